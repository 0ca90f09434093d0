"""Candidate pairs without comparing everything with everything."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.normalize import normalize_description
from ledgerloom.operators.frames import cut_lineage, staged, unstage
from ledgerloom.operators.nearest import PLACES, nearest as most_similar
from ledgerloom.operators.ranks import running_sum

#: Width of the logarithmic amount buckets.
STEP = math.log(1.26)
KEY_PREFIX, KEY_MIN = 8, 4


def _amount_bucket(c: Column) -> Column:
    return F.floor(F.log(F.abs(c)) / STEP)


def _sides(internal: DataFrame, external: DataFrame) -> tuple[DataFrame, DataFrame]:
    i = internal.select(F.col("id").alias("internal_id"), F.col("amount").cast("double").alias("ia"), F.col("txn_date").alias("idate"))
    e = external.select(F.col("id").alias("external_id"), F.col("amount").cast("double").alias("ea"), F.col("txn_date").alias("edate"))
    return i, e


def _in_days(days: int) -> Column:
    return F.coalesce(F.abs(F.datediff("idate", "edate")) <= days, F.lit(True))


def candidates_by_amount(internal: DataFrame, external: DataFrame, tolerance: float = 0.20, days: int = 20, nearest: int = 10) -> DataFrame:
    """(internal_id, external_id): the external rows nearest in amount within the band around the internal
    amount (of equal gaps the lesser id), then of these those near in date.

    Only the rows next to an amount in the order of amounts can be among the nearest, so the join is on blocks of
    that order: an internal amount meets the rows around its own block, however many the band holds. Each internal amount is
    looked up once, whatever number of rows has it; of external rows of one amount no more than `nearest` can ever be taken.
    """
    i, e = _sides(internal, external)
    i, e = i.where("ia IS NOT NULL AND ia <> 0"), e.where("ea IS NOT NULL AND ea <> 0")
    e = e.withColumn("same", F.row_number().over(Window.partitionBy("ea").orderBy("external_id"))).where(F.col("same") <= nearest).drop("same")
    amounts = i.select("ia").distinct().select(F.lit(0).alias("side"), F.lit(None).cast(e.schema["external_id"].dataType).alias("id"), F.col("ia").alias("a"), F.lit(None).cast("date").alias("day"))
    both = amounts.unionByName(e.select(F.lit(1).alias("side"), F.col("external_id").alias("id"), F.col("ea").alias("a"), F.col("edate").alias("day")))
    # An external row's place is its rank by (amount, id), an internal amount's the number of external rows up to it.
    placed = running_sum(both, [], [F.col("a"), F.desc("side"), F.col("id")], F.col("side"), "place")
    # Nearest are among the `nearest` places above and the 2 * `nearest` up to it, as equal amounts below stand with their least id farthest away. The
    # rows around each block are one array, so that no pair is made but for these.
    size, below = max(64, 2 * nearest), 2 * nearest
    block = lambda place: F.floor(place / size)
    other = placed.where("side = 1").select("place", F.col("id").alias("external_id"), F.col("a").alias("ea"), F.col("day").alias("edate"))
    other = other.withColumn("block", F.explode(F.sequence(block(F.col("place") - nearest), block(F.col("place") + below))))
    around = staged(other.groupBy("block").agg(F.collect_list(F.struct("place", "ea", "external_id", "edate")).alias("rows")), "around")
    own = placed.where("side = 0").select(F.col("a").alias("ia"), F.col("place").alias("at"), block(F.col("place")).alias("block"))
    window = F.abs("ia") * tolerance
    near = lambda x: (x["place"] > F.col("at") - below) & (x["place"] <= F.col("at") + nearest) & (x["ea"] >= F.col("ia") - window) & (x["ea"] <= F.col("ia") + window)
    gaps = F.transform(F.filter("rows", near), lambda x: F.struct(F.abs(x["ea"] - F.col("ia")).alias("gap"), x["external_id"].alias("external_id"), x["edate"].alias("edate")))
    best = own.join(around.hint("merge"), "block").select("ia", F.explode(F.slice(F.array_sort(gaps), 1, nearest)).alias("x"))
    best = staged(best.select("ia", "x.external_id", "x.edate"), "by-amount")
    return i.join(best.hint("merge"), "ia").where(_in_days(days)).select("internal_id", "external_id")


def blocking_keys(docs: DataFrame, ceiling: float = 0.10, key: str = "id") -> DataFrame:
    """(id, block): the beginnings of a description's longer words, but for those that more than a share of all rows
    have. That cut is also what bounds a block."""
    words = F.array_distinct(F.transform(F.filter(F.split(normalize_description(F.col("description")), " "), lambda w: F.char_length(w) >= KEY_MIN), lambda w: F.substring(w, 1, KEY_PREFIX)))
    rows = docs.select(key, F.explode(words).alias("block"))
    n = docs.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) * ceiling)).alias("most"))
    often = rows.groupBy("block").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(n)).where("n > most").select("block")
    # No more than 1 / ceiling times the words of a row are that frequent. They go to all tasks, so that the rows of none are gathered in one.
    return rows.join(F.broadcast(often), "block", "left_anti").select(key, "block")


def _cells(low: str, high: str, levels: int) -> str:
    """SQL of an array of (level, x): cells of 2^level fine buckets each that make up the buckets from `low` up to, but without, `high`; the
    larger a cell the better, so there are few, at most two of a size."""
    parts = []
    for k in range(levels):
        lo, hi, up_lo, up_hi = f"-shiftright(-({low}), {k})", f"shiftright({high}, {k})", f"-shiftright(-({low}), {k + 1})", f"shiftright({high}, {k + 1})"
        whole = f"sequence({lo}, {hi} - 1)"
        beside = f"filter(array(IF({lo} < 2 * {up_lo}, {lo}, NULL), IF({hi} > 2 * {up_hi}, {hi} - 1, NULL)), x -> x IS NOT NULL)"
        some = f"IF({up_lo} < {up_hi}, {beside}, {whole})" if k + 1 < levels else whole
        parts.append(f"transform(IF({lo} < {hi}, {some}, CAST(array() AS ARRAY<BIGINT>)), x -> struct({k} AS level, x AS x))")
    return f"flatten(array({', '.join(parts)}))"


def _in_few(i: DataFrame, e: DataFrame, few: int, hot: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Rows of both sides whose block has no more than `few` of e, and the other rows. A block of more than `hot` rows on a side is one of the
    others; these are at most a row's share of `hot` and go to all tasks, so that no join on blocks gathers one."""
    crowds = [rows.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("block") for rows in (i, e)]
    crowds = staged(crowds[0].unionByName(crowds[1]).distinct(), "hot")
    sizes = e.groupBy("block").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(crowds), "block", "left_anti")
    sizes = staged(sizes, "sizes")
    out = []
    for rows in (i, e):
        cool = rows.join(F.broadcast(crowds), "block", "left_anti").join(sizes.hint("merge"), "block")
        out.append((cool.where(F.col("n") <= few).drop("n"), cool.where(F.col("n") > few).drop("n").unionByName(rows.join(F.broadcast(crowds), "block", "left_semi"))))
    return out[0][0], out[1][0], out[0][1], out[1][1]


def nearest_days(i: DataFrame, e: DataFrame, low: float, high: float, days: int, nearest: int, light: int = 64, few: int = 64, hot: int = 10_000) -> DataFrame:
    """(internal_id, external_id, gap): for each internal row the `nearest` rows by days (then by id) that share a block with it and whose
    amount is a share from `low` to `high` of its own, up to `days` days away.

    i has (block, internal_id, ia, day), e (block, external_id, ea, day), days as numbers. Blocks with no more than `few` rows of e are
    joined at once. In the others days are taken in rings outwards, and a row leaves once it has enough. On a day where a block has more
    than `light` rows, a band of amounts is made up of cells, of which only the first `nearest` ids each can count, and their list
    is made once for all rows of one band; rows are compared one by one only in the two fine buckets at the band's ends.
    """
    step = STEP / 16
    levels = max(1, math.ceil(math.log2(max(2.0, math.log(high / low) / step))))
    fine = lambda c: F.floor(F.log(c) / step)
    band = (F.col("ea") >= F.col("ia") * low) & (F.col("ea") <= F.col("ia") * high)
    first = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("external_id"))
    cols = ["internal_id", "external_id", "gap"]
    near = Window.partitionBy("internal_id").orderBy("gap", "external_id")
    # Equal pairs, of several blocks, have one rank and stand side by side. What is not among the first of a part is not among the first of all.
    again = F.coalesce(F.lag("external_id").over(near) == F.col("external_id"), F.lit(False))
    top = lambda rows: rows.select(*cols).withColumns({"r": F.dense_rank().over(near), "again": again}).where((F.col("r") <= nearest) & ~F.col("again")).select(*cols)
    # Rows of one block, day and amount differ in their ids alone.
    e = e.withColumn("r", first("block", "day", "ea")).where(F.col("r") <= nearest).drop("r")
    i, e = staged(i, "left"), staged(e, "receipts")
    si, se, i, e = _in_few(i, e, few, hot)
    gap = F.abs(F.col("day") - F.col("other"))
    at_once = staged(top(si.join(se.withColumnRenamed("day", "other").hint("merge"), "block").where(band & (gap <= days)).withColumn("gap", gap)), "at-once")
    e = staged(e, "receipts")
    seen = staged(e.groupBy("block", "day").agg(F.count(F.lit(1)).alias("n"), F.min("ea").alias("least"), F.max("ea").alias("most")), "days")
    crowd = staged(e.join(seen.where(F.col("n") > light).select("block", "day").hint("merge"), ["block", "day"], "left_semi").withColumn("f", fine(F.col("ea"))), "crowded")
    cells = crowd.withColumn("c", F.explode(F.expr(f"transform(sequence(0, {levels - 1}), k -> struct(k AS level, shiftright(f, k) AS x))"))).select("block", "day", "external_id", "c.level", "c.x")
    cells = staged(cells.withColumn("r", first("block", "day", "level", "x")).where(F.col("r") <= nearest).drop("r"), "cells")
    rings, reach = [[0]], 1
    while reach <= days:
        rings.append([s * k for k in range(reach, min(days, 2 * reach - 1) + 1) for s in (-1, 1)])
        reach *= 2
    left, parts, crowded = staged(i, "left"), [], bool(crowd.limit(1).count())
    small = left.count() / 20
    while rings:
        ring = rings.pop(0)
        at = left.withColumn("off", F.explode(F.array(*map(F.lit, ring)))).withColumn("day", F.col("day") + F.col("off"))
        at = at.join(seen.hint("merge"), ["block", "day"]).where((F.col("most") >= F.col("ia") * low) & (F.col("least") <= F.col("ia") * high))
        at = staged(at.select("block", "day", "internal_id", "ia", F.abs("off").alias("gap"), "n"), "reach")
        made = at.where(F.col("n") <= light).join(e.hint("merge"), ["block", "day"]).where(band).select(*cols)
        if crowded:
            many = at.where(F.col("n") > light).withColumn("f0", fine(F.col("ia") * low)).withColumn("f1", fine(F.col("ia") * high))
            bands = many.select("block", "day", "f0", "f1").distinct().withColumn("c", F.explode(F.expr(_cells("f0 + 1", "f1", levels))))
            lists = bands.select("block", "day", "f0", "f1", "c.level", "c.x").join(cells.hint("merge"), ["block", "day", "level", "x"])
            lists = lists.withColumn("r", first("block", "day", "f0", "f1")).where(F.col("r") <= nearest).select("block", "day", "f0", "f1", "external_id")
            inner = many.join(lists.hint("merge"), ["block", "day", "f0", "f1"])
            edge = many.withColumn("f", F.explode(F.array_distinct(F.array("f0", "f1")))).join(crowd.hint("merge"), ["block", "day", "f"]).where(band)
            made = made.unionByName(inner.select(*cols)).unionByName(edge.select(*cols))
        parts.append(staged(top(made), "ring"))
        unstage(at)
        found = parts[0]
        for p in parts[1:]:
            found = found.unionByName(p)
        if not rings:
            break
        enough = found.groupBy("internal_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= nearest).select("internal_id")
        old, left = left, staged(left.join(enough.hint("merge"), "internal_id", "left_anti"), "left")
        unstage(old)
        many_left = left.count()
        if not many_left:
            break
        # Every ring reads all cells; for few rows the rest is one ring.
        if many_left <= small:
            rings = [[off for r in rings for off in r]]
    return top(found.unionByName(at_once))


def candidates_by_share(internal: DataFrame, external: DataFrame, low: float = 0.05, high: float = 0.95, days: int = 20, nearest: int = 10) -> DataFrame:
    """(internal_id, external_id): external amounts that are a share of the internal one. Rows that share a block with any in the band keep to the
    block; the others look over the whole band. The nearest by date are kept (by amount without a date).

    Whether a block has any row in the band is read off the least and greatest amount of its amount buckets, so no pair is made
    for it. Of dated rows only those within reach can stay, whatever their rank, and they are looked for by rings of days. Pairs with
    an undated side are joined by amount buckets, and they rank after those.
    """
    if high / low < math.exp(2 * STEP):
        raise ValueError("the band must be wider than two amount buckets")
    i, e = _sides(internal, external)
    i, e = i.where("ia > 0"), e.where("ea > 0")
    keys = blocking_keys(internal.select("id", "description").unionByName(external.select("id", "description")))
    ik = staged(i.join(keys.withColumnRenamed("id", "internal_id").hint("merge"), "internal_id"), "keyed")
    ek = staged(e.join(keys.withColumnRenamed("id", "external_id").hint("merge"), "external_id"), "keyed")
    band = (F.col("ea") >= F.col("ia") * low) & (F.col("ea") <= F.col("ia") * high)
    steps = F.sequence(F.lit(math.floor(math.log(low) / STEP) - 1), F.lit(0))
    spread = lambda rows: rows.withColumn("amounts", F.explode(F.transform(steps, lambda k: _amount_bucket(F.col("ia")) + k)))
    bounds = ek.groupBy("block", _amount_bucket(F.col("ea")).alias("amounts")).agg(F.min("ea").alias("least"), F.max("ea").alias("most"))
    # The band is wider than a bucket, so of a bucket that reaches into it one bound is inside. A block has few buckets, which are one array.
    bounds = bounds.groupBy("block").agg(F.collect_list(F.struct("least", "most")).alias("bounds"))
    inside = F.exists("bounds", lambda x: (x["most"] >= F.col("ia") * low) & (x["least"] <= F.col("ia") * high))
    some = staged(ik.select("block", "internal_id", "ia").join(bounds.hint("merge"), "block").where(inside).select("internal_id").distinct(), "some")
    whole = F.lit("").alias("block")
    # Nothing is in no block: rows that look over the whole band are together in one of their own.
    inner = ik.select("block", "internal_id", "ia", "idate").unionByName(i.join(some.hint("merge"), "internal_id", "left_anti").select(whole, "internal_id", "ia", "idate"))
    outer = ek.select("block", "external_id", "ea", "edate").unionByName(e.select(whole, "external_id", "ea", "edate"))
    day = lambda c: F.datediff(F.col(c), F.lit("1970-01-01").cast("date"))
    dated = nearest_days(inner.where("idate IS NOT NULL").select("block", "internal_id", "ia", day("idate").alias("day")), outer.where("edate IS NOT NULL").select("block", "external_id", "ea", day("edate").alias("day")), low, high, days, nearest)
    if not i.where("idate IS NULL").limit(1).count() and not e.where("edate IS NULL").limit(1).count():
        return dated.select("internal_id", "external_id")
    blank = lambda a, b: spread(a).join(b.withColumn("amounts", _amount_bucket(F.col("ea"))).hint("merge"), ["block", "amounts"]).where(band)
    rest = blank(inner.where("idate IS NULL"), outer).unionByName(blank(inner.where("idate IS NOT NULL"), outer.where("edate IS NULL")))
    far = F.when(F.col("idate").isNotNull(), F.lit(float("inf"))).otherwise(F.abs(F.col("ea") - F.col("ia")))
    top = Window.partitionBy("internal_id").orderBy("gap", "external_id")
    both = dated.withColumn("gap", F.col("gap").cast("double")).unionByName(rest.select("internal_id", "external_id", far.alias("gap")).distinct())
    return both.withColumn("r", F.row_number().over(top)).where(F.col("r") <= nearest).select("internal_id", "external_id")


def candidates_by_cluster(clusters: DataFrame, internal: DataFrame, external: DataFrame, vi: DataFrame, ve: DataFrame, most: int = 6) -> DataFrame:
    """(internal_id, external_id): for each internal row the most similar external rows of its cluster, of equal ones those with the
    lesser id. Equal texts of a cluster are compared once, and of external rows with one text no more than `most` can be
    taken."""
    known = clusters.where("cluster <> '-1'").select("id", F.col("cluster").alias("g"))
    side = lambda rows: rows.select("id", normalize_description(F.col("description")).alias("t")).join(known.hint("merge"), "id")
    whole = lambda ids, v: ids.join(v.hint("merge"), "id").groupBy("g", "id").agg(F.array_sort(F.collect_list(F.struct("term", "w"))).alias("vec"))
    return within_clusters(side(internal), side(external), lambda ids: whole(ids, vi), lambda ids: whole(ids, ve), most)


def within_clusters(internal: DataFrame, external: DataFrame, vi: Callable[[DataFrame], DataFrame], ve: Callable[[DataFrame], DataFrame], most: int = 6) -> DataFrame:
    """The same of rows (id, t, g) of both sides, which have a text or its number, and that of their cluster. `vi` and `ve` give the vectors
    (g, id, vec) of rows (g, id, t)."""
    a = cut_lineage(internal.withColumn("first", F.min("id").over(Window.partitionBy("g", "t"))).select("g", "t", "first", F.col("id").alias("internal_id")))
    same = Window.partitionBy("g", "t").orderBy("id")
    b = cut_lineage(external.withColumn("r", F.row_number().over(same)).where(F.col("r") <= most).withColumn("first", F.min("id").over(Window.partitionBy("g", "t"))).select("g", "t", "first", F.col("id").alias("external_id")))
    # A cluster without rows of one side has no pairs.
    shared = cut_lineage(a.select("g").distinct().join(b.select("g").distinct().hint("merge"), "g"))
    a, b = a.join(shared.hint("merge"), "g", "left_semi"), b.join(shared.hint("merge"), "g", "left_semi")
    # A text's first row stands for it.
    ids = lambda rows, own: rows.where(F.col("first") == F.col(own)).select("g", F.col("first").alias("id"), "t")
    ia, ib = ids(a, "internal_id"), ids(b, "external_id")
    wa, wb = (cut_lineage(v(rows).select("g", "id", F.transform("vec", lambda x: F.struct(x["term"].alias("term"), x["w"].alias("w"))).alias("vec"))) for v, rows in ((vi, ia), (ve, ib)))
    spread = lambda whole: whole.select("g", "id", F.explode("vec").alias("x")).select("g", "id", "x.term", "x.w")
    near = most_similar(spread(wa), spread(wb), most, ia, ib, (wa, wb)).select("g", F.col("a").alias("own"), F.col("b").alias("first"), "cos")
    top = Window.partitionBy("g", "own").orderBy(F.desc(F.round("cos", PLACES)), "external_id")
    best = near.join(b.drop("t").hint("merge"), ["g", "first"]).withColumn("r", F.row_number().over(top)).where(F.col("r") <= most)
    return a.select("g", F.col("first").alias("own"), "internal_id").join(best.select("g", "own", "external_id").hint("merge"), ["g", "own"]).select("internal_id", "external_id")


def all_candidates(*channels: DataFrame) -> DataFrame:
    out = channels[0]
    for c in channels[1:]:
        out = out.unionByName(c)
    # Dealt by internal row, as scoring then needs them.
    return out.repartition("internal_id").dropDuplicates(["internal_id", "external_id"])
