"""Scores of candidate pairs, one-to-one assignment, nominations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.normalize import clean_string
from ledgerloom.operators.frames import staged, unstage

# The weights of a pair's components, and the reasons of what is left.
WEIGHTS = {"description": 0.40, "amount": 0.35, "date": 0.15, "reference": 0.10}
AMOUNT_TOLERANCE, DATE_DAYS = 0.20, 10
BELOW, ISOLATED, NONE_NEAR, ONE_SIDED = "below confidence threshold", "isolated outlier - no similar transaction found", "no candidate counterpart", "no counterpart feed in this batch"


def amount_proximity(a: Column, b: Column) -> Column:
    """1 for equal amounts, down to 0 at the tolerance, relative to the larger."""
    big = F.greatest(F.abs(a), F.abs(b)).cast("double")
    gap = F.abs(a - b).cast("double") / F.nullif(big, F.lit(0.0))
    near = F.when(big == 0, 1.0).when(gap >= AMOUNT_TOLERANCE, 0.0).otherwise(1 - gap / AMOUNT_TOLERANCE)
    return F.when(a.isNull() | b.isNull(), 0.0).otherwise(near)


def date_proximity(a: Column, b: Column) -> Column:
    days = F.abs(F.datediff(a, b))
    return F.when(days < DATE_DAYS, 1 - days / DATE_DAYS).otherwise(0.0)


def reference_agreement(a: Column, b: Column) -> Column:
    x, y = F.upper(clean_string(a)), F.upper(clean_string(b))
    return F.when(x.isNull() | y.isNull(), 0.5).when(x == y, 1.0).otherwise(0.0)


def scored_side(rows: DataFrame, side: str) -> DataFrame:
    """What of a side's rows counts for scores, under its names; `side` is internal or external."""
    return rows.select(F.col("id").alias(f"{side}_id"), *[F.col(c).alias(f"{side[0]}_{c}") for c in ("amount", "txn_date", "reference_code")])


def score_pairs(pairs: DataFrame, internal: DataFrame, external: DataFrame) -> DataFrame:
    """Pairs (internal_id, external_id, similarity) with their components and confidence, four places."""
    return score_joined(pairs.join(scored_side(internal, "internal").hint("merge"), "internal_id").join(scored_side(external, "external").hint("merge"), "external_id"))


def score_joined(rows: DataFrame) -> DataFrame:
    """The same of pairs that have both sides' columns already."""
    parts = {
        "c_description": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("similarity"))),
        "c_amount": amount_proximity(F.col("i_amount"), F.col("e_amount")),
        "c_date": date_proximity(F.col("i_txn_date"), F.col("e_txn_date")),
        "c_reference": reference_agreement(F.col("i_reference_code"), F.col("e_reference_code")),
    }
    rows = rows.withColumns(parts)
    total = sum((F.col(f"c_{k}") * w for k, w in WEIGHTS.items()), F.lit(0.0))
    return rows.select("internal_id", "external_id", F.round(total, 4).alias("confidence"), F.lit("ML").alias("match_type"), *[F.round(c, 4).alias(c) for c in parts])


def _along_chains(ranked: DataFrame) -> DataFrame:
    """Pairs that are taken because of a chain: a pair with just one better neighbour is taken exactly if that one is not. Each
    step doubles how far a pair looks along such neighbours, until it sees one that is taken for certain or one with several better ones."""
    best = F.when(F.col("_i") == 2, F.struct(F.col("internal_id").alias("a"), F.col("_with").alias("b"))).otherwise(F.struct(F.col("_for").alias("a"), F.col("external_id").alias("b")))
    links = staged(ranked.where("_i + _e = 3").select("internal_id", "external_id", best.alias("to"), F.lit(True).alias("odd")), "chains")
    while True:
        on = links.select(F.struct(F.col("internal_id").alias("a"), F.col("external_id").alias("b")).alias("to"), F.col("to").alias("next"), F.col("odd").alias("more"))
        moved = F.col("next").isNotNull()
        step = links.join(on.hint("merge"), "to", "left").select("internal_id", "external_id", F.coalesce("next", "to").alias("to"), F.when(moved, F.col("odd") != F.col("more")).otherwise(F.col("odd")).alias("odd"), moved.alias("moved"))
        old, links = links, staged(step, "chains")
        unstage(old)
        if not links.where("moved").limit(1).count():
            break
    sure = ranked.where("_i = 1 AND _e = 1").select(F.struct(F.col("internal_id").alias("a"), F.col("external_id").alias("b")).alias("to"))
    return links.where("NOT odd").join(sure.hint("merge"), "to", "left_semi").select("internal_id", "external_id")


def assign_one_to_one(pairs: DataFrame, rounds: int = 6) -> DataFrame:
    """Greedy by confidence (ties by ids), each id once: rounds that keep the pairs which are best for both their
    sides, until no pair is left. Equal to taking pairs one by one from the top. What is left after so many `rounds` are chains of ever
    better neighbours, which are then followed to their ends in each round, however long they are."""
    cols = pairs.columns
    order = [F.desc("confidence"), "internal_id", "external_id"]
    own, other = Window.partitionBy("internal_id").orderBy(*order), Window.partitionBy("external_id").orderBy(*order)
    left, done = staged(pairs, "pairs"), []
    while True:
        ranked = left.withColumn("_i", F.row_number().over(own)).withColumn("_with", F.first("external_id").over(own)).withColumn("_e", F.row_number().over(other)).withColumn("_for", F.first("internal_id").over(other))
        if len(done) < rounds:
            taken = ranked.where("_i = 1 AND _e = 1").select(*cols)
        else:
            ranked = staged(ranked, "ranked")
            taken = ranked.where("_i = 1 AND _e = 1").select(*cols).unionByName(ranked.select(*cols).join(_along_chains(ranked).hint("merge"), ["internal_id", "external_id"], "left_semi").select(*cols))
        done.append(staged(taken, "taken"))
        ends = done[-1].select("internal_id", "external_id")
        old, left = left, staged(left.join(ends.select("internal_id").hint("merge"), "internal_id", "left_anti").join(ends.select("external_id").hint("merge"), "external_id", "left_anti").select(*cols), "pairs")
        unstage(old)
        if not left.limit(1).count():
            return done[0].sparkSession.read.schema(done[0].schema).parquet(*[d._staged_path for d in done])


def confirmed(threshold: float) -> Column:
    """Enough confidence, and an exact amount or reference besides."""
    exact = (F.col("match_type") == "RULE") | (F.col("c_amount") >= 0.999) | (F.col("c_reference") >= 0.999)
    return (F.col("confidence") >= threshold) & exact


def split_by_threshold(pairs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    ok = F.coalesce(confirmed(threshold), F.lit(False))
    return pairs.where(ok), pairs.where(~ok)


def _by_side(pairs: DataFrame) -> DataFrame:
    """Each pair twice: (id, other, confidence)."""
    return pairs.select(F.explode(F.array(F.struct(F.col("internal_id").alias("id"), F.col("external_id").alias("other")), F.struct(F.col("external_id").alias("id"), F.col("internal_id").alias("other")))).alias("p"), "confidence").select("p.id", "p.other", "confidence")


def best_near_miss(below: DataFrame) -> DataFrame:
    """(id, best_confidence, best_counterpart_id) over the pairs that were not confirmed."""
    best = F.max_by(F.col("other"), F.struct("confidence", F.col("other")))
    return _by_side(below).groupBy("id").agg(F.max("confidence").alias("best_confidence"), best.alias("best_counterpart_id"))


def nominations(scored: DataFrame, above: DataFrame) -> DataFrame:
    """(id, other, confidence, rank) of all scored pairs that touch no confirmed row."""
    free = scored.join(above.select("internal_id").hint("merge"), "internal_id", "left_anti").join(above.select("external_id").hint("merge"), "external_id", "left_anti")
    return _by_side(free).withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("confidence"), "other")))


def co_settling(nominated: DataFrame, amounts: DataFrame, floor: float = 0.80, most: int = 6, leg_share: float = 0.95, cover: float = 1.10) -> DataFrame:
    """(id, candidate_ids): counterparts that may settle a row together, best first. Legs are a fraction of the obligation each and
    do not exceed it by much together; fewer than two of these leave the best candidate alone. Where `amounts` have a name, the candidates
    are given by it."""
    own, other = amounts.select("id", F.col("amount").alias("obligation")), amounts.select(F.col("id").alias("other"), F.col("amount").alias("leg"), *(["name"] if "name" in amounts.columns else []))
    name = "name" if "name" in amounts.columns else "other"
    first = F.max("confidence").over(Window.partitionBy("id"))
    near = nominated.withColumn("top", first).where((F.col("rank") <= most) & (F.col("confidence") >= F.col("top") * floor)).join(own.hint("merge"), "id", "left").join(other.hint("merge"), "other", "left")
    fits = F.coalesce((F.col("leg") > 0) & (F.col("obligation") > 0) & (F.col("leg") < F.col("obligation") * leg_share), F.lit(False))
    order = Window.partitionBy("id").orderBy("rank")
    near = near.withColumn("fits", fits).withColumn("running", F.sum(F.when(F.col("fits"), F.col("leg")).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    over = F.max(F.when(F.col("fits") & (F.col("running") > F.col("obligation") * cover), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    near = near.withColumn("kept", F.col("fits") & (over == 0))
    ids = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda s: s[name])
    both = near.groupBy("id").agg(ids(F.when(F.col("kept"), F.struct("rank", name))).alias("legs"), F.min_by(name, "rank").alias("best"))
    return both.select("id", F.when(F.size("legs") >= 2, F.col("legs")).otherwise(F.array("best")).alias("candidate_ids"))


def unmatched_reasons(rows: DataFrame, above: DataFrame, near: DataFrame, co: DataFrame, isolated: DataFrame) -> DataFrame:
    """What was not confirmed and why, with the nearest miss and the co-settling candidates."""
    claimed = above.select(F.explode(F.array("internal_id", "external_id")).alias("id"))
    left = rows.join(claimed.hint("merge"), "id", "left_anti").join(near.hint("merge"), "id", "left").join(isolated.withColumn("isolated", F.lit(True)), "id", "left").join(co.hint("merge"), "id", "left")
    reason = F.when(F.col("best_confidence").isNotNull(), BELOW).when(F.col("isolated"), ISOLATED).otherwise(NONE_NEAR)
    return left.select(*rows.columns, reason.alias("reason"), "best_confidence", "best_counterpart_id", F.when(F.col("best_confidence").isNotNull(), F.col("candidate_ids")).alias("candidate_ids"))


def one_sided(rows: DataFrame) -> DataFrame:
    """The same of a batch that has one side only: nothing in it can be matched."""
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    return rows.select("id", F.lit(ONE_SIDED).alias("reason"), none("double", "best_confidence"), none("string", "best_counterpart_id"), none("array<string>", "candidate_ids"))


def threshold_sweep(assigned: DataFrame, truth: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, confirmed, correct, wrong) over pairs scored once. The thresholds are a short list of the caller's."""
    spark = assigned.sparkSession
    marked = assigned.join(truth.withColumn("true", F.lit(True)).hint("merge"), ["internal_id", "external_id"], "left")
    at = F.explode(F.array(*[F.lit(t) for t in thresholds]))
    grid = marked.withColumn("threshold", at).where(confirmed(F.col("threshold")))
    counts = grid.groupBy("threshold").agg(F.count(F.lit(1)).alias("confirmed"), F.count_if("true").alias("correct"))
    frame = spark.createDataFrame([(t,) for t in thresholds], "threshold double")
    filled = frame.join(counts, "threshold", "left")
    return filled.select("threshold", F.coalesce("confirmed", F.lit(0)).alias("confirmed"), F.coalesce("correct", F.lit(0)).alias("correct"), (F.coalesce("confirmed", F.lit(0)) - F.coalesce("correct", F.lit(0))).alias("wrong"))
