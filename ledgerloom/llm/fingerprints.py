"""Document fingerprints: invertible Bloom lookup tables of paragraph digests, subtracted and peeled."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import staged
from ledgerloom.llm.spans import let

#: A paragraph: up to so many words of one line.
WORDS = 24
#: Entries (of two versions together) that one subtable expects, and the cells of each of its three rows at the first try.
LOAD, ROW = 16, 8
#: A sketch has so many times the subtables that its digests call for.
SPARE = 2
#: Tries of one table alone: each has four times the cells of the one before, under other hashes.
TRIES = 6
ROUNDS = 12
#: Rounds of peeling that all tables get at once, before the few that are left over are tried singly.
FIRST_ROUNDS = 5


def paragraphs(text: Column) -> Column:
    """Distinct 64-bit digests of the paragraphs."""
    found = F.regexp_extract_all(text, F.lit(r"(?:[^\s]++[^\S\n]*+){1,%d}+" % WORDS), F.lit(0))
    return F.array_distinct(F.transform(found, lambda p: F.xxhash64(F.rtrim(p))))


def subtables(n: Column) -> Column:
    """Into how many subtables the sketch of a version with n digests is dealt: the power of two that holds as many again from
    another version, with room to SPARE, as small tables are often dealt unevenly. A digest lies in the subtable of its low bits, so a sketch folds to any smaller power of two by adding
    subtables up, and two versions are subtracted at the smaller of their sizes."""
    return F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.lit(1.0), SPARE * 2 * n / LOAD)))).cast("long")


def dealt(xs: Column, tables: Column, of: Callable[[Column], Column]) -> Column:
    """For each of `tables` subtables, a power of two, the elements whose digest (`of`) lies in it. The array is halved by one bit after
    another, the highest first, so the work grows with n log n and not with n times the subtables."""
    steps = F.transform(F.sequence(F.lit(1), F.round(F.log2(tables)).cast("int")), lambda j: (tables / F.pow(F.lit(2.0), j)).cast("long"))
    bit = lambda x, step: F.shiftright(of(x), 8).bitwiseAND(step)
    half = lambda g, step: F.array(F.filter(g, lambda x: bit(x, step) == 0), F.filter(g, lambda x: bit(x, step) != 0))
    halved = F.aggregate(steps, F.array(xs), lambda gs, step: F.flatten(F.transform(gs, lambda g: half(g, step))))
    return F.when(tables == 1, F.array(xs)).otherwise(halved)


def together(n: Column, m: Column) -> Column:
    """The number of subtables at which sketches of n and m digests are compared first: the smaller of theirs, unless so many
    digests must differ that they cannot be recovered from it; then what holds all of both."""
    own, whole = F.least(subtables(n), subtables(m)), subtables((n + m) / 2)
    return F.when(F.abs(n - m) > own * LOAD, whole).otherwise(own)


def _entry(x: Column, c: Column, row: Column, seed: Column) -> Column:
    """A digest with its sign, its check value and its cell in each of the three rows."""
    h = F.xxhash64(x, seed)
    at = lambda j: (row * j + F.pmod(F.shiftrightunsigned(h, 20 * j).bitwiseAND(F.lit(0xFFFFF)), row)).cast("int")
    return F.struct(x.alias("x"), c.alias("c"), F.xxhash64(x, F.lit(17)).alias("y"), at(0).alias("p0"), at(1).alias("p1"), at(2).alias("p2"))


def _into(cell: Column, entries: Column, i: Column, sign: int) -> Column:
    """A cell after adding (or taking away) the entries that lie in it."""
    here = F.filter(entries, lambda e: (e["p0"] == i) | (e["p1"] == i) | (e["p2"] == i))
    return F.aggregate(here, cell, lambda a, e: F.struct((a["c"] + e["c"] * sign).alias("c"), a["x"].bitwiseXOR(e["x"]).alias("x"), a["y"].bitwiseXOR(e["y"]).alias("y")))


def _zero() -> Column:
    return F.struct(F.lit(0).alias("c"), F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"))


def lookup_table(entries: Column, row: Column) -> Column:
    """The cells: sums of signs, and exclusive ors of digests and check values, of what lies in each."""
    return F.transform(F.sequence(F.lit(0), (row * 3 - 1).cast("int")), lambda i: _into(_zero(), entries, i, 1))


def peeled(cells: Column, row: Column, seed: Column) -> Column:
    """Number of digests recovered from a subtracted table, or -1 if it can't be emptied.

    A cell with one entry left names it; taking such entries out of their other cells frees more.
    """
    state = F.struct(cells.alias("cells"), F.lit(0).alias("n"), F.lit(1).alias("new"))

    def step(s: Column, _: Column) -> Column:
        pure = F.filter(s["cells"], lambda c: (F.abs(c["c"]) == 1) & (c["y"] == F.xxhash64(c["x"], F.lit(17))))
        out = F.array_distinct(F.transform(pure, lambda c: _entry(c["x"], c["c"], row, seed)))
        return let(
            out,
            lambda es: F.struct(
                F.when(F.size(es) == 0, s["cells"]).otherwise(F.transform(s["cells"], lambda c, i: _into(c, es, i, -1))).alias("cells"),
                (s["n"] + F.size(es)).alias("n"),
                F.size(es).alias("new"),
            ),
        )

    return F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)),
        state,
        lambda s, r: F.when(s["new"] > 0, step(s, r)).otherwise(s),
        lambda s: F.when(F.forall(s["cells"], lambda c: (c["c"] == 0) & (c["x"] == 0) & (c["y"] == 0)), s["n"]).otherwise(-1),
    )


def differing(both: Column) -> Column:
    """How many digests differ between two versions, or -1. `both` has x and c: 1 for one version, -1 for the
    other. Tables are linear, so filling one with both signs is the subtraction of the two. Large sets are
    dealt into subtables by digest; one that fails is tried again with four times the cells."""

    def tried(v: Column, level: Column) -> Column:
        return let(
            (F.lit(ROW) * F.pow(F.lit(4), level)).cast("int"),
            lambda row: let(F.transform(v, lambda e: _entry(e["x"], e["c"], row, level)), lambda entries: peeled(lookup_table(entries, row), row, level)),
        )

    def of(v: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(0), F.lit(TRIES - 1)), F.lit(-1), lambda d, level: F.when(d >= 0, d).otherwise(tried(v, level)))

    def total(tables: Column) -> Column:
        each = F.transform(dealt(both, tables, lambda e: e["x"]), of)
        return let(each, lambda ds: F.when(F.exists(ds, lambda d: d < 0), -1).otherwise(F.aggregate(ds, F.lit(0), lambda a, d: a + d)))

    return let(F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.lit(1.0), F.size(both) / LOAD)))).cast("long"), total)


def _signed(a: Column, b: Column) -> Column:
    one = lambda xs, c: F.transform(xs, lambda x: F.struct(x.alias("x"), F.lit(c).alias("c")))
    return F.concat(one(a, 1), one(b, -1))


def _slots(x: Column, tables: Column) -> list[Column]:
    """The three cells of a digest, numbered over all subtables: the same as those of `_entry` at the first try."""
    h = F.xxhash64(x, F.lit(0))
    table = F.pmod(F.shiftright(x, 8), tables).cast("long") * (4 * ROW)
    return [table + ROW * j + F.pmod(F.shiftrightunsigned(h, 20 * j).bitwiseAND(F.lit(0xFFFFF)), F.lit(ROW)) for j in range(3)]


def peel_together(sets: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, de, dn): digests recovered between a and e, and between a and n, or -1 where a table could not be emptied.

    `sets` has the arrays a, e, n and lies partitioned on `keys`. Both sketches of a comparison are filled at the size at
    which they meet (`together`), one with the other sign, which is their subtraction. All of a partition are
    peeled together as rows: cells are sums by slot; a round makes each cell with one entry name it, lets every name
    count once, and adds it with the other sign to its three cells. Every grouping has the keys in it, so nothing is
    shuffled.
    """
    side = lambda cmp, c, xs, ys: F.struct(F.lit(cmp).alias("cmp"), F.lit(c).alias("c"), together(F.size("a"), F.size(ys)).alias("tables"), F.col(xs).alias("xs"))
    sides = F.explode(F.array(side(0, 1, "a", "e"), side(0, -1, "e", "e"), side(1, 1, "a", "n"), side(1, -1, "n", "n")))
    entries = sets.select(*keys, sides.alias("s")).select(*keys, (F.col("s.tables") * 2 + F.col("s.cmp")).alias("tag"), F.col("s.c").cast("long").alias("c"), F.col("s.tables").alias("tables"), F.explode("s.xs").alias("x"))
    group = [*keys, "tag", "slot"]
    full = (F.col("c") != 0) | (F.col("x") != 0) | (F.col("y") != 0) | (F.col("slot") < 0)
    cells = (
        entries.select(*keys, "tag", "c", "x", F.xxhash64("x", F.lit(17)).alias("y"), F.explode(F.array(*_slots(F.col("x"), F.col("tables")))).alias("slot"))
        .groupBy(*group)
        .agg(F.sum("c").alias("c"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
        .where(full)
        .withColumn("found", F.lit(0).cast("long"))
    )
    own = lambda kind, at: F.struct(F.lit(kind).alias("kind"), at.alias("at"), "c", "x", "y", "found")
    put = lambda slot, c, x, y, found: F.struct(slot.alias("slot"), c.alias("c"), x.alias("x"), y.alias("y"), found.alias("found"))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    for _ in range(FIRST_ROUNDS):
        pure = (F.abs("c") == 1) & (F.col("y") == F.xxhash64("x", F.lit(17))) & (F.col("slot") >= 0)
        named = cells.select(*keys, "tag", F.explode(F.when(pure, F.array(own(0, F.col("slot")), own(1, F.col("x")))).otherwise(F.array(own(0, F.col("slot"))))).alias("r")).select(*keys, "tag", "r.*")
        # A digest that several cells name counts once.
        once = named.groupBy(*keys, "tag", "kind", "at").agg(*[F.min(c).alias(c) for c in ("c", "x", "y", "found")])
        taken = [put(s, -F.col("c"), F.col("x"), F.col("y"), zero) for s in _slots(F.col("x"), F.shiftright("tag", 1))]
        out = F.when(F.col("kind") == 0, F.array(put(F.col("at"), F.col("c"), F.col("x"), F.col("y"), F.col("found")))).otherwise(F.array(put(F.lit(-1).cast("long"), zero, zero, zero, one), *taken))
        cells = once.select(*keys, "tag", F.explode(out).alias("r")).select(*keys, "tag", "r.*").groupBy(*group).agg(F.sum("c").alias("c"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.sum("found").alias("found")).where(full)
    of = lambda cmp: F.pmod("tag", F.lit(2)) == cmp
    d = lambda cmp: F.when(F.count_if(of(cmp) & (F.col("slot") >= 0)) > 0, -1).otherwise(F.coalesce(F.sum(F.when(of(cmp), F.col("found"))), F.lit(0)))
    return cells.groupBy(*keys).agg(d(0).cast("int").alias("de"), d(1).cast("int").alias("dn"))


def printed(digests: Column) -> Column:
    """The sketch of one version as text: the number of subtables, then the cells of each, row by row: count, digests and checks as
    sixteenth figures, nothing for an empty cell. Its size follows from the version alone."""
    hexed = lambda c, name: F.lower(F.hex(c[name]))
    cell = lambda c: F.when(c["c"] == 0, F.lit("")).otherwise(F.concat_ws(".", hexed(c, "c"), hexed(c, "x"), hexed(c, "y")))
    row = F.lit(ROW)

    def table(es: Column) -> Column:
        return F.array_join(F.transform(lookup_table(es, row), cell), "-")

    def of(tables: Column) -> Column:
        each = F.transform(dealt(digests, tables, lambda x: x), lambda xs: let(F.transform(xs, lambda x: _entry(x, F.lit(1), row, F.lit(0))), table))
        return F.concat(tables.cast("string"), F.lit(":"), F.array_join(each, "-"))

    return let(subtables(F.size(digests)), of)


def _likeness(a: str, b: str, d: str) -> Column:
    n = F.size(a) + F.size(b)
    return F.when(n == 0, F.lit(1.0)).otherwise((n - F.col(d)) / (n + F.col(d)))


def ring(keys: DataFrame) -> DataFrame:
    """(k1, k2, n_chars, n1, n2): each distinct row key and its text's length with the next one, by descending id (null last), then key; after the
    last comes the first. Ids are range-partitioned and led within partitions; only one row for each partition meets
    in one task, to carry the lead over the borders."""
    spread = keys.select("doc_id", "k1", "k2", "n_chars").distinct()
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc_nulls_last("doc_id"), F.asc("k1"), F.asc("k2")]
    ranged = staged(spread.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "ring-keys")
    w = Window.partitionBy("part").orderBy(*order)
    here = F.struct("k1", "k2")
    led = ranged.withColumn("next", F.lead(here).over(w)).withColumn("row", F.row_number().over(w))
    firsts = led.where("row = 1").select("part", here.alias("first"))
    parts = Window.orderBy("part")
    start = F.first("first").over(parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    border = firsts.select("part", F.coalesce(F.lead("first").over(parts), start).alias("border"))
    out = led.join(border.hint("merge"), "part").withColumn("next", F.coalesce("next", "border"))
    return out.select("k1", "k2", "n_chars", F.col("next.k1").alias("n1"), F.col("next.k2").alias("n2"))


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness.

    The edited text has the last third replaced by the beginning of the next document (descending
    doc_id, of equal ids by a hash; after the last the first). A fingerprint is the sketch of a version's distinct paragraphs, sized by
    that version alone. Likeness is the share of paragraphs in common: two fingerprints, folded to the smaller size, are
    subtracted and peeled, and the digests recovered are those that differ. Where so many differ that they cannot
    be recovered, larger sketches of both versions are made and tried again (`tries_edited`, `tries_next`: 0 where the
    fingerprints themselves were enough, 1 if a larger sketch was needed, 2 if none could be emptied and the digests were
    compared one by one).

    Null text is empty; texts without a word have an empty table and are fully alike; rows that repeat
    id and text have the same next document; null ids come last; texts of any length are read whole;
    other columns are ignored; an empty table gives an empty result. Rows are known by 128 bits of id and text.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))
    keyed = rows.select("doc_id", F.xxhash64(name, "text").alias("k1"), F.xxhash64("text", name, F.lit("second")).alias("k2"), "text")
    after = staged(ring(keyed.withColumn("n_chars", F.char_length("text"))), "ring")
    # Each document sends the one before it as much of its beginning as that one replaces; rows that repeat id and text
    # send it once. Both sides read the same shuffle of the texts.
    to = after.select(F.col("n1").alias("k1"), F.col("n2").alias("k2"), F.col("k1").alias("to1"), F.col("k2").alias("to2"), F.floor(F.col("n_chars") / 3).cast("int").alias("third"))
    sent = keyed.join(to.hint("merge"), ["k1", "k2"]).withColumn("_copy", F.row_number().over(Window.partitionBy("k1", "k2").orderBy("to1"))).where("_copy = 1")
    sent = sent.select(F.col("to1").alias("k1"), F.col("to2").alias("k2"), F.col("k1").alias("n1"), F.col("k2").alias("n2"), F.col("doc_id").alias("next_doc_id"), "third", F.substr("text", F.lit(1), F.col("third")).alias("next_text"))
    pairs = keyed.join(sent.hint("merge"), ["k1", "k2"]).withColumn("n_chars", F.char_length("text").cast("long"))
    edited = F.concat(F.substr("text", F.lit(1), (F.col("n_chars") - F.col("third")).cast("int")), F.col("next_text"))
    keys = ["k1", "k2", "n1", "n2"]
    sets = pairs.select("doc_id", "next_doc_id", *keys, "n_chars", "text", edited.alias("edited")).select(
        "doc_id", "next_doc_id", *keys, "n_chars", F.unhex(F.sha2("edited", 256)).alias("sha"), paragraphs(F.col("text")).alias("a"), paragraphs(F.col("edited")).alias("e")
    )
    sets = staged(sets, "paragraphs")
    # From here on only digests are read. Of repeated rows one is compared.
    distinct = sets.withColumn("_copy", F.row_number().over(Window.partitionBy("k1", "k2").orderBy("n1"))).where("_copy = 1").select(*keys, "a", "e")
    following = distinct.select(F.col("k1").alias("n1"), F.col("k2").alias("n2"), F.col("a").alias("n"))
    trio = distinct.join(following.hint("merge"), ["n1", "n2"])
    peeled_ = staged(peel_together(trio.select("n1", "n2", "a", "e", "n"), ["n1", "n2"]), "peeled")
    known = trio.join(peeled_.hint("merge"), ["n1", "n2"], "left").withColumns({"de": F.coalesce("de", F.lit(0)), "dn": F.coalesce("dn", F.lit(0))})
    larger = lambda d, other: F.when(F.col(d) < 0, differing(_signed(F.col("a"), F.col(other))))
    known = known.withColumns({"le": larger("de", "e"), "ln": larger("dn", "n")})
    one_by_one = lambda other: F.size(F.array_except("a", other)) + F.size(F.array_except(other, "a"))
    found = lambda d, again, other: F.when(F.col(d) >= 0, F.col(d)).when(F.col(again) >= 0, F.col(again)).otherwise(one_by_one(other))
    met = lambda other: together(F.size("a"), F.size(other)) == F.least(subtables(F.size("a")), subtables(F.size(other)))
    tries = lambda d, again, other: F.when((F.col(d) >= 0) & met(other), 0).when((F.col(d) >= 0) | (F.col(again) >= 0), 1).otherwise(2)
    known = known.withColumns({"tries_edited": tries("de", "le", "e"), "tries_next": tries("dn", "ln", "n"), "de": found("de", "le", "e"), "dn": found("dn", "ln", "n")})
    likely = known.select("k1", "k2", _likeness("a", "e", "de").alias("near_edited"), _likeness("a", "n", "dn").alias("near_next"), "tries_edited", "tries_next")
    return sets.join(likely.hint("merge"), ["k1", "k2"]).select(
        "doc_id", "next_doc_id", "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"), printed(F.col("a")).alias("fingerprint"), printed(F.col("e")).alias("edited_fingerprint"), "near_edited", "near_next", "tries_edited", "tries_next"
    )
