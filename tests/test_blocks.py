import datetime
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import block, match_rule, ranks, score
from tests.test_match import assigned, one_by_one, txns


def receipts(spark, n, seed, days=40, kinds=400):
    """Dated amounts: one block has all rows, another a tenth, and amounts repeat."""
    r = random.Random(seed)
    rows = [(b, f"e{k:05d}", float(r.choice(range(1, kinds))), r.randrange(days)) for k in range(n) for b in (["all", "tenth"] if k % 10 == 0 else ["all"])]
    own = [(b, f"i{k:05d}", float(r.choice(range(1, kinds))), r.randrange(days)) for k in range(n // 5) for b in (["all", "tenth"] if k % 10 == 0 else ["all"])]
    return spark.createDataFrame(own, "block string, internal_id string, ia double, day int"), spark.createDataFrame(rows, "block string, external_id string, ea double, day int"), own, rows


def by_hand(own, rows, low, high, days, nearest):
    out, each = set(), {}
    for b, i, ia, d in own:
        for c, e, ea, g in rows:
            if b == c and ia * low <= ea <= ia * high and abs(d - g) <= days:
                each.setdefault(i, set()).add((abs(d - g), e))
    for i, found in each.items():
        out |= {(i, e, g) for g, e in sorted(found)[:nearest]}
    return out


@pytest.mark.parametrize("light", [3, 10**6])
@pytest.mark.parametrize("low,high,days", [(0.05, 0.95, 20), (0.5, 0.9, 3)])
def test_rings_of_days_equal_every_pair_ranked(spark, light, low, high, days):
    i, e, own, rows = receipts(spark, 600, light % 7)
    got = [(r.internal_id, r.external_id, r.gap) for r in block.nearest_days(i, e, low, high, days, 10, light).collect()]
    assert len(got) == len(set(got)) and set(got) == by_hand(own, rows, low, high, days, 10)


def test_cells_make_up_a_range(spark):
    for low, high in [(0, 0), (5, 6), (-9, 14), (1, 200), (-3, -2), (7, 9)]:
        cells = spark.sql(f"SELECT {block._cells(f'{low}L', f'{high}L', 7)} AS c").first().c
        covered = [x for c in cells for x in range(c.x << c.level, (c.x + 1) << c.level)]
        assert sorted(covered) == list(range(low, high)) and len(cells) <= 16


def test_a_hot_block_makes_few_pairs(spark, monkeypatch):
    n, made = 20_000, []
    i, e, _, _ = receipts(spark, n, 1, days=10, kinds=4000)
    keep = block.staged

    def counted(df, name):
        out = keep(df, name)
        if name == "ring":
            made.append(out.count())
        return out

    monkeypatch.setattr(block, "staged", counted)
    assert block.nearest_days(i, e, 0.05, 0.95, 20, 10).count() > n
    assert sum(made) <= 20 * n  # a pair list of the block would be of n * n / 5 / 2


@pytest.mark.parametrize("few,hot", [(0, 10**6), (64, 100), (10**6, 10**6)])
def test_small_and_hot_blocks_equal_every_pair_ranked(spark, few, hot):
    r = random.Random(few + hot)
    blocks = lambda k: {f"b{k % 40}", "all" if k % 3 else f"b{r.randrange(40)}"}
    dealt = lambda p, n: [(b, *row) for row, bs in [((f"{p}{k:05d}", float(r.randrange(1, 300)), r.randrange(40)), blocks(k)) for k in range(n)] for b in sorted(bs)]
    rows, own = dealt("e", 400), dealt("i", 120)
    i, e = spark.createDataFrame(own, "block string, internal_id string, ia double, day int"), spark.createDataFrame(rows, "block string, external_id string, ea double, day int")
    got = [(x.internal_id, x.external_id, x.gap) for x in block.nearest_days(i, e, 0.05, 0.95, 20, 10, 4, few, hot).collect()]
    assert len(got) == len(set(got)) and set(got) == by_hand(own, rows, 0.05, 0.95, 20, 10)


def test_a_ring_leaves_a_row_no_more_than_it_can_take(spark, monkeypatch):
    n, made, keep = 4_000, [], block.staged
    i, e, own, _ = receipts(spark, n, 1, days=4, kinds=4000)

    def counted(df, name):
        out = keep(df, name)
        if name == "ring":
            made.append(out.groupBy("internal_id").count().agg(F.max("count")).first()[0] or 0)
        return out

    monkeypatch.setattr(block, "staged", counted)
    block.nearest_days(i, e, 0.05, 0.95, 20, 10)
    assert made and max(made) <= 10


def test_frequent_words_are_gathered_in_no_task(spark):
    docs = spark.range(200).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("common word"), F.col("id")).alias("description"))
    keys = block.blocking_keys(docs)
    assert {r.block for r in keys.collect()}.isdisjoint({"common"})
    plan = keys._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftAnti" in plan and "strategy=broadcast" in plan


def test_ranks_of_a_key_with_half_of_all_rows(spark):
    n = 40_000
    rows = spark.range(n).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 500)).alias("key"), F.sha2(F.col("id").cast("string"), 256).alias("id"))
    often = ranks.frequent(rows, ["key"], 1000)
    assert [r.key for r in often.collect()] == ["hot"] and ranks.frequent(rows, ["key"], n) is None
    out = ranks.numbered(rows, ["key"], [F.col("id")], often).collect()
    each = {}
    for r in out:
        each.setdefault(r.key, []).append((r.id, r._n))
    assert len(out) == n and all([k for _, k in sorted(v)] == list(range(1, len(v) + 1)) for v in each.values())


def test_a_frequent_key_is_numbered_by_even_tasks(spark):
    rows = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 500)).alias("key"), F.sha2(F.col("id").cast("string"), 256).alias("id"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        dealt = rows.where("key = 'hot'").repartitionByRange(16, F.col("key"), F.col("id")).groupBy(F.spark_partition_id()).count().collect()
        sizes = sorted(r["count"] for r in dealt)
        assert len(sizes) == 16 and sizes[-1] < 3 * sizes[8]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_rule_pairs_are_the_same_for_frequent_keys(spark):
    r = random.Random(3)
    rows = [(f"i{k:03d}", "erp", 10 if r.random() < 0.6 else k, 1, "a", "REF-1") for k in range(90)] + [(f"e{k:03d}", "bank_api", 10 if r.random() < 0.5 else k, 1, "a", "REF-1") for k in range(80)]
    i, e = match_rule.split_sides(txns(spark, rows))
    pairs = lambda **kw: {(x.internal_id, x.external_id) for x in match_rule.rule_match(i, e, **kw).collect()}
    assert pairs(key_rows=5) == pairs() and len(pairs()) > 30


def test_amounts_that_many_rows_have(spark):
    r = random.Random(8)
    money = lambda: r.choice([100, 100, 100, 101, r.randint(50, 150)])
    rows_i = [(f"i{k:03d}", "erp", money(), r.randint(1, 28), "a", None) for k in range(150)]
    rows_e = [(f"e{k:03d}", "bank_api", money(), r.randint(1, 28), "a", None) for k in range(150)]
    got = {(x.internal_id, x.external_id) for x in block.candidates_by_amount(txns(spark, rows_i), txns(spark, rows_e), days=9, nearest=4).collect()}
    want = set()
    for i in rows_i:
        near = sorted((abs(e[2] - i[2]), e[0], e[3]) for e in rows_e if abs(e[2] - i[2]) <= i[2] * 0.2)[:4]
        want |= {(i[0], k) for _, k, d in near if abs(d - i[3]) <= 9}
    assert got == want


def test_undated_rows_rank_after_dated_ones(spark):
    from decimal import Decimal

    kind = "id string, amount decimal(18,2), txn_date date, description string"
    day = lambda d: None if d is None else datetime.date(2026, 1, d)
    frame = lambda rows: spark.createDataFrame([(k, Decimal(a), day(d), "same words here") for k, a, d in rows], kind)
    i, e = frame([("i1", 100, 5), ("i2", 100, None)]), frame([("e1", 50, None), ("e2", 60, 9), ("e3", 90, 30), ("e4", 94, None)])
    got = {(x.internal_id, x.external_id) for x in block.candidates_by_share(i, e, nearest=2).collect()}
    assert got == {("i1", "e2"), ("i1", "e1"), ("i2", "e4"), ("i2", "e3")}


def test_a_chain_of_5000_links_and_stars(spark, monkeypatch):
    n, staged = 5000, []
    keep = score.staged
    monkeypatch.setattr(score, "staged", lambda df, name: (staged.append(name), keep(df, name))[1])
    rows = [(f"i{k:05d}", f"e{k:05d}", k / 10000) for k in range(n)] + [(f"i{k:05d}", f"e{k + 1:05d}", k / 10000 + 0.00005) for k in range(n - 1)]
    r = random.Random(6)
    rows += [(f"i{r.randrange(n):05d}x", f"e{r.randrange(n):05d}", r.random()) for _ in range(400)]
    rows = list({(a, b): (a, b, c) for a, b, c in rows}.values())
    assert assigned(spark, rows) == one_by_one(rows)
    assert staged.count("taken") < 30


def test_amounts_meet_only_the_places_around_them(spark, monkeypatch):
    import random
    from datetime import date

    from ledgerloom.operators import block

    r, day, made = random.Random(5), date(2026, 1, 1), {}
    monkeypatch.setattr(block, "staged", lambda df, name, f=block.staged: made.setdefault(name, f(df, name)))
    # Few amounts, so that many rows tie, on both sides of an amount and on it, and more below zero.
    amount = lambda: float(r.choice([-1, 1]) * r.randint(90, 110) * r.choice([1, 1, 1, 0.5]))
    i = [(f"I{k:03}", amount(), day) for k in range(120)]
    e = [(f"E{k:03}", amount(), day) for k in r.sample(range(900), 900)]
    frame = lambda rows: spark.createDataFrame(rows, "id string, amount double, txn_date date")
    got = {(x.internal_id, x.external_id) for x in block.candidates_by_amount(frame(i), frame(e)).collect()}
    want = set()
    for a, x, _ in i:
        near = sorted((abs(y - x), b) for b, y, _ in e if abs(y - x) <= 0.2 * abs(x))
        want |= {(a, b) for _, b in near[:10]}
    assert got == want
    assert max(len(x.rows) for x in made["around"].collect()) <= 64 + 3 * 10
