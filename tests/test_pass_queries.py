import datetime

from pyspark.sql import functions as F

from ledgerloom.operators import block, reconcile as R
from ledgerloom.plans import q_match, q_triage

SF, DAY = "/root/testdata/sf0.001", datetime.date(2001, 1, 1)


def passed(spark):
    """A pass over five rows, two of which are a pair."""
    pairs = spark.createDataFrame([("a", "x", 1.0, "RULE")], "internal_id string, external_id string, confidence double, match_type string")
    rows = spark.createDataFrame([(i, "erp" if i < "m" else "bank_api", 10.0, DAY, None, f"shop {i}", "USD") for i in "abcxy"], "id string, source_type string, amount double, txn_date date, reference_code string, description string, currency string")
    left = rows.where("id IN ('b', 'c', 'y')").select("id", F.lit(0.5).alias("best_confidence"), F.lit("y").alias("best_counterpart_id"), F.array(F.lit("y")).alias("candidate_ids"))
    return R.Result(pairs, lambda: left, pairs, pairs, rows.withColumn("amount", F.col("amount").cast("decimal(18,2)")))


def test_queries_over_a_pass_read_its_own_rows(spark, monkeypatch):
    whole = passed(spark)
    monkeypatch.setattr(R, "reconcile", lambda *a: whole)
    monkeypatch.setattr(q_triage, "reconcile", lambda *a: whole)
    for name in ("run_row", "reconcile_whole_summary"):
        row = q_match.Q[name][0](spark, SF).first()
        assert (row.rows, row.pairs, row.unmatched) == (5, 1, 3)
    assert {r.id for r in q_triage.Q["triage_of_unmatched"][0](spark, SF).collect()} == {"EXC-b", "EXC-c", "EXC-y"}


def test_bounds_of_a_block_are_looked_up_without_making_rows(spark, monkeypatch):
    plans, keep = {}, block.staged
    monkeypatch.setattr(block, "staged", lambda df, name: plans.setdefault(name, df._jdf.queryExecution().optimizedPlan().toString()) and keep(df, name))
    rows = lambda p, shift: spark.createDataFrame([(f"{p}{k:02d}", float(100 + 40 * k), DAY, f"client{(k + shift) % 12:02d} south") for k in range(12)], "id string, amount double, txn_date date, description string")
    got = {(x.internal_id, x.external_id) for x in block.candidates_by_share(rows("i", 0), rows("e", 3)).collect()}
    # A receipt of the same client is three rows down; the first three rows have none in the band and look over the whole of it.
    amount = lambda k: 100 + 40 * k
    band = {k: [j for j in range(12) if amount(k) * 0.05 <= amount(j) <= amount(k) * 0.95] for k in range(12)}
    want = {(f"i{k:02d}", f"e{j:02d}") for k, js in band.items() for j in ([k - 3] if k >= 3 else js)}
    assert got == want and len(want) > 9 and "Generate" not in plans["some"]
