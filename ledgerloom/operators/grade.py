"""Grading against answer keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.ranks import exact_percentile


def _share(a: str, b: str):
    return F.round(F.try_divide(F.col(a).cast("double"), F.nullif(b, F.lit(0)).cast("double")), 4)


def grade_detection(decisions: DataFrame) -> DataFrame:
    """Rows with `defect` (null: good) and status: what was caught, and what good was held back."""
    bad, held = F.col("defect").isNotNull(), F.col("status") == "QUARANTINED"
    n = decisions.agg(F.count_if(bad).alias("malformed"), F.count_if(bad & held).alias("caught"), F.count_if(~bad).alias("good"), F.count_if(~bad & held).alias("false_positives"))
    return n.withColumn("detection_rate", _share("caught", "malformed")).withColumn("false_positive_rate", _share("false_positives", "good"))


def _unordered(df: DataFrame) -> DataFrame:
    return df.select(F.least("internal_id", "external_id").alias("a"), F.greatest("internal_id", "external_id").alias("b")).distinct()


def grade_pairs(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """Precision and recall over unordered pairs, each leg a pair."""
    said, true = _unordered(pairs), _unordered(truth)
    n = said.join(true.withColumn("hit", F.lit(True)).hint("merge"), ["a", "b"], "left").agg(F.count(F.lit(1)).alias("said"), F.count_if("hit").alias("correct"))
    return n.join(F.broadcast(true.agg(F.count(F.lit(1)).alias("true")))).select("said", "true", "correct", _share("correct", "said").alias("precision"), _share("correct", "true").alias("recall"))


def grade_coverage(truth: DataFrame, pairs: DataFrame, nominated: DataFrame) -> DataFrame:
    """True pairs that were matched, nominated (id, candidate_ids), or lost."""
    a = pairs.select("internal_id", "external_id").withColumn("matched", F.lit(True))
    legs = nominated.select("id", F.explode("candidate_ids").alias("other")).withColumn("nominated", F.lit(True)).distinct()
    rows = truth.join(a, ["internal_id", "external_id"], "left").join(legs.hint("merge"), (truth.internal_id == legs.id) & (truth.external_id == legs.other), "left")
    outcome = F.when(F.col("matched"), "matched").when(F.col("nominated"), "nominated").otherwise("lost")
    return rows.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def grade_triage(triaged: DataFrame, truth: DataFrame) -> DataFrame:
    """Per archetype: rows of the key (transaction_id, archetype, expected), those reached by triage, those right."""
    rows = truth.join(triaged.select("transaction_id", "category").hint("merge"), "transaction_id", "left")
    n = rows.groupBy("archetype").agg(F.count(F.lit(1)).alias("in_key"), F.count("category").alias("reached"), F.count_if(F.col("category") == F.col("expected")).alias("correct"))
    return n.withColumn("accuracy", _share("correct", "reached"))


def defect_stage_check(decisions: DataFrame) -> DataFrame:
    return decisions.where("defect IS NOT NULL").groupBy("defect", "stage").agg(F.count(F.lit(1)).alias("n"))


def accounting_check(inputs: DataFrame, pairs: DataFrame, unmatched: DataFrame) -> DataFrame:
    """Every input row is in one pair or in the queue, once."""
    seen = pairs.select(F.explode(F.array("internal_id", "external_id")).alias("id")).unionByName(unmatched.select("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    rows = inputs.select("id").join(seen.hint("merge"), "id", "full")
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("n").isNull()).alias("lost"), F.count_if(F.col("n") > 1).alias("twice"))


def nomination_histogram(unmatched: DataFrame) -> DataFrame:
    return unmatched.groupBy(F.when(F.col("candidate_ids").isNull(), 0).otherwise(F.size("candidate_ids")).alias("nominated")).agg(F.count(F.lit(1)).alias("n"))


def latency_percentile(runs: DataFrame) -> DataFrame:
    done, ms = runs.where("status = 'COMPLETED'"), F.col("duration_ms").cast("double")
    p95 = F.lit(exact_percentile(done, ms, 0.95)).cast("double")
    return done.agg(F.count(F.lit(1)).alias("runs"), F.round(F.avg(ms), 4).alias("avg_ms")).select("runs", F.round(p95, 4).alias("p95_ms"), "avg_ms")
