"""Figures for reports: key figures over a window, daily series, queue views, tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.ranks import exact_percentile
from ledgerloom.operators.triage import CATEGORIES


def ratio(a: Column, b: Column) -> Column:
    """Four places; null, never 0, where there is nothing to divide by."""
    return F.round(F.try_divide(a.cast("double"), F.nullif(b, F.lit(0)).cast("double")), 4)


def delta(now: Column, before: Column) -> Column:
    return F.round(now - before, 4)


def _in(c: str, as_of: str, first: int, last: int) -> Column:
    """Days before as_of: more than `last`, up to `first`."""
    d = F.datediff(F.lit(as_of).cast("date"), F.col(c).cast("date"))
    return (d >= last) & (d < first)


def kpi_volume(txns: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    now, before = _in("txn_date", as_of, days, 0), _in("txn_date", as_of, 2 * days, days)
    return txns.agg(F.count_if(now).alias("volume"), F.sum(F.when(now, F.col("amount"))).alias("value"), F.count_if(before).alias("prior_volume"))


def kpi_match_rate(txns: DataFrame, pairs: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Twice the pairs over the rows, in the window and the one before. `pairs` has matched_on."""
    t = txns.agg(F.count_if(_in("txn_date", as_of, days, 0)).alias("v"), F.count_if(_in("txn_date", as_of, 2 * days, days)).alias("v0"))
    p = pairs.agg(F.count_if(_in("matched_on", as_of, days, 0)).alias("p"), F.count_if(_in("matched_on", as_of, 2 * days, days)).alias("p0"))
    rate, prior = F.least(F.lit(1.0), ratio(2 * F.col("p"), F.col("v"))), F.least(F.lit(1.0), ratio(2 * F.col("p0"), F.col("v0")))
    rate, prior = F.when(F.col("v") > 0, rate), F.when(F.col("v0") > 0, prior)
    return t.join(F.broadcast(p)).select(rate.alias("match_rate"), prior.alias("prior_rate"), delta(rate, prior).alias("delta"))


def kpi_exceptions(queue: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Open now (not windowed), created in the prior window, resolved and rejected in the window."""
    now = _in("resolved_at", as_of, days, 0)
    done, refused = F.count_if(now & (F.col("state") == "RESOLVED")), F.count_if(now & (F.col("state") == "REJECTED"))
    return queue.agg(
        F.count_if(F.col("state").isin("OPEN", "SUGGESTED")).alias("open"), F.count_if(_in("created_at", as_of, 2 * days, days)).alias("prior_created"), done.alias("resolved"), refused.alias("rejected"), ratio(done, done + refused).alias("resolved_rate")
    )


def kpi_validation(log: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    now = _in("validated_at", as_of, days, 0)
    ok, bad = F.count_if(now & (F.col("status") == "PASSED")), F.count_if(now & (F.col("status") == "QUARANTINED"))
    today = F.count_if((F.col("status") == "QUARANTINED") & (F.to_date("validated_at") == F.lit(as_of).cast("date")))
    return log.agg(ok.alias("passed"), bad.alias("quarantined"), today.alias("quarantined_today"), ratio(bad, ok + bad).alias("quarantine_share"))


def kpi_runs(runs: DataFrame) -> DataFrame:
    last = F.max_by(F.struct("id", "status", "started_at"), F.struct("started_at", "id"))
    p95 = F.lit(exact_percentile(runs.where("status = 'COMPLETED'"), F.col("duration_ms"), 0.95)).cast("double")
    return runs.agg(last.alias("last"), F.avg(F.when(F.col("status") == "COMPLETED", F.col("duration_ms").cast("double"))).alias("a"), F.count_if(F.col("status") == "FAILED").alias("failed")).select(
        F.col("last.id").alias("last_run"), F.col("last.status").alias("last_status"), F.col("last.started_at").alias("last_started_at"), F.round("a", 4).alias("avg_duration_ms"), F.round(p95, 4).alias("p95_duration_ms"), "failed"
    )


def run_status(kpi: DataFrame, now: str, stale_hours: int = 24) -> DataFrame:
    """UNKNOWN without a run, ATTENTION after a failed or an old one, else HEALTHY."""
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("last_started_at")
    return kpi.select(F.when(F.col("last_run").isNull(), "UNKNOWN").when((F.col("last_status") == "FAILED") | (age > stale_hours * 3600), "ATTENTION").otherwise("HEALTHY").alias("status"))


def match_rate_series(txns: DataFrame, pairs: DataFrame, runs: DataFrame, first: str, last: str) -> DataFrame:
    """A row for each day, gaps filled: volume, matched = min(volume, 2 pairs), unmatched, rule, ml, rate, average latency."""
    days = txns.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
    v = txns.where(F.col("txn_date").between(first, last)).groupBy(F.col("txn_date").alias("day")).agg(F.count(F.lit(1)).alias("volume"))
    p = pairs.where(F.col("matched_on").between(first, last)).groupBy(F.col("matched_on").alias("day")).agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("match_type") == "RULE").alias("rule"), F.count_if(F.col("match_type") == "ML").alias("ml"))
    r = runs.where("status = 'COMPLETED'").groupBy(F.to_date("started_at").alias("day")).agg(F.round(F.avg(F.col("duration_ms").cast("double")), 4).alias("avg_latency_ms"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    rows = days.join(v.hint("merge"), "day", "left").join(p.hint("merge"), "day", "left").join(r.hint("merge"), "day", "left")
    rows = rows.select("day", zero("volume").alias("volume"), zero("pairs").alias("pairs"), zero("rule").alias("rule"), zero("ml").alias("ml"), "avg_latency_ms")
    rows = rows.withColumn("matched", F.least("volume", 2 * F.col("pairs")))
    return rows.select("day", "volume", "matched", (F.col("volume") - F.col("matched")).alias("unmatched"), "rule", "ml", ratio(F.col("matched"), F.col("volume")).alias("rate"), "avg_latency_ms")


def category_breakdown(queue: DataFrame) -> DataFrame:
    """Open rows and exposure by category; null is UNCLASSIFIED."""
    return queue.where("state IN ('OPEN', 'SUGGESTED')").groupBy(F.coalesce("category", F.lit("UNCLASSIFIED")).alias("category")).agg(F.count(F.lit(1)).alias("open"), F.sum("amount").alias("exposure"))


def exception_age(queue: DataFrame, now: str) -> DataFrame:
    """Whole hours since creation."""
    seconds = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("created_at")
    return queue.select("id", F.floor(seconds / 3600).alias("age_hours"))


def exception_list(queue: DataFrame, state: str | None = None, category: str | None = None, search: str | None = None, offset: int = 0, limit: int = 50) -> tuple[DataFrame, DataFrame]:
    """One page, newest first, and the total as a frame of one row."""
    rows = queue
    if state:
        rows = rows.where(F.col("state") == state)
    if category:
        rows = rows.where(F.col("category") == category)
    if search:
        like = "%" + search.replace("\\", "\\\\").replace("%", r"\%").replace("_", r"\_") + "%"
        rows = rows.where(F.col("id").ilike(like) | F.col("transaction_id").ilike(like) | F.coalesce(F.col("resolved_by"), F.lit("")).ilike(like))
    return rows.orderBy(F.desc("created_at"), "id").offset(offset).limit(limit), rows.agg(F.count(F.lit(1)).alias("total"))


def queue_counts(queue: DataFrame) -> DataFrame:
    """Rows and amount of every category, zero where there is none."""
    frame = queue.sparkSession.createDataFrame([(c,) for c in CATEGORIES], "category string")
    per = queue.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))
    return frame.join(per, "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("amount", F.lit(0).cast("decimal(28,2)")).alias("amount"))


def queue_view(queue: DataFrame, sort: str = "newest", limit: int = 100) -> DataFrame:
    order = {"newest": [F.desc("created_at")], "amount": [F.desc("amount")], "confidence": [F.desc(F.coalesce("confidence", F.lit(0)))] if "confidence" in queue.columns else []}[sort]
    return queue.orderBy(*order, "id").limit(limit)


def range_totals(series: DataFrame, as_of: str, ranges: tuple[int, ...] = (7, 30, 90)) -> DataFrame:
    """Sums and rate of the last so many days."""
    rows = series.withColumn("days", F.explode(F.array(*[F.lit(n) for n in ranges]))).where(F.datediff(F.lit(as_of).cast("date"), "day").between(F.lit(0), F.col("days") - 1))
    return rows.groupBy("days").agg(F.sum("volume").alias("volume"), F.sum("matched").alias("matched"), F.sum("unmatched").alias("unmatched")).withColumn("rate", ratio(F.col("matched"), F.col("volume")))


def report_exceptions(queue: DataFrame, txns: DataFrame, first: str, last: str, limit: int = 200) -> DataFrame:
    """Queue rows whose transaction lies in the period, newest first."""
    t = txns.where(F.col("txn_date").between(first, last)).select(F.col("id").alias("transaction_id"), "txn_date", F.col("amount").alias("txn_amount"), "description")
    return queue.select("id", "transaction_id", "state", "category", "created_at").join(t, "transaction_id").orderBy(F.desc("created_at"), "id").limit(limit)


def rule_ml_split(series: DataFrame) -> DataFrame:
    return series.agg(F.sum("rule").alias("rule"), F.sum("ml").alias("ml")).withColumn("deterministic_share", ratio(F.col("rule"), F.col("rule") + F.col("ml")))


def series_downsample(series: DataFrame, most: int = 20) -> DataFrame:
    """Days with volume, every n-th of them so that about `most` are left. A series has one row a day."""
    full = series.where("volume > 0").withColumn("n", F.row_number().over(Window.orderBy("day")) - 1)
    step = full.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / most)).alias("step"))
    return full.join(F.broadcast(step)).where("n % step = 0").drop("n", "step")


def category_shares(breakdown: DataFrame) -> DataFrame:
    """Share of all open rows. One row for each category."""
    return breakdown.select("category", "open", ratio(F.col("open"), F.sum("open").over(Window.partitionBy())).alias("share"), "exposure")


def report_tables(name: str, rows: DataFrame, most: int, order: list) -> DataFrame:
    """The first `most` rows, and how many more there are in a last one."""
    top = rows.orderBy(*order).limit(most).select(F.lit(name).alias("table"), F.to_json(F.struct(*rows.columns)).alias("row"))
    more = rows.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select(F.lit(name).alias("table"), F.concat((F.col("n") - most).cast("string"), F.lit(" more")).alias("row"))
    return top.unionByName(more)


#: What each type of report holds.
BUNDLES = {
    "RECONCILIATION_SUMMARY": ["kpi", "series", "categories", "exceptions"],
    "EXCEPTION_DETAIL": ["exceptions", "categories"],
    "AUDIT_TRAIL": ["audit", "actors"],
    "VALIDATION_REPORT": ["validation", "kpi"],
}


def report_bundle(kind: str, frames: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {k: frames[k] for k in BUNDLES[kind] if k in frames}


def report_snapshot(kind: str, as_of: str, figures: DataFrame) -> DataFrame:
    """One row: parameters and the figures as they are now."""
    return figures.select(F.lit(kind).alias("report_type"), F.lit(as_of).cast("date").alias("as_of"), F.struct(*figures.columns).alias("figures"))


def report_list(reports: DataFrame, limit: int = 50) -> DataFrame:
    return reports.orderBy(F.desc("generated_at"), "id").limit(limit)
