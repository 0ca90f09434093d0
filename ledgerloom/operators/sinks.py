"""Rows for the tables that are written, and the writes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.normalize import clean_string


def transactions_rows(decisions: DataFrame) -> DataFrame:
    """Passed records, typed, with their payload as it came."""
    ok = decisions.where("status = 'PASSED'")
    return ok.select(
        F.concat(F.lit("T-"), F.substring("fingerprint", 1, 32)).alias("id"), "external_id", "source_type", F.col("amount").cast("decimal(18,2)").alias("amount"), "currency", "txn_date", clean_string(F.col("description")).alias("description"), "reference_code", F.to_json("record").alias("raw_payload")
    )


def quarantine_rows(decisions: DataFrame) -> DataFrame:
    return decisions.where("status = 'QUARANTINED'").select(F.to_json("record").alias("payload"), "stage", "violations", "fingerprint")


def validation_log_rows(decisions: DataFrame) -> DataFrame:
    """One row for each decision; passed rows log the last stage, and `copies` where copies were counted, or `copy` where they
    were marked."""
    more = [c for c in ("copies", "copy") if c in decisions.columns]
    return decisions.select("fingerprint", "status", F.coalesce("stage", F.lit("checksum")).alias("stage"), "violations", *more)


def quarantine_alerts(quarantined: DataFrame) -> DataFrame:
    return quarantined.select(F.to_json(F.struct(F.lit("quarantine").alias("type"), "stage", "fingerprint", "violations")).alias("value"))


def match_rows(pairs: DataFrame) -> DataFrame:
    return pairs.select("internal_id", "external_id", "match_type", F.col("confidence").cast("decimal(5,4)").alias("confidence"))


def ledger_postings(pairs: DataFrame, txns: DataFrame) -> DataFrame:
    """Debit of the internal amount and credit of the external one for each pair; neither where an amount is missing."""
    amount = lambda n: txns.select(F.col("id").alias(f"{n}_id"), F.col("amount").alias(n))
    rows = pairs.join(amount("internal").hint("merge"), "internal_id").join(amount("external").hint("merge"), "external_id").where("internal IS NOT NULL AND external IS NOT NULL")
    entry = lambda n, kind: F.struct(F.col(f"{n}_id").alias("transaction_id"), F.lit(kind).alias("entry_type"), F.col(n).alias("amount"))
    return rows.select("internal_id", "external_id", F.explode(F.array(entry("internal", "DEBIT"), entry("external", "CREDIT"))).alias("e")).select("internal_id", "external_id", "e.*")


def exception_rows(unmatched: DataFrame) -> DataFrame:
    """Open exceptions without a category; the context has only the reason where nothing came near."""
    near = F.to_json(F.struct("reason", "best_confidence", "best_counterpart_id", "candidate_ids"))
    context = F.when(F.col("best_confidence").isNull(), F.to_json(F.struct("reason"))).otherwise(near)
    return unmatched.select(F.concat(F.lit("EXC-"), "id").alias("id"), F.col("id").alias("transaction_id"), F.lit("OPEN").alias("state"), F.lit(None).cast("string").alias("category"), context.alias("context"))


def run_row(summary: DataFrame, threshold: float, seconds: float) -> DataFrame:
    return summary.select("*", F.lit(threshold).alias("threshold"), F.lit(round(seconds * 1000, 2)).cast("decimal(12,2)").alias("duration_ms"), F.lit("COMPLETED").alias("status"))


def events(rows: DataFrame, kind: str) -> DataFrame:
    """Change notices as JSON values, for a Kafka or file sink."""
    return rows.select(F.to_json(F.struct(F.lit(kind).alias("type"), F.struct(*rows.columns).alias("payload"))).alias("value"))


def mark_replayed(quarantine: DataFrame, ids: DataFrame, at: str) -> DataFrame:
    hit = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    return quarantine.join(hit, "id", "left").withColumn("replayed_at", F.coalesce("replayed_at", F.when(F.col("_hit"), F.lit(at).cast("timestamp")))).drop("_hit")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _stored_batches(spark: SparkSession, root: str) -> DataFrame | None:
    """(batch, attempt) of the batches that are stored as a whole; None before the first."""
    path = f"{root.rstrip('/')}/manifest"
    return spark.read.schema("batch long, attempt string").parquet(path) if _exists(spark, path) else None


def write_validated(decisions: DataFrame, root: str, batch_id: int) -> None:
    """One batch's three tables, all or none of them: each attempt writes into folders of its own, and the manifest, written last, names
    the one that counts. A batch that comes again after that is there already and left alone. Rows that are marked as a `copy`
    of an earlier record are logged, and stored nowhere else."""
    spark, root = decisions.sparkSession, root.rstrip("/")
    known = _stored_batches(spark, root)
    if known is not None and known.where(F.col("batch") == batch_id).limit(1).count():
        return
    attempt = uuid.uuid4().hex
    kept = decisions.persist()
    new = kept.where("NOT copy") if "copy" in kept.columns else kept
    try:
        for name, rows in (("transactions", transactions_rows(new)), ("quarantine", quarantine_rows(new)), ("validation_log", validation_log_rows(kept))):
            rows.write.parquet(f"{root}/{name}/batch={batch_id}/attempt={attempt}")
    finally:
        kept.unpersist()
    spark.createDataFrame([(batch_id, attempt)], "batch long, attempt string").coalesce(1).write.mode("append").parquet(f"{root}/manifest")


def read_validated(spark: SparkSession, root: str, name: str, few: int = 100_000) -> DataFrame:
    """A table that write_validated() has written: the rows of whole batches, and nothing of one that was broken off."""
    rows, known = spark.read.option("basePath", f"{root.rstrip('/')}/{name}").parquet(f"{root.rstrip('/')}/{name}"), _stored_batches(spark, root)
    if known is None:
        return rows.limit(0).drop("batch", "attempt")
    # One row for each batch: sent to all tasks while there are few, which also spares the folders of other attempts.
    known = known.hint("broadcast" if known.count() <= few else "merge")
    return rows.join(known, ["batch", "attempt"], "left_semi").drop("batch", "attempt")
