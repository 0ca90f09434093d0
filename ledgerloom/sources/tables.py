"""Reading the working tables: backlogs, queues, labels, and obligations from line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load_backlog(txns: DataFrame, matched: DataFrame, queue: DataFrame, limit: int | None = None, include_open: bool = False) -> DataFrame:
    """Transactions in no match on either leg and without an open or suggested exception, oldest first."""
    used = matched.select(F.explode(F.array("internal_id", "external_id")).alias("id")).distinct()
    rows = txns.join(used.hint("merge"), "id", "left_anti")
    if not include_open:
        rows = rows.join(queue.where("state IN ('OPEN', 'SUGGESTED')").select(F.col("transaction_id").alias("id")).hint("merge"), "id", "left_anti")
    rows = rows.orderBy("txn_date", "id")
    return rows.limit(limit) if limit else rows


def load_quarantined(quarantine: DataFrame, ids: DataFrame | None = None, fingerprints: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Payloads not replayed yet, by id or fingerprint where given, oldest first."""
    rows = quarantine.where("replayed_at IS NULL")
    if ids is not None:
        rows = rows.join(ids.select("id").hint("merge"), "id", "left_semi")
    if fingerprints is not None:
        rows = rows.join(fingerprints.select("fingerprint").hint("merge"), "fingerprint", "left_semi")
    rows = rows.orderBy("quarantined_at", "id")
    return rows.limit(limit) if limit else rows


def load_history_text(txns: DataFrame, limit: int = 20_000) -> DataFrame:
    """Descriptions of the latest rows that have one."""
    return txns.where("description IS NOT NULL").orderBy(F.desc("txn_date"), "id").limit(limit).select("id", "description")


def load_labels(queue: DataFrame, limit: int = 20_000) -> DataFrame:
    """Settled exceptions with a category, newest first."""
    return queue.where("state IN ('RESOLVED', 'REJECTED') AND category IS NOT NULL").orderBy(F.desc("resolved_at"), "id").limit(limit)


def invoices_from_lines(lines: DataFrame) -> DataFrame:
    """Obligations from line items (invoice, customer, quantity, price, date, description, line): cancelled and worthless lines go; the
    sum, first date, number of lines and the first line's text of each invoice."""
    ok = lines.where("NOT startswith(invoice, 'C') AND quantity > 0 AND price > 0 AND customer IS NOT NULL")
    return ok.groupBy("invoice").agg(F.sum((F.col("quantity") * F.col("price")).cast("decimal(18,2)")).alias("amount"), F.min("date").alias("txn_date"), F.count(F.lit(1)).alias("lines"), F.min("customer").alias("customer"), F.min_by("description", F.struct("line", "description")).alias("top_item"))


def ledger_window(invoices: DataFrame, count: int, window_days: int = 120, headroom_days: int = 21, as_of: str = "2001-12-31") -> DataFrame:
    """Ledger rows from a sample of the last days' invoices: the least hashes of the invoice number, all dates moved by one offset
    so that the last lies the headroom before as_of."""
    last = invoices.agg(F.max("txn_date").alias("last"))
    rows = invoices.join(F.broadcast(last)).where(F.col("txn_date") > F.date_sub("last", window_days))
    move = F.datediff(F.date_sub(F.lit(as_of).cast("date"), headroom_days), "last")
    picked = rows.orderBy(F.crc32(F.col("invoice").cast("binary")), "invoice").limit(count)
    return picked.select(F.concat(F.lit("ERP-"), "invoice").alias("id"), F.lit("erp").alias("source_type"), "amount", F.date_add("txn_date", move).alias("txn_date"), F.concat(F.lit("REF-"), F.lpad("invoice", 6, "0")).alias("reference_code"))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
