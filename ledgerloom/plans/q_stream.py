"""Queries over streams: the raw feed as files, read by a stream to its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import sinks, validate as V
from ledgerloom.operators.frames import work_dir
from ledgerloom.plans.fixtures import AS_OF, QUEUE_SQL, RAW_SQL, queue, raw_feed
from ledgerloom.sources import feeds
from ledgerloom.streaming import stream as S

Q = {}


def q(name, sql=None):
    def put(f):
        Q[name] = (f, sql)
        return f

    return put


def messages(s, d, copies=1):
    """The raw feed written as text files, each message `copies` times, as a stream."""
    path = work_dir(s, "feed")
    rows = raw_feed(s, d).select("value")
    for _ in range(copies):
        rows.write.mode("append").text(path)
    return s.readStream.text(path)


@q("write_validated", f"WITH {RAW_SQL}, t AS (SELECT stage IS NULL AS ok FROM marked) SELECT 'transactions' AS name, count(*) AS n FROM t WHERE ok UNION ALL SELECT 'quarantine', count(*) FROM t WHERE NOT ok UNION ALL SELECT 'validation_log', count(*) FROM t")
def _(s, d):
    root = work_dir(s, "stored")
    decisions = V.validate(feeds.read_json_feed(raw_feed(s, d)), AS_OF)
    for _ in range(2):  # a batch that comes again replaces itself
        sinks.write_validated(decisions, root, 0)
    out = None
    for name in ("transactions", "quarantine", "validation_log"):
        n = sinks.read_validated(s, root, name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = n if out is None else out.unionByName(n)
    return out


def stored(s, d, runs, copies):
    root, place, feed = work_dir(s, "stored"), work_dir(s, "stream"), messages(s, d, copies)
    for _ in range(runs):
        S.start_validation(feed, root, place, AS_OF, once=True).awaitTermination()
    return root


TXN_SQL = f"WITH {RAW_SQL} SELECT id AS external_id, amount, txn_date FROM marked WHERE stage IS NULL"


@q("micro_batch", TXN_SQL)
def _(s, d):
    return sinks.read_validated(s, stored(s, d, 1, 1), "transactions").select("external_id", "amount", "txn_date")


# Three runs over the same files, from one checkpoint: what was stored is not stored again.
@q("at_least_once", f"WITH {RAW_SQL} SELECT stage, count(*) AS n FROM marked WHERE stage IS NOT NULL GROUP BY 1")
def _(s, d):
    return sinks.read_validated(s, stored(s, d, 3, 1), "quarantine").groupBy("stage").agg(F.count(F.lit(1)).alias("n"))


# The feed comes three times, in three batches: copies are stored once and logged each time; what is no record is no copy.
@q("copies_across_batches", f"""WITH {RAW_SQL}, t AS (SELECT *, CASE WHEN defect = 'not_an_object' THEN 3 ELSE 1 END AS times FROM marked)
SELECT 'transactions' AS name, sum(times)::BIGINT AS rows, 0::BIGINT AS copies FROM t WHERE stage IS NULL UNION ALL SELECT 'quarantine', sum(times)::BIGINT, 0::BIGINT FROM t WHERE stage IS NOT NULL
UNION ALL SELECT 'validation_log', 3 * count(*), sum(3 - times)::BIGINT FROM t""")
def _(s, d):
    root, place, path = work_dir(s, "stored"), work_dir(s, "stream"), work_dir(s, "feed")
    for _ in range(3):
        raw_feed(s, d).select("value").write.mode("append").text(path)
        S.start_validation(s.readStream.text(path), root, place, AS_OF, once=True).awaitTermination()
    out = None
    for name in ("transactions", "quarantine", "validation_log"):
        rows = sinks.read_validated(s, root, name)
        copies = F.count_if("copy") if "copy" in rows.columns else F.lit(0).cast("long")
        n = rows.agg(F.count(F.lit(1)).alias("rows"), copies.alias("copies")).select(F.lit(name).alias("name"), "rows", "copies")
        out = n if out is None else out.unionByName(n)
    return out


# Records as Kafka has them, as files: through the same decoding, so many files a batch. A record without a value is a deletion.
@q("read_kafka", f"WITH {RAW_SQL} SELECT coalesce(stage, 'passed') AS stage, count(*) AS n, count(DISTINCT k) AS keys FROM marked GROUP BY 1")
def _(s, d):
    path, out = work_dir(s, "topic"), work_dir(s, "kafka")
    rows = raw_feed(s, d).select(F.col("k").cast("string").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"), F.lit("raw_transactions").alias("topic"), F.pmod("k", F.lit(4)).cast("int").alias("partition"), F.col("k").cast("long").alias("offset"), F.lit(AS_OF).cast("timestamp").alias("timestamp"))
    rows = rows.unionByName(rows.where("offset % 10 = 0").withColumn("value", F.lit(None).cast("binary")))
    # Four batches, each of as many files as there are cores.
    cores = s.sparkContext.defaultParallelism
    rows.repartition(4 * cores).write.parquet(path)
    messages = feeds.kafka_messages(s.readStream.schema(rows.schema).option("maxFilesPerTrigger", cores).parquet(path))
    S.validated_stream(messages, AS_OF).select("key", F.coalesce("stage", F.lit("passed")).alias("stage")).writeStream.format("parquet").option("path", out).option("checkpointLocation", work_dir(s, "stream")).trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(out).groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("key").alias("keys"))


# Each message twice; what is no record is never taken for a copy.
@q("dedupe_by_fingerprint", f"WITH {RAW_SQL} SELECT coalesce(defect, 'none') AS defect, CASE WHEN defect = 'not_an_object' THEN 2 * count(*) ELSE count(*) END AS n FROM marked WHERE defect IS NULL OR defect = 'not_an_object' GROUP BY defect")
def _(s, d):
    timed = messages(s, d, 2).withColumn("ingested_at", F.current_timestamp())
    once = S.dedupe_by_fingerprint(S.validated_stream(timed, AS_OF)).select(F.when(F.col("error").isNotNull(), "not_an_object").when(F.col("status") == "PASSED", "none").alias("defect"))
    out = work_dir(s, "deduped")
    once.writeStream.format("parquet").option("path", out).option("checkpointLocation", work_dir(s, "stream")).trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(out).where("defect IS NOT NULL").groupBy("defect").agg(F.count(F.lit(1)).alias("n"))


@q("sweep", f"WITH {QUEUE_SQL} SELECT id FROM queue WHERE state = 'OPEN'")
def _(s, d):
    changes, out = work_dir(s, "changes"), work_dir(s, "swept")
    rows = queue(s, d).select("id", "state")
    rows.write.parquet(changes)
    S.sweep(s.readStream.schema(rows.schema).parquet(changes), lambda batch, n: batch.select("id").write.mode("overwrite").parquet(f"{out}/batch={n}"), work_dir(s, "stream"), once=True).awaitTermination()
    return s.read.parquet(out).select("id")


@q("stream_stats", f"WITH {RAW_SQL} SELECT count(*) AS records FROM marked")
def _(s, d):
    stats = S.StreamStats()
    s.streams.addListener(stats)
    try:
        stored(s, d, 1, 1)
        s.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
    finally:
        s.streams.removeListener(stats)
    return s.range(1).select(F.lit(stats.records).cast("long").alias("records"))
