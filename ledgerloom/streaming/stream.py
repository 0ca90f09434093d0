"""The same operators over streams: micro-batches, dedupe by fingerprint, idempotent writes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener

from ledgerloom.operators.sinks import write_validated
from ledgerloom.operators.validate import validate
from ledgerloom.sources.feeds import read_json_feed

#: A batch closes after so long; how many records it may hold is set at the source.
EVERY = "5 seconds"
#: How long a record is known after it was first seen, in milliseconds.
TTL_MS = 3_600_000
#: Buckets that hold what is known: the more, the less of it a small batch reads and writes.
BUCKETS = 4096
#: How a query keeps such state: in RocksDB, and without batches that have no data, which would come without end.
STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
#: Times go through JSON whole.
TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "ignoreNullFields": "false"}


def validated_stream(messages: DataFrame, as_of: str) -> DataFrame:
    """Decisions over a stream of JSON messages (value, ...)."""
    return validate(read_json_feed(messages), as_of)


def dedupe_by_fingerprint(decisions: DataFrame, time: str = "ingested_at", ttl: str = "1 hour") -> DataFrame:
    """The first decision of each fingerprint within the time to live, which later copies do not extend. What could not be
    read as a record is never taken for a copy."""
    # A key of its own for each row that is no record, so that the stream is read and validated once.
    timed = decisions.withColumn("_junk", F.when(F.col("error").isNotNull(), F.uuid())).withWatermark(time, ttl)
    return timed.dropDuplicatesWithinWatermark(["fingerprint", "_junk"]).drop("_junk")


def once_each(decisions: DataFrame) -> DataFrame:
    """One decision of each fingerprint, with `copies`, the number of records that had it. Each record that could not
    be read stays, whatever its fingerprint."""
    kept = decisions.withColumn("_junk", F.when(F.col("error").isNotNull(), F.monotonically_increasing_id()))
    first = kept.groupBy("fingerprint", "_junk").agg(F.count(F.lit(1)).alias("copies"), F.any_value(F.struct(*decisions.columns)).alias("d"))
    return first.select("d.*", "copies")


def duplicate_count(decisions: DataFrame) -> DataFrame:
    """Records, distinct ones and copies of a batch."""
    return decisions.agg(F.count(F.lit(1)).alias("records"), F.countDistinct("fingerprint").alias("distinct")).withColumn("duplicates", F.col("records") - F.col("distinct"))


class FirstSight(StatefulProcessor):
    """Which row of a fingerprint is the first, for all fingerprints of a bucket at once. What is known of a fingerprint ends a time
    after its first sight, which copies do not put off.

    A bucket's state is one value, 32 bytes of fingerprint and 8 of the time of its first sight for each record: it is read and
    written once a batch, however many records come, where a key for each fingerprint cost several calls of Python for each."""

    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        # A bucket in which nothing new came for so long holds nothing that is known any more.
        self.seen = handle.getValueState("seen", "rows binary", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        blob = bytes(self.seen.get()[0]) if self.seen.exists() else b""
        stored = ((blob[i : i + 32], blob[i + 32 : i + 40]) for i in range(0, len(blob), 40))
        known = {f: at for f, at in stored if int.from_bytes(at, "big") + self.ttl_ms > now}
        stamp, before = now.to_bytes(8, "big"), len(known)
        for batch in rows:
            copy = []
            for junk, hexed in zip(batch["junk"], batch["fingerprint"]):
                # What could not be read as a record is never a copy.
                f = bytes.fromhex(hexed)
                copy.append(bool(f in known and not junk))
                if not junk:
                    known.setdefault(f, stamp)
            yield batch[["fingerprint", "decision"]].assign(copy=copy)
        if len(known) > before:
            self.seen.update((b"".join(f + at for f, at in known.items()),))

    def close(self) -> None:
        pass


def mark_copies(decisions: DataFrame, ttl_ms: int = TTL_MS, buckets: int = BUCKETS) -> DataFrame:
    """`decisions` of a stream with `copy`: whether the record was seen before, in this batch or an earlier one, within the time to
    live. The state is one value for each bucket of fingerprints, in RocksDB and in the query's checkpoint, which goes with the number of
    buckets it was begun with."""
    rows = decisions.select("fingerprint", F.col("error").isNotNull().alias("junk"), F.to_json(F.struct(*[c for c in decisions.columns if c != "fingerprint"]), TIMES).alias("decision"))
    kind = "fingerprint string, decision string, copy boolean"
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("fingerprint"), F.lit(buckets)).cast("int"))
    marked = dealt.groupBy("bucket").transformWithStateInPandas(FirstSight(ttl_ms), kind, "Append", "ProcessingTime")
    schema = decisions.drop("fingerprint").schema
    return marked.select("fingerprint", "copy", F.from_json("decision", schema, TIMES).alias("d")).select("d.*", "fingerprint", "copy")


def start_validation(messages: DataFrame, root: str, checkpoint: str, as_of: str, every: str = EVERY, once: bool = False, ttl_ms: int = TTL_MS) -> StreamingQuery:
    """Validate and store a stream. Offsets are committed after a batch is stored as a whole; a batch that comes again is not stored again.
    Of the copies of a record one is stored, in whatever batches they come within the time to live; each copy is logged."""

    def store(batch: DataFrame, batch_id: int) -> None:
        write_validated(batch, root, batch_id)

    conf = messages.sparkSession.conf
    before = {k: conf.get(k) for k in STATE}
    for k, v in STATE.items():
        conf.set(k, v)
    try:
        writer = mark_copies(validated_stream(messages, as_of), ttl_ms).writeStream.option("checkpointLocation", checkpoint).foreachBatch(store)
        writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)
        return writer.start()
    finally:
        for k, v in before.items():
            conf.set(k, v)


def sweep(queue_changes: DataFrame, triage, checkpoint: str, every: str = "120 seconds", once: bool = False) -> StreamingQuery:
    """Run `triage(batch, batch_id)` over what is new in the queue at fixed intervals."""
    writer = queue_changes.where("state = 'OPEN'").writeStream.option("checkpointLocation", checkpoint).foreachBatch(triage)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


class StreamStats(StreamingQueryListener):
    """Records, batches and the last error of the queries it listens to."""

    def __init__(self) -> None:
        self.records = self.batches = 0
        self.error: str | None = None

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.batches += 1
        self.records += event.progress.numInputRows

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.error = event.exception
