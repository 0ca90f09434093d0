import json

import pytest

from ledgerloom.operators import learn, sinks
from ledgerloom.operators.sinks import read_validated
from ledgerloom.operators.triage import FEATURES
from ledgerloom.streaming.stream import StreamStats, dedupe_by_fingerprint, start_validation, validated_stream


def write_feed(path, rows):
    path.mkdir(exist_ok=True)
    (path / f"f{len(list(path.iterdir()))}.txt").write_text("\n".join(json.dumps(r) for r in rows) + "\n")


def record(i, **kw):
    return {"txn_id": f"T{i}", "channel": "bank_api", "amt": "5.00", "posted_date": "2026-01-01", "reference": f"REF-{1000 + i}", **kw}


def test_stream_is_stored_once(spark, tmp_path):
    feed, out = tmp_path / "feed", str(tmp_path / "out")
    write_feed(feed, [record(i) for i in range(10)] + [record(3), record(99, amt="-1")])
    stats = StreamStats()
    spark.streams.addListener(stats)
    messages = spark.readStream.text(str(feed))
    for _ in range(2):  # a restart sees nothing new
        start_validation(messages, out, str(tmp_path / "cp"), "2026-01-31", once=True).awaitTermination()
    assert read_validated(spark, out, "transactions").count() == 10
    assert read_validated(spark, out, "quarantine").count() == 1
    write_feed(feed, [record(50)])
    start_validation(messages, out, str(tmp_path / "cp"), "2026-01-31", once=True).awaitTermination()
    assert read_validated(spark, out, "transactions").count() == 11
    spark.streams.removeListener(stats)


def test_dedupe_within_time(spark, tmp_path):
    from pyspark.sql import functions as F

    feed = tmp_path / "feed"
    write_feed(feed, [record(1), record(1), record(2)])
    s = validated_stream(spark.readStream.text(str(feed)).withColumn("ingested_at", F.current_timestamp()), "2026-01-31")
    q = dedupe_by_fingerprint(s).select("fingerprint").writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("once").count() == 2


def test_forest_learns_and_round_trips(spark, tmp_path):
    rows = [(f"s{i}", "ACCEPT", ["PARTIAL_PAYMENT", "TIMING_DIFFERENCE"][i % 2], *[float(i % 2) * 3 + (i % 7) / 10] * len(FEATURES)) for i in range(80)]
    df = spark.createDataFrame(rows, "id string, decision string, category string, " + ", ".join(f"{f} double" for f in FEATURES))
    assert learn.retrain_if_ready(df)[0] == "skipped"
    outcome, model = learn.retrain_if_ready(df, force=True, trees=10)
    assert outcome == "promoted"
    path = learn.save_version(model, str(tmp_path), 1)
    again = learn.load_version(spark, str(tmp_path), 1)
    assert path and learn.macro_f1(learn.classify_forest(again, df)) > 0.95
    assert learn.train_forest(df.limit(5)) is None and len(learn.explain_top3(model)) == 3
    assert not learn.promotion_guard(0.5, 0.9) and learn.promotion_guard(0.5, None)


def test_a_copy_in_a_later_batch_is_logged_and_not_stored(spark, tmp_path):
    feed, out = tmp_path / "feed", str(tmp_path / "out")
    run = lambda **kw: start_validation(spark.readStream.text(str(feed)), out, str(tmp_path / "cp"), "2026-01-31", once=True, **kw).awaitTermination()
    count = lambda name: read_validated(spark, out, name).count()
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    write_feed(feed, [record(1), record(2, amt="-1")])
    run()
    write_feed(feed, [record(1), record(2, amt="-1"), record(3), record(1)])
    run()
    assert (count("transactions"), count("quarantine"), count("validation_log")) == (2, 1, 6)
    log = read_validated(spark, out, "validation_log")
    assert log.where("copy").count() == 3 and log.where("copy AND status = 'QUARANTINED'").count() == 1
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


def test_what_is_known_ends_after_its_time(spark, tmp_path):
    import time

    feed, out = tmp_path / "feed", str(tmp_path / "out")
    for wait in (0, 3):
        time.sleep(wait)
        write_feed(feed, [record(1)])
        start_validation(spark.readStream.text(str(feed)), out, str(tmp_path / "cp"), "2026-01-31", once=True, ttl_ms=1000).awaitTermination()
    assert read_validated(spark, out, "transactions").count() == 2


def test_half_a_batch_is_not_read(spark, tmp_path, monkeypatch):
    feed, out = tmp_path / "feed", str(tmp_path / "out")
    write_feed(feed, [record(i) for i in range(5)] + [record(9, amt="x")])
    run = lambda: start_validation(spark.readStream.text(str(feed)), out, str(tmp_path / "cp"), "2026-01-31", once=True).awaitTermination()

    def broken(rows):
        raise OSError("no space left")

    with monkeypatch.context() as m:
        m.setattr(sinks, "validation_log_rows", broken)
        # The first table is written, the next one fails.
        m.setattr(sinks, "transactions_rows", lambda rows, f=sinks.transactions_rows: (f(rows).write.parquet(f"{out}/transactions/batch=0/attempt=lost"), f(rows))[1])
        with pytest.raises(Exception, match="no space left"):
            run()
    assert spark.read.parquet(f"{out}/transactions").count() == 5 and read_validated(spark, out, "transactions").count() == 0
    run()
    assert [read_validated(spark, out, n).count() for n in ("transactions", "quarantine", "validation_log")] == [5, 1, 6]
    assert spark.read.parquet(f"{out}/transactions").count() == 10


@pytest.mark.parametrize("n", [0, 1, 2, 7, 500])
def test_percentiles_are_exact(spark, n):
    import numpy as np
    from pyspark.sql import functions as F

    from ledgerloom.operators.ranks import exact_percentile

    v = np.random.default_rng(n).choice([-5.5, 0.1, 1e-9, 3.25, 1e300, *np.random.default_rng(1).normal(size=40)], n).tolist()
    rows = spark.createDataFrame([(x,) for x in v] + [(None,)], "v double")
    for p in (0.0, 0.5, 0.95, 1.0):
        got = exact_percentile(rows, F.col("v"), p, bins=4)
        assert got is None if not n else np.isclose(got, np.quantile(v, p), rtol=1e-12)


@pytest.mark.parametrize("sizes", [(40, 9), (3, 2), (5, 1), (900, 400)])
def test_split_takes_an_exact_share_of_each_class(spark, sizes):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(f"{c}-{k}", c) for c, n in zip("AB", sizes) for k in range(n)] + [(f"n{k}", None) for k in range(4)], "id string, category string")
    got = {r.id: r.held_out for r in learn.stratified_split(rows).collect()}
    h = F.conv(F.substring(F.md5(F.col("id").cast("binary")), 1, 8), 16, 10).cast("long")
    own = F.percent_rank().over(Window.partitionBy("category").orderBy(h, "id")) < 0.25
    want = rows.withColumn("held", h < 2**30 if min(sizes) < 2 else own).collect()
    assert got == {r.id: r.held for r in want}


def test_state_has_a_key_for_each_bucket_and_not_for_each_record(spark, tmp_path):
    from ledgerloom.streaming import stream as S

    feed = tmp_path / "feed"
    feed.mkdir()
    before = {k: spark.conf.get(k) for k in S.STATE}
    for k, v in S.STATE.items():
        spark.conf.set(k, v)
    seen = []
    try:
        for lot in (range(0, 200), range(150, 300)):  # fifty copies in the second batch
            write_feed(feed, [record(i) for i in lot] + [record(lot[0]), "no object"])
            marked = S.mark_copies(validated_stream(spark.readStream.text(str(feed)), "2026-01-31"), buckets=3)
            q = marked.writeStream.option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda b, n: seen.extend(b.select("external_id", "copy").collect())).trigger(availableNow=True).start()
            q.awaitTermination()
            # The buckets and what keeps their time to live.
            assert 0 < max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress) < 30
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(not r["copy"] for r in seen if r["external_id"]) == 300 and sum(r["copy"] for r in seen) == 52
    assert [r["copy"] for r in seen if not r["external_id"]] == [False, False]


def test_dedupe_reads_the_stream_once(spark, tmp_path):
    from pyspark.sql import functions as F

    feed = tmp_path / "feed"
    write_feed(feed, [record(1), record(1), "no object", "no object"])
    s = validated_stream(spark.readStream.text(str(feed)).withColumn("ingested_at", F.current_timestamp()), "2026-01-31")
    q = dedupe_by_fingerprint(s).select("fingerprint").writeStream.format("memory").queryName("read_once").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("read_once").count() == 3 and sum(p["numInputRows"] for p in q.recentProgress) == 4


def test_a_topic_is_read_by_all_cores(spark):
    from pathlib import Path

    from ledgerloom.operators.frames import shared_dir
    from ledgerloom.plans.registry import queries

    queries()["read_kafka"](spark, "/root/testdata/sf0.001").collect()
    topic = max(Path(shared_dir(spark).removeprefix("file:")).glob("topic-*"), key=lambda p: p.stat().st_mtime)
    assert len(list(topic.glob("part-*"))) == 4 * spark.sparkContext.defaultParallelism
