"""Records that are easily lost or wrongly refused: junk messages, blank checksums, own keys, quoted line ends."""

import hashlib
import json

from pyspark.sql import functions as F

from ledgerloom.operators import validate as V
from ledgerloom.operators.sinks import read_validated
from ledgerloom.sources import feeds
from ledgerloom.streaming.stream import once_each, start_validation

GOOD = {"id": "A1", "source": "erp", "amount": "12.50", "ccy": "usd", "date": "2026-01-05", "ref": "REF-1234"}


def decide(spark, records):
    df = spark.createDataFrame([(i, r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(records)], "n int, value string")
    return V.validate(feeds.read_json_feed(df), "2026-01-31")


def test_blank_and_padded_checksums(spark):
    body = json.dumps({"external_id": "A1", "source_type": "erp", "amount": "12.50", "currency": "USD", "txn_date": "2026-01-05", "reference_code": "REF-1234"}, sort_keys=True, separators=(",", ":"))
    sha = hashlib.sha256(body.encode()).hexdigest()
    cases = [({"checksum": ""}, None), ({"checksum": "  "}, None), ({"checksum": " " + sha.upper() + "\n"}, None), ({"checksum": " ", "digest": sha}, None), ({"checksum": " ", "digest": "00"}, "checksum"), ({"_checksum": "00"}, "checksum"), ({"_checksum": sha}, None)]
    got = {r.n: r.stage for r in decide(spark, [{**GOOD, **more} for more, _ in cases]).collect()}
    assert [got[i] for i in range(len(cases))] == [stage for _, stage in cases]


def test_own_keys_are_part_of_the_fingerprint(spark):
    records = [GOOD, {**GOOD, "_batch": "1"}, {**GOOD, "_batch": "2"}, {**GOOD, "checksum": ""}, {**GOOD, "_batch": " "}, {**GOOD, "other": "x"}]
    got = {r.n: r.fingerprint for r in decide(spark, records).collect()}
    assert len({got[0], got[1], got[2]}) == 3 and got[0] == got[3] == got[4] == got[5]


def test_junk_is_never_taken_for_a_copy(spark, tmp_path):
    d = decide(spark, ["{broken", "{broken too", "text", "text", GOOD, GOOD])
    rows = once_each(d).collect()
    assert sorted(r.copies for r in rows) == [1, 1, 1, 1, 2]
    feed, out = tmp_path / "feed", str(tmp_path / "out")
    feed.mkdir()
    (feed / "a.txt").write_text("\n".join(["{broken", "{broken too", "text", "text", json.dumps(GOOD), json.dumps(GOOD)]))
    start_validation(spark.readStream.text(str(feed)), out, str(tmp_path / "cp"), "2026-01-31", once=True).awaitTermination()
    assert read_validated(spark, out, "quarantine").count() == 4 and read_validated(spark, out, "transactions").count() == 1
    assert read_validated(spark, out, "validation_log").agg(F.count(F.lit(1)), F.count_if("copy")).first()[:] == (6, 1)


def test_csv_records_with_quoted_line_ends(spark):
    text = 'id,memo\r\n1,"two\nlines, ""quoted"""\r\n\r\n2,plain\n3,"a ""b"""\n4,open " quote\n'
    df = spark.createDataFrame([(text,), ("id,memo\n",), ("",), (None,)], "value string")
    rows = sorted((r.record["id"], r.record["memo"]) for r in feeds.read_csv_feed(df, ["id", "memo"]).collect())
    assert rows == [("1", 'two\nlines, "quoted"'), ("2", "plain"), ("3", 'a "b"'), ("4", 'open " quote')]
    many = spark.range(1).select(F.concat(F.lit("id,memo\n"), F.repeat(F.lit("1,x\n"), 1_000_003)).alias("value"))
    assert feeds.read_csv_feed(many, ["id", "memo"]).count() == 1_000_003


def test_csv_quotes_open_at_the_start_of_a_field_only(spark):
    text = 'n,memo\n1,5" pipe\n2,x\n3,7" pipe\n4,"a, ""b""\nc"\n5,it"s "so"\n6,"open\n'
    df = spark.createDataFrame([(text,), (text.replace(",", ";"),)], "value string")
    for sep in ",;":
        rows = [(r.record["n"], r.record["memo"]) for r in feeds.read_csv_feed(df.where(F.col("value").contains("n" + sep)), ["n", "memo"], sep=sep).collect()]
        assert [n for n, _ in rows] == ["1", "2", "3", "4", "5", "6"]
        assert [m for _, m in rows][:5] == ['5" pipe', "x", '7" pipe', 'a' + sep + ' "b"\nc', 'it"s "so"']


def test_kafka_records(spark):
    rows = [(b"k", b"{}", "t", 0, 1, None), (None, b"\xff{", "t", 0, 2, None), (b"k", None, "t", 0, 3, None)]
    df = spark.createDataFrame([tuple(bytearray(x) if isinstance(x, bytes) else x for x in r) for r in rows], "key binary, value binary, topic string, partition int, offset long, timestamp timestamp")
    assert [(r.key, r.value, r.offset) for r in feeds.kafka_messages(df).collect()] == [("k", "{}", 1), (None, "\ufffd{", 2)]
