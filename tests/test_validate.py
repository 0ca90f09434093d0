import hashlib
import hmac

from pyspark.sql import functions as F

from ledgerloom.functions import normalize as N
from ledgerloom.operators import validate as V
from ledgerloom.sources import feeds


def decide(spark, values, **kw):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "n int, value string")
    rows = V.validate(feeds.read_json_feed(df), "2026-01-31", **kw).collect()
    return {r.n: r for r in rows}


GOOD = '{"id":"A1","source":"erp","amount":"12.50","ccy":"usd","date":"2026-01-05","ref":"REF-1234","memo":" x "}'


def test_good_and_bad_records(spark):
    cases = {
        GOOD: None,
        GOOD.replace('"ccy":"usd",', ""): None,
        GOOD.replace('"usd"', "null"): "schema",
        GOOD.replace("12.50", "0.00"): "schema",
        GOOD.replace("12.50", "12,50.00"): "schema",
        GOOD.replace("12.50", "$400"): "schema",
        GOOD.replace("2026-01-05", "2026-1-5"): "schema",
        GOOD.replace("2026-01-05", "31/02/2026"): "schema",
        GOOD.replace("2026-01-05", "2026-02-01"): "business_rule",
        GOOD.replace("REF-1234", "REF-1234\\n"): None,
        GOOD.replace("REF-1234", "ref-12345"): "business_rule",
        GOOD.replace("A1", "a b"): "business_rule",
        GOOD.replace("erp", "fax"): "business_rule",
        GOOD[:-1] + ',"checksum":"12"}': "checksum",
        GOOD[:-1] + ',"checksum":"12","checksum_algorithm":"crc32"}': "checksum",
        GOOD[:-1] + ',"hmac":"12","checksum_algorithm":"hmac-sha256"}': "checksum",
        '"text"': "schema",
        "not json {": "schema",
    }
    got = decide(spark, list(cases))
    assert [got[i].stage for i in range(len(cases))] == list(cases.values())
    assert got[0].currency == "USD" and str(got[0].txn_date) == "2026-01-05"


def test_arrays_and_raw(spark):
    df = spark.createDataFrame([(f"[{GOOD}, 7, {GOOD}]",)], "value string")
    rows = feeds.read_json_feed(df).collect()
    assert len(rows) == 3 and sum(r.error is not None for r in rows) == 1


def test_hmac_is_the_standard_one(spark):
    for key in ("k", "x" * 100):
        got = spark.range(1).select(V.hmac_sha256(key, F.lit("message é"))).first()[0]
        assert got == hmac.new(key.encode(), "message é".encode(), hashlib.sha256).hexdigest()


def test_csv_and_formats(spark):
    df = spark.createDataFrame([("id,amount\n1,2.5\n\"a,b\",3\n",)], "value string")
    rows = feeds.read_csv_feed(df, ["id", "amount"]).select("record").collect()
    assert [r.record for r in rows] == [{"id": "1", "amount": "2.5"}, {"id": "a,b", "amount": "3"}]
    kinds = spark.createDataFrame([(' {"a":1}',), ("a;b\n1;2",), ("plain",)], "value string").select(feeds.detect_format(F.col("value"))).collect()
    assert [k[0] for k in kinds] == ["json", "csv", "json"]


def test_alias_order_and_keys(spark):
    df = spark.createDataFrame([(None, "2", "3")], "amt string, value string, transaction_amount string")
    assert N.rename_aliases(df).first().asDict() == {"amount": "2"}
    m = spark.range(1).select(N.canon_keys(F.create_map(F.lit(" Txn ID "), F.lit("1"), F.lit("txn_id"), F.lit("2"))).alias("m")).first().m
    assert m == {"txn_id": "1"}
    import pytest

    with pytest.raises(ValueError):
        V.load_rules("[]")


def test_records_that_come_twice_are_validated_once(spark):
    from ledgerloom.plans import registry

    df = registry.queries()["duplicate_count"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("StructsToJsonEvaluator") == 1
    row = df.first()
    assert row.records == 2 * row.distinct == 2 * row.duplicates > 0
