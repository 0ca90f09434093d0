"""Queries over feeds, normalisation and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import normalize as N
from ledgerloom.operators import grade, sinks, validate as V
from ledgerloom.plans.fixtures import AS_OF, RAW_SQL, LEDGER_SQL, ledger, raw_feed, statement, table, transactions
from ledgerloom.sources import feeds, tables
from ledgerloom.streaming.stream import duplicate_count

Q = {}


def q(name, sql=None):
    def put(f):
        Q[name] = (f, sql)
        return f

    return put


def decisions(s, d):
    return V.validate(feeds.read_json_feed(raw_feed(s, d)), AS_OF)


CSV = ["transaction_id", "source", "transaction_amount", "ccy", "value_date", "narrative", "ref"]


def csv_messages(s, d):
    """Ledger rows as CSV messages of one header and one line each."""
    line = F.concat_ws(",", "id", "source_type", F.col("amount").cast("string"), "currency", F.col("txn_date").cast("string"), "description", "reference_code")
    return ledger(s, d).select("k", F.concat(F.lit(",".join(CSV) + "\n"), line, F.lit("\n")).alias("value"))


@q("read_csv_feed", f"WITH {LEDGER_SQL} SELECT k, id AS transaction_id, CAST(amount AS VARCHAR) AS amount, CAST(txn_date AS VARCHAR) AS value_date, description AS narrative, reference_code AS ref FROM ledger")
def _(s, d):
    r = feeds.read_csv_feed(csv_messages(s, d), CSV)
    g = lambda n: F.col("record")[n]
    return r.select("k", g("transaction_id").alias("transaction_id"), g("transaction_amount").alias("amount"), g("value_date").alias("value_date"), g("narrative").alias("narrative"), g("ref").alias("ref"))


@q("read_json_feed", f"WITH {RAW_SQL} SELECT k, id, CASE WHEN defect = 'bad_external_id' THEN 'has space!' WHEN defect = 'not_an_object' THEN NULL ELSE id END AS txn_id, defect IS NOT DISTINCT FROM 'not_an_object' AS bad FROM marked")
def _(s, d):
    r = feeds.read_json_feed(raw_feed(s, d))
    return r.select("k", "id", F.try_element_at("record", F.lit("txn_id")).alias("txn_id"), F.col("error").isNotNull().alias("bad"))


@q("detect_format", f"WITH {RAW_SQL} SELECT 'csv' AS format, count(*) AS n FROM ledger UNION ALL SELECT 'json', count(*) FROM marked")
def _(s, d):
    both = csv_messages(s, d).select("value").unionByName(raw_feed(s, d).select("value"))
    return both.groupBy(feeds.detect_format(F.col("value")).alias("format")).agg(F.count(F.lit(1)).alias("n"))


@q("decode_bytes")
def _(s, d):
    bad = F.concat(F.col("value").cast("binary"), F.unhex(F.lit("C328")))
    return raw_feed(s, d).select("id", F.char_length(feeds.decode_bytes(bad)).alias("n_chars"))


@q("load_rules")
def _(s, d):
    import json

    rules = V.load_rules(json.dumps(V.RULES))
    return V.coerce_for_rules(decisions(s, d)).select("id", F.size(V.apply_rules(AS_OF, rules)).alias("n_violations"))


@q("invoices_from_lines", "SELECT CAST(l_orderkey AS VARCHAR) AS invoice, sum(CAST(CAST(l_quantity AS DECIMAL(10,2)) * CAST(l_tax AS DECIMAL(10,2)) AS DECIMAL(18,2))) AS amount, min(CAST(l_shipdate AS DATE)) AS txn_date, count(*) AS lines FROM lineitem WHERE l_quantity > 0 AND CAST(l_tax AS DECIMAL(10,2)) > 0 GROUP BY 1")
def _(s, d):
    return tables.invoices_from_lines(_lines(s, d)).select("invoice", "amount", "txn_date", "lines")


def _lines(s, d):
    return table(s, d, "lineitem").selectExpr("CAST(l_orderkey AS STRING) AS invoice", "l_suppkey AS customer", "CAST(l_quantity AS DECIMAL(10,2)) AS quantity", "CAST(l_tax AS DECIMAL(10,2)) AS price", "CAST(l_shipdate AS DATE) AS date", "CAST(l_partkey AS STRING) AS description", "l_linenumber AS line")


@q("ledger_window")
def _(s, d):
    return tables.ledger_window(tables.invoices_from_lines(_lines(s, d)), 100)


@q("canon_headers", f"WITH {LEDGER_SQL} SELECT id AS transaction_id, amount AS transaction_amount FROM ledger")
def _(s, d):
    return N.canon_headers(ledger(s, d).select(F.col("id").alias(" Transaction ID "), F.col("amount").alias("TRANSACTION amount")))


@q("rename_aliases", f"WITH {LEDGER_SQL} SELECT id AS external_id, amount, description FROM statement")
def _(s, d):
    return N.rename_aliases(statement(s, d).select(F.col("id").alias("txn_id"), F.col("amount").alias("amt"), F.col("description").alias("memo")))


@q("clean_strings", f"WITH {LEDGER_SQL} SELECT id, CASE WHEN k % 3 = 0 THEN NULL ELSE description END AS cleaned FROM ledger")
def _(s, d):
    raw = F.when(F.expr("k % 3 = 0"), F.lit(" \t ")).otherwise(F.concat(F.lit("\t "), "description", F.lit(" \n")))
    return ledger(s, d).select("id", N.clean_string(raw).alias("cleaned"))


@q("missing_to_null", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END AS value FROM events")
def _(s, d):
    v = F.when(F.expr("event_id % 4 = 0"), F.lit(float("nan"))).otherwise(F.col("value"))
    return table(s, d, "events").select("event_id", N.missing_to_null(v).alias("value"))


@q("keep_fields", f"WITH {RAW_SQL} SELECT count(*) AS n FROM marked WHERE defect IN ('mismatch', 'unsupported_algorithm', 'hmac_no_secret')")
def _(s, d):
    r = feeds.read_json_feed(raw_feed(s, d)).select(F.map_keys(N.keep_fields(F.col("record"))).alias("keys"))
    return r.agg(F.count_if(F.array_contains("keys", "checksum")).alias("n"))


@q("carry_unparseable", f"WITH {RAW_SQL} SELECT id, '\"just text\"' AS raw FROM marked WHERE defect = 'not_an_object'")
def _(s, d):
    return feeds.read_json_feed(raw_feed(s, d)).where("error IS NOT NULL").select("id", F.try_element_at("record", F.lit("_raw")).alias("raw"))


CANON = """'{"amount":"' || CAST(amount AS VARCHAR) || '","currency":"USD","description":"' || description || '","external_id":"' || id || '",' || coalesce('"reference_code":"' || reference_code || '",', '') || '"source_type":"' || source_type || '","txn_date":"' || CAST(txn_date AS VARCHAR) || '"}'"""


@q("canonical_json", f"WITH {RAW_SQL} SELECT id, {CANON} AS body FROM marked WHERE defect IS NULL")
def _(s, d):
    return decisions(s, d).where("defect IS NULL").select("id", N.canonical_json("r").alias("body"))


@q("fingerprint", f"WITH {RAW_SQL} SELECT id, sha256({CANON}) AS fingerprint FROM marked WHERE defect IS NULL")
def _(s, d):
    return decisions(s, d).where("defect IS NULL").select("id", "fingerprint")


@q("normalize_description", f"WITH {LEDGER_SQL} SELECT id, trim(regexp_replace(lower(description), '[^a-z0-9]+', ' ', 'g')) AS t FROM statement")
def _(s, d):
    return statement(s, d).select("id", N.normalize_description(F.col("description")).alias("t"))


@q("jaccard_tokens", f"""WITH {LEDGER_SQL}, t AS (SELECT s.id, list_distinct(string_split(lower(l.description), ' ')) AS x, list_distinct(string_split(lower(s.description), ' ')) AS y FROM ledger l JOIN statement s USING (k))
SELECT id, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 4) AS j FROM t""")
def _(s, d):
    a, b = ledger(s, d).select("k", F.col("description").alias("x")), statement(s, d).select("k", "id", F.col("description").alias("y"))
    return a.join(b.hint("merge"), "k").select("id", N.jaccard_tokens(F.col("x"), F.col("y")).alias("j"))


@q("format_values", f"WITH {LEDGER_SQL} SELECT id, CASE WHEN k % 5 = 0 THEN '—' ELSE currency || ' ' || format('{{:,.2f}}', CAST(amount AS DOUBLE)) END AS money FROM ledger")
def _(s, d):
    a = F.when(F.expr("k % 5 <> 0"), F.col("amount"))
    return ledger(s, d).select("id", N.format_money(a, F.col("currency")).alias("money"))


@q("check_structure", f"WITH {RAW_SQL} SELECT id, CASE WHEN stage = 'schema' AND defect <> 'not_an_object' THEN 1 ELSE 0 END AS n FROM marked WHERE defect IS DISTINCT FROM 'not_an_object'")
def _(s, d):
    return decisions(s, d).where("error IS NULL").select("id", F.size(V.check_structure("r")).cast("int").alias("n"))


@q("check_object", f"WITH {RAW_SQL} SELECT count(*) AS n FROM marked WHERE defect = 'not_an_object'")
def _(s, d):
    return decisions(s, d).where("error IS NOT NULL AND stage = 'schema'").agg(F.count(F.lit(1)).alias("n"))


def _rule(name, kinds, columns, defects):
    sql = f"WITH {RAW_SQL} SELECT id, coalesce(defect IN ({', '.join(repr(x) for x in defects)}), false) AS broken FROM marked WHERE defect IS DISTINCT FROM 'not_an_object'"

    def f(s, d):
        rules = [r for r in V.RULES if r["rule"] in kinds and r["column"] in columns]
        return decisions(s, d).where("error IS NULL").select("id", (F.size(V.apply_rules(AS_OF, rules)) > 0).alias("broken"))

    Q[name] = (f, sql)


_rule("rule_not_null", ["not_null"], ["amount", "txn_date", "source_type", "currency"], ["missing_amount", "null_amount", "non_numeric_amount", "missing_txn_date", "malformed_date", "missing_source_type"])
_rule("rule_between", ["between"], ["amount"], ["zero_amount", "negative_amount", "amount_overflows_column"])
_rule("rule_in_set", ["in_set"], ["currency", "source_type"], ["unknown_currency", "unknown_source_type", "currency_too_short", "currency_too_long"])
_rule("rule_regex", ["regex"], ["reference_code", "external_id"], ["bad_reference_format", "bad_external_id"])
_rule("rule_not_future", ["not_future"], ["txn_date"], ["future_date"])


@q("apply_rules", f"WITH {RAW_SQL} SELECT count(*) AS n FROM marked WHERE stage = 'business_rule'")
def _(s, d):
    return decisions(s, d).where("stage = 'business_rule' AND size(violations) > 0").agg(F.count(F.lit(1)).alias("n"))


@q("coerce_for_rules", f"WITH {RAW_SQL} SELECT count(*) FILTER (defect IN ('missing_amount', 'null_amount', 'non_numeric_amount', 'not_an_object')) AS no_amount, count(*) FILTER (defect IN ('missing_txn_date', 'malformed_date', 'not_an_object')) AS no_date FROM marked")
def _(s, d):
    return decisions(s, d).agg(F.count_if(F.col("amount").isNull()).alias("no_amount"), F.count_if(F.col("txn_date").isNull()).alias("no_date"))


@q("verify_checksum", f"WITH {RAW_SQL} SELECT defect, count(*) AS n FROM marked WHERE stage = 'checksum' GROUP BY 1")
def _(s, d):
    return decisions(s, d).where("stage = 'checksum'").groupBy("defect").agg(F.count(F.lit(1)).alias("n"))


@q("verify_checksum_signed", f"WITH {RAW_SQL} SELECT count(*) AS rows, count(*) AS good FROM marked WHERE defect IS NULL")
def _(s, d):
    r = decisions(s, d).where("defect IS NULL").select("id", "record", "r")
    named = r.select("id", F.map_concat("record", F.create_map(F.lit("checksum_algorithm"), F.lit("hmac-sha256"))).alias("record")).withColumn("r", N.canonical_record(F.col("record")))
    signed = named.select("id", F.map_concat("record", F.create_map(F.lit("checksum"), F.concat(F.lit(" "), F.upper(V.hmac_sha256("key", N.canonical_json("r")))))).alias("record"))
    out = V.validate(signed, AS_OF, secret="key")
    return out.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("status") == "PASSED").alias("good"))


@q("first_failing_stage", f"WITH {RAW_SQL} SELECT id, stage, CASE WHEN stage IS NULL THEN 'PASSED' ELSE 'QUARANTINED' END AS status FROM marked")
def _(s, d):
    return decisions(s, d).select("id", "stage", "status")


@q("validation_summary", f"WITH {RAW_SQL} SELECT count(*) AS total, count(*) FILTER (stage IS NULL) AS passed, count(stage) AS quarantined, count(*) FILTER (stage = 'schema') AS at_schema, count(*) FILTER (stage = 'business_rule') AS at_business_rule, count(*) FILTER (stage = 'checksum') AS at_checksum FROM marked")
def _(s, d):
    return V.validation_summary(decisions(s, d))


@q("revalidate", f"WITH {RAW_SQL} SELECT count(*) AS replayed, count(*) FILTER (defect = 'future_date') AS passed FROM marked WHERE stage IS NOT NULL AND defect <> 'not_an_object'")
def _(s, d):
    bad = decisions(s, d).where("stage IS NOT NULL AND error IS NULL").select("record")
    again = V.validate(bad, "2099-12-31")
    return again.agg(F.count(F.lit(1)).alias("replayed"), F.count_if(F.col("status") == "PASSED").alias("passed"))


@q("transactions_rows", f"WITH {RAW_SQL} SELECT id AS external_id, source_type, amount, currency, txn_date, description, reference_code FROM marked WHERE stage IS NULL")
def _(s, d):
    return sinks.transactions_rows(decisions(s, d)).drop("id", "raw_payload")


@q("quarantine_rows", f"WITH {RAW_SQL} SELECT stage, count(*) AS n FROM marked WHERE stage IS NOT NULL GROUP BY 1")
def _(s, d):
    return sinks.quarantine_rows(decisions(s, d)).groupBy("stage").agg(F.count(F.lit(1)).alias("n"))


@q("validation_log_rows", f"WITH {RAW_SQL} SELECT coalesce(stage, 'checksum') AS stage, CASE WHEN stage IS NULL THEN 'PASSED' ELSE 'QUARANTINED' END AS status, count(*) AS n FROM marked GROUP BY ALL")
def _(s, d):
    return sinks.validation_log_rows(decisions(s, d)).groupBy("stage", "status").agg(F.count(F.lit(1)).alias("n"))


@q("quarantine_alerts")
def _(s, d):
    return sinks.quarantine_alerts(sinks.quarantine_rows(decisions(s, d)))


@q("grade_detection", f"WITH {RAW_SQL} SELECT count(defect) AS malformed, count(defect) AS caught, count(*) - count(defect) AS good, 0 AS false_positives, CASE WHEN count(defect) > 0 THEN 1.0::DOUBLE END AS detection_rate, 0.0::DOUBLE AS false_positive_rate FROM marked")
def _(s, d):
    return grade.grade_detection(decisions(s, d))


@q("defect_stage_check", f"WITH {RAW_SQL} SELECT defect, stage, count(*) AS n FROM marked WHERE defect IS NOT NULL GROUP BY ALL")
def _(s, d):
    return grade.defect_stage_check(decisions(s, d))


@q("duplicate_count", f"WITH {RAW_SQL} SELECT 2 * count(*) AS records, count(*) AS distinct, count(*) AS duplicates FROM marked WHERE defect IS NULL")
def _(s, d):
    # Each record comes twice; it is read and validated once.
    one = decisions(s, d).where("defect IS NULL").select("fingerprint")
    return duplicate_count(one.select("fingerprint", F.explode(F.array(F.lit(1), F.lit(2))).alias("time")))


@q("load_history_text", f"WITH {LEDGER_SQL} SELECT id, description FROM transactions WHERE description IS NOT NULL ORDER BY txn_date DESC, id LIMIT 2000")
def _(s, d):
    return tables.load_history_text(transactions(s, d), 2000)
