"""Reconciliation tables derived from the given ones, as DataFrames and as SQL.

A ledger of obligations and a statement of receipts come from `orders` and `customer` by the order
key alone; events give the queue, the runs and the logs. Nothing is random, so Spark and SQL agree row for row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2001-12-31"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def obligations(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).selectExpr(
        "o_orderkey AS k",
        "o_orderkey % 120 AS b",
        "CAST(o_totalprice AS DECIMAL(18,2)) AS amount",
        "CAST(o_orderdate AS DATE) AS txn_date",
        "concat('C', lpad(CAST(o_custkey AS STRING), 7, '0'), ' ', lower(c_mktsegment), ' - ', lower(substr(o_orderpriority, 3))) AS description",
        "concat('REF-', lpad(CAST(o_orderkey AS STRING), 6, '0')) AS reference_code",
    )


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return obligations(spark, sf_dir).where("b < 110").selectExpr(
        "concat('ERP-', k) AS id", "'erp' AS source_type", "amount", "'USD' AS currency", "txn_date", "description", "reference_code", "k", "b"
    )


def statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    legs = F.expr("CASE WHEN b BETWEEN 97 AND 99 THEN array(1, 2, 3) ELSE array(0) END")
    rows = obligations(spark, sf_dir).where("b < 100 OR b >= 110").withColumn("leg", F.explode(legs))
    memo = "concat('POS ', upper(substr(description, 1, 8)), ' BATCH', CAST(k % 90 + 10 AS STRING))"
    return rows.selectExpr(
        "CASE WHEN leg = 0 THEN concat('BNK-', k) ELSE concat('BNK-', k, '-', leg) END AS id",
        "CASE WHEN k % 2 = 0 THEN 'bank_api' ELSE 'payment_gateway' END AS source_type",
        """CAST(CASE WHEN b BETWEEN 91 AND 96 THEN amount * CAST(60 + k % 36 AS DECIMAL(4,0)) * 0.01
                     WHEN leg = 1 THEN amount * 0.50 WHEN leg = 2 THEN amount * 0.30 WHEN leg = 3 THEN amount * 0.15
                     ELSE amount END AS DECIMAL(18,2)) AS amount""",
        "'USD' AS currency",
        """date_add(txn_date, CAST(CASE WHEN b BETWEEN 62 AND 75 OR b BETWEEN 91 AND 96 THEN k % 3
                     WHEN b BETWEEN 76 AND 84 THEN 5 + k % 16 WHEN leg > 0 THEN leg - 1 ELSE 0 END AS INT)) AS txn_date""",
        f"CASE WHEN b BETWEEN 62 AND 75 OR b BETWEEN 85 AND 90 THEN {memo} ELSE description END AS description",
        """CASE WHEN b BETWEEN 62 AND 75 OR b BETWEEN 85 AND 99 THEN NULL
                WHEN b >= 110 THEN concat('REF-9', lpad(CAST(k AS STRING), 6, '0')) ELSE reference_code END AS reference_code""",
        "k",
        "b",
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger(spark, sf_dir).unionByName(statement(spark, sf_dir))


LEDGER_SQL = """
obligations AS (
  SELECT o_orderkey AS k, o_orderkey % 120 AS b, CAST(o_totalprice AS DECIMAL(18,2)) AS amount, CAST(o_orderdate AS DATE) AS txn_date,
    'C' || lpad(CAST(o_custkey AS VARCHAR), 7, '0') || ' ' || lower(c_mktsegment) || ' - ' || lower(substr(o_orderpriority, 3)) AS description,
    'REF-' || lpad(CAST(o_orderkey AS VARCHAR), 6, '0') AS reference_code
  FROM orders JOIN customer ON o_custkey = c_custkey
), ledger AS (
  SELECT 'ERP-' || k AS id, 'erp' AS source_type, amount, 'USD' AS currency, txn_date, description, reference_code, k, b FROM obligations WHERE b < 110
), legs AS (
  SELECT *, unnest(CASE WHEN b BETWEEN 97 AND 99 THEN [1, 2, 3] ELSE [0] END) AS leg FROM obligations WHERE b < 100 OR b >= 110
), statement AS (
  SELECT CASE WHEN leg = 0 THEN 'BNK-' || k ELSE 'BNK-' || k || '-' || leg END AS id,
    CASE WHEN k % 2 = 0 THEN 'bank_api' ELSE 'payment_gateway' END AS source_type,
    CAST(CASE WHEN b BETWEEN 91 AND 96 THEN amount * CAST(60 + k % 36 AS DECIMAL(4,0)) * 0.01
      WHEN leg = 1 THEN amount * 0.50 WHEN leg = 2 THEN amount * 0.30 WHEN leg = 3 THEN amount * 0.15 ELSE amount END AS DECIMAL(18,2)) AS amount,
    'USD' AS currency,
    txn_date + CAST(CASE WHEN b BETWEEN 62 AND 75 OR b BETWEEN 91 AND 96 THEN k % 3 WHEN b BETWEEN 76 AND 84 THEN 5 + k % 16 WHEN leg > 0 THEN leg - 1 ELSE 0 END AS INTEGER) AS txn_date,
    CASE WHEN b BETWEEN 62 AND 75 OR b BETWEEN 85 AND 90 THEN 'POS ' || upper(substr(description, 1, 8)) || ' BATCH' || CAST(k % 90 + 10 AS VARCHAR) ELSE description END AS description,
    CASE WHEN b BETWEEN 62 AND 75 OR b BETWEEN 85 AND 99 THEN NULL WHEN b >= 110 THEN 'REF-9' || lpad(CAST(k AS VARCHAR), 6, '0') ELSE reference_code END AS reference_code,
    k, b
  FROM legs
), transactions AS (
  SELECT * FROM ledger UNION ALL SELECT * FROM statement
)"""

#: The defect of every 37th statement row, in turn, and the stage that has to catch it.
DEFECTS = [
    ("missing_amount", "schema"),
    ("missing_txn_date", "schema"),
    ("missing_source_type", "schema"),
    ("zero_amount", "schema"),
    ("negative_amount", "schema"),
    ("non_numeric_amount", "schema"),
    ("currency_too_short", "schema"),
    ("currency_too_long", "schema"),
    ("malformed_date", "schema"),
    ("null_amount", "schema"),
    ("not_an_object", "schema"),
    ("unknown_currency", "business_rule"),
    ("unknown_source_type", "business_rule"),
    ("future_date", "business_rule"),
    ("bad_reference_format", "business_rule"),
    ("bad_external_id", "business_rule"),
    ("amount_overflows_column", "business_rule"),
    ("mismatch", "checksum"),
    ("unsupported_algorithm", "checksum"),
    ("hmac_no_secret", "checksum"),
]


def raw_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, id, defect, value): the statement as JSON under the bank's names; every 37th order key has a defect."""
    rows = statement(spark, sf_dir)
    names = F.array(*[F.lit(d) for d, _ in DEFECTS])
    rows = rows.withColumn("defect", F.when(F.expr("k % 37 = 0"), F.element_at(names, (F.floor(F.col("k") / 37) % 20 + 1).cast("int"))))
    is_ = lambda d: F.coalesce(F.col("defect") == d, F.lit(False))

    def swap(value, *changes):
        out = None
        for d, v in changes:
            out = F.when(is_(d), F.lit(v)) if out is None else out.when(is_(d), F.lit(v))
        return out.otherwise(value) if out is not None else value

    text = lambda name, v: F.when(v.isNotNull(), F.concat(F.lit(f'"{name}":"'), v, F.lit('"')))
    amount = swap(F.col("amount").cast("string"), ("zero_amount", "0.00"), ("negative_amount", "-5.00"), ("non_numeric_amount", "not-a-number"), ("amount_overflows_column", "99999999999.00"))
    fields = F.concat_ws(
        ",",
        text("txn_id", swap(F.col("id"), ("bad_external_id", "has space!"))),
        F.when(~is_("missing_source_type"), text("channel", swap(F.col("source_type"), ("unknown_source_type", "carrier_pigeon")))),
        F.when(is_("null_amount"), F.lit('"amt":null')).when(~is_("missing_amount"), text("amt", amount)),
        text("currency_code", swap(F.col("currency"), ("currency_too_short", "US"), ("currency_too_long", "USDD"), ("unknown_currency", "XXX"))),
        F.when(~is_("missing_txn_date"), text("posted_date", swap(F.col("txn_date").cast("string"), ("malformed_date", "2026-13-45"), ("future_date", "2099-01-01")))),
        text("memo", F.col("description")),
        text("reference", swap(F.col("reference_code"), ("bad_reference_format", "BADFORMAT"))),
        F.when(is_("mismatch"), F.lit('"checksum":"' + "0" * 64 + '"')),
        F.when(is_("unsupported_algorithm"), F.lit('"checksum":"00","checksum_algorithm":"crc32"')),
        F.when(is_("hmac_no_secret"), F.lit('"checksum":"00","checksum_algorithm":"hmac-sha256"')),
    )
    value = F.when(is_("not_an_object"), F.lit('"just text"')).otherwise(F.concat(F.lit("{"), fields, F.lit("}")))
    return rows.select("k", "id", "defect", value.alias("value"))


_list = ", ".join(f"'{d}'" for d, _ in DEFECTS)
_stages = ", ".join(f"'{s}'" for _, s in DEFECTS)
RAW_SQL = (
    LEDGER_SQL
    + f""", marked AS (
  SELECT *, CASE WHEN k % 37 = 0 THEN ([{_list}])[CAST(floor(k / 37) AS BIGINT) % 20 + 1] END AS defect,
    CASE WHEN k % 37 = 0 THEN ([{_stages}])[CAST(floor(k / 37) AS BIGINT) % 20 + 1] END AS stage
  FROM statement
)"""
)


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exception queue from events: type gives the state, the order of the id the category."""
    e = table(spark, sf_dir, "events")
    return e.selectExpr(
        "concat('EXC-', event_id) AS id",
        "concat('ERP-', event_id % 1000) AS transaction_id",
        "CASE event_type WHEN 'error' THEN 'OPEN' WHEN 'signup' THEN 'SUGGESTED' WHEN 'purchase' THEN 'RESOLVED' WHEN 'click' THEN 'REJECTED' ELSE 'OPEN' END AS state",
        "CASE CAST(event_id % 5 AS INT) WHEN 0 THEN 'PARTIAL_PAYMENT' WHEN 1 THEN 'SPLIT_SETTLEMENT' WHEN 2 THEN 'MISSING_REFERENCE_CODE' WHEN 3 THEN 'TIMING_DIFFERENCE' END AS category",
        "CAST(value AS DECIMAL(18,2)) AS amount",
        "ts AS created_at",
        "CASE WHEN event_type IN ('purchase', 'click') THEN ts + INTERVAL 36 HOURS END AS resolved_at",
        "CASE WHEN event_type IN ('purchase', 'click') AND user_id % 7 <> 0 THEN concat('user-', user_id % 20) END AS resolved_by",
        "event_id",
        "user_id",
    )


QUEUE_SQL = """queue AS (
  SELECT 'EXC-' || event_id AS id, 'ERP-' || (event_id % 1000) AS transaction_id,
    CASE event_type WHEN 'error' THEN 'OPEN' WHEN 'signup' THEN 'SUGGESTED' WHEN 'purchase' THEN 'RESOLVED' WHEN 'click' THEN 'REJECTED' ELSE 'OPEN' END AS state,
    CASE event_id % 5 WHEN 0 THEN 'PARTIAL_PAYMENT' WHEN 1 THEN 'SPLIT_SETTLEMENT' WHEN 2 THEN 'MISSING_REFERENCE_CODE' WHEN 3 THEN 'TIMING_DIFFERENCE' END AS category,
    CAST(value AS DECIMAL(18,2)) AS amount, ts AS created_at,
    CASE WHEN event_type IN ('purchase', 'click') THEN ts + INTERVAL 36 HOUR END AS resolved_at,
    CASE WHEN event_type IN ('purchase', 'click') AND user_id % 7 <> 0 THEN 'user-' || (user_id % 20) END AS resolved_by, event_id, user_id
  FROM events
)"""


def validation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "concat('VAL-', event_id) AS id", "ts AS validated_at", "CASE WHEN event_id % 13 = 0 THEN 'QUARANTINED' ELSE 'PASSED' END AS status", "CASE WHEN event_id % 13 = 0 THEN CASE WHEN event_id % 2 = 0 THEN 'schema' ELSE 'business_rule' END END AS stage"
    )


VALIDATION_LOG_SQL = """validation_log AS (
  SELECT 'VAL-' || event_id AS id, ts AS validated_at, CASE WHEN event_id % 13 = 0 THEN 'QUARANTINED' ELSE 'PASSED' END AS status,
    CASE WHEN event_id % 13 = 0 THEN CASE WHEN event_id % 2 = 0 THEN 'schema' ELSE 'business_rule' END END AS stage FROM events
)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_id % 50 = 0").selectExpr(
        "concat('RUN-', event_id) AS id", "ts AS started_at", "CASE WHEN event_id % 350 = 0 THEN 'FAILED' ELSE 'COMPLETED' END AS status", "CAST(value * 10 AS DECIMAL(12,2)) AS duration_ms"
    )


RUNS_SQL = """runs AS (
  SELECT 'RUN-' || event_id AS id, ts AS started_at, CASE WHEN event_id % 350 = 0 THEN 'FAILED' ELSE 'COMPLETED' END AS status,
    CAST(value * 10 AS DECIMAL(12,2)) AS duration_ms FROM events WHERE event_id % 50 = 0
)"""
