"""Queries over reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import grade, match_rule, report as P, validate as V
from ledgerloom.operators.frames import cut_lineage
from ledgerloom.plans.fixtures import AS_OF, LEDGER_SQL, QUEUE_SQL, RUNS_SQL, VALIDATION_LOG_SQL, ledger, queue, raw_feed, runs, statement, transactions, validation_log
from ledgerloom.plans.q_match import RULE_SQL
from ledgerloom.sources import feeds

Q = {}
NOW, TODAY = "2024-01-31 12:00:00", "2024-01-30"
FIRST, LAST = "1998-01-01", "1998-03-31"


def q(name, sql=None):
    def put(f):
        Q[name] = (f, sql)
        return f

    return put


def dated_pairs(s, d):
    return match_rule.rule_match(ledger(s, d), statement(s, d), dated=True)


def _d(c, as_of):
    return f"date_diff('day', CAST({c} AS DATE), DATE '{as_of}')"


@q("kpi_volume", f"WITH {LEDGER_SQL} SELECT count(*) FILTER ({_d('txn_date', LAST)} BETWEEN 0 AND 29) AS volume, sum(amount) FILTER ({_d('txn_date', LAST)} BETWEEN 0 AND 29) AS value, count(*) FILTER ({_d('txn_date', LAST)} BETWEEN 30 AND 59) AS prior_volume FROM transactions")
def _(s, d):
    return P.kpi_volume(transactions(s, d), LAST)


@q("kpi_match_rate", f"""WITH {RULE_SQL}, n AS (SELECT (SELECT count(*) FROM transactions WHERE {_d('txn_date', LAST)} BETWEEN 0 AND 29) AS v, (SELECT count(*) FROM transactions WHERE {_d('txn_date', LAST)} BETWEEN 30 AND 59) AS v0,
(SELECT count(*) FROM rule_pairs WHERE {_d('matched_on', LAST)} BETWEEN 0 AND 29) AS p, (SELECT count(*) FROM rule_pairs WHERE {_d('matched_on', LAST)} BETWEEN 30 AND 59) AS p0),
r AS (SELECT CASE WHEN v > 0 THEN least(1.0, round(2 * p / v, 4)) END AS a, CASE WHEN v0 > 0 THEN least(1.0, round(2 * p0 / v0, 4)) END AS b FROM n)
SELECT a AS match_rate, b AS prior_rate, round(a - b, 4) AS delta FROM r""")
def _(s, d):
    return P.kpi_match_rate(transactions(s, d), dated_pairs(s, d), LAST)


@q("kpi_exceptions", f"""WITH {QUEUE_SQL}, n AS (SELECT count(*) FILTER (state IN ('OPEN', 'SUGGESTED')) AS open, count(*) FILTER ({_d('created_at', TODAY)} BETWEEN 10 AND 19) AS prior_created,
count(*) FILTER (state = 'RESOLVED' AND {_d('resolved_at', TODAY)} BETWEEN 0 AND 9) AS resolved, count(*) FILTER (state = 'REJECTED' AND {_d('resolved_at', TODAY)} BETWEEN 0 AND 9) AS rejected FROM queue)
SELECT *, round(resolved / nullif(resolved + rejected, 0), 4) AS resolved_rate FROM n""")
def _(s, d):
    return P.kpi_exceptions(queue(s, d), TODAY, 10)


@q("kpi_validation", f"""WITH {VALIDATION_LOG_SQL}, n AS (SELECT count(*) FILTER (status = 'PASSED' AND {_d('validated_at', TODAY)} BETWEEN 0 AND 9) AS passed, count(*) FILTER (status = 'QUARANTINED' AND {_d('validated_at', TODAY)} BETWEEN 0 AND 9) AS quarantined,
count(*) FILTER (status = 'QUARANTINED' AND CAST(validated_at AS DATE) = DATE '{TODAY}') AS quarantined_today FROM validation_log) SELECT *, round(quarantined / nullif(passed + quarantined, 0), 4) AS quarantine_share FROM n""")
def _(s, d):
    return P.kpi_validation(validation_log(s, d), TODAY, 10)


KPI_RUNS = "n AS (SELECT arg_max(id, started_at) AS last_run, arg_max(status, started_at) AS last_status, max(started_at) AS last_started_at, round(avg(CAST(duration_ms AS DOUBLE)) FILTER (status = 'COMPLETED'), 4) AS avg_duration_ms, round(quantile_cont(CAST(duration_ms AS DOUBLE), 0.95) FILTER (status = 'COMPLETED'), 4) AS p95_duration_ms, count(*) FILTER (status = 'FAILED') AS failed FROM runs)"


@q("kpi_runs", f"WITH {RUNS_SQL}, {KPI_RUNS} SELECT * FROM n")
def _(s, d):
    return P.kpi_runs(runs(s, d))


@q("run_status", f"WITH {RUNS_SQL}, {KPI_RUNS} SELECT CASE WHEN last_run IS NULL THEN 'UNKNOWN' WHEN last_status = 'FAILED' OR date_diff('second', last_started_at, TIMESTAMP '{NOW}') > 86400 THEN 'ATTENTION' ELSE 'HEALTHY' END AS status FROM n")
def _(s, d):
    return P.run_status(P.kpi_runs(runs(s, d)), NOW)


@q("ratio_delta", f"WITH {LEDGER_SQL}, n AS (SELECT b, count(*) FILTER (source_type = 'erp') AS i, count(*) FILTER (source_type <> 'erp') AS e FROM transactions GROUP BY 1), r AS (SELECT b, round(i / nullif(e, 0), 4) AS ratio FROM n) SELECT b, ratio, round(ratio - 1, 4) AS delta FROM r")
def _(s, d):
    n = transactions(s, d).groupBy("b").agg(F.count_if(F.col("source_type") == "erp").alias("i"), F.count_if(F.col("source_type") != "erp").alias("e"))
    r = n.select("b", P.ratio(F.col("i"), F.col("e")).alias("ratio"))
    return r.select("b", "ratio", P.delta(F.col("ratio"), F.lit(1.0)).alias("delta"))


SERIES_SQL = f"""days AS (SELECT CAST(unnest(generate_series(DATE '{FIRST}', DATE '{LAST}', INTERVAL 1 DAY)) AS DATE) AS day),
vol AS (SELECT txn_date AS day, count(*) AS volume FROM transactions GROUP BY 1), prs AS (SELECT matched_on AS day, count(*) AS pairs FROM rule_pairs GROUP BY 1),
lat AS (SELECT CAST(started_at AS DATE) AS day, round(avg(CAST(duration_ms AS DOUBLE)), 4) AS avg_latency_ms FROM runs WHERE status = 'COMPLETED' GROUP BY 1),
s0 AS (SELECT day, coalesce(volume, 0) AS volume, coalesce(pairs, 0) AS pairs, avg_latency_ms FROM days LEFT JOIN vol USING (day) LEFT JOIN prs USING (day) LEFT JOIN lat USING (day)),
series AS (SELECT day, volume, least(volume, 2 * pairs) AS matched, volume - least(volume, 2 * pairs) AS unmatched, pairs AS rule, 0::BIGINT AS ml, round(least(volume, 2 * pairs) / nullif(volume, 0), 4) AS rate, avg_latency_ms FROM s0)"""


def series(s, d):
    return P.match_rate_series(transactions(s, d), dated_pairs(s, d), runs(s, d), FIRST, LAST)


@q("match_rate_series", f"WITH {RULE_SQL}, {RUNS_SQL}, {SERIES_SQL} SELECT * FROM series")
def _(s, d):
    return series(s, d)


@q("category_breakdown", f"WITH {QUEUE_SQL} SELECT coalesce(category, 'UNCLASSIFIED') AS category, count(*) AS open, sum(amount) AS exposure FROM queue WHERE state IN ('OPEN', 'SUGGESTED') GROUP BY 1")
def _(s, d):
    return P.category_breakdown(queue(s, d))


@q("exception_list", f"WITH {QUEUE_SQL} SELECT id, state, category FROM queue WHERE state = 'RESOLVED' AND resolved_by ILIKE '%USER-1%' ORDER BY created_at DESC, id LIMIT 50 OFFSET 20")
def _(s, d):
    return P.exception_list(queue(s, d), state="RESOLVED", search="USER-1", offset=20)[0].select("id", "state", "category")


@q("exception_list_total", f"WITH {QUEUE_SQL} SELECT count(*) AS total FROM queue WHERE category = 'SPLIT_SETTLEMENT' AND (id ILIKE '%C-1%' OR transaction_id ILIKE '%C-1%')")
def _(s, d):
    return P.exception_list(queue(s, d), category="SPLIT_SETTLEMENT", search="c-1")[1]


@q("exception_age", f"WITH {QUEUE_SQL} SELECT id, CAST(floor(date_diff('second', date_trunc('second', created_at), TIMESTAMP '{NOW}') / 3600) AS BIGINT) AS age_hours FROM queue")
def _(s, d):
    return P.exception_age(queue(s, d), NOW)


@q("queue_view", f"WITH {QUEUE_SQL} SELECT id, amount FROM queue ORDER BY amount DESC, id LIMIT 100")
def _(s, d):
    return P.queue_view(queue(s, d), "amount").select("id", "amount")


@q("queue_counts", f"WITH {QUEUE_SQL} SELECT category, count(*) AS n, sum(amount) AS amount FROM queue WHERE category IS NOT NULL GROUP BY 1")
def _(s, d):
    return P.queue_counts(queue(s, d))


@q("range_totals", f"""WITH {RULE_SQL}, {RUNS_SQL}, {SERIES_SQL}, n AS (SELECT unnest([7, 30, 90]) AS days)
SELECT days, sum(volume)::BIGINT AS volume, sum(matched)::BIGINT AS matched, sum(unmatched)::BIGINT AS unmatched, round(sum(matched) / nullif(sum(volume), 0), 4) AS rate FROM n JOIN series ON date_diff('day', day, DATE '{LAST}') BETWEEN 0 AND days - 1 GROUP BY 1""")
def _(s, d):
    return P.range_totals(series(s, d), LAST)


@q("report_exceptions", f"WITH {LEDGER_SQL}, {QUEUE_SQL} SELECT queue.id, transaction_id, t.amount AS txn_amount FROM queue JOIN transactions t ON t.id = transaction_id WHERE t.txn_date BETWEEN DATE '{FIRST}' AND DATE '{LAST}' ORDER BY created_at DESC, queue.id LIMIT 200")
def _(s, d):
    return P.report_exceptions(queue(s, d), transactions(s, d), FIRST, LAST).select("id", "transaction_id", "txn_amount")


@q("rule_ml_split", f"WITH {RULE_SQL}, {RUNS_SQL}, {SERIES_SQL} SELECT sum(rule)::BIGINT AS rule, sum(ml)::BIGINT AS ml, round(sum(rule) / nullif(sum(rule) + sum(ml), 0), 4) AS deterministic_share FROM series")
def _(s, d):
    return P.rule_ml_split(series(s, d))


@q("series_downsample", f"WITH {RULE_SQL}, {RUNS_SQL}, {SERIES_SQL}, f AS (SELECT *, row_number() OVER (ORDER BY day) - 1 AS n, greatest(1, floor(count(*) OVER () / 20)) AS step FROM series WHERE volume > 0) SELECT day, volume, matched FROM f WHERE n % step = 0")
def _(s, d):
    return P.series_downsample(series(s, d)).select("day", "volume", "matched")


@q("category_shares", f"WITH {QUEUE_SQL}, b AS (SELECT coalesce(category, 'UNCLASSIFIED') AS category, count(*) AS open, sum(amount) AS exposure FROM queue WHERE state IN ('OPEN', 'SUGGESTED') GROUP BY 1) SELECT category, open, round(open / sum(open) OVER (), 4) AS share, exposure FROM b")
def _(s, d):
    return P.category_shares(P.category_breakdown(queue(s, d)))


@q("report_tables", f"WITH {QUEUE_SQL}, n AS (SELECT count(*) AS n FROM queue WHERE state = 'OPEN') SELECT 'exceptions' AS \"table\", least(n, 60) + CASE WHEN n > 60 THEN 1 ELSE 0 END AS rows, CASE WHEN n > 60 THEN (n - 60) || ' more' END AS more FROM n")
def _(s, d):
    t = P.report_tables("exceptions", queue(s, d).where("state = 'OPEN'").select("id", "category"), 60, ["id"])
    return t.groupBy("table").agg(F.count(F.lit(1)).alias("rows"), F.max(F.when(F.col("row").endswith(" more"), F.col("row"))).alias("more"))


@q("report_bundle")
def _(s, d):
    b = P.report_bundle("EXCEPTION_DETAIL", {"exceptions": queue(s, d).select("id"), "categories": P.category_breakdown(queue(s, d)), "audit": queue(s, d)})
    out = None
    for name, rows in b.items():
        n = rows.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = n if out is None else out.unionByName(n)
    return out


@q("report_snapshot", f"WITH {LEDGER_SQL} SELECT 'RECONCILIATION_SUMMARY' AS report_type, DATE '{LAST}' AS as_of, count(*) FILTER ({_d('txn_date', LAST)} BETWEEN 0 AND 29) AS volume FROM transactions")
def _(s, d):
    return P.report_snapshot("RECONCILIATION_SUMMARY", LAST, P.kpi_volume(transactions(s, d), LAST)).select("report_type", "as_of", F.col("figures.volume").alias("volume"))


@q("report_list", f"WITH {RUNS_SQL} SELECT id, started_at AS generated_at FROM runs ORDER BY started_at DESC, id LIMIT 50")
def _(s, d):
    return P.report_list(runs(s, d).select("id", F.col("started_at").alias("generated_at")))


@q("latency_percentile", f"WITH {RUNS_SQL} SELECT count(*) AS runs, round(quantile_cont(CAST(duration_ms AS DOUBLE), 0.95), 4) AS p95_ms, round(avg(CAST(duration_ms AS DOUBLE)), 4) AS avg_ms FROM runs WHERE status = 'COMPLETED'")
def _(s, d):
    return grade.latency_percentile(runs(s, d))


def flagship(s, d):
    """Validated bank feed against the ledger: rule-layer match rate by day."""
    passed = V.validate(feeds.read_json_feed(raw_feed(s, d)), AS_OF).where("status = 'PASSED'")
    # Both sides are read by the match and by the series: they are made once.
    external = cut_lineage(passed.select(F.col("external_id").alias("id"), "source_type", F.col("amount").cast("decimal(18,2)").alias("amount"), "currency", "txn_date", "description", "reference_code"))
    internal = cut_lineage(ledger(s, d).select(external.columns))
    pairs = match_rule.rule_match(internal, external, dated=True)
    return P.match_rate_series(internal.unionByName(external), pairs, runs(s, d), FIRST, LAST)


FLAGSHIP_SQL = RULE_SQL.replace("FROM legs\n)", "FROM legs WHERE k % 37 <> 0\n)")
Q["daily_match_rate"] = (flagship, f"WITH {FLAGSHIP_SQL}, {RUNS_SQL}, {SERIES_SQL} SELECT * FROM series")
