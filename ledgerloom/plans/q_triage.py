"""Queries over triage, decisions and learning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import grade, learn, triage as T
from ledgerloom.operators.frames import cut_lineage, staged, work_dir
from ledgerloom.operators.reconcile import reconcile
from ledgerloom.plans.fixtures import AS_OF, LEDGER_SQL, QUEUE_SQL, ledger, queue, statement, transactions
from ledgerloom.plans.q_match import JACCARD

Q = {}


def q(name, sql=None):
    def put(f):
        Q[name] = (f, sql)
        return f

    return put


def open_queue(s, d):
    """Open exceptions of ledger rows that no rule matched, with all receipts of their order as candidates."""
    legs = statement(s, d).groupBy("k").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    rows = ledger(s, d).where("b >= 62").join(legs.hint("merge"), "k", "left")
    return rows.select(
        F.concat(F.lit("EXC-"), "id").alias("id"), F.col("id").alias("transaction_id"), F.lit("OPEN").alias("state"), F.col("txn_date").cast("timestamp").alias("created_at"), F.get("ids", 0).alias("best_counterpart_id"), F.col("ids").alias("candidate_ids"), F.when(F.col("ids").isNotNull(), F.lit(0.5)).alias("best_confidence"), F.lit(None).cast("string").alias("category"), "b"
    )


def opened(s, d):
    return T.load_open_exceptions(open_queue(s, d), staged(transactions(s, d), "rows"))


def featured(s, d):
    return T.exception_features(opened(s, d))


def classified(s, d):
    return T.classify_rules(featured(s, d))


OPEN_SQL = f"""o AS (SELECT * FROM ledger WHERE b >= 62),
cand AS (SELECT l.id, l.k, s.id AS other, s.amount AS leg, s.txn_date AS leg_date, s.reference_code AS leg_ref, {JACCARD} AS sim, row_number() OVER (PARTITION BY l.id ORDER BY abs(s.amount - l.amount), s.id) AS near_rank FROM o l JOIN statement s USING (k)),
agg AS (SELECT id, count(*) AS n, sum(leg) AS total FROM cand GROUP BY 1),
f AS (SELECT o.id, o.b, o.amount, coalesce(n, 0) AS n, total, leg, leg_date, leg_ref, other, o.reference_code,
  CASE WHEN n > 0 THEN round(CAST(leg AS DOUBLE) / CAST(o.amount AS DOUBLE), 6) ELSE 0.0 END AS amount_ratio, CASE WHEN n > 0 THEN sim ELSE 0.0 END AS description_similarity,
  CASE WHEN n > 0 THEN CAST(abs(date_diff('day', o.txn_date, leg_date)) AS DOUBLE) ELSE 0.0 END AS date_delta_days,
  CASE WHEN n > 0 THEN CAST(o.amount - total AS DOUBLE) ELSE CAST(o.amount AS DOUBLE) END AS amount_shortfall,
  CASE WHEN n IS NULL THEN 0.0 WHEN o.reference_code IS NULL OR leg_ref IS NULL THEN 0.5 WHEN o.reference_code = leg_ref THEN 1.0 ELSE 0.0 END AS reference_agreement, ln(1 + CAST(o.amount AS DOUBLE)) AS log_amount
  FROM o LEFT JOIN agg USING (id) LEFT JOIN cand c ON c.id = o.id AND near_rank = 1),
cls AS (SELECT *, abs(amount_ratio - 1) <= 0.01 AS eq FROM f),
classed AS (SELECT *, CASE WHEN n >= 2 THEN 'SPLIT_SETTLEMENT' WHEN eq AND date_delta_days > 3 THEN 'TIMING_DIFFERENCE' WHEN eq AND (reference_code IS NULL OR reference_agreement = 0.5) THEN 'MISSING_REFERENCE_CODE' WHEN amount_ratio > 0 AND NOT eq THEN 'PARTIAL_PAYMENT' WHEN n = 0 THEN 'MISSING_REFERENCE_CODE' ELSE 'TIMING_DIFFERENCE' END AS category,
  round(CASE WHEN n >= 2 THEN least(0.95, 0.55 + 0.08 * n + 0.15 * least((CAST(amount AS DOUBLE) - amount_shortfall) / CAST(amount AS DOUBLE), 1.0)) WHEN eq AND date_delta_days > 3 THEN least(0.95, 0.70 + 0.02 * date_delta_days) WHEN eq AND (reference_code IS NULL OR reference_agreement = 0.5) THEN 0.85 WHEN amount_ratio > 0 AND NOT eq THEN least(0.92, 0.55 + 0.4 * least(amount_ratio, 1 / amount_ratio)) WHEN n = 0 THEN 0.45 ELSE 0.40 END, 4) AS confidence FROM cls)"""


@q("load_open_exceptions", f"WITH {LEDGER_SQL}, {OPEN_SQL} SELECT 'EXC-' || id AS id, n FROM f")
def _(s, d):
    return opened(s, d).select("id", F.when(F.col("counterparts").isNull(), 0).otherwise(F.size("counterparts")).alias("n"))


@q("nominated_ids", f"WITH {LEDGER_SQL} SELECT l.id AS transaction_id, coalesce(list(s.id ORDER BY s.id) FILTER (s.id IS NOT NULL), []) AS ids FROM ledger l LEFT JOIN statement s USING (k) WHERE l.b >= 62 GROUP BY 1")
def _(s, d):
    return open_queue(s, d).select("transaction_id", T.nominated_ids(F.col("best_counterpart_id"), F.col("candidate_ids")).alias("ids"))


@q("nearest_counterpart", f"WITH {LEDGER_SQL}, {OPEN_SQL} SELECT 'EXC-' || id AS id, other AS nearest FROM f")
def _(s, d):
    return featured(s, d).select("id", F.col("nearest.other").alias("nearest"))


@q("exception_features", f"WITH {LEDGER_SQL}, {OPEN_SQL} SELECT 'EXC-' || id AS id, amount_ratio, description_similarity, CASE WHEN reference_code IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS has_reference_code, date_delta_days, CAST(n AS DOUBLE) AS counterpart_count, amount_shortfall, CASE WHEN n > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS best_confidence, reference_agreement::DOUBLE AS reference_agreement, round(log_amount, 6) AS log_amount, 1.0::DOUBLE AS is_internal FROM f")
def _(s, d):
    return featured(s, d).withColumn("log_amount", F.round("log_amount", 6)).select("id", *T.FEATURES)


@q("classify_rules", f"WITH {LEDGER_SQL}, {OPEN_SQL} SELECT 'EXC-' || id AS id, category, CAST(confidence AS DOUBLE) AS confidence FROM classed")
def _(s, d):
    return classified(s, d).select("id", "category", F.col("category_confidence").alias("confidence"))


def suggested(s, d):
    return T.suggest_resolution(classified(s, d), AS_OF)


@q("suggest_resolution", f"WITH {LEDGER_SQL}, {OPEN_SQL} SELECT 'EXC-' || id AS id, CASE category WHEN 'PARTIAL_PAYMENT' THEN 'POST_PARTIAL_JOURNAL' WHEN 'SPLIT_SETTLEMENT' THEN 'ALLOCATE_MULTI_LINE' WHEN 'MISSING_REFERENCE_CODE' THEN 'ASSIGN_REFERENCE' ELSE 'HOLD_PENDING_SETTLEMENT' END AS action FROM classed")
def _(s, d):
    return suggested(s, d).select("id", "action")


@q("partial_payment_fields", f"WITH {LEDGER_SQL}, {OPEN_SQL} SELECT 'EXC-' || id AS id, greatest(amount, leg) AS obligation_amount, least(amount, leg) AS settled_amount, CAST(abs(amount - leg) AS DECIMAL(18,2)) AS residual_balance, round(CAST(least(amount, leg) AS DOUBLE) / CAST(greatest(amount, leg) AS DOUBLE), 4) AS settled_share, CASE WHEN amount >= leg THEN 'obligation' ELSE 'receipt' END AS viewed_from FROM classed WHERE category = 'PARTIAL_PAYMENT'")
def _(s, d):
    f = lambda n: F.col(f"fields.{n}").alias(n)
    return suggested(s, d).where("category = 'PARTIAL_PAYMENT'").select("id", *[f(n) for n in ("obligation_amount", "settled_amount", "residual_balance", "settled_share", "viewed_from")])


@q("split_settlement_fields", f"WITH {LEDGER_SQL}, {OPEN_SQL} SELECT 'EXC-' || id AS id, CAST(n AS INTEGER) AS candidate_legs, CAST(total AS DECIMAL(18,2)) AS allocated_total, CAST(amount - total AS DECIMAL(18,2)) AS unallocated_remainder FROM classed WHERE category = 'SPLIT_SETTLEMENT'")
def _(s, d):
    f = lambda n: F.col(f"fields.{n}").alias(n)
    return suggested(s, d).where("category = 'SPLIT_SETTLEMENT'").select("id", *[f(n) for n in ("candidate_legs", "allocated_total", "unallocated_remainder")])


@q("missing_reference_fields", f"WITH {LEDGER_SQL}, {OPEN_SQL} SELECT 'EXC-' || id AS id, CAST(n AS INTEGER) AS candidate_count, CASE WHEN n = 0 THEN 'MANUAL_SEARCH' ELSE 'ASSIGN_AND_REMATCH' END AS next_step FROM classed WHERE category = 'MISSING_REFERENCE_CODE'")
def _(s, d):
    return suggested(s, d).where("category = 'MISSING_REFERENCE_CODE'").select("id", F.col("fields.candidate_count").alias("candidate_count"), F.col("fields.next_step").alias("next_step"))


@q("timing_fields", f"WITH {LEDGER_SQL}, {OPEN_SQL} SELECT 'EXC-' || id AS id, CAST(date_delta_days AS INTEGER) AS period_drift_days, eq AS amount_agrees, CASE WHEN date_delta_days > 0 THEN DATE '{AS_OF}' + CAST(date_delta_days AS INTEGER) END AS hold_until FROM classed WHERE category = 'TIMING_DIFFERENCE'")
def _(s, d):
    f = lambda n: F.col(f"fields.{n}").alias(n)
    return suggested(s, d).where("category = 'TIMING_DIFFERENCE'").select("id", *[f(n) for n in ("period_drift_days", "amount_agrees", "hold_until")])


@q("apply_suggestions", f"WITH {LEDGER_SQL}, {OPEN_SQL} SELECT 'SUGGESTED' AS state, category, count(*) AS n FROM classed GROUP BY 2")
def _(s, d):
    return T.apply_suggestions(open_queue(s, d), suggested(s, d)).groupBy("state", "category").agg(F.count(F.lit(1)).alias("n"))


@q("triage", f"WITH {LEDGER_SQL}, {OPEN_SQL} SELECT 'EXC-' || id AS id, 'SUGGESTED' AS state, category, CAST(confidence AS DECIMAL(5,4)) AS confidence FROM classed")
def _(s, d):
    return T.apply_suggestions(open_queue(s, d), suggested(s, d)).select("id", "state", "category", F.col("category_confidence").alias("confidence"))


def left_by_matching(s, d):
    """The exceptions that a whole pass opens: its unmatched rows with their nearest misses and co-settling candidates. And the pass's rows."""
    passed = reconcile(transactions(s, d))
    left = passed.unmatched
    own = ("best_counterpart_id", "candidate_ids", "best_confidence")
    return staged(left.select(F.concat(F.lit("EXC-"), "id").alias("id"), F.col("id").alias("transaction_id"), F.lit("OPEN").alias("state"), F.lit(AS_OF).cast("timestamp").alias("created_at"), *own, F.lit(None).cast("string").alias("category")), "queue"), passed.inputs


# Triage over what matching really left, instead of what the fixture says it should.
@q("triage_of_unmatched")
def _(s, d):
    opened_, rows = left_by_matching(s, d)
    found = T.suggest_resolution(T.classify_rules(T.exception_features(T.load_open_exceptions(opened_, rows))), AS_OF)
    return T.apply_suggestions(opened_, found).select("id", "state", "category", F.col("category_confidence").alias("confidence"))


ARCHETYPE = "CASE WHEN b < 76 THEN 'noisy_description' WHEN b < 85 THEN 'timing_difference' WHEN b < 91 THEN 'missing_reference' WHEN b < 97 THEN 'partial_payment' WHEN b < 100 THEN 'split_settlement' ELSE 'decoy' END"
EXPECTED = "CASE WHEN b < 76 THEN 'MISSING_REFERENCE_CODE' WHEN b < 85 THEN 'TIMING_DIFFERENCE' WHEN b < 91 THEN 'MISSING_REFERENCE_CODE' WHEN b < 97 THEN 'PARTIAL_PAYMENT' WHEN b < 100 THEN 'SPLIT_SETTLEMENT' ELSE 'MISSING_REFERENCE_CODE' END"


@q("grade_triage", f"WITH {LEDGER_SQL}, {OPEN_SQL} SELECT {ARCHETYPE} AS archetype, count(*) AS in_key, count(*) AS reached, count(*) FILTER (category = {EXPECTED}) AS correct, round(count(*) FILTER (category = {EXPECTED}) / count(*), 4) AS accuracy FROM classed GROUP BY 1")
def _(s, d):
    key = ledger(s, d).where("b >= 62").selectExpr("id AS transaction_id", f"{ARCHETYPE} AS archetype", f"{EXPECTED} AS expected")
    return grade.grade_triage(classified(s, d), key)


def decisions(s, d):
    """A decision on every second exception of the events' queue."""
    return queue(s, d).where("event_id % 2 = 0").selectExpr("id", "CASE CAST(event_id % 3 AS INT) WHEN 0 THEN 'ACCEPT' WHEN 1 THEN 'EDIT' ELSE 'REJECT' END AS decision", "concat('user-', user_id % 20) AS actor", "created_at + INTERVAL 48 HOURS AS decided_at", "CASE WHEN event_id % 9 <> 1 THEN 'PARTIAL_PAYMENT' END AS corrected_category")


DECIDE_SQL = """dec AS (SELECT id, state AS old_state, category, CASE event_id % 3 WHEN 0 THEN 'ACCEPT' WHEN 1 THEN 'EDIT' ELSE 'REJECT' END AS decision, CASE WHEN event_id % 9 <> 1 THEN 'PARTIAL_PAYMENT' END AS corrected, 'user-' || (user_id % 20) AS actor FROM queue WHERE event_id % 2 = 0),
fin AS (SELECT *, old_state IN ('OPEN', 'SUGGESTED') AND (decision <> 'EDIT' OR corrected IS NOT NULL) AS ok, CASE WHEN decision = 'EDIT' THEN corrected ELSE category END AS final FROM dec)"""


@q("apply_decisions", f"WITH {QUEUE_SQL}, {DECIDE_SQL} SELECT id, old_state, CASE WHEN decision = 'REJECT' THEN 'REJECTED' ELSE 'RESOLVED' END AS state, final AS category, actor AS resolved_by, decision <> 'REJECT' AND final IS NOT NULL AS is_label FROM fin WHERE ok")
def _(s, d):
    return T.apply_decisions(queue(s, d), decisions(s, d))[0].drop("resolved_at")


@q("refused_decisions", f"WITH {QUEUE_SQL}, {DECIDE_SQL} SELECT id, decision, CASE WHEN old_state NOT IN ('OPEN', 'SUGGESTED') THEN 'already settled' ELSE 'invalid decision' END AS reason FROM fin WHERE NOT ok")
def _(s, d):
    return T.apply_decisions(queue(s, d), decisions(s, d))[1]


def settled(s, d):
    """Settled exceptions with decision, category and features."""
    how = "CASE WHEN pmod(crc32(CAST(id AS BINARY)), 5) = 0 THEN 'EDIT' WHEN pmod(crc32(CAST(id AS BINARY)), 5) = 1 THEN 'REJECT' ELSE 'ACCEPT' END"
    return classified(s, d).withColumn("decision", F.expr(how)).select("id", "decision", "category", *T.FEATURES)


def simple_settled(s, d):
    return queue(s, d).where("state IN ('RESOLVED', 'REJECTED')").selectExpr("id", "category", "event_id", "CASE WHEN event_id % 5 = 0 THEN 'EDIT' WHEN state = 'REJECTED' THEN 'REJECT' ELSE 'ACCEPT' END AS decision")


SETTLED_SQL = QUEUE_SQL + ", st AS (SELECT id, category, event_id, CASE WHEN event_id % 5 = 0 THEN 'EDIT' WHEN state = 'REJECTED' THEN 'REJECT' ELSE 'ACCEPT' END AS decision FROM queue WHERE state IN ('RESOLVED', 'REJECTED'))"
USABLE = "decision <> 'REJECT' AND category IS NOT NULL"


@q("usable_label", f"WITH {SETTLED_SQL} SELECT id, {USABLE} AS usable FROM st")
def _(s, d):
    return simple_settled(s, d).select("id", T.usable_label(F.col("decision"), F.col("category")).alias("usable"))


@q("training_set", f"WITH {SETTLED_SQL} SELECT count(*) FILTER ({USABLE} AND decision = 'ACCEPT') AS confirmed, count(*) FILTER ({USABLE} AND decision = 'EDIT') AS corrected, count(*) FILTER (NOT ({USABLE})) AS unusable FROM st")
def _(s, d):
    return learn.label_counts(simple_settled(s, d))


@q("retrain_readiness", f"WITH {SETTLED_SQL}, n AS (SELECT count(*) FILTER ({USABLE}) AS u, count(*) AS r FROM st) SELECT u AS usable, 200 AS trigger, greatest(0, 200 - u) AS remaining, u >= 200 AS ready, r AS resolved FROM n")
def _(s, d):
    return learn.retrain_readiness(simple_settled(s, d))


@q("class_weights", f"WITH {SETTLED_SQL}, n AS (SELECT category, count(*) AS n FROM st WHERE {USABLE} GROUP BY 1) SELECT category, n, round(sum(n) OVER () / (count(*) OVER () * n), 6) AS weight FROM n")
def _(s, d):
    return learn.class_weights(learn.training_set(simple_settled(s, d)))


@q("stratified_split", f"""WITH {SETTLED_SQL}, t AS (SELECT id, category, ('0x' || substr(md5(id), 1, 8))::BIGINT AS h FROM st WHERE {USABLE}),
r AS (SELECT *, percent_rank() OVER (PARTITION BY category ORDER BY h, id) AS p, count(*) OVER (PARTITION BY category) AS n FROM t)
SELECT id, category, CASE WHEN min(n) OVER () < 2 THEN h / 4294967296 < 0.25 ELSE p < 0.25 END AS held_out FROM r""")
def _(s, d):
    return learn.stratified_split(learn.training_set(simple_settled(s, d))).select("id", "category", "held_out")


@q("classification_report", f"""WITH {SETTLED_SQL}, p AS (SELECT category AS t, CASE WHEN event_id % 4 = 0 THEN 'PARTIAL_PAYMENT' ELSE category END AS p FROM st WHERE category IS NOT NULL),
c AS (SELECT DISTINCT t AS category FROM p UNION SELECT DISTINCT p FROM p),
n AS (SELECT category, (SELECT count(*) FROM p WHERE t = category) AS support, (SELECT count(*) FROM p WHERE p.p = category) AS said, (SELECT count(*) FROM p WHERE t = category AND p.p = category) AS hit FROM c),
r AS (SELECT category, support, coalesce(hit / nullif(said, 0), 0) AS pr, coalesce(hit / nullif(support, 0), 0) AS re FROM n)
SELECT category, support, round(pr, 4) AS precision, round(re, 4) AS recall, round(coalesce(2 * pr * re / nullif(pr + re, 0), 0), 4) AS f1 FROM r""")
def _(s, d):
    rows = simple_settled(s, d).where("category IS NOT NULL").withColumn("predicted", F.when(F.expr("event_id % 4 = 0"), "PARTIAL_PAYMENT").otherwise(F.col("category")))
    return learn.classification_report(rows)


@q("train_forest")
def _(s, d):
    rows = staged(learn.stratified_split(learn.training_set(settled(s, d))), "split")
    model = learn.train_forest(rows.where("NOT held_out"))
    return learn.classify_forest(model, rows.where("held_out")).select("id", "category", "predicted", F.round("probability", 4).alias("probability"))


def forest(s, d):
    rows = cut_lineage(learn.stratified_split(learn.training_set(settled(s, d))))
    return rows, learn.train_forest(rows.where("NOT held_out"))


@q("promotion_guard")
def _(s, d):
    """The forest against what serves before any forest does, the rules, on the rows held out."""
    rows, model = forest(s, d)
    new, old, _ = learn.against_serving(model, rows.where("held_out"))
    return s.range(1).select(F.lit(new).alias("candidate_f1"), F.lit(old).alias("incumbent_f1"), F.lit(learn.promotion_guard(new, old)).alias("promoted"), F.lit(learn.promotion_guard(old, new)).alias("the_other_way"))


@q("classify_forest")
def _(s, d):
    rows, model = forest(s, d)
    return learn.classify(model, rows).select("id", "predicted", F.round("probability", 4).alias("probability"), "engine")


@q("classify_without_model", f"WITH {LEDGER_SQL}, {OPEN_SQL} SELECT 'EXC-' || id AS id, category AS predicted, CAST(confidence AS DOUBLE) AS probability, 'rules' AS engine FROM classed")
def _(s, d):
    return learn.classify(None, featured(s, d)).select("id", "predicted", "probability", "engine")


@q("explain_top3")
def _(s, d):
    rows, model = forest(s, d)
    return rows.select("id", learn.rationale(model).alias("rationale"))


@q("model_registry")
def _(s, d):
    """Predictions of a model that was saved and loaded again."""
    rows, model = forest(s, d)
    root = work_dir(s, "models")
    learn.save_version(model, root, 1)
    return learn.classify_forest(learn.load_version(s, root, 1), rows.where("held_out")).select("id", "predicted")


@q("retrain_if_ready")
def _(s, d):
    ready = cut_lineage(settled(s, d))
    outcomes = [("enough", learn.retrain_if_ready(ready, trigger=20)[0]), ("too few", learn.retrain_if_ready(ready, trigger=10**9)[0]), ("no rows", learn.retrain_if_ready(ready.limit(0), force=True)[0])]
    return s.createDataFrame(outcomes, "labels string, outcome string")


@q("load_labels", f"WITH {QUEUE_SQL} SELECT id, category FROM queue WHERE state IN ('RESOLVED', 'REJECTED') AND category IS NOT NULL ORDER BY resolved_at DESC, id LIMIT 500")
def _(s, d):
    from ledgerloom.sources.tables import load_labels

    return load_labels(queue(s, d), 500).select("id", "category")
