"""Queries over matching: rule layer, text, blocking, scores, assignment, grading of pairs."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from ledgerloom.functions import normalize as N
from ledgerloom.operators import block, grade, match_rule, reconcile as R, score, sinks, text
from ledgerloom.operators.frames import staged, work_dir
from ledgerloom.operators.validate import pair_invariants
from ledgerloom.plans.fixtures import LEDGER_SQL, QUEUE_SQL, ledger, queue, statement, transactions
from ledgerloom.sources import tables

Q = {}
THRESHOLD = 0.85


def q(name, sql=None):
    def put(f):
        Q[name] = (f, sql)
        return f

    return put


RULE_SQL = (
    LEDGER_SQL
    + """, li AS (SELECT *, row_number() OVER (PARTITION BY reference_code, amount, txn_date ORDER BY id) AS n FROM ledger WHERE reference_code IS NOT NULL),
se AS (SELECT *, row_number() OVER (PARTITION BY reference_code, amount, txn_date ORDER BY id) AS n FROM statement WHERE reference_code IS NOT NULL),
rule_pairs AS (SELECT li.id AS internal_id, se.id AS external_id, li.txn_date AS matched_on FROM li JOIN se USING (reference_code, amount, txn_date, n)),
ri AS (SELECT * FROM ledger WHERE id NOT IN (SELECT internal_id FROM rule_pairs)),
re AS (SELECT * FROM statement WHERE id NOT IN (SELECT external_id FROM rule_pairs))"""
)


def pairs_by_rule(s, d):
    return match_rule.rule_match(ledger(s, d), statement(s, d))


def residuals(s, d):
    """What the rules leave of both sides, written down: the operators after them read it more than once."""
    i, e = staged(ledger(s, d), "ledger"), staged(statement(s, d), "statement")
    p = staged(match_rule.rule_match(i, e), "pairs")
    return staged(match_rule.residual(i, p, "internal_id"), "rest"), staged(match_rule.residual(e, p, "external_id"), "rest")


@q("split_sides", f"WITH {LEDGER_SQL} SELECT (SELECT count(*) FROM ledger) AS internal, (SELECT count(*) FROM statement) AS external")
def _(s, d):
    i, e = match_rule.split_sides(transactions(s, d))
    return i.agg(F.count(F.lit(1)).alias("internal")).join(F.broadcast(e.agg(F.count(F.lit(1)).alias("external"))))


@q("quantise_amount", "SELECT o_orderkey AS k, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS amount FROM orders")
def _(s, d):
    from ledgerloom.plans.fixtures import table

    text_ = F.when(F.col("o_orderkey") >= 0, F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
    return table(s, d, "orders").select(F.col("o_orderkey").alias("k"), match_rule.quantise_amount(text_).cast("string").alias("amount"))


@q("match_key", f"WITH {LEDGER_SQL} SELECT id, reference_code AS ref, amount FROM statement WHERE reference_code IS NOT NULL")
def _(s, d):
    return match_rule.match_key(statement(s, d)).select("id", F.col("_ref").alias("ref"), F.col("_amount").alias("amount"))


@q("rule_match", f"WITH {RULE_SQL} SELECT internal_id, external_id, 1.0::DOUBLE AS confidence, 'RULE' AS match_type FROM rule_pairs")
def _(s, d):
    return pairs_by_rule(s, d)


@q("residual", f"WITH {RULE_SQL} SELECT id FROM ri UNION ALL SELECT id FROM re")
def _(s, d):
    i, e = residuals(s, d)
    return i.select("id").unionByName(e.select("id"))


@q("load_backlog", f"WITH {RULE_SQL}, {QUEUE_SQL} SELECT id, amount FROM transactions WHERE id NOT IN (SELECT internal_id FROM rule_pairs) AND id NOT IN (SELECT external_id FROM rule_pairs) AND id NOT IN (SELECT transaction_id FROM queue WHERE state IN ('OPEN', 'SUGGESTED')) ORDER BY txn_date, id LIMIT 500")
def _(s, d):
    return tables.load_backlog(transactions(s, d), pairs_by_rule(s, d), queue(s, d), 500).select("id", "amount")


TERMS_SQL = """words AS (SELECT id, list_filter(string_split(trim(regexp_replace(lower(description), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: length(x) >= 2) AS w FROM transactions),
grams AS (SELECT id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM words),
tf AS (SELECT id, term, count(*) AS tf FROM grams GROUP BY ALL),
idf AS (SELECT term, count(*) AS df, ln((1 + (SELECT count(*) FROM words WHERE len(w) > 0)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY 1),
raw AS (SELECT id, term, (1 + ln(tf)) * idf AS raw FROM tf JOIN idf USING (term)),
vec AS (SELECT id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY id)) AS w FROM raw)"""


@q("tfidf_fit", f"WITH {LEDGER_SQL}, {TERMS_SQL} SELECT term, df, round(idf, 6) AS idf FROM idf")
def _(s, d):
    return text.tfidf_fit(transactions(s, d)).select("term", "df", F.round("idf", 6).alias("idf"))


@q("tfidf_transform", f"WITH {LEDGER_SQL}, {TERMS_SQL} SELECT id, term, round(w, 6) AS w FROM vec")
def _(s, d):
    t = transactions(s, d)
    return text.tfidf_transform(t, text.tfidf_fit(t)).select("id", "term", F.round("w", 6).alias("w"))


def same_key(s, d):
    a, b = ledger(s, d).select("k", F.col("id").alias("internal_id")), statement(s, d).select("k", F.col("id").alias("external_id"))
    return a.join(b.hint("merge"), "k").select("internal_id", "external_id")


@q("pair_similarity", f"""WITH {LEDGER_SQL}, {TERMS_SQL}, p AS (SELECT l.id AS i, s.id AS e FROM ledger l JOIN statement s USING (k)),
dots AS (SELECT i, e, sum(a.w * b.w) AS dot FROM p JOIN vec a ON a.id = i JOIN vec b ON b.id = e AND b.term = a.term GROUP BY ALL)
SELECT p.i AS internal_id, p.e AS external_id, round(greatest(0, least(1, coalesce(dot, 0))), 5) AS similarity FROM p LEFT JOIN dots USING (i, e)""")
def _(s, d):
    t = transactions(s, d)
    v = staged(text.row_vectors(t, text.coded(text.tfidf_fit(t))), "vectors")
    return text.pair_similarity(same_key(s, d), v, v).select("internal_id", "external_id", F.round("similarity", 5).alias("similarity"))


@q("save_load_model")
def _(s, d):
    path = work_dir(s, "tfidf-model")
    text.save_model(text.tfidf_fit(transactions(s, d)), path)
    return text.load_model(s, path)


@q("cluster_texts")
def _(s, d):
    i, e = residuals(s, d)
    return text.cluster_texts(i.unionByName(e))


def rest(s, d):
    i, e = residuals(s, d)
    return i.unionByName(e)


@q("flag_outliers")
def _(s, d):
    return text.flag_outliers(rest(s, d))


@q("isolated_ids")
def _(s, d):
    t = rest(s, d)
    known = text.distinct_texts(t)
    known = (*known, staged(text.similar_texts(known[3], known[2], 0.6), "similar"))
    return text.isolated_ids(text.cluster_texts(t, known=known), text.flag_outliers(t, known=known))


# All texts: SQL would join every two that share a word, so the tests hold it against brute force. Pairs are between the first rows of
# different texts; the other rows of a text are tied to its first as copies.
@q("similar_texts")
def _(s, d):
    t = transactions(s, d)
    m = text.coded(text.tfidf_fit(t))
    return text.similar_rows(statement(s, d), m, 0.6).select("a", "b", F.round("cos", 5).alias("cos"), "copy")


@q("candidates_by_cluster")
def _(s, d):
    i, e = residuals(s, d)
    t = i.unionByName(e)
    m = text.coded(text.tfidf_fit(t))
    known = text.distinct_texts(t, m)
    v = staged(text.tfidf_transform(t, m), "vectors")
    return block.candidates_by_cluster(text.cluster_texts(t, known=known), i, e, v, v)


AMOUNT_SQL = """band AS (SELECT i.id AS internal_id, e.id AS external_id, i.txn_date AS idate, e.txn_date AS edate,
  row_number() OVER (PARTITION BY i.id ORDER BY abs(CAST(e.amount AS DOUBLE) - CAST(i.amount AS DOUBLE)), e.id) AS r
  FROM ri i JOIN re e ON CAST(e.amount AS DOUBLE) BETWEEN CAST(i.amount AS DOUBLE) - abs(CAST(i.amount AS DOUBLE)) * 0.2 AND CAST(i.amount AS DOUBLE) + abs(CAST(i.amount AS DOUBLE)) * 0.2 WHERE i.amount <> 0),
by_amount AS (SELECT internal_id, external_id FROM band WHERE r <= 10 AND abs(date_diff('day', idate, edate)) <= 20)"""


@q("candidates_by_amount", f"WITH {RULE_SQL}, {AMOUNT_SQL} SELECT * FROM by_amount")
def _(s, d):
    return block.candidates_by_amount(*residuals(s, d))


KEYS_SQL = """tok AS (SELECT id, unnest(list_distinct(list_transform(list_filter(string_split(trim(regexp_replace(lower(description), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: length(x) >= 4), lambda x: substr(x, 1, 8)))) AS block FROM (SELECT id, description FROM ri UNION ALL SELECT id, description FROM re)),
often AS (SELECT block FROM tok GROUP BY 1 HAVING count(*) <= greatest(1, floor(((SELECT count(*) FROM ri) + (SELECT count(*) FROM re)) * 0.10))),
keys AS (SELECT id, block FROM tok WHERE block IN (SELECT block FROM often))"""


@q("blocking_keys", f"WITH {RULE_SQL}, {KEYS_SQL} SELECT id, block FROM keys")
def _(s, d):
    i, e = residuals(s, d)
    return block.blocking_keys(i.select("id", "description").unionByName(e.select("id", "description")))


SHARE_SQL = """shared AS (SELECT DISTINCT i.id AS internal_id, e.id AS external_id, i.txn_date AS idate, e.txn_date AS edate FROM ri i JOIN keys ki ON ki.id = i.id JOIN keys ke ON ke.block = ki.block JOIN re e ON e.id = ke.id
  WHERE i.amount > 0 AND CAST(e.amount AS DOUBLE) BETWEEN CAST(i.amount AS DOUBLE) * 0.05 AND CAST(i.amount AS DOUBLE) * 0.95),
wide AS (SELECT i.id AS internal_id, e.id AS external_id, i.txn_date AS idate, e.txn_date AS edate FROM ri i JOIN re e ON CAST(e.amount AS DOUBLE) BETWEEN CAST(i.amount AS DOUBLE) * 0.05 AND CAST(i.amount AS DOUBLE) * 0.95
  WHERE i.amount > 0 AND i.id NOT IN (SELECT internal_id FROM shared)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY internal_id ORDER BY abs(date_diff('day', idate, edate)), external_id) AS r FROM (SELECT * FROM shared UNION ALL SELECT * FROM wide)),
by_share AS (SELECT internal_id, external_id FROM ranked WHERE r <= 10 AND abs(date_diff('day', idate, edate)) <= 20)"""


@q("candidates_by_share", f"WITH {RULE_SQL}, {KEYS_SQL}, {SHARE_SQL} SELECT * FROM by_share")
def _(s, d):
    return block.candidates_by_share(*residuals(s, d))


@q("all_candidates", f"WITH {RULE_SQL}, {KEYS_SQL}, {AMOUNT_SQL}, {SHARE_SQL} SELECT * FROM by_amount UNION SELECT * FROM by_share")
def _(s, d):
    i, e = residuals(s, d)
    return block.all_candidates(block.candidates_by_amount(i, e), block.candidates_by_share(i, e))


JACCARD = "round(len(list_intersect(list_distinct(string_split(lower(l.description), ' ')), list_distinct(string_split(lower(s.description), ' ')))) / len(list_distinct(list_concat(string_split(lower(l.description), ' '), string_split(lower(s.description), ' ')))), 4)"
PARTS_SQL = f"""parts AS (SELECT l.id AS internal_id, s.id AS external_id, {JACCARD} AS c_description,
  CASE WHEN greatest(l.amount, s.amount) = 0 THEN 1.0 WHEN CAST(abs(l.amount - s.amount) AS DOUBLE) / CAST(greatest(l.amount, s.amount) AS DOUBLE) >= 0.2 THEN 0.0
    ELSE 1 - CAST(abs(l.amount - s.amount) AS DOUBLE) / CAST(greatest(l.amount, s.amount) AS DOUBLE) / 0.2 END AS c_amount,
  CASE WHEN abs(date_diff('day', l.txn_date, s.txn_date)) < 10 THEN 1 - abs(date_diff('day', l.txn_date, s.txn_date)) / 10 ELSE 0.0 END AS c_date,
  CASE WHEN l.reference_code IS NULL OR s.reference_code IS NULL THEN 0.5 WHEN l.reference_code = s.reference_code THEN 1.0 ELSE 0.0 END AS c_reference
  FROM ledger l JOIN statement s USING (k)),
scored AS (SELECT internal_id, external_id, round(c_description * 0.40 + c_amount * 0.35 + c_date * 0.15 + c_reference * 0.10, 4) AS confidence, 'ML' AS match_type, round(c_description, 4) AS c_description, round(c_amount, 4) AS c_amount, round(c_date, 4) AS c_date, round(c_reference, 4) AS c_reference FROM parts)"""


def _joined(s, d):
    side = lambda df, p: df.select("k", *[F.col(c).alias(f"{p}_{c}") for c in ("id", "amount", "txn_date", "description", "reference_code")])
    return side(ledger(s, d), "l").join(side(statement(s, d), "s").hint("merge"), "k")


@q("amount_proximity", f"WITH {LEDGER_SQL}, {PARTS_SQL} SELECT external_id, round(c_amount, 6) AS v FROM parts")
def _(s, d):
    return _joined(s, d).select(F.col("s_id").alias("external_id"), F.round(score.amount_proximity(F.col("l_amount"), F.col("s_amount")), 6).alias("v"))


@q("date_proximity", f"WITH {LEDGER_SQL}, {PARTS_SQL} SELECT external_id, round(c_date, 6) AS v FROM parts")
def _(s, d):
    return _joined(s, d).select(F.col("s_id").alias("external_id"), F.round(score.date_proximity(F.col("l_txn_date"), F.col("s_txn_date")), 6).alias("v"))


@q("reference_agreement", f"WITH {LEDGER_SQL}, {PARTS_SQL} SELECT external_id, CAST(c_reference AS DOUBLE) AS v FROM parts")
def _(s, d):
    return _joined(s, d).select(F.col("s_id").alias("external_id"), score.reference_agreement(F.col("l_reference_code"), F.col("s_reference_code")).alias("v"))


def scored_same_key(s, d):
    """Pairs of one order key, scored with token overlap for similarity; a ledger row with three legs has three."""
    p = _joined(s, d).select(F.col("l_id").alias("internal_id"), F.col("s_id").alias("external_id"), N.jaccard_tokens(F.col("l_description"), F.col("s_description")).alias("similarity"))
    return score.score_pairs(p, ledger(s, d), statement(s, d))


@q("score_pairs", f"WITH {LEDGER_SQL}, {PARTS_SQL} SELECT internal_id, external_id, CAST(confidence AS DOUBLE) AS confidence, match_type, c_description, CAST(c_amount AS DOUBLE) AS c_amount, CAST(c_date AS DOUBLE) AS c_date, CAST(c_reference AS DOUBLE) AS c_reference FROM scored")
def _(s, d):
    return scored_same_key(s, d)


@q("assign_one_to_one", f"WITH {LEDGER_SQL}, {PARTS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY internal_id ORDER BY confidence DESC, external_id) AS n FROM scored) SELECT internal_id, external_id, CAST(confidence AS DOUBLE) AS confidence FROM r WHERE n = 1")
def _(s, d):
    return score.assign_one_to_one(scored_same_key(s, d)).select("internal_id", "external_id", "confidence")


CONFIRMED_SQL = f"confidence >= {THRESHOLD} AND (c_amount >= 0.999 OR c_reference >= 0.999)"


@q("split_by_threshold", f"WITH {LEDGER_SQL}, {PARTS_SQL} SELECT external_id, {CONFIRMED_SQL} AS confirmed FROM scored")
def _(s, d):
    up, down = score.split_by_threshold(scored_same_key(s, d), THRESHOLD)
    return up.select("external_id", F.lit(True).alias("confirmed")).unionByName(down.select("external_id", F.lit(False).alias("confirmed")))


@q("best_near_miss", f"""WITH {LEDGER_SQL}, {PARTS_SQL}, below AS (SELECT * FROM scored WHERE NOT ({CONFIRMED_SQL})),
b AS (SELECT internal_id AS id, external_id AS other, confidence FROM below UNION ALL SELECT external_id, internal_id, confidence FROM below),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY confidence DESC, other DESC) AS n FROM b)
SELECT id, CAST(confidence AS DOUBLE) AS best_confidence, other AS best_counterpart_id FROM r WHERE n = 1""")
def _(s, d):
    return score.best_near_miss(score.split_by_threshold(scored_same_key(s, d), THRESHOLD)[1])


NOMINATED_SQL = f"""above AS (SELECT * FROM scored WHERE {CONFIRMED_SQL}),
free AS (SELECT * FROM scored WHERE internal_id NOT IN (SELECT internal_id FROM above) AND external_id NOT IN (SELECT external_id FROM above)),
nb AS (SELECT internal_id AS id, external_id AS other, confidence FROM free UNION ALL SELECT external_id, internal_id, confidence FROM free),
nominated AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY confidence DESC, other) AS rank FROM nb)"""


@q("nominations", f"WITH {LEDGER_SQL}, {PARTS_SQL}, {NOMINATED_SQL} SELECT id, other, CAST(confidence AS DOUBLE) AS confidence, rank FROM nominated")
def _(s, d):
    p = scored_same_key(s, d)
    return score.nominations(p, score.split_by_threshold(p, THRESHOLD)[0])


CO_SQL = """near AS (SELECT n.*, o.amount AS obligation, l.amount AS leg, max(confidence) OVER (PARTITION BY n.id) AS top FROM nominated n JOIN transactions o ON o.id = n.id JOIN transactions l ON l.id = n.other),
fit AS (SELECT *, leg > 0 AND obligation > 0 AND leg < obligation * 0.95 AS fits FROM near WHERE rank <= 6 AND confidence >= top * 0.80),
run AS (SELECT *, sum(CASE WHEN fits THEN leg ELSE 0 END) OVER (PARTITION BY id ORDER BY rank) AS running FROM fit),
stop AS (SELECT *, max(CASE WHEN fits AND running > obligation * 1.10 THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY rank) AS over FROM run),
co AS (SELECT id, list(other ORDER BY rank) FILTER (fits AND over = 0) AS legs, min_by(other, rank) AS best FROM stop GROUP BY id)"""


@q("co_settling", f"WITH {LEDGER_SQL}, {PARTS_SQL}, {NOMINATED_SQL}, {CO_SQL} SELECT id, CASE WHEN len(legs) >= 2 THEN legs ELSE [best] END AS candidate_ids FROM co")
def _(s, d):
    p = scored_same_key(s, d)
    n = score.nominations(p, score.split_by_threshold(p, THRESHOLD)[0])
    return score.co_settling(n, transactions(s, d).select("id", "amount"))


@q("unmatched_reasons", f"""WITH {LEDGER_SQL}, {PARTS_SQL}, above AS (SELECT * FROM scored WHERE {CONFIRMED_SQL}), below AS (SELECT * FROM scored WHERE NOT ({CONFIRMED_SQL})),
left_over AS (SELECT id FROM transactions WHERE id NOT IN (SELECT internal_id FROM above) AND id NOT IN (SELECT external_id FROM above))
SELECT CASE WHEN id IN (SELECT internal_id FROM below UNION ALL SELECT external_id FROM below) THEN 'below confidence threshold' ELSE 'no candidate counterpart' END AS reason, count(*) AS n FROM left_over GROUP BY 1""")
def _(s, d):
    p = scored_same_key(s, d)
    up, down = score.split_by_threshold(p, THRESHOLD)
    t = transactions(s, d)
    co = score.co_settling(score.nominations(p, up), t.select("id", "amount"))
    return score.unmatched_reasons(t.select("id"), up, score.best_near_miss(down), co, t.select("id").limit(0)).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@q("threshold_sweep", f"""WITH {LEDGER_SQL}, {PARTS_SQL}, t AS (SELECT unnest([0.5, 0.7, 0.85, 0.95]) AS threshold)
SELECT CAST(threshold AS DOUBLE) AS threshold, count(internal_id) AS confirmed, count(internal_id) AS correct, 0::BIGINT AS wrong FROM t LEFT JOIN scored ON confidence >= threshold AND (c_amount >= 0.999 OR c_reference >= 0.999) GROUP BY 1""")
def _(s, d):
    return score.threshold_sweep(scored_same_key(s, d), same_key(s, d), [0.5, 0.7, 0.85, 0.95])


@q("reconcile")
def _(s, d):
    r = R.reconcile(transactions(s, d))
    return r.pairs


@q("reconcile_summary", f"WITH {RULE_SQL} SELECT (SELECT count(*) FROM transactions) AS rows, count(*) AS pairs, (SELECT count(*) FROM transactions) - 2 * count(*) AS unmatched, count(*) AS rule, 0::BIGINT AS ml, least(1.0, round(2.0 * count(*) / (SELECT count(*) FROM transactions), 4))::DOUBLE AS match_rate FROM rule_pairs")
def _(s, d):
    return R.reconcile_summary(transactions(s, d), pairs_by_rule(s, d))


# The whole pass, with its pairs of both layers and the time it took.
@q("run_row")
def _(s, d):
    began = time.monotonic()
    r = R.reconcile(transactions(s, d), THRESHOLD)
    return sinks.run_row(R.reconcile_summary(r.inputs, staged(r.pairs, "pairs")), THRESHOLD, time.monotonic() - began)


# Receipts that several obligations claim, and wrong pairs among them: the sweep over what the pass itself assigned.
@q("threshold_sweep_of_pass")
def _(s, d):
    return score.threshold_sweep(R.reconcile(transactions(s, d), THRESHOLD).assigned, same_key(s, d), [0.5, 0.7, 0.85, 0.95])


@q("grade_pairs_of_pass")
def _(s, d):
    return grade.grade_pairs(R.reconcile(transactions(s, d), THRESHOLD).pairs, same_key(s, d))


@q("reconcile_unmatched")
def _(s, d):
    return R.reconcile(transactions(s, d)).unmatched


@q("reconcile_one_sided", f"WITH {LEDGER_SQL} SELECT id, 'no counterpart feed in this batch' AS reason FROM ledger")
def _(s, d):
    return R.reconcile(ledger(s, d)).unmatched.select("id", "reason")


# Rows alone in their cluster and far from all texts are told apart, on both sides: the pass's own reasons, counted.
@q("reconcile_reasons")
def _(s, d):
    return R.reconcile(transactions(s, d)).unmatched.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@q("reconcile_whole_summary")
def _(s, d):
    r = R.reconcile(transactions(s, d))
    return R.reconcile_summary(r.inputs, r.pairs)


@q("pair_invariants", f"WITH {RULE_SQL}, m AS (SELECT *, row_number() OVER (ORDER BY internal_id) AS _n, CAST(substr(internal_id, 5) AS BIGINT) AS k FROM rule_pairs) SELECT internal_id FROM m WHERE k % 7 IN (1, 3)")
def _(s, d):
    # Every seventh match has lost its counterpart, and every seventh unmatched row has one.
    k = F.substring("internal_id", 5, 20).cast("long") % 7
    p = pairs_by_rule(s, d).withColumn("status", F.when(k.isin(2, 3), "UNMATCHED").otherwise("MATCHED"))
    p = p.withColumn("external_id", F.when(~k.isin(1, 2), F.col("external_id"))).withColumn("match_type", F.when(k != 2, F.col("match_type")))
    return pair_invariants(p).select("internal_id")


@q("match_rows", f"WITH {RULE_SQL} SELECT internal_id, external_id, 'RULE' AS match_type, 1.0000::DECIMAL(5,4) AS confidence FROM rule_pairs")
def _(s, d):
    return sinks.match_rows(pairs_by_rule(s, d))


@q("ledger_postings", f"WITH {RULE_SQL} SELECT internal_id, external_id, internal_id AS transaction_id, 'DEBIT' AS entry_type, l.amount FROM rule_pairs JOIN ledger l ON l.id = internal_id UNION ALL SELECT internal_id, external_id, external_id, 'CREDIT', s.amount FROM rule_pairs JOIN statement s ON s.id = external_id")
def _(s, d):
    return sinks.ledger_postings(pairs_by_rule(s, d), transactions(s, d))


def unmatched(s, d):
    p = staged(scored_same_key(s, d), "scored")
    up, down = score.split_by_threshold(p, THRESHOLD)
    t = staged(transactions(s, d).select("id", "amount"), "rows")
    co = score.co_settling(score.nominations(p, up), t.select("id", "amount"))
    return score.unmatched_reasons(t.select("id"), up, score.best_near_miss(down), co, t.select("id").limit(0))


@q("exception_rows")
def _(s, d):
    return sinks.exception_rows(unmatched(s, d))


@q("exception_events")
def _(s, d):
    return sinks.events(sinks.exception_rows(unmatched(s, d)).select("id", "transaction_id"), "exception_created")


@q("grade_pairs", f"""WITH {RULE_SQL}, truth AS (SELECT l.id AS i, s.id AS e FROM ledger l JOIN statement s USING (k)), n AS (SELECT (SELECT count(*) FROM rule_pairs) AS said, (SELECT count(*) FROM truth) AS t, (SELECT count(*) FROM rule_pairs JOIN truth ON i = internal_id AND e = external_id) AS correct)
SELECT said, t AS true, correct, round(correct / said, 4) AS precision, round(correct / t, 4) AS recall FROM n""")
def _(s, d):
    return grade.grade_pairs(pairs_by_rule(s, d), same_key(s, d))


@q("grade_coverage", f"""WITH {LEDGER_SQL}, {PARTS_SQL}, {NOMINATED_SQL}, {CO_SQL}, c AS (SELECT id, unnest(CASE WHEN len(legs) >= 2 THEN legs ELSE [best] END) AS other FROM co)
SELECT CASE WHEN {CONFIRMED_SQL} THEN 'matched' WHEN c.id IS NOT NULL THEN 'nominated' ELSE 'lost' END AS outcome, count(*) AS n FROM scored s LEFT JOIN c ON c.id = s.internal_id AND c.other = s.external_id GROUP BY 1""")
def _(s, d):
    p = scored_same_key(s, d)
    up, _ = score.split_by_threshold(p, THRESHOLD)
    co = score.co_settling(score.nominations(p, up), transactions(s, d).select("id", "amount"))
    return grade.grade_coverage(same_key(s, d), up, co)


@q("accounting_check", f"WITH {LEDGER_SQL} SELECT count(*) AS rows, 0::BIGINT AS lost, 0::BIGINT AS twice FROM transactions")
def _(s, d):
    p = score.assign_one_to_one(scored_same_key(s, d))
    up, down = score.split_by_threshold(p, THRESHOLD)
    t = transactions(s, d)
    left = score.unmatched_reasons(t.select("id"), up, score.best_near_miss(down), score.co_settling(score.nominations(p, up), t.select("id", "amount")), t.select("id").limit(0))
    return grade.accounting_check(t, up, left)


@q("nomination_histogram", f"""WITH {LEDGER_SQL}, {PARTS_SQL}, {NOMINATED_SQL}, {CO_SQL}, below AS (SELECT * FROM scored WHERE NOT ({CONFIRMED_SQL})),
left_over AS (SELECT id FROM transactions WHERE id NOT IN (SELECT internal_id FROM above) AND id NOT IN (SELECT external_id FROM above)),
near_ids AS (SELECT DISTINCT internal_id AS id FROM below UNION SELECT external_id FROM below)
SELECT CASE WHEN near_ids.id IS NULL OR co.id IS NULL THEN 0 WHEN len(legs) >= 2 THEN len(legs) ELSE 1 END AS nominated, count(*) AS n FROM left_over LEFT JOIN co ON co.id = left_over.id LEFT JOIN near_ids ON near_ids.id = left_over.id GROUP BY 1""")
def _(s, d):
    return grade.nomination_histogram(unmatched(s, d))
