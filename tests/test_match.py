import random

from ledgerloom.operators import block, match_rule, reconcile, score, text
from ledgerloom.operators.validate import pair_invariants
from ledgerloom.plans.fixtures import transactions

TXN = "id string, source_type string, amount decimal(18,2), currency string, txn_date date, description string, reference_code string"


def txns(spark, rows):
    import datetime
    from decimal import Decimal

    return spark.createDataFrame([(i, s, None if a is None else Decimal(str(a)), "USD", datetime.date(2026, 1, d), t, r) for i, s, a, d, t, r in rows], TXN)


def test_rule_layer_pairs_one_to_one(spark):
    t = txns(spark, [("i1", "erp", 10, 1, "a", "REF-1"), ("i2", "erp", 10, 1, "a", "REF-1"), ("e1", "bank_api", 10, 1, "a", " REF-1 "), ("i3", "erp", 5, 1, "a", None), ("e3", "bank_api", 5, 1, "a", None), ("e4", "bank_api", 5, 1, "a", " ")])
    pairs, i, e = reconcile.rule_layer(t)
    assert [(p.internal_id, p.external_id) for p in pairs.collect()] == [("i1", "e1")]
    assert {r.id for r in i.collect()} == {"i2", "i3"} and {r.id for r in e.collect()} == {"e3", "e4"}


def one_by_one(rows):
    used, out = set(), set()
    for a, b, c in sorted(rows, key=lambda x: (-x[2], x[0], x[1])):
        if a not in used and b not in used:
            used |= {a, b}
            out.add((a, b))
    return out


def assigned(spark, rows, **kw):
    got = score.assign_one_to_one(spark.createDataFrame(rows, "internal_id string, external_id string, confidence double"), **kw)
    return {(x.internal_id, x.external_id) for x in got.collect()}


def test_greedy_assignment_equals_one_by_one(spark):
    r = random.Random(1)
    for n in (5, 40):
        pairs = list({(f"i{r.randrange(n)}", f"e{r.randrange(n)}"): None for _ in range(3 * n)})
        rows = [(a, b, round(r.random(), 2)) for a, b in pairs]
        assert assigned(spark, rows) == one_by_one(rows)


def test_a_long_chain_is_settled(spark):
    rows = [(f"i{k:03d}", f"e{k:03d}", k / 1000) for k in range(30)] + [(f"i{k:03d}", f"e{k + 1:03d}", k / 1000 + 0.0005) for k in range(29)]
    assert assigned(spark, rows, rounds=7) == one_by_one(rows)


def test_similar_texts_finds_every_pair(spark):
    r = random.Random(2)
    words = ["ab", "cd", "ef", "gh", "common", "ij", "kl"]
    rows = [(f"d{i}", " ".join(["common"] * r.randint(0, 1) + [r.choice(words) for _ in range(r.randint(1, 5))])) for i in range(60)]
    df = spark.createDataFrame(rows, "id string, description string")
    m = text.tfidf_fit(df)
    v = text.tfidf_transform(df, m)
    w = {}
    for x in v.collect():
        w.setdefault(x.id, {})[x.term] = x.w
    want = {(a, b) for a in w for b in w if a < b and sum(w[a][t] * w[b].get(t, 0) for t in w[a]) >= 0.6}
    assert {(x.a, x.b) for x in text.similar_texts(v, m, 0.6).collect()} == want
    clusters = {x.id: x.cluster for x in text.cluster_texts(df).collect()}
    assert all(clusters[a] == clusters[b] != "-1" for a, b in want)


def test_whole_vectors_are_joined_without_being_put_together_again(spark):
    from ledgerloom.operators.frames import staged

    r = random.Random(5)
    words = [f"w{k}" for k in range(12)] + ["common"] * 6
    kinds = sorted({" ".join(r.choice(words) for _ in range(r.randint(1, 6))) for _ in range(80)} | {"x", "alone here", " ".join(f"long{k} common" for k in range(300))})
    df = spark.createDataFrame([(f"d{i:03d}", t, t) for i, t in enumerate(kinds)], "id string, t string, description string")
    m = text.coded(text.tfidf_fit(df))
    made = text.text_vectors(text._dealt(df.select("id", "t"), "id"), m, "id")
    v = staged(made, "v")
    # Texts by key, terms and model by term, terms by key: counting the terms of a text moves nothing.
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 4
    w = {x.id: {y.term: y.w for y in x.vec} for x in v.collect()}
    assert len(w) == len(kinds) - 1  # a word of one letter is no term
    want = {(a, b) for a in w for b in w if a < b and sum(w[a][t] * w[b].get(t, 0) for t in w[a]) >= 0.6}
    got = text.similar_texts(v, m, 0.6)
    assert "collect_list" not in got._jdf.queryExecution().executedPlan().toString()
    assert want and {(x.a, x.b) for x in got.collect()} == want
    rows = text.similar_rows(df.unionByName(df.withColumn("id", text.F.concat("id", text.F.lit("-again")))), m, 0.6).collect()
    assert {(x.a, x.b) for x in rows if not x.copy} == want and {(x.a, x.b) for x in rows if x.copy} == {(f"d{i:03d}", f"d{i:03d}-again") for i in range(len(kinds))}


def test_co_settling_legs(spark):
    n = spark.createDataFrame([("o", "a", 0.8, 1), ("o", "b", 0.79, 2), ("o", "c", 0.78, 3), ("o", "d", 0.3, 4), ("p", "a", 0.8, 1), ("p", "x", 0.8, 2)], "id string, other string, confidence double, rank int")
    a = spark.createDataFrame([("o", 100.0), ("p", 100.0), ("a", 50.0), ("b", 30.0), ("c", 99.0), ("d", 10.0), ("x", 97.0)], "id string, amount double")
    got = {r.id: r.candidate_ids for r in score.co_settling(n, a).collect()}
    assert got == {"o": ["a", "b"], "p": ["a"]}


def test_whole_pass_accounts_for_every_row(spark):
    t = transactions(spark, "/root/testdata/sf0.001").where("k < 400")
    r = reconcile.reconcile(t)
    from ledgerloom.operators.grade import accounting_check, grade_pairs

    assert accounting_check(t, r.pairs, r.unmatched).first()[1:] == (0, 0)
    keys = t.select("k", "id")
    truth = keys.where("id LIKE 'ERP%'").join(keys.where("id LIKE 'BNK%'").withColumnRenamed("id", "external_id"), "k").withColumnRenamed("id", "internal_id")
    g = grade_pairs(r.pairs, truth).first()
    assert g.precision >= 0.99 and g.recall > 0.6


def test_bands_and_invariants(spark):
    i = txns(spark, [("i1", "erp", 100, 5, "acme corporation x", None), ("i2", "erp", 0, 5, "a", None), ("i3", "erp", None, 5, "a", None)])
    e = txns(spark, [("e1", "b", 80, 5, "acme corporation y", None), ("e2", "b", 120, 5, "z", None), ("e3", "b", 79.99, 5, "z", None), ("e4", "b", 100, 31, "z", None), ("e5", "b", 50, 5, "ACME CORPO", None), ("e6", "b", 50, 6, "other name", None)])
    assert {x.external_id for x in block.candidates_by_amount(i, e).collect()} == {"e1", "e2"}
    got = {(x.internal_id, x.external_id) for x in block.candidates_by_share(i, e).collect()}
    assert got and all(a == "i1" for a, _ in got)
    bad = pair_invariants(spark.createDataFrame([("MATCHED", "a", "b", "ML"), ("MATCHED", "a", None, "ML"), ("UNMATCHED", "a", "b", None), ("UNMATCHED", "a", None, None)], "status string, internal_id string, external_id string, match_type string"))
    assert bad.count() == 2


def test_reasons_of_outliers_and_of_one_side(spark):
    from ledgerloom.operators import score

    t = transactions(spark, "/root/testdata/sf0.001").where("k < 300").select(*[f.split()[0] for f in TXN.split(", ")])
    odd = txns(spark, [("ERP-odd", "erp", 12.34, 5, "zzyzx quixotic ephemera", None), ("BNK-odd", "bank_api", 98765.43, 5, "vermilion gnomon", None)])
    got = {r.id: r.reason for r in reconcile.reconcile(t.unionByName(odd)).unmatched.collect()}
    assert got["ERP-odd"] == got["BNK-odd"] == score.ISOLATED and {score.BELOW, score.ISOLATED} <= set(got.values())
    r = reconcile.reconcile(t.where("source_type = 'erp'"))
    assert r.pairs.count() == 0 and {x.reason for x in r.unmatched.collect()} == {score.ONE_SIDED} and r.unmatched.count() == t.where("source_type = 'erp'").count()


def test_shares_against_brute_force(spark):
    r = random.Random(9)
    names = ["acme corp", "globex inc", "initech llc", "umbrella"]
    side = lambda p, src, n: [(f"{p}{k}", src, round(r.uniform(1, 500), 2), r.randint(1, 28), r.choice(names) + r.choice(["", " alpha", " beta"]), None) for k in range(n)]
    rows_i, rows_e = side("i", "erp", 60), side("e", "bank_api", 60)
    got = {(x.internal_id, x.external_id) for x in block.candidates_by_share(txns(spark, rows_i), txns(spark, rows_e), days=6, nearest=3).collect()}
    keys = {x.id: set() for x in txns(spark, rows_i + rows_e).collect()}
    for x in block.blocking_keys(txns(spark, rows_i + rows_e)).collect():
        keys[x.id].add(x.block)
    want = set()
    for i in rows_i:
        band = [e for e in rows_e if i[2] * 0.05 <= e[2] <= i[2] * 0.95]
        shared = [e for e in band if keys[i[0]] & keys[e[0]]]
        best = sorted(shared or band, key=lambda e: (abs(i[3] - e[3]), e[0]))[:3]
        want |= {(i[0], e[0]) for e in best if abs(i[3] - e[3]) <= 6}
    assert got == want


def test_sweep_grades_and_triage_of_a_whole_pass(spark, monkeypatch):
    """Over the pass's own assignments and leftovers, not those that the fixture would have. The pass is made once."""
    from ledgerloom.plans import q_match, q_triage

    sf = "/root/testdata/sf0.001"
    whole = reconcile.reconcile(transactions(spark, sf))
    monkeypatch.setattr(reconcile, "reconcile", lambda *a: whole)
    monkeypatch.setattr(q_triage, "reconcile", lambda *a: whole)
    q = {n: f for m in (q_match, q_triage) for n, (f, _) in m.Q.items()}
    sweep = sorted(tuple(r) for r in q["threshold_sweep_of_pass"](spark, sf).collect())
    assert all(c == right + wrong for _, c, right, wrong in sweep) and [c for _, c, _, _ in sweep] == sorted((c for _, c, _, _ in sweep), reverse=True)
    run = q["run_row"](spark, sf).first()
    assert run.ml > 0 and run.duration_ms > 0 and run.pairs == run.rule + run.ml and run.rows == run.unmatched + 2 * run.pairs
    found = q["triage_of_unmatched"](spark, sf).collect()
    assert len(found) == run.unmatched == len({r.id for r in found}) and all(r.category and r.state == "SUGGESTED" for r in found)
