import hashlib
import re
import sys

from ledgerloom.llm.pii import bootstrap, pii_report, redact

sys.set_int_max_str_digits(0)
KINDS = ["email", "ip", "card", "phone"]
RX = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0


def ok(kind, m):
    n = sum(c.isdigit() for c in m)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.split(".")), "card": 12 <= n <= 19 and luhn(m), "phone": 9 <= n <= 15}[kind]


def brute(text):
    spans = sorted((m.start(), o, m.end(), k) for o, k in enumerate(KINDS) for m in re.finditer(RX[k], text or "") if ok(k, m.group()))
    return [sum(s[3] == k for s in spans) for k in KINDS], ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)


def test_base_spans_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = dict(docs.select("doc_id", "text").collect())
    out = pii_report(docs).collect()
    assert len(out) == len(texts)
    for r in out:
        counts, spans = brute(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts
        assert r.base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
        assert set(spans.split(",")) <= set(r.spans.split(","))


def test_edges(spark):
    texts = [
        None,
        "",
        "a@b.c_d@e.f @x.y a@b a@b. é😀 a.b+c@d-e.f.g,x@y..z",
        "1.2.3.4.5.6.7.8 256.1.1.1 0001.0.0.0255 1.2.3 00000000000000255.1.1.1 999999999999999999999.1.1.1",
        "4539 1488 0343 6467 4539148803436467 4539-1488-0343-6467-4539148803436467 0000000000000 1",
        "+1 (017) 555-7713 +12 +1-2-3-4-5-6-7-8-9 ++1234567890. +1 2345678901234567890",
        "9" * 60_000 + "." + "1.1" * 20_000,
        "a" * 800 + "@" + "b-" * 300 + " " + "a.b@" * 500,
        "1 2-3 " * 20_000,
    ]
    df = spark.createDataFrame([(i if i else None, t, "x", 0) for i, t in enumerate(texts)], "doc_id long, text string, spans string, _x int")
    out = {r.doc_id or 0: r for r in pii_report(df).collect()}
    for i, t in enumerate(texts):
        counts, spans = brute(t)
        r = out[i]
        assert ([r.n_email, r.n_ip, r.n_card, r.n_phone], r.spans) == (counts, spans), i
    assert pii_report(df.limit(0)).count() == 0


def test_very_long_runs(spark):
    texts = ["a" * 300_000 + "@" + "b-" * 100_000, "1" * 400_000, "+1" + " " * 300_000, "1-" * 200_000, "x@y" * 100_000]
    out = pii_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.spans for r in out} == {""}


def test_patterns_find_unseen_identifiers(spark):
    rows = [(i, f"some text mailto user{i}@host{i}.example.org and more") for i in range(40)]
    rows += [(100 + i, f"reach me: mailto someone{i}99999(at)host.org now") for i in range(3)]
    rows += [(200 + i, f"the {10**9 + i}x is a number, the user{i}@a.bc too") for i in range(30)]
    out = {r.doc_id: r for r in pii_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in range(3):
        assert out[100 + i].n_email == 0 and out[100 + i].spans == "email:17:%d" % (17 + len(f"someone{i}99999(at)host.org"))
    assert all(out[200 + i].spans.count("email") == 1 and "card" not in out[200 + i].spans for i in range(30))


def test_spaced_identifiers_and_contexts_of_a_third_unknown(spark):
    phone = lambda i: f"+1 (555) {100 + i}-{2000 + i}"
    rows = [(i, f"some words, call me: {phone(i)} today") for i in range(30)]
    rows += [(100 + i, f"again words, call me: (555) {300 + i}-{4000 + i} today") for i in range(15)]  # no plus: not a base span
    rows += [(200 + i, f"room {10000 + i} is free") for i in range(40)] + [(300 + i, f"the {20000 + i} of them and the {phone(50 + i)} too") for i in range(30)]
    rows += [(400, "call me: (555) 999-0000\ntoday"), (401, "call me: 12 today"), (402, "pay with card 4539 1488 0343 6467 now")]
    out = {r.doc_id: r for r in pii_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in range(15):
        m = f"(555) {300 + i}-{4000 + i}"
        at = rows[30 + i][1].index(m)
        assert out[100 + i].n_phone == 0 and out[100 + i].n_added == 1 and out[100 + i].spans == f"phone:{at}:{at + len(m)}"
    assert out[400].spans == "phone:9:23" and out[401].spans == "" and out[402].n_card == 1
    # Places where most that is seen is unknown, or no known one is, add nothing.
    assert all(out[200 + i].spans == "" for i in range(40)) and all(out[300 + i].n_added == 0 for i in range(30))


def brute_bootstrap(seen, rounds=3, least=5, sure=0.75, unknown=0.5):
    edges = {}
    for m, seed, pattern in seen:
        edges[pattern, m] = max(filter(None, (seed, edges.get((pattern, m)))), default=None)
    score = {}
    for _ in range(rounds):
        conf = {}
        for pattern in {p for p, _ in edges}:
            own = [(m, s) for (p, m), s in edges.items() if p == pattern]
            for k in KINDS:
                top = sum(1.0 if s == k else 0.0 if s else score.get((m, k), 0.0) for m, s in own)
                weight = sum(1.0 if s else score.get((m, k), unknown) for m, s in own)
                if sum(s == k for _, s in own) >= least and top / weight >= sure:
                    conf[pattern, k] = top / weight
        score = {}
        for (p, m), s in edges.items():
            for k in KINDS:
                if s is None and (p, k) in conf:
                    score[m, k] = max(score.get((m, k), 0), conf[p, k])
    best = {}
    for (m, k), v in score.items():
        best[m] = max(best.get(m, (0, "")), (v, k))
    return {(m, k, round(v, 9)) for m, (v, k) in best.items()}


def test_rounds_of_the_bootstrap(spark):
    import random

    r = random.Random(6)
    seen = [(f"m{i}", r.choice(KINDS + [None] * 3), f"p{min(r.randrange(12), r.randrange(12))}") for i in range(120) for _ in range(r.randint(1, 3))]
    seen += [(f"q{i}", "phone" if i < 8 else None, "only") for i in range(11)] + [(f"q{i}", None if i >= 8 else "phone", "then") for i in range(3, 12)]
    df = spark.createDataFrame(seen, "m string, seed string, pattern string")
    for rounds in (1, 2, 4):
        got = {(x.m, x.kind, round(x.score, 9)) for x in bootstrap(df, rounds).collect()}
        assert got == brute_bootstrap(seen, rounds) and got


def test_many_spans_in_one_text(spark):
    text = " ".join(f"user{i}@host.org, {i}.2.3.4;" for i in range(3000))
    out = pii_report(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    counts, spans = brute(text)
    assert ([out.n_email, out.n_ip, out.n_card, out.n_phone], out.spans) == (counts, spans)
    assert redact(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().text.count("[EMAIL]") == 3000


def test_redact(spark):
    df = spark.createDataFrame([(1, "é a@b.co, 1.2.3.4!", 18, "k"), (2, "clean", 5, "k"), (3, None, 0, None), (4, "+1 234 567 89 01 23", 19, "k")], "doc_id long, text string, n_chars long, source string")
    out = {r.doc_id: r for r in redact(df).collect()}
    assert redact(df).columns == df.columns
    assert out[1].text == "é [EMAIL], [IP]!" and out[1].n_chars == 16 and out[2].text == "clean" and out[3].text is None
    assert out[4].text == "[PHONE]"
