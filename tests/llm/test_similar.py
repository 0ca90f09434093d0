"""Groups of similar texts against brute force, and the pipeline's stages on rows that are easily mishandled."""

import random
import re

import numpy as np
import pytest

import corpus_pipeline as cp
from ledgerloom.llm import simhash
from ledgerloom.llm.simhash import nearest_links, similar_groups

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def like(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def brute(texts):
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [(i, j) for i in range(len(texts)) for j in range(i) if like(sets[i], sets[j]) >= 0.8]
    for i, j in links:
        a, b = sorted((find(i), find(j)))
        root[b] = a
    return [find(i) for i in range(len(texts))], links


def edited(r, words, n):
    """n words changed, each at a place of its own."""
    out = list(words)
    for k in r.sample(range(len(out)), n):
        out[k] = f"edit{r.randrange(10**6)}"
    return out


def corpus(r):
    texts = [None, "", " \n", "one two", "One Two", "one"]
    for _ in range(40):
        base = [f"w{r.randrange(5000)}" for _ in range(r.choice([20, 60, 200, 600]))]
        texts.append(" ".join(base))
        for _ in range(r.choice([0, 1, 3, 9])):
            texts.append(" ".join(edited(r, base, max(1, int(len(base) * r.choice([0.01, 0.015, 0.02, 0.03, 0.05]))))))
    return texts


def test_groups_of_planted_edits(spark):
    texts = corpus(random.Random(11))
    got = {x.rid: x.root for x in similar_groups(spark.createDataFrame(list(enumerate(texts)), "rid long, text string")).collect()}
    want, links = brute(texts)
    assert len(links) > 80 and len(got) == len(texts)
    found = sum(got[i] == got[j] for i, j in links)
    assert found >= 0.95 * len(links)
    # Nothing is joined that no chain of links joins.
    assert all(want[i] == want[j] for i in range(len(texts)) for j in range(i) if got[i] == got[j])
    assert similar_groups(spark.createDataFrame([], "rid long, text string")).count() == 0


def test_recall_on_the_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    got = {x.rid: x.root for x in similar_groups(spark.createDataFrame([(i, r.text) for i, r in enumerate(rows)], "rid long, text string")).collect()}
    want, links = brute([r.text for r in rows])
    assert sum(got[i] == got[j] for i, j in links) >= 0.95 * len(links) > 0
    assert sum(a != b for a, b in zip([want[got[i]] for i in range(len(rows))], want)) == 0


def test_nearest_links_keep_what_is_linked():
    r = np.random.default_rng(3)
    fp = np.repeat(r.integers(0, 2**63, 6, dtype=np.uint64), 20) ^ (np.uint64(1) << r.integers(0, 60, 120).astype(np.uint64)) ^ (np.uint64(1) << r.integers(0, 60, 120).astype(np.uint64))
    bucket = np.sort(r.integers(0, 2, 120))
    i, j = nearest_links(fp, bucket, 4)
    assert len(i) <= 3 * 120 and all(bucket[a] == bucket[b] for a, b in zip(i, j))
    label = list(range(120))
    for _ in range(120):
        for a, b in zip(i.tolist(), j.tolist()):
            label[a] = label[b] = min(label[a], label[b])
    for a in range(120):
        near = [b for b in range(120) if b != a and bucket[a] == bucket[b] and int(fp[a] ^ fp[b]).bit_count() <= 4]
        assert all(label[a] == label[b] for b in near)


NAMES = ["row", "ROW_", "_key", "_copy", "_base", "_rid", "_spans", "_words", "_found", "rid", "first", "root", "kept", "keep_id", "spans", "doc", "length"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(3, "beta mail a@b.example.org"), (5, "alpha"), (5, "BETA mail a@b.example.org"), (7, "Ab"), (7, "aB"), (None, "ab"), (None, None), (None, "some gamma"), (None, "delta text"), (8, ""), (9, "alpha"), (9, "alpha")]
    rows = [(i, t, "en", f"s{k}", len(t or ""), *([f"v{k}"] * len(NAMES))) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in NAMES))


def test_exact_goes_by_rows(spark, odd):
    out = cp.exact(spark, odd, SF)
    assert out.columns == odd.columns
    assert sorted(r.source for r in out.collect()) == ["s0", "s1", "s3", "s7", "s8", "s9"] or sorted(r.source for r in out.collect()) == ["s0", "s1", "s4", "s7", "s8", "s9"]
    assert all({r[n] for n in NAMES} == {"v" + r.source[1:]} for r in out.collect())


def test_every_stage_keeps_columns_and_edges(spark, odd):
    for name, stage in cp.STAGES:
        out = stage(spark, odd, SF)
        rows = out.collect()
        if name == "best-fit packing":
            assert len(rows) == odd.count()
            continue
        assert out.columns == odd.columns and out.dtypes == odd.dtypes
        assert all({r[n] for n in NAMES} == {"v" + r.source[1:]} for r in rows)
        if name == "SimHash near-dedup":
            # Case does not count in shingles either.
            assert sorted(r.source for r in rows if r.source not in ("s3", "s4")) == ["s0", "s1", "s7", "s8", "s9"] and len(rows) == 6
        if name == "PII":
            assert len(rows) == odd.count() and {r.text for r in rows if r.source in ("s0", "s2")} == {"beta mail [EMAIL]", "BETA mail [EMAIL]"}


def test_no_link_of_a_bucket_gives_way_to_nearer_ones_that_fail(spark):
    from ledgerloom.llm import simhash as S

    # 90 edited versions of one text, of which many are nearer in their fingerprints than in their shingles.
    r, similarity = random.Random(1), 0.8
    base = [f"w{r.randrange(900)}" for _ in range(60)]
    texts = []
    for _ in range(90):
        w = list(base)
        for p in r.sample(range(60), r.choice([1, 2, 3])):
            w[p] = f"x{r.randrange(900)}"
        texts.append(" ".join(w))
    hashes = [np.unique(S.shingle_hashes(t, 5)) for t in texts]
    keys = [S.least_shingles(h, 12, 4) for h in hashes]
    fps = [S.fingerprint(t, 5) for t in texts]
    sets = [set(h.tolist()) for h in hashes]
    links = [(i, j) for i in range(90) for j in range(i) if (keys[i] == keys[j]).any() and (fps[i] ^ fps[j]).bit_count() <= 22 and like(sets[i], sets[j]) >= similarity]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "rid long, text string")
    root = {x.rid: x.root for x in similar_groups(rows, similarity=similarity).collect()}
    assert links and not [(i, j) for i, j in links if root[i] != root[j]]


def test_ties_between_roots_are_few_and_those_of_all_pairs():
    r = np.random.default_rng(5)
    common = r.choice(1 << 30, 400, replace=False).astype("<u4")
    # 240 near copies in 12 roots; half of the roots are too far from all others to be linked.
    root = np.repeat(np.arange(100, 112), 20)
    sets = [np.unique(np.concatenate([common[: 400 if g % 2 else 250 + 5 * (g - 100)], r.choice(1 << 30, 20).astype("<u4")])) for g in root]
    fp, bucket = np.zeros(len(root), dtype=np.uint64), np.zeros(len(root), dtype=np.int64)
    alike = lambda a, b: len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b))
    parent = {int(g): int(g) for g in root}

    def top(g):
        while parent[g] != g:
            g = parent[g]
        return g

    for x in range(len(root)):
        for y in range(x):
            if root[x] != root[y] and alike(sets[x], sets[y]):
                a, b = sorted((top(int(root[x])), top(int(root[y]))))
                parent[b] = a
    u, v = simhash.ties_between(fp, root, sets, bucket, 22, 0.8)
    assert len(u) < 12
    assert {int(b): int(a) for a, b in zip(u, v)} == {g: top(g) for g in parent if top(g) != g}


def test_shared_counts_in_several_columns():
    r = np.random.default_rng(6)
    sets = [np.unique(r.choice(200, 80).astype("<u4")) for _ in range(30)]
    i, j = np.triu_indices(30, 1)
    assert simhash.shared_counts(sets, i, j, width=16).tolist() == [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j)]
