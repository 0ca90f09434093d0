import hashlib
import random
import re

import numpy as np
import pandas as pd
import xxhash

from ledgerloom.llm.common import components
from ledgerloom.llm.exact_dedup import exact_dedup
from ledgerloom.llm.simhash import _links, bucket_masks, fingerprint, simhash_groups


def test_exact_dedup_edges(spark):
    rows = [(1, "Ab É"), (2, "aB É"), (3, "ab é"), (4, None), (5, ""), (6, "x"), (6, "x"), (None, "y"), (None, None)]
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, kept string")
    out = exact_dedup(df).toPandas()
    got = sorted((-1 if pd.isna(r.doc_id) else int(r.doc_id), -1 if pd.isna(r.keep_id) else int(r.keep_id), r.group_size, bool(r.kept)) for r in out.itertuples())
    assert got == [(-1, -1, 1, True), (-1, 5, 3, False), (1, 2, 2, False), (2, 2, 2, True), (3, 3, 1, True), (4, 5, 3, False), (5, 5, 3, True), (6, 6, 2, False), (6, 6, 2, True)]
    assert out[out.doc_id == 1].text_sha256.iloc[0] == hashlib.sha256("ab É".encode()).hexdigest()
    assert exact_dedup(df.limit(0)).count() == 0


def brute_fp(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    sh = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    fps = [brute_fp(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = sorted((find(i), find(j)), key=lambda k: rows[k][0])
                parent[b] = a
    return {(rows[i][0], f"{fps[i]:016x}", rows[find(i)][0]) for i in range(len(rows))}


def test_simhash_matches_brute_force(spark):
    r = random.Random(5)
    vocab = ["w%d" % i for i in range(300)] + ["É", "Ab"]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "ONE"), (5, "a b c d")]
    for base in range(40):
        w = [r.choice(vocab) for _ in range(r.choice([30, 200, 600]))]
        for k in range(r.choice([1, 1, 3, 8])):
            v = list(w)
            if k:
                v[r.randrange(len(v))] = "edit"
            rows.append((10 + 20 * base + k, " ".join(v)))
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, fp int")
    got = {tuple(x) for x in simhash_groups(df).collect()}
    assert got == brute_components(rows)
    assert simhash_groups(df.limit(0)).count() == 0


def test_bit_sliced_links_and_masks():
    r = np.random.default_rng(1)
    for n in (1, 5, 64, 65, 200):
        base = r.integers(0, 2**63, 3, dtype=np.uint64)
        fp = base[r.integers(0, 3, n)] ^ (np.uint64(1) << r.integers(0, 64, n).astype(np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, n).astype(np.uint64))
        bucket = np.sort(r.integers(0, 3, n))
        for radius in (0, 1, 3, 4, 6, 7):
            i, j = _links(fp, bucket, radius)
            want = {(a, b) for a in range(n) for b in range(a + 1, n) if bucket[a] == bucket[b] and int(fp[a] ^ fp[b]).bit_count() <= radius}
            assert set(zip(i.tolist(), j.tolist())) == want
    for n, radius in ((10, 4), (10**6, 4), (10**9, 4), (10**11, 4), (10**6, 6)):
        for _ in range(50):
            flips = r.choice(64, radius, replace=False)
            diff = sum(1 << int(b) for b in flips)
            assert any(diff & m == 0 for m in bucket_masks(n, radius))


def test_components_of_a_chain_and_hub(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 40)] + [(7, 7), (200, 199), (199, 200)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert all(got[i] == 100 for i in range(101, 161)) and all(got[i] == 1 for i in range(2, 40)) and got[200] == 199
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_fingerprint_of_long_text():
    t = "The quick É fox " * 5000
    assert fingerprint(t) == brute_fp(t)
