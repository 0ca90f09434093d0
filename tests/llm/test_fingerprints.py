import hashlib
import random
import re

import pytest
import xxhash

from pyspark.sql import functions as F

from ledgerloom.llm.fingerprints import WORDS, _signed, compare_with_edits, differing


def units(text):
    return {u.rstrip(" ") for line in text.split("\n") for w in [re.findall(r"\S+\s*", line)] for i in range(0, len(w), WORDS) for u in ["".join(w[i : i + WORDS])]}


def like(a, b):
    a, b = units(a), units(b)
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def brute(rows):
    signed = lambda r: (lambda h: h - (1 << 64) if h >> 63 else h)(xxhash.xxh64_intdigest(r[1].encode(), xxhash.xxh64_intdigest(("none" if r[0] is None else str(r[0])).encode(), 42)))
    ring = sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is None, -(r[0] or 0), signed(r)))
    out = []
    for i, t in rows:
        t = t or ""
        nxt = ring[(ring.index((i, t)) + 1) % len(ring)][1]
        third = len(t) // 3
        edited = t[: len(t) - third] + nxt[:third]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), like(t, edited), like(t, nxt)))
    return sorted(out, key=str)


M64 = (1 << 64) - 1


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def parse(text):
    tables, _, rest = text.partition(":")
    cells = [tuple(signed(int(p, 16)) for p in c.split(".")) if c else (0, 0, 0) for c in rest.split("-")]
    assert len(cells) == 24 * int(tables)
    return int(tables), cells


def digest(x, seed):
    """Spark's xxhash64(x, seed): the seed is a second column, of four bytes."""
    return xxhash.xxh64_intdigest(seed.to_bytes(4, "little"), xxhash.xxh64_intdigest((x & M64).to_bytes(8, "little"), 42))


def recovered(a, b):
    """How many digests two printed sketches differ in: folded, subtracted and peeled, from the strings alone. None if that fails."""
    (ta, a), (tb, b) = parse(a), parse(b)
    t = min(ta, tb)
    out = [[0, 0, 0] for _ in range(24 * t)]
    for cells, sign in ((a, 1), (b, -1)):
        for i, (c, x, y) in enumerate(cells):
            cell = out[i // 24 % t * 24 + i % 24]
            cell[0] += sign * c
            cell[1] ^= x & M64
            cell[2] ^= y & M64
    n, rows = 0, True
    while rows:
        rows = {c[1]: c[0] for c in out if abs(c[0]) == 1 and c[2] == digest(c[1], 17)}
        for x, c in rows.items():
            n += 1
            h = digest(x, 0)
            for j in range(3):
                cell = out[(signed(x) >> 8) % t * 24 + 8 * j + (h >> 20 * j & 0xFFFFF) % 8]
                cell[0] -= c
                cell[1] ^= x
                cell[2] ^= digest(x, 17)
    return None if any(map(any, out)) else n


def entries(text):
    return sum(c for c, _, _ in parse(text)[1]) // 3


def test_likeness_is_that_of_the_returned_strings(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = compare_with_edits(docs).collect()
    prints = {r.doc_id: r.fingerprint for r in rows}
    seen = 0
    for r in rows:
        for other, near, tries in ((r.edited_fingerprint, r.near_edited, r.tries_edited), (prints[r.next_doc_id], r.near_next, r.tries_next)):
            if tries == 0:
                d = recovered(r.fingerprint, other)
                n = entries(r.fingerprint) + entries(other)
                assert d is not None and near == pytest.approx((n - d) / (n + d) if n else 1.0)
                seen += 1
    assert seen > 1.25 * len(rows) and sum(r.tries_edited == 0 for r in rows) > 0.9 * len(rows)
    assert len({r.fingerprint for r in rows}) > 0.7 * len(rows)


def test_against_sets(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdé😀") for _ in range(r.randint(1, 5)))
    rows = [(i * 3, "\n".join(" ".join(word() for _ in range(r.randint(0, 30))) for _ in range(r.randint(0, 12)))) for i in range(60)]
    rows += [(500, None), (501, ""), (502, "one"), (503, " \n "), (None, "null id"), (504, "same"), (504, "same"), (504, "other")]
    rows += [(600, " ".join(word() for _ in range(6000)))]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, k int")
    out = compare_with_edits(df).collect()
    got = sorted(((x.doc_id, x.n_chars, x.edited_sha256, x.near_edited, x.near_next) for x in out), key=str)
    for g, w in zip(got, brute(rows), strict=True):
        assert g[:3] == w[:3] and g[3:] == pytest.approx(w[3:])
    prints = {}
    for x in out:
        prints.setdefault((x.doc_id, x.n_chars), set()).add(x.fingerprint)
    assert len(prints[504, 4]) == 1 and prints[500, 0] == prints[501, 0] == prints[503, 3]
    assert compare_with_edits(df.limit(0)).count() == 0
    assert {d for (d,) in spark.createDataFrame([([1, 2, 3], [3, 4]), ([7], [7])], "a array<long>, b array<long>").select(differing(_signed(F.col("a"), F.col("b")))).collect()} == {3, 0}
    one = compare_with_edits(df.where("doc_id = 502")).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"ono").hexdigest()


def test_very_long_texts_take_time_in_step_with_their_length(spark):
    """300,000 words: some 12,500 paragraphs, alike but for what was edited, and dealt over thousands of subtables."""
    import time

    r = random.Random(6)
    text = " ".join(f"{r.randrange(10**6)}" for _ in range(300_000))
    rows = [(2, text), (1, "other " + text[: len(text) // 2])]
    began = time.time()
    out = {x.doc_id: x for x in compare_with_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert time.time() - began < 90
    for i, n, sha, edited, following in brute(rows):
        assert (out[i].n_chars, out[i].edited_sha256) == (n, sha) and (out[i].near_edited, out[i].near_next) == pytest.approx((edited, following))
    assert entries(out[2].fingerprint) == len(units(text)) and out[2].tries_edited in (0, 1)  # recovered from sketches
