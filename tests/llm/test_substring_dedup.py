import hashlib
import random
from collections import Counter

import pandas as pd

from ledgerloom.llm.substring_dedup import anchors, cut_repeats, kept_text, remove_repeats


def brute(rows, length):
    datas = [(t or "").encode() for _, t in rows]
    seen = Counter(d[p : p + length] for d in datas for p in range(len(d) - length + 1))
    out = []
    for (i, _), d in zip(rows, datas):
        gone = bytearray(len(d))
        for p in range(len(d) - length + 1):
            if seen[d[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(b for b, g in zip(d, gone) if not g)
        spans = sum(1 for p in range(len(d)) if gone[p] and (p == 0 or not gone[p - 1]))
        out.append((i, len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows, length, k):
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, rid int")
    return sorted(((None if pd.isna(r[0]) else int(r[0]), *r[1:]) for r in remove_repeats(df, length, k, 5).collect()), key=str)


def test_matches_brute_force(spark):
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, other = text(40), text(25)
    rows = [(0, None), (1, ""), (2, "short"), (3, "ab" * 300), (4, "a" * 500), (None, text(30))]
    rows += [(10 + i, text(r.randint(1, 60)) + r.choice(["", passage, other, passage[:90], passage[13:]]) + text(r.randint(0, 40))) for i in range(60)]
    whole = text(120)
    rows += [(100, whole), (101, whole), (102, whole[:300] + "X" + whole[300:]), (103, whole[50:] + passage + passage), (103, whole)]
    assert got(spark, rows, 60, 12) == brute(rows, 60)


def test_empty_table_and_very_long_text(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert remove_repeats(df).count() == 0
    r = random.Random(8)
    long = "".join(r.choice("abcdefgh ") for _ in range(1_400_000))
    cut = long[1_048_300:1_049_000]  # across the border of two spans
    out = got(spark, [(1, long), (2, "x" + cut + "y")], 400, 64)
    assert [x[2:4] for x in out] == [(700, 1), (700, 1)]


def test_anchors_deal_every_window():
    r = random.Random(9)
    for alphabet in ("ab", "abcdefghij", "a"):
        d = "".join(r.choice(alphabet) for _ in range(700)).encode()
        parts = list(anchors(d, 50, 8))
        at = 0
        for a, lo, n in parts:
            assert lo == at and lo + n - 1 <= a and a + 8 <= lo + 50
            at += n
        assert at == 651


def test_what_is_left_and_the_spans_are_given(spark):
    r = random.Random(11)
    passage = "".join(r.choice("abcdefg") for _ in range(80))
    rows = [(1, "first " + passage + " end"), (2, "é" + passage + "ü" + passage), (3, "clean"), (4, None)]
    # Two characters that begin with one byte: a match of bytes ends inside them.
    half = "z" * 5 + "".join(r.choice("hijk") for _ in range(70))
    rows += [(5, half + "\u00e9"), (6, half + "\u00e8")]
    cut = cut_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 60, 12, 5)
    got = {r.doc_id: r for r in cut.select("*", kept_text(cut["kept"]).alias("text")).collect()}
    assert {i: r.text for i, r in got.items()} == {1: "first  end", 2: "éü", 3: "clean", 4: "", 5: "\ufffd", 6: "\ufffd"}
    assert [tuple(x) for x in got[2].spans] == [(2, 82), (84, 164)] and bytes(got[5].kept) == b"\xa9" and got[3].spans == []
    for i, t in rows:
        data = bytearray((t or "").encode())
        for s in reversed(got[i].spans):
            del data[s.start : s.end]
        assert bytes(data) == bytes(got[i].kept) and got[i].n_bytes == len((t or "").encode())


def test_the_query_gives_the_text_with_its_digests(spark):
    from ledgerloom.llm.queries import op3_substring_dedup

    rows = op3_substring_dedup(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(rows) == len(texts) and any(r.n_removed for r in rows)
    for r in rows:
        data = texts[r.doc_id].encode()
        left, at = b"", 0
        for s in r.spans:
            left, at = left + data[at : s.start], s.end
        left += data[at:]
        assert r.text == left.decode("utf-8", "replace") and r.kept_sha256 == hashlib.sha256(left).hexdigest()
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(data), len(data) - len(left), len(r.spans))
