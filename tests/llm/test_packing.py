import bisect
import json
import random
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
from tokenizers import Tokenizer

from ledgerloom.llm.packing import best_fit, byte_level, encode, pack, sweep

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_ids_are_those_of_tokenizers():
    r = random.Random(1)
    texts = ["", " ", "<|endoftext|> a<|endoftext|>", "it's I'LL  \n\n x"] + ["".join(r.choice(" \n\t'sa1é!ñß漢　\u0085<|endoftext|>") for _ in range(80)) for _ in range(500)]
    hf = Tokenizer.from_file(PATH)
    assert [e.ids for e in hf.encode_batch(texts, add_special_tokens=False)] == [encode(PATH, t) for t in texts]


def test_files_of_other_kinds_go_through_tokenizers(tmp_path):
    """Each change makes ids differ from those of the byte-level pattern; the file decides."""
    spec = json.load(open(PATH, encoding="utf-8"))
    assert byte_level(spec)
    changes = {
        "blank": {"pre_tokenizer": spec["pre_tokenizer"] | {"add_prefix_space": True}},
        "digits": {"pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Digits", "individual_digits": True}, spec["pre_tokenizer"]]}},
        "lower": {"normalizer": {"type": "Lowercase"}},
        "order": {"model": spec["model"] | {"merges": spec["model"]["merges"][::-1]}},
    }
    text = "The year 2024 and SOME words"
    for name, change in changes.items():
        path = str(tmp_path / f"{name}.json")
        json.dump(spec | change, open(path, "w", encoding="utf-8"))
        assert not byte_level(spec | change)
        ids = encode(path, text)
        assert ids == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids != encode(PATH, text), name


def check(out: pd.DataFrame, texts: dict, capacity: int):
    hf = Tokenizer.from_file(PATH)
    for doc_id, text in texts.items():
        ids = np.array([*hf.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        own = out[out.doc_id == doc_id].sort_values("piece")
        assert own.length.sum() == len(ids) and list(own.piece) == list(range(len(own)))
        for p in own.itertuples():
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
        assert list(own.start) == [0, *own.length.cumsum()[:-1]]
        assert (own.length[1:] == capacity).all()
    for _, seq in out.sort_values("offset").groupby("sequence_id"):
        assert list(seq.offset) == [0, *seq.length.cumsum()[:-1]] and seq.length.sum() <= capacity
    return out.sequence_id.nunique(), -(-int(out.length.sum()) // capacity)


def test_pack_is_gapless_and_whole(spark):
    r = random.Random(2)
    texts = {i: " ".join(r.choice(["ab", "the", "xyzzy", "longerword"]) for _ in range(r.choice([0, 1, 5, 60, 200, 900]))) for i in range(200)}
    texts[500], texts[501] = None, "word " * 9000
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in texts.items()], "doc_id long, text string, length string, piece int")
    n, least = check(pack(df, PATH, 256).toPandas(), texts, 256)
    assert n <= least * 1.05 + 1


def test_pack_of_nothing_and_of_repeats(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pack(empty, PATH).count() == 0
    same = spark.createDataFrame([(1, "a b c")] * 50, "doc_id long, text string")
    out = pack(same, PATH, 16).toPandas()
    assert len(out) == 50 and out.groupby("sequence_id").length.sum().max() <= 16
    assert out.sequence_id.nunique() == 13


def stack_sweep(gaps: list[int], lengths: list[int]) -> list[tuple[int, int]]:
    """(length, gap) of a sweep, one by one."""
    out, held, gaps = [], [], sorted(gaps, reverse=True)
    for n in sorted(lengths, reverse=True):
        while gaps and gaps[0] >= n:
            held.append(gaps.pop(0))
        if held:
            out.append((n, held.pop()))
    return out


def test_sweep_is_that_of_a_stack(spark):
    r = random.Random(3)
    for most in (3, 40, 2048):
        gaps, lengths = [r.randint(1, most) for _ in range(300)], [r.randint(1, most) for _ in range(400)]
        rows = [(0, i, g, g) for i, g in enumerate(gaps)] + [(1, i, n, None) for i, n in enumerate(lengths)]
        out = sweep(spark.createDataFrame(rows, "kind int, id long, size int, gap int"), 3).toPandas()
        assert len(out) == len(rows)
        took = out[(out.kind == 1) & out.seq.notna()]
        assert took.seq.is_unique
        assert sorted((int(n), gaps[int(s)]) for n, s in zip(took["size"], took.seq)) == sorted(stack_sweep(gaps, lengths))
        got = out[(out.kind == 0) & out.got.notna()]
        assert {int(i): int(n) for i, n in zip(got.id, got.got)} == {int(s): int(n) for n, s in zip(took["size"], took.seq)}


def plain_best_fit(lengths: list[int], capacity: int) -> int:
    """Number of sequences that best fit one by one, from large to small, needs."""
    gaps: list[int] = []
    for n in sorted(lengths, reverse=True):
        at = bisect.bisect_left(gaps, n)
        gap = gaps.pop(at) if at < len(gaps) else capacity
        bisect.insort(gaps, gap - n)
    return len(gaps)


def test_best_fit_against_one_by_one(spark):
    r = random.Random(4)
    cases = [[r.randint(1, 128) for _ in range(500)], [r.choice([128, 65, 64, 3]) for _ in range(500)], [7] * 400, [min(128, int(r.expovariate(1 / 20)) + 1) for _ in range(800)]]
    for lengths in cases:
        pieces = spark.createDataFrame(list(enumerate(lengths)), "pid long, length long")
        out = best_fit(pieces, 128).toPandas()
        assert sorted(out.pid) == list(range(len(lengths)))
        out["length"] = [lengths[i] for i in out.pid]
        for _, seq in out.sort_values("offset").groupby("sequence_id"):
            assert list(seq.offset) == [0, *seq.length.cumsum()[:-1]] and seq.length.sum() <= 128
        assert out.sequence_id.nunique() <= plain_best_fit(lengths, 128) * 1.02 + 1


def test_few_long_and_many_short_pieces(spark):
    lengths = [64] + [2] * 900
    out = best_fit(spark.createDataFrame(list(enumerate(lengths)), "pid long, length long"), 128).toPandas()
    assert len(out) == 901 and out.sequence_id.nunique() <= plain_best_fit(lengths, 128) * 1.02 + 1


def test_null_ids_are_packed_too(spark):
    rows = [(None, "a b c"), (None, None), (7, ""), (7, "x " * 40)]
    out = pack(spark.createDataFrame(rows, "doc_id long, text string"), PATH, 16).toPandas()
    hf = Tokenizer.from_file(PATH)
    assert out.length.sum() == sum(len(hf.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    assert out.doc_id.isna().sum() == 2 and out.groupby("sequence_id").length.sum().max() <= 16
    for _, seq in out.sort_values("offset").groupby("sequence_id"):
        assert list(seq.offset) == [0, *seq.length.cumsum()[:-1]]
