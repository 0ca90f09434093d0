import zlib

import numpy as np
import pytest

from ledgerloom.llm import language_id, toxicity
from ledgerloom.llm.language_id import ByteGRU, identify
from ledgerloom.llm.queries import op5_language_id, op9_toxicity
from ledgerloom.llm.toxicity import KneserNey

SF = "/root/testdata/sf0.01"


def bucket(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_gradients_match_differences():
    m = ByteGRU(["a", "b", "c"], hidden=3)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    x = np.random.default_rng(0).integers(97, 103, (5, 4))
    y = np.array([0, 1, 2, 0])
    _, g = m.gradients(x, y)
    for k in m.p:
        i = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        old, e = m.p[k][i], 1e-4
        m.p[k][i] = old + e
        up = m.gradients(x, y)[0]
        m.p[k][i] = old - e
        down = m.gradients(x, y)[0]
        m.p[k][i] = old
        assert g[k][i] == pytest.approx((up - down) / (2 * e), rel=1e-2, abs=1e-4)


def test_pooling_is_the_plain_network(spark):
    m = ByteGRU(["a", "b"], hidden=3, seed=1)
    texts = [b"x", b"hello there", b"", b"z" * 700]
    got = m.pooled(texts)
    for t, row in zip(texts, got):
        want = np.zeros(2)
        for lo in range(0, len(t), language_id.STRETCH):
            part = np.frombuffer(t[lo : lo + language_id.STRETCH], dtype=np.uint8).astype(int)[:, None]
            h, f, b = np.zeros((3, 1), np.float32), [], []
            for k in part:
                h = m._step("f", k, h)[-1]
                f.append(h)
            h = np.zeros((3, 1), np.float32)
            for k in part[::-1]:
                h = m._step("b", k, h)[-1]
                b.append(h)
            for hf, hb in zip(f, b[::-1]):
                q = np.exp(m.p["V"] @ np.concatenate([hf, hb]) + m.p["c"])[:, 0]
                want += q / q.sum()
        assert np.allclose(row, want / max(len(t), 1), atol=1e-4)


def test_language_held_out_accuracy(spark):
    out = op5_language_id(spark, SF).toPandas()
    lang = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas()
    both = out.merge(lang, on="doc_id")
    assert len(out) == len(lang) and (both.held_out == [bucket(i, 3) == 1 for i in both.doc_id]).all()
    held = both[both.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.97 and both.score.between(0, 1).all()


def test_language_edges(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "12 !?", "x"), (None, "abc", "x"), (4, "é" * 50_000, "x"), (4, "abc", "x")], "doc_id long, text string, score string")
    assert {(r.doc_id, r.lang_pred, r.score) for r in identify(df, None).collect()} == {(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0), (None, "und", 0.0), (4, "und", 0.0)}
    got = [(r.doc_id, r.lang_pred) for r in identify(df, ByteGRU(["only"])).collect()]
    assert got == [(1, "und"), (2, "und"), (3, "und"), (None, "only"), (4, "only"), (4, "only")]
    assert language_id.train(spark.createDataFrame([], "doc_id long, text string, lang string")) is None


def test_toxicity_held_out(spark):
    out = op9_toxicity(spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    assert len(out) == 1000 and ((out.score >= 0.3) == (out.predicted == 1)).all() and out.score.between(0, 1).all()
    assert (out.held_out == [bucket(i, 4) == 2 for i in out.doc_id]).all()
    held = out[out.held_out].merge(labels, on="doc_id")
    pos, neg = held[held.toxic == 1].score.to_numpy(), held[held.toxic == 0].score.to_numpy()
    assert (pos[:, None] > neg[None, :]).mean() > 0.75
    assert (neg >= 0.3).mean() < 0.08


def test_toxicity_models_are_distributions_and_edges(spark):
    r = np.random.default_rng(2)
    docs = [[f"w{k}" for k in r.integers(0, 12, 40)] for _ in range(30)]
    lm = KneserNey(docs[:10], docs[10:], least=1, every=True)
    for c in (0, 1):
        assert lm.uni[c].sum() == pytest.approx(1)
        for u in range(1, lm.n):
            own = lm.keys[c] // lm.n == u
            assert lm.values[c][own].sum() + lm.back[c][u] == pytest.approx(1)
    model = toxicity.Toxicity(lm, np.zeros(4), np.ones(4), np.array([0.1, 1, 1, 1, 1]))
    df = spark.createDataFrame([(1, None, 7), (None, "", 7), (2, "w1 " * 9000, 7)], "doc_id long, text string, predicted int")
    got = toxicity.score(df, model).collect()
    assert len(got) == 3 and got[0].score == got[1].score
    assert toxicity.train(df.limit(0), spark.createDataFrame([], "doc_id long, toxic int")) is None
    assert all(x.score == 0 for x in toxicity.score(df, None).collect())
