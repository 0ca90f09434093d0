"""Language identification by a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASCII_LETTER = re.compile("[A-Za-z]")
HIDDEN = 8
#: Bytes that the recurrent state runs over; longer texts are read in as many stretches as they need.
STRETCH = 256
ROWS = 2048


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class ByteGRU:
    """Two gated recurrent layers, one from each end, and a softmax over languages at every byte.

    Arrays have features first and the batch last, so every gate is one contiguous block.
    """

    def __init__(self, classes: list[str], hidden: int = HIDDEN, seed: int = 7):
        r = np.random.default_rng(seed)
        f = lambda *s, scale: (r.standard_normal(s) * scale).astype(np.float32)
        self.classes, self.h = classes, hidden
        self.p = {}
        for d in "fb":
            self.p["E" + d] = f(3 * hidden, 256, scale=0.3)  # input weights and bias of each byte
            self.p["U" + d] = f(3 * hidden, hidden, scale=0.3)
        self.p["V"] = f(len(classes), 2 * hidden, scale=0.3)
        self.p["c"] = np.zeros((len(classes), 1), dtype=np.float32)

    def _step(self, d: str, x: np.ndarray, h: np.ndarray):
        n = self.h
        a = self.p["E" + d].take(x, axis=1)
        u = self.p["U" + d] @ h
        zr = _sigmoid(a[: 2 * n] + u[: 2 * n])
        z, r = zr[:n], zr[n:]
        new = np.tanh(a[2 * n :] + r * u[2 * n :])
        return z, r, u[2 * n :], new, new + z * (h - new)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Backpropagation through time. x: (steps, batch) bytes, y: (batch) classes."""
        steps, batch = x.shape
        n, p = self.h, self.p
        saved, states = {}, {}
        for d in "fb":
            h = np.zeros((n, batch), dtype=np.float32)
            order = range(steps) if d == "f" else range(steps - 1, -1, -1)
            for t in order:
                out = self._step(d, x[t], h)
                saved[d, t] = (h, *out)
                h = out[-1]
                states[d, t] = h
        g = {k: np.zeros_like(v) for k, v in p.items()}
        one = np.zeros((len(self.classes), batch), dtype=np.float32)
        one[y, np.arange(batch)] = 1
        loss, back = 0.0, {}
        scale = np.float32(1 / (steps * batch))
        for t in range(steps):
            both = np.concatenate([states["f", t], states["b", t]])
            logits = p["V"] @ both + p["c"]
            logits -= logits.max(axis=0)
            q = np.exp(logits)
            q /= q.sum(axis=0)
            loss -= float(np.log(q[y, np.arange(batch)] + 1e-9).mean()) / steps
            e = (q - one) * scale
            g["V"] += e @ both.T
            g["c"] += e.sum(axis=1, keepdims=True)
            back[t] = p["V"].T @ e
        for d in "fb":
            dh = np.zeros((n, batch), dtype=np.float32)
            da_all = np.zeros((steps, 3 * n, batch), dtype=np.float32)
            order = range(steps - 1, -1, -1) if d == "f" else range(steps)
            for t in order:
                h0, z, r, un, new, _ = saved[d, t]
                dh = dh + back[t][:n] if d == "f" else dh + back[t][n:]
                dn = dh * (1 - z) * (1 - new * new)
                da = da_all[t]
                da[:n] = dh * (h0 - new) * z * (1 - z)
                da[n : 2 * n] = dn * un * r * (1 - r)
                da[2 * n :] = dn
                du = da.copy()
                du[2 * n :] = dn * r
                g["U" + d] += du @ h0.T
                dh = dh * z + p["U" + d].T @ du
            flat = x.ravel()
            for k in range(3 * n):
                g["E" + d][k] = np.bincount(flat, weights=da_all[:, k].ravel(), minlength=256)
        return loss, g

    def fit(self, texts: list[bytes], labels: np.ndarray, steps: int = 260, batch: int = 192, length: int = 48, rate: float = 0.02, seed: int = 11) -> float:
        """Adam on random stretches of the texts."""
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        loss = 0.0
        for step in range(1, steps + 1):
            pick = r.integers(0, len(texts), batch)
            x = np.full((length, batch), 32, dtype=np.int64)
            for b, i in enumerate(pick):
                t = texts[i]
                at = int(r.integers(0, max(1, len(t) - length + 1)))
                part = np.frombuffer(t[at : at + length], dtype=np.uint8)
                x[: len(part), b] = part
            loss, g = self.gradients(x, labels[pick])
            now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k in self.p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] * g[k]
                self.p[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return loss

    def _label(self, x: np.ndarray, live: np.ndarray) -> np.ndarray:
        """Summed class probabilities of each column of x (steps, batch); live: bytes in each column."""
        steps, batch = x.shape
        n, p = self.h, self.p
        fwd = np.empty((steps, n, batch), dtype=np.float32)
        a = np.empty((3 * n, batch), dtype=np.float32)
        u = np.empty((3 * n, batch), dtype=np.float32)

        def step(d: str, t: int, h: np.ndarray) -> np.ndarray:
            np.take(p["E" + d], x[t], axis=1, out=a, mode="clip")
            np.matmul(p["U" + d], h, out=u)
            zr = a[: 2 * n]
            zr += u[: 2 * n]
            _sigmoid(zr)
            new = u[2 * n :]
            new *= zr[n:]
            new += a[2 * n :]
            np.tanh(new, out=new)
            out = h - new
            out *= zr[:n]
            out += new
            return out

        h = np.zeros((n, batch), dtype=np.float32)
        for t in range(steps):
            h = step("f", t, h)
            fwd[t] = h
        total = np.zeros((len(self.classes), batch), dtype=np.float32)
        h = np.zeros((n, batch), dtype=np.float32)
        vf, vb = np.ascontiguousarray(p["V"][:, :n]), np.ascontiguousarray(p["V"][:, n:])
        shortest = int(live.min())
        for t in range(steps - 1, -1, -1):
            h = step("b", t, h)
            if t >= shortest:
                h *= t < live  # padding after the end leaves no trace in the state
            q = vf @ fwd[t]
            q += vb @ h
            q += p["c"]
            np.exp(q, out=q)
            q /= q.sum(axis=0)
            if t >= shortest:
                q *= t < live
            total += q
        return total

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """Mean probability of each class over all bytes of each text, (texts, classes)."""
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        parts = -(-sizes // STRETCH)
        owner = np.repeat(np.arange(len(texts)), parts)
        at = (np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)) * STRETCH
        live = np.minimum(STRETCH, sizes[owner] - at)
        out = np.zeros((len(texts), len(self.classes)))
        order = np.argsort(-live, kind="stable")  # like lengths together: little padding
        raw = np.frombuffer(b"".join(texts) + bytes(STRETCH), dtype=np.uint8)
        start = (np.cumsum(sizes) - sizes)[owner] + at
        for lo in range(0, len(order), ROWS):
            pick = order[lo : lo + ROWS]
            steps = int(live[pick].max())
            x = raw[start[pick][None, :] + np.arange(steps)[:, None]].astype(np.intp)
            np.add.at(out, owner[pick], self._label(x, live[pick]).T)
        return out / np.maximum(sizes, 1)[:, None]


def training_sample(docs: DataFrame, label: str, max_rows: int, max_chars: int) -> list:
    """A bounded sample of labelled rows: those of least hash of doc_id, thinned by a rate before
    anything is ordered, each with one stretch of at most `max_chars` characters from anywhere in it.
    """
    rows = docs.where(F.col(label).isNotNull() & (F.length("text") > 0))
    n = rows.count()
    if not n:
        return []
    rate = min(1.0, 1.5 * max_rows / n)
    h = F.pmod(F.xxhash64(F.lit(11), F.col("doc_id")), F.lit(1 << 30))
    at = 1 + F.pmod(F.xxhash64(F.lit(5), F.col("doc_id")), F.greatest(F.length("text") - max_chars, F.lit(1)))
    return (
        rows.where(h < int(rate * (1 << 30)))
        .select(F.col(label).alias("y"), F.substr(F.col("text"), at.cast("int"), F.lit(max_chars)).alias("t"), h.alias("h"))
        .orderBy("h", "t")
        .limit(max_rows)
        .collect()
    )


def train(docs: DataFrame, learn: Column | None = None, max_rows: int = 3000, max_chars: int = 400) -> ByteGRU | None:
    """Fit on at most `max_rows` rows of (doc_id, text, lang) where `learn` holds and lang is known."""
    rows = training_sample(docs if learn is None else docs.where(learn), "lang", max_rows, max_chars)
    classes = sorted({r.y for r in rows})
    if not classes:
        return None
    model = ByteGRU(classes)
    if len(classes) > 1:
        model.fit([r.t.encode("utf-8", "replace") for r in rows], np.array([classes.index(r.y) for r in rows]))
    return model


def predict(model: ByteGRU | None, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Language and score of texts that have letters."""
    lang, score = np.array(["und"] * len(texts), dtype=object), np.zeros(len(texts))
    if model is None or not texts:
        return lang, score
    # So many documents at once as hold about 8 MB.
    group = np.cumsum([len(t) for t in texts]) // 8_000_000
    for g in np.unique(group):
        own = np.flatnonzero(group == g)
        prob = model.pooled([texts[i].encode("utf-8", "replace") for i in own])
        best = prob.argmax(axis=1)
        lang[own] = np.array(model.classes, dtype=object)[best]
        score[own] = np.clip(prob[np.arange(len(own)), best], 0, 1)
    return lang, score


def has_letter(text: str | None) -> bool:
    return bool(text) and (bool(ASCII_LETTER.search(text)) or any(c.isalpha() for c in text))


def accept(docs: DataFrame, model: ByteGRU | None, min_score: float = 0.35) -> DataFrame:
    """The rows of `docs`, all columns as they are, whose text has a letter and whose best language scores
    at least `min_score`. Null and empty texts go; with nothing learned every row goes; an empty
    table stays empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            keep = np.array([has_letter(t) for t in texts], dtype=bool)
            pick = np.flatnonzero(keep)
            lang, score = predict(model, [texts[i] for i in pick])
            keep[pick] = (lang != "und") & (score >= min_score)
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def identify(docs: DataFrame, model: ByteGRU | None) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of (doc_id, text), from all bytes of the text.

    `und` with score 0 where the text is null or has no letter, or where nothing could be learned.
    Ties go to the class that sorts first; repeated rows return as often as they come; null ids pass
    through; other columns are never looked at; an empty table gives an empty result.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lang, score = np.array(["und"] * len(pdf), dtype=object), np.zeros(len(pdf))
            pick = np.flatnonzero(pdf["letters"].to_numpy(dtype=bool))
            lang[pick], score[pick] = predict(model, pdf["text"].iloc[pick].tolist())
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "lang_pred": lang, "score": score})

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", letters).mapInPandas(run, "doc_id long, lang_pred string, score double")
