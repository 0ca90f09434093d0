"""Toxicity by two class-conditional Kneser-Ney language models."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import staged, unstage

TOKEN = re.compile(r"[^\W\d_]+")
#: Words of the stretches whose length-normalised likelihoods are compared.
WINDOW = 6
FEATURES = 4
#: Characters that words have in common which are alike.
STEM = 5
#: A word that tells the classes apart is so many times as common in one.
TIMES = 3.0
#: Counts that a task holds before it hands them on: bounded memory, the same sums.
FLUSH = 200_000
#: Words, or pairs of them, that a model may have: some 200 MB in the driver and in every worker.
MOST = 2_000_000


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def discounts(counts: np.ndarray) -> np.ndarray:
    """What is taken off a count of 0, 1, 2, 3 or more, from the counts of counts."""
    n = [0.0, *((counts == k).sum() + 0.5 for k in (1, 2, 3, 4))]
    y = n[1] / (n[1] + 2 * n[2])
    return np.array([0.0, *(float(np.clip(k - (k + 1) * y * n[k + 1] / n[k], 0.1 * k, k - 0.05)) for k in (1, 2, 3))])


def stem(word: str) -> str:
    return word[:STEM] + "*"


def evidence(n0, n1, share: float):
    """The likelihood ratio statistic of n1 of n0 + n1 uses falling to a class that has `share` of all documents. Numpy arrays."""
    n = n0 + n1
    with np.errstate(divide="ignore", invalid="ignore"):
        part = lambda k, q: np.where(k > 0, k * np.log(np.maximum(k, 1e-300) / (n * q)), 0.0)
        return 2 * (part(n0, 1 - share) + part(n1, share))


def telling(n0: Column, n1: Column, share: float, words: int) -> Column:
    """Whether a word's documents are dealt over the classes so unevenly that of `words` words about one would be by
    chance: `evidence` over 2 ln(words); and whether it is TIMES as common in one class as in the other, so that a larger
    corpus does not let in ever slighter differences."""
    n = n0 + n1
    times = (n1 + 0.5) * (1 - share) / ((n0 + 0.5) * share)
    part = lambda k, q: F.when(k > 0, k * F.log(k / (n * q))).otherwise(0.0)
    return (2 * (part(n0, 1 - share) + part(n1, share)) > 2 * float(np.log(max(words, 3)))) & (F.greatest(times, 1 / times) >= TIMES)


def _gathered(table: DataFrame, what: str, most: int) -> pd.DataFrame:
    """A staged table of a model, in the driver, after a look at its size. No entry is left out: a larger one is an error."""
    n = table.count()
    if n > most:
        raise ValueError(f"the toxicity model has {n} {what}, more than the {most} that may be sent to every worker (`most`)")
    out = table.toPandas()
    unstage(table)
    return out


class KneserNey:
    """Interpolated Kneser-Ney bigram models of toxic and of ordinary text over one vocabulary.

    The vocabulary are the words, of all that the labelled texts have, whose documents are dealt over the two classes more
    unevenly than chance would; words that tell nothing, but whose like (those that begin alike) do together, share a
    place. All others are unknown: they count as neighbours, but move no ratio. So what is counted grows with the
    labelled texts, and what every worker holds only with the expressions that set the classes apart.

    All counts of the models are continuation counts: of how many different words come before a word or a pair. A
    text that was copied many times therefore counts once, and so does a line that it repeats. The lowest order is shared:
    continuation counts of both classes together. An expression that one class lacks falls back
    on what is common to both, and only what a class has really seen moves the ratio.
    """

    def __init__(self, toxic: list[list[str]], ordinary: list[list[str]], least: int = 5, every: bool = False):
        """In one process, as the tests hold it against `counted`; `every` takes all words into the vocabulary."""
        docs = [Counter(w for d in part for w in set(d)) for part in (ordinary, toxic)]
        share = len(toxic) / max(len(toxic) + len(ordinary), 1)
        words = sorted(docs[0] | docs[1])

        def kept(names: list[str], counts: list[Counter]) -> set[str]:
            n0, n1 = (np.array([c[w] for w in names], dtype=float) for c in counts)
            times = (n1 + 0.5) * (1 - share) / ((n0 + 0.5) * share)
            ok = (evidence(n0, n1, share) > 2 * np.log(max(len(words), 3))) & (n0 + n1 >= least) & (np.maximum(times, 1 / times) >= TIMES)
            return {w for w, k in zip(names, ok) if k}

        held = set(words) if every else kept(words, docs)
        rest = [Counter() for _ in docs]
        for c, part in zip(rest, docs):
            for w, n in part.items():
                if w not in held:
                    c[stem(w)] += n
        self._index(held | kept(sorted(rest[0] | rest[1]), rest))
        into, keys, counts = [], [], []
        for part in (ordinary, toxic):
            # Distinct triples of (raw word before, pair), then distinct raw words before.
            triples, pairs = set(), set()
            for d in part:
                ids = self.ids(d).tolist()
                w = ["", "", *d]
                triples.update(zip(w, ids, ids[1:]))
                pairs.update(zip(w[1:], ids[1:]))
            into.append(np.bincount(np.fromiter((v for _, v in pairs), dtype=np.int64, count=len(pairs)), minlength=self.n).astype(float))
            k, c = np.unique(np.fromiter((u * self.n + v for _, u, v in triples if u and v), dtype=np.int64), return_counts=True)
            keys.append(k)
            counts.append(c)
        self._estimate(into, keys, counts)

    @classmethod
    def counted(cls, rows: DataFrame, least: int = 5, most: int = MOST) -> KneserNey:
        """The same model of (text, y), y = 1 for toxic text, of different texts, with all counting done by Spark. Only the chosen
        words and their pairs come to the driver, at most `most` of each (checked before)."""
        self = cls.__new__(cls)
        seen = rows.select("text", "y").mapInPandas(_documents, "w string, n0 long, n1 long").groupBy("w").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
        seen = staged(seen, "toxicity-words")
        # Three figures: how many different words, and texts of each class.
        words = seen.count()
        per = {r.y: r.n for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
        share = per.get(1, 0) / max(sum(per.values()), 1)
        ok = telling(F.col("n0"), F.col("n1"), share, words) & (F.col("n0") + F.col("n1") >= least)
        marked = seen.withColumn("ok", ok)
        stems = marked.where("NOT ok").groupBy(F.concat(F.substring("w", 1, STEM), F.lit("*")).alias("w")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where(ok)
        self._index(set(_gathered(staged(marked.where("ok").select("w").unionByName(stems.select("w")), "toxicity-chosen"), "words", most)["w"]))
        unstage(seen)
        index = rows.sparkSession.sparkContext.broadcast(self)

        def before(keys_of: Callable, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """Different words before each key, by class."""
            m = index.value
            for pdf in batches:
                out = set()
                for t, y in zip(pdf["text"], pdf["y"]):
                    d, y = tokens(t), int(y)
                    w, key = keys_of(m, d)
                    out.update((y, a, k) for a, k in zip(w, key.tolist()) if k >= 0)
                    if len(out) >= FLUSH:
                        yield pd.DataFrame(list(out), columns=["y", "a", "key"])
                        out = set()
                yield pd.DataFrame(list(out), columns=["y", "a", "key"])

        def of_words(m: KneserNey, d: list[str]) -> tuple[list[str], np.ndarray]:
            return ["", *d], m.ids(d)[1:]

        def of_pairs(m: KneserNey, d: list[str]) -> tuple[list[str], np.ndarray]:
            ids = m.ids(d)
            return ["", "", *d], np.where((ids[:-1] > 0) & (ids[1:] > 0), ids[:-1] * m.n + ids[1:], -1)

        def counts(keys_of: Callable, name: str) -> pd.DataFrame:
            found = rows.select("text", "y").mapInPandas(partial(before, keys_of), "y int, a string, key long").distinct()
            found = staged(found.groupBy("key").agg(*[F.count_if(F.col("y") == c).alias(f"n{c}") for c in (0, 1)]), name)
            return _gathered(found, "keys", most).sort_values("key")

        # One after the other and staged, so that the shuffle files of each are gone before the next.
        words, pairs = counts(of_words, "toxicity-into"), counts(of_pairs, "toxicity-pairs")
        into, keys, values = [], [], []
        for c in ("n0", "n1"):
            into.append(np.bincount(words["key"].to_numpy(dtype=np.int64), weights=words[c].to_numpy(), minlength=self.n).astype(float))
            held = pairs[c].to_numpy() > 0
            keys.append(pairs["key"].to_numpy(dtype=np.int64)[held])
            values.append(pairs[c].to_numpy(dtype=np.int64)[held])
        self._estimate(into, keys, values)
        return self

    def _index(self, frequent: set[str]) -> None:
        self.vocab = {w: i + 1 for i, w in enumerate(sorted(frequent))}  # 0: unknown
        self.n = len(self.vocab) + 1

    def _estimate(self, into: list[np.ndarray], keys: list[np.ndarray], counts: list[np.ndarray]) -> None:
        """From the continuation counts of words and, sorted by key, of pairs; ordinary text first."""
        n = self.n
        shared = into[0] + into[1] + 0.5
        shared /= shared.sum()
        self.keys, self.values, self.back, self.uni = keys, [], [], []
        for c in (0, 1):
            d = discounts(into[c])
            off = d[np.minimum(into[c], 3).astype(int)]
            total = max(into[c].sum(), 1.0)
            # With nothing seen the model is what is shared.
            self.uni.append((into[c] - off) / total + (off.sum() / total if into[c].any() else 1.0) * shared)
            u = keys[c] // n
            off = discounts(counts[c])[np.minimum(counts[c], 3)]
            total = np.bincount(u, weights=counts[c], minlength=n)
            self.back.append(np.where(total > 0, np.bincount(u, weights=off, minlength=n) / np.maximum(total, 1), 1.0))
            self.values.append((counts[c] - off) / np.maximum(total[u], 1))

    def ids(self, words: list[str]) -> np.ndarray:
        v = self.vocab
        return np.array([0, *(v.get(w) or v.get(stem(w), 0) for w in words)], dtype=np.int64)  # 0 also starts a text

    def ratio(self, ids: np.ndarray) -> np.ndarray:
        """log P(word | word before) under toxic text less that under ordinary text, for each word."""
        u, v = ids[:-1], ids[1:]
        key, out = u * self.n + v, 0.0
        for c, sign in ((1, 1.0), (0, -1.0)):
            p = self.back[c][u] * self.uni[c][v]
            if len(self.keys[c]):
                at = np.minimum(np.searchsorted(self.keys[c], key), len(self.keys[c]) - 1)
                p = p + np.where(self.keys[c][at] == key, self.values[c][at], 0.0)
            out = out + sign * np.log(p)
        return np.where(v == 0, 0.0, out)  # a word that neither class has seen tells nothing

    def features(self, words: list[str]) -> np.ndarray:
        """Length-normalised ratios: of the whole text, of its most toxic word, of its most toxic stretch, and of the
        mean of its three most toxic words."""
        r = self.ratio(self.ids(words))
        if not len(r):
            return np.zeros(FEATURES)
        sums = np.concatenate([[0.0], np.cumsum(r)])
        w = min(WINDOW, len(r))
        top = np.sort(np.partition(r, -min(3, len(r)))[-3:])
        return np.array([r.mean(), top[-1], (sums[w:] - sums[:-w]).max() / w, top.mean()])


def _documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How many texts of each class have a word."""
    out: tuple[Counter, Counter] = (Counter(), Counter())

    def told() -> pd.DataFrame:
        words = sorted(out[0].keys() | out[1].keys())
        return pd.DataFrame({"w": pd.Series(words, dtype=object), "n0": [out[0][w] for w in words], "n1": [out[1][w] for w in words]})

    for pdf in batches:
        for t, y in zip(pdf["text"], pdf["y"]):
            out[int(y)].update(set(tokens(t)))
        if len(out[0]) + len(out[1]) >= FLUSH:
            yield told()
            out = (Counter(), Counter())
    yield told()


class Toxicity:
    def __init__(self, lm: KneserNey, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray):
        self.lm, self.mean, self.scale, self.weights = lm, mean, scale, weights

    def score(self, text: str | None) -> float:
        x = (self.lm.features(tokens(text)) - self.mean) / self.scale
        return float(1 / (1 + np.exp(-np.clip(self.weights[0] + x @ self.weights[1:], -30, 30))))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton's method with a small ridge, over weighted rows."""
    a = np.c_[np.ones(len(x)), x]
    w = np.zeros(a.shape[1])
    penalty = ridge * np.diag([1e-6, *np.ones(x.shape[1])])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + penalty, a.T @ (weight * (y - p)) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def monotone(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic weights of which none is negative: a feature that would count against toxicity is left out."""
    use = list(range(x.shape[1]))
    while True:
        w = _logistic(x[:, use], y, weight)
        if not use or w[1:].min() >= 0:
            break
        use.pop(int(w[1:].argmin()))
    out = np.zeros(x.shape[1] + 1)
    out[0], out[np.array(use, dtype=int) + 1] = w[0], w[1:]
    return out


def labelled(docs: DataFrame, labels: DataFrame, learn: Column | None, max_toxic: int, max_ordinary: int) -> tuple[DataFrame, DataFrame, dict[int, int]]:
    """(text, y) of the labelled texts to count, the rows held back from them to fit on, and how many texts each label has. Of
    equal texts one counts; it is toxic if any of them is.

    Held back are the texts of least hash: one in two of each label, but no more than about max_toxic and
    max_ordinary; so every labelled text is either counted or fitted on, and the fit sees only texts that were not counted."""
    y = labels.where("toxic IS NOT NULL").select("doc_id", F.col("toxic").cast("int").alias("y")).groupBy("doc_id").agg(F.max("y").alias("y"))
    docs = docs.select("doc_id", "text")
    if learn is not None:
        y, docs = y.where(learn), docs.where(learn)
    h = F.coalesce("text", F.lit(""))
    # Digests and ids only; the texts are read once, for those that stay.
    marked = docs.select("doc_id", F.xxhash64(h).alias("h1"), F.xxhash64(h, F.lit(1)).alias("h2")).join(y.hint("merge"), "doc_id")
    texts = staged(marked.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"), F.max("y").alias("y")).where("doc_id IS NOT NULL"), "toxicity-labelled")
    counts = {r.y: r.n for r in texts.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    held = F.lit(False)
    for value, most in ((1, max_toxic), (0, max_ordinary)):
        rate = min(0.5, most / max(counts.get(value, 0), 1))
        held = held | ((F.col("y") == value) & (F.pmod("h1", F.lit(1 << 30)) < int(rate * (1 << 30))))
    keys = texts.select("doc_id", F.col("h1").alias("_h1"), "y", held.alias("held"))
    rows = docs.join(keys.hint("merge"), "doc_id").where(F.xxhash64(h) == F.col("_h1"))
    rows = staged(rows.select("text", "y", "held"), "toxicity-texts")
    unstage(texts)
    return rows.where("NOT held").select("text", "y"), rows.where("held").select("text", "y"), counts


def train(docs: DataFrame, labels: DataFrame, learn: Column | None = None, max_toxic: int = 1500, max_ordinary: int = 2500, most: int = MOST) -> Toxicity | None:
    """The n-gram counts come from all labelled texts but those of a bounded sample (see `labelled`). On these, which the counts
    have not seen, the weights of the ratios are fitted; a row weighs as many texts of its label as it stands for, so both
    classes have their share among the labels at every size. Of the sample only the features come to the driver."""
    counted, sample, counts = labelled(docs, labels, learn, max_toxic, max_ordinary)
    if {r.y for r in counted.select("y").distinct().collect()} != {0, 1}:
        return None
    lm = KneserNey.counted(counted, most=most)
    shared = docs.sparkSession.sparkContext.broadcast(lm)

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.array([shared.value.features(tokens(t)) for t in pdf["text"]]).reshape(-1, FEATURES)
            yield pd.DataFrame({"y": pdf["y"].astype(float), **{f"x{k}": x[:, k] for k in range(FEATURES)}})

    columns = [f"x{k}" for k in range(FEATURES)]
    # At most about max_toxic + max_ordinary rows of five figures.
    fit = sample.mapInPandas(measured, "y double, " + ", ".join(f"{c} double" for c in columns)).toPandas().sort_values(["y", *columns])
    y, x = fit["y"].to_numpy(), fit[columns].to_numpy()
    if not {0.0, 1.0} <= set(y):
        return None
    weight = np.where(y == 1, counts[1] / (y == 1).sum(), counts[0] / (y == 0).sum())
    weight /= weight.mean()
    mean = np.average(x, axis=0, weights=weight)
    scale = np.sqrt(np.average((x - mean) ** 2, axis=0, weights=weight)) + 1e-9
    return Toxicity(lm, mean, scale, monotone((x - mean) / scale, y, weight))


def score(docs: DataFrame, model: Toxicity | None, threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted) for every row of (doc_id, text), from the whole text.

    Null and empty texts get the score of a text without words; where nothing could be learned
    every score is 0. Repeated rows return as often as they come, null ids pass through, other
    columns are never looked at, an empty table gives an empty result. The model is broadcast; it has the words, and the
    pairs of them, that set the two classes apart (see KneserNey), not the vocabulary; `train` checks that they are at most
    MOST of each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for pdf in batches:
            s = np.array([m.score(t) for t in pdf["text"]] if m is not None else [0.0] * len(pdf), dtype=float)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "score": s, "predicted": (s >= threshold).astype(np.int32)})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, score double, predicted int")
