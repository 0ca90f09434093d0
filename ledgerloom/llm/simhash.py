"""SimHash fingerprints and near-duplicate links by bit-sliced comparison.

`simhash_groups` links fingerprints within a few bits, exactly. `similar_groups` links texts of a given likeness: its fingerprints
differ in more bits than parts of them could agree on, so its buckets come from several seeds of least shingles, the
bit-sliced comparison picks each member's nearest in a bucket, and the likeness of what it picks is taken from the shingles.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import components, staged, unstage

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SEED = 42
BITS = 64
#: Members of a bucket that one task compares; larger buckets are compared in blocks of so many.
BLOCK = 1024
#: Largest radius that the vertical counters tell from more: five bits of them.
MOST = 31


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """The XXH64 of all word shingles, repeats included; of the whole sequence where it is shorter."""
    w = WORD.findall((text or "").encode("utf-8", "replace").lower())  # bytes: lower-cases A-Z only
    if not w:
        return np.zeros(0, dtype="<u8")
    joined, k = b" ".join(w), min(words, len(w))
    ends = np.cumsum([len(x) + 1 for x in w]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    return np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist())), dtype="<u8", count=len(w) - k + 1)


def majority(h: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes; zero if there are none."""
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(h), 4096):  # bounded memory for very long texts
        part = h[i : i + 4096]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def fingerprint(text: str | None, words: int = 4) -> int:
    """Majority bits of the XXH64 of all word shingles; zero if there is no word."""
    return majority(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fp = np.array([fingerprint(t, words) for t in pdf["text"]], dtype=np.uint64).astype(np.int64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "fp": fp})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, fp long")


def bucket_masks(distinct: int, radius: int) -> list[int]:
    """Masks such that two fingerprints within `radius` agree under at least one of them.

    The bits are dealt into b parts; with at most `radius` parts touched by a difference, b - radius
    parts agree. b is the least for which the agreeing bits tell apart as many buckets as there
    are fingerprints, over 64, so buckets stay of like size as the input grows.
    """
    for b in range(radius + 1, 2 * radius + 5):
        edges = [BITS * i // b for i in range(b + 1)]
        parts = [sum(1 << i for i in range(lo, hi)) for lo, hi in zip(edges, edges[1:])]
        masks = [sum(c) for c in combinations(parts, b - radius)]
        if min(m.bit_count() for m in masks) >= np.log2(max(distinct, 1) / 64 + 1):
            break
    return masks


def _links(fp: np.ndarray, bucket: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), i < j, of one bucket within `radius`. `bucket` is sorted.

    The members of a bucket lie across the lanes of 64-bit words, one word for each bit plane and 64
    members. A pivot is compared with all lanes of a word at once: each plane adds one bit to
    vertical carry-save counters (1, 2, 4, 8, 16 and an overflow that stays set), and (pivot, word)
    rows in which every lane has passed the radius are abandoned.
    """
    if radius > MOST:
        raise ValueError(f"the counters reach to {MOST} bits")
    n = len(fp)
    new = np.r_[True, bucket[1:] != bucket[:-1]]
    group = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    size = np.diff(np.r_[first, n])
    pos = np.arange(n) - first[group]
    words = -(-size // 64)
    word0 = np.r_[0, np.cumsum(words)[:-1]]
    word = word0[group] + pos // 64
    lane = np.uint64(1) << (pos % 64).astype(np.uint64)
    n_words = int(words.sum())
    planes = np.zeros((BITS, n_words), dtype=np.uint64)
    for p in range(BITS):
        on = (fp >> np.uint64(p)) & np.uint64(1) != 0
        np.bitwise_or.at(planes[p], word[on], lane[on])
    # Rows: each pivot with the words of its bucket from its own on; lanes after the pivot only.
    own = pos // 64
    count = words[group] - own
    pivot = np.repeat(np.arange(n), count)
    step = np.arange(len(pivot)) - np.repeat(np.cumsum(count) - count, count)
    w = word[pivot] + step
    full = np.full(n_words, ~np.uint64(0))
    tail = size - (words - 1) * 64
    last = word0 + words - 1
    full[last] = np.where(tail == 64, ~np.uint64(0), (np.uint64(1) << (tail % 64).astype(np.uint64)) - np.uint64(1))
    live = full[w]
    same = step == 0
    live[same] &= ~((lane[pivot[same]] << np.uint64(1)) - np.uint64(1))
    counter_bits = max(3, radius.bit_length())
    counters = [np.zeros(len(pivot), dtype=np.uint64) for _ in range(counter_bits)]
    over = np.zeros(len(pivot), dtype=np.uint64)
    for p in range(BITS):
        pb = (fp[pivot] >> np.uint64(p)) & np.uint64(1)
        carry = planes[p][w] ^ (np.uint64(0) - pb)
        for c in counters:
            both = c & carry
            c ^= carry
            carry = both
        over |= carry
        if p % 8 == 7:
            # Lanes whose count is over the radius: compare the counter bits with it, the highest first.
            gt, eq = over.copy(), ~over
            for k in range(counter_bits - 1, -1, -1):
                if radius >> k & 1:
                    eq &= counters[k]
                else:
                    gt |= eq & counters[k]
                    eq &= ~counters[k]
            live &= ~gt
            alive = live != 0
            if not alive.all():
                pivot, w, live, over, *counters = (x[alive] for x in (pivot, w, live, over, *counters))
            if not len(pivot):
                break
    i, j = [], []
    while len(pivot):
        low = live & (~live + np.uint64(1))
        bit = np.bitwise_count(low - np.uint64(1)).astype(np.int64)
        i.append(pivot)
        g = group[pivot]
        j.append(first[g] + (w - word0[g]) * 64 + bit)
        live ^= low
        alive = live != 0
        pivot, w, live = pivot[alive], w[alive], live[alive]
    if not i:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(i), np.concatenate(j)


def _stars(fp: np.ndarray, bucket: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Instead of all pairs of a bucket: each linked member with the least fingerprint (as a signed
    number) that it reaches there. The components are those of all pairs."""
    i, j = _links(fp, bucket, radius)
    signed = fp.view(np.int64)
    label = np.argsort(np.argsort(signed, kind="stable"), kind="stable")
    if not len(i):
        return signed[:0], signed[:0]
    by_rank = np.sort(signed, kind="stable")
    while True:
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        if (label == before).all():
            break
    root = by_rank[label]
    linked = root != signed
    return signed[linked], root[linked]


def in_buckets(rows: DataFrame, bucket: list[str], split: list[str], columns: list[str], compare: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """`compare` over the members of each bucket that has more than one: frames of `columns` and `task`, whole buckets each. A
    bucket of more than BLOCK members is dealt into blocks by the hash of `split`; each pair of blocks is a task's work."""
    sizes = rows.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64(*split, F.lit(7)), F.col("parts")).cast("int")
    dealt = (
        rows.join(sizes.withColumn("parts", parts).hint("merge"), bucket)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(*columns, F.xxhash64(*bucket, F.least("own", "other"), F.greatest("own", "other")).alias("task"))
    )
    dealt = dealt.repartition("task").sortWithinPartitions("task")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in batches:
            rest = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            task = rest["task"].to_numpy()
            end = int(np.searchsorted(task, task[-1]))  # the last bucket may go on
            if end:
                yield compare(rest.iloc[:end])
                rest = rest.iloc[end:].reset_index(drop=True)
        if rest is not None and len(rest):
            yield compare(rest)

    return dealt.mapInPandas(run, schema)


def near_links(distinct: DataFrame, radius: int, n_distinct: int) -> DataFrame:
    """Star edges (u, v) of distinct fingerprints `fp` within `radius` bits."""
    masks = bucket_masks(n_distinct, radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(signed)]))
    rows = distinct.select("fp", keys.alias("b")).select("fp", "b.k", "b.key")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        u, v = _stars(pdf["fp"].to_numpy(dtype=np.int64).view(np.uint64).copy(), pdf["task"].to_numpy(), radius)
        return pd.DataFrame({"u": u, "v": v})

    return in_buckets(rows, ["k", "key"], ["fp"], ["fp"], compare, "u long, v long").distinct()


def simhash_groups(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id): component_id is the smallest doc_id that links reach.

    Exact copies fall together as one fingerprint before any comparison. Candidates come from
    agreement on parts of the fingerprint (no link within the radius can be missed), buckets are
    compared bit-sliced, and the links become components in star rounds.

    Null and empty texts and texts without a word have fingerprint zero and link like any other;
    texts of any length are read whole; repeated rows return as often as they come; null ids join
    groups but never name one unless the group has no other; other columns are ignored; an empty
    table gives an empty result.
    """
    fps = staged(fingerprints(docs, words), "simhash")
    per = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-distinct")
    n = per.count()
    roots = staged(components(near_links(per.select("fp"), radius, n), "simhash"), "simhash-roots")
    named = per.join(roots.hint("merge"), per.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    # Staged, so that both sides of the join are shuffled for it and a large component can be split.
    lows = staged(named.groupBy("root").agg(F.min("low").alias("component_id")), "simhash-lows")
    classes = named.join(lows.hint("merge"), "root").select("fp", "component_id")
    return fps.join(classes.hint("merge"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def least_shingles(h: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A key for each band: what its `rows` seeds have for their least of the hashes. Sets of likeness j agree on a band
    with chance j ** rows."""
    seeds = np.random.default_rng(SEED).integers(1 << 62, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    low = np.full(bands * rows, ~np.uint64(0))
    with np.errstate(over="ignore"):
        for i in range(0, len(h), 4096):
            x = h[i : i + 4096, None] * seeds
            low = np.minimum(low, (x ^ (x >> np.uint64(32))).min(axis=0))
    return np.array([xxhash.xxh3_64_intdigest(low[b * rows : (b + 1) * rows].tobytes(), b) for b in range(bands)], dtype=np.uint64).view(np.int64)


def sketches(rows: DataFrame, words: int, bands: int, band_rows: int) -> DataFrame:
    """Of each text its fingerprint, a 128-bit digest of the set of its shingles, the bands and the set itself, as sorted hashes
    of four bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for rid, text in zip(pdf["rid"].tolist(), pdf["text"]):
                h = shingle_hashes(text, words)
                own = np.unique(h)
                d = xxhash.xxh3_128_digest(own.tobytes())
                d1, d2 = np.frombuffer(d, dtype="<i8").tolist()
                fp = int(np.uint64(majority(h)).astype(np.int64))
                out.append((rid, fp, d1, d2, least_shingles(own, bands, band_rows).tolist(), np.unique((own >> np.uint64(32)).astype("<u4")).tobytes()))
            yield pd.DataFrame(out, columns=["rid", "fp", "d1", "d2", "bands", "shingles"])

    return rows.select("rid", "text").mapInPandas(run, "rid long, fp long, d1 long, d2 long, bands array<long>, shingles binary")


def nearest_links(fp: np.ndarray, bucket: np.ndarray, radius: int, nearest: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Of all links within the radius in a bucket those of a tree of least distances, and each member's `nearest`: pairs (i, j). What
    was linked stays so."""
    i, j = _links(fp, bucket, radius)
    if not len(i):
        return i, j
    # Links in the order of their distances; of equal ones the first.
    order = np.argsort(np.bitwise_count(fp[i] ^ fp[j]), kind="stable")
    i, j = i[order], j[order]
    ends, rank = np.concatenate([i, j]), np.tile(np.arange(len(i)), 2)
    by_end = np.lexsort((rank, ends))
    starts = np.flatnonzero(np.r_[True, np.diff(ends[by_end]) != 0])
    nth = np.arange(len(ends)) - np.repeat(starts, np.diff(np.r_[starts, len(ends)]))
    take = np.unique(rank[by_end][nth < nearest])
    label = np.arange(len(fp))
    new = take
    while len(new):
        while True:  # one label for what the links join
            low = np.minimum(label[i[new]], label[j[new]])
            before = label.copy()
            np.minimum.at(label, i[new], low)
            np.minimum.at(label, j[new], low)
            np.minimum.at(label, before, label)
            label = label[label]
            if (label == before).all():
                break
        cross = np.flatnonzero(label[i] != label[j])
        best = np.full(len(fp), len(i))
        np.minimum.at(best, label[i[cross]], cross)
        np.minimum.at(best, label[j[cross]], cross)
        new = np.unique(best[best < len(i)])
        take = np.union1d(take, new)
        new = take
        if not len(cross):
            break
    return i[take], j[take]


def shared_counts(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, width: int = 2048) -> np.ndarray:
    """How many elements the sets i and j of each pair share. Many pairs are counted at once, by products of 0-1 matrices of `width`
    elements each; elements that one set alone has are left out."""
    if len(i) < 4 * len(sets):
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j)], dtype=np.int64)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = count[column] > 1
    owner, column = owner[common], (np.cumsum(count > 1) - 1)[column[common]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((len(sets), len(sets)), dtype=np.float32)  # whole numbers under 2^24 are exact
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        start, end = np.searchsorted(column, [low, low + width])
        part = np.zeros((len(sets), width), dtype=np.float32)
        part[owner[start:end], column[start:end] - low] = 1
        total += part @ part.T
    return total[i, j].astype(np.int64)


def ties_between(fp: np.ndarray, root: np.ndarray, sets: list[np.ndarray], bucket: np.ndarray, radius: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Ties (u, v) of roots in each bucket (sorted): of all pairs of different roots within the radius those alike by `similarity` count, and each
    root is tied to the least that these reach, so a bucket gives fewer ties than it has roots."""
    i, j = _links(fp, bucket, radius)
    apart = root[i] != root[j]
    i, j = i[apart], j[apart]
    order = np.argsort(i, kind="stable")
    i, j = i[order], j[order]
    sizes, u, v = np.array([len(x) for x in sets], dtype=np.int64), [], []
    edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]).tolist() + [len(fp)]
    for low, high in zip(edges, edges[1:]):
        start, end = np.searchsorted(i, [low, high])
        if start == end:
            continue
        a, b = i[start:end], j[start:end]
        shared = shared_counts(sets[low:high], a - low, b - low)
        held = shared >= similarity * (sizes[a] + sizes[b] - shared)
        names, place = np.unique(np.concatenate([root[a[held]], root[b[held]]]), return_inverse=True)
        x, y = place[: held.sum()], place[held.sum() :]
        label = np.arange(len(names))
        while True:
            before = label.copy()
            least = np.minimum(label[x], label[y])
            np.minimum.at(label, x, least)
            np.minimum.at(label, y, least)
            label = label[label]
            if (label == before).all():
                break
        tied = label != np.arange(len(names))
        u.append(names[label[tied]])
        v.append(names[tied])
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(u), np.concatenate(v)) if u else (none, none)


def similar_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, bands: int = 12, band_rows: int = 4, radius: int = 22) -> DataFrame:
    """(rid, root) of rows (rid, text), rid a unique long: root is the same for rows whose sets of word shingles links of
    `similarity` or more (shared shingles over all of both) connect.

    Rows of one set fall together first. Buckets are what texts agree on by one of `bands` bands of least shingles: at 0.8 a
    pair meets in one of twelve with a chance of 0.998. In a bucket the fingerprints are compared bit-sliced within `radius` (at
    0.8 they differ in about ten of 64 bits, over 22 one time in ten thousand), and of the links the two nearest of each member
    and a tree of the least distances go on. Their likeness is then computed from the shingles, so no link is
    below `similarity`. All other links of a bucket between texts that these do not join are computed after that, so none within the
    radius is left out.

    Texts without a word are alike; shorter ones than `words` are one shingle; null text is empty; an empty table gives an
    empty result.
    """
    known = staged(sketches(docs, words, bands, band_rows), "similar-sketches")
    kinds = staged(known.groupBy("d1", "d2").agg(F.min("rid").alias("rep")), "similar-kinds")
    reps = known.join(kinds.select(F.col("rep").alias("rid")).hint("merge"), "rid")
    rows = reps.select("rid", "fp", F.posexplode("bands").alias("k", "key"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        rid = pdf["rid"].to_numpy(dtype=np.int64)
        i, j = nearest_links(pdf["fp"].to_numpy(dtype=np.int64).view(np.uint64).copy(), pdf["task"].to_numpy(), radius)
        return pd.DataFrame({"u": np.minimum(rid[i], rid[j]), "v": np.maximum(rid[i], rid[j])})

    links = staged(in_buckets(rows, ["k", "key"], ["rid"], ["rid", "fp"], compare, "u long, v long").distinct(), "similar-links")

    def alike(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = []
            for a, b in zip(pdf["a"], pdf["b"]):
                x, y = np.frombuffer(a, dtype="<u4"), np.frombuffer(b, dtype="<u4")
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(shared >= similarity * (len(x) + len(y) - shared))
            yield pdf.loc[np.array(keep, dtype=bool), ["u", "v"]]

    side = lambda name, to: known.select(F.col("rid").alias(name), F.col("shingles").alias(to))
    pairs = links.join(side("u", "a").hint("merge"), "u").join(side("v", "b").hint("merge"), "v")
    held = staged(pairs.mapInPandas(alike, "u long, v long"), "similar-held")
    roots = staged(components(held, "similar"), "similar-roots")
    # What the nearest and the trees left out can only matter between texts that are not joined yet: in buckets that still hold several
    # roots every link within the radius between two of them is computed too, in the task that compares them; no pair leaves it, only ties of roots.
    rooted = rows.join(roots.select(F.col("node").alias("rid"), "root").hint("merge"), "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    several = rooted.groupBy("k", "key").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high"))
    # Of three members each has both others among its two nearest.
    open_ = staged(rooted.join(several.where("n > 3 AND low < high").select("k", "key").hint("merge"), ["k", "key"], "left_semi"), "similar-open")

    def between(pdf: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(x, dtype="<u4") for x in pdf["shingles"]]
        u, v = ties_between(pdf["fp"].to_numpy(dtype=np.int64).view(np.uint64).copy(), pdf["root"].to_numpy(dtype=np.int64), sets, pdf["task"].to_numpy(), radius, similarity)
        return pd.DataFrame({"u": u, "v": v})

    wide = open_.join(side("rid", "shingles").hint("merge"), "rid")
    late = staged(in_buckets(wide, ["k", "key"], ["rid"], ["rid", "fp", "root", "shingles"], between, "u long, v long").distinct(), "similar-late")
    first = roots
    if late.limit(1).count():
        roots = staged(components(held.unionByName(late), "similar"), "similar-roots")
        unstage(first)
    unstage(open_)
    named = kinds.join(roots.hint("merge"), kinds.rep == roots.node, "left").select("d1", "d2", F.coalesce("root", "rep").alias("root"))
    named = staged(named, "similar-named")
    out = staged(known.select("rid", "d1", "d2").join(named.hint("merge"), ["d1", "d2"]).select("rid", "root"), "similar-groups")
    # The sets of shingles are the largest of all that was written down; nothing reads them any more.
    for done in (known, kinds, links, held, late, roots, named):
        unstage(done)
    return out
