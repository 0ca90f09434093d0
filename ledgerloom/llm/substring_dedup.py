"""Removal of byte strings that occur more than once: ranks at growing lengths over sampled suffixes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import staged, unstage

#: An odd multiplier for the rolling hash that picks positions; it decides the sample, never a match.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes handled at once, so that very long texts need bounded memory.
SPAN = 1 << 20


@lru_cache(maxsize=2)
def _all_powers(base: int) -> np.ndarray:
    out = np.full(SPAN + 65_536, np.uint64(base))
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    return _all_powers(base)[:n]


def _scrambled(data: np.ndarray, k: int) -> np.ndarray:
    """A 32-bit priority of the k bytes at each position: equal bytes, equal priority."""
    n = len(data)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(BASE, n), out=sums[1:])
        h = (sums[k:] - sums[:-k]) * _powers(INVERSE, n)[: n - k + 1]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(32)).astype(np.uint32)


def _window_minimum(key: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive keys, in two passes of running minima over blocks of w."""
    n = len(key)
    pad = -n % w
    full = np.r_[key, np.full(pad, np.iinfo(key.dtype).max, dtype=key.dtype)].reshape(-1, w)
    left = np.minimum.accumulate(full, axis=1).ravel()
    right = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def anchors(data: bytes, length: int, k: int) -> Iterator[tuple[int, int, int]]:
    """(anchor, first window, windows): the starts of `length`-byte windows dealt to the k-byte string
    of least priority in each (the leftmost of equals). Which one that is depends on the bytes of
    the window alone, so equal windows have equal anchors at equal places."""
    n, w = len(data), length - k + 1
    raw = np.frombuffer(data, dtype=np.uint8)
    held: list[int] = []
    for lo in range(0, n - length + 1, SPAN):
        hi = min(n, lo + SPAN + length - 1)
        key = (_scrambled(raw[lo:hi], k).astype(np.uint64) << np.uint64(32)) | np.arange(hi - lo - k + 1, dtype=np.uint64)
        at = (_window_minimum(key, w) & np.uint64(0xFFFFFFFF)).astype(np.int64) + lo
        cuts = np.flatnonzero(at[1:] != at[:-1]) + 1
        for a, b in zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(at)].tolist()):
            anchor = int(at[a])
            if held and held[0] == anchor:
                held[2] += b - a
            else:
                if held:
                    yield tuple(held)
                held = [anchor, lo + a, b - a]
    if held:
        yield tuple(held)


SUFFIX_COLUMNS = ["rid", "lo", "n", "g", "c"]
SUFFIXES = "rid long, lo long, n long, g long, c long"


def _rank(data: bytes, seed: int = 0) -> int:
    return xxhash.xxh3_64_intdigest(data, seed) - (1 << 63)


def _suffix_row(rid: int, data: bytes, lo: int, n: int, head: int, size: int, length: int) -> tuple:
    """g ranks the `size` bytes at `head`, which all windows from lo on share; c ranks all bytes that the
    windows cover, with the place of the head in them."""
    return rid, lo, n, _rank(data[head : head + size]), _rank(data[lo : lo + n - 1 + length], (head - lo) * 4096 + n)


def sampled_suffixes(rows: DataFrame, length: int, k: int) -> DataFrame:
    """A row for each anchor, with the rank of its k bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: list[tuple] = []
            for rid, text in zip(pdf["rid"].tolist(), pdf["text"]):
                data = text.encode("utf-8", "replace")
                if len(data) < length:
                    continue
                for a, lo, n in anchors(data, length, k):
                    out.append(_suffix_row(rid, data, lo, n, a, k, length))
                    if len(out) >= 50_000:
                        yield pd.DataFrame(out, columns=SUFFIX_COLUMNS)
                        out = []
            yield pd.DataFrame(out, columns=SUFFIX_COLUMNS)

    return rows.select("rid", "text").mapInPandas(run, SUFFIXES)


def longer_suffixes(rows: DataFrame, length: int, k: int, block: int) -> DataFrame:
    """A row for each block of up to `block` windows of the open anchors (rid, text, open), with the rank of the
    length - block + 1 bytes that all windows of the block share. Blocks are laid from the anchor, so
    equal windows lie in equal blocks. The anchor of a span is found again from the span alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: list[tuple] = []
            for rid, text, spans in zip(pdf["rid"].tolist(), pdf["text"], pdf["open"]):
                data = text.encode("utf-8", "replace")
                for s in spans:
                    lo, n = s["lo"], s["n"]
                    a = lo + next(anchors(data[lo : lo + length], length, k))[0]
                    at = lo
                    while at < lo + n:
                        first = a - -(-(a - at) // block) * block  # of the block that holds `at`
                        m = min(first + block, lo + n) - at
                        out.append(_suffix_row(rid, data, at, m, first + block - 1, length - block + 1, length))
                        at += m
                if len(out) >= 50_000:
                    yield pd.DataFrame(out, columns=SUFFIX_COLUMNS)
                    out = []
            yield pd.DataFrame(out, columns=SUFFIX_COLUMNS)

    return rows.select("rid", "text", "open").mapInPandas(run, SUFFIXES)


def full_suffixes(rows: DataFrame, length: int) -> DataFrame:
    """A row for each window of the open blocks (rid, text, open), with two ranks of all its bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: list[tuple] = []
            for rid, text, spans in zip(pdf["rid"].tolist(), pdf["text"], pdf["open"]):
                data = text.encode("utf-8", "replace")
                for s in spans:
                    for p in range(s["lo"], s["lo"] + s["n"]):
                        w = data[p : p + length]
                        out.append((rid, p, 1, _rank(w), _rank(w, 1)))
                if len(out) >= 50_000:
                    yield pd.DataFrame(out, columns=SUFFIX_COLUMNS)
                    out = []
            yield pd.DataFrame(out, columns=SUFFIX_COLUMNS)

    return rows.select("rid", "text", "open").mapInPandas(run, SUFFIXES)


def settle(found: DataFrame, name: str) -> DataFrame:
    """What a round of ranks settles: (rid, lo, n, whole, open) of the rows whose rank g is not unique.
    whole: the covered bytes c repeat too, so every window does. open: of each distinct c of a rank
    that has several, one row, whose windows must be compared at a greater length."""
    contexts = found.groupBy("g", "c").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("rid", "lo")).alias("first"))
    per_rank = contexts.groupBy("g").agg(F.count(F.lit(1)).alias("kinds"), F.sum("m").alias("total")).where("total > 1")
    known = contexts.join(per_rank.hint("merge"), "g").select("g", "c", "m", "kinds", "first")
    out = found.join(known.hint("merge"), ["g", "c"]).select(
        "rid", "lo", "n", (F.col("m") > 1).alias("whole"), ((F.col("kinds") > 1) & (F.struct("rid", "lo") == F.col("first"))).alias("open")
    )
    return staged(out.where("whole OR open"), name)


def spans_of(hits: DataFrame, which: str) -> DataFrame:
    """One list of (lo, n) per document."""
    return hits.where(which).groupBy("rid").agg(F.collect_list(F.struct("lo", "n")).alias(which))


def _covered(spans, length: int, n: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by windows; spans are (first window, windows)."""
    out: list[list[int]] = []
    for lo, k in sorted(spans):
        hi = lo + k - 1 + length
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, min(b, n)) for a, b in out]


def _cut(data: bytes, spans, length: int) -> tuple[int, list[dict], bytes]:
    """n_bytes, the runs that go and the bytes that are left."""
    runs = _covered([(s["lo"], s["n"]) for s in spans] if spans is not None else [], length, len(data))
    left, at = [], 0
    for a, b in runs:
        left.append(data[at:a])
        at = b
    left.append(data[at:])
    return len(data), [{"start": a, "end": b} for a, b in runs], b"".join(left)


KEPT_COLUMNS = ["doc_id", "n_bytes", "spans", "kept"]
KEPT = "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary"


def cut_or_carry(rows: DataFrame, length: int) -> DataFrame:
    """Documents with nothing open are finished; of the others the text is carried on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for rid, doc_id, text, whole, more in zip(pdf["rid"], pdf["doc_id"], pdf["text"], pdf["whole"], pdf["open"]):
                if more is None:
                    out.append((doc_id, *_cut(text.encode("utf-8", "replace"), whole, length), None, None))
                else:
                    out.append((doc_id, None, None, None, rid, text))
            res = pd.DataFrame(out, columns=[*KEPT_COLUMNS, "rid", "text"])
            for c in ("doc_id", "n_bytes", "rid"):
                res[c] = pd.array(res[c], dtype="Int64")
            yield res

    return rows.select("rid", "doc_id", "text", "whole", "open").mapInPandas(run, KEPT + ", rid long, text string")


def cut_out(rows: DataFrame, length: int) -> DataFrame:
    """Per document (doc_id, text, spans) what is left when the covered bytes are gone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(doc_id, *_cut(text.encode("utf-8", "replace"), spans, length)) for doc_id, text, spans in zip(pdf["doc_id"], pdf["text"], pdf["spans"])]
            res = pd.DataFrame(out, columns=KEPT_COLUMNS)
            res["doc_id"] = pd.array(res["doc_id"], dtype="Int64")
            yield res

    return rows.select("doc_id", "text", "spans").mapInPandas(run, KEPT)


def digests(cut: DataFrame) -> list:
    """The columns (doc_id, n_bytes, n_removed, n_spans, kept_sha256) of what cut_repeats() gives."""
    gone = F.aggregate(cut["spans"], F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return [cut["doc_id"], cut["n_bytes"], gone.alias("n_removed"), F.size(cut["spans"]).cast("long").alias("n_spans"), F.sha2(cut["kept"], 256).alias("kept_sha256")]


def remove_repeats(docs: DataFrame, length: int = 400, k: int = 32, block: int = 16) -> DataFrame:
    """cut_repeats() as digests: (doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    cut = cut_repeats(docs, length, k, block)
    return cut.select(*digests(cut))


def kept_text(kept: Column) -> Column:
    """What is left as text. A match may begin or end inside a character; what is left of one is U+FFFD."""
    return F.make_valid_utf8(kept.cast("string"))


def cut_repeats(docs: DataFrame, length: int = 400, k: int = 32, block: int = 16) -> DataFrame:
    """Remove every byte covered by a `length`-byte string that also starts elsewhere: (doc_id, n_bytes, spans, kept), with the
    maximal runs removed (start, end) and the bytes that are left.

    Plain prefix doubling would sort a (position, rank) pair for each byte in each round: over
    twenty times the input on disk. Here the positions are thinned first, without losing a match:
    each window of `length` bytes is dealt to the k-byte string of least hash in it, so equal windows
    are dealt to equal strings at equal offsets. Ranks are then taken at growing lengths, and
    positions leave as soon as they are settled:

    1. k bytes at each anchor: an anchor whose rank is unique settles all its windows as unique.
    2. length - block + 1 bytes, shared by a block of neighbouring windows, for the anchors whose
       surroundings differ; again a unique rank settles the whole block.
    3. `length` bytes at each window of the blocks still open.

    In rounds 1 and 2 a row also ranks all bytes that its windows cover: where those repeat as a
    whole, all its windows are repeated and nothing need be looked at more closely. Of equal
    surroundings one row goes on. Each round is a grouped count with partial aggregation and a
    join on the rank, so a passage that a third of all documents share is counted before it is
    shuffled. Ranks are 64-bit hashes of the bytes, and a match needs two of them equal.

    Null text is empty; texts shorter than `length` are kept whole; repeated rows count as documents
    of their own; null ids pass through; other columns are ignored; an empty table gives an empty
    result.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = staged(base.withColumn("rid", F.monotonically_increasing_id()), "repeats-text")
    found = staged(sampled_suffixes(rows, length, k), "repeats-anchors")
    hits = settle(found, "repeats-hits")
    unstage(found)
    joined = rows.join(spans_of(hits, "whole").hint("merge"), "rid", "left").join(spans_of(hits, "open").hint("merge"), "rid", "left")
    first = staged(cut_or_carry(joined, length), "repeats-first")
    unstage(rows)
    done, rest = first.where("rid IS NULL").drop("rid", "text"), first.where("rid IS NOT NULL").select("rid", "doc_id", "text")

    blocks = staged(longer_suffixes(rest.join(spans_of(hits, "open").hint("merge"), "rid"), length, k, block), "repeats-blocks")
    more = settle(blocks, "repeats-hits")
    unstage(blocks)
    windows = staged(full_suffixes(rest.join(spans_of(more, "open").hint("merge"), "rid"), length), "repeats-windows")
    last = settle(windows, "repeats-hits")
    unstage(windows)
    # Of a row that went on for others of the same surroundings all windows are known to repeat already.
    known = hits.where("whole").unionByName(more.where("whole")).unionByName(last.where("whole")).select("rid", "lo", "n")
    spans = known.groupBy("rid").agg(F.collect_list(F.struct("lo", "n")).alias("spans"))
    return done.unionByName(cut_out(rest.join(spans.hint("merge"), "rid", "left"), length))
