"""SentencePiece encoding and decoding by suffix-array matching."""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: A unit: white space marks, then what follows up to the next mark. No piece crosses a unit's end.
UNIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Distinct units and pairs that a task remembers at most.
MEMORY = 400_000


class Pieces:
    """A BPE model of the sentencepiece library, read from its file and nothing else taken from it."""

    def __init__(self, path: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        plain = [i for i in range(len(names)) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        self.id = {names[i]: i for i in plain}
        self.score = {names[i]: m.get_score(i) for i in plain}
        self.byte = {int(names[i][3:-1], 16): i for i in range(len(names)) if m.is_byte(i)}
        self.longest = max(map(len, self.id))
        self.bytes = {i: names[i].replace(SPACE, " ").encode() for i in plain} | {i: bytes([b]) for b, i in self.byte.items()}
        # Pieces of one character need no search: they are what stands where no longer piece fits.
        self.sorted = sorted(p for p in self.id if len(p) > 1)
        self.names = self.sorted + sorted(p for p in self.id if len(p) == 1)
        self.single = {p: k for k, p in enumerate(self.names) if len(p) == 1}
        lengths = np.array([len(p) for p in self.sorted])
        self.chars = np.zeros((len(self.sorted), self.longest), dtype=np.int64)
        for k, p in enumerate(self.sorted):
            self.chars[k, : len(p)] = [ord(c) for c in p]
        self.lengths = lengths
        self.own = [array("I", [self.id[p]]).tobytes() for p in self.names]
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}

    def merge(self, text: str) -> list[str]:
        """Plain merging: the best-scored adjacent pair, the leftmost of equals, until none is a piece."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, left: str, right: str) -> bool:
        """Whether merging the two pieces' text gives back the two pieces."""
        return self.merge(left + right) == [left, right]

    def edges(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where pieces occur in the concatenated units: (start, end, piece), by end, then the longest first.

        The suffix array is sorted as deep as the longest piece, by prefix doubling over ranks; then
        every piece is searched for in it by bisection, all pieces side by side.
        """
        text = np.frombuffer("\0".join(units).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        n = len(text)
        rank = np.unique(text, return_inverse=True)[1].astype(np.int64) + 1
        width = 1
        while width < self.longest:
            nxt = np.zeros(n, dtype=np.int64)
            nxt[: max(0, n - width)] = rank[width:]
            rank = np.unique(rank * (int(rank.max()) + 1) + nxt, return_inverse=True)[1].astype(np.int64) + 1
            width *= 2
        suffixes = np.argsort(rank, kind="stable")
        padded = np.r_[text, np.full(self.longest, -1, dtype=np.int64)]
        bounds = []
        for upper in (False, True):
            lo, hi = np.zeros(len(self.sorted), dtype=np.int64), np.full(len(self.sorted), n, dtype=np.int64)
            while (lo < hi).any():
                mid = (lo + hi) // 2
                at = suffixes[np.minimum(mid, n - 1)]
                order = np.zeros(len(lo), dtype=np.int8)  # of the suffix's head against the piece
                for k in range(self.longest):
                    undecided = (order == 0) & (self.lengths > k)
                    if not undecided.any():
                        break
                    c = padded[at[undecided] + k]
                    order[undecided] = np.sign(c - self.chars[undecided, k])
                right = (order < 0) | ((order == 0) & upper)
                active = lo < hi
                lo = np.where(active & right, mid + 1, lo)
                hi = np.where(active & ~right, mid, hi)
            bounds.append(lo)
        first, count = bounds[0], bounds[1] - bounds[0]
        piece = np.repeat(np.arange(len(self.sorted)), count)
        start = suffixes[np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))]
        end = start + self.lengths[piece]
        order = np.lexsort((start, end))
        return start[order], end[order], piece[order]

    def learn(self, units: list[str]) -> None:
        """Encode distinct units: relax their edges from left to right.

        The encoding of a prefix ends in the one piece that fits behind the encoding of what is before
        it; if no longer one does, in its last character. A character that no piece has is spelled in bytes.
        Runs of white space marks, whose pieces tie in score, are merged plainly.
        """
        runs = [u for u in units if u.startswith(SPACE * 2)]
        for u in runs:
            self.known[u] = b"".join(map(self.spelled, self.merge(u) if len(u) < 64 else self.merge_long(u)))
        units = [u for u in units if not u.startswith(SPACE * 2)]
        if not units:
            return
        start, end, piece = self.edges(units)
        starts, ends, found = start.tolist(), end.tolist(), piece.tolist()
        at, k, total = 0, 0, len(ends)
        names, pairs, many, single = self.names, self.pairs, len(self.names), self.single
        if len(pairs) > 4 * MEMORY:
            pairs.clear()
        own = self.own
        for u in units:
            stop = at + len(u)
            last = [-1] * (len(u) + 1)  # last piece of the encoding of each prefix
            while k < total and ends[k] <= stop:
                e = ends[k]
                if last[e - at] >= 0:
                    k += 1
                    continue
                s, p = starts[k] - at, found[k]
                if s:
                    before = last[s]
                    if before < 0:
                        before = single.get(u[s - 1], -1)
                    if before < 0:  # a character that no piece has stands for itself and merges with nothing
                        fits = True
                    else:
                        fits = pairs.get(before * many + p)
                        if fits is None:
                            fits = pairs[before * many + p] = self.fits(names[before], names[p])
                else:
                    fits = True
                if fits:
                    last[e - at] = p
                k += 1
            parts, e = [], len(u)
            while e:
                p = last[e]
                if p >= 0:
                    parts.append(own[p])
                    e -= len(names[p])
                else:
                    e -= 1
                    parts.append(self.spelled(u[e]))
            parts.reverse()
            self.known[u] = b"".join(parts)
            at = stop + 1

    def merge_long(self, unit: str) -> list[str]:
        """Plain merging with a heap of pairs, for long units."""
        parts = list(unit)
        nxt, prev = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = []

        def offer(k: int) -> None:
            if 0 <= k and nxt[k] < len(parts):
                s = self.score.get(parts[k] + parts[nxt[k]])
                if s is not None:
                    heapq.heappush(heap, (-s, k, parts[k], parts[nxt[k]]))

        for k in range(len(parts)):
            offer(k)
        while heap:
            _, k, a, b = heapq.heappop(heap)
            if parts[k] != a or nxt[k] >= len(parts) or parts[nxt[k]] != b:
                continue
            gone = nxt[k]
            parts[k], parts[gone], nxt[k] = a + b, "", nxt[gone]
            if nxt[k] < len(parts):
                prev[nxt[k]] = k
            offer(prev[k])
            offer(k)
        return [p for p in parts if p]

    def spelled(self, text: str) -> bytes:
        """Ids of a piece, or of the bytes of a character that is none."""
        i = self.id.get(text)
        return array("I", [i] if i is not None else [self.byte[b] for b in text.encode("utf-8", "replace")]).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        split = [UNIT.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        units = set().union(*split)
        if len(self.known) > MEMORY:  # what was not met since the last time goes
            self.old, self.known = self.known, {}
        new = units - self.known.keys()
        met = new & self.old.keys()
        self.known.update((u, self.old[u]) for u in met)
        new -= met
        if new:
            self.learn(sorted(new))
        known = self.known
        return [b"".join([known[u] for u in s]) for s in split]

    def decode(self, ids: bytes) -> str:
        raw = b"".join([self.bytes[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])
        text = raw.decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _batches(texts: list[str], size: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about `size` characters together."""
    lo = held = 0
    for k, t in enumerate(texts):
        held += len(t)
        if held >= size:
            yield lo, k + 1
            lo, held = k + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def encode_documents(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids) with ids as an array of int for every row of (doc_id, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = pieces(model)
        for pdf in batches:
            texts = [t or "" for t in pdf["text"]]
            for lo, hi in _batches(texts):
                yield pd.DataFrame({"doc_id": pdf["doc_id"].iloc[lo:hi].astype("Int64"), "ids": [np.frombuffer(b, dtype="<i4") for b in m.encode(texts[lo:hi])]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = pieces(model)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "text": [m.decode(np.asarray(i, dtype="<u4").tobytes()) for i in pdf["ids"]]})

    return encoded.select("doc_id", "ids").mapInPandas(run, "doc_id long, text string")


def digest_documents(docs: DataFrame, model: str) -> DataFrame:
    """Per document the number and crc32 of its ids, and the digest of what they decode to.

    Null and empty texts have no ids; texts of any length are encoded whole; repeated rows return as
    often as they come; null ids pass through; other columns are ignored; an empty table gives an
    empty result.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = pieces(model)
        for pdf in batches:
            texts, out = [t or "" for t in pdf["text"]], []
            for lo, hi in _batches(texts):
                for b in m.encode(texts[lo:hi]):
                    out.append((len(b) // 4, zlib.crc32(b), hashlib.sha256(m.decode(b).encode("utf-8", "replace")).hexdigest()))
            res = pd.DataFrame(out, columns=["n_ids", "ids_crc32", "decoded_sha256"])
            res.insert(0, "doc_id", pdf["doc_id"].astype("Int64").to_numpy(dtype=object))
            res["doc_id"] = res["doc_id"].astype("Int64")
            yield res

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string")
