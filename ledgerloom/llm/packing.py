"""Best-fit packing of tokenised documents into sequences of a fixed length."""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import staged

#: The pre-tokenisation pattern of the 50k byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    for i, b in enumerate(b for b in range(256) if b not in set(plain)):
        out[chr(256 + i)] = b
    return out


def byte_level(spec: dict) -> bool:
    """Whether a tokenizer file says what the fast encoder does: no normaliser, words by PATTERN without a blank put in front, plain
    merges that go by the order of their ids, and added tokens that are taken as they stand."""
    words, model = spec.get("pre_tokenizer") or {}, spec["model"]
    if spec.get("normalizer") or words.get("type") != "ByteLevel" or words.get("add_prefix_space") or not words.get("use_regex", True) or model.get("type") != "BPE":
        return False
    if any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return False
    if any(t.get(k) for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip")):
        return False
    merged = [model["vocab"].get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model["merges"]]
    return all(x < y for x, y in zip([-1, *merged], merged))


@lru_cache(maxsize=2)
def _encoder(path: str) -> Callable[[str], list[int]]:
    """Text to ids. A byte-level vocabulary becomes a tiktoken encoding, which gives the same ids several times faster (the tests
    hold it against the tokenizers library); any other file goes through that library."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if not byte_level(spec):
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        whole.no_truncation()
        whole.no_padding()
        return lambda text: whole.encode(text, add_special_tokens=False).ids
    import tiktoken

    alphabet = _byte_alphabet()
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(alphabet[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    fast = tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return lambda text: fast.encode(text, allowed_special="all")


def encode(path: str, text: str) -> list[int]:
    return _encoder(path)(text)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: full ones, and a shorter one first if n isn't a multiple."""
    first = n % capacity
    head = [(0, first)] if first else []
    return head + [(s, capacity) for s in range(first, n, capacity)]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                ids = np.array([*encode(tokenizer, text or ""), end_id], dtype="<u4")
                for k, (s, n) in enumerate(cut(len(ids), capacity)):
                    rows.append((doc_id, k, s, n, zlib.crc32(ids[s : s + n].tobytes())))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            out["doc_id"] = pd.array(out["doc_id"], dtype="Int64")
            yield out

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInPandas(run, PIECES)


def sweep(items: DataFrame, salts: int) -> DataFrame:
    """Match pieces (kind 1) to the smallest gaps (kind 0) that hold them. `items`: (kind, id, size, gap).

    Gaps and pieces stand in one order, from large to small, gaps first where sizes are equal. A piece takes the last gap before
    it that no piece has taken, its successor; where several want one gap the first in order has it. In a count that
    a gap raises and a piece lowers, these are the gap that lifts it to a level and the next piece that leaves that level,
    so after a running sum the matches are neighbours within a level.

    The sum goes by (size, kind, salt): at most two sizes a token of capacity, times the salts that deal out a frequent
    size; rows add their rank in it. Rows of one size are on levels of their own, so a level has no more rows than there are
    sizes, however many pieces share one.

    Adds `seq`, the gap that a piece took, and `got`, the size of the piece that a gap took.
    """
    items = items.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
    runs = items.groupBy("size", "kind", "salt").agg(F.count(F.lit(1)).alias("n"))
    step = F.when(F.col("kind") == 0, 1).otherwise(-1)
    # At most two rows a token of capacity, whatever the input; they can be broadcast.
    classes = runs.groupBy("size", "kind").agg(F.sum("n").alias("n"))
    upto = F.sum(step * F.col("n")).over(Window.orderBy(F.desc("size"), "kind"))
    classes = classes.select("size", "kind", (upto - step * F.col("n")).alias("level"))
    before = F.sum("n").over(Window.partitionBy("size", "kind").orderBy("salt")) - F.col("n")
    starts = runs.select("size", "kind", "salt", before.alias("before")).join(F.broadcast(classes), ["size", "kind"])
    row = F.row_number().over(Window.partitionBy("size", "kind", "salt").orderBy("id"))
    # A gap stands on the level it reaches, a piece on the one it leaves.
    rank = F.col("before") + F.col("row")
    level = F.when(F.col("kind") == 0, F.col("level") + rank).otherwise(F.col("level") - rank + 1)
    placed = items.withColumn("row", row).join(starts.hint("merge"), ["size", "kind", "salt"]).withColumn("level", level)
    order = Window.partitionBy("level").orderBy(F.desc("size"), "kind")
    seq = F.when((F.col("kind") == 1) & (F.lag("kind").over(order) == 0), F.lag("id").over(order))
    got = F.when((F.col("kind") == 0) & (F.lead("kind").over(order) == 1), F.lead("size").over(order))
    return placed.select("kind", "id", "size", "gap", seq.alias("seq"), got.alias("got"))


def best_fit(pieces: DataFrame, capacity: int, open_share: float = 0.9) -> DataFrame:
    """Bulk-synchronous best fit of (pid, length): returns (pid, sequence_id, offset).

    Pieces over half the capacity can share with no other of their kind: each opens a sequence, that of its own pid. Empty ones,
    with negative numbers, are added up to `open_share` of the least number that the tokens need. Then a round is a
    sweep over all pieces left and all gaps that hold the smallest of them; gaps shrink by what they took. A gap that holds k
    of the largest pieces left takes part as k equal slots, which hold any piece, so rounds follow the spread of lengths
    and not the number of pieces in a sequence. After a sweep that placed under a tenth of what was left, as many sequences are
    opened as the rest needs at least beyond the gaps, after one that placed nothing, beside them. Only counts and sums of what is left go to the driver. Each round is written down, so lineage is one round long.
    """
    spark = pieces.sparkSession
    pieces = pieces.select("pid", F.col("length").cast("int").alias("size"))
    alone = 2 * F.col("size") > capacity
    free = pieces.where(~alone).select(F.lit(1).alias("kind"), F.col("pid").alias("id"), "size")
    bins = pieces.where(alone & (F.col("size") < capacity)).select(F.col("pid").alias("id"), (capacity - F.col("size")).alias("gap"))
    taken = [pieces.where(alone).select("pid", F.col("pid").alias("seq"), "size", F.lit(0).alias("round"))]
    large = pieces.agg(F.count_if(alone).alias("n"), F.sum("size").alias("total")).first()
    left = F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"), F.min("size").alias("least"), F.max("size").alias("most")
    opened, before, salts = 0, None, 1
    while (now := free.agg(*left).first()).n:
        need = 0
        if before is None:
            need, salts = max(0, int(-(-large.total // capacity) * open_share) - large.n), 8 + now.n // 500_000
        elif now.n == before:
            need = -(-now.total // capacity)
        elif 10 * (before - now.n) < before:
            room = bins.where(F.col("gap") >= now.least).agg(F.coalesce(F.sum("gap"), F.lit(0))).first()[0]
            need = max(0, -(-(now.total - room) // capacity))
        if need:
            bins = bins.unionByName(spark.range(opened + 1, opened + need + 1).select((-F.col("id")).alias("id"), F.lit(capacity).alias("gap")))
            opened += need
        before = now.n
        slots = F.greatest(F.lit(1), F.floor(F.col("gap") / now.most)).cast("int")
        gaps = bins.where(F.col("gap") >= now.least).select(F.lit(0).alias("kind"), "id", F.floor(F.col("gap") / slots).cast("int").alias("size"), "gap", F.explode(F.array_repeat(F.lit(0), slots)).alias("slot")).drop("slot")
        state = staged(sweep(free.withColumn("gap", F.lit(None).cast("int")).unionByName(gaps), salts), "packing-sweep")
        free = state.where("kind = 1 AND seq IS NULL").select("kind", "id", "size")
        bins = state.where("kind = 0").groupBy("id", "gap").agg(F.coalesce(F.sum("got"), F.lit(0)).alias("used")).select("id", (F.col("gap") - F.col("used")).cast("int").alias("gap"))
        taken.append(state.where("kind = 1 AND seq IS NOT NULL").select(F.col("id").alias("pid"), "seq", "size", F.lit(len(taken)).alias("round")))
    rows = taken[0]
    for more in taken[1:]:
        rows = rows.unionByName(more)
    # No more pieces than its capacity are in a sequence.
    behind = F.sum("size").over(Window.partitionBy("seq").orderBy("round", F.desc("size"), "pid").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    return rows.select("pid", F.col("seq").alias("sequence_id"), behind.alias("offset"))


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pack documents (doc_id, text) into as few sequences of at most `capacity` ids as it can.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. The text is read
    once; the sweeps work on two numbers a piece.

    Null or empty text is one end id; texts of any length are cut, never dropped; repeated rows and
    equal ids are packed as rows of their own; an empty table gives an empty result; null ids pass
    through; other columns are ignored.
    """
    pieces = staged(token_pieces(docs, tokenizer, capacity, end_id).withColumn("pid", F.monotonically_increasing_id()), "pieces")
    placed = best_fit(pieces, capacity)
    return pieces.join(placed.hint("merge"), "pid").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
