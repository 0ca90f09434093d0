"""Spelling variants: words one edit apart, found by dynamic programming over the sorted vocabulary.

The vocabulary is dealt out by the beginnings of words and, reversed, by their ends: two words of seven or more letters that
are one edit apart share the first three or the last four. In such a block the words lie sorted, and every word is
compared with all others at once: a row of the edit matrix, three cells wide, belongs to a range of words with a common prefix,
so it is computed once for all words of the range; a range whose prefix is already two edits away is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import lower_ascii, staged, unstage

LETTERS = "[A-Za-zÀ-ÿ]"
LEAST = 7
#: Letters that a block's words share: at the beginning, and at the end.
HEAD, TAIL = 3, 4
#: Words of a block at most; a larger one is dealt out by one more letter. Words that a task compares at a time.
BLOCK, CHUNK = 20_000, 40_000
SCANNED = "word string, n_near long, best_n long, best string"


def vocabulary(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(word, n): the runs of letters of all texts, A-Z lower-cased, with `least` code points and two occurrences or more.

    A run loses one code point where 31 divides the crc32 of `<doc_id>:<run>`, that at crc32 % length; a row without an id loses
    none. A null text has no words. Runs that are too short to begin with are not looked at, as none grows.
    """
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(f"{LETTERS}{{{least},}}+"), F.lit(0))).alias("run"))
    h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("run")).cast("binary"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.char_length("run")))
    words = runs.withColumn("h", h).select(F.when(F.col("h") % 31 == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.char_length("word") >= least).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


def pairs_in_blocks(words: list[bytes], shared: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j), i < j, of all pairs of the sorted distinct `words` that are one edit apart and share their first `shared` bytes.

    A state is a word and a range of words that agree in their first d bytes, with the word's distances to that prefix:
    from d - 1, d and d + 1 of its own bytes. All states of a depth are moved on together.
    """
    m = len(words)
    size = np.fromiter(map(len, words), np.int64, m)
    begin = np.concatenate([[0], np.cumsum(size)])
    text = np.frombuffer(b"".join(words) + b"\0", np.uint8)
    at = lambda w, k: np.where(k < size[w], text[np.minimum(begin[w] + k, len(text) - 1)], 0)
    common = np.zeros(m, np.int64)
    alive, d = np.arange(1, m), 0
    while len(alive):
        a, b = at(alive - 1, d), at(alive, d)
        alive, d = alive[(a == b) & (a > 0)], d + 1
        common[alive] = d
    d = shared
    edges = np.append(np.flatnonzero(common < d), m)
    q = np.arange(m)
    block = np.searchsorted(edges, q, side="right") - 1
    lo, hi = edges[block], edges[block + 1]
    left, mid, right = np.ones(m, np.int8), np.zeros(m, np.int8), np.where(size > d, 1, 2).astype(np.int8)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    while True:
        # Only words after one's own, so that a pair is met once.
        keep = hi > q + 1
        q, lo, hi, left, mid, right = q[keep], lo[keep], hi[keep], left[keep], mid[keep], right[keep]
        if not len(q):
            break
        # The word that ends here is the first of its range.
        ends = size[lo] == d
        short = size[q] - d
        last = np.select([short == -1, short == 0, short == 1], [left, mid, right], 2)
        hit = ends & (last == 1) & (lo > q)
        found.append((q[hit], lo[hit]))
        edges = np.append(np.flatnonzero(common < d + 1), m)
        first = np.searchsorted(edges, lo) + ends
        number = np.maximum(np.searchsorted(edges, hi) - first, 0)
        of = np.repeat(np.arange(len(q)), number)
        child = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(number) - number, number)
        lo, hi = edges[child], edges[child + 1]
        later = hi > q[of] + 1
        of, lo, hi = of[later], lo[later], hi[later]
        q, left, mid, right = q[of], left[of], mid[of], right[of]
        c = text[begin[lo] + d]
        room = size[q]
        # Columns d, d + 1 and d + 2 of the next row; a column beyond the word's end is out of reach.
        new_left = np.minimum(left + (c != at(q, np.full(len(q), d - 1))), mid + 1)
        new_left = np.where(room >= d, new_left, 2)
        new_mid = np.minimum(np.minimum(mid + (c != at(q, np.full(len(q), d))), right + 1), new_left + 1)
        new_mid = np.where(room >= d + 1, new_mid, 2)
        new_right = np.minimum(right + (c != at(q, np.full(len(q), d + 1))), new_mid + 1)
        new_right = np.where(room >= d + 2, new_right, 2)
        near = np.minimum(np.minimum(new_left, new_mid), new_right) <= 1
        q, lo, hi = q[near], lo[near], hi[near]
        left, mid, right = (np.minimum(x[near], 2).astype(np.int8) for x in (new_left, new_mid, new_right))
        d += 1
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _near_of(words: list[bytes], n: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """For each word with a near one: how many it has, and the one of largest n (of these the first in order)."""
    order = np.empty(len(words), np.int64)
    order[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    one, other = np.concatenate([a, b]), np.concatenate([b, a])
    by = np.lexsort((order[other], -n[other], one))
    one, other = one[by], other[by]
    top = np.flatnonzero(np.append(True, one[1:] != one[:-1])) if len(one) else np.zeros(0, np.int64)
    count = np.diff(np.append(top, len(one)))
    text = lambda i: pa.array([words[k].decode("latin-1") for k in i.tolist()], pa.string())
    return pa.record_batch([text(one[top]), pa.array(count), pa.array(n[other[top]]), text(other[top])], names=["word", "n_near", "best_n", "best"])


def _scan(deeper: int):
    """A function over batches of (side, key, word, n), sorted by side and key: the near words of each within its block. Whole
    blocks are gathered until there is enough to compare at a time."""

    def compare(side: int, words: list[bytes], n: list[int]) -> pa.RecordBatch:
        turned = [w[::-1] for w in words] if side else words
        by = sorted(range(len(words)), key=turned.__getitem__)
        own, n_own = [words[i] for i in by], np.array([n[i] for i in by], np.int64)
        a, b = pairs_in_blocks([turned[i] for i in by], (TAIL if side else HEAD) + deeper)
        if side and len(a):
            # Pairs that share the beginning too are found there.
            new = np.fromiter((own[i][:HEAD] != own[j][:HEAD] for i, j in zip(a.tolist(), b.tolist(), strict=True)), bool, len(a))
            a, b = a[new], b[new]
        return _near_of(own, n_own, a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side, key, start, words, n = None, None, 0, [], []
        for batch in batches:
            for s, k, w, c in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if (s, k) != (side, key):
                    if words and (s != side or len(words) >= CHUNK):
                        yield compare(side, words, n)
                        words, n = [], []
                    side, key = s, k
                words.append(w.encode("latin-1"))
                n.append(c)
        if words:
            yield compare(side, words, n)

    return run


def _by_rest(rows: DataFrame, shared: int) -> DataFrame:
    """Near words of large blocks that part right after the block's letters: without the letter there (one of them, or both) they are
    the same, which is an equal join; letters are few, so a group is small."""
    u, w = F.col("turned"), F.substring(F.col("turned"), shared + 1, 1)
    whole = rows.select("side", "word", "n", w.alias("letter"), u.alias("rest"), F.lit(0).alias("cut"))
    less = rows.where(F.char_length(u) > shared).select("side", "word", "n", w.alias("letter"), F.concat(F.substring(u, 1, shared), F.substring(u, F.lit(shared + 2), F.char_length(u))).alias("rest"), F.lit(1).alias("cut"))
    all_ = staged(whole.unionByName(less), "spelling-rest")
    other = all_.select("side", "rest", F.col("word").alias("other"), F.col("n").alias("other_n"), F.col("letter").alias("other_letter"), F.col("cut").alias("other_cut"))
    both = all_.join(other.hint("merge"), ["side", "rest"]).where("cut + other_cut > 0 AND letter <> other_letter AND (side = 0 OR left(word, 3) <> left(other, 3))")
    return both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("w"))).alias("b")).select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.w").alias("best"))


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n_near, best_n, best) of the words (word, n) that have a near one, over all of their near words.

    A block of more than `block` words is dealt out by one more letter; what parts at that letter is found by an equal
    join. Rows may repeat a word: each has a share of its near words.
    """
    side = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("word").alias("turned")), F.struct(F.lit(1).alias("side"), F.reverse("word").alias("turned")))).alias("s")
    rest, deeper, parts = words.select("word", "n", side).select("word", "n", "s.side", "s.turned"), 0, []
    while True:
        key: Column = F.substring(F.col("turned"), F.lit(1), F.when(F.col("side") == 0, HEAD).otherwise(TAIL) + deeper)
        keyed = rest.withColumn("key", key)
        large = staged(keyed.groupBy("side", "key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > block).select("side", "key"), "spelling-large")
        some = bool(large.limit(1).count())
        cold = keyed.join(large.hint("merge"), ["side", "key"], "left_anti") if some else keyed
        dealt = cold.select("side", "key", "word", "n").repartition("side", "key").sortWithinPartitions("side", "key")
        parts.append(dealt.mapInArrow(_scan(deeper), SCANNED))
        if not some:
            break
        hot = staged(keyed.join(large.hint("merge"), ["side", "key"], "left_semi").drop("key"), "spelling-hot")
        parts += [_by_rest(hot.where(F.col("side") == s), (TAIL if s else HEAD) + deeper) for s in (0, 1)]
        rest, deeper = hot, deeper + 1
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("w"))).alias("b")).select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.w").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of the chain of forms (word, form) from each word. Each round doubles how far a word looks; n grows
    tenfold along a chain, so chains are short and have no rings."""
    reach = staged(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = reach.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = staged(reach.join(on.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        unstage(reach)
        reach = new.select("word", "root")
        reach._staged_path = new._staged_path
        if not new.where("moved").limit(1).count():
            return reach


def spelling_variants(docs: DataFrame, least: int = LEAST, times: int = 10, block: int = BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of `docs` (doc_id, text).

    A word's form is the near word of largest n (ties: the smallest in code-point order), if it comes `times` as often or more; its root is
    where the forms lead. Null and empty texts have no words, repeated rows count each time, an empty table gives no rows, and other
    columns are not looked at. Words may be as long as a text; a step of the comparison is done for each letter of the longest.
    """
    if least < HEAD + TAIL:
        raise ValueError(f"words of fewer than {HEAD + TAIL} letters may share neither beginning nor end")
    words = staged(vocabulary(docs.select("doc_id", "text"), least), "spelling-words")
    near = near_words(words, block)
    all_ = staged(words.join(near.hint("merge"), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("best_n") >= times * F.col("n"), F.struct(F.col("best").alias("form"), F.col("best_n").alias("form_n"))).alias("f")), "spelling-near")
    ends = roots(all_.where("f IS NOT NULL").select("word", "f.form"))
    return all_.join(ends.hint("merge"), "word", "left").select("word", "f.form", F.coalesce("root", "word").alias("root"), "n", "n_near", "f.form_n")
