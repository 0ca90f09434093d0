import random
import re
import zlib
from collections import Counter

import pytest

from ledgerloom.llm.spelling import near_words, pairs_in_blocks, spelling_variants

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, word string, n string"


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    p = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[p:] == b[p + 1 :] or len(a) == len(b) and a[p + 1 :] == b[p + 1 :]


def brute(docs):
    count = Counter()
    for i, text in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{i}:{w}".encode()) if i is not None else 1
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += 1
    words = {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}
    near = {w: [o for o in words if one_edit(w, o)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best and words[best] >= 10 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def check(spark, docs, **kw):
    df = spark.createDataFrame([(i, t, "own", "n") for i, t in docs], SCHEMA)
    got = sorted((tuple(r) for r in spelling_variants(df, **kw).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr)
    assert got == brute(docs)
    return got


def test_variants_equal_brute_force(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcé") for _ in range(rng.randint(6, 9))) for _ in range(120)] + ["repeated", "reepeated", "repeeted"]
    docs = []
    for i in range(60):
        words = []
        for _ in range(80):
            w = rng.choice(base[: rng.choice([3, 40, 123])])
            if rng.random() < 0.1:
                p = rng.randrange(len(w))
                w = rng.choice([w[:p] + w[p + 1 :], w[:p] + rng.choice("abcéÀ") + w[p:], w[:p] + "x" + w[p + 1 :]])
            words.append(w.upper() if rng.random() < 0.1 else w)
        docs.append((rng.choice([i, i, None]), " ".join(words) + "\n"))
    docs += [(5, None), (6, ""), (7, "123 ???"), *docs[:3]]
    got = check(spark, docs)
    assert check(spark, docs, block=5) == got  # blocks that go on letter by letter
    assert sum(r[1] is not None for r in got) > 5


def test_chains_of_forms_and_a_hot_beginning(spark):
    # One beginning holds nearly all words, and forms lead on and on.
    rng = random.Random(2)
    stem = ["interna" + "".join(rng.choice("abcdef") for _ in range(3)) for _ in range(300)]
    docs = [(1, " ".join(stem + stem))]
    docs += [(None, " ".join(["chainzz"] * 2 + ["chainzy"] * 25 + ["chainxy"] * 260 + ["chawnxy"] * 2700))]
    got = {r[0]: r for r in check(spark, docs, block=20)}
    assert got["chainzz"][1:3] == ("chainzy", "chawnxy")


def test_nothing_and_long_words(spark):
    assert check(spark, []) == []
    long = "ab" * 4000
    got = check(spark, [(None, f"{long} {long}"), (None, f"{long}c {long}c " * 12), (None, f"{long[:3999]}é{long[3999:]} " * 2)])
    assert [r[4] for r in got if r[0] == long] == [2]


@pytest.mark.parametrize("letters", ["ab", "abc", "abcdefgh"])
def test_pairs_in_blocks(letters):
    rng = random.Random(len(letters))
    words = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(3, 8))).encode() for _ in range(300)})
    for shared in (0, 1, 3):
        a, b = pairs_in_blocks(words, shared) if shared else pairs_in_blocks([b"-" + w for w in words], 1)
        want = {(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if words[i][:shared] == words[j][:shared] and one_edit(words[i].decode(), words[j].decode())}
        assert set(zip(a.tolist(), b.tolist())) == want and len(a) == len(want)


def test_near_words_of_one_word(spark):
    assert near_words(spark.createDataFrame([("abcdefg", 3)], "word string, n long")).count() == 0
