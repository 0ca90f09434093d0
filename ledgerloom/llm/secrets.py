"""Secret scans: candidate strings, and a random forest that removes false positives."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import doc_bucket, staged
from ledgerloom.llm.spans import none, placed

# What the names of secrets have in them.
NAMES = r"(?i:token|secret|passw|passphrase|pwd|api[_-]?key|access[_-]?key|private[_-]?key|credential|auth)"
#: A name that has one of these within its first 40 characters, and what assigns a value to it.
ASSIGNS = rf"(?<![A-Za-z0-9_.-])(?=[A-Za-z0-9_.-]{{0,40}}?{NAMES})[A-Za-z0-9_.-]++[\"']?\s{{0,3}}+(?:=>|:=|[=:])\s{{0,3}}+"
#: The word of a header that a credential follows.
HEADER = r"(?<![A-Za-z0-9_.-])(?i:bearer|basic)\s++"
#: What stands before the password of a URL: its scheme and the user, who may be missing.
URL = r"""(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]*+://[^\s:/@"'<>]*+:"""
PASSWORD = r"""[^\s/@"'<>]{3,}+(?=@[A-Za-z0-9\[])"""
#: A line that gives a pass phrase: such a name, and two to eight words up to the end of the line.
PHRASE = rf"(?<![^\n])[ \t]*+(?=[A-Za-z0-9_.-]{{0,40}}?(?i:secret|passw|passphrase|pwd)){ASSIGNS}" + r"""[^\s"',;]{2,}+(?:[ \t]++[^\s"',;]{2,}+){1,7}+(?=[ \t\r]*+(?:\n|\z))"""
BEGIN, END = (rf"-----{word} (?:[A-Z0-9]++ ){{0,4}}?PRIVATE KEY(?: BLOCK)?-----" for word in ("BEGIN", "END"))
#: Lines of a key block that has lost its end: headers, and runs of sixteen or more; line ends may be written as in JSON.
LINES = r"(?:(?:\s|\\[nr])++(?:[A-Z][A-Za-z-]{2,20}+: [^\n\\]{1,80}+|[A-Za-z0-9+/]{16,}+={0,2}+))++"
#: A key block, whole (with what headers it has) or without its end, the password in a URL, a pass phrase, a value that is assigned (in quotes, or up to
#: white space) or follows a header word, or a run of sixteen or more characters that keys are written with, one of them at
#: least a digit. `=` only ends a run.
CANDIDATE = "|".join(
    [
        BEGIN + r"(?:[^-]++|-(?!----))*+" + END,
        BEGIN + LINES,
        URL + PASSWORD,
        PHRASE,
        HEADER + r"[A-Za-z0-9._~+/-]{8,}+=*+",
        ASSIGNS + rf"(?![\"']?{URL}{PASSWORD})" + r"""(?:"[^"\n]{6,}+"|'[^'\n]{6,}+'|(?!(?i:bearer|basic)\s)[^\s"',;]{6,}+)""",
        r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])[A-Za-z0-9_+/-]{16,}+={0,2}+",
    ]
)
#: What of a candidate stands before its value.
LEAD = rf"^(?:{HEADER}|{URL}|[ \t]*+{ASSIGNS}[\"']?)"
FEATURES = [
    "length",
    "transitions",
    "digits",
    "upper",
    "vowels",
    "distinct",
    "hex",
    "coverage",
    "in_path",
    "slashes",
    "word_before",
    "word_after",
    "known_before",
    "known_after",
]


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, start, value, before, after, named) of every candidate in every whole text. The name that a value is assigned
    to belongs to neither side: before ends in front of it, and `named` says whether there is one."""
    text = F.coalesce(F.col("text"), F.lit(""))
    # A text without a long run, a name and a URL has no candidate.
    at = F.when(text.rlike("[A-Za-z0-9_+/-]{16}") | text.rlike(NAMES) | text.rlike("(?i:bearer|basic)") | text.contains("://"), placed(text, CANDIDATE)).otherwise(none())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(at).alias("f"))
    lead = F.regexp_extract("f.m", LEAD, 0)
    value = F.substr("f.m", F.char_length(lead) + 1, F.char_length("f.m"))
    value = F.when(lead.rlike("[\"']$"), F.left(value, F.char_length(value) - 1)).otherwise(value)
    return rows.select("doc_id", (F.col("f.start") + F.char_length(lead)).alias("start"), value.alias("value"), F.col("f.gap").alias("before"), F.col("f.after").alias("after"), ((lead != "") | F.col("f.m").startswith("-----BEGIN ")).alias("named"))


def dictionary(docs: DataFrame, size: int = 1000) -> DataFrame:
    """The `size` most frequent words of three letters or more, counted over all documents."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"\p{L}{3,}+"), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(size).select("word")


def features(found: DataFrame, words: DataFrame) -> DataFrame:
    """Findings with their features and label. `words` has at most a thousand rows or so.

    The label is whether a secret's name or header stands at the value. No feature looks at it: the neighbouring words are
    those in front of the name and behind the value, and quotes are no feature."""
    v, n = F.col("value"), F.char_length("value")
    share = lambda pattern: F.regexp_count(v, F.lit(pattern)) / n
    # Where letters turn into figures, or small letters into large ones, or back.
    turn = r"(?<=[a-z])(?=[0-9A-Z])|(?<=[A-Z])(?=[0-9a-z])|(?<=[0-9])(?=[A-Za-z])"
    before = F.lower(F.regexp_extract("before", r"(\p{L}+)[^\p{L}]{0,6}$", 1))
    after = F.lower(F.regexp_extract("after", r"^[^\p{L}]{0,6}(\p{L}+)", 1))
    rows = found.withColumn("fid", F.monotonically_increasing_id()).withColumn("_before", before).withColumn("_after", after)
    rows = staged(rows, "secret-findings")
    parts = rows.select("fid", F.explode(F.regexp_extract_all(F.lower("value"), F.lit("[a-z]{3,}+"), F.lit(0))).alias("word"))
    covered = parts.join(F.broadcast(words), "word").groupBy("fid").agg(F.sum(F.char_length("word")).alias("_covered"))
    known = lambda side: F.broadcast(words.select(F.col("word").alias(f"_{side}"), F.lit(1.0).alias(f"_known_{side}")))
    out = rows.join(covered.hint("merge"), "fid", "left").join(known("before"), "_before", "left").join(known("after"), "_after", "left")
    return out.select(
        "doc_id",
        "start",
        "value",
        F.col("named").cast("double").alias("label"),
        n.cast("double").alias("length"),
        share(turn).alias("transitions"),
        share("[0-9]").alias("digits"),
        share("[A-Z]").alias("upper"),
        share("(?i)[aeiou]").alias("vowels"),
        (F.size(F.array_distinct(F.filter(F.split("value", ""), lambda c: c != ""))) / n).alias("distinct"),
        v.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$").cast("double").alias("hex"),
        (F.coalesce("_covered", F.lit(0)) / n).alias("coverage"),
        (F.col("before").rlike(r"[/\\.]$|://\S*$") | v.rlike(r"^\.{0,2}/|^\w+://")).cast("double").alias("in_path"),
        share("/").alias("slashes"),
        F.char_length("_before").cast("double").alias("word_before"),
        F.char_length("_after").cast("double").alias("word_after"),
        F.coalesce("_known_before", F.lit(0.0)).alias("known_before"),
        F.coalesce("_known_after", F.lit(0.0)).alias("known_after"),
    )


#: Features of a value that know nothing of where it stands.
FORM = ["length", "transitions", "digits", "upper", "vowels", "distinct", "hex", "coverage", "slashes"]


def _assembled(rows: DataFrame, columns: list[str] = FEATURES) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep").transform(rows)


def fitted(rows: DataFrame, columns: list[str], max_rows: int, trees: int, depth: int) -> RandomForestClassificationModel | None:
    """A forest on at most about max_rows labelled findings of each label, those of least hash. None where only one label is seen."""
    counts = {r.label: r.n for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return None
    h = F.pmod(F.xxhash64("doc_id", "start", "value"), F.lit(1 << 30))
    keep = F.lit(False)
    for label, n in counts.items():
        keep = keep | ((F.col("label") == label) & (h < int(min(1.0, max_rows / n) * (1 << 30))))
    weight = F.when(F.col("label") == 1.0, min(counts.values()) / counts[1.0]).otherwise(min(counts.values()) / counts[0.0])
    sample = _assembled(rows.where(keep).withColumn("weight", weight), columns)
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=7, weightCol="weight").fit(sample)


def train(rows: DataFrame, max_rows: int = 20_000, trees: int = 20, depth: int = 6, doubt: float = 0.5) -> RandomForestClassificationModel | None:
    """Learning from positive and unlabelled findings, in two steps. That a value stands at no name does not say that it is no secret,
    so a first forest, over the form of the value alone, tells which unnamed values look like named ones (`doubt` or more);
    these are no examples. The second forest sees all features, and learns from the named values and the unnamed ones that are
    left. Where none is left it learns from all. None where only one label is seen."""
    form = fitted(rows, FORM, max_rows, trees, depth)
    if form is None:
        return None
    sure = (F.col("label") == 1.0) | (vector_to_array("probability")[1] < doubt)
    clear = staged(form.transform(_assembled(rows, FORM)).where(sure).select(*rows.columns), "secret-clear")
    return fitted(clear, FEATURES, max_rows, trees, depth) or fitted(rows, FEATURES, max_rows, trees, depth)


def scored(rows: DataFrame, model: RandomForestClassificationModel | None) -> DataFrame:
    p: Column = F.col("label")
    if model is not None:
        rows = model.transform(_assembled(rows))
        p = vector_to_array("probability")[1]
    return rows.withColumn("p", p)


def scan(docs: DataFrame, sure: float = 0.5) -> DataFrame:
    """One row per candidate: doc_id, start (code points), n_chars, value_sha256, assigned, held_out, score, secret.

    Candidates come from every whole text. There are no reviewed findings, so the corpus labels its own: values that stand
    at a secret's name, after a header word, or in a key block, against all other candidates. The forest learns from those of
    the documents whose crc32(doc_id as text) mod 5 is not 0; the others are held out. Unnamed values that have the form of named ones
    are no examples of either (see `train`). It sees length, character transitions and
    classes, how much of the string common words cover, paths, and the words around, but not the name; so a finding
    without one can still be a secret, and a value with one that looks like a word or a path is dropped. A key block is a secret by
    its form.

    Not searched for: values under six characters (three in URLs), passwords in prose of which no name and sign of assignment stands before, pass
    phrases in the middle of a line without quotes (the first word is found), and keys in runs that other characters break up. Values of a form
    that stands at a name nowhere in the table are candidates, but the forest has no example to know them by.

    Null and empty texts have no rows; long runs are one candidate; repeated rows give repeated
    findings; null ids pass through and are not held out; other columns are ignored; an empty table gives an empty
    result; where no label or only one is seen the label itself decides.
    """
    rows = features(candidates(docs), staged(dictionary(docs), "secret-words"))
    held = F.coalesce(doc_bucket(F.col("doc_id"), 5) == 0, F.lit(False))
    rows = staged(rows.withColumn("held_out", held), "secret-features")
    p = F.when(F.col("value").startswith("-----BEGIN "), 1.0).otherwise(F.col("p"))
    return scored(rows, train(rows.where("NOT held_out"))).select(
        "doc_id", "start", F.char_length("value").alias("n_chars"), F.sha2("value", 256).alias("value_sha256"), (F.col("label") == 1.0).alias("assigned"), "held_out", p.alias("score"), (p >= sure).alias("secret")
    )
