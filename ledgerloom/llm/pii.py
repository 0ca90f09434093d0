"""Personal data: fixed patterns, and bootstrapped extraction of identifiers in like contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import staged
from ledgerloom.llm.spans import none, placed, running

KINDS = ("email", "ip", "card", "phone")
#: The contract's patterns. Runs are taken possessively, and a run is entered only at its start or where the
#: last match ended: the matches are the same, without quadratic retries or deep recursion on long runs.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without a match of these has no span of the kind that can pass.
NEEDS = {
    "email": r"[A-Za-z0-9._%+-]@[A-Za-z0-9-]",
    "ip": r"[0-9]\.[0-9]",
    "card": r"[0-9](?:[\x20-]?[0-9]){11}",
    "phone": r"\+[0-9][\x20().0-9-]",
}
#: What may be an identifier: figures in groups, with what may part them, and words with figures or an at sign.
CANDIDATE = r"[+(]{0,2}+[0-9]++(?:[\x20()./:-]{1,3}+[0-9]++)++(?![^\s\p{Punct}])|(?<![^\s])[^\s0-9@]*+[0-9@][^\s]*+"
#: How sure a pattern or an identifier must be, how many known identifiers a pattern must have been seen with, and what an identifier
#: of which nothing is known counts against a pattern.
SURE, LEAST, UNKNOWN = 0.75, 5, 0.5
SPAN = "struct<start:int,ord:int,end:int,kind:string>"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(d: Column) -> Column:
    figures = F.filter(F.split(F.reverse(d), ""), lambda x: x != "")
    weighed = F.transform(figures, lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(2 * x.cast("int") - F.when(x.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(weighed, F.lit(0), lambda a, x: a + x) % 10 == 0


def passes(kind: str, m: Column) -> Column:
    """The test that a match has to stand."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        short = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(m, r"\."), lambda p: F.when(F.length(short(p)) <= 3, F.concat(F.lit("0"), short(p)).cast("int") <= 255).otherwise(False))
    n = F.length(_digits(m))
    if kind == "card":
        return F.when(n.between(12, 19), _luhn(_digits(m))).otherwise(False)
    return n.between(9, 15)


def _words(gap: Column, before: bool) -> Column:
    """The two words nearest in a gap, lower-cased, the nearest first: letters only. A gap without a letter gives none."""
    words = F.regexp_extract_all(F.lower(gap), F.lit(r"[\p{L}]+"), F.lit(0))
    return F.slice(F.reverse(words), 1, 2) if before else F.slice(words, 1, 2)


def patterns(gap: Column, after: Column) -> Column:
    """The lexical patterns that a place matches: the word before, the two before, the word after, and both sides."""
    b, a = _words(gap, True), _words(after, False)
    one, two, next_ = F.get(b, 0), F.get(b, 1), F.get(a, 0)
    near = F.concat(F.lit("<"), one)
    made = F.array(near, F.concat(F.lit("<"), two, F.lit(" "), one), F.concat(F.lit(">"), next_), F.concat(near, F.lit(" > "), next_))
    return F.filter(made, lambda p: p.isNotNull())


def base_found(text: Column) -> Column:
    """array<struct<span, m, gap, after>> of the base patterns' matches that pass, of all kinds, by start, then kind as listed."""

    def of(o: int, k: str) -> Column:
        ok = F.filter(placed(text, PATTERNS[k]), lambda x: passes(k, x["m"]))
        span = lambda x: F.struct(x["start"].alias("start"), F.lit(o).alias("ord"), (x["start"] + F.char_length(x["m"])).alias("end"), F.lit(k).alias("kind"))
        made = F.transform(ok, lambda x: F.struct(span(x).alias("span"), x["m"].alias("m"), x["gap"].alias("gap"), x["after"].alias("after")))
        return F.when(text.rlike(NEEDS[k]), made).otherwise(F.array().cast(f"array<struct<span:{SPAN},m:string,gap:string,after:string>>"))

    return F.array_sort(F.concat(*[of(o, k) for o, k in enumerate(KINDS)]))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def instances(marked: DataFrame) -> DataFrame:
    """(rid, m, start, end, seed, pattern): the known identifiers, `seed` their kind, and what else may be one, at each pattern
    that its place matches. What overlaps a base span is known already; an unknown one has five figures or an at sign,
    without the punctuation around it."""
    seeds = marked.select("rid", F.explode("found").alias("f")).select("rid", F.lower("f.m").alias("m"), F.col("f.span.start").alias("start"), F.col("f.span.end").alias("end"), F.col("f.span.kind").alias("seed"), F.explode(patterns(F.col("f.gap"), F.col("f.after"))).alias("pattern"))
    w = marked.where(F.size("words") > 0).select("rid", F.transform("found", lambda f: f["span"]).alias("spans"), F.explode("words").alias("w"))
    lead = F.char_length(F.regexp_extract("w.m", r"^[^\p{L}\p{N}+(]*", 0))
    w = w.withColumn("start", (F.col("w.start") + lead).cast("int")).withColumn("m", F.regexp_extract("w.m", r"^[^\p{L}\p{N}+(]*(.*?)[^\p{L}\p{N}]*$", 1))
    w = w.withColumn("end", (F.col("start") + F.char_length("m")).cast("int")).where((F.length(_digits(F.col("m"))) >= 5) | F.col("m").contains("@"))
    free = w.where(~F.exists("spans", lambda s: (s["start"] < F.col("end")) & (s["end"] > F.col("start"))))
    unknown = free.select("rid", F.lower("m").alias("m"), "start", "end", F.lit(None).cast("string").alias("seed"), F.explode(patterns(F.col("w.gap"), F.col("w.after"))).alias("pattern"))
    return seeds.unionByName(unknown)


def bootstrap(seen: DataFrame, rounds: int = 3, least: int = LEAST, sure: float = SURE, unknown: float = UNKNOWN) -> DataFrame:
    """(m, kind, score) of unknown identifiers that share patterns with known ones. `seen` has m, seed and pattern.

    Each round scores the graph of patterns and identifiers from both ends. A pattern's confidence in a kind is the sum of
    its identifiers' scores over their weights: a seed of the kind scores and weighs 1, a seed of another kind weighs 1, an
    unknown one scores and weighs what it was given in the last round, if at all, and `unknown` else. Patterns that have
    `least` different seeds of the kind and a confidence of `sure` pass it on, and an identifier takes the best of its
    patterns. So what one round discovers supports the patterns of the next. Identifiers are counted by their
    text, so copies of a document weigh once.
    """
    edges = staged(seen.groupBy("pattern", "m").agg(F.max("seed").alias("seed")), "pii-edges")
    kinds = F.explode(F.array(*[F.lit(k) for k in KINDS])).alias("kind")
    counted = edges.select("pattern", "m", "seed", kinds)
    score = None
    for _ in range(rounds):
        known = counted.withColumn("score", F.lit(None).cast("double")) if score is None else counted.join(score.hint("merge"), ["m", "kind"], "left")
        own = F.col("seed") == F.col("kind")
        s = F.when(own, 1.0).when(F.col("seed").isNotNull(), 0.0).otherwise(F.coalesce("score", F.lit(0.0)))
        w = F.when(F.col("seed").isNotNull(), 1.0).otherwise(F.coalesce("score", F.lit(unknown)))
        told = known.groupBy("pattern", "kind").agg((F.sum(s) / F.sum(w)).alias("conf"), F.count_if(F.coalesce(own, F.lit(False))).alias("seeds"))
        told = told.where((F.col("seeds") >= least) & (F.col("conf") >= sure)).select("pattern", "kind", "conf")
        score = staged(edges.where("seed IS NULL").join(told.hint("merge"), "pattern").groupBy("m", "kind").agg(F.max("conf").alias("score")), "pii-scores")
    return score.groupBy("m").agg(F.max(F.struct("score", "kind")).alias("b")).select("m", "b.kind", "b.score")


def find_pii(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(doc, base, spans) for every row of docs (text, ...): doc is a struct of its columns, those of `keep` if not all,
    base and spans are arrays of SPAN.

    Positions are code points, ends exclusive. Null and empty texts have no spans; kinds may overlap,
    base spans of one kind don't; very long runs of digits or letters are read once; repeated rows and
    null ids are rows of their own; columns of any name are carried; an empty table gives an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    carried = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)])
    words = F.when(text.rlike("[0-9@]"), placed(text, CANDIDATE)).otherwise(none())
    marked = staged(docs.select(F.monotonically_increasing_id().alias("rid"), carried.alias("doc"), base_found(text).alias("found"), words.alias("words")), "pii-base")
    seen = staged(instances(marked.select("rid", "found", "words")), "pii-seen")
    # Staged, so that both sides of the join are shuffled for it and an identifier that comes often can be split.
    best = staged(bootstrap(seen.select("m", "seed", "pattern")), "pii-best")
    order = F.create_map(*[x for o, k in enumerate(KINDS) for x in (F.lit(k), F.lit(o))])
    new = seen.where("seed IS NULL").select("rid", "m", "start", "end").join(best.hint("merge"), "m")
    added = new.groupBy("rid").agg(F.collect_set(F.struct("start", order["kind"].alias("ord"), "end", "kind")).cast(f"array<{SPAN}>").alias("added"))
    out = marked.select("rid", "doc", F.transform("found", lambda f: f["span"]).alias("base")).join(added.hint("merge"), "rid", "left")
    return out.select("doc", "base", F.array_sort(F.concat("base", F.coalesce("added", F.array().cast(f"array<{SPAN}>")))).alias("spans"))


def pii_report(docs: DataFrame) -> DataFrame:
    """Counts of base spans by kind, the digest of the base spans, the list of all spans, and how many these are and
    how many of them the contexts added."""
    rows = find_pii(docs.select("doc_id", "text"), keep=["doc_id"])
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    n = F.size("spans").cast("long")
    return rows.select("doc.doc_id", *[count(k) for k in KINDS], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), n.alias("n_spans"), (n - F.size("base")).alias("n_added"))


def redact(docs: DataFrame) -> DataFrame:
    """The same rows with every span of personal data replaced by its kind in brackets. Spans
    that overlap become one, named after the first. n_chars follows the text where there is one."""
    rows = find_pii(docs)
    # How far the spans before each reach; one that begins within is part of them.
    reach = running(F.transform("spans", lambda s: s["end"]), lambda a, x: F.greatest(a, x), F.lit(0))
    reached = F.filter(F.zip_with("spans", reach, lambda s, at: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), at.alias("at"))), lambda s: s["start"] >= s["at"])
    text = F.col("doc.text")
    cut = F.transform("reached", lambda s: F.concat(F.substr(text, s["at"] + 1, s["start"] - s["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]")))
    rest = F.substr(text, F.array_max(F.transform("spans", lambda s: s["end"])) + 1, F.char_length(text))
    some = F.size("spans") > 0
    rows = rows.withColumn("reached", F.when(some, reached)).withColumn("redacted", F.when(some, F.concat(F.array_join(cut, ""), rest)).otherwise(text))
    new = {"text": F.col("redacted")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(some, F.char_length("redacted").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("doc.n_chars"))
    return rows.select(*[new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])
