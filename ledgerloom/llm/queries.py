"""The registered query of each operator, and its SQL twin where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.llm import language_id, toxicity
from ledgerloom.llm.common import doc_bucket, table
from ledgerloom.llm.exact_dedup import exact_dedup
from ledgerloom.llm.fingerprints import compare_with_edits
from ledgerloom.llm.packing import pack
from ledgerloom.llm.pii import pii_report
from ledgerloom.llm.secrets import scan
from ledgerloom.llm.sentencepieces import digest_documents
from ledgerloom.llm.simhash import simhash_groups
from ledgerloom.llm.spelling import spelling_variants
from ledgerloom.llm.substring_dedup import cut_repeats, digests, kept_text
from ledgerloom.llm.topk import top_k
from ledgerloom.llm.whitening import whitened


def tokenizer_path(name):
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pack(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op2_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))


OP2_SQL = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), r AS (
  SELECT doc_id, t, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM r
"""


def op3_substring_dedup(spark, sf_dir):
    cut = cut_repeats(table(spark, sf_dir, "documents"))
    return cut.select(*digests(cut), kept_text(cut["kept"]).alias("text"), "spans")


def op4_simhash(spark, sf_dir):
    return simhash_groups(table(spark, sf_dir, "documents"))


def op5_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(doc_bucket(F.col("doc_id"), 3) == 1, F.lit(False))
    model = language_id.train(docs, ~held_out)
    return language_id.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op6_sentencepiece(spark, sf_dir):
    return digest_documents(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op7_secrets(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents"))


def op8_pii(spark, sf_dir):
    return pii_report(table(spark, sf_dir, "documents"))


def op9_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(doc_bucket(F.col("doc_id"), 4) == 2, F.lit(False))
    model = toxicity.train(docs, labels, ~held_out)
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op10_fingerprints(spark, sf_dir):
    return compare_with_edits(table(spark, sf_dir, "documents"))


def op11_spelling(spark, sf_dir):
    return spelling_variants(table(spark, sf_dir, "documents"))


# Two words are one edit apart where one of them without a letter is the other, or both are the same without the letter at one place.
OP11_SQL = """
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]{7,}')) AS run FROM documents
), each AS (
  SELECT doc_id, run, count(*) AS c FROM runs GROUP BY ALL
), crc_table AS (
  SELECT list(list_reduce(range(8), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) ORDER BY i) AS t FROM (SELECT unnest(range(256)) AS i)
), bytes AS (
  SELECT doc_id, run, c, list_concat(list_transform(string_split(doc_id || ':', ''), lambda x: unicode(x)::BIGINT), flatten(list_transform(string_split(run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195, unicode(x)::BIGINT - 64] END))) AS b FROM each
), hashed AS (
  SELECT doc_id, run, c, xor(list_reduce(b, lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]), 4294967295), 4294967295) AS h FROM bytes, crc_table
), words AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, sum(c)::BIGINT AS n FROM hashed GROUP BY 1
), vocabulary AS (
  SELECT word, n FROM words WHERE length(word) >= 7 AND n >= 2
), cuts AS (
  SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM vocabulary)
), near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN vocabulary b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cuts a JOIN vocabulary b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, max(other_n) AS best_n, arg_min(other, (-other_n, other)) AS best FROM near GROUP BY word
), formed AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * n THEN best END AS form, CASE WHEN best_n >= 10 * n THEN best_n END AS form_n FROM vocabulary LEFT JOIN best USING (word)
), walk AS (
  SELECT word, word AS root FROM formed
  UNION ALL SELECT walk.word, formed.form FROM walk JOIN formed ON formed.word = walk.root WHERE formed.form IS NOT NULL
)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM formed f JOIN (SELECT walk.word, walk.root FROM walk JOIN formed ON formed.word = walk.root WHERE formed.form IS NULL) r ON r.word = f.word
"""


def op12_topk(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP12_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""


def op13_whitening(spark, sf_dir):
    return whitened(table(spark, sf_dir, "embeddings"))


def queries():
    return {
        "op1_pack": op1_pack,
        "op2_exact_dedup": op2_exact_dedup,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_simhash": op4_simhash,
        "op5_language_id": op5_language_id,
        "op6_sentencepiece": op6_sentencepiece,
        "op7_secrets": op7_secrets,
        "op8_pii": op8_pii,
        "op9_toxicity": op9_toxicity,
        "op10_fingerprints": op10_fingerprints,
        "op11_spelling": op11_spelling,
        "op12_topk": op12_topk,
        "op13_whitening": op13_whitening,
    }


def oracle_sql():
    return {"op2_exact_dedup": OP2_SQL, "op11_spelling": OP11_SQL, "op12_topk": OP12_SQL}
