"""The corpus pipeline: stages over `documents`, each calling one operator of the llm subpackage.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs. All but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import language_id
from ledgerloom.llm.common import fresh, staged, table
from ledgerloom.llm.exact_dedup import exact_dedup
from ledgerloom.llm.packing import pack
from ledgerloom.llm.pii import redact
from ledgerloom.llm.queries import tokenizer_path
from ledgerloom.llm.simhash import similar_groups


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a number for each row, written down, so that it stays the same whoever reads it, and the name of its column.
    Decisions about rows go by it: ids may be null or repeat."""
    rid = fresh(docs, "row")
    return staged(docs.withColumn(rid, F.monotonically_increasing_id()), "pipeline-rows"), rid


def _kept(rows: DataFrame, rid: str, keys: DataFrame) -> DataFrame:
    """The rows whose number is in `keys` (rid), without it."""
    return rows.join(keys.select(F.col("rid").alias(rid)).hint("merge"), rid, "left_semi").drop(rid)


def _first(rows: DataFrame, rid: str) -> Column:
    """The order in which rows of a group are preferred: by id, null last, of equal ids by the row's number."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(rid).alias("rid"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of which no learned language is likely, go. The model learns from
    the lang of docs; empty docs stay empty."""
    return language_id.accept(docs, language_id.train(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased, null as empty) the row with the smallest id stays, of those one; a null id is the
    largest. Other columns, whatever their names, stay as they are."""
    rows, rid = _keyed(docs)
    kept = exact_dedup(rows.select(_first(rows, rid).alias("first"), "text"), id_col="first", keep="min").where("kept")
    return _kept(rows, rid, kept.select("first.rid")).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays that links of 0.8 or more, of five-word shingles, connect: the one with the smallest id,
    of equal ids one; a null id is the largest. Other columns, whatever their names, stay as they are."""
    rows, rid = _keyed(docs)
    groups = similar_groups(rows.select(F.col(rid).alias("rid"), "text"))
    ids = rows.select(F.col(rid).alias("rid"), _first(rows, rid).alias("first"))
    first = groups.join(ids.hint("merge"), "rid").groupBy("root").agg(F.min("first").alias("first"))
    return _kept(rows, rid, first.select("first.rid")).select(*docs.columns)


def personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind in brackets; every document stays."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every token of every document left, in sequences of at most 2048."""
    return pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", language),
    ("exact dedup", exact),
    ("SimHash near-dedup", near),
    ("PII", personal),
    ("best-fit packing", packing),
]

#: SQL has no tokenizer and no recurrent network; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
