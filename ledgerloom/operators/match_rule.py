"""First matching layer: one-to-one pairs of equal reference, amount and date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.normalize import clean_string
from ledgerloom.operators.ranks import KEY_ROWS, frequent, numbered

INTERNAL = ("erp",)
KEY = ["_ref", "_amount", "_date"]


def split_sides(txns: DataFrame, internal: tuple[str, ...] = INTERNAL) -> tuple[DataFrame, DataFrame]:
    """Internal and external rows; without a source column all rows are internal."""
    if "source_type" not in txns.columns:
        return txns, txns.limit(0)
    inside = F.coalesce(F.col("source_type").isin(*internal), F.lit(False))
    return txns.where(inside), txns.where(~inside)


def quantise_amount(c: Column) -> Column:
    """Two places, half up; what is no number is null."""
    return c.try_cast("decimal(18,2)")


def match_key(side: DataFrame) -> DataFrame:
    """Rows that can match at all, with their key: a reference, an amount and a date."""
    keyed = side.withColumns({"_ref": clean_string(F.col("reference_code")), "_amount": quantise_amount(F.col("amount")), "_date": F.col("txn_date").cast("date")})
    return keyed.where(F.col("_ref").isNotNull() & F.col("_amount").isNotNull() & F.col("_date").isNotNull())


def rule_match(internal: DataFrame, external: DataFrame, same_currency: bool = False, dated: bool = False, key_rows: int = KEY_ROWS) -> DataFrame:
    """(internal_id, external_id, confidence, match_type; matched_on, their date, if `dated`): the k-th internal row of a key pairs with the k-th
    external one, by id; the surplus of either side stays over. The rows of a key of more than `key_rows` are numbered by many
    tasks, and the join is on key and number, so no key is one task's."""
    key = KEY + (["currency"] if same_currency else [])
    left, right = match_key(internal).select(*key, F.col("id").alias("internal_id")), match_key(external).select(*key, F.col("id").alias("external_id"))
    often = frequent(left.select(*key).unionByName(right.select(*key)), key, key_rows)
    pairs = numbered(left, key, [F.col("internal_id")], often).join(numbered(right, key, [F.col("external_id")], often).hint("merge"), [*key, "_n"])
    return pairs.select("internal_id", "external_id", F.lit(1.0).alias("confidence"), F.lit("RULE").alias("match_type"), *([F.col("_date").alias("matched_on")] if dated else []))


def residual(side: DataFrame, pairs: DataFrame, column: str) -> DataFrame:
    """Rows of a side that are in no pair."""
    return side.join(pairs.select(F.col(column).alias("id")).hint("merge"), "id", "left_anti")
