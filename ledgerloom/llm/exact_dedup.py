"""Exact dedup: 128-bit content hash, bytes compared inside groups, one row of each text stays."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import lower_ascii


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """One row per input row: id, keep id, group_size, kept, text_sha256.

    Texts are equal when their bytes are, after lower-casing A-Z. Rows are grouped on the 128-bit
    hash *and* the text itself, so a group is compared byte for byte while it is being formed and
    a collision of the hash makes two groups. The partial aggregate runs before the shuffle: a
    text held by a third of all rows leaves each task as one row. Members then find their group
    by hash and digest alone, without their text; that join may be split by AQE.

    Null text counts as empty; null ids never win against another id; of rows that repeat both id
    and text one is kept; an empty table gives an empty result; other columns are not looked at.
    """
    best = F.max if keep == "max" else F.min
    # Only what is needed, under names that cannot clash.
    rows = docs.select(F.col(id_col).alias("_id"), lower_ascii(F.coalesce(F.col(text_col), F.lit(""))).alias("_norm"))
    hashed = rows.withColumn("_h", F.unhex(F.md5("_norm")))
    groups = (
        hashed.groupBy("_h", "_norm")
        .agg(F.count(F.lit(1)).alias("_n"), best("_id").alias("_keep"))
        .select("_h", F.sha2("_norm", 256).alias("_sha"), "_n", "_keep")
    )
    members = hashed.select("_id", "_h", F.sha2("_norm", 256).alias("_sha"))
    joined = members.join(groups.hint("merge"), ["_h", "_sha"])
    # Rows that repeat id and text: the first of them is the row that stays.
    copy = F.row_number().over(Window.partitionBy("_id", "_sha").orderBy("_h"))
    return joined.withColumn("_copy", copy).select(
        F.col("_id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.col("_n").alias("group_size"),
        (F.col("_id").eqNullSafe(F.col("_keep")) & (F.col("_copy") == 1)).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )
