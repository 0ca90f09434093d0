"""Audit: changes of the queue, differences of states, integrity, actors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def capture_changes(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """A row for each key whose state differs between two versions: old and new state as JSON, who did it."""
    cols = sorted(set(old.columns) & set(new.columns) - {key})
    pack = lambda df, n: df.select(key, F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias(n), F.xxhash64(*cols).alias("h_" + n), *([F.col("resolved_by").alias("_by")] if n == "new_state" and "resolved_by" in df.columns else []))
    rows = pack(old, "old_state").join(pack(new, "new_state").hint("merge"), key).where("h_old_state <> h_new_state")
    actor = F.coalesce("_by", F.lit("system")) if "_by" in rows.columns else F.lit("system")
    return rows.select(F.lit("exceptionqueue").alias("entity_type"), F.col(key).alias("entity_id"), F.lit("UPDATE").alias("action"), actor.alias("actor"), "old_state", "new_state")


def changed_fields(old: Column, new: Column, ignore: tuple[str, ...] = ("updated_at",)) -> Column:
    """Sorted names of the fields that differ between two JSON states."""
    a, b = F.from_json(old, "map<string,string>"), F.from_json(new, "map<string,string>")
    a, b = (F.coalesce(m, F.create_map().cast("map<string,string>")) for m in (a, b))
    keys = F.array_except(F.array_union(F.map_keys(a), F.map_keys(b)), F.array(*[F.lit(i) for i in ignore]))
    return F.array_sort(F.filter(keys, lambda k: ~F.try_element_at(a, k).eqNullSafe(F.try_element_at(b, k))))


def audit_query(trail: DataFrame, entity_type: str | None = None, entity_id: str | None = None, actor: str | None = None, action: str | None = None, since: str | None = None, limit: int = 50, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """One page, newest first, and the total."""
    rows = trail
    for c, v in (("entity_type", entity_type), ("entity_id", entity_id), ("actor", actor), ("action", action)):
        if v is not None:
            rows = rows.where(F.col(c) == v)
    if since is not None:
        rows = rows.where(F.col("changed_at") >= F.lit(since).cast("timestamp"))
    return rows.orderBy(F.desc("changed_at"), "entity_id").offset(offset).limit(limit), rows.agg(F.count(F.lit(1)).alias("total"))


def audit_integrity(queue: DataFrame, trail: DataFrame, sample: int = 25) -> DataFrame:
    """Settled rows without an audit entry: how many, the share that has one (null without settled rows), a sample, and
    how many entries name no person."""
    settled = queue.where("state IN ('RESOLVED', 'REJECTED')").select("id").distinct()
    seen = trail.select(F.col("entity_id").alias("id")).distinct()
    marked = settled.join(seen.withColumn("seen", F.lit(True)).hint("merge"), "id", "left")
    counts = marked.agg(F.count(F.lit(1)).alias("settled"), F.count_if("seen").alias("audited"))
    missing = settled.join(seen.hint("merge"), "id", "left_anti").orderBy("id").limit(sample).agg(F.array_sort(F.collect_list("id")).alias("sample"))
    system = trail.agg(F.count_if(F.col("actor") == "system").alias("by_system"))
    share = F.round(F.try_divide(F.col("audited").cast("double"), F.nullif("settled", F.lit(0)).cast("double")), 4)
    return counts.join(F.broadcast(missing)).join(F.broadcast(system)).select("settled", "audited", (F.col("settled") - F.col("audited")).alias("missing"), share.alias("coverage"), "sample", "by_system")


def actor_activity(trail: DataFrame, limit: int = 50) -> DataFrame:
    return trail.groupBy("actor").agg(F.count(F.lit(1)).alias("changes"), F.min("changed_at").alias("first"), F.max("changed_at").alias("last")).orderBy(F.desc("changes"), "actor").limit(limit)
