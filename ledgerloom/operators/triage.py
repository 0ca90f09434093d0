"""Triage of what was not matched: features, rule classes, suggested resolutions, decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.normalize import clean_string, format_money, jaccard_tokens
from ledgerloom.operators.score import reference_agreement

# The categories and the features of an exception.
CATEGORIES = ["PARTIAL_PAYMENT", "SPLIT_SETTLEMENT", "MISSING_REFERENCE_CODE", "TIMING_DIFFERENCE"]
FEATURES = [
    "amount_ratio",
    "description_similarity",
    "has_reference_code",
    "date_delta_days",
    "counterpart_count",
    "amount_shortfall",
    "best_confidence",
    "reference_agreement",
    "log_amount",
    "is_internal",
]
EQUAL, DRIFT_DAYS = 0.01, 3
# What is proposed for each category.
PATHWAYS = {
    "PARTIAL_PAYMENT": ("POST_PARTIAL_JOURNAL", "Propose partial-match journal entry; flag remaining balance for follow-up"),
    "SPLIT_SETTLEMENT": ("ALLOCATE_MULTI_LINE", "Open multi-line allocation resolution across the target obligations"),
    "MISSING_REFERENCE_CODE": ("ASSIGN_REFERENCE", "Surface likely counterpart candidates for manual reference assignment"),
    "TIMING_DIFFERENCE": ("HOLD_PENDING_SETTLEMENT", "Suggest matching across accounting periods; hold pending settlement date"),
}


def nominated_ids(best: Column, ids: Column) -> Column:
    """The best counterpart first, then the candidates, none twice."""
    return F.array_distinct(F.array_compact(F.concat(F.array(best), F.coalesce(ids, F.array().cast("array<string>")))))


def load_open_exceptions(queue: DataFrame, txns: DataFrame, limit: int | None = None) -> DataFrame:
    """Open rows, oldest first, with their transaction and an array of the nominated counterparts.
    `queue` has id, transaction_id, state, created_at, best_counterpart_id, candidate_ids, best_confidence."""
    open_ = queue.where("state = 'OPEN'").orderBy("created_at", "id")
    open_ = open_.limit(limit) if limit else open_
    named = open_.withColumn("nominated", nominated_ids(F.col("best_counterpart_id"), F.col("candidate_ids")))
    legs = named.select("id", F.posexplode("nominated").alias("nth", "other"))
    t = txns.select(F.col("id").alias("other"), *[F.col(c) for c in ("amount", "txn_date", "description", "reference_code")])
    found = legs.join(t.hint("merge"), "other").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("nth", "other", "amount", "txn_date", "description", "reference_code"))).alias("counterparts"))
    own = txns.select(F.col("id").alias("transaction_id"), "amount", "txn_date", "description", "reference_code", "source_type", "currency")
    return named.join(own.hint("merge"), "transaction_id").join(found.hint("merge"), "id", "left")


def exception_features(rows: DataFrame, internal: tuple[str, ...] = ("erp",)) -> DataFrame:
    """Rows of load_open_exceptions with the ten features and `nearest`, the counterpart least away in amount."""
    n = F.coalesce(F.size("counterparts"), F.lit(0))
    n = F.when(F.col("counterparts").isNull(), 0).otherwise(n)
    gap = lambda c: F.abs(c["amount"] - F.col("amount"))
    nearest = F.get(F.array_sort(F.transform("counterparts", lambda c: F.struct(gap(c).alias("gap"), c["nth"].alias("nth"), c.alias("c")))), 0)
    rows = rows.withColumn("counterpart_count", n.cast("double")).withColumn("nearest", nearest.getField("c"))
    total = F.aggregate("counterparts", F.lit(0).cast("decimal(38,2)"), lambda a, c: (a + F.coalesce(c["amount"], F.lit(0))).cast("decimal(38,2)"))
    has = rows.withColumn("total", total)
    some, amount = F.col("counterpart_count") > 0, F.col("amount").cast("double")
    return has.withColumns(
        {
            "amount_ratio": F.when(some & (F.col("amount") != 0), F.round(F.col("nearest.amount").cast("double") / amount, 6)).otherwise(0.0),
            "description_similarity": F.when(some, jaccard_tokens(F.col("description"), F.col("nearest.description"))).otherwise(0.0),
            "has_reference_code": clean_string(F.col("reference_code")).isNotNull().cast("double"),
            "date_delta_days": F.when(some, F.coalesce(F.abs(F.datediff("txn_date", "nearest.txn_date")).cast("double"), F.lit(0.0))).otherwise(0.0),
            "amount_shortfall": F.when(~some, amount).when(F.col("amount") == 0, 0.0).otherwise((F.col("amount") - F.col("total")).cast("double")),
            "best_confidence": F.coalesce(F.col("best_confidence").cast("double"), F.lit(0.0)),
            "reference_agreement": F.when(some, reference_agreement(F.col("reference_code"), F.col("nearest.reference_code"))).otherwise(0.0),
            "log_amount": F.log1p(F.abs(amount)),
            "is_internal": F.coalesce(F.col("source_type").isin(*internal), F.lit(False)).cast("double"),
        }
    )


def _rule_cases() -> dict[str, Column]:
    """What the rules tell apart, by the features alone."""
    c = F.col
    equal = F.abs(c("amount_ratio") - 1) <= EQUAL
    return {
        "split": c("counterpart_count") >= 2,
        "late": equal & (c("date_delta_days") > DRIFT_DAYS),
        "unreferenced": equal & ((c("has_reference_code") == 0) | (c("reference_agreement") == 0.5)),
        "differ": (c("amount_ratio") > 0) & ~equal,
        "none": c("counterpart_count") == 0,
    }


def rule_category() -> Column:
    """The category that the rules give a row with the ten features."""
    k = _rule_cases()
    return F.when(k["split"], CATEGORIES[1]).when(k["late"], CATEGORIES[3]).when(k["unreferenced"], CATEGORIES[2]).when(k["differ"], CATEGORIES[0]).when(k["none"], CATEGORIES[2]).otherwise(CATEGORIES[3])


def classify_rules(rows: DataFrame) -> DataFrame:
    """category and confidence from the features: several counterparts, same amount late, same amount without reference,
    amounts that differ, nothing nominated, and the rest."""
    c, k = F.col, _rule_cases()
    covered = F.when(c("amount").cast("double") != 0, (c("amount").cast("double") - c("amount_shortfall")) / c("amount").cast("double")).otherwise(0.0)
    share = F.least(c("amount_ratio"), 1 / F.nullif(c("amount_ratio"), F.lit(0.0)))
    confidence = (
        F.when(k["split"], F.least(F.lit(0.95), 0.55 + 0.08 * c("counterpart_count") + 0.15 * F.least(covered, F.lit(1.0))))
        .when(k["late"], F.least(F.lit(0.95), 0.70 + 0.02 * c("date_delta_days")))
        .when(k["unreferenced"], 0.85)
        .when(k["differ"], F.least(F.lit(0.92), 0.55 + 0.4 * share))
        .when(k["none"], 0.45)
        .otherwise(0.40)
    )
    return rows.withColumn("category", rule_category()).withColumn("category_confidence", F.round(confidence, 4))


def suggest_resolution(rows: DataFrame, as_of: str) -> DataFrame:
    """What to do about each classified row: action, pathway and the fields that its category calls for."""
    c, amount = F.col, F.col("amount").cast("decimal(18,2)")
    other = F.coalesce(c("nearest.amount"), F.lit(0).cast("decimal(18,2)"))
    is_ = lambda k: c("category") == k
    look = lambda i: F.create_map(*[x for k, v in PATHWAYS.items() for x in (F.lit(k), F.lit(v[i]))])[c("category")]
    partial, split, missing, timing = (is_(k) for k in CATEGORIES)
    obligation, settled = F.greatest(amount, other), F.least(amount, other)
    left = (amount - F.coalesce(c("total"), F.lit(0))).cast("decimal(18,2)")
    ids = F.transform("counterparts", lambda x: x["other"])
    fields = {
        "obligation_amount": F.when(partial, obligation).when(split, amount),
        "settled_amount": F.when(partial, settled),
        "residual_balance": F.when(partial, (obligation - settled).cast("decimal(18,2)")),
        "settled_share": F.when(partial & (obligation > 0), F.round(settled.cast("double") / obligation.cast("double"), 4)),
        "viewed_from": F.when(partial, F.when(amount >= other, "obligation").otherwise("receipt")),
        "candidate_legs": F.when(split, c("counterpart_count").cast("int")),
        "allocated_total": F.when(split, c("total").cast("decimal(18,2)")),
        "unallocated_remainder": F.when(split, left),
        "candidate_count": F.when(missing, c("counterpart_count").cast("int")),
        "next_step": F.when(missing, F.when(c("counterpart_count") == 0, "MANUAL_SEARCH").otherwise("ASSIGN_AND_REMATCH")),
        "period_drift_days": F.when(timing, c("date_delta_days").cast("int")),
        "amount_agrees": F.when(timing, F.abs(c("amount_ratio") - 1) <= EQUAL),
        "hold_until": F.when(timing & (c("date_delta_days") > 0), F.date_add(F.lit(as_of).cast("date"), c("date_delta_days").cast("int"))),
        "counterpart_id": F.when(partial | timing, c("nearest.other")),
        "counterpart_ids": F.when(split | missing, ids),
    }
    money = lambda x: format_money(x, F.coalesce(c("currency"), F.lit("USD")))
    detail = (
        F.when(partial, F.concat(money(settled), F.lit(" settled of "), money(obligation), F.lit("; carry forward "), money(obligation - settled)))
        .when(split, F.concat(c("counterpart_count").cast("int").cast("string"), F.lit(" receipts, "), money(c("total")), F.lit(" of "), money(amount)))
        .when(missing, F.concat(c("counterpart_count").cast("int").cast("string"), F.lit(" candidates without a shared reference")))
        .otherwise(F.concat(F.lit("posted "), c("date_delta_days").cast("int").cast("string"), F.lit(" days apart")))
    )
    return rows.withColumns({"action": look(0), "pathway": look(1), "detail": detail, "fields": F.struct(*[v.alias(k) for k, v in fields.items()])})


def apply_suggestions(queue: DataFrame, suggested: DataFrame) -> DataFrame:
    """The next version of queue rows that have a suggestion: category, confidence, state SUGGESTED."""
    s = suggested.select("id", F.col("category").alias("_c"), F.col("category_confidence").alias("_p"), "fields")
    hit = F.col("_c").isNotNull() & (F.col("state") == "OPEN")
    out = queue.drop("category", "fields").join(s.hint("merge"), "id", "left")
    new = {"state": F.when(hit, "SUGGESTED").otherwise(F.col("state")), "category": F.when(hit, F.col("_c")), "category_confidence": F.when(hit, F.col("_p")).cast("decimal(5,4)")}
    return out.withColumns(new).drop("_c", "_p")


def usable_label(decision: Column, category: Column) -> Column:
    return F.when(decision.isin("ACCEPT", "EDIT") & category.isNotNull(), True).otherwise(False)


def apply_decisions(queue: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Decisions (id, decision, actor, decided_at, corrected_category) over the queue: the changed rows, and the
    decisions refused because the row is unknown or settled or the decision is none."""
    d = decisions.join(queue.select("id", "state", "category").hint("merge"), "id", "left")
    ok = F.coalesce(F.col("state").isin("OPEN", "SUGGESTED") & F.col("decision").isin("ACCEPT", "REJECT", "EDIT") & ((F.col("decision") != "EDIT") | F.col("corrected_category").isNotNull()), F.lit(False))
    why = F.when(F.col("state").isNull(), "unknown exception").when(~F.col("state").isin("OPEN", "SUGGESTED"), "already settled").otherwise("invalid decision")
    final = F.when(F.col("decision") == "EDIT", F.col("corrected_category")).otherwise(F.col("category"))
    changed = d.where(ok).select(
        "id", F.col("state").alias("old_state"), F.when(F.col("decision") == "REJECT", "REJECTED").otherwise("RESOLVED").alias("state"), final.alias("category"), F.col("actor").alias("resolved_by"), F.col("decided_at").alias("resolved_at"), usable_label(F.col("decision"), final).alias("is_label")
    )
    return changed, d.where(~ok).select("id", "decision", why.alias("reason"))
