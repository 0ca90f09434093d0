"""Validation: structure, business rules and checksums, the first failing stage decides."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.normalize import CHECKSUMS, canonical_json, canonical_record, fingerprint

# The business rules as data.
RULES = [
    {"rule": "not_null", "column": "amount"},
    {"rule": "between", "column": "amount", "min": "0.01"},
    {"rule": "between", "column": "amount", "max": "1000000000"},
    {"rule": "not_null", "column": "txn_date"},
    {"rule": "not_null", "column": "currency"},
    {"rule": "in_set", "column": "currency", "values": ["USD", "EUR", "GBP", "NGN", "ZAR", "KES", "GHS", "CAD", "AUD", "JPY", "CHF", "CNY"]},
    {"rule": "not_null", "column": "source_type"},
    {"rule": "in_set", "column": "source_type", "values": ["bank_api", "payment_gateway", "erp"]},
    {"rule": "regex", "column": "reference_code", "pattern": r"^REF-[0-9]{4,10}\z"},
    {"rule": "regex", "column": "external_id", "pattern": r"^[A-Za-z0-9_-]{1,64}\z"},
    {"rule": "not_future", "column": "txn_date"},
]
NO_VIOLATIONS = "array<string>"


def load_rules(text: str) -> list[dict]:
    """Rules from JSON. A suite without rules is an error, not a suite that everything passes."""
    rules = json.loads(text)
    if not rules:
        raise ValueError("the rule suite is empty")
    return rules


def _listed(*checks: Column) -> Column:
    return F.array_compact(F.array(*checks)).cast(NO_VIOLATIONS)


def typed_amount(c: Column) -> Column:
    return F.when(c.rlike(r"^[+-]?[0-9]+(\.[0-9]*)?\z|^[+-]?\.[0-9]+\z"), c.try_cast("decimal(38,6)"))


def typed_date(c: Column) -> Column:
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}\z"), c.try_cast("date"))


def check_structure(r: str) -> Column:
    """Every structural failure of the canonical struct `r`."""
    f = lambda name: F.col(f"{r}.{name}")
    amount, date = typed_amount(f("amount")), typed_date(f("txn_date"))
    return _listed(
        F.when(f("amount").isNull(), "amount: required").when(amount.isNull(), "amount: not a number").when(amount <= 0, "amount: must be positive"),
        F.when(f("txn_date").isNull(), "txn_date: required").when(date.isNull(), "txn_date: not a date"),
        F.when(f("source_type").isNull(), "source_type: required"),
        F.when(f("currency").isNull(), "currency: required").when(F.char_length(f("currency")) != 3, "currency: must have 3 letters"),
    )


def _rule(rule: dict, as_of: str) -> Column:
    c = F.col(rule["column"])
    told = lambda what: F.concat(F.lit(f"{rule['column']}: {what} (got "), F.coalesce(c.cast("string"), F.lit("null")), F.lit(")"))
    if rule["rule"] == "not_null":
        return F.when(c.isNull(), told("must be present"))
    if rule["rule"] == "in_set":
        return F.when(~c.isin(rule["values"]), told("not in the allowed set"))
    if rule["rule"] == "regex":
        return F.when(~c.rlike(rule["pattern"]), told("bad format"))
    if rule["rule"] == "not_future":
        return F.when(c > F.lit(as_of).cast("date"), told("in the future"))
    if rule["rule"] == "between":
        low = c < F.lit(rule["min"]).cast("decimal(38,6)") if "min" in rule else F.lit(False)
        high = c > F.lit(rule["max"]).cast("decimal(38,6)") if "max" in rule else F.lit(False)
        return F.when(low | high, told("out of range"))
    raise ValueError(f"unknown rule {rule['rule']!r}")


def coerce_for_rules(df: DataFrame, r: str = "r") -> DataFrame:
    """Typed columns of the canonical struct; what cannot be typed is null, so that the not-null rules see it."""
    f = lambda name: F.col(f"{r}.{name}")
    return df.withColumns({"amount": typed_amount(f("amount")), "txn_date": typed_date(f("txn_date")), **{n: f(n) for n in ("external_id", "source_type", "currency", "description", "reference_code")}})


def apply_rules(as_of: str, rules: list[dict] = RULES) -> Column:
    """Violations of the suite over typed columns; nulls pass all but the not-null rules."""
    return _listed(*[_rule(x, as_of) for x in rules])


def hmac_sha256(key: str, message: Column) -> Column:
    """HMAC from two digests; the padded keys are made once."""
    k = key.encode()
    k = (hashlib.sha256(k).digest() if len(k) > 64 else k).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in k), bytes(b ^ 0x5C for b in k)
    first = F.unhex(F.sha2(F.concat(F.lit(inner), message.cast("binary")), 256))
    return F.sha2(F.concat(F.lit(outer), first), 256)


def verify_checksum(r: str, secret: str | None = None) -> Column:
    """Violations: an absent or blank checksum passes, an unknown algorithm or a missing secret fails. Spaces around the
    checksum and its case don't count."""
    given = F.coalesce(*[F.col(f"{r}.{c}") for c in CHECKSUMS])
    kind = F.lower(F.coalesce(F.col(f"{r}.checksum_algorithm"), F.lit("sha256")))
    body = canonical_json(r)
    want = F.when(kind == "sha256", F.sha2(body, 256)).when(kind == "sha512", F.sha2(body, 512)).when(kind == "md5", F.md5(body))
    if secret is not None:
        want = want.when(kind == "hmac-sha256", hmac_sha256(secret, body))
    bad = (
        F.when(given.isNull(), F.lit(None))
        .when(~kind.isin("sha256", "sha512", "md5", "hmac-sha256"), F.concat(F.lit("checksum: unsupported algorithm "), kind))
        .when((kind == "hmac-sha256") & F.lit(secret is None), F.lit("checksum: no secret to check with"))
        .when(F.lower(given) != want, F.lit("checksum: mismatch"))
    )
    return _listed(bad)


def validate(records: DataFrame, as_of: str, rules: list[dict] = RULES, secret: str | None = None) -> DataFrame:
    """Records (`record` map, optional `error`) with status, stage, violations, fingerprint and typed fields.

    One projection: structure first, rules over what has it, checksums over what obeys them. What is no object
    fails the structure.
    """
    if "error" not in records.columns:
        records = records.withColumn("error", F.lit(None).cast("string"))
    # Through explode, so that the optimizer does not copy the parsing of a record into every use of a field.
    df = coerce_for_rules(records.withColumn("r", F.explode(F.array(canonical_record(F.col("record"))))))
    none = F.array().cast(NO_VIOLATIONS)
    df = df.withColumn("_schema", F.when(F.col("error").isNotNull(), F.array(F.concat(F.lit("record: "), "error"))).otherwise(check_structure("r")))
    df = df.withColumn("_rules", F.when(F.size("_schema") == 0, apply_rules(as_of, rules)).otherwise(none))
    df = df.withColumn("_sums", F.when(F.size("_schema") + F.size("_rules") == 0, verify_checksum("r", secret)).otherwise(none))
    stage = F.when(F.size("_schema") > 0, "schema").when(F.size("_rules") > 0, "business_rule").when(F.size("_sums") > 0, "checksum")
    return (
        df.withColumn("stage", stage)
        .withColumn("status", F.when(stage.isNull(), "PASSED").otherwise("QUARANTINED"))
        .withColumn("violations", F.concat("_schema", "_rules", "_sums"))
        .withColumn("fingerprint", fingerprint("r"))
        .drop("_schema", "_rules", "_sums")
    )


def validation_summary(decisions: DataFrame) -> DataFrame:
    """total, passed, quarantined, and quarantined by stage, in one row."""
    at = lambda s: F.count_if(F.col("stage") == s).alias(f"at_{s}")
    return decisions.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "PASSED").alias("passed"), F.count_if(F.col("status") == "QUARANTINED").alias("quarantined"), at("schema"), at("business_rule"), at("checksum"))


def pair_invariants(pairs: DataFrame) -> DataFrame:
    """Rows that break an invariant: a match without counterpart or type, or an unmatched row with one."""
    both = F.col("internal_id").isNotNull() & F.col("external_id").isNotNull() & F.col("match_type").isNotNull()
    none = F.col("external_id").isNull() & F.col("match_type").isNull()
    return pairs.where(~F.when(F.col("status") == "MATCHED", both).otherwise(none))
