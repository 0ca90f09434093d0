"""Normalisation of incoming records: headers, aliases, blanks, text, canonical form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names under which feeds carry the canonical fields.
ALIASES = {
    "transaction_id": "external_id",
    "txn_id": "external_id",
    "id": "external_id",
    "reference": "reference_code",
    "ref": "reference_code",
    "ref_code": "reference_code",
    "value": "amount",
    "transaction_amount": "amount",
    "amt": "amount",
    "ccy": "currency",
    "currency_code": "currency",
    "date": "txn_date",
    "transaction_date": "txn_date",
    "value_date": "txn_date",
    "posted_date": "txn_date",
    "narrative": "description",
    "memo": "description",
    "details": "description",
    "source": "source_type",
    "channel": "source_type",
}
# The canonical fields, and the fields that may carry a checksum, in the order they are looked at.
CANONICAL = ["external_id", "source_type", "amount", "currency", "txn_date", "description", "reference_code"]
CHECKSUMS = ["checksum", "signature", "hmac", "digest", "_checksum"]
CARRIED = [*CHECKSUMS, "checksum_algorithm"]
#: What counts as white space at the ends of a value.
SPACES = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(chr(c) for c in range(0x2000, 0x200B))


def canon_headers(df: DataFrame) -> DataFrame:
    """Column names trimmed, lower-cased, with underscores for spaces."""
    return df.toDF(*[c.strip().lower().replace(" ", "_") for c in df.columns])


def canon_keys(record: Column) -> Column:
    """The same for the keys of a map; of keys that become equal the first stays."""
    name = lambda k: F.replace(F.lower(F.btrim(k)), F.lit(" "), F.lit("_"))
    entries = F.transform(F.map_entries(record), lambda e: F.struct(name(e["key"]).alias("key"), e["value"].alias("value")))
    first = F.filter(entries, lambda e, i: F.array_position(F.transform(entries, lambda x: x["key"]), e["key"]) == i + 1)
    return F.map_from_entries(first)


def clean_string(c: Column) -> Column:
    """Trimmed; blank becomes null."""
    return F.nullif(F.btrim(c, F.lit(SPACES)), F.lit(""))


def missing_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def rename_aliases(df: DataFrame, aliases: dict[str, str] = ALIASES) -> DataFrame:
    """Columns under their canonical names. Where several stand for one field the first value that is
    there counts: the canonical column, then aliases in their listed order."""
    taken = [c for c in df.columns if c not in aliases]
    out = {}
    for field in dict.fromkeys(aliases.values()):
        given = [c for c in [field, *[a for a, f in aliases.items() if f == field]] if c in df.columns]
        if given:
            out[field] = F.coalesce(*[F.col(c) for c in given])
    return df.select(*[F.col(c) for c in taken if c not in out], *[v.alias(k) for k, v in out.items()])


def record_field(record: Column, field: str, aliases: dict[str, str] = ALIASES) -> Column:
    """A canonical field of a record held as a map."""
    names = [field, *[a for a, f in aliases.items() if f == field]]
    return F.coalesce(*[F.try_element_at(record, F.lit(n)) for n in names])


def has_field(record: Column, field: str, aliases: dict[str, str] = ALIASES) -> Column:
    names = [field, *[a for a, f in aliases.items() if f == field]]
    return F.arrays_overlap(F.map_keys(record), F.array(*[F.lit(n) for n in names]))


def keep_fields(record: Column) -> Column:
    """Canonical and carried fields of a record, and keys that begin with an underscore."""
    return F.map_filter(record, lambda k, _: k.isin(*CANONICAL, *CARRIED) | k.startswith("_"))


def canonical_record(record: Column) -> Column:
    """Struct of the canonical and the carried fields, cleaned, and `own`, a map of the keys that begin with an underscore;
    currency falls to USD only where the key is absent."""
    clean = {f: clean_string(record_field(record, f)) for f in CANONICAL}
    clean["currency"] = F.when(~has_field(record, "currency"), F.lit("USD")).otherwise(F.upper(clean["currency"]))
    own = F.map_filter(record, lambda k, _: k.startswith("_") & ~k.isin(CARRIED))
    own = F.map_filter(F.transform_values(own, lambda _, v: clean_string(v)), lambda _, v: v.isNotNull())
    return F.struct(*[v.alias(k) for k, v in clean.items()], *[clean_string(F.try_element_at(record, F.lit(f))).alias(f) for f in CARRIED], own.alias("own"))


def canonical_json(r: str) -> Column:
    """What the record of struct column `r` holds but for its checksum, as JSON with sorted keys and no spaces: the
    canonical fields, the algorithm, and the keys that begin with an underscore, where they have a value."""
    named = F.array(*[F.struct(F.lit(f).alias("key"), F.col(f"{r}.{f}").alias("value")) for f in [*CANONICAL, "checksum_algorithm"]])
    given = F.filter(F.concat(named, F.map_entries(F.col(f"{r}.own"))), lambda e: e["value"].isNotNull())
    return F.to_json(F.map_from_entries(F.array_sort(given)))


def fingerprint(r: str) -> Column:
    return F.sha2(canonical_json(r), 256)


def normalize_description(c: Column) -> Column:
    """Lower-cased, anything but letters, digits and single spaces gone; null becomes empty."""
    return F.coalesce(F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")), F.lit(""))


def jaccard_tokens(a: Column, b: Column) -> Column:
    """Overlap of the token sets, 4 places; 0 where either has no token."""
    tokens = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+"), lambda t: t != ""))
    x, y = tokens(a), tokens(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.round(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)), 4))


def format_money(c: Column, currency: Column) -> Column:
    return F.when(c.isNull(), F.lit("—")).otherwise(F.concat(currency, F.lit(" "), F.format_number(c, 2)))


def format_percent(c: Column) -> Column:
    return F.when(c.isNull(), F.lit("—")).otherwise(F.format_string("%.2f%%", c * 100))
