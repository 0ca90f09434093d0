"""Feeds: CSV, JSON and Kafka messages to records, bad ones carried along."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = "map<string,string>"


def csv_record(sep: str = ",") -> str:
    """A pattern of a CSV record: fields up to a line end. A quote opens only at the start of a field; one inside a field, or one
    that nothing closes, is a character like any other."""
    s = re.escape(sep)
    field = rf'(?:"(?:[^"]++|"")*+")?[^{s}\r\n]*+'
    return f"{field}(?:{s}{field})*+"


def decode_bytes(c: Column) -> Column:
    """UTF-8 text of binary messages; bad bytes become U+FFFD."""
    return F.make_valid_utf8(c.cast("string"))


def detect_format(value: Column) -> Column:
    """json where the text begins with a brace or bracket, csv where the first line has a separator, else json."""
    first = F.element_at(F.split(F.btrim(value), r"\r?\n", 2), 1)
    return F.when(F.ltrim(value).rlike(r"^[{\[]"), "json").when(first.rlike("[,;]"), "csv").otherwise("json")


def read_json_feed(messages: DataFrame, value: str = "value") -> DataFrame:
    """A row for each record of each JSON message (an object or an array of objects): the message's columns, `record` and
    `error`. What is no object, or cannot be parsed, is one row with the first 2000 characters under `_raw`."""
    text = F.btrim(F.col(value))
    many = text.startswith("[")
    listed = F.from_json(text, T.ArrayType(T.StringType()))
    parts = F.when(many, F.coalesce(listed, F.array(text))).otherwise(F.array(text))
    rows = messages.withColumn("_part", F.explode(parts))
    record = F.when(F.ltrim("_part").startswith("{"), F.from_json("_part", RECORD))
    bad = F.create_map(F.lit("_raw"), F.substring("_part", 1, 2000))
    return rows.withColumn("record", F.coalesce(record, bad)).withColumn("error", F.when(record.isNull(), F.lit("not an object"))).drop("_part")


def read_csv_feed(messages: DataFrame, header: list[str], value: str = "value", sep: str = ",") -> DataFrame:
    """A row for each record but the first of each CSV message, `record` holding its fields by header name, as strings.
    Records end at line ends outside quoted fields, which may hold some; a quote inside quotes is written twice."""
    schema = T.StructType([T.StructField(h, T.StringType()) for h in header])
    lines = F.regexp_extract_all(F.col(value), F.lit(csv_record(sep)), F.lit(0))
    lines = F.filter(lines, lambda x: F.btrim(x) != "")
    rows = messages.withColumn("_line", F.explode(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1)))))
    parsed = F.from_csv("_line", schema.simpleString()[7:-1].replace(":", " "), {"sep": sep, "escape": '"'})
    rows = rows.withColumn("_row", parsed)
    pairs = F.array(*[F.struct(F.lit(h).alias("key"), F.col(f"_row.{h}").alias("value")) for h in header])
    return rows.withColumn("record", F.map_from_entries(pairs)).drop("_line", "_row")


def read_csv_files(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """CSV files with a header, every column a string: types are decided later, never inferred."""
    return spark.read.csv(path, header=True, sep=sep, inferSchema=False)


def kafka_messages(records: DataFrame) -> DataFrame:
    """Text messages of Kafka's records (key, value, topic, partition, offset, timestamp), with where each was. A record without a
    value is a deletion and no message."""
    return records.where("value IS NOT NULL").select(decode_bytes(F.col("key")).alias("key"), decode_bytes(F.col("value")).alias("value"), "topic", "partition", "offset", "timestamp")


def read_kafka(spark: SparkSession, brokers: str, topic: str = "raw_transactions", per_batch: int = 500) -> DataFrame:
    """The topic from its beginning as a stream of messages, so many in a batch at most."""
    stream = spark.readStream.format("kafka").option("kafka.bootstrap.servers", brokers).option("subscribe", topic).option("startingOffsets", "earliest").option("maxOffsetsPerTrigger", per_batch).load()
    return kafka_messages(stream)
