"""What the operators share: tables, staging in the shared folder, text scalars, connected components."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share. Only where the session names none
    (local mode, as in tests) is one made here."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        path = spark.sparkContext.getCheckpointDir()
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it back: lineage is cut, later
    readers survive lost executors, and Spark knows the true size of what it reads."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/ledgerloom-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    # Spark drops the shuffle files of a finished step when the driver has collected its plan.
    gc.collect()
    spark._jvm.System.gc()
    return out


def unstage(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more (loops only)."""
    path = getattr(df, "_staged_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that `df` does not have (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z and nothing else. Pure ASCII text takes the fast built-in."""
    return F.when(F.char_length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def doc_bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the decimal text of doc_id, modulo n."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n)).cast("int")


def components(edges: DataFrame, name: str = "cc", max_rounds: int = 60) -> DataFrame:
    """Connected components of `edges` (u, v), as (node, root) with the smallest node as root.

    Large-star and small-star rounds: every node's neighbours are pointed at the smallest node
    around it, until nothing changes. A round is two grouped minima and two joins on the node, so
    no neighbourhood is gathered anywhere. The minima are staged, so both sides of a join are
    shuffled for it and AQE can split a hub. Loops and repeated edges do no harm; an empty table
    gives an empty result.
    """
    e = staged(edges.select("u", "v").where("u <> v").distinct(), f"{name}-edges")
    state = None
    for _ in range(max_rounds):
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = staged(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), f"{name}-low")
        large = both.where("v > u").join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = staged(large, f"{name}-large")
        # Small-star: u > v holds in every row of `large`.
        low2 = staged(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-low")
        small = large.join(low2.hint("merge"), "u")
        new = small.select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("p")).select(F.col("p.a").alias("u"), F.col("p.b").alias("v")).where("u <> v").distinct()
        new = staged(new, f"{name}-edges")
        for old in (e, low, large, low2):
            unstage(old)
        e = new
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (now.n, now.s) == state:
            break
        state = (now.n, now.s)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
