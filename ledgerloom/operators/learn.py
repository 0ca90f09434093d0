"""A random forest over reviewed exceptions: training set, split, weights, quality, promotion."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.pipeline import Pipeline
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.operators.frames import staged
from ledgerloom.operators.triage import FEATURES, classify_rules, rule_category, usable_label

LEAST_SAMPLES, TRIGGER = 8, 200


def training_set(settled: DataFrame) -> DataFrame:
    """Usable rows of settled exceptions (decision, category, features)."""
    return settled.where(usable_label(F.col("decision"), F.col("category")))


def label_counts(settled: DataFrame) -> DataFrame:
    ok = usable_label(F.col("decision"), F.col("category"))
    return settled.agg(F.count_if(ok & (F.col("decision") == "ACCEPT")).alias("confirmed"), F.count_if(ok & (F.col("decision") == "EDIT")).alias("corrected"), F.count_if(~ok).alias("unusable"))


def retrain_readiness(settled: DataFrame, trigger: int = TRIGGER) -> DataFrame:
    usable = F.count_if(usable_label(F.col("decision"), F.col("category")))
    return settled.agg(usable.alias("usable"), F.lit(trigger).alias("trigger"), F.greatest(F.lit(0), F.lit(trigger) - usable).alias("remaining"), (usable >= trigger).alias("ready"), F.count(F.lit(1)).alias("resolved"))


def class_weights(samples: DataFrame, label: str = "category") -> DataFrame:
    """(label, n, weight): rows over classes times rows of the class."""
    per = samples.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    # One row for each class.
    total = per.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("classes"))
    return per.join(F.broadcast(total)).select(label, "n", F.round(F.col("rows") / (F.col("classes") * F.col("n")), 6).alias("weight"))


def stratified_split(samples: DataFrame, label: str = "category", share: float = 0.25, key: str = "id") -> DataFrame:
    """`held_out`: the share of each class with the least hash (of equal ones, the least key); of the whole where a class has one row only.

    A class is counted by bins of its hash, so whole bins are in or out; only the rows of the one bin where the share ends are
    ranked, a few thousandths of a class.
    """
    h = F.coalesce(F.conv(F.substring(F.md5(F.col(key).cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(-1))
    # As text, so that a missing class is one of its own.
    rows = staged(samples, "labelled").withColumns({"_class": F.to_json(F.struct(label)), "_h": h}).withColumn("_bin", F.floor(F.col("_h") / (1 << 20)))
    bins = rows.groupBy("_class", "_bin").agg(F.count(F.lit(1)).alias("_n"))
    own = Window.partitionBy("_class")
    bins = bins.withColumns({"_all": F.sum("_n").over(own), "_upto": F.sum("_n").over(own.orderBy("_bin"))})
    few = bins.agg((F.min("_all") < 2).alias("_few"))
    # Held out are the rows whose rank, from 0, is under this.
    end = F.lit(share) * (F.col("_all") - 1)
    side = F.when(F.col("_upto") - 1 < end, True).when(F.col("_upto") - F.col("_n") >= end, False)
    placed = rows.join(bins.withColumn("_in", side).hint("merge"), ["_class", "_bin"]).join(F.broadcast(few))
    by_class = F.coalesce("_in", F.rank().over(Window.partitionBy("_class", "_in").orderBy("_h", key)) + F.col("_upto") - F.col("_n") - 1 < end)
    whole, ranked = placed.where(F.col("_in").isNotNull()).withColumn("_held", F.col("_in")), placed.where(F.col("_in").isNull()).withColumn("_held", by_class)
    out = whole.unionByName(ranked).withColumn("held_out", F.when(F.col("_few"), F.col("_h") < share * (1 << 32)).otherwise(F.col("_held")))
    return out.select(*samples.columns, "held_out")


def train_forest(samples: DataFrame, trees: int = 200, seed: int = 42, depth: int = 30) -> PipelineModel | None:
    """A forest with balanced weights over the ten features; None with too few rows or classes. Trees grow until their leaves are of
    one class; `depth` is the most that Spark allows."""
    counts = samples.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("category").alias("k")).first()
    if counts.n < LEAST_SAMPLES or counts.k < 2:
        return None
    # The fit reads its rows once for each level of the trees and more, so they are written down, not made each time.
    samples = staged(samples.select("category", *FEATURES), "samples")
    weighted = samples.join(F.broadcast(class_weights(samples).select("category", "weight")), "category")
    index = StringIndexer(inputCol="category", outputCol="label", stringOrderType="alphabetAsc").fit(weighted)
    stages = [index, VectorAssembler(inputCols=FEATURES, outputCol="vector", handleInvalid="keep"), RandomForestClassifier(featuresCol="vector", numTrees=trees, maxDepth=depth, seed=seed, weightCol="weight"), IndexToString(inputCol="prediction", outputCol="predicted", labels=index.labels)]
    return Pipeline(stages=stages).fit(weighted)


def classify_forest(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """predicted and its probability."""
    plain = rows.withColumn("category", F.coalesce("category", F.lit("PARTIAL_PAYMENT"))) if "category" in rows.columns else rows.withColumn("category", F.lit("PARTIAL_PAYMENT"))
    labels = model.stages[0].labels
    safe = plain.withColumn("_true", F.col("category")).withColumn("category", F.when(F.col("category").isin(labels), F.col("category")).otherwise(labels[0])).withColumn("weight", F.lit(1.0))
    out = model.transform(safe).withColumn("probability", F.array_max(vector_to_array("probability")))
    return out.withColumn("category", F.col("_true")).drop("_true", "label", "vector", "rawPrediction", "prediction", "weight")


def classify(model: PipelineModel | None, rows: DataFrame) -> DataFrame:
    """predicted, its probability and the `engine`: the forest, or the rules where there is none yet."""
    if model is None:
        ruled = classify_rules(rows.drop("category"))
        return ruled.withColumnRenamed("category", "predicted").withColumn("probability", F.col("category_confidence")).drop("category_confidence").withColumn("engine", F.lit("rules"))
    return classify_forest(model, rows).withColumn("engine", F.lit("random_forest"))


def explain_top3(model: PipelineModel) -> list[tuple[str, float]]:
    """The three features that matter most."""
    importance = model.stages[2].featureImportances.toArray()
    return sorted(zip(FEATURES, importance.tolist()), key=lambda x: (-x[1], x[0]))[:3]


def rationale(model: PipelineModel) -> Column:
    """The same with each row's values, as text for the audit trail."""
    return F.concat_ws(", ", *[F.format_string(f"{name}=%.3g", F.col(name)) for name, _ in explain_top3(model)])


def classification_report(predicted: DataFrame, label: str = "category", guess: str = "predicted") -> DataFrame:
    """(category, support, precision, recall, f1) from confusion counts; 0 where there is nothing to divide by."""
    pairs = predicted.groupBy(F.col(label).alias("t"), F.col(guess).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    sides = pairs.select(F.explode(F.array(F.struct(F.col("t").alias("category"), F.col("n").alias("support"), F.lit(0).cast("long").alias("said")), F.struct(F.col("p").alias("category"), F.lit(0).cast("long").alias("support"), F.col("n").alias("said")))).alias("s"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("hit"))
    per = sides.groupBy("s.category").agg(F.sum("s.support").alias("support"), F.sum("s.said").alias("said"), (F.sum("hit") / 2).alias("hit"))
    per = per.withColumn("p", F.coalesce(F.try_divide(F.col("hit"), F.col("said")), F.lit(0.0))).withColumn("r", F.coalesce(F.try_divide(F.col("hit"), F.col("support")), F.lit(0.0)))
    return per.select("category", "support", F.round("p", 4).alias("precision"), F.round("r", 4).alias("recall"), F.round(F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0)), 4).alias("f1"))


def macro_f1(predicted: DataFrame, guess: str = "predicted") -> float:
    return classification_report(predicted, guess=guess).agg(F.avg("f1")).first()[0] or 0.0


def promotion_guard(candidate_f1: float, incumbent_f1: float | None, tolerance: float = 0.01) -> bool:
    return incumbent_f1 is None or candidate_f1 >= incumbent_f1 - tolerance


def against_serving(candidate: PipelineModel, held: DataFrame, incumbent: PipelineModel | None = None) -> tuple[float, float, str]:
    """Macro F1 of a candidate and of what is serving, over the same held-out rows, and what that is: the incumbent forest or, where there is
    none yet, the rules. These need the features alone to choose a category."""
    held = staged(held, "held")
    if incumbent is None:
        return macro_f1(classify_forest(candidate, held)), macro_f1(held.withColumn("predicted", rule_category())), "rules"
    return macro_f1(classify_forest(candidate, held)), macro_f1(classify_forest(incumbent, held)), "random_forest"


def save_version(model: PipelineModel, root: str, version: int) -> str:
    path = f"{root.rstrip('/')}/v{version:06d}"
    model.save(path)
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(version, ",".join(FEATURES))], "version int, features string").write.parquet(path + "-meta")
    return path


def load_version(spark: SparkSession, root: str, version: int) -> PipelineModel:
    """A saved model; one with another feature list is refused."""
    path = f"{root.rstrip('/')}/v{version:06d}"
    if spark.read.parquet(path + "-meta").first().features != ",".join(FEATURES):
        raise ValueError(f"{path} was trained on other features")
    return PipelineModel.load(path)


def retrain_if_ready(settled: DataFrame, incumbent_guess: str | None = None, trigger: int = TRIGGER, force: bool = False, trees: int = 200) -> tuple[str, PipelineModel | None]:
    """skipped, failed, rejected or promoted, with the model. The incumbent's guesses are a column of `settled`; without one the rules are
    what is serving. Both are scored on the same held-out rows."""
    samples = staged(stratified_split(training_set(settled)), "split")
    if not force and samples.count() < trigger:
        return "skipped", None
    model = train_forest(samples.where("NOT held_out"), trees)
    if model is None:
        return "failed", None
    held = samples.where("held_out")
    new, old = (macro_f1(classify_forest(model, held)), macro_f1(held, incumbent_guess)) if incumbent_guess else against_serving(model, held)[:2]
    return ("promoted", model) if promotion_guard(new, old) else ("rejected", None)
