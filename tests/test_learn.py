from pyspark.sql import functions as F

from ledgerloom.operators import learn
from ledgerloom.operators.triage import FEATURES, rule_category
from ledgerloom.plans import q_triage

SF = "/root/testdata/sf0.001"


def labelled(spark, n=120):
    """Rows of two kinds, partial payments and late ones, that the rules tell apart."""
    rows = [(f"s{i}", 0.7 + (i % 20) / 100 if i % 2 else 1.0, float(i % 9 if i % 2 else 5 + i % 9)) for i in range(n)]
    df = spark.createDataFrame(rows, "id string, amount_ratio double, date_delta_days double")
    df = df.withColumns({f: F.lit(1.0) for f in FEATURES if f not in ("amount_ratio", "date_delta_days")})
    return df.withColumn("decision", F.lit("ACCEPT")).withColumn("category", rule_category())


def test_every_forest_query_grows_all_trees_whole(spark, monkeypatch):
    asked, real = [], learn.RandomForestClassifier
    monkeypatch.setattr(learn, "RandomForestClassifier", lambda **k: asked.append(k) or real(**{**k, "numTrees": 2, "maxDepth": 3}))
    names = ["train_forest", "promotion_guard", "classify_forest", "explain_top3", "model_registry", "retrain_if_ready"]
    for name in names:
        q_triage.Q[name][0](spark, SF)
    assert len(asked) == len(names) and all(k["numTrees"] == 200 and k["maxDepth"] == 30 for k in asked)


def test_a_first_forest_is_held_against_the_rules(spark):
    """Without a forest it is the rules that serve, and a forest worse than they are is not promoted."""
    good = labelled(spark)
    other = F.when(F.col("category") == "PARTIAL_PAYMENT", "TIMING_DIFFERENCE").otherwise("PARTIAL_PAYMENT")
    bad = learn.train_forest(good.withColumn("category", other), trees=5)
    new, old, serving = learn.against_serving(bad, good)
    assert new < 0.1 and old == 1.0 and serving == "rules" and not learn.promotion_guard(new, old)
    fit = learn.train_forest(good, trees=5)
    new, old, serving = learn.against_serving(fit, good, bad)
    assert new > 0.95 and old < 0.1 and serving == "random_forest" and learn.promotion_guard(new, old)


def test_retraining_without_an_incumbent_is_held_against_the_rules(spark, monkeypatch):
    monkeypatch.setattr(learn, "classify_forest", lambda model, rows: rows.withColumn("predicted", F.lit("SPLIT_SETTLEMENT")))
    assert learn.retrain_if_ready(labelled(spark), force=True, trees=5) == ("rejected", None)


def test_the_guard_knows_what_the_rules_score(spark, monkeypatch):
    """The labels of the fixture are the rules' own, so the rules are right in all of them."""
    real = learn.RandomForestClassifier
    monkeypatch.setattr(learn, "RandomForestClassifier", lambda **k: real(**{**k, "numTrees": 3}))
    assert q_triage.Q["promotion_guard"][0](spark, SF).first().incumbent_f1 == 1.0
