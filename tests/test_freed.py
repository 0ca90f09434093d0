import datetime
import os
import time

from pyspark.sql import functions as F

from ledgerloom.operators import frames, reconcile as R, text

DAY = datetime.date(2001, 1, 1)
KIND = "id string, source_type string, amount double, txn_date date, reference_code string, description string"


def batch(spark, n=60):
    rows = lambda p, source: [(f"{p}{k}", source, float(100 + k % 7), DAY + datetime.timedelta(k % 5), f"REF-{p}{k}", f"shop {k % 6} parcel {k % 4} north {p}") for k in range(n)]
    return spark.createDataFrame(rows("i", "erp") + rows("e", "bank_api"), KIND)


def shuffle_files(spark):
    dirs = spark._jsc.sc().env().blockManager().diskBlockManager().localDirs()
    return {f for i in range(len(dirs)) for _, _, names in os.walk(dirs[i].getPath()) for f in names if f.startswith("shuffle_") and f.endswith(".data")}


def test_what_is_staged_leaves_no_shuffle_files(spark):
    before, set_to = shuffle_files(spark), spark.conf.get(frames.SWEEP)
    out = frames.staged(spark.range(1000).repartition(4, "id").groupBy((F.col("id") % 7).alias("m")).count(), "counts")
    deadline = time.time() + 20
    while shuffle_files(spark) - before and time.time() < deadline:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before and out.count() == 7 and spark.conf.get(frames.SWEEP) == set_to


def test_what_only_a_step_needs_is_deleted_after_it(spark):
    made = []

    def step():
        made.append(frames.staged(spark.range(5), "inner"))
        made.append(frames.settled(lambda: frames.staged(made[0], "innermost"), "middle"))
        return made[1].where("id > 1")

    out = frames.settled(step, "outer")
    assert out.count() == 3 and os.path.isdir(out._staged_path.removeprefix("file:"))
    assert not any(os.path.exists(df._staged_path.removeprefix("file:")) for df in made)


def test_a_pass_keeps_few_tables(spark):
    """What the steps wrote on their way is gone; what is left is read by the pairs, or for the reasons of what is unmatched."""
    here = frames.shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(here))
    r = R.reconcile(batch(spark))
    left = sorted(name.split("-")[0] for name in set(os.listdir(here)) - before)
    assert left == sorted(["cut", "ruled", "texts", "numbered", "model", "vectors", "similar", "grouped", "scored", "picked", "assigned"])
    # Each of these is still readable, and no row is lost.
    assert r.unmatched.count() + 2 * r.pairs.count() == 120 and r.scored.count() >= r.assigned.count() > 0


def test_numbers_are_in_the_order_of_names_and_texts(spark):
    rows = [("b", "bank_api", 1.0, DAY, None, "zeta"), ("a", "erp", 2.0, DAY, None, "alpha one"), ("a", "erp", 3.0, DAY, None, None), (None, "erp", 4.0, DAY, None, "zeta"), ("B", "erp", 5.0, DAY, None, "  ")]
    df = spark.createDataFrame(rows, KIND)
    kinds = frames.staged(text.numbered_texts(df), "kinds")
    assert [(x.t, x.n) for x in kinds.orderBy("code").collect()] == [("alpha one", 1), ("zeta", 2)]
    got = R.numbered_rows(df.where("source_type = 'erp'"), df.where("source_type <> 'erp'"), kinds).collect()
    ids = {x.name: x.id for x in got}
    assert len(got) == 5 and ids[None] is None and ids["B"] < ids["a"] < ids["b"] and len({x.id for x in got if x.name == "a"}) == 1
    assert sum(bool(x["first"]) for x in got if x.name) == 3 and {x.name for x in got if not x.inside} == {"b"}
    codes = {x.t: x.code for x in kinds.collect()}
    assert sorted(((x.name or "", x.amount, x.t) for x in got)) == [("", 4.0, codes["zeta"]), ("B", 5.0, None), ("a", 2.0, codes["alpha one"]), ("a", 3.0, None), ("b", 1.0, codes["zeta"])]


def test_reasons_are_looked_into_when_they_are_read(spark, monkeypatch):
    asked, real = [], R.flag_outliers
    monkeypatch.setattr(R, "flag_outliers", lambda *a, **k: asked.append(1) or real(*a, **k))
    r = R.reconcile(batch(spark))
    assert r.pairs.count() >= 0 and not asked
    assert r.unmatched.count() == r.unmatched.count() and asked == [1]
