import corpus_pipeline as cp
from test_dedup import brute_components
from test_packing import check
from test_pii import brute

from ledgerloom.llm import language_id
from ledgerloom.llm.language_id import has_letter
from ledgerloom.llm.packing import encode
from ledgerloom.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = [(9001, None), (9002, ""), (9003, "... 123"), (9004, "The same text here, with é."), (9005, "the SAME text here, with é."), (9005, "the SAME text here, with é."), (9006, "mail me: a.b@example.org now")]
    docs = docs.unionByName(spark.createDataFrame([(i, t, None, "x", len(t or "")) for i, t in extra], docs.schema))
    columns = docs.columns
    rows = [r.asDict() for r in docs.collect()]
    for name, stage in cp.STAGES:
        out = stage(spark, docs, SF)
        if name == "best-fit packing":
            used, least = check(out.toPandas(), {r["doc_id"]: r["text"] for r in rows}, 2048)
            assert used <= least * 1.03 + 1
            break
        assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        got = [r.asDict() for r in docs.collect()]
        if name == "language ID":
            assert {r["doc_id"] for r in rows if has_letter(r["text"])} == {r["doc_id"] for r in got}
        elif name == "exact dedup":
            first = {}
            for r in sorted(rows, key=lambda r: r["doc_id"]):
                first.setdefault("".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"]), r["doc_id"])
            assert sorted(r["doc_id"] for r in got) == sorted(first.values())
        elif name == "SimHash near-dedup":
            assert {r["doc_id"] for r in got} <= {r["doc_id"] for r in rows} and len(got) >= 0.9 * len(rows)
        else:
            assert sorted(r["doc_id"] for r in got) == sorted(r["doc_id"] for r in rows)
            texts = {r["doc_id"]: r["text"] for r in got}
            assert texts[9006] == "mail me: [EMAIL] now"
            for r in rows:
                if not brute(r["text"])[1]:
                    assert texts[r["doc_id"]] == r["text"]
        rows = got


def test_run_and_empty_table(spark):
    assert cp.run(spark, SF).count() > 100
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        docs2 = stage(spark, docs, SF)
        assert docs2.count() == 0
