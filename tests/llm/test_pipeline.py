"""The pipeline against its own operators and brute force, on a small table."""

import random

import corpus_pipeline
from pyspark.sql import functions as F
from test_operators import brute_spans, frame, insults, prose


def test_stages(spark, tmp_path):
    rng = random.Random(3)
    rows = [(k, t) for k, t, _ in insults(200)]
    shared = prose(60, rng)
    rows += [(1000 + k, prose(80, rng) + " " + shared) for k in range(10)]
    rows += [(2000 + k, rows[201 + k][1]) for k in range(5)] + [(3000, "12 34"), (3001, None)]
    docs = frame(spark, rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, y) for k, _, y in insults(200)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / f"stage{k}")
        before = docs
        stage(spark, docs, str(tmp_path)).write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = {r.doc_id: r.text for r in docs.collect()} if "text" in docs.columns else docs.collect()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == before.columns
    assert set(kept["language_id"]) == {i for i, _ in rows} - {3000, 3001}
    gone = set(kept["language_id"]) - set(kept["toxicity"])
    assert gone and all(i < 200 and i % 4 == 0 for i in gone)
    assert set(kept["toxicity"]) - set(kept["near_dedup"]) == {2000 + k for k in range(5)}
    want = {i: n for (i, _, n, _, _), c in brute_spans(list(kept["near_dedup"].items())).items()}
    assert all(len(kept["near_dedup"][i].encode()) - want[i] == len(t.encode()) for i, t in kept["suffix_dedup"].items())
    assert sum(want.values()) > 0
    assert {r.doc_id for r in kept["packing"]} == set(kept["suffix_dedup"])
    assert corpus_pipeline.run(spark, str(tmp_path)).agg(F.sum("length").alias("n")).first().n == sum(r.length for r in kept["packing"])
