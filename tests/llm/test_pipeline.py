"""The stages one by one on what their predecessors left."""

import corpus_pipeline
from pyspark.sql import functions as F

from sondage.llm import pseudonyms
from sondage.session import new_path


def test_stages(spark, folder):
    source = spark.read.parquet(f"{folder}/documents.parquet")
    docs, seen = source, {}
    for name, stage in corpus_pipeline.STAGES:
        path = new_path(spark, "stage")
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = docs
        if name != "packing":
            assert docs.dtypes == source.dtypes
    n = {k: v.count() for k, v in seen.items()}
    assert source.count() >= n["toxicity"] >= n["simhash_near_dedup"] == n["pii_pseudonyms"] >= n["mixing"] > 0
    kept = seen["simhash_near_dedup"]
    assert kept.select("text").distinct().count() == kept.count()
    assert kept.join(seen["toxicity"], "doc_id", "left_anti").count() == 0
    hidden = seen["pii_pseudonyms"].select("doc_id", F.col("text").alias("hidden")).join(kept, "doc_id")
    value = F.rlike("text", F.lit(pseudonyms.FORMATS["email"]))
    assert hidden.where(value & (F.col("text") == F.col("hidden"))).count() == 0
    pieces = seen["packing"]
    assert pieces.select("doc_id").distinct().count() == seen["mixing"].select("doc_id").distinct().count()


def test_run_equals_its_stages(spark, folder):
    whole = corpus_pipeline.run(spark, folder)
    assert whole.count() > 0 and "sequence_id" in whole.columns


def test_odd_rows(spark, tmp_path):
    """Nulls, repeated rows, empty and very long texts, clashing columns, empty tables."""
    rows = [
        (1, "one two three four five", "en", "s", 5), (1, "one two three four five", "en", "s", 5), (2, None, None, None, None),
        (None, "", "en", "s", 0), (3, "word " * 50_000, "de", "s", 1), (4, "ONE two three four five", "en", "s", 5),
    ]
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    for name, data in (("some", rows), ("none", [])):
        folder = str(tmp_path / name)
        spark.createDataFrame(data, kinds).selectExpr("*", "1 AS score", "2 AS fp", "3 AS row1", "4 AS key").write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        out = corpus_pipeline.run(spark, folder)
        if data:
            # One of the equal rows stays, empty texts are one group.
            assert {r["doc_id"] for r in out.collect()} == {1, 2, 3}
        else:
            assert out.count() == 0
