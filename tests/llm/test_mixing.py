"""Domain posteriors on held-out rows, and rates against the plain optimum."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sondage.llm import mixing

FOLDER = "/root/testdata/sf0.1"
DOMAINS = ("poor", "good", "toxic")


def domain(labels):
    kind = F.when(F.col("quality") == 0, "poor").when(F.col("toxic") == 1, "toxic").otherwise("good")
    return labels.select("doc_id", kind.alias("domain"))


@pytest.fixture(scope="module")
def model(spark):
    labels = domain(spark.read.parquet(f"{FOLDER}/labels.parquet"))
    return mixing.fit_domains(spark.read.parquet(f"{FOLDER}/documents.parquet"), labels.where("doc_id % 3 <> 1"), DOMAINS)


def test_held_out_posteriors(spark, model):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("doc_id % 3 = 1")
    known = mixing.posteriors(docs, model).join(domain(spark.read.parquet(f"{FOLDER}/labels.parquet")).withColumnRenamed("doc_id", "key"), "key")
    rows = known.collect()
    right = [DOMAINS[int(np.argmax([r["p0"], r["p1"], r["p2"]]))] == r["domain"] for r in rows]
    assert np.mean(right) > 0.9
    assert all(abs(r["p0"] + r["p1"] + r["p2"] - 1) < 0.01 for r in rows)


def test_scores_against_plain_sums(spark, model):
    """A document's score is the sum of its features' weights."""
    texts = [(1, "The of thing ### idiot"), (2, ""), (3, None), (3, None), (4, "A A a É")]
    df = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 AS row1", "2 AS words", "3 AS tokens", "3 AS rate")
    weights = {r["feature"]: r["w"] for r in model.weights.collect()}
    source = df.dropDuplicates(["doc_id"]).select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = mixing._exploded(mixing._features(source), ["doc_id"])
    for row in rows.groupBy("doc_id").agg(F.collect_list("feature").alias("features")).collect():
        scores = np.array(model.prior) + sum(np.array(weights.get(f, (0.0,) * 3)) for f in row["features"])
        p = np.exp((scores - scores.max()) / model.temperature)
        found = mixing.posteriors(df, model).where(F.col("key") == row["doc_id"]).collect()
        assert len(found) == 1 and found[0]["n_copies"] == (2 if row["doc_id"] == 3 else 1)
        assert [found[0][f"p{k}"] for k in range(3)] == pytest.approx((p / p.sum()).tolist(), abs=2e-3)


def optimum(p, n, weights, total, most, pull=1e-3):
    """The same problem by many steps over single documents."""
    r, scale = np.ones(len(n)), np.maximum((n[:, None] * p).sum(0), 1e-9 * n.sum())
    goal = np.array(weights) / sum(weights) * total
    curve = np.einsum("i,ij,ik->jk", n, p, p) / np.sqrt(np.outer(scale, scale))
    step = 1 / (np.linalg.eigvalsh(curve).max() + pull)
    for _ in range(3000):
        error = ((n * r) @ p - goal) / scale
        r = np.clip(r - step * (p @ error + pull * (r - 1)), 0, most)
    return r


@pytest.mark.parametrize("most", [None, 1.0])
def test_rates(spark, most):
    generator = np.random.default_rng(3)
    p = np.round(generator.dirichlet([0.3, 0.3, 0.3], 200), 2)
    n = generator.integers(1, 500, 200)
    rows = [(*map(float, x), int(m), 1) for x, m in zip(p, n)]
    known = spark.createDataFrame(rows, "p0 double, p1 double, p2 double, n_tokens long, n_copies long")
    weights, total = [0.6, 0.3, 0.1], 0.6 * n.sum()
    rates = mixing.fit_rates(known, weights, total=float(total), most=most, steps=400, tolerance=1e-9)
    found = {(r["p0"], r["p1"], r["p2"]): r["rate"] for r in rates.collect()}
    got = np.array([found[tuple(x)] for x in p])
    wanted = optimum(p, n, weights, total, most or np.inf)
    assert (got >= 0).all() and (most is None or (got <= most).all())
    assert ((n * got) @ p / total).tolist() == pytest.approx(((n * wanted) @ p / total).tolist(), abs=5e-3)
    if most is None:
        assert ((n * got) @ p / total).tolist() == pytest.approx([0.6, 0.3, 0.1], abs=5e-3)


def test_mixed_rows(spark, model):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").withColumn("p0", F.lit(1)).withColumn("copies", F.lit("x"))
    out = mixing.mixed(docs, model, {"poor": 0.02, "good": 0.96, "toxic": 0.02}, whole=1, most=1.0)
    assert out.columns == docs.columns
    kept = out.join(domain(spark.read.parquet(f"{FOLDER}/labels.parquet")), "doc_id").groupBy("domain").count().collect()
    all_of = {r["domain"]: r["count"] for r in domain(spark.read.parquet(f"{FOLDER}/labels.parquet")).groupBy("domain").count().collect()}
    kept = {r["domain"]: r["count"] / all_of[r["domain"]] for r in kept}
    assert kept["good"] > 0.95 and kept["poor"] < 0.5 and kept["toxic"] < 0.7


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(None, "good"), (1, None)], "doc_id long, domain string")
    model = mixing.fit_domains(docs, labels, ("good", "poor"))
    found = mixing.document_rates(docs, model, {"good": 0.9, "poor": 0.1}).collect()
    assert [(r["p_good"], r["rate"], r["copies"]) for r in found] == [(0.5, 1.0, 1)] * 2
    assert mixing.mixed(docs.limit(0), model, {"good": 0.5, "poor": 0.5}).count() == 0


def test_words_are_split_in_compiled_code(spark):
    """Empty words go without a function called word by word."""
    rows = [" a  b\ta\n", "", "   ", "x", "A b a B"]
    found = mixing._features(spark.createDataFrame([(t,) for t in rows], "text string"))
    assert [r["n_tokens"] for r in found.collect()] == [3, 0, 0, 1, 4]
    assert "lambda" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_words_are_split_once(spark, model):
    """No filter before the rows of tokens works the tokens out as well."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for keyed in (mixing.posteriors(docs, model), mixing.posteriors(docs.limit(5), model)):
        assert keyed._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
