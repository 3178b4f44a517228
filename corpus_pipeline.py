"""A corpus made ready for training, in five stages over whole tables.

Each stage works on all that its predecessor kept; its result is written as Parquet to the
shared folder (spark.checkpoint.dir) and read again, so that a lost executor repeats one
stage at most.
"""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.llm.mixing import fit_domains, mixed
from sondage.llm.packing import harmonic_packing
from sondage.llm.pseudonyms import pseudonymise
from sondage.llm.simhash import without_near_duplicates
from sondage.llm.toxicity import fit_toxicity, toxicity_score
from sondage.session import new_path

TOXIC = 0.7
KEY = "a secret of the corpus"
# Shares of tokens by quality. The total follows from the good documents, which all stay.
WEIGHTS = {"poor": 0.03, "good": 0.97}


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below TOXIC; learned from two thirds of the labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    training = lambda key: F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3, F.lit(0)) != 1
    score = toxicity_score(fit_toxicity(docs, labels, training))
    return docs.where(score(docs["text"]) < TOXIC)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near copies."""
    return without_near_duplicates(docs)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by pseudonyms; n_chars stays that of the source."""
    return pseudonymise(docs, KEY)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Poor documents thinned out until they hold their share of the tokens."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    labelled = labels.select("doc_id", F.when(F.col("quality") == 0, "poor").otherwise("good").alias("domain"))
    names = tuple(WEIGHTS)
    model = fit_domains(docs, labelled, names)
    return mixed(docs, model, WEIGHTS, whole=names.index("good"), most=1.0)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 2,048, as pieces of documents."""
    return harmonic_packing(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("pii_pseudonyms", hide_personal_data),
    ("mixing", mix_to_weights),
    ("packing", pack),
]

# SQL expresses neither the classifiers nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
