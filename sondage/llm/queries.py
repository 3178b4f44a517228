"""The queries of this subpackage, over whole tables: name -> (spark, folder) -> DataFrame."""

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.llm.conversations import Repair, conversation_key, damaged
from sondage.llm.grouping import grouped_packing
from sondage.llm.infilling import fill_in_middle, restored
from sondage.llm.mixing import document_rates, fit_domains
from sondage.llm.packing import harmonic_packing
from sondage.llm.pitman_yor import fit_pitman_yor, score_texts
from sondage.llm.pseudonyms import PATTERN, pseudonymise
from sondage.llm.repetition import repetition_quality
from sondage.llm.secrets import secret_report
from sondage.llm.simhash import near_duplicates
from sondage.llm.sketches import edited_fingerprints
from sondage.llm.toxicity import fit_toxicity, score_toxicity
from sondage.llm.warc import read_archive, write_archive
from sondage.session import new_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def remainder(key, divisor: int):
    """crc32 of an id as text, modulo ``divisor``; a null id has remainder 0."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % divisor, F.lit(0))


@query
def op1_pitman_yor(spark, folder):
    docs = table(spark, folder, "documents")
    held_out = remainder(docs["doc_id"], 7) == 2
    scored = score_texts(docs, fit_pitman_yor(docs, ~held_out))
    return scored.select("doc_id", (remainder(F.col("doc_id"), 7) == 2).alias("held_out"), *scored.columns[1:])


@query
def op2_harmonic_packing(spark, folder):
    path = public_tokenizers.path("word_bpe_49k.json")
    return harmonic_packing(table(spark, folder, "documents"), path)


@query
def op3_covering_simhash(spark, folder):
    return near_duplicates(table(spark, folder, "documents"))


@query
def op4_trigram_secrets(spark, folder):
    return secret_report(table(spark, folder, "documents"))


@query
def op5_invertible_sketches(spark, folder):
    return edited_fingerprints(table(spark, folder, "documents"))


@query
def op6_soft_mixing(spark, folder):
    """Rates that bring poor and toxic documents to a small share of as many tokens."""
    labels = table(spark, folder, "labels")
    domain = F.when(F.col("quality") == 0, "poor").when(F.col("toxic") == 1, "toxic").otherwise("good")
    docs = table(spark, folder, "documents")
    model = fit_domains(docs, labels.select("doc_id", domain.alias("domain")), ("poor", "good", "toxic"))
    rates = document_rates(docs, model, {"poor": 0.03, "good": 0.95, "toxic": 0.02})
    return rates.select(F.col("key").alias("doc_id"), "n_copies", "n_tokens", "p_poor", "p_good", "p_toxic", "rate", "copies")


@query
def op7_warc_archive(spark, folder):
    archive = new_path(spark, "warc")
    write_archive(table(spark, folder, "pages"), archive)
    records = read_archive(spark, archive)
    return records.select(
        "page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), "payload_digest",
        "record_type", "refers_to",
    )


@query
def op8_deobfuscated_toxicity(spark, folder):
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = fit_toxicity(docs, labels, lambda key: remainder(key, 3) != 1)
    scored = score_toxicity(docs, model)
    held_out = remainder(F.col("doc_id"), 3) == 1
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query
def op9_repetition_quality(spark, folder):
    return repetition_quality(table(spark, folder, "documents"))


@query
def op10_feistel_pseudonyms(spark, folder):
    docs = table(spark, folder, "documents")
    n = F.size(F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)))
    found = docs.select("doc_id", "text", F.when(F.rlike("text", F.lit("@|[0-9]")), n).otherwise(0).cast("long").alias("n_values"))
    return pseudonymise(found, "a secret of the corpus")


@query
def op11_hirschberg_repair(spark, folder):
    turns = table(spark, folder, "conversations")
    repair = Repair(damaged(turns))
    every = turns.select(conversation_key("conv_id").alias("key"), "conv_id").groupBy("key").agg(F.any_value("conv_id").alias("conv_id"))
    found = every.join(repair.report, "key", "left").join(repair.digests(), "key", "left")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    empty = F.sha2(F.lit(""), 256)
    return found.select(
        "conv_id", *(F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in counts),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256"),
    )


@query
def op12_linear_grouping(spark, folder):
    path = public_tokenizers.path("byte_bpe_50k.json")
    return grouped_packing(table(spark, folder, "documents"), path)


@query
def op13_rank_index_infilling(spark, folder):
    found = fill_in_middle(table(spark, folder, "documents"))
    back = restored(F.col("output"), F.col("form"))
    return found.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"),
    )


QUERIES["pipeline"] = corpus_pipeline.run
