"""A corpus pipeline: five operators one after another, from raw to mixed documents.

Each stage takes what its predecessor kept, written as Parquet and read again, and returns the
columns of documents.

Defined results: the language stage rejects null texts, texts without letters, and texts of which
less than ``MIN_SCORE`` is evidence for a target language; a null ``lang`` is replaced by the one
found; where no document has a language there is nothing to judge by, and all are passed on. Of
near duplicates the smallest id stays (null last), of repeated rows one; documents without id
are told apart by their text. Texts that lose all words are empty and stay until the mix, which
takes no document without words. Ties in the mix are settled by hashes, so reruns agree. An
empty table gives an empty table; columns other than those of documents are dropped.

The stages bound what a task hands to Python at a time (``bound_batches``), for the whole session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewright.llm import decontam, langid, mixing, simhash, substring
from ratewright.llm.text import bound_batches
from ratewright.plans.inputs import table
from ratewright.sources import work_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


# Languages to keep, None for all that documents are labelled with, and the least share of a text's
# n-grams that speaks for its language.
TARGET_LANGUAGES: tuple[str, ...] | None = None
MIN_SCORE = 0.5


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are in a target language by their text, with that language if they had none."""
    bound_batches(spark)
    model = langid.learn(docs)
    if not model.languages:
        return docs.select(*COLUMNS)
    found = langid.identify(docs, model, carry=(*COLUMNS,))
    targets = [x for x in TARGET_LANGUAGES or model.languages if x != langid.UNDETERMINED]
    kept = found.filter(F.col("lang_pred").isin(targets) & (F.col("score") >= MIN_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group."""
    bound_batches(spark)
    return simhash.keep_one(docs).select(*COLUMNS)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that repeat anywhere."""
    bound_batches(spark)
    cut = substring.dedup_substrings(docs)
    rows = cut.select("row.*", F.col("kept").alias("text"))
    n_chars = F.length("text").cast(docs.schema["n_chars"].dataType)
    return rows.withColumn("n_chars", n_chars).select(*COLUMNS)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    bound_batches(spark)
    return decontam.without_matches(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it is taken."""
    return mixing.mix(docs).select(*COLUMNS)


STAGES = [
    ("language_id", keep_known_languages),
    ("simhash_near_dedup", keep_one_of_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("source_mixing", mix_sources),
]

# Language identification and alignment can't be put in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept = stage(spark, docs, sf_dir)
        path = work_path(spark, name)
        kept.write.parquet(path)
        docs = spark.read.schema(kept.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
