"""A training corpus from raw documents, stage by stage.

Quality rules drop documents, the Jaccard join leaves the smallest id of each
group of near duplicates, substring dedup cuts text that stood before, benchmark
decontamination drops documents that hold test items, and packing turns the rest
into sequences of tokens.  Each stage is written as Parquet and read again.

Documents are told apart by ``doc_id``: rows with one id share the fate of that
id, and rows without an id pass the filters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telluria.llm.decontaminate import decontaminate
from telluria.llm.ngram_join import jaccard_components
from telluria.llm.packing import pack_documents
from telluria.llm.quality import quality
from telluria.llm.queries import table, tokenizer_path
from telluria.llm.superkmer import remove_repeated_windows
from telluria.session import scratch_path

SHINGLE_WORDS, SIMILARITY = 5, (4, 5)  # of near duplicates; op1 has a contract of its own
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    return docs.join(gone.select("doc_id").distinct(), "doc_id", "left_anti").select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or the perplexity bands reject go."""
    return without(docs, quality(docs).where("not kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group only the document with the smallest id stays, once."""
    found = jaccard_components(docs, k=SHINGLE_WORDS, t=SIMILARITY)
    repeated = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    rest = without(docs, found.where("doc_id <> component_id"))
    if repeated.isEmpty():
        return rest
    return rest.withColumn("copy", F.xxhash64("text")).dropDuplicates(["doc_id", "copy"]).select(*COLUMNS)


def repeated_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 20 words that stood before are cut; emptied documents go."""
    cut = remove_repeated_windows(docs, carry=("lang", "source"), layout=True)
    return cut.where("n_removed = 0 or n_removed < n_words").select(
        "doc_id", F.col("kept_text").alias("text"), "carried.lang", "carried.source",
        F.length("kept_text").cast("long").alias("n_chars"))


def benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return without(docs, decontaminate(docs, table(spark, sf_dir, "benchmark")).where("contaminated"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences, a row for each piece of a document."""
    return pack_documents(docs, tokenizer_path())


STAGES = [("quality_rules", quality_rules), ("ngram_jaccard_join", near_duplicates),
          ("substring_dedup", repeated_text), ("benchmark_decontamination", benchmark_items), ("packing", packed)]
# Perplexity and tokens are beyond SQL; tests/llm compares each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = scratch_path(spark, "corpus")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
