"""From raw documents to packed sequences, in five stages over whole tables.

Toxic documents go, one document of each near-duplicate group stays, sentences
of repeated passages are cut out, sources are repeated towards tempered
weights, and all tokens are packed. Every stage is written as Parquet in the
folder that the cluster names for checkpoints and read again by the next.

Any column may be null and extra columns are carried along. Documents without
text are clean and alike to nothing; rows that share an id stay or go
together in the near-duplicate stage; rows with a null id are kept by it and
not compared for passages. Empty tables pass through as empty ones.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.common import checked_broadcast
from shelfmark.llm.minhash_bayes import near_duplicates
from shelfmark.llm.mixture_packing import pack
from shelfmark.llm.sentence_spans import remove_repeats
from shelfmark.llm.temperature_mix import mix
from shelfmark.llm.toxic_automata import keep_clean, train, training_labels
from shelfmark.session import bound_batches, materialize

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
# Stages run one after the other on the same executors, whose memory holds what the
# earlier ones grew to: a batch of whole texts is kept far below Spark's 64 MB.
BATCH_BYTES = "2m"


def bounded(stage):
    """``stage`` with batches for Python workers of BATCH_BYTES at most."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bound_batches(spark, BATCH_BYTES)
        return stage(spark, docs, sf_dir)

    return run


@bounded
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5, learned from the labels of these documents."""
    labels = training_labels(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    lexicon, weights = train(docs.select("doc_id", "text"), labels)
    return keep_clean(docs, lexicon, weights)


@bounded
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that a smaller id of their group stands for."""
    dropped = materialize(
        near_duplicates(docs).filter(~F.col("kept")).select("doc_id").distinct(), "dropped")
    return docs.join(checked_broadcast(dropped), "doc_id", "left_anti").select(docs.columns)


@bounded
def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without sentences of repeated passages; documents of nothing else go.

    n_chars, where there is one, follows the text of documents that changed.
    """
    cut = remove_repeats(docs, whole=3)
    changed = F.coalesce(F.col("n_removed") > 0, F.lit(False))
    cut = cut.filter(~(changed & (F.col("text") == "")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        cut = cut.withColumn("n_chars", F.when(changed, F.length("text").cast(kind))
                             .otherwise(F.col("n_chars")))
    return cut.select(docs.columns)


@bounded
def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, and those of small sources up to twice."""
    return mix(docs, max_repeats=2.0)


@bounded
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of the packed sequences."""
    return pack(docs, VOCABULARY, end_id=1)


STAGES = [
    ("toxicity", toxicity),
    ("near_copies", near_copies),
    ("passages", passages),
    ("mixed_sources", mixed_sources),
    ("packing", packed),
]

# Neither the learned model nor tokens can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
