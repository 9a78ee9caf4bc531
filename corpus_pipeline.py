"""From raw documents to packed training sequences, in stages over the operators of `clicktide.llm`.

Each stage is a function of (spark, docs, sf_dir) and keeps the columns of `documents`, but for
the last, which returns the pieces of packed sequences. `run` writes what a stage returns as
Parquet to the shared checkpoint folder and reads it again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from clicktide.llm import mixing, packing, quality, simhash, substrings
from clicktide.session import Written, scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def check_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every rule of the current policy."""
    return quality.ledger(docs.select(COLUMNS)).filter(quality.kept()).select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, that of the smallest doc_id."""
    return simhash.one_of_each(docs.select(COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that occur elsewhere; those of which no word is left go."""
    cut = substrings.without_repeats(docs.select(COLUMNS))
    left = cut.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return left.withColumn("n_chars", F.char_length("text").cast("long")).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight asks for."""
    return mixing.mixed(docs.select(COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", check_quality),
    ("SimHash near-dedup", drop_near_copies),
    ("substring dedup", cut_repeats),
    ("mixing sources", mix_sources),
    ("packing", pack_sequences),
]

# Fingerprints and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of `documents`.

    What a stage has written on its way is dropped when its output is, and its output when the next
    one is; tables of the last stage stay, since its result is read from them.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        with scratch(spark):
            out = Written(stage(spark, docs, sf_dir), kept=True)
        if before is not None:
            before.drop()
        docs, before = out.rows, out
    packed = STAGES[-1][1](spark, docs, sf_dir)
    # Pieces and their ids were written; nothing reads the texts again.
    before.drop()
    return packed
