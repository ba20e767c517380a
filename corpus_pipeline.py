"""A training-corpus pipeline: quality rules, exact and near duplicates, source mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's documents. All stages but the last return the columns of the documents.
Documents are carried as they are, with all their columns; nulls, empty and repeated rows have the
results that the operators' docstrings state.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playmetrics.llm import exact, mixing, pieces, quality, simhash
from playmetrics.llm.queries import MIX_EXPONENT, MIX_SEED, MIX_TOTAL
from playmetrics.sources.tables import settle

#: Words in a shingle, and the bits in which fingerprints of near copies may differ.
SHINGLE, RADIUS = 3, 2


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality.keep(docs)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id."""
    return exact.distinct_rows(docs)


def keep_one_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by fingerprints the row with the smallest id (a null id comes last); one row stays
    where several share it."""
    return simhash.one_of_each(docs, SHINGLE, RADIUS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as drawn, in the global order of the copies."""
    copies = mixing.replicate(docs, seed=MIX_SEED, exponent=MIX_EXPONENT, total=MIX_TOTAL)
    return copies.orderBy("key", "replica").select("held.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, and the ids of the text with the source bytes of every piece."""
    model = pieces.read_model(public_tokenizers.path("piece_bpe_32k.model"))
    coded = pieces.encode_documents(docs, model, carry=["doc_id", "source"])
    return coded.withColumn("n_tokens", F.size("ids").cast("bigint"))


STAGES = [
    ("quality", keep_quality),
    ("exact", keep_distinct),
    ("near", keep_one_near),
    ("mix", mix_sources),
    ("encode", encode),
]

#: Fingerprints, drawn copies and byte-pair ids are not stated in SQL; tests compare with plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
