"""From raw documents to packed training sequences: five stages, each one of the operators of ``clinspan.llm``.

Each stage works on all rows that the one before kept. ``run`` writes every stage's result as Parquet to
the shared folder and reads it back for the next, so a lost executor costs part of one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinspan.llm import mixing, packing, private_spans, signature_trees, toxicity
from clinspan.llm.stored import store

ORACLE_SQL = None  # no stage after the first word count can be told in SQL; tests compare with plain versions


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the rejection threshold, by a model fitted on the labels of two folds of three."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").where(fold != 1)
    score = "score"
    while score in docs.columns:
        score += "_"
    scored = toxicity.score_documents(docs, toxicity.fit(docs, labels), into=score)
    return scored.where(F.col(score) < toxicity.REJECT).drop(score)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the least id."""
    return signature_trees.keep_one(docs)


def mask_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind in brackets; ``n_chars`` follows."""
    return private_spans.mask_documents(docs, private_spans.fit(docs), length_col="n_chars")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, those of small sources again as the mixture asks."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes: bin, capacity, offset."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_copies),
    ("private_spans", mask_private),
    ("temperature_mix", mix_sources),
    ("best_fit_pack", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"corpus-{name}")
    return docs
