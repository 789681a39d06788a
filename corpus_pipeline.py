"""From raw documents to packed training sequences, stage by stage.

Toxic documents go, documents of low quality go, one document of each group of
near copies stays, sources are mixed to target weights, and what is left is
packed into sequences. Each stage gets the rows its predecessor kept and returns
them with the columns of ``documents``; the last returns the placed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from touchline.llm import jaccard, mixing, packing, quality, toxicity
from touchline.llm.common import read, saved
from touchline.llm.queries import THRESHOLD, tokenizer

BATCH_BYTES = 1 << 20  # of whole texts in an Arrow batch


def small_texts(spark: SparkSession) -> None:
    """Arrow batches bounded by bytes from here on.

    By rows alone a batch holds ten thousand whole texts; Spark's buffers and both
    Python workers of an executor grow with it and keep that memory through all
    stages. It stays set: a stage's result is read after the stage has returned.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_texts(spark)
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), "toxic", 4, 2)
    return toxicity.score(docs, model, out="toxicity_score").where(F.col("toxicity_score") < THRESHOLD).select(*docs.columns)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_texts(spark)
    model = quality.fit(docs, read(spark, sf_dir, "labels"), "quality", 5, 0)
    return quality.score(docs, model, out="quality_score").where(F.col("quality_score") >= THRESHOLD).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_texts(spark)
    return jaccard.keep_one(docs, words=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeated(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_texts(spark)
    return packing.pack(packing.pieces(docs, tokenizer()))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("jaccard_join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
ORACLE_SQL = None  # classifiers and packing are not expressible


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
