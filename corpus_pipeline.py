"""A training-data pipeline: quality, boilerplate lines, near copies, benchmark leaks, tokens.

``STAGES`` are (name, function) pairs; a function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next one's ``docs``. All but the last
return the columns of ``documents``. Each stage works on all rows that the one before kept.
"""

from __future__ import annotations

from pathlib import Path
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parsimony.llm import bpe, cotrain, decontaminate, linededup, simhash
from parsimony.llm.common import shared_folder, table
from parsimony.llm.queries import TOKENIZERS

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: The stages as SQL: the classifier and the fingerprints have none.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the co-trained classifier finds of low quality or toxic."""
    meta = ["lang", "source", "n_chars"]
    model = cotrain.train(docs, table(spark, sf_dir, "labels"), "doc_id", "text", meta)
    return cotrain.score(docs, "text", meta, model).where("keep").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated lines across sites; a document that consists of nothing else goes."""
    clean = linededup.dedup(docs, "doc_id", "text", "source")
    left = clean.where((F.col("n_removed") == 0) | (F.trim(F.col("text")) != ""))
    return left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: the one with the smallest id."""
    groups = simhash.near_copies(docs, "doc_id", "text")
    kept = groups.where(F.col("component_id").isNull() | (F.col("doc_id") == F.col("component_id"))).select("doc_id").distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["doc_id"]), "left_semi").select(*COLUMNS)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes documents that hold a benchmark item."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text").select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes every text."""
    return bpe.encode(docs.select("doc_id", "lang", "source", "text"), "text", Path(f"{TOKENIZERS}/word_bpe_49k.json").read_text(encoding="utf-8"))


STAGES = [("quality classifier", quality), ("line dedup", lines), ("SimHash near-dedup", near_copies), ("benchmark decontamination", leaks), ("BPE encoding", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the results between them lie in the shared checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return STAGES[-1][1](spark, docs, sf_dir)
