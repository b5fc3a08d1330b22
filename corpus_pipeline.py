"""Documents to training pieces in five stages: quality classifier, line dedup, n-gram Jaccard join, mixing, SentencePiece.

Each stage takes (spark, docs, sf_dir), works on all documents that its predecessor kept, and returns a DataFrame that run() writes
as Parquet in the shared folder and reads again for the next one. All but the last return the columns of documents.
Nulls, empty texts and repeated rows are treated as the stages' operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayframe.llm import common, line_dedup, mixing, ngram_join, piece_nbest, quality_cnn


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte network, fitted on the labelled rows of all folds but the held-out one, does not reject."""
    network = quality_cnn.train(docs, common.table(spark, sf_dir, "labels"))
    scored = quality_cnn.score_quality(docs, network)
    return scored.where("predicted = 1").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document, or an earlier place, has; n_chars anew.

    Passages are three lines or more, fewer lines of over 50 words together, and whole texts of under three lines.
    """
    out = line_dedup.dedup(docs, long_words=line_dedup.LONG_WORDS)
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of documents that near duplicates link, the one of the smallest doc_id, with all rows of that doc_id; all without doc_id."""
    classes = ngram_join.join_classes(docs.select("doc_id", "text"))
    copies = classes.where("component_id <> doc_id").select("doc_id")
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources, each document as often as it is taken."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of the mix, with the scores of the best segmentations; one row per document taken."""
    return piece_nbest.encode(docs, keep=("doc_id", "source"))


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mixture),
    ("SentencePiece encoding and decoding", tokens),
]

#: A network, a join to a fixed point and a lattice search are not SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents."""
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = common.checkpointed(stage(spark, docs, sf_dir), docs)
    return docs
