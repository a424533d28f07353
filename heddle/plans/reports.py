"""Review reports over labelled documents and conversations. These go beyond parity: the definitions are this project's."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def label_rollup(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents and labels per source and language, with subtotals per source and a total."""
    narrow = documents.select("doc_id", "source", "lang")
    joined = narrow.join(labels, "doc_id", "left")
    return joined.rollup("source", "lang").agg(
        F.count("*").alias("n_docs"), F.count("quality").alias("n_labelled"),
        F.coalesce(F.sum("quality"), F.lit(0)).alias("n_good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("n_toxic"),
    )


def turn_checks(conversations: DataFrame) -> DataFrame:
    """Per turn: whether its number follows the one before and whether its role differs from it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return conversations.select(
        "conv_id", "turn",
        F.coalesce(F.col("turn") == F.lag("turn").over(w) + 1, F.lit(True)).alias("follows"),
        F.coalesce(F.col("role") != F.lag("role").over(w), F.lit(True)).alias("changes"),
    )
