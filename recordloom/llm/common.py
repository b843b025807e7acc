"""What the training-data operators share: stored tables, words, split choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from recordloom.session import scratch_path, table

#: White space as the contracts have it: space and \x09-\x0D.
SPACES = "[ \\x09-\\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back.

    Cuts lineage, survives lost executors, and gives Spark the real size when
    it chooses between a broadcast and a shuffle.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spaced_words(text: Column) -> Column:
    """The words of a text between white space; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def may_learn(doc_id: Column) -> Column:
    """Rows that a model may learn from: all but those with remainder 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 != 2, F.lit(False))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))
