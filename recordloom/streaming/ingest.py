"""Record files as they arrive: the sequential read, kept going."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recordloom.layout import Layout
from recordloom.sources.records import register


def stream_lines(spark: SparkSession, path: str, layout: Layout, max_files: int | None = None) -> DataFrame:
    """New line files under ``path``, decoded by the same layout expressions."""
    reader = spark.readStream.option("recursiveFileLookup", "true")      # also what an EXTEND adds
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return layout.decode(reader.text(path))


def stream_fixed(spark: SparkSession, path: str, layout: Layout, keep: tuple[str, ...] = ()) -> DataFrame:
    """Fixed-length records as they arrive, in new files and at the ends of those that grow, decoded by
    the same layout expressions; ``keep`` may name file and offset."""
    register(spark)
    reader = spark.readStream.format("fixed_records").option("recordLength", str(layout.length)).option("positions", str(bool(keep)).lower())
    return layout.decode(reader.load(path), keep=keep)
