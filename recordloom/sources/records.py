"""Record files: lines, fixed-length records, delimited dumps."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from recordloom.layout import Layout
from recordloom.operators.keyed import Alternate, KeySpec, load
from recordloom.sources import fixed
from recordloom.sources.fixed import filesystem

LINE, FIXED, INDEXED, RELATIVE = "LINE SEQUENTIAL", "SEQUENTIAL", "INDEXED", "RELATIVE"
MODES = {"OUTPUT": "overwrite", "EXTEND": "append"}
EXTENDED = "extended-"     # folder of what an EXTEND added
NUMBER_DIGITS = 19         # of the record number before a record of a relative file: those of the largest bigint


# -- lines -------------------------------------------------------------------
def _text(spark: SparkSession, path: str) -> DataFrame:
    """All lines of a file, those of later EXTENDs included."""
    return spark.read.option("recursiveFileLookup", "true").text(path)


def read_lines(spark: SparkSession, path: str, layout: Layout) -> DataFrame:
    """Text lines decoded by a layout; short lines leave the tail blank."""
    return layout.decode(_text(spark, path))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): line numbers from one within each file.

    A row's place within its split is known while reading; one count per split
    gives the lines in the splits before it.
    """
    raw = _text(spark, path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"))
    splits = raw.groupBy("file", "_start").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    before = Window.partitionBy("file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    base = splits.select("file", "_start", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return raw.join(base, ["file", "_start"]).select(
        "file", (F.col("_base") + F.col("_id") - F.col("_first") + 1).alias("line"), "value")


def arrival(file: str = "file", line: str = "line") -> Column:
    """A line's place in its data set, to order by: the EXTEND that wrote it, then
    the number of its part, then the line."""
    number = lambda pattern: F.coalesce(F.regexp_extract(F.col(file), pattern, 1).try_cast("bigint"), F.lit(0).cast("bigint"))
    return F.struct(number(rf"/{EXTENDED}(\d+)/[^/]*$").alias("extend"), number(r"/part-(\d+)[^/]*$").alias("part"), F.col(file).alias("file"), F.col(line).alias("line"))


def _write(lines: DataFrame, path: str, mode: str) -> None:
    """An EXTEND goes to a folder of its own, numbered on, so that its lines stand
    behind all that were there, whatever their files are called."""
    if mode == "EXTEND":
        from pyarrow import fs

        store, root = filesystem(path)
        there = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
        taken = [int(i.base_name.removeprefix(EXTENDED)) for i in there if i.base_name.startswith(EXTENDED)]
        lines.write.text(f"{path.rstrip('/')}/{EXTENDED}{max(taken, default=0) + 1}")
    else:
        lines.write.mode(MODES[mode]).text(path)


def write_lines(df: DataFrame, layout: Layout, path: str, mode: str = "OUTPUT") -> None:
    """Records as lines without trailing blanks; order is the DataFrame's."""
    _write(layout.encode(df).select(F.rtrim("value").alias("value")), path, mode)


def read_delimited(lines: DataFrame, names: list[str], separator: str = "|", value: str = "value") -> DataFrame:
    """``a|b|c`` lines of a fixed number of fields; any other number is an error."""
    parts = F.split(F.col(value), re.escape(separator), -1)
    n = len(names)
    wrong = F.concat(F.lit(f"expected {n} fields: "), F.col(value))
    checked = F.when(F.size(parts) == n, parts).otherwise(F.raise_error(wrong).cast("array<string>"))
    return lines.select(checked.alias("_p")).select(*[F.get("_p", F.lit(i)).alias(c) for i, c in enumerate(names)])


def decode_pairs(pairs: DataFrame, key_layout: Layout, value_layout: Layout, key: str = "key", value: str = "value") -> DataFrame:
    """Key and value blobs of an index dump, decoded by their layouts."""
    return pairs.select(*key_layout.columns(F.col(key), True), *value_layout.columns(F.col(value), True))


# -- fixed-length records ----------------------------------------------------
def register(spark: SparkSession) -> None:
    """Make the source known; its code travels with it, workers need no install."""
    cloudpickle.register_pickle_by_value(fixed)
    spark.dataSource.register(fixed.FixedRecords)


def raw_fixed(spark: SparkSession, path: str, length: int, positions: bool = False) -> DataFrame:
    register(spark)
    reader = spark.read.format("fixed_records").option("recordLength", str(length))
    return reader.option("positions", str(positions).lower()).load(path)


def read_fixed(spark: SparkSession, path: str, layout: Layout, keep: tuple[str, ...] = ()) -> DataFrame:
    return layout.decode(raw_fixed(spark, path, layout.length, positions=bool(keep)), keep=keep)


def write_fixed(df: DataFrame, layout: Layout, path: str, mode: str = "OUTPUT") -> None:
    register(df.sparkSession)
    layout.encode(df, binary=True).write.format("fixed_records").mode(MODES[mode]).save(path)


# -- file bindings -----------------------------------------------------------
@dataclass(frozen=True)
class FileSpec:
    """SELECT ... ASSIGN: where a file is, how it is organised, what keys it.

    Records of a relative file are stored with their numbers before them;
    without ``numbers_stored`` a record's number is that of its line, which
    holds for one plain text file.
    """

    path: str
    layout: Layout
    organization: str = LINE
    record_key: str | None = None
    alternates: tuple[Alternate, ...] = ()
    relative_key: str = "rrn"
    numbers_stored: bool = True

    @property
    def keys(self) -> KeySpec:
        return KeySpec(self.record_key or self.relative_key, self.alternates)


def open_input(spark: SparkSession, spec: FileSpec) -> DataFrame:
    if spec.organization == LINE:
        return read_lines(spark, spec.path, spec.layout)
    if spec.organization == FIXED:
        return read_fixed(spark, spec.path, spec.layout)
    if spec.organization == RELATIVE and spec.numbers_stored:
        v = F.col("value")
        stored = _text(spark, spec.path).select(v.substr(1, NUMBER_DIGITS).cast("bigint").alias(spec.relative_key), F.substring(v, F.lit(NUMBER_DIGITS + 1), F.length(v)).alias("value"))
        return spec.layout.decode(stored, keep=(spec.relative_key,))
    lines = numbered_lines(spark, spec.path)
    if spec.organization == RELATIVE:
        return spec.layout.decode(lines.withColumnRenamed("line", spec.relative_key), keep=(spec.relative_key,))
    # first record per key, by its place in the data set
    rows = spec.layout.decode(lines.withColumn("_at", arrival()), keep=("_at",))
    return load(rows, spec.record_key, "_at")


def close_output(df: DataFrame, spec: FileSpec, mode: str = "OUTPUT") -> None:
    """Write a file back; keyed files go out in key order."""
    if spec.organization == FIXED:
        write_fixed(df, spec.layout, spec.path, mode)
    elif spec.organization == LINE:
        write_lines(df, spec.layout, spec.path, mode)
    elif spec.organization == RELATIVE:
        at = F.col(spec.relative_key).cast("bigint")
        wrong = F.raise_error(F.concat(F.lit("no record number: "), F.coalesce(F.col(spec.relative_key).cast("string"), F.lit("null")))).cast("string")
        number = F.when(at >= 1, F.lpad(at.cast("string"), NUMBER_DIGITS, "0")).otherwise(wrong)
        records = spec.layout.record(present=set(df.columns))
        lines = df.orderBy(spec.relative_key).select(F.rtrim(F.concat(number, records)).alias("value"))
        _write(lines, spec.path, mode)
    else:
        write_lines(df.orderBy(spec.keys.key), spec.layout, spec.path, mode)


def status_of_open(spark: SparkSession, path: str) -> str:
    """35 when the file is not there, else 00."""
    from pyarrow import fs

    store, root = filesystem(path)
    return "35" if store.get_file_info(root).type == fs.FileType.NotFound else "00"
