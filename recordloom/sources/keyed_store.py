"""Keyed data sets on disk: files ranged and sorted by key, a manifest of each file's keys, indexes of alternates.

READ and START look at the manifest, a row a file, and open the files whose keys
can match, no others. An alternate has files of its own, (alternate, key) in order
of the alternate, with a manifest likewise. Keys are not null.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from recordloom.operators.keyed import KeySpec

FILE_ROWS = 1 << 20
#: START's relations: fixed values
EQUAL, NOT_LESS, GREATER = "=", ">=", ">"


def _ranged(df: DataFrame, order: list[str], path: str, files: int) -> None:
    df.repartitionByRange(files, *order).sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{path}/rows")
    written = df.sparkSession.read.parquet(f"{path}/rows").select(F.col(order[0]).alias("k"), F.col("_metadata.file_path").alias("file"))
    bounds = written.groupBy("file").agg(F.min("k").alias("low"), F.max("k").alias("high"), F.count(F.lit(1)).alias("rows"))
    bounds.write.mode("overwrite").parquet(f"{path}/manifest")


def write_store(df: DataFrame, spec: KeySpec, path: str, files: int | None = None) -> KeyedStore:
    """Writes the records, the manifest and an index for each alternate. ``files`` is worked out from
    the number of rows where it is not given."""
    n = files or -(-max(df.count(), 1) // FILE_ROWS)
    _ranged(df, [spec.key], f"{path}/primary", n)
    for a in spec.alternates:
        _ranged(df.where(F.col(a.name).isNotNull()).select(a.name, spec.key), [a.name, spec.key], f"{path}/by-{a.name}", n)
    return KeyedStore(df.sparkSession, path, spec)


@dataclass(frozen=True)
class KeyedStore:
    spark: SparkSession
    path: str
    spec: KeySpec

    def _some(self, part: str, column: str, low: object = None, high: object = None, above: bool = False) -> DataFrame:
        """Rows of a part with low <= column <= high (low < column, with ``above``), from the files that can hold any."""
        manifest = self.spark.read.parquet(f"{self.path}/{part}/manifest")
        can = lambda least, most: F.lit(True) & (F.lit(True) if low is None else most > low if above else most >= low) & (F.lit(True) if high is None else least <= high)
        rows = self.spark.read.parquet(f"{self.path}/{part}/rows")
        files = [r["file"] for r in manifest.where(can(F.col("low"), F.col("high"))).select("file").collect()]     # names of the files in range
        if not files:
            return rows.limit(0)
        return self.spark.read.schema(rows.schema).parquet(*files).where(can(F.col(column), F.col(column)))

    def read(self, key: object) -> DataFrame:
        return self._some("primary", self.spec.key, key, key)

    def start(self, relation: str, key: object) -> DataFrame:
        """The records from START's position on; READ NEXT takes them in order of the key."""
        if relation == EQUAL:
            # positioned on an equal key, reading goes on behind it; without one nothing is positioned
            return self._some("primary", self.spec.key, key) if not self.read(key).isEmpty() else self.read(key)
        return self._some("primary", self.spec.key, key, above=relation == GREATER)

    def between(self, low: object, high: object) -> DataFrame:
        return self._some("primary", self.spec.key, low, high)

    def read_alternate(self, name: str, low: object, high: object | None = None) -> DataFrame:
        """Records with an alternate of that value, or from one to the other: from the index's files in range,
        and the files of the records between the lowest and the highest key that it names."""
        keys = self._some(f"by-{name}", name, low, low if high is None else high).select(self.spec.key)
        ends = keys.agg(F.min(self.spec.key), F.max(self.spec.key)).first()
        if ends[0] is None:
            return self.between(None, None).limit(0)
        return self.between(*ends).join(keys, self.spec.key, "left_semi")

