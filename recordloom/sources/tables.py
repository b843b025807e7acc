"""SQL tables: JDBC, and small tables described in text."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

# column types of described tables: fixed values
SQL_TYPES = {"INTEGER": "int", "INT": "int", "SMALLINT": "smallint", "BIGINT": "bigint", "DATE": "date",
             "TIMESTAMP": "timestamp", "FLOAT": "double", "DOUBLE": "double"}


def spark_type(sql_type: str) -> str:
    t = sql_type.strip().upper()
    sized = re.fullmatch(r"(DECIMAL|NUMERIC)\s*\((\d+)\s*(?:,\s*(\d+))?\)", t)
    if sized:
        return f"decimal({sized[2]},{sized[3] or 0})"
    if re.match(r"(VARCHAR|CHAR|CHARACTER|CLOB)\b", t):
        return "string"
    return SQL_TYPES[t]


def jdbc(spark: SparkSession, url: str, table: str, partition_column: str | None = None,
         bounds: tuple[int, int] | None = None, partitions: int = 32, **options) -> DataFrame:
    """A database table; with a partition column it is read by many tasks."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if partition_column and bounds:
        reader = reader.options(partitionColumn=partition_column, lowerBound=bounds[0],
                                upperBound=bounds[1], numPartitions=partitions)
    return reader.load()


def described(spark: SparkSession, description: dict) -> dict[str, DataFrame]:
    """Tables from a parsed description: name -> {columns: {name: type}, rows: [...]}.

    Rows are mappings or lists in column order.
    """
    out = {}
    for name, spec in description.items():
        columns = spec["columns"]
        if isinstance(columns, list):
            columns = {c["name"]: c["type"] for c in columns}
        schema = ", ".join(f"`{c.lower()}` {spark_type(t)}" for c, t in columns.items())
        names = list(columns)
        rows = [tuple(r.get(c) for c in names) if isinstance(r, dict) else tuple(r) for r in spec.get("rows") or []]
        out[name.lower()] = spark.createDataFrame(rows, schema)
    return out


def described_file(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    import yaml

    with open(path, encoding="utf-8") as f:
        body = yaml.safe_load(f)
    return described(spark, body.get("tables", body))


def seed(tables: dict[str, DataFrame]) -> None:
    """Start a run from these contents: each table's view is replaced."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
