"""Embedded SQL: host variables, outcomes and data change.

Statement text goes to ``spark.sql`` with named parameters; only what belongs
to the host language is taken out of it first.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from recordloom.functions.text import fit

# outcome codes: fixed values
SUCCESS, NO_ROW, TOO_MANY, DUPLICATE_KEY, NO_TABLE, NO_COLUMN = 0, 100, -811, -803, -204, -206
SQLSTATE = {0: "00000", 100: "02000", -811: "21000", -803: "23505", -204: "42704", -206: "42703"}
VERBS = ("SELECT", "INSERT", "UPDATE", "DELETE")
WARNINGS = {"WITH UR": r"\bWITH\s+UR\b", "FOR UPDATE": r"\bFOR\s+UPDATE(\s+OF\s+\w+(\s*,\s*\w+)*)?",
            "FETCH FIRST": r"\bFETCH\s+FIRST\s+(\d+)?\s*ROWS?\s+ONLY\b"}
_APART = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|--[^\n]*|/\*.*?\*/", re.S)
_HOST = re.compile(r"(?<!:):([A-Za-z][\w-]*)(?:\s*:\s*([A-Za-z][\w-]*))?")      # a::int is no variable


class HostVariableError(LookupError):
    """SQL_HOST_VARIABLE_NOT_FOUND"""


class UnsupportedStatement(ValueError):
    pass


@dataclass(frozen=True)
class Outcome:
    sqlcode: int
    rows: DataFrame | None = None
    count: int | None = None
    warnings: tuple[str, ...] = ()

    @property
    def sqlstate(self) -> str:
        return SQLSTATE.get(self.sqlcode, "58004")


def statement(text: str, host: dict[str, object] | None = None) -> tuple[str, dict[str, object], list[str]]:
    """Host-free SQL text, its named arguments, and what was set aside.

    Literals, quoted names and hints are set apart before anything is looked for,
    and come back as they were; comments go. FETCH FIRST becomes a LIMIT where it
    stands, in subqueries too, with or without a number. Text values lose trailing blanks; a
    variable with a negative indicator is bound as null. Every occurrence of a
    variable has an argument of its own, as its indicator may differ.
    """
    host = {k.upper(): v for k, v in (host or {}).items()}
    apart: list[str] = []

    def set_apart(m: re.Match) -> str:
        if m[0].startswith(("--", "/*")) and not m[0].startswith("/*+"):
            return " "
        apart.append(m[0])
        return f"\x00{len(apart) - 1}\x00"

    body = _APART.sub(set_apart, text).strip().rstrip(";").rstrip()
    verb = body.split(None, 1)[0].upper()
    if verb not in VERBS:
        raise UnsupportedStatement(f"Unsupported SQL statement type: {verb}")
    warnings = [name for name, pattern in WARNINGS.items() if re.search(pattern, body, re.I)]
    if verb == "SELECT":
        body = re.sub(r"\bINTO\s+:[\w\s:,-]+?(?=\bFROM\b|$)", "", body, count=1, flags=re.I)
    body = re.sub(WARNINGS["FETCH FIRST"], lambda m: f"LIMIT {m[1] or 1}", body, flags=re.I)
    for pattern in (WARNINGS["WITH UR"], WARNINGS["FOR UPDATE"]):
        body = re.sub(pattern, "", body, flags=re.I)
    body = re.sub(r"\bFROM\s+SYSIBM\.SYSDUMMY1\b", "", body, flags=re.I)
    body = re.sub(r"\bCURRENT\s+TIMESTAMP\b", "current_timestamp()", body, flags=re.I)
    args: dict[str, object] = {}

    def bind(m: re.Match) -> str:
        name, indicator = m[1].upper(), (m[2] or "").upper()
        for n in filter(None, (name, indicator)):
            if n not in host:
                raise HostVariableError(f"SQL_HOST_VARIABLE_NOT_FOUND: {n}")
        value = host[name]
        if indicator and int(host[indicator]) < 0:
            value = None
        elif isinstance(value, str):
            value = value.rstrip(" ")
        key = f"h{len(args)}"
        args[key] = value
        return f":{key}"

    body = _HOST.sub(bind, body)
    return re.sub(r"\x00(\d+)\x00", lambda m: apart[int(m[1])], body).strip(), args, warnings


def query(spark: SparkSession, text: str, host: dict[str, object] | None = None) -> DataFrame:
    body, args, _ = statement(text, host)
    return spark.sql(body, args=args)


def sqlcode(error: Exception) -> int:
    """Outcome code of a failed statement; unknown failures keep -1."""
    name = error.getCondition() if isinstance(error, PySparkException) else None
    state = error.getSqlState() if isinstance(error, PySparkException) else None
    if name and name.startswith("TABLE_OR_VIEW_NOT_FOUND"):
        return NO_TABLE
    if name and name.startswith("UNRESOLVED_COLUMN"):
        return NO_COLUMN
    return {"42704": NO_TABLE, "42703": NO_COLUMN, "23505": DUPLICATE_KEY}.get(state or "", -1)


def select_into(spark: SparkSession, text: str, host: dict[str, object] | None = None, order: list[str] | None = None) -> Outcome:
    """Singleton SELECT: first row by ``order``; no row is 100.

    ``count`` is 2 when more than one row qualified.
    """
    body, args, warnings = statement(text, host)
    try:
        df = spark.sql(body, args=args)
        top = (df.orderBy(*order) if order else df).limit(2).collect()
    except PySparkException as e:
        return Outcome(sqlcode(e), warnings=tuple(warnings))
    rows = spark.createDataFrame(top[:1], df.schema)
    return Outcome(SUCCESS if top else NO_ROW, rows, len(top), tuple(warnings))


def lookup_first(requests: DataFrame, target: DataFrame, by: str, key: str, order: str) -> DataFrame:
    """A singleton SELECT per request row, as one join.

    The first qualifying row by ``order`` is found per key before the join;
    SQLCODE is 100 where there is none, and ``row_count`` tells apart the
    lookups that had several.
    """
    body = [c for c in target.columns if c != key]
    first = target.groupBy(key).agg(F.min_by(F.struct(*body), F.col(order)).alias("_r"), F.count(F.lit(1)).alias("row_count"))
    joined = requests.join(first, F.col(by) == F.col(key), "left")
    return joined.select(
        *requests.columns, *[F.col(f"_r.{c}").alias(c) for c in body],
        F.coalesce("row_count", F.lit(0).cast("bigint")).alias("row_count"),
        F.when(F.col("row_count").isNull(), NO_ROW).otherwise(SUCCESS).alias("sqlcode"))


def indicator(column: Column) -> Column:
    """-1 for null, else 0."""
    return F.when(column.isNull(), -1).otherwise(0)


def host_text(column: Column, width: int) -> Column:
    """Null text arrives as blanks."""
    return fit(F.coalesce(column, F.lit("")), width)


# -- data change -------------------------------------------------------------
def updated(df: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    hit = F.coalesce(where, F.lit(False))
    types = dict(df.dtypes)
    return df.withColumns({c: F.when(hit, v.cast(types[c])).otherwise(F.col(c)) for c, v in values.items()})


def deleted(df: DataFrame, where: Column) -> DataFrame:
    return df.where(~F.coalesce(where, F.lit(False)))


def inserted(df: DataFrame, rows: DataFrame, key: list[str], seq: str) -> tuple[DataFrame, DataFrame]:
    """INSERT a batch under a primary key: new table, and rows with sqlcode."""
    first = rows.groupBy(*key).agg(F.min(seq).alias(seq))
    fresh = first.join(df.select(*key), key, "left_anti").select(seq, F.lit(True).alias("_in"))
    outcome = rows.join(fresh, seq, "left").select(
        *rows.columns, F.when(F.col("_in").isNull(), DUPLICATE_KEY).otherwise(SUCCESS).alias("sqlcode"))
    added = rows.join(fresh, seq, "left_semi").select(*df.columns)
    return df.unionByName(added), outcome
