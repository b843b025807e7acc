"""Dataset comparison: record by record, as bags, and against a contract."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from recordloom.operators.ordering import number_rows
from recordloom.session import cut

PASS, FAIL, UNVERIFIED, NOT_APPLICABLE = "PASS", "FAIL", "UNVERIFIED", "NOT_APPLICABLE"
#: The names of the checks.
CHECKS = ("output_presence", "file_set", "file_contents", "record_counts",
          "stdout", "stderr", "exit_code", "database_state")


def _side(df: DataFrame, keys: list[str], fields: list[str], prefix: str) -> DataFrame:
    """A row per key: its fields, and how many records have the key."""
    rows = df.select(*[F.col(k).alias(f"{prefix}{k}") for k in keys], F.struct(F.lit(True).alias("here"), *fields).alias("_f"))
    one = rows.groupBy(*[f"{prefix}{k}" for k in keys]).agg(F.min("_f").alias("_f"), F.count(F.lit(1)).alias(f"{prefix}n"))
    return one.select(*[f"{prefix}{k}" for k in keys], *[F.col(f"_f.{c}").alias(f"{prefix}{c}") for c in fields], f"{prefix}n")


def pair(expected: DataFrame, actual: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Both sides by key, prefixed ``e_`` and ``a_``; ``e_n`` and ``a_n`` count records.

    A null key is a key like others. Records that share a key are one row: what
    they hold is not paired, as nothing says which belongs to which.
    """
    e, a = _side(expected, keys, fields, "e_"), _side(actual, keys, fields, "a_")
    same = reduce(lambda x, y: x & y, [F.col(f"e_{k}").eqNullSafe(F.col(f"a_{k}")) for k in keys])
    return e.join(a, same, "full")


def compare(expected: DataFrame, actual: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """One row per difference: keys, kind, field, both values.

    Kinds are MISSING, EXTRA, FIELD, and REPEATED for a key that several records
    of a side have, with their numbers as the values.
    """
    both = pair(expected, actual, keys, fields)
    e_in, a_in = F.col("e_n").isNotNull(), F.col("a_n").isNotNull()

    def entry(kind: str, name: str, left: Column, right: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("field"),
                        left.cast("string").alias("expected"), right.cast("string").alias("actual"))

    none = F.lit(None).cast("string")
    changed = F.array(*[
        F.when(~F.col(f"e_{c}").eqNullSafe(F.col(f"a_{c}")), entry("FIELD", c, F.col(f"e_{c}"), F.col(f"a_{c}")))
        for c in fields])
    repeated = (F.coalesce("e_n", F.lit(0)) > 1) | (F.coalesce("a_n", F.lit(0)) > 1)
    found = (F.when(repeated, F.array(entry("REPEATED", "", F.coalesce("e_n", F.lit(0)), F.coalesce("a_n", F.lit(0)))))
             .when(~a_in, F.array(entry("MISSING", "", none, none)))
             .when(~e_in, F.array(entry("EXTRA", "", none, none)))
             .otherwise(F.filter(changed, lambda x: x.isNotNull())))
    key_cols = [F.when(e_in, F.col(f"e_{k}")).otherwise(F.col(f"a_{k}")).alias(k) for k in keys]
    listed = both.select(*key_cols, found.alias("_all"))
    return listed.select(*keys, F.explode_outer("_all").alias("_d")).where(F.col("_d").isNotNull()).select(*keys, "_d.*")


def compare_paired(expected: DataFrame, actual: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """One row per difference, where keys may repeat: keys, record, kind, field, both values.

    Within a key equal records belong together, copy by copy. What is left on
    either side is paired in order of the fields, so as few records differ as can;
    what has no partner is MISSING or EXTRA. ``record`` numbers the pairs of a key.
    A null key is a key. Copies are counted before the shuffle, and ranks come from
    a sort over all keys, so a key with any number of records is spread over tasks.
    """
    cols = [*keys, *fields]
    tagged = expected.select(*cols, F.lit(1).alias("_side")).unionByName(actual.select(*cols, F.lit(-1).alias("_side")))
    left = cut(tagged.groupBy(*cols).agg(F.sum("_side").alias("_more")).where("_more <> 0"))

    def ranked(sign: int, prefix: str) -> DataFrame:
        copies = left.where(F.col("_more") * sign > 0).select(*cols, F.explode(F.sequence(F.lit(1), F.abs("_more").cast("int"))).alias("_copy"))
        rows = number_rows(copies, [*[F.asc_nulls_first(c) for c in cols], F.asc("_copy")], "_rn")
        key = F.struct(*keys)
        first = rows.groupBy(key.alias("_key")).agg(F.min("_rn").alias("_base"))
        placed = rows.withColumn("_key", key).join(first, "_key")
        return placed.select(F.col("_key").alias(f"{prefix}key"), (F.col("_rn") - F.col("_base") + 1).alias(f"{prefix}record"), *[F.col(c).alias(f"{prefix}{c}") for c in fields])

    e, a = ranked(1, "e_"), ranked(-1, "a_")
    both = e.join(a, (F.col("e_key") == F.col("a_key")) & (F.col("e_record") == F.col("a_record")), "full")
    entry = lambda kind, name, x, y: F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("field"), x.cast("string").alias("expected"), y.cast("string").alias("actual"))
    none = F.lit(None).cast("string")
    changed = F.filter(F.array(*[F.when(~F.col(f"e_{c}").eqNullSafe(F.col(f"a_{c}")), entry("FIELD", c, F.col(f"e_{c}"), F.col(f"a_{c}"))) for c in fields]), lambda x: x.isNotNull())
    found = F.when(F.col("a_record").isNull(), F.array(entry("MISSING", "", none, none))).when(F.col("e_record").isNull(), F.array(entry("EXTRA", "", none, none))).otherwise(changed)
    listed = both.select(F.coalesce("e_key", "a_key").alias("_key"), F.coalesce("e_record", "a_record").alias("record"), F.explode(found).alias("_d"))
    return listed.select(*[F.col(f"_key.{k}").alias(k) for k in keys], "record", "_d.*")


def verdict(expected: DataFrame, actual: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """One row: counts and MATCH or MISMATCH. Records of a key that repeats are
    different, or missing or extra if the other side lacks the key."""
    both = pair(expected, actual, keys, fields)
    e, a = F.coalesce("e_n", F.lit(0)), F.coalesce("a_n", F.lit(0))
    equal = reduce(lambda x, y: x & y, [F.col(f"e_{c}").eqNullSafe(F.col(f"a_{c}")) for c in fields], (e == 1) & (a == 1))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    counted = both.agg(
        total(e).alias("expected_records"),
        total(a).alias("actual_records"),
        F.count_if(equal).alias("equal_records"),
        total(F.when((e > 0) & (a > 0) & ~equal, F.greatest(e, a))).alias("different_records"),
        total(F.when(a == 0, e)).alias("missing_records"),
        total(F.when(e == 0, a)).alias("extra_records"),
    )
    bad = F.col("different_records") + F.col("missing_records") + F.col("extra_records")
    return counted.withColumn("verdict", F.when(bad == 0, "MATCH").otherwise("MISMATCH"))


def comparable(df: DataFrame) -> list[str]:
    """Columns a table comparison looks at: not those named as dates or timestamps."""
    return [c for c in df.columns if "TIMESTAMP" not in c.upper() and "DATE" not in c.upper()]


def bag_difference(expected: DataFrame, actual: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows whose number of copies differs, compared as trimmed text.

    Copies are counted before the shuffle, so many equal rows cost one.
    """
    cols = columns or comparable(expected)
    as_text = [F.trim(F.col(c).cast("string")).alias(c) for c in cols]
    tagged = (expected.select(*as_text, F.lit(1).cast("bigint").alias("_e"), F.lit(0).cast("bigint").alias("_a"))
              .unionByName(actual.select(*as_text, F.lit(0).cast("bigint").alias("_e"), F.lit(1).cast("bigint").alias("_a"))))
    counted = tagged.groupBy(*cols).agg(F.sum("_e").alias("expected_copies"), F.sum("_a").alias("actual_copies"))
    return counted.where(F.col("expected_copies") != F.col("actual_copies"))


def normalize(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Regex rules applied in turn before a comparison."""
    return reduce(lambda c, r: F.regexp_replace(c, r[0], r[1]), rules, text)


def normalize_newlines(text: Column) -> Column:
    return F.replace(text, F.lit("\r\n"), F.lit("\n"))


def normalization_log(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Per rule, how many places it would change, as an array."""
    out, seen = [], text
    for pattern, by in rules:
        out.append(F.regexp_count(seen, F.lit(pattern)).cast("bigint"))
        seen = F.regexp_replace(seen, pattern, by)
    return F.array(*out)


def regex_check(text: Column, pattern: str, expected: str, group: int = 1) -> Column:
    """A configured check: the first match's group equals the expected text.

    All-digit values compare as numbers.
    """
    actual = F.trim(F.regexp_extract(text, pattern, group))
    hit = text.rlike(pattern)
    same = actual == expected
    if expected.isdigit():
        same = F.when(actual.rlike("^[0-9]+$"), actual.try_cast("decimal(38,0)") == F.lit(int(expected))).otherwise(same)
    return hit & same


def compare_lines(expected: DataFrame, actual: DataFrame, rules: list[tuple[str, str]] | None = None,
                  at: str = "line", value: str = "value") -> DataFrame:
    """Lines that differ, by line number: byte for byte, or after the rules."""
    clean = lambda d: d.select(at, normalize(F.col(value), rules or []).alias(value))
    return compare(clean(expected), clean(actual), [at], [value])


def digest(content: Column) -> Column:
    """SHA-256 of the bytes, to show a source did not change."""
    return F.sha2(content, 256)


# -- contract ----------------------------------------------------------------
def contract(
    expected: dict[str, DataFrame],
    actual: dict[str, DataFrame],
    modes: set[str],
    keys: dict[str, list[str]],
    exit_codes: tuple[int, int] | None = None,
    exit_parities: dict[int, set[int]] | None = None,
    abnormal: bool = False,
    streams: dict[str, tuple[DataFrame, DataFrame]] | None = None,
) -> DataFrame:
    """Each check's outcome for two runs' named outputs.

    ``modes`` are the checks asked for; a check not asked for is
    NOT_APPLICABLE, one asked for without evidence is UNVERIFIED. File contents
    and counts come from one joined pass per shared output. ``streams`` gives
    the lines (line, value) of stdout and stderr, expected and actual.
    """
    streams = streams or {}
    spark = next(iter((expected or actual).values())).sparkSession
    fixed: dict[str, str] = {c: NOT_APPLICABLE for c in CHECKS}
    if abnormal:
        fixed["exit_code"] = FAIL
    if not abnormal and "exit_code" in modes:
        if exit_codes is None:
            fixed["exit_code"] = UNVERIFIED
        else:
            want, got = exit_codes
            ok = want == got or got in (exit_parities or {}).get(want, set())
            fixed["exit_code"] = PASS if ok else FAIL
    shared = sorted(set(expected) & set(actual)) if not abnormal else []
    if not abnormal and "file_set" in modes:
        fixed["file_set"] = PASS if set(expected) == set(actual) else FAIL
    if not abnormal and "output_presence" in modes:
        fixed["output_presence"] = PASS if actual else FAIL
    measured = {"file_contents", "record_counts", "database_state", "stdout", "stderr"} & modes
    for c in measured:
        fixed[c] = UNVERIFIED
    out = spark.createDataFrame(sorted(fixed.items()), "check string, status string")
    told = [] if abnormal else [
        compare_lines(*streams[c]).agg(F.lit(c).alias("check"), F.when(F.count(F.lit(1)) == 0, PASS).otherwise(FAIL).alias("_status"))
        for c in ("stdout", "stderr") if c in measured and c in streams]
    if not abnormal and shared and measured & {"file_contents", "record_counts", "database_state"}:
        told.append(_file_checks(expected, actual, shared, modes, keys))
    if not told:
        return out
    results = reduce(lambda a, b: a.unionByName(b), told)
    return out.join(F.broadcast(results), "check", "left").select(      # a row per check
        "check", F.coalesce("_status", "status").alias("status"))


def overall(checks: DataFrame) -> DataFrame:
    """One status for a contract: any FAIL fails it, else any UNVERIFIED leaves it open."""
    s = F.col("status")
    return checks.agg(F.when(F.count_if(s == FAIL) > 0, FAIL).when(F.count_if(s == UNVERIFIED) > 0, UNVERIFIED).otherwise(PASS).alias("status"))


def _file_checks(expected: dict, actual: dict, shared: list[str], modes: set[str], keys: dict[str, list[str]]) -> DataFrame:
    parts = []
    for name in shared:
        k = keys[name]
        fields = [c for c in expected[name].columns if c not in k]
        parts.append(verdict(expected[name], actual[name], k, fields))
    joined = reduce(lambda a, b: a.unionByName(b), parts).agg(
        F.bool_and(F.col("verdict") == "MATCH").alias("same"),
        F.bool_and(F.col("expected_records") == F.col("actual_records")).alias("counts"))
    state = lambda c: F.when(c, PASS).otherwise(FAIL)
    rows = {"file_contents": state(F.col("same")), "record_counts": state(F.col("counts")),
            "database_state": state(F.col("same"))}
    return joined.select(F.explode(F.array(*[
        F.struct(F.lit(k).alias("check"), v.alias("_status")) for k, v in rows.items() if k in modes])).alias("_r")).select("_r.*")
