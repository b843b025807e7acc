"""Secrets in text, by an incremental ledger of blobs.

Every version of a text is a blob, named by its SHA-256. The ledger remembers
which (blob, rule, version of the rule) were scanned and what was found. A scan
takes only pairs that are not in the ledger, each blob once however many paths
hold it, adds findings and then pairs to the ledger, and joins the findings of
all blobs back to every path. A new rule or a new version of one is scanned on
all blobs; nothing else is scanned again.

Null texts are read as empty; empty texts have no findings. Rows that repeat a
path are each returned. Null paths come back like others. Very long texts are
scanned whole, as one blob. An empty table gives an empty table and leaves the
ledger as it is. Other columns may have any names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from recordloom.llm.common import documents, stored
from recordloom.session import scratch_path


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds, leftmost first and without overlap; ``least`` characters
    of group ``group`` decide whether a match stays. ``hint``, if given, is text
    that every match contains."""

    kind: str
    pattern: str
    version: int = 1
    group: int = 0
    least: int = 1
    hint: tuple[str, ...] = ()


BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=12, hint=(":", "=")),
    Rule("access", r"AKIA[A-Z0-9]+", least=18, hint=("AKIA",)),
    Rule("hex", r"[0-9a-f]+", least=16),
)
#: Further kinds; their spans are added, those of BASE stay as they are.
MORE = (
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", hint=("gh",)),
    Rule("bearer", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", hint=("eyJ",)),
    Rule("key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", hint=("-----BEGIN ",)),
)
RULES = BASE + MORE
SPAN = "array<struct<start:int,rank:int,kind:string,end:int>>"
MASK = "[secret]"


def spans_of(text: Column, rule: Rule, rank: int) -> Column:
    """Spans of the matches of one rule, in code points, end exclusive.

    The pieces between matches and the matches themselves alternate, so a
    running sum of their lengths gives the places.
    """
    may = F.lit(True)
    if rule.hint:
        may = F.lit(False)
        for h in rule.hint:
            may = may | text.contains(h)
    quick = rule.pattern if rule.group else rule.pattern.removesuffix("+") + f"{{{max(rule.least - 4, 1)},}}" if rule.pattern.endswith("+") else rule.pattern
    may = may & text.rlike(quick)
    between = F.transform(F.split(text, rule.pattern, -1), lambda x: F.length(x))
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    sizes = F.zip_with(F.transform(whole, lambda x: F.length(x)), F.transform(part, lambda x: F.length(x)), lambda n, k: F.struct(n.alias("n"), k.alias("k")))
    steps = F.filter(F.zip_with(between, sizes, lambda gap, m: F.struct(gap.alias("gap"), m["n"].alias("n"), m["k"].alias("k"))), lambda s: s["n"].isNotNull())
    empty = F.array().cast(SPAN)
    walked = F.aggregate(
        steps, F.struct(F.lit(0).alias("at"), empty.alias("found")),
        lambda acc, s: F.struct(
            (acc["at"] + s["gap"] + s["n"]).alias("at"),
            F.when(s["k"] >= rule.least, F.concat(acc["found"], F.array(F.struct(
                (acc["at"] + s["gap"]).alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), (acc["at"] + s["gap"] + s["n"]).alias("end")))))
            .otherwise(acc["found"]).alias("found")),
        lambda acc: acc["found"])
    return F.when(may, walked).otherwise(empty)


def blob(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


class Ledger:
    """Scanned pairs and findings, as Parquet under ``path`` on shared storage."""

    PAIRS = "blob string, kind string, version int"
    FOUND = f"blob string, kind string, version int, spans {SPAN}"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        none = [F.lit(None).cast(t).alias(c) for c, t in (("blob", "string"), ("kind", "string"), ("version", "int"), ("spans", SPAN))]
        for name, columns in (("pairs", none[:3]), ("found", none)):
            spark.range(0).select(*columns).write.mode("append").parquet(f"{self.path}/{name}")

    def pairs(self) -> DataFrame:
        return self.spark.read.schema(self.PAIRS).parquet(f"{self.path}/pairs")

    def found(self) -> DataFrame:
        """Findings of scanned pairs; one of a blob that was written twice, as a
        scan that broke off before it wrote its pairs is done again."""
        return self.spark.read.schema(self.FOUND).parquet(f"{self.path}/found").dropDuplicates(["blob", "kind", "version"])

    def unseen(self, docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """(blob, path, kinds): each blob with pairs to scan, and one path that holds it."""
        named = docs.select(blob(F.col("text")).alias("blob"), F.col("path").alias("path"))
        blobs = stored(named.groupBy("blob").agg(F.min("path").alias("path")), "blobs")
        asked = F.explode(F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules]))
        fresh = blobs.select("blob", "path", asked.alias("r")).select("blob", "path", "r.kind", "r.version")
        fresh = fresh.join(self.pairs().distinct(), ["blob", "kind", "version"], "left_anti")
        return fresh.groupBy("blob").agg(F.first("path").alias("path"), F.collect_set("kind").alias("kinds"))

    def scan(self, docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> int:
        """Scans what is unseen in ``docs`` (path, text); gives the number of pairs."""
        todo = stored(self.unseen(docs, rules), "unseen")
        # A path can stand for the wrong text where paths repeat, hence both keys.
        texts = docs.select(F.col("path").alias("_p"), F.coalesce("text", F.lit("")).alias("text"), blob(F.col("text")).alias("_b"))
        joined = texts.join(todo, (F.col("_b") == F.col("blob")) & F.col("_p").eqNullSafe(F.col("path"))).select("blob", "kinds", "text")
        per_rule = F.array(*[
            F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"),
                     F.when(F.array_contains("kinds", r.kind), spans_of(F.col("text"), r, k)).otherwise(F.array().cast(SPAN)).alias("spans"))
            for k, r in enumerate(rules)])
        found = joined.select("blob", F.explode(per_rule).alias("f")).select("blob", "f.kind", "f.version", "f.spans").where(F.size("spans") > 0)
        found.write.mode("append").parquet(f"{self.path}/found")
        versions = F.create_map(*[F.lit(v) for r in rules for v in (r.kind, r.version)])
        pairs = todo.select("blob", F.explode("kinds").alias("kind")).withColumn("version", F.element_at(versions, F.col("kind")))
        pairs = stored(pairs, "scanned")
        pairs.write.mode("append").parquet(f"{self.path}/pairs")
        return pairs.count()

    def findings(self, docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """(path, blob, spans) for each row of ``docs``: its spans of all rules, by start and rule."""
        known = F.concat_ws(":", "kind", "version").isin([f"{r.kind}:{r.version}" for r in rules])
        per_blob = stored(self.found().where(known)
                          .groupBy(F.col("blob").alias("_blob")).agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans")), "found")
        named = stored(docs.select("path", blob(F.col("text")).alias("blob")), "paths")
        return named.join(per_blob, named["blob"] == per_blob["_blob"], "left").select("path", "blob", F.coalesce("spans", F.array().cast(SPAN)).alias("spans"))


def scanned(docs: DataFrame, rules: tuple[Rule, ...] = RULES, ledger_path: str | None = None) -> DataFrame:
    """Findings of ``docs`` (path, text) with a ledger at ``ledger_path``, or a new one."""
    spark = docs.sparkSession
    ledger = Ledger(spark, ledger_path or scratch_path(spark, "ledger"))
    ledger.scan(docs, rules)
    return ledger.findings(docs, rules)


def masked(text: Column, spans: Column) -> Column:
    """The text with each span, overlapping ones as one, replaced by MASK."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    piece = lambda a, b: text.substr(a + 1, F.greatest(b - a, F.lit(0)))
    done = F.aggregate(
        spans, start,
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] >= acc["at"], F.concat(acc["out"], piece(acc["at"], s["start"]), F.lit(MASK))).otherwise(acc["out"]).alias("out")),
        lambda acc: acc)
    return F.concat(done["out"], piece(done["at"], F.length(text)))


def without_secrets(docs: DataFrame) -> DataFrame:
    """The documents with their secrets masked, and n_chars to match where it is a column."""
    found = scanned(docs.select(F.col("doc_id").alias("path"), "text")).where(F.size("spans") > 0)
    found = stored(found.select("blob", "spans").dropDuplicates(["blob"]), "masks")
    joined = docs.select(F.struct(*docs.columns).alias("d"), blob(F.col("text")).alias("_b")).join(found, F.col("_b") == F.col("blob"), "left")
    hit = F.col("spans").isNotNull()
    own = lambda c: F.col("d").getField(c)
    text = F.when(hit, masked(own("text"), F.col("spans"))).otherwise(own("text"))
    joined = joined.select("d", hit.alias("hit"), text.alias("new"))
    return joined.select(*[
        F.col("new").alias(c) if c == "text"
        else F.when(F.col("hit"), F.length("new").cast(docs.schema[c].dataType)).otherwise(own(c)).alias(c) if c == "n_chars"
        else own(c).alias(c) for c in docs.columns])


def _listed(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scanned(documents(spark, sf_dir).select(F.col("doc_id").alias("path"), "text"))
    kinds = [r.kind for r in BASE]
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    base = F.filter("spans", lambda s: s["kind"].isin(kinds))
    return found.select(
        F.col("path").alias("doc_id"), *[count(k).alias(f"n_{k}") for k in kinds],
        F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


_RULE_SQL = """
  SELECT doc_id, {rank} AS r, '{kind}' AS k, s, s + n AS e FROM (
    SELECT doc_id, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'n': len(m[i]), 'g': len(g[i]),
           's': CAST(list_sum(list_transform(p[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0) AS BIGINT)}}), recursive := true)
    FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {group}) AS g,
                 string_split_regex(t, '{pattern}') AS p FROM texts)) WHERE g >= {least}"""


def _sql() -> str:
    # DuckDB's (?i) also folds letters that are not ASCII, hence classes.
    pattern = {r.kind: r.pattern.replace("'", "''") for r in RULES}
    fold = lambda w: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
    names = "|".join(fold(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    pattern["assign"] = f"({names})" + pattern["assign"].partition("))")[2]
    parts = [_RULE_SQL.format(rank=k, kind=r.kind, pattern=pattern[r.kind], group=r.group, least=r.least) for k, r in enumerate(RULES)]
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({' UNION ALL '.join(parts)}),
per AS (
  SELECT doc_id, count(*) FILTER (k = 'assign') AS n_assign, count(*) FILTER (k = 'access') AS n_access, count(*) FILTER (k = 'hex') AS n_hex,
         string_agg(k || ':' || s || ':' || e, ',' ORDER BY s, r) FILTER (r < {len(BASE)}) AS base,
         string_agg(k || ':' || s || ':' || e, ',' ORDER BY s, r) AS spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN per USING (doc_id)"""


OP6_SQL = _sql()
