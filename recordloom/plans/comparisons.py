"""Reconciliation of orders, customer and documents with altered copies."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordloom.operators import reconcile as rc
from recordloom.plans.registry import query
from recordloom.session import table


def _sides(spark, sf_dir):
    e = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("decimal(15,2)").alias("price"), "o_orderpriority")
    a = e.select(
        F.when(F.col("o_orderkey") % 97 == 0, -F.col("o_orderkey") - 1).otherwise(F.col("o_orderkey")).alias("o_orderkey"), "o_orderstatus",
        F.when(F.col("o_orderkey") % 13 == 0, F.col("price") + 1).otherwise(F.col("price")).cast("decimal(15,2)").alias("price"),
        F.when(F.col("o_orderkey") % 17 != 0, F.col("o_orderpriority")).alias("o_orderpriority"))
    return e, a


_SIDES = """
WITH e AS (SELECT o_orderkey, o_orderstatus, CAST(o_totalprice AS DECIMAL(15,2)) AS price, o_orderpriority FROM orders),
a AS (SELECT CASE WHEN o_orderkey % 97 = 0 THEN -o_orderkey - 1 ELSE o_orderkey END AS o_orderkey, o_orderstatus,
        CAST(CASE WHEN o_orderkey % 13 = 0 THEN price + 1 ELSE price END AS DECIMAL(15,2)) AS price, CASE WHEN o_orderkey % 17 <> 0 THEN o_orderpriority END AS o_orderpriority
      FROM e)"""
FIELDS = ["o_orderstatus", "price", "o_orderpriority"]


@query("reconcile_diff", _SIDES + """
SELECT e.o_orderkey, 'MISSING' AS kind, '' AS field, NULL::VARCHAR AS expected, NULL::VARCHAR AS actual FROM e WHERE o_orderkey NOT IN (SELECT o_orderkey FROM a)
UNION ALL SELECT a.o_orderkey, 'EXTRA', '', NULL, NULL FROM a WHERE o_orderkey NOT IN (SELECT o_orderkey FROM e)
UNION ALL SELECT o_orderkey, 'FIELD', 'price', CAST(e.price AS VARCHAR), CAST(a.price AS VARCHAR) FROM e JOIN a USING (o_orderkey) WHERE e.price IS DISTINCT FROM a.price
UNION ALL SELECT o_orderkey, 'FIELD', 'o_orderpriority', e.o_orderpriority, a.o_orderpriority FROM e JOIN a USING (o_orderkey) WHERE e.o_orderpriority IS DISTINCT FROM a.o_orderpriority
UNION ALL SELECT o_orderkey, 'FIELD', 'o_orderstatus', e.o_orderstatus, a.o_orderstatus FROM e JOIN a USING (o_orderkey) WHERE e.o_orderstatus IS DISTINCT FROM a.o_orderstatus""")
def reconcile_diff(spark, sf_dir):
    return rc.compare(*_sides(spark, sf_dir), ["o_orderkey"], FIELDS)


@query("reconcile_repeated", """
WITH e AS (SELECT o_custkey AS k, count(*) AS n, min(o_orderstatus) AS s FROM orders WHERE o_orderkey % 11 <> 0 GROUP BY 1),
a AS (SELECT CASE WHEN o_custkey % 5 <> 0 THEN o_custkey END AS k, count(*) AS n, min(o_orderstatus) AS s FROM orders GROUP BY 1)
SELECT coalesce(e.k, a.k) AS k, CASE WHEN coalesce(e.n, 0) > 1 OR coalesce(a.n, 0) > 1 THEN 'REPEATED' WHEN a.n IS NULL THEN 'MISSING' WHEN e.n IS NULL THEN 'EXTRA' ELSE 'FIELD' END AS kind,
       CASE WHEN e.n = 1 AND a.n = 1 THEN 's' ELSE '' END AS field, CASE WHEN coalesce(e.n, 0) > 1 OR coalesce(a.n, 0) > 1 THEN CAST(coalesce(e.n, 0) AS VARCHAR) WHEN e.n = 1 AND a.n = 1 THEN e.s END AS expected,
       CASE WHEN coalesce(e.n, 0) > 1 OR coalesce(a.n, 0) > 1 THEN CAST(coalesce(a.n, 0) AS VARCHAR) WHEN e.n = 1 AND a.n = 1 THEN a.s END AS actual
FROM e FULL JOIN a ON e.k IS NOT DISTINCT FROM a.k WHERE NOT (coalesce(e.n, 0) = 1 AND coalesce(a.n, 0) = 1 AND e.s = a.s)""")
def reconcile_repeated(spark, sf_dir):
    """Keys that repeat or are null are reported by key, not paired all with all."""
    o = table(spark, sf_dir, "orders")
    e = o.where("o_orderkey % 11 <> 0").select(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("s"))
    a = o.select(F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey")).alias("k"), F.col("o_orderstatus").alias("s"))
    return rc.compare(e, a, ["k"], ["s"])


@query("reconcile_paired", """
WITH e AS (SELECT CASE WHEN o_custkey % 7 <> 0 THEN o_custkey END AS k, o_orderstatus AS s, o_orderpriority AS p FROM orders),
a AS (SELECT CASE WHEN o_custkey % 7 <> 0 THEN o_custkey END AS k, o_orderstatus AS s, CASE WHEN o_orderkey % 13 = 0 THEN '9-NONE' WHEN o_orderkey % 17 <> 0 THEN o_orderpriority END AS p FROM orders WHERE o_orderkey % 29 <> 0),
l AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY s NULLS FIRST, p NULLS FIRST) AS r FROM (SELECT * FROM e EXCEPT ALL SELECT * FROM a)),
m AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY s NULLS FIRST, p NULLS FIRST) AS r FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM e)),
b AS (SELECT coalesce(l.k, m.k) AS k, coalesce(l.r, m.r) AS record, l.r AS e_in, m.r AS a_in, l.s AS e_s, m.s AS a_s, l.p AS e_p, m.p AS a_p FROM l FULL JOIN m ON l.k IS NOT DISTINCT FROM m.k AND l.r = m.r)
SELECT k, record, 'MISSING' AS kind, '' AS field, NULL::VARCHAR AS expected, NULL::VARCHAR AS actual FROM b WHERE a_in IS NULL
UNION ALL SELECT k, record, 'EXTRA', '', NULL, NULL FROM b WHERE e_in IS NULL
UNION ALL SELECT k, record, 'FIELD', 's', e_s, a_s FROM b WHERE e_in = a_in AND e_s IS DISTINCT FROM a_s
UNION ALL SELECT k, record, 'FIELD', 'p', e_p, a_p FROM b WHERE e_in = a_in AND e_p IS DISTINCT FROM a_p""")
def reconcile_paired(spark, sf_dir):
    """Records of keys that repeat, one null key with a seventh of all: equal ones belong together, the rest by rank."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey")).alias("k"), F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p"))
    changed = F.when(F.col("o_orderkey") % 13 == 0, "9-NONE").when(F.col("o_orderkey") % 17 != 0, F.col("p"))
    return rc.compare_paired(o.select("k", "s", "p"), o.where("o_orderkey % 29 <> 0").select("k", "s", changed.alias("p")), ["k"], ["s", "p"])


@query("reconcile_verdict", _SIDES + """
SELECT count(*) FILTER (e.o_orderkey IS NOT NULL) AS expected_records, count(*) FILTER (a.o_orderkey IS NOT NULL) AS actual_records,
  count(*) FILTER (e.o_orderkey = a.o_orderkey AND e.price IS NOT DISTINCT FROM a.price AND e.o_orderpriority IS NOT DISTINCT FROM a.o_orderpriority AND e.o_orderstatus IS NOT DISTINCT FROM a.o_orderstatus) AS equal_records,
  count(*) FILTER (e.o_orderkey = a.o_orderkey AND NOT (e.price IS NOT DISTINCT FROM a.price AND e.o_orderpriority IS NOT DISTINCT FROM a.o_orderpriority AND e.o_orderstatus IS NOT DISTINCT FROM a.o_orderstatus)) AS different_records,
  count(*) FILTER (a.o_orderkey IS NULL) AS missing_records, count(*) FILTER (e.o_orderkey IS NULL) AS extra_records, 'MISMATCH' AS verdict
FROM e FULL JOIN a ON e.o_orderkey = a.o_orderkey""")
def reconcile_verdict(spark, sf_dir):
    return rc.verdict(*_sides(spark, sf_dir), ["o_orderkey"], FIELDS)


@query("bag_difference", """
WITH e AS (SELECT CAST(user_id AS VARCHAR) AS user_id, event_type, count(*) AS n FROM events GROUP BY ALL),
a AS (SELECT CAST(user_id AS VARCHAR) AS user_id, CASE WHEN event_id % 50 = 0 THEN 'view' ELSE event_type END AS event_type, count(*) AS n FROM events GROUP BY ALL)
SELECT coalesce(e.user_id, a.user_id) AS user_id, coalesce(e.event_type, a.event_type) AS event_type, coalesce(e.n, 0) AS expected_copies, coalesce(a.n, 0) AS actual_copies
FROM e FULL JOIN a ON e.user_id = a.user_id AND e.event_type = a.event_type WHERE coalesce(e.n, 0) <> coalesce(a.n, 0)""")
def bag_difference(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    other = F.when(F.col("event_id") % 50 == 0, "view").otherwise(F.col("event_type")).alias("event_type")
    return rc.bag_difference(ev.select("user_id", "event_type"), ev.select("user_id", other))


@query("equivalence_contract", """
SELECT * FROM (VALUES ('output_presence', 'PASS'), ('file_set', 'FAIL'), ('file_contents', 'FAIL'), ('stdout', 'PASS'), ('stderr', 'UNVERIFIED'),
  ('exit_code', 'PASS'), ('database_state', 'NOT_APPLICABLE'), ('record_counts', 'PASS')) AS t("check", status)
UNION ALL SELECT 'overall', 'FAIL'""")
def equivalence_contract(spark, sf_dir):
    e, a = _sides(spark, sf_dir)
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    printed = c.select(F.col("c_custkey").alias("line"), F.col("c_name").alias("value"))
    checks = rc.contract({"orders": e, "customer": c, "lost": c}, {"orders": a, "customer": c},
                         {"output_presence", "file_set", "file_contents", "record_counts", "stdout", "stderr", "exit_code"},
                         {"orders": ["o_orderkey"], "customer": ["c_custkey"]}, exit_codes=(0, 4), exit_parities={0: {4}},
                         streams={"stdout": (printed, printed)})
    return checks.unionByName(rc.overall(checks).select(F.lit("overall").alias("check"), "status"))


RULES = [(r"[0-9]{4,}", "<n>"), (r"[ \t]+", " ")]


@query("normalized_text", r"""
WITH s AS (SELECT doc_id, text, regexp_replace(text, '[0-9]{4,}', '<n>', 'g') AS one FROM documents)
SELECT doc_id, regexp_replace(one, '[ \t]+', ' ', 'g') AS clean, CAST(len(regexp_extract_all(text, '[0-9]{4,}')) AS BIGINT) AS numbers, CAST(len(regexp_extract_all(one, '[ \t]+')) AS BIGINT) AS blanks FROM s""")
def normalized_text(spark, sf_dir):
    log = rc.normalization_log(F.col("text"), RULES)
    return table(spark, sf_dir, "documents").select("doc_id", rc.normalize(F.col("text"), RULES).alias("clean"), log[0].alias("numbers"), log[1].alias("blanks"))


@query("configured_checks", r"""
SELECT event_id, regexp_matches(props, '"k": ([0-9]+)') AND CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS INTEGER) = 42 AS ok FROM events""")
def configured_checks(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", rc.regex_check(F.col("props"), r'"k": ([0-9]+)', "042").alias("ok"))


@query("content_digest", "SELECT doc_id, sha256(text) AS digest FROM documents")
def content_digest(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", rc.digest(F.encode("text", "UTF-8")).alias("digest"))


@query("line_comparison", """
SELECT -1 - o_orderkey AS line, 'EXTRA' AS kind, '' AS field, NULL AS expected, NULL AS actual FROM orders WHERE o_orderkey % 50 = 0
UNION ALL SELECT o_orderkey AS line, CASE WHEN o_orderkey % 50 = 0 THEN 'MISSING' ELSE 'FIELD' END AS kind, CASE WHEN o_orderkey % 50 = 0 THEN '' ELSE 'value' END AS field,
       CASE WHEN o_orderkey % 50 <> 0 THEN o_orderpriority || ' <n>' END AS expected, CASE WHEN o_orderkey % 50 <> 0 THEN 'changed <n>' END AS actual
FROM orders WHERE o_orderkey % 50 = 0 OR o_orderkey % 9 = 0""")
def line_comparison(spark, sf_dir):
    """Lines with other line ends and other numbers are the same; others are told."""
    o, n = table(spark, sf_dir, "orders"), F.lpad(F.col("o_custkey").cast("string"), 8, "0")
    e = o.select(F.col("o_orderkey").alias("line"), F.concat("o_orderpriority", F.lit(" "), n, F.lit("\r\n")).alias("value"))
    line = F.when(F.col("o_orderkey") % 50 == 0, -1 - F.col("o_orderkey")).otherwise(F.col("o_orderkey"))
    a = o.select(line.alias("line"), F.concat(
        F.when(F.col("o_orderkey") % 9 == 0, "changed").otherwise(F.col("o_orderpriority")), F.lit(" 12345678\n")).alias("value"))
    return rc.compare_lines(e, a, [("[0-9]{8}", "<n>"), ("\r?\n$", "")])
