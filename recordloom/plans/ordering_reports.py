"""Sorts, merges and page reports over orders, customer and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordloom.functions.numeric import num
from recordloom.operators import report as rp
from recordloom.operators import sorting as so
from recordloom.operators.counters import in_order
from recordloom.operators.ordering import scan_by_key
from recordloom.plans.registry import query
from recordloom.session import table


@query("sort_multi_key", """
SELECT o_orderkey, row_number() OVER (ORDER BY o_orderstatus, CAST(o_totalprice AS DECIMAL(15,2)) DESC, o_orderkey) AS position FROM orders""")
def sort_multi_key(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("decimal(15,2)").alias("price"))
    return so.positions([o], [("o_orderstatus", "A"), ("price", "D")], "o_orderkey").select("o_orderkey", "position")


@query("sort_procedures", """
SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(15,2)) * 2 AS DECIMAL(15,2)) AS doubled FROM orders WHERE o_orderstatus <> 'P'""")
def sort_procedures(spark, sf_dir):
    """RELEASE lets some records in; each RETURNed record is changed."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("decimal(15,2)").alias("price"))
    return so.sort_records(
        [o], [("price", "A")], "o_orderkey",
        input_procedure=lambda d: d.where(F.col("o_orderstatus") != "P"),
        output_procedure=lambda d: d.withColumn("doubled", (F.col("price") * 2).cast("decimal(15,2)"))).select("o_orderkey", "doubled")


@query("merge_files", """
WITH u AS (SELECT 0 AS f, o_orderkey AS seq, o_custkey AS k FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 1, o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 2, o_orderkey, o_custkey FROM orders WHERE o_orderstatus NOT IN ('F', 'O') UNION ALL SELECT 3, c_custkey, c_custkey FROM customer)
SELECT seq, k, row_number() OVER (ORDER BY k DESC, f, seq) AS position FROM u""")
def merge_files(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    cols = [F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("k")]
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("seq"), F.col("c_custkey").alias("k"))
    files = [o.where(w).select(*cols) for w in ("o_orderstatus = 'F'", "o_orderstatus = 'O'", "o_orderstatus NOT IN ('F', 'O')")]
    return so.positions([*files, c],
                        [("k", "D")], "seq").select("seq", "k", "position")


@query("utility_sort_fields", """
WITH l AS (SELECT rpad(o_orderpriority, 15, ' ') || o_orderstatus || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS value FROM orders)
SELECT value, row_number() OVER (ORDER BY substr(value, 16, 1) DESC, substr(value, 1, 5), value) AS position FROM l""")
def utility_sort_fields(spark, sf_dir):
    from recordloom.operators.ordering import number_rows

    lines = table(spark, sf_dir, "orders").select(F.concat(
        F.rpad("o_orderpriority", 15, " "), "o_orderstatus", F.lpad(F.col("o_orderkey").cast("string"), 10, "0")).alias("value"))
    keys = so.field_keys(so.fields_card(" SORT FIELDS=(16,1,CH,D,1,5,CH,A)"))
    return number_rows(lines, keys, "position")


@query("utility_sort_card", """
WITH l AS (SELECT rpad(o_orderpriority, 15, ' ') || o_orderstatus || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS value FROM orders)
SELECT value, row_number() OVER (ORDER BY substr(value, 16, 1) DESC, substr(value, 1, 5), value) AS mixed_parts,
       row_number() OVER (ORDER BY substr(value, 16, 1), substr(value, 1, 5) DESC, value) AS one_format FROM l""")
def utility_sort_card(spark, sf_dir):
    """Keys of four and of three parts, and three parts under one FORMAT."""
    from recordloom.operators.ordering import number_rows

    lines = table(spark, sf_dir, "orders").select(F.concat(
        F.rpad("o_orderpriority", 15, " "), "o_orderstatus", F.lpad(F.col("o_orderkey").cast("string"), 10, "0")).alias("value"))
    once = number_rows(lines, so.field_keys(so.fields_card(" SORT FIELDS=(16,1,CH,D,1,5,A)")), "mixed_parts")
    return number_rows(once, so.field_keys(so.fields_card(" SORT FIELDS=(16,1,A,1,5,D),FORMAT=CH")), "one_format")


@query("running_balance", """
SELECT event_id, user_id, CAST(coalesce(sum(CAST(value AS DECIMAL(9,2))) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DECIMAL(25,2)) AS before,
       last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_purchase FROM events""")
def running_balance(spark, sf_dir):
    """A total kept per key while reading on, and the latest purchase before each event."""
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("value").cast("decimal(9,2)").alias("amount"))
    out = scan_by_key(ev, ["user_id"], "event_id", last={"last_purchase": F.when(F.col("event_type") == "purchase", F.col("event_id"))},
                      sums={"_before": F.col("amount")})
    return out.select("event_id", "user_id", F.coalesce("_before", F.lit(0)).cast("decimal(25,2)").alias("before"), "last_purchase")


SALES = rp.Report(
    heading=rp.Group((rp.Item(1, "X(20)", value="ORDERS BY DATE"), rp.Item(30, "X(4)", value="PAGE"), rp.Item(35, "ZZZZZ9", source=rp.PAGE_COUNTER))),
    detail=rp.Group((rp.Item(5, "X(12)", source="key_text"), rp.Item(20, "ZZZ,ZZ9.99", source="price"))),
    footing=rp.Group((rp.Item(1, "X(10)", value="TOTAL SO"), rp.Item(12, "ZZZ,ZZZ,ZZZ,ZZ9.99", sum="price")), plus=2),
    source_pics={"price": "9(9)V99", "key_text": "X(12)"},
)


@query("report_pages", """
WITH o AS (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(11,2)) AS price, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS k, count(*) OVER () AS n,
                  sum(CAST(o_totalprice AS DECIMAL(11,2))) OVER (ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS total FROM orders),
p AS (SELECT *, (k - 1) // 4 + 1 AS page, (k - 1) % 4 AS spot, ((k - 1) // 4) * 7 AS base FROM o)
SELECT page, base + 1 AS line, rpad('ORDERS BY DATE', 29, ' ') || 'PAGE ' || lpad(CAST(page AS VARCHAR), 6, ' ') AS text FROM p WHERE spot = 0
UNION ALL SELECT page, base + spot + 2, '    ' || rpad(CAST(o_orderkey AS VARCHAR), 12, ' ') || '   ' || lpad(format('{:,.2f}', CAST(price AS DOUBLE)), 10, ' ') FROM p
UNION ALL SELECT page, base + spot + 3, '' FROM p WHERE spot = 3 OR k = n
UNION ALL SELECT page, base + spot + 4, 'TOTAL SO   ' || lpad(format('{:,.2f}', CAST(total AS DOUBLE)), 18, ' ') FROM p WHERE spot = 3 OR k = n""")
def report_pages(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderdate", F.col("o_orderkey").cast("string").alias("key_text"), F.col("o_totalprice").cast("decimal(11,2)").alias("price"))
    return rp.generate(o, SALES, [F.asc("o_orderdate"), F.asc("o_orderkey")])


@query("report_sum_page", """
SELECT (k - 1) // 5 + 1 AS page, CAST(sum(price) AS DECIMAL(25,2)) AS page_total, count(*) AS details FROM (
  SELECT CAST(o_totalprice AS DECIMAL(11,2)) AS price, row_number() OVER (ORDER BY o_orderkey) AS k FROM orders) GROUP BY 1""")
def report_sum_page(spark, sf_dir):
    from recordloom.operators.ordering import number_rows

    plain = rp.Report(detail=rp.Group((rp.Item(1, "X(12)", source="o_orderkey"),)))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(15,2)").alias("price"))
    n = number_rows(o, [F.asc("o_orderkey")], "k").withColumn("page", (F.floor((F.col("k") - 1) / plain.details_per_page) + 1).cast("bigint"))
    return n.groupBy("page").agg(F.sum("price").alias("page_total"), F.count(F.lit(1)).alias("details"))


@query("report_totals", """
SELECT CAST(sum(CAST(o_totalprice AS DECIMAL(11,2))) AS DECIMAL(21,2)) AS sum_price, count(*) AS details FROM orders""")
def report_totals(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_totalprice").cast("decimal(11,2)").alias("price"))
    return rp.total(o, {"price": "9(9)V99"})


@query("counters_signed_overflow", """
WITH x AS (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(9,2)) * CASE o_orderstatus WHEN 'F' THEN -1 WHEN 'O' THEN 1 ELSE 2 END AS x FROM orders),
w AS (SELECT list_reduce(list_prepend(CAST(0 AS BIGINT), list(CAST(x * 100 AS BIGINT) ORDER BY o_orderkey)), lambda s, x: (s + x) % 100000000) AS s,
      list_reduce(list_prepend(CAST(0 AS BIGINT), list(CAST(x * 100 AS BIGINT) ORDER BY o_orderkey)), lambda s, x: (abs(s + x) - abs(s + x) % 10) % 10000000) AS u FROM x)
SELECT CAST(s / 100 AS DECIMAL(8,2)) AS balance, CAST(u / 100 AS DECIMAL(6,1)) AS turned FROM w""")
def counters_signed_overflow(spark, sf_dir):
    """Two counters over all orders in turn: a signed one that overflows either way, and an unsigned one that drops a digit and turns at zero."""
    x, price = _signed_prices(spark, sf_dir)
    return in_order(x, [], "o_orderkey", {"balance": (price, "S9(6)V99"), "turned": (price, "9(5)V9")})


@query("counters_by_customer", """
WITH x AS (SELECT o_orderkey, o_custkey, CAST(o_totalprice AS DECIMAL(9,2)) * CASE o_orderstatus WHEN 'F' THEN -1 WHEN 'O' THEN 1 ELSE 2 END AS x FROM orders)
SELECT o_custkey, CAST(list_reduce(list_prepend(CAST(0 AS BIGINT), list(CAST(x * 100 AS BIGINT) ORDER BY o_orderkey)), lambda s, x: (s + x) % 10000000) / 100 AS DECIMAL(7,2)) AS balance FROM x GROUP BY o_custkey""")
def counters_by_customer(spark, sf_dir):
    x, price = _signed_prices(spark, sf_dir)
    return in_order(x, ["o_custkey"], "o_orderkey", {"balance": (price, "S9(5)V99")})


def _signed_prices(spark, sf_dir):
    sign = F.when(F.col("o_orderstatus") == "F", -1).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    x = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.col("o_totalprice").cast("decimal(9,2)") * sign).cast("decimal(10,2)").alias("x"))
    return x, num("x", "S9(8)V99")
