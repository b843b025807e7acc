"""Embedded SQL over customer, orders, nation and supplier."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordloom.operators import embedded_sql as e
from recordloom.plans.registry import query
from recordloom.session import table


def _views(spark, sf_dir, *names):
    for n in names:
        table(spark, sf_dir, n).createOrReplaceTempView(n)


@query("sql_inner_join", """
SELECT c_name, o_orderkey, CAST(o_totalprice AS DECIMAL(15,2)) AS price FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey WHERE c.c_mktsegment = 'BUILDING'""")
def sql_inner_join(spark, sf_dir):
    _views(spark, sf_dir, "customer", "orders")
    return e.query(spark, """
        SELECT c_name, o_orderkey, CAST(o_totalprice AS DECIMAL(15,2)) AS price
        FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey WHERE c.c_mktsegment = :WS-SEGMENT
        WITH UR""", {"WS-SEGMENT": "BUILDING  "})


@query("sql_left_join_indicator", """
SELECT c_custkey, o_orderkey, CASE WHEN o_orderkey IS NULL THEN -1 ELSE 0 END AS order_ind, rpad(coalesce(o_orderpriority, ''), 15, ' ') AS priority_text
FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 400000) ON c_custkey = o_custkey""")
def sql_left_join_indicator(spark, sf_dir):
    _views(spark, sf_dir, "customer", "orders")
    q = e.query(spark, """
        SELECT c_custkey, o_orderkey, o_orderpriority
        FROM customer LEFT OUTER JOIN (SELECT * FROM orders WHERE o_orderstatus = :ST AND o_totalprice > :FLOOR) o ON c_custkey = o_custkey""",
                {"ST": "P", "FLOOR": 400000})
    return q.select("c_custkey", "o_orderkey", e.indicator(F.col("o_orderkey")).alias("order_ind"), e.host_text(F.col("o_orderpriority"), 15).alias("priority_text"))


@query("sql_right_join", """
SELECT s_name, n_name FROM (SELECT * FROM supplier WHERE s_acctbal > 5000) RIGHT JOIN nation ON s_nationkey = n_nationkey""")
def sql_right_join(spark, sf_dir):
    _views(spark, sf_dir, "supplier", "nation")
    return e.query(spark, "SELECT s_name, n_name FROM (SELECT * FROM supplier WHERE s_acctbal > :LOW) s RIGHT JOIN nation ON s_nationkey = n_nationkey", {"LOW": 5000})


@query("sql_group_having", """
SELECT o_custkey, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(15,2))) AS DECIMAL(25,2)) AS total,
       CAST(min(CAST(o_totalprice AS DECIMAL(15,2))) AS DECIMAL(15,2)) AS low, max(o_orderpriority) AS high
FROM orders GROUP BY o_custkey HAVING count(*) > 12""")
def sql_group_having(spark, sf_dir):
    _views(spark, sf_dir, "orders")
    return e.query(spark, """
        SELECT o_custkey, count(*) AS orders, sum(CAST(o_totalprice AS DECIMAL(15,2))) AS total,
               min(CAST(o_totalprice AS DECIMAL(15,2))) AS low, max(o_orderpriority) AS high
        FROM orders GROUP BY o_custkey HAVING count(*) > :MIN-ORDERS ORDER BY o_custkey""", {"MIN-ORDERS": 12})


@query("sql_aggregates", """
SELECT count(*) AS n, count(DISTINCT c_nationkey) AS nations, CAST(sum(CAST(c_acctbal AS DECIMAL(15,2))) AS DECIMAL(25,2)) AS total,
       CAST((CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS BIGINT) // count(*)) AS BIGINT) AS avg_cents FROM customer WHERE c_mktsegment = 'MACHINERY'""")
def sql_aggregates(spark, sf_dir):
    _views(spark, sf_dir, "customer")
    return e.query(spark, """
        SELECT count(*) AS n, count(DISTINCT c_nationkey) AS nations, sum(CAST(c_acctbal AS DECIMAL(15,2))) AS total,
               CAST(avg(CAST(c_acctbal AS DECIMAL(15,2))) * 100 AS BIGINT) AS avg_cents
        FROM customer WHERE c_mktsegment = :SEG""", {"SEG": "MACHINERY"})


@query("sql_in_subquery", """
SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 490000)""")
def sql_in_subquery(spark, sf_dir):
    _views(spark, sf_dir, "customer", "orders")
    return e.query(spark, "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > :AMT)", {"AMT": 490000})


@query("sql_between_in_like_null", """
SELECT o_orderkey FROM orders WHERE (o_totalprice BETWEEN 1000 AND 90000 AND NOT o_orderpriority IN ('1-URGENT', '5-LOW')) OR (o_orderpriority LIKE '2%' AND o_custkey IS NOT NULL)""")
def sql_between_in_like_null(spark, sf_dir):
    _views(spark, sf_dir, "orders")
    return e.query(spark, """
        SELECT o_orderkey FROM orders WHERE (o_totalprice BETWEEN :LO AND :HI AND NOT o_orderpriority IN (:A, '5-LOW'))
           OR (o_orderpriority LIKE '2%' AND o_custkey IS NOT NULL)""", {"LO": 1000, "HI": 90000, "A": "1-URGENT   "})


@query("sql_null_input", "SELECT count(*) AS n FROM orders WHERE o_orderstatus IS NULL")
def sql_null_input(spark, sf_dir):
    """A host variable with a negative indicator is null: nothing equals it."""
    _views(spark, sf_dir, "orders")
    return e.query(spark, "SELECT count(*) AS n FROM orders WHERE o_orderstatus = :ST:ST-IND", {"ST": "F", "ST-IND": -1})


@query("sql_singleton_select", """
WITH o AS (SELECT o_custkey, min(o_orderkey) AS o_orderkey, count(*) AS row_count FROM orders WHERE o_totalprice > 300000 GROUP BY o_custkey)
SELECT c_custkey, o.o_orderkey, coalesce(row_count, 0) AS row_count, CASE WHEN row_count IS NULL THEN 100 ELSE 0 END AS sqlcode FROM customer LEFT JOIN o ON c_custkey = o.o_custkey""")
def sql_singleton_select(spark, sf_dir):
    """SELECT INTO once per customer, first order by key."""
    o = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select("o_custkey", "o_orderkey")
    c = table(spark, sf_dir, "customer").select("c_custkey")
    return e.lookup_first(c, o, "c_custkey", "o_custkey", "o_orderkey").select("c_custkey", "o_orderkey", "row_count", "sqlcode")


@query("sql_cursor_order", """
SELECT s_suppkey, s_name, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS fetch_no FROM supplier WHERE s_nationkey < 20""")
def sql_cursor_order(spark, sf_dir):
    """A cursor's rows with their FETCH number."""
    from recordloom.operators.ordering import number_rows

    _views(spark, sf_dir, "supplier")
    rows = e.query(spark, "SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_nationkey < :TOP FOR UPDATE", {"TOP": 20})
    return number_rows(rows, [F.desc("s_acctbal"), F.asc("s_suppkey")], "fetch_no").select("s_suppkey", "s_name", "fetch_no")


@query("sql_insert_outcomes", """
WITH r AS (SELECT o_orderkey AS seq, o_custkey AS id FROM orders), f AS (SELECT id, min(seq) AS seq FROM r GROUP BY id)
SELECT r.seq, r.id, CASE WHEN f.seq IS NULL OR r.id IN (SELECT CASE WHEN c_custkey % 2 = 0 THEN c_custkey ELSE -1 - c_custkey END FROM customer) THEN -803 ELSE 0 END AS sqlcode FROM r LEFT JOIN f ON r.seq = f.seq""")
def sql_insert_outcomes(spark, sf_dir):
    t = table(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey")).otherwise(-1 - F.col("c_custkey")).alias("id"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("id"))
    return e.inserted(t, rows, ["id"], "seq")[1]


@query("sql_update_delete", """
SELECT s_suppkey, CASE WHEN s_acctbal < 1000 THEN 'LOW' ELSE s_name END AS s_name, CAST(CASE WHEN s_acctbal < 1000 THEN CAST(s_acctbal AS DECIMAL(15,2)) + 500 ELSE CAST(s_acctbal AS DECIMAL(15,2)) END AS DECIMAL(15,2)) AS bal
FROM supplier WHERE NOT coalesce(s_nationkey = 3, FALSE)""")
def sql_update_delete(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", F.col("s_acctbal").cast("decimal(15,2)").alias("bal"))
    u = e.updated(s, F.col("bal") < 1000, {"s_name": F.lit("LOW"), "bal": F.col("bal") + 500})
    return e.deleted(u, F.col("s_nationkey") == 3).select("s_suppkey", "s_name", "bal")


@query("sql_literals_untouched", """
SELECT o_orderkey, 'SOLD WITH UR FOR UPDATE :X' AS text, 'CURRENT TIMESTAMP' AS words FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 50""")
def sql_literals_untouched(spark, sf_dir):
    """Clauses and variables inside literals and comments are only text; a limit behind FOR UPDATE OF holds."""
    _views(spark, sf_dir, "orders")
    return e.query(spark, """SELECT o_orderkey, 'SOLD WITH UR FOR UPDATE :X' AS text, 'CURRENT TIMESTAMP' AS words -- not :BOUND
        FROM orders WHERE o_orderstatus = :ST /* WITH UR */ ORDER BY o_orderkey FOR UPDATE OF o_custkey, o_orderstatus FETCH FIRST 50 ROWS ONLY""", {"ST": "F  "})


@query("sql_indicator_per_use", """
SELECT c_custkey, c_nationkey = 3 AS plain, CAST(NULL AS BOOLEAN) AS with_indicator, c_nationkey < 7 AS other FROM customer""")
def sql_indicator_per_use(spark, sf_dir):
    """One variable with and without its indicator, and names that differ by - and _."""
    _views(spark, sf_dir, "customer")
    return e.query(spark, "SELECT c_custkey, c_nationkey = :WS-N AS plain, c_nationkey = :WS-N:IND AS with_indicator, c_nationkey < :WS_N AS other FROM customer",
                   {"WS-N": 3, "WS_N": 7, "IND": -1})


@query("sql_outcome_codes", """
SELECT r_regionkey, CASE r_regionkey WHEN 0 THEN -204 WHEN 1 THEN -206 WHEN 2 THEN 100 ELSE 0 END AS sqlcode,
       CASE r_regionkey WHEN 0 THEN '42704' WHEN 1 THEN '42703' WHEN 2 THEN '02000' ELSE '00000' END AS sqlstate FROM region""")
def sql_outcome_codes(spark, sf_dir):
    """An unknown table, an unknown column, no row, and a row."""
    _views(spark, sf_dir, "region")
    done = {0: e.select_into(spark, "SELECT X FROM NO_SUCH_TABLE"), 1: e.select_into(spark, "SELECT NO_SUCH INTO :A FROM region"),
            2: e.select_into(spark, "SELECT r_name INTO :A FROM region WHERE r_regionkey < 0"), 3: e.select_into(spark, "SELECT r_name INTO :A FROM region WHERE r_regionkey = 3")}
    pick = lambda what: F.coalesce(*[F.when(F.col("r_regionkey") == k, F.lit(what(o))) for k, o in done.items()], F.lit(what(done[3])))
    return table(spark, sf_dir, "region").select("r_regionkey", pick(lambda o: o.sqlcode).alias("sqlcode"), pick(lambda o: o.sqlstate).alias("sqlstate"))


@query("sql_dialect_forms", """
SELECT o_orderkey, o_custkey, TRUE AS has_time FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""")
def sql_dialect_forms(spark, sf_dir):
    """SYSDUMMY1, CURRENT TIMESTAMP and FETCH FIRST as they are written."""
    _views(spark, sf_dir, "orders")
    one = e.query(spark, "SELECT CURRENT TIMESTAMP AS now_at FROM SYSIBM.SYSDUMMY1")
    top = e.query(spark, "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_totalprice DESC, o_orderkey FETCH FIRST 100 ROWS ONLY")
    return top.select("o_orderkey", "o_custkey", one.scalar().isNotNull().alias("has_time"))


@query("sql_fetch_first_nested", """
SELECT n_nationkey, (SELECT s_suppkey FROM supplier WHERE s_nationkey = n_nationkey ORDER BY s_acctbal DESC, s_suppkey LIMIT 1) IS NOT NULL AS has_supplier, c.c_custkey
FROM nation JOIN (SELECT c_custkey, c_nationkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 40) c ON c.c_nationkey = n_nationkey ORDER BY c.c_custkey LIMIT 30""")
def sql_fetch_first_nested(spark, sf_dir):
    """A FETCH FIRST in a subquery limits that, one behind the statement all of it."""
    _views(spark, sf_dir, "nation", "supplier", "customer")
    return e.query(spark, """
        SELECT n_nationkey, n_nationkey IN (SELECT s_nationkey FROM supplier) AS has_supplier, c.c_custkey
        FROM nation JOIN (SELECT c_custkey, c_nationkey FROM customer ORDER BY c_acctbal DESC, c_custkey FETCH FIRST 40 ROWS ONLY) c ON c.c_nationkey = n_nationkey
        ORDER BY c.c_custkey FETCH FIRST 30 ROWS ONLY WITH UR""")


@query("sql_trailing_comment", """
SELECT o_orderkey, CAST(round(o_totalprice) AS INTEGER) AS whole, '-- no comment' AS note FROM orders WHERE o_custkey > 10 ORDER BY o_orderkey LIMIT 25""")
def sql_trailing_comment(spark, sf_dir):
    """Comments before, between and behind the clauses, a cast with two colons, a semicolon ahead of a comment."""
    _views(spark, sf_dir, "orders")
    return e.query(spark, """-- the first :N orders
        SELECT o_orderkey, /* WITH UR; */ round(o_totalprice)::int AS whole, '-- no comment' AS note
        FROM orders WHERE o_custkey > :LOW ORDER BY o_orderkey FETCH FIRST /* not 5 */ 25 ROWS ONLY; -- FETCH FIRST 5 ROWS ONLY""", {"LOW": 10})
