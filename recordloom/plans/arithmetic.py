"""Storage arithmetic over lineitem, orders and customer."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordloom.functions import numeric as n
from recordloom.functions.codecs import decode_binary, decode_packed, decode_zoned, encode_binary, encode_packed, encode_zoned
from recordloom.functions.edited import edit
from recordloom.functions.numeric import Num, divide, divide_into, divide_remainder, num, round_to, store
from recordloom.operators.counters import accumulate
from recordloom.plans.registry import query
from recordloom.session import table


def lines(spark, sf_dir):
    """Line items with exact amounts; quantity, price, discount and tax."""
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.col("l_quantity").cast("decimal(5,0)").alias("qty"), F.col("l_extendedprice").cast("decimal(9,2)").alias("price"),
        F.col("l_discount").cast("decimal(3,2)").alias("disc"), F.col("l_tax").cast("decimal(3,2)").alias("tax"))


ID = "l_orderkey, l_linenumber, l_partkey"
_L = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS DECIMAL(5,0)) AS qty,
 CAST(l_extendedprice AS DECIMAL(9,2)) AS price, CAST(l_discount AS DECIMAL(3,2)) AS disc, CAST(l_tax AS DECIMAL(3,2)) AS tax FROM lineitem"""
KEYS = ["l_orderkey", "l_linenumber", "l_partkey"]


def amounts() -> tuple[Num, Num, Num, Num]:
    """Quantity, price, discount, tax of a line."""
    return num("qty", "9(5)"), num("price", "9(7)V99"), num("disc", "9V99"), num("tax", "9V99")


@query("compute_expression", f"""
WITH l AS ({_L}), v AS (SELECT *, CAST(qty * 3 + 7 AS DECIMAL(8,0)) AS a, CAST(CAST(1 + tax AS DECIMAL(4,2)) * CAST(1 - disc AS DECIMAL(4,2)) AS DECIMAL(8,4)) AS f FROM l)
SELECT {ID}, CAST(trunc(CAST(price AS DECIMAL(20,2)) * f, 2) AS DECIMAL(11,2)) AS charge,
       CAST(a * a - qty AS DECIMAL(10,0)) AS squared FROM v""")
def compute_expression(spark, sf_dir):
    qty, price, disc, tax = amounts()
    charge = store(price * (1 + tax) * (1 - disc), "9(9)V99")
    squared = store((qty * 3 + 7) ** 2 - qty, "9(10)")
    return lines(spark, sf_dir).select(*KEYS, charge.value.alias("charge"), squared.value.alias("squared"))


@query("rounded_vs_truncated", f"""
SELECT {ID}, CAST(trunc(price * disc, 2) AS DECIMAL(9,2)) AS truncated, CAST(round(price * disc, 2) AS DECIMAL(9,2)) AS rounded
FROM ({_L})""")
def rounded_vs_truncated(spark, sf_dir):
    _, price, disc, _ = amounts()
    off = price * disc
    return lines(spark, sf_dir).select(
        *KEYS, store(off, "9(7)V99").value.alias("truncated"),
        store(off, "9(7)V99", rounding=n.NEAREST_AWAY).value.alias("rounded"))


_MODES = {"truncation": n.TRUNCATION, "nearest_away": n.NEAREST_AWAY, "nearest_even": n.NEAREST_EVEN,
          "nearest_toward": n.NEAREST_TOWARD, "greater": n.TOWARD_GREATER, "lesser": n.TOWARD_LESSER, "away": n.AWAY}


@query("rounding_modes", f"""
WITH u AS (SELECT {ID}, CAST(price * 100 AS BIGINT) * (CAST(disc * 100 AS BIGINT) - 5) AS u FROM ({_L})),
q AS (SELECT *, u // 100 AS t, abs(u % 100) AS r, CASE WHEN u < 0 THEN -1 ELSE 1 END AS s FROM u)
SELECT {ID},
  CAST(t * 0.01 AS DECIMAL(9,2)) AS truncation,
  CAST((t + s * CASE WHEN r >= 50 THEN 1 ELSE 0 END) * 0.01 AS DECIMAL(9,2)) AS nearest_away,
  CAST((t + s * CASE WHEN r > 50 OR (r = 50 AND t % 2 <> 0) THEN 1 ELSE 0 END) * 0.01 AS DECIMAL(9,2)) AS nearest_even,
  CAST((t + s * CASE WHEN r > 50 THEN 1 ELSE 0 END) * 0.01 AS DECIMAL(9,2)) AS nearest_toward,
  CAST((t + CASE WHEN r > 0 AND s > 0 THEN 1 ELSE 0 END) * 0.01 AS DECIMAL(9,2)) AS greater,
  CAST((t - CASE WHEN r > 0 AND s < 0 THEN 1 ELSE 0 END) * 0.01 AS DECIMAL(9,2)) AS lesser,
  CAST((t + s * CASE WHEN r > 0 THEN 1 ELSE 0 END) * 0.01 AS DECIMAL(9,2)) AS away
FROM q""")
def rounding_modes(spark, sf_dir):
    _, price, disc, _ = amounts()
    signed = price * (disc - "0.05")
    return lines(spark, sf_dir).select(*KEYS, *[store(signed, "S9(7)V99", rounding=m).value.alias(k) for k, m in _MODES.items()])


@query("unsigned_overflow_store", """
SELECT c_custkey, CAST(abs(CAST(c_acctbal AS DECIMAL(15,2))) % 1000 AS DECIMAL(5,2)) AS stored,
       CAST(CAST(c_acctbal AS DECIMAL(15,2)) % 1000 AS DECIMAL(5,2)) AS signed_stored FROM customer""")
def unsigned_overflow_store(spark, sf_dir):
    bal = num(F.col("c_acctbal"), "S9(13)V99")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", store(bal, "9(3)V99").value.alias("stored"), store(bal, "S9(3)V99").value.alias("signed_stored"))


@query("size_error_branch", f"""
WITH v AS (SELECT *, CAST(qty * price AS DECIMAL(18,2)) AS total FROM ({_L}))
SELECT {ID}, CAST(CASE WHEN total >= 1000000 THEN -1 ELSE total END AS DECIMAL(8,2)) AS total,
       CASE WHEN total >= 1000000 THEN 'OVERFLOW' ELSE 'STORED' END AS branch,
       CAST(CASE WHEN disc = 0 THEN -1 ELSE CAST(price * 100 AS BIGINT) // CAST(disc * 100 AS BIGINT) END AS DECIMAL(8,0)) AS ratio,
       (disc = 0) AS zero_divisor
FROM v""")
def size_error_branch(spark, sf_dir):
    qty, price, disc, _ = amounts()
    old = F.lit(-1).cast("decimal(8,2)")
    s = store(qty * price, "S9(6)V99", old=old, on_size_error=True)
    r = divide_into(price, disc, "S9(8)", old=F.lit(-1), on_size_error=True)
    return lines(spark, sf_dir).select(
        *KEYS, s.value.alias("total"), F.when(s.size_error, "OVERFLOW").otherwise("STORED").alias("branch"),
        r.value.alias("ratio"), r.size_error.alias("zero_divisor"))


@query("divide_remainder", f"""
SELECT {ID}, CAST(CAST(price * 100 AS BIGINT) // (CAST(qty AS BIGINT) * 100) AS DECIMAL(9,0)) AS quotient,
       CAST((CAST(price * 100 AS BIGINT) % (CAST(qty AS BIGINT) * 100)) * 0.01 AS DECIMAL(9,2)) AS remainder
FROM ({_L})""")
def divide_remainder_query(spark, sf_dir):
    qty, price, _, _ = amounts()
    q, r = divide_remainder(price, qty, "9(9)", "9(7)V99")
    return lines(spark, sf_dir).select(*KEYS, q.value.alias("quotient"), r.value.alias("remainder"))


@query("divide_exact", f"""
WITH i AS (SELECT {ID}, CAST(price * 100 AS BIGINT) AS a, CAST(qty AS BIGINT) AS b FROM ({_L}))
SELECT {ID}, CAST((a // b) * 0.01 AS DECIMAL(9,2)) AS truncated,
       CAST((a // b + CASE WHEN 2 * (a % b) >= b THEN 1 ELSE 0 END) * 0.01 AS DECIMAL(9,2)) AS rounded,
       CAST(a * 1000000 // b AS DECIMAL(18,0)) AS fine
FROM i""")
def divide_exact(spark, sf_dir):
    qty, price, _, _ = amounts()
    fine = divide(price, qty, 8)
    return lines(spark, sf_dir).select(
        *KEYS, divide_into(price, qty, "9(7)V99").value.alias("truncated"),
        divide_into(price, qty, "9(7)V99", rounding=n.NEAREST_AWAY).value.alias("rounded"),
        (fine.col * n.pow10(8)).cast("decimal(18,0)").alias("fine"))


@query("power_and_unary", f"""
WITH i AS (SELECT {ID}, CAST(qty AS BIGINT) AS q FROM ({_L}))
SELECT {ID}, CAST(q * q * q AS DECIMAL(15,0)) AS cubed, CAST(-q + 1 AS DECIMAL(5,0)) AS negated,
       CAST((10000000000 // (q * q)) * 0.0000000001 AS DECIMAL(11,10)) AS inverse_square FROM i""")
def power_and_unary(spark, sf_dir):
    qty, _, _, _ = amounts()
    return lines(spark, sf_dir).select(
        *KEYS, store(qty ** 3, "9(15)").value.alias("cubed"), store(-qty + 1, "S9(5)").value.alias("negated"),
        store(qty ** -2, "9V9(10)").value.alias("inverse_square"))


@query("add_several_receivers", f"""
WITH v AS (SELECT {ID}, price, qty, CAST(price + disc AS DECIMAL(10,2)) AS a, CAST(qty + disc AS DECIMAL(10,2)) AS b FROM ({_L}))
SELECT {ID}, CAST(trunc(a % 100000, 1) AS DECIMAL(6,1)) AS short, CAST(a AS DECIMAL(9,2)) AS long, CAST(trunc(b, 0) AS DECIMAL(5,0)) AS whole FROM v""")
def add_several_receivers(spark, sf_dir):
    qty, price, disc, _ = amounts()
    sums = n.add_to({"long": (price, "9(7)V99"), "whole": (qty, "9(5)")}, disc)
    short = store(price + disc, "9(5)V9").value
    return lines(spark, sf_dir).select(*KEYS, short.alias("short"), *[c.alias(k) for k, c in sums.items()])


@query("numval_mod", """
WITH v AS (SELECT c_custkey, CAST(c_acctbal AS DECIMAL(15,2)) AS b, CAST(c_nationkey - 12 AS BIGINT) AS d, CAST(trunc(CAST(c_acctbal AS DECIMAL(15,2)), 0) AS BIGINT) AS w FROM customer)
SELECT c_custkey, CAST(b AS DECIMAL(18,2)) AS value,
       CAST(CASE WHEN d = 0 THEN NULL ELSE ((w % d) + d) % d END AS DECIMAL(5,0)) AS mod_value,
       CAST(CASE WHEN d = 0 THEN NULL ELSE w % d END AS DECIMAL(5,0)) AS rem_value
FROM v""")
def numval_mod(spark, sf_dir):
    bal = F.col("c_acctbal").cast("decimal(15,2)")
    text = F.concat(F.lit(" $"), F.format_number(F.abs(bal), 2), F.when(bal < 0, "CR ").otherwise("  "))
    whole = round_to(num(bal, "S9(13)V99"), 0)
    d = num((F.col("c_nationkey") - 12).cast("decimal(5,0)"), "S9(5)")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", n.numval(text, 18, 2).col.alias("value"), n.function_mod(whole, d).col.alias("mod_value"),
        n.function_rem(whole, d).col.alias("rem_value"))


@query("parse_int_safe", """
SELECT event_id, CAST(CASE WHEN k < 30 THEN 0 ELSE k END AS INTEGER) AS k FROM (
  SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events)""")
def parse_int_safe(spark, sf_dir):
    k = F.regexp_extract("props", "([0-9]+)", 1)
    messy = F.when(k.cast("int") < 15, "  ").when(k.cast("int") < 30, F.concat(k, F.lit("x"))).otherwise(F.concat(F.lit(" "), k, F.lit(" ")))
    return table(spark, sf_dir, "events").select("event_id", n.parse_int(messy).alias("k"))


# -- stored forms ------------------------------------------------------------
@query("zoned_roundtrip", """
WITH v AS (SELECT c_custkey, CAST(c_acctbal AS DECIMAL(9,2)) AS b, lpad(CAST(abs(CAST(CAST(c_acctbal AS DECIMAL(9,2)) * 100 AS BIGINT)) AS VARCHAR), 9, '0') AS d FROM customer)
SELECT c_custkey, CASE WHEN b < 0 THEN substr(d, 1, 8) || translate(substr(d, 9, 1), '0123456789', 'pqrstuvwxy') ELSE d END AS trailing_text,
       CASE WHEN b < 0 THEN translate(substr(d, 1, 1), '0123456789', 'pqrstuvwxy') || substr(d, 2) ELSE d END AS leading_text,
       CASE WHEN b < 0 THEN d || '-' ELSE d || '+' END AS separate_text, b AS trailing, b AS leading, b AS separate FROM v""")
def zoned_roundtrip(spark, sf_dir):
    p, b = "S9(7)V99", F.col("b")
    v = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").cast("decimal(9,2)").alias("b"))
    e = v.select("c_custkey", encode_zoned(b, p).alias("trailing_text"), encode_zoned(b, p, leading=True).alias("leading_text"),
                 encode_zoned(b, p, separate=True).alias("separate_text"))
    return e.select("*", decode_zoned(F.col("trailing_text"), p).alias("trailing"),
                    decode_zoned(F.col("leading_text"), p, leading=True).alias("leading"),
                    decode_zoned(F.col("separate_text"), p, separate=True).alias("separate"))


@query("packed_roundtrip", f"""
WITH v AS (SELECT {ID}, CAST(price AS DECIMAL(11,2)) AS p, CAST(disc - 0.05 AS DECIMAL(4,2)) AS d FROM ({_L}))
SELECT {ID}, lpad(CAST(CAST(p * 100 AS BIGINT) AS VARCHAR), 11, '0') || 'F' AS unsigned_hex, p AS unsigned_value,
       lpad(CAST(abs(CAST(d * 100 AS BIGINT)) AS VARCHAR), 5, '0') || CASE WHEN d < 0 THEN 'D' ELSE 'C' END AS signed_hex, d AS signed_value FROM v""")
def packed_roundtrip(spark, sf_dir):
    v = lines(spark, sf_dir).select(*KEYS, encode_packed(F.col("price"), "9(9)V99").alias("u"),
                                    encode_packed((F.col("disc") - F.lit(0.05).cast("decimal(2,2)")).cast("decimal(4,2)"), "S99V99").alias("s"))
    return v.select(*KEYS, F.hex("u").alias("unsigned_hex"), decode_packed(F.col("u"), "9(9)V99").alias("unsigned_value"),
                    F.hex("s").alias("signed_hex"), decode_packed(F.col("s"), "S99V99").alias("signed_value"))


@query("binary_roundtrip", """
SELECT c_custkey, CAST(c_acctbal AS DECIMAL(9,2)) AS four, CAST(c_acctbal AS DECIMAL(15,2)) AS eight, CAST(c_nationkey - 12 AS DECIMAL(4,0)) AS two FROM customer""")
def binary_roundtrip(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    b = F.col("c_acctbal")
    e = c.select("c_custkey", encode_binary(b.cast("decimal(9,2)"), "S9(7)V99").alias("f"),
                 encode_binary(b.cast("decimal(15,2)"), "S9(13)V99").alias("e"),
                 encode_binary((F.col("c_nationkey") - 12).cast("decimal(4,0)"), "S9(4)").alias("t"))
    return e.select("c_custkey", decode_binary(F.col("f"), "S9(7)V99").alias("four"),
                    decode_binary(F.col("e"), "S9(13)V99").alias("eight"), decode_binary(F.col("t"), "S9(4)").alias("two"))


@query("numeric_display", """
WITH v AS (SELECT c_custkey, CAST(c_acctbal AS DECIMAL(9,2)) AS b, lpad(CAST(abs(CAST(CAST(c_acctbal AS DECIMAL(9,2)) * 100 AS BIGINT)) AS VARCHAR), 9, '0') AS d FROM customer)
SELECT c_custkey, CASE WHEN b < 0 THEN '-' ELSE '+' END || substr(d, 1, 7) || '.' || substr(d, 8) AS signed_text,
       substr(d, 1, 7) || '.' || substr(d, 8) || CASE WHEN b < 0 THEN '-' ELSE '+' END AS trailing_text,
       lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS comp5_text,
       'KEY ' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') || substr(d, 1, 7) || '.' || substr(d, 8) AS line FROM v""")
def numeric_display(spark, sf_dir):
    b, k = F.col("c_acctbal").cast("decimal(9,2)"), F.col("c_custkey").cast("decimal(9,0)")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", n.display_text(b, "S9(7)V99").alias("signed_text"), n.display_text(b, "S9(7)V99", separate="TRAILING").alias("trailing_text"),
        n.display_text(k, "9(9)", usage="COMP-5").alias("comp5_text"),
        F.concat(F.lit("KEY "), n.display_text(k, "9(9)"), n.display_text(F.abs(b), "9(7)V99")).alias("line"))


@query("edited_pictures", """
WITH v AS (SELECT c_custkey, CAST(c_acctbal AS DECIMAL(9,2)) AS b, CAST(abs(CAST(c_acctbal AS DECIMAL(9,2))) AS DOUBLE) AS a FROM customer),
t AS (SELECT *, format('{:,.2f}', a) AS c FROM v)
SELECT c_custkey, lpad('$' || c, 10, ' ') AS dollar, lpad(CASE WHEN b < 0 THEN '-' ELSE '+' END || c, 11, ' ') AS plus,
       lpad(CASE WHEN b < 0 THEN '-' ELSE ' ' END || c, 10, ' ') AS minus, lpad(c, 9, ' ') AS plain, lpad(c, 9, '*') AS stars,
       lpad(c, 9, ' ') || CASE WHEN b < 0 THEN 'CR' ELSE '  ' END AS credit, lpad(c, 9, ' ') || CASE WHEN b < 0 THEN 'DB' ELSE '  ' END AS debit,
       lpad(format('{:d}', CAST(round(a) AS BIGINT)), 5, ' ') || CASE WHEN b < 0 AND round(a) <> -1 THEN '-' ELSE ' ' END AS trailing_minus
FROM t""")
def edited_pictures(spark, sf_dir):
    b = num(F.col("c_acctbal"), "S9(7)V99")
    pics = {"dollar": "$$$,$$9.99", "plus": "++++,++9.99", "minus": "----,--9.99"[1:], "plain": "ZZ,ZZ9.99", "stars": "**,**9.99",
            "credit": "ZZ,ZZ9.99CR", "debit": "ZZ,ZZ9.99DB", "trailing_minus": "ZZZZ9-"}
    return table(spark, sf_dir, "customer").select("c_custkey", *[edit(b, p).alias(k) for k, p in pics.items()])


@query("running_counters", f"""
SELECT count(*) AS records, count(*) FILTER (disc > 0) AS discounted, CAST(sum(CAST(qty AS BIGINT)) % 100000 AS DECIMAL(5,0)) AS qty_total,
       CAST(sum(price) AS DECIMAL(15,2)) AS price_total, sum(CAST(qty AS BIGINT)) >= 100000 AS qty_wrapped
FROM ({_L})""")
def running_counters(spark, sf_dir):
    """Counters of a read loop; the quantity counter is too short and wraps."""
    qty, price, _, _ = amounts()
    qty, wrapped = accumulate(qty, "9(5)", "qty_total")
    price, _ = accumulate(price, "9(13)V99", "price_total")
    return lines(spark, sf_dir).agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("disc") > 0).alias("discounted"),
                                    qty, price, wrapped.alias("qty_wrapped"))


@query("perform_varying", """
WITH RECURSIVE y(p_partkey, n, balance) AS (
  SELECT p_partkey, 0, CAST(p_retailprice AS DECIMAL(9,2)) FROM part
  UNION ALL
  SELECT p_partkey, n + 1, CAST(balance + trunc(balance * 0.07, 2) AS DECIMAL(9,2)) FROM y WHERE n < 5)
SELECT p_partkey, balance AS after_five FROM y WHERE n = 5""")
def perform_varying(spark, sf_dir):
    """PERFORM 5 TIMES: interest truncated to cents on every turn."""
    b = num(F.col("p_retailprice"), "9(7)V99")
    for _ in range(5):
        b = num(store(b + num(store(b * "0.07", "9(7)V99").value, "9(7)V99"), "9(7)V99").value, "9(7)V99")
    return table(spark, sf_dir, "part").select("p_partkey", b.col.alias("after_five"))


@query("perform_until", """
WITH RECURSIVE y(p_partkey, balance, turns) AS (
  SELECT p_partkey, CAST(p_size AS BIGINT), 0 FROM part
  UNION ALL
  SELECT p_partkey, balance * 2 + 1, turns + 1 FROM y WHERE balance < 1000000000 * (p_partkey % 5))
SELECT p_partkey, max(turns) AS turns, max(balance) AS balance FROM y GROUP BY p_partkey""")
def perform_until(spark, sf_dir):
    """PERFORM UNTIL a limit of the record's own, however many turns that takes."""
    from recordloom.operators.loops import perform_until as until

    start = F.struct(F.col("p_size").cast("bigint").alias("balance"), F.lit(0).alias("turns"))
    done = until(table(spark, sf_dir, "part").select("p_partkey", "p_size"), start, lambda a: a["balance"] >= 1000000000 * (F.col("p_partkey") % 5),
                 lambda a: F.struct((a["balance"] * 2 + 1).alias("balance"), (a["turns"] + 1).alias("turns")))
    return done.select("p_partkey", "state.turns", "state.balance")


@query("perform_times", """
WITH RECURSIVE y(p_partkey, n, m, balance) AS (
  SELECT p_partkey, 0, p_size % 4, CAST(p_retailprice AS DECIMAL(9,2)) FROM part
  UNION ALL
  SELECT p_partkey, n + 1, m, CAST(balance + trunc(balance * 0.07, 2) AS DECIMAL(9,2)) FROM y WHERE n < m)
SELECT p_partkey, balance FROM y WHERE n = m""")
def perform_times(spark, sf_dir):
    """PERFORM n TIMES, n from the record."""
    from recordloom.operators.loops import perform_times as times

    def turn(state):
        b = num(state["b"], "9(7)V99")
        return F.struct(store(b + num(store(b * "0.07", "9(7)V99").value, "9(7)V99"), "9(7)V99").value.alias("b"))

    state = times(F.col("p_size") % 4, F.struct(F.col("p_retailprice").cast("decimal(9,2)").alias("b")), turn)
    return table(spark, sf_dir, "part").select("p_partkey", state["b"].alias("balance"))


@query("compute_wide_division", """
WITH o AS (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS HUGEINT) AS cents, CAST(o_custkey + 1 AS HUGEINT) AS d FROM orders),
q AS (SELECT o_orderkey, cents * 10000 // d AS six, (cents * 100000000) // (d * 3) AS eight FROM o)
SELECT o_orderkey, CAST(CAST(six // 1000000 AS VARCHAR) || '.' || lpad(CAST(six % 1000000 AS VARCHAR), 6, '0') AS DECIMAL(16,6)) AS of_28_digits,
       CAST(CAST(eight // 10000000000 AS VARCHAR) || '.' || lpad(CAST(eight % 10000000000 // 10000 AS VARCHAR), 6, '0') AS DECIMAL(16,6)) AS of_30_digits FROM q""")
def compute_wide_division(spark, sf_dir):
    """A division inside an expression keeps its fraction however wide the operands are."""
    a, b = num(F.col("o_totalprice").cast("decimal(28,12)"), "9(16)V9(12)"), num((F.col("o_custkey") + 1).cast("decimal(9,0)"), "9(9)")
    wide = num(F.col("o_totalprice").cast("decimal(30,12)"), "9(18)V9(12)")
    return table(spark, sf_dir, "orders").select("o_orderkey", store(a / b, "9(10)V9(6)").value.alias("of_28_digits"),
                                                 store(wide / (b * 3), "9(10)V9(6)").value.alias("of_30_digits"))


@query("numval_fractions", """
WITH l AS (SELECT l_orderkey, l_linenumber, substr('129987', 1, CAST(l_linenumber % 7 AS INTEGER)) AS f FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST(CAST(l_orderkey AS VARCHAR) || '.' || rpad(substr(f, 1, 2), 2, '0') AS DECIMAL(11,2)) AS cut,
       CAST(CAST(l_orderkey AS VARCHAR) || '.' || rpad(f, 6, '0') AS DECIMAL(15,6)) AS whole FROM l""")
def numval_fractions(spark, sf_dir):
    """NUMVAL keeps what the text has; the receiver cuts."""
    text = F.concat(F.lit(" "), F.col("l_orderkey").cast("string"), F.lit("."), F.substring(F.lit("129987"), F.lit(1), (F.col("l_linenumber") % 7).cast("int")), F.lit(" "))
    v = n.numval(text)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", store(v, "9(9)V99").value.alias("cut"), store(v, "9(9)V9(6)").value.alias("whole"))


@query("zoned_damaged", """
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 1234 WHEN 4 THEN 0 WHEN 5 THEN 42 END::DECIMAL(4,0) AS plain, CASE o_orderkey % 6 WHEN 0 THEN 1234 WHEN 4 THEN 0 WHEN 5 THEN 42 END::DECIMAL(4,0) AS signed FROM orders""")
def zoned_damaged(spark, sf_dir):
    """Text that is no number is null, not some number."""
    from recordloom.functions.codecs import decode_zoned

    text = F.element_at(F.array(*[F.lit(t) for t in ("1234", "12A4", "1.5 ", "-123", "    ", "0042")]), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", decode_zoned(text, "9(4)").alias("plain"), decode_zoned(text, "S9(4)").alias("signed"))


@query("encode_truncates", """
WITH v AS (SELECT p_partkey, CAST(round(p_retailprice * 100) AS BIGINT) * 10 + 9 AS mills FROM part)
SELECT p_partkey, lpad(CAST(mills // 10 % 1000 AS VARCHAR), 3, '0') || lpad(CAST(mills // 1000 % 100 AS VARCHAR), 2, '0') AS line FROM v""")
def encode_truncates(spark, sf_dir):
    """What does not fit a record's item loses fraction digits, then high-order digits."""
    from recordloom.layout import copybook

    layout = copybook("01 R. 05 A PIC 9V99. 05 B PIC 99.")
    v = F.col("p_retailprice").cast("decimal(12,3)") + F.lit("0.009").cast("decimal(4,3)")
    rows = table(spark, sf_dir, "part").select("p_partkey", v.alias("a"), v.alias("b"))
    return rows.select("p_partkey", layout.record().alias("line"))


@query("text_order_padded", """
WITH t AS (SELECT o_orderkey, o_orderpriority AS a, o_orderpriority || CASE o_orderkey % 3 WHEN 0 THEN chr(9) WHEN 1 THEN '  ' ELSE 'a' END AS b FROM orders),
p AS (SELECT o_orderkey, rpad(a, CAST(greatest(length(a), length(b)) AS INTEGER), ' ') AS a, b FROM t)
SELECT o_orderkey, a < b AS below, a <= b AS not_above FROM p""")
def text_order_padded(spark, sf_dir):
    """Order of texts of two lengths, as if the shorter were filled with blanks."""
    from recordloom.functions.conditions import text_le, text_lt

    k = F.col("o_orderkey") % 3
    a = F.col("o_orderpriority")
    b = F.concat(a, F.when(k == 0, "\t").when(k == 1, "  ").otherwise("a"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text_lt(a, b).alias("below"), text_le(a, b).alias("not_above"))


@query("perform_varying_after", """
SELECT p_partkey, CAST(sum(p_size * i + j) AS BIGINT) AS total FROM part, range(1, 4) a(i), range(1, 3) b(j) GROUP BY p_partkey""")
def perform_varying_after(spark, sf_dir):
    """Nested counted loops over one record."""
    from recordloom.functions.tables import varying

    size, zero = F.col("p_size").cast("bigint"), F.lit(0).cast("bigint")
    total = varying(3, zero, lambda a, i: varying(2, a, lambda b, j: b + size * i + j))
    return table(spark, sf_dir, "part").select("p_partkey", total.alias("total"))


@query("time_forms", """
SELECT event_id, strftime(ts, '%Y%m%d') AS date_text, strftime(ts, '%H%M%S') AS time_text, CAST(ts AS DATE) AS date_value FROM events""")
def time_forms(spark, sf_dir):
    from recordloom.functions.times import format_date, format_time, record_date

    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    e = table(spark, sf_dir, "events").select("event_id", ms.alias("millis"))
    return e.select("event_id", format_date(F.col("millis")).alias("date_text"), format_time(F.col("millis")).alias("time_text"),
                    record_date(format_date(F.col("millis"))).alias("date_value"))
