"""Whole batch programs as single plans: bills, sales, accounts, credit draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from recordloom.functions.conditions import evaluate, text_eq
from recordloom.functions.numeric import num, store
from recordloom.functions.text import string_into
from recordloom.layout import copybook
from recordloom.operators.keyed import OK, read_key
from recordloom.operators.moves import call
from recordloom.plans.registry import query
from recordloom.session import table

BILL = copybook("""
    01  BILL.
        05  BILL-NUMBER   PIC 9(9).
        05  BILLED-ON.
            10  ON-YEAR   PIC 9(4).
            10  ON-MONTH  PIC 99.
            10  ON-DAY    PIC 99.
        05  PAYER         PIC 9(7).
        05  NET           PIC 9(7)V99.
""")
BILL_OUT = copybook("""
    01  BILL-OUT.
        05  BILL-NUMBER   PIC 9(9).
        05  PAYER         PIC 9(7).
        05  NET           PIC 9(7)V99.
        05  VAT           PIC 9(7)V99.
        05  GROSS         PIC 9(8)V99.
        05  SIZE-CLASS    PIC X(6).
""")
CREDIT = copybook("""
    01  CREDIT-LINE.
        05  LINE-HOLDER   PIC 9(9).
        05  LINE-STATE    PIC X.
            88  LINE-OPEN   VALUE 'O'.
        05  LINE-PURPOSE  PIC X(3).
        05  LINE-CEILING  PIC S9(11)V99 COMP-3.
        05  LINE-MARGIN   PIC S9(9)V99 COMP-3.
""")
VAT_RATE = "0.19"
SECOND_LOOK = 150_000        # grants above it are looked at again


# -- bills -------------------------------------------------------------------
def bill_amounts(bills: DataFrame) -> DataFrame:
    """VAT cut to cents, the gross amount, and a class by the net amount."""
    net = num("net", "9(7)V99")
    vat = num(store(net * VAT_RATE, "9(7)V99").value, "9(7)V99")
    return bills.select(
        "bill_number", "payer", net.col.alias("net"), vat.col.alias("vat"), store(net + vat, "9(8)V99").value.alias("gross"),
        F.when(net >= 2500, "LARGE").when(net >= 500, "MEDIUM").otherwise("SMALL").alias("size_class"))


def bills(spark, sf_dir: str) -> DataFrame:
    """A bill an order, over a hundredth of its price."""
    o = table(spark, sf_dir, "orders")
    day = lambda f: f(F.col("o_orderdate"))
    return o.select(
        F.col("o_orderkey").cast("decimal(9,0)").alias("bill_number"),
        F.struct(day(F.year).cast("decimal(4,0)").alias("on_year"), day(F.month).cast("decimal(2,0)").alias("on_month"), day(F.day).cast("decimal(2,0)").alias("on_day")).alias("billed_on"),
        F.col("o_custkey").cast("decimal(7,0)").alias("payer"),
        (F.col("o_totalprice").cast("decimal(9,2)") / F.lit(100)).cast("decimal(9,2)").alias("net"))


_BILLS = """
WITH c AS (SELECT o_orderkey, o_custkey, (CAST(round(o_totalprice * 100) AS BIGINT) + 50) // 100 AS cents FROM orders),
b AS (SELECT *, cents * 19 // 100 AS vat, CASE WHEN cents >= 250000 THEN 'LARGE' WHEN cents >= 50000 THEN 'MEDIUM' ELSE 'SMALL' END AS size_class FROM c)"""


@query("invoice_tax_status", _BILLS + """
SELECT CAST(o_orderkey AS DECIMAL(9,0)) AS bill_number, CAST(o_custkey AS DECIMAL(7,0)) AS payer, CAST(cents * 0.01 AS DECIMAL(9,2)) AS net,
       CAST(vat * 0.01 AS DECIMAL(9,2)) AS vat, CAST((cents + vat) * 0.01 AS DECIMAL(10,2)) AS gross, size_class FROM b""")
def invoice_tax_status(spark, sf_dir):
    return bill_amounts(bills(spark, sf_dir))


@query("invoice_record_lines", _BILLS + """
SELECT lpad(CAST(o_orderkey AS VARCHAR), 9, '0') || lpad(CAST(o_custkey AS VARCHAR), 7, '0') || lpad(CAST(cents AS VARCHAR), 9, '0')
       || lpad(CAST(vat AS VARCHAR), 9, '0') || lpad(CAST(cents + vat AS VARCHAR), 10, '0') || size_class AS line FROM b""")
def invoice_record_lines(spark, sf_dir):
    """Fixed-width line in, fixed-width line out."""
    out = bill_amounts(BILL.decode(BILL.encode(bills(spark, sf_dir))))
    return BILL_OUT.encode(out).select(F.rtrim("value").alias("line"))


# -- freight -----------------------------------------------------------------
def freight_calc(qty: Column, price: Column, tax: Column, charge: Column, band: Column) -> dict[str, Column]:
    """The called subprogram: what a line's carriage costs, with cover for its value, and how it goes."""
    value = store(num(qty, "9(5)") * "1.35" + num(price, "9(7)V99") * num(tax, "9V99") * "0.25", "9(7)V99", charge).value
    return {"charge": value, "band": evaluate([(qty > 40, "PALLET"), (value > 400, "COVERED"), (qty == 1, "LETTER")], F.lit("PARCEL"))}


@query("tier_evaluate", """
WITH s AS (
  SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DECIMAL(5,0)) AS qty, CAST(l_extendedprice AS DECIMAL(9,2)) AS price, CAST(l_tax AS DECIMAL(3,2)) AS tax FROM lineitem),
t AS (SELECT *, CAST(trunc(CAST(qty * 1.35 AS DECIMAL(15,6)) + CAST(price * tax AS DECIMAL(13,4)) * 0.25, 2) AS DECIMAL(9,2)) AS charge FROM s)
SELECT l_orderkey, l_linenumber, charge, CASE WHEN qty > 40 THEN 'PALLET' WHEN charge > 400 THEN 'COVERED' WHEN qty = 1 THEN 'LETTER' ELSE 'PARCEL' END AS band
FROM t""")
def tier_evaluate(spark, sf_dir):
    """Lines in bands of carriage, by EVALUATE in a called program."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").cast("decimal(5,0)").alias("qty"), F.col("l_extendedprice").cast("decimal(9,2)").alias("price"),
        F.col("l_tax").cast("decimal(3,2)").alias("tax"), F.lit(None).cast("decimal(9,2)").alias("charge"), F.lit(None).cast("string").alias("band"))
    called = call(li, freight_calc, {"qty": "qty", "price": "price", "tax": "tax", "charge": "charge", "band": "band"})
    return called.select("l_orderkey", "l_linenumber", "charge", "band")


# -- deposits ----------------------------------------------------------------
@query("account_balance", """
WITH a AS (
  SELECT c_custkey, CAST(abs(c_acctbal) AS DECIMAL(12,2)) AS deposit, o_orderkey, o_orderpriority LIKE '1%' AS urgent,
         CAST(trunc(CAST(o_totalprice AS DECIMAL(12,2)) * CASE WHEN o_orderpriority LIKE '1%' THEN 0.012 ELSE 0.003 END, 2) AS DECIMAL(12,2)) AS held
  FROM orders JOIN customer ON o_custkey = c_custkey),
b AS (SELECT *, CAST(CASE WHEN urgent THEN deposit - held ELSE deposit + held END AS DECIMAL(12,2)) AS closing FROM a)
SELECT o_orderkey, lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS deposit_no, closing,
       CASE WHEN closing < 0 THEN 'SHORT' WHEN closing < 500 THEN 'THIN' ELSE 'FULL' END AS cover FROM b""")
def account_balance(spark, sf_dir):
    """A deposit after a rush order's guarantee is held from it, or an ordinary order's is given back."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.abs(F.col("c_acctbal")).cast("decimal(12,2)").alias("deposit"))
    price = num(F.col("o_totalprice"), "9(10)V99")
    urgent = F.col("o_orderpriority").startswith("1")
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", urgent.alias("urgent"),
        F.when(urgent, store(price * "0.012", "9(10)V99").value).otherwise(store(price * "0.003", "9(10)V99").value).alias("held"))
    a = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    deposit, held = num("deposit", "9(10)V99"), num("held", "9(10)V99")
    closing = F.when(F.col("urgent"), store(deposit - held, "S9(10)V99").value).otherwise(store(deposit + held, "S9(10)V99").value)
    out = a.select("o_orderkey", F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("deposit_no"), closing.alias("closing"))
    return out.withColumn("cover", evaluate([(F.col("closing") < 0, "SHORT"), (F.col("closing") < 500, "THIN")], F.lit("FULL")))


# -- draws on credit lines ----------------------------------------------------
#: Why a draw is turned down: code and wording, in the order in which they are looked for.
REFUSALS = {"NOLINE": "holder has no credit line", "CLOSED": "line takes no draws now", "PURPOSE": "line is for another purpose"}


def grant(draws: DataFrame, lines: DataFrame) -> DataFrame:
    """Each draw against its holder's line: what is granted, why not, and a journal entry.

    A draw is cut by the margin that the holder bears and then fitted under the
    line's ceiling.
    """
    met = read_key(draws, lines, "holder", "line_holder")
    faults = {"NOLINE": F.col("status") != OK, "CLOSED": ~CREDIT.condition("LINE-OPEN"), "PURPOSE": ~text_eq(F.col("purpose"), F.col("line_purpose"))}
    first = F.coalesce(*[F.when(faults[code], code) for code in REFUSALS])
    after_margin = store(num("asked", "9(10)V99") - num("line_margin", "S9(9)V99"), "S9(11)V99").value
    nothing = F.lit(0).cast("decimal(13,2)")
    sized = met.withColumn("refusal", first).withColumn(
        "granted", F.when(F.col("refusal").isNull(), F.least(F.greatest(after_margin, nothing), F.col("line_ceiling").cast("decimal(13,2)"))))
    outcome = evaluate([(F.col("refusal").isNotNull(), "REFUSED"), (F.col("granted") == 0, "EMPTY"), (F.col("granted") > SECOND_LOOK, "HELD")], F.lit("PAID"))
    wording = F.element_at(F.create_map(*[F.lit(x) for pair in REFUSALS.items() for x in pair]), F.col("refusal"))
    entry = string_into([(F.col("draw"), None), (";", None), (F.col("outcome"), None), (";", None), (F.coalesce(wording, F.col("granted").cast("string")), None), (";", None), (F.col("note"), None)])
    return sized.withColumn("outcome", outcome).select("draw", "holder", "refusal", "granted", "outcome", entry.alias("entry"))


def draw_tables(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Orders as draws, customers as holders of lines; every ninth customer has none."""
    lines = table(spark, sf_dir, "customer").where("c_custkey % 9 <> 0").select(
        F.col("c_custkey").alias("line_holder"), F.substring("c_mktsegment", 1, 3).alias("line_purpose"),
        F.when(F.col("c_nationkey") % 6 == 1, "S").otherwise("O").alias("line_state"),
        (F.abs(F.col("c_acctbal")).cast("decimal(13,2)") * 30).cast("decimal(13,2)").alias("line_ceiling"),
        F.abs(F.col("c_acctbal")).cast("decimal(11,2)").alias("line_margin"))
    purpose = evaluate([("F", "BUI"), ("O", "MAC")], F.lit("AUT"), subjects=(F.col("o_orderstatus"),))
    draws = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("draw"), F.col("o_custkey").alias("holder"), purpose.alias("purpose"),
        F.col("o_totalprice").cast("decimal(12,2)").alias("asked"), F.col("o_orderpriority").alias("note"))
    return draws, lines


_DRAWS = """
WITH l AS (SELECT c_custkey, substr(c_mktsegment, 1, 3) AS purpose, c_nationkey % 6 <> 1 AS is_open,
                  CAST(CAST(abs(c_acctbal) AS DECIMAL(13,2)) * 30 AS DECIMAL(13,2)) AS ceiling, CAST(abs(c_acctbal) AS DECIMAL(13,2)) AS margin FROM customer WHERE c_custkey % 9 <> 0),
d AS (SELECT CAST(o_orderkey AS VARCHAR) AS draw, o_custkey AS holder, CASE o_orderstatus WHEN 'F' THEN 'BUI' WHEN 'O' THEN 'MAC' ELSE 'AUT' END AS wanted,
             CAST(o_totalprice AS DECIMAL(13,2)) AS asked, o_orderpriority AS note FROM orders),
f AS (SELECT *, CASE WHEN c_custkey IS NULL THEN 'NOLINE' WHEN NOT is_open THEN 'CLOSED' WHEN wanted <> purpose THEN 'PURPOSE' END AS refusal FROM d LEFT JOIN l ON holder = c_custkey),
s AS (SELECT *, CASE WHEN refusal IS NULL THEN CAST(least(greatest(asked - margin, 0), ceiling) AS DECIMAL(13,2)) END AS granted FROM f),
r AS (SELECT *, CASE WHEN refusal IS NOT NULL THEN 'REFUSED' WHEN granted = 0 THEN 'EMPTY' WHEN granted > 150000 THEN 'HELD' ELSE 'PAID' END AS outcome FROM s)"""


@query("claims_settlement", _DRAWS + """
SELECT draw, holder, refusal, granted, outcome, draw || ';' || outcome || ';' || coalesce(CASE refusal WHEN 'NOLINE' THEN 'holder has no credit line'
       WHEN 'CLOSED' THEN 'line takes no draws now' WHEN 'PURPOSE' THEN 'line is for another purpose' END, CAST(granted AS VARCHAR)) || ';' || note AS entry FROM r""")
def claims_settlement(spark, sf_dir):
    return grant(*draw_tables(spark, sf_dir))


@query("claims_totals", _DRAWS + """
SELECT count(*) AS draws, count(*) FILTER (outcome = 'PAID') AS paid, count(*) FILTER (outcome = 'HELD') AS held, count(*) FILTER (outcome = 'REFUSED') AS refused,
       CAST(coalesce(sum(granted), 0) % 1000000000 AS DECIMAL(11,2)) AS granted_total FROM r""")
def claims_totals(spark, sf_dir):
    """The counters of the read loop, as one aggregate."""
    from recordloom.operators.counters import totals

    counted = {"draws": F.lit(True)} | {name: F.col("outcome") == name.upper() for name in ("paid", "held", "refused")}
    return totals(grant(*draw_tables(spark, sf_dir)), counted, {"granted_total": (num(F.coalesce("granted", F.lit(0)), "9(11)V99"), "9(9)V99")})
