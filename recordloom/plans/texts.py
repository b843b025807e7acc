"""String verbs, conditions and moves over part, customer, events and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordloom.functions import text as t
from recordloom.functions.conditions import ANY, evaluate, set_true, text_eq
from recordloom.functions.tables import subscript
from recordloom.layout import copybook
from recordloom.operators.moves import arithmetic_corresponding, initialize, move, move_corresponding
from recordloom.plans.registry import query
from recordloom.session import table


@query("refmod_substring", """
SELECT p_partkey, substr(p_name, 2, 4) AS middle, substr(p_name, 3) AS tail, substr(p_name, CAST(p_partkey % 3 + 1 AS INTEGER), 2) AS moving FROM part""")
def refmod_substring(spark, sf_dir):
    n = F.col("p_name")
    return table(spark, sf_dir, "part").select(
        "p_partkey", t.refmod(n, 2, 4).alias("middle"), t.refmod(n, 3).alias("tail"),
        t.refmod(n, (F.col("p_partkey") % 3 + 1).cast("int"), F.lit(2)).alias("moving"))


@query("string_concat", """
SELECT p_partkey, split_part(p_name, ' ', 1) || '-' || split_part(p_brand, '#', 1) || p_type AS joined,
       rpad(split_part(p_name, ' ', 1) || ';' || p_brand, 12, ' ') AS fitted FROM part""")
def string_concat(spark, sf_dir):
    n, b, ty = F.col("p_name"), F.col("p_brand"), F.col("p_type")
    return table(spark, sf_dir, "part").select(
        "p_partkey", t.string_into([(n, " "), ("-", None), (b, "#"), (ty, None)]).alias("joined"),
        t.string_into([(n, F.lit(" ")), (";", None), (b, None)], 12).alias("fitted"))


@query("unstring_split", """
WITH v AS (SELECT doc_id, text, string_split(text, ' ') AS p, length(text) AS n FROM documents),
w AS (SELECT *, length(coalesce(p[1], '')) + length(coalesce(p[2], '')) + length(coalesce(p[3], '')) + 3 AS used FROM v)
SELECT doc_id, coalesce(p[1], '') AS first, coalesce(p[2], '') AS second, coalesce(p[3], '') AS third, CAST(least(len(p), 3) AS INTEGER) AS filled,
       CAST(CASE WHEN len(p) <= 3 THEN n + 1 ELSE 1 + used END AS INTEGER) AS pointer,
       CASE WHEN len(p) <= 3 THEN FALSE ELSE 1 + used <= n END AS overflow
FROM w""")
def unstring_split(spark, sf_dir):
    u = t.unstring(F.col("text"), " ", 3)
    return table(spark, sf_dir, "documents").select(
        "doc_id", *[c.alias(k) for c, k in zip(u.fields, ("first", "second", "third"))],
        u.tally.alias("filled"), u.pointer.alias("pointer"), u.overflow.alias("overflow"))


@query("unstring_pointer", """
WITH v AS (SELECT event_id, props, CAST(event_id % 12 AS INTEGER) AS ptr FROM events),
w AS (SELECT *, CASE WHEN ptr < 1 OR ptr > length(props) THEN NULL ELSE string_split(substr(props, ptr), ':') END AS p FROM v)
SELECT event_id, CASE WHEN p IS NULL THEN '' ELSE coalesce(p[1], '') END AS head, CASE WHEN p IS NULL THEN 0 ELSE 1 END AS filled, p IS NULL OR len(p) > 1 AND ptr + length(p[1]) + 1 <= length(props) AS overflow FROM w""")
def unstring_pointer(spark, sf_dir):
    u = t.unstring(F.col("props"), ":", 1, (F.col("event_id") % 12).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", u.fields[0].alias("head"), u.tally.alias("filled"), u.overflow.alias("overflow"))


@query("inspect_tally", """
SELECT doc_id, CAST(length(text) AS INTEGER) AS characters, CAST(length(text) - length(replace(text, 'e', '')) AS INTEGER) AS all_e,
       CAST((length(text) - length(replace(text, 'th', ''))) // 2 AS INTEGER) AS all_th,
       CAST(length(s) - length(ltrim(s, '0')) AS INTEGER) AS leading_zeros
FROM (SELECT *, lpad(CAST(n_chars AS VARCHAR), 7, '0') AS s FROM documents)""")
def inspect_tally(spark, sf_dir):
    d = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", t.tally_characters(d).alias("characters"), t.tally_all(d, "e").alias("all_e"), t.tally_all(d, "th").alias("all_th"),
        t.tally_leading(F.lpad(F.col("n_chars").cast("string"), 7, "0"), "0").alias("leading_zeros"))


@query("inspect_replace", """
SELECT p_partkey, replace(replace(p_name, ' ', '_'), 'red', 'RED') AS all_replaced,
       CASE WHEN instr(p_name, 'e') > 0 THEN substr(p_name, 1, instr(p_name, 'e') - 1) || 'E' || substr(p_name, instr(p_name, 'e') + 1) ELSE p_name END AS first_replaced,
       repeat('*', length(s) - length(ltrim(s, '0'))) || ltrim(s, '0') AS leading_replaced, repeat('#', length(p_type)) AS masked
FROM (SELECT *, lpad(CAST(p_size AS VARCHAR), 6, '0') AS s FROM part)""")
def inspect_replace(spark, sf_dir):
    n = F.col("p_name")
    return table(spark, sf_dir, "part").select(
        "p_partkey", t.inspect_replacing(n, [("ALL", " ", "_"), ("ALL", "red", "RED")]).alias("all_replaced"),
        t.replace_first(n, "e", "E").alias("first_replaced"),
        t.replace_leading(F.lpad(F.col("p_size").cast("string"), 6, "0"), "0", "*").alias("leading_replaced"),
        t.replace_characters(F.col("p_type"), "#").alias("masked"))


@query("inspect_convert", """
SELECT doc_id, translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS upper_ascii, translate(text, 'ae', 'AE') AS shorter FROM documents""")
def inspect_convert(spark, sf_dir):
    lower = "abcdefghijklmnopqrstuvwxyz"
    d = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", t.converting(d, lower, lower.upper()).alias("upper_ascii"), t.converting(d, "aeio", "AE").alias("shorter"))


@query("move_alphanumeric", """
SELECT c_custkey, rpad(c_mktsegment, 6, ' ') AS cut, rpad(c_mktsegment, 12, ' ') AS padded, lpad(CAST(c_nationkey AS VARCHAR), 4, '0') AS digits,
       CAST(c_nationkey % 10 AS DECIMAL(1,0)) AS last_digit, CAST(c_custkey % 1000 AS DECIMAL(3,0)) AS from_text FROM customer""")
def move_alphanumeric(spark, sf_dir):
    seg, nk = F.col("c_mktsegment"), F.col("c_nationkey").cast("decimal(4,0)")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", move(seg, "X(20)", "X(6)").alias("cut"), move(seg, "X(20)", "X(12)").alias("padded"),
        move(nk, "9(4)", "X(4)").alias("digits"), move(nk, "9(4)", "9").alias("last_digit"),
        move(F.concat(F.col("c_custkey").cast("string"), F.lit("  ")), "X(12)", "9(3)").alias("from_text"))


@query("level88_filter", """
SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus IN ('F', 'P') THEN 'CLOSED' ELSE 'OPEN' END AS state
FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') OR o_orderstatus BETWEEN 'O' AND 'P'""")
def level88_filter(spark, sf_dir):
    layout = copybook("""
        01 ORDER-REC.
           05 O-ORDERSTATUS PIC X.
              88 CLOSED-ORDER VALUE 'F' 'P'.
              88 LATE-LETTERS VALUE 'O' THRU 'P'.
           05 O-ORDERPRIORITY PIC X(15).
              88 PRESSING VALUES ARE '1-URGENT' '2-HIGH'.
    """)
    state = F.when(layout.condition("CLOSED-ORDER"), "CLOSED").otherwise(set_true(["OPEN"]))
    return table(spark, sf_dir, "orders").where(layout.condition("PRESSING") | layout.condition("LATE-LETTERS")).select(
        "o_orderkey", "o_orderstatus", state.alias("state"))


@query("evaluate_also", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND price > 250000 THEN 'big closed' WHEN o_orderstatus = 'F' THEN 'closed'
       WHEN price BETWEEN 100000 AND 200000 THEN 'mid' ELSE 'other' END AS class
FROM (SELECT *, CAST(o_totalprice AS DECIMAL(15,2)) AS price FROM orders)""")
def evaluate_also(spark, sf_dir):
    price = F.col("o_totalprice").cast("decimal(15,2)")
    cls = evaluate([("F", True, "big closed"), ("F", ANY, "closed")], None, (F.col("o_orderstatus"), price > 250000))
    rest = evaluate([((100000, 200000), "mid")], F.lit("other"), (price,))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(cls, rest).alias("class"))


@query("padded_text_compare", """
SELECT c_custkey, c_mktsegment = 'BUILDING' AS literal_equal, TRUE AS column_equal FROM customer""")
def padded_text_compare(spark, sf_dir):
    seg = F.col("c_mktsegment")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", text_eq(F.rpad(seg, 15, " "), "BUILDING  ").alias("literal_equal"), text_eq(F.rpad(seg, 15, " "), seg).alias("column_equal"))


_FROM = copybook("""
    01 SRC.
       05 NAME PIC X(12).
       05 KEYS.
          10 NATIONKEY PIC 9(4).
          10 REGIONKEY PIC 9(4).
       05 ONLY-HERE PIC X(3).
""")
_TO = copybook("""
    01 DST.
       05 NAME PIC X(8).
       05 KEYS.
          10 REGIONKEY PIC 9.
          10 NATIONKEY PIC 9(6).
          10 EXTRA PIC 9(3).
       05 TALLY PIC 9(5).
""")


def _groups(spark, sf_dir):
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", F.struct(F.col("c_name").alias("name"), F.struct(F.col("n_nationkey").cast("decimal(4,0)").alias("nationkey"),
                 F.col("n_regionkey").cast("decimal(4,0)").alias("regionkey")).alias("keys"), F.lit("abc").alias("only_here")).alias("src"),
        F.struct(F.col("n_name").alias("name"), F.struct(F.lit(1).cast("decimal(1,0)").alias("regionkey"), F.lit(100).cast("decimal(6,0)").alias("nationkey"),
                 F.lit(7).cast("decimal(3,0)").alias("extra")).alias("keys"), F.lit(9).cast("decimal(5,0)").alias("tally")).alias("dst"))


@query("corresponding_move", """
SELECT c_custkey, rpad(c_name, 8, ' ') AS name, CAST(n_regionkey AS DECIMAL(1,0)) AS regionkey, CAST(n_nationkey AS DECIMAL(6,0)) AS nationkey,
       CAST(7 AS DECIMAL(3,0)) AS extra, CAST(9 AS DECIMAL(5,0)) AS tally, CAST((1 + n_regionkey) % 10 AS DECIMAL(1,0)) AS added_region,
       CAST(100 + n_nationkey AS DECIMAL(6,0)) AS added_nation, CAST(100 - n_nationkey AS DECIMAL(6,0)) AS less_nation
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def corresponding_move(spark, sf_dir):
    g = _groups(spark, sf_dir)
    moved = F.struct(*move_corresponding(_FROM, _TO, "src", "dst"))
    added = F.struct(*arithmetic_corresponding("ADD", _FROM, _TO, "src", "dst"))
    less = F.struct(*arithmetic_corresponding("SUBTRACT", _FROM, _TO, "src", "dst"))
    done = g.select("c_custkey", moved.alias("m"), added.alias("a"), less.alias("s"))
    return done.select("c_custkey", "m.name", "m.keys.regionkey", "m.keys.nationkey", "m.keys.extra", "m.tally",
                       F.col("a.keys.regionkey").alias("added_region"), F.col("a.keys.nationkey").alias("added_nation"),
                       F.col("s.keys.nationkey").alias("less_nation"))


@query("initialize_group", """
SELECT s_suppkey, '        ' AS name, CAST(0 AS DECIMAL(6,0)) AS nationkey, CAST(0 AS DECIMAL(5,0)) AS tally FROM supplier""")
def initialize_group(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", *initialize(_TO)).select(
        "s_suppkey", "name", F.col("keys.nationkey").alias("nationkey"), "tally")


@query("occurs_table", """
WITH v AS (SELECT o_orderkey, CAST(o_orderkey % 4 AS INTEGER) AS n FROM orders),
e AS (SELECT o_orderkey, n, CAST(u.i AS INTEGER) AS i FROM v, unnest(range(1, n + 1)) AS u(i))
SELECT v.o_orderkey, v.n AS entries, CAST(coalesce(sum(i * 11), 0) AS BIGINT) AS total, CAST(CASE WHEN v.n >= 2 THEN 22 END AS DECIMAL(3,0)) AS second
FROM v LEFT JOIN e USING (o_orderkey) GROUP BY v.o_orderkey, v.n""")
def occurs_table(spark, sf_dir):
    """OCCURS DEPENDING ON: encode a table of entries, read it back, subscript it."""
    layout = copybook("""
        01 REC.
           05 O-ORDERKEY PIC 9(12).
           05 N PIC 9.
           05 ENTRY OCCURS 0 TO 4 TIMES DEPENDING ON N.
              10 POS PIC 9.
              10 AMT PIC 9(3).
    """)
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 4).cast("int").alias("n"))
    filled = o.withColumn("entry", F.transform(
        F.when(F.col("n") > 0, F.sequence(F.lit(1), F.col("n"))).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(i.alias("pos"), (i * 11).alias("amt"))))
    back = layout.decode(layout.encode(filled))
    total = F.aggregate("entry", F.lit(0).cast("bigint"), lambda a, x: a + x["amt"].cast("bigint"))
    return back.select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"), F.col("n").cast("int").alias("entries"),
                       total.alias("total"), subscript(F.col("entry"), 2)["amt"].alias("second"))


@query("redefines_views", """
SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS as_text, substr(lpad(CAST(c_custkey AS VARCHAR), 8, '0'), 1, 4) AS high,
       CAST(c_custkey % 10000 AS DECIMAL(4,0)) AS low, lpad(CAST(CAST(abs(CAST(c_acctbal AS DECIMAL(9,2))) * 100 AS BIGINT) AS VARCHAR), 9, '0') || CASE WHEN c_acctbal < 0 THEN 'D' ELSE 'C' END AS packed_hex
FROM customer""")
def redefines_views(spark, sf_dir):
    """Two readings of the same bytes, one of them over a packed item."""
    layout = copybook("""
        01 REC.
           05 KEY-N PIC 9(8).
           05 KEY-T REDEFINES KEY-N PIC X(8).
           05 KEY-P REDEFINES KEY-N.
              10 HIGH-PART PIC X(4).
              10 LOW-PART PIC 9(4).
           05 BAL PIC S9(7)V99 COMP-3.
           05 BAL-X REDEFINES BAL PIC X(5).
    """)
    src = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key_n"), F.col("c_acctbal").cast("decimal(9,2)").alias("bal"))
    back = layout.decode(layout.encode(src, binary=True))
    return back.select(F.col("key_n").cast("bigint").alias("c_custkey"), F.col("key_t").alias("as_text"), F.col("key_p.high_part").alias("high"),
                       F.col("key_p.low_part").alias("low"), F.hex(t.latin1(F.col("bal_x"))).alias("packed_hex"))
