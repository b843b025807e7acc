"""Record files written and read back: lines, fixed records, dumps."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from recordloom.layout import copybook
from recordloom.plans.registry import query
from recordloom.session import scratch_path, table
from recordloom.sources import records as r

ORDER = copybook("""
    01 ORDER-REC.
       05 O-ORDERKEY   PIC 9(12).
       05 O-CUSTKEY    PIC 9(12).
       05 O-STATUS     PIC X.
       05 O-PRICE      PIC S9(9)V99 COMP-3.
       05 O-NET        PIC S9(9)V99 SIGN IS LEADING SEPARATE.
       05 O-PRIORITY   PIC X(15).
""")
LINE_ORDER = copybook("""
    01 ORDER-REC.
       05 O-ORDERKEY   PIC 9(12).
       05 O-STATUS     PIC X.
       05 O-NET        PIC S9(9)V99.
       05 O-PRIORITY   PIC X(15).
""")


def order_records(spark, sf_dir):
    price = F.col("o_totalprice").cast("decimal(11,2)")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", F.col("o_orderstatus").alias("o_status"), price.alias("o_price"),
        (price - 250000).cast("decimal(11,2)").alias("o_net"), F.col("o_orderpriority").alias("o_priority"))


@query("fixed_file_roundtrip", """
SELECT CAST(o_orderkey AS DECIMAL(12,0)) AS o_orderkey, CAST(o_custkey AS DECIMAL(12,0)) AS o_custkey, o_orderstatus AS o_status,
       CAST(o_totalprice AS DECIMAL(11,2)) AS o_price, CAST(CAST(o_totalprice AS DECIMAL(11,2)) - 250000 AS DECIMAL(11,2)) AS o_net, o_orderpriority AS o_priority FROM orders""")
def fixed_file_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "fixed")
    r.write_fixed(order_records(spark, sf_dir), ORDER, path)
    return r.read_fixed(spark, path, ORDER)


@query("line_file_roundtrip", """
SELECT CAST(o_orderkey AS DECIMAL(12,0)) AS o_orderkey, o_orderstatus AS o_status,
       CAST(CAST(o_totalprice AS DECIMAL(11,2)) - 250000 AS DECIMAL(11,2)) AS o_net, o_orderpriority AS o_priority FROM orders""")
def line_file_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "lines")
    r.write_lines(order_records(spark, sf_dir), LINE_ORDER, path)
    return r.read_lines(spark, path, LINE_ORDER)


@query("relative_file_numbers", "SELECT CAST(count(*) AS BIGINT) AS records, CAST(1 AS BIGINT) AS low, TRUE AS dense FROM orders")
def relative_file_numbers(spark, sf_dir):
    """Record numbers of a relative file are the line numbers of each file."""
    path = scratch_path(spark, "relative")
    r.write_lines(order_records(spark, sf_dir), LINE_ORDER, path)
    lines = r.numbered_lines(spark, path)
    per_file = lines.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("lo"), F.max("line").alias("hi"),
                                         F.count_distinct("line").alias("d"))
    return per_file.agg(F.sum("n").alias("records"), F.min("lo").alias("low"),
                        F.bool_and((F.col("hi") == F.col("n")) & (F.col("d") == F.col("n"))).alias("dense"))


@query("indexed_file_load", """
SELECT CAST(o_custkey AS DECIMAL(12,0)) AS o_custkey, CAST(min(o_orderkey) AS DECIMAL(12,0)) AS o_orderkey FROM orders GROUP BY o_custkey""")
def indexed_file_load(spark, sf_dir):
    """A keyed file loaded from lines: the first record of a key stays."""
    layout = copybook("01 REC.  05 O-CUSTKEY PIC 9(12).  05 O-ORDERKEY PIC 9(12).")
    path = scratch_path(spark, "indexed")
    src = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey").orderBy("o_orderkey")
    r.write_lines(src, layout, path)
    return r.open_input(spark, r.FileSpec(path, layout, r.INDEXED, "o_custkey"))


@query("relative_roundtrip", """
SELECT CAST(3 * o_orderkey + 1 AS BIGINT) AS rrn, o_orderstatus AS state FROM orders""")
def relative_roundtrip(spark, sf_dir):
    """Record numbers with gaps, over several part files, closed and opened again."""
    spec = r.FileSpec(scratch_path(spark, "slots"), copybook("01 REC.  05 STATE PIC X."), r.RELATIVE)
    o = table(spark, sf_dir, "orders").select((3 * F.col("o_orderkey") + 1).alias("rrn"), F.col("o_orderstatus").alias("state"))
    r.close_output(o.repartition(5), spec)
    return r.open_input(spark, spec)


@query("relative_wide_numbers", """
SELECT CAST(12345678900 + l_orderkey * 8 + l_linenumber AS BIGINT) AS rrn, l_returnflag AS state FROM lineitem""")
def relative_wide_numbers(spark, sf_dir):
    """Record numbers of more than ten digits, closed, extended and opened again."""
    spec = r.FileSpec(scratch_path(spark, "wide"), copybook("01 REC.  05 STATE PIC X."), r.RELATIVE)
    rows = table(spark, sf_dir, "lineitem").select((F.lit(12345678900) + F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("rrn"), F.col("l_returnflag").alias("state"))
    r.close_output(rows.where("rrn % 2 = 0"), spec)
    r.close_output(rows.where("rrn % 2 = 1"), spec, "EXTEND")
    return r.open_input(spark, spec)


@query("extend_first_wins", """
SELECT CAST(c_custkey AS DECIMAL(12,0)) AS key, CASE WHEN c_custkey % 3 = 0 THEN 'FIRST' WHEN c_custkey % 3 = 1 THEN 'SECOND' ELSE 'THIRD' END AS written FROM customer""")
def extend_first_wins(spark, sf_dir):
    """Of records with one key the one written first loads, also from an EXTEND behind an EXTEND."""
    spec = r.FileSpec(scratch_path(spark, "extended"), copybook("01 REC.  05 KEY PIC 9(12).  05 WRITTEN PIC X(6)."), r.INDEXED, "key")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    for mode, label, rows in (("OUTPUT", "FIRST", c.where("key % 3 = 0")), ("EXTEND", "SECOND", c.where("key % 3 <> 2")), ("EXTEND", "THIRD", c)):
        r.close_output(rows.withColumn("written", F.lit(label)), spec, mode)
    return r.open_input(spark, spec).select("key", F.rtrim("written").alias("written"))


@query("extend_line_order", """
SELECT CAST(r_regionkey AS BIGINT) + 1 AS place, r_name AS name FROM region UNION ALL
SELECT CAST(n_nationkey AS BIGINT) + 1 + (SELECT count(*) FROM region), n_name FROM nation""")
def extend_line_order(spark, sf_dir):
    """EXTEND puts its lines behind the last record."""
    from recordloom.operators.ordering import number_rows

    path, layout = scratch_path(spark, "order"), copybook("01 REC.  05 NAME PIC X(25).")
    r.write_lines(table(spark, sf_dir, "region").orderBy("r_regionkey").select(F.col("r_name").alias("name")), layout, path)
    r.write_lines(table(spark, sf_dir, "nation").orderBy("n_nationkey").select(F.col("n_name").alias("name")), layout, path, "EXTEND")
    lines = r.numbered_lines(spark, path).select(r.arrival().alias("at"), F.col("value").alias("name"))
    return number_rows(lines, [F.asc("at")], "place").select("place", "name")


@query("two_record_types", """
SELECT CASE WHEN c_custkey % 2 = 0 THEN 'A' ELSE 'B' END AS kind, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey AS DECIMAL(9,0)) END AS number, CASE WHEN c_custkey % 2 = 1 THEN c_mktsegment END AS segment FROM customer""")
def two_record_types(spark, sf_dir):
    """Two records of one file over the same storage, told apart by their first byte."""
    layout = copybook("01 HEAD. 05 KIND PIC X. 05 NUMBER PIC 9(9). 01 BODY. 05 KIND-B PIC X. 05 SEGMENT PIC X(15).")
    even = F.col("c_custkey") % 2 == 0
    lines = table(spark, sf_dir, "customer").select(F.when(even, F.concat(F.lit("A"), F.lpad(F.col("c_custkey").cast("string"), 9, "0"))).otherwise(F.concat(F.lit("B"), F.col("c_mktsegment"))).alias("value"))
    d = layout.decode(lines)
    return d.select("head.kind", F.when(F.col("head.kind") == "A", F.col("head.number")).alias("number"), F.when(F.col("head.kind") == "B", F.rtrim("body.segment")).alias("segment"))


@query("keyed_file_close", """
SELECT CAST(s_suppkey AS DECIMAL(9,0)) AS s_suppkey, rpad(s_name, 25, ' ') AS name FROM supplier""")
def keyed_file_close(spark, sf_dir):
    """A keyed file written back in key order and opened again."""
    layout = copybook("01 REC.  05 S-SUPPKEY PIC 9(9).  05 S-NAME PIC X(25).")
    spec = r.FileSpec(scratch_path(spark, "close"), layout, r.INDEXED, "s_suppkey")
    r.close_output(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), spec)
    return r.open_input(spark, spec).select("s_suppkey", F.rpad("s_name", 25, " ").alias("name"))


@query("delimited_dump", """
SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, c_mktsegment AS segment, CAST(CAST(c_acctbal AS DECIMAL(9,2)) AS VARCHAR) AS balance FROM customer""")
def delimited_dump(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    lines = c.select(F.concat_ws("|", F.col("c_custkey").cast("string"), "c_name", "c_mktsegment",
                                 F.col("c_acctbal").cast("decimal(9,2)").cast("string")).alias("value"))
    return r.read_delimited(lines, ["id", "name", "segment", "balance"])


@query("index_dump_decode", """
SELECT CAST(o_orderkey AS DECIMAL(12,0)) AS id, o_orderstatus AS state, CAST(o_totalprice AS DECIMAL(11,2)) AS price FROM orders""")
def index_dump_decode(spark, sf_dir):
    """Key and value blobs decoded by their own layouts."""
    key = copybook("01 K.  05 ID PIC 9(12).")
    value = copybook("01 V.  05 STATE PIC X.  05 PRICE PIC S9(9)V99 COMP-3.")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("state"),
                                              F.col("o_totalprice").cast("decimal(11,2)").alias("price"))
    pairs = o.select(key.record(binary=True).alias("key"), value.record(binary=True).alias("value"))
    return r.decode_pairs(pairs, key, value)


@query("packed_fields_in_lines", """
SELECT CAST(o_orderkey AS DECIMAL(12,0)) AS o_orderkey, CAST(o_totalprice AS DECIMAL(11,2)) AS amount FROM orders""")
def packed_fields_in_lines(spark, sf_dir):
    """A packed amount after a separator, cut from the record's bytes and decoded."""
    from recordloom.functions.codecs import decode_packed, encode_packed

    raw = table(spark, sf_dir, "orders").select(F.concat(
        F.encode(F.concat(F.lpad(F.col("o_orderkey").cast("string"), 12, "0"), F.lit("|")), "ISO-8859-1"),
        encode_packed(F.col("o_totalprice").cast("decimal(11,2)"), "S9(9)V99")).alias("value"))
    return raw.select(F.decode(F.col("value").substr(1, 12), "ISO-8859-1").cast("decimal(12,0)").alias("o_orderkey"),
                      decode_packed(F.col("value").substr(14, 6), "S9(9)V99").alias("amount"))


@query("described_tables_seed", """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' END AS meaning, CAST(CASE o_orderstatus WHEN 'F' THEN 0.50 WHEN 'O' THEN 1.25 END AS DECIMAL(4,2)) AS fee FROM orders""")
def described_tables_seed(spark, sf_dir):
    """A small table described in text, its rows as mappings and lists, seeded beside orders and asked by SQL."""
    from recordloom.operators.embedded_sql import query as ask
    from recordloom.sources.tables import described, seed

    codes = described(spark, {"STATUS_CODES": {"columns": {"CODE": "CHAR(1)", "MEANING": "VARCHAR(20)", "FEE": "DECIMAL(4,2)"},
                                              "rows": [{"CODE": "F", "MEANING": "finished", "FEE": Decimal("0.50")}, ["O", "open", Decimal("1.25")], {"CODE": "X", "MEANING": "never"}]}})
    seed(codes | {"orders": table(spark, sf_dir, "orders")})
    return ask(spark, "SELECT o_orderkey, meaning, fee FROM orders LEFT JOIN status_codes ON code = o_orderstatus WITH UR")


@query("copied_data_set", "SELECT CAST(o_orderkey AS VARCHAR) || '|' || o_orderstatus AS value FROM orders")
def copied_data_set(spark, sf_dir):
    """A line file copied to another, over what was there."""
    from recordloom.operators.batch import copy_dataset

    source, target = scratch_path(spark, "copy-from"), scratch_path(spark, "copy-to")
    lines = table(spark, sf_dir, "orders").select(F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderstatus").alias("value"))
    lines.write.text(source)
    lines.limit(3).write.text(target)
    copy_dataset(spark, source, target)
    return spark.read.text(target)


@query("defined_cluster", "SELECT CAST(s_suppkey AS DECIMAL(9,0)) AS k, s_nationkey::VARCHAR AS t, FALSE AS there FROM supplier")
def defined_cluster(spark, sf_dir):
    """A keyed data set's table defined from its layout, filled, read and deleted."""
    import uuid

    from recordloom.operators.batch import define_cluster, delete_dataset
    from recordloom.session import cut

    name = f"cluster_{uuid.uuid4().hex}"
    define_cluster(spark, name, copybook("01 REC.  05 K PIC 9(9).  05 T PIC X(3)."))
    table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("decimal(9,0)").alias("k"), F.col("s_nationkey").cast("string").alias("t")).write.insertInto(name)
    held = cut(spark.table(name))
    delete_dataset(spark, name)
    return held.withColumn("there", F.lit(spark.catalog.tableExists(name)))
