"""Keyed datasets over customer, orders, part and lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordloom.operators import keyed as k
from recordloom.plans.registry import query
from recordloom.session import table


def _masters(spark, sf_dir):
    """Customers as a keyed master; every seventh is filed under another key."""
    return table(spark, sf_dir, "customer").select(
        F.when(F.col("c_custkey") % 7 == 0, -1 - F.col("c_custkey")).otherwise(F.col("c_custkey")).alias("c_custkey"),
        "c_name", "c_nationkey", F.col("c_mktsegment").alias("segment"))


_C = "(SELECT CASE WHEN c_custkey % 7 = 0 THEN -1 - c_custkey ELSE c_custkey END AS c_custkey, c_name, c_nationkey, c_mktsegment FROM customer)"


@query("keyed_lookup_status", f"""
SELECT o_orderkey, o_custkey, c_name, c_nationkey, CASE WHEN c_custkey IS NULL THEN '23' ELSE '00' END AS status
FROM orders LEFT JOIN {_C} ON o_custkey = c_custkey""")
def keyed_lookup_status(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return k.read_key(o, _masters(spark, sf_dir), "o_custkey", "c_custkey").select("o_orderkey", "o_custkey", "c_name", "c_nationkey", "status")


@query("keyed_lookup_bare_key", f"""
WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN lpad(CAST(o_custkey AS VARCHAR), 10, '0') ELSE CAST(o_custkey AS VARCHAR) END AS asked, o_custkey FROM orders)
SELECT o_orderkey, asked, c_name, CASE WHEN c_custkey IS NULL THEN '23' ELSE '00' END AS status
FROM o LEFT JOIN {_C} ON o_custkey = c_custkey""")
def keyed_lookup_bare_key(spark, sf_dir):
    """Keys asked for with leading zeros are found without them."""
    text = F.col("o_custkey").cast("string")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.lpad(text, 10, "0")).otherwise(text).alias("asked"))
    m = _masters(spark, sf_dir).select(F.col("c_custkey").cast("string").alias("id"), "c_name")
    return k.read_key(o, m, "asked", "id", strip_zeros=True).select("o_orderkey", "asked", "c_name", "status")


@query("alt_key_first", f"""
WITH f AS (SELECT c_nationkey, c_mktsegment, min(c_custkey) AS c_custkey FROM {_C} GROUP BY ALL),
a AS (SELECT c_nationkey || '/' || c_mktsegment AS alt, c_custkey FROM f)
SELECT o_orderkey, o_custkey % 30 || '/' || CASE WHEN o_orderstatus = 'F' THEN 'BUILDING' ELSE 'MACHINERY' END AS asked, a.c_custkey, CASE WHEN a.alt IS NULL THEN '23' ELSE '00' END AS status
FROM orders LEFT JOIN a ON a.alt = o_custkey % 30 || '/' || CASE WHEN o_orderstatus = 'F' THEN 'BUILDING' ELSE 'MACHINERY' END""")
def alt_key_first(spark, sf_dir):
    m = _masters(spark, sf_dir).select("c_custkey", F.concat_ws("/", F.col("c_nationkey").cast("string"), "segment").alias("alt"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws(
        "/", (F.col("o_custkey") % 30).cast("string"), F.when(F.col("o_orderstatus") == "F", "BUILDING").otherwise("MACHINERY")).alias("asked"))
    return k.read_alternate(o, m, "asked", "alt", "c_custkey").select("o_orderkey", "asked", "c_custkey", "status")


@query("start_ge_scan", "SELECT p_partkey, p_brand FROM part WHERE p_partkey >= 150")
def start_ge_scan(spark, sf_dir):
    return k.start(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_partkey", ">=", 150)


@query("start_alternate_scan", "SELECT p_brand, p_partkey, p_size FROM part WHERE p_brand > 'Brand#2'")
def start_alternate_scan(spark, sf_dir):
    return k.start(table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_size"), "p_brand", ">", "Brand#2", tie="p_partkey")


@query("start_outcomes", """
SELECT 'reached' AS attempt, CASE WHEN count(*) FILTER (p_partkey >= 150) > 0 THEN '00' ELSE '23' END AS status FROM part
UNION ALL SELECT 'beyond', CASE WHEN count(*) FILTER (p_partkey > 1000000000) > 0 THEN '00' ELSE '23' END FROM part""")
def start_outcomes(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey")
    a = k.start_status(p, "p_partkey", ">=", 150).select(F.lit("reached").alias("attempt"), "status")
    return a.unionByName(k.start_status(p, "p_partkey", ">", 1000000000).select(F.lit("beyond").alias("attempt"), "status"))


@query("sequential_outcomes", """
WITH n AS (SELECT count(*) AS n FROM part), r AS (SELECT p_partkey, (p_partkey + 1) * 2 AS reads FROM part)
SELECT p_partkey, CASE WHEN reads <= n THEN '00' WHEN reads = n + 1 THEN '10' ELSE '46' END AS status FROM r, n""")
def sequential_outcomes(spark, sf_dir):
    r = table(spark, sf_dir, "part").select("p_partkey", ((F.col("p_partkey") + 1) * 2).alias("reads"))
    n = table(spark, sf_dir, "part").agg(F.count(F.lit(1)).alias("n"))
    return r.select("p_partkey", k.sequential_status(F.col("reads"), n.scalar()).alias("status"))


def _events(spark, sf_dir):
    """Events as write requests: few keys, many attempts each."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("id"), "event_type", F.col("value").cast("decimal(9,2)").alias("amount"))


_EV = "SELECT event_id AS seq, user_id AS id, event_type, CAST(value AS DECIMAL(9,2)) AS amount FROM events"


def _user_master(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey")).otherwise(-1 - F.col("c_custkey")).alias("id"), F.lit("master").alias("event_type"), F.lit(0).cast("decimal(9,2)").alias("amount"))


_MASTER = "SELECT CASE WHEN c_custkey % 3 = 0 THEN c_custkey ELSE -1 - c_custkey END AS id, 'master' AS event_type, CAST(0 AS DECIMAL(9,2)) AS amount FROM customer"


@query("keyed_write_dup", f"""
WITH e AS ({_EV}), m AS ({_MASTER}), f AS (SELECT id, min(seq) AS seq FROM e GROUP BY id)
SELECT e.seq, e.id, CASE WHEN f.seq IS NOT NULL AND m.id IS NULL THEN '00' ELSE '22' END AS status
FROM e LEFT JOIN f ON e.seq = f.seq LEFT JOIN m ON e.id = m.id""")
def keyed_write_dup(spark, sf_dir):
    done = k.write_batch(_user_master(spark, sf_dir), _events(spark, sf_dir), k.KeySpec("id"), "seq")
    return done.outcomes.select("seq", "id", "status")


@query("keyed_write_master", f"""
WITH e AS ({_EV}), m AS ({_MASTER})
SELECT * FROM m UNION ALL SELECT id, event_type, amount FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS rn FROM e) WHERE rn = 1 AND id NOT IN (SELECT id FROM m)""")
def keyed_write_master(spark, sf_dir):
    return k.write_batch(_user_master(spark, sf_dir), _events(spark, sf_dir), k.KeySpec("id"), "seq").master


@query("keyed_write_repeated_alternate", f"""
WITH e AS ({_EV}), m AS ({_MASTER}), w AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS rn FROM e),
a AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY seq) AS an FROM w WHERE rn = 1 AND id NOT IN (SELECT id FROM m))
SELECT e.seq, CASE WHEN a.seq IS NULL THEN '22' WHEN a.an > 1 OR a.event_type IN (SELECT event_type FROM m) THEN '02' ELSE '00' END AS status
FROM e LEFT JOIN a ON e.seq = a.seq""")
def keyed_write_repeated_alternate(spark, sf_dir):
    spec = k.KeySpec("id", (k.Alternate("event_type", duplicates=True),))
    return k.write_batch(_user_master(spark, sf_dir), _events(spark, sf_dir), spec, "seq").outcomes.select("seq", "status")


_UNIQUE_EVENTS = """
ev AS (SELECT event_id AS seq, user_id AS id, CAST(value AS DECIMAL(9,2)) AS alt FROM events),
mc AS (SELECT CASE WHEN c_custkey % 5 = 0 THEN c_custkey ELSE -1 - c_custkey END AS id, CAST(abs(c_acctbal) AS DECIMAL(9,2)) AS alt FROM customer),
m AS (SELECT min(id) AS id, alt FROM mc GROUP BY alt)"""


@query("keyed_write_unique_alternate", f"""
WITH {_UNIQUE_EVENTS},
open AS (SELECT * FROM ev WHERE id NOT IN (SELECT id FROM m) AND alt NOT IN (SELECT alt FROM m)),
-- the requests in order, with the ids, alternates and numbers of those let in so far
fold AS (SELECT list_reduce(list({{'ids': [id], 'alts': [alt], 'seqs': [seq]}} ORDER BY seq), lambda s, r: CASE WHEN list_contains(s.ids, r.ids[1]) OR list_contains(s.alts, r.alts[1]) THEN s
  ELSE {{'ids': list_concat(s.ids, r.ids), 'alts': list_concat(s.alts, r.alts), 'seqs': list_concat(s.seqs, r.seqs)}} END) AS s FROM open),
let AS (SELECT unnest(s.seqs) AS seq FROM fold)
SELECT ev.seq, id, alt, CASE WHEN let.seq IS NULL THEN '22' ELSE '00' END AS status FROM ev LEFT JOIN let ON ev.seq = let.seq""")
def keyed_write_unique_alternate(spark, sf_dir):
    """Two keys that must each stay unique; what is let in depends on order."""
    ev = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("id"), F.col("value").cast("decimal(9,2)").alias("alt"))
    master = table(spark, sf_dir, "customer").select(
        F.when(F.col("c_custkey") % 5 == 0, F.col("c_custkey")).otherwise(-1 - F.col("c_custkey")).alias("id"), F.abs(F.col("c_acctbal")).cast("decimal(9,2)").alias("alt"))
    master = k.load(master.withColumn("at", F.col("id")), "alt", "at").select("id", "alt")
    return k.write_batch(master, ev, k.KeySpec("id", (k.Alternate("alt"),)), "seq").outcomes


#: Orders ask for a record of their customer and for a seat in it: both are one of a few of that customer.
_SEATS = """
r AS (SELECT o_orderkey AS seq, o_custkey AS o, o_custkey * 8 + o_orderkey % 3 AS id, o_custkey * 8 + o_totalprice::INTEGER % 4 AS alt, CASE o_orderkey // 3 % 4 WHEN 0 THEN 'WRITE' WHEN 1 THEN 'REWRITE' WHEN 2 THEN 'DELETE' ELSE 'REWRITE' END AS op FROM (SELECT o_orderkey, o_custkey, floor(o_totalprice) AS o_totalprice FROM orders))"""
#: The requests of a customer in turn; the state is the alternate of each of its three records, null where there is none.
_FOLD = """
SELECT o, list_reduce(list_prepend({'seq': -1, 'id': 0, 'alt': 0, 'op': '', 'st': '', 'all': [{'seq': CAST(-1 AS BIGINT), 'st': ''}], 'held': [o * 8, o * 8 + 1, NULL]},
  list({'seq': seq, 'id': id, 'alt': alt, 'op': op, 'st': '', 'all': [{'seq': CAST(-1 AS BIGINT), 'st': ''}], 'held': [CAST(NULL AS BIGINT)]} ORDER BY seq)), lambda s, q:
  {'seq': q.seq, 'id': q.id, 'alt': q.alt, 'op': q.op, 'st': '', 'all': list_append(s.all, {'seq': q.seq, 'st': STATUS}), 'held': CASE WHEN STATUS <> '00' THEN s.held
     ELSE [CASE WHEN q.id % 8 = i THEN (CASE WHEN q.op = 'DELETE' THEN NULL ELSE q.alt END) ELSE s.held[i + 1] END for i in [0, 1, 2]] END}).all AS told FROM r GROUP BY o""".replace("STATUS", """
  (CASE WHEN q.op = 'WRITE' AND (s.held[q.id % 8 + 1] IS NOT NULL OR list_contains(s.held, q.alt)) THEN '22' WHEN q.op <> 'WRITE' AND s.held[q.id % 8 + 1] IS NULL THEN '23'
    WHEN q.op = 'REWRITE' AND len(list_filter([0, 1, 2], lambda i: i <> q.id % 8 AND s.held[i + 1] = q.alt)) > 0 THEN '22' ELSE '00' END)""")


def _seats(spark, sf_dir):
    op = F.element_at(F.array(F.lit(k.WRITE), F.lit(k.REWRITE), F.lit(k.DELETE), F.lit(k.REWRITE)), F.expr("CAST(o_orderkey DIV 3 % 4 + 1 AS INT)"))
    requests = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("seq"), (F.col("o_custkey") * 8 + F.col("o_orderkey") % 3).alias("id"), (F.col("o_custkey") * 8 + F.floor("o_totalprice") % 4).alias("alt"), op.alias("op"))
    seat = F.explode(F.sequence(F.col("o_custkey") * 8, F.col("o_custkey") * 8 + 1))
    return table(spark, sf_dir, "orders").select("o_custkey").distinct().select(seat.alias("id")).withColumn("alt", F.col("id")), requests, k.KeySpec("id", (k.Alternate("alt"),))


@query("keyed_mixed_unique_alternate", f"""
WITH {_SEATS}, f AS ({_FOLD}), t AS (SELECT unnest(told) AS t FROM f)
SELECT r.seq, r.id, r.alt, r.op, t.st AS status FROM t JOIN r ON r.seq = t.t.seq""".replace("t.st AS", "t.t.st AS"))
def keyed_mixed_unique_alternate(spark, sf_dir):
    """Writes, rewrites and deletes that take and free each other's alternates."""
    master, requests, spec = _seats(spark, sf_dir)
    return k.apply_batch_unique(master, requests, spec, "seq").outcomes


@query("keyed_rewrite_alternate", f"""
WITH {_SEATS.replace("CASE o_orderkey // 3 % 4 WHEN 0 THEN 'WRITE' WHEN 1 THEN 'REWRITE' WHEN 2 THEN 'DELETE' ELSE 'REWRITE' END", "'REWRITE'")}, f AS ({_FOLD}), t AS (SELECT unnest(told) AS t FROM f)
SELECT r.seq, r.id, r.alt, t.t.st AS status FROM t JOIN r ON r.seq = t.t.seq""")
def keyed_rewrite_alternate(spark, sf_dir):
    """A rewrite that asks for an alternate another record holds is turned down; the record keeps its own."""
    master, requests, spec = _seats(spark, sf_dir)
    return k.rewrite_batch(master, requests.drop("op"), "id", "seq", spec).outcomes


@query("relative_write", """
WITH r AS (SELECT o_orderkey AS seq, o_custkey AS rrn, o_orderstatus AS body FROM orders), m AS (SELECT n_nationkey AS rrn FROM nation),
f AS (SELECT rrn, min(seq) AS seq FROM r GROUP BY rrn)
SELECT r.seq, r.rrn, CASE WHEN f.seq IS NOT NULL AND r.rrn NOT IN (SELECT rrn FROM m) THEN '00' ELSE '22' END AS status FROM r LEFT JOIN f ON r.seq = f.seq""")
def relative_write(spark, sf_dir):
    m = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("rrn"), F.lit("x").alias("body"))
    r = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("rrn"), F.col("o_orderstatus").alias("body"))
    return k.write_relative(m, r, "rrn", "seq").outcomes.select("seq", "rrn", "status")


@query("keyed_rewrite", f"""
WITH e AS ({_EV}), m AS ({_MASTER})
SELECT e.seq, e.id, CASE WHEN m.id IS NULL THEN '23' ELSE '00' END AS status FROM e LEFT JOIN m ON e.id = m.id""")
def keyed_rewrite(spark, sf_dir):
    return k.rewrite_batch(_user_master(spark, sf_dir), _events(spark, sf_dir), "id", "seq").outcomes.select("seq", "id", "status")


@query("keyed_rewrite_master", f"""
WITH e AS ({_EV}), m AS ({_MASTER}), l AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS rn FROM e)
SELECT m.id, coalesce(l.event_type, m.event_type) AS event_type, coalesce(l.amount, m.amount) AS amount FROM m LEFT JOIN (SELECT * FROM l WHERE rn = 1) l ON m.id = l.id""")
def keyed_rewrite_master(spark, sf_dir):
    return k.rewrite_batch(_user_master(spark, sf_dir), _events(spark, sf_dir), "id", "seq").master


@query("keyed_delete", f"""
WITH e AS ({_EV}), m AS ({_MASTER}), f AS (SELECT id, min(seq) AS seq FROM e GROUP BY id)
SELECT e.seq, e.id, CASE WHEN f.seq IS NOT NULL AND m.id IS NOT NULL THEN '00' ELSE '23' END AS status FROM e LEFT JOIN f ON e.seq = f.seq LEFT JOIN m ON e.id = m.id""")
def keyed_delete(spark, sf_dir):
    return k.delete_batch(_user_master(spark, sf_dir), _events(spark, sf_dir), "id", "seq").outcomes.select("seq", "id", "status")


@query("keyed_delete_master", f"WITH m AS ({_MASTER}) SELECT * FROM m WHERE id NOT IN (SELECT user_id FROM events)")
def keyed_delete_master(spark, sf_dir):
    return k.delete_batch(_user_master(spark, sf_dir), _events(spark, sf_dir), "id", "seq").master


_OPS = "CASE event_type WHEN 'view' THEN 'READ' WHEN 'click' THEN 'REWRITE' WHEN 'error' THEN 'DELETE' ELSE 'WRITE' END"
_MIX = f"""
WITH e AS (SELECT seq, id, amount, {_OPS} AS op FROM ({_EV})), m AS (SELECT id, amount FROM ({_MASTER})),
w AS (SELECT e.*, m.id AS mid, last_value(CASE op WHEN 'WRITE' THEN TRUE WHEN 'DELETE' THEN FALSE END IGNORE NULLS) OVER (PARTITION BY e.id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM e LEFT JOIN m ON e.id = m.id),
s AS (SELECT *, CASE WHEN op = 'WRITE' AND coalesce(was, mid IS NOT NULL) THEN '22' WHEN op <> 'WRITE' AND NOT coalesce(was, mid IS NOT NULL) THEN '23' ELSE '00' END AS status FROM w)"""


def _mixed(spark, sf_dir):
    op = (F.when(F.col("event_type") == "view", k.READ).when(F.col("event_type") == "click", k.REWRITE)
          .when(F.col("event_type") == "error", k.DELETE).otherwise(k.WRITE))
    req = _events(spark, sf_dir).select("seq", "id", "amount", op.alias("op"))
    return k.apply_batch(_user_master(spark, sf_dir).select("id", "amount"), req, "id", "seq")


@query("keyed_mixed_stream", _MIX + " SELECT seq, id, op, status FROM s")
def keyed_mixed_stream(spark, sf_dir):
    return _mixed(spark, sf_dir).outcomes.select("seq", "id", "op", "status")


@query("keyed_mixed_master", _MIX + """, f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS rn FROM s WHERE status = '00' AND op <> 'READ')
SELECT id, amount FROM m WHERE id NOT IN (SELECT id FROM f) UNION ALL SELECT id, amount FROM f WHERE rn = 1 AND op <> 'DELETE'""")
def keyed_mixed_master(spark, sf_dir):
    return _mixed(spark, sf_dir).master


@query("invalid_key_branches", f"""
SELECT CASE WHEN c_custkey IS NULL THEN 'INVALID KEY' ELSE 'NOT INVALID KEY' END AS branch, count(*) AS records, CAST(sum(CAST(o_totalprice AS DECIMAL(15,2))) AS DECIMAL(25,2)) AS amount
FROM orders LEFT JOIN {_C} ON o_custkey = c_custkey GROUP BY 1""")
def invalid_key_branches(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_totalprice").cast("decimal(15,2)").alias("amount"))
    done = k.read_key(o, _masters(spark, sf_dir).select("c_custkey"), "o_custkey", "c_custkey")
    branch = F.when(F.col("status") == k.MISSING, "INVALID KEY").otherwise("NOT INVALID KEY")
    return done.groupBy(branch.alias("branch")).agg(F.count(F.lit(1)).alias("records"), F.sum("amount").alias("amount"))


@query("sequential_read", f"SELECT c_custkey, c_name FROM {_C}")
def sequential_read(spark, sf_dir):
    return k.read_sequential(_masters(spark, sf_dir).select("c_custkey", "c_name"), "c_custkey")


@query("start_positions", """
SELECT o_orderkey, o_custkey, m.c_custkey, CASE WHEN m.c_custkey IS NULL THEN '23' ELSE '00' END AS status
FROM (SELECT o_orderkey, o_custkey * 7 AS o_custkey FROM orders) ASOF LEFT JOIN (SELECT c_custkey * 6 + 3 AS c_custkey FROM customer) m ON o_custkey <= m.c_custkey""")
def start_positions(spark, sf_dir):
    """A START >= per order: the key each one positions on."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") * 7).alias("o_custkey"))
    m = table(spark, sf_dir, "customer").select((F.col("c_custkey") * 6 + 3).alias("c_custkey"))
    return k.start_each(o, m, "o_custkey", "c_custkey", "o_orderkey")


@query("start_positions_after", """
SELECT o_orderkey, o_custkey, m.c_custkey, CASE WHEN m.c_custkey IS NULL THEN '23' ELSE '00' END AS status
FROM (SELECT o_orderkey, o_custkey * 7 AS o_custkey FROM orders) ASOF LEFT JOIN (SELECT c_custkey * 6 + 3 AS c_custkey FROM customer) m ON o_custkey < m.c_custkey""")
def start_positions_after(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") * 7).alias("o_custkey"))
    m = table(spark, sf_dir, "customer").select((F.col("c_custkey") * 6 + 3).alias("c_custkey"))
    return k.start_each(o, m, "o_custkey", "c_custkey", "o_orderkey", ">")


@query("relative_append", """
SELECT c_custkey + 1 AS rrn, c_name AS body FROM customer
UNION ALL SELECT (SELECT max(c_custkey) + 1 FROM customer) + row_number() OVER (ORDER BY o_orderkey), o_orderpriority FROM orders""")
def relative_append(spark, sf_dir):
    m = table(spark, sf_dir, "customer").select((F.col("c_custkey") + 1).alias("rrn"), F.col("c_name").alias("body"))
    r = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("body"))
    return k.append_relative(m, r, "rrn", "seq")


def _order_store(spark, sf_dir):
    """Orders on disk by their number, with an index of their customers."""
    from recordloom.session import scratch_path
    from recordloom.sources.keyed_store import write_store

    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").cast("decimal(12,2)").alias("price"))
    return write_store(o, k.KeySpec("o_orderkey", (k.Alternate("o_custkey", True),)), scratch_path(spark, "order-store"), files=16)


@query("keyed_store_start", """
SELECT o_orderkey, o_custkey, CAST(o_totalprice AS DECIMAL(12,2)) AS price FROM orders WHERE o_orderkey > (SELECT max(o_orderkey) * 9 // 10 FROM orders)""")
def keyed_store_start(spark, sf_dir):
    """START > a key nine tenths along: the files of the last tenth are opened."""
    store = _order_store(spark, sf_dir)
    last = table(spark, sf_dir, "orders").agg(F.max("o_orderkey")).first()[0]
    return store.start(">", last * 9 // 10)


@query("keyed_store_alternate", """
SELECT o_orderkey, o_custkey, CAST(o_totalprice AS DECIMAL(12,2)) AS price FROM orders WHERE o_custkey BETWEEN 10 AND 30""")
def keyed_store_alternate(spark, sf_dir):
    """Records of a range of customers, by the index."""
    return _order_store(spark, sf_dir).read_alternate("o_custkey", 10, 30)
