"""Graphs over programs written from the tables, and job decks likewise."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordloom.operators import batch as b
from recordloom.operators import graph as g
from recordloom.plans.registry import query
from recordloom.session import table


def spread(rows):
    """The rows over all cores: they are few bytes each in one file, and the texts made of them are long."""
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism)


def order_programs(spark, sf_dir):
    """A program text per order. It calls a program for its customer and one for
    its priority, and one named at run time where the order is finished."""
    o = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus"))
    text = lambda c: F.col(c).cast("string")
    return o.select(
        F.concat(F.lit("O"), text("o_orderkey")).alias("program"),
        F.concat(
            F.lit("       IDENTIFICATION DIVISION.\n       PROGRAM-ID. X.\n      * CALL 'NOT-THIS'.\n       PROCEDURE DIVISION.\n"
                  "       MAIN-PARA.\n           PERFORM CALL-PARA\n           COPY BOOK"), (F.col("o_custkey") % 100).cast("string"),
            F.lit(".\n           IF WS-A > WS-B\n               MOVE WS-B TO WS-C\n           END-IF\n"
                  "           COMPUTE WS-D = WS-A * WS-B + 1\n           GO TO END-PARA.\n       CALL-PARA.\n           CALL 'C"), text("o_custkey"),
            F.lit("' USING WS-AREA\n           CALL \"P"), F.substring("o_orderpriority", 1, 1), F.lit("\" USING WS-AREA\n"),
            F.when(F.col("o_orderstatus") == "F", "           CALL WS-TARGET USING WS-AREA\n").otherwise(""),
            F.lit("           CONTINUE.\n       LAST-PARA.\n           ADD WS-A WS-D GIVING WS-E.\n       END-PARA.\n           GOBACK.\n")).alias("text"))


@query("call_graph_edges", """
SELECT 'O' || o_orderkey AS caller, 'C' || o_custkey AS callee, 'static' AS kind FROM orders
UNION ALL SELECT 'O' || o_orderkey, 'P' || substr(o_orderpriority, 1, 1), 'static' FROM orders
UNION ALL SELECT 'O' || o_orderkey, 'WS-TARGET', 'dynamic' FROM orders WHERE o_orderstatus = 'F'""")
def call_graph_edges(spark, sf_dir):
    return g.call_edges(order_programs(spark, sf_dir))


@query("call_graph_roots", """
SELECT 'P' || p_partkey AS program FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)
UNION ALL SELECT 'O' || o_orderkey FROM orders""")
def call_graph_roots(spark, sf_dir):
    """Orders call parts and nothing calls an order."""
    name = lambda mark, c: F.concat(F.lit(mark), F.col(c).cast("string"))
    programs = table(spark, sf_dir, "part").select(name("P", "p_partkey").alias("program")).unionByName(
        table(spark, sf_dir, "orders").select(name("O", "o_orderkey").alias("program")))
    edges = table(spark, sf_dir, "lineitem").select(
        name("O", "l_orderkey").alias("caller"), name("P", "l_partkey").alias("callee"), F.lit("static").alias("kind"))
    return g.roots(programs, edges)


@query("dynamic_callers", "SELECT 'O' || o_orderkey AS caller FROM orders WHERE o_orderstatus = 'F'")
def dynamic_callers(spark, sf_dir):
    return g.dynamic_callers(g.call_edges(order_programs(spark, sf_dir)))


@query("copybook_coverage", """
WITH u AS (SELECT 'BOOK' || (o_custkey % 100) AS copybook FROM orders)
SELECT copybook, count(*) AS uses FROM u WHERE copybook NOT IN (SELECT 'BOOK' || s_suppkey FROM supplier) GROUP BY copybook""")
def copybook_coverage(spark, sf_dir):
    """Copybooks that programs use and nobody has."""
    have = table(spark, sf_dir, "supplier").select(F.concat(F.lit("BOOK"), F.col("s_suppkey").cast("string")).alias("copybook"))
    return g.uncovered(g.copybook_uses(order_programs(spark, sf_dir)), have, "copybook")


@query("control_flow_edges", """
WITH o AS (SELECT 'O' || o_orderkey AS program FROM orders)
SELECT program, 'MAIN-PARA' AS source, 'CALL-PARA' AS target, 'PERFORM' AS kind FROM o
UNION ALL SELECT program, 'MAIN-PARA', 'END-PARA', 'GOTO' FROM o
UNION ALL SELECT program, 'CALL-PARA', 'LAST-PARA', 'FALLTHROUGH' FROM o
UNION ALL SELECT program, 'LAST-PARA', 'END-PARA', 'FALLTHROUGH' FROM o
UNION ALL SELECT program, 'END-PARA', 'EXIT', 'EXIT' FROM o
UNION ALL SELECT 'O' || o_orderkey, 'CALL-PARA', 'C' || o_custkey, 'CALL' FROM orders
UNION ALL SELECT 'O' || o_orderkey, 'CALL-PARA', 'P' || substr(o_orderpriority, 1, 1), 'CALL' FROM orders""")
def control_flow_edges(spark, sf_dir):
    return g.control_flow(order_programs(spark, sf_dir))


@query("data_flow_edges", """
WITH o AS (SELECT 'O' || o_orderkey AS program FROM orders)
SELECT program, t.* FROM o, (VALUES ('WS-B', 'WS-C', 'ASSIGNS'), ('WS-A', 'WS-D', 'DERIVES_FROM'), ('WS-B', 'WS-D', 'DERIVES_FROM'), ('WS-A', 'WS-E', 'DERIVES_FROM'),
  ('WS-D', 'WS-E', 'DERIVES_FROM'), ('WS-A', 'WS-C', 'CONDITIONAL_ON'), ('WS-B', 'WS-C', 'CONDITIONAL_ON')) AS t(source, target, kind)""")
def data_flow_edges(spark, sf_dir):
    return g.data_flow(order_programs(spark, sf_dir))


def lineage(spark, sf_dir):
    """Edges from regions down to orders."""
    tag = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    n = table(spark, sf_dir, "nation").select(tag("R", "n_regionkey").alias("source"), tag("N", "n_nationkey").alias("target"))
    c = table(spark, sf_dir, "customer").select(tag("N", "c_nationkey").alias("source"), tag("C", "c_custkey").alias("target"))
    o = table(spark, sf_dir, "orders").select(tag("C", "o_custkey").alias("source"), tag("O", "o_orderkey").alias("target"))
    back = table(spark, sf_dir, "nation").select(tag("N", "n_nationkey").alias("source"), tag("R", "n_regionkey").alias("target"))
    return n.unionByName(c).unionByName(o).unionByName(back)


_REACH = """
WITH RECURSIVE edge AS (SELECT 'R' || n_regionkey AS source, 'N' || n_nationkey AS target FROM nation
  UNION ALL SELECT 'N' || c_nationkey, 'C' || c_custkey FROM customer UNION ALL SELECT 'C' || o_custkey, 'O' || o_orderkey FROM orders),
walk(node, depth) AS (SELECT 'R1', 0 UNION ALL SELECT e.target, depth + 1 FROM walk JOIN edge e ON e.source = walk.node)
SELECT node, depth FROM walk"""


@query("lineage_reach", _REACH)
def lineage_reach(spark, sf_dir):
    """Everything under one region; the edges hold cycles."""
    seeds = table(spark, sf_dir, "region").where("r_regionkey = 1").select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("node"))
    return g.reach(lineage(spark, sf_dir), seeds)


# -- jobs --------------------------------------------------------------------
@query("job_statements", """
SELECT 'S' || s_suppkey AS name, 'EXEC' AS op, 'PROG' || s_nationkey AS pgm, CASE WHEN s_suppkey % 2 = 0 THEN '(4,LT,S1)' END AS cond, 'PROD.D' || s_nationkey || '.FILE' AS dsn, '&&TEMP' AS temp FROM supplier""")
def job_statements(spark, sf_dir):
    """Deck lines to statements, with symbols put in."""
    s = table(spark, sf_dir, "supplier")
    nk = F.col("s_nationkey").cast("string")
    line = F.concat(F.lit("//S"), F.col("s_suppkey").cast("string"), F.lit(" EXEC PGM=PROG&NUM.,"),
                    F.when(F.col("s_suppkey") % 2 == 0, "COND=(4,LT,S1),").otherwise(""), F.lit("DSN=&ENV..D&NUM..FILE,TEMP=&&TEMP"))
    lines = s.select(F.explode(F.array(F.lit("//* COMMENT LINE"), line, F.lit("DATA LINE"))).alias("value"), nk.alias("num"))
    symbols = F.create_map(F.lit("ENV"), F.lit("PROD"), F.lit("NUM"), F.col("num"))
    st = b.statements(lines).withColumn("operands", b.substitute(F.col("operands"), symbols))
    return st.select("name", "op", b.parameter(F.col("operands"), "PGM").alias("pgm"), b.parameter(F.col("operands"), "COND").alias("cond"),
                     b.parameter(F.col("operands"), "DSN").alias("dsn"), b.parameter(F.col("operands"), "TEMP").alias("temp"))


@query("job_procedures", """
SELECT c_custkey AS job, 1 AS step_no, n_nationkey AS proc_no, 'RUN.P' || n_nationkey AS step, n_name AS pgm, 'IN' AS dd,
       CASE WHEN c_custkey % 3 = 0 AND n_nationkey % 2 = 0 THEN 'OVER' || c_custkey ELSE 'DEF' || n_nationkey END AS dsn
FROM customer JOIN nation ON n_regionkey = c_custkey % 5 WHERE c_custkey % 4 <> 0
UNION ALL SELECT c_custkey, 1, 0, 'RUN', 'PLAIN', NULL, NULL FROM customer WHERE c_custkey % 4 = 0""")
def job_procedures(spark, sf_dir):
    """Each customer's job runs a region's procedure, some with other data sets."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    plain = F.col("c_custkey") % 4 == 0
    steps = c.select(F.col("c_custkey").alias("job"), F.lit(1).alias("step_no"), F.lit("RUN").alias("step"), F.when(plain, "PLAIN").alias("pgm"),
                     F.when(~plain, F.concat(F.lit("R"), (F.col("c_custkey") % 5).cast("string"))).alias("proc"))
    procs = n.select(F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("proc"), F.col("n_nationkey").alias("proc_no"),
                     F.concat(F.lit("P"), F.col("n_nationkey").cast("string")).alias("proc_step"), F.col("n_name").alias("proc_pgm"), F.lit("IN").alias("dd"),
                     F.concat(F.lit("DEF"), F.col("n_nationkey").cast("string")).alias("dsn"))
    over = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("job"), F.lit("RUN").alias("step"), F.lit("IN").alias("dd"),
                                               F.concat(F.lit("OVER"), F.col("c_custkey").cast("string")).alias("dsn"), (F.col("c_custkey") % 5).alias("r"))
    over = over.join(n.where("n_nationkey % 2 = 0"), F.col("r") == F.col("n_regionkey")).select(
        "job", "step", F.concat(F.lit("P"), F.col("n_nationkey").cast("string")).alias("proc_step"), "dd", "dsn")
    return b.expand_procedures(steps, procs, over)


def deck_lines(spark, sf_dir):
    """Lines of the decks: one deck per nation of customers, numbered in order."""
    s = table(spark, sf_dir, "customer")
    k = F.col("c_custkey").cast("string")
    lines = F.array(F.concat(F.lit("//S"), k, F.lit(" EXEC PGM=SORT,COND=(4,LT)")), F.concat(F.lit("//SORTIN DD DSN=IN.D"), k, F.lit(",DISP=SHR")),
                    F.lit("//* A COMMENT"), F.lit("//SYSIN DD *"), F.concat(F.lit(" SORT FIELDS=(1,"), k, F.lit(",CH,A)")), F.lit("/*"),
                    F.concat(F.lit("//OUT DD DSN=OUT.D"), k, F.lit(",DISP=(NEW,CATLG)")))
    return s.select(F.col("c_nationkey").alias("deck"), "c_custkey", F.posexplode(lines).alias("n", "value")).select(
        "deck", (F.col("c_custkey") * 10 + F.col("n")).alias("seq"), "value")


@query("job_data_sets", """
SELECT c_nationkey AS deck, 'S' || c_custkey AS step, d.dd, CASE d.dd WHEN 'SORTIN' THEN 'IN.D' || c_custkey WHEN 'OUT' THEN 'OUT.D' || c_custkey END AS dsn, d.disp
FROM customer, (VALUES ('SORTIN', 'SHR'), ('SYSIN', NULL), ('OUT', '(NEW,CATLG)')) d(dd, disp)""")
def job_data_sets(spark, sf_dir):
    return b.step_data_sets(deck_lines(spark, sf_dir), "deck", "seq")


@query("job_continued_lines", """
SELECT s_nationkey AS deck, 'S' || s_suppkey AS step, d.dd, d.dsn || s_suppkey AS dsn, d.disp, '(4,LT)' AS cond
FROM supplier, (VALUES ('IN', 'FIRST.D', 'SHR'), ('IN', 'SECOND.D', 'OLD'), ('OUT', 'OUT.D', '(NEW,CATLG)')) d(dd, dsn, disp)""")
def job_continued_lines(spark, sf_dir):
    """Statements over several lines, with a comment between, and a DD that is concatenated."""
    k = F.col("s_suppkey").cast("string")
    lines = F.array(F.concat(F.lit("//S"), k, F.lit(" EXEC PGM=SORT,")), F.lit("//* BETWEEN"), F.lit("//   COND=(4,LT)"), F.concat(F.lit("//IN DD DSN=FIRST.D"), k, F.lit(",DISP=SHR")),
                    F.concat(F.lit("//   DD DSN=SECOND.D"), k, F.lit(",")), F.lit("//      DISP=OLD"), F.concat(F.lit("//OUT DD DSN=OUT.D"), k, F.lit(",")), F.lit("//  DISP=(NEW,"), F.lit("//  CATLG)"))
    deck = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("deck"), "s_suppkey", F.posexplode(lines).alias("n", "value")).select(
        "deck", (F.col("s_suppkey") * 16 + F.col("n")).alias("seq"), "value")
    steps = b.statements(b.whole_statements(deck, "deck", "seq")).where("op = 'EXEC'").select("deck", F.col("name").alias("step"), b.parameter(F.col("operands"), "COND").alias("cond"))
    return b.step_data_sets(deck, "deck", "seq").join(steps, ["deck", "step"])


@query("job_inline_data", """
SELECT c_nationkey AS deck, c_custkey * 10 + 4 AS seq, 'SYSIN' AS dd, ' SORT FIELDS=(1,' || c_custkey || ',CH,A)' AS value FROM customer""")
def job_inline_data(spark, sf_dir):
    return b.inline_data(deck_lines(spark, sf_dir), "deck", "seq")


def _decks(rows, key, lines):
    """Deck lines, numbered, from a table's rows: one deck a key, @ put in."""
    texts = F.array(*[F.replace(F.lit(x), F.lit("@"), F.col(key).cast("string")) for x in lines])
    return rows.select(F.col(key).alias("deck"), F.posexplode(texts).alias("seq", "value")).withColumn("seq", F.col("seq").cast("bigint"))


@query("job_set_symbols", """
SELECT s_suppkey AS deck, d.step, replace(d.dsn, '@', CAST(s_suppkey AS VARCHAR)) AS dsn FROM supplier, (VALUES
  ('ONE', 'PROD.D@.IN'), ('TWO', 'TEST.D@.PROD.LOG'), ('TWO', '&&WORK'), ('THREE', '&NEVER..X')) AS d(step, dsn)""")
def job_set_symbols(spark, sf_dir):
    """SET holds from where it stands to the next one; a value may name other symbols; what was never set stays."""
    lines = ("//J@ JOB (A),CLASS=A", "// SET ENV=PROD,NUM=D@", "// SET OLD=&ENV..LOG", "//ONE EXEC PGM=P", "//IN DD DSN=&ENV..&NUM..IN,DISP=SHR", "// SET ENV='TEST'",
             "//TWO EXEC PGM=P", "//LOG DD DSN=&ENV..&NUM..&OLD,DISP=SHR", "//TMP DD DSN=&&WORK,DISP=(NEW,PASS)", "//THREE EXEC PGM=P", "//X DD DSN=&NEVER..X,DISP=SHR", "// SET NEVER=LATE")
    out = b.expanded(_decks(table(spark, sf_dir, "supplier"), "s_suppkey", lines), "deck", "seq")
    return out.where("op = 'DD'").select("deck", "step", b.parameter(F.col("operands"), "DSN").alias("dsn"))


@query("job_procedures_from_text", """
SELECT s_suppkey AS deck, d.step, d.dd, replace(d.dsn, '@', CAST(s_suppkey AS VARCHAR)) AS dsn, d.pgm FROM supplier, (VALUES
  ('RUN.SORT', 'IN', 'OWN.@', 'SORT'), ('RUN.SORT', 'OUT', 'LIVE.OUT', 'SORT'), ('RUN.COPY.CP', 'TO', 'LIVE.D@.COPY', 'CP1'), ('RUN.COPY.CP', 'FROM', 'BASE.IN', 'CP1'),
  ('AGAIN.SORT', 'IN', 'BASE.IN', 'SORT'), ('AGAIN.SORT', 'OUT', 'PLAY.OUT', 'SORT'), ('AGAIN.SORT', 'LOG', 'LOG.@', 'SORT'), ('AGAIN.COPY.CP', 'TO', 'PLAY.D@.COPY', 'CP1'), ('AGAIN.COPY.CP', 'FROM', 'BASE.IN', 'CP1'),
  ('LAST', 'X', 'PLAIN.@', 'LASTPGM')) AS d(step, dd, dsn, pgm)""")
def job_procedures_from_text(spark, sf_dir):
    """Two runs of a procedure that runs another: values on EXEC, on PROC and SET, data sets put in place of its own, and one added."""
    lines = ("//J@ JOB (A)", "// SET ENV=PLAY,VER=1",
             "//OUTER PROC BASE=BASE,NUM=0", "//SORT EXEC PGM=SORT", "//IN DD DSN=&BASE..IN,DISP=SHR", "//OUT DD DSN=&ENV..OUT,DISP=OLD", "//COPY EXEC INNER,WHERE=&ENV..D&NUM", "//         PEND",
             "//INNER PROC WHERE=NOWHERE", "//CP EXEC PGM=CP&VER", "//TO DD DSN=&WHERE..COPY,", "//  DISP=OLD", "//FROM DD DSN=BASE.IN,DISP=SHR", "//         PEND",
             "//RUN EXEC OUTER,ENV=LIVE,NUM=@", "//SORT.IN DD DSN=OWN.@,DISP=SHR", "//AGAIN EXEC PROC=OUTER,NUM=@", "//SORT.LOG DD DSN=LOG.@,DISP=OLD", "//LAST EXEC PGM=LASTPGM", "//X DD DSN=PLAIN.@,DISP=SHR")
    out = b.expanded(_decks(table(spark, sf_dir, "supplier"), "s_suppkey", lines), "deck", "seq")
    steps = out.where("op = 'EXEC'").select("deck", "root", "step", b.parameter(F.col("operands"), "PGM").alias("pgm"))
    return out.where("op = 'DD'").join(steps, ["deck", "root", "step"]).select("deck", "step", "dd", b.parameter(F.col("operands"), "DSN").alias("dsn"), "pgm")
