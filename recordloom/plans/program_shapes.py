"""Statement-level flow of programs of eight shapes, data flow, storage and lineage across programs.

A shape's edges are written out by hand beside its text, and serve as the SQL side.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from recordloom.operators import graph as g
from recordloom.plans.graphs_jobs import spread
from recordloom.plans.registry import query
from recordloom.session import table

#: (text, statement flow, data flow); @ stands for the number of the order's customer.
SHAPES = (
    ("""A-PARA.
    IF WS-A > 1
        MOVE WS-B TO WS-C
    ELSE
        ADD WS-D TO WS-C
    END-IF
    STOP RUN.""",
     "A-PARA A-PARA:1 FALLTHROUGH, A-PARA:1 A-PARA:2 TRUE_BRANCH, A-PARA:1 A-PARA:3 FALSE_BRANCH, A-PARA:2 A-PARA:5 SEQUENTIAL, A-PARA:3 A-PARA:4 FALSE_BRANCH, "
     "A-PARA:4 A-PARA:5 SEQUENTIAL, A-PARA:5 A-PARA:6 SEQUENTIAL, A-PARA:6 EXIT EXIT",
     "WS-B WS-C ASSIGNS, WS-D WS-C DERIVES_FROM, WS-C WS-C DERIVES_FROM, WS-A WS-C CONDITIONAL_ON"),
    ("""B-PARA.
    IF WS-A = 1 AND (WS-M = 2)
        IF WS-B = 2
            MOVE WS-X TO WS-Y
        ELSE
            GO TO D-PARA.
C-PARA.
    DISPLAY "GO TO A1".
D-PARA.
    GOBACK.""",
     "B-PARA B-PARA:1 FALLTHROUGH, B-PARA:1 B-PARA:2 TRUE_BRANCH, B-PARA:1 C-PARA FALSE_BRANCH, B-PARA:2 B-PARA:3 TRUE_BRANCH, B-PARA:2 B-PARA:4 FALSE_BRANCH, "
     "B-PARA:3 C-PARA SEQUENTIAL, B-PARA:4 B-PARA:5 FALSE_BRANCH, B-PARA:5 D-PARA GOTO, C-PARA C-PARA:1 FALLTHROUGH, C-PARA:1 D-PARA SEQUENTIAL, "
     "D-PARA D-PARA:1 FALLTHROUGH, D-PARA:1 EXIT EXIT",
     "WS-X WS-Y ASSIGNS, WS-A WS-Y CONDITIONAL_ON, WS-M WS-Y CONDITIONAL_ON, WS-B WS-Y CONDITIONAL_ON"),
    ("""E-PARA.
    EVALUATE WS-K
        WHEN 1
        WHEN 2
            MOVE WS-A TO WS-B
        WHEN OTHER
            MOVE ZERO TO WS-B
    END-EVALUATE.""",
     "E-PARA E-PARA:1 FALLTHROUGH, E-PARA:1 E-PARA:2 TRUE_BRANCH, E-PARA:1 E-PARA:3 TRUE_BRANCH, E-PARA:1 E-PARA:5 TRUE_BRANCH, E-PARA:2 E-PARA:3 SEQUENTIAL, "
     "E-PARA:3 E-PARA:4 SEQUENTIAL, E-PARA:4 E-PARA:7 SEQUENTIAL, E-PARA:5 E-PARA:6 SEQUENTIAL, E-PARA:6 E-PARA:7 SEQUENTIAL, E-PARA:7 EXIT SEQUENTIAL",
     "WS-A WS-B ASSIGNS, WS-K WS-B CONDITIONAL_ON"),
    ("""F-PARA.
    EVALUATE TRUE
        WHEN WS-A > WS-B
            COMPUTE WS-C = (WS-A - WS-B) * WS-T(WS-I)
    END-EVALUATE
    CONTINUE.""",
     "F-PARA F-PARA:1 FALLTHROUGH, F-PARA:1 F-PARA:2 TRUE_BRANCH, F-PARA:1 F-PARA:4 FALSE_BRANCH, F-PARA:2 F-PARA:3 SEQUENTIAL, F-PARA:3 F-PARA:4 SEQUENTIAL, "
     "F-PARA:4 F-PARA:5 SEQUENTIAL, F-PARA:5 EXIT SEQUENTIAL",
     "WS-A WS-C DERIVES_FROM, WS-B WS-C DERIVES_FROM, WS-T WS-C DERIVES_FROM, WS-A WS-C CONDITIONAL_ON, WS-B WS-C CONDITIONAL_ON"),
    ("""G-PARA.
    PERFORM H-PARA THRU I-PARA
    PERFORM J-PARA UNTIL WS-N > 3
    PERFORM NO-PARA
    STOP RUN.
H-PARA.
    ADD 1 TO WS-N.
I-PARA.
    EXIT.
J-PARA.
    SUBTRACT WS-A WS-B FROM WS-C GIVING WS-D.""",
     "G-PARA G-PARA:1 FALLTHROUGH, G-PARA:1 H-PARA PERFORM_THRU, I-PARA G-PARA:2 RETURN, G-PARA:1 G-PARA:2 SEQUENTIAL, G-PARA:2 J-PARA PERFORM, J-PARA G-PARA:3 RETURN, "
     "G-PARA:2 G-PARA:3 SEQUENTIAL, G-PARA:3 G-PARA:3 UNRESOLVED, G-PARA:3 G-PARA:4 SEQUENTIAL, G-PARA:4 EXIT EXIT, H-PARA H-PARA:1 FALLTHROUGH, H-PARA:1 I-PARA SEQUENTIAL, "
     "I-PARA I-PARA:1 FALLTHROUGH, I-PARA:1 J-PARA SEQUENTIAL, J-PARA J-PARA:1 FALLTHROUGH, J-PARA:1 EXIT SEQUENTIAL",
     "WS-N WS-N DERIVES_FROM, WS-A WS-D DERIVES_FROM, WS-B WS-D DERIVES_FROM, WS-C WS-D DERIVES_FROM"),
    ("""K-PARA.
    PERFORM UNTIL WS-EOF = 'Y'
        READ IN-FILE INTO WS-R
            AT END
                MOVE 'Y' TO WS-EOF
        END-READ
    END-PERFORM.""",
     "K-PARA K-PARA:1 FALLTHROUGH, K-PARA:1 K-PARA:2 TRUE_BRANCH, K-PARA:1 K-PARA:6 FALSE_BRANCH, K-PARA:6 K-PARA:1 LOOP, K-PARA:2 K-PARA:3 SEQUENTIAL, "
     "K-PARA:3 K-PARA:4 TRUE_BRANCH, K-PARA:3 K-PARA:5 FALSE_BRANCH, K-PARA:4 K-PARA:5 SEQUENTIAL, K-PARA:5 K-PARA:6 SEQUENTIAL, K-PARA:6 EXIT SEQUENTIAL",
     "IN-FILE WS-R CONSUMES, WS-EOF WS-R CONDITIONAL_ON, WS-EOF WS-EOF CONDITIONAL_ON"),
    ("""L-PARA.
    CALL 'P@' USING WS-A BY REFERENCE WS-B
    CALL WS-PGM
    GO TO M-PARA, N-PARA DEPENDING ON WS-I
    GO TO NOWHERE.
M-PARA.
    EXIT PROGRAM.
N-PARA.
    WRITE OUT-REC FROM WS-A
    GOBACK.""",
     "L-PARA L-PARA:1 FALLTHROUGH, L-PARA:1 P@ CALL, P@ L-PARA:2 RETURN, L-PARA:1 L-PARA:2 SEQUENTIAL, L-PARA:2 L-PARA:2 UNRESOLVED, L-PARA:2 L-PARA:3 SEQUENTIAL, "
     "L-PARA:3 M-PARA GOTO, L-PARA:3 N-PARA GOTO, L-PARA:3 L-PARA:4 SEQUENTIAL, L-PARA:4 L-PARA:4 UNRESOLVED, M-PARA M-PARA:1 FALLTHROUGH, M-PARA:1 EXIT EXIT, "
     "N-PARA N-PARA:1 FALLTHROUGH, N-PARA:1 N-PARA:2 SEQUENTIAL, N-PARA:2 EXIT EXIT",
     "WS-A OUT-REC ASSIGNS"),
    ("""    MOVE 'ABC' TO WS-X
    MOVE LOW-VALUES TO WS-Y.
MAIN SECTION.
    DISPLAY 'IF THIS GO TO THAT.'
    MOVE WS-TAB(WS-I) TO WS-Z WS-V(1:2)
    STRING WS-P '-' WS-Q DELIMITED BY SIZE INTO WS-S
    SET WS-J TO WS-K.""",
     "PROCEDURE PROCEDURE:1 FALLTHROUGH, PROCEDURE:1 PROCEDURE:2 SEQUENTIAL, PROCEDURE:2 MAIN SEQUENTIAL, MAIN MAIN:1 FALLTHROUGH, MAIN:1 MAIN:2 SEQUENTIAL, "
     "MAIN:2 MAIN:3 SEQUENTIAL, MAIN:3 MAIN:4 SEQUENTIAL, MAIN:4 EXIT SEQUENTIAL",
     "WS-TAB WS-Z ASSIGNS, WS-TAB WS-V ASSIGNS, WS-P WS-S DERIVES_FROM, WS-Q WS-S DERIVES_FROM, WS-K WS-J ASSIGNS"),
)


def shaped_programs(spark, sf_dir):
    """A program per order, of one of eight shapes."""
    o = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"))
    shape, customer = F.col("o_orderkey") % len(SHAPES), F.col("o_custkey").cast("string")
    texts = ["       IDENTIFICATION DIVISION.\n       PROCEDURE DIVISION.\n" + "\n".join("       " + x for x in text.split("\n")) + "\n" for text, _, _ in SHAPES]
    text = reduce(lambda c, k: c.when(shape == k, texts[k]), range(1, len(SHAPES)), F.when(shape == 0, texts[0]))
    return o.select(F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("program"), F.replace(text, F.lit("@"), customer).alias("text"))


def _beside(part: int) -> str:
    rows = [f"({k}, '{s}', '{t}', '{kind}')" for k, shape in enumerate(SHAPES) for s, t, kind in (e.split(" ") for e in shape[part].split(", "))]
    name = lambda c: f"replace({c}, '@', CAST(o_custkey AS VARCHAR)) AS {c}"
    return f"SELECT 'O' || o_orderkey AS program, {name('source')}, {name('target')}, kind FROM orders JOIN (VALUES {', '.join(rows)}) AS t(shape, source, target, kind) ON o_orderkey % {len(SHAPES)} = shape"


@query("statement_flow_edges", _beside(1))
def statement_flow_edges(spark, sf_dir):
    """Branches, arms, loops, jumps and calls from statement to statement."""
    return g.statement_flow(shaped_programs(spark, sf_dir))


@query("data_flow_shapes", _beside(2))
def data_flow_shapes(spark, sf_dir):
    return g.data_flow(shaped_programs(spark, sf_dir))


@query("storage_and_file_edges", """
WITH p AS (SELECT 'S' || s_suppkey AS program, CAST(s_nationkey AS VARCHAR) AS n FROM supplier)
SELECT program, replace(source, '@', n) AS source, replace(target, '@', n) AS target, kind FROM p, (VALUES
  ('IN-FILE', 'IN-@', 'CONSUMES'), ('OUT-@', 'OUT-FILE', 'PRODUCES'), ('AMOUNT-@', 'AMOUNT-X', 'SHARED_STORAGE'), ('IS-OPEN', 'STATE', 'USES'), ('IS-SHUT', 'STATE', 'USES')) AS t(source, target, kind)""")
def storage_and_file_edges(spark, sf_dir):
    """Items that redefine others, condition names, and records of the files they are read from and written to."""
    text = """       FILE SECTION.
       FD  IN-FILE LABEL RECORDS ARE STANDARD.
       01  IN-@ PIC X(80).
       FD  OUT-FILE.
       01  OUT-@ PIC X(80).
       FD  IDLE-FILE.
       01  IDLE-REC PIC X.
       WORKING-STORAGE SECTION.
       01  STATE PIC X VALUE 'N'.
           88 IS-OPEN VALUE 'Y. 05 Z REDEFINES Q'.
           88 IS-SHUT VALUE 'N'.
       01  AMOUNT-@ PIC 9(4).
       01  AMOUNT-X REDEFINES AMOUNT-@ PIC X(4).
       PROCEDURE DIVISION.
       MAIN-PARA.
           READ IN-FILE.
           WRITE OUT-@.
           STOP RUN.
"""
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("program"),
                                               F.replace(F.lit("       DATA DIVISION.\n" + text), F.lit("@"), F.col("s_nationkey").cast("string")).alias("text"))
    return g.storage_flow(s).unionByName(g.file_flow(s))


def billing_programs(spark, sf_dir):
    """Orders hand their total to their customer's program, which hands its sum to its nation's."""
    text = lambda c: F.col(c).cast("string")
    body = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    o = table(spark, sf_dir, "orders").select(body("O", text("o_orderkey")).alias("program"), body(
        "       PROCEDURE DIVISION.\n       MAIN.\n           CALL 'C", text("o_custkey"), "' USING BY CONTENT WS-TOTAL.\n").alias("text"))
    c = table(spark, sf_dir, "customer").select(body("C", text("c_custkey")).alias("program"), body(
        "       PROCEDURE DIVISION USING LK-AMT.\n       MAIN.\n           MOVE LK-AMT TO WS-SUM\n           CALL 'N", text("c_nationkey"), "' USING WS-SUM.\n").alias("text"))
    n = table(spark, sf_dir, "nation").select(body("N", text("n_nationkey")).alias("program"), F.lit(
        "       PROCEDURE DIVISION USING LK-SUM.\n       MAIN.\n           ADD LK-SUM TO WS-NATION.\n").alias("text"))
    return o.unionByName(c).unionByName(n)


@query("lineage_across_programs", """
WITH RECURSIVE edge AS (
  SELECT 'O' || o_orderkey || '.WS-TOTAL' AS source, 'C' || o_custkey || '.LK-AMT' AS target FROM orders
  UNION ALL SELECT 'C' || c_custkey || '.LK-AMT', 'C' || c_custkey || '.WS-SUM' FROM customer
  UNION ALL SELECT 'C' || c_custkey || '.WS-SUM', 'N' || c_nationkey || '.LK-SUM' FROM customer
  UNION ALL SELECT 'N' || c_nationkey || '.LK-SUM', 'C' || c_custkey || '.WS-SUM' FROM customer
  UNION ALL SELECT 'N' || n_nationkey || '.LK-SUM', 'N' || n_nationkey || '.WS-NATION' FROM nation
  UNION ALL SELECT 'N' || n_nationkey || '.WS-NATION', 'N' || n_nationkey || '.WS-NATION' FROM nation),
walk(node) AS (SELECT 'N' || n_nationkey || '.WS-NATION' FROM nation WHERE n_regionkey = 1 UNION SELECT e.source FROM walk JOIN edge e ON e.target = walk.node)
SELECT node FROM walk""")
def lineage_across_programs(spark, sf_dir):
    """All items of all programs that a region's sums come from, over two calls."""
    seeds = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string"), F.lit(".WS-NATION")).alias("node"))
    return g.reach(g.lineage_edges(billing_programs(spark, sf_dir)), seeds, source="target", target="source").select("node")
