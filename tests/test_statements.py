"""Embedded SQL, comparison, graphs and job decks on small fixtures."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from recordloom.operators import batch as b
from recordloom.operators import embedded_sql as e
from recordloom.operators import graph as g
from recordloom.operators import reconcile as rc
from recordloom.sources.tables import described, seed, spark_type


@pytest.fixture(scope="module")
def tables(spark):
    t = described(spark, {
        "CUSTOMER": {"columns": {"CUST_ID": "INTEGER", "CUST_NAME": "VARCHAR(100)", "DEPT_ID": "INTEGER", "STATUS": "VARCHAR(10)"},
                     "rows": [[101, "TEST CUSTOMER", None, "ACTIVE"], [102, "ANOTHER CUST", 10, "ACTIVE"], [103, "NULL TEST CUST", 10, "INACTIVE"]]},
        "DEPT": {"columns": [{"name": "DEPT_ID", "type": "INT"}, {"name": "DEPT_NAME", "type": "CHAR(20)"}], "rows": [{"DEPT_ID": 10, "DEPT_NAME": "ENGINEERING"}]},
        "ORD": {"columns": {"ORDER_ID": "INTEGER", "CUSTOMER_ID": "INTEGER", "AMOUNT": "DECIMAL(10,2)"}, "rows": []}})
    seed(t)
    return t


def test_queries(spark, tables):
    join = e.select_into(spark, """SELECT C.CUST_NAME, D.DEPT_NAME INTO :WS-NAME, :WS-DEPT:WS-IND FROM CUSTOMER C
        LEFT OUTER JOIN DEPT D ON C.DEPT_ID = D.DEPT_ID WHERE C.CUST_ID = :WS-ID""", {"WS-ID": 101, "WS-NAME": "", "WS-DEPT": "", "WS-IND": 0})
    assert (join.sqlcode, join.sqlstate) == (0, "00000") and tuple(join.rows.first()) == ("TEST CUSTOMER", None)
    assert e.query(spark, "SELECT COUNT(*) FROM CUSTOMER WHERE STATUS = :S", {"S": "ACTIVE   "}).first()[0] == 2
    grp = e.query(spark, "SELECT DEPT_ID, COUNT(*) AS N FROM CUSTOMER GROUP BY DEPT_ID HAVING COUNT(*) > :M", {"M": 1})
    assert [tuple(r) for r in grp.collect()] == [(10, 2)]
    none = e.select_into(spark, "SELECT CUST_NAME INTO :N FROM CUSTOMER WHERE CUST_ID = 999", {"N": ""})
    assert (none.sqlcode, none.sqlstate) == (100, "02000")
    many = e.select_into(spark, "SELECT CUST_ID INTO :N FROM CUSTOMER", {"N": 0}, order=["cust_id"])
    assert many.count == 2 and many.rows.first()[0] == 101
    assert e.select_into(spark, "SELECT 1 FROM NO_SUCH_TABLE").sqlcode == -204
    assert e.select_into(spark, "SELECT NO_SUCH FROM CUSTOMER").sqlcode == -206
    assert e.select_into(spark, "SELECT CURRENT TIMESTAMP FROM SYSIBM.SYSDUMMY1").sqlcode == 0


def test_refusals(spark, tables):
    with pytest.raises(e.HostVariableError, match="WS-MISSING"):
        e.query(spark, "SELECT * FROM CUSTOMER WHERE CUST_ID = :WS-MISSING")
    for verb in ("MERGE INTO T", "WITH X AS (SELECT 1) SELECT 1", "CALL P", "CONNECT TO D"):
        with pytest.raises(e.UnsupportedStatement):
            e.statement(verb)
    body, args, warned = e.statement("SELECT ':x' AS A FROM T WHERE B = :C-D WITH UR", {"c-d": "v  "})
    assert ":x" in body and list(args.values()) == ["v"] and warned == ["WITH UR"]
    assert e.sqlcode(ValueError("x")) == -1
    assert spark_type("NUMERIC(9,2)") == "decimal(9,2)" and spark_type("CHAR(3)") == "string"


def test_statement_text_is_left_alone():
    body, args, _ = e.statement("SELECT 'SOLD WITH UR X', \"a :b\" FROM T -- :no\nWHERE A = :ST:IND OR B = :ST OR C = :WS-A OR D = :WS_A FOR UPDATE OF A, B FETCH FIRST 5 ROWS ONLY",
                                {"ST": "x ", "IND": -1, "WS-A": 1, "WS_A": 2})
    assert "'SOLD WITH UR X'" in body and '"a :b"' in body and ":no" not in body and body.endswith("LIMIT 5")
    assert list(args.values()) == [None, "x", 1, 2]


def test_fetch_first_stays_in_its_place():
    text = lambda t, **host: " ".join(e.statement(t, host)[0].split())
    assert text("SELECT A FROM T FETCH FIRST 5 ROWS ONLY -- the top; FETCH FIRST 9 ROWS ONLY") == "SELECT A FROM T LIMIT 5"
    assert text("SELECT A FROM (SELECT A FROM T ORDER BY A FETCH FIRST ROW ONLY) X FETCH FIRST 3 ROWS ONLY WITH UR ; -- end") == "SELECT A FROM (SELECT A FROM T ORDER BY A LIMIT 1) X LIMIT 3"
    assert text("SELECT A INTO :X -- where to\n, :Y FROM T WHERE B = :Z", Z=1) == "SELECT A FROM T WHERE B = :h0"
    assert text("SELECT /*+ BROADCAST(T) */ A::int, '--', B ::date FROM T") == "SELECT /*+ BROADCAST(T) */ A::int, '--', B ::date FROM T"


# -- comparison: every kind of damage must be seen -----------------------------
@pytest.fixture(scope="module")
def base(spark):
    return spark.createDataFrame([(i, f"n{i}", None if i == 3 else i * 10) for i in range(20)], "id int, name string, v int")


DAMAGE = {
    "changed": lambda d: d.withColumn("v", F.when(F.col("id") == 5, -1).otherwise(F.col("v"))),
    "nulled": lambda d: d.withColumn("v", F.when(F.col("id") != 5, F.col("v"))),
    "filled": lambda d: d.withColumn("v", F.coalesce("v", F.lit(0))),
    "lost": lambda d: d.where("id != 7"),
    "added": lambda d: d.unionByName(d.where("id = 7").withColumn("id", F.lit(99))),
    "renumbered": lambda d: d.withColumn("id", F.when(F.col("id") == 7, 77).otherwise(F.col("id"))),
}


@pytest.mark.parametrize("kind", DAMAGE)
def test_damage_is_seen(spark, base, kind):
    bad = DAMAGE[kind](base)
    assert rc.verdict(base, bad, ["id"], ["name", "v"]).first().verdict == "MISMATCH"
    assert not rc.compare(base, bad, ["id"], ["name", "v"]).isEmpty()
    assert not rc.bag_difference(base, bad).isEmpty()
    got = dict(rc.contract({"t": base}, {"t": bad}, {"file_contents", "record_counts"}, {"t": ["id"]}).collect())
    assert got["file_contents"] == "FAIL" and got["record_counts"] == ("FAIL" if kind in ("lost", "added") else "PASS")


def test_equal_sides(spark, base):
    assert rc.verdict(base, base, ["id"], ["name", "v"]).first().verdict == "MATCH"
    assert rc.compare(base, base, ["id"], ["name", "v"]).isEmpty() and rc.bag_difference(base, base).isEmpty()
    twice = base.unionByName(base.where("id = 1"))
    assert [(r.id, r.expected_copies, r.actual_copies) for r in rc.bag_difference(base, twice).collect()] == [("1", 1, 2)]


def test_contract_without_evidence(spark, base):
    got = dict(rc.contract({"t": base}, {"u": base}, {"file_contents", "exit_code", "file_set", "stdout"}, {}).collect())
    assert (got["file_contents"], got["exit_code"], got["file_set"], got["stdout"], got["stderr"]) == (
        "UNVERIFIED", "UNVERIFIED", "FAIL", "UNVERIFIED", "NOT_APPLICABLE")
    assert dict(rc.contract({"t": base}, {"t": base}, {"file_contents"}, {"t": ["id"]}, abnormal=True).collect())["exit_code"] == "FAIL"
    assert dict(rc.contract({"t": base}, {"t": base}, {"exit_code"}, {"t": ["id"]}, exit_codes=(0, 4)).collect())["exit_code"] == "FAIL"


def test_streams_and_overall(spark, base):
    out = spark.createDataFrame([(1, "A"), (2, "B")], "line int, value string")
    got = rc.contract({"t": base}, {"t": base}, {"stdout", "stderr", "file_contents"}, {"t": ["id"]}, streams={"stdout": (out, out), "stderr": (out, out.limit(1))})
    assert {k: v for k, v in got.collect() if k in ("stdout", "stderr", "file_contents")} == {"stdout": "PASS", "stderr": "FAIL", "file_contents": "PASS"}
    assert rc.overall(got).first()[0] == "FAIL"
    assert rc.overall(rc.contract({"t": base}, {"t": base}, {"stdout"}, {"t": ["id"]})).first()[0] == "UNVERIFIED"
    assert rc.overall(rc.contract({"t": base}, {"t": base}, {"file_contents"}, {"t": ["id"]})).first()[0] == "PASS"


def test_text_checks(spark):
    df = spark.createDataFrame([("TOTAL: 0042\r\n",), ("none",)], "t string")
    assert [r[0] for r in df.select(rc.regex_check(F.col("t"), r"TOTAL:\s*(\d+)", "42")).collect()] == [True, False]
    assert df.select(rc.normalize_newlines(F.col("t"))).first()[0] == "TOTAL: 0042\n"
    rules = [(r"\d+", "N"), ("N", "M")]
    assert df.select(rc.normalize(F.col("t"), rules), rc.normalization_log(F.col("t"), rules)).first() == ("TOTAL: M\r\n", [1, 1])


# -- graphs ----------------------------------------------------------------------
PROGRAM = """       IDENTIFICATION DIVISION.
       PROGRAM-ID. A.
       PROCEDURE DIVISION USING X.
           MOVE 1 TO WS-I.
       MAIN-PARA.
           PERFORM SUB-PARA UNTIL WS-I > 5
           PERFORM UNTIL WS-EOF = 'Y'
               CALL "B" USING WS-I
           END-PERFORM
           CALL WS-PGM
      *    CALL 'COMMENTED'
           GO TO LAST-PARA.
       SUB-PARA.
           MOVE WS-I TO WS-J WS-K
           COMPUTE WS-T = WS-J * 2
           SUBTRACT WS-T FROM WS-K GIVING WS-L.
       LAST-PARA.
           STOP RUN.
"""


def test_program_graphs(spark):
    p = spark.createDataFrame([("A", PROGRAM), ("B", "       PROCEDURE DIVISION.\n       ONLY.\n           GOBACK.\n"), ("EMPTY", "")], "program string, text string")
    calls = g.call_edges(p)
    assert sorted(tuple(r) for r in calls.collect()) == [("A", "B", "static"), ("A", "WS-PGM", "dynamic")]
    assert sorted(r[0] for r in g.roots(p, calls).collect()) == ["A", "EMPTY"]
    assert [r[0] for r in g.dynamic_callers(calls).collect()] == ["A"]
    flow = sorted(tuple(r)[1:] for r in g.control_flow(p).where("program = 'A'").collect())
    assert flow == sorted([("PROCEDURE", "MAIN-PARA", "FALLTHROUGH"), ("MAIN-PARA", "SUB-PARA", "PERFORM"), ("MAIN-PARA", "B", "CALL"), ("MAIN-PARA", "LAST-PARA", "GOTO"),
                           ("SUB-PARA", "LAST-PARA", "FALLTHROUGH"), ("LAST-PARA", "EXIT", "EXIT")])
    data = sorted(tuple(r)[1:] for r in g.data_flow(p).collect())
    assert data == sorted([("WS-I", "WS-J", "ASSIGNS"), ("WS-I", "WS-K", "ASSIGNS"), ("WS-J", "WS-T", "DERIVES_FROM"), ("WS-T", "WS-L", "DERIVES_FROM"), ("WS-K", "WS-L", "DERIVES_FROM")])
    assert [(r.n, r.paragraph) for r in g.paragraphs(p).where("program = 'A'").collect()] == [(0, "PROCEDURE"), (1, "MAIN-PARA"), (2, "SUB-PARA"), (3, "LAST-PARA")]


def test_program_graphs_of_other_shapes(spark):
    """Ranges, computed jumps, guarded jumps, sums in place, records, arguments, nested conditions."""
    lines = """PROCEDURE DIVISION.
A-PARA.
    PERFORM B-PARA THRU D-PARA
    GO TO B-PARA, C-PARA D-PARA DEPENDING ON WS-N.
B-PARA.
    IF WS-A = 'IF. ADD' GO TO D-PARA.
C-PARA.
    READ IN-FILE INTO WS-REC AT END GO TO D-PARA.
D-PARA.
    IF WS-A > 1
        IF WS-B = 2
            ADD WS-X TO WS-Y
        ELSE
            SUBTRACT 1 FROM WS-Z
        END-IF
        MOVE WS-P TO WS-Q WS-R
    END-IF
    MULTIPLY WS-M BY WS-O.
    DIVIDE WS-D BY WS-E GIVING WS-F REMAINDER WS-G.
    WRITE OUT-REC FROM WS-REC.
    CALL 'SUB' USING BY REFERENCE WS-H WS-I(3)
    GOBACK.""".split("\n")
    p = spark.createDataFrame([("X", "\n".join("       " + x for x in lines))], "program string, text string")
    flow = {tuple(r)[1:] for r in g.control_flow(p).collect()}
    assert flow == {("A-PARA", t, k) for t in ("B-PARA", "C-PARA", "D-PARA") for k in ("PERFORM", "GOTO")} | {
        ("A-PARA", "B-PARA", "FALLTHROUGH"), ("B-PARA", "D-PARA", "GOTO"), ("B-PARA", "C-PARA", "FALLTHROUGH"), ("C-PARA", "D-PARA", "GOTO"),
        ("C-PARA", "D-PARA", "FALLTHROUGH"), ("D-PARA", "SUB", "CALL"), ("D-PARA", "EXIT", "EXIT")}
    data = {tuple(r)[1:] for r in g.data_flow(p).collect()}
    under = {(c, t, "CONDITIONAL_ON") for c in ("WS-A", "WS-B") for t in ("WS-Y", "WS-Z")} | {("WS-A", t, "CONDITIONAL_ON") for t in ("WS-Q", "WS-R")}
    derived = {("WS-X", "WS-Y"), ("WS-Y", "WS-Y"), ("WS-Z", "WS-Z"), ("WS-M", "WS-O"), ("WS-O", "WS-O"), ("WS-D", "WS-F"), ("WS-E", "WS-F"), ("WS-D", "WS-G"), ("WS-E", "WS-G")}
    assert data == under | {(*e, "DERIVES_FROM") for e in derived} | {
        ("WS-P", "WS-Q", "ASSIGNS"), ("WS-P", "WS-R", "ASSIGNS"), ("IN-FILE", "WS-REC", "CONSUMES"), ("WS-REC", "OUT-REC", "ASSIGNS")}
    assert {tuple(r)[1:] for r in g.call_arguments(p).collect()} == {("WS-H", "SUB", "CALLS_WITH"), ("WS-I", "SUB", "CALLS_WITH")}



def test_reach_with_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y"), ("a", "b")], "source string, target string")
    seeds = spark.createDataFrame([("a",)], "node string")
    assert sorted(tuple(r) for r in g.reach(edges, seeds).collect()) == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]


def test_records_of_a_repeated_key_are_paired(spark):
    """Thirty by thirty records of one key: one that changed and one that is gone are two differences."""
    from recordloom.operators.reconcile import compare_paired

    rows = [(1, i // 10, f"n{i}") for i in range(30)] + [(2, 5, "x")] * 30 + [(None, 1, "a")] * 2
    df = spark.createDataFrame(rows, "k int, v int, t string")
    other = spark.createDataFrame([(1, 7, "n4") if r == (1, 0, "n4") else r for r in rows if r != (1, 1, "n12")][:-2] + [(None, 1, "b"), (None, 1, "a"), (3, 1, None)], "k int, v int, t string")
    got = sorted(tuple(r) for r in compare_paired(df, other, ["k"], ["v", "t"]).collect() if r["k"] is not None)
    assert [(k, kind, field, e, a) for k, _, kind, field, e, a in got if kind != "FIELD"] == [(1, "MISSING", "", None, None), (3, "EXTRA", "", None, None)]
    assert [x[3:] for x in got if x[2] == "FIELD"] == [("v", "0", "7")]
    assert [tuple(r)[2:] for r in compare_paired(df, other, ["k"], ["v", "t"]).collect() if r["k"] is None] == [("FIELD", "t", "a", "b")]
    assert compare_paired(df, df.repartition(3), ["k"], ["v", "t"]).count() == 0


# -- jobs ------------------------------------------------------------------------
def test_symbols(spark):
    df = spark.createDataFrame([("DSN=&HLQ..&HLQX.,T=&&TMP,U=&NO.", {"HLQ": "P", "HLQX": "Q"})], "t string, m map<string,string>")
    r = df.select(b.substitute(F.col("t"), F.col("m")).alias("t")).select("t", b.unresolved(F.col("t")).alias("u")).first()
    assert (r.t, r.u) == ("DSN=P.Q,T=&&TMP,U=&NO.", ["NO"])


def test_texts_are_worked_out_once(spark):
    """No pattern is compiled for each text, and nothing that stands in several places is worked out in each."""
    from recordloom.operators.statements import division, statements

    df = spark.createDataFrame([("       PROCEDURE DIVISION.\n       A.\n           MOVE 'X, Y' TO B;\n           CALL \"P\".\n           EXEC SQL A END-EXEC GO TO Z.\n",)], "text string")
    out = df.select(statements(division(F.col("text"))).alias("s"))
    assert out.collect()[0]["s"] == ["A.", "MOVE @ TO B", "CALL @P.", "EXEC", "GO TO Z."]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") == 1 and plan.count("upper(") == 1 and "END-EXEC" in plan
    assert "split(regexp_replace(" in plan
