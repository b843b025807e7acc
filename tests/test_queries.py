"""Every registered query beside its SQL, and the shape of its plan."""

import pytest

import __spark_entry__ as entry
from recordloom.plans import load
from tests.oracle import DATA, compare, connect

SF = f"{DATA}/sf0.001"
QUERIES, ORACLE = load()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def executed(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    plan = executed(df)
    for node in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "CartesianProduct"):
        assert node not in plan, node
    if name in ORACLE:
        assert compare(df, con, ORACLE[name]) == []
    else:
        assert df.count() > 0


def test_write_with_unique_alternate_against_a_loop(spark):
    """Replayed one request at a time."""
    from recordloom.plans.keyed_sets import keyed_write_unique_alternate  # noqa: F401

    out = sorted(QUERIES["keyed_write_unique_alternate"](spark, SF).collect(), key=lambda r: r["seq"])
    con = connect(SF)
    master = con.sql("""SELECT min(id) AS id, alt FROM (SELECT CASE WHEN c_custkey % 5 = 0 THEN c_custkey ELSE -1 - c_custkey END AS id, CAST(abs(c_acctbal) AS DECIMAL(9,2)) AS alt FROM customer) GROUP BY alt""").fetchall()
    ids, alts = {m[0] for m in master}, {m[1] for m in master}
    for r in out:
        free = r["id"] not in ids and r["alt"] not in alts
        assert r["status"] == ("00" if free else "22")
        if free:
            ids.add(r["id"])
            alts.add(r["alt"])


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_scan_reads_only_needed_columns(spark):
    plan = executed(QUERIES["sql_inner_join"](spark, SF))
    assert "PushedFilters: [IsNotNull(c_mktsegment), EqualTo(c_mktsegment,BUILDING)" in plan
    assert "o_orderpriority" not in plan and "c_acctbal" not in plan
    assert "o_totalprice" not in executed(QUERIES["keyed_lookup_status"](spark, SF))
