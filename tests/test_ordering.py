"""Numbering and running values, with a hot key."""

import random

import pytest
from pyspark.sql import functions as F

from recordloom.functions.numeric import num
from recordloom.operators import report as rp
from recordloom.operators import sorting as so
from recordloom.operators.counters import accumulate, totals
from recordloom.operators.ordering import number_rows, scan_by_key


def test_number_rows_with_one_heavy_value(spark):
    rnd = random.Random(1)
    rows = [("hot" if rnd.random() < 0.5 else f"k{rnd.randrange(50)}", i, rnd.randrange(100)) for i in range(5000)]
    df = spark.createDataFrame(rows, "k string, i int, v int").repartition(7)
    out = number_rows(df, [F.col("k").desc(), F.col("i").asc()], "rn", {"run": F.col("v")}, total="n", partitions=9)
    got = sorted((r.rn, r.k, r.i, r.run, r.n) for r in out.collect())
    want, run = [], 0
    for n, (key, i, v) in enumerate(sorted(sorted(rows, key=lambda r: r[1]), key=lambda r: r[0], reverse=True), 1):
        run += v
        want.append((n, key, i, run, len(rows)))
    assert got == want


@pytest.mark.parametrize("block", [1, 7, 64, 10000])
def test_scan_by_key(spark, block):
    rnd = random.Random(block)
    rows = [(None if rnd.random() < 0.05 else ("hot" if rnd.random() < 0.4 else f"k{rnd.randrange(9)}"), i, rnd.choice([None, rnd.randrange(9)])) for i in range(800)]
    df = spark.createDataFrame(rows, "k string, s int, v int").repartition(5)
    got = {r.s: (r.last, r.sum) for r in scan_by_key(df, ["k"], "s", {"last": F.col("v")}, {"sum": F.col("v")}, block_rows=block).collect()}
    want, last, total = {}, {}, {}
    for key, s, v in rows:
        want[s] = (last.get(key), total.get(key))
        if v is not None:
            last[key], total[key] = v, total.get(key, 0) + v
    assert got == want


def test_scan_starts_from_given_values(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 9, None), ("b", 2, None)], "k string, s int, v int")
    given = spark.createDataFrame([("a", 70), ("b", 80)], "k string, last int")
    got = {r.s: r.last for r in scan_by_key(df, ["k"], "s", {"last": F.col("v")}, initial=given, block_rows=4).collect()}
    assert got == {1: 70, 9: 5, 2: 80}


def test_sort_is_stable_and_merge_keeps_file_order(spark):
    a = spark.createDataFrame([(1, "Alice", 30), (2, "Bob", 25), (3, "Charlie", 35)], "n int, name string, age int")
    assert [r.name for r in so.sort_records([a], [("age", "ASCENDING")], "n").collect()] == ["Bob", "Alice", "Charlie"]
    b = spark.createDataFrame([(1, "Dan", 25), (2, "Eve", 40)], "n int, name string, age int")
    assert [r.name for r in so.merge_records([a, b], [("age", "A")], "n").collect()] == ["Bob", "Dan", "Alice", "Charlie", "Eve"]
    pos = {r.name: r.position for r in so.positions([a, b], [("age", "D")], "n").collect()}
    assert pos == {"Eve": 1, "Charlie": 2, "Alice": 3, "Bob": 4, "Dan": 5}


def test_utility_sort(spark):
    df = spark.createDataFrame([("b2x",), ("a1y",), ("a2",), ("a",), ("b1",)], "value string")
    assert [r[0] for r in so.utility_sort(df, " SORT FIELDS=(2,1,CH,D,1,1,CH,A)").collect()] == ["a2", "b2x", "a1y", "b1", "a"]


REPORT = rp.Report(
    heading=rp.Group((rp.Item(1, "X(10)", value="SALARIES"), rp.Item(12, "Z9", source=rp.PAGE_COUNTER))),
    detail=rp.Group((rp.Item(3, "X(4)", source="name"), rp.Item(8, "ZZZZ9", source="pay"), rp.Item(14, "Z(6)9", sum="pay"))),
    footing=rp.Group((rp.Item(1, "X(4)", value="SUM"), rp.Item(6, "Z(6)9", sum="pay")), plus=2),
    source_pics={"name": "X(4)", "pay": "9(5)"})


def step_by_step(rows):
    """INITIATE, GENERATE for each row, TERMINATE."""
    out, page, line, total = [], 1, 1, 0

    def heading():
        out.append((page, f"{'SALARIES':<10} {page:>2}"))

    heading()
    line += 1
    for name, pay in rows:
        if line > 5:
            out.append((page, ""))
            out.append((page, f"SUM  {total:>7}"))
            page, line = page + 1, 1
            heading()
            line += 1
        out.append((page, f"  {name:<4} {pay:>5} {total:>7}"))
        line += 1
        total += pay
    out.append((page, ""))
    out.append((page, f"SUM  {total:>7}"))
    return out


@pytest.mark.parametrize("n", [1, 4, 5, 8, 23])
def test_report(spark, n):
    rows = [(f"N{i}", 100 + i) for i in range(n)]
    df = spark.createDataFrame(list(reversed(rows)), "name string, pay int")
    got = sorted((r.line, r.page, r.text) for r in rp.generate(df, REPORT, [F.col("pay").asc()]).collect())
    assert [(p, t) for _, p, t in got] == step_by_step(rows)
    assert [x[0] for x in got] == list(range(1, len(got) + 1))


def test_report_totals(spark):
    df = spark.createDataFrame([(100,), (250,)], "pay int")
    assert tuple(rp.total(df, {"pay": "9(5)"}).first()) == (350, 2)


def test_counters(spark):
    df = spark.createDataFrame([(60, 5), (70, -3), (80, 4)], "a int, b int")
    a, b = num("a", "9(3)"), num("b", "S9(3)")
    got = df.agg(*accumulate(a, "9(2)", "short"), *accumulate(a, "9(5)", "long"), *accumulate(b, "S9(3)", "both")).first()
    want, total = 0, 0
    for v in (60, 70, 80):
        want = (want + v) % 100
    assert (got.short, got.short_wrapped, got.long, got.both) == (want, True, 210, 6)
    assert tuple(totals(df, {"n": F.col("a") > 65}, {"t": (a, "9(5)")}).first()) == (2, 210)
    with pytest.raises(Exception, match="depends on record order"):
        df.agg(*accumulate(b, "S9", "tiny")).collect()


def test_scan_with_sparse_numbers_and_a_hot_key(spark):
    """Numbers far apart make no more blocks than rows ask for."""
    from recordloom.operators.ordering import scan_by_key

    rows = [("hot", i * 1_000_003, i % 7) for i in range(900)] + [(f"k{i}", i, i) for i in range(100)]
    df = spark.createDataFrame(rows, "k string, seq bigint, v int")
    got = {(r.k, r.seq): (r.before, r.last) for r in scan_by_key(df, ["k"], "seq", last={"last": F.when(F.col("v") == 3, F.col("seq"))}, sums={"before": F.col("v")}, block_rows=50).collect()}
    total, last = None, None
    for k, seq, v in rows[:900]:
        assert got[k, seq] == (total, last)
        total, last = (total or 0) + v, seq if v == 3 else last
    assert all(got[k, s] == (None, None) for k, s, _ in rows[900:])


def test_blocks_are_bounded_in_rows(spark):
    """A key with nine tenths of the rows and one number far from all others."""
    from recordloom.operators.ordering import blocks_of, scan_by_key

    rows = [("hot", 10**15 + i, i % 5) for i in range(18_000)] + [("hot", 0, 7)] + [(f"k{i % 40}", i, 1) for i in range(2_000)]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "k string, seq bigint, v int").repartition(6)
    sizes = [r["count"] for r in blocks_of(df.where("k = 'hot'"), "k", "seq", 18).groupBy("k", "_block").count().collect()]
    assert sum(sizes) == 18_001 and max(sizes) <= 3_000
    got = {(r.k, r.seq): r.run for r in scan_by_key(df, ["k"], "seq", sums={"run": F.col("v")}, block_rows=1_000).collect()}
    run: dict = {}
    for k, seq, v in sorted(rows):
        assert got[k, seq] == run.get(k)
        run[k] = run.get(k, 0) + v


def fold(values, digits, signed, scale_in, scale):
    """ADD value TO counter, one after another; values and result in units of scale_in."""
    unit, limit, t = 10 ** (scale_in - scale), 10 ** (digits - scale + scale_in), 0
    for x in values:
        s = t + x
        a = (abs(s) - abs(s) % unit) % limit
        t = -a if s < 0 and signed else a
    return t


@pytest.mark.parametrize(("pic", "digits", "signed", "scale"), [("S9(3)", 3, True, 0), ("9(3)", 3, False, 0), ("S9(2)V9", 3, True, 1), ("9(2)V9", 3, False, 1), ("S9(20)", 20, True, 0)])
def test_counters_in_order(spark, pic, digits, signed, scale):
    """Signed counters that overflow, and unsigned ones that turn, equal the fold row by row."""
    from decimal import Decimal

    from recordloom.operators.counters import in_order

    r = random.Random(digits)
    big = 10 ** (digits + 1)
    rows = [(r.choice(["hot", "hot", "hot", "a", "b", None]), i, r.choice([r.randrange(-300, 300), r.randrange(-big, big), r.randrange(-30, 31)])) for i in range(900)]
    df = spark.createDataFrame([(k, i, Decimal(v).scaleb(-2)) for k, i, v in rows], "k string, seq int, x decimal(26,2)").repartition(4)
    out = in_order(df, ["k"], "seq", {"t": (num("x", "S9(24)V99"), pic)}, partitions=5)
    got = {x["k"]: x["t"] for x in out.collect()}
    want = {k: Decimal(fold([v for a, _, v in rows if a == k], digits, signed, 2, scale)).scaleb(-2) for k in {x[0] for x in rows}}
    assert got == want
    assert in_order(df.limit(0), [], "seq", {"t": (num("x", "S9(24)V99"), pic)}).collect()[0]["t"] == 0


@pytest.mark.parametrize(("pic", "digits", "signed", "scale"), [("9(3)V9", 4, False, 1), ("S9(3)V9", 4, True, 1), ("S9(5)V99", 7, True, 2)])
def test_counters_of_many_rows(spark, pic, digits, signed, scale):
    """What many rows do to a counter stays short, whatever it held; what they come to equals the fold."""
    from decimal import Decimal

    from recordloom.operators.counters import Run, applied, in_order

    r = random.Random(digits)
    unit, limit = 10 ** (2 - scale), 10 ** (digits - scale + 2)
    amounts = [r.randrange(-limit, 2 * limit) for _ in range(20_000)]
    run = Run(limit, unit, signed)
    for i in range(0, len(amounts), 7_000):
        run.add(amounts[i : i + 7_000])
    told = run.told()
    assert sum(len(x) for x in told) < 30_000
    for v in (0, unit, 37 * unit, limit - unit):
        want = v
        for x in amounts:
            size = abs(want + x) // unit * unit % limit
            want = -size if signed and want + x < 0 else size
        assert applied(told, v) == want
    df = spark.createDataFrame([(i, Decimal(x).scaleb(-2)) for i, x in enumerate(amounts)], "seq int, x decimal(12,2)")
    out = in_order(df, [], "seq", {"t": (num("x", "S9(10)V99"), pic)}, partitions=3).collect()
    assert [x["t"] for x in out] == [Decimal(fold(amounts, digits, signed, 2, scale)).scaleb(-2)]


def test_counters_of_keys_that_begin_in_a_task(monkeypatch):
    """Only the first key of a task can have begun before it; the others' values are known, and told as one number."""
    import pyarrow as pa

    from recordloom.operators import counters as c

    class Context:
        @staticmethod
        def get():
            return type("Task", (), {"partitionId": staticmethod(lambda: 3)})

    monkeypatch.setattr(c, "TaskContext", Context)
    rows = [(k, x) for k in range(400) for x in (900, -250, None, 470)]
    batch = pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows]), pa.array([x for _, x in rows])], names=["k", "x"])
    told = pa.Table.from_batches(list(c._effects(1, [(1_000, 1, True, 0)])(iter([batch])))).to_pylist()
    assert [x["k"] for x in told] == list(range(400)) and {x["_part"] for x in told} == {3}
    assert len(told[0]["_e0"]) == 3 and all(x["_e0"] == [["120"]] for x in told[1:])
