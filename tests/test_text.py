"""String verbs and conditions against direct Python."""

import pytest
from pyspark.sql import functions as F

from recordloom.functions import text as t
from recordloom.functions.conditions import ANY, condition_name, evaluate, text_eq


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "t string").select(fn(F.col("t"))).first()[0]


def test_string(spark):
    got = spark.createDataFrame([("JOHN DOE", "A,B")], "a string, b string").select(
        t.string_into([(F.col("a"), " "), ("/", None), (F.col("b"), ","), (F.col("b"), F.lit("Z"))], 14)).first()[0]
    assert got == "JOHN/AA,B     "


def sequential_unstring(src, d, n, ptr=1):
    """The verb as it is described, one field at a time."""
    if ptr < 1 or ptr > len(src):
        return [""] * n, 0, ptr, True
    at, out = ptr - 1, []
    while len(out) < n and at <= len(src):
        j = src.find(d, at)
        if j < 0:
            out.append(src[at:])
            at = len(src) + 1
        else:
            out.append(src[at:j])
            at = j + len(d)
    pointer = min(at, len(src)) + 1
    return out + [""] * (n - len(out)), len(out), pointer, at < len(src)


@pytest.mark.parametrize("d", [",", "--", "."])
def test_unstring(spark, d):
    texts = ["a,b,c", "a--b--c", "abc", ",", ",,", "a,", "x.y.z.", "--", "a,b--c.d", "..a"]
    rows = [(s, p) for s in texts for p in range(0, len(s) + 2)]
    u = t.unstring(F.col("s"), d, 2, F.col("p"))
    got = spark.createDataFrame(rows, "s string, p int").select("s", "p", *u.fields, u.tally, u.pointer, u.overflow).collect()
    for s, p, a, b, tally, pointer, overflow in got:
        assert ([a, b], tally, pointer, overflow) == sequential_unstring(s, d, 2, p), (s, p)


def test_inspect(spark):
    assert one(spark, "aXaXa", lambda c: t.tally_all(c, "aX")) == 2
    assert one(spark, "ababc", lambda c: t.tally_leading(c, "ab")) == 2
    assert one(spark, "abc", lambda c: t.tally_leading(c, "x")) == 0
    assert one(spark, "a.a.a", lambda c: t.replace_first(c, ".", "$1")) == "a$1a.a"
    assert one(spark, "0012", lambda c: t.replace_leading(c, "0", "*")) == "**12"
    assert one(spark, "abc", lambda c: t.replace_characters(c, "#")) == "###"
    assert one(spark, "abcabc", lambda c: t.converting(c, "abc", "XY")) == "XYcXYc"
    assert one(spark, "a b", lambda c: t.inspect_replacing(c, [("ALL", " ", "-"), ("FIRST", "-", "+")])) == "a+b"
    assert one(spark, "abc", lambda c: t.tally_all(c, "")) == 0


def test_refmod_and_figuratives(spark):
    assert one(spark, "ABCDEF", lambda c: t.refmod(c, 2, 3)) == "BCD"
    assert one(spark, "ABCDEF", lambda c: t.refmod(c, 4)) == "DEF"
    assert one(spark, "", lambda c: F.concat(t.figurative("SPACES", 2), t.figurative("ZEROS", 2), c)) == "  00"


def test_conditions(spark):
    df = spark.createDataFrame([("A  ", 5), ("B", 15), ("C", 25)], "s string, n int")
    got = df.select(text_eq(F.col("s"), "A"), condition_name(F.col("s"), ["A", ("B", "C")]), condition_name(F.col("n"), [(10, 20), 25]),
                    evaluate([((0, 9), ANY, "low"), (ANY, "B", "b")], F.lit("x"), (F.col("n"), F.col("s")))).collect()
    assert [tuple(r) for r in got] == [(True, True, False, "low"), (False, True, True, "b"), (False, True, True, "x")]


def test_latin1(spark):
    assert one(spark, "é", lambda c: F.hex(t.latin1(c))) == "E9"
    assert one(spark, "é", lambda c: t.from_latin1(t.latin1(c))) == "é"
