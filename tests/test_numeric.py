"""Storage arithmetic against hand-worked values and Python decimals."""

import random
from decimal import ROUND_DOWN, ROUND_HALF_UP, Decimal as D, localcontext

import pytest
from pyspark.sql import functions as F

from recordloom.functions import numeric as n
from recordloom.functions.codecs import encode_packed, encode_zoned
from recordloom.functions.numeric import as_num, divide_into, divide_remainder, num, store
from recordloom.layout import copybook
from recordloom.operators.moves import move
from recordloom.picture import PictureError, picture


def value(spark, *cols):
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()
    return row[0] if len(cols) == 1 else tuple(row)


def lit(text, pic):
    return num(F.lit(D(text)), pic)


def test_integer_statements(spark):
    a, b = lit("15", "9(4)"), lit("25", "9(4)")
    assert value(spark, store(a + b, "9(4)").value, store(b - a, "9(4)").value, store(a * b, "9(4)").value) == (D(40), D(10), D(375))
    a, b = lit("-15", "S9(4)"), lit("25", "S9(4)")
    got = [store(a + b, "S9(4)"), store(a - b, "S9(4)"), store(a * b, "S9(4)")]
    assert value(spark, *[g.value for g in got]) == (D(10), D(-40), D(-375))
    assert value(spark, encode_zoned(got[1].value, "S9(4)")) == "004p"


def test_implied_decimals_and_division(spark):
    assert value(spark, store("45.67", "9(4)V99").value) == D("45.67")
    assert value(spark, divide_into(lit("10.00", "9(4)V99"), lit("3.00", "9(4)V99"), "9(4)V99").value) == D("3.33")
    assert value(spark, divide_into(1, 3, "V9(2)").value, divide_into(10, 3, "9(2)V9(9)").value, divide_into(1, 3, "9(2)V9(20)").value) == (
        D("0.33"), D("3.333333333"), D("0." + "3" * 20))


def test_rounding(spark):
    a = lit("1.236", "9(4)V999")
    assert value(spark, store(a, "9(4)V99", rounding=n.NEAREST_AWAY).value, store(a, "9(4)V99").value) == (D("1.24"), D("1.23"))
    loaded = num(store("-1.235", "S9(4)V99").value, "S9(4)V99")
    assert value(spark, store(loaded, "S9(4)V99", rounding=n.NEAREST_AWAY).value) == D("-1.23")


def test_overflow_keeps_the_old_value(spark):
    up = store(lit("99", "9(2)") + 5, "9(2)", old=F.lit(10), on_size_error=True)
    down = store(lit("-99", "S9(2)") - 5, "S9(2)", old=F.lit(-10), on_size_error=True)
    assert value(spark, up.value, up.size_error, down.value, down.size_error) == (D(10), True, D(-10), True)
    assert value(spark, store(lit("99", "9(2)") + 5, "9(2)").value) == D(4)
    # the fraction survives high-order truncation
    assert value(spark, store("12345.67", "9(3)V99").value) == D("345.67")


def test_zero_divisor(spark):
    zero = lit("0", "9(4)")
    with_clause = divide_into(10, zero, "9(4)", old=F.lit(5), on_size_error=True)
    without = divide_into(10, zero, "9(4)", old=F.lit(5))
    assert value(spark, with_clause.value, with_clause.size_error, without.value) == (D(5), True, D(5))


def test_receivers_and_remainder(spark):
    amount = num(store("1.236", "9(4)V99").value, "9(4)V99")
    got = n.add_to({"b": (lit("0", "9(4)V9"), "9(4)V9"), "c": (lit("0", "9(4)V99"), "9(4)V99")}, amount)
    assert value(spark, got["b"], got["c"]) == (D("1.2"), D("1.23"))
    q, r = divide_remainder(lit("10", "9(4)"), lit("3", "9(4)"), "9(4)", "9(4)")
    assert value(spark, q.value, r.value) == (D(3), D(1))


def test_compute_and_signs(spark):
    assert value(spark, store(lit("12.34", "9(4)V99") * lit("5.678", "9(4)V999") + "1.2", "9(4)V9").value) == D("71.2")
    a = lit("10", "S9(4)")
    assert value(spark, store(a - 1, "S9(4)").value, store(a - -1, "S9(4)").value) == (D(9), D(11))
    assert value(spark, store(D(-5), "9(3)").value) == D(5)


def test_display(spark):
    assert value(spark, n.display_text(F.lit(D(42)), "9(5)"), n.display_text(F.lit(D("-12.34")), "S9(4)V99"),
                 F.concat(n.display_text(F.lit(1234), "9(4)"), n.display_text(F.lit(5678), "9(4)"))) == ("00042", "-0012.34", "12345678")


def test_packed_and_redefined_bytes(spark):
    assert value(spark, F.hex(encode_packed(F.lit(D("-12.34")), "S9(4)V99")), F.hex(encode_packed(F.lit(D("12.34")), "9(4)V99"))) == ("0001234D", "0001234F")
    lay = copybook("01 G. 05 A PIC X(4). 05 B REDEFINES A PIC 9(4).")
    df = spark.createDataFrame([("1234",)], "a string")
    assert lay.decode(lay.encode(df)).first().asDict() == {"a": "1234", "b": D(1234)}


def test_truncation_chain(spark):
    """Each stored result is what the next statement reads."""
    gross = lit("1293.24", "9(5)V99")
    tax = num(store(gross * "0.20", "9(5)V99").value, "9(5)V99")
    assert value(spark, tax.col, store(gross - tax, "9(5)V99").value) == (D("258.64"), D("1034.60"))


def test_mod_follows_the_divisor_sign(spark):
    pairs = [(7, 3), (-7, 3), (7, -3), (-7, -3), (6, 3)]
    got = value(spark, *[n.function_mod(a, b).col for a, b in pairs])
    assert got == tuple(D(a - b * (a // b)) for a, b in pairs)


def test_numval(spark):
    texts = ["  12.5 ", "-3", "3-", "$1,234.50", "7.25CR", "7DB", "+4", "abc", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(n.numval(F.col("t")).col).collect()]
    assert got == [D("12.50"), D(-3), D(-3), D("1234.50"), D("-7.25"), D(-7), D(4), D(0), D(0)]


def test_power():
    with pytest.raises(ValueError):
        as_num(2) ** 0.5
    with pytest.raises(n.PrecisionError):
        num(F.lit(1), "9(18)") ** 3


@pytest.mark.parametrize("pa,pb,pt", [("S9(7)V99", "S9(3)V9", "S9(6)V99"), ("S9(14)V99", "S9(12)V9(4)", "S9(10)V9(6)"), ("S9(3)", "S9(3)V99", "S9V9(15)")])
def test_division_is_exact(spark, pa, pb, pt):
    rnd = random.Random(pa)
    A, B, T = picture(pa), picture(pb), picture(pt)
    draw = lambda p: D(rnd.randint(-(10 ** p.digits) + 1, 10 ** p.digits - 1)).scaleb(-p.scale)
    rows = [(draw(A), draw(B)) for _ in range(400)] + [(D(1), D(1)), (D(-1), D(3)), (D(5), D(0))]
    df = spark.createDataFrame(rows, f"a {A.sql_type}, b {B.sql_type}")
    a, b = num("a", pa), num("b", pb)
    got = df.select("a", "b", n.divide(a, b, T.scale).col, n.divide(a, b, T.scale, n.NEAREST_AWAY).col, store(n.divide(a, b, T.scale), pt).value).collect()
    import decimal

    with decimal.localcontext() as ctx:
        ctx.prec = 80
        for x, y, cut, rounded, stored in got:
            if y == 0:
                assert cut is None and rounded is None
                continue
            q = x / y
            ulp = D(1).scaleb(-T.scale)
            num_, den = int(abs(x).scaleb(T.scale + 30)), int(abs(y).scaleb(30))
            exact = D(num_ // den).scaleb(-T.scale) * (1 if q >= 0 else -1)
            assert cut == exact, (x, y)
            half = D((2 * num_ + den) // (2 * den)).scaleb(-T.scale) * (1 if q >= 0 else -1)
            assert rounded == half, (x, y)
            limit = D(10) ** T.int_digits
            assert stored == (abs(exact) % limit) * (1 if exact >= 0 else -1)
            assert ulp


def test_modes_against_decimals(spark):
    import decimal

    modes = {n.TRUNCATION: ROUND_DOWN, n.NEAREST_AWAY: ROUND_HALF_UP, n.NEAREST_EVEN: decimal.ROUND_HALF_EVEN,
             n.NEAREST_TOWARD: decimal.ROUND_HALF_DOWN, n.TOWARD_GREATER: decimal.ROUND_CEILING,
             n.TOWARD_LESSER: decimal.ROUND_FLOOR, n.AWAY: decimal.ROUND_UP}
    rows = [(D(i).scaleb(-3),) for i in range(-2025, 2026, 5)]
    df = spark.createDataFrame(rows, "v decimal(9,3)")
    for mode, py in modes.items():
        got = df.select("v", store(num("v", "S9(6)V999"), "S9(6)V99", rounding=mode).value).collect()
        for v, g in got:
            assert g == v.quantize(D("0.01"), rounding=py), (mode, v)
    s = store(num("v", "S9(6)V999"), "S9(6)V99", old=F.lit(0), rounding=n.PROHIBITED, on_size_error=True)
    for v, e in df.select("v", s.size_error).collect():
        assert e == (v != v.quantize(D("0.01"), rounding=ROUND_DOWN))


def test_moves(spark):
    assert value(spark, move(F.lit("AB"), "X(4)", "X(2)"), move(F.lit("AB"), "X(2)", "X(4)"), move(F.lit(D("12.5")), "9(3)V9", "X(6)"),
                 move(F.lit(" 42 "), "X(4)", "9(3)"), move(F.lit(D("1234.56")), "9(4)V99", "ZZ,ZZ9.9"), move(F.lit(D("-3.99")), "S9V99", "9")) == (
        "AB", "AB  ", "0125  ", D(42), " 1,234.6", D(3))


def test_pictures():
    p = picture("S9(4)V9(2)")
    assert (p.digits, p.scale, p.signed, p.width) == (6, 2, True, 6)
    assert picture("ZZ,ZZ9.99CR").kind == "edited" and picture("X(3)9").kind == "alnum"
    with pytest.raises(PictureError):
        picture("9(3)Q")


def test_wide_quotients_keep_their_digits(spark):
    """A quotient in an expression is the same however wide its operands' pictures are, or it is refused."""
    pairs = [(D(10), D(3)), (D(-1), D(7)), (D("99999999999.999999999999"), D(999999999)), (D("0.000000000001"), D(999999999)), (D(0), D(3)), (D(5), D(0))]
    df = spark.createDataFrame(pairs, "a decimal(38,12), b decimal(38,0)")
    with localcontext() as c:
        c.prec = 60
        want = [None if not y else (x / y).quantize(D(1).scaleb(-20), "ROUND_DOWN") for x, y in pairs]
    for left, right in (("S9(12)V9(12)", "S9(9)"), ("S9(16)V9(12)", "S9(9)"), ("S9(18)V9(12)", "S9(11)"), ("S9(12)V9(12)", "S9(17)")):
        q = n.num("a", left) / n.num("b", right)
        assert [r[0] for r in df.select(q.col).collect()] == want, (left, right)
    assert q.scale == n.QUOTIENT_SCALE
    twice = n.num("a", "S9(16)V9(12)") / n.num("b", "S9(9)") * 3
    assert [r[0] for r in df.select(twice.col).collect()] == [None if w is None else w * 3 for w in want]
    for left, right in (("S9(19)V9(9)", "S9(9)"), ("S9(16)V9(12)", "S9(9)V9(3)"), ("S9(12)V9(18)", "S9(13)")):
        with pytest.raises(n.PrecisionError):
            n.num("a", left) / n.num("b", right)
    with pytest.raises(n.PrecisionError):
        n.num("a", "S9(16)V9(12)") / n.num("b", "S9(9)") * 1_000_000
