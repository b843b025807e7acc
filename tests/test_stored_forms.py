"""Codecs, layouts and edited pictures."""

import random
import struct
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from recordloom.functions import codecs as c
from recordloom.functions.edited import edit
from recordloom.functions.numeric import num
from recordloom.layout import LayoutError, copybook
from recordloom.picture import picture


@pytest.mark.parametrize("pic", ["S9(4)V99", "9(5)", "S9(18)", "SV9(4)", "S9(9)V9(9)", "9", "S9(17)V9"])
def test_decode_undoes_encode(spark, pic):
    p = picture(pic)
    rnd = random.Random(pic)
    top = 10 ** p.digits - 1
    whole = [w for w in (0, 1, top, 10, 9) if w <= top] + [rnd.randint(0, top) for _ in range(100)]
    if p.signed:
        whole += [-w for w in whole]
    df = spark.createDataFrame([(D(w).scaleb(-p.scale),) for w in whole], f"v {p.sql_type}")
    v = F.col("v")
    out = {"packed": c.decode_packed(c.encode_packed(v, p), p)}
    for lead in (False, True):
        for sep in (False, True):
            out[f"z{lead}{sep}"] = c.decode_zoned(c.encode_zoned(v, p, lead, sep), p, lead, sep)
    if p.digits <= 18:
        out["binary"] = c.decode_binary(c.encode_binary(v, p), p)
    for row in df.select("v", *[e.alias(k) for k, e in out.items()]).collect():
        for k in out:
            assert row[k] == row["v"], (pic, k, row)


def test_sign_nibbles_and_bad_bytes(spark):
    df = spark.createDataFrame([(bytearray.fromhex(h),) for h in ("123C", "123D", "123B", "123A", "123F", "1A3C")], "b binary")
    assert [r[0] for r in df.select(c.decode_packed(F.col("b"), "S999")).collect()] == [123, -123, -123, 123, 123, None]


def test_overpunch_and_blanks(spark):
    df = spark.createDataFrame([("12s",), ("   ",), ("123",), ("1x3",)], "t string")
    assert [r[0] for r in df.select(c.decode_zoned(F.col("t"), "S999")).collect()] == [-123, 0, 123, None]


def test_floating(spark):
    xs = [0.0, 1.5, -2.75, 3.14159, 1e-40, -1e30, 12345.678]
    df = spark.createDataFrame([(i, bytearray(struct.pack(">f", x)), bytearray(struct.pack(">d", x))) for i, x in enumerate(xs)], "i int, f binary, d binary")
    for i, f, d in df.select("i", c.decode_float(F.col("f"), 4), c.decode_float(F.col("d"), 8)).collect():
        assert d == xs[i] and f == struct.unpack(">f", struct.pack(">f", xs[i]))[0]


# hand-worked, floating symbols included
EDITED = {
    "$$$,$$9.99": {"1234.56": " $1,234.56", "-345.67": "   $345.67", "0": "     $0.00", "98765.43": "$98,765.43"},
    "++++,++9.99": {"1234.56": "  +1,234.56", "-5": "      -5.00"},
    "----,--9.99": {"1234.56": "   1,234.56", "-345.67": "    -345.67"},
    "ZZ,ZZ9.99": {"1234.56": " 1,234.56", "0.05": "     0.05", "345.67": "   345.67"},
    "**,**9.99": {"1234.56": "*1,234.56", "345.67": "***345.67"},
    "ZZ,ZZ9.99CR": {"-1234.56": " 1,234.56CR", "1234.56": " 1,234.56  "},
    "ZZ,ZZ9.99DB": {"-1234.56": " 1,234.56DB", "0": "     0.00  "},
    "ZZ9.99": {"12345.67": "345.67", "7": "  7.00"},
    "$ZZ9.99": {"7": "$  7.00"},
    "+ZZ9": {"7": "+  7", "-7": "-  7"},
    "ZZ9-": {"7": "  7 ", "-7": "  7-"},
    "ZZZ.ZZ": {"0": "      ", "0.05": "   .05"},
    "***.**": {"0": "***.**"},
    "99/99": {"1234": "12/34"},
    "ZB9": {"5": "  5", "12": "1 2"},
}


@pytest.mark.parametrize("pic", EDITED)
def test_edited(spark, pic):
    cases = EDITED[pic]
    df = spark.createDataFrame([(k, D(k)) for k in cases], "k string, v decimal(12,3)")
    assert dict(df.select("k", edit(num("v", "S9(9)V999"), pic)).collect()) == cases


def test_rounding_of_edited_items(spark):
    df = spark.createDataFrame([(D("1.236"),)], "v decimal(12,3)")
    assert tuple(df.select(edit(num("v", "S9(9)V999"), "Z9.99"), edit(num("v", "S9(9)V999"), "Z9.99", rounded=False)).first()) == (" 1.24", " 1.23")


BOOK = """
000100* A COMMENT LINE
000200 01  REC.
000300     05  ID        PIC X(5).
           05  AMT       PIC S9(5)V99 USAGE IS COMP-3.
           05  AMT-X REDEFINES AMT PIC X(4).
           05  N         PIC 9(1).
           05  TAB OCCURS 1 TO 3 TIMES DEPENDING ON N.
              10 K PIC 9(2).
              10 S PIC S9(3) SIGN IS TRAILING SEPARATE CHARACTER.
           05  ST        PIC X VALUE 'A'.
              88 ACTIVE VALUE 'A' 'B'.
              88 LATE VALUES ARE 'C' THRU 'F', 'X'.
           05  CNT PIC 9(4) COMP.
              88 MANY VALUE 10 THRU 9999.
           05  FILLER PIC X(3).
       78  MAX-ROWS VALUE 250.
"""


@pytest.mark.parametrize("binary", [True, False])
def test_layout(spark, binary):
    lay = copybook(BOOK)
    assert lay.length == 5 + 4 + 1 + 18 + 1 + 4 + 3 and lay.constants == {"MAX-ROWS": "250"}
    assert [(f.name, f.offset) for f in lay.fields] == [("ID", 0), ("AMT", 5), ("AMT-X", 5), ("N", 9), ("TAB", 10), ("ST", 28), ("CNT", 29), ("FILLER", 33)]
    df = spark.createDataFrame([("AB", D("-12.34"), 2, [(1, D(-5)), (2, D(7)), (3, D(9))], "A", 12), ("Ü", D("1"), 0, [], "D", 3)],
                               "id string, amt decimal(7,2), n int, tab array<struct<k:int,s:decimal(3,0)>>, st string, cnt int")
    raw = lay.encode(df, binary=binary)
    out = lay.decode(raw)
    a, b = out.select("*", lay.condition("ACTIVE").alias("act"), lay.condition("LATE").alias("late"), lay.condition("MANY").alias("many")).collect()
    assert (a.id, a.amt, a.n, [tuple(x) for x in a.tab], a.cnt, a.act, a.late, a.many) == ("AB", D("-12.34"), 2, [(1, -5), (2, 7)], 12, True, False, True)
    assert (b.id, b.amt, b.tab, b.act, b.late, b.many) == ("Ü", D("1.00"), [], False, True, False)
    assert out.schema["tab"].dataType.simpleString() == "array<struct<k:decimal(2,0),s:decimal(3,0)>>"
    assert lay.schema()["amt"].metadata["offset"] == 5


def test_binary_storage(spark):
    lay = copybook("01 R. 05 A PIC S9(4) COMP. 05 B PIC 9(9) BINARY. 05 C PIC S9(9)V99 COMP.", binary_storage=True)
    assert lay.length == 2 + 4 + 8
    df = spark.createDataFrame([(-5, 123456789, D("-1.25"))], "a int, b int, c decimal(11,2)")
    assert tuple(lay.decode(lay.encode(df, binary=True)).first()) == (D(-5), D(123456789), D("-1.25"))


def test_short_lines(spark):
    lay = copybook("01 R. 05 A PIC X(4). 05 N PIC 9(3). 05 B PIC X(2).")
    df = spark.createDataFrame([("AB",), ("ABCD12",), ("",)], "value string")
    assert [tuple(r) for r in lay.decode(df).collect()] == [("AB", 0, ""), ("ABCD", 12, ""), ("", 0, "")]


def test_refused_descriptions():
    for text in ("01 R. 66 X RENAMES Y.", "01 R. 05 P USAGE POINTER.", "01 R. 05 A REDEFINES B PIC X.", "01 R. 05 A."):
        with pytest.raises(LayoutError):
            copybook(text)


def test_decode_reads_only_what_is_asked(spark):
    lay = copybook(BOOK)
    df = spark.createDataFrame([(bytearray(lay.length),)], "value binary")
    plan = lay.decode(df).select("id")._jdf.queryExecution().optimizedPlan().toString()
    assert "hex" not in plan and "sequence" not in plan
