"""Stored forms of numbers: zoned, packed, binary and floating."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from recordloom.functions.numeric import dec, digits_text, pow10
from recordloom.picture import Picture, picture

# trailing (or leading) digit of a negative zoned item: fixed values
PLAIN_DIGITS = "0123456789"
MINUS_DIGITS = "pqrstuvwxy"


def _pic(p: str | Picture) -> Picture:
    return picture(p) if isinstance(p, str) else p


def _scaled(whole: Column, digits: int, p: Picture) -> Column:
    """A whole number of ``digits`` digits, with the implied point put in."""
    return dec(whole * pow10(-p.scale), p.digits, p.scale) if p.scale else dec(whole, p.digits, 0)


# -- zoned -------------------------------------------------------------------
def decode_zoned(text: Column, pic: str | Picture, leading: bool = False, separate: bool = False) -> Column:
    """DISPLAY digits with an overpunched or separate sign; blanks are zero.

    Anything else than digits and, in signed items, the sign is null.
    """
    p = _pic(pic)
    n = p.digits
    negative = F.lit(False)
    body = text
    if p.signed and separate:
        sign = text.substr(1, 1) if leading else text.substr(n + 1, 1)
        body = text.substr(2, n) if leading else text.substr(1, n)
        negative = sign == "-"
        body = F.when(sign.isin("+", "-", " "), body)
    elif p.signed:
        mark = text.substr(1, 1) if leading else text.substr(n, 1)
        negative = mark.between(MINUS_DIGITS[0], MINUS_DIGITS[-1])
        digit = F.translate(mark, MINUS_DIGITS, PLAIN_DIGITS)
        body = F.concat(digit, text.substr(2, n - 1)) if leading else F.concat(text.substr(1, n - 1), digit)
    plain = F.trim(body)
    whole = F.when(plain == "", F.lit(0).cast(f"decimal({n},0)")).when(plain.rlike("^[0-9]+$"), plain.try_cast(f"decimal({n},0)"))
    value = _scaled(whole, n, p)
    return F.when(negative, -value).otherwise(value) if p.signed else value


def encode_zoned(value: Column, pic: str | Picture, leading: bool = False, separate: bool = False) -> Column:
    p = _pic(pic)
    d = digits_text(value, p)
    if not p.signed:
        return d
    negative = value < 0
    if separate:
        sign = F.when(negative, "-").otherwise("+")
        return F.concat(sign, d) if leading else F.concat(d, sign)
    if leading:
        marked = F.concat(F.translate(d.substr(1, 1), PLAIN_DIGITS, MINUS_DIGITS), d.substr(2, p.digits))
    else:
        marked = F.concat(d.substr(1, p.digits - 1), F.translate(d.substr(p.digits, 1), PLAIN_DIGITS, MINUS_DIGITS))
    return F.when(negative, marked).otherwise(d)


# -- packed ------------------------------------------------------------------
def packed_bytes(digits: int) -> int:
    return digits // 2 + 1


def decode_packed(raw: Column, pic: str | Picture) -> Column:
    """COMP-3: two digits a byte, sign in the last nibble (B and D are minus).

    Bytes that are no packed number give null.
    """
    p = _pic(pic)
    n = 2 * packed_bytes(p.digits) - 1
    text = F.hex(raw)
    sign = F.when(text.substr(n + 1, 1).isin("B", "D"), "-").otherwise("")
    if not p.scale:
        number = F.concat(sign, text.substr(1, n))
    else:
        number = F.concat(sign, text.substr(1, n - p.scale), F.lit("."), text.substr(n - p.scale + 1, p.scale))
    return number.try_cast(f"decimal({p.digits},{p.scale})")


def encode_packed(value: Column, pic: str | Picture) -> Column:
    p = _pic(pic)
    n = 2 * packed_bytes(p.digits) - 1
    sign = F.when(value < 0, "D").otherwise("C") if p.signed else F.lit("F")
    return F.unhex(F.concat(F.lpad(digits_text(value, p), n, "0"), sign))


# -- binary ------------------------------------------------------------------
def binary_bytes(digits: int) -> int:
    return 2 if digits <= 4 else 4 if digits <= 9 else 8


def decode_binary(raw: Column, pic: str | Picture) -> Column:
    """Big-endian two's complement."""
    p = _pic(pic)
    size = binary_bytes(p.digits)
    unsigned = F.conv(F.hex(raw), 16, 10).cast("decimal(20,0)")
    whole = unsigned
    if p.signed:
        whole = F.when(unsigned >= F.lit(2 ** (8 * size - 1)).cast("decimal(20,0)") if size < 8
                       else unsigned >= F.lit("9223372036854775808").cast("decimal(20,0)"),
                       unsigned - F.lit(str(2 ** (8 * size))).cast("decimal(20,0)")).otherwise(unsigned)
    return _scaled(dec(whole, max(p.digits, 20), 0) if p.scale == 0 else dec(whole, 20, 0), 20, p)


def encode_binary(value: Column, pic: str | Picture) -> Column:
    p = _pic(pic)
    size = binary_bytes(p.digits)
    whole = (value * pow10(p.scale) if p.scale else value).cast("bigint")
    return F.unhex(F.right(F.lpad(F.hex(whole), 16, "0"), F.lit(2 * size)))


# -- floating ----------------------------------------------------------------
def decode_float(raw: Column, size: int) -> Column:
    """IEEE big-endian COMP-1 (4 bytes) or COMP-2 (8 bytes)."""
    text = F.hex(raw)
    head = F.conv(text.substr(1, 3), 16, 10).cast("int")           # sign and exponent bits
    if size == 8:
        sign, exponent = F.shiftright(head, 11), head.bitwiseAND(2047)
        fraction = F.conv(text.substr(4, 13), 16, 10).cast("bigint").cast("double")
        bias, steps = 1023, 52
    else:
        bits = F.conv(text.substr(1, 8), 16, 10).cast("bigint")
        sign = F.shiftright(bits, 31)
        exponent = F.shiftright(bits, 23).bitwiseAND(F.lit(255).cast("bigint"))
        fraction = bits.bitwiseAND(F.lit(8388607).cast("bigint")).cast("double")
        bias, steps = 127, 23
    normal = (F.lit(1.0) + fraction / F.lit(float(2 ** steps))) * F.pow(F.lit(2.0), exponent - bias)
    small = fraction / F.lit(float(2 ** steps)) * F.lit(2.0 ** (1 - bias))
    size_of = F.when(exponent == 0, small).otherwise(normal)
    out = F.when(sign == 1, -size_of).otherwise(size_of)
    return out if size == 8 else out.cast("float")
