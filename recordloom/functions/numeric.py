"""Exact fixed-point arithmetic with PICTURE storage rules.

``Num`` pairs a decimal Column with the precision and scale it is known to fit,
so result types are settled while the plan is built: Spark never gets to shrink
a scale behind our back, and an expression that cannot be exact is refused.
``store`` then moves a ``Num`` into a receiving PICTURE.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, functions as F

from recordloom.picture import NUMERIC, Picture, picture

MAX_DIGITS = 38
LONG_DIGITS = 18
QUOTIENT_SCALE = 20   # fraction digits kept by a division inside an expression

TRUNCATION = "TRUNCATION"
NEAREST_AWAY = "NEAREST-AWAY-FROM-ZERO"
NEAREST_EVEN = "NEAREST-EVEN"
NEAREST_TOWARD = "NEAREST-TOWARD-ZERO"
TOWARD_GREATER = "TOWARD-GREATER"
TOWARD_LESSER = "TOWARD-LESSER"
AWAY = "AWAY-FROM-ZERO"
PROHIBITED = "PROHIBITED"


class PrecisionError(ValueError):
    """The exact result needs more digits than a decimal can hold."""


def dec(col: Column, digits: int, scale: int) -> Column:
    return col.cast(f"decimal({digits},{scale})")


def pow10(n: int) -> Column:
    """10**n as an exact decimal literal; negative n gives a fraction."""
    if n >= 0:
        return F.lit(Decimal(10) ** n).cast(f"decimal({n + 1},0)")
    return F.lit(Decimal(1).scaleb(n)).cast(f"decimal({-n},{-n})")


def point_left(whole: Column, digits: int, scale: int, size: int) -> Column:
    """A non-negative whole number of ``digits`` digits, over 10**scale."""
    if not scale:
        return dec(whole, size, 0)
    if digits + scale + 1 <= MAX_DIGITS:
        return dec(whole * pow10(-scale), size, scale)
    # the product's type would not hold the scale, so the point goes in as text
    text = F.lpad(dec(whole, digits, 0).cast("string"), max(digits, scale + 1), "0")
    head = max(digits, scale + 1) - scale
    return dec(F.concat(text.substr(1, head), F.lit("."), text.substr(head + 1, scale)), size, scale)


def _fits(digits: int, what: str) -> None:
    if digits > MAX_DIGITS:
        raise PrecisionError(f"{what} needs {digits} digits; store an intermediate result first")


@dataclass(frozen=True)
class Num:
    col: Column      # decimal(digits, scale)
    digits: int
    scale: int

    @property
    def ints(self) -> int:
        return self.digits - self.scale

    # -- expression building ------------------------------------------------
    def _align(self, other, sign: str) -> "Num":
        other = as_num(other)
        scale = max(self.scale, other.scale)
        digits = max(self.ints, other.ints) + scale + 1
        _fits(digits, "sum")
        col = self.col + other.col if sign == "+" else self.col - other.col
        return Num(dec(col, digits, scale), digits, scale)

    def __add__(self, other):
        return self._align(other, "+")

    def __radd__(self, other):
        return as_num(other) + self

    def __sub__(self, other):
        return self._align(other, "-")

    def __rsub__(self, other):
        return as_num(other) - self

    def __neg__(self):
        return Num(-self.col, self.digits, self.scale)

    def __mul__(self, other):
        other = as_num(other)
        digits = self.digits + other.digits + 1
        _fits(digits, "product")
        return Num(self.col * other.col, digits, self.scale + other.scale)

    def __rmul__(self, other):
        return as_num(other) * self

    def __truediv__(self, other):
        other = as_num(other)
        head = max(self.scale, other.scale) - self.scale
        room = min(31 - self.digits - head, 32 - self.ints - other.scale)
        if room >= QUOTIENT_SCALE:
            return divide(self, other, QUOTIENT_SCALE)
        return _long_quotient(self, other)

    def __rtruediv__(self, other):
        return as_num(other) / self

    def __pow__(self, exponent: int):
        if not isinstance(exponent, int):
            raise ValueError("only whole-number powers are exact")
        if exponent < 0:
            return as_num(1) / self ** -exponent
        if exponent == 0:
            return as_num(1)
        out = self
        for _ in range(exponent - 1):
            out = out * self
        return out

    # -- comparisons keep plain Columns --------------------------------------
    def __gt__(self, other):
        return self.col > as_num(other).col

    def __ge__(self, other):
        return self.col >= as_num(other).col

    def __lt__(self, other):
        return self.col < as_num(other).col

    def __le__(self, other):
        return self.col <= as_num(other).col


def num(col: Column | str, pic: str | Picture) -> Num:
    """A stored numeric field: ``col`` read under its PICTURE."""
    p = picture(pic) if isinstance(pic, str) else pic
    if p.kind != NUMERIC:
        raise ValueError(f"{p.text} is not numeric")
    c = F.col(col) if isinstance(col, str) else col
    return Num(dec(c, p.digits, p.scale), p.digits, p.scale)


def as_num(value) -> Num:
    if isinstance(value, Num):
        return value
    d = Decimal(str(value))
    exp = d.as_tuple().exponent
    scale = max(0, -exp)
    digits = max(len(d.as_tuple().digits) + max(exp, 0), scale, 1)
    return Num(F.lit(d).cast(f"decimal({digits},{scale})"), digits, scale)


# -- division ----------------------------------------------------------------
def _whole_quotient(a: Num, b: Num, scale: int):
    """|a|*10**scale div |b| with its remainder, all in whole numbers.

    Up to 18 digits that is long arithmetic. Beyond, the dividend less its remainder is a multiple of the divisor, so the one
    decimal division that is left has a whole result and cannot be rounded.
    """
    common = max(a.scale, b.scale)
    top_digits = a.ints + common + scale
    low_digits = b.ints + common
    quot_digits = a.ints + b.scale + scale

    def whole(n: Num, shift: int) -> Column:
        return n.col * pow10(shift) if shift else n.col

    if max(top_digits, low_digits, quot_digits) <= LONG_DIGITS:
        top = F.abs(whole(a, common + scale).cast("bigint"))
        low = F.nullif(F.abs(whole(b, common).cast("bigint")), F.lit(0).cast("bigint"))
        return F.call_function("div", top, low), top % low, low, quot_digits
    _fits(top_digits + 7, "dividend")
    _fits(low_digits + 7, "divisor")
    _fits(quot_digits + 6, "quotient")
    top = dec(F.abs(whole(a, common + scale)), top_digits, 0)
    low = dec(F.nullif(F.abs(whole(b, common)), F.lit(0)), low_digits, 0)
    rest = dec(top % low, low_digits, 0)
    quot = dec(dec(top - rest, top_digits, 0) / low, quot_digits, 0)
    return quot, rest, low, quot_digits


def _long_quotient(a: Num, b: Num) -> Num:
    """A quotient of wide operands: its whole part, and then its fraction from
    the remainder, some digits at a time, each step a division of whole numbers.
    It has QUOTIENT_SCALE fraction digits as a narrow one has, or is refused."""
    quot, rest, low, digits = _whole_quotient(a, b, 0)
    low_digits, scale = b.ints + max(a.scale, b.scale), QUOTIENT_SCALE
    _fits(digits + scale, "quotient")
    step = MAX_DIGITS - 7 - low_digits
    if step < 1:
        raise PrecisionError(f"divisor of {low_digits} digits leaves no room for a fraction; store an intermediate result first")
    rest, low = dec(rest, low_digits, 0), dec(low, low_digits, 0)
    text = [F.when((a.col < 0) != (b.col < 0), "-").otherwise(""), dec(quot, max(digits, 1), 0).cast("string"), F.lit(".")]
    for done in range(0, scale, step):
        k = min(step, scale - done)
        top = dec(rest * pow10(k), low_digits + k, 0)
        rest = dec(top % low, low_digits, 0)
        text.append(F.lpad(dec(dec(top - rest, low_digits + k, 0) / low, k, 0).cast("string"), k, "0"))
    # the sum's type would not hold the scale, so the point goes in as text
    return Num(dec(F.concat(*text), max(digits, 1) + scale, scale), max(digits, 1) + scale, scale)


def divide(a, b, scale: int, rounding: str = TRUNCATION) -> Num:
    """Quotient exact to ``scale`` digits; null where the divisor is zero."""
    a, b = as_num(a), as_num(b)
    quot, rest, low, digits = _whole_quotient(a, b, scale)
    negative = (a.col < 0) != (b.col < 0)
    if rounding != TRUNCATION:
        twice = rest * F.lit(2)
        up = {
            NEAREST_AWAY: twice >= low,
            NEAREST_TOWARD: twice > low,
            NEAREST_EVEN: (twice > low) | ((twice == low) & (quot % F.lit(2) != 0)),
            TOWARD_GREATER: (rest != 0) & ~negative,
            TOWARD_LESSER: (rest != 0) & negative,
            AWAY: rest != 0,
        }[rounding]
        digits += 1
        _fits(digits, "quotient")
        quot = F.when(up, quot + F.lit(1)).otherwise(quot)
    size = max(digits, scale + 1)
    value = point_left(dec(quot, digits, 0), digits, scale, size)
    return Num(F.when(negative, -value).otherwise(value), size, scale)


# -- storing -----------------------------------------------------------------
def round_to(n: Num, scale: int, mode: str = TRUNCATION) -> Num:
    """Reduce to ``scale`` fraction digits under one of the rounding modes."""
    if n.scale <= scale:
        return n
    v = n.col
    half = F.lit(Decimal(5).scaleb(-scale - 1)).cast(f"decimal({scale + 1},{scale + 1})")
    s = F.lit(scale)
    if mode in (TRUNCATION, PROHIBITED):
        out = F.when(v < 0, F.ceil(v, s)).otherwise(F.floor(v, s))
    elif mode == NEAREST_AWAY:
        out = F.round(v, scale)
    elif mode == NEAREST_EVEN:
        out = F.bround(v, scale)
    elif mode == NEAREST_TOWARD:
        out = F.when(v < 0, F.floor(v + half, s)).otherwise(F.ceil(v - half, s))
    elif mode == TOWARD_GREATER:
        out = F.ceil(v, s)
    elif mode == TOWARD_LESSER:
        out = F.floor(v, s)
    elif mode == AWAY:
        out = F.when(v < 0, F.floor(v, s)).otherwise(F.ceil(v, s))
    else:
        raise ValueError(f"unknown rounding mode {mode!r}")
    digits = min(n.ints + 1 + scale, MAX_DIGITS)
    return Num(dec(out, digits, scale), digits, scale)


@dataclass(frozen=True)
class Stored:
    value: Column        # decimal of the receiving PICTURE
    size_error: Column   # boolean


def store(
    n,
    pic: str | Picture,
    old: Column | None = None,
    rounding: str = TRUNCATION,
    on_size_error: bool = False,
) -> Stored:
    """Move a result into a receiver.

    Unsigned receivers take the absolute value; fraction digits go first, then
    high-order digits. With ``on_size_error`` an overflow or a zero divisor
    leaves ``old`` in place; without it digits are dropped silently and only a
    zero divisor leaves ``old``.
    """
    n = as_num(n)
    p = picture(pic) if isinstance(pic, str) else pic
    if p.kind != NUMERIC:
        raise ValueError(f"{p.text} does not receive numbers")
    src = n if p.signed else Num(F.abs(n.col), n.digits, n.scale)
    r = round_to(src, p.scale, rounding)
    too_big = F.lit(False)
    body = r.col
    if r.ints > p.int_digits:
        limit = pow10(p.int_digits)
        too_big = F.abs(r.col) >= limit
        body = r.col % limit
    if rounding == PROHIBITED and n.scale > p.scale:
        too_big = too_big | (r.col != src.col)
    fitted = dec(body, p.digits, p.scale)
    keep = F.lit(None) if old is None else old
    keep = dec(keep, p.digits, p.scale)
    error = n.col.isNull() | too_big
    if on_size_error:
        value = F.when(error, keep).otherwise(fitted)
    else:
        value = fitted if old is None else F.coalesce(fitted, keep)
    return Stored(value, F.coalesce(error, F.lit(True)))


def divide_into(a, b, pic: str | Picture, old: Column | None = None,
                rounding: str = TRUNCATION, on_size_error: bool = False) -> Stored:
    """DIVIDE a BY b GIVING receiver: quotient exact at the receiver's scale."""
    p = picture(pic) if isinstance(pic, str) else pic
    return store(divide(a, b, p.scale, rounding), p, old, on_size_error=on_size_error)


def divide_remainder(a, b, quotient_pic: str, remainder_pic: str,
                     old_quotient: Column | None = None,
                     old_remainder: Column | None = None) -> tuple[Stored, Stored]:
    """DIVIDE ... GIVING q REMAINDER r; r uses the quotient as truncated for q."""
    a, b = as_num(a), as_num(b)
    q = divide(a, b, picture(quotient_pic).scale)
    r = a - q * b
    return store(q, quotient_pic, old_quotient), store(r, remainder_pic, old_remainder)


def add_to(receivers: dict[str, tuple[Num, str]], amount, rounding: str = TRUNCATION) -> dict[str, Column]:
    """ADD x TO a b c: each receiver stores its own sum under its own PICTURE."""
    return {k: store(n + amount, pic, n.col, rounding).value for k, (n, pic) in receivers.items()}


def subtract_from(receivers: dict[str, tuple[Num, str]], amount, rounding: str = TRUNCATION) -> dict[str, Column]:
    return {k: store(n - amount, pic, n.col, rounding).value for k, (n, pic) in receivers.items()}


# -- intrinsic functions -----------------------------------------------------
def function_mod(a, b) -> Num:
    """FUNCTION MOD on whole numbers: a - b * floor(a / b), so the sign of b."""
    a, b = as_num(a), as_num(b)
    rest = F.pmod(a.col, F.nullif(F.abs(b.col), F.lit(0)))
    value = F.when((b.col < 0) & (rest != 0), rest + b.col).otherwise(rest)
    return Num(dec(value, b.digits, b.scale), b.digits, b.scale)


def function_rem(a, b) -> Num:
    """Remainder with the sign of the dividend."""
    a, b = as_num(a), as_num(b)
    scale = max(a.scale, b.scale)
    digits = b.ints + scale
    return Num(dec(a.col % F.nullif(b.col, F.lit(0)), digits, scale), digits, scale)


def numval(text: Column, digits: int = 36, scale: int = 18) -> Num:
    """FUNCTION NUMVAL: free-form number text; anything unreadable is zero.

    Fraction digits past ``scale`` are cut, not rounded. A number with more
    whole digits than there is room for fails the row.
    """
    kind = f"decimal({digits},{scale})"
    clean = F.upper(F.trim(F.translate(text, "$,", "")))
    negative = clean.startswith("-") | clean.endswith("-") | clean.endswith("CR") | clean.endswith("DB")
    body = F.trim(F.regexp_replace(clean, r"^[+-]|[+-]$|CR$|DB$", ""))
    readable = body.rlike(r"^([0-9]+\.?[0-9]*|\.[0-9]+)$")
    number = F.regexp_replace(body, rf"(\.[0-9]{{{scale}}})[0-9]+$" if scale else r"\.[0-9]*$", "$1" if scale else "").try_cast(kind)
    too_long = F.raise_error(F.concat(F.lit("no room for the number "), body)).cast(kind)
    value = F.when(~F.coalesce(readable, F.lit(False)), F.lit(0).cast(kind)).when(number.isNull(), too_long).otherwise(number)
    return Num(F.when(negative, -value).otherwise(value), digits, scale)


def parse_int(text: Column, kind: str = "int") -> Column:
    """Whole number or zero: blanks and bad text do not fail the row."""
    return F.coalesce(F.trim(text).try_cast(kind), F.lit(0).cast(kind))


# -- display -----------------------------------------------------------------
def digits_text(value: Column, p: Picture) -> Column:
    """Unsigned digits without a point, zero-filled to the picture."""
    whole = dec(F.abs(value) * pow10(p.scale), p.digits, 0) if p.scale else dec(F.abs(value), p.digits, 0)
    return F.lpad(whole.cast("string"), p.digits, "0")


def display_text(value: Column, pic: str | Picture, separate: str | None = None, usage: str = "DISPLAY") -> Column:
    """DISPLAY of a numeric item: zero-filled, sign shown on signed items.

    ``separate`` is LEADING or TRAILING for SIGN SEPARATE items. A nine-digit
    COMP-5 item shows ten digits.
    """
    p = picture(pic) if isinstance(pic, str) else pic
    d = digits_text(value, p)
    body = d
    if usage == "COMP-5" and p.digits == 9 and p.scale == 0:
        body = F.concat(F.lit("0"), d)
    if p.scale:
        body = F.concat(d.substr(1, p.int_digits), F.lit("."), d.substr(p.int_digits + 1, p.scale)) \
            if p.int_digits else F.concat(F.lit("0."), d)
    if not p.signed:
        return body
    sign = F.when(value < 0, "-").otherwise("+")
    return F.concat(body, sign) if separate == "TRAILING" else F.concat(sign, body)
