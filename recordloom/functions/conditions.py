"""Relations, condition names and multi-way selection."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

ANY = object()   # matches every subject in one WHEN position


def text_eq(a: Column, b: Column | str) -> Column:
    """Text compares as if both sides were blank-padded to one length."""
    other = b if isinstance(b, Column) else F.lit(b.rstrip(" "))
    return F.rtrim(a) == (F.rtrim(other) if isinstance(b, Column) else other)


def padded(a: Column, b: Column | str) -> tuple[Column, Column]:
    """Both sides blank-padded to one length, for <, <=, > and >= on text."""
    b = b if isinstance(b, Column) else F.lit(b)
    n = F.greatest(F.length(a), F.length(b))
    return F.rpad(a, n, F.lit(" ")), F.rpad(b, n, F.lit(" "))


def text_lt(a: Column, b: Column | str) -> Column:
    x, y = padded(a, b)
    return x < y


def text_le(a: Column, b: Column | str) -> Column:
    x, y = padded(a, b)
    return x <= y


def through(subject: Column, low, high) -> Column:
    """low THRU high, ends included."""
    if not isinstance(low, str):
        return subject.between(low, high)
    return ~text_lt(subject, low) & text_le(subject, high)


def condition_name(subject: Column, values: Sequence) -> Column:
    """Level-88 test; values are single ones or (low, high) pairs for THRU."""
    single = [v for v in values if not isinstance(v, tuple)]
    tests = []
    if single:
        body = F.rtrim(subject) if all(isinstance(v, str) for v in single) else subject
        tests.append(body.isin(*[v.rstrip(" ") if isinstance(v, str) else v for v in single]))
    for low, high in (v for v in values if isinstance(v, tuple)):
        tests.append(through(subject, low, high))
    return reduce(lambda a, b: a | b, tests)


def set_true(values: Sequence) -> Column:
    """SET cond TO TRUE moves the condition's first value."""
    first = values[0]
    return F.lit(first[0] if isinstance(first, tuple) else first)


def evaluate(whens: Sequence[tuple], other: Column | None = None, subjects: Sequence[Column] = (True,)) -> Column:
    """EVALUATE subj [ALSO subj ...]: the first WHEN that matches decides.

    Each entry is (match, ..., result). A match is a Column condition when the
    subject is True, else a value, a (low, high) pair, or ANY.
    """
    chain = None
    for *matches, result in whens:
        tests = []
        for subject, match in zip(subjects, matches, strict=True):
            if match is ANY:
                continue
            if subject is True:
                tests.append(match)
            elif isinstance(match, tuple):
                tests.append(through(subject, *match))
            else:
                tests.append(subject == match)
        hit = reduce(lambda a, b: a & b, tests) if tests else F.lit(True)
        value = result if isinstance(result, Column) else F.lit(result)
        chain = F.when(hit, value) if chain is None else chain.when(hit, value)
    return chain if other is None else chain.otherwise(other)
