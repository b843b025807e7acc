"""String verbs and alphanumeric moves as Column expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

SPACE = " "
# figurative constants: fixed values
FIGURATIVE = {"SPACES": " ", "ZEROS": "0", "HIGH-VALUES": "ÿ", "LOW-VALUES": "\u0000", "QUOTES": '"'}


def _c(value: Column | str) -> Column:
    """Plain strings are literals here; columns are passed as Columns."""
    return value if isinstance(value, Column) else F.lit(value)


def fit(text: Column, width: int) -> Column:
    """Alphanumeric receiver: blank-padded on the right, or cut."""
    return F.rpad(text, width, SPACE)


def figurative(name: str, width: int) -> Column:
    return F.lit(FIGURATIVE[name] * width)


def refmod(text: Column, start: int | Column, length: int | Column | None = None) -> Column:
    """``f(start:length)``, counted from one."""
    if length is None:
        return F.substring(text, _c(start) if isinstance(start, Column) else start, 2147483647)
    if isinstance(start, int) and isinstance(length, int):
        return text.substr(start, length)
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return text.substr(as_col(start), as_col(length))


def string_into(parts: list[tuple[Column | str, Column | str | None]], width: int | None = None) -> Column:
    """STRING: each part up to its delimiter (None means by SIZE), joined."""
    pieces = []
    for value, delimiter in parts:
        v = _c(value)
        if isinstance(delimiter, Column):
            at = F.instr(v, delimiter)
            v = F.when(at > 0, v.substr(F.lit(1), at - 1)).otherwise(v)
        elif delimiter:
            v = F.substring_index(v, delimiter, 1)
        pieces.append(v)
    joined = F.concat(*pieces)
    return joined if width is None else fit(joined, width)


@dataclass(frozen=True)
class Unstrung:
    fields: list[Column]
    tally: Column      # receivers filled
    pointer: Column    # next position to examine, from one
    overflow: Column


def unstring(text: Column, delimiter: str, receivers: int, pointer: Column | None = None) -> Unstrung:
    """UNSTRING by one delimiter into ``receivers`` fields, from ``pointer`` on.

    Overflow is a pointer outside the text, or text left over once every
    receiver is filled. Receivers that are not reached come back empty.
    """
    start = F.lit(1) if pointer is None else pointer.cast("int")
    size = F.length(text)
    bad = (start < 1) | (start > size)
    rest = text if pointer is None else text.substr(start, size)
    # one part more than there are receivers: the rest stays in one piece
    parts = F.split(rest, re.escape(delimiter), receivers + 1)
    filled = F.least(F.size(parts), F.lit(receivers))
    fields = [F.when(bad, F.lit("")).otherwise(F.coalesce(F.get(parts, F.lit(i)), F.lit(""))) for i in range(receivers)]
    used = F.aggregate(F.slice(parts, 1, receivers), F.lit(0), lambda a, x: a + F.length(x) + len(delimiter))
    after = F.when(F.size(parts) <= receivers, size + 1).otherwise(start + used)
    return Unstrung(
        fields,
        F.when(bad, 0).otherwise(filled),
        F.when(bad, start).otherwise(after),
        bad | (after <= size),
    )


# -- INSPECT -----------------------------------------------------------------
def tally_characters(text: Column) -> Column:
    return F.length(text)


def tally_all(text: Column, what: str) -> Column:
    if not what:
        return F.lit(0)
    gone = F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))
    return gone if len(what) == 1 else (gone / F.lit(len(what))).cast("int")


def _leading_length(text: Column, what: str) -> Column:
    return F.length(F.regexp_extract(text, f"^(?:{re.escape(what)})*", 0))


def tally_leading(text: Column, what: str) -> Column:
    if not what:
        return F.lit(0)
    run = _leading_length(text, what)
    return run if len(what) == 1 else (run / F.lit(len(what))).cast("int")


def replace_all(text: Column, what: str, by: str) -> Column:
    return F.replace(text, F.lit(what), F.lit(by)) if what else text


def replace_first(text: Column, what: str, by: str) -> Column:
    at = F.instr(text, what)
    swapped = F.concat(text.substr(F.lit(1), at - 1), F.lit(by), F.substring(text, at + len(what), 2147483647))
    return F.when(at > 0, swapped).otherwise(text) if what else text


def replace_leading(text: Column, what: str, by: str) -> Column:
    if not what:
        return text
    run = _leading_length(text, what)
    return F.concat(F.repeat(F.lit(by), (run / F.lit(len(what))).cast("int")), F.substring(text, run + 1, 2147483647))


def replace_characters(text: Column, by: str) -> Column:
    return F.repeat(F.lit((by or SPACE)[0]), F.length(text))


def inspect_replacing(text: Column, steps: list[tuple[str, str | None, str]]) -> Column:
    """Replacements (kind, what, by) applied one after another."""
    for kind, what, by in steps:
        if kind == "CHARACTERS":
            text = replace_characters(text, by)
        else:
            text = {"ALL": replace_all, "FIRST": replace_first, "LEADING": replace_leading}[kind](text, what, by)
    return text


def converting(text: Column, source: str, target: str) -> Column:
    """Character map; characters past the shorter target stay as they are."""
    n = min(len(source), len(target))
    return F.translate(text, source[:n], target[:n]) if n else text


def latin1(text: Column) -> Column:
    return F.encode(text, "ISO-8859-1")


def from_latin1(raw: Column) -> Column:
    return F.decode(raw, "ISO-8859-1")
