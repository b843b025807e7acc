"""Group moves and record initialisation."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F, types as T

from recordloom.functions.edited import edit
from recordloom.functions.numeric import Num, digits_text, num, store
from recordloom.functions.text import fit
from recordloom.layout import Field, Layout
from recordloom.picture import EDITED, NUMERIC, Picture, picture


def move(source: Column, source_pic: str | Picture, target_pic: str | Picture) -> Column:
    """MOVE one elementary item into another picture."""
    s = picture(source_pic) if isinstance(source_pic, str) else source_pic
    t = picture(target_pic) if isinstance(target_pic, str) else target_pic
    if t.kind == NUMERIC:
        if s.kind == NUMERIC:
            return store(num(source, s), t).value
        # text into a number: its digits as a whole number, blanks are zero
        whole = F.coalesce(F.trim(source).try_cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))
        return store(Num(whole, 38, 0), t).value
    if t.kind == EDITED:
        return edit(num(source, s), t.text)
    if s.kind == NUMERIC:
        return fit(digits_text(source, s), t.width)
    return fit(source, t.width)


def common_items(a: list[Field], b: list[Field], path: tuple = ()) -> list[tuple[tuple, Field, Field]]:
    """Elementary items under both groups at the same path of names."""
    names = {f.name: f for f in b if not f.filler}
    out = []
    for f in a:
        g = names.get(f.name)
        if f.filler or g is None or f.redefines or g.redefines or f.occurs or g.occurs:
            continue
        if f.children and g.children:
            out += common_items(f.children, g.children, (*path, f.column))
        elif not f.children and not g.children:
            out.append(((*path, f.column), f, g))
    return out


def _at(prefix: str | None, path: tuple) -> Column:
    return F.col(".".join(([prefix] if prefix else []) + list(path)))


def _rebuild(fields: list[Field], values: dict[tuple, Column], prefix: str | None, path: tuple = ()) -> list[Column]:
    out = []
    for f in fields:
        if f.filler:
            continue
        here = (*path, f.column)
        if f.children and not f.occurs:
            out.append(F.struct(*_rebuild(f.children, values, prefix, here)).alias(f.column))
        else:
            out.append(values.get(here, _at(prefix, here)).alias(f.column))
    return out


def move_corresponding(source: Layout, target: Layout, source_at: str | None = None, target_at: str | None = None) -> list[Column]:
    """The target group's columns after MOVE CORRESPONDING."""
    values = {p: move(_at(source_at, p), f.pic, g.pic) for p, f, g in common_items(source.fields, target.fields)}
    return _rebuild(target.fields, values, target_at)


def arithmetic_corresponding(verb: str, source: Layout, target: Layout,
                             source_at: str | None = None, target_at: str | None = None) -> list[Column]:
    """ADD or SUBTRACT CORRESPONDING over the shared numeric items."""
    values = {}
    for p, f, g in common_items(source.fields, target.fields):
        if f.pic.kind == NUMERIC and g.pic.kind == NUMERIC:
            a, b = num(_at(target_at, p), g.pic), num(_at(source_at, p), f.pic)
            values[p] = store(a + b if verb == "ADD" else a - b, g.pic, a.col).value
    return _rebuild(target.fields, values, target_at)


def initialize(layout: Layout) -> list[Column]:
    """INITIALIZE: zero for numbers, blanks for text, through groups and tables."""

    def blank(f: Field) -> Column:
        if f.children:
            one = F.struct(*[blank(c).alias(c.column) for c in f.children if not c.filler])
        elif isinstance(f.leaf_type(), T.StringType):
            one = F.lit(" " * f.unit)
        else:
            one = F.lit(Decimal(0)).cast(f.leaf_type())
        return F.array_repeat(one, f.occurs) if f.occurs else one

    return [blank(f).alias(f.column) for f in layout.fields if not f.filler and not f.redefines]


def call(df: DataFrame, program, using: dict[str, str], by_content: set[str] = frozenset()) -> DataFrame:
    """CALL: ``program`` maps parameter Columns to the parameters it changed.

    ``using`` names the caller's column for each parameter. Changes are written
    back, save for parameters passed by content.
    """
    if not callable(program):
        raise LookupError(f"no program {program!r}")
    changed = program(**{p: F.col(c) for p, c in using.items()})
    back = {using[p]: v for p, v in changed.items() if p not in by_content}
    return df.withColumns(back)
