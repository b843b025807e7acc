"""Page reports: headings, numbered details, footings and running sums."""

from __future__ import annotations

from dataclasses import dataclass, field as dc_field

from pyspark.sql import Column, DataFrame, functions as F

from recordloom.functions.edited import edit
from recordloom.functions.numeric import Num, num
from recordloom.functions.text import fit
from recordloom.operators.ordering import number_rows
from recordloom.picture import ALNUM, NUMERIC, picture

PAGE_COUNTER = "PAGE-COUNTER"


@dataclass(frozen=True)
class Item:
    """One printed field: VALUE text, SOURCE column, or SUM of a column."""
    column: int
    pic: str
    value: str | None = None
    source: str | None = None
    sum: str | None = None


@dataclass(frozen=True)
class Group:
    items: tuple[Item, ...]
    plus: int = 1      # LINE PLUS n: n - 1 blank lines come first


@dataclass(frozen=True)
class Report:
    detail: Group
    heading: Group | None = None
    footing: Group | None = None
    source_pics: dict[str, str] = dc_field(default_factory=dict)   # PICTURE of each source column
    last_line: int = 5     # a detail that would start past this line opens a new page

    @property
    def details_per_page(self) -> int:
        return self.last_line - (1 if self.heading else 0)

    def sums(self) -> list[str]:
        groups = [g for g in (self.heading, self.detail, self.footing) if g]
        return sorted({i.sum for g in groups for i in g.items if i.sum})


def _print(item: Item, report: Report, page: Column, before: bool) -> Column:
    p = picture(item.pic)
    if item.value is not None:
        return F.lit(item.value.ljust(p.width)[: p.width])
    if item.source == PAGE_COUNTER:
        n = Num(page.cast("decimal(18,0)"), 18, 0)
    elif item.sum:
        scale = picture(report.source_pics[item.sum]).scale
        col = F.col(f"_sum_{item.sum}")
        if before:
            col = col - F.col(item.sum)
        n = Num(col.cast(f"decimal(28,{scale})"), 28, scale)
    else:
        source = picture(report.source_pics.get(item.source, "X"))
        if source.kind != NUMERIC:
            return fit(F.coalesce(F.col(item.source), F.lit("")), p.width)
        n = num(item.source, source)
    if p.kind == ALNUM:
        return fit(n.col.cast("string"), p.width)
    return edit(n, item.pic if p.kind != NUMERIC else "9" * p.digits)


def _line(group: Group, report: Report, page: Column, before: bool = False) -> Column:
    parts, at = [], 0
    for item in sorted(group.items, key=lambda i: i.column):
        if item.column - 1 > at:
            parts.append(F.lit(" " * (item.column - 1 - at)))
            at = item.column - 1
        parts.append(_print(item, report, page, before))
        at += picture(item.pic).width
    return F.concat(*parts)


def _lines(group: Group, text: Column, page: Column, first: Column) -> list[Column]:
    out = []
    for i in range(group.plus):
        body = text if i == group.plus - 1 else F.lit("")
        out.append(F.struct(page.alias("page"), (first + F.lit(i)).cast("bigint").alias("line"), body.alias("text")))
    return out


def generate(details: DataFrame, report: Report, order: list[Column]) -> DataFrame:
    """INITIATE, one GENERATE per row in ``order``, TERMINATE.

    Gives (page, line, text); lines are numbered through the whole report.
    Every page holds the same number of lines, so a line's number follows from
    the detail's number and no second pass is needed. ``order`` ends in
    something unique.
    """
    sums = report.sums()
    running = {f"_sum_{c}": num(c, report.source_pics[c]).col for c in sums}
    rows = number_rows(details, order, "_k", running, total="_total")
    n = report.details_per_page
    head = report.heading.plus if report.heading else 0
    foot = report.footing.plus if report.footing else 0
    k = F.col("_k") - 1
    page = F.call_function("div", k, F.lit(n).cast("bigint")) + 1
    spot = k % F.lit(n)
    base = (page - 1) * F.lit(head + n * report.detail.plus + foot)
    parts = []
    if report.heading:
        opens = F.array(*_lines(report.heading, _line(report.heading, report, page, before=True), page, base + 1))
        parts.append(F.when(spot == 0, opens))
    at = base + head + spot * F.lit(report.detail.plus) + 1
    parts.append(F.array(*_lines(report.detail, _line(report.detail, report, page, before=True), page, at)))
    if report.footing:
        end = at + report.detail.plus
        closes = F.array(*_lines(report.footing, _line(report.footing, report, page), page, end))
        parts.append(F.when((spot == n - 1) | (F.col("_k") == F.col("_total")), closes))
    merged = F.concat(*[F.coalesce(p, F.array().cast("array<struct<page:bigint,line:bigint,text:string>>")) for p in parts])
    # Built in a projection, repeated pieces are computed once; and the outer
    # form of explode keeps Spark from testing the whole array for emptiness
    # first, which would build it twice. It is never empty.
    return rows.select(merged.alias("_all")).select(F.explode_outer("_all").alias("_l")).select("_l.page", "_l.line", "_l.text")


def total(details: DataFrame, sums: dict[str, str]) -> DataFrame:
    """Report SUM counters at TERMINATE: column name to its PICTURE."""
    return details.agg(*[F.sum(num(c, pic).col).alias(f"sum_{c}") for c, pic in sums.items()],
                       F.count(F.lit(1)).alias("details"))
