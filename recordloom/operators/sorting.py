"""SORT, MERGE and the utility sort."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from recordloom.operators.ordering import number_rows

ASC, DESC = "A", "D"


def keys(spec: list[tuple[str, str]]) -> list[Column]:
    return [F.col(c).desc() if way.upper().startswith("D") else F.col(c).asc() for c, way in spec]


def gather(inputs: list[DataFrame], seq: str | None = None) -> DataFrame:
    """USING several files: one after another, file number first in ``_file``."""
    numbered = [df.withColumn("_file", F.lit(i)) for i, df in enumerate(inputs)]
    return reduce(lambda a, b: a.unionByName(b), numbered)


def sort_records(inputs: list[DataFrame], spec: list[tuple[str, str]], seq: str | None = None,
                 input_procedure=None, output_procedure=None) -> DataFrame:
    """Stable sort of the inputs; ``seq`` is the arrival number within a file.

    The procedures are plain DataFrame functions: what RELEASE lets in, and
    what is done with each RETURNed record.
    """
    rows = gather(inputs)
    if input_procedure:
        rows = input_procedure(rows)
    ties = [F.col("_file").asc()] + ([F.col(seq).asc()] if seq else [])
    out = rows.orderBy(*keys(spec), *ties)
    if output_procedure:
        out = output_procedure(out)
    return out.drop("_file")


def merge_records(inputs: list[DataFrame], spec: list[tuple[str, str]], seq: str | None = None) -> DataFrame:
    """MERGE: inputs need not be sorted already; equal keys keep file order."""
    return sort_records(inputs, spec, seq)


def positions(inputs: list[DataFrame], spec: list[tuple[str, str]], seq: str, name: str = "position") -> DataFrame:
    """The sorted records with their place in the output file."""
    rows = gather(inputs)
    return number_rows(rows, [*keys(spec), F.col("_file").asc(), F.col(seq).asc()], name).drop("_file")


def field_keys(fields: list[tuple[int, int, str]], record: str = "value") -> list[Column]:
    """FIELDS=(start,len,fmt,A|D,...): byte ranges compared as text, then the record."""
    out = []
    for start, length, way in fields:
        c = F.substring(F.col(record), start, length)
        out.append(c.desc() if way.upper() == DESC else c.asc())
    return [*out, F.col(record).asc()]


def fields_card(text: str) -> list[tuple[int, int, str]]:
    """The FIELDS operand of a control card: (start, length, direction) of each key.

    A key has four parts, or three if the card gives one format for all keys
    (FORMAT=). The format code is not used: keys compare as text. Anything else
    is refused, never skipped.
    """
    card = text.upper()
    if "FIELDS=(" not in card:
        raise ValueError(f"no FIELDS operand in {text!r}")
    inside, closed, after = card.split("FIELDS=(", 1)[1].partition(")")
    size = 3 if "FORMAT=" in after or "FORMAT=" in card.split("FIELDS=(", 1)[0] else 4
    parts = [p.strip() for p in inside.split(",")]
    out, at = [], 0
    while at < len(parts):
        own = size if size == 4 or at + 2 < len(parts) and parts[at + 2] in (ASC, DESC) else 4
        if own == 4 and at + 2 < len(parts) and parts[at + 2] in (ASC, DESC):
            own = 3               # a key of three parts among keys of four
        key = parts[at:at + own]
        if not closed or len(key) < own or not (key[0].isdigit() and key[1].isdigit()) or key[-1] not in (ASC, DESC):
            raise ValueError(f"cannot read the keys of {text!r}")
        out.append((int(key[0]), int(key[1]), key[-1]))
        at += own
    return out


def utility_sort(lines: DataFrame, card: str, record: str = "value") -> DataFrame:
    return lines.orderBy(*field_keys(fields_card(card), record))
