"""Numeric-edited pictures compiled to Column expressions.

The picture is laid out once with every digit and insertion in place. Zero
suppression only ever rewrites a prefix of that text, and the prefix depends on
nothing but the count of leading zeros (and the sign, for a floating sign), so
all prefixes are made while the plan is built and looked up per row.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from recordloom.functions.numeric import NEAREST_AWAY, Num, TRUNCATION, as_num, pow10, round_to, dec
from recordloom.picture import EDITED, picture


def _sign(negative: Column, minus: str, plus: str) -> Column:
    return F.when(negative, minus).otherwise(plus)


def edit(value, pic: str, rounded: bool = True) -> Column:
    p = picture(pic)
    if p.kind != EDITED:
        raise ValueError(f"{pic} is not numeric-edited")
    n: Num = as_num(value)
    body = p.text
    negative = n.col < 0

    # trailing sign or CR / DB
    suffix = None
    if body.endswith(("CR", "DB")):
        suffix, body = _sign(negative, body[-2:], "  "), body[:-2]
    elif body[-1] in "+-" and body.count(body[-1]) == 1:
        suffix, body = _sign(negative, "-", "+" if body[-1] == "+" else " "), body[:-1]

    # one leading symbol is fixed; several of the same float
    floating = next((c for c in "$+-" if body.split(".")[0].count(c) > 1), None)
    fixed = None
    while body[:1] in ("$", "+", "-") and body[:1] != floating:
        c, body = body[0], body[1:]
        piece = F.lit("$") if c == "$" else _sign(negative, "-", "+" if c == "+" else " ")
        fixed = piece if fixed is None else F.concat(fixed, piece)

    whole = body.partition(".")[0]
    cells: list[int | str] = []      # digit number, or the inserted character
    quiet: list[bool] = []           # digit number -> may be suppressed
    seen_float = False
    for c in body:
        if c in "9Z*" or (c == floating and seen_float):
            cells.append(len(quiet))
            quiet.append(c != "9")
        elif c == floating:
            seen_float = True
            cells.append(c)
        else:
            cells.append(" " if c == "B" else c)
    ints = len(quiet) - p.scale
    most = next((i for i, q in enumerate(quiet[:ints]) if not q), ints)
    fill = "*" if "*" in body else " "

    r = round_to(n, p.scale, NEAREST_AWAY if rounded else TRUNCATION)
    whole_digits = min(38, r.ints + p.scale)
    unscaled = dec(F.abs(r.col) * pow10(p.scale) if p.scale else F.abs(r.col), whole_digits, 0)
    wide = max(len(quiet), whole_digits)
    digits = F.lpad(unscaled.cast("string"), wide, "0")
    if wide > len(quiet):
        digits = F.right(digits, F.lit(len(quiet)))

    # the text with nothing suppressed: runs of digits and insertions
    pieces, run = [], None
    for cell in cells:
        if isinstance(cell, int):
            run = (run[0], run[1] + 1) if run else (cell, 1)
        else:
            if run:
                pieces.append(digits.substr(run[0] + 1, run[1]))
                run = None
            pieces.append(F.lit(cell))
    if run:
        pieces.append(digits.substr(run[0] + 1, run[1]))
    full = F.concat(*pieces)

    text = full
    if most or floating:
        spots = [i for i, c in enumerate(cells) if isinstance(c, int)] + [len(cells)]
        ends = [spots[k] if k < ints else len(whole) for k in range(most + 1)]

        def prefixes(symbol: str) -> Column:
            return F.array(*[F.lit((fill * e)[:-1] + symbol if floating and e else fill * e) for e in ends])

        zeros = F.lit(ints) - F.length(F.ltrim(digits.substr(1, ints), F.lit("0"))) if ints else F.lit(0)
        at = F.least(zeros, F.lit(most)) + 1
        if floating == "$":
            table = prefixes("$")
        elif floating:
            table = F.when(negative, prefixes("-")).otherwise(prefixes("+" if floating == "+" else " "))
        else:
            table = prefixes("")
        text = F.overlay(full, F.element_at(table, at), 1)
    out = [x for x in (fixed, text, suffix) if x is not None]
    result = F.concat(*out) if len(out) > 1 else out[0]
    if quiet and all(quiet):
        blank = "".join("." if c == "." and fill == "*" else fill for c in p.text)
        zero = r.col == 0
        result = F.when(zero, F.lit(blank)).otherwise(result)
    return result
