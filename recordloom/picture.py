"""PICTURE clauses: what a field holds and how wide it is."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

ALNUM, NUMERIC, EDITED = "alnum", "numeric", "edited"


class PictureError(ValueError):
    pass


@dataclass(frozen=True)
class Picture:
    text: str        # repeat counts written out, e.g. S9(2)V9 -> S99V9
    kind: str
    digits: int      # numeric and edited pictures: digit positions
    scale: int
    signed: bool
    width: int       # characters in DISPLAY storage, sign byte not included

    @property
    def int_digits(self) -> int:
        return self.digits - self.scale

    @property
    def sql_type(self) -> str:
        return f"decimal({self.digits},{self.scale})" if self.kind == NUMERIC else "string"


def expand(text: str) -> str:
    return re.sub(r"(.)\((\d+)\)", lambda m: m[1] * int(m[2]), text.upper().strip().rstrip("."))


@lru_cache(maxsize=4096)
def picture(text: str) -> Picture:
    body = expand(text)
    if re.fullmatch(r"[XA9]*[XA][XA9]*", body):
        return Picture(body, ALNUM, 0, 0, False, len(body))
    plain = re.fullmatch(r"(S?)(9*)(?:V(9*))?", body)
    if plain and (plain[2] or plain[3]):
        scale = len(plain[3] or "")
        digits = len(plain[2]) + scale
        return Picture(body, NUMERIC, digits, scale, bool(plain[1]), digits)
    if re.fullmatch(r"[9Z*$+\-,.B0/V]+(CR|DB)?", body):
        whole, _, frac = body.partition(".")
        scale = len(re.findall(r"[9Z*]", frac))
        floats = [c for c in "$+-" if whole.count(c) > 1]
        holders = len(re.findall(r"[9Z*]", whole)) + sum(whole.count(c) - 1 for c in floats)
        signed = any(m in body for m in ("+", "-", "CR", "DB"))
        return Picture(body, EDITED, holders + scale, scale, signed, len(body))
    raise PictureError(f"unsupported PICTURE {text!r}")
