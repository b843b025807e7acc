"""Record layouts: copybook text to schema, decode and encode expressions.

A layout never touches rows. It gives one Column per leaf over a slice of the
raw record, so a query that needs two fields decodes two fields.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field as dc_field
from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F, types as T

from recordloom.functions import codecs
from recordloom.functions.conditions import condition_name
from recordloom.functions.numeric import Num, store
from recordloom.picture import NUMERIC, Picture, picture

PACKED = ("COMP-3", "PACKED-DECIMAL")
BINARY = ("COMP", "BINARY", "COMP-4", "COMP-5")


class LayoutError(ValueError):
    pass


def column_name(name: str) -> str:
    return name.lower().replace("-", "_")


@dataclass
class Field:
    level: int
    name: str
    pic: Picture | None = None
    usage: str = "DISPLAY"
    sign_leading: bool = False
    sign_separate: bool = False
    occurs: int = 0
    occurs_min: int = 0
    depending_on: str | None = None
    redefines: str | None = None
    value: str | None = None
    children: list["Field"] = dc_field(default_factory=list)
    conditions: dict[str, list] = dc_field(default_factory=dict)
    offset: int = 0          # in the record, or in the enclosing table entry
    binary_storage: bool = False

    @property
    def column(self) -> str:
        return column_name(self.name)

    @property
    def filler(self) -> bool:
        return self.name == "FILLER"

    @property
    def unit(self) -> int:
        """Bytes of one occurrence."""
        if self.children:
            return sum(c.length for c in self.children if not c.redefines)
        if self.pic is None and self.usage not in ("COMP-1", "COMP-2"):
            raise LayoutError(f"{self.name} has no PICTURE")
        if self.usage == "COMP-1":
            return 4
        if self.usage == "COMP-2":
            return 8
        if self.usage in PACKED:
            return codecs.packed_bytes(self.pic.digits)
        if self.usage in BINARY and self.binary_storage:
            return codecs.binary_bytes(self.pic.digits)
        return self.pic.width + (1 if self.sign_separate else 0)

    @property
    def length(self) -> int:
        return self.unit * (self.occurs or 1)

    def leaf_type(self) -> T.DataType:
        if self.usage == "COMP-1":
            return T.FloatType()
        if self.usage == "COMP-2":
            return T.DoubleType()
        if self.pic.kind == NUMERIC:
            return T.DecimalType(self.pic.digits, self.pic.scale)
        return T.StringType()

    def data_type(self) -> T.DataType:
        one = (T.StructType([T.StructField(c.column, c.data_type()) for c in self.children if not c.filler])
               if self.children else self.leaf_type())
        return T.ArrayType(one) if self.occurs else one


@dataclass
class Slicer:
    """Cuts a raw record column; lines are text, fixed records are bytes."""
    raw: Column
    is_binary: bool

    def bytes(self, start: Column | int, length: int) -> Column:
        at = start + 1 if isinstance(start, int) else start + F.lit(1)
        piece = self.raw.substr(at, length) if isinstance(at, int) else self.raw.substr(at, F.lit(length))
        return piece if self.is_binary else F.encode(piece, "ISO-8859-1")

    def text(self, start: Column | int, length: int) -> Column:
        at = start + 1 if isinstance(start, int) else start + F.lit(1)
        piece = self.raw.substr(at, length) if isinstance(at, int) else self.raw.substr(at, F.lit(length))
        return F.decode(piece, "ISO-8859-1") if self.is_binary else piece


class Layout:
    def __init__(self, name: str, fields: list[Field], constants: dict[str, str] | None = None):
        self.name = name
        self.fields = fields
        self.constants = constants or {}
        self._place(fields, 0)

    # -- structure -----------------------------------------------------------
    def _place(self, fields: list[Field], base: int) -> None:
        at, seen = base, {}
        for f in fields:
            if f.redefines:
                if f.redefines not in seen:
                    raise LayoutError(f"{f.name} redefines unknown item {f.redefines}")
                f.offset = seen[f.redefines]
            else:
                f.offset = at
                at += f.length
            seen[f.name] = f.offset
            self._place(f.children, 0 if f.occurs else f.offset)

    @property
    def length(self) -> int:
        return max((f.offset + f.length for f in self.fields), default=0)

    def leaves(self) -> list[Field]:
        out: list[Field] = []

        def walk(fs):
            for f in fs:
                walk(f.children) if f.children else out.append(f)

        walk(self.fields)
        return out

    def find(self, name: str) -> Field:
        stack = list(self.fields)
        while stack:
            f = stack.pop()
            if f.name == name.upper() or f.column == name:
                return f
            stack.extend(f.children)
        raise LayoutError(f"no item {name} in {self.name}")

    def schema(self) -> T.StructType:
        out = T.StructType()
        for f in self.fields:
            if not f.filler:
                meta = {"offset": f.offset, "length": f.length, "usage": f.usage,
                        "picture": f.pic.text if f.pic else ""}
                out.add(T.StructField(f.column, f.data_type(), True, meta))
        return out

    def condition(self, name: str, subject: Column | None = None) -> Column:
        """A level-88 name as a predicate on its item."""
        stack = list(self.fields)
        while stack:
            f = stack.pop()
            if name.upper() in f.conditions:
                values = f.conditions[name.upper()]
                if f.pic and f.pic.kind == NUMERIC:
                    values = [tuple(map(Decimal, v)) if isinstance(v, tuple) else Decimal(v) for v in values]
                return condition_name(F.col(f.column) if subject is None else subject, values)
            stack.extend(f.children)
        raise LayoutError(f"no condition {name} in {self.name}")

    # -- decode --------------------------------------------------------------
    def _decode_leaf(self, f: Field, s: Slicer, start) -> Column:
        if f.usage in PACKED:
            return codecs.decode_packed(s.bytes(start, f.unit), f.pic)
        if f.usage in ("COMP-1", "COMP-2"):
            return codecs.decode_float(s.bytes(start, f.unit), f.unit)
        if f.usage in BINARY and f.binary_storage:
            return codecs.decode_binary(s.bytes(start, f.unit), f.pic)
        text = s.text(start, f.unit)
        if f.pic.kind == NUMERIC:
            return codecs.decode_zoned(text, f.pic, f.sign_leading, f.sign_separate)
        return F.rtrim(text)

    def _decode(self, f: Field, s: Slicer, base) -> Column:
        """``base`` is 0, or the start of the enclosing table entry."""
        start = f.offset if isinstance(base, int) and base == 0 else base + F.lit(f.offset)

        def one(at, inner_base) -> Column:
            if not f.children:
                return self._decode_leaf(f, s, at)
            return F.struct(*[self._decode(c, s, inner_base).alias(c.column) for c in f.children if not c.filler])

        if not f.occurs:
            return one(start, base)
        first = start if isinstance(start, Column) else F.lit(start)
        items = F.transform(F.sequence(F.lit(0), F.lit(f.occurs - 1)),
                            lambda i: one(first + i * F.lit(f.unit), first + i * F.lit(f.unit)))
        if f.depending_on:
            count = self._decode(self.find(f.depending_on), s, 0).cast("int")
            items = F.slice(items, F.lit(1), F.least(F.greatest(count, F.lit(0)), F.lit(f.occurs)))
        return items

    def columns(self, raw: Column, is_binary: bool) -> list[Column]:
        s = Slicer(raw, is_binary)
        return [self._decode(f, s, 0).alias(f.column) for f in self.fields if not f.filler]

    def decode(self, df: DataFrame, raw: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
        is_binary = isinstance(df.schema[raw].dataType, T.BinaryType)
        return df.select(*keep, *self.columns(F.col(raw), is_binary))

    # -- encode --------------------------------------------------------------
    def _encode_leaf(self, f: Field, value: Column, binary: bool) -> Column:
        if f.pic is not None and f.pic.kind == NUMERIC:
            # a value that does not fit loses fraction digits, then high-order digits
            scale = max(18, f.pic.scale)
            value = store(Num(F.coalesce(value, F.lit(0)).cast(f"decimal(38,{scale})"), 38, scale), f.pic).value
        if f.usage in PACKED:
            raw = codecs.encode_packed(value, f.pic)
            return raw if binary else F.decode(raw, "ISO-8859-1")
        if f.usage in BINARY and f.binary_storage:
            raw = codecs.encode_binary(value, f.pic)
            return raw if binary else F.decode(raw, "ISO-8859-1")
        if f.usage in ("COMP-1", "COMP-2"):
            raise LayoutError(f"{f.name}: floating items are read only")
        if f.pic.kind == NUMERIC:
            text = codecs.encode_zoned(value, f.pic, f.sign_leading, f.sign_separate)
        else:
            text = F.rpad(F.coalesce(value, F.lit("")), f.unit, " ")
        return F.encode(text, "ISO-8859-1") if binary else text

    def _encode(self, f: Field, value: Column | None, binary: bool) -> Column:
        def blank(width: int) -> Column:
            return F.lit(b" " * width) if binary else F.lit(" " * width)

        if f.filler and not f.children or value is None:
            return blank(f.length)

        def one(v: Column) -> Column:
            if not f.children:
                return self._encode_leaf(f, v, binary)
            parts = [self._encode(c, None if c.filler else v.getField(c.column), binary)
                     for c in f.children if not c.redefines]
            return F.concat(*parts)

        if not f.occurs:
            return one(value)
        entries = [one(F.get(value, F.lit(i))) for i in range(f.occurs)]
        return F.concat(*entries)

    def record(self, binary: bool = False, present: set[str] | None = None) -> Column:
        """The whole record as one column; items without a column are blank."""
        parts = []
        for f in self.fields:
            if f.redefines:
                continue
            have = not f.filler and (present is None or f.column in present)
            parts.append(self._encode(f, F.col(f.column) if have else None, binary))
        return F.concat(*parts)

    def encode(self, df: DataFrame, name: str = "value", binary: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
        return df.select(*keep, self.record(binary, set(df.columns)).alias(name))


# -- copybook text -----------------------------------------------------------
_CLAUSES = re.compile(
    r"""REDEFINES\s+(?P<redefines>[\w-]+)
      | PIC(?:TURE)?\s+(?:IS\s+)?(?P<pic>\S+)
      | OCCURS\s+(?P<lo>\d+)(?:\s+TO\s+(?P<hi>\d+))?(?:\s+TIMES)?(?:\s+DEPENDING\s+(?:ON\s+)?(?P<dep>[\w-]+))?
      | SIGN\s+(?:IS\s+)?(?P<sign>LEADING|TRAILING)(?P<sep>\s+SEPARATE(?:\s+CHARACTER)?)?
      | VALUES?\s+(?:IS\s+|ARE\s+)?(?P<value>.+)$
      | (?:USAGE\s+(?:IS\s+)?)?(?P<usage>COMP-[1-5]|COMP|BINARY|PACKED-DECIMAL|DISPLAY|POINTER)
    """,
    re.VERBOSE | re.IGNORECASE,
)
_LITERAL = re.compile(r"""'[^']*'|"[^"]*"|THRU|THROUGH|[^\s,]+""", re.IGNORECASE)


def _values(text: str) -> list:
    """VALUE list: single literals, and pairs for THRU."""
    out: list = []
    words = [w[1:-1] if w[0] in "'\"" else w for w in _LITERAL.findall(text)]
    i = 0
    while i < len(words):
        if i + 2 < len(words) and words[i + 1].upper() in ("THRU", "THROUGH"):
            out.append((words[i], words[i + 2]))
            i += 3
        else:
            out.append(words[i])
            i += 1
    return out


def _entries(text: str) -> list[str]:
    lines = []
    for line in text.splitlines():
        if len(line) > 6 and re.fullmatch(r"\d{6}| {6}", line[:6]):
            line = line[6:72]
        if line.lstrip().startswith("*"):
            continue
        lines.append(line)
    body = " ".join(lines)
    return [e.strip() for e in re.split(r"\.(?=\s|$)(?=(?:[^'\"]*['\"][^'\"]*['\"])*[^'\"]*$)", body) if e.strip()]


def copybook(text: str, binary_storage: bool = False, default_name: str = "RECORD") -> Layout:
    """A layout from data-description entries.

    ``binary_storage`` keeps COMP items as big-endian binary; by default they
    are stored as digits.
    """
    root: list[Field] = []
    stack: list[Field] = []
    constants: dict[str, str] = {}
    name = default_name
    for entry in _entries(text):
        m = re.match(r"(\d{1,2})\s*([\w-]+)?\s*(.*)$", entry, re.DOTALL)
        if not m:
            raise LayoutError(f"not a data description: {entry!r}")
        level, item, rest = int(m[1]), (m[2] or "FILLER").upper(), m[3]
        if item in ("PIC", "PICTURE", "REDEFINES", "OCCURS", "VALUE"):
            rest, item = f"{m[2]} {rest}", "FILLER"
        if level == 66:
            raise LayoutError("level 66 is not supported")
        if level == 78:
            constants[item] = _values(_CLAUSES.search(rest)["value"])[0]
            continue
        f = Field(level, item, binary_storage=binary_storage)
        left = re.sub(r"\b(IS|ARE|TIMES|GLOBAL|EXTERNAL|USAGE|INDEXED\s+(BY\s+)?[\w-]+|(ASCENDING|DESCENDING)\s+(KEY\s+)?(IS\s+)?[\w-]+)\b", " ", _CLAUSES.sub(" ", rest), flags=re.I)
        if level != 88 and re.search(r"\w", left):
            raise LayoutError(f"{item}: clause {left.strip()!r} is not supported")
        for c in _CLAUSES.finditer(rest):
            if c["redefines"]:
                f.redefines = c["redefines"].upper()
            elif c["pic"]:
                f.pic = picture(c["pic"])
            elif c["lo"]:
                f.occurs = int(c["hi"] or c["lo"])
                f.occurs_min = int(c["lo"])
                f.depending_on = c["dep"].upper() if c["dep"] else None
            elif c["sign"]:
                f.sign_leading = c["sign"].upper() == "LEADING"
                f.sign_separate = bool(c["sep"])
            elif c["usage"]:
                f.usage = c["usage"].upper()
            elif c["value"]:
                f.value = c["value"].strip()
        if level == 88:
            if not stack:
                raise LayoutError(f"condition {item} has no item")
            stack[-1].conditions[item] = _values(f.value or "")
            continue
        if f.usage == "POINTER":
            raise LayoutError(f"{item}: pointers have no column form")
        if level == 1 and f.pic is None and not root:
            name, stack = item, []
            continue
        if level == 1 and root and not f.redefines:
            # records of one file share their storage: the first becomes a group, the others lie over it
            if not (len(root) and root[0].level == 1):
                root = [Field(1, name, binary_storage=binary_storage, children=root)]
            f.redefines, stack = root[0].name, []
        while stack and stack[-1].level >= level:
            stack.pop()
        (stack[-1].children if stack else root).append(f)
        stack.append(f)
    return Layout(name, root, constants)
