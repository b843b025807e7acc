"""Counters and totals kept in a read loop: as one aggregate where the order of the
records does not matter, else as functions of what the counter held before."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from decimal import Context, Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from recordloom.functions.numeric import Num, dec, pow10, round_to
from recordloom.picture import Picture, picture

NOT_EXACT = "counter {0} may overflow on the way with both signs; its value depends on record order"
WIDE = Context(prec=76)      # any decimal's digits


def count_if(condition: Column) -> Column:
    """ADD 1 TO counter under a condition."""
    return F.count_if(condition)


def accumulate(amount: Num, pic: str | Picture, name: str) -> list[Column]:
    """ADD amount TO a receiver that starts at zero, once per record.

    Every ADD drops digits beyond the receiver. For amounts of one sign that is
    the same as dropping them once, from the sum. With both signs it is the
    same as long as no fraction is dropped and no step can overflow, which
    holds when the absolute amounts add up to less than the receiver's limit. Otherwise the value
    depends on the order of the records, which an aggregate does not know: it is refused here, and
    worked out by `in_order`.
    """
    p = picture(pic) if isinstance(pic, str) else pic
    step = round_to(amount, p.scale)
    c = step.col
    total = F.coalesce(F.sum(c), F.lit(0).cast(f"decimal({step.digits},{step.scale})"))
    reach = F.coalesce(F.sum(F.abs(c)), F.lit(0).cast(f"decimal({step.digits},{step.scale})"))
    limit = pow10(p.int_digits)
    one_sign = F.coalesce((F.min(c) >= 0) | (F.max(c) <= 0), F.lit(True))
    kept = dec((F.abs(total) if not p.signed else total) % limit, p.digits, p.scale)
    if not p.signed:
        # an unsigned receiver turns negative steps round, so only additions qualify
        one_sign = F.coalesce(F.min(c) >= 0, F.lit(True))
        safe = one_sign
    elif amount.scale > p.scale:
        # dropping fractions of either sign at every step depends on the order
        safe = one_sign
    else:
        safe = one_sign | (reach < limit)
    value = F.when(safe, kept).otherwise(F.raise_error(NOT_EXACT.format(name)).cast(f"decimal({p.digits},{p.scale})"))
    return [value.alias(name), (reach >= limit).alias(f"{name}_wrapped")]


def totals(df: DataFrame, counters: dict[str, Column], sums: dict[str, tuple[Num, str]]) -> DataFrame:
    cols = [F.count_if(c).alias(k) for k, c in counters.items()]
    for name, (amount, pic) in sums.items():
        cols.append(accumulate(amount, pic, name)[0])
    return df.agg(*cols)


# -- in order ----------------------------------------------------------------
class Effect:
    """What some ADDs in a row do to a counter, as a function of what it held.

    One ADD moves the value, and takes it round where it passes the receiver's
    limit, turns it at zero (unsigned) or drops fraction digits towards zero. So
    any number of them is linear in pieces of slope 1 or -1: piece i, from ``low[i]``
    on, gives slope * v + offset. Values are whole numbers of the amount's last digit.
    """

    def __init__(self, limit: int, unit: int, signed: bool):
        self.limit, self.unit, self.signed = limit, unit, signed
        wide = limit > 10**17
        self.kind = object if wide else np.int64
        self.low = np.array([unit - limit if signed else 0], self.kind)      # values are whole multiples of ``unit``
        self.slope, self.offset = np.array([1], self.kind), np.array([0], self.kind)

    def add(self, x: int) -> None:
        limit, unit, signed = self.limit, self.unit, self.signed
        if self.kind is not object and abs(x) > 10**17:
            self.kind = object
            self.low, self.slope, self.offset = (a.astype(object) for a in (self.low, self.slope, self.offset))
        # Where x takes a value to zero, to the limit or a multiple of it; on either side of that the pieces differ.
        least, most = (unit - limit if signed else 0) + x, limit - unit + x
        edges = [0] if least < 0 <= most else []
        edges += [k * limit for k in range(max(1, least // limit), most // limit + 1) if least < k * limit <= most]
        edges += [1 - k * limit for k in range(max(1, -most // limit), -least // limit + 1) if least < 1 - k * limit <= most]
        high = np.append(self.low[1:] - unit, limit - unit)
        for e in edges:
            c = e - x
            at = -(-np.where(self.slope > 0, c - self.offset, self.offset - c + 1) // unit) * unit       # first value of the piece's upper part
            split = np.flatnonzero((at > self.low) & (at <= high))
            if len(split):
                self.low, self.slope, self.offset, high = (
                    np.insert(self.low, split + 1, at[split]), np.insert(self.slope, split + 1, self.slope[split]),
                    np.insert(self.offset, split + 1, self.offset[split]), np.insert(high, split, at[split] - unit))
        first = self.slope * self.low + self.offset + x
        size = abs(first)
        size = (size - size % unit) % limit
        # The sign of a piece is that of any value in it but zero.
        last = self.slope * high + self.offset + x
        below = (first < 0) | (last < 0)
        value = np.where(below & (first != 0), -size if signed else size, size)
        slope = np.where(below & (not signed), -self.slope, self.slope)
        offset = value - slope * self.low
        new = np.concatenate(([True], (slope[1:] != slope[:-1]) | (offset[1:] != offset[:-1])))
        self.low, self.slope, self.offset = self.low[new], slope[new], offset[new]

    def image(self) -> tuple[np.ndarray, np.ndarray]:
        """The ranges (first, last) of the values that it can give, apart from one another."""
        high = np.append(self.low[1:] - self.unit, self.limit - self.unit)
        ends = self.slope * self.low + self.offset, self.slope * high + self.offset
        first, last = np.minimum(*ends), np.maximum(*ends)
        order = np.argsort(first, kind="stable")
        first, last = first[order], np.maximum.accumulate(last[order])
        new = np.concatenate(([True], first[1:] > last[:-1]))
        return first[new], last[np.append(new[1:], True)]

    def forgets_sign(self) -> bool:
        """Whether a signed counter's v and v - limit always come to the same."""
        limit = self.limit
        at = np.unique(np.concatenate(([self.unit], self.low, self.low + limit)))
        at = at[(at >= self.unit) & (at < limit)]
        i, j = (np.searchsorted(self.low, x, "right") - 1 for x in (at, at - limit))
        return bool(np.all((self.slope[i] == self.slope[j]) & (self.offset[i] == self.offset[j] - self.slope[j] * limit)))


#: Pieces from which on the values that they can give are counted, and how many of these a piece may stand for.
SOME_PIECES, POINTS_A_PIECE = 256, 8
#: Amounts worked in at once.
CHUNK = 1 << 16


class Run:
    """What a row of ADDs does to a counter, whose value before is known (``start``) or not.

    A known value is carried on as a number. Else the ADDs are an `Effect`. Each one that turns
    or wraps values splits pieces, but lays values over one another too: once few are left
    that the counter can hold at all, each of them is carried on instead, and those that meet
    go on as one. A signed counter that drops no fractions keeps its rest by the limit whatever
    its sign was, so only the ADDs since which the sign no longer matters are gone through singly.
    """

    def __init__(self, limit: int, unit: int, signed: bool, start: int | None = None):
        self.limit, self.unit, self.signed, self.value = limit, unit, signed, start
        self.effect = None if start is not None else Effect(limit, unit, signed)
        self.check = SOME_PIECES
        self.at = self.now = self.to = None      # values after the effect, those they have come to, and which of these each has

    def add(self, amounts: list[int]) -> None:
        if self.value is not None:
            self.value = self._fold(self.value, amounts)
        elif self.at is not None:
            self._carry(amounts)
        elif self.signed and (self.unit == 1 or all(x % self.unit == 0 for x in amounts)):
            self._signed(amounts)
        else:
            self._pieces(amounts)

    def _fold(self, v: int, amounts: list[int]) -> int:
        limit, unit, signed = self.limit, self.unit, self.signed
        for x in amounts:
            v += x
            if v < 0:
                v = -(-v - -v % unit) % -limit if signed else (-v - -v % unit) % limit
            else:
                v = (v - v % unit) % limit
        return v

    def _signed(self, amounts: list[int]) -> None:
        n = 64
        while n < len(amounts):
            tail = Effect(self.limit, self.unit, True)
            for x in amounts[-n:]:
                tail.add(x)
            if tail.forgets_sign():
                self.effect.add(sum(amounts[:-n]) % self.limit)
                amounts = amounts[-n:]
                break
            n *= 4
        for x in amounts:
            self.effect.add(x)

    def _pieces(self, amounts: list[int]) -> None:
        effect = self.effect
        for i, x in enumerate(amounts):
            effect.add(x)
            if len(effect.low) >= self.check and effect.kind is not object:
                self.check = 2 * len(effect.low)
                first, last = effect.image()
                if int(((last - first) // self.unit + 1).sum()) <= POINTS_A_PIECE * len(effect.low):
                    self.at = np.concatenate([np.arange(a, b + 1, self.unit) for a, b in zip(first, last, strict=True)])
                    self.now, self.to = self.at, np.arange(len(self.at))
                    return self._carry(amounts[i + 1 :])

    def _carry(self, amounts: list[int]) -> None:
        limit, unit, signed, now = self.limit, self.unit, self.signed, self.now
        for i, x in enumerate(amounts):
            if len(now) == 1:
                now = np.array([self._fold(int(now[0]), amounts[i:])], now.dtype)
                break
            if abs(x) > 10**17 and now.dtype != object:
                now = now.astype(object)
            now = now + x
            size = abs(now)
            if unit > 1:
                size -= size % unit
            size %= limit
            now = np.where(now < 0, -size, size) if signed else size
            if i % 256 == 255:
                now, same = np.unique(now, return_inverse=True)
                self.to = same[self.to]
        self.now = now

    def told(self) -> list[list[int]]:
        """As lists: a known value, or the effect's pieces and, where values were carried on, what they came to."""
        if self.value is not None:
            return [[self.value]]
        pieces = [a.tolist() for a in (self.effect.low, self.effect.slope, self.effect.offset)]
        return pieces if self.at is None else [*pieces, self.at.tolist(), self.now[self.to].tolist()]


def applied(told: list[list[int]], v: int) -> int:
    """What a counter that held ``v`` holds after a `Run`."""
    if len(told) == 1:
        return told[0][0]
    low, slope, offset, *carried = told
    i = bisect_right(low, v) - 1
    v = slope[i] * v + offset[i]
    return carried[1][bisect_left(carried[0], v)] if carried else v


def _effects(n_keys: int, counters: list[tuple[int, int, bool, int]]):
    """Rows in order (key columns, amounts) to one row a key and task: its number and what its rows do."""

    def run(batches):
        part = TaskContext.get().partitionId()
        current, runs, amounts, out, schema, first = None, None, None, [], None, True

        def work_in():
            for r, some in zip(runs, amounts, strict=True):
                r.add(some)
                some.clear()

        def row():
            work_in()
            return (*current, part, *[[[str(x) for x in a] for a in r.told()] for r in runs])

        def flush():
            kinds = [*[schema.field(i).type for i in range(n_keys)], pa.int32(), *[pa.list_(pa.list_(pa.string()))] * len(counters)]
            names = [*schema.names[:n_keys], "_part", *[f"_e{i}" for i in range(len(counters))]]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            schema = batch.schema
            columns = [c.to_pylist() for c in batch.columns[: n_keys + len(counters)]]
            for i, (_, _, _, scale) in enumerate(counters, n_keys):
                if pa.types.is_decimal(schema.field(i).type):
                    columns[i] = [x if x is None else int(x.scaleb(scale, WIDE)) for x in columns[i]]
            for values in zip(*columns, strict=True):
                key = values[:n_keys]
                if runs is None or key != current:
                    if runs is not None:
                        out.append(row())
                        first = False
                        if len(out) >= 5_000:
                            yield flush()
                            out = []
                    # only the first key of a task can have begun in one before
                    current, runs = key, [Run(limit, unit, signed, None if first and part else 0) for limit, unit, signed, _ in counters]
                    amounts = [[] for _ in counters]
                for some, x in zip(amounts, values[n_keys:], strict=True):
                    if x is not None:
                        some.append(x)
                if any(len(some) >= CHUNK for some in amounts):
                    work_in()
        if runs is not None:
            out.append(row())
            yield flush()

    return run


def _outcome(n_keys: int, counters: list[tuple[int, int, bool, int]], kinds: list[pa.DataType]):
    """One row a key and task, in order, to one row a key: what the counters hold at the end."""

    def run(batches):
        current, held, out, schema = None, None, [], None

        def ended():
            # whole multiples of the receiver's last digit, so nothing is dropped here
            return [Decimal(v // unit).scaleb(len(str(unit)) - 1 - scale, WIDE) for v, (_, unit, _, scale) in zip(held, counters, strict=True)]

        def flush():
            fields = [*[schema.field(i).type for i in range(n_keys)], *kinds]
            names = [*schema.names[:n_keys], *[f"_c{i}" for i in range(len(counters))]]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), fields, strict=True)], names=names)

        for batch in batches:
            schema = batch.schema
            for values in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                key = values[:n_keys]
                if held is None or key != current:
                    if held is not None:
                        out.append((*current, *ended()))
                    current, held = key, [0] * len(counters)
                held = [applied([[int(x) for x in a] for a in told], v) for told, v in zip(values[n_keys + 1 :], held, strict=True)]
            if len(out) >= 5_000:
                yield flush()
                out = []
        if held is not None:
            out.append((*current, *ended()))
            yield flush()

    return run


def in_order(df: DataFrame, keys: list[str], seq: str, sums: dict[str, tuple[Num, str | Picture]], partitions: int | None = None) -> DataFrame:
    """ADD each amount TO its receiver, which starts at zero, in ``seq`` order along each key, or all rows
    without ``keys``; the receivers' last values. Overflow, signs and dropped fractions count at every step.

    Rows are ranged by key and ``seq``, so a key with any number of rows is spread over tasks. A task works
    out what its rows do to whatever the counter held (`Run`); one row a key and task is applied in turn. A null
    amount adds nothing. Without keys an empty table gives one row of zeros.
    """
    pics = [picture(p) if isinstance(p, str) else p for _, p in sums.values()]
    amounts = [a for a, _ in sums.values()]
    scales = [max(a.scale, p.scale) for a, p in zip(amounts, pics, strict=True)]
    counters = [(10 ** (p.int_digits + s), 10 ** (s - p.scale), p.signed, s) for p, s in zip(pics, scales, strict=True)]
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = {k: df.schema[k].dataType.simpleString() for k in keys}
    typed = ", ".join(f"`{k}` {t}" for k, t in schema.items())
    whole = lambda a, s: (a.col * F.lit(10**s)).cast("bigint") if a.digits + s - a.scale <= 17 else a.col
    rows = df.select(*keys, *[whole(a, s).alias(f"_a{i}") for i, (a, s) in enumerate(zip(amounts, scales, strict=True))], seq).repartitionByRange(n, *keys, seq).sortWithinPartitions(*keys, seq)
    parts = rows.drop(seq) if seq not in keys else rows
    pieces = ", ".join(f"_e{i} array<array<string>>" for i in range(len(sums)))
    effects = parts.mapInArrow(_effects(len(keys), counters), f"{typed + ', ' if typed else ''}_part int, {pieces}")
    # a shuffle in either case: coalesced, all ranges would be worked out by one task, each under its number
    together = effects.repartition(*keys) if keys else effects.repartition(1)
    kinds = [pa.decimal128(p.digits, p.scale) for p in pics]
    values = ", ".join(f"_c{i} decimal({p.digits},{p.scale})" for i, p in enumerate(pics))
    out = together.sortWithinPartitions(*keys, "_part").mapInArrow(_outcome(len(keys), counters, kinds), f"{typed + ', ' if typed else ''}{values}")
    named = out.select(*keys, *[F.col(f"_c{i}").alias(name) for i, name in enumerate(sums)])
    if keys:
        return named
    return named.agg(*[F.coalesce(F.max(c), F.lit(0).cast(named.schema[c].dataType)).alias(c) for c in named.columns])
