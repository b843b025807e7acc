"""Keyed datasets: lookups, positioning and batches of writes, as joins.

Outcomes are file-status codes in a column: 00 done, 02 done with a repeated
alternate key, 10 end, 22 duplicate key, 23 not found, 46 read past the end.
Requests carry an arrival number (``seq``, a unique whole number); earlier
requests win. Joins back to the requests go on ``seq`` wherever one side is
already reduced to a row per key, so a hot key does not pile up in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from recordloom.operators.graph import connected
from recordloom.operators.ordering import BLOCK_ROWS, next_key, number_rows, scan_by_key
from recordloom.session import cut

OK, OK_DUPLICATE, END, DUPLICATE, MISSING, PAST_END = "00", "02", "10", "22", "23", "46"
WRITE, REWRITE, DELETE, READ = "WRITE", "REWRITE", "DELETE", "READ"


@dataclass(frozen=True)
class Alternate:
    name: str
    duplicates: bool = False


@dataclass(frozen=True)
class KeySpec:
    key: str
    alternates: tuple[Alternate, ...] = ()

    @property
    def unique(self) -> list[str]:
        return [a.name for a in self.alternates if not a.duplicates]

    @property
    def repeated(self) -> list[str]:
        return [a.name for a in self.alternates if a.duplicates]


@dataclass(frozen=True)
class BatchResult:
    master: DataFrame
    outcomes: DataFrame    # the requests with a status column


def _record(columns: list[str]) -> Column:
    return F.struct(*columns)


# -- opening -----------------------------------------------------------------
def load(records: DataFrame, key: str, seq: str) -> DataFrame:
    """First record per key wins; arrival order is ``seq``."""
    body = [c for c in records.columns if c != seq]
    first = records.groupBy(key).agg(F.min_by(_record(body), F.col(seq)).alias("_r"))
    return first.select("_r.*")


# -- reading -----------------------------------------------------------------
def read_key(requests: DataFrame, master: DataFrame, by: str, key: str, strip_zeros: bool = False) -> DataFrame:
    """READ by primary key: request columns, the record's columns, status.

    With ``strip_zeros`` a miss is tried again with leading zeros removed.
    """
    found = master.withColumn("_hit", F.lit(True))
    hit = requests.join(found, F.col(by) == F.col(key), "left")
    if not strip_zeros:
        return hit.withColumn("status", F.when(F.col("_hit").isNull(), MISSING).otherwise(OK)).drop("_hit")
    again = master.select(*[F.col(c).alias(f"_2{c}") for c in master.columns], F.lit(True).alias("_hit2"))
    bare = F.ltrim(F.col(by), F.lit("0"))
    # a key without leading zeros has nothing to retry: give it a value that
    # matches nothing but still spreads over the partitions
    retry = F.when(bare == F.col(by), F.concat(F.lit("\u0000"), F.col(by))).otherwise(bare)
    both = hit.withColumn("_retry", retry).join(again, F.col("_retry") == F.col(f"_2{key}"), "left")
    pick = [F.when(F.col("_hit").isNull(), F.col(f"_2{c}")).otherwise(F.col(c)).alias(c) for c in master.columns]
    status = F.when(F.col("_hit").isNull() & F.col("_hit2").isNull(), MISSING).otherwise(OK)
    return both.select(*requests.columns, *pick, status.alias("status"))


def first_by_alternate(master: DataFrame, alternate: str, key: str) -> DataFrame:
    """One record per alternate value: the one with the lowest primary key."""
    first = master.groupBy(alternate).agg(F.min_by(_record(master.columns), F.col(key)).alias("_r"))
    return first.select("_r.*")


def read_alternate(requests: DataFrame, master: DataFrame, by: str, alternate: str, key: str) -> DataFrame:
    return read_key(requests, first_by_alternate(master, alternate, key), by, alternate)


def read_sequential(master: DataFrame, key: str, tie: str | None = None) -> DataFrame:
    """READ NEXT from the start: every record in key order."""
    return master.orderBy(key, *([tie] if tie else []))


def start_each(requests: DataFrame, master: DataFrame, by: str, key: str, seq: str, relation: str = ">=") -> DataFrame:
    """A START per request: the key it positions on, and 00 or 23."""
    if relation == "=":
        return read_key(requests, master.select(key), by, key)
    if relation not in (">", ">=", "NOT <"):
        raise ValueError(f"START does not take {relation!r}")
    found = next_key(requests, master.select(key), by, key, seq, after=relation == ">")
    return found.withColumn("status", F.when(F.col(key).isNull(), MISSING).otherwise(OK))


def start(master: DataFrame, key: str, relation: str, value, tie: str | None = None) -> DataFrame:
    """START then READ NEXT to the end: the records in key order from there.

    An alternate key orders by (alternate, primary); name the primary in ``tie``.
    """
    c = F.col(key)
    tests = {"=": c == value, ">": c > value, ">=": c >= value, "NOT <": c >= value}
    if relation not in tests:
        raise ValueError(f"START does not take {relation!r}")
    # equality only positions; reading goes on through the higher keys
    if relation == "=":
        if master.where(tests["="]).isEmpty():
            return master.limit(0)
        return master.where(c >= value).orderBy(key, *([tie] if tie else []))
    return master.where(tests[relation]).orderBy(key, *([tie] if tie else []))


def start_status(master: DataFrame, key: str, relation: str, value) -> DataFrame:
    c = F.col(key)
    test = {"=": c == value, ">": c > value, ">=": c >= value, "NOT <": c >= value}[relation]
    return master.agg(F.when(F.count(F.when(test, 1)) > 0, OK).otherwise(MISSING).alias("status"))


def sequential_status(reads: Column, records: Column) -> Column:
    """Outcome of the n-th READ NEXT on a file of that many records."""
    return F.when(reads <= records, OK).when(reads == records + 1, END).otherwise(PAST_END)


# -- writing -----------------------------------------------------------------
def _first_per(df: DataFrame, column: str, seq: str) -> DataFrame:
    return df.groupBy(column).agg(F.min(seq).alias(seq))


def _not_taken(df: DataFrame, master: DataFrame, column: str, repeated: bool = False) -> DataFrame:
    """Rows whose value the master does not hold.

    Where the master may repeat the value, its copies are folded before the
    shuffle, so a value most records share stays one row.
    """
    values = master.select(column)
    return df.join(values.distinct() if repeated else values, column, "left_anti")


def _accepted_primary(master: DataFrame, requests: DataFrame, key: str, seq: str) -> DataFrame:
    return _not_taken(_first_per(requests, key, seq), master, key).select(seq)


# -- unique alternates -------------------------------------------------------
def _conflicts(master: DataFrame, requests: DataFrame, spec: KeySpec, seq: str) -> DataFrame:
    """(seq, part): requests that can affect one another have one part.

    A request touches its key, the alternates it asks for, and those that its
    key's record holds. Requests that touch a value in common are linked to the
    first of them, and parts are what links join; a request alone is its own part.
    """
    held = master.select(F.col(spec.key).alias("_k"), *[F.col(a).alias(f"_h_{a}") for a in spec.unique])
    met = requests.join(held, F.col(spec.key) == F.col("_k"), "left")
    value = lambda n, c: F.struct(F.lit(n).alias("n"), F.col(c).cast("string").alias("v"))
    touched = F.array(value(0, spec.key), *[value(n, c) for n, a in enumerate(spec.unique, 1) for c in (a, f"_h_{a}")])
    values = cut(met.select(seq, F.explode(F.array_distinct(touched)).alias("_t")).where("_t.v IS NOT NULL"))
    first = values.groupBy("_t").agg(F.min(seq).alias("_first"))
    links = values.join(first, "_t").where(F.col(seq) != F.col("_first")).select(F.col("_first").alias("a"), F.col(seq).alias("b"))
    found = connected(links)
    return requests.select(seq).join(found.select(F.col("id").alias(seq), "part"), seq, "left").select(seq, F.coalesce("part", seq).alias("part"))


def _settle(names: tuple[str, ...], n_alternates: int):
    """Requests in order of part and arrival to (seq, status).

    Each carries what the master says: whether its key is there, what that
    record holds, and who owns the alternates it asks for. Of a part, the state
    of the keys and values that it touched is held, not its requests.
    """

    def settle(batches):
        import pyarrow as pa

        part, records, owners = None, {}, {}
        for batch in batches:
            seqs, statuses = [], []
            for own, seq, op, key, there, *rest in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                wanted, holds, owned = rest[:n_alternates], rest[n_alternates : 2 * n_alternates], rest[2 * n_alternates :]
                if own != part:
                    part, records, owners = own, {}, {}
                if key is not None and key not in records:
                    records[key] = tuple(holds) if there else None
                    for n, v in enumerate(holds if there else ()):
                        if v is not None:
                            owners.setdefault((n, v), key)
                for n, (v, k) in enumerate(zip(wanted, owned, strict=True)):
                    if v is not None:
                        owners.setdefault((n, v), k)
                has = key is not None and records[key] is not None
                clash = any(v is not None and owners[n, v] not in (None, key) for n, v in enumerate(wanted))
                if key is None:
                    status = DUPLICATE if op == WRITE else MISSING
                elif op == WRITE:
                    status = DUPLICATE if has or clash else OK
                else:
                    status = MISSING if not has else DUPLICATE if op == REWRITE and clash else OK
                if status == OK and op != READ:
                    for n, v in enumerate(records[key] or ()):
                        if v is not None and owners.get((n, v)) == key:
                            owners[n, v] = None
                    records[key] = None if op == DELETE else tuple(wanted)
                    for n, v in enumerate(wanted if op != DELETE else ()):
                        if v is not None:
                            owners[n, v] = key
                seqs.append(seq)
                statuses.append(status)
            yield pa.RecordBatch.from_arrays([pa.array(seqs, batch.schema.field(1).type), pa.array(statuses)], names=list(names))

    return settle


def _outcomes_unique(master: DataFrame, requests: DataFrame, spec: KeySpec, seq: str, op: Column) -> DataFrame:
    """The requests with a status, where alternates must stay unique.

    Requests that can affect one another are settled in order, part by part; the
    number of shuffles does not depend on how many share a key. The rows of a part
    go through one task as a stream, since each outcome depends on those before.
    """
    parts = _conflicts(master, requests, spec, seq)
    held = master.select(F.col(spec.key).alias("_k"), *[F.col(a).alias(f"_h_{a}") for a in spec.unique], F.lit(True).alias("_there"))
    told = requests.select(seq, op.alias("_op"), F.col(spec.key).alias("_key"), *[F.col(a).alias(f"_w_{a}") for a in spec.unique]).join(held, F.col("_key") == F.col("_k"), "left")
    for a in spec.unique:
        owners = master.where(F.col(a).isNotNull()).select(F.col(a).alias(f"_v_{a}"), F.col(spec.key).alias(f"_o_{a}"))
        told = told.join(owners, F.col(f"_w_{a}") == F.col(f"_v_{a}"), "left")
    columns = ["part", seq, "_op", "_key", "_there", *[f"_{kind}_{a}" for kind in "who" for a in spec.unique]]
    told = told.join(parts, seq).select(*columns).repartition("part").sortWithinPartitions("part", seq)
    kind = requests.schema[seq].dataType.simpleString()
    settled = cut(told.mapInArrow(_settle((seq, "status"), len(spec.unique)), f"{seq} {kind}, status string"))
    return requests.join(settled, seq)


def _merged(master: DataFrame, outcomes: DataFrame, key: str, seq: str, op: Column) -> DataFrame:
    """The master after the requests that went through: the last one on each key is what stays."""
    body = [c for c in master.columns if c != key]
    effective = outcomes.where((F.col("status").isin(OK, OK_DUPLICATE)) & (op != READ)).withColumn("_op", op)
    final = effective.groupBy(key).agg(F.max_by(F.struct("_op", *body), F.col(seq)).alias("_new")).withColumnRenamed(key, "_k")
    merged = master.join(final, F.col(key) == F.col("_k"), "full")
    touched = F.col("_new").isNotNull()
    kept = merged.where(~touched | (F.col("_new._op") != DELETE)).select(
        F.coalesce("_k", key).alias(key), *[F.when(touched, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in body])
    return kept.select(*master.columns)


#: Open requests that one task may settle in order, and most rounds that let some in side by side before.
SETTLED, ROUNDS = 200_000, 40


def _open_writes(master: DataFrame, requests: DataFrame, spec: KeySpec, seq: str) -> tuple[DataFrame, DataFrame]:
    """WRITEs only: (seq) of those that surely go through, and the requests that are still open after some rounds.

    Nothing is freed, so what the master or a written record holds is taken for good, and a request for it is out.
    One that is the first of all open ones on each of its values goes through whatever the others do. A null
    alternate is held by nobody.
    """
    names = [spec.key, *spec.unique]
    rest = requests.select(seq, *names).where(F.col(spec.key).isNotNull())
    for c in names:
        rest = rest.join(master.select(c).where(F.col(c).isNotNull()).distinct(), c, "left_anti")
    rest, done = cut(rest.select(seq, *names)), []
    for _ in range(ROUNDS):
        if rest.count() <= SETTLED:
            break
        won = rest
        for c in names:
            first = rest.where(F.col(c).isNotNull()).groupBy(c).agg(F.min(seq).alias("_first")).select("_first")
            won = won.join(first, F.col(seq) == F.col("_first"), "left_semi") if c == spec.key else won.join(
                first, F.col(seq) == F.col("_first"), "left").where(F.col(c).isNull() | F.col("_first").isNotNull()).drop("_first")
        won = cut(won.select(seq, *names))
        done.append(won.select(seq))
        for c in names:
            rest = rest.join(won.select(c).where(F.col(c).isNotNull()), c, "left_anti")
        rest = cut(rest.select(seq, *names))
    through = requests.select(seq).limit(0)
    for d in done:
        through = through.unionByName(d)
    return through, rest


def write_batch(master: DataFrame, requests: DataFrame, spec: KeySpec, seq: str) -> BatchResult:
    """WRITE a batch: 00, 02 (repeated alternate) or 22 per request."""
    if spec.unique:
        through, rest = _open_writes(master, requests, spec, seq)
        # what is open asks for nothing that is taken, so the master has no part in it
        got = through.unionByName(_outcomes_unique(master.limit(0), rest, spec, seq, F.lit(WRITE)).where(F.col("status") == OK).select(seq))
    else:
        got = _accepted_primary(master, requests, spec.key, seq)
    marked = requests.join(got.withColumn("_in", F.lit(True)), seq, "left")
    repeated = F.lit(False)
    if spec.repeated:
        taken = requests.join(got, seq, "left_semi")
        for i, alt in enumerate(spec.repeated):
            fresh = _not_taken(_first_per(taken, alt, seq), master, alt, repeated=True).select(seq, F.lit(True).alias(f"_new{i}"))
            marked = marked.join(fresh, seq, "left")
            repeated = repeated | F.col(f"_new{i}").isNull()
    status = F.when(F.col("_in").isNull(), DUPLICATE).when(repeated, OK_DUPLICATE).otherwise(OK)
    outcomes = marked.select(*requests.columns, status.alias("status"))
    added = requests.join(got, seq, "left_semi").select(*master.columns)
    return BatchResult(master.unionByName(added), outcomes)


def write_relative(master: DataFrame, requests: DataFrame, rrn: str, seq: str) -> BatchResult:
    """Relative WRITE: the record number is the key."""
    return write_batch(master, requests, KeySpec(rrn), seq)


def append_relative(master: DataFrame, requests: DataFrame, rrn: str, seq: str) -> DataFrame:
    """Relative WRITE without a record number: each goes behind the last record."""
    last = master.agg(F.coalesce(F.max(rrn), F.lit(0)).cast("bigint"))
    body = [c for c in master.columns if c != rrn]
    placed = number_rows(requests, [F.col(seq).asc()], "_rn")
    added = placed.select((F.col("_rn") + last.scalar()).alias(rrn), *body)
    return master.unionByName(added.select(*master.columns))


def rewrite_batch(master: DataFrame, requests: DataFrame, key: str, seq: str, spec: KeySpec | None = None) -> BatchResult:
    """REWRITE by key: the last request per key is what stays. With a ``spec``
    that has unique alternates, one that another record holds is turned down with 22."""
    if spec is not None and spec.unique:
        outcomes = _outcomes_unique(master, requests, spec, seq, F.lit(REWRITE))
        return BatchResult(_merged(master, outcomes, key, seq, F.lit(REWRITE)), outcomes)
    body = [c for c in master.columns if c != key]
    known = master.select(F.col(key).alias("_k"), F.lit(True).alias("_hit"))
    outcomes = requests.join(known, F.col(key) == F.col("_k"), "left").select(
        *requests.columns, F.when(F.col("_hit").isNull(), MISSING).otherwise(OK).alias("status"))
    latest = requests.groupBy(key).agg(F.max_by(_record(body), F.col(seq)).alias("_new"))
    merged = master.join(latest, key, "left").select(
        key, *[F.when(F.col("_new").isNull(), F.col(c)).otherwise(F.col(f"_new.{c}")).alias(c) for c in body])
    return BatchResult(merged.select(*master.columns), outcomes)


def delete_batch(master: DataFrame, requests: DataFrame, key: str, seq: str) -> BatchResult:
    """DELETE by key: the first request finds the record, later ones miss."""
    first = _first_per(requests, key, seq)
    done = first.join(master.select(key), key, "left_semi").select(seq, F.lit(True).alias("_hit"))
    outcomes = requests.join(done, seq, "left").select(
        *requests.columns, F.when(F.col("_hit").isNull(), MISSING).otherwise(OK).alias("status"))
    return BatchResult(master.join(first.select(key), key, "left_anti"), outcomes)


def apply_batch(master: DataFrame, requests: DataFrame, key: str, seq: str, op: str = "op",
                block_rows: int = BLOCK_ROWS) -> BatchResult:
    """A mixed stream of WRITE, REWRITE, DELETE and READ, in ``seq`` order.

    Whether a key exists before a request depends only on the latest earlier
    WRITE or DELETE for it (accepted or not), so presence is a carried value,
    and the outcome follows from presence. What stays is the latest effective
    request. Primary key only.
    """
    o = F.col(op)
    turn = F.when(o == WRITE, True).when(o == DELETE, False)
    known = master.select(key, F.lit(True).alias("_was"))
    seen = scan_by_key(requests, [key], seq, last={"_was": turn}, initial=known, block_rows=block_rows)
    present = F.coalesce(F.col("_was"), F.lit(False))
    status = (F.when((o == WRITE) & present, DUPLICATE)
              .when((o != WRITE) & ~present, MISSING)
              .otherwise(OK))
    outcomes = seen.select(*requests.columns, status.alias("status"))
    return BatchResult(_merged(master, outcomes, key, seq, o), outcomes)


def apply_batch_unique(master: DataFrame, requests: DataFrame, spec: KeySpec, seq: str, op: str = "op") -> BatchResult:
    """The mixed stream with unique alternates, where requests can block or
    free each other's alternate values."""
    outcomes = _outcomes_unique(master, requests, spec, seq, F.col(op))
    return BatchResult(_merged(master, outcomes, spec.key, seq, F.col(op)), outcomes)
