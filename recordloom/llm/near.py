"""Pairs of sets with a Jaccard similarity of at least a threshold.

Sets that share a band key are candidates. No bucket is expanded into its
pairs. First every member is compared with the smallest id of its bucket, the
pivot, on full sets. Members as near as asked are linked to it. What is left,
ids not near a pivot, meets the other members of that pivot in blocks of
bounded size, where pairs that sizes, the triangle inequality (Jaccard distance
is a metric) and signatures do not exclude are compared on full sets. A block
answers with no more links than it takes to join its members, so a group of
thousands of copies costs tasks, not rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from recordloom.llm.common import stored

BLOCK = 256          # members of a pivot that meet at a time, twice as many in a task's group
DEVIATIONS = 5.0     # a signature may say so many standard deviations less than the sets


def _links_of(ids, n, open_, lo, hi, blk, sig, sets, one: bool, least: float, percent: int) -> tuple[list, list]:
    """Links among the members of two blocks of a pivot, in order of id; of one block if ``one``."""
    floor = least - DEVIATIONS * np.sqrt(least * (1 - least) / sig.shape[1])
    up = list(range(len(ids)))

    def root(k: int) -> int:
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    linked = np.flatnonzero(~open_)          # all of them are linked to the pivot
    for k in linked[1:]:
        up[k] = int(linked[0])
    found_a, found_b = [], []
    for k in range(len(ids) - 1):
        rest = slice(k + 1, None)
        ok = (open_[rest] | open_[k]) & (np.maximum(lo[rest] - hi[k], lo[k] - hi[rest]) <= 1 - least + 1e-9)
        ok &= np.minimum(n[rest], n[k]) * 100 >= percent * np.maximum(n[rest], n[k])
        if not one:
            ok &= blk[rest] != blk[k]
        at = np.flatnonzero(ok) + k + 1
        if not len(at):
            continue
        same = (sig[at] == sig[k]).mean(axis=1)
        order = np.argsort(-same, kind="stable")
        for m in at[order][same[order] >= floor]:
            if root(k) != root(m):
                inter = np.intersect1d(sets[k], sets[m], assume_unique=True).size
                if inter * 100 >= percent * (n[k] + n[m] - inter):
                    up[root(m)] = root(k)
                    found_a.append(ids[k])
                    found_b.append(ids[m])
    return found_a, found_b


def _joined(least: float, percent: int):
    """Links (a, b) among the members of two blocks of a pivot."""

    def compare(g: pd.DataFrame) -> pd.DataFrame:
        one = int(g["_i"].iat[0]) == int(g["_j"].iat[0])
        g = g.sort_values("id", ignore_index=True)
        ids, n, open_, lo, hi, blk = (g[c].to_numpy() for c in ("id", "n", "open", "lo", "hi", "_blk"))
        sig = np.frombuffer(b"".join(g["sig"]), np.uint8).reshape(len(g), -1)
        found_a, found_b = _links_of(ids, n, open_, lo, hi, blk, sig, list(g["elements"]), one, least, percent)
        return pd.DataFrame({"a": pd.Series(found_a, dtype=g["id"].dtype), "b": pd.Series(found_b, dtype=g["id"].dtype)})

    return compare


def _streamed(least: float, percent: int):
    """The same for rows in order of pivot, blocks and id, group after group: for many small groups."""

    def groups(t: pa.Table) -> pa.RecordBatch | None:
        p, i, j, ids, n, open_, lo, hi, blk = (t.column(c).to_numpy() for c in ("p", "_i", "_j", "id", "n", "open", "lo", "hi", "_blk"))
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(len(ids), -1)
        sets = t.column("elements").combine_chunks()
        values, offsets = sets.values.to_numpy(), sets.offsets.to_numpy()
        first = np.flatnonzero(np.concatenate(([True], (p[1:] != p[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))))
        found_a, found_b = [], []
        for a, b in zip(first.tolist(), np.append(first[1:], len(p)).tolist(), strict=True):
            if b - a > 1:
                own = [values[offsets[k] : offsets[k + 1]] for k in range(a, b)]
                got = _links_of(ids[a:b], n[a:b], open_[a:b], lo[a:b], hi[a:b], blk[a:b], sig[a:b], own, i[a] == j[a], least, percent)
                found_a += got[0]
                found_b += got[1]
        kind = t.schema.field("id").type
        return pa.RecordBatch.from_arrays([pa.array(found_a, kind), pa.array(found_b, kind)], names=["a", "b"])

    def compare(batches):
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            t = t.combine_chunks()
            key = t.select(["p", "_i", "_j"])
            last = t.num_rows - 1
            while last > 0 and all(key.column(c)[last - 1] == key.column(c)[last] for c in range(3)):
                last -= 1
            if last:
                yield groups(t.slice(0, last).combine_chunks())
            held = t.slice(last)
        if held is not None and held.num_rows:
            yield groups(held.combine_chunks())

    return compare


def links(sketches: DataFrame, sets_of, percent: int, streamed: bool = False) -> DataFrame:
    """Links (a, b), a < b: enough of them to join all ids that links join.

    ``sketches`` has one row for each distinct set: id, n (size of the set),
    keys (band keys), sig (one byte a signature place). ``sets_of(ids)`` gives
    (id, elements array<bigint>) for a table of ids. Two sets are linked if
    100 * intersection >= ``percent`` * union. ``streamed`` is for small sets in
    many groups, where setting up a group costs more than its comparisons.

    What grows with the corpus is never broadcast, however small it is here.
    """
    least = percent / 100
    members = sketches.select("id", "n", F.explode("keys").alias("key"))
    pivots = members.groupBy("key").agg(F.min(F.struct("id", "n")).alias("p"), F.count(F.lit(1)).alias("size")).where("size > 1")
    pivots = stored(pivots.select("key", F.col("p.id").alias("p"), F.col("p.n").alias("pn")), "pivots")
    star = members.join(pivots.hint("merge"), "key").where(F.col("id") != F.col("p")).select("p", "pn", "id", "n").distinct()
    star = stored(star, "star")
    ids = star.select("id").union(star.select("p")).distinct()
    sets = stored(sets_of(ids), "sets")

    # Sizes alone tell that sets are further apart than the triangle inequality can use.
    reach = 2 * least - 1
    known = F.least("n", "pn") / F.greatest("n", "pn") >= reach
    met = measured(star.where(known), sets)
    bounded = star.where(~known).select("p", "id", "n", F.lit(False).alias("near"), F.lit(1 - reach).alias("lo"), F.lit(1.0).alias("hi"))
    near = F.col("inter") * 100 >= F.col("uni") * percent
    far = 1 - F.col("inter") / F.col("uni")
    seen = stored(met.select("p", "id", "n", near.alias("near"), far.alias("lo"), far.alias("hi")).union(bounded), "seen")

    # A linked member matters only where one that is not linked may be near it.
    open_ = stored(seen.where(~F.col("near")).groupBy("p").agg(F.min("lo").alias("least_lo")), "open")
    rest = seen.join(open_, "p").where(~F.col("near") | (F.col("lo") >= F.col("least_lo") - (1 - least) - 1e-9))
    rest = stored(rest.select("p", "id", "n", (~F.col("near")).alias("open"), "lo", "hi"), "rest")
    sizes = stored(rest.groupBy("p").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "sizes")
    rest = rest.join(sizes, "p").withColumn("_n", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("_blk", F.pmod(F.xxhash64("id"), F.col("_n")).cast("int"))
    full = rest.join(sketches.select("id", "sig"), "id").join(sets.hint("merge"), "id")
    dealt = full.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).select(
        "p", "id", "n", "open", "lo", "hi", "sig", "elements", "_blk", F.least("_blk", "_o").alias("_i"), F.greatest("_blk", "_o").alias("_j"))
    kind = sketches.schema["id"].dataType.simpleString()
    if streamed:
        more = dealt.repartition("p", "_i", "_j").sortWithinPartitions("p", "_i", "_j", "id").mapInArrow(_streamed(least, percent), f"a {kind}, b {kind}")
    else:
        more = dealt.groupBy("p", "_i", "_j").applyInPandas(_joined(least, percent), f"a {kind}, b {kind}")
    return seen.where("near").select(F.col("p").alias("a"), F.col("id").alias("b")).union(more)


def measured(star: DataFrame, sets: DataFrame) -> DataFrame:
    """``star`` (p, id, n) with the sizes of intersection and union, from the full sets."""
    one = sets.select("id", F.col("elements").alias("_x"))
    two = sets.select(F.col("id").alias("p"), F.col("elements").alias("_y"))
    both = star.select("p", "id", "n").join(one.hint("merge"), "id").join(two.hint("merge"), "p")
    inter = F.size(F.array_intersect("_x", "_y"))
    return both.select("p", "id", "n", inter.alias("inter"), (F.size("_x") + F.size("_y")).alias("_both")).select(
        "p", "id", "n", "inter", (F.col("_both") - F.col("inter")).alias("uni"))
