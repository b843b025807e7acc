"""A mix of sources at target weights, as packed blocks of words.

The words of each source, document after document, are cut into blocks of fixed
length. The mix is a row of shards; the slots of a shard draw their sources, so
its counts are multinomial. Where the draws of all shards give a source more
slots than its target asks for, its last ones go to sources that came short, so
totals are exact and the cap on repeats holds. A source's slots run through a
pseudorandom permutation of its blocks, a new one each time round, and blocks
are joined by index. Everything follows from doc_id and the seed: reruns agree.

Null and blank texts have size 0 and are taken 0 times. A null source is a
source, ordered last. An empty table has an empty mix. Rows that repeat a
doc_id are documents of their own, which follow one another in any order. Very
long texts are counted whole. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import LongType

from recordloom.llm.common import documents, spaced_words, stored

BLOCK_WORDS = 64
SHARD_SLOTS = 1_024
MOST_SHARDS = 1 << 16      # shards grow beyond SHARD_SLOTS rather than in number
PACK_DOCS = 10_000         # documents whose words are summed along in one group
REPEATS = 3
WEIGHTS = (1, 2, 3)        # by source in order, again and again


def targets(sizes: DataFrame, repeats: int = REPEATS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size) to the same with target: shares of all words by
    weight, each at most ``repeats`` times its source, the excess shared anew.

    The final shares are min(cap, x * weight) for one x, so the sources that
    are capped come first by cap / weight, and x follows from running sums. A
    row a source: the sums run in one task over sources, not documents.
    """
    order = Window.orderBy(F.col("source").isNull(), F.encode(F.col("source"), "UTF-8"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    given = sizes.select("source", "source_size", w.alias("w"), (F.col("source_size") * float(repeats)).alias("cap"))
    by = Window.orderBy(F.col("cap") / F.col("w"), "w", "source")
    upto, everything = by.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    run = given.select(
        "*", F.coalesce(F.sum("cap").over(upto), F.lit(0.0)).alias("_capped"), (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(upto), F.lit(0.0))).alias("_open"),
        F.sum(F.col("source_size").cast("double")).over(everything).alias("_all"))
    run = run.withColumn("_x", (F.col("_all") - F.col("_capped")) / F.col("_open"))
    # The first source whose cap is not reached at its own x ends the capped ones;
    # the x of those after it can only be smaller.
    x = F.max(F.when(F.col("cap") >= F.col("_x") * F.col("w"), F.col("_x"))).over(Window.partitionBy())
    return run.select("source", "source_size", F.least("cap", x * F.col("w")).alias("target"))


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, at: where each document's words begin in its source.

    Documents are dealt into groups by a hash of doc_id; sums run along a group
    and then along the groups of a source, so no source meets in one task.
    """
    groups = docs.agg(F.greatest(F.ceil(F.count(F.lit(1)) / PACK_DOCS), F.lit(1)).cast("bigint")).first()[0]
    rows = docs.withColumn("_g", F.pmod(F.xxhash64("doc_id", "size"), F.lit(groups)))
    sums = stored(rows.groupBy("source", "_g").agg(F.sum("size").alias("_n")), "groups")
    before = Window.partitionBy("source").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    base = stored(sums.select(F.col("source").alias("_s"), F.col("_g").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")), "bases")
    along = Window.partitionBy("source", "_g").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumn("_in", F.coalesce(F.sum("size").over(along), F.lit(0)))
    return inside.join(base, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_g") == F.col("_b"))).select(
        "doc_id", "source", "size", (F.col("_base") + F.col("_in")).alias("at"))


def plan(aims: DataFrame, block: int = BLOCK_WORDS, repeats: int = REPEATS) -> DataFrame:
    """Per source: number s, blocks, slots it is to fill, p (its share of slots)."""
    blocks = F.ceil(F.col("source_size") / block)
    rounds = F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)))
    rest = F.round((F.col("target") - rounds * F.col("source_size")) / block)
    slots = F.least(rounds * blocks + rest, F.lit(repeats) * blocks).cast("bigint")
    numbered = aims.select("*", blocks.cast("bigint").alias("blocks"), slots.alias("slots"),
                           (F.row_number().over(Window.orderBy(F.col("source").isNull(), F.encode(F.col("source"), "UTF-8"))) - 1).alias("s"))
    return stored(numbered.withColumn("p", F.col("slots") / F.greatest(F.sum("slots").over(Window.partitionBy()), F.lit(1))), "sources")


@F.pandas_udf(LongType())      # a type object, as there may be no session yet
def permuted(seed: pd.Series, i: pd.Series, n: pd.Series) -> pd.Series:
    """Where ``i`` goes in a pseudorandom permutation of 0 .. ``n`` - 1.

    Four Feistel rounds permute the smallest square of a power of two that
    holds n; a value past n is put through again until it falls below.
    """
    key, x, size = (c.to_numpy(np.uint64) for c in (seed, i, n))
    half = np.ceil(np.log2(np.maximum(size, 2).astype(np.float64)) / 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = x.copy(), np.arange(len(x))
    while len(todo):
        k, h, m = key[todo], half[todo], mask[todo]
        left, right = out[todo] >> h, out[todo] & m
        for r in range(4):
            f = (right + k + np.uint64(r + 1)) * np.uint64(0x9E3779B97F4A7C15)
            f ^= f >> np.uint64(31)
            f *= np.uint64(0xBF58476D1CE4E5B9)
            f ^= f >> np.uint64(29)
            left, right = right, left ^ (f & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= size[todo]]
    return pd.Series(out.astype(np.int64))


def mix(sources: DataFrame, seed: int = 11) -> DataFrame:
    """(shard, slot, source, s, block): the block that each slot of the mix takes."""
    total = sources.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    size = max(SHARD_SLOTS, -(-total // MOST_SHARDS))
    table = [(r["s"], r["p"], r["slots"], r["blocks"]) for r in sources.orderBy("s").collect()]     # a row a source
    edges, acc = [], 0.0
    for _, p, _, _ in table:
        acc += p
        edges.append(acc)
    edges = [F.lit(e) for e in edges[:-1]] or [F.lit(2.0)]
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("shard"), F.col("slot")), 11) / float(1 << 53)
    slots = sources.sparkSession.range(total).select(F.floor(F.col("id") / size).cast("bigint").alias("shard"), F.pmod("id", F.lit(size)).alias("slot"))
    slots = slots.withColumn("s", F.size(F.filter(F.array(*edges), lambda e: e <= u)))
    drawn = stored(slots.groupBy("shard", "s").agg(F.count(F.lit(1)).alias("n")), "draws")
    before = Window.partitionBy("s").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = stored(drawn.select(F.col("shard").alias("_sh"), F.col("s").alias("_s"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "bases")
    rank = Window.partitionBy("shard", "s").orderBy("slot")                # a shard's slots at most
    placed = slots.withColumn("_r", F.row_number().over(rank) - 1).join(bases, (F.col("shard") == F.col("_sh")) & (F.col("s") == F.col("_s")))
    placed = placed.select("shard", "slot", "s", (F.col("base") + F.col("_r")).alias("j"))

    # Slots past a source's total, numbered through, and the places that are free.
    got = {r["s"]: r["n"] for r in drawn.groupBy("s").agg(F.sum("n").alias("n")).collect()}
    over, short = {}, []
    extra = free = 0
    for s, _, n, _ in table:
        have = got.get(s, 0)
        if have > n:
            over[s] = (n, extra)
            extra += have - n
        elif have < n:
            short.append((s, have, n - have, free))
            free += n - have
    lookup = lambda d, k, default: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in d.items() for x in kv]), k), F.lit(default)) if d else F.lit(default)
    limit = lookup({s: n for s, _, n, _ in table}, F.col("s"), 0)
    spare = F.when(F.col("j") >= limit, F.col("j") - limit + lookup({s: e for s, (_, e) in over.items()}, F.col("s"), 0))
    placed = placed.withColumn("e", spare)
    at = F.size(F.filter(F.array(*[F.lit(f).cast("bigint") for *_, f in short]), lambda f: f <= F.col("e"))) if short else F.lit(0)
    s = F.when(F.col("e").isNull(), F.col("s")).otherwise(lookup({k + 1: x[0] for k, x in enumerate(short)}, at, 0))
    j = F.when(F.col("e").isNull(), F.col("j")).otherwise(F.col("e") + lookup({k + 1: x[1] - x[3] for k, x in enumerate(short)}, at, 0))
    final = placed.select("shard", "slot", s.cast("int").alias("s"), j.cast("bigint").alias("j"))
    n = lookup({s: max(b, 1) for s, _, _, b in table}, F.col("s"), 1).cast("bigint")
    round_ = F.floor(F.col("j") / n)
    key = F.shiftrightunsigned(F.xxhash64(F.lit(seed + 1), F.col("s"), round_), 1)
    return final.select("shard", "slot", "s", permuted(key, F.pmod("j", n), n).alias("block"))


def mixed(docs: DataFrame, block: int = BLOCK_WORDS, seed: int = 11) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for each row of ``docs``."""
    sized = stored(docs.select("doc_id", "source", F.size(spaced_words(F.col("text"))).cast("bigint").alias("size")), "sizes")
    sources = plan(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))), block)
    where = packed(sized)
    where = where.join(sources.select(F.col("source").alias("_s"), "s", "source_size", "target"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    where = stored(where.withColumn("key", F.monotonically_increasing_id()), "places")
    taken = stored(mix(sources, seed).groupBy("s", "block").agg(F.count(F.lit(1)).alias("times")), "taken")
    last = F.floor((F.col("at") + F.col("size") - 1) / block)
    parts = where.where("size > 0").select("key", "s", "at", "size", F.explode(F.sequence(F.floor(F.col("at") / block), last)).alias("block"))
    share = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block) - F.greatest(F.col("at"), F.col("block") * block)
    got = parts.join(taken, ["s", "block"]).groupBy("key").agg(F.sum(share * F.col("times")).alias("taken"))
    return where.join(got, "key", "left").select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))


def blocks(docs: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """(source, block, words): the packed blocks themselves, to be joined to ``mix`` by index."""
    rows = docs.select("doc_id", "source", spaced_words(F.col("text")).alias("_w")).withColumn("size", F.size("_w").cast("bigint"))
    where = packed(rows.select("doc_id", "source", "size"))
    texts = rows.select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.posexplode("_w").alias("_p", "word"))
    joined = texts.join(where, F.col("_d").eqNullSafe(F.col("doc_id")) & F.col("_s").eqNullSafe(F.col("source")))
    placed = joined.select("source", (F.col("at") + F.col("_p")).alias("_at"), "word")
    return placed.groupBy("source", F.floor(F.col("_at") / block).alias("block")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_at", "word"))), lambda x: x["word"]).alias("words"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")
