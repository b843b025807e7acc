"""Row numbers and running values without a single-partition window.

Two shapes are covered. ``number_rows`` orders a whole table: it range-partitions
on the sort keys, and only per-partition totals (one row a partition) meet in
one task. ``scan_by_key`` runs along each key: a key that holds a third of the
table is cut into blocks of rows, spread over many tasks, and only one summary
row per block crosses them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from recordloom.session import cut

BLOCK_ROWS = 1 << 20
PARTITION_BYTES = 256 << 20
MOST_PARTITIONS = 400_000    # 100 TB; estimates of joins can be far higher
MOST_HOT = 100_000           # hot keys that may be broadcast; more are joined
SMALL_PARTITIONS = 100_000   # rows of the offsets table that may be broadcast


def _partitions(df: DataFrame) -> int:
    """The session's partitions, or more where the input is estimated to need it."""
    set_to = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(set_to, min(size // PARTITION_BYTES + 1, MOST_PARTITIONS))


def number_rows(
    df: DataFrame,
    order: list[Column],
    name: str = "rn",
    running: dict[str, Column] | None = None,
    total: str | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Number rows from one in ``order``, with running sums if asked.

    ``order`` must end in something unique; that also lets the range cuts fall
    inside a group of equal leading keys. The placed rows are checkpointed, so
    numbers stay the same whatever is recomputed later.
    """
    n = partitions or _partitions(df)
    running = running or {}
    summed = {f"_v{i}": c for i, c in enumerate(running.values())}
    placed = (
        df.select("*", *[c.alias(k) for k, c in summed.items()])
        .repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .withColumn("_id", F.monotonically_increasing_id())
    )
    placed = cut(placed).withColumn("_block", F.shiftright("_id", 33))
    totals = placed.groupBy("_block").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(k).alias(f"_s{k}") for k in summed])
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_block",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"),
        *([F.sum("_n").over(Window.partitionBy()).alias(total)] if total else []),
        *[F.sum(f"_s{k}").over(before).alias(f"_b{k}") for k in summed],
    )
    if n <= SMALL_PARTITIONS:      # at most one row per partition
        offsets = F.broadcast(offsets)
    out = placed.join(offsets, "_block")
    within = Window.partitionBy("_block").orderBy("_id").rowsBetween(Window.unboundedPreceding, 0)
    for (label, expr), k in zip(running.items(), summed, strict=True):
        here = F.sum(k).over(within)
        out = out.withColumn(label, F.coalesce(here, F.lit(0)) + F.coalesce(F.col(f"_b{k}"), F.lit(0)))
    at = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    out = out.withColumn(name, F.col("_base") + at + F.lit(1))
    return out.drop("_id", "_block", "_base", *summed, *[f"_b{k}" for k in summed])


def hot_keys(keyed: DataFrame, key: str, rows: int = BLOCK_ROWS) -> tuple[DataFrame, int, int]:
    """Keys with more than ``rows`` rows, how many they are, and how many rows they have.
    Counting is done before the shuffle."""
    hot = cut(keyed.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows))
    n, total = hot.agg(F.count(F.lit(1)), F.coalesce(F.sum("_n"), F.lit(0))).first()
    return hot.select(key), n, total


def blocks_of(df: DataFrame, key: str, seq: str, partitions: int) -> DataFrame:
    """``df`` with _block, which grows along each key: rows are ranged by key and ``seq``, so a
    block has about as many rows as any other, whatever numbers ``seq`` has and however many rows
    a key has. Kept on the shared folder, so a row stays in its block whatever is worked out anew."""
    return cut(df.repartitionByRange(partitions, key, seq).withColumn("_block", F.spark_partition_id().cast("bigint")))


def scan_by_key(
    df: DataFrame,
    keys: list[str],
    seq: str,
    last: dict[str, Column] | None = None,
    sums: dict[str, Column] | None = None,
    initial: DataFrame | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Per key and in ``seq`` order: values carried over strictly earlier rows.

    ``last`` gives the latest non-null value, ``sums`` the sum, each over the
    rows before the current one (null where there are none). ``initial`` (one
    row a key, columns named as in ``last``) gives what held before the first
    row.

    ``seq`` is unique within its key. Keys with more than ``block_rows`` rows are
    cut into blocks of about so many rows (`blocks_of`); one summary row per block
    crosses them. Other keys are one block.
    """
    last, sums = last or {}, sums or {}
    # One key value for grouping, window and join, so that the rows move once;
    # inside a struct, nulls are equal to each other.
    key = F.struct(*keys).alias("_key")
    hot, n_hot, hot_rows = hot_keys(df.select(key), "_key", block_rows)
    listed = F.broadcast(hot) if n_hot <= MOST_HOT else hot
    one_block = lambda rows: rows.withColumns({"_block": F.lit(0).cast("bigint"), "_hot": F.lit(False)})
    marked = df.select("*", key)
    if n_hot:
        cut_up = blocks_of(marked.join(listed, "_key", "left_semi"), "_key", seq, -(-hot_rows // block_rows)).withColumn("_hot", F.lit(True))
        marked = cut_up.unionByName(one_block(marked.join(listed, "_key", "left_anti")))
    else:
        marked = one_block(marked)
    marked = marked.withColumns({**{f"_l_{k}": c for k, c in last.items()}, **{f"_s_{k}": c for k, c in sums.items()}})

    within = Window.partitionBy("_key", "_block").orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    inside = marked.select(
        "*",
        *[F.last(f"_l_{k}", ignorenulls=True).over(within).alias(f"_wl_{k}") for k in last],
        *[F.sum(f"_s_{k}").over(within).alias(f"_ws_{k}") for k in sums],
    )

    given = None
    if initial is not None:
        given = initial.select(key, *[F.col(k).alias(f"_cl_{k}") for k in last])
    carried = _block_carries(marked, last, sums, given, seq) if n_hot else None
    if given is not None:
        cold = given.join(listed, "_key", "left_anti") if n_hot else given
        null_sums = [F.lit(None).cast(inside.schema[f"_ws_{k}"].dataType).alias(f"_cs_{k}") for k in sums]
        cold = cold.select("_key", F.lit(0).cast("bigint").alias("_block"), *[f"_cl_{k}" for k in last], *null_sums)
        carried = cold if carried is None else cold.unionByName(carried)
    if carried is None:
        return inside.select(*df.columns, *[F.col(f"_wl_{k}").alias(k) for k in last], *[F.col(f"_ws_{k}").alias(k) for k in sums])
    joined = inside.join(carried, ["_key", "_block"], "left")
    plus = lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)
    return joined.select(
        *df.columns,
        *[F.coalesce(F.col(f"_wl_{k}"), F.col(f"_cl_{k}")).alias(k) for k in last],
        *[plus(F.col(f"_ws_{k}"), F.col(f"_cs_{k}")).alias(k) for k in sums],
    )


def _block_carries(marked: DataFrame, last: dict, sums: dict, given: DataFrame | None, seq: str) -> DataFrame:
    """What each block of a hot key starts with, from the blocks before it."""
    summary = marked.where(F.col("_hot")).groupBy("_key", "_block").agg(
        *[F.max_by(f"_l_{k}", F.when(F.col(f"_l_{k}").isNotNull(), F.col(seq))).alias(f"_l_{k}") for k in last],
        *[F.sum(f"_s_{k}").alias(f"_s_{k}") for k in sums],
    )
    along = Window.partitionBy("_key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(
        "_key", "_block",
        *[F.last(f"_l_{k}", ignorenulls=True).over(along).alias(f"_cl_{k}") for k in last],
        *[F.sum(f"_s_{k}").over(along).alias(f"_cs_{k}") for k in sums],
    )
    if given is not None:
        first = given.select("_key", *[F.col(f"_cl_{k}").alias(f"_il_{k}") for k in last])
        carried = carried.join(first, "_key", "left").withColumns(
            {f"_cl_{k}": F.coalesce(F.col(f"_cl_{k}"), F.col(f"_il_{k}")) for k in last}).drop(*[f"_il_{k}" for k in last])
    return carried


def next_key(requests: DataFrame, keys: DataFrame, by: str, key: str, seq: str, after: bool = False,
             partitions: int | None = None) -> DataFrame:
    """The requests with ``key``: the lowest key not below ``by`` (above it, with
    ``after``), or null.

    Requests and keys are sorted together once. Each partition looks ahead
    within itself, and the first key of every partition tells the one before
    where to go on. ``seq`` is unique, so many equal requests still spread.
    """
    n = partitions or _partitions(requests)
    first = 1 if after else 0      # do equal keys come before the request or behind it
    asked = requests.select(F.col(by).alias("_at"), F.lit(first).alias("_side"), F.col(seq).cast("bigint").alias("_seq"),
                            F.lit(None).cast(keys.schema[key].dataType).alias("_key"), F.struct(*requests.columns).alias("_req"))
    held = keys.select(F.col(key).alias("_at"), F.lit(1 - first).alias("_side"), F.lit(0).cast("bigint").alias("_seq"),
                       F.col(key).alias("_key"), F.lit(None).cast(asked.schema["_req"].dataType).alias("_req"))
    order = ["_at", "_side", "_seq"]
    placed = (asked.unionByName(held).repartitionByRange(n, *order).sortWithinPartitions(*order)
              .withColumn("_id", F.monotonically_increasing_id()))
    placed = cut(placed).withColumn("_block", F.shiftright("_id", 33))
    heads = placed.groupBy("_block").agg(F.min("_key").alias("_head"))
    ahead = Window.orderBy("_block").rowsBetween(1, Window.unboundedFollowing)
    carried = heads.select("_block", F.first("_head", ignorenulls=True).over(ahead).alias("_next"))
    if n <= SMALL_PARTITIONS:      # at most one row per partition
        carried = F.broadcast(carried)
    within = Window.partitionBy("_block").orderBy(F.desc("_id")).rowsBetween(Window.unboundedPreceding, 0)
    seen = placed.withColumn("_here", F.last("_key", ignorenulls=True).over(within))
    found = seen.where(F.col("_req").isNotNull()).join(carried, "_block")
    return found.select("_req.*", F.coalesce("_here", "_next").alias(key))
