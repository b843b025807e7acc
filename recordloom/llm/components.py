"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from recordloom.llm.common import stored

MOST_ROUNDS = 64     # labels travel twice as far each round: more is an error, never a silent stop


def components(links: DataFrame) -> DataFrame:
    """(a, b) links to (id, component): the smallest id that can be reached.

    Links are read as undirected; null ends and links from an id to itself are
    left out. Each round every id takes the smallest label among its neighbours
    and then the label of its label. Hot ids are no group in one task: labels
    meet links in a plain join, which adaptive execution can split, and minima
    are formed before the shuffle. An empty table gives an empty table.
    """
    some = links.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).select("a", "b").distinct()
    edges = stored(some.union(some.select("b", "a")).toDF("a", "b"), "edges")
    label = stored(edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("component")), "labels")
    for _ in range(MOST_ROUNDS):
        heard = edges.join(label, edges["b"] == label["id"]).groupBy("a").agg(F.min("component").alias("heard"))
        near = stored(label.join(heard, label["id"] == heard["a"]).select("id", F.least("component", "heard").alias("near"), "component"), "labels")
        up = near.select(F.col("id").alias("_at"), F.col("near").alias("_far"))
        new = stored(
            near.join(up, F.col("near") == F.col("_at"), "left")
            .select("id", F.least("near", "_far").alias("component"), (F.least("near", "_far") != F.col("component")).alias("moved")), "labels")
        moved = bool(new.agg(F.max("moved")).first()[0])
        label = new.drop("moved")
        if not moved:
            return label
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")


def contracted(links: DataFrame) -> DataFrame:
    """The same as `components`, for long chains and dense groups: each round every id is put into the smallest
    of its neighbours, and that into its own; what is left are the links between different ones of these. So
    a round has half as many ids at most, and links inside what has come together are read no more."""
    some = links.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges, label = stored(some, "edges"), None
    for _ in range(MOST_ROUNDS):
        if edges.isEmpty():
            return label if label is not None else edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
        ends = edges.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("up")).union(edges.select(F.col("a").alias("id"), F.col("a").alias("up")).distinct())
        up = stored(ends.groupBy("id").agg(F.min("up").alias("up")), "up")
        far = up.select(F.col("id").alias("up"), F.col("up").alias("far"))
        step = stored(up.join(far.hint("merge"), "up").select("id", F.col("far").alias("to")), "step")
        if label is None:
            label = step.select("id", F.col("to").alias("component"))
        else:
            moved = step.select(F.col("id").alias("component"), "to")
            label = label.join(moved.hint("merge"), "component", "left").select("id", F.coalesce("to", "component").alias("component"))
        label = stored(label, "labels")
        one, two = step.select(F.col("id").alias("a"), F.col("to").alias("_a")), step.select(F.col("id").alias("b"), F.col("to").alias("_b"))
        left = edges.join(one.hint("merge"), "a").join(two.hint("merge"), "b").where("_a <> _b")
        edges = stored(left.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct(), "edges")
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
