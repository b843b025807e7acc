"""How far the sources of a language are apart, term by term, from run-length columns.

Terms are runs of letters and of all characters beyond ASCII, A-Z in lower case.
A language keeps the terms that stand in at least 30 of its documents. Each
(lang, source) group is a column of counts over those terms. The terms are put
in an order that brings equal counts together (by the counts in the columns with
the fewest different values, the best order known for run lengths), the order is
cut into stripes of 8,192 terms, and each column is run-length encoded in each
stripe. For two columns the boundaries of their runs are intersected: between
two boundaries both are constant, so the term |p - q| is worked out once and
multiplied by the length.

Sizes: a stripe of 128 columns meets in a task at most. Sources beyond 64 a
language are dealt into blocks, and pairs of blocks meet stripe by stripe; the
answer itself has a row for each pair of sources. Texts are counted where they
are read, so a source with a third of all rows moves no more than its terms.

Nulls in text, lang and source are read as ''. Empty texts, texts without a
letter and whole groups without a kept term stay groups: their counts are zero.
Repeated rows count each. Very long texts are counted whole; the counts held are
bounded (`HELD`). Ties in value are ranked by the UTF-8 bytes of the item. An
empty table gives an empty table; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from recordloom.llm.common import documents, stored

LEAST_DOCUMENTS = 30
UNIT, SMOOTH = 1_000_000_000, 5
TOP_TERMS = 50
HELD = 1 << 18           # terms counted in a task before they are handed on
STRIPE = 8_192           # terms of a stripe
BLOCK = 64               # columns of a block
LEADING = 8              # columns that order the terms

_FOLD = bytes(c if c >= 0x80 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def _tally(batches):
    """(lang, source, text as bytes) to (lang, source, term, n, docs), summed as far as memory allows."""
    held: dict[tuple, tuple[Counter, Counter]] = {}

    def flush():
        for (lang, source), (counts, docs) in held.items():
            keys = list(counts)
            for at in range(0, len(keys), 1 << 16):
                part = keys[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * len(part), pa.string()), pa.array([source] * len(part), pa.string()), pa.array(part, pa.binary()).cast(pa.string()),
                    pa.array([counts[k] for k in part], pa.int64()), pa.array([docs[k] for k in part], pa.int64())], names=["lang", "source", "term", "n", "docs"])
        held.clear()

    size = 0
    for batch in batches:
        for lang, source, text in zip(*batch.columns, strict=True):
            found = terms(text.as_py())
            if not found:
                continue
            counts, docs = held.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
            before = len(counts)
            counts.update(found)
            docs.update(set(found))
            size += len(counts) - before
            if size >= HELD:
                yield from flush()
                size = 0
    yield from flush()


def _stripes(most: int):
    """Sorted (lang, term) to (lang, term, stripe, pos)."""

    def cut(batches):
        stripe, pos, current = TaskContext.get().partitionId() << 32, 0, None
        for batch in batches:
            stripes, places = [], []
            for lang in batch.column(0).to_pylist():
                if current is not None and (lang != current or pos == most):
                    stripe, pos = stripe + 1, 0
                current = lang
                stripes.append(stripe)
                places.append(pos)
                pos += 1
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(stripes, pa.int64()), pa.array(places, pa.int32())], names=["lang", "term", "stripe", "pos"])

    return cut


def runs(at: np.ndarray, counts: np.ndarray, p: np.ndarray, none: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of a column begin, and the p of each; places without an entry have ``none``."""
    n, value = np.zeros(width, np.int64), np.full(width, none, np.int64)
    n[at], value[at] = counts, p
    first = np.flatnonzero(np.concatenate(([True], n[1:] != n[:-1]))) if width else np.empty(0, np.int64)
    return first, value[first]


def _encode(batches):
    for batch in batches:
        rows = batch.to_pydict()
        first, value = [], []
        for cells, none, width in zip(rows["cells"], rows["none"], rows["width"], strict=True):
            cells = cells or []
            a, b = runs(*(np.array([c[k] for c in cells], np.int64) for k in ("pos", "n", "p")), none, width)
            first.append(a)
            value.append(b)
        kept = [batch.column(c) for c in ("lang", "source", "stripe", "width")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(first, pa.list_(pa.int64())), pa.array(value, pa.list_(pa.int64()))], names=["lang", "source", "stripe", "width", "first", "p"])


def distance(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], width: int) -> int:
    """Sum of |p - q| over a stripe, from the runs (first, p) of two columns."""
    cuts = np.union1d(a[0], b[0])
    f = np.abs(a[1][np.searchsorted(a[0], cuts, "right") - 1] - b[1][np.searchsorted(b[0], cuts, "right") - 1])
    return int((f * np.diff(np.append(cuts, width))).sum())


def _pairs(g: pd.DataFrame) -> pd.DataFrame:
    """The pairs of columns of two blocks that meet in a stripe."""
    g = g.sort_values("source", ignore_index=True)
    lang, width, one = g["lang"].iat[0], int(g["width"].iat[0]), int(g["_i"].iat[0]) == int(g["_j"].iat[0])
    columns = list(zip(g["first"], g["p"], strict=True))
    source, block = list(g["source"]), list(g["_b"])
    out = [(lang, source[i], source[j], distance(columns[i], columns[j], width)) for i in range(len(g)) for j in range(i + 1, len(g)) if one or block[i] != block[j]]
    return pd.DataFrame(out, columns=["lang", "a", "b", "value"]).astype({"value": "int64"})


def _share(n: str, total: str, v: str) -> Column:
    """1 + floor(UNIT * (n + SMOOTH) / (total + SMOOTH * v)), exact."""
    return F.expr(f"1L + (cast({n} + {SMOOTH} as decimal(24, 0)) * {UNIT}) div cast(greatest({total} + {SMOOTH} * {v}, 1) as decimal(24, 0))")


def divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS, stripe: int = STRIPE, block: int = BLOCK) -> DataFrame:
    """lang, source, part, item, value, rank of ``docs`` (text, lang, source)."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = docs.select(text("lang").alias("lang"), text("source").alias("source"), text("text").cast("binary").alias("text"))
    counts = rows.mapInArrow(_tally, "lang string, source string, term string, n bigint, docs bigint").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = stored(counts, "counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= least)
    kept = stored(kept.select("lang", "term", "total"), "kept")
    cells = stored(counts.select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "cells")

    # The columns: size, number of different counts, and what a term without an occurrence has.
    sizes = cells.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("_times")).groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("_times")).alias("size"), F.count(F.lit(1)).alias("kinds"))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("lang_size"))
    groups = rows.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["size", "kinds", "v", "lang_size"])
    groups = stored(groups.withColumn("none", _share("0", "size", "v")), "groups")
    shares = cells.join(groups.select("lang", "source", "size", "v", "lang_size"), ["lang", "source"]).select(
        "lang", "source", "term", "n", _share("n", "size", "v").alias("p"), _share("total", "lang_size", "v").alias("q"))
    shares = stored(shares, "shares")

    # The order of the terms, cut into stripes.
    leading = groups.where("size > 0").withColumn("_k", F.row_number().over(Window.partitionBy("lang").orderBy("kinds", "source"))).where(F.col("_k") <= LEADING).select("lang", "source", "_k")
    keys = [f"_k{k}" for k in range(1, LEADING + 1)]
    order = shares.join(leading, ["lang", "source"], "left").groupBy("lang", "term").agg(*[F.coalesce(F.max(F.when(F.col("_k") == k, F.col("n"))), F.lit(0)).alias(c) for k, c in enumerate(keys, 1)])
    order = order.repartitionByRange("lang", *keys, "term").sortWithinPartitions("lang", *keys, "term")
    place = stored(order.select("lang", "term").mapInArrow(_stripes(stripe), "lang string, term string, stripe bigint, pos int"), "place")
    widths = place.groupBy("lang", "stripe").agg(F.count(F.lit(1)).alias("width"))

    # Run-length columns, one row a column and stripe; a language without a kept term has one stripe of no width.
    cut = shares.join(place, ["lang", "term"]).groupBy("lang", "source", "stripe").agg(F.collect_list(F.struct("pos", "n", "p")).alias("cells"))
    every = groups.select("lang", "source", "none").join(widths, "lang", "left").fillna({"stripe": -1, "width": 0})
    columns = every.join(cut, ["lang", "source", "stripe"], "left").select("lang", "source", "stripe", "none", "width", "cells")
    columns = stored(columns.mapInArrow(_encode, "lang string, source string, stripe bigint, width bigint, first array<bigint>, p array<bigint>"), "columns")

    blocks = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_n"))
    dealt = columns.join(blocks, "lang").withColumn("_b", F.pmod(F.xxhash64("source"), F.col("_n")).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    dealt = dealt.select("lang", "source", "stripe", "width", "first", "p", "_b", F.least("_b", "_o").alias("_i"), F.greatest("_b", "_o").alias("_j"))
    met = dealt.groupBy("lang", "stripe", "_i", "_j").applyInPandas(_pairs, "lang string, a string, b string, value bigint").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    met = stored(met, "met")
    pairs = met.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").union(met.select("lang", "b", "a", "value"))
    found = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    names = ["lang", "source", "part", "item", "value", "rank"]
    ranked = found.withColumn("rank", rank).where(F.col("rank") <= top).withColumn("part", F.lit("term")).select(names)
    return pairs.withColumn("rank", rank).withColumn("part", F.lit("pair")).select(names).union(ranked)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(documents(spark, sf_dir))


OP11_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), w AS (
  SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS total FROM w GROUP BY ALL HAVING count(DISTINCT r) >= {LEAST_DOCUMENTS}
), langs AS (
  SELECT lang, count(*) AS v, sum(total) AS lang_size FROM kept GROUP BY lang
), groups AS (
  SELECT DISTINCT lang, source FROM d
), counts AS (
  SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL
), dense AS (
  SELECT g.lang, g.source, k.term, k.total, coalesce(c.n, 0) AS n FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)
), sizes AS (
  SELECT lang, source, sum(n) AS size FROM dense GROUP BY ALL
), s AS (
  SELECT lang, source, term, n, 1 + ({UNIT}::HUGEINT * (n + {SMOOTH})) // (size + {SMOOTH} * v) AS p,
         1 + ({UNIT}::HUGEINT * (total + {SMOOTH})) // (lang_size + {SMOOTH} * v) AS q
  FROM dense JOIN sizes USING (lang, source) JOIN langs USING (lang)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
), far AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), every AS (
  SELECT lang, source, 'pair' AS part, item, coalesce(value, 0) AS value FROM pairs LEFT JOIN far USING (lang, source, item)
  UNION ALL SELECT lang, source, 'term', term, p - q FROM s WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM every
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""
