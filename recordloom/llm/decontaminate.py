"""Benchmark passages in training text, by a positional inverted index.

The index holds postings of training tokens: text, place, and the words around
it. A window is searched from its two rarest terms, by their counts over the
whole corpus: their lists, one shifted by the gap between them, are intersected
while they are made, so the index stays small beside the text. A search shifts
each posting to where the window would start and compares word by word. All of
it is DataFrame operations.

Null and empty texts have no words: they hit nothing. Items without words have
no windows. Rows that repeat a doc_id with the same text give the same result;
with different texts each is judged by itself, null ids included. Items that
share an id are one item. Item ids that are null are left out.
Very long texts are searched whole, each as one row. An empty table of documents
gives an empty table, an empty benchmark no hits. Other columns are not read,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from recordloom.llm.common import documents, stored
from recordloom.session import table

WINDOW = 10            # words
NO_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def item_words(text: Column) -> Column:
    """A-Z in lower case, then runs of letters, digits and what is not ASCII."""
    t = F.coalesce(text, F.lit(""))
    small = F.when(F.length(t) == F.octet_length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))   # lower() also folds other letters
    return F.array_remove(F.split(small, NO_WORD), "")


def benchmark_windows(items: DataFrame, size: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (win, words) and where they are from (win, item_id)."""
    ws = items.where("item_id IS NOT NULL").select("item_id", item_words(F.col("text")).alias("words")).where(F.size("words") > 0)
    first = F.explode(F.sequence(F.lit(1), F.greatest(F.size("words") - size + 1, F.lit(1))))
    cut = stored(ws.select("item_id", "words", first.alias("at")).select("item_id", F.slice("words", F.col("at"), size).alias("words")).distinct()
                 .withColumn("win", F.sha2(F.concat_ws(" ", "words"), 256)), "windows")
    return cut.select("win", "words").dropDuplicates(["win"]), cut.select("win", "item_id")


def texts(docs: DataFrame) -> DataFrame:
    """Texts with the key that tells apart different texts under one id."""
    return docs.select("doc_id", F.xxhash64("text").alias("th"), "text")


def _tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, th, words, pos, term hash); pos counts from 0."""
    ws = texts(docs).select("doc_id", "th", item_words(F.col("text")).alias("words"))
    return ws.select("doc_id", "th", "words", F.posexplode("words").alias("pos", "term")).withColumn("h", F.xxhash64("term"))


def search_terms(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """The two rarest terms of each window, by their counts over all of ``docs``:
    (win, h, offset, h2, gap), ``gap`` from the first to the second. A window of
    one term has it twice, with gap 0; a window with a term that no text has is
    ruled out."""
    terms = stored(windows.select("win", F.posexplode("words").alias("offset", "term")).withColumn("h", F.xxhash64("term"))
                   .groupBy("win", "h").agg(F.min("offset").alias("offset")), "terms")
    vocabulary = stored(terms.select("h").distinct(), "vocabulary")
    counts = stored(_tokens(docs).select("h").join(vocabulary, "h").groupBy("h").agg(F.count(F.lit(1)).alias("n")), "counts")
    # A window's terms are at most WINDOW.
    ranked = terms.join(counts, "h", "left").groupBy("win").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "h"))).alias("t"))
    first, second = F.col("t")[0], F.col("t")[F.least(F.size("t"), F.lit(2)) - 1]
    return stored(ranked.where(first["n"] > 0).select(
        "win", first["h"].alias("h"), first["offset"].alias("offset"), second["h"].alias("h2"), (second["offset"] - first["offset"]).alias("gap")), "search")


def index(docs: DataFrame, pairs: DataFrame, around: int = WINDOW) -> DataFrame:
    """Postings (h, h2, gap, doc_id, th, pos, begins, context) of pairs of terms.

    A posting is a place ``pos`` of term ``h`` with ``h2`` standing ``gap`` words
    on: the two terms' lists, one shifted by the gap, intersected as they are
    made, so that a term which every text holds posts no more than it must. A
    pair of a term with itself at gap 0 posts the term. ``context`` are the
    words up to ``around`` - 1 before and behind, ``begins`` the place of the
    first of them.
    """
    wanted = stored(pairs.select("h", "h2", "gap").distinct(), "wanted")
    begins = F.greatest(F.col("pos") - (around - 1), F.lit(0))
    met = _tokens(docs).join(wanted, "h").where(F.xxhash64(F.get("words", F.col("pos") + F.col("gap"))) == F.col("h2"))
    return stored(met.select("h", "h2", "gap", "doc_id", "th", "pos", begins.alias("begins"),
                             F.concat_ws(" ", F.slice("words", begins + 1, F.col("pos") - begins + around)).alias("context")), "postings")


def phrase_matches(postings: DataFrame, search: DataFrame, windows: DataFrame) -> DataFrame:
    """(win, doc_id, th, start, size): every exact occurrence of a window.

    Postings of a window's two rarest terms are shifted by the offset to where
    the window would start, and the words from there are compared.
    """
    shifted = postings.join(search.join(windows, "win"), ["h", "h2", "gap"]).withColumn("start", F.col("pos") - F.col("offset")).where("start >= 0")
    here = F.slice(F.split("context", " "), F.col("start") - F.col("begins") + 1, F.size("words"))
    return shifted.where(here == F.col("words")).select("win", "doc_id", "th", "start", F.size("words").alias("size"))


def proximity_matches(postings: DataFrame, terms: list[str], within: int) -> DataFrame:
    """(doc_id, th, pos, last): places where all ``terms`` stand within ``within`` words.

    ``pos`` is an occurrence of the first term, ``last`` the furthest of the
    nearest occurrences of the others; the words are searched in the context of
    the first term's postings, so ``within`` may not exceed what was indexed.
    """
    first, *others = terms
    found = postings.where((F.col("h") == F.xxhash64(F.lit(first))) & (F.col("h2") == F.col("h")) & (F.col("gap") == 0))
    ahead = F.slice(F.split("context", " "), F.col("pos") - F.col("begins") + 1, within)
    places = [F.array_position(ahead, t) for t in others]
    if not places:
        return found.select("doc_id", "th", "pos", F.col("pos").alias("last"))
    furthest = F.greatest(*places, F.lit(0))
    everywhere = F.lit(True)
    for p in places:
        everywhere = everywhere & (p > 0)
    return found.where(everywhere).select("doc_id", "th", "pos", (F.col("pos") + furthest - 1).cast("int").alias("last"))


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """A row for each row of ``docs``: doc_id, th, n_words, n_hit, items (sorted ids of items met)."""
    windows, origin = benchmark_windows(items, size)
    search = search_terms(docs, windows)
    postings = index(docs, search, size)
    found = stored(phrase_matches(postings, search, windows), "matches")
    # Words inside any occurrence: along a text, each adds what is past the furthest end so far.
    along = Window.partitionBy("doc_id", "th").orderBy("start", F.desc("size"))
    ends = F.max(F.col("start") + F.col("size")).over(along.rowsBetween(Window.unboundedPreceding, -1))
    spans = found.groupBy("doc_id", "th", "start").agg(F.max("size").alias("size")).withColumn("_before", F.coalesce(ends, F.lit(0)))
    hit = spans.groupBy("doc_id", "th").agg(F.sum(F.greatest(F.col("start") + F.col("size") - F.greatest("start", "_before"), F.lit(0))).alias("n_hit"))
    met = found.select("win", "doc_id", "th").distinct().join(origin, "win").select("doc_id", "th", F.col("item_id").cast("string").alias("item")).distinct()
    met = met.groupBy("doc_id", "th").agg(F.sort_array(F.collect_list("item")).alias("items"))
    hits = stored(hit.join(met, [hit["doc_id"].eqNullSafe(met["doc_id"]), hit["th"] == met["th"]]).select(
        hit["doc_id"].alias("_d"), hit["th"].alias("_t"), "n_hit", "items"), "hits")
    counted = texts(docs).select("doc_id", "th", F.size(item_words(F.col("text"))).cast("bigint").alias("n_words"))
    return counted.join(hits, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t")), "left").select(
        "doc_id", "th", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents in which no benchmark window occurs, as they came."""
    dirty = contamination(docs, items).where("n_hit > 0").select(F.col("doc_id").alias("_d"), F.col("th").alias("_t")).distinct()
    dirty = stored(dirty, "dirty")
    return docs.join(dirty, docs["doc_id"].eqNullSafe(dirty["_d"]) & (F.xxhash64(docs["text"]) == dirty["_t"]), "left_anti")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP1_SQL = r"""
WITH words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
items AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, len(w) AS size, array_to_string(w, ' ') AS win FROM (
    SELECT item_id, ws[s:s + 9] AS w FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 8, 2))) AS s FROM items WHERE len(ws) > 0))),
sizes AS (SELECT DISTINCT size FROM wins),
placed AS (SELECT doc_id, s, size, array_to_string(ws[s:s + size - 1], ' ') AS win FROM (
    SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS s FROM words, sizes WHERE len(ws) >= size)),
found AS (SELECT a.doc_id, a.s, a.size, w.item_id FROM placed a JOIN wins w ON a.size = w.size AND a.win = w.win),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + size)) AS p FROM found) GROUP BY doc_id),
met AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS l FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words d LEFT JOIN hit USING (doc_id) LEFT JOIN met USING (doc_id)
"""
