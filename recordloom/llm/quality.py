"""Quality of a text by rules that vote, weighed by expectation maximisation.

Ten rules say good, bad, or abstain. They look at the same faults from several
sides (inserted marks show in symbols, letters and word length; separators in
symbols, bare words and letters; shouting in capitals and punctuation), so their
votes overlap and their rates can be estimated. No labels are used: a model with
one hidden class, good or bad, is fitted to how often each pattern of votes
occurs over all texts that pass the base rule. It gives the rate of each of the
three answers of each rule in either class, and a text's probability of being
good follows from its answers. A text is kept if that is at least a half. So one
bad vote need not reject a text (a rule that often stands alone has little weight),
and answers that are all in between may.

The counts of vote patterns are one aggregate; there are at most 3 to the number of
rules of them (59,049), twice, however many texts, and only they reach the driver.

Null, empty and blank texts have no words and fail the base rule. Very long texts
are counted whole. Rows that repeat are judged alike, in the model too. An empty
table gives an empty table. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from recordloom.llm.common import documents, spaced_words, stored

SYMBOLS = "#*$%&|<>"
REPEAT_WINDOW = 8
GOOD, BAD = 1, -1
ROUNDS, SETTLED = 200, 1e-7
PRIOR_GOOD = 0.85          # where the model starts; most texts are not junk
LEAST_POSTERIOR = 0.5


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with _m, a struct of what is counted in each text.

    Repeats are found within the row: hashes of all windows of eight words, and
    only where two are equal, the sorted (hash, place) pairs.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    k = REPEAT_WINDOW
    step = docs.select("*", spaced_words(t).alias("_w"), F.filter(F.split(t, "\n"), lambda x: x.rlike("[^ \\x09-\\x0D]")).alias("_l"))
    step = step.select("*", F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"))
    windows = F.when(F.size("_h") >= k, F.transform(F.sequence(F.lit(1), F.size("_h") - (k - 1)), lambda i: F.xxhash64(F.slice("_h", i, k)))).otherwise(F.array().cast("array<bigint>"))
    step = step.select("*", windows.alias("_win"))
    repeats = F.size(F.array_distinct("_win")) < F.size("_win")
    placed = F.array_sort(F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    step = step.select("*", F.when(repeats, placed).alias("_s"))
    one = F.slice("_s", 1, F.greatest(F.size("_s") - 1, F.lit(0)))
    two = F.slice("_s", 2, F.greatest(F.size("_s") - 1, F.lit(0)))
    equal = F.filter(F.zip_with(one, two, lambda a, b: F.struct((a["h"] == b["h"]).alias("same"), a["i"].alias("a"), b["i"].alias("b"))), lambda p: p["same"])
    twice = F.array_sort(F.array_distinct(F.concat(F.transform(equal, lambda p: p["a"]), F.transform(equal, lambda p: p["b"]))))
    covered = F.aggregate(
        twice, F.struct(F.lit(-k).alias("at"), F.lit(0).alias("n")),
        lambda acc, i: F.struct(i.alias("at"), (acc["n"] + F.least(i - acc["at"], F.lit(k))).alias("n")), lambda acc: acc["n"])
    joined = F.array_join("_w", "")
    n = F.size("_w")
    measures = F.struct(
        n.cast("bigint").alias("n_words"), F.length(joined).cast("bigint").alias("word_chars"),
        F.regexp_count(joined, F.lit("[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("bigint").alias("n_dup_lines"),
        F.when(F.col("_s").isNull(), 0).otherwise(covered).cast("bigint").alias("n_repeat_words"),
        F.size("_l").cast("bigint").alias("n_lines"), F.size(F.array_distinct("_h")).cast("bigint").alias("n_distinct"),
        (F.length(joined) - F.length(F.regexp_replace(joined, r"\p{L}+", ""))).cast("bigint").alias("n_letters"),
        F.length(F.regexp_replace(joined, r"\P{Lu}+", "")).cast("bigint").alias("n_capitals"),
        (F.length(joined) - F.length(F.translate(joined, ".,;:!?", ""))).cast("bigint").alias("n_marks"),
        F.size(F.filter("_w", lambda w: ~w.rlike(r"\p{L}"))).cast("bigint").alias("n_bare"),
        F.size(F.filter("_l", lambda x: x.rlike(r"[.!?][ \x09-\x0D]*\z"))).cast("bigint").alias("n_ended"))
    return step.select(*docs.columns, measures.alias("_m"))


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])


def votes(m: Column) -> dict[str, Column]:
    """Each rule's vote: GOOD, BAD, or 0 for no opinion."""
    n, chars, lines = (F.greatest(m[c], F.lit(1)) for c in ("n_words", "word_chars", "n_lines"))
    vote = lambda good, bad: F.when(bad, BAD).when(good, GOOD).otherwise(0)
    low = lambda x, of, good, bad: vote(x <= good * of, x > bad * of)
    high = lambda x, of, good, bad: vote(x >= good * of, x < bad * of)
    return {
        "symbols": low(m["n_symbols"], n, 0.02, 0.15),
        "letters": high(m["n_letters"], chars, 0.92, 0.85),
        "bare": low(m["n_bare"], n, 0.05, 0.20),
        "word_size": vote((m["word_chars"] >= 3.5 * n) & (m["word_chars"] <= 6.5 * n), (m["word_chars"] < 3.0 * n) | (m["word_chars"] > 7.5 * n)),
        "capitals": low(m["n_capitals"], chars, 0.08, 0.25),
        "marks": low(m["n_marks"], n, 0.40, 1.00),
        "lines": low(m["n_dup_lines"], lines, 0.00, 0.30),
        "repeats": low(m["n_repeat_words"], n, 0.00, 0.10),
        # Long texts use words again in any case, so few different words tell only in short ones.
        "variety": F.when(m["n_words"] > 2_000, 0).otherwise(high(m["n_distinct"], n, 0.45, 0.30)),
        "ends": high(m["n_ended"], lines, 0.50, 0.10),
    }


class LabelModel:
    """Rates of each rule's answers in good and bad texts, fitted without labels.

    Texts are bad in ways that have little to do with one another, so most rules
    call a bad text good: START says that such a vote means little and one for
    bad much. It counts as ANCHOR times the texts that are there, a tenth, so the
    counts move the rates; it keeps rates off zero and says which class is which.
    """

    START = {GOOD: {GOOD: 0.97, 0: 0.02, BAD: 0.01}, BAD: {GOOD: 0.60, 0: 0.15, BAD: 0.25}}
    ANCHOR = 0.1
    ANSWERS = (GOOD, 0, BAD)

    def __init__(self, rules: list[str], patterns: list[tuple[tuple[int, ...], int]]):
        self.rules = rules
        start = self.START
        everything = sum(n for _, n in patterns)
        self.rates = [{c: dict(start[c]) for c in (GOOD, BAD)} for _ in rules]
        self.good = PRIOR_GOOD
        last = -math.inf
        for _ in range(ROUNDS if patterns else 0):
            own = {GOOD: self.ANCHOR * everything * PRIOR_GOOD, BAD: self.ANCHOR * everything * (1 - PRIOR_GOOD)}
            sums = [{c: {v: own[c] * start[c][v] for v in self.ANSWERS} for c in (GOOD, BAD)} for _ in rules]
            good = like = 0.0
            for vs, n in patterns:
                p, log = self.posterior(vs)
                like += n * log
                good += n * p
                for r, v in enumerate(vs):
                    sums[r][GOOD][v] += n * p
                    sums[r][BAD][v] += n * (1 - p)
            self.good = min(max((good + own[GOOD]) / (everything + own[GOOD] + own[BAD]), 1e-6), 1 - 1e-6)
            self.rates = [{c: {v: x / sum(s[c].values()) for v, x in s[c].items()} for c in s} for s in sums]
            if abs(like - last) <= SETTLED * max(1.0, abs(like)):
                break
            last = like

    def posterior(self, vs: tuple[int, ...]) -> tuple[float, float]:
        """Probability of good, and the log likelihood of the answers."""
        g, b = math.log(self.good), math.log(1 - self.good)
        for r, v in zip(self.rates, vs, strict=True):
            g += math.log(r[GOOD][v])
            b += math.log(r[BAD][v])
        top = max(g, b)
        log = top + math.log(math.exp(g - top) + math.exp(b - top))
        return math.exp(g - log), log

    def column(self, cast: dict[str, Column]) -> Column:
        """The probability of good as an expression over the answers."""
        odds = F.lit(math.log(self.good / (1 - self.good)))
        for name, r in zip(self.rules, self.rates, strict=True):
            w = {v: math.log(r[GOOD][v] / r[BAD][v]) for v in self.ANSWERS}
            odds = odds + F.when(cast[name] == GOOD, w[GOOD]).when(cast[name] == BAD, w[BAD]).otherwise(w[0])
        return 1 / (1 + F.exp(-odds))


def judged(counted: DataFrame) -> DataFrame:
    """Rows with _m (of ``with_counts``) and base_failed, p_good, kept.

    The rows are read twice, for the patterns and for the verdict, so give a
    stored table where counting costs more than reading.
    """
    rules = votes(F.col("_m"))
    # Texts that the base rule rejects have their verdict; the model is for the
    # others. They are told apart in the groups: a filter would be pushed below
    # the counts, and they would be worked out once more for it.
    groups = counted.groupBy(*[v.alias(k) for k, v in rules.items()], base_failed(F.col("_m")).alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    patterns = [r for r in groups.collect() if not r["_b"]]     # 2 * 3 ** 10 rows at most
    model = LabelModel(list(rules), sorted((tuple(r[k] for k in rules), r["_n"]) for r in patterns))
    return counted.select("*", base_failed(F.col("_m")).alias("base_failed"), model.column(rules).alias("p_good")).withColumn(
        "kept", ~F.col("base_failed") & (F.col("p_good") >= LEAST_POSTERIOR))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = judged(stored(with_counts(docs).select("doc_id", "_m"), "counts"))
    return out.select("doc_id", *[f"_m.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], "base_failed", "kept", "p_good")
