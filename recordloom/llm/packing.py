"""Packing of tokenized documents into sequences of at most 4,096 tokens.

A document is its token ids and an end id; only longer ones are cut. What is to
be packed is known once there is a count for each length, at most 4,096 numbers
however many documents, so the plan is made on those counts, for all pieces of a
length at once:

1. Exact complements. From the longest length down, a gap is looked up in the
   index of single lengths, of sums of two and of sums of three that are still
   available, and the combination is consumed as often as all its counts allow.
   A gap beyond the reach of three is first narrowed by the longest lengths.
2. What has no exact complement goes best fit: longest first, each into the open
   sequence with the smallest gap that holds it, again all of one gap at a time.
   If best fit alone would need fewer sequences (many lengths over a half, little
   to fill them with), its plan is taken.

The plan is a table of slots: "of this length, pieces r0 .. r0+n-1 stand at this
offset of sequences s0 .. s0+n-1". A piece finds its slot by its rank among the
pieces of its length. Ranks come from counts per written file and length, summed
over the files, so a length that a third of all pieces has moves no rows.

Null and empty texts are the end id alone. Rows that repeat, also with a null
doc_id, are packed each. Very long texts are tokenized word by word and cut. Ties
between pieces of one length are settled by where they stand in the written
table. An empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import bisect
import re
import struct
import zlib
from collections import defaultdict
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from recordloom.llm.common import documents, stored

SEQUENCE = 4_096
END = 1
TOKENIZER = "word_bpe_49k.json"
SHORT, SHORTER = 16, 16              # lengths up to this share of a sequence get so many shorter ones tried where no complement is found
CACHE, PARTS = 1 << 20, 1 << 19      # words and parts of words whose ids a worker keeps; each starts anew beyond that
PIECES = "doc_id {}, piece int, start bigint, length bigint, ids_crc32 bigint, _part int, _rank bigint"


class WordIds(dict):
    """Ids of words, as little-endian 32-bit numbers.

    The tokenizer drops white space and no token of it spans two words, so the
    ids of a text are those of its words, one behind another. Nor does a token
    span letters and the ASCII marks around them, so words are put together
    from parts, which recur more often. Printable ASCII needs no normalisation
    but lower case and goes to the tokenizer's model; all else goes through its
    normaliser and splitter first.
    """

    _ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
    _MARKS = '.,;:!?"()'

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.parts: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        if (ids := self.parts.get(part)) is None:
            if len(self.parts) >= PARTS:
                self.parts.clear()
            t = self.tokenizer
            if "<|" in part:
                found = t.encode(part, add_special_tokens=False).ids
            elif part.isascii() and part.isprintable():
                found = [x.id for x in t.model.tokenize(part)]
            else:
                found = [x.id for piece, _ in t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(part)) for x in t.model.tokenize(piece)]
            ids = self.parts[part] = struct.pack(f"<{len(found)}I", *found)
        return ids

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        text = word.decode("utf-8")
        if text.isascii() and text.isprintable() and "<|" not in text:
            parts = self._ASCII.findall(text.lower())
        elif (core := text.strip(self._MARKS)).lower().isalpha():
            at = text.index(core)
            parts = [p for p in (text[:at], core, text[at + len(core) :]) if p]
        else:
            parts = [text]
        ids = self[word] = b"".join(map(self._part, parts))
        return ids

    def of(self, text: bytes | None) -> bytes:
        return b"".join(map(self.__getitem__, (text or b"").split())) + END.to_bytes(4, "little")


@cache
def word_ids(tokenizer: str) -> WordIds:
    """One for all tasks of a worker."""
    return WordIds(tokenizer_path(tokenizer))


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _pieces(tokenizer: str, size: int):
    """(doc_id, text as bytes) to pieces, each with its file's number and its rank there among its length."""

    def cut(batches):
        words = word_ids(tokenizer)
        part, seen = TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            kind = batch.schema.field(0).type
            for at in range(0, len(batch), 1_000):
                out = []
                for doc_id, text in zip(*batch.slice(at, 1_000).columns, strict=True):
                    ids = words.of(text.as_py())
                    for k, start in enumerate(range(0, len(ids), 4 * size)):
                        piece = ids[start : start + 4 * size]
                        n = len(piece) // 4
                        out.append((doc_id.as_py(), k, start // 4, n, zlib.crc32(piece), part, seen[n]))
                        seen[n] += 1
                kinds = [kind, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)],
                                                 names=["doc_id", "piece", "start", "length", "ids_crc32", "_part", "_rank"])

    return cut


class Plan:
    """Slots for counts of lengths, each (length, first rank, times, first sequence, offset)."""

    def __init__(self, counts: dict[int, int], size: int = SEQUENCE, exact: bool = True):
        self.size = size
        self.left = np.zeros(size + 1, np.int64)
        for length, n in counts.items():
            self.left[length] = n
        self.given = np.zeros(size + 1, np.int64)
        self.slots: list[tuple[int, int, int, int, int]] = []
        self.sequences = 0
        self.put_off = self.left.copy()
        if exact:
            self._exact()
        self._best_fit()

    def _put(self, lengths: list[int], times: int) -> None:
        """``times`` new sequences of these lengths."""
        offset = 0
        for length in lengths:
            self.slots.append((length, int(self.given[length]), times, self.sequences, offset))
            self.given[length] += times
            self.left[length] -= times
            offset += length
        self.sequences += times

    def _times(self, lengths: list[int]) -> int:
        """How often these lengths are available together."""
        wanted = defaultdict(int)
        for length in lengths:
            wanted[length] += 1
        return min(int(self.left[length]) // n for length, n in wanted.items())

    def _two(self, gap: int, most: int, used: list[int]) -> list[int] | None:
        """Two available lengths, the first the longer and at most ``most``, that sum to ``gap``."""
        low, high = (gap + 1) // 2, min(most, gap - 1)
        if low > high:
            return None
        free = self.left > 0
        both = np.flatnonzero(free[low : high + 1] & free[gap - high : gap - low + 1][::-1])
        for k in both[::-1]:
            a = low + int(k)
            if self._times([*used, a, gap - a]):
                return [a, gap - a]
        return None

    def _complement(self, gap: int, used: list[int]) -> list[int] | None:
        """One, two or three available lengths that sum to ``gap``."""
        if self.left[gap] and self._times([*used, gap]):
            return [gap]
        if found := self._two(gap, gap, used):
            return found
        for a in np.flatnonzero(self.left[: gap - 1])[::-1].tolist():
            if 3 * a < gap:
                return None
            if self._times([*used, a]) and (found := self._two(gap - a, a, [*used, a])):
                return [a, *found]
        return None

    def _shorter(self, lengths: list[int], gap: int) -> tuple[list[int], list[int] | None]:
        """These with a shorter last one, and lengths that sum to the gap then: where lengths are much alike, so
        many of the longest may leave a gap that lies between the sums of two and of three."""
        *kept, last = lengths
        free = np.flatnonzero(self.left[:last])[::-1]
        for a in free[:: max(1, -(-len(free) // SHORTER))].tolist():
            if self._times([*kept, a]) and (found := self._complement(gap + last - a, [*kept, a])):
                return [*kept, a], found
        return lengths, None

    def _exact(self) -> None:
        self.put_off = np.zeros(self.size + 1, np.int64)
        for length in range(self.size, 0, -1):
            while self.left[length]:
                lengths, gap = [length], self.size - length
                while gap:
                    longest = np.flatnonzero(self.left[: gap + 1])
                    fits = next((a for a in longest[::-1].tolist() if self._times([*lengths, a])), 0)
                    if not fits or 3 * fits >= gap:
                        break
                    lengths.append(fits)
                    gap -= fits
                found = [] if not gap else self._complement(gap, lengths) if fits else None
                if found is None and fits and len(lengths) > 1 and lengths[-1] <= self.size // SHORT:
                    lengths, found = self._shorter(lengths, gap)
                if found is None:
                    self.put_off[length], self.left[length] = self.left[length], 0
                else:
                    self._put([*lengths, *found], self._times([*lengths, *found]))

    def _best_fit(self) -> None:
        self.left = self.put_off
        open_: dict[int, list[tuple[int, int]]] = defaultdict(list)      # gap: (first sequence, number of sequences)
        gaps: list[int] = []                                             # with an open sequence, in order
        for length in range(self.size, 0, -1):
            while n := int(self.left[length]):
                at = bisect.bisect_left(gaps, length)
                if at == len(gaps):
                    gap, first, many = self.size, self.sequences, 0
                    # Those that share a sequence among themselves do, as each would be the best fit for the next.
                    times = max(1, n // (self.size // length))
                    self.sequences += times
                else:
                    gap = gaps[at]
                    first, many = open_[gap].pop()
                    times = min(n, many)
                    if times < many:
                        open_[gap].append((first + times, many - times))
                    if not open_[gap]:
                        gaps.pop(at)
                for _ in range(min(gap // length, n // times)):
                    self.slots.append((length, int(self.given[length]), times, first, self.size - gap))
                    self.given[length] += times
                    self.left[length] -= times
                    gap -= length
                if gap:
                    if not open_[gap]:
                        bisect.insort(gaps, gap)
                    open_[gap].append((first, times))

    @property
    def least(self) -> int:
        """No plan has fewer sequences: the tokens fill as many, and of lengths over a half no two share one."""
        n = np.arange(self.size + 1)
        return max(-(-sum(int(a) * int(b) for a, b in zip(n, self.given, strict=True)) // self.size), int(self.given[2 * n > self.size].sum()))

    def arrays(self) -> np.ndarray:
        """The slots by length and rank, one column each."""
        return np.array(sorted(self.slots), np.int64).reshape(-1, 5).T.copy()


def best_plan(counts: dict[int, int], size: int = SEQUENCE) -> Plan:
    """Exact complements first; where that falls short of what no plan can beat and best fit alone needs fewer, that."""
    plan = Plan(counts, size)
    return plan if plan.sequences == plan.least else min(plan, Plan(counts, size, exact=False), key=lambda p: p.sequences)


def _placed(plan: np.ndarray, names: list[str]):
    lengths, ranks, _, first, offset = plan
    begins = np.unique(lengths, return_index=True)

    def place(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("_at").to_numpy()
            at = np.empty(len(batch), np.int64)
            for value in np.unique(length):
                mine = length == value
                k = int(np.searchsorted(begins[0], value))
                low, high = begins[1][k], begins[1][k + 1] if k + 1 < len(begins[1]) else len(lengths)
                at[mine] = low + np.searchsorted(ranks[low:high], rank[mine], "right") - 1
            kept = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(first[at] + rank - ranks[at]), pa.array(offset[at])], names=[*names, "sequence_id", "offset"])

    return place


def packed(docs: DataFrame, tokenizer: str = TOKENIZER, size: int = SEQUENCE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece of ``docs`` (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    pieces = stored(rows.mapInArrow(_pieces(tokenizer, size), PIECES.format(kind)), "pieces")
    files = stored(pieces.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("n")), "lengths")
    # One number a length: at most ``size`` rows, whatever the number of documents.
    counts = {r["length"]: r["n"] for r in files.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = best_plan(counts, size).arrays()
    before = F.sum("n").over(Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    begins = stored(files.select("length", "_part", F.coalesce(before, F.lit(0)).alias("_before")), "begins")
    ranked = pieces.join(begins.hint("merge"), ["length", "_part"]).withColumn("_at", F.col("_before") + F.col("_rank"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return ranked.select(*names, "_at").mapInArrow(_placed(plan, names), f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir))
