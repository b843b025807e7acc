"""Near-duplicate documents by min-max hashing.

A document is the set of its five-word shingles. Signatures keep the minimum
and the maximum under each of 80 permutations, so 160 places cost 80 hash
evaluations; 32 bands of 5 places find a pair of similarity 0.75 but for one
time in 5,000, and pairs of 0.85 but for one in ten million. Links are decided
on full sets (`near.py`).

Documents with equal sets are one class and are compared once. Null, empty and
blank texts have no shingles: they are linked with nothing and kept. Rows that
repeat a doc_id with the same text give the same result; a null doc_id takes
part as no node: its row comes back with a null component and kept true. Very long
texts are sketched and compared whole. An empty table gives an empty table. Other
columns are not read, whatever their names. Different texts under one doc_id are
not told apart: one of them, any, stands for the id where sets are compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from recordloom.llm.common import documents, stored
from recordloom.llm.components import components
from recordloom.llm.near import links
from recordloom.llm.shingles import MinMax, packed, shingle_set, words

PERMUTATIONS, BANDS, ROWS = 80, 32, 5
PERCENT = 75
CHUNK = 1 << 16      # shingles hashed at a time


def sketcher(signer: MinMax, bands: int, rows: int):
    """Batches of (id, text) to (id, n, digest, keys, sig)."""

    def sketch(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            at, sets, held = 0, [], 0
            for k in range(len(ids)):
                s = shingle_set(words(texts[k].as_py()))
                sets.append(s)
                held += len(s)
                if held >= CHUNK or k == len(ids) - 1:
                    yield _rows(ids.slice(at, len(sets)), sets, signer, bands, rows)
                    at, sets, held = k + 1, [], 0

    return sketch


def _rows(ids: pa.Array, sets: list[np.ndarray], signer: MinMax, bands: int, rows: int) -> pa.RecordBatch:
    full = [s for s in sets if len(s)]
    n = np.array([len(s) for s in sets], np.int64)
    keys = sigs = iter(())
    if full:
        sig = signer.signatures(*packed(full))
        keys = iter(signer.keys(sig, bands, rows).view(np.int64))
        sigs = iter((sig >> np.uint64(24)).astype(np.uint8))
    digest = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
    own_keys = [next(keys) if m else None for m in n]
    own_sigs = [next(sigs).tobytes() if m else None for m in n]
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(n), pa.array(digest, pa.binary()), pa.array(own_keys, pa.list_(pa.int64())), pa.array(own_sigs, pa.binary())],
        names=["id", "n", "digest", "keys", "sig"])


def shingle_lists(batches):
    """Batches of (id, text) to (id, elements)."""
    for batch in batches:
        for at in range(0, len(batch), 256):
            part = batch.slice(at, 256)
            lists = [shingle_set(words(t.as_py())).view(np.int64) for t in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lists, pa.list_(pa.int64()))], names=["id", "elements"])


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs`` (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.col("doc_id").alias("id"), "text")
    sketch = sketcher(MinMax(PERMUTATIONS), BANDS, ROWS)
    sketches = stored(rows.mapInArrow(sketch, f"id {kind}, n bigint, digest binary, keys array<bigint>, sig binary"), "sketches")

    known = sketches.where("id IS NOT NULL AND n > 0")
    classes = stored(known.groupBy("digest").agg(F.min("id").alias("rep")), "classes")
    first = classes.select(F.col("rep").alias("id"), "digest").hint("merge")
    reps = stored(known.join(first, ["id", "digest"], "left_semi").dropDuplicates(["id", "digest"]), "reps")

    def sets_of(ids: DataFrame) -> DataFrame:
        wanted = rows.join(ids.hint("merge"), "id", "left_semi").dropDuplicates(["id"])
        return wanted.mapInArrow(shingle_lists, f"id {kind}, elements array<bigint>")

    found = components(links(reps, sets_of, percent))
    grouped = classes.join(found, classes["rep"] == found["id"], "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    grouped = stored(grouped, "grouped")
    out = sketches.select("id", "n", "digest").join(grouped.hint("merge"), "digest", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The documents but for those that a smaller doc_id of their group stands for."""
    gone = near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
