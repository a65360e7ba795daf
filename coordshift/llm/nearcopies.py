"""Near-duplicate groups: wide SimHash fingerprints, a generalised pigeonhole, exact Jaccard similarity.

A text is the set of hashes of its runs of ``shingle`` words; its fingerprint
has the bits set in over half of them. Two sets of Jaccard similarity s differ
in a bit with the chance arccos(2s / (1 + s)) / pi, 0.152 at 0.8. Fingerprints
are split into parts of correlated bits (``simhash.links``); texts that agree
in a part and differ in few of the first ``SENT`` words' bits are candidates.
A limit on all bits that no pair at 0.8 exceeds would need parts with too many
values near each, so the parts are narrow enough, and so many, that a pair at
the similarity agrees in one with the chance ``RECALL``: both grow with the
logarithm of the rows, the chance stays. Candidates' whole sets are then
compared within each connected group, so no link is below the similarity.

Sets of four and five hashes with four in common, 0.8 alike, differ in a bit
with the chance 3 / 16, the highest of all: for them ``RECALL`` is about 0.99.

Defined cases: as in ``minhash``.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, log, log2, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coordshift.llm import simhash
from coordshift.llm.common import checkpointed, components, document_text, slices
from coordshift.llm.minhash import labelled, verified

RECALL = 0.9996
#: Words of a fingerprint that are compared, and standard deviations above the mean distance that are let through.
SENT, SPREAD = 3, 5
#: Fingerprints under one part value whose pairs are all compared side by side.
SMALL = 256


def plan(rows: int, similarity: float) -> tuple[int, int, int]:
    """(bits of a part, words of a fingerprint, most differing bits of the words sent)."""
    differ = acos(2 * similarity / (1 + similarity)) / pi
    # about 64 fingerprints share a part's value by chance
    width = min(max(8, int(log2(max(rows, 2))) - 6), 40)
    parts = ceil(log(1 - RECALL) / log(1 - (1 - differ) ** width))
    bits = 64 * SENT
    return width, max(SENT + 1, -(-parts * width // 64)), ceil(bits * differ + SPREAD * sqrt(bits * differ * (1 - differ)))


def signatures(docs: DataFrame, shingle: int, words: int) -> DataFrame:
    """doc_id, tie (hash of the text), node (hash of the set), size, fp."""
    source = document_text(docs).withColumn("tie", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [np.unique(simhash.shingle_hashes(t, shingle)) for t in b.column("text").to_pylist()]
            nodes = np.array([xxhash.xxh64_intdigest(s.tobytes(), simhash.SEED) for s in sets], dtype=np.uint64).view(np.int64)
            fps = pa.array([x.tobytes() for x in simhash.fingerprints(sets, words)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tie"), pa.array(nodes), pa.array([len(s) for s in sets], pa.int64()), fps], names=["doc_id", "tie", "node", "size", "fp"])

    return source.mapInArrow(run, "doc_id long, tie long, node long, size long, fp binary")


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, rows: int | None = None) -> DataFrame:
    """doc_id, tie (xxhash64 of the text), component_id (smallest doc_id of the group), first_tie (its tie); one row per row of ``docs``.

    ``rows``: the number that fingerprints are made for, that of ``docs`` by default.
    """
    width, words, limit = plan(rows or docs.count(), similarity)
    prints = checkpointed(signatures(docs, shingle, words))
    known = prints.where("doc_id is not null")
    distinct = checkpointed(known.groupBy("node").agg(F.min(F.struct("doc_id", "tie")).alias("at"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.count("*").alias("copies")))
    candidates = simhash.links(distinct.where("size > 0").select("node", "fp"), limit, words, width, SENT, SMALL)
    found = verified(docs, distinct, components(candidates), distinct.count(), shingle, similarity)
    return labelled(prints, distinct, found)
