"""Near-duplicate groups: MinHash candidates, verified by exact Jaccard similarity.

A text is the set of hashes of its runs of ``shingle`` words. ``BANDS`` keys of
``ROWS`` least values each are made of the set; texts that share a key are
candidates. Two sets of Jaccard similarity s share one with the chance
1 - (1 - s ** ROWS) ** BANDS, whatever the number of rows: 0.9996 at 0.8.
Within each connected group of candidates every pair may be compared on its
whole sets; links are a spanning forest of the pairs that are similar enough.
Groups of more than ``VOLUME`` shingles are dealt in blocks, each two of which
meet in one task.

Defined cases: null and empty texts have the empty set, and are linked; texts
of fewer than ``shingle`` words are one run; texts with equal sets are one
node, so groups of copies are compared once; rows with a null doc_id get a null
component; repeated rows stay repeated; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coordshift.llm.common import arrow_schema, batch, checkpointed, components, document_text, joined_by, mixed, slices
from coordshift.llm.simhash import SEED, shingle_hashes

BANDS, ROWS = 20, 5
#: Shingles of a candidate group that one task holds on each side.
VOLUME = 1_000_000
_FACTORS = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_PIECE = 2048


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """One key for each band of a set of hashes."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for start in range(0, len(shingles), _PIECE):
        np.minimum(least, (shingles[start : start + _PIECE, None] * _FACTORS).min(axis=0), out=least)
    key = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + column)
    return key


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, tie (hash of the text), node (hash of the set), size, keys."""
    names = "doc_id long, tie long, node long, size long"
    source = document_text(docs).withColumn("tie", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [np.unique(shingle_hashes(t, shingle)) for t in b.column("text").to_pylist()]
            nodes = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], dtype=np.uint64).view(np.int64)
            keys = pa.array([band_keys(s).view(np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tie"), pa.array(nodes), pa.array([len(s) for s in sets], pa.int64()), keys], names=["doc_id", "tie", "node", "size", "keys"])

    return source.mapInArrow(run, f"{names}, keys array<long>")


def similar_links(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sets (sorted, each value once) with at least this Jaccard similarity."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    values, ids = np.unique(np.concatenate(sets), return_inverse=True) if len(sets) else (np.zeros(0), np.zeros(0, dtype=np.int64))
    ends = np.cumsum(sizes)
    own = [ids[e - s : e] for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
    mark, out = np.zeros(len(values), dtype=bool), []
    rest = np.flatnonzero(sizes > 0)
    while len(rest):
        edge, rest = [int(rest[0])], rest[1:]
        joined = starts = None
        while edge and len(rest):
            if joined is None:
                joined = np.concatenate([own[i] for i in rest])
                starts = np.cumsum(sizes[rest]) - sizes[rest]
            i = edge.pop()
            mark[own[i]] = True
            both = np.add.reduceat(mark[joined], starts, dtype=np.int64)
            mark[own[i]] = False
            near = both >= similarity * (sizes[i] + sizes[rest] - both) - 1e-9
            if near.any():
                found = rest[near].tolist()
                out += [(i, j) for j in found]
                edge += found
                rest, joined = rest[~near], None
    return out


def links(docs: DataFrame, distinct: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """a, b: nodes of similar sets, enough of them to connect all candidates that are connected. ``distinct``: node, at, size, keys."""
    total = distinct.count()
    keyed = distinct.where("size > 0").select("node", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.count("*").alias("n")).where("a <> b").select("key", "a", "n")
    groups = components(joined_by(keyed, shared, ["key"], total * BANDS).where("node <> a").select("a", F.col("node").alias("b")))
    return verified(docs, distinct, groups, total, shingle, similarity)


def verified(docs: DataFrame, distinct: DataFrame, groups: DataFrame, total: int, shingle: int, similarity: float) -> DataFrame:
    """a, b: nodes of similar sets within ``groups`` of candidates (node, component), compared on their whole sets."""
    members = distinct.select("node", "at.doc_id", "at.tie", "size").join(groups, "node")
    blocks = members.groupBy("component").agg(F.ceil(F.sum("size") / VOLUME).alias("blocks"), F.count("*").alias("n"))
    dealt = joined_by(members, blocks, ["component"], total).withColumn("own", F.pmod(F.xxhash64("node"), "blocks"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).where("blocks = 1 or own <> other")
    dealt = dealt.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
    texts = document_text(docs).withColumn("tie", F.xxhash64("text"))
    # of repeated rows any one: their texts are equal
    chosen = texts.join(members.select("doc_id", "tie", "node"), ["doc_id", "tie"]).dropDuplicates(["node"]).select("node", "text")
    names = "a long, b long"

    def compare(t: pa.Table) -> pa.Table:
        nodes = t.column("node").to_numpy()
        pairs = similar_links([np.unique(shingle_hashes(x, shingle)) for x in t.column("text").to_pylist()], similarity)
        return pa.Table.from_batches([batch(arrow_schema(names), [nodes[i] for i, _ in pairs], [nodes[j] for _, j in pairs])])

    return dealt.select("component", "low", "high", "node").join(chosen, "node").groupBy("component", "low", "high").applyInArrow(compare, names)


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, tie (xxhash64 of the text), component_id (smallest doc_id of the group), first_tie (its tie); one row per row of ``docs``."""
    prints = checkpointed(signatures(docs, shingle))
    known = prints.where("doc_id is not null")
    distinct = checkpointed(known.groupBy("node").agg(F.min(F.struct("doc_id", "tie")).alias("at"), F.first("size").alias("size"), F.first("keys").alias("keys"), F.count("*").alias("copies")))
    return labelled(prints, distinct, links(docs, distinct, shingle, similarity))


def labelled(prints: DataFrame, distinct: DataFrame, found: DataFrame) -> DataFrame:
    """``near_duplicates`` of the texts in ``prints``, whose nodes are linked by ``found``."""
    known = prints.where("doc_id is not null")
    groups = components(found)
    named = distinct.select("node", "at", "copies").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = checkpointed(named)
    firsts = named.groupBy("component").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    labels = joined_by(named, firsts, ["component"], named.count()).select("node", "first", F.col("copies").alias("n"))
    out = joined_by(known.select("doc_id", "tie", "node"), labels, ["node"], prints.count())
    none = F.lit(None).cast("long")
    lost = prints.where("doc_id is null").select("doc_id", "tie", none.alias("component_id"), none.alias("first_tie"))
    return out.select("doc_id", "tie", F.col("first.doc_id").alias("component_id"), F.col("first.tie").alias("first_tie")).union(lost)
