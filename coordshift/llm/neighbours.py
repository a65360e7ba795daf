"""Approximate nearest neighbours by randomly rotated one-bit codes.

Vectors are assigned to the nearest of a few centres (k-means on a bounded
sample), and the unit residual, turned by a random rotation, is kept as one
sign bit per dimension with two scalars: the residual's length and the inner
product of the residual and its code. A query's residual is cut to 8-bit
planes, and inner products with all codes of a list come from the bits that
its planes share with them. The scalars make the estimate unbiased and give a
bound of its error; every vector whose lower bound of the distance isn't above
the k-th least upper bound is measured exactly, in double precision.

A query looks into its ``FIRST`` nearest lists, and then into every other list
that can hold a nearer vector than the k-th found so far: one whose centre is
no farther than that distance and the length of the list's longest residual.
No list is given up, so what is missed comes from the codes' bounds alone,
whatever the number of vectors: lists save work where vectors have clusters,
and where they don't, the codes of all lists are read.

Small lists are packed to blocks of about ``BLOCK`` vectors, large ones cut to
several; a block is a task, a query is sent to a block once, and every block
returns its k nearest at most.

Defined cases: vectors that are null, zero, of another length than most, or
hold null or non-finite components take no part, nor do null ids; ties go to
the smaller id; repeated vectors are candidates like others; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coordshift.llm.common import arrow_schema, batch, checkpointed, mixed, table

#: Vectors that the centres are fitted on.
SAMPLE = 20_000
#: Vectors in one block of lists.
BLOCK = 20_000
#: Lists that a query looks into before the others are judged.
FIRST = 8
#: Width of the error bound in standard deviations.
SIGMAS = 3.0
PLANES = 8


def valid_vectors(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id (long), v (array of double) of the vectors that take part."""
    v = rows.select(rows[vec_id].cast("long").alias("vec_id"), rows[embedding].cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    fine = v.where("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    sizes = fine.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return fine.where(F.size("v") == (sizes["n"] if sizes else 0))


def centres_of(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(11)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = nearest(x, c, 1)[:, 0]
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(c))
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray, k: int) -> np.ndarray:
    """The k centres nearest to each row, nearest first."""
    out = []
    for start in range(0, len(x), 2048):
        d = (c * c).sum(axis=1) - 2 * (x[start : start + 2048] @ c.T)
        part = np.argpartition(d, k - 1, axis=1)[:, :k] if k < len(c) else np.tile(np.arange(len(c)), (len(d), 1))
        out.append(np.take_along_axis(part, np.argsort(np.take_along_axis(d, part, axis=1), axis=1, kind="stable"), axis=1))
    return np.concatenate(out) if out else np.zeros((0, k), dtype=int)


def rotation(dim: int) -> np.ndarray:
    """A random orthogonal matrix over dim, rounded up to whole 64-bit words."""
    wide = -(-dim // 64) * 64
    q, r = np.linalg.qr(np.random.default_rng(5).standard_normal((wide, wide)))
    return (q * np.sign(np.diag(r)))[:dim]


def encode(residual: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits, residual length, and inner product of unit residual and code."""
    length = np.linalg.norm(residual, axis=1)
    turned = (residual / np.maximum(length, 1e-300)[:, None]) @ turn
    codes = np.packbits(turned > 0, axis=1, bitorder="little").view("<u8")
    match = np.abs(turned).sum(axis=1) / np.sqrt(turn.shape[1])
    return codes, length, match


def estimates(codes: np.ndarray, query: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """For unit query residuals: inner products with each code (query, code), and the bound of the planes' rounding."""
    wide = turn.shape[1]
    turned = query @ turn
    low = turned.min(axis=1)
    step = np.maximum((turned.max(axis=1) - low) / ((1 << PLANES) - 1), 1e-12)
    cut = np.rint((turned - low[:, None]) / step[:, None]).astype(np.uint16)
    shared = np.zeros((len(query), len(codes)), dtype=np.int64)
    for j in range(PLANES):
        plane = np.packbits((cut >> j & 1).astype(np.uint8), axis=1, bitorder="little").view("<u8")
        bits = np.zeros(shared.shape, dtype=np.int64)
        for w in range(plane.shape[1]):
            bits += np.bitwise_count(plane[:, w, None] & codes[None, :, w])
        shared += bits << j
    ones = np.bitwise_count(codes).sum(axis=1).astype(np.int64)
    inner = 2 * (low[:, None] * ones + step[:, None] * shared) - (low * wide + step * cut.sum(axis=1))[:, None]
    return inner / np.sqrt(wide), step / 2 * np.sqrt(wide), wide


def search_block(queries: np.ndarray, query_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, codes: np.ndarray, length: np.ndarray, match: np.ndarray, centre: np.ndarray, turn: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, ids and distances of each query's k nearest in a block."""
    out: list[tuple[int, int, float]] = []
    safe = np.maximum(match, 1e-9)
    spread = np.sqrt(np.maximum(1 - match * match, 0)) / safe * SIGMAS / np.sqrt(max(turn.shape[1] - 1, 1))
    for start in range(0, len(queries), 64):
        q = queries[start : start + 64]
        residual = q - centre
        far = np.linalg.norm(residual, axis=1)
        inner, rounding, _ = estimates(codes, residual / np.maximum(far, 1e-300)[:, None], turn)
        like = inner / safe
        error = spread[None, :] + rounding[:, None] / safe
        scale = 2 * far[:, None] * length[None, :]
        base = far[:, None] ** 2 + length[None, :] ** 2
        upper = base - scale * np.maximum(like - error, -1)
        lower = base - scale * np.minimum(like + error, 1)
        own = ids[None, :] == query_ids[start : start + 64, None]
        upper[own] = np.inf
        kth = np.partition(upper, k - 1, axis=1)[:, k - 1] if upper.shape[1] > k else np.full(len(q), np.inf)
        chosen = (lower <= (kth * (1 + 1e-9) + 1e-12)[:, None]) & ~own
        for i in range(len(q)):
            at = np.flatnonzero(chosen[i])
            exact = np.sqrt(((x[at] - q[i]) ** 2).sum(axis=1))
            best = np.lexsort((ids[at], exact))[:k]
            out += zip([query_ids[start + i]] * len(best), ids[at[best]].tolist(), exact[best].tolist(), strict=True)
    return tuple(np.array([o[i] for o in out]) for i in range(3)) if out else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    parts = column.to_pylist()
    return np.frombuffer(b"".join(parts), dtype="<f8").reshape(-1, dim)


def _blocks_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first block, number of blocks) of each list, small lists packed together."""
    first, cuts, block, held = np.zeros(len(counts), dtype=np.int64), np.ones(len(counts), dtype=np.int64), 0, 0
    for i, n in enumerate(counts.tolist()):
        if held and held + n > BLOCK:
            block, held = block + 1, 0
        first[i], cuts[i] = block, max(1, -(-n // BLOCK))
        held += n
        if cuts[i] > 1:
            block, held = block + int(cuts[i]), 0
    return first, cuts


def search(rows: DataFrame, is_query: Column, k: int = 10, lists: int | None = None, probes: int = FIRST) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query, by Euclidean distance."""
    spark = rows.sparkSession
    vectors = valid_vectors(rows)
    n = vectors.count()
    names = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], names)
    share = min(1.0, 1.2 * SAMPLE / n)
    picked = vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < int(share * 1_000_000)).select("v").limit(SAMPLE)
    sample = np.array([r[0] for r in picked.collect()])
    if not len(sample):
        sample = np.array([r[0] for r in vectors.select("v").limit(SAMPLE).collect()])
    dim = sample.shape[1]
    lists = lists or int(np.clip(np.sqrt(n) / 2, 1, 65_536))
    centres, turn = centres_of(sample, min(lists, len(sample))), rotation(dim)
    model = spark.sparkContext.broadcast((centres, turn))
    coded = "list int, vec_id long, codes binary, length double, match double, raw binary"

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, turn = model.value
        for b in batches:
            if not b.num_rows:
                continue
            x = np.stack(b.column("v").to_numpy(zero_copy_only=False))
            near = nearest(x, centres, 1)[:, 0]
            codes, length, match = encode(x - centres[near], turn)
            yield batch(arrow_schema(coded), near.astype(np.int32), b.column("vec_id"), [c.tobytes() for c in codes], length, match, [v.tobytes() for v in x])

    index = checkpointed(vectors.mapInArrow(code, coded))
    # one row for each centre at most
    known = index.groupBy("list").agg(F.count("*").alias("n"), F.max("length").alias("far")).collect()
    counts, reach = np.zeros(len(centres), dtype=np.int64), np.full(len(centres), -np.inf)
    for r in known:
        counts[r["list"]], reach[r["list"]] = r["n"], r["far"]
    layout = spark.sparkContext.broadcast((*_blocks_of(counts), reach))
    dealt = "block long, " + coded

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, cuts, _ = layout.value
        for b in batches:
            own = b.column("list").to_numpy()
            block = first[own] + (mixed(b.column("vec_id").to_numpy().astype(np.uint64)) % cuts[own].astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(block), *b.columns], schema=arrow_schema(dealt))

    asked = "block long, query_id long, raw binary, lists binary"

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Without a column kth, the nearest lists; with it, those others that may hold a nearer vector."""
        centres, _ = model.value
        first, cuts, reach = layout.value
        for b in batches:
            if not b.num_rows:
                continue
            x = np.stack(b.column("v").to_numpy(zero_copy_only=False))
            near = nearest(x, centres, min(probes, len(centres)))
            kth = b.column("kth").to_numpy() if "kth" in b.schema.names else None
            out: list[tuple[int, int, bytes, bytes]] = []
            for i, (name, v) in enumerate(zip(b.column("vec_id").to_pylist(), x, strict=True)):
                wanted = near[i]
                if kth is not None:
                    far = np.sqrt(((centres - v) ** 2).sum(axis=1))
                    wanted = np.setdiff1d(np.flatnonzero(far - reach <= kth[i] * (1 + 1e-9) + 1e-9), near[i])
                places = first[wanted]
                for block in np.unique(places).tolist():
                    here = wanted[places == block].astype("<i4")
                    # a list of many blocks shares them with no other
                    out += [(block + c, name, v.tobytes(), here.tobytes()) for c in range(int(cuts[here].max()))]
            if out:
                yield batch(arrow_schema(asked), *([o[i] for o in out] for i in range(4)))

    found = "query_id long, vec_id long, score double"

    def look(own: pa.Table, wanted: pa.Table) -> pa.Table:
        centres, turn = model.value
        if not own.num_rows or not wanted.num_rows:
            return arrow_schema(found).empty_table()
        codes = np.frombuffer(b"".join(own.column("codes").to_pylist()), dtype="<u8").reshape(own.num_rows, -1)
        x, ids, which = _matrix(own.column("raw"), dim), own.column("vec_id").to_numpy(), own.column("list").to_numpy()
        length, match = own.column("length").to_numpy(), own.column("match").to_numpy()
        queries, names = _matrix(wanted.column("raw"), dim), wanted.column("query_id").to_numpy()
        asks = [np.frombuffer(w, dtype="<i4") for w in wanted.column("lists").to_pylist()]
        flat, row = np.concatenate(asks), np.repeat(np.arange(len(asks)), list(map(len, asks)))
        parts = []
        for one in np.unique(which).tolist():
            q, at = row[flat == one], np.flatnonzero(which == one)
            if len(q):
                parts.append(search_block(queries[q], names[q], x[at], ids[at], codes[at], length[at], match[at], centres[one], turn, k))
        if not parts:
            return arrow_schema(found).empty_table()
        query, vec, score = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((vec, score, query))
        query, vec, score = query[order], vec[order], score[order]
        head = np.maximum.accumulate(np.where(np.append(True, query[1:] != query[:-1]), np.arange(len(query)), 0)) if len(query) else query
        top = np.arange(len(query)) - head < k
        return pa.Table.from_batches([batch(arrow_schema(found), query[top], vec[top], score[top])])

    index = index.mapInArrow(deal, dealt)
    queries = vectors.where(is_query)
    near = checkpointed(index.groupBy("block").cogroup(queries.mapInArrow(ask, asked).groupBy("block")).applyInArrow(look, found))
    kth = near.groupBy("query_id").agg(F.when(F.count("*") >= k, F.element_at(F.array_sort(F.collect_list("score")), k)).alias("kth"))
    # at most k rows of each block a query has looked into
    judged = queries.join(kth, queries["vec_id"] == kth["query_id"], "left").select("vec_id", "v", F.coalesce("kth", F.lit(float("inf"))).alias("kth"))
    more = index.groupBy("block").cogroup(judged.mapInArrow(ask, asked).groupBy("block")).applyInArrow(look, found)
    ranked = near.union(more).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op2_neighbours(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
