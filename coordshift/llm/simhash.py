"""SimHash near-duplicate groups by a generalised pigeonhole.

Fingerprints of ``64 * words`` bits are split into parts of correlated bits.
If two fingerprints differ in at most ``limit`` bits and the parts' thresholds
t satisfy sum(t + 1) = limit + 1, then some part differs in at most its own t
bits. The thresholds are unequal: dynamic programming picks those with the
least estimated work. Per part, every fingerprint is filed under its own part
value and, for t > 0, under the values near it; fingerprints that meet under a
value are compared in full. Only a spanning forest of links is emitted for the
values compared together, never all pairs, and values with very many
fingerprints are compared block by block in separate tasks.

Defined cases: null and empty texts have the zero fingerprint and are linked
like others; equal texts have equal fingerprints; rows with a null doc_id get
a fingerprint and a null component; repeated rows stay repeated; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coordshift.llm.common import arrow_schema, batch, checkpointed, components, document_text, mixed, shuffle_partitions, slices
from coordshift.llm.suffix import pack, unpack

SEED = 42
#: Fingerprints under one part value that one task compares with each other.
BLOCK = 20_000
#: Part of ``BLOCK`` that a value's count may miss, words of fingerprints counted together, and links held before they are made a forest.
_MISSED, _COUNTED, _LINKS = 0.25, 1 << 19, 1 << 20
_BITS = 1 << 12
#: Rows of the matrix of bit counts that travel together, and groups that each strip is first added in.
_STRIP = 32
_SALTS = 32


def shingle_hashes(text: str, k: int) -> np.ndarray:
    """XXH64 of each run of k words (all words, if fewer), repeats included."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, dtype="<u8")
    joined, sizes = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    k = min(k, len(words))
    starts = (ends - sizes)[: len(words) - k + 1].tolist()
    hashes = map(xxhash.xxh64_intdigest, [joined[a:b] for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)], repeat(SEED))
    return np.fromiter(hashes, dtype="<u8", count=len(starts))


def fingerprints(hashes: list[np.ndarray], words: int) -> np.ndarray:
    """One row of ``words`` 64-bit words per array of hashes: the bits set in over half of them."""
    out = np.zeros((len(hashes), words), dtype="<u8")
    for i, h in enumerate(hashes):
        counts = np.zeros((words, 64), dtype=np.int64)
        for start in range(0, len(h), _BITS):
            piece = h[start : start + _BITS]
            for w in range(words):
                own = piece if w == 0 else mixed(piece + np.uint64(w * 0x632BE59BD9B4E019 & (1 << 64) - 1))
                bits = np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                counts[w] += bits.sum(axis=0, dtype=np.uint16)
        out[i] = np.packbits(2 * counts > len(h), axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def fingerprint(docs: DataFrame, shingle: int = 4, words: int = 1, *more) -> DataFrame:
    """doc_id, fp (binary, 8 * words bytes little-endian), and the columns ``more``."""
    source = document_text(docs, *more)
    kept = [c for c in source.columns if c != "text"]
    schema = source.drop("text").schema.add("fp", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=16 << 20):
            fps = fingerprints([shingle_hashes(t, shingle) for t in b.column("text").to_pylist()], words)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array([x.tobytes() for x in fps], pa.binary())], names=[*kept, "fp"])

    return source.mapInArrow(run, schema)


def _bits(raw: np.ndarray) -> np.ndarray:
    return np.unpackbits(raw.view(np.uint8).reshape(len(raw), -1), axis=1, bitorder="little")


def _raw(column: pa.Array, words: int) -> np.ndarray:
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, dtype="<u8").reshape(-1, words)


def bit_statistics(distinct: DataFrame, words: int) -> np.ndarray:
    """Matrix of counts of fingerprints with bits i and j both set, over all rows; one row more holds the number of rows.

    The matrix is symmetric: tasks send its upper half in compressed strips of
    rows, which are added in two steps.
    """
    n = 64 * words
    names = "strip int, salt int, block binary, rows long"
    schema = arrow_schema(names)
    strips = [slice(i, i + _STRIP) for i in range(0, n, _STRIP)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows, salt = np.zeros((n, n)), 0, 0
        for b in batches:
            if b.num_rows:
                raw = _raw(b.column("fp"), words)
                x = _bits(raw).astype(np.float32)
                total += x.T @ x
                salt = salt or int(mixed(raw[:1, 0])[0] % np.uint64(_SALTS))
                rows += len(x)
        if rows:
            blocks = [pack(total[s, s.start :].astype("<i8").ravel()) for s in strips]
            yield batch(schema, range(len(strips)), [salt] * len(strips), blocks, [rows] * len(strips))

    def add(t: pa.Table) -> pa.Table:
        total = sum(unpack(b.as_py(), ["<i8"])[0] for b in t.column("block"))
        return pa.Table.from_batches([batch(schema, [t.column("strip")[0].as_py()], [0], [pack(total)], [sum(t.column("rows").to_pylist())])])

    sent = distinct.select("fp").mapInArrow(run, names)
    sums = sent.groupBy("strip", "salt").applyInArrow(add, names).groupBy("strip").applyInArrow(add, names).collect()  # one row for each strip
    out, rows = np.zeros((n, n)), 0
    for r in sums:
        s, rows = strips[r["strip"]], r["rows"]
        out[s, s.start :] = unpack(bytes(r["block"]), ["<i8"])[0].reshape(_STRIP, -1)
        out[s.start :, s] = out[s, s.start :].T
    return np.append(out.ravel(), rows)


def group_bits(together: np.ndarray, rows: float, sizes: list[int]) -> list[list[int]]:
    """Bits in parts of the given sizes, each grown from its most correlated pair by total correlation."""
    p = np.diag(together) / max(rows, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    like = np.abs(together / max(rows, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(like, 0)
    free, parts = np.ones(len(p), dtype=bool), []
    for size in sizes:
        masked = np.where(np.outer(free, free), like, -1)
        first = int(np.argmax(masked.max(axis=1)))
        part, pull = [first], like[first].copy()
        free[first] = False
        while len(part) < size:
            new = int(np.argmax(np.where(free, pull, -1)))
            part.append(new)
            free[new] = False
            pull += like[new]
        parts.append(sorted(part))
    return parts


def allocate(parts: list[list[int]], p: np.ndarray, rows: float, limit: int, most: int = 2) -> list[int]:
    """Thresholds t >= -1 with sum(t + 1) = limit + 1 and the least estimated work.

    Work of a part: rows filed, each worth 20 comparisons, and candidate
    comparisons. Candidates are estimated from each bit's chance 2p(1-p) to
    differ between two fingerprints.
    """

    def work(part: list[int], t: int) -> float:
        if t < 0:
            return 0.0
        differ = 2 * p[part] * (1 - p[part])
        chance = np.zeros(t + 1)
        chance[0] = 1
        for d in differ:
            chance[1:] = chance[1:] * (1 - d) + chance[:-1] * d
            chance[0] *= 1 - d
        w = len(part)
        near = [1, 1 + w, 1 + w + w * (w - 1) // 2]
        return 20 * rows * (near[t // 2] + (near[(t + 1) // 2] if t else 0)) + rows * rows / 2 * chance.sum()

    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for part in parts:
        new: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, ts) in best.items():
            for t in range(-1, most + 1):
                at = spent + t + 1
                if at <= limit + 1 and (at not in new or cost + work(part, t) < new[at][0]):
                    new[at] = (cost + work(part, t), [*ts, t])
        best = new
    return best[limit + 1][1]


def part_width(rows: float, bits: int, limit: int) -> int:
    """Enough bits that a part's value is shared by few of the fingerprints by chance."""
    slack = 3 if limit * 8 <= bits else -1
    width = int(np.log2(max(rows, 2)) + slack)
    return max(8, min(width, bits // 2, 40))


def part_keys(bits: np.ndarray, part: list[int], number: int) -> np.ndarray:
    """Part values as 40-bit integers below the part's number."""
    padded = np.zeros((len(bits), 64), dtype=np.uint8)
    padded[:, : len(part)] = bits[:, part]
    return np.packbits(padded, axis=1, bitorder="little").view("<i8")[:, 0] | np.int64(number << 41)


def _flips(width: int, count: int) -> np.ndarray:
    one = np.int64(1) << np.arange(width, dtype=np.int64)
    out = [np.zeros(1, dtype=np.int64)]
    if count >= 1:
        out.append(one)
    if count >= 2:
        raise ValueError("at most one flip on a side")
    return np.concatenate(out)


def file_under(distinct: DataFrame, words: int, parts: list[list[int]], ts: list[int], sent: int) -> DataFrame:
    """bucket, filed (the part value itself, not one near it), node, fp (its first ``sent`` words)."""
    schema = arrow_schema("bucket long, filed boolean, node long, fp binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            raw = _raw(b.column("fp"), words)
            bits, fps = _bits(raw), pa.array([x.tobytes() for x in raw[:, :sent]], pa.binary())
            for number, (part, t) in enumerate(zip(parts, ts, strict=True)):
                if t < 0:
                    continue
                keys = part_keys(bits, part, number)
                flips = _flips(len(part), (t + 1) // 2)
                near = _flips(len(part), t // 2)
                for i, flip in enumerate(flips):
                    filed = np.full(len(keys), i < len(near))
                    yield pa.RecordBatch.from_arrays([pa.array(keys ^ flip), pa.array(filed), b.column("node"), fps], schema=schema)

    return distinct.select("node", "fp").mapInArrow(run, "bucket long, filed boolean, node long, fp binary")


def _spanning(fps: np.ndarray, filed: np.ndarray, nodes: np.ndarray, limit: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """A star of links for each component of one bucket; pairs with no filed side aren't compared."""
    left, right = [], []
    rest = np.arange(len(fps))
    while len(rest):
        centre, edge, rest = rest[0], rest[:1], rest[1:]
        while len(edge) and len(rest):
            found = np.zeros(len(rest), dtype=bool)
            for start in range(0, len(edge), 64):
                own = edge[start : start + 64]
                open_ = np.flatnonzero(~found)
                near = np.bitwise_count(fps[own][:, None, :] ^ fps[rest[open_]][None, :, :]).sum(axis=2, dtype=np.uint16) <= limit
                near &= filed[own][:, None] | filed[rest[open_]][None, :]
                found[open_] |= near.any(axis=0)
            edge, rest = rest[found], rest[~found]
            left.append(np.full(len(edge), nodes[centre]))
            right.append(nodes[edge])
    return left, right


def forest(left: list[np.ndarray], right: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Links from the least node of each component of the links left, right to its other nodes."""
    if not left:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    nodes, ids = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    a, b = ids[: len(ids) // 2], ids[len(ids) // 2 :]
    up = np.arange(len(nodes))
    while len(a):
        low = np.minimum(up[a], up[b])
        np.minimum.at(up, up[a], low)
        np.minimum.at(up, up[b], low)
        while (up[up] != up).any():
            up = up[up]
        open_ = up[a] != up[b]
        a, b = a[open_], b[open_]
    rest = np.flatnonzero(up != np.arange(len(up)))
    return nodes[up[rest]], nodes[rest]


def bucket_links(bucket: np.ndarray, block: np.ndarray, filed: np.ndarray, nodes: np.ndarray, fps: np.ndarray, limit: int, small: int = 48):
    """A spanning forest of the close pairs within runs of equal (bucket, block); runs up to ``small`` are compared side by side."""
    change = np.flatnonzero((bucket[1:] != bucket[:-1]) | (block[1:] != block[:-1])) + 1
    starts = np.concatenate([[0], change]) if len(bucket) else np.zeros(0, dtype=int)
    sizes = np.diff(np.append(starts, len(bucket)))
    any_filed = np.logical_or.reduceat(filed, starts) if len(starts) else np.zeros(0, dtype=bool)
    left, right, fresh = [], [], 0
    size_at, live_at, end_at = (np.repeat(x, sizes) for x in (sizes, any_filed, starts + sizes))
    at = np.flatnonzero((size_at > 1) & (size_at <= small) & live_at)
    for gap in range(1, small):
        at = at[at + gap < end_at[at]]
        if not len(at):
            break
        ok = at[filed[at] | filed[at + gap]]
        near = np.bitwise_count(fps[ok] ^ fps[ok + gap]).sum(axis=1, dtype=np.uint16) <= limit
        left.append(nodes[ok[near]])
        right.append(nodes[ok[near] + gap])
        fresh += len(left[-1])
        if fresh > _LINKS:
            a, b = forest(left, right)
            left, right, fresh = [a], [b], 0
    for g in np.flatnonzero((sizes > small) & any_filed):
        own = slice(starts[g], starts[g] + sizes[g])
        a, b = _spanning(fps[own], filed[own], nodes[own], limit)
        left += a
        right += b
    return forest(left, right)


def crowding(raw: np.ndarray, parts: list[list[int]], ts: list[int], share: float) -> tuple[np.ndarray, np.ndarray]:
    """Part values that more than ``share`` of the fingerprints ``raw`` are filed under, and how many are."""
    bits, found, counts = _bits(raw), [], []
    for number, (part, t) in enumerate(zip(parts, ts, strict=True)):
        if t >= 0:
            keys, own = np.unique(part_keys(bits, part, number), return_counts=True)
            flips = _flips(len(part), (t + 1) // 2)
            if len(flips) > 1:
                keys, at = np.unique(keys[:, None] ^ flips, return_inverse=True)
                own = np.bincount(at.ravel(), np.repeat(own, len(flips))).astype(np.int64)
            many = own > share * len(raw)
            found.append(keys[many])
            counts.append(own[many])
    return np.concatenate(found), np.concatenate(counts)


def links(distinct: DataFrame, limit: int, words: int = 1, width: int | None = None, sent: int | None = None, small: int = 48) -> DataFrame:
    """a, b: nodes of fingerprints that differ in at most ``limit`` bits, enough of them to connect all that are connected.

    ``distinct``: node (long), fp (binary), each fingerprint once. Exact when
    the part thresholds sum to ``limit``; a wide fingerprint with a large
    limit has at most as many thresholds of zero as parts, and pairs beyond
    that guarantee are found with a chance that falls with their distance.
    ``width``: bits of a part. ``sent``: words of a fingerprint that travel
    and that ``limit`` is meant for; the parts come from all of them.
    ``small``: fingerprints under one value whose pairs are compared side by side.

    A value that more than ``BLOCK`` fingerprints are filed under has more than
    ``_MISSED`` of its share in some piece of the table. Counts are only sent
    from such pieces: they miss ``_MISSED * BLOCK`` at most, which is added to
    each, and no value that is crowded goes without blocks.
    """
    sent = sent or words
    spark = distinct.sparkSession
    counts = bit_statistics(distinct, words)
    rows, n = counts[-1], 64 * words
    together = counts[:-1].reshape(n, n)
    width = width or part_width(rows, n, limit)
    m = max(1, n // width)
    sizes = [n // m + (i < n % m) for i in range(m)]
    if any(s > 40 for s in sizes):
        m = -(-n // 40)
        sizes = [n // m + (i < n % m) for i in range(m)]
    parts = group_bits(together, rows, sizes)
    p = np.diag(together) / max(rows, 1)
    reach = limit if limit * 8 <= n and sent == words else m - 1 if sent < words else min(limit, m - 1)
    ts = allocate(parts, p, rows, reach)
    filed = file_under(distinct, words, parts, ts, sent)
    kinds = arrow_schema("bucket long, n long")
    share, missed, most = _MISSED * BLOCK / max(rows, 1), int(_MISSED * BLOCK), _COUNTED // max(words, 8)

    def crowded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, waiting = [], 0
        for b in chain(batches, [None]):
            if b is not None and b.num_rows:
                piece.append(_raw(b.column("fp"), words))
                waiting += b.num_rows
            if piece and (b is None or waiting >= most):
                yield batch(kinds, *crowding(np.concatenate(piece), parts, ts, share))
                piece, waiting = [], 0

    full = distinct.select("fp").mapInArrow(crowded, "bucket long, n long").groupBy("bucket").agg((F.sum("n") + missed).alias("n")) if rows > BLOCK else None
    many = None if full is None else checkpointed(full.where(F.col("n") > BLOCK).select("bucket", F.ceil(F.col("n") / BLOCK).alias("blocks")))
    if many is None or many.isEmpty():
        filed = filed.withColumn("block", F.lit(0).cast("long"))
    else:
        own = F.pmod(F.xxhash64("fp"), F.col("blocks"))
        filed = filed.join(many, "bucket", "left").withColumn("own", F.coalesce(own, F.lit(0)))
        filed = filed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("blocks") - 1, F.lit(0)))))
        filed = filed.withColumn("block", F.least("own", "other") * F.lit(1 << 20) + F.greatest("own", "other"))
    out = arrow_schema("a long, b long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def compare(parts_: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(parts_)
            got = [t.column(c).to_numpy() for c in ("bucket", "block", "filed", "node")]
            a, b = bucket_links(got[0], got[1], got[2].astype(bool), got[3], _raw(t.column("fp").combine_chunks(), sent), limit, small)
            return batch(out, a, b)

        waiting = 0
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column("bucket").to_numpy(), b.column("block").to_numpy()])
            last = int(np.flatnonzero((keys != keys[:, -1:]).any(axis=0))[-1]) + 1 if (keys != keys[:, -1:]).any() else 0
            if held and (last or tuple(keys[:, 0]) != (held[-1].column("bucket")[-1].as_py(), held[-1].column("block")[-1].as_py())) and waiting > 100_000:
                yield compare([*held, b.slice(0, last)] if last else held)
                held, waiting = ([b.slice(last)], b.num_rows - last) if last else ([b], b.num_rows)
            else:
                held.append(b)
                waiting += b.num_rows
        if held:
            yield compare(held)

    dealt = filed.select("bucket", "block", "filed", "node", "fp").repartition(shuffle_partitions(spark), "bucket", "block").sortWithinPartitions("bucket", "block")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle: int, words: int, limit: int) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id of the group); one row per row of ``docs``."""
    prints = checkpointed(fingerprint(docs, shingle, words))
    distinct = checkpointed(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")))
    groups = components(links(distinct, limit, words))
    named = distinct.join(groups, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    out = prints.join(named, "fp", "left")
    return out.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    from coordshift.llm.common import table

    found = near_duplicates(table(spark, sf_dir, "documents"), shingle=4, words=1, limit=4)
    return found.select("doc_id", F.lower(F.hex(F.concat(*(F.substring("fp", i, 1) for i in range(8, 0, -1))))).alias("fingerprint"), "component_id")
