"""Quartile bucket digests of documents, compared by a bounded difference score.

Byte triplets within a window of five (bytes 1-2-3, 1-2-4 and 1-3-5) are
hashed to 128 buckets. Each bucket's count is coded by the quartile of the
counts it falls into; ahead of these 128 two-bit codes stand a checksum byte,
a logarithmic length byte and two four-bit ratios of the quartiles.

Defined cases: null and empty texts count as the empty string; equal texts
have equal digests; texts under five bytes have no triplets, so they differ in
checksum and length only; equal doc_ids are ordered by text; rows with a null
doc_id come last in the order; extra columns are ignored; a table of one row
is its own next document; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coordshift.llm.common import arrow_schema, batch, document_text, shuffle_partitions, slices, table

BUCKETS = 128
#: Odd multipliers for the three bytes and the final scramble.
_A, _B, _C, _M = (np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F))
#: Largest difference score: 6 for each bucket, 12 for each ratio and the length, 1 for the checksum.
MOST = BUCKETS * 6 + 3 * 12 + 1


def triplet_counts(data: list[bytes]) -> np.ndarray:
    """Counts of the 128 buckets for each byte string."""
    sizes = np.fromiter(map(len, data), np.int64, len(data))
    out = np.zeros((len(data), BUCKETS), dtype=np.int64)
    start = 0
    while start < len(data):
        stop = max(start + 1, int(np.searchsorted(np.cumsum(sizes[start:]), 2 << 20, side="right")) + start)
        own = sizes[start:stop]
        x = np.frombuffer(b"".join(data[start:stop]), dtype=np.uint8).astype(np.uint32)
        if len(x) >= 5:
            row = np.repeat(np.arange(stop - start, dtype=np.int64) * BUCKETS, own)
            inside = np.ones(len(x) - 4, dtype=bool)
            for end in np.cumsum(own)[:-1]:
                inside[max(0, end - 4) : end] = False
            a, b, c = x * _A, x * _B, x * _C
            n = len(x) - 4
            rows = row[:n][inside]
            for second, third in ((1, 2), (1, 3), (2, 4)):
                h = ((a[:n] + b[second : second + n] + c[third : third + n]) ^ np.uint32(third * 0x51ED27)) * _M
                h = ((h ^ (h >> np.uint32(15))) * _A) >> np.uint32(25)
                out[start:stop] += np.bincount(rows + h[inside], minlength=(stop - start) * BUCKETS).reshape(-1, BUCKETS)
        start = stop
    return out


def digests(data: list[bytes]) -> np.ndarray:
    """One row of 35 bytes per byte string: checksum, length, ratios, quartile codes."""
    counts = triplet_counts(data)
    ranked = np.sort(counts, axis=1)
    q1, q2, q3 = (ranked[:, i * BUCKETS // 4 - 1] for i in (1, 2, 3))
    codes = (counts > q1[:, None]).astype(np.uint8) + (counts > q2[:, None]) + (counts > q3[:, None])
    top = np.maximum(q3, 1)
    out = np.zeros((len(data), 3 + BUCKETS // 4), dtype=np.uint8)
    out[:, 0] = [zlib.crc32(d) & 255 for d in data]
    out[:, 1] = [min(255, int(np.log1p(len(d)) * 8)) for d in data]
    out[:, 2] = (q1 * 15 // top) << 4 | (q2 * 15 // top)
    four = codes.reshape(len(data), -1, 4)
    out[:, 3:] = four[:, :, 0] | four[:, :, 1] << 2 | four[:, :, 2] << 4 | four[:, :, 3] << 6
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 minus the difference score over its bound, row by row.

    A bucket's codes differ by 0 to 3, scored 0, 1, 2 and 6; ratios and the
    length score up to 12 each and the checksum 1.
    """
    score = (a[:, 0] != b[:, 0]).astype(np.int64)
    score += np.minimum(12, np.abs(a[:, 1].astype(int) - b[:, 1]))
    for shift in (0, 4):
        score += np.minimum(12, np.abs((a[:, 2] >> shift & 15).astype(int) - (b[:, 2] >> shift & 15)))
    weight = np.array([0, 1, 2, 6])
    for shift in (0, 2, 4, 6):
        score += weight[np.abs((a[:, 3:] >> shift & 3).astype(int) - (b[:, 3:] >> shift & 3))].sum(axis=1)
    return 1 - score / MOST


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, digest (70 hex digits)."""
    schema = arrow_schema("doc_id long, digest string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            got = digests([t.encode("utf-8", "replace") for t in b.column("text").to_pylist()])
            yield batch(schema, b.column("doc_id"), [x.tobytes().hex() for x in got])

    return document_text(docs).mapInArrow(run, "doc_id long, digest string")


def with_next(docs: DataFrame) -> DataFrame:
    """Rows dealt to ranges of doc_id, sorted there; each range ends with a copy of the first row of the next one.

    Columns: range, extra (that copy), doc_id, text. Cut points come from
    quantiles of doc_id; first rows of ranges (as many as partitions) are
    found by an aggregation.
    """
    n = shuffle_partitions(docs.sparkSession)
    rows = document_text(docs)
    cuts = rows.select("doc_id").approxQuantile("doc_id", [i / n for i in range(1, n)], 0.5 / n)
    cuts = sorted({int(c) for c in cuts})
    where = F.lit(len(cuts))
    if cuts:
        where = F.expr(f"coalesce(size(filter(array({','.join(f'{c}L' for c in cuts)}), c -> c < doc_id)), {len(cuts)})") if len(cuts) < 64 else None
    if where is None:
        # many ranges: two steps, so that a row is compared with few cut points
        step = 32
        coarse = cuts[step - 1 :: step]
        groups = [cuts[i : i + step] for i in range(0, len(cuts), step)]
        table_ = "array(" + ",".join("array(" + ",".join(f"{c}L" for c in g) + ")" for g in groups) + ")"
        first = f"size(filter(array({','.join(f'{c}L' for c in coarse)}), c -> c < doc_id))"
        where = F.expr(f"coalesce({first} * {step} + coalesce(size(filter(get({table_}, {first}), c -> c < doc_id)), 0), {len(cuts)})")
    rows = rows.select(F.when(F.col("doc_id").isNull(), len(cuts)).otherwise(where).cast("int").alias("range"), "doc_id", "text")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"))
    firsts = sorted((r["range"], tuple(r["first"])) for r in rows.groupBy("range").agg(F.min(order).alias("first")).collect())
    if not firsts:
        return rows.select("range", F.lit(False).alias("extra"), "doc_id", "text")
    before = {first: firsts[i - 1][0] for i, (_, first) in enumerate(firsts)}
    match = F.lit(None).cast("int")
    for (null, doc_id, text_hash), r in before.items():
        own = F.col("doc_id").isNull() if null else F.col("doc_id") == F.lit(doc_id)
        match = F.when(own & (F.xxhash64("text") == F.lit(text_hash)), F.lit(r)).otherwise(match) if len(before) <= 8 else match
    if len(before) > 8:
        spark = docs.sparkSession
        known = spark.createDataFrame([(doc_id, h, r) for (_, doc_id, h), r in before.items()], "first_id long, first_hash long, before int")
        keyed = rows.withColumn("h", F.xxhash64("text"))
        rows = keyed.join(F.broadcast(known), F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("h") == F.col("first_hash")), "left").select("range", "doc_id", "text", "before")
    else:
        rows = rows.withColumn("before", match)
    # repeated first rows: only one copy is sent on; the reader of a range uses the first it meets
    copies = F.expr("inline(if(before is null, array(struct(range as r, false as extra)), array(struct(range as r, false as extra), struct(before as r, true as extra))))")
    out = rows.select("doc_id", "text", copies).withColumnRenamed("r", "range").withColumn("tie", F.xxhash64("text"))
    return out.repartition(n, "range").sortWithinPartitions("range", "extra", F.col("doc_id").asc_nulls_last(), "tie").select("range", "extra", "doc_id", "text")


def edited(docs: DataFrame) -> DataFrame:
    """Each text's digest, that of the text with its second half replaced by the next document's start, and their likeness."""
    names = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    schema = arrow_schema(names)

    def pair_up(rows: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, str, str]]]:
        """Lists of (doc_id, text, next text)."""
        held, done, out, size = None, True, [], 0
        for b in slices(rows):
            for r, extra, doc_id, text in zip(*(b.column(c).to_pylist() for c in ("range", "extra", "doc_id", "text")), strict=True):
                if held is not None and r == held[0] and not done:
                    out.append((held[1], held[2], text))
                    size += len(text) + len(held[2])
                    done = extra
                if not extra:
                    held, done = (r, doc_id, text), False
                if size > 4 << 20:
                    yield out
                    out, size = [], 0
        if out:
            yield out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in pair_up(batches):
            texts = [r[1] for r in rows]
            changed = [(t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode("utf-8", "replace") for _, t, n in rows]
            own = digests([t.encode("utf-8", "replace") for t in texts])
            new = digests(changed)
            # the next text is mostly the next row's own
            after = np.concatenate([own[1:], own[:1]])
            odd = [i for i, r in enumerate(rows) if i + 1 == len(rows) or r[2] is not rows[i + 1][1]]
            if odd:
                after[odd] = digests([rows[i][2].encode("utf-8", "replace") for i in odd])
            yield batch(schema, [r[0] for r in rows], [len(t) for t in texts], [hashlib.sha256(c).hexdigest() for c in changed], [x.tobytes().hex() for x in own], [x.tobytes().hex() for x in new], likeness(own, new), likeness(own, after))

    return with_next(docs).mapInArrow(run, names)


def op7_digest(spark, sf_dir: str) -> DataFrame:
    return edited(table(spark, sf_dir, "documents"))
