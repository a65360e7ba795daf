"""Removal of repeated runs of lines.

A document is a sequence of lines, named by 128-bit hashes of the lines
without spaces at their ends. Prefix doubling names longer sequences: names of
h lines, of the line and of the one h lines on, make names of 2h, and two
names of 2^k lines that overlap name any length between 2^k and 2^(k+1). Names
stand for content, so equal ones are the ranks of equal prefixes and no round
of the doubling needs an exchange; the suffixes that share a name form the
common-prefix interval at that depth, and a shuffle by name collects it.

A run goes if it starts earlier as well (smaller doc_id, or earlier in the same
document) and has at least ``least`` characters. From each line the shortest
sequence on and the shortest one back with that many characters are named: the
sequences from one line that are equal up to this depth are one interval, all
but the first of an interval are later copies, and these copies together cover
just the lines of all maximal repeated runs of ``least`` characters. (A line
of such a run lies in the shortest sequence from the run's first line, or the
shortest one that ends with the line itself lies in the run.) So one long line
goes as a run of many short ones does.

Intervals are counted before their shuffle, and only names that occur again
are joined back; the few common names are sent out instead, so no name is one
task.

Defined cases: null text stays null and takes no part, empty text stays empty;
a text loses its repeated lines and their line breaks, all lines if all are
repeated; documents without a doc_id come last in the order; rows equal in
doc_id and text count as one document; extra columns are carried along, but
one with the name of a result is replaced by it; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from coordshift.llm.common import arrow_schema, batch, checkpointed, joined_by, mixed, slices, table

LEAST = 40
RESULTS = ("n_lines", "n_removed", "n_runs")
_NULL = (1 << 63) - 1
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def sequences(sizes: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, stop) of the shortest runs of lines with ``least`` characters, on from and back to each line, inside documents that stop at ``ends``."""
    n = len(sizes)
    upto = np.cumsum(sizes)
    before = upto - sizes
    owner = np.searchsorted(ends, np.arange(n), side="right")
    floor, top = np.append(0, ends)[owner], ends[owner]
    on = np.searchsorted(upto, before + least) + 1
    start, fine = np.arange(n), on <= top
    pairs = [(start[fine], on[fine])]
    back = np.searchsorted(before, upto - least, side="right") - 1
    fine = back >= floor
    pairs.append((back[fine], start[fine] + 1))
    both = np.unique(np.concatenate([a * (n + 1) + z for a, z in pairs]))
    return both // (n + 1), both % (n + 1)


def names_of(lines: list[bytes], start: np.ndarray, stop: np.ndarray) -> list[np.ndarray]:
    """Two words that name each sequence of lines, by prefix doubling."""
    raw = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x) for x in lines), dtype="<u8").reshape(-1, 2)
    size = stop - start
    level = np.frexp(size)[1] - 1
    out = [np.zeros(len(start), dtype=np.uint64) for _ in _ODD]
    names = [np.ascontiguousarray(raw[:, i]) for i in range(2)]
    for k in range(int(level.max(initial=-1)) + 1):
        at = np.flatnonzero(level == k)
        for i, odd in enumerate(_ODD):
            a, z = names[i][start[at]], names[i][stop[at] - (1 << k)]
            out[i][at] = mixed(mixed(a * odd + np.uint64(k + 1)) + z * odd + size[at].astype(np.uint64))
        # the names of twice as many lines
        h = 1 << k
        names = [mixed(mixed(x[:-h] * odd + np.uint64(h)) + x[h:]) if len(x) > h else x[:0] for x, odd in zip(names, _ODD, strict=True)]
    return out


def trimmed(text: str) -> list[str]:
    return [x.strip(" ") for x in text.split("\n")]


def repeated_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc, tie, spans: array of (start, stop) of sequences of lines that have an earlier copy."""
    rows = docs.where(docs["text"].isNotNull()).select(F.coalesce(docs["doc_id"].cast("long"), F.lit(_NULL)).alias("doc"), F.xxhash64(docs["text"]).alias("tie"), docs["text"].alias("text"))
    names = "doc long, tie long, start int, stop int, a long, b long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            split = [trimmed(t) for t in part.column("text").to_pylist()]
            lines = [x for own in split for x in own]
            ends = np.cumsum([len(own) for own in split])
            start, stop = sequences(np.fromiter(map(len, lines), np.int64, len(lines)), ends, least)
            a, b = names_of([x.encode("utf-8", "surrogatepass") for x in lines], start, stop)
            owner = np.searchsorted(ends, start, side="right")
            first = np.append(0, ends)[owner]
            yield batch(arrow_schema(names), part.column("doc").take(pa.array(owner)), part.column("tie").take(pa.array(owner)), (start - first).astype(np.int32), (stop - first).astype(np.int32), a.view(np.int64), b.view(np.int64))

    found = checkpointed(rows.mapInArrow(cut, names))
    at = F.struct("doc", "tie", "start")
    total = found.count()
    intervals = checkpointed(found.groupBy("a", "b").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n")).where("first <> last").select("a", "b", "first", "n"))
    met = joined_by(found, intervals, ["a", "b"], total)
    later = met.where(at > F.col("first"))
    return later.groupBy("doc", "tie").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))


def remove_repeats(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``docs`` with repeated lines deleted from text, and n_lines, n_removed, n_runs (maximal deleted runs)."""
    own = [c for c in docs.columns if c.lower() not in RESULTS]
    gone = repeated_runs(docs, least).select(F.col("doc").alias("__doc"), F.col("tie").alias("__tie"), F.transform("spans", lambda x: x["start"]).alias("__start"), F.transform("spans", lambda x: x["stop"]).alias("__stop"))
    keyed = docs.select(*own, F.coalesce(docs["doc_id"].cast("long"), F.lit(_NULL)).alias("__doc"), F.xxhash64(docs["text"]).alias("__tie"))
    joined = keyed.join(gone, ["__doc", "__tie"], "left").drop("__doc", "__tie")
    schema = StructType([f for f in docs.schema.fields if f.name in own])
    for c in RESULTS:
        schema = schema.add(c, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, counts, removed, runs = [], [], [], []
            for text, start, stop in zip(*(b.column(c).to_pylist() for c in ("text", "__start", "__stop")), strict=True):
                lines = [] if text is None else text.split("\n")
                edges = np.zeros(len(lines) + 1, dtype=np.int64)
                if start:
                    np.add.at(edges, start, 1)
                    np.add.at(edges, stop, -1)
                hit = np.cumsum(edges[:-1]) > 0
                if start:
                    text = "\n".join([x for x, out in zip(lines, hit.tolist(), strict=True) if not out])
                texts.append(text)
                counts.append(len(lines))
                removed.append(int(hit.sum()))
                runs.append(int((hit & ~np.append(False, hit[:-1])).sum()) if len(hit) else 0)
            columns = [pa.array(texts, pa.string()) if c == "text" else b.column(c) for c in own]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x, pa.int64()) for x in (counts, removed, runs))], names=[*own, *RESULTS])

    return joined.select(*own, "__start", "__stop").mapInArrow(run, schema)


def op5_lines(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2(F.col("text"), 256).alias("kept_sha256"))
