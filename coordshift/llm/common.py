"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
from collections.abc import Callable, Iterator
from typing import Any
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MIX = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of input for one shard: what one grouped task holds grows with this, not with the table.
SHARD_BYTES = 256 << 20


def shards_of(docs: DataFrame, column: str = "text", most: int = SHARD_BYTES) -> int:
    """Shards for the texts of ``docs``: no fewer than the shuffle partitions, and as many as their bytes ask for, ``most`` to a shard.

    The optimizer's size is an upper bound here; texts are measured only where
    it is large or unknown.
    """
    least = shuffle_partitions(docs.sparkSession)
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > least * most:
        size = docs.agg(F.coalesce(F.sum(F.octet_length(docs[column].cast("string"))), F.lit(0))).first()[0]
    return max(least, -(-size // most))


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder: ``spark.checkpoint.dir``, or one made here where none is set and all runs in one process."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(where or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, with its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a Parquet table to the shared checkpoint folder and read again."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def document_text(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id (long) and text (null: empty), with no other columns but ``more``."""
    return docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"),
        *more,
    )


def arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(","))])


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def give_back() -> None:
    """Return freed memory to the system: executors run workers of many stages side by side."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU C library
        pass


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Each batch in pieces of about ``most`` bytes of ``column``, one row at least; what a batch's work freed is given back."""
    for b in batches:
        if not b.num_rows:
            continue
        sizes = b.column(column).cast(pa.large_binary())
        ends = np.cumsum(np.nan_to_num(pa.compute.binary_length(sizes).to_numpy(zero_copy_only=False)))
        start = 0
        while start < b.num_rows:
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + most, side="right")))
            yield b.slice(start, stop - start)
            start = stop
        give_back()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


_HELD: dict[str, Any] = {}


def held(mark: str, build: Callable[[], Any]) -> Any:
    """The model named ``mark``, one a worker process: building it drops the one before and gives back what that left unused."""
    if mark not in _HELD:
        _HELD.clear()
        gc.collect()
        give_back()
        _HELD[mark] = build()
    return _HELD[mark]


class LookupTable:
    """Open addressing from 64-bit keys to float32 values, probed a vector at a time."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        keys = np.asarray(keys, dtype=np.uint64)
        self.bits = max(4, int(len(keys) * 3).bit_length())
        self.keys = np.zeros(1 << self.bits, dtype=np.uint64)
        self.used = np.zeros(1 << self.bits, dtype=bool)
        self.values = np.full(1 << self.bits, np.nan, dtype=np.float32)
        todo, at = np.arange(len(keys)), self._home(keys)
        while len(todo):
            free = todo[~self.used[at[todo]]]
            slot, first = np.unique(at[free], return_index=True)
            placed = free[first]
            self.keys[slot], self.values[slot], self.used[slot] = keys[placed], values[placed], True
            done = np.zeros(len(keys), dtype=bool)
            done[placed] = True
            todo = todo[~done[todo]]
            at[todo] = (at[todo] + self.used[at[todo]]) & ((1 << self.bits) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values, NaN for keys that aren't there."""
        at = self._home(keys)
        out = self.values[at]
        miss = np.flatnonzero((self.keys[at] != keys) & self.used[at])
        out[(self.keys[at] != keys)] = np.nan
        while len(miss):
            at[miss] = (at[miss] + 1) & ((1 << self.bits) - 1)
            here = at[miss]
            hit = (self.keys[here] == keys[miss]) & self.used[here]
            out[miss[hit]] = self.values[here[hit]]
            miss = miss[~hit & self.used[here]]
        return out


#: Keys that are sent to every executor at most.
HOT = 10_000


def joined_by(left: DataFrame, right: DataFrame, keys: list[str], total: int) -> DataFrame:
    """Inner join with ``right``, one row a key, whose column n counts the key's rows in ``left`` (``total`` in all); n is dropped.

    Keys with more than one part in ``HOT`` of the rows, ``HOT`` at most, are
    sent out; so no key of the shuffled rest is a large part of a task.
    """
    hot = F.broadcast(right.where(F.col("n") * HOT > total).drop("n"))
    cold = right.where(F.col("n") * HOT <= total).drop("n")
    rest = left.join(hot.select(*keys), keys, "left_anti")
    return left.join(hot, keys).unionByName(rest.join(cold, keys))


def components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) for undirected ``edges`` a, b (long).

    Alternates large-star and small-star steps until the edges are stars.
    A step is an aggregation (combined before the shuffle) and a join (which
    adaptive execution splits where a node is hot); each round is written as a
    table, so that the optimizer's size estimates don't grow from round to
    round. Nodes without edges aren't returned.
    """
    edges = written(edges.where("a <> b").selectExpr("least(a, b) as a", "greatest(a, b) as b").distinct(), "edges")
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b")
        large = large.distinct()
        # small star: each node's lower neighbours meet at the lowest of them
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b")
        small = small.select(F.col("m").alias("a"), "b").union(small.where("a <> m").select("m", F.col("a").alias("b")))
        new = written(small.distinct(), "edges")
        # done when no node has two lower neighbours, or lower and higher ones
        roles = new.selectExpr("stack(2, a, 0, b, 1) as (node, low)")
        if roles.groupBy("node").agg(F.sum("low").alias("n"), F.min("low").alias("root")).where("n > 1 or (n = 1 and root = 0)").isEmpty():
            return new.select(F.col("b").alias("node"), F.col("a").alias("component")).union(new.select("a", "a").distinct())
        edges = new
