"""The as-of join of points and the interval table.

An index of up to ``SEARCHED`` intervals is sent to the executors as sorted
arrays; points are then looked up by binary search in Arrow batches, in place:
only their contig and place go to Python, and nothing is shuffled. A larger
index is written to the shared folder once and met by sorting: each distinct place and the ends of intervals go to
(contig, place div width) buckets, so neither a contig nor a deeply covered
place is one task, and each bucket starts with the last start and the last end
before it. The places found are then joined back to the points.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coordshift.operators.index import sums_before

WIDTH = 1 << 14
#: Intervals that are sent to every executor at most, of some 150 bytes each.
SEARCHED = 1_000_000
#: Intervals of a larger index that one task of a lookup sorts.
TOGETHER = 100_000
FIELDS = ("idx", "source_start", "source_end", "target", "off", "strand", "next_source_start", "next_source_end", "next_strand", "next_target", "next_off", "target_run", "bad", "next_bad")
_KINDS = {"target": "string", "next_target": "string", "strand": "boolean", "next_strand": "boolean"}
#: What of the interval before a place is used.
LAST = ("idx", "target_run")
_STRUCT = "struct<" + ",".join(f"{c}:{_KINDS.get(c, 'bigint')}" for c in FIELDS) + ">"
LAST_STRUCT = "struct<" + ",".join(f"{c}:bigint" for c in LAST) + ">"


def interval() -> Column:
    return F.struct(*(F.col(c).cast(_KINDS.get(c, "bigint")).alias(c) for c in FIELDS))


def with_steps(index: DataFrame, allowed: int | None = None) -> DataFrame:
    """``index`` with bad and next_bad: steps up to an interval, and to the next one, that change strand or target or shift by more than ``allowed`` (None: not counted)."""
    if "bad" in index.columns and allowed is None:
        return index
    if allowed is None:
        return index.withColumn("bad", F.lit(0)).withColumn("next_bad", F.lit(0))
    fine = (F.col("strand") == F.col("next_strand")) & (F.col("target") == F.col("next_target")) & (F.abs(F.col("next_off") - F.col("off")) <= allowed)
    step = (~F.coalesce(fine, F.lit(True))).cast("long")
    counted = sums_before(index.drop("bad", "next_bad").withColumn("__step", step), ["contig"], "idx", bad=F.col("__step"))
    return counted.withColumn("next_bad", F.col("bad") + F.col("__step")).drop("__step")


class Search:
    """The index as sorted arrays, made once for several joins.

    By contig: length, first row, starts, sorted ends, the interval of each
    end, ends of intervals, shifts to the next one, and whether it has the same
    target. Plain tuples, so executors need nothing else to read them.
    """

    def __init__(self, spark, table: pa.Table):
        coded = table.column("contig").combine_chunks().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        order = np.lexsort((table.column("idx").to_numpy(), codes))
        table, codes, listed = table.take(pa.array(order)), codes[order], coded.dictionary.to_pylist()
        rows = pa.StructArray.from_arrays([table.column(c).combine_chunks() for c in FIELDS], names=list(FIELDS))
        heads = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.zeros(0, dtype=int)
        contigs = {}
        for a, z in zip(heads.tolist(), np.append(heads, len(codes))[1:].tolist(), strict=True):
            part = table.slice(a, z - a)
            ends = part.column("source_end").to_numpy()
            by_end = np.argsort(ends, kind="stable")
            own = {c: part.column(c).to_numpy(zero_copy_only=False) for c in ("source_start", "off", "strand", "target")}
            next_ = {c: np.append(v[1:], v[:1]) for c, v in own.items()} | {"source_end": np.append(ends[1:], ends[:1])}
            forward = own["strand"].astype(bool)
            shifts = np.where(forward, next_["off"] - own["off"], own["off"] + own["source_start"] + ends - next_["off"] - next_["source_start"] - next_["source_end"])
            kept = (own["target"] == next_["target"]) & (np.arange(z - a) < z - a - 1)
            contigs[listed[codes[a]]] = (int(part.column("s_len").to_numpy().max()), a, np.maximum(own["source_start"], 1), ends[by_end], by_end, ends, shifts, kept)
        last = pa.StructArray.from_arrays([table.column(c).combine_chunks() for c in LAST], names=list(LAST))
        self.shared = spark.sparkContext.broadcast((contigs, rows, last))

    def __call__(self, contig: Column, pos: Column) -> Column:
        shared = self.shared

        @F.arrow_udf(f"struct<sidx:bigint,eidx:bigint,s:{_STRUCT},e:struct<idx:bigint,target_run:bigint>>")
        def find(names: pa.Array, places: pa.Array) -> pa.Array:
            contigs, rows, last = shared.value
            n = len(names)
            at = places.fill_null(-1).to_numpy(zero_copy_only=False)
            sidx, eidx = np.full(n, -1, dtype=np.int64), np.full(n, -1, dtype=np.int64)
            base, known = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
            coded = names.dictionary_encode()
            which = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            for i, name in enumerate(coded.dictionary.to_pylist()):
                if name not in contigs:
                    continue
                length, first, starts, ends, upto, *_ = contigs[name]
                rows_ = np.flatnonzero((which == i) & (at >= 0) & (at < length))
                p = at[rows_]
                sidx[rows_] = np.searchsorted(starts, p, side="right") - 1
                passed = np.searchsorted(ends, p, side="left")
                eidx[rows_] = np.where(passed > 0, upto[np.maximum(passed - 1, 0)], 0)
                base[rows_], known[rows_] = first, True
            s = rows.take(pa.array(base + sidx, mask=sidx < 0))
            e = last.take(pa.array(base + eidx, mask=~known))
            return pa.StructArray.from_arrays([pa.array(sidx), pa.array(eidx), s, e], names=["sidx", "eidx", "s", "e"])

        return find(contig, pos.cast("long"))


    def crossings(self, contig: Column, first: Column, last: Column, pos: Column) -> Column:
        """array of (bp, diff): the ends of the intervals ``first`` to ``last`` behind a place, and the shift there."""
        shared = self.shared

        @F.arrow_udf("array<struct<bp:bigint,diff:bigint>>")
        def find(names: pa.Array, firsts: pa.Array, lasts: pa.Array, places: pa.Array) -> pa.Array:
            contigs, *_ = shared.value
            out: list[list[dict] | None] = []
            for name, i, j, p in zip(*(x.to_pylist() for x in (names, firsts, lasts, places)), strict=True):
                own = contigs.get(name) if None not in (i, j, p) else None
                if own is None:
                    out.append(None)
                    continue
                *_, ends, shifts, kept = own
                at = np.arange(max(i, 0), min(j + 1, len(kept)))
                at = at[kept[at] & (ends[at] > p)]
                out.append([{"bp": b, "diff": d} for b, d in zip((ends[at] - p).tolist(), shifts[at].tolist(), strict=True)])
            return pa.array(out, pa.list_(pa.struct([("bp", pa.int64()), ("diff", pa.int64())])))

        return find(contig, first, last, pos)


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder: ``spark.checkpoint.dir``, or one made here where all runs in one process."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(where or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


class Written:
    """An index in the shared folder, as each lookup reads it several times."""

    def __init__(self, index: DataFrame):
        path = f"{shared_folder(index.sparkSession)}/index-{uuid.uuid4().hex}"
        index.write.parquet(path)
        self.rows = index.sparkSession.read.parquet(path)
        #: tasks of a lookup: each sorts some TOGETHER intervals, however many there are
        self.parts = max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-self.rows.count() // TOGETHER))


def prepared(index: DataFrame | Search | Written, most: int = SEARCHED) -> Search | Written:
    """``index`` as sorted arrays if it has at most ``most`` intervals, else as files in the shared folder."""
    if isinstance(index, Search | Written):
        return index
    index = with_steps(index).select("contig", F.col("s_len").cast("long").alias("s_len"), interval().alias("x")).select("contig", "s_len", "x.*")
    if index.select("contig").limit(most + 1).count() > most:
        return Written(index)
    return Search(index.sparkSession, index.toArrow())


class Placed:
    """What a larger index has at the places of ``columns`` (contig and place each) of ``rows``, found once for all lookups that follow."""

    def __init__(self, rows: DataFrame, index: Written, *columns: tuple[Column, Column]):
        places = reduce(DataFrame.union, [rows.select(c.alias("contig"), p.cast("long").alias("at")) for c, p in columns])
        self.found, self.parts = located(places, index.rows, parts=index.parts), index.parts


def placed(rows: DataFrame, index: Search | Written, *columns: tuple[Column, Column]) -> Search | Placed:
    return Placed(rows, index, *columns) if isinstance(index, Written) else index


def slots(points: DataFrame, index: DataFrame | Search | Written | Placed, contig: str = "contig", pos: str = "pos", width: int = WIDTH) -> DataFrame:
    """``points`` with sidx, eidx (-1: none) and s, e: the intervals they name.

    sidx is the last interval with max(start, 1) <= pos, eidx the one with the
    last end < pos (0 if there is none), of equal ends the last interval; both are -1 for a negative place, one at or
    beyond the contig's length, a null one, or an unknown contig.
    """
    if isinstance(index, Placed):
        return _at(points, index.found, contig, pos, index.parts)
    index = prepared(index)
    if isinstance(index, Search):
        found = points.withColumn("__found", index(F.col(contig), F.col(pos)))
        return found.select(*points.columns, "__found.*")
    return sorted_slots(points, index.rows, contig, pos, width, index.parts)


def sorted_slots(points: DataFrame, index: DataFrame, contig: str = "contig", pos: str = "pos", width: int = WIDTH, parts: int | None = None) -> DataFrame:
    """``slots`` for an index of any size; ``parts``: tasks that share it (None: the shuffle partitions)."""
    places = points.select(F.col(contig).alias("contig"), F.col(pos).cast("long").alias("at"))
    return _at(points, located(places, index, width, parts), contig, pos, parts)


def _dealt(rows: DataFrame, parts: int | None, *keys: Column) -> DataFrame:
    return rows.repartition(parts, *keys) if parts else rows


def located(places: DataFrame, index: DataFrame, width: int = WIDTH, parts: int | None = None) -> DataFrame:
    """__contig, __spot, __s, __e, __passed: the intervals at each of ``places`` (contig, at) that isn't outside."""
    index = with_steps(index)
    lengths = index.groupBy(F.col("contig").alias("__contig")).agg(F.max("s_len").alias("__len"), F.min(F.struct(*LAST)).alias("__first"))
    at = F.col("at")
    # places outside name no interval, and are left out
    places = places.distinct().join(lengths, F.col("contig") == F.col("__contig")).where((at >= 0) & (at < F.col("__len")))
    places = places.select("contig", "at", F.lit(1).alias("kind"), F.col("__first").alias("first"), F.floor(at / width).cast("long").alias("bucket"))
    ends = F.array(F.struct(F.greatest("source_start", F.lit(1)).alias("at"), F.lit(0).alias("kind"), interval().alias("s"), F.lit(None).cast(LAST_STRUCT).alias("e")), F.struct(F.col("source_end").alias("at"), F.lit(2).alias("kind"), F.lit(None).cast(_STRUCT).alias("s"), F.struct(*(F.col(c).cast("bigint").alias(c) for c in LAST)).alias("e")))
    keys = index.select("contig", F.explode(ends).alias("k")).select("contig", "k.*").withColumn("bucket", F.floor(F.col("at") / width).cast("long"))
    # only buckets with places are met; each is opened by the last start and the last end before it, whatever bucket has them
    needed = places.select("contig", "bucket").distinct()
    tops = keys.groupBy("contig", "bucket", "kind").agg(F.max("at").alias("top"))
    asked = needed.select("contig", "bucket", F.explode(F.array(F.lit(0), F.lit(2))).alias("kind"), F.lit(None).cast("long").alias("top"), F.lit(True).alias("__asked"))
    before = Window.partitionBy("contig", "kind").orderBy("bucket").rangeBetween(Window.unboundedPreceding, -1)
    opening = tops.withColumn("__asked", F.lit(False)).union(asked).withColumn("__top", F.max("top").over(before)).where("__asked and __top is not null")
    opening = opening.select("contig", "kind", F.col("__top").alias("at"), F.col("bucket").alias("__b"))
    seeds = keys.drop("bucket").join(opening, ["contig", "kind", "at"]).select("contig", F.col("__b").alias("bucket"), F.lit(-1).cast("long").alias("at"), "kind", "s", "e")
    rows = keys.join(needed, ["contig", "bucket"], "left_semi").select("contig", "bucket", "at", "kind", "s", "e").union(seeds)
    both = _dealt(rows.unionByName(places, allowMissingColumns=True), parts, F.col("contig"), F.col("bucket"))
    # starts come before a point at the same place, ends after it
    w = Window.partitionBy("contig", "bucket").orderBy("at", "kind", F.col("s")["idx"], F.col("e")["idx"]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("s", F.last("s", ignorenulls=True).over(w)).withColumn("e", F.last("e", ignorenulls=True).over(w)).where("kind = 1")
    found = found.select(F.col("contig").alias("__contig"), F.col("at").alias("__spot"), F.col("s").alias("__s"), F.coalesce("e", "first").alias("__e"), F.col("e").isNotNull().alias("__passed"))
    return _dealt(found, parts, F.col("__contig"), F.col("__spot"))


def _at(points: DataFrame, found: DataFrame, contig: str, pos: str, parts: int | None) -> DataFrame:
    """``slots`` from what was ``located``."""
    points = _dealt(points, parts, F.col(contig), F.col(pos).cast("long"))
    joined = points.join(found, (points[contig] == F.col("__contig")) & (points[pos].cast("long") == F.col("__spot")), "left")
    none = F.lit(-1).cast("long")
    eidx = F.when(F.col("__spot").isNull(), none).when(F.col("__passed"), F.col("__e")["idx"]).otherwise(F.lit(0).cast("long"))
    return joined.select(*(points[c] for c in points.columns), F.coalesce(F.col("__s")["idx"], none).alias("sidx"), eidx.alias("eidx"), F.col("__s").alias("s"), F.col("__e").alias("e"))
