"""Interval algebra: overlap tests, merging, intersection, subtraction, islands."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Widths of bins, as powers of two: an interval is met in bins of the first one it isn't longer than, or of the last.
LEVELS = (6, 9, 12, 15)


def _level(start: Column, end: Column) -> Column:
    return reduce(lambda out, k: F.when(end - start <= 1 << k, k).otherwise(out), LEVELS[-2::-1], F.lit(LEVELS[-1]))


def binned(rows: DataFrame, start: str, end: str, other: DataFrame) -> DataFrame:
    """Each interval once for every bin it touches, of its own level (__own) and of the wider ones (__level) that ``other``, one row with __levels, has."""
    own = rows.where(F.col(end) > F.col(start)).withColumn("__own", _level(F.col(start), F.col(end))).join(F.broadcast(other))
    wider = F.filter("__levels", lambda k: k > F.col("__own"))
    cut = own.withColumn("__level", F.explode(F.concat(F.array("__own"), wider))).drop("__levels")
    return cut.withColumn("__bin", F.explode(F.expr(f"sequence(shiftright(cast(`{start}` as bigint), __level), shiftright(cast(`{end}` - 1 as bigint), __level))")))


def pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Overlapping pairs of ``a`` (contig, start, end and others) and ``b`` (contig, start, end), met once, with o_start and o_end.

    Two intervals meet in bins of the wider one's level, so a bin holds few that don't overlap.
    """
    b = b.select("contig", F.col("start").alias("__s"), F.col("end").alias("__e"))
    levels = [r.where(F.col(z) > F.col(s)).agg(F.collect_set(_level(F.col(s), F.col(z))).alias("__levels")) for r, s, z in ((b, "__s", "__e"), (a, "start", "end"))]
    right = binned(b, "__s", "__e", levels[1]).withColumnRenamed("__own", "__other")
    met = binned(a, "start", "end", levels[0]).join(right, ["contig", "__level", "__bin"]).where("start < __e and __s < end and greatest(__own, __other) = __level")
    met = met.withColumn("o_start", F.greatest("start", "__s")).withColumn("o_end", F.least("end", "__e"))
    # in the bin where the common part begins
    return met.where("shiftright(cast(o_start as bigint), __level) = __bin").drop("__bin", "__level", "__own", "__other")


def widest(rows: DataFrame, width: int = 1 << 15) -> DataFrame:
    """contig, start, end of the intervals that lie in no other one, each once."""
    own = rows.where("end > start").groupBy("contig", F.col("start").cast("long").alias("start")).agg(F.max("end").cast("long").alias("end"))
    own = own.withColumn("__bin", F.floor(F.col("start") / width))
    over = Window.partitionBy("contig").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    carried = own.groupBy("contig", "__bin").agg(F.max("end").alias("__reach")).withColumn("__before", F.max("__reach").over(over)).drop("__reach")
    inside = Window.partitionBy("contig", "__bin").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    known = own.join(carried, ["contig", "__bin"]).withColumn("__reach", F.greatest("__before", F.max("end").over(inside)))
    return known.where("__reach is null or end > __reach").select("contig", "start", "end")


def flag_overlaps(a: DataFrame, b: DataFrame, threshold: float = 0.0, name: str = "hit") -> DataFrame:
    """``a`` (id, contig, start, end and others) with a flag: the largest overlap with one interval of ``b`` meets the threshold.

    0 or less: any overlap; up to 1: share of a's length; above: bases. Empty intervals never do.
    """
    # no interval overlaps more than one that it lies in, and equal rows are met once
    places = pairs(a.select("contig", "start", "end").distinct(), widest(b)).groupBy("contig", "start", "end").agg(F.max(F.col("o_end") - F.col("o_start")).alias("__best"))
    best = a.select("id", "contig", "start", "end").join(places, ["contig", "start", "end"]).groupBy("id").agg(F.max("__best").alias("__best"))
    size = F.col("end") - F.col("start")
    enough: Column = F.lit(True) if threshold <= 0 else F.col("__best") >= (size * F.lit(threshold).cast("float") if threshold <= 1 else F.lit(threshold))
    return a.join(best, "id", "left").withColumn(name, F.coalesce(enough & F.col("__best").isNotNull(), F.lit(False))).drop("__best")


def merge(rows: DataFrame, gap: int = 0, width: int = 1 << 20) -> DataFrame:
    """Disjoint contig, start, end that cover the same bases; touching ones (or up to ``gap`` apart) are joined.

    Intervals are merged inside bins of their start first, so no task sees a
    contig's rows; what is left, the covered parts of each bin, is merged over bins.
    """
    own = rows.select("contig", F.col("start").cast("long"), F.col("end").cast("long"))
    inside = merged(own.withColumn("__bin", F.floor(F.col("start") / width)), ["contig", "__bin"], gap)
    # a bin's last reach and first start decide whether bins join; parts between are final
    ends = Window.partitionBy("contig", "__bin")
    marked = inside.withColumn("__open", (F.col("start") == F.min("start").over(ends)) | (F.col("end") == F.max("end").over(ends)))
    reach = inside.groupBy("contig", "__bin").agg(F.max("end").alias("reach"), F.min("start").alias("first"))
    over = Window.partitionBy("contig").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    carried = reach.withColumn("__before", F.max("reach").over(over)).select("contig", "__bin", "__before")
    known = marked.join(carried, ["contig", "__bin"])
    # parts that an earlier bin reaches over join it as well
    loose = F.col("__open") | (F.col("start") <= F.coalesce(F.col("__before"), F.lit(-1)) + gap)
    known = known.withColumn("__open", loose)
    return known.where("not __open").select("contig", "start", "end").union(merged(known.where("__open").select("contig", "start", "end"), ["contig"], gap))


def merged(rows: DataFrame, keys: list[str], gap: int = 0) -> DataFrame:
    """``merge`` with one task for each value of ``keys``."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = rows.withColumn("__new", F.coalesce(F.col("start") > reach + gap, F.lit(True)).cast("long")).withColumn("__run", F.sum("__new").over(w))
    return runs.groupBy(*keys, "__run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__run")


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Disjoint contig, start, end that cover the bases of either."""
    return merge(a.select("contig", "start", "end").union(b.select("contig", "start", "end")))


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """contig, start, end of each overlap of a row of a with a row of b."""
    return pairs(a.select("contig", "start", "end"), b).select("contig", F.col("o_start").alias("start"), F.col("o_end").alias("end"))


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    """What is left of each row of a (id, contig, start, end) without the bases of b: id, contig, start, end."""
    cut = pairs(a.select("id", "contig", "start", "end"), merge(b)).select("id", "contig", "start", "end", "o_start", "o_end")
    w = Window.partitionBy("id").orderBy("o_start")
    ahead = cut.select("id", "contig", F.coalesce(F.lag("o_end").over(w), F.col("start")).alias("start"), F.col("o_start").alias("end"))
    tail = cut.groupBy("id", "contig", "end").agg(F.max("o_end").alias("start")).select("id", "contig", "start", "end")
    whole = a.select("id", "contig", "start", "end").join(cut.select("id").distinct(), "id", "left_anti")
    return whole.unionByName(ahead).unionByName(tail).where("end > start")


def mappable_islands(rows: DataFrame, k: int) -> DataFrame:
    """Runs of mappable bedgraph rows (contig, start, end, mappable) as contig, start, end.

    A run begins no earlier than k bases after the last unmappable run began,
    and ends where the next unmappable row begins; a contig whose first row is
    unmappable is mappable before it. A run at the end of a contig is kept for
    the last contig (by name) only, and ends k bases after its last row's start.
    """
    w = Window.partitionBy("contig").orderBy("start")
    runs = rows.withColumn("__new", F.coalesce(F.lag("mappable").over(w) != F.col("mappable"), F.lit(True)).cast("long")).withColumn("__run", F.sum("__new").over(w))
    runs = runs.groupBy("contig", "__run", "mappable").agg(F.min("start").alias("start"), F.max("start").alias("last"))
    v = Window.partitionBy("contig").orderBy("__run")
    runs = runs.withColumn("before", F.lag("start").over(v)).withColumn("after", F.lead("start").over(v))
    final = F.broadcast(rows.agg(F.max("contig").alias("__final")))
    runs = runs.join(final, F.col("after").isNull() & (F.col("contig") == F.col("__final")), "left")
    tail = F.when(F.col("__final").isNotNull(), F.col("last") + k)
    begin = F.greatest(F.col("start"), F.coalesce(F.col("before") + k, F.lit(0)))
    own = runs.where("mappable").select("contig", begin.alias("start"), F.coalesce("after", tail).alias("end"))
    ahead = runs.where("not mappable and before is null").select("contig", F.lit(0).cast("long").alias("start"), F.col("start").alias("end"))
    return own.union(ahead).where("end > start")
