"""Chain blocks to the sorted interval table, with the columns that lifting needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lines, ranks and bases of one bucket: running sums and neighbours are found in buckets first and then over them, so no task sees a whole chain or contig.
LINES, BASES = 1 << 16, 1 << 20
#: Order of the intervals of a contig; rows that are equal in all of these are alike.
ORDER = ("source_start", "source_end", "target", "off", "strand")


def sums_before(rows: DataFrame, keys: list[str], order: str, width: int = LINES, **sums: Column) -> DataFrame:
    """``rows`` with the sums over the rows before, of equal ``keys`` (not null), by ``order``, a long; 0 for the first."""
    cut = rows.withColumns({f"__of_{n}": c for n, c in sums.items()}).withColumn("__bucket", F.floor(F.col(order) / width))
    over = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(*keys, "__bucket").agg(*(F.sum(f"__of_{n}").alias(f"__all_{n}") for n in sums))
    carried = totals.select(*keys, "__bucket", *(F.sum(f"__all_{n}").over(over).alias(f"__before_{n}") for n in sums))
    inside = Window.partitionBy(*keys, "__bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    out = cut.join(carried, [*keys, "__bucket"], "left").withColumns({n: F.coalesce(F.sum(f"__of_{n}").over(inside), zero) + F.coalesce(f"__before_{n}", zero) for n in sums})
    return out.select(*(c for c in rows.columns if c not in sums), *sums)


def chain_to_intervals(blocks: DataFrame, *more: Column) -> DataFrame:
    """Running sums of block lengths and gaps give each block's source interval and offset.

    Needs chain_id, line_no, s_name, s_len, s_start, d_name, d_len, d_start,
    strand, len, ds, dd; the last block of a chain has null gaps. ``more``:
    further columns to keep.
    """
    run = sums_before(blocks, ["chain_id"], "line_no", cs=F.col("len") + F.coalesce("ds", F.lit(0)), cd=F.col("len") + F.coalesce("dd", F.lit(0)))
    start = F.col("s_start") + F.col("cs")
    forward = F.col("d_start") + F.col("cd") - start
    backward = F.col("d_len") - F.col("d_start") - F.col("cd") - F.col("len") - start
    return run.select(
        F.col("s_name").alias("contig"),
        F.col("s_len").cast("long").alias("s_len"),
        F.col("d_name").alias("target"),
        "strand",
        start.cast("long").alias("source_start"),
        (start + F.col("len")).cast("long").alias("source_end"),
        F.when(F.col("strand"), forward).otherwise(backward).cast("long").alias("off"),
        *more,
    )


def build_index(intervals: DataFrame) -> DataFrame:
    """idx (rank by source_start in the contig), the next interval's fields and the runs of equal target."""
    names = ("source_start", "source_end", "strand", "target", "off")
    w = Window.partitionBy("contig", "__bucket").orderBy(*ORDER)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = intervals.withColumn("__bucket", F.floor(F.col("source_start") / BASES)).withColumn("__at", F.row_number().over(w))
    # the first of a bucket is compared with the last one before it below
    own = own.withColumn("__new", F.coalesce(F.lag("target").over(w) != F.col("target"), F.lit(False)).cast("long"))
    own = own.withColumn("__run", F.sum("__new").over(upto)).withColumn("__next", F.lead(F.struct(*names)).over(w))
    first, last = (f(F.struct(*ORDER)) for f in (F.min, F.max))
    heads = own.groupBy("contig", "__bucket").agg(F.count("*").alias("__n"), F.max("__run").alias("__runs"), first.alias("__first"), last["target"].alias("__last"))
    v = Window.partitionBy("contig").orderBy("__bucket")
    before, here = v.rowsBetween(Window.unboundedPreceding, -1), v.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    heads = heads.withColumn("__new", F.coalesce(F.lag("__last").over(v) != F.col("__first")["target"], F.lit(True)).cast("long"))
    ahead = F.lead(F.struct(*(F.col("__first")[c].alias(c) for c in names))).over(v)
    heads = heads.select("contig", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), (F.coalesce(F.sum("__runs").over(before), F.lit(0)) + F.sum("__new").over(here)).alias("__runs"), ahead.alias("__ahead"))
    own = own.join(heads, ["contig", "__bucket"], "left")
    own = own.withColumn("idx", (F.col("__before") + F.col("__at") - 1).cast("long")).withColumn("target_run", F.col("__runs") + F.col("__run")).withColumn("__next", F.coalesce("__next", "__ahead"))
    return own.select(*intervals.columns, "idx", "target_run", *(F.col("__next")[c].alias(f"next_{c}") for c in names))


def overlapping(intervals: DataFrame) -> DataFrame:
    """Neighbours whose source intervals overlap; a sound chain has none."""
    cut = intervals.withColumn("__bucket", F.floor(F.col("source_start") / BASES))
    order = ["source_start", *(c for c in intervals.columns if c != "source_start")]
    following = F.lead("__first").over(Window.partitionBy("contig").orderBy("__bucket"))
    heads = cut.groupBy("contig", "__bucket").agg(F.min("source_start").alias("__first")).select("contig", "__bucket", following.alias("__after"))
    own = cut.join(heads, ["contig", "__bucket"], "left")
    near = F.lead("source_start").over(Window.partitionBy("contig", "__bucket").orderBy(*order))
    return own.withColumn("next_start", F.coalesce(near, "__after")).select(*intervals.columns, "next_start").where("source_end > next_start")


def check_lengths(blocks: DataFrame, contigs: DataFrame) -> DataFrame:
    """Destination contigs whose length differs from the given one; those that aren't listed are fine."""
    return blocks.select("d_name", "d_len").distinct().join(contigs.select(F.col("name").alias("d_name"), "length"), "d_name").where("d_len <> length")


def write_index(index: DataFrame, path: str) -> None:
    index.repartitionByRange("contig", "source_start").sortWithinPartitions("contig", "source_start").write.mode("overwrite").parquet(path)


def read_index(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)
