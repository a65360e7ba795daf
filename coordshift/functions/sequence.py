"""Sequences of contigs: cutting, masking, identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coordshift.operators.overlap import merge


def extract(bed: DataFrame, fasta: DataFrame) -> DataFrame:
    """Rows of both joined on contig, with part: bases start to end (0-based, end excluded)."""
    return bed.join(fasta, "contig").withColumn("part", F.substring(F.col("seq"), F.col("start") + 1, F.col("end") - F.col("start")))


def mask(fasta: DataFrame, bed: DataFrame) -> DataFrame:
    """``fasta`` (contig, seq and others) with N in the regions of ``bed``.

    The sorted regions cut a sequence into pieces that are joined once.
    """
    regions = merge(bed.where("end > start and end > 0")).groupBy("contig").agg(F.array_sort(F.collect_list(F.struct(F.greatest("start", F.lit(0)).alias("start"), "end"))).alias("__regions"))
    size = F.length("seq")
    starts = F.concat(F.array(F.struct(F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"))), F.col("__regions"))
    nexts = F.concat(F.transform("__regions", lambda r: r["start"]), F.array(size.cast("long")))

    def piece(region: Column, stop: Column) -> Column:
        from_, to = F.least(region["end"], size), F.least(stop, size)
        covered = F.greatest(F.least(region["end"], size) - F.least(region["start"], size), F.lit(0))
        return F.concat(F.repeat(F.lit("N"), covered.cast("int")), F.substring(F.col("seq"), (from_ + 1).cast("int"), F.greatest(to - from_, F.lit(0)).cast("int")))

    masked = F.array_join(F.zip_with(starts, nexts, piece), "")
    return fasta.join(regions, "contig", "left").withColumn("seq", F.when(F.col("__regions").isNotNull(), masked).otherwise(F.col("seq"))).drop("__regions")


def identity(a: str, b: str) -> Column:
    """Share of equal letters of two sequences of one length."""
    same = F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x == y).cast("long")), F.lit(0).cast("long"), lambda acc, x: acc + F.coalesce(x, F.lit(0)))
    return F.when(F.length(a) > 0, same / F.length(a)).otherwise(0.0)
