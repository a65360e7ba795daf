"""Transforms of chains themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coordshift.operators.index import chain_to_intervals
from coordshift.operators.overlap import merged


def invert(blocks: DataFrame) -> DataFrame:
    """Source and destination swapped; chains on the reverse strand are turned round, blocks from the last to the first."""
    w = Window.partitionBy("chain_id").orderBy("line_no")
    whole = Window.partitionBy("chain_id")
    n = blocks.withColumn("__at", F.row_number().over(w)).withColumn("__n", F.count("*").over(whole))
    n = n.withColumn("__ss", F.sum(F.col("len") + F.when(F.col("__at") < F.col("__n"), F.coalesce("ds", F.lit(0))).otherwise(0)).over(whole))
    n = n.withColumn("__sd", F.sum(F.col("len") + F.when(F.col("__at") < F.col("__n"), F.coalesce("dd", F.lit(0))).otherwise(0)).over(whole))
    n = n.withColumn("__pds", F.lag("ds").over(w)).withColumn("__pdd", F.lag("dd").over(w))
    back = ~F.col("strand")
    last = F.col("__at") == F.col("__n")
    return n.select(
        "chain_id",
        F.when(back, F.col("__n") - F.col("__at") + 1).otherwise(F.col("__at")).cast("long").alias("line_no"),
        F.col("d_name").alias("s_name"),
        F.col("d_len").alias("s_len"),
        F.when(back, F.col("d_len") - F.col("d_start") - F.col("__sd")).otherwise(F.col("d_start")).cast("long").alias("s_start"),
        F.col("s_name").alias("d_name"),
        F.col("s_len").alias("d_len"),
        F.when(back, F.col("s_len") - F.col("s_start") - F.col("__ss")).otherwise(F.col("s_start")).cast("long").alias("d_start"),
        "strand",
        F.col("len"),
        F.when(back, F.col("__pdd")).when(~last, F.col("dd")).cast("long").alias("ds"),
        F.when(back, F.col("__pds")).when(~last, F.col("ds")).cast("long").alias("dd"),
    )


def to_bed(blocks: DataFrame, ids: list[str] | None = None) -> DataFrame:
    """chain_id, contig, start, end covered by blocks of the chosen chains (all: None) that keep their contig's name; touching blocks of a chain are joined.

    A chain's last block isn't part of the output.
    """
    chosen = blocks if ids is None else blocks.where(F.col("chain_id").cast("string").isin(*ids))
    chosen = chosen.where("s_name = d_name").withColumn("__last", F.col("line_no") == F.max("line_no").over(Window.partitionBy("chain_id")))
    kept = chain_to_intervals(chosen, F.col("chain_id"), F.col("__last")).where("not __last")
    rows = kept.select("chain_id", "contig", F.col("source_start").alias("start"), F.col("source_end").alias("end"))
    return merged(rows, ["chain_id", "contig"])


def to_vcf(blocks: DataFrame) -> DataFrame:
    """contig, pos (1-based, in the destination), ref, alt, info of the net length of each gap, with A for unknown bases; a chain's offset is a record as well.

    A chain that keeps its contig's name has the difference of its starts as
    that first record, another one the difference of its two lengths.
    """
    w = Window.partitionBy("chain_id").orderBy("line_no")
    n = blocks.withColumn("__at", F.row_number().over(w)).withColumn("__n", F.count("*").over(Window.partitionBy("chain_id")))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("chain_id")
    inner = F.col("__at") < F.col("__n")
    ds, dd = (F.when(inner, F.coalesce(c, F.lit(0))).otherwise(0) for c in ("ds", "dd"))
    n = n.withColumn("__ds", ds).withColumn("__dd", dd)
    n = n.withColumn("__t", F.col("s_start") + 1 + F.col("len") + F.coalesce(F.sum(F.col("len") + F.col("__ds")).over(before), F.lit(0)))
    n = n.withColumn("__q", F.col("d_start") + 1 + F.col("len") + F.coalesce(F.sum(F.col("len") + F.col("__dd")).over(before), F.lit(0)))
    n = n.withColumn("__st", F.sum(F.col("len") + F.col("__ds")).over(whole)).withColumn("__sd", F.sum(F.col("len") + F.col("__dd")).over(whole))
    more = F.col("__ds") - F.col("__dd")
    bases = lambda net, here: F.repeat(F.lit("A"), (F.when(here, F.abs(net)).otherwise(0) + 1).cast("int"))
    tpos = lambda place: F.concat(F.lit("TPOS="), place.cast("string"))
    gaps = n.where(inner & (more != 0)).select("chain_id", F.col("d_name").alias("contig"), F.col("__q").cast("long").alias("pos"), bases(more, more < 0).alias("ref"), bases(more, more > 0).alias("alt"), F.concat(tpos(F.col("__t")), F.lit(";ALN_DT="), F.col("__ds").cast("string"), F.lit(";ALN_DQ="), F.col("__dd").cast("string")).alias("info"))
    same = F.col("s_name") == F.col("d_name")
    # a later source start is an insertion in the destination, as is a longer source
    offset = F.when(same, F.col("s_start") - F.col("d_start")).otherwise(F.col("__st") - F.col("__sd"))
    shifted = F.col("d_start") + 1 - F.when(~same & (offset < 0), F.col("__sd")).otherwise(0)
    heads = n.where("__at = 1").where(offset != 0).select("chain_id", F.col("d_name").alias("contig"), shifted.cast("long").alias("pos"), bases(offset, offset < 0).alias("ref"), bases(offset, offset > 0).alias("alt"), tpos(F.col("s_start") + 1).alias("info"))
    return heads.union(gaps)
