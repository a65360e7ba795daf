"""Mates and competing alignments: collate, reconcile, extract, count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coordshift.functions.sam import has, primary

WORST = -(2**31)


def segment(flag: str = "flag") -> Column:
    return F.when(has(flag, 128), 2).otherwise(1)


def deferred_pairs(deferred: DataFrame, value: str = "seq") -> DataFrame:
    """One row per name: r1 and r2 (null: missing) of the primary deferred reads."""
    own = deferred.where(primary("flag")).withColumn("__seg", segment())
    return own.groupBy("qname").agg(F.min(F.when(F.col("__seg") == 1, F.col(value))).alias("r1"), F.min(F.when(F.col("__seg") == 2, F.col(value))).alias("r2"))


def collate_committed(committed: DataFrame, deferred: DataFrame) -> DataFrame:
    """``committed`` with outcome: committed, deferred (its mate was deferred alone) or dropped (non-primary of such a pair)."""
    alone = deferred.where(primary("flag")).groupBy("qname").agg(F.countDistinct(segment()).alias("__n")).where("__n = 1").select("qname", F.lit(True).alias("__alone"))
    out = F.when(F.col("__alone").isNull(), "committed").when(primary("flag"), "deferred").otherwise("dropped")
    return committed.join(alone, "qname", "left").withColumn("outcome", out).drop("__alone")


def extract_mates(reads: DataFrame, names: DataFrame) -> DataFrame:
    """``reads`` with to_fastq: a primary read whose name is listed."""
    listed = names.select("qname").distinct().withColumn("__in", F.lit(True))
    return reads.join(listed, "qname", "left").withColumn("to_fastq", F.coalesce("__in", F.lit(False)) & primary("flag")).drop("__in")


def count_outside(reads: DataFrame, passes: Column, low: int, high: int) -> DataFrame:
    """qname, n: passing reads per name where n lies outside low to high; names with none count 0."""
    return reads.groupBy("qname").agg(F.sum(passes.cast("long")).alias("n")).where((F.col("n") < low) | (F.col("n") > high))


def reconcile_single(rows: DataFrame, tag: str = "nm") -> DataFrame:
    """Best label per qname: least tag, then highest mapq, then label; with n_tied."""
    score = F.when(has("flag", 4) | F.col(tag).isNull(), WORST).otherwise(-F.col(tag)).cast("long")
    return _best(rows.withColumn("score", score), ["qname"], [F.desc("score"), F.desc("mapq")])


def reconcile_paired(rows: DataFrame, tag: str = "nm") -> DataFrame:
    """As above for pairs: proper pairs (template length of the first read not 0) win, then summed score and mapq.

    A missing or unmapped end adds half the worst score.
    """
    good = ~has("flag", 4) & F.col(tag).isNotNull()
    ends = rows.where(~has("flag", 256 | 2048)).groupBy("qname", "label").agg(
        F.coalesce(F.max(F.when(F.col("segment") == 1, F.col("tlen") != 0)), F.lit(False)).alias("proper"),
        F.sum(F.when(good, -F.col(tag)).otherwise(WORST // 2)).alias("__sum"),
        F.countDistinct("segment").alias("__n"),
        F.sum("mapq").alias("mapq"),
    )
    ends = ends.withColumn("score", (F.col("__sum") + (2 - F.col("__n")) * (WORST // 2)).cast("long")).drop("__sum", "__n")
    return _best(ends, ["qname"], [F.desc("proper"), F.desc("score"), F.desc("mapq")])


def _best(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys)
    ranked = rows.withColumn("__rank", F.rank().over(w.orderBy(*order))).withColumn("__row", F.row_number().over(w.orderBy(*order, "label")))
    ranked = ranked.withColumn("n_tied", F.sum((F.col("__rank") == 1).cast("long")).over(w))
    return ranked.where("__row = 1").drop("__rank", "__row")


def conservative_mapq(rows: DataFrame) -> DataFrame:
    """``rows`` with each end's least mapq over all inputs."""
    least = rows.groupBy("qname", "segment").agg(F.min("mapq").alias("least_mapq"))
    return rows.join(least, ["qname", "segment"])
