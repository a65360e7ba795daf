"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed by cell (source, language, topic). Cell weights are raked:
scaled to one marginal after the other until all of them fit their targets.
Documents are then kept with a probability proportional to their cell's
weight, scaled so that the expected tokens meet the budget and no probability
exceeds 1. The draw is a hash of doc_id, so it is the same on every run.

Only DataFrame operations are used. A marginal's sums are combined before
their shuffle, and the cell table joins the documents by broadcast only where
it has at most ``BROADCAST_CELLS`` rows.

Defined cases: null source or language is the class "(none)"; null and empty
texts have no tokens and the topic "empty", and are kept with the probability
of their cell; targets are rescaled over the classes that have tokens; classes
without a target keep their present share; repeated rows are drawn alike; rows
with a null doc_id are drawn as if it were empty; extra columns are carried
along by ``sample`` and ignored elsewhere; an empty table gives an empty result.
"""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coordshift.llm.common import checkpointed, table, written

MARGINS = ("source", "lang", "topic")
BROADCAST_CELLS = 200_000
NONE = "(none)"


def n_tokens(text: Column) -> Column:
    """Words: runs of bytes other than space and \\t to \\r."""
    kept = F.trim(F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     "))
    gaps = F.length(kept) - F.length(F.replace(kept, F.lit(" "), F.lit("")))
    double = F.length(kept) - F.length(F.replace(kept, F.lit("  "), F.lit(" ")))
    # runs of spaces are rare: only such texts are split
    exact = F.size(F.split(kept, " +"))
    return F.when(kept == "", 0).when(double == 0, gaps + 1).otherwise(exact).cast("long")


def topic(text: Column) -> Column:
    """A coarse topic from marks in the text."""
    t = F.coalesce(text, F.lit(""))
    return (
        F.when(F.trim(t) == "", "empty")
        .when(F.contains(t, F.lit(" | ")), "table")
        .when(F.contains(t, F.lit("http")) | F.contains(t, F.lit("@")), "contact")
        .when(F.contains(F.lower(t), F.lit("license")), "legal")
        .when(F.length(t) > 4000, "long prose")
        .otherwise("prose")
    )


def with_cells(docs: DataFrame) -> DataFrame:
    return docs.select(
        "*",
        F.coalesce(docs["source"].cast("string"), F.lit(NONE)).alias("__source"),
        F.coalesce(docs["lang"].cast("string"), F.lit(NONE)).alias("__lang"),
        topic(docs["text"]).alias("__topic"),
        n_tokens(docs["text"]).alias("__tokens"),
    )


def cells_of(docs: DataFrame) -> DataFrame:
    keys = [F.col(f"__{m}").alias(m) for m in MARGINS]
    return with_cells(docs).groupBy(*keys).agg(F.sum("__tokens").cast("double").alias("tokens"), F.count("*").alias("docs"))


def power_targets(cells: DataFrame, margin: str, power: float) -> DataFrame:
    """value, share: shares proportional to a power of the present ones (0: uniform, 1: unchanged)."""
    sums = cells.groupBy(F.col(margin).alias("value")).agg(F.sum("tokens").alias("t")).where("t > 0")
    return sums.select("value", F.pow("t", F.lit(power)).alias("share"))


def fixed_targets(cells: DataFrame, shares: dict[str, float]) -> DataFrame:
    return cells.sparkSession.createDataFrame(list(shares.items()), "value string, share double")


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = 12, tolerance: float = 1e-4) -> DataFrame:
    """``cells`` with a column weight; tokens * weight has the target marginals and the total of tokens.

    Targets that contradict each other can't be met: a warning says by how much
    they are missed.
    """
    cells = cells.withColumn("weight", F.lit(1.0))
    few = cells.limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS
    if few:
        cells = cells.coalesce(1)  # few rows: rounds without shuffles
    cells = checkpointed(cells)
    total = cells.agg(F.coalesce(F.sum("tokens"), F.lit(0.0))).first()[0]
    if not total:
        return cells
    goals = {}
    for margin, wanted in targets.items():
        present = cells.groupBy(F.col(margin).alias("value")).agg(F.sum("tokens").alias("t")).where("t > 0")
        both = present.join(wanted.groupBy("value").agg(F.max("share").alias("share")), "value", "left")
        known, given, old = both.agg(F.sum(F.when(F.col("share").isNotNull(), F.col("t"))), F.sum("share"), F.sum("t")).first()
        scale = (known or 0.0) / given if given else 0.0
        goals[margin] = both.select(F.col("value").alias(margin), F.coalesce(F.col("share") * scale, F.col("t")).alias("goal"))
        goals[margin] = checkpointed(goals[margin].coalesce(1) if few else goals[margin])
    for _ in range(rounds):
        for margin, goal in goals.items():
            sums = cells.groupBy(margin).agg(F.sum(F.col("tokens") * F.col("weight")).alias("now"))
            factor = sums.join(goal, margin).select(margin, (F.col("goal") / F.col("now")).alias("factor"), (F.abs(F.col("now") - F.col("goal")) / total).alias("miss"))
            cells = cells.drop("miss").join(factor, margin, "left").withColumn("weight", F.col("weight") * F.coalesce("factor", F.lit(1.0)))
            cells = cells.withColumnRenamed("miss", f"miss_{margin}").drop("factor")
        misses = [F.coalesce(f"miss_{m}", F.lit(0.0)) for m in goals]
        cells = cells.withColumn("miss", reduce(lambda a, b: F.greatest(a, b), misses, F.lit(0.0))).drop(*(f"miss_{m}" for m in goals))
        # A checkpoint keeps the size that the optimizer estimated, the product of the joined sizes: its digits would
        # double with every join. A limit above the checked number of cells, or a written table, ends that.
        cells = checkpointed(cells.limit(BROADCAST_CELLS)) if few else written(cells, "cells")
        miss = cells.agg(F.max("miss")).first()[0] or 0.0
        if miss < tolerance:
            break
    else:
        warnings.warn(f"targets are missed by up to {miss:.2g} of all tokens after {rounds} rounds", stacklevel=2)
    return cells.drop("miss")


def probabilities(cells: DataFrame, budget: float) -> DataFrame:
    """``cells`` with probability = min(1, scale * weight); expected tokens are ``budget`` of all."""
    total, top = cells.agg(F.coalesce(F.sum("tokens"), F.lit(0.0)), F.max("weight")).first()
    goal, scale, full = budget * total, None, -1.0
    while total:
        sure = F.lit(False) if scale is None else F.col("weight") * scale >= 1
        fixed, free = cells.agg(F.coalesce(F.sum(F.when(sure, F.col("tokens"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~sure, F.col("tokens") * F.col("weight"))), F.lit(0.0))).first()
        if free <= 0 or fixed == full or goal <= fixed:
            break
        scale, full = (goal - fixed) / free, fixed
    scale = 1.0 / top if scale is None and top else scale or 1.0
    return cells.withColumn("probability", F.least(F.lit(1.0), F.col("weight") * F.lit(scale)))


def weighted(docs: DataFrame, cells: DataFrame) -> DataFrame:
    """``docs`` with __source, __lang, __topic, __tokens, __weight, __probability."""
    few = cells.limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS
    small = cells.select(*(F.col(m).alias(f"__{m}") for m in MARGINS), F.col("weight").alias("__weight"), F.col("probability").alias("__probability"))
    return with_cells(docs).join(F.broadcast(small) if few else small, [f"__{m}" for m in MARGINS], "left")


def draw(doc_id: Column, seed: int) -> Column:
    """A number from 0 to 1, fixed by doc_id and seed."""
    return F.pmod(F.xxhash64(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))


def fit(docs: DataFrame, targets: dict | None = None, budget: float = 0.6) -> DataFrame:
    """Raked cells with probabilities. Targets by margin: a power, or shares by class."""
    cells = checkpointed(cells_of(docs))
    wanted = {"source": 0.5, "lang": 0.7, "topic": 0.8} if targets is None else targets
    made = {m: fixed_targets(cells, t) if isinstance(t, dict) else power_targets(cells, m, t) for m, t in wanted.items()}
    return probabilities(rake(cells, made), budget)


def sample(docs: DataFrame, targets: dict | None = None, budget: float = 0.6, seed: int = 7) -> DataFrame:
    """The drawn rows of ``docs``, with its own columns."""
    chosen = weighted(docs, fit(docs, targets, budget))
    return chosen.where(draw(docs["doc_id"], seed) < F.col("__probability")).select(*(docs[c] for c in docs.columns))


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    rows = weighted(docs, fit(docs))
    return rows.select("doc_id", F.col("__source").alias("source"), F.col("__lang").alias("lang"), F.col("__topic").alias("topic"), F.col("__tokens").alias("n_tokens"), F.col("__weight").alias("weight"), F.col("__probability").alias("probability"), (draw(docs["doc_id"], 7) < F.col("__probability")).alias("sampled"))
