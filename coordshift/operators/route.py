"""Commit / defer rules and the three-way split of lifted alignments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coordshift.functions.sam import has, primary

#: Rule names with the limits they start from (fixed values).
RULES = {"mapq": 30.0, "isize": 1000.0, "clipped_frac": 0.05, "aln_score": 100.0, "hdist": 5.0}


def parse_rules(items: list[str]) -> dict[str, float | None]:
    """{"lifted": None, "mapq": 20.0, ...} of "lifted" and "name:number" items; ValueError for others."""
    out: dict[str, float | None] = {}
    for item in items:
        if item == "lifted":
            out[item] = None
            continue
        name, colon, value = item.partition(":")
        if not colon or ":" in value or name not in RULES:
            raise ValueError(f"unknown rule {item!r}")
        out[name] = float(value)
    return out


def keep_lifted(rules: dict[str, float | None], commit: Column | None = None, defer: Column | None = None) -> Column:
    """Whether a lifted alignment is committed. Needs flag, mapq, as_score, tlen, clipped_frac, nm.

    Without rules, always. A missing score defers, and so does a missing NM
    under the hdist rule; regions to commit win over all rules after them.
    """
    if not rules:
        return F.lit(True)
    out = F.when(has("flag", 4), False)
    if "mapq" in rules:
        out = out.when(F.col("mapq") < rules["mapq"], False)
    if "aln_score" in rules:
        out = out.when(F.col("as_score").isNull() | (F.col("as_score") < rules["aln_score"]), False)
    if "isize" in rules:
        out = out.when((F.col("tlen") == 0) | (F.abs("tlen") > rules["isize"]), False)
    if defer is not None:
        out = out.when(defer, False)
    if commit is not None:
        out = out.when(commit, True)
    if "clipped_frac" in rules:
        out = out.when(F.col("clipped_frac") > F.lit(rules["clipped_frac"]).cast("float"), False)
    if "hdist" in rules:
        out = out.when(F.col("nm").isNull() | (F.col("nm") > rules["hdist"]), False)
    return out.otherwise(True)


def keep_original(flag: str, commit: Column) -> Column:
    """Whether the original lies in a region where lifting is suppressed; other regions change nothing."""
    return ~has(flag, 4) & commit


def route(rows: DataFrame, kept: Column, suppressed: Column, flag: str = "flag") -> DataFrame:
    """``rows`` with committed, deferred (primary only) and unliftable."""
    rows = rows.withColumn("__d", kept).withColumn("__s", suppressed)
    d, s = F.col("__d"), F.col("__s")
    return rows.withColumn("committed", d | s).withColumn("deferred", ~d & ~s & primary(flag)).withColumn("unliftable", ~d).drop("__d", "__s")
