"""Summaries: exact quantiles, comparisons, totals."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from coordshift.functions.sam import has


def exact_quantiles(rows: DataFrame, value: str, quantiles: list[float], parts: int = 200) -> DataFrame:
    """q, value: the element at index int(n * q) - 1 of the sorted values (the last, for index -1).

    Distinct values are counted, and dealt to ``parts`` ranges between quantiles
    estimated first; a range's rank comes from the counts of the ranges before
    it, so no task sees all values.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"))
    cuts = counts.agg(F.percentile_approx("v", [i / parts for i in range(1, parts)], 1000).alias("cuts"))
    dealt = counts.join(F.broadcast(cuts)).withColumn("part", F.size(F.filter("cuts", lambda c: c < F.col("v"))))
    sums = dealt.groupBy("part").agg(F.sum("n").alias("here"))  # as many rows as parts at most
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("before", F.coalesce(F.sum("here").over(before), F.lit(0)))
    total = sums.agg(F.sum("here").alias("total"))
    asked = rows.sparkSession.createDataFrame([(float(q),) for q in quantiles], "q double")
    at = F.floor(F.col("total") * F.col("q")).cast("long")
    wanted = asked.join(F.broadcast(total)).withColumn("at", F.when(at == 0, F.col("total")).otherwise(at))
    # of each range only those that hold a wanted rank are sorted
    found = wanted.join(F.broadcast(offsets), (F.col("at") > F.col("before")) & (F.col("at") <= F.col("before") + F.col("here"))).select("q", "at", "before", "part")
    ranked = dealt.select("part", "v", "n").join(F.broadcast(found.select("part", "before").distinct()), "part")
    ranked = ranked.withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy("part").orderBy("v")))
    hit = (ranked["part"] == found["part"]) & (F.col("upto") >= F.col("at")) & (F.col("upto") - F.col("n") < F.col("at"))
    return ranked.join(F.broadcast(found.drop("before")), hit).select("q", F.col("v").alias("value"))


def moments(rows: DataFrame, value: str) -> DataFrame:
    return rows.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("least"), F.max(value).alias("most"))


def alignments_by_read(rows: DataFrame, order: str = "id") -> DataFrame:
    """One row a qname and segment (0 or 1): the last of the rows that aren't secondary or supplementary."""
    own = rows.where(~has("flag", 256 | 2048)).withColumn("segment", F.when(has("flag", 1) & ~has("flag", 64), 1).otherwise(0))
    fields = [c for c in own.columns if c not in ("qname", "segment")]
    last = own.groupBy("qname", "segment").agg(F.max_by(F.struct(*fields), F.col(order)).alias("x"))
    return last.select("qname", "segment", "x.*")


def compared(query: DataFrame, baseline: DataFrame, least_mapq: int = 0) -> DataFrame:
    """Reads in both inputs (as ``alignments_by_read`` gives them): state, and of the compared ones posdiff, tlendiff (-1: other contig), same_mapq, same_cigar, identity.

    state: unmapped (either is), invalid (either has mapq 255 or too low a one) or compared.
    """
    b = baseline.select("qname", "segment", *(F.col(c).alias(f"b_{c}") for c in ("rname", "pos", "mapq", "cigar", "tlen", "flag")))
    both = query.join(b, ["qname", "segment"])
    low = lambda c: (F.col(c) == 255) | (F.col(c) < least_mapq)
    state = F.when(has("flag", 4) | has("b_flag", 4), "unmapped").when(low("mapq") | low("b_mapq"), "invalid").otherwise("compared")
    same = F.col("rname") == F.col("b_rname")
    alike = F.when(~same, 0.0).when((F.col("pos") == F.col("b_pos")) & (F.col("cigar") == F.col("b_cigar")), 1.0).otherwise(identity("cigar", "pos", "b_cigar", "b_pos"))
    return both.select(
        "qname",
        "segment",
        state.alias("state"),
        has("flag", 4).alias("query_unmapped"),
        has("b_flag", 4).alias("baseline_unmapped"),
        low("mapq").alias("query_low"),
        low("b_mapq").alias("baseline_low"),
        F.when(same, F.abs(F.col("pos") - F.col("b_pos"))).otherwise(-1).cast("long").alias("posdiff"),
        F.when(same, F.abs(F.col("tlen") - F.col("b_tlen"))).otherwise(-1).cast("long").alias("tlendiff"),
        (F.col("mapq") == F.col("b_mapq")).alias("same_mapq"),
        (F.col("cigar") == F.col("b_cigar")).alias("same_cigar"),
        F.when(state == "compared", alike).alias("identity"),
    )


def compare_alignments(query: DataFrame, baseline: DataFrame, allowed: int = 1, cutoff: float = 0.8, least_mapq: int = 0) -> DataFrame:
    """One row of counts over ``compared`` reads: n, and those that agree in position, identity, either, mapq, cigar and template length; reads left out by cause and input."""
    rows = compared(query, baseline, least_mapq)
    fine = F.col("state") == "compared"
    near = (F.col("posdiff") >= 0) & (F.col("posdiff") < allowed)
    alike = F.col("identity") >= cutoff
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias
    unmapped, invalid = F.col("state") == "unmapped", F.col("state") == "invalid"
    return rows.agg(
        count(fine)("n"),
        count(fine & near)("n_pos"),
        count(fine & alike)("n_identity"),
        F.round(F.avg("identity"), 6).alias("mean_identity"),
        count(fine & (near | alike))("n_pos_or_identity"),
        count(fine & F.col("same_mapq"))("n_mapq"),
        count(fine & F.col("same_cigar"))("n_cigar"),
        count(fine & F.col("tlendiff").between(0, 50))("n_tlen"),
        count(unmapped & F.col("query_unmapped"))("query_unmapped"),
        count(unmapped & F.col("baseline_unmapped"))("baseline_unmapped"),
        count(unmapped)("n_unmapped"),
        count(invalid & F.col("query_low"))("query_invalid"),
        count(invalid & F.col("baseline_low"))("baseline_invalid"),
        count(invalid)("n_invalid"),
    )


def first_errors(rows: DataFrame, category: str, n: int = 10, allowed: int = 1, cutoff: float = 0.8, furthest: int = 2**62) -> DataFrame:
    """The first ``n`` (by qname and segment) ``compared`` reads that differ by ``category``: pos, idy, pos_idy, cigar or tlen."""
    far = (F.col("posdiff") > allowed) & (F.col("posdiff") <= furthest)
    unlike = F.col("identity") < cutoff
    kinds = {"pos": far, "idy": unlike, "pos_idy": far & unlike, "cigar": ~F.col("same_cigar"), "tlen": F.col("tlendiff") >= 50}
    return rows.where((F.col("state") == "compared") & kinds[category]).orderBy("qname", "segment").limit(n)


def compare_reads(gold: DataFrame, test: DataFrame, k: int = 50) -> DataFrame:
    """category, n of test reads (name, segment, seq): first k bases equal to read 1 or 2 of that name, or to none."""
    g = gold.groupBy("name").agg(F.min(F.when(F.col("segment") == 1, F.substring("seq", 1, k))).alias("s1"), F.min(F.when(F.col("segment") == 2, F.substring("seq", 1, k))).alias("s2"))
    own = F.substring("seq", 1, k)
    kind = F.when((own == F.col("s1")) & (own == F.col("s2")), "both").when(own == F.col("s1"), "read1").when(own == F.col("s2"), "read2").otherwise("none")
    return test.join(g, "name", "left").groupBy(kind.alias("category")).agg(F.count("*").alias("n"))


def cigar_identity(a: str, pos_a: int, b: str, pos_b: int) -> float:
    """Share of a read's bases that two alignments of it place alike: runs that meet at one place of the read with one operator and diagonal.

    A run that skips the read meets others only where it stands; of two that
    meet the shorter one is used up.
    """
    from coordshift.functions.cigar import QUERY, REFERENCE, runs

    def segments(cigar: str, pos: int) -> tuple[list[tuple[int, int, str, int]], int]:
        q, r, out = 0, pos, []
        for n, op in runs(cigar):
            out.append((q, n, op, r - q))
            q += n if op in QUERY else 0
            r += n if op in REFERENCE else 0
        return out, sum(n for n, op in runs(cigar) if op in QUERY + "H")

    if (a, pos_a) == (b, pos_b):
        return 1.0
    (x, size), (y, _) = segments(a, pos_a), segments(b, pos_b)
    same, i, j, cut_x, cut_y = 0, 0, 0, 0, 0
    while i < len(x) and j < len(y):
        (p, n, op, d), (q, m, other, e) = x[i], y[j]
        p, n, q, m = p + cut_x, n - cut_x, q + cut_y, m - cut_y
        if p != q:
            cut_x, cut_y = (cut_x + q - p, cut_y) if p < q else (cut_x, cut_y + p - q)
            continue
        same += min(n, m) if op == other and d == e else 0
        i, cut_x = (i + 1, 0) if n <= m else (i, cut_x)
        j, cut_y = (j + 1, 0) if m <= n else (j, cut_y)
    return same / max(size, 1)


@F.pandas_udf(DoubleType())
def _identities(a: pd.Series, pos_a: pd.Series, b: pd.Series, pos_b: pd.Series) -> pd.Series:
    return pd.Series([cigar_identity(w, x, y, z) for w, x, y, z in zip(a, pos_a, b, pos_b, strict=True)], dtype="float64")


def identity(cigar: str, pos: str, other_cigar: str, other_pos: str) -> Column:
    return _identities(F.col(cigar), F.col(pos), F.col(other_cigar), F.col(other_pos))


def performance(rows: DataFrame) -> DataFrame:
    """Totals of ``sources.text.read_time_log`` rows: commands, CPU and wall seconds, largest memory."""
    return rows.agg(F.count("*").alias("commands"), *(F.round(F.sum(c), 3).alias(c) for c in ("user_s", "system_s", "wall_s")), F.round(F.sum(F.col("user_s") + F.col("system_s")), 3).alias("cpu_s"), F.max("max_rss_kb").alias("max_rss_kb"))


def chain_identity(blocks: DataFrame, source: DataFrame, dest: DataFrame) -> DataFrame:
    """Summary rows of chain blocks against two FASTA tables (contig, seq): size, hdist, source, s_start, s_end, strand, dest, d_start, d_end.

    hdist is the share of equal letters, upper-cased, on the reverse strand with
    all but A, C, G, T as N; 0 where a contig is missing, null where the pieces
    differ in length. strand is always +, as both places are counted forward;
    ``forward`` tells the strand.
    """
    from coordshift.functions import sequence
    from coordshift.functions.sam import masked_complement
    from coordshift.operators.index import chain_to_intervals

    rows = chain_to_intervals(blocks, F.col("chain_id"), F.col("line_no"))
    size = F.col("source_end") - F.col("source_start")
    d_start = F.col("source_start") + F.col("off")
    rows = rows.select("chain_id", "line_no", size.alias("size"), F.col("contig").alias("source"), F.col("source_start").alias("s_start"), F.col("source_end").alias("s_end"), "strand", F.col("target").alias("dest"), d_start.alias("d_start"), (d_start + size).alias("d_end"))
    cut = lambda seq, start: F.upper(F.substring(seq, (F.col(start) + 1).cast("int"), F.col("size").cast("int")))
    a = source.select(F.col("contig").alias("source"), F.col("seq").alias("__a"))
    b = dest.select(F.col("contig").alias("dest"), F.col("seq").alias("__b"))
    met = rows.join(a, "source", "left").withColumn("__x", cut(F.col("__a"), "s_start")).drop("__a")
    met = met.join(b, "dest", "left").withColumn("__y", cut(F.col("__b"), "d_start")).drop("__b")
    met = met.withColumn("__y", F.when(F.col("strand"), F.col("__y")).otherwise(masked_complement("__y")))
    known = F.col("__x").isNotNull() & F.col("__y").isNotNull()
    hdist = F.when(~known, 0.0).when(F.length("__x") == F.length("__y"), sequence.identity("__x", "__y"))
    return met.select("chain_id", "line_no", "size", hdist.alias("hdist"), "source", "s_start", "s_end", F.lit("+").alias("strand"), F.col("strand").alias("forward"), "dest", "d_start", "d_end")


def low_identity(summary: DataFrame, cutoff: float, side: str = "source") -> DataFrame:
    """contig, start, end of the summary rows below the cutoff, by source or dest."""
    p = "s" if side == "source" else "d"
    return summary.where(F.col("hdist") < cutoff).select(F.col(side).alias("contig"), F.col(f"{p}_start").alias("start"), F.col(f"{p}_end").alias("end"))


def identity_totals(summary: DataFrame) -> DataFrame:
    """bases and equal bases over all rows."""
    return summary.agg(F.sum("size").alias("bases"), F.sum(F.col("size") * F.col("hdist")).alias("equal_bases"))


def sample_pairs(reads: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """Rows of a share of the names: mates share a draw, so both stay or go."""
    draw = F.pmod(F.xxhash64("name", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return reads.where(draw < share)


def verbose_blocks(summary: DataFrame) -> DataFrame:
    """chain_id, line_no, value: each block's places in both genomes as text, with its shift and share of equal letters."""
    here = F.concat(F.col("source"), F.lit(":"), F.col("s_start").cast("string"), F.lit("-"), F.col("s_end").cast("string"))
    there = F.when(F.col("forward"), F.concat(F.col("d_start").cast("string"), F.lit("-"), F.col("d_end").cast("string"))).otherwise(F.concat(F.col("d_end").cast("string"), F.lit("-"), F.col("d_start").cast("string")))
    shift = F.when(F.col("forward"), F.col("d_start")).otherwise(F.col("d_end")) - F.col("s_start")
    value = F.concat(here, F.lit("=>"), F.col("dest"), F.lit(":"), there, F.lit(" ("), shift.cast("string"), F.lit(")\t"), F.coalesce(F.col("hdist").cast("string"), F.lit("")))
    return summary.select("chain_id", "line_no", value.alias("value"))


def block_regions(summary: DataFrame, side: str = "source") -> DataFrame:
    """contig, start, end of the blocks, by source or dest."""
    p = "s" if side == "source" else "d"
    return summary.select(F.col(side).alias("contig"), F.col(f"{p}_start").alias("start"), F.col(f"{p}_end").alias("end"))
