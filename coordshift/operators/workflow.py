"""Whole runs: lifting with its split, selective re-mapping, and annotations of regions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coordshift.functions import cigar as C
from coordshift.functions import md as M
from coordshift.functions import realign as R
from coordshift.functions.sam import has, without_tags
from coordshift.operators import lift, overlap, pairs, route, summary
from coordshift.sources.sinks import coordinate_sorted, merged_sorted

#: Values that a kind of reads and an aligner stand for (fixed values).
PRESETS = {
    ("ilmn", "bowtie2"): (0, {"hdist": 5.0, "mapq": 10.0, "aln_score": -10.0}),
    ("ilmn", "bwamem"): (0, {"hdist": 5.0, "mapq": 30.0, "aln_score": 100.0}),
    ("ilmn", "bwamem2"): (0, {"hdist": 5.0, "mapq": 30.0, "aln_score": 100.0}),
    ("pb_hifi", "minimap2"): (1000, {"hdist": 100.0}),
    ("pb_hifi", "winnowmap2"): (1000, {"hdist": 100.0}),
    ("ont", "minimap2"): (1500, {"hdist": 6000.0}),
    ("ont", "winnowmap2"): (1500, {"hdist": 6000.0}),
}


@dataclass
class Options:
    """What a lift is asked for; regions are tables of contig, start, end."""

    max_gap: int = 0
    rules: dict[str, float | None] = field(default_factory=dict)
    commit_source: DataFrame | None = None
    commit_dest: DataFrame | None = None
    defer_dest: DataFrame | None = None
    threshold: float = 0.0
    keep_mapq: bool = False
    ultima: bool = False
    reference: DataFrame | None = None
    realign: R.Settings | None = None

    def __post_init__(self) -> None:
        if not self.rules and any(x is not None for x in (self.commit_source, self.commit_dest, self.defer_dest)):
            raise ValueError("regions need a rule to split by")
        if (self.realign or "hdist" in self.rules) and self.reference is None:
            raise ValueError("realignment and the hdist rule need a reference")


def preset(kind: str, aligner: str, **more) -> Options:
    """Options for reads of a kind (ilmn_se, ilmn_pe, pb_hifi, ont) and an aligner."""
    key = (kind.removesuffix("_se").removesuffix("_pe"), aligner)
    if key not in PRESETS:
        raise ValueError(f"no preset for {kind} and {aligner}")
    gap, rules = PRESETS[key]
    return Options(max_gap=gap, rules=dict(rules), **more)


def _tag(name: str) -> Column:
    return F.col("tags")[name]["value"].try_cast("int")


def _hits(rows: DataFrame, regions: DataFrame | None, name: str, rname: str, pos: str, size: Column, threshold: float) -> DataFrame:
    if regions is None:
        return rows.withColumn(name, F.lit(False))
    spans = rows.select("id", F.col(rname).alias("contig"), F.col(pos).alias("start"), (F.col(pos) + size).alias("end"))
    found = overlap.flag_overlaps(spans, regions, threshold, name).select("id", name)
    return rows.join(found, "id", "left").withColumn(name, F.coalesce(name, F.lit(False)))


def lift_and_split(records: DataFrame, index: DataFrame, options: Options, contigs: DataFrame | None = None) -> DataFrame:
    """Lifted records with id, lo, original, and committed, deferred and unliftable.

    With a reference, MD and NM are made anew and, if asked for, reads of many
    edits realigned (tag LR).
    """
    rows = lift.lift_records(records, index, options.max_gap, options.keep_mapq, contigs, options.ultima)
    rows = rows.withColumn("nm", _tag("NM").cast("long")).withColumn("md", F.lit(None).cast("string"))
    if options.reference is not None:
        own = [c for c in rows.columns if c not in ("nm", "md")]
        rows = M.fill(rows.select(*own).withColumn("rlen", C.reference_length("cigar")), options.reference).drop("rlen")
        if options.realign is not None:
            rows = R.realign(rows, options.reference, options.realign)
            rows = rows.withColumn("tags", F.when(F.col("lr").isNull(), F.col("tags")).otherwise(F.map_concat("tags", F.create_map(F.lit("LR"), F.struct(F.lit("i").alias("type"), F.col("lr").cast("string").alias("value")))))).drop("lr")
        rows = rows.withColumn("tags", F.when(F.col("nm").isNull(), without_tags("tags", ["NM", "MD"])).otherwise(F.map_concat(without_tags("tags", ["NM", "MD"]), M.as_tags())))
    rows = rows.withColumn("as_score", _tag("AS")).withColumn("l_qseq", F.when(F.col("seq") == "*", 0).otherwise(F.length("seq"))).withColumn("clipped_frac", C.clipped_fraction("cigar", "l_qseq"))
    rows = _hits(rows, options.commit_dest, "__commit", "rname", "pos", C.reference_length("cigar"), options.threshold)
    rows = _hits(rows, options.defer_dest, "__defer", "rname", "pos", C.reference_length("cigar"), options.threshold)
    rows = rows.withColumn("__rname", F.col("original.rname")).withColumn("__pos", F.col("original.pos")).withColumn("__flag", F.col("original.flag"))
    rows = _hits(rows, options.commit_source, "__held", "__rname", "__pos", C.reference_length(F.col("original.cigar")), options.threshold)
    kept = route.keep_lifted(options.rules, F.col("__commit"), F.col("__defer"))
    routed = route.route(rows, kept, route.keep_original("__flag", F.col("__held")))
    return routed.drop("__commit", "__defer", "__held", "__rname", "__pos", "__flag", "l_qseq", "as_score", "clipped_frac", "nm", "md")


def collate(committed: DataFrame, deferred: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(committed records that stay, deferred primary records with the committed mates of those alone)."""
    marked = pairs.collate_committed(committed, deferred)
    own = [c for c in committed.columns]
    moved = marked.where("outcome = 'deferred'").select(*own)
    return marked.where("outcome = 'committed'").select(*own), deferred.where(~has("flag", 256 | 512 | 1024 | 2048)).select(*own).unionByName(moved)


def reconcile(inputs: dict[str, DataFrame], paired: bool, tag: str = "NM", conservative: bool = False) -> DataFrame:
    """Of records of one read in several inputs, those of the best input, with its label in the tag RF.

    Ends are ranked together if paired; the least mapq of all inputs is taken if conservative.
    """
    rows: DataFrame | None = None
    for label, frame in inputs.items():
        part = frame.withColumn("label", F.lit(label))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    rows = rows.withColumn("nm", _tag(tag)).withColumn("segment", pairs.segment())
    if paired:
        rows = rows.where(~has("flag", 256 | 2048))
        best = pairs.reconcile_paired(rows)
    else:
        best = pairs.reconcile_single(rows)
    chosen = rows.join(best.select("qname", "label"), ["qname", "label"], "left_semi")
    if conservative:
        least = rows.groupBy("qname", "segment").agg(F.min("mapq").alias("__least"))
        chosen = chosen.join(least, ["qname", "segment"]).withColumn("mapq", F.col("__least")).drop("__least")
    mark = F.create_map(F.lit("RF"), F.struct(F.lit("Z").alias("type"), F.col("label").alias("value")))
    return chosen.withColumn("tags", F.map_concat(without_tags("tags", ["RF"]), mark)).drop("nm", "segment", "label")


def remap(records: DataFrame, index: DataFrame, contigs: DataFrame, options: Options, aligner: Callable[[DataFrame], DataFrame], paired: bool) -> DataFrame:
    """The re-mapping run: lift and split, align the deferred reads anew, settle pairs between both, merge in coordinate order.

    ``aligner`` takes records (reads of the deferred ones) and returns aligned
    records with the same columns. ``contigs``: name, length, ord of the
    destination.
    """
    routed = lift_and_split(records, index, options, contigs)
    fields = records.columns
    committed, deferred = (routed.where(c).select(*fields) for c in ("committed", "deferred"))
    if not paired:
        return merged_sorted([committed, aligner(deferred).select(*fields)], contigs)
    committed, deferred = collate(committed, deferred)
    aligned = aligner(deferred).select(*fields)
    settled = reconcile({"liftover": deferred, "realigned": aligned}, True)
    return coordinate_sorted(committed.unionByName(settled.select(*fields)), contigs)


@dataclass
class Annotations:
    """Regions made from a chain, two references and their mappability."""

    low_identity: DataFrame
    map_reduced: DataFrame
    defer: DataFrame
    unliftable: DataFrame


def annotations(blocks: DataFrame, source: DataFrame, dest: DataFrame, source_map: DataFrame, dest_map: DataFrame, index: DataFrame, cutoff: float = 0.98, k: int = 151, least: int = 5000) -> Annotations:
    """Regions to defer: of low identity, or mappable in the source alone; and unliftable source regions of at least ``least`` bases.

    ``source`` and ``dest``: contig, seq; the maps: contig, start, end, mappable.
    """
    sizes = {n: f.select("contig", F.lit(0).cast("long").alias("start"), F.length("seq").cast("long").alias("end")).withColumn("id", F.xxhash64("contig")) for n, f in (("source", source), ("dest", dest))}
    rows = summary.chain_identity(blocks, source, dest)
    low = summary.low_identity(rows, cutoff, "dest")
    high = overlap.mappable_islands(source_map, k).select("contig", F.col("start").alias("bed_start"), F.col("end").alias("bed_end"))
    moved = lift.lift_bed(high, index).where("ok").select(F.col("t1").alias("contig"), F.col("op1").alias("start"), F.col("op2").alias("end"))
    unmappable = overlap.subtract(sizes["dest"], overlap.mappable_islands(dest_map, k))
    reduced = overlap.intersect(moved, unmappable)
    both = low.union(reduced.select("contig", "start", "end"))
    covered = rows.select(F.col("source").alias("contig"), F.col("s_start").alias("start"), F.col("s_end").alias("end"))
    gone = overlap.subtract(sizes["source"], covered)
    return Annotations(low, reduced, overlap.merge(overlap.intersect(both, sizes["dest"])), gone.where(F.col("end") - F.col("start") >= least).select("contig", "start", "end"))


def uniquely_aligned_out(reads: DataFrame, low: int = 1, high: int = 1) -> DataFrame:
    """contig, start, end of regions, named in qname as contig:from-to, that don't align between ``low`` and ``high`` times."""
    from coordshift.functions.sam import region_to_bed

    outside = pairs.count_outside(reads, ~has("flag", 4), low, high)
    contig, start, end = region_to_bed("qname")
    return outside.select(contig.alias("contig"), start.alias("start"), end.alias("end"))
