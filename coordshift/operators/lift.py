"""Coordinate lifting as projections over the as-of join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coordshift.functions import cigar as C
from coordshift.functions.sam import has, reverse_complement, reversed_array
from coordshift.operators.asof import Placed, Search, Written, placed, prepared, slots, with_steps


def lifted(pos: Column, at: Column) -> Column:
    """Place in the destination by an interval's offset and strand."""
    return F.when(at["strand"], pos + at["off"]).otherwise(-pos + at["off"] + at["source_start"] + at["source_end"])


def clip_start(pos: Column) -> Column:
    """Bases to skip from a leftmost place to the next interval; 0 inside one, -1 if it can't be done."""
    s, e = F.col("s"), F.col("e")
    in_gap = (F.col("sidx") == F.col("eidx")) & (F.col("sidx") != 0)
    to_next = F.abs(pos - s["next_source_start"]) + F.when(~s["next_strand"], 1).otherwise(0)
    gap = F.when(s["next_source_start"].isNull() | (s["next_target"] != s["target"]), -1).otherwise(to_next)
    return _clip(in_gap, gap, s, e)


def clip_end(pos: Column) -> Column:
    """Bases to drop from a rightmost place back to the interval before it."""
    s, e = F.col("s"), F.col("e")
    in_gap = (F.col("sidx") == F.col("eidx")) & (F.col("sidx") != 0)
    return _clip(in_gap, F.abs(pos - s["source_end"]) + F.when(s["strand"], 1).otherwise(0), s, e)


def _clip(in_gap: Column, gap: Column, s: Column, e: Column) -> Column:
    inside = F.when(s["target_run"] == e["target_run"], 0).otherwise(-1)
    bad = (F.col("sidx") <= -1) | (F.col("eidx") <= -1) | (F.col("sidx") < F.col("eidx"))
    return F.when(bad, -1).when(in_gap, gap).otherwise(inside).cast("long")


def lift_points(points: DataFrame, index: DataFrame | Search | Written | Placed, allowed: int = 0, left: bool = True, contig: str = "contig", pos: str = "pos") -> DataFrame:
    """``points`` with sidx, eidx, clip, target ("*": none) and lifted (-1: not liftable).

    Leftmost places in a gap move on to the next interval, rightmost ones back;
    a clip of -1 isn't refused by itself, it shifts the result by one.
    """
    cols = points.columns
    p, s_ = F.col(pos), F.col("s")
    got = slots(points, index, contig, pos).withColumn("clip", clip_start(p) if left else clip_end(p))
    on = (F.col("sidx") == F.col("eidx")) & (F.col("sidx") != 0) & s_["next_source_start"].isNotNull() & F.lit(left)
    following = F.struct(s_["next_strand"].alias("strand"), s_["next_off"].alias("off"), s_["next_source_start"].alias("source_start"), s_["next_source_end"].alias("source_end"))
    place = F.when(on, lifted(p, following)).otherwise(lifted(p, s_))
    found = (F.col("sidx") > -1) & (F.col("eidx") > -1) & (F.col("clip") <= allowed)
    out = F.when(found, place + (F.col("clip") if left else -F.col("clip"))).otherwise(-1)
    target = F.when(F.col("sidx") >= 0, s_["target"]).otherwise("*")
    return got.select(*cols, "sidx", "eidx", "clip", target.alias("target"), out.cast("long").alias("lifted"))


def lift_bed(bed: DataFrame, index: DataFrame, allowed: int = 500) -> DataFrame:
    """``bed`` (contig, bed_start, bed_end and others) with t1, op1, t2, op2 and ok.

    The end is lifted as the last base. The gap test uses that last base, so
    ``allowed`` 0 refuses every interval.
    """
    cols = bed.columns
    index = placed(bed, prepared(index), (F.col("contig"), F.col("bed_start")), (F.col("contig"), F.col("bed_end") - 1))
    first = lift_points(bed, index, allowed, True, "contig", "bed_start").select(*cols, F.col("target").alias("t1"), F.col("lifted").alias("op1"))
    both = lift_points(first.withColumn("__last", F.col("bed_end") - 1), index, allowed, False, "contig", "__last")
    both = both.withColumn("t2", F.col("target")).withColumn("op2", F.col("lifted") + 1)
    span = F.col("op2") - F.col("op1")
    bad = (F.col("op1") < 0) | (F.col("op2") < 0) | (span <= 0) | (F.col("t1") == "*") | (F.col("t2") == "*") | (F.col("t1") != F.col("t2")) | (span - (F.col("bed_end") - 1) + F.col("bed_start") > allowed)
    return both.select(*cols, "t1", "op1", "t2", "op2", (~bad).alias("ok"))


def _met(spans: DataFrame, index: DataFrame, last: str, steps: list[Column]) -> DataFrame:
    """``spans`` with the steps from start_idx to ``last``, on buckets of interval ranks; spans over many buckets meet whole ones."""
    wide = 64
    own = index.where("next_off is not null").select(F.col("contig").alias("__contig"), F.col("idx").alias("__idx"), F.floor(F.col("idx") / wide).alias("__b"), *steps)
    cut = spans.withColumn("__b", F.explode(F.expr(f"sequence(start_idx div {wide}, greatest({last}, start_idx) div {wide})")))
    return cut.join(own, (F.col("contig") == F.col("__contig")) & (cut["__b"] == own["__b"])).where(f"__idx between start_idx and {last}")


def legal_spans(spans: DataFrame, index: DataFrame, allowed: int) -> DataFrame:
    """``spans`` (id, contig, start_idx, end_idx and others) with legal: all steps between the intervals keep strand, target and offset.

    A span over one interval is legal; one that names intervals the contig
    doesn't have isn't. Every span is returned.
    """
    fine = (F.col("strand") == F.col("next_strand")) & (F.col("target") == F.col("next_target")) & (F.abs(F.col("next_off") - F.col("off")) <= allowed)
    many = spans.where("start_idx < end_idx and start_idx >= 0")
    met = _met(many.select("id", "contig", "start_idx", "end_idx").distinct(), index, "end_idx - 1", [fine.alias("__fine"), (F.col("next_off") - F.col("off")).alias("__step")])
    keys = ["id", "contig", "start_idx", "end_idx"]
    judged = met.groupBy(*keys).agg((F.min("__fine") & (F.abs(F.sum("__step")) <= allowed)).alias("__legal"), F.count("*").alias("__n"))
    joined = spans.join(judged, keys, "left")
    legal = F.when(F.col("start_idx") >= F.col("end_idx"), True).otherwise(F.coalesce(F.col("__legal") & (F.col("__n") == F.col("end_idx") - F.col("start_idx")), F.lit(False)))
    return joined.select(*(spans[c] for c in spans.columns), legal.alias("legal"))


def break_points(spans: DataFrame, index: DataFrame) -> DataFrame:
    """``spans`` (id, contig, pos, start_idx, end_idx and others) with bps: array of (bp, diff), in order, for all steps up to end_idx; empty without any."""
    here = F.col("off") + F.col("source_start") + F.col("source_end")
    there = F.col("next_off") + F.col("next_source_start") + F.col("next_source_end")
    diff = F.when(F.col("strand"), F.col("next_off") - F.col("off")).otherwise(here - there)
    met = _met(spans.select("id", "contig", "pos", "start_idx", "end_idx").distinct(), index.where("target = next_target"), "end_idx", [F.col("source_end").alias("__end"), diff.alias("__diff")]).where("__end > pos")
    keys = ["id", "contig", "pos", "start_idx", "end_idx"]
    own = met.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__idx", (F.col("__end") - F.col("pos")).alias("bp"), F.col("__diff").alias("diff")))).alias("x"))
    listed = F.transform("x", lambda v: F.struct(v["bp"].alias("bp"), v["diff"].alias("diff")))
    return spans.join(own, keys, "left").select(*(spans[c] for c in spans.columns), F.coalesce(listed, F.array().cast("array<struct<bp:bigint,diff:bigint>>")).alias("bps"))


def status_code(paired: Column, self_ok: Column, mate_ok: Column) -> Column:
    """The LO tag: L for lifted, UM for unmapped, itself and then the mate."""
    one = F.when(self_ok, "L").otherwise("UM")
    return F.when(paired, F.concat(one, F.lit("_"), F.when(mate_ok, "L").otherwise("UM"))).otherwise(one)


def lift_tlen(status: Column, tlen: Column, same: Column, turned: Column, pos: Column, mpos: Column, new_pos: Column, new_mpos: Column) -> Column:
    """Template length after lifting; 0 unless both mates are lifted to one contig."""
    kept = tlen + (mpos - pos) - (new_mpos - new_pos)
    flipped = -(tlen + (mpos - pos) + (new_mpos - new_pos))
    return F.when((status == "L_L") & (tlen != 0) & same, F.when(turned, flipped).otherwise(kept)).otherwise(0).cast("long")


def _side(rows: DataFrame, search, contig: str, pos: str, size: str, name: str, allowed: int, own: bool, listed: DataFrame | None) -> DataFrame:
    """``rows`` with what lifting one end of a pair gives: ``name``_ok, _target, _strand, _pos, _i, _j, _clip, _cut.

    A mate has no clips: its place doesn't move on over the bases before an interval.
    """
    cols, s_ = rows.columns, F.col("s")
    a = slots(rows, search, contig, pos).withColumn("__clip", clip_start(F.col(pos)))
    on = (F.col("sidx") == F.col("eidx")) & (F.col("sidx") != 0) & s_["next_source_start"].isNotNull()
    names = ("target", "strand", "off", "source_start", "source_end", "bad")
    following = F.struct(*(s_[f"next_{c}"].alias(c) for c in names))
    current = F.struct(*(s_[c].alias(c) for c in names))
    a = a.select(*cols, F.when(on, following).otherwise(current).alias("__at"), F.when(on, F.col("sidx") + 1).otherwise(F.col("sidx")).alias("__i"), F.col("eidx").alias("__seen"), "__clip", (F.col(pos) + F.col(size)).alias("__stop"))
    b = slots(a, search, contig, "__stop").withColumn("__cut", clip_end(F.col("__stop")))
    ok = (F.col("__i") >= 0) & (F.col("__seen") >= 0) & F.col("__clip").between(0, allowed) & (F.col("sidx") >= 0) & (F.col("eidx") >= 0)
    if own:
        ok = ok & (F.col("__cut") >= 0) & (F.col("__clip") + F.col("__cut") <= allowed)
    # steps between the intervals: as many unfit ones up to the last as up to the first
    steps = (F.col("s")["bad"] == F.col("__at")["bad"]) & (F.abs(F.col("s")["off"] - F.col("__at")["off"]) <= allowed)
    ok = ok & ((F.col("__i") >= F.col("sidx")) | steps)
    if listed is not None:
        known = listed.select(F.col("name").alias("__name")).distinct()
        b = b.join(known, F.col("__at")["target"] == F.col("__name"), "left")
        ok = ok & F.col("__name").isNotNull()
    before, after = (F.greatest(c, F.lit(0)) if own else F.lit(0) for c in ("__clip", "__cut"))
    place = F.when(F.col("__at")["strand"], lifted(F.col(pos), F.col("__at")) + before).otherwise(lifted(F.col("__stop"), F.col("s")) + after)
    ok = F.coalesce(ok & (place >= 0), F.lit(False))
    return b.select(*cols, ok.alias(f"{name}_ok"), F.col("__at")["target"].alias(f"{name}_target"), F.col("__at")["strand"].alias(f"{name}_strand"), place.alias(f"{name}_pos"), F.col("__i").alias(f"{name}_i"), F.col("sidx").alias(f"{name}_j"), F.greatest("__clip", F.lit(0)).alias(f"{name}_clip"), F.greatest("__cut", F.lit(0)).alias(f"{name}_cut"))


def lift_segments(aln: DataFrame, index: DataFrame | Search | Written, allowed: int = 0, contigs: DataFrame | None = None) -> DataFrame:
    """``aln`` with own_ and mate_ columns: ok, target, strand, pos; and new_cigar of the lifted ones, if it has a column cigar.

    Needs flag, rname, pos, rlen, rnext, pnext, mate_rlen; cigar and l_qseq for
    the CIGARs; and a unique id where the index is too large to be searched in
    place. ``contigs``: names of the destination's header; a read that lifts to
    another one fails. ``index``: prepared ones have counted the steps that ``allowed`` forbids. An end that isn't mapped, a negative place, steps between
    intervals that aren't legal, or a CIGAR that can't be kept, fail.
    """
    cols = aln.columns
    search = index if isinstance(index, Search | Written) else prepared(with_steps(index, allowed))
    at = placed(aln, search, *((F.col(c), F.col(p) + F.col(n) if n else F.col(p)) for c, p, z in (("rname", "pos", "rlen"), ("rnext", "pnext", "mate_rlen")) for n in ("", z)))
    got = _side(aln, at, "rname", "pos", "rlen", "own", allowed, True, contigs)
    got = _side(got, at, "rnext", "pnext", "mate_rlen", "mate", allowed, False, contigs)
    got = got.withColumn("own_ok", F.col("own_ok") & ~has("flag", 4)).withColumn("mate_ok", F.col("mate_ok") & ~has("flag", 8) & has("flag", 1))
    ends = [f"{n}_{c}" for n in ("own", "mate") for c in ("ok", "target", "strand", "pos")]
    if "cigar" not in cols:
        return got.select(*cols, *ends)
    many = F.col("own_ok") & (F.col("own_i") < F.col("own_j"))
    if isinstance(search, Search):
        got = got.withColumn("__bps", search.crossings(F.when(many, F.col("rname")), F.col("own_i"), F.col("own_j"), F.col("pos")))
    else:
        spans = got.where(many).select("id", F.col("rname").alias("contig"), "pos", F.col("own_i").alias("start_idx"), F.col("own_j").alias("end_idx"))
        got = got.join(break_points(spans, search.rows).select("id", F.col("bps").alias("__bps")), "id", "left")
    one = F.col("own_i") == F.col("own_j")
    easy = one & (F.col("own_clip") == 0) & (F.col("own_cut") == 0) & ~F.col("cigar").rlike("[=X]")
    # the plain case gives Python nulls
    hard = C.lift(F.when(F.col("own_ok") & ~easy, F.col("cigar")), F.coalesce("l_qseq", F.lit(0)), F.col("__bps")["bp"], F.col("__bps")["diff"], one, "own_strand", "own_clip", "own_cut")
    out = got.withColumn("new_cigar", F.when(easy, F.when(F.col("own_strand"), F.col("cigar")).otherwise(C.turned("cigar"))).otherwise(hard))
    whole = has("flag", 256 | 2048) | (F.coalesce(F.col("l_qseq"), F.lit(0)) == C.query_length("new_cigar"))
    out = out.withColumn("own_ok", F.col("own_ok") & F.coalesce(whole & F.col("new_cigar").isNotNull(), F.lit(False)))
    return out.select(*cols, *ends, F.when(F.col("own_ok"), F.col("new_cigar")).otherwise("*").alias("new_cigar"))


def lift_alignments(aln: DataFrame, index: DataFrame, allowed: int = 0, keep_mapq: bool = False, contigs: DataFrame | None = None) -> DataFrame:
    """Lifted alignments: ``aln`` with lo, the own_ and mate_ columns, and new_ flag, rname, pos, mapq, rnext, pnext, tlen and cigar.

    Needs what ``lift_segments`` does, and qname, mapq, tlen. Without the column
    cigar, coordinates alone are lifted.
    """
    cols = aln.columns
    got = lift_segments(aln, index, allowed, contigs)
    paired = has("flag", 1)
    got = got.withColumn("lo", status_code(paired, F.col("own_ok"), F.col("mate_ok")))
    own_turn, mate_turn = F.col("own_ok") & ~F.col("own_strand"), F.col("mate_ok") & ~F.col("mate_strand")
    flag = F.col("flag")
    flag = F.when(~F.col("own_ok"), flag.bitwiseOR(4).bitwiseAND(~2 & ~16)).otherwise(F.when(own_turn, flag.bitwiseXOR(F.lit(16))).otherwise(flag))
    flag = F.when(paired & ~F.col("mate_ok"), flag.bitwiseOR(8).bitwiseAND(~2 & ~32)).otherwise(F.when(mate_turn, flag.bitwiseXOR(F.lit(32))).otherwise(flag))
    rname = F.when(F.col("own_ok"), F.col("own_target")).when(F.col("mate_ok"), F.col("mate_target")).otherwise("*")
    pos = F.when(F.col("own_ok"), F.col("own_pos")).when(F.col("mate_ok"), F.col("mate_pos")).otherwise(-1)
    rnext = F.when(F.col("mate_ok"), F.col("mate_target")).when(paired & F.col("own_ok"), F.col("own_target")).otherwise("*")
    pnext = F.when(F.col("mate_ok"), F.col("mate_pos")).when(paired & F.col("own_ok"), F.col("own_pos")).otherwise(-1)
    tlen = lift_tlen(F.col("lo"), F.col("tlen"), F.col("own_target") == F.col("mate_target"), own_turn | mate_turn, F.col("pos"), F.col("pnext"), F.col("own_pos"), F.col("mate_pos"))
    tlen = F.when(~paired, F.col("tlen")).otherwise(tlen)
    mapq = F.col("mapq") if keep_mapq else F.when(F.col("own_ok"), F.col("mapq")).otherwise(0)
    new = {"new_flag": flag, "new_rname": rname, "new_pos": pos.cast("long"), "new_mapq": mapq, "new_rnext": rnext, "new_pnext": pnext.cast("long"), "new_tlen": tlen.cast("long")}
    more = ["new_cigar"] if "new_cigar" in got.columns else []
    return got.select(*cols, "lo", "own_ok", "mate_ok", "own_strand", "mate_strand", *(c.alias(n) for n, c in new.items()), *more)


def lift_records(records: DataFrame, index: DataFrame, allowed: int = 0, keep_mapq: bool = False, contigs: DataFrame | None = None, ultima: bool = False) -> DataFrame:
    """SAM records (as ``sources.sam`` reads them) to whole lifted records, with id, and the original one as column original.

    SEQ and QUAL are turned where the strand changes, and back to the read's own
    strand where it is unmapped; NM and MD are dropped, as is MC where the mate
    isn't lifted; LO is added.
    """
    fields = records.columns
    rows = records.withColumn("id", F.monotonically_increasing_id()).withColumn("original", F.struct(*fields))
    mc = F.col("tags")["MC"]["value"]
    size = F.when(F.col("seq") == "*", 0).otherwise(F.length("seq")).cast("long")
    rows = rows.withColumn("l_qseq", size).withColumn("rlen", C.reference_length("cigar")).withColumn("mate_rlen", F.coalesce(F.when(mc.isNotNull(), C.reference_length(mc)), size))
    rows = rows.withColumn("rnext", F.when(F.col("rnext") == "=", F.col("rname")).otherwise(F.col("rnext")))
    got = lift_alignments(rows, index, allowed, keep_mapq, contigs)
    turn = F.when(F.col("own_ok"), ~F.col("own_strand")).otherwise(has("flag", 16))
    seq = F.when((F.col("seq") != "*") & turn, reverse_complement("seq")).otherwise(F.col("seq"))
    qual = F.when((F.col("qual") != "*") & turn, F.reverse("qual")).otherwise(F.col("qual"))
    lost = F.array(F.lit("NM"), F.lit("MD"))
    tags = F.map_filter("tags", lambda k, _: ~F.array_contains(lost, k) & ~((k == "MC") & has("flag", 1) & ~F.col("mate_ok")) & (k != "LO"))
    if ultima:
        tags = F.transform_values(tags, lambda k, v: F.when(k == "t0", F.struct(v["type"].alias("type"), F.reverse(v["value"]).alias("value"))).when(k == "tp", F.struct(v["type"].alias("type"), reversed_array(v["value"]).alias("value"))).otherwise(v))
    tags = F.map_concat(tags, F.map_from_arrays(F.array(F.lit("LO")), F.array(F.struct(F.lit("Z").alias("type"), F.col("lo").alias("value")))))
    new = {"qname": F.col("qname"), "seq": seq, "qual": qual, "tags": tags} | {c: F.col(f"new_{c}") for c in ("flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen")}
    return got.select("id", *(new[c].alias(c) for c in fields if c in new), "lo", "original")
