"""The library's queries over the test tables, each with its DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coordshift.functions import cigar as C
from coordshift.functions import sam as S
from coordshift.functions import md as M
from coordshift.functions import realign as R
from coordshift.operators import asof, chains, index, lift, overlap, pairs, route, summary, vcf
from coordshift.plans import fixtures as X
from coordshift.plans.fixtures import duck, frame

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def the_index(spark, sf) -> DataFrame:
    return index.build_index(index.chain_to_intervals(frame(spark, sf, X.BLOCKS)))


# --- index and points -------------------------------------------------------

@query(X.INTERVALS)
def chain_to_intervals(spark, sf):
    return index.chain_to_intervals(frame(spark, sf, X.BLOCKS))


_REACHING = f"SELECT contig, target, source_start, source_end + CASE WHEN source_start % 3 = 0 THEN 12 ELSE 0 END AS source_end FROM ({X.INTERVALS})"


@query(f"WITH n AS (SELECT *, lead(source_start) OVER (PARTITION BY contig ORDER BY source_start) AS next_start FROM ({_REACHING})) SELECT * FROM n WHERE source_end > next_start")
def interval_sanity(spark, sf):
    """Intervals of which every third reaches further, so that some overlap the next."""
    rows = index.chain_to_intervals(frame(spark, sf, X.BLOCKS)).withColumn("source_end", F.col("source_end") + F.when(F.col("source_start") % 3 == 0, 12).otherwise(0))
    return index.overlapping(rows.select("contig", "target", "source_start", "source_end"))


_SLOTS = """SELECT p.*, coalesce(a.idx, -1) AS sidx, CASE WHEN p.contig NOT IN (SELECT contig FROM ix) THEN -1 ELSE coalesce(e.idx, 0) END AS eidx
 FROM points p ASOF LEFT JOIN (SELECT contig, greatest(source_start, 1) AS k, idx FROM ix) a ON p.contig = a.contig AND p.pos >= a.k
 ASOF LEFT JOIN ix e ON p.contig = e.contig AND p.pos > e.source_end"""
_WITH = f"""ix AS ({X.INDEX}), nx AS (SELECT *, lead(source_start) OVER w AS n_start, lead(source_end) OVER w AS n_end, lead(strand) OVER w AS n_strand, lead(target) OVER w AS n_target, lead(off) OVER w AS n_off
 FROM ix WINDOW w AS (PARTITION BY contig ORDER BY idx)),
 tr AS (SELECT *, sum(CASE WHEN target = pt THEN 0 ELSE 1 END) OVER (PARTITION BY contig ORDER BY idx) AS run FROM (SELECT *, lag(target) OVER (PARTITION BY contig ORDER BY idx) AS pt FROM nx))"""
# clip and lifted place of points with slots (table sl), for a leftmost and a rightmost place
_LIFT = """SELECT sl.*, CASE WHEN sidx < 0 OR eidx < 0 OR sidx < eidx THEN -1
   WHEN sidx = eidx AND sidx <> 0 THEN {gap} WHEN s.run = e.run THEN 0 ELSE -1 END AS clip,
   CASE WHEN sidx >= 0 THEN s.target ELSE '*' END AS target, s.strand, s.off, s.source_start, s.source_end, s.n_start, s.n_end, s.n_strand, s.n_off
 FROM {sl} sl LEFT JOIN tr s ON sl.contig = s.contig AND sl.sidx = s.idx LEFT JOIN tr e ON sl.contig = e.contig AND sl.eidx = e.idx"""
_LEFT_GAP = "CASE WHEN s.n_start IS NULL OR s.n_target <> s.target THEN -1 ELSE abs(pos - s.n_start) + CASE WHEN s.n_strand THEN 0 ELSE 1 END END"
_RIGHT_GAP = "abs(pos - s.source_end) + CASE WHEN s.strand THEN 1 ELSE 0 END"
_PLACE = "CASE WHEN strand THEN pos + off ELSE -pos + off + source_start + source_end END"
_PLACE_LEFT = f"CASE WHEN sidx = eidx AND sidx <> 0 AND n_start IS NOT NULL THEN (CASE WHEN n_strand THEN pos + n_off ELSE -pos + n_off + n_start + n_end END) ELSE {_PLACE} END"


def _lifted(points: str, allowed: int, left: bool = True) -> str:
    place = f"{_PLACE_LEFT} + clip" if left else f"{_PLACE} - clip"
    lift_ = _LIFT.format(gap=_LEFT_GAP if left else _RIGHT_GAP, sl="sl")
    return f"WITH points AS ({points}), {_WITH}, sl AS ({_SLOTS}), lf AS ({lift_}) SELECT * EXCLUDE (strand, off, source_start, source_end, n_start, n_end, n_strand, n_off), CAST(CASE WHEN sidx > -1 AND eidx > -1 AND clip <= {allowed} THEN {place} ELSE -1 END AS BIGINT) AS lifted FROM lf"


@query(f"WITH points AS ({X.POINTS}), ix AS ({X.INDEX}) SELECT point_id, contig, pos, sidx + 1 AS rank FROM ({_SLOTS})")
def asof_start_rank(spark, sf):
    got = asof.slots(frame(spark, sf, X.POINTS), the_index(spark, sf))
    return got.select("point_id", "contig", "pos", (F.col("sidx") + 1).alias("rank"))


@query(f"WITH points AS ({X.POINTS}), ix AS ({X.INDEX}) {_SLOTS}")
def interval_indexes(spark, sf):
    return asof.slots(frame(spark, sf, X.POINTS), the_index(spark, sf)).drop("s", "e")


@query(f"SELECT point_id, CAST(clip AS BIGINT) AS clip FROM ({_lifted(X.POINTS, 10)})")
def clip_distance(spark, sf):
    return lift.lift_points(frame(spark, sf, X.POINTS), the_index(spark, sf), 10).select("point_id", "clip")


@query(f"SELECT point_id, contig, pos, lifted FROM ({_lifted(X.POINTS, 10)})")
def lift_position(spark, sf):
    return lift.lift_points(frame(spark, sf, X.POINTS), the_index(spark, sf), 10).select("point_id", "contig", "pos", "lifted")


@query(f"SELECT point_id, contig, pos, target FROM ({_lifted(X.POINTS, 10)})")
def lift_contig(spark, sf):
    return lift.lift_points(frame(spark, sf, X.POINTS), the_index(spark, sf), 10).select("point_id", "contig", "pos", "target")


_SPANS = """SELECT l_orderkey * 8 + l_linenumber AS id, concat('c', CAST(l_suppkey % 5 AS STRING)) AS contig, CAST((l_orderkey * 131) % 900 AS BIGINT) AS start_idx,
 CAST((l_orderkey * 131) % 900 + l_partkey % 6 AS BIGINT) AS end_idx, CAST((l_orderkey * 53) % 60000 AS BIGINT) AS pos FROM lineitem"""
_SPANS = f"SELECT DISTINCT * FROM ({_SPANS})"


def _stepped(allowed: int) -> str:
    """Table tb: intervals with the number of unfit steps before them."""
    return f"""tb AS (SELECT *, CAST(coalesce(sum(unfit) OVER (PARTITION BY contig ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS bad
 FROM (SELECT *, CASE WHEN n_start IS NULL OR (n_strand = strand AND n_target = target AND abs(n_off - off) <= {allowed}) THEN 0 ELSE 1 END AS unfit FROM tr))"""


@query(f"""WITH {_WITH}, {_stepped(5)}, sp AS ({_SPANS})
 SELECT sp.*, start_idx >= end_idx OR coalesce(a.bad = b.bad AND abs(b.off - a.off) <= 5, false) AS legal
 FROM sp LEFT JOIN tb a ON sp.contig = a.contig AND start_idx = a.idx LEFT JOIN tb b ON sp.contig = b.contig AND end_idx = b.idx""")
def multi_interval_legality(spark, sf):
    return lift.legal_spans(frame(spark, sf, _SPANS), the_index(spark, sf), 5)


@query(f"""WITH {_WITH}, sp AS ({_SPANS}), m AS (SELECT sp.id, sp.contig, sp.pos, start_idx, end_idx, string_agg(concat(CAST(source_end - pos AS STRING), ':', CAST(CASE WHEN strand THEN n_off - off ELSE (off + source_start + source_end) - (n_off + n_start + n_end) END AS STRING)), ',' ORDER BY idx) AS bps
 FROM (SELECT *, unnest(range(start_idx, end_idx + 1)) AS here FROM sp) sp JOIN nx ON sp.contig = nx.contig AND nx.idx = here AND n_target = target AND source_end > pos GROUP BY ALL) SELECT sp.*, coalesce(bps, '') AS bps FROM sp LEFT JOIN m USING (id, contig, pos, start_idx, end_idx)""")
def break_points(spark, sf):
    got = lift.break_points(frame(spark, sf, _SPANS), the_index(spark, sf))
    return got.withColumn("bps", F.array_join(F.transform("bps", lambda x: F.concat_ws(":", x["bp"].cast("string"), x["diff"].cast("string"))), ","))


# --- BED --------------------------------------------------------------------

def _bed_sql() -> str:
    keyed = f"SELECT *, row_number() OVER () AS rid FROM ({X.BED})"
    return f"""WITH bed AS ({keyed}), {_WITH},
 a AS (SELECT rid, target AS t1, lifted AS op1 FROM ({_lifted('SELECT rid, contig, bed_start AS pos FROM bed', 500)})),
 b AS (SELECT rid, target AS t2, lifted + 1 AS op2 FROM ({_lifted('SELECT rid, contig, bed_end - 1 AS pos FROM bed', 500, False)})),
 j AS (SELECT bed.*, t1, op1, t2, op2 FROM bed JOIN a USING (rid) JOIN b USING (rid)),
 k AS (SELECT *, NOT (op1 < 0 OR op2 < 0 OR op2 - op1 <= 0 OR t1 = '*' OR t2 = '*' OR t1 <> t2 OR op2 - op1 - (bed_end - 1) + bed_start > 500) AS ok FROM j)"""


@query(f"{_bed_sql()} SELECT l_orderkey, l_linenumber, l_partkey, t1 AS contig, op1 AS bed_start, op2 AS bed_end FROM k WHERE ok")
def lift_bed(spark, sf):
    got = lift.lift_bed(frame(spark, sf, X.BED), the_index(spark, sf)).where("ok")
    return got.select("l_orderkey", "l_linenumber", "l_partkey", F.col("t1").alias("contig"), F.col("op1").alias("bed_start"), F.col("op2").alias("bed_end"))


@query(f"{_bed_sql()} SELECT l_orderkey, l_linenumber, l_partkey, contig, bed_start, bed_end, concat('# ', t1, ':', CAST(op1 AS STRING), '-', t2, ':', CAST(op2 AS STRING)) AS note FROM k WHERE NOT ok")
def lift_bed_unmapped(spark, sf):
    got = lift.lift_bed(frame(spark, sf, X.BED), the_index(spark, sf)).where("not ok")
    note = F.concat(F.lit("# "), F.col("t1"), F.lit(":"), F.col("op1").cast("string"), F.lit("-"), F.col("t2"), F.lit(":"), F.col("op2").cast("string"))
    return got.select("l_orderkey", "l_linenumber", "l_partkey", "contig", "bed_start", "bed_end", note.alias("note"))


# --- interval algebra -------------------------------------------------------

_BEST = f"""WITH a AS ({X.REGIONS}), b AS ({X.MASK}), m AS (SELECT a.id, max(least(a."end", b."end") - greatest(a.start, b.start)) AS o FROM a JOIN b ON a.contig = b.contig AND a.start < b."end" AND b.start < a."end" GROUP BY a.id)
 SELECT a.id, coalesce({{}}, false) AS hit FROM a LEFT JOIN m USING (id)"""


@query(_BEST.format("o IS NOT NULL"))
def bed_overlap_any(spark, sf):
    return overlap.flag_overlaps(frame(spark, sf, X.REGIONS), frame(spark, sf, X.MASK)).select("id", "hit")


@query(_BEST.format('o >= (a."end" - a.start) * 0.5'))
def bed_overlap_frac(spark, sf):
    return overlap.flag_overlaps(frame(spark, sf, X.REGIONS), frame(spark, sf, X.MASK), 0.5).select("id", "hit")


@query(_BEST.format("o >= 10"))
def bed_overlap_bp(spark, sf):
    return overlap.flag_overlaps(frame(spark, sf, X.REGIONS), frame(spark, sf, X.MASK), 10).select("id", "hit")


_MERGE = """SELECT contig, min(start) AS start, max("end") AS "end" FROM (SELECT *, sum(n) OVER (PARTITION BY contig ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS run FROM
 (SELECT *, CASE WHEN start <= max("end") OVER (PARTITION BY contig ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM ({}))) GROUP BY contig, run"""


@query(_MERGE.format(X.MASK))
def interval_merge(spark, sf):
    return overlap.merge(frame(spark, sf, X.MASK))


@query(f"""WITH a AS ({X.REGIONS}), b AS ({X.MASK}) SELECT a.contig, greatest(a.start, b.start) AS start, least(a."end", b."end") AS "end" FROM a JOIN b ON a.contig = b.contig AND a.start < b."end" AND b.start < a."end" """)
def interval_intersect(spark, sf):
    return overlap.intersect(frame(spark, sf, X.REGIONS), frame(spark, sf, X.MASK))


@query(f"""WITH a AS ({X.REGIONS}), b AS ({_MERGE.format(X.MASK)}), c AS (SELECT a.*, greatest(a.start, b.start) AS os, least(a."end", b."end") AS oe FROM a JOIN b ON a.contig = b.contig AND a.start < b."end" AND b.start < a."end"),
 p AS (SELECT id, contig, start AS s, os AS e FROM (SELECT id, contig, coalesce(lag(oe) OVER (PARTITION BY id ORDER BY os), start) AS start, os FROM c) UNION ALL SELECT id, contig, max(oe), any_value("end") FROM c GROUP BY id, contig
 UNION ALL SELECT id, contig, start, "end" FROM a WHERE id NOT IN (SELECT id FROM c)) SELECT id, contig, s AS start, e AS "end" FROM p WHERE e > s""")
def interval_subtract(spark, sf):
    return overlap.subtract(frame(spark, sf, X.REGIONS), frame(spark, sf, X.MASK))


_GRAPH = 'SELECT concat(\'c\', CAST(o_orderkey % 4 AS STRING)) AS contig, CAST(o_orderkey * 10 AS BIGINT) AS start, CAST(o_orderkey * 10 + 10 AS BIGINT) AS "end", (o_orderkey // 20) % 3 <> 0 AS mappable FROM orders'


@query(f"""WITH g AS ({_GRAPH}), f AS (SELECT *, CASE WHEN lag(mappable) OVER w = mappable THEN 0 ELSE 1 END AS n FROM g WINDOW w AS (PARTITION BY contig ORDER BY start)),
 r AS (SELECT contig, run, mappable, min(start) AS start, max(start) AS last FROM (SELECT *, sum(n) OVER (PARTITION BY contig ORDER BY start) AS run FROM f) GROUP BY ALL),
 l AS (SELECT *, lag(start) OVER w AS before, lead(start) OVER w AS after FROM r WINDOW w AS (PARTITION BY contig ORDER BY run)),
 o AS (SELECT contig, greatest(start, coalesce(before + 50, 0)) AS start, CASE WHEN after IS NOT NULL THEN after WHEN contig = (SELECT max(contig) FROM g) THEN last + 50 END AS "end" FROM l WHERE mappable
 UNION ALL SELECT contig, 0, start FROM l WHERE NOT mappable AND before IS NULL) SELECT * FROM o WHERE "end" > start""")
def mappable_islands(spark, sf):
    return overlap.mappable_islands(frame(spark, sf, _GRAPH.replace("//", "div")), 50)


@query(f'SELECT contig, start, "end" FROM ({X.MASK}) WHERE "end" - start >= 20')
def bed_size_filter(spark, sf):
    return frame(spark, sf, X.MASK).where("end - start >= 20").select("contig", "start", "end")


# --- alignments -------------------------------------------------------------

_RLEN = "list_sum(list_transform(regexp_extract_all(cigar, '([0-9]+)[MDN=X]', 1), lambda x: CAST(x AS BIGINT)))"
_QLEN = "list_sum(list_transform(regexp_extract_all(cigar, '([0-9]+)[MIS=X]', 1), lambda x: CAST(x AS BIGINT)))"


@query(f"SELECT id, CAST({_RLEN} AS BIGINT) AS rlen, CAST({_QLEN} AS BIGINT) AS qlen FROM ({X.ALN})")
def cigar_lengths(spark, sf):
    return frame(spark, sf, X.ALN).select("id", C.reference_length("cigar").alias("rlen"), C.query_length("cigar").alias("qlen"))


@query(f"SELECT id, CAST(unnest(regexp_extract_all(cigar, '([0-9]+)[A-Z=]', 1)) AS BIGINT) AS len, unnest(regexp_extract_all(cigar, '[0-9]+([A-Z=])', 1)) AS op FROM ({X.ALN})")
def cigar_parse(spark, sf):
    return frame(spark, sf, X.ALN).select("id", F.explode(C.parse("cigar")).alias("r")).select("id", "r.len", "r.op")


@query(f"SELECT id, CAST(round(CAST(1 - CAST({_RLEN} AS FLOAT) / CAST(l_qseq AS FLOAT) AS DOUBLE), 4) AS DOUBLE) AS clipped FROM ({X.ALN})")
def clipped_fraction(spark, sf):
    return frame(spark, sf, X.ALN).select("id", F.round(C.clipped_fraction("cigar", "l_qseq").cast("double"), 4).alias("clipped"))


@query(f"""WITH a AS (SELECT id, translate(cigar, '=X', 'MM') AS c FROM ({X.ALN})), p AS (SELECT id, unnest(range(len(ns))) AS k, unnest(ns) AS n, unnest(os) AS op FROM (SELECT id, regexp_extract_all(c, '([0-9]+)[A-Z]', 1) AS ns, regexp_extract_all(c, '[0-9]+([A-Z])', 1) AS os FROM a)),
 r AS (SELECT *, sum(fresh) OVER (PARTITION BY id ORDER BY k) AS run FROM (SELECT *, CASE WHEN lag(op) OVER (PARTITION BY id ORDER BY k) = op THEN 0 ELSE 1 END AS fresh FROM p)),
 m AS (SELECT id, run, any_value(op) AS op, sum(CAST(n AS BIGINT)) AS n FROM r GROUP BY id, run) SELECT id, string_agg(concat(CAST(n AS STRING), op), '' ORDER BY run) AS cigar FROM m GROUP BY id""")
def cigar_normalize(spark, sf):
    return frame(spark, sf, X.ALN).select("id", C.plain("cigar").alias("cigar"))


@query(duck(f"SELECT doc_id, translate(reverse(seq), 'ACGTN', 'TGCAN') AS seq FROM ({X.SEQ})"))
def reverse_complement(spark, sf):
    return frame(spark, sf, X.SEQ).select("doc_id", S.reverse_complement("seq").alias("seq"))


@query(f"SELECT id, CAST((flag | 4) & ~18 AS INT) AS own, CAST((flag | 8) & ~34 AS INT) AS mate, flag & 3840 = 0 AS is_primary FROM ({X.ALN})")
def flag_unmap(spark, sf):
    return frame(spark, sf, X.ALN).select("id", S.unmap_self("flag").alias("own"), S.unmap_mate("flag").alias("mate"), S.primary("flag").alias("is_primary"))


@query(f"SELECT id, CAST(coalesce(CASE WHEN id % 4 = 0 THEN NULL ELSE {_RLEN} END, l_qseq) AS BIGINT) AS n FROM ({X.ALN})")
def mate_ref_len(spark, sf):
    mc = F.when(F.col("id") % 4 != 0, C.reference_length("cigar"))
    return frame(spark, sf, X.ALN).select("id", F.coalesce(mc, F.col("l_qseq")).cast("long").alias("n"))


@query(duck(f"SELECT doc_id, reverse(substring(seq, 1, 20)) AS t0, array_to_string(list_reverse([len(seq), 1, 2]), ',') AS tp FROM ({X.SEQ})"))
def ultima_tags(spark, sf):
    rows = frame(spark, sf, X.SEQ).select("doc_id", F.substring("seq", 1, 20).alias("t0"), F.array(F.length("seq"), F.lit(1), F.lit(2)).alias("tp"))
    tp, t0 = S.ultima_tags("tp", "t0")
    return rows.select("doc_id", t0.alias("t0"), F.array_join(tp.cast("array<string>"), ",").alias("tp"))


@query(f"SELECT id, CASE WHEN lo = 'L_L' AND tlen <> 0 THEN CASE WHEN flag & 16 <> 0 THEN -(tlen + (pnext - pos) + (np - p)) ELSE tlen + (pnext - pos) - (np - p) END ELSE 0 END AS tlen FROM (SELECT *, CASE WHEN flag & 12 = 0 THEN 'L_L' ELSE 'L_UM' END AS lo, pos + 5 AS p, pnext + 9 AS np FROM ({X.ALN}))")
def tlen_lift(spark, sf):
    rows = frame(spark, sf, X.ALN)
    lo = F.when(~S.has("flag", 12), "L_L").otherwise("L_UM")
    return rows.select("id", lift.lift_tlen(lo, F.col("tlen"), F.lit(True), S.has("flag", 16), F.col("pos"), F.col("pnext"), F.col("pos") + 5, F.col("pnext") + 9).alias("tlen"))


_ALN_LIFT = f"SELECT id, flag, rname, pos, mapq, tlen, rname AS rnext, pnext, CAST(100 AS BIGINT) AS mate_rlen, cigar, l_qseq FROM ({X.ALN})"


def _slots_of(points: str) -> str:
    return _SLOTS.replace("FROM points p", f"FROM ({points}) p")


def _end_sql(n: str, pos: str, size: str, own: bool) -> str:
    """Tables f<n> (first place), g<n> (end) and h<n>: id, ok, target, strand, place of one end of a pair; 10 bases may change."""
    gap = lambda g: f"CASE WHEN p.sidx < 0 OR p.eidx < 0 OR p.sidx < p.eidx THEN -1 WHEN p.sidx = p.eidx AND p.sidx <> 0 THEN {g} WHEN s.run = e.run THEN 0 ELSE -1 END"
    next_ = "p.sidx = p.eidx AND p.sidx <> 0 AND s.n_start IS NOT NULL"
    pick = ", ".join(f"CASE WHEN {next_} THEN s.{a} ELSE s.{b} END AS {b}" for a, b in (("n_target", "target"), ("n_strand", "strand"), ("n_off", "off"), ("n_start", "source_start"), ("n_end", "source_end")))
    clips = "AND g.cut >= 0 AND f.clip + g.cut <= 10" if own else ""
    more = ("greatest(f.clip, 0)", "greatest(g.cut, 0)") if own else ("0", "0")
    joins = "LEFT JOIN tb s ON p.contig = s.contig AND p.sidx = s.idx LEFT JOIN tb e ON p.contig = e.contig AND p.eidx = e.idx"
    return f"""f{n} AS (SELECT p.id, p.pos, p.eidx, CASE WHEN {next_} THEN p.sidx + 1 ELSE p.sidx END AS i, {gap(_LEFT_GAP)} AS clip, {pick}, CASE WHEN {next_} THEN s.bad + s.unfit ELSE s.bad END AS bad FROM ({_slots_of(f"SELECT id, rname AS contig, {pos} AS pos FROM a")}) p {joins}),
 g{n} AS (SELECT p.id, p.pos, p.sidx, p.eidx, {gap(_RIGHT_GAP)} AS cut, s.strand, s.off, s.source_start, s.source_end, s.bad FROM ({_slots_of(f"SELECT id, rname AS contig, {pos} + {size} AS pos FROM a")}) p {joins}),
 k{n} AS (SELECT f.id, f.target, f.strand, f.i >= 0 AND f.eidx >= 0 AND f.clip BETWEEN 0 AND 10 AND g.sidx >= 0 AND g.eidx >= 0 {clips} AND (f.i >= g.sidx OR (f.bad = g.bad AND abs(g.off - f.off) <= 10)) AS fits,
 CASE WHEN f.strand THEN f.pos + f.off + {more[0]} WHEN g.strand THEN g.pos + g.off + {more[1]} ELSE -g.pos + g.off + g.source_start + g.source_end + {more[1]} END AS place FROM f{n} f JOIN g{n} g USING (id)),
 h{n} AS (SELECT id, target, strand, place, coalesce(fits AND place >= 0, false) AS ok FROM k{n})"""


_STATUS = f"""WITH {_WITH}, {_stepped(10)}, a AS (SELECT *, CAST({_RLEN} AS BIGINT) AS rlen FROM ({_ALN_LIFT})), {_end_sql('1', 'pos', 'rlen', True)}, {_end_sql('2', 'pnext', 'mate_rlen', False)},
 j AS (SELECT a.*, h1.ok AND flag & 4 = 0 AS o, h2.ok AND flag & 8 = 0 AS m, h1.target AS t1, h1.strand AS s1, h1.place AS p1, h2.target AS t2, h2.strand AS s2, h2.place AS p2 FROM a JOIN h1 USING (id) JOIN h2 USING (id)),
 x AS (SELECT *, CASE WHEN o THEN CASE WHEN s1 THEN flag ELSE xor(flag, 16) END ELSE (flag | 4) & ~18 END AS fl FROM j)
 SELECT id, concat(CASE WHEN o THEN 'L' ELSE 'UM' END, '_', CASE WHEN m THEN 'L' ELSE 'UM' END) AS lo,
 CAST(CASE WHEN m THEN CASE WHEN s2 THEN fl ELSE xor(fl, 32) END ELSE (fl | 8) & ~34 END AS INT) AS new_flag,
 CASE WHEN o THEN t1 WHEN m THEN t2 ELSE '*' END AS new_rname, CAST(CASE WHEN o THEN p1 WHEN m THEN p2 ELSE -1 END AS BIGINT) AS new_pos, CAST(CASE WHEN o THEN mapq ELSE 0 END AS INT) AS new_mapq,
 CASE WHEN m THEN t2 WHEN o THEN t1 ELSE '*' END AS new_rnext, CAST(CASE WHEN m THEN p2 WHEN o THEN p1 ELSE -1 END AS BIGINT) AS new_pnext,
 CAST(CASE WHEN o AND m AND tlen <> 0 AND t1 = t2 THEN CASE WHEN s1 AND s2 THEN tlen + (pnext - pos) - (p2 - p1) ELSE -(tlen + (pnext - pos) + (p2 - p1)) END ELSE 0 END AS BIGINT) AS new_tlen FROM x"""


def _to_lift(spark, sf) -> DataFrame:
    return frame(spark, sf, _ALN_LIFT).withColumn("rlen", C.reference_length("cigar"))


@query(_STATUS)
def lift_alignment_status(spark, sf):
    return lift.lift_alignments(_to_lift(spark, sf).drop("cigar"), the_index(spark, sf), 10).select("id", "lo", "new_flag", "new_rname", "new_pos", "new_mapq", "new_rnext", "new_pnext", "new_tlen")


@query()
def cigar_lift(spark, sf):
    """Lifted CIGARs of all reads, those over gaps and with clips included."""
    return lift.lift_segments(_to_lift(spark, sf), the_index(spark, sf), 10).where("own_ok").select("id", F.col("new_cigar").alias("cigar"))


@query(f"""WITH {_WITH}, {_stepped(10)}, a AS (SELECT *, CAST({_RLEN} AS BIGINT) AS rlen FROM ({_ALN_LIFT})), {_end_sql('1', 'pos', 'rlen', True)},
 e AS (SELECT a.id, a.cigar, f1.strand FROM a JOIN f1 USING (id) JOIN g1 USING (id) JOIN h1 USING (id) WHERE h1.ok AND flag & 4 = 0 AND clip = 0 AND cut = 0 AND i = sidx),
 p AS (SELECT id, strand, unnest(range(len(ns))) AS k, unnest(ns) AS n, unnest(os) AS op FROM (SELECT id, strand, regexp_extract_all(translate(cigar, '=X', 'MM'), '([0-9]+)[A-Z]', 1) AS ns, regexp_extract_all(translate(cigar, '=X', 'MM'), '[0-9]+([A-Z])', 1) AS os FROM e)),
 r AS (SELECT *, sum(fresh) OVER (PARTITION BY id ORDER BY k) AS run FROM (SELECT *, CASE WHEN lag(op) OVER (PARTITION BY id ORDER BY k) = op THEN 0 ELSE 1 END AS fresh FROM p)),
 m AS (SELECT id, strand, run, any_value(op) AS op, sum(CAST(n AS BIGINT)) AS n FROM r GROUP BY id, strand, run) SELECT id, string_agg(concat(CAST(n AS STRING), op), '' ORDER BY CASE WHEN strand THEN run ELSE -run END) AS cigar FROM m GROUP BY id""")
def cigar_lift_inside(spark, sf):
    """Lifted CIGARs of the reads that lie in one interval."""
    aln, ix = _to_lift(spark, sf), asof.prepared(asof.with_steps(the_index(spark, sf), 10))
    ends = asof.slots(asof.slots(aln, ix, "rname", "pos").select(*aln.columns, F.col("sidx").alias("i"), F.col("eidx").alias("u"), (F.col("pos") + F.col("rlen")).alias("stop")), ix, "rname", "stop")
    inside = ends.where("i = sidx and not (i = u and i <> 0) and not (sidx = eidx and sidx <> 0)").select(*aln.columns)
    return lift.lift_segments(inside, ix, 10).where("own_ok").select("id", F.col("new_cigar").alias("cigar"))


_RULES = {"lifted": None, "mapq": 20.0, "isize": 600.0, "hdist": 6.0, "aln_score": 50.0}
_FRAC = f"CAST(1 - CAST({_RLEN} AS FLOAT) / CAST(l_qseq AS FLOAT) AS FLOAT)"
_ROUTE = f"""WITH a AS (SELECT *, {_FRAC} AS clipped_frac FROM ({X.ALN})), m AS (SELECT contig, start, "end" FROM ({X.MASK})),
 h AS (SELECT DISTINCT a.id FROM a JOIN m ON a.rname = m.contig AND a.pos < m."end" AND m.start < a.pos + 100),
 d AS (SELECT a.*, h.id IS NOT NULL AS hit, CASE WHEN flag & 4 <> 0 THEN false WHEN mapq < 20 THEN false WHEN as_score < 50 THEN false WHEN tlen = 0 OR abs(tlen) > 600 THEN false WHEN nm > 6 THEN false ELSE true END AS d FROM a LEFT JOIN h ON a.id = h.id),
 r AS (SELECT *, flag & 4 = 0 AND hit AS s FROM d)"""


def _routed(spark, sf):
    aln = frame(spark, sf, X.ALN).withColumn("clipped_frac", C.clipped_fraction("cigar", "l_qseq")).withColumn("contig", F.col("rname")).withColumn("start", F.col("pos")).withColumn("end", F.col("pos") + 100)
    aln = overlap.flag_overlaps(aln, frame(spark, sf, X.MASK))
    return route.route(aln, route.keep_lifted(_RULES), route.keep_original("flag", F.col("hit")))


@query(f"{_ROUTE} SELECT id FROM r WHERE d OR s")
def route_committed(spark, sf):
    return _routed(spark, sf).where("committed").select("id")


@query(f"{_ROUTE} SELECT id FROM r WHERE NOT d AND NOT s AND flag & 3840 = 0")
def route_deferred(spark, sf):
    return _routed(spark, sf).where("deferred").select("id")


@query(f"{_ROUTE} SELECT id FROM r WHERE NOT d")
def route_unliftable(spark, sf):
    return _routed(spark, sf).where("unliftable").select("id")


# --- reconcile and collate --------------------------------------------------

_SINGLE = f"(SELECT * FROM ({X.RECON}) WHERE segment = 1)"


@query(f"""WITH s AS (SELECT *, CASE WHEN flag & 4 <> 0 THEN -2147483648 ELSE -nm END AS score FROM {_SINGLE}),
 r AS (SELECT *, row_number() OVER (PARTITION BY qname ORDER BY score DESC, mapq DESC, label) AS k, rank() OVER (PARTITION BY qname ORDER BY score DESC, mapq DESC) AS t FROM s)
 SELECT qname, label, mapq, CAST(score AS BIGINT) AS score, CAST(n AS BIGINT) AS n_tied FROM (SELECT *, sum(CASE WHEN t = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY qname) AS n FROM r) WHERE k = 1""")
def reconcile_single(spark, sf):
    rows = frame(spark, sf, X.RECON).where("segment = 1")
    return pairs.reconcile_single(rows).select("qname", "label", "mapq", "score", "n_tied")


@query(f"""WITH s AS (SELECT qname, label, bool_or(segment = 1 AND tlen <> 0) AS proper, CAST(sum(CASE WHEN flag & 4 <> 0 THEN -1073741824 ELSE -nm END) AS BIGINT) AS score, CAST(sum(mapq) AS BIGINT) AS mapq FROM ({X.RECON}) GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY qname ORDER BY proper DESC, score DESC, mapq DESC, label) AS k, rank() OVER (PARTITION BY qname ORDER BY proper DESC, score DESC, mapq DESC) AS t FROM s)
 SELECT qname, label, proper, score, mapq, CAST(n AS BIGINT) AS n_tied FROM (SELECT *, sum(CASE WHEN t = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY qname) AS n FROM r) WHERE k = 1""")
def reconcile_paired(spark, sf):
    return pairs.reconcile_paired(frame(spark, sf, X.RECON)).select("qname", "label", "proper", "score", "mapq", "n_tied")


@query(f"SELECT qname, label, segment, min(mapq) OVER (PARTITION BY qname, segment) AS least_mapq FROM ({X.RECON})")
def reconcile_conservative(spark, sf):
    return pairs.conservative_mapq(frame(spark, sf, X.RECON)).select("qname", "label", "segment", "least_mapq")


_READS = """SELECT concat('r', CAST(o_orderkey // 2 AS STRING)) AS qname, CAST(CASE WHEN o_orderkey % 2 = 0 THEN 65 ELSE 129 END + CASE WHEN o_orderkey % 17 = 0 THEN 256 ELSE 0 END AS INT) AS flag,
 concat('s', CAST(o_orderkey AS STRING)) AS seq, o_orderkey AS id, o_orderkey % 5 < 2 AS is_deferred FROM orders"""


def _reads(spark, sf):
    return frame(spark, sf, _READS.replace("//", "div"))


@query(f"SELECT qname, min(CASE WHEN flag & 128 = 0 THEN seq END) AS r1, min(CASE WHEN flag & 128 <> 0 THEN seq END) AS r2 FROM ({_READS}) WHERE is_deferred AND flag & 3840 = 0 GROUP BY qname")
def collate_pairs(spark, sf):
    return pairs.deferred_pairs(_reads(spark, sf).where("is_deferred"))


@query(f"""WITH x AS ({_READS}), a AS (SELECT qname FROM x WHERE is_deferred AND flag & 3840 = 0 GROUP BY qname HAVING count(DISTINCT flag & 128) = 1)
 SELECT id, CASE WHEN a.qname IS NULL THEN 'committed' WHEN flag & 3840 = 0 THEN 'deferred' ELSE 'dropped' END AS outcome FROM x LEFT JOIN a USING (qname) WHERE NOT is_deferred""")
def collate_committed(spark, sf):
    rows = _reads(spark, sf)
    return pairs.collate_committed(rows.where("not is_deferred"), rows.where("is_deferred")).select("id", "outcome")


@query(f"WITH x AS ({_READS}) SELECT id, flag & 3840 = 0 AND qname IN (SELECT qname FROM x WHERE is_deferred) AS to_fastq FROM x")
def mate_extract(spark, sf):
    rows = _reads(spark, sf)
    return pairs.extract_mates(rows, rows.where("is_deferred")).select("id", "to_fastq")


@query(f"SELECT qname, CAST(sum(CASE WHEN flag & 256 = 0 AND flag & 1 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS n FROM ({_READS}) GROUP BY qname HAVING n < 2 OR n > 2")
def qname_count_outside(spark, sf):
    return pairs.count_outside(_reads(spark, sf), S.passes_flags("flag", [1], [256]), 2, 2)


# --- summaries --------------------------------------------------------------

@query(f"""WITH s AS (SELECT as_score AS v, row_number() OVER (ORDER BY as_score) AS k, count(*) OVER () AS n FROM ({X.ALN}) WHERE flag & 2308 = 0), q AS (SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.95])::DOUBLE AS q)
 SELECT q, v AS value FROM q JOIN s ON k = CASE WHEN CAST(floor(n * q) AS BIGINT) = 0 THEN n ELSE CAST(floor(n * q) AS BIGINT) END""")
def feature_quantiles(spark, sf):
    return summary.exact_quantiles(frame(spark, sf, X.ALN).where("flag & 2308 = 0"), "as_score", [0.05, 0.25, 0.5, 0.75, 0.95])


_BASELINE = f"""SELECT qname, id, CAST(CASE WHEN id % 29 = 0 THEN flag | 4 ELSE flag END AS INT) AS flag, CASE WHEN id % 31 = 0 THEN 'c9' ELSE rname END AS rname, CAST(CASE WHEN id % 7 = 0 THEN pos + 1 ELSE pos END AS BIGINT) AS pos,
 CAST(CASE WHEN id % 3 = 0 THEN mapq + 1 WHEN id % 37 = 0 THEN 255 ELSE mapq END AS INT) AS mapq, CASE WHEN id % 4 = 0 THEN '100M' ELSE cigar END AS cigar, CAST(tlen + CASE WHEN id % 5 = 0 THEN 60 ELSE 0 END AS BIGINT) AS tlen FROM ({X.ALN})"""


def _runs_sql(cigar: str, pos: str) -> str:
    """Runs of a CIGAR with their place in the read and diagonal."""
    size = lambda ops: f"coalesce(sum(CASE WHEN op IN ({ops}) THEN n ELSE 0 END) OVER (PARTITION BY id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    q, r = "'M', 'I', 'S', '=', 'X'", "'M', 'D', 'N', '=', 'X'"
    return f"""SELECT id, op, n, q, {pos} + r - q AS d FROM (SELECT *, {size(q)} AS q, {size(r)} AS r FROM (SELECT id, {pos}, unnest(range(len(ns))) AS k, CAST(unnest(ns) AS BIGINT) AS n, unnest(os) AS op
 FROM (SELECT id, {pos}, regexp_extract_all({cigar}, '([0-9]+)[A-Z=]', 1) AS ns, regexp_extract_all({cigar}, '[0-9]+([A-Z=])', 1) AS os FROM j))) WHERE op IN ({q})"""


_COMPARED = f"""WITH a AS (SELECT * FROM ({X.ALN}) WHERE flag & 2304 = 0), b AS (SELECT * FROM ({_BASELINE}) WHERE flag & 2304 = 0),
 j AS (SELECT a.id, a.rname, a.pos, a.mapq, a.cigar, a.tlen, a.flag, b.rname AS brname, b.pos AS bpos, b.mapq AS bmapq, b.cigar AS bcigar, b.tlen AS btlen, b.flag AS bflag FROM a JOIN b USING (id)),
 x AS ({_runs_sql('cigar', 'pos')}), y AS ({_runs_sql('bcigar', 'bpos')}),
 o AS (SELECT x.id, sum(greatest(0, least(x.q + x.n, y.q + y.n) - greatest(x.q, y.q))) AS same FROM x JOIN y ON x.id = y.id AND x.op = y.op AND x.d = y.d GROUP BY x.id),
 s AS (SELECT j.*, flag & 4 <> 0 AS qu, bflag & 4 <> 0 AS bu, mapq = 255 OR mapq < 5 AS ql, bmapq = 255 OR bmapq < 5 AS bl, CASE WHEN rname <> brname THEN 0.0 WHEN pos = bpos AND cigar = bcigar THEN 1.0 ELSE coalesce(CAST(same AS DOUBLE), 0.0) / 100 END AS idy FROM j LEFT JOIN o USING (id)),
 t AS (SELECT *, NOT qu AND NOT bu AND NOT ql AND NOT bl AS fine, qu OR bu AS un, rname = brname AND abs(pos - bpos) < 1 AS near FROM s)"""
_N = "CAST(coalesce(sum(CASE WHEN {} THEN 1 ELSE 0 END), 0) AS BIGINT) AS {}".format
_COUNTS = ", ".join(_N(c, n) for c, n in (("fine", "n"), ("fine AND near", "n_pos"), ("fine AND idy >= 0.8", "n_identity"), ("fine AND (near OR idy >= 0.8)", "n_pos_or_identity"), ("fine AND mapq = bmapq", "n_mapq"), ("fine AND cigar = bcigar", "n_cigar"), ("fine AND rname = brname AND abs(tlen - btlen) <= 50", "n_tlen"), ("qu", "query_unmapped"), ("bu", "baseline_unmapped"), ("un", "n_unmapped"), ("NOT un AND ql", "query_invalid"), ("NOT un AND bl", "baseline_invalid"), ("NOT un AND (ql OR bl)", "n_invalid")))


def _compared_inputs(spark, sf):
    return (summary.alignments_by_read(frame(spark, sf, sql)) for sql in (X.ALN, _BASELINE))


@query(f"{_COMPARED} SELECT {_COUNTS}, round(avg(CASE WHEN fine THEN idy END), 6) AS mean_identity FROM t")
def sam_compare_summary(spark, sf):
    return summary.compare_alignments(*_compared_inputs(spark, sf), least_mapq=5)


@query(f"{_COMPARED} SELECT id, idy AS identity FROM t WHERE fine")
def cigar_identity(spark, sf):
    a, b = _compared_inputs(spark, sf)
    return summary.compared(a, b, 5).where("state = 'compared'").select(F.substring("qname", 2, 20).cast("long").alias("id"), "identity")


@query(f"{_COMPARED} SELECT concat('r', CAST(id AS STRING)) AS qname, idy AS identity FROM t WHERE fine AND cigar <> bcigar ORDER BY 1 LIMIT 10")
def first_cigar_errors(spark, sf):
    """A report of the first ten reads whose CIGARs differ."""
    return summary.first_errors(summary.compared(*_compared_inputs(spark, sf), 5), "cigar", 10).select("qname", "identity")


_TESTED = f"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN reverse(seq) ELSE seq END AS seq FROM ({X.SEQ})"


@query(duck(f"""WITH g AS (SELECT doc_id // 2 AS name, min(CASE WHEN doc_id % 2 = 0 THEN substring(seq, 1, 50) END) AS s1, min(CASE WHEN doc_id % 2 = 1 THEN substring(seq, 1, 50) END) AS s2 FROM ({X.SEQ}) GROUP BY 1), t AS (SELECT doc_id // 2 AS name, substring(seq, 1, 50) AS k FROM ({_TESTED})),
 c AS (SELECT coalesce(k = s1, false) AS a, coalesce(k = s2, false) AS b FROM t LEFT JOIN g USING (name)) SELECT CASE WHEN a AND b THEN 'both' WHEN a THEN 'read1' WHEN b THEN 'read2' ELSE 'none' END AS category, count(*) AS n FROM c GROUP BY 1"""))
def fastq_compare(spark, sf):
    """Reads of which every third is turned, against the reads themselves."""
    named = lambda sql: frame(spark, sf, sql).withColumn("name", F.expr("doc_id div 2")).withColumn("segment", F.expr("doc_id % 2 + 1"))
    return summary.compare_reads(named(X.SEQ), named(_TESTED))


@query(f"SELECT chain_id, CAST(sum(len) AS BIGINT) AS bases, count(*) AS blocks FROM ({X.BLOCKS}) GROUP BY chain_id")
def chain_totals(spark, sf):
    return frame(spark, sf, X.BLOCKS).groupBy("chain_id").agg(F.sum("len").alias("bases"), F.count("*").alias("blocks"))


@query(f"SELECT target AS contig, CAST(200000000 AS BIGINT) AS s_len, contig AS target, strand, source_start + off AS source_start, source_end + off AS source_end, -off AS off FROM ({X.INTERVALS})")
def chain_invert(spark, sf):
    return index.chain_to_intervals(chains.invert(frame(spark, sf, X.BLOCKS)))


# chains of the even ids keep their contig's name
_NAMED = X.BLOCKS.replace("concat('d', CAST((o_custkey + o_orderkey % 2) % 5 AS STRING))", "concat('c', CAST((o_custkey + o_orderkey % 2) % 5 AS STRING))")


@query(f"""WITH b AS (SELECT *, max(line_no) OVER (PARTITION BY chain_id) AS top, coalesce(sum(len + ds) OVER (PARTITION BY chain_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ({_NAMED}) WHERE s_name = d_name),
 p AS (SELECT chain_id, s_name AS contig, s_start + before AS a, s_start + before + len AS z FROM b WHERE line_no < top), r AS (SELECT *, CASE WHEN a = lag(z) OVER (PARTITION BY chain_id ORDER BY a) THEN 0 ELSE 1 END AS fresh FROM p),
 g AS (SELECT *, sum(fresh) OVER (PARTITION BY chain_id ORDER BY a) AS run FROM r) SELECT chain_id, contig, CAST(min(a) AS BIGINT) AS start, CAST(max(z) AS BIGINT) AS "end" FROM g GROUP BY chain_id, contig, run""")
def chain_to_bed(spark, sf):
    return chains.to_bed(frame(spark, sf, _NAMED))


# a place in both genomes goes on by len, then by the gap of each; only a net gap is written
@query(f"""WITH b AS (SELECT *, line_no = max(line_no) OVER (PARTITION BY chain_id) AS final, line_no = min(line_no) OVER (PARTITION BY chain_id) AS head FROM ({_NAMED})), c AS (SELECT *, CASE WHEN final THEN 0 ELSE ds END AS t, CASE WHEN final THEN 0 ELSE dd END AS q FROM b),
 w AS (SELECT *, s_start + 1 + sum(len + t) OVER o - t AS tp, d_start + 1 + sum(len + q) OVER o - q AS qp, sum(len + t) OVER (PARTITION BY chain_id) AS ts, sum(len + q) OVER (PARTITION BY chain_id) AS qs FROM c WINDOW o AS (PARTITION BY chain_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)),
 h AS (SELECT *, CASE WHEN s_name = d_name THEN s_start - d_start ELSE ts - qs END AS net FROM w WHERE head)
 SELECT chain_id, d_name AS contig, CAST(qp AS BIGINT) AS pos, repeat('A', CAST(CASE WHEN q > t THEN q - t ELSE 0 END + 1 AS BIGINT)) AS ref, repeat('A', CAST(CASE WHEN t > q THEN t - q ELSE 0 END + 1 AS BIGINT)) AS alt, concat('TPOS=', CAST(tp AS STRING), ';ALN_DT=', CAST(t AS STRING), ';ALN_DQ=', CAST(q AS STRING)) AS info FROM w WHERE NOT final AND t <> q
 UNION ALL SELECT chain_id, d_name, CAST(d_start + 1 - CASE WHEN s_name <> d_name AND net < 0 THEN qs ELSE 0 END AS BIGINT), repeat('A', CAST(CASE WHEN net < 0 THEN -net ELSE 0 END + 1 AS BIGINT)), repeat('A', CAST(CASE WHEN net > 0 THEN net ELSE 0 END + 1 AS BIGINT)), concat('TPOS=', CAST(s_start + 1 AS STRING)) FROM h WHERE net <> 0""")
def chain_to_vcf(spark, sf):
    return chains.to_vcf(frame(spark, sf, _NAMED))


# three blocks a document, from its letters to a changed copy: turned for odd ones
_PAIRED = f"SELECT doc_id, seq AS a, CASE WHEN doc_id % 2 = 0 THEN translate(seq, 'A', 'C') ELSE translate(reverse(seq), 'ACGTN', 'TGCAN') END AS b FROM ({X.SEQ}) WHERE length(seq) >= 80"
_TRIPLE = " UNION ALL ".join(f"SELECT doc_id AS chain_id, CAST({i} AS BIGINT) AS line_no, concat('a', CAST(doc_id AS STRING)) AS s_name, CAST(length(a) AS BIGINT) AS s_len, CAST(3 AS BIGINT) AS s_start, concat('b', CAST(doc_id AS STRING)) AS d_name, CAST(length(b) AS BIGINT) AS d_len, CAST(3 AS BIGINT) AS d_start, doc_id % 2 = 0 AS strand, CAST(15 AS BIGINT) AS len, CAST({ds} AS BIGINT) AS ds, CAST({dd} AS BIGINT) AS dd FROM ({_PAIRED})" for i, (ds, dd) in enumerate(((2, 2), (1, 3), ("NULL", "NULL"))))
_ALIKE = f"""WITH p AS ({_PAIRED}), k AS (SELECT doc_id, a, b, length(b) AS n, unnest([0, 1, 2]) AS line_no, unnest([3, 20, 36]) AS ss, unnest([3, 20, 38]) AS ds FROM p),
 c AS (SELECT doc_id, line_no, ss, CASE WHEN doc_id % 2 = 0 THEN ds ELSE n - ds - 15 END AS ds, a, b FROM k), d AS (SELECT *, substring(a, ss + 1, 15) AS x, CASE WHEN doc_id % 2 = 0 THEN substring(b, ds + 1, 15) ELSE translate(reverse(substring(b, ds + 1, 15)), 'ACGTN', 'TGCAN') END AS y FROM c),
 i AS (SELECT doc_id AS chain_id, CAST(line_no AS BIGINT) AS line_no, CAST(15 AS BIGINT) AS size, CAST(list_sum(list_transform(range(1, 16), lambda j: CASE WHEN substring(x, j, 1) = substring(y, j, 1) THEN 1 ELSE 0 END)) AS DOUBLE) / 15 AS hdist, concat('a', CAST(doc_id AS STRING)) AS source, CAST(ss AS BIGINT) AS s_start, CAST(ss + 15 AS BIGINT) AS s_end, '+' AS strand, doc_id % 2 = 0 AS forward, concat('b', CAST(doc_id AS STRING)) AS dest, CAST(ds AS BIGINT) AS d_start, CAST(ds + 15 AS BIGINT) AS d_end FROM d)"""


def _letters(spark, sf, sql: str) -> DataFrame:
    """The rows of ``sql``, made from the texts once, as several steps read them."""
    path = f"{asof.shared_folder(spark)}/letters-{uuid.uuid4().hex}"
    frame(spark, sf, sql).write.parquet(path)
    return spark.read.parquet(path)


def _identity_rows(spark, sf):
    pairs_ = _letters(spark, sf, _PAIRED)
    a, b = (pairs_.select(F.concat(F.lit(c), F.col("doc_id").cast("string")).alias("contig"), F.col(c).alias("seq")) for c in "ab")
    blocks = spark.sql(_TRIPLE.replace(f"({_PAIRED})", "{made}"), made=pairs_)
    return summary.chain_identity(blocks, a, b)


@query(duck(f"{_ALIKE} SELECT * FROM i"))
def chain_identity(spark, sf):
    return _identity_rows(spark, sf)


@query(duck(f"{_ALIKE} SELECT CAST(sum(size) AS BIGINT) AS bases, round(sum(size * hdist), 3) AS equal_bases FROM i"))
def chain_identity_totals(spark, sf):
    return summary.identity_totals(_identity_rows(spark, sf)).select("bases", F.round("equal_bases", 3).alias("equal_bases"))


@query(duck(f'{_ALIKE} SELECT dest AS contig, d_start AS start, d_end AS "end" FROM i WHERE hdist < 0.75'))
def low_identity_regions(spark, sf):
    return summary.low_identity(_identity_rows(spark, sf), 0.75, "dest")


# --- variants ---------------------------------------------------------------

_VARIANTS = """SELECT concat('c', CAST(o_custkey % 5 AS STRING)) AS chrom, CAST(o_orderkey * 40 AS BIGINT) AS pos, CASE WHEN o_orderkey % 4 = 2 THEN concat('A', repeat('C', CAST(1 + o_orderkey % 6 AS INT))) WHEN o_orderkey % 4 = 3 THEN 'AC' ELSE 'A' END AS ref,
 CASE WHEN o_orderkey % 4 = 1 THEN concat('A', repeat('C', CAST(1 + o_orderkey % 6 AS INT))) WHEN o_orderkey % 4 = 3 THEN 'GT' WHEN o_orderkey % 4 = 0 THEN 'G' ELSE 'A' END AS alt, o_orderkey % 7 <> 0 AS present FROM orders"""
_PLACES = "SELECT event_id AS point_id, concat('c', CAST(user_id % 6 AS STRING)) AS contig, CAST((event_id * 7919) % 600000 AS BIGINT) AS pos FROM events"


def _variants(spark, sf):
    rows = frame(spark, sf, _VARIANTS)
    return rows.select("chrom", "pos", "ref", F.array("alt").alias("alts"), F.lit(None).cast("string").alias("info"), F.when(F.col("present"), 1).otherwise(0).alias("allele"))


@query(f"""WITH v AS ({_VARIANTS}), e AS (SELECT chrom, pos + 1 AS place, length(alt) - length(ref) AS d FROM v WHERE present AND length(alt) <> length(ref)),
 c AS (SELECT *, coalesce(sum(d) OVER (PARTITION BY chrom ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e),
 p AS (SELECT chrom, 0 AS start, 0 AS source, 1 AS moves, 1 AS k FROM v WHERE present GROUP BY chrom UNION ALL SELECT chrom, place + before, place, 0, 0 FROM c WHERE d > 0 UNION ALL SELECT chrom, place + before + greatest(d, 0), place - least(d, 0), 1, 1 FROM c),
 q AS (SELECT chrom, CAST(start AS BIGINT) AS start, CAST(source AS BIGINT) AS source, moves FROM p), t AS ({_PLACES})
 SELECT point_id, contig, pos, CAST(CASE WHEN q.chrom IS NULL THEN pos ELSE source + moves * (pos - start) END AS BIGINT) AS lifted FROM t ASOF LEFT JOIN q ON t.contig = q.chrom AND t.pos >= q.start""")
def vcf_position_lift(spark, sf):
    return vcf.lift_places(frame(spark, sf, _PLACES), vcf.pieces(vcf.accepted(_variants(spark, sf))))


@query(_MERGE.format(f'SELECT chrom AS contig, CASE WHEN length(ref) > length(alt) THEN pos + 1 ELSE pos END AS start, pos + greatest(length(ref), length(alt)) AS "end" FROM ({_VARIANTS})'))
def vcf_to_bed(spark, sf):
    return vcf.to_bed(_variants(spark, sf))


# --- reads against a reference ----------------------------------------------

_READ = f"SELECT doc_id AS id, seq AS ref, translate(substring(seq, 11, 80), 'G', 'T') AS seq FROM ({X.SEQ}) WHERE length(seq) >= 12"


@query(duck(f"""WITH r AS (SELECT id, seq, substring(ref, 11, length(seq)) AS piece FROM ({_READ})), b AS (SELECT id, unnest(range(1, length(seq) + 1)) AS k, unnest(string_split(seq, '')) AS x, unnest(string_split(piece, '')) AS y FROM r),
 m AS (SELECT id, k, y, coalesce(lag(k) OVER (PARTITION BY id ORDER BY k), 0) AS before FROM b WHERE x <> y OR x = 'N'), t AS (SELECT id, string_agg(concat(CAST(k - before - 1 AS STRING), y), '' ORDER BY k) AS t, max(k) AS top, count(*) AS nm FROM m GROUP BY id)
 SELECT id, concat(coalesce(t, ''), CAST(length(seq) - coalesce(top, 0) AS STRING)) AS md, CAST(coalesce(nm, 0) AS BIGINT) AS nm FROM r LEFT JOIN t USING (id)"""))
def md_nm(spark, sf):
    rows = frame(spark, sf, _READ)
    fasta = rows.select(F.col("id").cast("string").alias("contig"), F.col("ref").alias("seq"))
    size = F.length("seq").cast("long")
    reads = rows.select("id", F.lit(0).alias("flag"), F.col("id").cast("string").alias("rname"), F.lit(10).cast("long").alias("pos"), size.alias("rlen"), "seq", F.concat(size.cast("string"), F.lit("M")).alias("cigar"))
    return M.fill(reads, fasta).select("id", "md", "nm")


@query()
def realign(spark, sf):
    """Reads with a gap of three bases in them, first aligned without one."""
    rows = _letters(spark, sf, _READ).where("length(seq) >= 60")
    fasta = rows.select(F.col("id").cast("string").alias("contig"), F.col("ref").alias("seq"))
    gapped = F.concat(F.substring("ref", 11, 30), F.substring("ref", 44, 30))
    reads = rows.select("id", F.lit(0).alias("flag"), F.col("id").cast("string").alias("rname"), F.lit(10).cast("long").alias("pos"), F.lit(63).cast("long").alias("rlen"), gapped.alias("seq"), F.lit("63M").alias("cigar"))
    return R.realign(M.fill(reads, fasta), fasta, R.PRESETS["bowtie2"]).select("id", "cigar", "md", "nm", "lr")


@query(duck(f"WITH s AS ({X.SEQ}) SELECT doc_id, substring(seq, 11, 20) AS seq FROM s"))
def extract_seq(spark, sf):
    from coordshift.functions.sequence import extract

    s = frame(spark, sf, X.SEQ).withColumn("contig", F.col("doc_id").cast("string"))
    bed = s.select("contig", F.lit(10).alias("start"), F.lit(30).alias("end"))
    return extract(bed, s.select("contig", "seq", "doc_id")).select("doc_id", F.col("part").alias("seq"))


@query(duck(f"WITH s AS ({X.SEQ}) SELECT doc_id, concat(substring(seq, 1, 10), repeat('N', greatest(0, least(20, length(seq) - 10))), substring(seq, 31)) AS seq FROM s"))
def mask_fasta(spark, sf):
    from coordshift.functions.sequence import mask

    s = frame(spark, sf, X.SEQ).withColumn("contig", F.col("doc_id").cast("string"))
    bed = s.select("contig", F.explode(F.array(F.struct(F.lit(10).alias("start"), F.lit(22).alias("end")), F.struct(F.lit(20).alias("start"), F.lit(30).alias("end")))).alias("r")).select("contig", "r.start", "r.end")
    return mask(s, bed).select("doc_id", "seq")
