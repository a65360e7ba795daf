"""Known values of the sequential functions and small joins."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pytest

from pyspark.sql import functions as F

from coordshift.functions import cigar as C
from coordshift.functions import realign as R
from coordshift.functions import sam as S
from coordshift.functions.md import md_nm, with_reference
from coordshift.functions.sequence import mask
from coordshift.operators import asof, chains, index, lift, overlap, route, summary, vcf
from coordshift.operators.summary import cigar_identity
from coordshift.sources import sinks

CHAIN = "chain_id long, line_no long, s_name string, s_len long, s_start long, d_name string, d_len long, d_start long, strand boolean, len long, ds long, dd long"
READ = "id long, flag int, rname string, pos long, cigar string, l_qseq long, rnext string, pnext long, mate_rlen long"


def blocks_of(spark, *rows):
    return spark.createDataFrame(list(rows), CHAIN)


@pytest.fixture(scope="module")
def three(spark):
    """Three intervals: 2 bases lost between the first two, one between the last two."""
    head = ("c", 900000, 674044, "d", 900000, 100269, True)
    return index.build_index(index.chain_to_intervals(blocks_of(spark, (1, 0, *head, 106, 2, 0), (1, 1, *head, 677, 12628, 12627), (1, 2, *head, 808, None, None)))).cache()


def with_lengths(rows):
    return rows.withColumn("rlen", C.reference_length("cigar"))


@pytest.mark.parametrize("most", [10**6, 0])
def test_cigars_over_gaps(spark, three, monkeypatch, most):
    monkeypatch.setattr(asof.prepared, "__defaults__", (most,))
    asked = [(674849, "7M13D13M", 20), (687454, "16M", 16), (687454, "16M", 0), (674140, "16M", 16), (674819, "16M", 16), (674849, "7=13D6=1X6=", 20), (687454, "10=1X5=", 16), (100, "16M", 16)]
    rows = spark.createDataFrame([(i, 0 if q else 256, "c", p, c, q, "*", -1, 0) for i, (p, c, q) in enumerate(asked)], READ)
    # the second read begins in the gap before the last interval, the fifth ends in the first gap
    shifted = rows.withColumn("pos", F.when(F.col("cigar").isin("7M13D13M", "7=13D6=1X6="), F.lit(674150 + 20)).otherwise(F.col("pos")))
    got = {r["id"]: (r["own_ok"], r["new_cigar"]) for r in lift.lift_segments(with_lengths(shifted), three, 13000).collect()}
    assert got == {0: (True, "7M13D13M"), 1: (True, "3S13M"), 2: (True, "3S13M"), 3: (True, "10M2I4M"), 4: (True, "9M7S"), 5: (True, "7M13D13M"), 6: (True, "3S13M"), 7: (False, "*")}


def test_steps_between_intervals(spark, three):
    spans = spark.createDataFrame([(1, "c", 0, 1), (2, "c", 0, 2), (3, "c", 1, 1), (4, "z", 0, 1), (5, "c", 1, 9)], "id long, contig string, start_idx long, end_idx long")
    legal = {g: {r["id"] for r in lift.legal_spans(spans, three, g).where("legal").collect()} for g in range(4)}
    assert legal == {0: {3}, 1: {3}, 2: {1, 3}, 3: {1, 2, 3}} and lift.legal_spans(spans, three, 2).count() == 5
    points = lift.break_points(spans.withColumn("pos", F.lit(674140).cast("long")), three)
    assert {r["id"]: [tuple(x) for x in r["bps"]] for r in points.collect()} == {1: [(10, -2), (689, -1)], 2: [(10, -2), (689, -1)], 3: [(689, -1)], 4: [], 5: [(689, -1)]}


def test_searching_equals_sorting(spark, three):
    places = spark.createDataFrame([(c, p) for c in ("c", "z", None) for p in (-1, 0, None, 674043, 674044, 674150, 674151, 674152, 687456, 687457, 688265, 688266, 899999, 900000)], "contig string, pos long")
    fields = ["contig", "pos", "sidx", "eidx", "s.idx", "e.idx"]
    search, sort = ([tuple(r) for r in f(places, three).select(*fields).collect()] for f in (asof.slots, asof.sorted_slots))
    assert sorted(map(str, search)) == sorted(map(str, sort)) and len(search) == 42


def test_a_mate_before_a_block_keeps_its_place(spark):
    """Blocks 100-150 to 200 and 180-250 to 280: three bases before the second, a mate's place isn't moved on."""
    head = ("a", 1000, 100, "b", 1000, 200, True)
    ix = index.build_index(index.chain_to_intervals(blocks_of(spark, (1, 0, *head, 20, 5, 5), (1, 1, *head, 25, 30, 30), (1, 2, *head, 70, None, None))))
    rows = spark.createDataFrame([(1, 1, "a", 177, "10M", 10, "a", 177, 10)], READ)
    got = lift.lift_segments(with_lengths(rows), ix, 50).first()
    assert got["own_pos"] - got["mate_pos"] == 3 and got["new_cigar"] == "3S7M"


def test_reverse_lift_turns_cigar_and_read(spark):
    ix = index.build_index(index.chain_to_intervals(blocks_of(spark, (1, 0, "a", 100, 0, "b", 100, 0, False, 100, None, None))))
    value = lambda t, v: {"type": t, "value": v}
    rows = spark.createDataFrame([("r", 0, "a", 10, 60, "2S3M1I4M", "*", -1, 0, "AACGTTACGT", "0123456789", {"NM": value("i", "1"), "XX": value("Z", "x")})], "qname string, flag int, rname string, pos long, mapq int, cigar string, rnext string, pnext long, tlen long, seq string, qual string, tags map<string,struct<type:string,value:string>>")
    r = lift.lift_records(rows, ix).first()
    assert (r["flag"], r["rname"], r["pos"], r["cigar"], r["seq"], r["qual"]) == (16, "b", 83, "4M1I3M2S", "ACGTAACGTT", "9876543210")
    assert {k: v["value"] for k, v in r["tags"].items()} == {"XX": "x", "LO": "L"} and r["original"]["pos"] == 10
    lost = lift.lift_records(rows.withColumn("rname", F.lit("z")).withColumn("flag", F.lit(16)), ix).first()
    assert (lost["flag"], lost["rname"], lost["pos"], lost["mapq"], lost["cigar"], lost["seq"]) == (4, "*", -1, 0, "*", "ACGTAACGTT")


@pytest.mark.parametrize(("seq", "cigar", "ref", "want"), [("ACGT", "4M", "ACGT", ("4", 0)), ("ACGT", "4M", "AGGN", ("1G1N0", 2)), ("ACGTA", "2M1I2M", "ACTA", ("4", 1)), ("ACTA", "2M2D2M", "ACGGTA", ("2^GG2", 2)), ("SSACG", "2S3M", "ACT", ("2T0", 1)), ("ACGT", "4M", "ac", ("2", 0)), ("=R", "2M", "AR", ("2", 0)), ("ACNN", "2M3N2M", "ACTTTNA", ("2N0A0", 2))])
def test_md_and_nm(seq, cigar, ref, want):
    assert md_nm(seq, cigar, ref) == want


def test_reference_pieces(spark):
    fasta = spark.createDataFrame([("a", "".join("ACGT"[i * 7 % 4] for i in range(50)))], "contig string, seq string")
    seq = fasta.first()["seq"]
    rows = spark.createDataFrame([(1, "a", 3, 5), (2, "a", 9, 4), (3, "a", 4, 30), (4, "z", 0, 3), (5, "a", 48, 9)], "id long, rname string, pos long, rlen long")
    got = {r["id"]: r["reference"] for r in with_reference(rows, fasta, width=10).collect()}
    assert got == {1: seq[3:8], 2: seq[9:13], 3: seq[4:34], 4: None, 5: seq[48:]}


def plain_score(t: str, q: str, s: R.Settings) -> int:
    """Best score by three or five whole tables."""
    costs = [(s.q, s.e), *([(s.q2, s.e2)] if s.dual else [])]
    low = -(10**9)
    h = {(0, 0): 0}
    e, f = ({(i, j, k): low for i in range(len(t) + 1) for j in range(len(q) + 1) for k in range(len(costs))} for _ in range(2))
    for i in range(len(t) + 1):
        for j in range(len(q) + 1):
            for k, (o, x) in enumerate(costs):
                if i:
                    e[i, j, k] = max(h[i - 1, j] - o - x, e[i - 1, j, k] - x)
                if j:
                    f[i, j, k] = max(h[i, j - 1] - o - x, f[i, j - 1, k] - x)
            pair = h[i - 1, j - 1] + (0 if "N" in (t[i - 1], q[j - 1]) else s.a if t[i - 1] == q[j - 1] else -abs(s.b)) if i and j else low
            if i or j:
                h[i, j] = max(pair, *(e[i, j, k] for k in range(len(costs))), *(f[i, j, k] for k in range(len(costs))))
    return h[len(t), len(q)]


@pytest.mark.parametrize("name", sorted(R.PRESETS))
def test_realigned_scores_are_best(name):
    import random

    rng = random.Random(4)
    for _ in range(25):
        t = "".join(rng.choice("ACGTN") for _ in range(rng.randint(1, 40)))
        q = t[: rng.randint(0, len(t))] + "".join(rng.choice("ACGT") for _ in range(rng.randint(1, 6))) + t[rng.randint(0, len(t)) :]
        cigar, score = R.align(t, q, R.PRESETS[name])
        assert score == plain_score(t, q, R.PRESETS[name])
        assert sum(n for n, op in C.runs(cigar) if op in "MIS") == len(q) and sum(n for n, op in C.runs(cigar) if op in "MD") == len(t)


def test_realigned_gaps():
    t = "ACGGATTACAGATTACCATGAACCTTGGAC"
    assert R.align(t, t[:12] + t[16:], R.PRESETS["default"])[0] == "12M4D14M"
    assert R.align(t, "TTTTT" + t, R.PRESETS["default"])[0] == "5S30M"


def variants(spark, rows):
    return spark.createDataFrame([("v", p, r, a.split(","), None, g) for p, r, a, g in rows], "chrom string, pos long, ref string, alts array<string>, info string, allele int")


def test_variants_that_overlap(spark):
    rows = [(10, "AC", "A", 1), (11, "C", "CT", 1), (11, "C", "G", 1), (12, "G", "T", 1), (12, "G", "T,C", 0), (20, "ACGT", "A", 1), (22, "G", "GAA", 1), (24, "A", "AT", 1), (30, "A", "C,AGG", 2), (40, "AC", "GT", 1)]
    got = [(r["pos"], r["kind"], r["change"]) for r in vcf.accepted(variants(spark, rows)).orderBy("pos", "change").collect()]
    assert got == [(10, "indel", -1), (11, "indel", 1), (12, "snp", 0), (20, "indel", -3), (24, "indel", 1), (30, "indel", 2), (40, "other", 0)]


def test_lift_by_variants(spark):
    kept = vcf.accepted(variants(spark, [(110, "ACC", "A", 1), (200, "A", "ACG", 1), (300, "ACGT", "A", 1)]))
    rows = spark.createDataFrame([(0, "v", 100, "20M"), (0, "v", 104, "7M13D13M"), (0, "v", 190, "20M"), (0, "v", 190, "9M2N4M"), (0, "v", 290, "8M4I8M"), (0, "w", 5, "9M"), (4, "v", 7, "*"), (0, "v", 199, "1S6M")], "flag int, rname string, pos long, cigar string")
    rows = rows.withColumn("rnext", F.lit("*")).withColumn("pnext", F.lit(-1).cast("long")).withColumn("tlen", F.lit(0).cast("long"))
    got = [(r["new_pos"], r["new_cigar"]) for r in vcf.lift_alignments(rows, kept).collect()]
    # two bases are lost at 111; two are gained at 201, 199 to 200 of the personalised sequence
    assert got == [(100, "11M2D9M"), (104, "7M15D13M"), (192, "9M2I9M"), (192, "13M"), (290, "8M4I3M3D5M"), (5, "9M"), (7, "*"), (201, "1S2I4M")]


def test_islands_at_the_ends(spark):
    rows = spark.createDataFrame([("a", 0, 10, True), ("a", 10, 20, False), ("a", 20, 60, True), ("b", 5, 9, False), ("b", 9, 50, True), ("b", 50, 60, True)], "contig string, start long, end long, mappable boolean")
    assert sorted(tuple(r) for r in overlap.mappable_islands(rows, 4).collect()) == [("a", 0, 10), ("b", 0, 5), ("b", 9, 54)]


@pytest.mark.parametrize("width", [7, 1 << 20])
def test_merging_over_bins(spark, width):
    import random

    rng = random.Random(1)
    rows = [("c", s, s + rng.randint(1, 9)) for s in (rng.randint(0, 200) for _ in range(40))] + [("c", 30, 90), ("d", 5, 6), ("d", 6, 8)]
    covered = {(c, x) for c, s, e in rows for x in range(s, e)}
    got = sorted(tuple(r) for r in overlap.merge(spark.createDataFrame(rows, "contig string, start long, end long"), width=width).collect())
    assert {(c, x) for c, s, e in got for x in range(s, e)} == covered
    assert all((c, s - 1) not in covered and (c, e) not in covered for c, s, e in got)


def test_masking(spark):
    fasta = spark.createDataFrame([("a", "ACGTACGTAC", 1), ("b", "ACGT", 2)], "contig string, seq string, n int")
    bed = spark.createDataFrame([("a", 2, 4), ("a", 3, 6), ("a", 8, 99), ("a", -3, 1), ("z", 0, 5)], "contig string, start long, end long")
    assert {r["contig"]: r["seq"] for r in mask(fasta, bed).collect()} == {"a": "NCNNNNGTNN", "b": "ACGT"}


def test_gaps_as_variants(spark):
    head = ("a", 100, 4, "a", 100, 1, True)
    got = chains.to_vcf(blocks_of(spark, (1, 0, *head, 10, 4, 4), (1, 1, *head, 5, 3, 1), (1, 2, *head, 5, 0, 2), (1, 3, *head, 9, None, None))).orderBy("pos").collect()
    assert [(r["contig"], r["pos"], r["ref"], r["alt"]) for r in got] == [("a", 2, "A", "AAAA"), ("a", 21, "A", "AAA"), ("a", 27, "AAA", "A")]


@pytest.mark.parametrize(("a", "b", "n"), [(("30M5I20M", 10), ("30M5I20M", 10), 55), (("10M2D10M", 0), ("10M2D10M", 0), 20), (("20M", 5), ("10M1D10M", 5), 10), (("20M", 5), ("20M", 6), 0)])
def test_identity_counts_runs(a, b, n):
    size = sum(k for k, op in C.runs(a[0]) if op in "MIS")
    assert cigar_identity(*a, *b) == n / size


def test_quantiles_over_many_values(spark):
    rows = spark.range(1000).select(((F.col("id") * 37) % 1000).alias("v"))
    got = {r["q"]: r["value"] for r in summary.exact_quantiles(rows, "v", [0.0001, 0.05, 0.5, 0.999, 1.0], parts=20).collect()}
    assert got == {0.0001: 999, 0.05: 49, 0.5: 499, 0.999: 998, 1.0: 999}


def test_header_and_tags(spark):
    head = ["@HD\tVN:1.6", "@SQ\tSN:a\tLN:9", "@RG\tID:x", "@PG\tID:bwa\tPN:bwa"]
    assert sinks.rewritten_header(head, [("b", 7)], "run -x") == ["@HD\tVN:1.6", "@SQ\tSN:b\tLN:7", "@RG\tID:x", "@PG\tID:bwa\tPN:bwa", "@PG\tID:coordshift\tPN:coordshift\tPP:bwa\tVN:1\tCL:run -x"]
    row = spark.createDataFrame([("c,-1,2,3", "ACGRn-")], "tp string, seq string").select(S.reversed_array("tp").alias("tp"), S.masked_complement("seq").alias("seq")).first()
    assert tuple(row) == ("c,3,2,-1", "NNNCGT")


@pytest.mark.parametrize(("start", "n", "op", "want"), [("2M", 1, "M", "3M"), ("1I", 1, "D", "1M"), ("4S", 2, "D", "4S"), ("3D", 1, "I", "2D1M")])
def test_runs_join_or_cancel(start, n, op, want):
    ops = C.runs(start)
    C.add(ops, n, op)
    assert C.render(ops) == want


def test_break_points_with_an_insertion_on_the_way():
    assert C.lift_runs("200M5I47M", 252, [(195, -18), (217, -2)], False, True, 0, 0) == "195M25I32M"


@pytest.mark.parametrize(("cigar", "q", "start", "forward", "want"), [("16M", 16, 3, True, "3S13M"), ("7=13D6=1X6=", 20, 0, True, "7M13D13M"), ("10=1X5=", 16, 0, False, "16M"), ("10=1X5=", 16, 3, True, "3S13M")])
def test_one_interval(cigar, q, start, forward, want):
    assert C.lift_runs(cigar, q, [], True, forward, start, 0) == want


def test_too_many_clips():
    assert C.lift_runs("10M", 10, [], True, True, 6, 6) is None


def test_identity_of_equal_alignments():
    assert cigar_identity("10M2D5M", 7, "10M2D5M", 7) == 1


def test_rules():
    assert route.parse_rules(["lifted", "mapq:20"]) == {"lifted": None, "mapq": 20.0}
    for bad in ("mapq", "nope:1", "mapq:1:2"):
        with pytest.raises(ValueError):
            route.parse_rules([bad])


def test_small_chain(spark):
    """A chain of 19 and 7 bases from place 0: place 0 has no rank, gaps after the first block count as inside it."""
    blocks = spark.createDataFrame([(1, 0, "a", 28, 0, "b", 28, 0, True, 19, 1, 1), (1, 1, "a", 28, 0, "b", 28, 0, True, 7, None, None)], "chain_id long, line_no long, s_name string, s_len long, s_start long, d_name string, d_len long, d_start long, strand boolean, len long, ds long, dd long")
    ix = index.build_index(index.chain_to_intervals(blocks))
    points = spark.createDataFrame([("a", 0), ("a", 5), ("a", 19), ("a", 22), ("a", 28), ("z", 3)], "contig string, pos long")
    got = {(r["contig"], r["pos"]): (r["sidx"], r["eidx"], r["lifted"]) for r in lift.lift_points(points, ix).collect()}
    assert got == {("a", 0): (-1, 0, -1), ("a", 5): (0, 0, 5), ("a", 19): (0, 0, 19), ("a", 22): (1, 0, 22), ("a", 28): (-1, -1, -1), ("z", 3): (-1, -1, -1)}


def test_overlaps_of_all_lengths_meet_in_small_bins(spark):
    """Pairs and flags equal brute force, each pair once, and bins hold few that don't overlap."""
    rng = np.random.default_rng(3)
    size = lambda: int(rng.choice([0, 1, 7, 60, 64, 65, 500, 3000, 40000, 100000]))
    a, b = ([(i, f"c{i % 2}", s, s + size()) for i, s in enumerate(rng.integers(0, 200000, 300).tolist())] for _ in range(2))
    names = "id long, contig string, start long, end long"
    x, y = spark.createDataFrame(a, names), spark.createDataFrame(b, names)
    met = [(i, max(s, t), min(e, f)) for i, c, s, e in a for _, d, t, f in b if c == d and s < f and t < e and s < e and t < f]
    assert sorted((r["id"], r["o_start"], r["o_end"]) for r in overlap.pairs(x, y).collect()) == sorted(met)
    best = {i: max((f - t for j, t, f in met if i == j), default=0) for i, *_ in a}
    for threshold, enough in ((0, lambda n, s: n > 0), (0.5, lambda n, s: n > 0 and n >= s * 0.5), (50, lambda n, s: n >= 50)):
        assert {r["id"]: r["hit"] for r in overlap.flag_overlaps(x, y, threshold).collect()} == {i: enough(best[i], e - s) for i, _, s, e in a}
    kept = {(c, s, e) for _, c, s, e in b if s < e and not any(d == c and t <= s and e <= f and (t, f) != (s, e) for _, d, t, f in b)}
    assert sorted(tuple(r) for r in overlap.widest(y, 1 << 12).collect()) == sorted(kept)
    # 2,000 short ones on 16,384 bases: 4,000,000 pairs in one wide bin
    dense = spark.range(2000).selectExpr("'c' as contig", "id * 7919 % 16384 as start", "id * 7919 % 16384 + 20 as end")
    level = dense.selectExpr("array(6) as __levels").limit(1)
    bins = overlap.binned(dense, "start", "end", level).groupBy("__level", "__bin").count().collect()
    assert overlap.pairs(dense, dense).count() < sum(r["count"] ** 2 for r in bins) < 60_000


def test_lookup_where_intervals_overlap(spark, monkeypatch):
    """The last start and the last end before a place, also where a long interval ends after later ones, whatever the buckets."""
    monkeypatch.setattr(index, "BASES", 16)
    rng = np.random.default_rng(4)
    starts = rng.choice(400, 60, replace=False).tolist()
    rows = [(f"c{i % 2}", 900, f"d{i % 3}", i % 4 > 0, s, s + int(rng.choice([1, 5, 90])), i) for i, s in enumerate(starts)]
    ix = index.build_index(spark.createDataFrame(rows, "contig string, s_len long, target string, strand boolean, source_start long, source_end long, off long"))
    plain = {c: sorted(r for r in rows if r[0] == c) for c in ("c0", "c1")}
    plain = {c: sorted(v, key=lambda r: r[4]) for c, v in plain.items()}
    for r in ix.collect():
        own = plain[r["contig"]]
        assert own[r["idx"]][4] == r["source_start"] and r["next_source_start"] == (own[r["idx"] + 1][4] if r["idx"] + 1 < len(own) else None)
        assert r["target_run"] == sum(i == 0 or own[i][2] != own[i - 1][2] for i in range(r["idx"] + 1))
    places = spark.createDataFrame([(c, p) for c in ("c0", "c1") for p in range(520)], "contig string, pos long")
    want = []
    for c in ("c0", "c1"):
        ends = [(r[5], i) for i, r in enumerate(plain[c])]
        for p in range(520):
            want.append((c, p, max((i for i, r in enumerate(plain[c]) if max(r[4], 1) <= p), default=-1), max((x for x in ends if x[0] < p), default=(0, 0))[1]))
    for found in (asof.slots(places, ix), asof.sorted_slots(places, ix, width=16), asof.slots(places, asof.placed(places, asof.Written(asof.with_steps(ix)), (F.col("contig"), F.col("pos"))))):
        assert sorted((r["contig"], r["pos"], r["sidx"], r["eidx"]) for r in found.select("contig", "pos", "sidx", "eidx").collect()) == want


def test_running_sums_over_buckets(spark):
    rows = spark.createDataFrame([(i % 3, i * 7 % 50, i) for i in range(50)], "k long, at long, v long")
    got = {(r["k"], r["at"]): r["s"] for r in index.sums_before(rows, ["k"], "at", 4, s=F.col("v")).collect()}
    assert got == {(k, a): sum(v for j, b, v in rows.collect() if j == k and b < a) for k, a, _ in rows.collect()}


def test_places_among_more_pieces_than_are_sent(spark):
    """Lifting by variants gives the same whether the pieces are sent out or met in buckets."""
    kept = spark.createDataFrame([("c", 5, "indel", 3), ("c", 20, "indel", -4), ("c", 90, "indel", 40), ("d", 50, "snp", 0), ("d", 200, "indel", -9)], "chrom string, pos long, kind string, change long")
    places = spark.createDataFrame([(c, p) for c in "cdx" for p in [None, -3, *range(260)]], "contig string, pos long")
    few, many = (sorted(map(str, vcf.lift_places(places, vcf.pieces(kept), most=most, width=16).collect())) for most in (100, 3))
    assert few == many and len(few) == 786


@pytest.mark.parametrize("zdrop", [400, 3])
def test_alignments_side_by_side_equal_single_ones(zdrop):
    rng = np.random.default_rng(5)
    letters = lambda n: "".join(rng.choice(list("ACGTN"), n))
    pairs = [(t, t[: len(t) // 3] + t[len(t) // 3 + 3 :] + letters(int(rng.integers(0, 4)))) for t in (letters(int(n)) for n in rng.choice([0, 1, 20, 21], 60))]
    for name in ("bowtie2", "ont"):
        settings = replace(R.PRESETS[name], zdrop=zdrop)
        assert R.align_many(*map(list, zip(*pairs, strict=True)), settings) == [R.align(t, x, settings) for t, x in pairs]
