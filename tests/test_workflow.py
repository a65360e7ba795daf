"""Whole runs on small tables, and streams."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from coordshift.functions import realign as R
from coordshift.operators import index, lift, workflow
from coordshift.sources import sinks, text
from coordshift.streaming import lifted_alignments, write

SEQ = "ACGTTGCAAGGCTTACCGATAGCTTGACCATTGGCATCAGTTACGGATCCA"


@pytest.fixture(scope="module")
def ix(spark):
    """100 bases of a go to b, from place 5 on."""
    head = ("a", 200, 10, "b", 200, 15, True)
    return index.build_index(index.chain_to_intervals(spark.createDataFrame([(1, 0, *head, 100, None, None)], "chain_id long, line_no long, s_name string, s_len long, s_start long, d_name string, d_len long, d_start long, strand boolean, len long, ds long, dd long"))).cache()


@pytest.fixture(scope="module")
def records(spark, tmp_path_factory):
    lines = ["@SQ\tSN:a\tLN:200"]
    for name, flag, pos, mapq, mate in (("p", 99, 21, 60, 41), ("p", 147, 41, 60, 21), ("q", 99, 31, 60, 51), ("q", 147, 51, 3, 31), ("x", 73, 150, 60, 150)):
        lines.append(f"{name}\t{flag}\t{"z" if name == "x" else "a"}\t{pos}\t{mapq}\t20M\t=\t{mate}\t{(mate - pos) or 0}\t{SEQ[:20]}\t{'I' * 20}\tNM:i:0\tAS:i:120")
    path = tmp_path_factory.mktemp("sam") / "in.sam"
    path.write_text("\n".join(lines) + "\n")
    return text.read_sam(spark, str(path))


@pytest.fixture(scope="module")
def contigs(spark):
    return spark.createDataFrame([("b", 200, 0)], "name string, length long, ord long")


def test_split(spark, records, ix, contigs, tmp_path):
    got = workflow.lift_and_split(records, ix, workflow.Options(rules={"mapq": 10.0}), contigs)
    rows = {(r["qname"], r["original"]["flag"]): r for r in got.collect()}
    assert [rows["p", 99][c] for c in ("rname", "pos", "committed", "unliftable")] == ["b", 25, True, False]
    assert [rows["q", 147][c] for c in ("committed", "deferred", "unliftable")] == [False, True, True]
    assert rows["x", 73]["flag"] & 4 and rows["x", 73]["deferred"]
    sinks.write_split(got, str(tmp_path / "out"), ["@SQ\tSN:b\tLN:200"], ["@SQ\tSN:a\tLN:200"])
    header, back = sinks.read_written_sam(spark, str(tmp_path / "out-unliftable.sam"))
    assert header == ["@SQ\tSN:a\tLN:200"] and sorted((r["qname"], r["pos"]) for r in back.collect()) == [("q", 50), ("x", 149)]


def test_held_regions(spark, records, ix, contigs):
    held = spark.createDataFrame([("a", 50, 55)], "contig string, start long, end long")
    got = workflow.lift_and_split(records, ix, workflow.Options(rules={"mapq": 10.0}, commit_source=held), contigs)
    row = got.where("qname = 'q' and original.flag = 147").first()
    assert row["committed"] and row["unliftable"] and not row["deferred"]
    with pytest.raises(ValueError):
        workflow.Options(commit_source=held)


def test_other_contigs_fail(spark, records, ix):
    none = spark.createDataFrame([("z", 9, 0)], "name string, length long, ord long")
    assert {r["lo"] for r in workflow.lift_and_split(records, ix, workflow.Options(), none).collect()} == {"UM_UM"}


def test_remapping_settles_pairs(spark, records, ix, contigs):
    def aligner(reads):
        tag = lambda v: F.struct(F.lit("i").alias("type"), F.lit(v).alias("value"))
        return reads.withColumn("rname", F.lit("b")).withColumn("pos", F.lit(100).cast("long")).withColumn("flag", F.col("flag").bitwiseAND(~4 & ~8)).withColumn("mapq", F.lit(50)).withColumn("tlen", F.lit(30).cast("long")).withColumn("cigar", F.lit("20M")).withColumn("tags", F.create_map(F.lit("NM"), tag("0")))

    done = workflow.remap(records, ix, contigs, workflow.Options(rules={"mapq": 10.0}), aligner, True).collect()
    assert sorted((r["qname"], r["flag"] & 192) for r in done) == [("p", 64), ("p", 128), ("q", 64), ("q", 128), ("x", 64)]
    label = {r["qname"]: r["tags"]["RF"]["value"] for r in done if "RF" in r["tags"]}
    assert label == {"q": "realigned", "x": "realigned"}
    single = workflow.remap(records, ix, contigs, workflow.Options(rules={"mapq": 10.0}), aligner, False)
    assert single.count() == 5
    assert workflow.preset("ilmn_pe", "bowtie2", reference=records).rules["aln_score"] == -10.0
    with pytest.raises(ValueError):
        workflow.preset("ont", "bowtie2")


def test_md_and_realignment_in_a_run(spark, records, ix, contigs):
    fasta = spark.createDataFrame([("b", "T" * 25 + SEQ[:10] + "CC" + SEQ[10:20] + "T" * 160)], "contig string, seq string")
    options = workflow.Options(rules={"hdist": 5.0}, reference=fasta, realign=R.PRESETS["bowtie2"])
    row = workflow.lift_and_split(records, ix, options, contigs).where("qname = 'p' and original.flag = 99").first()
    assert {"NM", "MD", "LR", "LO"} <= set(row["tags"]) and int(row["tags"]["NM"]["value"]) <= 12
    with pytest.raises(ValueError):
        workflow.Options(rules={"hdist": 5.0})


def test_annotations(spark, ix):
    blocks = spark.createDataFrame([(1, 0, "a", 200, 10, "b", 200, 15, True, 100, None, None)], "chain_id long, line_no long, s_name string, s_len long, s_start long, d_name string, d_len long, d_start long, strand boolean, len long, ds long, dd long")
    a, b = ([(n, "A" * 200)] for n in "ab")
    source, dest = (spark.createDataFrame(x, "contig string, seq string") for x in (a, b))
    maps = [spark.createDataFrame([(n, i * 50, i * 50 + 50, m) for i, m in enumerate(ms)], "contig string, start long, end long, mappable boolean") for n, ms in (("a", (True, True, False, False)), ("b", (False, False, True, True)))]
    got = workflow.annotations(blocks, source, dest, *maps, ix, 0.9, 5, 50)
    assert [tuple(r) for r in got.unliftable.collect()] == [("a", 110, 200)] and got.low_identity.count() == 0
    assert got.defer.count() == got.map_reduced.count()


def test_streams_are_lifted_as_tables_are(spark, ix, tmp_path):
    rows = spark.createDataFrame([(i, 0, "a", 10 + i, 60, "5M", 5, "*", -1, 0, 0, 5) for i in range(40)], "id long, flag int, rname string, pos long, mapq int, cigar string, l_qseq long, rnext string, pnext long, mate_rlen long, tlen long, rlen long")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = write(lifted_alignments(stream, ix), str(tmp_path / "out"), str(tmp_path / "state"))
    query.processAllAvailable()
    query.stop()
    fields = ["id", "new_rname", "new_pos", "new_cigar"]
    want = lift.lift_alignments(rows, ix).select(*fields)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select(*fields).collect())) == sorted(map(tuple, want.collect()))
