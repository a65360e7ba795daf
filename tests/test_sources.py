"""Readers of text files."""

import pytest

from coordshift.functions.realign import Settings
from coordshift.operators import summary
from coordshift.sources import bam, sinks, text


def test_chain(spark, tmp_path):
    (tmp_path / "x.chain").write_text("chain 1 a 28 + 0 28 b 28 - 0 28 1\n19\t1\t2\n7\n\nchain 1 c 9 + 1 9 d 9 + 1 9 2\n8\n\n")
    got = sorted(tuple(r)[1:] for r in text.read_chain(spark, str(tmp_path / "x.chain")).collect())
    assert got == [(0, "a", "b", 28, 0, 28, 0, False, 19, 1, 2), (0, "c", "d", 9, 1, 9, 1, True, 8, None, None), (1, "a", "b", 28, 0, 28, 0, False, 7, None, None)]


def test_bed_and_sam(spark, tmp_path):
    (tmp_path / "x.bed").write_text("#h\na\t1\t5\tn\t+\nb\t2\t3\n")
    assert [tuple(r) for r in text.read_bed(spark, str(tmp_path / "x.bed")).orderBy("contig").collect()] == [("a", 1, 5, ["n", "+"]), ("b", 2, 3, [])]
    (tmp_path / "x.sam").write_text("@SQ\tSN:a\tLN:9\nr\t0\ta\t3\t60\t4M\t*\t0\t0\tACGT\tIIII\tNM:i:1\tXX:Z:p:q\n")
    row = text.read_sam(spark, str(tmp_path / "x.sam")).first()
    assert (row["pos"], row["pnext"], row["tags"]["NM"]["value"], row["tags"]["XX"]["value"]) == (2, -1, "1", "p:q")


def test_chains_without_blank_lines(spark, tmp_path):
    (tmp_path / "x.chain").write_text("##note\nchain 1 a 28 + 0 28 b 28 + 0 28 1\n19\t1\t2\n7\nchain 1 c 9 + 1 9 d 9 + 1 9 2\n8\n")
    assert sorted((r["s_name"], r["line_no"], r["len"]) for r in text.read_chain(spark, str(tmp_path / "x.chain")).collect()) == [("a", 0, 19), ("a", 1, 7), ("c", 0, 8)]
    (tmp_path / "y.chain").write_text("chain 1 a 28 + 0 28 b 28 + 0 28\n9\n")
    with pytest.raises(Exception, match="not a chain header"):
        text.read_chain(spark, str(tmp_path / "y.chain")).collect()


def test_bad_bed_lines_are_left_out(spark, tmp_path):
    (tmp_path / "x.bed").write_text("a\t1\nb\t2\t3\nc\tx\t4\n")
    assert [r["contig"] for r in text.read_bed(spark, str(tmp_path / "x.bed")).collect()] == ["b"]
    assert text.bed_faults(spark, str(tmp_path / "x.bed")).count() == 2


def test_sequences(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">a one\nACG\nTac\n>b\nGG\n>c\n")
    got = {r["contig"]: r["seq"] for r in text.read_fasta(spark, str(tmp_path / "x.fa")).collect()}
    assert got == {"a": "ACGTAC", "b": "GG", "c": ""}
    (tmp_path / "x.fq").write_text("".join(f"@r{i} x\nACG{'T' * i}\n+\n@@@{'I' * i}\n" for i in range(50)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        reads = text.read_fastq(spark, str(tmp_path / "x.fq")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r["name"], len(r["seq"]), len(r["qual"])) for r in reads) == sorted((f"r{i}", 3 + i, 3 + i) for i in range(50))
    sinks.write_fasta(spark.createDataFrame([("a", "A" * 130)], "contig string, seq string"), str(tmp_path / "out.fa"))
    assert sorted(len(r["value"]) for r in spark.read.text(str(tmp_path / "out.fa")).collect()) == [2, 10, 60, 60]
    half = summary.sample_pairs(text.read_fastq(spark, str(tmp_path / "x.fq")), 0.5, 3)
    assert 10 < half.count() < 40 and {r["name"] for r in half.collect()} == {r["name"] for r in half.union(half).collect()}


def test_tables_of_names_and_values(spark, tmp_path):
    (tmp_path / "x.fai").write_text("b\t20\t0\t60\t61\na\t10\t9\t60\t61\n")
    contigs = text.read_fai(spark, str(tmp_path / "x.fai"))
    assert [tuple(r) for r in contigs.orderBy("ord").collect()] == [("b", 20, 0), ("a", 10, 1)]
    assert sorted(tuple(r) for r in text.fai_to_bed(contigs).collect()) == [("a", 0, 10), ("b", 0, 20)]
    (tmp_path / "x.map").write_text("a\tchrA\n")
    assert text.read_name_map(spark, str(tmp_path / "x.map")).first()["other"] == "chrA"
    (tmp_path / "x.bg").write_text("a 0 5 1\na 5 9 inf\na 9 11 0.5\n")
    assert [r["mappable"] for r in text.read_bedgraph(spark, str(tmp_path / "x.bg")).orderBy("start").collect()] == [True, False, False]
    (tmp_path / "x.yaml").write_text('alignment:\n    engine: "ksw_extd2_sse"\n    q2: 26 # w\n    flag: 0x08\n')
    s = Settings.of(text.read_config(spark, str(tmp_path / "x.yaml")))
    assert (s.engine, s.q2, s.a) == ("ksw_extd2_sse", 26, 2)
    (tmp_path / "x.tsv").write_text("SIZE\tHDIST\tSOURCE\tS_START\tS_END\tSTRAND\tDEST\tD_START\tD_END\n9\t0.5\ta\t1\t10\t+\tb\t3\t12\n")
    assert tuple(summary.low_identity(text.read_chain_summary(spark, str(tmp_path / "x.tsv")), 0.6).first()) == ("a", 1, 10)


def test_time_logs(spark, tmp_path):
    one = '\tCommand being timed: "/bin/tool lift -a x"\n\tUser time (seconds): 1.50\n\tSystem time (seconds): 0.25\n\tElapsed (wall clock) time (h:mm:ss or m:ss): {}\n\tMaximum resident set size (kbytes): {}\n'
    (tmp_path / "x.log").write_text(one.format("0:02.50", 100) + one.format("1:00:03", 300))
    rows = text.read_time_log(spark, str(tmp_path / "x.log"))
    assert sorted((r["task"], r["cpu_s"], r["wall_s"], r["max_rss_kb"]) for r in rows.collect()) == [("tool_lift", 1.75, 2.5, 100), ("tool_lift", 1.75, 3603.0, 300)]
    assert tuple(summary.performance(rows).first()) == (2, 3.0, 0.5, 3605.5, 3.5, 300)


def test_variants(spark, tmp_path):
    (tmp_path / "x.vcf").write_text("##fileformat=VCFv4.3\n##contig=<ID=a,length=99>\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\na\t5\t.\ta\tG,AT\t.\t.\t.\tGT\t0|2\t.|1\n")
    got = [text.read_vcf(spark, str(tmp_path / "x.vcf"), *x).first() for x in (("",), ("s1", 0), ("s1", 1), ("s2", 0))]
    assert [(r["pos"], r["ref"], r["alts"], r["allele"]) for r in got] == [(4, "A", ["G", "AT"], 1), (4, "A", ["G", "AT"], 0), (4, "A", ["G", "AT"], 2), (4, "A", ["G", "AT"], None)]
    assert tuple(text.vcf_contigs(spark, str(tmp_path / "x.vcf")).first()) == ("a", 99)
    with pytest.raises(ValueError):
        text.read_vcf(spark, str(tmp_path / "x.vcf"), "s9")


def test_sam_round_trip_and_order(spark, tmp_path):
    lines = ["r2\t0\tb\t3\t60\t4M\t=\t9\t10\tACGT\tIIII\tNM:i:1", "r1\t16\ta\t7\t60\t4M\t*\t0\t0\tACGA\t!III", "r0\t4\t*\t0\t0\t*\t*\t0\t0\tAC\t*"]
    (tmp_path / "x.sam").write_text("@SQ\tSN:b\tLN:9\n@SQ\tSN:a\tLN:9\n" + "\n".join(lines) + "\n")
    rows, head = text.read_sam(spark, str(tmp_path / "x.sam")), text.read_sam_header(spark, str(tmp_path / "x.sam"))
    order = text.header_contigs(spark, head)
    assert [r["qname"] for r in sinks.merged_sorted([rows.where("flag = 0"), rows.where("flag > 0")], order).collect()] == ["r2", "r1", "r0"]
    sinks.write_sam(rows, str(tmp_path / "out"), head)
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "out" / "records")).collect()) == sorted(lines)
    sinks.write_fastq(rows, str(tmp_path / "fq"))
    assert sorted((r["name"], r["seq"], r["qual"]) for r in text.read_fastq(spark, str(tmp_path / "fq")).collect()) == [("r0", "AC", "BB"), ("r1", "TCGT", "III!"), ("r2", "ACGT", "IIII")]
    sinks.write_indexed(rows, str(tmp_path / "ix"), order)
    assert [r["qname"] for r in sinks.read_region(spark, str(tmp_path / "ix"), "a", 0, 9).collect()] == ["r1"]


def test_bam(spark, tmp_path):
    """Two records, written by hand in two compressed blocks cut inside a record."""
    import gzip
    import struct

    def one(name, flag, ref, pos, cigar, seq, qual, tags):
        name = name.encode() + b"\0"
        ops = b"".join(struct.pack("<I", n << 4 | "MIDNSHP=X".index(o)) for n, o in cigar)
        codes = ["=ACMGRSVTWYHKDBN".index(c) for c in seq] + [0] * (len(seq) % 2)
        body = struct.pack("<iiBBHHHiiii", ref, pos, len(name), 60, 0, len(cigar), flag, len(seq), -1, -1, 7) + name + ops + bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True)) + bytes(qual) + tags
        return struct.pack("<i", len(body)) + body

    text = b"@SQ\tSN:c\tLN:99\n"
    raw = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", 1) + struct.pack("<i", 2) + b"c\0" + struct.pack("<i", 99)
    raw += one("r", 16, 0, 4, [(3, "M"), (2, "S")], "ACGTN", [0, 1, 2, 3, 40], b"NMC\x02XZZab\0tpBc" + struct.pack("<i", 2) + b"\xff\x03")
    raw += one("u", 4, -1, -1, [], "", [], b"")
    (tmp_path / "x.bam").write_bytes(gzip.compress(raw[:70]) + gzip.compress(raw[70:]))
    got = {r["qname"]: r for r in bam.read_bam(spark, str(tmp_path / "x.bam")).collect()}
    assert tuple(got["r"])[:11] == ("r", 16, "c", 4, 60, "3M2S", "*", -1, 7, "ACGTN", "!\"#$I")
    assert {k: tuple(v) for k, v in got["r"]["tags"].items()} == {"NM": ("i", "2"), "XZ": ("Z", "ab"), "tp": ("B", "c,-1,3")}
    assert tuple(got["u"])[:11] == ("u", 4, "*", -1, 60, "*", "*", -1, 7, "*", "*")
    assert bam.read_bam_header(spark, str(tmp_path / "x.bam")) == ["@SQ\tSN:c\tLN:99"]
