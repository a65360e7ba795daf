"""Readers of text files. All go through Spark's readers, so any store it opens will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SAM_FIELDS = (("qname", "string"), ("flag", "int"), ("rname", "string"), ("pos", "long"), ("mapq", "int"), ("cigar", "string"), ("rnext", "string"), ("pnext", "long"), ("tlen", "long"), ("seq", "string"), ("qual", "string"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no (from 0), value: each block's lines are counted, and numbered from the sum of the blocks before."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    blocks = lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return lines.join(starts, ["file", "block"]).select("file", (F.col("at") - F.col("first") + F.col("before")).alias("line_no"), "value")


def read_chain(spark: SparkSession, path: str) -> DataFrame:
    """Blocks as ``operators.index`` takes them. A chain, from one header to the next, is one record, so files split between chains.

    A header without 13 fields is an error; lines before the first chain that
    start with # are left out, as are lines of other than one or three numbers.
    """
    raw = spark.read.text(path, lineSep="\nchain").select(F.trim(F.regexp_replace("value", r"^(chain)?\s+|^chain$|\s+$", "")).alias("value"))
    split = raw.where("value <> '' and value not like '#%'").select(F.split("value", r"\s*\n\s*").alias("lines"))
    head = F.split(F.col("lines")[0], r"\s+")
    sound = (F.size(head) == 12) & head[3].rlike("^[+-]$") & head[8].rlike("^[+-]$")
    # a first record may open with comments, which have been joined to no header
    head = F.when(sound, head).otherwise(F.raise_error(F.concat(F.lit("not a chain header: chain "), F.col("lines")[0])))
    rows = split.select(head.alias("h"), F.posexplode(F.expr("filter(slice(lines, 2, size(lines) - 1), x -> x rlike '^[0-9]+([ \\t]+[0-9]+[ \\t]+[0-9]+)?$')")).alias("line_no", "line"))
    part = F.split("line", r"\s+")
    named = {"s_name": 1, "d_name": 6, "chain_name": 11}
    sized = {"s_len": 2, "s_start": 4, "d_len": 7, "d_start": 9}
    return rows.select(
        F.concat(F.lit("chain "), F.array_join("h", " ")).alias("chain_id"),
        F.col("line_no").cast("long").alias("line_no"),
        *(F.col("h")[named[n]].alias(n) for n in ("s_name", "d_name")),
        *(F.col("h")[i].cast("long").alias(n) for n, i in sized.items()),
        (F.col("h")[3] == F.col("h")[8]).alias("strand"),
        *(F.get(part, F.lit(i)).cast("long").alias(n) for i, n in enumerate(("len", "ds", "dd"))),
    )


def _bed_lines(spark: SparkSession, path: str) -> DataFrame:
    part = F.split("value", r"\t")
    start, end = (F.expr(f"try_cast(get(split(value, '\\t'), {i}) as bigint)") for i in (1, 2))
    rows = spark.read.text(path).where(r"value <> '' and value not rlike '^(#|track|browser)'")
    return rows.select("value", part.alias("part"), start.alias("bed_start"), end.alias("bed_end")).withColumn("sound", (F.size("part") >= 3) & F.col("bed_start").isNotNull() & F.col("bed_end").isNotNull())


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """contig, bed_start, bed_end and extra (the other columns); lines of fewer than three fields are left out (see ``bed_faults``)."""
    return _bed_lines(spark, path).where("sound").select(F.col("part")[0].alias("contig"), "bed_start", "bed_end", F.slice("part", 4, F.greatest(F.size("part") - 3, F.lit(0))).alias("extra"))


def bed_faults(spark: SparkSession, path: str) -> DataFrame:
    """value: the lines that ``read_bed`` leaves out."""
    return _bed_lines(spark, path).where("not sound").select("value")


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignments with places counted from 0, and tags by name as (type, value)."""
    part = F.split("value", "\t")
    rows = spark.read.text(path).where("value <> '' and value not rlike '^@[A-Za-z][A-Za-z]\\t'")
    fields = [(part[i].cast(kind) - 1 if n in ("pos", "pnext") else part[i].cast(kind)).alias(n) for i, (n, kind) in enumerate(SAM_FIELDS)]
    tag = lambda t: F.struct(F.substring(t, 1, 2).alias("key"), F.struct(F.substring(t, 4, 1).alias("type"), F.regexp_replace(t, "^.....", "").alias("value")).alias("value"))
    tags = F.map_from_entries(F.transform(F.slice(part, 12, F.greatest(F.size(part) - 11, F.lit(0))), tag))
    return rows.select(*fields, tags.alias("tags"))


def read_sam_header(spark: SparkSession, path: str) -> list[str]:
    """The header lines, in order; their number is that of contigs and programs."""
    rows = spark.read.text(path).withColumn("at", F.monotonically_increasing_id()).where("value rlike '^@[A-Za-z][A-Za-z]\\t'")
    return [r["value"] for r in rows.orderBy("at").collect()]


def header_contigs(spark: SparkSession, header: list[str]) -> DataFrame:
    """name, length, ord of the @SQ lines."""
    found = [dict(f.split(":", 1) for f in line.split("\t")[1:] if ":" in f) for line in header if line.startswith("@SQ\t")]
    return spark.createDataFrame([(f["SN"], int(f.get("LN", 0)), i) for i, f in enumerate(found)], "name string, length long, ord long")


def read_fai(spark: SparkSession, path: str) -> DataFrame:
    """name, length, ord (place in the file)."""
    rows = numbered_lines(spark, path).where("value <> ''")
    part = F.split("value", "\t")
    return rows.select(part[0].alias("name"), part[1].cast("long").alias("length"), F.col("line_no").alias("ord"))


def fai_to_bed(contigs: DataFrame) -> DataFrame:
    return contigs.select(F.col("name").alias("contig"), F.lit(0).cast("long").alias("start"), F.col("length").alias("end"))


def read_fasta(spark: SparkSession, path: str, upper: bool = True) -> DataFrame:
    """contig (the name's first word), seq; a contig is one record. Compressed files are read by their ending."""
    rows = spark.read.text(path, lineSep="\n>").select(F.regexp_replace("value", "^>", "").alias("value")).where("trim(value) <> ''")
    name = F.regexp_extract("value", r"^(\S*)", 1)
    body = F.regexp_replace(F.regexp_replace("value", r"^[^\n]*(\n|$)", ""), r"\s", "")
    return rows.select(name.alias("contig"), (F.upper(body) if upper else body).alias("seq"))


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """name (without @ and what follows a blank), seq, qual: records of four lines, numbered over each file."""
    lines = numbered_lines(spark, path)
    at = F.col("line_no") % 4
    pick = lambda i: F.max(F.when(at == i, F.col("value")))
    rows = lines.groupBy("file", F.expr("line_no div 4").alias("record")).agg(pick(0).alias("head"), pick(1).alias("seq"), pick(3).alias("qual"))
    return rows.where("head <> ''").select(F.regexp_extract("head", r"^@?(\S*)", 1).alias("name"), "seq", "qual")


def read_vcf(spark: SparkSession, path: str, sample: str = "", haplotype: int = 0) -> DataFrame:
    """chrom, pos (from 0), ref, alts (array), info, allele: 1 without a sample, else its allele on the haplotype (null: missing)."""
    lines = spark.read.text(path)
    column = 9
    if sample:
        names = lines.where("value like '#CHROM%'").first()["value"].split("\t")
        if sample not in names[9:]:
            raise ValueError(f"no sample {sample!r}")
        column = names.index(sample)
    part = F.split("value", "\t")
    keys, values = F.split(part[8], ":"), F.split(part[column], ":")
    genotype = F.split(F.get(values, F.array_position(keys, F.lit("GT")).cast("int") - 1), r"[|/]")
    allele = F.lit(1) if not sample else F.get(genotype, F.lit(haplotype)).try_cast("int")
    rows = lines.where("value <> '' and value not like '#%'")
    return rows.select(part[0].alias("chrom"), (part[1].cast("long") - 1).alias("pos"), F.upper(part[3]).alias("ref"), F.split(part[4], ",").alias("alts"), part[7].alias("info"), allele.alias("allele"))


def vcf_contigs(spark: SparkSession, path: str) -> DataFrame:
    """name, length of the ##contig lines."""
    rows = spark.read.text(path).where("value like '##contig=%'")
    return rows.select(F.regexp_extract("value", r"[<,]ID=([^,>]+)", 1).alias("name"), F.regexp_extract("value", r"[<,]length=(\d+)", 1).try_cast("long").alias("length"))


def read_name_map(spark: SparkSession, path: str) -> DataFrame:
    """name, other: two columns."""
    part = F.split("value", "\t")
    return spark.read.text(path).where("value <> ''").select(part[0].alias("name"), F.trim(part[1]).alias("other"))


def read_bedgraph(spark: SparkSession, path: str, least: float = 1.0) -> DataFrame:
    """contig, start, end, mappable: the value is a finite number of at least ``least``."""
    part = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where("trim(value) <> '' and value not rlike '^(#|track|browser)'")
    value = part[3].try_cast("double")
    return rows.select(part[0].alias("contig"), part[1].cast("long").alias("start"), part[2].cast("long").alias("end"), F.coalesce((F.lower(part[3]) != "inf") & (value >= least), F.lit(False)).alias("mappable"))


def read_time_log(spark: SparkSession, path: str) -> DataFrame:
    """One row a command of logs of ``time -v``: task (program and first argument), user_s, system_s, cpu_s, wall_s, max_rss_kb."""
    key = F.when(F.contains("value", F.lit("Command being timed:")), "task")
    for text, name in (("User time (seconds):", "user_s"), ("System time (seconds):", "system_s"), ("Elapsed (wall clock) time", "wall_s"), ("Maximum resident set size (kbytes):", "max_rss_kb")):
        key = key.when(F.contains("value", F.lit(text)), name)
    lines = numbered_lines(spark, path).withColumn("key", key).where("key is not null")
    upto = Window.partitionBy("file").orderBy("line_no")
    lines = lines.withColumn("run", F.sum((F.col("key") == "task").cast("int")).over(upto))
    pick = lambda c: F.max(F.when(F.col("key") == c, F.col("value")))
    rows = lines.groupBy("file", "run").agg(*(pick(c).alias(c) for c in ("task", "user_s", "system_s", "wall_s", "max_rss_kb")))
    words = F.split(F.regexp_extract("task", r'"(.*)"', 1), r"\s+")
    last = lambda c: F.trim(F.element_at(F.split(c, r"\):|\): "), -1))
    clock = F.split(last("wall_s"), ":")
    wall = F.aggregate(clock, F.lit(0.0), lambda acc, x: acc * 60 + x.cast("double"))
    user, system = last("user_s").cast("double"), last("system_s").cast("double")
    return rows.where("max_rss_kb is not null").select(F.concat(F.element_at(F.split(words[0], "/"), -1), F.lit("_"), F.coalesce(F.get(words, F.lit(1)), F.lit(""))).alias("task"), user.alias("user_s"), system.alias("system_s"), (user + system).alias("cpu_s"), wall.alias("wall_s"), last("max_rss_kb").cast("long").alias("max_rss_kb"))


def read_chain_summary(spark: SparkSession, path: str) -> DataFrame:
    """Columns as ``operators.summary.chain_identity`` makes them, of a table with a heading."""
    rows = spark.read.csv(path, sep="\t", header=True)
    kinds = {"size": "long", "hdist": "double", "s_start": "long", "s_end": "long", "d_start": "long", "d_end": "long"}
    return rows.select(*(F.col(c).cast(kinds.get(c.lower(), "string")).alias(c.lower()) for c in rows.columns))


def read_config(spark: SparkSession, path: str) -> dict[str, str]:
    """Names and values of a flat configuration: indented "name: value" lines, # starts a comment."""
    out = {}
    for r in spark.read.text(path).collect():  # a settings file
        name, colon, value = r["value"].partition("#")[0].partition(":")
        if colon and value.strip():
            out[name.strip()] = value.strip().strip("\"'")
    return out
