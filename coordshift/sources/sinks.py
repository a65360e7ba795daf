"""Writers. Each writes a folder of part files; a header is a file of its own that sorts before them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coordshift.functions.sam import forward_read, has, primary
from coordshift.sources.text import SAM_FIELDS


def rewritten_header(header: list[str], contigs: list[tuple[str, int]], command: str = "", name: str = "coordshift", version: str = "1") -> list[str]:
    """The header with the destination's contigs, in their order, in place of the old ones, and a @PG line."""
    old = [line for line in header if not line.startswith("@SQ\t")]
    first = [line for line in old if line.startswith("@HD\t")]
    programs = [line for line in old if line.startswith("@PG\t")]
    last = next((f[3:] for f in programs[-1].split("\t") if f.startswith("ID:")), "") if programs else ""
    taken = {f[3:] for line in programs for f in line.split("\t") if f.startswith("ID:")}
    own = next(n for n in [name, *(f"{name}.{i}" for i in range(1, len(taken) + 2))] if n not in taken)
    added = "\t".join(["@PG", f"ID:{own}", f"PN:{name}", *([f"PP:{last}"] if last else []), f"VN:{version}", *([f"CL:{command}"] if command else [])])
    return [*first, *(f"@SQ\tSN:{n}\tLN:{size}" for n, size in contigs), *(line for line in old if line not in first), added]


def sam_line(tags: str = "tags") -> Column:
    """The text of a record as ``sources.text.read_sam`` reads it."""
    fields = [(F.col(n) + 1 if n in ("pos", "pnext") else F.col(n)).cast("string") for n, _ in SAM_FIELDS]
    same = F.when((F.col("rnext") == F.col("rname")) & (F.col("rnext") != "*"), "=").otherwise(F.col("rnext"))
    fields[6] = same
    each = F.transform(F.map_entries(tags), lambda e: F.concat_ws(":", e["key"], e["value"]["type"], e["value"]["value"]))
    return F.concat_ws("\t", *fields, F.when(F.size(each) > 0, F.array_join(each, "\t")))


def write_sam(rows: DataFrame, path: str, header: list[str]) -> None:
    """``path``/header and ``path``/records: in this order, a SAM file."""
    spark = rows.sparkSession
    spark.createDataFrame([("\n".join(header),)], "value string").where("value <> ''").coalesce(1).write.mode("overwrite").text(f"{path}/header")
    rows.select(sam_line().alias("value")).write.mode("overwrite").text(f"{path}/records")


def read_written_sam(spark: SparkSession, path: str) -> tuple[list[str], DataFrame]:
    from coordshift.sources.text import read_sam, read_sam_header

    return read_sam_header(spark, f"{path}/header"), read_sam(spark, f"{path}/records")


def write_split(routed: DataFrame, prefix: str, header: list[str], source_header: list[str]) -> None:
    """Committed and deferred lifted records and unliftable original ones, of rows with those three marks and a struct column original."""
    own = [n for n, _ in SAM_FIELDS] + ["tags"]
    write_sam(routed.where("committed").select(*own), f"{prefix}-committed.sam", header)
    write_sam(routed.where("deferred").where(primary("flag")).select(*own), f"{prefix}-deferred.sam", header)
    write_sam(routed.where("unliftable").select("original.*").select(*own), f"{prefix}-unliftable.sam", source_header)


def fastq_record(name: str = "qname", seq: str = "seq", qual: str = "qual", flag: str = "flag") -> Column:
    """A read as it came from the sequencer; a missing quality is written as B's."""
    quality = F.when(F.col(qual) == "*", F.repeat(F.lit("B"), F.length(seq))).otherwise(F.when(has(flag, 16), F.reverse(qual)).otherwise(F.col(qual)))
    return F.concat(F.lit("@"), F.col(name), F.lit("\n"), forward_read(seq, flag), F.lit("\n+\n"), quality)


def write_fastq(rows: DataFrame, path: str) -> None:
    rows.select(fastq_record().alias("value")).write.mode("overwrite").text(path, compression="gzip")


def write_bed(lifted: DataFrame, prefix: str) -> None:
    """``prefix``.bed with the lifted rows of ``operators.lift.lift_bed``, ``prefix``-unmapped.bed with the others and where they went."""
    text = lambda *c: F.concat_ws("\t", *(F.col(x).cast("string") for x in c), F.when(F.size("extra") > 0, F.array_join("extra", "\t")))
    note = F.concat(F.lit("\t# "), F.col("t1"), F.lit(":"), F.col("op1").cast("string"), F.lit("-"), F.col("t2"), F.lit(":"), F.col("op2").cast("string"))
    lifted.where("ok").select(text("t1", "op1", "op2").alias("value")).write.mode("overwrite").text(f"{prefix}.bed")
    lifted.where("not ok").select(F.concat(text("contig", "bed_start", "bed_end"), note).alias("value")).write.mode("overwrite").text(f"{prefix}-unmapped.bed")


def write_intervals(rows: DataFrame, path: str) -> None:
    rows.select(F.concat_ws("\t", "contig", F.col("start").cast("string"), F.col("end").cast("string")).alias("value")).write.mode("overwrite").text(path)


def write_fasta(fasta: DataFrame, path: str, width: int = 60) -> None:
    """Sequences in lines of ``width`` letters."""
    body = F.regexp_replace(F.regexp_replace("seq", f"(.{{{width}}})", "$1\n"), "\n$", "")
    fasta.select(F.concat(F.lit(">"), F.col("contig"), F.lit("\n"), body).alias("value")).write.mode("overwrite").text(path)


def write_vcf(rows: DataFrame, path: str) -> None:
    """Records of ``operators.chains.to_vcf`` below a heading in a file of its own."""
    spark = rows.sparkSession
    names = [r["contig"] for r in rows.select("contig").distinct().orderBy("contig").collect()]  # contigs
    head = ["##fileformat=VCFv4.3", '##FILTER=<ID=AUTO,Description="Generated automatically.">', *(f"##contig=<ID={n}>" for n in names), '##INFO=<ID=TPOS,Number=A,Type=Integer,Description="Variant position on SEQ_T.">', '##INFO=<ID=ALN_DT,Number=A,Type=Integer,Description="Length of gap on SEQ_T.">', '##INFO=<ID=ALN_DQ,Number=A,Type=Integer,Description="Length of gap on SEQ_Q.">', "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO"]
    spark.createDataFrame([("\n".join(head),)], "value string").write.mode("overwrite").text(f"{path}/header")
    rows.select(F.concat_ws("\t", "contig", F.col("pos").cast("string"), F.lit("."), "ref", "alt", F.lit("."), F.lit("AUTO"), "info").alias("value")).write.mode("overwrite").text(f"{path}/records")


def coordinate_sorted(rows: DataFrame, contigs: DataFrame) -> DataFrame:
    """Records by the contigs' order in the header and place; those without a contig last."""
    order = F.broadcast(contigs.select(F.col("name").alias("__name"), F.col("ord").alias("__ord")))
    placed = rows.join(order, F.col("rname") == F.col("__name"), "left").withColumn("__ord", F.coalesce("__ord", F.lit((1 << 62))))
    return placed.orderBy("__ord", "pos", "flag", "qname").drop("__name", "__ord")


def name_sorted(rows: DataFrame) -> DataFrame:
    return rows.orderBy("qname", "flag")


def merged_sorted(parts: list[DataFrame], contigs: DataFrame) -> DataFrame:
    """Records of several inputs in the order of ``coordinate_sorted``."""
    first, *rest = parts
    for p in rest:
        first = first.unionByName(p, allowMissingColumns=True)
    return coordinate_sorted(first, contigs)


def write_indexed(rows: DataFrame, path: str, contigs: DataFrame) -> None:
    """Sorted records as Parquet: files hold ranges of places, which their statistics index."""
    coordinate_sorted(rows, contigs).write.mode("overwrite").parquet(path)


def read_region(spark: SparkSession, path: str, contig: str, start: int, end: int) -> DataFrame:
    """Records of ``write_indexed`` that begin in a region; files out of it are skipped by their statistics."""
    return spark.read.parquet(path).where((F.col("rname") == contig) & (F.col("pos") >= start) & (F.col("pos") < end))
