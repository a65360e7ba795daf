"""Lifting from a personalised sequence to its reference by the variants between them."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from coordshift.functions.cigar import expand_runs, render, runs
from coordshift.functions.realign import joined_runs
from coordshift.operators.asof import shared_folder
from coordshift.operators.index import BASES, sums_before

#: Pieces that are sent to every executor at most.
SEARCHED = 4_000_000


def kind_of(ref: Column, alt: Column) -> Column:
    """snp, indel or other; an indel adds or takes bases at one place."""
    short = F.when(F.length(ref) < F.length(alt), ref).otherwise(alt)
    wide = F.when(F.length(ref) < F.length(alt), alt).otherwise(ref)
    m = F.length(short)
    fits = F.exists(F.sequence(F.lit(0), m), lambda i: (F.substring(wide, F.lit(1), i) == F.substring(short, F.lit(1), i)) & (F.substring(wide, F.length(wide) - (m - i) + 1, m - i) == F.substring(short, i + 1, m - i)))
    plain = ~alt.startswith("<") & (alt != "*")
    return F.when(plain & (F.length(ref) == 1) & (F.length(alt) == 1) & (ref != alt), "snp").when(plain & (F.length(ref) != F.length(alt)) & fits, "indel").otherwise("other")


def accepted(variants: DataFrame) -> DataFrame:
    """chrom, pos, kind, change (bases gained, or lost below 0) of the variants (as ``sources.text.read_vcf`` gives them) that the haplotype has and that don't overlap one before.

    Only variants that reach into each other decide on each other: runs of them
    are folded on their own. A variant that starts on the last base of the one
    before is kept if its first base is an anchor.
    """
    own = variants.where("allele > 0 and allele <= size(alts)").withColumn("alt", F.upper(F.element_at("alts", F.col("allele"))))
    end = F.regexp_extract(F.coalesce("info", F.lit("")), r"(?:^|;)END=(\d+)", 1).try_cast("long") - 1
    last = F.when(F.col("alt").startswith("<"), F.coalesce(end, F.col("pos") + F.length("ref") - 1)).otherwise(F.col("pos") + F.length("ref") - 1)
    kind = kind_of(F.col("ref"), F.col("alt"))
    anchored = (kind == "indel") | F.col("alt").startswith("<DEL>") | F.col("alt").startswith("<INS")
    own = own.select("chrom", "pos", last.alias("last"), kind.alias("kind"), anchored.alias("anchored"), (F.length("alt") - F.length("ref")).cast("long").alias("change"))
    order = Window.partitionBy("chrom").orderBy("pos", "last", "kind", "change")
    reach = F.greatest(F.coalesce(F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), F.lit(0))
    runs_ = own.withColumn("__new", (F.col("pos") > reach).cast("long")).withColumn("run", F.sum("__new").over(order))
    rows = runs_.groupBy("chrom", "run").agg(F.array_sort(F.collect_list(F.struct("pos", "last", "kind", "change", "anchored"))).alias("v"))
    state = F.struct(F.lit(0).cast("long").alias("reach"), F.filter("v", lambda x: F.lit(False)).alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        fits = (x["pos"] > acc["reach"]) | ((x["pos"] == acc["reach"]) & x["anchored"])
        return F.struct(F.when(fits, x["last"]).otherwise(acc["reach"]).alias("reach"), F.when(fits, F.concat(acc["kept"], F.array(x))).otherwise(acc["kept"]).alias("kept"))

    kept = rows.select("chrom", F.explode(F.aggregate("v", state, step, lambda acc: acc["kept"])).alias("x"))
    return kept.select("chrom", "x.pos", "x.kind", "x.change")


def pieces(kept: DataFrame) -> DataFrame:
    """contig, start (in the personalised sequence), source (in the reference), moves: stretches where places rise together, or stay (insertions)."""
    events = sums_before(kept.where("kind = 'indel'"), ["chrom"], "pos", BASES, before=F.col("change"))
    at = F.col("pos") + 1
    here = events.select(F.col("chrom").alias("contig"), "change", at.alias("at"), (at + F.col("before")).alias("start"))
    gain = F.struct(F.col("start"), F.col("at").alias("source"), F.lit(False).alias("moves"))
    after = F.struct((F.col("start") + F.greatest("change", F.lit(0))).alias("start"), (F.col("at") - F.least("change", F.lit(0))).alias("source"), F.lit(True).alias("moves"))
    cut = here.select("contig", F.explode(F.when(F.col("change") > 0, F.array(gain, after)).otherwise(F.array(after))).alias("x")).select("contig", "x.*")
    zero = kept.select(F.col("chrom").alias("contig")).distinct().select("contig", F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("source"), F.lit(True).alias("moves"))
    return zero.union(cut)


class Lookup:
    """Pieces as sorted arrays on every executor."""

    def __init__(self, rows: DataFrame, most: int = SEARCHED):
        table = rows.limit(most + 1).toArrow()
        if table.num_rows > most:
            raise ValueError(f"more than {most} pieces: lift by contigs")
        frame = table.to_pandas().sort_values(["contig", "start", "source", "moves"], kind="stable")
        found = {str(k): tuple(g[c].to_numpy() for c in ("start", "source", "moves")) for k, g in frame.groupby("contig")}
        self.shared = rows.sparkSession.sparkContext.broadcast(found)

    def place(self, contig: Column, pos: Column) -> Column:
        """The place in the reference; the place itself on a contig without variants."""
        shared = self.shared

        @F.arrow_udf("bigint")
        def run(names: pa.Array, places: pa.Array) -> pa.Array:
            at = places.fill_null(-1).to_numpy(zero_copy_only=False)
            out = at.copy()
            coded = names.dictionary_encode()
            which = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            for i, name in enumerate(coded.dictionary.to_pylist()):
                if name in shared.value:
                    start, source, moves = shared.value[name]
                    rows = np.flatnonzero((which == i) & (at >= 0))
                    k = np.searchsorted(start, at[rows], side="right") - 1
                    out[rows] = source[k] + np.where(moves[k], at[rows] - start[k], 0)
            return pa.array(out, mask=places.is_null().to_numpy(zero_copy_only=False))

        return run(contig, pos.cast("long"))

    def cigar(self, contig: Column, pos: Column, cigar: Column) -> Column:
        shared = self.shared

        @F.pandas_udf(StringType())
        def run(names: pd.Series, places: pd.Series, cigars: pd.Series) -> pd.Series:
            return pd.Series([c if c is None or n not in shared.value else lift_cigar(c, int(p), *shared.value[n]) for n, p, c in zip(names, places, cigars, strict=True)], dtype=object)

        return run(contig, pos, cigar)


def lift_places(rows: DataFrame, found: DataFrame, contig: str = "contig", pos: str = "pos", most: int = SEARCHED, width: int = 1 << 14) -> DataFrame:
    """``rows`` with lifted, as ``Lookup.place`` gives it, for any number of pieces (``found``).

    More than ``most`` meet the distinct places in buckets of ``width`` bases, each opened by the last piece before it.
    """
    # variants are folded once: the pieces are read several times
    path = f"{shared_folder(rows.sparkSession)}/pieces-{uuid.uuid4().hex}"
    found.write.parquet(path)
    found = rows.sparkSession.read.schema(found.schema).parquet(path)
    if found.count() <= most:
        return rows.withColumn("lifted", Lookup(found, most).place(F.col(contig), F.col(pos)))
    names = ("start", "source", "moves")
    bucket = F.floor(F.col("at") / width).cast("long").alias("bucket")
    own = found.select("contig", F.col("start").alias("at"), *names).select("contig", bucket, "at", F.lit(0).alias("kind"), F.struct(*names).alias("x"))
    none = F.lit(None).cast(own.schema["x"].dataType)
    places = rows.select(F.col(contig).alias("contig"), F.col(pos).cast("long").alias("at")).where("at >= 0").distinct().select("contig", bucket, "at", F.lit(1).alias("kind"), none.alias("x"))
    asked = places.select("contig", "bucket").distinct()
    tops = own.groupBy("contig", "bucket").agg(F.max("x").alias("x"), F.lit(False).alias("asked")).union(asked.select("contig", "bucket", none.alias("x"), F.lit(True)))
    before = Window.partitionBy("contig").orderBy("bucket").rangeBetween(Window.unboundedPreceding, -1)
    opening = tops.withColumn("x", F.max("x").over(before)).where("asked").select("contig", "bucket", F.lit(-1).cast("long").alias("at"), F.lit(0).alias("kind"), "x")
    w = Window.partitionBy("contig", "bucket").orderBy("at", "kind", "x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = own.join(asked, ["contig", "bucket"], "left_semi").union(opening).union(places)
    met = met.withColumn("x", F.last("x", ignorenulls=True).over(w)).where("kind = 1").select(F.col("contig").alias("__contig"), F.col("at").alias("__at"), "x")
    x, at = F.col("x"), F.col(pos).cast("long")
    joined = rows.join(met, (F.col(contig) == F.col("__contig")) & (at == F.col("__at")), "left")
    lifted = F.when(x.isNull(), at).otherwise(x["source"] + F.when(x["moves"], at - x["start"]).otherwise(0))
    return joined.select(*(rows[c] for c in rows.columns), lifted.alias("lifted"))


def columns(pos: int, size: int, start: np.ndarray, source: np.ndarray, moves: np.ndarray) -> str:
    """How the two sequences stand from a base of the personalised one on, for ``size`` of its bases: "=" both, "+" only it, "-" only the reference."""
    k = int(np.searchsorted(start, pos, side="right")) - 1
    out, at = [], pos
    while at < pos + size:
        stop = int(start[k + 1]) if k + 1 < len(start) else pos + size
        n = min(stop, pos + size) - at
        out.append(("=" if moves[k] else "+") * n)
        at += n
        if k + 1 < len(start) and at == stop:
            reached = int(source[k]) + (stop - int(start[k]) if moves[k] else 0)
            out.append("-" * (int(source[k + 1]) - reached))
            k += 1
    return "".join(out)


def lift_cigar(cigar: str, pos: int, start: np.ndarray, source: np.ndarray, moves: np.ndarray) -> str:
    """The CIGAR against the reference of a read aligned to the personalised sequence.

    Both alignments are composed base by base. A base of the read alone and one
    of the reference alone that stand side by side make a match; a skip goes on
    over lost bases.
    """
    ops = expand_runs(runs(cigar))
    if not ops:
        return cigar
    stand = columns(pos, sum(op in "MDN=X" for op in ops) + 1, start, source, moves)
    out: list[str] = []

    def put(op: str, meets: str) -> None:
        if out and out[-1] in meets:
            out[-1] = "M"
        else:
            out.append(op)

    x = 0
    for op in ops:
        while stand[x : x + 1] == "-":
            put("N" if out and out[-1] == "N" else "D", "I")
            x += 1
        if op in "SHP":
            out.append(op)
        elif op == "I":
            put("I", "D")
        else:
            gained = stand[x : x + 1] == "+"
            x += 1
            if op in "M=X" and gained:
                put("I", "D")
            elif op in "M=X":
                out.append("M")
            elif not gained:
                put(op, "I")
    return render(joined_runs([[1, op] for op in out]))


def lift_alignments(aln: DataFrame, kept: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """``aln`` (flag, rname, pos, cigar, rnext, pnext, tlen) against the reference: new_pos, new_cigar, new_pnext, new_tlen, and new_rname by the name map.

    Every mapped read can be lifted; unmapped ones keep their values.
    """
    find = Lookup(pieces(kept))
    from coordshift.functions.sam import has

    mapped, mate = ~has("flag", 4), has("flag", 1) & ~has("flag", 8)
    got = aln.withColumn("new_pos", F.when(mapped, find.place(F.col("rname"), F.col("pos"))).otherwise(F.col("pos")))
    got = got.withColumn("new_pnext", F.when(mate, find.place(F.col("rnext"), F.col("pnext"))).otherwise(F.col("pnext")))
    got = got.withColumn("new_cigar", F.when(mapped, find.cigar(F.col("rname"), F.col("pos"), F.when(mapped, F.col("cigar")))).otherwise(F.col("cigar")))
    both = mapped & mate
    got = got.withColumn("new_tlen", F.when(both, F.col("tlen") + (F.col("new_pnext") - F.col("pnext")) - (F.col("new_pos") - F.col("pos"))).otherwise(F.col("tlen")))
    return lift_contigs(got, names) if names is not None else got.withColumn("new_rname", F.col("rname"))


def lift_contigs(rows: DataFrame, names: DataFrame) -> DataFrame:
    """``rows`` with new_rname: the other name of the map, or the same."""
    other = names.select(F.col("name").alias("__name"), F.col("other").alias("__other"))
    return rows.join(other, F.col("rname") == F.col("__name"), "left").withColumn("new_rname", F.coalesce("__other", "rname")).drop("__name", "__other")


def source_lengths(kept: DataFrame, contigs: DataFrame) -> DataFrame:
    """name, length, personal: lengths of the reference's contigs and of the personalised ones."""
    change = kept.where("kind = 'indel'").groupBy(F.col("chrom").alias("name")).agg(F.sum("change").alias("change"))
    return contigs.select("name", "length").join(change, "name", "left").select("name", "length", (F.col("length") + F.coalesce("change", F.lit(0))).alias("personal"))


def to_bed(variants: DataFrame) -> DataFrame:
    """contig, start, end of each allele, merged: the bases lost after the first one, or as many as the other allele has."""
    from coordshift.operators.overlap import merge

    each = variants.select("chrom", "pos", F.length("ref").alias("r"), F.explode("alts").alias("alt")).withColumn("a", F.length("alt"))
    lost = F.col("r") > F.col("a")
    return merge(each.select(F.col("chrom").alias("contig"), (F.col("pos") + lost.cast("long")).alias("start"), (F.col("pos") + F.greatest("r", "a")).alias("end")))


def lift_from_file(spark, path: str, sample: str = "", haplotype: int = 0) -> DataFrame:
    """The accepted variants of a file, of the haplotype (0 or 1) of a sample, or of all records without one."""
    from coordshift.sources.text import read_vcf

    if haplotype not in (0, 1):
        raise ValueError("the haplotype is 0 or 1")
    return accepted(read_vcf(spark, path, sample, haplotype))


def write_index(kept: DataFrame, path: str) -> None:
    pieces(kept).write.mode("overwrite").parquet(path)


def read_index(spark, path: str) -> DataFrame:
    """``pieces`` as ``write_index`` wrote them, for ``Lookup``."""
    return spark.read.parquet(path)
