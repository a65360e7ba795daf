"""MD and NM of alignments against a reference."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from coordshift.functions.cigar import QUERY, runs
from coordshift.functions.sam import has

#: Letters of nucleotide codes (fixed values); all others count as N.
CODES = "=ACMGRSVTWYHKDBN"
CHUNK = 1 << 16
_CODE = np.full(256, CODES.index("N"), dtype=np.uint8)
for _i, _c in enumerate(CODES):
    _CODE[[ord(_c), ord(_c.lower())]] = _i
_RESULT = StructType([StructField("md", StringType()), StructField("nm", LongType())])


def md_nm(seq: str, cigar: str, reference: str) -> tuple[str, int]:
    """MD and NM of a read and the reference bases from its place on; both end where either does."""
    a, b = (np.frombuffer(x.encode("latin-1", "replace"), dtype=np.uint8) for x in (seq, reference))
    read, ref = _CODE[a], _CODE[b]
    q = r = nm = kept = 0
    out: list[str] = []
    for n, op in runs(cigar):
        if op in "M=X":
            m = max(0, min(n, len(ref) - r, len(read) - q))
            x, y = read[q : q + m], ref[r : r + m]
            unlike = np.flatnonzero(~(((x == y) & (x != CODES.index("N"))) | (x == 0)))
            for gap, at in zip(np.diff(np.append(-1, unlike)).tolist(), unlike.tolist(), strict=True):
                out.append(f"{kept + gap - 1}{reference[r + at].upper()}")
                kept = 0
            kept += m - (int(unlike[-1]) + 1 if len(unlike) else 0)
            nm += len(unlike)
            if m < n:
                break
        elif op == "D":
            gone = reference[r : r + n].upper()
            out.append(f"{kept}^{gone}")
            kept, nm = 0, nm + len(gone)
            if len(gone) < n:
                break
        elif op == "I":
            nm += n
        q += n if op in QUERY else 0
        r += n if op in "MDN=X" else 0
    return "".join(out) + str(kept), nm


@F.pandas_udf(_RESULT)
def _md(seq: pd.Series, cigar: pd.Series, reference: pd.Series) -> pd.DataFrame:
    got = [(None, None) if s is None or c is None or r is None else md_nm(s, c, r) for s, c, r in zip(seq, cigar, reference, strict=True)]
    return pd.DataFrame(got, columns=["md", "nm"]).astype({"md": object, "nm": "Int64"})


def chunks(fasta: DataFrame, width: int = CHUNK) -> DataFrame:
    """contig, chunk, piece: the letters from chunk * width on, twice as many as the width."""
    cut = fasta.select("contig", "seq", F.explode(F.sequence(F.lit(0), F.expr(f"cast((greatest(length(seq), 1) - 1) div {width} as int)"))).alias("chunk"))
    return cut.select("contig", "chunk", F.substring("seq", F.col("chunk") * width + 1, F.lit(2 * width)).alias("piece"))


def with_reference(rows: DataFrame, fasta: DataFrame, rname: str = "rname", pos: str = "pos", size: str = "rlen", width: int = CHUNK) -> DataFrame:
    """``rows`` (with a unique id) and reference: ``size`` letters from ``pos`` on, null without such a contig.

    A read meets the one chunk it begins in; longer ones than a chunk meet all
    of theirs and put them together.
    """
    pieces = chunks(fasta, width).select(F.col("contig").alias("__c"), F.col("chunk").alias("__k"), "piece")
    long_ = F.col(size) > width
    short = rows.where(~F.coalesce(long_, F.lit(False)))
    k = F.floor(F.col(pos) / width).cast("int")
    near = short.join(pieces, (short[rname] == F.col("__c")) & (k == F.col("__k")), "left")
    cut = F.substring("piece", (F.col(pos) - F.col("__k") * width + 1).cast("int"), F.col(size).cast("int"))
    near = near.select(*(short[c] for c in rows.columns), cut.alias("reference"))
    far = rows.where(long_)
    wide = far.select("id", F.col(rname).alias("__r"), F.col(pos).alias("__p"), F.explode(F.sequence(k, F.floor((F.col(pos) + F.col(size) - 1) / width).cast("int"))).alias("__i"))
    met = wide.join(pieces, (F.col("__r") == F.col("__c")) & (F.col("__i") == F.col("__k"))).groupBy("id").agg(F.min("__i").alias("__first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__i", F.substring("piece", 1, width).alias("t")))), lambda x: x["t"]), "").alias("__text"))
    far = far.join(met, "id", "left").withColumn("reference", F.substring("__text", (F.col(pos) - F.col("__first") * width + 1).cast("int"), F.col(size).cast("int")))
    return near.unionByName(far.select(*rows.columns, "reference"))


def fill(rows: DataFrame, fasta: DataFrame) -> DataFrame:
    """``rows`` (id, flag, rname, pos, rlen, seq, cigar) with md and nm of the mapped ones that have a sequence."""
    own = ~has("flag", 4) & (F.col("seq") != "*")
    got = with_reference(rows, fasta).withColumn("__md", _md(F.when(own, F.col("seq")), F.col("cigar"), F.col("reference")))
    return got.select(*rows.columns, F.col("__md.md").alias("md"), F.col("__md.nm").alias("nm"))


def as_tags(md: str | Column = "md", nm: str | Column = "nm") -> Column:
    """A map of tags as ``sources.text.read_sam`` makes it."""
    md, nm = (F.col(c) if isinstance(c, str) else c for c in (md, nm))
    entry = lambda kind, value: F.struct(F.lit(kind).alias("type"), value.cast("string").alias("value"))
    return F.create_map(F.lit("NM"), entry("i", nm), F.lit("MD"), entry("Z", md))
