"""Global realignment with affine gaps, in a band."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from coordshift.functions import md
from coordshift.functions.cigar import joined, reference_length, render
from coordshift.functions.sam import has, unmap_self

_LOW = -(1 << 30)
#: Cells that are filled side by side.
TOGETHER = 1 << 20
_CODE = np.full(256, 4, dtype=np.uint8)
for _i, _c in enumerate("ACGT"):
    _CODE[[ord(_c), ord(_c.lower())]] = _i


@dataclass(frozen=True)
class Settings:
    """Scores: match a, mismatch -|b|, gap q + e * n or q2 + e2 * n; reads of more than nm_threshold edits are realigned."""

    engine: str = "ksw_extz2_sse"
    nm_threshold: int = 15
    a: int = 2
    b: int = 4
    q: int = 4
    e: int = 2
    q2: int = 24
    e2: int = 1
    w: int = 601
    zdrop: int = 400

    @property
    def dual(self) -> bool:
        return self.engine == "ksw_extd2_sse"

    @classmethod
    def of(cls, given: dict[str, str]) -> Settings:
        """Settings with those of a configuration in place of the defaults."""
        known = {k: v if k == "engine" else int(v, 0) for k, v in given.items() if k in cls.__dataclass_fields__}
        return replace(cls(), **known)


_PACBIO = Settings("ksw_extd2_sse", 200, 0, 4, 6, 2, 26, 1)
_ONT = Settings("ksw_extd2_sse", 200, 2, 4, 4, 2, 24, 1)
#: Values of the presets (fixed values).
PRESETS = {
    "default": Settings(),
    "bowtie2": Settings("ksw_extz2_sse", 5, 0, 2, 5, 3),
    "pacbio": _PACBIO,
    "pacbio_all": replace(_PACBIO, nm_threshold=0),
    "ont": _ONT,
    "ont_all": replace(_ONT, nm_threshold=0),
}


def align_many(references: list[str], reads: list[str], s: Settings) -> list[tuple[str, int]]:
    """``align`` of each pair; pairs of equal lengths are filled side by side."""
    out: list = [("", 0)] * len(reads)
    groups: dict[tuple[int, int], list[int]] = {}
    for k, (t, x) in enumerate(zip(references, reads, strict=True)):
        groups.setdefault((len(t), len(x)), []).append(k)
    for (n, m), own in groups.items():
        if n and m:
            step = max(1, TOGETHER // (n * (m + 1)))
            for i in range(0, len(own), step):
                part = own[i : i + step]
                for k, got in zip(part, _align([references[k] for k in part], [reads[k] for k in part], s), strict=True):
                    out[k] = got
    return out


def align(reference: str, read: str, s: Settings) -> tuple[str, int]:
    """CIGAR and score of the best alignment of both whole sequences; ends of insertions are clips."""
    return align_many([reference], [read], s)[0]


def _align(references: list[str], reads: list[str], s: Settings) -> list[tuple[str, int]]:
    """Alignments of pairs of equal lengths.

    Rows of the references are filled whole: a gap in the read opens from the
    row before, one in the reference is a running maximum along the row.
    """
    t, x = (np.stack([_CODE[np.frombuffer(v.encode("latin-1", "replace"), dtype=np.uint8)] for v in c]) for c in (references, reads))
    k_, n, m = len(t), t.shape[1], x.shape[1]
    costs = [(s.q, s.e), *([(s.q2, s.e2)] if s.dual else [])]
    place = np.arange(m + 1, dtype=np.int64)
    gap = lambda k: -min(q + e * k for q, e in costs)
    h = np.array([0, *(gap(k) for k in range(1, m + 1))], dtype=np.int64)
    h[s.w + 1 :] = _LOW
    down = [np.tile(np.where(place <= s.w, h - q - e, _LOW), (k_, 1)) for q, e in costs]
    h = np.tile(h, (k_, 1))
    # per cell: what made it (0 pair, 1.. gaps in the read, then gaps in the reference) and which gaps were longer ones
    made = np.zeros((n, k_, m + 1), dtype=np.uint8)
    longer = np.zeros((n, k_, m + 1), dtype=np.uint8)
    best, best_i, best_j = (np.full(k_, v, dtype=np.int64) for v in (0, -1, -1))
    # where a pair is cut short, and whether it was
    end_i, end_j, cut = np.full(k_, n - 1), np.full(k_, m), np.zeros(k_, dtype=bool)
    every = np.arange(k_)
    for i in range(n):
        lo, hi = max(0, i + 1 - s.w - 1), min(m, i + 1 + s.w)
        base = t[:, i, None]
        like = np.where((x == 4) | (base == 4), 0, np.where(x == base, s.a, -abs(s.b)))
        new = np.full((k_, m + 1), _LOW, dtype=np.int64)
        new[:, 1:] = h[:, :-1] + like
        new[:, 0] = gap(i + 1)
        src = np.zeros((k_, m + 1), dtype=np.uint8)
        for k, d in enumerate(down):
            better = d > new
            better[:, 0] = False
            src[better] = 1 + k
            new = np.where(better, d, new)
        outside = (place < lo) | (place > hi)
        new[:, outside] = _LOW
        across = []
        for q, e in costs:
            run = np.maximum.accumulate(new - q + e * place, axis=1)
            f = np.full((k_, m + 1), _LOW, dtype=np.int64)
            f[:, 1:] = run[:, :-1] - e * place[1:]
            across.append(f)
        for k, f in enumerate(across):
            better = f > new
            better[:, 0] = False
            src[better] = 1 + len(costs) + k
            new = np.where(better, f, new)
        new[:, outside] = _LOW
        bits = np.zeros((k_, m + 1), dtype=np.uint8)
        for k, (q, e) in enumerate(costs):
            bits |= (down[k] - e > new - q - e).astype(np.uint8) << k
            bits |= (across[k] - e > new - q - e).astype(np.uint8) << (len(costs) + k)
            down[k] = np.maximum(down[k] - e, new - q - e)
            down[k][:, outside] = _LOW
        made[i], longer[i] = src, bits
        h = new
        j = np.argmax(new[:, 1:], axis=1) + 1
        top = new[every, j]
        up = ~cut & (top > best)
        if s.zdrop >= 0:
            fallen = ~cut & ~up & (best_i >= 0) & (j >= best_j) & (best - top > s.zdrop + np.abs((i - best_i) - (j - best_j)) * s.e)
            end_i[fallen], end_j[fallen] = best_i[fallen], best_j[fallen]
            cut |= fallen
        best[up], best_i[up], best_j[up] = top[up], i, j[up]
        if cut.all():
            break
    whole = (end_i == n - 1) & (end_j == m)
    scores = np.where(whole, h[:, m], best)
    return [(_path(made[:, k], longer[:, k], int(end_i[k]), int(end_j[k]), len(costs)), int(scores[k])) for k in range(k_)]


def _path(made: np.ndarray, longer: np.ndarray, i: int, j: int, kinds: int) -> str:
    """The CIGAR that leads to a cell."""
    state = 0
    path: list[list] = []
    while i >= 0 and j > 0:
        if state and not longer[i, j] >> (state - 1) & 1:
            state = 0
        state = state or int(made[i, j])
        if state == 0:
            path.append([1, "M"])
            i, j = i - 1, j - 1
        elif state <= kinds:
            path.append([1, "D"])
            i -= 1
        else:
            path.append([1, "I"])
            j -= 1
    path += [[i + 1, "D"]] if i >= 0 else []
    path += [[j, "I"]] if j > 0 else []
    ops = joined(joined_runs(path[::-1]))
    for k in (0, -1):
        if ops and ops[k][1] == "I":
            ops[k] = [ops[k][0], "S"]
    return render(ops)


def joined_runs(path: list[list]) -> list[list]:
    out: list[list] = []
    for n, op in path:
        if out and out[-1][1] == op:
            out[-1][0] += n
        else:
            out.append([n, op])
    return out


def realign(rows: DataFrame, fasta: DataFrame, settings: Settings) -> DataFrame:
    """``rows`` (id, flag, rname, pos, cigar, seq, nm, md) with new cigar, md, nm and lr (the score) where nm is above the threshold.

    Other rows keep theirs; a read that aligns to nothing is unmapped.
    """
    picked = ~has("flag", 4) & F.coalesce(F.col("nm") > settings.nm_threshold, F.lit(False)) & (F.col("seq") != "*")
    result = StructType([StructField("cigar", StringType()), StructField("md", StringType()), StructField("nm", LongType()), StructField("lr", LongType())])

    @F.pandas_udf(result)
    def run(seq: pd.Series, reference: pd.Series) -> pd.DataFrame:
        out = []
        for a, b, (cigar, score) in zip(seq, reference, align_many([b or "" for b in reference], seq.tolist(), settings), strict=True):
            out.append((cigar, *md.md_nm(a, cigar, b or ""), score) if cigar else ("", None, None, None))
        return pd.DataFrame(out, columns=["cigar", "md", "nm", "lr"]).astype({"cigar": object, "md": object, "nm": "Int64", "lr": "Int64"})

    chosen = md.with_reference(rows.where(picked).withColumn("__size", reference_length("cigar")), fasta, size="__size")
    done = chosen.withColumn("__new", run("seq", "reference"))
    lost = F.col("__new.cigar") == ""
    new = {"cigar": F.when(lost, "*").otherwise(F.col("__new.cigar")), "md": F.col("__new.md"), "nm": F.col("__new.nm").cast(rows.schema["nm"].dataType), "flag": F.when(lost, unmap_self("flag")).otherwise(F.col("flag"))}
    done = done.select(*(new.get(c, F.col(c)).alias(c) for c in rows.columns), F.col("__new.lr").alias("lr"))
    return rows.where(~picked).withColumn("lr", F.lit(None).cast("long")).unionByName(done)
