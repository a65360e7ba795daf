"""Column functions over alignment fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: IUPAC codes and their complements (fixed values).
BASES, COMPLEMENTS = "ACGTMRWSYKVHDBN", "TGCAKYWSRMBDHVN"


def has(flag: str | Column, bits: int) -> Column:
    flag = F.col(flag) if isinstance(flag, str) else flag
    return flag.bitwiseAND(bits) != 0


def reverse_complement(seq: str | Column) -> Column:
    return F.translate(F.reverse(seq), BASES, COMPLEMENTS)


def forward_read(seq: str, flag: str) -> Column:
    """SEQ as it came from the sequencer."""
    return F.when(has(flag, 16), reverse_complement(seq)).otherwise(F.col(seq))


def unmap_self(flag: str) -> Column:
    return F.col(flag).bitwiseOR(4).bitwiseAND(~(2 | 16))


def unmap_mate(flag: str) -> Column:
    return F.col(flag).bitwiseOR(8).bitwiseAND(~(2 | 32))


def primary(flag: str | Column) -> Column:
    """Not secondary, failed, duplicate or supplementary."""
    return ~has(flag, 256 | 512 | 1024 | 2048)


def passes_flags(flag: str, include: list[int], exclude: list[int]) -> Column:
    out = F.lit(True)
    for b in include:
        out = out & has(flag, b)
    for b in exclude:
        out = out & ~has(flag, b)
    return out


def turned(before: str, after: str) -> Column:
    return has(F.col(before).bitwiseXOR(F.col(after)), 16)


def region_to_bed(region: str | Column) -> tuple[Column, Column, Column]:
    """contig, start, end (0-based) of "contig:from-to" (1-based)."""
    m = r"^(.*):(\d+)-(\d+)$"
    return F.regexp_extract(region, m, 1), F.regexp_extract(region, m, 2).cast("long") - 1, F.regexp_extract(region, m, 3).cast("long")


def ultima_tags(tp: str, t0: str) -> tuple[Column, Column]:
    """Both tags are turned around whatever the strand."""
    return F.reverse(tp), F.reverse(t0)


def ids_of(spec: str) -> list[str]:
    """"1-3,7" as a list of ids."""
    out: list[str] = []
    for part in filter(None, spec.split(",")):
        low, _, high = part.partition("-")
        out += [str(i) for i in range(int(low), int(high or low) + 1)]
    return out


def reversed_array(value: str | Column) -> Column:
    """The value of a B tag, "c,1,2", with its elements from the last to the first."""
    value = F.col(value) if isinstance(value, str) else value
    parts = F.split(value, ",")
    return F.array_join(F.concat(F.slice(parts, 1, 1), F.reverse(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))))), ",")


def masked_complement(seq: str | Column) -> Column:
    """Reverse complement of upper-cased A, C, G and T; all other letters become N."""
    seq = F.col(seq) if isinstance(seq, str) else seq
    return F.translate(F.reverse(F.regexp_replace(F.upper(seq), "[^ACGT]", "N")), "ACGT", "TGCA")


def without_tags(tags: str | Column, names: list[str]) -> Column:
    return F.map_filter(tags, lambda k, _: ~k.isin(*names))


def mate_reference_length(tags: str, seq: str) -> Column:
    """Reference length of the mate's CIGAR (tag MC), or the read's own length."""
    from coordshift.functions.cigar import reference_length

    mc = F.col(tags)["MC"]["value"]
    own = F.when(F.col(seq) == "*", 0).otherwise(F.length(seq)).cast("long")
    return F.coalesce(F.when(mc.isNotNull(), reference_length(mc)), own)


def command_line(arguments: list[str]) -> str:
    return " ".join(arguments)
