"""CIGAR strings: column expressions, and the sequential lift as an Arrow UDF."""

from __future__ import annotations

import re
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

QUERY, REFERENCE = "MIS=X", "MDN=X"


def parse(cigar: str | Column) -> Column:
    """array<struct<len, op>>; "*" and null are empty."""
    text = F.col(cigar) if isinstance(cigar, str) else cigar
    each = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([0-9]+[MIDNSHP=X])"), F.lit(1))
    return F.transform(each, lambda x: F.struct(F.substring(x, F.lit(1), F.length(x) - 1).cast("long").alias("len"), F.substring(x, -1, 1).alias("op")))


def _sum(parsed: Column, ops: str) -> Column:
    return F.aggregate(F.filter(parsed, lambda x: x["op"].isin(*ops)), F.lit(0).cast("long"), lambda acc, x: acc + x["len"])


def reference_length(cigar: str | Column) -> Column:
    return _sum(parse(cigar), REFERENCE)


def query_length(cigar: str | Column) -> Column:
    return _sum(parse(cigar), QUERY)


def clipped_fraction(cigar: str, l_qseq: str) -> Column:
    """1 - reference length / read length, in single precision; below 0 with deletions."""
    return (F.lit(1).cast("float") - reference_length(cigar).cast("float") / F.col(l_qseq).cast("float")).cast("float")


def plain(cigar: str | Column) -> Column:
    """= and X as M, neighbours of one operator joined."""
    text = F.translate(cigar, "=X", "MM")
    joined = F.aggregate(
        parse(text),
        F.array().cast("array<struct<len:bigint,op:string>>"),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["op"] == x["op"]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct((F.element_at(acc, -1)["len"] + x["len"]).alias("len"), x["op"].alias("op"))))).otherwise(F.concat(acc, F.array(F.struct(x["len"].alias("len"), x["op"].alias("op"))))),
    )
    return F.array_join(F.transform(joined, lambda x: F.concat(x["len"].cast("string"), x["op"])), "")


def turned(cigar: str | Column) -> Column:
    """The runs from the last to the first."""
    text = F.col(cigar) if isinstance(cigar, str) else cigar
    each = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([0-9]+[MIDNSHP=X])"), F.lit(1))
    return F.when(F.size(each) == 0, text).otherwise(F.array_join(F.reverse(each), ""))


def expand(cigar: str, consumer: str = "ref") -> Column:
    """One operator letter per consumed base; only M, I, D and S are known."""
    ops = "MD" if consumer == "ref" else "MIS"
    return F.array_join(F.transform(F.filter(parse(cigar), lambda x: x["op"].isin(*ops)), lambda x: F.repeat(x["op"], x["len"].cast("int"))), "")


#: Classes of operators that cancel each other: bases of the read alone, bases of the reference alone.
_READ_ONLY, _REFERENCE_ONLY = "IS", "DN"


def runs(text: str | None) -> list[list]:
    return [[int(n), op] for n, op in re.findall(r"(\d+)([MIDNSHP=X])", text or "")]


def render(ops: list[list]) -> str:
    return "".join(f"{n}{op}" for n, op in ops) or "*"


def add(ops: list[list], n: int, op: str) -> None:
    """Append a run: equal operators, and insertions with clips, join; insertions and deletions pair to matches; nothing is deleted beside a clip."""
    if not n:
        return
    size, last = ops[-1] if ops else (0, "")
    sides = [next((c for c in (_READ_ONLY, _REFERENCE_ONLY) if x and x in c), None) for x in (last, op)]
    if last == op or sides == [_READ_ONLY, _READ_ONLY]:
        ops[-1] = [size + n, last]
    elif None in sides or sides[0] == sides[1]:
        ops.append([n, op])
    elif last != "S":
        paired = min(size, n)
        ops.pop()
        if size == n:
            add(ops, paired, "M")
        else:
            ops += [r for r in ([size - paired, last], [paired, "M"], [n - paired, op]) if r[0]]


def joined(pieces: list[list]) -> list[list]:
    out: list[list] = []
    for n, op in pieces:
        add(out, n, op)
    return out


def places(pieces: list[list]) -> list[int]:
    """Read place at which each piece begins, and the end."""
    return list(accumulate((n if op in QUERY else 0 for n, op in pieces), initial=0))


def split(pieces: list[list], place: int) -> tuple[list[list], list[list]]:
    """Pieces before the read base at ``place`` and from it on; what the read skips there belongs to the first part."""
    at = places(pieces)
    i = next((k for k, (_, op) in enumerate(pieces) if op in QUERY and at[k + 1] > place), len(pieces))
    if i == len(pieces):
        return pieces, []
    (n, op), inside = pieces[i], place - at[i]
    return [*pieces[:i], *([[inside, op]] if inside else [])], [[n - inside, op], *pieces[i + 1 :]]


def without(pieces: list[list], n: int, ops: str) -> tuple[list[list], int]:
    """Pieces less their first n bases of the operators ``ops``, and how many of the n weren't there."""
    out = []
    for size, op in pieces:
        gone = min(n, size) if op in ops else 0
        n -= gone
        if size > gone:
            out.append([size - gone, op])
    return out, n


def spliced(pieces: list[list], points: list[tuple[int, int]], total: int) -> tuple[list[list], int]:
    """Pieces with the break points worked in, and the bases that are too many at the end.

    A point (read place, bases that the destination gains or loses) puts a
    deletion before the read base there, or an insertion that takes the place of
    the next bases of its run, and of matches after it; inside an insertion it
    takes the place of matches only, and the run's shifted end meets no points.
    A point behind a place that insertions have reached ends the crossing, as
    does one beyond the read.
    """
    excess = reached = 0
    shifted = (0, 0)
    for place, change in points:
        before, after = split(pieces, place)
        if place < reached or shifted[0] <= place < shifted[1] or not after:
            break
        reached = place
        if change > 0:
            before = [*before, [change, "D"]]
        elif change < 0:
            new, (size, op) = min(-change, total - place), after[0]
            reached += new
            if op == "I":
                end = shifted[0] if place < shifted[0] else place + size
                shifted = (end, place + size + new)
                after, short = without(after, new, "M")
            else:
                own, after = max(0, size - new), after[1:]
                after, short = without(after, new - (size - own), "M")
                after = [[own, op], *after] if own else after
            excess += short
            before = [*before, [new, "I"]]
        pieces = [*before, *after]
    return pieces, excess


def without_end(ops: list[list], n: int) -> list[list]:
    """Runs less their last n read bases and what stands behind the first of those."""
    keep = places(ops)[-1] - n
    if keep < 0:
        return []
    kept = [list(r) for r in split(ops, keep)[0]]
    if kept and kept[-1] != ops[len(kept) - 1]:
        add(kept, *kept.pop())
    return kept


def clipped_end(ops: list[list], n: int) -> list[list]:
    """Runs with their last n matched bases clipped; shorter insertions and clips among them are clipped besides."""
    matched = besides = 0
    for i in reversed(range(len(ops))):
        size, op = ops[i]
        if op in QUERY and size >= n - matched:
            out = [list(r) for r in ops[:i]]
            add(out, size - (n - matched), op)
            add(out, n + besides, "S")
            return out
        matched += size if op == "M" else 0
        besides += size if op in _READ_ONLY else 0
    return []


def lift_runs(cigar: str, l_qseq: int, points: list[tuple[int, int]], one: bool, forward: bool, start_clip: int, end_clip: int) -> str | None:
    """A lifted CIGAR, or None where the read can't keep one.

    ``one``: the read lies in one interval; ``forward``: the start interval's strand.
    """
    if 0 < l_qseq < start_clip + end_clip:
        return None
    pieces = [[n, "M" if op in "=X" else op] for n, op in runs(cigar)]
    turn = slice(None, None, 1 if forward else -1)
    if start_clip <= 0 and end_clip <= 0 and one:
        return render((joined(pieces) if "=" in cigar or "X" in cigar else pieces)[turn])
    total = l_qseq or places(pieces)[-1]
    if not total:
        return render(pieces)
    # the place of an alignment is its first base that isn't clipped
    head, pieces = (pieces[:1], pieces[1:]) if pieces and pieces[0][1] == "S" else ([], pieces)
    if start_clip > 0:
        held = places(pieces)[-1]
        rest = split(pieces, start_clip)[1] if held > start_clip else [] if held == start_clip else pieces
        clip = [[min(held, start_clip), "S"]]
    else:
        rest, clip = pieces, []
    excess = 0
    if not one:
        marked = [[n, op] for n, op in clip] + rest
        marked, excess = spliced(marked, points if not clip or not points or points[0][0] >= clip[0][0] else [], total)
        rest, clip = marked, []
    out = joined([*head, *clip, *rest])
    if excess:
        out = without_end(out, excess)
    if end_clip > 0:
        out = clipped_end(out, end_clip)
    if not out:
        return None
    for end in (0, -1):
        if out[end][1] == "I":
            out[end] = [out[end][0], "S"]
    if not any(op in "MIDN" for _, op in out):
        return None
    return render(out[turn])


@F.pandas_udf(StringType())
def lift(cigar: pd.Series, l_qseq: pd.Series, bp: pd.Series, diff: pd.Series, one: pd.Series, forward: pd.Series, start_clip: pd.Series, end_clip: pd.Series) -> pd.Series:
    """``lift_runs`` for the reads that need it; bp and diff are arrays."""
    rows = zip(cigar, l_qseq, bp, diff, one, forward, start_clip, end_clip, strict=True)
    return pd.Series([None if c is None else lift_runs(c, int(q), list(zip(b, d, strict=True)) if b is not None else [], bool(o), bool(f), int(x), int(y)) for c, q, b, d, o, f, x, y in rows], dtype=object)


def expand_runs(ops: list[list]) -> str:
    return "".join(op * n for n, op in ops)
