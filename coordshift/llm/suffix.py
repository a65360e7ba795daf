"""Exact substring dedup by sharded suffix arrays.

A byte goes if a string of ``length`` bytes that covers it also starts earlier
(smaller doc_id, or earlier in the same document).

1. Each window of ``length`` bytes is represented by one 32-byte gram inside
   it, the one with the least hash. Equal windows have the same gram at the
   same place, so a window whose gram occurs once in the corpus has no copy.
   Grams are counted in shards by their hash.
2. For every gram that occurs again, the windows it stands for are sent, as one
   short region of text, to the shard of the gram. A task sends a region that
   it has sent before only once: the later copy is known to go.
3. Each shard builds a suffix array of its distinct regions (Larsson-Sadakane
   refinement: ranks double their length, sorted groups are left alone) and
   common prefixes in Kasai's order; runs of prefixes of at least ``length``
   are the classes of equal windows. A shard too large for one array is cut;
   later cuts are merged by binary search in the sorted windows of earlier
   ones.
4. Marks go back to the documents.

Texts move once, compressed, dealt by a hash of the document; both joins use
that exchange. Nothing is collected.

Defined cases: null and empty texts have no bytes; documents without a doc_id
come last in the order; equal doc_ids are ordered by a hash of the text, and
rows equal in both count as one document and get the same result; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coordshift.llm.common import arrow_schema, batch, document_text, mixed, shards_of, slices, table

GRAM = 32
#: Bytes of distinct regions in one suffix array.
SHARD = 3 << 20
_PLACE = np.uint64((1 << 24) - 1)
_SEGMENT = 8 << 20
_NULL = (1 << 63) - 1
_STEPS = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5), np.uint64(0xD6E8FEB86659FD93)]
_codec = pa.Codec("zstd", compression_level=1)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as a compressed block."""
    raw = b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    return len(raw).to_bytes(8, "little") + bytes(_codec.compress(raw, asbytes=True)) if raw else bytes(8)


def unpack(block: bytes, kinds: list[str]) -> list[np.ndarray]:
    size = int.from_bytes(block[:8], "little")
    raw = _codec.decompress(block[8:], decompressed_size=size, asbytes=True) if size else b""
    n, at, out = size // sum(np.dtype(k).itemsize for k in kinds), 0, []
    for k in kinds:
        out.append(np.frombuffer(raw, dtype=k, count=n, offset=at))
        at += n * np.dtype(k).itemsize
    return out


def gram_hashes(x: np.ndarray) -> np.ndarray:
    """Hash of the 32 bytes from each place, by doubling."""
    h = mixed((x.astype(np.uint64) + np.uint64(1)) * _STEPS[0])
    for k, c in enumerate(_STEPS):
        gap = 1 << k
        h = h[: len(h) - gap] * c + h[gap:]
    return mixed(h)


def anchors(x: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """For texts joined in x: hash and place of each chosen gram, and the first and last window it stands for."""
    none = tuple(np.zeros(0, dtype=d) for d in (np.uint64, np.int64, np.int64, np.int64))
    if len(x) < length:
        return none
    h = gram_hashes(x)
    m = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    span, width = length - GRAM + 1, 1
    while width * 2 <= span:
        m = np.minimum(m[: len(m) - width], m[width:])
        width *= 2
    if width < span:
        m = np.minimum(m[: len(m) - (span - width)], m[span - width :])
    valid = np.zeros(len(m), dtype=bool)
    start = 0
    for end in ends.tolist():
        if end - start >= length:
            valid[start : end - length + 1] = True
        start = end
    p = np.flatnonzero(valid)
    if not len(p):
        return none
    place = (m[p] & _PLACE).astype(np.int64)
    new = np.append(True, (p[1:] != p[:-1] + 1) | (place[1:] != place[:-1]))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(p)) - 1
    return h[place[first]], place[first], p[first], p[last]


def anchors_of(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(text number, hash, first window, windows after it, gram's place in it); very long texts are cut with an overlap."""
    parts, sizes, numbers, offsets = [], [], [], []

    def flush():
        ends = np.cumsum(sizes)
        h, place, first, last = anchors(np.frombuffer(b"".join(parts), dtype=np.uint8), ends, length)
        which = np.searchsorted(ends, first, side="right")
        shift = np.array(offsets, dtype=np.int64)[which] - (ends - sizes)[which] if len(which) else first
        return np.array(numbers, dtype=np.int64)[which] if len(which) else first, h, first + shift, last - first, place - first

    total = 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - length + 1), _SEGMENT):
            piece = t[at : at + _SEGMENT + length - 1]
            if total and total + len(piece) > _SEGMENT:
                yield flush()
                parts, sizes, numbers, offsets, total = [], [], [], [], 0
            parts.append(piece)
            sizes.append(len(piece))
            numbers.append(i)
            offsets.append(at)
            total += len(piece)
    if total:
        yield flush()


def suffix_array(x: np.ndarray, rem: np.ndarray) -> np.ndarray:
    """Order of all suffixes, each ending with its own text; equal ones in order of place.

    ``rem``: bytes from each place to the end of its text. The first ranks are
    by 7 bytes (and the length, if shorter); then ranks by h bytes give those
    by 2h, for the places in groups that aren't sorted yet.
    """
    n = len(x)
    padded = np.append(x, np.zeros(7, dtype=np.uint8)).astype(np.uint64)
    key = np.zeros(n, dtype=np.uint64)
    for j in range(7):
        key |= np.where(rem > j, padded[j : j + n], np.uint64(0)) << np.uint64(56 - 8 * j)
    key |= np.minimum(rem, 7).astype(np.uint64)
    order = np.argsort(key)
    key = key[order]
    new = np.append(True, key[1:] != key[:-1])
    del key
    slots = np.arange(n)
    rank = np.empty(n, dtype=np.int64)
    head = np.maximum.accumulate(np.where(new, slots, 0))
    rank[order] = head
    h = 7
    while True:
        alone = new & np.append(new[1:], True)
        slots, new = slots[~alone], new[~alone]
        if not len(slots):
            return order
        own = order[slots]
        live = rem[own] > h
        if not live.any():
            order[slots] = (np.sort(rank[own] << 32 | own)) & ((1 << 32) - 1)
            return order
        follow = np.where(live, rank[np.minimum(own + h, n - 1)] + 1, 0)
        both = rank[own] << 32 | follow
        by = np.argsort(both)
        own, both = own[by], both[by]
        order[slots] = own
        new = np.append(True, both[1:] != both[:-1])
        rank[own] = np.maximum.accumulate(np.where(new, slots, 0))
        h *= 2


def common_prefixes(x: np.ndarray, rem: np.ndarray, starts: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix with the one before it in ``order``, by place.

    Kasai's rule in place order: if the bytes ahead of a suffix and of its
    predecessor are equal, its prefix is one less than that of the place
    before; only the other places are compared, eight bytes at a time.
    """
    n = len(x)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    first = np.zeros(n, dtype=bool)
    first[starts] = True
    safe = np.maximum(before, 0)
    at = np.arange(n)
    fresh = (before < 0) | first | first[safe] | (x[at - 1] != x[safe - 1])
    words = np.zeros(n, dtype=np.uint64)
    padded = np.append(x, np.zeros(8, dtype=np.uint8)).astype(np.uint64)
    for j in range(8):
        words |= padded[j : j + n] << np.uint64(8 * j)
    places = np.flatnonzero(fresh & (before >= 0))
    other = before[places]
    most = np.minimum(rem[places], rem[other])
    got = np.zeros(len(places), dtype=np.int64)
    todo = np.arange(len(places))
    while len(todo):
        a, b = places[todo] + got[todo], other[todo] + got[todo]
        differ = words[np.minimum(a, n - 1)] ^ words[np.minimum(b, n - 1)]
        low = differ & (~differ + np.uint64(1))
        same = np.where(differ == 0, 8, np.bitwise_count(low - np.uint64(1)) // 8)
        got[todo] = np.minimum(got[todo] + same, most[todo])
        todo = todo[(differ == 0) & (got[todo] < most[todo])]
    out = np.zeros(n, dtype=np.int64)
    out[places] = got
    source = np.maximum.accumulate(np.where(fresh, at, 0))
    return np.maximum(out[source] - (at - source), 0)


def repeated_windows(regions: list[bytes], length: int, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For distinct regions in order: region and offset of each window that also starts earlier, and the sorted distinct windows.

    ``known``: sorted windows of earlier shards, looked up by binary search.
    """
    sizes = np.fromiter(map(len, regions), np.int64, len(regions))
    x = np.frombuffer(b"".join(regions), dtype=np.uint8)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    rem = np.repeat(ends, sizes) - np.arange(len(x))
    order = suffix_array(x, rem)
    prefix = common_prefixes(x, rem, starts, order)[order]
    window = rem[order] >= length
    group = np.cumsum(prefix < length)[window]
    place = order[window]
    heads = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(place) else place
    least = np.minimum.reduceat(place, heads) if len(place) else place
    again = place != np.repeat(least, np.diff(np.append(heads, len(place))))
    kept = np.zeros(0, dtype=f"S{length + 1}")
    if known is not None and len(place):
        joined = np.append(x, np.ones(1, dtype=np.uint8))
        text = np.concatenate([np.lib.stride_tricks.sliding_window_view(x, length)[least], np.ones((len(least), 1), np.uint8)], axis=1) if len(joined) else x
        kept = np.ascontiguousarray(text).view(f"S{length + 1}")[:, 0]
        if len(known):
            at = np.minimum(np.searchsorted(known, kept), len(known) - 1)
            hit = known[at] == kept
            again |= np.repeat(hit, np.diff(np.append(heads, len(place))))
            kept = kept[~hit]
    gone = np.sort(place[again])
    region = np.searchsorted(ends, gone, side="right")
    return region, gone - starts[region] if len(gone) else gone, kept


_ANCHOR = ["<u8", "<i8", "<i8", "<i4", "u1", "u1"]
_MARK = ["<i8", "<i8", "<i4", "<i4"]


def _dealt(keys: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, rows of it) for the shards that have rows."""
    shard = keys % np.uint64(n)
    order = np.argsort(shard.astype(np.int32), kind="stable")
    ends = np.cumsum(np.bincount(shard.astype(np.int64), minlength=n))
    for s in np.flatnonzero(np.diff(np.append(0, ends))).tolist():
        yield s, order[(ends[s - 1] if s else 0) : ends[s]]


def _home(doc: np.ndarray, tie: np.ndarray) -> np.ndarray:
    return mixed(doc.astype(np.uint64) ^ mixed(tie.astype(np.uint64)))


_BLOCKS = "shard int, block binary"


def _blocks(keys: np.ndarray, n: int, columns: list[np.ndarray]) -> pa.RecordBatch:
    got = [(s, pack(*(c[rows] for c in columns))) for s, rows in _dealt(keys, n)]
    return batch(arrow_schema(_BLOCKS), [s for s, _ in got], [b for _, b in got])


def _joined(t: pa.Table, kinds: list[str]) -> list[np.ndarray]:
    parts = [unpack(b, kinds) for b in t.column("block").to_pylist()]
    return [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, dtype=k) for i, k in enumerate(kinds)]


def removed_spans(docs: DataFrame, length: int = 100) -> tuple[DataFrame, DataFrame]:
    """(texts: shard, doc, tie, packed text; marks: shard, block of doc, tie, start, end)."""
    n = shards_of(docs)
    source = document_text(docs).select(F.coalesce("doc_id", F.lit(_NULL)).alias("doc"), F.xxhash64("text").alias("tie"), "text")
    text_names = "shard int, doc long, tie long, packed binary"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            doc, tie = b.column("doc").to_numpy(), b.column("tie").to_numpy()
            packed = [pack(np.frombuffer(t.encode("utf-8", "replace"), dtype=np.uint8)) for t in b.column("text").to_pylist()]
            yield batch(arrow_schema(text_names), (_home(doc, tie) % np.uint64(n)).astype(np.int32), doc, tie, packed)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=_SEGMENT):
            doc, tie = b.column("doc").to_numpy(), b.column("tie").to_numpy()
            for number, h, first, more, place in anchors_of([t.encode("utf-8", "replace") for t in b.column("text").to_pylist()], length):
                yield _blocks(h, n, [h, doc[number], tie[number], first.astype("<i4"), more.astype("u1"), place.astype("u1")])

    def repeated(t: pa.Table) -> pa.Table:
        columns = _joined(t, _ANCHOR)
        order = np.argsort(columns[0])
        h = columns[0][order]
        same = h[1:] == h[:-1]
        keep = order[np.append(same, False) | np.append(False, same)] if len(h) else order
        columns = [c[keep] for c in columns]
        return pa.Table.from_batches([_blocks(_home(columns[1], columns[2]), n, columns)])

    region_names = "shard int, block binary, regions binary"

    def extract(key: tuple, texts: pa.Table, found: pa.Table) -> pa.Table:
        h, doc, tie, first, more, place = _joined(found, _ANCHOR)
        order = np.lexsort((first, tie, doc))
        h, doc, tie, first, more, place = (c[order] for c in (h, doc, tie, first, more, place))
        rows = sorted(zip(texts.column("doc").to_pylist(), texts.column("tie").to_pylist(), range(texts.num_rows), strict=True))
        ids = np.stack([doc, tie], axis=1)
        heads = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]).any(axis=1))) if len(doc) else np.zeros(0, dtype=int)
        own = {(int(doc[i]), int(tie[i])): (i, j) for i, j in zip(heads, np.append(heads, len(doc))[1:], strict=True)}
        seen: set[bytes] = set()
        pieces: list[bytes] = [b""] * len(doc)
        gone = np.zeros(len(doc), dtype=bool)
        packed, last = texts.column("packed"), None
        for d, t, row in rows:
            if (d, t) == last or (d, t) not in own:
                continue
            last = (d, t)
            text = unpack(packed[row].as_py(), ["u1"])[0].tobytes()
            i, j = own[d, t]
            for k, a, z, gram in zip(range(i, j), first[i:j].tolist(), (first[i:j] + more[i:j] + length).tolist(), place[i:j].tolist(), strict=True):
                piece = text[a:z]
                name = hashlib.blake2b(piece, digest_size=16, salt=bytes([gram])).digest()
                if name in seen:
                    gone[k] = True
                else:
                    seen.add(name)
                    pieces[k] = piece
        out = []
        sent = np.flatnonzero(~gone)
        for s, at in _dealt(h[sent], n):
            rows_ = sent[at]
            raw = np.frombuffer(b"".join(pieces[k] for k in rows_.tolist()), dtype=np.uint8)
            out.append((s, pack(*(c[rows_] for c in (h, doc, tie, first, more, place))), pack(raw)))
        if gone.any():
            marks = pack(doc[gone], tie[gone], first[gone], (first[gone] + more[gone] + length).astype("<i4"))
            out.append((-1 - key[0].as_py(), marks, b""))
        return pa.table({"shard": pa.array([o[0] for o in out], pa.int32()), "block": pa.array([o[1] for o in out], pa.binary()), "regions": pa.array([o[2] for o in out], pa.binary())})

    def judge(key: tuple, t: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:
            return pa.table({"shard": pa.array([-1 - key[0].as_py()] * t.num_rows, pa.int32()), "block": t.column("block")})
        h, doc, tie, first, more, place = _joined(t, _ANCHOR)
        joined = b"".join(unpack(r, ["u1"])[0].tobytes() for r in t.column("regions").to_pylist())
        sizes = more.astype(np.int64) + length
        starts = np.cumsum(sizes) - sizes
        order = np.lexsort((first, tie, doc, h))
        marks = []
        known, at = np.zeros(0, dtype=f"S{length + 1}"), 0
        while at < len(order):
            # a shard: whole groups of a gram, or a cut of one that is too large
            stop = at + max(1, int(np.searchsorted(np.cumsum(sizes[order[at : at + SHARD // length]]), SHARD)))
            cut = False
            if stop < len(order):
                group = h[order[stop - 1]]
                back = int(np.searchsorted(h[order[at:stop]], group)) + at
                if h[order[stop]] == group:
                    cut = back == at
                    stop = stop if cut else back
            joins = len(known) > 0 or cut
            own = order[at:stop]
            texts: dict[bytes, int] = {}
            distinct, copies = [], []
            for k in own.tolist():
                piece = joined[starts[k] : starts[k] + sizes[k]]
                if piece in texts:
                    copies.append(k)
                else:
                    texts[piece] = k
                    distinct.append(k)
            kept = np.array(distinct)
            by = np.lexsort((first[kept], tie[kept], doc[kept]))
            kept = kept[by]
            region, offset, windows = repeated_windows([joined[starts[k] : starts[k] + sizes[k]] for k in kept.tolist()], length, known if joins else None)
            if len(region):
                new = np.append(True, (region[1:] != region[:-1]) | (offset[1:] != offset[:-1] + 1))
                a = np.flatnonzero(new)
                z = np.append(a[1:], len(region)) - 1
                k = kept[region[a]]
                marks.append([doc[k], tie[k], first[k] + offset[a].astype("<i4"), (first[k] + offset[z] + length).astype("<i4")])
            if copies:
                k = np.array(copies)
                marks.append([doc[k], tie[k], first[k], (first[k] + sizes[k]).astype("<i4")])
            more_of_it = stop < len(order) and h[order[stop]] == h[order[stop - 1]]
            known = np.sort(np.concatenate([known, windows])) if more_of_it and joins else np.zeros(0, dtype=f"S{length + 1}")
            at = stop
        columns = [np.concatenate([m[i] for m in marks]) if marks else np.zeros(0, dtype=k) for i, k in enumerate(_MARK)]
        return pa.Table.from_batches([_blocks(_home(columns[0], columns[1]), n, columns)])

    texts = source.mapInArrow(send, text_names)
    found = source.mapInArrow(choose, _BLOCKS).groupBy("shard").applyInArrow(repeated, _BLOCKS)
    regions = texts.groupBy("shard").cogroup(found.groupBy("shard")).applyInArrow(extract, region_names)
    return texts, regions.groupBy("shard").applyInArrow(judge, _BLOCKS)


def keep_first(docs: DataFrame, length: int = 100, texts_out: bool = True) -> DataFrame:
    """doc_id, kept (text left, invalid UTF-8 pieces replaced), n_bytes, n_removed, n_spans; or kept_sha256 in place of kept."""
    texts, marks = removed_spans(docs, length)
    last = "kept string" if texts_out else "kept_sha256 string"
    names = f"doc_id long, n_bytes long, n_removed long, n_spans long, {last}"

    def cut(key: tuple, own: pa.Table, found: pa.Table) -> pa.Table:
        doc, tie, start, end = _joined(found, _MARK)
        order = np.lexsort((start, tie, doc))
        doc, tie, start, end = (c[order] for c in (doc, tie, start, end))
        ids = np.stack([doc, tie], axis=1)
        heads = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]).any(axis=1))) if len(doc) else np.zeros(0, dtype=int)
        at = {(int(doc[i]), int(tie[i])): (i, j) for i, j in zip(heads, np.append(heads, len(doc))[1:], strict=True)}
        rows = []
        for d, t, packed in zip(*(own.column(c).to_pylist() for c in ("doc", "tie", "packed")), strict=True):
            text = unpack(packed, ["u1"])[0].tobytes()
            spans: list[list[int]] = []
            i, j = at.get((d, t), (0, 0))
            for a, z in zip(start[i:j].tolist(), end[i:j].tolist(), strict=True):
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], z)
                else:
                    spans.append([a, z])
            edges = [0, *(e for s in spans for e in s), len(text)]
            kept = b"".join(text[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True)) if spans else text
            rows.append((None if d == _NULL else d, len(text), len(text) - len(kept), len(spans), kept.decode("utf-8", "replace") if texts_out else hashlib.sha256(kept).hexdigest()))
        return pa.Table.from_batches([batch(arrow_schema(names), *([r[i] for r in rows] for i in range(5)))])

    return texts.groupBy("shard").cogroup(marks.groupBy("shard")).applyInArrow(cut, names)


def op9_suffix(spark, sf_dir: str) -> DataFrame:
    return keep_first(table(spark, sf_dir, "documents"), length=100, texts_out=False)
