"""Scoring texts with a context-tree-weighted byte model.

Texts are lower-cased (A-Z), read as UTF-8 bytes and closed by a zero byte.
Each byte is eight binary decisions; each of the 255 decision nodes has its
own tree over the preceding bytes. A tree node holds a Krichevsky-Trofimov
estimator, and its weighted probability is half its own plus half the product
of its children's, so all depths from 0 to ``depth`` are mixed. The predictive
probability of a decision follows from the posterior weights down its context.

Documents are dealt to shards. Each shard counts its words and its byte
(depth + 1)-grams, and asks for them in the shards of the words' hashes and of
the grams' last ``LOW`` context bytes. A shard of grams has whole trees below
these contexts. It first sends up what they add to the levels above, which are
bounded by the alphabet and built on the driver, then answers each asked gram
with its log probability. So counts and trees cover all training texts at
full depth and grow with them, and nothing that grows is held in one place.
Beside it stands a unigram word model (add one half), counted and answered in
the same way.

Defined cases: null and empty texts score the end symbol only; rows with a
null doc_id count as training rows; repeated rows are scored and counted each
time; extra columns are ignored; with no training rows the byte model gives
each byte 1/256.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coordshift.llm.common import LookupTable, arrow_schema, batch, checkpointed, document_text, give_back, mixed, shards_of, slices, table
from coordshift.llm.suffix import _blocks, _joined, pack, unpack

DEPTH = 5
#: Bytes of context that grams are dealt by; the levels above are built on the driver (65,536 nodes at most).
LOW = 2
WORD, GRAM = 0, 1
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_END = np.uint64(0x5851F42D4C957F2D)
_BASE = 0x9E3779B97F4A7C15


def _powers(n: int, _kept: list = []) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006  kept on purpose
    if not _kept or len(_kept[0][0]) < n:
        size = max(n, 1 << 20)
        down = np.cumprod(np.full(size, pow(_BASE, -1, 1 << 64), dtype=np.uint64))
        up = np.cumprod(np.full(size, _BASE, dtype=np.uint64))
        _kept[:] = [(down, up)]
    return _kept[0]


def word_hashes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each run of bytes that aren't white space."""
    inside = np.append(np.append(False, ~_SPACE[x]), False)
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    down, up = _powers(len(x) + 1)
    sums = np.zeros(len(x) + 1, dtype=np.uint64)
    np.cumsum((x.astype(np.uint64) + np.uint64(1)) * down[: len(x)], out=sums[1:])
    return mixed((sums[end] - sums[start]) * up[end - 1]), start, end


def lowered(text: str) -> bytes:
    return text.encode("utf-8", "replace").lower()


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(token hash, text number): words in order of texts, then each text's end."""
    x = np.frombuffer(b" ".join(texts), dtype=np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    h, start, _ = word_hashes(x) if len(x) else (np.zeros(0, np.uint64),) * 3
    owner = np.searchsorted(np.cumsum(sizes), start, side="right")
    return np.append(h, np.full(len(texts), _END)), np.append(owner, np.arange(len(texts)))


def gram_keys(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Key (context, byte) of each byte and closing zero, and the text's number; contexts start as zeros."""
    pad = bytes(depth)
    x = np.frombuffer(b"".join(pad + t + b"\0" for t in texts), dtype=np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + depth + 1
    valid = np.ones(len(x), dtype=bool)
    starts = np.cumsum(sizes) - sizes
    for k in range(depth):
        valid[starts + k] = False
    keys = np.zeros(len(x), dtype=np.uint64)
    wide = x.astype(np.uint64)
    for k in range(depth + 1):
        keys[k:] |= wide[: len(x) - k] << np.uint64(8 * k)
    return keys[valid], np.repeat(np.arange(len(texts)), sizes - depth)


def _home(grams: np.ndarray) -> np.ndarray:
    """Hash of the last ``LOW`` context bytes."""
    return mixed((grams >> np.uint64(8)) & np.uint64((1 << 8 * LOW) - 1))


def _runs(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if n is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
    heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, dtype=int)
    total = np.diff(np.append(heads, len(keys))) if n is None else (np.add.reduceat(n, heads) if len(heads) else n)
    return keys[heads], total


def _log_gamma(x: np.ndarray) -> np.ndarray:
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        low = y < 8
        shift[low] += np.log(y[low])
        y[low] += 1
    z = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y - shift


def _estimate(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    out = np.empty(len(n0))
    for i in range(0, len(n0), 1 << 17):  # in pieces: the driver's memory is small
        a, b = n0[i : i + (1 << 17)].astype(np.float64), n1[i : i + (1 << 17)].astype(np.float64)
        out[i : i + (1 << 17)] = _log_gamma(a + 0.5) + _log_gamma(b + 0.5) - _log_gamma(a + b + 1) - np.log(np.pi)
    return out


def _parents(ids: np.ndarray, d: int) -> np.ndarray:
    """Node ids (context above an 8-bit decision node) with the context cut to d bytes."""
    return (ids >> np.uint64(8) & np.uint64((1 << 8 * d) - 1)) << np.uint64(8) | ids & np.uint64(255)


def _upper(ids: np.ndarray, d: int, n0: np.ndarray, n1: np.ndarray, weighted: np.ndarray) -> tuple[np.ndarray, ...]:
    """Nodes of depth d that those given have above them, with their counts and the sum of log weights below."""
    parent = _parents(ids, d)
    order = np.argsort(parent, kind="stable")
    parent = parent[order]
    heads = np.flatnonzero(np.append(True, parent[1:] != parent[:-1])) if len(parent) else np.zeros(0, dtype=int)
    n0, n1, below = (np.add.reduceat(v[order], heads) if len(heads) else v for v in (n0, n1, weighted))
    return parent[heads], n0, n1, below


def _level(ids: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray | None) -> tuple[tuple, np.ndarray]:
    """((ids, own probability of a one, share of the own estimate), log of the weighted probability); ``below`` is None for leaves."""
    own = _estimate(n0, n1)
    one = ((n1 + 0.5) / (n0 + n1 + 1)).astype(np.float32)
    if below is None:
        return (ids, one, np.ones(len(ids), dtype=np.float32)), own
    weighted = np.logaddexp(own, below) - np.log(2)
    return (ids, one, np.exp(own - np.log(2) - weighted).astype(np.float32)), weighted


def _descend(levels: list[tuple], d: int, above: tuple | None) -> tuple[list[np.ndarray], list[np.ndarray], tuple]:
    """Nodes of the levels from depth d on and their probability of a one if nothing deeper is known; ``above`` and the last: (ids, known, rest) of a level."""
    nodes, ones = [], []
    for ids, one, share in levels:
        ahead, open_ = np.zeros(len(ids), dtype=np.float32), np.ones(len(ids), dtype=np.float32)
        if above is not None:
            at = np.searchsorted(above[0], _parents(ids, d - 1))
            ahead, open_ = above[1][at], above[2][at]
        above = (ids, ahead + open_ * share * one, open_ * (1 - share))
        nodes.append(ids)
        ones.append(above[1] + above[2] / 2)
        d += 1
    return nodes, ones, above


class Top:
    """The levels above depth ``low``, from sums over the nodes of that depth; at most 256 ** d * 255 nodes at depth d."""

    def __init__(self, ids: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray, low: int = LOW):
        order = np.argsort(ids)
        ids, n0, n1, below = (v[order] for v in (ids, n0, n1, below))
        levels = []
        for d in range(low - 1, -1, -1):
            level, weighted = _level(ids, n0, n1, below)
            levels.insert(0, level)
            if d:
                ids, n0, n1, below = _upper(ids, d - 1, n0, n1, weighted)
        self.low = low
        self.nodes, self.ones, self.last = _descend(levels, 0, None)


def _decisions(grams: np.ndarray, n: np.ndarray) -> Iterator[tuple]:
    """For each of a byte's eight decisions: the byte's bit, first gram, node and counts of zeros and ones of each node of full depth.

    No node belongs to two decisions, so only one decision's arrays are held
    at a time; grams are sorted, so its nodes come in runs.
    """
    context, byte, n = grams >> np.uint64(8), grams & np.uint64(255), n.astype(np.int64)
    for j in range(8):
        key = context << np.uint64(8) | np.uint64(1 << j) | byte >> np.uint64(8 - j)
        bit = (byte >> np.uint64(7 - j) & np.uint64(1)).astype(bool)
        heads = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, dtype=int)
        n1, all_ = (np.add.reduceat(v, heads) if len(heads) else v for v in (np.where(bit, n, 0), n))
        yield bit, heads, key[heads], all_ - n1, n1


def climb(grams: np.ndarray, n: np.ndarray, depth: int, low: int = LOW) -> tuple[np.ndarray, ...]:
    """What the trees of some contexts of ``low`` bytes add to the nodes of depth low - 1: ids, counts, sums of log weights."""
    parts = []
    for _, _, ids, n0, n1 in _decisions(grams, n):
        _, weighted = _level(ids, n0, n1, None)
        for d in range(depth - 1, low - 2, -1):
            ids, n0, n1, below = _upper(ids, d, n0, n1, weighted)
            if d >= low:
                _, weighted = _level(ids, n0, n1, below)
        parts.append((ids, n0, n1, below))
    return tuple(map(np.concatenate, zip(*parts, strict=True)))


class Tree:
    """Sorted grams, log10 probability of each; for each of a byte's eight decisions, the nodes of each depth and their probability of a one.

    With ``top``, the grams are those of some contexts of ``top.low`` bytes;
    what is above these contexts comes from it.
    """

    def __init__(self, grams: np.ndarray, n: np.ndarray, depth: int, top: Top | None = None):
        self.depth, self.grams = depth, grams
        low = top.low if top else 0
        self.nodes, self.ones = [], []
        total = np.zeros(len(grams))
        for bit, heads, ids, n0, n1 in _decisions(grams, n):
            level, weighted = _level(ids, n0, n1, None)
            levels = [level]
            for d in range(depth - 1, low - 1, -1):
                ids, n0, n1, below = _upper(ids, d, n0, n1, weighted)
                level, weighted = _level(ids, n0, n1, below)
                levels.insert(0, level)
            nodes, ones, _ = _descend(levels, low, top.last if top else None)
            self.nodes.append([*(top.nodes if top else []), *nodes])
            self.ones.append([*(top.ones if top else []), *ones])
            p = np.repeat(ones[-1], np.diff(np.append(heads, len(grams)))).astype(np.float64)
            total += np.log10(np.where(bit, p, 1 - p))
        self.score = total.astype(np.float32)

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """Log10 probability of each gram; those not seen follow their context as far down as it is known."""
        at = np.minimum(np.searchsorted(self.grams, keys), max(len(self.grams) - 1, 0))
        seen = self.grams[at] == keys if len(self.grams) else np.zeros(len(keys), dtype=bool)
        out = np.zeros(len(keys), dtype=np.float32)
        out[seen] = self.score[at[seen]]
        new = keys[~seen]
        context, byte, total = new >> np.uint64(8), new & np.uint64(255), np.zeros(len(new))
        for j in range(8):
            node = np.uint64(1 << j) | byte >> np.uint64(8 - j)
            bit = (byte >> np.uint64(7 - j) & np.uint64(1)).astype(bool)
            p, todo = np.full(len(new), 0.5), np.arange(len(new))
            for d in range(self.depth, -1, -1):
                nodes = self.nodes[j][d]
                if not len(todo) or not len(nodes):
                    continue
                own = (context[todo] & np.uint64((1 << 8 * d) - 1)) << np.uint64(8) | node[todo]
                at = np.minimum(np.searchsorted(nodes, own), len(nodes) - 1)
                hit = nodes[at] == own
                p[todo[hit]] = self.ones[j][d][at[hit]]
                todo = todo[~hit]
            total += np.log10(np.where(bit, p, 1 - p))
        out[~seen] = total
        return out


def _planes(grams: np.ndarray, depth: int) -> list[np.ndarray]:
    """Bytes of the grams, place by place: sorted grams pack well so."""
    return list(grams.astype("<u8").view("u1").reshape(-1, 8)[:, : depth + 1].T)


def _grams(planes: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(planes[0]), dtype=np.uint64)
    for k, p in enumerate(planes):
        out |= p.astype(np.uint64) << np.uint64(8 * k)
    return out


def score(docs: DataFrame, held_out=None, depth: int = DEPTH) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    ``held_out``: condition over doc_id; such rows are scored but not learnt
    from. ``depth``: bytes of context, 3 to 6.
    """
    spark = docs.sparkSession
    n = shards_of(docs)
    name = F.coalesce(docs["doc_id"].cast("long").cast("string"), F.lit(""))
    held_out = F.crc32(name) % 5 == 1 if held_out is None else held_out
    rows = document_text(docs, held_out.alias("held_out"))
    names = "shard int, doc_id long, held_out boolean, packed binary"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = [t.encode("utf-8", "replace") for t in b.column("text").to_pylist()]
            shard = mixed(b.column("doc_id").fill_null(-1).to_numpy().astype(np.uint64)) % np.uint64(n)
            yield batch(arrow_schema(names), shard.astype(np.int32), b.column("doc_id"), b.column("held_out"), [pack(np.frombuffer(t, np.uint8)) for t in texts])

    def unpacked(t: pa.Table) -> Iterator[tuple[pa.Table, list[bytes]]]:
        start, size, packed = 0, 0, t.column("packed").to_pylist()
        for i, p in enumerate(packed):
            size += int.from_bytes(p[:8], "little")
            if size > 1 << 20 or i + 1 == len(packed):
                yield t.slice(start, i + 1 - start), [unpack(x, ["u1"])[0].tobytes().lower() for x in packed[start : i + 1]]
                start, size = i + 1, 0

    kinds = {WORD: ["<u8", "<i4", "<i4"], GRAM: [*["u1"] * (depth + 1), "<i4", "<i4"]}
    block_names = "kind int, shard int, block binary"
    block_schema = arrow_schema(block_names)

    def of_kind(kind: int, b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([kind] * b.num_rows, pa.int32()), *b.columns], schema=block_schema)

    def ask(key: tuple, t: pa.Table) -> pa.Table:
        found: dict[int, list] = {WORD: [], GRAM: []}
        sizes = {WORD: 0, GRAM: 0}
        for part, texts in unpacked(t):
            learnt = ~part.column("held_out").to_numpy().astype(bool)
            for kind, (h, owner) in ((WORD, tokens(texts)), (GRAM, gram_keys(texts, depth))):
                found[kind].append(_runs(h, learnt[owner].astype(np.int64)))
                if sum(len(x[0]) for x in found[kind]) > 2 * sizes[kind] + (1 << 20):
                    found[kind] = [_runs(*map(np.concatenate, zip(*found[kind], strict=True)))]
                    sizes[kind] = len(found[kind][0][0])
        asker = key[0].as_py()
        out = []
        for kind, parts in found.items():
            h, c = _runs(*map(np.concatenate, zip(*parts, strict=True)))
            own = [h] if kind == WORD else _planes(h, depth)
            out.append(of_kind(kind, _blocks(h if kind == WORD else _home(h), n, [*own, np.full(len(h), asker, dtype="<i4"), c.astype("<i4")])))
        return pa.Table.from_batches(out)

    def asked(kind: int, t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words or grams, asking shards and counts."""
        columns = _joined(t, kinds[kind])
        return columns[0] if kind == WORD else _grams(columns[:-2]), columns[-2], columns[-1].astype(np.int64)

    sum_names = "node long, n0 long, n1 long, below double"

    def sum_up(key: tuple, t: pa.Table) -> pa.Table:
        """Of words, total and number of those known; of grams, what their trees add to the top."""
        h, _, c = asked(key[0].as_py(), t)
        h, c = _runs(h, c)
        if key[0].as_py() == WORD:
            return pa.Table.from_batches([batch(arrow_schema(sum_names), [-1], [int(c.sum())], [int((c > 0).sum())], [0.0])])
        ids, n0, n1, below = climb(h[c > 0], c[c > 0], depth)
        return pa.Table.from_batches([batch(arrow_schema(sum_names), ids.astype(np.int64), n0, n1, below)])

    texts = rows.mapInArrow(send, names)
    asks = checkpointed(texts.groupBy("shard").applyInArrow(ask, block_names))
    # at most 255 nodes for each byte of context, and one row for all words
    sums = asks.groupBy("kind", "shard").applyInArrow(sum_up, sum_names).groupBy("node").agg(*(F.sum(c).alias(c) for c in ("n0", "n1", "below"))).toArrow()
    node, n0, n1, below = (sums.column(c).to_numpy() for c in ("node", "n0", "n1", "below"))
    words = node < 0
    all_, distinct = int(n0[words].sum()), int(n1[words].sum())
    floor = float(np.log10(all_ + 0.5 * (distinct + 1)))
    shared = spark.sparkContext.broadcast(Top(node[~words].astype(np.uint64), n0[~words], n1[~words], below[~words]))

    def answer(key: tuple, t: pa.Table) -> pa.Table:
        kind = key[0].as_py()
        h, asker, c = asked(kind, t)
        own, back = np.unique(h, return_inverse=True)
        total = np.bincount(back, weights=c, minlength=len(own)).astype(np.int64)
        value = total.astype("<i8") if kind == WORD else Tree(own[total > 0], total[total > 0], depth, shared.value).log10(own)
        columns = [h] if kind == WORD else _planes(h, depth)
        return pa.Table.from_batches([of_kind(kind, _blocks(asker.astype(np.uint64), n, [*columns, value[back]]))])

    out_names = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"

    def judge(key: tuple, own: pa.Table, found: pa.Table) -> pa.Table:
        kind = found.column("kind").to_numpy()
        word, c = _joined(found.filter(pa.array(kind == WORD)), ["<u8", "<i8"])
        *planes, log = _joined(found.filter(pa.array(kind == GRAM)), [*["u1"] * (depth + 1), "<f4"])
        model = LookupTable(_grams(planes), log)
        del planes, log
        order = np.argsort(word)
        word, c = word[order], c[order]
        out = []
        for part, texts_ in unpacked(own):
            h, owner = tokens(texts_)
            n_ = c[np.searchsorted(word, h)]
            m = len(texts_)
            size = np.bincount(owner, minlength=m)
            base = np.bincount(owner, weights=np.log10(n_ + 0.5), minlength=m) - size * floor
            keys, place = gram_keys(texts_, depth)
            log10 = np.bincount(place, weights=model.get(keys), minlength=m)
            per = -log10 * np.log2(10) / (np.fromiter(map(len, texts_), np.int64, m) + 1)
            out.append(batch(arrow_schema(out_names), part.column("doc_id").combine_chunks(), part.column("held_out").combine_chunks(), size, np.bincount(owner, weights=n_ > 0, minlength=m).astype(np.int64), np.full(m, all_), base, log10, per))
        del model
        give_back()
        return pa.Table.from_batches(out, schema=arrow_schema(out_names))

    answers = asks.groupBy("kind", "shard").applyInArrow(answer, block_names)
    return texts.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(judge, out_names)


def op3_contexttree(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
