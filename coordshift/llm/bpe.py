"""BPE encoding and decoding by speculation and verification.

A vocabulary with word ends is read from a tokenizers JSON file. Each new
word is first cut by greedy longest match. The cut is the true BPE result if
every token is reached by merging its own symbols and no adjacent pair could
have merged across its border first; both are tested with vectorised lookups
over the distinct pairs. Only words that fail are merged exactly, rule by
rule. Results are kept per white-space-delimited chunk, so a frequent word is
encoded once per worker.

Across a border, a right-edge part r of the left token and a left-edge part l
of the right token merge under rule k if k comes before r's own next merge
and no later than l's (equal rules apply leftmost first).

Defined cases: null and empty texts have no tokens and decode to the empty
string; special tokens' strings in a text become those tokens; repeated rows
and extra columns are harmless; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from coordshift.llm.common import LookupTable, arrow_schema, batch, document_text, held, slices, table

END = "</w>"
#: The file's word pattern: contractions, letters, one digit, other symbols.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
#: White space to str.split(), but not to the file's pattern.
_ODD = re.compile("[\x1c-\x1f]")
_SPACE = regex.compile(r"\p{White_Space}+")
#: Chunks that a worker remembers, of at most so many characters each.
REMEMBERED, LONGEST = 200_000, 200
#: What the file has to ask for, as this module does just that (fixed values).
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
_NEVER = 1 << 30
_BASE = 0x9E3779B97F4A7C15 | 1


def _hash(word: bytes, end: bool) -> int:
    h = 0
    for b in word:
        h = (h * _BASE + b + 1) & (1 << 64) - 1
    return (h ^ (len(word) << 1 | end) * 0xD6E8FEB86659FD93) & (1 << 64) - 1


def _prefix_hash(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all pieces come from running sums of byte * base ** -place and the powers of the base."""
    back = pow(_BASE, -1, 1 << 64)
    n = len(raw)
    down = np.cumprod(np.full(n + 1, back, dtype=np.uint64))
    up = np.cumprod(np.full(n + 1, _BASE, dtype=np.uint64))
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * down[:n], out=sums[1:])
    return sums, up


def _piece_hash(prefix: tuple[np.ndarray, np.ndarray], at: np.ndarray, size: np.ndarray, end: np.ndarray) -> np.ndarray:
    sums, up = prefix
    h = (sums[at + size] - sums[at]) * up[at + size - 1]
    return h ^ (size.astype(np.uint64) << np.uint64(1) | end.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)


def byte_symbols() -> list[str]:
    """The visible character that stands for each byte: itself if printable Latin-1, else one from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Vocabulary:
    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        if model.get("end_of_word_suffix") != END:
            raise ValueError("a vocabulary with word ends is needed")
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if spec.get("normalizer") != NORMALIZER or [x.get("type") for x in steps] != ["Split", "ByteLevel"] or steps[0] != SPLITTER or steps[1].get("add_prefix_space") or steps[1].get("use_regex"):
            raise ValueError("the file's normaliser or splitter isn't the one that is known here")
        if spec.get("decoder") or spec.get("post_processor") or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
            raise ValueError("the file has a decoder or model options that aren't known here")
        self.ids: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens = {i: t for t, i in [*self.ids.items(), *self.special.items()]}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {m: k for k, m in enumerate(merges)}
        n = max(self.tokens) + 1
        self.left, self.right, self.rank = np.full(n, -1), np.full(n, -1), np.full(n, _NEVER)
        for k, (a, b) in enumerate(merges):
            t = self.ids[a + b]
            if self.rank[t] == _NEVER:
                self.left[t], self.right[t], self.rank[t] = self.ids[a], self.ids[b], k
        pairs = np.array([self.ids[a] * n + self.ids[b] for a, b in merges], dtype=np.int64)
        order = np.argsort(pairs)
        self.pairs, self.pair_rank, self.n = pairs[order], order, n
        self.symbols = byte_symbols()
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        byte = {c: b for b, c in enumerate(self.symbols)}
        self.base = np.array([self.ids[c] for c in self.symbols])
        self.base_end = np.array([self.ids[c + END] for c in self.symbols])
        self.result = np.array([self.ids[a + b] for a, b in merges])
        self.pair_table = LookupTable(pairs.astype(np.uint64), np.arange(len(merges)))
        plain = [(i, bytes(byte[c] for c in t.removesuffix(END)), t.endswith(END)) for t, i in self.ids.items() if t not in self.special]
        self.longest = max(len(w) for _, w, _ in plain)
        self.entries = LookupTable(np.array([_hash(w, end) for _, w, end in plain], dtype=np.uint64), np.array([i for i, _, _ in plain]))
        self.token_bytes = {i: t.encode() for i, t in self.tokens.items()}
        # whether a token's own symbols merge to it; without the word end, by merging in front of a break
        self.own = dict.fromkeys((i for i, _, _ in plain), True)
        for i, _, end in plain:
            if not end:
                self.own[i] = self._merge_plain([self.symbols[b] for b in _]) == [i]
        ended = [(i, w) for i, w, end in plain if end]
        self.own.update({i: got == [i] for (i, _), got in zip(ended, self.merge([w for _, w in ended]), strict=True)})
        self.own_ok = np.array([self.own.get(i, False) for i in range(n)])

    def _merge_plain(self, parts: list[str]) -> list[int]:
        while len(parts) > 1:
            rank, at = min((self.ranks.get(p, _NEVER), i) for i, p in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == _NEVER:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ids[p] for p in parts]

    def symbols_of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all words in a row, each word's last one with the word end; and where words start."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        flat, ends = self.base[raw].astype(np.int64), np.cumsum(sizes)
        flat[ends - 1] = self.base_end[raw[ends - 1]]
        return flat, ends - sizes

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        got = self.pair_table.get((a * self.n + b).astype(np.uint64))
        return np.where(np.isnan(got), _NEVER, np.nan_to_num(got)).astype(np.int64)

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """Exact merging of all words at once: in each round, every word's lowest rule at its leftmost place."""
        out: list[list[int]] = [[]] * len(words)
        if not words:
            return out
        flat, starts = self.symbols_of(words)
        owner = np.repeat(np.arange(len(words)), np.diff(np.append(starts, len(flat))))
        live = np.arange(len(words))
        rank = np.full(len(flat), _NEVER)
        inner = np.flatnonzero(owner[:-1] == owner[1:])
        rank[inner] = self.pair_ranks(flat[inner], flat[inner + 1])
        while len(flat):
            least = np.minimum.reduceat(rank << 31 | np.arange(len(flat)), starts)
            at, going = least & ((1 << 31) - 1), least >> 31 < _NEVER
            if not going.all():
                stops = np.append(starts[1:], len(flat))
                for w, i, j in zip(live[~going].tolist(), starts[~going].tolist(), stops[~going].tolist(), strict=True):
                    out[w] = flat[i:j].tolist()
            at = at[going]
            flat[at] = self.result[rank[at]]
            keep = np.repeat(going, np.diff(np.append(starts, len(flat))))
            keep[at + 1] = False
            moved = np.cumsum(keep) - 1
            at = moved[at]
            flat, rank, owner, live = flat[keep], rank[keep], owner[keep], live[going]
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else owner
            last = np.append(owner[1:] != owner[:-1], True) if len(owner) else owner.astype(bool)
            rank[last] = _NEVER
            for x in (at[~last[at]], at[(at > 0) & ~last[at - 1]] - 1):
                rank[x] = self.pair_ranks(flat[x], flat[x + 1])
        return out

    def greedy(self, words: list[bytes]) -> list[list[int]]:
        """Longest vocabulary entry at each place, for all words at once; the word end belongs to the last symbol."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        prefix = _prefix_hash(raw)
        stop = np.cumsum(sizes)
        at = stop - sizes
        live, found = np.arange(len(words)), []
        while len(live):
            token = np.full(len(live), -1)
            length = np.minimum(stop[live] - at[live], self.longest)
            todo = np.arange(len(live))
            while len(todo):
                i, size = at[live[todo]], length[todo]
                got = self.entries.get(_piece_hash(prefix, i, size, i + size == stop[live[todo]]))
                hit = ~np.isnan(got)
                token[todo[hit]] = got[hit].astype(np.int64)
                todo = todo[~hit]
                length[todo] -= 1
            found.append((live, token))
            at[live] += length
            live = live[at[live] < stop[live]]
        order = np.argsort(np.concatenate([w for w, _ in found]), kind="stable") if found else []
        flat = np.concatenate([t for _, t in found])[order].tolist() if found else []
        counts = np.bincount(np.concatenate([w for w, _ in found]), minlength=len(words)) if found else sizes
        ends = np.cumsum(counts).tolist()
        return [flat[e - c : e] for e, c in zip(ends, counts.tolist(), strict=True)]

    def _spine(self, tokens: np.ndarray, side: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Edge parts of each token and the rank of the rule that takes each up (never, for the token)."""
        out, now, taken = [], tokens, np.full(len(tokens), _NEVER)
        while (now >= 0).any():
            out.append((now, taken))
            safe = np.maximum(now, 0)
            now, taken = np.where(now >= 0, side[safe], -1), self.rank[safe]
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each pair of adjacent tokens stays apart."""
        ok = np.ones(len(a), dtype=bool)
        lefts = self._spine(b, self.left)
        for r, r_taken in self._spine(a, self.right):
            for x, x_taken in lefts:
                key = np.where((r >= 0) & (x >= 0), r.astype(np.int64) * self.n + x, -1)
                at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
                k = np.where(self.pairs[at] == key, self.pair_rank[at], _NEVER)
                ok &= ~((k < r_taken) & (k <= x_taken) & (k < _NEVER))
        return ok

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        if not words:
            return []
        guesses = self.greedy(words)
        sizes = np.fromiter(map(len, guesses), np.int64, len(guesses))
        flat = np.fromiter(chain.from_iterable(guesses), np.int64, int(sizes.sum()))
        ends = np.cumsum(sizes)
        inner = np.ones(len(flat), dtype=bool)
        inner[ends - 1] = False
        at = np.flatnonzero(inner)
        codes, back = np.unique(flat[at] * self.n + flat[at + 1], return_inverse=True)
        ok = self.own_ok[flat]
        ok[at] &= self.compatible(codes // self.n, codes % self.n)[back]
        good = np.logical_and.reduceat(ok, ends - sizes)
        failed = np.flatnonzero(~good).tolist()
        for i, exact in zip(failed, self.merge([words[i] for i in failed]), strict=True):
            guesses[i] = exact
        return guesses

    def pieces(self, chunk: str) -> list[str | int]:
        """Words of a chunk after normalising, and ids of special tokens."""
        if chunk.isascii():
            if chunk.isalpha():
                return [chunk.lower()]
            if chunk[-1] in ".,;:!?" and chunk[:-1].isalpha():
                return [chunk[:-1].lower(), chunk[-1]]
        out: list[str | int] = []
        for part in self.split.split(chunk) if self.split else [chunk]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                # every character is lowered by itself: no special final sigma
                out += WORDS.findall(unicodedata.normalize("NFC", part).replace("Σ", "σ").lower())
        return out

    def encode_chunks(self, chunks: list[str], words: dict[str, tuple[int, ...]] | None = None) -> dict[str, tuple[bytes, bytes]]:
        """For each chunk: ids as little-endian 32-bit integers, and decoded text (UTF-8). ``words``: what is known of words, added to."""
        words = {} if words is None else words
        parted = list(map(self.pieces, chunks))
        new = list({p for ps in parted for p in ps if p not in words and not isinstance(p, int)})
        words.update(zip(new, self.encode_words([w.encode("utf-8", "replace") for w in new]), strict=True))
        out, tokens = {}, self.token_bytes
        for c, ps in zip(chunks, parted, strict=True):
            ids = words[ps[0]] if len(ps) == 1 and ps[0] in words else [i for p in ps for i in ([p] if isinstance(p, int) else words[p])]
            out[c] = (array("I", ids).tobytes(), b" ".join([tokens[i] for i in ids]))
        return out


def chunks_of(text: str) -> list[str]:
    return [c for c in _SPACE.split(text) if c] if _ODD.search(text) else text.split()


def decode(vocabulary: Vocabulary, ids: list[int]) -> str:
    """Tokens joined by spaces: the file names no decoder."""
    return " ".join(vocabulary.tokens[i] for i in ids)


def encode(docs: DataFrame, vocabulary_json: str, ids: bool = True, decoded: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian 32-bit), decoded (string).

    ``ids_sha256`` takes the place of ids where ``ids`` is false, and
    ``decoded_sha256`` that of decoded where ``decoded`` is: then no text goes
    back to the JVM.

    ``vocabulary_json`` is the file's content (read on the driver and sent to
    the executors once; its size doesn't depend on the data).
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary_json)
    names = f"doc_id long, n_tokens long, {'ids binary' if ids else 'ids_sha256 string'}, {'decoded' if decoded else 'decoded_sha256'} string"
    schema = arrow_schema(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, known, words = held(f"bpe-{hash(shared.value)}", lambda: (Vocabulary(shared.value), {}, {}))
        for b in slices(batches, most=1 << 20):
            texts = [chunks_of(t) for t in b.column("text").to_pylist()]
            if len(known) > REMEMBERED:
                known.clear()
            if len(words) > REMEMBERED:
                words.clear()
            new = set(chain.from_iterable(texts)).difference(known)
            known.update(vocabulary.encode_chunks(list(new), words))
            counts, coded, plain = [], [], []
            for t in texts:
                got = [known[c] for c in t]
                raw = b"".join([g[0] for g in got])
                text = b" ".join([g[1] for g in got])
                counts.append(len(raw) // 4)
                coded.append(raw if ids else hashlib.sha256(raw).hexdigest())
                plain.append(text.decode() if decoded else hashlib.sha256(text).hexdigest())
            yield batch(schema, b.column("doc_id"), counts, coded, plain)
            if any(len(c) > LONGEST for c in new):
                for kept in (known, words):
                    for c in [c for c in kept if len(c) > LONGEST]:
                        del kept[c]

    return document_text(docs).mapInArrow(run, names)


def vocabulary_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def op8_bpe(spark, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), vocabulary_file(), ids=False, decoded=False)
