"""Each operator against a plain version, and on odd tables."""

from __future__ import annotations

import hashlib
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from coordshift.llm import bpe, contexttree, digest, kneserney, lines, minhash, mixing, neighbours, passages, simhash, suffix
from coordshift.llm.common import components

WORDS = "the of and rain stone river cloud mill over under seven green house walk bright".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, shard int"


def prose(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[i] + str(rng.integers(0, 50)) for i in rng.integers(0, len(WORDS), n))


@pytest.fixture(scope="module")
def docs(spark):
    a, b = prose(1, 300), prose(2, 200)
    near = a.replace(a.split()[40], "changed", 1)
    rows = [(0, a), (1, b), (2, a), (3, near), (4, None), (5, ""), (6, "x"), (None, prose(3, 80)), (7, prose(4, 70) + "\n" + b + "\nend of it all"), (7, prose(5, 20)), (8, "Été " + prose(6, 3000)), (8, "Été " + prose(6, 3000)), (9, "aaaa" * 100)]
    return spark.createDataFrame([(i, t, "en" if i != 1 else None, "s0" if i != 2 else None, None, "clash", 3) for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = rng.integers(0, 60, (40, 2))
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges.tolist(), "a long, b long")).collect()}
    up = list(range(60))
    for _ in range(60):
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    assert all(got.get(i, i) == up[i] for i in range(60))


def plain_fingerprint(text: str, k: int) -> int:
    w = text.encode().lower().split()
    k = min(k, len(w))
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(len(w) - k + 1)] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs):
    got = simhash.near_duplicates(docs, 4, 1, 4).collect()
    assert len(got) == 13
    texts = {}
    for r in docs.collect():
        texts.setdefault(r["doc_id"], []).append(plain_fingerprint(r["text"] or "", 4))
    for r in got:
        assert int.from_bytes(r["fp"], "little") in texts[r["doc_id"]]
        assert (r["component_id"] is None) == (r["doc_id"] is None)
    near = {r["doc_id"]: r["component_id"] for r in got}
    assert near[2] == 0 and near[5] == 4


def test_simhash_finds_all_links(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    fps = {int(b) for b in base}
    for b in base:
        for _ in range(4):
            fps.add(int(b) ^ sum(1 << int(x) for x in rng.integers(0, 64, 4)))
    rows = [(i, bytearray(int(f).to_bytes(8, "little"))) for i, f in enumerate(sorted(fps))]
    found = components(simhash.links(spark.createDataFrame(rows, "node long, fp binary"), 4)).collect()
    comp = {r["node"]: r["component"] for r in found}
    all_ = sorted(fps)
    for i, x in enumerate(all_):
        for j in range(i):
            if (x ^ all_[j]).bit_count() <= 4:
                assert comp[i] == comp[j]


def test_near_dedup_finds_pairs_at_the_threshold(spark):
    import corpus_pipeline

    rng, rows, want = np.random.default_rng(5), [], set()
    for i in range(120):
        words = [f"w{x}" for x in rng.integers(0, 1 << 30, 304)]
        changed = list(words)
        # each change, far from others, breaks five of 300 shingles: 1 - 2 * 5c / (300 + 5c), 0.82 for 6 and 0.79 for 7
        c = 6 + i % 2
        for j in range(c):
            changed[10 + 40 * j] = "new"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(changed))]
        want |= {2 * i} if c == 6 else {2 * i, 2 * i + 1}
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, df, "").collect()} == want


def test_near_dedup_keeps_different_texts_of_one_doc_id(docs):
    import corpus_pipeline

    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(docs.sparkSession, docs, "").collect()]
    assert sorted(t for i, t in kept if i == 7) == sorted(r["text"] for r in docs.where("doc_id = 7").collect())
    assert sorted(i for i, _ in kept if i is not None) == [0, 1, 4, 6, 7, 7, 8, 9] and (None, prose(3, 80)) in kept


@pytest.mark.parametrize("volume", [1_000_000, 500])
def test_minhash_groups_equal_brute_force(spark, docs, empty, monkeypatch, volume):
    monkeypatch.setattr(minhash, "VOLUME", volume)
    rng, rows = np.random.default_rng(6), []
    for i in range(6):
        words = prose(100 + i, 150).split()
        for j in range(5):
            rows.append((10 * i + j, " ".join(words)))
            words[int(rng.integers(0, len(words)))] = f"x{j}"
            words[int(rng.integers(0, len(words)))] = f"y{j}"
    sets = {i: set(simhash.shingle_hashes(t, 5).tolist()) for i, t in rows}
    up = {i: i for i in sets}
    for _ in rows:
        for i, a in sets.items():
            for j, b in sets.items():
                if len(a & b) >= 0.8 * len(a | b):
                    up[i] = up[j] = min(up[i], up[j])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df).collect()} == up
    assert minhash.near_duplicates(docs).count() == 13 and minhash.near_duplicates(empty).count() == 0


def brute_spans(rows, length):
    seen, out = set(), {}
    for i, t in rows:
        b = t.encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        out[i] = bytes(x for x, g in zip(b, gone) if not g)
    return out


@pytest.mark.parametrize("shard", [3 << 20, 900])
def test_suffix(spark, monkeypatch, shard):
    monkeypatch.setattr(suffix, "SHARD", shard)
    a, b = prose(1, 120), prose(2, 90)
    rows = [(3, a), (5, b + a[100:400]), (6, "é" * 300), (9, ""), (11, a[50:300] + b), (12, "ab" * 200), (20, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["kept_sha256"] for r in suffix.keep_first(df, 100, False).collect()}
    assert got == {i: hashlib.sha256(k).hexdigest() for i, k in brute_spans(rows, 100).items()}


def test_suffix_odd_tables(docs, empty):
    assert suffix.keep_first(docs, 100, False).count() == 13
    assert suffix.keep_first(empty, 100, False).count() == 0


def test_bpe_equals_library(docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    v = bpe.Vocabulary(bpe.vocabulary_file())
    for t in ["", "Hello, WORLD's 'll 123 <|endoftext|>x", "ΣΑΣ İstanbul ﬁne é́ 中文 ²Ⅷ_\x1c!", prose(9, 50), "zzzz" * 40]:
        chunks = bpe.chunks_of(t)
        got = v.encode_chunks(chunks)
        ids = [i for c in chunks for i in np.frombuffer(got[c][0], dtype="<u4").tolist()]
        want = tok.encode(t, add_special_tokens=False).ids
        assert ids == want
        assert bpe.decode(v, ids) == tok.decode(want, skip_special_tokens=False)
    assert bpe.encode(docs, bpe.vocabulary_file()).count() == 13
    assert bpe.encode(empty, bpe.vocabulary_file()).count() == 0
    with pytest.raises(ValueError, match="normaliser"):
        bpe.Vocabulary(bpe.vocabulary_file().replace('"Lowercase"', '"Strip"'))


def test_bpe_digests_equal_library(spark):
    """Documents of many kinds, very long words among them, against the library's ids and text."""
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = np.random.default_rng(17)
    letters = list("abcdefgh ETAOIN éßøñ İΣς 中文かな 0123 .,;!?'’ \t\n_-@#|") + ["'s", "the ", "<|endoftext|>"]
    texts = ["".join(letters[i] for i in rng.integers(0, len(letters), int(rng.integers(0, 300)))) for _ in range(120)] + ["x" * 5000, "ab" * 3000 + " tail", " ", "\u00a0 \u2003"]
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for r in bpe.encode(df, bpe.vocabulary_file(), ids=False, decoded=False).collect():
        ids = tok.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_digest(spark, docs, empty):
    rows = [(1, "abc" * 30), (5, None), (9, prose(1, 40)), (12, "x"), (13, prose(1, 40))]
    got = {r["doc_id"]: r for r in digest.edited(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for (i, t), (_, n) in zip(rows, rows[1:] + rows[:1]):
        t, n = t or "", n or ""
        cut = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(cut.encode()).hexdigest()
        assert 0 <= got[i]["near_next"] <= 1
    assert got[9]["fingerprint"] == got[13]["fingerprint"]
    assert digest.edited(docs).count() == 13 and digest.edited(empty).count() == 0


def test_contexttree(docs, empty):
    out = contexttree.score(docs, depth=3).collect()
    assert len(out) == 13 and all(r["score"] < 0 and r["base_score"] < 0 for r in out)
    assert all(r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 5 == 1) for r in out)
    keys, owner = contexttree.gram_keys([b"abracadabra"], 2)
    tree = contexttree.Tree(*contexttree._runs(keys), 2)
    total = sum(10.0 ** tree.log10(np.array([(ord("a") << 16) | (ord("b") << 8) | x for x in range(256)], dtype=np.uint64)))
    assert abs(total - 1) < 1e-5
    assert contexttree.score(empty, depth=3).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 20)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(400, None), (500, [0.0] * 20), (600, [float("nan")] * 20), (700, [1.0])]
    got = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0, k=10).collect()
    assert {r["query_id"] for r in got} == {0, 100, 200, 300} and len(got) == 40
    hits = 0
    for q in (0, 100, 200, 300):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
        d[q] = np.inf
        hits += len({r["vec_id"] for r in got if r["query_id"] == q} & set(np.argsort(d)[:10].tolist()))
    assert hits >= 36
    assert neighbours.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0


def test_mixing(spark, docs, empty):
    # targets that can hold together: in ``docs`` the long texts, of one language and source, are four fifths of all tokens
    rows = [(i, prose(i, 20 + 7 * (i % 5)), ("en", None)[i % 3 == 0], ("s0", None)[i % 4 == 0]) for i in range(48)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    cells = mixing.fit(df, {"source": 0.0, "lang": {"en": 0.5, mixing.NONE: 0.5}, "topic": 1.0}, 0.5).toPandas()
    for margin in ("lang", "source"):
        mass = (cells["tokens"] * cells["weight"]).groupby(cells[margin]).sum()
        assert len(mass) == 2 and (abs(mass / mass.sum() - 0.5) < 0.01).all()
    assert abs((cells["tokens"] * cells["probability"]).sum() / cells["tokens"].sum() - 0.5) < 0.01
    assert mixing.sample(docs).columns == docs.columns
    assert mixing.sample(empty).count() == 0


def test_mixing_topic_reads_the_whole_text(spark):
    rows = [(1, prose(1, 100) + " under the License"), (2, prose(1, 100)), (3, "LICENSE " + prose(1, 9)), (4, prose(1, 9) + " | license")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["t"] for r in df.select("doc_id", mixing.topic(df["text"]).alias("t")).collect()} == {1: "legal", 2: "prose", 3: "legal", 4: "table"}


def test_lines(spark, docs, empty):
    shared = "a line that many documents have\nand another such line here"
    df = spark.createDataFrame([(2, "start\n" + shared), (1, shared + "\nown"), (3, None), (4, shared)], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in lines.remove_repeats(df).collect()} == {1: shared + "\nown", 2: "start", 3: None, 4: ""}
    assert lines.remove_repeats(docs).count() == 13 and lines.remove_repeats(empty).count() == 0


def test_kneserney(spark, docs, empty):
    texts = [(i, prose(i, 60), "en") for i in range(60)] + [(100, "@@@ %%% ### $$$ " * 20, "en"), (101, None, "en"), (102, prose(90, 60), None)]
    df = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(50)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in kneserney.score(df, labels).collect()}
    assert got[100]["rejected"] and not got[101]["rejected"] and sum(r["rejected"] for r in got.values()) <= 4
    keys, logs, last = kneserney.train(df.where("doc_id < 20").select("text"), 2)
    known = kneserney.LookupTable(keys, logs)
    p = [np.exp(kneserney.log_likelihoods([prose(1, 1) + chr(c)], known, last, 2)[1][0] - kneserney.log_likelihoods([prose(1, 1)], known, last, 2)[1][0]) for c in range(300)]
    assert abs(sum(p) + (kneserney.ALPHABET - 300) * p[-1] - 1) < 0.02
    assert kneserney.score(docs, labels).count() == 13 and kneserney.score(empty, labels).count() == 0


def test_passages(spark, docs, empty):
    shared = prose(50, 80).split()
    changed = [*shared[:30], "other", *shared[31:60], "new", *shared[60:]]
    df = spark.createDataFrame([(1, prose(51, 100) + " " + " ".join(shared)), (2, " ".join(changed) + " " + prose(52, 100)), (3, prose(53, 200))], "doc_id long, text string")
    got = passages.find_passages(df).collect()
    assert [(r["doc_id"], r["source_id"]) for r in got] == [(2, 1)] and got[0]["start"] == 0 and got[0]["n_words"] == 81
    assert passages.find_passages(docs).count() > 0 and passages.find_passages(empty).count() == 0


def varied(rng, n: int) -> list[str]:
    return [f"v{x}" for x in rng.integers(0, 1 << 40, n)]


def test_passages_inside_rejected_chains(spark):
    rng, rows = np.random.default_rng(8), []
    for i in range(20):
        a, b, c = (varied(rng, k) for k in (20, 20, 52))
        rows += [(100 + i, " ".join(a + varied(rng, 17) + b + varied(rng, 17) + c)), (200 + i, " ".join(a + varied(rng, 17) + b + varied(rng, 17) + c))]
    got = passages.find_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["source_id"]) for r in got if r["end"] >= 126 and r["n_words"] >= 52 and r["similarity"] >= 0.8} >= {(200 + i, 100 + i) for i in range(20)}


def test_passages_of_a_second_source(spark):
    rng = np.random.default_rng(9)
    runs = [varied(rng, 20) for _ in range(20)]
    # the first source has runs of 20 equal words and eight that differ, at most 48 words at 0.8; the second an exact passage
    one, own = ([w for r in runs for w in r + varied(rng, 8)] for _ in range(2))
    rows = [(1, one), (2, varied(rng, 30) + own[200:270] + varied(rng, 30)), (3, own)]
    got = passages.find_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")).collect()
    assert [(r["doc_id"], r["source_id"], r["start"], r["end"]) for r in got] == [(3, 2, 200, 270)]


def test_passages_at_several_places(spark):
    rng = np.random.default_rng(10)
    p, q = varied(rng, 60), varied(rng, 60)
    rows = [(1, p + varied(rng, 30)), (2, varied(rng, 40) + p + varied(rng, 40) + p), (3, q + varied(rng, 70) + q), (4, varied(rng, 200))]
    got = passages.find_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["start"], r["end"]) for r in got} == {(2, 40, 100), (2, 140, 200), (3, 130, 190)}
    assert all((r["source_id"], r["source_start"]) in {(1, 0), (2, 40), (3, 0)} and r["similarity"] == 1 for r in got)


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        new = stage(spark, docs, sf)
        if name != "tokenise":
            assert new.columns == docs.columns
        docs = new
    assert 0 < docs.count() < 200


def found_spans(spark, rows, **more):
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    return passages.find_passages(df, **more).collect()


def test_passages_that_others_quote(spark):
    """Two documents share 80 words; many others quote parts of them before, between and after."""
    rng = np.random.default_rng(11)
    p = varied(rng, 80)
    part = lambda i: p[(7 * i) % 52 : (7 * i) % 52 + 28]
    rows = [(i, varied(rng, 30) + part(i) + varied(rng, 30)) for i in range(60) if i not in (20, 50)]
    rows += [(20, varied(rng, 40) + p + varied(rng, 40)), (50, varied(rng, 25) + p + varied(rng, 9))]
    got = [(r["doc_id"], r["source_id"], r["start"], r["end"]) for r in found_spans(spark, sorted(rows))]
    assert (50, 20, 25, 105) in got and all(d == 50 for d, *_ in got)


def test_passages_equal_brute_force_on_changed_copies(spark):
    """Copies of 60 words with a share of them changed: those still alike enough by plain alignment are found."""
    rng, rows, want = np.random.default_rng(12), [], set()
    for i in range(80):
        p = varied(rng, 60)
        q = [w if rng.random() > (0.06, 0.12, 0.16)[i % 3] else f"c{rng.integers(0, 1 << 40)}" for w in p]
        rows += [(1000 + i, varied(rng, 30) + p + varied(rng, 30)), (2000 + i, varied(rng, 30) + q + varied(rng, 30))]
        if sum(a == b for a, b in zip(p, q, strict=True)) >= 0.82 * 60:
            want.add((2000 + i, 1000 + i))
    got = {(r["doc_id"], r["source_id"]) for r in found_spans(spark, rows)}
    assert got <= {(2000 + i, 1000 + i) for i in range(80)} and len(want & got) >= 0.9 * len(want) and len(want) > 60


def test_passages_of_one_common_source(spark, monkeypatch):
    """Many documents have changed copies of one passage: its text is dealt to several shards."""
    monkeypatch.setattr(passages, "FEW", 3)
    monkeypatch.setattr(passages, "HOT", 10**9)
    rng = np.random.default_rng(19)
    p = varied(rng, 70)
    rows = [(1, p)] + [(i, varied(rng, 20) + [w if rng.random() > 0.05 else f"c{i}" for w in p] + varied(rng, 20)) for i in range(2, 40)]
    got = found_spans(spark, rows)
    assert {r["doc_id"] for r in got} == set(range(2, 40)) and all(r["similarity"] >= 0.8 for r in got)


def test_only_texts_of_many_chains_are_sent_again(spark, monkeypatch):
    """All other texts stay where they are dealt; each row of chains meets its text once."""
    monkeypatch.setattr(passages, "FEW", 3)
    monkeypatch.setattr(passages, "HOT", 10**9)
    texts = spark.createDataFrame([(i % 4, i, 0, bytearray(b"x")) for i in range(20)], "shard int, doc long, tie long, packed binary")
    rows = [(d % 4, d, 0, 2, bytearray([d, k])) for d, times in ((5, 12), (6, 1), (7, 1)) for k in range(times)]
    chains = spark.createDataFrame(rows, "shard int, doc2 long, tie2 long, n int, heads binary")
    (own, most), (again, rest) = passages.spread(texts, chains, 4)
    assert own is texts and {r["doc"] for r in again.collect()} == {5} and again.count() == 7
    assert sorted(r["heads"] for d in (most, rest) for r in d.collect()) == sorted(r[4] for r in rows) and rest.count() > 0
    for t, c in ((own, most), (again, rest)):
        at = {(r["shard"], r["doc"]) for r in t.collect()}
        assert {(r["shard"], r["doc2"]) for r in c.collect()} <= at
    (own, most), = passages.spread(texts, chains.where("doc2 > 5"), 4)
    assert own is texts and most.count() == 2


def test_chains_to_one_text_share_their_words(spark, monkeypatch):
    """Equal words of chains that lead to one text are sent once, and no link is lost however they are dealt."""
    rng, sent = np.random.default_rng(23), []
    spread = passages.spread
    monkeypatch.setattr(passages, "spread", lambda t, c, n: [sent.append(c), spread(t, c, n)][1])
    p = varied(rng, 400)
    rows = [(i, p + varied(rng, 20 + i)) for i in range(30)]
    got = found_spans(spark, rows)
    assert {r["doc_id"] for r in got if r["n_words"] >= 400} == set(range(1, 30))
    chains = sent[0].collect()
    words = sum(int(suffix.unpack(r["heads"], passages._HEADS)[3].sum()) for r in chains)
    assert len(chains) < sum(r["n"] for r in chains) and sum(len(r["words"]) for r in chains) < 0.75 * 4 * words
    monkeypatch.setattr(passages, "TOGETHER", 2)
    assert sorted(found_spans(spark, rows)) == sorted(got)


def test_finished_shuffles_are_given_up(spark):
    """The files of a step's shuffle don't stay until the run ends, while its result is in use."""
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {x.rsplit("/", 1)[-1] for x in manager.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in x}
    before = files()
    out = passages.finished(spark.range(1000).selectExpr("id", "id % 3 as k").repartition(3, "k"))
    mine = files() - before
    # the first step's files go by the sweep after the next one
    for _ in range(5):
        again = passages.finished(out.where("k = 1"))
        time.sleep(0.5)
    assert not files() & mine and out.count() == 1000 and again.count() == 333


def test_seeds_of_long_texts(monkeypatch):
    rng = np.random.default_rng(13)
    words = [rng.integers(0, 1 << 60, n).astype(np.uint64) for n in (0, 3, 8, 500, 77)] + [np.zeros(60, dtype=np.uint64)]
    whole = passages.seeds(words)
    monkeypatch.setattr(passages, "_PART", 16)
    assert all((a == b).all() for a, b in zip(whole, passages.seeds(words), strict=True)) and len(whole[0]) > 100


def test_lines_equal_brute_force(spark):
    rng = np.random.default_rng(14)
    pool = [f"line {i} " + "x" * int(rng.integers(0, 60)) for i in range(9)] + ["", "}", "  ", "a b"]
    rows = [(int(i), "\n".join(pool[j] for j in rng.integers(0, len(pool), int(rng.integers(0, 14))))) for i in rng.permutation(60)]
    rows += [(100, rows[3][1]), (101, "z" * 50), (102, "z" * 50 + "\n" + "\n".join("abcdefgh")), (103, "\n".join("abcdefgh") + "\n" + "y" * 45)]
    texts = [(i, [x.strip(" ") for x in t.split("\n")]) for i, t in sorted(rows)]
    places = [(d, p) for d, (_, own) in enumerate(texts) for p in range(len(own))]
    want = {}
    for d, (i, own) in enumerate(texts):
        gone = set()
        for p in range(len(own)):
            longest = 0
            for e, q in places:
                if (e, q) >= (d, p):
                    break
                n = 0
                while p + n < len(own) and q + n < len(texts[e][1]) and own[p + n] == texts[e][1][q + n]:
                    n += 1
                longest = max(longest, n)
            if sum(map(len, own[p : p + longest])) >= 40:
                gone |= set(range(p, p + longest))
        kept = [x for k, x in enumerate(dict(rows)[i].split("\n")) if k not in gone]
        want[i] = ("\n".join(kept), len(gone), sum(k - 1 not in gone for k in gone))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit("clash")).withColumn("place", F.lit(1))
    got = lines.remove_repeats(df)
    assert got.columns == ["doc_id", "text", "place", "n_lines", "n_removed", "n_runs"]
    assert {r["doc_id"]: (r["text"], r["n_removed"], r["n_runs"]) for r in got.collect()} == want


def plain_kneserney(texts, order):
    """Probabilities of the next character by dictionaries of counts."""
    from collections import Counter, defaultdict

    start = chr(kneserney._START) if kneserney._START < 0x110000 else "\0"
    padded = [start * (order - 1) + t for t in texts]
    top = Counter(t[i : i + order] for t in padded for i in range(len(t) - order + 1))
    counts = {order: top}
    for m in range(order - 1, 0, -1):
        counts[m] = Counter(g[1:] for g in counts[m + 1])
    offs, contexts = {}, {}
    for m, c in counts.items():
        n1, n2, n3, n4 = (sum(v == k for v in c.values()) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
        offs[m] = [min(max(k - (k + 1) * y * (b / a if a else 0.5), 0.05), k - 0.05) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        contexts[m] = defaultdict(list)
        for g, v in c.items():
            contexts[m][g[:-1]].append(v)

    def p(context, x):
        if not context and not counts[1]:
            return 1 / kneserney.ALPHABET
        m = len(context) + 1
        lower = p(context[1:], x) if context else 1 / kneserney.ALPHABET
        own = contexts[m].get(context)
        if not own:
            return lower
        less = lambda v: offs[m][min(v, 3) - 1]
        v = counts[m].get(context + x, 0)
        return ((v - less(v)) if v else 0) / sum(own) + sum(map(less, own)) / sum(own) * lower

    return lambda t: sum(np.log(p((start * (order - 1) + t)[i : i + order - 1], t[i])) for i in range(len(t)))


def test_kneserney_equals_plain_counts(spark):
    trained = [prose(i, 30) for i in range(8)]
    asked = [(1, prose(3, 30), "en"), (2, prose(90, 20), "de"), (3, "zzz Ω", None), (4, "", "en"), (5, None, "en"), (None, prose(91, 5), "en"), (2, prose(90, 20), "de")]
    known = kneserney.model(spark.createDataFrame([(t,) for t in trained], "text string"), 3)
    df = spark.createDataFrame(asked, "doc_id long, text string, lang string")
    got = sorted((r["n_units"], round(-r["nats"], 4)) for r in kneserney.perplexities(df, known, 3).collect())
    plain = plain_kneserney(trained, 3)
    assert [n for n, _ in got] == sorted(len(t or "") for _, t, _ in asked)
    assert np.allclose([x for _, x in got], [x for _, x in sorted((len(t or ""), round(float(plain(t or "")), 4)) for _, t, _ in asked)], rtol=1e-4, atol=1e-3)


def test_quality_keeps_other_columns(spark):
    rows = [(i, prose(i, 60), "en") for i in range(60)] + [(100, "@@@ %%% ### $$$ " * 20, "en"), (101, None, "en"), (None, "@@@ %%% ### $$$ " * 20, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("limit", F.lit("x")).withColumn("n_units", F.lit(2)).withColumn("rejected", F.lit(3))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(50)], "doc_id long, quality int, toxic int")
    kept = kneserney.keep(df, labels)
    assert kept.columns == df.columns and {101} <= {r["doc_id"] for r in kept.collect()} and not kept.where("text like '@@@%'").count()
    none = labels.where("false")
    assert kneserney.keep(df, none).count() == 63


def test_limits_are_quantiles(spark):
    rows = [("en", i / 1000) for i in range(1, 1001)] + [("de", 5.0), (None, 7.0)]
    got = {r["lang"]: r["limit"] for r in kneserney.limits(spark.createDataFrame(rows, "lang string, level double")).collect()}
    assert abs(got["en"] - 0.995) < 2e-4 and abs(got["de"] - 5.0) < 2e-4 and abs(got[None] - 0.997) < 2e-3


def test_mixing_equals_plain_raking(spark):
    rng = np.random.default_rng(15)
    rows = [(i, prose(i, int(rng.integers(5, 90))) + (" | " if i % 5 == 0 else ""), ("en", "de", None)[int(rng.integers(0, 3))], ("s0", "s1", "s2")[int(rng.integers(0, 3))]) for i in range(200)]
    targets = {"source": {"s0": 0.2, "s1": 0.5, "s2": 0.3}, "lang": {"en": 0.6, "de": 0.3, mixing.NONE: 0.1}, "topic": 0.5}
    cells = mixing.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), targets, 0.5).toPandas()
    goals = {m: targets[m] for m in ("source", "lang")}
    sums = cells.groupby("topic")["tokens"].sum() ** 0.5
    goals["topic"] = (sums / sums.sum()).to_dict()
    total, w = cells["tokens"].sum(), np.ones(len(cells))
    for _ in range(12):
        for m in ("source", "lang", "topic"):
            now = (cells["tokens"] * w).groupby(cells[m]).transform("sum")
            w = w * (cells[m].map(goals[m]) * total / now)
    assert np.allclose(cells["weight"], w, rtol=2e-3)


def test_mixing_tells_of_targets_that_cannot_hold(spark):
    rows = [(i, prose(i, 20), "en", "s0") for i in range(9)] + [(i, prose(i, 20), "de", "s1") for i in range(10, 19)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    with pytest.warns(UserWarning, match="targets are missed"):
        mixing.fit(df, {"source": {"s0": 0.9, "s1": 0.1}, "lang": {"en": 0.1, "de": 0.9}, "topic": 1.0})


def test_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(16)
    x = np.round(rng.standard_normal((300, 12)), 2)
    x[50:60] = x[40:50]
    x[7] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 10 == 0, k=5, lists=4, probes=1).collect()
    for q in range(0, 300, 10):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        want = [i for i in np.lexsort((np.arange(300), d)) if i != q][:5]
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [v for _, v, _ in own] == want and [k for k, _, _ in own] == [1, 2, 3, 4, 5]
        assert np.allclose([s for _, _, s in own], d[want], rtol=0, atol=1e-12)


@pytest.mark.parametrize(("lists", "block"), [(1, 50), (40, 50), (40, 10_000)])
def test_neighbours_recall_does_not_hang_on_lists(spark, monkeypatch, lists, block):
    """Vectors without clusters, few lists looked into first: recall against brute force stays."""
    monkeypatch.setattr(neighbours, "BLOCK", block)
    rng = np.random.default_rng(18)
    x = rng.standard_normal((1500, 24))
    got = neighbours.search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), F.col("vec_id") % 25 == 0, lists=lists, probes=1).collect()
    hits = 0
    for q in range(0, 1500, 25):
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hits += len({r["vec_id"] for r in got if r["query_id"] == q} & set(np.argsort(d)[:10].tolist()))
    assert len(got) == 600 and hits >= 0.98 * 600


def plain_tree(data: bytes, depth: int):
    """log10 probability of a byte after a context, by weighting whole contexts over dictionaries."""
    from collections import Counter
    from math import lgamma

    padded = bytes(depth) + data + bytes(1)
    counts = Counter()
    for i in range(depth, len(padded)):
        node = 1
        for j in range(7, -1, -1):
            for d in range(depth + 1):
                counts[padded[i - d : i], node, padded[i] >> j & 1] += 1
            node = 2 * node + (padded[i] >> j & 1)
    kt = lambda a, b: lgamma(a + 0.5) + lgamma(b + 0.5) - lgamma(a + b + 1) - np.log(np.pi)
    weighted: dict[tuple[bytes, int], float] = {}
    share: dict[tuple[bytes, int], float] = {}
    for d in range(depth, -1, -1):
        for c, k in {(c, k) for c, k, _ in counts if len(c) == d}:
            own = kt(counts[c, k, 0], counts[c, k, 1])
            deeper = sum(v for (e, m), v in weighted.items() if len(e) == d + 1 and m == k and e[1:] == c)
            weighted[c, k] = own if d == depth else np.logaddexp(own, deeper) - np.log(2)
            share[c, k] = 1.0 if d == depth else float(np.exp(own - np.log(2) - weighted[c, k]))

    def log10(context: bytes, byte: int) -> float:
        total, node = 0.0, 1
        for j in range(7, -1, -1):
            p, left = 0.0, 1.0
            for d in range(depth + 1):
                c = context[depth - d :]
                if (c, node) not in share:
                    break
                n0, n1 = counts[c, node, 0], counts[c, node, 1]
                p, left = p + left * share[c, node] * (n1 + 0.5) / (n0 + n1 + 1), left * (1 - share[c, node])
            p += left / 2
            bit = byte >> j & 1
            total += np.log10(p if bit else 1 - p)
            node = 2 * node + bit
        return total

    return log10


def test_contexttree_equals_plain_weighting():
    data, depth = b"abracadabra, abracadabra; cabbage", 3
    keys, _ = contexttree.gram_keys([data], depth)
    tree, plain = contexttree.Tree(*contexttree._runs(keys), depth), plain_tree(data, depth)
    asked = [*np.unique(keys).tolist(), *(int.from_bytes(x, "big") for x in (b"abrx", b"zzza", b"rac ", b"xbra"))]
    want = [plain(k.to_bytes(depth + 1, "big")[:depth], k & 255) for k in asked]
    assert np.allclose(tree.log10(np.array(asked, dtype=np.uint64)), want, atol=1e-4)


def test_contexttree_base_score_is_a_plain_count(spark):
    texts = {i: prose(i, 25).upper() + ("  x\n" if i % 3 else "") for i in range(12)} | {12: "", 13: "Ä b"}
    out = {r["doc_id"]: r for r in contexttree.score(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), depth=3).collect()}
    lower = {i: t.encode().lower().split() for i, t in texts.items()}
    held = {i for i in texts if zlib.crc32(str(i).encode()) % 5 == 1}
    from collections import Counter

    c = Counter(w for i, own in lower.items() if i not in held for w in [*own, None])
    n, v = sum(c.values()), len(c)
    for i, own in lower.items():
        r = out[i]
        tokens = [*own, None]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i in held, len(tokens), sum(c[w] > 0 for w in tokens), n)
        assert abs(r["base_score"] - sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)) < 1e-9


def plain_digest(data: bytes) -> list[int]:
    """Bucket counts by single steps, quartiles by sorting, codes one by one."""
    m32 = (1 << 32) - 1
    k = [int(x) for x in (digest._A, digest._B, digest._C, digest._M)]
    counts = [0] * digest.BUCKETS
    for i in range(len(data) - 4):
        for second, third in ((1, 2), (1, 3), (2, 4)):
            h = (data[i] * k[0] + data[i + second] * k[1] + data[i + third] * k[2]) & m32
            h = ((h ^ (third * 0x51ED27)) * k[3]) & m32
            counts[(((h ^ (h >> 15)) * k[0]) & m32) >> 25] += 1
    q1, q2, q3 = (sorted(counts)[i * digest.BUCKETS // 4 - 1] for i in (1, 2, 3))
    codes = [(c > q1) + (c > q2) + (c > q3) for c in counts]
    head = [zlib.crc32(data) & 255, min(255, int(np.log1p(len(data)) * 8)), (q1 * 15 // max(q3, 1)) << 4 | q2 * 15 // max(q3, 1)]
    return head + [sum(c << 2 * j for j, c in enumerate(codes[i : i + 4])) for i in range(0, len(codes), 4)]


def plain_likeness(a: list[int], b: list[int]) -> float:
    score = (a[0] != b[0]) + min(12, abs(a[1] - b[1])) + sum(min(12, abs((a[2] >> s & 15) - (b[2] >> s & 15))) for s in (0, 4))
    score += sum((0, 1, 2, 6)[abs((x >> s & 3) - (y >> s & 3))] for x, y in zip(a[3:], b[3:], strict=True) for s in (0, 2, 4, 6))
    return 1 - score / digest.MOST


def test_digest_equals_plain(spark):
    rows = [(1, prose(1, 200)), (2, prose(1, 199) + " other"), (3, prose(2, 200)), (4, ""), (5, None), (6, "é" * 30)]
    got = {r["doc_id"]: r for r in digest.edited(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = [t or "" for _, t in rows]
    for k, (i, _) in enumerate(rows):
        t, n = texts[k], texts[(k + 1) % len(rows)]
        own, after, cut = (plain_digest(x.encode()) for x in (t, n, t[: len(t) - len(t) // 2] + n[: len(t) // 2]))
        assert got[i]["fingerprint"] == bytes(own).hex() and got[i]["edited_fingerprint"] == bytes(cut).hex()
        assert abs(got[i]["near_edited"] - plain_likeness(own, cut)) < 1e-12 and abs(got[i]["near_next"] - plain_likeness(own, after)) < 1e-12
    assert got[1]["near_next"] > got[2]["near_next"]


def test_passages_of_common_pieces(spark):
    """Two documents share a passage whose equal pieces are short and each common to many more, alone and by twos and threes."""
    rng = np.random.default_rng(20)
    rows, want, at = [], set(), 0
    for _ in range(10):
        pieces = [varied(rng, 11) for _ in range(6)]
        whole = lambda: [w for p in pieces for w in [*p, f"c{rng.integers(0, 1 << 40)}"]]
        # six others have any three pieces that follow each other, before, between and after the two
        some = lambda i: [w for p in pieces[i : i + 3] for w in [*p, f"c{rng.integers(0, 1 << 40)}"]]
        for k in range(30):
            own = whole() if k in (12, 24) else some(k % 4)
            rows.append((at + k, varied(rng, 30) + own + varied(rng, 30)))
        want.add((at + 24, at + 12))
        at += 100
    got = {(r["doc_id"], r["source_id"]) for r in found_spans(spark, rows) if r["similarity"] >= 0.8 and r["n_words"] >= 50}
    assert got == want


@pytest.mark.parametrize(("block", "small"), [(8_192, 48), (8_192, 4), (7, 48)])
def test_alike_equals_plain_comparison(spark, monkeypatch, block, small):
    """Each copy of a changed passage among many quotes has a source, however its common seeds are dealt."""
    monkeypatch.setattr(passages, "BLOCK", block)
    monkeypatch.setattr(passages, "_SMALL", small)
    rng = np.random.default_rng(21)
    line, rows = varied(rng, 20), []
    for i in range(60):
        rows.append((i, varied(rng, 25 + i % 7) + line + varied(rng, 40)))
    tail = varied(rng, 40)
    for i in (15, 42, 58):
        own = [w if k % 9 else f"c{i}-{k}" for k, w in enumerate(tail)]
        rows[i] = (i, varied(rng, 30) + line + own + varied(rng, 20))
    got = found_spans(spark, rows)
    assert {r["doc_id"] for r in got} == {42, 58} and all(r["source_id"] in (15, 42) and r["n_words"] >= 55 for r in got)


def test_passages_in_bounded_tasks(spark, monkeypatch):
    """What a task holds follows its limits, and the result doesn't."""
    rng = np.random.default_rng(23)
    line, tail = varied(rng, 20), varied(rng, 40)
    rows = [(i, varied(rng, 25 + i % 7) + line + varied(rng, 40)) for i in range(40)]
    for i in (15, 32, 38):
        rows[i] = (i, varied(rng, 30) + line + [w if k % 9 else f"c{i}-{k}" for k, w in enumerate(tail)] + varied(rng, 20))
    monkeypatch.setattr(passages, "BLOCK", 7)
    want = found_spans(spark, rows)
    opposed, sizes = passages.opposed, []
    monkeypatch.setattr(passages, "SHARD", 1 << 12)
    monkeypatch.setattr(passages, "ROWS", 50)
    dealt = pa.RecordBatch.from_arrays([pa.array([0]), pa.array([suffix.pack(*(np.arange(100).astype(k) if k != "<i4" else np.full(100, 30, dtype=k) for k in passages._AROUND))])], names=["shard", "block"])
    monkeypatch.setattr(passages, "_SENT", 600)
    for b in opposed(iter([dealt]), 9):
        sizes.append(sum(len(suffix.unpack(x, passages._AROUND)[0]) for x in b.column("block").to_pylist()))
    assert sum(sizes) == 3000 and max(sizes) <= 600
    assert passages.shards_of(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string"), most=passages.SHARD) > 4
    got = found_spans(spark, rows)
    assert len(want) > 0 and sorted(map(str, got)) == sorted(map(str, want))


@pytest.mark.parametrize("size", [None, 10**8])
def test_near_dedup_groups_come_from_the_pigeonhole(spark, docs, empty, monkeypatch, size):
    """Groups equal brute force on whole sets, also with parts as wide as for many rows; the pipeline's come this way."""
    import corpus_pipeline
    from coordshift.llm import nearcopies

    rng, rows, called = np.random.default_rng(22), [], []
    links = simhash.links
    monkeypatch.setattr(simhash, "links", lambda *a, **k: called.append(a) or links(*a, **k))
    for i in range(60):
        words = varied(rng, int(rng.integers(5, 320)))
        rows.append((10 * i, " ".join(words)))
        # copies down to a similarity of about 0.8, changed in a block at the end
        for j in range(1, 4):
            c = max(1, int((len(words) - 4) * rng.uniform(0.02, 0.12)))
            rows.append((10 * i + j, " ".join(words[:-c] + varied(rng, c))))
    sets = {i: set(simhash.shingle_hashes(t, 5).tolist()) for i, t in rows}
    up = {i: i for i in sets}
    for _ in range(4):
        for i, a in sets.items():
            for j in range(i // 10 * 10, i // 10 * 10 + 4):
                if len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                    up[i] = up[j] = min(up[i], up[j])
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"]: r["component_id"] for r in nearcopies.near_duplicates(df, rows=size).collect()} == up
    if size is None:
        assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, df, "").collect()} == set(up.values()) and len(called) == 2
        assert nearcopies.near_duplicates(docs).count() == 13 and nearcopies.near_duplicates(empty).count() == 0


def wide_prints(seed: int, groups: int, each: int, rest: int):
    """Fingerprints of four words: ``groups`` groups of near copies (2 % of the bits changed), and random ones."""
    rng = np.random.default_rng(seed)
    bits = np.repeat(rng.integers(0, 2, (groups, 256)), each, axis=0) ^ (rng.random((groups * each, 256)) < 0.02)
    bits = np.concatenate([bits, rng.integers(0, 2, (rest, 256))])
    return np.packbits(bits.astype(np.uint8), axis=1, bitorder="little").view("<u8")


def plain_groups(fps, limit: int) -> list[int]:
    up = list(range(len(fps)))
    near = [np.flatnonzero(np.bitwise_count(fps ^ x).sum(axis=1) <= limit) for x in fps]
    while (new := [min(up[j] for j in js) for js in near]) != up:
        up = new
    return up


@pytest.mark.parametrize("block, held", [(20_000, 1 << 20), (150, 100)])
def test_links_of_near_copies_are_a_forest(spark, monkeypatch, block, held):
    """A group of near copies is linked by no more rows than it has under each part, in blocks too, and to the groups of brute force."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "_LINKS", held, raising=False)
    fps = wide_prints(31, 2, 220, 300)
    limit, want = 30, plain_groups(fps, 30)
    df = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(fps)], "node long, fp binary").repartition(3)
    found = simhash.links(df, limit, 4, 8, 3, 256) if block > len(fps) else simhash.links(df, limit, 4, 8, 4, 256)
    got = {r["node"]: r["component"] for r in components(found).collect()}
    assert [got.get(i, i) for i in range(len(fps))] == want and sum(w != i for i, w in enumerate(want)) >= 438
    nodes = np.arange(220)
    same = np.zeros(220, dtype=np.int64)
    a, b = simhash.bucket_links(same, same, same == 0, nodes, fps[:220], 256, 256)
    assert len(a) == 219 and (a == 0).all() and sorted(b.tolist()) == list(range(1, 220))


def test_only_crowded_part_values_are_counted(spark, monkeypatch):
    """What is sent to find the crowded values doesn't grow with the values there are, and misses none."""
    monkeypatch.setattr(simhash, "BLOCK", 100)
    fps = wide_prints(32, 1, 400, 2400)
    df = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(fps)], "node long, fp binary").repartition(4)
    kind, sent, dealt = type(df), [], []
    own, written = kind.mapInArrow, simhash.checkpointed
    monkeypatch.setattr(kind, "mapInArrow", lambda d, f, schema, *a, **k: [out := own(d, f, schema, *a, **k), sent.append(out) if schema == "bucket long, n long" else None][0])
    monkeypatch.setattr(simhash, "checkpointed", lambda d: [out := written(d), dealt.append(out)][0])
    got = {r["node"]: r["component"] for r in components(simhash.links(df, 30, 4, 8, None, 256)).collect()}
    assert [got.get(i, i) for i in range(len(fps))] == plain_groups(fps, 30)
    # 32 parts of 256 values; a part has few values with more than 25 of 2,800 fingerprints
    assert len(sent) == 1 and sent[0].count() < 32 * 4 * 8
    blocks = {r["bucket"]: r["blocks"] for r in dealt[0].collect()}
    filed = simhash.file_under(df, 4, *parts_of(df), 4).groupBy("bucket").count().collect()
    assert max(r["count"] for r in filed) > 200 and all(blocks.get(r["bucket"], 1) * 100 >= r["count"] for r in filed)


def parts_of(df):
    counts = simhash.bit_statistics(df, 4)
    parts = simhash.group_bits(counts[:-1].reshape(256, 256), counts[-1], [8] * 32)
    return parts, simhash.allocate(parts, np.diag(counts[:-1].reshape(256, 256)) / counts[-1], counts[-1], 30)
