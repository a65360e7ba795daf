"""Quality by the perplexity of an interpolated modified Kneser-Ney model.

A character n-gram model is trained on trusted texts: all rows labelled good
and not toxic, but for one in ``FOLDS`` by a hash of doc_id, which is held out.
Highest-order counts, continuation counts of the lower orders, totals of
contexts and interpolated probabilities are made by shuffled counts and joins
on n-gram keys. Documents are dealt to shards, each of which asks once for
every gram it holds; asks and the model meet in shards by the gram's hash, and
the answers return, so neither the model nor any count leaves the executors.

A document is rejected if its perplexity, drawn towards the trusted mean as if
it were ``PRIOR`` characters longer, is above a high quantile of the held-out
trusted documents of its language. The quantile is read from a histogram with
bins of ``BIN`` nats, so it takes no sorting. A language with fewer held-out
documents than 1 / (1 - quantile) has no such quantile; the normal quantile of
its levels stands in where it is higher than their maximum.

Defined cases: null and empty texts have no characters and the trusted mean
perplexity, and are kept; languages without held-out documents (and null) use
the quantile over all; documents without labels are judged like others; rows
with a null doc_id can't be labelled; repeated rows are judged alike; without
any held-out trusted text nothing is rejected; extra columns are ignored by
``score`` and carried along by ``keep``, whatever their names; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coordshift.llm.common import LookupTable, arrow_schema, batch, checkpointed, document_text, give_back, mixed, shards_of, slices, table
from coordshift.llm.suffix import _BLOCKS, _blocks, _home, _joined, pack, unpack

ORDER = 4
FOLDS = 4
PRIOR = 60
QUANTILE = 0.995
#: Ids of trusted rows that are sent to every executor at most (8 bytes each); more are joined by a shuffle.
SENT = 4_000_000
#: Normal deviate of the quantile.
_DEVIATE = 2.576
BIN = 1e-4
#: Code points the last share of probability is spread over.
ALPHABET = 65_536
_C = np.uint64(0x9FB21C651E98DF25)
_START = 1 << 21


def _units(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the texts, each after order - 1 start marks; which are characters; sizes."""
    raw = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype="<u4") for t in texts]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    ends = np.cumsum(sizes + order - 1)
    x = np.full(int(ends[-1]) if len(ends) else 0, _START, dtype=np.uint64)
    real = np.ones(len(x), dtype=bool)
    starts = ends - sizes - (order - 1)
    for k in range(order - 1):
        real[starts + k] = False
    x[real] = np.concatenate(raw) if raw else x
    return x, real, sizes


def gram_keys(x: np.ndarray, order: int) -> list[np.ndarray]:
    """Keys of the last 0, 1, ... order units up to each place."""
    unit = mixed(x + np.uint64(1))
    sums, power, out = np.zeros(len(x), dtype=np.uint64), np.uint64(1), [np.zeros(len(x), dtype=np.uint64)]
    for m in range(order):
        sums = sums.copy()
        sums[m:] += unit[: len(x) - m] * power
        with np.errstate(over="ignore"):
            power = power * _C
        out.append(mixed(sums + np.uint64(m + 1)))
    return out


def _before(keys: np.ndarray) -> np.ndarray:
    return np.append(np.zeros(1, dtype=np.uint64), keys[:-1])


def count_highest(texts: DataFrame, order: int) -> DataFrame:
    """k1..k<order>, c1..c<order>, n: each gram with its shorter ends and their contexts, counted in each task first."""
    keys = [f"k{m}" for m in range(1, order + 1)] + [f"c{m}" for m in range(1, order + 1)]
    names = ", ".join(f"{k} long" for k in keys) + ", n long"
    schema = arrow_schema(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=1 << 20):
            x, real, _ = _units(b.column("text").to_pylist(), order)
            grams = gram_keys(x, order)
            top, first, n = np.unique(grams[order][real], return_index=True, return_counts=True)
            at = np.flatnonzero(real)[first]
            columns = [grams[m][at] for m in range(1, order + 1)] + [_before(grams[m - 1])[at] for m in range(1, order + 1)]
            yield batch(schema, *(c.astype(np.int64) for c in columns), n)

    counted = texts.select("text").mapInArrow(run, names)
    return counted.groupBy(f"k{order}").agg(F.sum("n").alias("n"), *(F.first(k).alias(k) for k in keys if k != f"k{order}"))


def model(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """key, log (natural): probabilities under gram keys, context shares under inverted keys."""
    level = checkpointed(count_highest(texts, order))
    levels = {order: level}
    for m in range(order - 1, 0, -1):
        rest = [f"k{j}" for j in range(1, m)] + [f"c{j}" for j in range(1, m + 1)]
        level = level.groupBy(f"k{m}").agg(F.count("*").alias("n"), *(F.first(k).alias(k) for k in rest))
        levels[m] = level
    ready: DataFrame | None = None
    out: DataFrame | None = None
    for m in range(1, order + 1):
        level = levels[m]
        n1, n2, n3, n4 = level.agg(*(F.coalesce(F.sum((F.col("n") == c).cast("long")), F.lit(0)) for c in (1, 2, 3, 4))).first()
        y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
        off = [min(max(c - (c + 1) * y * (b / a if a else 0.5), 0.05), c - 0.05) for c, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        less = F.when(F.col("n") == 1, off[0]).when(F.col("n") == 2, off[1]).otherwise(off[2])
        contexts = level.groupBy(f"c{m}").agg(F.sum("n").alias("total"), F.sum(less).alias("spare"))
        own = level.join(contexts, f"c{m}").select(F.col(f"k{m}").alias("key"), F.col(f"c{m}").alias("context"), *([F.col(f"k{m - 1}").alias("shorter")] if m > 1 else []), ((F.col("n") - less) / F.col("total")).alias("own"), (F.col("spare") / F.col("total")).alias("share"))
        if m == 1:
            p = own.withColumn("p", F.col("own") + F.col("share") / ALPHABET)
        else:
            p = own.join(ready.select(F.col("key").alias("shorter"), F.col("p").alias("lower")), "shorter").withColumn("p", F.col("own") + F.col("share") * F.col("lower"))
        ready = checkpointed(p.select("key", "context", "p", "share"))
        both = ready.select("key", F.log("p").alias("log")).union(ready.groupBy(F.bitwise_not("context").alias("key")).agg(F.log(F.first("share")).alias("log")))
        out = both if out is None else out.union(both)
    return out


LAST = -np.log(ALPHABET)


def train(texts: DataFrame, order: int = ORDER) -> tuple[np.ndarray, np.ndarray, float]:
    """The model of a small set of texts as (keys, natural logs, log of the last resort)."""
    got = model(texts, order).toArrow()
    return got.column("key").to_numpy().astype(np.uint64), got.column("log").to_numpy().astype(np.float32), LAST


def log_likelihoods(texts: list[str], known: LookupTable, last: float, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(characters, sum of natural log probabilities) of each text."""
    x, real, sizes = _units(texts, order)
    grams = gram_keys(x, order)
    at = np.flatnonzero(real)
    out, todo = np.zeros(len(at)), np.arange(len(at))
    for m in range(order, 0, -1):
        got = known.get(grams[m][at[todo]]).astype(np.float64)
        hit = ~np.isnan(got)
        out[todo[hit]] += got[hit]
        todo = todo[~hit]
        if not len(todo):
            break
        context = _before(grams[m - 1])[at[todo]] if m > 1 else np.zeros(len(todo), dtype=np.uint64)
        out[todo] += np.nan_to_num(known.get(~context))
    out[todo] += last
    owner = np.repeat(np.arange(len(texts)), sizes)
    return sizes, np.bincount(owner, weights=out, minlength=len(texts))


def _batches_of(packed: list[bytes], most: int = 1 << 18) -> Iterator[tuple[int, int, list[str]]]:
    """Ranges of packed texts of about ``most`` bytes, unpacked."""
    start = size = 0
    for i, p in enumerate(packed):
        size += int.from_bytes(p[:8], "little")
        if size > most or i + 1 == len(packed):
            yield start, i + 1, [unpack(x, ["u1"])[0].tobytes().decode("utf-8", "replace") for x in packed[start : i + 1]]
            start, size = i + 1, 0


def perplexities(docs: DataFrame, known: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, tie (xxhash64 of the text), lang, n_units, nats: one row per row of ``docs``, under the model ``known``."""
    n = shards_of(docs)
    names = "shard int, doc_id long, tie long, lang string, packed binary"
    source = document_text(docs, docs["lang"].cast("string").alias("lang")).withColumn("tie", F.xxhash64("text"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            shard = _home(b.column("doc_id").fill_null(-1).to_numpy(), b.column("tie").to_numpy()) % np.uint64(n)
            yield batch(arrow_schema(names), shard.astype(np.int32), b.column("doc_id"), b.column("tie"), b.column("lang"), [pack(np.frombuffer(t.encode("utf-8", "replace"), np.uint8)) for t in b.column("text").to_pylist()])

    def ask(key: tuple, t: pa.Table) -> pa.Table:
        found: list[np.ndarray] = []
        held = 0
        for _, _, part in _batches_of(t.column("packed").to_pylist()):
            grams = gram_keys(_units(part, order)[0], order)
            found += [np.unique(g) for g in grams[1:]] + [np.unique(~g) for g in grams[:order]]
            if sum(map(len, found)) > 2 * held + (1 << 19):
                found = [np.unique(np.concatenate(found))]
                held = len(found[0])
        keys = np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.uint64)
        del found
        give_back()
        return pa.Table.from_batches([_blocks(mixed(keys), n, [keys, np.full(len(keys), key[0].as_py(), dtype="<i4")])])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column("key").to_numpy().astype(np.uint64)
            yield _blocks(mixed(keys), n, [keys, b.column("log").to_numpy().astype("<f4")])

    def answer(asks: pa.Table, own: pa.Table) -> pa.Table:
        keys, asker = _joined(asks, ["<u8", "<i4"])
        logs = LookupTable(*_joined(own, ["<u8", "<f4"])).get(keys)
        hit = ~np.isnan(logs)
        return pa.Table.from_batches([_blocks(asker[hit].astype(np.uint64), n, [keys[hit], logs[hit].astype("<f4")])])

    out_names = "doc_id long, tie long, lang string, n_units long, nats double"

    def judge(own: pa.Table, answers: pa.Table) -> pa.Table:
        table_ = LookupTable(*_joined(answers, ["<u8", "<f4"]))
        out = []
        for i, j, part in _batches_of(own.column("packed").to_pylist()):
            units, log = log_likelihoods(part, table_, LAST, order)
            rows = own.slice(i, j - i)
            out.append(batch(arrow_schema(out_names), *(rows.column(c).combine_chunks() for c in ("doc_id", "tie", "lang")), units, -log))
        del table_
        give_back()
        return pa.Table.from_batches(out, schema=arrow_schema(out_names))

    texts = source.mapInArrow(send, names)
    asks = texts.groupBy("shard").applyInArrow(ask, _BLOCKS)
    answers = asks.groupBy("shard").cogroup(known.mapInArrow(deal, _BLOCKS).groupBy("shard")).applyInArrow(answer, _BLOCKS)
    return texts.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(judge, out_names)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id, held_out of the rows labelled good and not toxic."""
    good = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].alias("quality"), labels["toxic"].alias("toxic")).where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null")
    return good.select("doc_id").distinct().withColumn("held_out", F.pmod(F.xxhash64(F.col("doc_id"), F.lit(3)), F.lit(FOLDS)) == 0)


def limits(levels: DataFrame) -> DataFrame:
    """lang (null: over all), limit, from held-out rows (lang, level)."""
    both = levels.select(F.lit(None).cast("string").alias("lang"), "level").union(levels.where("lang is not null").select("lang", "level"))
    bins = both.groupBy("lang", F.ceil(F.col("level") / BIN).alias("bin")).agg(F.count("*").alias("n"), F.sum("level").alias("s"), F.sum(F.col("level") * F.col("level")).alias("ss"))
    # at most as many bins a language as there are levels of nats by BIN
    upto = F.sum("n").over(Window.partitionBy("lang").orderBy("bin"))
    total = F.sum("n").over(Window.partitionBy("lang"))
    ranked = bins.withColumn("upto", upto).withColumn("total", total)
    mean = F.sum("s") / F.sum("n")
    spread = F.sqrt(F.greatest(F.sum("ss") / F.sum("n") - mean * mean, F.lit(0.0)))
    made = ranked.groupBy("lang").agg(F.min(F.when(F.col("upto") >= F.col("total") * QUANTILE, F.col("bin"))).alias("bin"), F.first("total").alias("total"), (mean + F.lit(_DEVIATE) * spread).alias("normal"))
    quantile = F.col("bin") * BIN
    return made.select("lang", F.when(F.col("total") * (1 - QUANTILE) < 1, F.greatest(quantile, F.col("normal"))).otherwise(quantile).alias("limit"))


def score(docs: DataFrame, labels: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, tie, lang, n_units (characters), log_perplexity (nats a character), limit and rejected; one row per row of ``docs``."""
    ids = checkpointed(trusted_ids(labels))
    trained = ids.where("not held_out").select("doc_id")
    trained = F.broadcast(trained) if trained.limit(SENT + 1).count() <= SENT else trained
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).where("text is not null").join(trained, "doc_id", "left_semi").select("text")
    rows = checkpointed(perplexities(docs, model(texts, order), order))
    held = rows.join(ids.where("held_out"), "doc_id", "left_semi")
    mean = held.agg(F.sum("nats") / F.sum("n_units")).first()[0]
    if mean is None:
        level = F.when(F.col("n_units") > 0, F.col("nats") / F.col("n_units"))
        return rows.select("doc_id", "tie", "lang", "n_units", level.alias("log_perplexity"), F.lit(None).cast("double").alias("limit"), F.lit(False).alias("rejected"))
    level = (F.col("nats") + F.lit(mean * PRIOR)) / (F.col("n_units") + F.lit(PRIOR))
    found = checkpointed(limits(held.select("lang", level.alias("level"))))
    any_ = found.where("lang is null").first()["limit"]
    judged = rows.join(found.where("lang is not null"), "lang", "left").withColumn("limit", F.coalesce("limit", F.lit(any_)))
    return judged.select("doc_id", "tie", "lang", "n_units", level.alias("log_perplexity"), "limit", (level > F.col("limit")).alias("rejected"))


def keep(docs: DataFrame, labels: DataFrame, order: int = ORDER) -> DataFrame:
    """The rows of ``docs`` that aren't rejected, with all their columns."""
    bad = score(docs, labels, order).where("rejected").select(F.col("doc_id").alias("__d"), F.col("tie").alias("__t")).distinct()
    own = docs["doc_id"].cast("long").eqNullSafe(bad["__d"]) & (F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))) == bad["__t"])
    return docs.join(bad, own, "left_anti")


def op6_kneserney(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return score(docs, table(spark, sf_dir, "labels")).select("doc_id", "lang", "n_units", "log_perplexity", "limit", "rejected")
