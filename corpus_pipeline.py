"""The corpus pipeline: quality filter, line dedup, near-duplicate removal, mixing, tokenising.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one
before kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coordshift.llm import bpe, kneserney, lines, mixing, nearcopies
from coordshift.llm.common import table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: SQL can't express the stages (trained models, hashed fingerprints, merges); they are tested against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the n-gram model doesn't reject."""
    return kneserney.keep(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the later copies of repeated runs of lines; n_chars follows the text."""
    left = lines.remove_repeats(docs.select(*COLUMNS))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest doc_id of each near-duplicate group (five-word shingles, similarity 0.8).

    Of several rows with that doc_id in a group, the one with the least hash of
    its text stays. Rows with one doc_id and texts that are no near duplicates
    are in different groups and all stay, as do all rows without a doc_id.
    """
    docs = docs.select(*COLUMNS).withColumn("tie", F.xxhash64(F.coalesce("text", F.lit(""))))
    groups = nearcopies.near_duplicates(docs, shingle=5, similarity=0.8)
    keep = groups.where("doc_id = component_id and tie = first_tie").select("doc_id", "tie").distinct()
    kept = docs.join(keep, ["doc_id", "tie"], "left_semi").dropDuplicates(["doc_id", "tie"])
    return kept.select(*COLUMNS).union(docs.where("doc_id is null").select(*COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample by calibrated probabilities towards the target weights."""
    return mixing.sample(docs.select(*COLUMNS)).select(*COLUMNS)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of tokens, token ids and the decoded text's digest."""
    return bpe.encode(docs, bpe.vocabulary_file(), decoded=False)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix", mix), ("tokenise", tokenise)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written to the shared folder, so none is computed twice."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
