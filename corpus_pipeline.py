"""Corpus preparation as a chain of stages over the table of documents.

Quality rules drop documents, line dedup deletes later repeats of passages (and
documents of which nothing is left), the n-gram Jaccard join keeps the smallest
id of each near-duplicate component, decontamination drops documents that
overlap with the benchmark, and packing lays out what is left. ``check`` and
``run`` write each stage as Parquet and read it again for the next.

Cases, for every stage: an empty table gives no rows; all but the last keep the
columns as they are, extra ones and clashing names included. A null text counts
as empty: quality rules drop it, the stages after them would keep it as it is.
A row without id is judged by its text alone: its repeated lines go (such rows
come last in the order), it is no near duplicate of another and no overlap is
reported for it, so it stays; its pieces have a null id. Rows that repeat id and
text are treated alike and stay as often as they occur. Texts of any length are
read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm import common, decontamination, line_dedup, ngram_join, packing, quality_rules


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the compression bands."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later repeated runs of lines; a text with no word left goes."""
    after = line_dedup.dedup_lines(docs)
    touched = F.size(line_dedup.removed_column(docs)) > 0
    after = after.filter(~touched | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return after.withColumn("n_chars", F.when(touched, F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts alike in 0.8 of their five-word shingles."""
    return ngram_join.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an overlap with the benchmark."""
    return decontamination.drop_contaminated(docs, common.table(spark, sf_dir, "benchmark"), shortest=1)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, with their sequences."""
    return packing.pack(common.cut(packing.cut_into_pieces(docs), "pieces"))


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("packing", pack),
]

#: Compression ratios, winnowing and subword ids are beyond SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.cut(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
