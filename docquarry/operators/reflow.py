"""Page cleaning: wrapped lines are joined again, structure and heading lines stay apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.functions import text as tx
from docquarry.functions.scan import let, running


#: What is kept of the joined line: enough for every pattern and for the length that a heading may have.
HEAD = 200


def reflow(text: Column, composed: bool = False) -> Column:
    """The lines of ``text``, joined with a space where a line goes on.

    A line starts anew if it or the line so far is a structure or heading line,
    or if the line so far ends a sentence or clause. Of the joined line the
    state keeps its head, length and last character, so the fold is linear; as
    an expression it stays in the JVM.
    """
    fresh = lambda x: tx.is_structure_line(x) | tx.is_heading_line(x)
    state = lambda head, size, tail, apart: F.struct(F.substring(head, 1, HEAD).alias("head"), size.alias("size"), tail.alias("tail"), apart.alias("apart"))

    def step(last: Column, line: Column) -> Column:
        heading = (last["size"] <= HEAD) & tx.is_heading_line(last["head"])
        apart = last["head"].isNull() | fresh(line) | tx.is_structure_line(last["head"]) | heading | last["tail"].rlike(r'[.!?:;”"]')
        apart = F.coalesce(apart, F.lit(True))
        tail = F.substring(line, -1, 1)
        started, joined = state(line, F.length(line), tail, F.lit(True)), state(F.concat(last["head"], F.lit(" "), line), last["size"] + 1 + F.length(line), tail, F.lit(False))
        return F.when(apart, started).otherwise(joined)

    def joined(lines: Column) -> Column:
        begin = state(F.lit(None).cast("string"), F.lit(0), F.lit(""), F.lit(True))
        parts = F.zip_with(lines, running(lines, begin, step), lambda line, s: F.concat(F.when(s["apart"], F.lit("\n")).otherwise(F.lit(" ")), line))
        return F.regexp_replace(F.array_join(parts, ""), r"^\n", "")

    return F.coalesce(let(tx.split_lines(text if composed else tx.nfc(text)), joined), F.lit(""))


def clean_pages(pages: DataFrame, composed: bool = False) -> DataFrame:
    """PAGES_CLEAN from PAGES_RAW."""
    clean = pages.select("document_id", "page", reflow(F.col("text"), composed).alias("text"), F.length("text").alias("raw_char_count"))
    return clean.withColumn("clean_char_count", F.length("text"))


def clean_totals(cleaned: DataFrame) -> DataFrame:
    return cleaned.agg(F.count("*").alias("n_pages"), F.sum("raw_char_count").alias("raw_chars"), F.sum("clean_char_count").alias("clean_chars"), F.sum(F.col("raw_char_count") - F.col("clean_char_count")).alias("removed_chars"))
