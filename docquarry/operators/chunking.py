"""Fixed windows over pages, and the document that pages make together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docquarry.functions import text as tx
from docquarry.functions.scan import let

SIZE, OVERLAP = 512, 50


def check_window(size: int, overlap: int) -> None:
    if size <= 0:
        raise ValueError("size must be positive")
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below size")


def window_starts(length: Column, size: Column | int, overlap: Column | int) -> Column:
    """Start offsets of the windows over ``length`` characters; the last one reaches the end."""
    size, overlap = (x if isinstance(x, Column) else F.lit(x) for x in (size, overlap))
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((length - size) / step).cast("int")) * step
    return F.when(length > 0, F.sequence(F.lit(0), last.cast("int"), step.cast("int"))).otherwise(F.array().cast("array<int>"))


def fixed_chunks(pages: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """CHUNKS_FIXED: windows of ``size`` that overlap by ``overlap``; blank ones are dropped before numbering.

    Numbering stays inside the page's own row, so nothing is shuffled.
    """
    check_window(size, overlap)
    # the text is worked out once, not for each window, where it is an expression itself
    piece = lambda t: lambda s: F.struct(s.alias("start"), F.substring(t, s + 1, F.lit(size)).alias("text"))
    pieces = let(F.col("text"), lambda t: F.filter(F.transform(window_starts(F.length(t), size, overlap), piece(t)), lambda c: tx.strip(c["text"]) != ""))
    # an outer explode, as Spark puts a filter with all of these expressions before a plain one
    flat = pages.select("document_id", "page", F.posexplode_outer(pieces).alias("_i", "c")).filter("_i is not null").withColumn("chunk_index", F.col("_i") + 1)
    n = F.length("c.text")
    return flat.select(
        tx.page_chunk_id(F.col("document_id"), F.col("page"), F.col("chunk_index")).alias("chunk_id"), "document_id", "page", "chunk_index",
        F.col("c.start").alias("start_char"), (F.col("c.start") + n).alias("end_char"), n.alias("char_count"), F.col("c.text").alias("text"),
    )


def page_ranges(pages: DataFrame) -> DataFrame:
    """(document_id, page, start, end) in the global document, where one newline follows each page."""
    before = Window.partitionBy("document_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("_n") + 1).over(before), F.lit(0)).cast("long")
    # lengths only: texts would be shuffled and sorted along with their pages
    sizes = pages.select("document_id", "page", F.length("text").alias("_n"))
    return sizes.select("document_id", "page", start.alias("start"), (start + F.col("_n")).alias("end"))


def global_documents(pages: DataFrame) -> DataFrame:
    """(document_id, full_text): pages in order, a newline after each."""
    own = F.array_sort(F.collect_list(F.struct("page", "text")))
    return pages.groupBy("document_id").agg(own.alias("_p")).select("document_id", F.concat(F.array_join("_p.text", "\n"), F.lit("\n")).alias("full_text"))


def position_to_page(positions: DataFrame, ranges: DataFrame, position: str = "position", out: str = "page") -> DataFrame:
    """Adds the page of each (document_id, position): the last one that starts at or before it, else null.

    An as-of join inside each document: positions and page starts are merged in
    one sort, and the last start seen is carried on, so no pairs arise.
    """
    marks = ranges.select("document_id", F.col("start").alias("_at"), F.lit(0).alias("_kind"), F.struct(F.col("start").alias("_s"), F.col("page").alias("_p")).alias("_mark"), F.lit(None).cast(positions.select(F.struct(*positions.columns).alias("r")).schema["r"].dataType).alias("_row"))
    asks = positions.select("document_id", F.col(position).cast("long").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("struct<_s:long,_p:int>").alias("_mark"), F.struct(*positions.columns).alias("_row"))
    order = Window.partitionBy("document_id").orderBy("_at", "_kind", F.col("_mark._p"))
    found = marks.select("document_id", "_at", "_kind", F.col("_mark").cast("struct<_s:long,_p:int>").alias("_mark"), "_row").unionByName(asks)
    found = found.withColumn("_last", F.last("_mark", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return found.filter("_kind = 1").select("_row.*", F.col("_last._p").alias(out))
