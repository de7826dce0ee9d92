"""Schemas, readers, writers, hashes and manifests."""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from docquarry.sources import scratch

PAGES_RAW = "document_id string, page int, text string, char_count int"
PAGES_CLEAN = "document_id string, page int, text string, raw_char_count int, clean_char_count int"
CHUNKS_FIXED = "chunk_id string, document_id string, page int, chunk_index int, start_char int, end_char int, char_count int, text string"
CHUNKS_STRUCTURED = (
    "chunk_id string, document_id string, chapter string, article_number string, article_title string, clause string,"
    " piece_index int, page_start int, page_end int, source_start long, source_end long, char_count int, text string"
)
GOLD_ARTICLES = "question_id string, question string, gold_articles array<int>, difficulty string, language string"
GOLD_SPANS = "question_id string, question string, evidence_anchors array<string>, difficulty string, language string"
DEMO_CASES = "id string, question string, expected_status string, expected_article string, purpose string"


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON lines with a fixed schema; blank lines are skipped, a malformed one fails the read and names its file."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_metadata(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Chunk metadata with its vector_index."""
    return read_jsonl(spark, path, f"vector_index long, {schema}")


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """(vector_index, embedding) from .npy matrices, whole files a task; rows count from 0 in each file."""
    import io as bytes_io

    import numpy as np

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for content in pdf["content"]:
                matrix = np.load(bytes_io.BytesIO(bytes(content)), allow_pickle=False).astype(np.float32)
                for i in range(0, len(matrix), 1024):
                    block = matrix[i : i + 1024]
                    yield pd.DataFrame({"vector_index": np.arange(i, i + len(block)), "embedding": list(block)})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "vector_index long, embedding array<float>")


def pdf_texts(content: bytes) -> list[str]:
    """Page texts of a PDF, by whichever of pymupdf and pypdf is installed; an extractor for ``binary_pages``."""
    import io as bytes_io

    try:
        import pymupdf
    except ImportError:
        from pypdf import PdfReader

        return [page.extract_text() or "" for page in PdfReader(bytes_io.BytesIO(content)).pages]
    with pymupdf.open(stream=content, filetype="pdf") as document:
        return [page.get_text("text") for page in document]


def malformed_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(path, line, record): lines of JSON files that are not blank and do not parse, with their number; whole files a task."""
    import json

    names = [f.name for f in T.StructType.fromDDL(schema)]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            bad = []
            for file, content in zip(pdf["path"], pdf["content"]):
                for number, line in enumerate(bytes(content).decode("utf-8", "replace").split("\n"), 1):
                    if line.strip():
                        try:
                            ok = set(names) <= set(json.loads(line))
                        except (ValueError, TypeError):
                            ok = False
                        if not ok:
                            bad.append((file, number, line))
            yield pd.DataFrame(bad, columns=["path", "line", "record"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, line int, record string")


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def require_fields(df: DataFrame, fields: str | T.StructType) -> DataFrame:
    """``df``, or an error that lists the absent columns."""
    schema = T.StructType.fromDDL(fields) if isinstance(fields, str) else fields
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing fields: {', '.join(missing)}")
    return df


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_text(df: DataFrame, column: str, path: str) -> None:
    df.select(column).write.mode("overwrite").text(path)


def with_vector_index(chunks: DataFrame, *order: str) -> DataFrame:
    """Adds vector_index, 0, 1, ... by ``order`` (default: chunk_id).

    Numbers come from range-partitioned counts, not from one global window:
    each partition counts its rows, and starts where those before it end.
    """
    keys = order or ("chunk_id",)
    parts = chunks.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id())
    parts = scratch.cut(parts, "ranges")  # both uses below must see the same ranges
    local = parts.withColumn("_local", F.row_number().over(Window.partitionBy("_part").orderBy(*keys)) - 1)
    counts = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).select("_part", "_before")  # one row a partition
    return local.join(F.broadcast(before), "_part").withColumn("vector_index", (F.col("_before") + F.col("_local")).cast("long")).drop("_part", "_local", "_before")


def extract_html(text: str) -> str:
    """Visible text of a page: scripts, styles and tags gone, entities resolved."""
    text = re.sub(r"(?is)<(script|style|head)\b.*?</\1\s*>", " ", text or "")
    text = re.sub(r"(?i)<(?:br|/p|/div|/li|/h[1-6]|/tr)\b[^>]*>", "\n", text)
    text = html.unescape(re.sub(r"<[^>]*>", " ", text))
    return "\n".join(line for line in (re.sub(r"[^\S\n]+", " ", x).strip() for x in text.split("\n")) if line)


def html_pages(pages: DataFrame) -> DataFrame:
    """PAGES_RAW from (page_id, url, html): one page a document."""

    @F.pandas_udf("string")
    def text_of(parts: pd.Series) -> pd.Series:
        return parts.map(extract_html)

    found = pages.select(F.col("page_id").cast("string").alias("document_id"), F.lit(1).alias("page"), text_of(F.coalesce("html", F.lit(""))).alias("text"))
    return found.withColumn("char_count", F.length("text"))


def binary_pages(spark: SparkSession, path: str, extract: Callable[[bytes], list[str]]) -> DataFrame:
    """PAGES_RAW from files: ``extract`` gives the page texts of one file's bytes; no file is an error."""
    files = spark.read.format("binaryFile").load(path)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [(re.sub(r"\.[^.]*$", "", p.rsplit("/", 1)[-1]), i, t, len(t)) for p, c in zip(pdf["path"], pdf["content"]) for i, t in enumerate(extract(bytes(c)), 1)]
            yield pd.DataFrame(rows, columns=["document_id", "page", "text", "char_count"])

    return files.select("path", "content").mapInPandas(run, PAGES_RAW)


def sha256_of_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of each file."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def manifest(chunks: DataFrame, embeddings: DataFrame, config: dict, source_sha256: str | None = None, seconds: float | None = None) -> DataFrame:
    """One nested row: configuration, counts, dimension, norms and the source's hash."""
    from docquarry.functions.vectors import check_embeddings

    checked = check_embeddings(embeddings)
    first = embeddings.agg(F.max(F.size("embedding")).alias("dimension"))
    counted = chunks.agg(F.count("*").alias("n_chunks"))
    named = F.struct(*(F.lit(v).alias(k) for k, v in sorted(config.items()))) if config else F.lit(None).cast("string")
    return counted.join(F.broadcast(first)).join(F.broadcast(checked)).select(
        named.alias("config"), "n_chunks", "dimension", F.struct("min_norm", "max_norm").alias("norms"), F.when(F.col("ok"), "PASS").otherwise("FAIL").alias("status"),
        F.lit(source_sha256).alias("source_sha256"), F.lit(seconds).cast("double").alias("seconds"),
    )
