"""Exact dense search: a stated set of query vectors against all rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.functions import best
from docquarry.functions import vectors as vx
from docquarry.operators.bm25 import top
from docquarry.sources import scratch

TOP_K = 20
DIGITS = 6
#: Numbers of the vectors of a block.
BLOCK_NUMBERS = 4_000_000


def scores(index: DataFrame, queries: DataFrame, embedding: str = "embedding", vector: str = "query_vector") -> DataFrame:
    """(qid, chunk_id, score) of all pairs; queries are (qid, vector), a stated set.

    The vectors ride in one array column that each index row is scored against,
    so the index is read in place and never shuffled; vectors of more than
    ``scratch.BROADCAST_BYTES`` together go in parts, one scan each.
    """
    found = None
    for part in scratch.in_parts(queries.select("qid", F.col(vector).alias("v")), "qid", F.size("v") * 8 + 16):
        block = part.agg(F.collect_list(F.struct("qid", F.col("v").cast("array<double>").alias("v"))).alias("_q"))
        met = index.select("chunk_id", F.col(embedding).alias("_e")).join(F.broadcast(block)).select("chunk_id", "_e", F.explode("_q").alias("q"))
        met = met.select(F.col("q.qid").alias("qid"), "chunk_id", F.round(vx.dot(F.col("_e"), F.col("q.v")), DIGITS).alias("score"))
        found = met if found is None else found.unionByName(met)
    return found


def search(index: DataFrame, queries: DataFrame, k: int = TOP_K, embedding: str = "embedding", vector: str = "query_vector", rows: int | None = None) -> DataFrame:
    """The k best chunks of each query with rank; k above the index's size gives all. Null vectors match nothing.

    ``rows``, the index's size where it is known, lets tasks take whole blocks.
    A task multiplies its vectors with all queries in single precision, in
    blocks; pairs that, by the bound of its error, may be among the k best are
    multiplied again in double precision, and only the k best of each query
    are handed on. Queries of more than ``best.ASKED_BYTES`` together go in
    parts, one scan each.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    spark, found = index.sparkSession, None
    kinds = index.schema["chunk_id"].dataType.simpleString(), queries.schema["qid"].dataType.simpleString()
    schema = "qid {1}, chunk_id {0}, score double".format(*kinds)
    numbers = F.col(embedding) if index.schema[embedding].dataType.simpleString() == "array<float>" else F.col(embedding).cast("array<double>")
    own = index.select("chunk_id", numbers.alias("v")).filter("v is not null")
    if rows is not None:
        own = own.coalesce(best.tasks(spark, rows))
    for part in scratch.in_parts(queries.select("qid", F.col(vector).cast("array<double>").alias("v")), "qid", F.size("v") * 8 + 16, min(best.ASKED_BYTES, scratch.BROADCAST_BYTES)):
        asked = part.filter("v is not null").toArrow()
        met = spark.createDataFrame([], schema)
        if asked.num_rows:
            met = own.mapInArrow(_best_rows(spark.sparkContext.broadcast(_by_size(asked["qid"].combine_chunks(), asked["v"].combine_chunks())), k), schema)
        found = met if found is None else found.unionByName(met)
    return top(found, k)


def _by_size(ids: pa.Array, vectors: pa.Array) -> dict[int, tuple[pa.Array, np.ndarray]]:
    """Vectors of one size as a matrix, with their ids; vectors of another size have no product."""
    sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    out = {}
    for size in np.unique(sizes).tolist():
        at = pa.array(np.flatnonzero(sizes == size))
        flat = vectors.take(at).flatten().to_numpy(zero_copy_only=False)
        out[size] = ids.take(at), flat.reshape(len(at), size)
    return out


def _best_rows(sent, k: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = sent.value
        kept = {size: best.Best(len(ids), k, DIGITS) for size, (ids, _) in asked.items()}
        for rows in best.blocks(parts):
            for size, (ids, matrix) in _by_size(rows["chunk_id"].combine_chunks(), rows["v"].combine_chunks()).items():
                if size in asked:
                    step = max(1, BLOCK_NUMBERS // max(1, size))
                    for at in range(0, len(ids), step):
                        _add_block(kept[size], asked[size][1], ids.slice(at, step), matrix[at : at + step])
        for size, found in kept.items():
            if (got := found.sort()) is not None:
                yield from pa.table({"qid": asked[size][0].take(got["q"]), "chunk_id": got["id"], "score": got["s"]}).to_batches(max_chunksize=50_000)

    return run


def _add_block(kept: best.Best, asked: np.ndarray, ids: pa.Array, matrix: np.ndarray) -> None:
    longest = np.sqrt(np.square(asked, dtype=np.float64).sum(axis=1))
    reach = longest * np.sqrt(np.square(matrix, dtype=np.float64).sum(axis=1).max(initial=0.0))
    single = bool((reach < 1e30).all())  # false for what is not finite, too
    kind = np.float32 if single else np.float64
    # each number and each product rounds once, and each of the sums
    error = reach * ((matrix.shape[1] + 8) * best.UNIT) + 1e-30 if single else np.zeros(len(asked))
    held = np.ascontiguousarray(matrix.T.astype(kind, copy=False))
    kept.begin(ids)
    step = max(1, best.CELLS // len(ids))
    for at in range(0, len(asked), step):
        own = slice(at, at + step)
        block = asked[own].astype(kind) @ held
        if not single:
            block[np.isnan(block)] = -np.inf
        floor = np.maximum(kept.low[own], best.kth(block, kept.k) - error[own]) - kept.near - error[own]
        # below it in single precision, too
        floor = np.nextafter(floor.astype(kind), kind(-np.inf))
        q, r = np.divmod(np.flatnonzero(block >= floor[:, None]), len(ids))
        if len(q):
            s = np.empty(len(q))
            for i in range(0, len(q), 65_536):
                j = slice(i, i + 65_536)
                s[j] = np.einsum("ij,ij->i", asked[own][q[j]].astype(np.float64), matrix[r[j]].astype(np.float64))
            kept.add(q + at, r, s)
    kept.end()


def scores_of(index: DataFrame, queries: DataFrame, allowed: DataFrame, embedding: str = "embedding", vector: str = "query_vector") -> DataFrame:
    """(qid, chunk_id, score) of the allowed (qid, chunk_id) only."""
    # the pairs with the queries' vectors first, so each index row meets its own pairs only
    asked = allowed.select("qid", "chunk_id").join(scratch.bounded(queries.select("qid", vector), scratch.BROADCAST_BYTES // (8 * vx.DIMENSION)), "qid")
    return index.join(asked, "chunk_id").select("qid", "chunk_id", F.round(vx.dot(F.col(embedding), F.col(vector)), DIGITS).alias("score"))


def search_filtered(index: DataFrame, queries: DataFrame, allowed: DataFrame, k: int = TOP_K, embedding: str = "embedding", vector: str = "query_vector") -> DataFrame:
    """Search among the allowed (qid, chunk_id) only; a query without any gets no row."""
    return top(scores_of(index, queries, allowed, embedding, vector), k)


def encode_questions(questions: DataFrame, encoder: Callable[[list[str]], np.ndarray] | None = None, text: str = "question", dimension: int | None = None) -> DataFrame:
    """Adds query_vector; a blank question, or a vector of another dimension than the index has, is an error when the plan runs."""
    checked = questions.withColumn(text, F.when(F.trim(F.coalesce(text, F.lit(""))) == "", F.raise_error(F.lit("blank question"))).otherwise(F.col(text)))
    out = vx.encode(checked, text, encoder, "query_vector")
    if dimension is None:
        return out
    wrong = F.raise_error(F.concat(F.lit(f"query vector has not {dimension} numbers but "), F.size("query_vector").cast("string")))
    return out.withColumn("query_vector", F.when(F.size("query_vector") == dimension, F.col("query_vector")).otherwise(wrong))


def check_index(index: DataFrame, tolerance: float = 1e-4, dimension: int | None = None, strict: bool = False) -> DataFrame:
    """check_embeddings plus unique chunk ids and vector_index 0 .. N-1 without gaps, where that column exists; ``strict`` makes a failed check an error."""
    checked = vx.check_embeddings(index, tolerance=tolerance, dimension=dimension)
    ids = [F.count_distinct("chunk_id").alias("n_ids"), F.count("*").alias("n")]
    gapless = F.lit(True)
    if "vector_index" in index.columns:
        ids += [F.min("vector_index").alias("low"), F.max("vector_index").alias("high"), F.count_distinct("vector_index").alias("n_index")]
        gapless = (F.col("low") == 0) & (F.col("high") == F.col("n") - 1) & (F.col("n_index") == F.col("n"))
    found = index.agg(*ids)
    out = checked.join(F.broadcast(found.select(F.col("n_ids") == F.col("n"), gapless).toDF("unique_ids", "index_gapless"))).withColumn("ok", F.col("ok") & F.col("unique_ids") & F.col("index_gapless"))
    return out.withColumn("ok", F.when(F.col("ok"), True).otherwise(F.raise_error(F.concat(F.lit("index check failed: "), F.to_json(F.struct(*out.columns)))))) if strict else out
