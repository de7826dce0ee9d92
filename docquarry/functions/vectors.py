"""Vectors as ARRAY<FLOAT> columns: dot product, norm, encoders and checks."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSION = 1024


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


class _Places(dict):
    """Twice a word's axis, plus one where it counts up; the first 100,000 words are kept."""

    def __init__(self, dimension: int):
        self.dimension = dimension

    def __missing__(self, word: str) -> int:
        h = zlib.crc32(word.encode())
        place = h % self.dimension * 2 + (h >> 31)
        if len(self) < 100_000:
            self[word] = place
        return place


class HashingEncoder:
    """Deterministic stand-in for a neural encoder: signed hashed word counts, of unit length."""

    def __init__(self, dimension: int = DIMENSION):
        self.dimension, self.places = dimension, None

    def __call__(self, texts: list[str]) -> np.ndarray:
        if self.places is None:  # made where it is used
            self.places = _Places(self.dimension)
        out = np.zeros((len(texts), self.dimension), np.float32)
        for row, text in zip(out, texts):
            words = (text or "").lower().split()
            found = np.bincount(np.fromiter(map(self.places.__getitem__, words), np.int64, len(words)), minlength=2 * self.dimension)
            row += found[1::2] - found[::2]
        length = np.linalg.norm(out, axis=1, keepdims=True)
        out[:, 0] += (length == 0)[:, 0]  # an empty text is the first axis
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def encode(df: DataFrame, text: str, encoder: Callable[[list[str]], np.ndarray] | None = None, out: str = "embedding", batch: int = 64) -> DataFrame:
    """Adds ``out``, unit vectors of ``text``; ``encoder`` is built once for each worker and fed batches."""
    made = encoder or HashingEncoder()

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            rows: list[np.ndarray] = []
            for i in range(0, len(texts), batch):
                got = np.asarray(made([t or "" for t in texts.iloc[i : i + batch]]), np.float32)
                rows += list(got / np.maximum(np.linalg.norm(got, axis=1, keepdims=True), 1e-12))
            yield pd.Series(rows, index=texts.index, dtype=object)

    return df.withColumn(out, run(F.col(text)))


def check_embeddings(df: DataFrame, column: str = "embedding", expected: int | None = None, dimension: int | None = None, tolerance: float = 1e-3) -> DataFrame:
    """One row: rows, wrong dimensions, vectors with NaN or infinity, least and greatest norm, norms off one, and ok."""
    c = F.col(column)
    dim = F.lit(dimension) if dimension else F.size(c)
    inf = F.exists(c, lambda x: F.abs(x) == float("inf"))
    nan = F.exists(c, F.isnan)
    length = norm(c)
    sums = df.agg(
        F.count("*").alias("n_rows"), F.count_if(F.coalesce(F.size(c) != dim, F.lit(True))).alias("n_wrong_dimension"), F.count_if(nan).alias("n_nan"), F.count_if(inf).alias("n_inf"),
        F.min(length).alias("min_norm"), F.max(length).alias("max_norm"), F.count_if(F.abs(length - 1) > tolerance + 1e-5).alias("n_norm_off"),
    )
    count_ok = F.lit(True) if expected is None else F.col("n_rows") == expected
    return sums.withColumn("ok", count_ok & (F.col("n_wrong_dimension") + F.col("n_nan") + F.col("n_inf") + F.col("n_norm_off") == 0))
