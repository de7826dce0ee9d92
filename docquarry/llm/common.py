"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions.scan import let, running  # noqa: F401
from docquarry.sources.scratch import bounded, cut, drop_scratch, shared_dir  # noqa: F401
from docquarry.sources.session import ship

#: ASCII white space: space and 0x09 to 0x0D; everything else belongs to a word.
SPACE = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: A-Z only; other letters stay as they are.
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

#: Rows from which a join key is hot, hot keys that may be broadcast, and copies of a key beyond.
HOT, HOT_KEYS, SALTS = 1000, 200_000, 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test-data table; all reads go through Spark's reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 256, size: str = "4m") -> None:
    """Bound what one Arrow batch holds, so very long texts do not pile up in a Python worker."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def text_of(name: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts).cast("int")


def fold_of(doc_id, parts: int) -> int:
    """The same as ``fold`` in Python."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % parts


def rows_of(batches, *names):
    """(batch columns as Python lists) for each Arrow batch."""
    for batch in batches:
        yield [batch.column(n).to_pylist() for n in names]


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def join_back(rows: DataFrame, keys: DataFrame, key: str, most: int = HOT, keys_at_once: int = HOT_KEYS) -> DataFrame:
    """Inner join of rows with the table of keys, one row a key, that counts a key's rows in ``n`` (dropped).

    Keys of more than ``most`` rows are broadcast if they are few; if not, every
    key is copied ``SALTS`` times and rows are dealt by key and salt. Both sides
    should start from files, as they are read twice.
    """
    hot = keys.filter(F.col("n") > most)
    found = hot.limit(keys_at_once + 1).count()
    if found > keys_at_once:
        salted = keys.drop("n").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")).join(salted, [key, "_salt"]).drop("_salt")
    if not found:
        return rows.join(keys.drop("n"), key)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(keys.filter(F.col("n") <= most).drop("n"), key)
    return rows.join(F.broadcast(hot.drop("n")), key).unionByName(cold)


BLOCK = 1 << 16
FAN = 16  # partial sums of a block


def blocks_of(values: np.ndarray):
    """(number, packed) of the blocks of a flat array that are not all zero."""
    flat = values.ravel()
    for i in range(0, len(flat), BLOCK):
        if flat[i : i + BLOCK].any():
            yield i // BLOCK, zlib.compress(flat[i : i + BLOCK].tobytes(), 1)


def add_up(rows: DataFrame, size: int, kind) -> np.ndarray:
    """Sum of the blocks in rows of (block, part, packed), whatever their number, in order of ``part``.

    Each block is added up in ``FAN`` streams, then these; the driver gets one table of ``size`` numbers.
    """
    wide = np.float64 if kind == np.float32 else np.int64
    schema, names = "block int, part long, packed binary", ["block", "part", "packed"]

    def adder(own, fan):
        def add(batches):
            total: dict[tuple[int, int], np.ndarray] = {}
            for batch in batches:
                for i, part, b in zip(*(batch.column(c).to_pylist() for c in range(3))):
                    key = i, part % fan
                    total[key] = total.get(key, 0) + np.frombuffer(zlib.decompress(b), own).astype(wide)
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in total], pa.int32()), pa.array([p for _, p in total], pa.int64()), pa.array([zlib.compress(v.tobytes(), 1) for v in total.values()], pa.binary())], names=names)

        return add

    dealt = rows.select("block", "part", "packed").repartition("block", F.pmod("part", F.lit(FAN))).sortWithinPartitions("block", "part")
    dealt = dealt.mapInArrow(adder(kind, FAN), schema).repartition("block").sortWithinPartitions("block", "part").mapInArrow(adder(wide, 1), schema)
    out = np.zeros(size, wide)
    for r in dealt.toLocalIterator():
        got = np.frombuffer(zlib.decompress(r.packed), wide)
        out[r.block * BLOCK : r.block * BLOCK + len(got)] = got
    return out
