"""Packing into fixed-length sequences: shortest pack first, over the histogram of lengths.

Documents become subword ids with a closing id 0 and are cut into pieces of at
most ``length`` ids. Lengths are placed longest first: each goes to the
shortest pack that has room, a pack of its own if none has. As only the
histogram matters, equal packs are one pattern with a count. A length closes
with at most one pattern more than it found, so there are at most 2 * length
patterns, and a pattern holds fewer than sqrt(2 * length) different lengths:
the driver's work and the table of slots are bounded by ``length`` alone,
whatever the number of documents.

Pieces of a length get ranks 0, 1, ... by counting in hashed buckets first
(each (bucket, length) a small group, so a length that a third of the pieces
share is no hot group); a slot of a pattern owns a range of ranks, which gives
each piece its sequence and offset.

Cases: a null text counts as empty, and an empty text is the single id 0;
repeated rows are packed as often as they occur; null ids stay null; extra
columns of the input are ignored; an empty table gives no rows; equal pieces of
equal documents may swap ranks, which changes no row.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docquarry.llm import common, subwords

LENGTH = 1024
END = 0
PAD = 0
BUCKETS = 1024

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut_into_pieces(documents: DataFrame, length: int = LENGTH, ids: bool = False, paths=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``PIECES`` for each piece, with the ids themselves as ``ids array<int>`` if asked for."""
    common.small_batches(documents.sparkSession)
    paths = paths or subwords.vocabulary_paths()
    names = [c.split()[0] for c in PIECES.split(", ")] + ["ids"] * ids

    def pieces(batches):
        encode = subwords.shared(paths).encode
        for batch in batches:
            out = [[] for _ in names]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = encode(text)
                got.append(END)
                all_ids = np.array(got, "<u4")
                for start in range(0, len(all_ids), length):
                    own = all_ids[start : start + length]
                    for column, value in zip(out, (doc_id, start, len(own), zlib.crc32(own.tobytes()), len(all_ids))):
                        column.append(value)
                    if ids:
                        out[-1].append(own.astype("i4"))
            arrays = [pa.array(c, pa.int64()) for c in out[:5]] + ([pa.array(out[5], pa.list_(pa.int32()))] if ids else [])
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = PIECES + ", ids array<int>" * ids
    return documents.select(F.col(id_col).cast("long").alias("doc_id"), common.text_of(text_col).alias("text")).mapInArrow(pieces, schema)


def pack_histogram(counts: Mapping[int, int], length: int = LENGTH) -> list[tuple[int, list[tuple[int, int]]]]:
    """[(packs, [(piece length, pieces of it in a pack), ...])] for {piece length: pieces}.

    Longest lengths first, each into the pattern with the most room left.
    """
    room: list[int] = []  # of the open patterns, ascending
    open_: list[tuple[int, list]] = []
    done: list[tuple[int, list]] = []

    def put(n: int, parts: list, left: int) -> None:
        if not left:
            done.append((n, parts))
            return
        at = bisect.bisect_left(room, left)
        room.insert(at, left)
        open_.insert(at, (n, parts))

    for size in sorted((k for k, n in counts.items() if n), reverse=True):
        todo = counts[size]
        while todo:
            if not room or room[-1] < size:  # packs of its own, each filled before the next is opened
                whole, rest = divmod(todo, length // size)
                for n, times in ((whole, length // size), (min(rest, 1), rest)):
                    if n:
                        put(n, [(size, times)], length - times * size)
                break
            left, (n, parts) = room.pop(), open_.pop()
            took = min(n, todo)
            if n > took:
                put(n - took, parts, left)
            same = parts[-1][0] == size
            put(took, [*parts[: len(parts) - same], (size, 1 + same * parts[-1][1])], left - size)
            todo -= took
    return done + open_


def slots(patterns: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Rows of (length, first rank, end rank, pieces in a pack, first sequence, offset), ascending."""
    taken: dict[int, int] = {}
    rows, first = [], 0
    for n, parts in patterns:
        offset = 0
        for size, times in parts:
            rank = taken.get(size, 0)
            taken[size] = rank + n * times
            rows.append((size, rank, rank + n * times, times, first, offset))
            offset += size * times
        first += n
    return np.array(sorted(rows), "i8").reshape(-1, 6)


def pack(pieces: DataFrame, length: int = LENGTH, buckets: int = BUCKETS) -> DataFrame:
    """The pieces, all columns, with sequence_id and offset.

    ``pieces`` needs doc_id, start and length and should start from files
    (``common.cut``), as it is read twice.
    """
    spark = pieces.sparkSession
    ties = [c for c in ("ids_crc32",) if c in pieces.columns]  # parts the pieces of rows without id
    bucketed = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "start", *ties), F.lit(buckets)).cast("int"))
    sizes = bucketed.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    sizes = common.cut(sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("_n")), "sizes")
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    table = spark.sparkContext.broadcast(slots(pack_histogram(counts, length)))

    local = F.row_number().over(Window.partitionBy("_bucket", "length").orderBy("doc_id", "start", *ties)) - 1
    ranked = bucketed.withColumn("_local", local).join(sizes.drop("_n"), ["length", "_bucket"]).withColumn("_rank", F.col("_local") + F.col("_before"))
    names = pieces.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"

    def place(batches):
        t = table.value
        key = t[:, 0] * (1 << 44) + t[:, 1]
        for batch in batches:
            size = batch.column(batch.schema.get_field_index("length")).to_numpy()
            rank = batch.column(batch.schema.get_field_index("_rank")).to_numpy()
            s = t[np.searchsorted(key, size * (1 << 44) + rank, side="right") - 1]
            pack_no, nth = np.divmod(rank - s[:, 1], s[:, 3])
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(s[:, 4] + pack_no), pa.array(s[:, 5] + nth * size)], names=[*names, "sequence_id", "offset"])

    return ranked.select(*names, "_rank").mapInArrow(place, schema)


def sequences(packed: DataFrame, length: int = LENGTH, pad: int = PAD) -> DataFrame:
    """(sequence_id, ids, lengths): the padded training sequences of pieces packed with their ids.

    A sequence whose ids already fill a power of two stays unpadded.
    """
    own = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    joined = packed.groupBy("sequence_id").agg(own.alias("own")).select("sequence_id", F.flatten("own.ids").alias("ids"), F.col("own.length").alias("lengths"))
    used = F.size("ids")
    full = F.bit_count(used) == 1
    padded = F.when(full, F.col("ids")).otherwise(F.concat("ids", F.array_repeat(F.lit(pad), F.greatest(F.lit(length) - used, F.lit(0)))))
    return joined.select("sequence_id", padded.alias("ids"), "lengths")


def query(spark, sf_dir) -> DataFrame:
    return pack(common.cut(cut_into_pieces(common.table(spark, sf_dir, "documents")), "pieces"))
