"""Line deduplication by winnowing over line hashes.

A text is a sequence of lines, lines with several sentences being cut after
sentence ends (``.``, ``!`` or ``?`` and a space), so a passage inside a longer
line counts too. Pieces without a word only separate, and go with the one before them.

A gram is the shortest run of pieces from a given one on that holds at least
``GRAM_WORDS`` words. In each window, the shortest run of pieces that holds
``RUN_WORDS`` words, the gram with the least hash among those that lie whole
inside it becomes a fingerprint. Windows hang on their pieces alone, so two
documents that share a run of ``RUN_WORDS`` words select the same fingerprint
in it. Fingerprints that occur once are dropped.

A match is extended both ways around a repeated fingerprint: every shortest run
of ``RUN_WORDS`` words that holds it, to the left and to the right, is looked up
by its digest, and is a repeat if it has an earlier occurrence anywhere, in
order of document and piece. Each longer repeat is the union of such runs, so a
run is held against all its earlier holders without a pair among the copies: a
key is counted and its first position joined back. The later runs are deleted.
What is deleted has an equal earlier copy, so of each piece one copy stays.

Pieces are compared without leading and trailing ASCII white space. A repeat
inside a document counts when it starts after the first one's end; of a
periodic run the first ``RUN_WORDS`` words stay.

Cases: null texts count as empty; texts without a repeat and runs below the
limit stay as they are; a line of which a sentence goes
keeps its end; rows without id come last in the order; rows equal in id and
text are one document and are treated alike; extra columns pass through, and
the added column gets underscores before its name until no other has it; an
empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.llm import common

GRAM_WORDS = 20
RUN_WORDS = 50
BROADCAST_RANGES = 1_000_000
LAST = (1 << 63) - 1
_CUT = re.compile(rb"(?<=\n)|(?<=[.!?] )")
HASH = 16
PLACE = "decimal(38,0)"


def pieces_of(text: str) -> list[bytes]:
    """Lines and sentences of lines, with what separates them at their end."""
    return _CUT.split(text.encode("utf-8", "surrogatepass"))


def worded(text: str) -> tuple[list[int], list[int], list[bytes]]:
    """(number among all pieces, words, digest) of each piece with a word; the count of pieces stands after the numbers."""
    import xxhash

    digest, pieces = xxhash.xxh3_128_digest, pieces_of(text)
    counts = [len(x.split()) for x in pieces]
    at = [i for i, n in enumerate(counts) if n]
    return [*at, len(pieces)], [counts[i] for i in at], [digest(pieces[i].strip()) for i in at]


def ends_of(words: list[int], least: int) -> list[int]:
    """The end of the shortest run from each piece on that holds ``least`` words; only for pieces that have one."""
    out, end, held = [], 0, 0
    for w in words:
        while end < len(words) and held < least:
            held += words[end]
            end += 1
        if held < least:
            break
        out.append(end)
        held -= w
    return out


def fingerprints(words: list[int], hashes: list[bytes], gram_words: int = GRAM_WORDS, run_words: int = RUN_WORDS) -> list[tuple[int, int, int]]:
    """Selected (gram hash, first piece, end) among the pieces with words, by first piece."""
    import xxhash

    windows = ends_of(words, run_words)
    if not windows:
        return []
    joined, ends, hash_of = b"".join(hashes), ends_of(words, gram_words), xxhash.xxh3_64_intdigest
    grams = [hash_of(joined[HASH * i : HASH * end]) for i, end in enumerate(ends)]
    chosen, upto, best, n = [], 0, -1, len(ends)
    for i, end in enumerate(windows):
        if best < i:
            best, upto = i, i + 1
        least = grams[best]
        while upto < n and ends[upto] <= end:
            if grams[upto] < least:
                best, least = upto, grams[upto]
            upto += 1
        if not chosen or chosen[-1] != best:
            chosen.append(best)
    return [(grams[s] - (1 << 63), s, ends[s]) for s in chosen]


def runs_around(words: list[int], spots: list[int], gram_words: int = GRAM_WORDS, run_words: int = RUN_WORDS) -> list[tuple[int, int]]:
    """The runs [first, end) that hold ``run_words`` words, but none without their first or last piece, and hold a gram that starts at one of the ascending ``spots``."""
    ends, n = ends_of(words, gram_words), len(words)
    runs = set(enumerate(ends_of(words, run_words)))
    runs |= {(n - end, n - i) for i, end in enumerate(ends_of(words[::-1], run_words))}
    out = []
    for first, end in sorted(runs):
        at = bisect_left(spots, first)
        if at < len(spots) and ends[spots[at]] <= end:
            out.append((first, end))
    return out


def place_of(doc_id: Column, text: Column) -> Column:
    """A document's place in the order of ids, texts of one id in the order of their hash; rows without id come last."""
    ord_, low = F.coalesce(doc_id.cast("long"), F.lit(LAST)), F.shiftrightunsigned(F.xxhash64(text), 4)
    return (ord_.cast("decimal(19,0)") * F.lit(1 << 60).cast("decimal(19,0)") + low.cast("decimal(19,0)")).cast(PLACE)


def _scan(gram_words: int, run_words: int):
    """Rows of (place, at, words, hashes, prints) for each text long enough."""
    names = ["place", "at", "words", "hashes", "prints"]
    a_print = pa.struct([("gram", pa.int64()), ("first", pa.int32())])

    def scan(batches):
        for batch in batches:
            out, rows = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                at, words, hashes = worded(text)
                got = fingerprints(words, hashes, gram_words, run_words)
                if got:
                    rows.append(i)
                    out.append((at, words, b"".join(hashes), [g for g, _, _ in got], [a for _, a, _ in got]))
            if out:
                at, words, hashes, grams, firsts = zip(*out)
                own = pa.array(np.cumsum([0, *map(len, grams)]), pa.int32())
                flat = pa.StructArray.from_arrays([pa.array(chain.from_iterable(grams), pa.int64()), pa.array(chain.from_iterable(firsts), pa.int32())], fields=list(a_print))
                lists = [pa.array(at, pa.list_(pa.int32())), pa.array(words, pa.list_(pa.int32())), pa.array(hashes, pa.binary()), pa.ListArray.from_arrays(own, flat)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), *lists], names=names)

    return scan


def _extend(gram_words: int, run_words: int):
    """(key, place, range) of each run around a repeated fingerprint; a run that an earlier one of its own text equals has no key.

    A range is the first piece times 2^32 plus the end, counting all pieces.
    """

    def extend(batches):
        import xxhash

        for batch in batches:
            keys, rows, ranges = [], [], []
            columns = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("at", "words", "hashes", "spots"))
            for i, (at, words, hashes, spots) in enumerate(zip(*columns)):
                ended: dict[bytes, int] = {}
                for first, end in runs_around(words, sorted(spots), gram_words, run_words):
                    key = xxhash.xxh3_128_digest(hashes[HASH * first : HASH * end])
                    keys.append(key if ended.setdefault(key, end) > first else None)
                    rows.append(i)
                    ranges.append((at[first] << 32) + at[end])
            places = batch.column(batch.schema.get_field_index("place")).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), places, pa.array(ranges, pa.int64())], names=["key", "place", "range"])

    return extend


def _merge(batches):
    """Overlapping and adjacent ranges of a document made one; they come in ascending order."""
    for batch in batches:
        merged = []
        for own in batch.column(1):
            coded = own.values.to_numpy()
            starts, ends = coded >> 32, np.maximum.accumulate(coded & 0xFFFFFFFF)
            new = np.flatnonzero(np.concatenate([[True], starts[1:] > ends[:-1]]))
            merged.append([{"start": a, "end": b} for a, b in zip(starts[new].tolist(), ends[np.append(new[1:], len(ends)) - 1].tolist())])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(merged, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], names=["place", "ranges"])


def repeated_runs(texts: DataFrame, gram_words: int = GRAM_WORDS, run_words: int = RUN_WORDS) -> DataFrame:
    """(place, ranges): ranges [start, end) of pieces to delete, from rows of (place, text)."""
    docs = texts.mapInArrow(_scan(gram_words, run_words), f"place {PLACE}, at array<int>, words array<int>, hashes binary, prints array<struct<gram:long,first:int>>")
    docs = common.cut(docs, "lines")
    prints = docs.select("place", F.explode("prints").alias("p")).select("p.gram", "place", "p.first")
    twice = common.cut(prints.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1"), "twice")
    spots = common.join_back(prints, twice, "gram").groupBy("place").agg(F.collect_set("first").alias("spots"))
    runs = docs.drop("prints").dropDuplicates(["place"]).join(spots, "place").mapInArrow(_extend(gram_words, run_words), f"key binary, place {PLACE}, range long")
    runs = common.cut(runs, "runs")
    keyed = runs.filter("key is not null")
    firsts = common.cut(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("place").alias("low")).filter("n > 1"), "firsts")
    later = common.join_back(keyed, firsts, "key").filter("place > low").select("place", "range")
    repeats = later.unionByName(runs.filter("key is null").select("place", "range"))
    ranges = repeats.groupBy("place").agg(F.array_sort(F.collect_set("range")).alias("ranges"))
    return common.cut(ranges.mapInArrow(_merge, f"place {PLACE}, ranges array<struct<start:int,end:int>>"), "ranges")


def without(text: str, ranges: list[tuple[int, int]]) -> str:
    """The text without the pieces in the ascending ranges; a line of which the end went, but not the start, still ends."""
    pieces, kept, done = pieces_of(text), [], 0
    for start, end in ranges:
        kept += pieces[done:start]
        if pieces[end - 1].endswith(b"\n") and start and not pieces[start - 1].endswith(b"\n"):
            kept.append(b"\n")
        done = end
    return b"".join(kept + pieces[done:]).decode("utf-8", "surrogatepass")


def removed_column(documents: DataFrame) -> str:
    """Name of the column that ``dedup_lines`` adds."""
    return common.fresh(documents, "_lines_removed")


def dedup_lines(documents: DataFrame, gram_words: int = GRAM_WORDS, run_words: int = RUN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows, all columns, with the text without its later repeated runs, and ``removed_column`` (array of [start, end) ranges of pieces, empty if none)."""
    common.small_batches(documents.sparkSession)
    text = common.text_of(text_col)
    place = place_of(F.col(id_col), text)
    runs = repeated_runs(documents.select(place.alias("place"), text.alias("text")), gram_words, run_words)
    held = runs.agg(F.coalesce(F.sum(F.size("ranges") + 4), F.lit(0))).first()[0]
    p, r = common.fresh(documents, "_place"), common.fresh(documents, "_ranges")
    runs = runs.select(F.col("place").alias(p), F.col("ranges").alias(r))
    joined = documents.join(F.broadcast(runs) if held <= BROADCAST_RANGES else runs, place == F.col(p), "left")

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else without(t, list(zip(a.tolist(), b.tolist()))) for t, a, b in zip(texts, starts, ends)], dtype=object)

    cleaned = cleaned.asNondeterministic()  # so a filter on the new text does not make a second worker clean it again
    touched = F.col(r).isNotNull()
    clean = cleaned(F.when(touched, F.col(text_col)), F.col(r)["start"], F.col(r)["end"])
    none = F.array().cast("array<struct<start:int,end:int>>")
    return joined.withColumn(text_col, F.when(touched, clean).otherwise(F.col(text_col))).withColumn(removed_column(documents), F.coalesce(F.col(r), none)).drop(p, r)


def query(spark, sf_dir) -> DataFrame:
    """doc_id, the text that stays, its lines before, how many pieces went, and the ranges that went."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    before = docs.withColumn("n_lines", (F.length(common.text_of()) - F.length(F.replace(common.text_of(), F.lit("\n"), F.lit(""))) + 1).cast("long"))
    after = dedup_lines(before)
    ranges = F.array_join(F.transform("_lines_removed", lambda r: F.concat_ws(":", r["start"].cast("string"), r["end"].cast("string"))), ",")
    gone = F.aggregate("_lines_removed", F.lit(0), lambda n, r: n + r["end"] - r["start"])
    return after.select("doc_id", "text", "n_lines", gone.cast("long").alias("n_removed"), ranges.alias("removed"))
