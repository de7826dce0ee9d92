"""Quality rules by compression bands.

A text that zstandard shrinks too far is repetitive, one that it can hardly
shrink is noise. Short texts compress worse than long ones, so the limits go by
length. The whole text and its fixed chunks are both held against their bands;
the last chunk, what is left after the full ones, against the band of a whole
text of its length.

Cases: a null text counts as empty; an empty text has no words and ratio null,
and fails the base rule; extra columns of the input are ignored; each input row
gives one output row, repeated rows included.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm import common

#: (bytes below, lowest and highest ratio of compressed to raw bytes) of whole texts.
WHOLE_BANDS = (
    (128, 0.30, 4.00),
    (256, 0.32, 1.10),
    (512, 0.34, 0.95),
    (1024, 0.32, 0.90),
    (2048, 0.28, 0.85),
    (8192, 0.25, 0.80),
    (1 << 62, 0.20, 0.75),
)
CHUNK_BYTES = 4096
#: Lowest and highest ratio of a full chunk, and the part of a text's bytes that may lie in chunks outside their band.
CHUNK_BAND = (0.25, 0.85)
CHUNK_PART = 0.5
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
LEVEL = 3

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
    " base_failed boolean, kept boolean, n_bytes long, ratio double, n_chunks long, n_chunks_outside long, reason string"
)
_SYMBOLS = b"#*$%&|<>"


def repeated_words(words: list) -> int:
    """Words that lie in a three-word window found twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    seen, twice = set(), set()
    for w in windows:
        (twice if w in seen else seen).add(w)
    n = upto = 0
    for i, w in enumerate(windows):
        if w in twice:
            n += i + 3 - max(i, upto)
            upto = i + 3
    return n


def base_measures(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    seen, again = set(), 0
    for line in raw.split(b"\n"):
        if line in seen:
            again += 1
        elif line.strip():
            seen.add(line)
    return (
        len(words),
        len(text) - sum(text.count(c) for c in common.SPACE),
        len(raw) - len(raw.translate(None, _SYMBOLS)),
        again,
        repeated_words(words),
    )


def band(n_bytes: int) -> tuple[float, float]:
    return next((low, high) for below, low, high in WHOLE_BANDS if n_bytes < below)


def compression_verdict(raw: bytes, compressor) -> tuple[float | None, int, int, str | None]:
    """Whole ratio, chunks, chunks outside their band, reason to reject."""
    if not raw:
        return None, 0, 0, None
    ratio = len(compressor.compress(raw)) / len(raw)
    low, high = band(len(raw))
    reason = "repetitive" if ratio < low else "incompressible" if ratio > high else None
    if len(raw) < CHUNK_BYTES:  # one chunk, the text itself
        return ratio, 1, int(reason is not None), reason
    outside = []
    for i in range(0, len(raw), CHUNK_BYTES):
        chunk = raw[i : i + CHUNK_BYTES]
        least, most = CHUNK_BAND if len(chunk) == CHUNK_BYTES else band(len(chunk))
        if not least <= len(compressor.compress(chunk)) / len(chunk) <= most:
            outside.append(len(chunk))
    if reason is None and sum(outside) > CHUNK_PART * len(raw):
        reason = "chunks"
    return ratio, -(-len(raw) // CHUNK_BYTES), len(outside), reason


def _judge(batches):
    import zstandard

    compressor = zstandard.ZstdCompressor(level=LEVEL)
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    for batch in batches:
        out = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            n_words, *measures = base_measures(text)
            failed = n_words < MIN_WORDS or 100 * measures[3] > MAX_REPEAT_PERCENT * n_words
            raw = text.encode("utf-8", "surrogatepass")
            ratio, n_chunks, outside, reason = compression_verdict(raw, compressor)
            kept = not failed and reason is None
            out.append((doc_id, n_words, *measures, failed, kept, len(raw), ratio, n_chunks, outside, "base" if failed else reason))
        columns = list(zip(*out)) if out else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], names=names)


_TYPES = [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.string()]


def judge_quality(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the base measures, the compression ratios and the verdict (``SCHEMA``)."""
    common.small_batches(documents.sparkSession)
    return documents.select(F.col(id_col).cast("long").alias("doc_id"), common.text_of(text_col).alias("text")).mapInArrow(_judge, SCHEMA)


def keep_good(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """The input rows, all columns and their order unchanged, whose text passes base rule and bands."""
    common.small_batches(documents.sparkSession)

    @F.pandas_udf("boolean")
    def passes(texts: pd.Series) -> pd.Series:
        import zstandard

        compressor = zstandard.ZstdCompressor(level=LEVEL)

        def one(text):
            n_words, *measures = base_measures(text)
            if n_words < MIN_WORDS or 100 * measures[3] > MAX_REPEAT_PERCENT * n_words:
                return False
            return compression_verdict(text.encode("utf-8", "surrogatepass"), compressor)[3] is None

        return texts.map(one)

    return documents.filter(passes(common.text_of(text_col)))


def query(spark, sf_dir) -> DataFrame:
    return judge_quality(common.table(spark, sf_dir, "documents"))
