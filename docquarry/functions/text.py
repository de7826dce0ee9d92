"""Column functions over text: normalization, tokens, citations, spans and small formats.

All are built-in expressions but ``nfc``, for which Spark has no function.
Lengths and offsets count code points.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of structure lines.
STRUCTURE_LINE = r"(?U)^(?:Chương\s+[IVXLCDM]+|Điều\s+\d+[a-zA-Z]?\.|\d+\.|[a-zA-Zđ]\))"
HEADING_BELOW = 150
#: Unicode white space and the four separators that Python also strips.
_WS = r"[\s\x1c-\x1f]"


#: Characters that composition may change: all from U+0300 on but Vietnamese letters, dashes, quotes and Han.
_MAY_COMPOSE = r"[\u0300-\u1e9f\u1efa-\u200f\u2028-\u33ff\uac00-\uffff\x{10000}-\x{10ffff}]"


def _compose(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def nfc(text: Column) -> Column:
    """Canonical composition, in Arrow batches; only texts that may need it are sent there."""
    needs = text.rlike(_MAY_COMPOSE)
    return F.when(needs, F.pandas_udf(_compose, "string")(F.when(needs, text))).otherwise(text)


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, rf"(?U)^{_WS}+|{_WS}+$", "")


def collapse(text: Column) -> Column:
    """Runs of Unicode white space become one space; stripped."""
    return strip(F.regexp_replace(text, rf"(?U){_WS}+", " "))


def normalize_text(text: Column, composed: bool = False) -> Column:
    """Composed (unless ``composed`` says it is already), collapsed and stripped."""
    return collapse(text if composed else nfc(text))


def normalize_lower(text: Column, composed: bool = False) -> Column:
    return F.lower(normalize_text(text.cast("string"), composed))


def tokens(text: Column, composed: bool = False) -> Column:
    """Lower-case runs of letters, digits and underscores of the composed text."""
    return F.regexp_extract_all(F.lower(text if composed else nfc(text)), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def is_structure_line(line: Column) -> Column:
    return strip(line).rlike(STRUCTURE_LINE)


def is_heading_line(line: Column) -> Column:
    """Some cased letter, no lower-case one, and shorter than 150."""
    s = strip(line)
    return (s == F.upper(s)) & (s != F.lower(s)) & (F.length(s) < HEADING_BELOW)


def split_lines(text: Column) -> Column:
    """Lines at every Unicode line boundary, stripped, white space collapsed, empty ones dropped."""
    raw = F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")
    return F.filter(F.transform(raw, collapse), lambda x: x != "")


def overlap_size(start_a, end_a, start_b, end_b) -> Column:
    return F.greatest(F.lit(0), F.least(end_a, end_b) - F.greatest(start_a, start_b))


def clause_sort_key(label: Column) -> Column:
    """struct(number, suffix rank): "2a" gives (2, 1), "3" gives (3, 0); null if the label has another form."""
    number = F.regexp_extract(label, r"^(\d+)[a-zA-Z]?$", 1)
    suffix = F.lower(F.regexp_extract(label, r"^\d+([a-zA-Z]?)$", 1))
    return F.when(number != "", F.struct(number.cast("int").alias("number"), F.when(suffix == "", 0).otherwise(F.ascii(suffix) - 96).alias("suffix")))


def trim_span(text: Column, start: Column, end: Column) -> Column:
    """struct(start, end) of a span of ``text`` without white space at its ends."""
    part = F.substring(text, start + 1, end - start)
    left = F.length(part) - F.length(F.regexp_replace(part, rf"(?U)^{_WS}+", ""))
    right = F.length(part) - F.length(F.regexp_replace(part, rf"(?U){_WS}+$", ""))
    return F.struct((start + left).alias("start"), F.greatest(start + left, end - right).alias("end"))


# Beginnings of a footnote after its number.
FOOTNOTE_AFTER = r"(?:Khoản(?:\s+này|\s+\d+[a-zA-Z]?)|Điểm(?:\s+này|\s+[a-zA-Z])|Điều(?:\s+này|\s+\d+)|Đoạn\s+này|Cụm\s+từ|Nội\s+dung|Tên\s+)"
FOOTNOTE = rf"\d{{1,3}}\s+(?={FOOTNOTE_AFTER})"
PAGE_NUMBER = r"\s*\d{1,3}\s*"
CHAPTER = r"^Chương\s+([IVXLCDM]+)\s*$"
ARTICLE = r"^Điều\s+(\d+[a-zA-Z]?)\.\s*(.*)$"
CLAUSE = r"^(\d+[a-zA-Z]?)\.(?:\d+)?\s+"
#: The narrower footnote of the quality check.
FOOTNOTE_CHECK = r"\d{1,3}\s+(?:Khoản|Điểm|Điều|Đoạn|Cụm\s+từ|Nội\s+dung|Tên)\s+này"


def clean_article_title(title: Column) -> Column:
    """One line, cut at the first embedded footnote, without a trailing page number."""
    one = collapse(title)
    cut = strip(F.regexp_replace(one, rf"(?iU)\s+{FOOTNOTE}.*$", ""))
    return strip(F.regexp_replace(cut, r"(?U)\s+\d{1,3}\s*$", ""))


def is_title_continuation(line: Column) -> Column:
    """Not blank, no clause, footnote, page number or chapter, and its first letter is lower case."""
    s = strip(line)
    letter = F.regexp_extract(s, r"(\p{L})", 1)
    other = s.rlike(rf"(?U){CLAUSE}") | s.rlike(rf"(?iU)^{FOOTNOTE}") | s.rlike(r"(?U)^\d{1,3}$") | s.rlike(rf"(?U){CHAPTER}")
    return (s != "") & ~other & (letter != "") & (letter == F.lower(letter)) & (letter != F.upper(letter))


def control_characters(text: Column) -> Column:
    """Codes below 32 but newline, carriage return and tab."""
    return F.transform(F.regexp_extract_all(text, F.lit("([\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F])"), F.lit(1)), F.ascii)


def expected_chunk_count(length: Column, size: int = 512, overlap: int = 50) -> Column:
    return F.when(length <= 0, 0).when(length <= size, 1).otherwise(1 + F.ceil((length - size) / F.lit(size - overlap))).cast("int")


def extract_citations(answer: Column) -> Column:
    """"S1", "S2", ... as cited, each once, in order; "[s01]" is S1."""
    numbers = F.regexp_extract_all(answer, F.lit(r"(?iU)\[S(\d+)\]"), F.lit(1))
    return F.array_distinct(F.transform(numbers, lambda n: F.concat(F.lit("S"), n.cast("bigint").cast("string"))))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def preview(text: Column, size: int = 300) -> Column:
    return F.substring(text, 1, size)


def page_chunk_id(document_id: Column, page: Column, index: Column) -> Column:
    return F.format_string("%s_p%03d_c%03d", document_id, page, index)


def article_chunk_id(document_id: Column, article: Column, index: Column) -> Column:
    return F.format_string("%s_a%s_c%03d", document_id, article, index)


def id_number(chunk_id: Column) -> Column:
    """The number that ends a chunk id; -1 without one."""
    found = F.regexp_extract(chunk_id, r"_c(\d+)$", 1)
    return F.when(found == "", -1).otherwise(found.cast("int"))


def shown(value: Column, default="-") -> Column:
    return F.coalesce(value, F.lit(default))


def candidate_text(metadata_text: Column, text: Column) -> Column:
    """The first of the two that is not blank, else empty."""
    full = lambda c: F.when(strip(c) != "", c)
    return F.coalesce(full(metadata_text), full(text), F.lit(""))


def shown_number(value: Column, digits: int = 4) -> Column:
    return F.when(value.isNull(), F.lit("-")).otherwise(F.format_string(f"%.{digits}f", value.cast("double")))


def retrieval_seconds(timing: Column, stage: str = "retrieval", total: str = "total") -> Column:
    """Seconds of a stage from a struct or map of timings, where the stage is a number or has a total itself; else null."""
    told = F.to_json(timing)
    return F.coalesce(F.get_json_object(told, f"$.{stage}.{total}"), F.get_json_object(told, f"$.{stage}")).try_cast("double")
