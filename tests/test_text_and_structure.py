import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from docquarry.functions import text as tx
from docquarry.operators import chunking, quality, reflow, structure


def values(spark, texts, column, **more):
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "i int, t string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("t"))).collect()]


def fold(text):
    """Sequential form of the reflow rule."""
    structure_line = lambda x: re.match(r"(Chương\s+[IVXLCDM]+|Điều\s+\d+[a-zA-Z]?\.|\d+\.|[a-zA-Zđ]\))", x)
    fresh = lambda x: structure_line(x) or (x.isupper() and len(x) < 150)
    out = []
    for line in unicodedata.normalize("NFC", text).splitlines():
        line = re.sub(r"\s+", " ", line).strip()
        if not line:
            continue
        if out and not fresh(line) and not fresh(out[-1]) and out[-1][-1] not in '.!?:;”"':
            out[-1] += " " + line
        else:
            out.append(line)
    return "\n".join(out)


def test_reflow_equals_the_fold(spark):
    r = random.Random(3)
    parts = ["Điều", "5a. foo", "Chương", "II", "1. một", "a) b", "đ) x", "HAI BA", "tiếp theo", "hết.", "và:", "", "  x  y ", "“q”", "C dài", "Điều 3. Tên", "\x0bvt", "x\x85y", "z w"]
    texts = ["\n".join(r.choice(parts) for _ in range(r.randint(0, 9))) for _ in range(300)] + ["", "\n\n"]
    assert values(spark, texts, reflow.reflow) == [fold(t) for t in texts]


def test_small_functions(spark):
    assert values(spark, ["2a", "3", "x", "12B"], lambda c: tx.clause_sort_key(c)) == [(2, 1), (3, 0), None, (12, 2)]
    assert values(spark, ["[S1] [s01] [S3]", "none", "[S10]"], tx.extract_citations) == [["S1", "S3"], [], ["S10"]]
    assert values(spark, ["a\x00b\x1fc\n\t", "x"], tx.control_characters) == [[0, 31], []]
    assert values(spark, ["Đường bộ  39 Khoản này được sửa đổi 58", "Tên  58", "A\nb"], tx.clean_article_title) == ["Đường bộ", "Tên", "A b"]
    assert values(spark, ["thông đường bộ", "1. x", "39 Khoản này", "12", "Chương II", "Hoa", "a) x", ""], tx.is_title_continuation) == [True, False, False, False, False, False, True, False]
    assert values(spark, ["x_c012", "y"], tx.id_number) == [12, -1]
    assert values(spark, ["à"], tx.nfc) == ["à"]
    assert values(spark, ["  ab  "], lambda c: tx.trim_span(c, F.lit(0), F.lit(6))) == [(2, 4)]
    assert values(spark, ["Số ² và a_b, C"], tx.tokens) == [["số", "²", "và", "a_b", "c"]]


def test_fixed_windows(spark):
    pages = spark.createDataFrame([("d", 1, "x" * 1436), ("d", 2, ""), ("d", 3, "y" * 462 + " " * 562), ("d", 4, "z")], "document_id string, page int, text string")
    got = chunking.fixed_chunks(pages).orderBy("page", "chunk_index").collect()
    assert [(c.page, c.start_char, c.end_char) for c in got] == [(1, 0, 512), (1, 462, 974), (1, 924, 1436), (3, 0, 512), (4, 0, 1)]
    assert got[0].chunk_id == "d_p001_c001"
    with pytest.raises(ValueError):
        chunking.fixed_chunks(pages, 10, 10)
    lengths = [0, 1, 512, 513, 974, 975]
    df = spark.createDataFrame([(x,) for x in lengths], "n int")
    assert [r[0] for r in df.orderBy("n").select(tx.expected_chunk_count(F.col("n"))).collect()] == [0, 1, 1, 2, 2, 3]
    found = {(f.type, f.id) for f in quality.check_fixed(pages, chunking.fixed_chunks(pages)).filter("severity = 'error'").collect()}
    assert found == {("page_without_chunks", "d/2"), ("wrong_chunk_count", "d/3"), ("last_chunk_wrong_end", "d/3")}


def test_damaged_windows_are_found(spark):
    pages = spark.createDataFrame([("d", 1, "word " * 300)], "document_id string, page int, text string")
    chunks = chunking.fixed_chunks(pages)
    bad = chunks.withColumn("text", F.when(F.col("chunk_index") == 2, F.lit("other")).otherwise(F.col("text"))).unionByName(chunks.limit(1))
    types = {f.type for f in quality.check_fixed(pages, bad).collect()}
    assert {"text_source_mismatch", "wrong_char_count", "overlap_content_mismatch", "duplicate_chunk_id", "wrong_chunk_index", "duplicate_chunk_text", "short_chunk"} <= types
    assert {f.type for f in quality.check_before_embedding(bad).collect()} == {"duplicate_chunk_id", "wrong_char_count", "wrong_offset_length"}


LAW = [
    ("law", 1, "Chương I\nQUY ĐỊNH CHUNG\nĐiều 1. Phạm vi điều\nchỉnh của luật\nLuật này quy định về giao thông.\n1"),
    ("law", 2, "Điều 2. Giải thích\nTrong Luật này:\n1. Một là “Điều 9.\n1. trong ngoặc\n2. cũng vậy”;\n2. Hai là:\na) điểm a;\n2a. Hai a.\n1. lặp lại\n3. Ba hết.\n39 Khoản này được sửa đổi theo luật.\n58"),
    ("law", 3, "Chương II\nĐiều 5a. Dài\n1. " + "chữ " * 400),
]


def test_structured_chunks(spark):
    pages = spark.createDataFrame(LAW, "document_id string, page int, text string")
    full = "".join(t + "\n" for _, _, t in LAW)
    got = structure.structured_chunks(pages).orderBy("source_start", "piece_index").collect()
    assert [(c.article_number, c.clause, c.piece_index) for c in got] == [("1", None, 1), ("2", "intro", 1), ("2", "1", 1), ("2", "2", 1), ("2", "2a", 1), ("2", "3", 1), ("5a", "1", 1), ("5a", "1", 2), ("5a", "1", 3)]
    assert got[0].article_title == "Phạm vi điều chỉnh của luật" and got[0].chapter == "I" and got[-1].chapter == "II"
    assert got[0].text == "Điều 1. Phạm vi điều chỉnh của luật\nLuật này quy định về giao thông."
    assert got[5].text.endswith("3. Ba hết.")
    for c in got:
        head = f"Điều {c.article_number}. {c.article_title}\n"
        assert c.text == head + full[c.source_start : c.source_end] and len(c.text) == c.char_count <= 800
    assert [(c.page_start, c.page_end) for c in got] == [(1, 1)] + [(2, 2)] * 5 + [(3, 3)] * 3
    assert got[6].source_end - got[7].source_start == 120
    assert [c.chunk_id for c in got][-1] == "law_a5a_c003"
    errors = quality.check_structured(pages, structure.structured_chunks(pages), 3, 3, 2).filter("severity = 'error'").collect()
    assert errors == []
    wrong = quality.check_structured(pages, structure.structured_chunks(pages).withColumn("page_start", F.lit(9)), 4).collect()
    assert {"wrong_page_count", "page_start_mismatch", "invalid_page_range"} <= {f.type for f in wrong}
    stats = quality.structured_statistics(structure.structured_chunks(pages)).first()
    assert (stats.n_chunks, stats.n_intro, stats.n_fallback, stats.n_articles) == (9, 1, 2, 3)


def test_clause_and_quote_rules():
    assert [x for _, x in structure.rising_clauses(list(enumerate(["1", "2", "1", "2", "3", "4"])), [])] == ["1", "2", "3", "4"]
    assert [x for _, x in structure.rising_clauses(list(enumerate(["1", "2", "2a", "3", "1"])), [])] == ["1", "2", "2a", "3"]
    assert structure.quoted_spans('a “b “c” d” "e" "f') == [(2, 8), (12, 15)]
    assert structure.article_units("Điều 1. X\n", 10) == []


def test_positions_and_ranges(spark):
    pages = spark.createDataFrame([("a", 1, "xx"), ("a", 2, ""), ("a", 3, "yyy")], "document_id string, page int, text string")
    ranges = chunking.page_ranges(pages)
    asks = spark.createDataFrame([("a", p) for p in (-1, 0, 2, 3, 4, 6)], "document_id string, position int")
    got = {r.position: r.page for r in chunking.position_to_page(asks, ranges).collect()}
    assert got == {-1: None, 0: 1, 2: 1, 3: 2, 4: 3, 6: 3}
    assert chunking.global_documents(pages).first().full_text == "xx\n\nyyy\n"
