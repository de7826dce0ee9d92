"""The physical plans stay what they were meant to be."""

import io
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from docquarry.operators import bm25, chunking, dense, evaluate, fusion
from docquarry.plans import catalogue

SF = "/root/testdata/sf0.001"


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_windows_stay_in_their_row(spark):
    text = plan(chunking.fixed_chunks(catalogue._pages(spark, SF)))
    assert "Exchange" not in text and "Python" not in text and "Window" not in text


def test_scans_read_only_what_is_used(spark):
    text = plan(catalogue.QUERIES["token_counts"](spark, SF))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text


def test_rankings_cut_early(spark):
    index = bm25.build_index(catalogue._docs(spark, SF))
    for df in (bm25.search(index, catalogue._questions(spark, SF)), dense.search(catalogue._vectors(spark, SF), catalogue._vector_questions(spark, SF))):
        text = plan(df)
        assert "WindowGroupLimit" in text and "EvalPython" not in text and "CartesianProduct" not in text


def test_interval_join_is_a_hash_join(spark):
    spans = spark.createDataFrame([("d", "k", 0, 9)], "document_id string, chunk_id string, start int, end int")
    units = spark.createDataFrame([("d", "e", 0, 9)], "document_id string, evidence_id string, start int, end int")
    text = plan(evaluate.overlaps(units, spans, F.lit(1)))
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_page_lookup_makes_no_pairs(spark):
    ranges = chunking.page_ranges(catalogue._source_pages(spark, SF))
    text = plan(chunking.position_to_page(ranges.select("document_id", F.col("start").alias("position")), ranges))
    assert "Join" not in text


def test_fusion_is_one_aggregate(spark):
    ranked = spark.createDataFrame([(1, "a", 1, 0.5)], "qid int, chunk_id string, rank int, score double")
    assert "Join" not in plan(fusion.fuse(ranked, ranked))


def test_filter_reaches_the_scan(spark):
    text = plan(catalogue._t(spark, SF, "labels").filter("quality = 1").select("doc_id"))
    assert "EqualTo(quality,1)" in text
