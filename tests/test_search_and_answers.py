import math
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from docquarry.functions import vectors as vx
from docquarry.operators import answer as an
from docquarry.operators import bm25, dense, evaluate, fusion, quality, router
from docquarry.plans import retrieval
from docquarry.sources import io


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import tests


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [
        ("c1", "Bộ Công an có trách nhiệm quản lý", "87", "2", 1, 1), ("c2", "Chính phủ quy định chi tiết", "87", None, 1, 2), ("c3", "xe cơ giới phải nhường đường", "5a", "2", 2, 2),
        ("c4", "xe thô sơ đi bên phải", "9", "1", 3, 3), ("c5", "người đi bộ qua đường", "10", "intro", 4, 4),
    ]
    return spark.createDataFrame(rows, "chunk_id string, text string, article_number string, clause string, page_start int, page_end int").persist()


def test_routes(spark):
    rows = [(1, "Theo Điều 87 khoản 2, Bộ Công an có trách nhiệm gì?"), (2, "Bộ Công an có trách nhiệm gì và những cơ quan nào liên quan, các cơ quan khác?"), (3, "What must the driver do on the road?"), (4, "abc"), (5, "ĐIỀU 3 và điều 3, ủy ban nhân dân, uỷ ban nhân dân")]
    got = {r.qid: r for r in router.route(spark.createDataFrame(rows, "qid int, question string")).collect()}
    assert (got[1].filter_strategy, got[1].article_numbers, got[1].clause_numbers, got[1].entities, got[1].intent, got[1].language) == ("hard", [87], ["2"], ["Bộ Công an"], "responsibility", "vi")
    assert (got[2].filter_strategy, got[2].multi_evidence, got[2].candidate_top_k, got[2].multi_evidence_confidence) == ("soft", True, 30, 0.95)
    assert (got[3].language, got[3].filter_strategy, got[3].candidate_top_k, got[3].intent, got[3].intent_confidence) == ("en", "none", 20, "general", 0.5)
    assert (got[4].language, got[4].language_confidence) == ("unknown", 0.5)
    assert (got[5].article_numbers, got[5].entities) == ([3], ["Ủy ban nhân dân"])
    with pytest.raises(Exception, match="blank question"):
        router.route(spark.createDataFrame([(1, " \t")], "qid int, question string")).collect()


def test_bm25_equals_the_formula(spark, chunks):
    index = bm25.build_index(chunks)
    got = {r.chunk_id: r.score for r in bm25.search(index, spark.createDataFrame([(1, "xe xe đường")], "qid int, question string")).collect()}
    docs = {r.chunk_id: r.text.lower().split() for r in chunks.collect()}
    average, n = sum(map(len, docs.values())) / len(docs), len(docs)

    def score(words):
        total = 0.0
        for term, times in (("xe", 2), ("đường", 1)):
            df, tf = sum(term in d for d in docs.values()), words.count(term)
            total += times * math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(words) / average))
        return round(total, 6)

    assert got == {k: s for k, d in docs.items() if (s := score(d)) > 0}
    with pytest.raises(ValueError):
        bm25.build_index(chunks.limit(0))


def test_fusion_and_ties(spark):
    d = spark.createDataFrame([(1, "a", 1, 0.9), (1, "b", 2, 0.8)], "qid int, chunk_id string, rank int, score double")
    b = spark.createDataFrame([(1, "c", 1, 3.0), (1, "b", 2, 2.0)], "qid int, chunk_id string, rank int, score double")
    got = fusion.fuse(d, b).orderBy("rank").collect()
    assert [(r.chunk_id, r.dense_rank, r.bm25_rank) for r in got] == [("b", 2, 2), ("a", 1, None), ("c", None, 1)]
    assert abs(got[0].rrf_score - 2 / 62) < 1e-9


def test_hard_filter_keeps_sets_independent(spark, chunks):
    q = spark.createDataFrame([(1, [87, 9], ["2"]), (2, [87], []), (3, [5], [])], "qid int, article_numbers array<int>, clause_numbers array<string>")
    got = {(r.qid, r.chunk_id) for r in fusion.hard_filter(q, chunks).collect()}
    assert got == {(1, "c1"), (2, "c1"), (2, "c2")}


def test_soft_entities(spark, chunks):
    candidates = spark.createDataFrame([(1, c, i, 0.5, i, 0.1, None, None) for i, c in enumerate(("c4", "c5", "c3"), 1)], "qid int, chunk_id string, rank int, rrf_score double, dense_rank int, dense_score double, bm25_rank int, bm25_score double")
    q = spark.createDataFrame([(1, ["Bộ Công an", "Chính phủ"], 3)], "qid int, entities array<string>, candidate_top_k int")
    scores = spark.createDataFrame([(1, "c1", 0.4), (1, "c2", 0.2)], "qid int, chunk_id string, score double")
    got = fusion.soft_entities(candidates, q, chunks, scores).orderBy("rank").collect()
    assert [(r.chunk_id, r.routing_added, r.routing_reason) for r in got] == [("c4", False, None), ("c1", True, "soft_entity:Bộ Công an"), ("c2", True, "soft_entity:Chính phủ")]
    assert [r.rank for r in got] == [1, 2, 3] and got[1].rrf_score == 0.0 and got[1].bm25_rank is None


def test_routed_answers(spark, chunks):
    corpus = retrieval.Corpus.build(chunks, vx.HashingEncoder(64))
    q = spark.createDataFrame([(1, "Theo Điều 87 khoản 2, Bộ Công an có trách nhiệm gì?"), (2, "xe cơ giới phải nhường đường"), (3, "Theo Điều 999 là gì?")], "qid int, question string")
    found = retrieval.routed_retrieval(corpus, q, vx.HashingEncoder(64)).collect()
    assert {r.chunk_id for r in found if r.qid == 1} == {"c1"} and not [r for r in found if r.qid == 3]
    got = {r.qid: r for r in retrieval.ask(corpus, q, an.ExtractiveGenerator(), encoder=vx.HashingEncoder(64)).collect()}
    assert (got[2].status, got[2].answer, got[2].sources[0].chunk_id) == ("answered", "Xem [S1].", "c3")
    assert (got[3].status, got[3].guardrail.reason, got[3].guardrail.top1_score, got[3].answer) == ("abstain", "no_retrieval_results", -math.inf, an.ABSTENTION)


def test_guardrail_is_inclusive(spark):
    df = spark.createDataFrame([(x,) for x in (7.5, 4.9, 0.769, 0.5, -1.07, -5.0)], "s double")
    assert [r[0] for r in df.select(an.decide_score(F.col("s"))["action"]).collect()] == ["answer"] * 3 + ["abstain"] * 3


class Scripted:
    def __init__(self, answers, up=True):
        self.answers, self.up = answers, up

    def is_available(self):
        return self.up

    def generate(self, system, prompt):
        got = self.answers[1 if "YÊU CẦU SỬA:" in prompt else 0]
        if got is None:
            raise RuntimeError("down")
        return got


@pytest.mark.parametrize(("answers", "up", "status", "attempts"), [
    (["x [S1]", ""], True, "answered", 1), (["x", "y [S1]"], True, "answered", 2), (["x [S9]", "y"], True, "citation_validation_failed", 2),
    ([None, ""], True, "generation_error", 1), (["x [S1]", ""], False, "generator_unavailable", 0),
])
def test_answer_states(spark, answers, up, status, attempts):
    q = spark.createDataFrame([(1, "hỏi")], "qid int, question string")
    ranked = spark.createDataFrame([(1, 1, "c1", " nội dung ", "87", "2", 1, 2, 5.0)], "qid int, rank int, chunk_id string, text string, article_number string, clause string, page_start int, page_end int, rerank_score double")
    got = an.answer(q, ranked, Scripted(answers, up)).first()
    assert (got.status, got.attempts) == (status, attempts)
    assert got.context == "[S1]\nĐiều: 87\nKhoản: 2\nTrang: 1-2\nChunk ID: c1\nNội dung:\nnội dung"
    if status == "generation_error":
        assert got.generation_error == "RuntimeError: down"
    assert an.answer(q, ranked, enable_generation=False).first().status == "supported"


def test_citations(spark):
    df = spark.createDataFrame([("[S1]",), ("[S2] và [S3]",), ("[S7]",), ("không",), ("[s01]",)], "a string")
    allowed = F.array(*(F.lit(f"S{i}") for i in (1, 2, 3)))
    got = [r[0] for r in df.select(an.validate_citations(F.col("a"), allowed)).collect()]
    assert [g.reason for g in got] == ["citation_integrity_pass"] * 2 + ["invalid_source_reference", "missing_required_citation", "citation_integrity_pass"]


def test_metrics(spark):
    q = spark.createDataFrame([(1,), (2,)], "question_id int")
    found = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3)], "question_id int, chunk_id string, rank int")
    rel = spark.createDataFrame([(1, "c"), (1, "z")], "question_id int, chunk_id string")
    ev = spark.createDataFrame([(1, "e1", "c"), (1, "e2", "z")], "question_id int, evidence_id string, chunk_id string")
    got = {r.question_id: r for r in evaluate.score(found, rel, q, evidence=ev).collect()}
    assert (got[1].precision, got[1].recall, got[1].hit, round(got[1].mrr, 9), got[1].evidence_recall) == (0.2, 0.5, 1.0, round(1 / 3, 9), 0.5)
    assert abs(got[1].ndcg - 0.5 / (1 + 1 / math.log2(3))) < 1e-8
    assert tuple(got[2])[1:] == (0.0,) * 6
    assert evaluate.failures(spark.createDataFrame([(1.0, 1.0), (1.0, 0.5)], "evidence_recall double, mrr double")).count() == 1
    assert evaluate.latency_summary(spark.createDataFrame([(x,) for x in (1.0, 2.0, 3.0, 10.0)], "s double"), "s").first().p95 == pytest.approx(8.95)
    assert [r.covers for r in evaluate.hit_details(found, ev).first().hits] == [[], [], ["e1"]]


def test_evidence_thresholds(spark):
    spans = spark.createDataFrame([("d", f"k{n}", 0, n) for n in (19, 20, 49, 50)], "document_id string, chunk_id string, start int, end int")
    units = spark.createDataFrame([(1, "short", "d", 0, 30, 30), (1, "long", "d", 0, 100, 100)], "question_id int, evidence_id string, document_id string, start int, end int, length int")
    got = {(r.evidence_id, r.chunk_id) for r in evaluate.evidence_chunks(units, spans).collect()}
    assert got == {("short", "k20"), ("short", "k49"), ("short", "k50"), ("long", "k50")}
    far = spark.createDataFrame([("d", "k", 4000, 13000)], spans.schema)
    unit = spark.createDataFrame([(1, "e", "d", 4050, 12500, 8450)], units.schema)
    assert evaluate.overlaps(unit, far, F.lit(1)).select("overlap").collect()[0][0] == 8450


def test_article_spans_and_gold(spark):
    pages = spark.createDataFrame([("d", 1, "Điều 5. A\n" + "x" * 50 + "\nĐiều 5a. B\n" + "y" * 40), ("d", 2, "Điều 6. C")], "document_id string, page int, text string")
    spans = evaluate.article_spans(pages)
    got = {r.article: (r.start, r.end) for r in spans.collect()}
    assert got == {5: (61, 113), 6: (113, 123)}
    chunks = spark.createDataFrame([("d", "k1", 0, 90), ("d", "k2", 90, 124)], "document_id string, chunk_id string, start int, end int")
    gold = spark.createDataFrame([("q", [5])], "question_id string, gold_articles array<int>")
    assert [r.chunk_id for r in evaluate.gold_chunks(gold, spans, chunks, 29).collect()] == ["k1"]
    with pytest.raises(Exception, match="missing article"):
        evaluate.gold_chunks(spark.createDataFrame([("q", [77])], gold.schema), spans, chunks).collect()


def test_grading(spark):
    cases = spark.createDataFrame([("a", "q", "answered", "87", "p"), ("b", "q", "abstain", None, "p"), ("c", "q", "answered", "1", "p")], io.DEMO_CASES)
    results = spark.createDataFrame([("a", "q", "answered", [("87",)], (True,), 1), ("b", "q", "abstain", None, None, 0), ("c", "q", "answered", [("87",)], (True,), 1)], "qid string, question string, status string, sources array<struct<article_number:string>>, citation_validation struct<valid:boolean>, attempts int")
    graded = evaluate.grade_cases(cases, results)
    assert {r.id: r.passed for r in graded.collect()} == {"a": True, "b": True, "c": False}
    s = evaluate.summarize_cases(graded).first()
    assert (s.n, s.n_passed, s.failed_ids, s.bypass_rate) == (3, 2, ["c"], 1.0)


def test_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"document_id":"d","page":1,"text":"x","char_count":1}\n\n')
    assert io.read_jsonl(spark, str(tmp_path / "a.jsonl"), io.PAGES_RAW).count() == 1
    (tmp_path / "b.jsonl").write_text('{"document_id":"d"\n')
    with pytest.raises(Exception, match="b.jsonl"):
        io.read_jsonl(spark, str(tmp_path / "b.jsonl"), io.PAGES_RAW).collect()
    with pytest.raises(ValueError, match="page"):
        io.require_fields(spark.range(1), io.PAGES_RAW)
    assert io.sha256_of_files(spark, str(tmp_path / "a.jsonl")).first().length == 56
    pages = io.binary_pages(spark, str(tmp_path / "a.jsonl"), lambda b: b.decode().split("\n\n"))
    assert [(r.document_id, r.page) for r in pages.collect()] == [("a", 1), ("a", 2)]
    assert io.extract_html("<p>a&amp;b</p><script>x</script><p>c</p>") == "a&b\nc"
    e = vx.encode(spark.createDataFrame([("c1", "a b"), ("c2", "")], "chunk_id string, text string"), "text", vx.HashingEncoder(16))
    e = io.with_vector_index(e).persist()
    assert dense.check_index(e, dimension=16).first().ok
    m = io.manifest(e, e, {"model": "hash"}, "00", 1.5).first()
    assert (m.n_chunks, m.dimension, m.status, m.config.model) == (2, 16, "PASS", "hash")
    io.write_jsonl(e.drop("embedding"), str(tmp_path / "out"))
    assert io.read_metadata(spark, str(tmp_path / "out"), "chunk_id string, text string").count() == 2
    assert quality.review_text(e).count() == 2


def test_stream_of_questions(spark, tmp_path):
    from docquarry.streaming import questions as qs

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"qid":1,"question":"Điều 3 là gì?"}\n')
    stream = spark.readStream.schema("qid int, question string").json(str(tmp_path / "in"))
    run = qs.answer_stream(stream, router.route, str(tmp_path / "out"), str(tmp_path / "state"))
    run.processAllAvailable()
    run.stop()
    assert spark.read.parquet(str(tmp_path / "out")).first().filter_strategy == "hard"
