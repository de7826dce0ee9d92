"""Composition, linear scans, models, readers, strict checks and drivers."""

import json
import threading
import time
import unicodedata
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry.functions import models, scan
from docquarry.functions import text as tx
from docquarry.functions import vectors as vx
from docquarry.operators import answer as an
from docquarry.operators import bm25, chunking, dense, evaluate, fusion, quality, reflow, router, structure
from docquarry.plans import retrieval
from docquarry.sources import io, scratch

QUESTIONS = ["Theo Điều 87 khoản 2, Bộ Công an có trách nhiệm gì?", "Ủy ban nhân dân có quyền gì, những cơ quan nào?", "What is the law?", "Å 가 é"]


def test_decomposed_text_is_treated_as_composed(spark):
    rows = [(i, form, unicodedata.normalize(form, q)) for i, q in enumerate(QUESTIONS) for form in ("NFC", "NFD")]
    df = spark.createDataFrame(rows, "qid int, form string, question string")
    pairs = {}
    for r in router.route(df).drop("intent_scores").collect():
        pairs.setdefault(r.qid, []).append(tuple(r)[2:])
    assert all(a == b for a, b in pairs.values())
    assert pairs[0][0][7] == [87] and pairs[0][0][9] == ["Bộ Công an"]
    assert all(tuple(r) == (True, True, True) for r in df.groupBy("qid").agg(*(F.count_distinct(c) == 1 for c in (tx.normalize_text(F.col("question")), tx.tokens(F.col("question")), reflow.reflow(F.col("question"))))).drop("qid").collect())
    found = fusion.entity_matches(spark.createDataFrame([("BỘ CÔNG AN",)], "entity string"), df.select(F.col("form").alias("chunk_id"), F.col("question").alias("text")).filter("qid = 0"))
    assert sorted(r.chunk_id for r in found.collect()) == ["NFC", "NFD"]


def test_running_folds(spark):
    for n in (0, 1, 63, 64, 65, 129, 1000):
        values = [(i * 7) % 13 for i in range(n)]
        df = spark.createDataFrame([(values,)], "v array<int>")
        assert df.select(scan.running_sum(F.col("v"))).first()[0] == np.cumsum(values).tolist()


def test_work_is_linear_in_a_text(spark):
    def took(n, of):
        df = spark.createDataFrame([("d", 1, "a line, that goes on\n1. and a clause.\n" * n)], "document_id string, page int, text string")
        best = 1e9
        for _ in range(2):
            began = time.perf_counter()
            of(df).collect()
            best = min(best, time.perf_counter() - began)
        return best

    for of in (lambda df: df.select(F.length(reflow.reflow(F.col("text"), composed=True))), lambda df: structure.lines(df).agg(F.sum("at"))):
        took(1000, of)
        assert took(16_000, of) < 2.5 * took(8000, of)


def test_models_load_once_and_warm_up(spark):
    class Fake:  # local, so that workers get it by value
        def __init__(self, seen=None):
            self.seen = [] if seen is None else seen
            self.seen.append("made")

        def encode(self, texts, batch_size):
            if texts == ["warm-up"]:
                self.seen.append("warm")
            return [[len(t), 1.0] for t in texts]

        def predict(self, pairs, batch_size):
            return [len(q) - len(t) for q, t in pairs]

    seen = []
    encoder = models.SentenceEncoder("driver", load=lambda: Fake(seen))
    assert seen == []  # nothing is loaded before it is asked
    assert encoder(["ab"]).tolist() == [[2.0, 1.0]] and encoder(["abc"]).tolist() == [[3.0, 1.0]]
    assert seen == ["made", "warm"]
    assert models.CrossEncoderScorer("driver", load=Fake)(["abc"], ["a"]) == [2.0]
    got = vx.encode(spark.createDataFrame([("abc",), ("",)], "text string"), "text", models.SentenceEncoder("worker", load=Fake)).collect()
    assert [round(r.embedding[0] / r.embedding[1]) for r in got] == [3, 0]


def test_chat_server(spark):
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            self._send({"data": []})

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            content = None if "nothing" in body["messages"][1]["content"] else f" {body['model']} [S1] "
            self._send({"choices": [{"message": {"content": content}}]})

        def _send(self, value):
            data = json.dumps(value).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    chat = an.ChatGenerator(f"http://127.0.0.1:{server.server_port}", "m", timeout=10)
    assert chat.is_available() and chat.generate("s", "p") == "m [S1]"
    with pytest.raises(RuntimeError):
        chat.generate("s", "nothing")
    server.shutdown()
    server.server_close()
    assert not chat.is_available()


def test_files(spark, tmp_path):
    np.save(tmp_path / "m.npy", np.arange(6, dtype="f4").reshape(3, 2))
    assert [(r.vector_index, r.embedding) for r in io.read_npy(spark, str(tmp_path / "m.npy")).orderBy("vector_index").collect()] == [(0, [0, 1]), (1, [2, 3]), (2, [4, 5])]
    (tmp_path / "a.jsonl").write_text('{"a": 1, "b": "x"}\n\n{"a": 2\n{"b": "y"}\n')
    assert [(r.line, r.record) for r in io.malformed_lines(spark, str(tmp_path / "a.jsonl"), "a int, b string").orderBy("line").collect()] == [(3, '{"a": 2'), (4, '{"b": "y"}')]
    (tmp_path / "doc.txt").write_bytes("één\fтwo".encode())
    assert [(r.document_id, r.page, r.text, r.char_count) for r in io.binary_pages(spark, str(tmp_path / "doc.txt"), lambda b: b.decode().split("\f")).collect()] == [("doc", 1, "één", 3), ("doc", 2, "тwo", 3)]
    means = spark.createDataFrame([("a", 0.5)], "index string, mrr double")
    evaluate.write_outputs(means, means, str(tmp_path / "out"), evaluate.markdown_report(means, "index"))
    assert spark.read.text(str(tmp_path / "out/report")).count() == 5
    assert [len(r.sha256) for r in io.sha256_of_files(spark, str(tmp_path / "a.jsonl")).collect()] == [64]


def test_strict_checks(spark):
    pages = spark.createDataFrame([("d", 1, "some text " * 100)], "document_id string, page int, text string")
    chunks = chunking.fixed_chunks(pages)
    assert quality.check_before_embedding(chunks, strict=True).count() == 0
    for damaged in (chunks.withColumn("char_count", F.lit(1)), chunks.limit(0), chunks.drop("text")):
        with pytest.raises(ValueError):
            quality.check_before_embedding(damaged, strict=True)
    index = spark.createDataFrame([("a", [1.0, 0.0], 0), ("b", [0.0, 1.0], 1)], "chunk_id string, embedding array<float>, vector_index int")
    assert dense.check_index(index, strict=True).first().ok
    with pytest.raises(Exception, match="index check failed"):
        dense.check_index(index.withColumn("vector_index", F.lit(0)), strict=True).collect()
    with pytest.raises(Exception, match="has not 3 numbers"):
        dense.encode_questions(spark.createDataFrame([("q",)], "question string"), vx.HashingEncoder(2), dimension=3).collect()


def test_queries_go_in_parts(spark, monkeypatch):
    index = spark.createDataFrame([(str(i), [float(i), 1.0]) for i in range(5)], "chunk_id string, embedding array<float>")
    asked = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(9)], "qid int, query_vector array<float>")
    whole = sorted(map(tuple, dense.scores(index, asked).collect()))
    names = spark.createDataFrame([("one",), ("Two",), ("x",)], "entity string")
    texts = spark.createDataFrame([("a", "one  TWO"), ("b", "two"), ("c", None)], "chunk_id string, text string")
    matched = sorted(map(tuple, fusion.entity_matches(names, texts).collect()))
    monkeypatch.setattr(scratch.in_parts, "__defaults__", (40,))
    assert sorted(map(tuple, dense.scores(index, asked).collect())) == whole and len(whole) == 45
    assert sorted(map(tuple, fusion.entity_matches(names, texts).collect())) == matched == [("Two", "a"), ("Two", "b"), ("one", "a")]


def test_timed_search_and_ablation(spark):
    pages = spark.createDataFrame([("d", i, f"Điều {i}. t\n1. word{i} and word{i + 1} stand here for long enough to count\n2. other{i} text that is long enough") for i in range(1, 9)], "document_id string, page int, text string")
    chunks = structure.structured_chunks(pages)
    questions = spark.createDataFrame([(1, "word3 and word4"), (2, "other5 text")], "qid int, question string")
    found, took = retrieval.timed_hybrid_search(retrieval.Corpus.build(chunks, vx.HashingEncoder(16)), questions, vx.HashingEncoder(16))
    assert found.filter("rank = 1").count() == 2 and set(took) == {"encode", "dense", "bm25", "fusion", "total"} and took["total"] >= took["bm25"]
    documents = chunking.global_documents(pages)
    anchors = spark.createDataFrame([(1, "1_a", "word3 and word4 stand", "d"), (2, "2_a", "other5 text that is long", "d")], "question_id int, evidence_id string, anchor string, document_id string")
    evidence = evaluate.locate_evidence(documents, anchors, strict=True)
    fixed = chunking.fixed_chunks(pages)
    systems = {"fixed": (fixed, evaluate.chunk_spans(fixed, pages)), "structured": (chunks, evaluate.structured_spans(chunks))}
    search = lambda c: bm25.search(bm25.build_index(c), questions, 5).withColumnRenamed("qid", "question_id")
    out = evaluate.ablation(systems, evidence, search, questions.select(F.col("qid").alias("question_id")))
    assert {n: [(r.question_id, r.mrr, r.evidence_recall) for r in df.orderBy("question_id").collect()] for n, df in out.items()} == {n: [(1, 1.0, 1.0), (2, 1.0, 1.0)] for n in systems}


def test_candidates_of_anchors(spark):
    docs = spark.createDataFrame([("a", "x one two three four five y"), ("b", "one two three four"), ("c", "two words"), ("d", None)], "document_id string, full_text string")
    items = spark.createDataFrame([(1, "ne two three four fiv"), (2, "two words"), (3, "zz"), (4, "one two three four five six")], "question_id int, anchor string")
    assert sorted((r.document_id, r.question_id) for r in evaluate.candidate_documents(docs, items).collect()) == [("a", 1), ("c", 2)]
