"""What a search, a window or an evidence lookup may shuffle: never all pairs, never whole texts."""

import random

from docquarry.functions import vectors as vx
from docquarry.operators import answer as an
from docquarry.operators import bm25, chunking, dense, evaluate, fusion
from docquarry.plans import retrieval


def shuffled(spark, run) -> tuple[object, int]:
    """The result of ``run`` and the bytes that its stages wrote for shuffles."""

    def total() -> int:
        sc = spark.sparkContext._jsc.sc()
        sc.listenerBus().waitUntilEmpty(30_000)
        return sum(sc.statusStore().executorList(False).apply(i).totalShuffleWrite() for i in range(sc.statusStore().executorList(False).length()))

    before = total()
    return run(), total() - before


def test_search_hands_on_no_pairs(spark):
    r = random.Random(1)
    rows = [(f"c{i}", " ".join(r.choices([f"w{j}" for j in range(300)], k=20)) + " common") for i in range(6000)]
    asked = spark.createDataFrame([(i, " ".join(r.choices([f"w{j}" for j in range(300)], k=5)) + " common") for i in range(100)], "qid int, question string")
    index = bm25.build_index(spark.createDataFrame(rows, "chunk_id string, text string"))
    got, moved = shuffled(spark, lambda: bm25.search(index, asked, 5).collect())
    want = bm25.top(bm25.scores(index, asked), 5).collect()
    assert sorted(map(tuple, got)) == sorted((r.qid, r.chunk_id, r.score, r.rank) for r in want)
    assert moved < 1_000_000  # 600,000 pairs otherwise


def test_ranges_and_articles_shuffle_no_texts(spark):
    r = random.Random(2)
    pages = spark.createDataFrame([(f"d{i % 3}", i, f"Điều {i + 1}. x\n" + "".join(chr(r.randrange(97, 123)) for _ in range(5000))) for i in range(300)], "document_id string, page int, text string")
    got, moved = shuffled(spark, lambda: (chunking.page_ranges(pages).collect(), evaluate.article_spans(pages).collect()))
    assert len(got[0]) == len(got[1]) == 300 and moved < 300_000  # 1,500,000 characters


def test_windows_make_the_text_once(spark):
    pages = spark.createDataFrame([("a", 1, "x" * 1000), ("b", 1, " "), ("c", 1, "")], "document_id string, page int, text string")
    plan = chunking.fixed_chunks(pages.selectExpr("document_id", "page", "concat(text, reverse(text)) as text"))
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("reverse(") == 1
    assert [(c.start_char, c.end_char) for c in plan.orderBy("start_char").collect()] == [(0, 512), (462, 974), (924, 1436), (1386, 1898), (1848, 2000)]


def test_evidence_is_found_without_moving_texts(spark):
    r = random.Random(3)
    text = [" ".join("".join(chr(r.randrange(97, 123)) for _ in range(6)) for _ in range(700)) for _ in range(200)]
    documents = spark.createDataFrame([(str(i), t) for i, t in enumerate(text)], "document_id string, full_text string").repartition(8).persist()
    documents.count()
    anchors = spark.createDataFrame([(i, " ".join(text[i].split()[5:15])) for i in range(200)], "question_id int, anchor string")

    def run():
        met = evaluate.candidate_documents(documents, anchors).selectExpr("*", "'e' || question_id as evidence_id")
        return evaluate.locate_evidence(documents, met).collect()

    got, moved = shuffled(spark, run)
    assert sorted((x.question_id, x.document_id, x.start) for x in got) == sorted((i, str(i), text[i].index(" ".join(text[i].split()[5:15]))) for i in range(200))
    assert moved < 300_000  # the texts are 980,000 characters


def test_dense_search_hands_on_no_pairs(spark):
    r = random.Random(4)
    index = spark.createDataFrame([(f"c{i}", [r.gauss(0, 1) for _ in range(8)]) for i in range(6000)], "chunk_id string, embedding array<float>")
    asked = spark.createDataFrame([(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(100)] + [(100, None)], "qid int, query_vector array<float>")
    got = dense.search(index, asked, 5)
    want = bm25.top(dense.scores(index, asked.filter("qid < 100")), 5)
    assert sorted(map(tuple, got.select("qid", "chunk_id", "score", "rank").collect())) == sorted(map(tuple, want.select("qid", "chunk_id", "score", "rank").collect()))
    assert "MapInArrow" in got._jdf.queryExecution().optimizedPlan().toString()  # pairs are scored and cut to k in one place


def test_search_hands_on_a_list_for_each_core_not_for_each_file(spark):
    r = random.Random(5)
    words = [f"w{j}" for j in range(300)]
    chunks = spark.createDataFrame([(f"c{i}", " ".join(r.choices(words, k=20))) for i in range(6000)], "chunk_id string, text string").repartition(64)
    asked = dense.encode_questions(spark.createDataFrame([(i, " ".join(r.choices(words, k=5))) for i in range(100)], "qid int, question string"), vx.HashingEncoder(16)).cache()
    corpus = retrieval.Corpus.build(chunks, vx.HashingEncoder(16))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")  # a task for each of 64 files
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        # 100 questions with 30 chunks each are 3,000 rows from each of 64 tasks, or of 8
        for run in (lambda: bm25.search(corpus.index, asked, 30), lambda: dense.search(corpus.vectors, asked, 30, rows=corpus.index.n)):
            got, moved = shuffled(spark, lambda: run().collect())
            assert len(got) == 3000 and moved < 1_500_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_answers_move_a_text_once(spark):
    r = random.Random(6)
    words = ["".join(chr(r.randrange(97, 123)) for _ in range(8)) for _ in range(3000)]
    text = [" ".join(r.choices(words, k=600)) for _ in range(300)]
    asked = [" ".join(r.sample(t.split(), 6)) if i < 20 else " ".join(r.choices(words, k=12)) for i, t in enumerate(text)]
    chunks = spark.createDataFrame([(f"c{i}", t) for i, t in enumerate(text)], "chunk_id string, text string")
    questions = spark.createDataFrame(list(enumerate(asked)), "qid int, question string")
    corpus = retrieval.Corpus.build(chunks, vx.HashingEncoder(64))
    got, moved = shuffled(spark, lambda: retrieval.ask(corpus, questions, an.ExtractiveGenerator(), encoder=vx.HashingEncoder(64)).collect())
    # the same by pairs of question and text
    found = retrieval.routed_retrieval(corpus, questions, vx.HashingEncoder(64)).join(chunks, "chunk_id").join(questions, "qid")
    want = {x.qid: x for x in fusion.rerank(found, 1).collect()}
    assert len(got) == 300 and all((x.top_chunk_id, x.guardrail.top1_score) == (want[x.qid].chunk_id, want[x.qid].rerank_score) for x in got)
    assert {x.qid for x in got if x.status == "answered"} >= set(range(20)) and all(len(x.sources) == 5 and text[int(x.top_chunk_id[1:])] in x.context for x in got if x.status == "answered")
    assert moved < 10_000_000  # 300 texts are 1,600,000 characters, those of 6,000 pairs 32,000,000


def test_dense_search_is_exact_where_single_precision_is_not(spark):
    r = random.Random(7)
    base = [r.gauss(0, 1) for _ in range(64)]
    size = sum(x * x for x in base) ** 0.5
    near = [[x / size * (1 - 4e-7 * (i % 50)) + r.gauss(0, 1e-8) for x in base] for i in range(3000)]
    rows = [(f"c{i}", v) for i, v in enumerate(near)] + [("nan", [float("nan")] * 64), ("none", None), ("short", [1.0])]
    index = spark.createDataFrame(rows, "chunk_id string, embedding array<double>")
    asked = spark.createDataFrame([(1, near[0]), (2, [-x for x in near[1]]), (3, [x * 1e40 for x in near[2]])], "qid int, query_vector array<double>")
    known = index.filter("chunk_id like 'c%'")
    for own, qs in ((index, "qid < 3"), (known, "qid < 3"), (known, "qid = 3")):
        got = dense.search(own, asked.filter(qs), 20, rows=3003)
        want = bm25.top(dense.scores(known, asked.filter(qs)), 20)
        key = lambda x: (x.qid, x.rank, x.chunk_id if x.qid < 3 else None, round(x.score, 6) if x.qid < 3 else None)
        assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))
