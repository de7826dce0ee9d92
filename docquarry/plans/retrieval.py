"""Whole retrieval plans: hybrid search, routed retrieval and the batch of answers."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.functions import vectors as vx
from docquarry.operators import answer as an
from docquarry.operators import bm25, dense, fusion, router
from docquarry.sources import scratch

SOURCE_K = 20


@dataclass
class Corpus:
    """Chunks with their embedding, (chunk_id, embedding) alone, made once, and the lexical index."""

    chunks: DataFrame
    index: bm25.Index
    vectors: DataFrame

    @classmethod
    def build(cls, chunks: DataFrame, encoder=None) -> Corpus:
        if "embedding" in chunks.columns:
            return cls(chunks, bm25.build_index(chunks), chunks.select("chunk_id", "embedding"))
        embedded = vx.encode(chunks, "text", encoder)
        return cls(embedded, bm25.build_index(chunks), scratch.cut(embedded.select("chunk_id", "embedding"), "vectors"))


def hybrid_search(corpus: Corpus, questions: DataFrame, dense_k: int = SOURCE_K, bm25_k: int = SOURCE_K, k: int = fusion.FINAL_K) -> DataFrame:
    """Fused best chunks for (qid, question, query_vector)."""
    return fusion.fuse(dense.search(corpus.vectors, questions, dense_k, rows=corpus.index.n), bm25.search(corpus.index, questions, bm25_k, composed=False), k)


def timed_hybrid_search(corpus: Corpus, questions: DataFrame, encoder=None, dense_k: int = SOURCE_K, bm25_k: int = SOURCE_K, k: int = fusion.FINAL_K) -> tuple[DataFrame, dict[str, float]]:
    """Hybrid search of (qid, question) step by step, each written, and the seconds of the steps and in total."""
    took, began = {}, time.perf_counter()

    def step(name: str, df: DataFrame) -> DataFrame:
        at = time.perf_counter()
        out = scratch.cut(df, name)
        took[name] = time.perf_counter() - at
        return out

    encoded = step("encode", dense.encode_questions(questions, encoder))
    ranked = step("dense", dense.search(corpus.vectors, encoded, dense_k, rows=corpus.index.n)), step("bm25", bm25.search(corpus.index, encoded, bm25_k, composed=False))
    found = step("fusion", fusion.fuse(*ranked, k))
    return found, took | {"total": time.perf_counter() - began}


def routed_retrieval(corpus: Corpus, questions: DataFrame, encoder=None) -> DataFrame:
    """Candidates (qid, chunk_id, rank, ..., routing_added, routing_reason), at most candidate_top_k a question.

    Questions with an article search only chunks of it; the others search all,
    and those with entities get the best chunk of each missing one.
    """
    # of a route only what decides here
    routed = router.route(questions).select("qid", "question", "article_numbers", "clause_numbers", "entities", "filter_strategy", "candidate_top_k")
    routed = scratch.cut(dense.encode_questions(routed, encoder), "routed")
    ways = {r[0] for r in routed.select("filter_strategy").distinct().collect()}
    hard, rest = routed.filter("filter_strategy = 'hard'"), routed.filter("filter_strategy <> 'hard'")
    widest = router.MULTI_K
    found = fusion.fuse(dense.search(corpus.vectors, rest, widest, rows=corpus.index.n), bm25.search(corpus.index, rest, widest), widest)
    if "hard" in ways and {"article_number", "clause"} <= set(corpus.chunks.columns):
        allowed = scratch.cut(fusion.hard_filter(hard, corpus.chunks), "allowed")
        found = found.unionByName(fusion.fuse(dense.search_filtered(corpus.vectors, hard, allowed.select("qid", "chunk_id"), widest), bm25.search_filtered(corpus.index, hard, allowed, widest), widest))
    limits = routed.select("qid", "candidate_top_k")
    found = found.join(scratch.bounded(limits), "qid").filter(F.col("rank") <= F.col("candidate_top_k")).drop("candidate_top_k")
    added = {"routing_added": F.lit(False), "routing_reason": F.lit(None).cast("string")}
    if "soft" not in ways:  # no chunk is read for entities
        return found.withColumns(added)
    found = scratch.cut(found, "found")
    soft = routed.filter("filter_strategy = 'soft'")
    listed = soft.select("qid", F.explode("entities").alias("entity"))
    holding = scratch.cut(listed.join(fusion.entity_matches(listed, corpus.chunks), "entity").select("qid", "chunk_id").distinct(), "holding")
    scored = dense.scores_of(corpus.vectors, soft, holding)
    changed = fusion.soft_entities(found.join(soft.select("qid"), "qid", "left_semi"), soft, corpus.chunks, scored)
    return found.join(soft.select("qid"), "qid", "left_anti").withColumns(added).unionByName(changed)


def ask(corpus: Corpus, questions: DataFrame, generator=None, enable_generation: bool = True, encoder=None, scorer=None, threshold: float = an.THRESHOLD) -> DataFrame:
    """Answers for a batch (qid, question)."""
    candidates = routed_retrieval(corpus, questions, encoder)
    own, none = corpus.chunks, F.lit(None).cast("string")
    texts = own.select("chunk_id", "text", *(F.col(c) if c in own.columns else none.alias(c) for c in ("article_number", "clause", "page_start", "page_end")))
    asked = questions.select("qid", "question")
    ranked = scratch.cut(fusion.rerank_by_chunk(candidates, asked, texts, fusion.FINAL_K, scorer), "ranked")
    return an.answer(asked, ranked, generator, enable_generation, threshold, texts=texts)
