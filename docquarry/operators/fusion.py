"""Reciprocal rank fusion, soft entity routing and reranking."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docquarry.functions import text as tx
from docquarry.sources import scratch

RRF_K, FINAL_K = 60, 5
NEVER = 10**9
DIGITS = 12
#: Questions that go to a chunk's text in one row.
ASKED = 64


def best_source_rank(dense: Column, bm25: Column) -> Column:
    return F.coalesce(F.least(dense, bm25), F.lit(NEVER))


def fuse(dense: DataFrame, bm25: DataFrame, k: int = FINAL_K, rrf_k: int = RRF_K) -> DataFrame:
    """(qid, chunk_id, rank, rrf_score, dense_rank, dense_score, bm25_rank, bm25_score): the k best of each question.

    Order: fused score, best rank in a source, chunk id. Both lists are summed
    up in one aggregate instead of an outer join.
    """
    nothing = {"dense": ("bm25_rank", "bm25_score"), "bm25": ("dense_rank", "dense_score")}
    parts = []
    for name, df in (("dense", dense), ("bm25", bm25)):
        own = df.select("qid", "chunk_id", F.col("rank").alias(f"{name}_rank"), F.col("score").alias(f"{name}_score"))
        rank, score = nothing[name]
        parts.append(own.withColumn(rank, F.lit(None).cast("int")).withColumn(score, F.lit(None).cast("double")))
    both = parts[0].unionByName(parts[1]).groupBy("qid", "chunk_id")
    both = both.agg(*(F.max(c).alias(c) for c in ("dense_rank", "dense_score", "bm25_rank", "bm25_score")))
    share = lambda c: F.coalesce(1 / (rrf_k + F.col(c)), F.lit(0.0))
    both = both.withColumn("rrf_score", F.round(share("dense_rank") + share("bm25_rank"), DIGITS))
    order = Window.partitionBy("qid").orderBy(F.desc("rrf_score"), best_source_rank(F.col("dense_rank"), F.col("bm25_rank")), "chunk_id")
    both = both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return both.select("qid", "chunk_id", "rank", "rrf_score", "dense_rank", "dense_score", "bm25_rank", "bm25_score")


def hard_filter(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(qid, chunk_id) allowed by structure: article_numbers ARRAY<INT> and clause_numbers ARRAY<STRING> of each question.

    Articles that are no plain number never match; with clauses given, a chunk
    without clause does not match; articles and clauses are independent sets.
    """
    asked = questions.select("qid", F.explode("article_numbers").alias("_a"), "clause_numbers")
    numbered = chunks.select("chunk_id", F.expr("try_cast(article_number as int)").alias("_a"), F.lower(tx.strip(F.col("clause"))).alias("_c"))
    fits = (F.size("clause_numbers") == 0) | F.array_contains("clause_numbers", F.col("_c"))
    return asked.join(numbered, "_a").filter(fits).select("qid", "chunk_id").distinct()


def entity_matches(entities: DataFrame, chunks: DataFrame) -> DataFrame:
    """(entity, chunk_id): normalized chunk text contains the normalized entity.

    Entities ride in one broadcast array, and each chunk is searched once for
    all of them; entities of more than ``scratch.BROADCAST_BYTES`` together go
    in parts, one scan each.
    """
    found = None
    listed = entities.select("entity").distinct().withColumn("n", tx.normalize_lower(F.col("entity")))
    for part in scratch.in_parts(listed, "entity", F.length("entity") * 8 + 64):
        own = chunks.select("chunk_id", tx.normalize_lower(F.coalesce("text", F.lit(""))).alias("_t"))
        own = own.join(F.broadcast(part.agg(F.collect_list(F.struct("entity", "n")).alias("_e"))))
        own = own.select("chunk_id", F.explode(F.filter("_e", lambda e: F.contains(F.col("_t"), e["n"]))).alias("e")).select(F.col("e.entity").alias("entity"), "chunk_id")
        found = own if found is None else found.unionByName(own)
    return found


def soft_entities(candidates: DataFrame, questions: DataFrame, chunks: DataFrame, dense_scores: DataFrame, budget: str = "candidate_top_k") -> DataFrame:
    """Candidates with, for each entity that none of them contains, the best-scored chunk that does.

    candidates: (qid, chunk_id, rank, rrf_score, dense_*, bm25_*); questions:
    (qid, entities, candidate_top_k); dense_scores: (qid, chunk_id, score) of
    the chunks that contain an entity at least. Entities go in order, and a
    chunk added for one counts for the next. Over budget, ordinary candidates
    leave from the lowest rank on, then added ones. At most a few dozen
    candidates a question meet in one group.
    """
    listed = questions.select("qid", F.explode("entities").alias("entity"))
    matches = entity_matches(listed, chunks)
    best = listed.distinct().join(matches, "entity").join(dense_scores, ["qid", "chunk_id"])
    first = F.min_by(F.struct("chunk_id", "score"), F.struct((-F.col("score")).alias("s"), F.col("chunk_id").alias("c")))
    best = best.groupBy("qid", "entity").agg(first.alias("b"))
    best = best.groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("entity", "b"))).alias("best"))
    holds = matches.groupBy("chunk_id").agg(F.collect_set("entity").alias("holds"))
    columns = ["chunk_id", "rrf_score", "dense_rank", "dense_score", "bm25_rank", "bm25_score"]
    own = candidates.join(holds, "chunk_id", "left").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", *columns, F.coalesce("holds", F.array().cast("array<string>")).alias("holds")))).alias("c"))
    added_holds = best.select("qid", F.explode(F.map_values("best")).alias("b")).select("qid", F.col("b.chunk_id").alias("chunk_id")).distinct().join(holds, "chunk_id")
    added_holds = added_holds.groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("chunk_id", "holds"))).alias("added_holds"))
    rows = questions.select("qid", "entities", F.col(budget).alias("budget")).join(own, "qid", "left").join(best, "qid", "left").join(added_holds, "qid", "left")
    kind = candidates.schema["qid"].dataType.simpleString()
    schema = f"qid {kind}, chunk_id string, rank int, rrf_score double, dense_rank int, dense_score double, bm25_rank int, bm25_score double, routing_added boolean, routing_reason string"

    def route(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for r in pdf.itertuples(index=False):
                kept = [(dict(zip(columns, [c[k] for k in columns])), set(c["holds"]), None) for c in (r.c if r.c is not None else [])]
                best, more = dict(r.best or {}), dict(r.added_holds or {})
                for entity in r.entities if r.entities is not None else []:
                    found = best.get(entity)
                    if any(entity in holds for _, holds, _ in kept) or found is None or any(c["chunk_id"] == found["chunk_id"] for c, *_ in kept):
                        continue
                    row = dict.fromkeys(columns) | {"chunk_id": found["chunk_id"], "rrf_score": 0.0, "dense_score": found["score"]}
                    kept.append((row, set(more.get(found["chunk_id"], [])), f"soft_entity:{entity}"))
                while len(kept) > r.budget:
                    plain = [i for i, (*_, why) in enumerate(kept) if why is None]
                    kept.pop(plain[-1] if plain else -1)
                out += [(r.qid, c["chunk_id"], i, c["rrf_score"], c["dense_rank"], c["dense_score"], c["bm25_rank"], c["bm25_score"], why is not None, why) for i, (c, _, why) in enumerate(kept, 1)]
            got = pd.DataFrame(out, columns=["qid", "chunk_id", "rank", "rrf_score", "dense_rank", "dense_score", "bm25_rank", "bm25_score", "routing_added", "routing_reason"])
            yield got.astype({"dense_rank": "Int32", "bm25_rank": "Int32"})

    return rows.mapInPandas(route, schema)


class OverlapScorer:
    """Deterministic stand-in for a cross-encoder: log-odds of the share of question words that the text holds."""

    def __call__(self, questions: list[str], texts: list[str]) -> list[float]:
        out, last, has = [], None, set()
        for q, t in zip(questions, texts):
            if t is not last:  # the pairs of a text come one after the other
                last, has = t, set((t or "").lower().split()[:512])
            asked = set((q or "").lower().split())
            share = len(asked & has) / len(asked) if asked else 0.0
            out.append(round(10 * share - 5, 6))
        return out


def score_pairs(df: DataFrame, question: str = "question", text: str = "text", scorer: Callable[[list[str], list[str]], list[float]] | None = None, batch: int = 64) -> DataFrame:
    """Adds rerank_score and rerank_probability; the scorer gets batches within Arrow batches."""
    made = scorer or OverlapScorer()

    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for q, t in parts:
            got: list[float] = []
            for i in range(0, len(q), batch):
                got += list(made(q.iloc[i : i + batch].tolist(), t.iloc[i : i + batch].tolist()))
            yield pd.Series(got, index=q.index, dtype="float64")

    return df.withColumn("rerank_score", run(F.col(question), F.col(text))).withColumn("rerank_probability", tx.sigmoid(F.col("rerank_score")))


def rerank(candidates: DataFrame, k: int | None = None, question: str = "question", text: str = "text", scorer=None) -> DataFrame:
    """Candidates (qid, question, chunk_id, text, rank) by score, then chunk id; the old rank becomes pre_rerank_rank."""
    scored = score_pairs(candidates.withColumnRenamed("rank", "pre_rerank_rank"), question, text, scorer)
    order = Window.partitionBy("qid").orderBy(F.desc("rerank_score"), "chunk_id")
    ranked = scored.withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= k) if k else ranked


def rerank_by_chunk(candidates: DataFrame, questions: DataFrame, chunks: DataFrame, k: int, scorer=None, batch: int = 64) -> DataFrame:
    """(qid, chunk_id, pre_rerank_rank, rerank_score, rerank_probability, rank): the k best of ``rerank``, without texts in a ranking.

    candidates: (qid, chunk_id, rank); questions: (qid, question); chunks:
    (chunk_id, text). The questions of a chunk come to its text in lists of
    ``ASKED`` at most, so a text is moved once and never copied for each pair.
    """
    made = scorer or OverlapScorer()
    kinds = candidates.schema["qid"].dataType.simpleString(), candidates.schema["chunk_id"].dataType.simpleString()
    pairs = candidates.select("qid", "chunk_id", F.col("rank").alias("pre_rerank_rank")).join(questions.select("qid", "question"), "qid")
    pairs = pairs.withColumn("_n", F.expr(f"(row_number() over (partition by chunk_id order by qid) - 1) div {ASKED}"))
    lists = pairs.groupBy("chunk_id", "_n").agg(F.collect_list("qid").alias("qids"), F.collect_list("pre_rerank_rank").alias("ranks"), F.collect_list(F.coalesce("question", F.lit(""))).alias("questions"))
    lists = lists.join(chunks.select("chunk_id", "text"), "chunk_id").select("chunk_id", "qids", "ranks", "questions", "text")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in parts:
            asked = rows["questions"].to_pylist()
            texts = [t for t, q in zip(rows["text"].to_pylist(), asked) for _ in q]
            asked = [q for own in asked for q in own]
            got: list[float] = []
            for i in range(0, len(asked), batch):
                got += [float(x) for x in made(asked[i : i + batch], texts[i : i + batch])]
            times = pc.list_parent_indices(rows["qids"])
            yield pa.RecordBatch.from_arrays([rows["qids"].flatten(), rows["chunk_id"].take(times), rows["ranks"].flatten(), pa.array(got, pa.float64())], ["qid", "chunk_id", "pre_rerank_rank", "rerank_score"])

    scored = lists.mapInArrow(run, f"qid {kinds[0]}, chunk_id {kinds[1]}, pre_rerank_rank int, rerank_score double")
    order = Window.partitionBy("qid").orderBy(F.desc("rerank_score"), "chunk_id")
    return scored.withColumn("rerank_probability", tx.sigmoid(F.col("rerank_score"))).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
