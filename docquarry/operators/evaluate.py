"""Retrieval quality: gold spans, interval joins, ranking metrics, ablation and suite grading."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docquarry.functions import text as tx
from docquarry.operators import chunking, structure
from docquarry.sources import io, scratch

K = 5
ARTICLE_OVERLAP = 30
SPAN_OVERLAP, SPAN_PART = 20, 0.50
METRICS = ("precision", "recall", "hit", "mrr", "ndcg", "evidence_recall")
BAND = 1e-12
DIGITS = 9
#: Offsets share a bucket of so many characters in interval joins.
BUCKET = 4096


def article_spans(pages: DataFrame) -> DataFrame:
    """(document_id, article, start, end): numbers without suffix letter, the last one of a number counts, ends at the next article."""
    w = Window.partitionBy("document_id").orderBy("at")
    pattern = r"(?U)^Điều\s+(\d+)[a-zA-Z]?\."
    size = chunking.page_ranges(pages).groupBy("document_id").agg((F.max("end") + 1).alias("size"))
    found = structure.lines_like(pages, pattern).withColumn("n", F.regexp_extract("line", pattern, 1)).join(size, "document_id")
    found = found.select("document_id", F.col("n").cast("int").alias("article"), F.col("at").alias("start"), F.coalesce(F.lead("at").over(w), F.col("size")).alias("end"))
    return found.groupBy("document_id", "article").agg(F.max_by(F.struct("start", "end"), "start").alias("s")).select("document_id", "article", "s.start", "s.end")


def chunk_spans(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """(document_id, chunk_id, start, end) in the global document, from page-local offsets; an unknown page is an error."""
    ranges = chunking.page_ranges(pages).select("document_id", "page", F.col("start").alias("_at"))
    joined = chunks.join(ranges, ["document_id", "page"], "left")
    at = F.when(F.col("_at").isNull(), F.raise_error(F.lit("chunk of an unknown page"))).otherwise(F.col("_at"))
    return joined.select("document_id", "chunk_id", (at + F.col("start_char")).alias("start"), (at + F.col("end_char")).alias("end"))


def structured_spans(chunks: DataFrame) -> DataFrame:
    return chunks.select("document_id", "chunk_id", F.col("source_start").alias("start"), F.col("source_end").alias("end"))


def overlaps(left: DataFrame, right: DataFrame, least: Column) -> DataFrame:
    """Pairs of a document's intervals that share ``least`` characters; sides have document_id, start, end.

    Intervals are keyed by document and offset bucket, so this is a hash join
    with a residual condition; a pair that shares several buckets counts once,
    in the bucket where its overlap starts.
    """
    buckets = F.explode(F.sequence(F.floor(F.col("start") / BUCKET), F.floor((F.greatest("end", F.col("start") + 1) - 1) / BUCKET)))
    a, b = (df.withColumn("_b", buckets).alias(n) for df, n in ((left, "a"), (right, "b")))
    shared = tx.overlap_size(F.col("a.start"), F.col("a.end"), F.col("b.start"), F.col("b.end"))
    once = F.floor(F.greatest("a.start", "b.start") / BUCKET) == F.col("a._b")
    met = a.join(b, (F.col("a.document_id") == F.col("b.document_id")) & (F.col("a._b") == F.col("b._b")) & once & (shared >= least))
    own = [F.col(f"a.{c}") for c in left.columns]
    return met.select(*own, *(F.col(f"b.{c}") for c in right.columns if c not in left.columns), shared.alias("overlap"))


def gold_chunks(questions: DataFrame, spans: DataFrame, chunks: DataFrame, least: int = ARTICLE_OVERLAP) -> DataFrame:
    """(question_id, chunk_id) relevant: chunks that share 30 characters with a gold article. A missing article is an error."""
    asked = questions.select("question_id", F.explode("gold_articles").alias("article")).join(spans, "article", "left")
    asked = asked.withColumn("document_id", F.when(F.col("document_id").isNull(), F.raise_error(F.concat(F.lit("missing article "), F.col("article").cast("string")))).otherwise(F.col("document_id")))
    return overlaps(asked, chunks, F.lit(least)).select("question_id", "chunk_id").distinct()


def anchor_pattern(anchor: Column) -> Column:
    """A pattern that matches the anchor's words over any white space."""
    words = F.filter(F.split(tx.strip(anchor), r"(?U)\s+"), lambda w: w != "")
    return F.concat(F.lit("(?U)"), F.array_join(F.transform(words, lambda w: F.concat(F.lit("\\Q"), w, F.lit("\\E"))), r"\s+"))


def _at_documents(documents: DataFrame, rows: DataFrame, use: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``use`` of the documents joined with ``rows`` (document_id, anchor, ...), which go to the documents in parts of bounded size: whole texts are not shuffled."""
    found = None
    for part in scratch.in_parts(rows, "document_id", F.octet_length("anchor") + 96):
        met = use(documents.join(F.broadcast(part), "document_id"))
        found = met if found is None else found.unionByName(met)
    return found


def candidate_documents(documents: DataFrame, anchors: DataFrame) -> DataFrame:
    """(document_id, *anchors) of the documents that hold the anchor's words in a row; anchors: (question_id, anchor).

    Anchors meet documents on a hash of their second to fourth word, and the
    text is compared only there; anchors of fewer than five words, which have
    no such key, are looked for in every text, sent in parts of bounded size.
    """
    split = lambda t: F.filter(F.split(t, r"(?U)\s+"), lambda w: w != "")
    w = F.col("_w")
    asked = anchors.withColumn("_w", split(F.col("anchor")))
    keyed = asked.filter(F.size("_w") >= 5).withColumn("_k", F.xxhash64(w[1], w[2], w[3])).drop("_w")
    spread = documents.select("document_id", split(F.col("full_text")).alias("_w")).filter(F.size("_w") >= 3)
    spread = spread.select("document_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("_w") - 3), lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2))))).alias("_k"))
    pairs = spread.join(scratch.bounded(keyed.select("question_id", "_k")), "_k").select("document_id", "question_id").distinct()
    pairs = scratch.cut(pairs.join(anchors, "question_id"), "pairs")
    held = _at_documents(documents, pairs, lambda met: met.filter(F.contains("full_text", F.col("anchor"))).select("document_id", *anchors.columns))
    few = asked.filter(F.size("_w") < 5).drop("_w")
    for part in scratch.in_parts(few, "question_id", F.length("anchor") * 4 + 64) if not few.isEmpty() else []:
        met = documents.join(F.broadcast(part), F.contains("full_text", F.col("anchor"))).select("document_id", *anchors.columns)
        held = held.unionByName(met)
    return held


def locate_evidence(documents: DataFrame, anchors: DataFrame, strict: bool = False) -> DataFrame:
    """(question_id, evidence_id, document_id, text, start, end, length) of anchors that match exactly once.

    documents: (document_id, full_text); anchors: (question_id, evidence_id,
    anchor, document_id), as each anchor belongs to one document. ``strict``
    makes any other number of matches an error.
    """
    n = F.col("_n")
    checked = F.when(n != 1, F.raise_error(F.concat(F.col("evidence_id"), F.lit(" matches "), n.cast("string"), F.lit(" times")))).otherwise(n) if strict else n

    def place(met: DataFrame) -> DataFrame:
        met = met.withColumn("_p", anchor_pattern(F.col("anchor"))).withColumn("_n", F.regexp_count("full_text", F.col("_p"))).withColumn("_n", checked).filter("_n = 1")
        met = met.withColumn("text", F.regexp_substr("full_text", F.col("_p"))).withColumn("start", F.regexp_instr("full_text", F.col("_p")) - 1)
        return met.select("question_id", "evidence_id", "document_id", "text", "start", (F.col("start") + F.length("text")).alias("end"), F.length("text").alias("length"))

    return _at_documents(documents, scratch.cut(anchors, "anchors"), place)


def evidence_threshold(length: Column) -> Column:
    return F.greatest(F.lit(SPAN_OVERLAP), F.ceil(F.lit(SPAN_PART) * length)).cast("int")


def evidence_chunks(evidence: DataFrame, spans: DataFrame) -> DataFrame:
    """(question_id, evidence_id, chunk_id): chunks that share max(20, half) of the unit's characters."""
    return overlaps(evidence, spans, evidence_threshold(F.col("a.length"))).select("question_id", "evidence_id", "chunk_id").distinct()


def score(retrieved: DataFrame, relevant: DataFrame, questions: DataFrame, k: int = K, evidence: DataFrame | None = None, group: str = "question_id") -> DataFrame:
    """(question_id, precision, recall, hit, mrr, ndcg, evidence_recall) at k.

    retrieved: (question_id, chunk_id, rank); relevant: (question_id, chunk_id).
    Precision divides by k even where fewer were retrieved; the reciprocal rank
    looks at the whole list; without relevant chunks all are 0.
    """
    rel = relevant.select(group, "chunk_id").distinct()
    marked = retrieved.select(group, "chunk_id", "rank").join(rel.withColumn("rel", F.lit(1)), [group, "chunk_id"], "left").fillna(0, ["rel"])
    within = (F.col("rank") <= k) & (F.col("rel") == 1)
    got = marked.groupBy(group).agg(F.count_if(within).alias("hits"), F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"), F.sum(F.when(within, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"))
    n = rel.groupBy(group).agg(F.count("*").alias("n_rel"))
    base = questions.select(group).distinct().join(got, group, "left").join(n, group, "left").fillna(0, ["hits", "n_rel"]).fillna(0.0, ["dcg"])
    ideal = F.aggregate(F.when(F.col("n_rel") > 0, F.sequence(F.lit(1), F.least(F.col("n_rel"), F.lit(k)).cast("int"))).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    out = base.select(
        group, (F.col("hits") / F.lit(k)).alias("precision"), F.when(F.col("n_rel") > 0, F.col("hits") / F.col("n_rel")).otherwise(0.0).alias("recall"), (F.col("hits") > 0).cast("double").alias("hit"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"), F.when(F.col("n_rel") > 0, F.round(F.col("dcg") / ideal, DIGITS)).otherwise(0.0).alias("ndcg"),
    )
    if evidence is None:
        return out
    covered = evidence.join(retrieved.filter(F.col("rank") <= k).select(group, "chunk_id"), [group, "chunk_id"], "left_semi").groupBy(group).agg(F.count_distinct("evidence_id").alias("covered"))
    units = evidence.groupBy(group).agg(F.count_distinct("evidence_id").alias("units"))
    share = F.coalesce(F.col("covered") / F.col("units"), F.lit(0.0))
    return out.join(units, group, "left").join(covered, group, "left").withColumn("evidence_recall", share).drop("units", "covered")


def hit_details(retrieved: DataFrame, evidence: DataFrame, k: int = K) -> DataFrame:
    """(question_id, hits): for each retrieved chunk its rank and the evidence ids it covers, as an array."""
    own = evidence.groupBy("question_id", "chunk_id").agg(F.array_sort(F.collect_set("evidence_id")).alias("covers"))
    met = retrieved.filter(F.col("rank") <= k).join(own, ["question_id", "chunk_id"], "left").withColumn("covers", F.coalesce("covers", F.array().cast("array<string>")))
    return met.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "covers"))).alias("hits"))


def mean_metrics(rows: DataFrame, *group: str) -> DataFrame:
    """Macro means; 0 for no rows."""
    return rows.groupBy(*group).agg(*(F.round(F.coalesce(F.avg(m), F.lit(0.0)), DIGITS).alias(m) for m in METRICS if m in rows.columns))


def latency_summary(rows: DataFrame, column: str) -> DataFrame:
    """Mean and interpolated 50th and 95th percentiles."""
    return rows.agg(F.avg(column).alias("mean"), F.percentile(column, 0.5).alias("p50"), F.percentile(column, 0.95).alias("p95"))


def deltas(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: metric means of b less those of a."""
    names = [m for m in METRICS if m in a.columns and m in b.columns]
    both = mean_metrics(a).select(*(F.col(m).alias(f"a_{m}") for m in names)).join(F.broadcast(mean_metrics(b)))
    return both.select(*((F.col(m) - F.col(f"a_{m}")).alias(m) for m in names))


def win_tie_loss(a: DataFrame, b: DataFrame, key: str = "question_id") -> DataFrame:
    """(metric, wins, ties, losses) of b against a, question by question, with a band of 1e-12."""
    names = [m for m in METRICS if m in a.columns and m in b.columns]
    stacked = lambda df, n: df.select(key, F.explode(F.create_map(*(x for m in names for x in (F.lit(m), F.col(m).cast("double"))))).alias("metric", n))
    both = stacked(a, "va").join(stacked(b, "vb"), [key, "metric"])
    d = F.col("vb") - F.col("va")
    return both.groupBy("metric").agg(F.count_if(d > BAND).alias("wins"), F.count_if(F.abs(d) <= BAND).alias("ties"), F.count_if(d < -BAND).alias("losses"))


def failures(rows: DataFrame) -> DataFrame:
    """Questions without full evidence recall at the first rank."""
    return rows.filter(~((F.col("evidence_recall") >= 1) & (F.col("mrr") >= 1)))


def _table(rows: DataFrame, columns: dict[str, Column], order: str) -> DataFrame:
    """One row with ``t``, a markdown table of the named columns, by ``order``."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *columns.values()), F.lit(" |"))
    made = rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))), lambda x: x["l"]), "\n").alias("t"))
    return made.select(F.concat(F.lit("| " + " | ".join(columns) + " |\n|" + "---|" * len(columns) + "\n"), F.col("t")).alias("t"))


def markdown_report(means: DataFrame, label: str, a: DataFrame | None = None, b: DataFrame | None = None) -> DataFrame:
    """One row of text: metric means by ``label`` and, for the per-question rows of two systems, deltas, wins, ties and losses of b, and each question."""
    shown = lambda m: F.format_string("%.4f", F.col(m))
    names = [m for m in METRICS if m in means.columns]
    parts = [("Means", _table(means, {label: F.col(label)} | {m: shown(m) for m in names}, label))]
    if a is not None:
        stack = F.explode(F.create_map(*(x for m in names for x in (F.lit(m), F.col(m))))).alias("metric", "delta")
        parts.append(("Deltas", _table(deltas(a, b).select(stack), {"metric": F.col("metric"), "delta": F.format_string("%+.4f", F.col("delta"))}, "metric")))
        parts.append(("Wins, ties and losses", _table(win_tie_loss(a, b), {c: F.col(c).cast("string") for c in ("metric", "wins", "ties", "losses")}, "metric")))
        both = a.select("question_id", *(F.col(m).alias(f"a_{m}") for m in names)).join(b, "question_id")
        parts.append(("Questions", _table(both, {"question": F.col("question_id").cast("string")} | {m: F.concat_ws(" / ", shown(f"a_{m}"), shown(m)) for m in names}, "question_id")))
    out = None
    for title, table in parts:
        made = table.select(F.concat(F.lit(f"## {title}\n\n"), F.col("t")).alias(f"t{title}"))
        out = made if out is None else out.join(F.broadcast(made))  # one row each
    return out.select(F.concat_ws("\n\n", *(F.col(f"`t{title}`") for title, _ in parts)).alias("report"))


def write_outputs(per_question: DataFrame, summary: DataFrame, path: str, report: DataFrame | None = None) -> None:
    """Per-question rows and summary as JSON lines, and the report as text, under one folder."""
    io.write_jsonl(per_question, f"{path}/per_question")
    io.write_jsonl(summary, f"{path}/summary")
    if report is not None:
        io.write_text(report, "report", f"{path}/report")


def article_benchmark(pages: DataFrame, chunks: DataFrame, retrieved: DataFrame, questions: DataFrame, k: int = K) -> DataFrame:
    """Metrics of (question_id, chunk_id, rank) against gold articles: questions (question_id, gold_articles), fixed windows over pages."""
    gold = gold_chunks(questions, article_spans(pages), chunk_spans(chunks, pages))
    return score(retrieved, gold, questions, k)


def ablation(systems: dict[str, tuple[DataFrame, DataFrame]], evidence: DataFrame, search: Callable[[DataFrame], DataFrame], questions: DataFrame, k: int = K) -> dict[str, DataFrame]:
    """Per-question metrics of each system, the same questions and evidence against its own chunks.

    systems: name to (chunks, their spans in the document); ``search`` gives
    (question_id, chunk_id, rank) over chunks.
    """
    out = {}
    for name, (chunks, spans) in systems.items():
        mapped = evidence_chunks(evidence, spans)
        out[name] = score(search(chunks), mapped.select("question_id", "chunk_id"), questions, k, mapped)
    return out


def grade_cases(cases: DataFrame, results: DataFrame) -> DataFrame:
    """(id, status_ok, citation_ok, article_ok, bypass_ok, passed): DEMO_CASES against answers (qid = id) with attempts and sources."""
    own = cases.join(results.withColumnRenamed("qid", "id").drop("question"), "id", "left")
    answered, abstained = F.col("expected_status") == "answered", F.col("expected_status") == "abstain"
    numbers = F.transform(F.coalesce("sources", F.array()), lambda s: s["article_number"].cast("string"))
    checks = {
        "status_ok": F.coalesce(F.col("status") == F.col("expected_status"), F.lit(False)),
        "citation_ok": F.when(answered, F.coalesce(F.col("citation_validation.valid"), F.lit(False))),
        "article_ok": F.when(answered & F.col("expected_article").isNotNull(), F.coalesce(F.array_contains(numbers, F.col("expected_article")), F.lit(False))),
        "bypass_ok": F.when(abstained, F.coalesce(F.col("attempts"), F.lit(0)) == 0),
    }
    found = own.withColumns(checks)
    passed = F.forall(F.filter(F.array(*checks), lambda x: x.isNotNull()), lambda x: x)
    return found.select("id", "expected_status", F.col("status").alias("actual_status"), *checks, passed.alias("passed"))


def summarize_cases(graded: DataFrame) -> DataFrame:
    """Rates over the cases that each check applies to (null without any) and the ids that failed."""
    rate = lambda c: F.avg(F.col(c).cast("int"))
    return graded.agg(
        F.count("*").alias("n"), F.count_if("passed").alias("n_passed"), rate("passed").alias("pass_rate"), rate("status_ok").alias("status_rate"), rate("citation_ok").alias("citation_rate"),
        rate("article_ok").alias("article_rate"), rate("bypass_ok").alias("bypass_rate"), F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("id")))).alias("failed_ids"),
    )
