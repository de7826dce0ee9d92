"""All registered queries of the engine's own operators on the test tables, and their SQL counterparts.

Documents play the role of pages (one page a document, or all pages of a
source), benchmark items that of questions and evidence anchors, embeddings
that of a dense index, conversations that of question batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions import text as tx
from docquarry.functions import vectors as vx
from docquarry.operators import answer as an
from docquarry.operators import bm25, chunking, dense, evaluate, fusion, quality, router
from docquarry.plans import retrieval
from docquarry.sources import io, scratch
from docquarry.sources.session import ship

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name, with its SQL."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pages(spark, sf_dir) -> DataFrame:
    """One page a document."""
    return _t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.lit(1).alias("page"), F.coalesce("text", F.lit("")).alias("text"))


def _source_pages(spark, sf_dir) -> DataFrame:
    """The documents of a source as the pages of one document."""
    return _t(spark, sf_dir, "documents").select(F.col("source").alias("document_id"), F.col("doc_id").cast("int").alias("page"), F.coalesce("text", F.lit("")).alias("text"))


def _docs(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), "text")


def _questions(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


def _vectors(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), "embedding", "label", "vec_id")


def _vector_questions(spark, sf_dir) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 100."""
    return _vectors(spark, sf_dir).filter("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query_vector"), F.col("label").alias("qlabel"))


def _longs(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(c).cast("long").alias(c) if t in ("int", "smallint") else F.col(c) for c, t in df.dtypes))


# ---- fixed values shared by the SQL below -----------------------------------

_WINDOWS = """
pieces as (
  select doc_id, s, least(s + 512, length(text)) as e, substr(text, s + 1, 512) as piece
  from (select doc_id, coalesce(text, '') as text, unnest(range(0, greatest(0, ceil((length(coalesce(text, '')) - 512) / 462.0))::int * 462 + 1, 462))::int as s from documents where length(coalesce(text, '')) > 0)),
chunks as (
  select doc_id::varchar as document_id, row_number() over (partition by doc_id order by s) as chunk_index, s::bigint as start_char, e::bigint as end_char, length(piece)::bigint as char_count, piece as text
  from pieces where trim(piece, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''),
named as (select printf('%s_p001_c%03d', document_id, chunk_index) as chunk_id, * from chunks)"""

_TOKENS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"
_POSTINGS = f"""
listed as (select doc_id::varchar as chunk_id, {_TOKENS.format("coalesce(text, '')")} as t from documents),
sizes as (select chunk_id, len(t) as dl from listed),
totals as (select count(*)::double as n, avg(dl) as average from sizes),
postings as (select chunk_id, term, count(*) as tf from (select chunk_id, unnest(t) as term from listed) group by all),
terms as (select term, count(*) as df from postings group by term),
asked as (select qid, term, count(*) as qtf from (select item_id as qid, unnest({_TOKENS.format("text")}) as term from benchmark) group by all),
scored as (
  select qid, chunk_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / average)))), 6) as score
  from asked join terms using (term) join postings using (term) join sizes using (chunk_id), totals group by qid, chunk_id having score > 0)"""

_DENSE = """
q as (select vec_id as qid, embedding as v, label as qlabel from embeddings where vec_id % 100 = 0),
pairs as (select qid, qlabel, vec_id::varchar as chunk_id, label, round(list_dot_product(list_transform(v, lambda x: x::double), list_transform(embedding, lambda x: x::double)), 6) as score from q, embeddings)"""


def _ranked(source: str, k: int, where: str = "true") -> str:
    return f"select * from (select qid, chunk_id, score, row_number() over (partition by qid order by score desc, chunk_id) as rank from {source} where {where}) where rank <= {k}"


# ---- text -------------------------------------------------------------------

@query(r"""select doc_id, md5(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))) as normal, md5(lower(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')))) as lower_normal from documents""")
def normalized_text(spark, sf_dir):
    t = F.coalesce("text", F.lit(""))
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(tx.normalize_text(t).cast("binary")).alias("normal"), F.md5(tx.normalize_lower(t).cast("binary")).alias("lower_normal"))


@query(f"select doc_id, len({_TOKENS.format('text')})::bigint as n_tokens, len(list_distinct({_TOKENS.format('text')}))::bigint as n_distinct from documents")
def token_counts(spark, sf_dir):
    t = tx.tokens(F.col("text"))
    return _longs(_t(spark, sf_dir, "documents").select("doc_id", F.size(t).alias("n_tokens"), F.size(F.array_distinct(t)).alias("n_distinct")))


@query(r"""
with l as (select doc_id, unnest(string_split(text, chr(10))) as line from documents)
select doc_id, count(*) filter (where regexp_matches(trim(line), '^(Chương\s+[IVXLCDM]+|Điều\s+\d+[a-zA-Z]?\.|\d+\.|[a-zA-Zđ]\))'))::bigint as n_structure,
       count(*) filter (where trim(line) = upper(trim(line)) and trim(line) <> lower(trim(line)) and length(trim(line)) < 150)::bigint as n_heading
from l group by doc_id""")
def line_kinds(spark, sf_dir):
    """Structure and heading lines of each document."""
    lines = _t(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count_if(tx.is_structure_line(F.col("line"))).alias("n_structure"), F.count_if(tx.is_heading_line(F.col("line"))).alias("n_heading"))


@query("select doc_id, sha256(coalesce(text, '')) as sha256, length(coalesce(text, ''))::bigint as n from documents")
def text_hashes(spark, sf_dir):
    t = F.coalesce("text", F.lit(""))
    return _t(spark, sf_dir, "documents").select("doc_id", F.sha2(t, 256).alias("sha256"), F.length(t).cast("long").alias("n"))


@query(r"""
with a as (select conv_id, turn, text || ' [S' || (turn % 4) || '][s0' || (turn % 7) || ']' as answer from conversations),
c as (select conv_id, turn, list_distinct(list_transform(regexp_extract_all(answer, '(?i)\[S(\d+)\]', 1), lambda x: 'S' || x::bigint)) as cited from a)
select conv_id, turn, len(cited)::bigint as n_cited, case when len(list_filter(cited, lambda x: x not in ('S1', 'S2', 'S3'))) > 0 then 'invalid_source_reference' when len(cited) = 0 then 'missing_required_citation' else 'citation_integrity_pass' end as reason from c""")
def citation_validation(spark, sf_dir):
    """Citations of answers made from conversation turns, against three allowed sources."""
    turn = F.col("turn")
    made = _t(spark, sf_dir, "conversations").withColumn("answer", F.concat("text", F.lit(" [S"), (turn % 4).cast("string"), F.lit("][s0"), (turn % 7).cast("string"), F.lit("]")))
    v = an.validate_citations(F.col("answer"), F.array(*(F.lit(f"S{i}") for i in (1, 2, 3))))
    return made.select("conv_id", "turn", F.size(v["cited_source_ids"]).cast("long").alias("n_cited"), v["reason"].alias("reason"))


# ---- chunking ---------------------------------------------------------------

@query(f"with {_WINDOWS} select chunk_id, document_id, 1::bigint as page, chunk_index, start_char, end_char, char_count, text from named")
def fixed_chunks(spark, sf_dir):
    return _longs(chunking.fixed_chunks(_pages(spark, sf_dir)))


@query("select doc_id, case when length(text) <= 0 then 0 when length(text) <= 512 then 1 else 1 + ceil((length(text) - 512) / 462.0) end::bigint as n_chunks from documents")
def chunk_counts(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", tx.expected_chunk_count(F.length("text")).cast("long").alias("n_chunks"))


@query(f"with {_WINDOWS} select count(*)::bigint as n_chunks, count(distinct document_id)::bigint as n_pages, min(char_count) as min_chars, max(char_count) as max_chars, round(avg(char_count), 6) as avg_chars from named")
def chunk_stats(spark, sf_dir):
    return _longs(quality.fixed_statistics(chunking.fixed_chunks(_pages(spark, sf_dir))))


_RANGES = """
ranges as (select source as document_id, doc_id::int as page, coalesce(sum(length(text) + 1) over (partition by source order by doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as start, length(text) as size from documents)"""


@query(f"with {_RANGES} select document_id, page::bigint as page, start, start + size as \"end\" from ranges")
def page_ranges(spark, sf_dir):
    return _longs(chunking.page_ranges(_source_pages(spark, sf_dir)))


@query("select source as document_id, length(string_agg(text || chr(10), '' order by doc_id))::bigint as size, md5(string_agg(text || chr(10), '' order by doc_id)) as hash from documents group by source")
def global_documents(spark, sf_dir):
    return chunking.global_documents(_source_pages(spark, sf_dir)).select("document_id", F.length("full_text").cast("long").alias("size"), F.md5(F.col("full_text").cast("binary")).alias("hash"))


@query(f"""with {_RANGES}, asks as (select document_id, page::bigint as asked, start + size as position from ranges union all select document_id, page::bigint, start + size // 2 from ranges)
select asks.document_id, asked, position, ranges.page::bigint as page from asks asof join ranges on asks.document_id = ranges.document_id and asks.position >= ranges.start""")
def position_to_page(spark, sf_dir):
    """As-of join of separators and page middles to pages."""
    ranges = chunking.page_ranges(_source_pages(spark, sf_dir))
    asks = ranges.select("document_id", F.col("page").alias("asked"), F.explode(F.array(F.col("end").cast("long"), F.col("start") + F.expr("(`end` - start) div 2"))).alias("position"))
    return _longs(chunking.position_to_page(asks, ranges))


@query(f"""with {_WINDOWS}, pages as (select doc_id::varchar as document_id, text as source from documents), joined as (select * from named join pages using (document_id)),
findings as (
  select 'warning' as severity, 'short_chunk' as type from joined where char_count < 100
  union all select 'warning', 'starts_inside_word' from joined where start_char > 0 and regexp_full_match(substr(source, start_char, 1), '[\\p{{L}}\\p{{N}}]') and regexp_full_match(substr(source, start_char + 1, 1), '[\\p{{L}}\\p{{N}}]')
  union all select 'warning', 'ends_inside_word' from joined where end_char < length(source) and regexp_full_match(substr(source, end_char, 1), '[\\p{{L}}\\p{{N}}]') and regexp_full_match(substr(source, end_char + 1, 1), '[\\p{{L}}\\p{{N}}]')
  union all select 'warning', 'control_characters' from joined where regexp_matches(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]')
  union all select 'warning', 'duplicate_chunk_text' from (select text from named group by text having count(*) > 1)
  union all select 'error', 'page_without_chunks' from pages where document_id not in (select document_id from named))
select severity, type, count(*)::bigint as n from findings group by all""")
def fixed_findings(spark, sf_dir):
    """The full check of the fixed windows, counted by type."""
    pages = _pages(spark, sf_dir)
    return quality.counts_by_type(quality.check_fixed(pages, chunking.fixed_chunks(pages)))


@query(f"with {_WINDOWS} select max(text) as text, count(*)::bigint as n from named group by text having count(*) > 1")
def duplicate_text(spark, sf_dir):
    return chunking.fixed_chunks(_pages(spark, sf_dir)).groupBy("text").agg(F.count("*").alias("n")).filter("n > 1")


# ---- search -----------------------------------------------------------------

@query(f"with {_POSTINGS} select term, df::bigint as df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 9) as idf from terms, totals")
def bm25_terms(spark, sf_dir):
    index = bm25.build_index(_docs(spark, sf_dir))
    return index.terms.select("term", "df", F.round(bm25.idf(F.col("df"), index.n), 9).alias("idf"))


@query(f"with {_POSTINGS}, ranked as ({_ranked('scored', 20)}) select qid, chunk_id, score, rank::bigint as rank from ranked")
def bm25_topk(spark, sf_dir):
    """The best 20 documents for every benchmark passage."""
    return _longs(bm25.search(bm25.build_index(_docs(spark, sf_dir)), _questions(spark, sf_dir)).select("qid", "chunk_id", "score", "rank"))


@query(f"with {_POSTINGS}, ranked as ({_ranked('scored', 20, 'chunk_id in (select doc_id::varchar from labels where quality = 1)')}) select qid, chunk_id, score, rank::bigint as rank from ranked")
def bm25_filtered(spark, sf_dir):
    """Among documents labelled good, with the statistics of all."""
    good = _t(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").cast("string").alias("chunk_id")).distinct()
    scored = bm25.scores(bm25.build_index(_docs(spark, sf_dir)), _questions(spark, sf_dir)).join(good, "chunk_id", "left_semi")
    return _longs(bm25.top(scored, 20).select("qid", "chunk_id", "score", "rank"))


@query(f"with {_DENSE}, ranked as ({_ranked('pairs', 20)}) select qid, chunk_id, score, rank::bigint as rank from ranked")
def dense_topk(spark, sf_dir):
    return _longs(dense.search(_vectors(spark, sf_dir), _vector_questions(spark, sf_dir)).select("qid", "chunk_id", "score", "rank"))


@query(f"with {_DENSE}, ranked as ({_ranked('pairs', 20, 'label = qlabel')}) select qid, chunk_id, score, rank::bigint as rank from ranked")
def dense_filtered(spark, sf_dir):
    """Among vectors of the query's label only."""
    index, q = _vectors(spark, sf_dir), _vector_questions(spark, sf_dir)
    allowed = index.select("chunk_id", F.col("label").alias("qlabel")).join(scratch.bounded(q.select("qid", "qlabel")), "qlabel").select("qid", "chunk_id")
    return _longs(dense.search_filtered(index.drop("label"), q, allowed).select("qid", "chunk_id", "score", "rank"))


@query(f"""with {_POSTINGS}, {_DENSE}, b as ({_ranked('scored', 20)}), dn as ({_ranked('(select qid // 100 as qid, chunk_id, score from pairs) x', 20)}),
both_ as (select coalesce(dn.qid, b.qid) as qid, coalesce(dn.chunk_id, b.chunk_id) as chunk_id, dn.rank as dense_rank, dn.score as dense_score, b.rank as bm25_rank, b.score as bm25_score from dn full join b on dn.qid = b.qid and dn.chunk_id = b.chunk_id),
s as (select *, round(coalesce(1 / (60 + dense_rank), 0) + coalesce(1 / (60 + bm25_rank), 0), 12) as rrf_score from both_),
r as (select *, row_number() over (partition by qid order by rrf_score desc, coalesce(least(dense_rank, bm25_rank), 1000000000), chunk_id) as rank from s)
select qid, chunk_id, rank::bigint as rank, rrf_score, dense_rank::bigint as dense_rank, dense_score, bm25_rank::bigint as bm25_rank, bm25_score from r where rank <= 5""")
def rrf_fusion(spark, sf_dir):
    """Dense list of vector 100 i and lexical list of benchmark item i, fused."""
    d = dense.search(_vectors(spark, sf_dir), _vector_questions(spark, sf_dir)).withColumn("qid", F.expr("qid div 100"))
    return _longs(fusion.fuse(d, bm25.search(bm25.build_index(_docs(spark, sf_dir)), _questions(spark, sf_dir))))


@query("""with c as (select doc_id::varchar as chunk_id, doc_id % 50 as article, doc_id % 10 = 9 as lettered, case when doc_id % 3 = 0 then null else (doc_id % 4)::varchar end as clause from documents)
select item_id as qid, chunk_id from benchmark join c on article in (item_id % 50, (item_id + 7) % 50) and not lettered where item_id % 2 = 0 or clause in ('1', '2')""")
def hard_filter(spark, sf_dir):
    """Two articles and, for odd items, two clauses; articles with a letter and chunks without clause drop out."""
    i = F.col("doc_id")
    number = F.concat((i % 50).cast("string"), F.when(i % 10 == 9, "a").otherwise(""))
    chunks = _t(spark, sf_dir, "documents").select(i.cast("string").alias("chunk_id"), number.alias("article_number"), F.when(i % 3 != 0, (i % 4).cast("string")).alias("clause"))
    q = F.col("item_id")
    clauses = F.when(q % 2 == 1, F.array(F.lit("1"), F.lit("2"))).otherwise(F.array().cast("array<string>"))
    asked = _t(spark, sf_dir, "benchmark").select(q.alias("qid"), F.array((q % 50).cast("int"), ((q + 7) % 50).cast("int")).alias("article_numbers"), clauses.alias("clause_numbers"))
    return fusion.hard_filter(asked, chunks)


@query("""with e as (select distinct string_split(text, ' ')[1] as entity from benchmark)
select entity, doc_id::varchar as chunk_id from e join documents on contains(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), lower(entity))""")
def entity_matches(spark, sf_dir):
    """First words of benchmark items as entities."""
    names = _t(spark, sf_dir, "benchmark").select(F.split("text", " ")[0].alias("entity"))
    return fusion.entity_matches(names, _docs(spark, sf_dir))


@query("""select count(*)::bigint as n_rows, count(*) filter (where len(embedding) <> 64)::bigint as n_wrong_dimension,
       round(min(sqrt(list_dot_product(embedding::double[], embedding::double[]))), 6) as min_norm, round(max(sqrt(list_dot_product(embedding::double[], embedding::double[]))), 6) as max_norm,
       bool_and(len(embedding) = 64 and abs(sqrt(list_dot_product(embedding::double[], embedding::double[])) - 1) <= 1.01e-3) as ok from embeddings""")
def vector_check(spark, sf_dir):
    got = vx.check_embeddings(_t(spark, sf_dir, "embeddings"), dimension=64)
    return got.select("n_rows", "n_wrong_dimension", F.round("min_norm", 6).alias("min_norm"), F.round("max_norm", 6).alias("max_norm"), "ok")


@query("select vec_id::varchar as chunk_id, row_number() over (order by vec_id::varchar) - 1 as vector_index from embeddings")
def vector_index(spark, sf_dir):
    return io.with_vector_index(_vectors(spark, sf_dir).select("chunk_id")).select("chunk_id", "vector_index")


@query()
def routed_answers(spark, sf_dir):
    """All user turns as questions over all documents, with stand-in models."""
    questions = _t(spark, sf_dir, "conversations").filter("role = 'user' and trim(text) <> ''").select(F.concat_ws("/", "conv_id", "turn").alias("qid"), F.col("text").alias("question"))
    encoder = vx.HashingEncoder(64)
    corpus = retrieval.Corpus.build(_docs(spark, sf_dir), encoder)
    return retrieval.ask(corpus, questions, an.ExtractiveGenerator(), encoder=encoder).select("qid", "status", "answer", "top_chunk_id", F.col("guardrail.top1_score").alias("score"))


# ---- routing ----------------------------------------------------------------

@query(f"""with s as (select doc_id, 2 * (length(t) - length(regexp_replace(t, '[{router.VIETNAMESE_CHARACTERS}]', '', 'g'))) + len(list_filter({_TOKENS.format("t")}, lambda w: w in {router.VIETNAMESE_WORDS!r})) as vi,
  len(list_filter({_TOKENS.format("t")}, lambda w: w in {router.ENGLISH_WORDS!r})) as en from (select doc_id, lower(text) as t from documents))
select doc_id, case when vi >= 2 then 'vi' when en >= 2 then 'en' else 'unknown' end as language, case when vi >= 2 then round(least(1.0, 0.70 + vi / 20), 4) when en >= 2 then round(least(1.0, 0.65 + en / 20), 4) else 0.5 end::double as confidence from s""")
def language_detect(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", router.detect_language(F.col("text")).alias("l")).select("doc_id", "l.language", "l.confidence")


# ---- guardrail and context --------------------------------------------------

@query("""select case when value is null then 'no_retrieval_results' when value / 100 >= 0.7690 then 'sufficient_reranker_evidence' else 'insufficient_reranker_evidence' end as reason,
       case when value / 100 >= 0.7690 then 'answer' else 'abstain' end as action, count(*)::bigint as n from events group by all""")
def guardrail_decisions(spark, sf_dir):
    d = an.decide_score(F.col("value") / 100)
    return _t(spark, sf_dir, "events").select(d.alias("d")).groupBy("d.reason", "d.action").agg(F.count("*").alias("n"))


@query(f"""with {_POSTINGS}, r as ({_ranked('scored', 5)}), b as (
  select qid, rank, '[S' || rank || ']' || chr(10) || 'Điều: None' || chr(10) || 'Khoản: None' || chr(10) || 'Trang: 1-1' || chr(10) || 'Chunk ID: ' || r.chunk_id || chr(10) || 'Nội dung:' || chr(10) || trim(d.text, chr(32) || chr(9) || chr(10) || chr(13)) as block
  from r join documents d on d.doc_id::varchar = r.chunk_id)
select qid, count(*)::bigint as n_sources, md5(string_agg(block, chr(10) || chr(10) || repeat('=', 30) || chr(10) || chr(10) order by rank)) as context from b group by qid""")
def labelled_context(spark, sf_dir):
    ranked = bm25.search(bm25.build_index(_docs(spark, sf_dir)), _questions(spark, sf_dir), 5).join(_docs(spark, sf_dir), "chunk_id")
    none = F.lit(None).cast("string")
    ranked = ranked.withColumns({"article_number": none, "clause": none, "page_start": F.lit(1), "page_end": F.lit(1), "rerank_score": F.col("score")})
    return an.build_context(ranked).select("qid", F.size("sources").cast("long").alias("n_sources"), F.md5(F.col("context").cast("binary")).alias("context"))


# ---- evaluation -------------------------------------------------------------

_EVIDENCE = """
evidence as (
  select item_id as question_id, item_id || '_' || doc_id as evidence_id, doc_id::varchar as document_id, strpos(d.text, b.text) - 1 as start, strpos(d.text, b.text) - 1 + length(b.text) as "end", length(b.text) as length
  from benchmark b join documents d on contains(d.text, b.text) where length(d.text) - length(replace(d.text, b.text, '')) = length(b.text))"""


def _evidence(spark, sf_dir) -> DataFrame:
    """Benchmark items located in the documents that hold them, written."""
    docs = _t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.col("text").alias("full_text"))
    items = _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("anchor"))
    met = evaluate.candidate_documents(docs, items).withColumn("evidence_id", F.concat_ws("_", "question_id", "document_id"))
    return scratch.cut(evaluate.locate_evidence(docs, met), "evidence")


@query(f"with {_EVIDENCE} select question_id, evidence_id, document_id, start::bigint as start, \"end\"::bigint as \"end\", length::bigint as length from evidence")
def evidence_located(spark, sf_dir):
    return _longs(_evidence(spark, sf_dir).drop("text"))


_EVIDENCE_CHUNKS = f"""{_WINDOWS}, {_EVIDENCE},
mapped as (select distinct question_id, evidence_id, chunk_id from evidence e join named c on e.document_id = c.document_id and least(e."end", c.end_char) - greatest(e.start, c.start_char) >= greatest(20, ceil(0.5 * e.length)))"""


def _mapped(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(question_id, evidence_id, chunk_id), written, and the chunks, which are cheap to cut again."""
    pages = _pages(spark, sf_dir)
    chunks = chunking.fixed_chunks(pages)
    spans = evaluate.chunk_spans(chunks, pages)
    return scratch.cut(evaluate.evidence_chunks(_evidence(spark, sf_dir), spans), "mapped"), chunks


@query(f"with {_EVIDENCE_CHUNKS} select * from mapped")
def evidence_chunks(spark, sf_dir):
    """Interval join of evidence and chunks."""
    return _mapped(spark, sf_dir)[0]


_METRICS = """
marked as (select question_id, chunk_id, rank, rel.chunk_id is not null as hit from {retrieved} r left join {relevant} rel using (question_id, chunk_id)),
per as (select question_id, count(*) filter (where hit and rank <= 5) as hits, min(rank) filter (where hit) as first, coalesce(sum(1 / log2(rank + 1)) filter (where hit and rank <= 5), 0) as dcg from marked group by 1),
n as (select question_id, count(*) as n_rel from {relevant} group by 1),
metrics as (select q.question_id, coalesce(hits, 0) / 5 as precision, case when n_rel > 0 then coalesce(hits, 0) / n_rel else 0 end::double as recall, (coalesce(hits, 0) > 0)::int::double as hit, coalesce(1 / first, 0)::double as mrr,
  case when n_rel > 0 then round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n_rel, 5) + 1), lambda i: 1 / log2(i + 1))), 9) else 0 end::double as ndcg from {questions} q left join per using (question_id) left join n using (question_id))"""


@query(f"""with {_DENSE}, found as (select qid as question_id, chunk_id, rank from ({_ranked('pairs', 20)})), rel as (select qid as question_id, vec_id::varchar as chunk_id from q join embeddings on label = qlabel), asked as (select qid as question_id from q), {_METRICS.format(retrieved="found", relevant="rel", questions="asked")}
select * from metrics""")
def retrieval_metrics(spark, sf_dir):
    """Metrics at 5 of the dense search, with the query's label as relevance."""
    index, q = _vectors(spark, sf_dir), _vector_questions(spark, sf_dir)
    found = dense.search(index, q).withColumnRenamed("qid", "question_id")
    rel = index.join(scratch.bounded(q.select("qid", "qlabel")), F.col("label") == F.col("qlabel")).select(F.col("qid").alias("question_id"), "chunk_id")
    return evaluate.score(found, rel, q.select(F.col("qid").alias("question_id")))


def _halved(spark, sf_dir):
    """Metrics of the whole vectors and of their first half."""
    index, q = _vectors(spark, sf_dir), _vector_questions(spark, sf_dir)
    rel = index.join(scratch.bounded(q.select("qid", "qlabel")), F.col("label") == F.col("qlabel")).select(F.col("qid").alias("question_id"), "chunk_id")
    asked = q.select(F.col("qid").alias("question_id"))
    half = dense.search(index.withColumn("embedding", F.slice("embedding", 1, 32)), q.withColumn("query_vector", F.slice("query_vector", 1, 32)))
    whole = dense.search(index, q)
    return tuple(evaluate.score(f.withColumnRenamed("qid", "question_id"), rel, asked) for f in (half, whole))


@query(f"""with {_DENSE}, halves as (select qid, vec_id::varchar as chunk_id, round(list_dot_product(list_transform(v[:32], lambda x: x::double), list_transform(embedding[:32], lambda x: x::double)), 6) as score from q, embeddings),
rel as (select qid as question_id, vec_id::varchar as chunk_id from q join embeddings on label = qlabel), asked as (select qid as question_id from q),
w as (with found as (select qid as question_id, chunk_id, rank from ({_ranked('pairs', 20)})), {_METRICS.format(retrieved="found", relevant="rel", questions="asked")} select * from metrics),
h as (with found as (select qid as question_id, chunk_id, rank from ({_ranked('halves', 20)})), {_METRICS.format(retrieved="found", relevant="rel", questions="asked")} select * from metrics),
d as (unpivot (select w.precision - h.precision as precision, w.recall - h.recall as recall, w.hit - h.hit as hit, w.mrr - h.mrr as mrr, w.ndcg - h.ndcg as ndcg from w join h using (question_id)) on precision, recall, hit, mrr, ndcg into name metric value d)
select metric, count(*) filter (where d > 1e-12)::bigint as wins, count(*) filter (where abs(d) <= 1e-12)::bigint as ties, count(*) filter (where d < -1e-12)::bigint as losses from d group by metric""")
def win_tie_loss(spark, sf_dir):
    """Whole vectors against their first half, question by question."""
    return evaluate.win_tie_loss(*_halved(spark, sf_dir))


def _evidence_rows(spark, sf_dir) -> DataFrame:
    mapped, chunks = _mapped(spark, sf_dir)
    found = bm25.search(bm25.build_index(chunks), _questions(spark, sf_dir), 5).withColumnRenamed("qid", "question_id")
    asked = _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id")).join(mapped, "question_id", "left_semi")
    return evaluate.score(found, mapped.select("question_id", "chunk_id"), asked, evidence=mapped)


_EVIDENCE_METRICS = f"""{_EVIDENCE_CHUNKS}, {_POSTINGS.replace("doc_id::varchar as chunk_id", "chunk_id").replace("from documents", "from named").lstrip()}, found as (select qid as question_id, chunk_id, rank from ({_ranked('scored', 5)})),
rel as (select distinct question_id, chunk_id from mapped), judged as (select distinct question_id from mapped), {_METRICS.format(retrieved="found", relevant="rel", questions="judged")},
rows_ as (select m.*, (select count(distinct evidence_id) from mapped x semi join found f on x.question_id = f.question_id and x.chunk_id = f.chunk_id where x.question_id = m.question_id) / (select count(distinct evidence_id) from mapped x where x.question_id = m.question_id) as evidence_recall from metrics m)"""


@query(f"with {_EVIDENCE_METRICS} select * from rows_")
def evidence_recall(spark, sf_dir):
    """The full evaluation loop over fixed windows: anchors, interval join, lexical search, metrics."""
    return _evidence_rows(spark, sf_dir)


@query("select avg(value)::double as mean, quantile_cont(value::double, 0.5) as p50, quantile_cont(value::double, 0.95) as p95 from events")
def latency_percentiles(spark, sf_dir):
    return evaluate.latency_summary(_t(spark, sf_dir, "events"), "value")


_WORDS = r"list_filter(string_split_regex(lower({}), '\s+'), lambda x: x <> '')"


@query(f"""with {_POSTINGS}, r as ({_ranked('scored', 20)}),
w as (select r.qid, r.chunk_id, r.rank as pre, list_distinct({_WORDS.format("b.text")}) as q, list_distinct(list_slice({_WORDS.format("d.text")}, 1, 512)) as t
      from r join benchmark b on b.item_id = r.qid join documents d on d.doc_id::varchar = r.chunk_id),
s as (select qid, chunk_id, pre, round(10.0::double * len(list_intersect(q, t)) / len(q) - 5, 6) as rerank_score from w)
select * from (select qid, chunk_id, pre::bigint as pre_rerank_rank, rerank_score, row_number() over (partition by qid order by rerank_score desc, chunk_id)::bigint as rank from s) where rank <= 5""")
def reranked(spark, sf_dir):
    """The lexical candidates of every benchmark passage, reranked by the stand-in cross-encoder."""
    found = bm25.search(bm25.build_index(_docs(spark, sf_dir)), _questions(spark, sf_dir)).join(_docs(spark, sf_dir), "chunk_id").join(_questions(spark, sf_dir), "qid")
    return _longs(fusion.rerank(found, 5).select("qid", "chunk_id", "pre_rerank_rank", F.round("rerank_score", 6).alias("rerank_score"), "rank"))


@query("""with r as (select doc_id::varchar as chunk_id, source as document_id, length(text)::bigint as n from documents)
select case when quality = 1 and toxic = 0 then 'answered' else 'abstain' end as status, count(*)::bigint as n_cases, sum(case when n >= 1000 then 1 else 0 end)::bigint as n_passed from labels join r on r.chunk_id = doc_id::varchar group by 1""")
def case_grading(spark, sf_dir):
    """Suite grading over labelled documents: a case passes if a document of at least 1,000 characters has its expected status."""
    labels = _t(spark, sf_dir, "labels").join(_t(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n")), "doc_id")
    expected = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "answered").otherwise("abstain")
    numbered = labels.withColumn("id", F.concat_ws("/", "doc_id", F.lit(1))).withColumn("expected_status", expected)
    cases = numbered.select("id", F.lit("q").alias("question"), "expected_status", F.lit(None).cast("string").alias("expected_article"), F.lit("").alias("purpose"))
    results = numbered.select(
        F.col("id").alias("qid"), F.lit("q").alias("question"), F.when(F.col("n") >= 1000, F.col("expected_status")).otherwise("supported").alias("status"),
        F.array().cast("array<struct<article_number:string>>").alias("sources"), F.struct(F.lit(True).alias("valid")).alias("citation_validation"), F.lit(0).alias("attempts"),
    )
    graded = evaluate.grade_cases(cases, results)
    return graded.groupBy(F.col("expected_status").alias("status")).agg(F.count("*").alias("n_cases"), F.count_if("passed").alias("n_passed"))


# The other module registers its queries beside these; it needs what stands above.
from docquarry.plans import catalogue_more  # noqa: E402, F401
