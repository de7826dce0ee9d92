"""More registered queries with their SQL: small column functions, structure, routing, validators, evaluation and answers.

Where the test tables hold nothing that a rule looks for, the query makes it
from them: structure lines before the lines of a document, Vietnamese phrases
before the turns of a conversation, damage to every so many chunks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.functions import text as tx
from docquarry.operators import answer as an
from docquarry.operators import bm25, chunking, dense, evaluate, fusion, quality, reflow, router, structure
from docquarry.plans import catalogue as base
from docquarry.plans.catalogue import _DENSE, _EVIDENCE_CHUNKS, _METRICS, _POSTINGS, _TOKENS, _longs, _ranked, _t, query
from docquarry.sources import io, scratch

_RTRIM = r"regexp_replace({}, '\s+$', '')"

# ---- column functions ---------------------------------------------------------


@query(r"""
with d as (select doc_id, replace(replace(coalesce(text, ''), 'é', 'e' || chr(769)), 'ü', 'u' || chr(776)) as t from documents), c as (select doc_id, nfc_normalize(t) as t from d)
select doc_id, md5(trim(regexp_replace(t, '\s+', ' ', 'g'))) as normal, md5(lower(trim(regexp_replace(t, '\s+', ' ', 'g')))) as lower_normal, len(regexp_extract_all(lower(t), '[\p{L}\p{N}_]+'))::bigint as n_tokens from c""")
def decomposed_text(spark, sf_dir):
    """Normal forms and tokens of texts with two letters in decomposed form."""
    t = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("\u00e9"), F.lit("e\u0301")), F.lit("\u00fc"), F.lit("u\u0308"))
    docs = _t(spark, sf_dir, "documents").select("doc_id", t.alias("t"))
    return docs.select("doc_id", F.md5(tx.normalize_text(F.col("t")).cast("binary")).alias("normal"), F.md5(tx.normalize_lower(F.col("t")).cast("binary")).alias("lower_normal"), F.size(tx.tokens(F.col("t"))).cast("long").alias("n_tokens"))


@query(r"""
with l as (select doc_id, case when doc_id % 7 = 0 then 'x' || (doc_id % 9) else (doc_id % 40) || case doc_id % 3 when 0 then '' when 1 then 'a' else 'C' end end as label from documents)
select doc_id, case when regexp_matches(label, '^\d+[a-zA-Z]?$') then regexp_extract(label, '^(\d+)', 1)::bigint end as number,
       case when regexp_matches(label, '^\d+[a-zA-Z]?$') then case when regexp_matches(label, '^\d+$') then 0 else ascii(lower(right(label, 1))) - 96 end end::bigint as suffix from l""")
def clause_labels(spark, sf_dir):
    """Sort keys of clause labels made from document ids."""
    i = F.col("doc_id")
    label = F.when(i % 7 == 0, F.concat(F.lit("x"), (i % 9).cast("string"))).otherwise(F.concat((i % 40).cast("string"), F.when(i % 3 == 0, "").when(i % 3 == 1, "a").otherwise("C")))
    key = tx.clause_sort_key(label)
    return _t(spark, sf_dir, "documents").select("doc_id", key["number"].cast("long").alias("number"), key["suffix"].cast("long").alias("suffix"))


@query(r"""
with s as (select doc_id, (doc_id % 13)::int as a, least(length(text), (doc_id % 13)::int + 90) as b, text from documents where length(text) >= 13),
p as (select *, substr(text, a + 1, b - a) as part from s), q as (select *, a + length(part) - length(regexp_replace(part, '^\s+', '')) as l, b - (length(part) - length(regexp_replace(part, '\s+$', ''))) as r from p)
select doc_id, l::bigint as start, greatest(l, r)::bigint as "end" from q""")
def trimmed_spans(spark, sf_dir):
    """Spans of document texts without white space at their ends."""
    a = (F.col("doc_id") % 13).cast("int")
    docs = _t(spark, sf_dir, "documents").filter("length(text) >= 13").withColumn("a", a).withColumn("b", F.least(F.length("text"), F.col("a") + 90))
    return _longs(docs.select("doc_id", tx.trim_span(F.col("text"), F.col("a"), F.col("b")).alias("s")).select("doc_id", "s.start", "s.end"))


_TAILS = ("", " 39 Khoản này được sửa đổi, bổ sung", " 17", "\n tiếp theo  ", " 5 Điểm a khoản 2")
_FIRST = ("", "1. ", "Chương II", "42", "39 Khoản này ", "2a.3 ")


@query(r"""
with t as (select doc_id, substr(replace(text, chr(10), ' '), 1, 50) || {tails}[doc_id % 5 + 1] as title, {first}[doc_id % 6 + 1] || case when doc_id % 6 = 2 or doc_id % 6 = 3 then '' else substr(replace(text, chr(10), ' '), 2, 40) end as line from documents),
o as (select *, trim(regexp_replace(title, '\s+', ' ', 'g')) as one, trim(regexp_replace(line, '^\s+|\s+$', '', 'g')) as s from t),
c as (select *, trim(regexp_replace(one, '(?i)\s+\d{{1,3}}\s+(Khoản(\s+này|\s+\d+[a-zA-Z]?)|Điểm(\s+này|\s+[a-zA-Z])|Điều(\s+này|\s+\d+)|Đoạn\s+này|Cụm\s+từ|Nội\s+dung|Tên\s+).*$', '')) as cut, regexp_extract(s, '(\p{{L}})', 1) as letter from o)
select doc_id, trim(regexp_replace(cut, '\s+\d{{1,3}}\s*$', '')) as title,
       s <> '' and not regexp_matches(s, '^(\d+[a-zA-Z]?)\.(\d+)?\s+') and not regexp_matches(s, '(?i)^\d{{1,3}}\s+(Khoản(\s+này|\s+\d+[a-zA-Z]?)|Điểm(\s+này|\s+[a-zA-Z])|Điều(\s+này|\s+\d+)|Đoạn\s+này|Cụm\s+từ|Nội\s+dung|Tên\s+)') and not regexp_matches(s, '^\d{{1,3}}$')
       and not regexp_matches(s, '^Chương\s+[IVXLCDM]+\s*$') and letter <> '' and letter = lower(letter) and letter <> upper(letter) as goes_on from c""".format(tails=list(_TAILS), first=list(_FIRST)).replace("\\n tiếp", "' || chr(10) || ' tiếp"))
def article_titles(spark, sf_dir):
    """Titles with footnotes, page numbers and line ends after them, and lines that may continue a title."""
    pick = lambda values, n: F.element_at(F.array(*(F.lit(v) for v in values)), (F.col("doc_id") % n + 1).cast("int"))
    flat = F.regexp_replace("text", "\n", " ")
    rest = F.when((F.col("doc_id") % 6).isin(2, 3), "").otherwise(F.substring(flat, 2, 40))
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.concat(F.substring(flat, 1, 50), pick(_TAILS, 5)).alias("title"), F.concat(pick(_FIRST, 6), rest).alias("line"))
    return docs.select("doc_id", tx.clean_article_title(F.col("title")).alias("title"), tx.is_title_continuation(F.col("line")).alias("goes_on"))


@query("""
with d as (select doc_id, text, (doc_id % 200 - 100) / 10 as score, case when doc_id % 5 = 0 then null else source end as label, case doc_id % 3 when 0 then null when 1 then '  ' || chr(10) else text end as meta from documents)
select doc_id, round(1 / (1 + exp(-score)), 9) as probability, md5(substr(text, 1, 300)) as preview, printf('doc_a%s_c%03d', (doc_id % 90) || 'a', doc_id % 1500) as chunk_id, (doc_id % 1500)::bigint as number, coalesce(label, '-') as label,
       md5(coalesce(nullif(case when trim(meta, ' ' || chr(10)) <> '' then meta end, ''), case when trim(text, ' ' || chr(10)) <> '' then text end, '')) as candidate,
       case when doc_id % 4 = 0 then '-' else printf('%.4f', score * 1000) end as shown, case when doc_id % 2 = 0 then score else doc_id / 8 end as seconds from d""")
def display_formats(spark, sf_dir):
    """Probabilities, previews, ids and the texts of values as shown."""
    i = F.col("doc_id")
    docs = _t(spark, sf_dir, "documents").select(
        "doc_id", "text", ((i % 200 - 100) / 10).alias("score"), F.when(i % 5 != 0, F.col("source")).alias("label"), F.when(i % 3 == 1, "  \n").when(i % 3 == 2, F.col("text")).alias("meta"),
        tx.article_chunk_id(F.lit("doc"), F.concat((i % 90).cast("string"), F.lit("a")), (i % 1500).cast("int")).alias("chunk_id"),
    )
    seconds = F.when(i % 2 == 0, tx.retrieval_seconds(F.struct(F.col("score").alias("retrieval")))).otherwise(tx.retrieval_seconds(F.struct(F.struct((i / 8).alias("total")).alias("retrieval"))))
    return docs.select(
        "doc_id", F.round(tx.sigmoid(F.col("score")), 9).alias("probability"), F.md5(tx.preview(F.col("text")).cast("binary")).alias("preview"), "chunk_id", tx.id_number(F.col("chunk_id")).cast("long").alias("number"),
        tx.shown(F.col("label")).alias("label"), F.md5(tx.candidate_text(F.col("meta"), F.col("text")).cast("binary")).alias("candidate"), tx.shown_number(F.when(i % 4 != 0, F.col("score") * 1000)).alias("shown"), seconds.alias("seconds"),
    )


# ---- reflow -------------------------------------------------------------------

_WRAPPED = """case doc_id % 4 when 0 then 'Điều ' || doc_id || '.' || chr(10) when 1 then 'Điều' || chr(10) || '5a. x' || chr(10) when 2 then 'CHƯƠNG MỘT' || chr(10) else '' end || replace(replace(text, ', ', ',' || chr(10)), '. ', '.  ' || chr(10) || ' ')"""
_FRESH = r"(regexp_matches({0}, '^(Chương\s+[IVXLCDM]+|Điều\s+\d+[a-zA-Z]?\.|\d+\.|[a-zA-Zđ]\))') or ({0} = upper({0}) and {0} <> lower({0}) and length({0}) < 150))"
_REFLOWED = rf"""
raw as (select doc_id, {_WRAPPED} as text from documents),
lines as (select doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') as l from raw),
done as (select doc_id, length(text) as raw_chars, case when len(l) = 0 then '' else list_reduce(l, lambda acc, x: acc || case when {_FRESH.format('x')} or {_FRESH.format("string_split(acc, chr(10))[-1]")} or regexp_matches(acc, '[.!?:;”"]$') then chr(10) else ' ' end || x) end as clean from lines)"""


def _wrapped(spark, sf_dir) -> DataFrame:
    i = F.col("doc_id")
    head = F.when(i % 4 == 0, F.concat(F.lit("Điều "), i.cast("string"), F.lit(".\n"))).when(i % 4 == 1, F.lit("Điều\n5a. x\n")).when(i % 4 == 2, F.lit("CHƯƠNG MỘT\n")).otherwise("")
    text = F.concat(head, F.replace(F.replace("text", F.lit(", "), F.lit(",\n")), F.lit(". "), F.lit(".  \n ")))
    return _t(spark, sf_dir, "documents").select(i.cast("string").alias("document_id"), F.lit(1).alias("page"), text.alias("text")).withColumn("char_count", F.length("text"))


@query(f"with {_REFLOWED} select doc_id::varchar as document_id, md5(clean) as clean, raw_chars::bigint as raw_char_count, length(clean)::bigint as clean_char_count from done")
def cleaned_pages(spark, sf_dir):
    """Documents wrapped at commas and sentence ends, with structure lines before some, joined again."""
    cleaned = reflow.clean_pages(_wrapped(spark, sf_dir))
    return _longs(cleaned.select("document_id", F.md5(F.col("text").cast("binary")).alias("clean"), "raw_char_count", "clean_char_count"))


@query(f"with {_REFLOWED.replace(_WRAPPED, 'text')} select count(*)::bigint as n_pages, sum(raw_chars)::bigint as raw_chars, sum(length(clean))::bigint as clean_chars, sum(raw_chars - length(clean))::bigint as removed_chars from done")
def page_clean_stats(spark, sf_dir):
    """Totals over the documents as they are."""
    return reflow.clean_totals(reflow.clean_pages(base._pages(spark, sf_dir)))


@query(f"with {_REFLOWED} select count(*)::bigint as n_pages, sum(raw_chars)::bigint as raw_chars, sum(length(clean))::bigint as clean_chars, sum(raw_chars - length(clean))::bigint as removed_chars from done")
def cleaned_totals(spark, sf_dir):
    return reflow.clean_totals(reflow.clean_pages(_wrapped(spark, sf_dir)))


# ---- routing ------------------------------------------------------------------

_PHRASES = (
    "Theo Điều 87 khoản 2, Bộ Công an có trách nhiệm gì?", "Chính phủ và Bộ Xây dựng có quyền gì, những cơ quan nào bao gồm những ai?", "Hành vi bị nghiêm cấm là gì?", "Điều kiện cấp lại giấy phép, hồ sơ và thủ tục?",
    "What is the law of the road?", "Biển báo dùng để làm gì, mục đích?", "Khi nào phải nhường đường? Điều 5, Điều 7, điều 5 khoản 3a Khoản 3A.", "Ủy ban nhân dân, uỷ ban nhân dân: quyền của họ", "", "Luật là gì, được hiểu là gì, giải thích?",
)


def _sql_rules(rules) -> str:
    return " + ".join(f"regexp_matches(t, '(?i)(^|[^\\p{{L}}\\p{{N}}_]){r}($|[^\\p{{L}}\\p{{N}}_])')::int" for r in rules)


_INTENTS = ", ".join(f"{{'n': {_sql_rules(rules)}, 'p': {-i}, 'name': '{name}'}}" for i, (name, rules) in enumerate(router.INTENTS))
_ENTITIES = ", ".join(f"case when contains(low, '{phrase}') then '{name}' end" for phrase, name in router.ENTITIES)


@query(f"""
with q as (select conv_id, turn, nfc_normalize(trim(regexp_replace({list(_PHRASES)!r}[(conv_id * 3 + turn) % {len(_PHRASES)} + 1] || ' ' || text, '\\s+', ' ', 'g'))) as t from conversations),
l as (select *, lower(t) as low from q where t <> ''),
s as (select *, 2 * (length(low) - length(regexp_replace(low, '[{router.VIETNAMESE_CHARACTERS}]', '', 'g'))) + len(list_filter({_TOKENS.format("low")}, lambda w: w in {router.VIETNAMESE_WORDS!r})) as vi,
  len(list_filter({_TOKENS.format("low")}, lambda w: w in {router.ENGLISH_WORDS!r})) as en, list_max([{_INTENTS}]) as best, {_sql_rules(router.MULTI_EVIDENCE)} as multi,
  regexp_extract_all(low, '(^|[^\\p{{L}}\\p{{N}}_])điều\\s+(\\d+)', 2) as articles, regexp_extract_all(t, '(?i)(^|[^\\p{{L}}\\p{{N}}_])khoản\\s+(\\d+[a-zA-Z]?)', 2) as clauses, list_filter([{_ENTITIES}], lambda x: x is not null) as names from l),
r as (select conv_id, turn, case when vi >= 2 then 'vi' when en >= 2 then 'en' else 'unknown' end as language, case when vi >= 2 then round(least(1.0, 0.70 + vi / 20), 4) when en >= 2 then round(least(1.0, 0.65 + en / 20), 4) else 0.5 end::double as language_confidence,
  case when best.n > 0 then best.name else 'general' end as intent, case when best.n >= 3 then 0.97 when best.n = 2 then 0.90 when best.n = 1 then 0.75 else 0.50 end::double as intent_confidence, multi > 0 as multi_evidence, case when multi >= 2 then 0.95 when multi = 1 then 0.85 else 0.70 end::double as multi_evidence_confidence,
  array_to_string(list_transform(articles, lambda x: x::int::varchar), ',') as articles, array_to_string(list_transform(clauses, lambda x: lower(x)), ',') as clauses, array_to_string(names, ',') as names from s)
select conv_id, turn, language, language_confidence, intent, intent_confidence, multi_evidence, multi_evidence_confidence, array_to_string(list_sort(list_distinct(string_split(articles, ','))), ',') as articles, array_to_string(list_sort(list_distinct(string_split(clauses, ','))), ',') as clauses,
  array_to_string(list_sort(list_distinct(string_split(names, ','))), ',') as entities, case when articles <> '' then 'hard' when names <> '' and intent_confidence >= 0.75 then 'soft' else 'none' end as filter_strategy, case when multi_evidence then 30 else 20 end::bigint as candidate_top_k from r""")
def routes(spark, sf_dir):
    """Every rule of the router: conversation turns after Vietnamese and English phrases, half of them decomposed."""
    made = F.concat(F.element_at(F.array(*(F.lit(p) for p in _PHRASES)), ((F.col("conv_id") * 3 + F.col("turn")) % len(_PHRASES) + 1).cast("int")), F.lit(" "), F.col("text"))
    turns = _t(spark, sf_dir, "conversations").select("conv_id", "turn", made.alias("question")).filter(tx.strip(F.col("question")) != "")
    marks = F.when(F.col("turn") % 2 == 0, F.replace(F.replace("question", F.lit("\u1ec1"), F.lit("\u00ea\u0300")), F.lit("\u1ed9"), F.lit("o\u0323\u0302"))).otherwise(F.col("question"))
    found = router.route(turns.withColumn("question", marks))
    joined = lambda c: F.array_join(F.array_sort(F.col(c).cast("array<string>")), ",")
    return _longs(found.select(
        "conv_id", "turn", "language", "language_confidence", "intent", "intent_confidence", "multi_evidence", "multi_evidence_confidence", joined("article_numbers").alias("articles"), joined("clause_numbers").alias("clauses"),
        joined("entities").alias("entities"), "filter_strategy", "candidate_top_k",
    ))


# ---- structure ----------------------------------------------------------------

_ARTICLES = rf"""
art as (select source as document_id, doc_id, 'Điều ' || (doc_id + 1) || '. tiêu đề' as heading, list_transform(string_split(translate(text, '"“”', ''''''''), chr(10)), lambda x, i: i || '. ' || x) as l from documents),
paged as (select *, heading || chr(10) || array_to_string(l, chr(10)) as text from art),
placed as (select *, coalesce(sum(length(text) + 1) over (partition by document_id order by doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as start from paged),
lined as (select document_id, doc_id, heading, start, unnest(l) as line, unnest(range(1, len(l) + 1)) as i from placed),
spots as (select *, start + length(heading) + 1 + coalesce(sum(length(line) + 1) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0)::bigint as a, 800 - length(heading) - 1 as room from lined),
trimmed as (select *, {_RTRIM.format("line")} as unit from spots),
cut as (select *, unnest(case when length(unit) <= room then [0] else range(0, (ceil((length(unit) - room) / (room - 120)) * (room - 120) + 1)::bigint, room - 120) end)::int as s from trimmed),
pieces as (select *, substr(unit, s + 1, room) as piece from cut),
structured as (
  select printf('%s_a%s_c%03d', document_id, (doc_id + 1)::varchar, row_number() over (partition by doc_id order by i, s)) as chunk_id, document_id, doc_id, (doc_id + 1)::varchar as article_number, heading, i::varchar as clause,
         row_number() over (partition by doc_id, i order by s) as piece_index, doc_id as page, a + s as source_start, a + s + length(piece) as source_end, heading || chr(10) || piece as text
  from pieces where regexp_matches(piece, '\S'))"""


def _article_pages(spark, sf_dir) -> DataFrame:
    """The documents of a source as pages, each an article of numbered lines, without quotes."""
    heading = F.concat(F.lit("Điều "), (F.col("page") + 1).cast("string"), F.lit(". tiêu đề\n"))
    numbered = F.array_join(F.transform(F.split(F.translate("text", '"“”', "'''"), "\n"), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")
    return base._source_pages(spark, sf_dir).withColumn("text", F.concat(heading, numbered))


@query(f"with {_ARTICLES} select chunk_id, document_id, article_number, 'tiêu đề' as article_title, clause, piece_index, page::bigint as page_start, page::bigint as page_end, source_start, source_end, length(text)::bigint as char_count, text from structured")
def structured_chunks(spark, sf_dir):
    """Structure-aware chunks, with their text, of pages made into articles."""
    return _longs(structure.structured_chunks(_article_pages(spark, sf_dir)).drop("chapter"))


@query(f"with {_ARTICLES} select document_id, (doc_id + 1)::varchar as article_number, 'tiêu đề' as article_title, case when doc_id >= 40 then 'II' else 'I' end as chapter, length(heading || chr(10) || array_to_string(l, chr(10))) + 1 as size, length(heading) + 1 as body_start from placed")
def chaptered_articles(spark, sf_dir):
    """Articles under chapter headings before the first page of a source and before its first page from 40 on."""
    pages = _article_pages(spark, sf_dir)
    first = pages.groupBy("document_id").agg(F.min("page").alias("p1"), F.min(F.when(F.col("page") >= 40, F.col("page"))).alias("p2"))
    head = F.when(F.col("page") == F.col("p2"), "Chương II\nTên chương\n").when(F.col("page") == F.col("p1"), "Chương I\n").otherwise("")
    found = structure.articles(pages.join(first, "document_id").withColumn("text", F.concat(head, "text")).drop("p1", "p2"))
    # an article before a chapter heading ends there, so the heading's characters are no part of it
    return _longs(found.select("document_id", "article_number", "article_title", "chapter", (F.col("end") - F.col("start")).alias("size"), "body_start"))


@query("""with h as (select source as document_id, min(doc_id) as p1, min(doc_id) filter (where doc_id >= 40) as p2 from documents group by source)
select document_id, 'I' as chapter from h where p2 is null or p1 <> p2 union all select document_id, 'II' from h where p2 is not null""")
def chapter_rows(spark, sf_dir):
    pages = _article_pages(spark, sf_dir)
    first = pages.groupBy("document_id").agg(F.min("page").alias("p1"), F.min(F.when(F.col("page") >= 40, F.col("page"))).alias("p2"))
    head = F.when(F.col("page") == F.col("p2"), "Chương II\nTên chương\n").when(F.col("page") == F.col("p1"), "Chương I\n").otherwise("")
    return structure.chapters(pages.join(first, "document_id").withColumn("text", F.concat(head, "text")).drop("p1", "p2")).select("document_id", "chapter")


# ---- validators ---------------------------------------------------------------

_LETTER = r"regexp_full_match(substr({}, {}, 1), '[\p{{L}}\p{{N}}]')"
#: Damage to fixed windows by what the number of the document and of the window say.
_DAMAGED = f"""{base._WINDOWS},
damaged as (
  select case when document_id::int % 17 = 1 and chunk_index = 2 then printf('%s_p001_c%03d', document_id, 1) else chunk_id end as chunk_id, document_id, chunk_index + case when document_id::int % 19 = 2 and chunk_index > 1 then 1 else 0 end as chunk_index,
         start_char + case when document_id::int % 23 = 3 then 1 else 0 end as start_char, end_char + case when document_id::int % 29 = 4 then 3 else 0 end as end_char, char_count + case when document_id::int % 31 = 5 then 2 else 0 end as char_count,
         case when document_id::int % 37 = 6 then replace(text, 'a', 'A') when document_id::int % 41 = 7 then '   ' when document_id::int % 43 = 8 then text || chr(7) || 'b' else text end as text
  from named where not (document_id::int % 13 = 9 and chunk_index = 1) and not document_id::int % 47 = 10),
pages as (select doc_id::varchar as document_id, text as source from documents),
ranked as (select *, row_number() over (partition by document_id order by chunk_index, chunk_id) as i from damaged),
own as (select *, trim(text, ' ' || chr(9) || chr(10)) = '' as blank from ranked join pages using (document_id)),
after as (select *, lead(start_char) over w as next_start, lead(substr(text, 1, 50)) over w as next_text from damaged window w as (partition by document_id order by chunk_index)),
by_page as (select p.document_id, length(source) as size, n, first, last, case when length(source) <= 0 then 0 when length(source) <= 512 then 1 else 1 + ceil((length(source) - 512) / 462.0) end as expected
  from pages p left join (select document_id, count(*) as n, arg_min(start_char, chunk_index) as first, arg_max(end_char, chunk_index) as last from damaged group by 1) c using (document_id)),
findings as (
  select 'error' as severity, 'duplicate_chunk_id' as type from damaged group by chunk_id having count(*) > 1
  union all select 'error', 'page_without_chunks' from by_page where n is null
  union all select 'error', 'wrong_chunk_count' from by_page where n <> expected
  union all select 'error', 'first_chunk_not_zero' from by_page where first <> 0
  union all select 'error', 'last_chunk_wrong_end' from by_page where last <> size
  union all select 'error', 'wrong_chunk_index' from own where chunk_index <> i
  union all select 'error', 'wrong_chunk_id' from own where chunk_id <> printf('%s_p001_c%03d', document_id, i)
  union all select 'error', 'end_out_of_bounds' from own where end_char > length(source)
  union all select 'error', 'invalid_range' from own where end_char <= start_char
  union all select 'error', 'text_source_mismatch' from own where text <> substr(source, start_char + 1, end_char - start_char)
  union all select 'error', 'wrong_char_count' from own where char_count <> length(text)
  union all select 'error', 'chunk_too_large' from own where length(text) > 512
  union all select 'error', 'empty_chunk' from own where blank
  union all select 'warning', 'short_chunk' from own where length(text) < 100
  union all select 'warning', 'control_characters' from own where regexp_matches(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]')
  union all select 'warning', 'starts_inside_word' from own where start_char > 0 and {_LETTER.format('source', 'start_char')} and {_LETTER.format('source', 'start_char + 1')}
  union all select 'warning', 'ends_inside_word' from own where end_char < length(source) and {_LETTER.format('source', 'end_char')} and {_LETTER.format('source', 'end_char + 1')}
  union all select 'error', 'wrong_overlap_offset' from after where next_start <> end_char - 50
  union all select 'error', 'overlap_content_mismatch' from after where right(text, 50) <> next_text
  union all select 'warning', 'duplicate_chunk_text' from (select text from damaged group by text having count(*) > 1))"""


def _damaged(spark, sf_dir) -> DataFrame:
    chunks, d, n = chunking.fixed_chunks(base._pages(spark, sf_dir)), F.col("document_id").cast("int"), F.col("chunk_index")
    chunks = chunks.filter(~((d % 13 == 9) & (n == 1)) & (d % 47 != 10))
    return chunks.withColumns({
        "chunk_id": F.when((d % 17 == 1) & (n == 2), tx.page_chunk_id(F.col("document_id"), F.col("page"), F.lit(1))).otherwise(F.col("chunk_id")),
        "chunk_index": n + F.when((d % 19 == 2) & (n > 1), 1).otherwise(0), "start_char": F.col("start_char") + F.when(d % 23 == 3, 1).otherwise(0), "end_char": F.col("end_char") + F.when(d % 29 == 4, 3).otherwise(0),
        "char_count": F.col("char_count") + F.when(d % 31 == 5, 2).otherwise(0),
        "text": F.when(d % 37 == 6, F.replace("text", F.lit("a"), F.lit("A"))).when(d % 41 == 7, "   ").when(d % 43 == 8, F.concat("text", F.lit("\x07b"))).otherwise(F.col("text")),
    })


@query(f"with {_DAMAGED} select severity, type, count(*)::bigint as n from findings group by all")
def damaged_findings(spark, sf_dir):
    """The full check of fixed windows after damage of every kind, counted by type."""
    return quality.counts_by_type(quality.check_fixed(base._pages(spark, sf_dir), _damaged(spark, sf_dir)))


@query(f"with {_DAMAGED} select type, count(*)::bigint as n from findings where type in ('wrong_overlap_offset', 'overlap_content_mismatch') group by all")
def adjacency_findings(spark, sf_dir):
    return quality.check_adjacency(_damaged(spark, sf_dir)).groupBy("type").agg(F.count("*").alias("n"))


@query(f"""with {_DAMAGED} select type, count(*)::bigint as n from (select type from findings where type in ('duplicate_chunk_id', 'wrong_char_count', 'empty_chunk')
union all select 'wrong_offset_length' from damaged where end_char - start_char <> length(text)) group by all""")
def before_embedding(spark, sf_dir):
    """What is checked before fixed windows are embedded."""
    return quality.check_before_embedding(_damaged(spark, sf_dir)).groupBy("type").agg(F.count("*").alias("n"))


@query(f"""with {_DAMAGED}, c as (select type, severity, count(*) as n from findings group by all), s as (select count(*) as n_chunks, count(distinct document_id) as n_pages, min(char_count) as lo, max(char_count) as hi, round(avg(char_count), 6) as avg from damaged)
select n_chunks::bigint as n_chunks, n_pages::bigint as n_pages, lo::bigint as min_chars, hi::bigint as max_chars, avg as avg_chars, (select sum(n) from c where severity = 'error')::bigint as errors, 'FAIL' as status,
  (select string_agg(severity || ' ' || type || ' ' || n, ',' order by severity, type) from c) as findings from s""")
def quality_report(spark, sf_dir):
    """Statistics, status and findings of the damaged windows in one row."""
    chunks = _damaged(spark, sf_dir)
    made = quality.report(quality.fixed_statistics(chunks), quality.check_fixed(base._pages(spark, sf_dir), chunks))
    told = F.array_join(F.transform("findings", lambda f: F.concat_ws(" ", f["severity"], f["type"], f["n"].cast("string"))), ",")
    return _longs(made.select("statistics.*", "errors", "status", told.alias("findings")))


#: Damage to structure-aware chunks.
_DAMAGED_ARTICLES = f"""{_ARTICLES},
numbered as (select *, row_number() over (partition by doc_id order by i, s) as k from pieces where regexp_matches(piece, '\\S')),
broken as (
  select printf('%s_a%s_c%03d', document_id, article_number, k + case when doc_id % 13 = 1 and k > 1 then 1 else 0 end) as chunk_id, document_id, article_number, clause, piece_index + case when doc_id % 17 = 2 then 1 else 0 end as piece_index,
         page + case when doc_id % 19 = 3 then 1 else 0 end as page_start, page as page_end, source_start, source_end + case when doc_id % 23 = 4 then 100000000 else 0 end as source_end, length(text) + case when doc_id % 29 = 5 then 1 else 0 end as char_count,
         case when doc_id % 31 = 6 then replace(text, 'Điều', 'điều') when doc_id % 37 = 7 then text || 'x' else text end as text, heading, doc_id, k, piece_index as true_index, page from (select n.*, (n.doc_id + 1)::varchar as article_number, n.i::varchar as clause,
         row_number() over (partition by n.doc_id, n.i order by n.s) as piece_index, n.doc_id as page, n.a + n.s as source_start, n.a + n.s + length(n.piece) as source_end, n.heading || chr(10) || n.piece as text from numbered n)),
sizes as (select document_id, max(start + length(text) + 1) as n, string_agg(text || chr(10), '' order by doc_id) as whole from placed group by 1),
judged as (select b.*, n, source_end <= n as ok from broken b join sizes using (document_id)),
shared as (select *, source_end - lead(source_start) over (partition by document_id, article_number, clause order by source_start, piece_index) as share, row_number() over (partition by document_id, article_number, clause order by source_start, piece_index) as nth, count(*) over (partition by document_id, article_number, clause) as members from broken),
found as (
  select 'error' as severity, 'char_count_mismatch' as type from judged where char_count <> length(text)
  union all select 'error', 'chunk_too_large' from judged where length(text) > 800
  union all select 'error', 'invalid_source_range' from judged where not ok
  union all select 'error', 'wrong_heading' from judged where ok and not starts_with(text, heading)
  union all select 'error', 'source_text_mismatch' from judged join sizes using (document_id) where ok and starts_with(text, heading || chr(10)) and substr(text, length(heading) + 2) <> substr(whole, source_start + 1, source_end - source_start)
  union all select 'error', 'invalid_page_range' from judged where page_start > page_end
  union all select 'error', 'page_start_mismatch' from judged where page_start <> page
  union all select 'error', 'page_end_mismatch' from judged join (select document_id, max(doc_id) as last from placed group by 1) using (document_id) where not ok and page_end <> last
  union all select 'warning', 'short_chunk' from judged where ok and length(text) < 100
  union all select 'error', 'non_sequential_chunk_ids' from broken where doc_id % 13 = 1 and k > 1
  union all select 'error', 'piece_index_sequence' from shared where members > 1 and piece_index <> nth
  union all select 'error', 'overlap_too_large' from shared where members > 1 and share > 120
  union all select 'warning', 'nonstandard_overlap' from shared where members > 1 and share > 0 and share < 120
  union all select 'error', 'missing_fallback_overlap' from shared where members > 1 and share <= 0)"""


def _broken(spark, sf_dir) -> DataFrame:
    pages = _article_pages(spark, sf_dir)
    chunks, d, k = structure.structured_chunks(pages), F.col("article_number").cast("int") - 1, tx.id_number(F.col("chunk_id"))
    moved = tx.article_chunk_id(F.col("document_id"), F.col("article_number"), k + F.when((d % 13 == 1) & (k > 1), 1).otherwise(0))
    more = lambda c, n, by: F.col(c) + F.when(d % n[0] == n[1], by).otherwise(0)
    return chunks.withColumns({
        "chunk_id": moved, "piece_index": more("piece_index", (17, 2), 1), "page_start": more("page_start", (19, 3), 1), "source_end": more("source_end", (23, 4), 100_000_000), "char_count": more("char_count", (29, 5), 1),
        "text": F.when(d % 31 == 6, F.replace("text", F.lit("Điều"), F.lit("điều"))).when(d % 37 == 7, F.concat("text", F.lit("x"))).otherwise(F.col("text")),
    })


@query(f"with {_DAMAGED_ARTICLES} select severity, type, count(*)::bigint as n from found group by all")
def structured_findings(spark, sf_dir):
    """The full check of structure-aware chunks after damage, counted by type."""
    return quality.counts_by_type(quality.check_structured(_article_pages(spark, sf_dir), _broken(spark, sf_dir)))


@query(f"with {_DAMAGED_ARTICLES} select type, count(*)::bigint as n from (select type from found where type = 'char_count_mismatch' union all select 'wrong_article_count') group by all".replace("'char_count_mismatch' union", "'char_count_mismatch' union"))
def before_embedding_structured(spark, sf_dir):
    """What is checked before structure-aware chunks are embedded, with a number of articles that is not met."""
    found = quality.check_before_embedding(_broken(spark, sf_dir), fixed=False, expected_articles=1)
    return found.withColumn("type", F.when(F.col("type") == "wrong_char_count", "char_count_mismatch").otherwise(F.col("type"))).groupBy("type").agg(F.count("*").alias("n"))


@query(f"""with {_ARTICLES} select count(*)::bigint as n_chunks, min(length(text))::bigint as min_chars, max(length(text))::bigint as max_chars, round(avg(length(text)), 6) as avg_chars, 0::bigint as n_intro, count(*) filter (where piece_index > 1)::bigint as n_fallback,
0::bigint as n_multi_page, count(distinct article_number)::bigint as n_articles from structured""")
def structured_stats(spark, sf_dir):
    return _longs(quality.structured_statistics(structure.structured_chunks(_article_pages(spark, sf_dir))))


@query(f"""with {_ARTICLES} select document_id, article_number, count(*)::bigint as n_chunks, count(distinct clause)::bigint as n_clauses, count(*) filter (where piece_index > 1)::bigint as n_pieces, sum(length(text))::bigint as chars, min(page)::bigint as page_start, max(page)::bigint as page_end
from structured group by 1, 2""")
def article_summaries(spark, sf_dir):
    return _longs(quality.summary_by_article(structure.structured_chunks(_article_pages(spark, sf_dir))))


@query(f"""with {_ARTICLES} select chunk_id, md5(repeat('=', 30) || chr(10) || 'chunk_id=' || chunk_id || ' article_number=' || article_number || ' clause=' || clause || ' page_start=' || page || ' page_end=' || page || ' char_count=' || length(text) || chr(10) || text) as line from structured""")
def review_lines(spark, sf_dir):
    """What people read of each structure-aware chunk."""
    chunks = structure.structured_chunks(_article_pages(spark, sf_dir))
    return quality.review_text(chunks).select(F.regexp_extract("line", r"chunk_id=(\S+)", 1).alias("chunk_id"), F.md5(F.col("line").cast("binary")).alias("line"))


@query(f"with {base._WINDOWS} select chunk_id, md5(repeat('=', 30) || chr(10) || 'chunk_id=' || chunk_id || ' page=1 char_count=' || char_count || chr(10) || text) as line from named")
def review_lines_fixed(spark, sf_dir):
    chunks = chunking.fixed_chunks(base._pages(spark, sf_dir))
    return quality.review_text(chunks).select(F.regexp_extract("line", r"chunk_id=(\S+)", 1).alias("chunk_id"), F.md5(F.col("line").cast("binary")).alias("line"))


# ---- sources and sinks --------------------------------------------------------


def _written(df: DataFrame, write, name: str) -> str:
    import uuid

    path = f"{scratch.shared_dir(df.sparkSession)}/docquarry-{df.sparkSession.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    write(df, path)
    return path


@query("select doc_id::varchar as document_id, 1::bigint as page, text, length(text)::bigint as char_count from documents")
def pages_round_trip(spark, sf_dir):
    """Raw pages written as JSON lines and read again."""
    pages = base._pages(spark, sf_dir).withColumn("char_count", F.length("text"))
    return _longs(io.read_jsonl(spark, _written(pages, io.write_jsonl, "pages"), io.PAGES_RAW))


@query(f"with {base._WINDOWS} select row_number() over (order by chunk_id) - 1 as vector_index, chunk_id, document_id, 1::bigint as page, chunk_index, start_char, end_char, char_count, text from named")
def fixed_round_trip(spark, sf_dir):
    """Metadata of fixed windows with their vector_index, written and read again."""
    chunks = io.with_vector_index(chunking.fixed_chunks(base._pages(spark, sf_dir)))
    return _longs(io.read_metadata(spark, _written(chunks, io.write_jsonl, "metadata"), io.CHUNKS_FIXED))


@query(f"with {_ARTICLES} select row_number() over (order by chunk_id) - 1 as vector_index, chunk_id, document_id, null::varchar as chapter, article_number, 'tiêu đề' as article_title, clause, piece_index, page::bigint as page_start, page::bigint as page_end, source_start, source_end, length(text)::bigint as char_count, text from structured")
def structured_round_trip(spark, sf_dir):
    chunks = io.with_vector_index(structure.structured_chunks(_article_pages(spark, sf_dir)))
    return _longs(io.read_metadata(spark, _written(chunks, io.write_jsonl, "metadata"), io.CHUNKS_STRUCTURED))


@query("select vec_id::bigint as vector_index, round(list_sum(list_transform(embedding, lambda x: x::double)), 6) as total, len(embedding)::bigint as n from embeddings")
def embeddings_round_trip(spark, sf_dir):
    """Vectors written as a table and read again."""
    rows = io.read_embeddings(spark, _written(_t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("vector_index"), "embedding"), io.write_table, "embeddings"))
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return _longs(rows.select("vector_index", F.round(total, 6).alias("total"), F.size("embedding").alias("n")))


@query(f"""with {base._WINDOWS}, v as (select sqrt(list_dot_product(embedding::double[], embedding::double[])) as n, len(embedding) as d from embeddings)
select 'fixed' as kind, 512::bigint as size, (select count(*) from named)::bigint as n_chunks, max(d)::bigint as dimension, round(min(n), 6) as min_norm, round(max(n), 6) as max_norm, case when bool_and(abs(n - 1) <= 1.01e-3) and min(d) = max(d) then 'PASS' else 'FAIL' end as status, 'abc' as source_sha256, 1.5::double as seconds from v""")
def index_manifest(spark, sf_dir):
    chunks = chunking.fixed_chunks(base._pages(spark, sf_dir))
    made = io.manifest(chunks, _t(spark, sf_dir, "embeddings"), {"kind": "fixed", "size": 512}, "abc", 1.5)
    return _longs(made.select("config.*", "n_chunks", "dimension", F.round("norms.min_norm", 6).alias("min_norm"), F.round("norms.max_norm", 6).alias("max_norm"), "status", "source_sha256", "seconds"))


@query("""with v as (select vec_id, case when vec_id % 50 = 1 then list_append(embedding, 1::float) when vec_id % 50 = 2 then list_transform(embedding, lambda x: 2 * x) else embedding end as e, case when vec_id % 50 = 3 then 0 else vec_id end as i from embeddings)
select count(*)::bigint as n_rows, count(*) filter (where len(e) <> 64)::bigint as n_wrong_dimension, count(*) filter (where abs(sqrt(list_dot_product(e::double[], e::double[])) - 1) > 1.1e-4)::bigint as n_norm_off, true as unique_ids, count(distinct i) = count(*) as index_gapless, false as ok from v""")
def index_check(spark, sf_dir):
    """An index with vectors too long or too large and with repeated numbers."""
    n = F.col("vec_id")
    e = F.when(n % 50 == 1, F.array_append("embedding", F.lit(1.0).cast("float"))).when(n % 50 == 2, F.transform("embedding", lambda x: (2 * x).cast("float"))).otherwise(F.col("embedding"))
    index = _t(spark, sf_dir, "embeddings").select(n.cast("string").alias("chunk_id"), e.alias("embedding"), F.when(n % 50 == 3, 0).otherwise(n).alias("vector_index"))
    return dense.check_index(index, dimension=64).select("n_rows", "n_wrong_dimension", "n_norm_off", "unique_ids", "index_gapless", "ok")


# ---- search and evaluation ----------------------------------------------------

_GOLD = f"""{_ARTICLES},
windows as (select document_id, doc_id, start, unnest(range(0, greatest(0, ceil((length(text) - 512) / 462.0))::bigint * 462 + 1, 462))::bigint as s, text from placed),
fixed as (select printf('%s_p%03d_c%03d', document_id, doc_id, row_number() over (partition by doc_id order by s)) as chunk_id, document_id, doc_id, start + s as a, start + least(s + 512, length(text)) as b, substr(text, s + 1, 512) as text from windows),
spans as (select document_id, doc_id + 1 as article, start as a, coalesce(lead(start) over (partition by document_id order by doc_id), start + length(text) + 1) as b from placed),
asked as (select item_id as question_id, text as question, unnest([item_id % 40 + 1, (item_id * 7) % 190 + 1]) as article from benchmark),
gold as (select distinct question_id, chunk_id from asked join spans using (article) join fixed on fixed.document_id = spans.document_id and least(fixed.b, spans.b) - greatest(fixed.a, spans.a) >= 30)"""


def _gold_questions(spark, sf_dir) -> DataFrame:
    i = F.col("item_id")
    return _t(spark, sf_dir, "benchmark").select(i.alias("question_id"), F.col("text").alias("question"), F.array((i % 40 + 1).cast("int"), ((i * 7) % 190 + 1).cast("int")).alias("gold_articles"))


@query(f"with {_ARTICLES} select document_id, (doc_id + 1)::bigint as article, start, coalesce(lead(start) over (partition by document_id order by doc_id), start + length(text) + 1)::bigint as \"end\" from placed")
def article_spans(spark, sf_dir):
    """Spans of articles in the document that a source's pages make."""
    return _longs(evaluate.article_spans(_article_pages(spark, sf_dir)))


@query(f"with {_ARTICLES} select document_id, chunk_id, source_start as start, source_end as \"end\" from structured")
def structured_spans(spark, sf_dir):
    return _longs(evaluate.structured_spans(structure.structured_chunks(_article_pages(spark, sf_dir))))


@query(f"with {_GOLD} select question_id, chunk_id from gold")
def gold_chunks(spark, sf_dir):
    """Fixed windows that share 30 characters with a question's gold articles."""
    pages = _article_pages(spark, sf_dir)
    spans = evaluate.chunk_spans(chunking.fixed_chunks(pages), pages)
    return evaluate.gold_chunks(_gold_questions(spark, sf_dir), evaluate.article_spans(pages), spans)


_OVER_FIXED = _POSTINGS.replace("doc_id::varchar as chunk_id", "chunk_id").replace("from documents", "from fixed").lstrip()


@query(f"""with {_GOLD}, {_OVER_FIXED.replace("asked as", "asked_terms as").replace("from asked join", "from asked_terms join")}, hits as (select qid as question_id, chunk_id, rank from ({_ranked('scored', 20)})), every as (select item_id as question_id from benchmark), {_METRICS.format(retrieved="hits", relevant="gold", questions="every")}
select * from metrics""")
def article_benchmark(spark, sf_dir):
    """Lexical search over fixed windows, judged by gold articles."""
    pages = scratch.cut(_article_pages(spark, sf_dir), "pages")  # made once; windows are cheap to cut again
    chunks = chunking.fixed_chunks(pages)
    found = bm25.search(bm25.build_index(chunks), base._questions(spark, sf_dir)).withColumnRenamed("qid", "question_id")
    return evaluate.article_benchmark(pages, chunks, found, _gold_questions(spark, sf_dir))


@query(f"""with {_EVIDENCE_CHUNKS}, {_POSTINGS.replace("doc_id::varchar as chunk_id", "chunk_id").replace("from documents", "from named").lstrip()}, f as (select qid as question_id, chunk_id, rank from ({_ranked('scored', 5)})),
c as (select question_id, chunk_id, string_agg(evidence_id, ',' order by evidence_id) as covers from mapped group by 1, 2)
select f.question_id, f.rank::bigint as rank, f.chunk_id, coalesce(covers, '') as covers from f left join c using (question_id, chunk_id)""")
def hit_details(spark, sf_dir):
    """For each retrieved window the evidence it covers."""
    mapped, chunks = base._mapped(spark, sf_dir)
    found = bm25.search(bm25.build_index(chunks), base._questions(spark, sf_dir), 5).withColumnRenamed("qid", "question_id")
    hits = evaluate.hit_details(found, mapped).select("question_id", F.explode("hits").alias("h"))
    return _longs(hits.select("question_id", "h.rank", "h.chunk_id", F.array_join("h.covers", ",").alias("covers")))


_REL = "rel as (select qid as question_id, vec_id::varchar as chunk_id from q join embeddings on label = qlabel), judged as (select qid as question_id from q)"
_HALVES = f"""{_DENSE}, halves as (select qid, vec_id::varchar as chunk_id, round(list_dot_product(list_transform(v[:32], lambda x: x::double), list_transform(embedding[:32], lambda x: x::double)), 6) as score from q, embeddings), {_REL},
w as (with found as (select qid as question_id, chunk_id, rank from ({_ranked('pairs', 20)})), {_METRICS.format(retrieved="found", relevant="rel", questions="judged")} select * from metrics),
h as (with found as (select qid as question_id, chunk_id, rank from ({_ranked('halves', 20)})), {_METRICS.format(retrieved="found", relevant="rel", questions="judged")} select * from metrics),
means as (select 'half' as index, round(avg(precision), 9) as precision, round(avg(recall), 9) as recall, round(avg(hit), 9) as hit, round(avg(mrr), 9) as mrr, round(avg(ndcg), 9) as ndcg from h union all select 'whole', round(avg(precision), 9), round(avg(recall), 9), round(avg(hit), 9), round(avg(mrr), 9), round(avg(ndcg), 9) from w)"""


@query(f"with {_HALVES} select * from means")
def metric_means(spark, sf_dir):
    """Macro means of two systems."""
    half, whole = (evaluate.mean_metrics(m).withColumn("index", F.lit(n)) for m, n in zip(base._halved(spark, sf_dir), ("half", "whole")))
    return half.unionByName(whole)


_DELTAS = "select " + ", ".join(f"round(b.{m} - a.{m}, 9) as {m}" for m in ("precision", "recall", "hit", "mrr", "ndcg")) + " from (select * from means where index = 'half') a, (select * from means where index = 'whole') b"


@query(f"with {_HALVES} {_DELTAS}")
def metric_deltas(spark, sf_dir):
    made = evaluate.deltas(*base._halved(spark, sf_dir))
    return made.select(*(F.round(c, 9).alias(c) for c in made.columns))


_MET = ("precision", "recall", "hit", "mrr", "ndcg")
_UNPIVOT = " union all ".join(f"select '{m}' as metric, b.{m} - a.{m} as d from h a join w b using (question_id)" for m in _MET)


def _md(columns, rows: str, order: str) -> str:
    head = "| " + " | ".join(columns) + " |"
    return f"(select '{head}' || chr(10) || '|{'---|' * len(columns)}' || chr(10) || string_agg('| ' || {rows} || ' |', chr(10) order by {order}) from {{0}})"


_F4 = lambda c: f"printf('%.4f', {c})"


@query(f"""with {_HALVES}, dl as ({_DELTAS}), du as ({" union all ".join(f"select '{m}' as metric, {m} as d from dl" for m in _MET)}), wtl as (select metric, count(*) filter (where d > 1e-12) as wins, count(*) filter (where abs(d) <= 1e-12) as ties, count(*) filter (where d < -1e-12) as losses from ({_UNPIVOT}) group by 1),
both_ as (select a.question_id, {", ".join(f"a.{m} as a_{m}, b.{m} as b_{m}" for m in _MET)} from h a join w b using (question_id))
select '## Means' || chr(10) || chr(10) || {_md(("index", *_MET), "index || ' | ' || " + " || ' | ' || ".join(_F4(m) for m in _MET), "index").format("means")}
 || chr(10) || chr(10) || '## Deltas' || chr(10) || chr(10) || {_md(("metric", "delta"), "metric || ' | ' || printf('%+.4f', d)", "metric").format("du")}
 || chr(10) || chr(10) || '## Wins, ties and losses' || chr(10) || chr(10) || {_md(("metric", "wins", "ties", "losses"), "metric || ' | ' || wins || ' | ' || ties || ' | ' || losses", "metric").format("wtl")}
 || chr(10) || chr(10) || '## Questions' || chr(10) || chr(10) || {_md(("question", *_MET), "question_id || ' | ' || " + " || ' | ' || ".join(f"{_F4('a_' + m)} || ' / ' || {_F4('b_' + m)}" for m in _MET), "question_id").format("both_")} as report""")
def ablation_report(spark, sf_dir):
    """The whole report on half vectors and whole ones."""
    a, b = (scratch.cut(m, "metrics") for m in base._halved(spark, sf_dir))
    means = evaluate.mean_metrics(a).withColumn("index", F.lit("half")).unionByName(evaluate.mean_metrics(b).withColumn("index", F.lit("whole")))
    return evaluate.markdown_report(means, "index", a, b)


_CASES = """
cases as (select labels.doc_id as id, case when quality = 1 then 'answered' else 'abstain' end as expected, case when labels.doc_id % 5 = 0 then null else (labels.doc_id % 4)::varchar end as article,
  case when labels.doc_id % 11 = 0 then 'abstain' when quality = 1 or labels.doc_id % 13 = 0 then 'answered' else 'abstain' end as status, labels.doc_id % 7 <> 0 as valid, list_transform(range(0, labels.doc_id % 4 + 1), lambda x: x::varchar) as articles, labels.doc_id % 3 as attempts
  from labels where labels.doc_id in (select doc_id from documents)),
g as (select id, expected, status, status = expected as status_ok, case when expected = 'answered' then valid end as citation_ok, case when expected = 'answered' and article is not null then list_contains(articles, article) end as article_ok, case when expected = 'abstain' then attempts = 0 end as bypass_ok from cases),
p as (select *, status_ok and coalesce(citation_ok, true) and coalesce(article_ok, true) and coalesce(bypass_ok, true) as passed from g)"""


def _graded(spark, sf_dir) -> DataFrame:
    i = F.col("doc_id")
    rows = _t(spark, sf_dir, "labels").join(_t(spark, sf_dir, "documents").select("doc_id"), "doc_id", "left_semi").withColumn("id", i.cast("string"))
    expected = F.when(F.col("quality") == 1, "answered").otherwise("abstain")
    cases = rows.select("id", F.lit("q").alias("question"), expected.alias("expected_status"), F.when(i % 5 != 0, (i % 4).cast("string")).alias("expected_article"), F.lit("").alias("purpose"))
    status = F.when(i % 11 == 0, "abstain").when((F.col("quality") == 1) | (i % 13 == 0), "answered").otherwise("abstain")
    sources = F.transform(F.sequence(F.lit(0), (i % 4).cast("int")), lambda x: F.struct(x.cast("string").alias("article_number")))
    results = rows.select(F.col("id").alias("qid"), F.lit("q").alias("question"), status.alias("status"), sources.alias("sources"), F.struct((i % 7 != 0).alias("valid")).alias("citation_validation"), (i % 3).cast("int").alias("attempts"))
    return evaluate.grade_cases(cases, results)


@query(f"with {_CASES} select id::varchar as id, expected as expected_status, status as actual_status, status_ok, citation_ok, article_ok, bypass_ok, passed from p")
def graded_cases(spark, sf_dir):
    """Every check of a demo case, over cases made from labels."""
    return _graded(spark, sf_dir)


@query(f"""with {_CASES} select count(*)::bigint as n, count(*) filter (where passed)::bigint as n_passed, round(avg(passed::int), 9) as pass_rate, round(avg(status_ok::int), 9) as status_rate, round(avg(citation_ok::int), 9) as citation_rate, round(avg(article_ok::int), 9) as article_rate,
round(avg(bypass_ok::int), 9) as bypass_rate, (select string_agg(id::varchar, ',' order by id::varchar) from p where not passed) as failed_ids from p""")
def suite_summary(spark, sf_dir):
    made = evaluate.summarize_cases(_graded(spark, sf_dir))
    return made.select("n", "n_passed", *(F.round(c, 9).alias(c) for c in ("pass_rate", "status_rate", "citation_rate", "article_rate", "bypass_rate")), F.array_join("failed_ids", ",").alias("failed_ids"))


_SHORT = r"array_to_string(list_slice(string_split(text, ' '), 3, 4), ' ')"
_FAILING = f"""{_EVIDENCE_CHUNKS}, {_POSTINGS.replace("doc_id::varchar as chunk_id", "chunk_id").replace("from documents", "from named").replace(_TOKENS.format("text") + ") as term from benchmark", _TOKENS.format(_SHORT) + ") as term from benchmark").lstrip()},
found as (select qid as question_id, chunk_id, rank from ({_ranked('scored', 5)})), rel as (select distinct question_id, chunk_id from mapped), judged as (select distinct question_id from mapped), {_METRICS.format(retrieved="found", relevant="rel", questions="judged")},
rows_ as (select m.*, (select count(distinct evidence_id) from mapped x semi join found f on x.question_id = f.question_id and x.chunk_id = f.chunk_id where x.question_id = m.question_id) / (select count(distinct evidence_id) from mapped x where x.question_id = m.question_id) as evidence_recall from metrics m)"""


@query(f"with {_FAILING} select question_id, mrr, evidence_recall from rows_ where not (evidence_recall >= 1 and mrr >= 1)")
def failure_filter(spark, sf_dir):
    """Questions of two words only, most of which miss their evidence."""
    mapped, chunks = base._mapped(spark, sf_dir)
    mapped, chunks = scratch.cut(mapped, "mapped"), scratch.cut(chunks, "chunks")
    short = base._questions(spark, sf_dir).withColumn("question", F.array_join(F.slice(F.split("question", " "), 3, 2), " "))
    found = bm25.search(bm25.build_index(chunks), short, 5).withColumnRenamed("qid", "question_id")
    asked = _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id")).join(mapped, "question_id", "left_semi")
    rows = evaluate.score(found, mapped.select("question_id", "chunk_id"), asked, evidence=mapped)
    return evaluate.failures(rows).select("question_id", "mrr", "evidence_recall")


_HELD = "held as (select d.doc_id, d.text, e.embedding from documents d join embeddings e on e.vec_id = d.doc_id)"


@query(f"""with {_HELD}, {_POSTINGS.replace("from documents", "from held").lstrip()}, pairs as (select item_id as qid, h.doc_id::varchar as chunk_id, round(list_dot_product(e.embedding::double[], h.embedding::double[]), 6) as score from benchmark b join embeddings e on e.vec_id = b.item_id, held h),
b as ({_ranked('scored', 20)}), dn as ({_ranked('pairs', 20)}),
both_ as (select coalesce(dn.qid, b.qid) as qid, coalesce(dn.chunk_id, b.chunk_id) as chunk_id, dn.rank as dense_rank, b.rank as bm25_rank from dn full join b on dn.qid = b.qid and dn.chunk_id = b.chunk_id),
s as (select *, round(coalesce(1 / (60 + dense_rank), 0) + coalesce(1 / (60 + bm25_rank), 0), 12) as rrf_score from both_),
r as (select *, row_number() over (partition by qid order by rrf_score desc, coalesce(least(dense_rank, bm25_rank), 1000000000), chunk_id) as rank from s)
select qid, chunk_id, rank::bigint as rank, rrf_score, dense_rank::bigint as dense_rank, bm25_rank::bigint as bm25_rank from r where rank <= 5""")
def hybrid_search(spark, sf_dir):
    """Both searches over the documents that have a vector, fused: benchmark passages with the vector of their number."""
    from docquarry.plans import retrieval

    vectors = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    chunks = _t(spark, sf_dir, "documents").select("doc_id", "text").join(vectors, "doc_id").select(F.col("doc_id").cast("string").alias("chunk_id"), "text", "embedding")
    asked = base._questions(spark, sf_dir).join(vectors.select(F.col("doc_id").alias("qid"), F.col("embedding").alias("query_vector")), "qid")
    corpus = retrieval.Corpus.build(scratch.cut(chunks, "corpus"))
    return _longs(retrieval.hybrid_search(corpus, asked).select("qid", "chunk_id", "rank", "rrf_score", "dense_rank", "bm25_rank"))


# ---- answers ------------------------------------------------------------------

class TryingGenerator:
    """Answers by the length of the question: well; badly, then well; badly twice; with an error."""

    def is_available(self) -> bool:
        return True

    def generate(self, system: str, prompt: str) -> str:
        question = prompt.split("CÂU HỎI:\n\n", 1)[1].split(f"\n\n{an.RULE}", 1)[0]
        how = len(question) % 4
        if how == 3:
            raise RuntimeError("no answer")
        return "Xem [S1][S2]." if how == 0 or how == 1 and "YÊU CẦU SỬA:" in prompt else "Xem [S9]." if how == 2 else "Không có nguồn."


_RERANKED = f"""{_POSTINGS}, cand as ({_ranked('scored', 20)}),
wd as (select r.qid, r.chunk_id, list_distinct({base._WORDS.format("b.text")}) as q, list_distinct(list_slice({base._WORDS.format("d.text")}, 1, 512)) as t from cand r join benchmark b on b.item_id = r.qid join documents d on d.doc_id::varchar = r.chunk_id),
sc as (select qid, chunk_id, round(10.0::double * len(list_intersect(q, t)) / len(q) - 5, 6) as rerank_score from wd),
best as (select * from (select *, row_number() over (partition by qid order by rerank_score desc, chunk_id) as rank from sc) where rank <= 5),
blocks as (select qid, rank, '[S' || rank || ']' || chr(10) || 'Điều: None' || chr(10) || 'Khoản: None' || chr(10) || 'Trang: None-None' || chr(10) || 'Chunk ID: ' || chunk_id || chr(10) || 'Nội dung:' || chr(10) || trim(d.text, ' ' || chr(9) || chr(10) || chr(13)) as block from best join documents d on d.doc_id::varchar = chunk_id),
context as (select qid, count(*) as n, string_agg(block, chr(10) || chr(10) || repeat('=', 30) || chr(10) || chr(10) order by rank) as context, string_agg('[S' || rank || ']', ', ' order by rank) as allowed from blocks group by 1)"""


def _reranked(spark, sf_dir) -> DataFrame:
    docs, asked = base._docs(spark, sf_dir), base._questions(spark, sf_dir)
    found = bm25.search(bm25.build_index(docs), asked).join(docs, "chunk_id").join(asked, "qid")
    none = F.lit(None).cast("string")
    return scratch.cut(fusion.rerank(found.withColumns({c: none for c in ("article_number", "clause", "page_start", "page_end")}), 5), "reranked")


@query(f"""with {_RERANKED}, top as (select item_id as qid, text as question, chunk_id, rerank_score, length(text) % 4 as how from benchmark left join best on item_id = qid and rank = 1)
select qid, case when coalesce(rerank_score, '-inf'::double) < 0.7690 then 'abstain' when how < 2 then 'answered' when how = 2 then 'citation_validation_failed' else 'generation_error' end as status,
       case when coalesce(rerank_score, '-inf'::double) < 0.7690 then '{an.ABSTENTION}' when how < 2 then 'Xem [S1][S2].' when how = 2 then '{an.REFUSAL}' end as answer,
       case when coalesce(rerank_score, '-inf'::double) < 0.7690 then 0 when how in (0, 3) then 1 else 2 end::bigint as attempts, chunk_id as top_chunk_id,
       case when coalesce(rerank_score, '-inf'::double) >= 0.7690 and how = 3 then 'RuntimeError: no answer' end as generation_error from top""")
def answers(spark, sf_dir):
    """Every outcome of guardrail, generation, citation check and repair, over the reranked passages of each benchmark item."""
    made = an.answer(base._questions(spark, sf_dir), _reranked(spark, sf_dir), TryingGenerator())
    return _longs(made.select("qid", "status", "answer", "attempts", "top_chunk_id", "generation_error"))


@query(f"with {_RERANKED} select item_id as qid, chunk_id as top_chunk_id, coalesce(rerank_score, '-inf'::double) >= 0.7690 as supported, coalesce(rerank_score, '-inf'::double) as top1_score, case when coalesce(rerank_score, '-inf'::double) >= 0.7690 then 'answer' else 'abstain' end as action, case when coalesce(rerank_score, '-inf'::double) < 0.7690 then '{an.ABSTENTION}' end as message from benchmark left join best on item_id = qid and rank = 1")
def guarded_questions(spark, sf_dir):
    """The decision on each question's best passage, and what the user is told."""
    judged = an.decide(base._questions(spark, sf_dir), _reranked(spark, sf_dir))
    return judged.select("qid", "top_chunk_id", "guardrail.supported", "guardrail.top1_score", "guardrail.action", an.abstention_message(F.col("guardrail.supported")).alias("message"))


_PROMPT = "'CONTEXT:' || chr(10) || chr(10) || context || chr(10) || chr(10) || repeat('=', 30) || chr(10) || chr(10) || 'CÂU HỎI:' || chr(10) || chr(10) || text || chr(10) || chr(10) || repeat('=', 30) || chr(10) || chr(10) || 'Các citation hợp lệ: ' || allowed || chr(10) || chr(10) || 'Hãy trả lời chỉ dựa trên CONTEXT. Mỗi thông tin pháp lý quan trọng phải có citation [Sx].'"


@query(f"with {_RERANKED} select qid, md5({_PROMPT} || case when qid % 2 = 1 then chr(10) || chr(10) || repeat('=', 30) || chr(10) || chr(10) || 'YÊU CẦU SỬA:' || chr(10) || chr(10) || 'lại' else '' end) as prompt from context join benchmark on item_id = qid")
def user_prompts(spark, sf_dir):
    """What the generator reads for each question, every other one with feedback."""
    made = an.build_context(_reranked(spark, sf_dir)).join(base._questions(spark, sf_dir), "qid")
    prompt = an.user_prompt(F.col("question"), F.col("context"), F.col("allowed_source_ids"), F.when(F.col("qid") % 2 == 1, "lại").otherwise(""))
    return made.select("qid", F.md5(prompt.cast("binary")).alias("prompt"))


@query(r"""
with a as (select conv_id, turn, text || case turn % 3 when 0 then '' when 1 then ' [S7] [s02]' else ' [S1]' end as answer from conversations),
c as (select conv_id, turn, list_distinct(list_transform(regexp_extract_all(answer, '(?i)\[S(\d+)\]', 1), lambda x: 'S' || x::bigint)) as cited from a)
select conv_id, turn, case when len(list_filter(cited, lambda x: x not in ('S1', 'S2'))) > 0 then 'Câu trả lời trước đã sử dụng citation không tồn tại: ' || array_to_string(list_transform(list_filter(regexp_extract_all(' [S7]', 'S\d+'), lambda x: list_contains(cited, x)), lambda x: '[' || x || ']'), ', ') || '. Hãy tạo lại câu trả lời. Chỉ được sử dụng: [S1], [S2].'
  when len(cited) = 0 then 'Câu trả lời trước chưa có citation. Hãy tạo lại câu trả lời và trích dẫn ít nhất một nguồn phù hợp. Chỉ được sử dụng: [S1], [S2].' else 'Hãy tạo lại câu trả lời chỉ dựa trên các nguồn được cung cấp.' end as feedback from c""")
def repair_feedback(spark, sf_dir):
    """What the generator is told after an answer made from each conversation turn."""
    turn = F.col("turn")
    made = _t(spark, sf_dir, "conversations").withColumn("answer", F.concat("text", F.when(turn % 3 == 0, "").when(turn % 3 == 1, " [S7] [s02]").otherwise(" [S1]")))
    checked = made.withColumn("v", an.validate_citations(F.col("answer"), F.array(F.lit("S1"), F.lit("S2"))))
    return checked.select("conv_id", "turn", an.retry_feedback(F.col("v")).alias("feedback"))


# ---- pages --------------------------------------------------------------------

@query(r"""
with a as (select page_id, regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'), '(?is)<head\b.*?</head\s*>', ' ', 'g') as h from pages),
b as (select page_id, regexp_replace(regexp_replace(h, '(?i)<(br|/p|/div|/li|/h[1-6]|/tr)\b[^>]*>', chr(10), 'g'), '<[^>]*>', ' ', 'g') as h from a),
c as (select page_id, regexp_replace(replace(replace(replace(h, '&quot;', '"'), '&middot;', '·'), '&copy;', '©'), '&amp;?', '&', 'g') as h from b),
d as (select page_id, array_to_string(list_filter(list_transform(string_split(h, chr(10)), lambda x: trim(regexp_replace(x, '[^\S\n]+', ' ', 'g'))), lambda x: x <> ''), chr(10)) as text from c)
select page_id::varchar as document_id, 1::bigint as page, length(text)::bigint as char_count, md5(text) as text from d""")
def html_extraction(spark, sf_dir):
    """Visible text of all pages."""
    found = io.html_pages(_t(spark, sf_dir, "pages"))
    return _longs(found.select("document_id", "page", "char_count", F.md5(F.col("text").cast("binary")).alias("text")))


# ---- soft routing -------------------------------------------------------------

_ENTITY_OF = "string_split((select text from benchmark o where o.item_id = (b.item_id + 1) % (select count(*) from benchmark)), ' ')[3]"


@query(f"""with {_POSTINGS}, cand as ({_ranked('scored', 5)}), asked_for as (select item_id as qid, {_ENTITY_OF} as entity from benchmark b),
holds as (select qid, entity, doc_id::varchar as chunk_id, round(((doc_id * 37 + qid * 11) % 101) / 101, 6) as score from asked_for join documents on contains(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), lower(entity))),
best as (select * from (select *, row_number() over (partition by qid order by score desc, chunk_id) as nth from holds) where nth = 1),
missing as (select best.* from best where qid not in (select cand.qid from cand join holds on cand.qid = holds.qid and cand.chunk_id = holds.chunk_id)),
counts as (select item_id as qid, count(c.chunk_id) as n from benchmark left join cand c on c.qid = item_id group by 1),
kept as (select c.qid, c.chunk_id, c.rank, false as routing_added, null::varchar as routing_reason from cand c left join missing m on m.qid = c.qid join counts on counts.qid = c.qid where c.rank <= 5 - (case when m.qid is not null and n = 5 then 1 else 0 end))
select qid, chunk_id, rank::bigint as rank, routing_added, routing_reason from kept
union all select m.qid, m.chunk_id, least(n, 4) + 1, true, 'soft_entity:' || entity from missing m join counts using (qid)""")
def soft_routed(spark, sf_dir):
    """The best passages of each benchmark item, with the best one that holds a word of the next item where none does."""
    i = F.col("item_id")
    items = _t(spark, sf_dir, "benchmark").select("item_id", F.split("text", " ")[2].alias("word"))
    n = items.count()
    entities = items.select(((i + n - 1) % n).alias("qid"), F.array("word").alias("entities"), F.lit(5).alias("candidate_top_k"))
    docs = base._docs(spark, sf_dir)
    found = bm25.search(bm25.build_index(docs), base._questions(spark, sf_dir), 5)
    none = F.lit(None)
    found = found.select("qid", "chunk_id", "rank", F.lit(0.0).alias("rrf_score"), none.cast("int").alias("dense_rank"), none.cast("double").alias("dense_score"), F.col("rank").alias("bm25_rank"), F.col("score").alias("bm25_score"))
    holding = fusion.entity_matches(entities.select(F.explode("entities").alias("entity")), docs)
    scored = entities.select("qid", F.explode("entities").alias("entity")).join(holding, "entity")
    scored = scored.select("qid", "chunk_id", F.round(((F.col("chunk_id").cast("long") * 37 + F.col("qid") * 11) % 101) / 101, 6).alias("score")).distinct()
    return _longs(fusion.soft_entities(found, entities, docs, scored).select("qid", "chunk_id", "rank", "routing_added", "routing_reason"))
