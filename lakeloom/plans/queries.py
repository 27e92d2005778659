"""Queries of the core's operators over the test tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom import providers
from lakeloom.functions import text as T
from lakeloom.functions import vectors as V
from lakeloom.operators import corpus, fulltext, language, links, pages, questions, rag, snapshots, telemetry, vectors
from lakeloom.session import materialize
from lakeloom.streaming import snapshots as streams

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# ---- pieces of SQL
WS = r"[\s\x0b\x{1C}-\x{1F}\x{85}\p{Z}]"
BREAK = r"\r\n|[\n\r\x0b\x0c\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"


def _strip(e: str) -> str:
    return f"regexp_replace({e}, '^{WS}+|{WS}+$', '', 'g')"


def _words(e: str) -> str:
    return f"list_filter(regexp_split_to_array({e}, '{WS}+'), lambda w: w <> '')"


def _tokens(e: str) -> str:
    return f"list_filter(regexp_split_to_array(lower(coalesce({e}, '')), '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+'), lambda w: w <> '')"


def _lines(e: str) -> str:
    return f"coalesce(array_to_string(list_filter(list_transform(regexp_split_to_array({e}, '{BREAK}'), lambda l: {_strip('l')}), lambda l: l <> ''), chr(10)), '')"


def _heading(e: str) -> str:
    return f"coalesce(nullif({_lines(e)}, ''), '{T.PLACEHOLDER}')"


def _question(e: str) -> str:
    one = f"regexp_replace({_strip(e)}, '{WS}+', ' ', 'g')"
    return f"{_strip(f'''regexp_replace({one}, '[?.!]+$', '')''')} || '?'"


def _uuid(name: str) -> str:
    h = f"sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode({name}))"
    v = f"substr('89ab', cast(('0x' || substr({h}, 17, 1)) as integer) % 4 + 1, 1)"
    return f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || {v} || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)"


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _passes(q: str) -> str:
    lean = "|".join(questions.LEANING)
    return f"len({_words(q)}) between 5 and 18 and not regexp_matches(lower({q}), '(^|[^\\p{{L}}\\p{{M}}\\p{{N}}_])({lean})($|[^\\p{{L}}\\p{{M}}\\p{{N}}_])') and len(list_filter({_list(questions.DOMAIN_TERMS)}, lambda t: contains(lower({q}), t))) > 0"


# ---- text
@_query(f"select doc_id, {_strip('''replace(coalesce(text, ''), chr(160), ' ')''')} as clean from documents")
def text_sanitize(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", T.sanitize(F.col("text")).alias("clean"))


@_query(f"select sec_id, {_heading('heading')} as heading_clean from section_lookup")
def text_collapse_lines(spark, sf_dir):
    return _read(spark, sf_dir, "section_lookup").select("sec_id", T.heading(F.col("heading")).alias("heading_clean"))


@_query(f"select doc_id, case when length(text) <= 200 then text else regexp_replace(left(text, 200), '{WS}+$', '') || '…' end as short from documents")
def text_truncate(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", T.truncate(F.col("text"), 200).alias("short"))


@_query(f"select doc_id, cast(len({_words('''coalesce(text, '')''')}) as integer) as n_words from documents")
def word_count(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", T.word_count(F.col("text")).alias("n_words"))


@_query(f"select doc_id, cast(len({_tokens('text')}) as integer) as n_tokens, cast(len(list_distinct({_tokens('text')})) as integer) as n_distinct from documents")
def tokenize(spark, sf_dir):
    t = T.tokens(F.col("text"))
    return _read(spark, sf_dir, "documents").select("doc_id", F.size(t).alias("n_tokens"), F.size(F.array_distinct(t)).alias("n_distinct"))


@_query("select sec_id, cast(case when length(content) < 500 then 3 when length(content) < 1500 then 5 else 8 end as integer) as n_questions, left(content, 2500) as prompt_text from section_lookup where content is not null")
def q_budget(spark, sf_dir):
    rows = _read(spark, sf_dir, "section_lookup").filter("content is not null")
    return rows.select("sec_id", T.question_budget(F.length("content")).alias("n_questions"), F.left("content", F.lit(2500)).alias("prompt_text"))


@_query(f"select doc_id, {_uuid('''coalesce(link, '') || '::' || coalesce(title, '')''')} as uuid from documents")
def doc_id(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", T.doc_id(F.col("link"), F.col("title")).alias("uuid"))


@_query("select event_id, printf('%d:%02d:%02d', s // 3600, (s // 60) % 60, s % 60) as duration from (select event_id, greatest(0, cast(floor(value) as bigint)) as s from events where value is not null)")
def fmt_duration(spark, sf_dir):
    return _read(spark, sf_dir, "events").filter("value is not null").select("event_id", T.duration(F.col("value")).alias("duration"))


_URL = r"^([A-Za-z][A-Za-z0-9+.\-]*://)([^/?#]*)(.*)$"
_CANONICAL = f"""case when regexp_matches(l, '{_URL}') then lower(regexp_extract(l, '{_URL}', 1)) || regexp_replace(lower(regexp_extract(l, '{_URL}', 2)), ':443$', '') || regexp_extract(l, '{_URL}', 3) else nullif(l, '') end"""


@_query(f"select distinct link, {_CANONICAL} as canonical from (select link, {_strip('link')} as l from corpus_snapshots)")
def url_canonical(spark, sf_dir):
    return _read(spark, sf_dir, "corpus_snapshots").select("link", T.canonical_link(F.col("link")).alias("canonical")).distinct()


# ---- links and pages
@_query(f"select distinct strftime(snapshot_date, '%Y-%m-%d') as snapshot, {_strip('link')} as path from corpus_snapshots where {_strip('link')} <> ''")
def link_scan(spark, sf_dir):
    rows = _read(spark, sf_dir, "corpus_snapshots").select(F.date_format("snapshot_date", "yyyy-MM-dd").alias("snapshot"), T.strip(F.col("link")).alias("path"))
    return rows.filter("path <> ''").distinct()


def _paths(spark, sf_dir) -> DataFrame:
    return _read(spark, sf_dir, "section_lookup").select(F.regexp_extract("link", r"^[a-z]+://[^/]+(/.*)$", 1).alias("path"))


_PATHS = "(select coalesce(regexp_extract(link, '^[a-z]+://[^/]+(/.*)$', 1), '') as path from section_lookup)"


@_query(f"select distinct path from {_PATHS} where path like '/%' and not path like '/nyheder%' and not contains(path, 'localLink') and not contains(path, '#') and not path like '%.pdf' and not path like '%.png'")
def link_filter(spark, sf_dir):
    return _paths(spark, sf_dir).filter(links.is_followed(F.col("path"))).distinct()


@_query(f"select distinct regexp_replace(split_part(path, '#', 1), '/+$', '') as path from {_PATHS} where path like '/%' and not path like '/english%' and not path like '/nyheder%'")
def link_filter_legacy(spark, sf_dir):
    return _paths(spark, sf_dir).filter(links.is_followed_legacy(F.col("path"))).select(links.without_anchor(F.col("path")).alias("path")).distinct()


@_query("select raw_id, etag, length(payload) as n_chars from raw_pages where payload is not null")
def page_scan(spark, sf_dir):
    return _read(spark, sf_dir, "raw_pages").filter("payload is not null").select("raw_id", "etag", F.length("payload").cast("bigint").alias("n_chars"))


def _escaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _html(spark, sf_dir) -> DataFrame:
    """Every document as a page: its title as h1, short lines as h2, other lines as unclosed paragraphs."""
    part = lambda x: F.when(F.length(x) < 40, F.concat(F.lit("<h2>"), _escaped(x), F.lit("</h2>"))).otherwise(F.concat(F.lit("<p class='x'>"), _escaped(x)))
    body = F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), part), "\n")
    head = F.lit("<html><head><title>t</title><script>var a = '</p><p>no';</script></head><body><nav><ul><li>menu</ul></nav><article><h1>")
    return _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.concat(head, _escaped(F.coalesce("title", F.lit(""))), F.lit("</h1>"), body, F.lit("</article><footer><p>foot</footer></body></html>")).alias("html"))


_ONE = f"regexp_replace({_strip('x')}, '{WS}+', ' ', 'g')"
_BLOCKS = f"""(select page_id, row_number() over (partition by page_id order by i) - 1 as pos, tag, t as text from (
  select page_id, i, tag, {_ONE} as t from (
    select doc_id as page_id, 0 as i, 'h1' as tag, coalesce(title, '') as x from documents
    union all select page_id, i, case when length(x) < 40 then 'h2' else 'p' end, x from (select doc_id as page_id, unnest(range(1, len(p) + 1)) as i, unnest(p) as x from (select doc_id, string_split(coalesce(text, ''), chr(10)) as p from documents)))) where t <> '')"""
_QUIET = " and ".join(f"not contains(lower(text), '{p}')" for p in pages.NOISE_PHRASES)


@_query(f"select page_id, cast(pos as integer) as pos, tag, text from {_BLOCKS} where {_QUIET}")
def page_blocks(spark, sf_dir):
    return pages.page_blocks(_html(spark, sf_dir))


@_query(f"""
select page_id, row_number() over (partition by page_id order by run) - 1 as section_index, heading, content from (
  select page_id, run, max(case when tag <> 'p' then text end) as heading, string_agg(case when tag = 'p' then text end, ' ' order by pos) as content
  from (select *, sum(case when tag <> 'p' then 1 else 0 end) over (partition by page_id order by pos) as run from {_BLOCKS} where {_QUIET})
  group by page_id, run) where content is not null""")
def page_sections(spark, sf_dir):
    return pages.page_sections(_html(spark, sf_dir))


@_query("select sec_id, " + " or ".join(f"contains(lower(content), '{p}')" for p in pages.NOISE_PHRASES) + " as noise from section_lookup where content is not null")
def noise_filter(spark, sf_dir):
    return _read(spark, sf_dir, "section_lookup").filter("content is not null").select("sec_id", pages.is_noise(F.col("content")).alias("noise"))


# ---- corpus
_DAY = "strftime(snapshot_date, '%Y-%m-%d') as snapshot"
_DOC_TEXT = f"coalesce(array_to_string(list_transform(sections, lambda s: {_heading('s.heading')} || chr(10) || coalesce(s.content, '')), chr(10) || chr(10)), '')"


@_query(f"select {_DAY}, doc_id, {_strip(_DOC_TEXT)} as text, cast(len(sections) as integer) as n_sections from corpus_snapshots where sections is not null")
def doc_aggregate(spark, sf_dir):
    rows = _read(spark, sf_dir, "corpus_snapshots").filter("sections is not null")
    return rows.select(F.date_format("snapshot_date", "yyyy-MM-dd").alias("snapshot"), "doc_id", corpus.document_text(F.col("sections")).alias("text"), F.size("sections").alias("n_sections"))


@_query(f"select snapshot, doc_id, cast(i - 1 as integer) as section_index, {_heading('sections[i].heading')} as heading, sections[i].content as content from (select {_DAY}, doc_id, sections, unnest(range(1, len(sections) + 1)) as i from corpus_snapshots)")
def corpus_sections(spark, sf_dir):
    rows = _read(spark, sf_dir, "corpus_snapshots").withColumn("snapshot", F.date_format("snapshot_date", "yyyy-MM-dd"))
    return corpus.corpus_sections(rows, ["snapshot", "doc_id"])


_LOOKUP = "(select * from section_lookup where doc_id is not null and section_index is not null qualify row_number() over (partition by doc_id, section_index order by scraped_at desc nulls last, content desc nulls last) = 1)"


@_query(f"select doc_id, section_index, sec_id, content from {_LOOKUP}")
def dedup_last_wins(spark, sf_dir):
    return corpus.lookup(_read(spark, sf_dir, "section_lookup")).select("doc_id", "section_index", "sec_id", "content")


@_query("""
select doc_id, cast(i as integer) as chunk_no, substr(text, i * 450 + 1, 500) as chunk
from (select doc_id, text, unnest(range(0, greatest(0, cast(ceil((length(text) - 50) / 450.0) as bigint) - 1) + 1)) as i from documents where length(text) > 0)""")
def chunk_text(spark, sf_dir):
    return corpus.chunks(_read(spark, sf_dir, "documents"), "doc_id", "text")


@_query()
def chunk_paragraphs(spark, sf_dir):
    return corpus.paragraph_chunks(_read(spark, sf_dir, "documents"), "doc_id", "text")


# ---- questions
@_query(f"select row_idx, {_question('question')} as question_clean from question_meta where question is not null")
def q_normalize(spark, sf_dir):
    return _read(spark, sf_dir, "question_meta").filter("question is not null").select("row_idx", T.normalize_question(F.col("question")).alias("question_clean"))


@_query("select row_idx, not regexp_matches(lower(question), '(^|[^\\p{L}\\p{M}\\p{N}_])(" + "|".join(questions.LEANING) + ")($|[^\\p{L}\\p{M}\\p{N}_])') as ok from question_meta where question is not null")
def q_self_contained(spark, sf_dir):
    return _read(spark, sf_dir, "question_meta").filter("question is not null").select("row_idx", questions.is_self_contained(F.col("question")).alias("ok"))


@_query(f"select row_idx, len(list_filter({_list(questions.DOMAIN_TERMS)}, lambda t: contains(lower(question), t))) > 0 as ok from question_meta where question is not null")
def q_domain(spark, sf_dir):
    return _read(spark, sf_dir, "question_meta").filter("question is not null").select("row_idx", questions.has_domain_term(F.col("question")).alias("ok"))


_ALL_Q = "list_transform(coalesce(questions, []), lambda q: " + _question("coalesce(q, '')") + ")"
_GOOD_Q = f"list_filter(c, lambda q: {_passes('q')})"


@_query(f"select doc_id, section_index, generated_at, array_to_string(case when len({_GOOD_Q}) > 0 then {_GOOD_Q} else c[1:1] end, '|') as kept from (select *, {_ALL_Q} as c from hqe_records)")
def q_quality(spark, sf_dir):
    return _read(spark, sf_dir, "hqe_records").select("doc_id", "section_index", "generated_at", F.array_join(questions.quality(F.col("questions")), "|").alias("kept"))


def _jaccard(a: str, b: str) -> str:
    return f"case when len({a}) = 0 and len({b}) = 0 then 1.0 else len(list_intersect({a}, {b})) / greatest(1, len(list_distinct({a} || {b}))) end"


_ALIKE = _jaccard(f"list_distinct({_tokens('k')})", f"list_distinct({_tokens('x[1]')})")


@_query(f"""select doc_id, section_index, generated_at, cast(len(c) as integer) as n, cast(len(kept) as integer) as n_kept, array_to_string(kept, '|') as kept from (
  select *, case when len(c) = 0 then [] else list_reduce(list_transform(c, lambda q: [q]), lambda kept, x: case when len(list_filter(kept, lambda k: {_ALIKE} >= 0.8)) = 0 then kept || x else kept end) end as kept
  from (select *, list_filter(coalesce(questions, []), lambda q: q is not null) as c from hqe_records))""")
def q_dedup(spark, sf_dir):
    clean = F.filter(F.coalesce("questions", F.array().cast("array<string>")), lambda q: q.isNotNull())
    kept = questions.distinct_enough(clean, 0.8)
    return _read(spark, sf_dir, "hqe_records").select("doc_id", "section_index", "generated_at", F.size(clean).alias("n"), F.size(kept).alias("n_kept"), F.array_join(kept, "|").alias("kept"))


@_query(f"""
with q as (select distinct row_idx, doc_id, section_index, list_distinct({_tokens('question')}) as t from question_meta where question is not null)
select a.row_idx as row_idx_a, b.row_idx as row_idx_b, round(case when len(a.t) = 0 and len(b.t) = 0 then 1.0 else len(list_intersect(a.t, b.t)) / greatest(1, len(list_distinct(a.t || b.t))) end, 6) as jaccard
from q a join q b on a.doc_id = b.doc_id and a.section_index = b.section_index and a.row_idx < b.row_idx""")
def jaccard_pairs(spark, sf_dir):
    q = _read(spark, sf_dir, "question_meta").filter("question is not null").select("row_idx", "doc_id", "section_index", F.array_distinct(T.tokens(F.col("question"))).alias("t")).distinct()
    b = q.select(F.col("row_idx").alias("row_idx_b"), "doc_id", "section_index", F.col("t").alias("u"))
    return q.join(b, ["doc_id", "section_index"]).filter("row_idx < row_idx_b").select(F.col("row_idx").alias("row_idx_a"), "row_idx_b", F.round(T.jaccard(F.col("t"), F.col("u")), 6).alias("jaccard"))


@_query(f"select doc_id, section_index, generated_at, coalesce(array_to_string(list_filter(questions, lambda q: q is not null and {_strip('q')} <> ''), '|'), '') as parsed from hqe_records")
def json_questions(spark, sf_dir):
    return _read(spark, sf_dir, "hqe_records").select("doc_id", "section_index", "generated_at", F.array_join(questions.parsed_list(F.to_json("questions", {"ignoreNullFields": "false"})), "|").alias("parsed"))


_VOTES = "len(list_filter({t}, lambda w: list_contains({l}, w)))"
_DA, _EN = (_VOTES.format(t="t", l=_list(x)) for x in (language.DANISH, language.ENGLISH))


@_query(f"select doc_id, case when {_DA} > {_EN} then 'da' when {_EN} > {_DA} then 'en' else 'da' end as detected from (select doc_id, {_tokens('text')} as t from documents)")
def lang_detect(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", language.detected(F.col("text")).alias("detected"))


@_query()
def hqe_records(spark, sf_dir):
    made = providers.hqe_records(corpus.lookup(_read(spark, sf_dir, "section_lookup")), generated_at="2026-01-01T00:00:00Z")
    return made.select("doc_id", "section_index", "language", "gen_model", "prompt_version", "generated_at", F.array_join("questions", "|").alias("questions"), F.col("meta.source").alias("source"), F.array_join("meta.combined_headings", "|").alias("combined_headings"), F.col("meta.section_char_len").alias("section_char_len"))


_KEY = "coalesce(doc_id, '') || '::' || section_index || '::' || (i - 1)"


@_query(f"""select 'hqe:' || doc_id || ':' || section_index || ':' || {_uuid(_KEY)} as id, doc_id, section_index, cast(i - 1 as integer) as ordinal, {_strip('questions[i]')} as question,
  meta.source as source, meta.page_title as page_title, meta.section_heading as section_heading, meta.section_char_len as section_char_len
from (select *, unnest(range(1, len(questions) + 1)) as i from hqe_records) where {_strip('''coalesce(questions[i], '')''')} <> ''""")
def hqe_flatten(spark, sf_dir):
    return questions.flatten_questions(_read(spark, sf_dir, "hqe_records"))


@_query("select row_idx, row_idx // 128 as batch_no, row_idx % 128 as place from question_meta")
def batch_assign(spark, sf_dir):
    return corpus.batches(_read(spark, sf_dir, "question_meta").select("row_idx"), "row_idx")


# ---- vectors
@_query("select vec_id, cast(len(embedding) as integer) as dim, cast('default' as varchar) as model from embeddings")
def embedding_scan(spark, sf_dir):
    return _read(spark, sf_dir, "embeddings").select("vec_id", F.size("embedding").alias("dim"), V.model_of(F.size("embedding")).alias("model"))


@_query("select count(*) as n_rows, min(len(embedding)) as least_dim, max(len(embedding)) as most_dim, cast(sum(case when embedding is null then 1 else 0 end) as bigint) as n_null from question_vectors")
def embedding_stats(spark, sf_dir):
    return vectors.embedding_stats(_read(spark, sf_dir, "question_vectors"), "embedding")


@_query()
def embed_hash(spark, sf_dir):
    embed = providers.embed_column(providers.HashedWords())
    rows = _read(spark, sf_dir, "documents").select("doc_id", embed(F.col("text")).alias("v"))
    return rows.select("doc_id", F.size("v").alias("dim"), F.round(V.norm(F.col("v")), 4).alias("norm"))


_DOT = "list_dot_product(cast(q.embedding as double[]), cast(e.embedding as double[]))"
_BATCH = "select vec_q, vec_id, round({sign}s, 6) as score, rank from (select q.vec_id as vec_q, e.vec_id, {s} as s, row_number() over (partition by q.vec_id order by round({s}, 12) {dir}, e.vec_id) as rank from embeddings q join embeddings e on q.vec_id % 50 = 0) where rank <= 5"


def _batch(spark, sf_dir, metric: str) -> DataFrame:
    e = _read(spark, sf_dir, "embeddings")
    q = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("vec_q"), "embedding")
    return vectors.top_k_batch(e, q, "vec_id", "embedding", "vec_q", 5, metric).select("vec_q", "vec_id", F.round("score", 6).alias("score"), "rank")


@_query(f"select e.vec_id, round({_DOT}, 6) as score from embeddings e, (select embedding from embeddings order by vec_id limit 1) q order by {_DOT} desc, e.vec_id limit 10")
def vector_topk(spark, sf_dir):
    e = _read(spark, sf_dir, "embeddings")
    query = e.orderBy("vec_id").select("embedding").first()[0]
    return vectors.top_k(e, "vec_id", "embedding", query, 10).select("vec_id", F.round("score", 6).alias("score"))


@_query(_BATCH.format(s=_DOT, dir="desc", sign=""))
def vector_topk_batch(spark, sf_dir):
    return _batch(spark, sf_dir, "dot")


@_query(_BATCH.format(s="list_cosine_similarity(cast(q.embedding as double[]), cast(e.embedding as double[]))", dir="desc", sign=""))
def vector_cosine(spark, sf_dir):
    return _batch(spark, sf_dir, "cosine")


@_query(_BATCH.format(s="pow(list_distance(cast(q.embedding as double[]), cast(e.embedding as double[])), 2)", dir="", sign=""))
def vector_l2(spark, sf_dir):
    return _batch(spark, sf_dir, "l2").withColumn("score", F.abs("score"))


# ---- retrieval
_USABLE = "(select row_idx, any_value(embedding) as embedding from question_vectors where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or isnan(x))) = 0 group by row_idx)"
_META = "(select * from question_meta qualify row_number() over (partition by row_idx order by question desc nulls last) = 1)"
_HITS = f"(select * from (select q.row_idx as query_id, e.row_idx, {_DOT} as score, row_number() over (partition by q.row_idx order by round({_DOT}, 12) desc, e.row_idx) as rank from {_USABLE} q join {_USABLE} e on q.row_idx % 50 = 0 where {_DOT} >= 0.0) where rank <= 4)"
_JOINED = f"""(select h.query_id, h.rank, h.row_idx, h.score, m.doc_id, m.section_index, s.sec_id is not null as found,
  case when s.sec_id is not null then s.title else coalesce(nullif(m.page_title, ''), '{rag.UNKNOWN_TITLE}') end as title,
  case when s.sec_id is not null then s.heading else coalesce(nullif(m.section_heading, ''), '{T.PLACEHOLDER}') end as heading,
  case when s.sec_id is not null then s.link else coalesce(m.source, '') end as link,
  case when s.sec_id is not null then s.content else coalesce(nullif(m.aggregated_content, ''), '{T.PLACEHOLDER}' || chr(10) || coalesce(m.question, '')) end as content
  from {_HITS} h join {_META} m using (row_idx) left join {_LOOKUP} s on m.doc_id = s.doc_id and m.section_index = s.section_index)"""


def _usable(spark, sf_dir) -> DataFrame:
    rows = _read(spark, sf_dir, "question_vectors").filter(F.size("embedding") == 64).filter(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x)))
    return rows.groupBy("row_idx").agg(F.max("embedding").alias("embedding"))


def _hits(spark, sf_dir) -> DataFrame:
    v = _usable(spark, sf_dir)
    q = v.filter("row_idx % 50 = 0").select(F.col("row_idx").alias("query_id"), "embedding")
    return vectors.top_k_batch(v, q, "row_idx", "embedding", "query_id", 4, min_score=0.0)


def _joined(spark, sf_dir) -> DataFrame:
    meta = corpus.last_wins(_read(spark, sf_dir, "question_meta"), ["row_idx"], [F.col("question")])
    hits = materialize(_hits(spark, sf_dir), "hits")
    wanted = meta.join(hits.select("row_idx").distinct(), "row_idx", "left_semi")
    wanted = materialize(wanted, "wanted")
    # only sections that a hit refers to are looked up
    sections = _read(spark, sf_dir, "section_lookup").join(wanted.select("doc_id", "section_index").distinct(), ["doc_id", "section_index"], "left_semi")
    return rag.with_sections(hits, wanted, corpus.lookup(sections))


@_query(f"select query_id, row_idx, round(score, 6) as score, rank from {_HITS}")
def rag_retrieve(spark, sf_dir):
    return _hits(spark, sf_dir).select("query_id", "row_idx", F.round("score", 6).alias("score"), "rank")


@_query(f"select query_id, rank, row_idx, doc_id, section_index, found, title, heading, link, content from {_JOINED}")
def rag_lookup_join(spark, sf_dir):
    return _joined(spark, sf_dir).drop("score")


def _cut(x: str, n: str) -> str:
    return f"regexp_replace(left({x}, {n}), '{WS}+$', '') || '…'"


_BLOCK = f"'### ' || coalesce(nullif(title, ''), '{rag.UNKNOWN_TITLE}') || ' - ' || coalesce(nullif(heading, ''), '{T.PLACEHOLDER}') || chr(10) || 'Kilde: ' || coalesce(link, '') || chr(10) || case when length(coalesce(content, '')) <= 900 then coalesce(content, '') else {_cut('content', '900')} end"
_CONTEXT = f"""(select query_id, string_agg(b, chr(10) || chr(10) order by rank) as context, count(*) as n_blocks from (
  select query_id, rank, case when before + length(block) <= 2500 then block when before = 2500 then block else {_cut('block', 'cast(2500 - before as bigint)')} end as b
  from (select *, coalesce(sum(length(block)) over (partition by query_id order by rank rows between unbounded preceding and 1 preceding), 0) as before from (select query_id, rank, {_BLOCK} as block from {_JOINED}))
  qualify sum(case when before + length(block) > 2500 then 1 else 0 end) over (partition by query_id order by rank) - case when before + length(block) > 2500 then 1 else 0 end = 0)
  group by query_id)"""


@_query(f"select * from {_CONTEXT}")
def rag_context(spark, sf_dir):
    return rag.contexts(_joined(spark, sf_dir))


def _asked(k: str) -> str:
    task, above, below = (x.replace("'", "''") for x in rag.ASKED[k])
    return f"'{task}' || chr(10) || chr(10) || '{above}' || chr(10) || context || chr(10) || chr(10) || '{below}' || chr(10) || question"


@_query(f"""select query_id, case when {_EN} > {_DA} then {_asked('en')} else {_asked('da')} end as prompt
from (select query_id, context, question, {_tokens('question')} as t from (select c.query_id, c.context, coalesce(m.question, '') as question from {_CONTEXT} c join {_META} m on m.row_idx = c.query_id))""")
def rag_prompt(spark, sf_dir):
    meta = corpus.last_wins(_read(spark, sf_dir, "question_meta"), ["row_idx"], [F.col("question")])
    rows = rag.contexts(_joined(spark, sf_dir)).join(meta.select(F.col("row_idx").alias("query_id"), "question"), "query_id")
    return rows.select("query_id", rag.prompt(F.coalesce("question", F.lit("")), F.col("context")).alias("prompt"))


@_query()
def rag_answer(spark, sf_dir):
    meta = corpus.last_wins(_read(spark, sf_dir, "question_meta"), ["row_idx"], [F.col("question")])
    asked = meta.select(F.col("row_idx").alias("query_id"), F.coalesce("question", F.lit("")).alias("question"))
    found = rag.contexts(_joined(spark, sf_dir))
    return rag.answers(asked.join(found.select("query_id"), "query_id", "left_semi"), found, providers.FirstLines())


# ---- full text
_FIELDS = f"(select doc_id, 'title' as field, {_tokens('title')} as terms from documents union all select doc_id, 'text', {_tokens('text')} from documents)"


@_query(f"select term, field, count(*) as n_docs, cast(sum(tf) as bigint) as n_uses from (select doc_id, field, term, count(*) as tf from (select doc_id, field, unnest(terms) as term from {_FIELDS}) group by all) group by all")
def fts_index(spark, sf_dir):
    made = fulltext.postings(_read(spark, sf_dir, "documents"), "doc_id", ["title", "text"])
    return made.groupBy("term", "field").agg(F.count("*").alias("n_docs"), F.sum("tf").alias("n_uses"))


@_query(f"""
with rows as (select *, len(terms) as n from {_FIELDS}),
sizes as (select field, avg(n) as avg_len, count(distinct doc_id) as n_docs from rows group by field),
tf as (select doc_id, field, n, term, count(*) as tf from (select doc_id, field, n, unnest(terms) as term from rows) where term in ('handicaptillæg', 'spørgsmål') group by all),
df as (select term, count(distinct doc_id) as df from tf group by term)
select doc_id, round(sum(w), 6) as score from (
  select doc_id, term, case when field = 'title' then 2.0 else 1.0 end * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / avg_len)) as w
  from tf join df using (term) join sizes using (field)) group by doc_id having count(distinct term) = 2 order by round(sum(w), 6) desc, doc_id limit 10""")
def fts_search(spark, sf_dir):
    index = fulltext.Index(_read(spark, sf_dir, "documents"), "doc_id", ["title", "text"])
    return index.search("Spørgsmål, handicaptillæg?", 10, weights={"title": 2.0})


# ---- snapshots
_TWO = "(select d, row_number() over (order by d desc) as age from (select distinct snapshot_date as d from corpus_snapshots) order by d desc limit 2)"
_LATEST = f"(select * from (select c.*, {_CANONICAL} as key from (select *, {_strip('link')} as l from corpus_snapshots) c) where key is not null qualify row_number() over (partition by snapshot_date, key order by scraped_at desc nulls last, title desc nulls last) = 1)"
_OLD, _NEW = (f"(select x.* from {_LATEST} x join {_TWO} t on x.snapshot_date = t.d where t.age = {age})" for age in (2, 1))
_SECTION_TEXT = f"coalesce(array_to_string(list_transform(sections, lambda s: coalesce(s.heading, '{T.PLACEHOLDER}') || ':' || chr(10) || coalesce(s.content, '')), chr(10)), '')"
_TITLE = _strip("replace(coalesce(title, ''), chr(160), ' ')")


def _pair(side: str) -> str:
    return f"(select key, {_TITLE} as t, {_SECTION_TEXT} as s from {side})"


def _two(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = _read(spark, sf_dir, "corpus_snapshots").withColumn("key", T.canonical_link(F.col("link"))).filter("key is not null")
    days = [r[0] for r in snapshots.latest_two(rows, "snapshot_date").orderBy("day").select("day").collect()]  # two rows
    pick = lambda d: corpus.last_wins(rows.filter(F.col("snapshot_date") == F.lit(d)), ["key"], [F.col("scraped_at"), F.col("title")])
    return (pick(days[0]), pick(days[-1])) if days else (rows.limit(0), rows.limit(0))


@_query(f"select strftime(d, '%Y-%m-%d') as day, age from {_TWO}")
def latest_two_snapshots(spark, sf_dir):
    return snapshots.latest_two(_read(spark, sf_dir, "corpus_snapshots"), "snapshot_date").select(F.date_format("day", "yyyy-MM-dd").alias("day"), "age")


@_query(f"select key from {_NEW} except select key from {_OLD}")
def snapshot_added(spark, sf_dir):
    return snapshots.added(*_two(spark, sf_dir), "key")


@_query(f"select key from {_OLD} except select key from {_NEW}")
def snapshot_removed(spark, sf_dir):
    return snapshots.removed(*_two(spark, sf_dir), "key")


@_query(f"select key from {_OLD} intersect select key from {_NEW}")
def snapshot_common(spark, sf_dir):
    return snapshots.common(*_two(spark, sf_dir), "key")


@_query(f"select key from {_OLD} union select key from {_NEW}")
def snapshot_union(spark, sf_dir):
    return snapshots.union(*_two(spark, sf_dir), "key")


@_query(f"select key, case when a.t is null then 'added' when b.t is null then 'removed' when a.t = b.t and a.s = b.s then 'same' else 'changed' end as status from {_pair(_OLD)} a full outer join {_pair(_NEW)} b using (key)")
def snapshot_status(spark, sf_dir):
    return snapshots.status(*_two(spark, sf_dir), "key")


@_query(f"select key, a.t <> b.t as title_changed, a.s <> b.s as sections_changed from {_pair(_OLD)} a join {_pair(_NEW)} b using (key) where a.t <> b.t or a.s <> b.s")
def snapshot_changed(spark, sf_dir):
    return snapshots.changed(*_two(spark, sf_dir), "key")


@_query()
def snapshot_diff(spark, sf_dir):
    return snapshots.diffs(*_two(spark, sf_dir), "key")


# ---- graph and telemetry
@_query("""
with recursive e as (select distinct 's' || l_suppkey as src, 'p' || l_partkey as dst from lineitem union select distinct 'p' || l_partkey, 's' || l_suppkey from lineitem),
walk(node, depth) as (select 's1', 0 union select e.dst, depth + 1 from walk join e on e.src = walk.node where depth < 8)
select node, cast(min(depth) as integer) as depth from walk where depth > 0 group by node""")
def crawl_bfs(spark, sf_dir):
    rows = _read(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"))
    return links.reached(rows.unionByName(rows.select(F.col("dst").alias("src"), F.col("src").alias("dst"))), "s1")


@_query("""
with e as (select event_type, value as x, row_number() over (partition by event_type order by value) as i, count(*) over (partition by event_type) as n from events where value is not null),
j as (select *, greatest(1, least(9 * (n + 1) // 10, n - 1)) as j from e)
select event_type, any_value(n) as n, round(avg(x), 6) as mean, round(case when any_value(n) < 10 then max(x) else (max(case when i = j then x end) * (10 - (9 * (any_value(n) + 1) - 10 * any_value(j))) + max(case when i = j + 1 then x end) * (9 * (any_value(n) + 1) - 10 * any_value(j))) / 10 end, 6) as p90
from j group by event_type""")
def latency_p90(spark, sf_dir):
    return telemetry.latency(_read(spark, sf_dir, "events"), "event_type", "value")


@_query("""
select event_type, n_done, epoch_us(ts) / 1e6 - began as elapsed_s, case when epoch_us(ts) / 1e6 - began > 0 then round(n_done / ((epoch_us(ts) - us) / 1e6), 6) end as rate from (
  select event_type, ts, row_number() over (partition by event_type order by ts, event_id) as n_done, min(epoch_us(ts)) over (partition by event_type) / 1e6 as began, min(epoch_us(ts)) over (partition by event_type) as us from events) where n_done % 25 = 0""".replace("epoch_us(ts) / 1e6 - began as", "(epoch_us(ts) - us) / 1e6 as"))
def telemetry_progress(spark, sf_dir):
    return telemetry.progress(_read(spark, sf_dir, "events").select("event_type", "ts", "event_id"), "event_type", "ts")


# ---- streams
@_query("select distinct user_id from events")
def stream_first_seen(spark, sf_dir):
    events = streams.read_parquet(spark, f"{sf_dir}/events.parquet", "ts")
    return streams.new_keys(events.select("user_id"), "user_id").select("user_id")


@_query("select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def stream_tumbling(spark, sf_dir):
    events = streams.read_parquet(spark, f"{sf_dir}/events.parquet", "ts")
    made = streams.latest_of_updates(streams.tumbling(events, "ts", "event_type", "value"), ["window_start", "event_type"])
    return made.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))
