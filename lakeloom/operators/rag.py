"""From hits to a packed context and a prompt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.functions import text as T
from lakeloom.operators.language import detected
from lakeloom.session import materialize

# The placeholder of a missing title and the layout of a context's block.
UNKNOWN_TITLE = "(ukendt titel)"
BLOCK = "### {} - {}\nKilde: {}\n{}"
# End of fixed values.


def _or(c: Column, default: Column | str) -> Column:
    """The default for null and empty values alike."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default) if isinstance(default, str) else default)


def with_sections(hits: DataFrame, meta: DataFrame, sections: DataFrame) -> DataFrame:
    """Hits (query_id, row_idx, score, rank) with title, heading, link and content of their sections, from the metadata where
    there is no section. `sections` has one row for each (doc_id, section_index), `meta` one for each row_idx."""
    m = meta.select("row_idx", "doc_id", "section_index", "question", "source", "page_title", "section_heading", "aggregated_content")
    s = sections.select("doc_id", "section_index", "title", "heading", "link", "content", F.lit(True).alias("there"))
    rows = hits.join(m, "row_idx").join(s, ["doc_id", "section_index"], "left")
    from_meta = lambda there, other: F.when(F.col("there"), there).otherwise(other)
    question = F.concat(F.lit(T.PLACEHOLDER + "\n"), F.coalesce("question", F.lit("")))
    return rows.select(
        "query_id", "rank", "row_idx", "score", "doc_id", "section_index", F.coalesce("there", F.lit(False)).alias("found"),
        from_meta(F.col("title"), _or(F.col("page_title"), UNKNOWN_TITLE)).alias("title"), from_meta(F.col("heading"), _or(F.col("section_heading"), T.PLACEHOLDER)).alias("heading"),
        from_meta(F.col("link"), F.coalesce("source", F.lit(""))).alias("link"), from_meta(F.col("content"), _or(F.col("aggregated_content"), question)).alias("content"),
    )


def block(per_section: int = 900) -> Column:
    parts = (_or(F.col("title"), UNKNOWN_TITLE), _or(F.col("heading"), T.PLACEHOLDER), F.coalesce("link", F.lit("")), T.truncate(F.coalesce("content", F.lit("")), per_section))
    between = [F.lit(x) for x in BLOCK.split("{}")]
    return F.concat(*(x for pair in zip(between, parts, strict=False) for x in pair))


def contexts(rows: DataFrame, per_section: int = 900, total: int = 2500) -> DataFrame:
    """(query_id, context, n_blocks): blocks in rank order up to `total` characters (0 or less: all).

    The first block that does not fit is cut to what is left and ends the context; separators do not count; if
    nothing at all is left, that block comes whole.
    """
    w = Window.partitionBy("query_id").orderBy("rank")  # the few hits of one query
    made = rows.withColumn("block", block(per_section)).withColumn("len", F.length("block"))
    made = made.withColumn("before", F.coalesce(F.sum("len").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    if total > 0:
        over = F.col("before") + F.col("len") > total
        # the sum over earlier rows grows strictly, so the first overflow is the only one that starts within the budget
        made = made.withColumn("n_over", F.sum(over.cast("int")).over(w)).filter((F.col("n_over") == 0) | (over & (F.col("n_over") == 1)))
        left = F.greatest(F.lit(0), F.lit(total) - F.col("before"))
        cut = F.when(left == 0, F.col("block")).otherwise(F.concat(T.rstrip(F.left(F.col("block"), left)), F.lit("…")))
        made = made.withColumn("block", F.when(over, cut).otherwise(F.col("block")))
    parts = F.array_sort(F.collect_list(F.struct("rank", "block")))
    return made.groupBy("query_id").agg(F.array_join(F.transform(parts, lambda x: x["block"]), "\n\n").alias("context"), F.count("*").alias("n_blocks"))


#: What a prompt has to achieve, by language: answers drawn from the excerpts alone, an admission where they say nothing.
ASKED = {
    "da": ("Herunder står uddrag om studiestøtte og derefter et spørgsmål. Svar på spørgsmålet ud fra uddragene, først i én sætning og så med de detaljer, der hører til, og sig, hvilken side eller lov de kommer fra. Siger uddragene det ikke, er svaret: Det fremgår ikke af kilderne.", "UDDRAG", "SPØRGSMÅL"),
    "en": ("Below are excerpts about student support and then a question. Answer the question from the excerpts, in one sentence first and then with the details that belong to it, and say which page or law they come from. If the excerpts do not say, the answer is: The sources do not tell.", "EXCERPTS", "QUESTION"),
}


def prompt(question: Column, context: Column) -> Column:
    """In the question's language, Danish unless English is found: the task, the context, the question."""
    made = {k: F.concat(F.lit(f"{task}\n\n{above}\n"), F.coalesce(context, F.lit("")), F.lit(f"\n\n{below}\n"), question) for k, (task, above, below) in ASKED.items()}
    return F.when(detected(question) == "en", made["en"]).otherwise(made["da"])


def answers(questions: DataFrame, contexts_: DataFrame, provider) -> DataFrame:
    """(query_id, question, answer) from a chat provider."""
    from lakeloom.providers import answer_column

    rows = questions.join(contexts_, "query_id", "left")
    return rows.select("query_id", "question", answer_column(provider)(prompt(F.col("question"), F.col("context"))).alias("answer"))


def score_text(score: float) -> str:
    return f"{score:.4f}"


def answered(asked: DataFrame, vectors_: DataFrame, sections: DataFrame, embedding, chat, k: int = 10, min_score: float = 0.6, per_section: int = 900, total: int = 2500) -> DataFrame:
    """(query_id, question, answer, sources) for plain question texts: embedded, checked for their length, searched, joined, packed, answered.

    Blank questions are left out. `vectors_` has row_idx, embedding and the questions' metadata, `sections` one row for each
    (doc_id, section_index). A question without a hit is answered from an empty context.
    """
    from lakeloom.operators.vectors import same_length, top_k_batch
    from lakeloom.providers import answer_column, embed_column

    rows = asked.filter(T.strip(F.coalesce("question", F.lit(""))) != "").withColumn("query_id", F.xxhash64("question")).dropDuplicates(["query_id"])
    dim = vectors_.agg(F.max(F.size("embedding"))).first()[0] or 0
    made = materialize(rows.select("query_id", "question", same_length(embed_column(embedding)(F.col("question")), dim).alias("embedding")), "asked")
    hits = top_k_batch(vectors_, made.select("query_id", "embedding"), "row_idx", "embedding", "query_id", k, min_score=min_score)
    meta = vectors_.select("row_idx", "doc_id", "section_index", "question", "source", "page_title", "section_heading", F.lit(None).cast("string").alias("aggregated_content"))
    found = materialize(with_sections(hits, meta, sections), "found")
    sources = found.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "title", "heading", "link", "score"))), lambda x: F.struct(x["title"].alias("title"), x["heading"].alias("heading"), x["link"].alias("link"), x["score"].alias("score"))).alias("sources"))
    out = made.select("query_id", "question").join(contexts(found, per_section, total), "query_id", "left").join(sources, "query_id", "left")
    answer = answer_column(chat)(prompt(F.col("question"), F.col("context")))
    return out.select("query_id", "question", answer.alias("answer"), F.coalesce("sources", F.array().cast(sources.schema["sources"].dataType)).alias("sources"))
