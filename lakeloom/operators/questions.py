"""Questions about sections: filters, duplicates, records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.functions import text as T

# Words that lean on a context, and terms of the field.
LEANING = ("this", "that", "it", "they", "these", "those", "den", "det", "de", "disse", "dette")
DOMAIN_TERMS = (
    "su", "minsu", "fribeløb", "stipendium", "digital post", "bekendtgørelse", "allowance", "grant", "income", "loan", "threshold", "udlandsstipendium", "slutløn", "handicaptillæg", "forsørgertillæg",
)
# End of fixed values.


def has_length(q: Column, least: int = 5, most: int = 18) -> Column:
    return T.word_count(q).between(least, most)


def is_self_contained(q: Column, leaning=LEANING) -> Column:
    return ~F.lower(T.strip(q)).rlike(r"(?:^|[^\p{L}\p{M}\p{N}_])(?:" + "|".join(leaning) + r")(?:$|[^\p{L}\p{M}\p{N}_])")


def has_domain_term(q: Column, terms=DOMAIN_TERMS) -> Column:
    low = F.lower(q)
    return F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(low, t))


def passes(q: Column) -> Column:
    return has_length(q) & is_self_contained(q) & has_domain_term(q)


def quality(questions: Column) -> Column:
    """Normalised questions that pass; if none does the first one normalised; empty for an empty array."""
    clean = F.transform(F.coalesce(questions, F.array().cast("array<string>")), lambda q: T.normalize_question(F.coalesce(q, F.lit(""))))
    good = F.filter(clean, passes)
    return F.when(F.size(good) > 0, good).otherwise(F.slice(clean, 1, 1))


def distinct_enough(questions: Column, at: float = 0.8) -> Column:
    """In order, each question whose token overlap with all kept ones is below `at`; the first always."""
    empty = F.array().cast("array<struct<q:string,t:array<string>>>")

    def step(kept, q):
        t = F.array_distinct(T.tokens(q))
        return F.when(F.forall(kept, lambda k: T.jaccard(k["t"], t) < at), F.concat(kept, F.array(F.struct(q.alias("q"), t.alias("t"))))).otherwise(kept)

    return F.transform(F.aggregate(questions, empty, step), lambda k: k["q"])


def parsed_list(raw: Column) -> Column:
    """The non-blank strings of a JSON array; anything else is the one raw string (nothing if blank)."""
    v = F.try_parse_json(raw)
    items = F.transform(
        F.try_variant_get(v, "$", "array<variant>"),
        lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")),
    )
    strings = F.filter(items, lambda x: x.isNotNull() & (T.strip(x) != ""))
    single = F.when(T.strip(F.coalesce(raw, F.lit(""))) != "", F.array(raw)).otherwise(F.array().cast("array<string>"))
    return F.when(F.schema_of_variant(v).startswith("ARRAY"), strings).otherwise(single)


def flatten_questions(records: DataFrame) -> DataFrame:
    """One row for each question that isn't blank: id, doc_id, section_index, ordinal, question and the record's metadata."""
    rows = records.select("doc_id", "section_index", "meta", F.posexplode("questions").alias("ordinal", "question"))
    rows = rows.filter(T.strip(F.coalesce("question", F.lit(""))) != "")
    key = F.concat_ws("::", F.coalesce("doc_id", F.lit("")), F.col("section_index").cast("string"), F.col("ordinal").cast("string"))
    return rows.select(
        F.concat_ws(":", F.lit("hqe"), F.col("doc_id"), F.col("section_index").cast("string"), T.uuid5_url(key)).alias("id"), "doc_id", "section_index", "ordinal", T.strip(F.col("question")).alias("question"),
        F.col("meta.source").alias("source"), F.col("meta.page_title").alias("page_title"), F.col("meta.section_heading").alias("section_heading"), F.col("meta.section_char_len").alias("section_char_len"),
    )
