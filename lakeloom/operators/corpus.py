"""Documents and their sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.functions import text as T


def corpus_sections(docs: DataFrame, keep: list[str]) -> DataFrame:
    """One row for each section: `keep`, section_index from 0, heading (placeholder if empty) and content."""
    rows = docs.select(*keep, F.posexplode("sections").alias("section_index", "s"))
    return rows.select(*keep, "section_index", T.heading(F.col("s.heading")).alias("heading"), F.col("s.content").alias("content"))


def document_text(sections: Column, stripped: bool = True) -> Column:
    """Headings and contents joined, sections apart by a blank line."""
    parts = F.transform(sections, lambda s: F.concat(T.heading(s["heading"]), F.lit("\n"), F.coalesce(s["content"], F.lit(""))))
    whole = F.array_join(parts, "\n\n")
    return T.strip(whole) if stripped else whole


def combined_headings(sections: Column) -> Column:
    return F.transform(sections, lambda s: T.heading(s["heading"]))


def last_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The row with the highest order of each key, nulls lowest. Aggregates before the shuffle; no sort of a hot key."""
    others = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("__row"))
    return picked.select(*keys, *(F.col(f"__row.`{c}`").alias(c) for c in others))


def lookup(sections: DataFrame) -> DataFrame:
    """The latest row of each (doc_id, section_index)."""
    rows = sections.filter("doc_id is not null and section_index is not null")
    return last_wins(rows, ["doc_id", "section_index"], [F.col("scraped_at"), F.col("content")])


def chunks(df: DataFrame, key: str, text_col: str, size: int = 500, overlap: int = 50) -> DataFrame:
    """(key, chunk_no, chunk) of `size` characters, each starting `size - overlap` after the one before."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the size")
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.length(text_col) - overlap) / F.lit(step)) - 1).cast("int")
    starts = df.filter(F.length(text_col) > 0).select(key, text_col, F.explode(F.sequence(F.lit(0), last)).alias("chunk_no"))
    return starts.select(key, "chunk_no", F.substring(F.col(text_col), F.col("chunk_no") * step + 1, F.lit(size)).alias("chunk"))


def paragraph_chunks(df: DataFrame, key: str, text_col: str, size: int = 500) -> DataFrame:
    """(key, chunk_no, chunk): paragraphs packed in order into chunks of at most `size`; a longer paragraph is one chunk."""
    parts = F.filter(F.transform(F.split(text_col, r"\n\s*\n"), T.strip), lambda x: x != "")
    empty = F.array().cast("array<string>")

    def add(acc, p):
        full = F.concat(F.element_at(acc, -1), F.lit("\n\n"), p)
        fits = (F.size(acc) > 0) & (F.length(full) <= size)
        return F.when(fits, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(full))).otherwise(F.concat(acc, F.array(p)))

    return df.select(key, F.posexplode(F.aggregate(parts, empty, add)).alias("chunk_no", "chunk"))


def batches(df: DataFrame, index: str, size: int = 128) -> DataFrame:
    """With batch_no and place, by a row index from 0."""
    return df.withColumns({"batch_no": F.floor(F.col(index) / size), "place": F.col(index) % size})


def ranked(df: DataFrame, by: list[str], order: list[Column], most: int) -> DataFrame:
    """The first `most` rows of each group, ranked from 1."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)
