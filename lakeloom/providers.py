"""Stand-ins for remote models, deterministic and offline. Any object with the same method serves instead."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType

from lakeloom.functions import text as T
from lakeloom.session import materialize


class EmbeddingProvider(Protocol):
    def embed(self, texts: list[str]) -> np.ndarray: ...


class QuestionProvider(Protocol):
    def ask(self, texts: list[str], languages: list[str], most: list[int]) -> list[list[str]]: ...


class ChatProvider(Protocol):
    def answer(self, prompts: list[str]) -> list[str]: ...


class HashedWords:
    """Signed feature hashing of words, unit length. Not a language model."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: list[str]) -> np.ndarray:
        from hashlib import blake2b

        out = np.zeros((len(texts), self.dim), np.float32)
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = int.from_bytes(blake2b(w.encode(), digest_size=8).digest(), "little")
                out[i, h % self.dim] += 1 if h >> 63 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(n > 0, n, 1)


class FirstLines:
    """Answers with the first line of the context, as a stand-in for a chat model."""

    def answer(self, prompts: list[str]) -> list[str]:
        return [next((x for x in p.partition("\n\n")[2].splitlines()[1:] if x.strip()), "") for p in prompts]


def embed_column(provider: EmbeddingProvider, batch: int = 128):
    """A column function from text to array<float>; order is kept, batches have a fixed size, null embeds as ''."""

    @F.pandas_udf(ArrayType(FloatType()))
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            texts = [x or "" for x in s]
            yield pd.Series([row for at in range(0, len(texts), batch) for row in provider.embed(texts[at : at + batch])], dtype=object)

    return run


def answer_column(provider: ChatProvider):
    @F.pandas_udf(StringType())
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series(provider.answer([x or "" for x in s]), dtype=object)

    return run


def template_questions(heading: Column, title: Column, language: Column, most: Column) -> Column:
    """Questions from fixed templates about a heading, `most` of them at most; the offline question generator."""
    about = F.coalesce(F.nullif(T.strip(heading), F.lit("")), title)
    danish = F.array(*(F.concat(F.lit(a), about, F.lit(b)) for a, b in (("Hvad gælder om ", " for min SU"), ("Hvem kan søge stipendium efter reglerne om ", ""), ("Hvornår skal jeg sende dokumentation om ", " til SU"), ("Hvor meget kan jeg få i stipendium ved ", ""), ("Hvordan klager jeg over en SU afgørelse om ", ""))))
    english = F.array(*(F.concat(F.lit(a), about, F.lit(b)) for a, b in (("What are the grant rules on ", ""), ("Who can apply for an allowance under ", ""), ("When is the grant paid according to ", ""), ("How much income is allowed under ", ""), ("How do I complain about a loan decision on ", ""))))
    return F.slice(F.when(language == "en", english).otherwise(danish), 1, most)


class Templates:
    """The offline question generator: fixed templates about a heading or title."""

    name = "templates"

    def ask(self, heading: Column, title: Column, content: Column, language: Column, most: Column) -> Column:
        return template_questions(heading, title, language, most)


class Asked:
    """Any `QuestionProvider` as a generator: texts, cut to `max_chars`, go to it in Arrow batches, built into its prompt by the provider."""

    def __init__(self, provider: QuestionProvider, name: str, max_chars: int = 2500):
        self.provider, self.name, self.max_chars = provider, name, max_chars

    def ask(self, heading: Column, title: Column, content: Column, language: Column, most: Column) -> Column:
        provider = self.provider

        @F.pandas_udf(ArrayType(StringType()))
        def run(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for text, lang, n in parts:
                yield pd.Series(provider.ask([x or "" for x in text], list(lang), [int(x) for x in n]), dtype=object)

        return run(F.left(content, F.lit(self.max_chars)) if self.max_chars > 0 else content, language, most)


def generation_prompt(text: str, language: str, most: int) -> str:
    """What a generative provider may send: one request for `most` questions as a JSON list."""
    if language == "en":
        return f"Read the text and list {most} questions, as a JSON array of strings, that someone might ask and that it answers. Each must be clear without the text.\n\n{text}"
    return f"Læs teksten og giv en JSON-liste med {most} spørgsmål, som nogen kunne stille, og som den besvarer. Hvert skal kunne forstås uden teksten.\n\n{text}"


def fallback_question(language: Column) -> Column:
    """For a text about which nothing was generated."""
    return F.when(language == "en", "What does this page say about the grant?").otherwise("Hvad siger denne side om SU?")


def with_documents(sections: DataFrame) -> DataFrame:
    """Latest sections, and for every document without a row at -1 one made of them: its text, and its headings combined."""
    rows = materialize(sections.select("doc_id", "section_index", "title", "link", "heading", "content", "combined_headings"), "latest")
    parts, there = rows.filter("section_index >= 0"), rows.filter("section_index < 0")
    each = F.array_sort(F.collect_list(F.struct("section_index", "heading", "content")))
    lacking = parts.join(there.select("doc_id"), "doc_id", "left_anti")
    whole = lacking.groupBy("doc_id").agg(each.alias("s"), F.min_by("title", "section_index").alias("title"), F.min_by("link", "section_index").alias("link"))
    heads = F.transform("s", lambda x: T.heading(x["heading"]))
    text = T.strip(F.array_join(F.transform("s", lambda x: F.concat(T.heading(x["heading"]), F.lit("\n"), F.coalesce(x["content"], F.lit("")))), "\n\n"))
    made = whole.select("doc_id", F.lit(-1).alias("section_index"), "title", "link", F.lit(None).cast("string").alias("heading"), text.alias("content"), heads.alias("combined_headings"))
    return rows.unionByName(made)


def hqe_records(sections: DataFrame, budget: tuple[int, int, int] = (3, 5, 8), duplicate_at: float = 0.8, generator=None, prompt_version: str = "v1", generated_at: str | None = None) -> DataFrame:
    """Question records of sections and documents (at -1): language, generator, version, time, questions and meta fields.

    The language is that of the whole document and holds for its sections. Lines are (doc_id, section_index) once.
    """
    from lakeloom.operators.language import detected
    from lakeloom.operators.questions import distinct_enough, quality

    generator = generator or Templates()
    every = materialize(with_documents(sections), "sections")
    languages = every.filter("section_index < 0").select("doc_id", detected(F.col("content")).alias("language"))
    n = T.question_budget(F.length(F.coalesce("content", F.lit(""))), *budget)
    rows = every.filter(T.strip(F.coalesce("content", F.lit(""))) != "").join(languages, "doc_id", "left").withColumn("language", F.coalesce("language", F.lit("da")))
    raw = generator.ask(F.col("heading"), F.col("title"), F.col("content"), F.col("language"), n)
    rows = rows.withColumn("kept", distinct_enough(quality(raw), duplicate_at))  # once, though it is read twice below
    kept = F.col("kept")
    at = F.lit(generated_at) if generated_at else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return rows.select(
        "doc_id", "section_index", "language", F.lit(generator.name).alias("gen_model"), F.lit(prompt_version).alias("prompt_version"), at.alias("generated_at"),
        F.when(F.size(kept) > 0, kept).otherwise(F.array(fallback_question(F.col("language")))).alias("questions"),
        F.struct(F.col("link").alias("source"), F.col("title").alias("page_title"), F.col("heading").alias("section_heading"), "combined_headings", F.col("content").alias("aggregated_content"), F.length("content").alias("section_char_len")).alias("meta"),
    )
