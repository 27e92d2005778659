"""Queries and SQL of the operators in this package. Each reads its whole tables with the parameters of production."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm import boilerplate, content, langid, leakage, mixing, neighbors, normalize, split
from lakeloom.session import materialize


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "section_lookup").filter("section_index >= 0")


def p2_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbors.nearest(_read(spark, sf_dir, "question_vectors"), "row_idx", "embedding")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbors.close_pairs(neighbors.nearest(_read(spark, sf_dir, "question_vectors"), "row_idx", "embedding", least=0.9), 0.9)


def _repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.repeated_lines(_sections(spark, sf_dir).select("sec_id", "doc_id", "site", "content"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _repeated(spark, sf_dir).filter("line_docs >= 5").select("sec_id", "line_no").distinct()


def p5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of a near-duplicate cluster that is frequent enough, with the documents of the cluster and of the very line."""
    return _repeated(spark, sf_dir).select("sec_id", "line_no", "cluster_docs", "line_docs").distinct()


def p5_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.without_repeated(_sections(spark, sf_dir), _repeated(spark, sf_dir))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.look_alike_pairs(_sections(spark, sf_dir).filter("content is not null"), "sec_id", ["heading", "content"])


def p6_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "section_lookup").select("sec_id", "section_index", "scraped_at", "heading", "content")
    return normalize.normalize_fields(rows, ["heading", "content"]).select("sec_id", "section_index", "scraped_at", "heading_norm", "content_norm")


def _pieces(spark: SparkSession, sf_dir: str, with_text: bool) -> DataFrame:
    return split.split_oversized(_sections(spark, sf_dir), _read(spark, sf_dir, "hqe_config"), with_text=with_text)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir, False).filter("n_pieces > 1").select("sec_id", "prompt_version").distinct()


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir, True)


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).select("doc_id", "item_id").distinct()


def p8_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir)


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leak_report(_leaks(spark, sf_dir))


def p8_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return leakage.without_leaks(docs, _leaks(spark, sf_dir)).select("doc_id", "source", "text")


def _record_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    filters = langid.fit(_read(spark, sf_dir, "documents"))
    return langid.record_lines(_read(spark, sf_dir, "hqe_records"), _read(spark, sf_dir, "section_lookup"), filters)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = _record_lines(spark, sf_dir).filter(F.col("line_lang").isin(*langid.LANGUAGES) & (F.col("label").isNull() | (F.col("label") != F.col("line_lang"))))
    return other.selectExpr("doc_id", "section_index", "line_no", "line_lang as lang").distinct()


def p7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _record_lines(spark, sf_dir)


def p7_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return langid.document_languages(docs, langid.fit(docs))


def _mixture(spark: SparkSession, sf_dir: str, **options: bool) -> tuple[DataFrame, DataFrame]:
    return mixing.mixture(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "source_targets"), **options)


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir)[0]


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir)[1]


def p9_exact_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir, exact_shares=True)[1]


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready = materialize(content.prepare(_read(spark, sf_dir, "documents")), "sentences")
    return content.score(ready, content.fit(ready, _read(spark, sf_dir, "content_labels")))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.flagged(_scored(spark, sf_dir)).distinct()


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir)


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.rates(_read(spark, sf_dir, "documents"), _scored(spark, sf_dir))


QUERIES = {
    "p1_found": p1_found,
    "p1_pieces": p1_pieces,
    "p2_found": p2_found,
    "p2_neighbors": p2_neighbors,
    "p5_found": p5_found,
    "p5_lines": p5_lines,
    "p5_clean": p5_clean,
    "p6_found": p6_found,
    "p6_normalized": p6_normalized,
    "p7_found": p7_found,
    "p7_lines": p7_lines,
    "p7_documents": p7_documents,
    "p8_found": p8_found,
    "p8_matches": p8_matches,
    "p8_report": p8_report,
    "p8_clean": p8_clean,
    "p9_mixture": p9_mixture,
    "p9_report": p9_report,
    "p9_exact_report": p9_exact_report,
    "p10_found": p10_found,
    "p10_scores": p10_scores,
    "p10_rates": p10_rates,
}

ORACLES = {
    "p5_found": r"""
with lines as (
  select site, doc_id, sec_id, i - 1 as line_no,
         regexp_replace(lower(trim(regexp_replace(parts[i], '[\s\x{1C}-\x{1F}\x{85}\p{Z}]+', ' ', 'g'))), '\p{Nd}+', '0', 'g') as same
  from (select *, string_split(content, chr(10)) as parts from section_lookup where section_index >= 0 and content is not null),
       unnest(range(1, len(parts) + 1)) as t(i)),
repeated as (select site, same from lines where same <> '' group by site, same having count(distinct doc_id) >= 5)
select distinct sec_id, cast(line_no as integer) as line_no from lines l join repeated r on l.same = r.same and l.site is not distinct from r.site
""",
    "p1_found": """
select distinct sec_id, prompt_version from section_lookup join hqe_config
on section_index >= 0 and max_chars > 0 and length(content) > max_chars
""",
}
