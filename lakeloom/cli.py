"""Command line: `python -m lakeloom.cli COMMAND ...`. Each command reads files, runs an operator and writes a table."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import functions as F

from lakeloom import providers, schemas
from lakeloom.functions import text as T
from lakeloom.operators import corpus, links, pages, questions, rag, snapshots
from lakeloom.session import build_session
from lakeloom.sources import readers, sinks


COMMANDS = {
    "scrape-links": ("pages", "out"),
    "scrape-content": ("pages", "out"),
    "hqe-generate": ("corpus", "out"),
    "embed-hqe": ("records", "out"),
    "qa-console": ("vectors", "corpus", "questions"),
    "changes-content": ("data_dir",),
    "changes-links": ("older", "newer"),
    "changes-all": ("data_dir",),
}
INPUTS = {"pages", "corpus", "records", "vectors", "questions", "data_dir", "older", "newer"}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lakeloom")
    sub = p.add_subparsers(dest="command", required=True)
    for name, words in COMMANDS.items():
        c = sub.add_parser(name)
        for w in words:
            c.add_argument(w)
    b, s = schemas.Budget(), schemas.Settings()
    for n in ("small", "medium", "large"):
        sub.choices["hqe-generate"].add_argument(f"--{n}", type=int, default=getattr(b, n))
    qa = sub.choices["qa-console"]
    qa.add_argument("--k", type=int, default=s.top_k)
    qa.add_argument("--min-score", type=float, default=s.min_score)
    qa.add_argument("--per-section", type=int, default=s.per_section_chars)
    qa.add_argument("--total", type=int, default=s.total_chars)
    for n in ("scrape-links", "scrape-content"):
        sub.choices[n].add_argument("--base", default="")
    sub.choices["scrape-links"].add_argument("--seen", help="a list of links known from before: they are kept and not followed again")
    return p


def _changes(spark, data_dir: str) -> None:
    newest, older = (r.path for r in readers.latest_two_files(readers.files(spark, data_dir, "*.json")).orderBy(F.desc("day")).collect())  # two rows
    old, new = (readers.corpus(spark, x, strict=False) for x in (older, newest))
    snapshots.status(old, new, "link").filter("status <> 'same'").orderBy("status", "link").show(1000, False)
    snapshots.diffs(old, new, "link").orderBy("link").show(1000, False)


def _link_changes(spark, older: str, newer: str) -> None:
    old, new = (readers.link_list(spark, x) for x in (older, newer))
    for what, found in (("added", snapshots.added(old, new, "path")), ("removed", snapshots.removed(old, new, "path"))):
        for r in found.orderBy("path").toLocalIterator():
            print(what, r.path)


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    for path in (getattr(a, x) for x in sorted(INPUTS) if hasattr(a, x)):
        if "*" not in path and "://" not in path and not os.path.exists(path):
            print(f"not found: {path}", file=sys.stderr)
            return 1
    spark = build_session("cli")
    if a.command == "scrape-links":
        found = pages.page_links(readers.pages(spark, a.pages), "url", "html")
        found = found.withColumn("src", F.regexp_replace(F.regexp_extract("url", r"^[a-z]+:/*(?:[^/]*)(/.*)$", 1), r"(?:/index)?\.html?$", ""))
        edges = found.filter(links.is_followed(F.col("href"))).select("src", F.col("href").alias("dst"))
        known = readers.link_list(spark, a.seen) if a.seen else None
        start = edges.agg(F.min(F.struct(F.length("src"), "src")).getField("src")).first()[0] or "/"
        got = links.reached(edges, start, None if known is None else known.select(F.col("path").alias("node"))).select(F.col("node").alias("path"))
        sinks.link_list(got if known is None else got.unionByName(known.select("path")), a.out)
    elif a.command == "scrape-content":
        sinks.corpus(pages.accepted_pages(pages.page_documents(readers.pages(spark, a.pages), "url", "html")).withColumn("link", T.canonical_link(F.concat(F.lit(a.base), "url"))), a.out)
    elif a.command == "hqe-generate":
        docs = readers.corpus(spark, a.corpus)
        none = F.lit(None).cast("array<string>").alias("combined_headings")
        parts = corpus.corpus_sections(docs, ["doc_id", "title", "link"]).withColumn("combined_headings", none)
        sinks.json_lines(providers.hqe_records(parts, (a.small, a.medium, a.large)), a.out)
    elif a.command == "embed-hqe":
        rows = questions.flatten_questions(readers.hqe_records(spark, a.records))
        embed = providers.embed_column(providers.HashedWords(), schemas.Settings().embed_batch)
        rows = rows.withColumn("row_idx", F.monotonically_increasing_id())
        sinks.vectors(rows.withColumn("embedding", embed(F.col("question"))), a.out)
    elif a.command == "qa-console":
        sections = corpus.corpus_sections(readers.corpus(spark, a.corpus), ["doc_id", "title", "link"])
        found = rag.answered(readers.link_list(spark, a.questions, distinct=False).select(F.col("path").alias("question")), spark.read.parquet(a.vectors), sections, providers.HashedWords(), providers.FirstLines(), a.k, a.min_score, a.per_section, a.total)
        for r in found.orderBy("query_id").toLocalIterator():
            print(f"> {r.question}\n{r.answer}")
            for i, x in enumerate(r.sources, 1):
                print(f"  {i}. {x.title} - {x.heading} ({rag.score_text(x.score)}) {x.link}")
    elif a.command == "changes-content":
        _changes(spark, a.data_dir)
    elif a.command == "changes-links":
        _link_changes(spark, a.older, a.newer)
    else:
        found = readers.files(spark, a.data_dir, "*.txt").orderBy(F.desc(F.regexp_extract("path", r"(\d{4}-\d{2}-\d{2})", 1)), "path").limit(2).collect()  # two rows
        if len(found) == 2:
            _link_changes(spark, found[1].path, found[0].path)
        _changes(spark, a.data_dir)
    return 0


if __name__ == "__main__":
    sys.exit(main())
