"""HTML pages as blocks and sections.

Flat recipe: every tag with the text after it is an event; block-level tags, opening or closing, start a block; a block is kept if an
opening h1, h2, h3, p or li starts it. Text of nested blocks is given once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases of players and page furniture.
NOISE_PHRASES = (
    "this is a modal window",
    "beginning of dialog window",
    "escape will cancel",
    "subtitles off",
    "opens subtitles settings dialog",
    "end of dialog window",
    "fandt du ikke, hvad du ledte efter",
    "genveje",
)
# End of fixed values.
HEADINGS, BODIES = ("h1", "h2", "h3"), ("p", "li")
BLOCK_TAGS = frozenset("address article aside blockquote body dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead title tr ul".split())
HIDDEN_TAGS = frozenset("script style noscript template nav footer head".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())


def is_noise(text: Column, phrases=NOISE_PHRASES) -> Column:
    """Whether the text holds one of the phrases, whatever its case."""
    low = F.lower(text)
    return F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(low, p))


class _Blocks(HTMLParser):
    def __init__(self, container: str | None):
        super().__init__(convert_charrefs=True)
        self.container, self.inside, self.hidden = container, 0, []
        self.tag: str | None = None
        self.text: list[str] = []
        self.out: list[tuple[str, str]] = []
        self.title: list[str] = []
        self.in_title = False

    def _close(self) -> None:
        if self.tag and (t := " ".join("".join(self.text).split())):
            self.out.append((self.tag, t))
        self.tag, self.text = None, []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "title":
            self.in_title = True
        gone = tag in HIDDEN_TAGS or "hidden" in a or "display:none" in (a.get("style") or "").replace(" ", "").lower()
        if (gone or self.hidden) and tag not in VOID_TAGS:
            if tag not in ("p", "li") or gone:  # these may stay open
                self.hidden.append(tag)
        if self.container is not None and tag == self.container:
            self.inside += 1
        if tag in BLOCK_TAGS:
            self._close()
            if not self.hidden and (self.container is None or self.inside) and tag in (*HEADINGS, *BODIES):
                self.tag = tag

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        if tag in BLOCK_TAGS:
            self._close()
        if tag in self.hidden:
            del self.hidden[len(self.hidden) - 1 - self.hidden[::-1].index(tag) :]
        if self.container is not None and tag == self.container:
            self.inside = max(0, self.inside - 1)

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        elif self.tag and not self.hidden:
            self.text.append(data)


def blocks_of(html: str, container: str | None = "article") -> list[tuple[str, str]]:
    p = _Blocks(container if container and f"<{container}" in html.lower() else None)
    p.feed(html)
    p.close()
    p._close()
    return p.out


def page_blocks(pages: DataFrame, key: str = "page_id", html: str = "html", container: str | None = "article") -> DataFrame:
    """(key, pos, tag, text) of the visible blocks of each page, in order; noise is left out."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, pos, tags, texts = [], [], [], []
            for r, page in enumerate(b.column(1).to_pylist()):
                for i, (tag, text) in enumerate(blocks_of(page, container) if page else ()):
                    at.append(r)
                    pos.append(i)
                    tags.append(tag)
                    texts.append(text)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(pos, pa.int32()), pa.array(tags, pa.string()), pa.array(texts, pa.string())], names=[key, "pos", "tag", "text"])

    return pages.select(key, html).mapInArrow(run, f"`{key}` {kind}, pos int, tag string, text string").filter(~is_noise(F.col("text")))


def sections_of(blocks: list[tuple[str, str]], noise=NOISE_PHRASES) -> list[tuple[str | None, str]]:
    """(heading, content): a heading starts a section, the last of several in a row holds; text before the first has a null
    heading; a heading without text gives nothing. Noisy blocks are left out."""
    out: list[tuple[str | None, str]] = []
    head, parts = None, []
    for tag, text in blocks:
        low = text.lower()
        if any(p in low for p in noise):
            continue
        if tag in HEADINGS:
            if parts:
                out.append((head, " ".join(parts)))
            head, parts = text, []
        else:
            parts.append(text)
    return [*out, (head, " ".join(parts))] if parts else out


def page_sections(pages: DataFrame, key: str = "page_id", html: str = "html", container: str | None = "article") -> DataFrame:
    """(key, section_index, heading, content) of each page, made where the page is parsed: nothing is shuffled."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, index, heads, texts = [], [], [], []
            for r, page in enumerate(b.column(1).to_pylist()):
                for i, (head, text) in enumerate(sections_of(blocks_of(page, container)) if page else ()):
                    at.append(r)
                    index.append(i)
                    heads.append(head)
                    texts.append(text)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(index, pa.int64()), pa.array(heads, pa.string()), pa.array(texts, pa.string())], names=[key, "section_index", "heading", "content"])

    return pages.select(key, html).mapInArrow(run, f"`{key}` {kind}, section_index bigint, heading string, content string")


_HREF = re.compile(r"<a\s[^>]*?href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_TITLE = re.compile(r"<title[^>]*>(.*?)</title>", re.I | re.S)


def page_links(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, href) of every link of each page, entities read."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(r, unescape(next(filter(None, m.groups()), ""))) for r, page in enumerate(b.column(1).to_pylist()) for m in _HREF.finditer(page or "")]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([r for r, _ in found], pa.int64())), pa.array([h for _, h in found], pa.string())], names=[key, "href"])

    return pages.select(key, html).mapInArrow(run, f"`{key}` {kind}, href string")


def page_documents(pages: DataFrame, key: str = "page_id", html: str = "html", container: str | None = "article") -> DataFrame:
    """(key, title, sections) of each page, a row for every page; the title is that of the page or its first heading."""
    kind = pages.schema[key].dataType.simpleString()
    section = pa.list_(pa.struct([("heading", pa.string()), ("content", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            titles, sections = [], []
            for page in b.column(1).to_pylist():
                m = _TITLE.search(page or "")
                found = blocks_of(page, container) if page else []
                first = next((t for tag, t in found if tag in HEADINGS), "(no title)")
                titles.append(" ".join(unescape(m[1]).split()) if m and m[1].strip() else first)
                sections.append([{"heading": h, "content": c} for h, c in sections_of(found)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(titles, pa.string()), pa.array(sections, section)], names=[key, "title", "sections"])

    return pages.select(key, html).mapInArrow(run, f"`{key}` {kind}, title string, sections array<struct<heading:string,content:string>>")


def accepted_pages(pages: DataFrame) -> DataFrame:
    """Pages with a title other than the placeholder and at least one section with content; blank contents are dropped."""
    kept = F.filter("sections", lambda s: F.trim(F.coalesce(s["content"], F.lit(""))) != "")
    return pages.withColumn("sections", kept).filter((F.size("sections") > 0) & F.col("title").isNotNull() & (F.col("title") != "(no title)"))
