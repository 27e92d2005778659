"""Passages of evaluation items inside a training corpus.

Each Arrow batch of documents is a shard: its words become numbers, a suffix array orders the shard's word suffixes, and the
first words of every suffix of every evaluation passage are found in it by binary search; each hit is then extended to the
longest verbatim match. A match of `min_words` words holds only words that occur in some evaluation passage, so other words
are left out of the array as separators; this loses nothing and keeps it small.

The evaluation items go to every executor in blocks of about `BLOCK_WORDS` words, as many blocks as they need: each block is
searched against all documents. A shard holds about `SHARD_CHARS` characters, however many documents Arrow sends at once.

Defined results: null and empty texts match nothing; a passage shorter than `min_words` words matches nothing; question and
answer are never joined; of several matches of a document with one field of an item the longest is reported (the
first of equals); repeated document rows give one row; repeated items are searched once each. Extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.normalize import look
from lakeloom.session import gather

#: Words of evaluation items that are sent at once (and items, as short ones have a cost too); characters of documents in a shard.
BLOCK_WORDS, BLOCK_ITEMS, SHARD_CHARS = 2_000_000, 50_000, 4_000_000
_WORD = re.compile(r"[^\W_]+")
_SOFT_END = re.compile("­[ \t]*\r?\n[ \t]*")
_LINE_END = re.compile(r"(?<=[^\W_])-[ \t]*\r?\n[ \t]*(?=[^\W_])")


def plain_words(text: str) -> list[str]:
    """Lower-case words of the plain form, broken words joined."""
    if "\n" in text:
        text = look(_SOFT_END.sub("", text))
        if "-" in text:
            text = _LINE_END.sub("", text)
    else:
        text = look(text)
    return _WORD.findall(text.lower())


def suffix_array(t: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes of `t` in the order of their first `depth` elements, by prefix doubling."""
    n = len(t)
    order = np.argsort(t, kind="stable")
    rank = np.empty(n, np.int64)
    s = t[order]
    rank[order] = np.concatenate([[0], np.cumsum(s[1:] != s[:-1])]) if n else []
    width = 1
    while n and width < depth and rank.max() < n - 1:
        nxt = np.zeros(n, np.int64)
        nxt[: n - width] = rank[width:] + 1
        key = rank * (n + 2) + nxt
        order = np.argsort(key, kind="stable")
        s = key[order]
        rank[order] = np.concatenate([[0], np.cumsum(s[1:] != s[:-1])])
        width *= 2
    return order


def _compare(t: np.ndarray, at: np.ndarray, q: np.ndarray) -> np.ndarray:
    """-1, 0, 1 for each row of `q` against the suffix of `t` at `at` cut to the row's length. `t` is padded."""
    have = t[at[:, None] + np.arange(q.shape[1])]
    differ = have != q
    first = differ.argmax(1)
    rows = np.arange(len(q))
    return np.where(differ.any(1), np.sign(have[rows, first] - q[rows, first]), 0)


def search(t: np.ndarray, order: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of `q` the range of `order` whose suffixes start with it."""
    ends = []
    for past in (False, True):
        lo, hi = np.zeros(len(q), np.int64), np.full(len(q), len(order), np.int64)
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            c = np.zeros(len(q), np.int64)
            c[open_] = _compare(t, order[mid[open_]], q[open_])
            right = open_ & ((c < 0) | ((c == 0) & past))
            lo, hi = np.where(right, mid + 1, lo), np.where(open_ & ~right, mid, hi)
        ends.append(lo)
    return ends[0], ends[1]


class Passages:
    """Evaluation passages as numbers, with the distinct first words of their suffixes."""

    def __init__(self, passages: list[tuple[int, str, list[str]]], min_words: int):
        self.min_words = min_words
        kept = [p for p in passages if len(p[2]) >= min_words]
        self.words = {w: i for i, w in enumerate(sorted({w for p in kept for w in p[2]}), 1)}
        self.owner = [(p[0], p[1]) for p in kept]
        self.longest = max((len(p[2]) for p in kept), default=0)
        starts: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        self.tokens = []
        for k, (_, _, ws) in enumerate(kept):
            ids = [self.words[w] for w in ws]
            self.tokens.append(np.array([*ids, -1], np.int64))
            for i in range(len(ids) - min_words + 1):
                starts.setdefault(tuple(ids[i : i + min_words]), []).append((k, i))
        self.heads = np.array(list(starts), np.int64).reshape(len(starts), min_words)
        self.places = list(starts.values())

    def matches(self, docs: list[list[str]]) -> Iterator[tuple[int, int, int, int, int]]:
        """(document, passage, words matched, word in the document, word in the passage), the longest of each pair."""
        get, m = self.words.get, self.min_words
        parts, origin = [], []
        for d, ws in enumerate(docs):
            ids = np.fromiter((get(w, 0) for w in ws), np.int64, len(ws))
            if len(ids) < m:
                continue
            known = np.concatenate([[0], (ids > 0).astype(np.int8), [0]])
            edges = np.flatnonzero(np.diff(known))
            for a, b in zip(edges[::2], edges[1::2], strict=True):
                if b - a >= m:
                    parts += [ids[a:b], [0]]
                    origin.append((d, a, b - a))
        if not parts or not len(self.heads):
            return
        t = np.concatenate([*parts, np.zeros(self.longest + m, np.int64)])
        n = len(t) - self.longest - m
        run_start = np.concatenate([[0], np.cumsum([x[2] + 1 for x in origin])[:-1]])
        order = suffix_array(t[:n], m)
        lo, hi = search(t, order, self.heads)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for h in np.flatnonzero(hi > lo):
            at = order[lo[h] : hi[h]]
            run = np.searchsorted(run_start, at, "right") - 1
            for k, i in self.places[h]:
                p = self.tokens[k][i:]
                equal = t[at[:, None] + np.arange(len(p))] == p
                length = np.where(equal.all(1), len(p), (~equal).argmax(1))
                for r, a, ln in zip(run, at, length, strict=True):
                    d, word = origin[r][0], origin[r][1] + a - run_start[r]
                    new = (int(ln), -int(word), -i)
                    if new > best.get((d, k), (0, 0, 0)):
                        best[d, k] = new
        for (d, k), (ln, word, i) in best.items():
            yield d, k, ln, -word, -i


def item_blocks(items: DataFrame, fields: tuple[str, ...], words: int = BLOCK_WORDS, most: int = BLOCK_ITEMS) -> Iterator[list]:
    """The distinct items (item, *fields) in blocks by hash, each small enough for the driver and the executors."""
    size = sum((F.coalesce(F.length(f), F.lit(0)) for f in fields), F.lit(0))
    n, chars = items.agg(F.count("*"), F.sum(size)).first()
    blocks = max(1, -(-n * 5 // (most * 4)), -(-(chars or 0) // (5 * words)))
    for b in range(blocks):
        part = items.filter(F.pmod(F.xxhash64(F.lit(11), "item"), F.lit(blocks)) == b) if blocks > 1 else items
        yield gather(part, "a block of the evaluation table", 2 * most)


def shards(texts: list[str], most: int = SHARD_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many characters; a longer text is one of its own."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", fields: tuple[str, ...] = ("question", "answer"), min_words: int = 12, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, field, n_words, doc_word, item_word), word numbers from 0."""
    wanted = items.select(F.col(f"`{item_col}`").cast("bigint").alias("item"), *(F.col(f"`{f}`").alias(f"f{k}") for k, f in enumerate(fields))).filter("item is not null").distinct()
    texts = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).filter("text is not null and doc_id is not null")
    found = None
    for rows in item_blocks(wanted, tuple(f"f{k}" for k in range(len(fields))), block_words):
        passages = Passages([(r[0], f, plain_words(x)) for r in sorted(rows, key=str) for f, x in zip(fields, r[1:], strict=True) if x], min_words)
        sent = docs.sparkSession.sparkContext.broadcast(passages)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            p = sent.value
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
            for b in batches:
                ids, all_texts = b.column(0).to_pylist(), b.column(1).to_pylist()
                for start, end in shards(all_texts):
                    found = [(ids[start + d], *p.owner[k], n, w, i) for d, k, n, w, i in p.matches([plain_words(x) for x in all_texts[start:end]])]
                    cols = list(zip(*found, strict=True)) or [[]] * 6
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "item_id", "field", "n_words", "doc_word", "item_word"])

        part = texts.mapInArrow(run, "doc_id bigint, item_id bigint, field string, n_words int, doc_word int, item_word int")
        found = part if found is None else found.unionByName(part)
    best = F.max(F.struct("n_words", (-F.col("doc_word")).alias("d"), (-F.col("item_word")).alias("i")))
    found = found.groupBy("doc_id", "item_id", "field").agg(best.alias("b"))
    return found.select("doc_id", "item_id", "field", "b.n_words", (-F.col("b.d")).alias("doc_word"), (-F.col("b.i")).alias("item_word"))


def without_leaks(docs: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents that carry no passage."""
    return docs.join(found.select(F.col("doc_id").alias(id_col)).distinct(), id_col, "left_anti")


def leak_report(found: DataFrame) -> DataFrame:
    """For each leaked item: documents that carry it and the longest match."""
    return found.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"), F.max("n_words").alias("longest"))
