"""Pieces of texts that exceed a size limit, cut where the topic changes.

Sentences and lines are the units. At each boundary between units the words of the blocks before and after it are compared
(cosine of counts); a boundary's depth is how far its similarity lies below the peaks on either side. Each piece ends
at the deepest valley of its window, a paragraph's end winning among equals. The window is what the limit leaves beyond the end of
the piece before, but for its first `LEAST` part, so that pieces advance; without a unit boundary there a piece ends at the last
one before it, else at a word's end, else at the limit. The next piece starts `overlap` characters earlier, at the nearest start of
a word not more than a quarter of the overlap away.

Defined results: null and short texts give no pieces; pieces cover the text without gaps; no piece exceeds the limit; an overlap
of over `MOST_OVERLAP` of the limit is cut to that, and every piece tells the characters it repeats; a null overlap is 0; a limit
of null, 0 or less is none; repeated rows give their pieces once; lengths count code points. Extra columns are not read.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.session import gather

#: Units in each of the two compared blocks; what parts of a window and of a limit are left out and repeated at most.
BLOCK, LEAST, MOST_OVERLAP = 4, 0.25, 0.75
MAX_CONFIGS = 1_000
_UNIT_END = re.compile(r"\n\s*|(?<=[.!?…])[\"”»')\]]*\s+(?=\S)")
_WORD = re.compile(r"[^\W\d_]{3,}")


def unit_ends(text: str) -> list[tuple[int, bool]]:
    """Offsets after a sentence or line within the text; True for a line's end."""
    return [(m.end(), "\n" in m[0]) for m in _UNIT_END.finditer(text) if 0 < m.end() < len(text)]


def depths(text: str, ends: list[int]) -> list[float]:
    """The depth of the similarity valley at each boundary. The blocks slide, so the work is linear in the text."""
    edges = [0, *ends, len(text)]
    lower = text.lower()
    units = [Counter(_WORD.findall(lower[a:b] if len(lower) == len(text) else text[a:b].lower())) for a, b in zip(edges, edges[1:], strict=False)]
    left: dict[str, int] = {}
    right: dict[str, int] = {}
    dot = l2 = r2 = 0

    def change(side: dict[str, int], other: dict[str, int], unit: Counter, sign: int) -> tuple[int, int]:
        d = s = 0
        for w, n in unit.items():
            old = side.get(w, 0)
            new = old + sign * n
            d += sign * n * other.get(w, 0)
            s += new * new - old * old
            if new:
                side[w] = new
            else:
                del side[w]
        return d, s

    for u in units[:BLOCK]:
        _, s = change(right, left, u, 1)
        r2 += s
    sims = []
    for i in range(1, len(units)):
        d, s = change(right, left, units[i - 1], -1)
        dot, r2 = dot + d, r2 + s
        d, s = change(left, right, units[i - 1], 1)
        dot, l2 = dot + d, l2 + s
        if i - 1 >= BLOCK:
            d, s = change(left, right, units[i - 1 - BLOCK], -1)
            dot, l2 = dot + d, l2 + s
        if i + BLOCK - 1 < len(units):
            d, s = change(right, left, units[i + BLOCK - 1], 1)
            dot, r2 = dot + d, r2 + s
        sims.append(dot / math.sqrt(l2 * r2) if l2 and r2 else 0.0)
    # peaks: how high the similarity climbs without falling, to either side
    n = len(sims)
    up_left, up_right = [0.0] * n, [0.0] * n
    for i in range(n):
        up_left[i] = up_left[i - 1] if i and sims[i - 1] >= sims[i] else sims[i]
    for i in range(n - 1, -1, -1):
        up_right[i] = up_right[i + 1] if i < n - 1 and sims[i + 1] >= sims[i] else sims[i]
    return [up_left[i] + up_right[i] - 2 * sims[i] for i in range(n)]


def pieces(text: str, limit: int, overlap: int, marks: tuple[list[int], list[tuple[float, bool]]] | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind of end) of each piece: unit, word, limit or end."""
    if limit <= 0 or len(text) <= limit:
        return [(0, len(text), "end")]
    overlap = max(0, min(overlap, int(limit * MOST_OVERLAP)))
    ends, score = marks or marked(text)
    out, start, last = [], 0, 0
    while len(text) - start > limit:
        hi = start + limit
        kind, a, b = "unit", bisect_left(ends, last + 1 + int(LEAST * (hi - last))), bisect_right(ends, hi)
        if a == b:
            a = max(bisect_left(ends, last + 1), b - 1)  # the last one before the window
        if a < b:
            cut = ends[max(range(a, b), key=lambda i: (score[i], ends[i]))]
        else:
            kind, cut, floor = "word", hi, last + 1
            while cut > floor and not (text[cut - 1].isspace() and not text[cut : cut + 1].isspace()):
                cut -= 1
            if cut <= floor:
                kind, cut = "limit", hi
                while cut > floor and (unicodedata.combining(text[cut]) or text[cut] in "\u200d\ufe0f"):
                    cut -= 1
                if cut <= floor:
                    cut = hi
        out.append((start, cut, kind))
        last, start = cut, _word_start(text, max(start + 1, cut - overlap), overlap // 4, max(start + 1, cut - limit + 1), cut)
    out.append((start, len(text), "end"))
    return out


def _word_start(text: str, at: int, reach: int, least: int, end: int) -> int:
    """The start of a word nearest to `at` within the reach, else `at`."""
    for d in range(reach + 1):
        for s in (at - d, at + d):
            if least <= s < end and text[s - 1].isspace() and not text[s].isspace():
                return s
    return at


def marked(text: str) -> tuple[list[int], list[tuple[float, bool]]]:
    """The boundaries of units, and by what one is preferred: depth, then the end of a line."""
    found = unit_ends(text)
    ends = [e for e, _ in found]
    return ends, [(round(d, 9), p) for d, (_, p) in zip(depths(text, ends), found, strict=True)]


def split_oversized(df: DataFrame, configs: DataFrame, id_col: str = "sec_id", text_col: str = "content", with_text: bool = True) -> DataFrame:
    """(id, prompt_version, piece_no, n_pieces, start_char, end_char, repeats, cut_at[, content]) of every text over a limit.

    `configs` has prompt_version, max_chars and overlap_chars; it is small and checked to be. The topic valleys of a text
    are found once for all limits, and only texts over the lowest limit reach Python.
    """
    wanted = configs.select("prompt_version", F.col("max_chars").cast("int"), F.coalesce(F.col("overlap_chars"), F.lit(0)).cast("int").alias("overlap")).filter("max_chars > 0")
    limits = sorted({(str(r[0]), r[1], r[2]) for r in gather(wanted.distinct(), "the configuration table", MAX_CONFIGS)})
    schema = "sec_id bigint, prompt_version string, piece_no int, n_pieces int, start_char int, end_char int, repeats int, cut_at string" + (", content string" if with_text else "")
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()] + [pa.string()] * with_text
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                out = []
                part = batch.slice(at, 200)
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    marks = marked(text)
                    for version, limit, overlap in limits:
                        if len(text) > limit:
                            found = pieces(text, limit, overlap, marks)
                            out += [(key, version, i, len(found), a, b, found[i - 1][1] - a if i else 0, kind, *([text[a:b]] * with_text)) for i, (a, b, kind) in enumerate(found)]
                cols = list(zip(*out, strict=True)) or [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    lowest = min((x[1] for x in limits), default=None)
    rows = df.select(F.col(f"`{id_col}`").cast("bigint").alias("sec_id"), F.col(f"`{text_col}`").alias("content"))
    rows = rows.filter(F.lit(False) if lowest is None else F.length("content") > lowest)
    if with_text:
        rows = rows.dropDuplicates(["sec_id", "content"])
    return rows.mapInArrow(run, schema)
