"""Lines that recur in many documents of one site, nearly the same lines included.

Lines are masked (numbers, dates and names) and cut into five-word shingles of the masked text. Lines with the same shingles
form a class. Classes meet by locality-sensitive hashing within their site: a class falls into the buckets of its least shingles
in one order of all shingles, rare ones first by a sketch that counts all classes, then by hash. It takes so many of them that
two classes with a Jaccard similarity of 0.8 or more always share a bucket (any order has that property, a rare-first one
keeps buckets small), so the hashing misses no pair. Pairs of a bucket are compared exactly; connected classes form a cluster; a
cluster seen in at least `min_docs` documents of its site is boilerplate.

A line's identity (`nkey`) is its trimmed, space-collapsed, lower-case text with runs of digits as 0, within its site; spellings
of one identity that mask differently are connected too. A line that a third of all documents carry is one class and is sent
on about once from each task. The sketch never counts too low, so it says before anything is shuffled which buckets may hold more
than `PAIRS_UP_TO` classes: those are split into blocks of about so many, of which every two meet in a cell of their own. All
pairs of a bucket are compared, no bucket is cut off and no cell is large.

Defined results: null contents and blank lines are never boilerplate; a null site is a site of its own; rows without doc_id
count as one document; repeated rows count once; versions of a section with one sec_id are cleaned each; lines of fewer than five
words are one shingle. Extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.langid import _mix
from lakeloom.operators.graph import connected_components
from lakeloom.session import join_one, materialize, release

SHINGLE, SIMILAR, PAIRS_UP_TO = 5, 0.8, 256
#: Counters in a row of the sketch, and rows: its size is the same for any data.
SKETCH, SKETCH_ROWS = 1 << 20, 2
#: Classes a task remembers to have sent.
REMEMBERED = 500_000
# Months of the languages at hand.
MONTHS = frozenset(
    "januar februar marts april maj juni juli august september oktober november december january february march may june july october "
    "januari februari mars augusti märz mai dezember desember oktober січня лютого березня квітня травня червня липня серпня вересня жовтня листопада грудня".split()
)
# End of fixed values.
_TOKEN = re.compile(r"\w+")
_DIGITS = re.compile(r"\d+")


def same_line(line: str) -> str:
    """The form in which lines are the same; '' for a blank one."""
    return _DIGITS.sub("0", " ".join(line.split()).lower())


def _number(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


class Tokens:
    """Numbers and kinds of words, remembered up to a bound."""

    def __init__(self, most: int = 300_000):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.kind = np.zeros(1024, np.uint64), np.zeros(1024, np.int8)

    def look_up(self, tokens: list[str]) -> np.ndarray:
        known = self.known
        if new := [w for w in set(tokens) if w not in known]:
            if len(known) + len(new) > self.most:
                self.clear()
                known, new = self.known, list(set(tokens))
            while len(known) + len(new) > len(self.ids):
                self.ids, self.kind = np.append(self.ids, np.zeros_like(self.ids)), np.append(self.kind, np.zeros_like(self.kind))
            for w in new:
                i = known[w] = len(known)
                low = w.lower()
                self.ids[i] = _number(low) & 0xFFFFFFFFFFFFFFFF
                self.kind[i] = _DIGIT if w[:1].isdigit() else _MONTH if low in MONTHS else 0
                self.kind[i] += _CAPITAL * w[:1].isupper()
        return np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))


_DIGIT, _MONTH, _CAPITAL = 1, 2, 4
_MASKS = np.array([0, 1, 2, 3], np.uint64)


def masked(lines: list[str], memory: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """(word numbers, line of each): numbers, months and names masked, a run of one mask made one."""
    split = [_TOKEN.findall(x) or [""] for x in lines]
    n = np.array([len(x) for x in split])
    at = memory.look_up([w for x in split for w in x])
    ids, kind = memory.ids[at], memory.kind[at]
    line = np.repeat(np.arange(len(lines)), n)
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    capital = kind >= _CAPITAL
    shout = 2 * np.bincount(line, capital, minlength=len(lines)) > n + 2  # all in capitals: names can't be told
    start = np.zeros(len(ids), bool)
    start[first] = True
    mask = np.zeros(len(ids), np.int8)
    mask[capital & ~shout[line] & ~start] = 3
    mask[(kind & 3 == _MONTH) & ~((mask == 3) & ~shout[line])] = 2
    mask[kind & 3 == _DIGIT] = 1
    ids = np.where(mask > 0, _MASKS[mask], ids)
    again = np.concatenate([[False], (mask[1:] > 0) & (mask[1:] == mask[:-1]) & ~start[1:]])
    return ids[~again], line[~again]


def shingles(lines: list[str], memory: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all lines one after the other, and where each line starts. Every line has at least one."""
    ids, line = masked(lines, memory)
    n = np.bincount(line, minlength=len(lines))
    start = np.concatenate([[0], np.cumsum(n)[:-1]])
    with np.errstate(over="ignore"):
        roll = np.zeros(len(ids), np.uint64)
        for k in range(SHINGLE):
            roll *= np.uint64(0x9E3779B97F4A7C15)
            m = len(ids) - k
            if m > 0:  # words beyond the line's end count as nothing
                roll[:m] += np.where(line[k:] == line[:m], ids[k:] + np.uint64(1), np.uint64(0))
        roll = _mix(roll)
    count = np.maximum(1, n - SHINGLE + 1)
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    return roll[np.repeat(start - first, count) + np.arange(count.sum())], first


LINE = "sec_id bigint, text bigint, line_no int, doc bigint, nkey bigint, class bigint, home bigint, shingles array<int>"


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From sec_id, text, doc, site, content: the lines. Only the first line of a class in a task has its home and shingles."""
    words = Tokens()
    known: dict[str, int] = {}
    sent: set[int] = set()
    for batch in batches:
        if len(sent) > REMEMBERED:  # some are then sent again
            sent.clear()
        for at in range(0, batch.num_rows, 300):
            part = batch.slice(at, 300)
            rows, no, lines, keys, sites = [], [], [], [], []
            for r, (site, text) in enumerate(zip(part.column(3).to_pylist(), part.column(4).to_pylist(), strict=True)):
                name = "" if site is None else f"{site}\n"
                for i, line in enumerate(text.split("\n")):
                    if same := same_line(line):
                        rows.append(r)
                        no.append(i)
                        lines.append(line)
                        keys.append(_number(name + same))
                        if name not in known:
                            known[name] = _number(name)
                        sites.append(known[name])
            if not lines:
                continue
            sh, start = shingles(lines, words)
            n = np.diff(np.append(start, len(sh)))
            home = np.array(sites, np.int64)
            with np.errstate(over="ignore"):  # a class is a sequence of shingles within a site
                place = (np.arange(len(sh)) - np.repeat(start, n)).astype(np.uint64)
                classes = _mix(np.add.reduceat(_mix(sh + place * np.uint64(0xA24BAED4963EE407)), start) ^ _mix(home.view(np.uint64))).view(np.int64)
            _, once = np.unique(classes, return_index=True)
            fresh = [i for i in once.tolist() if classes[i] not in sent]
            sent.update(classes[fresh].tolist())
            lead = np.zeros(len(lines), bool)
            lead[fresh] = True
            own = (sh[np.repeat(lead, n)] >> np.uint64(33)).astype(np.int32)
            offsets = pa.array(np.concatenate([[0], np.cumsum(n * lead)]), pa.int32())
            kept = part.select([0, 1, 2]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [kept.column(0), kept.column(1), pa.array(no, pa.int32()), kept.column(2), pa.array(keys, pa.int64()), pa.array(classes), pa.array(home, mask=~lead), pa.ListArray.from_arrays(offsets, pa.array(own), mask=pa.array(~lead))],
                names=[x.split()[0] for x in LINE.split(", ")],
            )


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, all values one after the other)."""
    return column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), column.flatten().to_numpy(zero_copy_only=False)


def bucket_keys(home: np.ndarray, n: np.ndarray, sh: np.ndarray) -> np.ndarray:
    """A key for each shingle of sets that lie one after the other in `sh`: the shingle within its site."""
    with np.errstate(over="ignore"):
        return _mix(np.repeat(_mix(home.view(np.uint64)), n) + sh.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def slots(keys: np.ndarray) -> list[np.ndarray]:
    """The counter of each key in every row of the sketch."""
    return [((keys >> np.uint64(20 * r)) & np.uint64(SKETCH - 1)).astype(np.int64) + r * SKETCH for r in range(SKETCH_ROWS)]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From home, shingles of all classes: the task's sketch."""
    count = np.zeros(SKETCH * SKETCH_ROWS, np.int64)
    for batch in batches:
        n, sh = _lists(batch.column(1))
        for at in slots(bucket_keys(batch.column(0).to_numpy(zero_copy_only=False), n, sh)):
            count += np.bincount(at, minlength=len(count))
    there = np.flatnonzero(count)
    yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(count[there])], names=["slot", "n"])


def sketch_of(sets: DataFrame) -> np.ndarray:
    """Counters of how many classes hold a shingle of a site, of a fixed size whatever the data: never too low."""
    t = sets.select("home", "shingles").mapInArrow(_counted, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SKETCH * SKETCH_ROWS, np.uint32)
    out[t.column("slot").to_numpy()] = np.minimum(t.column("n").to_numpy(), 2**32 - 1)
    return out


def least_hashes(home: np.ndarray, n: np.ndarray, sh: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, bucket, bound of the bucket's size) of the buckets of all sets.

    A set's buckets are its least elements in an order of all shingles of a site: rare ones first, then by hash. Of m
    elements it takes the first m - ceil(SIMILAR * m) + 1: two sets with a similarity of `SIMILAR` or more share one of those.
    """
    keys = bucket_keys(home, n, sh)
    seen = np.minimum.reduce([sketch[at] for at in slots(keys)]).astype(np.int64)
    of = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((keys, seen, of))
    many = n - np.ceil(SIMILAR * n - 1e-9).astype(np.int64) + 1
    first = order[np.arange(len(keys)) - np.repeat(np.cumsum(n) - n, n) < many[of]]
    return of[first], keys[first], seen[first]


CELL = "cell bigint, side tinyint, class bigint, size int, bits_0 bigint, bits_1 bigint, shingles array<int>"


def _cells(batches: Iterator[pa.RecordBatch], sketch: np.ndarray, most: int = PAIRS_UP_TO) -> Iterator[pa.RecordBatch]:
    """From class, home, shingles: every class in each cell of its buckets. Shingles come along where a bucket has several blocks."""
    for whole in batches:
        for start in range(0, whole.num_rows, 2000):
            batch = whole.slice(start, 2000)
            classes, home = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            n, sh = _lists(batch.column(2))
            begin = np.cumsum(n) - n
            bits = np.zeros((2, len(n)), np.uint64)  # a bit for each shingle: sets differ in at least as many shingles as bits
            for half in (0, 1):
                bits[half] = np.bitwise_or.reduceat(np.where(sh >> 6 & 1 == half, np.uint64(1) << (sh & 63).astype(np.uint64), np.uint64(0)), begin)
            row, bucket, bound = least_hashes(home, n, sh, sketch)
            blocks = np.maximum(1, -(-bound // most))
            own = (_mix(classes.view(np.uint64))[row] % blocks.astype(np.uint64)).astype(np.int64)
            # a class meets its own block and every other one: cell (i, j), i <= j, has block i on side 0 and block j on side 1
            at = np.repeat(np.arange(len(row)), blocks)
            other = np.arange(len(at)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            i, j = np.minimum(own[at], other), np.maximum(own[at], other)
            with np.errstate(over="ignore"):
                cell = np.where(blocks[at] == 1, bucket[at], _mix(bucket[at] + _mix((i * (1 << 32) + j).astype(np.uint64))))
            of, many = row[at], blocks[at] > 1
            size = np.where(many, n[of], 0)
            parts = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), batch.column(2).take(pa.array(of[many])).flatten(), mask=pa.array(~many))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell.view(np.int64)), pa.array((own[at] == j).astype(np.int8) * (i < j).astype(np.int8)), pa.array(classes[of]), pa.array(n[of].astype(np.int32)), *(pa.array(b[of].view(np.int64)) for b in bits), parts],
                names=[x.split()[0] for x in CELL.split(", ")],
            )


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows ordered by cell, side and size: pairs (a, b, sure) that may be alike; those of a bucket with several blocks are sure."""
    rest: pa.RecordBatch | None = None
    for batch in batches:
        if rest is not None:
            batch = pa.concat_batches([rest, batch])
        cell = batch.column(0).to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(cell, cell[-1])) if len(cell) else 0  # the last cell may go on
        rest = batch.slice(last)
        yield from _pairs_of(batch.slice(0, last))
    if rest is not None:
        yield from _pairs_of(rest)


def _pairs_of(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    if not rows.num_rows:
        return
    cell, side, classes, size, *bits = (rows.column(i).to_numpy(zero_copy_only=False) for i in range(6))
    plain = rows.column(6).is_null().to_numpy(zero_copy_only=False)
    edge = np.concatenate([[True], cell[1:] != cell[:-1]])
    ends = np.append(np.flatnonzero(edge), len(cell))
    # with sizes in order the partners of a row are the following ones of its cell up to its size / SIMILAR
    reach, mine = np.zeros(len(cell), np.int64), np.flatnonzero(plain)
    place = (np.cumsum(edge)[mine] << 32) + size[mine]
    most = (np.cumsum(edge)[mine] << 32) + np.floor(size[mine] / SIMILAR + 1e-9).astype(np.int64)
    reach[mine] = np.searchsorted(place, most, "right") - np.arange(len(mine)) - 1
    out: list[tuple[np.ndarray, np.ndarray]] = []
    step = np.append(np.searchsorted(np.cumsum(reach), np.arange(0, reach.sum(), 2_000_000), "left"), len(reach))
    for a, b in zip(step, step[1:], strict=False):
        x = np.repeat(np.arange(a, b), reach[a:b])
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(reach[a:b]) - reach[a:b], reach[a:b])
        apart = sum(np.bitwise_count(v[x] ^ v[y]).astype(np.int64) for v in (b.view(np.uint64) for b in bits))
        near = apart <= (1 - SIMILAR) / (1 + SIMILAR) * (size[x].astype(np.int64) + size[y]) + 1e-6
        out.append((classes[x[near]], classes[y[near]]))
    sure: list[tuple[np.ndarray, np.ndarray]] = []
    several = ~plain[ends[:-1]] & (np.diff(ends) > 1)
    for a, b in zip(ends[:-1][several], ends[1:][several], strict=True):
        sure += _joined(classes[a:b], side[a:b], *_lists(rows.column(6).slice(a, b - a)))
    for found, yes in ((out, False), (sure, True)):
        if found:
            x, y = (np.concatenate(z) for z in zip(*found, strict=True))
            both = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1)[x != y], axis=0)
            if len(both):
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(np.full(len(both), yes))], names=["a", "b", "sure"])


def _joined(classes: np.ndarray, side: np.ndarray, n: np.ndarray, sh: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs that join what is alike in one cell: across its two sides, or among all rows where there is one side."""
    one = side == 0
    left, right = (one, ~one) if side.any() else (one, one)
    pick = lambda m: (n[m], sh[np.repeat(m, n)])
    if not left.any() or not right.any():
        return []
    alike = _alike(*pick(left), *pick(right))
    a, b, far = classes[left], classes[right], int(left.sum())
    to_a, to_b = np.arange(far), np.full(len(b), far)
    while True:  # the first of `a` that each is joined with
        to_b = np.where(alike, to_a[:, None], far).min(0)
        new = np.minimum(to_a, np.where(alike, to_b, far).min(1))
        if (new == to_a).all():
            break
        to_a = new
    met = to_b < far
    return [(a[to_a], a), (a[to_b[met]], b[met])]


def _alike(na: np.ndarray, xa: np.ndarray, nb: np.ndarray, xb: np.ndarray) -> np.ndarray:
    """Which of the sets of sizes `na`, one after the other in `xa`, are alike which of those in `xb`."""
    words = np.intersect1d(xa, xb)
    both = np.zeros((len(na), len(nb)), np.float32)
    for at in range(0, len(words), 4096):
        part = words[at : at + 4096]
        one, other = (_incidence(n, x, part) for n, x in ((na, xa), (nb, xb)))
        both += one @ other.T
    both = both.astype(np.float64)
    return both >= SIMILAR * (na[:, None] + nb[None, :] - both) - 1e-9


def _incidence(n: np.ndarray, x: np.ndarray, words: np.ndarray) -> np.ndarray:
    out = np.zeros((len(n), len(words)), np.float32)
    at = np.minimum(np.searchsorted(words, x), len(words) - 1)
    hit = words[at] == x
    out[np.repeat(np.arange(len(n)), n)[hit], at[hit]] = 1
    return out


def similar_links(sets: DataFrame, most: int = PAIRS_UP_TO) -> DataFrame:
    """(a, b): pairs of classes that are alike, or in a bucket of several blocks enough of them to connect all that are.

    `sets`, a written table, has class, home and distinct shingles.
    """
    sent = sets.sparkSession.sparkContext.broadcast(sketch_of(sets))
    cells = sets.select("class", "home", "shingles").mapInArrow(lambda batches: _cells(batches, sent.value, most), CELL)
    made = cells.repartition("cell").sortWithinPartitions("cell", "side", "size").mapInArrow(_pairs, "a bigint, b bigint, sure boolean")
    made = materialize(made, "pairs", plain=True)
    sure = made.filter("sure").select("a", "b")
    left, right = (sets.select(F.col("class").alias(x), F.col("shingles").alias(f"of_{x}")) for x in "ab")
    both = F.size(F.array_intersect("of_a", "of_b"))
    pairs = made.filter("not sure").select("a", "b").distinct().join(left, "a").join(right, "b")
    return pairs.filter(both >= SIMILAR * (F.size("of_a") + F.size("of_b") - both) - 1e-9).select("a", "b").unionByName(sure)


def text_key() -> Column:
    """Tells apart the versions of a section that have one sec_id."""
    return F.xxhash64(F.lit(3), "content")


def repeated_lines(sections: DataFrame, min_docs: int = 5, most: int = PAIRS_UP_TO) -> DataFrame:
    """sec_id, text, line_no, nkey, cluster, cluster_docs, line_docs of every line whose cluster is boilerplate.

    `sections` has sec_id, doc_id, site, content. `text` is the version of the section. `line_docs` counts the documents of the
    site with this very line, `cluster_docs` those with any line of its cluster. `most` classes meet in one block of a bucket.
    """
    rows = sections.filter("content is not null").select("sec_id", text_key().alias("text"), F.xxhash64("doc_id").alias("doc"), "site", "content")
    lines = materialize(rows.mapInArrow(_lines, LINE), "lines", plain=True)
    slim = lines.select("sec_id", "text", "line_no", "doc", "nkey", "class")
    sets = lines.filter("shingles is not null").select("class", "home", F.array_distinct("shingles").alias("shingles")).dropDuplicates(["class"])
    sets = materialize(sets, "sets", plain=True)
    links = materialize(similar_links(sets, most), "links", plain=True)
    release(sets)
    # spellings of one identity
    kinds = materialize(slim.select("nkey", "class").distinct(), "kinds", plain=True)
    ends = kinds.groupBy("nkey").agg(F.min("class").alias("a"), F.max("class").alias("z")).filter("a <> z").select("nkey", "a")
    spelt = kinds.join(ends, "nkey").filter("a <> class").select("a", F.col("class").alias("b"))
    parts = connected_components(links.unionByName(spelt)).select(F.col("node").alias("class"), F.col("component").alias("cluster"))
    several = slim.groupBy("class").agg(F.min("doc").alias("x"), F.max("doc").alias("y")).filter("x <> y").select("class")
    wanted = materialize(several.join(parts, "class", "full_outer").select("class", F.coalesce("cluster", "class").alias("cluster")), "wanted")
    seen = materialize(join_one(slim.select("class", "nkey", "doc"), wanted, "class").select("cluster", "nkey", "doc").distinct(), "seen", plain=True)
    by_line = seen.groupBy("cluster", "nkey").agg(F.count("doc").alias("line_docs"))
    by_cluster = seen.select("cluster", "doc").distinct().groupBy("cluster").agg(F.count("doc").alias("cluster_docs")).filter(F.col("cluster_docs") >= min_docs)
    found = materialize(by_line.join(by_cluster, "cluster"), "found")
    release(links, kinds, wanted, seen)
    return join_one(slim.select("sec_id", "text", "line_no", "nkey"), found, "nkey")


def without_repeated(sections: DataFrame, found: DataFrame) -> DataFrame:
    """sec_id, content_clean, n_removed of every distinct version of a section, its boilerplate lines left out."""
    numbers = found.groupBy("sec_id", "text").agg(F.collect_set("line_no").alias("drop"))
    kept = F.filter(F.split("content", "\n"), lambda x, i: ~F.array_contains(F.col("drop"), i))
    rows = sections.select("sec_id", "content", text_key().alias("text")).distinct().join(numbers, ["sec_id", "text"], "left")
    clean = F.when(F.col("drop").isNull(), F.col("content")).otherwise(F.array_join(kept, "\n"))
    return rows.select("sec_id", clean.alias("content_clean"), F.coalesce(F.size("drop"), F.lit(0)).alias("n_removed"))
