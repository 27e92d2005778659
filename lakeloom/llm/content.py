"""Scores of abusive, hateful and sexually explicit content.

Sentences are compared by a gap-weighted subsequence kernel: two sentences are alike by the subsequences of `LENGTH` characters
they share, each weighted by `DECAY` to the power of its span, spans up to `WINDOW`. Insults with inserted, replaced or
repeated characters so still share most subsequences. The kernel is mapped to vectors by Nyström landmarks and a linear support
vector machine (squared hinge) is trained for each category.

As a score is linear in the kernel with the landmarks, and that is linear in a sentence's subsequences, the trained
machine is one weight for each subsequence of any landmark and category: scoring is a lookup, with the same result.

Labels belong to documents, so the sentences of a labelled document that carry the label are found by alternating
training and choosing: at first all sentences of a positive document that are not usual in the corpus count, later those the
machine scores high. Wrong labels are outvoted by the soft margin.

Training uses at most `LABELLED` labelled documents, and as doubtful negatives the `FREQUENT` sentences that most documents of
the whole corpus have. How many documents have a word or a run of words is counted over all documents. The score from which a
document is flagged is found on held-out folds of the labelled documents and moved to 0, so scores above 0 are flagged.
Every document is scored, whole.

Defined results: null and blank texts score `EMPTY` in every category; without labelled documents of a category all its
scores are `EMPTY`; repeated labels count once; a document, and a sentence, may have several categories. A repeated doc_id
keeps its highest scores. Extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.boilerplate import MONTHS
from lakeloom.llm.normalize import canonical
from lakeloom.session import bounded_sample, gather, materialize

CATEGORIES = ("abusive", "hateful", "sexual")
#: Bound on labelled training documents; the corpus's most frequent sentences taken as doubtful negatives; landmarks.
LABELLED, FREQUENT, LANDMARKS = 6_000, 8_000, 600
#: Weight of the frequent sentences; the score from which they are left out; the share of documents from
#: which a word or a run of three is usual.
BACKGROUND_WEIGHT, NEAR, COMMON = 0.25, -0.6, 0.004
LENGTH, WINDOW, DECAY = 4, 6, 0.8
ROUNDS, FOLDS, COST, EMPTY = 4, 4, 4.0, -2.0
#: Texts compared with the landmarks at once, for the memory it takes.
STEP = 40
PATTERNS = [(0, *c) for c in combinations(range(1, WINDOW), LENGTH - 1)]
_WEIGHT = np.array([DECAY ** (p[-1] - LENGTH + 1) for p in PATTERNS])
_END = re.compile(r"[.!?…]+[\"”»)']*\s+|\n\s*\n|\n(?=[A-ZÆØÅÄÖÜА-ЯІЇЄҐ0-9•>*-])")
_ABBREVIATED = re.compile(r"(?:\d|\b(?:kr|nr|kl|ca|evt|z\.B))$")
_NEXT = re.compile(r"[^\W\d_]+")
_TOKEN = re.compile(r"[\w*@$]+|[^\w\s]")
_LETTERS = re.compile(r"[^\W\d_]+")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][ .\-_*]){2,}[^\W\d_](?![^\W_])")
_APART = re.compile(r"[ .\-_*]")
_REPEATED = re.compile(r"(.)\1{2,}")
_OPENING = frozenset(":.!?\"'«“")
_LEET = str.maketrans("0134578@$", "oieastbas")


def sentences(text: str) -> list[str]:
    """All that hold a letter."""
    out, at = [], 0
    for m in _END.finditer(text):
        if m[0][0] == "." and m[0][1:2] != "." and _ABBREVIATED.search(text, max(at, m.start() - 8), m.start()):
            w = _NEXT.match(text, m.end())
            if not w or w[0][0].islower() or w[0].lower() in MONTHS:
                continue
        out.append(text[at : m.end()])
        at = m.end()
    out.append(text[at:])
    return [x.strip() for x in out if _LETTERS.search(x)]


@lru_cache(1 << 17)
def _kind(w: str) -> tuple[str, bool, bool, bool, bool]:
    """(plain form, is a word, in capitals, starts with a capital, may be a name)."""
    if w.isdigit():
        return "0", False, False, False, False
    low = w.translate(_LEET) if any(c.isdigit() or c in "@$" for c in w) and any(c.isalpha() for c in w) else w
    low = _REPEATED.sub(r"\1", low.lower())
    return low, w[0].isalpha(), w.isupper() and len(w) > 1, w[0].isupper() and len(w) > 1, w[0].isupper() and not (w.isupper() and len(w) > 2)


def prepared(sentence: str) -> str:
    """Lower case, numbers and names masked, letters written as digits or apart brought back.

    A name is a capital word within a sentence, or at its start before another one; words in capitals are no names.
    """
    found = _TOKEN.findall(_SPACED.sub(lambda m: _APART.sub("", m[0]), sentence))
    kinds = list(map(_kind, found))
    shout = 2 * sum(k[2] for k in kinds) > sum(k[1] for k in kinds)
    out: list[str] = []
    last, n = "", len(found)
    for i, k in enumerate(kinds):
        form = k[0]
        if k[4] and not shout and (i > 0 and found[i - 1] not in _OPENING or (i + 1 < n and kinds[i + 1][3])):
            form = "^"
        if form != last or (form != "0" and form != "^"):
            out.append(form)
        last = form
    return " " + " ".join(out) + " "


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, subsequence, weight), one row for each text and subsequence, weights scaled so each text has norm 1."""
    raw = "".join(t + "\0" * WINDOW for t in texts)
    c = np.frombuffer(raw.encode("utf-32-le"), np.uint32).astype(np.uint64)
    of = np.repeat(np.arange(len(texts)), [len(t) + WINDOW for t in texts])
    n = len(c) - WINDOW
    if n <= 0:
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0))
    alls, text, weight = [], [], []
    with np.errstate(over="ignore"):
        for p, w in zip(PATTERNS, _WEIGHT, strict=True):
            h = np.zeros(n, np.uint64)
            for k in p:
                h = (h ^ c[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            ok = c[p[-1] : p[-1] + n] != 0
            ok &= c[:n] != 0
            ok &= of[:n] == of[p[-1] : p[-1] + n]
            alls.append(h[ok])
            text.append(of[:n][ok])
            weight.append(np.full(ok.sum(), w))
    h, t, w = np.concatenate(alls), np.concatenate(text), np.concatenate(weight)
    order = np.lexsort((h, t))
    h, t, w = h[order], t[order], w[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (t[1:] != t[:-1])]) if len(h) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    w = np.add.reduceat(w, at) if len(at) else w
    h, t = h[at], t[at]
    norm = np.sqrt(np.bincount(t, w * w, minlength=len(texts)))
    return t, h, w / np.maximum(norm[t], 1e-12)


class Landmarks:
    """The subsequences of the landmark sentences, sorted, with the landmarks that have each."""

    def __init__(self, texts: list[str]):
        t, h, w = codes(texts)
        order = np.argsort(h, kind="stable")
        self.n, self.owner, self.weight = len(texts), t[order], w[order]
        self.keys, self.start = np.unique(h[order], return_index=True)
        self.count = np.diff(np.append(self.start, len(h)))

    def kernel(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.n))
        for a in range(0, len(texts), STEP):
            part = texts[a : a + STEP]
            t, h, w = codes(part)
            i = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            hit = self.keys[i] == h
            t, i, w = t[hit], i[hit], w[hit]
            n = self.count[i]
            at = np.repeat(self.start[i] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            flat = np.repeat(t, n) * self.n + self.owner[at]
            out[a : a + STEP] = np.bincount(flat, np.repeat(w, n) * self.weight[at], minlength=len(part) * self.n).reshape(len(part), -1)
        return out


class Machine:
    """One weight for each subsequence and category, and the offsets."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, offset: np.ndarray):
        self.keys, self.weights, self.offset = keys, weights.astype(np.float32), offset

    def scores(self, texts: list[str]) -> np.ndarray:
        out = np.full((len(texts), len(CATEGORIES)), EMPTY)
        if not len(self.keys):
            return out
        for a in range(0, len(texts), 500):
            part = texts[a : a + 500]
            t, h, w = codes(part)
            i = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            hit = self.keys[i] == h
            t, i, w = t[hit], i[hit], w[hit]
            for k in range(len(CATEGORIES)):
                out[a : a + 500, k] = np.bincount(t, w * self.weights[i, k], minlength=len(part)) + self.offset[k]
        return out


def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, start: np.ndarray | None = None, cost: float = COST) -> np.ndarray:
    """Coefficients, the offset last, of a machine with squared hinge loss, by Newton steps on the rows inside the margin."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    beta = np.zeros(x.shape[1]) if start is None else start
    for turn in range(30):
        inside = 1 - y * (x @ beta) > 0
        xi, wi = x[inside], weight[inside]
        scaled = (xi * wi[:, None]).T
        new = np.linalg.solve(ridge + 2 * cost * scaled @ xi, 2 * cost * scaled @ y[inside])
        if np.abs(new - beta).max() < 1e-6:
            break
        beta = 0.5 * beta + 0.5 * new if turn > 10 else new
    return beta


def triples(sentence: str) -> list[str]:
    w = sentence.split()
    return [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]


def grams(sentence: str) -> list[str]:
    """Its words and runs of three."""
    return [*triples(sentence), *_LETTERS.findall(sentence)]


class Space:
    """Sentences as Nyström vectors."""

    def __init__(self, marks: list[str]):
        self.lm = Landmarks(marks)
        k = self.lm.kernel(marks)
        values, vectors = np.linalg.eigh((k + k.T) / 2)
        keep = values > 1e-6 * values[-1]
        self.root = vectors[:, keep] / np.sqrt(values[keep])

    def __call__(self, texts: list[str]) -> np.ndarray:
        return self.lm.kernel(texts) @ self.root

    def machine(self, beta: np.ndarray) -> Machine:
        flat = (self.root @ beta[:, :-1].T)[self.lm.owner] * self.lm.weight[:, None]
        return Machine(self.lm.keys, np.add.reduceat(flat, self.lm.start, axis=0), beta[:, -1])


Documents = list[tuple[list[str], frozenset[str]]]


def positives(docs: Documents) -> list[tuple[int, str, frozenset[str]]]:
    """(document, sentence, its document's categories) of the documents with any."""
    return [(d, s, cats & set(CATEGORIES)) for d, (ss, cats) in enumerate(docs) if cats & set(CATEGORIES) for s in dict.fromkeys(ss)]


def train(docs: Documents, frequent: list[str], seen: dict[str, int], n_docs: int, vectors=lambda space, texts: space(texts), seed: int = 4) -> Machine:
    """From the prepared sentences of labelled documents and their categories.

    `frequent` sentences are taken as clean with a low weight; those with unusual words that score near the margin are left
    out from the second round on. `seen` says in how many of the `n_docs` documents of the corpus a word or a run of
    three is. In the last round the landmarks are chosen anew: positives and the hardest negatives.
    """
    rng = np.random.default_rng(seed)
    clean: dict[str, set[int]] = {}
    for d, (ss, cats) in enumerate(docs):
        if not cats & set(CATEGORIES):
            for s in ss:
                clean.setdefault(s, set()).add(d)
    positive = positives(docs)
    known = sorted(clean)
    rest = sorted({s for s in frequent if s not in clean})
    if not positive or not known and not rest:
        return Machine(np.zeros(0, np.uint64), np.zeros((0, len(CATEGORIES))), np.full(len(CATEGORIES), EMPTY))
    base, n = known + rest, len(known) + len(rest)
    texts = sorted({*base, *(s for _, s, _ in positive)})
    number = {s: i for i, s in enumerate(texts)}
    row = np.array([number[s] for s in base] + [number[s] for _, s, _ in positive])
    labels = np.array([[c in cats for c in CATEGORIES] for _, _, cats in positive])
    common = max(4, COMMON * n_docs)
    seen = dict(seen)
    for ss, cats in docs:  # what counts is how usual it is outside the documents that carry the labels
        for g in {g for s in ss for g in grams(s)} if cats & set(CATEGORIES) else ():
            seen[g] = seen.get(g, 0) - 1

    def plain(s: str) -> bool:
        return all(seen.get(w, 0) >= common for w in _LETTERS.findall(s))

    # sentences of the corpus's own patterns: most of their runs of three words, or all of their words, are in many documents
    usual = np.array([s in clean or plain(s) or sum(seen.get(g, 0) >= common for g in triples(s)) >= 0.5 * len(triples(s)) for _, s, _ in positive])
    chosen = labels & ~usual[:, None]
    fresh = sorted({s for (_, s, _), u in zip(positive, usual, strict=True) if not u})
    marks = [fresh[i] for i in rng.permutation(len(fresh))[: LANDMARKS // 2]]
    space = Space(sorted({*marks, *(base[i] for i in rng.permutation(n)[: LANDMARKS - len(marks)])}))
    x = vectors(space, texts)[row]
    weight = np.concatenate([np.ones(len(known)), np.full(len(rest), BACKGROUND_WEIGHT)])
    rare = np.array([not plain(s) for s in rest], bool)

    def solved(chosen: np.ndarray, weight: np.ndarray, there: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
        """Coefficients of all categories from the rows of positive documents that are `there`."""
        beta = np.zeros((len(CATEGORIES), x.shape[1] + 1))
        for k in range(len(CATEGORIES)):
            if not labels[:, k].any():
                beta[k, -1] = EMPTY
                continue
            others = chosen.any(1) & ~chosen[:, k]
            use = np.concatenate([weight > 0, (chosen[:, k] | others) & there])
            y = np.concatenate([-np.ones(n), np.where(chosen[:, k], 1.0, -1.0)])[use]
            w = np.concatenate([weight, np.where(chosen[:, k], 1.5, 0.7)])[use]
            beta[k] = svm(x[use], y, w, None if start is None else start[k])
        return beta

    every = np.ones(len(positive), bool)
    for turn in range(ROUNDS):
        beta = solved(chosen, weight, every)
        if turn == ROUNDS - 1:
            break
        score = x @ beta[:, :-1].T + beta[:, -1]
        top = score.max(1)
        weight[len(known) :] = np.where((top[len(known) : n] > NEAR) & rare, 0.0, BACKGROUND_WEIGHT)
        ok = score[n:] > (-0.5, -0.3, -0.2)[min(turn, 2)]
        new = labels & ~usual[:, None] & ok & (score[n:] >= top[n:, None])
        chosen = np.where(new.any(0), new, chosen)
        if turn == ROUNDS - 2:
            mine = sorted({s for (_, s, _), c in zip(positive, chosen, strict=True) if c.any()})
            mine = [mine[i] for i in rng.permutation(len(mine))[: LANDMARKS * 6 // 10]]
            hard = [base[i] for i in np.argsort(-np.where(weight > 0, top[:n], -9), kind="stable")[: LANDMARKS // 5]]
            space = Space(sorted({*mine, *hard, *(base[i] for i in rng.permutation(n)[: LANDMARKS // 5])}))
            x = vectors(space, texts)[row]
    # held-out scores of the labelled documents
    fold = rng.permutation(len(docs)) % FOLDS
    of = np.array([d for d, _, _ in positive])
    held = np.full((len(docs), len(CATEGORIES)), EMPTY)
    only = np.array([fold[next(iter(clean[s]))] if len({fold[d] for d in clean[s]}) == 1 else -1 for s in known] + [-1] * len(rest))
    place = {s: i for i, s in enumerate(known)}
    rows_of = [[place[s] for s in set(ss)] if not cats & set(CATEGORIES) else [] for ss, cats in docs]
    for d, r in zip(of.tolist(), range(n, n + len(of)), strict=True):
        rows_of[d].append(r)
    for f in range(FOLDS):
        b = solved(chosen, np.where(only == f, 0.0, weight), fold[of] != f, beta)
        score = x @ b[:, :-1].T + b[:, -1]
        for d in np.flatnonzero(fold == f):
            if rows_of[d]:
                held[d] = score[rows_of[d]].max(0)
    truth = np.array([[c in cats for c in CATEGORIES] for _, cats in docs])
    there = labels.any(0)
    machine = space.machine(beta)
    machine.offset = np.where(there, machine.offset - best_threshold(held[:, there], truth[:, there]), EMPTY)
    return machine


def best_threshold(scores: np.ndarray, truth: np.ndarray) -> float:
    """The score above which F1 of all documents and categories together is highest, midway to the next lower one."""
    s, t = scores.ravel(), truth.ravel()
    order = np.argsort(-s, kind="stable")
    s, hit = s[order], np.cumsum(t[order])
    last = np.append(s[1:] < s[:-1], True)
    f1 = np.where(last, 2 * hit / (np.arange(1, len(s) + 1) + t.sum()), 0)
    i = int(f1.argmax())
    return float((s[i] + s[min(i + 1, len(s) - 1)]) / 2)


READY = "doc_id bigint, sentences array<string>"


def prepare(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the distinct prepared sentences of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [list(dict.fromkeys(map(prepared, sentences(canonical(t))))) if t else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.string()))], names=["doc_id", "sentences"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id is not null").mapInArrow(run, READY)


def document_counts(ready: DataFrame, wanted: list[str]) -> dict[str, int]:
    """In how many documents each of the wanted words and runs of three is."""
    number = {g: i for i, g in enumerate(wanted)}
    sent = ready.sparkSession.sparkContext.broadcast(number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = sent.value.get
        count = np.zeros(len(sent.value), np.int64)

        @lru_cache(1 << 16)
        def held(s: str) -> np.ndarray:
            return np.array([i for i in {get(g) for g in grams(s)} if i is not None], np.int64)

        for batch in batches:
            for ss in batch.column(0).to_pylist():
                if ss:
                    count[np.unique(np.concatenate([held(s) for s in ss]))] += 1
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(count[at])], names=["g", "n"])

    rows = ready.select("sentences").mapInArrow(run, "g bigint, n bigint").groupBy("g").agg(F.sum("n").alias("n"))
    return {wanted[r[0]]: r[1] for r in gather(rows, "the counts of wanted words", max(1, len(wanted)))}


def frequent_sentences(ready: DataFrame, most: int = FREQUENT) -> list[str]:
    """The sentences of most documents, ties by hash. Only hashes are shuffled; the texts of the few found follow."""
    each = ready.select(F.explode("sentences").alias("s")).select("s", F.xxhash64("s").alias("h"))
    top = materialize(each.groupBy("h").count().orderBy(F.desc("count"), "h").limit(most).select("h"), "frequent")
    return [r[0] for r in gather(each.join(F.broadcast(top), "h").groupBy("h").agg(F.min("s").alias("s")).select("s"), "the frequent sentences", most)]


def fit(ready: DataFrame, labels: DataFrame, id_col: str = "doc_id", most: int = LABELLED) -> Machine:
    """From the prepared documents, a written table, and their labels: at most `most` labelled documents, those with the smallest hashes of their ids."""
    per = labels.filter("category is not null").groupBy(F.col(id_col).cast("bigint").alias("doc_id")).agg(F.collect_set("category").alias("cats"))
    rows = bounded_sample(per.join(ready, "doc_id").select("doc_id", "sentences", "cats"), "doc_id", "the labelled sample", most, 2)
    docs: Documents = [(r[1], frozenset(r[2])) for r in rows]
    frequent = frequent_sentences(ready)
    wanted = {g for _, s, _ in positives(docs) for g in grams(s)} | {w for s in frequent for w in _LETTERS.findall(s)}
    seen = document_counts(ready, sorted(wanted))
    spark = ready.sparkSession

    def vectors(space: Space, texts: list[str]) -> np.ndarray:
        """The kernel's rows are made in tasks."""
        sent = spark.sparkContext.broadcast(space)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                v = sent.value(b.column(1).to_pylist()).astype(np.float32)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in v], pa.binary())], names=["i", "v"])

        table = spark.createDataFrame(pa.table({"i": np.arange(len(texts)), "s": texts}))
        parts = max(1, min(len(texts) // 200, 2 * spark.sparkContext.defaultParallelism))
        t = table.repartition(parts, "i").mapInArrow(run, "i bigint, v binary").toArrow()
        out = np.empty((len(texts), space.root.shape[1]), np.float32)
        for i, v in zip(t.column(0).to_pylist(), t.column(1).to_pylist(), strict=True):
            out[i] = np.frombuffer(v, np.float32)
        return out

    return train(docs, frequent, seen, ready.count(), vectors)


def score(ready: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, and for each category the highest score of any sentence."""
    sent = ready.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number: dict[str, int] = {}
            doc, of = [], []
            for d, ss in enumerate(batch.column(1).to_pylist()):
                for s in ss or ():
                    doc.append(d)
                    of.append(number.setdefault(s, len(number)))
            out = np.full((batch.num_rows, len(CATEGORIES)), EMPTY)
            if number:
                np.maximum.at(out, np.array(doc), sent.value.scores(list(number))[np.array(of)])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.round(out[:, k], 6)) for k in range(len(CATEGORIES)))], names=["doc_id", *CATEGORIES])

    scored = ready.mapInArrow(run, "doc_id bigint, " + ", ".join(f"{c} double" for c in CATEGORIES))
    return scored.groupBy("doc_id").agg(*(F.max(c).alias(c) for c in CATEGORIES))


def flagged(scored: DataFrame) -> DataFrame:
    """(doc_id, category) of scores above 0."""
    pairs = F.array(*(F.struct(F.lit(c).alias("category"), F.col(c).alias("score")) for c in CATEGORIES))
    return scored.select("doc_id", F.explode(pairs).alias("x")).filter("x.score > 0").select("doc_id", "x.category")


def rates(docs: DataFrame, scored: DataFrame) -> DataFrame:
    """For each source, written alike: documents, and the share above 0 in each category."""
    source = F.regexp_replace(F.lower(F.trim("source")), r"/+$", "")
    rows = docs.select("doc_id", source.alias("source")).join(scored, "doc_id")
    return rows.groupBy("source").agg(F.count("*").alias("n_docs"), *(F.round(F.avg((F.col(c) > 0).cast("int")), 6).alias(f"{c}_rate") for c in CATEGORIES))
