"""Languages of documents and of their lines, by n-gram filters that hold one bit for each language.

Training: lines of a bounded sample of labelled documents are assigned by function words; where that agrees with the
document's label, the line's word n-grams count for the language. An n-gram enters the filter of each language in which it is
frequent enough next to its most frequent language. The Bloom filters of all languages lie bit-sliced in one byte array:
the byte at a hash position has the bit of every language that set it, so that AND over an n-gram's positions
gives at once all languages that hold it.

Use: all n-grams of many lines are looked up together; the popcounts of a line for each language are corrected for the filter's
false positives, and the language with the highest count wins. Confidence is its lead over the second, by the
number of n-grams that tell languages apart. Words that start with a capital within a sentence, as names do, count less.

Lines of which too few n-grams are known in any language are of another one (`other`).

Defined results: null, empty and letterless texts have language null and confidence 0; ties go to the first language in the order
of LANGUAGES; without training documents the function words alone decide, and a line of the language they give is never of another one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.normalize import canonical
from lakeloom.session import bounded_sample

LANGUAGES = ("da", "en", "de", "sv", "nb", "uk")
# Language codes of ISO 639 and common function words of each language.
CODES = {
    "da": "da", "dan": "da", "en": "en", "eng": "en", "de": "de", "deu": "de", "ger": "de", "sv": "sv", "swe": "sv",
    "nb": "nb", "nob": "nb", "no": "nb", "nor": "nb", "uk": "uk", "ukr": "uk",
}
FUNCTION_WORDS = {
    "da": "og i at det er en til af på som med den for de ikke der et har kan fra hvis eller når bliver efter hos din dit dine skal må så du får af før hvad hvor hvordan mere noget nogle også blev været ved om mig dig jeg vi ud uden under mellem sig denne dette deres hvilke gennem inden os mindst senest",
    "en": "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so up said what its about than into them can only other time new some could these two may first then do any like my now over such our",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde wenn können ihre ihr ihnen sie wegen müssen bitte ab",
    "sv": "och i att det som en på är av för med den till inte om ett han men var jag från har de så kan vid efter sig eller när hon nu där också ska skulle under blev din ditt du får måste hos innan utan denna detta deras vilka minst senast genom själv oss inom",
    "nb": "og i det er på til som en for med av at ikke den har de et om var jeg fra seg men han så kan vi ble skal etter ved eller når nå også hun dere noe noen hva hvor hvordan mer blir hos din ditt du får må dersom hvis enn minst senest uten mellom vanligvis ellers oss innen",
    "uk": "і в на не що з до як та це за у від для про але або якщо ви ваш ваша вас він вона вони ми його її їх був була було буде є по при після перед коли де чи так ні також можна може через під над без між щоб який яка яке які цей ця всі",
}
# End of fixed values.

#: Bound on the training sample; Bloom positions for each n-gram; share of the top language's rate an n-gram needs elsewhere.
SAMPLE_DOCS, HASHES, SHARE = 12_000, 3, 0.12
LOG2_BITS = 20
#: What a run of letters counts next to a word.
LETTER_WEIGHT = 0.2
#: A line is of another language if the n-grams of its best language are less than this part of its words, of which it has so many.
OTHER, OTHER_SHARE, OTHER_WORDS = "other", 0.2, 5
#: One bit for each language.
BITS = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if np.dtype(t).itemsize * 8 >= len(LANGUAGES))
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_LETTER = re.compile(r"[^\W\d_]")
_URL = re.compile(r"\s*(?:(?:https?|ftp)://|www\.)\S+\s*|\s*[\w-]+(?:\.[\w-]+)+(?:/\S*)?\s*", re.I)


def label_language(c: Column) -> Column:
    """The language a label names, by its two- or three-letter code in any case, with or without a region; else null."""
    code = F.lower(F.regexp_extract(c, r"^\s*([A-Za-z]{2,3})(?:[-_][A-Za-z0-9]{2,4})*\s*$", 1))
    return F.create_map(*[F.lit(x) for kv in CODES.items() for x in kv])[code]


def words_of(line: str) -> list[str]:
    """Lower-case words; words with a capital after a lower-case start or another capital word are marked as names."""
    found = _WORD.findall(line)
    capitals = sum(w[0].isupper() or w[1:2].isupper() for w in found)
    if 2 * capitals > len(found):  # all in capitals, or a title: no way to tell names
        return [w.lower() for w in found]
    return [("^" if i and w[0].isupper() else "") + w.lower() for i, w in enumerate(found)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Stable 64-bit numbers of words, remembered up to a bound."""

    def __init__(self, most: int = 200_000):
        self.known: dict[str, int] = {}
        self.most = most

    def __call__(self, ws: list[str]) -> np.ndarray:
        from hashlib import blake2b

        known = self.known
        if len(known) > self.most:
            known.clear()
        out = np.empty(len(ws), np.uint64)
        for i, w in enumerate(ws):
            h = known.get(w)
            if h is None:
                h = known[w] = int.from_bytes(blake2b(w.encode("utf-8", "replace"), digest_size=8).digest(), "little")
            out[i] = h
        return out


def grams(ids: np.ndarray, line: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word and word-pair n-grams of all lines at once, with the line of each. Names give none."""
    with np.errstate(over="ignore"):
        one = _mix(ids)
        two = _mix(ids[:-1] * np.uint64(0x9E3779B97F4A7C15) + ids[1:]) if len(ids) > 1 else ids[:0]
    ok = ~names
    pair = (line[1:] == line[:-1]) & ok[1:] & ok[:-1] if len(ids) > 1 else np.zeros(0, bool)
    return np.concatenate([one[ok], two[pair]]), np.concatenate([line[ok], line[1:][pair]])


def letters_of(ws: list[str]) -> list[str]:
    """Runs of three letters of words, their ends marked."""
    return [p[i : i + 3] for w in ws if w[0] != "^" for p in (f"<{w}>",) for i in range(len(p) - 2)]


def letter_grams(split: list[list[str]], words: Words) -> tuple[np.ndarray, np.ndarray]:
    parts = [letters_of(ws) for ws in split]
    flat = [x for p in parts for x in p]
    return _mix(words(flat)), np.repeat(np.arange(len(parts)), [len(p) for p in parts])


class Filters:
    """Bit-sliced Bloom filters of all languages."""

    def __init__(self, log2_bits: int = LOG2_BITS, hashes: int = HASHES):
        self.mask = np.uint64((1 << log2_bits) - 1)
        self.slices = np.zeros(1 << log2_bits, BITS)
        self.hashes = hashes

    def _at(self, g: np.ndarray) -> list[np.ndarray]:
        with np.errstate(over="ignore"):
            step = (g >> np.uint64(32)) | np.uint64(1)
            return [((g + np.uint64(k) * step) & self.mask).astype(np.int64) for k in range(self.hashes)]

    def add(self, g: np.ndarray, languages: np.ndarray) -> None:
        for at in self._at(g):
            np.bitwise_or.at(self.slices, at, languages)

    def seal(self) -> Filters:
        fill = np.array([(self.slices >> BITS(k) & BITS(1)).mean() for k in range(len(LANGUAGES))])
        self.false = fill**self.hashes
        return self

    def languages(self, g: np.ndarray) -> np.ndarray:
        out = np.full(len(g), np.iinfo(BITS).max, BITS)
        for at in self._at(g):
            out &= self.slices[at]
        return out

    def counts(self, g: np.ndarray, line: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Corrected popcounts of n lines for each language; n-grams that tell languages apart."""
        sets = self.languages(g)
        total = np.bincount(line, minlength=n)
        full = BITS((1 << len(LANGUAGES)) - 1)
        telling = np.bincount(line[(sets != 0) & (sets != full)], minlength=n)
        c = np.stack([np.bincount(line[(sets >> BITS(k) & BITS(1)).astype(bool)], minlength=n) for k in range(len(LANGUAGES))], 1)
        return np.maximum(0, (c - total[:, None] * self.false) / (1 - self.false)), telling


def fill(f: Filters, by_language: list[np.ndarray]) -> set[int]:
    """Adds each n-gram to the languages in which it is frequent enough; returns the n-grams."""
    count, total = [], []
    for g in by_language:
        values, n = np.unique(g, return_counts=True)
        count.append(dict(zip(values.tolist(), n.tolist(), strict=True)))
        total.append(max(1, int(n.sum())))
    every = set().union(*count)
    keep, masks = [], []
    for g in every:
        rate = [c.get(g, 0) / t for c, t in zip(count, total, strict=True)]
        top = max(rate)
        keep.append(g)
        masks.append(sum(1 << k for k, r in enumerate(rate) if r >= SHARE * top and r > 0))
    if keep:
        f.add(np.array(keep, np.uint64), np.array(masks, BITS))
    return every


def train(rows: list[tuple[str, str]], words: Words | None = None) -> Filters:
    """From (text, language) of documents. Filters of letter runs, for lines on which words do not decide, are in `letters`."""
    words = words or Words()
    seeds = {lang: set(ws.split()) for lang, ws in FUNCTION_WORDS.items()}
    lines: list[tuple[int, list[str]]] = []
    for text, lang in rows:
        for line in canonical(text).split("\n"):
            ws = words_of(line)
            score = sorted(((sum(w in seeds[x] for w in ws), x) for x in LANGUAGES), reverse=True)
            if score[0][1] == lang and score[0][0] >= 3 and score[0][0] >= score[1][0] + 2:
                lines.append((LANGUAGES.index(lang), ws))
    f = Filters()
    f.letters = Filters()
    by_word, by_letter = [], []
    for k, lang in enumerate(LANGUAGES):
        mine = [ws for x, ws in lines if x == k]
        flat = [w for ws in mine for w in ws]
        by_word.append(grams(words(flat), np.repeat(np.arange(len(mine)), [len(x) for x in mine]), np.array([w[0] == "^" for w in flat], bool))[0])
        by_letter.append(letter_grams([[*{w for w in flat}, *seeds[lang]]], words)[0])
    every = fill(f, by_word)
    fill(f.letters, by_letter)
    f.letters.seal()
    for k, lang in enumerate(LANGUAGES):
        ws = sorted(seeds[lang])
        g, _ = grams(words(ws), np.arange(len(ws)), np.zeros(len(ws), bool))
        new = np.array([x not in every for x in g.tolist()])
        f.add(g[new], np.full(new.sum(), 1 << k, BITS))
    f.trained = np.array([any(x == k for x, _ in lines) for k in range(len(LANGUAGES))])
    return f.seal()


def detect(f: Filters, words: Words, lines: list[str]) -> tuple[list[str | None], np.ndarray]:
    """Language and confidence of each line."""
    split = [words_of(canonical(x)) for x in lines]
    flat = [w for ws in split for w in ws]
    of = np.repeat(np.arange(len(lines)), [len(x) for x in split])
    g, line = grams(words(flat), of, np.array([w[0] == "^" for w in flat], bool))
    c, telling = f.counts(g, line, len(lines))
    none = c.max(1) <= 0 if len(lines) else np.zeros(0, bool)
    if none.any():  # nothing but names or unknown words: names count too
        plain = [[w.lstrip("^") for w in ws] if none[i] else [] for i, ws in enumerate(split)]
        flat = [w for ws in plain for w in ws]
        g, line = grams(words(flat), np.repeat(np.arange(len(lines)), [len(x) for x in plain]), np.zeros(len(flat), bool))
        c2, t2 = f.counts(g, line, len(lines))
        c[none], telling[none] = c2[none], t2[none]
    n_words = np.array([sum(w[0] != "^" for w in ws) for ws in split], int)
    other = f.trained[c.argmax(1)] & (n_words >= OTHER_WORDS) & (c.max(1) < OTHER_SHARE * n_words) if len(lines) else none
    if len(lines):  # few words decide: runs of letters of all words but names help
        top = np.sort(c, 1)
        weak = np.flatnonzero(top[:, -1] - top[:, -2] < 2)
        if len(weak):
            part = [[w.lstrip("^") for w in split[i]] if none[i] else split[i] for i in weak]
            g, line = letter_grams(part, words)
            c[weak] += LETTER_WEIGHT * f.letters.counts(g, line, len(weak))[0]
    best = c.argmax(1) if len(lines) else np.zeros(0, int)
    ordered = np.sort(c, 1)
    lead = (ordered[:, -1] - ordered[:, -2]) / np.maximum(1, ordered[:, -1]) if len(lines) else np.zeros(0)
    confidence = np.round(lead * (1 - np.exp(-telling / 5)), 4)
    found = [OTHER if other[i] else LANGUAGES[b] if c[i, b] > 0 else None for i, b in enumerate(best)]
    return found, np.where([x is None for x in found], 0.0, confidence) if found else confidence


def fit(docs: DataFrame, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id", most: int = SAMPLE_DOCS) -> Filters:
    """Filters from at most `most` labelled documents, those with the smallest hashes of their ids."""
    sample = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"), label_language(F.col(label_col)).alias("l")).filter("t is not null and l is not null")
    return train([(r[1], r[2]) for r in bounded_sample(sample, "k", "the training sample", most, 3)])


def detect_lines(rows: DataFrame, filters: Filters, keep: list[str], text_col: str = "content", min_letters: int = 20) -> DataFrame:
    """`keep`, line_no, lang, confidence, n_letters, only_url for each line with at least `min_letters` letters."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(filters)
    src = rows.select(*keep, F.col(text_col).alias("__text")).filter("__text is not null")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema[:-1]), "line_no int", "line_lang string", "confidence double", "only_url boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                at, no, lines = [], [], []
                for r, text in enumerate(part.column(part.num_columns - 1).to_pylist()):
                    for i, line in enumerate(text.split("\n")):
                        if len(line) >= min_letters and len(_LETTER.findall(line)) >= min_letters:
                            at.append(r)
                            no.append(i)
                            lines.append(line)
                if not lines:
                    continue
                langs, conf = detect(sent.value, words, lines)
                kept = part.select(list(range(part.num_columns - 1))).take(pa.array(at, pa.int64()))
                cols = [*kept.columns, pa.array(no, pa.int32()), pa.array(langs, pa.string()), pa.array(conf, pa.float64()), pa.array([bool(_URL.fullmatch(x)) for x in lines], pa.bool_())]
                yield pa.RecordBatch.from_arrays(cols, names=[*kept.schema.names, "line_no", "line_lang", "confidence", "only_url"])

    return src.mapInArrow(run, schema)


def record_lines(records: DataFrame, sections: DataFrame, filters: Filters) -> DataFrame:
    """(doc_id, section_index, language, label, line_no, line_lang, confidence): each distinct label of a record with each line of its section.

    Of repeated section rows the latest holds. Records are reduced to their keys and labels before the join, and texts that
    no record refers to are dropped before they are sorted.
    """
    keys = records.select("doc_id", "section_index", "language").filter("section_index >= 0 and doc_id is not null")
    keys = keys.groupBy("doc_id", "section_index").agg(F.collect_set(F.coalesce("language", F.lit("\u0000"))).alias("labels"))
    texts = sections.select("doc_id", "section_index", "content", "scraped_at").filter("section_index >= 0 and content is not null")
    joined = keys.join(texts, ["doc_id", "section_index"])
    latest = joined.groupBy("doc_id", "section_index").agg(F.max_by(F.struct("labels", "content"), F.struct("scraped_at", "content")).alias("x"))
    lines = detect_lines(latest.select("doc_id", "section_index", "x.labels", "x.content"), filters, ["doc_id", "section_index", "labels"])
    lines = lines.filter("not only_url").withColumn("language", F.explode("labels"))
    language = F.nullif("language", F.lit("\u0000"))
    return lines.select("doc_id", "section_index", language.alias("language"), label_language(language).alias("label"), "line_no", "line_lang", "confidence")


def document_languages(docs: DataFrame, filters: Filters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang, confidence, n_lines, n_other_lines): the language of most lines, by their weight of confidence."""
    lines = detect_lines(docs, filters, [id_col], text_col, min_letters=1)
    per = lines.filter("line_lang is not null").groupBy(id_col, "line_lang").agg(F.sum(F.col("confidence") + 0.01).alias("w"), F.count("*").alias("n"))
    best = per.groupBy(id_col).agg(F.max(F.struct("w", "line_lang", "n")).alias("b"), F.sum("w").alias("all_w"), F.sum("n").alias("n_lines"))
    found = best.select(id_col, F.col("b.line_lang").alias("lang_found"), F.round(F.col("b.w") / F.col("all_w"), 4).alias("confidence"), "n_lines", (F.col("n_lines") - F.col("b.n")).alias("n_other_lines"))
    return docs.select(id_col, "lang").distinct().join(found, id_col, "left")
