"""One consistent form for text that looks the same but differs in its characters.

A character is unstable if it may change, or may make a neighbour change, under the form used here: canonical composition,
with full-width and presentation letters, look-alike letters and hyphens of other scripts and single spaces of any kind
brought to their plain form and invisible characters dropped. A quick check by one character class finds the unstable
segments; each is normalised with the character before it as context and spliced into the unchanged rest.

Words that hold a letter found in Cyrillic only are then written in Cyrillic throughout, so that text of that script stays
readable. That step reads the plain form only, hence texts that look alike still compare as equal.

Kept apart: letter case, digits, punctuation, line breaks, the number of spaces, letters such as ø and o.
Defined results: null stays null, '' stays '', text of any length is handled whole; extra columns are passed through.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lakeloom.session import join_one, materialize

# Letters of other scripts and the Latin letters they look like.
CYRILLIC = "АВЕЅІЈКМНОРСТУХԚԜаеорсухіѕјһԁԛԝӏ"
CYRILLIC_AS = "ABESIJKMHOPCTYXQWaeopcyxisjhdqwl"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿαγικνορυϲϳ"
GREEK_AS = "ABEZHIKMNOPTYXCJayikvopucj"
ARMENIAN = "ՕՍՏօոսհցզք"
ARMENIAN_AS = "OUSonuhgqp"
CHEROKEE = "ᎠᎡᎢᎪᎫᎬᎳᎷᎻᎽᏀᏃᏏᏒᏔᏚᏙᏞᏟᏢᏦᏴ"
CHEROKEE_AS = "DRTAJEWMHYGZbRWSVLCPKB"
LISU = "ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ"
LISU_AS = "BPDTGKJCZFMNLSRVHWXYAEIOU"
OTHER = "ɑɡᴏӀᴄᴠᴡᴢ"
OTHER_AS = "agolcvwz"
HYPHENS = "‐‑‒⁃−˗֊᠆﹣－"
#: Ignorable characters outside the format category.
IGNORABLE = "͏ᅟᅠ឴឵᠋᠌᠍ㅤﾠ"
#: Format characters that show.
VISIBLE_FORMAT = "؀؁؂؃؄؅۝܏࣢"
#: Letters by form whose plain form looks another way.
NOT_ALIKE = "ſﬅ"
# End of fixed values.

_WORD = re.compile(r"[^\W\d_]+")


def _plain_of(cp: int) -> str | None:
    """What a single character is brought to; None if it stays."""
    c = chr(cp)
    cat = unicodedata.category(c)
    if c in HYPHENS:
        return "-"
    if (cat == "Cf" and c not in VISIBLE_FORMAT and not 0x110BD <= cp <= 0x110CD) or c in IGNORABLE or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF:
        return ""
    if cat == "Zs" and c not in "  ":
        return " "
    tag = unicodedata.decomposition(c)
    if tag.startswith(("<wide>", "<narrow>")):
        return unicodedata.normalize("NFKC", c)
    if tag.startswith(("<compat>", "<font>")) and c not in NOT_ALIKE:
        form = unicodedata.normalize("NFKC", c)
        if form.isascii() and form.isalpha():
            return form
    return None


@lru_cache(1)
def _tables() -> tuple[dict[int, str], re.Pattern, dict[int, str], re.Pattern]:
    plain: dict[int, str] = dict(zip(map(ord, CYRILLIC + GREEK + ARMENIAN + CHEROKEE + LISU + OTHER), CYRILLIC_AS + GREEK_AS + ARMENIAN_AS + CHEROKEE_AS + LISU_AS + OTHER_AS, strict=True))
    unstable: set[int] = set(plain)
    for cp in range(0x80, sys.maxunicode + 1):
        if cp == 0x20000:  # ideographs: only their compatibility block and the tags matter
            continue
        if 0x20000 < cp < 0x2F800 or 0x2FA20 <= cp < 0xE0000 or cp > 0xE01EF or 0xAC00 <= cp <= 0xD7A3 or 0xD800 <= cp <= 0xDFFF:
            continue
        if (to := _plain_of(cp)) is not None:
            plain[cp] = to
            unstable.add(cp)
            continue
        c = chr(cp)
        if unicodedata.combining(c) or unicodedata.category(c) in ("Mn", "Mc") or 0x1160 <= cp <= 0x11FF:
            unstable.add(cp)
        elif (d := unicodedata.normalize("NFD", c)) != c and unicodedata.normalize("NFC", d.translate(plain)) != c:
            unstable.add(cp)
    ranges: list[list[int]] = []
    for cp in sorted(unstable):
        if ranges and ranges[-1][1] == cp - 1:
            ranges[-1][1] = cp
        else:
            ranges.append([cp, cp])
    cls = "[" + "".join(re.escape(chr(a)) + ("-" + re.escape(chr(b)) if b > a else "") for a, b in ranges) + "]"
    back = dict(zip(map(ord, CYRILLIC_AS), CYRILLIC, strict=True)) | {ord("ï"): "ї", ord("Ï"): "Ї", ord("ë"): "ё", ord("Ë"): "Ё"}
    # letters of the script that look like no Latin letter, and the words with one
    own = "".join(chr(x) for x in range(0x400, 0x530) if x not in plain and chr(x).isalpha() and unicodedata.normalize("NFC", unicodedata.normalize("NFD", chr(x)).translate(plain)) == chr(x))
    return plain, re.compile(f"{cls}+"), back, re.compile(f"[{own}]")


@lru_cache(1 << 16)
def _segment(part: str) -> str:
    plain = _tables()[0]
    # look-alikes with an accent come apart first; what is dropped or replaced may let its neighbours compose
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", part.translate(plain)).translate(plain))


def _stable(text: str) -> bool:
    """The quick check: below U+0100 only the non-breaking space and the soft hyphen are unstable."""
    if text.isascii():
        return True
    try:
        return b"\xa0" not in (x := text.encode("latin-1")) and b"\xad" not in x
    except UnicodeEncodeError:
        return False


def look(text: str) -> str:
    """The plain form of `text`: equal for texts that look the same."""
    if _stable(text):
        return text
    out, done = [], 0
    for m in _tables()[1].finditer(text):
        a, b = m.span()
        if a > done:  # the character before is the context in which the segment composes
            out.append(text[done : a - 1])
            out.append(_segment(text[a - 1 : b]) if b - a < 64 else _segment.__wrapped__(text[a - 1 : b]))
        else:
            out.append(_segment.__wrapped__(text[a:b]))
        done = b
    if not done:
        return text
    out.append(text[done:])
    return "".join(out)


def canonical(text: str) -> str:
    """The plain form with Cyrillic words written in Cyrillic."""
    if _stable(text):
        return text
    _, _, back, own = _tables()
    out = look(text)
    if out.isascii() or not own.search(out):
        return out
    return _WORD.sub(lambda m: m[0].translate(back) if not m[0].isascii() and own.search(m[0]) else m[0], out)


@F.pandas_udf(StringType())
def _changed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        out = []
        for x in s:
            y = canonical(x) if x is not None else None
            out.append(None if y == x else y)
        yield pd.Series(out, dtype=object)


def canonical_column(c: Column) -> Column:
    """Text with only ASCII characters never leaves the JVM's row."""
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.coalesce(_changed(c), c)).otherwise(c)


def normalize_fields(df: DataFrame, fields: list[str]) -> DataFrame:
    """`df` with `<field>_norm` for each field; columns of those names are replaced."""
    return df.withColumns({f"{f}_norm": canonical_column(F.col(f"`{f}`")) for f in fields})


#: Rows of one look that meet in one block.
TOGETHER = 2_000


def look_alike_groups(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """(id, look, spelling) of distinct rows, digests of the plain form and of the characters of all fields. A written table."""
    kept = {f: F.coalesce(F.col(f"`{f}`"), F.lit("")) for f in fields}
    digest = lambda cols: F.unhex(F.md5(F.concat_ws("\u0000", *cols)))
    rows = df.select(
        F.col(f"`{id_col}`").alias("id"), digest([canonical_column(c) for c in kept.values()]).alias("look"), digest(list(kept.values())).alias("spelling")
    ).filter("id is not null")
    return materialize(rows.distinct(), "looks")  # 40 bytes a row


def look_alike_pairs(df: DataFrame, id_col: str, fields: list[str], together: int = TOGETHER) -> DataFrame:
    """Distinct (sec_id_a, sec_id_b), a < b, of rows alike in all fields while at least one differs in its characters.

    A null field looks like an empty one and does not differ from it. Only 16-byte digests are shuffled. A group of
    one spelling, however large, is dropped before anything is paired. The rows of a look lie in blocks of about `together`,
    of which every two meet in a task's group of their own: the pairs are the result itself, and no task makes those of a hot look.
    """
    rows = look_alike_groups(df, id_col, fields)
    several = rows.groupBy("look").agg(F.min("spelling").alias("a"), F.max("spelling").alias("b"), F.count("*").alias("n")).filter("a <> b")
    several = materialize(several.select("look", F.ceil(F.col("n") / F.lit(together)).cast("int").alias("blocks")), "several")
    rows = join_one(rows, several, "look").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    met = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    sides = rows.select("look", "block", "id", "spelling", met.alias("other"))
    left = sides.select("look", "block", "other", F.col("id").alias("sec_id_a"), F.col("spelling").alias("spelling_a"))
    right = sides.select("look", F.col("other").alias("block"), F.col("block").alias("other"), F.col("id").alias("sec_id_b"), F.col("spelling").alias("spelling_b"))
    return left.join(right, ["look", "block", "other"]).filter("sec_id_a < sec_id_b and spelling_a <> spelling_b").select("sec_id_a", "sec_id_b").distinct()
