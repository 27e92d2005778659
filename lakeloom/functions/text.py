"""Text expressions. White space is Unicode white space unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PLACEHOLDER = "(ingen overskrift)"


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^[\s\x{1C}-\x{1F}]+|[\s\x{1C}-\x{1F}]+$", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)[\s\x{1C}-\x{1F}]+$", "")


def sanitize(c: Column) -> Column:
    """Non-breaking spaces become spaces, ends are stripped; null gives ''."""
    return strip(F.translate(F.coalesce(c, F.lit("")), "\u00a0", " "))


def collapse_lines(c: Column) -> Column:
    """Lines stripped, blank ones dropped, joined by a line feed."""
    lines = F.transform(F.split(c, r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"), strip)
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def heading(c: Column) -> Column:
    """Collapsed lines, or the placeholder for a null or blank heading."""
    return F.coalesce(F.nullif(collapse_lines(c), F.lit("")), F.lit(PLACEHOLDER))


def words(c: Column) -> Column:
    """White-space separated words; a blank text has none."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda x: x != "")


def word_count(c: Column) -> Column:
    return F.size(words(F.coalesce(c, F.lit("")))).cast("int")


def tokens(c: Column) -> Column:
    """Lower-case runs of letters, marks, digits and underscores."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{M}\p{N}_]+"), lambda x: x != "")


def truncate(c: Column, most: int) -> Column:
    """At most `most` characters and an ellipsis; 0 or less is no limit."""
    if most <= 0:
        return c
    return F.when(F.length(c) <= most, c).otherwise(F.concat(rstrip(F.left(c, F.lit(most))), F.lit("…")))


def normalize_question(c: Column) -> Column:
    """Spaces collapsed, closing marks replaced by one question mark."""
    one_line = F.regexp_replace(strip(c), r"(?U)\s+", " ")
    return F.concat(strip(F.regexp_replace(one_line, r"[?.!]+$", "")), F.lit("?"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; two empty ones are equal."""
    both_empty = (F.size(a) == 0) & (F.size(b) == 0)
    return F.when(both_empty, F.lit(1.0)).otherwise(
        F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b)))
    )


def question_budget(length: Column, small: int = 3, medium: int = 5, large: int = 8) -> Column:
    return F.when(length < 500, small).when(length < 1500, medium).otherwise(large).cast("int")


def duration(seconds: Column) -> Column:
    """h:mm:ss of whole seconds, 0 for negative ones."""
    s = F.greatest(F.lit(0), F.floor(seconds)).cast("bigint")
    return F.format_string("%d:%02d:%02d", F.expr("0L") + F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def uuid5_url(name: Column) -> Column:
    """Version 5 UUID of `name` in the URL namespace."""
    space = F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8"))
    h = F.sha1(F.concat(space, F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab89ab89ab89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def doc_id(link: Column, title: Column) -> Column:
    return uuid5_url(F.concat(F.coalesce(link, F.lit("")), F.lit("::"), F.coalesce(title, F.lit(""))))


def canonical_link(c: Column) -> Column:
    """No blanks around it, scheme and host in lower case, no port 443; null and blank links are null."""
    s = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    pat = r"^([A-Za-z][A-Za-z0-9+.\-]*://)([^/?#]*)(.*)$"
    host = F.regexp_replace(F.lower(F.regexp_extract(s, pat, 2)), r":443$", "")
    fixed = F.concat(F.lower(F.regexp_extract(s, pat, 1)), host, F.regexp_extract(s, pat, 3))
    return F.nullif(F.when(s.rlike(pat), fixed).otherwise(s), F.lit(""))
