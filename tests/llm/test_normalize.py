import itertools
import sys
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from lakeloom.llm import normalize as N

LETTERS = "aeoøåÅæxKп ěйїіНеﬁﬂ１Ａ　   ​­̊̈́‐-–\nK﻿о"


def whole(x):
    """The plain form without segments."""
    plain = N._tables()[0]
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", x.translate(plain)).translate(plain))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=LETTERS, max_size=30))
def test_segments_equal_whole(x):
    assert N.look(x) == whole(x)
    assert N.canonical(N.canonical(x)) == N.canonical(x)


def test_every_single_character():
    for c in itertools.chain(map(chr, range(0x3000)), map(chr, range(0xF900, 0x10000)), map(chr, range(0x1D400, 0x1D800))):
        if not 0xD800 <= ord(c) < 0xE000:
            assert N.look(c) == whole(c), hex(ord(c))
    assert sys.maxunicode == 0x10FFFF


def test_alike_and_different():
    alike = [("ｆｕｌｄ", "fuld"), ("ﬁl", "fil"), ("å", "å"), ("Вrug", "Brug"), ("e‑mail", "e-mail"), ("a b", "a b"), ("a​b­", "ab"), ("K", "K"), ("і", "i"), ("ї", "ï"), ("ιnk", "ink"), ("Ꭺᏼ"[0], "A"), ("ꓐ", "B"), ("ոօ", "no")]
    for a, b in alike:
        assert N.canonical(a) == N.canonical(b), (a, b)
    for a, b in [("ø", "o"), ("å", "aa"), ("A", "a"), ("a  b", "a b"), ("1", "l"), ("–", "-"), ("“", '"'), ("a\nb", "a b"), ("²", "2")]:
        assert N.canonical(a) != N.canonical(b), (a, b)
    assert N.canonical("Не знаю, cтaвки") == "He знаю, ставки"


def test_pairs(spark):
    rows = [
        (1, "h", "abc", 1), (2, "h", "аbc", 1), (3, None, "abc", 1), (4, "", "abc", 1), (5, "​", "abc", 1), (6, "h", "abc", 1), (6, "h", "abc", 1),
        (7, "h", None, 1), (None, "h", "аbc", 1), (8, "h", "", 1), (9, "h", "​", 1), (10, "H", "abc", 1),
    ]
    df = spark.createDataFrame(rows, "sec_id bigint, heading string, content string, look int")
    got = {tuple(r) for r in N.look_alike_pairs(df.filter("content is not null"), "sec_id", ["heading", "content"]).collect()}
    assert got == {(1, 2), (2, 6), (3, 5), (4, 5), (8, 9)}
    for together in (1, 2):  # a look in several blocks
        assert {tuple(r) for r in N.look_alike_pairs(df.filter("content is not null"), "sec_id", ["heading", "content"], together).collect()} == got
    assert N.look_alike_pairs(df.limit(0), "sec_id", ["heading", "content"]).count() == 0
    out = {r.sec_id: r.content_norm for r in N.normalize_fields(df, ["heading", "content"]).collect()}
    assert out[2] == "abc" and out[7] is None and out[8] == ""


def test_long(spark):
    text = ("æ " * 200_000) + "x"
    df = spark.createDataFrame([(1, text)], "sec_id bigint, content string")
    assert N.normalize_fields(df, ["content"]).first()["content_norm"] == "æ " * 200_000 + "x"
