import uuid

import pytest
from pyspark.sql import functions as F

from lakeloom.functions import text as T
from lakeloom.operators import corpus, questions


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize(("q", "expected"), [("  A  b?!. ", "A b?"), ("", "?"), ("a ? ?", "a ??"), ("x  y", "x y?")])
def test_question(spark, q, expected):
    assert one(spark, q, T.normalize_question) == expected


def test_values(spark):
    assert one(spark, "  a b \t", T.sanitize) == "a b"
    assert one(spark, None, T.sanitize) == ""
    assert one(spark, " a \r\n\n b ", T.heading) == "a\nb"
    assert one(spark, " \n ", T.heading) == T.PLACEHOLDER == one(spark, None, T.heading)
    assert one(spark, "abc de", lambda c: T.truncate(c, 4)) == "abc…"
    assert one(spark, "abc", lambda c: T.truncate(c, 0)) == "abc"
    assert one(spark, "", T.word_count) == 0
    assert one(spark, "Ærø's 2 ting_x", T.tokens) == ["ærø", "s", "2", "ting_x"]
    assert [one(spark, n, lambda c: T.question_budget(c), "int") for n in (499, 500, 1499, 1500)] == [3, 5, 5, 8]
    assert one(spark, 3725.9, T.duration, "double") == "1:02:05"
    assert one(spark, -3.0, T.duration, "double") == "0:00:00"
    assert one(spark, "https://a/b::Titel æ", T.uuid5_url) == str(uuid.uuid5(uuid.NAMESPACE_URL, "https://a/b::Titel æ"))
    assert one(spark, " HTTPS://A.Example:443/P?q ", T.canonical_link) == "https://a.example/P?q"


@pytest.mark.parametrize(("a", "b", "expected"), [([], [], 1.0), (["a"], [], 0.0), (["a", "b"], ["b", "c"], 1 / 3)])
def test_jaccard(spark, a, b, expected):
    df = spark.createDataFrame([(a, b)], "a array<string>, b array<string>")
    assert df.select(T.jaccard(F.col("a"), F.col("b"))).first()[0] == pytest.approx(expected)


def test_quality(spark):
    q = lambda xs: one(spark, xs, questions.quality, "array<string>")
    assert q(["Hvad er SU?", "how do i apply for a grant now"]) == ["how do i apply for a grant now?"]
    assert q(["den er kort", None]) == ["den er kort?"]
    assert q([]) == [] == q(None)
    words = lambda n: " ".join(["grant"] * n)
    ok = [one(spark, words(n), questions.has_length) for n in (4, 5, 18, 19)]
    assert ok == [False, True, True, False]


def test_distinct_enough(spark):
    f = lambda xs, t: one(spark, xs, lambda c: questions.distinct_enough(c, t), "array<string>")
    assert f(["a b c d", "A b c d?", "a b c e"], 0.8) == ["a b c d", "a b c e"]
    assert f(["a b c d e", "a b c d"], 0.8) == ["a b c d e"]  # exactly at the threshold
    assert f([], 0.8) == []


def test_parsed_list(spark):
    f = lambda x: one(spark, x, questions.parsed_list)
    assert f('["a", 1, " ", null, "b"]') == ["a", "b"]
    assert f("not json") == ["not json"]
    assert f('{"a": 1}') == ['{"a": 1}']
    assert f(" ") == [] == f(None)


def test_chunks(spark):
    df = spark.createDataFrame([(1, "x" * 1000), (2, "abc"), (3, ""), (4, None)], "k bigint, t string")
    got = sorted(tuple(r) for r in corpus.chunks(df, "k", "t").collect())
    assert [(k, n, len(c)) for k, n, c in got] == [(1, 0, 500), (1, 1, 500), (1, 2, 100), (2, 0, 3)]
    parts = spark.createDataFrame([(1, "aa\n\nbb\n \ncccccccccc\n\nd")], "k bigint, t string")
    assert [r.chunk for r in corpus.paragraph_chunks(parts, "k", "t", 6).orderBy("chunk_no").collect()] == ["aa\n\nbb", "cccccccccc", "d"]


def test_last_wins(spark):
    df = spark.createDataFrame([("a", 1, 5, "x"), ("a", 1, None, "y"), ("a", 1, 7, "z"), ("b", None, 1, "q")], "doc_id string, section_index int, scraped_at int, content string")
    assert [(r.doc_id, r.content) for r in corpus.lookup(df).collect()] == [("a", "z")]
