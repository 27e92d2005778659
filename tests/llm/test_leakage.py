import random

import numpy as np

from lakeloom.llm import leakage as L

ITEMS = "item_id bigint, question string, answer string, n_words int"
DOCS = "doc_id bigint, text string, item_id string"


def test_suffix_array():
    rng = np.random.default_rng(0)
    for n in (0, 1, 7, 500):
        t = rng.integers(0, 3, n)
        got = L.suffix_array(t, 64)
        key = lambda i: t[i : i + 64].tolist()
        assert [key(i) for i in got] == sorted(key(i) for i in range(n))


def brute(docs, items, m):
    out = set()
    for d, text in docs:
        w = L.plain_words(text or "")
        grams = {tuple(w[i : i + m]) for i in range(len(w) - m + 1)}
        for i, *fields in items:
            for f in fields:
                p = L.plain_words(f or "")
                if any(tuple(p[k : k + m]) in grams for k in range(len(p) - m + 1)):
                    out.add((d, i))
    return out


def test_against_brute_force(spark):
    rng = random.Random(1)
    word = lambda: rng.choice("ab cd ef gh ij kl mn".split())
    items = [(i, " ".join(word() for _ in range(rng.randrange(0, 25))), " ".join(word() for _ in range(rng.randrange(0, 25))) if i % 4 else None) for i in range(15)]
    docs = []
    for d in range(120):
        text = [word() for _ in range(rng.randrange(0, 60))]
        src = L.plain_words(items[rng.randrange(15)][1])
        at = rng.randrange(len(text) + 1)
        docs.append((d, " ".join(text[:at] + src[: rng.randrange(20)] + (["zz"] if d % 3 else []) + text[at:])))
    for m in (3, 12):
        got = L.leaks(spark.createDataFrame([(*d, "x") for d in docs], DOCS), spark.createDataFrame([(*i, 1) for i in items], ITEMS), min_words=m)
        assert {(r.doc_id, r.item_id) for r in got.collect()} == brute(docs, items, m)


def test_forms(spark):
    q = "en to tre fire fem seks syv otte ni ti elleve tolv tretten"
    docs = [
        (1, f"x {q} y"), (2, q.upper()), (3, "en, to; TRE-fire fem\nseks syv ot-\nte ni ti el­\nleve t​olv"), (4, "еn to tre fire fem seks syv otte ni ti elleve tolv"),
        (5, "en to tre fire fem seks syv otte ni ti elleve"), (6, None), (7, ""), (8, "fire fem seks syv otte ni ti elleve tolv tretten en to tre"), (1, f"x {q} y"),
    ]
    items = [(1, q, None, 1), (1, q, None, 1), (2, "kort", "", 2), (None, q, q, 3), (3, "en to tre fire fem seks", "syv otte ni ti elleve tolv", 4)]
    got = L.leaks(spark.createDataFrame([(*d, "x") for d in docs], DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert {(r.doc_id, r.item_id, r.field, r.n_words) for r in got} == {(1, 1, "question", 13), (2, 1, "question", 13), (3, 1, "question", 12), (4, 1, "question", 12)}
    assert {(r.doc_word, r.item_word) for r in got if r.doc_id == 1} == {(1, 0)}


def test_report_and_empty(spark):
    docs = spark.createDataFrame([(1, "a " * 20, "x"), (2, "b", "y")], DOCS)
    items = spark.createDataFrame([(5, "a " * 14, None, 0)], ITEMS)
    found = L.leaks(docs, items)
    assert [tuple(r) for r in L.leak_report(found).collect()] == [(5, 1, 14)]
    assert [r.doc_id for r in L.without_leaks(docs, found).collect()] == [2]
    assert L.leaks(docs.limit(0), items).count() == 0
    assert L.leaks(docs, items.limit(0)).count() == 0


def test_items_in_blocks(spark):
    """As many blocks as the items need give the same rows as one."""
    rng = random.Random(5)
    word = lambda: rng.choice("ab cd ef gh ij kl mn op qr".split())
    items = [(i, " ".join(word() for _ in range(14)), None, 1) for i in range(60)]
    docs = [(d, "xx " + items[d % 60][1] + " yy", "x") for d in range(90)]
    df, it = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    one = {tuple(r) for r in L.leaks(df, it).collect()}
    assert {tuple(r) for r in L.leaks(df, it, block_words=100).collect()} == one and len(one) >= 90
    assert len(list(L.item_blocks(it.selectExpr("item_id as item", "question as f0"), ("f0",), 100))) > 3
    assert list(L.shards(["a" * 5, "b" * 5, "c" * 20, "d"], 10)) == [(0, 2), (2, 3), (3, 4)] and list(L.shards([])) == []
