import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from lakeloom.operators import snapdiff as S

SCHEMA = "snapshot_date date, doc_id string, link string, title string, sections array<struct<heading:string,content:string>>, scraped_at timestamp, ordinal int"


def day(n):
    return dt.date(2025, 1, 1) + dt.timedelta(days=n)


def at(n, h=0):
    return dt.datetime(2025, 1, 1) + dt.timedelta(days=n, hours=h)


def test_pages(spark):
    a, b = "https://x.example/a", "https://x.example/b"
    rows = [
        (day(0), "1", a, "T", [("h", "c")], at(0), 1),
        (day(0), "2", " HTTPS://X.example:443/b ", "T", [(None, "c")], at(0), 1),
        (day(0), "2", b, "old", [("h", "older")], None, 1),
        (day(0), "3", None, "T", [], at(0), 1),
        (day(0), "3", "  ", "T", [], at(0), None),
        (day(1), "1", a, " T ", [("h ", "c"), ("x", " ")], at(1), 1),
        (day(1), "2", b, "T", [("(ingen overskrift)", "c")], at(1), 1),
        (day(1), "2", b, "T", [("z", "c")], at(1, 2), 1),
        (day(1), "4", "https://x.example/new", None, None, at(1), 1),
        (day(3), "1", a, "T", [("h", "d")], at(3), 1),
        (day(3), "1", a, "T", [("h", "d")], at(3), 1),
        (day(5), "2", b, "T", [("z", "c")], at(5), 1),
        (None, "9", "https://x.example/9", "T", [], at(5), 1),
    ]
    got = {tuple(r) for r in S.corpus_changes(spark.createDataFrame(rows, SCHEMA)).collect()}
    new = "https://x.example/new"
    assert got == {
        ("2025-01-02", b, "changed"), ("2025-01-02", new, "added"),
        ("2025-01-04", a, "changed"), ("2025-01-04", b, "removed"), ("2025-01-04", new, "removed"),
        ("2025-01-06", a, "removed"), ("2025-01-06", b, "added"),
    }


def test_against_sets(spark):
    rng = random.Random(2)
    rows, sets = [], []
    for d in range(4):
        now = {f"k{rng.randrange(3000)}": rng.randrange(3) for _ in range(1500)}
        sets.append(now)
        rows += [(day(d), k, v) for k, v in now.items()]
    df = spark.createDataFrame(rows, "d date, k string, v bigint")
    got = {tuple(r) for r in S.snapshot_changes(df, F.col("d"), F.col("k"), F.col("v"), F.lit(1)).collect()}
    expected = set()
    for i in range(1, 4):
        old, new = sets[i - 1], sets[i]
        name = day(i).isoformat()
        expected |= {(name, k, "added") for k in new.keys() - old.keys()} | {(name, k, "removed") for k in old.keys() - new.keys()}
        expected |= {(name, k, "changed") for k in new.keys() & old.keys() if new[k] != old[k]}
    assert got == expected


def test_bitmaps():
    for n in (0, 1, 700, 20_000):
        at_ = np.sort(np.random.default_rng(n).choice(S.CHUNK, n, replace=False))
        flags = np.zeros(S.CHUNK, bool)
        flags[at_] = True
        bits = np.packbits(flags, bitorder="little").tobytes()
        assert (S.unpack(S.pack(bits)) == flags).all()
        assert len(S.pack(bits)) <= len(bits) + 1
    assert not S.unpack(None).any()


def test_ordinals_are_stored_and_stay(spark, tmp_path):
    keys = lambda n: spark.range(n).select(F.concat(F.lit("k"), "id").alias("key"))
    table = lambda: {r.key: r.ordinal for r in S.Ordinals(spark, f"file://{tmp_path}/o").table().collect()}
    assert S.Ordinals(spark, f"file://{tmp_path}/o").table() is None
    S.Ordinals(spark, f"file://{tmp_path}/o").extended(keys(200))
    first = table()
    (tmp_path / "o" / "part-broken").mkdir()  # a write that did not end
    S.Ordinals(spark, f"file://{tmp_path}/o").extended(keys(300).unionByName(keys(5)))
    later = table()
    assert len(later) == 300 == len(set(later.values())) and all(later[k] == o for k, o in first.items())
    S.Ordinals(spark, f"file://{tmp_path}/o").extended(keys(0))
    assert table() == later


def test_given_ordinals(spark, tmp_path):
    rows = [(day(d), "1", f"https://x.example/{i}", f"T{i * d}", [("h", "c")], at(d), 1) for d in range(3) for i in range(d, d + 4)]
    df = spark.createDataFrame(rows, SCHEMA)
    store = S.Ordinals(spark, f"file://{tmp_path}/o")
    old = {tuple(r) for r in S.corpus_changes(df.filter("snapshot_date < '2025-01-03'"), store).collect()}
    assert old | {("2025-01-03", f"https://x.example/{i}", k) for i, k in ((1, "removed"), (5, "added"), (2, "changed"), (3, "changed"), (4, "changed"))} == {tuple(r) for r in S.corpus_changes(df, store).collect()}



def test_empty(spark):
    assert S.corpus_changes(spark.createDataFrame([], SCHEMA)).count() == 0
    one = spark.createDataFrame([(day(0), "1", "https://a", None, None, None, None)], SCHEMA)
    assert S.corpus_changes(one).count() == 0
