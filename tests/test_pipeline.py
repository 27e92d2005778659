import json

import numpy as np
import pytest

from lakeloom import providers
from lakeloom.operators import graph, links, pages, rag, snapshots, telemetry, vectors
from lakeloom.plans import queries
from lakeloom.sources import readers, sinks

HTML = """<html><head><title>x</title><script>var a="</p>";</script></head><body><nav><li>menu</nav><article>
<p>before</p><h1>One</h1><h2>Two</h2><p>a &amp; b<li>c <b>d</b></li><p style="display: none">gone</p><h2>Empty</h2><h3>Last</h3><p>e</p><p>Genveje her</p></article><p>foot</p></body></html>"""


def test_sections(spark):
    df = spark.createDataFrame([(1, HTML), (2, None), (3, "")], "page_id bigint, html string")
    got = [(r.section_index, r.heading, r.content) for r in pages.page_sections(df).orderBy("section_index").collect()]
    assert got == [(0, None, "before"), (1, "Two", "a & b c d"), (2, "Last", "e")]


def test_link_rules(spark):
    df = spark.createDataFrame([("/a.PDF",), ("/a.pdf",), ("/a#b",), ("/nyheder/x",), ("/x.jpg",), ("http://x",), (None,), ("",)], "h string")
    assert {r.h for r in df.filter(links.is_followed(df.h)).collect()} == {"/a.PDF", "/x.jpg"}


def test_crawl_runs_until_nothing_is_new(spark, tmp_path):
    """A chain s1 - p1 - s2 - p2 - ... goes on beyond any fixed depth; both directions are links."""
    spark.createDataFrame([(i + j, i) for i in range(1, 8) for j in (0, 1)], "l_suppkey bigint, l_partkey bigint").write.parquet(f"{tmp_path}/lineitem.parquet")
    want = {("s1", 2)} | {(f"p{i}", 2 * i - 1) for i in range(1, 8)} | {(f"s{i + 1}", 2 * i) for i in range(1, 8)}
    assert {(r.node, r.depth) for r in queries.crawl_bfs(spark, str(tmp_path)).collect()} == want


def test_reached(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), (None, "z"), ("b", "c")], "src string, dst string")
    assert {(r.node, r.depth) for r in links.reached(e, "a").collect()} == {("b", 1), ("c", 2), ("a", 3)}
    assert {r.node for r in links.reached(e, "a", e.selectExpr("'b' as node")).collect()} == set()
    assert links.reached(e.limit(0), "a").count() == 0


def test_components(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(1000, 1060)]
    parent = {x: x for p in pairs for x in p}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {x: root(x) for p in pairs if p[0] != p[1] for x in p}
    assert graph.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_context(spark):
    def ctx(contents, total):
        rows = [(1, i + 1, "T", "H", "L", c) for i, c in enumerate(contents)]
        df = spark.createDataFrame(rows, "query_id bigint, rank int, title string, heading string, link string, content string")
        return rag.contexts(df, 900, total).first()["context"]

    head = "### T - H\nKilde: L\n"
    assert ctx(["aa", "bb"], 0) == f"{head}aa\n\n{head}bb"
    n = len(head) + 2
    assert ctx(["aa", "bb", "cc"], n) == f"{head}aa\n\n{head}bb"  # used up exactly: the next block comes whole
    assert ctx(["aa", "bb", "cc"], n + 9) == f"{head}aa\n\n### T - H…"
    assert ctx(["aa", "bb", "cc"], 3 * n) == "\n\n".join(head + x for x in ("aa", "bb", "cc"))


def test_top_k(spark):
    x = np.random.default_rng(4).normal(size=(300, 8)).astype(np.float32)
    x[10] = x[20]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [1.0])], "id bigint, v array<float>")
    got = vectors.top_k_batch(df, df.filter("id < 30").selectExpr("id as q", "v"), "id", "v", "q", 5).collect()
    for q in range(30):
        s = x.astype(np.float64) @ x[q].astype(np.float64)
        best = sorted(range(300), key=lambda i: (-round(s[i], 12), i))[:5]
        assert [r.id for r in sorted((r for r in got if r.q == q), key=lambda r: r.rank)] == best
    assert [r.id for r in vectors.top_k(df, "id", "v", x[3].tolist(), 1).collect()] == [int(np.argmax(x @ x[3]))]
    with pytest.raises(ValueError, match="k must"):
        vectors.top_k(df, "id", "v", [1.0], 0)


def test_p90(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(1, 11)] + [("b", 3.0), ("b", 4.0), ("c", None)], "g string, x double")
    assert {r.g: (r.n, r.p90) for r in telemetry.latency(df, "g", "x").collect()} == {"a": (10, 9.9), "b": (2, 4.0)}


def test_diffs(spark):
    kind = "key string, title string, sections array<struct<heading:string,content:string>>"
    old = spark.createDataFrame([("a", "t", [("h", "x\ny")]), ("b", "t", [("h", "x")]), ("c", None, None)], kind)
    new = spark.createDataFrame([("a", "t", [("h", "x\nz")]), ("c", None, None), ("d", "t", [])], kind)
    assert {tuple(r) for r in snapshots.status(old, new, "key").collect()} == {("a", "changed"), ("b", "removed"), ("c", "same"), ("d", "added")}
    d = snapshots.diffs(old, new, "key").collect()
    assert len(d) == 1 and "-y" in d[0]["diff"] and "+z" in d[0]["diff"]


def test_files(spark, tmp_path):
    folder = tmp_path / "2025-01-02"
    folder.mkdir()
    (folder / "links_2025-01-02.txt").write_text(" /a \n\n/b\n/a\n")
    got = readers.link_list(spark, str(folder)).collect()
    assert {(r.path, r.snapshot.isoformat()) for r in got} == {("/a", "2025-01-02"), ("/b", "2025-01-02")}
    docs = [{"link": "HTTPS://x.example/a", "title": "T", "sections": [{"heading": None, "content": "c"}], "doc_id": "old"}]
    (tmp_path / "links_content_2025-01-02.json").write_text(json.dumps(docs))
    (tmp_path / "links_content_2025-01-09.json").write_text(json.dumps([*docs, {"link": "x", "title": "", "sections": []}]))
    assert readers.corpus(spark, str(tmp_path / "links_content_2025-01-02.json")).first()["link"] == "https://x.example/a"
    assert readers.corpus(spark, str(tmp_path / "links_content_2025-01-09.json"), strict=False).count() == 1
    with pytest.raises(Exception, match="lacks"):
        readers.corpus(spark, str(tmp_path / "links_content_2025-01-09.json")).collect()
    listed = readers.files(spark, str(tmp_path), "*.json")
    assert [r.day.isoformat() for r in readers.latest_two_files(listed).collect()] == ["2025-01-09", "2025-01-02"]
    assert readers.newest(spark, str(tmp_path), "*.npy", "*.json").endswith(".json")
    x = np.arange(12, dtype=np.float32).reshape(4, 3)
    df = spark.createDataFrame([(i, f"q{i}", v.tolist()) for i, v in enumerate(x)], "row_idx bigint, question string, embedding array<float>")
    npy, meta = sinks.matrix(df, str(tmp_path / "out" / "x.hqe.v1"))
    back = readers.matrix(spark, npy).orderBy("row_idx").collect()
    assert [r.embedding for r in back] == x.tolist()
    assert json.load(open(meta))[2]["question"] == "q2"
    assert readers.companions("d/x.hqe.v1.embeddings.npy") == {"meta": "d/x.hqe.v1.meta.json", "records": "d/x.hqe.v1.jsonl", "corpus": "d/x.json"}
    sinks.link_list(spark.createDataFrame([("/b",), ("/a",), ("/b",)], "path string"), str(tmp_path / "sorted"))
    assert [r.path for r in readers.link_list(spark, str(tmp_path / "sorted"), distinct=False).collect()] == ["/a", "/b"]


def test_embedding_provider(spark):
    embed = providers.embed_column(providers.HashedWords(16), 3)
    df = spark.createDataFrame([(i, f"word {i}" if i else None) for i in range(8)], "i bigint, t string")
    rows = {r.i: r.v for r in df.select("i", embed("t").alias("v")).collect()}
    assert np.allclose(np.linalg.norm([rows[i] for i in range(1, 8)], axis=1), 1)
    assert not any(rows[0])
