import random
import re

import numpy as np

from lakeloom.llm import boilerplate as B

SCHEMA = "sec_id bigint, doc_id string, site string, content string, cluster string"


def exact(rows, least=5):
    seen, lines = {}, []
    for sec, doc, site, content, _ in rows:
        for i, x in enumerate((content or "").split("\n")):
            if k := re.sub(r"\d+", "0", " ".join(x.split()).lower()):
                seen.setdefault((site, k), set()).add(doc)
                lines.append((sec, i, (site, k)))
    return {(s, i) for s, i, k in lines if len(seen[k]) >= least}


def rows_of(rng, n):
    foot = ["Skrevet af webteamet hos Krovikerup Skole, 15.8.2018", "Vi bruger cookies, så vi kan føre statistik over besøg", "kort", "  LÆS  mere her\t"]
    out = []
    for i in range(n):
        own = [" ".join(rng.choice("alfa beta gamma delta epsilon zeta eta theta iota".split()) for _ in range(12)) for _ in range(3)]
        extra = [re.sub(r"\d+", lambda m: str(rng.randrange(1, 99)), x) for x in foot if rng.random() < 0.3]
        lines = own + extra + ["", "  "]
        rng.shuffle(lines)
        out.append((i, f"d{i // 2}", None if i % 7 == 0 else "hot" if i % 3 else f"s{i % 5}", "\n".join(lines), "c"))
    return [*out, out[0], (999, None, "hot", None, None), (998, None, "hot", foot[0], None)]


def test_exact_lines(spark):
    rows = rows_of(random.Random(4), 90)
    found = B.repeated_lines(spark.createDataFrame(rows, SCHEMA))
    assert {(r.sec_id, r.line_no) for r in found.filter("line_docs >= 5").collect()} == exact(rows)


def test_near_lines_and_cleaning(spark):
    base = "alle oplysninger på denne side er kun vejledende og uden ansvar for brugen af de viste beløb og satser hos os i dette år {}"
    rows = [(i, f"d{i}", "s", f"egen linje nummer {chr(97 + i)}{chr(98 + i)} her\n" + base.format(w), None) for i, w in enumerate(["nye", "gamle", "lange", "korte", "sidste", "første"])]
    rows += [(50, "d50", "other", base.format("nye"), None)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = B.repeated_lines(df)
    assert {(r.sec_id, r.line_no) for r in found.collect()} == {(i, 1) for i in range(6)}
    clean = {r.sec_id: (r.content_clean, r.n_removed) for r in B.without_repeated(df, found).collect()}
    assert clean[0] == ("egen linje nummer ab her", 1) and clean[50] == (base.format("nye"), 0)


def test_large_bucket_is_not_cut(spark):
    """Buckets over the limit are compared block by block and give the same clusters."""
    base = "alle oplysninger på denne side er kun vejledende og uden ansvar for brugen af de viste beløb og satser hos os i dette år {}"
    words = [a + b for a in "bdfgk" for b in ("ale", "ile", "ole")]
    df = spark.createDataFrame([(i, f"d{i}", "s", base.format(w), None) for i, w in enumerate(words)], SCHEMA)
    for most in (256, 3, 1):
        assert {(r.sec_id, r.cluster_docs) for r in B.repeated_lines(df, most=most).collect()} == {(i, 15) for i in range(15)}


def test_chain_in_a_large_bucket(spark):
    """Lines of which only neighbours are alike are one cluster at any limit."""
    words = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in ("la", "na", "ra")]
    lines = [" ".join(["andet" + words[j] if j < i else w for j, w in enumerate(words)]) for i in range(0, 24, 1)]
    df = spark.createDataFrame([(i, f"d{i}", "s", x, None) for i, x in enumerate(lines)], SCHEMA)
    for most in (256, 2, 1):
        assert {(r.sec_id, r.cluster_docs) for r in B.repeated_lines(df, most=most).collect()} == {(i, 24) for i in range(24)}


def brute_clusters(rows, min_docs):
    """(sec_id, line_no, cluster_docs) by comparing every two lines of a site."""
    memory, lines = B.Tokens(), []
    for sec, doc, site, content, _ in rows:
        for i, x in enumerate((content or "").split("\n")):
            if B.same_line(x):
                sh, _ = B.shingles([x], memory)
                lines.append((sec, i, doc, site, B.same_line(x), set(sh.tolist())))
    of = list(range(len(lines)))
    root = lambda k: k if of[k] == k else root(of[k])
    for x, a in enumerate(lines):
        for y in range(x):
            b = lines[y]
            if a[3] == b[3] and (a[4] == b[4] or len(a[5] & b[5]) >= 0.8 * len(a[5] | b[5])):
                of[root(x)] = root(y)
    docs = {}
    for k, x in enumerate(lines):
        docs.setdefault(root(k), set()).add(x[2])
    return {(x[0], x[1], len(docs[root(k)])) for k, x in enumerate(lines) if len(docs[root(k)]) >= min_docs}


def test_clusters_equal_brute_force(spark):
    rng = random.Random(21)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(40)]
    stems = [[rng.choice(words) for _ in range(rng.randrange(4, 60))] for _ in range(12)]
    rows = []
    for i in range(160):
        made = []
        for _ in range(rng.randrange(1, 4)):
            line = list(rng.choice(stems))
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                line[rng.randrange(len(line))] = rng.choice(words + ["7", "Hans", "maj"])
            made.append(" ".join(line))
        rows.append((i, f"d{i % 120}", rng.choice(["hot", "hot", "s1", None]), "\n".join(made), None))
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute_clusters(rows, 5)
    assert len(want) > 50
    for most in (256, 4):
        assert {(r.sec_id, r.line_no, r.cluster_docs) for r in B.repeated_lines(df, most=most).collect()} == want


def test_versions_of_a_section(spark):
    """A later version under the same sec_id keeps its own line numbers."""
    foot = "Vi bruger cookies, så vi kan føre statistik over besøg"
    rows = [(i, f"d{i}", "s", f"{foot}\negen {chr(97 + i)}", None) for i in range(5)] + [(0, "d0", "s", f"ny a\n{foot}", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.sec_id, r.content_clean) for r in B.without_repeated(df, B.repeated_lines(df)).collect()}
    assert got == {(0, "ny a"), *((i, f"egen {chr(97 + i)}") for i in range(5))}


def test_no_pair_at_the_threshold_is_missed(spark):
    """49 words have 45 shingles; another word in the middle changes five: 40 of 50 are common."""
    rng = random.Random(8)
    lines = [["".join(rng.choices("abcdefghijklmnop", k=9)) for _ in range(49)] for _ in range(150)]
    pairs = [" ".join(x) for words in lines for x in (words, [*words[:24], "andet", *words[25:]])]
    found = B.repeated_lines(spark.createDataFrame([(i, f"d{i}", "s", x, None) for i, x in enumerate(pairs)], SCHEMA), min_docs=2)
    assert {(r.sec_id, r.cluster_docs) for r in found.collect()} == {(i, 2) for i in range(300)}


def test_spellings_with_other_masks(spark):
    """Identity ignores case while masks see capitals: such lines still count together."""
    lines = ["Hilsen fra Anna Berg og alle os andre her", "hilsen fra anna berg og alle os andre her", "HILSEN FRA ANNA BERG OG ALLE OS ANDRE HER"]
    rows = [(i, f"d{i}", "s", lines[i % 3], None) for i in range(6)]
    assert B.repeated_lines(spark.createDataFrame(rows, SCHEMA)).filter("line_docs = 6").count() == 6


def test_shingles():
    sh, start = B.shingles(["a b c d e f", "x", "!!", "x"], B.Tokens())
    parts = np.split(sh, start[1:])
    assert [len(p) for p in parts] == [2, 1, 1, 1] and parts[1][0] == parts[3][0] != parts[2][0]


def test_empty(spark):
    assert B.repeated_lines(spark.createDataFrame([], SCHEMA)).count() == 0
    assert B.repeated_lines(spark.createDataFrame([(1, "d", "s", None, None), (2, "d", "s", "\n \n", None)], SCHEMA)).count() == 0
