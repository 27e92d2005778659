"""Mixtures of sources with target shares of all tokens.

Documents are grouped by membership pattern, the set of target sources they belong to (their `source`, and the host of their
link: both count where they differ). Only the token sums of the patterns reach the driver. A min-cost flow routes them to the
quotas of the sources: the first use of a pattern is free, each further repetition costs more, up to the source's cap. What is
routed is turned into whole uses of all documents of a pattern, and for the rest into documents in a seeded order up to
the routed size; what is still missing there is filled with the document not taken whose size comes nearest, again and again
until none comes nearer.

The order's prefix is found from sums over hash ranges; only the range with the cut is ordered document by document, so no
source, however large, is sorted in one task.

Defined results: sources are compared without case, blanks around them and closing slashes; a document of no target source is
left out, and so is one with a null or empty text; a repeated doc_id counts once (its longest text); a null cap is none, a null
or negative share 0; a target named twice counts with its largest share; a source without documents, or with too few
for its cap, is reported with its shortfall; an empty table gives an empty mixture.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.session import gather, materialize

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: How the rank files' vocabulary splits text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RANGES, MAX_SOURCES = 4096, 10_000
MIXTURE = "doc_id bigint, source string, uses int, n_tokens bigint"


@lru_cache(2)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def count_tokens(df: DataFrame, keep: list[str], text_col: str = "text", tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """`keep` and n_tokens of each row's whole text."""
    src = df.select(*keep, F.col(text_col).alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema[:-1]), "n_tokens bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(tokenizer, pattern)
        for b in batches:
            n = [len(enc.encode_ordinary(x)) if x else 0 for x in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], names=[*b.schema.names[:-1], "n_tokens"])

    return src.mapInArrow(run, schema)


def source_name(c: Column) -> Column:
    return F.nullif(F.regexp_replace(F.lower(F.trim(c)), r"[/\s]+$", ""), F.lit(""))


def link_host(c: Column) -> Column:
    return F.nullif(F.regexp_replace(F.lower(F.regexp_extract(c, r"^\s*[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)), r":\d+$", ""), F.lit(""))


def min_cost_flow(supply: dict[tuple[str, ...], int], quota: dict[str, int], caps: dict[str, int | None]) -> dict[tuple[tuple[str, ...], str], int]:
    """Tokens routed from each pattern to each of its sources: as many as fit, at the least total cost.

    Costs of a pattern's uses for a source are convex, in blocks of repetitions that double after the fourth. Successive
    shortest paths with potentials; the graph has one node for each pattern and source.
    """
    nodes = [0, *supply, *quota, 1]  # the ends are numbers, patterns tuples, sources strings
    number = {x: i for i, x in enumerate(nodes)}
    head: list[list[int]] = [[] for _ in nodes]
    to, cap, cost = [], [], []

    def arc(a, b, c: int, w: int) -> int:
        for u, v, x, y in ((a, b, c, w), (b, a, 0, -w)):
            head[number[u]].append(len(to))
            to.append(number[v])
            cap.append(x)
            cost.append(y)
        return len(to) - 2

    arcs: dict[tuple[tuple[str, ...], str], list[int]] = {}
    for p, tokens in supply.items():
        arc(0, p, sum(quota[s] for s in p), 0)
        for s in p:
            most = caps[s] if caps[s] is not None else -(-quota[s] // max(1, tokens))
            done, block = 0, 1
            while done < most and tokens:
                n = min(block, most - done)
                arcs.setdefault((p, s), []).append(arc(p, s, n * tokens, done))
                done += n
                block = done if done >= 4 else 1
    for s, q in quota.items():
        arc(s, 1, q, 0)
    s, t = 0, len(nodes) - 1
    potential = [0] * len(nodes)
    while True:
        dist: list[float] = [float("inf")] * len(nodes)
        dist[s], via, heap = 0, [-1] * len(nodes), [(0, s)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > dist[u]:
                continue
            for e in head[u]:
                if cap[e] > 0 and (new := d + cost[e] + potential[u] - potential[to[e]]) < dist[to[e]]:
                    dist[to[e]], via[to[e]] = new, e
                    heapq.heappush(heap, (new, to[e]))
        if dist[t] == float("inf"):
            break
        potential = [p + (int(d) if d < float("inf") else 0) for p, d in zip(potential, dist, strict=True)]
        v, push = t, 1 << 62
        while v != s:
            push, v = min(push, cap[via[v]]), to[via[v] ^ 1]
        v = t
        while v != s:
            cap[via[v]] -= push
            cap[via[v] ^ 1] += push
            v = to[via[v] ^ 1]
    return {k: sum(cap[e ^ 1] for e in es) for k, es in arcs.items()}


def members(docs: DataFrame, targets: list[str], tokenizer: str = TOKENIZER, split: str = PATTERN) -> DataFrame:
    """doc_id, pattern, n_tokens of the documents of any target source. Texts of no target source are not tokenised."""
    sent = docs.sparkSession.sparkContext.broadcast(frozenset(targets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, wanted = _encoding(tokenizer, split), sent.value
        for b in batches:
            ids, patterns, n = [], [], []
            for r, (own, host, text) in enumerate(zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True)):
                if (p := sorted({own, host} & wanted)) and (k := len(enc.encode_ordinary(text))):
                    ids.append(r)
                    patterns.append(p)
                    n.append(k)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ids, pa.int64())), pa.array(patterns, pa.list_(pa.string())), pa.array(n, pa.int64())], names=["doc_id", "pattern", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), source_name(F.col("source")).alias("own"), link_host(F.col("link")).alias("host"), "text")
    counted = rows.filter("doc_id is not null and text <> '' and (own is not null or host is not null)").mapInArrow(run, "doc_id bigint, pattern array<string>, n_tokens bigint")
    best = counted.groupBy("doc_id").agg(F.max(F.struct("n_tokens", "pattern")).alias("x"))
    return best.select("doc_id", "x.pattern", "x.n_tokens")


def filled(use: DataFrame) -> DataFrame:
    """(pattern, source, doc_id) beyond the prefix that bring each source's size nearer to the routed one.

    `use`, a written table, has pattern, source, doc_id, n_tokens, rest, extra. Each round takes for every pattern and source the
    document that leaves least; it ends when none leaves less than there is.
    """
    spark = use.sparkSession
    got = use.groupBy("pattern", "source").agg((F.max("rest") - F.sum(F.col("n_tokens") * F.col("extra"))).alias("left"))
    left = {(tuple(r[0]), r[1]): r[2] for r in gather(got, "the plan") if r[2] > 0}
    taken: list[tuple[list[str], str, int]] = []
    kinds = "pattern array<string>, source string, "
    free = use.filter("extra = 0 and rest > 0").select("pattern", "source", "doc_id", "n_tokens")
    while left:
        open_ = F.broadcast(spark.createDataFrame([(list(p), s, r) for (p, s), r in left.items()], kinds + "left bigint"))
        rows = free.join(open_, ["pattern", "source"]).filter(F.col("n_tokens") < 2 * F.col("left"))
        if taken:
            rows = rows.join(F.broadcast(spark.createDataFrame(taken, kinds + "doc_id bigint")), ["pattern", "source", "doc_id"], "left_anti")
        best = F.min(F.struct(F.abs(F.col("left") - F.col("n_tokens")).alias("off"), "n_tokens", "doc_id")).alias("x")
        found = gather(rows.groupBy("pattern", "source").agg(best), "the plan")
        taken += [(r[0], r[1], r[2]["doc_id"]) for r in found]
        left = {(tuple(r[0]), r[1]): n for r in found if (n := left[tuple(r[0]), r[1]] - r[2]["n_tokens"]) > 0}
    return spark.createDataFrame(taken, kinds + "doc_id bigint")


def mixture(docs: DataFrame, source_targets: DataFrame, total_tokens: int | None = None, exact_shares: bool = False, seed: int = 1, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """(mixture, report).

    The mixture has doc_id, source, uses and n_tokens (of one use). `total_tokens` is the size aimed at; unset it is
    the size of all documents of sources with a share, or with `exact_shares` the largest at which every source that has
    documents reaches its share. The report compares planned and actual shares and says what is short.
    """
    spark = docs.sparkSession
    rows = source_targets.select(source_name(F.col("source")).alias("s"), F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("share"), "max_repeats").filter("s is not null")
    named = gather(rows.groupBy("s").agg(F.max(F.struct("share", "max_repeats")).alias("x")).select("s", "x.*"), "the table of targets", MAX_SOURCES)
    share = {r["s"]: float(r["share"]) for r in named}
    caps = {r["s"]: None if r["max_repeats"] is None else max(0, int(r["max_repeats"])) for r in named}
    units = materialize(members(docs, sorted(share), tokenizer), "units")
    sums = gather(units.groupBy("pattern").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("d")), "the table of membership patterns")
    supply = {tuple(r["pattern"]): int(r["n"]) for r in sums}
    there = {s: sum(n for p, n in supply.items() if s in p) for s in share}
    n_docs = {s: sum(int(r["d"]) for r in sums if s in r["pattern"]) for s in share}
    active = {s for s, x in share.items() if x > 0}
    if total_tokens is None:
        total_tokens = sum(n for p, n in supply.items() if active & set(p))
        if exact_shares:
            total_tokens = min([total_tokens, *(int(caps[s] * there[s] / share[s]) for s in active if there[s] and caps[s] is not None)])
    quota = {s: round(share[s] * total_tokens) for s in share}
    flow = min_cost_flow(supply, quota, caps)
    plan = [(list(p), s, f // supply[p], f % supply[p], 1 << 30 if caps[s] is None else caps[s]) for (p, s), f in sorted(flow.items()) if f > 0]
    needs = F.broadcast(spark.createDataFrame(plan, "pattern array<string>, source string, whole bigint, rest bigint, cap bigint"))  # patterns x sources, counted above
    order = F.xxhash64(F.lit(seed), "source", "doc_id")
    use = units.join(needs, "pattern").withColumn("h", order).withColumn("range", F.pmod(F.shiftrightunsigned("h", 40), F.lit(RANGES)))
    ranges = use.filter("rest > 0").groupBy("pattern", "source", "range").agg(F.sum("n_tokens").alias("n"), F.max("rest").alias("rest"))
    w = Window.partitionBy("pattern", "source").orderBy("range")  # at most RANGES rows
    ranges = ranges.withColumn("before", F.sum("n").over(w) - F.col("n")).filter("before <= rest")
    cut = ranges.groupBy("pattern", "source").agg(F.max(F.struct("range", "before")).alias("c")).select("pattern", "source", F.col("c.range").alias("cut"), F.col("c.before").alias("before"))
    use = use.join(F.broadcast(cut), ["pattern", "source"], "left")  # as many rows as the plan
    at_cut = use.filter(F.col("range") == F.col("cut"))
    w = Window.partitionBy("pattern", "source").orderBy("h", "doc_id")
    run = F.sum("n_tokens").over(w) + F.col("before")
    taken = at_cut.select("pattern", "source", "doc_id", (run <= F.col("rest")).cast("int").alias("extra_cut"))
    use = use.join(taken, ["pattern", "source", "doc_id"], "left")
    extra = F.when(F.col("rest") == 0, 0).when(F.col("range") < F.col("cut"), 1).when(F.col("range") == F.col("cut"), F.coalesce("extra_cut", F.lit(0))).otherwise(0)
    use = materialize(use.withColumn("extra", extra).select("pattern", "source", "doc_id", "n_tokens", "whole", "rest", "cap", "extra"), "use")
    more = filled(use).withColumn("more", F.lit(1))
    use = use.join(F.broadcast(more), ["pattern", "source", "doc_id"], "left")  # a few documents for each row of the plan
    uses = F.least(F.col("whole") + F.col("extra") + F.coalesce("more", F.lit(0)), F.col("cap")).cast("int")
    mix = materialize(use.select("doc_id", "source", uses.alias("uses"), "n_tokens").filter("uses > 0"), "mixture")
    got = {r["source"]: r for r in gather(mix.groupBy("source").agg(F.sum(F.col("uses") * F.col("n_tokens")).alias("n"), F.max("uses").alias("u"), F.count("*").alias("d")), "the sums of sources")}
    all_ = sum(int(r["n"]) for r in got.values())
    report = [
        (s, share[s], caps[s], n_docs[s], there[s], quota[s], int(got[s]["n"]) if s in got else 0, round(int(got[s]["n"]) / all_, 6) if s in got else 0.0, int(got[s]["u"]) if s in got else 0, max(0, quota[s] - (int(got[s]["n"]) if s in got else 0)))
        for s in sorted(share)
    ]
    schema = "source string, target_share double, max_repeats int, n_docs bigint, available_tokens bigint, planned_tokens bigint, used_tokens bigint, actual_share double, most_uses int, shortfall_tokens bigint"
    return mix, spark.createDataFrame(report, schema)
