"""Exact vector search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.functions import vectors as V
from lakeloom.session import gather

#: Queries sent to every executor at once, and multiplied with a batch at once.
QUERY_BLOCK, STEP = 20_000, 500


def same_length(vec: Column, dim: int) -> Column:
    """The vector; an error in the task if its length is another."""
    return F.when(F.size(vec) == dim, vec).otherwise(F.raise_error(F.format_string("a vector has %d values, not " + str(dim), F.size(vec))).cast("array<float>"))


def top_k(df: DataFrame, id_col: str, vec_col: str, query: list[float], k: int = 10, min_score: float | None = None) -> DataFrame:
    """(id, score) of the k highest dot products with one query, ties by id. The threshold is applied before the limit."""
    if k < 1:
        raise ValueError("k must be at least 1")
    score = V.dot(F.col(vec_col), F.array(*(F.lit(float(x)) for x in query)))
    rows = df.filter(F.size(vec_col) == len(query)).select(id_col, score.alias("score"))
    if min_score is not None:
        rows = rows.filter(F.col("score") >= min_score)
    return rows.orderBy(F.desc("score"), id_col).limit(k)


def top_k_batch(df: DataFrame, queries: DataFrame, id_col: str, vec_col: str, query_id: str, k: int = 10, metric: str = "dot", min_score: float | None = None) -> DataFrame:
    """(query_id, id, score, rank) of the k best rows for each query, ties by id; exact.

    `metric` is dot, cosine or l2 (least squared distance first). Queries of any number go out in blocks by hash, one scan of the
    rows for each block; every Arrow batch of rows is multiplied with the block and keeps the rows for each query that may be
    among its k best, ties included, so that few rows are shuffled.
    """
    asked = queries.select(F.col(query_id).cast("bigint").alias("q"), F.col(vec_col).cast("array<double>").alias("v")).filter("v is not null")
    n = asked.count()
    blocks = -(-n * 5 // (QUERY_BLOCK * 4))
    spark = df.sparkSession
    out = None
    for block in range(max(1, blocks)):
        part = gather(asked.filter(F.pmod(F.xxhash64(F.lit(3), "q"), F.lit(blocks)) == block) if blocks > 1 else asked, "a block of queries", 2 * QUERY_BLOCK)
        sent = spark.sparkContext.broadcast((np.array([r[0] for r in part], np.int64), np.array([r[1] for r in part], np.float64)))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, q = sent.value
            for b in batches:
                if not len(ids) or not b.num_rows:
                    continue
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(np.float64)
                rows = b.column(0).to_numpy(zero_copy_only=False)
                for at in range(0, len(ids), STEP):
                    some = q[at : at + STEP]
                    s = some @ x.T
                    if metric == "cosine":
                        s /= np.maximum(1e-300, np.linalg.norm(some, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :])
                    elif metric == "l2":
                        s = -np.maximum(0, (some * some).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * s)
                    least = np.partition(s, s.shape[1] - k, 1)[:, s.shape[1] - k, None] if k < s.shape[1] else np.full((len(s), 1), -np.inf)
                    hit = s >= least - 1e-11
                    if min_score is not None:
                        hit &= s >= min_score
                    i, j = np.nonzero(hit)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at + i]), pa.array(rows[j]), pa.array(s[i, j])], names=[query_id, id_col, "score"])

        dim = len(part[0][1]) if part else 1
        rows = df.filter(F.size(vec_col) == dim).select(F.col(id_col).cast("bigint"), F.col(vec_col).cast("array<double>"))
        near = rows.mapInArrow(run, f"{query_id} bigint, {id_col} bigint, score double")
        out = near if out is None else out.unionByName(near)
    w = Window.partitionBy(query_id).orderBy(F.desc(F.round("score", 12)), id_col)
    best = out.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= k)
    return best.withColumn("score", -F.col("score")) if metric == "l2" else best


def embedding_stats(df: DataFrame, vec_col: str) -> DataFrame:
    """Rows, least and most values of a vector, rows without one."""
    n = F.size(vec_col)
    return df.agg(F.count("*").alias("n_rows"), F.min(F.when(n >= 0, n)).cast("bigint").alias("least_dim"), F.max(n).cast("bigint").alias("most_dim"), F.sum(F.when(F.col(vec_col).isNull(), 1).otherwise(0)).alias("n_null"))
