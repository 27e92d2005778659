"""Sinks."""

from __future__ import annotations

import json
import os

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.functions import text as T

MATRIX_ROWS = 2_000_000


def link_list(df: DataFrame, path: str, column: str = "path") -> None:
    """Sorted distinct lines in one file; link lists of a site are small."""
    df.select(F.col(column).alias("value")).distinct().orderBy("value").coalesce(1).write.mode("overwrite").text(path)


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def corpus(df: DataFrame, path: str) -> None:
    rows = df if "doc_id" in df.columns else df.withColumn("doc_id", T.doc_id(F.col("link"), F.col("title")))
    rows.select("link", "title", "sections", "doc_id").write.mode("overwrite").json(path)


def corpus_array(df: DataFrame, path: str, most: int = 100_000) -> None:
    """The corpus as one JSON array in a file of the driver, for programs that want that; an export, its size checked."""
    rows = df.select("link", "title", "sections", "doc_id")
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"over {most} documents: write JSON lines instead")
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump([r.asDict(recursive=True) for r in rows.orderBy("link", "doc_id").toLocalIterator()], f, ensure_ascii=False, indent=2)
        f.write("\n")


def vectors(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def matrix(df: DataFrame, prefix: str, most: int = MATRIX_ROWS) -> tuple[str, str]:
    """`<prefix>.embeddings.npy` and `<prefix>.meta.json` on the driver, in order of row_idx; an export, with its size checked."""
    n = df.limit(most + 1).count()
    if n > most:
        raise ValueError(f"over {most} rows: write parquet instead")
    t = df.orderBy("row_idx").toArrow()
    os.makedirs(os.path.dirname(os.path.abspath(prefix)), exist_ok=True)
    np.save(f"{prefix}.embeddings.npy", t.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(t), -1))
    with open(f"{prefix}.meta.json", "w", encoding="utf-8") as f:
        json.dump(t.drop_columns(["embedding"]).to_pylist(), f, ensure_ascii=False, indent=1, default=str)
        f.write("\n")
    return f"{prefix}.embeddings.npy", f"{prefix}.meta.json"


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of `new`, and those of `old` with other keys."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)
