"""Two snapshots against each other."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from lakeloom.functions import text as T


def added(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return new.select(key).subtract(old.select(key))


def removed(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.select(key).subtract(new.select(key))


def common(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.select(key).intersect(new.select(key))


def union(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.select(key).unionByName(new.select(key)).distinct()


def section_text(sections: Column) -> Column:
    """Headings with a colon and contents, one after the other."""
    return F.array_join(F.transform(F.coalesce(sections, F.array().cast("array<struct<heading:string,content:string>>")), lambda s: F.concat(F.coalesce(s["heading"], F.lit(T.PLACEHOLDER)), F.lit(":\n"), F.coalesce(s["content"], F.lit("")))), "\n")


def status(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, status): added, removed, changed or same, by title and sections. One row for each key on either side."""
    a = old.select(key, T.sanitize(F.col("title")).alias("t1"), section_text(F.col("sections")).alias("s1"), F.lit(True).alias("in1"))
    b = new.select(key, T.sanitize(F.col("title")).alias("t2"), section_text(F.col("sections")).alias("s2"), F.lit(True).alias("in2"))
    same = (F.col("t1") == F.col("t2")) & (F.col("s1") == F.col("s2"))
    found = F.when(F.col("in1").isNull(), "added").when(F.col("in2").isNull(), "removed").when(same, "same").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, found.alias("status"))


def changed(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, title_changed, sections_changed) of common keys that differ."""
    a = old.select(key, T.sanitize(F.col("title")).alias("t1"), section_text(F.col("sections")).alias("s1"))
    b = new.select(key, T.sanitize(F.col("title")).alias("t2"), section_text(F.col("sections")).alias("s2"))
    rows = a.join(b, key).select(key, (F.col("t1") != F.col("t2")).alias("title_changed"), (F.col("s1") != F.col("s2")).alias("sections_changed"))
    return rows.filter("title_changed or sections_changed")


@F.pandas_udf(ArrayType(StringType()))
def _unified(old: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series([list(difflib.unified_diff((a or "").splitlines(), (b or "").splitlines(), lineterm="")) for a, b in zip(old, new, strict=True)], dtype=object)


def diffs(old: DataFrame, new: DataFrame, key: str, most_lines: int = 30) -> DataFrame:
    """(key, n_lines, diff) of common keys whose sections differ; longer diffs end with a mark. Only changed rows reach Python."""
    a = old.select(key, section_text(F.col("sections")).alias("s1"))
    b = new.select(key, section_text(F.col("sections")).alias("s2"))
    rows = a.join(b, key).filter("s1 <> s2").withColumn("d", _unified("s1", "s2"))
    shown = F.when(F.size("d") > most_lines, F.concat(F.slice("d", 1, most_lines), F.array(F.lit("…")))).otherwise(F.col("d"))
    return rows.select(key, F.size("d").alias("n_lines"), F.array_join(shown, "\n").alias("diff"))


def latest_two(dates: DataFrame, day: str) -> DataFrame:
    """(day, age): the latest two distinct days, 1 the newest."""
    from pyspark.sql import Window

    days = dates.select(F.col(day).cast("date").alias("day")).filter("day is not null").distinct().orderBy(F.desc("day")).limit(2)
    return days.withColumn("age", F.row_number().over(Window.orderBy(F.desc("day"))).cast("bigint"))  # two rows
