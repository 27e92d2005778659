"""Figures about runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Rows of a group from which on ranks are found within a bracket; the bracket's accuracy.
SMALL, ACCURACY = 20_000, 10_000


def latency(df: DataFrame, group: str, seconds: str) -> DataFrame:
    """n, average and 90th percentile by the exclusive rule (the largest of fewer than ten values) of each group.

    Only rows in a bracket around the wanted rank are ordered: approximate percentiles, whose ranks are off by at most a
    ten-thousandth of the group, bound it, and the rows below are counted. A large group is so never sorted in one task.
    """
    rows = df.filter(F.col(seconds).isNotNull()).select(group, F.col(seconds).cast("double").alias("x"))
    around = F.percentile_approx("x", F.array(F.lit(0.898), F.lit(0.902)), F.lit(ACCURACY))
    sizes = rows.groupBy(group).agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.max("x").alias("most"), F.min("x").alias("least"), around.alias("q"))
    small = F.col("n") <= SMALL
    bounds = sizes.select(group, "n", F.when(small, F.col("least")).otherwise(F.col("q")[0]).alias("lo"), F.when(small, F.col("most")).otherwise(F.col("q")[1]).alias("hi"))
    j = F.greatest(F.lit(1), F.least(F.floor(9 * (F.col("n") + 1) / 10), F.col("n") - 1))
    d = 9 * (F.col("n") + 1) - 10 * j
    placed = rows.join(bounds, group)
    # equal values are one row with their number, so a value that is frequent is no long sort either
    below = F.sum(F.when(F.col("x") < F.col("lo"), 1).otherwise(0))
    values = placed.groupBy(group, F.when((F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("hi")), F.col("x")).alias("x"), "n").agg(F.count("*").alias("m"), below.alias("below"))
    start = F.sum("below").over(Window.partitionBy(group))
    last = start + F.sum(F.when(F.col("x").isNotNull(), F.col("m")).otherwise(0)).over(Window.partitionBy(group).orderBy(F.col("x").asc_nulls_first()))
    at = values.withColumns({"last": last}).filter("x is not null").withColumn("first", F.col("last") - F.col("m") + 1)
    has = lambda r: F.max(F.when((F.col("first") <= r) & (r <= F.col("last")), F.col("x")))
    pair = at.groupBy(group).agg(has(j).alias("a"), has(j + 1).alias("b"))
    p90 = F.when(F.col("n") < 10, F.col("most")).otherwise((F.col("a") * (10 - d) + F.col("b") * d) / 10)
    return sizes.join(pair, group, "left").select(group, "n", F.round("mean", 6).alias("mean"), F.round(p90, 6).alias("p90"))


def progress(df: DataFrame, stage: str, at: str, every: int = 25, total: int | None = None, ranges: int = 64) -> DataFrame:
    """(stage, n_done, elapsed_s, rate) at each `every`th row of a stage in order of time.

    A stage is cut into ranges of time of about equal size; rows are numbered within a range, behind those of the ranges before.
    """
    us = F.unix_micros(F.col(at).cast("timestamp"))
    cuts = df.groupBy(stage).agg(F.percentile_approx(us, F.array(*(F.lit(i / ranges) for i in range(1, ranges))), F.lit(1000)).alias("cuts"), F.min(us).alias("began"))
    rows = df.withColumn("us", us).join(cuts, stage).withColumn("range", F.size(F.filter("cuts", lambda c: c < F.col("us"))))
    before = F.sum("m").over(Window.partitionBy(stage).orderBy("range")) - F.col("m")
    starts = rows.groupBy(stage, "range").agg(F.count("*").alias("m")).select(stage, "range", before.alias("before"))  # `ranges` rows a stage
    w = Window.partitionBy(stage, "range").orderBy(at, *[c for c in df.columns if c not in (stage, at)])
    done = rows.withColumn("i", F.row_number().over(w)).join(starts, [stage, "range"]).select(stage, (F.col("before") + F.col("i")).cast("bigint").alias("n_done"), ((F.col("us") - F.col("began")) / 1e6).alias("elapsed_s"))
    out = done.filter(F.col("n_done") % every == 0)
    out = out.withColumn("rate", F.when(F.col("elapsed_s") > 0, F.round(F.col("n_done") / F.col("elapsed_s"), 6)))
    return out.withColumn("eta_s", F.round((total - F.col("n_done")) / F.col("rate"), 3)) if total is not None else out
