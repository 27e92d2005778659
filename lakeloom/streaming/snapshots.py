"""Structured Streaming over links and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lakeloom.session import _fs, own_folder


def first_seen(links: DataFrame, key: str, at: str, delay: str = "1 day") -> DataFrame:
    """Each key once, as it first comes, state kept as long as `delay`."""
    return links.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def tumbling(events: DataFrame, at: str, group: str, value: str, width: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Counts and sums of each window and group; late rows beyond `delay` are left out."""
    rows = events.withWatermark(at, delay).groupBy(F.window(at, width), group)
    return rows.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("window_start"), group, "n", "total")


def run_once(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there and returns its rows from a written table."""
    spark: SparkSession = stream.sparkSession
    base = own_folder(spark, "stream")
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
    else:
        write = lambda batch, _: batch.write.mode("overwrite").parquet(f"{base}/out")
        q = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def read_parquet(spark: SparkSession, path: str, time_col: str | None = None) -> DataFrame:
    """A parquet file or folder as a stream; a time without zone becomes a timestamp."""
    import os

    schema = spark.read.parquet(path).schema
    plain = path.removeprefix("file:")
    folder, name = (os.path.dirname(path), os.path.basename(path)) if os.path.isfile(plain) else (path, "*.parquet")
    df = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    return df.withColumn(time_col, F.col(time_col).cast("timestamp")) if time_col else df


def new_keys(stream: DataFrame, key: str, base: str | None = None) -> DataFrame:
    """Each key once, in the micro-batch in which it first comes: (key, batch).

    What was seen is a table, not state in memory: each batch writes its new keys to a folder of its own and reads those of
    the batches before, so a batch that is tried again overwrites what it wrote and emits the same rows.
    """
    spark = stream.sparkSession
    base = base or own_folder(spark, "new-keys")

    def step(batch: DataFrame, number: int) -> None:
        keys = batch.select(key).filter(F.col(key).isNotNull()).distinct()
        fs, root = _fs(batch.sparkSession, f"{base}/keys")
        if fs.exists(root):  # any other failure to read is an error
            old = [str(p.getPath()) for p in fs.listStatus(root) if int(p.getPath().getName().partition("=")[2]) < number]
            if old:
                keys = keys.join(batch.sparkSession.read.schema(keys.schema).parquet(*old), key, "left_anti")
        keys.write.mode("overwrite").parquet(f"{base}/keys/batch={number}")

    stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    kind = stream.schema[key].dataType.simpleString()
    fs, root = _fs(spark, f"{base}/keys")
    return spark.read.schema(f"`{key}` {kind}, batch bigint").parquet(f"{base}/keys") if fs.exists(root) else spark.createDataFrame([], f"`{key}` {kind}, batch bigint")


def latest_of_updates(stream: DataFrame, keys: list[str]) -> DataFrame:
    """The last row of each key that a stream in update mode gives. State that the watermark has passed is dropped."""
    spark = stream.sparkSession
    base = own_folder(spark, "updates")
    write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{base}/out/batch={n}")
    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/state").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    others = [c for c in stream.columns if c not in keys]
    rows = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(f"{base}/out")
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("x"))
    return last.select(*keys, *(F.col(f"x.{c}").alias(c) for c in others))
