"""Session settings, lineage cuts and checks of what may be sent to every executor."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows a table may have to be gathered on the driver or broadcast by hand.
MAX_BROADCAST_ROWS = 50_000
#: Keys with more than this part of all rows are met by broadcast: there are fewer than `HOT` of them.
HOT = 10_000
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own: list[tuple[SparkSession, str]] = []


def build_session(app: str = "lakeloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; `conf` keys use `__` for dots."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in (base | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir`, or a temporary one on a local master only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="lakeloom-")
    atexit.register(shutil.rmtree, path[7:], ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def drop_own_tables() -> None:
    """Removes what `materialize` wrote in this process."""
    while _own:
        spark, path = _own.pop()
        try:
            fs, p = _fs(spark, path)
            fs.delete(p, True)
        except Exception:  # the session may be gone: the folder is the cluster's to clean then
            if path.startswith("file://"):
                shutil.rmtree(path[7:], ignore_errors=True)


atexit.register(drop_own_tables)


def own_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, removed when this process ends."""
    path = f"{shared_dir(spark).rstrip('/')}/lakeloom-{os.getpid()}/{name}-{uuid.uuid4().hex[:12]}"
    _own.append((spark, path))
    return path


def materialize(df: DataFrame, name: str, plain: bool = False) -> DataFrame:
    """Writes `df` to the shared folder and reads it back: the lineage is cut and a lost executor costs nothing.

    `plain` leaves out dictionaries, for columns of hashes. The write's shuffle files go as soon as it ends.
    """
    spark = df.sparkSession
    path = own_folder(spark, name)
    before = spark.conf.get(CLEANUP, None)
    try:
        spark.conf.set(CLEANUP, "true")
        df.write.option("parquet.enable.dictionary", str(not plain).lower()).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    out = spark.read.schema(df.schema).parquet(path)
    out._lakeloom_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes tables of `materialize` that nothing reads any more: what was made of them must have been written."""
    for t in tables:
        path = t._lakeloom_path
        fs, p = _fs(t.sparkSession, path)
        fs.delete(p, True)
        _own.remove((t.sparkSession, path))


def join_one(big: DataFrame, small: DataFrame, key: str) -> DataFrame:
    """`big` joined with `small`, a written table of one row for each key, however often a key occurs in `big`.

    A table counted as small is broadcast. Else the keys with over 1 / `HOT` of the rows of `big`, of which there are fewer
    than `HOT`, meet by broadcast and only the others are shuffled, so no task gets a hot key.
    """
    if small.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS:
        return big.join(F.broadcast(small), key)
    counts = materialize(big.groupBy(key).count(), "counts", plain=True)
    least = (counts.agg(F.sum("count")).first()[0] or 0) // HOT
    hot = F.broadcast(counts.filter(F.col("count") > max(1000, least)).select(key))
    return big.join(F.broadcast(small.join(hot, key, "left_semi")), key).unionByName(big.join(hot, key, "left_anti").join(small, key))


def gather(df: DataFrame, what: str, most: int = MAX_BROADCAST_ROWS) -> list:
    """Rows of a table whose size is bounded by its nature; raises where the bound is exceeded."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{what} has over {most} rows: too many to be sent to every executor")
    return rows


def bounded_sample(df: DataFrame, key: str, what: str, most: int, seed: int = 1) -> list:
    """At most `most` rows: those with the smallest hashes of `key`, equal at every partitioning. Rows far from the smallest
    hashes are dropped where they are, so what reaches the driver does not grow with the number of partitions."""
    n = df.count()
    h = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 40))
    rows = df.withColumn("__h", h)
    if n > most:
        rows = rows.filter(F.col("__h") <= int((1 << 40) * min(1.0, 1.2 * most / n + 500 / n)))
    return [r[:-1] for r in gather(rows.orderBy("__h", *[c for c in df.columns if c != key][:1]).limit(most), what, most)]


def empty_as(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
