"""Sources: link lists, corpora, question records, vectors, artefacts."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lakeloom import schemas
from lakeloom.functions import text as T


def link_list(spark: SparkSession, path: str, distinct: bool = True) -> DataFrame:
    """`path` column: stripped lines that aren't blank; a snapshot day from a dated folder above the file, if any."""
    rows = spark.read.text(path).select(T.strip(F.col("value")).alias("path"), F.try_to_date(F.regexp_extract(F.input_file_name(), r"(\d{4}-\d{2}-\d{2})/[^/]*$", 1), "yyyy-MM-dd").alias("snapshot"))
    rows = rows.filter("path <> ''")
    return rows.distinct() if distinct else rows


def link_csv(spark: SparkSession, path: str, column: str = "Links") -> DataFrame:
    return spark.read.csv(path, header=True).select(T.strip(F.col(column)).alias("path")).filter("path <> ''")


def corpus(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Documents of a JSON array. Strict: a malformed file or a document without title, sections or content is an error."""
    mode = "FAILFAST" if strict else "PERMISSIVE"
    rows = spark.read.schema(schemas.CORPUS).option("multiLine", True).option("mode", mode).json(path)
    bad = F.col("link").isNull() | (F.coalesce(F.length("title"), F.lit(0)) < 1) | (F.coalesce(F.size("sections"), F.lit(-1)) < 1) | F.exists("sections", lambda s: F.coalesce(F.length(s["content"]), F.lit(0)) < 1)
    if strict:
        rows = rows.withColumn("link", F.when(bad, F.raise_error(F.lit("a document lacks its link, title, sections or content"))).otherwise(F.col("link")))
    else:
        rows = rows.filter(~bad)
    link = T.canonical_link(F.col("link"))
    return rows.withColumn("doc_id", T.doc_id(link, F.col("title"))).withColumn("link", link)


def hqe_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of JSON lines; blank lines are skipped."""
    return spark.read.schema(schemas.HQE_RECORD).json(path).filter("doc_id is not null or questions is not null")


def question_meta(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a JSON array in one file, numbered by position where they have no number."""
    rows = spark.read.schema(schemas.QUESTION_META).option("multiLine", True).json(path)
    place = F.monotonically_increasing_id()  # the array is one partition, so these are positions
    return rows.coalesce(1).withColumn("row_idx", F.coalesce("row_idx", place))


def whole_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def pages(spark: SparkSession, path: str) -> DataFrame:
    """HTML files as (url, html)."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("url"), F.col("value").alias("html"))


class _Rows(InputPartition):
    def __init__(self, start: int, end: int):
        super().__init__((start, end))
        self.start, self.end = start, end


class _MatrixReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.step = options["path"].removeprefix("file://"), int(options.get("rows", 50_000))

    def partitions(self) -> list[InputPartition]:
        import numpy as np

        n = len(np.load(self.path, mmap_mode="r"))
        return [_Rows(a, min(n, a + self.step)) for a in range(0, n, self.step)] or [_Rows(0, 0)]

    def read(self, partition) -> Iterator:
        import numpy as np
        import pyarrow as pa

        m = np.load(self.path, mmap_mode="r")
        for a in range(partition.start, partition.end, 5_000):
            part = np.asarray(m[a : min(partition.end, a + 5_000)], np.float32)
            offsets = pa.array(np.arange(len(part) + 1) * m.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + len(part))), pa.ListArray.from_arrays(offsets, pa.array(part.ravel()))], names=["row_idx", "embedding"])


class MatrixSource(DataSource):
    """`spark.read.format("npy_matrix").load(path)`: ranges of rows of a mapped matrix, one partition each."""

    @classmethod
    def name(cls) -> str:
        return "npy_matrix"

    def schema(self) -> str:
        return "row_idx bigint, embedding array<float>"

    def reader(self, schema) -> DataSourceReader:
        return _MatrixReader(self.options)


def matrix(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(MatrixSource)
    return spark.read.format("npy_matrix").load(path)


def files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(path, modificationTime) below a folder; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder).select("path", "modificationTime")


def newest(spark: SparkSession, folder: str, pattern: str, fallback: str | None = None) -> str | None:
    """The path modified last."""
    for p in filter(None, (pattern, fallback)):
        if (r := files(spark, folder, p).agg(F.max_by("path", F.struct("modificationTime", "path"))).first()[0]) is not None:
            return r
    return None


def latest_two_files(listed: DataFrame, prefix: str = "links_content_", suffix: str = ".json", without: str = "all_relative") -> DataFrame:
    """(path, day) of the two latest dated files of `listed` (path); names without a date are skipped; an error if under two."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    day = F.try_to_date(F.regexp_extract(name, r"(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd")
    rows = listed.select("path", day.alias("day")).filter(name.startswith(prefix) & name.endswith(suffix) & ~name.contains(without) & F.col("day").isNotNull())
    found = rows.orderBy(F.desc("day"), F.desc("path")).limit(2)
    if found.count() < 2:
        raise ValueError(f"fewer than two files {prefix}*{suffix}")
    return found


def companions(artefact: str) -> dict[str, str]:
    """Paths of the metadata, records and corpus that belong to a matrix."""
    base = re.sub(r"(\.embeddings)?\.npy$", "", artefact)
    return {"meta": f"{base}.meta.json", "records": f"{base}.jsonl", "corpus": re.sub(r"\.hqe(\.v\d+)?$", "", base) + ".json"}


def dated(base: str, day: str) -> str:
    return f"{base.rstrip('/')}/{day}"
