"""Changes between consecutive full snapshots of a keyed table.

Keys get persistent ordinals, kept in a stored table that is read and extended (`Ordinals`). A snapshot is, for each chunk of 32,768 ordinals, a bitmap of the ordinals present and a
vector of content fingerprints aligned with its set bits. Consecutive snapshots are then compared chunk by chunk:
`new AND NOT old` is added, `old AND NOT new` removed, and where both bits are set unequal fingerprints mean changed.

Only fixed-size chunks meet in a task, so neither a frequent date nor a frequent key makes a large group.

Defined results: a null or blank key does not count; of rows with one key in a snapshot the latest (nulls oldest, then the
largest fingerprint) holds; rows with a null date are ignored; the first snapshot yields nothing; an empty table too.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.functions.text import PLACEHOLDER, canonical_link, sanitize
from lakeloom.session import _fs, materialize, own_folder, release

CHUNK = 32_768
#: New keys that are numbered in one task; ordinals come in ranges, each filled from its start.
TOGETHER = 200_000
RANGE = 1 << 40


class Ordinals:
    """A stored table (key, ordinal) in a folder that all executors share. Ordinals stay as they are once given."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def table(self) -> DataFrame | None:
        """What is stored; None before anything is. Parts of a write that did not end are not read."""
        fs, p = _fs(self.spark, self.path)
        if not fs.exists(p):
            return None
        parts = sorted(str(x.getPath()) for x in fs.listStatus(p) if fs.exists(_fs(self.spark, f"{x.getPath()}/_SUCCESS")[1]))
        return self.spark.read.schema("key string, ordinal bigint").parquet(*parts) if parts else None

    def extended(self, keys: DataFrame) -> DataFrame:
        """The table after the keys it lacks have got ordinals behind those of their range."""
        known = self.table()
        new = keys.select(F.col("key").cast("string").alias("key")).filter("key is not null").distinct()
        if known is not None:
            new = new.join(known.select("key"), "key", "left_anti")
        new = materialize(new, "new_keys")
        n = new.count()
        if n or known is None:
            ranges = max(16, -(-n // TOGETHER))
            placed = new.withColumn("range", F.pmod(F.xxhash64("key"), F.lit(ranges)))
            rank = F.row_number().over(Window.partitionBy("range").orderBy("key")).cast("bigint") - 1
            used = F.lit(0)
            if known is not None:
                ends = known.groupBy(F.floor(F.col("ordinal") / F.lit(RANGE)).cast("bigint").alias("range")).agg((F.max("ordinal") % F.lit(RANGE) + 1).alias("used"))
                placed, used = placed.join(ends, "range", "left"), F.coalesce("used", F.lit(0))
            placed.select("key", (F.col("range") * F.lit(RANGE) + rank + used).alias("ordinal")).write.parquet(f"{self.path}/part-{uuid.uuid4().hex[:12]}")
        release(new)
        return self.table()


def pack(bits: bytes) -> bytes:
    """A bitmap as sorted 16-bit positions if that is shorter, else as it is; the first byte tells which."""
    a = np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little"))
    return b"\1" + a.astype("<u2").tobytes() if 2 * len(a) < len(bits) else b"\0" + bits


def unpack(packed: bytes | None) -> np.ndarray:
    """The set of positions as CHUNK booleans."""
    flags = np.zeros(CHUNK, bool)
    if packed:
        if packed[0]:
            flags[np.frombuffer(packed, "<u2", offset=1)] = True
        else:
            flags[:] = np.unpackbits(np.frombuffer(packed, np.uint8, offset=1), bitorder="little").astype(bool)[:CHUNK]
    return flags


def _pack_column(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        i = b.schema.get_field_index("bits")
        yield b.set_column(i, "bits", pa.array([pack(x) for x in b.column(i).to_pylist()], pa.binary()))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["added", "removed", "changed"]
    for b in batches:
        col = {n: b.column(n).to_pylist() for n in b.schema.names if n not in ("fp", "old_fp")}
        fps = {n: b.column(n) for n in ("fp", "old_fp")}
        dates, ordinals, kinds = [], [], []
        for r in range(b.num_rows):
            new, old = unpack(col["bits"][r]), unpack(col["old_bits"][r])
            found = [new & ~old, old & ~new]
            changed, common = np.zeros(CHUNK, bool), new & old
            if common.any():
                x, y = (np.asarray(fps[n][r].values.to_numpy(zero_copy_only=False)) for n in ("fp", "old_fp"))
                a, o = x[(np.cumsum(new) - 1)[common]], y[(np.cumsum(old) - 1)[common]]
                changed[np.flatnonzero(common)[a != o]] = True
            for kind, flags in zip(names, [*found, changed], strict=True):
                at = np.flatnonzero(flags)
                dates += [col["day"][r]] * len(at)
                ordinals.append(at + col["chunk"][r] * CHUNK)
                kinds += [kind] * len(at)
        all_ = np.concatenate(ordinals) if ordinals else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(dates, pa.date32()), pa.array(all_.astype(np.int64)), pa.array(kinds, pa.string())], names=["day", "ordinal", "change_kind"])


def snapshot_changes(df: DataFrame, day: Column, key: Column, fingerprint: Column, version: Column, ordinals: Ordinals | None = None) -> DataFrame:
    """(snapshot_date, key, change_kind) for each pair of consecutive days. `fingerprint` is a bigint of the content.

    Without a stored table of `ordinals` one is made for the run: the first day begins it, the others extend it.
    """
    rows = df.select(day.cast("date").alias("day"), key.alias("key"), fingerprint.alias("fp"), version.alias("v")).filter("day is not null and key is not null")
    last = materialize(rows.groupBy("day", "key").agg(F.max(F.struct("v", "fp")).getField("fp").alias("fp")), "last")
    if ordinals is None:
        ordinals = Ordinals(df.sparkSession, own_folder(df.sparkSession, "ordinals"))
        ordinals.extended(last.join(F.broadcast(last.agg(F.min("day").alias("day"))), "day"))
    ordinals = ordinals.extended(last)
    days = last.select("day").distinct()
    # one row for each day, hence no partition key
    following = days.withColumn("next_day", F.lead("day").over(Window.orderBy("day")))
    placed = last.join(ordinals, "key").select("day", F.floor(F.col("ordinal") / F.lit(CHUNK)).cast("bigint").alias("chunk"), (F.col("ordinal") % CHUNK).alias("pos"), "fp")
    chunks = placed.groupBy("day", "chunk").agg(
        F.bitmap_construct_agg("pos").alias("bits"),
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "fp"))), lambda x: x["fp"]).alias("fp"),
    )
    chunks = chunks.mapInArrow(_pack_column, chunks.schema)
    old = chunks.join(following, "day").filter("next_day is not null").select(F.col("next_day").alias("day"), "chunk", F.col("bits").alias("old_bits"), F.col("fp").alias("old_fp"))
    both = chunks.join(old, ["day", "chunk"], "full_outer").select("day", "chunk", "bits", "fp", "old_bits", "old_fp")
    found = both.mapInArrow(_compare, "day date, ordinal bigint, change_kind string")
    found = found.join(following.select(F.col("next_day").alias("day")).filter("day is not null"), "day", "left_semi").join(ordinals, "ordinal")
    return found.select(F.date_format("day", "yyyy-MM-dd").alias("snapshot_date"), "key", "change_kind")


def page_fingerprint(title: Column, sections: Column) -> Column:
    """Of the title and the ordered sections that have content, blanks and empty headings made alike."""
    made = F.transform(
        F.coalesce(sections, F.array().cast("array<struct<heading:string,content:string>>")),
        lambda s: F.struct(F.coalesce(F.nullif(sanitize(s["heading"]), F.lit("")), F.lit(PLACEHOLDER)).alias("h"), sanitize(s["content"]).alias("c")),
    )
    return F.xxhash64(F.lit(7), sanitize(title), F.filter(made, lambda s: s["c"] != ""))


def corpus_changes(snapshots: DataFrame, ordinals: Ordinals | None = None) -> DataFrame:
    """(snapshot_date, link, change_kind) of the pages of dated crawls."""
    found = snapshot_changes(
        snapshots, F.col("snapshot_date"), canonical_link(F.col("link")), page_fingerprint(F.col("title"), F.col("sections")), F.col("scraped_at"), ordinals
    )
    return found.select("snapshot_date", F.col("key").alias("link"), "change_kind")
