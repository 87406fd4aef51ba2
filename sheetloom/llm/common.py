"""Helpers that all corpus operators share."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WHITE = re.compile(r"[\x20\x09-\x0D]+")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bounded_batches(spark: SparkSession, megabytes: int = 2) -> None:
    """Arrow batches are bounded in bytes, so that a few huge texts can't fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(megabytes << 20))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; our own only where none is named and all executors are on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="sheetloom-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def store(df: DataFrame, what: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: short lineage that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/sheetloom/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def by_part(df: DataFrame, row_col: str, what: str) -> str:
    """Writes a table with a row number of monotonically_increasing_id to the shared folder, a folder for each partition that the numbers name; its path.

    What belongs to one partition of the numbered table can then be read beside it (``attach``), and the numbered table itself isn't shuffled.
    """
    path = f"{shared_folder(df.sparkSession)}/sheetloom/{what}-{uuid.uuid4().hex}"
    df.withColumn("_sl_part", F.shiftright(row_col, 33)).repartition("_sl_part").write.partitionBy("_sl_part").parquet(path)
    where = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path if "://" in path or path.startswith("file:") else "file://" + path


def attach(batches, path: str, row_col: str, column: str, kind: pa.DataType):
    """Batches of the numbered table with the column that the table at path has for each row, null where it has none."""
    from pyarrow import fs
    from pyarrow import parquet as pq

    system, place = fs.FileSystem.from_uri(path)
    parts: dict[int, pa.Table | None] = {}
    for batch in batches:
        rows = batch.column(batch.schema.get_field_index(row_col)).to_numpy()
        of, at, tables, base = rows >> 33, np.full(len(rows), -1), [], 0
        for p in np.unique(of).tolist():
            if p not in parts:
                parts.clear()
                folder = f"{place}/_sl_part={p}"
                there = system.get_file_info(folder).type != fs.FileType.NotFound
                parts[p] = pq.read_table(folder, filesystem=system, partitioning=None, columns=[row_col, column]).sort_by(row_col) if there else None
            if parts[p] is None or not parts[p].num_rows:
                continue
            known, here = parts[p].column(row_col).to_numpy(), np.flatnonzero(of == p)
            k = np.minimum(np.searchsorted(known, rows[here]), len(known) - 1)
            same = known[k] == rows[here]
            at[here[same]] = base + k[same]
            tables.append(parts[p].column(column).cast(kind))
            base += len(known)
        found = pa.chunked_array([c for t in tables for c in t.chunks], kind).combine_chunks() if tables else pa.nulls(0, kind)
        if isinstance(found, pa.ChunkedArray):
            found = pa.concat_arrays(found.chunks) if found.num_chunks else pa.nulls(0, kind)
        yield pa.RecordBatch.from_arrays([*batch.columns, found.take(pa.array(at, mask=at < 0))], [*batch.schema.names, column])


def settle(spark: SparkSession) -> None:
    """After a stored step: lets Spark's cleaner remove the shuffle files of plans that are done, which it does when the driver's garbage is collected."""
    for _ in range(2):  # plans that Python's cycles still hold go first
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [x if x is not None else "" for x in batch.column(column).to_pylist()]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 of a whole text column (null: empty) in one array, and offsets of len + 1; no copy where Arrow allows it."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finalizer of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Odd multiplier of the rolling hash, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """BASE**0 .. BASE**(n-1) modulo 2**64, or those of its inverse."""
    key = "i" if inverse else "p"
    have = _POWERS.get(key)
    if have is None or len(have) < n:
        size = max(1 << 16, n + n // 16)
        b = pow(BASE, -1, 1 << 64) if inverse else BASE
        have = np.ones(size, np.uint64)
        step = 1
        while step < size:  # doubling
            more = min(step, size - step)
            have[step : step + more] = have[:more] * np.uint64(pow(b, step, 1 << 64))
            step *= 2
        _POWERS[key] = have
    return have[:n]


_SLICE = 1 << 17
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (runs without ASCII white space; A-Z lowered), and for each text its first word's place, len + 1.

    Works on whole byte arrays: prefix sums of byte * BASE**position, times BASE**-start, mixed.
    """
    n, texts = len(data), len(offsets) - 1
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(texts + 1, np.int64)
    if n > _SLICE and texts > 1:  # what the processor's cache holds at a time
        hashes, places, first, total = [], [np.zeros(1, np.int64)], 0, 0
        while first < texts:
            last = min(texts, max(first + 1, int(np.searchsorted(offsets, offsets[first] + _SLICE, "right")) - 1))
            h, at = word_hashes(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], lower)
            hashes.append(h)
            places.append(at[1:] + total)
            total, first = total + len(h), last
        return np.concatenate(hashes), np.concatenate(places)
    if lower:
        data = _LOWER[data]
    word = ~_SPACE[data]
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    edge = offsets[1:-1]
    edge = edge[edge < n]
    begin[edge] = word[edge]
    end = word.copy()
    end[:-1] &= ~word[1:]
    end[edge[edge > 0] - 1] = word[edge[edge > 0] - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(n), out=total[1:])
    h = (total[ends] - total[starts]) * powers(n, inverse=True)[starts]
    h = mix(h ^ ((ends - starts).astype(np.uint64) << np.uint64(40)))
    return h, np.searchsorted(starts, offsets, side="left").astype(np.int64)


def crc_mod(column, modulus: int):
    """crc32 of the id as decimal text, modulo a number; null counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


def components(edges: DataFrame, what: str = "components") -> DataFrame:
    """node and label (the smallest node that it is connected with) for all nodes of edges (a, b: long).

    Each round takes the smallest label among neighbours and then the label of that label, so chains shorten by half; rounds are written to the
    shared folder.  Hot nodes are only aggregated and joined, never collected.
    """
    both = store(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct(), what + "-edges")
    labels = store(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), what)
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = store(step.join(jump, "label", "left").select("node", "was", F.least("label", F.coalesce("further", "label")).alias("label")), what)
        labels = new.select("node", "label")
        if new.where("was != label").limit(1).count() == 0:
            return labels
