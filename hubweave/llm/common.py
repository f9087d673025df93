"""Shared helpers: table access, shared scratch tables, vectorised word hashing."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OWN: dict[str, str] = {}
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names.

    Where it is unset, a local session (as in tests) gets a folder of its own; on a cluster that is an error, as a
    folder of the driver's would be another one on every executor.
    """
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    app = spark.sparkContext.applicationId
    if not re.fullmatch(r"local(\[[^,]*(,.*)?\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="hubweave-")
        atexit.register(shutil.rmtree, _OWN[app], True)
    return f"file://{_OWN[app]}"


def materialize(df: DataFrame, **options) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared scratch folder and read it back.

    The table outlives lost executors. It stays until it is released or the scratch folder is cleaned. The shuffle files
    behind it have served; they go when the driver collects its garbage, which Spark itself asks for only every 30 minutes.
    Python workers get a few megabytes at a time, as rows may be long. ``options`` are the writer's.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/hubweave/{uuid.uuid4().hex}"
    batch = spark.conf.get(BATCH_BYTES)
    spark.conf.set(BATCH_BYTES, "4m")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(BATCH_BYTES, batch)
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out.hubweave_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables that materialize() wrote; everything made from them has to be written by then."""
    for table in tables:
        jvm, path = table.sparkSession.sparkContext._jvm, table.hubweave_path
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def first_rows(rows: DataFrame, by: str, order: list[str], n: int, buckets: int = 256) -> DataFrame:
    """The first ``n`` rows of each value of ``by``, in two steps: no task meets all rows of a value."""
    bucket = F.pmod(F.xxhash64(*order), F.lit(buckets))
    some = rows.withColumn("bucket", bucket).withColumn("place", F.row_number().over(Window.partitionBy(by, "bucket").orderBy(*order))).where(F.col("place") <= n)
    return some.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("place") <= n).drop("bucket", "place")


# --- words ---------------------------------------------------------------------------------------

WORD_PATTERN = r"[^\x20\x09-\x0D]+"
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_KEYS = mix64(np.arange(1, 257, dtype=np.uint64) * _GOLDEN)
_POWER_BASE = np.uint64(0xD6E8FEB86659FD93)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _POWER_BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = _powers(1024)


def string_parts(column: pa.Array, limit: int = 1 << 20):
    """Cut a string column into (first row, offsets, bytes), each part of about ``limit`` bytes (one row at least)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null("") if column.null_count else column
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        end = min(end, len(column))
        yield row, offsets[row : end + 1] - offsets[row], data[offsets[row] : offsets[end]]
        row = end


def word_spans(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of every word, and for each row the index of its first word (one more at the end)."""
    space = _SPACE[data]
    before = np.ones(len(data), bool)
    before[1:] = space[:-1]
    inner = offsets[:-1][offsets[:-1] < len(data)]
    before[inner] = True
    starts = np.flatnonzero(before & ~space)
    after = np.ones(len(data), bool)
    after[:-1] = space[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    after[last] = True
    ends = np.flatnonzero(after & ~space) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word's bytes (A-Z lower-cased first)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    data = _LOWER[data] if lower else data
    begin = int(starts[0])
    place = np.arange(begin, len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    longest = int((ends - starts).max())
    powers = _POWERS if longest <= len(_POWERS) else _powers(longest)
    keyed = _BYTE_KEYS[data[begin:]] * powers[np.minimum(place, len(powers) - 1)]
    keyed[_SPACE[data[begin:]]] = 0
    return mix64(np.add.reduceat(keyed, starts - begin) + (ends - starts).astype(np.uint64) * _GOLDEN)


def runs(batches, name: str):
    """Batches of rows sorted by ``name``, cut anew so that no value's rows are in two of them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch[name].to_numpy()
        last = int(np.searchsorted(values, values[-1], "left"))
        if last == 0 and (not held or held[-1][name][0].as_py() == values[0]):
            held.append(batch)
            continue
        if last == 0 or (held and held[-1][name][0].as_py() != values[0]):
            yield pa.concat_batches(held)
            held = []
        if last:
            yield pa.concat_batches([*held, batch.slice(0, last)])
        held = [batch.slice(last)]
    if held:
        yield pa.concat_batches(held)


_SHINGLE_KEYS = mix64(np.arange(11, 11 + 64, dtype=np.uint64) * _GOLDEN) | np.uint64(1)


def shingle_sets(column: pa.Array, width: int = 5):
    """Yield (row, sorted distinct hashes of its ``width``-word shingles) for each row.

    With fewer words, the whole sequence is one shingle; without words the set is empty.
    """
    for row, offsets, data in string_parts(column):
        starts, ends, first = word_spans(offsets, data)
        words = word_hashes(data, starts, ends)
        rolled = np.zeros(max(0, len(words) - width + 1), np.uint64)
        for k in range(width):
            rolled += words[k : k + len(rolled)] * _SHINGLE_KEYS[k]
        rolled = mix64(rolled)
        for i in range(len(offsets) - 1):
            a, b = int(first[i]), int(first[i + 1])
            if b - a >= width:
                yield row + i, np.unique(rolled[a : b - width + 1])
            elif b > a:
                yield row + i, mix64(np.sum(words[a:b] * _SHINGLE_KEYS[: b - a], keepdims=True) + np.uint64(b - a))
            else:
                yield row + i, np.zeros(0, np.uint64)
