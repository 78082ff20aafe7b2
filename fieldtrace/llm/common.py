"""Helpers shared by the corpus operators: stage tables, Arrow text batches, word hashes."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Text bytes that one numpy pass works on; a longer text is worked on alone.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """New folder name below ``spark.checkpoint.dir``, or below the warehouse where no such folder is set."""
    root = (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
            or spark.conf.get("spark.sql.warehouse.dir"))
    return f"{root.rstrip('/')}/corpus-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Cut lineage: write ``df`` to a new shared folder and scan what was written; the files go when the driver ends."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.option("compression", "zstd").parquet(path)
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete what ``written`` wrote; nothing may read these tables any more.

    The driver then drops what it holds of finished shuffles, so executors delete their files.
    """
    spark = None
    for table_ in tables:
        path = getattr(table_, "_written_to", None)
        if path:
            spark = table_.sparkSession
            hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)
    if spark is not None:
        gc.collect()
        spark._jvm.System.gc()


def free_name(df: DataFrame, name: str) -> str:
    """``name``, longer where the table has such a column."""
    while name in df.columns:
        name += "_"
    return name


def labelled_sample(rows: DataFrame, label: str, per_label: int, order: str = "doc_id") -> DataFrame:
    """About ``per_label`` rows of each label, all of a label that has fewer: those with the smallest hash of ``order``."""
    rows = rows.where(rows[label].isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}  # one row per label
    if not sizes:
        return rows.limit(0)
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, per_label / n))]), F.col(label))
    return rows.where(F.pmod(F.xxhash64(order), F.lit(1 << 30)) < share * (1 << 30))


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``limit`` bytes of ``text``, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        row = 0
        while row < batch.num_rows:
            before = int(ends[row - 1]) if row else 0
            stop = max(row + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(row, stop - row)
            row = stop


def flat_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column in one array and the bounds of its rows; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return flat, bounds - bounds[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_STEP = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_CODES = np.arange(256)
IS_WORD = (((_CODES >= 48) & (_CODES <= 57)) | ((_CODES >= 97) & (_CODES <= 122))
           | ((_CODES >= 65) & (_CODES <= 90)) | (_CODES >= 128))
_LOWER = np.where((_CODES >= 65) & (_CODES <= 90), _CODES + 32, _CODES)
_BYTE_VALUE = mix((_LOWER.astype(np.uint64) + np.uint64(1)) * _STEP)
_RAW_VALUE = mix((_CODES.astype(np.uint64) + np.uint64(300)) * _STEP)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, kept for the next call."""
    if len(_POWERS.get("up", ())) < n:
        n = max(n, CHUNK_BYTES + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


class Hashes:
    """64-bit hashes of spans of one byte array, equal for equal bytes wherever the span lies."""

    def __init__(self, flat: np.ndarray, lower: bool = True):
        up, self._down = _powers(len(flat) + 1)
        self._sums = np.zeros(len(flat) + 1, np.uint64)
        np.cumsum((_BYTE_VALUE if lower else _RAW_VALUE)[flat] * up[:len(flat)], out=self._sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self._sums[ends] - self._sums[starts]) * self._down[starts] + (ends - starts).astype(np.uint64) * _STEP)


def words(flat: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word: a run of ASCII letters, digits and non-ASCII bytes."""
    inside = IS_WORD[flat]
    breaks = np.zeros(len(flat) + 1, bool)
    breaks[bounds] = True
    before = np.empty_like(inside)
    after = np.empty_like(inside)
    before[:1], before[1:] = False, inside[:-1]
    after[-1:], after[:-1] = False, inside[1:]
    starts = np.flatnonzero(inside & (breaks[:-1] | ~before))
    ends = np.flatnonzero(inside & (breaks[1:] | ~after)) + 1
    return starts, ends, np.searchsorted(bounds, starts, "right") - 1


def shingles(hashes: np.ndarray, rows: np.ndarray, n_rows: int, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each run of ``k`` words; fewer words, but not none, make one shingle."""
    first = np.searchsorted(rows, np.arange(n_rows + 1), "left")
    count = np.diff(first)
    made = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    row = np.repeat(np.arange(n_rows), made)
    at = np.arange(len(row)) - np.repeat(np.cumsum(made) - made, made) + first[:-1][row]
    total = np.zeros(len(row), np.uint64)
    last = first[1:][row]
    padded = np.append(hashes, np.uint64(0))
    with np.errstate(over="ignore"):
        for j in range(k):
            factor = mix(np.full(1, j + 17, np.uint64) * _STEP)[0] | np.uint64(1)
            here = np.minimum(at + j, len(hashes))
            total += np.where(at + j < last, padded[here], np.uint64(0)) * factor
    return mix(total), row
