"""Shared helpers: tables in the shared folder, and vectorised tokenising inside tasks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The word pattern of every operator here: runs without space, tab, LF, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"
#: Most bytes of text that a task tokenises at once; a longer text is taken alone.
CHUNK_BYTES = 1 << 18
#: Most rows and bytes of an Arrow batch while tables are written: whole texts are large rows.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 1 << 24}
#: Most keys that are broadcast (8 to 16 bytes each); beyond, both sides are joined by a shuffle.
BROADCAST_KEYS = 2_000_000

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    One is set from a local folder only where the session names none and runs in one process (tests).
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back.

    Cuts the lineage: what follows survives lost executors and scans only the columns that it needs.  Arrow batches are
    bounded by BATCH meanwhile; the session's own settings come back afterwards.
    """
    spark, path = df.sparkSession, f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    was = {k: int(str(spark.conf.get(k)).removesuffix("b")) if str(spark.conf.get(k)).removesuffix("b").lstrip("-").isdigit() else spark.conf.get(k) for k in BATCH}
    for k, most in BATCH.items():
        if not isinstance(was[k], int) or not 0 < was[k] <= most:
            spark.conf.set(k, str(most))
    try:
        df.write.parquet(path)
    finally:
        for k, v in was.items():
            spark.conf.set(k, str(v))
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def released(*tables: DataFrame) -> None:
    """Deletes the files of ``written`` tables that nothing reads any more."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def arrow_map(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``mapInArrow``; ``written`` bounds the batches of what it runs."""
    return df.mapInArrow(run, schema)


def key_type(df: DataFrame, key: str) -> str:
    """The type of a key column, for the schema of what a task returns."""
    return df.schema[key].dataType.simpleString()


def small(table: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it has up to BROADCAST_KEYS rows; larger ones are joined by a shuffle."""
    return F.broadcast(table) if table.count() <= BROADCAST_KEYS else table


def without(docs: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose ``key`` isn't in the one column of ``gone`` (a written table); null equals null.

    Up to BROADCAST_KEYS keys are broadcast, so that texts stay where they are; more are joined by a shuffle.
    """
    return docs.join(small(gone), docs[key].eqNullSafe(gone[gone.columns[0]]), "left_anti")


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 over uint64 values."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        with np.errstate(over="ignore"):
            p = np.full(max(n, 4096), np.uint64(_BASE), dtype=np.uint64)
            p[0] = 1
            _POWERS = np.multiply.accumulate(p)
    return _POWERS


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n + 1 offsets of a string column; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices a string column into runs of rows of about ``CHUNK_BYTES``: (first row, end row, bytes, offsets)."""
    raw, off = string_buffers(column)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + CHUNK_BYTES, side="right")) - 1)
        yield lo, hi, raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


class Words:
    """Words of a run of texts: start and end byte, text number, 64-bit hash of each word's bytes."""

    def __init__(self, raw: np.ndarray, off: np.ndarray, separator: np.ndarray = _SPACE, fold: np.ndarray | None = None):
        inside = ~separator[raw]
        # a word never runs over the border between two texts
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        borders = off[1:-1]
        borders = borders[(borders > 0) & (borders < len(raw))]
        first[borders] = inside[borders]
        last[borders - 1] = inside[borders - 1]
        self.raw, self.off = raw, off
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.doc = np.searchsorted(off, self.start, side="right") - 1
        #: Word range of text i: bounds[i] to bounds[i + 1].
        self.bounds = np.searchsorted(self.doc, np.arange(len(off)))
        length = self.end - self.start
        if len(self.start):
            at = np.flatnonzero(inside)
            base = np.repeat(np.cumsum(length) - length, length)
            chars = (raw if fold is None else fold[raw])[at].astype(np.uint64) + np.uint64(1)
            with np.errstate(over="ignore"):
                chars *= _powers(int(length.max()))[np.arange(len(at)) - base]
            self.hash = mix(np.add.reduceat(chars, np.cumsum(length) - length))
        else:
            self.hash = np.zeros(0, np.uint64)

    def __len__(self) -> int:
        return len(self.start)


_STEP = np.uint64(0xD6E8FEB86659FD93)


def windows(words: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``size`` consecutive words within one text, and the index of its first word."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        h = words[:n].copy()
        for j in range(1, size):
            h = h * _STEP + words[j : j + n]
    at = np.flatnonzero(doc[:n] == doc[size - 1 :])
    return mix(h[at]), at


def signed(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h).view(np.int64)


def ragged(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and the length of each list."""
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))
