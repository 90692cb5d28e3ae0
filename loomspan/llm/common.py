"""What the operators share: tables, written intermediate results and byte-level hashing of Arrow text."""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that a numpy kernel hashes at once; a longer text is hashed alone.
CHUNK_BYTES = 1 << 19
#: Rows of an Arrow batch: what a Python worker and the JVM hold of a task's input at once.
ARROW_ROWS = 500
#: Rows that a Parquet reader decodes at once: with texts, the usual 4096 are arrays of many megabytes, made anew for each task.
READ_ROWS = 512
#: Bytes of file lists that Spark remembers on the driver.
FILE_LISTS = "spark.sql.hive.filesourcePartitionFileCacheSize"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which all executors share; on a single machine, where it is unset, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir isn't set: name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='loomspan-')}"
    return found.rstrip("/")


@contextlib.contextmanager
def small_batches(spark: SparkSession):
    """While a result is written, Arrow's and the Parquet reader's batches are small: texts are long, and the usual numbers of
    rows would fill an executor.

    The session has its own settings again afterwards.
    """
    with _at_most(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": ARROW_ROWS, "spark.sql.parquet.columnarReaderBatchSize": READ_ROWS}):
        yield


@contextlib.contextmanager
def _at_most(spark: SparkSession, settings: dict[str, int]):
    """Within it the session's settings are lowered to these bounds. A session's own zero or less (no bound) is replaced too."""
    own = {key: spark.conf.get(key) for key in settings}
    for key, most in settings.items():
        if not min(most, 1) <= int(own[key]) <= most:
            spark.conf.set(key, most)
    try:
        yield
    finally:
        for key, value in own.items():
            spark.conf.set(key, value)


class Scratch:
    """Written intermediate tables. They cut lineage and survive lost executors; ``drop`` frees one that is used up."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.n = 0

    def keep(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
        path = self.path(name)
        # no marker of success: a failed write raises, and each file that the driver makes on a local disk starts processes there
        writer = df.write.option("compression", "zstd").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
        with small_batches(self.spark):
            (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        # Spark's cache of file lists never finds this table again, and keeps up to 250 MB of such lists on the driver's heap
        with _at_most(self.spark, {FILE_LISTS: 0}):
            return self.spark.read.schema(df.schema).parquet(path)

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def drop(self, df: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if self.root.split("://")[-1].lstrip("/") in folder:
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(conf).delete(path, True)


_MULT = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= _STEP
    x ^= x >> np.uint64(32)
    x *= _STEP
    x ^= x >> np.uint64(32)
    return x


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Keys of the independent hashes of spans, and masks of a word's last bytes.
_KEYS = mix(np.arange(1, 5, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(8)], np.uint64)
#: Longer spans are hashed one by one.
_LONG = 64


def text_chunks(column: pa.Array | pa.ChunkedArray, chunk_bytes: int = CHUNK_BYTES):
    """(first row, bytes, row offsets) of runs of rows of at most ``chunk_bytes``, or of one longer row. Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + chunk_bytes, side="right")) - 1
        to = min(n, max(to, at + 1))
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def words(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word ``[^\\x20\\x09-\\x0D]+``; a row's end ends a word."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    inside = ~_SPACE[data]
    first = np.zeros(len(data), bool)
    first[rows[:-1][rows[:-1] < len(data)]] = True
    starts = np.flatnonzero(inside & (first | ~np.concatenate(([False], inside[:-1]))))
    last = np.concatenate((first[1:], [True]))
    ends = np.flatnonzero(inside & (last | ~np.concatenate((inside[1:], [False])))) + 1
    return starts, ends, np.searchsorted(rows, starts, side="right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: int = 0) -> np.ndarray:
    """64-bit keyed hash of each span of bytes; different ``key`` (0 or 1) give independent hashes.

    Eight bytes go in at a time, each time through a bijection that isn't linear, so no two spans of up to eight bytes and
    of one length collide, and longer ones do only by chance. Long spans have a cryptographic hash.
    """
    left, at = ends - starts, starts.copy()
    with np.errstate(over="ignore"):
        out = mix(left.astype(np.uint64) * _STEP + _KEYS[key])
        words_ = np.ndarray(len(data) + 1, "<u8", np.concatenate((data, np.zeros(8, np.uint8))), strides=(1,))
        live = np.flatnonzero((left > 0) & (left <= _LONG))
        while len(live):
            part = words_[at[live]]
            short = left[live] < 8
            part[short] &= _MASKS[left[live][short]]
            out[live] = mix((out[live] * _MULT) ^ mix(part + _KEYS[2 + key]))
            left[live] -= 8
            at[live] += 8
            live = live[left[live] > 0]
    for i in np.flatnonzero(ends - starts > _LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, salt=bytes([key])).digest(), "little")
    return out


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def ngram_hashes(word_hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive words; the caller drops runs that cross rows."""
    if len(word_hashes) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(len(word_hashes) - n + 1, np.uint64)
        for i in range(n):
            out = (out ^ (out >> np.uint64(29))) * _MULT + word_hashes[i : len(word_hashes) - n + 1 + i]
        return mix(out)


def released(run):
    """A kernel that gives its worker's free memory back when its task ends: the next task may be another operator's."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # the C library is another one
        ctypes.CDLL(None).malloc_trim(0)
