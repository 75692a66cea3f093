"""Shared pieces: table access, scratch tables, and vectorised word hashing over Arrow text."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one vectorised step takes at once; a longer single document is one step.
STEP_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """Texts are long: at most ``rows`` of them travel to a Python worker at once, which bounds
    the Arrow buffers on both sides.  A smaller setting of the session stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(df.sparkSession.conf.get(name)) > rows:
        df.sparkSession.conf.set(name, str(rows))
    return df


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir; under a local one only where that is unset and all of Spark is on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        import tempfile

        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="thawline-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/thawline-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession) -> None:
    """Deletes all scratch tables of this application; frames that rest on them can't be read any more."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/thawline-{spark.sparkContext.applicationId}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stash(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared scratch folder and read it back: lineage ends here.

    The schema is passed on as it is, so an empty table stays readable.
    """
    spark = df.sparkSession
    path = scratch_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalising 64-bit mixer (xor-shift-multiply); works in place on a copy."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two neighbouring hashes, in this order."""
    return mix64(mix64(a + _LEFT) ^ (b * _RIGHT))


_LEFT, _RIGHT, _SIZE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
#: For a block that holds n more bytes of a span: the bits that count.
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Spans beyond so many bytes are hashed one by one.
LONG_SPAN = 64


def byte_hash(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of raw[start:end] for every span: its length, then blocks of eight bytes, each mixed in turn.  Spans
    of up to eight bytes and equal length never collide.  Another ``seed`` gives an independent hash."""
    size = ends - starts
    out = mix64(size.astype(np.uint64) * _SIZE + mix64(np.array([seed + 1], np.uint64)))
    blocks = np.lib.stride_tricks.sliding_window_view(np.concatenate([raw, np.zeros(8, np.uint8)]), 8)
    live = np.flatnonzero((size > 0) & (size <= LONG_SPAN))
    done = 0
    while len(live):
        block = blocks[starts[live] + done].view(np.uint64)[:, 0] & _MASKS[np.minimum(size[live] - done, 8)]
        out[live] = mix64((out[live] ^ block) + _LEFT)
        done += 8
        live = live[size[live] > done]
    for i in np.flatnonzero(size > LONG_SPAN).tolist():
        out[i] ^= np.uint64(xxhash.xxh3_64_intdigest(raw[starts[i] : ends[i]], seed))
    return out


def run_hash(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n consecutive hashes, by doubling: a run of twice the length is two runs, and the last step
    joins two that overlap."""
    at, length = hashes, 1
    while 2 * length <= n:
        at = _paired(at[: max(len(at) - length, 0)], at[length:])
        length *= 2
    if length < n:
        at = _paired(at[: max(len(at) - (n - length), 0)], at[n - length :])
    return mix64(at ^ np.uint64((n * int(_SIZE)) % (1 << 64)))


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n+1 offsets of its rows; null is an empty text."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, and after the last one unused Arrow memory goes back: workers outlive their tasks."""
    yield from batches
    pa.default_memory_pool().release_unused()


def steps(batch: pa.RecordBatch, column: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of whole rows of about ``limit`` bytes of text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = np.cumsum(sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


class Words:
    """The words [^\\x20\\x09-\\x0D]+ of a text column: byte spans, and which words belong to which row."""

    def __init__(self, column: pa.Array, fold: bool = False) -> None:
        raw, self.offsets = texts_of(column)
        if fold:  # A-Z only
            raw = raw + (((raw >= 65) & (raw <= 90)) * np.uint8(32))
        self.raw = raw
        word = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
        edge = np.zeros(len(raw) + 1, bool)
        edge[self.offsets] = True
        before = np.concatenate([[False], word[:-1]]) if len(raw) else word
        after = np.concatenate([word[1:], [False]]) if len(raw) else word
        self.starts = np.flatnonzero(word & (~before | edge[:-1]))
        self.ends = np.flatnonzero(word & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, self.offsets)  # words of row i: first[i]:first[i+1]
        self.counts = np.diff(self.first)
        self.known: dict[int, np.ndarray] = {}

    def hashes(self, seed: int = 0) -> np.ndarray:
        if seed not in self.known:
            self.known[seed] = byte_hash(self.raw, self.starts, self.ends, seed)
        return self.known[seed]

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of all runs of n words that stay in one row, and the rows."""
        row = self.row()
        if len(row) < n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(row[: len(row) - n + 1] == row[n - 1 :])
        return at, row[at]


def longs(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64), pa.int64())


def map_rows(docs: DataFrame, make, fields: str, keep: list[str], column: str = "text") -> DataFrame:
    """``docs[keep]`` with new columns beside them, row by row and without a shuffle.

    ``make()`` runs once in each task and returns a function from a batch to the list of new
    columns, in the order of the DDL string ``fields``.  ``column`` is the text that steps are cut by.
    """
    from pyspark.sql import types as T

    taken = list(dict.fromkeys([*keep, column]))
    docs = small_batches(docs).select(*taken)
    new = T.StructType.fromDDL(fields)
    if clash := {f.name for f in new} & set(keep):
        raise ValueError(f"columns are there already: {sorted(clash)}")
    schema = T.StructType([docs.schema[c] for c in keep] + list(new))
    names, order = [f.name for f in schema], list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in tidy(batches):
            for step in steps(batch, column):
                yield pa.RecordBatch.from_arrays([*(step.column(c) for c in order), *work(step)], names)

    return docs.mapInArrow(run, schema)


def strings(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return pc.fill_null(batch.column(column), "").to_pylist()
