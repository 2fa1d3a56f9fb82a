"""Helpers that the training-data operators share: shared storage, Arrow text buffers, word hashes."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # not glibc
    _TRIM = None

#: Bytes of text that one NumPy pass handles; a longer text is a pass of its own.
PASS_BYTES = 1 << 20

#: Bytes that separate words: space and the controls 0x09 to 0x0D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Lower case of ASCII letters; every other byte stays.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.default_rng(20240229)
#: A random odd number for each byte value, and the multiplier of polynomial hashes modulo 2^64.
BYTE_CODE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MULT = np.uint64(0x9E3779B97F4A7C15)


# --- storage that every executor and the driver see ---------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder in spark.checkpoint.dir; where that is unset, a new one in a local session and an error in others."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='boxtrail-')}"
        spark.sparkContext.setCheckpointDir(base)
    return base if "://" in base or not base.startswith("/") else f"file://{base}"


def scratch_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of rows that a row group of stored() takes.
GROUP_BYTES = 4 << 20


def stored(df: DataFrame, what: str, made: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None, schema: str | None = None) -> DataFrame:
    """written(), or what made() turns df's batches into (of this schema), by Python workers where the shared folder is a local path.
    Without its native library Hadoop starts a chmod for each folder and file of a local path, and until such a child is a program of
    its own it counts with all memory of the executor. A file gets its name from the driver once its task has ended."""
    spark = df.sparkSession
    local = re.fullmatch(r"file:(?://)?(/(?!/).*)", path := scratch_path(spark, what))
    if local is None:
        return written(df if made is None else df.mapInArrow(made, schema), what)
    kind = df.schema if made is None else StructType.fromDDL(schema)
    folder = local[1]
    os.makedirs(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, writer, waiting, size = uuid.uuid4().hex, None, [], 0
        try:
            for batch in batches if made is None else made(batches):
                if batch.num_rows:
                    if writer is None:
                        writer = pq.ParquetWriter(f"{folder}/_{name}", batch.schema)
                    waiting.append(batch)
                    size += batch.nbytes
                if size >= GROUP_BYTES:
                    writer.write_table(pa.Table.from_batches(waiting))
                    waiting, size = [], 0
                    del batch
                    tidy()
            if waiting:
                writer.write_table(pa.Table.from_batches(waiting))
        finally:
            if writer is not None:
                writer.close()
        del waiting
        tidy()
        yield pa.RecordBatch.from_arrays([pa.array([name] if writer is not None else [], pa.string())], ["name"])

    names = [r.name for r in df.mapInArrow(run, "name string").collect()]
    for name in names:
        os.rename(f"{folder}/_{name}", f"{folder}/{name}.parquet")
    if not names:
        pq.write_table(to_arrow_schema(kind).empty_table(), f"{folder}/none.parquet")
    return spark.read.schema(kind).parquet(path)


def drop_written(*tables: DataFrame) -> None:
    """Deletes the files of tables made by written() or stored(), once nothing reads them any more."""
    for df in tables:
        spark = df.sparkSession
        jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        base = shared_dir(spark).removeprefix("file://").rstrip("/")
        for folder in {os.path.dirname(f) for f in df.inputFiles()}:
            if base in folder:
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(conf).delete(path, True)


def free_name(columns: list[str], base: str) -> str:
    """base, with as many underscores before it as keep it apart from the columns."""
    taken = {c.lower() for c in columns}
    while base.lower() in taken:
        base = f"_{base}"
    return base


#: Rows of an Arrow batch: whole texts, so that a batch is tens of MB at most for common lengths.
BATCH_ROWS = 4000


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches, unless they are smaller already."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out(doc_id: str, modulus: int):
    """Whether crc32 of the id as text leaves 0; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus == 0, F.lit(False))


def shards(spark: SparkSession, weight: float, each: float) -> int:
    """Partitions for a shuffle of so much weight, from the session's default upwards."""
    return int(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-weight // each)))


def tidy() -> None:
    """Gives the memory of a finished batch back to the system: a Python worker lives on between tasks and stages, and
    what its allocators keep counts against the executor."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


# --- text buffers -------------------------------------------------------------------------------


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column and the offsets of its rows; null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32, len(column) + 1 + column.offset)[column.offset :].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def passes(offsets: np.ndarray, limit: int = PASS_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [i, j) of at most limit bytes, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (finaliser of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_KEYS = [np.zeros(0, np.uint64)]


def place_keys(n: int) -> np.ndarray:
    """A number for each place in a string, with no relation between them: sums of byte codes times these (a multilinear
    hash) tell strings apart whatever their pattern, which polynomials modulo 2^64 don't (Thue-Morse words)."""
    if len(_KEYS[0]) < n:
        _KEYS[0] = mix(np.arange(1, max(n, 4096) + 1, dtype=np.uint64) * MULT)
    return _KEYS[0][:n]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows, and the row of each. Words don't cross rows."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    solid = ~IS_SPACE[data]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    inner = offsets[1:-1]
    inner = inner[inner < len(data)]
    begin[inner] = solid[inner]
    end = solid.copy()
    end[:-1] &= ~solid[1:]
    before = inner[inner > 0] - 1
    end[before] = solid[before]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the lower-cased words."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    code = BYTE_CODE[LOWER[data]]
    # a byte's place in its word: counted over the gaps too, which then weigh nothing
    first = np.repeat(starts, np.diff(np.append(starts, len(data))))
    place = np.arange(starts[0], len(data)) - first
    inside = place < np.repeat(lens, np.diff(np.append(starts, len(data))))
    place[~inside] = 0
    code = code[starts[0] :] * place_keys(int(lens.max()))[place]
    code[~inside] = 0
    return mix(np.add.reduceat(code, starts - starts[0]) + lens.astype(np.uint64))


def shingles(hashes: np.ndarray, row: np.ndarray, n_rows: int, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles and their rows; a row with 1 to k-1 words has its whole sequence as one."""
    count = np.bincount(row, minlength=n_rows)
    out_h, out_r = [], []
    if len(hashes) >= k:
        h = np.zeros(len(hashes) - k + 1, np.uint64)
        for i in range(k):
            h = mix(h * MULT + hashes[i : len(hashes) - k + 1 + i] + np.uint64(i + 1))
        whole = row[: len(h)] == row[k - 1 :]
        out_h.append(h[whole])
        out_r.append(row[: len(h)][whole])
    first = np.concatenate(([0], np.cumsum(count)))
    for i in np.flatnonzero((count > 0) & (count < k)):
        h = np.uint64(count[i])
        with np.errstate(over="ignore"):
            for x in hashes[first[i] : first[i + 1]]:
                h = mix(np.array([h * MULT + x], np.uint64))[0]
        out_h.append(np.array([h], np.uint64))
        out_r.append(np.array([i]))
    if not out_h:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h, r = np.concatenate(out_h), np.concatenate(out_r)
    order = np.argsort(r, kind="stable")
    return h[order], r[order]


def rolling(data: np.ndarray, q: int) -> np.ndarray:
    """Polynomial hashes of all stretches of q bytes, put together from those of powers of two."""
    if len(data) < q:
        return np.zeros(0, np.uint64)
    block, size, factor = BYTE_CODE[data], 1, MULT
    out, done = None, 0
    while q:
        if q & 1:
            if out is None:
                out = block
            else:
                n = len(data) - done - size + 1
                out = out[:n] * factor + block[done : done + n]
            done += size
        q >>= 1
        if q:
            block = block[:-size] * factor + block[size:]
            factor = np.uint64(pow(int(factor), 2, 1 << 64))
            size *= 2
    return out
