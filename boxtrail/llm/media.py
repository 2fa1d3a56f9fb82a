"""Media columns: payloads stored losslessly as pictures in archives, and a Spark data source that reads them.

Writing: every text's UTF-8 bytes, padded with blanks to a positive multiple of 192, become the samples of an
RGB picture of 64 pixels by row (PNG, 8 bits a sample). Each task streams its pictures, uncompressed again, into
ZIP archives of about `archive_bytes` in the shared folder. The driver then writes a manifest with the archives of
the tasks that succeeded, so files of lost or repeated attempts are never read.

Reading: the data source plans byte ranges over the archives from their sizes alone, so the driver never holds a
list of members. A task reads the directory of its archive and then the members whose headers begin in its range,
one by one, by offset. A member that can't be read or fails its checksum is tried again on its own with the file
opened anew, `retries` times; then the task fails and Spark runs it elsewhere.

Null texts are empty; an empty text is one row of 192 blanks. Null ids and repeated rows are kept as they are; equal
texts give equal pictures. An empty table gives no archives and no rows. Only the named columns are read.
"""

from __future__ import annotations

import json
import struct
import time
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from boxtrail.llm.kit import scratch_path, utf8

#: Bytes in a picture's row: 64 pixels of three samples.
ROW = 192
PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"
MANIFEST = "_manifest.json"


# --- pictures -----------------------------------------------------------------------------------


def pad(raw: bytes) -> bytes:
    return raw + b" " * (-len(raw) % ROW if raw else ROW)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    plain = np.zeros((len(rows), ROW + 1), np.uint8)  # a filter byte of 0 begins each row
    plain[:, 1:] = rows
    return PNG_SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", ROW // 3, len(rows), 8, 2, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(plain.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_png(png: bytes) -> np.ndarray:
    """Samples as rows of ROW bytes, of a picture made by to_png."""
    if png[:8] != PNG_SIGNATURE:
        raise ValueError("not a PNG")
    at, size, body = 8, (0, 0), b""
    while at < len(png):
        (n,), kind = struct.unpack_from(">I", png, at), png[at + 4 : at + 8]
        if kind == b"IHDR":
            size = struct.unpack_from(">II", png, at + 8)
        elif kind == b"IDAT":
            body += png[at + 8 : at + 8 + n]
        at += 12 + n
    plain = np.frombuffer(zlib.decompress(body), np.uint8).reshape(size[1], -1)
    if plain[:, 0].any() or plain.shape[1] != size[0] * 3 + 1:
        raise ValueError("a picture of another kind")
    return plain[:, 1:]


def feature(samples: np.ndarray) -> str:
    """Mean, deviation and entropy of the samples, and the mean step between neighbouring rows."""
    count = np.bincount(samples.ravel(), minlength=256)
    share = count / count.sum()
    mean = float(share @ np.arange(256))
    dev = float(np.sqrt(max(share @ (np.arange(256) - mean) ** 2, 0)))
    p = share[share > 0]
    step = float(np.abs(np.diff(samples.astype(np.int16), axis=0)).mean()) if len(samples) > 1 else 0.0
    return f"{mean:.4f};{dev:.4f};{float(-(p * np.log2(p)).sum()):.4f};{step:.4f}"


# --- writing ------------------------------------------------------------------------------------


class _Stream:
    """A file that is only written onwards, so that zipfile needs no seeks."""

    def __init__(self, out):
        self.write, self.flush = out.write, lambda: None


def write_archives(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", archive_bytes: int = 128 << 20) -> int:
    """Stores all rows; the number of archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        task, names, archive, out, n, size = TaskContext.get(), [], None, None, 0, 0
        for batch in batches:
            data, at = utf8(batch.column(1))
            for i, doc in enumerate(batch.column(0).to_pylist()):
                if archive is None:
                    names.append(f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{len(names):03d}.zip")
                    out = fs.open_output_stream(f"{root}/{names[-1]}")
                    archive, size = zipfile.ZipFile(_Stream(out), "w", zipfile.ZIP_STORED), 0
                raw = data[at[i] : at[i + 1]].tobytes()
                png = to_png(pad(raw))
                archive.writestr(zipfile.ZipInfo(f"{n:010d}_{'' if doc is None else doc}_{len(raw)}.png"), png)
                n, size = n + 1, size + len(png)
                if size >= archive_bytes:
                    archive.close()
                    out.close()
                    archive = None
        if archive is not None:
            archive.close()
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([fs.get_file_info(f"{root}/{x}").size for x in names], pa.int64())], ["name", "size"])

    made = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "name string, size long").collect()
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/{MANIFEST}") as f:
        f.write(json.dumps([[r.name, r.size] for r in sorted(made)]).encode())
    return len(made)


# --- the data source ----------------------------------------------------------------------------


class ByteRange(InputPartition):
    def __init__(self, path: str, begin: int, end: int):
        self.path, self.begin, self.end = path, begin, end


class ArchiveReader(DataSourceReader):
    def __init__(self, options):
        self.folder = options["path"]
        self.step = int(options.get("partitionbytes", options.get("partitionBytes", 32 << 20)))
        self.batch = int(options.get("batchbytes", options.get("batchBytes", 8 << 20)))
        self.retries = int(options.get("retries", 3))

    def partitions(self) -> list[ByteRange]:
        fs, root = pafs.FileSystem.from_uri(self.folder)
        if fs.get_file_info(f"{root}/{MANIFEST}").type == pafs.FileType.File:
            with fs.open_input_stream(f"{root}/{MANIFEST}") as f:
                files = [(f"{root}/{name}", size) for name, size in json.loads(f.read())]
        else:
            files = [(x.path, x.size) for x in fs.get_file_info(pafs.FileSelector(root)) if x.path.endswith(".zip")]
        return [ByteRange(path, at, at + self.step) for path, size in sorted(files) for at in range(0, size, self.step)] or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, _ = pafs.FileSystem.from_uri(self.folder)
        with fs.open_input_file(partition.path) as f:
            members = [x for x in zipfile.ZipFile(f).infolist() if partition.begin <= x.header_offset < partition.end]
        rows: list[tuple] = []
        size, f = 0, None
        try:
            for x in sorted(members, key=lambda m: m.header_offset):
                f, payload = self._member(fs, partition.path, f, x)
                rows.append((partition.path, x.filename, x.header_offset, payload))
                size += len(payload)
                if size >= self.batch:
                    yield self._batch(rows)
                    rows, size = [], 0
            if rows:
                yield self._batch(rows)
        finally:
            if f is not None:
                f.close()

    def _member(self, fs, path: str, f, x: zipfile.ZipInfo):
        """One member by its offset, checked; the file is opened anew after a failure."""
        for attempt in range(self.retries + 1):
            try:
                f = f or fs.open_input_file(path)
                f.seek(x.header_offset)
                head = f.read(30)
                if head[:4] != b"PK\x03\x04":
                    raise OSError(f"no member at {x.header_offset} of {path}")
                name, extra = struct.unpack_from("<HH", head, 26)
                f.seek(name + extra, 1)
                payload = f.read(x.compress_size)
                if zlib.crc32(payload) != x.CRC:
                    raise OSError(f"{x.filename} of {path} has another checksum")
                return f, payload
            except OSError:
                if attempt == self.retries:
                    raise
                if f is not None:
                    f.close()
                f = None
                time.sleep(0.1 * 2**attempt)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        a, m, o, p = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(m, pa.string()), pa.array(o, pa.int64()), pa.array(p, pa.binary())], ["archive", "member", "offset", "payload"])


class MediaArchives(DataSource):
    """spark.read.format("media_archives").load(folder); options partitionBytes, batchBytes, retries."""

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return "archive string, member string, offset long, payload binary"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(dict(self.options))


def read_archives(spark: SparkSession, folder: str, partition_bytes: int = 32 << 20) -> DataFrame:
    spark.dataSource.register(MediaArchives)
    return spark.read.format("media_archives").option("partitionBytes", str(partition_bytes)).load(folder)


def features(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What the stored pictures hold: id, n_bytes (unpadded), payload (read back), media and feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                names = [m.removesuffix(".png").split("_") for m in part.column(0).to_pylist()]
                samples = [from_png(p) for p in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(x[1]) if x[1] else None for x in names], pa.int64()), pa.array([int(x[2]) for x in names], pa.int64()), pa.array([s.tobytes() for s in samples], pa.binary()), part.column(1), pa.array([feature(s) for s in samples], pa.string())],
                    [id_col, "n_bytes", "payload", "media", "feature"],
                )

    return media.select("member", "payload").mapInArrow(run, f"`{id_col}` long, n_bytes long, payload binary, media binary, feature string")


def store_and_read(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    spark = docs.sparkSession
    folder = scratch_path(spark, "media")
    write_archives(docs, folder, id_col, text_col)
    return features(read_archives(spark, folder), id_col)


def digest(read: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return read.select(
        id_col, "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.expr("substring(payload, -16, 16)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )
