"""Media columns in archives: a Spark data source that reads members by byte range.

Method: payloads (a text's bytes, padded with zeros to rows of WIDTH) are stored losslessly as 8-bit
grey PNG images, the unpadded length in a text chunk, inside ZIP archives of ARCHIVE_BYTES or less in
one directory. ``ArchiveSource`` plans partitions of RANGE_BYTES over the archives from their sizes
alone; a reader takes the members whose headers begin in its range, by the archive's central
directory, and streams them in Arrow batches. A range's members are read at once and checked against
their CRCs; one that is damaged, or all if that read fails, is read ATTEMPTS times on its own, by its
offset; one that still fails is a row with its error. Beyond MOST_RANGES ranges they are longer instead.

Recovery: an archive is put in place whole under a name fixed by its task, so a task that runs again
replaces its own archives, removes what an attempt before it has written beyond them, and touches nothing else. Files are reached through pyarrow's file systems (file,
hdfs, s3, gs), so the directory must be one that driver and executors share.

Cases: null is the empty text, stored as one row of zeros; very long texts are one member each; equal
texts give equal media; a null doc_id stays null; repeated rows are members of their own; an empty table
leaves an empty directory; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import io
import struct
import time
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillforge.llm import kernels as K
from quillforge.llm.shared import bound_arrow, fresh_path

WIDTH = 64
ARCHIVE_BYTES = 32 << 20
RANGE_BYTES, MOST_RANGES = 8 << 20, 200_000
BATCH_BYTES = 2 << 20
ATTEMPTS = 4
_MAGIC = b"\x89PNG\r\n\x1a\n"


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """pyarrow's file system and path for a URI or a plain path."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(raw: bytes) -> bytes:
    """The bytes as samples of a grey image, rows of WIDTH, the last one filled up with zeros."""
    height = max(1, -(-len(raw) // WIDTH))
    lines = np.zeros((height, WIDTH + 1), np.uint8)
    flat = np.zeros(height * WIDTH, np.uint8)
    flat[: len(raw)] = np.frombuffer(raw, np.uint8)
    lines[:, 1:] = flat.reshape(height, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, height, 8, 0, 0, 0, 0)
    return _MAGIC + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"Length\0" + str(len(raw)).encode()) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> tuple[bytes, int]:
    """(payload, unpadded length) of an image of ``to_png``."""
    if not media.startswith(_MAGIC):
        raise ValueError("not an image")
    at, body, length, size = len(_MAGIC), [], 0, (0, 0)
    while at < len(media):
        n, kind = struct.unpack_from(">I4s", media, at)
        own = media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + own) != struct.unpack_from(">I", media, at + 8 + n)[0]:
            raise ValueError(f"chunk {kind!r} is damaged")
        if kind == b"IHDR":
            size = struct.unpack_from(">II", own)
        elif kind == b"tEXt" and own.startswith(b"Length\0"):
            length = int(own[7:])
        elif kind == b"IDAT":
            body.append(own)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(size[1], size[0] + 1)
    if lines[:, 0].any():
        raise ValueError("a filtered image")
    return np.ascontiguousarray(lines[:, 1:]).tobytes(), length


def _put(directory: str, name: str, data: bytes) -> None:
    """Write a whole file under a name of this attempt's own, then move it into place."""
    system, path = file_system(directory)
    context = TaskContext.get()
    draft = f"{path}/_draft-{context.taskAttemptId() if context else 0}-{name}"
    with system.open_output_stream(draft) as out:
        out.write(data)
    system.move(draft, f"{path}/{name}")


def _write(directory: str):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        buffer = io.BytesIO()
        archive = zipfile.ZipFile(buffer, "w", zipfile.ZIP_STORED)
        names, counts = [], []

        def close() -> None:
            nonlocal buffer, archive, made
            archive.close()
            if archive.infolist():
                names.append(f"part-{task:06d}-{made:05d}.zip")
                counts.append(len(archive.infolist()))
                _put(directory, names[-1], buffer.getvalue())
                made += 1
            buffer = io.BytesIO()
            archive = zipfile.ZipFile(buffer, "w", zipfile.ZIP_STORED)

        for batch in batches:
            data, offsets = K.buffers(batch.column("text"))
            for r, doc in enumerate(batch.column("doc_id").to_pylist()):
                info = zipfile.ZipInfo(f"{len(archive.infolist()):07d}/{'null' if doc is None else doc}.png")
                archive.writestr(info, to_png(data[offsets[r] : offsets[r + 1]].tobytes()))
                if buffer.tell() >= ARCHIVE_BYTES:
                    close()
        close()
        system, path = file_system(directory)
        while system.get_file_info(old := f"{path}/part-{task:06d}-{made:05d}.zip").is_file:
            system.delete_file(old)
            made += 1
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())], names=["archive", "members"])

    return run


def store(docs: DataFrame, directory: str) -> int:
    """Write the texts of ``docs`` (doc_id, text) as media into archives; how many there are now."""
    bound_arrow(docs.sparkSession)
    system, path = file_system(directory)
    system.create_dir(path, recursive=True)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(_write(directory), "archive string, members long").agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0]


class ByteRange(InputPartition):
    def __init__(self, path: str, start: int, end: int) -> None:
        super().__init__((path, start, end))


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.directory = options["path"]
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.pause = float(options.get("pause", 0.2))

    def partitions(self) -> list[ByteRange]:
        system, path = file_system(self.directory)
        found = [f for f in system.get_file_info(fs.FileSelector(path)) if f.is_file and f.extension == "zip" and not f.base_name.startswith("_")]
        step = max(self.range_bytes, sum(f.size for f in found) // MOST_RANGES)
        return [ByteRange(f.path, at, min(at + step, f.size)) for f in sorted(found, key=lambda f: f.path) for at in range(0, f.size, step)]

    @staticmethod
    def _at_once(own: pa.NativeFile, members: list[zipfile.ZipInfo]) -> dict[int, bytes]:
        """The sound members by offset, from one read; none if it fails."""
        if not members:
            return {}
        first, last = members[0].header_offset, members[-1]
        try:
            own.seek(first)
            # The last member's local header is as long as its name and some extra fields.
            whole = memoryview(own.read(last.header_offset - first + 30 + len(last.filename.encode()) + 4096 + last.compress_size))
        except OSError:
            return {}
        out = {}
        for info in members:
            at = info.header_offset - first
            if bytes(whole[at : at + 4]) == b"PK\3\4" and len(whole) >= at + 30:
                start = at + 30 + sum(struct.unpack_from("<HH", whole, at + 26))
                data = bytes(whole[start : start + info.compress_size])
                if len(data) == info.compress_size and zlib.crc32(data) == info.CRC:
                    out[info.header_offset] = data
        return out

    def _member(self, system: fs.FileSystem, path: str, info: zipfile.ZipInfo) -> bytes:
        """One member's bytes, from its header's offset; a failed read is tried again from there."""
        for attempt in range(ATTEMPTS):
            try:
                with system.open_input_file(path) as own:
                    own.seek(info.header_offset)
                    head = own.read(30)
                    if head[:4] != b"PK\3\4":
                        raise OSError(f"no member at {info.header_offset}")
                    own.seek(info.header_offset + 30 + sum(struct.unpack_from("<HH", head, 26)))
                    data = own.read(info.compress_size)
                if len(data) != info.compress_size or zlib.crc32(data) != info.CRC:
                    raise OSError(f"member at {info.header_offset} is damaged")
                return data
            except OSError:
                if attempt + 1 == ATTEMPTS:
                    raise
                time.sleep(self.pause * 2**attempt)
        raise AssertionError

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark passes when there is nothing to plan
            return
        path, start, end = partition.value
        system, _ = file_system(self.directory)
        with system.open_input_file(path) as own, zipfile.ZipFile(own) as archive:
            members = sorted((m for m in archive.infolist() if start <= m.header_offset < end), key=lambda m: m.header_offset)
            sound = self._at_once(own, members)
        rows: list[tuple] = []
        size = 0
        for info in members:
            try:
                data, error = sound.pop(info.header_offset, None) or self._member(system, path, info), None
            except OSError as e:
                data, error = None, str(e)
            rows.append((path.rsplit("/", 1)[-1], info.header_offset, info.filename, data, error))
            size += len(data or b"")
            if size >= BATCH_BYTES:
                yield self._batch(rows)
                rows, size = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["archive", "offset", "name", "media", "error"])


class ArchiveSource(DataSource):
    """Rows (archive, offset, name, media, error) of all members under option ``path``."""

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return "archive string, offset long, name string, media binary, error string"

    def reader(self, schema) -> ArchiveReader:  # noqa: ANN001
        return ArchiveReader(dict(self.options))


def members(spark: SparkSession, directory: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    bound_arrow(spark)
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("media_archives").option("rangebytes", str(range_bytes)).load(directory)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for name, media, error in zip(*(batch.column(c).to_pylist() for c in ("name", "media", "error")), strict=True):
            if error:
                raise OSError(f"{name}: {error}")
            payload, n = from_png(media)
            doc = name.split("/")[1].removesuffix(".png")
            samples = np.frombuffer(payload, np.uint8)
            bins = np.bincount(samples >> 5, minlength=8)
            feature = f"{WIDTH}x{len(payload) // WIDTH} sum {int(samples.sum(dtype=np.int64))} min {samples.min()} max {samples.max()} bins {' '.join(map(str, bins.tolist()))}"
            rows.append((None if doc == "null" else int(doc), n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature))
        if rows:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def features(media: DataFrame) -> DataFrame:
    """doc_id, sizes, digests and sample features of each of ``members``; a member's error is raised."""
    return media.select("name", "media", "error").mapInArrow(
        _features, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )


def stored_features(docs: DataFrame, directory: str | None = None) -> DataFrame:
    """Store the texts of ``docs`` under ``directory`` (a new one by default), read them back, and describe them."""
    spark = docs.sparkSession
    directory = directory or fresh_path(spark, "media")
    store(docs, directory)
    return features(members(spark, directory))
