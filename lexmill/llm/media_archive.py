"""Media columns: a Spark data source over archive directories.

The writer stores media as members of ZIP archives of bounded size, one or more for each task, and
commits a list of the archives, so that those of failed or repeated tasks are never read. The
reader plans byte ranges over the archives from their sizes alone; a task reads its archive's
directory and takes the members whose offset lies in its range. Members are streamed as Arrow
batches of bounded size. A member whose bytes cannot be read or fail their checksum is retried by
its offset, with a new handle, without reading its neighbours again; after the last try the read
fails, or, with option onError=null, the row stays with null media.

Ranges grow with the store, so that the planner lists no more than MOST_RANGES and one for each archive.

Defined cases: doc_ids are integers; a null text is empty (one row of 64 zero samples); repeated rows are members of their
own; a null doc_id is kept; an empty table gives an empty folder that reads as no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .shared import fresh_dir, table, texts

WIDTH = 64
ARCHIVE_BYTES = 32 << 20
RANGE_BYTES = 8 << 20
MOST_RANGES = 200_000
BATCH_BYTES = 4 << 20
BATCH_ROWS = 2000
TRIES = 4


def to_png(payload: bytes) -> bytes:
    """Bytes as 8-bit grey samples of a PNG image, WIDTH to a row; a positive multiple of WIDTH."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    raw = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each row begins with its filter, none
    raw[:, 1:] = rows

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw.tobytes(), 6)) + chunk(b"IEND", b"")


def samples(png: bytes) -> np.ndarray:
    """The samples of such an image, rows by WIDTH; every chunk's checksum is verified."""
    at, data, shape = 8, [], None
    while at < len(png):
        size, kind = struct.unpack(">I4s", png[at : at + 8])
        body = png[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack(">I", png[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("a chunk of the image fails its checksum")
        if kind == b"IHDR":
            shape = struct.unpack(">II", body[:8])
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(shape[1], shape[0] + 1)
    if rows[:, 0].any():
        raise ValueError("only images without row filters are read")
    return rows[:, 1:]


def feature(rows: np.ndarray) -> str:
    """Mean, deviation, entropy and mean step between neighbours of the samples."""
    count = np.bincount(rows.ravel(), minlength=256)
    p = count[count > 0] / rows.size
    step = np.abs(np.diff(rows.astype(np.int16), axis=1)).mean()
    values = np.arange(256)
    mean = (count * values).sum() / rows.size
    dev = np.sqrt((count * (values - mean) ** 2).sum() / rows.size)
    return f"mean={mean:.4f};dev={dev:.4f};entropy={-(p * np.log2(p)).sum():.4f};step={step:.4f}"


@dataclass
class ArchiveRange(InputPartition):
    path: str
    start: int
    end: int


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class MemberArchive(DataSource):
    """format("member_archive"): columns archive, offset, name, media."""

    @classmethod
    def name(cls) -> str:
        return "member_archive"

    def schema(self) -> str:
        return "archive string, offset bigint, name string, media binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArchiveReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return ArchiveWriter(dict(self.options))


class ArchiveWriter(DataSourceArrowWriter):
    """Rows of name and media; other columns are not taken."""

    def __init__(self, options: dict):
        self.path, self.limit = options["path"], int(options.get("archiveBytes", ARCHIVE_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = pafs.FileSystem.from_uri(self.path)
        store.create_dir(root, recursive=True)
        names: list[str] = []
        buffer, archive = io.BytesIO(), None

        def close() -> None:
            nonlocal buffer, archive
            archive.close()
            names.append(f"{uuid.uuid4().hex}.zip")
            with store.open_output_stream(f"{root}/{names[-1]}") as out:
                out.write(buffer.getvalue())
            buffer, archive = io.BytesIO(), None

        for b in iterator:
            for name, media in zip(b.column("name").to_pylist(), b.column("media").to_pylist()):
                archive = archive or zipfile.ZipFile(buffer, "w", zipfile.ZIP_STORED)
                archive.writestr(zipfile.ZipInfo(name), media)
                if buffer.tell() >= self.limit:
                    close()
        if archive:
            close()
        return Written(names)

    def commit(self, messages) -> None:
        store, root = pafs.FileSystem.from_uri(self.path)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/archives-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps([n for m in messages if m for n in m.names]).encode())

    def abort(self, messages) -> None:
        store, root = pafs.FileSystem.from_uri(self.path)
        for m in messages:
            for n in m.names if m else []:
                store.delete_file(f"{root}/{n}")


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.options = options["path"], options

    def partitions(self) -> list[ArchiveRange]:
        """Ranges from names and sizes only."""
        store, root = pafs.FileSystem.from_uri(self.path)
        files = {f.base_name: f for f in store.get_file_info(pafs.FileSelector(root, allow_not_found=True))}
        names = []
        for n in sorted(files):
            if n.startswith("archives-"):
                with store.open_input_stream(files[n].path) as f:
                    names += json.loads(f.read())
        total = sum(files[n].size for n in names)
        step = int(self.options.get("rangeBytes", max(RANGE_BYTES, -(-total // MOST_RANGES))))  # the driver's list stays bounded
        return [ArchiveRange(files[n].path, at, at + step) for n in names for at in range(0, files[n].size, step)] or [ArchiveRange("", 0, 0)]

    def read(self, partition: ArchiveRange) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        store, _ = pafs.FileSystem.from_uri(self.path)
        null, rows, size = self.options.get("onError", "fail") == "null", [], 0
        with store.open_input_file(partition.path) as f:
            with zipfile.ZipFile(f) as archive:
                members = [i for i in archive.infolist() if partition.start <= i.header_offset < partition.end]
            for m in members:
                rows.append((partition.path, m.header_offset, m.filename, fetch(store, partition.path, f, m, null)))
                size += m.file_size
                if size >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                    yield _batch(rows)
                    rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["archive", "offset", "name", "media"])


def fetch(store, path: str, handle, member: zipfile.ZipInfo, null: bool = False, tries: int = TRIES, pause: float = 0.05):
    """One member's bytes by its offset; from the second try on with a handle of its own."""
    for k in range(tries):
        try:
            if k == 0:
                return _stored(handle, member)
            with store.open_input_file(path) as own:
                return _stored(own, member)
        except (OSError, ValueError, struct.error):
            if k + 1 == tries:
                if null:
                    return None
                raise
            time.sleep(pause * 2**k)


def _stored(handle, member: zipfile.ZipInfo) -> bytes:
    handle.seek(member.header_offset)
    head = handle.read(30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError(f"{member.filename}: no member at offset {member.header_offset}")
    name, extra = struct.unpack("<HH", head[26:30])
    body = handle.read(name + extra + member.file_size)[name + extra :]
    if len(body) != member.file_size or zlib.crc32(body) != member.CRC:
        raise ValueError(f"{member.filename}: its bytes fail the checksum")
    return body


def write_images(docs: DataFrame, path: str) -> None:
    """Each text's UTF-8 bytes, padded with zeros, as an image named doc_id.n_bytes.png."""
    d = texts(docs)
    d.sparkSession.dataSource.register(MemberArchive)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BATCH_ROWS):
                some = b.slice(at, BATCH_ROWS)
                raw = some.column(1).cast(pa.binary()).to_pylist()
                png = [to_png(x + bytes(-len(x) % WIDTH or (0 if x else WIDTH))) for x in raw]
                names = [f"{'' if i is None else i}.{len(x)}.png" for i, x in zip(some.column(0).to_pylist(), raw)]
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(png, pa.binary())], names=["name", "media"])

    d.mapInArrow(run, "name string, media binary").write.format("member_archive").mode("append").save(path)


def read_media(spark, path: str, **options) -> DataFrame:
    spark.dataSource.register(MemberArchive)
    return spark.read.format("member_archive").options(**options).load(path)


def op2_media_archive(spark, sf_dir: str) -> DataFrame:
    path = fresh_dir(spark, "media")
    write_images(table(spark, sf_dir, "documents"), path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for name, media in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                doc_id, n, _ = name.split(".")
                image = samples(media)
                payload = image.tobytes()
                rows.append((
                    int(doc_id) if doc_id else None, int(n), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]),
                    len(media), hashlib.sha256(media).hexdigest(), feature(image),
                ))
            if rows:
                i, s = pa.int64(), pa.string()
                cols = [pa.array(c, k) for c, k in zip(zip(*rows), (i, i, i, s, i, i, s, s))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return read_media(spark, path).select("name", "media").mapInArrow(
        run,
        "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    )
