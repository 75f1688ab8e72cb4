"""Media columns: payloads in archive files, read by byte ranges.

An archive is a folder of files that tasks write side by side, each holding
media one after the other and an index at its end. A custom data source plans
byte-range partitions over the files; a task reads the index, takes the
members that start in its range and streams them in Arrow batches of a few MB.
A member that can't be read is tried again by its own offset; the others of
its range are neither read again nor lost, and one that stays unreadable comes
with its error instead of its bytes.

A medium here is a grey PNG picture, 64 samples of 8 bits wide: lossless and
compact. Other encoders can be given to write_archive().
"""

from __future__ import annotations

import hashlib
import struct
import time
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from siftwork.session import shared_dir, ship

WIDTH = 64
RANGE_BYTES, BATCH_BYTES, TRIES = 8 << 20, 4 << 20, 3
MAGIC = b"SIFTMED1"
#: Footer: magic, number of members, offset of the index. An index entry: id
#: (with a null flag), offset, length and crc32 of the medium, bytes of the data it holds.
FOOTER, ENTRY = struct.Struct("<8sqq"), np.dtype([("id", "<i8"), ("null", "<i8"), ("offset", "<i8"), ("length", "<i8"), ("crc", "<i8"), ("holds", "<i8")])
SCHEMA = "media_id bigint, file string, offset bigint, length bigint, holds bigint, media binary, error string"
_PNG = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def padded(raw: bytes) -> bytes:
    """raw and as many zero bytes as make a positive multiple of WIDTH."""
    return raw + bytes(-len(raw) % WIDTH or (0 if raw else WIDTH))


def encode_png(raw: bytes) -> bytes:
    """A grey 8-bit picture of WIDTH columns with the padded bytes as its samples."""
    payload = padded(raw)
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)  # the first byte of a row: no filter
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _PNG + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 4)) + _chunk(b"IEND", b"")


def decode_png(data: bytes) -> bytes:
    """The samples of an encode_png() picture; ValueError for anything else."""
    if data[:8] != _PNG:
        raise ValueError("not a PNG")
    at, shape, packed = 8, None, []
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if struct.pack(">I", zlib.crc32(body, zlib.crc32(kind))) != data[at + 8 + size : at + 12 + size]:
            raise ValueError("damaged PNG")
        if kind == b"IHDR":
            shape = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    if shape is None or shape[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not an 8-bit grey picture")
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(shape[1], shape[0] + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:].tobytes()


def opened(url: str) -> tuple[pafs.FileSystem, str]:
    """Filesystem and path of a folder that every task can reach."""
    if "://" not in url:
        url = url.replace("file:", "file://", 1) if url.startswith("file:") else "file://" + url
    return pafs.FileSystem.from_uri(url)


def _write(batches: Iterator[pa.RecordBatch], url: str, encode: Callable[[bytes], bytes]) -> Iterator[pa.RecordBatch]:
    """One file a task. A task that is run again writes another file; the
    rows returned by the run that counts name the files that count."""
    system, path = opened(url)
    name = f"{uuid.uuid4().hex}.media"
    index, at = [], 0
    out = None
    for batch in batches:
        for key, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if out is None:
                system.create_dir(path, recursive=True)
                out = system.open_output_stream(f"{path}/{name}")
            raw = data.as_py() or b""
            medium = encode(raw)
            out.write(medium)
            index.append((key or 0, key is None, at, len(medium), zlib.crc32(medium), len(raw)))
            at += len(medium)
    if out is not None:
        out.write(np.array(index, ENTRY).tobytes())
        out.write(FOOTER.pack(MAGIC, len(index), at))
        out.close()
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([at])], ["file", "size"])


def write_archive(rows: DataFrame, id_col: str, data_col: str, url: str, encode: Callable[[bytes], bytes] = encode_png) -> str:
    """Write an id and a binary column as an archive under url; gives the url.
    Null data is written as an empty payload."""
    ship(rows.sparkSession)
    data = rows.select(F.col(id_col).cast("bigint"), F.col(data_col).cast("binary"))
    files = data.mapInArrow(lambda it: _write(it, f"{url}/files", encode), "file string, size bigint")
    files.write.parquet(f"{url}/manifest")  # commits: only the files of finished tasks are named
    return url


class Range(InputPartition):
    def __init__(self, file: str, start: int, end: int):
        self.file, self.start, self.end = file, start, end


class ArchiveReader(DataSourceReader):
    """Plans ranges from the manifest (a row a file) and streams their members."""

    def __init__(self, url: str, range_bytes: int, tries: int):
        self.url, self.range_bytes, self.tries = url, range_bytes, tries

    def partitions(self) -> list[Range]:
        import pyarrow.dataset as ds

        system, path = opened(f"{self.url}/manifest")
        names = [f.path for f in system.get_file_info(pafs.FileSelector(path)) if f.path.endswith(".parquet")]
        rows = ds.dataset(names, filesystem=system).to_table().to_pylist() if names else []
        cut = [Range(r["file"], i, i + self.range_bytes) for r in sorted(rows, key=lambda r: r["file"]) for i in range(0, max(r["size"], 1), self.range_bytes)]
        return cut or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.file:
            return
        system, path = opened(f"{self.url}/files")
        path = f"{path}/{part.file}"
        size = system.get_file_info(path).size
        with system.open_input_file(path) as f:
            magic, many, at = FOOTER.unpack(f.read_at(FOOTER.size, size - FOOTER.size))
            if magic != MAGIC:
                raise ValueError(f"{part.file} is no archive file, or a cut one")

            def entry(i: int) -> np.ndarray:
                return np.frombuffer(f.read_at(ENTRY.itemsize, at + i * ENTRY.itemsize), ENTRY)[0]

            def first(offset: int) -> int:
                a, b = 0, many
                while a < b:
                    c = (a + b) // 2
                    a, b = (c + 1, b) if entry(c)["offset"] < offset else (a, c)
                return a

            a, b = first(part.start), first(part.end)
            index = np.frombuffer(f.read_at((b - a) * ENTRY.itemsize, at + a * ENTRY.itemsize), ENTRY)
        rows, held = [], 0
        for x in index:
            media, error = self.member(system, path, x)
            rows.append((None if x["null"] else int(x["id"]), part.file, int(x["offset"]), int(x["length"]), int(x["holds"]), media, error))
            held += int(x["length"])
            if held >= BATCH_BYTES:
                yield self.batch(rows)
                rows, held = [], 0
        if rows:
            yield self.batch(rows)

    _open: tuple[str, object] | None = None

    def member(self, system: pafs.FileSystem, path: str, x: np.ndarray) -> tuple[bytes | None, str | None]:
        """A member's bytes, tried anew by its offset if they can't be read or don't match."""
        error = ""
        for n in range(self.tries):
            try:
                if self._open is None or self._open[0] != path:
                    self._open = (path, system.open_input_file(path))
                media = self._open[1].read_at(int(x["length"]), int(x["offset"]))
                if len(media) == x["length"] and zlib.crc32(media) == x["crc"]:
                    return media, None
                error = "bytes differ from what was written"
            except OSError as e:
                error = str(e)
            self._open = None
            time.sleep(0.05 * n)
        return None, error

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
        names = ["media_id", "file", "offset", "length", "holds", "media", "error"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


class ArchiveSource(DataSource):
    """spark.read.format("media_archive").option("range_bytes", ...).load(url)"""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        o = self.options
        return ArchiveReader(o["path"], int(o.get("range_bytes", RANGE_BYTES)), int(o.get("tries", TRIES)))


def read_archive(spark: SparkSession, url: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The archive's members: media_id, file, offset, length, holds, media, error."""
    ship(spark)
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("media_archive").option("range_bytes", range_bytes).load(url)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for media, error in zip(batch.column("media"), batch.column("error").to_pylist(), strict=True):
            if error is not None:
                out.append((None,) * 6)
                continue
            data = media.as_py()
            samples = decode_png(data)
            x = np.frombuffer(samples, np.uint8)
            n = np.bincount(x, minlength=256)
            p = n[n > 0] / len(x)
            # Mean, deviation, entropy and mean step between neighbours: rounded, so equal samples give equal text.
            total, square = int((n * np.arange(256)).sum()), int((n * np.arange(256) ** 2).sum())
            step = int(np.abs(np.diff(x.astype(np.int64))).sum())
            var = max(square / len(x) - (total / len(x)) ** 2, 0)
            feature = f"rows={len(x) // WIDTH};mean={total / len(x):.4f};dev={var**0.5:.4f};entropy={-(p * np.log2(p)).sum():.4f};step={step / max(len(x) - 1, 1):.4f}"
            out.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature))
        cols = list(zip(*out, strict=True)) or [()] * 6
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        yield pa.RecordBatch.from_arrays([batch.column("media_id"), batch.column("holds"), batch.column("error"), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]], ["media_id", "n_bytes", "error", *names])


FEATURES = "media_id bigint, n_bytes bigint, error string, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def media_features(media: DataFrame) -> DataFrame:
    """Features of read_archive()'s rows; nulls beside the error of an unreadable one."""
    ship(media.sparkSession)
    return media.select("media_id", "holds", "media", "error").mapInArrow(_features, FEATURES)


def text_media(docs: DataFrame, url: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: every text written to an archive as a picture,
    read back and described: doc_id, n_bytes, payload_bytes, payload_sha256,
    tail_crc32, media_bytes, media_sha256, feature, error.

    Null texts count as empty: a payload of 64 zero bytes. Repeated rows and
    null ids are members of their own. n_bytes, without the padding, is kept in
    the archive's index.
    """
    spark = docs.sparkSession
    ship(spark)
    url = url or shared_dir(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.cast("binary").alias("data"))
    write_archive(rows, "id", "data", url)
    got = media_features(read_archive(spark, url))
    return got.select(
        F.col("media_id").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"
    )
