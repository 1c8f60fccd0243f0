"""Media columns: payloads in content-addressed tar shards, metadata by header-only range reads.

A payload is stored as a greyscale PNG of 64 samples a row, under its SHA-256 as member name. Rows carry
digest, shard, offset and length. A writing task stores a payload once for each shard it writes, so no
payload crosses the network; of several stored copies the catalog names the first.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parasift.llm.common import file_system, join_counted, row_bytes, stage, stage_path, tidy, utf8

WIDTH = 64
SHARD_BYTES = 128 << 20
LEVEL = 6
#: Stored bytes that one task reads back, and the most such tasks.
READ_BYTES = 16 << 20
MOST_READS = 50_000
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Signature and header chunk: all that the metadata columns need.
HEADER_BYTES = 33


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def pad(raw: bytes) -> bytes:
    """``raw`` with zero bytes up to a positive multiple of the row width."""
    return raw + bytes(-len(raw) % WIDTH or (0 if raw else WIDTH))


def to_png(payload: bytes) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # filter 0, then the samples
    lines[:, 1:] = rows
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def read_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bit depth from a file's first ``HEADER_BYTES``."""
    if head[:8] != _SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    width, height, depth = struct.unpack(">IIB", head[16:25])
    return width, height, depth


def from_png(media: bytes) -> bytes:
    """The samples of a PNG written by ``to_png``; checks every chunk's checksum."""
    width, height, depth = read_header(media[:HEADER_BYTES])
    at, data = 8, []
    while at < len(media):
        (size,) = struct.unpack(">I", media[at : at + 4])
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + size]
        if struct.unpack(">I", media[at + 8 + size : at + 12 + size])[0] != zlib.crc32(kind + body):
            raise ValueError("damaged chunk")
        if kind == b"IDAT":
            data.append(body)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if depth != 8 or lines[:, 0].any():
        raise ValueError("only unfiltered 8-bit samples are written here")
    return lines[:, 1:].tobytes()


def feature(payload: bytes, width: int, height: int) -> str:
    """Size, range, sum and a 64-bit mean pattern of the samples."""
    samples = np.frombuffer(payload, np.uint8)
    total = int(samples.sum(dtype=np.int64))
    parts = samples.reshape(64, -1).sum(axis=1, dtype=np.int64)
    bits = int(np.packbits(parts * 64 > total).view(">u8")[0])
    return f"{width}x{height} {samples.min()}-{samples.max()} {total} {bits:016x}"


class TarShard:
    """A tar file under a temporary name, which ``close`` makes final."""

    def __init__(self, folder: str, name: str):
        self.fs, base = file_system(folder)
        self.fs.create_dir(base, recursive=True)
        self.final, self.temporary = f"{base}/{name}", f"{base}/_{name}.tmp"
        self.out = self.fs.open_output_stream(self.temporary)
        self.at = 0
        self.held: dict[bytes, tuple[int, int]] = {}

    def add(self, digest: bytes, media: bytes) -> None:
        name = f"{digest.hex()}.png".encode()
        header = bytearray(512)
        size = f"{len(media):011o}".encode() if len(media) < 8**11 else b"\x80" + len(media).to_bytes(10, "big")
        for start, value in ((0, name), (100, b"0000644\0"), (108, b"0000000\0"), (116, b"0000000\0"), (124, size + b"\0"), (136, b"00000000000\0"), (148, b" " * 8), (156, b"0"), (257, b"ustar\x0000")):
            header[start : start + len(value)] = value
        header[148:156] = f"{sum(header):06o}\0 ".encode()
        self.out.write(bytes(header))
        self.out.write(media)
        self.out.write(bytes(-len(media) % 512))
        self.held[digest] = self.at + 512, len(media)
        self.at += 512 + len(media) + -len(media) % 512

    def close(self) -> None:
        self.out.write(bytes(1024))
        self.out.close()
        self.fs.move(self.temporary, self.final)


def write_media(df: DataFrame, folder: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Catalog rows ``key``, ``n_bytes``, ``digest``, ``shard``, ``offset``, ``length``; stores every
    payload in tar shards in ``folder``. Evaluate it once (stage it): each evaluation writes anew.

    Shard names hold the task attempt, so a task that runs again never touches what another wrote;
    shards that no catalog row names are left-overs.
    """
    schema = T.StructType([df.schema[key], T.StructField("n_bytes", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("shard", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType())])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        stem, shards, shard = f"{task.partitionId():06d}-{task.taskAttemptId()}", 0, None
        for batch in batches:
            rows = []
            for raw in row_bytes(*utf8(batch.column(1))):
                if shard is None:
                    name = f"{stem}-{shards:04d}.tar"
                    shard, shards = TarShard(folder, name), shards + 1
                payload = pad(raw)
                digest = hashlib.sha256(payload).digest()
                if digest not in shard.held:
                    shard.add(digest, to_png(payload))
                rows.append((len(raw), digest, name, *shard.held[digest]))
                if shard.at >= SHARD_BYTES:
                    shard.close()
                    shard = None
            if rows:
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=schema.names)
        if shard is not None:
            shard.close()

    return df.select(key, text).mapInArrow(run, schema)


def _places(catalog: DataFrame) -> DataFrame:
    """One stored place of each payload, dealt out evenly in the order of shards and offsets.

    A row stands for its stored bytes, so the number of tasks follows those and not the rows' size.
    """
    stored = catalog.agg(F.sum("length")).first()[0] or 0
    tasks = min(max(1, math.ceil(stored / READ_BYTES)), MOST_READS)
    first = catalog.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at")).select("digest", "at.*")
    return first.repartitionByRange(tasks, "shard", "offset").sortWithinPartitions("shard", "offset")


def _reader(folder: str, whole: bool):
    @tidy
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = file_system(folder)
        name, file = None, None
        for frame in frames:
            rows = []
            for digest, shard, offset, length in frame.itertuples(index=False):
                if shard != name:
                    if file is not None:
                        file.close()
                    name, file = shard, fs.open_input_file(f"{base}/{shard}")
                width, height, depth = read_header(file.read_at(HEADER_BYTES, offset))
                row = [digest, width, height, depth, width * height]
                if whole:
                    media = file.read_at(length, offset)
                    payload = from_png(media)
                    if hashlib.sha256(payload).digest() != digest:
                        raise ValueError(f"{shard}: the payload at {offset} is not what its digest says")
                    row += [zlib.crc32(payload[-WIDTH:]), len(media), hashlib.sha256(media).digest(), feature(payload, width, height)]
                rows.append(row)
            yield pd.DataFrame(rows, columns=META + (FULL if whole else []))
        if file is not None:
            file.close()

    return run


META = ["digest", "width", "height", "depth", "payload_bytes"]
FULL = ["tail_crc32", "media_bytes", "media_digest", "feature"]
_META_SCHEMA = "digest binary, width int, height int, depth int, payload_bytes long"
_FULL_SCHEMA = _META_SCHEMA + ", tail_crc32 long, media_bytes long, media_digest binary, feature string"


def media_metadata(catalog: DataFrame, folder: str) -> DataFrame:
    """Metadata of each distinct payload from range reads of ``HEADER_BYTES`` each."""
    return _places(catalog).mapInPandas(_reader(folder, False), _META_SCHEMA)


def media_features(catalog: DataFrame, folder: str) -> DataFrame:
    """Metadata, digest of the stored bytes and features of each distinct payload, all read back; a payload
    that is not what its digest says raises."""
    return _places(catalog).mapInPandas(_reader(folder, True), _FULL_SCHEMA)


def media_columns(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, metadata and features of each row's payload, stored in the shared folder and read back: width,
    height and depth from the headers alone, the features from the whole stored bytes.

    A null text is the empty text; its payload is one row of zeros. Equal texts share one payload and
    get equal values; each repeated row gives its row, null keys too. An empty table gives no rows;
    other columns are ignored.
    """
    folder = stage_path(df.sparkSession, "media")
    catalog = stage(write_media(df, folder, text, key), "media-catalog")
    meta = media_metadata(catalog, folder).select("digest", "width", "height", "depth")
    whole = media_features(catalog, folder).drop("width", "height", "depth")
    counts = catalog.groupBy("digest").agg(F.count("*").alias("rows"))
    found = stage(whole.join(meta, "digest").join(counts, "digest"), "media-features")
    hexed = lambda c: F.lower(F.hex(c))
    joined = join_counted(catalog.select(key, "n_bytes", "digest"), found, ["digest"], "rows")
    return joined.withColumns({"payload_sha256": hexed("digest"), "media_sha256": hexed("media_digest")}).drop("rows", "media_digest")
