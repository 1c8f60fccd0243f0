"""A deterministic sharded WARC writer, and the reader that checks what it wrote.

Records are sorted by key over ranges of nearly equal payload bytes; within a range files roll by
compressed size. Headers and digests are made anew, every record is its own gzip member without time
stamps, so equal tables give equal files. A file is written under a temporary name and renamed; the
manifest, a table committed at the end, names the files that count.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import math
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parasift.llm.common import file_system, join_counted, small_table, stage, stage_path, tidy

FILE_BYTES = 16 << 20
RANGE_BYTES = 16 << 20
MOST_RANGES = 50_000
BUCKETS_A_RANGE = 8
LEAST_BUCKETS = 4096
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = re.compile(r"[\x00-\x20\x7f]")
MANIFEST = "file string, records long, bytes long, sha256 string, first_key long, last_key long"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(key: int | None, digest: str, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{key}/{digest}/{copy}')}>"


def record(key: int | None, url: str | None, payload: bytes, owner: int | None, copy: int) -> bytes:
    """A response, or a revisit of the record of key ``owner``; ``copy`` counts rows of equal key and payload."""
    digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = owner is not None
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(key, digest, copy)}", f"WARC-Date: {DATE}"]
    if url:
        head.append("WARC-Target-URI: " + _SPACE.sub(lambda m: f"%{ord(m[0]):02X}", url))
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}"]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(owner, digest, 0)}", f"X-Refers-To-Key: {owner}"]
    if key is not None:
        head.append(f"X-Key: {key}")
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _File:
    def __init__(self, folder: str, name: str, attempt: int):
        self.fs, base = file_system(folder)
        self.fs.create_dir(base, recursive=True)
        self.name, self.final, self.temporary = name, f"{base}/{name}", f"{base}/_{name}.{attempt}.tmp"
        self.out = self.fs.open_output_stream(self.temporary, compression=None)
        self.size, self.records, self.sha, self.first, self.last = 0, 0, hashlib.sha256(), None, None

    def add(self, key: int | None, data: bytes) -> None:
        member = gzip.compress(data, 6, mtime=0)
        self.out.write(member)
        self.sha.update(member)
        self.size += len(member)
        self.records += 1
        if key is not None:
            self.first, self.last = key if self.first is None else self.first, key

    def close(self) -> tuple:
        self.out.close()
        self.fs.move(self.temporary, self.final)
        return self.name, self.records, self.size, self.sha.hexdigest(), self.first, self.last


_TIE = 12


def _tie(digest: Column) -> Column:
    """The first bits of a digest in hexadecimal."""
    return F.conv(F.substring(digest, 1, _TIE // 4), 16, 10).cast("int")


class _Plan:
    """Ranges of nearly equal bytes over (key, digest): a histogram over the keys' leading bits, refined
    where one bucket holds more than a range's share, down to single keys and then to their digests.

    Bits are split the same way whatever the partitioning, so equal tables have equal ranges. A level's
    histogram, a few thousand rows or 8 a range, is all that reaches the driver.
    """

    def __init__(self, sized: DataFrame):
        low, high, total = sized.agg(F.min("key"), F.max("key"), F.sum("size")).first()
        ranges = min(max(1, math.ceil((total or 0) / RANGE_BYTES)), MOST_RANGES)
        self.share, self.spark = max(1, math.ceil((total or 0) / ranges)), sized.sparkSession
        most = max(LEAST_BUCKETS, BUCKETS_A_RANGE * ranges)
        shift = next(s for s in range(65) if low is None or (high >> s) - (low >> s) < most)
        self.shifts, leaves, rows = [], [], sized.where("key is not null")
        while low is not None:
            bucket = F.shiftright("key", min(shift, 63))
            sizes = rows.groupBy(bucket.alias("bucket")).agg(F.sum("size").alias("bytes")).collect()
            heavy = [r["bucket"] for r in sizes if r["bytes"] > self.share]
            leaves += [(r["bucket"] << shift, -1, len(self.shifts), r["bucket"], r["bytes"]) for r in sizes if r["bytes"] <= self.share]
            self.shifts.append(shift)
            if not heavy:
                break
            # At most one heavy bucket a range.
            table = small_table(self.spark, [{"bucket": b} for b in heavy], "bucket:bigint")
            rows = rows.join(F.broadcast(table), bucket == F.col("bucket"), "left_semi")
            if shift == 0:
                leaves += self._ties(rows)
                break
            shift = max(0, shift - max(1, (most // len(heavy)).bit_length() - 1))
        none = sized.where("key is null")
        if (none.agg(F.sum("size")).first()[0] or 0) > self.share:
            leaves += self._ties(none)
        self._deal(leaves)

    def _ties(self, rows: DataFrame) -> list[tuple]:
        sizes = rows.groupBy("key", _tie(F.hex("digest")).alias("tie")).agg(F.sum("size").alias("bytes")).collect()
        return [(-(1 << 64) if r["key"] is None else r["key"], r["tie"], None, r["key"], r["bytes"]) for r in sizes]

    def _deal(self, leaves: list[tuple]) -> None:
        filled, keyed = 0, False
        self.levels: list[list[dict]] = [[] for _ in self.shifts]
        self.tied: list[dict] = []
        self.last = 0
        for _, tie, level, bucket, size in sorted(leaves, key=lambda x: x[:2]):
            if bucket is not None and not keyed:  # rows without a key have ranges of their own
                keyed, filled, first = True, 0, self.last + 1
            self.last = (first if keyed else 0) + filled // self.share
            filled += size
            if level is None:
                self.tied.append({"key": bucket, "tie": tie, "range": self.last})
            else:
                self.levels[level].append({"bucket": bucket, "range": self.last})

    def place(self, rows: DataFrame, digest: Column) -> DataFrame:
        """``rows`` with ``range``; each key is in the table of one level."""
        found = []
        for i, (shift, level) in enumerate(zip(self.shifts, self.levels)):
            if level:
                table = small_table(self.spark, level, "bucket:bigint,range:int").toDF(f"__b{i}", f"__r{i}")
                rows = rows.join(F.broadcast(table), F.shiftright("key", min(shift, 63)) == F.col(f"__b{i}"), "left")
                found.append(f"__r{i}")
        if self.tied:
            table = small_table(self.spark, self.tied, "key:bigint,tie:int,range:int").toDF("__key", "__tie", "__r")
            rows = rows.join(F.broadcast(table), F.col("key").eqNullSafe(F.col("__key")) & (_tie(digest) == F.col("__tie")), "left")
            found.append("__r")
        return rows.withColumn("range", F.coalesce(*found, F.lit(0))).drop(*(c for c in rows.columns if c.startswith("__")))


def write_warc(df: DataFrame, folder: str, key: str = "page_id", url: str = "url", body: str = "html", least_revisit: int = 0) -> DataFrame:
    """Write a record for each row into ``folder``; returns the manifest (staged, so written once).

    Payload: ``body`` in UTF-8, null as empty. Of records with equal payloads of at least
    ``least_revisit`` bytes the one with the least key is the response and the others revisit it; smaller
    ones are all responses. Of rows with equal key and payload the first is the response. Rows with a
    null key come first, in ranges of their own, as responses, or as revisits if a row with a key has
    the payload. Within a key records are ordered by payload, or where the key is spread over ranges first by
    digest. An empty table gives an empty manifest and no file. Other columns are ignored. Records of one
    range are sorted in one task; rows equal in key and payload always share a range.
    """
    payload = F.encode(F.coalesce(F.col(body), F.lit("")), "UTF-8")
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    sized = stage(rows.select("key", F.octet_length("payload").cast("long").alias("size"), F.unhex(F.sha1("payload")).alias("digest")), "warc-digests")
    plan = _Plan(sized)
    owners = sized.where(F.col("size") >= least_revisit).groupBy("digest").agg(F.min("key").alias("owner"), F.count("*").alias("n")).where("n > 1 and owner is not null")
    # What a row needs to know about its payload's owner meets the row itself in the range sort.
    known = join_counted(sized.select("key", "digest"), stage(owners, "warc-owners"), ["digest"], "n").select("key", "digest", "owner").distinct()
    none = lambda kind: F.lit(None).cast(kind)
    told = known.select("key", F.lit(0).alias("kind"), none("string").alias("url"), none("binary").alias("payload"), "digest", "owner")
    both = told.unionByName(rows.select("key", F.lit(1).alias("kind"), "url", "payload", none("binary").alias("digest"), none("long").alias("owner")))
    placed = plan.place(both, F.coalesce(F.hex("digest"), F.sha1("payload")))
    dealt = placed.repartitionByRange(plan.last + 1, "range").sortWithinPartitions("range", "key", "kind", "payload", "url")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = TaskContext.get().taskAttemptId()
        file, here, number, now, owner_of, seen = None, None, 0, None, {}, {}
        done: list[tuple] = []
        for batch in batches:
            columns = (batch.column(n).to_pylist() for n in ("range", "key", "kind", "url", "payload", "digest", "owner"))
            for at, own, kind, link, data, told_digest, told_owner in zip(*columns):
                if (at, own) != now:
                    now, owner_of, seen = (at, own), {}, {}
                if kind == 0:
                    owner_of[told_digest] = told_owner
                    continue
                digest = hashlib.sha1(data).digest()
                owner, copy = owner_of.get(digest), seen.get(digest, 0)
                seen[digest] = copy + 1
                if owner is not None and owner == own and copy == 0:
                    owner = None
                if file is not None and (at != here or file.size >= FILE_BYTES):
                    done.append(file.close())
                    file, number = None, number + 1 if at == here else 0
                if file is None:
                    number = number if at == here else 0
                    here, file = at, _File(folder, f"{at:06d}-{number:04d}.warc.gz", attempt)
                file.add(own, record(own, link, data, owner, copy))
        if file is not None:
            done.append(file.close())
        if done:
            yield pa.RecordBatch.from_pandas(pd.DataFrame(done, columns=["file", "records", "bytes", "sha256", "first_key", "last_key"]).astype({"first_key": "Int64", "last_key": "Int64"}), preserve_index=False)

    return stage(dealt.mapInArrow(run, MANIFEST), "warc-manifest")


#: Bytes of a file that the reader unpacks at a time: what lies behind a record's end is read again by the next.
READ_WINDOW = 1 << 14


def members(data: bytes) -> Iterator[bytes]:
    """The gzip members of a file, one after another; one that is cut off raises."""
    view, at = memoryview(data), 0
    while at < len(data):
        unzip, parts = zlib.decompressobj(31), []
        while not unzip.eof:
            window = view[at : at + READ_WINDOW]
            if not len(window):
                raise ValueError("the last record is cut off")
            parts.append(unzip.decompress(window))
            at += len(window) - len(unzip.unused_data)
        yield b"".join(parts)


def parse(raw: bytes) -> dict:
    """Key, payload size and digest, type and reference of a record; a wrong digest raises."""
    head, _, block = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if base32_sha1(block) != fields["WARC-Block-Digest"].removeprefix("sha1:"):
        raise ValueError(f"{fields['WARC-Record-ID']}: wrong block digest")
    if fields["WARC-Type"] == "response" and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError(f"{fields['WARC-Record-ID']}: wrong payload digest")
    number = lambda name: int(fields[name]) if name in fields else None
    return {"key": number("X-Key"), "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": number("X-Refers-To-Key")}


def read_warc(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per record of the files that ``manifest`` names; each file's checksum is verified."""

    @tidy
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = file_system(folder)
        for frame in frames:
            for name, sha in zip(frame["file"], frame["sha256"]):
                with fs.open_input_file(f"{base}/{name}") as file:
                    data = file.read()
                if hashlib.sha256(data).hexdigest() != sha:
                    raise ValueError(f"{name}: not the file that the manifest names")
                rows = pd.DataFrame([parse(m) for m in members(data)], columns=["key", "payload_bytes", "payload_digest", "record_type", "refers_to"])
                yield rows.astype({"key": "Int64", "refers_to": "Int64"})

    schema = "key long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    # A row stands for a whole file, so the number of tasks follows the files and not the rows' bytes.
    tasks = min(max(1, manifest.count()), MOST_RANGES)
    return manifest.select("file", "sha256").repartitionByRange(tasks, "file").mapInPandas(run, schema)


def round_trip(df: DataFrame, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """Write all rows to the shared folder and read every record back."""
    folder = stage_path(df.sparkSession, "warc")
    return read_warc(write_warc(df, folder, key, url, body), folder).withColumnRenamed("key", key)
