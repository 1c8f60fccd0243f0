"""Where the tokens of two tokenizers meet in the bytes of a text, and how often two ids overlap corpus-wide.

The texts of a whole Arrow batch lie end to end as bytes, each behind one space. The ends of all A tokens and
of all B tokens are counted once by byte; a cut is where both occur. Prefix sums over those counts give each
token its group and each A token its range of overlapping B tokens; their values at the texts' own offsets give
every text's results.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parasift.llm import bpe
from parasift.llm.common import file_system, row_chunks, stage, tidy, utf8

#: Bytes of text aligned together (or one longer text), and links counted together.
BATCH_BYTES, LINKS_TOGETHER = 2 << 20, 1 << 21
#: Id pairs that a worker holds at a time; more are looked up block by block.
PAIRS_A_BLOCK = 1 << 22
_SPACE = 32


class TokensA:
    """Ids by byte-level BPE. The array codec and the library cut texts alike but for characters that one's edition
    of Unicode does not know; so texts beyond the settled ranges go through the library."""

    def __init__(self, ranks: str, pattern: str, library: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # read when the library is first loaded
        from tokenizers import Tokenizer

        self.codec, self.library = bpe.codec(ranks, pattern), Tokenizer.from_file(library)
        self.library.encode_special_tokens = True
        self.sizes = np.asarray(self.codec.ranks.sizes)

    @staticmethod
    def unsettled(data: np.ndarray) -> np.ndarray:
        """Lead bytes of characters from U+0500 on, but for general punctuation (U+2000 to U+207F)."""
        following = np.append(data[1:], 0)
        return (data >= 0xD4) & ~((data == 0xE2) & ((following == 0x80) | (following == 0x81)))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        seen = np.concatenate([[0], np.cumsum(self.unsettled(data))])[offsets]
        odd = np.flatnonzero(np.diff(seen))
        if not len(odd):
            ids, at = self.codec.encode_rows(data, offsets)
            return np.asarray(ids, np.int64), np.asarray(at, np.int64)
        rows: list = [None] * (len(offsets) - 1)
        texts = [data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace") for i in odd]
        for i, coded in zip(odd.tolist(), self.library.encode_batch(texts, add_special_tokens=False)):
            rows[i] = np.array(coded.ids, np.int64)
        others = np.setdiff1d(np.arange(len(rows)), odd)
        sizes = np.diff(offsets)[others]
        keep = np.repeat(np.isin(np.arange(len(rows)), others), np.diff(offsets))
        ids, at = self.codec.encode_rows(data[keep], np.concatenate([[0], np.cumsum(sizes)]))
        for n, i in enumerate(others.tolist()):
            rows[i] = np.asarray(ids[at[n] : at[n + 1]], np.int64)
        return np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])

    def decode(self, ids: np.ndarray) -> np.ndarray:
        return self.codec.ranks.decode(ids)


class TokensB:
    """Ids by a piece model, which puts one space before a text itself."""

    def __init__(self, model: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = self.model.id_to_piece(list(range(self.model.get_piece_size())))
        raw = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.sizes = np.array([len(r) for r in raw])
        self.begins, self.bytes = np.cumsum(self.sizes) - self.sizes, np.frombuffer(b"".join(raw), np.uint8)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        whole = data.tobytes()
        texts = [whole[a + 1 : z].decode("utf-8", "replace") for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        rows = self.model.encode(texts, num_threads=1)
        return np.fromiter(chain.from_iterable(rows), np.int64), np.concatenate([[0], np.cumsum([len(r) for r in rows], dtype=np.int64)])

    def decode(self, ids: np.ndarray) -> np.ndarray:
        return bpe.spans(self.bytes, self.begins[ids], self.sizes[ids])


def _faithful(decoded: np.ndarray, sizes: np.ndarray, at: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text's tokens are its bytes again."""
    if len(decoded) == len(data) and (decoded == data).all():
        return np.ones(len(offsets) - 1, bool)
    bounds = np.concatenate([[0], np.cumsum(sizes)])[at]
    return np.array([decoded[a:z].tobytes() == data[b:y].tobytes() for a, z, b, y in zip(bounds[:-1], bounds[1:], offsets[:-1], offsets[1:])], bool)


class Aligned:
    """Results of a run of texts: arrays over tokens, and bounds of each text in them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], sizes_a: np.ndarray, sizes_b: np.ndarray):
        (self.a, self.at_a), (self.b, self.at_b) = a, b
        n = len(data)
        end_a, end_b = np.cumsum(sizes_a[self.a]), np.cumsum(sizes_b[self.b])
        count_a, count_b = np.bincount(end_a, minlength=n + 1), np.bincount(end_b, minlength=n + 1)
        cuts = np.cumsum((count_a > 0) & (count_b > 0))
        until_b = np.cumsum(count_b)
        self.group_a, self.group_b = cuts[end_a - 1], cuts[end_b - 1]
        self.n_groups = np.diff(cuts[offsets])
        self.low = until_b[end_a - sizes_a[self.a]]
        self.times = until_b[end_a - 1] - self.low + 1
        self.links_at = np.concatenate([[0], np.cumsum(self.times)])[self.at_a]

    def links(self) -> np.ndarray:
        """``a << 16 | b`` of every overlapping pair of tokens, text after text."""
        a = np.repeat(self.a, self.times)
        first = np.cumsum(self.times) - self.times
        b = self.b[np.repeat(self.low - first, self.times) + np.arange(len(a))]
        return (a << 16 | b).astype(np.uint32)

    def groups(self) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of each text."""
        total = len(self.a) + len(self.b)
        place_a = np.arange(len(self.a)) + np.searchsorted(self.group_b, self.group_a, "left")
        place_b = np.arange(len(self.b)) + np.searchsorted(self.group_a, self.group_b, "right")
        ids, mark = np.empty(total, np.int64), np.full(total, ord(","), np.uint8)
        ids[place_a], ids[place_b] = self.a, self.b
        last = lambda g: np.append(g[1:] != g[:-1], True)
        mark[place_a[last(self.group_a)]] = ord("|")
        mark[place_b[last(self.group_b)]] = ord(";")
        digits, sizes = _decimals(int(ids.max()) + 1 if total else 1)
        width = sizes[ids] + 1
        ends = np.cumsum(width)
        out = np.empty(int(ends[-1]) if total else 0, np.uint8)
        for k in range(digits.shape[1]):
            some = np.flatnonzero(sizes[ids] > k)
            out[ends[some] - width[some] + k] = digits[ids[some], k]
        out[ends - 1] = mark
        bounds = np.concatenate([[0], ends])[self.at_a + self.at_b].tolist()
        whole = out.tobytes()
        return [whole[a : max(a, z - 1)] for a, z in zip(bounds[:-1], bounds[1:])]


@lru_cache(maxsize=2)
def _decimals(most: int) -> tuple[np.ndarray, np.ndarray]:
    """Digits of the numbers below ``most``, left-bound, and how many each has."""
    words = np.arange(most).astype("S")
    return words.view(np.uint8).reshape(most, -1), np.char.str_len(words)


class Aligner:
    def __init__(self, ranks: str, pattern: str, library: str, model: str):
        self.a, self.b = TokensA(ranks, pattern, library), TokensB(model)
        if max(len(self.a.sizes), len(self.b.sizes)) > 1 << 16:
            raise ValueError("ids of over 16 bits")

    def align(self, raw: np.ndarray, offsets: np.ndarray) -> Aligned:
        """Texts that either side does not give back to the byte, and empty ones, have no tokens."""
        sizes = np.diff(offsets)
        while True:
            full = sizes + (sizes > 0)
            own = np.concatenate([[0], np.cumsum(full)])
            data = np.full(int(own[-1]), _SPACE, np.uint8)
            inside = np.ones(len(data), bool)
            inside[own[:-1][sizes > 0]] = False
            data[inside] = raw
            a, b = self.a.encode(data, own), self.b.encode(data, own)
            good = _faithful(self.a.decode(a[0]), self.a.sizes[a[0]], a[1], data, own) & _faithful(self.b.decode(b[0]), self.b.sizes[b[0]], b[1], data, own)
            if good.all():
                return Aligned(data, own, a, b, self.a.sizes, self.b.sizes)
            raw, sizes = raw[np.repeat(good, sizes)], np.where(good, sizes, 0)


@lru_cache(maxsize=1)
def aligner(ranks: str, pattern: str, library: str, model: str) -> Aligner:
    """One a worker process."""
    return Aligner(ranks, pattern, library, model)


COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


def align(df: DataFrame, files: tuple[str, str, str, str], text: str = "text", key: str = "doc_id", digest: bool = False, links: bool = False) -> DataFrame:
    """``key``, ``n_a``, ``n_b``, ``n_groups``, ``n_links`` and ``groups``: ``a1,a2|b1;a3|b2,b3``, the ids of both
    tokenizers between the byte offsets where both have a token's end; with ``digest`` its SHA-256 in lowercase
    hexadecimal digits. ``links`` adds that column: ``a << 16 | b`` of each overlapping pair, four bytes little-endian.

    ``files``: ranks and pattern of A, the same vocabulary for its library, and the model of B; every worker can open
    them. A null or empty text, and one that either side does not give back to the byte, has no tokens: zeros and
    ''. Strings of special tokens are plain text. Narrow: a row for each row, repeated ones too; a null key passes;
    an empty table gives none; other columns are ignored, whatever their names.
    """
    fields = [T.StructField(key, df.schema[key].dataType), *(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("groups", T.StringType())]
    schema = T.StructType(fields + [T.StructField("links", T.BinaryType())] * links)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(*files)
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for first, stop in row_chunks(offsets, BATCH_BYTES):
                part = offsets[first : stop + 1]
                done = own.align(data[part[0] : part[-1]], part - part[0])
                found = done.groups()
                if digest:
                    found = [hashlib.sha256(g).hexdigest() if g else "" for g in found]
                columns = [np.diff(done.at_a), np.diff(done.at_b), done.n_groups, np.diff(done.links_at)]
                arrays = [batch.column(0).slice(first, stop - first), *(pa.array(c.astype(np.int64)) for c in columns), pa.array(found, pa.binary()).cast(pa.string()) if not digest else pa.array(found, pa.string())]
                if links:
                    bounds = (4 * done.links_at).astype(np.int64)
                    arrays.append(pa.Array.from_buffers(pa.large_binary(), stop - first, [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(done.links().tobytes())]).cast(pa.binary()))
                yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in fields] + ["links"] * links)

    return df.select(F.col(key), F.col(text)).mapInArrow(run, schema)


def pair_counts(linked: DataFrame) -> DataFrame:
    """(``pair``, ``n``, ``best``): how many links of ``linked`` hold an id pair, and whether no pair with its B id has
    more. Workers count runs of texts first; the B ids' highest go to the pairs by broadcast, as there are at
    most 65,536."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = np.frombuffer(utf8(batch.column(0))[0].tobytes(), "<u4")
            for at in range(0, len(held), LINKS_TOGETHER):
                pairs, counts = np.unique(held[at : at + LINKS_TOGETHER], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pairs.astype(np.int64)), pa.array(counts.astype(np.int64))], names=["pair", "n"])

    counted = stage(linked.select("links").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "id-pairs")
    b = F.col("pair").bitwiseAND(0xFFFF)
    top = counted.groupBy(b.alias("b")).agg(F.max("n").alias("top"))
    return counted.withColumn("b", b).join(F.broadcast(top), "b").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


@lru_cache(maxsize=1)
def _pair_block(files: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs in order, their counts and marks, of one block's files; a worker process keeps one block."""
    found = []
    for file in files:
        system, path = file_system(file)
        with system.open_input_file(path) as source:
            found.append(pq.read_table(source))
    table = pa.concat_tables(found)
    pairs, n, best = (table[c].to_numpy() for c in ("pair", "n", "best"))
    order = np.argsort(pairs, kind="stable")
    return pairs[order].astype(np.uint32), n[order], best[order]


def with_pair_counts(linked: DataFrame) -> DataFrame:
    """``linked``, a staged table of ``align`` with links, with ``n_best`` (links whose count is their B id's highest) and
    ``count_sum`` (of all links' counts) in place of ``links``.

    The pair table lies in the shared folder in blocks of about ``PAIRS_A_BLOCK`` pairs, split by a hash; workers read
    them, and hold one at a time, however many pairs there are.
    """
    pairs = pair_counts(linked)
    blocks = max(1, -(-pairs.count() // PAIRS_A_BLOCK))
    table = pairs.repartition(blocks, F.col("pair"))
    files = sorted(stage(table, "id-pair-blocks").inputFiles())
    kept = [f for f in linked.schema.fields if f.name != "links"]
    schema = T.StructType([*kept, T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])
    names, at = [f.name for f in schema], linked.columns.index("links")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(at))
            held = np.frombuffer(data.tobytes(), "<u4")
            best, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for file in files:
                known, n, mark = _pair_block((file,))
                if not len(known):
                    continue
                for first, stop in row_chunks(offsets, 4 * LINKS_TOGETHER):
                    bounds = offsets[first : stop + 1] // 4
                    some = held[bounds[0] : bounds[-1]]
                    place = np.minimum(np.searchsorted(known, some), len(known) - 1)
                    hit = known[place] == some
                    sums = lambda v: np.diff(np.concatenate([[0], np.cumsum(v)])[bounds - bounds[0]])  # noqa: B023, E731
                    best[first:stop] += sums(hit & mark[place])
                    total[first:stop] += sums(np.where(hit, n[place], 0))
            others = [batch.column(i) for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*others, pa.array(best), pa.array(total)], names=names)

    return linked.mapInArrow(run, schema)


def aligned_with_counts(df: DataFrame, files: tuple[str, str, str, str], text: str = "text", key: str = "doc_id", digest: bool = True) -> DataFrame:
    """``align`` with ``n_best`` and ``count_sum`` beside it. Texts are coded once: links are written to the shared folder,
    counted from there, and their counts looked up there. Odd cases as in ``align``; a text without tokens has
    zeros."""
    return with_pair_counts(stage(align(df, files, text, key, digest, links=True), "links", compression="zstd"))
