"""Benchmark decontamination by greedy string tiling with running Karp-Rabin hashes.

Windows of ``LEAST_TILE`` words that document and test item share are the seeds. From the item positions
that seeds cover follows an upper bound of what tiles can cover; pairs below the threshold end there.
The others are tiled: at each search length all longest common stretches of unmarked words are found by
window hashes, the longest are marked first, and the search length falls until it is ``LEAST_TILE``.
Tiles do not overlap and may come in any order, so passages put together anew still count.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parasift.llm.common import file_system, row_bytes, stage, tidy, utf8
from parasift.llm.features import Words, chunks, mixed
from parasift.llm.toxicity import _WORD, _lower

LEAST_TILE = 5
LEAST_COVERAGE = 0.8
FIRST_LENGTH = 20
#: Benchmark text that a worker holds at a time. A larger benchmark lies in files of about this size, and the
#: documents pass each in turn.
BLOCK_BYTES = 16 << 20
FILES_A_BLOCK = 4
PAIR_BLOCK = 1 << 20
_BASE = 0xBF58476D1CE4E5B9
_BITMAP = 22


class Rolled:
    """Prefix hashes of a word sequence: the hash of any window in constant time."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        power = np.full(n + 1, _BASE, np.uint64)
        inverse = np.full(n + 1, pow(_BASE, -1, 1 << 64), np.uint64)
        power[0] = inverse[0] = 1
        self.inverse = np.cumprod(inverse, dtype=np.uint64)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(words * np.cumprod(power, dtype=np.uint64)[:n], dtype=np.uint64, out=self.sums[1:])
        self.words = words

    def window(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.inverse[start]


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and where each text's words begin (one more entry than texts)."""
    words = Words(_lower(texts), _WORD)
    hashes = mixed(words.span(words.rolling(words.data), words.start, words.stop), 21)
    return hashes, np.concatenate([[0], np.cumsum(words.counts)])


def _free(marked: np.ndarray) -> np.ndarray:
    """Unmarked words from each position up to the next mark."""
    n = len(marked)
    stop = np.where(marked, np.arange(n), n)
    return np.minimum.accumulate(stop[::-1])[::-1] - np.arange(n)


def _matches(a: Rolled, b: Rolled, free_a: np.ndarray, free_b: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Maximal common stretches of ``length`` or more unmarked words: starts in a and b, and sizes."""
    at_a, at_b = np.flatnonzero(free_a >= length), np.flatnonzero(free_b >= length)
    if not len(at_a) or not len(at_b):
        return
    hash_a, hash_b = a.window(at_a, length), b.window(at_b, length)
    order = np.argsort(hash_b, kind="stable")
    at_b, hash_b = at_b[order], hash_b[order]
    low, high = np.searchsorted(hash_b, hash_a, "left"), np.searchsorted(hash_b, hash_a, "right")
    hit = high > low
    at_a, low, times = at_a[hit], low[hit], (high - low)[hit]
    total = np.concatenate([[0], np.cumsum(times)])
    row = 0
    while row < len(at_a):
        stop = max(int(np.searchsorted(total, total[row] + PAIR_BLOCK, "right")) - 1, row + 1)
        some = times[row:stop]
        i = np.repeat(at_a[row:stop], some)
        j = at_b[np.repeat(low[row:stop] - total[row:stop], some) + np.arange(total[row], total[stop])]
        row = stop
        inner = (i > 0) & (j > 0)
        inner[inner] = (free_a[i[inner] - 1] > 0) & (free_b[j[inner] - 1] > 0) & (a.words[i[inner] - 1] == b.words[j[inner] - 1])
        i, j = i[~inner], j[~inner]
        size, most = np.full(len(i), length), np.minimum(free_a[i], free_b[j])
        while (size < most).any():  # the largest size with equal hashes, by bisection
            middle = (size + most + 1) // 2
            same = a.window(i, middle) == b.window(j, middle)
            size, most = np.where(same, middle, size), np.where(same, most, middle - 1)
        yield i, j, size


def tile(text: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (start in text, start in item, words) between two sequences of word hashes."""
    a, b = Rolled(text), Rolled(item)
    mark_a, mark_b = np.zeros(len(text), bool), np.zeros(len(item), bool)
    tiles: list[tuple[int, int, int]] = []
    length = max(least, min(FIRST_LENGTH, len(item)))
    while True:
        found = list(_matches(a, b, _free(mark_a), _free(mark_b), length))
        longest = max((int(size.max()) for *_, size in found if len(size)), default=0)
        if longest > 2 * length:
            length = longest
            continue
        heap = [(-s, j, i) for i_, j_, size in found for i, j, s in zip(i_.tolist(), j_.tolist(), size.tolist())]
        heapq.heapify(heap)
        while heap:
            size, j, i = heapq.heappop(heap)
            size = -size
            blocked = mark_a[i : i + size] | mark_b[j : j + size]
            if not blocked.any():
                if (text[i : i + size] == item[j : j + size]).all():
                    tiles.append((i, j, size))
                    mark_a[i : i + size] = mark_b[j : j + size] = True
                continue
            edge = np.diff(np.concatenate([[1], blocked, [1]]).astype(np.int8))
            for begin, end in zip(np.flatnonzero(edge == -1).tolist(), np.flatnonzero(edge == 1).tolist()):
                if end - begin >= length:
                    heapq.heappush(heap, (begin - end, j + begin, i + begin))
        if length == least:
            return sorted(tiles)
        length = max(least, length // 2)


class Index:
    """Seeds of a block of test items."""

    def __init__(self, items: list[tuple[int, bytes]], least: int, coverage: float):
        self.ids = [i for i, _ in items]
        self.coverage, self.least = coverage, least
        hashes, starts = tokens([t for _, t in items])
        self.items = [hashes[a:z] for a, z in zip(starts[:-1], starts[1:])]
        self.size = np.diff(starts)
        self.width = {}
        #: Items shorter than a tile are sought as a whole, by windows of their own length.
        for width in sorted({min(least, int(n)) for n in self.size if n}):
            own = np.flatnonzero(self.size == width) if width < least else np.flatnonzero(self.size >= least)
            seeds = [(self._windows(self.items[k], width), np.full(self.size[k] - width + 1, k), np.arange(self.size[k] - width + 1)) for k in own]
            seed, item, at = (np.concatenate(x) for x in zip(*seeds))
            order = np.argsort(seed, kind="stable")
            seed, item, at = seed[order], item[order], at[order]
            bitmap = np.zeros(1 << _BITMAP, bool)
            bitmap[self._bit(seed)] = True
            self.width[width] = seed, item, at, bitmap

    @staticmethod
    def _windows(words: np.ndarray, width: int) -> np.ndarray:
        return mixed(Rolled(words).window(np.arange(len(words) - width + 1), width), 22)

    @staticmethod
    def _bit(hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - _BITMAP)).astype(np.int64)

    def _candidates(self, hashes: np.ndarray, starts: np.ndarray) -> list[tuple[int, int]]:
        """(text, item) pairs whose seeds cover enough of the item."""
        out: list[tuple[int, int]] = []
        text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        for width, (seed, item, at, bitmap) in self.width.items():
            if len(hashes) < width:
                continue
            window = self._windows(hashes, width)
            here = np.flatnonzero(bitmap[self._bit(window)])
            here = here[text[here] == text[here + width - 1]]
            low = np.searchsorted(seed, window[here], "left")
            ok = seed[np.minimum(low, len(seed) - 1)] == window[here]
            if not ok.any():
                continue
            pairs = np.unique(text[here[ok]] * np.int64(len(seed)) + low[ok])  # a seed once per text
            of, low = pairs // len(seed), pairs % len(seed)
            times = np.searchsorted(seed, seed[low], "right") - low
            k = np.repeat(low - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
            of = np.repeat(of, times)
            order = np.lexsort((at[k], item[k], of))
            of, k = of[order], k[order]
            same = np.append((of[1:] == of[:-1]) & (item[k][1:] == item[k][:-1]), False)
            covers = np.full(len(k), width)
            covers[:-1][same[:-1]] = np.minimum(width, np.diff(at[k])[same[:-1]])
            last = np.flatnonzero(~same)
            total = np.diff(np.concatenate([[0], np.cumsum(covers)[last]]))
            enough = total >= self.coverage * self.size[item[k[last]]]
            out.extend(zip(of[last][enough].tolist(), item[k[last]][enough].tolist()))
        return out

    def find(self, texts: list[bytes]) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
        """(index of the text, index of the item, tiles) for each contaminated pair."""
        hashes, starts = tokens(texts)
        for text, item in self._candidates(hashes, starts):
            tiles = tile(hashes[starts[text] : starts[text + 1]], self.items[item], min(self.least, int(self.size[item])))
            if sum(size for *_, size in tiles) >= self.coverage * self.size[item]:
                yield text, item, tiles


def _blocks(benchmark: DataFrame, item_key: str, text: str) -> list[tuple[str, ...]]:
    """Groups of files in the shared folder, each with test items of about ``BLOCK_BYTES``.

    Workers read a block themselves: no item passes through the driver or a broadcast.
    """
    raw = benchmark.where(F.col(text).isNotNull()).select(F.col(item_key).alias("item"), F.encode(text, "UTF-8").alias("text"))
    size = raw.agg(F.sum(F.octet_length("text"))).first()[0]
    if not size:
        return []
    parts = math.ceil(size / BLOCK_BYTES)
    files = sorted(stage(raw.repartition(FILES_A_BLOCK * parts, "item", "text"), "benchmark").inputFiles())
    return [block for i in range(parts) if (block := tuple(files[i::parts]))]


@lru_cache(maxsize=1)
def _index(files: tuple[str, ...], least: int, coverage: float) -> Index:
    """The index of one block; a worker process keeps one."""
    items: list[tuple[int, bytes]] = []
    for file in files:
        system, path = file_system(file)
        with system.open_input_file(path) as source:
            table = pq.read_table(source)
        items.extend(zip(table["item"].to_pylist(), table["text"].to_pylist()))
    return Index(items, least, coverage)


def contaminated(df: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item_key: str = "item_id", item_text: str = "text", least: int = LEAST_TILE, coverage: float = LEAST_COVERAGE) -> DataFrame:
    """One row per document and test item of which tiles cover ``coverage``: ``key``, ``item_key``,
    ``item_words``, ``covered_words``, ``coverage``, ``tiles`` (starts in words, and sizes).

    Whole texts, no shuffle: the documents pass the benchmark block by block. Words are runs of
    letters and digits, lower-cased. Items of fewer than ``least`` words must occur whole; items and
    documents without words (null, empty) match nothing. Repeated items and repeated documents each
    give their rows; a null key is kept. Empty tables give no rows; other columns are ignored.
    """
    part = T.StructType([T.StructField(n, T.IntegerType()) for n in ("text_start", "item_start", "words")])
    schema = T.StructType(
        [df.schema[key], T.StructField(item_key, benchmark.schema[item_key].dataType), T.StructField("item_words", T.LongType()), T.StructField("covered_words", T.LongType()),
         T.StructField("coverage", T.DoubleType()), T.StructField("tiles", T.ArrayType(part))]
    )
    tile_type = pa.list_(pa.struct([(n, pa.int32()) for n in ("text_start", "item_start", "words")]))

    def search(block: tuple[str, ...]):
        @tidy
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = _index(block, least, coverage)
            for batch in batches:
                first, rows = 0, []
                for part in chunks(list(row_bytes(*utf8(batch.column(1))))):
                    rows.extend((first + t, i, tiles) for t, i, tiles in index.find(part))
                    first += len(part)
                if not rows:
                    continue
                words = [int(index.size[i]) for _, i, _ in rows]
                covered = [sum(size for *_, size in tiles) for *_, tiles in rows]
                dicts = [[{"text_start": a, "item_start": b, "words": s} for a, b, s in tiles] for *_, tiles in rows]
                columns = [batch.column(0).take(pa.array([t for t, *_ in rows])), pa.array([index.ids[i] for _, i, _ in rows], item_arrow), pa.array(words, pa.int64()), pa.array(covered, pa.int64())]
                columns += [pa.array([c / w for c, w in zip(covered, words)], pa.float64()), pa.array(dicts, tile_type)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

        return run

    from pyspark.sql.pandas.types import to_arrow_type

    item_arrow, names = to_arrow_type(benchmark.schema[item_key].dataType), [f.name for f in schema]
    out = df.sparkSession.createDataFrame([], schema)
    found = None
    for block in _blocks(benchmark, item_key, item_text):
        own = df.select(key, text).mapInArrow(search(block), schema)
        found = own if found is None else found.unionByName(own)
    return out if found is None else found


def decontaminate(df: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", least: int = LEAST_TILE, coverage: float = LEAST_COVERAGE) -> DataFrame:
    """The rows of ``df``, all columns, without those that hold a test item as ``contaminated`` finds.

    Rows with a null or empty text stay; repeated rows stay or go together; an empty benchmark changes
    nothing, an empty table gives no rows; columns of any name pass. What one block leaves is written
    before the next is taken, so a task never holds more than one.
    """

    def keep(block: tuple[str, ...]):
        @tidy
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = _index(block, least, coverage)
            for batch in batches:
                first, clean = 0, np.ones(batch.num_rows, bool)
                for part in chunks(list(row_bytes(*utf8(batch.column(text))))):
                    for t, _, _ in index.find(part):
                        clean[first + t] = False
                    first += len(part)
                yield batch.filter(pa.array(clean))

        return run

    for i, block in enumerate(_blocks(benchmark, item_key, item_text)):
        df = (stage(df, "decontaminated") if i else df).mapInArrow(keep(block), df.schema)
    return df
