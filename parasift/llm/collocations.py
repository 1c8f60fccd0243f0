"""Phrases of two to four words that belong together, by language.

Words are counted first; those in enough places make a dictionary of numbers in byte order. Pieces of text are broken
at all other words, as no frequent phrase holds one. From each place of what is left the next four words, or
as many as the piece has, become one fixed-width binary key. A worker sorts the keys of a run of texts by radix and
counts equal ones; the keys are dealt out by ranges of their values, sorted there, and the lengths of runs of keys
that begin alike are the phrases' counts: the one key of a place counts for its two, three and four words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parasift.llm.common import file_system, row_chunks, small_table, stage, tidy, utf8

#: Words in the longest phrase, and bytes of a word's number in a key.
MOST_WORDS, WIDTH = 4, 5
#: Bytes of text whose words are counted, or whose keys are sorted, together (or one longer text).
BATCH_BYTES = 4 << 20
#: Words of the dictionary that a worker holds at a time; more are looked up block by block.
WORDS_A_BLOCK = 1 << 20
# Bytes that end a piece, and those between words.
BREAKS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
UNKNOWN_LANGUAGE = "und"

_KIND = np.zeros(256, np.uint8)
_KIND[list(BREAKS)], _KIND[list(BLANKS)] = 2, 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words:
    """The words of a run of texts as one dictionary-encoded array: for each its number, its text, and whether it
    begins a piece."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        data = _LOWER[data]
        kind = _KIND[data]
        inside = kind == 0
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        first[offsets[:-1][offsets[:-1] < len(data)]] = True
        first &= inside
        begins = np.flatnonzero(first)
        self.row = np.searchsorted(offsets, begins, "right") - 1
        sizes = np.diff(np.append(np.cumsum(inside)[begins] - 1, inside.sum()))
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        raw = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(bounds.astype(np.int64).tobytes()), pa.py_buffer(data[inside].tobytes())])
        coded = pc.dictionary_encode(raw)
        self.words, self.number = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        breaks = np.cumsum(kind == 2)[begins]
        self.opens = np.ones(len(begins), bool)
        self.opens[1:] = (breaks[1:] != breaks[:-1]) | (self.row[1:] != self.row[:-1])


def language(lang: Column) -> Column:
    return F.coalesce(lang.cast("string"), F.lit(UNKNOWN_LANGUAGE))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[str], Words]]:
    """Of batches (lang, text), run by run: each word's language by number, the languages, the words."""
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        coded = batch.column(0).dictionary_encode()
        of_row, names = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()
        for first, stop in row_chunks(offsets, BATCH_BYTES):
            part = offsets[first : stop + 1]
            words = Words(data[part[0] : part[-1]], part - part[0])
            if len(words.number):
                yield of_row[first:stop][words.row], names, words


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) over all words of ``docs`` (lang, text); runs of texts are counted before the shuffle. ``word`` is
    bytes."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, names, words in _runs(batches):
            pairs, n = np.unique(lang * len(words.words) + words.number, return_counts=True)
            word = words.words.take(pa.array(pairs % len(words.words))).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()).take(pa.array(pairs // len(words.words))), word, pa.array(n.astype(np.int64))], names=["lang", "word", "n"])

    return docs.mapInArrow(run, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def numbered(words: DataFrame) -> DataFrame:
    """A staged table with ``id``: numbers from one without gaps, by file and row. The driver sees a count a file."""
    placed = words.withColumn("__file", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    placed = stage(placed, "words")
    begin, rows = 1, []
    for file, count in sorted((r["__file"], r["count"]) for r in placed.groupBy("__file").count().collect()):
        rows.append({"__file": file, "__begin": begin})
        begin += count
    if begin > 1 << 8 * WIDTH:
        raise ValueError(f"word numbers of over {WIDTH} bytes")
    starts = small_table(words.sparkSession, rows, "__file: int, __begin: bigint") if rows else placed.select("__file", F.lit(0).cast("long").alias("__begin"))
    return placed.join(F.broadcast(starts), "__file").select(*words.columns, (F.col("__row") + F.col("__begin")).alias("id"))


@lru_cache(maxsize=1)
def _dictionary(file: str) -> dict[str, tuple[pa.Array, np.ndarray]]:
    """Words and numbers of one block, by language; a worker process keeps one block."""
    system, path = file_system(file)
    with system.open_input_file(path) as source:
        table = pq.read_table(source, columns=["lang", "word", "id"]).combine_chunks()
    out = {}
    for lang in pc.unique(table["lang"]).to_pylist():
        own = table.filter(pc.equal(table["lang"], lang))
        out[lang] = own["word"].combine_chunks().cast(pa.large_binary()), own["id"].to_numpy()
    return out


def numbers_of(lang: np.ndarray, names: list[str], words: Words, files: list[str]) -> np.ndarray:
    """Each word's number in the dictionary of its language, zero where it has none."""
    out = np.zeros(len(words.number), np.int64)
    for at in np.unique(lang).tolist():
        here = np.flatnonzero(lang == at)
        seen = np.unique(words.number[here])
        asked, ids = words.words.take(pa.array(seen)), np.zeros(len(seen), np.int64)
        for file in files:
            known = _dictionary(file).get(names[at])
            if known is not None:
                place = pc.index_in(asked, value_set=known[0]).fill_null(-1).to_numpy(zero_copy_only=False)
                ids[place >= 0] = known[1][place[place >= 0]]
        whole = np.zeros(len(words.words), np.int64)
        whole[seen] = ids
        out[here] = whole[words.number[here]]
    return out


def radix_order(columns: list[np.ndarray]) -> np.ndarray:
    """The order of rows of non-negative integers below 2**40, the first column first: least digit first, by sixteen bits,
    each pass a stable counting sort."""
    order = np.arange(len(columns[0]))
    for column in reversed(columns):
        for shift in range(0, 8 * WIDTH, 16):
            digit = (column >> shift & 0xFFFF).astype(np.uint16)
            if digit.any():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def pack(columns: list[np.ndarray]) -> np.ndarray:
    """Keys of ``WIDTH`` bytes a word, the highest byte first: they compare as bytes as the words' numbers do."""
    return np.concatenate([c.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - WIDTH :] for c in columns], axis=1)


def window_keys(docs: DataFrame, files: list[str]) -> DataFrame:
    """(``key``, ``n``): how often a run of texts holds a window of two to four words of the dictionary, the rest of the key
    zero. A window ends at the piece's end or before a word without a number."""
    size = MOST_WORDS * WIDTH

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, names, words in _runs(batches):
            ids = numbers_of(lang, names, words, files)
            stretch = np.cumsum(words.opens | (ids == 0))
            columns, last = [ids], len(ids)
            for k in range(1, MOST_WORDS):
                column = np.zeros(last, np.int64)
                column[: last - k] = np.where(stretch[k:] == stretch[: last - k], ids[k:], 0)
                columns.append(column)
            whole = (ids > 0) & (columns[1] > 0)
            columns = [c[whole] for c in columns]
            order = radix_order(columns)
            keys = pack([c[order] for c in columns]).view(f"V{size}").ravel()
            if not len(keys):
                continue
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            n = np.diff(np.append(first, len(keys)))
            binary = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((size * np.arange(len(first) + 1)).astype(np.int32).tobytes()), pa.py_buffer(keys[first].tobytes())])
            yield pa.RecordBatch.from_arrays([binary, pa.array(n.astype(np.int64))], names=["key", "n"])

    return docs.mapInArrow(run, "key binary, n long")


def run_lengths(keys: DataFrame, least: int) -> DataFrame:
    """(``key``, ``n``) of all phrases with ``least`` or more places, from windows (``key``, ``n``).

    Ranges of keys, each sorted. Within a range the runs are whole but for the first and the last of each phrase size,
    which a neighbour may share: those are given as they are and added up; of the others the rare ones go at once.
    """
    size = MOST_WORDS * WIDTH

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, int] | None] = [None] * (MOST_WORDS + 1)  # the run under way, by words
        opened = [False] * (MOST_WORDS + 1)  # whether an earlier run of the range has ended

        def told(words: int, keys: np.ndarray, n: np.ndarray, final: bool) -> tuple[np.ndarray, np.ndarray]:
            """Ended runs to be given, as keys and counts."""
            if held[words] is not None and len(keys) and held[words][0] == keys[0].tobytes():
                n[0] += held[words][1]
            elif held[words] is not None:
                keys, n = np.concatenate([np.frombuffer(held[words][0], f"V{size}"), keys]), np.concatenate([[held[words][1]], n])
            if not len(keys):
                return keys, n
            held[words] = None if final else (keys[-1].tobytes(), int(n[-1]))
            keep = n >= least
            keep[0] |= not opened[words]
            keep[-1] = final
            opened[words] |= len(keys) > 1
            return keys[keep], n[keep]

        def given(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            keys, n = np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts])
            binary = pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer((size * np.arange(len(keys) + 1)).astype(np.int32).tobytes()), pa.py_buffer(keys.tobytes())])
            return pa.RecordBatch.from_arrays([binary, pa.array(n.astype(np.int64))], names=["key", "n"])

        none = np.zeros(0, f"V{size}"), np.zeros(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            raw, _ = utf8(batch.column(0))
            rows, n = raw.reshape(-1, size), batch.column(1).to_numpy()
            parts = []
            for words in range(2, MOST_WORDS + 1):
                some = rows[:, (words - 1) * WIDTH : words * WIDTH].any(axis=1)
                own = rows[some].copy()
                own[:, words * WIDTH :] = 0
                keys = own.view(f"V{size}").ravel()
                if len(keys):
                    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
                    parts.append(told(words, keys[first], np.add.reduceat(n[some], first), False))
            yield given([none, *parts])
        yield given([none, *(told(words, *none, True) for words in range(2, MOST_WORDS + 1))])

    sorted_keys = keys.repartitionByRange("key").sortWithinPartitions("key")
    return sorted_keys.mapInArrow(run, "key binary, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _part(key: Column, first: int, words: int) -> Column:
    """The key of the ``words`` words of ``key`` from the ``first`` on (from zero)."""
    own = F.substring(key, first * WIDTH + 1, words * WIDTH)
    return F.rpad(own, MOST_WORDS * WIDTH, F.lit(b"\x00"))


def _number(key: Column, at: int) -> Column:
    return F.conv(F.hex(F.substring(key, at * WIDTH + 1, WIDTH)), 16, 10).cast("long")


def _size(key: Column) -> Column:
    zero = F.lit(bytes(WIDTH))
    return F.when(F.substring(key, 3 * WIDTH + 1, WIDTH) != zero, 4).when(F.substring(key, 2 * WIDTH + 1, WIDTH) != zero, 3).otherwise(2)


def scored(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """``phrases`` (key, n) with ``a``, ``l``, ``r``, ``score`` of the cut that scores lowest, the first of equal ones;
    ``words`` (id, n) are the counts of single words. Parts of a phrase are found by joins on their keys."""
    key = F.col("key")
    id_key = F.unhex(F.lpad(F.hex("id"), 2 * WIDTH, "0"))
    counts = phrases.unionByName(words.select(F.rpad(id_key, MOST_WORDS * WIDTH, F.lit(b"\x00")).alias("key"), "n"))
    cut = lambda size, k: F.struct(F.lit(k).alias("k"), _part(key, 0, k).alias("left"), _part(key, k, size - k).alias("right"))
    cuts = F.when(_size(key) == 2, F.array(cut(2, 1))).when(_size(key) == 3, F.array(cut(3, 1), cut(3, 2))).otherwise(F.array(cut(4, 1), cut(4, 2), cut(4, 3)))
    every = phrases.select("key", F.col("n").alias("a"), F.explode(cuts).alias("c")).select("key", "a", "c.*")
    named = lambda side, out: counts.select(F.col("key").alias(side), F.col("n").alias(out))
    every = every.join(named("left", "l"), "left").join(named("right", "r"), "right")
    every = every.withColumn("score", F.expr("(cast(a as decimal(20,0)) * 2000000) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"))
    best = every.groupBy("key", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    return best.select("key", "a", "b.l", "b.r", "b.score")


def without_parts(scored: DataFrame, share: int = 80) -> DataFrame:
    """Without phrases of which a longer one that holds them has ``share`` hundredths of the places or more."""
    key = F.col("key")
    inner = F.when(_size(key) == 4, F.array(_part(key, 0, 3), _part(key, 1, 3), _part(key, 0, 2), _part(key, 1, 2), _part(key, 2, 2))).otherwise(F.array(_part(key, 0, 2), _part(key, 1, 2)))
    longer = scored.where(_size(key) > 2).select(F.explode(inner).alias("key"), "a").groupBy("key").agg(F.max("a").alias("__longer"))
    kept = scored.join(longer, "key", "left")
    ten = lambda c: c.cast("decimal(20,0)")
    return kept.where(F.col("__longer").isNull() | (ten(F.col("__longer")) * 100 < ten(F.col("a")) * share)).drop("__longer")


def collocations(df: DataFrame, text: str = "text", lang: str = "lang", least: int = 30, most: int = 2000, share: int = 80) -> DataFrame:
    """Each language's ``most`` best phrases of two to four words: ``lang``, ``rank`` from one, ``phrase``, ``a`` (its
    places), ``l``, ``r`` (those of its parts), ``n`` (the language's words), ``score``.

    Texts are lower-cased (A-Z), cut into pieces at ``BREAKS`` and into words at blanks. A phrase with ``least`` places is
    a candidate; its score is the lowest floor(2000000 a / (l + r)) of its cuts, the first of equal ones. Candidates
    inside a longer one with ``share`` hundredths of their places are dropped. Order: score, then places, falling, then
    the phrase's bytes. A null language is ``und``; null and empty texts and empty tables give no words; repeated
    rows count each time; other columns are ignored, whatever their names. No table of words or phrases passes through
    the driver.
    """
    docs = df.select(language(F.col(lang)).alias("lang"), F.col(text).alias("text"))
    counts = stage(word_counts(docs), "word-counts")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = counts.where(F.col("n") >= least)
    words = stage(numbered(frequent), "dictionary")
    blocks = max(1, -(-words.count() // WORDS_A_BLOCK))
    files = sorted(stage(words.repartition(blocks, "id"), "dictionary-blocks").inputFiles())
    phrases = stage(run_lengths(window_keys(docs, files), least), "phrases")
    kept = without_parts(stage(scored(phrases, words.select("id", "n")), "scored"), share)
    kept = kept.join(words.select(F.col("id").alias("__first"), "lang"), _number(F.col("key"), 0) == F.col("__first")).drop("__first")
    # The best of each language in as many parts as a shuffle has, ties included, so that none is sorted whole.
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("score").desc(), F.col("a").desc()]
    near = Window.partitionBy("lang", F.pmod(F.xxhash64("key"), F.lit(parts))).orderBy(*order)
    near = kept.withColumn("__rank", F.rank().over(near)).where(F.col("__rank") <= most).drop("__rank")
    spelt = near.select("*", F.posexplode(F.array(*(_number(F.col("key"), i) for i in range(MOST_WORDS)))).alias("__at", "id")).where("id > 0")
    spelt = spelt.join(words.select("id", F.decode("word", "UTF-8").alias("__word")), "id")
    spelt = spelt.groupBy("lang", "key", "a", "l", "r", "score").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__at", "__word"))), lambda w: w["__word"]), " ").alias("phrase"))
    last = Window.partitionBy("lang").orderBy(*order, "phrase")
    ranked = spelt.withColumn("rank", F.row_number().over(last).cast("long")).where(F.col("rank") <= most)
    return ranked.join(F.broadcast(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
