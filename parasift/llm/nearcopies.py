"""Near copies by similarity: texts whose sets of five-word shingles have a Jaccard index of 0.8 or more.

SimHash alone cannot serve here: at 0.8 two fingerprints of 64 bits differ in about ten, too many for any
prefix that splits a large table. So candidates are fingerprints that ``simhash.links`` finds within its
budget, and texts that share one of ``BANDS`` keys of ``ROWS`` least hashes each (MinHash): a pair at 0.8
is missed with a chance of 0.738 ^ 32, about 1 in 17,000, and one above it less often. Whole sets decide, so
every link is exact and no candidate is left out. Connected candidates meet in one task up to a bound. In a
larger group some texts at a time are pivots, which all others are held against where they lie; once every
text that no chain of links joins to the first pivot has been a pivot itself, all links that matter are known.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parasift.llm import simhash
from parasift.llm.common import file_system, row_bytes, row_chunks, stage, tidy, utf8
from parasift.llm.components import components

WORDS = 5
SIMILAR = 0.8
BANDS = 32
ROWS = 6
HASH_BLOCK = 1 << 9
#: The largest group of candidates that one task compares, in texts and in bytes.
GROUP_TEXTS, GROUP_BYTES = 1000, 16 << 20
#: Texts of larger groups, and their bytes, that all others are held against at a time.
MOST_PIVOTS, PIVOT_BYTES = 1024, 32 << 20
_ODD = np.random.default_rng(simhash.SEED).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.random.default_rng(simhash.SEED + 1).integers(0, 1 << 63, ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def bands(hashes: np.ndarray) -> np.ndarray:
    """One key a band for a set of shingle hashes; equal sets have equal keys."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), HASH_BLOCK):
        part = hashes[at : at + HASH_BLOCK, None] * _ODD
        np.minimum(least, part.min(axis=0), out=least)
    mixed = (least ^ least >> np.uint64(32)).reshape(BANDS, ROWS) * _MIX
    return np.bitwise_xor.reduce(mixed ^ mixed >> np.uint64(29), axis=1)


def linked(sets: list[np.ndarray]) -> np.ndarray:
    """For each set the first index that chains of similar sets lead to."""
    sizes = np.array([len(s) for s in sets])
    root = np.full(len(sets), -1)
    left, owners, hashes = np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.uint64)

    def index() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The sets without a root, and their hashes in order with the place of their set in ``left``."""
        left = np.flatnonzero(root < 0)
        owners = np.repeat(np.arange(len(left)), sizes[left])
        hashes = np.concatenate([np.zeros(0, np.uint64), *(sets[i] for i in left)])
        order = np.argsort(hashes, kind="stable")
        return left, owners[order], hashes[order]

    waiting = 0
    for first in range(len(sets)):
        if root[first] >= 0:
            continue
        root[first] = first
        queue = [first]
        waiting = int((root < 0).sum())
        while queue and waiting:
            if len(left) > 2 * waiting or not len(left):
                left, owners, hashes = index()
            at = queue.pop()
            a, z = np.searchsorted(hashes, sets[at]), np.searchsorted(hashes, sets[at], side="right")
            spans = z - a
            ends = np.cumsum(spans)
            places = np.arange(ends[-1] if len(ends) else 0) + np.repeat(a - ends + spans, spans)
            common = np.bincount(owners[places], minlength=len(left))
            union = sizes[left] + sizes[at] - common
            near = left[(root[left] < 0) & (common >= SIMILAR * union - 1e-9)]
            root[near] = first
            queue.extend(near.tolist())
            waiting -= len(near)
    return root


def text_id(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _marks(df: DataFrame, text: str, key: str) -> DataFrame:
    """``key``, the id of the text, its size, fingerprint and bands for each row."""
    schema = T.StructType([df.schema[key], T.StructField("row", T.LongType()), T.StructField("bytes", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            prints, keys = [], []
            for a, z in row_chunks(offsets, simhash.BATCH_BYTES):
                part = offsets[a : z + 1]
                for raw in row_bytes(data[part[0] : part[-1]], part - part[0]):
                    hashes = simhash.shingle_hashes(raw, WORDS)
                    prints.append(simhash.majority(hashes))
                    keys.append(bands(hashes))
            flat = pa.array(np.concatenate([np.zeros(0, np.uint64), *keys]).view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(offsets)), pa.array(np.array(prints, np.uint64).view(np.int64)), lists], names=schema.names)

    return df.select(key, text_id(F.col(text)).alias("row"), text).mapInArrow(run, schema)


def _candidates(nodes: DataFrame) -> DataFrame:
    """Edges (u, v) between texts that share a band or whose fingerprints are linked."""
    keyed = nodes.select("row", F.posexplode("bands").alias("band", "part")).select("row", F.xxhash64("band", "part").alias("k"))
    shared = keyed.groupBy("k").agg(F.min("row").alias("v"), F.max("row").alias("last")).where("v < last").drop("last")
    banded = keyed.join(shared, "k").select(F.col("row").alias("u"), "v")
    own = nodes.groupBy("fp").agg(F.min("row").alias("v"))
    same = nodes.join(own, "fp").select(F.col("row").alias("u"), "v")
    heads = lambda end, name: own.select(F.col("fp").alias(end), F.col("v").alias(name))
    near = simhash.links(nodes).select(F.col("u").alias("fu"), F.col("v").alias("fv"))
    near = near.join(heads("fu", "u"), "fu").join(heads("fv", "v"), "fv").select("u", "v")
    return banded.unionByName(same).unionByName(near).where("u <> v").distinct()


def _compare(frame: pd.DataFrame) -> pd.DataFrame:
    sets = [np.unique(simhash.shingle_hashes((t or "").encode(), WORDS)) for t in frame["text"]]
    rows = frame["row"].to_numpy()
    return pd.DataFrame({"row": rows, "group": rows[linked(sets)]})


def _alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Do two sorted sets have a Jaccard index of ``SIMILAR`` or more?"""
    if min(len(a), len(b)) < SIMILAR * max(len(a), len(b)) - 1e-9:
        return False
    common = np.isin(a, b, assume_unique=True).sum()
    return bool(common >= SIMILAR * (len(a) + len(b) - common) - 1e-9)


@lru_cache(maxsize=1)
def _pivots(files: tuple[str, ...]) -> dict[int, list[tuple[int, np.ndarray]]]:
    """The pivots' sets by group, from files that all workers share."""
    out: dict[int, list[tuple[int, np.ndarray]]] = {}
    for file in files:
        system, path = file_system(file)
        with system.open_input_file(path) as source:
            table = pq.read_table(source)
        for root, row, text in zip(*(table[c].to_pylist() for c in ("root", "row", "text"))):
            out.setdefault(root, []).append((row, np.unique(simhash.shingle_hashes((text or "").encode(), WORDS))))
    return out


def _held_against(files: tuple[str, ...]):
    """(u, v) of each text and pivot of its group that are alike."""

    @tidy
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pivots = _pivots(files)
        for frame in frames:
            found = []
            for root, row, text in zip(frame["root"], frame["row"], frame["text"]):
                if root in pivots:
                    own = np.unique(simhash.shingle_hashes((text or "").encode(), WORDS))
                    found.extend((row, pivot) for pivot, other in pivots[root] if pivot != row and _alike(own, other))
            yield pd.DataFrame(found, columns=["u", "v"], dtype="int64")

    return run


def _large_groups(texts: DataFrame) -> DataFrame:
    """(row, group) of ``texts`` (row, text, bytes, root), whose groups are too large for one task.

    Every round holds a bounded number of pivots against all texts; links, a row each at most for a text and
    pivot, and components of them are tables. A group whose texts are all like its first needs one round.
    """
    texts = stage(texts, "large-groups")
    heads = stage(texts.groupBy("root").agg(F.min("row").alias("first")), "large-heads")
    spark, edges = texts.sparkSession, None
    pending = heads.join(texts.select("row", "bytes"), F.col("first") == F.col("row")).select("root", "row", "bytes")
    used = spark.createDataFrame([], "row long")
    while True:
        offered = pending.orderBy("row").limit(MOST_PIVOTS).collect()
        if not offered:
            break
        total, chosen = 0, []
        for r in offered:
            total += r["bytes"]
            if chosen and total > PIVOT_BYTES:
                break
            chosen.append((r["row"],))
        now = spark.createDataFrame(chosen, "row long")  # MOST_PIVOTS rows at most
        files = tuple(sorted(stage(texts.join(F.broadcast(now), "row").select("root", "row", "text"), "pivots").inputFiles()))
        found = texts.select("root", "row", "text").mapInPandas(_held_against(files), "u long, v long")
        edges = stage(found if edges is None else edges.unionByName(found), "large-links")
        used = stage(used.unionByName(now), "pivots-used")
        stars = components(edges, "large")
        placed = texts.select("root", "row", "bytes").join(stars.withColumnRenamed("node", "row").withColumnRenamed("root", "group"), "row", "left")
        placed = stage(placed.withColumn("group", F.coalesce("group", "row")), "large-placed")
        main = heads.join(placed.select("row", "group"), F.col("first") == F.col("row")).select("root", F.col("group").alias("main"))
        pending = placed.join(main, "root").where("group <> main").join(used, "row", "left_anti").select("root", "row", "bytes")
        # The first pivots of groups that did not fit in this round are still to come.
        unheard = heads.join(used, F.col("first") == F.col("row"), "left_anti").select("root")
        pending = stage(pending.join(unheard, "root", "left_anti").unionByName(placed.join(unheard, "root").join(heads.select(F.col("first").alias("row")), "row").select("root", "row", "bytes")), "pending")
    return placed.select("row", "group")


def drop_near_copies(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``df`` but those whose text chains of similar texts link to one of lesser ``key``.

    Of each group the text of the least key stays, of several the one of the least hash; a null key comes
    last. Rows equal in key and text are one row. Texts of fewer than five words are one shingle; texts
    without words (null, empty, blank) are alike.
    """
    marks = stage(_marks(df, text, key), "marks")
    # A struct orders nulls first, so whether the key is null leads.
    owner = F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.col("row").alias("text"))).alias("owner")
    nodes = stage(marks.groupBy("row").agg(owner, F.first("bytes").alias("bytes"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "texts")
    stars = components(_candidates(nodes), "candidates")
    heads = stars.select(F.col("root").alias("node"), "root").distinct()
    members = stars.unionByName(heads).withColumnRenamed("node", "row")
    sized = members.join(nodes.select("row", "bytes"), "row")
    large = sized.groupBy("root").agg(F.count("*").alias("n"), F.sum("bytes").alias("size")).where((F.col("n") > GROUP_TEXTS) | (F.col("size") > GROUP_BYTES)).select("root", F.lit(True).alias("large"))
    sized = stage(sized.join(large, "root", "left").withColumn("large", F.coalesce("large", F.lit(False))), "candidates-sized")
    texts = df.select(text_id(F.col(text)).alias("row"), F.col(text).alias("text")).join(sized, "row").dropDuplicates(["row"])
    groups = texts.where("not large").select("row", "text", "root").groupBy("root").applyInPandas(_compare, "row long, group long")
    if sized.where("large").limit(1).count():
        groups = groups.unionByName(_large_groups(texts.where("large").select("row", "text", "bytes", "root")))
    placed = nodes.select("row", "owner").join(groups, "row", "left").withColumn("group", F.coalesce("group", "row"))
    first = stage(placed.groupBy("group").agg(F.min("owner").alias("owner")).select(F.col("owner.text").alias("__row"), F.col("owner.key").alias("__key")), "firsts")
    kept = df.withColumn("__row", text_id(F.col(text))).join(first, "__row").where(F.col(key).eqNullSafe(F.col("__key")))
    return kept.dropDuplicates([key, "__row"]).select(df.columns)
