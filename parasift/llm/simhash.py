"""SimHash fingerprints, and near-duplicate groups by a binary-trie self-join.

A fingerprint's 64 bits are four blocks of 16. Two fingerprints with at most two differing bits agree in
at least two blocks, so each of the six ways to put two blocks first gives a trie whose first 32 levels
have no error left to spend; its sub-tries are independent and are dealt out by that prefix. Within a
sub-trie the join descends pairs of nodes together, level by level, adds the bits in which they differ,
and drops a pair once it has spent more than the budget.

A sub-trie of over ``HOT_TRIE`` fingerprints (large groups of near copies) is not given to one task: its
nodes ``SPLIT`` levels down are paired with all nodes whose path differs within the budget, and each node
pair, with the bits it has spent, is dealt out as a task of its own. Pairs that are still hot are split
again; after 32 bits none can be.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parasift.llm.common import join_counted, row_bytes, row_chunks, stage, tidy, utf8
from parasift.llm.components import components

SEED = 42
BUDGET = 2
HOT_TRIE = 1024
SPLIT = 8
BATCH_BYTES = 4 << 20
SHINGLE_BLOCK = 1 << 15
#: Fingerprints that a task joins at a time (whole node pairs, so up to HOT_TRIE more).
JOIN_ROWS = 200_000
_PAIRS = [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]


def shingle_hashes(text: bytes, words_in: int) -> np.ndarray:
    """Hashes of each run of ``words_in`` words, or of all words of a shorter text."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    width = min(words_in, len(words))
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:z], SEED) for a, z in spans), np.uint64, len(words) - width + 1)


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of ``hashes`` have; 0 for none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), SHINGLE_BLOCK):
        bits = np.unpackbits(hashes[at : at + SHINGLE_BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, words_in: int = 3) -> int:
    """Majority bits of the shingles' hashes; 0 for a text without words."""
    return majority(shingle_hashes(text, words_in))


def fingerprints(df: DataFrame, text: str = "text", key: str = "doc_id", words_in: int = 3) -> DataFrame:
    """``key`` and ``fp`` (the 64 bits as a signed long) of each row; a null text counts as empty."""
    schema = T.StructType([df.schema[key], T.StructField("fp", T.LongType(), False)])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            out = []
            for a, z in row_chunks(offsets, BATCH_BYTES):
                part = offsets[a : z + 1]
                out.extend(fingerprint(raw, words_in) for raw in row_bytes(data[part[0] : part[-1]], part - part[0]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(out, np.uint64).view(np.int64))], names=[key, "fp"])

    return df.select(key, text).mapInArrow(run, schema)


def trie_pairs(keys: np.ndarray, nodes: tuple[np.ndarray, ...], levels: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of ``keys`` that differ in at most ``budget`` of their low ``levels`` bits, below pairs of
    trie nodes. A node is a range of sorted ``keys``; ``nodes`` are the ends of the first and of the second
    node of each pair and the bits it has spent. A node paired with itself gives each pair of keys once."""
    a_lo, a_hi, b_lo, b_hi, spent = nodes
    several = (a_lo != b_lo) | (a_hi - a_lo > 1)
    a_lo, a_hi, b_lo, b_hi, spent = (x[several] for x in nodes)
    for level in range(levels - 1, -1, -1):
        if not len(a_lo):
            break
        ones = np.concatenate([[0], np.cumsum((keys >> np.uint64(level)) & np.uint64(1))]).astype(np.int64)
        a_mid = a_hi - (ones[a_hi] - ones[a_lo])
        b_mid = b_hi - (ones[b_hi] - ones[b_lo])
        same = a_lo == b_lo
        parts = [
            (a_lo, a_mid, b_lo, b_mid, spent, np.ones(len(a_lo), bool)),
            (a_mid, a_hi, b_mid, b_hi, spent, np.ones(len(a_lo), bool)),
            (a_lo, a_mid, b_mid, b_hi, spent + 1, np.ones(len(a_lo), bool)),
            (a_mid, a_hi, b_lo, b_mid, spent + 1, ~same),
        ]
        kept = []
        for al, ah, bl, bh, s, here in parts:
            alone = (al == bl) & (ah - al < 2)
            here = here & (ah > al) & (bh > bl) & (s <= budget) & ~alone
            kept.append((al[here], ah[here], bl[here], bh[here], s[here]))
        a_lo, a_hi, b_lo, b_hi, spent = (np.concatenate(x) for x in zip(*kept))
    return a_lo, b_lo


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index that each of ``n`` nodes reaches over the edges."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        if (root == before).all():
            break
    return root


_NODES = ["way", "prefix", "a", "b"]


def _join_nodes(levels: int):
    """Edges to the least fingerprint of each linked set below the node pairs that a task gets in order."""

    def edges(frame: pd.DataFrame) -> pd.DataFrame:
        pair = frame[_NODES].to_numpy()
        first = np.flatnonzero(np.append(True, (pair[1:] != pair[:-1]).any(axis=1)))
        end = np.append(first[1:], len(pair))
        side = np.concatenate([[0], np.cumsum(frame["side"].to_numpy())])
        middle = end - (side[end] - side[first])  # where the second node's keys begin
        alone = pair[first, 2] == pair[first, 3]
        nodes = first, np.where(alone, end, middle), np.where(alone, first, middle), end, frame["spent"].to_numpy()[first].astype(np.int64)
        a, b = trie_pairs(frame["rest"].to_numpy().astype(np.uint64), nodes, levels, BUDGET)
        fp = frame["fp"].to_numpy()
        root = _roots(len(fp), a, b)
        other = root != np.arange(len(fp))
        return pd.DataFrame({"u": fp[other], "v": fp[root[other]]})

    @tidy
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for frame in frames:
            held.append(frame)
            if sum(map(len, held)) < JOIN_ROWS:
                continue
            whole = pd.concat(held, ignore_index=True)
            tail = (whole[_NODES] == whole[_NODES].iloc[-1]).all(axis=1).to_numpy()
            yield edges(whole[~tail].reset_index(drop=True))
            held = [whole[tail]]
        if held:
            yield edges(pd.concat(held, ignore_index=True))

    return run


def _split(hot: DataFrame, levels: int) -> DataFrame:
    """The node pairs ``SPLIT`` levels further down, ``levels`` above the keys: a key goes to the pairs of its
    own node with each that its pair's budget still reaches."""
    masks = sorted((m for m in range(1 << SPLIT) if m.bit_count() <= BUDGET), key=int.bit_count)
    reached = F.filter(F.array(*(F.lit(m).cast("long") for m in masks)), lambda m: F.bit_count(m) + F.col("spent") <= BUDGET)
    spread = hot.select("*", F.shiftright("rest", levels).alias("x"), F.explode(reached).alias("mask"))
    x, y, alone, first = F.col("x"), F.col("x").bitwiseXOR(F.col("mask")), F.col("a") == F.col("b"), F.col("side") == 0
    down = lambda path, step: F.shiftleft(path, SPLIT).bitwiseOR(step)
    return spread.select(
        "fp", "way", "prefix",
        down(F.col("a"), F.when(alone, F.least(x, y)).when(first, x).otherwise(y)).alias("a"),
        down(F.col("b"), F.when(alone, F.greatest(x, y)).when(first, y).otherwise(x)).alias("b"),
        F.when(alone, (x > y).cast("int")).otherwise(F.col("side")).alias("side"),
        (F.col("spent") + F.bit_count("mask")).cast("int").alias("spent"),
        F.col("rest").bitwiseAND(F.lit((1 << levels) - 1)).alias("rest"),
    )


def links(fps: DataFrame) -> DataFrame:
    """Edges (u, v) that connect exactly the fingerprints of column ``fp`` which chains of links of at
    most ``BUDGET`` differing bits connect."""
    block = lambda i: F.shiftrightunsigned("fp", 16 * (3 - i)).bitwiseAND(F.lit(0xFFFF))
    joined = lambda i, j: F.shiftleft(block(i), 16).bitwiseOR(block(j))
    ways = []
    for way, (i, j) in enumerate(_PAIRS):
        k, m = (x for x in range(4) if x not in (i, j))
        ways.append(F.struct(F.lit(way).alias("way"), joined(i, j).alias("prefix"), joined(k, m).alias("rest")))
    keyed = fps.select("fp").distinct().select("fp", F.explode(F.array(*ways)).alias("k")).select("fp", "k.*")
    zero = F.lit(0).cast("long")
    now = keyed.select("fp", "way", "prefix", zero.alias("a"), zero.alias("b"), F.lit(0).alias("side"), F.lit(0).alias("spent"), "rest")
    found, levels = [], 32
    while True:
        sizes = now.groupBy(*_NODES).agg(F.count("*").alias("n"), F.min("side").alias("least"), F.max("side").alias("most"))
        sizes = sizes.where((F.col("n") > 1) & ((F.col("a") == F.col("b")) | (F.col("least") < F.col("most")))).drop("least", "most")
        shared = stage(now.join(sizes, _NODES), "tries")
        deepest = levels <= SPLIT
        mild = F.lit(deepest) | (F.col("n") <= HOT_TRIE)
        dealt = shared.where(mild).drop("n").repartition(*_NODES).sortWithinPartitions(*_NODES, "side", "rest")
        found.append(dealt.mapInPandas(_join_nodes(levels), "u long, v long"))
        hot = shared.where(~mild).drop("n")
        if deepest or not hot.limit(1).count():
            break
        levels -= SPLIT
        now = _split(hot, levels)
    edges = found[0]
    for more in found[1:]:
        edges = edges.unionByName(more)
    return edges.distinct()


def near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id", words_in: int = 3) -> DataFrame:
    """``key``, ``fp``, ``component_id`` of each row of ``df``.

    ``component_id`` is the least ``key`` among the rows that chains of linked fingerprints reach. Equal
    fingerprints are one node of the graph, so copies and repeated rows cost no links. Texts without
    words (null, empty, blank) have fingerprint zero and are linked like any other. Rows with a null
    ``key`` are fingerprinted and keep their component, whose id is null if no row in it has a key.
    An empty table gives no rows; other columns are ignored.
    """
    prints = stage(fingerprints(df, text, key, words_in), "fps")
    own = prints.groupBy("fp").agg(F.min(key).alias("least"), F.count("*").alias("rows"))
    stars = components(links(prints), "simhash")
    rooted = own.join(stars.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    member = stage(rooted.select("fp", "root", "rows").join(least, "root").select("fp", "rows", "component_id"), "members")
    return join_counted(prints, member, ["fp"], "rows").select(key, "fp", "component_id")
