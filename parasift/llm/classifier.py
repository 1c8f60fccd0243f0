"""Shared frame of the text classifiers: fitting on a bounded sample of labelled rows, scoring all rows.

Both classifiers are linear over hashed features and follow the regularised leader (FTRL-proximal).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parasift.llm.common import row_bytes, tidy, utf8
from parasift.llm.features import BITS, chunks

#: Features of a run of texts: index of the text, slot and value of each, sorted by text.
Featurize = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray, np.ndarray]]


@dataclass
class Ftrl:
    """FTRL-proximal over ``2**BITS`` slots and a bias in the last place."""

    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.05
    l2: float = 0.1
    size: int = (1 << BITS) + 1
    z: np.ndarray = field(init=False)
    n: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.z, self.n = np.zeros(self.size), np.zeros(self.size)
        self.penalty = np.full(self.size, self.l1)
        self.penalty[-1] = 0.0

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.penalty[at], 0.0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def update(self, at: np.ndarray, w: np.ndarray, gradient: np.ndarray) -> None:
        n = self.n[at]
        after = n + gradient * gradient
        self.z[at] += gradient - (np.sqrt(after) - np.sqrt(n)) / self.alpha * w
        self.n[at] = after


@dataclass(frozen=True)
class Model:
    """The weights that are not zero, at most one a slot, and the bias."""

    slots: np.ndarray
    values: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS)
        out[self.slots] = self.values
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def may_learn(key: str) -> "F.Column":
    """Rows whose labels may be learned from: two of three, by the key's checksum."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 3 != 1


def labelled_sample(df: DataFrame, labels: DataFrame, label: str, text: str, key: str, most: int) -> DataFrame:
    """(text, y, turn) of at most ``most`` labelled rows, chosen and ordered by a hash of the key.

    Rows with a null key, label or text are no examples; several labels of one key count as their
    maximum, and of several texts of one key the least counts, so copies of a key add nothing. ``most`` bounds what
    the join broadcasts and what is learned from.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & may_learn(key)).groupBy(key).agg(F.max(label).cast("int").alias("__y"))
    turn = F.xxhash64(F.lit(7), F.col(key))
    few = known.withColumn("__turn", turn).orderBy("__turn", key).limit(most).withColumnRenamed(key, "__key")
    texts = df.where(F.col(text).isNotNull()).select(F.col(key).alias("__key"), F.col(text).alias("text"))
    found = texts.join(F.broadcast(few), "__key").groupBy("__key", "__y", "__turn").agg(F.min("text").alias("text"))
    return found.select("text", F.col("__y").alias("y"), F.col("__turn").alias("turn"))


def fit(sample: DataFrame, featurize: Callable[[list[bytes]], list[dict]], train: Callable[[pd.DataFrame], Model]) -> Model:
    """Featurise the sample where it lies, train in one task, return the bounded model."""
    names = list(featurize([b""])[0])
    schema = T.StructType(
        [T.StructField("turn", T.LongType()), T.StructField("y", T.IntegerType()), *(T.StructField(n, T.BinaryType()) for n in names)]
    )

    @tidy
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[dict] = []
            for part in chunks(list(row_bytes(*utf8(batch.column("text"))))):
                rows.extend(featurize(part))
            columns = [pa.array([r[n] for r in rows], pa.binary()) for n in names]
            yield pa.RecordBatch.from_arrays([batch.column("turn"), batch.column("y"), *columns], names=["turn", "y", *names])

    @tidy
    def learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(frames)
        if held:
            model = train(pd.concat(held, ignore_index=True))
            yield pd.DataFrame({"slots": [model.slots.astype(np.int32).tobytes()], "weights": [model.values.tobytes()], "bias": [model.bias]})

    order = ["turn", "y", *names]
    ready = sample.select("text", "y", "turn").mapInArrow(features, schema).repartition(1).sortWithinPartitions(*order)
    found = ready.mapInPandas(learn, "slots binary, weights binary, bias double").take(1)
    if not found:
        return Model(np.zeros(0, np.int64), np.zeros(0), 0.0)
    row = found[0]
    return Model(np.frombuffer(row["slots"], np.int32).astype(np.int64), np.frombuffer(row["weights"]), row["bias"])


def score_rows(df: DataFrame, model: Model, logits: Callable[[list[bytes], np.ndarray], np.ndarray], text: str, key: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``key`` (and ``keep``) with ``score`` in 0..1 of each row's whole text; a null text is empty."""
    names = [key, *keep]
    schema = T.StructType([*(df.schema[n] for n in names), T.StructField("score", T.DoubleType(), False)])
    at = names.index(text) if text in names else len(names)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = model.dense()
        for batch in batches:
            raw = list(row_bytes(*utf8(batch.column(at))))
            scores = [sigmoid(logits(part, weights) + model.bias) for part in chunks(raw)]
            own = [batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*own, pa.array(np.concatenate(scores) if scores else np.zeros(0))], names=[*names, "score"])

    return df.select(*names, *([] if text in names else [text])).mapInArrow(run, schema)
