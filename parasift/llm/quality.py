"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

Words are what white space separates. Features are word unigrams and bigrams, and unigrams and bigrams
of word shapes (the classes of a word's last three bytes, and whether it repeats one of the two words
before it), each as a share of the text's words. A score is one sparse dot product.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from parasift.llm import classifier
from parasift.llm.features import BITS, Words, slot

#: Bound of the labelled sample, in rows.
MOST_EXAMPLES = 16_000
EPOCHS = 3
#: Shares are small numbers; this brings them to the scale of the bias.
SCALE = 8.0
_WORD = np.ones(256, bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123] = _CLASS[65:91] = _CLASS[128:] = 97
_CLASS[48:58] = 48


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text index, slot and word count of the text for each occurrence of a feature."""
    words = Words(texts, _WORD)
    n = len(words.start)
    lower = words.rolling(_LOWER[words.data])
    own = words.span(lower, words.start, words.stop)
    shape = words.span(words.rolling(_CLASS[words.data]), np.maximum(words.start, words.stop - 3), words.stop)
    same = np.zeros(n, np.uint64)
    for back in (1, 2):
        again = (own[back:] == own[: n - back]) & (words.text[back:] == words.text[: n - back])
        same[back:] += again.astype(np.uint64) << np.uint64(back - 1)
    shape = shape * np.uint64(5) + same
    pair = words.text[1:] == words.text[:-1]
    left, right, both = np.flatnonzero(pair), np.flatnonzero(pair) + 1, words.text[1:][pair]
    odd = np.uint64(0x9E3779B97F4A7C15)
    slots = [slot(own, 1), slot(shape, 3), slot(own[left] * odd + own[right], 2), slot(shape[left] * odd + shape[right], 4)]
    index = np.concatenate([words.text, words.text, both, both])
    return index, np.concatenate(slots), words.counts


def _rows(texts: list[bytes]) -> list[dict]:
    index, slots, counts = features(texts)
    keys, times = np.unique(index << BITS | slots, return_counts=True)
    index, slots = keys >> BITS, keys & (1 << BITS) - 1
    values = (SCALE * times / counts[index]).astype(np.float32)
    cuts = np.searchsorted(index, np.arange(len(texts) + 1))
    return [{"slots": slots[a:z].astype(np.int32).tobytes(), "values": values[a:z].tobytes()} for a, z in zip(cuts[:-1], cuts[1:])]


def _train(frame: pd.DataFrame) -> classifier.Model:
    ftrl = classifier.Ftrl()
    bias = ftrl.size - 1
    examples = [
        (np.append(np.frombuffer(s, np.int32), bias), np.append(np.frombuffer(v, np.float32), 1.0).astype(float), y)
        for s, v, y in zip(frame["slots"], frame["values"], frame["y"])
    ]
    for _ in range(EPOCHS):
        for at, x, y in examples:
            w = ftrl.weights(at)
            ftrl.update(at, w, (classifier.sigmoid(w @ x) - y) * x)
    w = ftrl.weights()
    kept = np.flatnonzero(w[:-1])
    return classifier.Model(kept, w[kept], float(w[-1]))


def logits(texts: list[bytes], weights: np.ndarray) -> np.ndarray:
    index, slots, counts = features(texts)
    return SCALE * np.bincount(index, weights[slots], minlength=len(texts)) / np.maximum(counts, 1)


def quality_scores(df: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", key: str = "doc_id", keep: tuple[str, ...] = (), most: int = MOST_EXAMPLES) -> DataFrame:
    """``key`` (and ``keep``), ``held_out`` and ``score`` of each row: how likely label 1 is.

    Learns from at most ``most`` labelled rows whose crc32(key as text) mod 3 is not 1; scores all rows,
    whole texts. Null and empty texts, and all texts if no label can be learned from, get the score of
    the bias alone; ``held_out`` of a null key is null. An empty table gives no rows; repeated rows get
    equal scores. Columns other than ``keep`` are ignored.
    """
    model = classifier.fit(classifier.labelled_sample(df, labels, label, text, key, most), _rows, _train)
    scored = classifier.score_rows(df, model, logits, text, key, keep)
    return scored.withColumn("held_out", ~classifier.may_learn(key))
