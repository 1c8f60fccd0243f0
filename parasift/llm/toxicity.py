"""Toxicity classifier with counterfactual regularisation.

Features are a text's distinct words and word beginnings of 4, 5 and 6 bytes (so inflected forms share
one), hashed. Of each labelled sentence that names a group, a counterfactual is made: every identity
term becomes the next of its kind. The loss is the log loss plus ``PENALTY`` times the squared change of
the score between the two, so a weight that only moves with the name of the group is driven to zero.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from parasift.llm import classifier
from parasift.llm.features import BITS, Words, slot

#: Bound of the labelled sample, in rows.
MOST_EXAMPLES = 16_000
EPOCHS = 5
PENALTY = 0.5
PREFIXES = (4, 5, 6)
#: Identity terms by kind, in English, French, German and Spanish. Swaps stay in a
#: kind, and so in a language: no term stands in two.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab", "african"),
    ("gay", "lesbian", "bisexual", "straight", "transgender", "queer"),
    ("women", "men"),
    ("woman", "man"),
    ("female", "male"),
    ("immigrants", "refugees", "foreigners", "locals"),
    ("deaf", "blind", "disabled"),
    ("old", "young"),
    ("musulmans", "chrétiens", "juifs", "hindous"),
    ("femmes", "hommes"),
    ("muslime", "christen", "juden", "buddhisten"),
    ("frauen", "männer"),
    ("musulmanes", "cristianos", "judíos", "hindúes"),
    ("mujeres", "hombres"),
)
_NEXT = {term: kind[(i + 1) % len(kind)] for kind in IDENTITY_TERMS for i, term in enumerate(kind)}
_TERM = re.compile(r"\b(?:" + "|".join(sorted(map(re.escape, _NEXT), key=len, reverse=True)) + r")\b")
_WORD = np.zeros(256, bool)
_WORD[128:] = True
_WORD[48:58] = _WORD[97:123] = _WORD[65:91] = True


def counterfactual(text: str) -> str:
    """The lower-case text with every identity term swapped for the next of its kind."""
    return _TERM.sub(lambda m: _NEXT[m[0]], text.lower())


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Text index and slot for each occurrence of a feature; texts must be lower case."""
    words = Words(texts, _WORD)
    rolled = words.rolling(words.data)
    size = words.stop - words.start
    index, slots = [words.text], [slot(words.span(rolled, words.start, words.stop), 11)]
    for length in PREFIXES:
        longer = size > length
        begin = words.start[longer]
        index.append(words.text[longer])
        slots.append(slot(words.span(rolled, begin, begin + length), 11 + length))
    return np.concatenate(index), np.concatenate(slots)


def _lower(texts: list[bytes]) -> list[bytes]:
    return [t.decode().lower().encode() for t in texts]


def _distinct(texts: list[bytes]) -> list[np.ndarray]:
    index, slots = features(texts)
    keys = np.unique(index << BITS | slots)
    index, slots = keys >> BITS, (keys & (1 << BITS) - 1).astype(np.int32)
    cuts = np.searchsorted(index, np.arange(len(texts) + 1))
    return [slots[a:z] for a, z in zip(cuts[:-1], cuts[1:])]


def _rows(texts: list[bytes]) -> list[dict]:
    lower = _lower(texts)
    swapped = [counterfactual(t.decode()).encode() for t in lower]
    own, other = _distinct(lower), {i: s for i, s in enumerate(swapped) if s != lower[i]}
    others = dict(zip(other, _distinct(list(other.values())))) if other else {}
    return [{"slots": s.tobytes(), "swapped": others[i].tobytes() if i in others else b""} for i, s in enumerate(own)]


def _train(frame: pd.DataFrame) -> classifier.Model:
    ftrl = classifier.Ftrl(alpha=1.0, l1=8.0, l2=0.1)
    bias = ftrl.size - 1
    examples = []
    for own, swapped, y in zip(frame["slots"], frame["swapped"], frame["y"]):
        own, swapped = np.frombuffer(own, np.int32), np.frombuffer(swapped, np.int32)
        only = np.setdiff1d(own, swapped), np.setdiff1d(swapped, own)
        examples.append((np.append(own, bias), only if len(swapped) else None, y))
    for _ in range(EPOCHS):
        for at, changed, y in examples:
            w = ftrl.weights(at)
            ftrl.update(at, w, np.full(len(at), classifier.sigmoid(w.sum()) - y))
            if changed is not None:
                both = np.concatenate(changed)
                sign = np.repeat([1.0, -1.0], [len(changed[0]), len(changed[1])])
                w = ftrl.weights(both)
                ftrl.update(both, w, 2 * PENALTY * (w @ sign) * sign)
    w = ftrl.weights()
    kept = np.flatnonzero(w[:-1])
    return classifier.Model(kept, w[kept], float(w[-1]))


def logits(texts: list[bytes], weights: np.ndarray) -> np.ndarray:
    index, slots = features(_lower(texts))
    counts = weights[slots] != 0
    keys = np.unique(index[counts] << BITS | slots[counts])
    return np.bincount(keys >> BITS, weights[keys & (1 << BITS) - 1], minlength=len(texts))


def toxicity_scores(df: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", key: str = "doc_id", keep: tuple[str, ...] = (), most: int = MOST_EXAMPLES) -> DataFrame:
    """``key`` (and ``keep``), ``held_out`` and ``score`` of each row: how likely label 1 is.

    Learns from at most ``most`` labelled rows whose crc32(key as text) mod 3 is not 1; scores all rows,
    whole texts. Null and empty texts, and all texts if no label can be learned from, get the score of
    the bias alone; ``held_out`` of a null key is null. An empty table gives no rows; repeated rows get
    equal scores. Columns other than ``keep`` are ignored.
    """
    model = classifier.fit(classifier.labelled_sample(df, labels, label, text, key, most), _rows, _train)
    return classifier.score_rows(df, model, logits, text, key, keep).withColumn("held_out", ~classifier.may_learn(key))
