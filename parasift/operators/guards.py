"""Masking of amounts, URLs, e-mails and numbers around a translation, and putting them back."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from parasift.functions import textnorm as tn
from parasift.functions.amounts import NUMBER, render_text, unit_pattern
from parasift.staging import slices

GUARDED = "struct<text:string,guards:array<struct<token:string,original:string>>>"
_AMOUNT = re.compile(rf"({NUMBER})\s*({unit_pattern()})")
# What is masked after amounts, in this order, each with its token's name.
_PLAIN = [
    ("G", re.compile(tn.INLINE_URL_PATTERN, re.IGNORECASE)),
    ("G", re.compile(tn.EMAIL_PATTERN)),
    ("G", re.compile(rf"(?<![\d_]){NUMBER}(?:\.\d+)?(?![\d_])")),
]
# Dates and times that the second pass leaves alone.
_CALENDAR = [
    ("DATE_", re.compile(rf"\b(?:{'|'.join(tn.MONTHS)})\s+\d{{1,2}},\s+\d{{4}}\b")),
    ("TIME_", re.compile(r"\b\d{1,2}:\d{2}[-–]\d{1,2}:\d{2}\b")),
]


class Mask:
    """A text whose stretches give way to tokens ``__<name><n>__``, and what each token stands for."""

    def __init__(self, text: str):
        self.text, self.guards, self.next = text, [], Counter()

    def cover(self, name: str, pattern: re.Pattern, shown: Callable[[re.Match], str | None] = lambda m: m[0]) -> Mask:
        def token(match: re.Match) -> str:
            if (original := shown(match)) is None:
                return match[0]
            new = f"__{name}{self.next[name]}__"
            self.next[name] += 1
            self.guards.append((new, original))
            return new

        self.text = pattern.sub(token, self.text)
        return self

    def all(self, kinds: list[tuple[str, re.Pattern]]) -> Mask:
        return reduce(lambda mask, kind: mask.cover(*kind), kinds, self)


def mask_text(text: str) -> tuple[str, list[tuple[str, str]]]:
    """The text with ``__G<n>__`` tokens, and (token, original) in the order of their making: amounts
    first (already rendered in English), then URLs, e-mails, other numbers."""
    masked = Mask(text).cover("G", _AMOUNT, lambda m: render_text(m[1], m[2])).all(_PLAIN)
    return masked.text, masked.guards


def mask_for_polish(text: str) -> tuple[str, list[tuple[str, str]]]:
    """Dates and time ranges behind ``__DATE_<n>__`` and ``__TIME_<n>__``, then all that ``mask_text`` masks."""
    masked = Mask(text).all(_CALENDAR).cover("G", _AMOUNT, lambda m: render_text(m[1], m[2])).all(_PLAIN)
    return masked.text, masked.guards


def _struct(mask):
    def part(texts: pd.Series) -> pd.DataFrame:
        rows = [(None, None) if t is None else mask(t) for t in texts]
        return pd.DataFrame([(t, g and [{"token": a, "original": b} for a, b in g] if g is not None else None) for t, g in rows], columns=["text", "guards"])

    @F.pandas_udf(GUARDED)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            for some in slices(texts):
                yield part(texts.iloc[some])

    return run


def mask(text: Column) -> Column:
    return _struct(mask_text)(text)


def mask_polish(text: Column) -> Column:
    return _struct(mask_for_polish)(text)


def restore(text: Column, guards: Column) -> Column:
    """Tokens back to what they stood for, last made first, so an original that holds an earlier token
    is put back before that token is; leftovers go."""
    back = F.aggregate(F.reverse(guards), text, lambda acc, g: F.replace(acc, g["token"], g["original"]))
    return F.regexp_replace(back, F.lit(r"__(?:G|DATE_|TIME_)\d+__"), F.lit(""))


def must_preserve(text: Column) -> Column:
    """Amounts with units and numbers of four or more digits, each once, in order; null if none."""
    found = F.concat(F.regexp_extract_all(text, F.lit(rf"{NUMBER}\s*(?:{unit_pattern()})"), F.lit(0)), F.regexp_extract_all(text, F.lit(r"\d{4,}"), F.lit(0)))
    return F.when(F.size(found) > 0, F.array_distinct(found))
