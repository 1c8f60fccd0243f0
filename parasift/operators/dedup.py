"""Adjacent duplicates within a paragraph: graded removal, read-only audit, protected tokens."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parasift.functions import textnorm as tn
from parasift.staging import slices, stage

LONGEST = 8
AUDIT = "array<struct<dup:string,removed:string,reason:string,confidence:string,action:string>>"
_STOPWORDS = frozenset(tn.STOPWORDS)
_PROTECTED = re.compile("|".join(f"(?:{p})" for p in tn.PROTECTED_TOKEN_PATTERNS))
_TOKEN = re.compile(r"\s*\S+")


def _stop(token: str) -> bool:
    return token.lower() in _STOPWORDS


def _structural(token: str) -> bool:
    return _PROTECTED.fullmatch(token) is not None


def repeats(words: list[str]) -> np.ndarray:
    """Where blocks of at most ``LONGEST`` words begin that their own copies follow."""
    numbers: dict[str, int] = {}
    at = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    found = np.zeros(len(at) + 1, bool)
    for k in range(1, min(LONGEST, len(at) // 2) + 1):
        same = np.concatenate([[0], np.cumsum(at[:-k] == at[k:])])
        found[np.flatnonzero(same[k:] - same[:-k] == k)] = True
    return np.flatnonzero(found)


def block_length(tokens: list[str], at: int) -> int:
    """Words of the longest block at ``at`` that its own copy follows; 0 for none."""
    most = min(LONGEST, (len(tokens) - at) // 2)
    for k in range(most, 0, -1):
        if tokens[at] == tokens[at + k] and tokens[at : at + k] == tokens[at + k : at + 2 * k]:
            return k
    return 0


def _grade(block: list[str], protected: frozenset[str] | set[str]) -> tuple[str, bool]:
    """Why a repeated block goes or stays, and whether it goes."""
    rare = any(t in protected for t in block)
    if len(block) == 1 and _stop(block[0]):
        return "stopword_dup", True
    if sum(not _stop(t) for t in block) >= 2 and not rare:
        return "exact_adjacent", True
    if len(block) == 1 and _structural(block[0]):
        return "id_number_dup", True
    return ("protected_keep" if rare else "single_content_token"), False


def remove_duplicates(text: str, protected: Iterable[str] = ()) -> tuple[str, list[dict]]:
    """The text without removable repeats, and what was removed or kept with a warning.

    Words lie in a list with a gap: those already judged before it, the others behind. A removed copy
    widens the gap, and judged words go back over it as far as a judgement can have changed: one at a
    position sees at most 16 words. So the work follows the removals, not the text's length times them.
    Kept warnings are told once, as of the final text.
    """
    words = text.split()
    hot = repeats(words).tolist()
    if not hot:
        return text, []
    pieces = _TOKEN.findall(text)
    tail = text[sum(map(len, pieces)) :]
    rare = set(protected)
    removed: list[dict] = []
    kept: list[tuple[int, int, dict]] = []
    # Before the gap: [0, left); behind it: [right, n). From ``fresh`` on the words are as they were.
    left = right = fresh = 0
    n = len(words)

    def move(to: int) -> None:
        nonlocal left, right
        step = to - right
        words[left : left + step] = words[right:to]
        pieces[left : left + step] = pieces[right:to]
        left, right = left + step, to

    while right < n:
        if right >= fresh:
            next_ = bisect_left(hot, right)
            move(hot[next_] if next_ < len(hot) else n)
            if right == n:
                break
        k = block_length(words, right)
        if not k:
            move(right + 1)
            continue
        block = words[right : right + k]
        reason, goes = _grade(block, rare)
        entry = {"dup": " ".join(block), "removed": " ".join(block) if goes else "", "reason": reason, "confidence": "high" if goes else "medium", "action": "removed" if goes else "kept_warn"}
        if not goes:
            kept.append((left, k, entry))
            move(right + k)
            continue
        removed.append(entry)
        pieces[right + k : right + 2 * k] = pieces[right : right + k]  # the first copy's white space stays
        right += k
        fresh = max(fresh, right + k)
        back = max(0, left + k - 2 * LONGEST + 1)
        # A position within a kept block was not judged; its first one was, and may be far enough back to stand.
        inside = next((s + size for s, size, _ in reversed(kept) if s < back < s + size), back)
        back = min(left, inside)
        while kept and kept[-1][0] >= back:
            kept.pop()
        step = left - back
        words[right - step : right] = words[back:left]
        pieces[right - step : right] = pieces[back:left]
        left, right = back, right - step
    return "".join(pieces[:left]) + tail, removed + [e for *_, e in kept]


def find_duplicates(text: str) -> list[dict]:
    """Repeated blocks without changing the text; a scan goes on behind both copies."""
    words = text.split()
    found, at = [], 0
    for start in repeats(words).tolist():
        if start < at:
            continue
        k = block_length(words, start)
        block = words[start : start + k]
        sure = sum(not _stop(t) for t in block) >= 2 or k == 1 and (_stop(block[0]) or _structural(block[0]))
        found.append({"dup": " ".join(block), "removable": sure, "confidence": "high" if sure else "medium"})
        at = start + 2 * k
    return found


def _remove(texts: pd.Series, protected: pd.Series) -> pd.DataFrame:
    rows = [(None, None) if t is None else remove_duplicates(t, () if p is None else p) for t, p in zip(texts, protected)]
    return pd.DataFrame(rows, columns=["text", "audit"])


def _find(texts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else find_duplicates(t) for t in texts], dtype=object)


def dedup(text: Column, protected: Column | None = None) -> Column:
    """Struct of the cleaned ``text`` and its ``audit``."""
    def sliced(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, rare in batches:
            for some in slices(texts):
                yield _remove(texts.iloc[some], rare.iloc[some])

    run = F.pandas_udf(sliced, f"struct<text:string,audit:{AUDIT}>")
    return run(text, F.array().cast("array<string>") if protected is None else protected)


def _remove_parts(stretches: pd.Series, protected: pd.Series) -> pd.Series:
    out = []
    for row, words in zip(stretches, protected):
        if row is None:
            out.append(None)
            continue
        parts = []
        for s in row:
            text, audit = (s["part"], []) if s["url"] else remove_duplicates(s["part"], () if words is None else words)
            parts.append({"part": text, "audit": audit})
        out.append(parts)
    return pd.Series(out, dtype=object)


def dedup_stretches(stretches: Column, protected: Column | None = None) -> Column:
    """``dedup`` of each stretch of an array of (part, url) that is no URL, with ``audit``."""
    run = F.pandas_udf(_remove_parts, f"array<struct<part:string,audit:{AUDIT}>>")
    return run(stretches, F.array().cast("array<string>") if protected is None else protected)


def audit(text: Column) -> Column:
    return F.pandas_udf(_find, "array<struct<dup:string,removable:boolean,confidence:string>>")(text)


def adjacent_repeats(text: Column) -> Column:
    """Single words that repeat the word before them; an expression, for corpus-wide counts."""
    return tn.let(tn.tokens(text), lambda words: F.filter(words, lambda w, i: (i > 0) & (w == F.get(words, i - 1))))


def protected_tokens(df: DataFrame, text: str, keys: list[str], most: int = 2) -> DataFrame:
    """Rare words of each group of ``keys``: no stopword, nothing structural, at most ``most`` times.

    Words are counted as they stand first, so what kind each is gets looked at once, not at every occurrence.
    """
    words = df.select(*keys, F.explode(tn.tokens(F.col(text))).alias("raw")).groupBy(*keys, "raw").agg(F.count("*").alias("n"))
    plain = words.where(~tn.is_stopword(F.col("raw")) & ~tn.is_protected_token(F.col("raw")))
    return plain.groupBy(*keys, tn.normal_token(F.col("raw")).alias("token")).agg(F.sum("n").alias("n")).where(F.col("n") <= most)


def with_protected(df: DataFrame, text: str, keys: list[str], rare: DataFrame, name: str = "protected") -> DataFrame:
    """``df`` with those of its group's ``rare`` words (``keys``, token) that ``text`` holds, as an array.

    Rows and words meet by group and word, so no group's whole set is ever in one row. Words are taken as the
    clean-up sees them, after its first rules.
    """
    numbered = stage(df, "numbered").withColumn("__row", F.monotonically_increasing_id())
    held = numbered.select("__row", *keys, F.explode(tn.tokens(tn.before_dedup(F.col(text)))).alias("token")).distinct()
    own = held.join(rare, [*keys, "token"]).groupBy("__row").agg(F.collect_set("token").alias(name))
    return numbered.join(own, "__row", "left").drop("__row")
