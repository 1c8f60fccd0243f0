"""Mechanical clean-up of whole paragraphs: everything but URLs goes through the segment rules."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parasift.functions import textnorm as tn
from parasift.operators.dedup import dedup_stretches
from parasift.operators.glossary import COMMON_TERMS, replaced_between_urls

# Fixed values.
URL_LABELS = {
    "链接": "link",
    "网址链接": "URL",
    "网址": "URL",
    "网站": "Website",
    "参考链接": "Reference link",
    "来源链接": "Source link",
    "来源": "Source",
    "参考": "Reference",
}


def stretched(text: Column) -> Column:
    """A text's stretches (``part``, ``url``), those outside URLs after the rules that come before repeats; null for null.
    Texts without a URL, nearly all, stay whole."""
    stretches = tn.let(text, lambda t: F.when(tn.contains_url(t), tn.url_stretches(t)).otherwise(F.array(F.struct(t.alias("part"), F.lit(False).alias("url")))))
    ready = F.transform(stretches, lambda s: F.struct(F.when(s["url"], s["part"]).otherwise(tn.before_dedup(s["part"])).alias("part"), s["url"].alias("url")))
    return F.when(text.isNotNull(), ready)


def word_twice(text: Column) -> Column:
    """Whether a word comes twice: in all other texts the removal of repeats changes nothing. White space is what Python
    takes for it, which is more than Unicode's."""
    words = F.filter(F.split(text, r"(?U)[\s\x1c-\x1f]+", -1), lambda w: w != "")
    return F.coalesce(tn.let(words, lambda w: F.size(F.array_distinct(w)) < F.size(w)), F.lit(False))


def repeated(ready: Column) -> Column:
    """The same in one of the stretches outside URLs."""
    return F.coalesce(F.exists(ready, lambda s: ~s["url"] & word_twice(s["part"])), F.lit(False))


def finished(ready: Column, judged: Column | None = None) -> Column:
    """The text from its stretches, after the rules that come after repeats; ``judged`` are the stretches without these."""
    if judged is None:
        return F.array_join(F.transform(ready, lambda r: F.when(r["url"], r["part"]).otherwise(tn.after_dedup(r["part"]))), "")
    return F.array_join(F.zip_with(ready, judged, lambda r, s: F.when(r["url"], r["part"]).otherwise(tn.after_dedup(s["part"]))), "")


def clean_segments(df: DataFrame, text: str = "text", protected: str | None = None) -> DataFrame:
    """``df`` with ``text`` cleaned and ``dedup_audit``: only stretches outside URLs change.

    Repeated words are judged in each stretch apart. One scan; Python sees the words between the two runs of rules, and
    nothing else.
    """
    return clean_stretched(df.withColumn("__r", stretched(F.col(text))), text, protected)


def clean_stretched(df: DataFrame, text: str, protected: str | None = None) -> DataFrame:
    """The same of a table that has its texts' stretches in ``__r``."""
    # Read twice, so that it stays a column of its own and the Python function's argument is a plain one.
    judged = df.withColumn("__s", dedup_stretches(F.col("__r"), F.col(protected) if protected else None))
    audit = F.flatten(F.transform("__s", lambda s: s["audit"]))
    names = [c for c in df.columns if c != "__r"]
    return judged.select(*(finished(F.col("__r"), F.col("__s")).alias(c) if c == text else F.col(c) for c in names), audit.alias("dedup_audit"))


def url_line(text: Column, terms: Mapping[str, str]) -> Column:
    """Labels and terms of a line with a URL in English; the URL itself and lines without Chinese stay.

    Each label gives way once, longer ones first, if a colon follows; terms in every stretch outside URLs.
    """
    labelled = text
    for label in sorted(URL_LABELS, key=len, reverse=True):
        labelled = F.regexp_replace(labelled, F.lit(rf"(?s)^(.*?)\Q{label}\E(?=[：:])"), F.lit(f"$1{URL_LABELS[label]}"))
    every = {**COMMON_TERMS, **terms}
    lines = tn.let(text, lambda t: tn.contains_url(t) & t.rlike(tn.CJK))
    return F.when(lines, replaced_between_urls(labelled, every)).otherwise(text)
