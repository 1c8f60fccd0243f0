"""Glossaries: loading rules, replacement, verification, completion of cut terms, time to live."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable, Iterator, Mapping
from functools import lru_cache, reduce
from itertools import zip_longest

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parasift.functions import textnorm as tn
from parasift.staging import in_order, read_file, stage

TTL_DAYS = 7
# Fixed values.
HEADER_CN = ["中文术语", "中文", "术语", "原文", "中文术语(必填)", "中文名称"]
HEADER_EN = ["en-us", "english", "英文", "译文", "翻译", "translation", "en", "en名称"]
LANGUAGE_CODES_CN, LANGUAGE_CODES_EN = ["zh-cn", "zh", "cn"], ["en-us", "en"]
COMMON_TERMS = {
    "首席执行官": "Chief Executive Officer",
    "联合创始人": "Co-Founder",
    "数字化转型": "digital transformation",
    "碳中和": "carbon neutrality",
    "智慧城市": "smart city",
    "工业化": "industrialization",
    "数字化": "digitalization",
    "云平台": "Cloud Platform",
    "注册建筑师": "Registered Architect",
}

#: Up to so many terms go into a plan as expressions; more are looked up in an index that each worker holds.
MOST_EXPRESSIONS = 48
#: A glossary goes to the workers whole, so it may have so many terms.
MOST_TERMS = 500_000


def is_header(cn: Column, en: Column) -> Column:
    key = F.lower(F.btrim(F.replace(cn, F.lit("﻿"), F.lit(""))))
    value = F.lower(F.btrim(en))
    return key.isin(HEADER_CN) | value.isin(HEADER_EN) | (key.isin(LANGUAGE_CODES_CN) & value.isin(LANGUAGE_CODES_EN))


def clean_terms(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Terms of raw rows (``pos``, ``cn``, ``en``): trimmed, without headers, blanks and sentences; of
    rows with one ``cn`` the last counts."""
    keys = keys or []
    bare = rows.select(*keys, "pos", F.btrim("cn").alias("cn"), F.btrim("en").alias("en"))
    good = bare.where((F.col("cn") != "") & (F.col("en") != "") & ~is_header(F.col("cn"), F.col("en")) & ~tn.is_sentence_like(F.col("en")))
    return good.groupBy(*keys, "cn").agg(F.max_by("en", "pos").alias("en"), F.min("pos").alias("ord"))


def as_mapping(terms: DataFrame) -> dict[str, str]:
    """A glossary of at most ``MOST_TERMS`` terms, in the order of its file."""
    rows = terms.orderBy("ord").limit(MOST_TERMS + 1).collect()
    if len(rows) > MOST_TERMS:
        raise ValueError(f"over {MOST_TERMS} terms in one glossary")
    return {r["cn"]: r["en"] for r in rows}


def _curly(text: str) -> str:
    parts = re.split('["“”]', text)
    return "".join(p + ("" if i == len(parts) - 1 else "“”"[i % 2]) for i, p in enumerate(parts))


class TermIndex:
    """Terms by their first character and length: which of them a text holds costs a look at each place where
    some term could begin, however many terms there are."""

    def __init__(self, terms: Iterable[str]):
        self.numbers: dict[str, int] = {}
        sizes: dict[str, set[int]] = {}
        for number, term in enumerate(terms):
            if term:
                self.numbers.setdefault(term, number)
                sizes.setdefault(term[0], set()).add(len(term))
        self.sizes = {first: sorted(some) for first, some in sizes.items()}
        self.first = re.compile("[" + "".join(map(re.escape, sizes)) + "]") if sizes else None

    def held(self, text: str) -> set[int]:
        """Numbers of the terms that ``text`` holds."""
        found: set[int] = set()
        for m in self.first.finditer(text) if self.first else ():
            at = m.start()
            for size in self.sizes[m[0]]:
                number = self.numbers.get(text[at : at + size])
                if number is not None:
                    found.add(number)
        return found


class Replacer:
    """Plain replacements in order, each over what the ones before it left.

    One automaton finds all terms in one pass; they are then replaced by order and place. A replacement is scanned
    again only where it stands, with as much beside it as the longest term, for later terms that it made. The
    text is a linked list of characters, so a change moves nothing: the cost follows the text and its changes, not
    the number of terms.
    """

    def __init__(self, pairs: list[tuple[str, str]]):
        self.pairs = pairs
        self.automaton = ahocorasick.Automaton()
        for number, (cn, _) in enumerate(pairs):
            if cn and cn not in self.automaton:
                self.automaton.add_word(cn, number)
        self.longest = max((len(cn) for cn, _ in pairs), default=0)
        if self.longest:
            self.automaton.make_automaton()

    def __call__(self, text: str) -> str:
        if not self.longest:
            return text
        pairs, found = self.pairs, sorted((n, end - len(self.pairs[n][0]) + 1) for end, n in self.automaton.iter(text))
        if not found:
            return text
        # The list's ends are nodes of their own, after the text's characters.
        size = len(text)
        chars = [*text, "", ""]
        after, before = [*range(1, size), size + 1, 0, size + 1], [size, *range(size + 1)]
        before[size], before[size + 1] = size, size - 1
        gone = bytearray(size + 2)
        place: dict[int, tuple[int, ...]] = {}  # of nodes put in: sorts behind the node they stand for
        fresh: list[tuple[int, tuple[int, ...], int]] = []  # a heap of what replacements made
        at = 0
        while at < len(found) or fresh:
            if at < len(found) and (not fresh or (found[at][0], (found[at][1],)) <= fresh[0][:2]):
                number, node = found[at]
                at += 1
            else:
                number, _, node = heapq.heappop(fresh)
            if gone[node]:
                continue
            cn, en = pairs[number]
            nodes = []
            for char in cn:
                if gone[node] or chars[node] != char:  # the ends hold no character
                    break
                nodes.append(node)
                node = after[node]
            if len(nodes) < len(cn):
                continue
            label = place.get(nodes[0], (nodes[0],))
            left, right = before[nodes[0]], after[nodes[-1]]
            for n in nodes:
                gone[n] = 1
            last = left
            for i, char in enumerate(en):
                chars.append(char)
                new = len(chars) - 1
                gone.append(0)
                place[new] = (*label, i)
                after.append(right)
                before.append(last)
                after[last], last = new, new
            after[last], before[right] = right, last
            self._look_again(number, left, right, len(en), chars, after, before, place, fresh)
        out, node = [], after[size]
        while node != size + 1:
            out.append(chars[node])
            node = after[node]
        return "".join(out)

    def _look_again(self, number, left, right, put_in, chars, after, before, place, fresh) -> None:
        """Terms after ``number`` that hold a new character or go across the place of a change."""
        nodes, node = [], left
        while len(nodes) < self.longest - 1 and chars[node]:
            nodes.append(node)
            node = before[node]
        nodes.reverse()
        begin, node = len(nodes), after[left]
        stop = begin + put_in
        while len(nodes) < stop + self.longest - 1 and chars[node]:
            nodes.append(node)
            node = after[node]
        for end, later in self.automaton.iter("".join(chars[n] for n in nodes)):
            first = end - len(self.pairs[later][0]) + 1
            if later > number and first < stop and end >= begin:
                heapq.heappush(fresh, (later, place.get(nodes[first], (nodes[first],)), nodes[first]))


def _longest_first(terms: Mapping[str, str]) -> list[tuple[str, str]]:
    return sorted(((cn, en) for cn, en in terms.items() if cn and en is not None), key=lambda t: -len(t[0]))


def replaced_in_order(text: Column, terms: Mapping[str, str]) -> Column:
    """Every term replaced, longest first."""
    pairs = _longest_first(terms)
    if len(pairs) <= MOST_EXPRESSIONS:
        return tn.literal(text, pairs)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        replace = Replacer(pairs)
        for texts in batches:
            yield pd.Series([None if t is None else replace(t) for t in texts], dtype=object)

    return run(text)


def replaced_between_urls(text: Column, terms: Mapping[str, str]) -> Column:
    """The same in what stands between a text's URLs; the URLs stay."""
    pairs = _longest_first(terms)
    if len(pairs) <= MOST_EXPRESSIONS:
        return F.array_join(F.transform(tn.url_stretches(text), lambda s: F.when(s["url"], s["part"]).otherwise(tn.literal(s["part"], pairs))), "")

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        replace = Replacer(pairs)
        whole = lambda o, u: "".join(replace(part) + url for part, url in zip_longest(o, u, fillvalue=""))
        for others, urls in batches:
            yield pd.Series([None if o is None else whole(o, u) for o, u in zip(others, urls)], dtype=object)

    # Two plain arrays: Spark does not evaluate a Python function whose argument nests lambdas.
    return run(*tn.url_parts(text))


#: Terms whose automaton a worker holds at a time where a glossary is a table.
TERMS_A_BLOCK = 200_000


def replaced_by_table(df: DataFrame, text: str, terms: DataFrame) -> DataFrame:
    """``df`` with every term of ``terms`` (cn, en, ord) replaced in ``text``, longest first, those of one length in the
    order of ``ord``: ``replaced_in_order`` for a glossary of any size, of which nothing passes through the driver.

    The terms lie in the shared folder in ranges of that order. A task takes one range after another over its rows,
    so it holds one range's automaton at a time. Of terms with one ``cn`` the first counts; null and empty ones
    are left out; null texts stay null.
    """
    used = terms.where((F.col("cn") != "") & F.col("en").isNotNull()).groupBy("cn").agg(F.min_by("en", "ord").alias("en"), F.min("ord").alias("ord"))
    used = used.select((-F.length("cn")).alias("rank"), "ord", "cn", "en")
    blocks = max(1, -(-used.count() // TERMS_A_BLOCK))
    ranges = used.repartitionByRange(blocks, "rank", "ord", "cn").withColumn("block", F.spark_partition_id()).sortWithinPartitions("rank", "ord", "cn")
    files = in_order(stage(ranges, "terms"), "block")
    at, schema = df.columns.index(text), df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for group in files:
                replace = _block_replacer(tuple(group))
                texts = [None if t is None else replace(t) for t in texts]
            columns = [pa.array(texts, batch.schema.field(i).type) if i == at else batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return df.mapInArrow(run, schema)


@lru_cache(maxsize=1)
def _block_replacer(files: tuple[str, ...]) -> Replacer:
    """The automaton of one range of terms; a worker process keeps one."""
    rows = [r for file in files for r in read_file(file, ["rank", "ord", "cn", "en"]).to_pylist()]
    return Replacer([(r["cn"], r["en"]) for r in sorted(rows, key=lambda r: (r["rank"], r["ord"], r["cn"]))])


def replace_terms(text: Column, glossary: Mapping[str, str]) -> Column:
    """Quotes made even, then every term replaced, longest first; an empty glossary changes nothing."""
    if not glossary:
        return text
    return replaced_in_order(tn.normalize_quotes(text), {_curly(cn): en for cn, en in glossary.items()})


def translate_terms(text: Column, glossary: Mapping[str, str]) -> Column:
    """``replace_terms`` with dates converted, common terms as fallback, and keys without their spaces."""
    terms = {**COMMON_TERMS, **glossary}
    for cn, en in list(terms.items()):
        terms.setdefault(cn.replace(" ", "").replace("\u3000", ""), en)
    even = tn.normalize_quotes(text)
    # As an argument of a Python function, for many terms, it may hold no lambda in another.
    dated = tn.let(even, tn.convert_chinese_dates) if len(terms) <= MOST_EXPRESSIONS else tn.convert_chinese_dates(even)
    return replaced_in_order(dated, terms)


def _variants(en: str) -> list[str]:
    return [v.strip().lower() for v in en.split("|") if v.strip()]


def unused_terms(cn: Column, en: Column, glossary: Mapping[str, str]) -> Column:
    """Array of (cn, en): the terms that occur in the source while none of their ``|`` variants occurs in the
    translation, in the glossary's order. A null text holds nothing."""
    terms = [(c, e) for c, e in glossary.items() if c and e is not None]
    kind = "array<struct<cn:string,en:string>>"
    if len(terms) <= MOST_EXPRESSIONS:
        none = F.lit(None).cast("struct<cn:string,en:string>")
        told = lambda c, e: F.struct(F.lit(c).alias("cn"), F.lit(e).alias("en"))
        there = lambda lower, e: reduce(lambda a, v: a | lower.contains(v), _variants(e), F.lit(False))
        both = F.struct(F.coalesce(cn, F.lit("")).alias("cn"), F.lower(F.coalesce(en, F.lit(""))).alias("en"))
        found = tn.let(both, lambda b: F.array(none, *(F.when(b["cn"].contains(c) & ~there(b["en"], e), told(c, e)) for c, e in terms)))
        return F.filter(found, lambda t: t.isNotNull())

    @F.pandas_udf(kind)
    def run(sources: pd.Series, targets: pd.Series) -> pd.Series:
        index, variants = TermIndex(c for c, _ in terms), {}
        out = []
        for source, target in zip(sources, targets):
            lower, missing = (target or "").lower(), []
            for n in sorted(index.held(source or "")):
                if not any(v in lower for v in variants.setdefault(n, _variants(terms[n][1]))):
                    missing.append({"cn": terms[n][0], "en": terms[n][1]})
            out.append(missing)
        return pd.Series(out, dtype=object)

    return run(cn, en)


def term_warnings(cn: Column, en: Column, glossary: Mapping[str, str]) -> Column:
    return F.transform(unused_terms(cn, en, glossary), lambda t: F.concat(F.lit("术语缺失: 中文「"), t["cn"], F.lit("」标准译法「"), t["en"], F.lit("」未在英文中出现")))


#: A pair of characters with over one in so many of all pairs is hot; there can be no more such than that.
HOT_SHARE = 1000


def _grams(text: Column, single: bool) -> Column:
    """The distinct pairs of characters that stand side by side in ``text``; with ``single`` its characters too."""
    chars = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    pairs = lambda c: F.transform(c, lambda x, i: F.concat(x, F.get(c, i + 1)))
    every = tn.let(chars, lambda c: F.concat(pairs(c), c) if single else pairs(c))
    return F.array_distinct(F.filter(every, lambda g: g.isNotNull()))


def candidates(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(``row``, ``cn``, ``en``): the terms (cn, en) that may stand in a text of ``texts`` (row, text), a table on disk.

    A term is sought by its anchor, the pair of characters in it that the fewest texts have; one with a pair that no
    text has is in none. Texts and terms meet on anchors in a hash join. Anchors of over a ``HOT_SHARE``-th of all
    pairs are split: their texts are dealt out at random and their terms go to each part.
    """
    single = terms.where(F.char_length("cn") == 1).limit(1).count() > 0
    held = texts.select("row", F.explode(_grams(F.col("text"), single)).alias("gram"))
    counts = stage(held.groupBy("gram").agg(F.count("*").alias("n")), "gram-counts")
    bound = (counts.agg(F.sum("n")).first()[0] or 0) / HOT_SHARE
    own = terms.select("cn", "en", F.explode(F.when(F.char_length("cn") == 1, F.array("cn")).otherwise(_grams(F.col("cn"), False))).alias("gram"))
    known = own.join(counts, "gram", "left").groupBy("cn", "en").agg(F.count_if(F.col("n").isNull()).alias("absent"), F.min(F.struct("n", "gram")).alias("least"))
    anchors = stage(known.where("absent = 0").select("cn", "en", "least.n", "least.gram"), "anchors")
    hot = counts.where(F.col("n") > bound).select("gram")
    cold = held.join(F.broadcast(hot), "gram", "left_anti").join(anchors.where(F.col("n") <= bound), "gram")
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = held.join(F.broadcast(hot), "gram").withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int"))
    copies = anchors.where(F.col("n") > bound).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return cold.select("row", "cn", "en").unionByName(dealt.join(copies, ["gram", "part"]).select("row", "cn", "en"))


def missing_terms(pairs: DataFrame, terms: DataFrame, cn: str = "cn_text", en: str = "en_text") -> DataFrame:
    """Rows of ``pairs`` with each term (``term_cn``, ``term_en``) that ``unused_terms`` finds, for any number of terms: none
    passes through the driver or is held in a worker. Of terms with one ``cn`` the last by ``ord``, where there is
    such a column, else the greatest, counts. Repeated rows each give theirs; null texts hold nothing."""
    last = F.max_by("en", "ord") if "ord" in terms.columns else F.max("en")
    used = terms.where((F.col("cn") != "") & F.col("en").isNotNull()).groupBy("cn").agg(last.alias("en"))
    rows = stage(pairs.withColumns({"__row": F.monotonically_increasing_id(), "__cn": F.col(cn), "__en": F.lower(F.coalesce(F.col(en), F.lit("")))}), "term-pairs")
    found = candidates(rows.select(F.col("__row").alias("row"), F.col("__cn").alias("text")), used)
    found = found.select(F.col("row").alias("__row"), F.col("cn").alias("term_cn"), F.col("en").alias("term_en"))
    variants = F.transform(F.split("term_en", r"\|"), lambda v: F.lower(F.regexp_replace(v, F.lit(r"(?U)^\s+|\s+$"), F.lit(""))))
    there = F.exists(variants, lambda v: (v != "") & F.col("__en").contains(v))
    return rows.join(found, "__row").where(F.col("__cn").contains(F.col("term_cn")) & ~there).select(*pairs.columns, "term_cn", "term_en")


class Variants:
    """Standard translations by their first two words, in the order they are tried; one-word ones apart."""

    def __init__(self, variants: list[tuple[str, list[str]]]):
        self.single: set[str] = set()
        self.longer: dict[tuple[str, str], list[tuple[str, list[str]]]] = {}
        for text, words in variants:
            if len(words) == 1:
                self.single.add(words[0])
            elif words:
                self.longer.setdefault((words[0], words[1]), []).append((text, words))


_PIECE = re.compile(r"\s*\S+")
_LINK = re.compile(r"https?://|www\.|@")


def _plain(piece: str) -> str | None:
    word = piece.lstrip()
    return None if _LINK.search(word) else word.strip(tn.WORD_PUNCTUATION).lower()


def complete_terms(text: str, variants: Variants) -> tuple[str, list[dict]]:
    """Cut standard translations made whole: two or more leading words of a variant, not the whole of any.

    Whole variants are looked for before cut ones, and words of URLs and e-mails are left alone. What a
    completion puts in is judged again from its first word; words before it stand.
    """
    pieces = _PIECE.findall(text)
    tail = text[sum(map(len, pieces)) :]
    plain = [_plain(p) for p in pieces]
    audit: list[dict] = []
    at = 0
    while at < len(plain):
        shared = []
        for variant, words in variants.longer.get((plain[at], plain[at + 1]), ()) if at + 1 < len(plain) and plain[at] is not None else ():
            n = 2
            while n < len(words) and at + n < len(plain) and plain[at + n] == words[n]:
                n += 1
            shared.append((n, words, variant))
        whole = max((n for n, words, _ in shared if n == len(words)), default=1 if plain[at] in variants.single else 0)
        if whole or not shared:
            at += whole or 1
            continue
        n, words, variant = shared[0]
        found = "".join(pieces[at : at + n]).lstrip()
        audit.append({"from_text": found, "to_text": variant})
        lead = pieces[at][: len(pieces[at]) - len(pieces[at].lstrip())]
        new = _PIECE.findall(lead + variant)
        pieces[at : at + n] = new
        plain[at : at + n] = [_plain(p) for p in new]
        if plain[at : at + len(new)] != words:
            at += len(new)  # its words are not all plain, as with a link in it: it would be completed again
    return "".join(pieces) + tail, audit


def variants_of(glossary: Mapping[str, str]) -> list[tuple[str, list[str]]]:
    """Variants that can be completed: names, not sentences."""
    out = []
    for en in glossary.values():
        for v in (x.strip() for x in (en or "").split("|")):
            body = v.rstrip(".")
            if v and len(v) <= 80 and len(v.split()) <= 10 and body.count(".") < 2 and not set("!?;") & set(body):
                out.append((v, [w.strip(tn.WORD_PUNCTUATION).lower() for w in v.split()]))
    return sorted(out, key=lambda v: -len(" ".join(v[0].split())))


def completed(text: Column, glossary: Mapping[str, str]) -> Column:
    """Struct of the completed ``text`` and an ``audit`` of (from_text, to_text)."""
    every = variants_of(glossary)

    @F.pandas_udf("struct<text:string,audit:array<struct<from_text:string,to_text:string>>>")
    def run(texts: pd.Series) -> pd.DataFrame:
        variants = Variants(every)
        return pd.DataFrame([(None, None) if t is None else complete_terms(t, variants) for t in texts], columns=["text", "audit"])

    return run(text)


def alive(metadata: DataFrame, now: Column, days: int = TTL_DAYS) -> DataFrame:
    """Glossaries used in the last ``days`` days; no stamp counts as the epoch."""
    stamp = F.coalesce(F.col("uploaded_at").cast("timestamp"), F.timestamp_seconds(F.lit(0)))
    return metadata.where(now.cast("timestamp") - stamp <= F.expr(f"interval {days} days"))


def touch(metadata: DataFrame, used: DataFrame) -> DataFrame:
    """Use renews a glossary's stamp: the later of upload and last use (``glossary_id``, ``used_at``)."""
    last = used.groupBy("glossary_id").agg(F.max("used_at").alias("__used"))
    return metadata.join(last, "glossary_id", "left").withColumn("uploaded_at", F.greatest("uploaded_at", "__used")).drop("__used")


def term_counts(terms: DataFrame) -> DataFrame:
    return terms.groupBy("glossary_id").agg(F.count("*").alias("term_count"))


def prompt_list(terms: DataFrame, keys: list[str]) -> DataFrame:
    """``cn → en`` lines of each glossary, in the order of its file."""
    lines = F.array_sort(F.collect_list(F.struct("ord", F.concat("cn", F.lit(" → "), "en").alias("line"))))
    return terms.groupBy(*keys).agg(F.array_join(F.transform(lines, lambda t: t["line"]), "\n").alias("terms"))


def longest_first(terms: DataFrame, keys: list[str]) -> DataFrame:
    """Rank of each term in replacement order: longer keys first, ties in the order of the file."""
    order = Window.partitionBy(*keys).orderBy(F.length("cn").desc(), "ord")
    return terms.withColumn("rank", F.row_number().over(order))
