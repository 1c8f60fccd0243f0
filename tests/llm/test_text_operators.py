"""Fingerprints, tokens, lines, tiles: against brute force on small fixtures."""

import base64
import random
import re
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from parasift.llm import bpe, common, decontaminate, linededup, simhash
from parasift.llm.components import components

SCHEMA = "doc_id long, text string, fp string, line string, way int"


def documents(spark, texts, schema=SCHEMA):
    """With extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "x", "y", 3) for i, t in texts], schema)


# SimHash


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in prints:
        for j in prints:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in prints}


def test_fingerprint_of_odd_texts():
    for text in ["", "  ", "one", "One TWO", "É é x", "a\x1cb c d", "w " * 50, "a b c d e f\tg\x0bh"]:
        assert simhash.fingerprint(text.encode()) == plain_fingerprint(text), text


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(2)
    base = ["w%d" % rng.randrange(400) for _ in range(300)]
    texts = {}
    for i in range(160):
        words = list(base) if i % 3 else ["v%d" % rng.randrange(400) for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 2)):
            if words:
                words[rng.randrange(len(words))] = "edit%d" % rng.randrange(50)
        texts[i * 7] = " ".join(words)
    texts |= {2000: None, 2001: "", 2002: " \n", 2003: texts[0], 2004: texts[7]}
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(documents(spark, list(texts.items()))).collect()}
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    assert {i: f for i, (f, _) in got.items()} == prints
    assert {i: c for i, (_, c) in got.items()} == plain_components(prints)


def cluster(n, seed):
    """Fingerprints around a few centres, so links and chains abound."""
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(4)]
    return sorted({rng.choice(centres) ^ sum(1 << b for b in rng.sample(range(20), rng.randint(0, 4))) for _ in range(n)})


@pytest.mark.parametrize("hot,split", [(1024, 8), (8, 8), (2, 4)])
def test_links_of_dense_clusters(spark, monkeypatch, hot, split):
    """With a low bound sub-tries are split into node pairs, some down to the last bits."""
    monkeypatch.setattr(simhash, "HOT_TRIE", hot)
    monkeypatch.setattr(simhash, "SPLIT", split)
    prints = cluster(250, 4)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    stars = components(simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long")), "test").collect()
    root = {r.node: r.root for r in stars}
    mine, true = defaultdict(set), defaultdict(set)
    for s in signed:
        mine[root.get(s, s)].add(s)
    for p, c in plain_components(dict(zip(signed, prints))).items():
        true[c].add(p)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, true.values()))


def test_trie_pairs_find_every_pair():
    rng = random.Random(9)
    keys = np.array(sorted(rng.sample(range(1 << 12), 300)), np.uint64)
    first, end = np.array([0, 120]), np.array([120, 300])
    a, b = simhash.trie_pairs(keys, (first, end, first, end, np.zeros(2, np.int64)), 32, 2)
    groups = [0] * 120 + [1] * 180
    want = {(i, j) for i in range(300) for j in range(i) if groups[i] == groups[j] and (int(keys[i]) ^ int(keys[j])).bit_count() <= 2}
    assert {(max(x, y), min(x, y)) for x, y in zip(a.tolist(), b.tolist())} == want and len(a) == len(want)


def test_trie_pairs_below_two_nodes():
    rng = random.Random(10)
    keys = np.array([*sorted(rng.sample(range(1 << 10), 90)), *sorted(rng.sample(range(1 << 10), 70))], np.uint64)
    for spent in (0, 1, 2):
        a, b = simhash.trie_pairs(keys, tuple(np.array([x]) for x in (0, 90, 90, 160, spent)), 10, 2)
        want = {(i, j) for i in range(90) for j in range(90, 160) if (int(keys[i]) ^ int(keys[j])).bit_count() <= 2 - spent}
        assert set(zip(a.tolist(), b.tolist())) == want and len(a) == len(want)


def test_fingerprint_of_a_very_long_text(spark):
    text = " ".join(f"w{i * 7919 % 5003}" for i in range(150_000))
    rows = simhash.near_duplicates(documents(spark, [(1, text), (2, text + " more")])).collect()
    assert {r.fp % (1 << 64) for r in rows if r.doc_id == 1} == {plain_fingerprint(text)} and {r.component_id for r in rows} == {1}


def test_long_chain_is_one_component(spark):
    edges = spark.range(300).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert {r.root for r in components(edges, "chain").collect()} == {0}
    assert components(edges.limit(0), "none").count() == 0


def test_simhash_of_nothing(spark):
    assert simhash.near_duplicates(documents(spark, [])).count() == 0
    rows = simhash.near_duplicates(spark.createDataFrame([(None, "a b c d"), (3, "a b c d"), (3, "a b c d"), (None, "q r s t")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in rows if r.doc_id) == [(3, 3), (3, 3)] and {r.component_id for r in rows if r.doc_id is None} == {3, None}


# Byte-level BPE

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(spark, library):
    rng = random.Random(1)
    texts = ["", None, "  a", "a  b", " a b ", "a\n b", "aaa" * 700, "x" * 5000, "日本語 text  's don't  ", "\t\t a\t b", "<|endoftext|>", "12 345 6!! ??"]
    texts += ["' 's' 't''s 're'really don't I'll we've  'll", "'s", "'", "a'", "a'r", "a's\u0301b", "²Ⅷ½ x²", "\u3000 \u3000a \u0085"]
    texts += ["".join(rng.choice(" \n\t\x1c\x85　ab'sétrelvdm12!?日\r​\x0b½🙂") for _ in range(rng.randint(0, 30))) for _ in range(600)]
    rows = bpe.encode_decode(documents(spark, list(enumerate(texts))), PATH, public_tokenizers.PATTERN).collect()
    assert len(rows) == len(texts)
    for row in rows:
        text = texts[row.doc_id] or ""
        assert row.ids == library.encode_ordinary(text) and row.decoded == text.encode(), text
    assert bpe.encode_decode(documents(spark, []), PATH, public_tokenizers.PATTERN).count() == 0


def test_bpe_of_long_texts(spark, library, monkeypatch):
    """Texts beyond a window and a batch, with and without spaces to cut at, and repeated rows."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeéß'-1") for _ in range(rng.randint(1, 40))) for _ in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(60_000)), "\n".join(rng.choice(words) for _ in range(30_000)), "".join(rng.choice("ab1") for _ in range(700_000))]
    monkeypatch.setattr(bpe, "WINDOW_BYTES", 1 << 12)
    own = bpe.Codec(PATH, public_tokenizers.PATTERN)
    for text in texts:
        assert own.encode(text) == library.encode_ordinary(text)
    docs = documents(spark, [(1, texts[0]), (1, texts[0]), (2, texts[1])])
    for row in bpe.encode_decode(docs, PATH, public_tokenizers.PATTERN).collect():
        text = texts[row.doc_id - 1]
        assert row.ids == library.encode_ordinary(text) and row.decoded == text.encode()
    with pytest.raises(ValueError):
        bpe.encode_decode(docs.withColumn("ids", F.lit(1)), PATH, public_tokenizers.PATTERN, keep=("doc_id", "ids"))


def test_bpe_of_other_patterns(library):
    own = bpe.Codec(PATH, r"\s+|\w+|[^\s\w]+")
    other = tiktoken.Encoding("other", pat_str=r"\s+|\w+|[^\s\w]+", mergeable_ranks=own.ranks.ranks, special_tokens={})
    for text in ("", "Hello there, don't!  12x", "a" * 40 + " é"):
        assert own.encode(text) == other.encode_ordinary(text)


def test_bpe_of_ranks_that_go_back(monkeypatch):
    """A merge can make a pair of lesser rank; the queue must take that one next."""
    rng = random.Random(3)
    for _ in range(600):
        ranks = {bytes([b]): b for b in range(256)}
        while len(ranks) < 256 + 12:
            token = bytes(rng.choice(b"ab") for _ in range(rng.randint(2, 4)))
            if token not in ranks:
                ranks[token] = len(ranks)
        spread = {t: i if i < 256 else 256 + 23 * (i - 256) for t, i in ranks.items()}  # over several leaves
        model = bpe.Ranks(spread)
        pieces = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 20))) for _ in range(5)]
        ids, counts = model.merge(np.frombuffer(b"".join(pieces), np.uint8), np.array([len(p) for p in pieces]))
        for piece, own in zip(pieces, np.split(ids, np.cumsum(counts)[:-1])):
            parts = [piece[i : i + 1] for i in range(len(piece))]
            while True:
                best = min(((spread[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in spread), default=None)
                if best is None:
                    break
                i = best[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            assert own.tolist() == [spread[p] for p in parts], (piece, spread)


def test_bpe_table_stays_bounded(monkeypatch, library):
    monkeypatch.setattr(bpe, "TABLE_WORDS", 20)
    own = bpe.Codec(PATH, public_tokenizers.PATTERN)
    texts = [" ".join(f"w{i}x{j}" for j in range(12)) for i in range(6)]
    for text in texts * 2:
        assert own.encode(text) == library.encode_ordinary(text)
        own.pieces.shrink(20)
        assert own.pieces.count - own.pieces.base <= 20


# Line dedup


def plain_lines(docs):
    """(kept text, dropped) of each (id, text): two lines share a template if they are equal once tokens with a
    digit are masked, or of four tokens or more and equal but for one of five stretches, which is behind the third
    token or before the last but one."""
    lines = []
    for i, text in docs:
        for pos, line in enumerate((text or "").split("\n")):
            words = re.findall(r"[^ \t\r\x0b\x0c]+", line)
            masked = ["<*>" if re.search("[0-9]", w) else w for w in words]
            constants = sum(m != "<*>" for m in masked)
            t = masked if constants else words
            n = len(t)
            cuts = [i * n // 5 for i in range(6)]
            keys = {(tuple(t), None)} if words else set()
            keys |= {(tuple(t[:a] + ["|"] + t[z:]), k) for k, (a, z) in enumerate(zip(cuts, cuts[1:])) if n >= 4 and z > a and constants - (z - a) >= 3 and (a >= 3 or z <= n - 2)}
            lines.append((i, pos, line, {(n, *k) for k in keys}))
    first = {}
    for i, _, _, keys in lines:
        for k in keys:
            first[k] = min(i, first.get(k, i))
    gone = {(i, pos) for i, pos, _, keys in lines if any(first[k] < i for k in keys)}
    return {i: (None if text is None else "\n".join(x for p, x in enumerate(text.split("\n")) if (i, p) not in gone), len({g for g in gone if g[0] == i})) for i, text in docs}


def test_lines(spark):
    long = "alpha beta gamma one two three four five six seven"
    texts = [
        (1, f"User 17 logged in today\nunique words here now\n{long}"),
        (2, "User 99 logged in today\nother words stand here\nok\n1 2 3 4"),
        (3, f"ok\n1 2 3 4\n1 2 3 5\n\n{long.replace('seven', 'eight')}\n{long.replace('beta', 'other')}"),
        (4, "All lines here are mine\nAll lines here are mine"),
        (5, None),
        (6, ""),
        (7, "User 5 logged in today"),
    ]
    df = documents(spark, texts).union(documents(spark, [(7, "User 5 logged in today"), (None, "User 17 logged in today")]))
    rows = sorted(linededup.dedup_lines(df).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    kept = [(r.doc_id, r.text, r.lines_dropped) for r in rows]
    assert kept[0] == (1, texts[0][1], 0)
    assert kept[1] == (2, "other words stand here\nok\n1 2 3 4", 1)
    assert kept[2] == (3, "1 2 3 5\n", 4)  # a leading token can be a field; numbers alone are no template
    assert kept[3] == (4, texts[3][1], 0) and kept[4] == (5, None, 0) and kept[5] == (6, "", 0)
    assert kept[6] == kept[7] == (7, "", 1) and kept[8] == (None, "User 17 logged in today", 0)
    assert linededup.dedup_lines(documents(spark, [])).count() == 0


def test_a_leaf_has_several_templates(spark):
    """Lines alike to each other, but not to the first line of their leaf."""
    lead = "Posted in the"
    texts = [(1, f"{lead} a b c d e f g"), (2, f"{lead} p q r s t u v"), (3, f"{lead} p q r s t u w"), (4, f"{lead} p q r s other u v")]
    got = {r.doc_id: r.lines_dropped for r in linededup.dedup_lines(documents(spark, texts)).collect()}
    assert got == {1: 0, 2: 0, 3: 1, 4: 1}


def test_fields_among_the_leading_tokens_and_in_short_lines(spark):
    names = ["Anna", "Boris", "Chloe"]
    posted = [f"Posted by {n} on Monday in the news section of our site" for n in names]
    read = [f"Read more about {n}" for n in names]
    first = [f"{n} wrote this page for our readers" for n in names]
    texts = [(i, "\n".join(x)) for i, x in enumerate(zip(posted, read, first))] + [(9, "Posted by nobody else on another day at all in no section\nTell more about us")]
    got = {r.doc_id: r.text for r in linededup.dedup_lines(documents(spark, texts)).collect()}
    assert got == {0: texts[0][1], 1: "", 2: "", 9: texts[3][1]}


@pytest.mark.parametrize("share", [1000, 20])
def test_lines_match_brute_force(spark, monkeypatch, share):
    """With a small share many lines count as hot and meet their templates by broadcast."""
    monkeypatch.setattr(common, "HOT_SHARE", share)
    rng = random.Random(6)
    pool = [" ".join(rng.choice(["aa", "b", "c7", "42", "dd", "e"]) for _ in range(rng.randint(0, 14))) for _ in range(60)]
    docs = []
    for i in range(60):
        lines = []
        for _ in range(rng.randint(0, 8)):
            words = rng.choice(pool).split()
            if words and rng.random() < 0.5:
                words[rng.randrange(len(words))] = rng.choice(["x", "y9", "zz"])
            lines.append(rng.choice([" ", "  ", "\t"]).join(words) + rng.choice(["", " ", "\r"]))
        docs.append((i, "\n".join(lines)))
    rows = linededup.dedup_lines(documents(spark, docs)).collect()
    assert {r.doc_id: (r.text, r.lines_dropped) for r in rows} == plain_lines(docs) and sum(r.lines_dropped for r in rows) > 50


def test_a_text_of_many_lines(spark):
    many = "\n".join(f"line {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{chr(97 + i // 17576)} of a long text" for i in range(100_000))
    rows = {r.doc_id: r for r in linededup.dedup_lines(documents(spark, [(1, many), (2, many + "\nmy own"), (3, "x" * 3_000_000)])).collect()}
    assert rows[1].lines_dropped == 0 and rows[2].text == "my own" and rows[2].lines_dropped == 100_000 and len(rows[3].text) == 3_000_000


def test_line_dedup_runs_no_python(spark):
    lines = linededup.template_lines(documents(spark, [(1, "a b c d")]), "text", "doc_id")
    plan = linededup.recurring_templates(lines)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_distinct_lines_are_written_once_and_deleted(spark, monkeypatch):
    texts = [(1, "Posted by Ann Lee on Monday in the news section of our site"), (2, "Posted by Bob Ray on Monday in the news section of our site"), (3, "a b c d")]
    lines = linededup.stage(linededup.template_lines(documents(spark, texts), "text", "doc_id"), "lines")
    made, gone = {}, []

    def staged(df, label):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().toString())
        made[label] = common.stage(df, label)
        return made[label]

    monkeypatch.setattr(linededup, "stage", staged)
    monkeypatch.setattr(linededup, "unstage", lambda df: (gone.append(df.staged_path), common.unstage(df)))
    found = linededup.recurring_templates(lines)
    assert [r.first for r in found.collect()] == [1] and list(made) == ["distinct-lines", "filed-lines", "templates"]
    assert sorted(gone) == sorted(made[label].staged_path for label in ("distinct-lines", "filed-lines"))


# Decontamination


def plain_tiles(a, b, least):
    """All maximal matches, longest first, until none is left."""
    marks_a, marks_b, total = [0] * len(a), [0] * len(b), 0
    while True:
        best, found = least, []
        for j in range(len(b)):
            for i in range(len(a)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and not marks_a[i + k] and not marks_b[j + k]:
                    k += 1
                if k > best:
                    best, found = k, []
                if k == best:
                    found.append((i, j))
        if not found:
            return total
        for i, j in found:
            if not any(marks_a[i : i + best]) and not any(marks_b[j : j + best]):
                marks_a[i : i + best] = marks_b[j : j + best] = [1] * best
                total += best


def test_tiles_match_brute_force():
    rng = random.Random(3)
    for _ in range(150):
        size = rng.choice([2, 4, 8])
        a, b = ([rng.randrange(size) for _ in range(rng.randint(0, 40))] for _ in range(2))
        least = rng.choice([2, 3, 5])
        hashed = [np.array(x, np.uint64) * np.uint64(0x9E3779B97F4A7C15) for x in (a, b)]
        tiles = decontaminate.tile(*hashed, least) if b else []
        assert sum(s for *_, s in tiles) == plain_tiles(a, b, least)
        assert all(a[i : i + s] == b[j : j + s] for i, j, s in tiles)


def test_contaminated(spark, monkeypatch):
    item = "the quick brown fox jumps over the lazy dog while seven wizards watch from afar today"
    words = item.split()
    benchmark = spark.createDataFrame([(1, item), (2, "too short"), (3, None), (4, ""), (5, "a b c d e f g h i j")], "item_id long, text string")
    texts = [
        (10, "x y " + item.upper().replace(" ", ", ") + " z"),
        (11, " ".join(words[8:] + ["mid"] + words[:8])),  # put together anew
        (12, " ".join(words[:8]) + " unlike the rest of it"),
        (13, "it is too  short!"),
        (14, "too and short"),
        (15, None),
        (16, ""),
        (17, "a b c d e " * 3000),
        (10, item),
    ]
    docs = documents(spark, texts)
    for size in (decontaminate.BLOCK_BYTES, 40):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        rows = decontaminate.contaminated(docs, benchmark).collect()
        assert sorted((r.doc_id, r.item_id) for r in rows) == [(10, 1), (10, 1), (11, 1), (13, 2)]
        assert decontaminate.decontaminate(docs, benchmark.limit(0)).count() == len(texts)
        clean = decontaminate.decontaminate(docs, benchmark)
        assert sorted(r.doc_id for r in clean.collect()) == [12, 14, 15, 16, 17] and clean.columns == docs.columns
    moved = next(r for r in rows if r.doc_id == 11)
    assert len(moved.tiles) == 2 and moved.coverage == 1.0
    assert decontaminate.contaminated(docs, benchmark.limit(0)).count() == 0 and decontaminate.contaminated(docs.limit(0), benchmark).count() == 0
