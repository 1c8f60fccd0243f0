"""Stages of the pipeline against brute force on small fixtures."""

import random

import numpy as np
import pytest

import corpus_pipeline as pipeline
from parasift.llm import nearcopies

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "x", "y", None if t is None else len(t)) for i, t in texts], SCHEMA)


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def similarity(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def plain_survivors(texts):
    """Ids that stay: the least of each group that similarities of 0.8 or more link."""
    root = {i: i for i, _ in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in texts:
        for j, t in texts:
            if i < j and similarity(s, t) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return sorted(i for i in root if root[i] == i)


@pytest.mark.parametrize("texts_a_task,pivots", [(1000, 1024), (2, 3)])
def test_near_dedup_stage_matches_brute_force(spark, monkeypatch, texts_a_task, pivots):
    """With a low bound groups of candidates are held against pivots, a few at a time."""
    monkeypatch.setattr(nearcopies, "GROUP_TEXTS", texts_a_task)
    monkeypatch.setattr(nearcopies, "MOST_PIVOTS", pivots)
    rng = random.Random(5)
    texts = []
    for i in range(40):
        words = ["w%d" % rng.randrange(3000) for _ in range(rng.randint(1, 300))]
        texts.append((len(texts), " ".join(words)))
        for _ in range(rng.randint(0, 4)):
            words = list(words)
            for _ in range(rng.randint(0, 1 + len(words) // 40)):
                words[rng.randrange(len(words))] = "edit%d" % rng.randrange(50)
            texts.append((len(texts), " ".join(words)))
    texts += [(1000, "two words"), (1001, "Two  WORDS"), (1002, None), (1003, "  ")]
    want = plain_survivors(texts)
    near = [(i, j) for i, s in texts for j, t in texts if i < j and s != t and 0.8 <= similarity(s, t) < 0.95]
    assert len(near) > 20
    kept = pipeline.near_dedup_stage(spark, documents(spark, texts), "")
    assert sorted(r.doc_id for r in kept.collect()) == want and kept.columns == documents(spark, []).columns


def test_near_dedup_stage_of_nothing(spark):
    assert pipeline.near_dedup_stage(spark, documents(spark, []), "").count() == 0


def test_line_stage_drops_lines_only(spark):
    """A document goes only without any word left, and every line that went stands in one that stays."""
    shared = ["Terms of use apply to all of this site", "Contact the office during the usual opening hours", "This page was last changed by its own author"]
    texts = [
        (1, f"{shared[0]}\nfirst own words of one document"),
        (2, f"{shared[0]}\nmine alone\n{shared[0]}"),  # the words left are a fraction
        (3, f"{shared[0]}\n{shared[1]}\n{shared[0]}\n{shared[0]}\n{shared[0]}\n{shared[0]}"),  # owns a line, 84 % recurring
        (4, f"{shared[1]}\nfourth own words of a document"),
        (5, f"{shared[0]}\n{shared[1]}\n \n"),  # nothing of its own
        (6, f"{shared[2]}"),
        (7, None),
        (8, ""),
        (9, f"{shared[2]}\nok"),
    ]
    kept = {r.doc_id: (r.text, r.n_chars) for r in pipeline.line_stage(spark, documents(spark, texts), "").collect()}
    assert sorted(kept) == [1, 2, 3, 4, 6, 7, 8, 9]
    assert kept[2] == ("mine alone", 10) and kept[3][0] == shared[1] and kept[9] == ("ok", 2) and kept[7] == (None, None)
    held = {line for text, _ in kept.values() for line in (text or "").split("\n")}
    assert all(line in held for _, text in texts for line in (text or "").split("\n") if line.strip())


def test_linked_sets_match_brute_force():
    rng = random.Random(8)
    for _ in range(60):
        core = [rng.getrandbits(64) for _ in range(rng.choice([5, 12, 30]))]
        sets = [np.array(sorted({*rng.sample(core, rng.randint(len(core) // 2, len(core))), *(rng.getrandbits(64) for _ in range(rng.randint(0, 4)))}), np.uint64) for _ in range(40)]
        sets += [np.zeros(0, np.uint64)] * 2
        like = lambda a, b: not a | b or 5 * len(a & b) >= 4 * len(a | b)
        whole = [set(s.tolist()) for s in sets]
        want = [-1] * len(sets)
        for first in range(len(sets)):
            queue = [first] if want[first] < 0 else []
            while queue:
                at = queue.pop()
                if want[at] < 0:
                    want[at] = first
                    queue += [i for i in range(len(sets)) if want[i] < 0 and like(whole[at], whole[i])]
        assert nearcopies.linked(sets).tolist() == want


def test_near_dedup_stage_with_repeated_and_missing_ids(spark):
    """Rows that share an id but not a text are two documents; rows without an id are copies like any other."""
    one, two, three = (" ".join(f"{c}{i}" for i in range(30)) for c in "abc")
    rows = [(1, one), (1, two), (1, one), (2, two), (None, one), (None, three), (None, three)]
    kept = pipeline.near_dedup_stage(spark, documents(spark, rows), "").collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == [(0, three), (1, one), (1, two)]
