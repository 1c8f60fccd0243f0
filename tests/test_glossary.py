"""Replacement and containment for glossaries of any size, against plain loops."""

import random
import time

import pytest

from parasift.operators import glossary
from parasift.operators.glossary import Replacer


def in_turn(text, pairs):
    for cn, en in pairs:
        text = text.replace(cn, en)
    return text


def test_replacer_is_replacement_in_turn():
    rng = random.Random(5)
    for letters in ("abc", "ab", "天地a"):
        for _ in range(3000):
            some = {"".join(rng.choices(letters, k=rng.randint(1, 4))): "".join(rng.choices(letters, k=rng.randint(0, 4))) for _ in range(rng.randint(1, 6))}
            pairs = sorted(some.items(), key=lambda t: -len(t[0]))
            text = "".join(rng.choices(letters, k=rng.randint(0, 25)))
            assert Replacer(pairs)(text) == in_turn(text, pairs), (text, pairs)
    assert Replacer([])("x") == "x" and Replacer([("", "y")])("x") == "x"


def test_replacer_is_linear():
    """The time follows the text, with fifty thousand terms in it."""
    rng = random.Random(1)
    pairs = sorted({"".join(rng.choices("天地玄黄宇宙洪荒", k=rng.randint(4, 9))): f"w{i} " for i in range(50_000)}.items(), key=lambda t: -len(t[0]))
    replace, keys = Replacer(pairs), [cn for cn, _ in pairs]
    text = "".join(rng.choice(keys) if rng.random() < 0.2 else "abc " for _ in range(40_000))
    took = []
    for part in (text[: len(text) // 8], text):
        began = time.process_time()
        done = replace(part)
        took.append(time.process_time() - began)
    assert took[1] < 40 * took[0] and not any(cn in done for cn in keys[:200])


@pytest.mark.parametrize("block", [200_000, 3])
def test_a_glossary_as_a_table(spark, monkeypatch, block):
    monkeypatch.setattr(glossary, "TERMS_A_BLOCK", block)
    glossary._block_replacer.cache_clear()
    rng = random.Random(2)
    terms = [("".join(rng.choices("abc", k=rng.randint(1, 4))), "".join(rng.choices("abcX", k=rng.randint(0, 3))), i) for i in range(25)] + [("", "x", 98), ("zz", None, 99)]
    texts = ["".join(rng.choices("abc ", k=rng.randint(0, 30))) for _ in range(40)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    first: dict = {}
    for cn, en, _ in terms:
        if cn and en is not None:
            first.setdefault(cn, en)
    pairs = sorted(first.items(), key=lambda t: -len(t[0]))
    got = glossary.replaced_by_table(df, "text", spark.createDataFrame(terms, "cn string, en string, ord long"))
    assert {r.id: r.text for r in got.collect()} == {i: None if t is None else in_turn(t, pairs) for i, t in enumerate(texts)}
    none = spark.createDataFrame([], "cn string, en string, ord long")
    assert [r.text for r in glossary.replaced_by_table(df.where("id < 2"), "text", none).orderBy("id").collect()] == texts[:2]


@pytest.mark.parametrize("share", [1000, 8])
def test_missing_terms_by_anchors(spark, monkeypatch, share):
    monkeypatch.setattr(glossary, "HOT_SHARE", share)
    rng = random.Random(share)
    word = lambda low, high: "".join(rng.choices("天地玄😀é", [9, 6, 3, 2, 1], k=rng.randint(low, high)))
    terms = {word(1, 4): rng.choice(["sky", "Sky | heaven", "|", "earth", " EARTH "]) for _ in range(40)}
    rows = [(i, word(0, 25), rng.choice(["the sky", "Heaven and earth", "", None])) for i in range(80)] + [(None, "天地", None), (3, None, "x"), (7, "天地", "sky"), (7, "天地", "sky")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id int, cn_text string, en_text string, row string")
    table = spark.createDataFrame([(c, "wrong", 0) for c in terms] + [(c, e, 1) for c, e in terms.items()] + [("", "x", 2), ("玄", None, 3)], "cn string, en string, ord int")
    got = sorted((str(r.id), r.cn_text, r.term_cn, r.term_en) for r in glossary.missing_terms(df, table).collect())
    there = lambda en, target: any(v in (target or "").lower() for v in glossary._variants(en))
    want = sorted((str(i), cn, c, e) for i, cn, en in rows for c, e in terms.items() if c in (cn or "") and not there(e, en))
    assert got == want and glossary.missing_terms(df, table).columns == [*df.columns, "term_cn", "term_en"]
    assert glossary.missing_terms(df.where("false"), table).count() == 0 and glossary.missing_terms(df, table.where("false")).count() == 0
