"""Numbering of documents of very unequal length, against a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from parasift.functions.textnorm import ROMAN_NUMERALS
from parasift.operators import numbering


def plain(rows):
    """(kind, seq, mixed, first place of an equal number, whether it opens its document) of each (file, pos, kind, number)."""
    out = {}
    for file in {r[0] for r in rows}:
        own = sorted(r for r in rows if r[0] == file)
        counts = {k: sum(r[2] == k for r in own) for k in ("roman", "arabic")}
        mixed = None if not all(counts.values()) else "roman" if counts["roman"] >= counts["arabic"] else "arabic"
        seen: dict = {}
        for _, pos, kind, number in own:
            first = seen.setdefault((kind, number), pos) if kind else pos
            out[file, pos] = (kind, number if kind else None, mixed, first if first < pos else None, pos == own[0][1])
    return out


@pytest.mark.parametrize("share", [1000, 3])
def test_unequal_documents(spark, monkeypatch, share):
    """With a small share the long document and its frequent numbers come by broadcast."""
    monkeypatch.setattr(numbering, "HOT_SHARE", share)
    rng, rows = random.Random(share), []
    for file, size in (("long", 900), (None, 40), ("none", 5), *((f"f{i}", 12) for i in range(20))):
        for pos in rng.sample(range(2000), size):
            kind = None if file == "none" else rng.choice(["roman", "roman", "arabic", "article", None])
            rows.append((str(file), pos, kind, rng.randint(1, 9)))
    shown = {"roman": lambda n: f"{ROMAN_NUMERALS[n - 1]}. item", "arabic": lambda n: f"{n}. item", "article": lambda n: f"Article {n} says", None: lambda n: "plain text"}
    df = spark.createDataFrame([(None if f == "None" else f, p, shown[k](n), "x") for f, p, k, n in rows], "file string, pos int, text string, extra string").repartition(6)
    found = numbering.normalize(df, ["file"])
    got = {(str(r.file), r.pos): (r.kind, r.seq, r.mixed, r.first_pos, r.opening) for r in found.collect()}
    assert got == plain(rows) and found.count() == len(rows)
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_nothing_to_number(spark):
    df = spark.createDataFrame([("a", 0, None), ("a", 1, "")], "file string, pos int, text string")
    rows = {r.pos: r for r in numbering.normalize(df, ["file"]).collect()}
    assert rows[0].opening and not rows[1].opening and rows[1].kind is None and rows[0].new_text is None
    assert numbering.normalize(df.where("false"), ["file"]).withColumn("told", F.size(numbering.warnings())).collect() == []


def test_lines_are_classified_once_and_meet_one_table(spark, monkeypatch):
    monkeypatch.setattr(numbering, "HOT_SHARE", 2)
    df = spark.createDataFrame([(f"f{i % 7}", i, f"{i % 9 + 1}. x") for i in range(70)], "file string, pos int, text string")
    found = numbering.normalize(df, ["file"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "Article|Clause" not in plan
    assert sum(r.first_pos is not None for r in found.collect()) == 70 - 7 * 9
