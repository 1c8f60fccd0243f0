"""Graded removal of adjacent repeats, against fixed cases and a plain rescan."""

import random
import re

import pytest

from parasift.operators import dedup


@pytest.mark.parametrize("text,expected", [
    ("the the cat", "the cat"),
    ("V1.0 V1.0", "V1.0"),
    ("2025 2025 plan", "2025 plan"),
    ("software testing software testing report", "software testing report"),
    ("a b c a b c a b c", "a b c"),
    ("Cai Cai", "Cai Cai"),
    ("No. No. 5", "No. No. 5"),
    ("very very good", "very very good"),
    ("x  the\tthe  y", "x  the  y"),
    ("", ""),
    ("  lead the the tail  ", "  lead the tail  "),
])
def test_removal(text, expected):
    assert dedup.remove_duplicates(text)[0] == expected


def test_audit():
    assert [e["reason"] for e in dedup.remove_duplicates("the the Cai Cai 5 5")[1]] == ["stopword_dup", "id_number_dup", "single_content_token"]
    assert dedup.remove_duplicates("red fox red fox", {"fox"})[1][0]["reason"] == "protected_keep"
    assert [d["removable"] for d in dedup.find_duplicates("the the Cai Cai red fox red fox")] == [True, False, True]


def rescanned(text, protected):
    """From the first word again after each removal."""
    while True:
        tokens = [(m[0], m.start(), m.end()) for m in re.finditer(r"\S+", text)]
        words, at = [t[0] for t in tokens], 0
        while at < len(words):
            k = next((k for k in range(min(8, (len(words) - at) // 2), 0, -1) if words[at : at + k] == words[at + k : at + 2 * k]), 0)
            if not k:
                at += 1
            elif dedup._grade(words[at : at + k], protected)[1]:
                text = text[: tokens[at + k - 1][2]] + text[tokens[at + 2 * k - 1][2] :]
                break
            else:
                at += k
        else:
            return text


def test_resumed_scan_equals_full_rescan():
    rng = random.Random(5)
    for _ in range(1500):
        vocabulary = ["the", "of", "Cai", "Bo", "42", "x"][: rng.randint(2, 6)]
        text = "".join(rng.choice(vocabulary) + rng.choice([" ", "  ", "\n"]) for _ in range(rng.randint(0, 60)))
        protected = {"Bo"} if rng.random() < 0.3 else set()
        assert dedup.remove_duplicates(text, protected)[0] == rescanned(text, protected), text


def test_columns_and_protected(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("s", "the the Cai Cai 7 7"), ("s", "Bo. bo"), ("s", None)], "source string, text string")
    assert [r[0] for r in df.select(F.size(dedup.adjacent_repeats(F.col("text")))).collect()][:2] == [3, 0]
    assert [r.t and r.t.text for r in df.select(dedup.dedup(F.col("text")).alias("t")).collect()] == ["the Cai Cai 7", "Bo. bo", None]
    assert {(r.token, r.n) for r in dedup.protected_tokens(df, "text", ["source"]).collect()} == {("cai", 2), ("bo", 2)}
