"""Text functions against fixed cases: one Spark job a group."""

import pytest
from pyspark.sql import functions as F

from parasift.functions import textnorm as tn
from parasift.operators import cleaning, fidelity, glossary, guards, numbering, quality


def apply(spark, function, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    rows = df.select("i", function(F.col("text")).alias("out")).collect()
    return [r["out"] for r in sorted(rows, key=lambda r: r["i"])]


def check(spark, function, cases):
    assert apply(spark, function, list(cases)) == list(cases.values())


def test_chinese_dates(spark):
    check(spark, tn.convert_chinese_dates, {
        "2025年10月22日": "October 22, 2025",
        "2025年10月": "October 2025",
        "10月22日": "October 22",
        "2025.10.13": "October 13, 2025",
        "2025-01-05": "January 5, 2025",
        "于2025年3月1日签订": "于March 1, 2025签订",
        "2025年13月1日": "2025年13月1日",
        "1009-4067.2025.16.06": "1009-4067.2025.16.06",
        "12025.10.13": "12025.10.13",
        "2024年 ": "2024 ",
        "no date": "no date",
        "": "",
    })


def test_english_dates_and_amounts(spark):
    check(spark, tn.normalize_formats, {
        "January 1987 13th": "January 13, 1987",
        "January 13th, 1987": "January 13, 1987",
        "13 January 1987": "January 13, 1987",
        "05 May 2024": "May 5, 2024",
        "RMB 400,000 yuan": "RMB 400,000",
        "Jan 1987 13": "Jan 1987 13",
        "November 25,,, 2024,..": "November 25, 2024.",
        "wait....": "wait...",
        "5.5 and 1,000 and 1.2.3": "5.5 and 1,000 and 1.2.3",
        "a..b": "a.b",
    })


def test_double_dates(spark):
    check(spark, tn.double_dates, {
        "October 13, 2025 2025.10.13": "October 13, 2025",
        "October 13, 2025 October 13, 2025": "October 13, 2025",
        "October 13, 2025 October 14, 2025": "October 13, 2025 October 14, 2025",
    })


def test_mechanical_steps(spark):
    check(spark, tn.collapse_char_runs, {"missspelled III 10001 aaa ____": "mispelled III 10001 a _", "xxx": "xxx", "中中中": "中", "ééé": "é"})
    check(spark, tn.split_camel, {"helloWorld kWh": "hello World k Wh"})
    check(spark, tn.punctuation_spacing, {"a,b.c 1.5": "a, b. c 1.5"})
    check(spark, tn.parenthesis_spacing, {"x(y)z": "x (y) z"})
    check(spark, tn.cn_punctuation, {"：，。；！？（）【】“”《》、．": ":,.;!?()[]\"\"<>,."})
    check(spark, tn.normalize_quotes, {'say "hi" now': "say “hi” now", "“a”": "“a”", '"': "“", "": ""})
    check(spark, tn.strip_markdown, {"***a*** **b** *c*": "a b c"})
    check(spark, tn.strip_revision_tags, {" a [REVISION_INSTRUCTION]x[/REVISION_INSTRUCTION] b [REVISION_INSTRUCTION]y": "a  b"})


def test_labels(spark):
    check(spark, tn.fix_cn_labels, {
        "【图片】【条形码】【盖章】": "[Image][Barcode][Seal]",
        "一、开始 第二、 （三） (四)": "I.开始 II. (III) (IV)",
        "3、x 10、y": "3.x 10、y",
        "[Photo]": "[Image]",
        "原文：abc 翻译：def": "def",
    })


def test_predicates(spark):
    check(spark, tn.contains_url, {"https://a.com": True, "www.example.org": True, "see a.cn now": True, "x@y.com": True, "plain": False, "a.company": False})
    check(spark, tn.is_protected_token, {"V1.0": True, "2025": True, "L-04077": True, "SRO344608": True, "2026SR0344608": True, "a@b.c": True, "[Image]": True, " ": True, "Cai": False, "No.": False})
    check(spark, tn.route, {" ": "blank", "链接 http://a.com": "url", "System V1": "term", "中文": "model"})
    check(spark, tn.is_sentence_like, {"": True, "Name Co., Ltd.": False, "a" * 81: True, "One; two": True, "a b c d e f g h i j k": True, "A.B.C. x": True})
    check(spark, lambda c: F.array_join(tn.chinese_residue(c), ""), {"a中b文文": "中文文", "abc": "", "": ""})
    check(spark, tn.snippet, {"a  b\n c": "a b c", "x" * 90: "x" * 80 + "…"})
    check(spark, tn.html_escape, {"<a&b>'": "&lt;a&amp;b&gt;'"})


def test_split_long(spark):
    texts = ["short", "a" * 950, "句子。" * 200, "x" * 398 + "__G12__" + "y" * 10, "b" * 390 + "! " + "c" * 30]
    out = apply(spark, tn.split_long, texts)
    assert ["".join(c) for c in out] == texts
    assert all(len(piece) <= 400 for c in out for piece in c)
    assert [len(p) for p in out[1]] == [400, 400, 150]
    assert out[3] == ["x" * 398, "__G12__" + "y" * 10]
    assert out[4] == ["b" * 390 + "!", " " + "c" * 30]


def test_nulls_stay_null(spark):
    functions = [tn.convert_chinese_dates, tn.normalize_formats, tn.fix_cn_labels, tn.normalize_quotes, tn.split_long, tn.snippet, tn.contains_url, guards.mask]
    df = spark.createDataFrame([(None,)], "text string")
    assert list(df.select(*(f(F.col("text")) for f in functions[:-1])).first()) == [None] * (len(functions) - 1)


GUARDED = {
    "1025.00万元": "RMB 10,250,000.00",
    "12.6亿元": "RMB 1.26 billion",
    "5000万": "RMB 50,000,000.00",
    "3亿美元": "USD 300 million",
    "2万亿美元": "USD 2 trillion",
    "1.5万亿元": "RMB 1.5 trillion",
    "1234.5678亿": "RMB 123.45678 billion",
    "800美金": "USD 800.00",
    "see https://a.com/1 and me@x.org, 42": "see https://a.com/1 and me@x.org, 42",
    "1.2.3元": "1.2.3元",
}


def test_guard_round_trip(spark):
    restored = apply(spark, lambda c: guards.restore(guards.mask(c)["text"], guards.mask(c)["guards"]), list(GUARDED))
    assert restored == list(GUARDED.values())
    masked = apply(spark, lambda c: guards.mask(c)["text"], ["看https://a.com/5万元 12"])
    assert not any(ch.isdigit() for ch in masked[0].replace("__G0__", "").replace("__G1__", "").replace("__G2__", ""))
    text, originals = guards.mask_for_polish("On May 5, 2024 at 9:00-10:30 for 300 people")
    assert text == "On __DATE_0__ at __TIME_0__ for __G0__ people" and dict(originals)["__TIME_0__"] == "9:00-10:30"


@pytest.mark.parametrize("cn,en,count", [
    ("合同1025万元", "RMB 10,250,000.00", 0),
    ("合同1025万元", "RMB 10.25 million", 1),
    ("合同12亿元", "1.2 billion yuan", 0),
    ("合同12亿元", "12 hundred million", 0),
    ("合同12亿元", "1.3 billion", 1),
    ("编号 20251234", "No. 20251234", 0),
    ("编号 20251234", "No. 2025", 2),
    ("第 12 条", "nothing", 0),
    ("150人", "no one", 1),
])
def test_fidelity(spark, cn, en, count):
    df = spark.createDataFrame([(cn, en)], "cn string, en string")
    assert len(df.select(fidelity.warnings(F.col("cn"), F.col("en"))).first()[0]) == count


def test_glossary(spark):
    terms = {"系统 V1.0": "System V1.0", "系统": "system", "软件著作权": "software copyright"}
    assert apply(spark, lambda c: glossary.translate_terms(c, terms), ["系统V1.0的软件著作权", "碳中和", "2025年1月2日"]) == ["System V1.0的software copyright", "carbon neutrality", "January 2, 2025"]
    assert apply(spark, lambda c: glossary.replace_terms(c, {}), ['"a"']) == ['"a"']
    rows = spark.createDataFrame([(0, "﻿zh-CN", "en-US"), (1, "中文术语", "英文翻译"), (2, "甲", "A"), (3, "甲", "B"), (4, "乙", "x; y"), (5, "", "z"), (6, "原文", "w")], "pos long, cn string, en string")
    assert [(r.cn, r.en) for r in glossary.clean_terms(rows).collect()] == [("甲", "B")]
    pairs = spark.createDataFrame([("系统与甲", "The SYSTEM"), ("无", "none")], "cn_text string, en_text string")
    known = spark.createDataFrame([("系统", "platform|system"), ("甲", "First")], "cn string, en string")
    assert [r.term_cn for r in glossary.missing_terms(pairs, known).collect()] == ["甲"]


def test_completion():
    names = {"a": "China Software Association", "b": "China Software Testing Center (CSTC)", "c": "Harbor Co., Ltd."}
    variants = glossary.Variants(glossary.variants_of(names))
    complete = lambda t: glossary.complete_terms(t, variants)[0]
    assert complete("the China Software Association said") == "the China Software Association said"
    assert complete("the China Software Testing group") == "the China Software Testing Center (CSTC) group"
    assert complete("Harbor Co. ships") == "Harbor Co., Ltd. ships"
    assert complete("Harbor ships") == "Harbor ships"
    assert complete("see http://harbor co") == "see http://harbor co"
    assert glossary.complete_terms("", variants) == ("", [])


def test_numbering(spark):
    lines = ["I. a", "2. b", "II. c", "Article 3 d", "12、 e", "(1) f", "plain", "Section iv x", "2) g"]
    df = spark.createDataFrame([("f", i, t) for i, t in enumerate(lines)] + [("g", 0, "1. x"), ("g", 1, "I. y"), ("g", 2, "2. z")], "file_id string, pos int, text string")
    rows = {(r.file_id, r.pos): r for r in numbering.normalize(df, ["file_id"]).collect()}
    assert [rows["f", i].kind for i in range(len(lines))] == ["roman", "arabic", "roman", "article", "arabic", "arabic", None, "article", "arabic"]
    assert rows["f", 0].new_text == "1. a" and rows["f", 5].new_text == "(1) f" and rows["f", 4].new_text == "12、 e"
    assert rows["f", 8].first_pos == 1 and rows["f", 0].articles
    assert [rows["g", i].new_text for i in range(3)] == ["1. x", "1. y", "2. z"]
    tie = spark.createDataFrame([("h", 0, "I. x"), ("h", 1, "2.  y"), ("k", 0, "I. x"), ("k", 1, "11. y")], "file_id string, pos int, text string")
    tied = {(r.file_id, r.pos): r for r in numbering.normalize(tie, ["file_id"]).collect()}
    assert tied["h", 1].new_text == "II.  y" and tied["k", 1].new_text == "11. y" and tied["k", 1].beyond and not tied["k", 0].beyond and tied["k", 0].opening


def test_cleaning_leaves_urls(spark):
    df = spark.createDataFrame([(1, "the the cat https://a.com/the the"), (2, "see see Germany'sFraunhofer"), (3, None), (4, "")], "i int, text string")
    out = {r.i: r.text for r in cleaning.clean_segments(df).collect()}
    assert out[1].startswith("the cat https://a.com/the") and out[2] == "see see Germany's Fraunhofer" and out[3] is None and out[4] == ""
    many = {f"词{i}": f"word {i}" for i in range(glossary.MOST_EXPRESSIONS)}  # with the common terms too many for expressions
    for terms in ({"网站": "site"}, {"网站": "site"} | many):
        lines = {"网址链接：https://a.com/网址": "URL：https://a.com/网址", "https://a.com": "https://a.com", "来源：x 来源：www.a.cn 网站 链接": "Source：x 来源：www.a.cn site 链接", "中文": "中文"}
        assert apply(spark, lambda c: cleaning.url_line(c, terms), [*lines, None]) == [*lines.values(), None]


def test_quality(spark):
    warned = spark.createDataFrame([("a", "数字缺失: x")] * 6 + [("b", "重复检测[x]")], "file_id string, warning string")
    rows = {r.file_id: r for r in quality.file_summary(warned, spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "file_id string, paragraphs int")).collect()}
    assert rows["a"].severity == "critical" and rows["a"].categories == {"数字保真": 6} and rows["b"].severity == "minor" and rows["c"].warning_count == 0
