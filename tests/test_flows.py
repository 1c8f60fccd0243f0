"""Translation, fixes, revision and storage with a translator that fails in known ways."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from parasift.engine import Engine
from parasift.operators import cleaning, dedup, glossary
from parasift.plans import jobs, reports, translate
from parasift.plans.calls import Calls
from parasift.sources import docx
from tests.test_documents import BODY, STYLES, package

SEGMENT = "file_id string, region string, pos int, tbl int, row int, col int, box int, text string"


def segments(spark, texts, region="body"):
    return spark.createDataFrame([("f", region, i, None, None, None, None, t) for i, t in enumerate(texts)], SEGMENT)


class Forgetful:
    """Leaves Chinese at first, drops numbers, and obeys what it is told the second or third time."""

    def translate(self, text, terms, instruction=""):
        if "甲" in text:
            return "first answer 甲" if translate.FULLY not in instruction and translate.STRICTLY not in instruction else "second answer" if "乙" not in text else "third answer" if translate.STRICTLY in instruction else "second 乙"
        if "丁" in text:
            return "always 丁"
        if "金额" in text:
            assert translate.PRESERVE in instruction or translate.FULLY in instruction or not instruction
            return "the amount __G0__" if translate.PRESERVE in instruction and "500万元" in instruction else "the amount"
        if "润色" in text:
            return "On May 5, 2024 at 9:00-10:30 the group of 300 people met " + "and talked of this, that and many other things which nobody wrote down at the time"
        return "well well Rare Rare Word Rare Rare Word"

    def polish(self, text):
        assert "2024" not in text and "300" not in text and "10:30" not in text
        return text.replace("met", "assembled") + " ,, done"


def test_the_retry_ladder(spark):
    texts = ["甲很重要", "甲乙很重要", "丁很重要", "合同金额500万元", "请润色这个段落", "注意事项", "short", " ", None, "链接：https://a.com 丁"]
    rows = {r.pos: r for r in translate.translate_segments(segments(spark, texts), {"丁": "Ding", "很重要": " matters", "应": "Must Be There"}, Forgetful, 2).collect()}
    assert rows[0].translated_text == "second answer" and rows[1].translated_text == "third answer"
    assert rows[2].translated_text == "Ding matters"  # terms alone are clean
    assert rows[3].translated_text == "the amount RMB 5,000,000.00" and translate.RESTORED in rows[3].warnings
    assert rows[4].translated_text.startswith("On May 5, 2024 at 9:00-10:30 the group of 300 people assembled") and rows[4].translated_text.endswith(", done")
    assert rows[5].translated_text == "well Rare Rare Word" or rows[5].translated_text.startswith("well ")
    assert rows[6].route == "term" and rows[7].translated_text == " " and rows[8].translated_text is None
    assert rows[9].route == "url" and rows[9].translated_text.startswith("link：https://a.com") or rows[9].translated_text.startswith("link:https://a.com")
    assert "Ding" in rows[9].translated_text and len(rows) == len(texts)


def test_missing_terms_are_told(spark):
    df = segments(spark, ["系统与应用都在这里"])
    row = translate.translate_segments(df, {"系统": "platform", "应用": "application|app"}, Forgetful, 1).first()
    assert sorted(w.split("「")[1].split("」")[0] for w in row.warnings if w.startswith("术语缺失")) == ["应用", "系统"]


def test_protected_words_of_a_region(spark):
    rare = spark.createDataFrame([("f", "rare"), ("g", "other")], "file_id string, token string")
    df = spark.createDataFrame([("f", "the rare thing the rare thing"), ("g", "the rare thing the rare thing"), (None, "x")], "file_id string, text string")
    rows = {r.file_id: r.protected for r in dedup.with_protected(df, "text", ["file_id"], rare).collect()}
    assert rows == {"f": ["rare"], "g": None, None: None}


def test_fixes_are_audited_anew(spark):
    schema = SEGMENT + ", translated_text string, warnings array<string>"
    row = lambda file, pos, cn, en, *told: (file, "body", pos, None, None, None, None, cn, en, list(told))
    rows = [row("a", 0, "很长的一段中文", "the the text", "重复检测[可自动删除]: 「the」"), row("a", 1, "合同金额500万元是", "the amount", "old"), row("b", 0, "没有", "fine", "old"), ("a", "textbox", 0, None, None, None, 3, "框", "the the", ["old"])]
    done = {(r.file_id, r.region, r.pos): r for r in translate.fix_segments(spark.createDataFrame(rows, schema), ["duplicate"], {}).collect()}
    assert done["a", "body", 0].translated_text == "the text" and done["a", "body", 0].warnings == []
    assert any(w.startswith("金额/数量缺失") for w in done["a", "body", 1].warnings) and "old" not in done["a", "body", 1].warnings
    assert done["b", "body", 0].warnings == ["old"] and done["a", "textbox", 0].translated_text == "the the"


def test_a_revision_reaches_the_file(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.docx").write_bytes(package(word__document_xml=BODY, word__styles_xml=STYLES))
    (tmp_path / "in/b.docx").write_bytes(b"no zip")
    engine = Engine(spark)
    assert [(r.file_id[-6:], r.status) for r in engine.broken_files(str(tmp_path / "in")).collect()] == [("b.docx", "failed")]
    source = engine.read_docx(str(tmp_path / "in"))
    assert source.select("file_id").distinct().count() == 1
    done = engine.translate(source, {"合同": "Contract"})
    reply = '{"needs_retranslation": false, "actions": [{"indices": [0], "action": "font_name", "value": "宋体"}, {"indices": [0], "action": "line_spacing", "value": "1.5"}, {"indices": [], "action": "italic", "value": "true"}]}'
    revised = engine.revise(source, done, "宋体 please", {}, lambda prompt: reply if prompt.startswith("[0]   一、合同") and "[3] 单元格" in prompt and prompt.endswith("宋体 please") else "wrong")
    files = {}
    status = engine.write_docx(str(tmp_path / "in"), revised, lambda f, data: str((tmp_path / f.split("/")[-1]).write_bytes(data))).collect()
    assert {r.file_id[-6:]: r.status for r in status} == {"a.docx": "completed", "b.docx": "failed"}, files
    xml = zipfile.ZipFile(tmp_path / "a.docx").read("word/document.xml").decode()
    assert 'w:ascii="宋体"' in xml and 'w:line="360"' in xml and xml.count("<w:i") >= 3
    again = engine.revise(source, None, "bold", {"合同": "Contract"}, lambda prompt: "no idea")
    assert again.where("asked.bold").count() == again.count()  # the feedback's own words, translated anew


def test_actions_go_to_the_listed_segments_of_their_file(spark):
    place = lambda file, region, **at: (file, region, *(at.get(k) for k in ("pos", "tbl", "row", "col", "box")), f"{file} {region} {at}", [("x", False, False, False, None, None, None, "00AA00")])
    rows = [place(f, "textbox", pos=0, box=0) for f in "ab"] + [place(f, "cell", pos=0, tbl=0, row=r, col=0) for f in "ab" for r in (1, 0)] + [place(f, "body", pos=p) for f in "ab" for p in range(3)]
    segments = spark.createDataFrame(rows, f"file_id string, region string, pos int, tbl int, row int, col int, box int, text string, runs array<{docx.RUN}>").repartition(5)
    done = segments.withColumns({"translated_text": F.concat(F.lit("old "), "text"), "warnings": F.array().cast("array<string>")})

    def ask(prompt):
        if prompt.startswith("[0] a"):
            return '{"needs_retranslation": false, "actions": [{"indices": [1, 4, 5, 77], "action": "bold", "value": true}, {"indices": [], "action": "font_color", "value": "0000FF"}, {"indices": [1], "action": "font_color", "value": "FF0000"}, {"indices": [], "action": "dance", "value": "x"}]}'
        raise OSError("down")

    answers = translate.feedback_actions(segments, "make it italic", ask, Calls(2, 2, pause=0.01))
    found, applied = Engine(spark).revise_with(segments, done, "make it italic", answers, {})
    rows = found.select("file_id", "region", "pos", "row", "asked.*", F.col("runs")[0].alias("run"), "translated_text").collect()
    at = {(r.file_id, r.region, r.row if r.region == "cell" else r.pos): r for r in rows}
    assert len(at) == 12 and all(r.translated_text.startswith("old ") for r in rows)
    assert {k[1:] for k, r in at.items() if k[0] == "a" and r.bold} == {("body", 1), ("cell", 1), ("textbox", 0)}
    assert at["a", "body", 1].color == "FF0000" and at["a", "cell", 0].color == "0000FF" and at["a", "cell", 0].run.color == "0000FF"
    assert all(r.italic and r.bold is None and r.color is None and r.run.color == "00AA00" for k, r in at.items() if k[0] == "b")
    told = {r.file_id: r.applied for r in applied.collect()}
    assert told["b"] == ["italic → true (all paragraphs)"] and told["a"][0] == "bold → true (paragraphs [1, 4, 5, 77])"


def test_only_the_files_that_need_it_are_translated_again(spark):
    rows = [(f, "body", i, None, None, None, None, "系统") for f in "abc" for i in range(2)]
    source = spark.createDataFrame(rows, SEGMENT)
    done = source.where("file_id <> 'c'").withColumns({"route": F.lit("model"), "warnings": F.array().cast("array<string>"), "translated_text": F.lit("old")})
    answers = spark.createDataFrame([("a", True, []), ("b", False, []), ("c", False, [])], "file_id string, needs_retranslation boolean, actions array<struct<indices:array<int>,action:string,value:string>>")
    found = translate.revise_segments(source, done, "shorter", answers, {"系统": "system"})
    assert sorted((r.file_id, r.translated_text) for r in found.collect()) == [("a", "system")] * 2 + [("b", "old")] * 2 + [("c", "system")] * 2


def test_pages_hold_all_warnings_with_their_texts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(reports, "WARNINGS_A_PAGE", 3)
    schema = SEGMENT + ", translated_text string, warnings array<string>"
    rows = [("a b/1", "body", i, None, None, None, None, f"源 <{i}>", f"target & {i}", [f"术语缺失: 「{i}」"]) for i in range(4)]
    rows += [("a b/1", "cell", p, 0, 1, 0, None, f"格{p}", f"cell 留{p}", []) for p in range(2)] + [("a b/1", "textbox", 0, None, None, None, 0, "框", "the the box", None), ("clean", "body", 0, None, None, None, None, "x", "x", [])]
    translated = spark.createDataFrame(rows, schema).repartition(4)
    warned = {r.number: r for r in reports.numbered_warnings(translated).collect()}
    assert [warned[n].cn for n in range(6)] == ["源 <0>", "源 <1>", "源 <2>", "源 <3>", "格0", "框"] and sorted(warned) == list(range(6))
    assert warned[4].warning.startswith("Table 1R2C1: cell 留0") and warned[4].fix == "chinese" and warned[5].fix == "duplicate" and warned[5].en == "the the box"
    engine = Engine(spark)
    pages = engine.html_report(translated, "t & t")
    found = {(r.file_id, r.page): (r.pages, r.html) for r in pages.collect()}
    assert set(found) == {("a b/1", 1), ("a b/1", 2), ("clean", 1)} and {p for p, _ in found.values()} == {2, 1}
    assert "<p>源 &lt;2&gt;</p><p>target &amp; 2</p>" in found["a b/1", 1][1] and "t &amp; t" in found["clean", 1][1] and "class='clean'" in found["clean", 1][1]
    assert "data-fix='duplicate'" in found["a b/1", 2][1] and "<li value='3'" in found["a b/1", 2][1] and "<li value='2'" not in found["a b/1", 2][1]
    stored = engine.store_pages(pages, f"{tmp_path}/pages").collect()
    assert {open(r.path, encoding="utf-8").read() for r in stored} == {h for _, h in found.values()} and len({r.path for r in stored}) == 3


def test_pages_of_jobs(spark, monkeypatch):
    monkeypatch.setattr(reports, "FILES_A_PAGE", 2)
    schema = "job_id string, file_id string, pos int, status string, warning_count long, severity string, categories map<string,int>, error string"
    rows = [("j", f"f{i}", i, "completed", 3, "moderate", {"术语": 2, "其他": 1}, None) for i in range(3)] + [("j", "bad", 3, "failed", 0, None, None, "<no zip>"), ("k", "one", None, "completed", 0, None, None, None)]
    names = spark.createDataFrame([("f1", "Contract")], "file_id string, name string")
    pages = {(r.job_id, r.page): r for r in Engine(spark).job_report(spark.createDataFrame(rows, schema), names, "job").collect()}
    assert set(pages) == {("j", 1), ("j", 2), ("k", 1)} and pages["j", 2].pages == 2 and pages["k", 1].pages == 1
    assert "<h2>Contract</h2>" in pages["j", 1].html and "<li>其他: 1</li><li>术语: 2</li>" in pages["j", 1].html and "f2" not in pages["j", 1].html
    assert "&lt;no zip&gt;" in pages["j", 2].html and "<dt>warnings</dt><dd>9</dd>" in pages["j", 2].html and "<dd>1</dd>" in pages["j", 2].html


def test_stored_glossaries_and_bundles(spark, tmp_path):
    (tmp_path / "g.csv").write_text("甲,First\n乙,Second\n", encoding="utf-8")
    (tmp_path / "bad.xlsx").write_bytes(b"no zip")
    engine, store = Engine(spark), str(tmp_path / "store")
    assert engine.save_glossary(store, "g1", str(tmp_path / "*.*")) == 2
    assert engine.stored_glossary(store, "g1") == {"甲": "First", "乙": "Second"} == engine.stored_glossary(store, "g1")
    with pytest.raises(KeyError):
        engine.stored_glossary(store, "g2")
    results = spark.createDataFrame([("j", f"f{i}", i, "completed" if i % 2 else "failed", f"out{i}") for i in range(6)], "job_id string, file_id string, pos int, status string, output string")
    target = io.BytesIO()
    assert jobs.bundle(results, spark.createDataFrame([("f1", "One")], "file_id string, name string"), lambda output: output.encode(), target) == 3
    assert zipfile.ZipFile(target).namelist() == ["One-EN.docx", "f3-EN.docx", "f5-EN.docx"]
    assert engine.ping() == "test"


def test_large_glossaries_equal_small_ones(spark, monkeypatch):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("甲乙丙ab ") for _ in range(n))
    terms = {word(rng.randint(1, 4)): word(rng.randint(0, 4)) + rng.choice(["", "|" + word(2)]) for _ in range(40)}
    texts = [word(rng.randint(0, 60)) for _ in range(80)] + [None, ""]
    df = spark.createDataFrame([(t, word(30)) for t in texts], "t string, e string")
    columns = lambda: [glossary.replaced_in_order(F.col("t"), terms), glossary.unused_terms(F.col("t"), F.col("e"), terms), glossary.translate_terms(F.col("t"), terms)]
    small = df.select(*columns()).collect()
    monkeypatch.setattr(glossary, "MOST_EXPRESSIONS", 0)
    assert df.select(*columns()).collect() == small


def test_fifty_thousand_terms(spark):
    terms = {f"词{i}号": f"Name {i} of the List" for i in range(50_000)}
    df = spark.createDataFrame([("见词77号与词49999号", "see Name 77 of the rest")], "cn string, en string")
    row = df.select(glossary.replace_terms(F.col("cn"), terms), glossary.unused_terms(F.col("cn"), F.col("en"), terms), glossary.completed(F.col("en"), terms)["text"]).first()
    assert row[0] == "见Name 77 of the List与Name 49999 of the List" and [t.cn for t in row[1]] == ["词77号", "词49999号"] and row[2] == "see Name 77 of the List rest"


def test_new_documents_read_back():
    given = [{"region": "body", "tbl": None, "text": "a\nb"}, {"region": "cell", "tbl": 0, "runs": [("x", True, False, "FF0000")]}]
    found = docx.segments_of(docx.new_document(given))
    assert [(s["region"], s["text"]) for s in found] == [("body", "a\nb"), ("cell", "x")] and found[1]["runs"][0]["bold"]


def test_only_texts_with_a_word_twice_are_searched_for_repeats(spark):
    texts = ["the the end", "http://a.b中 中", "see http://a.com the the", "a\x1ca of\x1fof b", "x，y y", "中国　中国 12 12", "no word again", "www.a.com aaa", "", None, "for for www.b.com or"]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    job = translate._Job({}, translate.OfflineTranslator, None, [])
    got = {r.n: r.text for r in job.clean(rows, "text").collect()}
    assert got == {r.n: r.text for r in cleaning.clean_segments(rows, "text").select("n", "text").collect()}
    twice = {r.n for r in rows.where(cleaning.repeated(cleaning.stretched(F.col("text")))).collect()}
    assert twice == {0, 1, 2, 3, 5, 10}
    assert {r.n for r in rows.where(cleaning.word_twice(F.col("text"))).collect()} >= {0, 2, 3, 5}
