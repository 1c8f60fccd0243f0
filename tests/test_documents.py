"""Word and glossary files made here, read, edited and written."""

import io
import zipfile
from xml.etree import ElementTree as ET

import pytest
from pyspark.sql import functions as F

from parasift.engine import Engine
from parasift.operators import quality
from parasift.plans import translate
from parasift.sources import docx, tables

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
BODY = f"""<?xml version="1.0" encoding="UTF-8"?><w:document {W}><w:body>
<w:p><w:pPr><w:shd w:fill="FF0000"/><w:jc w:val="right"/></w:pPr><w:r><w:t xml:space="preserve">  </w:t></w:r><w:r><w:rPr><w:b/><w:color w:val="ff0000"/><w:sz w:val="28"/><w:shd w:fill="00FF00"/></w:rPr><w:t>一、合同</w:t><w:br/><w:t>金额</w:t></w:r><w:r><w:rPr><w:i/><w:b w:val="0"/><w:highlight w:val="yellow"/></w:rPr><w:t>2025年1月2日</w:t></w:r></w:p>
<w:p/>
<w:tbl><w:tr><w:tc><w:tcPr><w:shd w:fill="0000FF"/></w:tcPr><w:p><w:r><w:t>单元格</w:t></w:r></w:p><w:p/></w:tc></w:tr></w:tbl>
<w:p><w:r><w:txbxContent><w:p><w:r><w:rPr><w:u w:val="single"/></w:rPr><w:t>框</w:t><w:t>多</w:t></w:r></w:p></w:txbxContent></w:r></w:p>
</w:body></w:document>"""
STYLES = f'<w:styles {W}><w:docDefaults><w:rPrDefault><w:rPr><w:rFonts w:asciiTheme="x"/></w:rPr></w:rPrDefault></w:docDefaults><w:style w:styleId="Normal"/><w:style w:styleId="T"><w:rPr><w:rFonts w:ascii="Arial"/></w:rPr></w:style></w:styles>'


def package(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in parts.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml").replace("_rels/", "_rels/"), data)
    return out.getvalue()


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.docx").write_bytes(package(word__document_xml=BODY, word__styles_xml=STYLES))
    return tmp_path


def test_read(spark, folder):
    rows = {(r.region, r.pos): r for r in docx.read_docx(spark, str(folder / "in")).collect()}
    assert set(rows) == {("body", 0), ("body", 1), ("body", 2), ("cell", 0), ("textbox", 0)}
    first = rows["body", 0]
    assert first.text == "  一、合同\n金额2025年1月2日" and first.alignment == 2
    assert [(r.bold, r.italic) for r in first.runs] == [(False, False), (True, False), (False, True)]
    assert first.runs[1].color == "FF0000" and first.runs[1].font_size == 14.0 and first.runs[2].highlight == 7
    assert rows["textbox", 0].text == "框" and rows["textbox", 0].runs[0].underline is False
    assert rows["cell", 0].tbl == 0 and rows["cell", 0].row == 0


def test_format_expressions(spark, folder):
    first = docx.read_docx(spark, str(folder / "in")).where("region = 'body' and pos = 0")
    texts, form = first.select(docx.full_text_runs(F.col("runs"), F.lit("new")), docx.union_format(F.col("runs"))).first()
    assert texts == ["  ", "new", ""]
    assert (form.bold, form.italic, form.highlight, form.color, form.font_size) == (True, True, 7, "FF0000", 12.0)
    actions = spark.createDataFrame([(None, 0, "bold", "true", []), (None, 1, "font_color", "0000FF", [0]), (None, 2, "line_spacing", "1.5", [5])], docx.ACTIONS)
    changed = docx.apply_actions(first, actions).first()
    assert all(r.bold and r.color == "0000FF" for r in changed.runs) and changed.line_spacing is None
    assert docx.describe_actions(actions).orderBy("ord").first().description == "bold → true (all paragraphs)"


def test_translate_write_read(spark, folder):
    out = folder / "out"
    out.mkdir()

    def store(file_id, data):
        target = out / "a_EN.docx"
        target.write_bytes(data)
        return str(target)

    engine = Engine(spark)
    source = engine.read_docx(str(folder / "in"))
    done = engine.translate(source, {"合同": "Contract", "金额": " amount ", "单元格": "Cell", "框": "Box"})
    status = engine.write_docx(str(folder / "in"), done, store).collect()
    assert [r.status for r in status] == ["completed"], status
    back = {(r.region, r.pos): r for r in engine.read_docx(str(out)).collect()}
    assert "Contract" in back["body", 0].text and "January 2, 2025" in back["body", 0].text and back["cell", 0].text == "Cell" and back["textbox", 0].text == "Box"
    xml = zipfile.ZipFile(out / "a_EN.docx").read("word/document.xml").decode()
    assert xml.count("w:shd") == 1 and 'w:line="480"' in xml and docx.FONT in xml  # shading of table cells stays
    styles = zipfile.ZipFile(out / "a_EN.docx").read("word/styles.xml").decode()
    assert "asciiTheme" not in styles and 'w:ascii="Arial"' in styles
    report = engine.quality_report(done).first()
    assert report.paragraphs == 5
    assert "<html>" in engine.html_report(done, "report").first()["html"]
    fixed = engine.fix(done, ["duplicate", "numbering", "term", "fidelity", "chinese"], {"x": "Harbor Co., Ltd."})
    assert fixed.count() == 5
    with pytest.raises(ValueError):
        engine.fix(done, ["magic"], {})


def test_line_ends_and_prefixes_survive():
    given = [{"region": "body", "tbl": None, "runs": [("a\r\nb", False, False, 'x"<'), ("\r", True, False, None)]}, {"region": "body", "tbl": None, "text": ""}]
    raw = docx.new_document(given)
    assert [(s["text"], s["runs"][0]["color"]) for s in docx.segments_of(raw)] == [("a\r\nb\r", 'X"<'), ("", None)]
    place = {"region": "body", "pos": 1, "tbl": None, "row": None, "col": None, "box": None}
    assert [s["text"] for s in docx.segments_of(docx.rewrite(raw, [place | {"new_text": "\r\n c", "format": None}]))] == ["a\r\nb\r", "\r\n c"]
    # The main namespace once with a prefix and once without, and a prefix that means two things.
    more = ' xmlns="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:x="urn:one" x:k="&quot;&#10;"'
    other = package(word__document_xml=BODY.replace(W, W + more).replace("<w:p/>", '<x:y xmlns:x="urn:two" x:k="1"/><w:p/>'))
    done = docx.rewrite(other, [place | {"pos": 0, "new_text": "new", "format": None}])
    assert [(s["text"], s["alignment"]) for s in docx.segments_of(done)] == [("  new", 2)] + [(s["text"], s["alignment"]) for s in docx.segments_of(other)][1:]
    root = ET.fromstring(zipfile.ZipFile(io.BytesIO(done)).read("word/document.xml"))
    assert root.get("{urn:one}k") == '"\n' and root.find(".//{urn:two}y").get("{urn:two}k") == "1"


def test_broken_file_fails_alone(spark, folder):
    (folder / "in/b.docx").write_bytes(b"no zip")
    good = [f"file:{folder}/in/a.docx", f"file:{folder}/in/b.docx"]
    edits = spark.createDataFrame([(f, "body", 0, None, None, None, None, "x", None) for f in good], "file_id string, region string, pos int, tbl int, row int, col int, box int, new_text string, format string")
    status = {r.file_id[-6:]: r.status for r in docx.write_docx(spark, str(folder / "in"), edits, lambda f, d: f).collect()}
    assert status == {"a.docx": "completed", "b.docx": "failed"}


def test_glossary_files(spark, tmp_path):
    (tmp_path / "g.csv").write_bytes("﻿zh-CN,en-US\n甲,First\n甲,\"Second, more\"\n乙\n".encode())
    sheet = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>中文术语</t></is></c><c r="B1" t="s"><v>0</v></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2"><v>42</v></c></row></sheetData></worksheet>'
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    book = io.BytesIO()
    with zipfile.ZipFile(book, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="s" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>英文</t></si><si><r><t>丙</t></r><r><t>丁</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", sheet)
    (tmp_path / "h.xlsx").write_bytes(book.getvalue())
    rows = {(r.file[-5:], r.cn): r.en for r in tables.read_glossaries(spark, str(tmp_path)).collect()}
    assert rows == {("g.csv", "甲"): "Second, more", (".xlsx", "丙丁"): "42"}
    (tmp_path / "x.txt").write_text("no")
    with pytest.raises(ValueError):
        tables.read_glossaries(spark, str(tmp_path))


def test_model_errors_and_retries(spark):
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("busy")
        return "done"

    assert translate.with_retries(flaky, pause=0) == "done"

    class Broken:
        def translate(self, text, terms, instruction=""):
            raise OSError("down")

        def polish(self, text):
            raise OSError("down")

    translate.FIRST_PAUSE, before = 0.0, translate.FIRST_PAUSE
    df = spark.createDataFrame([("f", "body", 0, "碳中和很重要")], "file_id string, region string, pos int, text string")
    row = translate.translate_segments(df, {}, Broken, 1).first()
    translate.FIRST_PAUSE = before
    assert row.translated_text == "carbon neutrality很重要"
    answer = spark.createDataFrame([('x {"actions": [{"indices": [1], "action": "bold", "value": "true"}]} y',), ("none",)], "t string")
    parsed = [r.a for r in answer.select(translate.parse_actions(F.col("t")).alias("a")).collect()]
    assert parsed[0].actions[0].action == "bold" and parsed[1].actions == []
    assert translate.interpret_feedback(["p"], "f", lambda p: 'ok {"actions": [], "needs_retranslation": true}') == {"needs_retranslation": True, "actions": []}


def test_stream(spark, folder):
    from parasift.streaming import intake

    segments = intake.read_docx_stream(spark, str(folder / "in"))
    intake.run_available(segments, {"合同": "Contract"}, str(folder / "done"), str(folder / "state")).awaitTermination()
    assert spark.read.parquet(str(folder / "done/segments")).count() == 5


def test_residue_places(spark):
    rows = [("f", "body", 2, None, None, None, None, " 中 x"), ("f", "cell", 0, 0, 1, 2, None, "甲"), ("f", "cell", 1, 0, 1, 2, None, "乙"), ("f", "textbox", 0, None, None, None, 3, "丙"), ("f", "body", 4, None, None, None, None, "clean")]
    df = spark.createDataFrame(rows, "file_id string, region string, pos int, tbl int, row int, col int, box int, text string")
    assert {r.warning for r in quality.residue_warnings(df).collect()} == {"Para 3: 中 x", "Table 1R2C3: 甲\n乙", "TextBox 4P1: 丙"}
