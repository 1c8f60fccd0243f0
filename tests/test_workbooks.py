"""Cells of workbooks by type: each kind of number format against the text it stands for."""

import io
import zipfile

import pytest

from parasift.sources import tables

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
FORMATS = ["General", "14", "yyyy-mm-dd hh:mm", "[h]:mm:ss", "0.00", '"days" 0', "20", "[Red]0;d", "46", "m/d/yy;@", "[$-409]mmm d"]


def workbook(cells, date1904=False):
    """A workbook with ``cells`` (type, style, value) in column B, beside a term each."""
    own = {f: n for n, f in enumerate((f for f in FORMATS if not f.isdigit() and f != "General"), 164)}
    styles = "".join(f"<numFmt numFmtId='{n}' formatCode='{f.replace(chr(34), '&quot;')}'/>" for f, n in own.items())
    used = "".join(f"<xf numFmtId='{0 if f == 'General' else own.get(f, f)}'/>" for f in FORMATS)
    rows = "".join(
        f"<row r='{i + 1}'><c r='A{i + 1}' t='inlineStr'><is><t>词{i}</t></is></c><c r='B{i + 1}' t='{kind}' s='{style}'>" + (f"<is><t>{value}</t></is>" if kind == "inlineStr" else f"<v>{value}</v>" if value is not None else "") + "</c></row>"
        for i, (kind, style, value) in enumerate(cells)
    )
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as book:
        book.writestr("xl/workbook.xml", f"<workbook {MAIN}><workbookPr date1904='{int(date1904)}'/><sheets><sheet name='x' sheetId='1' r:id='r1'/></sheets></workbook>")
        book.writestr("xl/_rels/workbook.xml.rels", "<Relationships xmlns='http://schemas.openxmlformats.org/package/2006/relationships'><Relationship Id='r1' Target='worksheets/sheet1.xml'/></Relationships>")
        book.writestr("xl/styles.xml", f"<styleSheet {MAIN}><numFmts>{styles}</numFmts><cellStyleXfs><xf numFmtId='14'/></cellStyleXfs><cellXfs>{used}</cellXfs></styleSheet>")
        book.writestr("xl/sharedStrings.xml", f"<sst {MAIN}><si><r><t>two </t></r><r><t>runs</t></r></si></sst>")
        book.writestr("xl/worksheets/sheet1.xml", f"<worksheet {MAIN}><sheetData>{rows}</sheetData></worksheet>")
    return out.getvalue()


CASES = [
    (("n", "General", 42), "42"),
    (("n", "General", 42.5), "42.5"),
    (("n", "General", "1E3"), "1000.0"),
    (("b", "General", 1), "True"),
    (("b", "General", 0), "False"),
    (("s", "General", 0), "two runs"),
    (("str", "General", "of a formula"), "of a formula"),
    (("e", "General", "#N/A"), "#N/A"),
    (("inlineStr", "General", "inline"), "inline"),
    (("d", "General", "2024-05-06T07:08:09"), "2024-05-06 07:08:09"),
    (("n", "14", 45000), "2023-03-15 00:00:00"),
    (("n", "yyyy-mm-dd hh:mm", 45000.5), "2023-03-15 12:00:00"),
    (("n", "14", 1), "1900-01-01 00:00:00"),
    (("n", "14", 61), "1900-03-01 00:00:00"),
    (("n", "20", 0.75), "18:00:00"),
    (("n", "[h]:mm:ss", 1.5), "1 day, 12:00:00"),
    (("n", "46", 0.25), "6:00:00"),
    (("n", "0.00", 7), "7"),
    (("n", '"days" 0', 7), "7"),
    (("n", "[Red]0;d", 7), "7"),
    (("n", "m/d/yy;@", 2), "1900-01-02 00:00:00"),
    (("n", "[$-409]mmm d", 45000), "2023-03-15 00:00:00"),
    (("n", "General", None), None),
]


def test_every_kind_of_cell():
    rows = {cn: en for _, cn, en in tables._rows_of_xlsx(workbook([(k, FORMATS.index(f), v) for (k, f, v), _ in CASES]))}
    assert rows == {f"词{i}": want for i, (_, want) in enumerate(CASES) if want is not None}


def test_the_other_calendar():
    (row,) = tables._rows_of_xlsx(workbook([("n", FORMATS.index("14"), 0)], date1904=True))[:1]
    assert row[2] == "00:00:00"
    assert tables._rows_of_xlsx(workbook([("n", FORMATS.index("14"), 1)], date1904=True))[0][2] == "1904-01-02 00:00:00"


@pytest.mark.parametrize(("code", "kind"), [("General", None), ("0.0", None), ("yyyy", "date"), ("mm:ss", "date"), ("[mm]:ss", "span"), ("\\d0", None), ("#,##0_d", None), ("[Blue]#", None), ("@", None)])
def test_format_kinds(code, kind):
    assert tables.format_kind(code) == kind
