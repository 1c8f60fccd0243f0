"""Word documents as tables of paragraphs and runs, and back, with the standard library's ZIP and XML.

Reading is one row per paragraph: body paragraphs, those of table cells, those of text boxes. Writing
takes new texts and formats by that key and returns a status row a file, so one broken file stops no
other.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from typing import BinaryIO
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parasift.functions import textnorm as tn

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_XML = "http://www.w3.org/XML/1998/namespace"
_XML_SPACE = f"{{{_XML}}}space"
_P, _R, _T, _P_FORM, _R_FORM, _FONTS, _SHADE = (_W + name for name in "p r t pPr rPr rFonts shd".split())
_VAL, _SIZE, _COLOR, _MARK = (_W + name for name in "val sz color highlight".split())
_FLAGS, _BOXED = {_W + "b": "bold", _W + "i": "italic", _W + "u": "underline"}, (_W + "b", _W + "i")
_BREAKS = {_W + "br": "\n", _W + "cr": "\n", _W + "tab": "\t"}
FONT = "Times New Roman"
RUN = "struct<text:string,bold:boolean,italic:boolean,underline:boolean,font_name:string,font_size:double,highlight:int,color:string>"
SEGMENTS = f"file_id string, region string, pos int, tbl int, row int, col int, box int, text string, alignment int, runs array<{RUN}>, error string"
# Numbers of alignments and highlights in the object model of Word.
ALIGNMENTS = {"left": 0, "start": 0, "center": 1, "right": 2, "end": 2, "both": 3, "distribute": 4}
HIGHLIGHTS = "black blue turquoise brightGreen pink red yellow white darkBlue teal green violet darkRed darkYellow gray50 gray25".split()
HIGHLIGHT_NAMES = {"cyan": "turquoise", "magenta": "pink", "darkCyan": "teal", "darkGreen": "green", "darkMagenta": "violet", "darkGray": "gray50", "lightGray": "gray25", "green": "brightGreen"}
FONT_SLOTS = ["ascii", "hAnsi", "eastAsia", "cs"]
THEME_FONTS = ["asciiTheme", "hAnsiTheme", "eastAsiaTheme", "cstheme"]
_SLOTS, _THEME_SLOTS = [_W + s for s in FONT_SLOTS], {_W + s for s in THEME_FONTS}
FORMATS = "struct<bold:boolean,italic:boolean,font_name:string,color:string>"
PROPERTIES_BEFORE_SPACING = ["pStyle", "keepNext", "keepLines", "pageBreakBefore", "framePr", "widowControl", "numPr", "suppressLineNumbers", "pBdr", "shd", "tabs", "suppressAutoHyphens", "kinsoku", "wordWrap", "overflowPunct", "topLinePunct", "autoSpaceDE", "autoSpaceDN", "bidi", "adjustRightInd", "snapToGrid"]
FORMAT_KEYWORDS = [
    (["单倍行距", "single spacing", "一倍行距"], "line_spacing", "single"),
    (["双倍行距", "double spacing", "两倍行距"], "line_spacing", "double"),
    (["1.5倍行距", "1.5 spacing", "一点五倍行距"], "line_spacing", "1.5"),
    (["红色", "red"], "font_color", "FF0000"),
    (["蓝色", "blue"], "font_color", "0000FF"),
    (["绿色", "green"], "font_color", "00FF00"),
    (["黑色", "black"], "font_color", "000000"),
    (["Times New Roman", "TNR"], "font_name", "Times New Roman"),
    (["宋体"], "font_name", "宋体"),
    (["黑体"], "font_name", "黑体"),
    (["加粗", "bold"], "bold", "true"),
    (["斜体", "italic"], "italic", "true"),
    (["去除底纹", "remove shading", "clear shading", "清除底纹"], "clear_shading", "true"),
]
LINE_UNITS = {"single": 240, "1.5": 360, "double": 480}


def _val(node: ET.Element | None, name: str = "val") -> str | None:
    return None if node is None else node.get(_W + name)


class _Tree(ET.TreeBuilder):
    """Builds a tree and keeps the prefixes that its text gives to namespaces."""

    def __init__(self) -> None:
        super().__init__()
        self.prefixes: dict[str, str] = {}

    def start_ns(self, prefix: str, uri: str) -> None:
        if prefix:  # attributes cannot do without one
            self.prefixes[uri] = prefix


def _parsed(data: bytes) -> tuple[ET.Element, dict[str, str]]:
    tree = _Tree()
    return ET.fromstring(data, ET.XMLParser(target=tree)), tree.prefixes


def _escaped(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace("\r", "&#13;")


def _quoted(value: str) -> str:
    inner = _escaped(value).replace('"', "&quot;").replace("\n", "&#10;").replace("\t", "&#9;")
    return f'"{inner}"'


def _xml(root: ET.Element, prefixes: dict[str, str]) -> bytes:
    """The text of a tree, with ``prefixes`` where they are free. The library's own writer looks at every element twice and
    keeps prefixes for all documents together; here each start of an element is made once a document."""
    spaces, names, given, starts, ends, out = {_XML: "xml"}, {}, {}, {}, {}, []

    def name(tag: str) -> str:
        if tag not in names:
            uri, _, local = tag[1:].rpartition("}") if tag[0] == "{" else ("", "", tag)
            if uri and uri not in spaces:
                prefix = prefixes.get(uri)
                spaces[uri] = f"ns{len(spaces)}" if prefix is None or prefix in spaces.values() or re.fullmatch(r"ns\d+", prefix) else prefix
            names[tag] = f"{spaces[uri]}:{local}" if uri else local
        return names[tag]

    def start(key: str | tuple, node: ET.Element) -> str:
        told = f"<{name(node.tag)}"
        ends[node.tag] = f"</{name(node.tag)}>"
        for pair in node.items():
            if pair not in given:
                given[pair] = f" {name(pair[0])}={_quoted(pair[1])}"
            told += given[pair]
        starts[key] = told
        return told

    def put(nodes: Iterable[ET.Element]) -> None:
        for node in nodes:
            tag, pairs, text, tail = node.tag, node.items(), node.text, node.tail
            key = (tag, *pairs) if pairs else tag
            opened = starts.get(key) or start(key, node)
            if len(node):
                add(f"{opened}>{_escaped(text)}" if text else f"{opened}>")
                put(node)
                add(ends[tag])
            else:
                add(f"{opened}>{_escaped(text)}{ends[tag]}" if text else f"{opened}/>")
            if tail:
                add(_escaped(tail))

    add = out.append
    put(root)
    opened = start("", root)
    declared = "".join(f" xmlns:{prefix}={_quoted(uri)}" for uri, prefix in spaces.items() if uri != _XML)
    return f"<?xml version='1.0' encoding='UTF-8'?>\n{opened}{declared}>{_escaped(root.text or '')}{''.join(out)}{ends[root.tag]}".encode()


def _run_text(run: ET.Element) -> str:
    out = ""
    for node in run:
        tag = node.tag
        if tag == _T:
            out += node.text or ""
        elif tag in _BREAKS:
            out += _BREAKS[tag]
    return out


def _run_row(run: ET.Element, boxed: bool) -> dict:
    """Of text boxes the first text and bold and italic alone are read."""
    text = run.findtext(_T, "") if boxed else _run_text(run)
    row = {"text": text, "bold": False, "italic": False, "underline": False, "font_name": None, "font_size": None, "highlight": None, "color": None}
    p = run.find(_R_FORM)
    if p is None:
        return row
    for node in reversed(p):  # of several alike the first counts
        tag, value = node.tag, node.get(_VAL)
        if boxed and tag not in _BOXED:
            continue
        if tag in _FLAGS:
            row[_FLAGS[tag]] = value not in ("0", "false", "none")
        elif tag == _FONTS:
            row["font_name"] = node.get(_SLOTS[0])
        elif tag == _SIZE:
            row["font_size"] = int(value) / 2 if value else None
        elif tag == _COLOR:
            row["color"] = value.upper() if value and value != "auto" else None
        elif tag == _MARK:
            value = HIGHLIGHT_NAMES.get(value, value)
            row["highlight"] = HIGHLIGHTS.index(value) + 1 if value in HIGHLIGHTS else None
    return row


Place = tuple[str, int, int | None, int | None, int | None, int | None]


def _boxes(root: ET.Element) -> list[ET.Element]:
    """Text boxes; the fallback copy that Word keeps beside a drawing counts as the same box."""
    found = list(root.iter(_W + "txbxContent"))
    if not found:  # nearly all documents; a look at every element costs more than all else here
        return []
    hidden = {id(x) for f in root.iter() if f.tag.endswith("}Fallback") for x in f.iter()}
    return [b for b in found if id(b) not in hidden]


def paragraphs(root: ET.Element) -> Iterator[tuple[Place, ET.Element]]:
    """All paragraphs with their place: (region, pos, tbl, row, col, box)."""
    body = root.find(_W + "body")
    for pos, p in enumerate(body.findall(_P)):
        yield ("body", pos, None, None, None, None), p
    for t, table in enumerate(body.findall(_W + "tbl")):
        for r, row in enumerate(table.findall(_W + "tr")):
            for c, cell in enumerate(row.findall(_W + "tc")):
                for pos, p in enumerate(cell.findall(_W + "p")):
                    yield ("cell", pos, t, r, c, None), p
    for b, box in enumerate(_boxes(root)):
        for pos, p in enumerate(box.findall(_W + "p")):
            yield ("textbox", pos, None, None, None, b), p


def segments_of(raw: bytes) -> list[dict]:
    with zipfile.ZipFile(io.BytesIO(raw)) as package:
        root = ET.fromstring(package.read("word/document.xml"))
    rows = []
    for (region, pos, tbl, row, col, box), p in paragraphs(root):
        runs = [_run_row(r, region == "textbox") for r in p.findall(_R)]
        text = "".join([r["text"] for r in runs])
        if region != "body" and not text.strip():
            continue
        form = p.find(_P_FORM)
        jc = None if form is None else form.find(_W + "jc")
        rows.append({"region": region, "pos": pos, "tbl": tbl, "row": row, "col": col, "box": box, "text": text, "alignment": ALIGNMENTS.get(_val(jc) or ""), "runs": runs})
    return rows


def parse_files(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``SEGMENTS`` of files (path, content); a file that cannot be read is one row with its ``error``."""
    names = [f.strip().split(" ", 1)[0] for f in SEGMENTS.split(", ")]
    for frame in frames:
        for file_id, raw in zip(frame["path"], frame["content"]):
            try:
                rows = [{"file_id": file_id} | s for s in segments_of(raw)]
            except Exception as error:  # one file's failure is that file's row
                rows = [{"file_id": file_id, "error": f"{type(error).__name__}: {error}"}]
            columns = {n: [r.get(n) for r in rows] for n in names}
            whole = {c: pd.array(columns[c], "Int32") for c in ("pos", "tbl", "row", "col", "box", "alignment")}
            yield pd.DataFrame({n: whole[n] if n in whole else pd.Series(columns[n], dtype=object) for n in names})


def list_docx(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, name) of all ``.docx`` files below ``path``: their paths, and their names without the ending. No content
    is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path).select(F.col("path").alias("file_id"))
    return files.withColumn("name", F.regexp_replace(F.element_at(F.split("file_id", "/"), -1), F.lit(r"\.docx$"), F.lit("")))


def read_docx(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``SEGMENTS`` of all ``.docx`` files below ``path``, or of the files that it lists; ``file_id`` is the file's path. ``error`` is null but
    for the one row of a file that cannot be read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path)
    return files.select("path", "content").mapInPandas(parse_files, SEGMENTS)


def new_document(segments: list[dict]) -> bytes:
    """A package with body paragraphs and tables of one cell a row from (region, tbl, row, text, runs), in order;
    ``runs`` are (text, bold, italic, color) or, if absent, the text is one run."""

    def paragraph(s: dict) -> str:
        out = ["<w:p>"]
        for text, bold, italic, color in s.get("runs") or [(s["text"], False, False, None)]:
            lines = "<w:br/>".join([line and f"<w:t{'' if line == line.strip() else preserved}>{_escaped(line)}</w:t>" for line in text.split("\n")])
            form = ("<w:b/>" if bold else "") + ("<w:i/>" if italic else "") + (f"<w:color w:val={_quoted(color)}/>" if color else "")
            out.append(f"<w:r><w:rPr>{form}</w:rPr>{lines}</w:r>" if form else f"<w:r>{lines}</w:r>")
        return "".join(out) + "</w:p>"

    preserved = ' xml:space="preserve"'
    body: list[list[str]] = []
    tables: dict = {}
    for s in segments:
        if s["region"] == "body":
            body.append([paragraph(s)])
        else:
            if s["tbl"] not in tables:
                tables[s["tbl"]] = ["<w:tbl>"]
                body.append(tables[s["tbl"]])
            tables[s["tbl"]].append(f"<w:tr><w:tc>{paragraph(s)}</w:tc></w:tr>")
    for table in tables.values():
        table.append("</w:tbl>")
    text = "".join("".join(part) for part in body)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as package:
        package.writestr("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?>\n<w:document xmlns:w="{_W[1:-1]}"><w:body>{text}</w:body></w:document>'.encode())
    return out.getvalue()


# Formats of a paragraph as expressions over its runs.


def carrier(runs: Column) -> Column:
    """Index of the first run that is not blank: the one that takes a new text; null if none."""
    at = F.filter(F.transform(runs, lambda r, i: F.when(F.trim(r["text"]) != "", i)), lambda i: i.isNotNull())
    return F.get(at, F.lit(0))


def full_text_runs(runs: Column, text: Column) -> Column:
    """Run texts with ``text`` in the first run that is not blank; other such runs empty, blank ones kept."""
    return tn.let(carrier(runs), lambda first: F.transform(runs, lambda r, i: F.when(i == first, text).when(F.trim(r["text"]) != "", "").otherwise(r["text"])))


def union_format(runs: Column, asked: Column | None = None) -> Column:
    """One format for the text of all runs: any bold, italic, underline; the first highlight and color. What
    ``asked`` (a struct of ``FORMATS``, null where nothing is) names goes before."""
    asked = F.lit(None).cast(FORMATS) if asked is None else asked
    of = lambda name: F.exists(runs, lambda r: r[name])
    first = lambda name: F.get(F.filter(F.transform(runs, lambda r: r[name]), lambda v: v.isNotNull()), F.lit(0))
    flags = [(n, F.coalesce(of(n), F.lit(False))) for n in ("bold", "italic", "underline")]
    flags = [F.coalesce(asked[n], f).alias(n) if n in ("bold", "italic") else f.alias(n) for n, f in flags]
    name, color = F.coalesce(asked["font_name"], F.lit(FONT)), F.coalesce(asked["color"], first("color"))
    return F.struct(*flags, name.alias("font_name"), F.lit(12.0).alias("font_size"), first("highlight").alias("highlight"), color.alias("color"))


ACTIONS = "file_id string, ord int, action string, value string, indices array<int>"
#: What each action sets of a segment, and its field in a run's format.
FIELDS = {"bold": "bold", "italic": "italic", "font_name": "font_name", "font_color": "color", "line_spacing": None, "clear_shading": None}


def listed(segments: DataFrame, order: Column, name: str = "number") -> DataFrame:
    """``segments`` with ``name``: their place in their file's listing, from zero, by ``order``."""
    return segments.withColumn(name, F.row_number().over(Window.partitionBy("file_id").orderBy(order)) - 1)


def apply_actions(segments: DataFrame, actions: DataFrame, order: Column | str = "pos") -> DataFrame:
    """Run formats after ``actions`` (``ACTIONS``): each goes to the segments of its file, or without one of every file,
    whose number in their file's listing (by ``order``: body, cells, boxes) is among its ``indices``, or to all if there
    are none. Of actions of one kind on a segment the one of the highest ``ord`` counts; other actions change nothing.

    What was asked of a segment is also in its column ``asked`` (``FORMATS``), line spacing and shading in
    ``line_spacing`` and ``clear_shading``. Actions stay a table: they meet the segments in joins on file and number, and
    those without either are one row.
    """
    known = actions.where(F.col("action").isin(list(FIELDS)))
    each = known.select("file_id", F.explode_outer(F.when(F.size("indices") > 0, F.col("indices"))).alias("__number"), "action", F.struct("ord", "value").alias("told"))
    chosen = lambda df, keys: df.groupBy(*keys).agg(*(F.max(F.when(F.col("action") == a, F.col("told"))).alias(a) for a in FIELDS))
    columns = [c for c in segments.columns if c not in ("line_spacing", "clear_shading", "asked")]
    out = listed(segments.select(columns), F.col(order) if isinstance(order, str) else order, "__number")
    found: dict[str, list[Column]] = {a: [] for a in FIELDS}
    for n, (file, number) in enumerate([(True, True), (True, False), (False, True), (False, False)]):
        keys = ["file_id"] * file + ["__number"] * number
        own = each.where((F.col("file_id").isNotNull() if file else F.col("file_id").isNull()) & (F.col("__number").isNotNull() if number else F.col("__number").isNull()))
        own = chosen(own, keys).select(*(F.col(k).alias(f"{k}__") for k in keys), *(F.col(a).alias(f"__{a}_{n}") for a in FIELDS))
        same = [out[k] == own[f"{k}__"] for k in keys]
        out = out.join(own, same, "left").drop(*(f"{k}__" for k in keys)) if keys else out.join(F.broadcast(own), F.lit(True), "left")
        for a in FIELDS:
            found[a].append(F.col(f"__{a}_{n}"))
    # The one asked last; nulls stand for what nobody asked.
    last = {a: F.greatest(*some)["value"] for a, some in found.items()}
    value = {a: F.lower(last[a]) == "true" if a in ("bold", "italic") else last[a] for a in FIELDS}
    out = out.withColumn("asked", F.struct(*(value[a].alias(field) for a, field in FIELDS.items() if field)))
    given = {"line_spacing": value["line_spacing"], "clear_shading": last["clear_shading"].isNotNull()}
    if "runs" in columns:
        set_all = lambda r: reduce(lambda run, f: run.withField(f, F.coalesce(F.col("asked")[f], r[f])), ["bold", "italic", "font_name", "color"], r)
        given["runs"] = F.transform("runs", set_all)
    return out.withColumns(given).select(*columns, "line_spacing", "clear_shading", "asked")


def describe_actions(actions: DataFrame) -> DataFrame:
    """``action → value (paragraphs [...])`` of each action."""
    where = F.when(F.size("indices") > 0, F.concat(F.lit("(paragraphs ["), F.array_join("indices", ", "), F.lit("])"))).otherwise("(all paragraphs)")
    return actions.withColumn("description", F.concat_ws(" ", F.concat("action", F.lit(" → "), "value"), where))


def applied(segments: DataFrame, actions: DataFrame) -> DataFrame:
    """(file_id, applied): the descriptions of what was asked of each file, in the order of ``actions``."""
    told = describe_actions(actions).select(F.col("file_id").alias("__file"), F.struct("ord", "description").alias("told"))
    files = segments.select("file_id").distinct()
    shared = told.where("__file is null").agg(F.collect_list("told").alias("__every"))
    own = told.where("__file is not null").groupBy("__file").agg(F.collect_list("told").alias("__own"))
    both = files.join(own, F.col("file_id") == F.col("__file"), "left").join(F.broadcast(shared), F.lit(True), "left")
    every = F.array_sort(F.concat(F.coalesce("__own", F.array().cast("array<struct<ord:int,description:string>>")), "__every"))
    return both.select("file_id", F.transform(every, lambda t: t["description"]).alias("applied"))


def keyword_actions(feedback: Column) -> Column:
    """Actions that plain words in a feedback ask for, in the order of the rules."""
    rule = lambda words, action, value: F.when(F.greatest(*(feedback.contains(w) for w in words), F.lit(False)), F.struct(F.lit(action).alias("action"), F.lit(value).alias("value")))
    return F.filter(F.array(*(rule(*r) for r in FORMAT_KEYWORDS)), lambda a: a.isNotNull())


# Writing.


def _child(parent: ET.Element, name: str, at: int | None = None) -> ET.Element:
    node = parent.find(_W + name)
    if node is None:
        node = ET.Element(_W + name)
        parent.insert(len(parent) if at is None else at, node)
    return node


def _set_text(run: ET.Element, text: str) -> None:
    for node in [n for n in run if n.tag == _T or n.tag in _BREAKS]:  # drawings and boxes stay
        run.remove(node)
    for i, line in enumerate(text.split("\n") if text else ()):
        if i:
            ET.SubElement(run, _W + "br")
        node = ET.SubElement(run, _T, {_XML_SPACE: "preserve"} if line != line.strip() else {})
        node.text = line


def _set_fonts(properties: ET.Element) -> None:
    fonts = _child(properties, "rFonts", 0)
    fonts.attrib.update(dict.fromkeys(_SLOTS, FONT))
    _drop_theme(fonts)


def _drop_theme(fonts: ET.Element) -> None:
    """A theme's font goes before a named one, so it must not be there."""
    for name in _THEME_SLOTS.intersection(fonts.attrib):
        del fonts.attrib[name]


def _fill_fonts(properties: ET.Element) -> None:
    """The font in the slots that name none, where fonts are named at all."""
    fonts = properties.find(_FONTS)
    if fonts is not None:
        _drop_theme(fonts)
        for slot in _SLOTS:
            fonts.attrib.setdefault(slot, FONT)


_SET_FORMATS = {_W + name for name in "rFonts b i color sz szCs highlight u".split()}


def _set_format(run: ET.Element, form: dict, boxed: bool) -> None:
    p = _child(run, "rPr", 0)
    for node in [n for n in p if n.tag in _SET_FORMATS]:
        p.remove(node)
    p.insert(0, ET.Element(_FONTS, dict.fromkeys(_SLOTS, form.get("font_name") or FONT)))
    for flag, name in (("bold", "b"), ("italic", "i")):
        if form.get(flag):
            ET.SubElement(p, _W + name)
    if not boxed and form.get("color"):
        ET.SubElement(p, _W + "color", {_W + "val": form["color"]})
    ET.SubElement(p, _W + "sz", {_W + "val": str(int(2 * (form.get("font_size") or 12)))})
    if not boxed and form.get("highlight"):
        back = {v: k for k, v in HIGHLIGHT_NAMES.items()}
        name = HIGHLIGHTS[int(form["highlight"]) - 1]
        ET.SubElement(p, _W + "highlight", {_W + "val": back.get(name, name)})
    if not boxed and form.get("underline"):
        ET.SubElement(p, _W + "u", {_W + "val": "single"})


def _set_spacing(paragraph: ET.Element, line: str) -> None:
    p = _child(paragraph, "pPr", 0)
    before = sum(node.tag.removeprefix(_W) in PROPERTIES_BEFORE_SPACING for node in p) if len(p) else 0
    spacing = _child(p, "spacing", before)
    spacing.set(_W + "line", str(LINE_UNITS[line]))
    spacing.set(_W + "lineRule", "auto")
    if line == "single":
        spacing.set(_W + "before", "0")
        spacing.set(_W + "after", "0")


def clear_shading(root: ET.Element) -> None:
    """No shading of paragraphs and runs; that of table cells stays."""
    for kind in (_P_FORM, _R_FORM):
        for properties in root.iter(kind):
            for node in properties.findall(_SHADE):
                properties.remove(node)


def _fix_styles(root: ET.Element) -> None:
    """The document's defaults and the Normal style name the font; other styles keep what they name."""
    for properties in root.findall(f"{_W}docDefaults/{_W}rPrDefault/{_W}rPr"):
        _set_fonts(properties)
    for style in root.findall(_W + "style"):
        if _val(style, "styleId") == "Normal":
            _set_fonts(_child(style, "rPr"))
        else:
            for properties in style.findall(_W + "rPr"):
                _fill_fonts(properties)


def _fix_theme(root: ET.Element) -> None:
    for font in root.iter(_A + "font"):
        if font.get("script") == "Hans":
            font.set("typeface", FONT)


def rewrite(raw: bytes, edits: list[dict], spacing: str | None = "double") -> bytes:
    """The document with new texts: each edit has a place, ``new_text``, a ``format`` (or null) and
    optionally ``line_spacing``. Shading is cleared and fonts are made one."""
    number = lambda n: n if type(n) is int else None if pd.isna(n) else int(n)
    by_place = {(e["region"], *[number(e[k]) for k in ("pos", "tbl", "row", "col", "box")]): e for e in edits}
    with zipfile.ZipFile(io.BytesIO(raw)) as package:
        files = {name: package.read(name) for name in package.namelist()}
    root, prefixes = _parsed(files["word/document.xml"])
    for place, p in list(paragraphs(root)):
        edit = by_place.get(place)
        if edit is None:
            continue
        boxed = place[0] == "textbox"
        runs = p.findall(_R)
        filled = [r for r in runs if _run_text(r).strip()]
        if not edit["new_text"].strip() and not filled:
            continue
        first = next(iter(filled or runs), None)
        if first is None:
            first = ET.SubElement(p, _R)
        for r in runs if boxed else filled:
            if r is not first:
                p.remove(r) if boxed else _set_text(r, "")
        _set_text(first, edit["new_text"])
        if edit.get("format") is not None:
            form = edit["format"]
            _set_format(first, form if isinstance(form, dict) else form.asDict(), boxed)
        line = edit.get("line_spacing") or spacing
        if line:
            _set_spacing(p, line)
    clear_shading(root)
    for properties in root.iter(_R_FORM):
        _fill_fonts(properties)
    root.attrib.pop("{http://schemas.openxmlformats.org/markup-compatibility/2006}Ignorable", None)  # names prefixes that may go unused
    files["word/document.xml"] = _xml(root, prefixes)
    for name, fix in (("word/styles.xml", _fix_styles), ("word/theme/theme1.xml", _fix_theme)):
        if name in files:
            part, own = _parsed(files[name])
            fix(part)
            files[name] = _xml(part, own)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as package:
        for name, data in files.items():
            package.writestr(name, data)
    return out.getvalue()


def write_docx(spark: SparkSession, path: str, edits: DataFrame, store: Callable[[str, bytes], str]) -> DataFrame:
    """(file_id, status, output, error): each file of ``path`` with the ``edits`` of its ``file_id``
    handed to ``store`` (which returns where it went). Files meet their edits in one cogroup by file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path).select(F.col("path").alias("file_id"), "content")

    def write(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        try:
            output = store(key[0], rewrite(left["content"].iloc[0], right.to_dict("records")))
            row = (key[0], "completed", output, None)
        except Exception as error:  # one file's failure is that file's status
            row = (key[0], "failed", None, str(error))
        return pd.DataFrame([row], columns=["file_id", "status", "output", "error"])

    return files.groupBy("file_id").cogroup(edits.groupBy("file_id")).applyInPandas(write, "file_id string, status string, output string, error string")


def bundle(files: Iterable[tuple[str, bytes]], target: BinaryIO) -> None:
    """A ZIP of finished documents as ``<name>-EN.docx``, written to ``target`` one after another."""
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as package:
        for name, data in files:
            package.writestr(f"{name}-EN.docx", data)
