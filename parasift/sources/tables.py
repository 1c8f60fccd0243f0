"""Glossary and job tables: readers by format, Parquet in and out."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parasift.operators.glossary import clean_terms

_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
RAW = "file string, pos long, cn string, en string, error string"
JOB = T.StructType(
    [
        T.StructField("job_id", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("file_ids", T.ArrayType(T.StringType())),
        T.StructField("glossary_id", T.StringType()),
        T.StructField("failed_count", T.IntegerType()),
        T.StructField("error", T.StringType()),
    ]
)


def _rows_of_csv(raw: bytes) -> list[tuple]:
    import csv

    rows = csv.reader(io.StringIO(raw.decode("utf-8-sig"), newline=""))
    return [(i, r[0], r[1]) for i, r in enumerate(rows) if len(r) >= 2]


# The built-in number formats of workbooks that show dates and times, and the one that shows a span.
DATE_FORMATS, SPAN_FORMATS = {*range(14, 23), 45, 47}, {46}
_QUIET = re.compile(r'"[^"]*"|\\.|_.|\*.|\[(?!(?:h+|m+|s+)\])[^\]]*\]', re.IGNORECASE)
_SPAN = re.compile(r"\[(?:h+|m+|s+)\]", re.IGNORECASE)


def format_kind(code: str) -> str | None:
    """``date`` or ``span`` for a number format that shows one: a letter of d, m, y, h, s outside of quotes, escapes and
    brackets in its first section."""
    bare = _QUIET.sub("", code.split(";")[0])
    return "span" if _SPAN.search(bare) else "date" if re.search("[dmyhs]", bare, re.IGNORECASE) else None


def _format_kinds(styles: ElementTree.Element | None) -> list[str | None]:
    """What each cell style shows."""
    if styles is None:
        return []
    own = {int(f.get("numFmtId")): format_kind(f.get("formatCode", "")) for f in styles.iter(f"{_S}numFmt")}
    kinds = {**dict.fromkeys(DATE_FORMATS, "date"), **dict.fromkeys(SPAN_FORMATS, "span"), **own}
    used = styles.find(f"{_S}cellXfs")
    return [] if used is None else [kinds.get(int(x.get("numFmtId", 0))) for x in used.iter(f"{_S}xf")]


def _number(raw: str, kind: str | None, epoch: datetime) -> str:
    value = float(raw) if re.search("[.eE]", raw) else int(raw)
    if kind is None:
        return str(value)
    days, part = divmod(value, 1)
    part = timedelta(milliseconds=round(part * 86_400_000))
    if kind == "span":
        return str(timedelta(days=days) + part)
    if 0 <= value < 1 and not part.days:
        return str((datetime.min + part).time())
    # Day 60 of the older calendar is a 29 February that never was.
    return str(epoch + timedelta(days=days + (0 < value < 60 and epoch.year < 1900)) + part)


def _cell(cell: ElementTree.Element, shared: list[str], kinds: list[str | None], epoch: datetime) -> str | None:
    """A cell's value as text: booleans, dates, times, spans and numbers by their type; formulas by what they last gave."""
    kind, value = cell.get("t", "n"), cell.find(f"{_S}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{_S}t"))
    if value is None or value.text is None:
        return None
    if kind == "s":
        return shared[int(value.text)]
    if kind == "b":
        return str(bool(int(value.text)))
    if kind == "d":
        return str(datetime.fromisoformat(value.text))
    if kind == "n":
        style = int(cell.get("s", 0))
        return _number(value.text, kinds[style] if style < len(kinds) else None, epoch)
    return value.text


def _rows_of_xlsx(raw: bytes) -> list[tuple]:
    """First two columns of the active sheet, with the values that were stored."""
    with zipfile.ZipFile(io.BytesIO(raw)) as book:
        names = set(book.namelist())
        read = lambda name: ElementTree.fromstring(book.read(name))
        text = lambda node: "".join(t.text or "" for t in node.iter(f"{_S}t"))
        shared = [text(si) for si in read("xl/sharedStrings.xml").iter(f"{_S}si")] if "xl/sharedStrings.xml" in names else []
        kinds = _format_kinds(read("xl/styles.xml") if "xl/styles.xml" in names else None)
        workbook = read("xl/workbook.xml")
        about, view = workbook.find(f"{_S}workbookPr"), workbook.find(f"{_S}bookViews/{_S}workbookView")
        epoch = datetime(1904, 1, 1) if about is not None and about.get("date1904") in ("1", "true") else datetime(1899, 12, 30)
        active = int(view.get("activeTab", 0)) if view is not None else 0
        wanted = workbook.find(f"{_S}sheets")[active].get(f"{_R}id")
        target = next(r.get("Target") for r in read("xl/_rels/workbook.xml.rels") if r.get("Id") == wanted)
        sheet = read(target.lstrip("/") if target.startswith("/") else f"xl/{target}")
    out = []
    for number, row in enumerate(sheet.iter(f"{_S}row")):
        cells = {re.match("[A-Z]+", c.get("r", "A"))[0]: _cell(c, shared, kinds, epoch) for c in row.iter(f"{_S}c")}
        if cells.get("A") is not None and cells.get("B") is not None:
            out.append((int(row.get("r", number + 1)) - 1, cells["A"], cells["B"]))
    return out


def _parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for path, raw in zip(frame["path"], frame["content"]):
            error = None
            try:
                rows = _rows_of_xlsx(raw) if path.lower().endswith(".xlsx") else _rows_of_csv(raw)
            except Exception as failure:  # one file's failure is that file's row
                rows, error = [(-1, None, None)], f"{type(failure).__name__}: {failure}"
            yield pd.DataFrame([(path, *r, error) for r in rows], columns=["file", "pos", "cn", "en", "error"])


def glossary_rows(spark: SparkSession, path: str) -> DataFrame:
    """``RAW`` rows of ``.csv`` and ``.xlsx`` files below ``path``, one task a file at most; other formats
    raise. A file that cannot be read is one row with its ``error``."""
    files = spark.read.format("binaryFile").load(path)
    odd = files.where(~F.lower("path").rlike(r"\.(csv|xlsx)$")).select("path").take(1)
    if odd:
        raise ValueError(f"not a glossary format: {odd[0]['path']}")
    return files.select("path", "content").mapInPandas(_parse, RAW)


def read_glossaries(spark: SparkSession, path: str) -> DataFrame:
    """(file, cn, en, ord) of the terms in the glossary files below ``path`` that can be read."""
    return clean_terms(glossary_rows(spark, path).where("error is null"), ["file"])


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    """Job records from JSON files; unreadable lines are left out, API keys are no part of the schema."""
    return spark.read.schema(JOB).option("mode", "DROPMALFORMED").json(path)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
