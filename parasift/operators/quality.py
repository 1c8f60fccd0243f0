"""Findings rolled up into file and job reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parasift.functions import textnorm as tn

# Categories in the order of their tests, with the marks that tell them.
CATEGORIES = {
    "数字保真": ["金额/数量缺失", "数字缺失"],
    "术语": ["术语缺失", "术语补全"],
    "中文残留": ["残留", "Para ", "Table ", "TextBox"],
    "重复": ["重复检测"],
    "编号": ["编号"],
}
OTHER = "其他"
FIXES = {"数字保真": "fidelity", "术语": "term", "中文残留": "chinese", "重复": "duplicate", "编号": "numbering"}
PREVIEW, SHOWN = 60, 110


def category(warning: Column) -> Column:
    out = None
    for name, marks in CATEGORIES.items():
        hit = F.lit(False)
        for mark in marks:
            hit = hit | warning.contains(mark)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(OTHER)


def fix_type(of: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in FIXES.items() for x in pair))
    return F.try_element_at(table, of)


def file_severity(count: Column) -> Column:
    return F.when(count > 5, "critical").when(count > 2, "moderate").otherwise("minor")


def job_severity(count: Column) -> Column:
    return F.when(count > 10, "critical").when(count > 4, "moderate").when(count > 0, "minor").otherwise("clean")


def location(region: Column, pos: Column, tbl: Column, row: Column, col: Column, box: Column) -> Column:
    """``Para i``, ``Table tRrCc`` or ``TextBox bPp``, counted from one."""
    return (
        F.when(region == "body", F.format_string("Para %d", pos + 1))
        .when(region == "cell", F.format_string("Table %dR%dC%d", tbl + 1, row + 1, col + 1))
        .otherwise(F.format_string("TextBox %dP%d", box + 1, pos + 1))
    )


def residue_warnings(segments: DataFrame, text: str = "text", placed: bool = False) -> DataFrame:
    """A warning for each segment, or whole table cell, with Chinese characters left; ``placed`` ones have the columns of
    ``PLACE``, a cell's that of its first paragraph."""
    body = segments.where("region <> 'cell'")
    cell = segments.where("region = 'cell'").groupBy("file_id", "region", "tbl", "row", "col").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", text))), lambda s: s[text]), "\n").alias(text), F.min("pos").alias("pos")
    )
    every = body.select("file_id", "region", "pos", "tbl", "row", "col", "box", text).unionByName(cell.withColumn("box", F.lit(None).cast("int")).select("file_id", "region", "pos", "tbl", "row", "col", "box", text))
    left = every.where(F.col(text).rlike(tn.CJK))
    bare = F.regexp_replace(text, F.lit(r"(?U)^\s+|\s+$"), F.lit(""))
    where = location(*(F.col(c) for c in ("region", "pos", "tbl", "row", "col", "box")))
    return left.select(*(PLACE if placed else ["file_id"]), F.concat(where, F.lit(": "), F.substring(bare, 1, PREVIEW)).alias("warning"))


def split_warning(warning: Column) -> Column:
    """Struct of ``loc`` and ``preview``."""
    rest = F.substr(warning, F.position(F.lit(": "), warning) + 2)
    return F.struct(F.substring_index(warning, ": ", 1).alias("loc"), F.substring(F.when(warning.contains(": "), rest).otherwise(""), 1, SHOWN).alias("preview"))


def file_summary(warnings: DataFrame, paragraphs: DataFrame | None = None) -> DataFrame:
    """(file_id, warning_count, severity, categories) of ``warnings`` (file_id, warning); with
    ``paragraphs`` (file_id, paragraphs) also files without any. Two small aggregations."""
    counts = warnings.groupBy("file_id", category(F.col("warning")).alias("category")).agg(F.count("*").cast("int").alias("n"))
    entries = F.array_sort(F.collect_list(F.struct("category", "n")))
    out = counts.groupBy("file_id").agg(F.sum("n").cast("int").alias("warning_count"), F.map_from_entries(entries).alias("categories"))
    if paragraphs is not None:
        out = paragraphs.join(out, "file_id", "left").withColumn("warning_count", F.coalesce("warning_count", F.lit(0)))
    return out.withColumn("severity", F.when(F.col("warning_count") > 0, file_severity(F.col("warning_count"))))


def job_summary(results: DataFrame) -> DataFrame:
    """Totals of each job over ``results`` (job_id, status, warning_count)."""
    done = F.col("status") == "completed"
    return results.groupBy("job_id").agg(
        F.sum("warning_count").alias("warnings"),
        F.count_if(done & (F.col("warning_count") == 0)).alias("clean_files"),
        F.count_if(done).alias("done"),
        F.count_if(F.col("status") == "failed").alias("failed_count"),
    ).withColumn("severity", job_severity(F.col("warnings")))


PLACE = ["file_id", "region", "tbl", "row", "col", "box", "pos"]


def contexts(warnings: DataFrame, segments: DataFrame, place: list[str] | None = None) -> DataFrame:
    """Source and target snippets of each warning's segment; both have the columns of its place, null where
    a region has none."""
    place = place or PLACE
    shown = segments.select(*(F.col(c).alias(f"__{c}") for c in place), tn.snippet(F.col("cn_text")).alias("cn"), tn.snippet(F.col("en_text")).alias("en"))
    same = [warnings[c].eqNullSafe(F.col(f"__{c}")) for c in place]
    return warnings.join(shown, same, "left").drop(*(f"__{c}" for c in place))


def aligned(source: DataFrame, target: DataFrame, place: list[str] | None = None) -> DataFrame:
    """Segments of a source document with those of its translation by place: ``text`` and
    ``translated_text``. Inner: what only one side has is left out, as when lists are zipped."""
    place = place or PLACE
    other = target.select(*(F.col(c).alias(f"__{c}") for c in place), F.col("text").alias("translated_text"))
    same = [source[c].eqNullSafe(F.col(f"__{c}")) for c in place]
    return source.join(other, same).drop(*(f"__{c}" for c in place))
