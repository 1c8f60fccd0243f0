"""Report pages: every warning with its number in its file, its source and its translation; and the cards of a job's files.

A page is a row, put together by expressions where its warnings meet, and stored by the task that has it. A file with
many warnings has several pages, so that no row grows without bound and nothing is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parasift.functions import textnorm as tn
from parasift.operators import dedup, numbering, quality
from parasift.staging import file_system

#: Warnings of a file, and files of a job, on one page.
WARNINGS_A_PAGE, FILES_A_PAGE = 500, 200


def repeat_warning(found: Column) -> Column:
    return F.concat(F.when(found["removable"], "重复检测[可自动删除]: 「").otherwise("重复检测[需人工确认]: 「"), found["dup"], F.when(found["removable"], "」置信度: 高").otherwise("」置信度: 中"))


def numbered_warnings(translated: DataFrame) -> DataFrame:
    """(``quality.PLACE``, ``number``, ``warning``, ``category``, ``fix``, ``loc``, ``preview``, ``cn``, ``en``): all warnings of each file,
    numbered from zero in the order of the document; of a segment first its own, then residue, then repeats.
    ``fix`` is what may mend it, null where nothing does; ``cn`` and ``en`` are the start of the segment's source and
    translation."""
    place = quality.PLACE
    own = translated.select(*place, F.lit(0).alias("kind"), F.posexplode("warnings").alias("n", "warning"))
    left = quality.residue_warnings(translated, "translated_text", True).select(*place, F.lit(1).alias("kind"), F.lit(0).alias("n"), "warning")
    twice = translated.select(*place, F.posexplode(dedup.audit(F.col("translated_text"))).alias("n", "d"))
    twice = twice.select(*place, F.lit(2).alias("kind"), "n", repeat_warning(F.col("d")).alias("warning"))
    every = own.unionByName(left).unionByName(twice)
    order = F.struct(numbering.document_order().alias("place"), "kind", "n")
    every = every.withColumn("number", F.row_number().over(Window.partitionBy("file_id").orderBy(order)) - 1)
    told = quality.contexts(every, translated.withColumns({"cn_text": F.col("text"), "en_text": F.col("translated_text")}))
    kind, parts = quality.category(F.col("warning")), quality.split_warning(F.col("warning"))
    return told.select(*place, "number", "warning", kind.alias("category"), quality.fix_type(kind).alias("fix"), parts["loc"].alias("loc"), parts["preview"].alias("preview"), "cn", "en")


def _safe(text: Column) -> Column:
    return tn.html_escape(F.coalesce(text.cast("string"), F.lit("")))


def _joined(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def html_page(title: Column, body: Column) -> Column:
    return _joined("<!DOCTYPE html><html><head><meta charset='utf-8'><title>", _safe(title), "</title></head><body><h1>", _safe(title), "</h1>", body, "</body></html>")


def _item() -> Column:
    c = {n: _safe(F.col(n)) for n in ("number", "fix", "category", "loc", "preview", "cn", "en")}
    return _joined("<li value='", c["number"], "' data-fix='", c["fix"], "'><b>", c["loc"], "</b> <i>", c["category"], "</i> ", c["preview"], "<p>", c["cn"], "</p><p>", c["en"], "</p></li>")


def file_pages(warnings: DataFrame, files: DataFrame, title: str) -> DataFrame:
    """(``file_id``, ``page`` from one, ``pages``, ``html``) of ``numbered_warnings`` for each file of ``files`` (file_id); one
    without warnings has one page that says so."""
    page = (F.col("number") / WARNINGS_A_PAGE).cast("int")
    items = warnings.groupBy("file_id", page.alias("page")).agg(F.array_sort(F.collect_list(F.struct("number", _item().alias("item")))).alias("items"))
    items = items.select("file_id", "page", F.array_join(F.transform("items", lambda i: i["item"]), "").alias("items"))
    counts = warnings.groupBy("file_id").agg(F.count("*").alias("n"))
    own = files.select("file_id").distinct().join(counts, "file_id", "left").join(items, "file_id", "left")
    n = F.coalesce("n", F.lit(0))
    pages = F.greatest(F.ceil(n / WARNINGS_A_PAGE), F.lit(1)).cast("int")
    severity = F.when(n > 0, quality.file_severity(n)).otherwise("clean")
    body = _joined("<section class='", severity, "'><h2>", _safe(F.col("file_id")), "</h2><p>", n.cast("string"), "</p><ol>", F.coalesce("items", F.lit("")), "</ol></section>")
    return own.select("file_id", (F.coalesce("page", F.lit(0)) + 1).alias("page"), pages.alias("pages"), html_page(F.lit(title), body).alias("html"))


def job_pages(results: DataFrame, names: DataFrame, title: str) -> DataFrame:
    """(``job_id``, ``page`` from one, ``pages``, ``html``): the totals of each job, and a card for each of its files (job_id, file_id,
    pos, status, warning_count, severity, categories, error) in the order of ``pos``, ``FILES_A_PAGE`` positions a page. A
    file without a position is on the first page."""
    totals = quality.job_summary(results)
    last = results.groupBy("job_id").agg(F.max(F.coalesce("pos", F.lit(0))).alias("__last"))
    named = results.join(names, "file_id", "left").withColumn("name", F.coalesce("name", "file_id"))
    kinds = F.array_sort(F.map_entries("categories"))
    listed = F.coalesce(F.array_join(F.transform(kinds, lambda e: _joined("<li>", _safe(e["key"]), ": ", e["value"].cast("string"), "</li>")), ""), F.lit(""))
    error = F.when(F.col("error").isNotNull(), _joined("<p>", _safe(F.substring("error", 1, 120)), "</p>")).otherwise("") if "error" in results.columns else F.lit("")
    severity, count = F.coalesce("severity", F.lit("clean")), F.coalesce("warning_count", F.lit(0)).cast("string")
    card = _joined("<section class='", severity, "'><h2>", _safe(F.col("name")), "</h2><p>", _safe(F.col("status")), ", ", count, "</p>", error, "<ul>", listed, "</ul></section>")
    page = (F.coalesce("pos", F.lit(0)) / FILES_A_PAGE).cast("int")
    cards = named.groupBy("job_id", page.alias("page")).agg(F.array_sort(F.collect_list(F.struct("pos", "file_id", card.alias("card")))).alias("cards"))
    head = ["severity", "warnings", "clean_files", "done", "failed_count"]
    told = _joined("<dl class='", F.col("severity"), "'>", *(part for h in head for part in (f"<dt>{h}</dt><dd>", F.col(h).cast("string"), "</dd>")), "</dl>")
    body = F.concat(told, F.array_join(F.transform("cards", lambda c: c["card"]), ""))
    both = cards.join(totals, "job_id").join(last, "job_id")
    return both.select("job_id", (F.col("page") + 1).alias("page"), ((F.col("__last") / FILES_A_PAGE).cast("int") + 1).alias("pages"), html_page(F.lit(title), body).alias("html"))


def store_pages(pages: DataFrame, key: str, folder: str) -> DataFrame:
    """Writes each page to ``folder``, which all executors share, as ``<key>-<page>.html``; a key that is no plain name goes by
    its hash. Returns (``key``, ``page``, ``path``); a task that runs again writes the same files over."""
    plain = F.when(F.col(key).rlike(r"^[\w.-]{1,100}$"), F.col(key)).otherwise(F.sha2(F.coalesce(F.col(key).cast("string"), F.lit("")), 256))
    ready = pages.select(key, "page", F.concat(plain, F.lit("-"), F.col("page").cast("string"), F.lit(".html")).alias("path"), "html")

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = file_system(folder)
        system.create_dir(base, recursive=True)
        for frame in frames:
            for name, html in zip(frame["path"], frame["html"]):
                with system.open_output_stream(f"{base}/{name}") as out:
                    out.write(html.encode())
            yield frame[[key, "page"]].assign(path=[f"{folder}/{name}" for name in frame["path"]])

    return ready.mapInPandas(write, T.StructType([pages.schema[key], pages.schema["page"], T.StructField("path", T.StringType())]))
