"""The library's front: documents and glossaries in, translations and reports out."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parasift.functions import textnorm as tn
from parasift.operators import glossary, quality
from parasift.plans import jobs, reports, translate
from parasift.plans.calls import Calls
from parasift.sources import docx, tables


class Engine:
    """Jobs over one session. ``make`` builds the translator in each worker; without one the offline
    stand-in serves. API keys belong to ``make``'s closure and never become data. ``callers`` bounds the calls
    under way at once."""

    def __init__(self, spark: SparkSession, make: Callable[[], translate.Translator] = translate.OfflineTranslator, callers: Calls | int | None = None):
        self.spark, self.make, self.callers = spark, make, callers

    def ping(self) -> str:
        """One short call to the translator on the driver, to see whether it answers."""
        return self.make().translate("测试", {"测试": "test"})

    def load_glossary(self, path: str) -> dict[str, str]:
        return glossary.as_mapping(tables.read_glossaries(self.spark, path))

    def save_glossary(self, store: str, glossary_id: str, path: str) -> int:
        """Terms of the files below ``path`` kept under ``glossary_id``; returns their number."""
        terms = tables.read_glossaries(self.spark, path).groupBy("cn").agg(F.max_by("en", "file").alias("en"), F.min("ord").alias("ord"))
        terms = terms.select(F.lit(glossary_id).alias("glossary_id"), "cn", "en", "ord")
        jobs.save(terms, store, "terms", ["glossary_id"])
        count = terms.count()
        self._touch(store, glossary_id, path, count)
        return count

    def _touch(self, store: str, glossary_id: str, filename: str, count: int) -> None:
        row = self.spark.range(1).select(F.lit(glossary_id).alias("glossary_id"), F.lit(filename).alias("filename"), F.lit(count).cast("long").alias("term_count"), F.current_timestamp().alias("uploaded_at"))
        jobs.save(row, store, "glossaries", ["glossary_id"])

    def stored_glossary(self, store: str, glossary_id: str) -> dict[str, str]:
        """A kept glossary; use renews its time to live. One that is gone or past its time raises."""
        known = glossary.alive(jobs.load(self.spark, store, "glossaries", ["glossary_id"]).where(F.col("glossary_id") == glossary_id), F.current_timestamp()).first()
        if known is None:
            raise KeyError(glossary_id)
        self._touch(store, glossary_id, known["filename"], known["term_count"])
        return glossary.as_mapping(jobs.load(self.spark, store, "terms", ["glossary_id"]).where(F.col("glossary_id") == glossary_id))

    def read_docx(self, path: str) -> DataFrame:
        """Segments of the files that can be read; ``broken_files`` tells of the others."""
        return docx.read_docx(self.spark, path).where("error is null").drop("error")

    def broken_files(self, path: str) -> DataFrame:
        return docx.read_docx(self.spark, path).where("error is not null").select("file_id", F.lit("failed").alias("status"), "error")

    def translate(self, segments: DataFrame, terms: Mapping[str, str], feedback: str | None = None) -> DataFrame:
        done = translate.translate_segments(segments, terms, self.make, self.callers, feedback)
        return translate.number_document(done, ["file_id", "region"])

    def fix(self, segments: DataFrame, fixes: list[str], terms: Mapping[str, str]) -> DataFrame:
        return translate.fix_segments(segments, fixes, terms, self.make, self.callers)

    def fix_files(self, source: str, target: str, fixes: list[str], terms: Mapping[str, str]) -> DataFrame:
        """The same from the files of a source and of its translation, whose paths end in the same name."""
        name = lambda df: df.withColumn("file_id", F.regexp_replace(F.element_at(F.split("file_id", "/"), -1), F.lit(r"(?:_EN)?\.docx$"), F.lit("")))
        pairs = quality.aligned(name(self.read_docx(source)), name(self.read_docx(target)))
        return self.fix(translate.audited(pairs, terms), fixes, terms)

    def revise(self, segments: DataFrame, previous: DataFrame | None, feedback: str, terms: Mapping[str, str], ask: Callable[[str], str]) -> DataFrame:
        """Translations revised after ``feedback``; ``ask``, one call to a model about formats, is made once a file."""
        answers = translate.feedback_actions(segments, feedback, ask, self.callers or Calls())
        return translate.revise_segments(segments, previous, feedback, answers, terms, self.make, self.callers)

    def revise_with(self, segments: DataFrame, previous: DataFrame | None, feedback: str, answers: DataFrame, terms: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
        """The same for known ``answers`` (of ``translate.feedback_actions``), and (file_id, applied): what was done."""
        done = translate.revise_segments(segments, previous, feedback, answers, terms, self.make, self.callers)
        return done, docx.applied(segments, translate.format_actions(answers, feedback))

    def quality_report(self, translated: DataFrame) -> DataFrame:
        counts = translated.groupBy("file_id").agg(F.count("*").alias("paragraphs"))
        return quality.file_summary(translate.quality_gate(translated), counts)

    def html_report(self, translated: DataFrame, title: str) -> DataFrame:
        """Pages (file_id, page, pages, html) with all warnings of each file, each with its source and translation."""
        return reports.file_pages(reports.numbered_warnings(translated), translated, title)

    def job_report(self, results: DataFrame, names: DataFrame, title: str) -> DataFrame:
        """Pages (job_id, page, pages, html) of each job of ``results`` (job_id, file_id, pos, status, warning_count, severity,
        categories)."""
        return reports.job_pages(results, names, title)

    def store_pages(self, pages: DataFrame, folder: str) -> DataFrame:
        """The pages of a report in files, written where they are made: (file_id or job_id, page, path)."""
        return reports.store_pages(pages, pages.columns[0], folder)

    def preview(self, translated: DataFrame, file_id: str | None = None) -> DataFrame:
        rows = translated if file_id is None else translated.where(F.col("file_id") == file_id)
        return rows.select("file_id", "region", "pos", tn.snippet(F.col("text")).alias("source"), tn.snippet(F.col("translated_text")).alias("target"))

    def job(self, file_ids: list[str], glossary_id: str | None = None) -> DataFrame:
        return jobs.new_job(self.spark, file_ids, glossary_id)

    def start_job(self, store: str, path: str, glossary_id: str | None = None) -> str:
        """A job over the documents below ``path``, kept in ``store``; ``run_job`` does its work, now or after a stop."""
        made = self.job([], glossary_id)
        job_id = made.first()["job_id"]
        jobs.save(made, store, "jobs", ["job_id"])
        files = docx.list_docx(self.spark, path)
        jobs.start(files.withColumn("pos", F.lit(None)), store, job_id)
        return job_id

    def run_job(self, store: str, job_id: str, group: int = jobs.GROUP, feedback: str | None = None) -> DataFrame:
        """Translates the files of a job that are not finished and returns all their states. A file that fails, or
        cannot be read, ends no other; a glossary that is gone ends the job."""
        glossary_id = jobs.load(self.spark, store, "jobs", ["job_id"]).where(F.col("job_id") == job_id).first()["glossary_id"]
        try:
            terms = self.stored_glossary(store, glossary_id) if glossary_id else {}
        except KeyError:
            jobs.fail(self.spark, store, job_id, f"no such glossary, or past its time: {glossary_id}")
            return jobs.states(self.spark, store, job_id)

        def step(segments: DataFrame, progress: str) -> DataFrame:
            done = translate.translate_segments(segments, terms, self.make, self.callers, feedback, progress)
            return translate.number_document(done, ["file_id", "region"])

        return jobs.run(self.spark, store, job_id, lambda ids: docx.read_docx(self.spark, ids), step, group)

    def progress(self, store: str, job_id: str) -> DataFrame:
        return jobs.live_progress(self.spark, store, job_id)

    def result(self, results: DataFrame, file_id: str | None = None) -> DataFrame:
        return jobs.first_result(results, file_id)

    def bundle(self, results: DataFrame, names: DataFrame, load: Callable[[str], bytes], target: BinaryIO) -> int:
        return jobs.bundle(results, names, load, target)

    def write_docx(self, path: str, translated: DataFrame, store: Callable[[str, bytes], str]) -> DataFrame:
        """Texts, formats and line spacing of ``translated`` in the files of ``path``."""
        asked = F.col("asked") if "asked" in translated.columns else None
        spacing = F.col("line_spacing") if "line_spacing" in translated.columns else F.lit(None).cast("string")
        edits = translated.select("file_id", "region", "pos", "tbl", "row", "col", "box", F.col("translated_text").alias("new_text"), docx.union_format(F.col("runs"), asked).alias("format"), spacing.alias("line_spacing"))
        return docx.write_docx(self.spark, path, edits, store)
