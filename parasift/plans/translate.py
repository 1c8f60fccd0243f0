"""Translation, fix and revision of paragraphs as plans around a pluggable translator.

Only paragraphs whose route is the model reach it: the routes are split before the Python stage, as a
Python function within a CASE would run for every row.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections import Counter, deque
from collections.abc import Callable, Iterator, Mapping
from itertools import count
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parasift.functions import textnorm as tn
from parasift.operators import cleaning, dedup, fidelity, glossary, guards, numbering, quality
from parasift.plans import jobs, reports
from parasift.plans.calls import ATTEMPTS, FIRST_PAUSE, OFFLINE, REMOTE, Answer, Calls, Window
from parasift.sources import docx
from parasift.staging import stage

POLISH_FROM, POLISH_LEAST = 120, 10
#: A text under so many characters is asked for a third time if Chinese is left.
SHORT = 300
#: What the model is told beside the text.
FULLY = "Your last answer still held Chinese. Give the whole text in English."
STRICTLY = "Two answers still held Chinese. Write English alone: not one Chinese character may be left, names included."
PRESERVE = "Your last answer lost figures. Each of these has to stand in the translation exactly as written:"
# Fixed values.
RESTORED, NOT_RESTORED = "保真重译: 已自动恢复缺失的数字/金额", "保真重译后仍有数字缺失，请人工核对"
FIX_ORDER = ["term", "numbering", "duplicate", "fidelity", "chinese"]


class Translator(Protocol):
    """What turns a source text into a translation; one is made in each worker."""

    def translate(self, text: str, terms: Mapping[str, str], instruction: str = "") -> str: ...

    def polish(self, text: str) -> str: ...


class OfflineTranslator:
    """Deterministic stand-in: terms replaced, nothing else."""

    def translate(self, text: str, terms: Mapping[str, str], instruction: str = "") -> str:
        if getattr(self, "terms", None) is not terms:
            self.terms, self.replace = terms, glossary.Replacer(sorted(((c, e) for c, e in terms.items() if c), key=lambda t: -len(t[0])))
        return self.replace(text)

    def polish(self, text: str) -> str:
        return text


def with_retries(call: Callable[[], str], attempts: int = ATTEMPTS, pause: float = FIRST_PAUSE) -> str:
    """The same for one call on the driver."""
    for attempt in range(attempts):
        try:
            return call()
        except Exception:
            if attempt + 1 == attempts:
                raise
            time.sleep(pause * 2**attempt)
    raise AssertionError


def call_model(df: DataFrame, column: str, make: Callable[[], Translator], method: str, terms: Mapping[str, str] | None = None, callers: Calls | int | None = None, instruction: str | None = None, progress: str | None = None) -> DataFrame:
    """``df`` with ``column`` run through the translator and ``model_error`` where it failed in all attempts: the
    text then stays as it was. ``instruction`` names a column with what the model is told beside the text.
    ``callers`` bounds the calls under way at once: so many tasks, and in each a window of calls whose answers come in
    the order of the rows. The window goes on from batch to batch. The answers are written once: no later step
    or lost executor asks again for what has been answered."""
    calls = callers if isinstance(callers, Calls) else Calls(callers)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", model_error string"
    label = uuid.uuid4().hex

    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, window, held, number = make(), Window(calls), deque(), count()

        def asked() -> Iterator[tuple]:
            for batch in batches:
                texts = batch.column(at).to_pylist()
                held.append((batch, texts))
                told = batch.column(instruction).to_pylist() if instruction else [""] * len(texts)
                for text, more in zip(texts, told):
                    yield (model.translate, text, terms or {}, more or "") if method == "translate" else (model.polish, text)

        try:
            answers = window.ordered(asked())
            got: list[Answer] = []
            for answer in answers:
                got.append(answer)
                while held and len(got) >= len(held[0][1]):
                    done = _answered(*held.popleft(), at, got)
                    if progress:
                        whole = Counter(f for f, n in zip(done.column("file_id").to_pylist(), done.column("__n").to_pylist()) if n == 0)
                        jobs.mark(progress, f"{label}-{TaskContext.get().partitionId()}-{next(number)}", {str(f): n for f, n in whole.items()})
                    yield done
            for batch, texts in held:  # empty ones
                yield _answered(batch, texts, at, got)
        finally:
            window.close()

    asked = df if calls.callers is None else df.repartition(calls.callers)
    return stage(asked.mapInArrow(run, schema), f"model-{method}")


def _answered(batch: pa.RecordBatch, texts: list[str | None], at: int, got: list[Answer]) -> pa.RecordBatch:
    """``batch`` with its answers in column ``at``, the first of ``got``, which are taken off there."""
    own, got[:] = got[: len(texts)], got[len(texts) :]
    told = [text if a.error is not None else a.value or text for text, a in zip(texts, own)]
    columns = [pa.array(told, batch.schema.field(i).type) if i == at else c for i, c in enumerate(batch.columns)]
    return pa.RecordBatch.from_arrays([*columns, pa.array([a.error for a in own], pa.string())], names=[*batch.schema.names, "model_error"])


class _Job:
    """What all steps of one translation share."""

    def __init__(self, terms: Mapping[str, str], make: Callable[[], Translator], callers: Calls | int | None, keys: list[str], feedback: str | None = None, progress: str | None = None):
        self.progress = progress
        self.terms, self.make, self.keys, self.feedback = dict(terms), make, keys, feedback
        self.callers = callers if callers is not None else OFFLINE if make is OfflineTranslator else REMOTE
        self.source: DataFrame | None = None
        self._rare: DataFrame | None = None

    def watch(self, segments: DataFrame) -> None:
        """Words that are rare in a region's source are protected from the removal of repeats there."""
        self.source = segments

    def rare(self) -> DataFrame:
        """Those words, counted when a row first needs them."""
        if self._rare is None:
            self._rare = stage(dedup.protected_tokens(self.source, "text", self.keys).select(*self.keys, "token"), "rare-words")
        return self._rare

    def clean(self, rows: DataFrame, text: str) -> DataFrame:
        """``rows`` with ``text`` cleaned, written once. Only texts in which a word comes twice go through the removal of
        repeats, in Python; there a row gets those of its region's protected words that it holds."""
        ready = rows.withColumn("__r", cleaning.stretched(F.col(text))).withColumn("__again", cleaning.repeated(F.col("__r")))
        ready = stage(ready, "rows")
        done = ready.where("not __again").withColumn(text, cleaning.finished(F.col("__r"))).select(rows.columns)
        some = ready.where("__again").drop("__again")
        if some.limit(1).count():
            if self.source is not None:
                some = dedup.with_protected(some, text, self.keys, self.rare())
            judged = cleaning.clean_stretched(some, text, "protected" if self.source is not None else None)
            done = done.unionByName(judged.select(rows.columns))
        return stage(done, "cleaned")

    def speak(self, rows: DataFrame, instruction: Column | str | None = None, progress: str | None = None) -> DataFrame:
        """``rows`` with ``spoken`` and ``model_error``: dates converted, numbers masked, chunks of whole
        sentences translated, joined and unmasked; labels, remarks and marks of the model taken out. A URL
        line is no business of the model; where it failed, ``spoken`` is the source."""
        columns = rows.columns
        told = F.lit(instruction or "") if not isinstance(instruction, Column) else instruction
        if self.feedback:
            told = F.concat_ws("\n\n", F.when(told != "", told), F.lit(self.feedback))
        masked = rows.withColumn("__told", told).withColumn("__g", guards.mask(tn.convert_chinese_dates(F.col("text")))).withColumn("__row", F.monotonically_increasing_id())
        chunks = masked.select(*columns, "__row", "__told", F.col("__g.guards").alias("__guards"), F.posexplode(tn.split_long(F.col("__g.text"))).alias("__n", "__chunk"))
        spoken = call_model(chunks, "__chunk", self.make, "translate", self.terms, self.callers, "__told", progress)
        whole = spoken.groupBy("__row").agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__n", "__chunk"))), lambda c: c["__chunk"]), "").alias("__text"),
            F.first("__guards").alias("__guards"),
            F.max("model_error").alias("model_error"),
            *(F.first(c).alias(c) for c in columns),
        )
        restored = guards.restore(F.trim("__text"), F.col("__guards"))
        text = F.when(F.col("model_error").isNotNull(), F.col("text")).otherwise(restored)
        return whole.withColumn("spoken", tidied(text)).select(*columns, "spoken", "model_error")

    def again(self, rows: DataFrame, which: Column, instruction: Column | str, taken: Column) -> DataFrame:
        """``rows``, a staged table, with the chosen ones asked for once more; the answer, cleaned, counts where ``taken`` (over
        ``spoken`` and ``translated_text``) and the model did not fail. ``retaken`` tells where it did."""
        which = F.coalesce(which, F.lit(False))
        if not rows.where(which).limit(1).count():
            return rows.withColumn("retaken", F.lit(False))
        asked = self.clean(stage(self.speak(rows.where(which), instruction), "asked"), "spoken")
        taken = F.col("model_error").isNull() & F.coalesce(taken, F.lit(False))
        asked = asked.withColumn("retaken", taken).withColumn("translated_text", F.when(F.col("retaken"), F.col("spoken")).otherwise(F.col("translated_text")))
        rest = rows.where(~which).withColumn("retaken", F.lit(False))
        return stage(rest.unionByName(asked.drop("spoken", "model_error")), "retried")

    def polish(self, rows: DataFrame) -> DataFrame:
        """``translated_text`` of ``rows``, of a staged table, polished: cleaned, dates and numbers masked, asked, unmasked, cleaned
        again. Lines with a URL are only cleaned, as is what the model fails on."""
        if not rows.limit(1).count():
            return rows
        first = stage(cleaning.clean_segments(rows, "translated_text").drop("dedup_audit"), "cleaned")
        asked = first.withColumn("__link", F.coalesce(tn.contains_url(F.col("translated_text")), F.lit(False)))
        masked = stage(asked.where("not __link").withColumn("__g", guards.mask_polish(F.col("translated_text"))).withColumn("translated_text", F.col("__g.text")), "masked")
        spoken = call_model(masked, "translated_text", self.make, "polish", None, self.callers)
        back = spoken.withColumn("translated_text", guards.restore(F.trim("translated_text"), F.col("__g.guards"))).drop("__g", "model_error")
        return cleaning.clean_segments(back, "translated_text").drop("dedup_audit").unionByName(asked.where("__link")).drop("__link")

    def complete(self, rows: DataFrame, notes: str, lost: str | None = None) -> DataFrame:
        """``translated_text`` with cut terms made whole, and what was done added to the array ``notes``. ``lost`` names a
        column for the warnings of numbers of the result, so that these are looked for once."""
        done = rows.withColumn("__c", glossary.completed(F.col("translated_text"), self.terms))
        told = F.transform("__c.audit", lambda a: F.concat(F.lit("术语补全: 「"), a["from_text"], F.lit("」→「"), a["to_text"], F.lit("」")))
        done = done.withColumn("translated_text", F.col("__c.text")).withColumn(notes, F.concat(notes, told)).drop("__c")
        return stage(done.withColumn(lost, fidelity.warnings(F.col("text"), F.col("translated_text"))) if lost else done, "completed")

    def findings(self, lost: Column | None = None) -> Column:
        """Warnings of a row's numbers, unless ``lost`` has them, and of its terms."""
        numbers = fidelity.warnings(F.col("text"), F.col("translated_text")) if lost is None else lost
        return F.concat(numbers, glossary.term_warnings(F.col("text"), F.col("translated_text"), self.terms))


def tidied(text: Column) -> Column:
    """A translation without labels, remarks, revision tags and markdown."""
    return tn.strip_markdown(tn.strip_revision_tags(tn.fix_cn_labels(text)))


def _residue(text: Column) -> Column:
    return F.size(tn.chinese_residue(text))


def _lost(target: Column) -> Column:
    return F.size(fidelity.warnings(F.col("text"), target))


def _must_preserve() -> Column:
    return F.concat(F.lit(PRESERVE + "\n- "), F.array_join(guards.must_preserve(F.col("text")), "\n- "))


def translate_segments(segments: DataFrame, terms: Mapping[str, str], make: Callable[[], Translator] = OfflineTranslator, callers: Calls | int | None = None, feedback: str | None = None, progress: str | None = None) -> DataFrame:
    """Rows (``file_id``, ``region``, ``pos``, ``text``; other key columns pass) with ``route``,
    ``translated_text`` and ``warnings``.

    Blank and null texts stay. Lines with a URL and short lines without Chinese need no model: labels and
    terms are replaced, the rest cleaned. All others go through the model. ``callers`` bounds the calls under
    way at once, to ``REMOTE`` unless the translator is the offline one; ``feedback`` is told to the model with every
    text.
    """
    job = _Job(terms, make, callers, ["file_id", "region"], feedback, progress)
    empty = F.array().cast("array<string>")
    # Each route reads the table anew, so what made the texts, and their routes, is written once.
    keyed = stage(segments.withColumn("route", tn.route(F.col("text"))).withColumn("warnings", empty), "routed")
    job.watch(keyed)
    blank = keyed.where("route = 'blank' or route is null").withColumn("translated_text", F.col("text"))
    url = keyed.where("route = 'url'").withColumn("translated_text", tn.fix_cn_labels(cleaning.url_line(F.col("text"), job.terms)))
    term = keyed.where("route = 'term'").withColumn("translated_text", tidied(glossary.translate_terms(F.col("text"), job.terms)))
    term = job.complete(job.clean(term, "translated_text"), "warnings")
    model = _through_model(keyed.where("route = 'model'"), job)
    names = model.columns
    return unions([x.select(names) for x in (blank, job.clean(url, "translated_text"), term, model)])


def unions(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _through_model(rows: DataFrame, job: _Job) -> DataFrame:
    """First answer; where Chinese is left, a second and, for short texts, a third, then terms alone; clean-up;
    polish of long texts; completion of terms; where numbers are missing, an answer asked for with a list of
    them, which counts if it has fewer findings. Then the findings."""
    columns = rows.columns
    terms_only = glossary.translate_terms(F.col("text"), job.terms)
    first = job.speak(rows, progress=job.progress)
    first = first.withColumn("translated_text", F.when(F.col("model_error").isNotNull(), tidied(terms_only)).otherwise(F.col("spoken"))).drop("spoken", "model_error")
    left = _residue(F.col("translated_text")) > 0
    second = job.again(stage(first, "spoken"), left, FULLY, F.lit(True)).withColumnRenamed("retaken", "__second")
    short = left & F.col("__second") & (F.length("text") < SHORT)
    third = job.again(second, short, STRICTLY, F.lit(True)).withColumn("__third", short & F.col("__second")).drop("retaken", "__second")
    bare = F.when(F.col("__third") & left, tidied(terms_only))
    third = third.withColumn("translated_text", F.when(_residue(bare) == 0, bare).otherwise(F.col("translated_text"))).drop("__third")
    clean = job.clean(third, "translated_text")
    long = F.coalesce(F.length("translated_text") > max(POLISH_FROM, POLISH_LEAST - 1), F.lit(False))
    both = job.polish(clean.where(long)).unionByName(clean.where(~long))
    done = job.complete(both.withColumn("__notes", F.array().cast("array<string>")), "__notes", "__lost")
    asked = (F.size("__lost") > 0) & guards.must_preserve(F.col("text")).isNotNull()
    kept = job.again(done, asked, _must_preserve(), _lost(F.col("spoken")) < F.size("__lost"))
    retaken = job.complete(kept.where("retaken").withColumn("__more", F.array().cast("array<string>")), "__more", "__lost")
    status = F.when(F.size("__lost") > 0, NOT_RESTORED).otherwise(RESTORED)
    retaken = retaken.withColumn("__notes", F.concat("__more", F.array(status), "__notes")).drop("__more")
    whole = retaken.unionByName(kept.where("not retaken"))
    return whole.withColumn("warnings", F.concat(job.findings(F.col("__lost")), "__notes")).select(*columns, "translated_text")


def number_document(translated: DataFrame, keys: list[str]) -> DataFrame:
    """List numbers made one style in each document of ``keys``, in the document's order; what was found joins
    the warnings of its line."""
    placed = translated
    for name in ("tbl", "row", "col", "box"):
        if name not in translated.columns:
            placed = placed.withColumn(name, F.lit(None).cast("int"))
    numbered = numbering.normalize(placed, keys, numbering.document_order(), "translated_text")
    return numbered.withColumn("warnings", F.concat("warnings", numbering.warnings())).withColumn("translated_text", F.col("new_text")).select(*translated.columns)


def quality_gate(translated: DataFrame) -> DataFrame:
    """(file_id, warning): fidelity and completion findings, residue, and repeats left in the result."""
    own = translated.select("file_id", F.explode("warnings").alias("warning"))
    left = quality.residue_warnings(translated, "translated_text")
    found = translated.select("file_id", F.explode(dedup.audit(F.col("translated_text"))).alias("d"))
    repeats = found.select("file_id", reports.repeat_warning(F.col("d")).alias("warning"))
    return own.unionByName(left).unionByName(repeats)


def audited(segments: DataFrame, terms: Mapping[str, str]) -> DataFrame:
    """``segments`` with ``warnings`` found anew: numbers and terms of each line, numbering of each file.
    Residue and repeats are the quality gate's."""
    job = _Job(terms, OfflineTranslator, None, [])
    found = F.when(tn.route(F.col("text")) == "model", job.findings()).otherwise(F.array().cast("array<string>"))
    return number_document(segments.withColumn("warnings", found), ["file_id"]).withColumn("translated_text", F.col("translated_text"))


def fix_segments(segments: DataFrame, fixes: list[str], terms: Mapping[str, str], make: Callable[[], Translator] = OfflineTranslator, callers: Calls | int | None = None) -> DataFrame:
    """``segments`` (file_id, region, pos, text: source; translated_text, warnings) after the asked-for
    ``fixes``, always in the order term, numbering, duplicate, fidelity, chinese.

    Body and cells only; a text box keeps its text. A file that no fix changes keeps its warnings; one that
    changes is audited anew, so warnings of what was mended go and new ones come.
    """
    unknown = set(fixes) - set(FIX_ORDER)
    if unknown:
        raise ValueError(f"no such fix: {sorted(unknown)}")
    columns, job = segments.columns, _Job(terms, make, callers, ["file_id", "region"])
    boxes = segments.where("region = 'textbox'").withColumn("__was", F.col("translated_text"))
    now = segments.where("region is null or region <> 'textbox'").withColumn("__was", F.col("translated_text"))
    for fix in (f for f in FIX_ORDER if f in fixes):
        target = F.col("translated_text")
        if fix == "term":
            now = stage(now.withColumn("translated_text", glossary.completed(target, job.terms)["text"]), "fixed")
        elif fix == "numbering":
            now = number_document(now, ["file_id"])
        elif fix == "duplicate":
            told = stage(now.withColumn("__twice", cleaning.word_twice(target)), "fixed")
            some = told.where("__twice").withColumn("translated_text", dedup.dedup(target)["text"])
            now = stage(told.where("not __twice").unionByName(some).drop("__twice"), "fixed")
        elif fix == "fidelity":
            # The source of a table cell is no part of this fix, as it is found by body position only.
            asked = (F.col("region") == "body") & (_lost(target) > 0) & guards.must_preserve(F.col("text")).isNotNull()
            now = job.again(stage(now, "fixed"), asked, _must_preserve(), _lost(F.col("spoken")) == 0).drop("retaken")
        else:
            now = job.again(stage(now, "fixed"), _residue(target) > 0, FULLY, _residue(F.col("spoken")) == 0).drop("retaken")
    done = stage(now.unionByName(boxes), "fixed")
    changed = done.where(~F.col("translated_text").eqNullSafe(F.col("__was"))).select("file_id").distinct()
    fresh = audited(done.join(changed, "file_id", "left_semi").select(columns), terms)
    same = done.join(changed, "file_id", "left_anti").select(columns)
    before = segments.select(*[F.col(c).alias(f"__{c}") for c in quality.PLACE if c in columns], F.col("warnings").alias("__warnings"))
    keyed = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in quality.PLACE if c in columns]
    kept = same.drop("warnings").join(before, keyed).withColumn("warnings", F.col("__warnings")).select(columns)
    return fresh.select(columns).unionByName(kept)


def feedback_actions(segments: DataFrame, feedback: str, ask: Callable[[str], str], callers: Calls | int | None = REMOTE) -> DataFrame:
    """(file_id, needs_retranslation, actions): what a model makes of a feedback for each file. It is shown the file's
    listing, the first 60 characters of each segment by number: body, cells, boxes. Files are asked about in tasks;
    where the model fails or answers without an object, nothing is asked of the file."""
    calls = callers if isinstance(callers, Calls) else Calls(callers)
    line = F.concat(F.lit("["), F.col("number"), F.lit("] "), F.substring(F.coalesce("text", F.lit("")), 1, 60))
    numbered = docx.listed(segments, numbering.document_order()).select("file_id", F.struct("number", line.alias("line")).alias("l"))
    pages = numbered.groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), "\n").alias("page"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        window = Window(calls)
        try:
            for frame in frames:
                answers = window.ordered((ask, f"{page}\n\n{feedback}") for page in frame["page"])
                yield pd.DataFrame({"file_id": frame["file_id"], "reply": [a.value or "" for a in answers]})
        finally:
            window.close()

    asked = pages if calls.callers is None else pages.repartition(calls.callers)
    replies = stage(asked.mapInPandas(run, "file_id string, reply string"), "feedback")
    return replies.select("file_id", parse_actions(F.col("reply")).alias("a")).select("file_id", "a.*")


def format_actions(answers: DataFrame, feedback: str) -> DataFrame:
    """``docx.ACTIONS`` of ``feedback_actions``; a file of whose formats the answer tells nothing gets those that the
    feedback's own words ask for."""
    told = answers.where(F.size("actions") > 0).select("file_id", F.posexplode("actions").alias("ord", "a"))
    plain = answers.where(F.size("actions") == 0).select("file_id", F.posexplode(docx.keyword_actions(F.lit(feedback))).alias("ord", "a"))
    none = F.array().cast("array<int>")
    return told.select("file_id", "ord", "a.action", "a.value", F.coalesce("a.indices", none).alias("indices")).unionByName(plain.select("file_id", "ord", "a.action", "a.value", none.alias("indices")))


def revise_segments(segments: DataFrame, previous: DataFrame | None, feedback: str, answers: DataFrame, terms: Mapping[str, str], make: Callable[[], Translator] = OfflineTranslator, callers: Calls | int | None = None) -> DataFrame:
    """Translations revised after ``feedback``, file by file: translated again with it where ``answers`` (of
    ``feedback_actions``) asks for that or there is no ``previous`` translation of the file, then with the formats that
    the answer asks for, or, if it names none, that the feedback's own words do."""
    again = answers.where("needs_retranslation").select("file_id")
    if previous is not None:
        again = again.unionByName(segments.select("file_id").distinct().join(previous.select("file_id").distinct(), "file_id", "left_anti"))
    else:
        again = segments.select("file_id").distinct()
    again = stage(again.distinct(), "again")
    parts = [] if previous is None else [previous.join(again, "file_id", "left_anti")]
    if again.limit(1).count():
        chosen = segments.join(again, "file_id", "left_semi")
        parts.append(number_document(translate_segments(chosen, terms, make, callers, feedback), ["file_id", "region"]))
    if len(parts) == 2:
        parts = [p.select(*parts[0].columns) for p in parts]
    return docx.apply_actions(unions(parts), format_actions(answers, feedback), numbering.document_order())


def parse_actions(response: Column) -> Column:
    """Format actions from a model's answer: the outermost JSON object in it; none if there is none."""
    body = F.regexp_extract(response, r"(?s)\{.*\}", 0)
    parsed = F.from_json(body, "needs_retranslation boolean, actions array<struct<indices:array<int>,action:string,value:string>>")
    return F.struct(F.coalesce(parsed["needs_retranslation"], F.lit(False)).alias("needs_retranslation"), F.coalesce(parsed["actions"], F.from_json(F.lit("[]"), "array<struct<indices:array<int>,action:string,value:string>>")).alias("actions"))


def interpret_feedback(paragraphs: list[str], feedback: str, ask: Callable[[str], str]) -> dict:
    """The same for one request on the driver: paragraphs as ``[i] first 60 characters``."""
    listing = "\n".join(f"[{i}] {p[:60]}" for i, p in enumerate(paragraphs))
    try:
        found = re.search(r"\{.*\}", with_retries(lambda: ask(f"{listing}\n\n{feedback}")), re.DOTALL)
        parsed = json.loads(found[0]) if found else {}
    except Exception:
        parsed = {}
    return {"needs_retranslation": bool(parsed.get("needs_retranslation", False)), "actions": parsed.get("actions", [])}
