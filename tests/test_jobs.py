"""The life of a job: versions, restarts, files that fail, progress that is seen while it runs."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from parasift.engine import Engine
from parasift.plans import jobs, translate
from parasift.plans.calls import Calls
from parasift.sources import docx


def files(spark, ids):
    return spark.createDataFrame([(i, i.upper(), n) for n, i in enumerate(ids)], "file_id string, name string, pos int")


def reader(spark, sizes):
    rows = spark.createDataFrame([(f, n) for f, size in sizes.items() for n in range(size)], "file_id string, n int")
    return lambda ids: rows.where(F.col("file_id").isin(ids))


def shown(found):
    return {r.file_id: (r.status, r.attempt, r.segments, r.warnings) for r in found.collect()}


def test_versions_count_by_number(spark, tmp_path):
    store = str(tmp_path)
    row = lambda key, value: spark.createDataFrame([(key, value)], "k string, v int")
    assert [jobs.save(row("a", 1), store, "t", ["k"]), jobs.save(row("a", 2), store, "t", ["k"]), jobs.save(row(None, 3), store, "t", ["k"]), jobs.save(row(None, 4), store, "t", ["k"])] == [1, 2, 3, 4]
    assert sorted(map(tuple, jobs.load(spark, store, "t", ["k"]).collect()), key=str) == [("a", 2), (None, 4)]
    assert jobs.load(spark, store, "none", ["k"], "k string").collect() == []
    jobs.save(spark.createDataFrame([("a", 9, "new")], "k string, v int, more string"), store, "t", ["k"])
    assert {(r.k, r.v, r.more) for r in jobs.load(spark, store, "t", ["k"]).collect()} == {("a", 9, "new"), (None, 4, None)}


def test_savers_at_once_get_numbers_of_their_own(spark, tmp_path):
    got = []
    saver = lambda n: got.append(jobs.save(spark.createDataFrame([(n,)], "k int"), str(tmp_path), "t", ["k"]))
    threads = [threading.Thread(target=saver, args=(n,)) for n in range(5)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(got) == sorted(set(got)) and jobs.load(spark, str(tmp_path), "t", ["k"]).count() == 5


def test_a_failing_file_ends_no_other(spark, tmp_path):
    store, read = str(tmp_path), reader(spark, {"a": 2, "b": 3, "c": 1, "d": 4})
    jobs.start(files(spark, ["a", "b", "c", "d", "empty"]), store, "j")

    def step(rows, progress):
        told = F.when(F.col("n") == 1, F.array(F.lit("w"))).otherwise(F.array().cast("array<string>"))
        return rows.withColumn("warnings", told).withColumn("n", F.when(F.col("file_id") == "c", F.raise_error("bad file").cast("int")).otherwise(F.col("n")))

    done = shown(jobs.run(spark, store, "j", read, step))
    assert done["a"] == ("completed", 1, 2, 1) and done["b"] == ("completed", 1, 3, 1) and done["d"] == ("completed", 1, 4, 1)
    assert done["c"][0] == "failed" and done["empty"] == ("completed", 1, 0, 0)
    assert "bad file" in jobs.states(spark, store, "j").where("file_id = 'c'").first()["error"]
    assert jobs.results(spark, store, "j").groupBy("file_id").count().count() == 3
    total = jobs.status(jobs.states(spark, store)).first()
    assert (total.status, total.completed, total.failed, total.warnings) == ("completed", 4, 1, 3)


class Killed(BaseException):
    pass


@pytest.mark.parametrize("after", ["step", "results"])
def test_a_stop_between_two_files(spark, tmp_path, monkeypatch, after):
    store, read = str(tmp_path), reader(spark, {"a": 2, "b": 3, "c": 1})
    jobs.start(files(spark, ["a", "b", "c"]), store, "j")
    ran = []

    def step(rows, progress):
        name = rows.first()["file_id"]
        if name == "b" and after == "step" and "b" not in ran:
            ran.append(name)
            raise Killed
        ran.append(name)
        return rows

    saved = jobs.save

    def stop_after_results(table, store, name, keys):
        number = saved(table, store, name, keys)
        if name == "results" and ran == ["a", "b"]:
            raise Killed
        return number

    if after == "results":
        monkeypatch.setattr(jobs, "save", stop_after_results)
    with pytest.raises(Killed):
        jobs.run(spark, store, "j", read, step, group=1)
    monkeypatch.setattr(jobs, "save", saved)
    assert {f: s[0] for f, s in shown(jobs.states(spark, store, "j")).items()} == {"a": "completed", "b": "processing", "c": "pending"}
    assert jobs.status(jobs.states(spark, store, "j")).first()["status"] == "processing"
    done = shown(jobs.run(spark, store, "j", read, step, group=1))
    assert {f: s[0] for f, s in done.items()} == dict.fromkeys("abc", "completed") and done["a"][1] == 1
    assert ran == (["a", "b", "b", "c"] if after == "step" else ["a", "b", "c"])  # each finished file once
    assert {r.file_id: r["count"] for r in jobs.results(spark, store, "j").groupBy("file_id").count().collect()} == {"a": 2, "b": 3, "c": 1}


class Slow:
    def translate(self, text, terms, instruction=""):
        time.sleep(0.8)
        return "an answer"

    def polish(self, text):
        return text


def test_progress_is_seen_while_a_job_runs(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, size in (("one", 20), ("two", 30)):
        (tmp_path / "in" / f"{name}.docx").write_bytes(docx.new_document([{"region": "body", "text": f"第{i}段中文内容"} for i in range(size)]))
    (tmp_path / "in" / "bad.docx").write_bytes(b"no package")
    store = str(tmp_path / "store")
    engine = Engine(spark, Slow, Calls(2, 2))
    job_id = engine.start_job(store, str(tmp_path / "in"))
    assert {r.name for r in jobs.states(spark, store, job_id).collect()} == {"one", "two", "bad"}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    worker = threading.Thread(target=engine.run_job, args=(store, job_id))
    seen = []
    try:
        worker.start()
        while worker.is_alive():
            seen.append({r.file_id.rsplit("/", 1)[1]: r.fraction for r in engine.progress(store, job_id).collect()})
            time.sleep(0.1)
    finally:
        worker.join()
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    shares = [s["two.docx"] for s in seen]
    assert any(0 < x < 0.99 for x in shares) and shares == sorted(shares) and all(x <= 0.99 or x == 1 for x in shares)
    last = {r.name: r for r in jobs.states(spark, store, job_id).collect()}
    assert last["bad"].status == "failed" and "BadZipFile" in last["bad"].error and last["two"].status == "completed" and last["two"].segments == 30
    assert {r.fraction for r in engine.progress(store, job_id).where("status = 'completed'").collect()} == {1.0}
    assert jobs.results(spark, store, job_id).where("translated_text = 'an answer'").count() == 50


def test_marks_of_a_repeated_task_count_once(spark, tmp_path):
    store = str(tmp_path)
    jobs.start(files(spark, ["a"]), store, "j")
    own = jobs.states(spark, store, "j").withColumns({"status": F.lit("processing"), "segments": F.lit(4).cast("long")})
    jobs.save(own, store, "files", jobs.FILE_KEYS)
    for _ in range(3):
        jobs.mark(jobs.marks(store, "j"), "x-0-0", {"a": 2})
    assert jobs.live_progress(spark, store, "j").first().fraction == 0.5
    jobs.mark(jobs.marks(store, "j"), "x-0-1", {"a": 2})
    assert jobs.live_progress(spark, store, "j").first().fraction == 0.99


def test_a_glossary_that_is_gone_ends_the_job(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.docx").write_bytes(docx.new_document([{"region": "body", "text": "x"}]))
    (tmp_path / "g.csv").write_text("甲,first\n", encoding="utf-8")
    store, engine = str(tmp_path / "store"), Engine(spark, translate.OfflineTranslator)
    engine.save_glossary(store, "other", str(tmp_path / "g.csv"))
    job_id = engine.start_job(store, str(tmp_path / "in"), "gone")
    row = engine.run_job(store, job_id).first()
    assert row.status == "failed" and "gone" in row.error
    assert jobs.status(jobs.states(spark, store)).first().status == "failed"
