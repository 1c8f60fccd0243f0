"""Jobs as tables: results with names, the first finished file, totals."""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable
from functools import reduce
from typing import BinaryIO

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parasift.operators import quality
from parasift.sources import docx
from parasift.staging import file_system, stage

RESULT = "job_id string, file_id string, pos int, status string, output string, error string, warning_count long"


def new_job(spark: SparkSession, file_ids: list[str], glossary_id: str | None = None) -> DataFrame:
    """One pending job; credentials are no part of it."""
    row = (uuid.uuid4().hex, "pending", file_ids, glossary_id, 0, None)
    return spark.createDataFrame([row], "job_id string, status string, file_ids array<string>, glossary_id string, failed_count int, error string")


def named(results: DataFrame, names: DataFrame) -> DataFrame:
    """``results`` with the ``name`` of each file (file_id, name), or its id."""
    return results.join(names, "file_id", "left").withColumn("name", F.coalesce("name", "file_id"))


def first_result(results: DataFrame, file_id: str | None = None) -> DataFrame:
    """The first finished file of each job, or the given one."""
    done = results.where("status = 'completed'")
    done = done if file_id is None else done.where(F.col("file_id") == file_id)
    order = Window.partitionBy("job_id").orderBy("pos", "file_id")
    return done.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def progress(segments: DataFrame, done: DataFrame) -> DataFrame:
    """(file_id, total, completed) over segment keys; a file is at most 99 hundredths done until all is."""
    total = segments.groupBy("file_id").agg(F.count("*").alias("total"))
    counted = total.join(done.groupBy("file_id").agg(F.count("*").alias("n")), "file_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return counted.select("file_id", "total", F.when(F.col("n") >= F.col("total"), 1.0).otherwise(F.least(F.col("n") / F.col("total"), F.lit(0.99))).alias("completed"))


def summary(results: DataFrame) -> DataFrame:
    """Totals and status of each job: failed only if no file was finished, and how many files failed."""
    totals = quality.job_summary(results)
    return totals.withColumn("status", F.when((F.col("done") == 0) & (F.col("failed_count") > 0), "failed").otherwise("completed"))


def bundle(results: DataFrame, names: DataFrame, load: Callable[[str], bytes], target: BinaryIO) -> int:
    """Writes a ZIP of a job's finished documents to ``target`` and returns their number; ``load`` reads an
    output. One document is in memory at a time, however many there are."""
    rows = named(results.where("status = 'completed'"), names).orderBy("pos", "file_id")
    count = rows.count()
    docx.bundle(((r["name"], load(r["output"])) for r in rows.toLocalIterator()), target)
    return count


# Stored tables: numbered versions.


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


#: Local file systems do not create a file for one thread alone.
_CLAIMING = threading.Lock()


def _created(system, file) -> bool:
    """Whether this call, and no other, has made the file."""
    try:
        return system.createNewFile(file)
    except Py4JJavaError:  # some file systems raise where another was first
        if system.exists(file):
            return False
        raise


def save(table: DataFrame, store: str, name: str, keys: list[str]) -> int:
    """Rows added to the table ``name`` in the folder ``store`` as its next version, whose number is returned: jobs,
    files, results, glossaries and their terms. Of rows with equal ``keys`` those of the highest version count when
    they are read.

    A number is claimed by a file that only one can create; the rows are written beside the table and moved there
    whole, so readers see a version whole or not at all, and a writer that dies leaves nothing but a number.
    """
    spark = table.sparkSession
    system, folder = _folder(spark, f"{store}/{name}")
    path = spark._jvm.org.apache.hadoop.fs.Path
    claims = path(folder, "_claims")
    system.mkdirs(claims)
    with _CLAIMING:
        taken = [int(f.getPath().getName()) for f in system.listStatus(claims)]
        version = max(taken, default=0) + 1
        while not _created(system, path(claims, f"{version:09d}")):
            version += 1
    writing = path(folder, f"_writing-{uuid.uuid4().hex}")
    try:
        table.write.parquet(writing.toString())
    except BaseException:
        system.delete(writing, True)
        raise
    if not system.rename(writing, path(folder, f"version={version}")):
        raise OSError(f"version {version} of {name} could not be put in place")
    return version


def load(spark: SparkSession, store: str, name: str, keys: list[str], schema: str | None = None) -> DataFrame:
    """The table ``name`` as last saved: for equal ``keys``, nulls equal too, the rows of the highest version. A table
    that was never saved is empty if ``schema`` tells its columns."""
    system, folder = _folder(spark, f"{store}/{name}")
    if schema is not None and not any(f.getPath().getName().startswith("version=") for f in (system.listStatus(folder) if system.exists(folder) else [])):
        return spark.createDataFrame([], schema)
    every = spark.read.option("mergeSchema", "true").parquet(f"{store}/{name}")
    latest = every.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("version").alias("__version")).groupBy(*(f"__{k}" for k in keys)).agg(F.max("__version").alias("__version"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return every.join(latest, same & (F.col("version") == F.col("__version"))).select([c for c in every.columns if c != "version"])


# The life of a job. Each of its files is pending, processing, completed or failed.

FILES = "job_id string, file_id string, name string, pos int, status string, attempt int, segments long, warnings long, error string"
FILE_KEYS = ["job_id", "file_id"]
#: Files that go through a plan together, and the most ids that the driver holds.
GROUP = 64


def start(files: DataFrame, store: str, job_id: str) -> None:
    """A new job over ``files`` (file_id, name, pos): all pending."""
    row = files.select(F.lit(job_id).alias("job_id"), "file_id", "name", F.col("pos").cast("int").alias("pos"), F.lit("pending").alias("status"), F.lit(0).alias("attempt"))
    save(row.withColumns({"segments": F.lit(None).cast("long"), "warnings": F.lit(None).cast("long"), "error": F.lit(None).cast("string")}), store, "files", FILE_KEYS)


def states(spark: SparkSession, store: str, job_id: str | None = None) -> DataFrame:
    found = load(spark, store, "files", FILE_KEYS, FILES)
    return found if job_id is None else found.where(F.col("job_id") == job_id)


def results(spark: SparkSession, store: str, job_id: str) -> DataFrame:
    """The rows of a job's completed files, each file's from its last finished attempt."""
    done = states(spark, store, job_id).where("status = 'completed'").select("job_id", "file_id")
    return load(spark, store, "results", FILE_KEYS).join(done, FILE_KEYS, "left_semi").drop("attempt")


def fail(spark: SparkSession, store: str, job_id: str, error: str) -> None:
    """All files of a job that are not finished fail for one reason, as when its glossary is gone."""
    rest = states(spark, store, job_id).where("status in ('pending', 'processing')")
    save(stage(rest.withColumns({"status": F.lit("failed"), "error": F.lit(error)}), "states"), store, "files", FILE_KEYS)


Read = Callable[[list[str]], DataFrame]
Step = Callable[[DataFrame, str], DataFrame]


def run(spark: SparkSession, store: str, job_id: str, read: Read, step: Step, group: int = GROUP) -> DataFrame:
    """Runs what is left of a job and returns the states of its files.

    ``read`` gives the segments of some files (file_id; a file that cannot be read is a row with its ``error``), ``step``
    their results (file_id, and ``warnings``, an array, or none); its second argument is the folder for marks of
    progress. So many files go through one plan; their results are one version and so are kept whole or not at
    all, and their states are saved after them. Where a plan fails, each half of its files goes through one of its own,
    down to the file that fails alone: that one is marked, the others finish. Run again after a stop, finished files are
    left alone, and files whose results were saved before their state are only marked.
    """
    _adopt(spark, store, job_id)
    todo = states(spark, store, job_id).where("status in ('pending', 'processing')").orderBy("pos", "file_id").select("file_id")
    ids: list[str] = []
    for row in todo.toLocalIterator():
        ids.append(row["file_id"])
        if len(ids) == group:
            _run_group(spark, store, job_id, ids, read, step)
            ids = []
    if ids:
        _run_group(spark, store, job_id, ids, read, step)
    return states(spark, store, job_id)


def _adopt(spark: SparkSession, store: str, job_id: str) -> None:
    """Files under way at a stop whose results of that attempt are there."""
    under_way = states(spark, store, job_id).where("status = 'processing'")
    if not under_way.limit(1).count():
        return
    there = load(spark, store, "results", FILE_KEYS, "job_id string, file_id string, attempt int").where(F.col("job_id") == job_id)
    found = _counted(there).join(under_way.drop("warnings"), ["job_id", "file_id", "attempt"]).withColumn("status", F.lit("completed"))
    save(stage(found.select(*_names(FILES)), "states"), store, "files", FILE_KEYS)


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _counted(rows: DataFrame) -> DataFrame:
    told = F.sum(F.coalesce(F.size("warnings"), F.lit(0))) if "warnings" in rows.columns else F.lit(0)
    return rows.groupBy("job_id", "file_id", "attempt").agg(told.cast("long").alias("warnings"))


def _run_group(spark: SparkSession, store: str, job_id: str, ids: list[str], read: Read, step: Step, begun_before: bool = False) -> None:
    chosen = spark.createDataFrame([(i,) for i in ids], "file_id string")
    own = stage(states(spark, store, job_id).join(chosen, "file_id", "left_semi").withColumn("attempt", F.col("attempt") + int(not begun_before)), "states")
    columns = _names(FILES)
    try:
        rows = stage(read(ids), "segments")
        broken = rows.where("error is not null").groupBy("file_id").agg(F.first("error").alias("__error")) if "error" in rows.columns else spark.createDataFrame([], "file_id string, __error string")
        good = rows.where("error is null").drop("error") if "error" in rows.columns else rows
        sizes = good.groupBy("file_id").agg(F.count("*").alias("segments"))
        begun = stage(own.drop("segments").join(sizes, "file_id", "left").withColumn("segments", F.coalesce("segments", F.lit(0))).withColumn("status", F.lit("processing")).select(columns), "states")
        save(begun, store, "files", FILE_KEYS)
        done = step(good, marks(store, job_id))
        attempts = begun.select("file_id", "job_id", "attempt")
        save(done.drop("job_id", "attempt").join(F.broadcast(attempts), "file_id"), store, "results", FILE_KEYS)
        saved = load(spark, store, "results", FILE_KEYS).join(F.broadcast(attempts), ["job_id", "file_id", "attempt"], "left_semi")
        counts = _counted(saved).select("file_id", F.col("warnings").alias("__warnings"))
        ended = begun.join(counts, "file_id", "left").join(broken, "file_id", "left")
        ended = ended.withColumns({"status": F.when(F.col("__error").isNull(), "completed").otherwise("failed"), "warnings": F.coalesce("__warnings", F.lit(0)), "error": F.col("__error")})
        save(stage(ended.select(columns), "states"), store, "files", FILE_KEYS)
    except Exception as error:
        if spark.sparkContext._jsc.sc().isStopped():
            raise
        if len(ids) == 1:
            own = states(spark, store, job_id).join(chosen, "file_id", "left_semi")  # with its attempt, if it had begun
            told = str(error).partition("\n")[0][:500] or type(error).__name__
            save(stage(own.withColumns({"status": F.lit("failed"), "error": F.lit(told)}).select(columns), "states"), store, "files", FILE_KEYS)
            return
        half = len(ids) // 2
        for some in (ids[:half], ids[half:]):
            _run_group(spark, store, job_id, some, read, step, True)


def status(files: DataFrame) -> DataFrame:
    """Each job's status of ``files`` (``FILES``) and its counts: pending until a file has begun, processing until all are
    finished, then failed if none was completed, else completed."""
    count = lambda s: F.count_if(F.col("status") == s)
    found = files.groupBy("job_id").agg(F.count("*").alias("files"), *(count(s).alias(s) for s in ("pending", "processing", "completed", "failed")), F.sum(F.coalesce("warnings", F.lit(0))).alias("warnings"))
    state = F.when(F.col("pending") == F.col("files"), "pending").when(F.col("pending") + F.col("processing") > 0, "processing").when(F.col("completed") == 0, "failed").otherwise("completed")
    return found.withColumn("status", state)


# Progress while a job runs.

MARKS = "file_id string, n long"


def marks(store: str, job_id: str) -> str:
    return f"{store}/progress/{job_id}"


def mark(path: str, name: str, counts: dict[str, int]) -> None:
    """Called by a task: how many segments of each file it has just done. The name is of the rows, not of the attempt, so
    a task that runs again writes the same marks over."""
    system, folder = file_system(path)
    system.create_dir(folder, recursive=True)
    with system.open_output_stream(f"{folder}/{name}.json") as out:
        out.write("".join(json.dumps({"file_id": f, "n": n}) + "\n" for f, n in counts.items()).encode())


def live_progress(spark: SparkSession, store: str, job_id: str) -> DataFrame:
    """(file_id, status, segments, done, fraction) of a job, also while it runs: completed files are 1, others at most 0.99."""
    system, folder = _folder(spark, marks(store, job_id))
    told = spark.read.schema(MARKS).json(marks(store, job_id)) if system.exists(folder) else spark.createDataFrame([], MARKS)
    done = told.groupBy("file_id").agg(F.sum("n").alias("n"))
    share = F.when(F.col("status") == "completed", 1.0).when(F.col("segments") > 0, F.least(F.col("n") / F.col("segments"), F.lit(0.99))).otherwise(0.0)
    found = states(spark, store, job_id).join(done, "file_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return found.select("file_id", "status", "segments", F.when(F.col("status") == "completed", F.col("segments")).otherwise(F.least("n", "segments")).alias("done"), share.alias("fraction"))
