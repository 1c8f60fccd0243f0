"""Lives of glossaries over a stream of uses that comes in files, in and out of order."""

from datetime import datetime, timedelta

from parasift.streaming.expiry import expiries

BEGIN = datetime(2024, 1, 1)


def at(days, **more):
    return BEGIN + timedelta(days=days, **more)


def ended(spark, folder, batches, **more):
    (folder / "in").mkdir()
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, "glossary_id string, used_at timestamp").coalesce(1).write.mode("append").parquet(f"{folder}/in/{n:02d}")
    uses = spark.readStream.schema("glossary_id string, used_at timestamp").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{folder}/in/*")
    done = expiries(uses, **more).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    done.awaitTermination(120)
    assert done.exception() is None
    return sorted((str(r.glossary_id), r.last_used, r.expired_at) for r in spark.read.schema("glossary_id string, last_used timestamp, expired_at timestamp").parquet(f"{folder}/out").collect())


def test_lives_end_after_seven_days_without_a_use(spark, tmp_path):
    batches = [
        [("a", at(0)), ("b", at(0)), ("c", at(0)), (None, at(0)), ("a", None)],
        [("b", at(6)), ("b", at(3)), ("c", at(7))],  # exactly seven days: still alive
        [("x", at(8))],  # a and the one without a name are past their time
        [("a", at(9)), ("b", at(13, seconds=1)), ("b", at(13, seconds=1))],  # a begins anew; b's first life has ended
        [("d", at(1))],  # too late to count
        [("x", at(20, hours=2))],
    ]
    week = timedelta(days=7)
    want = [("None", at(0)), ("a", at(0)), ("a", at(9)), ("b", at(6)), ("b", at(13, seconds=1)), ("c", at(7)), ("x", at(8))]
    assert ended(spark, tmp_path, batches) == sorted((k, t, t + week) for k, t in want)


def test_two_lives_in_one_batch(spark, tmp_path):
    found = ended(spark, tmp_path, [[("a", at(30)), ("a", at(0)), ("a", at(2)), ("b", at(31))], [("z", at(32))]], days=5, delay="0 seconds")
    assert found == [("a", at(2), at(7))]


def test_no_use_is_handed_to_python(spark):
    uses = spark.readStream.format("rate").load().selectExpr("cast(value as string) AS glossary_id", "timestamp AS used_at")
    plan = expiries(uses)._jdf.queryExecution().analyzed().toString()
    assert "session_window" in plan and "Pandas" not in plan and "Python" not in plan
