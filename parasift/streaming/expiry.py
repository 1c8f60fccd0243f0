"""A glossary's sliding time to live over the stream of its uses."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parasift.operators.glossary import TTL_DAYS

SCHEMA = "glossary_id string, last_used timestamp, expired_at timestamp"


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams started within keep their state in RocksDB, so it may be larger than the executors' heaps."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def expiries(uses: DataFrame, days: int = TTL_DAYS, delay: str = "1 hour") -> DataFrame:
    """(``glossary_id``, ``last_used``, ``expired_at``) of each life of a glossary that ended, from the stream ``uses``
    (glossary_id, used_at): no use for ``days`` days after its last.

    A life is a session of uses: Spark's state keeps the first and last time of each life, merges lives that a use
    between them joins, and lets one go once the stream is past its end by ``delay``; no use is handed to Python. Until
    then uses may come in any order, and a life ends only where two of them are over ``days`` days apart. Later ones
    are dropped. A use after the end begins a new life. Null ids are one glossary; null times are no uses; repeated uses
    count once. A session ends a microsecond after its last day, so that one that ends with the stream's last use is
    kept; a use that is late by that microsecond alone still counts.
    """
    own = uses.where("used_at is not null").select("glossary_id", "used_at").withWatermark("used_at", delay)
    # Late uses are told by their own time here; a session's test is its end. A use is kept until the stream is past it.
    own = own.dropDuplicates(["glossary_id", "used_at"])
    life = F.session_window("used_at", f"{days} days 1 microsecond")
    ended = own.groupBy("glossary_id", life).agg(F.max("used_at").alias("last_used"))
    return ended.select("glossary_id", "last_used", (F.col("last_used") + F.expr(f"INTERVAL '{days}' DAY")).alias("expired_at"))
