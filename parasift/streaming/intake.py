"""Background jobs as a stream: new documents in a folder are parsed once and appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from parasift.operators import quality
from parasift.plans import translate
from parasift.sources.docx import SEGMENTS, parse_files


def read_docx_stream(spark: SparkSession, path: str) -> DataFrame:
    """Segments of ``.docx`` files as they arrive; a broken file is one row with its ``error``."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.docx").load(path)
    return files.select("path", "content").mapInPandas(parse_files, SEGMENTS)


def run_available(segments: DataFrame, terms: dict[str, str], output: str, checkpoint: str) -> StreamingQuery:
    """Translate all that has arrived, append texts, file summaries and broken files to ``output``, and end."""

    def batch(rows: DataFrame, number: int) -> None:
        rows.where("error is not null").select("file_id", "error").write.mode("overwrite").parquet(f"{output}/broken/batch={number}")
        done = translate.translate_segments(rows.where("error is null"), terms)
        done = translate.number_document(done, ["file_id", "region"])
        done.write.mode("overwrite").parquet(f"{output}/segments/batch={number}")
        written = rows.sparkSession.read.parquet(f"{output}/segments/batch={number}")
        quality.file_summary(translate.quality_gate(written)).write.mode("overwrite").parquet(f"{output}/summary/batch={number}")

    return segments.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
