"""Pages as they arrive: parsing is a stateless map, so streams need neither state nor watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.pages import html_events, parse_html, run


def page_stream(spark: SparkSession, path: str, schema: str = "page_id bigint, url string, html string", files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of pages in a folder, as they are added."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def stream_nodes(pages: DataFrame, **options) -> DataFrame:
    return parse_html(pages, **options)


def stream_events(pages: DataFrame, **options) -> DataFrame:
    return html_events(pages, **options)


def stream_output(pages: DataFrame, **options) -> DataFrame:
    return run(pages, **options)


def write_stream(frame: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append to Parquet; with ``once`` all that is there now, then stop."""
    writer = frame.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
