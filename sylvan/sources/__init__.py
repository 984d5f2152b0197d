"""Page tables from files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import decode_html
from ..html.dom import Node
from ..html.rows import NodeColumns
from ..schema import NODES


def materialize(table: DataFrame) -> DataFrame:
    """A table written once, as Parquet in the folder that the cluster shares (spark.checkpoint.dir), for queries that read it several times."""
    spark = table.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if not folder:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="sylvan-")
    path = f"{folder}/table-{uuid.uuid4().hex}"
    table.write.parquet(path)
    return spark.read.parquet(path)


def pages_from_parquet(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """A Parquet table of pages. Few large files make few tasks, so pages are dealt out again if ``partitions`` says so."""
    pages = spark.read.parquet(path)
    return pages.repartition(partitions) if partitions else pages


def pages_from_files(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """Files of HTML bytes: ``page_id`` (a hash of the path), ``url`` (the path), ``html``, ``encoding``.

    ``encoding`` is what a server would have declared; a byte-order mark goes before it, and without either the meta elements count.
    """
    files = spark.read.format("binaryFile").load(path)
    got = decode_html(F.col("content"), F.lit(encoding).cast("string"))
    return files.select(F.xxhash64("path").alias("page_id"), F.col("path").alias("url"), got.alias("d")).select("page_id", "url", "d.html", "d.encoding")


def pages_from_text(spark: SparkSession, path: str) -> DataFrame:
    """UTF-8 files, one page each."""
    return spark.read.text(path, wholetext=True).select(F.xxhash64(F.input_file_name()).alias("page_id"), F.input_file_name().alias("url"), F.col("value").alias("html"))


def nodes_from_trees(spark: SparkSession, trees: dict[int, Node]) -> DataFrame:
    """The node table of trees built by hand (see sylvan.html.builder), by page id."""
    made = NodeColumns()
    for key, root in trees.items():
        made.add(key, root)
    import pyarrow as pa

    return spark.createDataFrame(made.batch("page_id", pa.int64()).to_pylist(), f"page_id bigint, {NODES}")
