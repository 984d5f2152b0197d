"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that end a word in the whitespace-word contracts: space and U+0009 to U+000D. ``bytes.split()``
#: without an argument splits on exactly these, and ``bytes.lower()`` folds exactly A-Z.
SPACES = r"[\x20\x09-\x0D]+"


#: Rows, and bytes, of a batch that an operator looks at together: it holds them several times over.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Without one, a temporary folder if all runs on this machine, else an error."""
    named = spark.conf.get("spark.checkpoint.dir", "")
    if named:
        return named
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
    return tempfile.mkdtemp(prefix="sylvan-")


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def _lean() -> None:
    """From now on arrays of 16 MB or more have pages of their own, which go back as soon as they are freed; the heap shrinks in steps of 64 MB."""
    _LIBC.mallopt(_MMAP_THRESHOLD, 16 << 20)
    _LIBC.mallopt(_TRIM_THRESHOLD, 64 << 20)


def _tidy() -> None:
    """Give freed memory back to the system, so that a worker that waits for its next task holds little."""
    pa.default_memory_pool().release_unused()
    _LIBC.malloc_trim(0)


#: glibc's names for the size from which an array has pages of its own, and for the free top of the heap that goes back at once.
_MMAP_THRESHOLD, _TRIM_THRESHOLD = -3, -1


class _NoLibc:
    """Where the C library isn't the GNU one, memory is left to its own rules."""

    def mallopt(self, *_: int) -> None: ...

    def malloc_trim(self, *_: int) -> None: ...


try:
    _LIBC = ctypes.CDLL("libc.so.6")
except OSError:
    _LIBC = _NoLibc()


def arrow_map(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` in batches of bounded size, whose workers give large arrays back to the system as soon as they are freed, and the rest at a task's end."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, min(BATCH_ROWS, batch.num_rows * BATCH_BYTES // max(BATCH_BYTES, batch.nbytes)))
            for at in range(0, batch.num_rows, step):
                yield batch.slice(at, step)

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _lean()
        try:
            yield from run(cut(batches))
        finally:
            _tidy()

    return rows.mapInArrow(lean, schema)


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding."""
    return column.cast(pa.large_binary()).to_pylist()


def word_starts(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the first byte of each word, and of the byte after it, in the words joined by single spaces."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    return ends - lengths, ends


def doc_crc(doc_id) -> F.Column:
    """crc32 of the doc_id written as text; a null id counts as the empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary"))


def packed_mask(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Boolean array of n places; True where one of the windows [start, start + width) lies."""
    edge = np.zeros(n + 1, np.int64)
    if len(starts):
        np.add.at(edge, starts, 1)
        np.add.at(edge, np.minimum(starts + width, n), -1)
    return np.cumsum(edge[:-1]) > 0


def written(df: DataFrame) -> DataFrame:
    """Write a table as Parquet into the shared checkpoint folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/sylvan-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def plain_names(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The table with its columns named c0, c1 and so on, which clash with no name that an operator makes; and the new name of each old one."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def row_hash(df: DataFrame) -> F.Column:
    """64-bit hash of all columns of a row, whatever their names; with the row's id it names the row, and equal rows share a name."""
    comparable = lambda c, kind: F.to_json(F.struct(F.array_sort(F.map_entries(c)))) if kind == "map" else c
    return F.xxhash64(*[comparable(F.col(f"`{f.name}`"), f.dataType.typeName()) for f in df.schema.fields])


def attach(docs: DataFrame, decided: DataFrame, doc_id: str, value: str | None = None) -> DataFrame:
    """Rows of docs that ``decided`` names, with its value, if asked for, as last column; one row for each name, so equal rows become one.

    decided: ``__id``, ``__hash``, ``__rows`` (how many rows of docs have the name) and the value. Only names with several rows
    are made distinct; the others pass a plain join.
    """
    plain, names = plain_names(docs)
    decided = decided.select("__id", F.col("__hash").alias("__name"), "__rows", (F.col(value) if value else F.lit(None)).alias("__value"))
    hit = plain.withColumn("__hash", row_hash(plain)).join(decided, F.col(names[doc_id]).eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__name")))
    several = hit.where("__rows > 1").dropDuplicates(["__id", "__hash"])
    found = hit.where("__rows = 1").unionByName(several)
    return found.select(*names.values(), "__value").toDF(*names, value) if value else found.select(*names.values()).toDF(*names)
