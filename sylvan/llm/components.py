"""Connected components of a graph held as an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, durable


#: Edges that one task joins by itself; more are joined by rounds over all machines.
TOGETHER = 1 << 18


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges of a small graph to (node, smallest reachable node)."""
    ends = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches]
    if not ends:
        return
    nodes, at = np.unique(np.concatenate(ends, axis=1), return_inverse=True)
    root = list(range(len(nodes)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for a, b in at.reshape(2, -1).T.tolist():
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)  # nodes are in order, so the smallest becomes the root
    found = nodes[[find(i) for i in range(len(nodes))]]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(found, pa.int64())], ["node", "root"])


def connected_components(edges: DataFrame, source: str = "u", target: str = "v", together: int = TOGETHER) -> DataFrame:
    """Smallest reachable node of every node that has an edge: columns ``node``, ``root`` (both bigint).

    A graph of ``together`` edges at most, a bound of few MB, is joined in one task. A larger one alternates large-star and small-star steps. A node's neighbours are never gathered into one row: minima are partial
    aggregates and return by a join, which adaptive execution splits for hub nodes. Only a count and a checksum of the edge
    set reach the driver. Self loops, repeated edges and rows with a null end have no effect; an empty table gives an empty one.
    """
    now = edges.select(F.greatest(source, target).alias("u"), F.least(source, target).alias("v"))
    now = durable(now.where("u <> v").distinct())
    if now.count() <= together:
        return durable(arrow_map(now.coalesce(1), _joined, "node bigint, root bigint"))
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        now = durable(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def pairs_across(named: DataFrame, columns: list[str], within: Column | None = None, about: DataFrame | None = None, few: int = 0) -> DataFrame:
    """Pairs of members of one bucket that belong to different groups: columns ``a_*`` and ``b_*`` of ``node``, ``root`` and ``columns``.

    ``named`` has key, node, root and ``columns``. Members of a bucket's largest group meet only those outside it, so that a dense
    bucket with an outsider gives as many rows as it has members, and not their square. ``within`` may give an array of narrower
    keys of a row, of which two members share one at least if they are to be paired; buckets with ``few`` members outside the largest
    group at most do without them, as whole pairs are fewer there than narrower keys. ``about`` has more columns of a ``node``, which
    only members of buckets with several groups are given.
    """
    sizes = named.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count(F.lit(1)).alias("groups"), (F.sum("n") - F.max("n")).alias("outside")).where("groups > 1").select("key", "main", "outside")
    open_ = named.join(largest, "key")
    on = ["key"]
    if about is not None:
        open_, columns = open_.join(about, "node"), [*columns, *(c for c in about.columns if c != "node")]
    if within is not None:
        narrow = F.when(F.col("outside") <= few, F.array(F.lit(0).cast("bigint"))).otherwise(within)
        open_, on = open_.withColumn("narrow", F.explode(narrow)), ["key", "narrow"]
    names = ["node", "root", *columns]
    rest = open_.where("root <> main").select(*on, *[F.col(c).alias(f"a_{c}") for c in names])
    other = open_.select(*on, "main", *[F.col(c).alias(f"b_{c}") for c in names])
    return rest.join(other, on).where("a_root <> b_root and (b_root = main or a_node < b_node)").drop(*on, "main")
