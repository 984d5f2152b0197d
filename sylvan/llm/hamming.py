"""Exact top-k search in Hamming space by incremental multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map
from .packets import pack, unpack

#: Candidates looked at together; bounds the memory of a round.
CHUNK = 1 << 20
FAR = np.int64(1 << 40)


def sign_code(vector: str) -> F.Column:
    """Binary code of a vector, as a string of 0 and 1: a bit is 1 where the component is above 0. Null stays null."""
    return F.array_join(F.transform(F.col(vector), lambda x: F.when(x > 0, "1").otherwise("0")), "")


def _pack(codes: list[str], words: int) -> np.ndarray:
    raw = np.zeros((len(codes), words * 64), np.uint8)
    for i, c in enumerate(codes):
        raw[i, : len(c)] = np.frombuffer(c.encode(), np.uint8) - 48
    return raw


class MultiIndex:
    """Segment tables over one block of codes (an n x bits array of 0 and 1). Rows are in order of preference among equal distances."""

    def __init__(self, bits: np.ndarray, segment: int) -> None:
        self.n, width = bits.shape
        count = max(1, -(-width // segment))
        edges = [round(i * width / count) for i in range(count + 1)]
        self.spans = list(zip(edges, edges[1:], strict=False))
        self.packed = np.packbits(bits, axis=1)
        self.order, self.starts = [], []
        for a, b in self.spans:
            values = self.values(bits, a, b)
            order = np.argsort(values, kind="stable")
            self.order.append(order)
            self.starts.append(np.searchsorted(values[order], np.arange((1 << (b - a)) + 1)))

    @staticmethod
    def values(bits: np.ndarray, a: int, b: int) -> np.ndarray:
        return bits[:, a:b].astype(np.int64) @ (1 << np.arange(b - a, dtype=np.int64)[::-1])

    def search(self, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, distances), each queries x min(k, rows): the nearest rows of each query, of equal distances the first rows.

        Round r probes every segment at radius r. After it, each code within m * (r + 1) - 1 bits has been met, m being the
        number of segments, since a code further than r in every segment differs in m * (r + 1) bits at least. A query is done
        when its kth verified distance is within that bound: then all rows of that distance have been met as well.
        """
        want, m = min(k, self.n), len(self.spans)
        rows, far = np.full((len(queries), want), -1, np.int64), np.full((len(queries), want), FAR)
        packed, values = np.packbits(queries, axis=1), [self.values(queries, a, b) for a, b in self.spans]
        active, radius = np.arange(len(queries) if want else 0), 0
        while len(active):
            for group in self._groups(active, values, radius):
                self._round(group, values, packed, radius, rows, far)
            active, radius = active[far[active, -1] > m * (radius + 1) - 1], radius + 1
        return rows, far

    def _flips(self, width: int, radius: int) -> np.ndarray:
        return np.fromiter((sum(1 << i for i in c) for c in combinations(range(width), radius)), np.int64, comb(width, radius))

    def _groups(self, active: np.ndarray, values: list[np.ndarray], radius: int) -> Iterator[np.ndarray]:
        """Queries that together probe buckets of about CHUNK rows at most; a query is never cut, as it meets each row once for each segment at most."""
        probes = sum(comb(b - a, radius) for a, b in self.spans)
        for i in range(0, len(active), step := max(1, CHUNK // max(1, probes))):
            part = active[i : i + step]
            size = np.zeros(len(part), np.int64)
            for (a, b), starts, value in zip(self.spans, self.starts, values, strict=True):
                at = value[part][:, None] ^ self._flips(b - a, radius)[None, :]
                size += (starts[at + 1] - starts[at]).sum(axis=1)
            block = np.cumsum(size) // CHUNK
            yield from np.split(part, np.flatnonzero(block[1:] != block[:-1]) + 1)

    def _round(self, group: np.ndarray, values: list[np.ndarray], packed: np.ndarray, radius: int, rows: np.ndarray, far: np.ndarray) -> None:
        """Meet the buckets of one radius, verify, and keep the best of each query of a group."""
        found, owners = [], []
        for (a, b), order, starts, value in zip(self.spans, self.order, self.starts, values, strict=True):
            flips = self._flips(b - a, radius)
            probes = (value[group][:, None] ^ flips[None, :]).ravel()
            size = starts[probes + 1] - starts[probes]
            hit = np.flatnonzero(size)
            size, first = size[hit], starts[probes[hit]]
            found.append(order[np.repeat(first - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())])
            owners.append(np.repeat(hit // max(1, len(flips)), size))
        pair = np.unique(np.concatenate(owners) * self.n + np.concatenate(found))
        owner, row = pair // self.n, pair % self.n
        distance = np.empty(len(row), np.int64)
        for i in range(0, len(row), CHUNK):
            distance[i : i + CHUNK] = np.bitwise_count(self.packed[row[i : i + CHUNK]] ^ packed[group[owner[i : i + CHUNK]]]).sum(axis=1, dtype=np.int64)
        have = np.repeat(np.arange(len(group)), far.shape[1])
        owner, row, distance = np.concatenate((have, owner)), np.concatenate((rows[group].ravel(), row)), np.concatenate((far[group].ravel(), distance))
        order = np.lexsort((row, distance, owner))
        owner, row, distance = owner[order], row[order], distance[order]
        fresh = np.concatenate(([True], (owner[1:] != owner[:-1]) | (row[1:] != row[:-1]) | (row[1:] < 0)))  # a row may come again at another radius
        owner, row, distance = owner[fresh], row[fresh], distance[fresh]
        place = np.arange(len(owner)) - np.searchsorted(owner, owner)
        best = place < far.shape[1]
        rows[group[owner[best]], place[best]], far[group[owner[best]], place[best]] = row[best], distance[best]


def top_k(codes: DataFrame, queries: DataFrame, k: int = 10, row_id: str = "id", query_id: str = "id", code: str = "code", segment: int = 12, query_block: int = 2048, rows_per_index: int = 250_000) -> DataFrame:
    """``query_id, neighbor_id, distance, rank``: for each query its k rows at the smallest (distance, id), a row itself included.

    ``code`` is a string of 0 and 1. The rows are dealt into index blocks once; blocks of queries go to every one of them, and
    each answers with its k best rows, by growing radii; the answers are merged. A block holds its index and one block of
    queries at a time; of rows with one code it keeps the k smallest ids, as no other can be among the best k. Neither the plan nor
    the driver grows with the queries.

    Null codes and codes of another length than the query's are not met; a query with a null code or id gives no row, a query id
    that is repeated counts once; repeated ids of rows stay and take a rank each; fewer than k rows give as many ranks; empty
    tables give none.
    """
    typed = codes.select(F.col(f"`{row_id}`").cast("bigint").alias("id"), F.col(f"`{code}`").alias("code")).where("code is not null and code <> ''")
    asked = queries.select(F.col(f"`{query_id}`").cast("bigint").alias("id"), F.col(f"`{code}`").alias("code")).where("code is not null and code <> '' and id is not null")
    asked = asked.groupBy("id").agg(F.min("code").alias("code"))
    n_rows = typed.count()
    shards = max(1, -(-n_rows // rows_per_index), min(int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_rows // 4000))
    rows = arrow_map(typed, _packed(shards, 1 << 30), "shard int, kind int, payload binary")
    blocks = arrow_map(asked, _packed(1, query_block), "shard int, kind int, payload binary").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    met = rows.unionByName(blocks).repartition(shards, "shard").sortWithinPartitions("shard", "kind")
    merged = arrow_map(met, _answer(k, segment), "query_id bigint, neighbor_id bigint, distance int")
    best = Window.partitionBy("query_id").orderBy("distance", F.col("neighbor_id").asc_nulls_last())
    return merged.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _packed(shards: int, most: int):
    """Packets of (code length, ids, which ids are null, codes as bits): kind 0 dealt to ``shards``, kind 1 (with one shard) of ``most`` rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, codes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            parts: dict[tuple[int, int], list[int]] = {}
            for i, (name, text) in enumerate(zip(ids, codes, strict=True)):
                parts.setdefault((xxhash.xxh32_intdigest(f"{name}:{text}") % shards, len(text)), []).append(i)
            out = []
            for (shard, width), at in parts.items():
                for a in range(0, len(at), most):
                    mine = at[a : a + most]
                    bits = np.packbits(_pack([codes[i] for i in mine], -(-width // 64)), axis=1)
                    null = np.array([ids[i] is None for i in mine])
                    out.append((shard, pack(np.array([width], np.int64), np.array([0 if ids[i] is None else ids[i] for i in mine], np.int64), null, bits)))
            kind = int(most < 1 << 30)
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.int32()), pa.array([kind] * len(out), pa.int32()), pa.array([p for _, p in out], pa.binary())], ["shard", "kind", "payload"])

    return run


def _read(payload: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    (width,), ids, null, raw = unpack(payload, "i8", "i8", "?", "u1")
    return int(width), ids, null, raw.reshape(len(ids), -1)


def _index(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], width: int, k: int, segment: int) -> tuple[MultiIndex, np.ndarray, np.ndarray]:
    """An index over rows in order of (null last, id), of each code the first k rows."""
    ids, null, raw = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((ids, null))
    ids, null, raw = ids[order], null[order], raw[order]
    _, code = np.unique(raw.view(f"V{raw.shape[1]}").ravel(), return_inverse=True)
    by = np.argsort(code, kind="stable")
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by)) - np.searchsorted(code[by], code[by])
    keep = place < k
    return MultiIndex(np.unpackbits(raw[keep], axis=1)[:, :width], segment), ids[keep], null[keep]


def _answer(k: int, segment: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, built = None, {}, {}
        for batch in batches:
            for shard, kind, payload in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if shard != now:
                    now, parts, built = shard, {}, {}
                width, names, null, raw = _read(payload)
                if kind == 0:
                    parts.setdefault(width, []).append((names, null, raw))
                    continue
                if width in parts:
                    built[width] = _index(parts.pop(width), width, k, segment)
                if width not in built:
                    continue
                index, ids, missing = built[width]
                rows, far = index.search(np.unpackbits(raw, axis=1)[:, :width], k)
                neighbor = pa.array(ids[rows.ravel()], pa.int64(), mask=missing[rows.ravel()])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, rows.shape[1]), pa.int64()), neighbor, pa.array(far.ravel().astype(np.int32), pa.int32())], ["query_id", "neighbor_id", "distance"])

    return run
