"""Packed exchanges: many small entries travel as few binary rows, dealt by slice, and are met slice by slice as a stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame

from .common import arrow_map

PACKET = "slice int, payload binary"


def pack(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays (as raw bytes) behind a header of their sizes, compressed."""
    parts = [a if isinstance(a, bytes) else np.ascontiguousarray(a).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(np.array([len(parts), *map(len, parts)], np.int64).tobytes() + b"".join(parts))


def unpack(payload: bytes, *kinds: str) -> list:
    raw = zstandard.ZstdDecompressor().decompress(payload)
    sizes, at, out = np.frombuffer(raw, np.int64, len(kinds), 8), 8 * (len(kinds) + 1), []
    for kind, n in zip(kinds, sizes.tolist(), strict=True):
        out.append(raw[at : at + n] if kind == "bytes" else np.frombuffer(raw, kind, n // np.dtype(kind).itemsize, at))
        at += n
    return out


def packets(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["slice", "payload"])


def by_slice(sent: DataFrame, merge: Callable[[int, Iterator[bytes]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Run ``merge(slice, payloads)`` once for each slice of a packet table; payloads arrive as a stream, in no given order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flow = ((s, p) for b in batches for s, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        held = next(flow, None)
        while held is not None:
            now = held[0]

            def of_slice() -> Iterator[bytes]:
                nonlocal held
                while held is not None and held[0] == now:
                    payload = held[1]
                    yield payload
                    held = next(flow, None)

            stream = of_slice()
            yield from merge(now, stream)
            for _ in stream:
                pass

    return arrow_map(sent.repartition("slice").sortWithinPartitions("slice"), run, schema)


FILTER_SLICE = 1 << 20


def key_filter(keys: DataFrame, rows: int, most: int = 26) -> tuple[np.ndarray, int]:
    """Bits set for the binary keys of a one-column table, and the logarithm of their number: 8 for each of ``rows``, 2**most at most.

    A key whose bit isn't set isn't in the table; some others pass as well. The driver gets the bits, whose size is bounded.
    """
    width = min(most, max(20, int(8 * max(1, rows) - 1).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [key_places(batch.column(0).to_pylist(), width) for batch in batches]
        at = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
        for s in np.unique(at // FILTER_SLICE).tolist():
            bits = np.zeros(FILTER_SLICE, bool)
            bits[at[at // FILTER_SLICE == s] - s * FILTER_SLICE] = True
            yield packets([(s, pack(np.packbits(bits)))])

    out = np.zeros((1 << width) // 8, np.uint8)
    for s, payload in by_slice(arrow_map(keys, run, PACKET), _either, PACKET).toLocalIterator():
        out[s * FILTER_SLICE // 8 : (s + 1) * FILTER_SLICE // 8] = unpack(bytes(payload), "u1")[0]
    return out, width


def _either(number: int, payloads: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(FILTER_SLICE // 8, np.uint8)
    for p in payloads:
        bits |= unpack(p, "u1")[0]
    yield packets([(number, pack(bits))])


def key_places(keys: list[bytes], width: int) -> np.ndarray:
    return (np.frombuffer(b"".join(k[:8] for k in keys), ">u8") >> np.uint64(64 - width)).astype(np.int64)


def maybe_in(bits: np.ndarray, width: int, keys: list[bytes]) -> np.ndarray:
    at = key_places(keys, width)
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def sift(rows: DataFrame, key: str, keys: DataFrame, n_rows: int) -> tuple[DataFrame, DataFrame]:
    """Rows whose binary key may be in ``keys``, and the rows whose key isn't: only the former need to travel to a join."""
    sent = rows.sparkSession.sparkContext.broadcast(key_filter(keys, n_rows))
    at = rows.columns.index(key)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def half(wanted: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield batch.filter(pa.array(maybe_in(*sent.value, batch.column(at).to_pylist()) == wanted))

        return run

    return arrow_map(rows, half(True), schema), arrow_map(rows, half(False), schema)


def block_slice(uid: int) -> int:
    """Slice by which what belongs to a block of a task meets again."""
    return uid & 0x7FFFFFFF


def block_uid(partition: int, block: int) -> int:
    return xxhash.xxh64_intdigest(f"{partition}:{block}") >> 1


def head_packet(uid: int, names: np.ndarray, owner: np.ndarray, mark: np.ndarray) -> tuple[int, bytes]:
    """What a block knows itself: the names (16 bytes) of its texts, and marks of some. Goes past the judges of the slices, as slice below 0."""
    return -1 - (uid & 1023), pack(np.array([uid, 1], np.int64), names, owner.astype(np.int32), mark.astype(np.int64))


def mark_packets(uids: np.ndarray, owner: np.ndarray, mark: np.ndarray) -> Iterator[pa.RecordBatch]:
    """What a slice's judge found, block by block: marks of texts, each named by its number in the block."""
    if not len(uids):
        return
    order = np.argsort(uids, kind="stable")
    uids, owner, mark = uids[order], owner[order], mark[order]
    first, out = np.flatnonzero(np.concatenate(([True], uids[1:] != uids[:-1]))), []
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(uids)], strict=True):
        uid = int(uids[a])
        out.append((block_slice(uid), pack(np.array([uid, 0], np.int64), b"", owner[a:b].astype(np.int32), mark[a:b].astype(np.int64))))
    yield packets(out)


def past(payloads: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    """Head packets on their way to their blocks."""
    for p in payloads:
        yield packets([(block_slice(int(unpack(p, "i8", "bytes", "i4", "i8")[0][0])), p)])


def gathered(number: int, payloads: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    """``key, marks`` of each text of a block that has marks, each mark once: what the block knew and what the slices' judges found."""
    names: dict[int, np.ndarray] = {}
    marks: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for p in payloads:
        (uid, is_head), raw, owner, mark = unpack(p, "i8", "bytes", "i4", "i8")
        if is_head:
            names[int(uid)] = np.frombuffer(raw, "V16")
        marks.setdefault(int(uid), []).append((owner, mark))
    for uid, parts in marks.items():
        owner, mark = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((mark, owner))
        owner, mark = owner[order], mark[order]
        fresh = np.concatenate(([True], (owner[1:] != owner[:-1]) | (mark[1:] != mark[:-1]))) if len(owner) else np.empty(0, bool)
        owner, mark = owner[fresh], mark[fresh]
        first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if len(owner) else np.empty(0, np.int64)
        ends = [*first[1:].tolist(), len(owner)]
        for i in range(0, len(first), 5_000):
            cut = list(zip(first[i : i + 5_000].tolist(), ends[i : i + 5_000], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([names[uid][owner[a]].tobytes() for a, _ in cut], pa.binary()), pa.array([mark[a:b].tobytes() for a, b in cut], pa.binary())], ["key", "marks"])
