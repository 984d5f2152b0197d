"""Removal of repeated word windows: a count-min prefilter, then exact grouping of the windows that it estimates repeated."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sketch
from .common import arrow_map, as_bytes, durable, packed_mask, word_starts
from .packets import PACKET, block_uid, by_slice, gathered, head_packet, mark_packets, pack, packets, past, sift, unpack


def window_hashes(words: list[bytes], width: int) -> np.ndarray:
    """128-bit digests (rows of two uint64) of the windows of ``width`` words joined by single spaces."""
    if len(words) < width:
        return np.empty((0, 2), np.uint64)
    joined = b" ".join(words)
    first, last = word_starts(words)
    digest = xxhash.xxh3_128_digest
    n = len(words) - width + 1
    return np.frombuffer(b"".join([digest(joined[a:b]) for a, b in zip(first[:n].tolist(), last[width - 1 :].tolist(), strict=True)]), np.uint64).reshape(-1, 2)


def remove_repeats(docs: DataFrame, text: str = "text", width: int = 35, keep: list[str] | None = None, most_bits: int = 28, entries_per_slice: int = 500_000, cleaned: bool = False) -> DataFrame:
    """Columns ``keep``, then n_words, n_removed, kept_sha256, and with ``cleaned`` the kept words joined by single spaces.

    A word goes if a window of ``width`` words of its document that covers it has a word sequence that also starts elsewhere,
    in the same document or another. Windows are judged on the input.

    1. Every task sketches its windows; the sketches are added up. The merged sketch has 3 * 2**most_bits bits at most, whatever
       the input; fewer cells than windows let more windows pass, but a repeated window always passes.
    2. Windows that pass are grouped exactly by a 128-bit digest: first inside a task, which leaves one entry for each digest and
       task, then across tasks, dealt by digest. A digest that all documents share so makes as many entries as tasks.
    3. Starts of repeated windows return to the texts by a join on the text's MD5, which equal texts share.

    Null texts have no words; texts shorter than a window keep all; repeated rows are repeats of each other; other columns,
    whatever their names, play no part; an empty table gives an empty one.
    """
    keep = ["doc_id"] if keep is None else keep
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("__text"))
    total, n_rows = texts.agg(F.coalesce(F.sum(F.octet_length("__text")), F.lit(0)), F.count(F.lit(1))).first()
    bits = sketch.log_width(total // 6, most_bits)

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partial = sketch.Partial(bits)
        for batch in batches:
            for value in as_bytes(batch.column(0)):
                yield from partial.add(window_hashes(value.split(), width)[:, 0])
        yield from partial.flush()

    sent = spark.sparkContext.broadcast(sketch.merged(arrow_map(texts, first_pass, PACKET), bits))
    slices = max(8, total // 6 // 3 // entries_per_slice)

    def second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block(TaskContext.get().partitionId(), slices)
        for batch in batches:
            for value, key in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                hashes = window_hashes(value.split(), width)
                places = np.flatnonzero(sketch.repeated(sent.value, hashes[:, 0], bits))
                block.add(key, hashes[places], places)
                if block.n >= 700_000:
                    yield from block.flush()
        yield from block.flush()

    keyed = texts.select("__text", F.unhex(F.md5(F.col("__text").cast("binary"))).alias("__key"))
    judged = by_slice(arrow_map(keyed, second_pass, PACKET), _judge, PACKET)
    # equal texts of several blocks have equal marks, so one row of them tells all
    flags = durable(by_slice(judged, gathered, "key binary, marks binary").groupBy("key").agg(F.max("marks").alias("__starts")))
    sent.destroy()  # the checkpoint needs it no more, and workers would keep it
    # Only texts that may lose something travel to their starts; a filter of the keys, bounded in size, tells them.
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], whole.alias("__text"), F.unhex(F.md5(whole.cast("binary"))).alias("__key"))
    some, others = sift(rows, "__key", flags.select("key"), n_rows)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-2]]
    joined = some.join(flags, F.col("__key") == F.col("key"), "left").select(*rows.columns[:-1], "__starts")
    others = others.select(*rows.columns[:-1], F.lit(None).cast("binary").alias("__starts"))
    schema = ", ".join([*fields, "n_words bigint", "n_removed bigint", "kept_sha256 string", *(["kept string"] if cleaned else [])])

    def last_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, digest, kept = [], [], [], []
            for value, starts in zip(as_bytes(batch.column(len(keep))), batch.column(len(keep) + 1).to_pylist(), strict=True):
                words = value.split()
                n.append(len(words))
                if starts:
                    mask = packed_mask(np.frombuffer(starts, np.int64), width, len(words))
                    words = [words[i] for i in np.flatnonzero(~mask).tolist()]
                gone.append(n[-1] - len(words))
                left = b" ".join(words)
                digest.append(hashlib.sha256(left).hexdigest())
                if cleaned:
                    kept.append(left.decode())
            out = [*batch.columns[: len(keep)], pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string()), *([pa.array(kept, pa.string())] if cleaned else [])]
            yield pa.RecordBatch.from_arrays(out, [*keep, "n_words", "n_removed", "kept_sha256", *(["kept"] if cleaned else [])])

    return arrow_map(joined, last_pass, schema).unionByName(arrow_map(others, last_pass, schema))


class _Block:
    """Windows of some documents of a task: those repeated among them are settled, the others are dealt out with their places."""

    def __init__(self, partition: int, slices: int) -> None:
        self.partition, self.number, self.slices = partition, 0, slices
        self._clear()

    def _clear(self) -> None:
        self.keys: dict[bytes, int] = {}
        self.weight: list[int] = []
        self.parts, self.n = [], 0

    def add(self, key: bytes, hashes: np.ndarray, places: np.ndarray) -> None:
        if not len(places):
            return
        number = self.keys.setdefault(key, len(self.keys))
        if number < len(self.weight):
            self.weight[number] += 1  # an equal text is here already
            return
        self.weight.append(1)
        self.parts.append((hashes, np.full(len(places), number, np.int32), places.astype(np.int32)))
        self.n += len(places)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        hashes, owner, place = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        names, weight, uid = np.frombuffer(b"".join(self.keys), np.uint8), np.array(self.weight), block_uid(self.partition, self.number)
        self.number += 1
        self._clear()
        to = (hashes[:, 0] % np.uint64(self.slices)).astype(np.int32)
        order = np.lexsort((hashes[:, 1], hashes[:, 0], to))
        hashes, owner, place, to = hashes[order], owner[order], place[order], to[order]
        head = np.concatenate(([True], (hashes[1:] != hashes[:-1]).any(axis=1)))
        first = np.flatnonzero(head)
        many = np.repeat(np.add.reduceat(weight[owner], first) > 1, np.diff(np.concatenate((first, [len(owner)]))))
        out = [head_packet(uid, names, owner[many], place[many])]
        cuts = np.searchsorted(to, np.arange(self.slices + 1)).tolist()
        for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if a < b:
                one, known = ~many[a:b], many[a:b] & head[a:b]
                out.append((s, pack(np.array([uid], np.int64), hashes[a:b][one], owner[a:b][one], place[a:b][one], hashes[a:b][known])))
        yield packets(out)


def _judge(number: int, payloads: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    """Entries of a slice: digests met in two packets are repeated. Yields packets of starts of repeated windows, by block."""
    if number < 0:
        yield from past(payloads)
        return
    hashes, blocks, owners, places, uids = [], [], [], [], []
    for p in payloads:
        uid, h, o, w, known = unpack(p, "i8", "u8", "i4", "i4", "u8")
        hashes += [h.reshape(-1, 2), known.reshape(-1, 2)]
        blocks.append(np.full(len(o) + len(known) // 2, len(uids), np.int32))
        owners += [o, np.full(len(known) // 2, -1, np.int32)]
        places += [w, np.full(len(known) // 2, -1, np.int32)]
        uids.append(int(uid[0]))
    hashes, blocks, owners, places = (np.concatenate(x) for x in (hashes, blocks, owners, places))
    order = np.lexsort((hashes[:, 1], hashes[:, 0]))
    hashes = hashes[order]
    same = (hashes[1:] == hashes[:-1]).all(axis=1)
    chosen = order[np.concatenate((same, [False])) | np.concatenate(([False], same))]
    chosen = chosen[owners[chosen] >= 0]
    yield from mark_packets(np.array(uids, np.int64)[blocks[chosen]], owners[chosen], places[chosen])
