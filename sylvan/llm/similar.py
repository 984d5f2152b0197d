"""Groups of texts whose sets of word shingles are similar: SimHash links first, then an exact check that leaves no pair out.

SimHash fingerprints of the sets meet by pigeonhole blocks; pairs within the distance are verified on the whole sets and linked.
Fingerprints of pairs just similar enough differ in many bits (about 10 of 64 at 0.8), more than blocks can cover. So a
prefix-filtered join completes the links between the groups that SimHash made: all shingles have one global order. Two sets of similarity (shared / all shingles) t or more share one of the first n - ceil(t * n) + 1
shingles of each, so these are the join keys. Shingles that a sketch says occur once come first and, as nothing can meet by
them, are never sent; those that are common in a sample come last. The order decides only the cost: every candidate is
verified on the whole sets, and no pair is left out. Join keys travel packed and meet slice by slice, where those that only one
set has are dropped: without a sketch, as on very large tables, where it would be full, more of them travel, but none becomes a
row. Then more pairs are proposed too, so signatures as wide as the sets rule out nearly all that aren't similar before sets travel.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sketch
from .common import arrow_map, as_bytes, durable, row_hash
from .components import connected_components, pairs_across
from .packets import PACKET, by_slice, pack, packets, sift, unpack
from .simhash import exploded_keys, one_of_each

ODD = np.uint64(0x9E3779B97F4A7C15)
#: Texts in the sample that tells common shingles, occurrences there that make one common, and the most that are sent.
SAMPLE, COMMON, MOST = 5_000, 4, 50_000

#: Items for each cell from which a sketch of the greatest size says of nearly all that they are repeated, and isn't made.
FULL = 4

#: Bytes of a part of a batch whose shingle sets are held together.
SET_BYTES = 1 << 20


class _Words(dict):
    """Word to hash; a cache of bounded size."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word, 42)
        return value


def shingle_set(text: bytes | None, k: int, words: dict | None = None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; words as in ``simhash.fingerprint``, a text without words gives one 0."""
    split = text.lower().split() if text else []
    if not split:
        return np.zeros(1, np.uint64)
    h = np.fromiter(map((_Words() if words is None else words).__getitem__, split), np.uint64, len(split))
    k = min(k, len(h))
    n = len(h) - k + 1
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = ((out ^ (out >> np.uint64(32))) * ODD) + h[j : j + n]
    out = (out ^ (out >> np.uint64(31))) * ODD
    return np.unique(out ^ (out >> np.uint64(29)))


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared >= similarity * (len(a) + len(b) - shared) - 1e-9


def _sets(batches: Iterator[pa.RecordBatch], at: int, shingle: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Parts of the batches with their shingle sets; a part has few bytes, as the sets and what is made of them are many times its size."""
    words = _Words()
    for batch in batches:
        step = max(1, batch.num_rows * SET_BYTES // max(SET_BYTES, batch.nbytes))
        for begin in range(0, batch.num_rows, step):
            part = batch.slice(begin, step)
            yield part, [shingle_set(x, shingle, words) for x in as_bytes(part.column(at))]


def _name(values: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(values.tobytes(), 42)


def _signed(values: list[int] | np.ndarray) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def set_fingerprint(values: np.ndarray) -> int:
    """64-bit SimHash of a set of shingle hashes: a bit is 1 if it is set in over half of them; of the text without words, 0."""
    ones = np.unpackbits(values.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(values)).tobytes(), "big")


#: Words of 64 bits of a set's parity signature.
PARITY = 4


def parity(values: np.ndarray) -> np.ndarray:
    """Bits that say of each of 64 * PARITY classes of shingles whether a set has an odd number of them.

    Two sets that differ in d shingles have signatures that differ in d bits at most, so many different bits rule a pair out.
    """
    return np.packbits(np.bincount((values >> np.uint64(17)).astype(np.int64) % (64 * PARITY), minlength=64 * PARITY) & 1 == 1).view(">i8").astype(np.int64)


def wide_parity(values: np.ndarray) -> bytes:
    """The same over as many classes as a set has shingles at least, a power of two: sets of any size that share little differ in many bits."""
    width = max(64, 1 << (len(values) - 1).bit_length())
    at = ((values >> np.uint64(17)) & np.uint64(width - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=width) & 1 == 1).tobytes()


def bits_apart(a: bytes, b: bytes) -> int:
    """Different bits of two wide signatures; the halves of the longer one are merged until both have the same classes."""
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def named_sets(docs: DataFrame, doc_id: str, text: str, shingle: int) -> DataFrame:
    """``__id, __hash, sid, n, fp, q0 ..., wide`` of every row: the name, size, fingerprint and parity signatures of its shingle set."""
    named = docs.select(F.col(f"`{doc_id}`").alias("__id"), row_hash(docs).alias("__hash"), F.col(f"`{text}`").cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _sets(batches, 2, shingle):
            columns = [_signed([_name(x) for x in sets]), pa.array([len(x) for x in sets], pa.int32()), _signed([set_fingerprint(x) for x in sets])]
            odd = np.array([parity(x) for x in sets]).reshape(-1, PARITY)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns, *(pa.array(odd[:, i]) for i in range(PARITY)), pa.array([wide_parity(x) for x in sets], pa.binary())], ["__id", "__hash", "sid", "n", "fp", *SIGNATURE, "wide"])

    return arrow_map(named, run, f"__id {named.schema['__id'].dataType.simpleString()}, __hash bigint, sid bigint, n int, fp bigint, " + ", ".join(f"{q} bigint" for q in SIGNATURE) + ", wide binary")


SIGNATURE = [f"q{i}" for i in range(PARITY)]

#: Join keys of a slice, if all shingles of all prefixes are sent, and join keys that a task packs together.
SLICE_KEYS, BLOCK_KEYS = 400_000, 300_000
CROWDED = "key bigint, sid bigint, n int, place int, p_sid bigint, p_n int, p_place int"


def key_packets(parts: list[tuple[np.ndarray, ...]], slices: int) -> pa.RecordBatch:
    """Join keys with the name, size and place of their sets, as packets of one slice each. Equal sets of the block are sent once."""
    key, sid, n, place = (np.concatenate(x) for x in zip(*parts, strict=True))
    key = key * ODD  # prefixes prefer small hashes, slices are even
    order = np.lexsort((sid, key))
    key, sid, n, place = key[order], sid[order], n[order], place[order]
    fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (sid[1:] != sid[:-1])))
    key, sid, n, place = key[fresh], sid[fresh], n[fresh].astype(np.int32), place[fresh].astype(np.int32)
    cuts, out = np.searchsorted(((key >> np.uint64(32)) * np.uint64(slices)) >> np.uint64(32), np.arange(slices + 1)), []
    for s, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
        if a < b:
            out.append((s, pack(np.diff(key[a:b], prepend=np.uint64(0)), sid[a:b], n[a:b], place[a:b])))
    return packets(out)


def has_room(key: np.ndarray, n: np.ndarray, place: np.ndarray, similarity: float) -> np.ndarray:
    """Whether what is left of a set behind a key, and of some set with the same key, can be similar; ``key`` is sorted.

    Sets of n and m shingles can only be if m is at most what n reaches and n at most what m reaches. A set that reaches its own
    size finds itself, so some without room pass, and none with room is left out.
    """
    reach = np.minimum((n - place) * ((1 + similarity) / similarity) - n + 1e-3, 2.0**32).astype(np.int64)  # more never harms
    bucket = np.cumsum(np.concatenate(([0], key[1:] != key[:-1]))) << 33
    order = np.lexsort((n, bucket))
    most = np.maximum.accumulate((bucket + reach)[order])
    below = np.searchsorted((bucket + n)[order], bucket + reach, side="right")  # members small enough, and all of the buckets before
    return (below > 0) & (most[below - 1] >= bucket + n)


def crowds(number: int, payloads: Iterator[bytes], similarity: float = 0.0) -> Iterator[pa.RecordBatch]:
    """The members of a slice's keys that several sets have, each once, with the bucket's pivot; with ``similarity`` those that have room for it.

    The pivot depends on one of 4 orders, so that one dense cluster has few pivots, and not one alone.
    """
    parts = [unpack(p, "u8", "u8", "i4", "i4") for p in payloads]
    key, sid, n, place = np.concatenate([np.cumsum(x[0], dtype=np.uint64) for x in parts]), *(np.concatenate([x[i] for x in parts]) for i in (1, 2, 3))
    del parts
    rank = (sid ^ ((key & np.uint64(3)) + np.uint64(1)) * ODD) * sketch.ROWS[1]
    order = np.lexsort((sid, rank ^ (rank >> np.uint64(31)), key))  # a bucket's first is its pivot
    key, sid, n, place = key[order], sid[order], n[order], place[order]
    fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (sid[1:] != sid[:-1])))
    key, sid, n, place = key[fresh], sid[fresh], n[fresh], place[fresh]
    if similarity:
        room = has_room(key, n, place, similarity)
        key, sid, n, place = key[room], sid[room], n[room], place[room]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    many = np.diff(np.append(first, len(key)))
    pivot = np.repeat(first, many)
    at = np.flatnonzero(np.repeat(many > 1, many))
    for i in range(0, len(at), 50_000):
        x = at[i : i + 50_000]
        columns = [_signed(key[x]), _signed(sid[x]), pa.array(n[x]), pa.array(place[x]), _signed(sid[pivot[x]]), pa.array(n[pivot[x]]), pa.array(place[pivot[x]])]
        yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in CROWDED.split(", ")])


def centre_pairs(grouped: DataFrame, similarity: float) -> DataFrame:
    """The centre of a bucket's largest group with each member outside the group: ``a, n, place`` of the member, ``b, m, other`` of the centre.

    ``grouped``: ``key, node, n, place, root``. The centre is the member that has most of its prefix in common with others: a copy with few edits
    of its own is similar to most that are similar to any of the group. There are no more rows than those of grouped.
    """
    held = grouped.groupBy("node").agg((F.lit(1 - similarity) * F.min("n") - F.count(F.lit(1))).alias("alone"))
    groups = grouped.join(held, "node").groupBy("key", "root").agg(F.count(F.lit(1)).alias("many"), F.min(F.struct("alone", "node", "n", "place")).alias("c"))
    largest = groups.groupBy("key").agg(F.max_by(F.struct("root", "c"), F.struct("many", "root")).alias("main"), F.count(F.lit(1)).alias("groups")).where("groups > 1")
    outside = grouped.join(largest, "key").where("root <> main.root")
    return outside.select(F.col("node").alias("a"), "n", "place", F.col("main.c.node").alias("b"), F.col("main.c.n").alias("m"), F.col("main.c.place").alias("other"))


def similar_groups(docs: DataFrame, rows: DataFrame, text: str, similarity: float, shingle: int, distance: int = 4, blocks: int | None = None) -> DataFrame:
    """``sid``, ``root`` of the shingle sets that have a similar one; others are left out. ``rows``: as ``named_sets`` gives it.

    In SimHash's buckets and in those of the prefixes, a pivot meets all members and similar ones are linked. In buckets of prefixes
    that then hold several groups the centre of the largest meets those outside it, as few are left for whom it is too far but another
    of its group is not; what still holds several groups is compared across groups. Pairs in one group already, and pairs that can't be
    similar by their sizes, the places of the shared key and their parity signatures, are dropped before their sets are fetched.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(f"`{text}`").cast("string").alias("__text"))
    n_rows, n_items = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    bits = sketch.log_width(n_items, 27)

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partial = sketch.Partial(bits, 500_000)
        for _, sets in _sets(batches, 0, shingle):
            yield from partial.add(np.concatenate(sets))
        yield from partial.flush()

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _sets(batches, 0, shingle):
            yield pa.RecordBatch.from_arrays([_signed(np.concatenate(sets))], ["key"])

    some = texts.where(F.pmod(F.xxhash64("__text"), F.lit(max(1, n_rows // SAMPLE))) == 0)
    often = arrow_map(some.distinct(), listed, "key bigint").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON)
    often = often.orderBy(F.desc("n"), "key").limit(MOST).toArrow()
    keys, times = often.column("key").to_numpy().view(np.uint64), often.column("n").to_numpy()
    by = np.argsort(keys)
    seen = None if n_items > FULL << bits else sketch.merged(arrow_map(texts, sketched, PACKET), bits)
    sent = spark.sparkContext.broadcast((seen, keys[by], times[by]))

    slices = max(64, int((1 - similarity) * n_items + n_rows) // SLICE_KEYS)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, common, weight = sent.value
        out: list[tuple[np.ndarray, ...]] = []
        held = 0
        for _, sets in _sets(batches, 0, shingle):
            joined = np.concatenate(sets)
            rank = np.ones(len(joined), np.int64) if seen is None else sketch.repeated(seen, joined, bits).astype(np.int64)
            if len(common):
                at = np.minimum(np.searchsorted(common, joined), len(common) - 1)
                rank = np.where(common[at] == joined, 1 + weight[at], rank)
            begin = 0
            for values in sets:
                n = len(values)
                mine = rank[begin : begin + n]
                begin += n
                first = n - ceil(similarity * n - 1e-9) + 1
                place = int((mine == 0).sum())
                if place >= first:
                    continue
                order = np.argsort(mine, kind="stable")[place:first]  # values are sorted already
                out.append((values[order], np.full(len(order), _name(values), np.uint64), np.full(len(order), n), np.arange(place, first)))
                held += len(order)
            if held >= BLOCK_KEYS:
                yield key_packets(out, slices)
                out, held = [], 0
        if out:
            yield key_packets(out, slices)

    crowded = durable(by_slice(arrow_map(texts, prefixes, PACKET), partial(crowds, similarity=similarity), CROWDED))
    sent.destroy()

    about = rows.groupBy("sid").agg(F.min("n").alias("n"), *[F.min(q).alias(q) for q in SIGNATURE])
    wide = rows.groupBy("sid").agg(F.min("n").alias("n"), F.min("wide").alias("wide"))

    def bits(a: str, b: str) -> F.Column:
        return sum((F.bit_count(F.col(f"{a}{q}").bitwiseXOR(F.col(f"{b}{q}"))) for q in SIGNATURE), F.lit(0))

    def near(a: str, b: str) -> F.Column:
        """Whether the signatures, and sizes, of two sets leave room for the similarity: sets that share s of all differ in (1 - s) / (1 + s) of their sizes."""
        return bits(a, b) <= F.lit((1 - similarity) / (1 + similarity)) * (F.col(f"{a}n") + F.col(f"{b}n")) + 1e-9

    def left_open(pairs: DataFrame) -> DataFrame:
        """Pairs a, b, with what else they have, that the signatures as wide as their sets don't rule out: sets are many times larger, and few of those left are in vain."""
        side = lambda x: wide.select(F.col("sid").alias(x), F.col("n").alias(f"{x}_n"), F.col("wide").alias(f"{x}_wide"))
        width, room = len(pairs.columns), (1 - similarity) / (1 + similarity)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n, m, a, b = (batch.column(width + i).to_pylist() for i in range(4))
                good = [bits_apart(x, y) <= room * (i + j) + 1e-9 for i, j, x, y in zip(n, m, a, b, strict=True)]
                yield batch.select(range(width)).filter(pa.array(good, pa.bool_()))

        met = pairs.join(side("a"), "a").join(side("b"), "b").select(*pairs.columns, "a_n", "b_n", "a_wide", "b_wide")
        return arrow_map(met, run, ", ".join(f"{c} {kind}" for c, kind in pairs.dtypes))

    def signed(pairs: DataFrame) -> DataFrame:
        """Pairs a, b that their signatures don't rule out."""
        side = lambda x: about.select(F.col("sid").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("n", *SIGNATURE)])
        return left_open(pairs.join(side("a"), "a").join(side("b"), "b").where(near("a_", "b_")).select("a", "b"))

    def possible(n: str, place: str, m: str, other: str) -> F.Column:
        """If this is the first shingle in which two sets meet: whether what is left of both can be similar."""
        most = F.least(F.col(n) - F.col(place), F.col(m) - F.col(other))
        return most >= F.lit(similarity) * (F.col(n) + F.col(m) - most) - 1e-9

    # SimHash: members of a block's bucket and its pivot, within the distance
    hashed_sets = exploded_keys(rows.groupBy("sid").agg(F.min("fp").alias("fp")), distance, blocks)
    block_pivot = hashed_sets.groupBy("key").agg(F.count(F.lit(1)).alias("many"), F.min(F.struct(F.xxhash64("sid", F.pmod("key", F.lit(4))).alias("r"), "sid", "fp")).alias("p")).where("many > 1")
    close = hashed_sets.join(block_pivot.select("key", "p"), "key").where((F.col("sid") != F.col("p.sid")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("p.fp"))) <= distance))
    close = durable(signed(close.select(F.col("sid").alias("a"), F.col("p.sid").alias("b")).distinct()))
    star = crowded.select(F.col("sid").alias("a"), "n", "place", F.col("p_sid").alias("b"), F.col("p_n").alias("m"), F.col("p_place").alias("other"))
    star = durable(signed(star.where((F.col("a") != F.col("b")) & possible("n", "place", "m", "other")).select("a", "b").distinct()))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _sets(batches, 1, shingle):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in sets], pa.binary())], ["sid", "set"])

    hashed = F.unhex(F.lpad(F.hex("__hash"), 16, "0"))

    def fetched(sids: DataFrame) -> DataFrame:
        """``sid, set`` of the named sets, made from their texts again."""
        wanted = durable(rows.join(sids, "sid").groupBy("sid").agg(F.min("__hash").alias("__hash")).select("sid", hashed.alias("__key")))
        named = docs.withColumn("__hash", row_hash(docs)).select(F.col(f"`{text}`").cast("string").alias("__text"), hashed.alias("__key"))
        held = sift(named, "__key", wanted.select("__key"), n_rows)[0].join(wanted, "__key").select("sid", "__text")
        return durable(arrow_map(held, packed, "sid bigint, set binary").groupBy("sid").agg(F.min("set").alias("set")))

    ends = lambda pairs: pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid")))
    whole = fetched(ends(close).unionByName(ends(star)).distinct())

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [similar(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), similarity) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    def links(pairs: DataFrame) -> DataFrame:
        """Verified ones of pairs a, b, by their sets."""
        first = pairs.join(whole.select(F.col("sid").alias("a"), F.col("set").alias("set_a")), "a")
        both = first.join(whole.select(F.col("sid").alias("b"), F.col("set").alias("set_b")), "b").select(F.col("a").alias("u"), F.col("b").alias("v"), "set_a", "set_b")
        return arrow_map(both, verify, "u bigint, v bigint")

    edges = lambda roots: roots.select(F.col("node").alias("u"), F.col("root").alias("v"))
    by_print = connected_components(links(close))
    of = lambda name: by_print.select(F.col("node").alias(name), F.col("root").alias(f"root_{name}"))
    apart = star.join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")
    roots = connected_components(links(apart).unionByName(edges(by_print)))

    def grouped_by(roots: DataFrame) -> DataFrame:
        grouped = crowded.select("key", "sid", "n", "place").join(roots, F.col("sid") == F.col("node"), "left")
        return durable(grouped.select("key", F.col("sid").alias("node"), "n", "place", F.coalesce("root", "sid").alias("root")))

    def complete(pairs: DataFrame) -> None:
        """Fetches the sets of pairs a, b that aren't there."""
        nonlocal whole
        more = durable(ends(pairs).distinct().join(whole, "sid", "left_anti"))
        if more.take(1):
            whole = whole.unionByName(fetched(more))

    grouped = grouped_by(roots)
    central = durable(signed(centre_pairs(grouped, similarity).where(possible("n", "place", "m", "other")).select("a", "b").distinct()))
    if central.take(1):
        complete(central)
        roots = connected_components(links(central).unionByName(edges(roots)))
        grouped = grouped_by(roots)
    across = pairs_across(grouped, ["n", "place"], about=about.select(F.col("sid").alias("node"), *SIGNATURE)).where(possible("a_n", "a_place", "b_n", "b_place") & near("a_", "b_"))
    across = durable(left_open(across.groupBy(F.col("a_node").alias("a"), F.col("b_node").alias("b")).agg(F.min(bits("a_", "b_")).alias("bits"))))
    complete(across)
    # the nearest other text by signature first: most groups are joined by then, and need no more of their pairs
    nearest = across.groupBy("a").agg(F.min_by("b", F.struct("bits", "b")).alias("b")).select("a", "b")
    joined = connected_components(links(nearest).unionByName(edges(roots)))
    of = lambda name: joined.select(F.col("node").alias(name), F.col("root").alias(f"root_{name}"))
    apart = across.join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b"))
    apart = apart.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    joined = connected_components(links(apart).unionByName(edges(joined)))
    return joined.select(F.col("node").alias("sid"), "root")


def one_of_similar(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """The rows of docs that stay when one of each group linked by shingle similarity is kept: that with the smallest id, nulls last.

    Two texts are linked if they share ``similarity`` or more of all distinct shingles of both; a text with fewer words than a
    shingle is one shingle; null, empty and blank texts are equal. Rows with the smallest id are told apart by a hash of all
    columns; of wholly equal rows one stays. Columns are those of docs.
    """
    return one_of_each(docs, doc_id, text, shingle=shingle, similarity=similarity)
