"""SimHash near-duplicate groups with pigeonhole blocks.

Fingerprints are cut into blocks; two fingerprints that differ in few bits agree on several whole blocks, so each
combination of that many blocks is a join key. Keys only propose pairs; a link is made after the Hamming distance is verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, as_bytes, durable, plain_names, row_hash, word_starts
from .components import connected_components, pairs_across
from .packets import sift

BITS = 64


def fingerprint(text: bytes | None, shingle: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles: a bit is 1 if it is set in over half of the shingles' XXH64 values.

    A-Z are lower-cased, words are runs of non-spaces, repeated shingles count again. A text with fewer words than a
    shingle is one shingle; null, and a text without words, gives 0.
    """
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    first, last = word_starts(words)
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    ends = last[shingle - 1 :].tolist() if len(words) >= shingle else [len(joined)]
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(first[:n].tolist(), ends, strict=True)], ">u8")
    ones = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def with_fingerprint(docs: DataFrame, text: str, keep: list[str], shingle: int = 4, seed: int = 42) -> DataFrame:
    """Columns ``keep`` of docs and a bigint ``fp``, one row for each row of docs."""
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), "fp bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(x, shingle, seed) for x in as_bytes(batch.column(len(keep)))]
            fps = pa.array(np.array(values, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], fps], [*keep, "fp"])

    return arrow_map(rows, run, schema)


def block_keys(distance: int, blocks: int | None = None) -> list[list[tuple[int, int]]]:
    """Block combinations, each a list of (shift, width): pairs within ``distance`` agree on one combination at least."""
    blocks = blocks or distance + 3
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    spans = [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]
    return [list(c) for c in combinations(spans, blocks - distance)]


def exploded_keys(prints: DataFrame, distance: int, blocks: int | None = None) -> DataFrame:
    """Adds ``number`` (the block combination) and ``key`` to rows with ``fp``: one row for each combination.

    A key is a hash of the combination's number and block values; two keys with one hash only propose more pairs. Rows are dealt
    out first: they are few bytes each, and the keys are many. A join of them sorts: adaptive execution takes an exploded table to be
    as small as the exchange below it, and would send all keys to the driver for a broadcast.
    """
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    value = lambda shift, width: F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1))
    keys = [F.struct(F.lit(i).alias("number"), F.xxhash64(F.lit(i), *[value(*s) for s in spans]).alias("key")) for i, spans in enumerate(block_keys(distance, blocks))]
    dealt = prints.repartition(parts, F.xxhash64("fp"))  # by another key than that of a distinct before it, else both are one exchange of few tasks
    return dealt.withColumn("k", F.explode(F.array(*keys))).select(*prints.columns, "k.number", "k.key").hint("merge")


def narrower_keys(distance: int, blocks: int | None = None) -> F.Column:
    """Array of keys inside a bucket: the bits outside its blocks, cut into distance + 1 parts, of which a near pair shares one."""
    rest = []
    for spans in block_keys(distance, blocks):
        taken = {b for shift, width in spans for b in range(shift, shift + width)}
        left = [b for b in range(BITS) if b not in taken]
        edges = [round(i * len(left) / (distance + 1)) for i in range(distance + 2)]
        masks = [sum(1 << b for b in left[x:y]) for x, y in zip(edges, edges[1:], strict=False)]
        rest.append([m - (1 << BITS) if m >> (BITS - 1) else m for m in masks])
    masks = F.element_at(F.array(*[F.array(*[F.lit(m).cast("bigint") for m in part]) for part in rest]), F.col("number") + 1)
    return F.transform(masks, lambda m, i: F.xxhash64(i, F.col("fp").bitwiseAND(m)))


def near_groups(fingerprints: DataFrame, distance: int = 4, blocks: int | None = None) -> DataFrame:
    """Groups of the distinct values of ``fp``: columns ``fp``, ``root``; values without a link are left out.

    1. Every key's bucket gets a pivot, chosen by hash so that buckets of one dense cluster have different pivots; members
       within the distance are linked to it. That joins dense clusters with as many links as members.
    2. In buckets that still hold several groups, members outside the largest one meet those of other groups by narrower
       keys, and are verified; where those outside are few, all pairs with them are.
    No pair is lost: a pair in one group already needs no link of its own, a pair across groups is compared in step 2.
    """
    fps = fingerprints.select("fp").where("fp is not null").distinct()
    keyed = exploded_keys(fps, distance, blocks)
    pivots = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.xxhash64("fp", "key").alias("r"), "fp")).alias("p"))
    pivots = pivots.where("n > 1").select("key", F.col("p.fp").alias("pivot"))
    near = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= distance
    crowded = durable(keyed.join(pivots, "key"))
    star = crowded.where((F.col("fp") != F.col("pivot")) & near("fp", "pivot")).select(F.col("fp").alias("u"), F.col("pivot").alias("v"))
    roots = connected_components(star)
    named = crowded.select("key", "number", "fp").join(roots, F.col("fp") == F.col("node"), "left").select("key", "number", "fp", F.col("fp").alias("node"), F.coalesce("root", "fp").alias("root"))
    across = pairs_across(durable(named), [], narrower_keys(distance, blocks), few=distance + 1).where(near("a_node", "b_node"))
    joined = connected_components(across.select(F.col("a_root").alias("u"), F.col("b_root").alias("v")))
    final = roots.join(joined.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
    known = final.select(F.col("node").alias("fp"), F.coalesce("top", "root").alias("root"))
    fresh = joined.join(roots, "node", "left_anti").select(F.col("node").alias("fp"), "root")
    return known.unionByName(fresh)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = 4, shingle: int = 4, seed: int = 42, blocks: int | None = None) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id``, one row for each row of docs.

    component_id is the smallest doc_id reachable over links of at most ``distance`` differing bits, the row's own included.
    Null ids never become a component_id unless the whole component has no other; null, empty and blank texts have
    fingerprint zero, which links like any other; equal rows stay as often as they came; other columns are ignored.
    """
    rows = durable(with_fingerprint(docs, text, [doc_id], shingle, seed))
    roots = near_groups(rows, distance, blocks)
    each = rows.groupBy("fp").agg(F.min(doc_id).alias("low")).join(roots, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    each = durable(each)
    lowest = each.groupBy("root").agg(F.min("low").alias("component_id"))
    named = each.join(lowest, "root").select("fp", "component_id")
    return rows.join(named, "fp").select(doc_id, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = 4, shingle: int = 5, seed: int = 42, blocks: int | None = None, similarity: float | None = None
) -> DataFrame:
    """The rows of docs that stay when one of each near-duplicate group is kept: that with the smallest id, nulls last.

    Two rows are linked if their fingerprints differ in ``distance`` bits at most. With ``similarity`` they are linked if they share
    that part or more of all distinct shingles of both, whatever their distance: fingerprints then link most copies cheaply, each
    link being checked on the shingles, and ``similar.similar_groups`` adds exactly the pairs that are farther apart.

    Rows with that id are told apart by a hash of all columns; of wholly equal rows one stays. Columns are those of docs.
    """
    if similarity is None:
        named = docs.select(F.col(f"`{doc_id}`").alias("__id"), row_hash(docs).alias("__hash"), F.col(f"`{text}`").cast("string").alias("__text"))
        rows = durable(with_fingerprint(named, "__text", ["__id", "__hash"], shingle, seed))
        roots, group = near_groups(rows, distance, blocks), "fp"
    else:
        from .similar import named_sets, similar_groups

        rows, group = durable(named_sets(docs, doc_id, text, shingle)), "sid"
        roots = similar_groups(docs, rows, text, similarity, shingle, distance, blocks)
    each = rows.join(roots, group, "left").select(F.coalesce("root", group).alias("root"), F.struct(F.col("__id").isNull().alias("a"), F.col("__id").alias("b"), F.col("__hash").alias("c")).alias("o"))
    names = each.groupBy("root", "o").agg(F.count(F.lit(1)).alias("n"))
    first = names.groupBy("root").agg(F.min("o").alias("first"))
    # Names that go, and those that stay once of several rows. The rows of all others stay where they are.
    odd = names.join(first, "root").where("o <> first or n > 1").select(F.col("o.b").alias("__id"), F.col("o.c").alias("__name"), (F.col("o") == F.col("first")).alias("__stays"))
    odd = durable(odd.withColumn("__key", _name_key("__id", "__name")))
    plain, columns = plain_names(docs)
    named = plain.withColumn("__hash", row_hash(plain)).withColumn("__key", _name_key(columns[doc_id], "__hash"))
    some, others = sift(named, "__key", odd.select("__key"), rows.count())
    found = some.join(odd.drop("__key"), F.col(columns[doc_id]).eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__name")), "left")
    once = found.where("__stays").dropDuplicates(["__id", "__hash"])
    kept = found.where("__stays is null").unionByName(once).select(*columns.values()).unionByName(others.select(*columns.values()))
    return kept.toDF(*columns)


def _name_key(doc_id: str, name: str) -> F.Column:
    return F.unhex(F.lpad(F.hex(F.xxhash64(F.col(doc_id), F.col(name))), 16, "0"))
