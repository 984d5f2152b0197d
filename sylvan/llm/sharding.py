"""Histogram-sort sharding: near-equal bytes for every shard, with DataFrame operations only.

Shards are ranges of (key, doc_id), where the key is a digest of the text, so equal texts meet in a shard. Splitters are found
by counting exact bytes in ranges of candidate boundaries, then refining only the ranges that a target falls in; the rows
are exchanged once, after the splitters are known.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable

#: The key is a 60-bit number; a round resolves STEP further bits, so the driver gets at most (shards - 1) * 2**STEP counts.
KEY_BITS, STEP = 60, 10


def with_key(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``__key`` (60 bits of the text's MD5) and ``size`` (UTF-8 bytes plus 1); a null text counts as empty."""
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return docs.withColumn("__key", F.conv(F.substring(F.md5(whole.cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("bigint")).withColumn("size", F.octet_length(whole).cast("bigint") + 1)


def _refine(rows: DataFrame, column: str, open_: list[dict], span: int, step: int) -> None:
    """One histogram round: narrow each open range of ``column`` to the probe interval where its target falls.

    ``open_`` holds dicts with ``lo`` (first value of the range), ``below`` (exact bytes before it), ``goal`` and a filter.
    """
    width = max(1, -(-span // (1 << step)))
    los = sorted({(r["key"] or 0, r["lo"]) if column != "__key" else (0, r["lo"]) for r in open_})
    cases = None
    for key, lo in los:
        inside = (F.col(column) >= lo) & (F.col(column) < lo + span)
        if column != "__key":
            inside &= F.col("__key") == key
        cases = F.when(inside, F.struct(F.lit(key).alias("k"), F.lit(lo).alias("lo"), F.floor((F.col(column) - lo) / width).cast("bigint").alias("p"))) if cases is None else cases.when(inside, F.struct(F.lit(key).alias("k"), F.lit(lo).alias("lo"), F.floor((F.col(column) - lo) / width).cast("bigint").alias("p")))
    counts: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for k, lo, p, b in rows.select(cases.alias("at"), "size").where("at is not null").groupBy("at.k", "at.lo", "at.p").agg(F.sum("size").alias("bytes")).collect():
        counts.setdefault((k, lo), []).append((p, b))
    for r in open_:
        at, below, last = r["lo"], r["below"], None
        for p, b in sorted(counts.get((r["key"] if column != "__key" else 0, r["lo"]), [])):
            last = (r["lo"] + p * width, below, b)
            if below + b >= r["goal"]:
                break
            below += b
        if last:
            at, r["below"], r["bytes"] = last
        r["lo"] = at
    return width


def splitters(keyed: DataFrame, shards: int, tolerance: float = 0.0) -> list[tuple[int, int | None]]:
    """shards - 1 boundaries (key, id): a row is past a boundary if its (key, id) is not below it.

    Each round counts exact bytes below 2**STEP probes of every open range. A boundary is settled when the bytes below it are
    within ``tolerance`` of a shard's share; ranges narrow to one key, and if one key (a group of equal texts) still straddles
    the boundary beyond the tolerance, to an id within that group. The boundary falls before or after the last id's rows, whichever is nearer to the goal.
    """
    total = keyed.agg(F.sum("size"), F.min("__id"), F.max("__id")).first()
    if not total[0]:
        return [(1 << KEY_BITS, None)] * (shards - 1)
    slack = tolerance * total[0] / shards
    found = [{"goal": i * total[0] / shards, "lo": 0, "below": 0, "bytes": total[0], "key": None} for i in range(1, shards)]
    settled = lambda r: r["goal"] - r["below"] <= slack
    span = 1 << KEY_BITS
    while span > 1 and (open_ := [r for r in found if not settled(r)]):
        span = _refine(keyed, "__key", open_, span, STEP)
    for r in found:
        r["id"], r["key"] = None, r["lo"]
    if open_ := [r for r in found if not settled(r)]:
        low, high = total[1], total[2]
        span = high - low + 1
        for r in (refined := open_):
            r["lo"] = low
        while span > 1 and (open_ := [r for r in open_ if not settled(r)]):
            span = _refine(keyed, "__id", open_, span, STEP)
        for r in refined:
            nearer = r["goal"] - r["below"] > r["bytes"] / 2  # to the end of the rows with this id than to their beginning
            r["id"] = r["lo"] + nearer
    return [(r["key"], r["id"]) for r in found]


def histogram_shards(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = 8, tolerance: float = 0.0, keep: list[str] | None = None) -> DataFrame:
    """Shard, and a gapless slot within it, of every row; columns ``keep`` (default: the id), then size, text_crc32, law, shard, slot, grown_shard.

    Law ``bytes``: shards differ by at most the tolerance and one row's size on each boundary. Equal texts
    share a shard unless a boundary falls among them. Slots follow the key's first bits, then the id's remainder by 16, the key and the id. A null text counts as empty (size 1); a null id sorts first; rows equal
    in id and text stay together; an empty table gives none.
    """
    keep = [doc_id] if keep is None else keep
    ident = F.coalesce(F.col(f"`{doc_id}`").cast("bigint"), F.lit(-(1 << 62)))
    rows = with_key(docs, text).withColumn("text_crc32", F.crc32(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary"))).withColumn("__id", ident)
    slim = durable(rows.select("__key", "__id", "size"))
    cuts = splitters(slim, shards, tolerance)
    past = [((F.col("__key") > k) | ((F.col("__key") == k) & (F.col("__id") >= i))) if i is not None else F.col("__key") >= k for k, i in cuts]
    number = lambda: sum((p.cast("int") for p in past), F.lit(0)).cast("int")
    # Slots: rows are ranked inside small cells, and a table of cell counts, bounded by shards * 2**STEP * 16, gives each cell's offset.
    cell = [number().alias("shard"), F.shiftright("__key", KEY_BITS - STEP).cast("int").alias("__part"), F.pmod("__id", F.lit(16)).cast("int").alias("__salt")]
    from pyspark.sql import Window

    counts = slim.select(*cell).groupBy("shard", "__part", "__salt").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("shard").orderBy("__part", "__salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0))).drop("n")
    inside = Window.partitionBy("shard", "__part", "__salt").orderBy("__key", "__id")
    slim_rows = rows.select(*[F.col(f"`{c}`") for c in keep], "__key", "__id", "size", "text_crc32", *cell)
    ranked = slim_rows.withColumn("__rank", F.row_number().over(inside) - 1)
    placed = ranked.join(F.broadcast(offsets), ["shard", "__part", "__salt"])
    return placed.select(*[F.col(f"`{c}`") for c in keep], "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("__ahead") + F.col("__rank")).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
