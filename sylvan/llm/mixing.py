"""Mixing overlapping sources to target weights by min-cost flow over membership patterns."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

#: Words of a text: runs of anything but space and U+0009 to U+000D.
def word_count(text: F.Column) -> F.Column:
    """Number of words of a string column; null counts 0. Counted as the places where a word begins."""
    spaced = F.translate(F.coalesce(text.cast("string"), F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.filter(F.split(spaced, " ", -1), lambda w: w != "")).cast("bigint")


def capped_targets(sizes: dict[str | None, int], weights: dict[str | None, float], share: float, cap: float) -> dict[str | None, float]:
    """Targets proportional to the weights that sum to ``share`` times all sizes; none is above ``cap`` times its source's size.

    The excess of capped sources is shared again by weight until none is above; what no source can take is dropped.
    """
    total, free, out = share * sum(sizes.values()), dict(weights), {}
    while free:
        unit = total / sum(free.values())
        over = [s for s in free if unit * free[s] > cap * sizes[s]]
        if not over:
            return out | {s: unit * w for s, w in free.items()}
        for s in over:
            out[s] = float(cap * sizes[s])
            total -= out[s]
            del free[s]
        if total <= 0:
            return out | dict.fromkeys(free, 0.0)
    return out


def min_cost_flow(patterns: list[tuple[frozenset, int]], quotas: dict, repeats: int) -> dict[tuple[int, object], int]:
    """Words routed from each pattern to each source: {(pattern number, source): words}, by successive cheapest paths.

    A pattern's words may be taken ``repeats`` times; taking them for the r-th time costs r * r a word, so the cost is convex
    and every pattern fills its first pass before any second one. Paths go pattern -> source, and back over words routed
    earlier, so a later quota may move an earlier one. Patterns and sources are few: both come from aggregated counts.
    """
    left = {(i, r): size for i, (_, size) in enumerate(patterns) for r in range(1, repeats + 1)}
    level = [1] * len(patterns)
    flow: dict[tuple[int, object], int] = {}
    need = {s: q for s, q in quotas.items() if q > 0}
    by_source: dict[object, list[int]] = {}
    for i, (members, _) in enumerate(patterns):
        for s in members:
            by_source.setdefault(s, []).append(i)
    while need:
        start = min(need, key=lambda s: (s is None, str(s)))
        best: dict[object, int] = {start: 0}
        came: dict[object, tuple[object, int]] = {}
        queue, tie, end = [(0, 0, start)], 0, None
        while queue:  # cheapest path from the source in need to a pass with words left, moving other sources' words
            cost, _, s = heapq.heappop(queue)
            if isinstance(s, tuple) and s[:1] == ("end",):
                end = (cost, s[1], s[2])
                break
            if cost > best.get(s, cost):
                continue
            for i in by_source.get(s, ()):
                while level[i] <= repeats and left[i, level[i]] == 0:
                    level[i] += 1
                if level[i] <= repeats:
                    tie += 1
                    heapq.heappush(queue, (cost + level[i] ** 2, tie, ("end", s, i)))
                for other in patterns[i][0]:
                    if other != s and flow.get((i, other), 0) > 0 and cost < best.get(other, 1 << 60):
                        best[other], came[other] = cost, (s, i)
                        tie += 1
                        heapq.heappush(queue, (cost, tie, other))
        if end is None:
            del need[start]  # nothing more can reach this source
            continue
        _, s, i = end
        amount, path = min(need[start], left[i, level[i]]), []
        at = s
        while at != start:
            before, via = came[at]
            amount = min(amount, flow[via, at])
            path.append((before, via, at))
            at = before
        left[i, level[i]] -= amount
        flow[i, s] = flow.get((i, s), 0) + amount
        for before, via, at in path:
            flow[via, at] -= amount
            flow[via, before] = flow.get((via, before), 0) + amount
        need[start] -= amount
        if not need[start]:
            del need[start]
    return flow


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, repeats: int = 2, seed: str = "mix", max_patterns: int = 100_000, keep: list[str] | None = None) -> DataFrame:
    """Every row with ``size, source_size, target, taken``: the words that the mix takes of it, repeats counted.

    ``source`` is a string, or an array of strings for documents that belong to several sources. Documents are counted by
    membership pattern; the driver holds patterns, not documents, and stops with an error beyond ``max_patterns``. Words flow
    from patterns to source quotas at convex repetition costs. A pattern's words are then taken from its documents in seeded
    order: whole passes first, then part of the order, the last document in part, so that the pattern's amount is met exactly.

    Sources in code point order, null last, get the weights in turn. ``target`` and ``source_size`` are the row's source's, or
    sums over its sources. A null or blank text has size 0 and is taken 0 times; rows equal in id and text are ordered by all
    their columns; an empty table gives an empty result.
    """
    keep = [doc_id] if keep is None else keep
    kind = docs.schema[source].dataType.typeName()
    pattern = F.array_sort(F.array_distinct(F.col(f"`{source}`"))) if kind == "array" else F.array(F.col(f"`{source}`").cast("string"))
    order = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("null"))))
    slim = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(pattern, F.array(F.lit(None).cast("string"))).alias("__pattern"), order.alias("__order"), word_count(F.col(f"`{text}`")).alias("size"))
    slim = durable(slim)
    counted = slim.groupBy("__pattern").agg(F.sum("size").alias("n")).limit(max_patterns + 1).collect()
    if len(counted) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    patterns = [(frozenset(r[0]), int(r[1] or 0)) for r in sorted(counted, key=lambda r: [(x is None, x or "") for x in r[0]])]
    names = sorted({s for p, _ in patterns for s in p}, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(n for p, n in patterns if s in p) for s in names}
    targets = capped_targets(sizes, {s: weights[i % len(weights)] for i, s in enumerate(names)}, share, repeats)
    flow = min_cost_flow(patterns, {s: int(t + 0.5) for s, t in targets.items()}, repeats)
    amounts = [sum(a for (i, _), a in flow.items() if i == j) for j in range(len(patterns))]
    spark = docs.sparkSession
    rows = [(sorted(p, key=lambda s: (s is None, s or "")), n, amounts[j], sum(sizes[s] for s in p), float(sum(targets[s] for s in p))) for j, (p, n) in enumerate(patterns)]
    plan = spark.createDataFrame(rows, "p array<string>, n bigint, amount bigint, source_size bigint, target double")
    # The seeded order is cut where a pattern's last pass ends. A cell of it holds 1/4096 of a pattern's documents, whatever
    # its size: cells before the cut are taken whole, those after it not, and only the cell with the cut is summed row by row.
    slim = slim.withColumn("__cell", F.substring("__order", 1, 3)).withColumn("__sorted", F.array_sort("__pattern"))
    plan = plan.withColumn("__sorted", F.array_sort("p")).withColumn("passes", F.when(F.col("n") > 0, F.floor(F.col("amount") / F.col("n"))).otherwise(F.lit(0)).cast("bigint")).withColumn("rest", F.col("amount") - F.col("passes") * F.col("n")).drop("p", "n", "amount")
    cells = slim.groupBy("__sorted", "__cell").agg(F.sum("size").alias("__words"))
    before = Window.partitionBy("__sorted").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("__before", F.coalesce(F.sum("__words").over(before), F.lit(0)))
    cells = cells.select(F.to_json(F.struct("__sorted")).alias("__name"), "__cell", "__before", "__words")
    plan = plan.select(F.to_json(F.struct("__sorted")).alias("__name"), "passes", "rest", "source_size", "target")
    planned = cells.join(F.broadcast(plan), "__name").withColumn("__whole", F.col("__before") + F.col("__words") <= F.col("rest")).withColumn("__none", F.col("__before") >= F.col("rest"))
    located = slim.withColumn("__name", F.to_json(F.struct("__sorted"))).join(planned, ["__name", "__cell"])
    rest = F.col("rest") - F.col("__before")
    out = [*[F.col(f"`{c}`") for c in keep], F.col("size"), F.col("source_size"), F.col("target")]
    easy = located.where("__whole or __none").select(*out, (F.col("size") * (F.col("passes") + F.when(F.col("__whole"), 1).otherwise(0))).alias("taken"))
    # In the cell with the cut, rows of one order and size are counted together; only the group that the cut falls in is numbered,
    # and as its rows have one size, it doesn't matter which of those with one id come first.
    hard = located.where("not (__whole or __none)")
    upto = Window.partitionBy("__name", "__cell").orderBy("__order", "size").rowsBetween(Window.unboundedPreceding, -1)
    groups = hard.groupBy("__name", "__cell", "__order", "size").agg(F.count(F.lit(1)).alias("__rows"))
    groups = groups.withColumn("__sofar", F.coalesce(F.sum(F.col("size") * F.col("__rows")).over(upto), F.lit(0)))
    hard = hard.join(groups, ["__name", "__cell", "__order", "size"]).withColumn("__left", rest - F.col("__sofar"))
    cut = (F.col("__left") > 0) & (F.col("__left") < F.col("size") * F.col("__rows"))
    clear = hard.where(~cut).select(*out, (F.col("size") * (F.col("passes") + F.when(F.col("__left") > 0, 1).otherwise(0))).cast("bigint").alias("taken"))
    ids = [F.col(f"`{c}`") for c in keep if docs.schema[c].dataType.typeName() not in ("map", "variant")]
    among = Window.partitionBy("__name", "__cell", "__order", "size").orderBy(*(ids or [F.lit(1)]))
    part = F.greatest(F.lit(0), F.least("size", F.col("__left") - (F.row_number().over(among) - 1) * F.col("size")))
    split = hard.where(cut).select(*out, (F.col("size") * F.col("passes") + part).cast("bigint").alias("taken"))
    hard = clear.unionByName(split)
    return easy.unionByName(hard)
