"""SimHash groups, repeated windows and strings of earlier documents, against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from sylvan.llm import simhash, similar, sketch, substring, suffix
from sylvan.llm.components import connected_components, pairs_across


def sha(data):
    return hashlib.sha256(data).hexdigest()


def slow_fingerprint(text, k=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [b" ".join(words)]
    values = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(500 + i, 501 + i) for i in range(40)] + [(900, 900 + i) for i in range(50)] + [(7, 7), (None, 3)]
    frame = spark.createDataFrame(edges, "u bigint, v bigint")
    got = {r.node: r.root for r in connected_components(frame, together=0).collect()}
    assert got == {r.node: r.root for r in connected_components(frame).collect()}
    assert connected_components(frame.limit(0)).collect() == []
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in list(root)}


def test_simhash(odd_docs, no_docs):
    got = simhash.near_duplicates(odd_docs).collect()
    source = odd_docs.collect()
    assert len(got) == len(source)
    assert sorted(r.fingerprint for r in got) == sorted(f"{slow_fingerprint(r.text):016x}" for r in source)
    group = {}
    for r in got:
        group.setdefault(r.component_id, set()).add(int(r.fingerprint, 16))
    for a in got:
        for b in got:
            if (int(a.fingerprint, 16) ^ int(b.fingerprint, 16)).bit_count() <= 4:
                assert a.component_id == b.component_id
    for c, r in {(r.component_id, r) for r in got}:
        ids = [x.doc_id for x in got if x.component_id == c and x.doc_id is not None]
        assert c == min(ids, default=None)
    assert simhash.near_duplicates(no_docs).collect() == []


def test_every_near_pair_shares_a_key():
    for distance, blocks in ((4, 7), (6, 9), (2, 5)):
        keys = simhash.block_keys(distance, blocks)
        rng = np.random.default_rng(distance)
        for _ in range(300):
            bits = rng.choice(64, distance, replace=False)
            assert any(all(not any(s <= b < s + w for b in bits) for s, w in spans) for spans in keys)


def test_chain_and_dense_cluster(spark):
    base = 0x0123456789ABCDEF
    rng = np.random.default_rng(2)
    values = {base}
    for i in range(12):  # a chain, each link 4 bits from the last
        base ^= 0xF << (4 * i)
        values.add(base)
    center = int(rng.integers(1 << 62))
    for _ in range(300):
        values.add(center ^ (1 << int(rng.integers(63))) ^ (1 << int(rng.integers(63))))
    values |= {int(x) for x in rng.integers(0, 1 << 62, 200)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    got = {r.fp: r.root for r in simhash.near_groups(spark.createDataFrame([(v,) for v in signed], "fp bigint")).collect()}
    for a in signed:
        for b in signed:
            if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 4:
                assert got[a] == got[b]
    assert len(set(got.values())) <= 3


def test_one_of_each(odd_docs, no_docs):
    """Of each component of the graph of all pairs, the row with the smallest id stays, nulls last, and of equal rows one."""
    source = odd_docs.collect()
    prints = [slow_fingerprint(r.text, 5) for r in source]
    root = list(range(len(source)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(len(source)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(source):
        groups.setdefault(find(i), []).append(r)
    kept = simhash.one_of_each(odd_docs).collect()
    assert kept[0].__fields__ == odd_docs.columns and len(kept) == len(groups) < len(set(source))
    order = lambda r: (r.doc_id is None, r.doc_id or 0)
    for rows in groups.values():
        mine = [r for r in kept if r in rows]
        assert len(mine) == 1 and order(mine[0]) == min(map(order, rows))
    assert simhash.one_of_each(no_docs).collect() == []


def test_dense_buckets_with_outsiders_make_few_pairs(spark):
    """One bucket of 10,000 members of a group and 20 outsiders: as many pairs as members times outsiders at most, and each pair across groups is there."""
    rows = [(1, i, 0) for i in range(10_000)] + [(1, 10_000 + i, 10_000 + i) for i in range(20)] + [(2, i, 5) for i in range(50)]
    named = spark.createDataFrame(rows, "key bigint, node bigint, root bigint").repartition(5)
    pairs = pairs_across(named, [])
    assert pairs.count() == 10_000 * 20 + 20 * 19 // 2
    assert pairs.where("a_root = b_root").count() == 0 and pairs.where("a_node >= 10000").count() == pairs.count()


def test_buckets_with_few_outsiders_make_no_narrower_keys(spark):
    """Where few members are outside the largest group all pairs with them are made, without narrower keys; elsewhere those decide."""
    rows = [(1, i, 0) for i in range(1_000)] + [(1, 1_000 + i, 1_000 + i) for i in range(3)] + [(2, i, 0) for i in range(50)] + [(2, 2_000 + i, 2_000 + i) for i in range(6)]
    named = spark.createDataFrame(rows, "key bigint, node bigint, root bigint").repartition(3)
    within = F.array(F.when(F.col("key") == 2, F.pmod("node", F.lit(2))).otherwise(F.raise_error("a narrower key was made").cast("bigint")))
    pairs = {(r.a_node, r.b_node) for r in pairs_across(named, [], within, few=5).collect()}
    outside = [r for r in rows if r[2]]
    want = {(a, b) for k, a, x in outside for j, b, y in rows if k == j and x != y and (y == 0 or a < b) and (k == 1 or (a - b) % 2 == 0)}
    assert pairs == want and len(want) == 3 * 1_000 + 3 + 6 * 25 + 2 * 3


def test_exploded_keys_are_not_broadcast(spark, monkeypatch):
    plans, durable = [], simhash.durable
    monkeypatch.setattr(simhash, "durable", lambda df: plans.append(df) or durable(df))
    rng = random.Random(5)
    values = [rng.getrandbits(62) for _ in range(2000)]
    simhash.near_groups(spark.createDataFrame([(v,) for v in values + [v ^ 1 for v in values[:50]]], "fp bigint"))
    crowded = plans[0]._jdf.queryExecution().executedPlan().toString()
    assert "Generate" in crowded and "SortMergeJoin" in crowded and "Broadcast" not in crowded


def test_near_groups_of_a_dense_bucket(spark):
    """10,000 fingerprints around one, and outsiders that share most of their blocks: the groups are those of all pairs."""
    rng = np.random.default_rng(12)
    center = 0x00FF00FF00FF00FF
    members = {center}
    while len(members) < 10_000:
        members.add(center ^ (1 << int(rng.integers(62))) ^ (1 << int(rng.integers(62))) ^ (1 << int(rng.integers(62))))
    outside = {center ^ sum(1 << b for b in (0, 8, 16, 24, 32, 40, 48, 56, 4 + i, 20 + i, 36 + i, 52 + i)) for i in range(4)}
    got = {r.fp: r.root for r in simhash.near_groups(spark.createDataFrame([(v,) for v in members | outside], "fp bigint")).collect()}
    assert len({got[m] for m in members}) == 1
    for o in outside:
        assert o not in got or got[o] != got[center] or min((o ^ m).bit_count() for m in members) <= 4


def slow_stay(rows, t=0.8, k=5):
    """Ids that stay, over all pairs of texts."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)} or {b" ".join(w)})
    root = list(range(len(rows)))

    def find(i):
        return i if root[i] == i else find(root[i])

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    return sorted(min(rows[i][0] for i in range(len(rows)) if find(i) == r) for r in {find(i) for i in range(len(rows))})


def test_pairs_of_similarity_of_four_fifths(spark, odd_docs, no_docs):
    rng = random.Random(5)
    line = [f"common{i}" for i in range(12)]
    rows = []
    for i in range(60):
        base = [f"v{rng.randrange(3000)}" for _ in range(rng.choice((8, 40, 150, 400)))] + line * (i % 2)
        for _ in range(rng.choice((1, 2, 5))):
            copy = list(base)
            for _ in range(rng.randrange(1 + len(copy) // 25)):
                copy[rng.randrange(len(copy))] = f"edit{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy)))
    rows += [(1000, None), (1001, " "), (1002, rows[0][1].upper())]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    want = slow_stay(rows)
    stays = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert stays == want
    simple = simhash.one_of_each(docs, distance=6, shingle=5, blocks=9).count()
    assert len(want) < simple  # 6 bits of 64 leave edited copies
    known = [(r.doc_id, r.text) for r in odd_docs.collect() if r.doc_id is not None]
    kept = similar.one_of_similar(odd_docs.where("doc_id is not null"))
    assert kept.columns == odd_docs.columns and sorted(r.doc_id for r in kept.collect()) == slow_stay(known)
    assert similar.one_of_similar(no_docs).collect() == []


def test_shingle_sets_are_held_in_parts():
    """A batch of 4 MB is looked at in parts of 1 MB: each text once, in order, with its whole set."""
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(1700)) for _ in range(400)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array(texts)], ["i", "t"])
    parts = list(similar._sets(iter([batch, batch.slice(0, 0)]), 1, 5))
    assert max(part.nbytes for part, _ in parts) <= 1.1 * (1 << 20) and len(parts) >= 4
    assert [i for part, _ in parts for i in part.column(0).to_pylist()] == list(range(400))
    assert all(np.array_equal(x, similar.shingle_set(t.encode(), 5)) for x, t in zip((x for _, sets in parts for x in sets), texts, strict=True))


def test_join_keys_of_one_set_become_no_rows(spark, monkeypatch):
    """With a sketch so full that it rules nothing out, as on very large tables, keys that one set alone has are dropped before they are rows, and the result is the same."""
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{rng.randrange(10**9)}" for _ in range(200))) for i in range(40)]
    rows += [(100 + i, f"{rows[0][1]} end{i}") for i in range(3)] + [(200, rows[1][1])]
    made, keep = [], similar.durable

    def counted(df):
        out = keep(df)
        made.append((set(df.columns), out.count()))
        return out

    monkeypatch.setattr(similar, "durable", counted)
    monkeypatch.setattr(sketch, "merged", lambda partials, width: b"\xff" * (3 << width - 3))
    kept = similar.one_of_similar(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4))
    assert sorted(r.doc_id for r in kept.collect()) == slow_stay(rows) == list(range(40))
    assert 0 < max(n for columns, n in made if {"key", "place"} <= columns) <= 4 * 41  # the prefixes of 40 texts have 1,640 keys


def test_crowds_are_the_keys_of_several_sets():
    rng = np.random.default_rng(9)
    key, sid = rng.integers(0, 40, 300).astype(np.uint64), rng.integers(0, 60, 300).astype(np.uint64)
    parts = [(key[a : a + 50], sid[a : a + 50], sid[a : a + 50].astype(np.int64) + 7, key[a : a + 50].astype(np.int64) + 3) for a in range(0, 300, 50)]
    sent = [p for a in (0, 2, 4) for p in zip(*similar.key_packets(parts[a : a + 2], 4).to_pydict().values(), strict=True)]
    got = [r for s in range(4) if (mine := [p for n, p in sent if n == s]) for b in similar.crowds(s, iter(mine)) for r in b.to_pylist()]
    want = {}
    for k, s in zip(key.tolist(), sid.tolist(), strict=True):
        want.setdefault(k, set()).add(s)
    assert sorted((r["place"] - 3, r["sid"]) for r in got) == sorted((k, s) for k, v in want.items() if len(v) > 1 for s in v)
    pivots = {(r["key"], r["p_sid"], r["p_n"] - 7, r["p_place"]) for r in got}
    assert len(pivots) == len({r["key"] for r in got}) and all(s == n and s in want[p - 3] for _, s, n, p in pivots)


def test_sets_without_room_leave_their_buckets():
    """A bucket's member goes if no other can be similar by sizes and places, as the members of a very common line; none goes that some other can be similar to."""
    rng = np.random.default_rng(10)
    key, n = rng.integers(0, 30, 600).astype(np.uint64), rng.integers(1, 200, 600)
    sid, place = np.arange(1, 601).astype(np.uint64), (n * rng.uniform(0, 0.22, 600)).astype(np.int64)
    n, place = np.append(n, np.arange(60, 260)), np.append(place, np.arange(60, 260) // 6)  # 200 sets that meet far behind in their prefixes
    key, sid = np.append(key, np.full(200, 99, np.uint64)), np.append(sid, np.arange(1000, 1200).astype(np.uint64))
    sent = similar.key_packets([(key, sid, n, place)], 2).to_pydict()
    got = [(r["n"], r["place"], r["sid"]) for s, p in zip(*sent.values(), strict=True) for b in similar.crowds(s, iter([p]), 0.8) for r in b.to_pylist()]
    rows = list(zip(key.tolist(), n.tolist(), place.tolist(), sid.tolist(), strict=True))
    most = lambda x, y: min(x[1] - x[2], y[1] - y[2])
    want = {x[1:] for x in rows for y in rows if x[0] == y[0] and x[3] != y[3] and most(x, y) >= 0.8 * (x[1] + y[1] - most(x, y)) - 1e-9}
    assert len(got) == len(set(got)) and want and want <= set(got)
    assert all(n - place >= 0.8 * (n + place) - 0.01 for n, place, _ in set(got) - want)  # those that have room for a set like themselves
    assert not any(1000 <= s for _, _, s in got)


def test_a_large_group_of_near_copies_makes_few_pairs(spark, monkeypatch):
    """Copies of a text with edits of their own, most of them near 0.8 of each other: pairs left to compare don't grow with the square of the group, and the result is that of all pairs."""
    rng = random.Random(11)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(500):
        copy = list(base)
        for at in rng.sample(range(150), rng.choice((1, 2, 2, 3, 3, 4, 5))):
            copy[at] = f"edit{rng.randrange(10**9)}"
        rows.append((i, " ".join(copy)))
    made, across, keep = [], [], similar.durable

    def counted(df):
        out = keep(df)
        made.append((df.columns, out.count()))
        return out

    def watched(*args, **more):
        out = pairs_across(*args, **more)
        across.append(out.count())
        return out

    monkeypatch.setattr(similar, "durable", counted)
    monkeypatch.setattr(similar, "pairs_across", watched)
    kept = similar.one_of_similar(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4))
    assert sorted(r.doc_id for r in kept.collect()) == slow_stay(rows)
    left = [n for columns, n in made if columns == ["a", "b", "bits"]]
    assert len(left) == 1 and left[0] <= 500 and across[0] <= 20 * 500


def test_wide_signatures_rule_out_only_what_is_not_similar():
    rng = np.random.default_rng(12)
    for n, m, shared in ((1, 1, 1), (3, 70, 2), (64, 65, 60), (700, 800, 690), (5000, 5000, 4500), (5000, 4000, 0), (20_000, 20_000, 4000)):
        values = np.unique(rng.integers(0, 1 << 63, n + m - shared).astype(np.uint64))
        rng.shuffle(values)
        apart = similar.bits_apart(similar.wide_parity(np.sort(values[:n])), similar.wide_parity(np.sort(values[n - shared :])))
        assert apart <= n + m - 2 * shared
        assert shared >= 0.5 * n or apart > (n + m) / 9  # more than sets of similarity 0.8 can differ in


@pytest.mark.parametrize("made", (True, False))
def test_sets_of_long_texts_with_a_common_passage_stay_at_home(spark, monkeypatch, made):
    """Where the sketch is full, or so full that it isn't made, a passage that long texts share proposes pairs, but their sets don't travel for it."""
    rng = random.Random(13)
    rows = []
    for i in range(42):
        own = [f"w{rng.randrange(10**9)}" for _ in range(1500)]
        own[700:730] = [f"passage{i // 3}word{j}" for j in range(30)]
        rows.append((i, " ".join(own)))
    rows.append((42, rows[0][1] + " end"))
    fetched, star, keep = [], [], similar.durable

    def counted(df):
        out = keep(df)
        if "set" in out.columns:
            fetched.append(out.count())
        if {"key", "place"} <= set(out.columns):
            star.append(out.count())
        return out

    monkeypatch.setattr(similar, "durable", counted)
    monkeypatch.setattr(sketch, "merged", lambda partials, width: b"\xff" * (3 << width - 3))
    monkeypatch.setattr(similar, "FULL", 4 if made else 0)
    kept = similar.one_of_similar(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4))
    assert sorted(r.doc_id for r in kept.collect()) == slow_stay(rows) == list(range(42))
    assert star[0] > 42 and 2 <= sum(fetched) <= 4


def test_sketch_never_underestimates():
    rng = np.random.default_rng(3)
    items = rng.integers(0, 1 << 63, 5000).astype(np.uint64)
    items = np.concatenate((items, items[:500]))
    for row in range(3):
        assert len(np.unique(sketch.cells(items, row, 20))) > 4000
    for at in ([], [0], [5, 6, 260, 261, 516, 1000], list(range(300)), [255, 511, 100_000]):
        assert sketch.places(sketch.gaps(np.array(at, np.int64))).tolist() == at
    assert sketch.log_width(1) == 18 and sketch.log_width(1 << 40) == 28


@pytest.mark.parametrize("bits", [28, 18])
def test_substring(odd_docs, no_docs, bits):
    got = substring.remove_repeats(odd_docs, width=20, most_bits=bits, cleaned=True).collect()
    docs = [(r.doc_id, (r.text or "").encode().split()) for r in odd_docs.collect()]
    count = Counter(tuple(w[i : i + 20]) for _, w in docs for i in range(len(w) - 19))
    want = []
    for i, w in docs:
        gone = {j for k in range(len(w) - 19) if count[tuple(w[k : k + 20])] > 1 for j in range(k, k + 20)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        want.append((i, len(w), len(gone), sha(kept), kept.decode()))
    key = lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:]))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert substring.remove_repeats(no_docs).collect() == []


def slow_suffix(docs, width):
    last = 1 << 62
    least = {}
    rank = lambda i: last if i is None else i
    for i, t in docs:
        for k in range(len(t) - width + 1):
            least[t[k : k + width]] = min(rank(i), least.get(t[k : k + width], last))
    out = []
    for i, t in docs:
        mask = bytearray(len(t))
        for k in range(len(t) - width + 1):
            if least[t[k : k + width]] < rank(i):
                mask[k : k + width] = b"\1" * width
        spans = sum(mask[j] and not (j and mask[j - 1]) for j in range(len(t)))
        out.append((i, len(t), sum(mask), spans, sha(bytes(x for x, m in zip(t, mask) if not m))))
    return out


def test_suffix(odd_docs, no_docs):
    got = suffix.remove_earlier(odd_docs).collect()
    want = slow_suffix([(r.doc_id, (r.text or "").encode()) for r in odd_docs.collect()], 50)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert suffix.remove_earlier(no_docs).collect() == []


@pytest.mark.parametrize("width", [58, 140, 255])
def test_suffix_of_other_widths(spark, width):
    rng = np.random.default_rng(width)
    letters = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    base = letters(1500)
    docs = [(2, base), (5, letters(90) + base[200:900] + letters(40)), (1, base[1000 : 1000 + width] + letters(300)), (7, base[: width - 1]), (None, base), (9, "a" * 700), (4, "a" * 400)]
    got = suffix.remove_earlier(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), width=width).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(tuple, got), key=key) == sorted(slow_suffix([(i, t.encode()) for i, t in docs], width), key=key)


def test_long_texts_are_looked_at_in_pieces(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = "".join(map(chr, rng.integers(97, 110, 3000)))
    docs = [(1, base), (2, "x" + base[500:2500] + "y"), (3, base[::-1] + base[100:200])]
    monkeypatch.setattr(suffix, "PIECE", 400)
    texts = [t.encode() for _, t in docs]
    seen = {(int(n), int(p)) for data, number, place, limits in suffix._pieces(texts, 50) for s, e, _, _ in [suffix.stretches(data, limits, 50)] for a, b in zip(s, e) for n, p in zip(number[a:b], place[a:b])}
    assert seen == {(i, k) for i, t in enumerate(texts) for k in range(len(t) - 49)}


def test_merge_sort_orders_and_survives_collisions(monkeypatch):
    rng = np.random.default_rng(5)
    for base in (suffix.BASE, np.uint64(0)):  # with base 0 every prefix has one hash
        monkeypatch.setattr(suffix, "BASE", base)
        bucket = np.sort(rng.integers(0, 12, 300))
        length = rng.integers(0, 9, 300)
        text = rng.integers(97, 99, (300, 8)).astype(np.uint8)
        order, common = suffix.merge_sort(bucket, text, length)
        key = lambda i: text[i, : length[i]].tobytes()
        for j in range(1, 300):
            a, b = order[j - 1], order[j]
            if bucket[j] == bucket[j - 1]:
                assert key(a) <= key(b)
                n = 0
                while n < min(length[a], length[b]) and text[a, n] == text[b, n]:
                    n += 1
                assert common[j] == n
            else:
                assert common[j] == -1
        assert sorted(order.tolist()) == list(range(300))
