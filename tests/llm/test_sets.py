"""Shards, exact search and mixtures, against brute force, and the pipeline."""

import hashlib
import zlib

import numpy as np
import pytest

import corpus_pipeline
from sylvan.llm import hamming, mixing
from sylvan.llm.common import table
from sylvan.llm.sharding import histogram_shards

SF = "/root/testdata/sf0.001"


def test_shards(spark, odd_docs, no_docs):
    for docs, n in ((odd_docs, 8), (table(spark, SF, "documents"), 8), (odd_docs, 1)):
        got = histogram_shards(docs, shards=n, keep=["doc_id", "text"]).collect()
        assert len(got) == docs.count()
        biggest = max(r.size for r in got)
        for s in range(n):
            mine = [r for r in got if r.shard == s]
            assert sorted(r.slot for r in mine) == list(range(len(mine)))
            assert abs(sum(r.size for r in mine) - sum(r.size for r in got) / n) <= 3 * biggest
        for r in got:
            assert r.size == len((r.text or "").encode()) + 1 and r.text_crc32 == zlib.crc32((r.text or "").encode())
    assert histogram_shards(no_docs).collect() == []


def test_a_large_group_is_split(spark):
    rows = [(i, "same text" if i % 2 else f"text {i}") for i in range(800)]
    got = histogram_shards(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    sizes = [sum(r.size for r in got if r.shard == s) for s in range(8)]
    assert max(sizes) - min(sizes) <= 20


def test_search(spark):
    rng = np.random.default_rng(8)
    for bits in (64, 20, 100):
        codes = ["".join(map(str, rng.integers(0, 2, bits))) for _ in range(400)]
        codes[5:9] = [codes[0]] * 4
        rows = [(i, c, 1) for i, c in enumerate(codes)] + [(None, codes[3], 1), (1000, None, 1), (1001, "01", 1)]
        frame = spark.createDataFrame(rows, "id bigint, code string, rank int").repartition(3)
        got = hamming.top_k(frame, frame.where("id % 100 = 0"), k=7, rows_per_index=150).collect()
        whole = [(i, c) for i, c, _ in rows if c and len(c) == bits]
        for q in (0, 100, 200, 300):
            far = sorted((sum(a != b for a, b in zip(c, codes[q])), i if i is not None else 1 << 62) for i, c in whole)[:7]
            mine = sorted((r.rank, r.distance, r.neighbor_id if r.neighbor_id is not None else 1 << 62) for r in got if r.query_id == q)
            assert [m[1:] for m in mine] == far
    assert hamming.top_k(frame.limit(0), frame, k=3).collect() == [] == hamming.top_k(frame, frame.limit(0), k=3).collect()
    assert len(hamming.top_k(frame, frame.where("id = 0"), k=10_000).collect()) == 401


def slow_mix(rows, weights=(5, 2, 1), share=1.5):
    size = lambda t: len((t or "").encode().split())
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(size(t) for _, t, x in rows if x == s) for s in names}
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, free, target = share * sum(sizes.values()), set(names), {}
    while free:
        unit = total / sum(weight[s] for s in free)
        over = {s for s in free if unit * weight[s] > 2 * sizes[s]}
        if not over:
            target |= {s: unit * weight[s] for s in free}
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            total -= target[s]
        free -= over
    return sizes, target


def test_mix(spark, odd_docs, no_docs):
    for docs in (odd_docs, table(spark, SF, "documents")):
        rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
        sizes, target = slow_mix(rows)
        got = mixing.mix(docs, keep=["doc_id", "source"]).collect()
        assert len(got) == len(rows)
        for s in sizes:
            mine = [r for r in got if r.source == s]
            assert sum(r.taken for r in mine) == int(target[s] + 0.5)
            assert all(r.source_size == sizes[s] and abs(r.target - target[s]) < 1e-6 and 0 <= r.taken <= 2 * r["size"] for r in mine)
        again = mixing.mix(docs.repartition(7), keep=["doc_id", "source"]).collect()
        assert sorted(map(str, again)) == sorted(map(str, got))
    assert mixing.mix(no_docs).collect() == []


def test_overlapping_sources(spark):
    """Shared documents serve the source that has nothing else."""
    flow = mixing.min_cost_flow([(frozenset("a"), 10), (frozenset("ab"), 10)], {"a": 10, "b": 10}, 2)
    assert flow[0, "a"] == 10 and flow[1, "b"] == 10
    flow = mixing.min_cost_flow([(frozenset("ab"), 10), (frozenset("b"), 10)], {"a": 5, "b": 20}, 2)
    assert flow[0, "a"] == 5 and flow[0, "b"] + flow[1, "b"] == 20 and flow[1, "b"] >= 10
    frame = spark.createDataFrame([(1, "a b c d", ["x"]), (2, "e f", ["x", "y"]), (3, "g", None)], "doc_id int, text string, source array<string>")
    got = {r.doc_id: r for r in mixing.mix(frame, weights=(1,), share=1.0).collect()}
    assert all(r.taken <= 2 * r["size"] for r in got.values())


def test_pipeline(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        docs = corpus_pipeline.written(stage(spark, docs, SF))
        after = docs.collect()
        assert docs.columns == columns and {r.doc_id for r in after} <= set(before)
        if name == "near_dedup":
            assert len({r.text for r in after}) == len(after)
        if name in ("language", "near_dedup", "mixture"):
            assert all(r == before[r.doc_id] for r in after)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert len(last) == len(after) and {r.shard for r in last} == set(range(8))
    whole = corpus_pipeline.run(spark, SF).collect()
    digest = lambda rows: hashlib.sha256(repr(sorted(map(str, rows))).encode()).hexdigest()
    assert digest(whole) == digest(last)


def test_the_language_stage_uses_what_it_infers(spark):
    docs = table(spark, SF, "documents")
    french = docs.where("lang = 'fr' and length(text) > 500").orderBy("doc_id").limit(1)
    assert french.count() == 1
    rng = np.random.default_rng(9)
    junk = " ".join("".join(chr(0x4E00 + int(x)) for x in rng.integers(0, 20_000, 6)) for _ in range(80))
    odd = french.selectExpr("-1L doc_id", "text", "'en' lang", "source", "n_chars").unionByName(french.selectExpr("-2L doc_id", "text", "cast(null as string) lang", "source", "n_chars"))
    odd = odd.unionByName(spark.createDataFrame([(-3, junk, None, "s", len(junk))], "doc_id bigint, text string, lang string, source string, n_chars bigint"))
    got = {r.doc_id: r.lang for r in corpus_pipeline.language(spark, docs.select(*odd.columns).unionByName(odd), SF).collect()}
    assert got[-1] == "fr" and got[-2] == "fr" and -3 not in got
    assert len(got) >= 0.95 * docs.count()


def test_pipeline_with_odd_rows(spark, odd_docs, no_docs):
    """All columns of odd_docs, and others with the names that stages make, pass through every stage."""
    clash = ["score", "n_hit", "languages", "lang_pred", "gain", "__text", "__hash", "__id", "__rows", "slot", "size_", "c0", "copies", "__copies", "text_crc32"]
    odd = odd_docs.selectExpr("*", *[f"concat('{c}', doc_id) `{c}`" for c in clash], "map('k', doc_id) m", "struct(doc_id) st")
    for docs in (odd, odd.limit(0), odd_docs.select("doc_id", "text", "lang", "source", "n_chars"), no_docs.select("doc_id", "text", "lang", "source", "n_chars")):
        columns, some = docs.columns, docs.count()
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.written(stage(spark, docs, SF))
            made = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"] if name == "shards" else []
            assert len(docs.columns) == len(columns) + len(made) == len({c.lower() for c in docs.columns})
            if name != "shards":
                assert docs.columns == columns
                assert all(r[c] is None or r[c] == f"{c}{r.doc_id}" for r in docs.collect() for c in clash if c in columns)
        assert (docs.count() > 0) == (some > 0)


@pytest.mark.parametrize("name", ["op1_simhash", "op2_substring", "op3_suffix", "op4_sharding", "op6_decontamination", "op8_hmm", "op9_language", "op10_mixing"])
def test_registered_queries_give_a_row_for_each_document(spark, name):
    from sylvan.llm.queries import QUERIES

    got = [r.doc_id for r in QUERIES[name](spark, SF).select("doc_id").collect()]
    assert sorted(got) == sorted(r.doc_id for r in table(spark, SF, "documents").select("doc_id").collect())


@pytest.mark.parametrize("name", ["op5_url_filter", "op7_topk", "op10_mixing", "op4_sharding", "op6_decontamination"])
def test_registered_queries(spark, name):
    from sylvan.llm.queries import QUERIES

    assert QUERIES[name](spark, SF).count() > 0


def test_equal_codes_and_many_queries(spark):
    """A dense group of one code costs what k of its rows cost, and more queries don't make a larger plan."""
    rng = np.random.default_rng(3)
    codes = ["01" * 32] * 5000 + ["".join(map(str, rng.integers(0, 2, 64))) for _ in range(300)]
    frame = spark.createDataFrame(list(enumerate(codes)), "id bigint, code string").repartition(4)
    got = hamming.top_k(frame, frame.where("id % 100 = 0"), k=5, rows_per_index=2000, query_block=8)
    found = {}
    for r in got.collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.distance, r.neighbor_id))
    assert set(found) == set(range(0, 5300, 100))
    for q, rows in found.items():
        far = sorted((sum(a != b for a, b in zip(codes[q], c)), i) for i, c in enumerate(codes))[:5]
        assert sorted(rows) == [(j + 1, d, i) for j, (d, i) in enumerate(far)]
    plan = lambda f: f._jdf.queryExecution().optimizedPlan().toString().count("\n")
    assert plan(got) == plan(hamming.top_k(frame, frame.where("id = 0"), k=5, rows_per_index=2000, query_block=8))


def test_a_hundred_thousand_equal_codes():
    bits = np.tile(np.array([0, 1], np.uint8), (100_000, 32))
    index, ids, _ = hamming._index([(np.arange(100_000)[::-1], np.zeros(100_000, bool), np.packbits(bits, axis=1))], 64, 10, 12)
    rows, far = index.search(bits[:100], 10)
    assert index.n == 10 and (far == 0).all() and (np.sort(ids[rows], axis=1) == np.arange(10)).all()
