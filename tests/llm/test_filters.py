"""URL rules, benchmark leaks, languages and the language model."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from sylvan.llm import hmm, langid
from sylvan.llm.common import doc_crc, table
from sylvan.llm.decontaminate import SuffixAutomaton, contamination
from sylvan.llm.queries import URL_RULES
from sylvan.llm.urlfilter import filter_urls

SF = "/root/testdata/sf0.001"


def slow_rule(url, rules):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].lower(), m[2]) if m else ("", "")
    fits = [(len(h) + len(p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


def test_urls(spark):
    urls = [
        "http://www.example.com/en/x?y", "http://a.EXAMPLE.com/en/", "http://example.com/en", "https://x.net/es/1#z", "http://net/fr/", "http://x.net/de/", "com/", None, "",
        "http://", "http://com", "x://y.com?a/en/", "http://www.example.com/en/http://x.net/es/", "http://b.com/" + "p" * 3000, "http://notexample.com/en/", "http://a..com/",
    ]
    pages = spark.createDataFrame([(i if i % 5 else None, u, "h", "r") for i, u in enumerate(urls + urls[:2])], "page_id bigint, url string, host string, rule string")
    rules = spark.createDataFrame([*URL_RULES, (None, "/", "block"), ("x.net", "/d", "block"), ("y.com", "", "block")], "host string, path string, verdict string")
    known = [*URL_RULES, ("x.net", "/d", "block"), ("y.com", "", "block")]
    got = sorted(map(str, (tuple(r) for r in filter_urls(pages, rules).collect())))
    assert got == sorted(str((r.page_id, *slow_rule(r.url, known))) for r in pages.collect())
    assert {r.verdict for r in filter_urls(pages, rules.limit(0)).collect()} == {"allow"}
    assert filter_urls(pages.limit(0), rules).collect() == []


def words(text):
    return re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())


def slow_leaks(docs, items, window):
    out = []
    for i, text in docs:
        w, names, hit = words(text), [], set()
        for name, item in items:
            v = words(item)
            n, found = min(window, len(v)), False
            for a, b in itertools.product(range(len(v) - n + 1), range(len(w) - n + 1)) if n else ():
                if v[a : a + n] == w[b : b + n]:
                    found = True
                    hit |= set(range(b, b + n))
            if found:
                names.append("" if name is None else str(name))
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("most", [16 << 20, 200])
def test_decontamination(spark, odd_docs, no_docs, most):
    texts = [r.text for r in odd_docs.collect() if r.text]
    items = [(1, " ".join(texts[0].split()[5:25])), (2, "W1"), (None, "zz. W3, w4"), (4, ""), (5, None), (6, "A-b c!"), (7, "FRANÇAISE ici"), (1, "q"), (8, "ä" * 70), (9, texts[2])]
    bench = spark.createDataFrame([(*x, 1) for x in items], "item_id bigint, text string, n_words int")
    got = contamination(odd_docs, bench, max_item_bytes=most)
    want = slow_leaks([(r.doc_id, r.text) for r in odd_docs.collect()], items, 13)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    cut = {r.text: r.clean_text for r in contamination(odd_docs, bench, keep=["text"], clean=True).collect()}
    assert cut["a b c"] == "" and cut[None] is None and cut["..."] == "..." and cut[" \t\n"] == " \t\n"
    assert contamination(no_docs, bench).collect() == []
    assert {r.n_hit for r in contamination(odd_docs, bench.limit(0)).collect()} == {0}


def test_automaton_small_alphabet():
    rng = np.random.default_rng(6)
    for _ in range(150):
        items = [(str(i), [b"abc"[j : j + 1] for j in rng.integers(0, 3, rng.integers(0, 9))]) for i in range(6)]
        doc = [b"abcz"[j : j + 1] for j in rng.integers(0, 4, 25)]
        machine = SuffixAutomaton(items, 4)
        spans, found = machine.scan(doc)
        hit, names = set(), set()
        for name, v in items:
            n = min(4, len(v))
            for a, b in itertools.product(range(len(v) - n + 1), range(len(doc) - n + 1)) if n else ():
                if v[a : a + n] == doc[b : b + n]:
                    hit |= set(range(b, b + n))
                    names.add(name)
        assert {j for a, b in spans for j in range(a, b)} == hit
        assert {machine.names[i] for i in found} == names


def test_languages(spark, odd_docs, no_docs):
    docs = table(spark, SF, "documents")
    held = doc_crc("doc_id") % 4 == 2
    got = langid.identify(docs, docs.where(~held), keep=["doc_id", "lang", held.alias("held_out")]).toPandas()
    mine = got[got.held_out]
    assert (mine.lang == mine.lang_pred).mean() > 0.95 and got.score.between(0, 1).all()
    odd = langid.identify(odd_docs, odd_docs, keep=["text", "lang"]).collect()
    assert len(odd) == odd_docs.count()
    for r in odd:
        assert (r.lang_pred == "und") == (not re.search(r"[^\W\d_]", r.text or ""))
    assert {r.lang_pred for r in langid.identify(odd_docs, no_docs).collect()} == {"und"}
    assert langid.identify(no_docs, odd_docs).collect() == []


def test_mixture_of_two_languages():
    ll = np.log(np.array([[0.9, 0.1, 0.01]] * 30 + [[0.1, 0.9, 0.01]] * 20 + [[0.9, 0.1, 0.1]] * 10))
    owner = np.repeat([0, 1], [50, 10])
    share, sets = langid.infer(ll, owner, 3, rounds=50)
    assert sets[0] == [0, 1] and sets[1] == [0]
    assert abs(share[0, 0] - 0.625) < 0.02


def test_mixture_of_six_languages():
    ll = np.log(np.full((240, 8), 0.01) + 0.9 * (np.arange(240)[:, None] // 40 == np.arange(8)))
    share, sets = langid.infer(ll, np.zeros(240, np.int64), 1)
    assert sorted(sets[0]) == list(range(6))
    close = np.log(np.array([[0.5, 0.4]] * 60 + [[0.4, 0.5]] * 40))  # languages that differ little settle late
    share, total = langid.mixtures(close, np.zeros(100, np.int64), 1, np.array([[0.5, 0.5]]))
    grid = np.linspace(0, 1, 2001)[:, None]
    best = np.log(grid * np.exp(close[:, 0]) + (1 - grid) * np.exp(close[:, 1])).sum(axis=1).max()
    assert best - total[0] < 0.011


def slow_hmm(model, seq):
    total, start, moves, emit = 0.0, np.zeros(2), np.zeros((2, 2)), np.zeros_like(model.emit)
    for path in itertools.product(range(2), repeat=len(seq)):
        p = model.start[path[0]] * model.emit[seq[0], path[0]]
        for a, b, x in zip(path, path[1:], seq[1:]):
            p *= model.moves[a, b] * model.emit[x, b]
        total += p
        start[path[0]] += p
        for a, b in zip(path, path[1:]):
            moves[a, b] += p
        for x, a in zip(seq, path):
            emit[x, a] += p
    return math.log(total), start / total, moves / total, emit / total


def test_forward_and_expected_counts():
    rng = np.random.default_rng(7)
    model = hmm.Hmm(np.array([0.3, 0.7]), np.array([[0.6, 0.4], [0.2, 0.8]]), rng.dirichlet([1] * 5, 2).T)
    texts = [rng.integers(0, 5, n) for n in (3, 1, 6, 4, 1)]
    value, counts = model.batch(texts, True)
    slow = [slow_hmm(model, t) for t in texts]
    assert np.allclose(value, [s[0] for s in slow])
    for i in range(3):
        assert np.allclose(counts[i], sum(s[i + 1] for s in slow))
    total = sum(math.exp(model.batch([np.array(s)], False)[0][0]) for s in itertools.product(range(5), repeat=3))
    assert abs(total - 1) < 1e-9


def test_long_texts_shape_the_states(spark):
    """Without a text of up to 20,000 bytes the states are fitted too: words that alternate are told apart by their neighbours."""
    rng = np.random.default_rng(4)
    rows = [(i, " ".join("ab"[j % 2] + "xyz"[rng.integers(3)] for j in range(8000))) for i in range(12)]
    got = hmm.score(spark.createDataFrame(rows, "doc_id bigint, text string"), states=3, frequent=50, endings=16, held_mod=5).collect()
    for r in got:
        assert r.score / r.n_tokens > -0.52 and r.base_score / r.n_tokens < -0.75  # log10 3 is 0.48, log10 6 is 0.78


def test_pair_counts_start():
    rng = np.random.default_rng(5)
    prior = np.full(6, 1 / 6)
    pairs = np.zeros((6, 6))
    pairs[:3, 3:] = pairs[3:, :3] = rng.integers(4900, 5100, (3, 3))
    model = hmm.from_pairs(hmm.Hmm.seeded(3, 6, prior), pairs, np.array([9, 9, 9, 0, 0, 0.0]), prior, rounds=300, settled=1e-9)
    assert model.moves.diagonal().max() < 0.05


def test_scores(spark, odd_docs, no_docs):
    for docs in (odd_docs, table(spark, SF, "documents")):
        got = hmm.score(docs, states=3, frequent=50, endings=16, rounds=1, sample=20).collect()
        rows = docs.collect()
        count = Counter()
        held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
        split = lambda t: [*(t or "").encode().lower().split(), b"\n"]
        for r in rows:
            if not held(r.doc_id):
                count.update(split(r.text))
        n, v = sum(count.values()), len(count)
        want = []
        for r in rows:
            w = split(r.text)
            want.append((str(r.doc_id), held(r.doc_id), len(w), sum(count[x] > 0 for x in w), n, round(sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 5)))
        assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == sorted(want)
        assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    big = [r for r in got if r.held_out]
    assert sum(r.score for r in big) > sum(r.base_score for r in big)  # on held-out texts the states help
    assert hmm.score(no_docs).collect() == []


def tiny_corpus():
    rng = np.random.default_rng(11)
    texts = [" ".join(rng.choice(["a", "b", "cat", "hat", "dog", "fog", "x"], rng.integers(0, 6))) for _ in range(40)]
    return [(i, t) for i, t in enumerate([*texts, texts[0], texts[1], "never seen"])]


def test_scores_against_enumeration(spark):
    """The whole model, from counts to scores, by loops over all state sequences."""
    rows = tiny_corpus()
    got = {r.doc_id: r for r in hmm.score(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), states=2, frequent=4, endings=8, rounds=2).collect()}
    split = lambda t: [*t.encode().split(), b"\n"]
    train = [split(t) for i, t in rows if zlib.crc32(str(i).encode()) % 10]
    count = Counter(w for t in train for w in t)
    top = sorted(count, key=lambda w: (w != b"\n", -count[w], w))[:4]
    kind = lambda w: top.index(w) if w in top else len(top) + zlib.crc32(w[-3:]) % 8
    total, types = np.zeros(8), np.zeros(8)
    for w, c in count.items():
        if w not in top:
            total[kind(w) - len(top)] += c
            types[kind(w) - len(top)] += 1
    prior = np.concatenate(([count[w] for w in top], total)) + 0.1
    prior /= prior.sum()
    pairs, first = np.zeros((len(prior), len(prior))), np.zeros(len(prior))
    for t in train:
        first[kind(t[0])] += 1
        for a, b in zip(t, t[1:]):
            pairs[kind(a), kind(b)] += 1
    model = hmm.from_pairs(hmm.Hmm.seeded(2, len(prior), prior, 42), pairs.astype(np.float32), first.astype(np.float32), prior)
    for _ in range(2):
        parts = [slow_hmm(model, [kind(w) for w in t]) for t in train]
        model = hmm.Hmm.from_counts(*(sum(p[i] for p in parts) for i in (1, 2, 3)), prior)
    for i, text in rows:
        words = split(text)
        inside = sum(0 if w in top else math.log10((count[w] + 0.1) / (total[kind(w) - len(top)] + 0.1 * (types[kind(w) - len(top)] + 1))) for w in words)
        assert abs(got[i].score - (slow_hmm(model, [kind(w) for w in words])[0] / math.log(10) + inside)) < 1e-4


def test_blocks_that_share_a_slice_add_up_apart(spark):
    rows = tiny_corpus() * 3
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    found = [sorted((r.doc_id, r.n_known, round(r.base_score, 6)) for r in hmm.score(docs, states=2, frequent=4, endings=8, rounds=1, **small).collect()) for small in ({}, {"slices": 1, "block_words": 5})]
    assert found[0] == found[1]


def slow_language(text, tables, names):
    """Set, proportions and score of one text by plain loops: EM until nothing moves, over nested sets."""
    low = f" {text.lower()} ".encode()
    spaced = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in low)
    words, now = [], None
    for i in range(1, len(spaced) - 1):
        if spaced[i] == 32:
            continue
        if spaced[i - 1] == 32:
            now = [0.0] * len(names)
            words.append(now)
        gram = ((spaced[i - 1] << 16 | spaced[i] << 8 | spaced[i + 1]) * 2654435761 % (1 << 32)) >> 16
        for j in range(len(names)):
            now[j] += tables[j].get(gram, tables[j][None])

    def em(langs):
        share = {j: 1 / len(langs) for j in langs}
        for _ in range(3000):
            new = dict.fromkeys(langs, 0.0)
            for w in words:
                top = max(w)
                mix = sum(share[j] * math.exp(w[j] - top) for j in langs)
                for j in langs:
                    new[j] += share[j] * math.exp(w[j] - top) / mix / len(words)
            moved = max(abs(new[j] - share[j]) for j in langs)
            share = new
            if moved < 1e-7:
                break
        return share, sum(max(w) + math.log(max(1e-300, sum(share[j] * math.exp(w[j] - max(w)) for j in langs))) for w in words)

    order = sorted(range(len(names)), key=lambda j, s=em(range(len(names)))[0]: (-s[j], j))
    tried = []
    for k in range(1, len(names) + 1):
        share, value = em(order[:k])
        tried.append((-2 * value + (k - 1) * math.log(max(2, len(words))), share))
    share = min(tried, key=lambda t: t[0])[1]
    best = max(share, key=lambda j: (share[j], -j))
    return names[best], (share[best] * len(words) + 0.5) / (len(words) + 0.5 * len(names)), {names[j] for j in share}


def test_languages_against_loops(spark):
    docs = table(spark, SF, "documents").where("length(text) < 1500").limit(40).collect()
    rows = [(i, r.text, r.lang) for i, r in enumerate(docs)]
    rows += [(100 + i, " ".join((a.text[:200], b.text[:120])), None) for i, (a, b) in enumerate(zip(docs, docs[5:]))][:12]
    counts = {}
    for _, text, lang in rows:
        if lang and text:
            spaced = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in f" {text.lower()} ".encode())
            for i in range(1, len(spaced) - 1):
                if spaced[i] != 32:
                    counts.setdefault(lang, Counter())[((spaced[i - 1] << 16 | spaced[i] << 8 | spaced[i + 1]) * 2654435761 % (1 << 32)) >> 16] += 1
    names = sorted(counts)
    totals = [sum(counts[n].values()) + 0.5 * (1 << 16) for n in names]
    tables = [{g: math.log((c + 0.5) / t) for g, c in counts[n].items()} | {None: math.log(0.5 / t)} for n, t in zip(names, totals)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    several = 0
    for r in langid.identify(frame, frame, keep=["doc_id", "text"]).collect():
        if r.lang_pred == "und":
            continue
        lang, score, chosen = slow_language(r.text, tables, names)
        assert r.lang_pred == lang and abs(r.score - score) < 0.01 and set(r.languages) == chosen and r.languages[0] == lang
        several += len(chosen) > 1
    assert several


def test_many_languages_stop_before_they_are_collected(spark):
    frame = spark.createDataFrame([(i, "abc", f"l{i}") for i in range(9)], "doc_id bigint, text string, lang string")
    with pytest.raises(ValueError):
        langid.train(frame, "text", "lang", max_languages=8)
    assert len(langid.train(frame, "text", "lang", max_languages=9)[0]) == 9
