"""Language identification: each text as a mixture of languages, inferred from n-gram likelihoods by expectation-maximisation."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

GRAMS = 1 << 16
LETTER = re.compile(r"[^\W\d_]")
#: Bytes that belong to words: ASCII letters and all bytes of non-ASCII characters; every other byte reads as a space.
_TO = np.array([b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)
PIECE = 1 << 20


def letter_grams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the byte trigram around each word byte, whether a word starts there), for lower-case text with spaces at both ends."""
    b = _TO[data].astype(np.uint32)
    inner = np.flatnonzero(b[1:-1] != 32) + 1
    grams = ((b[inner - 1] << 16 | b[inner] << 8 | b[inner + 1]) * np.uint32(2654435761)) >> np.uint32(16)
    return grams, b[inner - 1] == 32


def spaced(text: str) -> bytes:
    return b" " + text.lower().encode("utf-8", "replace") + b" "


def train(docs: DataFrame, text: str, lang: str, max_languages: int = 1000) -> tuple[list[str], np.ndarray]:
    """Languages, and log-probabilities of the trigram hashes in each (add-one half), from every row with a text and a language.

    A task adds its texts up in one count table for each language it met; the tables are summed as a DataFrame. The driver gets
    GRAMS counts for each language at most; with more than ``max_languages`` it stops before that with an error.
    """
    rows = docs.where(F.col(f"`{lang}`").isNotNull() & F.col(f"`{text}`").isNotNull()).select(F.col(f"`{text}`").cast("string"), F.col(f"`{lang}`").cast("string"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, np.ndarray] = {}
        for batch in batches:
            for value, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                table = tables.setdefault(name, np.zeros(GRAMS, np.int64))
                table += np.bincount(letter_grams(np.frombuffer(spaced(value), np.uint8))[0], minlength=GRAMS)
        for name, table in tables.items():
            at = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(table[at], pa.int64())], ["lang", "gram", "n"])

    many = rows.select(F.col(f"`{lang}`")).distinct().limit(max_languages + 1).count()
    if many > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    counts = arrow_map(rows, count, "lang string, gram int, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    found = counts.toArrow()
    names = sorted(set(found.column("lang").to_pylist()))
    number = {n: i for i, n in enumerate(names)}
    table = np.full((GRAMS, len(names)), 0.5)
    which = np.array([number[n] for n in found.column("lang").to_pylist()], np.int64)
    table[found.column("gram").to_numpy(), which] += found.column("n").to_numpy()
    return names, np.log(table / table.sum(axis=0)).astype(np.float32)


def mixtures(ll: np.ndarray, owner: np.ndarray, n: int, start: np.ndarray, rounds: int | None = None, settled: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
    """(proportions, log-likelihood) of n texts whose words have log-likelihoods ``ll`` by language, after EM from ``start``.

    ``owner`` is sorted; a zero in ``start`` stays zero, which restricts a text to a set of languages. A text is done when its
    log-likelihood is within ``settled`` of the greatest one: it can't gain more than words * (largest factor of a proportion
    in a round - 1), as it is concave in the proportions. ``rounds`` ends EM earlier.
    """
    top = ll.max(axis=1, keepdims=True)
    like = np.exp((ll - top).astype(np.float64))
    words = np.bincount(owner, minlength=n).astype(np.float64)
    first = np.searchsorted(owner, np.arange(n))
    full = words > 0
    share = start.astype(np.float64)
    open_, mine, at = np.flatnonzero(full), like, np.repeat(np.arange(int(full.sum())), words[full].astype(np.int64))
    done = 0
    while len(open_) and done != rounds:
        now = share[open_]
        mixed = np.einsum("ij,ij->i", mine, now[at])
        begin = np.searchsorted(at, np.arange(len(open_)))
        factor = np.add.reduceat(mine / np.maximum(mixed, 1e-300)[:, None], begin, axis=0) / words[open_, None]
        share[open_] = now * factor
        done += 1
        left = words[open_] * (np.where(now > 0, factor, 0).max(axis=1) - 1) > settled
        if not left.all():
            pick, place = left[at], np.cumsum(left) - 1
            open_, mine, at = open_[left], mine[pick], place[at[pick]]
    value = np.log(np.maximum((like * share[owner]).sum(axis=1), 1e-300)) + top[:, 0]
    total = np.zeros(n)
    total[full] = np.add.reduceat(value, first[full])
    return share, total


def infer(ll: np.ndarray, owner: np.ndarray, n: int, rounds: int | None = None, penalty: float = 1.0) -> tuple[np.ndarray, list[list[int]]]:
    """Proportions of the languages of each text's set, estimated inside the set, and the sets by falling proportion.

    Sets are nested by the proportions of a mixture of all languages; the chosen one has the least -2 log-likelihood + penalty *
    (size - 1) * log(words). Sets of any size are tried, until even the likelihood of all languages together would not pay for the
    next size.
    """
    langs = ll.shape[1]
    share, total = mixtures(ll, owner, n, np.full((n, langs), 1 / langs), rounds)
    rank = np.argsort(-share, axis=1, kind="stable")
    words = np.bincount(owner, minlength=n)
    cost = penalty * np.log(np.maximum(words, 2))
    one = np.zeros((n, langs))
    one[np.arange(n), rank[:, 0]] = 1
    alone = mixtures(ll, owner, n, one, 0)[1]
    best, size, inside = -2 * alone, np.ones(n, np.int64), one
    for k in range(2, langs + 1):
        open_ = np.flatnonzero(-2 * total + (k - 1) * cost < best)
        if not len(open_):
            break
        place = np.full(n, -1)
        place[open_] = np.arange(len(open_))
        pick = place[owner] >= 0
        start = np.zeros((len(open_), langs))
        start[np.arange(len(open_))[:, None], rank[open_, :k]] = 1 / k
        estimate, value = mixtures(ll[pick], place[owner[pick]], len(open_), start, rounds)
        value = -2 * value + (k - 1) * cost[open_]
        better = value < best[open_]
        best[open_[better]], size[open_[better]], inside[open_[better]] = value[better], k, estimate[better]
    sets = [rank[i, : size[i]] for i in range(n)]
    return inside, [s[np.lexsort((s, -inside[i, s]))].tolist() for i, s in enumerate(sets)]


def word_likelihoods(table: np.ndarray, grams: np.ndarray, first: np.ndarray, step: int = 1 << 15) -> np.ndarray:
    """Log-likelihood of each word (those begin at ``first``) in each language, some words at a time: a long text's trigrams times languages are never held."""
    ends = np.append(first, len(grams))
    parts = [np.add.reduceat(table[grams[ends[i] : ends[min(i + step, len(first))]]], first[i : i + step] - first[i], axis=0) for i in range(0, len(first), step)]
    return np.concatenate(parts)


def identify(docs: DataFrame, training: DataFrame, text: str = "text", lang: str = "lang", keep: list[F.Column | str] | None = None, rounds: int | None = None, gain: bool = False) -> DataFrame:
    """Columns ``keep``, then lang_pred, score and languages (the chosen set, by falling proportion), for each row of docs.

    lang_pred is the language of the chosen set with the largest proportion, estimated inside the set; score is that proportion,
    smoothed by half a word for each language, so that few words give less. EM runs until it settles (or for ``rounds``), and sets may hold any number of languages. A null text, or one without a letter, is ``und`` with score 0 and no languages; so is every
    text if no training row has a text and a language. Ties go to the first language in code point order. Other columns play
    no part in a prediction; repeated rows get equal predictions; an empty table gives an empty one.

    With ``gain`` a last column says by how much (natural log, a letter byte) the mixture of the chosen languages explains the text better
    than trigram hashes drawn evenly would; null for ``und``. Where it isn't above 0, no learned language explains the text.
    """
    keep = ["doc_id"] if keep is None else keep
    names, table = train(training, text, lang)
    sent = docs.sparkSession.sparkContext.broadcast(table)
    rows = docs.select(*keep, F.col(f"`{text}`").cast("string").alias("__text"))
    kept = rows.columns[:-1]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), "lang_pred string, score double, languages array<string>", *(["gain double"] if gain else [])])

    def predict(texts: list[str | None]) -> list[tuple[str, float, list[str], float | None]]:
        out: list[tuple[str, float, list[str], float | None]] = [("und", 0.0, [], None)] * len(texts)
        group: list[int] = []
        size = 0
        for i, value in enumerate([*texts, None]):
            last = i == len(texts)
            if not last and names and value and LETTER.search(value):
                group.append(i)
                size += len(value)
            if group and (last or size >= PIECE):
                parts = [spaced(texts[j]) for j in group]
                grams, starts = letter_grams(np.frombuffer(b"".join(parts), np.uint8))
                letters = [int((_TO[np.frombuffer(p, np.uint8)] != 32).sum()) for p in parts]
                first = np.flatnonzero(starts)
                owner = np.repeat(np.arange(len(group)), letters)[first]
                ll = word_likelihoods(sent.value, grams, first)
                share, sets = infer(ll, owner, len(group), rounds)
                words = np.bincount(owner, minlength=len(group))
                fit = mixtures(ll, owner, len(group), share, 0)[1] / np.maximum(letters, 1) + np.log(GRAMS) if gain else [None] * len(group)
                for j, i_text in enumerate(group):
                    p = share[j, sets[j][0]]
                    out[i_text] = (names[sets[j][0]], float((p * words[j] + 0.5) / (words[j] + 0.5 * len(names))), [names[x] for x in sets[j]], fit[j])
                group, size = [], 0
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = predict(batch.column(len(kept)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.list_(pa.string())), *([pa.array([g[3] for g in got], pa.float64())] if gain else [])], [*kept, "lang_pred", "score", "languages", *(["gain"] if gain else [])])

    return arrow_map(rows, run, schema)
