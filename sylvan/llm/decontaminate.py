"""Benchmark decontamination with a generalised suffix automaton over the words of the test items."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, as_bytes

#: Words after A-Z are lower-cased: ASCII letters and digits, and every byte of a non-ASCII character.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: bytes | None) -> list[bytes]:
    return WORD.findall(text.lower()) if text else []


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences.

    States hold the longest length, the suffix link and the transitions. A state that holds the window-long suffix of others, their
    head, knows the items in which that window occurs; every state knows the items that are, as a whole, a suffix of its strings
    and shorter than a window. Built from dictionaries, it is kept as one flat table of transitions, which is what workers hold.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int) -> None:
        self.window, self.ids = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        marks: list[tuple[int, int]] = []
        self.names = [name for name, words in items if words]
        self.shortest = min([min(window, len(words)) for _, words in items if words], default=window)
        ends: list[tuple[int, int, int]] = []
        for number, (_, words) in enumerate(x for x in items if x[1]):
            state = 0
            for word in words:
                state = self._extend(state, self.ids.setdefault(word, len(self.ids) + 1))
                marks.append((state, number))
            if len(words) < window:
                ends.append((state, len(words), number))
        order = sorted(range(1, len(self.next)), key=self.length.__getitem__)
        self.heads: list[int] = [0] * len(self.next)  # the state that holds the window-long suffix, 0 if shorter
        whole: dict[int, list[tuple[int, int]]] = {}
        for state, n, number in ends:
            whole.setdefault(state, []).append((n, number))
        self.whole: dict[int, list[tuple[int, int]]] = {}
        for s in order:
            above = self.link[s]
            self.heads[s] = self.heads[above] or (s if self.length[s] >= window else 0)
            if short := whole.get(s, []) + self.whole.get(above, []):
                self.whole[s] = short
        found: dict[int, set[int]] = {}
        for state, number in marks:
            if head := self.heads[state]:
                found.setdefault(head, set()).add(number)
        self.items = {head: tuple(numbers) for head, numbers in found.items()}
        self.step = {s << 32 | word: to for s, following in enumerate(self.next) for word, to in following.items()}
        self.next = []

    def _extend(self, last: int, word: int) -> int:
        if (to := self.next[last].get(word)) is not None:
            if self.length[to] == self.length[last] + 1:
                return to
            return self._clone(last, word, to)
        now = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = now
            p = self.link[p]
        if p >= 0:
            to = self.next[p][word]
            self.link[now] = to if self.length[to] == self.length[p] + 1 else self._clone(p, word, to)
        return now

    def _state(self, length: int, following: dict[int, int], link: int) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _clone(self, p: int, word: int, to: int) -> int:
        twin = self._state(self.length[p] + 1, dict(self.next[to]), self.link[to])
        self.link[to] = twin
        while p >= 0 and self.next[p].get(word) == to:
            self.next[p][word] = twin
            p = self.link[p]
        return twin

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans (start, end) of window occurrences in a word sequence, merged, and the numbers of the items they come from.

        The words stream through the automaton, which keeps the longest suffix that occurs in an item. Runs of words that
        occur in no item, or runs shorter than the shortest window, can hold no window and are passed over.
        """
        known = np.fromiter(map(self.ids.get, words, [0] * len(words)), np.int64, len(words))
        edge = np.flatnonzero(np.diff(np.concatenate(([0], known != 0, [0])).astype(np.int8)))
        spans: list[tuple[int, int]] = []
        hit: set[int] = set()
        step = self.step
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a < self.shortest:
                continue
            state = matched = 0
            for i, word in enumerate(known[a:b].tolist(), a):
                while (to := step.get(state << 32 | word)) is None and state:
                    state = self.link[state]
                    matched = self.length[state]
                if to is not None:
                    state, matched = to, matched + 1
                longest = 0
                if matched >= self.window:
                    # the window-long suffix of the match lies in the state that heads this chain
                    longest = self.window
                    hit.update(self.items[self.heads[state]])
                for n, number in self.whole.get(state, ()):
                    if n <= matched:
                        longest = max(longest, n)
                        hit.add(number)
                if longest:
                    start = i + 1 - longest
                    while spans and spans[-1][1] >= start and spans[-1][0] >= start:
                        spans.pop()
                    if spans and spans[-1][1] >= start:
                        spans[-1] = (spans[-1][0], i + 1)
                    else:
                        spans.append((start, i + 1))
        return spans, hit



def _items_in_blocks(items: DataFrame, item_id: str, text: str, max_bytes: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items as (id, words), in blocks of bounded size: hash classes of the items, whose number follows their total size."""
    known = items.select(F.col(f"`{item_id}`").cast("string").alias("id"), F.col(f"`{text}`").cast("string").alias("text")).where("text is not null")
    total = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-2 * total // max_bytes)) if total > max_bytes else 1
    for block in range(blocks):
        part = known.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block)
        yield [(r.id, words_of(r.text.encode())) for r in part.orderBy("id", "text").collect()]


def contamination(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 13, share: int = 20, keep: list[str] | None = None, clean: bool = False, max_item_bytes: int = 2 << 20) -> DataFrame:
    """Columns ``keep``, then n_words, n_hit, n_items, items_sha256, contaminated, and with ``clean`` the text without hit spans.

    The automaton of the items is broadcast. Its size is bounded (some 60 bytes in a worker for each byte of ``max_item_bytes``): items beyond that are taken in blocks, each with
    its own automaton, and the spans of earlier blocks travel with the rows. A document is contaminated if it has a hit word and
    its hit words are 1 / ``share`` of its words at least. ``clean`` gives the text with the bytes from the first to the last
    word of every hit span removed. Null and wordless texts have no words and are never contaminated; items without words match
    nothing; items with a null id match and are named by the empty string; repeated items count once each; extra columns of
    either table are ignored; an empty table on either side is fine.
    """
    keep = ["doc_id"] if keep is None else keep
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields]
    spark = docs.sparkSession
    rows = rows.withColumn("__spans", F.lit(b"")).withColumn("__names", F.array().cast("array<string>"))
    middle = ", ".join([*fields, "__spans binary", "__names array<string>"])
    for block in _items_in_blocks(items, item_id, item_text, max_item_bytes):
        sent = spark.sparkContext.broadcast(SuffixAutomaton([(i or "", w) for i, w in block], window))
        rows = arrow_map(rows, _scanner(sent), middle)
    end = ", ".join([*fields[:-1], "n_words bigint", "n_hit bigint", "n_items bigint", "items_sha256 string", "contaminated boolean", *(["clean_text string"] if clean else [])])
    return arrow_map(rows, _finisher(share, clean), end)


def _scanner(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = sent.value
        for batch in batches:
            spans, names = [], []
            before = zip(as_bytes(batch.column(batch.num_columns - 3)), batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True)
            for text, old, named in before:
                found, hit = automaton.scan(words_of(text))
                spans.append(old + np.array(found, np.int64).tobytes())
                names.append(named + [automaton.names[i] for i in sorted(hit)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(spans, pa.binary()), pa.array(names, pa.list_(pa.string()))], batch.schema.names)

    return run


def _finisher(share: int, clean: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, hits, count, digest, bad, kept = [], [], [], [], [], []
            k = batch.num_columns
            for text, raw, names in zip(as_bytes(batch.column(k - 3)), batch.column(k - 2).to_pylist(), batch.column(k - 1).to_pylist(), strict=True):
                places = [m.span() for m in WORD.finditer(text.lower())] if text and (raw or clean) else []
                n = len(places) if places or not text else len(words_of(text))
                spans = np.frombuffer(raw, np.int64).reshape(-1, 2)
                mask = np.zeros(n, bool)
                for a, b in spans.tolist():
                    mask[a:b] = True
                n_hit = int(mask.sum())
                total.append(n)
                hits.append(n_hit)
                count.append(len(names))
                digest.append(hashlib.sha256(",".join(sorted(names)).encode()).hexdigest())
                bad.append(n_hit > 0 and share * n_hit >= n)
                if clean:
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask, [0])).astype(np.int8)))
                    at, out = 0, []
                    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                        out.append(text[at : places[a][0]])
                        at = places[b - 1][1]
                    kept.append(None if text is None else (b"".join(out) + text[at:]).decode())
            columns = [*batch.columns[:-3], pa.array(total, pa.int64()), pa.array(hits, pa.int64()), pa.array(count, pa.int64()), pa.array(digest, pa.string()), pa.array(bad, pa.bool_())]
            names = [*batch.schema.names[:-3], "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
            if clean:
                columns, names = [*columns, pa.array(kept, pa.string())], [*names, "clean_text"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run
