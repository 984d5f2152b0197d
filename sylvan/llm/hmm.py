"""Hidden Markov language model: Baum-Welch over word classes, with exact word counts inside a class.

The model of a text is P(classes) * product of P(word | class). Frequent words are classes of their own; the others share a
class by their ending, and the share of a word in its class comes from its exact corpus count. The class sequence, with an
end symbol, comes from a hidden Markov model; its parameters have a bounded size, and its expected counts are summed over
all partitions in each round.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, as_bytes, doc_crc, durable
from .packets import PACKET, by_slice, pack, packets, unpack

END = b"\n"  # no word contains it
ADD = 0.1


class Hmm:
    """Parameters: start (K), moves (K x K), emit (C x K: probability of a class in each state)."""

    def __init__(self, start: np.ndarray, moves: np.ndarray, emit: np.ndarray) -> None:
        self.start, self.moves, self.emit = start, moves, emit

    @classmethod
    def seeded(cls, states: int, classes: int, prior: np.ndarray, seed: int = 42) -> Hmm:
        noise = np.random.default_rng(seed).gamma(1.0, size=(classes, states)) + 0.1
        emit = noise * prior[:, None]
        moves = np.random.default_rng(seed + 1).gamma(1.0, size=(states, states)) + 0.1  # without order: states that stay would hold on to it
        return cls(np.full(states, 1 / states), moves / moves.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))

    @classmethod
    def from_counts(cls, start: np.ndarray, moves: np.ndarray, emit: np.ndarray, prior: np.ndarray) -> Hmm:
        """Counts to probabilities; every state borrows a few tokens from the prior over classes, so nothing is impossible."""
        smooth = emit + 10 * prior[:, None]
        return cls((start + 0.5) / (start + 0.5).sum(), (moves + 0.5) / (moves + 0.5).sum(axis=1, keepdims=True), smooth / smooth.sum(axis=0))

    def batch(self, texts: list[np.ndarray], learn: bool) -> tuple[np.ndarray, tuple[np.ndarray, ...] | None]:
        """Log-likelihoods (natural) of class sequences by the scaled forward recursion; with ``learn`` also the expected counts.

        Texts are laid out step by step, longest first, so that one step treats all texts that are that long at once. Expected
        counts are made of single-precision terms, added up in double precision; likelihoods alone are computed in double precision.
        """
        kind = np.float32 if learn else np.float64
        lengths = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-lengths, kind="stable")
        steps = int(lengths.max(initial=0))
        active = len(texts) - np.searchsorted(np.sort(lengths), np.arange(steps), side="right")
        begin = np.concatenate(([0], np.cumsum(active)))
        tokens = np.empty(begin[-1], np.int64)
        for i, j in enumerate(order.tolist()):
            tokens[begin[: lengths[j]] + i] = texts[j]
        emit = self.emit.astype(kind)[tokens]
        alpha, scale = np.empty_like(emit), np.empty((len(tokens), 1), kind)
        value, moves, begins = np.zeros(len(texts)), self.moves.astype(kind), self.start.astype(kind)
        cuts = begin.tolist()
        for t in range(steps):
            a, b = cuts[t], cuts[t + 1]
            now = begins * emit[a:b] if t == 0 else (alpha[cuts[t - 1] : cuts[t - 1] + b - a] @ moves) * emit[a:b]
            total = now.sum(axis=1, keepdims=True)
            scale[a:b] = total
            np.divide(now, total, out=alpha[a:b])
            value[: b - a] += np.log(total[:, 0])
        result = np.empty(len(texts))
        result[order] = value
        if not learn:
            return result, None
        ahead = emit / scale  # becomes emission * beta / scale of each token
        beta, back = np.ones_like(emit), moves.T
        for t in range(steps - 1, 0, -1):
            a, b = cuts[t], cuts[t + 1]
            ahead[a:b] *= beta[a:b]
            before = cuts[t - 1]
            beta[before : before + b - a] = ahead[a:b] @ back
        gamma = alpha * beta
        later = np.arange(cuts[1] if steps else 0, len(tokens))
        previous = later - np.repeat(active[:-1], active[1:]) if steps > 1 else later
        crossing = self.moves * (alpha[previous].T @ ahead[later]) if steps > 1 else np.zeros_like(self.moves)
        counts = np.stack([np.bincount(tokens, gamma[:, k], len(self.emit)) for k in range(len(self.start))], axis=1)
        return result, (gamma[: cuts[1]].sum(axis=0, dtype=np.float64) if steps else np.zeros(len(self.start)), crossing, counts)


class Classes(dict):
    """Word to class: frequent words by table, others by a hash of their last bytes; grows as a cache of bounded size."""

    def __init__(self, frequent: list[bytes], endings: int) -> None:
        super().__init__({w: i for i, w in enumerate(frequent)})
        self.frequent, self.endings = frequent, endings

    def __reduce__(self):
        return Classes, (self.frequent, self.endings)

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
            self.update({w: i for i, w in enumerate(self.frequent)})
        self[word] = value = len(self.frequent) + ending_class(word, self.endings)
        return value

    def of(self, text: bytes) -> np.ndarray:
        words = text.lower().split()
        words.append(END)
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def ending_class(word: bytes, endings: int) -> int:
    return zlib.crc32(word[-3:]) % endings


def batches_of(texts: Iterator[tuple[object, np.ndarray]], tokens: int = 250_000, held: int = 2_000_000) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Batches of texts of like length: sorted within ``held`` tokens, cut at ``tokens``."""
    buffer: list[tuple[object, np.ndarray]] = []
    size = 0

    def cut() -> Iterator[tuple[list, list[np.ndarray]]]:
        buffer.sort(key=lambda x: -len(x[1]))
        at = 0
        while at < len(buffer):
            end, n = at, 0
            while end < len(buffer) and (n == 0 or n + len(buffer[end][1]) <= tokens):
                n += len(buffer[end][1])
                end += 1
            yield [x[0] for x in buffer[at:end]], [x[1] for x in buffer[at:end]]
            at = end

    for x in texts:
        buffer.append(x)
        size += len(x[1])
        if size >= held:
            yield from cut()
            buffer, size = [], 0
    yield from cut()


def _word_blocks(slices: int, hot: list[bytes], most: int):
    """Packets of (text keys, words, occurrences): each word once for a block of texts, with the texts it occurs in.

    ``hot`` words occur in so many texts that their occurrences would fill a slice: of them only counts travel, as packet -1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, block = TaskContext.get().partitionId() << 20, 0
        hot_at, hot_counts = {w: i for i, w in enumerate(hot)}, np.zeros(len(hot), np.int64)
        keys: dict[bytes, int] = {}
        weight: list[int] = []
        words: dict[bytes, int] = {}
        word_at, text_at, times = [], [], []
        n = 0

        def flush() -> pa.RecordBatch:
            names = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, 16)
            w = np.concatenate(word_at)
            t = np.repeat(np.arange(len(keys), dtype=np.int32), [len(x) for x in word_at])
            c, trained = np.concatenate(times), np.array(weight, np.int64)
            spelled = list(words)
            hot_of = np.fromiter(map(hot_at.get, spelled, repeat(-1)), np.int64, len(spelled))
            common = hot_of[w] >= 0
            np.add.at(hot_counts, hot_of[w[common]], (c * trained[t])[common])
            slice_of = np.fromiter((-1 if x in hot_at else zlib.crc32(x) % slices for x in spelled), np.int64, len(spelled))
            order = np.lexsort((w, slice_of[w]))
            w, t, c = w[order], t[order], c[order]
            cuts, out = np.searchsorted(slice_of[w], np.arange(slices + 1)), []
            for s in range(slices):
                a, b = cuts[s], cuts[s + 1]
                if a < b:
                    mine, local = np.unique(w[a:b], return_inverse=True)
                    who, owner = np.unique(t[a:b], return_inverse=True)
                    out.append((s, pack(np.array([number + block], np.int64), names[who], trained[who], b" ".join([spelled[i] for i in mine.tolist()]), local.astype(np.int32), owner.astype(np.int32), c[a:b].astype(np.int32))))
            return packets(out)

        for batch in batches:
            for text, key, train in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                at = keys.setdefault(key, len(keys))
                if at < len(weight):
                    weight[at] += train
                    continue
                weight.append(train)
                counted = Counter(text.lower().split())
                counted[END] = 1
                word_at.append(np.fromiter((words.setdefault(x, len(words)) for x in counted), np.int64, len(counted)))
                times.append(np.fromiter(counted.values(), np.int64, len(counted)))
                n += len(counted)
                if n >= most:
                    yield flush()
                    block += 1
                    keys, weight, words, word_at, times, n = {}, [], {}, [], [], 0
        if keys:
            yield flush()
        if hot_counts.any():
            yield packets([(-1, pack(hot_counts))])

    return run


def _count(hot: int, frequent: int, endings: int):
    """For a slice of the words: exact training counts; then, for each block, its texts' sums of log10(count + ADD) and known tokens.

    Yields rows of kind 0, sums of a block's texts; 1, counts and numbers of words by ending; 2, the slice's most frequent words;
    and for slice -1 of kind 3, the counts of the hot words.
    """
    row = lambda kind, uid, payload: pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([uid], pa.int64()), pa.array([payload], pa.binary())], ["kind", "uid", "payload"])

    def merge(number: int, payloads: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
        if number < 0:
            yield row(3, 0, pack(sum((unpack(p, "i8")[0] for p in payloads), np.zeros(hot, np.int64))))
            return
        known: dict[bytes, int] = {}
        counts = np.zeros(1 << 16)
        held = []
        for p in payloads:
            uid, keys, weight, spelled, word, owner, times = unpack(p, "i8", "u1", "i8", "bytes", "i4", "i4", "i4")
            at = np.fromiter((known.setdefault(x, len(known)) for x in spelled.split(b" ")), np.int64)
            if len(known) > len(counts):
                counts = np.concatenate((counts, np.zeros(max(len(counts), len(known)))))
            counts[at] += np.bincount(word, times * weight[owner], len(at))
            held.append((int(uid[0]), p, at))
        counts = counts[: len(known)]
        logs = np.log10(counts + ADD)
        for uid, p, at in held:
            _, keys, _, _, word, owner, times = unpack(p, "i8", "u1", "i8", "bytes", "i4", "i4", "i4")
            here = at[word]
            n = len(keys) // 16
            yield row(0, uid, pack(np.array([uid], np.int64), keys, np.bincount(owner, logs[here] * times, n), np.bincount(owner, (counts[here] > 0) * times, n).astype(np.int64)))
        words = list(known)
        seen = np.flatnonzero(counts > 0)
        top = seen if len(seen) <= frequent else seen[counts[seen] >= np.partition(counts[seen], len(seen) - frequent)[len(seen) - frequent]]
        top = sorted(top.tolist(), key=lambda i: (-counts[i], words[i]))[:frequent]
        kinds = np.fromiter((ending_class(words[i], endings) for i in seen.tolist()), np.int64, len(seen))
        yield row(1, 0, pack(np.bincount(kinds, counts[seen], endings), np.bincount(kinds, minlength=endings).astype(np.float64)))
        for i in top:
            yield row(2, int(counts[i]), words[i])

    return merge


def _sum_texts(number: int, payloads: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    """Sums of each text of each block over all slices of words. A text that several blocks hold has equal sums in each."""
    keys, blocks, sums, known = [], [], [], []
    for p in payloads:
        uid, k, s, n = unpack(p, "i8", "u1", "f8", "i8")
        keys.append(k.view("V16"))
        blocks.append(np.full(len(s), uid[0], np.int64))
        sums.append(s)
        known.append(n)
    keys, blocks = np.concatenate(keys), np.concatenate(blocks)
    both = np.rec.fromarrays([keys, blocks.view("V8")]).view("V24")
    name, at = np.unique(both, return_inverse=True)
    yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()[:16] for x in name], pa.binary()), pa.array(np.bincount(at, np.concatenate(sums)), pa.float64()), pa.array(np.bincount(at, np.concatenate(known)).astype(np.int64), pa.int64())], ["key", "logs", "n_known"])


def _add_endings(number: int, payloads: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    total = None
    for p in payloads:
        now = unpack(p, "f8", "f8")
        total = now if total is None else [a + b for a, b in zip(total, now, strict=True)]
    yield packets([(number, pack(*total))])


def _hot_words(rows: DataFrame, n_rows: int, sample: int = 5_000, most: int = 4096) -> list[bytes]:
    """Words that occur in one of 200 texts or more, as far as a sample of texts tells; which words these are decides only how counts travel."""
    some = rows.where(F.pmod(F.xxhash64("__key"), F.lit(max(1, n_rows // sample))) == 0).select("__key", "__text")

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in as_bytes(batch.column(1)):
                words = list(set(text.lower().split()))
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary())], ["word"])

    found = arrow_map(some.dropDuplicates(["__key"]), spelled, "word binary").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    found = found.where(F.col("n") >= max(3, sample // 200)).orderBy(F.desc("n"), "word").limit(most).collect()
    return [END, *(bytes(r.word) for r in found)]


#: Tokens between the classes whose counts shape the states first: what holds over so many words, such as the language, is what states keep.
LAG = 32


def _packed(sent):
    """Packets of (lengths, classes) of texts of like length: the training texts as every round reads them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = sent.value
        for _, texts in batches_of((None, classes.of(t)) for b in batches for t in as_bytes(b.column(0))):
            yield packets([(0, pack(np.array([len(t) for t in texts], np.int32), np.concatenate(texts).astype(np.uint16)))])

    return run


def _sequences(payload: bytes) -> list[np.ndarray]:
    lengths, joined = unpack(payload, "i4", "u2")
    return np.split(joined.astype(np.int64), np.cumsum(lengths)[:-1])


def _pairs(classes: int, parts: int):
    """Packets of (pair codes as differences, counts): neighbouring classes, and the first class of each text after a class of its own,
    as slices from 0; classes LAG tokens apart as slices from ``parts``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = classes
        held: list[np.ndarray] = []
        size = 0

        def counted(codes: np.ndarray, offset: int) -> list[tuple[int, bytes]]:
            code, count = np.unique(codes, return_counts=True)
            part = code // n * parts // (n + 1)
            cuts = np.searchsorted(part, np.arange(parts + 1)).tolist()
            return [(i + offset, pack(np.diff(code[a:b], prepend=0), count[a:b].astype(np.int32))) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if a < b]

        def flush() -> pa.RecordBatch:
            joined = np.concatenate(held)
            inner = joined[:-1] * n + joined[1:]  # the edge class n stands before each text
            far = [t[1:-LAG] * n + t[LAG + 1 :] for t in held if len(t) > LAG + 1]
            return packets(counted(inner[joined[1:] != n], 0) + (counted(np.concatenate(far), parts) if far else []))

        for b in batches:
            for payload in b.column(0).to_pylist():
                for text in _sequences(payload):
                    held.append(np.concatenate((np.array([n], np.int64), text)))
                    size += len(held[-1])
                if size >= 2_000_000:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return run


def _add_pairs(n: int):
    def merge(number: int, payloads: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
        code, count = np.empty(0, np.int64), np.empty(0, np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def added() -> tuple[np.ndarray, np.ndarray]:
            codes, at = np.unique(np.concatenate([code, *(c for c, _ in held)]), return_inverse=True)
            return codes, np.bincount(at, np.concatenate([count, *(k for _, k in held)]), len(codes)).astype(np.int64)

        for p in payloads:
            gaps, k = unpack(p, "i8", "i4")
            held.append((np.cumsum(gaps), k.astype(np.int64)))
            if sum(len(k) for _, k in held) > max(1_000_000, len(code)):
                code, count = added()
                held = []
        code, count = added()
        yield packets([(number, pack(np.diff(code, prepend=0), count))])

    return merge


def from_pairs(model: Hmm, pairs: np.ndarray, first: np.ndarray, prior: np.ndarray, rounds: int = 60, settled: float = 1e-5) -> Hmm:
    """EM from ``model`` on the counts of neighbouring classes (C x C) and of first classes: a start for Baum-Welch."""
    states, total, last = len(model.start), max(1.0, float(pairs.sum(dtype=np.float64))), -np.inf
    share = np.full(states, 1 / states)
    for _ in range(rounds):
        emit = model.emit.astype(np.float32)
        joint = (share[:, None] * model.moves).astype(np.float32)
        moved, back = emit @ joint, emit @ joint.T
        before, after, crossing, value = np.zeros_like(model.emit), np.zeros_like(model.emit), np.zeros_like(model.moves), 0.0
        for a in range(0, len(pairs), 512):
            n = pairs[a : a + 512]
            p = np.maximum(moved[a : a + 512] @ emit.T, np.float32(1e-35))
            value += float((n * np.log(p)).sum(dtype=np.float64))
            x = n / p
            right = x @ emit
            before[a : a + 512] = x @ back
            after += x.T @ moved[a : a + 512]
            crossing += emit[a : a + 512].T @ right
        began = model.start * model.emit
        began *= (first / np.maximum(began.sum(axis=1), 1e-300))[:, None]
        moves = joint * crossing
        share = (moves.sum(axis=1) + 0.5) / (moves.sum() + 0.5 * states)
        model = Hmm.from_counts(began.sum(axis=0), moves, model.emit * (before + after), prior)
        if value - last < settled * total:
            break
        last = value
    return model


def _learn(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, parts = sent.value
        start, moves, emit = np.zeros_like(model.start), np.zeros_like(model.moves), np.zeros_like(model.emit)
        value = 0.0
        for b in batches:
            for payload in b.column(0).to_pylist():
                got, counts = model.batch(_sequences(payload), True)
                value += got.sum()
                start, moves, emit = start + counts[0], moves + counts[1], emit + counts[2]
        cuts = np.linspace(0, len(emit), parts + 1).astype(int)
        yield packets([(-1, pack(start, moves, np.array([value])))] + [(i, pack(emit[a:b])) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))])

    return run


def _add(number: int, payloads: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    total = None
    for p in payloads:
        now = unpack(p, *["f8"] * (3 if number < 0 else 1))
        total = now if total is None else [a + b for a, b in zip(total, now, strict=True)]
    yield packets([(number, pack(*total))])


def _score(sent, names: list[str]):
    """Model log10 probability, and the hot words' share of the sums of log10(count + ADD) and of the known tokens.

    Hot words that are classes of their own are told by their class; the few others are looked up.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, model, offset, class_logs, class_known, others = sent.value

        def rows() -> Iterator[tuple[tuple, np.ndarray]]:
            for b in batches:
                kept = zip(*(b.column(i).to_pylist() for i in range(1, b.num_columns)), strict=True)
                for row, text in zip(kept, as_bytes(b.column(0)), strict=True):
                    words = text.lower().split()
                    words.append(END)
                    of = np.fromiter(map(classes.__getitem__, words), np.int64, len(words))
                    logs, known = float(class_logs[of].sum()), int(class_known[of].sum())
                    if others:
                        found = [others[w] for w in words if w in others]
                        logs, known = logs + sum(x for x, _ in found), known + sum(y for _, y in found)
                    yield (*row, logs, known), of

        for kept, texts in batches_of(rows()):
            value, _ = model.batch(texts, False)
            value = value / np.log(10) + [offset[t].sum() for t in texts]
            columns = [*zip(*kept, strict=True)]
            kinds = [None, pa.bool_(), pa.binary(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), pa.array([len(t) for t in texts], pa.int64()), pa.array(value, pa.float64())], names)

    return run


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", held_mod: int = 10, states: int = 8, frequent: int = 4096, endings: int = 1024, rounds: int | None = None, sample: int | None = None, seed: int = 42, settled: float = 1e-3, slices: int | None = None, block_words: int = 2_000_000) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``, one row for each row of docs.

    Rows with crc32(doc_id as text) mod ``held_mod`` of 0 are held out; all others train. Word counts, the start of the hidden
    states (fitted to the counts of classes LAG tokens apart, then of neighbours) and all Baum-Welch rounds cover all training texts. Rounds end when
    one gains less than ``settled`` (natural log) a token, or after ``rounds`` if given. ``sample`` has no effect: nothing is sampled.

    A null text is empty: just the end token. An unseen word counts as the one unseen type of its class. Null ids hash as the empty
    text. Repeated rows train as often as they occur. Other columns are ignored; an empty table gives an empty one.
    """
    if frequent + endings > 1 << 16:
        raise ValueError("a class is held in 16 bits")
    spark = docs.sparkSession
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(whole.alias("__text"), F.unhex(F.md5(whole.cast("binary"))).alias("__key"), F.col(f"`{doc_id}`").alias("doc_id"), (doc_crc(F.col(f"`{doc_id}`")) % held_mod == 0).alias("held_out"))
    total, n_rows = rows.agg(F.coalesce(F.sum(F.octet_length("__text")), F.lit(0)), F.count(F.lit(1))).first()
    slices = slices or max(12, total >> 26)
    hot = _hot_words(rows, n_rows)
    marked = rows.select("__text", "__key", F.when(F.col("held_out"), 0).otherwise(1).alias("train"))
    blocks = arrow_map(marked, _word_blocks(slices, hot, block_words), PACKET)
    counted = durable(by_slice(blocks, _count(len(hot), frequent, endings), "kind int, uid bigint, payload binary"))
    deal = F.pmod(F.xxhash64("uid"), F.lit(max(64, slices))).cast("int")
    known = by_slice(counted.where("kind = 0").select(deal.alias("slice"), "payload"), _sum_texts, "key binary, logs double, n_known bigint")
    known = known.groupBy("key").agg(F.max("logs").alias("logs"), F.max("n_known").alias("n_known"))

    tokens, types, hot_counts = np.zeros(endings), np.zeros(endings), np.zeros(len(hot), np.int64)
    for r in counted.where("kind = 3").select("payload").collect():
        hot_counts = hot_counts + unpack(bytes(r[0]), "i8")[0]
    for r in by_slice(counted.where("kind = 1").select(F.lit(0).alias("slice"), "payload"), _add_endings, PACKET).collect():
        tokens, types = unpack(bytes(r[1]), "f8", "f8")
    seen_hot = [(w, float(c)) for w, c in zip(hot, hot_counts.tolist(), strict=True) if c > 0]
    tokens, types = tokens.copy(), types.copy()
    for w, c in seen_hot:
        k = ending_class(w, endings)
        tokens[k], types[k] = tokens[k] + c, types[k] + 1
    best = counted.where("kind = 2").select("uid", "payload").orderBy(F.desc("uid"), "payload").limit(frequent).collect()
    top = seen_hot + [(bytes(r.payload), float(r.uid)) for r in best]
    n_train, n_types = tokens.sum(), types.sum()
    top = sorted(top, key=lambda x: (x[0] != END, -x[1], x[0]))[:frequent]
    for w, c in top:
        k = ending_class(w, endings)
        tokens[k], types[k] = tokens[k] - c, types[k] - 1
    classes = Classes([w for w, _ in top], endings)
    prior = np.concatenate((np.array([c for _, c in top]), tokens)) + ADD
    prior /= prior.sum()
    # what a class adds to the sum of log10(count + ADD) over all tokens, to make it the sum of log10 P(word | class)
    offset = np.concatenate((-np.log10(np.array([c for _, c in top]) + ADD), -np.log10(tokens + ADD * (types + 1))))

    training = rows.where("not held_out").select("__text")
    model, n, n_tokens = Hmm.seeded(states, len(prior), prior, seed), len(prior), max(1.0, n_train)
    training = durable(arrow_map(training, _packed(spark.sparkContext.broadcast(classes)), PACKET).select("payload"))
    pairs = durable(by_slice(arrow_map(training, _pairs(n, 16), PACKET), _add_pairs(n), PACKET))

    def counts(of: str) -> np.ndarray:
        out = np.zeros((n + 1, n), np.float32)
        for r in pairs.where(of).toLocalIterator():
            gaps, count = unpack(bytes(r[1]), "i8", "i8")
            out.ravel()[np.cumsum(gaps)] = count
        return out

    far = counts("slice >= 16")
    apart = bool(far.any())
    if apart:
        model = from_pairs(model, far[:-1], np.zeros(n), prior, 300)
        model = Hmm(model.start, 0.95 * model.moves + 0.05 / states, model.emit)  # neighbours may move where distant words stay
    del far
    near = counts("slice < 16")
    model = from_pairs(model, near[:-1], near[-1], prior, 5 if apart else 60)
    del near
    last, done = -np.inf, 0
    while done != rounds:
        sent = spark.sparkContext.broadcast((model, 16))
        parts = {r[0]: bytes(r[1]) for r in by_slice(arrow_map(training, _learn(sent), PACKET), _add, PACKET).collect()}
        if not parts:
            break
        sent.destroy()
        start, moves, value = unpack(parts[-1], "f8", "f8", "f8")
        emit = np.concatenate([unpack(parts[i], "f8")[0].reshape(-1, states) for i in range(16)])
        model = Hmm.from_counts(start, moves.reshape(states, states), emit, prior)
        done += 1
        if value[0] - last < settled * n_tokens:
            break
        last = value[0]
    values = {w: (float(np.log10(c + ADD)), int(c > 0)) for w, c in zip(hot, hot_counts.tolist(), strict=True)}
    class_logs, class_known = np.zeros(n), np.zeros(n, np.int64)
    for i, (w, _) in enumerate(top):
        if w in values:
            class_logs[i], class_known[i] = values.pop(w)
    sent = spark.sparkContext.broadcast((classes, model, offset, class_logs, class_known, values))
    names = ["doc_id", "held_out", "__key", "__hot_logs", "__hot_known", "n_tokens", "__value"]
    kinds = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, __key binary, __hot_logs double, __hot_known bigint, n_tokens bigint, __value double"
    scored = arrow_map(rows.select("__text", "doc_id", "held_out", "__key"), _score(sent, names), kinds)
    unit = float(np.log10(n_train + ADD * (n_types + 1)))
    logs = F.coalesce("logs", F.lit(0.0)) + F.col("__hot_logs")  # a text of hot words alone has no sums
    return scored.join(known, F.col("__key") == F.col("key"), "left").select(
        "doc_id", "held_out", "n_tokens", (F.coalesce("n_known", F.lit(0)) + F.col("__hot_known")).alias("n_known"), F.lit(int(round(n_train))).cast("bigint").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.lit(unit)).alias("base_score"), (F.col("__value") + logs).alias("score"),
    )
