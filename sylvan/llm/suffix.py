"""Removal of byte strings that an earlier document has too, by distributed suffix sorting.

Equal strings of ``width`` bytes have the same anchor: the least hash among their GRAM-byte pieces. Stretches of text that
share an anchor meet by it, and only stretches whose anchor a count-min sketch estimates repeated travel. Where they meet,
the suffixes from the anchor on, and the reversed ones before it, are sorted with a mergesort that compares two suffixes by a
binary search over prefix hashes; neighbours' common extensions then tell which strings are equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sketch
from .common import arrow_map, as_bytes, durable
from .packets import PACKET, block_uid, by_slice, gathered, head_packet, mark_packets, pack, packets, past, sift, unpack

GRAM = 26
#: Windows of a stretch that one mark holds.
RUN = 32
#: Bytes of text looked at together, and the id that null ids take, which no other id exceeds.
PIECE, LAST = 1 << 19, (1 << 63) - 1
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes that start at each place of a byte array."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    at = lambda i: np.ndarray((n,), "<u8", data, i, (1,))
    h = at(0) * np.uint64(0x9E3779B97F4A7C15)
    for i, odd in ((8, 0xC2B2AE3D27D4EB4F), (16, 0x165667B19E3779F9), (18, 0x27D4EB2F165667C5)):
        h ^= h >> np.uint64(31)
        h += at(i)
        h *= np.uint64(odd)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(32))


def stretches(data: np.ndarray, limits: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, end of windows, anchor, anchor hash) of each maximal run of windows with one anchor.

    ``limits``: for each place, the end of its text; windows don't cross it. The hash's low bits are replaced by the place, so
    that a plain running minimum finds the first place of the least hash.
    """
    n = len(data) - width + 1
    if n <= 0:
        empty = np.empty(0, np.int64)
        return empty, empty, empty, np.empty(0, np.uint64)
    hashes = gram_hashes(data)
    low = np.uint64((1 << 20) - 1)
    least = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    span, reach = 1, width - GRAM + 1
    while 2 * span <= reach:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if rest := reach - span:
        least = np.minimum(least[:-rest], least[rest:])
    anchor = (least[:n] & low).astype(np.int64)
    inside = limits[:n] - np.arange(n) >= width
    change = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (limits[1:n] != limits[: n - 1])))
    start = np.flatnonzero(change & inside)
    edge = np.flatnonzero(np.diff(np.concatenate((inside, [False])).astype(np.int8)) == -1) + 1
    bounds = np.sort(np.concatenate((np.flatnonzero(change), edge, [n])))
    end = bounds[np.searchsorted(bounds, start, side="right")]
    return start, end, anchor[start], hashes[anchor[start]]


def cut_runs(start: np.ndarray, end: np.ndarray, anchor: np.ndarray, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stretches cut to RUN windows at most, which is what a mark has bits for; each part keeps the anchor."""
    many = -(-(end - start) // RUN)
    if (many <= 1).all():
        return start, end, anchor, hashed
    at = np.repeat(np.arange(len(start)), many)
    first = start[at] + RUN * (np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many))
    return first, np.minimum(first + RUN, end[at]), anchor[at], hashed[at]


def _pieces(texts: list[bytes], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Byte arrays of about PIECE bytes, with each place's text number, place in the text and end of text; long texts overlap."""
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def out() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        lengths = np.array([len(b) for _, _, b in held], np.int64)
        ends = np.cumsum(lengths)
        data = np.frombuffer(b"".join(b for _, _, b in held), np.uint8)
        number = np.repeat(np.array([i for i, _, _ in held], np.int64), lengths)
        place = np.arange(len(data)) - np.repeat(ends - lengths - np.array([a for _, a, _ in held], np.int64), lengths)
        return data, number, place, np.repeat(ends, lengths)

    for i, text in enumerate(texts):
        for a in range(0, max(0, len(text) - width) + 1, PIECE - width):
            part = text[a : a + PIECE - 1]
            if len(part) < width:
                continue
            if size + len(part) >= PIECE:
                if held:
                    yield out()
                held, size = [], 0
            held.append((i, a, part))
            size += len(part)
    if held:
        yield out()


def remove_earlier(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 50, keep: list[str] | None = None, most_bits: int = 27, cleaned: bool = False) -> DataFrame:
    """Columns ``keep``, then n_bytes, n_removed, n_spans, kept_sha256, and with ``cleaned`` the remaining bytes as binary.

    A byte goes if a string of ``width`` bytes (GRAM to 255) that covers it also starts in a document with a smaller id, judged
    on the input. Null texts are empty. Null ids come after all others and are not smaller than each other; rows with equal ids
    don't remove from each other. Texts shorter than ``width`` keep all. Other columns play no part; an empty table gives an
    empty one. The sketch has 3 * 2**most_bits bits at most; when it is full, more stretches travel, and none is lost.
    """
    keep = [doc_id] if keep is None else keep
    spark = docs.sparkSession
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    ident = F.coalesce(F.col(f"`{doc_id}`").cast("bigint"), F.lit(LAST))
    row_key = F.unhex(F.md5(F.concat_ws(":", F.md5(whole.cast("binary")), ident.cast("string")).cast("binary")))
    texts = docs.select(whole.alias("__text"), row_key.alias("__key"), ident.alias("__id"))
    total, n_rows = texts.agg(F.coalesce(F.sum(F.octet_length("__text")), F.lit(0)), F.count(F.lit(1))).first()
    anchors = 2 * total // (width - GRAM + 2)
    bits = sketch.log_width(anchors, most_bits)

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partial = sketch.Partial(bits)
        for batch in batches:
            for data, _, _, limits in _pieces(as_bytes(batch.column(0)), width):
                yield from partial.add(stretches(data, limits, width)[3])
        yield from partial.flush()

    sent = spark.sparkContext.broadcast(sketch.merged(arrow_map(texts.select("__text"), first_pass, PACKET), bits))
    slices = max(12, anchors // 500_000)

    def second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block(TaskContext.get().partitionId(), slices, width)
        for batch in batches:
            values, keys, ids = as_bytes(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            order = sorted(range(len(ids)), key=ids.__getitem__)
            values, keys, ids = [values[i] for i in order], [keys[i] for i in order], [ids[i] for i in order]
            for data, number, place, limits in _pieces(values, width):
                start, end, anchor, hashed = stretches(data, limits, width)
                pick = sketch.repeated(sent.value, hashed, bits)
                block.add(data, *cut_runs(start[pick], end[pick], anchor[pick], hashed[pick]), number, place, keys, ids)
                if block.n + len(block.settled) // 4 >= 120_000:
                    yield from block.flush()
        yield from block.flush()

    judge = lambda number, payloads: past(payloads) if number < 0 else _judge(payloads, width)
    judged = by_slice(arrow_map(texts, second_pass, PACKET), judge, PACKET)
    # rows of equal text and id have equal marks in each block, so one row of them tells all
    flags = durable(by_slice(judged, gathered, "key binary, marks binary").groupBy("key").agg(F.max("marks").alias("__marks")))
    sent.destroy()  # the checkpoint needs it no more, and workers would keep it
    # Only texts that may lose something travel to their marks; a filter of the marks' keys, bounded in size, tells them.
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], whole.alias("__text"), row_key.alias("__key"))
    some, others = sift(rows, "__key", flags.select("key"), n_rows)
    joined = some.join(flags, F.col("__key") == F.col("key"), "left").select(*[F.col(f"`{c}`") for c in keep], "__text", "__marks")
    others = others.select(*[F.col(f"`{c}`") for c in keep], "__text", F.lit(None).cast("binary").alias("__marks"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields[:-2]]
    schema = ", ".join([*fields, "n_bytes bigint", "n_removed bigint", "n_spans bigint", "kept_sha256 string", *(["kept binary"] if cleaned else [])])

    def last_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, spans, digest, kept = [], [], [], [], []
            for value, marks in zip(as_bytes(batch.column(len(keep))), batch.column(len(keep) + 1).to_pylist(), strict=True):
                n.append(len(value))
                cuts = removed_spans(np.frombuffer(marks, np.int64), len(value), width) if marks else []
                at, left = 0, []
                for a, b in cuts:
                    left.append(value[at:a])
                    at = b
                left = b"".join(left) + value[at:]
                gone.append(len(value) - len(left))
                spans.append(len(cuts))
                digest.append(hashlib.sha256(left).hexdigest())
                kept.append(left)
            out = [*batch.columns[: len(keep)], pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string()), *([pa.array(kept, pa.binary())] if cleaned else [])]
            yield pa.RecordBatch.from_arrays(out, [*keep, "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if cleaned else [])])

    return arrow_map(joined, last_pass, schema).unionByName(arrow_map(others, last_pass, schema))


def removed_spans(marks: np.ndarray, n: int, width: int) -> list[tuple[int, int]]:
    """Maximal removed runs; a mark holds a place (high bits) and, for the 32 windows from it on, a bit each."""
    place, mask = marks >> 32, marks & 0xFFFFFFFF
    which, shift = np.nonzero((mask[:, None] >> np.arange(32)) & 1)
    starts = np.unique(place[which] + shift)
    if not len(starts):
        return []
    first = np.concatenate(([True], starts[1:] > starts[:-1] + width))
    last = np.concatenate((first[1:], [True]))
    return list(zip(starts[first].tolist(), (starts[last] + width).tolist(), strict=True))


class _Block:
    """Stretches of some documents of a task, in groups of equal bytes: those with a larger id than the group's least are settled."""

    def __init__(self, partition: int, slices: int, width: int) -> None:
        self.partition, self.number, self.slices, self.width = partition, 0, slices, width
        self._clear()

    def _clear(self) -> None:
        self.groups: dict[bytes, list] = {}
        self.names: dict[bytes, int] = {}
        self.settled: list[tuple[int, int]] = []
        self.n = 0

    def add(self, data, start, end, anchor, hashed, number, place, keys: list[bytes], ids: list[int]) -> None:
        raw, groups, settled, tail = data.tobytes(), self.groups, self.settled, self.width - 1
        texts = number[start]
        mine = {i: (self.names.setdefault(keys[i], len(self.names)), ids[i]) for i in np.unique(texts).tolist()}
        for a, e, c, h, i, p in zip(start.tolist(), end.tolist(), anchor.tolist(), hashed.tolist(), texts.tolist(), place[start].tolist(), strict=True):
            piece = raw[a : e + tail]
            name, ident = mine[i]
            group = groups.get(piece)
            if group is None:
                groups[piece] = [ident, h, c - a, [(name, p)]]
            elif ident == group[0]:
                group[3].append((name, p))
            elif ident > group[0]:
                settled.append((name, p << 32 | (1 << (e - a)) - 1))
            else:
                full = (1 << (e - a)) - 1
                settled += [(n, q << 32 | full) for n, q in group[3]]
                group[0], group[3] = ident, [(name, p)]
        self.n = len(groups)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.names:
            return
        uid = block_uid(self.partition, self.number)
        rows = [(piece, h, offset, ident, n, p) for piece, (ident, h, offset, places) in self.groups.items() for n, p in places]
        pieces, hashed, *rest = zip(*rows, strict=True) if rows else [()] * 6
        to = (np.array(hashed, np.uint64) % np.uint64(self.slices)).astype(np.int64)
        offset, ident, owner, place = (np.array(x, k) for x, k in zip(rest, (np.uint8, np.int64, np.int32, np.int32), strict=True))
        settled = np.array(self.settled, np.int64).reshape(-1, 2)
        out = [head_packet(uid, np.frombuffer(b"".join(self.names), np.uint8), settled[:, 0], settled[:, 1])]
        self.number += 1
        self._clear()
        order = np.argsort(to, kind="stable")
        cuts = np.searchsorted(to[order], np.arange(self.slices + 1)).tolist()
        for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if a < b:
                at = order[a:b]
                mine = [pieces[i] for i in at.tolist()]
                out.append((s, pack(np.array([uid], np.int64), b"".join(mine), np.array([len(p) for p in mine], np.uint16), offset[at], ident[at], owner[at], place[at])))
        yield packets(out)


def merge_sort(bucket: np.ndarray, text: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of suffixes within their buckets, and each one's common extension with the one before it in the bucket (-1: none).

    ``bucket`` is sorted; row i of ``text`` is suffix i, ``length[i]`` bytes of it. Two suffixes are compared by a binary search,
    over hashes of their prefixes, for the longest common one, and by the byte after it. Runs double in each round; every
    element finds its place in the run beside its own by binary search, so a round compares each element log(run) times. Suffixes
    of one bucket with equal hashes of all their bytes are sorted as one. Afterwards all extensions are verified byte by byte; buckets in which hashes collided are sorted by their bytes.
    """
    n, longest = text.shape
    hashes = np.zeros((n, longest + 1), np.uint64)
    for j in range(longest):
        hashes[:, j + 1] = (hashes[:, j] + text[:, j].astype(np.uint64) + np.uint64(1)) * BASE
    flat, stride = hashes.ravel(), longest + 1
    padded = np.concatenate((text, np.zeros((n, 1), np.uint8)), axis=1).ravel()
    size = length.astype(np.int64)

    def extension(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        low, high = np.zeros(len(x), np.int64), np.minimum(size[x], size[y])
        for _ in range(longest.bit_length()):
            mid = (low + high + 1) >> 1
            same = flat[x * stride + mid] == flat[y * stride + mid]
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def below(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        at = extension(x, y)
        done_x, done_y = at == size[x], at == size[y]
        return np.where(done_x | done_y, done_x & ~done_y, padded[x * stride + at] < padded[y * stride + at])

    whole = flat[np.arange(n) * stride + size]
    alike = np.lexsort((whole, size, bucket))
    fresh = np.concatenate(([True], (bucket[alike][1:] != bucket[alike][:-1]) | (size[alike][1:] != size[alike][:-1]) | (whole[alike][1:] != whole[alike][:-1])))
    order = alike[fresh]  # one suffix of each kind, still by bucket
    kind = np.empty(n, np.int64)
    kind[alike] = np.cumsum(fresh) - 1
    m = len(order)
    head = np.flatnonzero(np.concatenate(([True], bucket[order][1:] != bucket[order][:-1])))
    counts = np.diff(np.concatenate((head, [m])))
    first, many = np.repeat(head, counts), np.repeat(counts, counts)
    run = 1
    while run < counts.max(initial=0):
        at = np.flatnonzero(many > run)  # only buckets with two runs or more
        rel = at - first[at]
        mine = rel // run
        base = first[at] + (mine ^ 1) * run
        room = np.clip(first[at] + many[at] - base, 0, run)
        left = mine % 2 == 0
        low, high = np.zeros(len(at), np.int64), room.copy()
        me = order[at]
        for _ in range(int(run).bit_length()):
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            mid = (low[open_] + high[open_]) >> 1
            other = order[base[open_] + mid]
            own = me[open_]
            # the left run's elements come before equal ones of the right run
            ahead = np.where(left[open_], below(other, own), ~below(own, other))
            low[open_] = np.where(ahead, mid + 1, low[open_])
            high[open_] = np.where(ahead, high[open_], mid)
        pair = first[at] + (mine // 2) * 2 * run
        place = pair + (rel % run) + low
        new = order.copy()
        new[place] = me
        order, run = new, 2 * run
    rank = np.empty(m, np.int64)
    rank[kind[order]] = np.arange(m)
    order = np.argsort(rank[kind], kind="stable")
    common = np.full(n, -1, np.int64)
    inner = np.flatnonzero(bucket[1:] == bucket[:-1]) + 1
    common[inner] = extension(order[inner], order[inner - 1])
    wrong = np.zeros(n, bool)
    columns = np.arange(longest)
    for i in range(0, len(inner), 1 << 18):
        part = inner[i : i + (1 << 18)]
        a, b, c = order[part], order[part - 1], common[part]
        equal = text[a] == text[b]
        bad = (~equal & (columns < c[:, None])).any(axis=1)
        open_ = (c < size[a]) & (c < size[b])
        bad |= open_ & (padded[a * stride + c] <= padded[b * stride + c])
        bad |= ~open_ & (size[a] < size[b])
        wrong[part] = bad
    if wrong.any():
        for b in np.unique(bucket[wrong]).tolist():
            lo, hi = np.searchsorted(bucket, [b, b + 1])
            own = sorted(range(lo, hi), key=lambda i: text[i, : size[i]].tobytes())
            order[lo:hi] = own
            for j in range(lo + 1, hi):
                x, y = text[own[j - lo]], text[own[j - lo - 1]]
                most = int(min(size[own[j - lo]], size[own[j - lo - 1]]))
                differ = np.flatnonzero(x[:most] != y[:most])
                common[j] = differ[0] if len(differ) else most
    return order, common


#: Stretches that are sorted together, at most, unless one anchor has more.
TOGETHER = 100_000


def _judge(payloads: Iterator[bytes], width: int) -> Iterator[pa.RecordBatch]:
    """Stretches of a slice: for each, which of its windows a smaller id has too. Yields packets of marks by block."""
    parts, uids, marks = [], [], []
    for p in payloads:
        uid, raw, size, offset, ident, owner, place = unpack(p, "i8", "u1", "u2", "u1", "i8", "i4", "i4")
        parts.append((raw, size, offset, ident, owner, place, np.full(len(owner), len(uids), np.int32)))
        uids.append(int(uid[0]))
    raw, size, offset, ident, owner, place, block = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts
    raw = np.concatenate((raw, np.zeros(width + 8, np.uint8)))
    begin = np.cumsum(size, dtype=np.int64) - size
    h = np.concatenate([_hash_at(raw, (begin + offset)[i : i + TOGETHER]) for i in range(0, max(1, len(size)), TOGETHER)])
    order = np.argsort(h, kind="stable")
    h = h[order]
    # an anchor that only one stretch has is done; so is one whose stretches all have one id
    if len(h):
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        ids = ident[order]
        mixed = np.minimum.reduceat(ids, first) < np.maximum.reduceat(ids, first)
        stay = np.repeat(mixed, np.diff(np.concatenate((first, [len(h)]))))
        order, h = order[stay], h[stay]
    at = 0
    while at < len(order):
        end = len(order) if len(order) - at <= TOGETHER else max(int(np.searchsorted(h, h[at + TOGETHER])), int(np.searchsorted(h, h[at], side="right")))
        part = order[at:end]
        hit, mask = _compare(raw, begin[part] + offset[part], size[part].astype(np.int64), offset[part].astype(np.int64), ident[part], h[at:end], width)
        marks.append((block[part][hit], owner[part][hit], place[part][hit].astype(np.int64) << 32 | mask[hit]))
        at = end
    if marks:
        blocks, owners, values = (np.concatenate(x) for x in zip(*marks, strict=True))
        yield from mark_packets(np.array(uids, np.int64)[blocks], owners, values)


def _hash_at(raw: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Hashes of the GRAM bytes at the given places."""
    grams = np.zeros((len(anchors), GRAM), np.uint8)
    grams[:] = raw[anchors[:, None] + np.arange(GRAM)]
    return gram_hashes(grams.ravel())[::GRAM] if len(anchors) else np.empty(0, np.uint64)


def _compare(raw: np.ndarray, anchor: np.ndarray, size: np.ndarray, left: np.ndarray, ident: np.ndarray, h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For stretches sorted by their anchors' hashes: (those with windows that a smaller id has, the windows as bits of all)."""
    tail, n = width - GRAM, len(anchor)
    number = np.cumsum(np.concatenate(([True], h[1:] != h[:-1]))) - 1
    right = size - left - GRAM
    back = np.arange(n)
    steps, pad = np.arange(tail), len(raw) - 1
    grams = raw[anchor[:, None] + np.arange(GRAM)]
    # stretches with equal hashes and different anchors would meet in one bucket: then the anchors' bytes make the buckets
    if ((number[1:] == number[:-1]) & (grams[1:] != grams[:-1]).any(axis=1)).any():
        number = np.unique(np.concatenate((number[:, None].astype(">i8").view(np.uint8).reshape(-1, 8), grams), axis=1), axis=0, return_inverse=True)[1].ravel()
        back = np.argsort(number, kind="stable")
        number, anchor, left, right, ident = (x[back] for x in (number, anchor, left, right, ident))
    del grams
    after = raw[np.where(steps < right[:, None], (anchor + GRAM)[:, None] + steps, pad)]
    sort_r, common_r = merge_sort(number, after, right)
    del after
    before = raw[np.where(steps < left[:, None], (anchor - 1)[:, None] - steps, pad)]
    sort_l, common_l = merge_sort(number, before, left)
    del before
    mask = np.zeros(n, np.int64)

    def reach(order: np.ndarray, common: np.ndarray) -> np.ndarray:
        """How far each stretch extends equally with any other."""
        out = np.empty(n, np.int64)
        out[order] = np.maximum(common, np.append(common[1:], -1))
        return out

    far_r, far_l = reach(sort_r, common_r), reach(sort_l, common_l)
    for rel in range(tail + 1):  # windows that begin ``rel`` bytes before the anchor
        need = tail - rel
        valid = np.flatnonzero((far_l >= rel) & (far_r >= need))
        if not len(valid):
            continue
        class_r, class_l = np.empty(n, np.int64), np.empty(n, np.int64)
        class_r[sort_r] = np.cumsum(common_r < need)
        class_l[sort_l] = np.cumsum(common_l < rel)
        pair = class_r[valid] * (n + 1) + class_l[valid]
        by = np.lexsort((ident[valid], pair))
        start = np.concatenate(([True], pair[by][1:] != pair[by][:-1]))
        least = ident[valid][by][np.flatnonzero(start)][np.cumsum(start) - 1]
        later = valid[by][ident[valid][by] > least]
        mask[later] |= 1 << (left[later] - rel)
    out = np.empty(n, np.int64)
    out[back] = mask
    return np.flatnonzero(out), out
