"""Repeated substrings removed from later documents, by longest-previous-factor arrays over a suffix order that is dealt out.

A suffix array of the whole corpus can't be one array, and only factors of ``length`` bytes or more matter. So suffixes are dealt to
groups that any two with ``length`` bytes in common share: each window of ``length`` bytes picks one of its positions, its anchor, by its
content alone (the least hash of the K-grams in it), so equal windows pick the same one and meet at their anchors' K-gram.

1. Where documents are read, anchors are listed: hash of the K-gram, and of the context, which is all that the windows that may pick the
   anchor can reach. Anchors of equal context have equal windows, so all but those of the smallest document are repeated whole.
   What a task sees of them is settled there. Contexts count as equal by 96 bits of hash (besides the 64 of the K-gram): a billion
   different contexts of one K-gram clash with a probability of about 1e-11. Anchors are listed in ROUNDS, a share of the K-grams each,
   and what a round has shuffled goes before the next one.
2. Spark sorts the rest by K-gram and context, and each task settles what it reads in passing. Two contexts of a K-gram that have a
   window in common agree on about half of the window's other bytes right before the K-gram or right after it; hashes of both sides are
   listed, and anchors that no other document agrees with on either are done. (K-grams meet by chance the oftener the larger the input
   is.) Of the others, contexts' bytes are fetched, once for each context and document.
3. Within each K-gram, the suffixes that start at the windows are sorted by their bytes. The previous and the next position of a smaller
   document in that order give the longest previous factor, which is measured on the bytes. Where a K-gram has more than HOT contexts,
   its windows are grouped by the side whose bytes they hold too; where even such a group has more, its suffixes aren't sorted in one
   task: Spark groups them by their bytes and finds each group's smallest document.
4. Each document's repeated windows are merged into runs and cut out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialise, parallelism, salted_lookup

#: Bytes of a K-gram. A window has length - K + 1 of them.
K = 20
#: Rounds that the anchors are listed in: so much less is shuffled at a time, and texts are read so often.
ROUNDS = 2
#: Anchors that a task gathers before it passes them on, bytes of text that are laid side by side, and positions worked on at once.
GATHER, PIECE, STRETCH = 300_000, 1 << 20, 1 << 16
#: Rows of texts that are unpacked at once.
SLICE = 512
#: Contexts of a K-gram in one gathering that make it a common one; and contexts of a K-gram whose suffixes are sorted in one task at most.
MARK, HOT = 256, 4096
#: Values of _salt: a mark of a common K-gram, an ordinary row, parts of a common K-gram from 1 on, and settled rows.
MARKED, PLAIN, PARTS, SETTLED = -1, 0, 64, 1000
_FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0x9FB21C651E98DF25)]
_LOW = np.uint64(0xFFFFFFFF)


class Flat:
    """Texts side by side with gaps, and their anchors."""

    def __init__(self, texts: list[bytes], length: int):
        self.length, self.before, self.wide = length, length - K, length - K + 1
        gap = b"\xff" * (length + 8)  # wider than any context's reach
        self.data = gap + b"".join(x + gap for x in texts)
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.starts = len(gap) + np.cumsum(self.sizes + len(gap)) - self.sizes - len(gap)
        self.words = np.ndarray(len(self.data) - 7, "<u8", self.data, 0, (1,))

    def stretches(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(first positions of whole windows, their anchors), in order and STRETCH positions at a time."""
        edge = np.zeros(len(self.data) + 1, np.int8)
        long = self.sizes >= self.length
        edge[self.starts[long]] = 1
        edge[(self.starts + self.sizes)[long] - self.length + 1] = -1
        inside = np.add.accumulate(edge, dtype=np.int8)
        position = np.uint64((1 << (STRETCH + self.wide).bit_length()) - 1)
        top = len(self.data) - self.length - 8
        for i in range(0, top, STRETCH):
            windows = np.flatnonzero(inside[i : min(i + STRETCH, top)])
            if not len(windows):
                continue
            n = min(STRETCH, top - i) + self.wide - 1
            m = self.words[i : i + n + 12].copy()
            m *= _FACTORS[0]
            m ^= m >> np.uint64(29)
            h = m[:n] * _FACTORS[1]
            h += m[8 : 8 + n] * _FACTORS[2]
            h += m[12 : 12 + n] * _FACTORS[3]
            h ^= h >> np.uint64(32)
            h *= _FACTORS[4]
            h ^= h >> np.uint64(29)
            self.grams = h
            key = (h & ~position) | np.arange(n, dtype=np.uint64)
            size = 1
            while size * 2 <= self.wide:
                key = np.minimum(key[:-size], key[size:])
                size *= 2
            if self.wide > size:
                key = np.minimum(key[: len(key) - (self.wide - size)], key[self.wide - size :])
            yield windows + i, (key[windows] & position).astype(np.int64) + i

    def anchors(self):
        """Distinct anchors: position, hash of the K-gram, and the first and last window that picks it."""
        at, gram, low, high = [], [], [], []
        for windows, anchor in self.stretches():
            new = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
            at.append(anchor[new])
            gram.append(self.grams[anchor[new] - int(windows[0] // STRETCH * STRETCH)])
            low.append(windows[new])
            high.append(windows[np.r_[new[1:] - 1, len(windows) - 1]])
        if not at:
            none = np.empty(0, np.int64)
            return none, none.astype(np.uint64), none, none
        at, gram, low, high = map(np.concatenate, (at, gram, low, high))
        new = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])  # an anchor may go on in the next stretch
        return at[new], gram[new], low[new], high[np.r_[new[1:] - 1, len(at) - 1]]

    def owners(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, "right") - 1

    def contexts(self, at: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """64 and 32 bits of hash of each anchor's context, and of how far it reaches to both sides."""
        reach = self.before + self.length
        left = np.minimum(self.before, at - self.starts[owner])
        right = np.minimum(self.length, self.starts[owner] + self.sizes[owner] - at)
        a = (left * 1024 + right).astype(np.uint64) * _FACTORS[3]
        b = a ^ _FACTORS[0]
        for j in range(0, reach, 8):
            w = self.words[at + (min(j, reach - 8) - self.before)]
            a = (a ^ w) * _FACTORS[1]
            a ^= a >> np.uint64(31)
            b = (b ^ (w * _FACTORS[2])) * _FACTORS[4]
            b ^= b >> np.uint64(30)
        a = (a ^ (a >> np.uint64(29))) * _FACTORS[2]
        b = (b ^ (b >> np.uint64(32))) * _FACTORS[1]
        return a ^ (a >> np.uint64(32)), b >> np.uint64(32)

    def sides(self, at: np.ndarray, gram: np.ndarray) -> np.ndarray:
        """32 bits of hash each of the K-gram with the bytes before it, and with those after it: every window of the anchor has the ones or the others."""
        left = self.before // 2
        right = self.before - left + 1
        a, b = gram.copy(), gram.copy()
        for x, offsets in ((a, range(-left, 0, 8)), (b, range(K + right - 8, K - 8, -8))):  # a word may reach into the K-gram
            for j in offsets:
                x ^= self.words[at + j]
                x *= _FACTORS[2]
                x ^= x >> np.uint64(31)
        return (a & ~_LOW) | (b >> np.uint64(32))

    def seats(self, at: np.ndarray, owner: np.ndarray):
        """Hash of the context, and the seat: the anchor's place in its text and 32 more bits of its context's hash."""
        context, check = self.contexts(at, owner)
        return context, ((at - self.starts[owner]).astype(np.uint64) << np.uint64(32) | check).view(np.int64)


def _bytes(value) -> bytes:
    x = value.as_py()
    return x if isinstance(x, bytes) else (x or "").encode("utf-8", "surrogatepass")


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of SLICE rows at most, so that few texts are unpacked at once."""
    for batch in batches:
        for i in range(0, batch.num_rows, SLICE):
            yield batch.slice(i, SLICE)


def _pieces(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about PIECE bytes: (from, to)."""
    start = held = 0
    for i, x in enumerate(texts):
        held += len(x)
        if held >= PIECE:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


_LISTED = "_gram bigint, _salt int, _ctx bigint, _doc bigint, _seat bigint, _sides bigint"


def _rows(gram, salt, ctx, doc, seat, sides) -> pa.RecordBatch:
    arrays = [pa.array(gram.view(np.int64)), pa.array(salt.astype(np.int32)), pa.array(ctx.view(np.int64)), pa.array(doc), pa.array(seat), pa.array(sides.view(np.int64))]
    return pa.RecordBatch.from_arrays(arrays, ["_gram", "_salt", "_ctx", "_doc", "_seat", "_sides"])


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Whether a row differs from that before it."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for x in columns:
        out[1:] |= x[1:] != x[:-1]
    return out


def _last_start(first: np.ndarray) -> np.ndarray:
    return np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))


def _scan(length: int, part: int):
    """Step 1: documents in, a round's listed anchors out; of equal contexts in one gathering only the smallest document's stay listed."""

    def passed(parts) -> pa.RecordBatch:
        doc, gram, ctx, seat, sides = (np.concatenate([p[i] for p in parts]) for i in range(5))
        order = np.argsort(doc, kind="stable")
        order = order[np.argsort(((gram & ~_LOW) | (ctx >> np.uint64(32)))[order], kind="stable")]
        doc, gram, ctx, seat, sides = doc[order], gram[order], ctx[order], seat[order], sides[order]
        first = _starts(gram, ctx, seat & np.int64(0xFFFFFFFF))
        own = doc == doc[_last_start(first)]
        run = np.cumsum(_starts(gram)) - 1
        common = np.bincount(run[first]) > MARK
        salt = np.where(common[run], 1 + (ctx % np.uint64(PARTS)).astype(np.int64), PLAIN)
        salt[~own] = SETTLED + doc[~own] % PARTS
        marks = np.unique(gram[common[run]])
        none = np.zeros(len(marks), np.int64)
        return _rows(np.r_[marks, gram], np.r_[none + MARKED, salt], np.r_[none.view(np.uint64), ctx], np.r_[none, doc], np.r_[none, seat], np.r_[none.view(np.uint64), sides])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in _sliced(batches):
            ids, texts = batch.column(0).to_numpy(), [_bytes(x) for x in batch.column(1)]
            for i, j in _pieces(texts):
                flat = Flat(texts[i:j], length)
                at, gram, _, _ = flat.anchors()
                now = gram % np.uint64(ROUNDS) == part
                at, gram = at[now], gram[now]
                owner = flat.owners(at)
                ctx, seat = flat.seats(at, owner)
                parts.append((ids[i:j][owner], gram, ctx, seat, flat.sides(at, gram)))
                held += len(at)
                if held >= GATHER:
                    yield passed(parts)
                    parts, held = [], 0
        if held:
            yield passed(parts)

    return run


_GROUPED = "_doc bigint, _seat bigint, _gram bigint, _ctx bigint, _open boolean"


def _group():
    """Step 2: rows sorted by K-gram, salt, context and document in; settled anchors and those that are still open out."""

    def out(doc, seat, gram, ctx, is_open: bool) -> pa.RecordBatch:
        arrays = [pa.array(doc), pa.array(seat), pa.array(gram) if is_open else pa.nulls(len(doc), pa.int64()), pa.array(ctx) if is_open else pa.nulls(len(doc), pa.int64()), pa.array(np.full(len(doc), is_open))]
        return pa.RecordBatch.from_arrays(arrays, ["_doc", "_seat", "_gram", "_ctx", "_open"])

    def whole(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """All rows of some K-grams."""
        gram, salt, ctx, doc, seat, sides = columns
        late = salt >= SETTLED
        yield out(doc[late], seat[late], None, None, False)
        gram, salt, ctx, doc, seat, sides = (x[~late] for x in columns)
        if not len(gram):
            return
        run = np.cumsum(_starts(gram)) - 1
        common = np.bincount(run, salt == MARKED) > 0
        real = salt != MARKED
        run, gram, salt, ctx, doc, seat, sides = run[real], gram[real], salt[real], ctx[real], doc[real], seat[real], sides[real]
        first = _starts(run, salt, ctx, seat & np.int64(0xFFFFFFFF))
        own = doc == doc[_last_start(first)]
        yield out(doc[~own], seat[~own], None, None, False)
        # A K-gram of several contexts, of which some that agree on a side aren't all in one document.
        several = own & (np.bincount(run[first], minlength=len(common)) > 1)[run]
        is_open = own & ((salt > PLAIN) | common[run])
        some = np.flatnonzero(several & ~is_open)
        for side in (sides >> np.int64(32), sides & np.int64(0xFFFFFFFF)):
            order = some[np.lexsort((side[some], run[some]))]
            if len(new := np.flatnonzero(_starts(run[order], side[order]))):
                apart = np.minimum.reduceat(doc[order], new) != np.maximum.reduceat(doc[order], new)
                is_open[order] |= np.repeat(apart, np.diff(np.r_[new, len(order)]))
        yield out(doc[is_open], seat[is_open], gram[is_open], ctx[is_open], True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last K-gram may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [c.to_numpy() for c in batch.columns]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            cut = int(np.flatnonzero(_starts(now[0]))[-1])
            if not cut and len(now[0]) > GATHER:
                # One K-gram in so many contexts: what has come goes on as parts of a common one, and what comes is marked.
                parts = [*now]
                parts[1] = np.where(now[1] == PLAIN, 1, now[1])
                yield from whole(parts)
                held = [x[-1:] for x in now]
                held[1] = np.array([MARKED], now[1].dtype)
                continue
            if cut:
                yield from whole([x[:cut] for x in now])
            held = [x[cut:] for x in now]
        if held is not None:
            yield from whole(held)

    return run


def _nearest_smaller(x: np.ndarray) -> np.ndarray:
    """Nearest earlier position with a smaller value, -1 if there is none: pointers over larger ones are doubled."""
    at = np.arange(-1, len(x) - 1)
    todo = np.flatnonzero((at >= 0) & (x[at] >= x))
    while len(todo):
        at[todo] = at[at[todo]]
        todo = todo[(at[todo] >= 0) & (x[at[todo]] >= x[todo])]
    return at


def longest_previous_factors(suffixes: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Of suffixes (rows of bytes), the most leading bytes that each shares with one of a smaller document.

    In suffix order, of all positions of smaller documents on one side the nearest shares the most bytes.
    """
    n, width = suffixes.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = suffixes
    order = np.lexsort(padded.view(">u8").T[::-1])
    rows, doc = suffixes[order], docs[order]
    out = np.zeros(n, np.int64)
    for near in (_nearest_smaller(doc), n - 1 - _nearest_smaller(doc[::-1])[::-1]):
        some = np.flatnonzero((near >= 0) & (near < n))
        differ = rows[some] != rows[near[some]]
        shared = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        out[order[some]] = np.maximum(out[order[some]], shared)
    return out


def _windows(contexts: np.ndarray, low: np.ndarray, high: np.ndarray, length: int):
    """Of each context the windows that pick its anchor: owner, distance before the anchor, and the bytes."""
    size = high - low + 1
    owner = np.repeat(np.arange(len(low)), size)
    back = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + low[owner]
    flat = np.lib.stride_tricks.sliding_window_view(contexts.ravel(), length)
    return owner, back, flat[owner * contexts.shape[1] + (length - K) - back]


def previous_factors(contexts: np.ndarray, low: np.ndarray, high: np.ndarray, docs: np.ndarray, length: int) -> np.ndarray:
    """Bits of the windows (bit s: it starts s bytes before the anchor) with a previous factor of ``length``."""
    owner, back, suffixes = _windows(contexts, low, high, length)
    # Suffixes whose hash no other has share fewer bytes than asked, so they needn't be sorted.
    padded = np.zeros((len(owner), -(-length // 8) * 8), np.uint8)
    padded[:, :length] = suffixes
    h = np.full(len(owner), _FACTORS[0])
    for w in padded.view(np.uint64).T:
        h = (h ^ w) * _FACTORS[1]
        h ^= h >> np.uint64(31)
    order = np.argsort(h)
    new = _starts(h[order])
    alone = new & np.r_[new[1:], True]
    some = np.sort(order[~alone])
    out = np.zeros(len(low), np.uint64)
    if len(some):
        hit = some[longest_previous_factors(suffixes[some], docs[owner[some]]) >= length]
        np.bitwise_or.at(out, owner[hit], np.uint64(1) << back[hit].astype(np.uint64))
    return out


_CONTEXTS = "_gram bigint, _doc bigint, _low int, _high int, _text binary, _seats array<bigint>"


def _contexts(length: int):
    """Step 3: documents with their open anchors in, one row a context out."""
    reach = 2 * length - K

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            ids, texts = batch.column(0).to_numpy(), [_bytes(x) for x in batch.column(1)]
            seats = batch.column(2).flatten().to_numpy()
            ends = np.r_[0, np.cumsum(batch.column(2).value_lengths().to_numpy())]
            for i, j in _pieces(texts):
                flat = Flat(texts[i:j], length)
                at, gram, low, high = flat.anchors()
                owner = flat.owners(at)
                ctx, seat = flat.seats(at, owner)
                # An open anchor is in its text's list by its seat, else it is of another row of this id.
                want_owner = np.repeat(np.arange(j - i), np.diff(ends[i : j + 1]))
                want = seats[ends[i] : ends[j]]
                place = flat.starts[want_owner] + (want >> np.int64(32))
                k = np.minimum(np.searchsorted(at, place), max(0, len(at) - 1))
                good = (at[k] == place) & (seat[k] == want) if len(at) else np.zeros(len(want), bool)
                k = k[good]
                if not len(k):
                    continue
                order = np.lexsort((k, seat[k] & np.int64(0xFFFFFFFF), ctx[k], gram[k], owner[k]))
                k = k[order]
                first = np.flatnonzero(_starts(owner[k], gram[k], ctx[k], seat[k] & np.int64(0xFFFFFFFF)))
                one = k[first]
                bytes_ = np.frombuffer(flat.data, np.uint8)[(at[one] - flat.before)[:, None] + np.arange(reach)]
                text = pa.Array.from_buffers(pa.binary(), len(one), [None, pa.py_buffer((np.arange(len(one) + 1) * reach).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(bytes_))])
                arrays = [gram[one].view(np.int64), ids[i:j][owner[one]], (at[one] - high[one]).astype(np.int32), (at[one] - low[one]).astype(np.int32)]
                listed = pa.ListArray.from_arrays(pa.array(np.r_[first, len(k)].astype(np.int32)), pa.array(seat[k]))
                yield pa.RecordBatch.from_arrays([*map(pa.array, arrays), text, listed], ["_gram", "_doc", "_low", "_high", "_text", "_seats"])

    return run


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _halves(rows: DataFrame, length: int) -> DataFrame:
    """Each context twice: with the windows that hold the side before the anchor, and with those that hold the side after it; ``_gram`` is made of the side too."""
    left = (length - K) // 2
    before = F.struct(F.xxhash64("_gram", F.lit(0), F.substring("_text", length - K - left + 1, left)).alias("_gram"), F.greatest("_low", F.lit(left)).alias("_low"), "_high")
    after = F.struct(F.xxhash64("_gram", F.lit(1), F.substring("_text", length + 1, length - K - left + 1)).alias("_gram"), "_low", F.least("_high", F.lit(left - 1)).alias("_high"))
    return rows.withColumn("_half", F.explode(F.array(before, after))).select("_half.*", "_doc", "_text", "_seats").where("_low <= _high")


_HITS = "_doc bigint, _seat bigint, _mask bigint"


def _hits(rows: pa.RecordBatch | pa.Table, hit: np.ndarray, masks: np.ndarray) -> pa.RecordBatch:
    listed = rows["_seats"].take(pa.array(hit)).to_pylist()
    sizes = [len(x) for x in listed]
    doc = rows["_doc"].to_numpy()[hit]
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(doc, sizes)), pa.array([s for x in listed for s in x], pa.int64()), pa.array(np.repeat(masks[hit].view(np.int64), sizes))], ["_doc", "_seat", "_mask"])


def _compare(length: int):
    """Contexts sorted by K-gram in, repeated windows out; a K-gram's contexts are kept together."""

    def whole(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts)
        low, high, doc = (rows[c].to_numpy().astype(np.int64) for c in ("_low", "_high", "_doc"))
        if doc.min() == doc.max():
            return _hits(rows, np.empty(0, np.int64), np.empty(0, np.uint64))
        masks = previous_factors(_matrix(rows["_text"], 2 * length - K), low, high, doc, length)
        return _hits(rows, np.flatnonzero(masks), masks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for part in (batch.slice(i, HOT) for i in range(0, batch.num_rows, HOT)):
                gram = part.column(0).to_numpy()
                cut = int(np.flatnonzero(_starts(gram))[-1])
                if held and (cut or held[-1].column(0)[-1].as_py() != gram[0]):
                    yield whole([*held, part.slice(0, cut)])
                    held = []
                elif cut:
                    yield whole([part.slice(0, cut)])
                held.append(part.slice(cut))
        if held:
            yield whole(held)

    return run


def _spread(length: int):
    """Contexts of common K-grams in, a row a window out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, HOT) for i in range(0, batch.num_rows, HOT)):
                low, high = (part[c].to_numpy().astype(np.int64) for c in ("_low", "_high"))
                owner, back, suffixes = _windows(_matrix(part["_text"], 2 * length - K), low, high, length)
                text = pa.Array.from_buffers(pa.binary(), len(owner), [None, pa.py_buffer((np.arange(len(owner) + 1) * length).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(suffixes))])
                yield pa.RecordBatch.from_arrays([text, part["_doc"].take(pa.array(owner)), pa.array(np.int64(1) << back), part["_seats"].take(pa.array(owner))], ["_window", "_doc", "_mask", "_seats"])

    return run


def _cut(length: int, keep: bool):
    """Step 4: texts with their settled windows in; what is left out."""

    def runs(texts: list[bytes], owner: np.ndarray, seat: np.ndarray, mask: np.ndarray) -> list[list[tuple[int, int]]]:
        """The repeated runs (from, to) of each text."""
        flat = Flat(texts, length)
        at = flat.starts[owner] + (seat >> np.int64(32))
        fits = at <= (flat.starts + flat.sizes)[owner] - K
        at, owner, seat, mask = at[fits], owner[fits], seat[fits], mask[fits]
        good = flat.seats(at, owner)[1] == seat  # else of another row of this id
        order = np.argsort(at[good], kind="stable")
        at, mask = at[good][order], mask[good][order].view(np.uint64)
        found = []
        for windows, anchor in flat.stretches():
            base = int(windows[0])
            lo, hi = np.searchsorted(at, [base, int(anchor[-1]) + 1])
            if lo == hi:
                continue
            bits = np.zeros(int(anchor[-1]) - base + 1, np.uint64)
            np.bitwise_or.at(bits, at[lo:hi] - base, mask[lo:hi])
            found.append(windows[(bits[anchor - base] >> (anchor - windows).astype(np.uint64)) & np.uint64(1) > 0])
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        if not found or not len(starts := np.concatenate(found)):
            return out
        of = flat.owners(starts)
        new = np.flatnonzero(np.r_[True, (starts[1:] > starts[:-1] + length) | (of[1:] != of[:-1])])
        ends = starts[np.r_[new[1:] - 1, len(starts) - 1]] + length
        for k, a, b in zip(of[new].tolist(), (starts[new] - flat.starts[of[new]]).tolist(), (ends - flat.starts[of[new]]).tolist(), strict=True):
            out[k].append((a, b))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            texts = [_bytes(x) for x in batch.column(1)]
            flags = batch.column(2)
            sizes = np.array([0 if x is None else x for x in flags.value_lengths().to_pylist()], np.int64)
            some = np.flatnonzero(sizes)
            flat_flags = flags.flatten()
            seat, mask = (flat_flags.field(i).to_numpy() for i in range(2))
            ends = np.r_[0, np.cumsum(sizes[some])]
            gone: dict[int, list[tuple[int, int]]] = {}
            chosen = [texts[i] for i in some]
            for i, j in _pieces(chosen):
                owner = np.repeat(np.arange(j - i), sizes[some[i:j]])
                for k, found in zip(some[i:j].tolist(), runs(chosen[i:j], owner, seat[ends[i] : ends[j]], mask[ends[i] : ends[j]]), strict=True):
                    gone[k] = found
            columns: list[list] = [[] for _ in range(5)]
            for k, data in enumerate(texts):
                cuts = gone.get(k, [])
                left = [data[a:b] for a, b in zip([0, *(b for _, b in cuts)], [*(a for a, _ in cuts), len(data)], strict=True)]
                kept = b"".join(left)
                for into, x in zip(columns, (len(data), len(data) - len(kept), len(cuts), hashlib.sha256(kept).hexdigest(), kept), strict=True):
                    into.append(x)
            arrays = [batch.column(0), *(pa.array(x, pa.int64()) for x in columns[:3]), pa.array(columns[3], pa.string())]
            if keep:
                arrays.append(pa.array(columns[4], pa.binary()))
            yield pa.RecordBatch.from_arrays(arrays, ["_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * keep)

    return run


def remove_repeats(docs: DataFrame, id_col: str, text_col: str, length: int = 50, keep_bytes: bool = False) -> DataFrame:
    """Remove each byte covered by a ``length``-byte string that also starts in a document of a smaller id.

    Returns ``id_col``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and, with ``keep_bytes``, ``kept`` (binary: cuts need not fall between characters).
    Strings are judged on the input; matches never cross documents. Null counts as empty, and a text shorter than ``length`` is kept whole. Ids are
    integers; rows of one id are one document's in so far as they don't repeat each other, and each gets a row. Rows with a null id are kept whole.
    A very long text is one value in one task, worked on a stretch at a time. Other columns are ignored; an empty table gives an empty table.
    """
    if not K + 8 <= length <= K + 63:
        raise ValueError(f"length must be {K + 8} to {K + 63}")
    n = parallelism(docs, 6 << 20)
    each = max(1, -(-n // ROUNDS))
    docs = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("_text"))
    known = docs.where("_id is not null")
    # Rows of a K-gram meet, but for parts of common ones and settled rows, which are dealt by their salt too.
    dealt_by = F.greatest("_salt", F.lit(PLAIN))

    def anchors(part: int) -> DataFrame:
        listed = known.mapInArrow(_scan(length, part), _LISTED)
        return materialise(listed.repartition(each, "_gram", dealt_by).sortWithinPartitions("_gram", "_salt", "_ctx", "_doc").mapInArrow(_group(), _GROUPED), "anchors", passing=True)

    grouped = reduce(DataFrame.unionByName, map(anchors, range(ROUNDS)))
    is_open = grouped.where("_open")
    hot = materialise(is_open.groupBy("_gram").count().where(F.col("count") > HOT).select("_gram", F.lit(True).alias("_hot")), "common", passing=True)
    # Texts are dealt to documents once; each join below and the last one read the same shuffle.
    dealt = known.repartition(n, "_id")

    def contexts(rows: DataFrame) -> DataFrame:
        wanted = rows.groupBy(F.col("_doc").alias("_id")).agg(F.collect_list("_seat").alias("_open"))
        return dealt.join(wanted.hint("shuffle_hash"), "_id").select("_id", "_text", "_open").mapInArrow(_contexts(length), _CONTEXTS)

    flags = grouped.where("not _open").select("_doc", "_seat", F.lit(-1).cast("bigint").alias("_mask"))
    compared = contexts(is_open)
    if not hot.isEmpty():
        looked = materialise(salted_lookup(is_open, hot, "_gram", F.col("_ctx"), grows=False).select("_doc", "_seat", "_gram", "_hot"), "open", passing=True)
        halves = materialise(_halves(contexts(looked.where("_hot")), length), "halves", passing=True)
        hotter = materialise(halves.groupBy("_gram").count().where(F.col("count") > HOT).select("_gram", F.lit(True).alias("_hot")), "hotter", passing=True)
        halves = salted_lookup(halves, hotter, "_gram", F.col("_doc"), grows=False)
        compared = contexts(looked.where("_hot is null")).unionByName(halves.where("_hot is null").drop("_hot"))
        spread = halves.where("_hot").select("_doc", "_low", "_high", "_text", "_seats").mapInArrow(_spread(length), "_window binary, _doc bigint, _mask bigint, _seats array<bigint>")
        least = spread.groupBy("_window").agg(F.min("_doc").alias("_least"), F.max("_doc").alias("_most")).where("_least < _most").select("_window", "_least")
        flags = flags.unionByName(salted_lookup(spread, least, "_window", F.col("_doc")).where("_doc > _least").select("_doc", F.explode("_seats").alias("_seat"), "_mask"))
    compared = compared.repartition(n, "_gram").sortWithinPartitions("_gram").mapInArrow(_compare(length), _HITS)
    flags = flags.unionByName(compared).groupBy(F.col("_doc").alias("_id")).agg(F.collect_list(F.struct("_seat", "_mask")).alias("_flags"))
    schema = "_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * keep_bytes
    rows = dealt.join(flags.hint("shuffle_hash"), "_id", "left").select("_id", "_text", "_flags")
    rows = rows.unionByName(docs.where("_id is null").select("_id", "_text", F.lit(None).cast("array<struct<_seat: bigint, _mask: bigint>>").alias("_flags")))
    return rows.mapInArrow(_cut(length, keep_bytes), schema).withColumnRenamed("_id", id_col)


def oracle() -> str:
    """DuckDB SQL for 50-byte repeats of documents, window by window."""
    return """
WITH b AS (SELECT doc_id, octet_length(coalesce(encode(text), ''::BLOB)) AS n, hex(coalesce(encode(text), ''::BLOB)) AS h FROM documents),
     part AS (SELECT doc_id, q * 256 AS start, substr(h, q * 512 + 1, 610) AS h FROM (SELECT doc_id, h, unnest(range((n - 49 + 255) // 256)) AS q FROM b WHERE n >= 50)),
     w AS (SELECT doc_id, start + i + 1 AS p, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, start, h, unnest(range(least(256, (length(h) // 2) - 49))) AS i FROM part)),
     f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY 1 HAVING min(doc_id) < max(doc_id)),
     hit AS (SELECT doc_id, p FROM w JOIN f USING (s) WHERE doc_id > first),
     run AS (SELECT doc_id, min(p) AS a, max(p) + 49 AS z FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM (SELECT *, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS new FROM hit)) GROUP BY doc_id, g),
     cut AS (SELECT doc_id, sum(z - a + 1) AS n_removed, count(*) AS n_spans, list({'a': a, 'z': z} ORDER BY a) AS runs FROM run GROUP BY 1)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(CASE WHEN runs IS NULL THEN unhex(h) ELSE unhex(array_to_string(list_transform(range(0, len(runs) + 1), lambda i: substr(h, (2 * CASE WHEN i = 0 THEN 0 ELSE runs[i].z END + 1)::BIGINT, (2 * greatest(0, CASE WHEN i = len(runs) THEN n ELSE runs[i + 1].a - 1 END - CASE WHEN i = 0 THEN 0 ELSE runs[i].z END))::BIGINT)), '')) END) AS kept_sha256
FROM b LEFT JOIN cut USING (doc_id)
    """
