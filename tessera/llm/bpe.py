"""Byte-level BPE encoding and decoding by a monoid tree reduction.

A piece (one match of the splitting pattern) is encoded by halving: each half is encoded on its own,
and neighbours are joined by encoding a window of tokens around the seam again, a window that grows
until the tokens outside of it provably stay as they are.

The proof: a token sequence is what greedy lowest-rank-first merging gives for its bytes exactly
when each two neighbouring tokens, encoded together, give these two tokens again. (Look at the first
merge that would cross a boundary between two tokens. Until then every token's bytes merged as they do
alone, so the best pair at that moment is also the best one when only these two tokens are encoded.)
So a join is right once the pairs at both ends of the window are stable.

Joining is associative and the empty sequence is neutral; pieces join by concatenation since
merges never cross them, and decoding concatenates the tokens' bytes up the same tree.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a leaf of the tree, and tokens of a leaf when decoding.
LEAF, TOKENS = 32, 1024
#: Pieces kept in a worker's cache, and the longest piece kept.
CACHE_ROWS, CACHE_PIECE = 500_000, 64


def _split(pattern: str):
    """``findall`` of the splitting pattern, with a faster matcher for texts of characters below 256.

    There the Unicode classes are written out character by character; ``\\s`` is the White_Space property, which
    the standard library's own ``\\s`` isn't. Other texts, and patterns with more syntax, go to ``regex``.
    """
    slow = regex.compile(pattern).findall
    names = {rf"\{k}": "".join(re.escape(c) for c in map(chr, range(256)) if regex.match(rf"\{k}", c)) for k in ("p{L}", "p{N}", "s")}
    body, depth, i, out = pattern, 0, 0, []
    while i < len(body):
        name = next((k for k in (*names, r"\S") if body.startswith(k, i)), None)
        if name is None:
            if body[i] == "\\" or (body.startswith("(?", i) and not body.startswith("(?!", i)):
                return slow
            depth += {"[": 1, "]": -1}.get(body[i], 0)
            out.append(body[i])
        elif name == r"\S":
            if depth:
                return slow
            out.append(f"[^{names[chr(92) + 's']}]")
        else:
            out.append(names[name] if depth else f"[{names[name]}]")
        i += len(name or "x")
    fast = re.compile("".join(out)).findall

    def findall(text: str) -> list[str]:
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return slow(text)
        return fast(text)

    return findall


class Ranks:
    """A vocabulary of ranked byte strings."""

    def __init__(self, lines: bytes, pattern: str):
        self.rank = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines.splitlines() if x.strip())}
        self.bytes_of = [b""] * (max(self.rank.values()) + 1)
        for token, k in self.rank.items():
            self.bytes_of[k] = token
        self.byte_ids = [self.rank[bytes([b])] for b in range(256)]
        #: Two tokens that together are a token: the merged one.
        self.pair = {(a, b): k for token, k in self.rank.items() for i in range(1, len(token)) if (a := self.rank.get(token[:i])) is not None and (b := self.rank.get(token[i:])) is not None}
        self.findall = _split(pattern)
        self._pairs: dict[tuple[int, int], bool] = {}
        self._packed = _Packed(self)

    def merge(self, data: bytes) -> list[int]:
        """Greedy merging of a short run: the lowest rank first, the leftmost of equals."""
        get, none = self.pair.get, len(self.bytes_of)
        out = list(map(self.byte_ids.__getitem__, data))
        ranks = [get(p, none) for p in zip(out, out[1:], strict=False)]
        while ranks:
            k = min(ranks)
            if k == none:
                break
            i = ranks.index(k)
            out[i : i + 2] = [k]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = get((k, out[i + 1]), none)
            if i:
                ranks[i - 1] = get((out[i - 1], k), none)
        return out

    def stable(self, a: int, b: int) -> bool:
        """Whether two neighbouring tokens stay as they are."""
        known = self._pairs.get((a, b))
        if known is None:
            if len(self._pairs) > CACHE_ROWS:
                self._pairs.clear()
            both = self.bytes_of[a] + self.bytes_of[b]
            known = self._pairs[(a, b)] = self._window(both) == [a, b]
        return known

    def _window(self, data: bytes) -> list[int]:
        """A window's tokens. Tokens may be long (runs of blanks), so it uses a heap when it is."""
        return self.merge(data) if len(data) <= 4 * LEAF else _heap_merge(self.rank, data)

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The product of the monoid: the tokens of the concatenated bytes."""
        if not left or not right:
            return left or right
        if self.stable(left[-1], right[0]):
            return left + right
        k = 1
        while True:
            a, b = max(0, len(left) - k), min(len(right), k)
            middle = self._window(b"".join(self.bytes_of[t] for t in left[a:] + right[:b]))
            left_ok = a == 0 or self.stable(left[a - 1], middle[0])
            right_ok = b == len(right) or self.stable(middle[-1], right[b])
            if left_ok and right_ok:
                return left[:a] + middle + right[b:]
            k *= 2

    def encode_bytes(self, data: bytes) -> list[int]:
        """Tokens of a piece's bytes by halves, bottom up, so that depth costs no stack."""
        if not data:
            return []
        level = [self.merge(data[i : i + LEAF]) for i in range(0, len(data), LEAF)]
        while len(level) > 1:
            level = [self.join(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0]

    def encode_piece(self, piece: str) -> list[int]:
        data = piece.encode("utf-8", "surrogatepass")
        whole = self.rank.get(data)
        return [whole] if whole is not None else self.encode_bytes(data)

    def encode_packed(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        packed = self._packed
        if len(packed) > CACHE_ROWS:
            packed.clear()
        return b"".join(map(packed.__getitem__, self.findall(text)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<u4").tolist()

    def decode(self, ids) -> bytes:
        """Bytes of the ids: leaves of some tokens, of which neighbours are concatenated level by level."""
        get = self.bytes_of.__getitem__
        level = [b"".join(map(get, ids[i : i + TOKENS])) for i in range(0, len(ids), TOKENS)] or [b""]
        while len(level) > 1:
            level = [b"".join(level[i : i + 2]) for i in range(0, len(level), 2)]
        return level[0]


class _Packed(dict):
    """Piece to packed ids; only short pieces are kept."""

    def __init__(self, ranks: Ranks):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: str) -> bytes:
        ids = self.ranks.encode_piece(piece)
        ids = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= CACHE_PIECE:
            self[piece] = ids
        return ids


def _heap_merge(rank: dict[bytes, int], data: bytes) -> list[int]:
    """The same merging in O(n log n)."""
    from heapq import heapify, heappop, heappush

    n = len(data)
    end = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    heap = [(k, i, i + 1, i + 2) for i in range(n - 1) if (k := rank.get(data[i : i + 2])) is not None]
    heapify(heap)
    alive = [True] * n
    while heap:
        _, i, middle, stop = heappop(heap)
        if not alive[i] or end[i] != middle or middle >= n or not alive[middle] or end[middle] != stop:
            continue
        alive[middle] = False
        end[i] = stop
        if stop < n:
            before[stop] = i
            if (k := rank.get(data[i : end[stop]])) is not None:
                heappush(heap, (k, i, stop, end[stop]))
        if (p := before[i]) >= 0 and (k := rank.get(data[p:stop])) is not None:
            heappush(heap, (k, p, i, stop))
    out, i = [], 0
    while i < n:
        out.append(rank[data[i : end[i]]])
        i = end[i]
    return out


_LOADED: dict[str, Ranks] = {}


def load(path: str, pattern: str | None = None) -> Ranks:
    """The vocabulary of a rank file, read once a process."""
    if path not in _LOADED:
        if pattern is None:
            from public_tokenizers import PATTERN as pattern  # noqa: N811
        with open(path, "rb") as f:
            _LOADED[path] = Ranks(f.read(), pattern)
    return _LOADED[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


SLICE = 256


def encode_texts(docs: DataFrame, id_col: str, text_col: str, vocabulary: str | None = None, ids: bool = True, digests: bool = False) -> DataFrame:
    """Encode a text column. Null counts as empty; an empty text has no tokens.

    Returns ``id_col``, ``n_tokens``, with ``ids`` also ``token_ids`` (array of int), and with ``digests``
    ``ids_sha256`` and ``decoded_sha256`` (of the decoded bytes). One row a row of the input, repeated ids
    included. No shuffle: documents are encoded where they are read, in slices of a bounded number of rows.
    Every column but the two named is ignored, whatever its name.
    """
    vocabulary = vocabulary or default_vocabulary()
    schema = [f"_id {dict(docs.dtypes)[id_col]}", "n_tokens bigint"] + ["token_ids array<int>"] * ids + ["ids_sha256 string", "decoded_sha256 string"] * digests

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load(vocabulary)
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE):
                batch = whole.slice(start, SLICE)
                counts, lists, one, two = [], [], [], []
                for value in batch.column(1):
                    packed = ranks.encode_packed(value.as_py() or "")
                    tokens = np.frombuffer(packed, "<u4")
                    counts.append(len(tokens))
                    if ids:
                        lists.append(tokens.astype(np.int32))
                    if digests:
                        one.append(hashlib.sha256(packed).hexdigest())
                        two.append(hashlib.sha256(ranks.decode(tokens.tolist())).hexdigest())
                columns = [batch.column(0), pa.array(counts, pa.int64())]
                names = ["_id", "n_tokens"]
                if ids:
                    columns.append(pa.array(lists, pa.list_(pa.int32())))
                    names.append("token_ids")
                if digests:
                    columns += [pa.array(one, pa.string()), pa.array(two, pa.string())]
                    names += ["ids_sha256", "decoded_sha256"]
                yield pa.RecordBatch.from_arrays(columns, names)

    docs = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return docs.mapInArrow(run, ", ".join(schema)).withColumnRenamed("_id", id_col)


def decode_ids(rows: DataFrame, id_col: str, ids_col: str, vocabulary: str | None = None) -> DataFrame:
    """Decode arrays of ids: ``id_col`` and ``decoded`` (binary: ids need not end on a character).

    A null array is decoded as an empty one.
    """
    vocabulary = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load(vocabulary)
        for batch in batches:
            out = [ranks.decode(x.as_py() or []) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["_id", "decoded"])

    rows = rows.select(F.col(id_col).alias("_id"), F.col(ids_col).alias("_ids"))
    return rows.mapInArrow(run, f"_id {dict(rows.dtypes)['_id']}, decoded binary").withColumnRenamed("_id", id_col)
