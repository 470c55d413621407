"""SimHash near-duplicates, found with pivot distance tables.

A fingerprint's row of the table holds its Hamming distances to fixed reference fingerprints. By the
triangle inequality two fingerprints within r bits differ by at most r in every coordinate, so a pair with a larger
coordinate difference is discarded unseen, and only survivors are compared bit by bit.

Coordinates of uniform fingerprints are too alike to deal the work out (a random reference keeps nearly half of all
pairs), so the table is cut up first: of r + 1 disjoint groups of bits one must be equal, and the fingerprints that
share a group of bits meet in a bucket. A bucket with too many members is cut up again by its remaining bits, of
which one of r + 1 subgroups must again be equal. No member is dropped: after DEPTH cuts a bucket is worked on whatever its size, which the bits
that are still free bound. Its members differ in few bits, so that they are mostly linked, and linked members leave the search at once.
The table is made once, where fingerprints are listed, and its rows travel with them.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialise, measured_lookup, parallelism, salted_lookup
from ._graph import components

#: Members from which a bucket is cut up again; members up to which pairs are compared by offsets.
BUCKET, SMALL = 4096, 8
#: Cuts at most. With four groups each, 21 of 64 bits are free after four, so that no bucket can have more than two million different members.
DEPTH = 4
REFERENCES = 16
#: Keys of a set of shingles, least hashes of a key, lowest hashes that a set is held by, and deviations of a share of equal ones that are allowed for.
BANDS, ROWS, KEPT, SHY = 24, 4, 512, 4.3
_MIX = 0x9E3779B97F4A7C15


def references(n: int = REFERENCES) -> np.ndarray:
    """The reference fingerprints: a fixed pseudo-random sequence."""
    with np.errstate(over="ignore"):
        x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_MIX)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def hashes(text: str, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle: words of lower-cased (A-Z only) text between ASCII white space."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(tokens) - words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)), np.uint64, len(starts))


def fingerprint(text: str | None, words: int = 3) -> int:
    """Bits set in over half of the shingles' hashes; 0 for a text without words (null included)."""
    return _majority(hashes(text or "", words))


def _majority(h: np.ndarray) -> int:
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        rows = np.unpackbits(h[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for j in range(0, len(rows), 255):
            ones += np.add.reduce(rows[j : j + 255], axis=0, dtype=np.uint8)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int = 3) -> DataFrame:
    """``_id`` and ``_fp`` (the fingerprint's bits as a signed 64-bit integer), where documents are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.fromiter((fingerprint(x.as_py(), words) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits.view(np.int64))], ["_id", "_fp"])

    docs = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return docs.mapInArrow(run, f"_id {dict(docs.dtypes)['_id']}, _fp bigint")


def _cuts(mask: int, parts: int) -> list[int]:
    """The mask with each of ``parts`` groups of its free bits added."""
    free = [i for i in range(64) if not mask >> i & 1]
    return [mask | sum(1 << i for i in free[k * len(free) // parts : (k + 1) * len(free) // parts]) for k in range(parts)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def with_table(fps: DataFrame) -> DataFrame:
    """Fingerprints (``_fp``) with their rows of the pivot table, ``_table``."""
    return fps.withColumn("_table", F.array(*[F.bit_count(F.col("_fp").bitwiseXOR(F.lit(_signed(int(r))))).cast("tinyint") for r in references()]))


def linked_in_bucket(fps: np.ndarray, table: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest of the links of one bucket's distinct fingerprints.

    Each member is compared once, with the members that no tree has reached yet, so that dense groups are quick.
    """
    order = np.argsort(table[:, 0], kind="stable")
    fps, table = fps[order], table[order]
    rest, out, frontier = np.arange(len(fps)), [], []
    while len(rest) or frontier:
        if not frontier:
            frontier, rest = [rest[0]], rest[1:]
        if not len(rest):
            break
        x = frontier.pop()
        lo, hi = np.searchsorted(table[rest, 0], [table[x, 0] - radius, table[x, 0] + radius + 1])
        near = rest[lo:hi]
        near = near[np.abs(table[near] - table[x]).max(axis=1, initial=0) <= radius]
        near = near[np.bitwise_count(fps[near] ^ fps[x]) <= radius]
        if len(near):
            out.append((np.full(len(near), fps[x]), fps[near]))
            rest = np.setdiff1d(rest, near, assume_unique=True)
            frontier.extend(near.tolist())
    return out


def _links(radius: int):
    def whole_runs(fps: np.ndarray, table: np.ndarray, run: np.ndarray) -> pa.RecordBatch:
        """fps and their buckets' numbers, all members of each bucket together."""
        ones, twos = [], []
        starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
        sizes = np.diff(np.r_[starts, len(run)])
        small = np.repeat(sizes <= SMALL, sizes)
        for o in range(1, int(min(SMALL, sizes.max()))):
            i = np.flatnonzero((run[o:] == run[:-o]) & small[o:])
            i = i[np.abs(table[i, 0] - table[i + o, 0]) <= radius]
            i = i[np.abs(table[i] - table[i + o]).max(axis=1, initial=0) <= radius]
            i = i[np.bitwise_count(fps[i] ^ fps[i + o]) <= radius]
            ones.append(fps[i])
            twos.append(fps[i + o])
        for k in np.flatnonzero(sizes > SMALL):
            for a, b in linked_in_bucket(fps[starts[k] : starts[k] + sizes[k]], table[starts[k] : starts[k] + sizes[k]], radius):
                ones.append(a)
                twos.append(b)
        a, b = (np.concatenate(x) if x else np.empty(0, np.uint64) for x in (ones, twos))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last bucket may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            now.append(batch.column(3).flatten().to_numpy().reshape(batch.num_rows, -1))
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            fps, path, part, table = now
            new = np.r_[False, (path[1:] != path[:-1]) | (part[1:] != part[:-1])]
            cut = int(np.flatnonzero(new)[-1]) if new.any() else 0
            if cut:
                yield whole_runs(fps[:cut].view(np.uint64), table[:cut].astype(np.int16), np.cumsum(new[:cut]))
            held = [x[cut:] for x in now]
        if held is not None:
            yield whole_runs(held[0].view(np.uint64), held[3].astype(np.int16), np.zeros(len(held[0]), np.int64))

    return run


def links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """Links ``a``, ``b`` that connect all distinct fingerprints (``_fp``, with their ``_table``) within ``radius`` bits of each other.

    Every two linked fingerprints share a bucket, and a bucket's links form a spanning forest of it; so
    components are those of all links, though not every link between members of one component is returned.
    """
    parts = radius + 1
    masks = [0]
    rows = fps.select("_fp", "_table", F.lit(0).alias("_path"))
    out = None
    for depth in range(1, DEPTH + 1):
        masks = [m for mask in masks for m in _cuts(mask, parts)]
        table = F.array(*[F.lit(_signed(m)) for m in masks])
        rows = rows.select("_fp", "_table", F.explode(F.array(*[F.col("_path") * parts + k for k in range(parts)])).alias("_path"))
        rows = rows.withColumn("_part", F.col("_fp").bitwiseAND(F.get(table, F.col("_path"))))
        more = False
        if depth < DEPTH:
            size = rows.groupBy("_path", "_part").count()
            large = materialise(size.where(F.col("count") > BUCKET).select("_path", "_part"), "buckets")
            more = not large.isEmpty()
        here = rows.join(large, ["_path", "_part"], "left_anti") if more else rows
        here = here.select("_fp", "_path", "_part", "_table")
        # A hash deals the buckets out; sorting brings each bucket's rows together.
        n = parallelism(fps, 4 << 20) * parts
        found = here.repartition(n, "_path", "_part").sortWithinPartitions("_path", "_part").mapInArrow(_links(radius), "a bigint, b bigint").distinct()
        out = found if out is None else out.unionByName(found)
        if not more:
            break
        rows = materialise(rows.join(large, ["_path", "_part"], "left_semi").select("_fp", "_table", "_path"), "refine")
    return out


def near_duplicates(docs: DataFrame, id_col: str, text_col: str, words: int = 3, radius: int = 3) -> DataFrame:
    """``id_col``, ``fingerprint`` (16 hex digits) and ``component_id`` (least id reachable over links of at most ``radius`` bits).

    Null, empty and blank texts have fingerprint 0 and are linked as any other. A text of fewer words than a shingle is one
    shingle. Repeated rows each get a row. Rows with a null id take part, but a null is never the least id. An empty table gives an empty table.
    Other columns are ignored. Documents with equal fingerprints are one class from the start: only distinct fingerprints are compared.
    """
    prints = materialise(fingerprints(docs, id_col, text_col, words), "fingerprints")
    fps = materialise(with_table(prints.groupBy("_fp").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))), "distinct")
    found = components(links(fps, radius), "a", "b").select(F.col("node").alias("_fp"), F.col("root").alias("_root"))
    joined = fps.join(found, "_fp", "left").withColumn("_root", F.coalesce("_root", "_fp"))
    least = joined.groupBy("_root").agg(F.min("_first").alias("_component"))
    classes = salted_lookup(joined, least, "_root", F.col("_fp"))
    # Only classes of several documents need a row to look up.
    several = classes.where((F.col("_n") > 1) | ~F.col("_component").eqNullSafe(F.col("_first"))).select("_fp", "_component")
    out = salted_lookup(prints, several, "_fp", F.col("_id"))
    return out.select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), F.coalesce("_component", "_id").alias("component_id"))


def bands(shingles: np.ndarray) -> tuple[np.ndarray, bytes]:
    """A key for each band of a set's least hashes, and the lowest byte of each.

    Sets of similarity s share a key with probability 1 - (1 - s**ROWS)**BANDS, and each byte with s or a little more.
    """
    least = np.full(BANDS * ROWS, np.uint64(0xFFFFFFFFFFFFFFFF))
    shifts, factors = references(2 * BANDS * ROWS).reshape(2, -1)
    for i in range(0, len(shingles), 2048):
        x = (shingles[i : i + 2048, None] ^ shifts) * (factors | np.uint64(1))
        np.minimum(least, x.min(axis=0), out=least)
    rows = least.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(_MIX)
    for j in range(ROWS):
        key = (key ^ rows[:, j]) * np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(31)
    return key.view(np.int64), (least & np.uint64(255)).astype(np.uint8).tobytes()


def _sets(words: int):
    """Each document's set of shingles: its digest, fingerprint, size and bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, prints, sizes, keys, marks = [], [], [], [], []
            for x in batch.column(1):
                listed = hashes(x.as_py() or "", words)
                shingles = np.unique(listed)
                digests.append(xxhash.xxh64_intdigest(shingles.tobytes(), 7))
                prints.append(_majority(listed))
                sizes.append(len(shingles))
                key, mark = bands(shingles)
                keys.append(key)
                marks.append(mark)
            flat = np.concatenate(keys) if keys else np.empty(0, np.int64)
            arrays = [np.array(digests, np.uint64).view(np.int64), np.array(prints, np.uint64).view(np.int64), np.array(sizes, np.int32)]
            listed = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * BANDS, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, arrays), listed, pa.array(marks, pa.binary())], ["_id", "_set", "_fp", "_n", "_keys", "_marks"])

    return run


def _lowest(words: int):
    """The lowest halves of a set's hashes, sorted, KEPT of them at most: all of a small set, a sketch of a large one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, shingles in _shingles(batches, words):
            low = np.unique(shingles.astype(np.uint32))[:KEPT]
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([low.tobytes()], pa.binary())], ["_set", "_low"])

    return run


def _cross(ratio: tuple[int, int]):
    """Pairs of a band's documents that no links join yet and that may be similar, each at the first band that the two share.

    Sizes must allow it; then the share of equal marks, of which there are BANDS * ROWS, and of equal lowest hashes may fall short of it by SHY deviations
    of such a share. Of sets that have all their hashes among the lowest, that share is the similarity itself and may not fall short.
    """
    over, under = ratio
    wanted = over / under

    def allowed(size):
        return wanted - SHY * np.sqrt(wanted * (1 - wanted) / size)

    def alike(low: list[np.ndarray], i: int, j: np.ndarray) -> np.ndarray:
        """Which of the sets have enough of the lowest hashes in common with set i."""
        mine, good = low[i], np.zeros(len(j), bool)
        for at, other in enumerate(j.tolist()):
            theirs = low[other]
            cut = min((x[-1] for x in (mine, theirs) if len(x) == KEPT), default=None)
            a, b = (mine, theirs) if cut is None else (mine[mine <= cut], theirs[theirs <= cut])
            place = np.searchsorted(a, b)
            both = int((a[np.minimum(place, len(a) - 1)] == b).sum()) if len(a) and len(b) else 0
            whole = len(a) + len(b) - both
            good[at] = under * both >= over * whole if cut is None else both >= allowed(whole) * whole
        return good

    def pairs(keys, sets, sizes, roots, marks, bands_, low) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        ones, twos, held = [], [], 0
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(keys)], strict=True):
            order = a + np.argsort(sizes[a:b], kind="stable")
            n, root = sizes[order], roots[order]
            for i in range(len(order) - 1):
                j = np.arange(i + 1, int(np.searchsorted(n, n[i] * under // over, "right")))
                j = order[j[root[j] != root[i]]]
                if len(j):
                    shared = bands_[j] == bands_[order[i]]
                    j = j[bands_[order[i]][shared.argmax(axis=1)] == keys[a]]
                if len(j):
                    j = j[(marks[j] == marks[order[i]]).mean(axis=1) >= allowed(BANDS * ROWS)]
                if len(j):
                    j = j[alike(low, order[i], j)]
                if len(j):
                    ones.append(np.minimum(sets[j], sets[order[i]]))
                    twos.append(np.maximum(sets[j], sets[order[i]]))
                    held += len(j)
                if held > 1 << 16:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ones, twos)], ["a", "b"])
                    ones, twos, held = [], [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ones, twos)], ["a", "b"])

    def read(batch: pa.RecordBatch) -> list:
        now = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)]
        now.append(np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint8).reshape(batch.num_rows, -1))
        now.append(batch.column(5).flatten().to_numpy().reshape(batch.num_rows, -1))
        return [*now, [np.frombuffer(x, np.uint32) for x in batch.column(6).to_pylist()]]

    def joined(x, y):
        return x + y if isinstance(x, list) else np.concatenate([x, y])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last band's documents may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            now = read(batch) if held is None else [joined(x, y) for x, y in zip(held, read(batch), strict=True)]
            new = np.flatnonzero(now[0][1:] != now[0][:-1])
            cut = int(new[-1]) + 1 if len(new) else 0
            if cut:
                yield from pairs(*[x[:cut] for x in now])
            held = [x[cut:] for x in now]
        if held is not None:
            yield from pairs(*held)

    return run


def _shingles(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[int, np.ndarray]]:
    """Digest and shingles of each row's text (digest, text); other texts of the same id have other sets and are passed over."""
    for batch in batches:
        for key, x in zip(batch.column(0), batch.column(1), strict=True):
            shingles = np.unique(hashes(x.as_py() or "", words))
            if xxhash.xxh64_intdigest(shingles.tobytes(), 7) == key.as_py() % (1 << 64):
                yield key.as_py(), shingles


def _texts_of(wanted: DataFrame, firsts: DataFrame, docs: DataFrame) -> DataFrame:
    """``_set`` and ``_text`` of sets, from the documents that they were first seen in."""
    return wanted.join(firsts, "_set").select("_set", F.col("_first").alias("_id")).join(docs, "_id").select("_set", "_text")


def _similar(pairs: DataFrame, firsts: DataFrame, docs: DataFrame, words: int, ratio: tuple[int, int]) -> DataFrame:
    """Those of the pairs ``a``, ``b`` of sets that have the Jaccard similarity, counted on the sets themselves."""
    over, under = ratio

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, shingles in _shingles(batches, words):
            flat = pa.ListArray.from_arrays(pa.array([0, len(shingles)], pa.int32()), pa.array(shingles.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), flat], ["_set", "_all"])

    pairs = materialise(pairs.distinct(), "candidates")
    wanted = pairs.select(F.col("a").alias("_set")).unionByName(pairs.select(F.col("b").alias("_set"))).distinct()
    sets = materialise(_texts_of(wanted, firsts, docs).mapInArrow(run, "_set bigint, _all array<bigint>").dropDuplicates(["_set"]), "sets")
    # The lesser set of a pair may be in many pairs, the other one too; their shingles are joined to each pair where it is.
    one = sets.select(F.col("_set").alias("a"), F.col("_all").alias("_a"))
    two = sets.select(F.col("_set").alias("b"), F.col("_all").alias("_b"))
    both = measured_lookup(pairs, one, "a", F.col("b")).join(two.hint("shuffle_merge"), "b")
    both = both.withColumn("_c", F.size(F.array_intersect("_a", "_b")))
    return both.where(under * F.col("_c") >= over * (F.size("_a") + F.size("_b") - F.col("_c"))).select("a", "b")


def similar_documents(docs: DataFrame, id_col: str, text_col: str, words: int = 5, similarity: str = "0.8", radius: int = 3) -> DataFrame:
    """``id_col`` and ``component_id`` (least id reachable over links): linked are documents whose sets of shingles have a Jaccard similarity of at least ``similarity``.

    Fingerprints within ``radius`` bits propose pairs, but fingerprints alone miss most copies that differ. So each set also has BANDS keys
    made of ROWS least hashes each: two sets at 0.8 share one of them with a probability of 0.999997, more alike ones with a greater one. Every key's
    sets are held against one of them first; then all pairs that no link joins yet are, but those whose least hashes show that they are less alike
    (of pairs at 0.8, this leaves out one in 100,000). All proposed pairs are verified by counting their (64-bit hashed) shingles. Texts without words are alike. Rows with a null id are left out. A very long text is one value in one task.
    """
    part = Fraction(similarity)
    ratio = over, under = part.numerator, part.denominator
    docs = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where("_id is not null")
    kind = dict(docs.dtypes)["_id"]
    scanned = materialise(docs.mapInArrow(_sets(words), f"_id {kind}, _set bigint, _fp bigint, _n int, _keys array<bigint>, _marks binary"), "shingle-sets")
    reps = materialise(scanned.groupBy("_set").agg(F.min("_id").alias("_first"), F.first("_fp").alias("_fp"), F.first("_n").alias("_n"), F.first("_keys").alias("_keys"), F.first("_marks").alias("_marks")), "distinct-sets")
    firsts = reps.select("_set", "_first")
    # What fingerprints propose: sets of one fingerprint with the least of them, and the least ones of linked fingerprints.
    prints = materialise(with_table(reps.groupBy("_fp").agg(F.min("_set").alias("_least"))), "distinct")
    one, two = (prints.select(F.col("_fp").alias(x), F.col("_least").alias(f"_{x}")) for x in "ab")
    near = links(prints.select("_fp", "_table"), radius).join(one, "a").join(two, "b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))
    same = salted_lookup(reps.select("_set", "_fp"), prints.select("_fp", "_least"), "_fp", F.col("_set")).where("_set <> _least").select(F.col("_least").alias("a"), F.col("_set").alias("b"))
    # What bands propose.
    seats = reps.select("_set", "_n", F.explode("_keys").alias("_key"))
    # One member of each key, drawn by a hash, is the hub that all others are held against; other keys of the same sets have other ones.
    drawn = F.struct(F.xxhash64("_key", "_set").alias("h"), "_set", "_n")
    shared = seats.groupBy("_key").agg(F.count("*").alias("_c"), F.min(drawn).alias("_hub")).where("_c > 1").select("_key", "_hub")
    groups = materialise(salted_lookup(seats, shared, "_key", F.col("_set")).where("_hub is not null").select("_key", "_set", "_n", "_hub"), "shared-bands")
    fits = under * F.least("_n", "_hub._n") >= over * F.greatest("_n", "_hub._n")
    stars = groups.where((F.col("_set") != F.col("_hub._set")) & fits).select(F.least("_hub._set", "_set").alias("a"), F.greatest("_hub._set", "_set").alias("b"))
    linked = materialise(_similar(near.unionByName(same).unionByName(stars), firsts, docs, words, ratio), "similar")
    joined = materialise(components(linked, "a", "b").select(F.col("node").alias("_set"), F.col("root").alias("_root")), "joined")
    now = salted_lookup(groups.drop("_hub"), joined, "_set", F.col("_key")).withColumn("_root", F.coalesce("_root", "_set"))
    now = materialise(now, "band-groups")
    apart = now.groupBy("_key").agg(F.min("_root").alias("_u"), F.max("_root").alias("_v")).where("_u <> _v").select("_key")
    rows = materialise(now.join(apart, "_key", "left_semi").select("_key", "_set", "_n", "_root"), "apart")
    low = materialise(_texts_of(rows.select("_set").distinct(), firsts, docs).mapInArrow(_lowest(words), "_set bigint, _low binary").dropDuplicates(["_set"]), "lowest")
    rows = rows.join(reps.select("_set", "_marks", "_keys"), "_set").join(low, "_set").select("_key", "_set", "_n", "_root", "_marks", "_keys", "_low")
    dealt = rows.repartition(parallelism(now, 4 << 20), "_key").sortWithinPartitions("_key")
    rest = _similar(dealt.mapInArrow(_cross(ratio), "a bigint, b bigint"), firsts, docs, words, ratio)
    # What is linked late joins components that are known: the graph of their roots is all that is left.
    root = lambda side: joined.select(F.col("_set").alias(side), F.col("_root").alias(f"_{side}"))
    late = rest.join(root("a"), "a", "left").join(root("b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
    above = components(late, "a", "b").select(F.col("node").alias("_root"), F.col("root").alias("_top"))
    named = firsts.join(joined, "_set", "left").withColumn("_root", F.coalesce("_root", "_set")).join(above, "_root", "left").withColumn("_root", F.coalesce("_top", "_root"))
    ids = named.groupBy("_root").agg(F.min("_first").alias("_component"))
    named = materialise(salted_lookup(named, ids, "_root", F.col("_set")).select("_set", "_component"), "classes")
    out = salted_lookup(scanned.select("_id", "_set"), named, "_set", F.col("_id"))
    return out.select(F.col("_id").alias(id_col), F.col("_component").alias("component_id"))
