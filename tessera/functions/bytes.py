"""Byte-level analytics over binary columns: Column expressions where a value is read at a place, Arrow batches where all of it is."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Widths of the typed reads, and what numpy calls those that it has.
WIDTHS = {"u8": 1, "i8": 1, "u16": 2, "i16": 2, "u24": 3, "i24": 3, "u32": 4, "i32": 4, "u64": 8, "i64": 8, "f32": 4, "f64": 8}


def byte_at(data: Column, offset: Column | int) -> Column:
    """The unsigned byte at an offset; null beyond the end."""
    at = F.lit(offset) if isinstance(offset, int) else offset
    return F.conv(F.nullif(F.hex(F.substring(data, at + 1, F.lit(1))), F.lit("")), 16, 10).cast("bigint")


def read_typed(data: Column, offset: Column | int, kind: str, big_endian: bool = False) -> Column:
    """An integer at an offset; null where it isn't whole. Of 64 bits it is a decimal."""
    n = WIDTHS[kind]
    at = F.lit(offset) if isinstance(offset, int) else offset
    # Each step names the one before it once, so that the data's expression isn't repeated for every byte.
    digits = F.hex(F.substring(data, at + 1, F.lit(n)))
    if not big_endian and n > 1:
        digits = F.array_join(F.reverse(F.regexp_extract_all(digits, F.lit("(..)"), 1)), "")
    wide = "decimal(20,0)" if n == 8 else "bigint"
    value = F.conv(F.regexp_extract(digits, f"^.{{{2 * n}}}$", 0), 16, 10).cast(wide)
    if kind[0] == "i":
        value = F.when(value >= F.lit(1 << (8 * n - 1)).cast(wide), value - F.lit(1 << (8 * n)).cast("decimal(20,0)" if n == 8 else "bigint")).otherwise(value)
    return value


def numbers_of(value: bytes, kind: str, big_endian: bool = False) -> np.ndarray:
    """All whole numbers of a kind, side by side."""
    n = WIDTHS[kind]
    whole = value[: len(value) // n * n]
    if n == 3:
        raw = np.frombuffer(whole, np.uint8).reshape(-1, 3).astype(np.int64)
        out = raw @ np.array([65536, 256, 1] if big_endian else [1, 256, 65536])
        return np.where(out >= 1 << 23, out - (1 << 24), out) if kind[0] == "i" else out
    return np.frombuffer(whole, f"{'>' if big_endian else '<'}{kind[0]}{n}")


def read_series(rows: DataFrame, key: str, data: str, offset: int, kind: str, count: int, big_endian: bool = False) -> DataFrame:
    """``key``, ``index``, ``value`` (double): so many numbers from an offset, as far as the value goes."""

    def made(value: bytes) -> Iterator[tuple]:
        yield from enumerate(float(x) for x in numbers_of(value[offset : offset + count * WIDTHS[kind]], kind, big_endian))

    return each_value(rows, [key], [data], "index int, value double", made)


def find_value(rows: DataFrame, key: str, data: str, value: float, kind: str) -> DataFrame:
    """``key``, ``offset``, ``order``: everywhere that a number stands as this kind, in either byte order (one row where both are alike)."""
    packed = [(name, numbers_packed(value, kind, name == "be")) for name in ("le", "be")]

    def made(data: bytes) -> Iterator[tuple]:
        for i, (name, needle) in enumerate(packed):
            if i and needle == packed[0][1]:
                continue
            at = data.find(needle)
            while at >= 0:
                yield at, name
                at = data.find(needle, at + 1)

    return each_value(rows, [key], [data], "offset int, `order` string", made)


def numbers_packed(value: float, kind: str, big_endian: bool = False) -> bytes:
    """A number's bytes as a kind."""
    n, order = WIDTHS[kind], "big" if big_endian else "little"
    if kind[0] == "f":
        return np.array(value, f"{'>' if big_endian else '<'}f{n}").tobytes()
    return int(value).to_bytes(n, order, signed=kind[0] == "i")


def each_value(rows: DataFrame, keys: list[str], values: list[str], schema: str, made: Callable[..., Iterator[tuple]], ahead: Callable[[list[bytes]], list] | None = None) -> DataFrame:
    """Rows that ``made`` yields of each row's binary values, behind its keys: one pass in Arrow batches, and no shuffle. Null counts as empty.

    What ``ahead`` says of several first values at once, ``made`` gets as one more argument.
    """
    n = len(keys)
    types = dict(rows.dtypes)
    whole = T._parse_datatype_string(", ".join(f"{k} {types[k]}" for k in keys) + ", " + schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(whole)
        for batch in batches:
            held = [batch.column(i) for i in range(n, batch.num_columns)]
            at, out = [], []
            for r, given in _given(held, batch.num_rows, ahead):
                for row in made(*given):
                    at.append(r)
                    out.append(row)
                if len(out) > 100_000:
                    yield _batch(batch, n, at, out, arrow)
                    at, out = [], []
            yield _batch(batch, n, at, out, arrow)

    return rows.select(*keys, *[F.col(v).cast("binary") for v in values]).mapInArrow(run, whole)


#: Fixed value: bytes of values that are looked at ahead together.
AHEAD = 256 << 10


def _given(held: list[pa.Array], n: int, ahead: Callable[[list[bytes]], list] | None) -> Iterator[tuple[int, tuple]]:
    """The number of each row and what is made from."""
    group, size = [], 0
    for r in range(n):
        values = tuple(c[r].as_py() or b"" for c in held)
        if ahead is None:
            yield r, values
            continue
        group.append((r, values))
        size += len(values[0])
        if size >= AHEAD or r == n - 1:
            yield from ((place, (*v, more)) for (place, v), more in zip(group, ahead([v[0] for _, v in group]), strict=True))
            group, size = [], 0


def each_arrays(rows: DataFrame, keys: list[str], values: list[str], schema: str, made: Callable[..., tuple[np.ndarray, ...]]) -> DataFrame:
    """each_value() of columns instead of rows: ``made`` gives equally long arrays of numbers, so that no row is an object."""
    n = len(keys)
    types = dict(rows.dtypes)
    whole = T._parse_datatype_string(", ".join(f"{k} {types[k]}" for k in keys) + ", " + schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(whole)

        def filled(batch: pa.RecordBatch, at: list[int], out: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            places = np.repeat(np.array(at, np.int64), [len(a[0]) for a in out])
            own = [batch.column(i).take(pa.array(places)) for i in range(n)]
            return pa.RecordBatch.from_arrays([*own, *(pa.array(np.concatenate(c), pa.from_numpy_dtype(c[0].dtype)).cast(f.type) for c, f in zip(zip(*out, strict=True), list(arrow)[n:], strict=True))], schema=arrow)

        for batch in batches:
            held = [batch.column(i) for i in range(n, batch.num_columns)]
            at, out, size = [], [], 0
            for r in range(batch.num_rows):
                found = made(*(c[r].as_py() or b"" for c in held))
                at.append(r)
                out.append(found)
                size += len(found[0])
                if size > 100_000:
                    yield filled(batch, at, out)
                    at, out, size = [], [], 0
            if out:
                yield filled(batch, at, out)

    return rows.select(*keys, *[F.col(v).cast("binary") for v in values]).mapInArrow(run, whole)


def _batch(batch: pa.RecordBatch, n: int, at: list[int], out: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    own = [batch.column(i).take(pa.array(at, pa.int64())) for i in range(n)]
    columns = list(zip(*out, strict=True)) or [()] * (len(arrow) - n)
    return pa.RecordBatch.from_arrays([*own, *(pa.array(list(c), f.type) for c, f in zip(columns, list(arrow)[n:], strict=True))], schema=arrow)


def byte_counts(rows: DataFrame, key: str, data: str) -> DataFrame:
    """``key``, ``byte``, ``n``: a row for each byte value that occurs in a row's value."""

    def made(value: bytes) -> Iterator[tuple]:
        counts = np.bincount(np.frombuffer(value, np.uint8), minlength=256)
        yield from ((int(b), int(counts[b])) for b in np.flatnonzero(counts))

    return each_value(rows, [key], [data], "byte int, n bigint", made)


def entropy(counts: DataFrame, key: str) -> DataFrame:
    """Bits a byte of each key's histogram, at most the logarithm of the number of values."""
    total, self_log, kinds = F.sum("n"), F.sum(F.col("n") * F.log2("n")), F.count("*")
    raw = F.log2(total) - self_log / total
    return counts.groupBy(key).agg(F.round(F.greatest(F.lit(0.0), F.least(raw, F.log2(kinds))), 6).alias("entropy"), total.cast("bigint").alias("n_bytes"))


def windows_of(rows: DataFrame, key: str, data: str, windows: int) -> DataFrame:
    """Equal slices [i*n//w, (i+1)*n//w) of each value, empty ones left out."""
    n, i = F.octet_length(data), F.col("window")
    cut = rows.select(key, F.col(data).alias("_d"), F.explode(F.sequence(F.lit(0), F.lit(windows - 1))).alias("window"))
    n = F.octet_length("_d")
    start, end = F.floor(i * n / windows).cast("int"), F.floor((i + 1) * n / windows).cast("int")
    return cut.select(key, "window", F.substring("_d", start + 1, end - start).alias("slice")).where(F.octet_length("slice") > 0)


def sampled_entropy(rows: DataFrame, key: str, data: str, windows: int = 72, sample: int = 8192, probes: int = 4) -> DataFrame:
    """``window``, ``entropy``, ``sampled``: like windows_of() and entropy(), but of windows larger than ``sample`` only some places are read."""

    def made(value: bytes) -> Iterator[tuple]:
        n = len(value)
        bounds = [(i * n // windows, max(i * n // windows + 1, (i + 1) * n // windows)) for i in range(windows)]
        partly = bool(n) and max(b - a for a, b in bounds) > sample
        for i, (a, b) in enumerate(bounds):
            if a >= n:
                return
            part = value[a : min(b, n)]
            if partly:
                each = max(1, sample // probes)
                stride = max(1, (b - a - each) // max(1, probes - 1))
                part = b"".join(value[a + p * stride : min(b, a + p * stride + each)] for p in range(probes))
            counts = np.bincount(np.frombuffer(part, np.uint8))
            counts = counts[counts > 0]
            h = np.log2(len(part)) - (counts * np.log2(counts)).sum() / len(part)
            yield i, round(float(min(max(h, 0.0), np.log2(len(counts)))), 6), partly

    return each_value(rows, [key], [data], "window int, entropy double, sampled boolean", made)


def find_all(rows: DataFrame, key: str, data: str, needle: bytes) -> DataFrame:
    """``key``, ``offset`` of every match, overlapping ones too."""

    def made(value: bytes) -> Iterator[tuple]:
        at = value.find(needle)
        while at >= 0:
            yield (at,)
            at = value.find(needle, at + 1)

    return each_value(rows, [key], [data], "offset int", made)


def strings(rows: DataFrame, key: str, data: str, least: int = 4) -> DataFrame:
    """Printable runs of at least so many bytes, with their offsets."""
    runs = re.compile(rb"[ -~]{%d,}" % least)
    return each_value(rows, [key], [data], "offset int, run string", lambda value: ((m.start(), m.group().decode("ascii")) for m in runs.finditer(value)))


def hexdump(rows: DataFrame, key: str, data: str) -> DataFrame:
    """Rows of sixteen bytes: offset, hex digits, and the printable characters."""
    n = F.octet_length(data)
    each = rows.where(n > 0).select(key, F.col(data).alias("_d"), F.explode(F.sequence(F.lit(0), n - 1, F.lit(16))).alias("offset"))
    part = F.substring("_d", F.col("offset") + 1, F.lit(16))
    return each.select(key, "offset", F.lower(F.hex(part)).alias("hex"), F.regexp_replace(F.decode(part, "ISO-8859-1"), "[^ -~]", ".").alias("ascii"))


def byte_class(b: Column) -> Column:
    return F.when(b == 0, "null").when(b == 255, "ff").when(b.between(32, 126), "ascii").when(b < 32, "ctrl").when(b == 127, "ctrl").otherwise("high")


def diff_ranges(pairs: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Ranges in which two values differ over their common length."""

    def made(x: bytes, y: bytes) -> Iterator[tuple]:
        n = min(len(x), len(y))
        off = np.frombuffer(x, np.uint8, n) != np.frombuffer(y, np.uint8, n)
        edges = np.flatnonzero(np.diff(np.r_[False, off, False].astype(np.int8)))
        yield from zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)

    return each_value(pairs, [key], [a, b], "start int, stop int", made)


def hilbert_cells(rows: DataFrame, key: str, data: str, side_bits: int) -> DataFrame:
    """``cell``, ``x``, ``y`` and the mean byte (a whole number) of each cell of a 2**side_bits square that a value's bytes are laid out on."""

    cells = 1 << 2 * side_bits

    def made(value: bytes) -> tuple[np.ndarray, ...]:
        n = len(value)
        cell = np.arange(cells) if n >= cells else np.arange(n) * cells // max(1, n)
        starts = -(-cell * n // cells)
        total = np.add.reduceat(np.frombuffer(value, np.uint8), starts, dtype=np.int64) if n else np.empty(0, np.int64)
        return cell, *hilbert_places(side_bits, cell), total // np.diff(np.append(starts, n))

    return each_arrays(rows, [key], [data], "cell bigint, x bigint, y bigint, mean int", made)


def hilbert_places(side_bits: int, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """hilbert_xy() of numbers at hand."""
    x, y = np.zeros_like(t), np.zeros_like(t)
    for i in range(side_bits):
        s = 1 << i
        rx = t >> 1 & 1
        ry = (t ^ rx) & 1
        flip = (ry == 0) & (rx == 1)
        fx, fy = np.where(flip, s - 1 - x, x), np.where(flip, s - 1 - y, y)
        x, y = np.where(ry == 0, fy, fx) + s * rx, np.where(ry == 0, fx, fy) + s * ry
        t = t >> 2
    return x, y


def hilbert_xy(side_bits: int, d: Column) -> tuple[Column, Column]:
    """Cell of a distance along the Hilbert curve of a 2**side_bits square: the curve's loop, unrolled for its fixed order."""
    x, y, t = F.lit(0).cast("bigint"), F.lit(0).cast("bigint"), d.cast("bigint")
    for i in range(side_bits):
        s = 1 << i
        rx = F.shiftright(t, 1).bitwiseAND(F.lit(1).cast("bigint"))
        ry = t.bitwiseXOR(rx).bitwiseAND(F.lit(1).cast("bigint"))
        flip = (ry == 0) & (rx == 1)
        fx, fy = F.when(flip, s - 1 - x).otherwise(x), F.when(flip, s - 1 - y).otherwise(y)
        x, y = F.when(ry == 0, fy).otherwise(fx) + s * rx, F.when(ry == 0, fx).otherwise(fy) + s * ry
        t = F.shiftright(t, 2)
    return x, y


def bitfield(container: Column, position: int, width: int, bias: int = 0) -> Column:
    return F.shiftright(container, position).bitwiseAND((1 << width) - 1) - bias


def synchsafe(data: Column, offset: int) -> Column:
    """A 28-bit number of seven bits a byte."""
    out = F.lit(0).cast("bigint")
    for i in range(4):
        out = out * 128 + byte_at(data, offset + i).bitwiseAND(F.lit(127).cast("bigint"))
    return out


def mac_date(seconds: Column) -> Column:
    """Seconds since 1904 as an ISO date and time; empty for 0."""
    return F.when(seconds == 0, "").otherwise(F.date_format(F.timestamp_seconds(seconds - 2082844800), "yyyy-MM-dd'T'HH:mm:ss"))


def mac_text(seconds: int | None) -> str:
    """mac_date() of a number at hand."""
    return "" if not seconds else (datetime(1904, 1, 1) + timedelta(seconds=seconds)).isoformat()
