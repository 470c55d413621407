"""Numbers in bytes and back, axis scales, checksums, and names that are safe for files."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import music
from tessera.functions.bytes import WIDTHS, each_value, numbers_packed, read_typed

#: Struct formats in the order in which an encoding is guessed.
TRIED = ["B", "b", "H", "h", "I", "i", "Q", "q", "f", "d"]
#: Sample rates, and the grain of Ableton's analysis in seconds.
STANDARD_RATES, GRAIN = [8000, 11025, 16000, 22050, 32000, 44100, 48000, 88200, 96000, 176400, 192000], 0.03


# Typed values


def decode_value(data: Column, kind: str, offset: int = 0, big_endian: bool = False) -> Column:
    """A value of a type spec (u16, i24, cstr, bytes:8 and so on) at an offset."""
    if kind.startswith("bytes:"):
        return F.lower(F.hex(F.substring(data, offset + 1, int(kind[6:]))))
    if kind == "cstr":
        return F.substring_index(F.decode(F.substring(data, F.lit(offset + 1), F.octet_length(data)), "ISO-8859-1"), "\0", 1)
    return read_typed(data, offset, kind, big_endian)


def decode_both(data: Column, kind: str, offset: int = 0) -> Column:
    """A number read in either byte order, as a struct."""
    return F.struct(read_typed(data, offset, kind, True).alias("be"), read_typed(data, offset, kind).alias("le"))


def encode_value(value: Column, kind: str, big_endian: bool = False) -> Column:
    """A whole number's bytes; null where it doesn't fit."""
    n = WIDTHS[kind]
    low, high = (-(1 << 8 * n - 1), (1 << 8 * n - 1) - 1) if kind[0] == "i" else (0, (1 << 8 * n) - 1)
    digits = F.substring(F.lpad(F.hex(value.cast("bigint")), 16, "0"), 17 - 2 * n, 2 * n)
    if not big_endian:
        digits = F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(n))])
    return F.when((value >= low) & (value <= min(high, (1 << 63) - 1)), F.unhex(digits))


def infer_encoding(rows: DataFrame, key: str, value: str, raw: str, prefer_big: bool = False) -> DataFrame:
    """``encoding``: the first struct format whose bytes of the value are the raw ones; null if none is."""
    orders = "><" if prefer_big else "<>"
    formats = [o + c for c in TRIED for o in orders]

    @F.pandas_udf("string")
    def guess(values: pd.Series, raws: pd.Series) -> pd.Series:
        def one(v, r):
            for f in formats:
                if r is None or struct.calcsize(f) != len(r):
                    continue
                try:
                    if struct.pack(f, v if f[1] in "fd" else int(v)) == bytes(r) and (f[1] in "fd" or int(v) == v):
                        return f
                except (struct.error, OverflowError, ValueError):
                    continue
            return None

        return pd.Series([one(v, r) for v, r in zip(values, raws, strict=True)])

    return rows.select(key, value, guess(F.col(value).cast("double"), F.col(raw)).alias("encoding"))


def bitfield_apply(container: Column, shift: int, width: int, value: Column, bias: int = 0) -> Column:
    """The container with the field set; null where the value doesn't fit."""
    mask = ((1 << width) - 1) << shift
    biased = value + bias
    return F.when(biased.between(0, (1 << width) - 1), container.bitwiseAND(F.lit(~mask)).bitwiseOR(F.shiftleft(biased, shift)))


# Checksums


@cache
def _table(poly: int, bits: int) -> list[int]:
    out, top, mask = [], 1 << bits - 1, (1 << bits) - 1
    for b in range(256):
        c = b << bits - 8
        for _ in range(8):
            c = (c << 1 ^ poly if c & top else c << 1) & mask
        out.append(c)
    return out


def crc8(data: bytes) -> int:
    """FLAC's header check: x^8 + x^2 + x + 1 from zero."""
    table, c = _table(0x07, 8), 0
    for b in data:
        c = table[c ^ b]
    return c


def crc16(data: bytes) -> int:
    """FLAC's frame check: x^16 + x^15 + x^2 + 1 from zero."""
    table, c = _table(0x8005, 16), 0
    for b in data:
        c = table[c >> 8 ^ b] ^ (c << 8 & 0xFFFF)
    return c


def checks(rows: DataFrame, key: str, data: str) -> DataFrame:
    return each_value(rows, [key], [data], "crc8 int, crc16 int", lambda value: iter([(crc8(value), crc16(value))]))


# Scales


def scaled(rows: DataFrame, keys: list[str], value: str, mode: str = "absolute", floor: float = 0.0, ceiling: float | None = None, clip: float = 0.99) -> DataFrame:
    """``scaled``: the value on an axis from 0 to 1 over its key: absolute (floor to ceiling or the largest), auto (least to largest), log, or clip (floor to
    a quantile). An axis without a span gives 0. The axis is aggregated by key, so that no key's values are gathered.
    """
    v = F.col(value).cast("double")
    ends = rows.groupBy(*keys).agg(F.min(v).alias("_low"), F.max(v).alias("_high"), F.expr(f"percentile_disc({clip}) WITHIN GROUP (ORDER BY {value})").alias("_clip") if mode == "clip" else F.lit(None).cast("double").alias("_clip"))
    out = rows.join(ends, keys)
    low, high = (F.col("_low"), F.col("_high")) if mode == "auto" else (F.lit(float(floor)), F.lit(float(ceiling)) if ceiling is not None else F.col("_high"))
    if mode == "log":
        top = F.log1p(F.greatest(F.lit(0.0), F.col("_high") - low))
        norm = F.log1p(F.greatest(F.lit(0.0), v - low)) / F.when(top == 0, 1.0).otherwise(top)
    else:
        high = F.when(F.col("_clip") != 0, F.col("_clip")).otherwise(F.col("_high")) if mode == "clip" else high
        span = F.when(high - low == 0, 1.0).otherwise(high - low)
        norm = F.when((high - low < 1e-9) & F.lit(mode == "auto"), 0.0).otherwise((v - low) / span)
    return out.withColumn("scaled", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), norm)), 6)).drop("_low", "_high", "_clip")


def sample_rate_for(step: Column) -> Column:
    """The least standard rate whose 30 ms grain reaches the largest step; null if none does."""
    rates = F.array(*[F.struct(F.lit(round(r * GRAIN)).alias("grain"), F.lit(r).alias("rate")) for r in STANDARD_RATES])
    return F.when(step > 0, F.get(F.filter(rates, lambda r: r["grain"] >= step), 0)["rate"])


# Keys and notes


def pick_key(detected: Column, named: Column) -> Column:
    """The key to believe, and where it comes from: a name's, unless both agree or it has none."""
    own = named.isNull() | (detected == named)
    return F.struct(F.when(own, detected).otherwise(named).alias("key"), F.when(own & F.coalesce(named.isNull() | detected.isNotNull(), F.lit(True)), "detected").otherwise("filename").alias("origin"))


def root_or_none(note: Column) -> Column:
    """A root note; 0 says that there is none."""
    return F.nullif(note, F.lit(0))


def note_class(note: Column) -> Column:
    return F.get(F.array(*map(F.lit, music.PITCHES)), (note % 12).cast("int"))


def compatible_keys(key: Column) -> Column:
    """Names of the keys that fit a key: itself, its relative and its neighbours on the wheel."""
    names = {name: sorted(music.PITCHES[pc] + "m" * mode for pc, mode in music.related(name)) for name in music.spellings()}
    table = F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.element_at(table, music.normal_key(key))


# Names


def normal_path(path: Column) -> Column:
    """Forward slashes, no doubled ones, no single dots, and none at the end."""
    out = F.regexp_replace(path, r"\\", "/")
    for pattern, by in ((r"/+", "/"), (r"(/\.)+(?=/|$)", ""), (r"(?<=.)/$", "")):
        out = F.regexp_replace(out, pattern, by)
    return out


def safe_label(label: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(label, r"[^A-Za-z0-9_.\-]+", "_"), r"^_+|_+$", "")
    return F.coalesce(F.nullif(out, F.lit("")), F.lit("library"))


def path_hash(root: Column, digits: int = 12) -> Column:
    return F.substring(F.sha1(F.encode(normal_path(root), "UTF-8")), 1, digits)


def csv_name(path: Column) -> Column:
    """The path with a file name that is safe and ends in .csv."""
    base = F.regexp_replace(F.trim(F.regexp_extract(path, r"([^/]*)$", 1)), r"[^A-Za-z0-9._\-]+", "_")
    base = F.when(base == "", "output.csv").otherwise(base)
    return F.concat(F.regexp_extract(path, r"^(.*/)?", 0), F.when(F.lower(base).endswith(".csv"), base).otherwise(F.concat(base, F.lit(".csv"))))


def safe_fourcc(raw: Column) -> Column:
    text = F.decode(raw, "ISO-8859-1")
    return F.when(text.rlike(r"\A[ -~]*\z"), text).otherwise(F.concat(F.lit("hex:"), F.lower(F.hex(raw))))


def unique_labels(libraries: DataFrame, base: str = "label", root: str = "root") -> DataFrame:
    """A label for each root: its base, with the parent folder where that is taken, with a hash where both are. Earlier roots (in order) keep theirs."""
    parent = F.regexp_extract(root, r"([^/]*)/[^/]*$", 1)
    second = F.concat(F.col(base), F.lit("_"), parent)
    first = F.row_number().over(Window.partitionBy(base).orderBy(root)) == 1
    out = libraries.withColumns({"_first": first, "_second": second})
    again = F.row_number().over(Window.partitionBy("_first", "_second").orderBy(root)) == 1
    out = out.withColumn("_again", again)
    hashed = F.concat(F.col(base), F.lit("_"), F.substring(F.sha1(F.encode(F.col(root), "UTF-8")), 1, 6))
    return out.withColumn("unique_label", F.when(F.col("_first"), F.col(base)).when(F.col("_again"), F.col("_second")).otherwise(hashed)).drop("_first", "_second", "_again")


# Vectors


def projected_vector(features: Column, names: list[str]) -> Column:
    """A map's values in a fixed order; what is missing or isn't finite counts as 0."""
    clean = lambda x: F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), x).otherwise(0.0)
    return F.array(*[clean(features[n].cast("double")) for n in names])


def pack_vector(vector: Column) -> Column:
    """Little-endian 32-bit floats."""

    @F.pandas_udf("binary")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())

    return run(vector)


def unpack_vector(data: Column) -> Column:
    @F.pandas_udf("array<float>")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None or len(x) % 4 else np.frombuffer(x, "<f4").tolist())

    return run(data)


def packed(rows: DataFrame, key: str, value: str, kind: str, big_endian: bool = False) -> DataFrame:
    """``raw``: bytes of numbers of any kind, floats too."""

    @F.pandas_udf("binary")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None or x != x else numbers_packed(x, kind, big_endian))

    return rows.select(key, value, run(F.col(value)).alias("raw"))


def runs_of(mask: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
    """Maximal runs of true values of at least so many: (from, to)."""
    edges = np.flatnonzero(np.diff(np.r_[False, mask, False].astype(np.int8)))
    return ((int(a), int(b)) for a, b in zip(edges[::2], edges[1::2], strict=True) if b - a >= least)
