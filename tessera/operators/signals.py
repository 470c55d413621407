"""Statistics of raw bytes and samples, worked out with numpy where the bytes are read; each has a DataFrame form that runs in Arrow batches."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.bytes import each_value, numbers_of
from tessera.functions.values import runs_of

#: Windows of the audio scan, its lags, and the limits of its score.
WINDOW, STEP, LAGS = 1024, 512, (1, 2, 4, 8)
ENTROPY_FLOOR, ENTROPY_CEIL, PEAK_FLOOR, PEAK_SPAN, STRUCTURE = 2.0, 7.7, 0.25, 0.50, 0.30
PRINTABLE_LOW, PRINTABLE_HIGH, LIVE_FLOOR, LIVE_FULL, LIVE_MIN = 0.35, 0.70, 2.0, 16.0, 0.25
#: Floats count as audio up to this size, if so many of them are in range.
FLOAT_RANGE, FLOAT_SHARE, FLOAT_SCORE = 1.5, 0.85, 0.30
MIN_SCORE, MERGE_GAP = 0.25, 4
FEATURES = "start bigint, entropy double, lag1 double, lag2 double, lag4 double, lag8 double, peak double, structure double, printable double, spread double, is_float boolean"
_NAMES = ("entropy", "lag1", "lag2", "lag4", "lag8", "peak", "structure", "printable", "spread", "is_float")


def lag_correlations(x: np.ndarray, lags: tuple[int, ...] = LAGS) -> np.ndarray:
    """Autocorrelation of each row at each lag; 0 for a flat row."""
    d = x - x.mean(axis=-1, keepdims=True)
    square = (d * d).sum(axis=-1)
    out = [(d[..., :-k] * d[..., k:]).sum(axis=-1) for k in lags]
    return np.stack(out, axis=-1) / np.where(square > 0, square, 1)[..., None]


def _round6(x: np.ndarray) -> np.ndarray:
    """Rounded to six digits, halves away from zero, as SQL does."""
    scaled = x * 1e6
    whole = np.trunc(scaled)
    return (whole + np.where(np.abs(scaled - whole) >= 0.5, np.copysign(1.0, scaled), 0.0)) / 1e6


#: n log2 n of counts of a byte in a window, which bytes are printable, and each byte as a signed number.
_SELF_LOG = np.arange(WINDOW + 1) * np.log2(np.maximum(np.arange(WINDOW + 1), 1))
_PRINTABLE = np.isin(np.arange(256), [9, 10, 13, *range(32, 127)])
_SIGNED = np.arange(256, dtype=np.uint8).view(np.int8).astype(np.int64)


def _float_heads(low: int) -> np.ndarray:
    """First bytes (sign and exponent) of floats in range count 2**20 + 1, of zero or a smaller one 1, others nothing."""
    top = np.arange(256) & 127
    return np.where((top >= low) & (top <= 0x3F), (1 << 20) + 1, (top == 0).astype(np.int64))


_FLOATS = [("<f4", 4, 3, _float_heads(0x2B)), (">f4", 4, 0, _float_heads(0x2B)), ("<f8", 8, 7, _float_heads(0x3D)), (">f8", 8, 0, _float_heads(0x3D))]


def _float_scores(windows: np.ndarray) -> np.ndarray:
    """The best lag-1 correlation of a window's bytes as floats of either width and order; 0 where they aren't floats in range. By their first bytes few windows can be."""
    best = np.zeros(len(windows))
    for kind, width, head, heads in _FLOATS:
        firsts = heads[windows[:, head::width]].sum(axis=1)
        likely = np.flatnonzero((firsts >= 1 << 20) & ((firsts & (1 << 20) - 1) / (windows.shape[1] // width) >= FLOAT_SHARE))
        if not len(likely):
            continue
        with np.errstate(invalid="ignore", over="ignore"):
            x = np.ascontiguousarray(windows[likely]).view(kind).astype(np.float64)
            inside = np.isfinite(x) & (np.abs(x) <= FLOAT_RANGE) & ((x == 0) | (np.abs(x) > 1e-12))
        fits = (inside.mean(axis=1) >= FLOAT_SHARE) & ((x != 0) & inside).any(axis=1)
        if fits.any():
            clean = np.where(inside[fits], x[fits], 0)
            score = np.maximum(lag_correlations(clean, (1,))[:, 0], 0)
            at = likely[fits]
            best[at] = np.maximum(best[at], np.where(score >= FLOAT_SCORE, score, 0))
    return best


def _measured(rows: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """Entropy, four lags, peak and structure of each window side by side; its printable share, its spread, and whether it reads as floats.

    Sums of products are whole numbers, so correlations are exact but for one division. Peak and structure of nearly random bytes are 0; those of floats are the floats' correlation.
    """
    n = len(rows)
    self_log = _SELF_LOG if window <= WINDOW else np.arange(window + 1) * np.log2(np.maximum(np.arange(window + 1), 1))
    counts = np.bincount((np.arange(0, 256 * n, 256)[:, None] + rows).ravel(), minlength=256 * n).reshape(n, 256)
    kinds = (counts > 0).sum(axis=1)
    entropy = np.clip(np.log2(window) - self_log[counts].sum(axis=1) / window, 0, np.log2(kinds))
    printable = counts[:, _PRINTABLE].sum(axis=1) / window
    total, square = counts @ _SIGNED, counts @ (_SIGNED * _SIGNED)
    variance = window * square - total * total
    lags, moving = np.zeros((n, len(LAGS))), np.flatnonzero(variance)
    if len(moving):
        x = rows[moving].view(np.int8).astype(np.float64)
        whole, scale = total[moving], (window * variance[moving]).astype(np.float64)
        for j, k in enumerate(LAGS):
            products = np.einsum("ij,ij->i", x[:, :-k], x[:, k:]).astype(np.int64)
            ends = 2 * whole - x[:, :k].sum(axis=1).astype(np.int64) - x[:, -k:].sum(axis=1).astype(np.int64)
            lags[moving, j] = (window * window * products - window * whole * ends + (window - k) * whole * whole) / scale
    spread = np.sqrt(variance) / window
    live = np.where((entropy <= ENTROPY_CEIL)[:, None], lags, 0.0)
    peak = np.maximum(live[:, 0], live[:, 1])
    structure = np.maximum.reduce([np.abs(live[:, 2]), np.abs(live[:, 3]), np.maximum(live[:, 1] - live[:, 0], 0)])
    floats = np.zeros(n)
    floats[moving] = _float_scores(rows[moving])
    is_float = floats > 0
    peak, structure = np.where(is_float, floats, peak), np.where(is_float, floats, structure)
    return _round6(np.column_stack([entropy, lags, peak, structure])), printable, _round6(spread), is_float


def _windows(raw: np.ndarray, window: int = WINDOW, step: int = STEP) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(raw, window)[::step] if len(raw) >= window else np.empty((0, window), np.uint8)


def window_features(data: bytes, window: int = WINDOW, step: int = STEP, batch: int = 2048) -> Iterator[tuple]:
    """(start, features) of each whole window, some thousand at once."""
    every = _windows(np.frombuffer(data, np.uint8), window, step)
    for first in range(0, len(every), batch):
        numbers, printable, spread, is_float = _measured(every[first : first + batch], window)
        for i, (values, share, level, real) in enumerate(zip(numbers.tolist(), printable.tolist(), spread.tolist(), is_float.tolist(), strict=True)):
            yield (first + i) * step, *values, share, level, real


def window_scores(values: list[bytes], batch: int = 2048) -> list[np.ndarray]:
    """audio_score() of each window of each value. Windows of small values are measured together, those of a large one some thousand at once."""
    every = [_windows(np.frombuffer(v, np.uint8)) for v in values]
    out: list[np.ndarray] = []
    group: list[np.ndarray] = []

    def scored(rows: np.ndarray) -> np.ndarray:
        # Windows of one byte value have no entropy, so they don't score.
        scores, moving = np.zeros(len(rows)), np.flatnonzero((rows != rows[:, :1]).any(axis=1))
        if len(moving):
            scores[moving] = moved(rows[moving])
        return scores

    def moved(rows: np.ndarray) -> np.ndarray:
        numbers, printable, spread, is_float = _measured(rows)
        entropy, peak, structure = numbers[:, 0], numbers[:, 5], numbers[:, 6]
        text = np.clip((PRINTABLE_HIGH - printable) / (PRINTABLE_HIGH - PRINTABLE_LOW), 0, 1)
        live = LIVE_MIN + (1 - LIVE_MIN) * np.clip((spread - LIVE_FLOOR) / (LIVE_FULL - LIVE_FLOOR), 0, 1)
        bytes_ = np.where(entropy > ENTROPY_CEIL, 0.0, np.clip((peak - PEAK_FLOOR) / PEAK_SPAN, 0, 1) * np.clip(structure / STRUCTURE, 0, 1) * text * live)
        return np.where(entropy < ENTROPY_FLOOR, 0.0, np.where(is_float, peak, bytes_))

    def flush() -> None:
        if group:
            ends = np.cumsum([len(g) for g in group])
            out.extend(np.split(scored(np.concatenate(group)), ends[:-1]) if ends[-1] else [np.empty(0)] * len(group))
            group.clear()

    for rows in every:
        if len(rows) > batch:
            flush()
            out.append(np.concatenate([scored(rows[i : i + batch]) for i in range(0, len(rows), batch)]))
            continue
        if sum(map(len, group)) + len(rows) > batch:
            flush()
        group.append(rows)
    flush()
    return out


def features_of(rows: DataFrame, key: str, data: str, window: int = WINDOW, step: int = STEP) -> DataFrame:
    return each_value(rows, [key], [data], FEATURES, lambda value: window_features(value, window, step))


def audio_score(entropy: Column, peak: Column, structure: Column, printable: Column, spread: Column, is_float: Column) -> Column:
    """How much a window looks like audio, 0 to 1: correlated, shaped like a wave, not like text, and moving."""
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    strength, shape = unit((peak - PEAK_FLOOR) / PEAK_SPAN), unit(structure / STRUCTURE)
    text = unit((PRINTABLE_HIGH - printable) / (PRINTABLE_HIGH - PRINTABLE_LOW))
    live = LIVE_MIN + (1 - LIVE_MIN) * unit((spread - LIVE_FLOOR) / (LIVE_FULL - LIVE_FLOOR))
    return F.when(entropy < ENTROPY_FLOOR, 0.0).when(is_float, peak).when(entropy > ENTROPY_CEIL, 0.0).otherwise(strength * shape * text * live)


def scores(features: DataFrame) -> DataFrame:
    return features.withColumn("score", F.round(audio_score(*(F.col(c) for c in ("entropy", "peak", "structure", "printable", "spread", "is_float"))), 6))


def audio_regions(scored: DataFrame, key: str, window: int = WINDOW, step: int = STEP, least: float = MIN_SCORE, gap: int = MERGE_GAP) -> DataFrame:
    """Runs of windows that score enough, across up to ``gap`` that don't: ``start``, ``stop``, ``confidence`` (the mean of those that do).

    A key's windows are one blob's, in order; those that don't score aren't shuffled.
    """
    from pyspark.sql import Window

    hits = scored.where(F.col("score") >= least).select(key, "start", "score")
    w = Window.partitionBy(key).orderBy("start")
    new = F.coalesce((F.col("start") - F.lag("start").over(w) > (gap + 1) * step).cast("int"), F.lit(1))
    marked = hits.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w))
    return marked.groupBy(key, "_run").agg(F.min("start").alias("start"), (F.max("start") + window).alias("stop"), F.round(F.avg("score"), 4).alias("confidence")).drop("_run")


# PCM


def coherence(samples: np.ndarray, least_peak: int = 0, least: int = 256) -> tuple[float, int, float]:
    """Lag-1 correlation, peak and level of the first 12,000 samples; no correlation below the gates."""
    if len(samples) < least:
        return 0.0, 0, 0.0
    x = samples[:12_000].astype(np.float64)
    peak = int(np.abs(x).max())
    if peak < least_peak:
        return 0.0, peak, 0.0
    d = x - x.mean()
    variance = (d * d).mean() or 1.0
    return float((d[:-1] * d[1:]).sum() / (len(x) - 1) / variance), peak, float(variance**0.5)


def coherences(rows: DataFrame, key: str, data: str) -> DataFrame:
    def made(value: bytes) -> Iterator[tuple]:
        r, peak, level = coherence(numbers_of(value, "i16"))
        yield round(r, 6), peak, round(level, 6)

    return each_value(rows, [key], [data], "coherence double, peak int, rms double", made)


def _entropy2(ones: np.ndarray, size: int) -> np.ndarray:
    p = ones / size
    with np.errstate(divide="ignore", invalid="ignore"):
        h = -(p * np.log2(p) + (1 - p) * np.log2(1 - p))
    return np.where((ones > 0) & (ones < size), h, 0.0)


def lsb_entropies(pcm: bytes, width: int, windows: int = 64) -> np.ndarray:
    """Entropy of the lowest bits of samples, in equal windows."""
    low = np.frombuffer(pcm, np.uint8)[:: max(1, width)] & 1
    windows = max(1, len(low) // 4) if len(low) < 4 * windows else windows
    size = len(low) // windows
    return np.round(_entropy2(low[: size * windows].reshape(windows, size).sum(axis=1), size), 3) if size else np.empty(0)


def lsb_verdicts(rows: DataFrame, key: str, data: str, width: int = 2) -> DataFrame:
    """Least, largest and mean entropy of the lowest bits, and whether it is high throughout; values of under 256 samples have no row."""

    def made(value: bytes) -> Iterator[tuple]:
        if len(value) >= 256 * width and len(h := lsb_entropies(value, width)):
            low, mean = float(h.min()), float(h.mean())
            yield len(h), low, float(h.max()), round(mean, 9), bool(len(h) >= 16 and low >= 0.92 and mean >= 0.97)

    return each_value(rows, [key], [data], "windows int, low double, high double, mean double, uniform_high boolean", made)


def both_orders(data: bytes) -> tuple[float, float]:
    """Lag-1 correlation of 16-bit samples in both byte orders."""
    out = []
    for big in (False, True):
        x = numbers_of(data[:200_000], "i16", big).astype(np.float64)
        out.append(float(lag_correlations(x, (1,))[0]) if len(x) >= 8 else 0.0)
    return out[0], out[1]


def _smoothness(x: np.ndarray) -> float:
    """Lag-1 correlation; -1 of a flat signal."""
    d = x - x.mean()
    square = np.dot(d, d)
    return float(np.dot(d[:-1], d[1:]) / square) if square else -1.0


GEOMETRY = "width int, channels int, `order` string, is_float boolean, confidence double, silence double, dc double, clipping double"


def geometry(data: bytes, most: int = 16_384) -> tuple:
    """The reading of raw samples that is smoothest: width, channels, byte order, and tells of silence, offset and clipping."""
    raw = data[:most]
    best: tuple[float, int, int, str | None, bool, np.ndarray] = (-1.0, 8, 1, None, False, np.empty(0))
    bytes_ = np.frombuffer(raw, np.uint8)
    for width, order, is_float in ((8, None, False), (16, "le", False), (16, "be", False), (32, "le", True), (32, "be", True), (64, "le", True), (64, "be", True)):
        kind = f"{'f' if is_float else 'i'}{width}"
        if is_float:
            whole = len(raw) // (width // 8)
            heads = next(h for k, _, _, h in _FLOATS if k == f"{'<' if order == 'le' else '>'}f{width // 8}")
            firsts = bytes_[width // 8 - 1 if order == "le" else 0 : whole * (width // 8) : width // 8]
            if whole < 8 or np.count_nonzero(heads[firsts]) / whole < FLOAT_SHARE:
                continue
        if not is_float:
            x = numbers_of(raw, kind, order == "be").astype(np.float64)
        else:
            with np.errstate(invalid="ignore", over="ignore"):
                x = numbers_of(raw, kind, order == "be").astype(np.float64)
                if (np.isfinite(x) & (np.abs(x) <= FLOAT_RANGE) & ((x == 0) | (np.abs(x) > 1e-12))).mean() < FLOAT_SHARE:
                    continue
            x = np.nan_to_num(x, posinf=0, neginf=0)
        for channels in (1,) if is_float else (1, 2):
            parts = [x[c::channels] for c in range(channels)]
            if len(parts[-1]) < 8:
                continue
            score = sum(map(_smoothness, parts)) / channels
            if score > best[0]:
                best = (score, width, channels, order, is_float, parts[0])
    score, width, channels, order, is_float, x = best
    full = 1.0 if is_float else float((1 << width - 1) - 1)
    tells = [round(float(v), 6) for v in ((np.abs(x) <= full / 1000).mean(), x.mean() / full, (np.abs(x) >= full).mean())] if len(x) else [0.0] * 3
    return width, channels, order, is_float, round(max(score, 0.0), 3), *tells


def geometries(rows: DataFrame, key: str, data: str) -> DataFrame:
    return each_value(rows, [key], [data], GEOMETRY, lambda value: iter([geometry(value)]))


def spu_share(data: bytes, blocks: int = 512) -> float:
    """How many of the first blocks have a header that PlayStation ADPCM allows; 0 if nearly all is empty."""
    raw = np.frombuffer(data[: len(data) // 16 * 16], np.uint8).reshape(-1, 16)[:blocks]
    if not len(raw) or (raw[:, 2:] != 0).any(axis=1).mean() < 0.05:
        return 0.0
    return float((((raw[:, 0] & 15) <= 12) & (raw[:, 0] >> 4 <= 4) & (raw[:, 1] <= 7)).mean())


def classified(rows: DataFrame, key: str, data: str) -> DataFrame:
    """What a region is, the likeliest first: PlayStation ADPCM by its headers (85 % or more), or PCM by its smoothness; below a half it is uncertain."""

    def made(value: bytes) -> Iterator[tuple]:
        found = []
        if (share := spu_share(value[:32_768])) >= 0.85:
            found.append((round(share, 2), "spu-adpcm", True))
        width, channels, order, is_float, score, *_ = geometry(value)
        found.append((float(score), f"raw-pcm {'float' if is_float else (order or '?') + '-'}{width}{'' if is_float else 'bit'} {'stereo' if channels == 2 else 'mono'}", False))
        for place, (confidence, label, codec) in enumerate(sorted(found, key=lambda c: -c[0]), 1):
            yield place, label, codec, confidence, not codec and confidence < 0.5

    return each_value(rows, [key], [data], "place int, label string, is_codec boolean, confidence double, uncertain boolean", made)



def transforms(keys: range = range(1, 256)) -> Iterator[tuple[str, np.ndarray]]:
    """Names and tables: each XOR key, rotations, and swapped halves."""
    every = np.arange(256, dtype=np.uint8)
    for k in keys:
        yield f"xor-{k:02x}", every ^ np.uint8(k)
    for n in range(1, 8):
        yield f"rol-{n}", (every << np.uint8(n)) | (every >> np.uint8(8 - n))
    yield "nibbles", (every << np.uint8(4)) | (every >> np.uint8(4))


def transformed_audio(rows: DataFrame, key: str, data: str, least: float = 0.40, run: int = 6) -> DataFrame:
    """``transform``, ``start``, ``stop``: the table under which most windows in a row become correlated, if the bytes as they stand aren't.

    An XOR with a key keeps differences of neighbours only where no carry is involved, so each key is tried on the windows.
    """

    def made(value: bytes) -> Iterator[tuple]:
        raw = np.frombuffer(value, np.uint8)
        count = (len(raw) - WINDOW) // WINDOW + 1
        if count < run:
            return
        windows = raw[: count * WINDOW].reshape(count, WINDOW)
        plain = lag_correlations(windows.astype(np.int8).astype(np.float64), (1,))[:, 0]
        best: tuple[int, float, str, int, int] | None = None
        for name, table in transforms():
            r = lag_correlations(table[windows].astype(np.int8).astype(np.float64), (1,))[:, 0]
            for a, b in runs_of((r >= least) & (r > plain + 0.1), run):
                score = (b - a, float(r[a:b].mean()), name, a * WINDOW, b * WINDOW)
                best = score if best is None or score[:2] > best[:2] else best
        if best:
            yield best[2], best[3], best[4], round(best[1], 4)

    return each_value(rows, [key], [data], "transform string, start bigint, stop bigint, score double", made)


def concealment(rows: DataFrame, key: str, data: str, least: int = 32) -> DataFrame:
    """Runs of at least so many 16-bit samples that were put in for lost ones: muted, held, interpolated in a line, or repeated from just before."""

    def made(value: bytes) -> Iterator[tuple]:
        x = numbers_of(value, "i16").astype(np.int64)
        if len(x) < 2 * least:
            return
        step = np.diff(x)
        hits = [("mute", a, b) for a, b in runs_of(x == 0, least)]
        hits += [("hold", a, b + 1) for a, b in runs_of((step == 0) & (x[1:] != 0), least)]
        hits += [("line", a, b + 2) for a, b in runs_of((np.diff(step) == 0) & (step[1:] != 0), least)]
        hits += [("repeat", a + least, b + least) for a, b in runs_of((x[least:] == x[:-least]) & (x[least:] != 0), least) if len(set(x[a : a + least])) > 2]
        yield from sorted(hits, key=lambda h: (h[1], h[0]))

    return each_value(rows, [key], [data], "kind string, start bigint, stop bigint", made)


def silence_split(rows: DataFrame, key: str, data: str, rate: int, threshold: float = 25, gap_s: float = 1.5, song_s: float = 5.0) -> DataFrame:
    """Songs between quiet stretches of 16-bit mono samples, by the level of windows of 50 ms."""

    def made(value: bytes) -> Iterator[tuple]:
        x = numbers_of(value, "i16").astype(np.float64)
        size = max(1, rate // 20)
        n = -(-len(x) // size)
        if not n:
            return
        level = np.sqrt(np.add.reduceat(x * x, np.arange(n) * size) / np.diff(np.r_[np.arange(n) * size, len(x)]))
        quiet = np.zeros(n, bool)
        for a, b in runs_of(level < threshold, max(1, round(gap_s * 20))):
            quiet[a:b] = True
        for a, b in runs_of(~quiet, max(1, round(song_s * 20))):
            yield a * size, min(len(x), b * size)

    return each_value(rows, [key], [data], "start bigint, stop bigint", made)


# Spectra


def spectrogram(x: np.ndarray, size: int = 4096, hop: int = 1024) -> np.ndarray:
    """Magnitudes of frames by bins, with a Hann window."""
    if len(x) < size:
        x = np.pad(x, (0, size - len(x)))
    frames = np.lib.stride_tricks.sliding_window_view(x, size)[::hop]
    return np.abs(np.fft.rfft(frames * _hann(size), axis=1))


_hann = functools.cache(np.hanning)


@functools.cache
def _pitches(size: int, rate: int) -> tuple[slice, np.ndarray]:
    """Bins from 55 to 5,000 Hz, and the pitch class of each."""
    freqs = np.fft.rfftfreq(size, 1 / rate)
    inside = np.flatnonzero((freqs >= 55) & (freqs <= 5000))
    classes = np.round(12 * np.log2(np.maximum(freqs, 1e-9) / 440) + 69).astype(int) % 12
    bins = slice(int(inside[0]), int(inside[-1]) + 1) if len(inside) else slice(0, 0)
    return bins, classes[bins]


def median_filter(x: np.ndarray, size: int, axis: int) -> np.ndarray:
    """Median of a centred window along an axis; ends are mirrored."""
    half = size // 2
    pad = [(half, half) if a == axis else (0, 0) for a in range(x.ndim)]
    return np.median(np.lib.stride_tricks.sliding_window_view(np.pad(x, pad, "reflect" if x.shape[axis] > half else "edge"), size, axis=axis), axis=-1)


def chroma(x: np.ndarray, rate: int, harmonic: bool = True) -> np.ndarray:
    """Energy of the twelve pitch classes from 55 to 5,000 Hz, compressed by log(1 + 100 x); percussive energy is masked out."""
    mag = spectrogram(x.astype(np.float64) / max(1.0, np.abs(x).max(initial=0)))
    if harmonic and len(mag) >= 17:
        steady, sharp = median_filter(mag, 17, 0), median_filter(mag, 17, 1)
        mag = mag * steady**2 / np.maximum(steady**2 + sharp**2, 1e-12)
    bins, classes = _pitches(4096, rate)
    return np.bincount(classes, np.log1p(100 * mag[:, bins]).sum(axis=0), minlength=12)


def chromas(rows: DataFrame, key: str, data: str, rate: int) -> DataFrame:
    """``pc`` and ``energy``: a row a pitch class of 16-bit mono samples, as key estimation takes them."""

    def made(value: bytes) -> Iterator[tuple]:
        yield from ((pc, round(float(e), 6)) for pc, e in enumerate(chroma(numbers_of(value, "i16"), rate)))

    return each_value(rows, [key], [data], "pc int, energy double", made)


@functools.cache
def _walls(rate: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Frequencies at which a wall may be, and of each the bins where the band below begins, where the band above begins, and where that ends; both hold bins."""
    freqs = np.fft.rfftfreq(4096, 1 / rate)
    at, ratio = np.geomspace(1000, rate / 2 * 0.98, 240), 2 ** (1 / 6)
    low, middle, high = (np.searchsorted(freqs, f) for f in (at / ratio, at, np.minimum(at * ratio, rate / 2)))
    held = (low < middle) & (middle < high)
    return at[held], low[held], middle[held], high[held]


def bandwidth_wall(x: np.ndarray, rate: int, drop: float = 40.0) -> tuple[float | None, float]:
    """The frequency at which the level falls the most from one band to the next, and by how many dB; None if by less than ``drop``.

    Means of bands are differences of running sums; those that come within a millionth of the most are worked out anew.
    """
    mag = spectrogram(x.astype(np.float64))
    level = 20 * np.log10(np.maximum((mag**2).mean(axis=0) ** 0.5, 1e-9))
    at, low, middle, high = _walls(rate)
    sums = np.concatenate(([0.0], np.cumsum(level)))
    steps = (sums[middle] - sums[low]) / (middle - low) - (sums[high] - sums[middle]) / (high - middle)
    best, where = 0.0, None
    for i in np.flatnonzero(steps >= steps.max(initial=0.0) - 1e-6):
        if (step := float(level[low[i] : middle[i]].mean() - level[middle[i] : high[i]].mean())) > best:
            best, where = step, float(at[i])
    return (round(where, 1) if where is not None and best >= drop else None), round(best, 3)


def bandwidths(rows: DataFrame, key: str, data: str, rate: int) -> DataFrame:
    def made(value: bytes) -> Iterator[tuple]:
        wall, drop = bandwidth_wall(numbers_of(value, "i16"), rate)
        yield wall, drop, wall is not None

    return each_value(rows, [key], [data], "wall_hz double, drop_db double, transcoded boolean", made)


def tempo(x: np.ndarray, rate: int) -> float | None:
    """Beats a minute from the autocorrelation of the rise in level, 60 to 200."""
    hop = 512
    mag = spectrogram(x.astype(np.float64), 1024, hop)
    rise = np.maximum(np.diff(np.log1p(mag), axis=0), 0).sum(axis=1)
    if len(rise) < 8 or not rise.std():
        return None
    d = rise - rise.mean()
    lags = np.arange(max(1, round(60 / 200 * rate / hop)), min(len(d) - 1, round(60 / 60 * rate / hop)) + 1)
    if not len(lags):
        return None
    value = np.array([(d[:-k] * d[k:]).sum() for k in lags])
    return round(60 * rate / hop / float(lags[value.argmax()]), 3) if value.max() > 0 else None


FEATURE_NAMES = ["duration", "tempo", "rms", "zcr", "centroid", "spread", "rolloff", "flatness"] + [f"chroma_{i}" for i in range(12)] + [f"band_{i}" for i in range(25)]


@functools.cache
def _bands(n: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of so many nearly equal parts."""
    sizes = np.array([len(p) for p in np.array_split(np.empty(n), parts)])
    return np.cumsum(sizes) - sizes, sizes


_frequencies = functools.cache(lambda size, rate: np.fft.rfftfreq(size, 1 / rate))


def audio_features(x: np.ndarray, rate: int) -> dict[str, float]:
    """Numbers that describe a sound: level, crossings, shape of the spectrum, pitch classes, and levels of 25 bands."""
    y = x.astype(np.float64) / 32768
    mag = spectrogram(y, 2048, 512).mean(axis=0)
    freqs = _frequencies(2048, rate)
    total = mag.sum() or 1.0
    centroid = float((mag * freqs).sum() / total)
    out = {"duration": len(y) / rate, "tempo": tempo(x, rate) or 0.0, "rms": float(np.sqrt((y * y).mean())) if len(y) else 0.0, "zcr": float((np.diff(np.signbit(y)) != 0).mean()) if len(y) > 1 else 0.0, "centroid": centroid}
    out["spread"] = float(np.sqrt((mag * (freqs - centroid) ** 2).sum() / total))
    out["rolloff"] = float(freqs[np.searchsorted(np.cumsum(mag), 0.85 * total)]) if mag.sum() else 0.0
    out["flatness"] = float(np.exp(np.log(np.maximum(mag, 1e-12)).mean()) / max(mag.mean(), 1e-12))
    out |= {f"chroma_{i}": float(v) for i, v in enumerate(chroma(x, rate, False))}
    starts, sizes = _bands(len(mag), 25)
    return out | {f"band_{i}": v for i, v in enumerate(np.log10(np.maximum(np.add.reduceat(mag, starts) / sizes, 1e-12)).tolist())}


def features_table(rows: DataFrame, key: str, data: str, rate: int) -> DataFrame:
    """``vector``: audio_features() of 16-bit mono samples in the order of FEATURE_NAMES."""

    def made(value: bytes) -> Iterator[tuple]:
        found = audio_features(numbers_of(value, "i16"), rate)
        yield ([float(found[n]) for n in FEATURE_NAMES],)

    return each_value(rows, [key], [data], "vector array<double>", made)
