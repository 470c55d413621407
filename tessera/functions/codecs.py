"""Sample codecs as Arrow functions: binary in, 16-bit PCM out, no row fails the job."""

from __future__ import annotations

import math
import struct
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The index and step tables of IMA ADPCM.
IMA_INDEX = [-1, -1, -1, -1, 2, 4, 6, 8, -1, -1, -1, -1, 2, 4, 6, 8]
IMA_STEPS = [
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544,
    598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
]
#: Predictor pairs of PlayStation ADPCM in 64ths, the steps of Fibonacci-delta 8SVX, and Microsoft ADPCM's factors and predictor pairs.
SPU_FILTERS = [(0, 0), (60, 0), (115, -52), (98, -55), (122, -60)]
FIBONACCI = [-34, -21, -13, -8, -5, -3, -2, -1, 0, 1, 2, 3, 5, 8, 13, 21]
MS_FACTORS = [230, 230, 230, 230, 307, 409, 512, 614, 768, 614, 512, 409, 307, 230, 230, 230]
MS_PAIRS = [(256, 0), (512, -256), (0, 0), (192, 64), (240, 0), (460, -208), (392, -232)]


def _clip(x: int) -> int:
    return max(-32768, min(32767, x))


def _nibbles(data: bytes, low_first: bool) -> np.ndarray:
    """Signed four-bit numbers, two a byte."""
    raw = np.frombuffer(data, np.uint8)
    both = np.stack([raw & 15, raw >> 4] if low_first else [raw >> 4, raw & 15], axis=1).ravel().astype(np.int64)
    return (both ^ 8) - 8


class Predictor:
    """Second-order prediction, which most console codecs share: residuals in, clipped samples out; its memory goes on from block to block."""

    def __init__(self, shift: int, rounding: int = 0, inside: bool = False, one: int = 0, two: int = 0):
        """``inside``: residuals are scaled up and rounded together with the prediction, else added after its rounding."""
        self.shift, self.rounding, self.inside, self.one, self.two = shift, rounding, inside, one, two

    def run(self, residuals: np.ndarray, a: int, b: int) -> list[int]:
        if not a and not b:
            out = np.clip(residuals, -32768, 32767).tolist()
            if len(out) > 1:
                self.one, self.two = out[-1], out[-2]
            elif out:
                self.one, self.two = out[0], self.one
            return out
        one, two, shift, rounding, out = self.one, self.two, self.shift, self.rounding, []
        for r in residuals.tolist():
            sum_ = a * one + b * two + rounding
            one, two = _clip((r << shift) + sum_ >> shift if self.inside else r + (sum_ >> shift)), one
            out.append(one)
        self.one, self.two = one, two
        return out


def _pcm16(*channels: list[int]) -> bytes:
    """Channels side by side, as long as the shortest."""
    n = min(map(len, channels), default=0)
    return np.stack([np.array(c[:n], np.int64) for c in channels], axis=1).astype("<i2").tobytes() if n else b""


def ima(data: bytes, block: int = 256, channels: int = 1) -> bytes:
    """IMA ADPCM in blocks: for each channel a 16-bit sample, an index and a spare byte; then groups of four bytes a channel, the low half first."""
    outs: list[list[int]] = [[] for _ in range(channels)]
    for at in range(0, len(data) - 4 * channels + 1, block):
        body = data[at + 4 * channels : at + block]
        for c in range(channels):
            sample, index = struct.unpack_from("<hB", data, at + 4 * c)
            index = min(index, 88)
            out = outs[c]
            out.append(sample)
            own = body if channels == 1 else b"".join(body[i + 4 * c : i + 4 * c + 4] for i in range(0, len(body), 4 * channels))
            for code in (x for byte in own for x in (byte & 15, byte >> 4)):
                step = IMA_STEPS[index]
                change = step >> 3
                for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
                    change += part if code & bit else 0
                sample = _clip(sample - change if code & 8 else sample + change)
                index = max(0, min(88, index + IMA_INDEX[code]))
                out.append(sample)
    return _pcm16(*outs)


def microsoft(data: bytes, block: int = 256, channels: int = 1) -> bytes:
    """Microsoft ADPCM in blocks: predictors, deltas and two samples of each channel, then four bits a sample, the high half first."""
    outs: list[list[int]] = [[] for _ in range(channels)]
    for at in range(0, len(data) - 7 * channels + 1, block):
        kinds = [min(k, 6) for k in data[at : at + channels]]
        deltas, ones, twos = (list(struct.unpack_from(f"<{channels}h", data, at + channels + 2 * channels * i)) for i in range(3))
        for c in range(channels):
            outs[c] += [twos[c], ones[c]]
        for i, code in enumerate(x for byte in data[at + 7 * channels : at + block] for x in (byte >> 4, byte & 15)):
            c = i % channels
            a, b = MS_PAIRS[kinds[c]]
            sample = _clip((ones[c] * a + twos[c] * b >> 8) + ((code ^ 8) - 8) * deltas[c])
            ones[c], twos[c] = sample, ones[c]
            deltas[c] = max(16, MS_FACTORS[code] * deltas[c] >> 8)
            outs[c].append(sample)
    return _pcm16(*outs)


def _ps_shift(code: int, odd: int = 9) -> int:
    """Places to shift a residual up by; codes above 12 aren't valid and count as another one."""
    return 12 - (code if code <= 12 else odd)


def spu(data: bytes) -> bytes:
    """PlayStation ADPCM: 16-byte blocks of 28 samples, up to a block that ends the sound and doesn't loop."""
    out, memory = [], Predictor(6, 32)
    for at in range(0, len(data) - 15, 16):
        a, b = SPU_FILTERS[min(data[at] >> 4, 4)]
        out += memory.run(_nibbles(data[at + 2 : at + 16], True) << _ps_shift(data[at] & 15), a, b)
        if data[at + 1] & 1 and not data[at + 1] & 2:
            break
    return _pcm16(out)


def xa(data: bytes, stereo: bool = False) -> bytes:
    """CD-XA audio: groups of 128 bytes, a header for each of eight units, whose samples stand a unit apart."""
    outs, memories = ([], []), (Predictor(6, 32), Predictor(6, 32))
    for at in range(0, len(data) - 127, 128):
        planes = np.frombuffer(data, np.uint8, 112, at + 16).reshape(28, 4).astype(np.int64)
        for unit in range(8):
            head = data[at + 4 + unit]
            codes = planes[:, unit // 2] >> 4 * (unit % 2) & 15
            c = unit % 2 if stereo else 0
            a, b = SPU_FILTERS[min(head >> 4, 4)]
            outs[c].extend(memories[c].run(((codes ^ 8) - 8) << _ps_shift(head & 15), a, b))
    return _pcm16(*outs[: 2 if stereo else 1])


def dtk(data: bytes) -> bytes:
    """GameCube streams: frames of 32 bytes, of which the high halves are the left channel."""
    outs, memories = ([], []), (Predictor(6, 32), Predictor(6, 32))
    for at in range(0, len(data) - 31, 32):
        codes = _nibbles(data[at + 4 : at + 32], False).reshape(-1, 2)
        for c in range(2):
            a, b = SPU_FILTERS[data[at + c] >> 4 & 3]
            outs[c].extend(memories[c].run((codes[:, c] << 12) >> (data[at + c] & 15), a, b))
    return _pcm16(*outs)


def dsp(data: bytes, coefficients: list[int], one: int = 0, two: int = 0, samples: int | None = None) -> list[int]:
    """DSP-ADPCM frames of 8 bytes: a scale and one of eight pairs, then 14 samples."""
    out, memory = [], Predictor(11, 1024, True, one, two)
    for at in range(0, len(data) - 7, 8):
        pair = data[at] >> 4 & 7
        out += memory.run(_nibbles(data[at + 1 : at + 8], False) << (data[at] & 15), coefficients[2 * pair], coefficients[2 * pair + 1])
    return out if samples is None else out[:samples]


def dsp_file(data: bytes) -> bytes:
    """A standalone .dsp: a header of 96 bytes with sixteen coefficients and the first memory."""
    samples = struct.unpack_from(">I", data, 0)[0]
    one, two = struct.unpack_from(">hh", data, 0x40)
    return _pcm16(dsp(data[0x60:], list(struct.unpack_from(">16h", data, 0x1C)), one, two, samples))


def hps(data: bytes) -> bytes:
    """A HAL stream: coefficients of each channel, then blocks that name the next one; each block has its channels one after the other."""
    channels = struct.unpack_from(">I", data, 12)[0]
    tables = [list(struct.unpack_from(">16h", data, 0x20 + 0x38 * c)) for c in range(min(channels, 2))]
    outs: list[list[int]] = [[] for _ in tables]
    at, seen = 0x80, set()
    while at not in seen and at + 32 <= len(data):
        seen.add(at)
        size, last, following = struct.unpack_from(">III", data, at)
        each = size // len(tables)
        for c, table in enumerate(tables):
            one, two = struct.unpack_from(">hh", data, at + 14 + 8 * c)
            body = data[at + 32 + each * c : at + 32 + each * (c + 1)]
            outs[c] += dsp(body, table, one, two)
        if following == 0xFFFFFFFF:
            break
        at = following
    return _pcm16(*outs)


def brstm(data: bytes) -> bytes:
    """A Nintendo stream of DSP-ADPCM: blocks of each channel in turn, the last one shorter."""
    order = "<" if data[4:6] == b"\xff\xfe" else ">"
    u = lambda at, kind="I": struct.unpack_from(order + kind, data, at)[0]
    head = u(16)
    base = head + 8
    one = base + u(head + 12)
    codec, channels, samples = data[one], data[one + 2], u(one + 12)
    start, blocks, size, last_size, last_padded = u(one + 16), u(one + 20), u(one + 24), u(one + 32), u(one + 40)
    if codec != 2:
        raise ValueError(f"codec {codec} is not DSP-ADPCM")
    table = base + u(head + 28)
    outs: list[list[int]] = [[] for _ in range(channels)]
    for c in range(channels):
        info = base + u(table + 8 + 8 * c)
        at = base + u(info + 4)
        coefficients = list(struct.unpack_from(order + "16h", data, at))
        first, second = struct.unpack_from(order + "hh", data, at + 36)
        parts = []
        for b in range(blocks):
            final = b == blocks - 1
            place = start + b * size * channels + c * (last_padded if final else size)
            parts.append(data[place : place + (last_size if final else size)])
        outs[c] = dsp(b"".join(parts), coefficients, first, second, samples)
    return _pcm16(*outs)


def adx(data: bytes) -> bytes:
    """CRI ADX: blocks of each channel in turn; the predictor follows from the cutoff and the rate."""
    start, kind, size, _, channels, rate, samples, cutoff = struct.unpack_from(">HBBBBIIH", data, 2)
    if kind not in (2, 3):
        raise ValueError(f"encoding {kind} is not ADX")
    root = math.sqrt(2)
    x, y = root - math.cos(2 * math.pi * cutoff / rate), root - 1
    z = (x - math.sqrt((x + y) * (x - y))) / y
    a, b = int(z * 8192), int(-z * z * 4096)
    outs, memories = [[] for _ in range(channels)], [Predictor(12) for _ in range(channels)]
    at = start + 4
    while at + size * channels <= len(data) and len(outs[0]) < samples:
        for c in range(channels):
            scale = struct.unpack_from(">H", data, at)[0]
            outs[c] += memories[c].run(_nibbles(data[at + 2 : at + size], False) * scale, a, b)
            at += size
    return _pcm16(*(o[:samples] for o in outs))


def brr(data: bytes) -> bytes:
    """SNES BRR: blocks of nine bytes with 16 samples of 15 bits, up to the block flagged as the end; a range above 12 ends it too."""
    out: list[int] = []
    one = two = 0
    for at in range(0, len(data) - 8, 9):
        up, kind = data[at] >> 4, data[at] >> 2 & 3
        if up > 12:
            break
        for r in ((_nibbles(data[at + 1 : at + 9], False) << up) >> 1).tolist():
            if kind == 1:
                r += one + (-one >> 4)
            elif kind == 2:
                r += 2 * one + (-3 * one >> 5) - two + (two >> 4)
            elif kind == 3:
                r += 2 * one + (-13 * one >> 6) - two + (3 * two >> 4)
            one, two = max(-16384, min(16383, r)), one
            out.append(one)
        if data[at] & 1:
            break
    return _pcm16(out)


def vadpcm(data: bytes, book: list[int], order: int = 2) -> bytes:
    """N64 VADPCM: frames of nine bytes; eight samples at a time are predicted from ``order`` before them by rows of the codebook, and from each other."""
    out: list[int] = [0] * order
    table = np.array(book, np.int64).reshape(-1, order, 8)
    for at in range(0, len(data) - 8, 9):
        which = data[at] & 15
        if which >= len(table):
            break
        rows = table[which]
        residuals = _nibbles(data[at + 1 : at + 9], False) << (data[at] >> 4)
        for half in (residuals[:8], residuals[8:]):
            sums = np.array(out[-order:], np.int64) @ rows
            part = []
            for i in range(8):
                part.append(_clip(int(sums[i] >> 11) + int(half[i])))
                sums[i + 1 :] += rows[-1][: 7 - i] * half[i]
            out += part
    return _pcm16(out[order:])


def _bits(data: bytes, count: int, width: int) -> np.ndarray:
    """Signed numbers of so many bits, packed from the lowest bit on."""
    bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: count * width].reshape(-1, width).astype(np.int64)
    value = bits @ (np.int64(1) << np.arange(width, dtype=np.int64))
    return np.where(value >= 1 << width - 1, value - (1 << width), value)


def ncw(data: bytes) -> bytes:
    """NI's lossless waves: a table of blocks of 512 samples a channel, as differences, cut numbers or raw; 16 bits of what has more."""
    channels, bits, _, samples, table, body = struct.unpack_from("<HHIIII", data, 8)
    blocks = -(-samples // 512)
    offsets = struct.unpack_from(f"<{blocks}I", data, table)
    outs: list[list[np.ndarray]] = [[] for _ in range(channels)]
    for offset in offsets:
        at, parts, middle = body + offset, [], False
        for c in range(channels):
            _, base, width, flags = struct.unpack_from("<iihH", data, at)
            middle = bool(flags & 1) if c == 0 else middle
            at += 16
            size = 512 * (abs(width) or bits) // 8
            values = _bits(data[at : at + size], 512, abs(width) or bits)
            parts.append(np.r_[0, np.cumsum(values)[:-1]] + base if width > 0 else values)
            at += size
        if middle and channels == 2:
            parts = [parts[0] + parts[1], parts[0] - parts[1]]
        for c in range(channels):
            outs[c].append(parts[c])
    whole = [np.concatenate(o)[:samples] for o in outs]
    return _pcm16(*((x >> max(0, bits - 16)).tolist() for x in whole))


class _Bits:
    def __init__(self, data: bytes):
        self.value, self.left = int.from_bytes(data, "little"), 8 * len(data)

    def take(self, n: int) -> int:
        out = self.value & (1 << n) - 1
        self.value >>= n
        self.left -= n
        return out


def impulse(data: bytes, count: int, wide: bool = False, twice: bool = False) -> bytes:
    """Impulse Tracker's packed samples: numbers of a width that they change themselves, as differences, or differences of differences."""
    top, most, first = (16, 0x4000, 17) if wide else (8, 0x8000, 9)
    out, at = [], 0
    while len(out) < count and at + 2 <= len(data):
        size = struct.unpack_from("<H", data, at)[0]
        bits, at = _Bits(data[at + 2 : at + 2 + size]), at + 2 + size
        width, one, two = first, 0, 0
        goal = min(count, len(out) + most)
        while len(out) < goal and bits.left >= 0:
            value = bits.take(width)
            if width < 7 and value == 1 << width - 1:
                new = bits.take(4 if wide else 3) + 1
                width = new if new < width else new + 1
                continue
            if 7 <= width < first:
                border = ((1 << top) - 1 >> first - width) - top // 2
                if border < value <= border + top:
                    new = value - border
                    width = new if new < width else new + 1
                    continue
            if width == first and value >> top & 1:
                width = value + 1 & 0xFF
                continue
            if width > first:
                return _packed_samples(out, top)
            own = min(width, top)
            value &= (1 << own) - 1
            one += value - (1 << own) if value >> own - 1 else value
            two += one
            out.append(two if twice else one)
    return _packed_samples(out, top)


def _packed_samples(values: list[int], bits: int) -> bytes:
    return (np.array(values, np.int64) & (1 << bits) - 1).astype(f"<u{bits // 8}").tobytes()


def split_bodies(sizes: list[int], body: bytes) -> list[bytes]:
    """A bank's sounds by their sizes, one behind the other; empty ones and those beyond the end are left out."""
    starts = np.r_[0, np.cumsum(sizes)].tolist()
    return [body[a:b] for a, b in zip(starts, starts[1:], strict=False) if b > a and b <= len(body)]


def fibonacci(data: bytes) -> bytes:
    """Fibonacci-delta 8SVX: a spare byte, a first sample, then four bits a sample, the high half first; 8 bits widened to 16."""
    if len(data) < 2:
        return b""
    codes = np.frombuffer(data[2:], np.uint8)
    steps = np.array(FIBONACCI)[np.stack([codes >> 4, codes & 15], axis=1).ravel()]
    first = struct.unpack_from("b", data, 1)[0]
    wave = (np.cumsum(steps) + first + 128) % 256 - 128
    return (wave * 256).astype("<i2").tobytes()


def pcm(data: bytes, width: int, big_endian: bool = False, signed: bool = True) -> np.ndarray:
    """Samples of 1 to 4 bytes as integers; a last part that isn't whole is left out."""
    n = len(data) // width
    raw = np.frombuffer(data[: n * width], np.uint8).reshape(n, width).astype(np.int64)
    raw = raw[:, ::-1] if not big_endian else raw
    value = np.zeros(n, np.int64)
    for i in range(width):
        value = value * 256 + raw[:, i]
    return np.where(value >= 1 << (8 * width - 1), value - (1 << 8 * width), value) if signed else value - (1 << 8 * width - 1)


#: Decoders by name: binary in, 16-bit little-endian PCM out. More go in by their name.
CODECS: dict[str, Callable[[bytes], bytes]] = {
    "ima": ima, "ima2": lambda x: ima(x, 512, 2), "microsoft": microsoft, "microsoft2": lambda x: microsoft(x, 512, 2), "spu": spu, "xa": xa, "xa2": lambda x: xa(x, True), "dtk": dtk, "dsp": dsp_file, "hps": hps, "brstm": brstm, "adx": adx,
    "brr": brr, "vadpcm": lambda x: vadpcm(x[32:], list(struct.unpack(">16h", x[:32]))), "ncw": ncw, "fibonacci": fibonacci,
}


def decoded(content: Column, codec: str) -> Column:
    """16-bit little-endian PCM of a binary column; null stays null."""
    decode = CODECS[codec]

    @F.pandas_udf("binary")
    def run(values: pd.Series) -> pd.Series:
        def one(x):
            try:
                return None if x is None else decode(bytes(x))
            except (struct.error, ValueError, IndexError, ZeroDivisionError):
                return None  # a damaged file has no samples, and fails no job

        return values.map(one)

    return run(content)


def samples_of(pcm16: Column) -> Column:
    """Samples of 16-bit PCM as integers."""

    @F.pandas_udf("array<int>")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else np.frombuffer(x[: len(x) // 2 * 2], "<i2").tolist())

    return run(pcm16)


def swapped(data: Column, width: int) -> Column:
    """Each sample's bytes in the other order; a last part that isn't whole is left out."""

    @F.pandas_udf("binary")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else np.frombuffer(x[: len(x) // width * width], np.uint8).reshape(-1, width)[:, ::-1].tobytes())

    return run(data)


def wrapped(data: Column, rate: int, channels: int = 1, width: int = 2, big_endian: bool = False, is_float: bool = False) -> Column:
    """Raw samples in a WAV file."""
    body = swapped(data, width) if big_endian else data
    return _wav_file(body, rate, channels, width, 3 if is_float else 1)


def wav_to_pcm(data: bytes) -> bytes | None:
    """A WAV's samples as 16-bit PCM, decoded if they are ADPCM; None for what isn't a WAV or has another coding."""
    from tessera.sources.chunks import iff

    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return None
    tag = channels = align = bits = 0
    for name, at, size, _, _ in iff(data, "little"):
        body = data[at + 8 : at + 8 + size]
        if name == "fmt " and len(body) >= 16:
            tag, channels, _, _, align, bits = struct.unpack_from("<HHIIHH", body)
            tag = struct.unpack_from("<H", body, 24)[0] if tag == 0xFFFE and len(body) >= 26 else tag
        elif name == "data":
            if tag == 0x11:
                return ima(body, align, channels)
            if tag == 2:
                return microsoft(body, align, channels)
            if tag == 1 and bits in (8, 16, 24, 32):
                value = pcm(body, bits // 8, signed=bits > 8)
                return (value >> bits - 16 if bits > 16 else value << 16 - bits).astype("<i2").tobytes()
            if tag == 3 and bits in (32, 64):
                value = np.nan_to_num(np.frombuffer(body[: len(body) // (bits // 8) * (bits // 8)], f"<f{bits // 8}"))
                return np.clip(np.round(value * 32767), -32768, 32767).astype("<i2").tobytes()
    return None


CODECS["wav"] = lambda x: wav_to_pcm(x) or b""


def _wav_file(body: Column, rate: int, channels: int, width: int, tag: int) -> Column:
    from tessera.sources.bindings import le32

    n = F.octet_length(body).cast("int")
    head = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, tag, channels, rate, rate * channels * width, channels * width, 8 * width) + b"data"
    return F.concat(F.unhex(F.lit(b"RIFF".hex())), le32(n + 36), F.unhex(F.lit(head.hex())), le32(n), body)


def wav_of(pcm16: Column, rate: int, channels: int = 1) -> Column:
    """A WAV file around 16-bit PCM, as an expression."""
    return _wav_file(pcm16, rate, channels, 2, 1)


def notes_to_smf(notes: list[tuple[int, float, float, int]], bpm: float = 120.0, division: int = 480) -> bytes:
    """A MIDI file of one track of notes: pitch, start and length in beats, velocity."""
    def vlq(n: int) -> bytes:
        out = bytes([n & 127])
        while n := n >> 7:
            out = bytes([n & 127 | 128]) + out
        return out

    events = []
    for pitch, start, length, velocity in notes:
        a, b = round(start * division), round((start + length) * division)
        events += [(a, 1, bytes([0x90, pitch & 127, max(1, velocity & 127)])), (max(b, a + 1), 0, bytes([0x80, pitch & 127, 0]))]
    track, now = b"\0\xff\x51\x03" + round(60e6 / bpm).to_bytes(3, "big"), 0
    for at, _, message in sorted(events):
        track += vlq(at - now) + message
        now = at
    track += b"\0\xff\x2f\0"
    return b"MThd" + struct.pack(">IHHH", 6, 0, 1, division) + b"MTrk" + struct.pack(">I", len(track)) + track
