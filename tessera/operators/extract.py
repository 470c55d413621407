"""Samples out of banks and modules, regions cut out of files, pictures, and records by declared layouts."""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import codecs
from tessera.functions.bytes import each_value, numbers_of
from tessera.functions.sniffing import sniff
from tessera.functions.values import decode_value
from tessera.operators import signals
from tessera.sources import audio, formats

Sample = tuple[str, int, bytes]  # name, rate, 16-bit PCM


def _wide(data: bytes, signed: bool = True) -> bytes:
    """8-bit samples as 16-bit ones."""
    raw = np.frombuffer(data, np.int8 if signed else np.uint8).astype(np.int16)
    return ((raw if signed else raw - 128) << 8).astype("<i2").tobytes()


def from_sf2(data: bytes) -> Iterator[Sample]:
    body = next((at + 8 for tag, at, *_ in audio.sf2(data) if tag == "smpl"), None)
    for tag, _, _, f, warning in audio.sf2(data):
        if body is not None and re.fullmatch(r"sample\d+", tag) and not warning and f["sample_rate"] and f["end"] > f["start"]:
            yield f["name"], f["sample_rate"], data[body + 2 * f["start"] : body + 2 * f["end"]]


def from_mod(data: bytes) -> Iterator[Sample]:
    for tag, at, size, f, _ in formats.mod(data):
        if tag.startswith("smp"):
            yield f["name"] or tag, 8363, _wide(data[at : at + size])


def from_xm(data: bytes) -> Iterator[Sample]:
    for tag, at, size, f, _ in formats.xm(data):
        if tag.startswith("smp") and size:
            wide = f["bits"] == 16
            steps = np.frombuffer(data[at : at + size // (2 if wide else 1) * (2 if wide else 1)], "<i2" if wide else np.int8)
            whole = np.cumsum(steps.astype(np.int64))
            yield f["name"] or tag, 8363, (whole.astype(np.int16).astype("<i2").tobytes() if wide else _wide(whole.astype(np.int8).tobytes()))


def from_s3m(data: bytes) -> Iterator[Sample]:
    signed = number_at(data, 0x2A) == 1
    for tag, _, _, f, _ in formats.s3m(data):
        if tag.startswith("ins") and f.get("type") == 1 and f["length"] and f["data_offset"]:
            yield f["name"] or tag, f["c2spd"], _wide(data[f["data_offset"] : f["data_offset"] + f["length"]], signed)


def number_at(data: bytes, at: int) -> int:
    return struct.unpack_from("<H", data, at)[0] if at + 2 <= len(data) else 0


def from_it(data: bytes) -> Iterator[Sample]:
    for tag, at, _, f, _ in formats.it(data):
        if tag.startswith("smp") and f.get("flags", 0) & 1 and f["length"]:
            wide, start, packed = f["bits"] == 16, f["data_offset"], f["flags"] & 8
            convert = data[at + 46] if at + 46 < len(data) else 1
            body = codecs.impulse(data[start:], f["length"], wide, bool(convert & 4)) if packed else data[start : start + f["length"] * (2 if wide else 1)]
            yield f["name"] or tag, f["c5speed"], body if wide else _wide(body, bool(convert & 1))


def from_vag(data: bytes) -> Iterator[Sample]:
    rate, size = struct.unpack_from(">I", data, 16)[0], struct.unpack_from(">I", data, 12)[0]
    yield formats.text_of(data[32:48]), rate, codecs.spu(data[48 : 48 + size])


def from_gf1(data: bytes) -> Iterator[Sample]:
    for tag, at, size, f, _ in formats.gf1pat(data):
        if tag == "smp":
            body = data[at : at + size]
            if f["bits"] == 16:
                raw = numbers_of(body, "u16" if f["unsigned"] else "i16").astype(np.int64)
                yield f["name"], f["sample_rate"], (raw - (32768 if f["unsigned"] else 0)).astype("<i2").tobytes()
            else:
                yield f["name"], f["sample_rate"], _wide(body, not f["unsigned"])


def from_krz(data: bytes) -> Iterator[Sample]:
    for tag, at, size, _, _ in formats.krz(data):
        if tag == "PCM":
            yield "PCM", 44_100, numbers_of(data[at : at + size], "i16", True).astype("<i2").tobytes()


def from_8svx(data: bytes) -> Iterator[Sample]:
    rate, packed, name = 8363, 0, "BODY"
    for tag, at, size, f, _ in audio.svx(data):
        body = data[at + 8 : at + 8 + size]
        if tag == "VHDR":
            rate, packed = f.get("sample_rate", rate), f.get("compression", 0)
        elif tag == "NAME":
            name = f["text"]
        elif tag == "BODY":
            yield name, rate, codecs.fibonacci(body) if packed else _wide(body)


def from_wave(data: bytes) -> Iterator[Sample]:
    rate = next((f.get("sample_rate") for tag, _, _, f, _ in audio.wav(data) if tag == "fmt "), None)
    if rate and (body := codecs.wav_to_pcm(data)):
        yield "data", rate, body


def from_ncw(data: bytes) -> Iterator[Sample]:
    yield "NCW", struct.unpack_from("<I", data, 12)[0], codecs.ncw(data)


def from_adx(data: bytes) -> Iterator[Sample]:
    yield "ADX", struct.unpack_from(">I", data, 8)[0], codecs.adx(data)


def from_snes(data: bytes, least_blocks: int = 16, coherent: float = 0.8) -> Iterator[Sample]:
    """BRR sounds of a ROM: runs of blocks with valid ranges up to an end flag that decode to something smooth."""
    raw = np.frombuffer(data, np.uint8)
    stop_at = 0
    # A sound begins with a range that isn't 0 and doesn't end in its first block.
    for at in np.flatnonzero((raw >> 4 > 0) & (raw >> 4 <= 12) & (raw & 1 == 0)).tolist():
        if at < stop_at or at + 9 * least_blocks > len(raw):
            continue
        heads = raw[at : at + 9 * 2048 : 9]
        stop = np.flatnonzero((heads >> 4 > 12) | (heads & 1 == 1))
        blocks = int(stop[0]) + 1 if len(stop) and heads[stop[0]] >> 4 <= 12 else 0
        if blocks >= least_blocks and len(np.unique(heads[:blocks])) > 1:
            body = codecs.brr(data[at : at + 9 * blocks])
            r, _, level = signals.coherence(numbers_of(body, "i16"), 200)
            if r >= coherent and level >= 100:
                yield f"{at:06x}", 32_000, body
                stop_at = at + 9 * blocks


def from_n64(data: bytes, least: int = 512, coherent: float = 0.8) -> Iterator[Sample]:
    """VADPCM sounds of a ROM: codebooks by their headers, each tried on what follows it, kept if it decodes to something smooth."""
    for m in re.finditer(rb"\x00\x00\x00\x02\x00\x00\x00[\x01-\x08]", data):
        predictors = data[m.end() - 1]
        book = data[m.end() : m.end() + 32 * predictors]
        if len(book) < 32 * predictors or not any(book):
            continue
        start = m.end() + 32 * predictors
        heads = np.frombuffer(data, np.uint8)[start : start + 9 * 4096 : 9]
        wrong = np.flatnonzero((heads & 15 >= predictors) | (heads >> 4 > 12))
        frames = int(wrong[0]) if len(wrong) else len(heads)
        if frames * 16 >= least:
            body = codecs.vadpcm(data[start : start + 9 * frames], list(struct.unpack(f">{16 * predictors}h", book)))
            if signals.coherence(numbers_of(body, "i16"), 200)[0] >= coherent:
                yield f"{start:06x}", 22_050, body


#: Extractors by format; register_extractor() adds to them.
EXTRACTORS: dict[str, Callable[[bytes], Iterator[Sample]]] = {
    "sf2": from_sf2, "mod": from_mod, "xm": from_xm, "s3m": from_s3m, "it": from_it, "vag": from_vag, "gf1pat": from_gf1, "krz": from_krz, "8svx": from_8svx, "wav": from_wave, "ncw": from_ncw, "adx": from_adx, "snesrom": from_snes, "n64rom": from_n64,
}


def register_extractor(kind: str, extract: Callable[[bytes], Iterator[Sample]]) -> None:
    EXTRACTORS[kind] = extract


def samples(files: DataFrame) -> DataFrame:
    """Samples of each file that holds some: ``ordinal``, ``name``, ``rate``, ``pcm`` (16-bit). A damaged file gives those before the damage."""

    def made(data: bytes, name: bytes) -> Iterator[tuple]:
        extract = EXTRACTORS.get(sniff(data, name.decode()))
        try:
            for i, (label, rate, pcm) in enumerate(extract(data) if extract else ()):
                yield i, label, int(rate), pcm
        except (struct.error, IndexError, KeyError, ValueError, TypeError):
            return

    named = files.select("path", "content", F.encode("path", "UTF-8").alias("_name"))
    return each_value(named, ["path"], ["content", "_name"], "ordinal int, name string, rate int, pcm binary", made)


# Cutting


def carve(files: DataFrame, offset: Column, length: Column) -> DataFrame:
    """A range of each file."""
    return files.select("path", offset.alias("offset"), F.substring("content", (offset + 1).cast("int"), length.cast("int")).alias("part"))


def carve_regions(files: DataFrame, regions: DataFrame) -> DataFrame:
    """Every region of ``regions`` (path, start, stop) cut out of its file; a region beyond the file is cut short."""
    rows = files.select("path", "content").join(regions, "path")
    return rows.select("path", "start", "stop", F.substring("content", (F.col("start") + 1).cast("int"), (F.col("stop") - F.col("start")).cast("int")).alias("part"))


def carve_struct(files: DataFrame, layout: str) -> DataFrame:
    """Fields by a layout such as ``@4 size:u32 @8 kind:bytes:4``: a place, then a name and a type, one after the other."""
    at, columns = 0, []
    from tessera.functions.bytes import WIDTHS

    for token in layout.split():
        if token.startswith("@"):
            at = int(token[1:], 0)
            continue
        name, _, kind = token.partition(":")
        big = kind.endswith(">")
        kind = kind.rstrip("<>")
        columns.append(decode_value(F.col("content"), kind, at, big).alias(name))
        at += WIDTHS.get(kind) or (int(kind[6:]) if kind.startswith("bytes:") else 0)
    return files.select("path", *columns)


def cover(data: bytes) -> tuple[str, bytes] | None:
    """The first picture in a file: its type and bytes."""
    kind = sniff(data)
    if kind == "flac":
        for tag, at, size, f, _ in audio.flac(data):
            if tag == "PICTURE":
                return f["mime"], data[at + 4 + f["data_at"] : at + 4 + size]
    if kind in ("mp3", "id3-wrapped"):
        for tag, at, size, f, _ in audio.id3v2(data):
            if tag == "APIC":
                body = data[at + 10 : at + 10 + size]
                rest = body[len(f["mime"]) + 3 :]
                end = b"\0\0" if body[:1] in (b"\1", b"\2") else b"\0"
                return f["mime"], rest.partition(end)[2]
    if kind == "mp4" and (at := data.find(b"covr")) > 0:
        size, code = struct.unpack_from(">I", data, at + 4)[0], struct.unpack_from(">I", data, at + 12)[0]
        return ("image/png" if code == 14 else "image/jpeg"), data[at + 20 : at + 4 + size]
    return None


def covers(files: DataFrame) -> DataFrame:
    def made(data: bytes) -> Iterator[tuple]:
        if (found := cover(data)) is not None:
            yield found

    return each_value(files, ["path"], ["content"], "mime string, picture binary", made)


def compiled(layout: list[dict], content: str = "content") -> list[Column]:
    """A declared layout as Column expressions: each field has a name, a type, a place (a number or ``after`` another field's end), an order and maybe a table of names.

    Formats that are fixed heads need no parser: their fields are read by the engine's own expressions.
    """
    from tessera.functions.bytes import WIDTHS

    out, ends, at = [], {}, 0
    for f in layout:
        at = ends[f["after"]] if "after" in f else f.get("at", at)
        value = decode_value(F.col(content), f["type"], at, f.get("order", "little") == "big")
        if "names" in f:
            table = F.create_map(*[x for k, v in f["names"].items() for x in (F.lit(k), F.lit(v))])
            value = F.coalesce(F.element_at(table, value.cast("int")), value.cast("string"))
        out.append(value.alias(f["name"]))
        at += WIDTHS.get(f["type"]) or (int(f["type"][6:]) if f["type"].startswith("bytes:") else 0)
        ends[f["name"]] = at
    return out
