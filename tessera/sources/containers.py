"""Disc images, cue sheets and console streams: bytes in, a row a file, track or block out."""

from __future__ import annotations

import re
from collections.abc import Iterator

from tessera.sources.chunks import Chunk, fields_of, number, text_of

SECTOR, RAW = 2048, 2352


def iso9660(data: bytes) -> Iterator[Chunk]:
    """Files of an ISO image, depth first; a folder that is met again isn't entered."""
    if data[16 * SECTOR + 1 : 16 * SECTOR + 6] != b"CD001":
        yield "warning", 0, 0, {}, "no volume descriptor"
        return
    root = 16 * SECTOR + 156
    yield "volume", 16 * SECTOR, SECTOR, {"name": text_of(data[16 * SECTOR + 40 : 16 * SECTOR + 72])}, None
    seen: set[int] = set()

    def inside(lba: int, size: int, path: str) -> Iterator[Chunk]:
        if lba in seen:
            return
        seen.add(lba)
        at, end = lba * SECTOR, min(len(data), lba * SECTOR + size)
        while at < end:
            n = data[at]
            if not n:  # records don't cross sectors
                at = (at // SECTOR + 1) * SECTOR
                continue
            extent, length, name = number(data, at + 2, 4, "little"), number(data, at + 10, 4, "little"), data[at + 33 : at + 33 + data[at + 32]]
            if name not in (b"\0", b"\1"):
                full = f"{path}/{name.decode('latin-1').split(';')[0]}"
                if data[at + 25] & 2:
                    yield from inside(extent, length, full)
                else:
                    yield "file", extent * SECTOR, length, {"path": full, "lba": extent}, "file goes beyond the image" if extent * SECTOR + length > len(data) else None
            at += n

    yield from inside(number(data, root + 2, 4, "little") or 0, number(data, root + 10, 4, "little") or 0, "")


def gcm(data: bytes) -> Iterator[Chunk]:
    """Files of a GameCube image, from its table: entries of twelve bytes, then names."""
    at, total = number(data, 0x424, 4, "big") or 0, number(data, 0x428, 4, "big")
    count = number(data, at + 8, 4, "big") or 0
    yield "GCM", 0, 0x440, {"game": text_of(data[:6]), "title": text_of(data[0x20:0x60]), "entries": count, "table": at}, None if at + 12 * count <= len(data) and total else "file table is outside of the image"
    names = at + 12 * count
    folders: list[tuple[int, str]] = []
    for i in range(1, min(count, max(0, len(data) - at) // 12)):
        word, offset, length = (number(data, at + 12 * i + 4 * k, 4, "big") for k in range(3))
        while folders and i >= folders[-1][0]:
            folders.pop()
        full = (folders[-1][1] if folders else "") + "/" + text_of(data[names + (word & 0xFFFFFF) : names + (word & 0xFFFFFF) + 256])
        if word >> 24:
            folders.append((length, full))
        else:
            yield "file", offset, length, {"path": full}, "file goes beyond the image" if offset + length > len(data) else None


def cue(data: bytes) -> Iterator[Chunk]:
    """Tracks of a cue sheet: file, type, and the start of index 1 in frames of a 75th of a second."""
    file = number_ = kind = None
    for found in re.finditer(r'(?im)^\s*(?:FILE\s+"([^"]*)"|TRACK\s+(\d+)\s+(\S+)|INDEX\s+01\s+(\d+):(\d+):(\d+))', data.decode("utf-8", "replace")):
        name, track, type_, m, s, f = found.groups()
        if name is not None:
            file = name
        elif track is not None:
            number_, kind = int(track), type_
        elif number_ is not None:
            start = (int(m) * 60 + int(s)) * 75 + int(f)
            yield f"track{number_}", start * RAW, 0, {"number": number_, "type": kind, "file": file, "start_lba": start}, None


def cdxa(data: bytes) -> Iterator[Chunk]:
    """Audio streams of a raw CD image: sectors whose submode says audio, by file and channel."""
    found: dict[tuple[int, int], list[int]] = {}
    for at in range(0, len(data) - RAW + 1, RAW):
        if data[at + 15] == 2 and data[at + 18] & 4:
            row = found.setdefault((data[at + 16], data[at + 17]), [at, 0, data[at + 19]])
            row[1] += 1
    for (file, channel), (at, sectors, coding) in sorted(found.items()):
        yield f"xa{file}.{channel}", at, sectors * RAW, {"file": file, "channel": channel, "sectors": sectors, "channels": 1 + (coding & 1), "sample_rate": 18900 if coding & 4 else 37800}, None


def adx(data: bytes) -> Iterator[Chunk]:
    decoded = fields_of([("copyright", 2, ">H"), ("encoding", 4, ">B"), ("block_size", 5, ">B"), ("bits", 6, ">B"), ("channels", 7, ">B"), ("sample_rate", 8, ">I"), ("samples", 12, ">I"), ("cutoff", 16, ">H")], data)
    start = decoded.pop("copyright", 0) + 4
    yield "ADX", 0, start, decoded, None if data[start - 6 : start] == b"(c)CRI" else "no (c)CRI before the audio"
    yield "data", start, max(0, len(data) - start), {}, None


def hps(data: bytes) -> Iterator[Chunk]:
    decoded = fields_of([("sample_rate", 8, ">I"), ("channels", 12, ">I")], data)
    yield "HALPST", 0, 0x80, decoded, None
    at, seen = 0x80, set()
    while at not in seen and at + 12 <= len(data):
        seen.add(at)
        size, _, following = (number(data, at + 4 * k, 4, "big") for k in range(3))
        yield "block", at, size, {"next": following}, "block goes beyond the file" if at + 32 + size > len(data) else None
        if following == 0xFFFFFFFF:
            return
        at = following


def brstm(data: bytes) -> Iterator[Chunk]:
    order = "little" if data[4:6] == b"\xff\xfe" else "big"
    yield "RSTM", 0, number(data, 12, 2, order) or 64, {"order": order, "file_size": number(data, 8, 4, order)}, None
    for i in range(min(number(data, 14, 2, order) or 0, 8)):
        at, size = number(data, 16 + 8 * i, 4, order), number(data, 20 + 8 * i, 4, order)
        if at is None or size is None or not size:
            continue
        decoded: dict[str, object] = {}
        if data[at : at + 4] == b"HEAD":
            one = at + 8 + (number(data, at + 12, 4, order) or 0)
            decoded = {"codec": data[one] if one < len(data) else None, "loop": data[one + 1] if one + 1 < len(data) else None, "channels": data[one + 2] if one + 2 < len(data) else None, "sample_rate": number(data, one + 4, 2, order), "samples": number(data, one + 12, 4, order)}
        yield text_of(data[at : at + 4]) or f"section{i}", at, size, decoded, "section goes beyond the file" if at + size > len(data) else None


def wii(data: bytes) -> Iterator[Chunk]:
    yield "WII", 0, 0x40, {"game": text_of(data[:6]), "title": text_of(data[0x20:0x60])}, "partitions are encrypted and not read"


def n64rom(data: bytes) -> Iterator[Chunk]:
    order = {b"\x80\x37\x12\x40": "z64", b"\x37\x80\x40\x12": "v64", b"\x40\x12\x37\x80": "n64"}.get(data[:4])
    yield "ROM", 0, 0x40, {"layout": order, "title": text_of(data[0x20:0x34]) if order == "z64" else None}, None


def snesrom(data: bytes) -> Iterator[Chunk]:
    at = 0x7FC0 if len(data) >= 0x7FE0 and (number(data, 0x7FDC, 2, "little") ^ number(data, 0x7FDE, 2, "little")) == 0xFFFF else 0xFFC0
    yield "header", at, 32, {"title": text_of(data[at : at + 21]), "map_mode": data[at + 21] if at + 21 < len(data) else None, "checksum": number(data, at + 30, 2, "little")}, None


PARSERS = {"iso": iso9660, "gcm": gcm, "cue": cue, "cdxa": cdxa, "adx": adx, "hps": hps, "brstm": brstm, "wii": wii, "n64rom": n64rom, "snesrom": snesrom}
