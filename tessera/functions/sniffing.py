"""Formats by magic bytes: one ordered table, read by a Column expression and by Python alike. The first rule that fits decides."""

from __future__ import annotations

import io
import json
import struct
import zipfile
import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Format id, then what must stand where. The order is part of the rule.
RULES: list[tuple[str, list[tuple[int, bytes]]]] = [
    ("cdxa", [(0, b"\x00" + b"\xff" * 10 + b"\x00")]),
    ("wav", [(0, b"RIFF"), (8, b"WAVE")]),
    ("sf2", [(0, b"RIFF"), (8, b"sfbk")]),
    ("rmid", [(0, b"RIFF"), (8, b"RMID")]),
    ("akp", [(0, b"RIFF"), (8, b"APRG")]),
    ("pgm", [(4, b"MPC1000 PGM")]),
    ("aiff", [(0, b"FORM"), (8, b"AIFF")]),
    ("aifc", [(0, b"FORM"), (8, b"AIFC")]),
    ("e4b", [(0, b"FORM"), (8, b"E4B0")]),
    ("e5b", [(0, b"FORM"), (8, b"E5B0")]),
    ("8svx", [(0, b"FORM"), (8, b"8SVX")]),
    ("smus", [(0, b"FORM"), (8, b"SMUS")]),
    ("okt", [(0, b"OKTASONG")]),
    ("med", [(0, b"MMD0")]),
    ("med", [(0, b"MMD1")]),
    ("med", [(0, b"MMD2")]),
    ("med", [(0, b"MMD3")]),
    ("fc", [(0, b"SMOD")]),
    ("fc", [(0, b"FC14")]),
    ("krz", [(0, b"PRAM")]),
    ("krz", [(0, b"SROM")]),
    ("bfdlac", [(0, b"BFDC")]),
    ("gf1pat", [(0, b"GF1PATCH")]),
    ("vag", [(0, b"VAGp")]),
    ("hps", [(0, b" HALPST\x00")]),
    ("brstm", [(0, b"RSTM")]),
    ("cue", [(0, b'FILE "')]),
    ("midi2", [(0, b"SMF2CLIP")]),
    ("midi", [(0, b"MThd")]),
    ("rf64", [(0, b"RF64"), (8, b"WAVE")]),
    ("serum", [(0, b"XferJson")]),
    ("wt", [(0, b"vawt")]),
    ("bitwig", [(0, b"BtWg")]),
    ("amxd", [(0, b"ampf")]),
    ("asd", [(0, b"\x06I"), (6, b"\x00\x00\x00\x00")]),
    ("asd", [(0, b"\x06M"), (6, b"\x00\x00\x00\x00")]),
    ("fxp", [(0, b"CcnK")]),
    ("rx2", [(0, b"CAT "), (8, b"REX2")]),
    ("ncw", [(0, b"\x01\xa8\x9e\xd6")]),
    ("vital", [(0, b"{")]),
    ("mp4", [(4, b"ftyp")]),
    ("ni", [(12, b"hsin")]),
    ("ni", [(0, b"-in-")]),
    ("ni", [(0, b"RIFF"), (8, b"NIKS")]),
    ("flac", [(0, b"fLaC")]),
    ("ogg", [(0, b"OggS")]),
    ("xm", [(0, b"Extended Module: ")]),
    ("it", [(0, b"IMPM")]),
    ("mp3", [(0, b"ID3")]),
]
#: Bytes that the rules look at.
HEAD = 20
#: Containers that may stand behind an ID3 tag, ends of the names of captures without a header, and ROM words.
WRAPPED = (b"RIFF", b"RF64", b"FORM", b"fLaC", b"MThd")
CAPTURES = (".iq", ".cu8", ".cs8", ".cs16", ".cf32", ".cfile", ".fc32")
ROM_WORDS = (b"\x80\x37\x12\x40", b"\x37\x80\x40\x12", b"\x40\x12\x37\x80")
#: How the channel counts of tracker modules are told at offset 1080.
MOD_MAGICS = {b"M.K.": 4, b"M!K!": 4, b"FLT4": 4, b"FLT8": 8, b"CD81": 8, b"OKTA": 8, b"OCTA": 8} | {f"{n}CHN".encode(): n for n in range(1, 10)} | {f"{n}CH".encode(): n for n in range(10, 33)}
#: First elements of Ableton documents.
ABLETON = {"LiveSet": "als", "GroupDevicePreset": "adg", "Groove": "agr", "ClipSlot": "alc", "LiveClip": "alc"}

#: Kilobits of MPEG audio by (version 1?, layer) and index, and sample rates of version 1.
BITRATES = {
    (True, 1): [32 * i for i in range(15)],
    (True, 2): [0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    (True, 3): [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
    (False, 1): [0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    (False, 2): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
    (False, 3): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
RATES = [44100, 48000, 32000]


def mpeg_header(b4: bytes, allow_free: bool = False) -> dict[str, int] | None:
    """Fields of an MPEG audio frame's header; None where a reserved value shows that it isn't one. A free bitrate has length 0."""
    if len(b4) < 4 or b4[0] != 0xFF or b4[1] & 0xE0 != 0xE0:
        return None
    version, layer = b4[1] >> 3 & 3, 4 - (b4[1] >> 1 & 3)
    index, rate = b4[2] >> 4, b4[2] >> 2 & 3
    if version == 1 or layer == 4 or index == 15 or rate == 3 or (index == 0 and not allow_free):
        return None
    one = version == 3
    kbps, hz = BITRATES[one, layer][index], RATES[rate] >> (0 if one else 1 if version == 2 else 2)
    pad = b4[2] >> 1 & 1
    samples = 384 if layer == 1 else 576 if layer == 3 and not one else 1152
    size = (12 * kbps * 1000 // hz + pad) * 4 if layer == 1 else samples // 8 * kbps * 1000 // hz + pad
    return {"version": {3: 1, 2: 2, 0: 25}[version], "layer": layer, "bitrate": kbps, "sample_rate": hz, "samples": samples, "length": size if index else 0, "channels": 1 if b4[3] >> 6 == 3 else 2, "padding": pad, "crc": 1 - (b4[1] & 1), "mode_extension": b4[3] >> 4 & 3}


#: Rules by the first byte, in their order: those that begin with another one can't fit.
_BY_FIRST = [[(name, parts) for name, parts in RULES if all(at or magic[0] == b for at, magic in parts)] for b in range(256)]


def sniff_bytes(head: bytes) -> str | None:
    """Format by the first 20 bytes."""
    for name, parts in _BY_FIRST[head[0]] if head else ():
        if all(head[at : at + len(magic)] == magic for at, magic in parts) and (name != "asd" or 0 < int.from_bytes(head[2:6], "little" if head[1:2] == b"I" else "big") < 1 << 24):
            return name
    return "mp3" if mpeg_header(head[:4]) else None


def sniffed(data: Column) -> Column:
    """sniff_bytes() as an expression over binary content."""
    head = F.hex(F.substring(data, 1, HEAD))
    out = None
    for name, parts in RULES:
        fits = None
        for at, magic in parts:
            here = F.substring(head, 2 * at + 1, 2 * len(magic)) == magic.hex().upper()
            fits = here if fits is None else fits & here
        if name == "asd":
            count = F.substring(head, 5, 8)
            if parts[0][1] == b"\x06I":
                count = F.concat(*[F.substring(head, 5 + 2 * i, 2) for i in (3, 2, 1, 0)])
            fits &= F.conv(count, 16, 10).cast("bigint").between(1, (1 << 24) - 1)
        out = F.when(fits, name) if out is None else out.when(fits, name)
    byte = lambda i: F.conv(F.substring(head, 2 * i + 1, 2), 16, 10).cast("int")
    second, third = byte(1), byte(2)
    frame = (F.substring(head, 1, 2) == "FF") & (F.octet_length(data) >= 4) & (second >= 0xE0) & (F.shiftright(second, 3).bitwiseAND(3) != 1) & (F.shiftright(second, 1).bitwiseAND(3) != 0)
    return out.when(frame & ~F.shiftright(third, 4).isin(0, 15) & (F.shiftright(third, 2).bitwiseAND(3) != 3), "mp3")


def _zip_names(data: bytes) -> list[str]:
    try:
        return zipfile.ZipFile(io.BytesIO(data)).namelist()
    except (zipfile.BadZipFile, ValueError, OSError, struct.error):
        return []


def inflated(data: bytes, most: int = 64 << 20, bits: int = 47) -> bytes:
    """zlib or gzip content, as far as it goes and up to ``most`` bytes."""
    try:
        return zlib.decompressobj(bits).decompress(data, most)
    except zlib.error:
        return b""


def _snes(data: bytes) -> bool:
    for at in (0x7FC0, 0xFFC0):
        if len(data) >= at + 32:
            complement, check = struct.unpack_from("<HH", data, at + 28)
            if complement ^ check == 0xFFFF and check not in (0, 0xFFFF):
                return True
    return False


def _albank(data: bytes) -> bool:
    if data[:2] != b"B1" or len(data) < 8 or not 0 < int.from_bytes(data[2:4], "big") <= 64:
        return False
    at = int.from_bytes(data[4:8], "big")
    return at + 8 <= len(data) and 8000 <= int.from_bytes(data[at + 4 : at + 8], "big") <= 48000


def sniff(data: bytes, name: str = "") -> str | None:
    """Format by the whole content and, where that has no magic, by the end of the name."""
    low = name.lower()
    kind = sniff_bytes(data[:HEAD])
    if kind == "mp3" and data[:3] == b"ID3" and len(data) >= 10:
        size = 0
        for b in data[6:10]:
            size = size << 7 | b & 127
        size += 10 + (10 if data[5] & 16 else 0)
        return "id3-wrapped" if data[size : size + 4] in WRAPPED else "mp3"
    if kind == "mp3":
        # A lone sync is weak: a second header must stand where the first frame ends.
        step = mpeg_header(data[:4])["length"]
        kind = "mp3" if step >= 4 and mpeg_header(data[step : step + 4]) else None
    if kind == "vital":
        if low.endswith(".sigmf-meta"):
            return "sigmf"
        if low.endswith(".mpcpattern"):
            return "mpcpattern"
        return "vital" if b'"synth_version"' in data else None
    if kind is not None:
        return kind
    if low.endswith(".cue"):
        return "cue"
    if data[:2] == b"\x1f\x8b":
        inner = inflated(data, 1 << 16)
        if b"<Ableton" in inner[:4096]:
            first = inner[inner.find(b"<Ableton") :].split(b"<")[2:3]
            tag = first[0].split()[0].rstrip(b"/>").decode("latin-1") if first and first[0].split() else ""
            return ABLETON.get(tag, "adv")
        if inner[:4] == b"ACVS":
            return "xtd"
    if data[:2] == b"\x80\x00" and len(data) > 20:
        start = int.from_bytes(data[2:4], "big")
        if data[start - 2 : start + 4] == b"(c)CRI":
            return "adx"
    if data[0x18:0x1C] == b"\x5d\x1c\x9e\xa3":
        return "wii"
    if data[0x1C:0x20] == b"\xc2\x33\x9f\x3d":
        return "gcm"
    if _albank(data):
        return "albank"
    if data[:4] in ROM_WORDS:
        return "n64rom"
    if _snes(data):
        return "snesrom"
    if data[:4] == b"PK\x03\x04":
        names = _zip_names(data)
        if "multisample.xml" in names:
            return "multisample"
        if "Expansion.xml" in names or low.endswith(".xpn"):
            return "xpn"
        if low.endswith(".labx") or any(len(p := n.split("/")) >= 4 and p[1] in ("User", "Factory") for n in names):
            return "labx"
    if len(data) >= 4 and (free := mpeg_header(data[:4], True)) is not None and not free["length"]:
        again = data.find(data[:2], 24, 4096)
        if again > 0 and data[2 * again : 2 * again + 2] == data[:2]:
            return "mp3"
    if data[0x2C:0x30] == b"SCRM":
        return "s3m"
    if low.endswith((".sigmf-data", ".sigmf-meta")):
        return "sigmf"
    if low.endswith(CAPTURES):
        return "iq"
    if b"<MPCVObject" in data[:512]:
        return "xpm"
    if low.endswith(".pgm") and len(data) >= 19 and data[18] == 0 and 32 <= data[2] < 127:
        return "pgm"
    if low.endswith(".snd") and data[:1] == b"\x01" and len(data) >= 42:
        return "snd"
    return "mod" if data[1080:1084] in MOD_MAGICS else None


def leading_json(text: str) -> tuple[object, int]:
    """The JSON value that a text begins with, and where it ends; (None, 0) if there is none."""
    try:
        return json.JSONDecoder().raw_decode(text)
    except (ValueError, RecursionError):
        return None, 0
