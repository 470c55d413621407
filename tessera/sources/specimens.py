"""Small files of every format, made from a number and a name: what parsers read of them is known beforehand.

``SPECIMENS`` has for each: the end of its name, the builder, and what a walk must find, as (chunk, field, SQL over ``k`` and ``name``).
"""

from __future__ import annotations

import gzip
import io
import json
import struct
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def _chunk(tag: bytes, body: bytes, order: str = "<", pad: bool = True) -> bytes:
    return tag + struct.pack(order + "I", len(body)) + body + (b"\0" if pad and len(body) % 2 else b"")


def _riff(kind: bytes, *parts: bytes) -> bytes:
    return _chunk(b"RIFF", kind + b"".join(parts), pad=False)


def _form(kind: bytes, *parts: bytes) -> bytes:
    return _chunk(b"FORM", kind + b"".join(parts), ">", False)


def _fixed(text: str, n: int) -> bytes:
    return text.encode()[:n].ljust(n, b"\0")


def _rate(k: int) -> int:
    return 8000 + 100 * (k % 400)


def _float80(x: int) -> bytes:
    shift = x.bit_length() - 1
    return struct.pack(">HQ", 16383 + shift, x << (63 - shift))


def _box(tag: bytes, body: bytes) -> bytes:
    return struct.pack(">I", 8 + len(body)) + tag + body


def _pcm(k: int) -> bytes:
    return bytes((i * k) % 251 for i in range(2 * (k % 50 + 1)))


def _fmt(k: int) -> bytes:
    return _chunk(b"fmt ", struct.pack("<HHIIHH", 1, 1, _rate(k), 2 * _rate(k), 2, 16))


def wav(k: int, name: str) -> bytes:
    acid = struct.pack("<IHHfIHHf", k % 2, 60, 0, 0.0, k % 16, 4, 4, 100.0)
    smpl = struct.pack("<9I", 0, 0, 22675, k % 128, 0, 0, 0, 1, 0) + struct.pack("<6I", 1, 0, k % 10, k % 10 + 5, 0, 0)
    cue = struct.pack("<I", 2) + struct.pack("<II4sIII", 1, 0, b"data", 0, 0, k) + struct.pack("<II4sIII", 2, 0, b"data", 0, 0, k + 7)
    bext = _fixed(name, 256) + _fixed("tool", 32) + _fixed("ref", 32) + b"2024-01-02" + b"03:04:05" + struct.pack("<QH", k * 1000, 1) + bytes(254) + b"A=PCM"
    cart = b"0101" + _fixed(name, 64) + _fixed("an artist", 64) + bytes(1800)
    ixml = f"<BWFXML><SCENE>{k}</SCENE><TAKE>2</TAKE></BWFXML>".encode()
    info = b"INFO" + _chunk(b"INAM", name.encode()) + _chunk(b"ISFT", b"tool")
    parts = [_fmt(k), _chunk(b"fact", struct.pack("<I", k)), _chunk(b"acid", acid), _chunk(b"smpl", smpl), _chunk(b"inst", struct.pack("<BbbBBBB", 60, -3, 2, 0, 127, 1, 127)), _chunk(b"cue ", cue), _chunk(b"bext", bext), _chunk(b"cart", cart), _chunk(b"iXML", ixml), _chunk(b"BWBM", struct.pack("<II", 1, k)), _chunk(b"LIST", info), _chunk(b"data", _pcm(k))]
    return _riff(b"WAVE", *parts)


def rf64(k: int, name: str) -> bytes:
    data = _pcm(k)
    body = b"WAVE" + _chunk(b"ds64", struct.pack("<QQQI", 0, len(data), len(data) // 2, 0)) + _fmt(k) + b"data" + b"\xff" * 4 + data
    body = body[:12] + struct.pack("<Q", len(body)) + body[20:]
    return b"RF64" + b"\xff" * 4 + body


def aiff(k: int, name: str, kind: bytes = b"AIFF") -> bytes:
    comm = struct.pack(">hIh", 1 + k % 2, k, 16) + _float80(_rate(k)) + (b"sowt" + b"\x04swap\0" if kind == b"AIFC" else b"")
    label = name.encode()[:30]
    mark = struct.pack(">HHI", 1, 7, k) + bytes([len(label)]) + label + b"\0" * ((len(label) + 1) % 2)
    inst = struct.pack(">6bhhhhhhh", 60, 0, 1, 127, 1, 127, -2, 1, 3, 4, 0, 0, 0)
    comt = struct.pack(">HIHH", 1, 86400 * (k % 100 + 1), 0, len(label)) + label + b"\0" * (len(label) % 2)
    basc = struct.pack(">IIHHHHH", 1, k % 16, 48, 1, 4, 4, 0) + bytes(60)
    return _form(kind, *(_chunk(t, b, ">") for t, b in ((b"COMM", comm), (b"MARK", mark), (b"INST", inst), (b"COMT", comt), (b"NAME", name.encode()), (b"APPL", b"tool" + b"x"), (b"AESD", bytes(24)), (b"basc", basc), (b"SSND", struct.pack(">II", 0, 0) + _pcm(k)))))


def aifc(k: int, name: str) -> bytes:
    return aiff(k, name, b"AIFC")


def svx(k: int, name: str) -> bytes:
    return _form(b"8SVX", _chunk(b"VHDR", struct.pack(">IIIHBBI", k, k % 7, 32, _rate(k), 1, 0, 65536), ">"), _chunk(b"NAME", name.encode(), ">"), _chunk(b"BODY", _pcm(k), ">"))


def _comments(k: int, name: str) -> bytes:
    rows = [f"TITLE={name}", f"tracknumber={k}", "TITLE=other"]
    return struct.pack("<I", 4) + b"tool" + struct.pack("<I", len(rows)) + b"".join(struct.pack("<I", len(r.encode())) + r.encode() for r in rows)


def flac(k: int, name: str) -> bytes:
    block = lambda kind, body, last=0: bytes([last << 7 | kind]) + len(body).to_bytes(3, "big") + body
    info = struct.pack(">HH", 16, 4096) + b"\0\0\x10\0\x20\0" + (_rate(k) << 44 | (k % 2) << 41 | 15 << 36 | k * 10).to_bytes(8, "big") + bytes(16)
    image = struct.pack(">II", 3, 9) + b"image/png" + struct.pack(">I", 5) + b"cover" + struct.pack(">5I", k % 500, 10, 24, 0, 4) + b"\x89PNG"
    sheet = _fixed("catalogue", 128) + struct.pack(">Q", k) + bytes(259) + bytes([2])
    return b"fLaC" + block(0, info) + block(2, b"riff" + b"abc") + block(3, bytes(18 * (k % 4))) + block(4, _comments(k, name)) + block(5, sheet) + block(6, image) + block(1, bytes(20), 1) + b"\xff\xf8" + _pcm(k)


def midi(k: int, name: str) -> bytes:
    text = name.encode()[:100]
    notes = b"".join(bytes([0, 0x90, 60 + i % 12, 64, 96, 0x80, 60 + i % 12, 0]) for i in range(k % 9))
    events = b"\0\xff\x03" + bytes([len(text)]) + text + b"\0\xff\x51\x03" + (60_000_000 // (60 + k % 120)).to_bytes(3, "big") + b"\0\xff\x58\x04\x03\x02\x18\x08" + b"\0\xff\x59\x02\x02\0" + notes + b"\0\xff\x2f\0"
    return b"MThd" + struct.pack(">IHHH", 6, 0, 1, 96 + k % 5) + b"MTrk" + struct.pack(">I", len(events)) + events


def rmid(k: int, name: str) -> bytes:
    return _riff(b"RMID", _chunk(b"data", midi(k, name)), _chunk(b"LIST", b"INFO" + _chunk(b"INAM", name.encode())))


def _page(serial: int, sequence: int, flags: int, granule: int, packet: bytes) -> bytes:
    lacing = b"\xff" * (len(packet) // 255) + bytes([len(packet) % 255])
    return b"OggS\0" + bytes([flags]) + struct.pack("<qIII", granule, serial, sequence, 0) + bytes([len(lacing)]) + lacing + packet


def ogg(k: int, name: str) -> bytes:
    if k % 2:
        ident, tags = b"OpusHead\x01" + bytes([2]) + struct.pack("<HIhB", k % 1000, _rate(k), 0, 0), b"OpusTags" + _comments(k, name)
    else:
        ident, tags = b"\x01vorbis" + struct.pack("<IBIiiiBB", 0, 2, _rate(k), 0, 0, 0, 0, 1), b"\x03vorbis" + _comments(k, name) + b"\x01"
    return _page(k, 0, 2, 0, ident) + _page(k, 1, 0, 0, tags) + _page(k, 2, 4, k * 10, _pcm(k))


def mp4(k: int, name: str) -> bytes:
    full = lambda tag, body: _box(tag, b"\0\0\0\0" + body)
    entry = _box(b"mp4a", bytes(6) + struct.pack(">H", 1) + bytes(8) + struct.pack(">HHHHHH", 1 + k % 2, 16, 0, 0, _rate(k), 0))
    table = _box(b"stbl", full(b"stsd", struct.pack(">I", 1) + entry) + full(b"stco", struct.pack(">II", 1, k)) + full(b"stsz", struct.pack(">III", 0, 2, k) + struct.pack(">I", 5)))
    tags = _box(b"udta", full(b"meta", _box(b"ilst", _box(b"\xa9nam", _box(b"data", struct.pack(">II", 1, 0) + name.encode())) + _box(b"tmpo", _box(b"data", struct.pack(">IIH", 21, 0, 60 + k % 100))))))
    moov = _box(b"moov", full(b"mvhd", struct.pack(">IIII", 0, 0, 1000, k) + bytes(80)) + _box(b"trak", _box(b"mdia", _box(b"minf", table))) + tags)
    return _box(b"ftyp", b"M4A " + bytes(4)) + moov + _box(b"mdat", _pcm(k))


def _mpeg(frames: int) -> bytes:
    return (b"\xff\xfb\x90\x64" + bytes(413)) * frames


def mp3(k: int, name: str) -> bytes:
    frame = lambda tag, body: tag + struct.pack(">IH", len(body), 0) + body
    body = frame(b"TIT2", b"\0" + name.encode()) + frame(b"TBPM", b"\0" + str(60 + k % 100).encode()) + frame(b"TCON", b"\0(7)") + frame(b"TXXX", b"\0mood\0calm") + frame(b"COMM", b"\0eng\0" + b"a comment") + frame(b"APIC", b"\0image/png\0\x03\0" + b"\x89PNG") + bytes(30)
    size = bytes([len(body) >> 21 & 127, len(body) >> 14 & 127, len(body) >> 7 & 127, len(body) & 127])
    xing = bytearray(_mpeg(1))
    xing[36:56] = b"Xing" + struct.pack(">III", 3, k, k * 417) + b"LAME"
    return b"ID3\x03\0\0" + size + body + bytes(xing) + _mpeg(k % 7 + 1) + b"TAG" + _fixed(name, 30) + _fixed("an artist", 30) + _fixed("an album", 30) + b"1999" + bytes(31)


def sf2(k: int, name: str) -> bytes:
    header = _fixed(name, 20) + struct.pack("<5IBbHH", 0, k + 8, 2, k + 6, _rate(k), 60, -3, 0, 1)
    records = {b"phdr": _fixed(name, 20) + struct.pack("<HHHIII", k % 128, k % 3, 0, 0, 0, 0) + bytes(38), b"pbag": bytes(8), b"pmod": bytes(10), b"pgen": bytes(4), b"inst": bytes(44), b"ibag": bytes(8), b"imod": bytes(10), b"igen": bytes(4), b"shdr": header + _fixed("EOS", 46)}
    info = b"INFO" + _chunk(b"ifil", struct.pack("<HH", 2, 4)) + _chunk(b"INAM", name.encode())
    return _riff(b"sfbk", _chunk(b"LIST", info), _chunk(b"LIST", b"sdta" + _chunk(b"smpl", _pcm(k))), _chunk(b"LIST", b"pdta" + b"".join(_chunk(t, b) for t, b in records.items())))


def fxp(k: int, name: str) -> bytes:
    return b"CcnK" + struct.pack(">I", 52 + 8) + b"FPCh" + struct.pack(">I", 1) + b"Test" + struct.pack(">II", k, k % 64) + _fixed(name, 28) + struct.pack(">I", 8) + bytes(8)


def akp(k: int, name: str) -> bytes:
    zone = bytes([0, len(name[:20])]) + name[:20].encode() + bytes(10)
    return _riff(b"APRG", _chunk(b"prg ", bytes([0, k % 128, 1, 0])), _chunk(b"kgrp", _chunk(b"kloc", bytes([0, 0, 0, 0, k % 60, 60 + k % 60])) + _chunk(b"zone", zone)))


def e4b(k: int, name: str) -> bytes:
    body = struct.pack(">H", k % 1000) + _fixed(name, 16) + bytes(6)
    entry = b"E4P1" + struct.pack(">IIH", len(body), 12 + 8 + 32, k % 1000) + _fixed(name, 16) + bytes(2)
    return _form(b"E4B0", _chunk(b"TOC1", entry, ">"), _chunk(b"E4P1", body, ">"))


def e5b(k: int, name: str) -> bytes:
    body = struct.pack(">H", k % 1000) + name[:30].encode("utf-16-be").ljust(64, b"\0")
    return _form(b"E5B0", _chunk(b"TOC2", b"E5P1" + struct.pack(">IIH", len(body), 12 + 8 + 78, k % 1000) + bytes(64), ">"), _chunk(b"E5P1", body, ">"))


def krz(k: int, name: str) -> bytes:
    label = name.encode()[:15] + b"\0"
    label += b"\0" * (len(label) % 2)
    block = struct.pack(">HHH", 36 << 10 | k % 1024, 20, 2 + len(label)) + label + bytes(8)
    block = struct.pack(">i", -(len(block) + 4)) + block
    return b"PRAM" + struct.pack(">i", 32 + len(block) + 4) + bytes(8) + struct.pack(">i", 354) + bytes(12) + block + bytes(4) + _pcm(k)


def gf1pat(k: int, name: str) -> bytes:
    head = bytearray(129)
    head[:12], head[82], head[83] = b"GF1PATCH110\0", 1, 14
    head[85:87] = struct.pack("<H", 1)
    instrument, layer, sample = bytearray(63), bytearray(47), bytearray(96)
    instrument[22], layer[6] = 1, 1
    data = _pcm(k)
    sample[:7], sample[8:12], sample[20:22], sample[55] = _fixed(name, 7), struct.pack("<I", len(data)), struct.pack("<H", _rate(k)), 1
    return bytes(head + instrument + layer + sample) + data


def albank(k: int, name: str) -> bytes:
    bank, instrument, sound, wave = 8, 24, 44, 60
    return b"B1" + struct.pack(">HI", 1, bank) + struct.pack(">HHIII", 1, 0, _rate(k), 0, instrument) + bytes(14) + struct.pack(">HI", 1, sound) + struct.pack(">IIII", 0, 0, wave, 0) + struct.pack(">IIB3xII", 0, 18, k % 2, 0, 0) + bytes(16)


def bfdlac(k: int, name: str) -> bytes:
    body = b"".join(_chunk(t, b, ">", False) for t, b in ((b"fmt ", struct.pack(">5I", 24, 10, k * 64, _rate(k), 2)), (b"BFDi", name.encode() + b"\0"), (b"Indx", struct.pack(">III", 64, k, 0)), (b"data", _pcm(k))))
    return b"BFDC" + struct.pack(">I", len(body)) + body


def wt(k: int, name: str) -> bytes:
    return b"vawt" + struct.pack("<IHH", 8, k % 30 + 1, 4) + bytes(16 * (k % 30 + 1))


def ncw(k: int, name: str) -> bytes:
    return b"\x01\xa8\x9e\xd6" + bytes(4) + struct.pack("<HHII", 2, 16, _rate(k), k) + bytes(100)


def vag(k: int, name: str) -> bytes:
    return b"VAGp" + struct.pack(">III", 32, 0, 16 * (k % 9)) + struct.pack(">I", _rate(k)) + bytes(12) + _fixed(name, 16) + bytes(16 * (k % 9))


def rx2(k: int, name: str) -> bytes:
    inner = b"SLCL" + b"".join(_chunk(b"SLCE", struct.pack(">II", i, i), ">") for i in range(k % 12))
    return _chunk(b"CAT ", b"REX2" + _chunk(b"CREI", name.encode(), ">") + _chunk(b"CAT ", inner, ">"), ">", False)


def _wide(x: int) -> bytes:
    """A big-endian number in two bytes, or in four or eight where it doesn't go into them."""
    return x.to_bytes(2 if x < 1 << 16 else 4 if x < 1 << 32 else 8, "big")


def smus(k: int, name: str) -> bytes:
    return _form(b"SMUS", _chunk(b"SHDR", _wide(k * 3) + bytes([100, k % 5]), ">"), _chunk(b"NAME", name.encode(), ">"), _chunk(b"TRAK", bytes(4), ">"))


def okt(k: int, name: str) -> bytes:
    return b"OKTASONG" + _chunk(b"CMOD", struct.pack(">4H", k % 2, 0, 1, 0), ">") + _chunk(b"SAMP", _fixed(name, 20) + bytes(12 + 32 * (k % 3)), ">") + _chunk(b"SLEN", _wide(k), ">")


def med(k: int, name: str) -> bytes:
    return b"MMD" + str(k % 4).encode() + struct.pack(">I", 8 + k % 50) + bytes(k % 50)


def fc(k: int, name: str) -> bytes:
    return (b"SMOD" if k % 2 else b"FC14") + struct.pack(">I", k) + bytes(100)


def mod(k: int, name: str) -> bytes:
    heads = b"".join(_fixed(f"s{i}", 22) + struct.pack(">HBBHH", (k % 20 + 1) if i < 2 else 0, 0, 64, 0, 1) for i in range(31))
    return _fixed(name, 20) + heads + bytes([1, 127]) + bytes([0, k % 3] + [0] * 126) + b"M.K." + bytes(1024 * (k % 3 + 1)) + bytes(4 * (k % 20 + 1))


def s3m(k: int, name: str) -> bytes:
    head = bytearray(0x60)
    head[:28], head[0x1C:0x1E], head[0x2C:0x30] = _fixed(name, 28), b"\x1a\x10", b"SCRM"
    head[0x20:0x26] = struct.pack("<HHH", 2, 1, 0)
    head[0x31], head[0x32] = 6, 100 + k % 100
    head[0x40:0x60] = bytes([0, 1] + [255] * 30)
    ins = bytearray(80)
    ins[0], ins[0x10:0x14], ins[0x1C], ins[0x20:0x24], ins[0x30:0x4C] = 1, struct.pack("<I", k), 64, struct.pack("<I", _rate(k)), _fixed(name, 28)
    return bytes(head) + b"\0\xff" + struct.pack("<H", 7) + bytes(12) + bytes(ins)


def xm(k: int, name: str) -> bytes:
    head = b"Extended Module: " + _fixed(name, 20) + b"\x1a" + _fixed("tool", 20) + struct.pack("<HI8H", 0x104, 276, 1, 0, 4, 1, 1, 0, 6, 100 + k % 100) + bytes(256)
    pattern = struct.pack("<IBHH", 9, 0, 64, 4) + bytes(4)
    size = k % 30 + 1
    ins = struct.pack("<I", 263) + _fixed(name, 22) + b"\0" + struct.pack("<HI", 1, 40) + bytes(230)
    return head + pattern + ins + struct.pack("<IIIBbBBb", size, 0, 0, 64, 0, 0, 128, 0) + b"\0" + _fixed("a sample", 22) + bytes(size)


def it(k: int, name: str) -> bytes:
    head = b"IMPM" + _fixed(name, 26) + bytes(2) + struct.pack("<9H", 1, 0, 1, 0, 0x214, 0x200, 0, 0, 0) + bytes([6, 100 + k % 100]) + bytes(192 - 52)
    at = 192 + 1 + 4
    sample = b"IMPS" + bytes(13) + bytes([64, 3, 60]) + _fixed(name, 26) + bytes(2) + struct.pack("<4I", k, 1, 2, _rate(k)) + bytes(8) + struct.pack("<I", at + 80) + bytes(4)
    return head + b"\xff" + struct.pack("<I", at) + sample + bytes(k % 9)


def midi2(k: int, name: str) -> bytes:
    words = [0x00400000, 0x00300000 | 96, 0xD0100000, 50_000_000, 0xF0200000, 0, 0, 0]
    for _ in range(k % 6):
        words += [0x40903C00, 0x80000000, 0x00400000 | 96, 0x40803C00, 0]
    return b"SMF2CLIP" + struct.pack(f">{len(words)}I", *words)


def serum(k: int, name: str) -> bytes:
    return b"XferJson" + bytes(9) + json.dumps({"presetName": name, "product": "Serum2", "tags": ["a", str(k)], "version": k}).encode() + b"\0blob" * (k % 5)


def vital(k: int, name: str) -> bytes:
    return json.dumps({"author": "someone", "preset_name": name, "settings": {f"p{i}": i for i in range(k % 7)}, "synth_version": f"1.{k % 9}"}).encode()


def ni(k: int, name: str) -> bytes:
    text = name.encode()[:31]
    body = b"\x83" + b"\xa4name" + bytes([0xA0 | len(text)]) + text + b"\xa4bank" + b"\xcd" + struct.pack(">H", k % 60000) + b"\xa5types" + b"\x92\xa1a\xa1b"
    return _riff(b"NIKS", _chunk(b"NISI", struct.pack("<I", 1) + body), _chunk(b"PCHK", bytes(4)))


def _ableton(tag: str, k: int, name: str) -> bytes:
    text = f'<?xml version="1.0"?>\n<Ableton MajorVersion="5" MinorVersion="{k}" Creator="Live">\n<{tag}>' + "<AudioTrack Id='1'><Name Value=\"" + name + '"/></AudioTrack>' * 1 + "<MidiTrack/>" * (k % 4) + f"</{tag}></Ableton>"
    return gzip.compress(text.encode(), mtime=0)


def als(k: int, name: str) -> bytes:
    return _ableton("LiveSet", k, name)


def adg(k: int, name: str) -> bytes:
    return _ableton("GroupDevicePreset", k, name)


def adv(k: int, name: str) -> bytes:
    return _ableton("MxDeviceAudioEffect", k, name)


def agr(k: int, name: str) -> bytes:
    return _ableton("Groove", k, name)


def alc(k: int, name: str) -> bytes:
    return _ableton("LiveClip", k, name)


def asd(k: int, name: str) -> bytes:
    n = k % 8 + 2
    return b"\x06I" + struct.pack("<II", n, 0) + struct.pack(f"<{n}I", *(i * (k + 1) for i in range(n))) + b"\x0aWarpMarker" * (k % 3)


def amxd(k: int, name: str) -> bytes:
    body = bytes(k % 9) + json.dumps({"patcher": name}).encode()
    return b"ampf" + struct.pack("<I", 4) + b"aaaa" + b"meta" + struct.pack("<I", 4) + struct.pack("<I", k) + b"ptch" + struct.pack("<I", len(body)) + body


def bitwig(k: int, name: str) -> bytes:
    sized = lambda t: struct.pack(">I", len(t)) + t
    return b"BtWg0003000200" + b"\0\0\0\x01" + sized(b"device_name") + b"\x08" + sized(name.encode()[:60]) + b"\0\0\0\x01" + sized(b"tempo_value") + b"\x07" + struct.pack(">d", 60 + k % 100)


def _zip(**files: bytes | str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for n, body in files.items():
            z.writestr(zipfile.ZipInfo(n.replace("__", "/").replace("_dot_", ".")), body)
    return out.getvalue()


def multisample(k: int, name: str) -> bytes:
    xml = f'<multisample name="{name}"><generator>tool</generator><category>keys</category><creator>someone</creator><sample file="a.wav"><key root="{k % 128}" low="0" high="127"/></sample></multisample>'
    return _zip(multisample_dot_xml=xml, a_dot_wav=_pcm(k))


def xpn(k: int, name: str) -> bytes:
    return _zip(Expansion_dot_xml=f"<expansion><title>{name}</title><manufacturer>maker</manufacturer><version>1.{k}</version></expansion>", kit_dot_xpm="<MPCVObject/>", a_dot_wav=_pcm(k))


def labx(k: int, name: str) -> bytes:
    return _zip(**{f"Engine__User__Bank{k % 5}__{'preset'}": b"22 serialization", "Engine__User__cover_dot_png": b"\x89PNG"})


def mpcpattern(k: int, name: str) -> bytes:
    return json.dumps({"pattern": {"length": 96 * k, "events": [{"type": 2050, "1": 36 + i, "2": 100, "len": 10} for i in range(k % 6)] + [{"type": 1}]}}).encode()


def xpm(k: int, name: str) -> bytes:
    names = "".join(f"<SampleName>s{i % 3}</SampleName>" for i in range(k % 6))
    return f'<?xml version="1.0"?><MPCVObject><Version><File_Version>2.{k % 9}</File_Version></Version><Program type="Drum"><ProgramName>{name}</ProgramName><KeygroupNumKeygroups>{k % 16}</KeygroupNumKeygroups>{names}</Program></MPCVObject>'.encode()


def xtd(k: int, name: str) -> bytes:
    return gzip.compress(f"ACVS\n3.{k % 9}\nTrack\njson\nmacOS\n".encode() + json.dumps({"data": {"name": name, "samples": [{"name": "a"}] * (k % 4)}}).encode(), mtime=0)


def pgm(k: int, name: str) -> bytes:
    pads = bytearray(164 * 64)
    pads[:16], pads[17], pads[18], pads[19] = _fixed(name, 15) + b"\0", k % 100, 0, 127
    return struct.pack("<I", 24 + len(pads)) + b"MPC1000 PGM 1.00" + bytes(4) + bytes(pads)


def snd(k: int, name: str) -> bytes:
    frames = k % 40 + 1
    return b"\x01\x04" + _fixed(name, 16) + b"\0" + bytes([100, 0, k % 2]) + bytes(8) + struct.pack("<I", frames) + bytes(8) + bytes(2 * frames * (1 + k % 2))


def sigmf(k: int, name: str) -> bytes:
    return json.dumps({"global": {"core:datatype": "cf32_le", "core:sample_rate": 1000 * k, "core:version": "1.0.0", "core:author": name}, "captures": [{"core:sample_start": 0, "core:frequency": k}], "annotations": [{}] * (k % 4)}).encode()


def iq(k: int, name: str) -> bytes:
    return b"\x11\x22" * (2 * k % 500) + b"\x11\x22" * 2


def cue(k: int, name: str) -> bytes:
    return f'FILE "{name}.bin" BINARY\n  TRACK 01 MODE2/2352\n    INDEX 01 00:00:00\n  TRACK 02 AUDIO\n    INDEX 00 00:01:00\n    INDEX 01 {k % 60:02d}:10:{k % 75:02d}\n'.encode()


def cdxa(k: int, name: str) -> bytes:
    sector = lambda channel, audio: b"\0" + b"\xff" * 10 + b"\0" + b"\0\2\0\2" + bytes([1, channel, 0x64 if audio else 8, k % 2]) * 2 + bytes(2328)
    return b"".join(sector(i % 2, i < 4) for i in range(6))


def gcm(k: int, name: str) -> bytes:
    names = b"folder\0" + name.encode()[:40] + b"\0"
    entries = struct.pack(">III", 1 << 24, 0, 3) + struct.pack(">III", 1 << 24, 0, 3) + struct.pack(">III", 7, 0x600, k % 64)
    image = bytearray(0x700)
    image[:6], image[0x1C:0x20], image[0x20:0x60] = b"GTEST1", b"\xc2\x33\x9f\x3d", _fixed(name, 64)
    image[0x424:0x42C] = struct.pack(">II", 0x500, len(entries) + len(names))
    image[0x500 : 0x500 + len(entries) + len(names)] = entries + names
    return bytes(image)


def iso(k: int, name: str) -> bytes:
    def record(extent: int, size: int, flags: int, label: bytes) -> bytes:
        n = 33 + len(label)
        return bytes([n + n % 2, 0]) + struct.pack("<I", extent) + struct.pack(">I", extent) + struct.pack("<I", size) + struct.pack(">I", size) + bytes(7) + bytes([flags, 0, 0]) + struct.pack("<HH", 1, 256) + bytes([len(label)]) + label + b"\0" * (n % 2)

    image = bytearray(2048 * 20)
    image[16 * 2048 : 16 * 2048 + 6] = b"\x01CD001"
    image[16 * 2048 + 40 : 16 * 2048 + 72] = _fixed(name, 32)
    root = record(17, 2048, 2, b"\0")
    image[16 * 2048 + 156 : 16 * 2048 + 156 + len(root)] = root
    rows = root + record(17, 2048, 2, b"\1") + record(18, 2048, 2, b"SUB") + record(19, k % 2000, 0, b"A.WAV;1")
    image[17 * 2048 : 17 * 2048 + len(rows)] = rows
    inner = record(18, 2048, 2, b"\0") + record(17, 2048, 2, b"\1") + record(19, 5, 0, b"B.WAV;1")
    image[18 * 2048 : 18 * 2048 + len(inner)] = inner
    return bytes(image)


def adx(k: int, name: str) -> bytes:
    return b"\x80\0" + struct.pack(">H", 32) + bytes([3, 18, 4, 1 + k % 2]) + struct.pack(">IIH", _rate(k), k, 500) + bytes(12) + b"(c)CRI" + bytes(18)


def hps(k: int, name: str) -> bytes:
    return b" HALPST\0" + struct.pack(">II", _rate(k), 1 + k % 2) + bytes(0x70) + struct.pack(">III", 32, 31, 0xFFFFFFFF) + bytes(20 + 32)


def brstm(k: int, name: str) -> bytes:
    head = b"HEAD" + struct.pack(">I", 0x40) + struct.pack(">II", 0x01000000, 24) + bytes(16) + bytes([2, 0, 1 + k % 2, 0]) + struct.pack(">HHII", _rate(k), 0, 0, k) + bytes(20)
    return b"RSTM\xfe\xff\x01\x00" + struct.pack(">IHH", 64 + len(head), 64, 1) + struct.pack(">II", 64, len(head)) + bytes(40) + head


def snesrom(k: int, name: str) -> bytes:
    rom = bytearray(0x8000)
    rom[0x7FC0:0x7FD5] = _fixed(name, 21)
    check = 0x1234 + k % 100
    rom[0x7FDC:0x7FE0] = struct.pack("<HH", check ^ 0xFFFF, check)
    return bytes(rom)


def n64rom(k: int, name: str) -> bytes:
    return b"\x80\x37\x12\x40" + bytes(28) + _fixed(name, 20) + bytes(16)


def wrapped(k: int, name: str) -> bytes:
    return b"ID3\x03\0\0\0\0\0\x0a" + bytes(10) + wav(k, name)


_R = "8000 + 100 * (k % 400)"
_N = "2 * (k % 50 + 1)"
_XML = [("Ableton", "MinorVersion", "k"), ("Ableton", "Creator", "'Live'"), ("Ableton", "AudioTrack", "1")]
_AIFF = [("COMM", "channels", "1 + k % 2"), ("COMM", "frames", "k"), ("COMM", "sample_rate", f"({_R})::DOUBLE"), ("mark0", "position", "k"), ("mark0", "name", "substr(name, 1, 30)"), ("INST", "gain", "-2"), ("comment0", "text", "substr(name, 1, 30)"), ("comment0", "date", "strftime(date '1904-01-01' + (k % 100 + 1)::INT, '%Y-%m-%dT00:00:00')"), ("NAME", "text", "name"), ("APPL", "signature", "'tool'"), ("basc", "beats", "k % 16"), ("SSND", "block_size", "0")]

#: Format id: end of the name, builder, what must be found.
SPECIMENS = {
    "wav": (".wav", wav, [("fmt ", "sample_rate", _R), ("data", "frames", "k"), ("fact", "sample_length", "k"), ("acid", "num_beats", "k % 16"), ("acid", "tempo", "'100.0'"), ("smpl", "midi_unity_note", "k % 128"), ("loop0", "start", "k % 10"), ("loop0", "end", "k % 10 + 5"), ("inst", "detune", "-3"), ("cue1", "sample", "k + 7"), ("bext", "description", "name"), ("bext", "time_reference", "k * 1000"), ("bext", "coding_history", "'A=PCM'"), ("cart", "title", "name"), ("iXML", "SCENE", "k"), ("BWBM", "count", "k"), ("LIST", "INAM", "name")]),
    "rf64": (".wav", rf64, [("ds64", "sample_count", "k % 50 + 1"), ("fmt ", "sample_rate", _R), ("data", "frames", "k % 50 + 1")]),
    "aiff": (".aif", aiff, _AIFF),
    "aifc": (".aifc", aifc, [*_AIFF, ("COMM", "compression", "'sowt'"), ("COMM", "compression_name", "'swap'")]),
    "8svx": (".8svx", svx, [("VHDR", "sample_rate", _R), ("VHDR", "one_shot", "k"), ("NAME", "text", "name")]),
    "flac": (".flac", flac, [("STREAMINFO", "sample_rate", _R), ("STREAMINFO", "channels", "k % 2 + 1"), ("STREAMINFO", "total_samples", "k * 10"), ("SEEKTABLE", "points", "k % 4"), ("VORBIS_COMMENT", "TITLE", "name"), ("VORBIS_COMMENT", "TRACKNUMBER", "k"), ("CUESHEET", "lead_in", "k"), ("PICTURE", "width", "k % 500"), ("PICTURE", "mime", "'image/png'"), ("APPLICATION", "application", "'riff'"), ("PADDING", "last", "1")]),
    "midi": (".mid", midi, [("MThd", "division", "96 + k % 5"), ("MTrk", "name", "name"), ("MTrk", "notes", "k % 9"), ("MTrk", "ticks", "96 * (k % 9)"), ("MTrk", "metre", "'3/4'"), ("MTrk", "key_signature", "2")]),
    "rmid": (".rmi", rmid, [("MThd", "division", "96 + k % 5"), ("MTrk", "notes", "k % 9"), ("LIST", "INAM", "name")]),
    "ogg": (".ogg", ogg, [("ident", "codec", "CASE WHEN k % 2 = 1 THEN 'opus' ELSE 'vorbis' END"), ("ident", "channels", "2"), ("ident", "sample_rate", f"CASE WHEN k % 2 = 1 THEN 48000 ELSE {_R} END"), ("tags", "TITLE", "name")]),
    "mp4": (".m4a", mp4, [("mvhd", "duration", "k"), ("stsd", "codec", "'mp4a'"), ("stsd", "channels", "1 + k % 2"), ("stsd", "sample_rate", _R), ("stco", "first", "k"), ("stsz", "total", "k + 5"), ("hex:a96e616d", "title", "name"), ("tmpo", "bpm", "60 + k % 100")]),
    "mp3": (".mp3", mp3, [("TIT2", "text", "name"), ("TBPM", "text", "60 + k % 100"), ("TCON", "text", "'Hip-Hop'"), ("TXXX", "text", "'calm'"), ("COMM", "text", "'a comment'"), ("APIC", "mime", "'image/png'"), ("frames", "frames", "k % 7 + 2"), ("frames", "vbr_frames", "k"), ("frames", "sample_rate", "44100"), ("ID3v1", "title", "substr(name, 1, 30)"), ("ID3v1", "album", "'an album'")]),
    "sf2": (".sf2", sf2, [("ifil", "version", "'2.04'"), ("INAM", "text", "name"), ("phdr", "records", "1"), ("preset0", "preset", "k % 128"), ("preset0", "bank", "k % 3"), ("sample0", "name", "substr(name, 1, 20)"), ("sample0", "end", "k + 8"), ("sample0", "sample_rate", _R), ("sample0", "correction", "-3")]),
    "fxp": (".fxp", fxp, [("CcnK", "preset_name", "substr(name, 1, 28)"), ("CcnK", "plugin_version", "k"), ("CcnK", "num_params", "k % 64")]),
    "akp": (".akp", akp, [("prg ", "midi_program", "k % 128"), ("kgrp", "low_note", "k % 60"), ("kgrp", "high_note", "60 + k % 60"), ("kgrp", "zone0", "substr(name, 1, 20)")]),
    "e4b": (".e4b", e4b, [("TOC1", "entries", "1"), ("E4P1", "index", "k % 1000"), ("E4P1", "name", "substr(name, 1, 16)")]),
    "e5b": (".exb", e5b, [("TOC2", "entries", "1"), ("E5P1", "index", "k % 1000"), ("E5P1", "name", "substr(name, 1, 30)")]),
    "krz": (".krz", krz, [("PRAM", "software_version", "354"), ("Program", "id", "k % 1024"), ("Program", "name", "substr(name, 1, 15)"), ("PCM", "samples", "k % 50 + 1")]),
    "gf1pat": (".pat", gf1pat, [("GF1", "voices", "14"), ("smp", "name", "substr(name, 1, 7)"), ("smp", "sample_rate", _R), ("smp", "bits", "16")]),
    "albank": (".ctl", albank, [("ALBank0", "sample_rate", _R), ("ALBank0", "vadpcm", "1 - k % 2"), ("ALBank0", "raw16", "k % 2")]),
    "bfdlac": (".bfdlac", bfdlac, [("fmt ", "sample_rate", _R), ("fmt ", "num_samples", "k * 64"), ("BFDi", "pack_id", "name"), ("Indx", "frame_count", "k")]),
    "wt": (".wt", wt, [("vawt", "frame_samples", "8"), ("vawt", "frame_count", "k % 30 + 1")]),
    "ncw": (".ncw", ncw, [("NCW", "sample_rate", _R), ("NCW", "num_samples", "k")]),
    "vag": (".vag", vag, [("VAGp", "name", "substr(name, 1, 16)"), ("VAGp", "sample_rate", _R), ("data", "blocks", "k % 9")]),
    "rx2": (".rx2", rx2, [("CAT ", "slices", "k % 12"), ("CREI", "text", "name")]),
    "smus": (".smus", smus, [("SHDR", "tempo", "k * 3"), ("SHDR", "tracks", "k % 5"), ("NAME", "text", "name")]),
    "okt": (".okt", okt, [("CMOD", "voices", "5 + k % 2"), ("SAMP", "samples", "1 + k % 3"), ("SAMP", "first_sample", "substr(name, 1, 20)"), ("SLEN", "value", "k")]),
    "med": (".med", med, [("MMD0", "modlen", "CASE WHEN k % 4 = 0 THEN 8 + k % 50 END"), ("MMD1", "modlen", "CASE WHEN k % 4 = 1 THEN 8 + k % 50 END")]),
    "fc": (".fc", fc, [("SMOD", "seq_length", "CASE WHEN k % 2 = 1 THEN k END"), ("FC14", "version", "CASE WHEN k % 2 = 0 THEN '1.4' END")]),
    "mod": (".mod", mod, [("MOD", "title", "substr(name, 1, 20)"), ("MOD", "patterns", "k % 3 + 1"), ("MOD", "channels", "4"), ("smp1", "name", "'s0'"), ("smp2", "volume", "64")]),
    "s3m": (".s3m", s3m, [("SCRM", "title", "substr(name, 1, 28)"), ("SCRM", "tempo", "100 + k % 100"), ("SCRM", "channels", "2"), ("ins1", "length", "k"), ("ins1", "c2spd", _R), ("ins1", "name", "substr(name, 1, 28)")]),
    "xm": (".xm", xm, [("XM", "title", "substr(name, 1, 20)"), ("XM", "bpm", "100 + k % 100"), ("pat0", "rows", "64"), ("ins1", "samples", "1"), ("smp1.1", "name", "'a sample'"), ("smp1.1", "volume", "64")]),
    "it": (".it", it, [("IMPM", "title", "substr(name, 1, 26)"), ("IMPM", "tempo", "100 + k % 100"), ("smp1", "length", "k"), ("smp1", "c5speed", _R), ("smp1", "name", "substr(name, 1, 26)"), ("smp1", "bits", "16")]),
    "midi2": (".midi2", midi2, [("clip", "resolution", "96"), ("clip", "tempo_10ns", "50000000"), ("clip", "ticks", "96 * (k % 6)"), ("clip", "notes", "2 * (k % 6)")]),
    "serum": (".serumpreset", serum, [("json", "presetName", "name"), ("json", "tags", "'a, ' || k"), ("json", "version", "k")]),
    "vital": (".vital", vital, [("vital", "preset_name", "name"), ("vital", "settings", "k % 7"), ("vital", "synth_version", "'1.' || k % 9")]),
    "ni": (".nksf", ni, [("NISI", "name", "substr(name, 1, 31)"), ("NISI", "bank", "k % 60000"), ("NISI", "types", "'a, b'")]),
    "als": (".als", als, _XML), "adg": (".adg", adg, _XML), "adv": (".adv", adv, _XML), "agr": (".agr", agr, _XML), "alc": (".alc", alc, _XML),
    "asd": (".asd", asd, [("asd", "entries", "k % 8 + 2"), ("asd", "last_frame", "(k % 8 + 1) * (k + 1)"), ("asd", "largest_step", "k + 1"), ("body", "warp_markers", "k % 3")]),
    "amxd": (".amxd", amxd, [("ampf", "version", "4"), ("ptch", "json_at", "k % 9")]),
    "bitwig": (".bwpreset", bitwig, [("BtWg", "version", "'0003000200'"), ("meta", "device_name", "substr(name, 1, 60)"), ("meta", "tempo_value", "(60 + k % 100)::DOUBLE")]),
    "multisample": (".multisample", multisample, [("multisample.xml", "name", "name"), ("multisample.xml", "zones", "1"), ("multisample.xml", "category", "'keys'"), ("zone", "root", "k % 128")]),
    "xpn": (".xpn", xpn, [("expansion", "title", "name"), ("expansion", "version", "'1.' || k"), ("expansion", "programs", "1"), ("program", "stored", "1")]),
    "labx": (".labx", labx, [("bank", "bank_name", "'Bank' || k % 5"), ("bank", "engines", "'Engine 2'")]),
    "mpcpattern": (".mpcpattern", mpcpattern, [("pattern", "length", "96 * k"), ("pattern", "events", "k % 6 + 1"), ("pattern", "notes", "k % 6"), ("pattern", "schema", "'MPC2'")]),
    "xpm": (".xpm", xpm, [("program", "program_name", "name"), ("program", "keygroups", "k % 16"), ("program", "referenced_samples", "least(k % 6, 3)")]),
    "xtd": (".xtd", xtd, [("xtd", "name", "name"), ("xtd", "samples", "k % 4"), ("xtd", "platform", "'macOS'")]),
    "pgm": (".pgm", pgm, [("PGM", "program_type", "'MPC1000'"), ("pad0", "layer0", "substr(name, 1, 15)"), ("pad0", "level", "k % 100")]),
    "snd": (".snd", snd, [("SND", "name", "substr(name, 1, 16)"), ("SND", "frames", "k % 40 + 1"), ("SND", "channels", "1 + k % 2")]),
    "sigmf": (".sigmf-meta", sigmf, [("global", "datatype", "'cf32_le'"), ("global", "sample_rate", "1000 * k"), ("global", "author", "name"), ("global", "sample_bytes", "8"), ("capture0", "frequency", "k"), ("annotations", "count", "k % 4")]),
    "iq": (".cs16", iq, [("samples", "samples", "(2 * k % 500) // 2 + 1"), ("samples", "bits", "16")]),
    "cue": (".cue", cue, [("track2", "start_lba", "(k % 60) * 4500 + 750 + k % 75"), ("track2", "type", "'AUDIO'"), ("track2", "file", "name || '.bin'")]),
    "cdxa": (".bin", cdxa, [("xa1.0", "sectors", "2"), ("xa1.1", "channels", "1 + k % 2"), ("xa1.1", "sample_rate", "37800")]),
    "gcm": (".gcm", gcm, [("GCM", "title", "name"), ("file", "path", "'/folder/' || substr(name, 1, 40)")]),
    "adx": (".adx", adx, [("ADX", "sample_rate", _R), ("ADX", "channels", "1 + k % 2"), ("ADX", "samples", "k")]),
    "hps": (".hps", hps, [("HALPST", "sample_rate", _R), ("HALPST", "channels", "1 + k % 2")]),
    "brstm": (".brstm", brstm, [("HEAD", "sample_rate", _R), ("HEAD", "channels", "1 + k % 2"), ("HEAD", "samples", "k")]),
    "snesrom": (".sfc", snesrom, [("header", "title", "substr(name, 1, 21)"), ("header", "checksum", "4660 + k % 100")]),
    "n64rom": (".z64", n64rom, [("ROM", "title", "substr(name, 1, 20)"), ("ROM", "layout", "'z64'")]),
    "id3-wrapped": (".wav", wrapped, [("fmt ", "sample_rate", _R), ("LIST", "INAM", "name")]),
    "iso": (".iso", iso, [("volume", "name", "substr(name, 1, 32)")]),
}


#: Parts a core that rows are dealt to, and bytes of contents after which a batch of files is handed on.
PARTS, BATCH_BYTES = 3, 4 << 20


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt to all cores by their keys: a table of names is small enough to be read in one part, but what is made of it isn't."""
    return rows.repartition(PARTS * rows.sparkSession.sparkContext.defaultParallelism, key)


def _filled(rows: DataFrame, key: str, name: str, schema: str, make: Callable[[int, str], Iterator[tuple]]) -> DataFrame:
    """Rows that ``make`` yields of each number and name, their contents last, in batches bounded by the contents' bytes."""
    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for k, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for row in make(k, n):
                    held.append(row)
                    size += len(row[-1])
                if size >= BATCH_BYTES or len(held) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*held, strict=True), arrow, strict=True)], schema=arrow)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*held, strict=True), arrow, strict=True)], schema=arrow)

    return spread(rows.select(F.col(key).cast("bigint").alias("k"), F.col(name).alias("name")), "k").mapInArrow(run, schema)


def files(rows: DataFrame, kind: str, key: str, name: str) -> DataFrame:
    """``path``, ``k`` and ``content``: a file of the format for each row."""
    end, build, _ = SPECIMENS[kind]
    return _filled(rows, key, name, "path string, k bigint, content binary", lambda k, n: iter([(f"/{kind}/{k}{end}", k, build(k, n))]))


def files_of(rows: DataFrame, kinds: list[str], key: str, name: str) -> DataFrame:
    """``kind``, ``k`` and ``content``: a file of each of the formats for each row, all of them in one pass."""
    builders = [(kind, SPECIMENS[kind][1]) for kind in kinds]
    return _filled(rows, key, name, "kind string, k bigint, content binary", lambda k, n: ((kind, k, build(k, n)) for kind, build in builders))


def built(rows: DataFrame, key: str, name: str, build: Callable[[int, str], bytes]) -> DataFrame:
    """``k`` and ``content``: what ``build`` makes of each row's number and name."""
    return _filled(rows, key, name, "k bigint, content binary", lambda k, n: iter([(k, build(k, n))]))
