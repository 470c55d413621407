"""Parsers of audio containers: WAV and its kin, AIFF, 8SVX, FLAC, Ogg, MPEG, MP4, MIDI and SoundFonts."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

from tessera.functions.bytes import mac_text
from tessera.functions.sniffing import mpeg_header
from tessera.sources.chunks import Chunk, Table, fields_of, iff, number, printable, text_of

#: Fields of chunks by offset.
WAV_FIELDS: dict[bytes, Table] = {
    b"fmt ": [("format_tag", 0, "<H"), ("channels", 2, "<H"), ("sample_rate", 4, "<I"), ("avg_bytes_per_sec", 8, "<I"), ("block_align", 12, "<H"), ("bits_per_sample", 14, "<H")],
    b"fact": [("sample_length", 0, "<I")],
    b"acid": [("flags", 0, "<I"), ("root_note", 4, "<H"), ("num_beats", 12, "<I"), ("meter_denominator", 16, "<H"), ("meter_numerator", 18, "<H"), ("tempo", 20, "<f")],
    b"smpl": [(n, 4 * i, "<I") for i, n in enumerate(("manufacturer", "product", "sample_period", "midi_unity_note", "pitch_fraction", "smpte_format", "smpte_offset", "num_sample_loops", "sampler_data"))],
    b"inst": [("base_note", 0, "<B"), ("detune", 1, "<b"), ("gain", 2, "<b"), ("low_note", 3, "<B"), ("high_note", 4, "<B"), ("low_velocity", 5, "<B"), ("high_velocity", 6, "<B")],
    b"cue ": [("count", 0, "<I")],
    b"bext": [("time_reference", 338, "<Q"), ("version", 346, "<H")],
}
#: Texts of bext and cart by offset and length, and ID3's genres that number 0 to 9 stand for.
BEXT = [("description", 0, 256), ("originator", 256, 32), ("originator_reference", 288, 32), ("origination_date", 320, 10), ("origination_time", 330, 8)]
CART = [("version", 0, 4), ("title", 4, 64), ("artist", 68, 64), ("cut_id", 132, 64), ("client_id", 196, 64), ("category", 260, 64)]
GENRES = ["Blues", "Classic Rock", "Country", "Dance", "Disco", "Funk", "Grunge", "Hip-Hop", "Jazz", "Metal"]


def riff_list(payload: bytes) -> dict[str, object]:
    """A LIST's kind, and the texts of an INFO list or the labels of an associated data list."""
    out: dict[str, object] = {"list_type": printable(payload[:4])}
    for tag, at, size, _, _ in iff(payload, "little", 4):
        body = payload[at + 8 : at + 8 + size]
        if payload[:4] == b"INFO":
            out[tag] = text_of(body)
        elif tag in ("labl", "note") and len(body) >= 4:
            out[f"{tag}{number(body, 0, 4, 'little')}"] = text_of(body[4:])
    return out


def wav(data: bytes, sizes: dict[int, int] | None = None, whole: int | None = None) -> Iterator[Chunk]:
    claimed = whole if whole is not None else number(data, 4, 4, "little")
    if claimed is not None and claimed + 8 != len(data):
        yield printable(data[:4]), 0, claimed, {}, f"RIFF size {claimed} + 8 is not the file's {len(data)}"
    frame, rate, declared, frames = 0, 0, None, None
    for tag, at, size, decoded, warning in iff(data, "little", fields=WAV_FIELDS, sizes=sizes):
        payload = data[at + 8 : at + 8 + size]
        extra: list[Chunk] = []
        if tag == "fmt ":
            frame, rate = decoded.get("block_align") or 0, decoded.get("sample_rate") or 0
            if decoded.get("format_tag") == 1 and len(decoded) == 6:
                if frame != decoded["channels"] * decoded["bits_per_sample"] // 8:
                    warning = warning or f"block align {frame} is not channels times bytes a sample"
                elif decoded["avg_bytes_per_sec"] != rate * frame:
                    warning = warning or f"{decoded['avg_bytes_per_sec']} bytes a second are not rate times block align"
            if rate and not 1000 <= rate <= 768_000:
                warning = warning or f"sample rate {rate} is implausible"
        elif tag == "fact":
            declared = decoded.get("sample_length")
            if declared == 0xFFFFFFFF:
                declared = None
        elif tag == "data":
            there = min(size, max(0, len(data) - at - 8))
            frames = declared if declared is not None and warning is None else (there // frame if frame else None)
            decoded = {"frames": frames, "duration": round(frames / rate, 6) if frames is not None and rate else None}
            warning = warning or ("data chunk is empty" if not size else None)
        elif tag == "smpl":
            room, count = max(0, size - 36) // 24, decoded.get("num_sample_loops") or 0
            if count > room:
                warning = warning or f"{count} loops claimed, room for {room}"
            loops: Table = [("id", 0, "<I"), ("type", 4, "<I"), ("start", 8, "<I"), ("end", 12, "<I"), ("fraction", 16, "<I"), ("play_count", 20, "<I")]
            for i in range(min(count, room)):
                loop = fields_of(loops, payload[36 + 24 * i : 60 + 24 * i])
                if len(loop) == 6:
                    extra.append((f"loop{i}", at + 44 + 24 * i, 24, loop, "loop ends before it starts" if loop["end"] < loop["start"] else None))
        elif tag == "cue ":
            room, count = max(0, size - 4) // 24, decoded.get("count") or 0
            if count > room:
                warning = warning or f"{count} cues claimed, room for {room}"
            for i in range(min(count, room)):
                point = fields_of([("id", 0, "<I"), ("position", 4, "<I"), ("chunk_start", 12, "<I"), ("block_start", 16, "<I"), ("sample", 20, "<I")], payload[4 + 24 * i : 28 + 24 * i])
                extra.append((f"cue{i}", at + 12 + 24 * i, 24, point, None))
        elif tag == "bext":
            decoded |= {name: text_of(payload[a : a + n]) for name, a, n in BEXT}
            decoded["coding_history"] = text_of(payload[602:])
        elif tag == "cart":
            decoded |= {name: text_of(payload[a : a + n]) for name, a, n in CART}
        elif tag == "iXML":
            text = payload.decode("utf-8", "replace")
            decoded |= {k: v.strip() for k, v in re.findall(r"<(PROJECT|SCENE|TAKE|TAPE|NOTE|FILE_UID)>([^<]*)</", text)}
        elif tag == "BWBM":
            decoded |= fields_of([("version", 0, "<I"), ("count", 4, "<I")], payload)
        elif tag == "LIST":
            decoded = riff_list(payload)
        elif tag == "acid" and decoded.get("tempo") is not None and not 40 <= decoded["tempo"] <= 300:
            warning = warning or f"tempo {decoded['tempo']:g} is implausible"
        yield tag, at, size, decoded, warning
        yield from extra


def rf64(data: bytes) -> Iterator[Chunk]:
    """RF64: the first chunk holds 64-bit sizes of the file, of data, and of listed chunks."""
    whole, sizes, samples = None, {}, None
    size = number(data, 16, 4, "little") or 0
    if data[12:16] == b"ds64":
        whole, in_data, samples = (number(data, 20 + 8 * i, 8, "little") for i in range(3))
        listed = {data[48 + 12 * i : 52 + 12 * i]: number(data, 52 + 12 * i, 8, "little") for i in range(min(number(data, 44, 4, "little") or 0, max(0, min(size, len(data) - 20) - 28) // 12))}
        listed[b"data"] = in_data
        at = 12
        while at + 8 <= len(data):
            tag, n = data[at : at + 4], number(data, at + 4, 4, "little")
            if n == 0xFFFFFFFF and listed.get(tag) is not None:
                sizes[at] = n = listed[tag]
            at += 8 + n + n % 2
    for tag, at, n, decoded, warning in wav(data, sizes, whole):
        if tag == "ds64":
            decoded = {"riff_size": whole, "data_size": number(data, 28, 8, "little"), "sample_count": samples}
        yield tag, at, n, decoded, warning


def rmid(data: bytes) -> Iterator[Chunk]:
    for tag, at, size, decoded, warning in iff(data, "little"):
        payload = data[at + 8 : at + 8 + size]
        yield tag, at, size, riff_list(payload) if tag == "LIST" else decoded, warning
        if tag == "data":
            for sub, start, n, inner, trouble in midi(payload):
                yield sub, at + 8 + start, n, inner, trouble


def float80(raw: bytes) -> float:
    """Big-endian extended float; 0 where it isn't a number."""
    if len(raw) < 10:
        return 0.0
    top, mantissa = struct.unpack(">HQ", raw[:10])
    exponent = top & 0x7FFF
    if exponent == 0x7FFF or exponent - 16446 > 900:
        return 0.0
    return (-1.0 if top >> 15 else 1.0) * mantissa * 2.0 ** (exponent - 16446)


def pstring(raw: bytes) -> str:
    return raw[1 : 1 + raw[0]].decode("latin-1") if raw else ""


def aiff(data: bytes) -> Iterator[Chunk]:
    table = {
        b"COMM": [("channels", 0, ">h"), ("frames", 2, ">I"), ("bits_per_sample", 6, ">h")], b"SSND": [("data_offset", 0, ">I"), ("block_size", 4, ">I")], b"FVER": [("timestamp", 0, ">I")],
        b"INST": [("base_note", 0, ">b"), ("detune", 1, ">b"), ("low_note", 2, ">b"), ("high_note", 3, ">b"), ("low_velocity", 4, ">b"), ("high_velocity", 5, ">b"), ("gain", 6, ">h"), ("sustain_mode", 8, ">h"), ("sustain_begin", 10, ">h"), ("sustain_end", 12, ">h")],
        b"basc": [("version", 0, ">I"), ("beats", 4, ">I"), ("root_note", 8, ">H"), ("scale", 10, ">H"), ("numerator", 12, ">H"), ("denominator", 14, ">H")],
    }
    for tag, at, size, decoded, warning in iff(data, "big", fields=table):
        payload = data[at + 8 : at + 8 + size]
        extra: list[Chunk] = []
        if tag == "COMM":
            rate = float80(payload[8:18])
            decoded |= {"sample_rate": rate, "duration": round(decoded.get("frames", 0) / rate, 4) if rate else None}
            if data[8:12] == b"AIFC" and len(payload) >= 22:
                decoded |= {"compression": text_of(payload[18:22]), "compression_name": pstring(payload[22:])}
        elif tag == "MARK":
            decoded["count"] = number(payload, 0, 2, "big")
            start = 2
            for i in range(decoded["count"] or 0):
                if start + 7 > len(payload):
                    warning = warning or "markers are cut off"
                    break
                length = payload[start + 6]
                extra.append((f"mark{i}", at + 8 + start, 7 + length, {"id": number(payload, start, 2, "big"), "position": number(payload, start + 2, 4, "big"), "name": pstring(payload[start + 6 :])}, None))
                start += 7 + length + (length + 1) % 2
        elif tag == "COMT":
            start, decoded["count"] = 2, number(payload, 0, 2, "big")
            for i in range(decoded["count"] or 0):
                length = number(payload, start + 6, 2, "big")
                if length is None:
                    break
                extra.append((f"comment{i}", at + 8 + start, 8 + length, {"date": mac_text(number(payload, start, 4, "big")), "text": text_of(payload[start + 8 : start + 8 + length])}, None))
                start += 8 + length + length % 2
        elif tag in ("NAME", "AUTH", "(c) ", "ANNO"):
            decoded["text"] = text_of(payload)
        elif tag == "APPL":
            decoded["signature"] = text_of(payload[:4])
        elif tag == "AESD":
            decoded["status"] = payload[:24].hex()
        elif tag == "ID3 ":
            extra = [(i, at + 8 + o, n, f, w) for i, o, n, f, w in id3v2(payload)]
        yield tag, at, size, decoded, warning
        yield from extra


def svx(data: bytes) -> Iterator[Chunk]:
    table = {b"VHDR": [("one_shot", 0, ">I"), ("repeat", 4, ">I"), ("samples_per_cycle", 8, ">I"), ("sample_rate", 12, ">H"), ("octaves", 14, ">B"), ("compression", 15, ">B"), ("volume", 16, ">I")], b"CHAN": [("channels", 0, ">I")]}
    for tag, at, size, decoded, warning in iff(data, "big", fields=table):
        if tag in ("NAME", "AUTH", "(c) ", "ANNO"):
            decoded["text"] = text_of(data[at + 8 : at + 8 + size])
        yield tag, at, size, decoded, warning


#: Names of FLAC metadata blocks.
FLAC_BLOCKS = ["STREAMINFO", "PADDING", "APPLICATION", "SEEKTABLE", "VORBIS_COMMENT", "CUESHEET", "PICTURE"]


def picture(payload: bytes) -> dict[str, object]:
    """A FLAC picture: kind, type, description, size and where its bytes begin."""
    be = lambda at: number(payload, at, 4, "big") or 0
    mime = be(4)
    text = be(8 + mime)
    at = 12 + mime + text
    return {"picture_type": be(0), "mime": text_of(payload[8 : 8 + mime]), "description": payload[12 + mime : at].decode("utf-8", "replace"), "width": be(at), "height": be(at + 4), "depth": be(at + 8), "bytes": be(at + 16), "data_at": at + 20}


def flac(data: bytes) -> Iterator[Chunk]:
    at = 4
    while at + 4 <= len(data):
        head, size = data[at], number(data, at + 1, 3, "big")
        kind, payload = head & 127, data[at + 4 : at + 4 + size]
        decoded: dict[str, object] = {"last": int(head >> 7)}
        warning = "block goes beyond the file" if at + 4 + size > len(data) else None
        if kind == 0 and len(payload) >= 34:
            packed = int.from_bytes(payload[10:18], "big")
            decoded |= {"min_block": number(payload, 0, 2, "big"), "max_block": number(payload, 2, 2, "big"), "min_frame": number(payload, 4, 3, "big"), "max_frame": number(payload, 7, 3, "big"), "sample_rate": packed >> 44, "channels": (packed >> 41 & 7) + 1, "bits_per_sample": (packed >> 36 & 31) + 1, "total_samples": packed & (1 << 36) - 1, "md5": payload[18:34].hex()}
            if decoded["min_block"] > decoded["max_block"]:
                warning = warning or "smallest block is above the largest"
        elif kind == 2:
            decoded["application"] = text_of(payload[:4])
        elif kind == 3:
            decoded["points"] = size // 18
        elif kind == 4:
            decoded |= comments(payload)
        elif kind == 5:
            decoded |= {"catalog": text_of(payload[:128]), "lead_in": number(payload, 128, 8, "big"), "tracks": payload[395] if len(payload) > 395 else None}
        elif kind == 6:
            decoded |= picture(payload)
        yield FLAC_BLOCKS[kind] if kind < len(FLAC_BLOCKS) else f"BLOCK_{kind}", at, size, decoded, warning
        at += 4 + size
        if head >> 7:
            break
    if at < len(data):
        yield "frames", at, len(data) - at, {}, None if data[at : at + 2] in (b"\xff\xf8", b"\xff\xf9") else "no frame sync after the metadata"


def comments(payload: bytes) -> dict[str, str]:
    """Vorbis comments: keys in capitals, the first value of each; the vendor as VENDOR. More than 10,000 aren't read, which is told."""
    out: dict[str, str] = {}
    n = number(payload, 0, 4, "little")
    if n is None:
        return out
    out["VENDOR"] = payload[4 : 4 + n].decode("utf-8", "replace")
    at = 4 + n
    count = number(payload, at, 4, "little") or 0
    at += 4
    for _ in range(min(count, 10_000)):
        n = number(payload, at, 4, "little")
        if n is None or at + 4 + n > len(payload):
            break
        key, eq, value = payload[at + 4 : at + 4 + n].decode("utf-8", "replace").partition("=")
        if eq:
            out.setdefault(key.upper(), value)
        at += 4 + n
    if count > 10_000:
        out["NOT READ"] = str(count - 10_000)
    return out


def vlq(data: bytes, at: int) -> tuple[int, int]:
    """A variable-length quantity and where it ends."""
    value = 0
    for _ in range(4):
        if at >= len(data):
            break
        b = data[at]
        at += 1
        value = value << 7 | b & 127
        if b < 128:
            break
    return value, at


def midi(data: bytes) -> Iterator[Chunk]:
    at = 0
    while at + 8 <= len(data):
        tag, size = data[at : at + 4], number(data, at + 4, 4, "big")
        payload = data[at + 8 : at + 8 + size]
        decoded: dict[str, object] = {}
        if tag == b"MThd":
            decoded = fields_of([("format", 0, ">H"), ("tracks", 2, ">H"), ("division", 4, ">H")], payload)
        elif tag == b"MTrk":
            decoded = track(payload)
        yield printable(tag), at, size, decoded, "track goes beyond the file" if at + 8 + size > len(data) else None
        at += 8 + size


def track_events(payload: bytes) -> Iterator[tuple[int, int, int, bytes]]:
    """(ticks, status, type of a meta event or 0, its bytes) of each event; running status is resolved."""
    at, ticks, status = 0, 0, 0
    while at < len(payload):
        delta, at = vlq(payload, at)
        ticks += delta
        if at >= len(payload):
            return
        if payload[at] >= 128:
            status = payload[at]
            at += 1
        kind = 0
        if status == 0xFF:
            kind = payload[at] if at < len(payload) else 0
            n, at = vlq(payload, at + 1)
        elif status in (0xF0, 0xF7):
            n, at = vlq(payload, at)
        else:
            n = 1 if status & 0xF0 in (0xC0, 0xD0) else 2
        yield ticks, status, kind, payload[at : at + n]
        at += n
        if status == 0xFF and kind == 0x2F:
            return


def track(payload: bytes) -> dict[str, object]:
    """Counts of a track's events, its name, its first tempo, metre and key, and its length in ticks."""
    out: dict[str, object] = {"events": 0, "notes": 0, "ticks": 0, "tempo": None}
    for ticks, status, kind, body in track_events(payload):
        out["events"] += 1
        out["ticks"] = ticks
        if status == 0xFF:
            if kind == 0x51 and len(body) == 3 and out["tempo"] is None:
                out["tempo"] = round(60e6 / max(1, int.from_bytes(body, "big")), 3)
            elif kind == 0x03:
                out.setdefault("name", body.decode("latin-1"))
            elif kind == 0x58 and len(body) >= 2:
                out.setdefault("metre", f"{body[0]}/{1 << min(body[1], 16)}")
            elif kind == 0x59 and len(body) == 2:
                out.setdefault("key_signature", struct.unpack("b", body[:1])[0])
        elif status & 0xF0 == 0x90 and len(body) == 2 and body[1]:
            out["notes"] += 1
    return out


def ogg(data: bytes) -> Iterator[Chunk]:
    """Pages; the first packets of each stream tell its codec and tags."""
    at, packets, serials = 0, {}, {}
    while at + 27 <= len(data) and data[at : at + 4] == b"OggS":
        segments = data[at + 26]
        lacing = data[at + 27 : at + 27 + segments]
        size = 27 + segments + sum(lacing)
        serial = number(data, at + 14, 4, "little")
        yield "OggS", at, size, {"flags": data[at + 5], "granule": struct.unpack_from("<q", data, at + 6)[0], "serial": serial, "sequence": number(data, at + 18, 4, "little")}, "page goes beyond the file" if at + size > len(data) else None
        place = at + 27 + segments
        done = serials.setdefault(serial, [])
        for n in lacing:
            if len(done) < 2:
                packets[serial] = packets.get(serial, b"") + data[place : place + n]
                if n < 255:
                    done.append((at, packets.pop(serial)))
            place += n
        at += size
    for serial, found in serials.items():
        for start, packet in found:
            if packet[:7] == b"\x01vorbis":
                yield "ident", start, len(packet), {"serial": serial, "codec": "vorbis"} | fields_of([("channels", 11, "<B"), ("sample_rate", 12, "<I")], packet), None
            elif packet[:8] == b"OpusHead":
                yield "ident", start, len(packet), {"serial": serial, "codec": "opus", "sample_rate": 48000} | fields_of([("channels", 9, "<B"), ("pre_skip", 10, "<H"), ("input_rate", 12, "<I")], packet), None
            elif packet[:7] == b"\x03vorbis" or packet[:8] == b"OpusTags":
                yield "tags", start, len(packet), comments(packet[7 if packet[0] == 3 else 8 :]), None


#: MP4 boxes that hold boxes, and names of iTunes tags.
MP4_PARENTS = (b"moov", b"trak", b"mdia", b"minf", b"stbl", b"udta", b"ilst", b"edts", b"dinf")
ITUNES = {b"\xa9nam": "title", b"\xa9ART": "artist", b"\xa9alb": "album", b"\xa9gen": "genre", b"\xa9day": "year", b"\xa9cmt": "comment", b"tmpo": "bpm"}


def mp4(data: bytes, start: int = 0, end: int | None = None, depth: int = 0) -> Iterator[Chunk]:
    """Boxes with their depth; of movie, sample and tag boxes also the fields. Deeper than 64 nothing is entered, which is told."""
    end = len(data) if end is None else end
    at = start
    while at + 8 <= end:
        size, tag, head = number(data, at, 4, "big"), data[at + 4 : at + 8], 8
        if size == 1:
            size, head = number(data, at + 8, 8, "big") or 0, 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            yield printable(tag), at, size, {"depth": depth}, "box goes beyond its parent"
            return
        body = data[at + head : at + size]
        decoded: dict[str, object] = {"depth": depth}
        if tag == b"ftyp":
            decoded["brand"] = text_of(body[:4])
        elif tag == b"mvhd" and body:
            decoded |= fields_of([("timescale", 12, ">I"), ("duration", 16, ">I")] if body[0] == 0 else [("timescale", 20, ">I"), ("duration", 24, ">Q")], body)
        elif tag == b"stsd":
            decoded |= {"codec": text_of(body[12:16])} | fields_of([("channels", 32, ">H"), ("bits_per_sample", 34, ">H"), ("sample_rate", 40, ">H")], body)
        elif tag in (b"stco", b"co64"):
            decoded |= fields_of([("count", 4, ">I"), ("first", 8, ">I" if tag == b"stco" else ">Q")], body)
        elif tag == b"stsz":
            decoded |= fields_of([("sample_size", 4, ">I"), ("count", 8, ">I")], body)
            count = min(decoded.get("count", 0), max(0, len(body) - 12) // 4)
            decoded["total"] = decoded["sample_size"] * decoded["count"] if decoded.get("sample_size") else sum(struct.unpack_from(f">{count}I", body, 12))
        elif tag in ITUNES and body[4:8] == b"data":
            decoded[ITUNES[tag]] = int.from_bytes(body[16:], "big") if tag == b"tmpo" else body[16:].decode("utf-8", "replace")
        deep = depth >= 64 and (tag in MP4_PARENTS or tag == b"meta")
        yield printable(tag), at, size, decoded, "nested too deeply to go on" if deep else None
        if tag in MP4_PARENTS and not deep:
            yield from mp4(data, at + head, at + size, depth + 1)
        elif tag == b"meta" and not deep:
            yield from mp4(data, at + head + 4, at + size, depth + 1)
        at += size


def synchsafe(raw: bytes) -> int:
    out = 0
    for b in raw:
        out = out << 7 | b & 127
    return out


def id3_text(body: bytes) -> str:
    """The text of a frame: its first byte tells the encoding."""
    kinds = ["latin-1", "utf-16", "utf-16-be", "utf-8"]
    return body[1:].decode(kinds[body[0]] if body and body[0] < 4 else "latin-1", "replace").strip("\0") if body else ""


def id3v2(data: bytes) -> Iterator[Chunk]:
    """The tag's header and its frames."""
    if data[:3] != b"ID3" or len(data) < 10:
        return
    major, size = data[3], synchsafe(data[6:10])
    total = size + 10 + (10 if data[5] & 16 else 0)
    yield "ID3", 0, total, {"version": f"2.{major}.{data[4]}", "flags": data[5]}, "tag goes beyond the file" if total > len(data) else None
    at, end, wide = 10, min(len(data), 10 + size), 3 if major == 2 else 4
    while at + wide * 2 <= end and data[at]:
        tag = data[at : at + wide]
        raw = data[at + wide : at + 2 * wide]
        n = synchsafe(raw) if major == 4 else int.from_bytes(raw, "big")
        head = 6 if major == 2 else 10
        body = data[at + head : at + head + n]
        decoded: dict[str, object] = {}
        if tag[:1] == b"T":
            text = id3_text(body)
            if tag in (b"TXXX", b"TXX"):
                name, _, value = text.partition("\0")
                decoded = {"description": name, "text": value.lstrip("﻿")}
            else:
                if tag in (b"TCON", b"TCO") and (m := re.fullmatch(r"\(?(\d+)\)?", text)) and int(m.group(1)) < len(GENRES):
                    text = GENRES[int(m.group(1))]
                decoded = {"text": text}
        elif tag in (b"COMM", b"COM"):
            decoded = {"language": text_of(body[1:4]), "text": id3_text(body[:1] + body[4:]).split("\0")[-1]}
        elif tag in (b"APIC", b"PIC"):
            mime = body[1:].split(b"\0")[0]
            decoded = {"mime": mime.decode("latin-1"), "picture_type": body[len(mime) + 2] if len(body) > len(mime) + 2 else None, "bytes": len(body)}
        yield printable(tag), at, n, decoded, "frame goes beyond the tag" if at + head + n > end else None
        at += head + n
    if at < end:
        yield "padding", at, end - at, {"nonzero": int(any(data[at:end]))}, None


def xing(frame: bytes) -> dict[str, object]:
    """A first frame's Xing, Info or VBRI header: frames, bytes and the encoder."""
    for magic in (b"Xing", b"Info"):
        if (at := frame.find(magic, 4, 64)) > 0:
            flags = number(frame, at + 4, 4, "big") or 0
            out, place = {"vbr_header": magic.decode()}, at + 8
            for bit, name in ((1, "vbr_frames"), (2, "vbr_bytes")):
                if flags & bit:
                    out[name] = number(frame, place, 4, "big")
                    place += 4
            place += (100 if flags & 4 else 0) + (4 if flags & 8 else 0)
            return out | ({"encoder": text_of(frame[place : place + 9])} if frame[place : place + 4] in (b"LAME", b"Lavf", b"Lavc") else {})
    if frame[36:40] == b"VBRI":
        return {"vbr_header": "VBRI", "vbr_bytes": number(frame, 46, 4, "big"), "vbr_frames": number(frame, 50, 4, "big")}
    return {}


def mpeg_frames(data: bytes, start: int, end: int) -> Iterator[tuple[int, dict[str, int]]]:
    """Frames from ``start`` on by their lengths; where one breaks off, the next place from which two follow each other is sought."""
    at, free = start, 0
    while at + 4 <= end:
        h = mpeg_header(data[at : at + 4], True)
        if h is not None and not h["length"]:
            if not free and (nxt := data.find(data[at : at + 2], at + 24, min(end, at + 4096))) > 0:
                free = nxt - at - h["padding"]
            h = h | {"length": free + h["padding"]} if free else None
        if h is None or h["length"] < 4 or at + h["length"] > end:
            while (at := data.find(b"\xff", at + 1, end)) >= 0:
                h = mpeg_header(data[at : at + 4])
                if h and h["length"] >= 4 and mpeg_header(data[at + h["length"] : at + h["length"] + 4]):
                    break
            if at < 0:
                return
            continue
        yield at, h
        at += h["length"]


def mp3(data: bytes) -> Iterator[Chunk]:
    at = 0
    for row in id3v2(data):
        yield row
        at = row[2] if row[0] == "ID3" else at
    end = len(data) - (128 if data[-128:-125] == b"TAG" else 0)
    first = stop = None
    frames = samples = gaps = 0
    rates = set()
    for place, h in mpeg_frames(data, at, end):
        if first is None:
            first = (place, h)
        elif place != stop:
            gaps += 1
        frames, samples, stop = frames + 1, samples + h["samples"], place + h["length"]
        rates.add(h["bitrate"])
    if first:
        start, h = first
        yield "frames", start, stop - start, h | xing(data[start : start + h["length"]]) | {"frames": frames, "vbr": int(len(rates) > 1), "duration": round(samples / h["sample_rate"], 6)}, f"sync was lost {gaps} times" if gaps else None
    if data[-128:-125] == b"TAG":
        tag = data[-128:]
        yield "ID3v1", len(data) - 128, 128, {"title": text_of(tag[3:33]), "artist": text_of(tag[33:63]), "album": text_of(tag[63:93]), "year": text_of(tag[93:97])}, None


#: Records of a SoundFont's pdta lists and their sizes.
SF2_RECORDS = {"phdr": 38, "pbag": 4, "pmod": 10, "pgen": 4, "inst": 22, "ibag": 4, "imod": 10, "igen": 4, "shdr": 46}


def sf2(data: bytes) -> Iterator[Chunk]:
    """SoundFonts: texts of the INFO list, counts of the pdta records, and each preset and sample."""
    for tag, at, size, decoded, warning in iff(data, "little"):
        kind = data[at + 8 : at + 12]
        yield tag, at, size, decoded, warning
        if tag != "LIST":
            continue
        for sub, start, n, _, trouble in iff(data[: at + 8 + size], "little", at + 12):
            body = data[start + 8 : start + 8 + n]
            fields: dict[str, object] = {}
            rows: list[Chunk] = []
            if kind == b"INFO":
                fields = {"version": f"{number(body, 0, 2, 'little')}.{number(body, 2, 2, 'little'):02d}"} if sub in ("ifil", "iver") and n >= 4 else {"text": text_of(body)}
            elif sub in SF2_RECORDS:
                width = SF2_RECORDS[sub]
                fields = {"records": max(0, n // width - 1)}
                trouble = trouble or (f"{n} bytes are no whole records" if n % width else None)
                for i in range(len(body) // width - 1):
                    r, place = body[width * i : width * (i + 1)], start + 8 + width * i
                    if sub == "shdr":
                        shdr = {"name": text_of(r[:20])} | fields_of([("start", 20, "<I"), ("end", 24, "<I"), ("loop_start", 28, "<I"), ("loop_end", 32, "<I"), ("sample_rate", 36, "<I"), ("pitch", 40, "<B"), ("correction", 41, "<b"), ("type", 44, "<H")], r)
                        rows.append((f"sample{i}", place, width, shdr, "sample ends before it starts" if shdr["end"] < shdr["start"] else None))
                    elif sub == "phdr":
                        rows.append((f"preset{i}", place, width, {"name": text_of(r[:20])} | fields_of([("preset", 20, "<H"), ("bank", 22, "<H")], r), None))
            yield sub, start, n, fields, trouble
            yield from rows


PARSERS = {"wav": wav, "rf64": rf64, "rmid": rmid, "aiff": aiff, "aifc": aiff, "8svx": svx, "flac": flac, "midi": midi, "ogg": ogg, "mp4": mp4, "mp3": mp3, "sf2": sf2}
