"""What is odd about a file, rule by rule: each rule reads the bytes and the walk of one file, and a rule that fails says so itself."""

from __future__ import annotations

import struct
from collections import Counter
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.bytes import each_value
from tessera.functions.sniffing import HEAD, leading_json, sniff_bytes
from tessera.operators import signals
from tessera.operators.locate import CONTAINERS, MAGICS, confirmed, extent
from tessera.sources import walk
from tessera.sources.chunks import Chunk, number
from tessera.sources.formats import VITAL

Finding = tuple[str, int | None, str]  # severity, offset, message
#: Second formats behind an end, ids that may occur once, frames that may be repeated, and what an unfilled chunk is called.
SECOND = {b"PK\x03\x04": "zip", b"RIFF": "riff", b"%PDF": "pdf", b"\x7fELF": "elf", b"Rar!": "rar", b"7z\xbc\xaf": "7z", b"\x89PNG": "png", b"\xff\xd8\xff": "jpeg", b"MZ": "exe"}
ONCE = ("fmt ", "data", "fact", "smpl", "inst", "acid", "bext", "COMM", "SSND", "VHDR", "BODY", "STREAMINFO")
MANY_FRAMES = ("TXXX", "WXXX", "COMM", "APIC", "USLT", "PRIV", "GEOB", "UFID", "POPM", "padding", "ID3")
CAVITIES, JUNK_LEAST = ("PADDING", "free", "skip", "JUNK", "PAD ", "junk"), 1024
BOX_KINDS = ("mp4", "flac", "ogg", "mp3", "midi")


def declared_end(data: bytes, kind: str | None, rows: list[Chunk]) -> int | None:
    """Where a file of chunks ends by what it says; None where nothing does."""
    if kind in ("wav", "sf2", "rmid", "aiff", "aifc", "8svx", "smus"):
        size = number(data, 4, 4, "big" if data[:4] == b"FORM" else "little")
        return None if size is None else size + 8 + size % 2
    if kind == "midi":
        return max((at + 8 + size for tag, at, size, *_ in rows if tag in ("MThd", "MTrk")), default=None)
    if kind == "mp4":
        return max((at + size for _, at, size, fields, _ in rows if fields.get("depth") == 0), default=None)
    if kind == "ogg":
        return max((at + size for tag, at, size, *_ in rows if tag == "OggS"), default=None)
    return None


def structure(data, kind, rows) -> Iterator[Finding]:
    for _, at, _, _, warning in rows:
        if warning:
            yield ("info" if "not read" in warning or "too deeply" in warning else "warn"), at, warning


def trailing_data(data, kind, rows) -> Iterator[Finding]:
    end = declared_end(data, kind, rows)
    if end and 0 < end < len(data):
        yield "notice", end, f"{len(data) - end} bytes after the declared end"


def polyglot(data, kind, rows) -> Iterator[Finding]:
    end = declared_end(data, kind, rows)
    if end and 0 < end < len(data):
        for magic, name in SECOND.items():
            if data.startswith(magic, end):
                yield "alert", end, f"{name} after the declared end"
                return
    tail = max(0, len(data) - 66_000)
    at = data.rfind(b"PK\x05\x06", tail)
    if at >= 0 and len(data) - at >= 22 and data[:4] != b"PK\x03\x04":
        yield "alert", at, "end of a zip directory"


def nonprintable_text(data, kind, rows) -> Iterator[Finding]:
    for tag, at, _, fields, _ in rows:
        for name, value in fields.items():
            if isinstance(value, str) and sum(ord(c) < 9 or 14 <= ord(c) < 32 for c in value) >= 2:
                yield "notice", at, f"control characters in {tag} {name}"


def duplicate_frame(data, kind, rows) -> Iterator[Finding]:
    if kind == "mp3" and rows and rows[0][0] == "ID3":
        frames = [(tag, at) for tag, at, *_ in rows if len(tag) == 4 and at < rows[0][2] and tag not in MANY_FRAMES]
        counts = Counter(tag for tag, _ in frames)
        for tag, n in counts.items():
            if n > 1:
                yield "notice", max(at for t, at in frames if t == tag), f"{n} frames {tag}"


def cavity_content(data, kind, rows) -> Iterator[Finding]:
    for tag, at, size, *_ in rows:
        if tag in CAVITIES and (tag not in ("JUNK", "PAD ", "junk") or size >= JUNK_LEAST):
            head = 4 if kind == "flac" else 8
            if any(data[at + head : at + head + size - (8 if kind == "mp4" else 0)]):
                yield "notice", at, f"bytes in {tag}"


def application_block(data, kind, rows) -> Iterator[Finding]:
    for tag, at, _, fields, _ in rows:
        if kind == "flac" and tag == "APPLICATION":
            yield "notice", at, f"application block {fields.get('application')}"


def ogg_multistream(data, kind, rows) -> Iterator[Finding]:
    if kind == "ogg" and len(serials := {fields["serial"] for tag, _, _, fields, _ in rows if tag == "OggS"}) > 1:
        yield "notice", 0, f"{len(serials)} logical streams"


def mp4_mdat_coverage(data, kind, rows) -> Iterator[Finding]:
    if kind == "mp4":
        media = sum(size - 8 for tag, _, size, *_ in rows if tag == "mdat")
        tables = [fields for tag, _, _, fields, _ in rows if tag == "stsz"]
        used = sum(f.get("total") or 0 for f in tables)
        if sum(f.get("count") or 0 for f in tables) and media - used > 1024:
            yield "notice", next(at for tag, at, *_ in rows if tag == "mdat"), f"{media - used} bytes of media that no sample uses"


def id3_padding_nonzero(data, kind, rows) -> Iterator[Finding]:
    for tag, at, _, fields, _ in rows:
        if tag == "padding" and fields.get("nonzero"):
            yield "notice", at, "bytes in the tag's padding"


def dual_endianness(data, kind, rows) -> Iterator[Finding]:
    if kind == "wav":
        bits = next((f.get("bits_per_sample") for tag, _, _, f, _ in rows if tag == "fmt "), None)
        for tag, at, size, *_ in rows:
            if tag == "data" and bits == 16 and size >= 512 and min(signals.both_orders(data[at + 8 : at + 8 + size])) > 0.9:
                yield "notice", at, "smooth in both byte orders"


def nonzero_pad(data, kind, rows) -> Iterator[Finding]:
    if kind in ("wav", "aiff", "aifc", "8svx", "sf2", "rmid", "rf64"):
        for tag, at, size, *_ in rows:
            if size % 2 and len(tag) == 4 and at + 8 + size < len(data) and data[at + 8 + size] and data[at : at + 4] == tag.encode("latin-1"):
                yield "warn", at + 8 + size, f"pad byte of {tag} is not zero"


def duplicate_chunk(data, kind, rows) -> Iterator[Finding]:
    for tag in ONCE:
        places = [at for t, at, *_ in rows if t == tag]
        if len(places) > 1:
            yield "warn", places[-1], f"{len(places)} chunks {tag}"


def wrong_format_tag(data, kind, rows) -> Iterator[Finding]:
    if kind not in (None, "mp3") and data[-32:-24] == b"APETAGEX":
        yield "notice", len(data) - 32, f"an APE tag in {kind}"


def embedded_standalone_media(data, kind, rows) -> Iterator[Finding]:
    if kind is None or kind in ("sf2", "rmid", "id3-wrapped", "bitwig", "multisample", "xpn", "labx"):
        return
    for magic in MAGICS:
        at = data.find(magic, 1)
        while at > 0:
            inner = sniff_bytes(data[at : at + HEAD])
            if inner in CONTAINERS and inner != kind and confirmed(data, at, inner) and (end := extent(data, at, inner)) and end <= len(data):
                yield "notice", at, f"a whole {inner} inside"
            at = data.find(magic, at + 1)


def json_trailing_data(data, kind, rows) -> Iterator[Finding]:
    if kind == "vital":
        text = data.decode("utf-8", "replace")
        value, end = leading_json(text)
        if value is not None and text[end:].strip():
            yield "alert", len(text[:end].encode()), "data after the top-level value"


def json_unknown_key(data, kind, rows) -> Iterator[Finding]:
    if kind == "vital":
        value, _ = leading_json(data.decode("utf-8", "replace"))
        for key in sorted(set(value) - set(VITAL)) if isinstance(value, dict) else ():
            yield "notice", 0, f"unknown key {key}"


RULES: dict[str, Callable[..., Iterator[Finding]]] = {
    f.__name__: f
    for f in (structure, trailing_data, polyglot, nonprintable_text, duplicate_frame, cavity_content, application_block, ogg_multistream, mp4_mdat_coverage, id3_padding_nonzero, dual_endianness, nonzero_pad, duplicate_chunk, wrong_format_tag, embedded_standalone_media, json_trailing_data, json_unknown_key)
}


def findings(data: bytes, name: str = "") -> Iterator[tuple[str, str, int | None, str]]:
    """(rule, severity, offset, message) of all rules. Warnings about what was not read are the rule ``coverage``."""
    kind, rows = walk.walk_bytes(data, None, name)
    for rule, check in RULES.items():
        try:
            for severity, offset, message in check(data, kind, rows):
                yield ("coverage" if rule == "structure" and severity == "info" else rule), severity, offset, message
        except (struct.error, IndexError, KeyError, ValueError, TypeError) as error:
            yield "check_failed", "warn", None, f"{rule} was not checked: {error}"


def scan(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """A row a finding of each file: ``rule``, ``severity``, ``offset``, ``message``."""
    named = files.select(F.col(path).alias("path"), F.col(content).alias("_content"), F.encode(path, "UTF-8").alias("_name"))
    return each_value(named, ["path"], ["_content", "_name"], "rule string, severity string, offset bigint, message string", lambda data, name: findings(data, name.decode()))
