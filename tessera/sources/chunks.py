"""What all parsers share: the row of a chunk, numbers and texts in bytes, and grids of [id][size] chunks."""

from __future__ import annotations

import functools
import struct
from collections.abc import Iterator

Chunk = tuple[str, int, int, dict[str, object], str | None]  # id, offset, size, fields, warning
Table = list[tuple[str, int, str]]  # name, offset, struct format


def number(data: bytes, at: int, n: int, order: str) -> int | None:
    """An unsigned integer; None where it isn't whole."""
    part = data[at : at + n] if at >= 0 else b""
    return int.from_bytes(part, order) if len(part) == n else None


def text_of(raw: bytes) -> str:
    return raw.split(b"\0")[0].decode("latin-1").strip()


def printable(raw: bytes) -> str:
    return raw.decode("latin-1") if all(32 <= b < 127 for b in raw) else "hex:" + raw.hex()


def fields_of(table: Table, payload: bytes) -> dict[str, object]:
    return {name: struct.unpack_from(kind, payload, at)[0] for name, at, kind in table if at + struct.calcsize(kind) <= len(payload)}


def overrun(tag: str, size: int, left: int) -> str:
    return f"chunk {tag} claims {size} bytes, {max(0, left)} are left"


def iff(data: bytes, order: str, start: int = 12, fields: dict[bytes, Table] | None = None, sizes: dict[int, int] | None = None) -> Iterator[Chunk]:
    """Chunks of a RIFF (little-endian) or IFF (big-endian) file; odd sizes are padded. ``sizes``: true sizes by offset, where 32 bits don't do."""
    fields = fields or {}
    at, end = start, len(data)
    while at + 8 <= end:
        tag, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], order)
        if sizes:
            size = sizes.get(at, size)
        decoded = fields_of(fields[tag], data[at + 8 : at + 8 + size]) if tag in fields else {}
        if tag in (b"LIST", b"RIFF", b"FORM"):
            decoded["list_type"] = printable(data[at + 8 : at + 8 + min(size, 4)])
        name = _tag(tag)
        yield name, at, size, decoded, overrun(name, size, end - at - 8) if at + 8 + size > end else None
        at += 8 + size + size % 2


#: printable() of the few tags that most chunks have.
_tag = functools.lru_cache(1024)(printable)
