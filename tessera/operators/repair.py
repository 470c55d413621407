"""Sizes, counts and offsets that a file gets wrong: found, told with what they should be, and put right; and metadata written anew.

Only fields change, never the samples: a repaired file has the same payloads.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.bytes import each_value
from tessera.sources import audio
from tessera.sources.chunks import number

Violation = tuple[str, str, int, int, int, int]  # kind, path, offset, width, stored, computed; -1: no witness

#: Ids whose payload begins with a kind and then holds chunks.
PARENTS = (b"RIFF", b"FORM", b"LIST", b"RF64", b"CAT ")


@dataclass
class Node:
    """A chunk with what it holds: chunks, or bytes as they are. ``size`` is what it says; ``pad`` what follows an odd payload."""

    tag: bytes
    size: int
    kind: bytes = b""
    children: list[Node] = field(default_factory=list)
    body: bytes = b""
    pad: bytes = b""

    def payload(self, order: str) -> bytes:
        return self.kind + b"".join(c.emit(order) for c in self.children) + self.body

    def emit(self, order: str) -> bytes:
        return self.tag + struct.pack(order + "I", self.size & 0xFFFFFFFF) + self.payload(order) + self.pad


def order_of(data: bytes) -> str | None:
    return "<" if data[:4] == b"RIFF" else ">" if data[:4] == b"FORM" else None


def parse(data: bytes, order: str, at: int = 0, end: int | None = None, depth: int = 0) -> tuple[list[Node], bytes]:
    """Chunks and what follows the last whole one; emitting them gives the same bytes."""
    end = len(data) if end is None else end
    out = []
    while at + 8 <= end:
        tag, size = data[at : at + 4], struct.unpack_from(order + "I", data, at + 4)[0]
        if not all(32 <= b < 127 for b in tag):
            break
        stop = min(end, at + 8 + size)
        if depth == 0:  # what the outermost size gets wrong is still inside
            stop = end
        node = Node(tag, size)
        if tag in PARENTS and depth < 16 and stop - at >= 12:
            node.kind = data[at + 8 : at + 12]
            node.children, node.body = parse(data, order, at + 12, stop, depth + 1)
        else:
            node.body = data[at + 8 : stop]
        if size % 2 and stop < end and stop == at + 8 + size:
            node.pad = data[stop : stop + 1]
            stop += 1
        out.append(node)
        at = stop
    return out, data[at:end]


def _sizes(nodes: list[Node], order: str, path: str, at: int) -> Iterator[Violation]:
    for i, n in enumerate(nodes):
        name = f"{path}/{n.tag.decode('latin-1')}[{i}]"
        true = len(n.payload(order))
        if n.size != true:
            yield "size", name, at + 4, 4, n.size, true
        yield from _sizes(n.children, order, name, at + 12)
        at += 8 + true + len(n.pad)


def iff_sizes(data: bytes) -> Iterator[Violation]:
    """Chunks whose size isn't that of what they hold, from the innermost on."""
    if order := order_of(data):
        yield from _sizes(parse(data, order)[0], order, "", 0)


def recomputed(nodes: list[Node], order: str) -> None:
    """Sizes from the innermost chunk up, and pads where they belong."""
    for n in nodes:
        recomputed(n.children, order)
        n.size = len(n.payload(order))
        n.pad = (n.pad or b"\0") if n.size % 2 and n.tag not in (b"RIFF", b"FORM") else b""


def riff_counts(data: bytes) -> Iterator[Violation]:
    """Cue points and loops that there is no room for."""
    if data[:4] == b"RIFF":
        for tag, at, size, fields, _ in audio.wav(data):
            there = min(size, len(data) - at - 8)
            for name, key, head, place in (("cue ", "count", 4, 8), ("smpl", "num_sample_loops", 36, 36)):
                if tag == name and (fields.get(key) or 0) > (room := max(0, there - head) // 24):
                    yield "count", f"{tag.strip()}.{key}", at + place, 4, fields[key], room


def flac_chain(data: bytes) -> Iterator[Violation]:
    """A last block that isn't flagged so, or one flagged before the last; block sizes in the wrong order."""
    if data[:4] != b"fLaC":
        return
    at, heads = 4, []
    while at + 4 <= len(data) and data[at : at + 2] not in (b"\xff\xf8", b"\xff\xf9") and data[at] & 127 < 7:
        size = number(data, at + 1, 3, "big")
        if at + 4 + size > len(data):
            break
        heads.append(at)
        at += 4 + size
    for i, place in enumerate(heads):
        flag, wanted = data[place] >> 7, int(i == len(heads) - 1)
        if flag != wanted:
            yield "flag", f"block[{i}].last", place, 1, data[place], data[place] & 127 | wanted << 7
    if heads and data[heads[0]] & 127 == 0:
        low, high = number(data, heads[0] + 4, 2, "big"), number(data, heads[0] + 6, 2, "big")
        if low > high:
            yield "order", "STREAMINFO.min_block", heads[0] + 4, 2, low, high


def mp4_offsets(data: bytes) -> Iterator[Violation]:
    """Chunk offsets that don't begin where the media do: all off by as much are moved together."""
    if data[4:8] != b"ftyp":
        return
    rows = list(audio.mp4(data))
    media = next(((at + 8, at + size) for tag, at, size, *_ in rows if tag == "mdat"), None)
    for tag, at, size, fields, _ in rows:
        if tag in ("stco", "co64") and media and fields.get("count"):
            width = 4 if tag == "stco" else 8
            offsets = [number(data, at + 16 + width * i, width, "big") for i in range(min(fields["count"], (size - 16) // width))]
            if offsets and not all(media[0] <= o < max(media[1], media[0] + 1) for o in offsets):
                by = media[0] - min(offsets)
                fits = max(offsets) + by < media[1]
                for i, o in enumerate(offsets):
                    yield "offset", f"{tag}[{i}]", at + 16 + width * i, width, o, o + by if fits else -1


REPAIRERS: dict[str, Callable[[bytes], Iterator[Violation]]] = {"iff": iff_sizes, "counts": riff_counts, "flac": flac_chain, "mp4": mp4_offsets}


def register_repairer(name: str, analyse: Callable[[bytes], Iterator[Violation]]) -> None:
    REPAIRERS[name] = analyse


def violations(data: bytes) -> Iterator[tuple]:
    for name, analyse in REPAIRERS.items():
        try:
            for v in analyse(data):
                yield name, *v, v[5] >= 0
        except (struct.error, IndexError, ValueError, TypeError):
            yield name, "unreadable", "", 0, 0, 0, -1, False


def analysed(files: DataFrame) -> DataFrame:
    """A row a violation: repairer, kind, path in the file, offset, stored and computed value, and whether it can be repaired."""
    return each_value(files, ["path"], ["content"], "repairer string, kind string, field string, offset bigint, width int, stored bigint, computed bigint, repairable boolean", violations)


def mended(data: bytes) -> bytes:
    """The file with every violation that has a witness put right. Counts first, then sizes, since a tree is emitted whole."""
    out = bytearray(data)
    little = data[:4] == b"RIFF"
    for name in ("counts", "flac", "mp4", *(n for n in REPAIRERS if n not in ("counts", "flac", "mp4", "iff"))):
        for _, _, at, width, _, value in REPAIRERS[name](bytes(out)):
            if value >= 0:
                out[at : at + width] = value.to_bytes(width, "little" if little else "big")
    if order := order_of(bytes(out)):
        nodes, rest = parse(bytes(out), order)
        recomputed(nodes, order)
        return b"".join(n.emit(order) for n in nodes) + rest
    return bytes(out)


def repaired(content: Column) -> Column:
    @F.pandas_udf("binary")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else mended(bytes(x)))

    return run(content)


def validated(files: DataFrame) -> DataFrame:
    """A file's status: ok, violated, or error where it can't be read; and how many violations it has."""
    found = analysed(files).groupBy("path").agg(F.count("*").alias("violations"), F.bool_or(F.col("kind") == "unreadable").alias("_bad"))
    rows = files.select("path").join(found, "path", "left")
    return rows.select("path", F.when(F.col("_bad"), "error").when(F.col("violations") > 0, "violated").otherwise("ok").alias("status"), F.coalesce("violations", F.lit(0)).cast("bigint").alias("violations"))


# Metadata

#: Chunks that strip() leaves in place.
ESSENTIAL = {"<": (b"fmt ", b"fact", b"data"), ">": (b"COMM", b"SSND", b"FVER", b"VHDR", b"BODY", b"CHAN")}
#: Chunks of AIFF that hold a text, and WAV's INFO ids, by the field.
AIFF_TEXTS = {"title": b"NAME", "artist": b"AUTH", "copyright": b"(c) ", "comment": b"ANNO"}
INFO_TEXTS = {"title": b"INAM", "artist": b"IART", "copyright": b"ICOP", "comment": b"ICMT", "genre": b"IGNR", "software": b"ISFT", "album": b"IPRD", "year": b"ICRD"}


def edited(data: bytes, changes: dict[str, str | None]) -> bytes:
    """A WAV or AIFF file with texts set, or removed where the value is None; other chunks stay as they are."""
    order = order_of(data)
    if order is None:
        raise ValueError("only RIFF and FORM files are edited")
    names = INFO_TEXTS if order == "<" else AIFF_TEXTS
    if unknown := sorted(set(changes) - set(names)):
        raise ValueError(f"no such fields: {', '.join(unknown)}")
    nodes, rest = parse(data, order)
    top = nodes[0]
    if order == "<":
        lists = [n for n in top.children if n.tag == b"LIST" and n.kind == b"INFO"]
        holder = lists[0] if lists else Node(b"LIST", 0, b"INFO")
        if not lists:
            top.children.append(holder)
    else:
        holder = top
    for name, value in changes.items():
        holder.children = [n for n in holder.children if n.tag != names[name]]
        if value is not None:
            holder.children.append(Node(names[name], 0, body=value.encode("utf-8") + (b"\0" if order == "<" else b"")))
    if order == "<" and not holder.children:
        top.children.remove(holder)
    recomputed(nodes, order)
    return b"".join(n.emit(order) for n in nodes) + rest


def stripped(data: bytes) -> bytes:
    """The file with the chunks only that its samples need."""
    order = order_of(data)
    if order is None:
        raise ValueError("only RIFF and FORM files are stripped")
    nodes, _ = parse(data, order)
    nodes[0].children = [n for n in nodes[0].children if n.tag in ESSENTIAL[order]]
    nodes[0].body = b""
    recomputed(nodes[:1], order)
    return nodes[0].emit(order)


def write_fields(content: Column, changes: dict[str, str | None]) -> Column:
    """edited() of a column; a file that can't be edited is null."""

    @F.pandas_udf("binary")
    def run(values: pd.Series) -> pd.Series:
        def one(x):
            try:
                return None if x is None else edited(bytes(x), changes)
            except (ValueError, IndexError, struct.error):
                return None

        return values.map(one)

    return run(content)
