"""Audio and tables found in raw images: signatures, frame cadences, chains of chunks, name tables, and what a file is on the whole.

Finders are generators over bytes, run in Arrow batches; what they find in a file is put together with DataFrame operators.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.bytes import each_value, numbers_of
from tessera.functions.sniffing import HEAD, mpeg_header, sniff, sniff_bytes
from tessera.functions.values import crc8, crc16, runs_of
from tessera.operators import signals
from tessera.sources import audio, walk
from tessera.sources.chunks import number, printable
from tessera.sources.scratch import materialise

#: Magics that are swept for, formats that count, and how far a header may be from its audio.
MAGICS = (b"RIFF", b"RF64", b"FORM", b"fLaC", b"OggS", b"ID3", b"MThd")
CONTAINERS = ("wav", "rf64", "aiff", "aifc", "8svx", "flac", "ogg", "sf2", "mp3", "midi", "rmid")
CONTAINER_CONFIDENCE, BLOB_SCALE, BLOB_LEAST, BACKTRACK, COALESCE, SLACK, FRAMES = 0.9, 0.89, 0.4, 65_536, 32_768, 65_536, 12


def extent(data: bytes, at: int, kind: str) -> int | None:
    """Where a container says that it ends; None if it doesn't, or beyond the data."""
    if kind in ("wav", "sf2", "rmid"):
        size = number(data, at + 4, 4, "little")
    elif kind in ("aiff", "aifc", "8svx"):
        size = number(data, at + 4, 4, "big")
    elif kind == "rf64":
        size = number(data, at + 20, 8, "little")
    elif kind == "midi":
        end = at
        while data[end : end + 4] in (b"MThd", b"MTrk") and (n := number(data, end + 4, 4, "big")) is not None and end + 8 + n <= len(data):
            end += 8 + n
        return end if end > at else None
    elif kind == "ogg":
        serial, end = None, at
        for _, place, size, fields, warning in audio.ogg(data[at:]):
            if warning or "granule" not in fields or (serial is not None and fields["serial"] != serial and not fields["flags"] & 2 and place):
                break
            serial, end = fields["serial"], at + place + size
            if fields["flags"] & 4:
                break
        return end
    else:
        return None
    return at + 8 + size if size is not None and size >= 12 and at + 8 + size <= len(data) else None


def confirmed(data: bytes, at: int, kind: str) -> bool:
    """Whether more than the magic speaks for a container."""
    if kind == "mp3":
        return data[at + 3] < 5 and all(b < 128 for b in data[at + 6 : at + 10]) and len(data) > at + 10
    if kind == "midi":
        return number(data, at + 4, 4, "big") == 6
    if kind == "flac":
        return at + 8 <= len(data) and data[at + 4] & 127 == 0 and number(data, at + 5, 3, "big") == 34
    if kind == "ogg":
        return data[at + 4 : at + 5] == b"\0"
    return True


def sweep(data: bytes) -> Iterator[tuple[str, int, int | None]]:
    """(format, offset, end or None) of every container by its signature; pages of one Ogg stream are one."""
    places, inside = [], 0
    for magic in MAGICS:
        at = data.find(magic)
        while at >= 0:
            places.append(at)
            at = data.find(magic, at + 1)
    places.sort()
    for at in places:
        kind = sniff_bytes(data[at : at + HEAD])
        if kind not in CONTAINERS or not confirmed(data, at, kind) or (kind == "ogg" and at < inside):
            continue
        end = extent(data, at, kind)
        inside = end if kind == "ogg" and end else inside
        yield kind, at, end


def mpeg_streams(data: bytes, least: int = FRAMES) -> Iterator[tuple[int, int, int, float]]:
    """(from, to, frames, confidence) of runs of MPEG frames. Places that can't begin a frame are left out by whole arrays first."""
    raw = np.frombuffer(data, np.uint8)
    if len(raw) < 4:
        return
    syncs = np.flatnonzero(raw[:-3] == 255)
    b, c = raw[syncs + 1], raw[syncs + 2]
    fits = (b >= 0xE0) & (b >> 3 & 3 != 1) & (b >> 1 & 3 != 0) & (c >> 4 != 0) & (c >> 4 != 15) & (c >> 2 & 3 != 3)
    stop = 0
    for at in syncs[fits].tolist():
        if at < stop:
            continue
        end, frames = at, 0
        while (h := mpeg_header(data[end : end + 4])) and h["length"] >= 4 and end + h["length"] <= len(data):
            end, frames = end + h["length"], frames + 1
        if frames >= least:
            stop = end
            yield at, end, frames, round(min(0.60 + 0.01 * frames, 0.99), 2)


FOUND = "kind string, format string, start bigint, stop bigint, confidence double, provisional boolean"


def found_in(data: bytes, scores: np.ndarray | None = None) -> Iterator[tuple]:
    """Containers, streams and blobs of one image, its windows' scores at hand or not. A container without a trustworthy end goes to the next container or the end."""
    containers = list(sweep(data))
    for i, (kind, at, end) in enumerate(containers):
        yield "container", kind, at, end or (containers[i + 1][1] if i + 1 < len(containers) else len(data)), CONTAINER_CONFIDENCE, end is None
    for a, b, _, confidence in mpeg_streams(data):
        yield "stream", "mp3", a, b, confidence, False
    hits: list[list[float]] = []
    scores = signals.window_scores([data])[0] if scores is None else scores
    places = np.flatnonzero(scores >= signals.MIN_SCORE)
    for start, score in zip((places * signals.STEP).tolist(), scores[places].tolist(), strict=True):
        if hits and start - hits[-1][1] <= (signals.MERGE_GAP + 1) * signals.STEP:
            hits[-1][1] = start
            hits[-1].append(score)
        else:
            hits.append([start, start, score])
    for first, last, *values in hits:
        yield "blob", "raw-pcm", int(first), int(last) + signals.WINDOW, round(sum(values) / len(values) * BLOB_SCALE, 4), False


def swept(rows: DataFrame, key: str, data: str) -> DataFrame:
    return each_value(rows, [key], [data], "format string, start bigint, stop bigint", sweep)


def streams(rows: DataFrame, key: str, data: str) -> DataFrame:
    return each_value(rows, [key], [data], "start bigint, stop bigint, frames int, confidence double", mpeg_streams)


def survives(mode: str, kind: Column, confidence: Column) -> Column:
    """What a mode keeps: strict has containers and streams, normal also likely blobs, aggressive all."""
    sure = kind.isin("container", "stream")
    return F.lit(True) if mode == "aggressive" else sure if mode == "strict" else sure | (confidence >= BLOB_LEAST)


def coalesced(records: DataFrame, key: str, gap: int = COALESCE) -> DataFrame:
    """Blobs merged with the next where the gap is small and nothing else begins between; the surest one's confidence stands."""
    w = Window.partitionBy(key).orderBy("start", "stop")
    joins = (F.col("kind") == "blob") & (F.lag("kind").over(w) == "blob") & (F.col("start") - F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1)) <= gap)
    marked = records.withColumn("_new", F.when(joins, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w))
    return marked.groupBy(key, "_run").agg(F.first("kind").alias("kind"), F.first("format").alias("format"), F.min("start").alias("start"), F.max("stop").alias("stop"), F.max("confidence").alias("confidence")).drop("_run")


def located(rows: DataFrame, key: str, data: str, mode: str = "normal") -> DataFrame:
    """Regions of audio in each image: containers, streams and blobs; blobs and streams that lie in a container for a half or more go, near blobs are one."""
    from tessera.operators import ordered

    # Images are read once; what is found in them is small.
    records = materialise(each_value(rows, [key], [data], FOUND, found_in, signals.window_scores), "found")
    solid = records.where("kind = 'container'")
    rest = records.where("kind <> 'container'")
    blobs, runs = rest.where("kind = 'blob'"), rest.where("kind = 'stream'")
    solid_or_run = solid.select(key, "start", "stop").unionByName(runs.select(key, "start", "stop"))
    inside = ordered.absorbed(blobs, solid_or_run, [key]).withColumn("kind", F.lit("blob")).unionByName(ordered.absorbed(runs, solid, [key]).withColumn("kind", F.lit("stream")))
    kept = rest.join(inside, [key, "kind", "start", "stop"], "left_anti")
    out = coalesced(solid.select(key, "kind", "format", "start", "stop", "confidence").unionByName(kept.select(key, "kind", "format", "start", "stop", "confidence")), key)
    return out.where(survives(mode, F.col("kind"), F.col("confidence")))


def stitched(regions: DataFrame, keys: list[str], segment: int, slack: int = SLACK) -> DataFrame:
    """Regions that a scan in segments cut at a boundary, joined again: same format and a stream in common, a boundary between them, and a small gap."""
    w = Window.partitionBy(*keys).orderBy("start", "stop")
    before = F.lag("stop").over(w)
    same = (F.lag("format").over(w) == F.col("format")) & F.arrays_overlap(F.lag("serials").over(w), F.col("serials"))
    edge = (F.floor(before / segment) != F.floor(F.col("start") / segment)) | (before % segment == 0)
    joins = same & edge & (F.col("start") - before).between(0, slack)
    marked = regions.withColumn("_new", F.when(joins, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w))
    return marked.groupBy(*keys, "_run").agg(F.first("format").alias("format"), F.min("start").alias("start"), F.max("stop").alias("stop"), F.count("*").cast("bigint").alias("parts")).drop("_run")


def headers_before(rows: DataFrame, key: str, data: str, start: str, bound: int = BACKTRACK) -> DataFrame:
    """The nearest confirmed container header at most ``bound`` bytes before each region."""
    files = rows.select(key, data).dropDuplicates([key])
    found = each_value(files, [key], [data], "format string, at bigint", lambda value: ((k, a) for k, a, _ in sweep(value)))
    near = rows.select(key, start).join(found, key).where((F.col("at") <= F.col(start)) & (F.col(start) - F.col("at") <= bound))
    return near.groupBy(key, start).agg(F.max_by("format", "at").alias("format"), F.max("at").alias("container_start"))


# Chains and tables


def plausible_tag(raw: bytes) -> bool:
    return len(raw) == 4 and all(32 <= b < 127 for b in raw)


def chain(data: bytes) -> tuple[str, list[tuple[str, int, int]]]:
    """The longest run of [tag][size] records, each of which ends where the next begins, in the byte order with the longer one."""
    best: tuple[str, list[tuple[str, int, int]]] = ("little", [])
    printable_at = np.ones(max(0, len(data) - 7), bool)
    raw = np.frombuffer(data, np.uint8)
    for i in range(4):
        part = raw[i : i + len(printable_at)]
        printable_at &= (part >= 32) & (part < 127)
    places = np.flatnonzero(printable_at)
    for order in ("little", "big"):
        u = sum(raw[places + 4 + i].astype(np.int64) << 8 * (i if order == "little" else 3 - i) for i in range(4)) if len(places) else np.empty(0, np.int64)
        ends = places + 8 + u + u % 2
        ok = (u > 0) & (places + 8 + u <= len(data))
        length: dict[int, int] = {}
        following: dict[int, int] = {}
        for at, end, good in zip(places[::-1].tolist(), ends[::-1].tolist(), ok[::-1].tolist(), strict=True):
            if good:
                length[at], following[at] = 1 + length.get(end, 0), end
        if length:
            at = max(length, key=lambda k: (length[k], -k))
            rows = []
            while at in length:
                rows.append((printable(data[at : at + 4]), at, number(data, at + 4, 4, order)))
                at = following[at]
            if len(rows) > len(best[1]):
                best = (order, rows)
    return best


def resynced(rows: DataFrame, key: str, data: str, least: int = 3) -> DataFrame:
    """Chunks that link up anywhere in damaged files; confidence by how many do, up to 0.95."""

    def made(value: bytes) -> Iterator[tuple]:
        order, found = chain(value)
        if len(found) >= least:
            known = sum(tag in ("fmt ", "data", "LIST", "COMM", "SSND", "fact", "smpl", "cue ", "MTrk") for tag, _, _ in found)
            confidence = min(0.95, 0.35 + 0.30 * min(1, len(found) / 4) + 0.15 * min(1, known) + 0.15 * (known == len(found)))
            yield from ((order, tag, at, size, round(confidence, 4)) for tag, at, size in found)

    return each_value(rows, [key], [data], "`order` string, chunk_id string, offset bigint, size bigint, confidence double", made)


def looks_like_a_name(text: Column) -> Column:
    """A printable run with an extension or a path separator that is mostly letters and digits."""
    share = F.length(F.regexp_replace(text, "[^A-Za-z0-9]", "")) / F.greatest(F.lit(1), F.length(text))
    return text.rlike(r"^[ -~]{3,}$") & text.rlike(r"\.[A-Za-z0-9]{1,4}$|[/\\]") & (share >= 0.6) & (F.length(F.array_join(F.array_distinct(F.split(text, "")), "")) >= 3)


def _nameish(raw: bytes) -> bool:
    return 3 <= len(raw) < 128 and all(32 <= b < 127 for b in raw) and re.search(rb"\.[A-Za-z0-9]{1,4}$|[/\\]", raw) is not None and sum(chr(b).isalnum() for b in raw) / len(raw) >= 0.6


def prefixed_tables(data: bytes, least: int = 4) -> Iterator[tuple]:
    """(index, offset, name, first number behind it) of the longest table of length-prefixed names with equal numbers of bytes between."""
    best: list[tuple[int, bytes, int]] = []
    names = {}
    for m in re.finditer(rb"[ -~]{3,127}", data):
        for width in (1, 2, 4):
            for shift in range(min(3, len(m.group()))):
                at = m.start() + shift
                n = number(data, at - width, width, "little")
                if n and at + n <= m.end() and _nameish(data[at : at + n]):
                    names[at - width] = (width, data[at : at + n], at + n)
    for start in sorted(names):
        for gap in (0, 4, 8, 12, 16):
            rows, at = [], start
            while at in names and names[at][0] == names[start][0]:
                rows.append((at, names[at][1], names[at][2]))
                at = names[at][2] + gap
            if len(rows) >= least and len(rows) > len(best):
                best = rows
    for i, (at, name, end) in enumerate(best):
        yield i, at, name.decode("ascii"), number(data, end, 4, "little")


def fixed_tables(data: bytes, least: int = 4) -> Iterator[tuple]:
    """(index, offset, name, first number behind it) of the longest table of names that stand a fixed number of bytes apart.

    The stride is the commonest distance from a name to one of the next six; candidates are tried in the order of how common they are.
    """
    starts = [m.start() for m in re.finditer(rb"[ -~]{3,127}(?=\0)", data) if _nameish(m.group())]
    strides = Counter(b - a for i, a in enumerate(starts) for b in starts[i + 1 : i + 7])
    best: list[int] = []
    known = set(starts)
    for stride, n in strides.most_common(16):
        if n + 1 < least or stride < 8:
            continue
        for a in starts:
            if a - stride in known:
                continue
            run = [a]
            while run[-1] + stride in known:
                run.append(run[-1] + stride)
            if len(run) >= least and len(run) > len(best):
                best = run
    for i, at in enumerate(best):
        end = data.index(b"\0", at)
        field = best[1] - best[0] - 8 + at
        yield i, at, data[at:end].decode("ascii"), number(data, field, 4, "little")


def tables(rows: DataFrame, key: str, data: str, fixed: bool = False, least: int = 4) -> DataFrame:
    find = fixed_tables if fixed else prefixed_tables
    return each_value(rows, [key], [data], "index int, offset bigint, name string, number bigint", lambda value: find(value, least))


def placed_entries(entries: DataFrame, keys: list[str], sizes: str, start: str) -> DataFrame:
    """Where entries are whose sizes are known and that follow each other."""
    w = Window.partitionBy(*keys).orderBy("index").rowsBetween(Window.unboundedPreceding, -1)
    return entries.withColumn("at", F.col(start) + F.coalesce(F.sum(sizes).over(w), F.lit(0)))


def ascending_runs(rows: DataFrame, key: str, data: str, least: int = 4) -> DataFrame:
    """Runs of aligned little-endian 32-bit numbers that go up and stay inside of the file: tables of offsets; and numbers that are its size, or 8 less."""

    def made(value: bytes) -> Iterator[tuple]:
        x = numbers_of(value, "u32").astype(np.int64)
        up = (np.diff(x) > 0) & (x[1:] < len(value)) & (x[:-1] > 0)
        for a, b in runs_of(up, least - 1):
            yield "table", 4 * a, b - a + 1
        for name, size in (("file_size", len(value)), ("file_size-8", len(value) - 8)):
            yield from ((name, 4 * int(i), 1) for i in np.flatnonzero(x == size))

    return each_value(rows, [key], [data], "kind string, offset bigint, count int", made)


# Files on the whole

#: First bytes of files of other kinds.
FOREIGN = {b"%PDF": "pdf", b"\x89PNG": "png", b"\xff\xd8\xff": "jpeg", b"PK\x03\x04": "zip", b"\x1f\x8b": "gzip", b"\x7fELF": "elf", b"MZ": "exe", b"{\\rtf": "rtf", b"GIF8": "gif", b"<?xml": "xml", b"SQLite format 3": "sqlite"}
NEXT = {"single": "inspect", "container": "locate", "chunked": "inspect", "damaged": "repair", "opaque": "probe", "foreign": None, "empty": None}


def triage(data: bytes, name: str = "") -> tuple[str, str | None, str | None]:
    """What kind of file it is, its format or what it looks like, and what to do next."""
    if not data:
        return "empty", None, None
    kind = sniff(data, name)
    if kind in walk.PARSERS:
        _, rows = walk.walk_bytes(data, kind, name)
        damaged = any(w and ("goes beyond" in w or "claims" in w or "stopped" in w) for *_, w in rows)
        verdict = "damaged" if damaged or not rows else "single"
        return verdict, kind, NEXT[verdict]
    if kind:
        return "single", kind, "inspect"
    for magic, label in FOREIGN.items():
        if data.startswith(magic):
            return "foreign", label, None
    if any(True for _ in sweep(data)):
        return "container", None, NEXT["container"]
    if any(True for _ in walk.generic(data)):
        return "chunked", None, NEXT["chunked"]
    return "opaque", None, NEXT["opaque"]


def triaged(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    named = files.select(F.col(path).alias("path"), F.col(content).alias("_content"), F.encode(path, "UTF-8").alias("_name"))
    return each_value(named, ["path"], ["_content", "_name"], "verdict string, format string, next_verb string", lambda data, name: iter([triage(data, name.decode())]))


def forced(files: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """What each parser makes of files that none claims: chunks without a warning, the most first."""

    def made(data: bytes) -> Iterator[tuple]:
        rows = []
        for kind in kinds or sorted(walk.PARSERS):
            _, found = walk.walk_bytes(data, kind)
            good = sum(1 for *_, warning in found if not warning)
            if good:
                rows.append((good, kind))
        for place, (good, kind) in enumerate(sorted(rows, key=lambda r: (-r[0], r[1])), 1):
            yield place, kind, good

    return each_value(files, ["path"], ["content"], "place int, format string, chunks int", made)


def explored(files: DataFrame, offset: Column, length: Column) -> DataFrame:
    """A walk of a region of each file, as if it were one; offsets are the file's."""
    part = files.select("path", F.substring("content", (offset + 1).cast("int"), length.cast("int")).alias("content"), offset.cast("bigint").alias("_from"))
    chunks = walk.walk(part)
    return chunks.join(part.select("path", "_from"), "path").withColumn("offset", F.col("offset") + F.col("_from")).drop("_from")


#: What tools leave in a file: where to look, the pattern, and the tool.
SIGNATURES = [
    ("software", r"(?i)\bLavf\d", "FFmpeg"), ("software", r"(?i)^LAME", "LAME"), ("software", r"(?i)Pro Tools", "Pro Tools"), ("software", r"(?i)Ableton", "Ableton Live"), ("software", r"(?i)FL Studio", "FL Studio"),
    ("software", r"(?i)Logic", "Logic"), ("software", r"(?i)REAPER", "REAPER"), ("software", r"(?i)Audacity", "Audacity"), ("software", r"(?i)libFLAC", "libFLAC"), ("software", r"(?i)^tool$", "tool"),
]
_SOFTWARE_FIELDS = ["ISFT", "originator", "VENDOR", "encoder", "TSSE", "creator", "coding_history", "originator_reference"]


def provenance(chunks: DataFrame) -> DataFrame:
    """The tool that wrote each file, by what chunks say of it: the first signature that fits, with the field that it rests on."""
    told = chunks.select("path", F.explode("fields").alias("field", "value")).where(F.col("field").isin(_SOFTWARE_FIELDS))
    hits = F.filter(F.array(*[F.when(F.col("value").rlike(p), F.struct(F.lit(i).alias("i"), F.lit(tool).alias("tool"))) for i, (_, p, tool) in enumerate(SIGNATURES)]), lambda x: x.isNotNull())
    named = told.withColumn("_hit", F.get(hits, 0)).where("_hit is not null")
    return named.groupBy("path").agg(F.min(F.struct("_hit.i", "_hit.tool", "field")).alias("m")).select("path", "m.tool", F.col("m.field").alias("basis"))


def flac_frames(data: bytes) -> Iterator[tuple[int, int, bool]]:
    """(offset, size, sound?) of FLAC frames: from one header whose CRC-8 holds to the next, and whether the CRC-16 at the end does."""
    start = next((at for tag, at, *_ in audio.flac(data) if tag == "frames"), len(data))
    heads = []
    for m in re.finditer(rb"\xff[\xf8\xf9]", data[start:]):
        at = start + m.start()
        n = 4
        lead = data[at + 4] if at + 4 < len(data) else 0
        n += 1 if lead < 0x80 else max(2, 8 - (lead ^ 0xFF).bit_length())
        size, rate = data[at + 2] >> 4 if at + 2 < len(data) else 0, data[at + 2] & 15 if at + 2 < len(data) else 0
        n += {6: 1, 7: 2}.get(size, 0) + {12: 1, 13: 2, 14: 2}.get(rate, 0)
        if at + n < len(data) and crc8(data[at : at + n]) == data[at + n]:
            heads.append(at)
    for a, b in zip(heads, [*heads[1:], len(data)], strict=False):
        yield a, b - a, crc16(data[a : b - 2]) == number(data, b - 2, 2, "big")


def audited_flac(rows: DataFrame, key: str, data: str) -> DataFrame:
    return each_value(rows, [key], [data], "offset bigint, size bigint, sound boolean", flac_frames)


def audited_mp3(rows: DataFrame, key: str, data: str) -> DataFrame:
    """Each MPEG frame with whether its side information starts inside of what has come (the bit reservoir)."""

    def made(value: bytes) -> Iterator[tuple]:
        start = next((size for tag, _, size, *_ in audio.id3v2(value) if tag == "ID3"), 0)
        come = 0
        for at, h in audio.mpeg_frames(value, start, len(value)):
            side = at + 4 + 2 * h["crc"]
            back = (number(value, side, 2, "big") or 0) >> 7 if h["layer"] == 3 else 0
            yield at, h["length"], h["bitrate"], back <= come
            come = min(511, come + h["length"])

    return each_value(rows, [key], [data], "offset bigint, size bigint, bitrate int, sound boolean", made)


def overflows(children: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks that claim bytes outside of the one that they are in."""
    inside = children.join(parents.select(*keys, F.col("chunk").alias("parent"), F.col("start").alias("_a"), F.col("stop").alias("_b")), [*keys, "parent"])
    return inside.where((F.col("start") < F.col("_a")) | (F.col("stop") > F.col("_b"))).drop("_a", "_b")


def within_any(points: DataFrame, extents: DataFrame, keys: list[str], cell: int = 4096) -> DataFrame:
    """Points (``at``) inside of some extent [start, stop): cells make it an equi-join."""
    cells = extents.select(*keys, "start", "stop", F.explode(F.sequence(F.floor(F.col("start") / cell), F.floor((F.greatest("stop", F.col("start") + 1) - 1) / cell))).alias("_cell"))
    marked = points.withColumn("_cell", F.floor(F.col("at") / cell))
    hits = marked.join(cells, [*keys, "_cell"]).where("at >= start and at < stop").select(*keys, "at").distinct()
    return points.join(hits, [*keys, "at"], "left_semi")


def sample_names(chained: DataFrame, listed: DataFrame, keys: list[str]) -> DataFrame:
    """Names of samples by index: a chunk's own name, else the contents table's."""
    own, other = chained.select(*keys, "index", F.col("name").alias("_own")), listed.select(*keys, "index", F.col("name").alias("_listed"))
    return own.join(other, [*keys, "index"], "full").select(*keys, "index", F.coalesce("_own", "_listed").alias("name"))


def lost_offsets(listed: DataFrame, chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Offsets of a contents table at which no chunk begins."""
    return listed.join(chunks.select(*keys, "offset").distinct(), [*keys, "offset"], "left_anti")


def body_ranges(sizes: DataFrame, keys: list[str]) -> DataFrame:
    """Byte ranges of bodies that follow each other, by their sizes; empty ones have none."""
    w = Window.partitionBy(*keys).orderBy("index").rowsBetween(Window.unboundedPreceding, -1)
    out = sizes.withColumn("start", F.coalesce(F.sum("size").over(w), F.lit(0)).cast("bigint"))
    return out.where("size > 0").withColumn("stop", F.col("start") + F.col("size"))


def track_bounds(tracks: DataFrame, keys: list[str], end: str) -> DataFrame:
    """Tracks of a cue sheet: each runs to the next one's start in the same file, or to its end."""
    w = Window.partitionBy(*keys).orderBy("number")
    return tracks.withColumn("stop", F.coalesce(F.lead("start").over(w), F.col(end)))
