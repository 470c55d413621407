"""Keys, tempi and kinds as Column expressions: no Python runs on the executors."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pitch classes with sharps, and what flats are called.
PITCHES = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]
FLATS = {"Db": "C#", "Eb": "D#", "Gb": "F#", "Ab": "G#", "Bb": "A#", "Cb": "B", "Fb": "E"}
#: Tempo patterns in the order they are tried, and the tempi believed.
BPM_PATTERNS = [r"(?i)(\d{2,3})\s*bpm", r"(?i)bpm\s*(\d{2,3})", r"(?i)(\d{2,3})bpm", r"(?<![\d.A-Za-z])(\d{2,3})(?![\d.A-Za-z])"]
BPM_LOW, BPM_HIGH = 60, 300
#: Key patterns in the order they are tried; the last three tell capitals from small letters.
KEY_PATTERNS = [
    r"(?i)\b([A-G][#b]?)\s*major\b", r"(?i)\b([A-G][#b]?)\s*maj\b", r"(?i)\b([A-G][#b]?)major\b", r"(?i)\b([A-G][#b]?)maj\b",
    r"(?i)\b([A-G][#b]?)\s*minor\b", r"(?i)\b([A-G][#b]?)\s*min\b", r"(?i)\b([A-G][#b]?)minor\b", r"(?i)\b([A-G][#b]?)min\b",
    r"\b([A-G][#b]?)m\b", r"\b([A-G][#b])M\b", r"\b([A-G])\s+M\b",
]


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def stem(path: Column) -> Column:
    """File name without its extension; a leading dot is none."""
    return F.regexp_replace(file_name(path), r"(?<=[^.])\.[^.]*$", "")


def bpm_from_filename(path: Column) -> Column:
    """The first tempo between 60 and 300 that a pattern finds, patterns in order; null if none."""
    found = [F.get(F.filter(F.transform(F.regexp_extract_all(stem(path), F.lit(p), 1), lambda x: x.cast("int")), lambda x: x.between(BPM_LOW, BPM_HIGH)), 0) for p in BPM_PATTERNS]
    return F.coalesce(*found)


def sharp(note: Column) -> Column:
    """A note's root with a capital letter, and flats as sharps; any other text as it is, but for its capitals."""
    names = {letter + sign: FLATS.get(letter + sign, letter + sign) for letter in "ABCDEFG" for sign in ("", "#", "b")}
    known = {spelt: name for n, name in names.items() for spelt in {n, n.lower(), n.upper(), n[0].lower() + n[1:].upper()}}
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), note), F.initcap(note))


def key_from_filename(path: Column) -> Column:
    """A key such as C#m that a file's name spells out; null if none."""
    name = F.translate(file_name(path), "_-", "  ")
    out = None
    for i, p in enumerate(KEY_PATTERNS):
        whole, note = F.regexp_extract(name, p, 0), sharp(F.regexp_extract(name, p, 1))
        minor = 4 <= i <= 8
        value = F.when(whole != "", F.concat(note, F.lit("m")) if minor else note)
        out = value if out is None else F.coalesce(out, value)
    return out


def bare_key(token: Column) -> Column:
    """A whole token that is a key: A, A#, Bb, Am; null if it isn't."""
    p = r"^([A-G][#b]?)(m?)$"
    return F.when(token.rlike(p), F.concat(sharp(F.regexp_extract(token, p, 1)), F.regexp_extract(token, p, 2)))


def key_from_path(path: Column, parents: int = 3) -> Column:
    """The file name's key, else the first whole token that is one, in the name and then in the folders above.

    A bare major letter beside a token such as min or min7 is minor.
    """
    folders = F.slice(F.reverse(F.split(F.regexp_replace(path, r"/[^/]*$", ""), "/")), 1, parents)
    segments = F.concat(F.array(stem(path)), F.filter(folders, lambda x: x != ""))

    def keyed(segment: Column) -> Column:
        tokens = F.filter(F.split(segment, r"[_\-.\s]+"), lambda t: t != "")

        def at(t: Column, i: Column) -> Column:
            key = bare_key(t)
            beside = F.coalesce(F.get(tokens, i - 1), F.lit("")).rlike("(?i)^min(or)?(add)?[0-9]*$"), F.coalesce(F.get(tokens, i + 1), F.lit("")).rlike("(?i)^min(or)?(add)?[0-9]*$")
            before_major = F.coalesce(F.get(tokens, i - 1), F.lit("")).rlike("(?i)^maj(or)?(add)?[0-9]*$")
            return F.when(~key.endswith("m") & (beside[0] | (beside[1] & ~before_major)), F.concat(key, F.lit("m"))).otherwise(key)

        return F.get(F.filter(F.transform(tokens, at), lambda k: k.isNotNull()), 0)

    return F.coalesce(key_from_filename(path), F.get(F.filter(F.transform(segments, keyed), lambda k: k.isNotNull()), 0))


def spellings() -> dict[str, tuple[int, int]]:
    """Pitch class and mode (0 major, 1 minor) of each place on the wheel and of each note as normal_key() leaves it."""
    out = {}
    for number in range(1, 13):
        major = (number - 8) * 7 % 12  # up by fifths, seven semitones each; C major is 8B, and a minor key stands with its relative major
        out |= {f"{number}B": (major, 0), f"{number}A": ((major + 9) % 12, 1)}
    for letter in "CDEFGAB":
        for sign, by in (("", 0), ("#", 1), ("b", -1)):
            for name in (letter, letter.lower()):
                pc = (PITCHES.index(letter) + by) % 12
                out |= {f"{name}{sign}": (pc, 0), f"{name}{sign}m": (pc, 1)}
    return out


#: How spellings of a key come to those of spellings(), one after the other.
NORMAL = [
    (r"^(?=\d{1,2}\s*[ABab]$)0?(\d+)\s*([Aa])$", "$1A"), (r"^(?=\d{1,2}\s*[Bb]$)0?(\d+)\s*([Bb])$", "$1B"),
    (r"^([A-Ga-g][#b]?)\s*(?:minor|min|m)\s*(?:\d+)?$", "$1m"), (r"^([A-Ga-g][#b]?)\s*(?:major|maj|M)?\s*(?:\d+)?$", "$1"),
]


def normal_key(key: Column) -> Column:
    out = F.trim(key)
    for pattern, by in NORMAL:
        out = F.regexp_replace(out, pattern, by)
    return out


def looked_up(key: Column, values: dict[str, object]) -> Column:
    """A literal for each of spellings(), by a key's normal spelling; null for any other text. The key's expression occurs once."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), normal_key(key))


def key_of(key: str) -> tuple[int, int] | None:
    """parse_key() of a text at hand."""
    out = key.strip(" ")
    for pattern, by in NORMAL:
        out = re.sub(pattern, by.replace("$", "\\"), out)
    return spellings().get(out)


def parse_key(key: Column) -> Column:
    """Pitch class and mode (0 major, 1 minor) of a spelling or a Camelot code; null if it is neither."""
    table = F.create_map(*[x for name, (pc, mode) in spellings().items() for x in (F.lit(name), F.struct(F.lit(pc).alias("pc"), F.lit(mode).alias("mode")))])
    return F.element_at(table, normal_key(key))


def pitch_name(pc: Column, mode: Column) -> Column:
    return F.concat(F.get(F.array(*map(F.lit, PITCHES)), F.pmod(pc, F.lit(12)).cast("int")), F.when(mode == 1, "m").otherwise(""))


def code_of(pc: int, mode: int) -> str:
    return f"{((pc + 3 * mode) * 7 + 7) % 12 + 1}{'BA'[mode]}"


def camelot(key: Column) -> Column:
    """The key's code on the wheel, such as 8A."""
    return looked_up(key, {name: code_of(*k) for name, k in spellings().items()})


def related(key: str) -> dict[tuple[int, int], int]:
    """The keys that fit a key, with their place among camelot_neighbours(): itself, its relative, and those below and above on the wheel."""
    found = key_of(key)
    if found is None:
        return {}
    pc, mode = found
    relative = ((pc + 3) % 12, 0) if mode else ((pc + 9) % 12, 1)
    return {(pc, mode): 0, relative: 1, ((pc + 5) % 12, mode): 2, ((pc + 7) % 12, mode): 3}


def camelot_neighbours(code: Column) -> Column:
    """The code, its relative, and its neighbours below and above on the wheel; an empty array if it isn't a code."""
    p = r"^(\d{1,2})([AB])$"
    n, side = F.regexp_extract(code, p, 1).try_cast("int"), F.regexp_extract(code, p, 2)
    other = F.when(side == "A", "B").otherwise("A")
    make = lambda k, s: F.concat(k.cast("string"), s)
    out = F.array(make(n, side), make(n, other), make(F.when(n == 1, 12).otherwise(n - 1), side), make(F.when(n == 12, 1).otherwise(n + 1), side))
    return F.when(code.rlike(p), out).otherwise(F.array().cast("array<string>"))


def enharmonics(key: Column) -> Column:
    """All spellings of a key, sorted."""
    k = parse_key(key)
    name = pitch_name(k["pc"], F.lit(0))
    others = F.filter(F.transform(F.array(*[F.struct(F.lit(a).alias("flat"), F.lit(b).alias("name")) for a, b in FLATS.items()]), lambda x: F.when(x["name"] == name, x["flat"])), lambda x: x.isNotNull())
    suffix = F.when(k["mode"] == 1, "m").otherwise("")
    return F.array_sort(F.transform(F.concat(F.array(name), others), lambda x: F.concat(x, suffix)))


def infer_kind(duration: Column, beats: Column) -> Column:
    d, b = F.coalesce(duration, F.lit(0.0)), F.coalesce(beats, F.lit(0))
    return F.when((b > 0) | (d >= 2.0), "loop").when((d < 1.0) & (b <= 0), "one_shot").otherwise("any")


def improve_bpm(detected: Column, named: Column, within: int = 20) -> Column:
    """The tempo to believe of a measured and a named one, and where it comes from."""
    close = lambda x: F.abs(x - named) <= within
    pick = lambda x, s: F.struct(x.cast("double").alias("bpm"), F.lit(s).cast("string").alias("origin"))
    out = F.when(detected.isNotNull() & ~detected.between(60, 200), F.when(named.isNotNull(), pick(named, "filename")).otherwise(pick(F.lit(None), "rejected")))
    out = out.when(named.isNull(), F.when(detected.isNotNull(), pick(detected, "detected")).otherwise(pick(detected, None)))
    out = out.when(detected.isNull(), pick(named, "filename")).when(close(detected), pick(detected, "detected"))
    for x in (detected * 2, detected / 2, detected * 1.5, detected / 1.5):
        out = out.when(close(x), pick(x, "corrected"))
    return out.otherwise(pick(named, "filename"))


def note_name(note: Column) -> Column:
    """MIDI note 60 is C3."""
    return F.concat(F.get(F.array(*map(F.lit, PITCHES)), (note % 12).cast("int")), (F.floor(note / 12) - 2).cast("string"))


def key_signature(sharps: Column, minor: Column) -> Column:
    """Name of a key signature of -7 (flats) to 7 (sharps): the wheel of fifths once more."""
    order = ["Cb", "Gb", "Db", "Ab", "Eb", "Bb", "F", "C", "G", "D", "A", "E", "B", "F#", "C#", "G#", "D#", "A#"]
    names = F.array(*map(F.lit, order))
    return F.when(sharps.between(-7, 7), F.concat(F.get(names, (sharps + 7 + F.when(minor == 1, 3).otherwise(0)).cast("int")), F.when(minor == 1, "m").otherwise("")))


def effective_beats(beats: Column, one_shot: Column, tempo: Column, duration: Column) -> Column:
    """A file's count of beats, unless it is flagged as a one-shot whose beats don't fill its duration (within 15 %)."""
    filled = F.abs(beats * 60.0 / tempo - duration) <= 0.15 * duration
    return F.when(beats.isNull() | (beats <= 0), None).when(~one_shot, beats).when((tempo > 0) & (duration > 0) & filled, beats)
