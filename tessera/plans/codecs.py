"""Sample codecs over data without prediction, so that SQL can say what they must give."""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import codecs as C
from tessera.sources import bindings as B
from tessera.sources import specimens as S

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def _body(name: str, n: int) -> bytes:
    return (name.encode() * (n // max(1, len(name.encode())) + 1))[:n]


def _dsp(k: int, name: str) -> bytes:
    return struct.pack(">III", 14, 16, 8000) + bytes(84) + bytes([k % 11]) + _body(name, 7)


def _hps(k: int, name: str) -> bytes:
    return b" HALPST\0" + struct.pack(">II", 8000, 1) + bytes(0x70) + struct.pack(">III", 8, 15, 0xFFFFFFFF) + bytes(20) + bytes([k % 11]) + _body(name, 7)


def _brstm(k: int, name: str) -> bytes:
    one = bytes([2, 0, 1, 0]) + struct.pack(">HHIIIIIIIII", 8000, 0, 0, 14, 256, 1, 8, 14, 8, 14, 8)
    refs = struct.pack(">6I", 0x01000000, 24, 0, 0, 0x01000000, 24 + len(one))
    table = bytes([1, 0, 0, 0]) + struct.pack(">II", 0x01000000, 24 + len(one) + 12) + struct.pack(">II", 0x01000000, 24 + len(one) + 20) + bytes(40)
    head = refs + one + table
    head = b"HEAD" + struct.pack(">I", 8 + len(head)) + head
    return (b"RSTM\xfe\xff\1\0" + struct.pack(">IHH", 264, 64, 2) + struct.pack(">IIIIII", 64, len(head), 0, 0, 248, 16) + bytes(24) + head).ljust(256, b"\0") + bytes([k % 11]) + _body(name, 7)


def _adx(k: int, name: str) -> bytes:
    return b"\x80\0" + struct.pack(">H", 32) + bytes([3, 18, 4, 1]) + struct.pack(">IIH", 8000, 32, 0) + bytes(12) + b"(c)CRI" + struct.pack(">H", k % 50) + _body(name, 16)


def _ncw(k: int, name: str) -> bytes:
    raw = _body(name, 1024)
    head = b"\x01\xa8\x9e\xd6" + bytes(4) + struct.pack("<HHIIII", 1, 16, 8000, 20, 120, 124)
    return head.ljust(120, b"\0") + struct.pack("<I", 0) + struct.pack("<iihH", 0, 0, 0, 0) + bytes(4) + raw


def _impulse(k: int, name: str) -> bytes:
    value = sum(b << 9 * i for i, b in enumerate(name.encode()))
    packed = value.to_bytes(-(-9 * len(name.encode()) // 8), "little")
    return struct.pack("<H", len(packed)) + packed


_SHIFTED = "greatest(-32768, least(32767, {0}))"
_N = "(CASE WHEN {0} > 7 THEN {0} - 16 ELSE {0} END)"
_LO, _HI = _N.format("(byte & 15)"), _N.format("(byte >> 4)")


def _pairs(n: int, sample: str, low_first: bool) -> str:
    """SQL of two samples a byte of the name's first n bytes."""
    a, b = (_LO, _HI) if low_first else (_HI, _LO)
    return f"SELECT k, 2 * i AS i, {sample.replace('#', a)} AS sample FROM each WHERE i < {n} UNION ALL SELECT k, 2 * i + 1, {sample.replace('#', b)} FROM each WHERE i < {n}"


_STEP = "[7, 8, 9, 10, 11, 12, 13, 14, 16]"
_IMA = "CASE WHEN {c} & 8 <> 0 THEN -1 ELSE 1 END * (({s} >> 3) + CASE WHEN {c} & 4 <> 0 THEN {s} ELSE 0 END + CASE WHEN {c} & 2 <> 0 THEN {s} >> 1 ELSE 0 END + CASE WHEN {c} & 1 <> 0 THEN {s} >> 2 ELSE 0 END)"
_INDEX = "[0, 0, 0, 0, 2, 4, 6, 8, 0, 0, 0, 0, 2, 4, 6, 8]"

#: Name: content of a customer's number and name, decoder, samples that are compared, SQL for (k, i, sample).
CASES: dict[str, tuple[Callable[[int, str], bytes], str, int, str]] = {
    "spu": (lambda k, n: bytes([k % 13, 0]) + _body(n, 14), "spu", 28, _pairs(14, _SHIFTED.format("# * (1 << (12 - k % 13)::INT)"), True)),
    "brr": (lambda k, n: bytes([k % 13 << 4 | 1]) + _body(n, 8), "brr", 16, _pairs(8, "greatest(-16384, least(16383, (# * (1 << (k % 13)::INT)) >> 1))", False)),
    "dsp": (_dsp, "dsp", 14, _pairs(7, _SHIFTED.format("# * (1 << (k % 11)::INT)"), False)),
    "hps": (_hps, "hps", 14, _pairs(7, _SHIFTED.format("# * (1 << (k % 11)::INT)"), False)),
    "brstm": (_brstm, "brstm", 14, _pairs(7, _SHIFTED.format("# * (1 << (k % 11)::INT)"), False)),
    "vadpcm": (lambda k, n: bytes(32) + bytes([k % 12 << 4]) + _body(n, 8), "vadpcm", 16, _pairs(8, _SHIFTED.format("# * (1 << (k % 12)::INT)"), False)),
    "xa": (lambda k, n: bytes(4) + bytes([k % 13] * 8) + bytes(4) + _body(n, 112), "xa", 224, f"SELECT k, u * 28 + j AS i, {_SHIFTED.format('CASE WHEN u % 2 = 0 THEN ' + _LO + ' ELSE ' + _HI + ' END * (1 << (12 - k % 13)::INT)')} AS sample FROM (SELECT e.k, e.byte, r.r AS j, c.c AS u FROM range(28) r(r), range(8) c(c), each e WHERE e.i = (4 * r.r + c.c // 2) % 18)"),
    "dtk": (lambda k, n: bytes([k % 13, k % 5, 0, 0]) + _body(n, 28), "dtk", 36, f"SELECT k, 2 * i AS i, ({_HI} * 4096) >> (k % 13)::INT AS sample FROM each UNION ALL SELECT k, 2 * i + 1, ({_LO} * 4096) >> (k % 5)::INT FROM each"),
    "adx": (_adx, "adx", 3, f"SELECT k, u.i, u.s AS sample FROM (SELECT k, unnest([{{'i': 0, 's': a * g}}, {{'i': 1, 's': b * g + 2 * a * g}}, {{'i': 2, 's': c * g + 2 * (b * g + 2 * a * g) - a * g}}]) AS u FROM (SELECT k, k % 50 AS g, max(CASE WHEN i = 0 THEN {_HI} END) AS a, max(CASE WHEN i = 0 THEN {_LO} END) AS b, max(CASE WHEN i = 1 THEN {_HI} END) AS c FROM each GROUP BY 1))"),
    "ima": (lambda k, n: struct.pack("<hBB", k % 1000, 0, 0) + _body(n, 4), "ima", 3, f"SELECT k, u.i, u.s AS sample FROM (SELECT k, unnest([{{'i': 0, 's': x}}, {{'i': 1, 's': x + a}}, {{'i': 2, 's': x + a + ({_IMA.format(c='hi', s='s2')})}}]) AS u FROM (SELECT *, {_IMA.format(c='lo', s='7')} AS a, {_STEP}[({_INDEX}[lo + 1] + 1)::INT] AS s2 FROM (SELECT k, k % 1000 AS x, byte & 15 AS lo, byte >> 4 AS hi FROM each WHERE i = 0)))"),
    "microsoft": (lambda k, n: bytes([2]) + struct.pack("<hhh", 100, k % 1000, -5) + _body(n, 4), "microsoft", 4, f"SELECT k, u.i, u.s AS sample FROM (SELECT k, unnest([{{'i': 0, 's': -5}}, {{'i': 1, 's': k % 1000}}, {{'i': 2, 's': {_HI} * 100}}, {{'i': 3, 's': {_LO} * greatest(16, ({C.MS_FACTORS}[(byte >> 4) + 1] * 100) >> 8)}}]) AS u FROM each WHERE i = 0)"),
    "ncw": (_ncw, "ncw", 8, "SELECT a.k, a.i // 2 AS i, CASE WHEN b.byte > 127 THEN b.byte - 256 ELSE b.byte END * 256 + a.byte AS sample FROM each a JOIN each b ON a.k = b.k AND b.i = a.i + 1 WHERE a.i % 2 = 0 AND a.i < 16"),
    "fibonacci": (lambda k, n: b"\0\0" + _body(n, 18), "fibonacci", 36, f"SELECT k, i, ((t + 128) % 256 + 256) % 256 * 256 - 32768 AS sample FROM (SELECT k, j AS i, sum({C.FIBONACCI}[(CASE WHEN j % 2 = 0 THEN byte >> 4 ELSE byte & 15 END) + 1]) OVER (PARTITION BY k ORDER BY j)::BIGINT AS t FROM (SELECT k, byte, unnest([2 * i, 2 * i + 1]) AS j FROM each))"),
}
C.CODECS["impulse"] = lambda x: C._pcm16(np.frombuffer(C.impulse(x, 18), "<i1").tolist())
CASES["impulse"] = (_impulse, "impulse", 18, "SELECT k, i, ((t + 128) % 256 + 256) % 256 - 128 AS sample FROM (SELECT k, i, sum(CASE WHEN byte > 127 THEN byte - 256 ELSE byte END) OVER (PARTITION BY k ORDER BY i)::BIGINT AS t FROM each)")


def _decoded(case: str) -> Callable:
    build, codec, count, _ = CASES[case]

    def run(spark, d):
        files = S.built(B.table(spark, d, "customer"), "c_custkey", "c_name", build)
        rows = files.select("k", F.posexplode(C.samples_of(C.decoded(F.col("content"), codec))).alias("i", "sample"))
        return rows.where(F.col("i") < count).select("k", F.col("i").cast("bigint").alias("i"), F.col("sample").cast("bigint").alias("sample"))

    return run


_EACH = "each AS (SELECT c_custkey AS k, unnest(range(octet_length(encode(c_name))))::BIGINT AS i, unnest(list_transform(regexp_extract_all(hex(encode(c_name)), '..'), lambda x: ('0x' || x)::BIGINT)) AS byte FROM customer)"
for _case in CASES:
    QUERIES[f"decode_{_case}"] = _decoded(_case)
    ORACLES[f"decode_{_case}"] = f"WITH {_EACH} SELECT k::BIGINT AS k, i::BIGINT AS i, sample::BIGINT AS sample FROM ({CASES[_case][3]}) WHERE i < {CASES[_case][2]}"
