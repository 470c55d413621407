"""Codecs against hand-made blocks."""

import struct

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import codecs
from tessera.sources import walk as K


def test_codecs():
    assert np.frombuffer(codecs.ima(struct.pack("<hBB", 100, 0, 0) + b"\x00" * 4, 8), "<i2").tolist() == [100] * 9
    up = np.frombuffer(codecs.ima(struct.pack("<hBB", 0, 0, 0) + b"\x77" * 20, 24), "<i2")
    assert (np.diff(up.astype(int)) >= 0).all() and up[-1] == 32767
    assert np.frombuffer(codecs.spu(b"\x00\x01" + b"\x11" * 14 + b"\xff" * 16), "<i2").tolist() == [4096] * 28
    assert np.frombuffer(codecs.fibonacci(b"\0\0" + b"\x9a"), "<i2").tolist() == [256, 768]
    assert codecs.pcm(b"\xff\xff\x01\x00\x05", 2).tolist() == [-1, 1] and codecs.pcm(b"\x00\x01", 2, True).tolist() == [1]
    for name in ("ima", "ima2", "microsoft", "spu", "xa", "dtk", "brr", "fibonacci", "wav"):
        assert codecs.CODECS[name](b"") == b""


def test_looped_blocks_go_on():
    """A block that ends and loops isn't the end, and shifts above 12 count as 9."""
    assert len(codecs.spu(b"\x00\x03" + bytes(14) + b"\x00\x03" + bytes(14))) == 2 * 56
    assert np.frombuffer(codecs.spu(b"\x0d\x01" + b"\x77" * 14), "<i2").tolist() == [56] * 28


def test_prediction_against_plain_formulas():
    rng = np.random.default_rng(2)
    body = rng.integers(0, 256, 16 * 6, dtype=np.uint8)
    body[::16], body[1::16] = [0x10, 0x24, 0x35, 0x41, 0x0C, 0x22], 0
    one = two = 0
    want = []
    for at in range(0, len(body), 16):
        a, b = codecs.SPU_FILTERS[body[at] >> 4]
        for byte in body[at + 2 : at + 16].tolist():
            for code in (byte & 15, byte >> 4):
                r = (code - 16 if code > 7 else code) * 2 ** (12 - int(body[at] & 15))
                one, two = max(-32768, min(32767, r + ((one * a + two * b + 32) >> 6))), one
                want.append(one)
    assert np.frombuffer(codecs.spu(body.tobytes()), "<i2").tolist() == want


def test_wave_files_of_all_widths():
    from tessera.sources.walk import walk_bytes

    head = lambda tag, bits, body: b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, tag, 1, 8000, 8000 * bits // 8, bits // 8, bits) + b"data" + struct.pack("<I", len(body)) + body
    read = lambda x: np.frombuffer(codecs.wav_to_pcm(x), "<i2").tolist()
    assert read(head(1, 8, bytes([128, 255, 0]))) == [0, 32512, -32768]
    assert read(head(1, 24, bytes([0, 0, 64, 0, 0, 192]))) == [16384, -16384]
    assert read(head(3, 32, struct.pack("<3f", 0.5, -1, 7))) == [16384, -32767, 32767]
    assert codecs.wav_to_pcm(b"no wave") is None
    smf = codecs.notes_to_smf([(60, 0, 1, 100), (64, 1, 0.5, 90)], 90)
    assert walk_bytes(smf)[1][1][3] == {"events": 6, "notes": 2, "ticks": 720, "tempo": 90.0}


def test_columns(spark):
    df = spark.createDataFrame([(1, b"\0\0\x9a"), (2, None)], "id int, c binary")
    got = df.select("id", codecs.wav_of(codecs.decoded(F.col("c"), "fibonacci"), 8000).alias("w")).collect()
    assert K.walk_bytes(bytes(got[0].w))[1][1][3]["frames"] == 2 and got[1].w is None
