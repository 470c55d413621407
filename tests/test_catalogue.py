"""Catalogue operators and music functions on small tables."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import music
from tessera.operators import catalogue as C
from tessera.operators import search as S
from tessera.operators import text as X

ROWS = [
    ("/a/kick_Am_128", 0, "Am", 128.0, 2.0, 4),
    ("/a/pad_C_128", 0, "C", 128.0, 2.0, 4),
    ("/a/lead_Fsm_128", 0, "F#m", 128.0, 2.0, 4),
    ("/a/bass_Am_64", 0, "Am", 64.0, 2.0, 4),
    ("/a/perc_Am_200", 0, "Am", 200.0, 2.0, 4),
    ("/b/verbose_Am_128", 1, "A minor", 128.0, 2.0, 4),
    ("/b/drum", 1, None, 90.0, 0.5, None),
]


@pytest.fixture(scope="module")
def samples(spark):
    return spark.createDataFrame(ROWS, "path string, library int, key string, bpm double, duration double, acid_beats int")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_ranges():
    assert C.parse_range("120") == (120, 120) and C.parse_range(":130") == (None, 130) and C.parse_range("120:") == (120, None)
    with pytest.raises(ValueError):
        C.parse_range("fast")


def test_compatible(samples):
    got = [(r.path, r.compatibility) for r in S.find_compatible(samples, "Am", 128.0).collect()]
    assert got == [("/a/kick_Am_128", "same key, same tempo"), ("/b/verbose_Am_128", "same key, same tempo"), ("/a/bass_Am_64", "same key, half-time"), ("/a/pad_C_128", "relative, same tempo")]
    assert [r.path for r in S.find_compatible(samples, None, 90.0).collect()] == ["/b/drum"]
    assert S.find_compatible(samples, "Am", 128.0, half_double=False, same_key_only=True).count() == 2


def test_no_limit_before_the_key_test(spark):
    rows = [(f"/x/{i:04}", 0, "Gm", 128.0, 4.0, 8) for i in range(250)] + [(f"/y/{i}", 0, "Am", 128.0, 4.0, 8) for i in range(5)]
    df = spark.createDataFrame(rows, "path string, library int, key string, bpm double, duration double, acid_beats int")
    assert S.find_compatible(df, "Am", 128.0, limit=20).count() == 5


def test_names(spark):
    names = {"Kick_128.wav": 128, "120.5.wav": None, "Kick_909.wav": None, "Take_02.wav": None, "Pack_03_126_A#": 126, "91V_SBH_x_126_.wav": 126, "90bpm.wav": 90}
    for name, bpm in names.items():
        assert one(spark, music.bpm_from_filename(F.lit(name))) == bpm, name
    keys = {"F#M.wav": "F#", "FM.wav": None, "Am.wav": "Am", "Eb minor.wav": "D#m"}
    for name, key in keys.items():
        assert one(spark, music.key_from_filename(F.lit(name))) == key, name
    assert one(spark, music.key_from_path(F.lit("/p/min_C/x.wav"))) == "Cm"


def test_wheel(spark):
    for key, code in {"C": "8B", "Am": "8A", "F#": "2B", "Db": "3B", "8A": "8A", "C4": "8B", "A minor": "8A", "FM": "7B", "H": None, "13A": None}.items():
        assert one(spark, music.camelot(F.lit(key))) == code, key
    assert one(spark, music.camelot_neighbours(F.lit("12B"))) == ["12B", "12A", "11B", "1B"]
    assert one(spark, music.camelot_neighbours(F.lit("x"))) == []
    assert one(spark, music.enharmonics(F.lit("C#m"))) == ["C#m", "Dbm"]
    assert one(spark, music.note_name(F.lit(60))) == "C3"


def test_tempo_choice(spark):
    pick = lambda a, b: tuple(one(spark, music.improve_bpm(F.lit(a).cast("double"), F.lit(b).cast("double"))))
    assert pick(128, 120) == (128, "detected") and pick(64, 128) == (128, "corrected") and pick(304, None) == (None, "rejected")
    assert pick(None, 90) == (90, "filename") and pick(None, None) == (None, None) and pick(190, 90) == (95, "corrected")


def test_text_match(spark):
    df = spark.createDataFrame([(1, "Booming sub, KICK one"), (2, "closed hat"), (3, "dusty synth"), (4, None)], "id int, text string")
    ids = lambda q: sorted(r.id for r in X.match_text(df, q).collect())
    assert ids("kick sub") == [1] and ids('"closed hat"') == [2] and ids("dust*") == [3] and ids("hat OR kick") == [1, 2] and ids("hat NOT closed") == []
    with pytest.raises(ValueError):
        X.match_text(df, '"open')


def test_tags_and_upserts(spark):
    tags = spark.createDataFrame([("a", "Kick"), ("a", "drums"), ("b", "kick"), ("b", "KICK")], "path string, tag string")
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "path string, v int")
    assert [r.path for r in C.with_tags(rows, tags, ["KICK", "Drums"]).collect()] == ["a"]
    new = spark.createDataFrame([("b", 9), ("d", 4)], "path string, v int")
    assert sorted(map(tuple, C.upsert(rows, new).collect())) == [("a", 1), ("b", 9), ("c", 3), ("d", 4)]
    added = spark.createDataFrame([("a", " punchy "), ("a", "  ")], "path string, tag string")
    assert sorted(r.tag for r in C.set_tags(tags, added, replace=True).where("path = 'a'").collect()) == ["punchy"]


def test_stems():
    """Words of Porter's own examples."""
    pairs = {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "conflated": "conflat", "hopping": "hop", "hissing": "hiss", "filing": "file", "happy": "happi", "relational": "relat", "conditional": "condit", "vietnamization": "vietnam", "triplicate": "triplic", "hopefulness": "hope", "revival": "reviv", "adjustable": "adjust", "adoption": "adopt", "probate": "probat", "controll": "control", "sky": "sky"}
    assert {w: X.stem(w) for w in pairs} == pairs


def test_query_grammar(spark):
    rows = ["alpha", "beta", "beta gamma", "gamma alpha delta", "delta"]
    df = spark.createDataFrame(list(enumerate(rows)), "id int, text string")
    ids = lambda q: sorted(r.id for r in X.match_text(df, q).collect())
    assert ids("alpha OR beta gamma") == [0, 2, 3] and ids("alpha OR beta AND gamma") == [0, 2, 3]
    assert ids("(alpha OR beta) AND gamma") == [2, 3] and ids("gamma NOT alpha delta") == [2] and ids("gamma NOT (beta OR alpha)") == []
    for wrong in ("NOT alpha", "alpha AND", '"open', "(alpha", "alpha )", "...", ""):
        assert X.message(wrong)
        with pytest.raises(X.SyntaxMessage):
            X.match_text(df, wrong)
    assert X.message("alpha") is None
    with pytest.raises(X.SyntaxMessage):
        X.match_text(df, "title:alpha")
