"""Queries over scalar functions, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import bytes as Y
from tessera.functions import music
from tessera.functions import values as V
from tessera.sources import bindings as B

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None, *tables: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = ("WITH " + ", ".join(tables) + " " if tables else "") + sql
        return f

    return add


def _le(x: str, n: int) -> str:
    return "unhex(" + " || ".join(f"printf('%02X', ({x} >> {8 * i}) & 255)" for i in range(n)) + ")"


@query(f"SELECT o_orderkey, hex({_le('o_orderkey', 4)}) AS le, printf('%08X', o_orderkey) AS be, printf('%04X', o_orderkey % 65536) AS narrow, o_orderkey AS back FROM orders")
def encoded_values(spark, d):
    k = F.col("o_orderkey")
    raw = V.encode_value(k, "u32")
    return B.table(spark, d, "orders").select("o_orderkey", F.hex(raw).alias("le"), F.hex(V.encode_value(k, "u32", True)).alias("be"), F.hex(V.encode_value(k % 65536, "u16", True)).alias("narrow"), V.decode_value(raw, "u32").alias("back"))


@query("SELECT o_orderkey, ((o_orderkey & 255) << 24) | (((o_orderkey >> 8) & 255) << 16) | (((o_orderkey >> 16) & 255) << 8) | ((o_orderkey >> 24) & 255) AS swapped, o_orderkey AS plain FROM orders")
def both_orders(spark, d):
    raw = V.encode_value(F.col("o_orderkey"), "u32")
    both = V.decode_both(raw, "u32")
    return B.table(spark, d, "orders").select("o_orderkey", both["be"].alias("swapped"), both["le"].alias("plain"))


@query("SELECT c_custkey, split_part(c_name, '#', 1) AS head, lower(hex(encode(substr(c_name, 3, 4)))) AS middle FROM customer")
def decoded_specs(spark, d):
    raw = F.concat(F.encode(F.split_part("c_name", F.lit("#"), F.lit(1)), "UTF-8"), F.unhex(F.lit("00")), F.encode("c_name", "UTF-8"))
    t = B.table(spark, d, "customer")
    return t.select("c_custkey", V.decode_value(raw, "cstr").alias("head"), V.decode_value(F.encode("c_name", "UTF-8"), "bytes:4", 2).alias("middle"))


@query("SELECT p_partkey, p_partkey::DOUBLE AS value, CASE p_partkey % 4 WHEN 0 THEN CASE WHEN p_partkey % 65536 < 65536 THEN '<I' END WHEN 1 THEN '<f' WHEN 2 THEN '<d' ELSE '>I' END AS encoding FROM part WHERE p_partkey > 0")
def inferred_encodings(spark, d):
    """Of numbers that were packed four ways, which format each was packed with."""
    t = B.table(spark, d, "part").where("p_partkey > 0").select("p_partkey", F.col("p_partkey").cast("double").alias("value"))
    parts = [V.packed(t.where(f"p_partkey % 4 = {i}"), "p_partkey", "value", kind, big) for i, (kind, big) in enumerate([("u32", False), ("f32", False), ("f64", False), ("u32", True)])]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return V.infer_encoding(rows, "p_partkey", "value", "raw")


@query("SELECT o_orderkey, (o_orderkey & ~240::BIGINT) | ((o_custkey % 16) << 4) AS applied FROM orders")
def bitfield_set(spark, d):
    return B.table(spark, d, "orders").select("o_orderkey", V.bitfield_apply(F.col("o_orderkey"), 4, 4, F.col("o_custkey") % 16).alias("applied"))




_TABLE8 = "list_transform(range(256), lambda b: " + "(list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 128 <> 0 THEN xor(c << 1, 7) & 255 ELSE (c << 1) & 255 END)))"
_TABLE16 = "list_transform(range(256), lambda b: " + "(list_reduce(list_prepend(b << 8, range(8)), lambda c, i: CASE WHEN c & 32768 <> 0 THEN xor(c << 1, 32773) & 65535 ELSE (c << 1) & 65535 END)))"


@query(f"SELECT n_nationkey, list_reduce(list_prepend(0::BIGINT, b), lambda c, x: t8[xor(c, x) + 1])::INT AS crc8, list_reduce(list_prepend(0::BIGINT, b), lambda c, x: xor(t16[xor(c >> 8, x) + 1], (c << 8) & 65535))::INT AS crc16 FROM (SELECT n_nationkey, list_transform(regexp_extract_all(hex(encode(n_name)), '..'), lambda x: ('0x' || x)::BIGINT) AS b, {_TABLE8} AS t8, {_TABLE16} AS t16 FROM nation)")
def frame_checks(spark, d):
    return V.checks(B.table(spark, d, "nation"), "n_nationkey", "n_name")


_SCALES = [("absolute", "greatest(0, least(1, (value - 0) / CASE WHEN hi = 0 THEN 1 ELSE hi END))"), ("auto", "CASE WHEN hi - lo < 1e-9 THEN 0 ELSE (value - lo) / (hi - lo) END"), ("log", "greatest(0, least(1, ln(1 + greatest(0, value)) / CASE WHEN hi <= 0 THEN 1 ELSE ln(1 + hi) END))")]


@query(" UNION ALL ".join(f"SELECT event_id, '{mode}' AS mode, round({sql}, 6) AS scaled FROM (SELECT *, min(value) OVER (PARTITION BY event_type) AS lo, max(value) OVER (PARTITION BY event_type) AS hi FROM events)" for mode, sql in _SCALES))
def axis_scales(spark, d):
    e = B.table(spark, d, "events")
    out = None
    for mode, _ in _SCALES:
        part = V.scaled(e, ["event_type"], "value", mode).select("event_id", F.lit(mode).alias("mode"), "scaled")
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT p_partkey, (SELECT min(r) FROM unnest([8000, 11025, 16000, 22050, 32000, 44100, 48000, 88200, 96000, 176400, 192000]) u(r) WHERE round_even(r * 0.03, 0) >= p_partkey % 6000) AS rate FROM part WHERE p_partkey % 6000 > 0")
def grain_rates(spark, d):
    return B.table(spark, d, "part").where("p_partkey % 6000 > 0").select("p_partkey", V.sample_rate_for(F.col("p_partkey") % 6000).alias("rate"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN named IS NULL OR detected = named THEN detected ELSE named END AS key, CASE WHEN named IS NULL THEN 'detected' WHEN detected IS NULL THEN 'filename' WHEN detected = named THEN 'detected' ELSE 'filename' END AS origin FROM (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 5 > 0 THEN 'C' || (l_partkey % 3) END AS detected, CASE WHEN l_linenumber % 3 > 0 THEN 'C' || (l_linenumber % 3) END AS named FROM lineitem)")
def picked_keys(spark, d):
    detected = F.when(F.col("l_partkey") % 5 > 0, F.concat(F.lit("C"), F.col("l_partkey") % 3))
    named = F.when(F.col("l_linenumber") % 3 > 0, F.concat(F.lit("C"), F.col("l_linenumber") % 3))
    return B.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", V.pick_key(detected, named).alias("p")).select("l_orderkey", "l_linenumber", "l_partkey", "p.*")


@query(f"SELECT n::BIGINT AS note, CASE WHEN n = 0 THEN NULL ELSE n END::BIGINT AS root, {music.PITCHES}[(n % 12 + 1)::INT] AS pitch_class FROM (SELECT DISTINCT p_partkey % 128 AS n FROM part)")
def note_classes(spark, d):
    n = (F.col("p_partkey") % 128).alias("note")
    return B.table(spark, d, "part").select(n).distinct().select("note", V.root_or_none(F.col("note")).alias("root"), V.note_class(F.col("note")).alias("pitch_class"))


_NAMES = {"Am": "Am,C,Dm,Em", "C": "Am,C,F,G", "F#m": "A,Bm,C#m,F#m", "Db": "A#m,C#,F#,G#", "8B": "Am,C,F,G", "x": None}


@query("SELECT DISTINCT key, fits FROM (VALUES " + ", ".join(f"('{k}', {'NULL' if v is None else repr(v)})" for k, v in _NAMES.items()) + ") v(key, fits), nation")
def compatible_names(spark, d):
    keys = F.explode(F.array(*map(F.lit, _NAMES)))
    return B.table(spark, d, "nation").select(keys.alias("key")).distinct().select("key", F.array_join(V.compatible_keys(F.col("key")), ",").alias("fits"))


@query("SELECT page_id, regexp_replace(regexp_replace(regexp_replace(u, '/+', '/', 'g'), '(/\\.)+/', '/', 'g'), '(.)/$', '\\1') AS path, sha1(regexp_replace(regexp_replace(regexp_replace(u, '/+', '/', 'g'), '(/\\.)+/', '/', 'g'), '(.)/$', '\\1'))[1:12] AS hash, coalesce(nullif(trim(regexp_replace(u, '[^A-Za-z0-9_.\\-]+', '_', 'g'), '_'), ''), 'library') AS label FROM (SELECT page_id, replace(coalesce(url, ''), ':', '//./') || '//' AS u FROM pages)")
def safe_names(spark, d):
    u = F.concat(F.replace(F.coalesce("url", F.lit("")), F.lit(":"), F.lit("//./")), F.lit("//"))
    return B.table(spark, d, "pages").select("page_id", u.alias("u")).select("page_id", V.normal_path(F.col("u")).alias("path"), V.path_hash(F.col("u")).alias("hash"), V.safe_label(F.col("u")).alias("label"))


@query("SELECT c_custkey, 'out/' || regexp_replace(c_name || ' x', '[^A-Za-z0-9._\\-]+', '_', 'g') || '.csv' AS name FROM customer")
def csv_names(spark, d):
    return B.table(spark, d, "customer").select("c_custkey", V.csv_name(F.concat(F.lit("out/"), "c_name", F.lit(" x"))).alias("name"))


@query("SELECT root, CASE WHEN a = 1 THEN label WHEN b = 1 THEN second ELSE label || '_' || sha1(root)[1:6] END AS unique_label FROM (SELECT *, row_number() OVER (PARTITION BY a = 1, second ORDER BY root) AS b FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY root) AS a, label || '_' || regexp_extract(root, '([^/]*)/[^/]*$', 1) AS second FROM (SELECT DISTINCT '/vol' || (p_partkey % 7) || '/' || p_brand || '/' || p_type AS root, p_brand AS label FROM part)))")
def unique_library_labels(spark, d):
    t = B.table(spark, d, "part")
    roots = t.select(F.concat(F.lit("/vol"), F.col("p_partkey") % 7, F.lit("/"), "p_brand", F.lit("/"), "p_type").alias("root"), F.col("p_brand").alias("label")).distinct()
    return V.unique_labels(roots).select("root", "unique_label")


@query("SELECT event_id, v[1] AS v0, v[2] AS v1, v[3] AS v2 FROM (SELECT event_id, list_transform(['value', 'absent', 'k'], lambda n: CASE n WHEN 'value' THEN value WHEN 'k' THEN coalesce((props::JSON->>'k')::DOUBLE, 0) ELSE 0 END) AS v FROM events)")
def projected_vectors(spark, d):
    e = B.table(spark, d, "events")
    m = F.create_map(F.lit("value"), F.col("value"), F.lit("k"), F.get_json_object("props", "$.k").cast("double"), F.lit("odd"), F.lit(float("nan")))
    v = e.select("event_id", V.projected_vector(m, ["value", "absent", "k"]).alias("v"))
    return v.select("event_id", *[F.get("v", i).alias(f"v{i}") for i in range(3)])


@query("SELECT vec_id, octet_length(unhex(repeat('00', 4 * len(embedding))))::INT AS n_bytes, embedding[1] AS first, embedding[len(embedding)] AS last FROM embeddings WHERE embedding IS NOT NULL")
def packed_vectors(spark, d):
    t = B.table(spark, d, "embeddings").where("embedding is not null")
    raw = t.select("vec_id", V.pack_vector(F.col("embedding")).alias("raw"))
    back = raw.select("vec_id", F.octet_length("raw").alias("n_bytes"), V.unpack_vector(F.col("raw")).alias("back"))
    return back.select("vec_id", "n_bytes", F.get("back", 0).alias("first"), F.element_at("back", -1).alias("last"))


@query("SELECT doc_id, i::INT AS index, ('0x' || substr(h, 4 * i::INT + 3, 2) || substr(h, 4 * i::INT + 1, 2))::INT::DOUBLE AS value FROM (SELECT doc_id, hex(encode(left(coalesce(text, ''), 40))) AS h FROM documents), range(8) r(i) WHERE length(h) >= 4 * i + 4")
def read_series(spark, d):
    t = B.table(spark, d, "documents").select("doc_id", F.substring(F.coalesce("text", F.lit("")), 1, 40).alias("data"))
    return Y.read_series(t, "doc_id", "data", 0, "u16", 8)


@query(f"SELECT p_partkey, list_sort(list_distinct(list_transform(range(0, 1), lambda i: {music.PITCHES}[(p_partkey % 12 + 1)::INT])))[1] AS name, [1, 2, 1, 2, 2, 1, 2, 1, 2, 1, 2, 2][(p_partkey % 12 + 1)::INT] AS spellings FROM part")
def enharmonic_names(spark, d):
    """How many spellings each pitch class has, with flats for the sharps and for B and E."""
    t = B.table(spark, d, "part").withColumn("name", F.get(F.array(*map(F.lit, music.PITCHES)), (F.col("p_partkey") % 12).cast("int")))
    return t.select("p_partkey", "name", F.size(music.enharmonics(F.col("name"))).alias("spellings"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN b <= 0 THEN NULL WHEN l_returnflag <> 'A' THEN b WHEN abs(b * 60.0 / 120 - l_quantity) <= 0.15 * l_quantity THEN b END AS beats FROM (SELECT *, l_partkey % 64 AS b FROM lineitem)")
def vetted_beats(spark, d):
    t = B.table(spark, d, "lineitem")
    beats = music.effective_beats(F.col("l_partkey") % 64, F.col("l_returnflag") == "A", F.lit(120.0), F.col("l_quantity"))
    return t.select("l_orderkey", "l_linenumber", "l_partkey", beats.alias("beats"))


_SIGNATURES = ["Cb", "Gb", "Db", "Ab", "Eb", "Bb", "F", "C", "G", "D", "A", "E", "B", "F#", "C#", "Abm", "Ebm", "Bbm", "Fm", "Cm", "Gm", "Dm", "Am", "Em", "Bm", "F#m", "C#m", "G#m", "D#m", "A#m"]


@query(f"SELECT s::INT AS sharps, m::INT AS minor, {_SIGNATURES}[(s + 8 + 15 * m)::INT] AS name FROM range(-7, 8) r(s), range(2) q(m), (SELECT 1 FROM region LIMIT 1)")
def key_signatures(spark, d):
    s = B.table(spark, d, "region").limit(1).select(F.explode(F.sequence(F.lit(-7), F.lit(7))).alias("sharps")).select("sharps", F.explode(F.array(F.lit(0), F.lit(1))).alias("minor"))
    return s.select("sharps", "minor", music.key_signature(F.col("sharps"), F.col("minor")).alias("name"))


@query("SELECT o_orderkey, (o_orderkey & 127) + ((o_orderkey >> 8) & 127) * 128 + ((o_orderkey >> 16) & 127) * 16384 + ((o_orderkey >> 24) & 127) * 2097152 AS value FROM orders")
def synchsafe_reads(spark, d):
    return B.table(spark, d, "orders").select("o_orderkey", Y.synchsafe(V.encode_value(F.col("o_orderkey"), "u32", True), 0).alias("value"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 256 BETWEEN 32 AND 126 THEN 'abc' || chr((o_orderkey % 256)::INT) ELSE 'hex:616263' || printf('%02x', o_orderkey % 256) END AS tag FROM orders")
def safe_fourccs(spark, d):
    raw = F.concat(F.encode(F.lit("abc"), "UTF-8"), V.encode_value(F.col("o_orderkey") % 256, "u8"))
    return B.table(spark, d, "orders").select("o_orderkey", V.safe_fourcc(raw).alias("tag"))


_QUERIES = {"alpha beta": True, "alpha AND": False, '"open': False, "(a OR b) c*": True, "NOT a": False, "title:x": True, "...": False, "a )": False}


@query("SELECT q, ok FROM (VALUES " + ", ".join("('" + q.replace("'", "''") + f"', {str(ok).lower()})" for q, ok in _QUERIES.items()) + ") v(q, ok), (SELECT 1 FROM region LIMIT 1)")
def syntax_messages(spark, d):
    from tessera.operators import text

    one = B.table(spark, d, "region").limit(1)
    return one.select(F.explode(F.array(*[F.struct(F.lit(q).alias("q"), F.lit(text.message(q) is None).alias("ok")) for q in _QUERIES])).alias("r")).select("r.*")


@query("SELECT n_nationkey, n_nationkey || ',' || n_name AS line FROM nation")
def csv_lines(spark, d):
    t = B.table(spark, d, "nation")
    return t.select("n_nationkey", F.to_csv(F.struct("n_nationkey", "n_name")).alias("line"))


@query("SELECT c_custkey, c_name || repeat(c_name[1:4], 3) AS text FROM customer")
def unpacked_texts(spark, d):
    """Literals and a match of the name's beginning, unpacked."""
    from tessera.sources.formats import fastlz

    def packed(k: int, name: str) -> bytes:
        raw = name.encode()
        # Literals in runs of up to 32, then a match of nine bytes and three literals; a match repeats four letters three times.
        out = bytes([len(raw) - 1]) + raw
        far = len(raw)
        return out + bytes([2 << 5 | (far - 1) >> 8, far - 1 & 255]) + bytes([6 << 5, 3])

    from tessera.sources import specimens as S

    rows = S.built(B.table(spark, d, "customer"), "c_custkey", "c_name", packed)
    return Y.each_value(rows, ["k"], ["content"], "text string", lambda x: iter([(fastlz(x).decode(),)])).select(F.col("k").alias("c_custkey"), "text")


@query("SELECT l_orderkey, l_linenumber, l_partkey, NOT (lower(n) LIKE '._%' ESCAPE '!' OR lower(n) IN ('.ds_store', 'thumbs.db', 'desktop.ini')) AS kept FROM (SELECT *, ['._a.wav', '.DS_Store', 'Thumbs.db', 'a.wav', 'b_.wav'][l_partkey % 5 + 1] AS n FROM lineitem)")
def junk_names(spark, d):
    from tessera.sources import walk

    name = F.get(F.array(*map(F.lit, ["._a.wav", ".DS_Store", "Thumbs.db", "a.wav", "b_.wav"])), (F.col("l_partkey") % 5).cast("int"))
    return B.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (~walk.junk(name)).alias("kept"))
