"""Catalogue queries and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import music
from tessera.operators import catalogue as C
from tessera.operators import search as S
from tessera.operators import text as X
from tessera.sources import bindings as B

QUERIES, ORACLES = {}, {}
COLUMNS = ["path", "library", "bpm", "key", "duration", "acid_beats", "format", "size"]
COLS = ", ".join(COLUMNS)


def query(sql: str | None = None, *tables: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = ("WITH " + ", ".join(tables) + " " if tables else "") + sql
        return f

    return add


@query(f"SELECT {COLS} FROM samples WHERE bpm BETWEEN 120 AND 130 AND lower(key) = 'am' AND lower(format) = 'wav'", B.SAMPLES)
def search_samples(spark, d):
    return B.samples(spark, d).where(C.build_filter(bpm="120:130", key="AM", format="WAV")).orderBy("path", "library", "size")


@query(f"SELECT {COLS} FROM samples WHERE bpm >= 180 AND duration <= 0.3", B.SAMPLES)
def filter_open_ranges(spark, d):
    return B.samples(spark, d).where(C.build_filter(bpm="180:", duration=":0.3"))


@query(f"SELECT {COLS} FROM samples WHERE bpm = 120", B.SAMPLES)
def filter_exact_bpm(spark, d):
    return B.samples(spark, d).where(C.build_filter(bpm="120"))


@query("SELECT count(*)::BIGINT AS n, count(*) FILTER (WHERE key IS NULL)::BIGINT AS keyless, count(*) FILTER (WHERE bpm IS NULL)::BIGINT AS tempoless FROM samples", B.SAMPLES)
def null_counts(spark, d):
    return B.samples(spark, d).agg(F.count("*").cast("bigint").alias("n"), F.count_if(F.col("key").isNull()).cast("bigint").alias("keyless"), F.count_if(F.col("bpm").isNull()).cast("bigint").alias("tempoless"))


@query("SELECT * FROM (SELECT path, library, bpm, size, (SELECT count(*) FROM samples WHERE bpm BETWEEN 100 AND 110)::BIGINT AS total_matched, (SELECT count(*) FROM samples WHERE bpm BETWEEN 100 AND 110) > 50 AS truncated FROM samples WHERE bpm BETWEEN 100 AND 110 ORDER BY path, library, size LIMIT 50)", B.SAMPLES)
def page_with_total(spark, d):
    return C.page(B.samples(spark, d).where(C.build_filter(bpm="100:110")).select("path", "library", "bpm", "size"), ["path", "library", "size"], 50)


@query("SELECT p.p_partkey, p.p_name FROM part p WHERE '/part/' || p_partkey IN (SELECT path FROM tags WHERE lower(tag) IN ('widget', 'small') GROUP BY path HAVING count(DISTINCT lower(tag)) = 2)", B.TAGS)
def tags_all(spark, d):
    parts = B.table(spark, d, "part").withColumn("path", F.concat(F.lit("/part/"), "p_partkey"))
    return C.with_tags(parts, B.tags(spark, d), ["WIDGET", "small", "Widget"]).select("p_partkey", "p_name")


@query("SELECT tag, count(*)::BIGINT AS n FROM tags GROUP BY 1", B.TAGS)
def list_tags(spark, d):
    return C.histogram(B.tags(spark, d), "tag")


@query("SELECT tag, count(*)::BIGINT AS n FROM tags WHERE tag ILIKE 's%' GROUP BY 1", B.TAGS)
def list_tags_prefix(spark, d):
    return C.histogram(B.tags(spark, d).where(F.expr("tag ilike 's%'")), "tag")


@query("SELECT key, count(*)::BIGINT AS n FROM samples WHERE key IS NOT NULL GROUP BY 1", B.SAMPLES)
def list_keys(spark, d):
    return C.histogram(B.samples(spark, d), "key")


@query("SELECT format, count(*)::BIGINT AS n FROM samples WHERE format IS NOT NULL GROUP BY 1", B.SAMPLES)
def list_formats(spark, d):
    return C.histogram(B.samples(spark, d), "format")


@query("SELECT library, format, count(*)::BIGINT AS n, count(key)::BIGINT AS keyed, count(DISTINCT path)::BIGINT AS paths, round(avg(bpm), 6) AS mean_bpm FROM samples GROUP BY 1, 2", B.SAMPLES)
def index_stats(spark, d):
    return B.samples(spark, d).groupBy("library", "format").agg(F.count("*").cast("bigint").alias("n"), F.count("key").cast("bigint").alias("keyed"), F.count_distinct("path").cast("bigint").alias("paths"), F.round(F.avg("bpm"), 6).alias("mean_bpm"))


@query("SELECT library, count(*)::BIGINT AS n, max(size) AS largest, sum(size)::BIGINT AS bytes FROM samples GROUP BY 1", B.SAMPLES)
def library_rollup(spark, d):
    return B.samples(spark, d).groupBy("library").agg(F.count("*").cast("bigint").alias("n"), F.max("size").alias("largest"), F.sum("size").cast("bigint").alias("bytes"))


@query("SELECT library, format, grouping(library)::BIGINT AS all_libraries, grouping(format)::BIGINT AS all_formats, count(*)::BIGINT AS n FROM samples GROUP BY CUBE (library, format)", B.SAMPLES)
def stats_cube(spark, d):
    return B.samples(spark, d).cube("library", "format").agg(F.grouping("library").cast("bigint").alias("all_libraries"), F.grouping("format").cast("bigint").alias("all_formats"), F.count("*").cast("bigint").alias("n"))


@query("SELECT path, library, size FROM samples WHERE path ILIKE '%PACK1!_%' ESCAPE '!' OR path ILIKE '%/pack1/s1%'", B.SAMPLES)
def locate_substring(spark, d):
    rows = B.samples(spark, d)
    return C.locate(rows, "PACK1_").unionByName(C.locate(rows, "/PACK1/S1")).select("path", "library", "size")


@query("SELECT root, label FROM libraries WHERE label = 'x' OR root = '/lib1' OR starts_with(root || '/', '/lib1/') OR starts_with('/lib1/', root || '/')", B.SAMPLES, B.LIBRARIES)
def scope_overlap(spark, d):
    return C.in_scope(B.libraries(spark, d), "/lib1/")


@query(f"SELECT {COLS} FROM samples QUALIFY row_number() OVER (PARTITION BY path ORDER BY library, size, bpm, duration, acid_beats, key, format) = 1", B.SAMPLES)
def dedup_first(spark, d):
    return C.first_of_path(B.samples(spark, d), F.col("library"), F.col("size"), F.asc_nulls_last("bpm"), F.col("duration"), F.asc_nulls_last("acid_beats"), F.asc_nulls_last("key"), F.asc_nulls_last("format"))


@query("SELECT path, root FROM (SELECT DISTINCT path FROM samples) JOIN libraries ON starts_with(path, root || '/') QUALIFY row_number() OVER (PARTITION BY path ORDER BY length(root) DESC) = 1", B.SAMPLES, B.LIBRARIES)
def longest_prefix_owner(spark, d):
    return C.owners(B.samples(spark, d).select("path").distinct(), B.libraries(spark, d))


@query("SELECT a.root AS outer_root, b.root AS inner_root FROM libraries a JOIN libraries b ON starts_with(b.root, a.root || '/')", B.SAMPLES, B.LIBRARIES)
def root_overlap(spark, d):
    return C.overlaps(B.libraries(spark, d))


_HALVES = ("a AS (SELECT path, max(size) AS size FROM samples WHERE size % 2 = 0 OR size % 5 = 0 GROUP BY 1)", "b AS (SELECT path, max(size) * 10 AS size FROM samples WHERE size % 2 = 1 GROUP BY 1)")


def _halves(spark, d):
    s = B.samples(spark, d)
    a = s.where("size % 2 = 0 or size % 5 = 0").groupBy("path").agg(F.max("size").alias("size"))
    b = s.where("size % 2 = 1").groupBy("path").agg((F.max("size") * 10).alias("size"))
    return a, b


@query("SELECT * FROM b UNION ALL SELECT * FROM a WHERE path NOT IN (SELECT path FROM b)", B.SAMPLES, *_HALVES)
def upsert_merge(spark, d):
    old, new = _halves(spark, d)
    return C.upsert(old, new)


@query("SELECT path, size FROM a WHERE NOT (starts_with(path, '/lib2/') AND (size % 11 = 0 OR size < 1000))", B.SAMPLES, *_HALVES)
def prune_missing(spark, d):
    old, _ = _halves(spark, d)
    seen = old.withColumn("last_seen_at", F.when(F.col("size") % 11 != 0, F.col("size")))
    return C.prune(seen, "/lib2", F.lit(1000)).select("path", "size")


@query("SELECT path, size FROM a WHERE NOT starts_with(path, '/lib3/')", B.SAMPLES, *_HALVES)
def remove_root(spark, d):
    return C.remove_root(_halves(spark, d)[0], "/lib3")


@query("SELECT DISTINCT path, tag FROM (SELECT path, tag FROM tags UNION ALL SELECT '/part/' || p_partkey, 'Fresh' FROM part WHERE p_partkey % 3 = 0)", B.TAGS)
def tags_added(spark, d):
    new = B.table(spark, d, "part").where("p_partkey % 3 = 0").select(F.concat(F.lit("/part/"), "p_partkey").alias("path"), F.lit("  Fresh ").alias("tag"))
    return C.set_tags(B.tags(spark, d), new)


@query("SELECT DISTINCT path, tag FROM tags WHERE NOT (tag = 'PROMO' AND path IN (SELECT '/part/' || p_partkey FROM part WHERE p_partkey % 2 = 0))", B.TAGS)
def tags_removed(spark, d):
    gone = B.table(spark, d, "part").where("p_partkey % 2 = 0").select(F.concat(F.lit("/part/"), "p_partkey").alias("path"), F.lit("PROMO").alias("tag"))
    return C.remove_tags(B.tags(spark, d), gone).distinct()


@query("SELECT path, string_agg(tag, ' ' ORDER BY tag) AS words FROM tags GROUP BY 1", B.TAGS)
def tag_text(spark, d):
    return B.tags(spark, d).groupBy("path").agg(F.array_join(F.array_sort(F.collect_list("tag")), " ").alias("words"))


@query("SELECT path, library, CASE WHEN coalesce(acid_beats, 0) > 0 OR coalesce(duration, 0) >= 2 THEN 'loop' WHEN coalesce(duration, 0) < 1 AND coalesce(acid_beats, 0) <= 0 THEN 'one_shot' ELSE 'any' END AS kind FROM samples", B.SAMPLES)
def infer_kind(spark, d):
    return B.samples(spark, d).select("path", "library", music.infer_kind(F.col("duration"), F.col("acid_beats")).alias("kind"))


_W = "windows AS (SELECT * FROM (VALUES (128.0, 'same tempo', 0, 0), (64.0, 'half-time', 1, 1), (256.0, 'double-time', 2, 1)) t(c, tempo, ix, r))"
_N = "near AS (SELECT * FROM (VALUES ('Am', 'same key', 0), ('C', 'relative', 1), ('Em', 'perfect fifth', 2), ('Dm', 'perfect fourth', 3)) t(key, relation, r))"
_M = "matched AS (SELECT s.*, n.relation, w.tempo, n.r * 3 + w.r AS rank, round(abs(s.bpm - w.c), 6) AS bpm_dist FROM samples s JOIN near n USING (key) JOIN windows w ON s.bpm BETWEEN w.c * (1 - 0.06) AND w.c * (1 + 0.06) QUALIFY row_number() OVER (PARTITION BY path ORDER BY rank, bpm_dist, library) = 1)"


@query("SELECT path, library, bpm, key, relation || ', ' || tempo AS compatibility, rank::INT AS rank, bpm_dist::DOUBLE AS bpm_dist FROM matched", B.SAMPLES, _W, _N, _M)
def compatible_all(spark, d):
    return S.find_compatible(B.samples(spark, d), "Am", 128.0, limit=None).select("path", "library", "bpm", "key", "compatibility", "rank", "bpm_dist")


@query("SELECT path, library, bpm, key, relation || ', ' || tempo AS compatibility, rank::INT AS rank, bpm_dist::DOUBLE AS bpm_dist FROM matched ORDER BY rank, bpm_dist, path LIMIT 20", B.SAMPLES, _W, _N, _M)
def compatible_top(spark, d):
    return S.find_compatible(B.samples(spark, d), "A minor", 128.0, limit=20).select("path", "library", "bpm", "key", "compatibility", "rank", "bpm_dist")


@query("SELECT path, library, bpm, 'same tempo' AS compatibility FROM samples WHERE key IS NULL AND bpm BETWEEN 90 * (1 - 0.06) AND 90 * (1 + 0.06) AND (acid_beats > 0 OR duration >= 2) QUALIFY row_number() OVER (PARTITION BY path ORDER BY abs(bpm - 90), library) = 1", B.SAMPLES)
def compatible_keyless(spark, d):
    return S.find_compatible(B.samples(spark, d), None, 90.0, half_double=False, kind="loop", limit=None).select("path", "library", "bpm", "compatibility")


_SIM = (
    B.FEATURES,
    "cur AS (SELECT * FROM features WHERE version = 3)",
    "dims AS (SELECT vec_id, label, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS x FROM cur)",
    "mom AS (SELECT i, avg(x) AS m, CASE WHEN stddev_pop(x) = 0 THEN 1 ELSE stddev_pop(x) END AS s FROM dims GROUP BY 1)",
    "z AS (SELECT vec_id, label, i, (x - m) / s AS v FROM dims JOIN mom USING (i))",
    "t AS (SELECT i, v AS tv FROM z WHERE vec_id = 0)",
    "sim AS (SELECT vec_id, label, round(sum(v * tv) / (sqrt(sum(v * v)) * sqrt(sum(tv * tv))), 6) AS similarity FROM z JOIN t USING (i) WHERE vec_id <> 0 GROUP BY 1, 2)",
    "ranked AS (SELECT *, round(100.0 * (rank() OVER (ORDER BY similarity) - 1) / count(*) OVER (), 1)::DOUBLE AS percentile, round(similarity - avg(similarity) OVER (), 6) AS above_mean FROM sim)",
)


@query("SELECT vec_id, label, similarity, percentile, above_mean FROM ranked", *_SIM)
def similar_all(spark, d):
    return S.find_similar(B.features(spark, d), 0)


@query("SELECT vec_id, similarity FROM ranked ORDER BY similarity DESC, vec_id LIMIT 5", *_SIM)
def similar_top(spark, d):
    return S.find_similar(B.features(spark, d), 0).select("vec_id", "similarity").orderBy(F.desc("similarity"), "vec_id").limit(5)


@query("SELECT p.p_partkey AS id, f.version FROM part p LEFT JOIN features f ON f.vec_id = p.p_partkey WHERE f.vec_id IS NULL OR f.version <> 3", B.FEATURES)
def stale_features(spark, d):
    parts = B.table(spark, d, "part").select(F.col("p_partkey").alias("id"))
    f = B.features(spark, d).select(F.col("vec_id").alias("id"), "version")
    return parts.join(f, "id", "left").where("version is null or version <> 3")


@query(
    "SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 60 + o_orderkey % 200 WHEN 1 THEN 60 + o_orderkey % 200 WHEN 3 THEN 126 END::INT AS bpm FROM orders WHERE o_orderkey % 6 IN (0, 1, 2, 3, 4, 5)",
)
def bpm_from_name(spark, d):
    n = (60 + F.col("o_orderkey") % 200).cast("string")
    k = F.col("o_orderkey") % 6
    name = F.when(k == 0, F.concat(F.lit("/a/Loop_"), n, F.lit("bpm_x.wav"))).when(k == 1, F.concat(F.lit("/a/Kick_"), n, F.lit(".wav"))).when(k == 2, "/a/Kick_909.wav").when(k == 3, "/a/91V_SBH_03_126_A#.wav").when(k == 4, "/a/120.5.wav").otherwise("/a/Take_02.wav")
    return B.table(spark, d, "orders").select("o_orderkey", music.bpm_from_filename(name).alias("bpm"))


_NAMES = [("Pad_F#M.wav", "F#"), ("FM_Bass.wav", None), ("Lead_Am.wav", "Am"), ("Eb minor keys.wav", "D#m"), ("Bb maj7.wav", None), ("Chord C major.wav", "C"), ("x_G#min_y.wav", "G#m"), ("SCREAM.wav", None), ("D M lead.wav", "D"), ("Gbm.flac", "F#m")]


@query("SELECT l_orderkey, l_linenumber, l_partkey, list_extract([" + ", ".join("NULL" if k is None else f"'{k}'" for _, k in _NAMES) + "], (l_partkey % 10 + 1)::INT) AS key FROM lineitem")
def key_from_name(spark, d):
    name = F.get(F.array(*[F.lit(n) for n, _ in _NAMES]), (F.col("l_partkey") % 10).cast("int"))
    return B.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", music.key_from_filename(name).alias("key"))


_PATHS = [("/packs/Am/kick.wav", "Am"), ("/packs/min_C/kick.wav", "Cm"), ("/x/Maj7_D.wav", "D"), ("/x/Analog.wav", None), ("/E/a/b/c/kick.wav", None), ("/E/a/b/kick.wav", "E")]


@query("SELECT p_partkey, list_extract([" + ", ".join("NULL" if k is None else f"'{k}'" for _, k in _PATHS) + "], (p_partkey % 6 + 1)::INT) AS key FROM part")
def key_from_path(spark, d):
    name = F.get(F.array(*[F.lit(n) for n, _ in _PATHS]), (F.col("p_partkey") % 6).cast("int"))
    return B.table(spark, d, "part").select("p_partkey", music.key_from_path(name).alias("key"))


_CODES = {"C": "8B", "C#": "3B", "D": "10B", "D#": "5B", "E": "12B", "F": "7B", "F#": "2B", "G": "9B", "G#": "4B", "A": "11B", "A#": "6B", "B": "1B", "Cm": "5A", "C#m": "12A", "Dm": "7A", "D#m": "2A", "Em": "9A", "Fm": "4A", "F#m": "11A", "Gm": "6A", "G#m": "1A", "Am": "8A", "A#m": "3A", "Bm": "10A"}


@query("SELECT s.key, c.code, count(*)::BIGINT AS n FROM samples s JOIN (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in _CODES.items()) + ") c(key, code) USING (key) GROUP BY 1, 2", B.SAMPLES)
def camelot_codes(spark, d):
    return B.samples(spark, d).where("key is not null").groupBy("key").agg(F.count("*").cast("bigint").alias("n")).select("key", music.camelot(F.col("key")).alias("code"), "n")


@query("SELECT k AS code, [k || 'A', k || 'B', (CASE WHEN k = 1 THEN 12 ELSE k - 1 END) || 'A', (CASE WHEN k = 12 THEN 1 ELSE k + 1 END) || 'A'] AS neighbours FROM (SELECT DISTINCT (p_partkey % 12 + 1)::INT AS k FROM part)")
def camelot_neighbours(spark, d):
    k = B.table(spark, d, "part").select((F.col("p_partkey") % 12 + 1).cast("int").alias("code")).distinct()
    return k.select("code", music.camelot_neighbours(F.concat(F.col("code").cast("string"), F.lit("A"))).alias("neighbours"))


@query("SELECT DISTINCT p_partkey % 128 AS note, list_extract(['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'], (p_partkey % 128 % 12 + 1)::INT) || ((p_partkey % 128) // 12 - 2) AS name FROM part")
def note_names(spark, d):
    return B.table(spark, d, "part").select((F.col("p_partkey") % 128).alias("note")).distinct().select("note", music.note_name(F.col("note")).alias("name"))


@query("SELECT path, library, size, CASE WHEN bpm IS NOT NULL AND bpm NOT BETWEEN 60 AND 200 THEN 120 WHEN bpm IS NULL THEN 120 WHEN abs(bpm - 120) <= 20 THEN bpm WHEN abs(bpm * 2 - 120) <= 20 THEN bpm * 2 WHEN abs(bpm / 2 - 120) <= 20 THEN bpm / 2 WHEN abs(bpm * 1.5 - 120) <= 20 THEN bpm * 1.5 WHEN abs(bpm / 1.5 - 120) <= 20 THEN bpm / 1.5 ELSE 120 END::DOUBLE AS best FROM samples", B.SAMPLES)
def bpm_validated(spark, d):
    return B.samples(spark, d).select("path", "library", "size", music.improve_bpm(F.col("bpm"), F.lit(120.0))["bpm"].alias("best"))


def _oracle_key() -> str:
    profiles = {0: [6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88], 1: [6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17]}
    rows = ", ".join(f"({mode}, {r}, {(r + i) % 12}, {w})" for mode, p in profiles.items() for r in range(12) for i, w in enumerate(p))
    return f"WITH prof AS (SELECT * FROM (VALUES {rows}) t(mode, root, pc, w)), e AS (SELECT l_suppkey, l_partkey % 12 AS pc, sum(l_quantity) AS energy FROM lineitem GROUP BY 1, 2), full_e AS (SELECT s.l_suppkey, p.pc, coalesce(e.energy, 0) AS energy FROM (SELECT DISTINCT l_suppkey FROM lineitem) s CROSS JOIN (SELECT unnest(range(12)) AS pc) p LEFT JOIN e ON e.l_suppkey = s.l_suppkey AND e.pc = p.pc), sc AS (SELECT l_suppkey, mode, root, round(corr(energy, w), 6) AS r FROM full_e JOIN prof USING (pc) GROUP BY 1, 2, 3), best AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY r DESC, root + 12 * mode) = 1) SELECT b.l_suppkey, list_extract(['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'], b.root + 1) || CASE WHEN b.mode = 1 THEN 'm' ELSE '' END AS key, b.r AS correlation, round(b.r - (SELECT max(s.r) FROM sc s WHERE s.l_suppkey = b.l_suppkey AND s.root <> b.root), 6) AS margin FROM best b"


@query(_oracle_key())
def key_estimates(spark, d):
    chroma = B.table(spark, d, "lineitem").select("l_suppkey", (F.col("l_partkey") % 12).alias("pc"), F.col("l_quantity").alias("energy"))
    return S.estimate_key(chroma, "l_suppkey")


@query(_oracle_key().replace("SELECT b.l_suppkey, list_extract", "SELECT l_suppkey, key, round(greatest(0, least(1, margin / 0.15)), 6) AS confidence FROM (SELECT b.l_suppkey, list_extract") + ")")
def key_details(spark, d):
    chroma = B.table(spark, d, "lineitem").select("l_suppkey", (F.col("l_partkey") % 12).alias("pc"), F.col("l_quantity").alias("energy"))
    return S.estimate_key(chroma, "l_suppkey", detailed=True).select("l_suppkey", "key", "confidence")


_WORDS = "w AS (SELECT doc_id, ' ' || array_to_string(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> ''), ' ') || ' ' AS line FROM documents)"


@query("SELECT doc_id FROM w WHERE contains(line, ' the ') AND contains(line, ' of the ')", _WORDS)
def match_words(spark, d):
    return X.match_text(B.table(spark, d, "documents"), 'THE "of the"').select("doc_id")


@query("SELECT doc_id FROM w WHERE contains(line, ' que') OR (contains(line, ' und ') AND NOT contains(line, ' en '))", _WORDS)
def match_prefix(spark, d):
    return X.match_text(B.table(spark, d, "documents"), "que* OR und NOT en").select("doc_id")


@query("SELECT doc_id FROM w WHERE contains(line, ' the ') AND NOT (contains(line, ' of ') AND contains(line, ' and ')) AND (contains(line, ' in ') OR contains(line, ' to '))", _WORDS)
def match_grouped(spark, d):
    return X.match_text(B.table(spark, d, "documents"), "the NOT of and AND (in OR to)").select("doc_id")


@query("SELECT p_partkey FROM part WHERE p_type IN ('ECONOMY', 'MEDIUM') AND NOT regexp_matches(p_name, '(^| )small') AND regexp_matches(p_name, '(^| )(widget|bolt|gear)( |$)')")
def match_stemmed(spark, d):
    """Words by their stems, in one column or another."""
    return X.match_text(B.table(spark, d, "part"), "(p_type:economies OR p_type:mediums) NOT p_name:small* AND (widgets OR bolted OR gears)", ["p_type", "p_name"], stemmed=True).select("p_partkey")


@query("SELECT library, n, total, rank() OVER (ORDER BY n DESC, library)::INT AS place FROM (SELECT library, count(*)::BIGINT AS n, sum(count(*)) OVER ()::BIGINT AS total FROM samples WHERE lower(format) = 'wav' GROUP BY 1)", B.SAMPLES)
def fan_out_totals(spark, d):
    each = B.samples(spark, d).where(C.build_filter(format="wav")).groupBy("library").agg(F.count("*").cast("bigint").alias("n"))
    w = Window.orderBy(F.desc("n"), "library")
    return each.withColumns({"total": F.sum("n").over(Window.partitionBy()).cast("bigint"), "place": F.rank().over(w)})
