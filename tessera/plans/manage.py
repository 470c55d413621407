"""Queries over addresses, targets, owners and the registry of libraries, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import catalogue as C
from tessera.sources import bindings as B
from tessera.sources import walk as K

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None, *tables: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = ("WITH " + ", ".join(tables) + " " if tables else "") + sql
        return f

    return add


_FACT = "unnest(CASE WHEN has_fact THEN [{'o': 0, 'id': 'fmt ', 'a': 12, 's': 16}, {'o': 1, 'id': 'fact', 'a': 36, 's': 4}, {'o': 2, 'id': 'data', 'a': 48, 's': n}] ELSE [{'o': 0, 'id': 'fmt ', 'a': 12, 's': 16}, {'o': 1, 'id': 'data', 'a': 36, 's': n}] END)"
_CHUNKS = f"chunks AS (SELECT path, c.o::INT AS ordinal, c.id AS chunk_id, c.a::BIGINT AS \"offset\", c.s::BIGINT AS size, has_fact, n FROM (SELECT path, has_fact, n, {_FACT} AS c FROM riff))"


def _chunks(spark, d):
    return K.walk(B.riff_files(spark, d))


@query("SELECT path, size FROM samples WHERE bpm BETWEEN 90 AND 95 AND lower(format) = 'flac' ORDER BY path, size", B.SAMPLES)
def selected_rows(spark, d):
    return C.select_rows(B.samples(spark, d), C.build_filter(bpm="90:95", format="FLAC"), ["path", "size"])


@query("SELECT count(*)::BIGINT AS total_matched FROM samples WHERE bpm BETWEEN 90 AND 95", B.SAMPLES)
def counted_rows(spark, d):
    return C.count_rows(B.samples(spark, d), C.build_filter(bpm="90:95"))


@query("SELECT '{\"size\":' || size || CASE WHEN key IS NULL THEN '' ELSE ',\"key\":\"' || key || '\"' END || '}' AS row FROM samples", B.SAMPLES)
def shaped_rows(spark, d):
    return C.shaped(B.samples(spark, d), ["size", "key"])


@query("SELECT path, ordinal, chunk_id FROM chunks WHERE chunk_id IN ('fmt ', 'data')", B.RIFF, _CHUNKS)
def selected_chunks(spark, d):
    return C.select_chunks(_chunks(spark, d), ["FMT", "data"], ["fact"]).select("path", "ordinal", "chunk_id")


@query("SELECT path FROM riff WHERE has_fact", B.RIFF)
def files_with_fact(spark, d):
    return C.having_chunks(_chunks(spark, d), ["FACT"])


@query("SELECT path, 44 + CASE WHEN has_fact THEN 12 ELSE 0 END AS \"offset\", n::BIGINT AS length, ((CASE WHEN has_fact THEN n ELSE n // 2 END)::BIGINT)::VARCHAR AS value FROM riff", B.RIFF)
def addresses(spark, d):
    return C.resolve_address(_chunks(spark, d), "data.frames")


@query("SELECT path, 'data+4' AS anchor, (40 + CASE WHEN has_fact THEN 12 ELSE 0 END)::BIGINT AS \"offset\" FROM riff UNION ALL SELECT path, 'end-2', (44 + n + n % 2 + CASE WHEN has_fact THEN 12 ELSE 0 END - 2)::BIGINT FROM riff UNION ALL SELECT path, 'hex', CASE WHEN has_fact THEN 36::BIGINT END FROM riff", B.RIFF)
def anchors(spark, d):
    files = B.riff_files(spark, d)
    parts = [("data+4", "find:data+4"), ("end-2", "end-2"), ("hex", "find:0x66616374")]
    out = None
    for name, spec in parts:
        part = C.resolve_anchor(files, spec).select("path", F.lit(name).alias("anchor"), "offset")
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT path, named OR path LIKE '%.wav' OR path LIKE '%.flac' AS found FROM (SELECT '/f/' || l_orderkey || '_' || l_linenumber || '_' || l_partkey || CASE l_linenumber % 4 WHEN 0 THEN '.WAV' WHEN 1 THEN '.flac' WHEN 2 THEN '.txt' ELSE '' END AS p, lower(p) AS path, l_partkey % 50 = 0 AS named FROM lineitem)")
def expanded_targets(spark, d):
    t = B.table(spark, d, "lineitem")
    ending = F.when(F.col("l_linenumber") % 4 == 0, ".WAV").when(F.col("l_linenumber") % 4 == 1, ".flac").when(F.col("l_linenumber") % 4 == 2, ".txt").otherwise("")
    path = F.concat(F.lit("/f/"), "l_orderkey", F.lit("_"), "l_linenumber", F.lit("_"), "l_partkey", ending)
    paths = t.select(path.alias("path"), (F.col("l_partkey") % 50 == 0).alias("named"))
    return C.expand_targets(paths, [".wav", ".flac"]).select(F.lower("path").alias("path"), "found")


@query("SELECT path, ordinal, 'defaulted' AS geometry, \"offset\" + 8 AS payload_base, 8 + size AS extent_len FROM chunks", B.RIFF, _CHUNKS)
def chunk_geometry(spark, d):
    none = F.lit(None).cast("bigint")
    return C.geometry(_chunks(spark, d).withColumns({"payload_base": none, "payload_len": none})).select("path", "ordinal", "geometry", "payload_base", "extent_len")


@query("SELECT path, library, size FROM samples QUALIFY row_number() OVER (ORDER BY path <> (SELECT max(path) FROM samples), library % 2, size) = 1", B.SAMPLES)
def resolved_reference(spark, d):
    rows = B.samples(spark, d).select("path", "library", "size")
    last = rows.agg(F.max("path")).first()[0]
    return C.resolve_reference(last, [rows.where("library % 2 = 0"), rows.where("library % 2 = 1")])


@query("SELECT vec_id, version FROM features WHERE vec_id = 8 AND version = 3", B.FEATURES)
def resolved_features(spark, d):
    return C.resolve_features(B.features(spark, d), 8, 3, "vec_id").select("vec_id", "version")


_HOLD = "rows AS (SELECT DISTINCT '/lib' || (l_suppkey % 5) AS root, '/lib' || (l_suppkey % 5) || '/s' || l_orderkey AS path FROM lineitem)"


@query("SELECT path, CASE WHEN root IN ('/lib0', '/lib1') THEN root ELSE min(root) OVER (PARTITION BY path) END AS root FROM (SELECT DISTINCT path, root FROM rows)", _HOLD)
def owning_library(spark, d):
    t = B.table(spark, d, "lineitem")
    root = F.concat(F.lit("/lib"), F.col("l_suppkey") % 5)
    rows = t.select(root.alias("root"), F.concat(root, F.lit("/s"), "l_orderkey").alias("path")).distinct()
    libraries = rows.select("root").distinct().where("root in ('/lib0', '/lib1')")
    return C.owner_or_holder(rows.select("path"), libraries, rows)


@query("SELECT path, description FROM (SELECT '/part/' || p_partkey AS path, CASE WHEN p_partkey % 3 = 0 THEN CASE WHEN p_partkey % 2 = 0 THEN p_name END ELSE p_type END AS description FROM part) WHERE description IS NOT NULL")
def set_descriptions(spark, d):
    t = B.table(spark, d, "part").withColumn("path", F.concat(F.lit("/part/"), "p_partkey"))
    old = t.select("path", F.col("p_type").alias("description"))
    new = t.where("p_partkey % 3 = 0").select("path", F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).alias("description"))
    return C.set_description(old, new)


_DEEP = "files AS (SELECT DISTINCT '/d' || (p_partkey % 4) || '/' || replace(p_brand, '#', '') || '/x/f' || p_partkey || '.wav' AS path FROM part), folders AS (SELECT path, unnest(['/' || split_part(path, '/', 2), '/' || split_part(path, '/', 2) || '/' || split_part(path, '/', 3), '/' || split_part(path, '/', 2) || '/' || split_part(path, '/', 3) || '/x']) AS folder FROM files), counts AS (SELECT folder, count(*) FILTER (WHERE len(string_split(path, '/')) - len(string_split(folder, '/')) - 1 <= 1)::BIGINT AS files, bool_or(len(string_split(path, '/')) - len(string_split(folder, '/')) - 1 > 1) AS truncated FROM folders GROUP BY 1)"


def _deep(spark, d):
    p = B.table(spark, d, "part")
    return p.select(F.concat(F.lit("/d"), F.col("p_partkey") % 4, F.lit("/"), F.replace("p_brand", F.lit("#")), F.lit("/x/f"), "p_partkey", F.lit(".wav")).alias("path")).distinct()


@query("SELECT * FROM counts", _DEEP)
def subtree_counts(spark, d):
    return C.folder_counts(_deep(spark, d), 1)


@query("SELECT folder, count(*)::BIGINT AS files, false AS truncated FROM folders WHERE len(string_split(folder, '/')) = 3 AND folder NOT LIKE '/d1/%' AND folder NOT LIKE '/d2/%' AND folder NOT LIKE '/d3/%' GROUP BY 1 HAVING count(*) >= 10 UNION ALL SELECT folder, count(*)::BIGINT, false FROM folders WHERE folder IN ('/d1', '/d2', '/d3') GROUP BY 1 HAVING count(*) >= 10", _DEEP)
def discovered_libraries(spark, d):
    """Beside a library that is registered deep inside of /d0, so that /d0 itself can't be one."""
    registered = spark.createDataFrame([("/d0/registered",)], "root string")
    return C.discover(_deep(spark, d), registered, 10)


_REG = "reg AS (SELECT '/n/' || n_name AS root, n_name AS label, timestamp '2024-01-01' + INTERVAL (n_regionkey) DAY AS last_seen_at FROM nation)"


def _registry(spark, d):
    return B.table(spark, d, "nation").select(F.concat(F.lit("/n/"), "n_name").alias("root"), F.col("n_name").alias("label"), (F.lit("2024-01-01").cast("timestamp") + F.make_interval(days="n_regionkey")).alias("last_seen_at"))


@query("SELECT root, label, epoch(last_seen_at)::BIGINT AS seen FROM reg WHERE label <> (SELECT min(label) FROM reg) UNION ALL SELECT '/new/lib', 'new', epoch(timestamp '2025-01-01')::BIGINT", _REG)
def registered_libraries(spark, d):
    """A library registered, another one forgotten."""
    registry = C.register(_registry(spark, d), "/new/lib/", "new", F.lit("2025-01-01"))
    first = registry.agg(F.min(F.when(F.col("label") != "new", F.col("label")))).first()[0]
    return C.forget(registry, first).select("root", "label", F.unix_timestamp("last_seen_at").alias("seen"))


@query("SELECT root, label, row_number() OVER (ORDER BY last_seen_at DESC, label)::INT AS place FROM reg", _REG)
def listed_libraries(spark, d):
    from pyspark.sql import Window

    return C.listed(_registry(spark, d)).select("root", "label", F.row_number().over(Window.orderBy(F.desc("last_seen_at"), "label")).alias("place"))


@query("SELECT root, label FROM reg WHERE root NOT IN (SELECT '/n/' || n_name FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE s_suppkey % 10 = 1)", _REG)
def orphaned_libraries(spark, d):
    rows = B.table(spark, d, "supplier").where("s_suppkey % 10 = 1").join(B.table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("/n/"), "n_name").alias("root"))
    return C.orphans(_registry(spark, d), rows).select("root", "label")


@query("SELECT root, coalesce(samples, 0)::BIGINT AS samples, coalesce(features, 0)::BIGINT AS features, last_indexed_at FROM reg LEFT JOIN (SELECT '/n/' || n_name AS root, count(*) AS samples, count(*) FILTER (WHERE c_custkey % 3 = 0) AS features, max(c_acctbal) AS last_indexed_at FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) USING (root)", _REG)
def library_stats(spark, d):
    c = B.table(spark, d, "customer").join(B.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = c.select(F.concat(F.lit("/n/"), "n_name").alias("root"), F.col("c_custkey").alias("path"), F.col("c_acctbal").alias("indexed_at"))
    return C.refreshed_stats(_registry(spark, d), rows, rows.where("path % 3 = 0")).select("root", "samples", "features", "last_indexed_at")


@query("SELECT path, bpm, NULL::VARCHAR AS device, NULL::VARCHAR AS category, NULL::VARCHAR AS creator, NULL::VARCHAR AS product, NULL::INT AS root_note, NULL::INT AS sample_rate, NULL::INT AS channels, NULL::INT AS bits_per_sample FROM samples", B.SAMPLES)
def migrated_rows(spark, d):
    return C.migrated(B.samples(spark, d).select("path", "bpm"), 1)


@query("SELECT DISTINCT '/p/' || p_partkey AS path, tag FROM (SELECT p_partkey, unnest([p_brand, 'x', p_brand]) AS tag FROM part)")
def imported_tags(spark, d):
    rows = B.table(spark, d, "part").select(F.to_json(F.create_map(F.concat(F.lit("/p/"), "p_partkey"), F.array("p_brand", F.lit(" x "), F.lit(" "), "p_brand"))).alias("value"))
    return C.tags_from_json(rows)
