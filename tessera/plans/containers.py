"""Byte, container and ordered queries, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import bytes as Y
from tessera.functions.sniffing import sniffed as sniffed_column
from tessera.operators import ordered as R
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


def _texts(spark, d):
    return B.table(spark, d, "documents").select("doc_id", F.col("text").cast("binary").alias("data"))


_T = "t AS (SELECT doc_id, coalesce(encode(text), ''::BLOB) AS data, hex(coalesce(encode(text), ''::BLOB)) AS h FROM documents)"
_EACH = "each AS (SELECT doc_id, unnest(range(octet_length(data)))::INT AS i, unnest(list_transform(regexp_extract_all(h, '..'), lambda x: ('0x' || x)::INT)) AS byte, octet_length(data) AS n FROM t)"


@query("SELECT doc_id, CASE WHEN length(h) >= 8 THEN ('0x' || substr(h, 1, 8))::BIGINT END AS be, CASE WHEN length(h) >= 8 THEN ('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2))::BIGINT END AS le, CASE WHEN length(h) >= 4 THEN ('0x' || substr(h, 3, 2))::BIGINT END AS second, CASE WHEN length(h) >= 16 THEN ('0x' || substr(h, 1, 16))::HUGEINT::DECIMAL(20, 0) END AS wide FROM (SELECT doc_id, hex(encode(left(coalesce(text, ''), 8))) AS h FROM documents)")
def typed_reads(spark, d):
    x = F.col("data")
    return _texts(spark, d).select("doc_id", Y.read_typed(x, 0, "u32", True).alias("be"), Y.read_typed(x, 0, "u32").alias("le"), Y.read_typed(x, 1, "u8").alias("second"), Y.read_typed(x, 0, "u64", True).alias("wide"))


@query("SELECT doc_id, byte, count(*)::BIGINT AS n FROM each GROUP BY 1, 2", _T, _EACH)
def byte_histogram(spark, d):
    return Y.byte_counts(_texts(spark, d), "doc_id", "data")


@query("SELECT doc_id, round(greatest(0, least(log2(sum(n)) - sum(n * log2(n)) / sum(n), log2(count(*)))), 6) AS entropy, sum(n)::BIGINT AS n_bytes FROM (SELECT doc_id, byte, count(*) AS n FROM each GROUP BY 1, 2) GROUP BY 1", _T, _EACH)
def byte_entropy(spark, d):
    return Y.entropy(Y.byte_counts(_texts(spark, d), "doc_id", "data"), "doc_id")


@query("SELECT doc_id || '/' || w AS slice, round(greatest(0, least(log2(sum(c)) - sum(c * log2(c)) / sum(c), log2(count(*)))), 6) AS entropy, sum(c)::BIGINT AS n_bytes FROM (SELECT doc_id, w, byte, count(*) AS c FROM (SELECT doc_id, byte, CASE WHEN i < n // 8 THEN 0 WHEN i < 2 * n // 8 THEN 1 WHEN i < 3 * n // 8 THEN 2 WHEN i < 4 * n // 8 THEN 3 WHEN i < 5 * n // 8 THEN 4 WHEN i < 6 * n // 8 THEN 5 WHEN i < 7 * n // 8 THEN 6 ELSE 7 END AS w FROM each) GROUP BY ALL) GROUP BY doc_id, w", _T, _EACH)
def windowed_entropy(spark, d):
    cut = Y.windows_of(_texts(spark, d), "doc_id", "data", 8).select(F.concat("doc_id", F.lit("/"), "window").alias("slice_id"), F.col("slice").alias("data"))
    return Y.entropy(Y.byte_counts(cut, "slice_id", "data"), "slice_id").withColumnRenamed("slice_id", "slice")


@query("SELECT doc_id, i AS \"offset\" FROM (SELECT doc_id, i, byte, lead(byte) OVER (PARTITION BY doc_id ORDER BY i) AS following FROM each) WHERE byte = 116 AND following = 104", _T, _EACH)
def find_bytes(spark, d):
    return Y.find_all(_texts(spark, d), "doc_id", "data", b"th")


@query("SELECT doc_id, i AS \"offset\", CASE WHEN o = 'l' THEN 'le' ELSE 'be' END AS \"order\" FROM (SELECT doc_id, i, byte, lead(byte) OVER (PARTITION BY doc_id ORDER BY i) AS following FROM each) JOIN (VALUES ('l', 101, 32), ('b', 32, 101)) v(o, x, y) ON byte = x AND following = y", _T, _EACH)
def value_scan(spark, d):
    """Everywhere that 0x2065 stands as 16 bits, in either byte order."""
    return Y.find_value(_texts(spark, d), "doc_id", "data", 0x2065, "u16")


@query("SELECT doc_id, min(i)::INT AS \"offset\", string_agg(chr(byte), '' ORDER BY i) AS run FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS g FROM each WHERE byte BETWEEN 32 AND 126) GROUP BY doc_id, g HAVING count(*) >= 8", _T, _EACH)
def printable_runs(spark, d):
    return Y.strings(_texts(spark, d), "doc_id", "data", 8)


@query("SELECT doc_id, (i // 16 * 16)::INT AS \"offset\", string_agg(printf('%02x', byte), '' ORDER BY i) AS hex, string_agg(CASE WHEN byte BETWEEN 32 AND 126 THEN chr(byte) ELSE '.' END, '' ORDER BY i) AS ascii FROM each GROUP BY 1, 2", _T, _EACH)
def hexdump(spark, d):
    return Y.hexdump(_texts(spark, d), "doc_id", "data")


@query("SELECT doc_id, class, count(*)::BIGINT AS n FROM (SELECT doc_id, CASE WHEN byte = 0 THEN 'null' WHEN byte = 255 THEN 'ff' WHEN byte BETWEEN 32 AND 126 THEN 'ascii' WHEN byte < 32 OR byte = 127 THEN 'ctrl' ELSE 'high' END AS class FROM each) GROUP BY 1, 2", _T, _EACH)
def byte_classes(spark, d):
    counts = Y.byte_counts(_texts(spark, d), "doc_id", "data")
    return counts.groupBy("doc_id", Y.byte_class(F.col("byte")).alias("class")).agg(F.sum("n").cast("bigint").alias("n"))


@query("SELECT doc_id, min(i)::INT AS start, (max(i) + 1)::INT AS stop FROM (SELECT a.doc_id, a.i, a.i - row_number() OVER (PARTITION BY a.doc_id ORDER BY a.i) AS g FROM each a JOIN each b ON b.doc_id = a.doc_id + 1 AND b.i = a.i WHERE a.byte <> b.byte) GROUP BY doc_id, g", _T, _EACH)
def byte_diff(spark, d):
    t = _texts(spark, d)
    pairs = t.join(t.select((F.col("doc_id") - 1).alias("doc_id"), F.col("data").alias("other")), "doc_id")
    return Y.diff_ranges(pairs, "doc_id", "data", "other")


_XY = "cell0 AS (SELECT doc_id, (i * 256 // n)::BIGINT AS cell, (sum(byte) // count(*))::INT AS mean FROM each GROUP BY 1, 2), l0 AS (SELECT doc_id, cell, mean, cell AS t, 0::BIGINT AS x, 0::BIGINT AS y FROM cell0)"


def _level(i: int) -> str:
    s = 1 << i
    return f"l{i + 1} AS (SELECT doc_id, cell, mean, t >> 2 AS t, CASE WHEN ry = 0 THEN CASE WHEN rx = 1 THEN {s} - 1 - y ELSE y END ELSE x END + {s} * rx AS x, CASE WHEN ry = 0 THEN CASE WHEN rx = 1 THEN {s} - 1 - x ELSE x END ELSE y END + {s} * ry AS y FROM (SELECT *, (t >> 1) & 1 AS rx, xor(t, (t >> 1) & 1) & 1 AS ry FROM l{i}))"


@query("SELECT doc_id, cell, x, y, mean FROM l4", _T, _EACH, _XY, *[_level(i) for i in range(4)])
def hilbert_cells(spark, d):
    """Mean byte of each cell of a 16 x 16 Hilbert square over each text's bytes."""
    return Y.hilbert_cells(_texts(spark, d), "doc_id", "data", 4)


def _chunks(spark, d):
    return K.walk(B.riff_files(spark, d))


_FACT = "unnest(CASE WHEN has_fact THEN [{'o': 0, 'id': 'fmt ', 'a': 12, 's': 16}, {'o': 1, 'id': 'fact', 'a': 36, 's': 4}, {'o': 2, 'id': 'data', 'a': 48, 's': n}] ELSE [{'o': 0, 'id': 'fmt ', 'a': 12, 's': 16}, {'o': 1, 'id': 'data', 'a': 36, 's': n}] END)"
_CHUNKS = f"chunks AS (SELECT path, c.o::INT AS ordinal, c.id AS chunk_id, c.a::BIGINT AS \"offset\", c.s::BIGINT AS size, has_fact, n FROM (SELECT path, has_fact, n, {_FACT} AS c FROM riff))"


@query("SELECT path, 'wav' AS format, ordinal, chunk_id, \"offset\", size FROM chunks", B.RIFF, _CHUNKS)
def riff_walk(spark, d):
    return _chunks(spark, d).select("path", "format", "ordinal", "chunk_id", "offset", "size")


@query("SELECT path, (CASE WHEN has_fact THEN n ELSE n // 2 END)::BIGINT AS frames FROM riff", B.RIFF)
def riff_frames(spark, d):
    return _chunks(spark, d).where("chunk_id = 'data'").select("path", F.col("fields")["frames"].cast("bigint").alias("frames"))


@query("SELECT chunk_id, count(*)::BIGINT AS files, min(path) AS example FROM chunks GROUP BY 1", B.RIFF, _CHUNKS)
def survey_chunks(spark, d):
    return K.survey(_chunks(spark, d))


@query("SELECT 'wav' AS format, chunk_id, count(*)::BIGINT AS chunks, sum(size)::BIGINT AS bytes, 0::BIGINT AS warnings FROM chunks GROUP BY 2", B.RIFF, _CHUNKS)
def census(spark, d):
    return K.census(_chunks(spark, d))


@query("SELECT 'wav' AS format, CASE WHEN has_fact THEN 'data,fact,fmt ' ELSE 'data,fmt ' END AS ids, count(*)::BIGINT AS files FROM riff GROUP BY 2", B.RIFF)
def shape_fingerprints(spark, d):
    return K.shapes(_chunks(spark, d))


@query("SELECT 'wav' AS format, count(*)::BIGINT AS n FROM riff", B.RIFF)
def sniffed(spark, d):
    return B.riff_files(spark, d).groupBy(sniffed_column(F.col("content")).alias("format")).agg(F.count("*").cast("bigint").alias("n"))


@query("SELECT path, chunk_id, 'chunk ' || chunk_id || ' claims ' || size || ' bytes, ' || (size - 10) || ' are left' AS warning FROM chunks WHERE chunk_id = 'data' AND n >= 20", B.RIFF, _CHUNKS)
def riff_overrun(spark, d):
    """Files cut short: the data chunk claims more than is left."""
    files = B.riff_files(spark, d).where("n >= 20")
    short = files.withColumn("content", F.substring("content", F.lit(1), F.octet_length("content") - 10 - F.col("n") % 2))
    return K.walk(short).where("chunk_id = 'data'").select("path", "chunk_id", "warning")


@query("SELECT path, chunk_id, f.field, f.value FROM chunks, (VALUES ('format_tag', '1'), ('channels', '1'), ('sample_rate', '44100'), ('avg_bytes_per_sec', '88200'), ('block_align', '2'), ('bits_per_sample', '16')) f(field, value) WHERE chunk_id = 'fmt '", B.RIFF, _CHUNKS)
def flat_fields(spark, d):
    return K.flatten_fields(_chunks(spark, d)).where("chunk_id = 'fmt '").select("path", "chunk_id", "field", "value")


_SAYS = "says AS (SELECT path, unnest([{'kind': 'chunk', 'value': chunk_id}, CASE WHEN chunk_id = 'fmt ' THEN {'kind': 'format_tag', 'value': '1'} END, CASE WHEN chunk_id = 'fact' THEN {'kind': 'fact_size', 'value': '4'} END, CASE WHEN ordinal = 0 THEN {'kind': 'container', 'value': 'wav'} END, CASE WHEN size % 2 = 1 THEN {'kind': 'flag', 'value': 'odd_size'} END, CASE WHEN size = 0 THEN {'kind': 'flag', 'value': 'empty_data'} END]) AS x FROM chunks)"


@query("SELECT x.kind AS kind, x.value AS value, count(*)::BIGINT AS n, min(path) AS first, CASE WHEN x.kind = 'flag' THEN array_to_string(list_sort(list(DISTINCT path))[1:25], ',') END AS examples FROM says WHERE x IS NOT NULL GROUP BY 1, 2", B.RIFF, _CHUNKS, _SAYS)
def census_detail(spark, d):
    """Empty payloads warn too, but texts aren't empty here."""
    return K.census_of(_chunks(spark, d).where("size > 0")).where("value <> 'warning'")


@query("SELECT 'WAVE' AS form, CASE WHEN has_fact THEN 'data,fact,fmt ' ELSE 'data,fmt ' END AS ids, count(*)::BIGINT AS files FROM riff GROUP BY 2", B.RIFF)
def cheap_shapes(spark, d):
    return K.cheap_shapes(B.riff_files(spark, d))


@query("SELECT doc_id, w AS window, round(greatest(0, least(log2(sum(c)) - sum(c * log2(c)) / sum(c), log2(count(*)))), 6) AS entropy, false AS sampled FROM (SELECT doc_id, w, byte, count(*) AS c FROM (SELECT doc_id, byte, n, unnest([((i + 1) * 72 - 1) // n - 1, ((i + 1) * 72 - 1) // n])::INT AS w, i FROM each WHERE n >= 72 AND n <= 500000) WHERE w >= 0 AND i >= w * n // 72 AND i < (w + 1) * n // 72 GROUP BY ALL) GROUP BY 1, 2", _T, _EACH)
def file_entropy(spark, d):
    texts = _texts(spark, d).where(F.octet_length("data").between(72, 500_000))
    return Y.sampled_entropy(texts, "doc_id", "data")


def _spans(spark, d):
    e = B.table(spark, d, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000
    return e.select("event_id", "user_id", F.floor(at).cast("bigint").alias("start"), (F.floor(at) + F.floor(F.abs("value")) % 600).cast("bigint").alias("stop"), "value")


_E = "e AS (SELECT event_id, user_id, (epoch_us(ts) // 1000000)::BIGINT AS start, (epoch_us(ts) // 1000000 + floor(abs(value))::BIGINT % 600)::BIGINT AS stop, value FROM events)"


@query("SELECT user_id, min(start) AS start, max(stop) AS stop, count(*)::BIGINT AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN start - max(stop) OVER (PARTITION BY user_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 3600 THEN 0 ELSE 1 END AS new FROM e)) GROUP BY user_id, island", _E)
def region_islands(spark, d):
    return R.islands(_spans(spark, d), ["user_id"], "start", "stop", 3600)


@query("SELECT DISTINCT b.user_id, b.start, b.stop FROM e b JOIN (SELECT * FROM e WHERE event_id % 3 = 0) x ON x.user_id = b.user_id WHERE b.event_id % 3 <> 0 AND x.start < b.stop AND b.start < x.stop AND least(b.stop, x.stop) - greatest(b.start, x.start) >= 0.5 * (b.stop - b.start)", _E)
def interval_absorb(spark, d):
    e = _spans(spark, d)
    return R.absorbed(e.where("event_id % 3 <> 0"), e.where("event_id % 3 = 0"), ["user_id"], cell=600)


@query("SELECT l.event_id, l.user_id, l.start, (SELECT max(r.start) FROM e r WHERE r.user_id = l.user_id AND r.event_id % 4 = 0 AND r.start <= l.start) AS asof_at FROM e l WHERE l.event_id % 4 <> 0", _E)
def asof_back(spark, d):
    e = _spans(spark, d)
    left, right = e.where("event_id % 4 <> 0").select("event_id", "user_id", "start"), e.where("event_id % 4 = 0").select("user_id", F.col("start").alias("r"), "value")
    return R.asof(left, right, ["user_id"], "start", "r", "value").drop("asof_value")


@query("SELECT l.event_id, l.user_id, l.start, (SELECT arg_min(r.start, (abs(r.start - l.start), r.start)) FROM e r WHERE r.user_id = l.user_id AND r.event_id % 4 = 0 AND abs(r.start - l.start) <= 86400) AS nearest_at FROM e l WHERE l.event_id % 4 <> 0", _E)
def asof_nearest(spark, d):
    e = _spans(spark, d)
    left, right = e.where("event_id % 4 <> 0").select("event_id", "user_id", "start"), e.where("event_id % 4 = 0").select("user_id", F.col("start").alias("r"))
    return R.nearest(left, right, ["user_id"], "start", "r", 86400)


@query("SELECT user_id, start, stop, stop - start AS length FROM (SELECT user_id, start, coalesce(lead(start) OVER (PARTITION BY user_id ORDER BY start), 2000000000) AS stop FROM (SELECT DISTINCT user_id, start FROM e))", _E)
def offset_tables(spark, d):
    entries = _spans(spark, d).select("user_id", "start").distinct().withColumn("end", F.lit(2_000_000_000).cast("bigint"))
    return R.table_regions(entries, ["user_id"], "start", "end").drop("end")


@query("SELECT user_id, beat, start, round(60.0 * (nb - beat) / (ns - start), 6)::DOUBLE AS tempo FROM (SELECT *, lead(beat) OVER w AS nb, lead(start) OVER w AS ns FROM (SELECT user_id, event_id AS beat, start FROM e) WINDOW w AS (PARTITION BY user_id ORDER BY start, beat)) WHERE ns > start", _E)
def marker_tempos(spark, d):
    return R.marker_tempos(_spans(spark, d).select("user_id", F.col("event_id").alias("beat"), "start"), ["user_id"], "beat", "start")


@query("SELECT user_id, " + ", ".join(f"round(CASE WHEN sum(d * d) = 0 THEN 0 ELSE coalesce(sum(d * l{k}), 0) / sum(d * d) END, 6) AS lag{k}" for k in (1, 2, 4, 8)) + " FROM (SELECT user_id, d, " + ", ".join(f"lead(d, {k}) OVER (PARTITION BY user_id ORDER BY start, event_id) AS l{k}" for k in (1, 2, 4, 8)) + " FROM (SELECT *, value - avg(value) OVER (PARTITION BY user_id) AS d FROM e)) GROUP BY 1", _E)
def autocorr_lags(spark, d):
    return R.autocorrelation(_spans(spark, d), ["user_id"], ["start", "event_id"], "value")


@query("SELECT user_id, w AS window_start, count(*)::BIGINT AS n, round(sum(value), 6) AS total FROM (SELECT user_id, value, unnest(range(greatest(floor((doc - 1024) / 512.0)::BIGINT + 1, 0), doc // 512 + 1)) * 512 AS w FROM (SELECT user_id, value, event_id AS doc FROM e)) GROUP BY 1, 2", _E)
def sliding_windows(spark, d):
    rows = _spans(spark, d).select("user_id", "value", "event_id")
    return R.sliding(rows, ["user_id"], "event_id", 1024, 512).groupBy("user_id", "window_start").agg(F.count("*").cast("bigint").alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query("SELECT source, doc_id, n_chars, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM documents")
def running_offsets(spark, d):
    return R.running_offsets(B.table(spark, d, "documents").select("source", "doc_id", "n_chars"), ["source"], ["doc_id"], "n_chars")
