"""A walk over files of every format, and the SQL that says what it must find."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.sniffing import sniffed as sniffed_column
from tessera.sources import bindings as B
from tessera.sources import specimens as S
from tessera.sources import walk as K

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
_ROWS = "(SELECT c_custkey AS k, c_name AS name FROM customer)"


def _walked(kind: str) -> Callable[..., DataFrame]:
    """Fields that are known beforehand, as a walk that sniffs the format itself finds them."""

    def run(spark, d) -> DataFrame:
        files = S.files(B.table(spark, d, "customer"), kind, "c_custkey", "c_name")
        forced = kind if kind == "iso" else None
        rows = K.walk(files, forced=forced).select("path", "format", "chunk_id", F.explode("fields").alias("field", "value"))
        wanted = F.concat_ws("/", "chunk_id", "field").isin([f"{c}/{f}" for c, f, _ in S.SPECIMENS[kind][2]])
        k = F.regexp_extract("path", r"/(\d+)\.[^/]*$", 1).cast("bigint")
        return rows.where(wanted).select(k.alias("k"), "format", "chunk_id", "field", "value")

    return run


def _known(kind: str) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"{{'c': {quoted(c)}, 'f': {quoted(f)}, 'v': ({sql})::VARCHAR}}" for c, f, sql in S.SPECIMENS[kind][2])
    return f"SELECT k, {quoted(kind)} AS format, x.c AS chunk_id, x.f AS field, x.v AS value FROM (SELECT k, unnest([{rows}]) AS x FROM {_ROWS}) WHERE x.v IS NOT NULL"


for _kind in S.SPECIMENS:
    _name = "walk_" + _kind.replace("-", "_")
    QUERIES[_name] = _walked(_kind)
    ORACLES[_name] = _known(_kind)

#: Formats that the first bytes tell.
_BY_HEAD = [k for k in S.SPECIMENS if k not in ("als", "adg", "adv", "agr", "alc", "multisample", "xpn", "labx", "mpcpattern", "xpm", "xtd", "snd", "sigmf", "iq", "gcm", "adx", "albank", "snesrom", "n64rom", "s3m", "mod", "id3-wrapped", "iso")]


def sniff_heads(spark, d) -> DataFrame:
    """Files of each format that its first bytes tell, by the Column expression."""
    files = S.files_of(B.table(spark, d, "supplier"), _BY_HEAD, "s_suppkey", "s_name")
    found = files.select(F.col("kind").alias("made"), sniffed_column(F.col("content")).alias("format"))
    return found.groupBy("made", "format").agg(F.count("*").cast("bigint").alias("n"))


QUERIES["sniff_heads"] = sniff_heads
ORACLES["sniff_heads"] = "SELECT made, made AS format, (SELECT count(*) FROM supplier)::BIGINT AS n FROM (SELECT unnest([" + ", ".join(f"'{k}'" for k in _BY_HEAD) + "]) AS made)"
