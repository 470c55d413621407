"""The catalogue: filters, pages with totals, histograms, scoping, deduplication, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def parse_range(spec: str) -> tuple[float | None, float | None]:
    """'120' is [120, 120]; '120:130', ':130' and '120:' have open ends."""
    low, colon, high = spec.partition(":")
    try:
        if not colon:
            return float(low), float(low)
        return (float(low) if low.strip() else None), (float(high) if high.strip() else None)
    except ValueError:
        raise ValueError(f"not a range: {spec!r}") from None


def escape_like(text: str, escape: str = "!") -> str:
    return "".join(escape + c if c in (escape, "%", "_") else c for c in text)


def within(column: str, low: float | None, high: float | None) -> Column:
    """Both ends inclusive; an absent end is open. Nulls are outside of any range with an end."""
    out = F.lit(True)
    if low is not None:
        out = out & (F.col(column) >= F.lit(low))
    if high is not None:
        out = out & (F.col(column) <= F.lit(high))
    return out


def build_filter(bpm: str | None = None, duration: str | None = None, **equals: str | None) -> Column:
    """A predicate of ranges and case-insensitive equalities; absent ones ask for nothing. It reaches the scan."""
    out = F.lit(True)
    for column, spec in (("bpm", bpm), ("duration", duration)):
        if spec:
            out = out & within(column, *parse_range(spec))
    for column, value in equals.items():
        if value:
            out = out & (F.lower(column) == value.lower())
    return out


def with_tags(rows: DataFrame, tags: DataFrame, wanted: list[str]) -> DataFrame:
    """Rows whose path has all tags, whatever their case."""
    names = sorted({t.lower() for t in wanted})
    if not names:
        return rows
    hits = tags.where(F.lower("tag").isin(names)).groupBy("path").agg(F.count_distinct(F.lower("tag")).alias("_n")).where(F.col("_n") == len(names))
    return rows.join(hits, "path", "left_semi")


def page(rows: DataFrame, order: list[str], limit: int) -> DataFrame:
    """The first rows in order, with the total that the filter matched."""
    total = rows.agg(F.count("*").cast("bigint").alias("total_matched"))
    shown = rows.orderBy(*order).limit(limit)
    return shown.join(F.broadcast(total)).withColumn("truncated", F.col("total_matched") > limit)


def locate(rows: DataFrame, text: str) -> DataFrame:
    """Rows whose path contains a text, whatever its case; the text's own wildcards stand for themselves."""
    pattern = "%" + escape_like(text).replace("'", "''") + "%"
    return rows.where(F.expr(f"path ilike '{pattern}' escape '!'"))


def in_scope(rows: DataFrame, scope: str, label: str = "label", root: str = "root") -> DataFrame:
    """Libraries of that label, or whose root overlaps that path in either direction."""
    path = F.lit(scope.rstrip("/"))
    overlap = (F.col(root) == path) | F.concat(F.col(root), F.lit("/")).startswith(F.concat(path, F.lit("/"))) | F.concat(path, F.lit("/")).startswith(F.concat(F.col(root), F.lit("/")))
    return rows.where((F.col(label) == scope) | overlap)


def histogram(rows: DataFrame, column: str, keep_null: bool = False) -> DataFrame:
    rows = rows if keep_null else rows.where(F.col(column).isNotNull())
    return rows.groupBy(column).agg(F.count("*").cast("bigint").alias("n"))


def first_of_path(rows: DataFrame, *order: Column) -> DataFrame:
    """One row a path: the first in order."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy("path").orderBy(*order))).where("_k = 1").drop("_k")


def prefixes(path: Column) -> Column:
    """All folders above a path, as an array: an equi-join on them replaces a prefix join."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.size(parts) - 1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return F.when(F.size(parts) > 2, above).otherwise(F.array().cast("array<string>"))


def owners(rows: DataFrame, libraries: DataFrame) -> DataFrame:
    """``path`` and the ``root`` of the most specific library that contains it."""
    # Files of one folder have one owner: folders are far fewer than files, and only they are joined with the roots.
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    files = rows.select("path", folder.alias("_folder")).distinct()
    above = files.select("_folder").distinct().select("_folder", F.explode(prefixes(F.concat("_folder", F.lit("/x")))).alias("root"))
    best = above.join(libraries.select("root").distinct(), "root").groupBy("_folder").agg(F.max_by("root", F.length("root")).alias("root"))
    return files.join(best, "_folder").select("path", "root")


def overlaps(libraries: DataFrame) -> DataFrame:
    """Pairs of roots of which one is inside the other."""
    inner = libraries.select(F.col("root").alias("inner_root"), F.explode(prefixes(F.concat("root", F.lit("/x")))).alias("root")).where("root <> inner_root")
    return inner.join(libraries.select("root").distinct(), "root").select(F.col("root").alias("outer_root"), "inner_root").distinct()


def upsert(old: DataFrame, new: DataFrame, key: str = "path") -> DataFrame:
    """A snapshot in which new rows replace old ones of their key."""
    return new.unionByName(old.join(new.select(key).distinct(), key, "left_anti").select(*new.columns))


def prune(rows: DataFrame, root: str, before: Column, seen: str = "last_seen_at") -> DataFrame:
    """Rows under a root go unless they were seen since then; others stay."""
    under = F.col("path").startswith(root.rstrip("/") + "/")
    return rows.where(~(under & (F.col(seen).isNull() | (F.col(seen) < before))))


def set_tags(tags: DataFrame, new: DataFrame, replace: bool = False) -> DataFrame:
    """Tags added (blank ones don't count), or, with ``replace``, put in the place of all tags of their path."""
    new = new.select("path", F.trim("tag").alias("tag")).where("tag <> ''")
    old = tags.join(new.select("path").distinct(), "path", "left_anti") if replace else tags
    return old.select("path", "tag").unionByName(new).distinct()


def remove_tags(tags: DataFrame, gone: DataFrame) -> DataFrame:
    return tags.join(gone, ["path", "tag"], "left_anti")


def remove_root(rows: DataFrame, root: str) -> DataFrame:
    return rows.where(~F.col("path").startswith(root.rstrip("/") + "/"))


def select_rows(rows: DataFrame, predicate: Column, fields: list[str] | None = None, order: str = "path", limit: int | None = None) -> DataFrame:
    """Rows that fit, some of their fields, in order; a limit reaches the sort as a top-k."""
    out = rows.where(predicate).orderBy(order)
    out = out.limit(row_limit(limit)) if limit is not None else out
    return out.select(*fields) if fields else out


def count_rows(rows: DataFrame, predicate: Column) -> DataFrame:
    """The number that the same predicate matches, whatever the limit."""
    return rows.where(predicate).agg(F.count("*").cast("bigint").alias("total_matched"))


def shaped(rows: DataFrame, fields: list[str]) -> DataFrame:
    """A row as JSON of those fields that it has."""
    return rows.select(F.to_json(F.struct(*fields)).alias("row"))


def row_limit(value: object, default: int = 50, most: int = 10_000) -> int:
    """A limit that a caller gives: a whole number from 0, at most so many."""
    if value is None:
        return default
    if isinstance(value, bool) or not str(value).lstrip("+").isdigit():
        raise ValueError(f"not a limit: {value!r}")
    return min(int(value), most)


def select_chunks(chunks: DataFrame, only: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Chunks by id, whatever its case; they keep their ordinals."""
    name = F.upper(F.trim("chunk_id"))
    if only:
        chunks = chunks.where(name.isin([x.strip().upper() for x in only]))
    return chunks.where(~name.isin([x.strip().upper() for x in exclude])) if exclude else chunks


def having_chunks(chunks: DataFrame, wanted: list[str]) -> DataFrame:
    """Paths of files that hold any of the chunk ids."""
    return select_chunks(chunks, wanted).select("path").distinct()


def resolve_address(chunks: DataFrame, spec: str) -> DataFrame:
    """``path``, ``offset``, ``length`` of a chunk, or ``value`` of its field (``chunk.field``): the first chunk of that id in each file."""
    name, _, field = spec.partition(".")
    first = Window.partitionBy("path").orderBy("ordinal")
    rows = chunks.where(F.trim("chunk_id") == name.strip()).withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return rows.select("path", (F.col("offset") + 8).alias("offset"), F.col("size").alias("length"), (F.col("fields")[field] if field else F.lit(None).cast("string")).alias("value"))


def resolve_anchor(files: DataFrame, expression: str, content: str = "content") -> DataFrame:
    """``path`` and ``offset`` of an anchor: a number, ``end``, ``find:text`` or ``find:0xhex``, each with +n or -n behind it. Null where nothing is found."""
    import re

    found = re.fullmatch(r"(.+?)(?:([+-])(0x[0-9a-fA-F]+|\d+))?", expression)
    base, sign, delta = found.groups()
    by = (int(delta, 0) if delta else 0) * (-1 if sign == "-" else 1)
    if base == "end":
        at = F.octet_length(content).cast("bigint")
    elif base.startswith("find:"):
        needle = base[5:]
        digits = needle[2:].upper() if needle.startswith("0x") else needle.encode().hex().upper()
        # In hex, a match must begin at an even digit: pairs are set apart, so that it can't begin elsewhere.
        spaced = lambda x: F.regexp_replace(x, "(..)", "$1 ")
        place = F.instr(spaced(F.hex(content)), re.sub("(..)", r"\1 ", digits))
        at = F.when(place > 0, ((place - 1) / 3).cast("bigint"))
    else:
        at = F.lit(int(base, 0)).cast("bigint")
    return files.select("path", (at + by).alias("offset"))


def refuses_as_root(path: str, home: str) -> bool:
    """Whether a path is no fit root of a library: a file system's root, or a home."""
    clean = path.replace("\\", "/").rstrip("/")
    return clean in ("", home.rstrip("/")) or len(clean) == 2 and clean[1] == ":"


def expand_targets(paths: DataFrame, accept: list[str], named: str = "named") -> DataFrame:
    """Paths with ``found``: of an accepted ending, or named explicitly; others are skipped."""
    ending = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    return paths.withColumn("found", F.col(named) | ending.isin([a.lower() for a in accept]))


def geometry(chunks: DataFrame, head: int = 8) -> DataFrame:
    """Chunks with where their payloads are, how long they are with their heads, and whether that is declared, defaulted, invalid or without a place."""
    base = F.coalesce("payload_base", F.col("offset") + head)
    length = F.coalesce("payload_len", "size")
    kind = F.when(F.col("offset").isNull(), "unpositioned").when((F.col("offset") < 0) | (length < 0) | (base < F.col("offset")), "invalid").when(F.col("payload_base").isNull(), "defaulted").otherwise("declared")
    return chunks.withColumns({"geometry": kind, "payload_base": base, "payload_len": length, "extent_len": base - F.col("offset") + length})


def resolve_reference(path: str, libraries: list[DataFrame]) -> DataFrame:
    """The row of a path from the first library that has it."""
    out = None
    for i, rows in enumerate(libraries):
        part = rows.where(F.col("path") == path).withColumn("_k", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return out.orderBy("_k").limit(1).drop("_k")


def resolve_features(features: DataFrame, path: str, current: int, key: str = "path") -> DataFrame:
    """A path's features of the current version."""
    return features.where((F.col(key) == path) & (F.col("version") == current)).limit(1)


def owner_or_holder(paths: DataFrame, libraries: DataFrame, rows: DataFrame) -> DataFrame:
    """``path`` and ``root``: the most specific library around a path, else the first (by root) that has a row of it."""
    around = owners(paths, libraries)
    holders = rows.join(paths.select("path").distinct(), "path", "left_semi").groupBy("path").agg(F.min("root").alias("_holder"))
    return paths.select("path").distinct().join(around, "path", "left").join(holders, "path", "left").select("path", F.coalesce("root", "_holder").alias("root"))


def set_description(descriptions: DataFrame, new: DataFrame) -> DataFrame:
    """Descriptions with new ones in their paths' places; an empty or null one deletes."""
    return descriptions.join(new.select("path").distinct(), "path", "left_anti").select("path", "description").unionByName(new.where(F.coalesce(F.trim("description"), F.lit("")) != "").select("path", "description"))


def folder_counts(files: DataFrame, most_depth: int = 16) -> DataFrame:
    """Files below each folder, down to a depth, and whether there are deeper ones."""
    each = files.select("path", F.explode(prefixes(F.col("path"))).alias("folder"))
    depth = F.size(F.split("path", "/")) - F.size(F.split("folder", "/")) - 1
    return each.groupBy("folder").agg(F.count_if(depth <= most_depth).cast("bigint").alias("files"), F.bool_or(depth > most_depth).alias("truncated"))


def discover(files: DataFrame, registered: DataFrame, least: int, most_depth: int = 16) -> DataFrame:
    """Folders that could be libraries: enough files below them, neither registered nor inside or around one that is, and not inside another such folder."""
    rich = folder_counts(files, most_depth).where(F.col("files") >= least)
    roots = registered.select("root").distinct()
    inside = rich.select("folder", F.explode(prefixes(F.concat("folder", F.lit("/x")))).alias("root")).join(roots, "root", "left_semi").select("folder").distinct()
    around = roots.select(F.explode(prefixes(F.col("root"))).alias("folder")).distinct()
    free = rich.join(inside, "folder", "left_anti").join(around, "folder", "left_anti")
    nested = free.select("folder", F.explode(prefixes(F.col("folder"))).alias("_above")).join(free.select(F.col("folder").alias("_above")), "_above", "left_semi").select("folder").distinct()
    return free.join(nested, "folder", "left_anti")


# The registry of libraries: a small table, changed by making a new one


def register(registry: DataFrame, root: str, label: str, seen: Column) -> DataFrame:
    """The registry with a library added or renewed. A root inside or around another one is refused."""
    mine = root.rstrip("/")
    others = [r[0] for r in registry.select("root").collect() if r[0] != mine]  # as many rows as there are libraries
    clash = next((r for r in others if (r + "/").startswith(mine + "/") or (mine + "/").startswith(r + "/")), None)
    if clash is not None:
        raise ValueError(f"{mine} overlaps the library at {clash}")
    new = registry.sparkSession.range(1).select(F.lit(mine).alias("root"), F.lit(label).alias("label"), seen.cast("timestamp").alias("last_seen_at"))
    return registry.where(F.col("root") != mine).select("root", "label", "last_seen_at").unionByName(new)


def forget(registry: DataFrame, label_or_root: str) -> DataFrame:
    return registry.where((F.col("label") != label_or_root) & (F.col("root") != label_or_root.rstrip("/")))


def listed(registry: DataFrame) -> DataFrame:
    """Libraries, the one last seen first."""
    return registry.orderBy(F.desc("last_seen_at"), "label")


def orphans(registry: DataFrame, rows: DataFrame) -> DataFrame:
    """Libraries without a row."""
    return registry.join(rows.select("root").distinct(), "root", "left_anti")


def refreshed_stats(registry: DataFrame, rows: DataFrame, features: DataFrame) -> DataFrame:
    """Each library with its numbers of samples and of samples with features, and when one was indexed last."""
    own = rows.join(features.select("path").distinct().withColumn("_f", F.lit(1)), "path", "left")
    sums = own.groupBy("root").agg(F.count("*").cast("bigint").alias("samples"), F.count("_f").cast("bigint").alias("features"), F.max("indexed_at").alias("last_indexed_at"))
    return registry.join(sums, "root", "left").na.fill(0, ["samples", "features"])


#: Columns that each version of the samples' table added, with their types.
VERSIONS = {2: {"device": "string", "category": "string", "creator": "string", "product": "string"}, 3: {"root_note": "int", "sample_rate": "int", "channels": "int", "bits_per_sample": "int"}}


def migrated(rows: DataFrame, version: int) -> DataFrame:
    """Rows of an older version with the columns that later ones have; forward only."""
    if version > max(VERSIONS):
        raise ValueError(f"version {version} is newer than {max(VERSIONS)}")
    for v, columns in VERSIONS.items():
        if v > version:
            rows = rows.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in rows.columns})
    return rows


def tags_from_json(imported: DataFrame) -> DataFrame:
    """``path`` and ``tag`` of a JSON object of paths with their tags, one such object a row; blank ones don't count."""
    pairs = imported.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("path", "tags"))
    return pairs.select("path", F.explode("tags").alias("tag")).select("path", F.trim("tag").alias("tag")).where("tag <> ''").distinct()
