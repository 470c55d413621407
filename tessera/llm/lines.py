"""Lines removed that repeat an earlier one, exactly or within one edit, by a deletion-neighbourhood join.

Two strings are within one edit of each other exactly when deleting the same character place from both (a substitution), or one character
from the longer (an insertion), gives equal strings. So each line emits its deletion variants as hashed keys, and lines that share
a key are linked. Of a key's lines only the earliest matters, which is aggregated; no pairs of a key's lines are made.

Most lines are near no other. An edit lies in one piece of a line, so a near line has the rest in common: lines whose halves no other
line shares are left out first, and then only variants of a piece whose surroundings another line shares are emitted. Nothing
is lost by either, since both only ask for what every link must have.

DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialise, parallelism, salted_lookup

#: Lines shorter than this are left as they are: only empty ones. Least pieces of a line in the second sieve.
LEAST_CHARS, PIECES = 1, 8
#: Characters from which lines also go if they are one edit from an earlier line; shorter ones go if they equal one. One edit makes another word of a short line.
NEAR_CHARS = 16
_LINE = ["_h1", "_h2"]


def _pieces(shorter: Column) -> Column:
    """Pieces of a line of so many characters: more of them in a long line, so that neither they nor their number get out of hand."""
    return F.greatest(F.lit(PIECES), F.floor(F.sqrt(shorter) / 2).cast("int"))


def _surroundings(line: str, chars: str, shorter: Column, piece: Column | int, pieces: Column | int) -> Column:
    """Hash of a line but for one piece; pieces are those of a line of ``shorter`` characters, and a line one longer has it in this piece."""
    a = F.floor(shorter * piece / pieces).cast("int")
    b = F.floor(shorter * (piece + 1) / pieces).cast("int")
    before = F.substring(F.col(line), F.lit(1), a)
    after = F.substring(F.col(line), F.col(chars) - (shorter - b) + 1, shorter - b)
    return F.xxhash64(shorter, F.lit(piece) if isinstance(piece, int) else piece, before, after)


def _second(line: str) -> Column:
    """A second hash of a line: what is hashed first is the seed of what follows, so that lines with one hash in common have other second ones."""
    return F.xxhash64(F.lit(1), F.col(line))


def _occurrences(docs: DataFrame) -> DataFrame:
    """A row a line that is long enough: document, line number, the line, and its place in the order of all lines."""
    rows = docs.select("_id", "_row", F.posexplode(F.split("_text", "\n", -1)).alias("_no", "_line"))
    rows = rows.where(F.col("_id").isNotNull() & (F.length("_line") >= LEAST_CHARS))
    place = F.col("_id").cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(10,0)") + F.col("_no")
    return rows.select("_id", "_row", "_no", "_line", F.xxhash64("_line").alias("_h1"), _second("_line").alias("_h2"), place.alias("_at"))


def _near(texts: DataFrame) -> DataFrame:
    """``_h1``, ``_h2`` of lines with an earlier line within one edit. texts: distinct lines, with their first places."""
    texts = texts.withColumn("_n", F.length("_line"))
    # Second sieve: which piece may differ, and from a line of the same length or of one less or more.
    def entries(m: int) -> Column:
        shorter = F.col("_n") - m
        made = lambda p: F.struct(_surroundings("_line", "_n", shorter, p, _pieces(shorter)).alias("key"), F.lit(m).alias("longer"), p.alias("piece"))
        return F.transform(F.sequence(F.lit(0), _pieces(shorter) - 1), made)

    seats = texts.select(*_LINE, "_at", "_line", "_n", F.explode(F.concat(entries(0), entries(1))).alias("_e")).select(*_LINE, "_at", "_line", "_n", "_e.*")
    shared = seats.groupBy("key").agg(F.min("_at").alias("a"), F.max("_at").alias("b"), F.min("longer").alias("c")).where("a <> b and c = 0").select("key", F.lit(True).alias("_shared"))
    seats = salted_lookup(seats, shared, "key", F.col("_h1")).where("_shared")
    shorter = F.col("_n") - F.col("longer")
    a = F.floor(shorter * F.col("piece") / _pieces(shorter)).cast("int")
    b = F.floor(shorter * (F.col("piece") + 1) / _pieces(shorter)).cast("int")
    seats = seats.withColumn("_mid", F.substring("_line", a + 1, b - a + F.col("longer")))
    cut = lambda i: F.concat(F.substring("_mid", F.lit(1), i), F.substring("_mid", i + 2, F.lit(1 << 30)))
    # Kind 0: substitutions at a place. Kind 1: insertions; there the shorter line is itself the variant.
    places = F.when(F.length("_mid") > 0, F.sequence(F.lit(0), F.length("_mid") - 1)).otherwise(F.array().cast("array<int>"))
    deletions = F.transform(places, lambda i: F.xxhash64(F.col("key"), F.col("longer"), F.when(F.col("longer") == 0, i).otherwise(-1), cut(i)))
    itself = F.when(F.col("longer") == 0, F.array(F.xxhash64(F.col("key"), F.lit(1), F.lit(-1), F.col("_mid")))).otherwise(F.array().cast("array<bigint>"))
    variants = seats.select(*_LINE, "_at", "piece", (F.col("longer") == 0).alias("_short"), F.explode(F.concat(F.transform(deletions, lambda h: F.struct(h.alias("h"), (F.col("longer") == 1).alias("i"))), F.transform(itself, lambda h: F.struct(h.alias("h"), F.lit(True).alias("i"))))).alias("_v"))
    variants = variants.select(*_LINE, "_at", "piece", F.col("_v.h").alias("_key"), F.when(~F.col("_v.i"), 0).when(F.col("_short"), 1).otherwise(2).alias("_kind"))
    # The earliest of each key: among equals for substitutions, on either side for insertions.
    best = variants.groupBy("_key").agg(*[F.min(F.when(F.col("_kind") == k, F.col("_at"))).alias(f"_m{k}") for k in (0, 1, 2)])
    best = best.join(variants.groupBy("_key").agg(F.count("*").alias("_c")).where("_c > 1"), "_key").drop("_c")
    met = salted_lookup(variants, best, "_key", F.col("_h1"))
    other = F.when(F.col("_kind") == 0, F.col("_m0")).when(F.col("_kind") == 1, F.col("_m2")).otherwise(F.col("_m1"))
    pairs = met.withColumn("_other", other).where("_other < _at").groupBy(*_LINE, "_at", "_other").agg(F.min("piece").alias("piece"))
    # Equal keys are equal hashes: the lines themselves are held against each other.
    mine = texts.select("_at", F.col("_line").alias("_mine"))
    theirs = texts.select(F.col("_at").alias("_other"), F.col("_line").alias("_theirs"))
    held = pairs.join(mine, "_at").join(theirs, "_other").withColumns({"_m": F.least(F.length("_mine"), F.length("_theirs"))})
    a = F.floor(F.col("_m") * F.col("piece") / _pieces(F.col("_m"))).cast("int")
    rest = F.col("_m") - F.floor(F.col("_m") * (F.col("piece") + 1) / _pieces(F.col("_m"))).cast("int")
    before = lambda x: F.substring(x, F.lit(1), a)
    after = lambda x: F.substring(x, F.length(x) - rest + 1, rest)
    middle = lambda x: F.substring(x, a + 1, F.length(x) - a - rest)
    # The edit distance of all but what both begin and end with: on long lines, of a small piece.
    same = (before("_mine") == before("_theirs")) & (after("_mine") == after("_theirs"))
    return held.where(same & F.levenshtein(middle("_mine"), middle("_theirs"), 1).between(0, 1)).select(*_LINE).distinct()


def remove_repeats(docs: DataFrame, id_col: str, text_col: str, near: bool = True, near_chars: int = NEAR_CHARS, counts: bool = True) -> DataFrame:
    """The rows of ``docs`` with the text changed, and ``n_lines`` and ``n_removed`` after their own columns.

    A line (between line feeds) goes if an earlier line, of a document of a smaller id or further up in its own, equals it or, with ``near``, is within one
    edit (a character inserted, deleted or replaced) and both have ``near_chars`` characters or more (at least 8). Lines are judged on the input. Empty lines stay. A null
    text stays null and has no lines. Rows with a null id are neither changed nor held against others. Repeated rows of one id with one text count as
    one document and are changed alike; rows of one id with other texts share that id's place in the order, so that equal lines at one number don't remove each
    other. An empty table gives an empty table. Ids are integers of up to 64 bits. Exact repeats are told by two 64-bit hashes of other seeds, near ones on the
    lines themselves. A line of any length is one value in one task. All columns are kept, but that with ``counts`` columns of the names
    ``n_lines`` and ``n_removed`` are replaced; only names that begin with an underscore are reserved.
    """
    kind = dict(docs.dtypes)[id_col]
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{id_col} must hold integers, not {kind}")
    added = ["n_lines", "n_removed"] if counts else []
    own = [c for c in docs.columns if c not in added]
    rows = docs.withColumns({"_id": F.col(id_col), "_text": F.col(text_col), "_row": F.xxhash64(F.col(text_col))})
    slim = rows.select("_id", "_text", "_row")
    n = F.length("_line")
    keyed = _occurrences(slim)
    halves = [F.when(F.col("_n") >= max(8, near_chars), _surroundings("_line", "_n", F.col("_n") - m, p, 2)).alias(f"_k{m}{p}") for m in (0, 1) for p in (0, 1)] if near else []
    names = [f"_k{m}{p}" for m in (0, 1) for p in (0, 1)] if near else []
    keyed = keyed.withColumn("_n", n).select("*", *halves)
    distinct = keyed.groupBy(*_LINE).agg(F.min("_at").alias("_at"), F.max("_at").alias("_last"), *[F.min(k).alias(k) for k in names])
    distinct = materialise(distinct, "lines")
    tasks = parallelism(slim, 8 << 20)
    # Lines are dealt instead of texts. Two jobs read this: that which fetches candidates, and the last one.
    split = rows.withColumn("_lines", F.split("_text", "\n", -1)).drop("_text", text_col)
    dealt = split.where("_id is not null").repartition(tasks, "_id")
    several = distinct.where("_last > _at").select(*_LINE, "_at", F.lit(False).alias("_near"))
    if near:
        sides = F.array(*[F.struct(F.col(k).alias("key"), F.lit(int(k[2])).alias("longer")) for k in names])
        seats = distinct.where("_k00 is not null").select(*_LINE, "_at", F.explode(sides).alias("_e")).select(*_LINE, "_at", "_e.*")
        shared = seats.groupBy("key").agg(F.min("_at").alias("a"), F.max("_at").alias("b"), F.min("longer").alias("c")).where("a <> b and c = 0").select("key", F.lit(True).alias("_shared"))
        left = materialise(salted_lookup(seats, shared, "key", F.col("_h1")).where("_shared").select(*_LINE, "_at").distinct(), "candidates")
        # Candidates' texts, from the documents that they first stand in.
        where = left.select((F.floor(F.col("_at") / F.lit(1 << 31).cast("decimal(10,0)"))).cast("bigint").alias("_id"), F.pmod(F.col("_at"), F.lit(1 << 31).cast("decimal(10,0)")).cast("int").alias("_no"), *_LINE, "_at")
        wanted = where.groupBy("_id").agg(F.collect_list(F.struct("_no", *_LINE, "_at")).alias("_wanted"))
        found = dealt.select("_id", "_lines").join(wanted, "_id").select("_lines", F.explode("_wanted").alias("_w"))
        texts = found.select("_w._h1", "_w._h2", "_w._at", F.get("_lines", F.col("_w._no")).alias("_line")).where((F.xxhash64("_line") == F.col("_h1")) & (_second("_line") == F.col("_h2")))
        texts = materialise(texts.dropDuplicates(_LINE), "candidate-texts")
        close = materialise(_near(texts).withColumn("_near", F.lit(True)), "near-lines")
        several = distinct.select(*_LINE, "_at", "_last").join(close, _LINE, "left").where("_near or _last > _at").select(*_LINE, "_at", F.coalesce("_near", F.lit(False)).alias("_near"))
    lines = _occurrences(slim).drop("_line").withColumnRenamed("_at", "_here")
    looked = salted_lookup(lines, several, _LINE, F.col("_id"))
    gone = looked.where("_near or _here > _at").groupBy("_id", "_row").agg(F.collect_set("_no").alias("_gone"))
    # Rows with a null id have nothing to look up, so they aren't dealt by it.
    out = dealt.join(gone, ["_id", "_row"], "left").unionByName(split.where("_id is null").withColumn("_gone", F.lit(None).cast("array<int>")))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    kept_lines = F.when(F.col("_gone").isNull(), F.col("_lines")).otherwise(F.transform(stay, lambda i: F.get(F.col("_lines"), i)))
    text = F.when(F.col("_lines").isNotNull(), F.array_join(kept_lines, "\n"))
    lines_in = F.when(F.col("_lines").isNull(), F.lit(0)).otherwise(F.size("_lines")).cast("bigint")
    kept = [text.alias(c) if c == text_col else F.col(f"`{c}`") for c in own]
    made = [lines_in.alias("n_lines"), F.coalesce(F.size("_gone"), F.lit(0)).cast("bigint").alias("n_removed")]
    return out.select(*kept, *made[: len(added)])


def oracle() -> str:
    """DuckDB SQL for documents' lines: every deletion of every line, joined."""
    return """
WITH o AS (SELECT doc_id, no, line, doc_id::HUGEINT * 2147483648 + no AS place FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS no FROM documents WHERE doc_id IS NOT NULL)),
     l AS (SELECT line, min(place) AS first FROM o WHERE line <> '' GROUP BY 1),
     v AS (SELECT line, first, 0 AS cut, line AS v FROM l WHERE length(line) >= 16 UNION ALL SELECT line, first, i, substr(line, 1, i - 1) || substr(line, i + 1) FROM l, unnest(range(1, length(line) + 1)) u(i) WHERE length(line) >= 16),
     near AS (SELECT DISTINCT b.line FROM v a JOIN v b ON a.v = b.v AND a.first < b.first AND a.line <> b.line AND (a.cut = b.cut OR length(a.line) <> length(b.line))),
     gone AS (SELECT doc_id, no FROM o JOIN l USING (line) WHERE place > first OR line IN (SELECT line FROM near)),
     k AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY no) AS text, count(*) AS kept FROM o WHERE (doc_id, no) NOT IN (SELECT doc_id, no FROM gone) GROUP BY 1)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, coalesce(len(string_split(d.text, chr(10))), 0)::BIGINT AS n_lines, (coalesce(len(string_split(d.text, chr(10))), 0) - coalesce(k.kept, 0))::BIGINT AS n_removed
FROM documents d LEFT JOIN k USING (doc_id)
    """
