"""Every corpus operator against a brute-force version, on small tables with nulls, empties, ties, repeats and clashing names."""

import base64
import hashlib
import re
import time

import numpy as np
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

import public_tokenizers
from tessera.llm import ann, bpe, langid, lines, mixing, simhash, substrings, topk, toxicity, warc
from tessera.llm._common import materialise, measured_lookup, scratch_path, shared_dir
from tessera.llm._graph import components

LONG = "lorem ipsum dolor sit amet " * 8000
BASE = "the quick brown fox jumps over the lazy dog while another fox sleeps under a tree by the river bank"
TEXTS = [
    (1, BASE + "\nsecond line of the first document"),
    (2, BASE + "\nsecond line of the first documenT"),
    (3, BASE),
    (4, None),
    (5, ""),
    (6, "   \n\t "),
    (7, "é" * 60 + BASE + "日本語"),
    (8, LONG),
    (9, "a"),
    (10, BASE.replace("lazy", "idle")),
    (3, BASE),
    (None, BASE),
    (12, "a" * 200),
    (13, "a" * 120 + "b"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", 1, 2) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id bigint, text string, score string, n_tokens int, component_id int")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# Byte-level BPE


@pytest.fixture(scope="module")
def encoding():
    ranks = bpe.load(bpe.default_vocabulary())
    return ranks, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks.rank, special_tokens={})


def test_bpe_is_tiktoken(encoding):
    ranks, theirs = encoding
    rng = np.random.default_rng(3)
    parts = ["a", "b", "th", "e", " ", "  ", "\n", "é", "ß", "1", "9", ".", "!", "\x1c", "\x85", "　", "中", "😀", "ing", "tion", "\t", "'s", "\xa0", "=", "²", "Ⅷ"]
    for n in (0, 1, 2, 7, 40, 300, 3000):
        for _ in range(40):
            text = "".join(parts[i] for i in rng.integers(0, len(parts), n))
            assert ranks.encode(text) == theirs.encode_ordinary(text)
    for text in ("a" * 5000 + "ab" * 3000 + "=" * 4097, " " * 3000, "é" * 3001, "x" * 1_000_000):
        assert ranks.encode(text) == theirs.encode_ordinary(text)
        assert ranks.decode(ranks.encode(text)) == text.encode()


def test_bpe_join_is_associative(encoding):
    ranks, theirs = encoding
    data = ("anticonstitutionally" * 30).encode()
    for cut in range(1, len(data), 37):
        assert ranks.join(ranks.encode_bytes(data[:cut]), ranks.encode_bytes(data[cut:])) == ranks.encode_bytes(data)


def test_bpe_rows(docs, empty, encoding):
    _, theirs = encoding
    want = []
    for i, t in TEXTS:
        ids = theirs.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert rows_of(bpe.encode_texts(docs, "doc_id", "text", ids=False, digests=True)) == sorted(want, key=repr)
    encoded = bpe.encode_texts(docs, "doc_id", "text")
    decoded = bpe.decode_ids(encoded, "doc_id", "token_ids")
    assert sorted((r[0], bytes(r[1])) for r in decoded.where("doc_id is not null").collect()) == sorted((i, (t or "").encode()) for i, t in TEXTS if i is not None)
    assert bpe.encode_texts(empty, "doc_id", "text").count() == 0


# WARC


def test_warc_round_trip(spark):
    pages = [(1, "http://a/", "<p>hi</p>"), (2, None, "<p>hi</p>"), (3, "http://c/", None), (4, "http://d/", ""), (5, "http://e/\r\nX: y", "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n"), (9, "u", "é" * 70_000), (9, "u", "other"), (None, "x", "y")]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id bigint, url string, html string, record_type string")
    got = warc.round_trip(df).select("page_id", "payload_bytes", "payload_digest", "response.record_type", "refers_to")
    want, first = [], {}
    for i, _, t in sorted((p for p in pages if p[0] is not None), key=lambda p: p[0]):
        body = (t or "").encode()
        f = first.setdefault(body, i)
        want.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if f == i else "revisit", None if f == i else f))
    assert rows_of(got) == sorted(want, key=repr)
    assert warc.round_trip(df.where("false")).count() == 0


def test_warc_records_and_assembly(spark):
    df = spark.createDataFrame([(7, "http://a/b", "body\r\n\r\n")], "page_id bigint, url string, html string")
    path = scratch_path(spark, "archive")
    warc.write(df, path, "page_id", "url", "html")
    records = warc.read(spark, path)
    assert sorted(r.record_type for r in records.collect()) == ["metadata", "request", "response"]
    row = warc.assemble(records).first()
    assert bytes(row.response.block).endswith(b"body\r\n\r\n") and row.response.actual_digest == row.response.payload_digest
    assert bytes(row.request.block).startswith(b"GET http://a/b") and b"pageId: 7" in bytes(row.metadata.block)
    lone = warc.assemble(records.where("record_type = 'response'")).first()
    assert lone.request is None and lone.metadata is None


def test_warc_keeps_any_bytes_and_large_payloads(spark):
    """Payloads of line ends and headers at random, one of several megabytes, and archives that are read in pieces."""
    rng = np.random.default_rng(8)
    parts = ["\r", "\n", "\r\n", "\r\n\r\n", "WARC/1.1", "Content-Length: 3", "x", "é"]
    pages = [(i, f"http://{i}/", "".join(parts[k] for k in rng.integers(0, len(parts), int(rng.integers(0, 12))))) for i in range(300)]
    pages.append((1000, "http://long/", "\r\n\r\n".join(["a" * 70_000] * 60)))
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").repartition(3)
    got = warc.round_trip(df, blocks=True).collect()
    first = {}
    for i, _, t in pages:
        first.setdefault(t, i)
    assert len(got) == len(pages)
    for r in got:
        text = dict((i, t) for i, _, t in pages)[r.page_id]
        if first[text] == r.page_id:
            assert bytes(r.response.block).partition(b"\r\n\r\n")[2] == text.encode() and r.refers_to is None
        else:
            assert r.refers_to == first[text]
        assert r.request.target_uri == f"http://{r.page_id}/" or r.page_id == 1000


def test_warc_parser_passes_over_what_is_broken():
    record = lambda size, block: b"WARC/1.1\r\nWARC-Type: x\r\nContent-Length: " + size + b"\r\n\r\n" + block + b"\r\n\r\n"
    data = record(b"many", b"lost") + record(b"4", b"kept") + b"junk\r\n\r\n" + record(b"0", b"") + record(b"99", b"cut off")
    parser = warc.Parser()
    assert [block for piece in data.split(b"\r\n\r\n") for _, block in parser.feed(piece)] == [b"kept", b""]


def test_warc_joins_stand(spark):
    """The query's rows rest on the joins through concurrent-to: the optimizer can't remove them."""
    records = spark.createDataFrame([], "record_type string, record_id string, concurrent_to string, refers_to string, target_uri string, payload_digest string, payload_bytes bigint, actual_digest string, block binary")
    got = warc.resolved(warc.assemble(records)).select("page_id", "payload_bytes", "refers_to", "request.target_uri")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("concurrent_to") >= 2 and plan.count("Join LeftOuter") >= 2 and "request" in plan and "metadata" in plan


# Mixing


def test_mixing_meets_targets(spark):
    rows = [(i, "a" if i % 3 else "b", "en" if i % 5 else None, "word " * (i % 50 + 1)) for i in range(1, 900)] + [(None, None, "de", None), (5, "a", "en", "word")]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, text string").withColumn("rate", F.lit("clash"))
    mixed = mixing.mixture(mixing.features(df, "doc_id", "text")).cache()
    assert mixed.count() == len(rows)
    total = mixed.agg(F.sum("tokens")).first()[0]
    for d, power in mixing.EXPONENTS.items():
        sums = {r[0]: (r[1], r[2]) for r in mixed.groupBy(d).agg(F.sum("tokens"), F.sum(F.col("rate") * F.col("tokens"))).collect()}
        scale = sum(n**power for n, _ in sums.values() if n)
        for n, fitted in sums.values():
            assert fitted == pytest.approx(mixing.BUDGET * total * (n**power if n else 0) / scale, rel=1e-3, abs=0.5)
    assert mixed.where("copies > rate + 1 or copies < rate - 1").count() == 0
    assert mixing.mixture(mixing.features(df.where("false"), "doc_id", "text")).count() == 0


# SimHash


def brute_fingerprint(text, words):
    low = (text or "").translate({k: k + 32 for k in range(65, 91)})
    tokens = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not tokens:
        return 0
    shingles = [" ".join(tokens[k : k + words]) for k in range(len(tokens) - words + 1)] or [" ".join(tokens)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_simhash_rows(docs, empty):
    known = [(i, t) for i, t in TEXTS if i is not None]
    prints = {i: brute_fingerprint(t, 3) for i, t in known}
    linked = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    least = brute_components(linked, prints)
    got = simhash.near_duplicates(docs, "doc_id", "text")
    assert rows_of(got.where("doc_id is not null")) == sorted(((i, f"{prints[i]:016x}", least[i]) for i, _ in known), key=repr)
    assert got.where("doc_id is null").count() == 1
    assert simhash.near_duplicates(empty, "doc_id", "text").count() == 0


def test_simhash_of_a_lone_null_id(spark):
    """A fingerprint that only a null id has takes part in links, and its row gets the component's id."""
    words = [f"w{k}" for k in range(400)]
    texts = {1: " ".join(words), None: next(t for k in range(400) if 0 < (brute_fingerprint(t := " ".join(words[:k] + ["other"] + words[k + 1 :]), 3) ^ brute_fingerprint(" ".join(words), 3)).bit_count() <= 3)}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = simhash.near_duplicates(df, "doc_id", "text").collect()
    assert len({r.fingerprint for r in got}) == 2 and {r.component_id for r in got} == {1}


def test_simhash_links_with_small_buckets(spark, monkeypatch):
    """Buckets that are cut up again and again find the same components."""
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    fps = {int(c) for c in centres}
    for c in centres:
        x = int(c)
        for _ in range(60):
            x ^= 1 << int(rng.integers(64)) | 1 << int(rng.integers(64))
            fps.add(x)
    fps = sorted(fps)
    linked = [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= 3]
    want = brute_components(linked, fps)
    df = simhash.with_table(spark.createDataFrame([(simhash._signed(x),) for x in fps], "_fp bigint"))
    for most in (4096, 20):
        monkeypatch.setattr(simhash, "BUCKET", most)
        got = components(simhash.links(df), "a", "b").collect()
        groups: dict[int, set] = {}
        for r in got:
            groups.setdefault(r.root, set()).add(r.node % (1 << 64))
        truth: dict[int, set] = {}
        for x, r in want.items():
            truth.setdefault(r, set()).add(x)
        assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in truth.values() if len(g) > 1)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5)], "a bigint, b bigint")
    got = {r.node: r.root for r in components(edges, "a", "b").collect()}
    assert got == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000}


# Lines


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def test_lines(spark):
    line = "a line that is long enough to count, no. 1"
    rows = [(1, line + "\nshort\nshort\n" + line), (2, line.replace("1", "2") + "\nown line of the second document"), (3, "x" + line), (4, None), (5, ""), (6, line.replace("line", "lime").replace("1", "3")), (7, "short\n\n\n"), (8, "own line of the second documen"), (8, "own line of the second documen"), (None, line), (9, LONG), (10, LONG[:-1]), (11, line[1:] + "\n" + line[:-1] + "é")]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id bigint, text string, n_lines string").withColumns({"line": F.lit(1), "n_removed": F.lit("clash")})
    seen, want = [], []
    done = {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        if (i, t) in done:
            want.append(done[i, t])
            continue
        kept, gone = [], 0
        for x in (t or "").split("\n"):
            if len(x) >= lines.LEAST_CHARS:
                drop = any(within_one(x, y) for y in seen)
                seen.append(x)
                if drop:
                    gone += 1
                    continue
            kept.append(x)
        done[i, t] = (i, None if t is None else "\n".join(kept), 0 if t is None else t.count("\n") + 1, gone)
        want.append(done[i, t])
    want.append((None, line, 1, 0))
    got = lines.remove_repeats(df, "doc_id", "text")
    assert got.columns == ["doc_id", "text", "line", "n_lines", "n_removed"]
    assert rows_of(got.drop("line")) == sorted(want, key=repr)
    kept = lines.remove_repeats(df, "doc_id", "text", counts=False)
    assert kept.columns == df.columns and {(r.n_lines, r.n_removed) for r in kept.collect()} == {("clash", "clash")}
    with pytest.raises(TypeError):
        lines.remove_repeats(df.withColumn("doc_id", F.lit("a")), "doc_id", "text")
    assert lines.remove_repeats(df.where("false"), "doc_id", "text").count() == 0


def test_lines_run_no_python(spark):
    df = spark.createDataFrame([(1, "a line that is long enough to count\nanother")], "doc_id bigint, text string")
    plan = lines.remove_repeats(df, "doc_id", "text")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# Repeated substrings


def brute_cut(rows, n):
    out, seen = [], {}
    for i, data in sorted(rows, key=lambda r: r[0]):
        gone = np.zeros(len(data), bool)
        for k in range(len(data) - n + 1):
            if seen.get(data[k : k + n], i) < i:
                gone[k : k + n] = True
        for k in range(len(data) - n + 1):
            seen.setdefault(data[k : k + n], i)
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        out.append((i, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_substrings_rows(docs, empty):
    known = [(i, (t or "").encode()) for i, t in TEXTS if i is not None]
    got = substrings.remove_repeats(docs, "doc_id", "text")
    assert rows_of(got.where("doc_id is not null")) == brute_cut(known, 50)
    null = got.where("doc_id is null").first()
    assert (null.n_removed, null.n_bytes) == (0, len(BASE))
    assert substrings.remove_repeats(empty, "doc_id", "text").count() == 0


@pytest.mark.parametrize("limits", [{}, {"GATHER": 40, "MARK": 2, "HOT": 3, "PIECE": 500}])
def test_substrings_random(spark, monkeypatch, limits):
    """Also with limits so small that most K-grams are common ones."""
    for name, value in limits.items():
        monkeypatch.setattr(substrings, name, value)
    rng = np.random.default_rng(9)
    passages = ["".join(rng.choice(list("abcde "), n)) for n in (49, 50, 51, 80, 200, 400)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(int(rng.integers(0, 5))):
            p = passages[int(rng.integers(len(passages)))]
            a = int(rng.integers(0, 20))
            parts += ["".join(rng.choice(list("abcde "), int(rng.integers(0, 60)))), p[a:]]
        rows.append((i * 3, "".join(parts) + ("ab" * 90 if i % 7 == 0 else "")))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert rows_of(substrings.remove_repeats(df, "doc_id", "text")) == brute_cut([(i, t.encode()) for i, t in rows], 50)


def test_substrings_of_one_phrase_in_many_contexts(spark, monkeypatch):
    """One passage between other neighbours in each document, and rows of one id with different texts."""
    monkeypatch.setattr(substrings, "HOT", 20)
    rng = np.random.default_rng(12)
    noise = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    passage = noise(58)
    rows = [(i, noise(40) + passage + noise(40)) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    assert rows_of(substrings.remove_repeats(df, "doc_id", "text")) == brute_cut([(i, t.encode()) for i, t in rows], 50)
    twice = [(1, "x" * 3 + passage), (1, passage + noise(30)), (2, noise(9) + passage)]
    got = rows_of(substrings.remove_repeats(spark.createDataFrame(twice, "doc_id bigint, text string"), "doc_id", "text").select("doc_id", "n_removed"))
    assert got == [(1, 0), (1, 0), (2, 58)]


def test_substrings_leave_no_shuffle_and_open_no_chance_meeting(spark, monkeypatch):
    """A phrase of 30 bytes between other neighbours is no repeat, so no context of it is fetched; what the anchors were shuffled in is gone before the last step."""
    made = []
    monkeypatch.setattr(substrings, "materialise", lambda df, label, **how: made.append((label, materialise(df, label, **how))) or made[-1][1])
    rng = np.random.default_rng(15)
    noise = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    phrase, passage = noise(30), noise(90)
    rows = [(i, noise(60) + (passage if i in (7, 30) else phrase) + noise(60)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {x for x in map(str, (disk.getAllFiles().apply(i).getName() for i in range(disk.getAllFiles().size()))) if x.startswith("shuffle_")}
    before = shuffled()
    got = substrings.remove_repeats(df, "doc_id", "text")
    for _ in range(50):
        if not shuffled() - before:
            break
        time.sleep(0.1)
    assert not shuffled() - before
    opened = {r._doc for label, x in made if label == "anchors" for r in x.where("_open").collect()}
    assert opened == {7, 30}
    assert rows_of(got) == brute_cut([(i, t.encode()) for i, t in rows], 50)


@pytest.mark.parametrize(("length", "hot"), [(28, 4096), (28, 3), (51, 3), (83, 4096), (83, 3)])
def test_substrings_of_other_lengths(spark, monkeypatch, length, hot):
    """Windows of the least and of the greatest length, which differ from each other by a byte more or less on either side."""
    monkeypatch.setattr(substrings, "HOT", hot)
    rng = np.random.default_rng(length)
    noise = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    passages = [noise(length + n) for n in (-1, 0, 1, 9, 40)]
    rows = [(i, noise(int(rng.integers(0, 70))) + passages[i % 5] + noise(int(rng.integers(0, 70)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert rows_of(substrings.remove_repeats(df, "doc_id", "text", length=length)) == brute_cut([(i, t.encode()) for i, t in rows], length)


def test_anchors_do_not_depend_on_stretches(monkeypatch):
    texts = [("ab" * 400 + LONG[:3000]).encode(), b"", b"x" * 49, b"y" * 50, LONG[:777].encode()]
    whole = substrings.Flat(texts, 50).anchors()
    monkeypatch.setattr(substrings, "STRETCH", 64)
    assert all((a == b).all() for a, b in zip(whole, substrings.Flat(texts, 50).anchors(), strict=True))


def test_longest_previous_factors():
    rng = np.random.default_rng(3)
    suffixes = rng.integers(97, 99, (200, 11), dtype=np.uint8)
    docs = rng.integers(0, 30, 200)
    shared = lambda x, y: next((k for k in range(len(x)) if x[k] != y[k]), len(x))
    want = [max((shared(suffixes[i], suffixes[j]) for j in range(200) if docs[j] < docs[i]), default=0) for i in range(200)]
    assert substrings.longest_previous_factors(suffixes, docs).tolist() == want


# Toxicity


def test_block_max_is_exact():
    rng = np.random.default_rng(1)
    vocabulary = {f"t{i}": float(rng.uniform(0.5, 4)) for i in range(60)}
    examples = [(i, int(rng.integers(2)), {f"t{j}": int(rng.integers(1, 5)) for j in rng.choice(60, int(rng.integers(0, 9)), replace=False)}) for i in range(700)]
    index = toxicity.Index(vocabulary, examples, (1.0, 1.0))
    dense = {}
    for key, _, counts in examples:
        v = np.zeros(60)
        ids, weights = index.vector(counts)
        v[ids] = weights
        dense[key] = v
    for _ in range(100):
        ids, weights = index.vector({f"t{j}": int(rng.integers(1, 4)) for j in rng.choice(60, 5, replace=False)})
        found, scores = index.nearest(ids, weights, 10)
        q = np.zeros(60)
        q[ids] = weights
        want = sorted((-float(dense[int(k)] @ q) for k in index.keys))[:10]
        assert np.allclose(-scores, want)


def test_toxicity_learns_and_holds_out(spark):
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("aeiorst"), 6)) for _ in range(400)]
    docs, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        text = " ".join(rng.choice(words, 60)) + (" wretch vilefoul vilemean" if toxic else "")
        docs.append((i, text))
        labels.append((i, int(toxic)))
    docs += [(1000, None), (1001, ""), (1002, "vilefoul vileness wretch"), (1002, "vilefoul vileness wretch"), (1003, LONG)]
    labels += [(None, 1), (7, None), (1000, 0)]
    df = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id bigint, text string, score string")
    held = toxicity.held_out("doc_id", 5, 0)
    index = toxicity.fit(df, spark.createDataFrame(labels, "doc_id bigint, toxic int"), "doc_id", "text", "toxic", learn=~held)
    got = toxicity.score(df, index, "doc_id", "text", evidence=True).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert all(by[i].predicted == (1 if i % 4 == 0 else 0) for i in range(400))
    assert by[1000].predicted == by[1001].predicted == by[1003].predicted == 0 and by[1002].predicted == 1 and len(by[1002].evidence_ids) > 0
    assert toxicity.score(df.where("false"), index, "doc_id", "text").count() == 0
    whole = toxicity.score(df, index, "doc_id", "text", keep_columns=True)
    assert whole.columns == ["doc_id", "text", "score", "predicted"] and dict(whole.dtypes)["score"] == "double"
    none = toxicity.fit(df, spark.createDataFrame([], "doc_id bigint, toxic int"), "doc_id", "text", "toxic")
    assert {r.predicted for r in toxicity.score(df, none, "doc_id", "text").collect()} == {0}


def test_toxicity_votes_against_brute_force():
    """Raw scores from all cosines in order, and the monotone map from all examples with each left out."""
    rng = np.random.default_rng(5)
    vocabulary = {f"t{i}": float(rng.uniform(0.5, 4)) for i in range(40)}
    examples = [(i, int(rng.random() < 0.3), {f"t{j}": int(rng.integers(1, 4)) for j in rng.choice(40, int(rng.integers(0, 7)), replace=False)}) for i in range(300)]
    examples += [(1000 + i, i % 2, examples[7][2]) for i in range(20)]  # equal vectors with both labels
    shares = (1.5, 2.5)
    index = toxicity.Index(vocabulary, examples, shares)
    index.calibrate([index.left_out(n) for n in range(len(index.vectors))])
    at = {k: i for i, k in enumerate(index.keys.tolist())}
    dense = np.zeros((len(at), 40))
    label = np.zeros(len(at))
    for key, y, counts in examples:
        if key in at:
            ids, weights = index.vector(counts)
            dense[at[key], ids], label[at[key]] = weights, y

    def brute(v, but=-1):
        cosines = dense @ v
        order = [n for n in np.lexsort((np.arange(len(cosines)), -np.round(cosines, 12))) if cosines[n] > 1e-12 and n != but][: toxicity.NEIGHBOURS]
        if not order:
            return index.without
        worth = np.where(label[order] > 0, shares[1], shares[0]) / shares[0]
        votes = cosines[order] ** 2 * worth
        scale = toxicity.SHRINK * float(index.worth.min())
        return float((votes @ label[order] + scale * index.without) / (votes.sum() + scale))

    for _ in range(60):
        ids, weights = index.vector({f"t{j}": int(rng.integers(1, 4)) for j in rng.choice(40, 5, replace=False)})
        v = np.zeros(40)
        v[ids] = weights
        assert index._raw(ids, weights)[0] == pytest.approx(brute(v), abs=1e-9)
    levels = [y for _, y, _ in index.reliability]
    assert levels == sorted(levels) and all(0 <= y <= 1 for y in levels)
    raw = np.r_[[brute(dense[n], n) for n in range(len(dense))], [index.without] * (len(examples) - len(dense))]
    worth = np.r_[np.where(label > 0, shares[1], shares[0]), [shares[y] for _, y, c in examples if not c]]
    truth = np.r_[label, [y for _, y, c in examples if not c]]
    got = np.array([index.calibrated(x) for x in raw])
    assert (got * worth).sum() == pytest.approx((truth * worth).sum(), rel=0.1)  # calibrated in the large
    assert (worth * (got - truth) ** 2).sum() <= (worth * (raw - truth) ** 2).sum()


# Languages


def test_languages(spark):
    rng = np.random.default_rng(4)
    letters = {"aa": list("abcd"), "bb": list("efgh"), "cc": list("ijkl")}
    word = lambda g: "".join(rng.choice(letters[g], 5))
    docs = [(i, " ".join(word(g) for _ in range(30)), g) for i, g in enumerate(["aa", "bb", "cc"] * 30)]
    extra = [(900, None, "aa"), (901, "123 ...", "bb"), (902, "", None), (903, word("aa") + " " + word("aa"), None), (904, " ".join([word("aa") for _ in range(60)] + [word("bb") for _ in range(30)]), None)]
    df = spark.createDataFrame([(*d, "clash") for d in docs + extra], "doc_id bigint, text string, lang string, score string")
    model = langid.fit(df, "doc_id", "text", "lang", learn=F.col("doc_id") < 60)
    got = {r.doc_id: r for r in langid.predict(df, model, "doc_id", "text").collect()}
    assert all(got[i].lang_pred == g for i, _, g in docs)
    assert [got[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "aa"]
    assert got[904].languages == ["aa", "bb"] and got[904].shares[0] == pytest.approx(2 / 3, abs=0.05)
    assert langid.predict(df.where("false"), model, "doc_id", "text").count() == 0
    nothing = langid.fit(df.where("false"), "doc_id", "text", "lang")
    assert {r.lang_pred for r in langid.predict(df, nothing, "doc_id", "text").collect()} == {"und"}


def test_language_sets_against_all_subsets(spark):
    """The chosen set has the best penalised likelihood of all sets; ties, repeats and a very long text."""
    from itertools import combinations

    rng = np.random.default_rng(6)
    letters = {"aa": list("abcdx"), "bb": list("cdefx"), "cc": list("efghx")}
    word = lambda g: "".join(rng.choice(letters[g], 6))
    rows = [(i, " ".join(word(g) for _ in range(40)), g) for i, g in enumerate(["aa", "bb", "cc"] * 40)]
    rows += [(1000, " ".join(word("aa") for _ in range(60_000)), None), (1001, rows[0][1], None), (1001, rows[0][1], None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.fit(df, "doc_id", "text", "lang")
    texts = [" ".join([word("aa")] * a + [word("bb") for _ in range(b)] + [word("cc") for _ in range(c)]) for a, b, c in rng.integers(0, 25, (40, 3)) if a + b + c]
    same = 0
    for text in texts:
        words = model.words(text)
        best = max((model.mixture(words[:, list(s)])[1] - langid.PENALTY * (len(s) - 1) * np.log(1 + len(words)), s) for n in (1, 2, 3) for s in combinations(range(3), n))
        same += sorted(model.infer(text)[0]) == sorted(model.languages[i] for i in best[1])
    assert same >= len(texts) - 1
    got = langid.predict(df, model, "doc_id", "text").collect()
    assert [r.lang_pred for r in got if r.doc_id == 1000] == ["aa"] and len([r for r in got if r.doc_id == 1001]) == 2


# Vectors


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(900, 12))
    rows = [(i, [float(v) for v in x[i]]) for i in range(900)]
    rows += [(i, rows[0][1]) for i in range(900, 960)]  # ties
    rows += [(2000, None), (2050, [0.0] * 12), (2100, [float("nan")] * 12), (2150, [None] * 12), (2200, []), (None, rows[1][1]), (2300, [1.0, 2.0]), (2350, [2.0, 1.0]), (50, rows[50][1])]
    return spark.createDataFrame([(*r, "clash") for r in rows], "vec_id bigint, embedding array<double>, score string"), rows


def test_top_k(vectors, monkeypatch):
    df, rows = vectors
    monkeypatch.setattr(topk, "SHARD", 60)
    monkeypatch.setattr(topk, "WAVE", 2)
    ok = [(i, [int(np.floor(1024 * v)) for v in e]) for i, e in rows if i is not None and e and all(v is not None and np.isfinite(v) for v in e)]
    want = []
    for q, e in {i: e for i, e in ok if i % 100 == 0 or i == 2350}.items():
        scores = sorted((-sum(a * b for a, b in zip(e, f, strict=True)), i) for i, f in ok if i != q and len(f) == len(e))[:10]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    got = topk.top_k(df, df.where("vec_id % 100 = 0 or vec_id = 2350"), "vec_id", "embedding")
    assert rows_of(got) == sorted(want, key=repr)
    assert topk.top_k(df.where("false"), df, "vec_id", "embedding").count() == 0


def cosine(a, b):
    return float((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())))


def test_nearest(vectors):
    """Exact cosines in exact order, ties and repeated rows included."""
    df, rows = vectors
    ok = [(i, np.array(e)) for i, e in rows if i is not None and e and all(v is not None and np.isfinite(v) for v in e) and any(e)]
    got = ann.nearest(df, df.where("vec_id % 50 = 0"), "vec_id", "embedding")
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    got = sorted(got.collect())
    hits = total = 0
    for q, e in {i: e for i, e in ok if i % 50 == 0}.items():
        best = sorted((-cosine(e, f), i) for i, f in ok if i != q and len(f) == len(e))[:5]
        own = [r for r in got if r.query_id == q]
        assert [r.rank for r in own] == list(range(1, len(best) + 1))
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        assert all(any(r.score == pytest.approx(cosine(e, f), abs=1e-12) for i, f in ok if i == r.vec_id) for r in own)
        hits += len({i for _, i in best} & {r.vec_id for r in own}) + len(best) - len({i for _, i in best})
        total += len(best)
    assert hits >= 0.9 * total
    for q in (0, 900, 950):  # the common vector: ties go to the smallest ids
        assert [r.vec_id for r in got if r.query_id == q] == [x for x in [0, *range(900, 960)] if x != q][:5]
    assert ann.nearest(df.where("false"), df, "vec_id", "embedding").count() == 0


def test_reach_does_not_depend_on_the_number_of_shards(spark, monkeypatch):
    """The same vectors get the same reach, and all queries a recall of 0.9, whether the table has one shard or several."""
    rng = np.random.default_rng(21)
    x = rng.normal(size=(2400, 16))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id bigint, embedding array<double>").repartition(3)
    met, ratios, meet = [], [], ann.meet
    monkeypatch.setattr(ann, "meet", lambda points, asked, build, *rest: met.append(rest[-1]) or ratios.append(build(np.arange(800), x[:800]).ratio) or meet(points, asked, build, *rest))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for shard in (4000, 1200, 400):
        monkeypatch.setattr(ann, "SHARD", shard)
        got = ann.nearest(df, df.where("vec_id % 5 = 0"), "vec_id", "embedding").collect()
        hits = 0
        for q in range(0, 2400, 5):
            like = unit @ unit[q]
            like[q] = -2
            hits += len(set(np.argsort(-like)[:5].tolist()) & {r.vec_id for r in got if r.query_id == q})
        assert hits >= 0.9 * 480 * 5
    assert met == [1, 2, 6] and len(set(ratios)) == 1


def test_index_prunes(monkeypatch):
    """Recall and cosines worked out, with a real number of lists: on clusters under a tenth of all, on isotropic vectors about half."""
    rng = np.random.default_rng(7)
    n, dims = 16_000, 32
    centres = rng.normal(size=(150, dims))
    clustered = centres[rng.integers(0, 150, n)] + 0.35 * rng.normal(size=(n, dims))
    for x, most in ((clustered, 0.1), (rng.normal(size=(n, dims)), 0.6)):
        index = ann.Lists(np.arange(n), x)
        assert len(index.graph.centres) == n // ann.LIST and len(np.unique(index.entries)) == n
        asked = np.arange(0, n, 80)
        q, _, ids, work = index.nearest(asked, x[asked], 5)
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        scores = unit[asked] @ unit.T
        scores[np.arange(len(asked)), asked] = -2
        best = np.argpartition(-scores, 5, axis=1)[:, :5]
        found = set(zip(q.tolist(), ids.tolist(), strict=True))
        assert sum((i, int(j)) in found for i, row in enumerate(best) for j in row) >= 0.9 * best.size
        assert work < most * n * len(asked)


# Shared helpers


def test_measured_lookup_is_a_join(spark):
    """A key with most of the rows, and keys that are missing on either side."""
    left = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(3000)], "k bigint, v bigint")
    right = spark.createDataFrame([(i, f"r{i}") for i in range(0, 3000, 2)] + [(1, "r1")], "k bigint, r string")
    want = rows_of(left.join(right, "k").select("k", "v", "r"))
    assert rows_of(measured_lookup(left, right, "k", F.col("v"), 50).select("k", "v", "r")) == want and len(want) > 1500


def test_no_local_folder_on_a_cluster():
    from types import SimpleNamespace as Made

    def session(master, named=None, told=None):
        checkpoint = Made(isDefined=lambda: told is not None, get=lambda: told)
        context = Made(getConf=lambda: Made(get=lambda key, none=None: named), _jsc=Made(sc=lambda: Made(getCheckpointDir=lambda: checkpoint)), master=master, applicationId="test")
        return Made(sparkContext=context, conf=Made(get=lambda key, none=None: None))

    assert shared_dir(session("spark://x", "file:///shared")) == "file:///shared"
    assert shared_dir(session("spark://x", None, "hdfs://told")) == "hdfs://told"
    for master in ("spark://x", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            shared_dir(session(master))
    assert shared_dir(session("local[2]")).startswith("/")
