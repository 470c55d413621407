"""The pipeline's stages against brute force."""

import numpy as np

import corpus_pipeline

from .test_llm import brute_components


def shingles(text):
    tokens = (text or "").lower().split()
    return {" ".join(tokens[k : k + 5]) for k in range(len(tokens) - 4)} or ({" ".join(tokens)} if tokens else set())


def similar(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def near_copies():
    """Texts of 6 to 300 words with copies of which more and more words are changed."""
    rng = np.random.default_rng(11)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(3000)]
    common = list(rng.choice(words, 12))
    texts = []
    for n in (6, 20, 60, 100, 300):
        for _ in range(4):
            base = common + list(rng.choice(words, n))
            texts.append(" ".join(base))
            for changes in (1, 1, 2, 3, 5, 8, 13):
                copy = list(base)
                for k in rng.choice(len(copy), min(changes, len(copy)), replace=False):
                    copy[k] = rng.choice(words)
                texts.append(" ".join(copy))
    texts += [None, "", " \n", "one", "One", texts[0], texts[3].upper()]
    return [(i * 7 % 1009, t) for i, t in enumerate(texts)]


def test_near_duplicates_reach_the_similarity(spark):
    rows = near_copies()
    df = spark.createDataFrame([*rows, rows[5], (None, rows[0][1])], "doc_id bigint, text string").repartition(3)
    sets = {i: shingles(t) for i, t in rows}
    linked = [(a, b) for a in sets for b in sets if a < b and similar(sets[a], sets[b])]
    assert sum(sets[a] != sets[b] for a, b in linked) > 50
    least = brute_components(linked, sets)
    want = sorted([i for i, _ in rows if least[i] == i] + [rows[5][0]] * (least[rows[5][0]] == rows[5][0]))
    got = corpus_pipeline.drop_near_duplicates(spark, df, "").collect()
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == want
    assert sum(r.doc_id is None for r in got) == 1
    assert corpus_pipeline.drop_near_duplicates(spark, df.where("false"), "").count() == 0


def test_short_lines_repeat_exactly(spark):
    rows = [(1, "Les.\nown\n\nLes.\n\nx"), (2, "Les.\nLet.\nx\na line of 16 char"), (3, "a line of 15 ch\na line of 16 cha\nx"), (4, "\n")]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id bigint, text string, n_chars int")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.drop_lines(spark, df, "").collect()}
    want = {1: "Les.\nown\n\n\nx", 2: "Let.\na line of 16 char", 3: "a line of 15 ch", 4: "\n"}
    assert got == {i: (t, len(t)) for i, t in want.items()}


def test_mixture_meets_the_targets(spark):
    rows = [(i, " ".join(["word"] * 5), "en", "b" if i % 10 == 0 else "a") for i in range(6000)]
    df = spark.createDataFrame([*rows, (None, None, "en", None)], "doc_id bigint, text string, lang string, source string")
    kept = corpus_pipeline.sample_mixture(spark, df, "")
    assert kept.columns == df.columns
    tokens = {"a": 0, "b": 0, None: 0}
    for r in kept.collect():
        assert r.source != "b" or r.doc_id % 10 == 0
        tokens[r.source] += 5
    powers = {"a": 0.9**0.9, "b": 0.1**0.9}
    for k, power in powers.items():
        assert abs(tokens[k] / 30_000 - power / sum(powers.values())) < 0.006
    assert corpus_pipeline.sample_mixture(spark, df.where("false"), "").count() == 0


CLASHES = ["score", "predicted", "n_lines", "copies", "rate", "component_id", "token_ids"]


def test_stages_keep_columns_of_clashing_names(spark, tmp_path):
    """Each stage's rows, with nulls, empties, repeats and columns that have the names of the operators' own."""
    rng = np.random.default_rng(21)
    words = ["".join(rng.choice(list("aeiorst"), 6)) for _ in range(300)]
    texts = [" ".join(rng.choice(words, 40)) + ("\nvile vile wretch" if i % 5 == 0 else "\nlast") for i in range(200)] + [None, "", "  "]
    rows = [(i, t, "en", "a", len(t or ""), *CLASHES) for i, t in enumerate(texts)] + [(3, texts[3], "en", "a", len(texts[3]), *CLASHES), (None, texts[4], None, None, None, *CLASHES)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} string" for c in CLASHES))
    spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(0, 150)] + [(None, 1), (2, None)], "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    kept = corpus_pipeline.drop_toxic(spark, df, str(tmp_path))
    assert kept.columns == df.columns
    got = kept.collect()
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == sorted([i for i in range(203) if i % 5 or i >= 200] + [3])
    assert {tuple(r)[5:] for r in got} == {tuple(CLASHES)}
    for stage in (corpus_pipeline.drop_lines, corpus_pipeline.drop_near_duplicates, corpus_pipeline.sample_mixture):
        out = stage(spark, kept, str(tmp_path))
        assert out.columns == df.columns and {tuple(r)[5:] for r in out.collect()} == {tuple(CLASHES)}
        assert stage(spark, kept.where("false"), str(tmp_path)).count() == 0
    ids = corpus_pipeline.encode(spark, kept, str(tmp_path))
    assert ids.count() == kept.count() and {len(r.token_ids) for r in ids.where("doc_id = 201").collect()} <= {0}
    assert corpus_pipeline.encode(spark, kept.where("false"), str(tmp_path)).count() == 0


def test_run_goes_through_all_stages(spark, tmp_path):
    rng = np.random.default_rng(22)
    words = ["".join(rng.choice(list("aeiorst"), 6)) for _ in range(500)]
    texts = [" ".join(rng.choice(words, 60)) for _ in range(120)]
    texts += [texts[k] + " more" for k in range(20)]
    spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0) for i in range(50)], "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    ids = [r.doc_id for r in got.collect()]
    # Nothing is toxic, no line repeats, twenty near copies go, and with one cell the mixture keeps all.
    assert sorted(ids) == list(range(120))
