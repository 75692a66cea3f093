"""The pipeline's decisions on planted cases: copies, a benchmark leak, toxic texts and a secret; clean texts stay."""

import random

import corpus_pipeline


def test_stages(spark, tmp_path):
    rng = random.Random(5)
    vocabulary = [f"w{i}x" for i in range(500)]
    say = lambda n: " ".join(rng.choices(vocabulary, k=n))
    item, base = say(40), say(150)
    rows = [(i, say(60 + i), "en", "s", 0) for i in range(1, 40)]
    rows += [(50, base, "en", "s", 0), (51, base + " more", "en", "s", 0), (52, f"{say(30)} {item} {say(30)}", "en", "s", 0)]
    rows += [(i, f"{say(20)} idiot moron {say(10)} scum", "en", "s", 0) for i in range(60, 70)]
    rows += [(80, f"{say(20)} token = \"{'0a1b2c3d' * 5}\" {say(9)}", "en", "s", 0), (81, None, None, None, None), (82, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], 0, int(60 <= r[0] < 70)) for r in rows if r[0] < 70], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == {*range(1, 40), 50, 80, 81, 82}
    assert all(r.round_trip for r in got.values()) and got[81].n_pieces == 0
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    shown = {r.doc_id: r for r in corpus_pipeline.redact_secrets(spark, docs, str(tmp_path)).collect()}
    assert "0a1b2c3d" not in shown[80].text and shown[80].n_chars == len(shown[80].text) and shown[1].text == dict((r[0], r[1]) for r in rows)[1]


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def written(spark, path, rows, labels=(), items=()):
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return spark.read.parquet(f"{path}/documents.parquet")


def test_empty_tables(spark, tmp_path):
    written(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_null_and_repeated_ids(spark, tmp_path):
    """Rows without an id pass the filters and stay; rows of one id are judged alike; nulls in any column stay nulls."""
    rng = random.Random(1)
    say = lambda n: " ".join(rng.choices([f"w{i}x" for i in range(400)], k=n))
    once, base = say(60), say(90)
    rows = [(None, once, None, None, None), (None, once, "en", "s", 1), (1, base, "en", "s", 1), (1, base, "en", "s", 1), (2, base, "en", "s", 1), (3, None, None, None, None), (4, "x" * 200_000, "en", "s", 200_000)]
    written(spark, tmp_path, rows)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == [(False, 1), (False, 1), (False, 3), (False, 4), (True, 0), (True, 0)]
    assert all(r.round_trip for r in got)


def test_extra_columns(spark, tmp_path):
    """Columns that bear the names of an operator's own don't reach it."""
    docs = written(spark, tmp_path, [(1, "one two three", "en", "s", 13), (2, "password = hunter2hunter2", "en", "s", 25)])
    wide = docs.selectExpr("*", "1 as score", "2 as predicted", "3 as h", "4 as hits", "5 as spans", "6 as component_id", "7 as n")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, wide, str(tmp_path)).columns == docs.columns, name


def test_stages_against_brute_force(spark, tmp_path):
    """What each stage keeps, recomputed by plain means on its own input."""
    from tests.llm.test_operators import brute_components, sellers
    from thawline.llm import decontamination, secret_scan

    rng = random.Random(9)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in ("n", "r", "st")]
    say = lambda n: rng.choices(vocabulary, k=n)
    items = [(i, " ".join(say(14))) for i in range(4)]
    rows = []
    for i in range(60):
        words = say(rng.randrange(5, 80))
        if rows and i % 4 == 0:  # an edited copy
            words = rng.choice(rows)[1].split()
            for _ in range(rng.randrange(0, 4)):
                words[rng.randrange(len(words))] = "edit"
        if i % 7 == 0:
            item = list(items[i % 4][1])
            for _ in range(i % 3):
                item[rng.randrange(len(item))] = "z"
            words = words[:10] + ["".join(item)] + words[10:]
        if i % 9 == 0:
            words += ["scum", "idiot", "moron"]
        if i % 11 == 0:
            words += ["token:", "xK9$vQ2!mZ7#pL4&" + str(i)]
        rows.append((i, " ".join(words), "en", "s", 0))
    docs = written(spark, tmp_path, rows, [(r[0], 0, int("idiot" in r[1])) for r in rows], items)
    stage, sf = dict(corpus_pipeline.STAGES), str(tmp_path)
    texts = {r[0]: r[1] for r in rows}
    kept = lambda name: {r.doc_id: r.text for r in stage[name](spark, docs, sf).collect()}
    insults = {i: len({"scum", "idiot", "moron"} & set(t.split())) for i, t in texts.items()}
    clean = set(kept("toxicity"))
    assert {i for i, n in insults.items() if not n} <= clean and not clean & {i for i, n in insults.items() if n == 3}
    components = brute_components([r[:2] for r in rows], 5, 80)
    assert kept("ngram_jaccard_join") == {i: t for i, t in texts.items() if components[i][1] == i}
    plain = {i: decontamination.normalise(t) for i, t in items}
    leaks = {i for i, t in texts.items() if any(sellers(x, decontamination.normalise(t)) <= int(0.05 * len(x)) for x in plain.values())}
    assert leaks and kept("benchmark_decontamination") == {i: t for i, t in texts.items() if i not in leaks}
    known = secret_scan.known_words()
    marked = {i: secret_scan.redact(t, secret_scan.scan(t, 10.0, known)[1], corpus_pipeline.SECRET_MARK) for i, t in texts.items()}
    assert kept("secret_scans") == marked and marked != texts
    encoded = {r.doc_id: r for r in stage["sentencepiece"](spark, docs, sf).collect()}
    assert set(encoded) == set(texts) and all(r.round_trip and r.n_pieces == len(r.ids) for r in encoded.values())
