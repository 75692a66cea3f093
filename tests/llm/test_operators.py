"""Each operator against a brute-force version on a small fixture with nulls, empty and long texts, ties, repeats."""

import bisect
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from thawline.llm import ann, decontamination, hilbert_shards, jaccard_join, language_id, license_scan, secret_scan, sentencepiece_codec, substring_dedup, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long"


def frame(spark, rows):
    """Rows of (doc_id, text); a column named as an operator's own stands beside them."""
    return spark.createDataFrame([(i, t, ("en", "de")[(i or 0) % 2] if (i or 0) % 7 else None, "s", None if t is None else len(t), 1) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(300)]
    say = lambda n: " ".join(rng.choices(vocabulary, k=n))
    base, passage = say(120), say(55)
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "one two"), (6, "for " * 400), (7, base), (8, base), (9, base.replace(" ", "\n", 3))]
    for i in range(10, 22):
        words = base.split()
        words[rng.randrange(120)] = "edit"
        if i % 3 == 0:
            words[rng.randrange(120)] = "other"
        rows.append((i, " ".join(words)))
    rows += [(i, f"{say(30)} {passage} {say(40)}") for i in range(30, 38)] + [(i, say(rng.randrange(1, 200))) for i in range(40, 60)]
    rows += [(70, say(9)), (70, say(9)), (71, "é" * 5000), (None, base)]
    return rows


def test_substring_dedup(spark, texts):
    got = {(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.dedup_substrings(frame(spark, texts), 50).collect()}
    seen, want = {}, set()
    for i, t in texts:
        w = (t or "").encode().split()
        for p in range(len(w) - 49):
            k = tuple(w[p : p + 50])
            if i is not None:
                seen[k] = min(seen.get(k, i), i)
    for i, t in texts:
        w = (t or "").encode().split()
        gone = set()
        for p in range(len(w) - 49):
            if i is not None and seen[tuple(w[p : p + 50])] < i:
                gone |= set(range(p, p + 50))
        want.add((i, len(w), len(gone), hashlib.sha256(b" ".join(x for p, x in enumerate(w) if p not in gone)).hexdigest()))
    assert got == want


@pytest.mark.parametrize("n,num,tile", [(4, 85, 1024), (5, 80, 4), (2, 60, 3)])
def test_jaccard(spark, texts, n, num, tile):
    rows = [(i, t) for i, t in texts if i != 70]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(frame(spark, rows), n, num, 100, tile).collect()}
    sets = {}
    for i, t in rows:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode().split()
        sets[i] = {tuple(w[p : p + n]) for p in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = [i for i in sets if i is not None]
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert got == {i: (len(sets[i]), find(i) if i is not None else None) for i in sets}


def test_secrets(spark):
    key = "a" * 7 + "B9"
    rows = [(1, None), (2, ""), (3, f"Password = '{key}' and token:short"), (4, "AKIA" + "A" * 12 + " AKIAshort"), (5, "é" + "0f" * 16 + "G"), (6, "pwd: xK9$vQ2!mZ7#pL4&"), (7, "password: password1"), (8, "passworK = abcdefgh1")]
    got = {r.doc_id: r for r in secret_scan.scan_secrets(frame(spark, rows), ["doc_id", "h"], mark="[X]").collect()}
    assert got[1].spans == got[2].spans == "" and got[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[3].spans == f"assign:0:{len('Password = ') + 1 + len(key)}" and got[3].n_assign == 1 and key not in got[3].redacted
    assert got[4].spans == "access:0:16" and got[5].spans == "hex:1:33"
    assert got[6].spans == "guess:5:21" and got[6].redacted == "pwd: [X]" and got[6].n_assign == 0
    assert got[7].n_assign == 1 and got[8].n_assign == 0
    cost = lambda value: secret_scan.guess_cost(value, KNOWN)
    assert cost("password1") < 4 < 10 < cost("xK9$vQ2!mZ7#pL4&")
    assert cost("qwertyuiop") < 4 and cost("19991231") < 6 and cost("aaaaaaaaaa") < 4


KNOWN = secret_scan.known_words()


@pytest.mark.parametrize("prose", ["password is incorrect", "The secret is forgiveness", "credentials: https://example.org/docs", "token: required parameter", "the secret is pronunciationally", "password: /etc/company/private.key", "pass: sunshine-monkey"])
def test_prose_is_no_secret(prose):
    assert secret_scan.scan(prose, 10.0, KNOWN) == ([], []) or all(k == "assign" for _, _, k, _ in secret_scan.scan(prose, 10.0, KNOWN)[1])


def test_address_with_a_password():
    text = "credentials: https://bob:xK9vQ2mZ7pL4@example.org/docs"
    assert [k for _, _, k, _ in secret_scan.scan(text, 10.0, KNOWN)[1]] == ["guess"]


def all_segmentations(value, words):
    """Cheapest segmentation with every segment of every kind tried at every place."""
    import math

    low, seg = value.lower(), secret_scan.SEGMENT_COST
    plain = low.translate(secret_scan.LEET)
    cost = lambda i, j: sum(map(secret_scan._char_cost, value[i:j]))

    def segments(i, j):
        part, n = low[i:j], j - i
        yield cost(i, j)
        if n >= 3 and len(set(part)) == 1:
            yield secret_scan._char_cost(value[j - 1]) + math.log10(n)
        if n >= 3 and all(part[k : k + 2] in secret_scan.NEAR_PAIRS for k in range(n - 1)):
            yield math.log10(47 * n)
        if n >= 2 and (rank := words.ranks.get(part) or words.ranks.get(plain[i:j])):
            yield math.log10(rank + 1) + (part not in words.ranks or value[i:j] != part) * math.log10(4)
        if secret_scan.DATE.fullmatch(part) and n in (4, 6, 8, 10):
            yield math.log10(200 if n == 4 else 73000)
        for size in range(2, min(secret_scan.BLOCK, n // 2) + 1):
            if n % size == 0 and part == part[:size] * (n // size):
                yield cost(j - size, j) + math.log10(n // size)

    best = [0.0]
    for j in range(1, len(value) + 1):
        best.append(min(best[i] + seg + min(segments(i, j)) for i in range(j)))
    return best[-1]


@pytest.mark.parametrize("alphabet", ["ab", "abc", "qwe1", "aq19-", "passwordA0", "0129/"])
def test_guess_cost_is_the_least(alphabet):
    """Against all segmentations, with runs longer than any word: the starts that are left out never win."""
    rng = random.Random(alphabet)
    words = secret_scan.Words({"ab": 3, "aaa": 2, "qwe": 5, "pass": 1, "word": 4, "abcab": 7}, 5)
    for _ in range(40):
        value = "".join(rng.choice(alphabet) * rng.choice([1, 1, 1, 2, 3, 9, 30]) for _ in range(rng.randrange(1, 9)))
        value += "".join(rng.choice(["abcdefghijkl", "qwertyuiop", "ab" * 13, "19991231", ""]) for _ in range(2))
        assert abs(secret_scan.guess_cost(value, words) - all_segmentations(value, words)) < 1e-9, value


@pytest.mark.parametrize("lead", ['{"pass": "', "db_pass = ", "pass => ", "pass is ", "pass_prod: ", "PASS := ", "passphrase: ", "passwd_x: ", "my pwd is: "])
def test_secrets_after_any_context(lead):
    """No other credential word stands in the text: the words that let a text in are no narrower than the pattern."""
    value = "xK9$vQ2!mZ7#pL4&"
    text = f"so {lead}{value}"
    assert secret_scan.CONTEXT.search(text)
    _, spans = secret_scan.scan(text, 10.0, KNOWN)
    assert value not in secret_scan.redact(text, spans, "[X]")


def test_guess_cost_of_long_runs():
    """Long repeats, blocks and walks stay one cheap segment, in time that grows with the length."""
    for run in ("a" * 20_000, "ab" * 10_000, "abcdefghijklmnopqrstuvwxyz"):
        assert secret_scan.guess_cost(run, KNOWN) < 8
        assert secret_scan.guess_cost("monkey" + run, KNOWN) < 11
    spans = secret_scan.scan("password='abcdefgh1' " * 2000, 10.0, KNOWN)[0]
    assert len(spans) == 2000 and all(k == "assign" for _, _, k, _ in spans)


def cosine_top(rows, k):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for q, x in ok:
        if q % 50 == 0:
            near = sorted(((-(x * y).sum() / (np.sqrt((x * x).sum()) * np.sqrt((y * y).sum())), i) for i, y in ok if i != q and len(y) == len(x)))
            out[q] = [i for _, i in near[:k]]
    return out


@pytest.mark.parametrize("n,hot", [(4, 0), (600, 0), (600, 200)])
def test_nearest(spark, n, hot):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in (rng.normal(size=16) if i >= hot or i % 50 == 0 else np.ones(16))]) for i in range(n)]
    rows += [(1000, None), (1050, [0.0] * 16), (1100, [float("nan")] + [1.0] * 15), (1150, [None] + [1.0] * 15), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(df, "vec_id % 50 = 0", k=5, block=64).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = cosine_top(rows, 5)
    assert got.keys() == want.keys() and all(len(got[q]) == len(want[q]) for q in want)
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.9 * sum(map(len, want.values()))


@pytest.mark.parametrize("block", [4096, 8])
def test_nearest_repeated_ids(spark, block):
    """Copies of one id, more than k of them and nearest to all queries, take one place."""
    rng = np.random.default_rng(2)
    center = np.ones(16)
    near = lambda s: [float(x) for x in center + s * rng.normal(size=16)]
    rows = [(i, near(0.2)) for i in range(60)] + [(777, near(0.001)) for _ in range(40)] + [(778, [1.0] * 16)] * 9
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(df, "vec_id % 50 = 0", k=5, block=block, hashes=1, probes=8).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    best = {}
    for i, v in rows:
        for q in (0, 50):
            x, y = np.array(rows[q][1]), np.array(v)
            best[q, i] = max(best.get((q, i), -2), x @ y / np.sqrt((x @ x) * (y @ y)))
    want = {q: sorted((i for p, i in best if p == q and i != q), key=lambda i: (-best[q, i], i))[:5] for q in (0, 50)}
    assert got == want


def test_language(spark):
    words = {"en": "the cat and this house with that".split(), "de": "der hund und dieses haus mit jenem".split()}
    rng = random.Random(0)
    rows = [(i, " ".join(rng.choices(words[("en", "de")[i % 2]], k=30))) for i in range(1, 60)] + [(61, None), (63, "123 !!"), (65, "unddieses"), (66, ""), (67, "½"), (69, "dieses²")]
    df = frame(spark, rows)
    got = {r.doc_id: r for r in language_id.predict(df, language_id.learn(df), ["doc_id"]).collect()}
    assert all(got[i].lang_pred == ("en", "de")[i % 2] and 0 <= got[i].score <= 1 for i in range(1, 60))
    assert got[61].lang_pred == got[63].lang_pred == got[66].lang_pred == got[67].lang_pred == "und" and got[65].lang_pred == got[69].lang_pred == "de"
    empty = language_id.predict(df, language_id.learn(df.where("false")), ["doc_id"])
    assert {r.lang_pred for r in empty.collect()} == {"und"}
    assert language_id.predict(df.where("false"), language_id.learn(df.where("false")), ["doc_id"]).count() == 0
    more = frame(spark, [(1, "the " * 100_000), (1, "the cat"), (None, "der hund")])
    found = language_id.predict(more, language_id.learn(df), ["doc_id", "h"]).collect()
    assert sorted((r.doc_id or 0, r.lang_pred) for r in found) == [(0, "de"), (1, "en"), (1, "en")]


def test_language_against_brute_force(spark):
    """Scores of every text recomputed from plain counts of the whole sample, with many languages."""
    import math
    from collections import Counter

    rng = random.Random(7)
    names = [f"l{i}" for i in range(130)]  # every language stays
    rows = []
    for i in range(390):
        syllables = [f"{a}{chr(97 + i % 26)}" for a in "bdfgk"] + ["ta", "no"]
        rows.append((i, " ".join("".join(rng.choices(syllables, k=rng.randrange(1, 4))) for _ in range(rng.randrange(0, 12))), names[i % 130]))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language_id.predict(df, language_id.learn(df, per_language=1000), ["doc_id"]).collect()}
    counts = {(lang, size): Counter() for lang in names for size in range(language_id.LONGEST + 1)}
    for _, text, lang in rows:
        for w in language_id.WORD.findall(text):
            counts[lang, 0][w] += 1
            for size in range(1, language_id.LONGEST + 1):
                counts[lang, size].update(language_id.grams(w, size))
    counts = {k: {t: n for t, n in c.items() if n >= 2} for k, c in counts.items()}
    total = {k: sum(c.values()) for k, c in counts.items()}
    penalty = 0.5 + max(math.log10(n) for n in total.values() if n)
    cost = lambda lang, size, t: math.log10(total[lang, size] / counts[lang, size][t]) if t in counts[lang, size] else penalty
    taught = sorted(lang for lang in names if any(r[2] == lang for r in rows))
    for i, text, _ in rows:
        words, want = language_id.WORD.findall(text), []
        for lang in taught:
            whole = 0.0
            for w in words:
                sizes = [0] if any(w in counts[x, 0] for x in taught) else [s for s in range(min(language_id.LONGEST, len(w) + 2), 0, -1) if any(g in counts[x, s] for x in taught for g in language_id.grams(w, s))][:1]
                if not sizes:
                    whole += penalty
                elif sizes == [0]:
                    whole += cost(lang, 0, w)
                else:
                    hits = [g for g in language_id.grams(w, sizes[0]) if any(g in counts[x, sizes[0]] for x in taught)]
                    whole += sum(cost(lang, sizes[0], g) for g in hits) / len(hits)
            want.append((whole / max(len(words), 1), lang))
        least = min(c for c, _ in want)
        assert got[i] in ([lang for c, lang in want if c <= least + 1e-9] if words else ["und"])


def test_toxicity(spark):
    rng = random.Random(0)
    clean = [f"word{i}" for i in range(80)]
    rows, labels = [(900, None), (901, "")], []
    for i in range(1, 300):
        bad = i % 4 == 0
        words = rng.choices(clean, k=40) + (rng.choices(["idiot", "scum,", "MORON"], k=2) if bad else [])
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad) if i % 40 else 1 - int(bad)))
    df, lab = frame(spark, rows), spark.createDataFrame(labels + [(5000, None), (None, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_texts(df, toxicity.fit(df, lab), ["doc_id"]).collect()}
    assert all(got[i].predicted == int(i % 4 == 0) for i in range(1, 300)) and got[900].score == got[901].score and got[900].predicted == 0
    alone = toxicity.score_texts(df, toxicity.fit(df, lab.where("false")), ["doc_id"]).where("doc_id < 300").collect()
    assert all(r.predicted == int(r.doc_id % 4 == 0) for r in alone)


@pytest.mark.parametrize("voters,hit,false,wrong", [(30, 0.25, 0.01, 0.03), (12, 0.5, 0.02, 0.05), (40, 0.1, 0.002, 0.03)])
def test_label_model(voters, hit, false, wrong):
    """On rows drawn from known rates the posterior errs less often than the given labels, and not far from the one that knows the rates."""
    rng = np.random.default_rng(voters)
    truth = rng.random(2000) < 0.3
    votes = (rng.random((2000, voters)) < np.where(truth, hit, false)[:, None]).astype(np.uint8)
    given = np.where(rng.random(2000) < wrong, ~truth, truth).astype(int)
    posterior = toxicity.label_model(votes, given)
    errors = ((posterior >= 0.5) != truth).sum()
    n = votes.sum(axis=1)
    known = np.log(0.3 / 0.7) + n * np.log(hit / false) + (voters - n) * np.log((1 - hit) / (1 - false)) + np.where(given, 1, -1) * np.log((1 - wrong) / wrong)
    best = ((known >= 0) != truth).sum()
    assert errors < 0.6 * (given != truth).sum() and errors <= best + 25


def test_toxicity_edges(spark):
    """Empty tables, rows of one doc_id, very long texts, columns of clashing names."""
    none = frame(spark, [])
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0)], "doc_id long, toxic int")
    assert toxicity.score_texts(none, toxicity.fit(none, labels), ["doc_id"]).count() == 0
    df = frame(spark, [(1, "idiot " * 30_000), (1, "idiot moron scum"), (2, "plain words"), (None, "plain words")])
    got = toxicity.score_texts(df, toxicity.fit(df, labels.where("false")), ["doc_id", "h"]).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    with pytest.raises(ValueError):
        toxicity.score_texts(df.withColumn("score", df.h), toxicity.fit(df, labels.where("false")), ["score"])


def test_toxicity_learns_beginnings(spark):
    """A language that the lexicon doesn't know: words of one stem mark the toxic texts; copies of one text teach nothing."""
    rng = random.Random(4)
    clean = ["".join(rng.choices("aeioulmnrt", k=7)) for _ in range(200)]
    rows, labels = [], []
    for i in range(1, 400):
        words = rng.choices(clean, k=40)
        if i % 5 == 0:
            words += ["zork" + rng.choice(clean)[:3] for _ in range(2)]
        rows.append((i, " ".join(words)))
    rows += [(i, "copied quuxword again " + rows[0][1]) for i in range(500, 530)]
    labels = [(i, int(i % 5 == 0 or i >= 500)) for i, _ in rows if i % 3]
    df, lab = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(df, lab)
    found = set(model.learned.tolist())
    of = lambda word: set(toxicity.beginnings(toxicity.Letters(pa.array([word])))[0].tolist())
    assert found & of("zork") and not found & of("quuxword")
    got = {r.doc_id: r.predicted for r in toxicity.score_texts(df, model, ["doc_id"]).where("doc_id < 400").collect()}
    assert all(got[i] == int(i % 5 == 0) for i in got)


def test_shards(spark, texts):
    got = hilbert_shards.shard_rows(frame(spark, texts), 16).collect()
    assert len(got) == len(texts) and {r.law for r in got} == {"rows"}
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.size >= 1 and r.grown_shard is None
    assert set(by) <= set(range(16)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert hilbert_shards.shard_rows(frame(spark, [])).count() == 0


def test_shards_against_one_sort(spark, texts):
    """Places recomputed from one sorted list: the curve's index, then doc_id, checksum, size; nulls first."""
    import zlib

    from pyspark.sql import functions as F

    rng = random.Random(3)
    rows = [(i, t, rng.choice(["en", "de", None, "zh-Hant"]), rng.choice(["src1", "src12", "", None])) for i, t in texts]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5)
    number = lambda s: None if s is None else int.from_bytes(s.encode()[:6].ljust(6, b"\0"), "big")
    ends = {}
    for name, of in (("l", lambda r: number(r[2])), ("s", lambda r: number(r[3])), ("d", lambda r: r[0])):
        some = [of(r) for r in rows if of(r) is not None]
        step = max(1, (max(some) - min(some) + 4096) // 4096)
        ends[name] = (min(some), step, sorted((x - min(some)) // step for x in some))
    cell = lambda name, x: 0 if x is None else bisect.bisect_left(ends[name][2], (x - ends[name][0]) // ends[name][1]) * 256 // len(ends[name][2])
    keyed = []
    for i, t, lang, source in rows:
        size = len((t or "").encode()) + 1
        power = size.bit_length() - 1
        keyed.append((min(255, power * 8 + ((size * 8 >> power) & 7)), cell("l", number(lang)), cell("s", number(source)), cell("d", i), i, size, zlib.crc32((t or "").encode())))
    cells = spark.createDataFrame([(*k[:4], n) for n, k in enumerate(keyed)], "a long, b long, c long, d long, n int")
    index = {r.n: r.h for r in cells.select("n", hilbert_shards.hilbert_index([F.col(x) for x in "abcd"], 8).alias("h")).collect()}
    order = sorted(range(len(keyed)), key=lambda n: (index[n], keyed[n][4] is not None, keyed[n][4] or 0, keyed[n][6], keyed[n][5]))
    total = len(order)
    want = []
    for p, n in enumerate(order):
        shard = p * 16 // total
        want.append((keyed[n][4], keyed[n][5], keyed[n][6], "rows", shard, p - -(-shard * total // 16), None))
    got = [tuple(r) for r in hilbert_shards.shard_rows(df, 16).collect()]
    key = lambda r: (r[4], r[5])
    assert sorted(got, key=key) == sorted(want, key=key)


def test_written_shards(spark, texts, tmp_path):
    """Repeated rows and null ids are written once each, columns with clashing names stay."""
    df = frame(spark, [*texts, (None, "again"), (70, "again")]).withColumn("shard", F_lit(5)).withColumn("slot", F_lit("x"))
    hilbert_shards.write_shards(df, f"{tmp_path}/out", 4)
    back = spark.read.parquet(f"{tmp_path}/out")
    plain = lambda d: sorted(map(repr, d.select("doc_id", "text", "lang", "source", "n_chars", "h", "shard", "slot").collect()))
    assert plain(back) == plain(df) and {r.shard_folder for r in back.select("shard_folder").distinct().collect()} == {0, 1, 2, 3}


def F_lit(x):
    from pyspark.sql import functions as F

    return F.lit(x)


def test_shards_prune(spark):
    """Ranges of a dimension open fewer shards than an arbitrary order, which opens all of them."""
    rng = random.Random(4)
    rows = [(i, "x" * rng.choice([10, 100, 1000, 4000]), rng.choice(["de", "en", "fr", "zh"]), f"src{rng.randrange(20)}") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    placed = hilbert_shards.shard_rows(df, 64, keep=["doc_id", "lang", "source"])
    for condition in ("lo_lang <= 'fr' and hi_lang >= 'fr'", "lo_doc_id <= 1000", "lo_source <= 'src5' and hi_source >= 'src5'"):
        r = hilbert_shards.pruned(placed, condition, ["doc_id", "lang", "source"]).first()
        assert r.shards == 64 and r.opened <= 40, (condition, r.opened)


@pytest.mark.parametrize("dims,bits", [(2, 3), (3, 2), (4, 2)])
def test_hilbert(spark, dims, bits):
    from pyspark.sql import functions as F

    cells = [F.expr(f"(id >> {i * bits}) & {(1 << bits) - 1}") for i in range(dims)]
    rows = spark.range(1 << dims * bits).select(*(c.alias(f"c{i}") for i, c in enumerate(cells)), hilbert_shards.hilbert_index(cells, bits).alias("h")).orderBy("h").collect()
    assert [r.h for r in rows] == list(range(1 << dims * bits))
    assert all(sum(abs(a[i] - b[i]) for i in range(dims)) == 1 for a, b in zip(rows, rows[1:]))


def sellers(pattern, text):
    column = list(range(len(pattern) + 1))
    best = column[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(pattern):
            new.append(min(column[i] + (p != c), column[i + 1] + 1, new[i] + 1))
        column, best = new, min(best, new[-1])
    return best


def test_decontamination(spark):
    rng = random.Random(3)
    letters = "abcdefgh "
    items = [(i, "".join(rng.choices(letters, k=60)).strip()) for i in range(6)] + [(90, None), (91, "..."), (92, "short")]
    rows = [(1, None), (2, ""), (3, "a short one"), (4, "shorter")]
    for i in range(10, 40):
        item = list(items[i % 6][1])
        for _ in range(i % 7):
            item[rng.randrange(len(item))] = rng.choice("abcdefghz")
        rows.append((i, "".join(rng.choices(letters, k=80)) + " " + "".join(item).upper() + " " + "".join(rng.choices(letters, k=50))))
    found = decontamination.find_items(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"), ["doc_id"], rate=0.08, block_chars=150).collect()
    got = {(r.doc_id, h.item_id): h.distance for r in found for h in r.hits}
    want = {(3, 92): 0}
    for d, t in rows:
        for i, x in items[:6]:
            x, budget = decontamination.normalise(x), int(0.08 * len(decontamination.normalise(x)))
            distance = sellers(x, decontamination.normalise(t or ""))
            if distance <= budget:
                want[d, i] = distance
    assert got == want and len(want) > 10


def test_sentencepiece(spark, texts):
    rows = [*texts, (80, "Grüße ▁ \U0001f600  two  spaces\n\ttab"), (81, " lead"), (82, "\0 nul")]
    encoded = sentencepiece_codec.encode_texts(frame(spark, rows), ["doc_id"])
    assert all(r.round_trip and r.n_pieces == len(r.ids) for r in encoded.collect())
    back = {r.doc_id: r.text for r in sentencepiece_codec.decode_ids(encoded.where("doc_id >= 80"), ["doc_id"]).collect()}
    assert back == {i: t for i, t in rows if i and i >= 80}
    assert encoded.where("doc_id in (1, 2)").selectExpr("sum(n_pieces)").first()[0] == 0


def test_viterbi():
    pieces = {b" a": -1.0, b"a": -2.0, b"b": -2.5, b"ab": -2.2, b" ab": -4.0, b"ba": -2.1, b" ": -3.0, "é".encode(): -1.5, b"aba": -3.9}
    names = [bytes([i]) for i in range(256)] + list(pieces)
    v = sentencepiece_codec.build({p: (256 + k, s) for k, (p, s) in enumerate(pieces.items())}, np.arange(256, dtype=np.int32), names)

    def best(raw):
        if not raw:
            return 0.0
        width = 1 + (raw[0] >= 0xC0) + (raw[0] >= 0xE0)
        options = [s + best(raw[len(p) :]) for p, s in pieces.items() if raw.startswith(p)]
        if raw[:width] not in pieces:
            options.append(min(pieces.values()) - 10 + best(raw[width:]))
        return max(options)

    rng = random.Random(0)
    segments = ["".join(rng.choices(["a", "b", " ", "é", "z", "中"], k=rng.randrange(1, 12))).encode() for _ in range(200)]
    ids, scores = sentencepiece_codec.viterbi(v, segments)
    for s, i, x in zip(segments, ids, scores):
        assert b"".join(names[j] for j in i) == s and abs(x - best(s)) < 1e-9


def test_licenses(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    rows = [(1, None), (2, ""), (3, "Hello. Licensed under the Apache License, Version 2.0.\nBye"), (4, mit), (5, "x\n" * 500 + "Licensed under CC BY-NC 4.0."), (6, "All rights reserved. Released under the MIT License."), (7, "See the GNU General Public License for more details.")]
    got = {r.doc_id: r for r in license_scan.scan_licenses(frame(spark, rows), ["doc_id"]).collect()}
    assert [got[i].licenses for i in range(1, 8)] == [[], [], ["Apache-2.0"], ["MIT"], ["CC-BY-NC-4.0"], ["Proprietary", "MIT"], []]
    assert got[4].sentences == ["MIT_GRANT", "MIT_NOTICE"] and got[7].unmatched == ["GPL_SEE"]


GPL_HEADER = """This program is free software{0} you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation{1} either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program{2}"""
APACHE_HEADER = """Copyright 2020 Some Owner, Inc.

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
BSD_TEXT = """Copyright (c) 2020, Some Owner
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2) Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of Some Owner, Inc. nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""
MIT_TEXT = """MIT License

Copyright (c) 2020 Some Owner

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""


@pytest.mark.parametrize("before,mark,after", [("", "", ""), ("", "# ", ""), ("/*\n", " * ", "\n */"), ("", "// ", "\r"), ("", "REM ", "")])
def test_wrapped_licenses(before, mark, after):
    """Standard texts, wrapped and in comments, match their longest rule."""
    rules = license_scan.Rules()

    def said(text):
        known = rules.identify("import os\n" + before + "\n".join(mark + line for line in text.split("\n")) + after + "\ncode = 1\n")
        found, rest = rules.match(known)
        return [n for _, n in known], [x for _, x in found], rest

    gpl = ["GPL_FREE", "GPL_HOPE", "GPL_SEE", "GPL_COPY"]
    for signs in ((":", ",", ".  If not, see <https://www.gnu.org/licenses/>."), (";", ";", "; if not, write to the Free Software\nFoundation, Inc., 59 Temple Place")):
        assert said(GPL_HEADER.format(*signs)) == (gpl, ["GPL-or-later"], [])
    assert said(APACHE_HEADER) == (["APACHE2_REF", "APACHE2_COMPLY", "APACHE2_COPY", "APACHE2_BASIS", "APACHE2_SEE"], ["Apache-2.0"], [])
    assert said(BSD_TEXT) == (["ALL_RIGHTS", "BSD_REDIST", "BSD_SOURCE", "BSD_BINARY", "BSD_ENDORSE"], ["Proprietary", "BSD-3-Clause"], [])
    assert said(MIT_TEXT) == (["MIT_REF", "MIT_GRANT", "MIT_NOTICE", "AS_IS_SOFTWARE", "AUTHORS_NOT_LIABLE"], ["MIT", "MIT"], [])
    assert said("Copyright 2020 A\nLicensed under the MIT License\nAll rights reserved")[0] == ["MIT_REF", "ALL_RIGHTS"]
    assert said("This Source Code Form is subject to the terms of the\nMozilla Public License, v. 2.0.")[1] == ["MPL-2.0"]


@pytest.mark.parametrize("text,want", [("// SPDX-License-Identifier: GPL-3.0-or-later\nint x;", ["GPL-3.0-or-later"]), ("# spdx-license-identifier: 0BSD", ["0BSD"]), ("This work is licensed under CC BY-NC-SA 4.0.", ["CC-BY-NC-SA-4.0"]), ("Released under the Eclipse Public License v2.0.\nSo be it.", ["EPL-2.0"]), ("Dual. Licensed under the MIT License.\nLicensed under the Boost Software License, Version 1.0.", ["MIT", "BSL-1.0"]), ("We licensed a song under pressure.", [])])
def test_named_licenses(text, want):
    rules = license_scan.Rules()
    assert [x for _, x in rules.match(rules.identify(text))[0]] == want


def test_own_rules_are_not_gated():
    """Sentences that a caller brings need none of the words of the known ones."""
    rules = license_scan.Rules({"HELLO": ["hello dear world"], "BYE": ["so long {x} friend"]}, [("greeting", ("HELLO", "BYE"))])
    assert [x for _, x in rules.match(rules.identify("Hello, dear\nworld! So long, my old friend."))[0]] == ["greeting"]
    assert all(rules.signs.search(s) for s in ("hello dear world", "so long my friend"))


def whole_sentences(text, rules):
    """Brute force for texts of whole sentences: each maximal run of words between full stops is compared with each known sentence."""
    out = []
    for number, sentence in enumerate(x for x in re.split(r"[.!?]+(?:\s+|$)", text) if license_scan.fold(x)):
        if name := rules.exact.get(license_scan.fold(sentence)):
            out.append((number, name))
    return out


def test_sentences_against_brute_force():
    rules, rng = license_scan.Rules(), random.Random(1)
    known = [s for s in rules.exact if not re.search(r"\bv \d|\d", s)]
    for _ in range(60):
        said = [rng.choice([rng.choice(known), "other words stand here", "the license is not named", "copyright of nobody"]) for _ in range(rng.randrange(1, 9))]
        text = " ".join(s.capitalize() + "." for s in said)
        assert rules.identify(text) == whole_sentences(text, rules)


def test_empty_tables(spark):
    none = frame(spark, [])
    assert substring_dedup.dedup_substrings(none).count() == 0
    assert jaccard_join.jaccard_components(none).count() == 0
    assert secret_scan.scan_secrets(none, ["doc_id"]).count() == 0
    assert decontamination.find_items(none, spark.createDataFrame([], "item_id long, text string"), ["doc_id"]).count() == 0
    assert sentencepiece_codec.encode_texts(none, ["doc_id"]).count() == 0
    assert license_scan.scan_licenses(none, ["doc_id"]).count() == 0
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), "vec_id % 50 = 0").count() == 0
    assert hilbert_shards.shard_rows(none).count() == 0


def brute_components(rows, n, num):
    sets, root = {}, {}
    for i, t in rows:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode().split()
        sets[i] = {tuple(w[p : p + n]) for p in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
        root[i] = i

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(i for i in sets if i is not None)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i) if i is not None else None) for i in sets}


@pytest.mark.parametrize("tile", [1024, 5])
def test_jaccard_hot_groups(spark, tile):
    """A class copied over all partitions, a passage in most sets, a template that fills over 70 % of each of many sets, and
    chains of near copies whose ends don't link."""
    rng = random.Random(11)
    vocabulary = [f"v{i}" for i in range(4000)]
    say = lambda k: rng.choices(vocabulary, k=k)
    template, passage, copied = say(80), say(20), " ".join(say(70))
    rows = [(i, copied) for i in range(60)] + [(100 + i, " ".join(passage + say(60))) for i in range(60)]
    rows += [(200 + i, " ".join(template + say(rng.randrange(4, 30)))) for i in range(60)]
    for c in range(3):
        words = say(100)
        for i in range(12):
            words = words[: 8 * i] + say(8) + words[8 * i + 8 :]
            rows.append((300 + 20 * c + i, " ".join(words)))
    rng.shuffle(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(frame(spark, rows).repartition(7), 5, 80, 100, tile).collect()}
    want = brute_components(rows, 5, 80)
    assert got == want and len({c for _, c in want.values()}) < 150


def thue_morse(k, a, b):
    out = [0]
    while len(out) < k:
        out += [1 - x for x in out]
    return [(a, b)[x] for x in out[:k]]


def test_hash_traps(spark):
    """Words that differ by a NUL and a letter, and sequences on which polynomial hashes modulo 2**64 agree."""
    x, y = thue_morse(2048, "a", "b"), thue_morse(2048, "b", "a")
    rng = random.Random(2)
    tail = [f"t{i}" for i in range(60)]
    nul = [rng.choice(["cat", "bat\0", "bat", "cat\0"]) for _ in range(61)]
    twin = [{"cat": "bat\0", "bat\0": "cat", "bat": "cat\0", "cat\0": "bat"}[w] for w in nul]
    words = ["".join(x), "".join(y)]
    rows = [(1, " ".join(nul)), (2, " ".join(twin)), (3, " ".join(x[:1024])), (4, " ".join(y[:1024])), (5, " ".join([words[0], *tail])), (6, " ".join([words[1], *tail]))]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.dedup_substrings(frame(spark, rows), 50).collect()}
    assert got == {i: want[:2] for i, want in brute_removals(rows, 50).items()}
    for n in (1, 4):
        linked = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(frame(spark, rows), n, 85, 100).collect()}
        assert linked == brute_components(rows, n, 85)


def brute_removals(rows, window):
    """n_words, n_removed and digest of each row with a doc_id of its own."""
    seen, out = {}, {}
    for i, t in rows:
        w = (t or "").encode().split()
        for p in range(len(w) - window + 1):
            if i is not None:
                k = tuple(w[p : p + window])
                seen[k] = min(seen.get(k, i), i)
    for i, t in rows:
        w, gone = (t or "").encode().split(), set()
        for p in range(len(w) - window + 1):
            if i is not None and seen[tuple(w[p : p + window])] < i:
                gone |= set(range(p, p + window))
        out[i] = (len(w), len(gone), hashlib.sha256(b" ".join(x for p, x in enumerate(w) if p not in gone)).hexdigest())
    return out


@pytest.mark.parametrize("window,base", [(50, 7), (20, 3), (9, 2), (400, 25)])
def test_substring_levels(spark, texts, window, base):
    """More levels than one, windows that aren't powers of two, and a window that nothing repeats."""
    assert substring_dedup.levels(window, base)[-1] == window and all(b <= 2 * a for a, b in zip(substring_dedup.levels(window, base), substring_dedup.levels(window, base)[1:]))
    rows = [(i, t) for i, t in texts if i is not None and i != 70]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.dedup_substrings(frame(spark, rows), window, base=base).collect()}
    assert got == brute_removals(rows, window)


def test_nearest_plan():
    """Near copies are found in fine buckets with few probes, rows without near ones need more of them."""
    rng = np.random.default_rng(6)
    centers = rng.normal(size=(300, 32))
    close = np.concatenate([centers + 0.02 * rng.normal(size=centers.shape) for _ in range(8)])
    far = rng.normal(size=(2000, 32))
    (hashes, probes), other = ann.plan(close, 5, 8, 7), ann.plan(far, 5, 8, 7)
    assert hashes > 1 and probes / 64**hashes < other[1] / 64 ** other[0]


def test_nearest_fine_buckets(spark):
    """Settings of more than one hash, fitted or given, on rows that have near ones."""
    rng = np.random.default_rng(8)
    centers = rng.normal(size=(60, 16))
    rows = [(i, [float(x) for x in centers[i % 60] + 0.05 * rng.normal(size=16)]) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = cosine_top(rows, 5)
    for settings in ({}, {"hashes": 2, "probes": 32}):
        got = {}
        for r in ann.search(df, "vec_id % 50 = 0", k=5, block=64, **settings).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
        assert sum(len(got[q] & set(want[q])) for q in want) >= 0.9 * 5 * len(want)


def naive_spans(text):
    """The three patterns spelled out character by character, leftmost and without overlap, each kind on its own."""
    plain = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
    out = []

    def run(at, letters):
        end = at
        while end < len(text) and text[end] in letters:
            end += 1
        return end

    def assigned(at):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text[at : at + 8])
        for name in ("password", "passwd", "secret", "token", "apikey", "api_key"):
            if low.startswith(name):
                for quotes in (1, 0):  # an optional sign is taken where it can be
                    i = at + len(name)
                    if quotes and text[i : i + 1] not in ('"', "'"):
                        continue
                    i = run(i + quotes, " ")
                    if text[i : i + 1] in (":", "="):
                        i = run(i + 1, " ")
                        i += text[i : i + 1] in ('"', "'") and i < len(text)
                        if (end := run(i, plain)) > i:
                            return end, end - i
        return None

    at = 0
    while at < len(text):
        if found := assigned(at):
            if found[1] >= 8:
                out.append((at, found[0], "assign"))
            at = found[0]
        else:
            at += 1
    at = 0
    while at < len(text):
        if text.startswith("AKIA", at) and (end := run(at + 4, plain[:26] + "0123456789")) > at + 4:
            if end - at >= 16:
                out.append((at, end, "access"))
            at = end
        else:
            at += 1
    at = 0
    while at < len(text):
        end = run(at, "0123456789abcdef")
        if end - at >= 32:
            out.append((at, end, "hex"))
        at = max(end, at + 1)
    return sorted(out, key=lambda s: (s[0], ("assign", "access", "hex").index(s[2])))


def test_base_spans_against_brute_force():
    rng = random.Random(12)
    bits = ["password", "PassWd", "secret", "ToKeN", "api_key", "apikey", "APIKEY", ":", "=", " ", "  ", '"', "'", "abcdefgh", "short", "é", "AKIA", "ABCDEFGHIJKL", "0f" * 16, "deadbeef" * 5, "\n", "ſ", "K", "-x_y.z/+="]
    for _ in range(3000):
        text = "".join(rng.choices(bits, k=rng.randrange(1, 14)))
        assert [(a, b, k) for a, b, k, _ in secret_scan.base_spans(text)] == naive_spans(text), text
