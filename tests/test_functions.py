"""Scalar functions, split guards and metrics on hand-computed cases."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from thawline.functions import text as fx
from thawline.operators import blocks as bl
from thawline.operators import content as ct
from thawline.operators import equity as eq
from thawline.operators import metrics as mt
from thawline.operators import models as md
from thawline.operators import retrieval as rt
from thawline.operators import split as sp
from thawline.operators import synthetic as sy
from thawline.operators import tuning as tn
from thawline.operators.ranking import running
from thawline.sources import readers
from thawline.sources.schemas import SplitParams


def one(spark, column, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize("raw,want", [("Charles Platt (Author)", ["charles platt"]), ("Brandon Graham (Author, Artist)", ["brandon graham"]), ("A (Author, Artist), B (Author)", ["a", "b"]), ("Smith, John", ["smith", "john"])])
def test_creators(spark, raw, want):
    assert [x for x in one(spark, fx.entities(fx.as_entities("s")), s=raw) if x not in fx.BLOCKLIST] == want


def test_prices(spark):
    df = spark.createDataFrame([("12.5",), ("from 4.95",), ("—",), (None,), ("1e3",), ("from 2E-1",), ("12f",)], "p string")
    assert [None if r.p is None else round(r.p, 2) for r in df.select(fx.price("p").alias("p")).collect()] == [12.5, 4.95, None, None, 1000.0, 0.2, None]


def test_blocked_creator(spark):
    assert one(spark, fx.creator(fx.as_entities("s")), s="DK Publishing") == fx.UNKNOWN


def test_windows(spark):
    got = one(spark, fx.windows("s"), s=" ".join(map(str, range(1500))))
    assert [w.split()[0] for w in got] == ["0", "650", "1300"]


def test_sections(spark):
    assert one(spark, fx.sections("s"), s="It was a review here") == {fx.RESIDUAL: "It was a review. here"}
    assert one(spark, fx.sections("s"), s="It was reviewed.") == {fx.RESIDUAL: "It was review. ed."}


def test_answers(spark):
    assert one(spark, fx.answer("s"), s="So Answer: No, then Answer: yes") == "yes"
    assert one(spark, fx.answer("s"), s="no answer: nothing") == "no" and one(spark, fx.answer("s"), s="Answer: **yes**") == ""
    odds = lambda **kv: one(spark, fx.answer_log_odds(F.create_map(*(F.lit(x) for p in kv.items() for x in p))))
    assert abs(odds(yes=-0.1, no=-2.4) - 2.3) < 1e-9 and abs(odds(yes=-0.1, maybe=-5.0) - 4.9) < 1e-9
    assert abs(odds(**{" YES": -0.1, "no": -2.4}) - 2.3) < 1e-9 and abs(odds(**{"Yes": -0.1, " NO": -2.4}) - 2.3) < 1e-9 and odds(maybe=-1.0) is None


def test_prompts(spark):
    text = one(spark, fx.prompt(F.array(*(F.lit(f"t{i}") for i in range(12))), F.lit("new"), reasoning=True))
    assert "- t9\n" in text and "t10" not in text and "Answer: yes" in text
    assert "(no prior history)" in one(spark, fx.prompt(F.lit(None).cast("array<string>"), F.lit("new")))


def test_discounts(spark):
    at = lambda name, r: round(one(spark, fx.discount(name, F.lit(r))), 3)
    assert [at("log", r) for r in (1, 5, 10)] == [1.0, 0.387, 0.289]
    assert [at("rbp0.90", r) for r in (1, 5, 10, 20)] == [1.0, 0.656, 0.387, 0.135]
    with pytest.raises(ValueError):
        fx.discount("rbp1.5", F.lit(1))


def test_params():
    with pytest.raises(ValueError):
        SplitParams(min_interactions=25, test_size=5, n_reveal=21)


def rows(spark, data):
    t = dt.datetime(2020, 1, 1)
    return spark.createDataFrame([(u, i, t + dt.timedelta(days=d), float(r), n, 1) for n, (u, i, d, r) in enumerate(data)], "user_id long, item_id long, ts timestamp, rating double, order_id long, line int")


def test_dedup_then_filter(spark):
    assert sp.positives(rows(spark, [(1, 1, 1, 5), (1, 1, 2, 2)])).count() == 0


def test_leave_last_out(spark):
    data = [(1, i, i, 5) for i in range(5)] + [(2, i, i, 5) for i in (3, 4)] + [(u, i, u, 5) for u in range(10, 14) for i in range(5)]
    s = sp.make_split(rows(spark, data), SplitParams(min_interactions=100, n_reveal=20, test_size=5, min_warm=1))
    labels = [r.split for r in s.warm.where("user_id = 1").orderBy("item_id").collect()]
    assert labels == ["train", "train", "train", "val", "test"]
    assert {r.split for r in s.warm.where("user_id = 2").collect()} == {"train"}


def test_starvation(spark):
    data = [(u, i, i, 5) for u in (1, 2) for i in (1, 2, 3)]
    s = sp.make_split(rows(spark, data), SplitParams(min_interactions=100, n_reveal=20, test_size=5, min_warm=1))
    assert {r.split for r in s.warm.collect()} == {"train"}


def test_ranking_metrics(spark):
    recs = spark.createDataFrame([(1, 1, 7), (1, 2, 8), (1, 3, 9)], "user_id long, rank int, item_id long")
    held = spark.createDataFrame([(1, 8)], "user_id long, item_id long")
    r = mt.gains(recs, held, [], "user_id", "item_id", 3).first()
    assert round(r.NDCG, 5) == 0.63093 and round(r.Precision, 5) == 0.33333 and r.Recall == r.HitRate == 1.0


def test_auc(spark):
    scored = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.9), (1, 3, 0.5), (1, 4, 0.1), (2, 1, 0.3), (2, 2, 0.3)], "user_id long, item_id long, score double")
    positive = spark.createDataFrame([(1, 1), (2, 1)], "user_id long, item_id long")
    got = {r.user_id: r.auc for r in rt.average_rank_auc(scored, positive, ["user_id"], "item_id").collect()}
    assert abs(got[1] - 2.5 / 3) < 1e-9 and got[2] == 0.5
    assert rt.average_rank_auc(scored, positive.where("false"), ["user_id"], "item_id").first().auc is None


@pytest.mark.parametrize("values,want", [([1, 1, 1, 1], 0.0), ([0, 0, 0, 1], 0.75), ([0, 0, 0, 0], 0.0)])
def test_gini(spark, values, want):
    df = spark.createDataFrame([(1, float(v)) for v in values], "g int, v double")
    assert eq.gini(df, ["g"], "v").first().gini == want


def test_ratio_stats(spark):
    r = spark.createDataFrame([(1, 0.75, 1.5), (1, 0.25, None), (1, 0.0, 0.0)], "g int, share double, ratio double")
    got = eq.ratio_stats(r, ["g"]).first()
    assert got.n_scored == 2 and got.frac_below_1 == 0.5 and got.geometric_mean == 1.5


def test_selection(spark):
    scored = spark.createDataFrame([(1, 9, 0.9), (2, 9, 0.8), (3, 9, 0.7), (4, 8, float("nan")), (5, 8, -3.0)], "user_id long, item_id long, score double")
    priors = spark.createDataFrame([(1, 0.5)], "user_id long, prior double")
    assert [r.user_id for r in sy.select_top(scored.where("item_id = 9"), 1, priors).collect()] == [2]
    assert [r.user_id for r in sy.select_top(scored.where("item_id = 8"), 2).collect()] == [5]
    assert sy.select_floored(scored.where("item_id = 8"), 2).count() == 0


def test_constrained_argmax(spark):
    points = spark.createDataFrame([("a", 1, 1.0, 0.50), ("a", 2, 2.0, 0.51), ("a", 3, 3.0, 0.49), ("a", 4, 9.0, 0.40)], "arm string, point int, objective double, warm double")
    assert tn.constrained_argmax(points, ["arm"]).first().point == 2


def test_queue(spark, tmp_path):
    from thawline.streaming.queue import score_queue

    pairs = spark.createDataFrame([(u, i, "") for u in range(5) for i in range(4)], "user_id long, item_id long, prompt string")
    pairs.write.parquet(f"{tmp_path}/pairs")
    for _ in range(2):  # the second run finds nothing left
        score_queue(spark, f"{tmp_path}/pairs", f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 20


def factors(spark, rows, name):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], f"{name} long, v array<double>")


@pytest.mark.parametrize("rows", [4096, 3])
def test_blocked_top(spark, rows):
    """Against all scores, with ties and seen items, in blocks of any size."""
    rng = np.random.default_rng(0)
    u, i = rng.integers(-2, 3, (9, 3)), rng.integers(-2, 3, (14, 3))
    seen = [(a, b) for a in range(9) for b in range(14) if (a * 7 + b) % 4 == 0] + [(0, b) for b in range(13)]
    got = {}
    top = md.blocked_top(factors(spark, enumerate(u), "user_id"), factors(spark, enumerate(i), "item_id"), spark.createDataFrame(seen, "user_id long, item_id long"), 4, rows)
    for r in top.orderBy("user_id", "rank").collect():
        got.setdefault(r.user_id, []).append((r.item_id, r.score))
    score = u @ i.T
    for a in range(9):
        want = sorted(((b, float(score[a, b])) for b in range(14) if (a, b) not in seen), key=lambda x: (-x[1], x[0]))[:4]
        assert got.get(a, []) == want


def test_products_of_unequal_rows(spark):
    """A row without a dense part, or with a shorter one, lacks zeros; keys that come twice add up; many terms go the sparse way."""
    fields = "id long, v array<double>, k array<long>, w array<double>"
    left = [(1, [1.0, 2.0], [7, 7, 9], [1.0, 2.0, 5.0]), (2, [], [9], [1.0]), (3, [3.0], [], [])]
    right = [(5, [10.0, 20.0], [7], [2.0]), (6, [1.0], [9, 8], [4.0, 1.0]), (7, [], list(range(100, 1100)), [1.0] * 1000)]
    got = bl.scored(spark.createDataFrame(left, fields), spark.createDataFrame(right, fields), bl.all_pairs, bl.PAIRS).collect()
    want = {(1, 5): 56.0, (1, 6): 21.0, (1, 7): 0.0, (2, 5): 0.0, (2, 6): 4.0, (2, 7): 0.0, (3, 5): 30.0, (3, 6): 3.0, (3, 7): 0.0}
    assert {(r.left_id, r.right_id): r.score for r in got} == want
    rng = np.random.default_rng(1)
    many = lambda n, at: [(at + i, [], [int(x) for x in rng.integers(0, 9000, 40)], [float(x) for x in rng.normal(size=40)]) for i in range(n)]
    x, y = many(30, 0), many(2500, 100)
    sums = bl.scored(spark.createDataFrame(x, fields), spark.createDataFrame(y, fields), bl.all_pairs, bl.PAIRS).groupBy("left_id").agg(F.sum("score").alias("s")).collect()
    total = np.zeros(9000)
    for _, _, k, w in y:
        np.add.at(total, k, w)
    assert all(abs(r.s - sum(total[k] * w for k, w in zip(x[r.left_id][2], x[r.left_id][3]))) < 1e-9 for r in sums)


@pytest.fixture(scope="module")
def small_split(spark):
    rng = np.random.default_rng(3)
    data = [(u, int(i), int(d), 5) for u in range(60) for d, i in enumerate(rng.choice(40, 24, replace=False))]
    s = sp.make_split(rows(spark, data), SplitParams(min_interactions=25, min_warm=2))
    return s, md.ALS(rank=4, rounds=6, reg=0.05).fit(s)


def test_fold_in_is_the_training_rule(spark, small_split):
    """Training solves the users last, on the final item factors: solving them again by the fold-in's rule, users and items swapped, gives the very
    factors that training gave."""
    s, model = small_split
    mirrored = md.ALS(rank=4, reg=0.05, users=model.items.withColumnRenamed("item_id", "user_id"))
    again = {r.item_id: np.array(r.v) for r in mirrored.solve(rt.swapped(s.train)).collect()}
    trained = {r.user_id: np.array(r.v) for r in model.users.collect()}
    assert again.keys() == trained.keys() and all(np.abs(again[u] - trained[u]).max() < 1e-5 for u in trained)


def test_hybrid(spark, small_split):
    """Weight 0 ranks as ALS alone; the additive score is both halves over their scales; a fold-in leaves profiles as they are."""
    s, als = small_split
    space = factors(spark, [(i, np.eye(8)[i % 8]) for i in range(40)], "item_id")
    users = s.reserved.select("user_id").distinct()
    shared = md.Content.of(s.train, space, users)
    base = md.Hybrid(als, shared).fit(s)
    seen = s.train.unionByName(s.revealed_at(5))
    order = lambda m: [tuple(r)[:3] for r in m.top(users, s.pool_items, seen, 5).select("user_id", "rank", "item_id").orderBy("user_id", "rank").collect()]
    folded = base.fold_in(s, 5)
    assert order(folded.with_weight(0.0)) == order(folded.cf) and folded.content is base.content and base.fold_in(s, 5).cf is folded.cf
    cf = {(r.user_id, r.item_id): r.score for r in folded.cf.scores(users, s.pool_items).collect()}
    cb = {}
    for r in s.train.join(users, "user_id", "left_semi").collect():
        cb.setdefault(r.user_id, []).append(np.eye(8)[r.item_id % 8])
    both = folded.with_weight(2.0).scores(users, s.pool_items).collect()
    assert both and all(abs(r.score - (cf.get((r.user_id, r.item_id), 0.0) / base.cf_scale + 2.0 * np.mean(cb[r.user_id], axis=0)[r.item_id % 8] / shared.scale)) < 1e-9 for r in both)
    loose = md.Hybrid(als, shared, frozen=False).fit(s).fold_in(s, 5)
    assert loose.content is not shared
    models = md.seed_ensemble(s, shared, [0, 1], rank=4, rounds=2)
    assert models[0].content is models[1].content and models[0].cf_scale != models[1].cf_scale


def test_nearest_keeps_n_rows_a_slice(spark):
    """Many blocks and slices against brute force: ties to the smaller id, nothing at or below ``above``, and few rows that leave the tasks."""
    rng = np.random.default_rng(2)
    u, i = rng.integers(-2, 3, (20, 3)), rng.integers(-2, 3, (90, 3))
    side = lambda x: ct.as_space(factors(spark, enumerate(x), "item_id"))
    found = bl.nearest(side(u), side(i), 4, others_only=True, digits=9, above=0.0, rows=2).collect()
    slices = -(-3 * spark.sparkContext.defaultParallelism // 2)
    assert len(found) <= 20 * 4 * slices < 20 * 4 * 45  # 45 blocks of right rows
    score = u @ i.T
    for a in range(20):
        got = sorted(((r.right_id, r.score) for r in found if r.left_id == a), key=lambda x: (-x[1], x[0]))[:4]
        assert got == sorted(((b, float(score[a, b])) for b in range(90) if b != a and score[a, b] > 0), key=lambda x: (-x[1], x[0]))[:4]


@pytest.mark.parametrize("most", [400, 0])
def test_moments_without_cells(spark, most, monkeypatch):
    """Sums and Gram matrices give the moments of all cells; so do the blocks."""
    monkeypatch.setattr(md, "MOMENTS", most)
    fields = "id long, v array<double>, k array<long>, w array<double>"
    x = [(1, [1.0, 2.0], [7, 7, 9], [1.0, 2.0, 5.0]), (2, [], [9], [1.0]), (3, [3.0], [], [])]
    y = [(5, [10.0, 20.0], [7], [2.0]), (6, [1.0], [9, 8], [4.0, 1.0])]
    got = md.score_moments(spark.createDataFrame(x, fields), spark.createDataFrame(y, fields)).first()
    cells = np.array([56.0, 21.0, 0.0, 4.0, 30.0, 3.0])
    assert got.n == 6 and abs(got.mean - cells.mean()) < 1e-9 and abs(got["std"] - cells.std()) < 1e-9


def test_sweep_merges_cold_lists_into_warm_ones(spark, small_split):
    """The lists of a level are those over all candidates at once."""
    from thawline.plans import modelling

    s, als = small_split
    seen, users = {}, s.reserved.select("user_id").distinct()
    modelling.sweep([als], s, [0, 5], n=6, on_lists=lambda k, seed, recs: seen.setdefault(k, recs))
    order = lambda df: [(r.user_id, r.rank, r.item_id) for r in df.orderBy("user_id", "rank").collect()]
    for k in (0, 5):
        assert order(seen[k]) == order(als.fold_in(s, k).top(users, s.pool_items, s.train.unionByName(s.revealed_at(k)), 6))


def test_pooled_vectors_travel_whole(spark):
    """Two keys, one of them null at times, over batches of three rows; a zero sum stays zero, and no row a component is made."""
    rng = np.random.default_rng(4)
    data = [(int(a), "xyz"[b] if b < 3 else None, [float(x) for x in v], float(w)) for a, b, v, w in zip(rng.integers(0, 3, 60), rng.integers(0, 4, 60), rng.normal(size=(60, 4)), rng.integers(1, 5, 60))]
    data += [(9, "x", [1.0, 0.0, 0.0, 0.0], 2.0), (9, "x", [-2.0, 0.0, 0.0, 0.0], 1.0)]
    want = {}
    for a, b, v, w in data:
        want[a, b] = want.get((a, b), 0) + np.array(v) * w
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        pooled = ct.pool_windows(spark.createDataFrame(data, "item_id long, section string, v array<double>, weight double"), ["item_id", "section"])
        got = pooled.collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    assert len(got) == len(want) and "Generate" not in pooled._jdf.queryExecution().toString()
    assert all(np.abs(np.array(r.v) - want[r.item_id, r.section] / max(np.linalg.norm(want[r.item_id, r.section]), 1e-300)).max() < 1e-12 for r in got)


def test_augmented_folds_are_apart(spark, small_split):
    s, als = small_split
    made = s.cold_ids.select(F.lit(1).cast("long").alias("user_id"), "item_id")
    assert als.fold_in(s, 0) is als.fold_in(s, 0) and als.fold_in(s.augmented(made), 0) is not als.fold_in(s, 0)
    assert s.augmented(made).revealed_at(0).count() == 0


def test_model_contract():
    md.check_model(md.ALS())
    md.check_model(md.Popularity())
    with pytest.raises(TypeError):
        md.check_model(object())
    with pytest.raises(NotImplementedError):
        md.Activity().recommend()


def test_rank_auc(spark):
    """The block kernel against a count of pairs, with ties, seen rows and a positive outside the pool."""
    rng = np.random.default_rng(5)
    u, i = rng.integers(-1, 2, (6, 2)), rng.integers(-1, 2, (12, 2))
    positive, seen = {(a, (a * 5 + k) % 13) for a in range(6) for k in range(3)}, {(a, (a * 3) % 12) for a in range(5)}
    frame = lambda pairs: spark.createDataFrame(sorted(pairs), "id long, other long")
    side = lambda x: ct.as_space(factors(spark, enumerate(x), "item_id"))
    got = {r.id: r.auc for r in rt.rank_auc(side(u), side(i), frame(positive), frame(seen)).collect()}
    for a in range(6):
        left = [b for b in range(12) if (a, b) not in seen]
        p, n = ([float(u[a] @ i[b]) for b in left if ((a, b) in positive) is yes] for yes in (True, False))
        assert abs(got[a] - np.mean([(x > y) + (x == y) / 2 for x in p for y in n])) < 1e-12


@pytest.mark.parametrize("kind", ["center", "all_but_top", "whiten"])
def test_transforms(spark, kind):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 4)) @ np.diag([5.0, 2.0, 1.0, 0.5]) + 3
    got = ct.apply_transform(factors(spark, enumerate(x), "item_id"), ct.fit_transform(factors(spark, enumerate(x[:30]), "item_id"), kind))
    got = np.array([r.v for r in got.orderBy("item_id").collect()])
    y = x - x[:30].mean(axis=0)
    value, vector = np.linalg.eigh(np.cov(x[:30].T))
    if kind == "all_but_top":
        y = y - np.outer(y @ vector[:, -1], vector[:, -1])
    if kind == "whiten":
        y = y @ (vector / np.sqrt(value))
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    assert np.abs(got @ got.T - y @ y.T).max() < 1e-9  # directions may turn, angles may not


def test_space_coercion(spark):
    assert ct.as_space(factors(spark, [(1, [1.0])], "item_id")).columns == ["id", "v", "k", "w"]
    with pytest.raises(TypeError):
        ct.as_space(spark.range(1).withColumnRenamed("id", "item_id"))
    with pytest.raises(ValueError):
        ct.build_space(None, None, None, ct.ENCODERS["hashing64"], "other")


def test_settings(spark, tmp_path):
    path = f"file://{tmp_path}/settings"
    readers.save_config(spark, path, {"weight": 1.5, "note": "two\nlines"}, ["data", 3])
    assert readers.load_config(spark, path, ["data", 3]) == {"weight": 1.5, "note": "two\nlines"}
    with pytest.raises(ValueError):
        readers.load_config(spark, path, ["data", 4])
    readers.write_text(spark, path, "{}")
    with pytest.raises(ValueError):
        readers.load_config(spark, path, ["data", 3])


def test_tables_are_built_once(spark, tmp_path):
    path, calls = f"file://{tmp_path}/t", []
    assert readers.write_filtered(spark.range(3), spark.range(5), path) and not readers.write_filtered(spark.range(4), spark.range(5), path)
    assert readers.footer_stats(spark, path).first()[:] == (3, 5, 0.6) and readers.read_stats(spark, f"file://{tmp_path}/none") == {}

    def make():
        calls.append(1)
        return spark.range(2)

    kept = readers.Checkpoint(spark, f"file://{tmp_path}/sweep", {"input": 1})
    assert [kept.get("a", make).count() for _ in range(2)] == [2, 2] and len(calls) == 1
    readers.Checkpoint(spark, f"file://{tmp_path}/sweep", {"input": 2}).get("a", make)
    assert len(calls) == 2
    spark.range(1).write.parquet(f"{tmp_path}/in/x.parquet")
    mark = readers.input_fingerprint(spark, f"file://{tmp_path}/in", seed=1)
    spark.range(9).write.mode("overwrite").parquet(f"{tmp_path}/in/x.parquet")
    assert mark != readers.input_fingerprint(spark, f"file://{tmp_path}/in", seed=1) and run_keys_differ()


def run_keys_differ():
    return readers.run_key({"a": 1}) == readers.run_key({"a": 1}) != readers.run_key({"a": 2})


def test_refusals(spark, tmp_path):
    pairs = spark.createDataFrame([(1, 2, 0.5)], "user_id long, item_id long, score double")
    sy.export_arms({("a", -1): pairs}, f"file://{tmp_path}/arms", "split 1")
    assert sy.read_arms(spark, f"file://{tmp_path}/arms", "split 1").count() == 1
    with pytest.raises(ValueError):
        sy.read_arms(spark, f"file://{tmp_path}/arms", "split 2")
    with pytest.raises(ValueError):
        sy.check_complete(pairs.where("false"), pairs)
    with pytest.raises(ValueError):
        readers.check_many_to_one(pairs.unionByName(pairs), ["user_id"])
    with pytest.raises(ValueError):
        eq.check_unattributed(spark.createDataFrame([("UNKNOWN",), ("a",)], "provider string"))
    assert sy.check_complete(pairs, pairs) is pairs


def test_progress_of_scoring(spark):
    done = spark.sparkContext.accumulator(0)
    pairs = spark.createDataFrame([(u, 1, "") for u in range(7)], "user_id long, item_id long, prompt string")
    assert sy.score_pairs(pairs, done=done).count() == 7 and done.value == 7


def test_queue_starts_again(spark, tmp_path):
    """A scorer that fails for a while; what is done stays done, and a scorer that never works is given up."""
    from pyspark.errors import StreamingQueryException

    from thawline.streaming.queue import run_queue

    spark.createDataFrame([(u, 1, "") for u in range(6)], "user_id long, item_id long, prompt string").repartition(3).write.parquet(f"{tmp_path}/pairs")
    flag = f"{tmp_path}/failed"

    def flaky(users, items, prompts):
        import os

        if users and not os.path.exists(flag):
            open(flag, "w").close()
            raise OSError("not yet")
        return [0.0] * len(users)

    def broken(users, items, prompts):
        raise OSError("never")

    assert run_queue(spark, f"{tmp_path}/pairs", f"{tmp_path}/out", f"{tmp_path}/check", flaky, files=1) == 2
    assert spark.read.parquet(f"{tmp_path}/out").count() == 6
    with pytest.raises(StreamingQueryException):
        run_queue(spark, f"{tmp_path}/pairs", f"{tmp_path}/out2", f"{tmp_path}/check2", broken)


def test_running(spark):
    """Ranks and sums over a whole relation against one sorted list."""
    rng = np.random.default_rng(2)
    data = [(int(g), float(x), i, int(w)) for i, (g, x, w) in enumerate(zip(rng.integers(0, 3, 200), rng.integers(0, 20, 200), rng.integers(1, 5, 200)))]
    got = running(spark.createDataFrame(data, "g int, x double, i int, w int"), ["x", "i"], ["g"], "w").collect()
    for g in range(3):
        before = 0
        for _, x, i, w in sorted(r for r in data if r[0] == g):
            assert next(r for r in got if r.i == i).before == before
            before += w
        assert {r.total for r in got if r.g == g} == {before}


def test_lists_are_made_once_a_content(spark, monkeypatch):
    """Rows of one content have one list and one sum, however many they are; results are those of all pairs."""

    fields = "id long, v array<double>, k array<long>, w array<double>"
    kinds = [([], [1, 2], [0.6, 0.8]), ([], [1], [1.0]), ([], [2, 3], [0.8, 0.6]), ([], [9], [1.0])]
    rows = spark.createDataFrame([(i, *kinds[i * 7 % 4]) for i in range(40)], fields)
    met, plain = [], bl.swept
    monkeypatch.setattr(bl, "swept", lambda left, right, *a, **b: met.append((left.count(), right.count())) or plain(left, right, *a, **b))
    dense = np.zeros((40, 10))
    for i in range(40):
        dense[i, kinds[i * 7 % 4][1]] = kinds[i * 7 % 4][2]
    score = np.round(dense @ dense.T, 9)
    want = {(i, r + 1, j) for i in range(0, 40, 3) for r, j in enumerate(sorted((j for j in range(40) if j != i and score[i, j] > 0), key=lambda j: (-score[i, j], j))[:6])}
    of = spark.createDataFrame([(i,) for i in range(0, 40, 3)], "item_id long")
    assert {(r.source_id, r["rank"], r.item_id) for r in ct.neighbours(rows, of, 6).collect()} == want
    users = spark.createDataFrame([(100 + u, [], [1, 3], [0.5, u / 7]) for u in range(20)], fields)
    taste = np.zeros((20, 10))
    taste[:, 1], taste[:, 3] = 0.5, np.arange(20) / 7
    cells = dense @ taste.T
    for r in ct.score_sums(users, rows).collect():
        assert np.allclose([r.total, r.spread], [cells[r.item_id].sum(), cells[r.item_id] @ (np.arange(100, 120) % 97)]) and r.n == (cells[r.item_id] > 1e-15).sum()
    near = np.round(cells / np.linalg.norm(taste, axis=1), 9)
    want = {(i, r + 1, 100 + u) for i in range(40) for r, u in enumerate(sorted((u for u in range(20) if near[i, u] > 0), key=lambda u: (-near[i, u], u))[:3])}
    assert {(r.item_id, r["rank"], r.user_id) for r in ct.filter_candidates(users, rows, 3).collect()} == want
    assert met == [(4, 4), (4, 20), (4, 20)]


def test_profiles_lay_classes_out(spark):
    """a user's rows of one content come as one part with its share; rows of items without terms count in the whole."""

    items = spark.createDataFrame([(i, [float(i % 2)], [1 + i % 2], [1.0]) for i in range(6)], "id long, v array<double>, k array<long>, w array<double>")
    history = spark.createDataFrame([(1, i) for i in range(6)] + [(1, 99), (1, 98), (2, 3)], "user_id long, item_id long")
    got = {r.id: (r.v, sorted(zip(r.k, r.w))) for r in bl.profiles(history, items).collect()}
    assert got == {1: ([0.375], [(1, 0.375), (2, 0.375)]), 2: ([1.0], [(2, 1.0)])}
    rows = spark.createDataFrame([(i, "title", "ab"[i % 2], 1.0) for i in range(6)], "item_id long, role string, term string, w double")
    assert sorted(map(tuple, ct.profiles(history, rows).collect())) == [(1, "title", "a", 0.375), (1, "title", "b", 0.375), (2, "title", "b", 1.0)]


def test_global_lists_sort_no_places(spark):
    """a user's free places are found in the user's own row; the lists are neither sorted nor dealt anew."""

    scores = spark.createDataFrame([(0, i, 10 - i) for i in range(8)], "k int, item_id long, score long")
    users = spark.createDataFrame([(u,) for u in range(3)], "user_id long")
    seen = spark.createDataFrame([(0, 1, 0), (0, 1, 2), (0, 1, 2), *((0, 2, i) for i in range(7))], "k int, user_id long, item_id long")
    got = rt.recommend_global(scores, users, seen, 3)
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.user_id, r["rank"], r.item_id) for r in got.collect()) == [(0, 1, 0), (0, 2, 1), (0, 3, 2), (1, 1, 1), (1, 2, 3), (1, 3, 4), (2, 1, 7)]


def test_split_steps_carry_no_more_than_they_need(spark):
    """what decides which row is the last travels once, and lines meet orders without a sort."""
    from thawline.plans import fixtures
    from thawline.sources.readers import keep_last

    rows = spark.createDataFrame([(1, 5, "a", 2), (1, 5, "b", 1), (2, 4, None, 0)], "k int, ts int, `x.y` string, z int")
    assert sorted(map(tuple, keep_last(rows.withColumnRenamed("x.y", "x"), ["k"], ["ts", "z"]).collect())) == [(1, 5, "a", 2), (2, 4, None, 0)]
    plan = keep_last(fixtures.interactions(spark, "/root/testdata/sf0.001"), ["user_id", "item_id"], ["ts", "order_id", "line", "rating"])._jdf.queryExecution().optimizedPlan().toString()
    assert "_row" not in plan and "AS row" not in plan
    assert "SortMergeJoin" not in fixtures.interactions(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_terms_are_cut_on_all_cores(spark):
    """the table is dealt by item before its terms are cut; counting them deals nothing anew."""

    docs = spark.createDataFrame([(1, "red red ring"), (1, "red")], "item_id long, title string").coalesce(1)
    got = ct.role_terms(docs, ("title",))
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted(map(tuple, got.collect())) == [(1, "title", "red", 3), (1, "title", "ring", 1)]


def test_sections_search_a_text_once(spark):
    """each of the two searches is worked out once a text, not once a heading."""

    text = spark.createDataFrame([("a review b Review c About the Author d reVIEW e",)], "t string").select(fx.sections("t").alias("m"))
    plan = text._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and plan.count("split(") == 1
    assert text.first().m == {"jacket_copy": "a review. b reVIEW. e", "editorial_review": "Review. c", "author_bio": "About the Author. d"}


def test_arms_deal_candidates_once(spark):
    """all arms and sizes come from one pass over the candidates; undefined scores are in no list of the scored arm."""

    scored = spark.createDataFrame([(u, i, float("nan") if u == 4 else float(u)) for u in range(5) for i in range(2)], "user_id long, item_id long, score double")
    train = spark.createDataFrame([(u,) for u in range(5) for _ in range(u)], "user_id long")
    got = sy.arms_by_n(scored, train, [2, 100], 3)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") <= 2
    assert {(r.n, r.shared, r.union) for r in got.where("arm = 'popularity'").collect()} == {(2, 2, 6), (100, 8, 10)}


def test_moments_read_vectors_once(spark):
    """number, sum and squares come from one reading."""

    read = spark.sparkContext.accumulator(0)

    def told(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    x = np.random.default_rng(0).normal(size=(50, 3))
    rows = spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>").mapInArrow(told, "v array<double>")
    n, mean, cov = ct.moments(rows)
    assert n == 50 and np.allclose(mean, x.mean(axis=0)) and np.allclose(cov, np.cov(x.T, bias=True)) and read.value == 50


def test_sums_of_tasks_meet_side_by_side(spark):
    """however many tasks there are, all are added up in one go, not a job a task, and one sum comes back."""
    x = np.random.default_rng(3).integers(-3, 4, (40, 40)).astype(float)
    rows = spark.createDataFrame([(i, v.tolist(), [], []) for i, v in enumerate(x)], "id long, v array<double>, k array<long>, w array<double>").repartition(10)
    context = spark.sparkContext
    context.setJobGroup("sums", "sums")
    n, total, outer = bl.grams(rows, [], 40)
    size, mean, cov = ct.moments(rows)
    context.setLocalProperty("spark.jobGroup.id", None)
    assert n == size == 40 and (total == x.sum(axis=0)).all() and (outer == x.T @ x).all() and np.allclose(mean, x.mean(axis=0)) and np.allclose(cov, np.cov(x.T, bias=True))
    assert len(context.statusTracker().getJobIdsForGroup("sums")) < 10
    empty = bl.grams(rows.where("id < 0"), [1], 2)
    assert empty[0] == 0 and not empty[1].any() and empty[2].shape == (3, 3) and ct.moments(rows.where("id < 0"))[0] == 0


def test_profiles_hold_a_key_once(spark, monkeypatch):
    """terms that several of a user's items share are added up, over batches too, and what is laid out is neither sorted nor collected."""
    rng = np.random.default_rng(6)
    data = [(i, [float(i)] * (i % 3), [1 + i % 4, 7], [0.5, i + 1.0]) for i in range(12)]
    items = spark.createDataFrame(data, "id long, v array<double>, k array<long>, w array<double>")
    pairs = [(u, int(i)) for u in range(6) for i in rng.choice(12, 1 + 2 * u, replace=False)] + [(u, 50 + u) for u in (2, 2, 4, 9, 9)]  # the last without rows
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        got = bl.profiles(spark.createDataFrame(pairs, "user_id long, item_id long").coalesce(1), items)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "collect_list" not in plan and plan.count("Exchange hashpartitioning(user_id") == 1 and plan.count("Sort [user_id") == 1
        rows = {r.id: r for r in got.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.setattr(bl, "DEALT", 2)
    assert bl.user_tasks(spark.range(100)) == 50 and set(rows) == set(range(6))
    for u, r in rows.items():
        mine, n = [data[i] for a, i in pairs if a == u and i < 12], sum(a == u for a, i in pairs)
        terms, dense = {}, np.zeros(max(len(m[1]) for m in mine))
        for _, v, k, w in mine:
            dense[: len(v)] += np.array(v) / n
            for x, y in zip(k, w):
                terms[x] = terms.get(x, 0.0) + y / n
        assert sorted(r.k) == sorted(terms) and np.allclose([terms[x] for x in r.k], r.w) and np.allclose(r.v, dense)


def test_texts_are_cut_once_a_content(spark, monkeypatch):
    """items of the same texts are cut and weighed once; their rows and the space are those of all items."""
    cut, plain = [], ct.role_terms
    docs = spark.createDataFrame([(i, ["red ring", "red bolt", "old ring", "odd"][i % 4], "ab"[i % 2]) for i in range(20)], "item_id long, title string, creator string")
    warm = spark.createDataFrame([(i,) for i in range(0, 15) for _ in range(2) if i != 3 and i != 7], "item_id long")
    roles = ("title", "creator")
    terms = plain(docs, roles)
    want = ct.transform(terms, ct.fit_space(terms, warm.distinct(), 3), {"title": 1.0, "creator": 0.5})
    want = {r.id: dict(zip(r.k, r.w)) for r in bl.packed(want, "item_id").collect()}
    monkeypatch.setattr(ct, "role_terms", lambda d, *a: cut.append(d.count()) or plain(d, *a))
    got = {r.id: dict(zip(r.k, r.w)) for r in ct.packed_rows(docs, warm, roles, {"title": 1.0, "creator": 0.5}, 3).collect()}
    assert cut == [4] and set(got) == set(want) == set(range(20))
    assert all(set(got[i]) == set(want[i]) and np.allclose([got[i][k] for k in got[i]], [want[i][k] for k in got[i]]) for i in got)
