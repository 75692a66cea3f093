"""Retrieval models: the contract, popularity, activity, implicit ALS with closed-form fold-in, the additive hybrid and its seeds.

User preferences are fitted once and frozen; only a cold item's representation moves with k.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Protocol, runtime_checkable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.readers import materialise
from . import blocks as bl
from . import content, retrieval
from .split import Split


@runtime_checkable
class Model(Protocol):
    """What a model must offer; nothing need be inherited."""

    def fit(self, s: Split) -> Model: ...

    def fold_in(self, s: Split, k: int) -> Model: ...

    def fold_in_ceiling(self, s: Split) -> Model: ...

    def scores(self, users: DataFrame, items: DataFrame) -> DataFrame: ...


def check_model(model: object) -> None:
    if not isinstance(model, Model):
        raise TypeError(f"{type(model).__name__} lacks a method of the model contract")


@dataclass
class Popularity:
    """Items by number of interactions; fold-in counts again with the revealed rows."""

    counts: DataFrame | None = None

    def fit(self, s: Split) -> Popularity:
        return Popularity(s.train.groupBy("item_id").agg(F.count("*").alias("score")))

    def _with(self, s: Split, more: DataFrame) -> Popularity:
        rows = s.train.unionByName(more.select("user_id", "item_id"))
        return Popularity(rows.groupBy("item_id").agg(F.count("*").alias("score")))

    def fold_in(self, s: Split, k: int) -> Popularity:
        return self._with(s, s.fold_in_at(k))

    def fold_in_ceiling(self, s: Split) -> Popularity:
        return self._with(s, s.ceiling)

    def scores(self, users: DataFrame, items: DataFrame) -> DataFrame:
        """One row an item: the order is the same for every user."""
        return items.join(self.counts, "item_id", "left").select("item_id", F.coalesce("score", F.lit(0)).alias("score"))


@dataclass
class Activity:
    """Users by number of interactions, for ranking users of an item; nothing to fold in."""

    counts: DataFrame | None = None

    def fit(self, s: Split) -> Activity:
        return Activity(s.train.groupBy("user_id").agg(F.count("*").alias("score")))

    def fold_in(self, s: Split, k: int) -> Activity:
        return self

    def fold_in_ceiling(self, s: Split) -> Activity:
        return self

    def scores(self, users: DataFrame, items: DataFrame) -> DataFrame:
        return users.join(self.counts, "user_id", "left").select("user_id", F.coalesce("score", F.lit(0)).alias("score"))

    def recommend(self, *_: object) -> DataFrame:
        raise NotImplementedError("activity ranks users, not items")


SALTS = 16
SUMS = "item_id long, n long, total array<double>, outer array<double>"


def _summed(parts: bool):
    """Sums over consecutive rows of one item: of v and v vT (rows (item_id, v)), or of partial sums (rows SUMS).  Input is sorted by item, so one
    item's sums are held at a time, and rows of an item may span batches."""
    import pyarrow as pa

    def run(batches):
        item, n, total, outer = None, 0, None, None

        def told():
            return pa.RecordBatch.from_pydict({"item_id": pa.array([item], pa.int64()), "n": pa.array([n], pa.int64()), "total": pa.array([total.tolist()]), "outer": pa.array([outer.ravel().tolist()])})

        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("item_id").to_numpy()
            flat = lambda c, r: batch.column(c).flatten().to_numpy().reshape(r, -1)
            rows = len(ids)
            x = flat("total" if parts else "v", rows)
            squares, counts = (flat("outer", rows), batch.column("n").to_numpy()) if parts else (None, np.ones(rows, np.int64))
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(ids)) + 1, [rows]])
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if ids[lo] != item:
                    if item is not None:
                        yield told()
                    item, n, total, outer = int(ids[lo]), 0, 0.0, 0.0
                n, total = n + int(counts[lo:hi].sum()), total + x[lo:hi].sum(axis=0)
                outer = outer + (squares[lo:hi].sum(axis=0) if parts else (x[lo:hi].T @ x[lo:hi]).ravel())
        if item is not None:
            yield told()

    return run


def _solve(gram: np.ndarray, reg: float):
    """The training rule: an item's regulariser is multiplied by its number of rows."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            rank = len(gram)
            total = np.array(batch.column("total").to_pylist(), float).reshape(-1, rank)
            outer = np.array(batch.column("outer").to_pylist(), float).reshape(-1, rank, rank)
            weight = reg * batch.column("n").to_numpy()[:, None, None] * np.eye(rank)
            x = np.linalg.solve(gram + weight + outer, 2.0 * total[:, :, None])[:, :, 0] if len(total) else total
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(x.tolist(), pa.list_(pa.float64()))], ["item_id", "v"])

    return run


@dataclass
class ALS:
    """Implicit matrix factorisation.  ``fold_in`` solves each cold item against frozen users in closed form."""

    rank: int = 16
    reg: float = 0.01
    rounds: int = 5
    seed: int = 0
    users: DataFrame | None = None
    items: DataFrame | None = None
    folds: dict = field(default_factory=dict, repr=False)

    def fit(self, s: Split, more: DataFrame | None = None) -> ALS:
        """On the train rows, and on ``more`` (synthetic rows) if there are any."""
        from pyspark.ml.recommendation import ALS as SparkALS

        train = s.train if more is None else s.train.unionByName(more.select("user_id", "item_id")).distinct()
        rows = train.select(F.col("user_id").cast("int").alias("user_id"), F.col("item_id").cast("int").alias("item_id"), F.lit(1.0).alias("r"))
        als = SparkALS(rank=self.rank, regParam=self.reg, maxIter=self.rounds, seed=self.seed, implicitPrefs=True, alpha=1.0, userCol="user_id", itemCol="item_id", ratingCol="r")
        model = als.fit(rows)
        factors = lambda df, name: df.select(F.col("id").cast("long").alias(name), F.col("features").cast("array<double>").alias("v"))
        return replace(self, users=materialise(factors(model.userFactors, "user_id")), items=materialise(factors(model.itemFactors, "item_id")), folds={})

    def gram(self) -> np.ndarray:
        """Sum of u uT over all users: rank * rank numbers, summed in the tasks."""
        from .content import moments

        n, mean, cov = moments(self.users)
        return n * (cov + np.outer(mean, mean))

    def solve(self, rows: DataFrame) -> DataFrame:
        """(item_id, v) of the items in rows (user_id, item_id), confidence 2 on each, users frozen.  The sums over users are taken in the tasks:
        an item's rows go to SALTS tasks at most, which send one partial sum each, so a hot item is no longer one task's work."""
        known = rows.join(self.users, "user_id").select("item_id", "v", F.pmod(F.xxhash64("user_id"), F.lit(SALTS)).alias("salt"))
        part = known.repartition("item_id", "salt").sortWithinPartitions("item_id").select("item_id", "v").mapInArrow(_summed(False), SUMS)
        sums = part.repartition("item_id").sortWithinPartitions("item_id").mapInArrow(_summed(True), SUMS)
        return sums.mapInArrow(_solve(self.gram(), self.reg), "item_id long, v array<double>")

    def _folded(self, s: Split, rows: DataFrame) -> ALS:
        """Cold items without rows get the zero vector."""
        cold = s.cold_ids.join(self.solve(rows), "item_id", "left").select("item_id", F.coalesce("v", F.array_repeat(F.lit(0.0), self.rank)).alias("v"))
        return replace(self, items=self.items.join(cold, "item_id", "left_anti").unionByName(cold), folds={})

    def fold_in(self, s: Split, k: int) -> ALS:
        return self._once(s, k, lambda: self._folded(s, s.fold_in_at(k)))

    def fold_in_ceiling(self, s: Split) -> ALS:
        return self._once(s, "ceiling", lambda: self._folded(s, s.ceiling.select("user_id", "item_id")))

    def _once(self, s: Split, k: int | str, make) -> ALS:
        """A fold-in of one split at one level is solved and written once; a split with synthetic rows has a key of its own."""
        key = (id(s.warm), s.population, s.salt, k)
        if key not in self.folds:
            folded = make()
            self.folds[key] = (s, replace(folded, items=materialise(folded.items)))
        return self.folds[key][1]

    def scores(self, users: DataFrame, items: DataFrame) -> DataFrame:
        """Every pair, for pools of bounded size; ranked lists go through ``top``."""
        left, right = users.join(self.users, "user_id").withColumnRenamed("user_id", "item_id"), items.join(self.items, "item_id")
        found = bl.scored(content.as_space(left), content.as_space(right), bl.all_pairs, bl.PAIRS)
        return found.withColumnsRenamed({"left_id": "user_id", "right_id": "item_id"})

    def top(self, users: DataFrame, items: DataFrame, seen: DataFrame, n: int) -> DataFrame:
        return blocked_top(users.join(self.users, "user_id"), items.join(self.items, "item_id"), seen, n)

    def warm_top(self, users: DataFrame, s: Split, n: int) -> DataFrame:
        """The lists over the warm items, which no fold-in moves; written once for the reserved users of a split."""
        key = (id(s.warm), s.population, id(s.only_items), "warm", n)
        if key not in self.folds:
            self.folds[key] = (s, warm_top(self, users, s, n))
        return self.folds[key][1]


def packed_side(rows: DataFrame, name: str) -> DataFrame:
    """Factors (name, v) or packed rows (id, ...) as packed rows."""
    return rows if "id" in rows.columns else content.as_space(rows.withColumnRenamed(name, "item_id"))


def blocked_top(users: DataFrame, items: DataFrame, seen: DataFrame, n: int, rows: int = bl.ROWS) -> DataFrame:
    """(user_id, rank, item_id, score): the n best unseen items of each user by inner product.

    Each task holds blocks of at most about ``rows`` users and reads its slice of the items once; what a user has seen is left out there, so n rows a
    user and slice are all that is written.
    """
    gone = seen.groupBy(F.col("user_id").alias("id")).agg(F.collect_set(F.col("item_id").cast("long")).alias("gone"))
    left = packed_side(users, "user_id").join(gone, "id", "left")
    found = bl.nearest(left, packed_side(items, "item_id"), n, rows=rows).withColumnsRenamed({"left_id": "user_id", "right_id": "item_id"})
    return retrieval.top_k(found, ["user_id"], "item_id", n)


def warm_top(model: ALS | Hybrid, users: DataFrame, s: Split, n: int) -> DataFrame:
    return materialise(model.top(users, s.train.select("item_id").distinct(), s.train.join(users, "user_id", "left_semi"), n))


def score_moments(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row (n, mean, std) over all cells of left x right.  Both follow from the sums and the Gram matrix of each side - the sum of all
    squared scores is the sum of the products of the two matrices - so no cell is formed; a right side of more than MOMENTS terms goes by blocks."""
    names = sorted(r[0] for r in right.select(F.explode("k")).distinct().limit(MOMENTS + 1).collect())
    if len(names) > MOMENTS:
        return score_spread(left, right).drop("range")
    width = right.agg(F.max(F.size("v"))).first()[0] or 0
    (n, s, g), (m, t, h) = (bl.grams(side, names, max(width, 0)) for side in (left, right))
    mean = F.col("s") / F.col("n")
    one = left.sparkSession.range(0, 1, 1, 1).select(F.lit(n * m).cast("long").alias("n"), F.lit(float(s @ t)).alias("s"), F.lit(float((g * h).sum())).alias("q"))
    return one.select("n", mean.alias("mean"), F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0))).alias("std"))


#: Terms that the moments of scores take a Gram matrix of.
MOMENTS = 400


def score_spread(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row (n, mean, std, range) over all cells of left x right, from one small row a pair of blocks."""
    import pyarrow as pa

    def reduce(a, b, score):
        if not score.size:
            return pa.table({"n": pa.array([], pa.int64()), **{c: pa.array([], pa.float64()) for c in ("s", "q", "lo", "hi")}})
        return pa.table({"n": pa.array([score.size], pa.int64()), "s": [float(score.sum())], "q": [float((score * score).sum())], "lo": [float(score.min())], "hi": [float(score.max())]})

    one = bl.scored(left, right, reduce, "n long, s double, q double, lo double, hi double").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    mean = F.col("s") / F.col("n")
    return one.select("n", mean.alias("mean"), F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0))).alias("std"), (F.col("hi") - F.col("lo")).alias("range"))


@dataclass
class Content:
    """What the hybrid takes from content: user profiles and items as packed rows, and the scale of their scores.  It depends on neither seed nor
    level, so the models of all seeds share one, written once."""

    users: DataFrame
    items: DataFrame
    scale: float = 1.0

    @staticmethod
    def of(history: DataFrame, space: DataFrame, users: DataFrame, kind: str = "std") -> Content:
        """Profiles of ``users`` over ``history``, and the scale over users x items."""
        items = materialise(content.as_space(space))
        rows = materialise(bl.profiles(history.join(users, "user_id", "left_semi"), items))
        return Content(rows, items, scale_of(rows, items, kind))


def scale_of(left: DataFrame, right: DataFrame, kind: str = "std") -> float:
    """The deviation or range of all scores, 1 where that is 0."""
    found = score_moments(left, right) if kind == "std" else score_spread(left, right)
    return float(found.first()[kind] or 0.0) or 1.0


@dataclass
class Hybrid:
    """cf / s_cf + weight * content / s_cb, as one inner product of joined rows.  Scales are fitted once on the unfolded model; they divide and never
    shift.  Folding in moves the factors of cold items alone, unless ``frozen`` is off, where profiles take in the revealed rows too (an
    ablation)."""

    cf: ALS
    content: Content
    weight: float = 1.0
    cf_scale: float = 1.0
    frozen: bool = True

    def fit(self, s: Split) -> Hybrid:
        cf = self.cf if self.cf.users is not None else self.cf.fit(s)
        users = self.content.users.select(F.col("id").alias("user_id")).join(cf.users, "user_id")
        return replace(self, cf=cf, cf_scale=scale_of(packed_side(users, "user_id"), packed_side(cf.items, "item_id")))

    def with_weight(self, weight: float) -> Hybrid:
        return replace(self, weight=weight)

    def _moved(self, cf: ALS, s: Split, shown: DataFrame) -> Hybrid:
        if self.frozen:
            return replace(self, cf=cf)
        history = s.train.unionByName(shown.select("user_id", "item_id"))
        known = self.content.users.select(F.col("id").alias("user_id"))
        rows = materialise(bl.profiles(history.join(known, "user_id", "left_semi"), self.content.items))
        return replace(self, cf=cf, content=replace(self.content, users=rows))

    def fold_in(self, s: Split, k: int) -> Hybrid:
        return self._moved(self.cf.fold_in(s, k), s, s.revealed_at(k))

    def fold_in_ceiling(self, s: Split) -> Hybrid:
        return self._moved(self.cf.fold_in_ceiling(s), s, s.ceiling)

    def sides(self, users: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Packed rows whose inner products are the additive scores; a missing half counts as zeros."""
        zero, none = F.array_repeat(F.lit(0.0), self.cf.rank), lambda t: F.array().cast(f"array<{t}>")

        def joined(ids, factors, rows, name, cf_by, cb_by):
            out = ids.select(F.col(name).alias("id")).join(factors.withColumnsRenamed({name: "id", "v": "f"}), "id", "left").join(rows.withColumnRenamed("v", "d"), "id", "left")
            times = lambda c, x: F.transform(c, lambda y: y * x)
            return out.select("id", F.concat(times(F.coalesce("f", zero), cf_by), times(F.coalesce("d", none("double")), cb_by)).alias("v"), F.coalesce("k", none("long")).alias("k"), times(F.coalesce("w", none("double")), cb_by).alias("w"))

        left = joined(users, self.cf.users, self.content.users, "user_id", 1.0 / self.cf_scale, self.weight / self.content.scale)
        return left, joined(items, self.cf.items, self.content.items, "item_id", 1.0, 1.0)

    def scores(self, users: DataFrame, items: DataFrame) -> DataFrame:
        found = bl.scored(*self.sides(users, items), bl.all_pairs, bl.PAIRS)
        return found.withColumnsRenamed({"left_id": "user_id", "right_id": "item_id"})

    def top(self, users: DataFrame, items: DataFrame, seen: DataFrame, n: int) -> DataFrame:
        left, right = self.sides(users, items)
        return blocked_top(left, right, seen, n)

    def warm_top(self, users: DataFrame, s: Split, n: int) -> DataFrame:
        return warm_top(self, users, s, n)


def seed_ensemble(s: Split, shared: Content, seeds: list[int], weight: float = 1.0, **als) -> list[Hybrid]:
    """One hybrid a seed; all share the content, each measures its own factors' scale."""
    return [Hybrid(ALS(seed=seed, **als), shared, weight).fit(s) for seed in seeds]


def users_of_items(model: ALS | Hybrid, s: Split, shown: DataFrame, n: int) -> DataFrame:
    """(item_id, rank, user_id, score): the n best users of each cold item, those in ``shown`` (user_id, item_id) left out.  An item that
    has seen too many gets a shorter list."""
    every = model.cf.users if isinstance(model, Hybrid) else model.users
    if isinstance(model, Hybrid):
        right, left = model.sides(every, s.cold_ids)
    else:
        right, left = packed_side(every, "user_id"), packed_side(model.items.join(s.cold_ids, "item_id", "left_semi"), "item_id")
    return retrieval.swapped(blocked_top(left, right, retrieval.swapped(shown.select("user_id", "item_id")), n)).select("item_id", "rank", "user_id", "score")
