"""Ranking without score matrices: popularity and activity lists, exclusion, top-K, merging, average-rank AUC."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.readers import materialise
from . import blocks as bl
from .ranking import top_per_key


def revealed_by_k(reveal: DataFrame, levels: list[int]) -> DataFrame:
    """(k, user_id, item_id): the first k users of each cold item, for every k at once."""
    ks = F.explode(F.filter(F.array(*map(F.lit, levels)), lambda k: k > F.col("pos")))
    return reveal.select(ks.alias("k"), "user_id", "item_id")


def swapped(df: DataFrame) -> DataFrame:
    """Users and items change places: the item-to-user direction reuses the user-to-item kernels."""
    names = {"user_id": "item_id", "item_id": "user_id"}
    return df.select(*(F.col(c).alias(names.get(c, c)) for c in df.columns))


def levels_frame(df: DataFrame, levels: list[int]) -> DataFrame:
    return df.select(F.explode(F.array(*map(F.lit, levels))).alias("k"), "*")


def popularity(train: DataFrame, revealed: DataFrame, pool: DataFrame, levels: list[int]) -> DataFrame:
    """(k, item_id, score): interaction counts of each pool item when the first k users are known."""
    base = levels_frame(pool.join(train.groupBy("item_id").agg(F.count("*").alias("n")), "item_id", "left"), levels)
    more = revealed.groupBy("k", "item_id").agg(F.count("*").alias("m"))
    return base.join(more, ["k", "item_id"], "left").select("k", "item_id", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("score"))


def recommend_global(scores: DataFrame, users: DataFrame, seen: DataFrame, n: int, entity: str = "item_id", to: str = "user_id") -> DataFrame:
    """(k, user, rank, item): the first n unseen items of one global order per k.

    A user who has seen m of the leading items finds n unseen ones among the first n + m places, so only the
    leading n + max(m) places are kept, and each user expands to n + m of them: no product of users and items.
    ``seen`` is (k, user, item).
    """
    longest = seen.groupBy("k", to).agg(F.count("*").alias("m")).groupBy("k").agg(F.max("m").alias("most"))
    # counts by score value say which scores can reach the leading places: only those are put in order
    values = scores.groupBy("k", "score").agg(F.count("*").alias("c")).join(longest, "k", "left")
    ahead = F.sum("c").over(Window.partitionBy("k").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1))
    wanted = n + F.coalesce("most", F.lit(0))
    values = values.withColumn("ahead", F.coalesce(ahead, F.lit(0))).where(F.col("ahead") < wanted).select("k", "score", wanted.alias("wanted"))
    place = F.row_number().over(Window.partitionBy("k").orderBy(F.desc("score"), entity))
    lead = materialise(scores.join(values, ["k", "score"]).withColumn("place", place).where(F.col("place") <= F.col("wanted")).select("k", entity, "place", "score"))
    hits = seen.join(lead, ["k", entity]).select("k", to, "place")
    taken = hits.groupBy("k", to).agg(F.collect_set("place").alias("taken"))
    asked = lead.select("k").distinct().join(users.select(to)).join(taken, ["k", to], "left")
    taken = F.coalesce("taken", F.array().cast("array<int>"))
    free = F.slice(F.array_except(F.sequence(F.lit(1), F.size(taken) + n), taken), 1, n)
    # places stay in one row until here, dealt over all cores: nothing of the size of the lists is sorted or dealt anew
    asked = asked.repartition(3 * users.sparkSession.sparkContext.defaultParallelism, "k", to)
    rows = asked.select("k", to, F.posexplode(free).alias("rank", "place")).join(lead, ["k", "place"])
    return rows.select("k", to, (F.col("rank") + 1).alias("rank"), entity, "score")


def exclude(candidates: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    return candidates.join(seen.select(*keys).distinct(), keys, "left_anti")


def top_k(scored: DataFrame, by: list[str], entity: str, n: int) -> DataFrame:
    """The n best of each key: score descending, ties to the smaller id."""
    return top_per_key(scored, by, [F.desc("score"), entity], n)


def merge_top(warm_lists: DataFrame, cold_scores: DataFrame, by: list[str], entity: str, n: int) -> DataFrame:
    """Cached lists of the unchanging items and fresh scores of the others, merged to n.  Exact: an item
    outside the cached n can't be among the n best of the union."""
    both = warm_lists.select(*by, entity, "score").unionByName(cold_scores.select(*by, entity, "score"))
    return top_k(both, by, entity, n)


def average_rank_auc(scored: DataFrame, positives: DataFrame, by: list[str], entity: str) -> DataFrame:
    """(by..., n_pos, n_neg, auc): Mann-Whitney over the candidates of each key with tied scores at their average rank;
    null without a positive or a negative.  ``scored`` excludes what was seen."""
    marks = scored.join(positives.select(*by, entity).distinct().withColumn("pos", F.lit(1)), [*by, entity], "left").fillna(0, ["pos"])
    # one row per key and score value: ties never gather, only their counts do
    tied = marks.groupBy(*by, "score").agg(F.count("*").alias("n"), F.sum("pos").alias("p"))
    below = F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = tied.withColumn("mean_rank", below + (F.col("n") + 1) / 2.0)
    out = ranked.groupBy(*by).agg(F.sum("p").alias("n_pos"), (F.sum("n") - F.sum("p")).alias("n_neg"), F.sum(F.col("mean_rank") * F.col("p")).alias("ranks"))
    u = F.col("ranks") - F.col("n_pos") * (F.col("n_pos") + 1) / 2.0
    return out.select(*by, "n_pos", "n_neg", (u / F.nullif(F.col("n_pos") * F.col("n_neg"), F.lit(0))).alias("auc"))


def popularity_auc(scores: DataFrame, users: DataFrame, seen: DataFrame, test: DataFrame) -> DataFrame:
    """(k, user_id, auc) of one global score order.

    Every user shares the order, so ranks are counted once per score value; a user's own excluded
    candidates are then taken off.  No product of users and items.  ``seen`` is (k, user_id, item_id).
    """
    value = scores.groupBy("k", "score").agg(F.count("*").alias("n"))
    below = F.coalesce(F.sum("n").over(Window.partitionBy("k").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    value = value.withColumn("below", below)
    total = scores.groupBy("k").agg(F.count("*").alias("total"))
    out_rows = seen.join(scores, ["k", "item_id"]).select("k", "user_id", F.col("score").alias("x"))
    gone = out_rows.groupBy("k", "user_id").agg(F.count("*").alias("gone"))
    kept = test.join(scores, "item_id").join(seen, ["k", "user_id", "item_id"], "left_anti")
    pos = kept.join(value, ["k", "score"])
    less = pos.join(out_rows, ["k", "user_id"], "left").groupBy("k", "user_id", "item_id", "score", "below", "n").agg(
        F.count_if(F.col("x") < F.col("score")).alias("gone_below"), F.count_if(F.col("x") == F.col("score")).alias("gone_tied"))
    rank = F.col("below") - F.col("gone_below") + (F.col("n") - F.col("gone_tied") + 1) / 2.0
    by_user = less.groupBy("k", "user_id").agg(F.count("*").alias("n_pos"), F.sum(rank).alias("ranks"))
    out = by_user.join(total, "k").join(gone, ["k", "user_id"], "left").join(users, "user_id", "left_semi")
    n_neg = F.col("total") - F.coalesce("gone", F.lit(0)) - F.col("n_pos")
    u = F.col("ranks") - F.col("n_pos") * (F.col("n_pos") + 1) / 2.0
    return out.select("k", "user_id", (u / F.nullif(F.col("n_pos") * n_neg, F.lit(0))).alias("auc"))


def rank_auc(left: DataFrame, right: DataFrame, positives: DataFrame, seen: DataFrame) -> DataFrame:
    """(id, n_pos, n_neg, auc) of each row of ``left`` (packed rows) that has a positive: Mann-Whitney over the rows of ``right``, those in ``seen``
    (id, other) left out, tied scores at their average rank; null without a negative.

    Two rounds over the blocks: the first tells the scores of the positives (id, other), the second counts in each block how many
    candidates score less and as much.  No candidate is ever written.
    """
    import numpy as np
    import pyarrow as pa

    listed = lambda df, name: df.groupBy("id").agg(F.collect_set("other").alias(name))
    asked = left.join(listed(positives.join(seen, ["id", "other"], "left_anti"), "wanted"), "id").join(listed(seen, "gone"), "id", "left")

    def told(a, b, score):
        order = np.argsort(b.ids)
        ids, of = a.listed("wanted")
        at = np.minimum(np.searchsorted(b.ids[order], ids), max(len(order) - 1, 0))
        on = b.ids[order][at] == ids if len(order) else np.zeros(len(ids), bool)
        row, column = of[on], order[at[on]] if len(order) else at[on]
        return pa.table({"id": pa.array(a.ids[row], pa.int64()), "score": pa.array(score[row, column], pa.float64())})

    carry = {"wanted": "array<long>"}
    marks = bl.scored(asked, right, told, "id long, score double", carry=carry).groupBy("id").agg(F.collect_list("score").alias("marks"))

    def counted(a, b, score):
        score = score.copy()
        order = np.argsort(b.ids)
        ids, of = a.listed("gone")
        at = np.minimum(np.searchsorted(b.ids[order], ids), max(len(order) - 1, 0))
        on = b.ids[order][at] == ids if len(order) else np.zeros(len(ids), bool)
        out = np.zeros_like(score, bool)
        if len(order):
            out[of[on], order[at[on]]] = True
        value, row = a.listed("marks")
        ranks, totals = np.zeros(len(a.ids)), (~out).sum(axis=1)
        first = np.searchsorted(row, np.arange(len(a.ids) + 1))
        for r in range(len(a.ids)):
            mine, kept = value[first[r] : first[r + 1]], np.sort(score[r][~out[r]])
            ranks[r] = (np.searchsorted(kept, mine) + np.searchsorted(kept, mine, "right")).sum() / 2.0
        return pa.table({"id": pa.array(a.ids, pa.int64()), "ranks": pa.array(ranks, pa.float64()), "total": pa.array(totals, pa.int64()), "n_pos": pa.array(np.bincount(row, minlength=len(a.ids)), pa.int64())})

    fields = "id long, ranks double, total long, n_pos long"
    rows = bl.scored(left.join(marks, "id").join(listed(seen, "gone"), "id", "left"), right, counted, fields, carry={"marks": "array<double>", "gone": "array<long>"})
    one = rows.groupBy("id").agg(F.sum("ranks").alias("ranks"), F.sum("total").alias("total"), F.max("n_pos").alias("n_pos"))
    n_neg = F.col("total") - F.col("n_pos")
    # a positive's rank counts half of its ties, itself among them: (less + not more + 1) / 2
    u = F.col("ranks") + F.col("n_pos") / 2.0 - F.col("n_pos") * (F.col("n_pos") + 1) / 2.0
    return one.select("id", "n_pos", n_neg.alias("n_neg"), (u / F.nullif(F.col("n_pos") * n_neg, F.lit(0))).alias("auc"))
