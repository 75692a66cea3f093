"""Approximate nearest neighbours by cross-polytope hashing.

Three rounds of random signs and a fast Hadamard transform turn each unit vector; its bucket in a table is
the signed axis it lies nearest to.  A query looks into the buckets of its ``probes`` nearest signed axes in each of
``tables`` tables, and what it meets there is ranked exactly by cosine.

Rows and queries meet in blocks (table, bucket, row salt, query salt): a bucket with more rows
or queries than ``block`` is cut, so a vector that a third of all rows share makes more blocks, not a
longer one.  Each block returns at most k rows a query.  Queries that met fewer than k candidates are ranked
against all rows in blocks.  ``hashes`` > 1 takes that many axes together: finer buckets, which hold a smaller share of the rows but need
more probes.  Where they aren't given, both numbers are fitted (``plan``) on a bounded sample: of the settings that find the true neighbours
within the sample often enough, the one whose buckets hold the smallest share of the rows.  The sample is thinner than the table, so its
neighbours lie farther and are harder to find.

Defined results: vectors that are null or zero, or hold null or non-finite components, or whose id is null, take no
part.  Vectors of different length never meet.  A query meets no row of its own id.  Fewer than k
candidates: all of them.  Rows that share an id count as one, by the best score.  Ties go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

#: Buckets whose sizes are broadcast; more are joined.
FEW = 200_000


def vectors(column: pa.Array) -> list[np.ndarray | None]:
    """Valid vectors in double precision, None for the others."""
    out: list[np.ndarray | None] = []
    for x in column:
        if not x.is_valid or x.values is None or x.values.null_count or not len(x.values):
            out.append(None)
            continue
        v = x.values.to_numpy().astype(np.float64)
        out.append(v if np.isfinite(v).all() and v.any() else None)
    return out


def rotate(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Pseudo-rotation of each row; the width is a power of two."""
    y = x
    for s in signs:
        y = y * s
        h = 1
        while h < y.shape[1]:
            y = y.reshape(len(y), -1, 2, h)
            y = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), -1)
            h *= 2
        y = y / np.sqrt(y.shape[1])
    return y


def signs_of(width: int, table: int, part: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, table, part, width]).choice(np.array([-1.0, 1.0]), (3, width))


def buckets(x: np.ndarray, tables: int, hashes: int, probes: int, seed: int) -> np.ndarray:
    """rows x tables x probes: bucket numbers, nearest first."""
    width = 1 << max(0, (x.shape[1] - 1).bit_length())
    unit = np.zeros((len(x), width))
    unit[:, : x.shape[1]] = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = np.zeros((len(x), tables, probes), np.int64)
    for t in range(tables):
        score, code = np.zeros((len(x), 1)), np.zeros((len(x), 1), np.int64)
        for p in range(hashes):
            y = rotate(unit, signs_of(width, t, p, seed))
            signed = np.concatenate([y, -y], axis=1)
            take = min(probes, signed.shape[1])
            best = np.argsort(-signed, axis=1, kind="stable")[:, :take]
            total = score[:, :, None] + np.take_along_axis(signed, best, 1)[:, None, :]
            codes = code[:, :, None] * signed.shape[1] + best[:, None, :]
            total, codes = total.reshape(len(x), -1), codes.reshape(len(x), -1)
            top = np.argsort(-total, axis=1, kind="stable")[:, :probes]
            score, code = np.take_along_axis(total, top, 1), np.take_along_axis(codes, top, 1)
        out[:, t, : code.shape[1]] = code
        out[:, t, code.shape[1] :] = code[:, -1:]
    return out


def _hashed(tables: int, hashes: int, probes: int, seed: int):
    def run(batches):
        for batch in batches:
            found, ids = vectors(batch.column("embedding")), batch.column("vec_id")
            by_width: dict[int, list[int]] = {}
            for i, v in enumerate(found):
                if v is not None and ids[i].is_valid:
                    by_width.setdefault(len(v), []).append(i)
            for width, rows in by_width.items():
                for at in range(0, len(rows), 1024):
                    some = rows[at : at + 1024]
                    x = np.stack([found[i] for i in some])
                    b = buckets(x, tables, hashes, probes, seed)
                    n = len(some)
                    t, of = np.tile(np.repeat(np.arange(tables), probes), n), np.repeat(np.arange(n), tables * probes)
                    raw = pa.array([v.tobytes() for v in x], pa.binary())
                    arrays = [pa.array(t, pa.int32()), pa.array(b.reshape(-1)), pa.array(np.full(len(t), width), pa.int32())]
                    yield pa.RecordBatch.from_arrays([*arrays, ids.take(pa.array(some)).take(pa.array(of)), raw.take(pa.array(of))], ["t", "b", "d", "vec_id", "v"])

    return run


def nearest(rows: np.ndarray, ids: np.ndarray, query: np.ndarray, rough: np.ndarray, starts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and exact cosines of the k best ids.  ``rough`` scores only choose what is measured exactly; rows of
    one id are neighbours, from each of ``starts`` on, and count by their best.  A row scored -inf takes no part."""
    best = np.maximum.reduceat(rough, starts) if len(rough) else rough
    taking = np.count_nonzero(best > -np.inf)
    if not taking:
        return np.zeros(0, np.int64), np.zeros(0)
    place = len(best) - min(k, taking)
    floor = np.partition(best, place)[place] - 1e-9
    at = np.flatnonzero(rough >= floor)
    some = rows[at]
    norm = np.sqrt((some * some).sum(axis=1)) * np.sqrt((query * query).sum())
    score = (some * query).sum(axis=1) / norm
    order = np.lexsort((ids[at], -score))
    _, first = np.unique(ids[at][order], return_index=True)
    order = order[np.sort(first)][:k]
    return ids[at][order], score[order]


def _ranked(k: int):
    def run(group):
        v = group.column("v").to_pylist()
        ids, asks = group.column("vec_id").to_numpy(), group.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        x = np.stack([np.frombuffer(b) for b in v])
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        # rows that share an id may fill the k places of a block, so they are told apart first
        by_id = np.flatnonzero(~asks)[np.argsort(ids[~asks], kind="stable")]
        rows, row_ids, out = x[by_id], ids[by_id], []
        starts = np.flatnonzero(np.diff(row_ids, prepend=row_ids[:1] - 1))
        rough = unit[asks] @ unit[by_id].T
        for q, query_id in enumerate(ids[asks].tolist()):
            rough[q, np.searchsorted(row_ids, query_id) : np.searchsorted(row_ids, query_id, "right")] = -np.inf
            near, score = nearest(rows, row_ids, x[asks][q], rough[q], starts, k)
            out += [(query_id, i, s) for i, s in zip(near.tolist(), score.tolist())]
        columns = list(zip(*out)) or [[], [], []]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})

    return run


def _meet(data: DataFrame, queries: DataFrame, sizes: DataFrame, block: int, k: int) -> DataFrame:
    """Blocks of (t, b, d): rows cut by row salt and sent to each query salt, and the other way about."""
    cuts = sizes.select("t", "b", "d", F.ceil(F.col("n") / block).cast("int").alias("row_cuts"), F.ceil(F.col("q") / block).cast("int").alias("query_cuts"))
    cuts = F.broadcast(cuts) if sizes.count() <= FEW else cuts  # at most tables * buckets rows, and those with queries only
    all_of = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    salt = lambda c: F.pmod(F.xxhash64("vec_id"), F.col(c)).cast("int")
    keys = ["t", "b", "d"]
    x = data.join(cuts, keys).select(*keys, salt("row_cuts").alias("i"), all_of("query_cuts").alias("j"), "vec_id", "v", F.lit(False).alias("asks"))
    y = queries.join(cuts, keys).select(*keys, salt("query_cuts").alias("j"), all_of("row_cuts").alias("i"), "vec_id", "v", F.lit(True).alias("asks"))
    return x.unionByName(y).groupBy(*keys, "i", "j").applyInArrow(_ranked(k), "query_id long, vec_id long, score double")


def _sizes(data: DataFrame, queries: DataFrame) -> DataFrame:
    keys = ["t", "b", "d"]
    return data.groupBy(*keys).agg(F.count("*").alias("n")).join(queries.groupBy(*keys).agg(F.count("*").alias("q")), keys)


def plan(x: np.ndarray, k: int, tables: int, seed: int, target: float = 0.95, asked: int = 128) -> tuple[int, int]:
    """(hashes, probes) of the least work that finds ``target`` of the k nearest rows of the first ``asked`` rows of the sample ``x`` within it; the finest
    probing of single hashes where none does."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    score = unit[:asked] @ unit.T
    score[np.arange(len(score)), np.arange(len(score))] = -np.inf
    near = np.argsort(-score, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
    best, width = None, 2 << max(0, (x.shape[1] - 1).bit_length())
    for hashes, most in ((1, min(width, 64)), (2, 256), (3, 256)):
        held = buckets(x, tables, hashes, 1, seed)[:, :, 0]
        wanted = buckets(x[:asked], tables, hashes, most, seed)
        place = np.full((len(score), len(x)), most)  # the first probe of any table that meets the row
        for t in range(tables):
            code, of = wanted[:, t], held[:, t]
            names, at = np.unique(of, return_inverse=True)
            first = np.full((len(score), len(names)), most)
            to = np.minimum(np.searchsorted(names, code), len(names) - 1)
            row, probe = np.nonzero(names[to] == code)
            np.minimum.at(first, (row, to[row, probe]), probe)
            place = np.minimum(place, first[:, at])
        probes = 1
        while probes <= most:
            recall, share = (np.take_along_axis(place, near, 1) < probes).mean(), (place < probes).mean()
            if recall >= target and (best is None or share < best[0]):
                best = share, hashes, probes
            probes *= 2
    return best[1:] if best else (1, min(width, 64))


def sample_of(rows: DataFrame, most: int, seed: int) -> np.ndarray:
    """At most ``most`` valid vectors of the commonest length among the sampled rows, drawn by a hash of the id."""
    n = max(1, rows.count())
    drawn = F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1 << 20)) < F.lit(min(1.0, 1.2 * most / n) * (1 << 20))
    found = [v for v in vectors(rows.where(drawn).orderBy(F.xxhash64("vec_id", F.lit(seed))).limit(most).toArrow().column("embedding").combine_chunks()) if v is not None]
    widths = [len(v) for v in found]
    common = max(set(widths), key=widths.count, default=0)
    return np.array([v for v in found if len(v) == common])


def search(rows: DataFrame, is_query, k: int = 5, tables: int = 8, probes: int | None = None, hashes: int | None = None, block: int = 4096, seed: int = 7, sample: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of ``rows`` (vec_id, embedding) for each row where the
    column ``is_query`` holds.  ``probes`` and ``hashes`` are fitted on at most ``sample`` rows unless both are given."""
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    if probes is None or hashes is None:
        x = sample_of(rows, sample, seed)
        hashes, probes = plan(x, k, tables, seed) if len(x) > 1 else (1, 8)
    fields = "t int, b long, d int, vec_id long, v binary"
    asked = rows.where(is_query)
    data = rows.mapInArrow(_hashed(tables, hashes, 1, seed), fields)
    queries = asked.mapInArrow(_hashed(tables, hashes, probes, seed), fields).dropDuplicates(["t", "b", "vec_id", "v"])
    keys = ["t", "b", "d"]
    counted = stash(data.groupBy(*keys).agg(F.count("*").alias("n")).join(queries.groupBy(*keys).agg(F.count("*").alias("q")), keys))

    def top(found: DataFrame) -> DataFrame:
        best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    first = stash(top(_meet(data, queries, counted, block, k)))

    # queries that met fewer than k rows: all rows in blocks, whatever their buckets
    single = asked.mapInArrow(_hashed(1, 1, 1, seed), fields).drop("t", "b")
    full = first.groupBy("query_id").count().where(F.col("count") >= k).select(F.col("query_id").alias("vec_id"))
    short = stash(single.join(full, "vec_id", "left_anti").select(F.lit(0).alias("t"), F.lit(0).cast("long").alias("b"), "d", "vec_id", "v"))
    if not short.limit(1).count():
        return first
    every = rows.mapInArrow(_hashed(1, 1, 1, seed), fields).select(F.lit(0).alias("t"), F.lit(0).cast("long").alias("b"), "d", "vec_id", "v")
    rest = top(_meet(every, short, stash(_sizes(every, short)), block, k))
    return first.join(short.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(rest)
