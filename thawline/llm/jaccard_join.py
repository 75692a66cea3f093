"""Exact n-gram Jaccard join: size-banded tiles, bitmap signatures, exact intersection.

1. Each text becomes the set of its distinct word shingles (64-bit hashes).  Texts with
   one and the same set are one *class* from here on (128-bit sums of the set, and its size).
2. Candidates come from prefixes.  In any one order of all shingles, two sets of similarity t or more share one of
   their first ``n - ceil(t * n) + 1``, n the set's own size.  The order here: shingles that stand in very many sets come
   last; before them hash ranges, and within a range the rarer ones first.  A set sends only the ranges that its prefix
   reaches into, about twice the prefix, and the sets that meet in a shingle give its frequency.  A shingle that one set
   alone has sent can't be shared, so prefixes of texts that are nobody's copy come out empty.  No link is lost, whatever
   the frequencies are.
3. Classes whose prefixes meet are grouped.  A group of a tile's size goes to one task.  In a larger one every
   class is first compared with a few leaders of its own and the neighbouring size bands; what they join into the group's
   greatest component needn't be compared among itself.  All else is cut into tiles by size band, since partners lie in
   the same or the next band.  A task compares one tile with another: sizes, then the bit counts of hashed
   bitmaps bound the overlap from above, then sorted arrays are intersected.  Pairs already joined within the task are skipped.

Defined results: texts without words, and null texts, have the empty set and link with nothing.  Rows with
a null doc_id are returned with a null component and link nothing.  doc_id names a row: identical repeated rows get
identical results.  Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, longs, mix64, run_hash, small_batches, stash, steps, tidy

#: Shingles that come last in the order: at most so many, each in at least SHARED distinct sets of a step.  They only
#: shape the candidates; any choice of them gives the same links.
COMMON, SHARED = 50_000, 3
#: Sets of one very common shingle that meet in one task.
SALTED = 2048
TILE = 1024
#: Shingles that a set may have on average in a full tile.
TILE_WORDS = 2048
#: Candidates are sent with their sets by a broadcast of their ids up to so many, by a shuffle of the texts beyond.
FEW = 500_000


class Bands:
    """Size bands for 'den * intersection >= num * union', in integers: sets that link lie in one band or in neighbouring ones."""

    def __init__(self, num: int, den: int) -> None:
        if not 0 < num <= den:
            raise ValueError("the threshold must be in (0, 1]")
        self.num, self.den = num, den
        starts = [1]
        while starts[-1] < 1 << 40:
            # sizes a <= b can only link if num * b <= den * a
            starts.append(max(starts[-1] + 1, starts[-1] * den // num + 1))
        self.starts = np.array(starts, np.int64)

    def band(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, sizes, side="right") - 1

    def prefix(self, sizes: np.ndarray) -> np.ndarray:
        """How many leading shingles of a set tell all its partners."""
        return sizes - -(-self.num * sizes // self.den) + 1

    def needed(self, total: np.ndarray) -> np.ndarray:
        """Least intersection of two sets whose sizes add up to ``total``."""
        return -(-self.num * total // (self.num + self.den))

    def ranges(self) -> np.ndarray:
        """Ends of the hash ranges as fractions: the first is twice a prefix, so most sets need no other."""
        gap = max((self.den - self.num) / self.den, 0.02)
        return np.append(np.arange(2 * gap, 1 - 1e-9, gap), 1.0)


def shingle_sets(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted within each row, and the first of each row (n_rows + 1 offsets)."""
    hashes = words.hashes()
    at, row = words.windows(n)
    values, rows = [run_hash(hashes, n)[at]], [row]
    for less in range(1, n):  # fewer words: the whole sequence is one shingle
        short = np.flatnonzero(words.counts == less)
        if len(short):
            values.append(run_hash(hashes, less)[words.first[:-1][short]])
            rows.append(short)
    values, row = np.concatenate(values), np.concatenate(rows)
    order = np.lexsort((values, row))
    values, row = values[order], row[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (values[1:] != values[:-1])
    values, row = values[new], row[new]
    return values, np.searchsorted(row, np.arange(len(words.counts) + 1))


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def _signatures(n: int, bands: Bands):
    """Per row: size of its set, the band of that, and two hashes of the whole set; with the first row of a
    step, the shingles that several of the step's distinct sets hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            for step in steps(batch):
                values, first = shingle_sets(Words(step.column("text"), fold=True), n)
                a, b = _sums(mix64(values), first), _sums(mix64(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)), first)
                n_set = np.diff(first)
                one = np.zeros(len(a), bool)
                one[np.unique(a, return_index=True)[1]] = True
                shared, times = np.unique(values[np.repeat(one, n_set)], return_counts=True)
                shared, times = shared[times >= SHARED], times[times >= SHARED]
                pairs = pa.StructArray.from_arrays([longs(shared), longs(times)], ["k", "m"])
                heavy = pa.ListArray.from_arrays(pa.array([0] + [len(shared)] * len(a), pa.int32()), pairs)
                yield pa.RecordBatch.from_arrays([step.column("doc_id"), longs(n_set), longs(bands.band(n_set)), longs(a), longs(b), heavy], ["doc_id", "n", "band", "a", "b", "heavy"])

    return run


def _keys(n: int, bands: Bands, common: np.ndarray, salts: np.ndarray):
    """(k, s, a, surplus): the shingles k that the class a sends, each class once a step.  Common ones have a salt s from 1 on.
    Where k lies in the last range that is sent, ``surplus`` is how many of that range's shingles lie beyond the prefix,
    elsewhere -1."""
    ends = bands.ranges()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            for step in steps(batch):
                values, first = shingle_sets(Words(step.column("text"), fold=True), n)
                a = _sums(mix64(values), first)
                picked = np.zeros(len(a), bool)
                picked[np.unique(a, return_index=True)[1]] = True
                sizes = np.where(picked, np.diff(first), 0)
                values = values[np.repeat(picked, np.diff(first))]
                row = np.repeat(np.arange(len(a)), sizes)
                at = np.minimum(np.searchsorted(common, values), max(len(common) - 1, 0))
                late = common[at] == values if len(common) else np.zeros(len(values), bool)
                part = (mix64(values ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(11)).astype(np.float64) / (1 << 53)
                place = np.searchsorted(ends, part, side="right") + len(ends) * late
                held = np.bincount(row * 2 * len(ends) + place, minlength=len(a) * 2 * len(ends)).reshape(len(a), -1).cumsum(axis=1)
                want = bands.prefix(sizes)
                last = (held >= want[:, None]).argmax(axis=1)
                surplus = held[np.arange(len(a)), last] - want
                sent = place <= last[row]
                row, place, at, late = row[sent], place[sent], at[sent], late[sent]
                salt = np.zeros(len(row), np.int64)
                if late.any():
                    salt[late] = 1 + (a[row[late]] % salts[at[late]]).astype(np.int64)
                beyond = np.where(place == last[row], surplus[row], -1)
                yield pa.RecordBatch.from_arrays([longs(values[sent]), pa.array(salt, pa.int32()), longs(a[row]), pa.array(beyond, pa.int32())], ["k", "s", "a", "surplus"])

    return run


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Input sorted by (k, s, a): the distinct rows of each shingle that several classes sent, with their number d; common
    shingles (s > 0) pass in any case, and count as most frequent.  A shingle's rows may span batches."""
    rest: tuple[np.ndarray, ...] | None = None

    def told(k: np.ndarray, s: np.ndarray, a: np.ndarray, surplus: np.ndarray) -> pa.RecordBatch:
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (s[1:] != s[:-1]) | (a[1:] != a[:-1])
        k, s, a, surplus = k[new], s[new], a[new], surplus[new]
        head = np.ones(len(k), bool)
        head[1:] = (k[1:] != k[:-1]) | (s[1:] != s[:-1])
        of = np.cumsum(head) - 1
        d = np.where(s > 0, 1 << 60, np.bincount(of)[of] if len(of) else 0)
        on = d > 1
        return pa.RecordBatch.from_arrays([pa.array(k[on]), pa.array(s[on]), pa.array(a[on]), pa.array(surplus[on]), longs(d[on])], ["k", "s", "a", "surplus", "d"])

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = tuple(batch.column(i).to_numpy() for i in range(4))
        if rest is not None:
            columns = tuple(np.concatenate(x) for x in zip(rest, columns))
        k, s = columns[:2]
        cut = int(np.flatnonzero((k != k[-1]) | (s != s[-1]))[-1]) + 1 if (k[0] != k[-1] or s[0] != s[-1]) else 0
        rest = tuple(c[cut:].copy() for c in columns)
        if cut:
            yield told(*(c[:cut] for c in columns))
    if rest is not None:
        yield told(*rest)


def _prefix_edges(sent: DataFrame) -> DataFrame:
    """(u, v): each class and the least class that meets it in a shingle of both prefixes, from what the classes sent."""
    met = sent.repartition("k", "s").sortWithinPartitions("k", "s", "a").mapInArrow(_met, "k long, s int, a long, surplus int, d long")
    # the most frequent shingles of the last range stand beyond the prefix; two classes of one 64-bit sum keep what either needs
    last = Window.partitionBy("a", F.col("surplus") >= 0)
    place = F.row_number().over(last.orderBy(F.desc("d"), F.desc("k")))
    kept = met.withColumns({"place": place, "least": F.min("surplus").over(last)}).where("surplus < 0 or place > least")
    kept = stash(kept.select("k", "s", "a"))
    first = kept.groupBy("k", "s").agg(F.min("a").alias("u"))
    stars = kept.join(first, ["k", "s"]).select("u", F.col("a").alias("v"))
    salted = first.where("s > 0")
    over = salted.join(salted.groupBy("k").agg(F.min("u").alias("top")), "k").select(F.col("top").alias("u"), F.col("u").alias("v"))
    return stars.unionByName(over).where("u <> v")


def components(edges: DataFrame) -> DataFrame:
    """(v, c): the least node that each node of the edges (u, v) reaches.  Each round hooks nodes to
    the least neighbour's label and halves the paths, so rounds grow with the logarithm of the
    diameter, and go on until no label changes; each is a written table, so nothing is recomputed after a loss.  Joins on a
    node of very many edges are cut by adaptive execution."""
    edges = stash(edges.where("u <> v").select("u", "v").distinct())
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    label = stash(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("c")))
    while True:
        near = both.join(label, "v").groupBy("u").agg(F.min("c").alias("m"))
        hooked = label.join(near.withColumnRenamed("u", "v"), "v").select("v", "c", F.least("c", "m").alias("m"))
        # the old root learns the new label too, then every node follows its label's label
        roots = hooked.groupBy("c").agg(F.min("m").alias("rm")).select(F.col("c").alias("v"), "rm")
        after = hooked.join(roots, "v", "left").select("v", F.col("c").alias("was"), F.least("m", F.coalesce("rm", "m")).alias("c"))
        hop = after.select(F.col("v").alias("c"), F.col("c").alias("next"))
        after = stash(after.join(hop, "c", "left").select("v", "was", F.coalesce("next", "c").alias("c")))
        label = after.select("v", "c")
        if not after.where("was <> c").limit(1).count():
            return label


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            for step in steps(batch):
                values, first = shingle_sets(Words(step.column("text"), fold=True), n)
                sets = pa.ListArray.from_arrays(pa.array(first, pa.int32()), longs(values))
                yield pa.RecordBatch.from_arrays([step.column("rep"), longs(np.diff(first)), sets], ["rep", "n", "s"])

    return run


def _bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    bits = 64 << max(2, min(10, math.ceil(math.log2(max(len(s) for s in sets) / 32 + 1))))
    out = np.zeros((len(sets), bits // 8), np.uint8)
    for i, s in enumerate(sets):
        at = (s % np.uint64(bits)).astype(np.int64)
        flags = np.zeros(bits, bool)
        flags[at] = True
        out[i] = np.packbits(flags)
    return out.view(np.uint64)


def _find(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def _overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays of distinct values."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())


def tile_links(reps: np.ndarray, sets: list[np.ndarray], left: np.ndarray, bands: Bands) -> list[tuple[int, int]]:
    """Links that join what is linked between the rows marked ``left`` and the others, or within all if
    every row is marked: a spanning set of links, each one verified exactly."""
    order = np.argsort([len(s) for s in sets], kind="stable")
    sets, reps, left = [sets[i] for i in order], reps[order], left[order]
    sizes = np.array([len(s) for s in sets], np.int64)
    maps, alone = _bitmaps(sets), bool(left.all())
    parent, links = list(range(len(sets))), []
    root = np.arange(len(sets))
    for i in range(len(sets)):
        stop = int(np.searchsorted(sizes, sizes[i] * bands.den // bands.num, side="right"))
        others = np.arange(i + 1, stop)
        if not alone:
            others = others[left[others] != left[i]]
        others = others[root[others] != root[i]]
        if not len(others):
            continue
        total = sizes[i] + sizes[others]
        differing = np.bitwise_count(maps[others] ^ maps[i]).sum(axis=1, dtype=np.int64)
        need = bands.needed(total)
        for j, least in zip(others[(total - differing) // 2 >= need].tolist(), need[(total - differing) // 2 >= need].tolist()):
            if _find(parent, i) != _find(parent, j) and _overlap(sets[i], sets[j]) >= least:
                a, b = _find(parent, i), _find(parent, j)
                parent[max(a, b)] = min(a, b)
                root[root == root[j]] = root[i]
                links.append((int(reps[i]), int(reps[j])))
    return links


def _tiles(num: int, den: int):
    def run(key, group):
        reps = group.column("rep").to_numpy()
        sets = [np.asarray(s, np.int64).view(np.uint64) for s in (x.values.to_numpy() for x in group.column("s"))]
        left = group.column("tile").to_numpy() == group.column("i").to_numpy()
        links = tile_links(reps, sets, left, Bands(num, den))
        return pa.table({"u": pa.array([a for a, _ in links], pa.int64()), "v": pa.array([b for _, b in links], pa.int64())})

    return run


def _compared(work: DataFrame, docs: DataFrame, n: int, bands: Bands) -> DataFrame:
    """(u, v): verified links of the tile pairs in work (g, i, j, tile, rep)."""
    wanted = work.select("rep").distinct()
    wanted = F.broadcast(wanted) if wanted.count() <= FEW else wanted
    sets = docs.join(wanted, docs.doc_id == wanted.rep).select("rep", "text").mapInArrow(_sets(n), "rep long, n long, s array<long>")
    return work.join(sets, "rep").select("g", "i", "j", "tile", "rep", "s").groupBy("g", "i", "j").applyInArrow(_tiles(bands.num, bands.den), "u long, v long")


def _led(large: DataFrame, tile: int) -> DataFrame:
    """Work for large groups: all classes, cut into tiles, against two leaders of their own band and of its neighbours."""
    drawn = F.struct(F.xxhash64("rep").alias("x"), F.col("rep").alias("rep"))
    ends = large.groupBy("g", "band").agg(F.min(drawn).alias("a"), F.max(drawn).alias("z"))
    leaders = ends.select("g", "band", F.explode(F.array_distinct(F.array("a.rep", "z.rep"))).alias("rep"))
    cut = large.groupBy("g", "band").agg(F.ceil(F.count("*") / tile).alias("cuts"))
    at = lambda band, part: band * F.lit(1 << 40) + part + 1  # noqa: E731  tile 0 holds the leaders
    members = large.join(cut, ["g", "band"]).select("g", "rep", at(F.col("band"), F.pmod(F.xxhash64("rep", F.lit(1)), "cuts")).alias("i"))
    members = members.select("g", "rep", "i", F.lit(0).cast("long").alias("j"), F.col("i").alias("tile"))
    near = leaders.select("g", "rep", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"))
    near = near.join(cut, ["g", "band"]).select("g", "rep", "band", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)).alias("part"))
    near = near.select("g", "rep", at(F.col("band"), F.col("part")).alias("i"))
    return members.unionByName(near.select("g", "rep", "i", F.lit(0).cast("long").alias("j"), F.lit(0).cast("long").alias("tile")))


def _tiled(large: DataFrame, weight) -> DataFrame:
    """Work for large groups: all pairs of tiles of one band or of neighbouring ones, but for pairs within ``closed``."""
    cut = large.groupBy("g", "band", "closed").agg(F.ceil(weight).alias("cuts"))
    tile_id = lambda band, closed, at: band * F.lit(1 << 40) + closed.cast("long") * F.lit(1 << 39) + at
    placed = large.join(cut, ["g", "band", "closed"]).select("g", "rep", tile_id(F.col("band"), F.col("closed"), F.pmod(F.xxhash64("rep"), "cuts")).alias("tile"))
    edge = cut.select("g", "band", "closed", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)).alias("at"))
    edge = edge.select("g", "band", "closed", tile_id(F.col("band"), F.col("closed"), F.col("at")).alias("tile"))
    x, y = edge.withColumnsRenamed({"tile": "i", "closed": "closed_i"}), edge.withColumnsRenamed({"band": "over", "tile": "j"})
    y = y.withColumn("band", F.explode(F.array("over", F.col("over") - 1)))
    pairs = x.join(y, ["g", "band"]).where("(over > band or i <= j) and not (closed and closed_i)").select("g", "i", "j")
    tiled = pairs.select("g", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("tile"))
    return placed.join(tiled, ["g", "tile"]).select("g", "rep", "i", "j", "tile")


def jaccard_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, tile: int = TILE) -> DataFrame:
    """doc_id, n_shingles, component_id per row of ``docs`` (doc_id, text): two documents link when
    den * |intersection| >= num * |union| of their n-word shingle sets; a component is the
    least doc_id reachable by links."""
    docs = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bands = Bands(num, den)
    every = stash(docs.mapInArrow(_signatures(n, bands), "doc_id long, n long, band long, a long, b long, heavy array<struct<k:long,m:long>>"))
    common = every.select(F.inline("heavy")).groupBy("k").agg(F.sum("m").alias("m")).orderBy(F.desc("m"), "k").limit(COMMON).collect()
    common = sorted((r.k % (1 << 64), 1 + r.m // SALTED) for r in common)
    names, salts = (np.array(x, np.uint64) for x in (zip(*common) if common else ((), ())))
    every = every.drop("heavy")
    classes = every.where("n > 0 and doc_id is not null").groupBy("a", "b", "n", "band").agg(F.min("doc_id").alias("rep"))

    sent = docs.where("doc_id is not null").mapInArrow(_keys(n, bands, names, salts), "k long, s int, a long, surplus int")
    near = components(_prefix_edges(sent)).withColumnsRenamed({"v": "a", "c": "g"})

    # candidate groups of a tile's size go to one task; larger ones are led, then cut by size band, and bands into tiles
    member = stash(classes.join(near, "a").select("g", "rep", "n", "band"))
    weight = (F.count("*") / tile + F.sum("n") / (tile * TILE_WORDS)).alias("weight")
    sized = stash(member.join(member.groupBy("g").agg(weight), "g"))
    zero = lambda c: F.lit(0).cast("long").alias(c)
    work = sized.where("weight <= 1").select("g", "rep", zero("i"), zero("j"), zero("tile"))
    large, links = sized.where("weight > 1").select("g", "rep", "n", "band"), None
    if large.limit(1).count():
        links = stash(_compared(stash(_led(large, tile)), docs, n, bands))
        joined = components(links).withColumnsRenamed({"v": "rep"})
        parted = large.join(joined, "rep", "left")
        most = parted.where("c is not null").groupBy("g", "c").agg(F.count("*").alias("m")).groupBy("g").agg(F.max_by("c", "m").alias("most"))
        parted = parted.join(most, "g", "left").select("g", "rep", "n", "band", F.coalesce(F.col("c") == F.col("most"), F.lit(False)).alias("closed"))
        work = work.unionByName(_tiled(stash(parted), weight))
    found = _compared(stash(work), docs, n, bands)
    joined = components(found if links is None else found.unionByName(links)).withColumnsRenamed({"v": "rep", "c": "component"})

    final = classes.join(joined, "rep", "left").select("a", "b", "n", F.coalesce("component", "rep").alias("component_id"))
    copies = every.join(final, ["a", "b", "n"], "left")
    alone = F.when(F.col("n") > 0, F.col("component_id"))
    return copies.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce(alone, "doc_id")).alias("component_id"))
