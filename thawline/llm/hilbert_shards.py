"""Sharding along a Hilbert curve, with DataFrame functions only.

Metadata dimensions are quantised to ``bits`` bits each: the size on a logarithmic scale, the language, the source
and the doc_id.  Every quantisation keeps the order of the values - strings go by their first six bytes; a histogram of BUCKETS even steps
between the least and the greatest value tells how many rows stand before each step, and cells hold even counts as far as steps allow - so a cell is a range in every dimension.  The position of a row's cell on the Hilbert
curve orders the rows (ties by doc_id, then by the text's checksum and size), and runs of that order are cut into shards whose counts
differ by at most one (law ``rows``).  Neighbouring cells are near each other in every dimension, so the files of a shard have
narrow value ranges in all of them, and readers skip files by any (``pruned`` measures it).

The order is made by a range partitioning over slim rows that are written first, so a text is read once and no task sees
all rows: each partition numbers its own rows and adds the count of those before it.

Defined results: a null value has the cell 0 of its dimension and stands first; a null text has size 1 and checksum 0.  Repeated rows
each get a place.  Equal texts have one size and checksum, but the law is about rows: copies with other doc_ids, languages or sources
lie where their own cells do, so a group of copies of any size fills no shard.  Columns of ``docs`` beyond those named are ignored, or carried along
by ``keep``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash


#: Steps of the histograms that cells are cut by.
BUCKETS = 4096


def gray_tables(dims: int) -> tuple[list[int], list[int], list[int]]:
    """Per corner number w of a cell: its position in the inverse Gray order, and the entry corner and
    direction of the sub-curve there."""
    count = 1 << dims
    gray = [w ^ (w >> 1) for w in range(count)]
    rank = [gray.index(g) for g in range(count)]
    entry = [0 if w == 0 else gray[2 * ((w - 1) // 2)] for w in range(count)]
    ones = lambda w: ((w ^ (w + 1)).bit_length() - 1) % dims  # noqa: E731  trailing ones
    turn = [0 if w == 0 else ones(w) if w % 2 else ones(w - 1) for w in range(count)]
    return rank, entry, turn


def hilbert_index(cells: list[Column], bits: int) -> Column:
    """Position on the Hilbert curve of the cell with these coordinates (each 0 to 2**bits - 1)."""
    dims = len(cells)
    if not 1 <= dims * bits <= 62:
        raise ValueError("dims * bits must be 1 to 62")
    rank, entry, turn = (F.array(*(F.lit(x).cast("long") for x in t)) for t in gray_tables(dims))
    full = (1 << dims) - 1
    point = F.array(*(c.cast("long") for c in cells))

    def left(x: Column, by: Column) -> Column:  # rotation of dims bits
        shift = lambda f, n: F.call_function(f, x, n.cast("int"))
        return (shift("shiftleft", by % dims).bitwiseOR(shift("shiftright", (dims - by % dims)))).bitwiseAND(F.lit(full).cast("long"))

    def step(state: Column, level: Column) -> Column:
        bit = lambda i: F.call_function("shiftright", point[i], level.cast("int")).bitwiseAND(F.lit(1).cast("long"))
        corner = sum((bit(i) * F.lit(1 << i).cast("long") for i in range(1, dims)), bit(0))
        e, d = state["e"], state["d"]
        moved = left(corner.bitwiseXOR(e), F.lit(dims).cast("long") - (d + 1) % dims)
        w = rank[moved.cast("int")]
        return F.struct(
            (state["h"] * (1 << dims) + w).alias("h"),
            e.bitwiseXOR(left(entry[w.cast("int")], d + 1)).alias("e"),
            ((d + turn[w.cast("int")] + 1) % dims).alias("d"),
        )

    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("h"), zero.alias("e"), zero.alias("d"))
    return F.aggregate(F.array(*(F.lit(i) for i in range(bits - 1, -1, -1))), start, step, lambda s: s["h"])


def _leading(c: str) -> Column:
    """The first six bytes of a string as a number, in the order of the strings."""
    return F.conv(F.rpad(F.hex(F.substring(F.encode(F.col(c).cast("string"), "UTF-8"), 1, 6)), 12, "0"), 16, 10).cast("long")


def _magnitude(c: str, top: int) -> Column:
    """Eight steps to each doubling, from the leading bits of a positive number."""
    exponent = F.length(F.bin(c)) - 1
    return F.least(exponent * 8 + F.call_function("shiftright", F.col(c) * 8, exponent).bitwiseAND(F.lit(7).cast("long")), F.lit(top)).cast("long")


def shard_rows(docs: DataFrame, shards: int = 16, bits: int = 8, keep: list[str] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of ``docs`` (doc_id, text, lang, source); with ``keep`` also ``row``, those
    columns of it as a struct."""
    if shards < 1:
        raise ValueError("shards must be positive")
    cells, carried = 1 << bits, [F.struct(*keep).alias("row")] if keep else []
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = stash(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
            _leading("lang").alias("x_lang"), _leading("source").alias("x_source"), F.col("doc_id").cast("long").alias("x_doc"), *carried,
        )
    )
    ends = slim.agg(*(f(c).alias(f"{n}_{c}") for c in ("x_lang", "x_source", "x_doc") for n, f in (("lo", F.min), ("hi", F.max)))).first()

    celled = slim
    for c in ("x_lang", "x_source", "x_doc"):
        low, high = ends[f"lo_{c}"] or 0, ends[f"hi_{c}"] or 0
        celled = celled.withColumn(c, F.expr(f"({c} - {low}L) div {max(1, (high - low + BUCKETS) // BUCKETS)}L"))
    for c in ("x_lang", "x_source", "x_doc"):
        steps = celled.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n"))  # at most BUCKETS rows
        before = F.coalesce(F.sum("n").over(Window.orderBy(c).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        steps = steps.select(c, (before * cells).alias("before"), F.sum("n").over(Window.partitionBy(F.lit(0))).alias("all"))
        celled = celled.join(F.broadcast(steps.select(c, F.expr("before div all").alias(f"c_{c}"))), c, "left")
    cell = lambda c: F.coalesce(f"c_{c}", F.lit(0)).cast("long")

    at = hilbert_index([_magnitude("size", cells - 1), cell("x_lang"), cell("x_source"), cell("x_doc")], bits)
    order = ["h", "doc_id", "text_crc32", "size"]
    row = ["row"] if keep else []
    # the range partitioning samples its input first, so the curve's index is written before
    indexed = stash(celled.select("doc_id", "size", "text_crc32", at.alias("h"), *row))
    ranged = stash(indexed.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    counts = ranged.groupBy("part").agg(F.count("*").alias("n"))  # one row a partition
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    total = counts.agg(F.sum("n").alias("total"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    ranked = ranged.withColumn("at", inside).join(F.broadcast(before), "part").join(F.broadcast(total), F.lit(True))
    rank = (F.col("before") + F.col("at")).alias("rank")
    placed = ranked.select("doc_id", "size", "text_crc32", "total", rank, *row).withColumn("shard", F.expr(f"cast((rank * {shards}) div total as int)"))
    first = F.expr(f"(shard * total + {shards - 1}) div {shards}")
    slot, grown = (F.col("rank") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", slot, grown, *row)


def write_shards(docs: DataFrame, path: str, shards: int = 16, bits: int = 8) -> None:
    """One folder a shard under ``path``, the whole rows of ``docs`` in it in slot order; the rows travel with their places, so repeated rows and null
    ids are written as they are."""
    placed = shard_rows(docs, shards, bits, docs.columns)
    ordered = placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    folder = "shard" if "shard" not in docs.columns else "shard_folder"
    ordered.select(F.col("shard").alias(folder), "row.*").write.partitionBy(folder).option("compression", "zstd").parquet(path)


def pruned(placed: DataFrame, condition: str, columns: list[str]) -> DataFrame:
    """One row: shards, and those that a reader must open for the rows where ``condition`` holds, going by the ranges of the ``columns`` in each
    shard.  ``condition`` is about lo_<column> and hi_<column>, ``placed`` rows have shard and row."""
    ranges = placed.groupBy("shard").agg(*(f(f"row.{c}").alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))))
    return ranges.agg(F.count("*").alias("shards"), F.count_if(F.expr(condition)).alias("opened"))
