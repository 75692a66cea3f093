"""Substring dedup by level-wise doubling.

A window of ``window`` words is removed from a document when the same word sequence
also starts in a document with a smaller doc_id.  The levels are run lengths, each at most twice the one before, from
``base`` words up to the window (25 and 50 by default).  A level below the last looks at one run for each full window
only (the one with the least hash, which two equal windows pick alike); only windows whose run repeats in another
document are extended to the next length, until the window is reached or none survives.  Longer repeats are unions of
windows, so no length beyond the window can remove more.

All levels aggregate before they shuffle, and each document learns only which hashes it
is alone with, or *owns* (is the first to hold), so a passage shared by a third of all rows costs one row a
task and never gathers its holders in one place.  Runs below the window are told apart by 64 bits, where a false match only
lets a window through to the next level; whole windows by 128, so with n windows compared, a given one
meets a false partner with probability n / 2**128.

Defined results: null or empty text: no words, nothing removed.  Null doc_id: neither source
nor target of a removal.  Rows with equal doc_id don't remove each other.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, longs, run_hash, small_batches, stash, steps, tidy


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of values[i:i+width] for each i, by doubling."""
    done = 1
    while 2 * done <= width:
        values = np.minimum(values[: len(values) - done], values[done:])
        done *= 2
    if done < width:
        values = np.minimum(values[: len(values) - (width - done)], values[width - done :])
    return values


def levels(window: int, base: int) -> list[int]:
    """Run lengths, the last one the window: each at most twice the one before, the first at least ``base`` where the window allows it."""
    out = [window]
    while out[0] > max(base, 1) and (out[0] + 1) // 2 >= base:
        out.insert(0, (out[0] + 1) // 2)
    return out


def _anchored(words: Words, hashes: np.ndarray, window: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the full windows, their rows, and for each the least hash of its runs of ``length`` words."""
    at, row = words.windows(window)
    if not len(at):
        return at, row, np.zeros(0, np.uint64)
    return at, row, _least(run_hash(hashes, length), window - length + 1)[at]


def _changes(row: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (anchor[1:] != anchor[:-1])
    return new


def _salted(values: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Makes hashes of different rows of a step comparable in one go."""
    return values ^ (row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of an array<long> column and the row of each; a null list is empty."""
    lengths = pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    return values, np.repeat(np.arange(len(column)), lengths)


def _within(values: np.ndarray, row: np.ndarray, column: pa.Array) -> np.ndarray:
    listed, of = _lists(column)
    return np.isin(_salted(values, row), _salted(listed, of)) if len(values) else np.zeros(0, bool)


def _surviving(words: Words, step: pa.RecordBatch, window: int, below: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and rows of the full windows whose run of every length ``below`` isn't this document's alone."""
    hashes = words.hashes()
    at, row = words.windows(window)
    keep = ~np.asarray(step.column("doc_id").is_null())[row]
    for length in below:
        anchor = _anchored(words, hashes, window, length)[2]
        new = _changes(row, anchor)
        single = _within(anchor[new], row[new], step.column(f"alone_{length}"))
        keep &= ~single[np.cumsum(new) - 1] if len(at) else keep
    return at[keep], row[keep]


def _whole(words: Words, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hashes of the windows that start at ``at``."""
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return run_hash(words.hashes(), window)[at], run_hash(words.hashes(1), window)[at]


def _anchors(window: int, length: int, below: list[int]):
    """(doc_id, h): anchors at ``length`` of the windows that survive the levels below."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            for step in steps(batch):
                words = Words(step.column("text"))
                at, row = _surviving(words, step, window, below)
                anchor = _least(run_hash(words.hashes(), length), window - length + 1)[at] if len(at) else np.zeros(0, np.uint64)
                new = _changes(row, anchor)
                ids = step.column("doc_id").take(pa.array(row[new]))
                yield pa.RecordBatch.from_arrays([ids, longs(anchor[new])], ["doc_id", "h"])

    return run


def _windows(window: int, below: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            for step in steps(batch):
                words = Words(step.column("text"))
                at, row = _surviving(words, step, window, below)
                h, i = _whole(words, at, window)
                ids = step.column("doc_id").take(pa.array(row))
                yield pa.RecordBatch.from_arrays([ids, longs(h), longs(i)], ["doc_id", "h", "i"])

    return run


def _removal(window: int, below: list[int], with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            for step in steps(batch):
                words = Words(step.column("text"))
                at, row = _surviving(words, step, window, below)
                h, i = _whole(words, at, window)
                hit = at[~(_within(h, row, step.column("owned_h")) & _within(i, row, step.column("owned_i")))]
                edge = np.zeros(len(words.starts) + 1, np.int64)
                np.add.at(edge, hit, 1)
                np.add.at(edge, hit + window, -1)
                gone = np.cumsum(edge)[:-1] > 0
                raw = words.raw.tobytes()
                starts, ends, gone_list = words.starts.tolist(), words.ends.tolist(), gone.tolist()
                texts, removed = [], []
                for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
                    texts.append(b" ".join([raw[starts[i] : ends[i]] for i in range(a, b) if not gone_list[i]]))
                    removed.append(sum(gone_list[a:b]))
                columns = {
                    "doc_id": step.column("doc_id"),
                    "n_words": longs(words.counts),
                    "n_removed": pa.array(removed, pa.int64()),
                    "kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
                }
                if with_text:
                    columns["kept_text"] = pa.array([t.decode() for t in texts], pa.string())
                yield pa.RecordBatch.from_pydict(columns)

    return run


def dedup_substrings(docs: DataFrame, window: int = 50, with_text: bool = True, base: int = 25) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): word counts, the digest of the kept words and,
    with ``with_text``, the kept words themselves joined by single spaces."""
    if window < 2 or base < 1:
        raise ValueError("window must be at least 2 words, base at least 1")
    docs = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    lengths = levels(window, base)
    below: list[int] = []
    for length in lengths[:-1]:
        named = docs.where(F.col("doc_id").isNotNull()).mapInArrow(_anchors(window, length, list(below)), "doc_id long, h long")
        firsts = named.groupBy("h").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z"))
        if len(lengths) > 2:
            firsts = stash(firsts)
        alone = firsts.where("a = z").groupBy(F.col("a").alias("doc_id")).agg(F.collect_list("h").alias(f"alone_{length}"))
        docs = docs.join(alone, "doc_id", "left")
        below.append(length)
        if len(lengths) > 2 and not firsts.where("a < z").limit(1).count():
            break  # no window survives: the last level finds none either
    owners = docs.mapInArrow(_windows(window, below), "doc_id long, h long, i long").groupBy("h", "i").agg(F.min("doc_id").alias("a"))
    owned = owners.groupBy(F.col("a").alias("doc_id")).agg(F.collect_list("h").alias("owned_h"), F.collect_list("i").alias("owned_i"))

    out = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")
    return docs.join(owned, "doc_id", "left").mapInArrow(_removal(window, below, with_text), out)
