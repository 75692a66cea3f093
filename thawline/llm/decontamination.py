"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are normalised alike: lower case, every run of ASCII characters other than letters and
digits becomes one space.  An item of n characters may be found with up to
``budget = floor(rate * n)`` edits.  It is split into budget + 1 pieces; any match within the budget
holds one of them unchanged, so an Aho-Corasick automaton over all pieces finds every candidate place.
There Myers' bit-parallel algorithm gives the least edit distance of the item to
any stretch of the text around the place.

Items are read in blocks of bounded size (``block_chars``), each broadcast on its own, so the benchmark may grow.
Defined results: null and empty texts match nothing; an item without letters or digits is found
nowhere; items with the budget 0 must stand between word ends.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, strings

_FOLD = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


def normalise(text: str) -> str:
    return b" ".join(text.lower().encode().translate(_FOLD).split()).decode()


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece) of budget + 1 pieces whose lengths differ by at most one."""
    cuts = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(pattern: str, text: str, masks: dict[str, int] | None = None) -> tuple[int, int]:
    """Least edit distance of ``pattern`` to any stretch of ``text``, and the end of the first such stretch."""
    if masks is None:
        masks = peq(pattern)
    m = len(pattern)
    full, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for i, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | (~(xh | plus) & full)
        mh = plus & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = (ph << 1) & full  # a match may start anywhere
        mh = (mh << 1) & full
        plus = mh | (~(xv | ph) & full)
        minus = ph & xv
        if score < best:
            best, end = score, i + 1
    return best, end


def peq(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


class Matcher:
    def __init__(self, items: list[tuple[int, str]], rate: float) -> None:
        import ahocorasick

        self.items, self.automaton, self.masks = [], ahocorasick.Automaton(), {}
        where: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            text = normalise(text)
            if not text:
                continue
            budget = int(rate * len(text))
            self.items.append((item_id, text, budget))
            if budget:
                for offset, piece in pieces(text, budget):
                    where.setdefault(piece, []).append((len(self.items) - 1, offset))
            else:
                where.setdefault(f" {text} ", []).append((len(self.items) - 1, -1))
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        if where:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(item id, least distance, end in the normalised text), by item id."""
        if not self.items:
            return []
        text = f" {normalise(text)} "
        found: dict[int, tuple[int, int]] = {}
        seen: set[tuple[int, int]] = set()
        for end, (size, places) in self.automaton.iter(text):
            for k, offset in places:
                item_id, item, budget = self.items[k]
                start = end - size + 1 - offset
                if (k, start) in seen or found.get(k, (1, 0))[0] == 0:
                    continue
                seen.add((k, start))
                if text.startswith(item, start) if start >= 0 else False:
                    found[k] = (0, start + len(item) - 1)
                    continue
                a = max(0, start - budget)
                if k not in self.masks:
                    self.masks[k] = peq(item)
                distance, stop = myers(item, text[a : start + len(item) + budget], self.masks[k])
                if distance <= budget and (k not in found or distance < found[k][0]):
                    found[k] = (distance, a + stop - 1)
        return sorted((self.items[k][0], d, e) for k, (d, e) in found.items())


def find_items(docs: DataFrame, items: DataFrame, keep: list[str], rate: float = 0.05, block_chars: int = 8_000_000) -> DataFrame:
    """``docs[keep]`` with ``hits``: item_id, distance and end (in the normalised text) of each item
    (item_id, text) that a text of ``docs`` holds within its edit budget."""
    if not 0 <= rate < 0.5:
        raise ValueError("rate must be in [0, 0.5)")
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).where("item_id is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = 1 + total // block_chars
    entry = "array<struct<item_id:long,distance:long,end:long>>"
    out, names = docs.select(*dict.fromkeys([*keep, "text"])), list(keep)
    for b in range(blocks):
        block = sorted((r.item_id, r.text) for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect())

        def make(block=block):
            matcher = Matcher(block, rate)

            def work(step: pa.RecordBatch) -> list[pa.Array]:
                rows = [[{"item_id": i, "distance": d, "end": e} for i, d, e in matcher.find(t)] for t in strings(step)]
                return [pa.array(rows, pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int64()), ("end", pa.int64())])))]

            return work

        final = b == blocks - 1
        out = map_rows(out, make, f"hits_{b} {entry}", names if final else list(dict.fromkeys([*names, "text"])))
        names.append(f"hits_{b}")
    return out.select(*keep, F.concat(*(f"hits_{b}" for b in range(blocks))).alias("hits"))
