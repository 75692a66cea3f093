"""Language identification by word-first backoff.

A word that some language's table knows is scored by its log frequency in each language.  A word that none
knows is scored by the mean over its character n-grams of the greatest length of which
any is known.  What a language lacks costs a penalty.  A text's score is the mean over its words.

The tables are learned from a bounded sample: about ``per_language`` documents of each language, picked
by a hash of doc_id, whatever the number of languages.  A word or n-gram enters a language's table if it was seen there at
least ``least`` times; rarer words are left to their n-grams, as unseen ones are.  Every text is then scored whole.

Defined results: null texts and texts without letters are ``und`` with score 0, and so is every text where
nothing could be learned, among them all texts where ``docs`` is empty or no row has a language.  Ties go to the language name that sorts
first.  Rows with a null doc_id may teach (they are drawn alike) and are predicted like any other; repeated rows are predicted each on its own.
Columns beyond those to keep and the text are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, steps, strings

WORD = re.compile(r"[^\W\d_]+")
LONGEST = 5
MEMORY = 150_000


def grams(word: str, n: int) -> list[str]:
    padded = f" {word} " if n > 1 else word
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def _counts(batches):
    for batch in batches:
        found: Counter = Counter()
        for step in steps(batch):
            words: dict[str, Counter] = {}
            for lang, text in zip(step.column("lang").to_pylist(), strings(step)):
                words.setdefault(lang, Counter()).update(WORD.findall(text.lower()))
            for lang, counter in words.items():
                for word, n in counter.items():
                    found[lang, 0, word] += n
                    for size in range(1, LONGEST + 1):
                        for g in grams(word, size):
                            found[lang, size, g] += n
        keys = list(found)
        columns = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.string()), pa.array(list(found.values()), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["lang", "size", "token", "n"])


class Model:
    """Tables of -log10 frequencies: token -> tuple over languages."""

    def __init__(self, languages: list[str], rows: list[tuple[str, int, str, int]]) -> None:
        self.languages = sorted(languages)
        at = {lang: i for i, lang in enumerate(self.languages)}
        totals: Counter = Counter()
        for lang, size, _, n in rows:
            totals[lang, size] += n
        self.penalty = 0.5 + max([math.log10(n) for n in totals.values()], default=0.0)
        self.tables: list[dict[str, list[float]]] = [{} for _ in range(LONGEST + 1)]
        for lang, size, token, n in rows:
            entry = self.tables[size].setdefault(token, [self.penalty] * len(self.languages))
            entry[at[lang]] = math.log10(totals[lang, size] / n)

    def word(self, word: str) -> list[float]:
        if (known := self.tables[0].get(word)) is not None:
            return known
        for size in range(min(LONGEST, len(word) + 2), 0, -1):
            table = self.tables[size]
            hits = [table[g] for g in grams(word, size) if g in table]
            if hits:
                return [sum(column) / len(hits) for column in zip(*hits)]
        return [self.penalty] * len(self.languages)


def learn(docs: DataFrame, per_language: int = 400, least: int = 2) -> Model:
    """From docs (doc_id, text, lang); rows without a language teach nothing."""
    docs = docs.where("lang is not null").select("doc_id", "text", "lang")
    shares = docs.groupBy("lang").count().collect()
    if not shares:
        return Model([], [])
    cut = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, per_language / r["count"])) for r in shares], "lang string, share double")
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("language")), F.lit(1 << 30)) / float(1 << 30)
    sample = docs.join(F.broadcast(cut), "lang").where(draw < F.col("share")).select("lang", "text")
    counted = sample.mapInArrow(_counts, "lang string, size int, token string, n long").groupBy("lang", "size", "token").agg(F.sum("n").alias("n"))
    kept = counted.where(F.col("n") >= least).select("lang", "size", "token", "n").toArrow()
    rows = list(zip(*(kept.column(c).to_pylist() for c in ("lang", "size", "token", "n"))))
    return Model([r["lang"] for r in shares], rows)


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``docs[keep]`` with lang_pred and score, from the text alone."""

    def make():
        width, names = len(model.languages), np.array(model.languages, object)
        memory: dict[str, int] = {}
        table = np.zeros((1024, width))

        def scored(text: str) -> tuple[str, float]:
            nonlocal table
            words = Counter(WORD.findall(text.lower()))
            if not width or not any(any(map(str.isalpha, w)) for w in words):
                return "und", 0.0
            for w in words:
                if w not in memory:
                    if len(memory) == len(table):
                        table = np.concatenate([table, np.zeros_like(table)])
                    table[len(memory)] = model.word(w)
                    memory[w] = len(memory)
            at = np.fromiter((memory[w] for w in words), np.int64, len(words))
            n = np.fromiter(words.values(), np.float64, len(words))
            cost = n @ table[at] / n.sum()
            best = int(cost.argmin())
            odds = np.exp(-(cost - cost[best]) * math.log(10) * min(20.0, n.sum()))
            return names[best], float(1 / odds.sum())

        def work(step: pa.RecordBatch) -> list[pa.Array]:
            if len(memory) > MEMORY:
                memory.clear()
            rows = [scored(t) for t in strings(step)]
            return [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64())]

        return work

    return map_rows(docs, make, "lang_pred string, score double", keep)
