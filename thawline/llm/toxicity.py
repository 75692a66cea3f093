"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier.

Voters are words and word pairs of a lexicon, a few patterns (shouting, exclamation marks, masked words), and word
beginnings that stand in toxic rows of the sample far more often than in its other rows, which covers languages the lexicon
does not know; every beginning that passes the thresholds votes.  Such a beginning must come from several texts that aren't copies of one
another.  The label model takes how many voters speak up, which ones do, and the given label as noisy signs of a
hidden class, and estimates all their rates by expectation maximisation at the prior that the given labels show.  Silence thus says as much
as the counts of votes in either class tell, and no more: most texts are in a language that most voters don't know.  What pairs of
voters share beyond the hidden class (their correlation within the classes) lowers the weight of which ones they are.  A
logistic regression on voters and hashed words is then trained on the model's posterior labels.

The fit uses at most ``max_rows`` labelled rows, taken in hash order of doc_id (a documented bound);
scores are given to every row and whole texts.  Training data of other rows never enters.

Defined results: null texts count as empty and get the score of a text without any feature.  Rows
without doc_id are scored and count as not held out.  Without labelled rows of both classes, as where ``docs`` or labels are empty, the
lexicon alone decides.  Repeated rows, and rows of one doc_id, are scored each on its own; a doc_id labelled twice counts as toxic if any of its
labels says so.  A score of exactly 0.5 is predicted 1.  Columns beyond those to keep and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, byte_hash, longs, map_rows, mix64, run_hash, steps, texts_of, tidy

# Insulting words and word pairs that vote for toxic.
WORDS = """idiot idiots idiotic moron morons moronic stupid scum pathetic loser losers disgusting trash garbage clown clowns
worthless dumb dumbass fool fools imbecile imbeciles jerk jerks retard retarded vermin filth filthy pig pigs bastard
bastards bitch bitches bullshit crap damn shit shitty fuck fucking fucked asshole assholes dick prick slut whore cunt
freak freaks ugly hate kill die degenerate lunatic psycho cretin dimwit halfwit nitwit parasite coward
idiote imbécile connard connasse salaud merde putain débile crétin abruti dégueulasse
arschloch scheisse scheiße dreck dummkopf trottel depp abschaum hurensohn wichser widerlich
estúpido estúpida idiota imbécil mierda puta cabrón gilipollas pendejo asqueroso basura escoria""".split()
PAIRS = ["shut up", "go die", "drop dead", "kill yourself", "you people", "hate you", "so stupid", "total idiot", "piece of", "fuck off", "screw you", "get lost"]
PATTERNS = ("shouting", "exclaiming", "masked")
SLOTS = 512
#: How often a given label is expected to say toxic in the hidden class 1 and in class 0, and with how many rows' weight, as a share of
#: the sample: the rates are estimated, but start from here, which holds the hidden class to what the labels mean.
TRUST, STRENGTH = (0.95, 0.03), 0.25
#: Turns in which the label's rates stay as expected, while the voters find theirs: else the hidden class could start out as the label itself.
SETTLED = 20
#: Numbers of votes that are told apart; more count as this many.
VOTES = 8
#: Beginnings that become voters: their lengths in bytes, the parts (of 16, by a sketch that copies share) of the toxic
#: rows that must hold one, and the least ratio of its rates in toxic and in other rows.
LENGTHS, PARTS, RATIO = range(4, 11), 5, 40.0


@dataclass
class Model:
    bias: float
    votes: np.ndarray
    words: np.ndarray
    learned: np.ndarray  # hashes of the beginnings that vote


class Letters(Words):
    """Runs of letters, A-Z folded; every byte from 128 up counts as a letter."""

    def __init__(self, column: pa.Array) -> None:
        raw, _ = texts_of(column)
        upper = (raw >= 65) & (raw <= 90)
        self.upper, self.original = upper, raw
        folded = raw + (upper * np.uint8(32))
        letter = ((folded >= 97) & (folded <= 122)) | (folded >= 128)
        offsets = texts_of(column)[1]
        clean = np.where(letter, folded, np.uint8(32))
        masked = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(clean))
        super().__init__(masked)


def beginnings(words: Words, less: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and length of the beginning of each of LENGTHS of each word that is long enough; the hash
    is that of the beginning without its last ``less`` bytes."""
    size, row = words.ends - words.starts, words.row()
    at = [np.flatnonzero(size >= n) for n in LENGTHS]
    length = np.repeat(np.array(LENGTHS), [len(a) for a in at])
    at = np.concatenate(at)
    starts = words.starts[at]
    return byte_hash(words.raw, starts, starts + length - less), row[at], length


def _hash_of(texts: list[str]) -> np.ndarray:
    """Hashes of single words, or of pairs of words."""
    words = Words(pa.array(texts, pa.large_string()))
    hashes, at = words.hashes(), words.first[:-1]
    return np.where(words.counts > 1, np.append(run_hash(hashes, 2), np.uint64(0))[at], hashes[at])


class Features:
    """Votes (rows x voters, 0 or 1) and word slots of a step."""

    def __init__(self, learned: np.ndarray) -> None:
        self.single, self.double, self.learned = _hash_of(WORDS), _hash_of(PAIRS), learned
        self.n_votes = len(WORDS) + len(PAIRS) + len(PATTERNS) + len(learned)

    @staticmethod
    def _mark(votes: np.ndarray, values: np.ndarray, row: np.ndarray, wanted: np.ndarray, shift: int) -> None:
        order = np.argsort(wanted)
        ranked = wanted[order]
        at = np.minimum(np.searchsorted(ranked, values), len(ranked) - 1)
        hit = ranked[at] == values
        votes[row[hit], order[at[hit]] + shift] = 1

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words = Letters(column)
        row, hashes = words.row(), words.hashes()
        votes = np.zeros((len(words.counts), self.n_votes), np.uint8)
        self._mark(votes, hashes, row, self.single, 0)
        at, of = words.windows(2)
        self._mark(votes, run_hash(hashes, 2)[at], of, self.double, len(WORDS))
        ends = words.offsets
        total = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[ends])
        low = (words.raw >= 97) & (words.raw <= 122)
        letters, upper = total(low), total(words.upper)
        marks, stars = total(words.original == 33), total(words.original == 42)
        base = len(WORDS) + len(PAIRS)
        votes[:, base] = (letters >= 20) & (2 * upper > letters)
        votes[:, base + 1] = 20 * marks > np.maximum(words.counts, 20)
        votes[:, base + 2] = 10 * stars > np.maximum(words.counts, 20)
        if len(self.learned):
            values, of, _ = beginnings(words)
            self._mark(votes, values, of, self.learned, base + len(PATTERNS))
        return votes, row, (hashes % np.uint64(SLOTS)).astype(np.int64)


def label_model(votes: np.ndarray, given: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Posterior probability of the hidden class 1 for each row, from voters and the given noisy labels.

    In each class a row draws its number of votes (up to VOTES), then the voters, each by its share of the class's votes, then its label.
    All of these are estimated with the class of the rows itself, in turns.
    """
    v, given = votes.astype(np.float64), given.astype(np.float64)
    said = v.sum(axis=1)
    count = np.minimum(said, VOTES).astype(np.int64)
    q = np.clip(given, 0.05, 0.95)
    prior = np.clip(given.mean(), 1e-3, 1 - 1e-3)
    trusted = STRENGTH * len(v)
    for turn in range(rounds):
        ones, zeros = q.sum(), (1 - q).sum()
        # how many votes
        many = [np.bincount(count, w, VOTES + 1) + 0.5 for w in (q, 1 - q)]
        many = np.log(many[0] / many[0].sum()) - np.log(many[1] / many[1].sum())
        # which voters, given that they vote
        hit, false = v.T @ q + 0.5, v.T @ (1 - q) + 0.5
        rate = (v.T @ q + 0.1) / (ones + 1.0), (v.T @ (1 - q) + 0.1) / (zeros + 1.0)
        rest = v - np.outer(q, rate[0]) - np.outer(1 - q, rate[1])
        scale = np.sqrt((rest * rest).mean(axis=0)) + 1e-3
        shared = np.clip((rest.T @ rest) / max(len(v), 1) / np.outer(scale, scale), 0, 1)
        np.fill_diagonal(shared, 0)
        weight = 1 / (1 + np.where(shared > 0.1, shared, 0).sum(axis=1))
        gain = weight * (np.log(hit / hit.sum()) - np.log(false / false.sum()))
        # the given label, which never abstains
        yes, no = TRUST if turn < SETTLED else ((given @ q + trusted * TRUST[0]) / (ones + trusted), (given @ (1 - q) + trusted * TRUST[1]) / (zeros + trusted))
        label = np.where(given > 0, np.log(yes / no), np.log((1 - yes) / (1 - no)))
        logit = np.log(prior / (1 - prior)) + many[count] + v @ gain + label
        new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        if turn > SETTLED and np.abs(new - q).max() < 1e-6:
            break
        q = new
    return q


def fit_linear(votes: np.ndarray, words: np.ndarray, target: np.ndarray, rounds: int = 25) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias and weights of an L2-regularised logistic regression by Newton steps, on soft labels."""
    x = np.column_stack([votes, words, np.ones(len(votes))]).astype(np.float64)
    ridge = np.concatenate([np.full(votes.shape[1], 0.05), np.full(words.shape[1], 20.0), [1e-6]])
    prior = float(np.clip(target.mean(), 1e-3, 1 - 1e-3))
    w = np.zeros(x.shape[1])
    w[-1] = np.log(prior / (1 - prior))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (target - p) - ridge * w
        bend = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(bend, slope)
        w = w + step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return float(w[-1]), w[: votes.shape[1]], w[votes.shape[1] : -1]


def split_of(doc_id) -> F.Column:
    """True where crc32(doc_id as text) mod 5 is 0; null ids are not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Beginnings of the words of each row, each once a row, with the row's part as a bit."""
    for batch in tidy(batches):
        for step in steps(batch):
            words = Letters(step.column("text"))
            hashes, row = words.hashes(), words.row()
            sketch = np.full(len(words.counts), np.iinfo(np.uint64).max)
            np.minimum.at(sketch, row, mix64(hashes))
            values, of, length = beginnings(words)
            parent = beginnings(words, less=1)[0]
            order = np.lexsort((of, values))
            new = np.ones(len(of), bool)
            new[1:] = (np.diff(of[order]) != 0) | (values[order][1:] != values[order][:-1])
            values, of, length, parent = (x[order[new]] for x in (values, of, length, parent))
            part = np.left_shift(1, (sketch[of] % np.uint64(16)).astype(np.int64))
            yield pa.RecordBatch.from_arrays([longs(values), longs(parent), pa.array(length, pa.int32()), longs(part)], ["h", "parent", "length", "part"])


def learn_beginnings(rows: DataFrame) -> np.ndarray:
    """Hashes of the beginnings that become voters, from the sampled rows (toxic, text)."""
    fields = "h long, parent long, length int, part long"
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return np.zeros(0, np.uint64)
    bad = rows.where("toxic = 1").select("text").mapInArrow(_counted, fields).groupBy("h", "parent", "length")
    bad = bad.agg(F.count("*").alias("n"), F.bit_count(F.bit_or("part")).alias("parts")).where(F.col("parts") >= PARTS)
    found = bad.select("h", "parent", "length", "n").toArrow().sort_by([("length", "ascending"), ("h", "ascending")])
    wanted = found.column("h").to_numpy().view(np.uint64)
    if not len(wanted):
        return wanted
    ranked = np.sort(wanted)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _counted(batches):
            h = batch.column("h").to_numpy().view(np.uint64)
            at = np.minimum(np.searchsorted(ranked, h), len(ranked) - 1)
            values, n = np.unique(h[ranked[at] == h], return_counts=True)
            yield pa.RecordBatch.from_arrays([longs(values), longs(n)], ["h", "n"])

    good = rows.where("toxic = 0").select("text").mapInArrow(held, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).toArrow()
    other = dict(zip(good.column("h").to_numpy().view(np.uint64).tolist(), good.column("n").to_pylist()))
    hits = found.column("n").to_numpy()
    misses = np.array([other.get(h, 0) for h in wanted.tolist()])
    ratio = (hits + 0.5) / (sizes[1] + 1) / ((misses + 0.5) / (sizes[0] + 1))
    # what the lexicon holds votes already, and a longer beginning must tell much more than the shorter ones
    best = dict.fromkeys(beginnings(Letters(pa.array(WORDS)))[0].tolist(), np.inf)
    kept = []
    for i, (h, parent) in enumerate(zip(wanted.tolist(), found.column("parent").to_numpy().view(np.uint64).tolist())):
        before = max(best.get(h, 0.0), best.get(parent, 0.0))
        if ratio[i] >= max(RATIO, 2 * before):
            kept.append(i)
            before = ratio[i]
        best[h] = before
    return wanted[sorted(kept, key=lambda i: -hits[i])]


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 6000) -> Model:
    """Learns from labelled rows of docs (doc_id, text) that aren't held out, at most ``max_rows`` of them."""
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    labels = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~split_of("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    taken = [(r.doc_id, r.toxic) for r in labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).collect()]
    chosen = docs.sparkSession.createDataFrame(taken, "doc_id long, toxic int")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")

    learned = learn_beginnings(rows)

    def make():
        features = Features(learned)

        def work(step: pa.RecordBatch) -> list[pa.Array]:
            votes, row, slot = features(step.column("text"))
            flat, counts = np.unique(row * SLOTS + slot, return_counts=True)
            first = np.searchsorted(flat // SLOTS, np.arange(len(votes) + 1))
            lists = [pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(x, pa.int32())) for x in (flat % SLOTS, counts)]
            return [pa.array([bytes(v) for v in votes], pa.binary()), *lists]

        return work

    got = map_rows(rows, make, "votes binary, slots array<int>, counts array<int>", ["doc_id", "toxic"]).toArrow()
    features = Features(learned)
    default = Model(-4.0, np.concatenate([np.full(len(WORDS) + len(PAIRS), 6.0), np.zeros(len(PATTERNS))]), np.zeros(SLOTS), np.zeros(0, np.uint64))
    given = got.column("toxic").to_numpy() if got.num_rows else np.zeros(0)
    if not 0 < given.sum() < len(given):
        return default
    order = np.argsort(got.column("doc_id").to_numpy(), kind="stable")
    votes = np.array([np.frombuffer(b, np.uint8) for b in got.column("votes").to_pylist()]).reshape(-1, features.n_votes)[order]
    words = np.zeros((len(votes), SLOTS), np.float32)
    for i, (s, c) in enumerate(zip(got.column("slots").combine_chunks(), got.column("counts").combine_chunks())):
        words[i, s.values.to_numpy()] = np.log1p(c.values.to_numpy())
    words = words[order]
    words /= np.maximum(np.sqrt((words * words).sum(axis=1, keepdims=True)), 1e-6)
    return Model(*fit_linear(votes, words, label_model(votes, given[order])), learned)


def score_texts(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``docs[keep]`` with score (0 to 1) and predicted (1 if score >= 0.5)."""

    def make():
        features = Features(model.learned)

        def work(step: pa.RecordBatch) -> list[pa.Array]:
            votes, row, slot = features(step.column("text"))
            flat, counts = np.unique(row * SLOTS + slot, return_counts=True)
            of, value = flat // SLOTS, np.log1p(counts)
            norm = np.sqrt(np.bincount(of, value * value, len(votes)))
            part = np.bincount(of, value * model.words[flat % SLOTS], len(votes)) / np.maximum(norm, 1e-6)
            logit = np.clip(votes @ model.votes + part + model.bias, -30, 30)
            score = 1 / (1 + np.exp(-logit))
            return [pa.array(score, pa.float64()), pa.array(score >= 0.5).cast(pa.int32())]

        return work

    return map_rows(docs, make, "score double, predicted int", keep)
