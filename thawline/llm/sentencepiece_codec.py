"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

Pieces and their kinds are read from a public ``.model`` file; nothing is trained.  A unigram
model's own log scores are used as they are.  A merge-based model stores merge ranks instead,
so piece number r there gets the Zipf log probability ``-ln(r + 1) - ln(H)``, H the harmonic number.

The text gets one leading space, spaces stand for the whitespace marker, and the best path over UTF-8 bytes
is found by dynamic programming.  A character that no piece covers is spelled in byte
pieces, at a score below every piece.  The literal marker character counts as such, so decoding gives
back any text exactly.  No piece crosses from a non-space to a space, so a text is cut there (checked when a
model is read; else texts are not cut), and equal segments are encoded once.  Among paths of
equal score the one whose last piece is longest is taken, from the end backwards.

Defined results: null and empty texts have no pieces.
"""

from __future__ import annotations

import itertools
import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_rows, strings

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARKER = "▁"
#: Segments that a task remembers before it starts anew.
MEMORY = 150_000


@dataclass
class Vocabulary:
    pieces: list[bytes]  # by id; the marker is a space here
    scores: np.ndarray
    byte_ids: np.ndarray  # id of each byte's piece
    base: np.ndarray
    check: np.ndarray
    leaf: np.ndarray  # id of the piece that ends in a state, or -1
    longest: int
    cuts: bool


def merges(path: str) -> bool:
    """Whether the file says of itself that it is a merge-based model: its trainer settings have the type 2 (1, a unigram model, where nothing
    is said)."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    return model.trainer_spec.model_type == proto.TrainerSpec.BPE


def read_model(path: str = MODEL) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    byte_ids = np.full(256, -1, np.int32)
    pieces, normal = [], []
    for i in range(size):
        name = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(name[3:5], 16)] = i
            pieces.append(bytes([int(name[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            pieces.append(b"")
        else:
            pieces.append(name.replace(MARKER, " ").encode())
            normal.append(i)
    if (byte_ids < 0).any():
        raise ValueError("the model has no byte pieces")
    own = np.array([model.get_score(i) for i in normal], np.float64)
    if merges(path):
        order = np.empty(len(own))
        order[np.argsort(-own, kind="stable")] = np.arange(len(own))
        own = -np.log(order + 1) - math.log((1 / np.arange(1, len(own) + 1)).sum())
    return build({pieces[i]: (i, s) for i, s in zip(normal, own)}, byte_ids, pieces)


def build(scored: dict[bytes, tuple[int, float]], byte_ids: np.ndarray, pieces: list[bytes]) -> Vocabulary:
    """``scored``: piece -> (id, log score)."""
    scores = np.full(len(pieces), -np.inf)
    for i, s in scored.values():
        scores[i] = s
    base, check, leaf = double_array({p: i for p, (i, _) in scored.items()})
    cuts = not any(re.search(rb"[^ ] ", p) for p in scored)
    return Vocabulary(pieces, scores, byte_ids, base, check, leaf, max(map(len, scored)), cuts)


def double_array(words: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check and leaf of a trie: state s goes on byte c to t = base[s] + c + 1 if check[t] == s."""
    keys = sorted(words)
    size = 1 << 16
    base, check, leaf = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    taken = bytearray(size)
    taken[0] = 1
    first_free, todo = 1, [(0, 0, len(keys), 0)]
    while todo:
        state, lo, hi, depth = todo.pop()
        if len(keys[lo]) == depth:
            leaf[state] = words[keys[lo]]
            lo += 1
        children, i = [], lo
        while i < hi:  # keys are sorted: each child is a run
            c, j = keys[i][depth], i
            while j < hi and keys[j][depth] == c:
                j += 1
            children.append((c, i, j))
            i = j
        if not children:
            continue
        at = first_free = taken.find(0, first_free)
        while True:
            offset = at - children[0][0] - 1
            if offset >= 0:
                if offset + 258 > len(taken):
                    more = len(taken)
                    taken.extend(bytes(more))
                    base, check, leaf = (np.concatenate([a, np.full(more, v, np.int32)]) for a, v in ((base, 0), (check, -1), (leaf, -1)))
                if not any(taken[offset + c + 1] for c, _, _ in children):
                    break
            at = taken.find(0, at + 1)
            if at < 0:
                at = len(taken)
                taken.extend(bytes(at))
                base, check, leaf = (np.concatenate([a, np.full(at, v, np.int32)]) for a, v in ((base, 0), (check, -1), (leaf, -1)))
        base[state] = offset
        for c, i, j in children:
            taken[offset + c + 1] = 1
            check[offset + c + 1] = state
            todo.append((offset + c + 1, i, j, depth + 1))
    return base, check, leaf


def viterbi(vocabulary: Vocabulary, segments: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    """The best piece ids of every segment, and the scores."""
    flat, first, size, scores = paths(vocabulary, segments)
    return [flat[a : a + n] for a, n in zip(first.tolist(), size.tolist())], scores


def paths(vocabulary: Vocabulary, segments: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Piece ids of all segments in one array, and where in it each one's path starts, how long it is, and its score; all segments advance
    together."""
    v = vocabulary
    lengths = np.array([len(s) for s in segments], np.int64)
    flat, done = [np.zeros(0, np.int32)], 0
    first, size, scores = np.zeros(len(segments), np.int64), np.zeros(len(segments), np.int64), np.zeros(len(segments))
    order = np.argsort(lengths, kind="stable")
    at = int(np.searchsorted(lengths[order], 1))
    while at < len(order):  # segments of up to twice the shortest's length at once
        stop = int(np.searchsorted(lengths[order], 2 * lengths[order[at]] + 8, side="right"))
        stop = min(stop, at + 200_000)
        group = order[at:stop]
        got, cuts, score = _viterbi(v, [segments[i] for i in group.tolist()])
        flat.append(got)
        first[group], size[group], scores[group] = done + cuts[:-1], np.diff(cuts), score
        done += len(got)
        at = stop
    return np.concatenate(flat), first, size, scores


def _viterbi(v: Vocabulary, segments: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ids, the first of each segment (n + 1 offsets), and the scores."""
    lengths = np.array([len(s) for s in segments], np.int64)
    node0 = np.concatenate([[0], np.cumsum(lengths + 1)])  # one node before each byte and one at the end
    raw = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8).astype(np.int64)
    place = np.arange(len(raw)) - np.repeat(node0[:-1], lengths + 1)  # in the segment
    room = np.repeat(lengths, lengths + 1) - place
    begins = np.flatnonzero((room > 0) & ((raw & 0xC0) != 0x80))  # characters
    state, live = np.zeros(len(begins), np.int64), begins
    begin_all, end_all, id_all = [], [], []
    covered = np.zeros(len(raw), bool)
    lead = raw[begins]
    width = np.zeros(len(raw), np.int64)
    width[begins] = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
    for depth in range(v.longest):
        target = v.base[state] + raw[live + depth] + 1
        ok = (v.check[np.minimum(target, len(v.check) - 1)] == state) & (target < len(v.check))
        state, live = target[ok].astype(np.int64), live[ok]
        if not len(live):
            break
        piece = v.leaf[state]
        hit = piece >= 0
        begin_all.append(live[hit])
        end_all.append(live[hit] + depth + 1)
        id_all.append(piece[hit])
        whole = live[hit]
        covered[whole[width[whole] == depth + 1]] = True
        more = room[live] > depth + 1
        state, live = state[more], live[more]
    spelled = begins[~covered[begins]]
    begin_all.append(spelled)
    end_all.append(spelled + width[spelled])
    id_all.append(np.full(len(spelled), -1, np.int32))
    begin, end, piece = np.concatenate(begin_all), np.concatenate(end_all), np.concatenate(id_all)
    below = v.scores[np.isfinite(v.scores)].min() - 10.0
    gain = np.where(piece >= 0, v.scores[piece], below)

    order = np.lexsort((begin, end, place[end]))
    begin, end, piece, gain = begin[order], end[order], piece[order], gain[order]
    best = np.full(len(raw), -np.inf)
    best[node0[:-1]] = 0.0
    back = np.full(len(raw), -1, np.int64)
    edges = np.concatenate([[0], np.flatnonzero(np.diff(place[end])) + 1, [len(end)]]) if len(end) else np.array([0])
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        score = best[begin[a:b]] + gain[a:b]
        heads = np.concatenate([[0], np.flatnonzero(np.diff(end[a:b])) + 1])
        top = np.maximum.reduceat(score, heads)
        of = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, b - a)))
        first = np.full(len(heads), b - a)
        win = np.flatnonzero(score == top[of])
        np.minimum.at(first, of[win], win)
        nodes = end[a:b][heads]
        best[nodes] = top
        back[nodes] = first + a

    last = node0[1:] - 1
    pos, who, trail_piece, trail_who, trail_begin = last.copy(), np.arange(len(segments)), [], [], []
    while len(pos):
        edge = back[pos]
        trail_piece.append(piece[edge])
        trail_who.append(who)
        trail_begin.append(begin[edge])
        pos = begin[edge]
        on = pos > node0[who]
        pos, who = pos[on], who[on]
    got, of, start = np.concatenate(trail_piece), np.concatenate(trail_who), np.concatenate(trail_begin)
    order = np.lexsort((start, of))
    got, of, start = got[order], of[order], start[order]
    if (got < 0).any():  # spell out
        times = np.where(got < 0, width[start], 1)
        step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        start, got, of = np.repeat(start, times) + step, np.repeat(got, times), np.repeat(of, times)
        got = np.where(got < 0, v.byte_ids[raw[start]], got)
    return got.astype(np.int32), np.searchsorted(of, np.arange(len(segments) + 1)), best[last]


class Codec:
    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.cut = re.compile(r" +[^ ]*|[^ ]+")
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.first, self.size, self.scores = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids, the first of each text (n + 1 offsets), and the log score of each text."""
        if len(self.known) > MEMORY:
            self.forget()
        cut, known = self.cut.findall, self.known
        parts = [(cut(" " + t) if self.v.cuts else [" " + t]) if t else [] for t in texts]
        new = list(set(itertools.chain.from_iterable(parts)).difference(known))
        if new:
            flat, first, size, scores = paths(self.v, [s.encode("utf-8") for s in new])
            known.update(zip(new, range(len(known), len(known) + len(new))))
            self.first = np.concatenate([self.first, first + len(self.flat)])
            self.flat, self.size, self.scores = (np.concatenate(x) for x in ((self.flat, flat), (self.size, size), (self.scores, scores)))
        which = np.fromiter(itertools.chain.from_iterable(map(known.__getitem__, p) for p in parts), np.int64)
        sizes = self.size[which]
        total = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.flat[np.repeat(self.first[which] - total[:-1], sizes) + np.arange(total[-1])]
        ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        score = np.concatenate([[0.0], np.cumsum(self.scores[which])])
        return ids, total[ends], score[ends[1:]] - score[ends[:-1]]

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self.v.pieces.__getitem__, ids.tolist()))
        return raw[1:].decode("utf-8", "replace")  # without the leading space


def encode_texts(docs: DataFrame, keep: list[str], model: str = MODEL) -> DataFrame:
    """``docs[keep]`` with ids (piece ids), n_pieces, n_spelled (byte pieces among them), log_score and
    round_trip (whether decoding the ids gave the text back)."""
    vocabulary = read_model(model)  # bounded by the file; shipped to the tasks

    def make():
        codec = Codec(vocabulary)
        spelled = np.zeros(len(vocabulary.pieces), bool)
        spelled[vocabulary.byte_ids] = True

        def work(step: pa.RecordBatch) -> list[pa.Array]:
            texts = strings(step)
            ids, first, score = codec.encode(texts)
            count = np.concatenate([[0], np.cumsum(spelled[ids])])
            same = [codec.decode(ids[a:b]) == t for t, a, b in zip(texts, first[:-1].tolist(), first[1:].tolist())]
            lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids, pa.int32()))
            return [lists, pa.array(np.diff(first), pa.int64()), pa.array(count[first[1:]] - count[first[:-1]], pa.int64()), pa.array(score, pa.float64()), pa.array(same, pa.bool_())]

        return work

    return map_rows(docs, make, "ids array<int>, n_pieces long, n_spelled long, log_score double, round_trip boolean", keep)


def decode_ids(encoded: DataFrame, keep: list[str], model: str = MODEL) -> DataFrame:
    """``encoded[keep]`` with ``text``, decoded from the column ``ids``; null ids give null."""
    from pyspark.sql import types as T

    vocabulary = read_model(model)
    schema = T.StructType([encoded.schema[c] for c in keep] + [T.StructField("text", T.StringType())])

    def run(batches):
        codec = Codec(vocabulary)
        for batch in batches:
            texts = [None if x is None else codec.decode(np.asarray(x, np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string())], schema.names)

    return encoded.select(*dict.fromkeys([*keep, "ids"])).mapInArrow(run, schema)
