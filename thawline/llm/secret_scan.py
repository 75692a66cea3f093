"""Secret scans: fixed patterns, and guess-cost segmentation of values in credential contexts.

Base spans (kinds ``assign``, ``access``, ``hex``) come from three patterns.  On top of them every value
that stands in a credential context - a credential word, a separator and a run of
non-blank characters - is segmented at minimum guess cost: known words, dates, repeats,
keyboard walks and brute-force spans, by dynamic programming over the value.  A
value that takes at least ``10 ** min_guesses`` guesses, and that the base spans don't cover
already, is a span of kind ``guess``.  Words and their ranks are common passwords, then the whole words of public
vocabularies of many languages (``vocabularies``, paths).  Addresses and paths without a password in them count as their costliest part, and
after "is" a value of letters alone is prose.

Defined results: null text counts as empty, and has no spans.  Offsets are code points, ends exclusive.  Texts of any length are
scanned whole.  Repeated rows are scanned each on its own; columns of ``docs`` beyond ``keep`` and text are ignored, and a column to keep
that bears the name of a result is refused.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_rows, strings

ASSIGN = re.compile(r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: One of these stands in every match of CONTEXT; "pass" also for passphrase.
CONTEXT_WORDS = (*ASSIGN_WORDS, "pwd", "pass", "credential", "private_key", "access_key", "auth_key")
CONTEXT = re.compile(
    r"(?:password|passwd|passphrase|pwd|pass|secret|token|api_?key|credentials?|private_key|access_key|auth_key)(?:_[a-z0-9]{1,12})?[\"']?\s{0,4}(?:[:=]|=>|:=|(?P<said>\bis\b):?)\s{0,4}[\"'`]?(?P<value>[^\s\"'`<>(){},;]{6,})",
    re.ASCII | re.IGNORECASE,
)

# Common passwords and words of passwords, most common first.
COMMON = """password qwerty letmein welcome admin dragon monkey football iloveyou master login hello shadow sunshine
princess abc baseball superman batman trustno access secret test user root guest default changeme pass love
god money summer winter spring autumn monday friday january london paris berlin madrid server database oracle
mysql postgres example sample dummy token key private public company home office system network internet
computer windows linux apple google orange purple yellow silver golden black white green blue red tiger
eagle falcon phoenix matrix hunter ranger killer soccer hockey george michael jordan thomas robert daniel
andrew charlie jessica ashley amanda nicole michelle jennifer secure my the new your""".split()
KEY_ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz", "qazwsxedcrfvtgbyhnujmikolp")
DATE = re.compile(r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)?\d\d|(?:19|20)\d\d")
LEET = str.maketrans("@431!05$7", "aaeiiosst")
SEGMENT_COST = math.log10(2)
#: Longest block whose repetition is a segment.
BLOCK = 16
#: Public vocabularies whose whole words are known words, most frequent first.
VOCABULARIES = ("/opt/tokenizers/word_bpe_49k.json", "/opt/tokenizers/piece_bpe_32k.model")
ADDRESS = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://[^@]*|(?:~|\.{0,2})/[^@]*")
NEAR_PAIRS = {row[i : i + 2] for row in KEY_ROWS for i in range(len(row) - 1)}
NEAR_PAIRS |= {p[::-1] for p in NEAR_PAIRS}


@dataclass
class Words:
    """Known words by rank, and the greatest length of one."""

    ranks: dict[str, int]
    longest: int


def known_words(vocabularies: tuple[str, ...] = VOCABULARIES) -> Words:
    """The common passwords, then the whole words of three letters or more of each vocabulary, in its own order."""
    words = list(COMMON)
    for path in vocabularies:
        if path.endswith(".json"):
            with open(path, encoding="utf-8") as f:
                tokens = json.load(f)["model"]["vocab"]
            found = (t.removesuffix("</w>") for t in sorted(tokens, key=tokens.get) if t.endswith("</w>"))
        else:
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            names = map(model.id_to_piece, range(model.get_piece_size()))
            found = (t[1:].lower() for t in names if t.startswith("\u2581"))
        words += [w for w in found if len(w) >= 3 and w.isalpha()]
    ranks = {w: i + 1 for i, w in enumerate(dict.fromkeys(words))}
    return Words(ranks, max(map(len, ranks)))


def _char_cost(c: str) -> float:
    if c.isdigit():
        return 1.0
    if "a" <= c <= "z" or "A" <= c <= "Z":
        return math.log10(26)
    return math.log10(33) if ord(c) < 128 else 2.0


def guess_cost(value: str, words: Words) -> float:
    """log10 of the guesses for the cheapest segmentation of ``value``; 0 for an empty one.

    A repeat or walk that ends at some place may start anywhere in its run, but the cheapest one starts at the run's first place or no more
    than ``reach`` after it: only a segment that straddles the run's beginning can make a later start cheaper than the first, and
    words, dates and repeated blocks end at most that far inside; a segment that lies in the run costs more than the factor by which it
    shortens what follows.  So long runs take linear time.
    """
    ranks, reach = words.ranks, max(words.longest, BLOCK)
    low, n = value.lower(), len(value)
    if len(low) != n:
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in value)
    plain = low.translate(LEET)
    best = [0.0] + [math.inf] * n
    brute = [math.inf] * (n + 1)  # cheapest way in which the last segment is a brute-force span
    alike = walk = 1  # lengths of the repeat and of the keyboard walk that end here
    same = [0] * (BLOCK + 1)  # for each distance, how many characters in a row equal the one that far before
    ends = {}  # dates by end
    for i in range(n):
        if low[i].isdigit():
            for width in (4, 6, 8, 10):
                if DATE.fullmatch(low, i, min(n, i + width)) and i + width <= n:
                    ends.setdefault(i + width, []).append(i)
    for j in range(1, n + 1):
        step = _char_cost(value[j - 1])
        brute[j] = min(brute[j - 1], best[j - 1] + SEGMENT_COST) + step
        found = brute[j]
        alike = alike + 1 if j > 1 and low[j - 1] == low[j - 2] else 1
        for start in range(j - alike, min(j - 2, j - alike + reach + 1)):
            found = min(found, best[start] + step + math.log10(j - start) + SEGMENT_COST)
        walk = walk + 1 if j > 1 and low[j - 2 : j] in NEAR_PAIRS else 1
        for start in range(j - walk, min(j - 2, j - walk + reach + 1)):
            found = min(found, best[start] + math.log10(47 * (j - start)) + SEGMENT_COST)
        for i in range(max(0, j - words.longest), j - 1):
            rank = ranks.get(low[i:j]) or ranks.get(plain[i:j])
            if rank:
                varied = low[i:j] not in ranks or value[i:j] != low[i:j]
                found = min(found, best[i] + math.log10(rank + 1) + varied * math.log10(4) + SEGMENT_COST)
        for start in ends.get(j, ()):
            found = min(found, best[start] + math.log10(200 if j - start == 4 else 73000) + SEGMENT_COST)
        for size in range(2, min(BLOCK, j - 1) + 1):  # blocks repeated twice or more
            same[size] = same[size] + 1 if low[j - 1] == low[j - 1 - size] else 0
            if same[size] >= size:
                times = same[size] // size + 1
                block = sum(map(_char_cost, value[j - size : j]))
                found = min(found, best[j - times * size] + block + math.log10(times) + SEGMENT_COST)
        best[j] = found
    return best[n]


def value_cost(value: str, words: Words) -> float:
    """``guess_cost``; of an address or path without a password in it, that of its costliest part."""
    if ADDRESS.fullmatch(value):
        return max((guess_cost(part, words) for part in re.split(r"[/?&=#]+", value)), default=0.0)
    return guess_cost(value, words)


def base_spans(text: str) -> list[tuple[int, int, str, int]]:
    """(start, end, kind, start of the value), ordered by start, then by kind as listed."""
    spans = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        spans += [(m.start(), m.end(), 0, m.start(1)) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), 1, m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    spans += [(m.start(), m.end(), 2, m.start()) for m in HEX.finditer(text)]
    return [(a, b, ("assign", "access", "hex")[k], v) for a, b, k, v in sorted(spans, key=lambda s: (s[0], s[2]))]


def added_spans(text: str, base: list[tuple[int, int, str, int]], min_guesses: float, words: Words) -> list[tuple[int, int, str, int]]:
    low = text.lower()
    if not any(w in low for w in CONTEXT_WORDS):
        return []
    found, passed = [], 0
    for m in CONTEXT.finditer(text):
        a, b = m.span("value")
        b -= len(m["value"]) - len(m["value"].rstrip(".,:!?"))
        while passed < len(base) and base[passed][1] <= a:
            passed += 1
        at = a
        for s, e, _, _ in islice(base, passed, None):  # ordered by start
            if s > at:
                break
            at = max(at, e)
        prose = m["said"] and text[a:b].isalpha()
        if at < b and b - a >= 6 and not prose and value_cost(text[a:b], words) >= min_guesses:
            found.append((a, b, "guess", a))
    return found


_ORDER = {"assign": 0, "access": 1, "hex": 2, "guess": 3}


def scan(text: str, min_guesses: float, words: Words) -> tuple[list, list]:
    base = base_spans(text)
    more = added_spans(text, base, min_guesses, words)
    return base, sorted(base + more, key=lambda s: (s[0], _ORDER[s[2]])) if more else base


def _joined(spans: list) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k, _ in spans)


def redact(text: str, spans: list, mark: str) -> str:
    """``text`` with the secret part of every span replaced; overlapping parts become one mark."""
    out, last = [], 0
    for a, b in sorted((v, e) for _, e, _, v in spans):
        if a >= last:
            out += [text[last:a], mark]
        last = max(last, b)
    return "".join(out) + text[last:]


def scan_secrets(docs: DataFrame, keep: list[str], min_guesses: float = 10.0, mark: str = "", vocabularies: tuple[str, ...] = VOCABULARIES) -> DataFrame:
    """``docs[keep]`` with n_assign, n_access, n_hex, base_sha256 and spans; with a ``mark`` also
    ``redacted``, the text with secrets replaced by it."""
    words = known_words(vocabularies)  # some ten thousand words, sent with the function

    def make():
        def work(step: pa.RecordBatch) -> list[pa.Array]:
            texts = strings(step)
            found = [scan(t, min_guesses, words) for t in texts]
            counts = [[sum(s[2] == kind for s in base) for base, _ in found] for kind in ("assign", "access", "hex")]
            columns = [pa.array(c, pa.int64()) for c in counts]
            columns.append(pa.array([hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in found], pa.string()))
            columns.append(pa.array([_joined(spans) for _, spans in found], pa.string()))
            if mark:
                columns.append(pa.array([redact(t, spans, mark) for t, (_, spans) in zip(texts, found)], pa.string()))
            return columns

        return work

    fields = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string" + ", redacted string" * bool(mark)
    return map_rows(docs, make, fields, keep)
