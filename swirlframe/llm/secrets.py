"""Secret scans: fixed patterns, and probabilistic automata inferred from labelled credentials.

The fixed patterns give the base spans. Their matches are credentials labelled by kind; from a bounded sample of
them (SAMPLE per kind, those of smallest hash) a prefix tree is built for each kind, and its states are merged where a
Hoeffding bound finds their frequencies compatible, which gives a probabilistic automaton of the format. Every
candidate of the corpus (a run of LEAST or more credential characters, the least that a labelled one can have, outside base
spans, dots at its ends left off) is then scored, and spans of kind ``format`` are added for those that pass both:

- the mean log-likelihood of a character against a uniform text reaches a cut-off that nine in ten labelled credentials left out of the fit pass;
- the log-likelihood of the whole, with the chances to go on and to end at its length against those of a uniform length,
  is at least a share (EVIDENCE) of what nine in ten of those credentials reach. So hexadecimal words, prefixes of commits and dates,
  whose characters are a key's but whose lengths are not, aren't taken for one.

A merged state's own chance to end is the same at every depth, so lengths come from the labelled credentials' (``Lengths``). A kind of which nine in
ten labelled credentials have a digit (or a letter) asks for one: a merged automaton forgets that.

Defined results: null and empty texts have no spans; spans are in code points, end exclusive; without labelled
credentials there are only base spans; repeated rows get a row each; an empty table gives no rows; ids are integers (null ones stay null, others
that can't be cast raise Spark's cast error); a text may be of any length and is scanned whole, one at a time; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from pyspark.sql import functions as F

from .common import map_rows, only, written

KINDS = ("assign", "access", "hex", "format")
SAMPLE, CONFIDENCE, SMOOTH, LEAST, MARGIN = 400, 0.05, 0.02, 8, 0.1
#: Share of labelled credentials' whole likelihood that a candidate has to have, and the longest one (labelled or by uniform length).
EVIDENCE, LONGEST = 0.5, 256
#: The base patterns, on UTF-8 bytes.
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
CANDIDATE = re.compile(rb"[A-Za-z0-9+/_=.-]{%d,}" % LEAST)
DIGIT, LETTER = re.compile(rb"[0-9]"), re.compile(rb"[A-Za-z]")
_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_HEXED = bytes(104 if chr(c) in "0123456789abcdef" else 32 for c in range(256))
ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."


def base_spans(text: bytes) -> list[tuple[int, int, int, bytes]]:
    """(start, end, kind number, credential) of the base matches, in bytes."""
    out = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [(m.start(), m.end(), 0, m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if b"AKIA" in text:
        out += [(m.start(), m.end(), 1, m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    hexed = text.translate(_HEXED)
    at = hexed.find(b"h" * 32)
    while at >= 0:
        end = hexed.find(b" ", at)
        end = len(text) if end < 0 else end
        out.append((at, end, 2, text[at:end]))
        at = hexed.find(b"h" * 32, end)
    return sorted(out)


class Automaton:
    """A probabilistic automaton by merging compatible states of a prefix tree, from shallow to deep."""

    def __init__(self, strings: list[bytes], confidence: float = CONFIDENCE) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.seen: list[dict[int, int]] = [{}]
        self.ends, self.total = [0], [0]
        for s in strings:
            at = 0
            self.total[0] += 1
            for c in s:
                self.seen[at][c] = self.seen[at].get(c, 0) + 1
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.seen.append({})
                    self.ends.append(0)
                    self.total.append(0)
                at = self.next[at][c]
                self.total[at] += 1
            self.ends[at] += 1
        self.width = math.sqrt(0.5 * math.log(2 / confidence))
        red, blue = [0], [(0, c) for c in self.next[0]]
        while blue:
            parent, c = blue.pop(0)
            state = self.next[parent][c]
            if state in red:
                continue
            for r in red:
                if self._compatible(r, state):
                    self.next[parent][c] = r
                    self._fold(r, state)
                    break
            else:
                red.append(state)
            blue = [(p, x) for p in red for x in self.next[p] if self.next[p][x] not in red]
        self.states = red

    def _differ(self, a: int, m: int, b: int, n: int) -> bool:
        return abs(a / m - b / n) > self.width * (1 / math.sqrt(m) + 1 / math.sqrt(n))

    def _compatible(self, x: int, y: int) -> bool:
        todo = [(x, y)]
        while todo:
            a, b = todo.pop()
            m, n = self.total[a], self.total[b]
            if not m or not n:
                continue
            if self._differ(self.ends[a], m, self.ends[b], n):
                return False
            for c in self.seen[a].keys() | self.seen[b].keys():
                if self._differ(self.seen[a].get(c, 0), m, self.seen[b].get(c, 0), n):
                    return False
                if c in self.next[a] and c in self.next[b] and self.next[a][c] != self.next[b][c]:
                    todo.append((self.next[a][c], self.next[b][c]))
        return True

    def _fold(self, x: int, y: int) -> None:
        """Adds the (tree-shaped) state y to x."""
        todo = [(x, y)]
        while todo:
            a, b = todo.pop()
            self.total[a] += self.total[b]
            self.ends[a] += self.ends[b]
            for c, n in self.seen[b].items():
                self.seen[a][c] = self.seen[a].get(c, 0) + n
            for c, to in self.next[b].items():
                if c in self.next[a]:
                    todo.append((self.next[a][c], to))
                else:
                    self.next[a][c] = to

    def likelihood(self, s: bytes) -> float:
        """Mean log-likelihood of a character against all characters being alike; unseen ones are smoothed."""
        return self.characters(s) / max(1, len(s))

    def characters(self, s: bytes) -> float:
        """The log-likelihood of all characters, given the length, against all of them being alike."""
        uniform = 1 / len(ALPHABET)
        at, sum_ = 0, 0.0
        for c in s:
            p = 0.0 if at < 0 or not self.total[at] else self.seen[at].get(c, 0) / max(1, self.total[at] - self.ends[at])
            sum_ += math.log(((1 - SMOOTH) * p + SMOOTH * uniform) / uniform)
            at = -1 if at < 0 else self.next[at].get(c, at)
        return sum_


class Lengths:
    """Chances to end at each length, smoothed, against those of a length that is uniform from LEAST to LONGEST."""

    def __init__(self, strings: list[bytes]) -> None:
        n = np.bincount([len(s) for s in strings], minlength=LONGEST + 2)[LEAST : LONGEST + 1].astype(float)
        share = (1 - SMOOTH) * n / max(1.0, n.sum()) + SMOOTH / len(n)
        self.ends = share / share[::-1].cumsum()[::-1]  # of those that got so far
        self.uniform = 1 / np.arange(len(n), 0, -1)

    def likelihood(self, length: int) -> float:
        """Log of: gone on at every shorter length and ended at this one, over the same by uniform lengths; 0 where neither can be."""
        at = length - LEAST
        if not 0 <= at < len(self.ends):
            return 0.0
        went = np.log1p(-self.ends[:at]).sum() - np.log1p(-self.uniform[:at]).sum()
        return float(went + math.log(self.ends[at] / self.uniform[at]))


class Formats:
    """Automata by kind with the cut-offs of their likelihoods, their lengths and the classes of characters that they ask for."""

    def __init__(self, labelled: dict[int, list[bytes]]) -> None:
        self.of: list[tuple[Automaton, Lengths, float, float, list[re.Pattern]]] = []
        for _, strings in sorted(labelled.items()):
            fit, rest = [s for i, s in enumerate(strings) if i % 4], strings[::4]
            if len(fit) < 10:
                continue
            model = Automaton(fit)
            lengths, tenth = Lengths(strings), len(rest) // 10
            mean = sorted(model.likelihood(s) for s in rest)[tenth]
            whole = sorted(model.characters(s) + lengths.likelihood(len(s)) for s in rest)[tenth]
            self.of.append((model, lengths, max(0.0, mean - MARGIN), max(0.0, EVIDENCE * whole), [c for c in (DIGIT, LETTER) if sum(bool(c.search(s)) for s in strings) >= 0.9 * len(strings)]))

    def fits(self, s: bytes) -> bool:
        for model, lengths, mean, whole, classes in self.of:
            if all(c.search(s) for c in classes):
                got = model.characters(s)
                if got >= mean * len(s) and got + lengths.likelihood(len(s)) >= whole:
                    return True
        return False


def labelled_credentials(docs: DataFrame, sample: int = SAMPLE, text: str = "text") -> dict[int, list[bytes]]:
    """By kind, at most ``sample`` distinct credentials of the base patterns, those of smallest hash."""

    def harvest(rows: Iterator[tuple]) -> Iterator[tuple]:
        held: list[dict[bytes, int]] = [{}, {}, {}]
        for (body,) in rows:
            for _, _, kind, value in base_spans(body or b""):
                if len(value) <= 256:
                    held[kind][value] = xxhash.xxh3_64_intdigest(value) >> 1
                    if len(held[kind]) > 4 * sample:
                        held[kind] = dict(heapq.nsmallest(sample, held[kind].items(), key=lambda x: (x[1], x[0])))
        for kind in range(3):
            yield from ((kind, v, h) for v, h in heapq.nsmallest(sample, held[kind].items(), key=lambda x: (x[1], x[0])))

    found = map_rows(only(docs, text=text), harvest, "kind int, value binary, h long", pa.schema([("kind", pa.int32()), ("value", pa.binary()), ("h", pa.int64())])).distinct()
    found = written(found, "credentials")  # one scan of the texts, at most `sample` rows a kind and task
    out: dict[int, list[bytes]] = {}
    for kind in range(3):
        rows = found.filter(F.col("kind") == kind).orderBy("h", "value").limit(sample).collect()
        if rows:
            out[kind] = [bytes(r.value) for r in rows]
    return out


def _points(text: bytes, spans: list[tuple]) -> list[tuple]:
    """Spans with places in code points instead of bytes."""
    if text.isascii():
        return spans
    before = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return [(int(before[a]), int(before[b]), *rest) for a, b, *rest in spans]


def format_spans(text: bytes, base: list[tuple], formats: Formats) -> list[tuple[int, int, int]]:
    """Candidates outside base spans that an automaton takes for its own."""
    if not formats.of:
        return []
    out = []
    for m in CANDIDATE.finditer(text):
        s = m[0].strip(b".")
        if len(s) >= LEAST and formats.fits(s):
            start = m.start() + len(m[0]) - len(m[0].lstrip(b"."))
            if not any(a < start + len(s) and start < b for a, b, *_ in base):
                out.append((start, start + len(s), 3))
    return out


def scan_secrets(docs: DataFrame, sample: int = SAMPLE, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, spans: array of (kind, start, end) in order of start, then kind as in KINDS."""
    shared = docs.sparkSession.sparkContext.broadcast(Formats(labelled_credentials(docs, sample, text)))

    def scan(rows: Iterator[tuple]) -> Iterator[tuple]:
        formats = shared.value
        for owner, body in rows:
            body = body or b""
            base = base_spans(body)
            spans = sorted((a, b, k) for a, b, k, *_ in [*base, *format_spans(body, base, formats)])
            spans = _points(body, sorted(spans, key=lambda x: (x[0], x[2])))
            yield owner, [{"kind": KINDS[k], "start": a, "end": b} for a, b, k in spans]

    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    return map_rows(only(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long")), scan, "doc_id long, spans array<struct<kind:string,start:long,end:long>>", pa.schema([("doc_id", pa.int64()), ("spans", kind)]))


def secret_digest(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (a string) of what ``scan_secrets`` returns."""
    told = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["kind"] != "format")
    of = lambda k: lambda s: s["kind"] == k
    counts = [F.size(F.filter("spans", of(k))).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(F.array_join(F.transform(base, told), ","), 256).alias("base_sha256"), F.array_join(F.transform("spans", told), ",").alias("spans"))


def digest(spans: list[str]) -> str:
    return hashlib.sha256(",".join(spans).encode()).hexdigest()
