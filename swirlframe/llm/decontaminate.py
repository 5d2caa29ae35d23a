"""Benchmark decontamination: a prefix-filtered join of item windows with documents, verified word by word.

A window is ``window`` consecutive words of an item (an item of fewer words is one window). Its shingles of three
words are ordered by rarity over all documents. A window has to be contained whole, so it can only occur where its
rarest shingle does (its prefix), only at that shingle's place (positional bound), and only inside a document with enough
words (length bound). What is left is compared word by word.

Items of at most BLOCK_BYTES are broadcast, and documents are never shuffled. More items are joined: two Bloom filters of
bounded size (of all shingles, then of prefixes) are broadcast, places that pass go by their shingle to the windows with
the words around them, and the verified hits go back to their rows. Either way there are two passes over the documents.

Defined results: null and empty texts have no words; items without words, id or text take no part; repeated
documents are judged each, and equal rows alike; documents of equal ids (or none) and different texts stay apart;
repeated items count once per id; empty tables give no rows (documents) or no hits (items). Ids are integers; a text may be
of any length; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filter_of, map_rows, noted, only, row_key, written

WINDOW, SHINGLE = 10, 3
#: Item text that is broadcast: at least two bytes a word, so it has at most 2^21 distinct words and codes fit 63 bits.
BLOCK_BYTES = 4 << 20
_WORD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z; every byte from 0x80 belongs to a word."""
    return (text or b"").translate(_WORD).split()


class Index:
    """Items that are broadcast: vocabulary, windows, shingle codes, and after ``choose`` the prefixes to look for."""

    def __init__(self, items: list[tuple[int, bytes]], window: int) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.windows: dict[tuple[int, ...], set[int]] = {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                self.windows.setdefault(tuple(ids[i : i + window]), set()).add(item)
        self.base = len(self.vocabulary) + 1
        self.sizes = sorted({min(SHINGLE, len(w)) for w in self.windows})
        self.shingles = np.unique(np.array([c for w in self.windows for c in self.window_codes(w)], np.int64))
        self.prefix: dict[int, list[tuple[np.ndarray, int, list[int]]]] = {}
        self.wanted = np.zeros(0, np.int64)

    def window_codes(self, w: tuple[int, ...]) -> list[int]:
        k = min(SHINGLE, len(w))
        return [sum(x * self.base ** (SHINGLE - 1 - j) for j, x in enumerate(w[i : i + k])) for i in range(len(w) - k + 1)]

    def ids(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int64, len(words))

    def found(self, ids: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and codes of the shingles that are in ``among`` (sorted)."""
        at, codes = [], []
        for k in self.sizes:
            n = len(ids) - k + 1
            if n <= 0 or not len(among):
                continue
            whole = ids[:n] > 0
            for j in range(1, k):
                whole &= ids[j : j + n] > 0
            where = np.flatnonzero(whole)
            code = sum(ids[where + j] * self.base ** (SHINGLE - 1 - j) for j in range(k))
            hit = among[np.minimum(np.searchsorted(among, code), len(among) - 1)] == code
            at.append(where[hit])
            codes.append(code[hit])
        return (np.concatenate(at), np.concatenate(codes)) if at else (np.zeros(0, np.int64),) * 2

    def choose(self, frequency: dict[int, int]) -> None:
        """The prefix of each window: its rarest shingle."""
        for w, items in self.windows.items():
            codes = self.window_codes(w)
            i = min(range(len(codes)), key=lambda i: (frequency.get(codes[i], 0), codes[i], i))
            self.prefix.setdefault(codes[i], []).append((np.array(w, np.int64), i, sorted(items)))
        self.wanted = np.array(sorted(self.prefix), np.int64)

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray | None, set[int]]:
        """Which words are inside an occurrence of a window, and the items with occurring windows."""
        at, codes = self.found(ids, self.wanted)
        if not len(at):
            return None, set()
        mark, items = np.zeros(len(ids) + 1, np.int64), set()
        for code in np.unique(codes):
            places = at[codes == code]
            for words, offset, owners in self.prefix[int(code)]:
                n = len(words)
                start = places - offset
                start = start[(start >= 0) & (start + n <= len(ids))]  # positional and length bounds
                start = start[(ids[start[:, None] + np.arange(n)] == words).all(axis=1)]
                if len(start):
                    np.add.at(mark, start, 1)
                    np.add.at(mark, start + n, -1)
                    items.update(owners)
        inside = np.cumsum(mark[:-1]) > 0
        return (inside, items) if items else (None, items)


def _spans(inside: np.ndarray | None) -> list[dict]:
    if inside is None:
        return []
    edge = np.flatnonzero(np.diff(np.concatenate([[0], inside.astype(np.int8), [0]])))
    return [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]


_HITS = "doc_id long, n_words long, hits array<struct<start:int,end:int>>, items array<long>"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("hits", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("items", pa.list_(pa.int64()))])


def find_windows(docs: DataFrame, items: DataFrame, window: int = WINDOW, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, hits (word spans inside occurrences of windows, end exclusive), items (ids with such windows)."""
    texts = only(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = only(items, item=item_id, text=item_text).withColumn("item", F.col("item").cast("long")).na.drop().distinct()
    if (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > block_bytes:
        return _joined(texts, rows, window)
    block = [(r.item, r.text.encode()) for r in rows.orderBy("item", "text").collect()]
    if not block:
        return map_rows(texts, lambda rows: ((d, len(words_of(t)), [], []) for d, t in rows), _HITS, _ARROW)
    return _broadcast(texts, Index(block, window))


def _broadcast(texts: DataFrame, index: Index) -> DataFrame:
    context = texts.sparkSession.sparkContext
    first = context.broadcast(index)

    def rarity(rows: Iterator[tuple]) -> Iterator[tuple]:
        idx, n = first.value, np.zeros(len(first.value.shingles), np.int64)
        for (body,) in rows:
            _, codes = idx.found(idx.ids(words_of(body)), idx.shingles)
            if len(codes):
                n[np.searchsorted(idx.shingles, np.unique(codes))] += 1
        yield from ((int(idx.shingles[i]), int(n[i])) for i in np.flatnonzero(n))

    counted = map_rows(texts.select("text"), rarity, "code long, n long", pa.schema([("code", pa.int64()), ("n", pa.int64())]))
    frequency = {r.code: r.n for r in counted.groupBy("code").agg(F.sum("n").alias("n")).collect()}  # at most the items' shingles
    first.destroy()
    index.choose(frequency)
    shared = context.broadcast(index)

    def search(rows: Iterator[tuple]) -> Iterator[tuple]:
        idx = shared.value
        for owner, body in rows:
            words = words_of(body)
            inside, items = idx.hits(idx.ids(words))
            yield owner, len(words), _spans(inside), sorted(items)

    return map_rows(texts, search, _HITS, _ARROW)


def _codes(words: list[bytes], k: int) -> np.ndarray:
    """XXH3 of the shingles of k words."""
    n = max(0, len(words) - k + 1)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, map(b" ".join, zip(*(words[i:] for i in range(k))))), np.uint64, n)


def _joined(texts: DataFrame, items: DataFrame, window: int) -> DataFrame:
    context = texts.sparkSession.sparkContext

    def windows_of(rows: Iterator[tuple]) -> Iterator[tuple]:
        for item, body in rows:
            words = words_of(body)
            for i in range(max(1, len(words) - window + 1) if words else 0):
                yield b" ".join(words[i : i + window]), len(words[i : i + window]), item

    def shingles_of(rows: Iterator[tuple]) -> Iterator[tuple]:
        for win, n in rows:
            for i, code in enumerate(_codes(win.split(b" "), min(SHINGLE, n)).view(np.int64).tolist()):
                yield code, i, win

    windows = written(map_rows(items, windows_of, "win binary, n int, item long", pa.schema([("win", pa.binary()), ("n", pa.int32()), ("item", pa.int64())])).distinct(), "windows")
    sizes = sorted({min(SHINGLE, r.n) for r in windows.select("n").distinct().collect()})  # at most `window` rows
    shingles = written(map_rows(windows.select("win", "n").distinct(), shingles_of, "code long, at int, win binary", pa.schema([("code", pa.int64()), ("at", pa.int32()), ("win", pa.binary())])), "window-shingles")
    every = context.broadcast(filter_of(shingles.select("code").distinct()))

    def places(words: list[bytes], field: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for k in sizes:
            codes = _codes(words, k)
            at = np.flatnonzero(noted(field, codes)) if len(codes) else np.zeros(0, np.int64)
            yield at, codes[at].view(np.int64)

    def rarity(rows: Iterator[tuple]) -> Iterator[tuple]:
        field, seen = np.frombuffer(zlib.decompress(every.value), np.uint8), Counter()
        for (body,) in rows:
            for _, codes in places(words_of(body), field):
                seen.update(np.unique(codes).tolist())
            if len(seen) > 300_000:
                yield from seen.items()
                seen.clear()
        yield from seen.items()

    counted = map_rows(texts.select("text"), rarity, "code long, n long", pa.schema([("code", pa.int64()), ("n", pa.int64())])).groupBy("code").agg(F.sum("n").alias("n"))
    ranked = shingles.join(counted, "code", "left").groupBy("win").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "code", "at")).alias("p"))
    prefix = written(ranked.select("p.code", "p.at", "win"), "window-prefixes")
    rare = context.broadcast(filter_of(prefix.select("code").distinct()))
    keyed = texts.select(row_key(F.col("doc_id"), F.col("text")).alias("row"), "doc_id", "text")

    def suspects(rows: Iterator[tuple]) -> Iterator[tuple]:
        field = np.frombuffer(zlib.decompress(rare.value), np.uint8)
        for row, body in rows:
            words = words_of(body)
            for at, codes in places(words, field):
                for p, code in zip(at.tolist(), codes.tolist(), strict=True):
                    low = max(0, p - window + 1)
                    yield code, row, p, low, b" ".join(words[low : p + window])

    def verify(rows: Iterator[tuple]) -> Iterator[tuple]:
        for row, p, low, around, at, win in rows:
            words, own, s = around.split(b" "), win.split(b" "), p - at - low
            if s >= 0 and words[s : s + len(own)] == own:
                yield row, p - at, p - at + len(own), win

    near = [("code", pa.int64()), ("row", pa.binary()), ("place", pa.int32()), ("low", pa.int32()), ("around", pa.binary())]
    sent = written(map_rows(keyed.select("row", "text"), suspects, "code long, row binary, place int, low int, around binary", pa.schema(near)), "suspects")
    met = sent.join(prefix, "code").select("row", "place", "low", "around", "at", "win")
    hits = written(map_rows(met, verify, "row binary, start int, end int, win binary", pa.schema([("row", pa.binary()), ("start", pa.int32()), ("end", pa.int32()), ("win", pa.binary())])).distinct(), "hits")
    spans = hits.groupBy("row").agg(F.collect_set(F.struct("start", "end")).alias("hits"))
    owners = hits.select("row", "win").distinct().join(windows.select("win", "item"), "win").groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    found = written(spans.join(owners, "row"), "found")  # a plain side of the join: an often repeated row is split
    counts = map_rows(keyed, lambda rows: ((r, d, len(words_of(t))) for r, d, t in rows), "row binary, doc_id long, n_words long", pa.schema([("row", pa.binary()), ("doc_id", pa.int64()), ("n_words", pa.int64())]))

    def merge(rows: Iterator[tuple]) -> Iterator[tuple]:
        for owner, n_words, hits, items in rows:
            inside = np.zeros(n_words, bool)
            for h in hits or ():
                inside[h["start"] : h["end"]] = True
            yield owner, n_words, _spans(inside), items or []

    return map_rows(counts.join(found, "row", "left").select("doc_id", "n_words", "hits", "items"), merge, _HITS, _ARROW)


def contamination(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of what ``find_windows`` returns."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda acc, h: acc + (h["end"] - h["start"]).cast("long"))
    joined = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(joined, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
