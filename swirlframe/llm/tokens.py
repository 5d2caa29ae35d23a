"""Exact tokenising by the public tokenizers' own libraries, one pre-token at a time.

The word vocabulary's tokenizer folds white space and case, and cuts a text into pre-tokens (runs of letters, digits one by
one, runs of other characters, contractions) that no merge crosses: a text's ids are its pre-tokens' ids one after
the other. Each distinct pre-token goes through the library once per worker process and is then looked up; what is surely
one pre-token goes through the library's merges alone. They are cut
here only where Python is sure to cut like the library: words of printable ASCII and Latin letters. Other words are kept
whole, and where even white space or case could differ (``\\x1c``-``\\x1f``, special strings, final sigma, texts not in
NFC) the steps are left out, or the whole text goes through the library.
"""

from __future__ import annotations

import re
import struct
import unicodedata
from functools import lru_cache

import numpy as np

#: Pre-tokens whose ids a worker process remembers, in each of two generations (results don't depend on it).
REMEMBERED = 600_000
#: Letters of which every Unicode version says so and that lower-casing leaves single.
_LETTER = "a-z\u00e0-\u00f6\u00f8-\u012f\u0131-\u024f"
_OTHER = "!-/:-@\\[-`{-~"
#: The contractions that are pre-tokens of their own.
_PRE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[{_OTHER}]+")
_PLAIN = re.compile(f"[{_LETTER}0-9{_OTHER}\t-\r ]*")


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """The library's tokenizer of a .json file, one thread: Spark gives each task its own core."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def spans_words(path: str) -> bool:
    """Whether pre-tokens can be cut beforehand: only for a normaliser that folds white space and case and the Split that is known."""
    import json

    spec = json.loads(tokenizer(path).to_str())
    normal = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    splits = [s for s in (spec.get("pre_tokenizer") or {}).get("pretokenizers", []) if s.get("type") == "Split"]
    plain = all(not t["lstrip"] and not t["rstrip"] and not t["single_word"] and t["content"].startswith("<|") and not any(c.isspace() for c in t["content"]) for t in spec.get("added_tokens", []))
    pattern = splits[0]["pattern"].get("Regex", "") if splits else ""
    known = pattern == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    return normal == ["NFC", "Replace", "Lowercase"] and plain and known and splits[0]["behavior"] == "Removed" and splits[0]["invert"]


#: Fixed rule of byte-level models: bytes that show as a Latin letter or sign stand for it, the others for what follows 255.
_SHOWN = str.maketrans({b: 256 + k for k, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))})


@lru_cache(maxsize=4)
def merges(path: str):
    """The library's merges alone, for pre-tokens that the steps before leave as they are; None where those aren't known."""
    import json

    library = tokenizer(path)
    spec = json.loads(library.to_str())
    last = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[-1]
    bytewise = last.get("type") == "ByteLevel" and not last.get("add_prefix_space") and not last.get("use_regex")
    return library.model.tokenize if spans_words(path) and bytewise and spec["model"]["type"] == "BPE" and not spec.get("post_processor") else None


def merged(word: str, merge) -> list | None:
    """The tokens of a word that is surely one pre-token, already folded; None for any other, which takes the whole library."""
    if not _PRE.fullmatch(word) or "<|" in word:
        return None
    if word.isascii():  # no capitals: the pattern has none
        return merge(word)
    return merge(word.encode().decode("latin-1").translate(_SHOWN)) if word == word.lower() else None


def cuts_alike(text: str) -> bool:
    """Python also splits at these four; the library doesn't."""
    return not ("\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text)


def canonical(text: str) -> str:
    """The text lower-cased where that is what the tokenizer's normaliser comes to, or else as it is."""
    if "<|" in text or "Σ" in text:
        return text
    low = text.lower()
    if text.isascii() or (unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", low)):
        return low
    return text


def pre_tokens(text: str, path: str) -> list[str]:
    """The text's pre-tokens; words that can't be cut for sure stay whole, and so does a text that has no sure words."""
    if not text:
        return []
    if not spans_words(path) or not cuts_alike(text):
        return [text]
    low = canonical(text)
    if "<|" in low:
        return low.split()
    if _PLAIN.fullmatch(low):
        return _PRE.findall(low)
    out: list[str] = []
    for w in low.split():
        if _PLAIN.fullmatch(w):
            out += _PRE.findall(w)
        else:
            out.append(w)
    return out


class Ids:
    """Ids of texts as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str) -> None:
        self.path, self.library = path, tokenizer(path)
        special = [(t.content, i) for i, t in self.library.get_added_tokens_decoder().items() if t.special and t.content.startswith("<|")]
        self.between = special[0] if special and spans_words(path) else None
        self.merge = merges(path)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _learn(self, words: list[str]) -> bool:
        full = len(self.young) + len(words) > REMEMBERED
        if full:
            self.old, self.young = self.young, {}
        todo = []
        for w in words:
            if (known := self.old.get(w)) is not None:
                self.young[w] = known
            elif self.merge and (tokens := merged(w, self.merge)) is not None:
                self.young[w] = struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])
            else:
                todo.append(w)
        joined = [w for w in todo if "<|" not in w] if self.between else []
        for at in range(0, len(joined), 256):  # one call for many words, a special token between them
            some = joined[at : at + 256]
            ids = np.array(self.library.encode_batch_fast([self.between[0].join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.append(np.flatnonzero(ids == self.between[1]), len(ids)).tolist()
            data, start = ids.tobytes(), 0
            for w, end in zip(some, ends, strict=True):
                self.young[w] = data[4 * start : 4 * end]
                start = end + 1
        for w in todo if not joined else [w for w in todo if "<|" in w]:
            self.young[w] = np.array(self.library.encode(w, add_special_tokens=False).ids, "<u4").tobytes()
        return full

    def of(self, text: str) -> bytes:
        return self.of_many([text])[0]

    def of_many(self, texts: list[str]) -> list[bytes]:
        """Each text's ids; what is new in all of them goes through the library together."""
        cut = [pre_tokens(t, self.path) for t in texts]
        whole = [len(w) == 1 and len(w[0]) > 1000 for w in cut]
        distinct: set[str] = set()
        for words, alone in zip(cut, whole, strict=True):
            if not alone:
                distinct.update(words)
        new = distinct.difference(self.young)
        if new and self._learn(list(new)):  # a new generation began just now
            self._learn(list(distinct.difference(self.young)))
        known = self.young.__getitem__
        out = [np.array(self.library.encode(w[0], add_special_tokens=False).ids, "<u4").tobytes() if alone else b"".join(map(known, w)) for w, alone in zip(cut, whole, strict=True)]
        for w in new:
            if len(w) > 256:  # memory is bounded in words, so only short ones stay
                del self.young[w]
        return out


@lru_cache(maxsize=2)
def ids_of(path: str) -> Ids:
    """One memory of words for each worker process, whichever tasks it runs."""
    return Ids(path)


def default_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
