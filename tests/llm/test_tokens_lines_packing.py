"""Line dedup, token counts and packing against brute force, with nulls, empty and odd texts, ties and repeats."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from swirlframe.llm import line_dedup, packing, token_counts
from swirlframe.llm.tokens import Ids, default_path, merged, merges, tokenizer

ODD = [
    None, "", " ", "\n", "plain text here", "It's we'll DON'T I'VE ’s", "<|endoftext|> and x<|startoftext|>y", "ΑΣ ΣΑΣ ΟΔΟΣ. Σ",
    "a\x1cb\x1d c\x85d e f​g", "é ́x é É ÇA straße İstanbul ﬁ Ⅷ ½ ٣ 12345", "日本語 の 文章 😀👍🏽 🇩🇪", "x" * 9000, "word " * 5000,
    "a.\n", "ẗ T̈. İ. ÀÉ, ß. AΣ, T̈", "e.g., x.,y .z '.' a.b. .", "<|ENDOFTEXT|> A, B. <|endoftext|>.", "Ὀδυσσεύς, ǅ, ﬀ. K. Ω. É̀",
    "tab\tand\nline\r\nends\x0b\x0c.", "same line\nsame line\n  SAME LINE \nother", "same line", "same line", "the_end--of---it!!! #$%&* 3.14",
]


def frame(spark, texts):
    rows = [(i, t, i, "en", "x") for i, t in enumerate(texts)]
    rows.append(rows[4])  # a repeated row
    return spark.createDataFrame(rows, "doc_id long, text string, row long, tail string, n_lines string")


@pytest.mark.parametrize("remembered", [20, 1000])
def test_ids_equal_the_librarys(monkeypatch, remembered):
    monkeypatch.setattr("swirlframe.llm.tokens.REMEMBERED", remembered)
    path = default_path()
    ids, lib = Ids(path), tokenizer(path)
    for t in ODD * 2:
        assert ids.of(t or "") == np.array(lib.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes(), t


@pytest.mark.parametrize("head", [0, 3, 1000])
def test_token_counts(spark, head):
    lib = tokenizer(default_path())
    docs = frame(spark, ODD)
    got = sorted(tuple(r) for r in token_counts.count_tokens(docs, head=head).collect())
    want = sorted((r.doc_id, len((r.text or "").encode()), len(lib.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect())
    assert got == want
    assert token_counts.count_tokens(docs.limit(0), head=head).count() == 0


def brute_lines(rows, min_docs, keep):
    keys = [[x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in (t or "").split("\n")] for _, t in rows]
    docs = Counter(k for own in keys for k in set(own) if k)
    first = {}
    for (d, _), own in zip(rows, keys, strict=True):
        for k in own:
            first[k] = min(first.get(k, d), d)
    out = []
    for (d, t), own in zip(rows, keys, strict=True):
        lines, left, dropped, kept = (t or "").split("\n"), [], 0, set()
        for line, k in zip(lines, own, strict=True):
            if docs[k] >= min_docs and not (keep == "first" and first[k] == d and k not in kept):
                dropped += 1
                continue
            kept.add(k)
            left.append(line)
        out.append((d, len(lines), dropped, hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("limit", [1 << 20, 0])
@pytest.mark.parametrize("bits", [1 << 20, 64])  # 64 bits: nearly every line is suspected
def test_lines(spark, keep, limit, bits):
    docs = frame(spark, ODD)
    got = line_dedup.kept_digest(line_dedup.dedup_lines(docs, 2, keep, bits=bits, broadcast_bytes=limit))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(tuple(r) for r in got.collect()) == brute_lines(rows, 2, keep)
    assert line_dedup.dedup_lines(docs.limit(0), 2, keep, broadcast_bytes=limit).count() == 0


def check_packed(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("broadcast_rows", [0, 1000])
def test_packing(spark, broadcast_rows):
    docs, ids = frame(spark, ODD), Ids(default_path())
    pieces = packing.written(packing.token_pieces(docs.repartition(3), default_path()), "pieces")
    rows = packing.pack(pieces, broadcast_rows=broadcast_rows).collect()
    want = Counter()
    for r in docs.collect():
        data = ids.of(r.text or "") + (1).to_bytes(4, "little")
        for i, at in enumerate(range(0, len(data), 4 * 4096)):
            want[(r.doc_id, i, at // 4, len(data[at : at + 4 * 4096]) // 4, zlib.crc32(data[at : at + 4 * 4096]))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    assert check_packed(rows, 4096) <= -(-sum(r.length for r in rows) // 4096) + 1
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_plan_uses_every_length_once_and_is_tight():
    rng = np.random.default_rng(1)
    for cap, n in ((64, 500), (4096, 3000)):
        counts = np.bincount(np.clip(rng.lognormal(np.log(cap / 6), 1, n).astype(int), 1, cap), minlength=cap + 1)
        plan = packing.plan_patterns(counts)
        used = Counter()
        for times, lengths in plan:
            assert sum(lengths) <= cap
            for x in lengths:
                used[x] += times
        assert all(used[x] == counts[x] for x in range(cap + 1))
        total = int((counts * np.arange(cap + 1)).sum())
        assert sum(t for t, _ in plan) <= 1.02 * total / cap + 1


def test_merges_alone_are_the_library():
    """Every Latin letter and sign alone, doubled and after others, and random words: what is taken directly has the library's ids."""
    import random

    path, rnd = default_path(), random.Random(5)
    lib, merge = tokenizer(path), merges(path)
    words = [x for c in range(1, 0x260) for x in (chr(c), chr(c) * 2, "a" + chr(c), "'" + chr(c))]
    words += ["".join(rnd.choice("abcxyzß\u00e0\u00f8\u00ff\u0100\u0131\u0149\u01c5's<|>!9\u0301") for _ in range(rnd.randint(1, 9))) for _ in range(5000)]
    words += ["ab" * 3000 + "\u00e9" * 700, "don't", "<|endoftext|>"]
    direct = [(w, t) for w in words if (t := merged(w, merge)) is not None]
    assert len(direct) > 1000
    for w, tokens in direct:
        assert [t.id for t in tokens] == lib.encode(w, add_special_tokens=False).ids, w


def test_long_texts_with_ids_as_strings_beside_other_columns(spark):
    rng = np.random.default_rng(3)
    long = " ".join(f"word{rng.integers(500)}" for _ in range(20_000)) + "\n" + "z" * 60_000
    assert len(long) > 150_000
    rows = [(str(i), t) for i, t in enumerate([long, "short\nshared line", None, "shared line"])]
    names = ("n_tokens", "n_bytes", "head", "piece", "start", "length", "part", "rank", "n_dropped", "sequence_id", "offset")
    docs = spark.createDataFrame([(*r, *range(len(names))) for r in rows], "doc_id string, text string, " + ", ".join(f"{n} int" for n in names))
    lib = tokenizer(default_path())
    n = {int(d): len(lib.encode(t or "", add_special_tokens=False).ids) for d, t in rows}
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs).collect()} == n
    pieces = packing.pack_documents(docs).collect()
    assert {d: sum(r.length for r in pieces if r.doc_id == d) for d in n} == {d: k + 1 for d, k in n.items()}
    digest = {int(r.doc_id): (r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.kept_digest(line_dedup.dedup_lines(docs, 2, keep="none")).collect()}
    assert digest[0] == (2, 0, hashlib.sha256(long.encode()).hexdigest()) and digest[1][:2] == (2, 1) and digest[3][:2] == (1, 1)
