"""Operators 11 to 13 against brute force: multiset fingerprints, the prefix trie of conversations, whitened embeddings."""

import hashlib
import os
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from swirlframe.llm import fingerprints, prefix_trie, queries, whitening

SF = "/root/testdata/sf0.001"


# --- fingerprints ---


def windows(text: bytes) -> dict:
    """Counts of the up to 16 bytes that end at each byte of each line."""
    out = defaultdict(int)
    for line in text.split(b"\n"):
        for i in range(len(line)):
            out[line[max(0, i - 15) : i + 1]] += 1
    return out


def cosine(a: dict, b: dict) -> float:
    size = (sum(v * v for v in a.values()) * sum(v * v for v in b.values())) ** 0.5
    return sum(v * b.get(k, 0) for k, v in a.items()) / size if size else 0.0


def prose(rng, n):
    return "".join(rng.choice(["the ", "or ", "an", "ing ", "st", "é", "\n", "ion, ", "won", "der ", "漢字"]) for _ in range(n))


def test_a_fingerprint_is_a_homomorphic_sum():
    rng = random.Random(3)
    for _ in range(20):
        a, b = (prose(rng, rng.randint(0, 300)).encode() for _ in range(2))
        fa, fb = fingerprints.fingerprint(a), fingerprints.fingerprint(b)
        lines = (a + b"\n" + b).split(b"\n")
        rng.shuffle(lines)
        both = fingerprints.fingerprint(b"\n\n".join(lines))
        assert np.array_equal(both, fingerprints.combined(fa, fb))
        assert np.array_equal(fingerprints.combined(both, fb, -1), fa)
        assert abs(fingerprints.likeness(fa, both) - cosine(windows(a), windows(a + b"\n" + b))) < 0.3
    assert len({fingerprints.fingerprint(str(i).encode()).tobytes() for i in range(3000)}) == 3000
    assert fingerprints.likeness(fingerprints.fingerprint(b""), fingerprints.fingerprint(None)) == 1.0
    assert fingerprints.likeness(fingerprints.fingerprint(b""), fingerprints.fingerprint(b"x")) == 0.0


def test_long_texts_are_hashed_in_parts(monkeypatch):
    rng = random.Random(5)
    text = prose(rng, 60_000).encode()
    assert len(text) > 150_000
    whole = fingerprints.fingerprint(text)
    monkeypatch.setattr(fingerprints, "_STEP", 1000)
    assert np.array_equal(whole, fingerprints.fingerprint(text))


def plain_edits(rows):
    """(doc_id, n_chars, sha256) by the definition; ties by the hash that the rows bring."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2]), reverse=True)
    out = []
    for (d, t, _), (_, nxt, _) in zip(rows, rows[1:] + rows[:1], strict=True):
        n = len(t)
        out.append((d, n, hashlib.sha256((t[: n - n // 2] + nxt[: n // 2]).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("range_bytes", [1 << 25, 3000, 50])
def test_edited_texts(spark, range_bytes):
    rng = random.Random(1)
    rows = [(i * 7 - 300, prose(rng, rng.randint(0, 200)), "x", 1.0) for i in range(120)]
    rows += [(5, None, "y", None), (6, "", None, None), (None, "no id", "z", 0.0), (9, "twice", "a", 0.0), (9, "twice", "b", 0.0), (9, "other", "c", 0.0), (10**12, prose(rng, 30_000), "long", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, range string, near_next double").repartition(5)
    told = [(r[0], r[1], r[2]) for r in docs.select("doc_id", F.coalesce("text", F.lit("")), F.xxhash64(F.coalesce("text", F.lit("")))).collect()]
    got = fingerprints.edited(docs, range_bytes=range_bytes).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=key) == sorted(plain_edits(told), key=key)
    texts = defaultdict(set)
    for d, t, _ in told:
        texts[t].add(d)
    prints = {(r.doc_id, r.n_chars, bytes(r.fingerprint)) for r in got}
    assert prints == {(d, len(t), fingerprints.fingerprint(t.encode()).tobytes()) for d, t, _ in told}
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    twice = [r for r in got if r.doc_id == 9 and r.near_next == 1.0]
    assert len(twice) == 1  # of the two equal rows one is followed by the other


def test_edges_of_fingerprints(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert fingerprints.edited(empty).collect() == [] == fingerprints.fingerprints(empty).collect()
    one = fingerprints.edited(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and one.near_next == 1.0
    same = spark.createDataFrame([(3, "same\ntext"), (2, "same\ntext"), (1, "text\nsame")], "doc_id long, text string")
    assert {r.near_next for r in fingerprints.edited(same).collect()} == {1.0}


def test_prints_change_and_add_up(spark):
    docs = spark.createDataFrame([(1, "a b c\nold line\nkept", "s"), (2, "new line\nkept\na b c", "s"), (3, None, "t")], "doc_id long, text string, source string")
    prints = fingerprints.fingerprints(docs).join(docs.drop("text"), "doc_id")
    edits = prints.withColumn("removed", F.when(F.col("doc_id") == 1, "old line")).withColumn("inserted", F.when(F.col("doc_id") == 1, "new line"))
    after = {r.doc_id: bytes(r.fingerprint) for r in fingerprints.changed(edits, "removed", "inserted").collect()}
    assert after[1] == after[2] == fingerprints.fingerprint(b"kept\nnew line\na b c").tobytes() and after[3] == fingerprints.fingerprint(b"").tobytes()
    groups = {r.source: bytes(r.fingerprint) for r in fingerprints.added_up(prints, "source").collect()}
    assert groups == {"s": fingerprints.fingerprint(b"a b c\nold line\nkept\nnew line\nkept\na b c").tobytes(), "t": fingerprints.fingerprint(None).tobytes()}


def test_op11_query(spark):
    got = queries.op11_multiset_fingerprints(spark, SF).collect()
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")), F.lit(0)).collect()
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == sorted(plain_edits([tuple(r) for r in rows]))
    assert sum(r.near_edited > r.near_next for r in got) >= 0.95 * len(got)


# --- conversations ---


def plain_trie(rows):
    """Every node by definition, from (conv_id, turn, role, text)."""
    conv = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            conv[c].append((t is not None, t or 0, r or "", x or ""))
    conv = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in conv.items()}
    nodes, kids = defaultdict(list), defaultdict(list)
    for c in conv:
        h = zlib.crc32(str(c).encode()) % 9
        seq = tuple(conv.get(c - c % 5, [])[:h] + conv[c][h:])
        for d in range(len(seq) + 1):
            nodes[seq[:d]].append((c, len(seq) == d))
    for k in nodes:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved, out = {}, {}, []
    for k in sorted(nodes, key=len, reverse=True):
        leaves[k] = sum(leaves[c] for c in kids[k]) or 1
        saved[k] = sum(saved[c] for c in kids[k]) + ((len(nodes[k]) - 1) * len(k[-1][1].encode()) if k else 0)
    for k, v in nodes.items():
        up = min(c for c, _ in nodes[k[:-1]]) if k else None
        ends = ",".join(str(c) for c in sorted(c for c, e in v if e))
        out.append((min(c for c, _ in v), len(k), up, len(v), len(kids[k]), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return ordered(out)


def ordered(rows):
    return sorted(rows, key=lambda r: tuple(-(1 << 62) if x is None else x for x in r))


def made_conversations():
    rng = random.Random(8)
    texts = ["", "hi", "grüße", "a longer turn\nof two lines", "漢", "x" * 1000]
    rows = []
    for c in range(90):
        shared = c % 3 == 0  # a third of all conversations begin alike
        for t in range(rng.randint(1, 10)):
            x = "common" if shared and t < 6 else rng.choice(texts)
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", x))
    for c in range(200, 260):  # copies
        rows += [(c, t, "user", f"copy {t}") for t in range(4)]
    rows += [(301, None, None, None), (301, 0, "user", None), (302, 1, "user", "tie"), (302, 1, "assistant", "tie"), (302, 1, "assistant", "tie"), (303, 5, "", ""), (None, 0, "user", "lost"), (7001, 3, "user", "y" * 100_000)]
    rows += [(400, t, "user", f"deep {t}") for t in range(600)] + [(405, t, "user", f"deep {t}") for t in range(600)]
    return rows


@pytest.mark.parametrize("limits", [(20_000, 400_000), (10, 10**9), (1, 1), (10**9, 50)])
def test_prefix_trie(spark, limits):
    rows = made_conversations()
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "conv_id long, turn long, role string, text string, chain string, n int")
    got = ordered(tuple(r) for r in prefix_trie.prefix_trie(df, *limits).collect())
    assert got == plain_trie(rows)


def test_limits_of_the_upper_nodes_double(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BROADCAST_BYTES", 1024)
    rows = made_conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert ordered(tuple(r) for r in prefix_trie.prefix_trie(df, 1, 1).collect()) == plain_trie(rows)


def test_chunks_of_equal_conversations_join_in_order(spark, monkeypatch):
    rows = [(c, t, "user", f"copy {t}") for c in [*range(3000, 3100), *range(9990, 10040)] for t in range(10)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert ordered(tuple(r) for r in prefix_trie.prefix_trie(df).collect()) == plain_trie(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_no_conversations(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.prefix_trie(empty).collect() == []
    turnless = spark.createDataFrame([(9, 0, "user", "only")], "conv_id long, turn long, role string, text string")  # its h is more than 0, conversation 5 is absent
    assert ordered(tuple(r) for r in prefix_trie.prefix_trie(turnless).collect()) == plain_trie([(9, 0, "user", "only")])


def test_op12_query_and_its_sql(spark):
    import duckdb

    path = f"{SF}/conversations.parquet"
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW conversations AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    want = plain_trie(duck.sql("SELECT conv_id, turn, role, text FROM conversations").fetchall())
    assert ordered(tuple(r) for r in queries.op12_prefix_trie(spark, SF).collect()) == want == ordered(duck.sql(queries.OP12_SQL).fetchall())


# --- whitening ---


def plain_whitening(rows):
    """{vec_id: (deviation, whitened)}, explained, by numpy's eigenvalues of the exact covariance."""
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for _, v in rows], dtype=object)
    n, s = len(x), x.sum(axis=0)
    far = ((n * x - s) ** 2).sum(axis=1)
    centred = ((n * x - s) / n).astype(float)
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    k = min(32, int((e > e[0] * 1e-12).sum()))
    return [int(f) for f in far], centred @ v[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


def check_whitening(got, rows):
    far, white, share = plain_whitening(rows)
    by = defaultdict(dict)
    for r in got:
        by[r.vec_id][r.component] = r
    assert len(got) == white.size
    for i, (vec_id, _) in enumerate(rows):
        assert sorted(by[vec_id]) == list(range(1, white.shape[1] + 1))
        for k, r in by[vec_id].items():
            assert r.n == len(rows) and r.deviation == far[i] and r.identity_error < 1e-6 and abs(r.explained / share[k - 1] - 1) < 1e-6
    for k in range(white.shape[1]):
        mine = np.array([by[v][k + 1].whitened for v, _ in rows])
        assert min(np.abs(mine - white[:, k]).max(), np.abs(mine + white[:, k]).max()) < 1e-6


def test_op13_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check_whitening(queries.op13_whitening(spark, SF).collect(), rows)


def test_odd_vectors(spark):
    rng = np.random.default_rng(4)
    good = [(i, (rng.normal(size=5) * [1, 20, 300, 4, 5000]).tolist()) for i in range(40)]
    flat = [(i, [*v[:4], 2 * v[3]]) for i, v in good]  # whatever the rank, at most five components
    bad = [(100, None), (101, []), (102, [1.0, None, 2.0, 3.0, 4.0]), (103, [1.0, float("nan"), 0.0, 0.0, 0.0]), (104, [float("inf")] * 5), (105, [1.0, 2.0]), (106, [1e300] * 5)]
    for rows in (good, flat):
        df = spark.createDataFrame([(*r, 1, "v") for r in rows + bad], "vec_id long, embedding array<double>, n int, v string").repartition(3)
        check_whitening(whitening.whiten(df).collect(), rows)


def test_repeated_and_null_ids_count_each(spark):
    rows = [(1, [0.0, 1.0]), (1, [0.0, 1.0]), (None, [2.0, 0.5]), (4, [1.0, 3.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    far, white, _ = plain_whitening(rows)
    assert sorted((r.deviation, round(abs(r.whitened), 9)) for r in got) == sorted((f, round(abs(w), 9)) for f, ws in zip(far, white, strict=True) for w in ws)


def test_large_entries_stay_exact(spark):
    rows = [(i, [float(v * 10**9 + i), float(i * i)]) for i, v in enumerate([3, -7, 11, 2])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    far, _, _ = plain_whitening(rows)
    assert {r.vec_id: r.deviation for r in got} == {i: (f if f < 1 << 63 else None) for i, f in enumerate(far)}


def test_dimensions_that_follow_from_others_are_no_components(spark):
    rng = np.random.default_rng(9)
    for trial in range(6):
        base = np.floor(rng.normal(size=(50, 3)) * 10 ** rng.integers(0, 4, 3)) / 64
        rows = [(i, [*v, v[0] + v[1], v[2], 3 * v[1] - v[2], 0.5]) for i, v in enumerate(base.tolist())]
        got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
        assert {r.component for r in got} <= {1, 2, 3} and max(r.identity_error for r in got) < 1e-4, trial
        check_whitening(got, rows)


def test_no_variance(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(i, [0.25, 7.0]) for i in range(5)], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [0.25, 7.0])], schema)).collect() == []
    one = whitening.whiten(spark.createDataFrame([(i, [0.25, float(i)]) for i in range(5)], schema)).collect()
    assert {r.component for r in one} == {1} and all(abs(r.explained - 1) < 1e-9 for r in one)
