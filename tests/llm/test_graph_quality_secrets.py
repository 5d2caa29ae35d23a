"""Graph index by recall, quality classifier by held-out accuracy, secret scans against plain regular expressions."""

import math
import random
import re
import zlib

import numpy as np
import pytest

from swirlframe.llm import graph_index, quality, secrets


def brute_nearest(rows, asked, k):
    out = {}
    for q, v in asked:
        near = sorted((math.dist(v, w), i) for i, w in rows if i != q and len(w) == len(v))
        out[q] = near[:k]
    return out


@pytest.mark.parametrize("shard_rows", [150, 5000])
def test_recall(spark, shard_rows):
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 1, (12, 24))
    x = (centres[rng.integers(0, 12, 900)] + rng.normal(0, 0.5, (900, 24))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = graph_index.nearest(df, df.filter("vec_id % 10 = 0"), 10, shard_rows).collect()
    want = brute_nearest(rows, [r for r in rows if r[0] % 10 == 0], 10)
    hits = sum((r.vec_id in {i for _, i in want[r.query_id]}) for r in got)
    assert len(got) == 900 and hits >= 0.95 * 900
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        by.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r.score == pytest.approx(math.dist(x[r.query_id].astype(float), x[r.vec_id].astype(float)), rel=1e-12)
    assert all(v == sorted(v) and len(v) == 10 for v in by.values())


def test_recall_of_the_largest_shard():
    """As many rows of 64 dimensions as a shard can have, without any structure: the beam that the size gets has to find nine in ten."""
    rng = np.random.default_rng(11)
    n = min(graph_index.MOST_ROWS, graph_index.SHARD_BYTES // (8 * 64))
    x = rng.normal(size=(n, 64))
    asked = x[::400]
    got, score = graph_index.Graph(x).search(asked, 11)
    hits = 0
    for q, ids, d in zip(asked, got, score, strict=True):
        far = np.sqrt(((x - q) ** 2).sum(axis=1))
        hits += len(set(np.argsort(far, kind="stable")[1:11].tolist()) & set(ids.tolist()))  # the row itself doesn't count
        assert np.allclose(d, far[ids])
    assert hits >= 0.9 * 10 * len(asked), hits / (10 * len(asked))


@pytest.mark.parametrize("size", [1e25, 1e300, 1e-300])
def test_neighbours_of_any_magnitude(spark, size):
    rng = np.random.default_rng(7)
    x = rng.normal(0, 1, (60, 6))
    df = spark.createDataFrame([(i, (v * size).tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = graph_index.nearest(df, df.filter("vec_id < 5"), 3).collect()
    want = brute_nearest(list(enumerate(x.tolist())), list(enumerate(x.tolist()))[:5], 3)
    assert {(r.query_id, r["rank"]): r.vec_id for r in got} == {(q, k + 1): i for q, near in want.items() for k, (_, i) in enumerate(near)}
    assert all(r.score == pytest.approx(size * want[r.query_id][r["rank"] - 1][0], rel=1e-9) for r in got)


def test_an_id_of_several_vectors_comes_once(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 1.0]), (2, [1.0, 0.5]), (3, [4.0, 4.0]), (1, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in graph_index.nearest(df, df.filter("vec_id = 1"), 3).collect()]
    assert sorted(got) == [(1, 1, 2, 0.5), (1, 2, 3, 5.0)]


def test_neighbours_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (2, [0.0, 1.0])]
    rows += [(100 + i, [1.0, 0.0]) for i in range(40)]
    df = spark.createDataFrame([(i, v, 7) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in graph_index.nearest(df, df.filter("vec_id < 10"), 3).collect()]
    s = math.sqrt(2)
    assert sorted(got) == [(0, 1, 1, 0.0), (0, 2, 100, 0.0), (0, 3, 101, 0.0), (1, 1, 0, 0.0), (1, 2, 100, 0.0), (1, 3, 101, 0.0), (2, 1, 0, s), (2, 2, 1, s), (2, 3, 100, s)]
    assert graph_index.nearest(df.limit(0), df, 3).count() == 0
    assert graph_index.nearest(df, df.limit(0), 3).count() == 0


def test_interactions_in_linear_time_equal_all_pairs():
    m = quality.Machine(40, 3)
    rng = np.random.default_rng(0)
    m.w, m.bias = rng.normal(size=40), 0.3
    words, cells = np.array([1, 5, 7]), np.array([30, 33])
    x = {**{i: 1 / math.sqrt(3) for i in words}, **{i: 1 / math.sqrt(2) for i in cells}}
    pairs = sum(m.v[i] @ m.v[j] * x[i] * x[j] for i in x for j in x if i < j)
    assert m.raw(words, cells) == pytest.approx(m.bias + sum(m.w[i] * x[i] for i in x) + pairs)


def test_quality(spark):
    rng = random.Random(1)
    good = lambda: " ".join(rng.choice(["river", "stone", "light", "walks", "near"]) for _ in range(40)) + "."
    bad = lambda: "".join(rng.choice(["BUY!!", "$$$", "click", "###", "NOW!!"]) + " " for _ in range(40))
    texts = [(i, bad() if i % 4 == 0 else good()) for i in range(400)]
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t in texts] + [(900, None, None, None), (901, "", "x", 2.0), (None, "a", "b", 1.0)], "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([(i, 0 if i % 4 == 0 else 1, 0) for i, _ in texts] + [(None, 1, 0), (1, 0, 0), (2, None, 0), (5, 7, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.score for r in quality.scores(docs, labels).collect()}
    assert len(got) == 403 and all(0 <= s <= 1 for s in got.values())
    test = [i for i, _ in texts if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((got[i] >= 0.5) == bool(i % 4) for i in test) >= 0.98 * len(test)
    assert {r.score for r in quality.scores(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.scores(docs.limit(0), labels).count() == 0
    rows = quality.training_rows(docs, labels, train_rows=50)
    assert len(rows) == 50
    assert len(quality.training_rows(docs.unionAll(docs), labels, train_rows=5)) == 5
    assert quality.scores(docs, labels, score="s").columns == [*docs.columns, "s"]


def brute_score(machine, text, n_chars):
    """Every feature and every pair of them, one by one."""
    words = sorted(set((text or "").lower().encode().split()))
    cells = quality.Features(quality.BUCKETS, 1).of((text or "").encode(), (n_chars,))[1]
    x = [(zlib.crc32(w) % quality.BUCKETS, 1 / math.sqrt(max(1, len(words)))) for w in words] + [(int(c), 1 / math.sqrt(len(cells))) for c in cells]
    z = machine.bias + sum(machine.w[i] * a for i, a in x)
    z += sum(float(machine.v[i] @ machine.v[j]) * a * b for k, (i, a) in enumerate(x) for j, b in x[:k])
    return 1 / (1 + math.exp(-z))


def test_scores_equal_the_sum_over_all_pairs(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["river", "Stone", "light!", "$$$", "né", "near"]) + str(rng.randrange(30)) for _ in range(n)) for n in range(1, 40)] + [None, "", "w" * 60_000, "a b " * 20_000]
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(len(texts))], "doc_id long, quality int")
    fit = quality.training_rows(docs, labels, ("n_chars",))
    machine = quality.Machine(quality.Features(quality.BUCKETS, 1).size).fit(fit)
    got = {r.doc_id: r.score for r in quality.scores(docs, labels, ("n_chars",)).collect()}
    assert all(got[i] == pytest.approx(brute_score(machine, t, len(t or "")), abs=1e-5) for i, t in enumerate(texts))


def brute_secrets(t):
    t = t or ""
    out = []
    for m in re.finditer(r"((?:[pP][aA][sS][sS][wW][oO][rR][dD])|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    out += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return [x for *_, x in sorted(out)]


def test_secrets(spark):
    rng = random.Random(2)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    texts = [None, "", "nothing here", "é token = \"" + hexes(40) + "\" ü", "PASSWORD: 'short'", "Secret==abcdefgh12", "api_key:x api-key=12345678 ApiKey = 'Zz+/_.=-99'", "AKIAABCDEFGH2345 AKIA123", "ſecret=12345678901 toKen=12345678901", hexes(31) + "g" + hexes(33), "4111111111111111 plainwordswithoutanydigits", hexes(5000)]
    texts += [f"日本 token = \"{hexes(40)}\"" for _ in range(60)] + ["left alone: " + hexes(28) + " and " + hexes(30)] * 2
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, spans int")
    found = {r.doc_id: r for r in secrets.secret_digest(secrets.scan_secrets(docs)).collect()}
    for i, t in enumerate(texts):
        want = brute_secrets(t)
        told = [x for x in found[i].spans.split(",") if x]
        assert [x for x in told if not x.startswith("format")] == want, t
        assert found[i].base_sha256 == secrets.digest(want)
        assert [found[i].n_assign, found[i].n_access, found[i].n_hex] == [sum(x.startswith(k) for x in want) for k in ("assign", "access", "hex")]
    assert [x.split(":")[0] for x in found[len(texts) - 1].spans.split(",")] == ["format", "format"]
    assert found[10].spans == found[2].spans == ""
    assert secrets.scan_secrets(docs.limit(0)).count() == 0


def test_merged_automaton_generalises():
    rng = random.Random(3)
    make = lambda: "AB" + "".join(rng.choice("0123456789") for _ in range(12))
    a = secrets.Automaton([make().encode() for _ in range(300)])
    assert len(a.states) < 40
    assert a.likelihood(make().encode()) > 1.5 > 0 > a.likelihood(b"zzqqWWkkMMppLL")
    s, at, total = make().encode(), 0, 0.0
    for c in s:  # by the automaton's tables alone
        p = a.seen[at].get(c, 0) / (a.total[at] - a.ends[at])
        total += math.log((0.98 * p + 0.02 / 68) * 68)
        at = a.next[at][c]
    assert a.likelihood(s) == pytest.approx(total / len(s), rel=1e-9)


def test_added_spans_by_precision_and_recall(spark):
    rng = random.Random(6)
    make = lambda: "sk_" + "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(24))
    word = lambda: "".join(rng.choice("aeioubdklmnrst") for _ in range(rng.randrange(2, 16)))
    prose = lambda n: " ".join(word() for _ in range(n)) + "."
    texts, planted = [], set()
    for i in range(300):
        key = make()
        if i % 3:
            texts.append(f"{prose(20)} token = {key} {prose(20)}")
        else:
            head = prose(20) + " see "
            planted.add((i, len(head), len(head) + len(key)))
            texts.append(f"{head}{key}. {prose(20)} 2024-05-06T10:11:12 version-1.20.33 item_{i} {rng.randrange(10**15, 10**16)}")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, s.start, s.end) for r in secrets.scan_secrets(docs).collect() for s in r.spans if s.kind == "format"}
    assert len(got & planted) >= 0.9 * len(planted) and len(got & planted) >= 0.95 * len(got)


def test_lengths_by_the_chain_rule():
    rng = random.Random(5)
    strings = [b"x" * rng.choice([12, 12, 12, 20]) for _ in range(80)]
    model = secrets.Lengths(strings)
    n = secrets.LONGEST - secrets.LEAST + 1
    for length in (8, 12, 13, 20, 256):
        share = 0.98 * sum(len(s) == length for s in strings) / 80 + 0.02 / n
        assert model.likelihood(length) == pytest.approx(math.log(share * n))
    assert model.likelihood(5000) == 0.0


def test_short_words_of_a_keys_alphabet_are_refused():
    rng = random.Random(1)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n)).encode()
    formats = secrets.Formats({0: [hexes(40) for _ in range(130)]})
    words = [b"facade12", b"deadbeef1", b"decade1990", b"00000000a", b"2e10000000", b"20240506a", b"e5b7c31", b"1a2b3c4d5e", b"cafe2024", b"f00dbabe", b"5eedbeef99"]
    assert not any(formats.fits(w) for w in words)
    assert not any(formats.fits(hexes(n)) for n in (7, 8, 10, 12) for _ in range(200))
    assert all(formats.fits(hexes(40)) for _ in range(200))


def test_bare_keys_of_forty_characters_among_hexadecimal_words(spark):
    rng = random.Random(12)
    key = lambda: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40))
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    noise = lambda: " ".join(rng.choice([f"facade{rng.randrange(99)}", f"decade19{rng.randrange(10, 99)}", hexes(rng.choice([7, 8, 10, 12])), "2024-05-06T10:11:12", f"build-{rng.randrange(10**8)}", "node12.cluster.example.org", f"0x{hexes(8)}", "version-1.20.33", "internationalisation", f"item_{rng.randrange(10**6)}", "key4/part7/page12"]) for _ in range(30))
    texts, planted = [], set()
    for i in range(240):
        k = key()
        if i % 3:
            texts.append(f"{noise()} secret = {k} {noise()}")
        else:
            head = noise() + " "
            planted.add((i, len(head), len(head) + 40))
            texts.append(f"{head}{k} {noise()}")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, s.start, s.end) for r in secrets.scan_secrets(docs).collect() for s in r.spans if s.kind == "format"}
    assert len(got & planted) >= 0.9 * len(planted) and len(got & planted) >= 0.97 * len(got), (len(got), len(got & planted))


def test_secrets_in_long_texts_beside_other_columns(spark):
    long = "plain words " * 9000 + "token = abcdef0123456789 " + "x" * 120_000
    docs = spark.createDataFrame([("7", long, "a", 1), (None, None, "b", 2)], "doc_id string, text string, spans string, n_assign int")
    found = {r.doc_id: r for r in secrets.secret_digest(secrets.scan_secrets(docs)).collect()}
    assert found[7].n_assign == 1 and found[None].spans == "" and ",".join(brute_secrets(long)) == found[7].spans
