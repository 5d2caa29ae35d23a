"""Decontamination and SimHash near-dedup against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from swirlframe.llm import decontaminate, simhash

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus():
    rng = random.Random(3)
    words = [a + b for a in "ab cd ef gh Éa ü 7".split() for b in "xyz tu k ß".split()]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [say(25) for _ in range(6)] + ["one", "two words", "THREE little words", "a b c d", "", None, say(10), "x x x x x x x x x x x x"]
    docs = [None, "", "...", "one", "Two-words two words", "three LITTLE words!", "x " * 30, "a b c d a b c", "a b c e d"]
    for i in range(40):
        docs.append(say(20) + "\n" + ((items[i % 6][: rng.randrange(40, 200)] + ", ") if i % 2 else "") + say(rng.randrange(30)))
    docs += docs[-3:]
    return docs, items


def brute_windows(docs, items):
    out = []
    windows = []
    for i, t in items:
        w = WORD.findall((t or "").translate(LOWER))
        windows += [(i, w[k : k + 10]) for k in range(max(1, len(w) - 9) if w else 0)]
    for d, t in docs:
        w = WORD.findall((t or "").translate(LOWER))
        hit, found = set(), set()
        for i, x in windows:
            for s in range(len(w) - len(x) + 1):
                if w[s : s + len(x)] == x:
                    hit |= set(range(s, s + len(x)))
                    found.add(str(i))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


@pytest.mark.parametrize("block", [1 << 20, 200])
def test_windows(spark, block):
    texts, items = corpus()
    docs = spark.createDataFrame([(i % 47, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, hits int, items int")
    bench = spark.createDataFrame([(i * 7, t) for i, t in enumerate(items)] + [(None, "one")], "item_id long, text string")
    got = decontaminate.contamination(decontaminate.find_windows(docs, bench, block_bytes=block))
    assert sorted(tuple(r) for r in got.collect()) == brute_windows([(i % 47, t) for i, t in enumerate(texts)], [(i * 7, t) for i, t in enumerate(items)])
    assert decontaminate.find_windows(docs.limit(0), bench).count() == 0
    assert all(not r.hits and not r.items for r in decontaminate.find_windows(docs, bench.limit(0)).collect())


@pytest.mark.parametrize("block", [1 << 20, 20])
def test_documents_of_one_id_stay_apart(spark, block):
    item = "a b c d e f g h i j k l"
    texts = [(1, item), (1, "m n " + item[:19] + " o p"), (None, item), (None, "l k j i h g f e d c b a"), (1, item), (2, "x " * 60_000 + item)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, item[4:]), (2, "q r s")], "item_id long, text string")
    got = decontaminate.find_windows(docs, bench, block_bytes=block).collect()
    want = [(1, 12, [(0, 12)], [1, 2]), (1, 14, [(2, 12)], [1]), (None, 12, [(0, 12)], [1, 2]), (None, 12, [], []), (1, 12, [(0, 12)], [1, 2]), (2, 60_012, [(60_000, 60_012)], [1, 2])]
    assert sorted(map(str, [(r.doc_id, r.n_words, [tuple(h) for h in r.hits], r["items"]) for r in got])) == sorted(map(str, want))


def brute_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not w:
        return 0
    sh = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_texts():
    rng = random.Random(5)
    out = [None, "", " \n", "one", "ONE", "two words", "É a b c"]
    for n in (30, 80, 200):
        for _ in range(12):
            base = [f"w{rng.randrange(500)}" for _ in range(n)]
            out.append(" ".join(base))
            for k in range(6):
                copy = list(base)
                for _ in range(k % 3):
                    copy[rng.randrange(n)] = "changed"
                out.append(" ".join(copy))
    return out


def brute_groups(prints, distance):
    ids, root = list(prints), {}
    for i in ids:
        root[i] = i

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x in ids:
        for y in ids:
            if x < y and bin(prints[x] ^ prints[y]).count("1") <= distance:
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash(spark):
    texts = near_texts()
    docs = spark.createDataFrame([(i, t, "a") for i, t in enumerate(texts)], "doc_id long, text string, fingerprint string")
    prints = {i: brute_print(t) for i, t in enumerate(texts)}
    groups = brute_groups(prints, 4)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (f"{p:016x}", groups[i]) for i, p in prints.items()}
    assert 20 < len(set(groups.values())) < len(texts) - 20
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_anchors_lose_no_link_within_the_distance(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(-(2**63), 2**63 - 1, 300)
    near = [int(x) for x in base]
    for x in base:
        flips = rng.choice(64, rng.integers(0, 9), replace=False)
        near.append(int(np.int64(x) ^ np.bitwise_xor.reduce(np.int64(1) << flips.astype(np.int64)) if len(flips) else x))
    near = sorted(set(near))
    nodes = spark.createDataFrame([(x, x) for x in near], "node long, w0 long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(nodes, simhash.exact_segments(4), 4)).collect()}
    want = brute_groups({x: x & (2**64 - 1) for x in near}, 4)
    assert {x: roots.get(x, x) for x in near} == want


def test_similar_groups(spark):
    rng = random.Random(8)
    texts, owner = [None, "", " "], [None] * 3
    for g in range(30):
        base = [f"w{rng.randrange(3000)}" for _ in range(150)]
        for k in range(3):
            copy = list(base)
            for _ in range(k):
                copy[rng.randrange(150)] = f"v{k}"
            texts.append(" ".join(copy))
            owner.append(g)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect()}
    assert all(got[i] == owner.index(g) for i, g in enumerate(owner) if g is not None)
    assert len(simhash.first_of_groups(docs, simhash.similar_groups(docs)).collect()) == 31  # texts without words have one fingerprint and are one group


def cut_texts(words):
    """60 texts of 100 shingles, each followed by its first ``words`` words."""
    rng = random.Random(9)
    bases = [[f"w{rng.randrange(3000)}" for _ in range(104)] for _ in range(60)]
    return [" ".join(x) for b in bases for x in (b, b[:words])]


def test_similar_groups_find_every_pair_at_the_threshold(spark):
    texts = cut_texts(84)  # 80 of 100 shingles
    docs = spark.createDataFrame([*enumerate(texts), (None, texts[2]), (None, "of no other")], "doc_id long, text string")
    rows = simhash.similar_groups(docs).collect()
    got = {r.doc_id: r.component_id for r in rows if r.doc_id is not None}
    assert got == {i: i - i % 2 for i in range(len(texts))} and len(rows) == len(texts) + 2
    assert simhash.similar_groups(docs.limit(0)).count() == 0


def test_similar_groups_link_nothing_below_the_threshold(spark):
    texts = cut_texts(83)  # 79 of 100 shingles
    # Fingerprints of these are alike: one shingle outweighs all that differ.
    texts += [" ".join(["a"] * 300 + [f"{k}x{i}" for i in range(20)]) for k in range(3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect()} == {i: i for i in range(len(texts))}


def brute_similar(texts, similarity=0.8):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x in range(len(texts)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if both >= similarity * (len(sets[x]) + len(sets[y]) - both) - 1e-9:
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in range(len(texts))}


def family(n, edits, length=150):
    """Copies of one text with 0 to ``edits`` changed words each, and a chain in which each differs a little from the last."""
    rng = random.Random(21)
    base = [f"w{rng.randrange(9000)}" for _ in range(length)]
    out = []
    for i in range(n):
        copy = list(base)
        for k in range(i % (edits + 1)):
            copy[rng.randrange(length)] = f"v{i}x{k}"
        out.append(" ".join(copy))
    chain = [f"c{rng.randrange(9000)}" for _ in range(length)]
    for i in range(12):
        chain = chain[4:] + [f"d{i}x{k}" for k in range(4)]
        out.append(" ".join(chain))
    return out


def test_similar_groups_of_a_large_family(spark):
    texts = family(90, 8)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect()}
    assert got == brute_similar(texts) and len(set(got.values())) > 20


def test_stars_are_as_many_as_rows_and_what_is_left_lies_across_components(spark):
    texts = family(200, 2)
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = simhash.prefix_rows(docs, 0.8, 5).cache()
    named = rows.withColumn("root", rows["node"])
    stars = simhash.shared_pairs(named, 0.8, stars=True)
    every = simhash.shared_pairs(named, 0.8, stars=False)
    assert stars.count() < rows.count() and every.count() > 20 * stars.count()
    assert stars.exceptAll(every).isEmpty()
    roots = simhash.components(stars)  # all of a family with two edits are similar to its centre
    rooted = rows.join(roots, "node", "left").selectExpr("shingle", "node", "n", "at", "coalesce(root, node) AS root")
    assert simhash.shared_pairs(rooted, 0.8, stars=False).count() < 200


def test_spanning_links_are_some_of_the_links():
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 400, 700), rng.integers(0, 400, 700)
    x, y = simhash._spanning(a, b)
    assert set(zip(x, y)) <= set(zip(a, b))
    want = brute_groups({int(i): 0 for i in np.union1d(a, b)}, -1)  # no links yet

    def roots(pairs):
        root = dict(want)

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for p, q in pairs:
            p, q = find(int(p)), find(int(q))
            root[max(p, q)] = min(p, q)
        return {i: find(i) for i in root}

    assert roots(zip(a, b)) == roots(zip(x, y)) and len(x) == len(want) - len(set(roots(zip(a, b)).values()))


def test_one_row_of_a_repeated_id_stays(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, "of no other"), (None, "x"), (None, "x")], "doc_id long, text string").withColumn("again", F.lit(1)).withColumn("gone", F.lit(2))
    got = simhash.first_of_groups(docs, simhash.similar_groups(docs))
    assert got.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in got.collect()) == [0, 0, 1, 3]


def test_fingerprints_of_long_texts_and_of_a_very_common_one(spark):
    rng = random.Random(8)
    long = " ".join(f"w{rng.randrange(400)}" for _ in range(30_000))
    assert len(long) > 120_000
    texts = {i: "the very same text of many documents here" for i in range(100, 500)} | {1: long, 2: long + " more", 3: "something else altogether in this one"}
    docs = spark.createDataFrame([(i, t, 7, "x") for i, t in texts.items()], "doc_id long, text string, salt int, common string")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert len(got) == len(texts) and {got[i][1] for i in range(100, 500)} == {100} and got[3][1] == 3
    assert got[1][1] == got[2][1] == 1 and len({got[i][0] for i in range(100, 500)}) == 1
