"""The pipeline on a small corpus with planted junk, copies, lines and benchmark passages."""

import random
import zlib
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from swirlframe.llm.tokens import default_path, tokenizer

RNG = random.Random(12)
WORDS = ["".join(RNG.choice("aeioubdklmnrst") for _ in range(RNG.randrange(3, 9))) for _ in range(3000)]


def prose(n):
    out = []
    while n > 0:
        k = min(n, RNG.randrange(8, 20))
        out.append(" ".join(RNG.choice(WORDS) for _ in range(k)).capitalize() + ".")
        n -= k
    return "\n".join(" ".join(out[i : i + 4]) for i in range(0, len(out), 4))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    junk = lambda: " ".join(RNG.choice(["###", "BUY!!", "$$$", "%%%"]) + RNG.choice(WORDS).upper() + "!!" for _ in range(60))
    texts = [prose(RNG.randrange(60, 200)) for _ in range(120)]
    kind = ["clean"] * 120
    texts += [junk() for _ in range(60)]
    kind += ["junk"] * 60
    for i in range(8):  # an exact and a near copy of each
        texts.append(texts[i])
        w = texts[i].split(" ")
        w[5] = "changed"
        texts.append(" ".join(w))
        kind += [f"copy{i}"] * 2
    items = [prose(30).replace("\n", " ") for _ in range(5)]
    for it in items:
        texts.append(prose(60) + "\n" + it + "\n" + prose(40))
        kind.append("leak")
    line = "This very line is on a great many pages of the site."
    for _ in range(12):
        texts.append(prose(50) + "\n" + line + "\n" + prose(40))
        kind.append("lined")
    texts += [None, ""]
    kind += ["empty"] * 2
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(k != "junk"), 0) for i, k in enumerate(kind)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, texts, kind, line


def test_stages(spark, corpus):
    d, texts, kind, line = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns
        rows = out.collect()
        kept[name] = {r.doc_id: r.text for r in rows}
        assert len(rows) == len(kept[name])
        docs = spark.createDataFrame(rows, docs.schema)
    junk = {i for i, k in enumerate(kind) if k == "junk"}
    first = set(range(len(texts)))
    assert not junk & set(kept["quality"]) and {i for i, k in enumerate(kind) if k in ("clean", "lined", "leak")} <= set(kept["quality"])
    with_line = [i for i, t in kept["lines"].items() if t and line in t]
    assert with_line == [min(i for i, k in enumerate(kind) if k == "lined")]
    assert {i for i, k in enumerate(kind) if k == "clean"} <= {i for i, t in kept["lines"].items() if t == texts[i]}
    copies = {i for i, k in enumerate(kind) if k.startswith("copy")}
    assert not copies & set(kept["near_duplicates"]) and {i for i, k in enumerate(kind) if k == "clean"} <= set(kept["near_duplicates"])
    leaks = {i for i, k in enumerate(kind) if k == "leak"}
    assert leaks <= set(kept["near_duplicates"]) <= first and not leaks & set(kept["decontaminate"])
    assert set(kept["near_duplicates"]) - set(kept["decontaminate"]) == leaks


def test_run_packs_what_is_left(spark, corpus):
    d, texts, kind, line = corpus
    rows = corpus_pipeline.run(spark, d).collect()
    lib = tokenizer(default_path())
    by, ids = defaultdict(list), Counter()
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
        ids[r.doc_id] += r.length
        if kind[r.doc_id] == "clean":
            data = b"".join(i.to_bytes(4, "little") for i in [*lib.encode(texts[r.doc_id], add_special_tokens=False).ids, 1])
            assert r.ids_crc32 == zlib.crc32(data)
    assert {i for i, k in enumerate(kind) if k == "clean"} <= set(ids) and not {i for i, k in enumerate(kind) if k in ("junk", "leak")} & set(ids)
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(by) <= sum(ids.values()) // 4096 + 2


def test_empty_tables(spark, corpus, tmp_path):
    d, *_ = corpus
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{d}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
