"""Token counts: pieces are counted once per distinct pre-token, then joined to per-document frequencies.

1. One pass over all documents gives each task's distinct pre-tokens with frequencies; they are summed.
2. Each distinct pre-token goes through the tokenizer once: (word, n_pieces). No ids are kept.
3. The most frequent pre-tokens (HEAD of them, a fixed bound) are broadcast; a second pass multiplies each
   document's frequencies with them at once. All others are shuffled as (row, word, frequency) and joined, so
   counts are exact however many pre-tokens there are. A word of the tail is rare by construction: no hot key.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows stay; an empty table stays empty. Ids are integers (others
raise Spark's cast error); a text may be of any length and is cut whole, one at a time; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, only, written
from .tokens import default_path, merged, merges, pre_tokens, tokenizer

#: Pre-tokens in the broadcast part, and the bytes of text that a broadcast word may have.
HEAD, HEAD_WORD_BYTES = 1 << 17, 64


def piece_counts(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(word string, n long, pieces int): every distinct pre-token with its corpus frequency and number of pieces."""

    def words(rows: Iterator[tuple]) -> Iterator[tuple]:
        seen: Counter = Counter()
        for (body,) in rows:
            seen.update(pre_tokens((body or b"").decode(), path))
            if len(seen) > 300_000:
                yield from seen.items()
                seen = Counter()
        yield from seen.items()

    def pieces(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, merge = tokenizer(path), merges(path)
        for part in parts:
            for at in range(0, part.num_rows, 4096):
                some = part.slice(at, 4096)
                words = some.column(0).to_pylist()
                got = [merged(w, merge) if merge else None for w in words]
                rest = iter(library.encode_batch_fast([w for w, g in zip(words, got, strict=True) if g is None], add_special_tokens=False))
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array([len(next(rest) if g is None else g) for g in got], pa.int32())], names=["word", "n", "pieces"])

    found = map_rows(only(docs, text=text), words, "word string, n long", pa.schema([("word", pa.string()), ("n", pa.int64())]))
    return found.groupBy("word").agg(F.sum("n").alias("n")).mapInArrow(pieces, "word string, n long, pieces int")


def count_tokens(docs: DataFrame, path: str | None = None, text: str = "text", doc_id: str = "doc_id", head: int = HEAD) -> DataFrame:
    """doc_id, n_bytes, n_tokens (long) of each row of ``docs``."""
    path = path or default_path()
    spark = docs.sparkSession
    counts = written(piece_counts(docs, path, text), "piece-counts")
    top = counts.filter(F.octet_length("word") <= HEAD_WORD_BYTES).orderBy(F.desc("n"), "word").limit(head)  # at most head words of bounded length
    shared = spark.sparkContext.broadcast({r.word: r.pieces for r in top.select("word", "pieces").toLocalIterator()})

    def tally(rows: Iterator[tuple]) -> Iterator[tuple]:
        known, base = shared.value, TaskContext.get().partitionId() << 40
        for i, (owner, body) in enumerate(rows):
            body = body or b""
            words = pre_tokens(body.decode(), path)
            got = list(map(known.get, words))
            tail: list[tuple[str, int]] = []
            if None in got:
                tail = list(Counter(w for w, n in zip(words, got, strict=True) if n is None).items())
                total = sum(n for n in got if n is not None)
            else:
                total = sum(got)
            yield base + i, owner, len(body), total, [{"word": w, "f": f} for w, f in tail]

    kind = pa.list_(pa.struct([("word", pa.string()), ("f", pa.int64())]))
    rows = map_rows(only(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long")), tally, "row long, doc_id long, n_bytes long, head long, tail array<struct<word:string,f:long>>", pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("head", pa.int64()), ("tail", kind)]))
    rows = written(rows, "token-rows")  # rows' numbers are then fixed
    tail = rows.select("row", F.explode("tail").alias("t")).select("row", "t.word", "t.f")
    rest = tail.join(counts.select("word", "pieces"), "word").groupBy("row").agg(F.sum(F.col("f") * F.col("pieces")).alias("rest"))
    return rows.select("row", "doc_id", "n_bytes", "head").join(rest, "row", "left").select("doc_id", "n_bytes", (F.col("head") + F.coalesce("rest", F.lit(0))).alias("n_tokens"))
