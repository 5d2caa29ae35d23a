"""Conversation prefix trie: conversations that begin with the same turns share nodes.

1. Turns become digests of (role, text) and byte counts on the JVM, so no text is shuffled. A conversation is rebuilt with the one
   whose first turns it takes: the turns of ids with one c - c % GROUP meet in a task, dealt by ranges of ids, and stream by in order. Each gives the
   chain of its prefixes' digests. A task joins the ids of equal conversations, ascending, so copies leave it as one row.
2. Rows of equal conversations meet by the digest of the whole, and SHA-256 runs over their ids in order of the ranges, a
   row at a time: what is left is a row for each different conversation, with its number of members, its smallest and the hash.
3. These are hash-partitioned by the digest of the first turn, and each first turn gets its trie of pointers (dictionaries of children)
   in ``applyInPandas``, several of them in a call; an iterative postorder sums up leaves and saved bytes. A group of more than ``most`` conversations or ``MOST_TURNS`` turns is
   dealt again by its next turn, and so on. Counts fall along a path, so one count of all prefixes of the oversized groups finds how
   deep that goes for all of them at once (otherwise a group that agrees on 400 turns would take 400 rounds).
4. The nodes above the dealt ones, and the root, are few (their list is held to BROADCAST_BYTES by doubling the two limits): they become a
   trie of their own, over the sums that the dealt ones add up to.

Defined results: turns of one conversation are taken by turn (null first), then role, then digest of the text; null role and text are empty; rows
without conv_id belong to no conversation; c - c % GROUP is toward zero; a conversation all of whose turns are left out is a member of
the root; an empty table gives no rows; ids and turns are integers; texts may be of any length; other columns are not read. Nodes are told apart by
128-bit digests. A conversation has to fit in a task (some 100 bytes a turn, without its texts).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, batches, only, written

#: Conversations and turns of a group at most; beyond either it is dealt by its next turn.
MOST, MOST_TURNS = 20_000, 400_000
#: Different conversations, on average, of the first turns that are dealt to one task's group together.
TOGETHER = 4096
GROUP, HEADS = 5, 9
EMPTY = hashlib.sha256(b"").hexdigest()
_D = 16  # bytes of a digest
_FLUSH = 20_000
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def taken(conv_id: Column) -> Column:
    """How many turns of its group's first conversation one begins with."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % HEADS).cast("int")


def turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """base, conv_id, head, turn, role, digest (16 bytes), size: a row a turn, without texts."""
    rows = only(conversations, conv_id=conv_id, turn=turn, role=role, text=text).filter("conv_id IS NOT NULL")
    role_, text_ = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    c = F.col("conv_id").cast("long")
    told = F.concat(F.length(role_).cast("string"), F.lit(":"), role_, text_)
    return rows.select((c - c % GROUP).alias("base"), c.alias("conv_id"), taken(c).alias("head"), F.col("turn").cast("long").alias("turn"), F.substring(role_, 1, 64).alias("role"), F.unhex(F.md5(told)).alias("digest"), F.octet_length(text_).cast("long").alias("size"))


def _chain(steps: list[tuple[bytes, int]]) -> tuple[bytes, bytes]:
    """Digests of all prefixes, and the turns' sizes (big-endian), as bytes."""
    at, out = b"", []
    for d, _ in steps:
        at = hashlib.md5(at + d, usedforsecurity=False).digest()
        out.append(at)
    return b"".join(out), np.array([s for _, s in steps], ">i8").tobytes()


def rebuilt(rows: DataFrame) -> DataFrame:
    """leaf binary, first long, n long, ids string, chain binary, sizes binary: conversations, equal ones of a task joined, ids ascending."""
    dealt = rows.repartitionByRange("base").sortWithinPartitions("base", F.col("conv_id") != F.col("base"), "conv_id", F.asc_nulls_first("turn"), "role", "digest")
    arrow = pa.schema([("leaf", pa.binary()), ("first", pa.int64()), ("n", pa.int64()), ("ids", pa.string()), ("chain", pa.binary()), ("sizes", pa.binary())])

    def conversations(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list]]:
        """(id, its turns after the exchange), ids ascending."""
        base, head, block = None, [], []
        conv, own, kept = None, [], 0

        def done() -> None:
            nonlocal head
            if conv is not None:
                if conv == base:
                    head = own[: HEADS - 1]
                block.append((conv, head[:kept] + own[kept:]))

        for part in parts:
            for b, c, h, _, _, d, s in zip(*(x.to_pylist() for x in part.columns), strict=True):
                if c != conv:
                    done()
                    if b != base:
                        yield from sorted(block)
                        base, head, block = b, [], []
                    conv, own, kept = c, [], h
                own.append((d, s))
        done()
        yield from sorted(block)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows_() -> Iterator[tuple]:
            held: dict[bytes, list] = {}
            for c, steps in conversations(parts):
                chain, sizes = _chain(steps)
                leaf = chain[-_D:]
                if leaf in held:
                    held[leaf][1].append(c)
                else:
                    held[leaf] = [c, [c], chain, sizes]
                if len(held) >= _FLUSH or len(held[leaf][1]) >= 1_000_000:
                    yield from told(held)
                    held = {}
            yield from told(held)

        def told(held: dict) -> Iterator[tuple]:
            for leaf, (first, ids, chain, sizes) in held.items():
                yield leaf, first, len(ids), ",".join(map(str, ids)), chain, sizes

        yield from batches(rows_(), arrow, 2048)

    return dealt.mapInArrow(run, "leaf binary, first long, n long, ids string, chain binary, sizes binary")


def different(rows: DataFrame) -> DataFrame:
    """leaf, first (smallest member), n, ends, chain, sizes: one row for each different conversation."""
    arrow = pa.schema([("leaf", pa.binary()), ("first", pa.int64()), ("n", pa.int64()), ("ends", pa.string()), ("chain", pa.binary()), ("sizes", pa.binary())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows_() -> Iterator[tuple]:
            leaf, held, sha = None, None, None
            for part in parts:
                for key, first, n, ids, chain, sizes in zip(*(x.to_pylist() for x in part.columns), strict=True):
                    if key != leaf or held is None:
                        if held:
                            yield leaf, held[0], held[1], sha.hexdigest(), held[2], held[3]
                        leaf, held, sha = key, [first, n, chain, sizes], hashlib.sha256(ids.encode())
                    else:
                        held[1] += n
                        sha.update(b"," + ids.encode())
            if held:
                yield leaf, held[0], held[1], sha.hexdigest(), held[2], held[3]

        yield from batches(rows_(), arrow, 2048)

    return rows.repartition("leaf").sortWithinPartitions("leaf", "first").mapInArrow(run, "leaf binary, first long, n long, ends string, chain binary, sizes binary")


def _prefix(depth) -> Column:
    """The digest of so many turns, of column ``chain``."""
    return F.substring("chain", 1, 0) if depth == 0 else F.expr(f"substring(chain, {(depth - 1) * _D + 1}, {_D})")


def upper_nodes(seqs: DataFrame, most: int = MOST, most_turns: int = MOST_TURNS) -> DataFrame:
    """node, parent, depth, first, n, size, ends: prefixes of more conversations or turns than a group may have, root (empty digest) apart."""
    schema = "node binary, parent binary, depth int, first long, n long, size long, ends string"
    depth = F.expr(f"cast(length(chain) / {_D} AS int)")
    large = seqs.filter(F.length("chain") > 0).groupBy(_prefix(1).alias("top")).agg(F.count("*").alias("c"), F.sum(depth).alias("t"))
    large = large.filter((F.col("c") > most) | ((F.col("t") > most_turns) & (F.col("c") > 1))).select("top")
    tops = written(large, "oversized")
    if tops.isEmpty():
        return seqs.sparkSession.createDataFrame([], schema)
    some = seqs.withColumn("top", _prefix(1)).join(F.broadcast(tops) if tops.count() * _D <= BROADCAST_BYTES else tops, "top", "left_semi")
    each = some.withColumn("depth", F.explode(F.sequence(F.lit(1), depth)))
    cut = lambda d: F.expr(f"substring(chain, ({d} - 1) * {_D} + 1, {_D})")
    last = F.col("depth") == depth
    each = each.select(cut("depth").alias("node"), F.when(F.col("depth") > 1, cut("(depth - 1)")).otherwise(F.lit(b"")).alias("parent"), "depth", "first", "n", F.expr("substring(sizes, (depth - 1) * 8 + 1, 8)").alias("raw"), F.when(last, F.col("ends")).alias("ends"), (depth - F.col("depth") + 1).alias("left"))
    sums = each.groupBy("node").agg(F.any_value("parent").alias("parent"), F.any_value("depth").cast("int").alias("depth"), F.min("first").alias("first"), F.sum("n").alias("n"), F.any_value("raw").alias("raw"), F.max("ends").alias("ends"), F.count("*").alias("c"), F.sum("left").alias("t"))
    counted = written(sums.filter((F.col("c") > most) | ((F.col("t") > most_turns) & (F.col("c") > 1))), "upper")
    while counted.filter((F.col("c") > most) | ((F.col("t") > most_turns) & (F.col("c") > 1))).count() * 128 > BROADCAST_BYTES:
        most, most_turns = 2 * most, 2 * most_turns
    few = counted.filter((F.col("c") > most) | ((F.col("t") > most_turns) & (F.col("c") > 1)))
    return few.select("node", "parent", "depth", "first", "n", F.conv(F.hex("raw"), 16, 10).cast("long").alias("size"), "ends")


class Trie:
    """Nodes as lists; children as dictionaries of pointers by digest. Node 0 is the group's top."""

    def __init__(self) -> None:
        self.children: list[dict[bytes, int]] = [{}]
        self.n, self.first, self.size, self.ends = [0], [None], [0], [EMPTY]

    def add(self, steps: list[bytes], sizes: list[int], n: int, first: int, ends: str) -> None:
        at = 0
        self._count(at, n, first)
        for d, s in zip(steps, sizes, strict=True):
            to = self.children[at].get(d)
            if to is None:
                to = self.children[at][d] = len(self.n)
                self.children.append({})
                self.n.append(0)
                self.first.append(None)
                self.size.append(s)
                self.ends.append(EMPTY)
            at = to
            self._count(at, n, first)
        self.ends[at] = ends

    def _count(self, at: int, n: int, first: int) -> None:
        self.n[at] += n
        self.first[at] = first if self.first[at] is None else min(self.first[at], first)

    def totals(self) -> tuple[list[int], list[int], list[tuple[int, int, int]]]:
        """Leaves and saved bytes of each node's subtree, and (node, parent or -1, depth below the top), children before parents."""
        leaves, saved, order, todo = [0] * len(self.n), [0] * len(self.n), [], [(0, -1, 0, False)]
        while todo:
            at, parent, depth, seen = todo.pop()
            if not seen:
                todo.append((at, parent, depth, True))
                todo += [(c, at, depth + 1, False) for c in self.children[at].values()]
                continue
            below = self.children[at].values()
            leaves[at] = sum(leaves[c] for c in below) if below else 1
            saved[at] = sum(saved[c] for c in below) + (self.n[at] - 1) * self.size[at]
            order.append((at, parent, depth))
        return leaves, saved, order


def prefix_trie(conversations: DataFrame, most: int = MOST, most_turns: int = MOST_TURNS, **columns: str) -> DataFrame:
    """NODE rows: one for each different prefix of the rebuilt conversations."""
    spark = conversations.sparkSession
    seqs = written(different(rebuilt(turns(conversations, **columns))), "conversations")
    whole = seqs.agg(F.min("first").alias("first"), F.sum("n").alias("n"), F.count("*").alias("rows")).first()
    if whole.n is None:
        return spark.createDataFrame([], NODE)
    upper = written(upper_nodes(seqs, most, most_turns), "upper")
    above = {bytes(r.node): r.first for r in upper.select("node", "first").collect()}  # held to BROADCAST_BYTES
    shared = spark.sparkContext.broadcast(above)

    def deal(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for part in parts:
            depths, keys = [], []
            for chain in part.column(4).to_pylist():
                d = 1
                while chain[(d - 1) * _D : d * _D] in known:
                    d += 1
                depths.append(d)
                keys.append(chain[(d - 1) * _D : d * _D])
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(depths, pa.int32()), pa.array(keys, pa.binary())], names=[*part.schema.names, "top", "key"])

    dealt = seqs.mapInArrow(deal, "leaf binary, first long, n long, ends string, chain binary, sizes binary, top int, key binary").filter(F.length("key") > 0)
    root = whole.first

    def build(group: pd.DataFrame) -> pd.DataFrame:
        tries: dict[bytes, tuple[Trie, int, bytes]] = {}
        for first, n, ends, chain, sizes, top, key in zip(*(group[c] for c in ("first", "n", "ends", "chain", "sizes", "top", "key")), strict=True):
            if key not in tries:
                tries[key] = Trie(), top, chain[(top - 2) * _D : (top - 1) * _D] if top > 1 else b""
            trie, lengths = tries[key][0], np.frombuffer(sizes, ">i8").tolist()
            trie.size[0] = lengths[top - 1]
            trie.add([chain[i : i + _D] for i in range(top * _D, len(chain), _D)], lengths[top:], n, first, ends)
        out = []
        for trie, top, parent_key in tries.values():
            leaves, saved, order = trie.totals()
            over = shared.value.get(parent_key, root)
            out += [(trie.first[a], depth + top, trie.first[p] if p >= 0 else over, trie.n[a], len(trie.children[a]), leaves[a], saved[a], trie.ends[a], parent_key if p < 0 else None) for a, p, depth in order]
        return pd.DataFrame(out, columns=["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "above"])

    # Several first turns to a group, or the call for each would cost more than its trie.
    parts = max(whole.rows // TOGETHER, min(256, whole.rows))
    dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(parts)))
    nodes = written(dealt.groupBy("bucket").applyInPandas(build, f"{NODE}, above binary"), "nodes")
    tops = nodes.filter("above IS NOT NULL").groupBy("above").agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    turnless = seqs.filter(F.length("chain") == 0).select("ends")
    rows = upper.select("node", "parent", "depth", "first", "n", "size", "ends")
    own_ends = turnless.first()
    top = spark.createDataFrame([(b"", None, 0, whole.first, whole.n, 0, own_ends.ends if own_ends else None)], rows.schema)
    few = rows.unionAll(top)
    few = few.join(tops, few["node"] == tops["above"], "left").select("node", "parent", "depth", "first", "n", "size", "ends", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("children", "leaves", "saved")])

    def finish(group: pd.DataFrame) -> pd.DataFrame:
        at = {bytes(k): i for i, k in enumerate(group["node"])}
        rows = group.sort_values("depth", ascending=False, kind="stable")
        children, leaves, saved = group["children"].tolist(), group["leaves"].tolist(), group["saved"].tolist()
        out = []
        for i in rows.index:
            r = group.loc[i]
            up = at[bytes(r["parent"])] if r["depth"] else None
            leaves[i] = leaves[i] if children[i] else 1
            saved[i] += (int(r["n"]) - 1) * int(r["size"])
            if up is not None:
                children[up] += 1
                leaves[up] += leaves[i]
                saved[up] += saved[i]
            out.append((r["first"], r["depth"], None if up is None else group["first"][up], r["n"], children[i], leaves[i], saved[i], r["ends"] or EMPTY))
        done = pd.DataFrame(out, columns=["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"])
        done["parent_conv_id"] = done["parent_conv_id"].astype("Int64")
        return done

    finished = few.withColumn("all", F.lit("")).groupBy("all").applyInPandas(finish, NODE)  # the nodes of ``upper`` and the root
    return nodes.drop("above").unionAll(finished)
