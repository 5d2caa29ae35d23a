"""The registered queries of this subpackage: each applies its operator to whole tables with production parameters."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fingerprints, graph_index, licenses, line_dedup, packing, pii, prefix_trie, quality, secrets, simhash, token_counts, whitening
from .common import table

#: Fixed by the query contracts.
LINE_MIN_DOCS, TOKEN_LIMIT, NEIGHBOURS, QUERY_EVERY = 10, 2048, 10, 100


def op1_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_pii, kinds (of the values, in order), text with pseudonyms."""
    done = pii.pseudonyms(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", F.size("pii").cast("long").alias("n_pii"), F.array_join(F.transform("pii", lambda p: p["kind"]), ",").alias("kinds"), "text")


def op2_graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return graph_index.nearest(vectors, vectors.filter(F.col("vec_id") % QUERY_EVERY == 0), NEIGHBOURS)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.kept_digest(line_dedup.dedup_lines(docs, min_docs=LINE_MIN_DOCS, keep="none"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.count_tokens(table(spark, sf_dir, "documents"))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op6_quality_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    scored = quality.scores(docs, table(spark, sf_dir, "labels"), metadata=("n_chars",))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(decontaminate.find_windows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(secrets.scan_secrets(table(spark, sf_dir, "documents")))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_digest(licenses.scan_licenses(table(spark, sf_dir, "documents")))


def op11_multiset_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_digest(fingerprints.edited(table(spark, sf_dir, "documents")))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_pii_pseudonyms, op2_graph_neighbours, op3_line_dedup, op4_token_counts, op5_best_fit_packing, op6_quality_machine, op7_decontaminate, op8_secrets, op9_simhash, op10_licenses, op11_multiset_fingerprints, op12_prefix_trie, op13_whitening)
    return {f.__name__: f for f in every}


OP3_SQL = r"""
WITH lines AS (
  SELECT d.rowid AS r, doc_id, u.i AS i, u.line AS line,
         translate(regexp_replace(regexp_replace(u.line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT row_number() OVER () AS rowid, * FROM documents) d,
       LATERAL (SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i) u),
gone AS (SELECT key FROM lines WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT doc_id, count(*) AS n_lines, count(g.key) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN g.key IS NULL THEN line END, chr(10) ORDER BY i), '')) AS kept_sha256
FROM lines l LEFT JOIN gone g ON l.key = g.key GROUP BY r, doc_id
"""

OP7_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
windows AS (SELECT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win FROM items, LATERAL (SELECT unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT r, s.n, i, array_to_string(w[i:i + s.n - 1], ' ') AS win FROM docs, sizes s, LATERAL (SELECT unnest(generate_series(1, len(w) - s.n + 1)) AS i) WHERE len(w) >= s.n),
hits AS (SELECT p.r, p.n, p.i, v.item_id FROM places p JOIN windows v ON p.win = v.win AND p.n = v.n),
words AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT DISTINCT r, n, i FROM hits) h, LATERAL (SELECT unnest(generate_series(i, i + n - 1)) AS k) GROUP BY r),
found AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (r) LEFT JOIN found USING (r)
"""


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _op10_sql() -> str:
    """Every block that begins with a template's word, by self-join of the places of its words."""
    rows = []
    for label, text in licenses.NOTICES:
        w = licenses.template_words(text)
        need = math.ceil(licenses.THRESHOLD * len(set(w)) - 1e-9)
        rows += [f"('{label}', {len(w)}, {len(set(w))}, {need}, '{x}')" for x in sorted(set(w))]
    phrases = []
    for phrase, label in licenses.PHRASES.items():
        parts = phrase.split(" ")
        joins = "".join(f" JOIN pos p{k} ON p{k}.r = p0.r AND p{k}.i = p0.i + {k} AND p{k}.word = '{x}'" for k, x in enumerate(parts[1:], 1))
        phrases.append(f"SELECT p0.r, p0.i, '{label}' AS label FROM pos p0{joins} WHERE p0.word = '{parts[0]}'")
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
pos AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM docs),
t(label, len, n, need, word) AS (VALUES {", ".join(rows)}),
near AS (SELECT r, i, label, len, n, need, t.word FROM pos JOIN t ON pos.word = t.word),
blocks AS (SELECT a.r, a.label, a.i, any_value(a.n) AS n, any_value(a.need) AS need, count(DISTINCT b.word) AS c FROM near a JOIN near b ON a.r = b.r AND a.label = b.label AND b.i BETWEEN a.i AND a.i + 2 * a.len - 1 GROUP BY a.r, a.label, a.i),
good AS (SELECT r, label, c / n::DOUBLE AS share FROM blocks WHERE c >= need),
base AS ({" UNION ALL ".join(phrases)}),
nb AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY r),
every AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM base UNION SELECT r, label FROM good) GROUP BY r),
best AS (SELECT r, max(share) AS share FROM good GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0) END::DOUBLE AS score
FROM docs LEFT JOIN nb USING (r) LEFT JOIN every USING (r) LEFT JOIN best USING (r)
"""


# CRC-32 by its polynomial, a bit at a time; a node is the joined digests of its turns, and meets its ancestors through its smallest member.
OP12_SQL = """
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), text) AS k, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
codes AS (SELECT DISTINCT c, list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda z: ascii(z)::BIGINT)) AS bytes FROM t),
ids AS (SELECT c, xor(list_reduce(bytes, lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, CASE WHEN v % 2 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) % 9 AS h FROM codes),
joined AS (SELECT ids.c, 0 AS part, k, r, x FROM ids JOIN t ON t.c = ids.c - ids.c % 5 AND k <= h UNION ALL SELECT ids.c, 1, k, r, x FROM ids JOIN t ON t.c = ids.c AND k > h),
steps AS (SELECT c, row_number() OVER w AS d, strlen(x) AS size, string_agg(md5(length(r) || ':' || r || x), '') OVER w AS p FROM joined WINDOW w AS (PARTITION BY c ORDER BY part, k)),
m AS (SELECT c, d, size, p FROM steps UNION ALL SELECT c, 0, 0, '' FROM ids),
n AS (SELECT d, p, min(c) AS first, count(*) AS n, any_value(size) AS size FROM m GROUP BY d, p),
last AS (SELECT c, arg_max(p, d) AS p FROM m GROUP BY c),
ends AS (SELECT p, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS ends FROM last GROUP BY p),
kids AS (SELECT left(p, (32 * (d - 1))::INT) AS p, count(*) AS kids FROM n WHERE d > 0 GROUP BY 1),
e AS (SELECT n.*, coalesce(kids, 0) AS kids FROM n LEFT JOIN kids USING (p)),
below AS (SELECT m.p, count(*) FILTER (e.kids = 0) AS leaves, sum((e.n - 1) * e.size) AS saved FROM e JOIN m ON m.c = e.first AND m.d <= e.d GROUP BY m.p)
SELECT e.first AS conv_id, e.d AS depth, up.first AS parent_conv_id, e.n AS n_convs, e.kids AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM e JOIN below USING (p) LEFT JOIN ends USING (p) LEFT JOIN n up ON e.d > 0 AND up.p = left(e.p, (32 * (e.d - 1))::INT)
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": OP3_SQL, "op7_decontaminate": OP7_SQL, "op10_licenses": _op10_sql(), "op12_prefix_trie": OP12_SQL}
