"""The subpackage's registered queries and, where SQL can express them, their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm import decontamination, language_id, mixing, ngram_join, phrases, quality, repair, sharding, sketches, token_counts, topk, toxicity, trie


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(of: int) -> F.Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(of))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen shards of nearly equal bytes, equal texts together."""
    return sharding.shard_documents(_read(spark, sf_dir, "documents"), 16)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text, learned from three quarters of the documents."""
    docs = _read(spark, sf_dir, "documents")
    model = language_id.learn(docs.where(_remainder(4) != 2))
    found = language_id.identify(docs, model)
    return found.select("doc_id", (_remainder(4) == 2).alias("held_out"), "lang_pred", "score", "languages")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by co-training."""
    table = quality.features(_read(spark, sf_dir, "documents"))
    return quality.score_documents(table, quality.train(table, _read(spark, sf_dir, "labels"))).drop("row")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a ten-word window of a benchmark item."""
    return decontamination.digest(decontamination.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), 10))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its words in repeated windows of 35 words."""
    return phrases.remove_repeats(_read(spark, sf_dir, "documents"), 35)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every text, learned from four fifths of the labelled documents."""
    docs = _read(spark, sf_dir, "documents")
    model = toxicity.train(docs, _read(spark, sf_dir, "labels").where(_remainder(5) != 0))
    return toxicity.score_documents(docs, model).select("doc_id", (_remainder(5) == 0).alias("held_out"), "score", "predicted")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE token counts of every text."""
    return token_counts.count_tokens(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 512)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of 150 % of all words takes of every document, at most two epochs a source."""
    return mixing.mix(_read(spark, sf_dir, "documents"), (3, 1, 2), 1.5, 2).select("doc_id", "size", "source_size", "target", "taken", "copies", "part")


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose four-word shingles have a Jaccard similarity of 0.85."""
    return ngram_join.jaccard_components(_read(spark, sf_dir, "documents"), 4, 85)


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten greatest inner products of every hundredth vector with all others."""
    vectors = _read(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where(F.pmod("vec_id", F.lit(100)) == 0), 10)


def op11_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose two-word shingles have a Jaccard similarity of 0.8."""
    return sketches.near_duplicates(_read(spark, sf_dir, "documents"), 2, 80)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of the rebuilt conversations."""
    return trie.prefix_trie(_read(spark, sf_dir, "conversations"), 100, 6)


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What it takes to repair the damaged conversations."""
    conversations = _read(spark, sf_dir, "conversations")
    return repair.audit(conversations, repair.damage(conversations))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_sharding, op2_language_id, op3_quality, op4_decontamination, op5_substring_dedup, op6_toxicity, op7_token_counts, op8_mixing, op9_ngram_jaccard, op10_topk, op11_minhash_dedup, op12_prefix_trie, op13_structure_repair)
}

_WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: CRC-32 of an ASCII string, which DuckDB lacks: the inverted register takes a byte, then eight shifts.
_CRC32 = "xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({}, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384::BIGINT * (v & 1)))))"

ORACLE_SQL: dict[str, str] = {
    "op4_decontamination": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT DISTINCT item_id, regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
lengths AS (SELECT DISTINCT least(10, len(w)) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS x FROM b, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS t(i) WHERE len(w) > 0),
dw AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS x FROM d, lengths, unnest(range(1, greatest(1, len(w) - n + 2))) AS t(i)),
hits AS (SELECT dw.r, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.x = bw.x AND dw.n = bw.n),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM hits)) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
 sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)""",
    "op5_substring_dedup": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
x AS (SELECT r, i, array_to_string(w[i:i + 34], ' ') AS x FROM d, unnest(range(1, greatest(1, len(w) - 33))) AS t(i)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY x) AS n FROM x) WHERE n > 1),
gone AS (SELECT r, list(DISTINCT p) AS ps FROM (SELECT r, unnest(range(i, i + 35)) AS p FROM again) GROUP BY r),
k AS (SELECT doc_id, len(w) AS n, coalesce(len(ps), 0) AS g, CASE WHEN ps IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda p: NOT list_contains(ps, p)), lambda p: w[p]) END AS kept FROM d LEFT JOIN gone USING (r))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(g AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k""",
    "op8_mixing": rf"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len({_WORDS}), 0) AS BIGINT) AS size, CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS ss, CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3] AS BIGINT) AS w FROM d GROUP BY source),
o AS (SELECT *, 2 * ss AS cap, 2.0::DOUBLE * ss / w AS ratio FROM s),
p AS (SELECT *, (SELECT 1.5::DOUBLE * sum(ss) FROM s) AS total, coalesce(sum(cap) OVER q, 0) AS filled, (SELECT sum(w) FROM s) - coalesce(sum(w) OVER q, 0) AS free
 FROM o WINDOW q AS (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lv AS (SELECT CAST(total - filled AS DOUBLE) AS num, CAST(free AS DOUBLE) AS den FROM p WHERE w * CAST(total - filled AS DOUBLE) / free <= cap ORDER BY ratio, source ASC NULLS LAST LIMIT 1),
t AS (SELECT source, ss, least(w * num / den, CAST(cap AS DOUBLE)) AS target FROM o, lv),
f AS (SELECT source, ss, target, CASE WHEN ss > 0 THEN CAST(floor(target / ss) AS BIGINT) ELSE 0 END AS whole, CAST(floor(target) AS BIGINT) AS fl FROM t),
e AS (SELECT d.doc_id, d.size, f.ss, f.target, f.whole, f.fl - f.whole * f.ss AS fraction,
 coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source),
g AS (SELECT *, CAST(greatest(0, least(size, fraction - pos)) AS BIGINT) AS extra FROM e)
SELECT doc_id, size, ss AS source_size, target, CAST(whole * size + extra AS BIGINT) AS taken,
 CAST(whole + CASE WHEN extra = size AND size > 0 THEN 1 ELSE 0 END AS INTEGER) AS copies, CAST(CASE WHEN extra = size THEN 0 ELSE extra END AS BIGINT) AS part FROM g""",
    "op9_ngram_jaccard": rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all({_LOWER.format("text")}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
x AS (SELECT DISTINCT r, CASE WHEN len(w) < 4 THEN 'short ' || array_to_string(w, ' ') ELSE array_to_string(w[i:i + 3], ' ') END AS x FROM d, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS t(i) WHERE len(w) > 0),
n AS (SELECT r, count(*) AS n FROM x GROUP BY r),
shared AS (SELECT a.r AS a, b.r AS b, count(*) AS k FROM x a JOIN x b ON a.x = b.x AND a.r <> b.r GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN n na ON na.r = a JOIN n nb ON nb.r = b WHERE 100 * k >= 85 * (na.n + nb.n - k)),
reach(a, b) AS (SELECT r, r FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(o.doc_id) AS component_id
FROM d JOIN reach ON reach.a = d.r JOIN d o ON o.r = reach.b LEFT JOIN n ON n.r = d.r GROUP BY d.r, d.doc_id""",
    "op10_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS DOUBLE)) AS v FROM embeddings
 WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10""",
    "op11_minhash_dedup": rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all({_LOWER.format("text")}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
x AS (SELECT DISTINCT r, CASE WHEN len(w) < 2 THEN w[1] ELSE array_to_string(w[i:i + 1], ' ') END AS x FROM d, unnest(range(1, greatest(1, len(w) - 1) + 1)) AS t(i) WHERE len(w) > 0),
n AS (SELECT r, count(*) AS n FROM x GROUP BY r),
shared AS (SELECT a.r AS a, b.r AS b, count(*) AS k FROM x a JOIN x b ON a.x = b.x AND a.r <> b.r GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN n na ON na.r = a JOIN n nb ON nb.r = b WHERE 100 * k >= 80 * (na.n + nb.n - k)),
reach(a, b) AS (SELECT r, r FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(o.doc_id) AS component_id, d.doc_id = min(o.doc_id) AS kept
FROM d JOIN reach ON reach.a = d.r JOIN d o ON o.r = reach.b LEFT JOIN n ON n.r = d.r GROUP BY d.r, d.doc_id""",
    "op12_prefix_trie": rf"""
WITH o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, substring(text, 1, 64), md5(length(role) || ':' || role || text)) - 1 AS n, role, text
 FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS leader, {_CRC32.format("CAST(conv_id AS VARCHAR)")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM o)),
l AS (SELECT c.conv_id, c.h, least(c.h, coalesce(max(o.n) + 1, 0)) AS m FROM c LEFT JOIN o ON o.conv_id = c.leader GROUP BY c.conv_id, c.h),
t AS (SELECT c.conv_id, o.n + 1 AS depth, role, text FROM c JOIN o ON o.conv_id = c.leader WHERE o.n < c.h
 UNION ALL SELECT l.conv_id, o.n - l.h + l.m + 1, role, text FROM l JOIN o ON o.conv_id = l.conv_id WHERE o.n >= l.h UNION ALL SELECT conv_id, 0, '', '' FROM c),
p AS (SELECT conv_id, depth, length(text) AS points, string_agg(md5(length(role) || ':' || role || text), '' ORDER BY depth) OVER (PARTITION BY conv_id ORDER BY depth) AS k FROM t),
q AS (SELECT conv_id, depth, points, md5(k) AS k, lag(md5(k)) OVER (PARTITION BY conv_id ORDER BY depth) AS up, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM p),
nodes AS (SELECT depth, k, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(points) AS points, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM q GROUP BY depth, k),
kids AS (SELECT depth - 1 AS depth, up AS k, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1, 2),
v AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids USING (depth, k)),
s AS (SELECT q.depth, q.k, CAST(sum(CASE WHEN v.n_children = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves, CAST(sum((v.n_convs - 1) * v.points) AS BIGINT) AS saved_tokens FROM v JOIN q ON q.conv_id = v.conv_id AND q.depth <= v.depth GROUP BY q.depth, q.k)
SELECT v.conv_id, CAST(v.depth AS BIGINT) AS depth, a.conv_id AS parent_conv_id, v.n_convs, CAST(v.n_children AS BIGINT) AS n_children, s.n_leaves, s.saved_tokens, v.ends_sha256
FROM v JOIN s USING (depth, k) LEFT JOIN nodes a ON a.depth = v.depth - 1 AND a.k = v.up""",
    "op13_structure_repair": rf"""
WITH RECURSIVE raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
 {_CRC32.format("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM raw WHERE kind <> 0),
e AS (SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body, substring(role, 1, 1) AS initial,
 row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, substring(text, 1, 64), md5(length(role) || ':' || role || text)) AS n FROM d),
g AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) AS again FROM e),
f AS (SELECT *, CASE WHEN body = '' THEN 'blank' WHEN again > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, lag(initial) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM g),
c AS (SELECT conv_id, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
 count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps FROM f GROUP BY conv_id),
ins(st, st2, c, e, l) AS (VALUES (0, 0, 0, '', []::VARCHAR[]), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), (0, 2, 3, 'I', ['user:']), (0, 3, 6, 'II', ['user:', 'assistant:']), (1, 2, 3, 'I', ['user:']),
 (1, 3, 6, 'II', ['user:', 'assistant:']), (2, 3, 3, 'I', ['assistant:']), (3, 2, 3, 'I', ['user:'])),
op(st, st2, c, e, x, r) AS (VALUES (0, 0, 4, 'D', '', ''), (1, 1, 4, 'D', '', ''), (2, 2, 4, 'D', '', ''), (3, 3, 4, 'D', '', ''), (0, 1, 0, 'K', 's', ''), (0, 2, 0, 'K', 'u', ''), (1, 2, 0, 'K', 'u', ''), (3, 2, 0, 'K', 'u', ''), (2, 3, 0, 'K', 'a', ''),
 (0, 2, 3, 'R', '', 'user'), (1, 2, 3, 'R', '', 'user'), (3, 2, 3, 'R', '', 'user'), (2, 3, 3, 'R', '', 'assistant')),
walk(conv_id, n, st, cost, audit, lines) AS (SELECT conv_id, 0::BIGINT, 0, 0, '', []::VARCHAR[] FROM c UNION ALL
 SELECT w.conv_id, f.n, op.st2, w.cost + i.c + op.c + CASE WHEN f.fault = 'truncated' AND op.e <> 'D' THEN 3 ELSE 0 END AS cost, w.audit || i.e || op.e AS audit,
 list_concat(w.lines, i.l, CASE op.e WHEN 'D' THEN [] WHEN 'K' THEN [f.role || ':' || f.text] ELSE [op.r || ':' || f.text] END)
 FROM walk w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.n = w.n + 1 JOIN ins i ON i.st = w.st
 JOIN op ON op.st = i.st2 AND (op.e = 'D' OR f.fault NOT IN ('blank', 'duplicate') AND (op.e = 'R' OR op.x = f.initial))
 QUALIFY row_number() OVER (PARTITION BY w.conv_id, op.st2 ORDER BY w.cost + i.c + op.c + CASE WHEN f.fault = 'truncated' AND op.e <> 'D' THEN 3 ELSE 0 END, w.audit || i.e || op.e) = 1),
ends AS (SELECT w.conv_id, w.cost + i.c AS cost, w.audit || i.e AS audit, list_concat(w.lines, i.l) AS lines FROM walk w JOIN (SELECT conv_id, max(n) AS n FROM f GROUP BY conv_id) z ON z.conv_id IS NOT DISTINCT FROM w.conv_id AND z.n = w.n
 JOIN ins i ON i.st = w.st WHERE i.st2 IN (0, 3) QUALIFY row_number() OVER (PARTITION BY w.conv_id ORDER BY w.cost + i.c, w.audit || i.e) = 1)
SELECT a.conv_id, CAST(coalesce(c.gaps, 0) AS BIGINT) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal,
 CAST(coalesce(ends.cost, 0) AS BIGINT) AS cost, coalesce(ends.audit, '') AS audit, sha256(coalesce(array_to_string(ends.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN ends ON ends.conv_id IS NOT DISTINCT FROM a.conv_id""",
}
