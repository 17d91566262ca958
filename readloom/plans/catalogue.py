"""Registered queries of the reference's operators and their DuckDB SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom import schemas
from readloom.functions import alignment as al
from readloom.functions import sequence as sq
from readloom.operators import align, consensus, hits, intervals, kmers, mapping, seeds, selection, signatures, significance, stats, tags, traceback, volumes
from readloom.plans import views
from readloom.sources import records

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


_LEN = "lens AS (SELECT doc_id AS rid, CAST(length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS BIGINT) AS len FROM documents)"


@query(f"WITH {_LEN}, r AS (SELECT len, row_number() OVER (ORDER BY len DESC) AS k, count(*) OVER () AS n FROM lens) SELECT count(*) AS n, CAST(sum(len) AS BIGINT) AS total, min(len) AS least, max(len) AS greatest, CAST(floor(sum(len) / count(*)) AS BIGINT) AS average, max(CASE WHEN k = n // 2 + 1 THEN len END) AS median FROM r")
def a03_length_stats(spark, d):
    return stats.length_stats(views.lengths(spark, d))


@query(f"""WITH {_LEN}, r AS (SELECT len, row_number() OVER (ORDER BY len DESC) AS k, sum(len) OVER (ORDER BY len DESC ROWS UNBOUNDED PRECEDING) AS c, (SELECT sum(len) FROM lens) AS t FROM lens),
p AS (SELECT unnest([10, 20, 25, 30, 40, 50, 60, 70, 75, 80, 90]) AS share) SELECT CAST(share AS INT) AS share, max(len) AS nx, CAST(min(k) AS BIGINT) AS lx FROM r, p WHERE c >= t * share // 100 GROUP BY share""")
def a04_nx_lx(spark, d):
    return stats.nx_lx(views.lengths(spark, d))


@query("SELECT doc_id, CAST(len(x) AS INT) AS runs, CAST(coalesce(list_sum(list_transform(x, lambda r: length(r))), 0) AS BIGINT) AS bases, CAST(len(y) AS INT) AS one_code FROM (SELECT doc_id, regexp_extract_all(t, '[RYSWKMBDHVNU]+') AS x, regexp_extract_all(t, 'R+|Y+|S+|W+|K+|M+|B+|D+|H+|V+|N+|U+') AS y FROM (SELECT doc_id, upper(regexp_replace(text, '[^ -~]', '', 'g')) AS t FROM documents))")
def a05_ambiguity_runs(spark, d):
    plain = views.table(spark, d, "documents").select("doc_id", F.regexp_replace("text", "[^ -~]", "").alias("t"))
    both = plain.select("doc_id", sq.ambiguity_runs("t", merged=True).alias("x"), sq.ambiguity_runs("t").alias("y"))
    return both.select("doc_id", F.size("x").alias("runs"), al.total(F.col("x")).cast("long").alias("bases"), F.size("y").alias("one_code"))


@query("SELECT source, count(*) AS n FROM documents GROUP BY source HAVING count(*) > 1")
def a06_duplicate_names(spark, d):
    return stats.duplicates(views.table(spark, d, "documents"), "source")


@query(f"""WITH {views.READS_SQL}, c AS (SELECT *, length(seq) AS n FROM reads WHERE length(seq) > 0), k AS (SELECT *, greatest(1, CAST(ceil((n - 2000 - 500 + 1) / 1800) AS BIGINT) + 1) AS chunks FROM c),
x AS (SELECT *, unnest(range(chunks)) AS i FROM k), y AS (SELECT *, i * 1800 AS f, CASE WHEN i = chunks - 1 THEN n ELSE i * 1800 + 2000 END AS t FROM x)
SELECT CASE WHEN chunks = 1 THEN name ELSE concat_ws('_', name, f, t) END AS name, CAST(f AS BIGINT) AS "from", CAST(t AS BIGINT) AS "to", substr(seq, f + 1, t - f) AS seq FROM y""")
def p01_split_reads(spark, d):
    return sq.split_reads(views.reads(spark, d), 2000, 200, 500)


_KMERS = f"{views.READS_SQL}, occ AS (SELECT rid, off, substr(seq, off + 1, 15) AS kmer FROM (SELECT rid, seq, unnest(range(0, length(seq) - 14, 10)) AS off FROM reads WHERE length(seq) >= 15))"
_STRANDS = f"{_KMERS}, strands AS (SELECT rid, 0 AS qdir, seq FROM reads UNION ALL SELECT rid, 1, reverse(translate(seq, 'ACGT', 'TGCA')) FROM reads)"
_WORDS = f"{_STRANDS}, parts AS (SELECT rid, qdir, a, substr(seq, a + 1, 300) AS p FROM (SELECT rid, qdir, seq, unnest(range(0, length(seq) - 14, 500)) AS a FROM strands WHERE length(seq) >= 15)), words AS (SELECT rid, qdir, a + i AS off, substr(p, i + 1, 15) AS kmer FROM (SELECT *, unnest(range(0, length(p) - 14)) AS i FROM parts))"


def _occurrences(spark, d):
    return kmers.occurrences(views.reads(spark, d), 15, 10)


@query(f"WITH {_KMERS} SELECT rid, off, kmer, CAST(list_reduce(list_transform(string_split(translate(kmer, 'ACGT', '0123'), ''), lambda c: CAST(c AS BIGINT)), lambda a, c: a * 4 + c) AS BIGINT) AS code FROM occ")
def p02_kmers(spark, d):
    return _occurrences(spark, d).withColumn("code", sq.kmer_code(F.col("kmer")))


@query(f"WITH {_WORDS} SELECT rid, CAST(qdir AS INT) AS qdir, CAST(off AS BIGINT) AS off, kmer FROM words")
def p03_sampled_kmers(spark, d):
    """Query words: segments of 300 bases on both strands, a word at each base."""
    return kmers.query_words(views.reads(spark, d), 15)


@query(f"""WITH RECURSIVE {_STRANDS}, n AS (SELECT rid, qdir, length(seq) AS n FROM strands WHERE length(seq) >= 15),
g(rid, qdir, n, a, e) AS (SELECT rid, qdir, n, 0, CASE WHEN n - least(300, n) <= 330 THEN n ELSE 300 END FROM n
 UNION ALL SELECT rid, qdir, n, e + 200, CASE WHEN n - least(e + 500, n) <= 330 THEN n ELSE e + 500 END FROM g WHERE e + 200 < n),
p AS (SELECT g.rid, g.qdir, a, substr(seq, a + 1, e - a) AS p FROM g JOIN strands s ON s.rid = g.rid AND s.qdir = g.qdir)
SELECT rid, CAST(qdir AS INT) AS qdir, CAST(a + i AS BIGINT) AS off, substr(p, i + 1, 15) AS kmer FROM (SELECT *, unnest(range(0, length(p) - 14, 10)) AS i FROM p)""")
def p04_word_list(spark, d):
    """Words of both strands at every tenth base, the rest of a read belonging to its last segment."""
    return kmers.word_list(views.reads(spark, d), 15, 10, 300, 200)


@query("SELECT doc_id, translate(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), 'RYSWKMBDHVNU-', 'AAAAAAAAAAAAA') AS packed FROM documents")
def p05_encode(spark, d):
    return views.table(spark, d, "documents").select("doc_id", sq.packed_letters("text").alias("packed"))


@query(f"WITH {views.READS_SQL} SELECT rid, reverse(translate(seq, 'ACGT', 'TGCA')) AS rc FROM reads")
def p07_revcomp(spark, d):
    return views.reads(spark, d).select("rid", sq.reverse_complement("seq").alias("rc"))


@query(f"""WITH {views.PAIRS_SQL}, c AS (SELECT pid, q_aln, s_aln, len(list_filter(range(1, length(q_aln) + 1), lambda i: q_aln[i] = s_aln[i] AND q_aln[i] <> '-')) AS m FROM pairs)
SELECT pid, round(100.0 * m / length(q_aln), 6) AS ident, CAST(length(q_aln) - m AS INT) AS dist, CAST(8 * length(q_aln) - m AS INT) AS score FROM c""")
def p09_identity(spark, d):
    return views.pairs(spark, d).select("pid", F.round(al.identity("q_aln", "s_aln"), 6).alias("ident"), al.distance("q_aln", "s_aln").alias("dist"), al.column_score("q_aln", "s_aln").alias("score"))


_OPS = f"""{views.PAIRS_SQL}, ops AS (SELECT pid, array_to_string(list_transform(range(1, length(q_aln) + 1), lambda i: CASE WHEN q_aln[i] = '-' AND s_aln[i] = '-' THEN '' WHEN q_aln[i] = '-' THEN 'D' WHEN s_aln[i] = '-' THEN 'I' WHEN q_aln[i] = s_aln[i] THEN '=' ELSE 'X' END), '') AS o FROM pairs)"""


@query(f"""WITH {_OPS}, c AS (SELECT pid, length(o) - coalesce(list_sum(list_transform(regexp_extract_all(o, 'I{{20,}}|D{{20,}}'), lambda r: length(r))), 0) AS n, length(regexp_replace(o, '[^=]', '', 'g')) AS m FROM ops)
SELECT pid, CASE WHEN n > 0 THEN round(100.0 * m / n, 6) ELSE 0.0 END AS eff_ident FROM c""")
def p10_effective_identity(spark, d):
    return views.pairs(spark, d).select("pid", F.round(al.effective_identity("q_aln", "s_aln"), 6).alias("eff_ident"))


@query(f"WITH {_OPS} SELECT pid, array_to_string(list_transform(regexp_extract_all(translate(o, '=X', 'MM'), 'M+|I+|D+'), lambda r: CAST(length(r) AS VARCHAR) || r[1]), '') AS cigar FROM ops")
def p12_cigar(spark, d):
    return views.pairs(spark, d).select("pid", al.cigar("q_aln", "s_aln").alias("cigar"))


@query(f"""{"WITH " + views.PAIRS_SQL}, t AS (SELECT pid, regexp_extract_all(array_to_string(list_transform(range(1, length(q_aln) + 1), lambda i: CASE WHEN s_aln[i] = '-' THEN '' WHEN q_aln[i] = '-' THEN '^' || s_aln[i] WHEN q_aln[i] = s_aln[i] THEN '=' ELSE 'x' || s_aln[i] END), ''), '=+|x[A-Z]|(\\^[A-Z])+') AS p FROM pairs)
SELECT pid, array_to_string(list_transform(range(1, len(p) + 1), lambda i: CASE WHEN p[i][1] = '=' THEN '' ELSE CASE WHEN i > 1 AND p[i - 1][1] = '=' THEN length(p[i - 1]) ELSE 0 END || CASE WHEN p[i][1] = 'x' THEN p[i][2] ELSE '^' || replace(p[i], '^', '') END END), '') || CASE WHEN len(p) > 0 AND p[len(p)][1] = '=' THEN length(p[len(p)]) ELSE 0 END AS md FROM t""")
def p13_md(spark, d):
    return views.pairs(spark, d).select("pid", al.md("q_aln", "s_aln").alias("md"))


_SPLIT = "array_to_string(list_transform(range(1, length(q_aln) + 1), lambda i: CASE WHEN q_aln[i] <> s_aln[i] AND q_aln[i] <> '-' AND s_aln[i] <> '-' THEN {} ELSE {} END), '')"


@query(f"WITH {views.PAIRS_SQL} SELECT pid, {_SPLIT.format("'-' || q_aln[i]", 'q_aln[i]')} AS q_aln, {_SPLIT.format("s_aln[i] || '-'", 's_aln[i]')} AS s_aln FROM pairs")
def p23_split_mismatches(spark, d):
    q, s = al.split_mismatches("q_aln", "s_aln")
    return views.pairs(spark, d).select("pid", q.alias("q_aln"), s.alias("s_aln"))


@query()
def p23_pushed_gaps(spark, d):
    """Mismatches split, gaps pushed to the right."""
    q, s = al.split_mismatches("q_aln", "s_aln")
    return views.pairs(spark, d).select("pid", traceback.push_gaps(q, s).alias("p")).select("pid", "p.*")


@query(f"WITH {views.ALN_SQL} SELECT qid, qdir, qoff, qend, qsize, sid, soff, send, CAST(floor((qend - qoff + send - soff) * (100 - ident) / 200) AS INT) AS dist FROM aln")
def p14_dist(spark, d):
    return hits.to_sv_reads(views.alignments(spark, d))


@query(f"WITH {views.ALN_SQL} SELECT aid, 'r' || qid || '_svr:' || qdir || ':' || sid || ':' || aid % 97 || ':' || soff || ':' || send AS name, 'r' || qid AS read, CAST(qdir AS BIGINT) AS qdir, sid, aid % 97 AS gid, soff, send FROM aln")
def p15_header_roundtrip(spark, d):
    a = views.alignments(spark, d)
    name = sq.group_name(F.concat(F.lit("r"), F.col("qid").cast("string")), *(F.col(c) for c in ("qdir", "sid")), F.col("aid") % 97, F.col("soff"), F.col("send"))
    made = a.select("aid", name.alias("name"))
    return made.select("aid", "name", *(c.alias(n) for c, n in zip(sq.parse_group_name(F.col("name")), ("read", "qdir", "sid", "gid", "soff", "send"), strict=True)))


@query(f"WITH {views.ALN_SQL} SELECT aid, 'r' || qid || '_cns:' || qoff || ':' || soff || ':' || qoff || ':' || qend || ':' || qsize || ':' || ssize AS name, 'r' || qid AS read, qoff AS ext, soff AS aln, qoff AS off, qend AS \"end\", qsize AS size, ssize AS raw FROM aln")
def p16_cns_header(spark, d):
    a = views.alignments(spark, d)
    made = a.select("aid", sq.consensus_name(F.concat(F.lit("r"), F.col("qid").cast("string")), *(F.col(c) for c in ("qoff", "soff", "qoff", "qend", "qsize", "ssize"))).alias("name"))
    return made.select("aid", "name", *(c.alias(n) for c, n in zip(sq.parse_consensus_name(F.col("name")), ("read", "ext", "aln", "off", "end", "size", "raw"), strict=True)))


@query("SELECT o_orderkey, format('{:,}', o_orderkey * 1237) AS grouped, lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS padded, CASE WHEN regexp_full_match(o_orderpriority, '[0-9].*') THEN 1 ELSE 0 END AS numbered FROM orders")
def p17_formatting(spark, d):
    return views.table(spark, d, "orders").select("o_orderkey", F.format_number(F.col("o_orderkey") * 1237, 0).alias("grouped"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0").alias("padded"), F.col("o_orderpriority").rlike("^[0-9]").cast("int").alias("numbered"))


@query(f"WITH {views.ALN_SQL} SELECT aid FROM aln WHERE qsize >= 3000 AND qoff <= 300 AND qsize - qend <= 300")
def f03_complete(spark, d):
    return views.alignments(spark, d).where((F.col("qsize") >= 3000) & hits.complete(300)).select("aid")


_CLASS = """CASE WHEN qoff <= 100 AND qsize - qend <= 100 THEN 'contained' WHEN soff <= 100 AND ssize - send <= 100 THEN 'contains' WHEN (qoff <= 100 AND ssize - send <= 100) OR (qsize - qend <= 100 AND soff <= 100) THEN 'dovetail' WHEN qoff <= 100 OR qsize - qend <= 100 THEN 'overhang' ELSE 'partial' END"""


@query(f"WITH {views.ALN_SQL} SELECT aid, {_CLASS} AS class FROM aln")
def f07_overlap_class(spark, d):
    return views.alignments(spark, d).select("aid", hits.overlap_class().alias("class"))


@query(f"WITH {views.ALN_SQL}, {views.OVERLAP_SQL}, b AS (SELECT *, max(CASE WHEN qoff <= 100 AND ssize - send <= 100 THEN 1 ELSE 0 END) OVER (PARTITION BY qid) AS l, max(CASE WHEN qsize - qend <= 100 AND soff <= 100 THEN 1 ELSE 0 END) OVER (PARTITION BY qid) AS r FROM ovl) SELECT aid, qid FROM b WHERE l = 1 AND r = 1")
def f09_dovetail(spark, d):
    return hits.both_ends(views.overlapping(spark, d), 100).select("aid", "qid")


@query(f"WITH {views.ALN_SQL}, {views.OVERLAP_SQL} SELECT aid, {_CLASS.replace('100', '300')} AS class FROM ovl")
def f08_overlap_class(spark, d):
    return views.overlapping(spark, d).select("aid", hits.overlap_class(300).alias("class"))


@query(f"WITH {views.ALN_SQL} SELECT aid FROM aln WHERE qend - qoff >= 5000 OR 100 * (qend - qoff) >= 80 * qsize")
def f10_coverage(spark, d):
    return views.alignments(spark, d).where(hits.covers(5000, 80)).select("aid")


@query(f"WITH {_KMERS} SELECT kmer, count(*) AS n FROM occ GROUP BY kmer HAVING count(*) > 8")
def a01_frequent_kmers(spark, d):
    return kmers.frequencies(_occurrences(spark, d)).where("n > 8")


@query(f"WITH {_KMERS} SELECT kmer, count(*) AS n, min(rid) AS first_read, string_agg(rid || ':' || off, ',' ORDER BY rid, off) AS places FROM occ GROUP BY kmer HAVING count(*) BETWEEN 2 AND 8")
def a02_index(spark, d):
    found = kmers.places(views.reads(spark, d), 15, 10, 8).where(F.size("places") > 1)
    text = F.array_join(F.transform("places", lambda p: F.concat_ws(":", p.rid, p.off)), ",")
    return found.select("kmer", F.size("places").cast("long").alias("n"), F.col("places")[0].rid.alias("first_read"), text.alias("places"))


@query(f"WITH {_KMERS} SELECT count(*) AS kmers, CAST(coalesce(sum(n), 0) AS BIGINT) AS occurrences FROM (SELECT count(*) AS n FROM occ GROUP BY kmer) WHERE n > 8")
def a01_removed_kmers(spark, d):
    return kmers.removed(_occurrences(spark, d), 8)


def _units(name, bases, number):
    """SQL: each read's unit, closed by the read with which it reaches so many bases or reads."""
    full = f"s >= {bases} OR n >= {number}"
    return f"""{name}_(i, rid, s, n, unit) AS (SELECT i, rid, len, 1, 0 FROM numbered WHERE i = 1
 UNION ALL SELECT o.i, o.rid, CASE WHEN {full} THEN o.len ELSE s + o.len END, CASE WHEN {full} THEN 1 ELSE n + 1 END, unit + CASE WHEN {full} THEN 1 ELSE 0 END FROM {name}_ f JOIN numbered o ON o.i = f.i + 1), {name} AS (SELECT rid, unit FROM {name}_)"""


#: Bases and reads of a subjects' volume and of a batch of queries.
VOLUME, BATCH = (200_000, 150), (100_000, 75)
_SEEDS = f"""RECURSIVE {_WORDS}, numbered AS (SELECT rid, length(seq) AS len, row_number() OVER (ORDER BY rid) AS i FROM reads), {_units("vols", *VOLUME)}, {_units("batches", *BATCH)},
okq AS (SELECT * FROM (SELECT words.*, count(*) OVER (PARTITION BY kmer, unit) AS n FROM words JOIN batches USING (rid)) WHERE n <= 200), oks AS (SELECT * FROM (SELECT occ.*, count(*) OVER (PARTITION BY kmer, unit) AS n FROM occ JOIN vols USING (rid)) WHERE n <= 200),
seeds AS (SELECT q.rid AS qid, CAST(q.qdir AS INT) AS qdir, CAST(q.off AS BIGINT) AS qoff, s.rid AS sid, CAST(s.off AS BIGINT) AS soff FROM okq q JOIN oks s ON q.kmer = s.kmer AND s.rid < q.rid)"""


@functools.cache
def _starts(app, d, unit):
    spark = SparkSession.active()
    return volumes.starts(views.lengths(spark, d), "rid", "len", *unit)


def _unit_starts(spark, d, unit):
    """First reads of the units of these tables; many queries ask for them."""
    return _starts(spark.sparkContext.applicationId, d, unit)


def _blocks(spark, d, **also):
    """Sampled words of both strands, at each base, and the index of every tenth base, in blocks; frequent ones are dropped by batch and volume."""
    reads = views.reads(spark, d)
    asked = seeds.blocks(reads, _unit_starts(spark, d, BATCH), seeds.QUERY_UNITS, 15, reverse=True, sample=True, **also)
    return asked, seeds.blocks(reads, _unit_starts(spark, d, VOLUME), seeds.SUBJECT_UNITS, 15, 10, **also)


def _seeds(spark, d):
    """Places where these meet."""
    return seeds.seeds(*_blocks(spark, d), 15)


@query(f"WITH {_SEEDS} SELECT * FROM seeds")
def j01_seed_join(spark, d):
    return _seeds(spark, d)


_PAIRS = f"{_SEEDS}, c AS (SELECT qid, qdir, sid, soff, count(*) AS k FROM seeds GROUP BY ALL HAVING count(*) <= 4), cand AS (SELECT qid, qdir, sid, CAST(sum(k) AS BIGINT) AS seeds, min(soff) AS first, max(soff) AS last FROM c GROUP BY qid, qdir, sid HAVING sum(k) >= 3)"


@query(f"WITH {_PAIRS} SELECT * FROM cand")
def t05_candidate_pairs(spark, d):
    return seeds.candidates(*_blocks(spark, d), 15)


@query(f"""WITH {_PAIRS}, q AS (SELECT rid, qdir, kmer, count(*) AS n, list(off) AS offs FROM words GROUP BY ALL HAVING count(*) <= 8), s AS (SELECT rid, kmer, count(*) AS n, list(off) AS offs FROM occ GROUP BY ALL HAVING count(*) <= 8),
m AS (SELECT p.qid, q.qdir, p.sid, q.offs AS x, s.offs AS y FROM (SELECT DISTINCT qid, sid FROM cand) p JOIN q ON q.rid = p.qid JOIN s ON s.rid = p.sid AND s.kmer = q.kmer WHERE q.n * s.n <= 8)
SELECT qid, CAST(qdir AS INT) AS qdir, CAST(qoff AS BIGINT) AS qoff, sid, CAST(unnest(y) AS BIGINT) AS soff FROM (SELECT qid, qdir, sid, y, unnest(x) AS qoff FROM m)""")
def j02_capped_seed_join(spark, d):
    """Words of candidate pairs, left out only by how often the two reads have them."""
    return seeds.pair_seeds(*_blocks(spark, d, own=8), 15)


@query()
def t04_chain(spark, d):
    """The best chain of each pair."""
    return seeds.best_chains(*_blocks(spark, d), 15).withColumn("seeds", F.col("seeds").cast("int"))


_CHAIN = f"{_SEEDS}, one AS (SELECT qid, qdir, sid, qoff, min(soff) AS soff FROM seeds GROUP BY ALL), chain AS (SELECT qid, qdir, sid, qoff, soff FROM (SELECT *, max(soff) OVER (PARTITION BY qid, qdir, sid ORDER BY qoff ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM one) WHERE top IS NULL OR soff > top)"
_RUNS = f"""{_CHAIN}, l AS (SELECT *, lag(qoff - soff) OVER (PARTITION BY qid, qdir, sid ORDER BY qoff) AS d FROM chain),
i AS (SELECT *, sum(CASE WHEN d = qoff - soff THEN 0 ELSE 1 END) OVER (PARTITION BY qid, qdir, sid ORDER BY qoff) AS run FROM l),
runs AS (SELECT qid, qdir, sid, min(qoff) AS qoff, min(soff) AS soff, max(qoff) - min(qoff) + 15 AS size, count(*) AS seeds FROM i GROUP BY qid, qdir, sid, run)"""


@query(f"WITH {_RUNS} SELECT * FROM runs")
def w10_diagonal_runs(spark, d):
    return seeds.diagonal_runs(*_blocks(spark, d), 15)


@query(f"""WITH {_RUNS}, p AS (SELECT qid, runs.qdir AS qdir, sid, qoff, soff, substr(a.seq, qoff + 1, size) AS x, substr(b.seq, soff + 1, size) AS y, size FROM runs JOIN strands a ON a.rid = qid AND a.qdir = runs.qdir JOIN reads b ON b.rid = sid),
c AS (SELECT qid, qdir, sid, qoff, soff, k, x[k + 1] = y[k + 1] AS same FROM p, unnest(range(0, size)) AS t(k)),
g AS (SELECT *, k - row_number() OVER (PARTITION BY qid, qdir, sid, qoff ORDER BY k) AS island FROM c WHERE same)
SELECT qid, qdir, sid, qoff + min(k) AS qoff, soff + min(k) AS soff, count(*) AS size FROM g GROUP BY qid, qdir, sid, g.qoff, g.soff, island HAVING count(*) >= 15""")
def w10_exact_matches(spark, d):
    return seeds.exact_matches(*_blocks(spark, d, text=True), 15)


@query(f"""WITH {_CHAIN}, a AS (SELECT *, lead(qoff) OVER w - qoff AS dq, lead(soff) OVER w - soff AS ds, lag(qoff) OVER w AS back FROM chain WINDOW w AS (PARTITION BY qid, qdir, sid ORDER BY qoff)),
n AS (SELECT *, coalesce(abs(dq - ds) <= 100 AND abs(1.0 - CAST(dq AS DOUBLE) / ds) <= CAST(0.21 AS DOUBLE), false) AS near FROM a),
t AS (SELECT *, coalesce(lag(near) OVER (PARTITION BY qid, qdir, sid ORDER BY qoff), false) AS tied FROM n)
SELECT qid, qdir, sid, qoff, soff FROM t WHERE near OR tied OR back IS NULL OR dq IS NULL""")
def w11_trace_points(spark, d):
    return seeds.trace_points(*_blocks(spark, d), 15)


_SIDE = "CASE WHEN {1} <= {0} THEN {1} ELSE least(CAST(floor(1.3::DOUBLE * qsize) AS BIGINT), {0} + 30000, {1}) END"


@query(f"WITH {views.ALN_SQL} SELECT aid, CASE WHEN ssize - qsize <= 2000 THEN 0 ELSE soff - {_SIDE.format('qoff', 'soff')} END AS sfrom, CASE WHEN ssize - qsize <= 2000 THEN ssize ELSE soff + {_SIDE.format('(qsize - qoff)', '(ssize - soff)')} END AS sto FROM (SELECT aid, qsize, qoff, soff, CASE WHEN aid % 3 = 0 THEN qsize + soff + aid % 5000 ELSE ssize END AS ssize FROM aln)")
def t06_window(spark, d):
    near = F.when(F.col("aid") % 3 == 0, F.col("qsize") + F.col("soff") + F.col("aid") % 5000).otherwise(F.col("ssize"))
    return kmers.window(views.alignments(spark, d).withColumn("ssize", near)).select("aid", "sfrom", "sto")


_NAMED = f"{views.ALN_SQL}, named AS (SELECT *, 'r' || qid % 1200 AS qname, 's' || sid AS sname, CAST(0 AS INT) AS sdir, qend - qoff AS columns, (qend - qoff) * ident // 100 AS matches, (qend - qoff) || 'M' AS cigar, (qend - qoff) || 'A0' AS md, 'ACGT' AS seq, ident - 0.25::DOUBLE * (aid % 4) AS eff FROM aln)"


def _named(spark, d):
    """The alignments with names, and columns that stand for a path."""
    a = views.alignments(spark, d)
    size = F.col("qend") - F.col("qoff")
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    return a.withColumns({"qname": name("r", F.col("qid") % 1200), "sname": name("s", F.col("sid")), "sdir": F.lit(0), "columns": size, "matches": F.floor(size * F.col("ident") / 100), "cigar": F.concat(size.cast("string"), F.lit("M")), "md": F.concat(size.cast("string"), F.lit("A0")), "seq": F.lit("ACGT"), "eff": F.col("ident") - 0.25 * (F.col("aid") % 4)})


@query(f"WITH {_NAMED}, n AS (SELECT 'r' || doc_id AS name, doc_id AS id FROM documents) SELECT aid, id AS read FROM named JOIN n ON name = qname")
def j03_name_lookup(spark, d):
    names = views.reads(spark, d).select("name", F.col("rid").alias("id"))
    return records.with_ids(_named(spark, d).select("aid", "qname"), names, "qname", "read").select("aid", "read")


@query(f"WITH {_NAMED}, n AS (SELECT 'r' || doc_id AS name, doc_id AS id FROM documents UNION ALL SELECT 's' || r_regionkey, -r_regionkey FROM region WHERE r_regionkey > 0) SELECT aid, a.id AS a, b.id AS b FROM named JOIN n a ON a.name = qname JOIN n b ON b.name = sname")
def j12_id_remap(spark, d):
    regions = views.table(spark, d, "region").where("r_regionkey > 0").select(F.concat(F.lit("s"), F.col("r_regionkey").cast("string")).alias("name"), (-F.col("r_regionkey")).cast("long").alias("id"))
    names = views.reads(spark, d).select("name", F.col("rid").cast("long").alias("id")).unionByName(regions)
    return records.remapped(_named(spark, d).select("aid", "qname", "sname"), names, {"qname": "a", "sname": "b"})


@query(f"WITH {views.ALN_SQL} SELECT doc_id AS rid FROM documents WHERE doc_id IN (SELECT qid FROM aln WHERE ident >= 90)")
def j11_semi(spark, d):
    """Reads of a good alignment."""
    good = views.alignments(spark, d).where("ident >= 90").select("qid")
    return records.only(views.lengths(spark, d).select("rid"), good)


@query(f"WITH {views.ALN_SQL} SELECT doc_id AS rid FROM documents WHERE doc_id NOT IN (SELECT qid FROM aln WHERE ident >= 90)")
def j11_anti(spark, d):
    """Reads without a good alignment."""
    good = views.alignments(spark, d).where("ident >= 90").select("qid")
    return records.only(views.lengths(spark, d).select("rid"), good, keep=False)


@query(f"WITH {views.READS_SQL}, {views.ALN_SQL} SELECT rid, name, seq FROM reads WHERE rid IN (SELECT qid FROM aln WHERE ident >= 95)")
def s18_selected_reads(spark, d):
    """Only the sequences that are asked for."""
    return records.only(views.reads(spark, d), views.alignments(spark, d).where("ident >= 95").select("qid"))


@query(f"WITH {views.READS_SQL}, p AS (SELECT *, length(seq) // 4 AS a, length(seq) - length(seq) // 3 AS b, CAST(rid % 2 AS INT) AS dir FROM reads) SELECT rid, dir, substr(CASE WHEN dir = 1 THEN reverse(translate(seq, 'ACGT', 'TGCA')) ELSE seq END, a + 1, b - a) AS part FROM p")
def s17_sub_reads(spark, d):
    """A part of each read, of either strand."""
    n = F.length("seq")
    p = views.reads(spark, d).withColumns({"a": F.floor(n / 4), "b": n - F.floor(n / 3), "dir": (F.col("rid") % 2).cast("int")})
    return p.select("rid", "dir", sq.sub_read("seq", "a", "b", "dir").alias("part"))


@query("SELECT doc_id AS rid, lpad(CAST(row_number() OVER (ORDER BY doc_id) - 1 AS VARCHAR), 10, '0') AS name FROM documents")
def k03_renamed(spark, d):
    return records.renamed(views.lengths(spark, d).select("rid"), "rid")


@query(f"WITH {views.READS_SQL} SELECT rid FROM reads WHERE length(seq) >= 1000")
def f01_min_size(spark, d):
    return views.reads(spark, d).where(sq.long_enough("seq", 1000)).select("rid")


_M4 = "concat_ws(chr(9), qname, sname, printf('%.2f', ident::DOUBLE), score, qdir, qoff, qend, qsize, sdir, soff, send, ssize)"
_SQL_TAGS = "'s1:i:' || score, 'NM:i:' || (columns - matches), 'AS:i:' || score"


@query(f"WITH {_NAMED} SELECT {_M4} AS value FROM named")
def k06_m4_lines(spark, d):
    return records.m4_lines(_named(spark, d))


@query(f"WITH {_NAMED} SELECT qname, sname, CAST(ident AS DOUBLE) AS ident, CAST(score AS INT) AS score, qdir, qoff, qend, qsize, sdir, soff, send, ssize FROM named")
def s08_m4_round_trip(spark, d):
    """Lines of alignments, written and parsed."""
    return records.parsed(records.m4_lines(_named(spark, d)), schemas.ALIGNMENT)


@query(f"WITH {_NAMED} SELECT concat_ws(chr(9), qname, qsize, qoff, qend, CASE WHEN qdir = 1 THEN '-' ELSE '+' END, sname, ssize, soff, send, matches, columns, 60, {_SQL_TAGS}, 'cg:Z:' || cigar, 'MD:Z:' || md) AS value FROM named")
def k07_paf_lines(spark, d):
    return records.paf_lines(_named(spark, d), cigar=True, md=True)


_SAM = "qname, CASE WHEN qdir = 1 THEN 16 ELSE 0 END, sname, soff + 1, 60, CASE WHEN qoff > 0 THEN qoff || 'S' ELSE '' END || cigar || CASE WHEN qsize - qend > 0 THEN (qsize - qend) || 'S' ELSE '' END, '*', '*', 0, seq, '*'"


@query(f"WITH {_NAMED} SELECT concat_ws(chr(9), {_SAM}, {_SQL_TAGS}, 'MD:Z:' || md) AS value FROM named")
def k08_sam_lines(spark, d):
    return records.sam_lines(_named(spark, d), md=True)


@query(f"""WITH {_NAMED} SELECT concat_ws(chr(9), {_SAM}, {_SQL_TAGS}, 'RG:Z:g1', 'qs:i:' || qoff, 'qe:i:' || qend, 'ql:i:' || qsize, 'mc:f:' || ident, 'ec:f:' || regexp_replace(regexp_replace(printf('%.4f', eff), '0+$', ''), '\\.$', '')) AS value FROM named""")
def k09_remapped_sam_lines(spark, d):
    return records.sam_lines(_named(spark, d), group="g1", places=True)


@query(f"WITH {_NAMED}, h AS (SELECT DISTINCT sname, ssize FROM named) SELECT 1 AS nth, concat_ws(chr(9), '@SQ', 'SN:' || sname, 'LN:' || ssize) AS value FROM h UNION ALL SELECT 0, concat_ws(chr(9), '@HD', 'VN:1.6', 'SO:unknown', 'GO:query') UNION ALL SELECT 2, concat_ws(chr(9), '@PG', 'ID:readloom', 'PN:readloom') UNION ALL SELECT 3, concat_ws(chr(9), '@RG', 'ID:subject1', 'SM:x')")
def k10_sam_header(spark, d):
    return records.sam_header(_named(spark, d).select("sname", "ssize").distinct(), group="subject1", sample="x")


@query(f"WITH {views.ALN_SQL} SELECT concat_ws(chr(9), qid, sid, max(score)) AS value FROM aln GROUP BY qid, sid")
def k11_candidate_lines(spark, d):
    return records.candidate_lines(hits.best_scores(views.alignments(spark, d)).withColumnRenamed("best", "score"))


@query(f"""WITH {views.ALN_SQL}, ev AS (SELECT sid, pos, sum(d) AS d FROM (SELECT sid, soff AS pos, 1 AS d FROM aln UNION ALL SELECT sid, send, -1 FROM aln) GROUP BY sid, pos), st AS (SELECT sid, pos AS f, lead(pos) OVER (PARTITION BY sid ORDER BY pos) AS t, sum(d) OVER (PARTITION BY sid ORDER BY pos ROWS UNBOUNDED PRECEDING) AS depth FROM ev),
deep AS (SELECT * FROM st WHERE t IS NOT NULL AND depth >= (SELECT 0.9 * max(depth) FROM st)), k AS (SELECT aid, sum(least(send, t) - greatest(soff, f)) AS k FROM aln JOIN deep ON deep.sid = aln.sid AND soff < t AND f < send GROUP BY aid)
SELECT aid, send - soff - coalesce(k, 0) < 200 AS full_ FROM aln LEFT JOIN k USING (aid)""")
def f12_saturated(spark, d):
    """Alignments whose places are nearly all among the deepest: nine tenths of the greatest depth, or more."""
    a = views.alignments(spark, d).select("aid", "sid", F.col("soff").alias("from"), F.col("send").alias("to"))
    depths = intervals.depth(a, ["sid"])
    least = depths.agg(F.ceil(0.9 * F.max("depth"))).first()[0] or 0
    return intervals.saturated(a, depths, ["sid"], "aid", least).select("aid", F.col("full").alias("full_"))


_LONG_MASK = f"{views.MASK_SQL}, e AS (SELECT *, max(t) OVER (PARTITION BY sid ORDER BY f, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM mask WHERE t - f > {views.LONG}), i AS (SELECT *, sum(CASE WHEN before IS NULL OR f > before THEN 1 ELSE 0 END) OVER (PARTITION BY sid ORDER BY f, t ROWS UNBOUNDED PRECEDING) AS k FROM e), u AS (SELECT sid, min(f) AS f, max(t) AS t FROM i GROUP BY sid, k)"
_ALN_MASKED = f"{views.ALN_SQL}, {_LONG_MASK}, m AS (SELECT aid, sum(least(send, t) - greatest(soff, f)) AS k FROM aln JOIN u ON u.sid = aln.sid AND soff < t AND f < send GROUP BY aid), am AS (SELECT aln.*, send - soff - coalesce(k, 0) <= 2000 AS masked FROM aln LEFT JOIN m USING (aid))"


def _with_mask(spark, d):
    """The alignments, and whether the long repeats leave too little of them."""
    a = views.alignments(spark, d).withColumns({"from": F.col("soff"), "to": F.col("send")})
    long = views.mask(spark, d).where(F.col("to") - F.col("from") > views.LONG)
    masked = intervals.masked_bases(a, long, ["sid"], "aid")
    return masked.withColumn("masked", ~intervals.unmasked_enough(F.col("to") - F.col("from"), F.col("masked"))).drop("from", "to")


_DUAL = f"""{_ALN_MASKED}, g AS (SELECT * FROM am WHERE ident >= 70 AND NOT masked), l AS (SELECT * FROM g WHERE qoff <= 300 AND qsize - qend > 300), r AS (SELECT * FROM g WHERE qoff > 300 AND qsize - qend <= 300),
dual AS (SELECT l.qid, l.sid, l.aid AS left_id, l.qdir AS ldir, l.qoff AS lqb, l.qend AS lqe, l.soff AS lb, l.send AS le, r.aid AS right_id, r.qdir AS rdir, r.qoff AS rqb, r.qend AS rqe, r.soff AS rb, r.send AS re
 FROM l JOIN r USING (qid, sid) WHERE CASE WHEN l.soff < r.soff THEN r.soff - l.send ELSE l.soff - r.send END <= 30000)"""


@query(f"WITH {_DUAL} SELECT * FROM dual")
def j04_dual_pairs(spark, d):
    return hits.dual_pairs(_with_mask(spark, d), masked="masked")


@query(f"""WITH {_DUAL}, one AS (SELECT *, count(*) OVER (PARTITION BY qid) AS n FROM dual)
SELECT qid, sid, ldir AS qdir, left_id, right_id, least(lqb, rqb) AS qoff, greatest(lqe, rqe) AS qend, least(lb, rb) AS soff, greatest(le, re) AS send FROM one WHERE n = 1 AND ldir = rdir AND CASE WHEN ldir = 0 THEN lb <= rb ELSE rb <= lb END""")
def a13_unique_dual(spark, d):
    return hits.unique_duals(hits.dual_pairs(_with_mask(spark, d), masked="masked"))


# the eight cases as rows: which end x has, which end y has, what must run forward, whose start is the hull's
_CASES = [
    ("x.soff <= 50", "y.ssize - y.send <= 50", "y.qend > x.qoff", "x"), ("x.soff <= 50", "y.qsize - y.qend <= 50", "y.send > x.soff", "x"),
    ("x.ssize - x.send <= 50", "y.soff <= 50", "y.qoff < x.qend", "y"), ("x.ssize - x.send <= 50", "y.qoff <= 50", "y.soff < x.send", "y"),
    ("x.qoff <= 50", "y.qsize - y.qend <= 50", "x.soff < y.send", "x"), ("x.qoff <= 50", "y.ssize - y.send <= 50", "x.qoff < y.qend", "x"),
    ("x.qsize - x.qend <= 50", "y.qoff <= 50", "y.soff < x.send", "y"), ("x.qsize - x.qend <= 50", "y.soff <= 50", "y.qoff < x.qend", "y"),
]
_CASE_SQL = " UNION ALL ".join(f"SELECT x.qid, x.sid, x.qdir, x.aid AS a, y.aid AS b, {n} AS c, {p}.qoff AS qoff, {'y' if p == 'x' else 'x'}.qend AS qend, {p}.soff AS soff, {'y' if p == 'x' else 'x'}.send AS send FROM ovl x JOIN ovl y ON x.qid = y.qid AND x.sid = y.sid AND x.qdir = y.qdir AND x.aid <> y.aid WHERE {has} AND {other} AND {forward}" for n, (has, other, forward, p) in enumerate(_CASES, 1))


@query(f"""WITH {views.ALN_SQL}, {views.OVERLAP_SQL}, every AS ({_CASE_SQL}), one AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY c) AS n FROM every)
SELECT qid, sid, qdir, a, b, CAST(c AS INT) AS "case", qoff, qend, soff, send, CAST(row_number() OVER (PARTITION BY qid, sid ORDER BY least(a, b), greatest(a, b), a > b) AS INT) AS rank FROM one WHERE n = 1""")
def j06_dual_cases(spark, d):
    return hits.broken_pairs(views.overlapping(spark, d))


_WHOLE = "((qoff <= 300 AND qsize - qend <= 300) OR (soff <= 300 AND ssize - send <= 300) OR (qoff <= 300 AND ssize - send <= 300) OR (qsize - qend <= 300 AND soff <= 300))"


@query(f"""WITH {views.ALN_SQL}, {views.BROKEN_SQL}, good AS (SELECT * FROM ovl WHERE ident >= 80), whole AS (SELECT *, row_number() OVER (PARTITION BY qid, sid ORDER BY aid) AS n FROM good WHERE {_WHOLE}),
rest AS (SELECT * FROM good g WHERE NOT EXISTS (SELECT 1 FROM whole w WHERE w.qid = g.qid AND w.sid = g.sid)), every AS ({_CASE_SQL.replace("ovl", "rest")}), one AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY c) AS n FROM every),
sized AS (SELECT one.* EXCLUDE (n), x.qsize, x.ssize FROM one JOIN rest x ON x.aid = one.a WHERE n = 1), pick AS (SELECT *, row_number() OVER (PARTITION BY qid, sid ORDER BY least(a, b), greatest(a, b), a > b) AS n FROM sized WHERE {_WHOLE})
SELECT qid, sid, qdir, aid AS a, CAST(NULL AS BIGINT) AS b, CAST(qoff AS BIGINT) AS qoff, CAST(qend AS BIGINT) AS qend, CAST(soff AS BIGINT) AS soff, CAST(send AS BIGINT) AS send FROM whole WHERE n = 1
UNION ALL SELECT qid, sid, qdir, a, b, CAST(qoff AS BIGINT), CAST(qend AS BIGINT), CAST(soff AS BIGINT), CAST(send AS BIGINT) FROM pick WHERE n = 1""")
def j07_resolved_overlaps(spark, d):
    got = hits.resolved_overlaps(views.broken(spark, d))
    return got.withColumns({c: F.col(c).cast("long") for c in ("qoff", "qend", "soff", "send")})


@query(f"""WITH RECURSIVE {views.ALN_SQL}, half AS (SELECT 0 AS i, CAST(0 AS DOUBLE) AS lo, CAST(4 AS DOUBLE) AS hi UNION ALL SELECT i + 1, CASE WHEN exp((lo + hi) / 2) / 4 + 0.75 * exp(-(lo + hi)) < 1 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN exp((lo + hi) / 2) / 4 + 0.75 * exp(-(lo + hi)) < 1 THEN hi ELSE (lo + hi) / 2 END FROM half WHERE i < 60),
rate AS (SELECT max(lo) AS r FROM half), mean AS (SELECT r, exp(r) / 4 - 1.5 * exp(-2 * r) AS a FROM rate),
sums AS (SELECT sum(exp(lgamma(j + 1) - lgamma(i + 1) - lgamma(j - i + 1) + i * ln(0.25) + (j - i) * ln(0.75) + r * least(0, 3 * i - 2 * j)) / j) AS t FROM range(1, 400) AS x(j), range(0, 400) AS y(i), rate WHERE i <= j),
par AS (SELECT r, r * a AS h, exp(-2 * t) / (a * (1 - exp(-r))) AS k FROM mean, sums), whole AS (SELECT sum(n) AS n, count(*) AS c FROM (SELECT max(ssize) AS n FROM aln GROUP BY sid)),
adj AS (SELECT qsize, max(l) AS l FROM (SELECT DISTINCT qsize FROM aln), range(0, 200) AS x(l), par, whole WHERE l < qsize AND l * c < n AND l * h <= ln(k) + ln((qsize - l) * (n - c * l)) GROUP BY qsize),
e AS (SELECT aid, CAST(l AS BIGINT) AS length_adjustment, (r * (score // 1000) - ln(k)) / ln(2) AS bits, ln(k) + ln(qsize - l) + ln(n - c * l) - r * (score // 1000) AS x FROM aln JOIN adj USING (qsize), par, whole)
SELECT aid, length_adjustment, round(bits, 6) AS bits, round(x / ln(10), 6) AS log10_e, round(CASE WHEN x < -12 THEN x - exp(x) / 2 WHEN exp(x) > 30 THEN 0 ELSE ln(1 - exp(-exp(x))) END / ln(10), 6) + 0.0 AS log10_p FROM e""")
def p22_significance(spark, d):
    par = significance.parameters(significance.match_scores(1, -2))
    rows = views.alignments(spark, d).withColumn("score", F.expr("score div 1000"))
    got = significance.with_significance(rows, par)
    return got.select("aid", "length_adjustment", *((F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("bits", "log10_e", "log10_p")))


_UNION = f"""{views.MASK_SQL}, e AS (SELECT *, max(t) OVER (PARTITION BY sid ORDER BY f, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM mask), i AS (SELECT *, sum(CASE WHEN before IS NULL OR f > before THEN 1 ELSE 0 END) OVER (PARTITION BY sid ORDER BY f, t ROWS UNBOUNDED PRECEDING) AS k FROM e),
u AS (SELECT sid, min(f) AS f, max(t) AS t, count(*) AS n, CAST(sum(t - f) AS BIGINT) AS residues FROM i GROUP BY sid, k)"""


@query(f'WITH {_UNION} SELECT sid, f AS "from", t AS "to", n, residues FROM u')
def a16_union(spark, d):
    return intervals.merge(views.mask(spark, d), ["sid"])


_MASKED = f"{views.ALN_SQL}, {_UNION}, m AS (SELECT aid, sum(least(send, t) - greatest(soff, f)) AS k FROM aln JOIN u ON u.sid = aln.sid AND soff < t AND f < send GROUP BY aid), am AS (SELECT aln.*, CAST(coalesce(k, 0) AS BIGINT) AS masked FROM aln LEFT JOIN m USING (aid))"


def _masked(spark, d):
    a = views.alignments(spark, d).select("aid", "sid", F.col("soff").alias("from"), F.col("send").alias("to"))
    return intervals.masked_bases(a, views.mask(spark, d), ["sid"], "aid")


@query(f"WITH {_MASKED} SELECT aid, masked FROM am")
def j05_mask_fraction(spark, d):
    return _masked(spark, d).select("aid", "masked")


@query(f"WITH {_MASKED} SELECT aid FROM am WHERE send - soff - masked > 2000")
def f04_mask_filter(spark, d):
    return _masked(spark, d).where(intervals.unmasked_enough(F.col("to") - F.col("from"), F.col("masked"), 2000)).select("aid")


@query(f"WITH {views.ALN_SQL} SELECT qid, sid, max(score) AS best FROM aln GROUP BY qid, sid")
def a07_subject_best(spark, d):
    return hits.best_scores(views.alignments(spark, d))


_TOP = f"{views.ALN_SQL}, b AS (SELECT qid, sid, max(score) AS best FROM aln GROUP BY qid, sid), t AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY best DESC, sid) AS subject_rank FROM b)"


@query(f"WITH {_TOP} SELECT aid, CAST(subject_rank AS INT) AS subject_rank FROM aln JOIN t USING (qid, sid) WHERE subject_rank <= 2")
def o04_topk_subjects(spark, d):
    return hits.top_subjects(views.alignments(spark, d), 2).select("aid", "subject_rank")


@query(f"WITH {_TOP}, o AS (SELECT aid, subject_rank, row_number() OVER (PARTITION BY qid, sid ORDER BY score DESC, aid) AS n FROM aln JOIN t USING (qid, sid) WHERE subject_rank <= 3) SELECT aid, CAST(subject_rank AS INT) AS subject_rank FROM o WHERE n = 1")
def o05_topk_one(spark, d):
    return hits.top_subjects(views.alignments(spark, d), 3, one_each=True).select("aid", "subject_rank")


@query(f"WITH {views.ALN_SQL} SELECT aid, CAST(n AS INT) AS hsp_rank FROM (SELECT aid, row_number() OVER (PARTITION BY qid, sid ORDER BY score DESC, aid) AS n FROM aln) WHERE n <= 2")
def o06_topk_hsps(spark, d):
    return hits.top_hsps(views.alignments(spark, d), 2).select("aid", "hsp_rank")


@query(f"""WITH {views.ALN_SQL}, near AS (SELECT *, sid % 2 AS s2 FROM aln), e AS (SELECT *, max(send) OVER w AS before FROM near WINDOW w AS (PARTITION BY qid, s2, qdir ORDER BY soff, send, aid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
i AS (SELECT *, sum(CASE WHEN before IS NULL OR soff > before + 9000 THEN 1 ELSE 0 END) OVER (PARTITION BY qid, s2, qdir ORDER BY soff, send, aid ROWS UNBOUNDED PRECEDING) AS k FROM e),
b AS (SELECT *, max(score) OVER (PARTITION BY qid, s2, qdir, k) AS best, min(soff) OVER (PARTITION BY qid, s2, qdir, k) AS f, row_number() OVER (PARTITION BY qid, s2, qdir, k ORDER BY score DESC, aid) AS nth FROM i),
w AS (SELECT *, dense_rank() OVER (PARTITION BY qid, s2 ORDER BY best DESC, qdir, f) AS win FROM b), r AS (SELECT *, row_number() OVER (PARTITION BY qid, s2 ORDER BY win, nth) AS hsp_rank FROM w WHERE win <= 4 AND nth <= 3)
SELECT aid, CAST(win AS INT) AS "window", CAST(hsp_rank AS INT) AS hsp_rank FROM r WHERE hsp_rank <= 2""")
def o06_window_hsps(spark, d):
    """Window by window, two rows a pair."""
    a = views.alignments(spark, d).select("aid", "qid", (F.col("sid") % 2).alias("sid"), "qdir", "soff", "send", "score")
    return hits.top_window_hsps(a, 2, 9000).select("aid", "window", "hsp_rank")


@query(f"WITH {views.ALN_SQL}, b AS (SELECT sid, qid, max(score) AS score FROM aln GROUP BY sid, qid) SELECT sid, qid, score, CAST(n AS INT) AS support_rank FROM (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY score DESC, qid) AS n FROM b) WHERE n <= 100")
def o07_topk_support(spark, d):
    return hits.top_support(views.alignments(spark, d), 100)


@query(f"""WITH {views.ALN_SQL}, e AS (SELECT *, max(send) OVER w AS before FROM aln WINDOW w AS (PARTITION BY qid, sid, qdir ORDER BY soff, send ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), i AS (SELECT *, sum(CASE WHEN before IS NULL OR soff > before + 500 THEN 1 ELSE 0 END) OVER (PARTITION BY qid, sid, qdir ORDER BY soff, send ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT qid, sid, qdir, min(soff) AS soff, max(send) AS send, count(*) AS n, CAST(sum(send - soff) AS BIGINT) AS residues, max(score) AS score FROM i GROUP BY qid, sid, qdir, k""")
def a08_merge_windows(spark, d):
    return intervals.merge(views.alignments(spark, d), ["qid", "sid", "qdir"], "soff", "send", 500, "score", bin_size=None)


def _fold_ctes(name: str, source: str, keys: str, order: str, first: str, second: str | None) -> str:
    """CTE ``name``: aid of the rows of ``source`` that stay, a key's rows being taken in order; each that is left meets
    those after it. ``first``: later row j goes; ``second``: then i goes. Without ``second`` both go where ``first`` holds.
    """
    hit = f"(j > i + 1 AND alive[j] AND {first})"
    back = f"(j > i + 1 AND alive[j] AND NOT {first} AND {second})" if second else hit
    return f"""{name}_g AS (SELECT {keys}, list({{'aid': aid, 'qoff': qoff, 'qend': qend, 'soff': soff, 'send': send}} ORDER BY {order}) AS r FROM {source} GROUP BY {keys}),
{name}_f AS (SELECT {keys}, r, 0 AS i, list_transform(r, lambda x: true) AS alive FROM {name}_g
 UNION ALL SELECT {keys}, r, i + 1, CASE WHEN alive[i + 1] THEN list_transform(range(1, len(r) + 1), lambda j: alive[j] AND NOT {hit} AND NOT (j = i + 1 AND len(list_filter(range(1, len(r) + 1), lambda k: {back.replace("j", "k")})) > 0)) ELSE alive END FROM {name}_f WHERE i < len(r)),
{name} AS (SELECT r[p].aid AS aid FROM (SELECT r, alive, unnest(range(1, len(r) + 1)) AS p FROM {name}_f WHERE i = len(r)) WHERE alive[p])"""


def _fold_sql(keys: str, order: str, first: str, second: str | None) -> str:
    return f"WITH RECURSIVE {views.ALN_SQL}, {_fold_ctes('kept', 'aln', keys, order, first, second)} SELECT aid FROM kept"


_J, _I = "r[j]", "r[i + 1]"
_INSIDE = "({0}.qoff + 200 >= {1}.qoff AND {0}.qend <= {1}.qend + 200 AND {0}.soff + 200 >= {1}.soff AND {0}.send <= {1}.send + 200)"
_FIRST, _LAST = f"greatest({_I}.qoff, {_J}.qoff)", f"least({_I}.qend, {_J}.qend)"
_SAME = f"({_FIRST} < {_LAST} AND {_FIRST} - {_I}.qoff + {_I}.qend - {_LAST} <= 300 AND {_FIRST} - {_J}.qoff + {_J}.qend - {_LAST} <= 300)"


@query(_fold_sql("qid, sid, qdir", "aid", _INSIDE.format(_J, _I), _INSIDE.format(_I, _J)))
def a09_containment(spark, d):
    return intervals.drop_contained(views.alignments(spark, d), ["qid", "sid", "qdir"], ["aid"]).select("aid")


@query(_fold_sql("qid, sid, qdir", "score DESC, aid", _INSIDE.format(_J, _I), _INSIDE.format(_I, _J)))
def a10_scored_containment(spark, d):
    ranked = views.alignments(spark, d).withColumn("rank", -F.col("score"))
    return intervals.drop_contained(ranked, ["qid", "sid", "qdir"], ["rank", "aid"]).select("aid")


@query(_fold_sql("qid", "aid", _SAME, None))
def a11_repeats(spark, d):
    return intervals.drop_repeats(views.alignments(spark, d), "qid", ["aid"]).select("aid")


@query(f"WITH {_ALN_MASKED}, c AS (SELECT *, count(*) OVER (PARTITION BY qid) AS alone FROM am WHERE qoff <= 300 AND qsize - qend <= 300), g AS (SELECT *, CASE WHEN alone = 1 AND ident >= 70 THEN ident ELSE ident - aid % 4 END AS by_ FROM c), k AS (SELECT *, row_number() OVER w AS n, lead(by_) OVER w AS nx FROM g WHERE by_ >= 70 WINDOW w AS (PARTITION BY qid ORDER BY by_ DESC, aid)) SELECT qid, aid, ident FROM k WHERE n = 1 AND (nx IS NULL OR by_ - nx > 10) AND NOT masked")
def a12_best_complete(spark, d):
    """The view has no columns to measure; an effective identity of up to three less stands in."""
    a = _with_mask(spark, d).withColumn("eff", F.col("ident") - F.col("aid") % 4)
    return hits.best_complete(a, 70, effective="eff", masked="masked").select("qid", "aid", "ident")


@query(f"WITH {views.ALN_SQL} SELECT qid, sid, soff FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY aid DESC) AS n FROM aln) WHERE n = 1")
def a15_last_writer(spark, d):
    return hits.last_writer(views.alignments(spark, d).select("qid", "aid", "sid", "soff"), "qid", "aid")


@query(f"WITH {views.ALN_SQL} SELECT sid, count(DISTINCT qid) AS reads, CAST(sum(qend - qoff) AS BIGINT) AS residues, round(sum(qend - qoff) / max(ssize), 6) AS coverage FROM aln GROUP BY sid")
def a17_subject_coverage(spark, d):
    return hits.subject_coverage(views.alignments(spark, d))


_DEPTH = f"{views.ALN_SQL}, ev AS (SELECT sid, pos, sum(d) AS d FROM (SELECT sid, soff AS pos, 1 AS d FROM aln UNION ALL SELECT sid, send, -1 FROM aln) GROUP BY sid, pos), st AS (SELECT sid, pos AS f, lead(pos) OVER (PARTITION BY sid ORDER BY pos) AS t, sum(d) OVER (PARTITION BY sid ORDER BY pos ROWS UNBOUNDED PRECEDING) AS depth FROM ev)"


@query(f'WITH {_DEPTH} SELECT sid, f AS "from", t AS "to", CAST(depth AS BIGINT) AS depth FROM st WHERE depth > 0 AND t IS NOT NULL')
def a25_depth(spark, d):
    return intervals.depth(views.alignments(spark, d), ["sid"], "soff", "send")


@query(f"""WITH {_DEPTH}, dp AS (SELECT sid, f, t FROM st WHERE depth >= 5 AND t IS NOT NULL), e AS (SELECT *, CASE WHEN f = lag(t) OVER (PARTITION BY sid ORDER BY f) THEN 0 ELSE 1 END AS nw FROM dp), i AS (SELECT *, sum(nw) OVER (PARTITION BY sid ORDER BY f ROWS UNBOUNDED PRECEDING) AS k FROM e),
r AS (SELECT sid, min(f) AS f, max(t) AS t FROM i GROUP BY sid, k) SELECT sid, f AS "from", t AS "to" FROM (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY t - f DESC, f) AS n FROM r WHERE t - f >= 500) WHERE n = 1""")
def a24_longest_covered_run(spark, d):
    return intervals.longest_covered(views.alignments(spark, d).select("sid", F.col("soff").alias("from"), F.col("send").alias("to")), ["sid"], 5, 500)


#: The strict scan's windows, stated by place: ``near`` are the positions that are left, from p on.
_GROUPS = """lst AS (SELECT sid, type, list(sfrom ORDER BY sfrom, qid, len) AS s FROM sig GROUP BY sid, type),
num AS (SELECT *, row_number() OVER (PARTITION BY sid, type ORDER BY sfrom, qid, len) AS i, lag(sfrom) OVER (PARTITION BY sid, type ORDER BY sfrom, qid, len) AS back FROM sig),
isl AS (SELECT *, CAST(sum(CASE WHEN back IS NULL OR sfrom > back + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY sid, type ORDER BY i ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM num),
st(sid, type, i, mid) AS (SELECT sid, type, 1, CAST(NULL AS BIGINT) FROM lst
 UNION ALL SELECT sid, type, i + len(list_filter(near, lambda x: x <= mid + 20)), mid FROM (
  SELECT sid, type, i, near, list_filter(near, lambda x: x >= p + best AND x <= p + 10 + best - CASE WHEN best = 0 THEN 1 ELSE 0 END)[1 + sizes[best + 1] // 2] AS mid FROM (
   SELECT *, list_position(sizes, list_max(sizes)) - 1 AS best FROM (
    SELECT *, list_transform(range(0, more + 1), lambda t: len(list_filter(near, lambda x: x >= p + t AND x <= p + 10 + t - CASE WHEN t = 0 THEN 1 ELSE 0 END))) AS sizes FROM (
     SELECT *, CASE WHEN list_contains(near, p + 10) THEN 0 ELSE list_min(list_filter(range(0, len(near) + 1), lambda t: NOT list_contains(near, p + 11 + t))) END AS more FROM (
      SELECT st.sid, st.type, st.i, s[st.i] AS p, list_filter(s[st.i:st.i + 400], lambda x: x <= s[st.i] + 2000) AS near FROM st JOIN lst ON lst.sid = st.sid AND lst.type = st.type WHERE st.i <= len(s))))))),
steps AS (SELECT sid, type, lag(i) OVER w AS a, i - 1 AS b, mid FROM st WINDOW w AS (PARTITION BY sid, type ORDER BY i)),
hit AS (SELECT n.sid, n.type, n.island, n.i, n.qid, n.sfrom, n.len, s.a FROM steps s JOIN isl n ON n.sid = s.sid AND n.type = s.type AND n.i BETWEEN s.a AND s.b AND abs(n.sfrom - s.mid) <= 20),
strict AS (SELECT *, count(*) OVER (PARTITION BY sid, type, a) AS size FROM hit),
one AS (SELECT sid, type, 1 AS pass, island, a AS g, row_number() OVER (PARTITION BY sid, type, a ORDER BY i) - 1 AS member, i, qid, sfrom, len FROM strict WHERE size >= 4),
rest AS (SELECT *, row_number() OVER (PARTITION BY sid, type ORDER BY i) AS k FROM isl WHERE NOT EXISTS (SELECT 1 FROM one WHERE one.sid = isl.sid AND one.type = isl.type AND one.i = isl.i)),
rl AS (SELECT sid, type, list({'s': sfrom, 'n': len, 'i': i} ORDER BY k) AS r FROM rest GROUP BY sid, type),
rx(sid, type, a, j, last, got, done) AS (SELECT sid, type, CAST(1 AS BIGINT), CAST(2 AS BIGINT), CAST(1 AS BIGINT), CAST([] AS BIGINT[]), false FROM rl
 UNION ALL SELECT sid, type, CASE WHEN goes THEN a WHEN len(got) < 4 THEN a + 1 ELSE last + 1 END, CASE WHEN goes THEN j + 1 WHEN len(got) < 4 THEN a + 2 ELSE last + 2 END, CASE WHEN goes THEN CASE WHEN alike THEN j ELSE last END WHEN len(got) < 4 THEN a + 1 ELSE last + 1 END,
  CASE WHEN goes THEN CASE WHEN alike THEN list_append(got, j) ELSE got END ELSE [] END, false FROM (
   SELECT rx.*, coalesce(j <= len(r) AND r[j].s <= r[last].s + 50, false) AS goes, coalesce(abs(r[j].n - r[last].n) <= 0.1::DOUBLE * greatest(r[j].n, r[last].n) AND abs(r[j].n - r[last].n) <= 50, false) AS alike FROM rx JOIN rl ON rl.sid = rx.sid AND rl.type = rx.type WHERE rx.a <= len(r))),
full_ AS (SELECT sid, type, a, max_by(got, j) AS got FROM rx GROUP BY sid, type, a HAVING max(len(got)) >= 4),
two AS (SELECT sid, type, 2 AS pass, a AS g, unnest(list_append(got, a)) AS k, unnest(range(len(got) + 1)) AS member FROM full_),
every AS (SELECT sid, type, pass, island, g, member, qid, sfrom, len FROM one UNION ALL SELECT two.sid, two.type, pass, island, g, member, qid, sfrom, len FROM two JOIN rest USING (sid, type, k)),
groups AS (SELECT sid, type, CAST(pass AS INT) AS pass, min(island) OVER (PARTITION BY sid, type, pass, g) AS island, g, CAST(member AS INT) AS member, qid, sfrom, len FROM every),
found AS (SELECT sid, type, pass, island, CAST(dense_rank() OVER (PARTITION BY sid, type, pass, island ORDER BY g) - 1 AS INT) AS group_nth, member, qid, sfrom, len FROM groups),
ids AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY sid ORDER BY type DESC, pass, island, group_nth) - 1 AS BIGINT) AS group_id FROM found)"""
_GROUPED = f"WITH RECURSIVE {views.SIG_SQL}, {_GROUPS}"
_CALLS = "SELECT sid, type, group_id, list_sort(list(sfrom))[count(*) // 2 + 1] AS pos, list_sort(list(len))[count(*) // 2 + 1] AS len, count(DISTINCT qid) AS support FROM ids GROUP BY sid, type, group_id"


def _groups(spark, d):
    return signatures.group_signatures(views.signatures(spark, d))


@query(f"{_GROUPED} SELECT * FROM found WHERE pass = 1")
def w01_strict_groups(spark, d):
    return _groups(spark, d).where("pass = 1")


@query(f"{_GROUPED} SELECT * FROM found WHERE pass = 2")
def w02_relaxed_groups(spark, d):
    return _groups(spark, d).where("pass = 2")


@query(f"{_GROUPED} SELECT sid, group_id, type, member, qid FROM ids")
def k16_group_ids(spark, d):
    return signatures.with_group_ids(_groups(spark, d)).select("sid", "group_id", "type", "member", "qid")


@query(f"{_GROUPED} SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY sid, type, pass, island, group_nth, qid ORDER BY member) = 1")
def a20_dedup_members(spark, d):
    return signatures.first_of_each_read(_groups(spark, d))


@query(f"{_GROUPED}, {views.READS_SQL} SELECT sid, group_id, member, qid, CAST(length(seq) AS INT) AS size FROM ids JOIN reads ON rid = qid")
def j08_group_reads(spark, d):
    members = signatures.with_group_ids(_groups(spark, d))
    return signatures.with_reads(members, views.reads(spark, d)).select("sid", "group_id", "member", "qid", F.length("seq").alias("size"))


@query(f"{_GROUPED} SELECT a.sid || ':' || a.group_id AS \"group\", a.qid, b.qid AS sid FROM ids a JOIN ids b ON a.sid = b.sid AND a.group_id = b.group_id AND a.qid <> b.qid")
def j09_group_pairs(spark, d):
    members = signatures.with_group_ids(_groups(spark, d))
    return consensus.group_pairs(members.select(F.concat_ws(":", "sid", "group_id").alias("group"), F.col("qid").alias("rid")))


@query(f"{_GROUPED} SELECT sid, group_id, type, member, qid, sfrom, len FROM ids")
def s14_group_file(spark, d):
    """Groups as the texts of a group file, and parsed again."""
    return records.parse_groups(records.group_lines(signatures.with_group_ids(_groups(spark, d))))


_SIM = f"""{views.SIG_SQL}, g AS (SELECT qid, sid, type, sfrom // 1440 AS day, sfrom, len FROM sig), v AS (SELECT a.qid, a.sid, a.type, a.day, a.sfrom, a.len, count(*) - 1 AS votes FROM g a JOIN g b ON a.sid = b.sid AND a.type = b.type AND a.day = b.day AND abs(a.len - b.len) <= 0.2 * greatest(a.len, b.len) GROUP BY ALL)"""


@query(f"WITH {_SIM} SELECT qid, sid, type, day, sfrom, len, votes FROM (SELECT *, row_number() OVER (PARTITION BY sid, type, day ORDER BY votes DESC, qid, sfrom) AS n FROM v) WHERE n <= 50")
def a21_similarity_top50(spark, d):
    days = views.signatures(spark, d).withColumn("day", F.expr("sfrom div 1440"))
    return signatures.most_alike(days, ["sid", "type", "day"]).select("qid", "sid", "type", "day", "sfrom", "len", "votes")


@query(f"{_GROUPED} {_CALLS}")
def k21_simple_calls(spark, d):
    return signatures.simple_calls(signatures.with_group_ids(_groups(spark, d)))


@query(f"""WITH {_OPS}, r AS (SELECT pid, unnest(regexp_extract_all(translate(o, '=X', 'MM'), 'M+|I+|D+')) AS r, unnest(range(len(regexp_extract_all(translate(o, '=X', 'MM'), 'M+|I+|D+')))) AS i FROM ops),
c AS (SELECT pid, r, i, coalesce(sum(CASE WHEN r[1] <> 'D' THEN length(r) ELSE 0 END) OVER w, 0) AS q, coalesce(sum(CASE WHEN r[1] <> 'I' THEN length(r) ELSE 0 END) OVER w, 0) AS s FROM r WINDOW w AS (PARTITION BY pid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT pid, r[1] AS kind, CAST(q AS BIGINT) AS qfrom, CAST(CASE WHEN r[1] = 'D' THEN q + 1 ELSE q + length(r) END AS BIGINT) AS qto, CAST(s AS BIGINT) AS sfrom, CAST(CASE WHEN r[1] = 'I' THEN s + 1 ELSE s + length(r) END AS BIGINT) AS sto FROM c WHERE r[1] <> 'M' AND length(r) >= 40""")
def t01_gap_runs(spark, d):
    p = views.pairs(spark, d)
    return p.select("pid", F.explode(al.gap_runs("q_aln", "s_aln", F.lit(0), F.lit(0), 40)).alias("g")).select("pid", "g.*")


@query(f"WITH {views.PAIRS_SQL} SELECT pid, CAST(levenshtein(replace(q_aln, '-', ''), replace(s_aln, '-', '')) AS INT) AS dist FROM pairs")
def t08_edit_distance(spark, d):
    bare = lambda c: F.replace(F.col(c), F.lit("-"), F.lit(""))
    return views.pairs(spark, d).select("pid", align.edit_distance(bare("q_aln"), bare("s_aln")).alias("dist"))


@query()
def t08_prefix_distance(spark, d):
    """Edit distance to the best prefix of the subject's piece."""
    return _windows(spark, d).select("pid", traceback.prefix_distance("q", "s").alias("p")).select("pid", "p.*")


@query()
def t02_affine_global_score(spark, d):
    bare = lambda c: F.replace(F.col(c), F.lit("-"), F.lit(""))
    return views.pairs(spark, d).select("pid", align.affine_score(bare("q_aln"), bare("s_aln")).alias("score"))


_bare = lambda c: F.replace(F.col(c), F.lit("-"), F.lit(""))


def _windows(spark, d):
    return views.pairs(spark, d).select("pid", _bare("q_aln").alias("q"), _bare("s_aln").alias("s"))


@query()
def t02_affine_path(spark, d):
    """The alignment itself."""
    return _windows(spark, d).select("pid", traceback.align_path("q", "s").alias("p")).select("pid", "p.*")


@query()
def t02_banded_path(spark, d):
    return _windows(spark, d).select("pid", traceback.align_banded("q", "s").alias("p")).select("pid", "p.*")


@query()
def t04_chains(spark, d):
    """All chains of each pair, best first, long neighbours joined."""
    found = seeds.chains(*_blocks(spark, d), 15, 36, join=True)
    return found.select("qid", "qdir", "sid", "nth", "score", F.size("seeds").alias("seeds"), F.col("seeds")[0].qoff.alias("qoff"), F.col("seeds")[0].soff.alias("soff"))


@query()
def t07_extended_alignment(spark, d):
    """Alignments along all chains, extended beyond their ends."""
    reads = views.reads(spark, d)
    made = mapping.along_chains(seeds.chains(*_blocks(spark, d), 15, 36), kmers.strands(reads), reads, 15)
    return made.select("qid", "qdir", "sid", "nth", "qoff", "qend", "soff", "send", "dist", "score", "ident", "eff")


@query()
def t18_overlaps(spark, d):
    return mapping.overlaps(views.reads(spark, d))


def _noisy(spark, d, size: int, copies: int):
    """Each read's pieces of ``size`` bases, the last one shorter, in copies that lack other bases each: group (read),
    piece, rid (copy), seq, raw."""
    r = views.reads(spark, d).where(F.length("seq") > 0)
    pieces = r.withColumn("piece", F.explode(F.sequence(F.lit(0), F.floor((F.length("seq") - 1) / size).cast("int"))))
    cut = pieces.select(F.col("rid").alias("group"), "piece", F.substring(F.col("seq"), F.col("piece") * size + 1, F.lit(size)).alias("raw"))
    each = cut.withColumn("rid", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(copies).cast("long"))))
    lacks = lambda c, i: F.when((i * 7919 + F.col("rid") * 104_729 + F.col("group") + F.col("piece")) % 29 == 0, "").otherwise(c)
    return each.select("group", "piece", "rid", F.array_join(F.transform(F.split("raw", ""), lacks), "").alias("seq"), "raw")


@query()
def a14_chained_duals(spark, d):
    """Pieces of reads against the same pieces without a third in the middle: the two sides, aligned as one."""
    r = _noisy(spark, d, 300, 1).where(F.length("raw") >= 90).withColumn("id", F.col("group") * 1000 + F.col("piece"))
    n = F.length("raw")
    third = F.floor(n / 3).cast("int")
    back = (F.col("id") % 2 == 1).cast("int")
    lacks = F.concat(F.substring(F.col("raw"), F.lit(1), third), F.substring(F.col("raw"), 2 * third + 1, n))
    made = r.select(F.col("id").alias("rid"), "raw", back.alias("qdir"), F.when(back == 1, sq.reverse_complement(lacks)).otherwise(lacks).alias("seq"), F.length(lacks).cast("long").alias("n"))
    ident = F.when(F.col("rid") % 3 == 0, 104.5).otherwise(100.0)  # of some pairs more than any alignment has
    duals = made.select(F.col("rid").alias("qid"), F.col("rid").alias("sid"), "qdir", F.lit(0).cast("long").alias("qoff"), F.col("n").alias("qend"), F.lit(0).cast("long").alias("soff"), F.length("raw").cast("long").alias("send"), ident.alias("left_ident"), ident.alias("right_ident"))
    return mapping.chain_duals(duals, made.select("rid", "seq"), made.select("rid", F.col("raw").alias("seq"))).select("qid", "qdir", "qoff", "qend", "soff", "send", "dist", "ident", "eff")


@query()
def t17_remapped(spark, d):
    """All reads, in pieces that lack bases, aligned to what they were made of; every second one reversed and complemented."""
    rows = _noisy(spark, d, 400, 2).withColumn("qdir", (F.col("rid") % 2).cast("int"))
    rows = rows.withColumn("seq", F.when(F.col("qdir") == 1, sq.reverse_complement("seq")).otherwise(F.col("seq")))
    ends = (F.least(F.lit(20), F.length("seq")).alias("cns_from"), F.greatest(F.least(F.lit(20), F.length("seq")), F.length("seq") - 30).alias("cns_to"))
    rows = rows.select("group", "piece", "rid", "qdir", "seq", *ends, F.col("raw").alias("_raw"), (F.col("piece") * 400).cast("long").alias("sfrom"))
    return mapping.remap(rows.withColumnRenamed("piece", "nth").withColumnRenamed("_raw", "piece")).select("group", "nth", "rid", "qdir", "soff", "send", "cigar", "dist", "ident", "eff")


def _cut(d, reads, one: str, first, size):
    """Join the reads (or strands) of one side of pairs and cut the stretch out of each: adds the column ``one``."""
    keys = [f"{one}id", *(["qdir"] if one == "q" else [])]
    side = reads.select(F.col("rid").alias(keys[0]), *keys[1:], "seq")
    return d.join(side, keys).withColumn(one, F.substring(F.col("seq"), (first + 1).cast("int"), size.cast("int"))).drop("seq")


@query()
def t07_seed_guided_alignment(spark, d):
    """Alignments along the segments of seeds that rise in both reads, measured."""
    seeds = kmers.segments(kmers.rising(_seeds(spark, d)))
    reads = views.reads(spark, d)
    first, last = F.col("seeds")[0], F.element_at("seeds", -1)
    both = seeds
    for one, of in (("q", kmers.strands(reads)), ("s", reads)):
        both = _cut(both, of, one, first[f"{one}off"], last[f"{one}off"] - first[f"{one}off"] + 15)
    offsets = lambda c: F.transform("seeds", lambda x: (x[c] - first[c]).cast("int"))
    made = both.select("qid", "qdir", "sid", first.qoff.alias("qoff"), first.soff.alias("soff"), traceback.align_seeds("q", "s", offsets("qoff"), offsets("soff"), F.lit(15)).alias("p"))
    return traceback.measured(made.select("qid", "qdir", "sid", "qoff", "soff", "p.*"))


@query()
def t09_local_alignment(spark, d):
    return _windows(spark, d).select("pid", traceback.align_local("q", "s").alias("p")).select("pid", "p.*")


@query()
def t10_refined(spark, d):
    return views.pairs(spark, d).select("pid", traceback.refined("q_aln", "s_aln").alias("p")).select("pid", "p.*")


@query()
def t11_windowed_alignment(spark, d):
    """Windows of 200 bases from the start of each exact match."""
    w, reads = w10_exact_matches(spark, d), views.reads(spark, d)
    for one, of in (("q", kmers.strands(reads)), ("s", reads)):
        w = _cut(w, of, one, F.col(f"{one}off"), F.lit(200))
    return traceback.windowed(w).select("qid", "qdir", "sid", "qoff", "soff", "qb", "qe", "sb", "se", "dist", "score", "ident", "eff")


def _votes(spark, d):
    p = views.pairs(spark, d).withColumn("g", F.col("pid") % 16).withColumn("soff", F.lit(0))
    return consensus.votes(p, "g")


@query(f"""WITH {views.PAIRS_SQL}, c AS (SELECT pid % 16 AS g, pid, i, q_aln[i] AS a, s_aln[i] AS b FROM pairs, unnest(range(1, 121)) AS t(i) WHERE i <= length(q_aln)),
t AS (SELECT *, sum(CASE WHEN b <> '-' THEN 1 ELSE 0 END) OVER (PARTITION BY pid ORDER BY i ROWS UNBOUNDED PRECEDING) - 1 AS t_pos FROM c),
n AS (SELECT *, CASE WHEN b <> '-' THEN 0 ELSE row_number() OVER (PARTITION BY pid, t_pos ORDER BY i) - CASE WHEN t_pos >= 0 THEN 1 ELSE 0 END END AS delta FROM t),
p AS (SELECT g, t_pos, delta, a, lag(t_pos, 1, -1) OVER w AS pt, lag(delta, 1, 0) OVER w AS pd, lag(a, 1, '.') OVER w AS pb FROM n WINDOW w AS (PARTITION BY pid ORDER BY i))
SELECT g AS "group", CAST(t_pos AS BIGINT) AS t_pos, CAST(delta AS INT) AS delta, a AS base, CAST(pt AS BIGINT) AS p_t_pos, CAST(pd AS INT) AS p_delta, pb AS p_base, CAST(count(*) AS DOUBLE) AS weight FROM p GROUP BY ALL""")
def a22_pileup(spark, d):
    return consensus.pileup(_votes(spark, d))


@query()
def a23_consensus(spark, d):
    return consensus.consensus(consensus.covered(_votes(spark, d)))


@query(f"""WITH {views.SIG_SQL}, p AS (SELECT concat_ws(':', sid, type, sfrom // 1440) AS cell, qid AS pid, CAST(sfrom AS DOUBLE) AS x, CAST(len AS DOUBLE) AS y FROM sig), size AS (SELECT cell, count(*) AS n FROM p GROUP BY cell),
d AS (SELECT a.cell, a.pid, b.pid AS o, sqrt(((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) / 2) AS d FROM p a JOIN p b ON a.cell = b.cell AND a.pid <> b.pid JOIN size ON size.cell = a.cell AND n > 5),
kd AS (SELECT cell, pid, max(d) AS kd FROM (SELECT *, row_number() OVER (PARTITION BY cell, pid ORDER BY d) AS r FROM d) WHERE r <= 5 GROUP BY cell, pid),
near AS (SELECT d.* FROM d JOIN kd USING (cell, pid) WHERE d <= kd),
den AS (SELECT near.cell, near.pid, 1 / greatest(avg(greatest(kd.kd, d)), 1e-12) AS density FROM near JOIN kd ON kd.cell = near.cell AND kd.pid = near.o GROUP BY near.cell, near.pid),
lof AS (SELECT near.cell, near.pid, avg(o.density) / any_value(m.density) AS lof FROM near JOIN den o ON o.cell = near.cell AND o.pid = near.o JOIN den m ON m.cell = near.cell AND m.pid = near.pid GROUP BY near.cell, near.pid)
SELECT p.cell, p.pid, round(coalesce(lof, 1.0), 6) AS lof, coalesce(round(lof, 9) > 1.0, false) AS outlier FROM p LEFT JOIN lof USING (cell, pid)""")
def a26_lof(spark, d):
    points = views.signatures(spark, d).select(F.concat_ws(":", "sid", "type", F.expr("sfrom div 1440")).alias("cell"), F.col("qid").alias("pid"), F.col("sfrom").cast("double").alias("x"), F.col("len").cast("double").alias("y"))
    return align.outlier_factors(points, "cell")


@query(f"""WITH {views.SIG_SQL}, b AS (SELECT sid, type, min(sfrom) AS lo, max(sfrom) AS hi, min(len) AS l, max(len) AS h FROM sig GROUP BY ALL)
SELECT qid, sid, type, CASE WHEN hi > lo THEN round((CAST(sfrom AS DOUBLE) - lo) / (hi - lo), 9) ELSE 0.0 END AS sfrom, CASE WHEN h > l THEN round((CAST(len AS DOUBLE) - l) / (h - l), 9) ELSE 0.0 END AS len FROM sig JOIN b USING (sid, type)""")
def a27_min_max(spark, d):
    scaled = stats.min_max(views.signatures(spark, d), ["sid", "type"], ["sfrom", "len"])
    return scaled.select("qid", "sid", "type", F.round("sfrom", 9).alias("sfrom"), F.round("len", 9).alias("len"))


_TAG = "CASE WHEN qoff <= 100 AND qsize - qend <= 100 THEN 'perfect' WHEN n > 3 THEN 'repeat' WHEN ident < 70 THEN 'unperfect' ELSE 'other' END"


@query(f"WITH {views.ALN_SQL}, t AS (SELECT {_TAG} AS tag, qend - qoff AS size FROM (SELECT *, count(*) OVER (PARTITION BY qid, sid) AS n FROM aln)) SELECT CASE WHEN grouping(tag) = 1 THEN 'total' ELSE tag END AS tag, count(*) AS n, CAST(sum(size) AS BIGINT) AS residues, round(100.0 * sum(size) / (SELECT sum(size) FROM t), 6) AS percent FROM t GROUP BY ROLLUP (tag)")
def a29_tag_report(spark, d):
    a = views.alignments(spark, d)
    n = a.groupBy("qid", "sid").agg(F.count("*").alias("n"))
    tagged = a.join(n, ["qid", "sid"]).select(F.expr(_TAG).alias("tag"), (F.col("qend") - F.col("qoff")).alias("size"))
    return stats.tag_report(tagged)


@query(f"""WITH RECURSIVE {_LEN}, o AS (SELECT rid, len, row_number() OVER (ORDER BY rid) AS i FROM lens), f(i, rid, len, s, n, vol) AS (SELECT i, rid, len, len, 1, 0 FROM o WHERE i = 1
 UNION ALL SELECT o.i, o.rid, o.len, CASE WHEN s >= 200000 OR n >= 150 THEN o.len ELSE s + o.len END, CASE WHEN s >= 200000 OR n >= 150 THEN 1 ELSE n + 1 END, vol + CASE WHEN s >= 200000 OR n >= 150 THEN 1 ELSE 0 END FROM f JOIN o ON o.i = f.i + 1)
SELECT CAST(vol AS BIGINT) AS vol, count(*) AS reads, CAST(sum(len) AS BIGINT) AS residues, min(rid) AS first FROM f GROUP BY vol""")
def k02_volumes(spark, d):
    """Volumes that the read closes with which they reach 200,000 bases or 150 reads."""
    v = volumes.by_size(views.lengths(spark, d), "rid", "len", 200_000, 150)
    return v.groupBy("vol").agg(F.count("*").alias("reads"), F.sum("len").alias("residues"), F.min("rid").alias("first"))


@query(f"WITH {views.ALN_SQL}, m AS (SELECT sid, qid, soff FROM aln WHERE ident >= 95 UNION ALL SELECT sid, qid, send FROM aln WHERE ident < 62) SELECT sid, count(*) AS n, count(DISTINCT qid) AS reads FROM m GROUP BY sid")
def u01_union(spark, d):
    a = views.alignments(spark, d)
    both = a.where("ident >= 95").select("sid", "qid", "soff").unionByName(a.where("ident < 62").select("sid", "qid", F.col("send").alias("soff")))
    return both.groupBy("sid").agg(F.count("*").alias("n"), F.countDistinct("qid").alias("reads"))


_SELECTED = f"""{_ALN_MASKED}, big AS (SELECT *, ident - aid % 4 AS eff FROM am WHERE qsize >= 3000), {_fold_ctes("free", "big", "qid, sid, qdir", "aid", _INSIDE.format(_J, _I), _INSIDE.format(_I, _J))},
lft AS (SELECT big.* FROM big JOIN free USING (aid)), whole AS (SELECT *, count(*) OVER (PARTITION BY qid) AS alone FROM lft WHERE qoff <= 300 AND qsize - qend <= 300),
ranked AS (SELECT *, row_number() OVER w AS n, lead(by_) OVER w AS nx FROM (SELECT *, CASE WHEN alone = 1 AND ident >= 70 THEN ident ELSE eff END AS by_ FROM whole) WHERE by_ >= 70 WINDOW w AS (PARTITION BY qid ORDER BY by_ DESC, aid)),
undone AS (SELECT * FROM lft WHERE qid NOT IN (SELECT qid FROM whole)), {_fold_ctes("single", "undone", "qid", "aid", _SAME, None)},
good AS (SELECT * FROM undone JOIN single USING (aid) WHERE (ident >= 70 OR eff >= 70) AND NOT masked),
duo AS (SELECT l.qid, l.sid, l.qdir, l.qsize, l.aid AS left_id, r.aid AS right_id, l.ident AS li, r.ident AS ri, l.qdir = r.qdir AND CASE WHEN l.qdir = 0 THEN l.soff <= r.soff ELSE r.soff <= l.soff END AS ordered, count(*) OVER (PARTITION BY l.qid) AS n,
  least(l.qoff, r.qoff) AS qoff, greatest(l.qend, r.qend) AS qend, least(l.soff, r.soff) AS soff, greatest(l.send, r.send) AS send
 FROM good l JOIN good r ON l.qid = r.qid AND l.sid = r.sid AND l.qoff <= 300 AND l.qsize - l.qend > 300 AND r.qoff > 300 AND r.qsize - r.qend <= 300 WHERE CASE WHEN l.soff < r.soff THEN r.soff - l.send ELSE l.soff - r.send END <= 30000),
svr AS (SELECT qid, sid, qdir, qsize, qoff, qend, soff, send, 'complete' AS kind, aid AS left_id, aid AS right_id FROM ranked WHERE n = 1 AND (nx IS NULL OR by_ - nx > 10) AND NOT masked
 UNION ALL SELECT qid, sid, qdir, qsize, qoff, qend, soff, send, 'dual', left_id, right_id FROM duo WHERE n = 1 AND ordered AND (li + ri) / 2.0 - (left_id + right_id) % 11 > least(li, ri) - 4)"""


def _sv_reads(spark, d):
    """SV reads of the view, which has no bases to align a pair of duals by: a figure made of both identities stands in."""
    a = _with_mask(spark, d).withColumn("eff", F.col("ident") - F.col("aid") % 4).drop("ssize", "score")

    def chain(duals):
        idents = lambda side: views.alignments(spark, d).select("qid", F.col("aid").alias(f"{side}_id"), F.col("ident").alias(f"_{side}"))
        both = duals.join(idents("left"), ["qid", "left_id"]).join(idents("right"), ["qid", "right_id"])
        return both.where((F.col("_left") + F.col("_right")) / 2 - (F.col("left_id") + F.col("right_id")) % 11 > F.least("_left", "_right") - 4)

    return selection.sv_reads(a, chain, effective="eff", masked="masked")


@query(f"WITH RECURSIVE {_SELECTED} SELECT * FROM svr")
def a14_sv_reads(spark, d):
    """The alignment that makes each read an SV read: size, containment, complete ones, repeats, duals, in this order."""
    return _sv_reads(spark, d)


_VARIANTS = f"""{_SELECTED}, kept AS (SELECT left_id AS aid, qid, sid, qdir, soff, send FROM svr), {views.variants_sql("kept")},
found AS (SELECT qid, sid, qdir, 0 AS type, strpos(q_aln, '-') - 1 AS qfrom, strpos(q_aln, '-') AS qto, soff + strpos(q_aln, '-') - 1 AS sfrom, length(q_aln) - length(replace(q_aln, '-', '')) AS len FROM vq WHERE contains(q_aln, '-')
 UNION ALL SELECT qid, sid, qdir, 6, strpos(s_aln, '-') - 1, strpos(s_aln, '-') - 1 + length(s_aln) - length(replace(s_aln, '-', '')), soff + strpos(s_aln, '-') - 1, length(s_aln) - length(replace(s_aln, '-', '')) FROM vq WHERE contains(s_aln, '-'))"""


def _sv_signatures(spark, d):
    return selection.signatures_of(views.variants(_sv_reads(spark, d).withColumnRenamed("left_id", "aid")))


@query(f"WITH RECURSIVE {_VARIANTS} SELECT qid, sid, qdir, CAST(type AS INT) AS type, CAST(qfrom AS BIGINT) AS qfrom, CAST(qto AS BIGINT) AS qto, CAST(sfrom AS BIGINT) AS sfrom, CAST(CASE WHEN type = 0 THEN sfrom + len ELSE sfrom + 1 END AS BIGINT) AS sto, CAST(len AS BIGINT) AS len FROM found")
def t01_sv_signatures(spark, d):
    """Signatures of the SV reads' aligned strings."""
    return _sv_signatures(spark, d)


@query(f"WITH RECURSIVE {_VARIANTS}, sig AS (SELECT CAST(qid AS BIGINT) AS qid, CAST(sid AS BIGINT) AS sid, CAST(type AS INT) AS type, CAST(sfrom AS BIGINT) AS sfrom, CAST(len AS BIGINT) AS len FROM found), {_GROUPS.replace('found AS', 'numbered AS').replace('FROM found)', 'FROM numbered)')} {_CALLS}")
def pipeline_sv(spark, d):
    """From alignments to calls: SV reads, the signatures of their aligned strings, their groups and the calls of these."""
    sigs = mapping.cut_lineage(_sv_signatures(spark, d))
    return signatures.simple_calls(signatures.with_group_ids(signatures.group_signatures(sigs)))


def _lots(name: str, place: str) -> str:
    """CTEs: lots of a strand's alignments that start within 200 places of their first one, and how much of the read each covers."""
    return f"""{name}_l AS (SELECT qid, sid, qdir, any_value(qsize) AS qsize, list({{'p': {place}, 'b': b, 'e': e}} ORDER BY {place}) AS r FROM undone GROUP BY qid, sid, qdir HAVING count(*) > 1),
{name}_w(qid, sid, qdir, qsize, r, i, n) AS (SELECT qid, sid, qdir, qsize, r, 1, len(list_filter(r, lambda x: x.p <= r[1].p + 200)) FROM {name}_l
 UNION ALL SELECT qid, sid, qdir, qsize, r, i + n, len(list_filter(r, lambda x: x.p >= r[i + n].p AND x.p <= r[i + n].p + 200)) FROM {name}_w WHERE i + n <= len(r)),
{name} AS (SELECT qid FROM (SELECT qid, qsize, r[i:i + n - 1] AS v FROM {name}_w WHERE n > 1) WHERE qsize - len(list_distinct(flatten(list_transform(v, lambda x: range(x.b, x.e))))) <= 200)"""


_TAGGED = f"""RECURSIVE {views.ALN_SQL}, {views.SELF_SQL}, t AS (SELECT *, CASE WHEN qdir = 1 THEN qsize - qend ELSE qoff END AS b, CASE WHEN qdir = 1 THEN qsize - qoff ELSE qend END AS e FROM slf WHERE ident + 8 >= 80),
whole AS (SELECT qid, ident, row_number() OVER (PARTITION BY qid ORDER BY ident DESC) AS n, lead(ident) OVER (PARTITION BY qid ORDER BY ident DESC) AS nx FROM t WHERE b <= 200 AND qsize - e <= 200 OR soff <= 200 AND ssize - send <= 200),
decided AS (SELECT qid, CASE WHEN nx IS NULL OR ident - nx > 8 THEN 'perfect' ELSE 'repeat' END AS tag FROM whole WHERE n = 1), undone AS (SELECT * FROM t WHERE qid NOT IN (SELECT qid FROM decided)),
circle AS (SELECT DISTINCT x.qid FROM undone x JOIN undone y ON x.qid = y.qid AND x.sid = y.sid AND x.qdir = y.qdir WHERE x.soff <= 200 AND x.qsize - x.e <= 200 AND y.ssize - y.send <= 200 AND y.b <= 200),
turned AS (SELECT DISTINCT f.qid FROM undone f JOIN undone r ON f.qid = r.qid AND f.sid = r.sid WHERE f.qdir = 0 AND r.qdir = 1 AND (f.soff <= r.soff + 200 AND f.send + 200 >= r.send OR f.soff + 200 >= r.soff AND f.send <= r.send + 200)
 AND f.qsize - len(list_distinct(list_concat(range(f.b, f.e), range(r.qsize - r.e, r.qsize - r.b)))) <= 200), {_lots("heads", "soff")}, {_lots("tails", "-send")},
tags AS (SELECT qid, any_value(qsize) AS qsize, CASE WHEN qid IN (SELECT qid FROM decided) THEN (SELECT tag FROM decided d WHERE d.qid = t.qid) WHEN qid IN (SELECT qid FROM circle) THEN 'circular' WHEN qid IN (SELECT qid FROM turned) THEN 'rcdup'
 WHEN qid IN (SELECT qid FROM heads UNION ALL SELECT qid FROM tails) THEN 'tandem-repeat' ELSE 'unperfect' END AS tag FROM t GROUP BY qid)"""


@query(f"WITH {_TAGGED} SELECT * FROM tags")
def a28_sequence_tags(spark, d):
    return tags.tag_reads(views.partial(spark, d), 80)


@query(f"WITH {_TAGGED} SELECT CASE WHEN grouping(tag) = 1 THEN 'total' ELSE tag END AS tag, count(*) AS n, CAST(sum(qsize) AS BIGINT) AS residues, round(100.0 * sum(qsize) / (SELECT sum(qsize) FROM tags), 6) AS percent FROM tags GROUP BY ROLLUP (tag)")
def a29_sequence_tag_report(spark, d):
    """The report of the tags that the reads' alignments give."""
    return stats.tag_report(tags.tag_reads(views.partial(spark, d), 80).select("tag", F.col("qsize").alias("size")))
