"""Interval, grouping and kernel operators against plain brute force."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from readloom.config import MapOptions, data_size, from_lines
from readloom.operators import align, hits, intervals, kmers, signatures, volumes


def test_mask_and_depth(spark):
    rng = random.Random(3)
    rows = [(i, i % 3, a := rng.randrange(20000), a + rng.randrange(1, 6000)) for i in range(60)]
    mask = [(i % 3, a := rng.randrange(20000), a + rng.randrange(1, 900)) for i in range(80)]
    r = spark.createDataFrame(rows, ["id", "sid", "from", "to"])
    m = spark.createDataFrame(mask, ["sid", "from", "to"])
    got = {x.id: x.masked for x in intervals.masked_bases(r, m, ["sid"], "id").collect()}
    for i, s, a, b in rows:
        assert got[i] == sum(any(k == s and f <= p < t for k, f, t in mask) for p in range(a, b)) if b - a < 400 else True
    deep = intervals.depth(r, ["sid"]).collect()
    for x in deep[:40]:
        assert x.depth == sum(s == x.sid and a <= x["from"] < b for _, s, a, b in rows)
    assert intervals.merge(r.where("id < 0"), ["sid"]).count() == 0


def test_containment_fold(spark):
    rows = [(1, 0, 1000, 0, 1000), (2, 100, 900, 100, 900), (3, 50, 2000, 50, 2000), (4, 5000, 6000, 0, 9)]
    d = spark.createDataFrame([(7, *r) for r in rows], ["qid", "aid", "qoff", "qend", "soff", "send"])
    assert sorted(r.aid for r in intervals.drop_contained(d, ["qid"], ["aid"]).collect()) == [3, 4]


def test_running_over_bins(spark):
    """Bins and gaps of the axis don't show in the result; keys may be null."""
    rng = random.Random(4)
    rows = [(rng.choice(("a", None)), rng.randrange(900) * 37, rng.randrange(1, 9), i) for i in range(400)]
    d = spark.createDataFrame(rows, "k string, at long, v long, i long")
    got = intervals.running(d, ["k"], ["at", "i"], {"s": ("v", "sum", False), "m": ("v", "max", True)}, 100).collect()
    assert len(got) == len(rows)
    for r in got:
        before = [v for k, at, v, i in rows if k == r.k and (at, i) < (r.at, r.i)]
        assert r.s == sum(before) and r.m == max([*before, r.v])
    once = d.select("k", "at").distinct()
    for r in intervals.following(once, ["k"], "at", "to", 100).collect():
        assert r.to == min((at for k, at, _, _ in rows if k == r.k and at > r.at), default=None)


def test_repeats_agree_in_sum_and_in_order(spark):
    def left(rows):
        d = spark.createDataFrame([(7, i, *r) for i, r in enumerate(rows)], "qid long, aid long, qoff long, qend long")
        return sorted(r.aid for r in intervals.drop_repeats(d, "qid", ["aid"]).collect())

    assert left([(0, 2000), (200, 1800)]) == [0, 1]  # 400 in sum
    assert left([(0, 2000), (150, 1850)]) == []
    assert left([(0, 2000), (200, 2000), (400, 2000)]) == [2]  # the second, dropped with the first, doesn't meet the third
    assert left([(0, 2000), (100, 2000), (5000, 6000), (200, 2000)]) == [2]


def test_volumes_close_and_reset(spark):
    def volumes_of(sizes, cap, most=1 << 40):
        d = spark.createDataFrame([(3 * i + 1, n) for i, n in enumerate(sizes)], "id long, len long")
        return [r.vol for r in volumes.by_size(d, "id", "len", cap, most).orderBy("id").collect()]

    assert volumes_of([150] * 4, 200) == [0, 0, 1, 1]
    assert volumes_of([1] * 5, 200, 2) == [0, 0, 1, 1, 2]
    rng = random.Random(2)
    sizes = [rng.choice((0, 1, 5, 40, 900)) for _ in range(300)]
    want, vol, s, n = [], 0, 0, 0
    for x in sizes:
        want.append(vol)
        s, n = s + x, n + 1
        if s >= 100 or n >= 30:
            vol, s, n = vol + 1, 0, 0
    assert volumes_of(sizes, 100, 30) == want and volumes_of([], 5) == []


def test_window_of_a_candidate(spark):
    rows = [(1, 3000, 100, 20000, 70000), (2, 3000, 2900, 100, 9000), (3, 3000, 50, 50, 5000), (4, 3000, 50, 50, 5001), (5, 50000, 10, 40000, 90000)]
    d = spark.createDataFrame(rows, "id int, qsize long, qoff long, soff long, ssize long")
    got = {r.id: (r.sfrom, r.sto) for r in kmers.window(d).collect()}
    assert got == {1: (16100, 23900), 2: (0, 4000), 3: (0, 5000), 4: (0, 3950), 5: (9990, 90000)}


def test_duals_of_both_strands(spark):
    columns = "aid long, qid long, sid long, qdir int, qoff long, qend long, qsize long, soff long, send long, ident double, masked boolean"
    left, right = (0, 2000, 5000), (3000, 5000, 5000)

    def rows(*pairs):
        return spark.createDataFrame([(10 * q + side, q, 1, d, *(left, right)[side], s, s + 2000, i, m) for q, d, *sides in pairs for side, (s, i, m) in enumerate(sides)], columns)

    d = rows((1, 0, (100, 80.0, False), (9000, 80.0, False)), (2, 0, (9000, 80.0, False), (100, 80.0, False)), (3, 1, (9000, 80.0, False), (100, 80.0, False)), (4, 1, (100, 80.0, False), (9000, 80.0, False)), (5, 0, (100, 80.0, True), (9000, 80.0, False)), (6, 0, (100, 60.0, False), (9000, 80.0, False)), (7, 0, (100, 80.0, False), (40000, 80.0, False)))
    pairs = hits.dual_pairs(d, masked="masked")
    assert sorted(r.qid for r in pairs.collect()) == [1, 2, 3, 4]
    assert sorted((r.qid, r.soff, r.send) for r in hits.unique_duals(pairs).collect()) == [(1, 100, 11000), (3, 100, 11000)]
    assert hits.dual_pairs(d.withColumn("eff", F.lit(75.0)), effective="eff").where("qid = 6").count() == 1
    # two strands: a pair, but not one to be chained
    two = rows((8, 0, (100, 80.0, False), (9000, 80.0, False))).withColumn("qdir", F.col("aid").cast("int") % 2)
    assert hits.dual_pairs(two).count() == 1 and hits.unique_duals(hits.dual_pairs(two)).count() == 0


def test_alike_members(spark):
    d = spark.createDataFrame([(0, i, i, 100 if i < 50 else 500) for i in range(51)], ["g", "qid", "sfrom", "len"])
    assert signatures.most_alike(d, ["g"]).count() == 50
    assert signatures.most_alike(d.where("qid < 50"), ["g"]).count() == 50


def test_global_score_against_plain_programme():
    def slow(q, s):
        low, cost = -(10**9), lambda k: min(5 + 4 * k, 56 + k)
        f = [[low] * (len(s) + 1) for _ in range(len(q) + 1)]
        f[0][0] = 0
        for i in range(len(q) + 1):
            for j in range(len(s) + 1):
                if i and j:
                    f[i][j] = max(f[i][j], f[i - 1][j - 1] + (2 if q[i - 1] == s[j - 1] else -5))
                for k in range(1, i + 1):
                    f[i][j] = max(f[i][j], f[i - k][j] - cost(k))
                for k in range(1, j + 1):
                    f[i][j] = max(f[i][j], f[i][j - k] - cost(k))
        return f[-1][-1]

    rng = random.Random(7)
    for _ in range(40):
        q, s = ("".join(rng.choices("ACGT", k=rng.randrange(0, 14))) for _ in range(2))
        assert align.global_score(q, s) == slow(q, s), (q, s)
    long = "ACGT" * 30
    assert align.global_score(long, long[:20] + long[90:]) == 2 * 50 - 56 - 70


def test_outliers(spark):
    d = spark.createDataFrame([("a", i, float(i % 5), float(i // 5)) for i in range(25)] + [("a", 99, 50.0, 50.0), ("b", 1, 0.0, 0.0)], ["cell", "pid", "x", "y"])
    got = {(r.cell, r.pid): r for r in align.outlier_factors(d, "cell").collect()}
    assert got["a", 99].outlier and got["a", 99].lof > 5 and not got["b", 1].outlier


def test_outliers_of_shared_places(spark):
    rng = np.random.default_rng(3)
    at = np.concatenate([rng.integers(0, 30, (700, 2)) / 3.0, rng.normal(40, 9, (150, 2)), np.repeat(rng.integers(0, 5, (6, 2)) * 9.0 + 70, 60, axis=0)])
    rows = [("a", i, float(x), float(y)) for i, (x, y) in enumerate(at)] + [("b", i, 1.0, 1.0) for i in range(5)]
    got = {(r.cell, r.pid): r for r in align.outlier_factors(spark.createDataFrame(rows, ["cell", "pid", "x", "y"]), "cell").collect()}
    d = np.sqrt(((at[:, None] - at[None]) ** 2).sum(axis=2) / 2)
    np.fill_diagonal(d, np.inf)
    far = np.sort(d, axis=1)[:, 4]
    near = [np.flatnonzero(r <= m) for r, m in zip(d, far, strict=True)]
    density = np.array([1 / max(np.maximum(far[m], r[m]).mean(), 1e-12) for m, r in zip(near, d, strict=True)])
    lof = np.array([density[m].mean() / own for m, own in zip(near, density, strict=True)])
    assert len(got) == len(rows) and all(abs(got["a", i].lof - x) <= 1e-6 * max(1, x) and got["a", i].outlier == (round(x, 9) > 1) for i, x in enumerate(lof.tolist()))
    assert all(got["b", i].lof == 1 and not got["b", i].outlier for i in range(5))
    # most points of one place: only places are compared
    many = spark.range(400_000).selectExpr("'c' AS cell", "id AS pid", "double(id % 20) AS x", "double(id div 20 % 10) AS y")
    assert align.outlier_factors(many, "cell").groupBy("lof", "outlier").count().collect() == [(1.0, False, 400_000)]


def test_options():
    assert data_size("8g") == 8 << 30 and from_lines(MapOptions, ["KMER_SIZE = 19 # k", ""]).kmer_size == 19
    for bad in (["kmer_size=9"], ["nothing=1"]):
        try:
            from_lines(MapOptions, bad)
        except ValueError:
            continue
        raise AssertionError(bad)


def test_places_of_words(spark, monkeypatch):
    rng = random.Random(11)
    reads = [(i, "".join(rng.choices("ACGT", k=rng.randrange(0, 90))) + "ACGTTACG" * (i % 3)) for i in range(120)]
    d = spark.createDataFrame([*reads, (500, None), (501, "ÄACGTACGTAC")], "rid long, seq string").repartition(7)
    want: dict = {}
    for i, s in reads:
        for at in range(0, len(s) - 5, 2):
            want.setdefault(s[at : at + 6], []).append((i, at))
    monkeypatch.setattr(kmers, "_CHUNK", 64)
    got = {r.kmer: [tuple(p) for p in r.places] for r in kmers.places(d.where("rid < 501"), 6, 2, 8).collect()}
    assert got == {k: sorted(v) for k, v in want.items() if len(v) <= 8} and len(got) < len(want)
    # each word where it stands, of any letters
    cut = kmers.occurrences(d, 6, 2)
    assert sorted((r.rid, r.off, r.kmer) for r in cut.where("rid < 500").collect()) == sorted((i, at, k) for k, v in want.items() for i, at in v)
    assert [(r.off, r.kmer) for r in cut.where("rid = 501").orderBy("off").collect()] == [(0, "ÄACGTA"), (2, "CGTACG"), (4, "TACGTA")]


def test_equal_intervals_stay_in_their_island(spark):
    rows = spark.range(0, 40_000, 1, 16).selectExpr("id % 2 as sid", "(id * 97) % 200 * 300 as `from`", "(id * 97) % 200 * 300 + 100 as `to`", "rand(5) as r")
    for size in (intervals.BIN, None):
        got = intervals.merge(rows.repartition(16, "r"), ["sid"], bin_size=size)
        assert got.where("to - `from` != 100").count() == 0 and got.count() == 200
        assert got.agg({"n": "sum"}).first()[0] == 40_000


def test_alignments_are_shuffled_once(spark):
    from readloom.plans import catalogue

    for name in ("a08_merge_windows", "o06_window_hsps"):  # by read; the scans follow in place
        plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1


def test_edit_distances_by_bits(spark):
    rng = random.Random(2)
    sizes = [0, 1, 63, 64, 65, 120, 128, 129, 300, 512]
    rows = [("".join(rng.choices(abc, k=m)), "".join(rng.choices(abc, k=n))) for abc in ("ACGT", "Aé\U0001f600") for m in sizes for n in sizes]
    rows += [("ACGT" * 200, "AGT" * 250), ("", "A" * 600), (None, "A"), ("A", None)]
    d = spark.createDataFrame(rows, "q string, s string")
    got = d.select("q", "s", F.levenshtein("q", "s").alias("want"), align.edit_distance(F.col("q"), F.col("s")).alias("dist")).collect()
    assert len(got) == len(rows) and all(r.dist == r.want for r in got)
    short = [r for r in got if None not in (r.q, r.s) and len(r.q) <= 512 and len(r.s) <= 512]
    assert align.edit_distances([r.q for r in short], [r.s for r in short]) == [r.want for r in short]


def test_seeds_of_many_pairs_are_linked_at_once():
    rng = np.random.default_rng(1)
    q, s, pairs = np.empty(0, np.int64), np.empty(0, np.int64), []
    for i in range(900):
        m = int(rng.choice([3, 4, 7, 20, 90, 300], p=[0.5, 0.2, 0.2, 0.07, 0.02, 0.01]))
        x = rng.integers(0, (300, 9000)[i % 2], m)
        pairs.append((len(q), len(q) + m))
        q, s = np.concatenate([q, x]), np.concatenate([s, np.sort(x + rng.integers(-60, 60, m) if i % 3 else rng.integers(0, 9000, m))])
    score, before = align.all_linked(q, s, pairs, 15, 5000, 1500)
    for a, b in pairs:
        want = align.linked(q[a:b], s[a:b], 15, 5000, 1500)
        assert (score[a:b] == want[0]).all() and (before[a:b] == want[1]).all()


def test_long_chains_are_linked_as_by_all_their_seeds():
    rng = np.random.default_rng(9)
    for n, wide in ((400, 90), (700, 3000), (600, 9000)):
        s = np.sort(rng.integers(0, wide, n) * 3)
        q = np.where(rng.random(n) < 0.6, s + rng.integers(0, 3, n) * 40, rng.integers(0, 3 * wide, n))
        score, before = align.linked(q, s, 15, 2000, 700)
        for i in range(n):
            top, of = 15.0, -1
            for j in range(i):
                dq, ds = int(q[i] - q[j]), int(s[i] - s[j])
                dd = abs(dq - ds)
                if 0 < dq <= 2000 and 0 < ds <= 2000 and dd <= 700:
                    made = min(dq, ds, 15) - math.floor(0.01 * dd * 15) - (math.floor(math.log2(dd)) // 2 if dd else 0) + score[j]
                    if made > 15 and made >= top:
                        top, of = made, j
            assert (score[i], before[i]) == (top, of)
