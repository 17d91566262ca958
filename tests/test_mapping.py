"""Overlaps, remapping and correction of reads drawn from a known sequence."""

import random
from collections import Counter

from pyspark.sql import functions as F

from readloom.config import ConsensusOptions
from readloom.operators import align, consensus, kmers, mapping, traceback


def noisy(rng, s, share):
    out = []
    for c in s:
        r = rng.random()
        out.append("" if r < share / 3 else c + rng.choice("ACGT") if r < 2 * share / 3 else rng.choice("ACGT") if r < share else c)
    return "".join(out)


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def errors(a, b):
    x, y = traceback.path(a, b, traceback.EDIT)
    return sum(c != d for c, d in zip(x, y, strict=True))


def test_overlaps(spark):
    rng = random.Random(5)
    g = "".join(rng.choices("ACGT", k=1500))
    reads = [(1, g[:900]), (2, rc(g[500:1400])), (3, g[600:800]), (4, "".join(rng.choices("ACGT", k=700))), (5, None), (6, "")]
    got = {(r.qid, r.sid): r for r in mapping.overlaps(spark.createDataFrame(reads, "rid long, seq string")).collect()}
    assert set(got) == {(1, 2), (2, 1), (1, 3), (3, 1), (2, 3), (3, 2)}
    r = got[2, 1]
    assert (r.qdir, r.kind, r.qoff, r.qend, r.soff, r.send) == (1, "dovetail", 0, 400, 500, 900)
    assert got[3, 1].kind == "contained" and got[1, 3].kind == "contains" and got[3, 2].qdir == 1


def test_broken_overlap_is_joined(spark):
    rng = random.Random(6)
    a, b, x = ("".join(rng.choices("ACGT", k=n)) for n in (600, 600, 1700))
    got = mapping.overlaps(spark.createDataFrame([(1, a + b), (2, a + x + b)], "rid long, seq string")).collect()
    assert {(r.qid, r.sid, r.qoff, r.qend, r.soff, r.send) for r in got} == {(1, 2, 0, 1200, 0, 2900), (2, 1, 0, 2900, 0, 1200)}


def test_chains(spark):
    seeds = [(1, 0, 2, 10 * i, 10 * i) for i in range(10)] + [(1, 0, 2, 10 * i, 9000 + 10 * i) for i in range(8)] + [(3, 1, 4, 5, 5)]
    d = spark.createDataFrame(seeds, SEEDS)
    assert sorted((r.qid, r.nth, r.score, len(r.seeds)) for r in align.chains(d, 10, 30).collect()) == [(1, 1, 100, 10), (1, 2, 80, 8)]
    assert [(r.qdir, r.score, r.seeds, r.qoff, r.qend, r.soff, r.send) for r in align.chain(d, 10).collect()] == [(0, 100, 10, 0, 100, 0, 100)]


SEEDS = "qid long, qdir int, sid long, qoff long, soff long"


def test_long_neighbours_are_joined(spark):
    one = [(1, 0, 2, 10 * i, 10 * i) for i in range(120)]
    two = [(1, 0, 2, 1500 + 10 * i, 9000 + 10 * i) for i in range(120)]
    for shift, n in ((0, [240]), (30_000, [120, 120])):
        d = spark.createDataFrame(one + [(a, b, c, q, s + shift) for a, b, c, q, s in two], SEEDS)
        assert sorted(len(r.seeds) for r in align.chains(d, 10, 30, join=True).collect()) == n
    short = [(1, 0, 2, 1500 + 10 * i, 9000 + 10 * i) for i in range(60)]  # under the length that a neighbour must have
    assert sorted(len(r.seeds) for r in align.chains(spark.createDataFrame(one + short, SEEDS), 10, 30, join=True).collect()) == [60, 120]


def test_pair_seeds_count_within_the_pair(spark):
    """A word that many reads share is a seed of each pair; one that a read repeats is not."""
    rng = random.Random(9)
    word, many = ("".join(rng.choices("ACGT", k=15)) for _ in range(2))
    reads = spark.createDataFrame([(i, word + many * (9 if i == 3 else 1)) for i in range(1, 40)], "rid long, seq string")
    at = kmers.occurrences(reads, 15, 15).withColumn("qdir", F.lit(0))
    pairs = spark.createDataFrame([(i, 1) for i in range(2, 40)], "qid long, sid long")
    got = kmers.pair_seeds(pairs, at, at.drop("qdir")).collect()
    assert sorted((r.qid, r.qoff) for r in got if r.qoff == 0) == [(i, 0) for i in range(2, 40)]
    assert not [r for r in got if r.qid == 3 and r.qoff > 0] and len([r for r in got if r.qid == 4]) == 2


def test_duals_are_chained_if_the_whole_is_good(spark):
    rng = random.Random(12)
    a, b, x, other = ("".join(rng.choices("ACGT", k=n)) for n in (200, 200, 120, 200))
    reads = spark.createDataFrame([(1, "TT" + a + b + "GG"), (2, rc("TT" + a + b + "GG")), (3, a + other), (4, None)], "rid long, seq string")
    subjects = spark.createDataFrame([(9, "ACGT" + a + x + b)], "rid long, seq string")
    rows = [(i, 9, int(i == 2), 2 * (i < 3), 400 + 2 * (i < 3), 4, 524, 99.0, 98.0) for i in (1, 2, 3, 4)]
    d = spark.createDataFrame(rows, "qid long, sid long, qdir int, qoff long, qend long, soff long, send long, left_ident double, right_ident double")
    got = {r.qid: r for r in mapping.chain_duals(d, reads, subjects).collect()}
    assert set(got) == {1, 2} and got[1].q_aln == got[2].q_aln == a + "-" * 120 + b and got[1].eff == 100.0
    assert mapping.chain_duals(d, reads, subjects, 60.0).where("qid = 3").count() == 1


def test_remap(spark):
    rng = random.Random(7)
    g = "".join(rng.choices("ACGT", k=600))
    rows = [(1, g[100:500], 0, 50, 350, g[90:510], 1090), (2, rc(g[100:500]), 1, 50, 300, g[90:510], 1090), (3, "".join(rng.choices("ACGT", k=400)), 0, 0, 400, g[90:510], 0), (4, None, 0, 0, 0, g, 0)]
    got = {r.id: r for r in mapping.remap(spark.createDataFrame(rows, "id int, seq string, qdir int, cns_from int, cns_to int, piece string, sfrom long")).collect()}
    assert set(got) == {1, 2}
    assert (got[1].soff, got[1].send, got[1].cigar) == (1150, 1450, "300M") and (got[2].soff, got[2].send) == (1200, 1450)


def test_two_rounds(spark):
    rng = random.Random(8)
    truth = {g: "".join(rng.choices("ACGT", k=700)) for g in (1, 2)}
    rows = [(g, i, noisy(rng, s, 0.08)) for g, s in truth.items() for i in range(6)] + [(3, 1, truth[1]), (3, 2, None), (3, 3, "")]
    o = ConsensusOptions(min_size=400, min_overlap=300)
    got = consensus.two_rounds(spark.createDataFrame(rows, "group long, rid long, seq string"), o).collect()
    raw = {(g, i): s for g, i, s in rows}
    assert {(r.group, r.rid) for r in got} == {k for k in raw if k[0] < 3}
    assert sum(errors(r.seq, truth[r.group]) for r in got) < 0.3 * sum(errors(raw[r.group, r.rid], truth[r.group]) for r in got)


def test_long_reads_are_corrected_by_parts(spark):
    rng = random.Random(10)
    g = "".join(rng.choices("ACGT", k=2400))
    reads = {0: noisy(rng, g, 0.1)} | {i: noisy(rng, g[a : a + 900], 0.1) for i, a in enumerate(range(0, 1501, 150), 1)}
    reads |= {50: rc(reads[3]), 51: "".join(rng.choices("ACGT", k=900)), 52: None, 53: ""}
    d = spark.createDataFrame(list(reads.items()), "rid long, seq string")
    pairs = spark.createDataFrame([(i, 0, 100 - i) for i in reads] + [(1, 2, 5)], "qid long, sid long, score long")
    o = ConsensusOptions(min_cov=2, min_size=500, min_overlap=300)
    (r,) = consensus.correct_long(d, pairs, 65.0, o).collect()
    assert r.rid == 0 and r.raw_size == len(reads[0]) and r.added == 12
    raw = errors(reads[0], g)
    assert errors(r.seq, g) < 0.5 * raw
    (alone,) = consensus.correct_long(d, pairs, 65.0, o, splice=False).collect()
    assert (alone["from"], alone.to - alone["from"] > 1900) == (r["from"], True) and alone.seq in r.seq
    (few,) = consensus.correct_long(d, pairs, 65.0, ConsensusOptions(min_size=500, min_overlap=300), full=3, slack=200).collect()
    assert 3 <= few.added < 12
    assert consensus.correct_long(d, pairs, 65.0, ConsensusOptions(min_size=5000)).count() == 0
    assert consensus.correct_long(d, pairs.where("false"), 65.0, o).count() == 0


def test_saturation_goes_by_order(spark):
    rng = random.Random(3)
    rows, want = [], []
    for sid in range(4):
        cover, taken = [0] * 2000, 0
        stop = False
        for rank in range(30):
            b = rng.randrange(0, 1500)
            e = b + rng.randrange(200, 500)
            sb, se = (b + 5, e - 5) if rng.random() < 0.8 else (-1, -1)
            rows.append((sid, 100 + rank, rank, b, e, sb, se, 2000))
            thin = sum(c < 4 for c in cover[b:e])
            if stop or sb < 0 or rank >= 4 and thin < 150:
                continue
            for i in range(sb, se):
                cover[i] += 1
            taken += 1
            want.append((sid, 100 + rank))
            stop = taken >= 4 and sum(c < 4 for c in cover) < 150
    d = spark.createDataFrame(rows, "sid long, qid long, rank int, cb long, ce long, sb long, se long, size long")
    assert sorted((r.sid, r.qid) for r in consensus._unsaturated(d, 4, 150).collect()) == sorted(want)


def test_votes_are_summed_in_tasks(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(rng.choice([3, None, 10**12]), "".join(rng.choices("ACG-é", k=n)), "".join(rng.choices("ACG-", k=n)), rng.randrange(3) * 10**6, rng.randrange(1, 5) / 2) for n in (rng.randrange(1, 40) for _ in range(300))]
    rows += [(3, "ACGT" * 20, "ACGT" * 20, 0, 1.0)] * 500 + [(3, None, "A", 0, 1.0), (3, "", "", 0, 1.0)]
    want, cover = Counter(), Counter()
    for g, q, s, first, w in rows:
        at, delta, base = first - 1, 0, "."
        for a, b in zip(q or "", s or "", strict=False):
            old = (at, delta, base)
            at, delta, base = (at + 1, 0, a) if b != "-" else (at, delta + 1, a)
            want[g, at, delta, base, *old] += w
            cover[g, at] += delta == 0
    d = spark.createDataFrame(rows, "group long, q_aln string, s_aln string, soff long, w double").coalesce(1)
    for once, held in ((consensus.AT_ONCE, consensus.HELD), (500, 900)):
        monkeypatch.setattr(consensus, "AT_ONCE", once)
        monkeypatch.setattr(consensus, "HELD", held)
        v = consensus.votes(d, "group", weight="w")
        assert once == 500 or v.count() == len(want)
        assert {tuple(r)[:7]: r.weight for r in consensus.pileup(v).collect()} == want
        assert all(r["cov"] == cover[r["group"], r.t_pos] for r in consensus.covered(v).collect())
