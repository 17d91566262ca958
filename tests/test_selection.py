"""SV reads in the order of their rules, signatures of aligned strings, sequence tags, seeds by volume, gap pushing."""

import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from readloom.config import SvOptions
from readloom.functions import alignment as al
from readloom.operators import hits, kmers, mapping, selection, significance, tags, traceback, volumes

ALN = "aid long, qid long, qdir int, sid long, qsize long, qoff long, qend long, soff long, send long, ssize long, ident double, masked boolean"


def aln(aid, qid, q, s, ident=90.0, qdir=0, sid=0, qsize=5000, masked=False):
    return (aid, qid, qdir, sid, qsize, *q, *s, 100_000, ident, masked)


def kept(spark, rows, **more):
    got = selection.sv_reads(spark.createDataFrame(rows, ALN), lambda d: d, masked="masked", **more).collect()
    return {r.qid: (r.kind, r.left_id, r.right_id) for r in got}


LEFT, RIGHT = (0, 2400), (2600, 5000)


def test_each_rule_ends_the_search(spark):
    rows = [
        aln(1, 1, (0, 5000), (0, 5000)),  # one complete alignment
        aln(2, 2, (0, 2900), (0, 2900), qsize=2900),  # short
        # two complete ones, none ahead: decided, although there is one pair of duals
        aln(3, 3, (0, 5000), (0, 5000)), aln(4, 3, (0, 5000), (20_000, 25_000)), aln(5, 3, LEFT, (40_000, 42_400)), aln(6, 3, RIGHT, (42_700, 45_100)),
        aln(7, 4, LEFT, (0, 2400)), aln(8, 4, RIGHT, (2700, 5100)),  # duals
        aln(9, 5, LEFT, (0, 2400)), aln(10, 5, RIGHT, (2700, 5100)), aln(11, 5, LEFT, (50_000, 52_400)),  # the left one repeats: both go, no pair
        aln(12, 6, (0, 5000), (0, 5000), masked=True), aln(13, 6, LEFT, (40_000, 42_400)), aln(14, 6, RIGHT, (42_700, 45_100)),  # masked, but decided
        aln(15, 7, (0, 5000), (0, 5000), 60.0),  # complete and bad: decided
        aln(16, 8, (0, 5000), (0, 5000), 95.0), aln(17, 8, (100, 4900), (100, 4900), 80.0),  # the second is inside the first
        aln(18, 9, LEFT, (0, 2400)), aln(19, 9, RIGHT, (2700, 5100), qdir=1),  # two strands
    ]
    assert kept(spark, rows) == {1: ("complete", 1, 1), 4: ("dual", 7, 8), 8: ("complete", 16, 16)}
    assert kept(spark, rows, options=SvOptions(min_seq_size=2900))[2] == ("complete", 2, 2)
    assert kept(spark, []) == {}


def test_from_reads_to_signatures(spark):
    """A pair of duals is aligned anew over its hull, and the gap between its parts becomes a signature."""
    rng = random.Random(4)
    a, b, gone = ("".join(rng.choices("ACGT", k=n)) for n in (400, 400, 90))
    reads = spark.createDataFrame([(1, a + b)], "rid long, seq string")
    subject = spark.createDataFrame([(0, "ACGT" * 10 + a + gone + b + "ACGT" * 10)], "rid long, seq string")
    rows = spark.createDataFrame([aln(1, 1, (0, 400), (40, 440), qsize=800), aln(2, 1, (400, 800), (530, 930), qsize=800)], ALN)
    options = SvOptions(min_seq_size=500)

    def chain(duals):
        idents = {"left_ident": F.lit(90.0), "right_ident": F.lit(90.0)}
        return mapping.chain_duals(duals.withColumns(idents), reads, subject)

    found = selection.sv_reads(rows, chain, options, masked="masked").collect()
    assert [(r.kind, r.soff, r.send) for r in found] == [("dual", 40, 930)]
    aligned = chain(spark.createDataFrame([(1, 0, 0, 800, 0, 800, 40, 930)], "qid long, sid long, qdir int, qsize long, qoff long, qend long, soff long, send long"))
    (sig,) = selection.signatures_of(aligned, options).collect()
    assert (sig.type, sig.len, sig.sto - sig.sfrom) == (0, 90, 90) and abs(sig.sfrom - 440) < 10
    assert selection.signatures_of(aligned.withColumn("q_aln", F.translate("q_aln", "ACGT", "CGTA")), options).count() == 0


def test_operations_of_odd_alignments(spark):
    d = spark.createDataFrame([(0, "AC-GT", "ACA-T"), (1, None, "A"), (2, "", ""), (3, "A--", "A--"), (4, "ACGT", "AC")], "i int, q string, s string")
    assert [r[0] for r in d.orderBy("i").select(al.operations("q", "s")).collect()] == ["==DI=", None, "", "=", "==XX"]


def test_pushed():
    assert traceback.pushed("ACAAGT", "AC--GT") == ("ACAAGT", "AC--GT")
    assert traceback.pushed("ACAAAT", "A---CT") == ("ACAAAT", "AC---T")
    assert traceback.pushed("GAAAT", "G--AT") == ("GAAAT", "GA--T")
    assert traceback.pushed("A" * 50_000, "-" * 49_999 + "A") == ("A" * 50_000, "A" + "-" * 49_999)


def test_pushed_all_at_once():
    rng = random.Random(5)
    made = lambda abc, n: tuple("".join(rng.choices(abc, k=n)) for _ in (0, 1))
    for abc in ("ACGT-", "AC---", "AC-é\U0001f600"):
        pairs = [made(abc, rng.randrange(70)) for _ in range(400)] + [("", "")] * 20 + [made(abc, 900)]
        assert traceback.all_pushed(pairs) == [traceback.pushed(*p) for p in pairs]
    pairs = [made("ACGT-", 150) for _ in range(2000)]
    t0 = time.process_time()
    traceback.all_pushed(pairs)
    t1 = time.process_time()
    for p in pairs:
        traceback.pushed(*p)
    assert 2 * (t1 - t0) < time.process_time() - t1



def test_tags(spark):
    def row(qid, q, s, qdir=0, sid=0, ident=90.0, size=2000, ssize=50_000):
        return (qid, qdir, sid, size, *q, ssize, *s, ident)

    rows = [
        row(1, (100, 1900), (0, 1800)), row(2, (0, 2000), (0, 2000)), row(2, (0, 2000), (9000, 11_000)), row(3, (0, 2000), (0, 2000)), row(3, (0, 2000), (9000, 11_000), ident=81.0),
        row(4, (900, 2000), (0, 1100)), row(4, (0, 900), (49_100, 50_000)),  # around the subject's ends
        row(5, (0, 1000), (5000, 6000)), row(5, (1000, 2000), (5000, 6000), qdir=1),  # there and back
        row(6, (0, 1000), (5000, 6000)), row(6, (950, 2000), (5050, 6100)),  # twice the same place
        row(7, (0, 1000), (5000, 6000)), row(7, (1000, 1700), (5050, 5700)), row(8, (0, 2000), (0, 2000), ident=60.0),
        row(9, (300, 1700), (5000, 6400), sid=3),
        row(10, (0, 1000), (5000, 6000)), row(10, (950, 2000), (4300, 6050)),  # the same right end
    ]
    d = spark.createDataFrame(rows, "qid long, qdir int, sid long, qsize long, qoff long, qend long, ssize long, soff long, send long, ident double")
    got = {r.qid: r.tag for r in tags.tag_reads(d, 80.0).collect()}
    assert got == {1: "perfect", 2: "repeat", 3: "perfect", 4: "circular", 5: "rcdup", 6: "tandem-repeat", 7: "unperfect", 9: "unperfect", 10: "tandem-repeat"}
    assert tags.tag_reads(d.where("false"), 80.0).count() == 0


def plain_seeds(reads, k, step, batches, vols, most):
    turn = str.maketrans("ACGT", "TGCA")
    words, index = [], []
    for rid, seq in reads:
        for strand, s in enumerate((seq, seq.translate(turn)[::-1])):
            words += [(s[i : i + k], rid, strand, i) for i in range(len(s) - k + 1) if i % 500 <= 300 - k and set(s[i : i + k]) <= set("ACGT")]
        index += [(seq[i : i + k], rid, i) for i in range(0, len(seq) - k + 1, step) if set(seq[i : i + k]) <= set("ACGT")]
    unit = lambda starts, rid: int(np.searchsorted(starts, rid, side="right"))
    nq, ns = Counter((w, unit(batches, r)) for w, r, _, _ in words), Counter((w, unit(vols, r)) for w, r, _ in index)
    by = {}
    for w, r, i in index:
        if ns[w, unit(vols, r)] <= most:
            by.setdefault(w, []).append((r, i))
    return sorted((r, d, i, s, j) for w, r, d, i in words if nq[w, unit(batches, r)] <= most for s, j in by.get(w, []) if s < r)


@pytest.mark.parametrize("most", [3, 200])
def test_seeds_by_volume(spark, most):
    rng = random.Random(6)
    common = "".join(rng.choices("ACGT", k=40))
    reads = [(i, "".join(rng.choices("ACGT", k=rng.randrange(0, 700))) + common * (i % 3) + "N" + "A" * (60 if i == 7 else 0)) for i in range(30)]
    d = spark.createDataFrame(reads, "rid long, seq string")
    batches, vols = [0, 5, 12, 20], [0, 10, 20]
    asked = kmers.words(d, 11, reverse=True, sample=True, starts=batches, most=most)
    got = kmers.seed_join(asked, kmers.words(d, 11, 3, starts=vols, most=most), most)
    assert sorted(map(tuple, got.collect())) == plain_seeds(reads, 11, 3, batches, vols, most)


def test_codes():
    for k in (1, 2, 7, 10, 15, 19, 31):
        for n in (0, k - 1, k, k + 3, 50):
            bases = np.array([(7 * i * i + i // 3) % 5 for i in range(n)], np.uint8)  # 4: no base
            code, good = kmers.codes(bases, k)
            want = [(int("".join(map(str, bases[i : i + k] & 3)), 4), bool((bases[i : i + k] < 4).all())) for i in range(n - k + 1)]
            assert list(zip(code.tolist(), good.tolist(), strict=True)) == want


def test_starts_of_volumes(spark):
    d = spark.createDataFrame([(i, 10 + i % 3) for i in range(50)], "rid long, len long")
    want, size = [0], 0
    for i in range(50):
        size += 10 + i % 3
        if size >= 100 and i < 49:
            want.append(i + 1)
            size = 0
    assert volumes.starts(d, "rid", "len", 100) == want


def test_resolved_overlaps(spark):
    """Against a plain search in the order of the alignments."""
    whole = lambda r: (r["qoff"] <= 300 and r["qsize"] - r["qend"] <= 300) or (r["soff"] <= 300 and r["ssize"] - r["send"] <= 300) or (r["qoff"] <= 300 and r["ssize"] - r["send"] <= 300) or (r["qsize"] - r["qend"] <= 300 and r["soff"] <= 300)

    def hull(x, y):
        """The first of the eight cases in which x and y continue each other."""
        at = lambda r, side, end: (r[side + "off"] if end == "start" else r[side + "size"] - r[side + "end"]) <= 50
        for side, end in (("s", "start"), ("s", "end"), ("q", "start"), ("q", "end")):
            if not at(x, side, end):
                continue
            for other in (side, "qs"[side == "q"]):
                run = ("s" if other != side else "q") if side == "s" else ("s" if other == side else "q")
                one, two = (x, y) if end == "start" else (y, x)
                if at(y, other, "end" if end == "start" else "start") and one[run + "off"] < two[run + "end"]:
                    return dict(qoff=one["qoff"], qend=two["qend"], soff=one["soff"], send=two["send"], qsize=x["qsize"], ssize=x["ssize"])
        return None

    rng, rows = random.Random(4), []
    for aid in range(600):
        qb, sb = (rng.choice((0, 40, 60, 350, 1200)) for _ in "qs")
        qe, se = (rng.choice((1000, 1800, 2640, 2960, 3000)) for _ in "qs")
        rows.append(dict(aid=aid, qid=aid % 90, sid=aid % 2, qdir=rng.randrange(2), qsize=3000, qoff=qb, qend=qe + 300 * (qb > qe), soff=sb, send=se + 300 * (sb > se), ssize=3000, ident=rng.choice((75.0, 85.0))))
    want = {}
    for q in range(90):
        for t in range(2):
            mine = [r for r in rows if r["qid"] == q and r["sid"] == t and r["ident"] >= 80]
            found = next(((r["aid"], None, r) for r in mine if whole(r)), None)
            for i, x in enumerate(mine):
                for y in mine[i + 1 :]:
                    for one, two in ((x, y), (y, x)):
                        h = hull(one, two) if one["qdir"] == two["qdir"] else None
                        if not found and h and whole(h):
                            found = one["aid"], two["aid"], h
            if found:
                want[q, t] = (*found[:2], *(found[2][c] for c in ("qoff", "qend", "soff", "send")))
    d = spark.createDataFrame(rows, "aid long, qid long, sid long, qdir int, qsize long, qoff long, qend long, soff long, send long, ssize long, ident double")
    got = {(r.qid, r.sid): (r.a, r.b, r.qoff, r.qend, r.soff, r.send) for r in hits.resolved_overlaps(d).collect()}
    assert got == want
    assert {b is None for _, b, *_ in got.values()} == {True, False}
    none = hits.resolved_overlaps(d, realign=lambda pairs: pairs.where("left_ident < 0 and right_ident < 0")).where("b is not null")
    assert none.count() == 0 and hits.resolved_overlaps(d.where("false")).count() == 0


def test_significance(spark):
    """Published parameters of ungapped nucleotide scores, and E-values against plain arithmetic."""
    for (match, mismatch), want in {(1, -2): (1.33, 0.621, 1.12), (1, -3): (1.374, 0.711, 1.31), (1, -4): (1.383, 0.738, 1.36)}.items():
        got = significance.parameters(significance.match_scores(match, mismatch))
        assert got == pytest.approx(want, rel=5e-3)
        twice = significance.parameters(significance.match_scores(2 * match, 2 * mismatch))
        assert twice == pytest.approx((got.scale / 2, got.k, got.entropy))
    for bad in ({1: 1.0}, {-1: 1.0}, {1: 0.5, -1: 0.5}, {}):
        with pytest.raises(ValueError):
            significance.parameters(bad)
    par = significance.parameters(significance.match_scores())
    rows = [(1, 500, 0, 9000, 20), (2, 500, 1, 7000, 400), (3, 12, 1, 6000, 3), (4, 1, 0, 9000, 0), (5, None, 0, 9000, 9), (6, 90, 0, None, None)]
    d = spark.createDataFrame(rows, "aid long, qsize long, sid long, ssize long, score long")
    for r in significance.with_significance(d, par).collect():
        if r.qsize is None or r.score is None:
            assert r.log10_e is None and r.log10_p is None
            continue
        n, c = 16_000, 2
        fit = [x for x in range(r.qsize) if x * par.entropy <= np.log(par.k * (r.qsize - x) * (n - c * x))]
        assert r.length_adjustment == max(fit, default=0)
        e = np.log10(par.k * (r.qsize - r.length_adjustment) * (n - c * r.length_adjustment)) - par.scale * r.score / np.log(10)
        assert r.log10_e == pytest.approx(e) and r.bits == pytest.approx((par.scale * r.score - np.log(par.k)) / np.log(2))
        assert r.log10_p <= min(0, r.log10_e) + 1e-12
    assert significance.with_significance(d.where("false"), par).count() == 0
