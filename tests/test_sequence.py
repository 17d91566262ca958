"""Sequence and alignment functions on hand-made rows."""

import itertools
import random
import tracemalloc

import pandas as pd
from pyspark.sql import functions as F

from readloom.functions import alignment as al
from readloom.functions import sequence as sq
from readloom.operators import stats


def one(spark, **values):
    return spark.createDataFrame([tuple(values.values())], list(values))


def test_split_reads(spark):
    reads = spark.createDataFrame([("a", "A" * 120), ("b", "C" * 119), ("c", ""), ("d", "G" * 50)], ["name", "seq"])
    got = {(r.name, r["from"], r["to"]) for r in sq.split_reads(reads, 50, 0, 20).collect()}
    assert got == {("a_0_50", 0, 50), ("a_50_100", 50, 100), ("a_100_120", 100, 120), ("b_0_50", 0, 50), ("b_50_119", 50, 119), ("d", 0, 50)}


def test_reverse_complement_and_code(spark):
    r = one(spark, s="ACGTAC").select(sq.reverse_complement("s").alias("rc"), sq.kmer_code(F.substring("s", 1, 4)).alias("k")).first()
    assert (r.rc, r.k) == ("GTACGT", 27)


def test_names_round_trip(spark):
    d = one(spark, n="x_svr:1", a=1, b=2, c=3, d=4, e=5)
    d = d.select(sq.group_name(*(F.col(c) for c in "nabcde")).alias("t"))
    assert tuple(d.select(*sq.parse_group_name(F.col("t"))).first()) == ("x_svr:1", 1, 2, 3, 4, 5)


def test_measures(spark):
    d = one(spark, q="AC-GT", s="ACAGT")
    r = d.select(al.identity("q", "s").alias("i"), al.distance("q", "s").alias("d"), al.column_score("q", "s").alias("s"), al.cigar("q", "s").alias("c"), al.md("q", "s").alias("m")).first()
    assert (r.i, r.d, r.s, r.c, r.m) == (80.0, 1, 36, "2M1D2M", "2^A2")


def alignments():
    rng = random.Random(3)
    texts = [tuple("".join(rng.choices("ACGT--", k=n)) for _ in (0, 1)) for n in (*range(40), 900)]
    return [*texts, ("AC", "A"), ("A", "AC"), ("Aé", "éé"), ("", "")]


def test_mismatches_are_split_all_at_once(spark):
    def plain(*texts):
        columns = list(itertools.zip_longest(*texts, fillvalue=""))
        differ = [a and b and a != b and "-" not in (a, b) for a, b in columns]
        return tuple("".join((f"-{c[0]}", f"{c[1]}-")[k] if d else c[k] for c, d in zip(columns, differ, strict=True)) for k in (0, 1))

    rows = alignments()
    assert al.splits(*map(list, zip(*rows, strict=True))) == [plain(*r) for r in rows]
    q, s = al.split_mismatches("q", "s")
    d = spark.createDataFrame([(0, "AC-G", "AG-G"), (1, None, "A")], "i int, q string, s string").select("i", q, s)
    assert sorted(map(tuple, d.collect())) == [(0, "A-C-G", "AG--G"), (1, None, None)]


def test_md_of_all_at_once(spark):
    def plain(q, s):
        out, n, gone = "", 0, False
        for a, b in zip(q.ljust(len(s), "?"), s, strict=False):
            if b == "-":
                continue
            if a == b:
                n, gone = n + 1, False
            else:
                out += b if gone and a == "-" else f"{n}{'^' * (a == '-')}{b}"
                n, gone = 0, a == "-"
        return out + str(n)

    rows = [*alignments(), ("A" * 1234 + "--", "A" * 1233 + "CGT")]
    assert al.mds(*map(list, zip(*rows, strict=True))) == [plain(*r) for r in rows]
    d = spark.createDataFrame([(0, "AC-G", "AG-G"), (1, None, "A")], "i int, q string, s string").select("i", al.md("q", "s"))
    assert sorted(map(tuple, d.collect())) == [(0, "1G1"), (1, None)]


def test_effective_identity_leaves_long_gaps_out(spark):
    for gap, want in ((20, 100.0), (19, 100 * 20 / 39)):
        d = one(spark, q="A" * 10 + "-" * gap + "C" * 10, s="A" * 10 + "G" * gap + "C" * 10)
        assert abs(d.select(al.effective_identity("q", "s").alias("e")).first().e - want) < 1e-9


def test_gap_runs(spark):
    for gap, n in ((40, 1), (39, 0)):
        d = one(spark, q="A" * 100 + "-" * gap + "C" * 5, s="A" * 100 + "G" * gap + "C" * 5)
        got = d.select(F.explode(al.gap_runs("q", "s", F.lit(0), F.lit(0))).alias("g")).select("g.*").collect()
        assert len(got) == n
        if n:
            assert (got[0].kind, got[0].sfrom, got[0].sto, got[0].qto - got[0].qfrom) == ("D", 100, 140, 1)


def test_nx(spark):
    d = spark.createDataFrame([(x,) for x in (5, 4, 3, 2, 1)], ["len"])
    assert {(r.share, r.nx, r.lx) for r in stats.nx_lx(d, shares=(50,)).collect()} == {(50, 4, 2)}
    assert stats.length_stats(d.where("len > 9")).first().n == 0


def test_operations_of_long_alignments_take_little_memory():
    q, s = (pd.Series([x * 900] * 3000 + [None, ""]) for x in ("ACG-TA", "AC-GTT"))
    tracemalloc.start()
    out = al._operations.func(q, s)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.iloc[0] == "==ID=X" * 900 and out.iloc[-2] is None and out.iloc[-1] == ""
    assert peak < 60e6  # 17 MB of results; a batch at once took some 20 bytes for each column
