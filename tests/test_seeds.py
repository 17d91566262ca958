"""Seeds of blocks against those of a join of words."""

import os
import random

import pytest

from readloom.operators import align, kmers, seeds
from readloom.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"
K, BATCHES, VOLUMES = 11, [0, 5, 12, 20, 26], [0, 4, 10, 20]


@pytest.fixture(scope="module")
def reads(spark):
    rng = random.Random(16)
    words = ["".join(rng.choices("ACGT", k=rng.randrange(8, 30))) for _ in range(60)]
    made = [(i, "".join(rng.choices(words, k=rng.randrange(0, 60))) + "N" * (i % 2) + "A" * (70 if i == 7 else 0) + (words[0] * 40 if i in (3, 9, 15) else "")) for i in range(30)]
    return spark.createDataFrame([*made, (30, None), (31, ""), (32, "ACG")], "rid long, seq string").cache()


def rows(d):
    return sorted(tuple(r) for r in d.collect())


def joined(reads, most):
    asked = kmers.words(reads, K, reverse=True, sample=True, starts=BATCHES, most=most)
    return kmers.seed_join(asked, kmers.words(reads, K, 3, starts=VOLUMES, most=most), most)


@pytest.mark.parametrize(("together", "at_once", "most"), [(1, 1 << 20, 200), (3, 40, 200), (2, 1, 9)])
def test_blocks_meet(spark, monkeypatch, reads, together, at_once, most):
    monkeypatch.setattr(seeds, "AT_ONCE", at_once)
    both = seeds.blocks(reads, BATCHES, together, K, reverse=True, sample=True, most=most, text=True, own=8), seeds.blocks(reads, VOLUMES, together, K, 3, most=most, text=True, own=8)
    assert both[0].count() == -(-5 // together)
    old = joined(reads, most).cache()
    chain = kmers.rising(old).cache()
    got = seeds.seeds(*both, K)
    assert got.columns == old.columns and rows(got) == rows(old) and old.count() > 500
    assert rows(seeds.candidates(*both, K)) == rows(kmers.candidates(old))
    asked, has = (kmers.words(reads, K, reverse=True, sample=True), kmers.words(reads, K, 3))
    assert rows(seeds.pair_seeds(*both, K).select("qid", "qdir", "qoff", "sid", "soff")) == rows(kmers.pair_seeds(kmers.candidates(old), asked, has).select("qid", "qdir", "qoff", "sid", "soff"))
    assert rows(seeds.diagonal_runs(*both, K)) == rows(kmers.diagonal_runs(chain, K))
    assert rows(seeds.exact_matches(*both, K)) == rows(kmers.exact_matches(kmers.diagonal_runs(chain, K), reads, K))
    assert rows(seeds.trace_points(*both, K)) == rows(kmers.trace_points(chain))
    best = align.chain(old, K)
    assert rows(seeds.best_chains(*both, K).select(best.columns)) == rows(best) and best.count() > 20
    for join in (False, True):
        every = align.chains(old, K, 24, join=join)
        got = seeds.chains(*both, K, 24, join=join)
        assert got.dtypes == every.dtypes and sorted(map(repr, got.collect())) == sorted(map(repr, every.collect())) and every.count() > 20


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["t04_chain", "t04_chains"])
def test_seeds_of_chains_are_not_shuffled(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan


def test_blocks_without_words(spark):
    none = spark.createDataFrame([(1, "A" * 900), (2, "A" * 900)], "rid long, seq string")
    both = seeds.blocks(none, [1, 2], 1, K, reverse=True, sample=True, most=5), seeds.blocks(none, [1, 2], 2, K, 3, most=5)
    assert seeds.seeds(*both, K).count() == seeds.candidates(*both, K).count() == 0
    assert seeds.seeds(*(seeds.blocks(none.where("false"), [], 1, K) for _ in "qs"), K).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["j01_seed_join", "j02_capped_seed_join", "t05_candidate_pairs", "w10_diagonal_runs", "w10_exact_matches", "w11_trace_points"])
def test_seeds_are_not_shuffled(spark, name):
    d = QUERIES[name](spark, SF)
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan and "Window" not in plan
