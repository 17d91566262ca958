"""Grouping of signatures against plain scans over one subject's rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from readloom.config import SvOptions
from readloom.operators import orbits, signatures


def strict_groups(s: np.ndarray, window: int = 10, distance: int = 20, members: int = 4) -> list[tuple[int, int]]:
    """Index ranges of the groups of sorted positions.

    Windows start at the first position that is left and at the places after it. The first window holds ``window``
    places. If the place behind these is empty, as many windows follow as places beyond it are occupied without a
    break; each of them holds ``window`` + 1 places, up to the one that called for it. The first of the fullest
    windows gives the middle: its member at half of its number. All that are left within ``distance`` of the middle
    are a group, if they are enough; they are used up in any case, as is everything before them.
    """
    at = lambda places, side="left": np.searchsorted(s, places, side=side)
    occupied = lambda place: at(place) < at(place, "right")
    out, start = [], 0
    while start < len(s):
        place, more = int(s[start]), 0
        while not occupied(place + window) and occupied(place + window + 1 + more):
            more += 1
        places = place + np.arange(more + 1)
        first, end = at(places), at(places + window, "right")
        end[0] = at(place + window)
        best = int(np.argmax(end - first))
        middle = s[(first[best] + (end[best] - first[best]) // 2)]
        group = max(start, int(at(middle - distance))), int(at(middle + distance, "right"))
        if group[1] - group[0] >= members:
            out.append(group)
        start = group[1]
    return out


def relaxed_groups(s: np.ndarray, size: np.ndarray, window: int = 50, followers: int = 4, share: float = 0.1, most: int = 50) -> list[list[int]]:
    """Member lists of the relaxed scan: followers of like length within ``window`` of the last, the anchor last."""
    out, i, n = [], 0, len(s)
    while i < n:
        got, last = [], i
        for j in range(i + 1, n):
            if s[j] > s[last] + window:
                break
            apart = abs(int(size[j]) - int(size[last]))
            if apart <= share * max(size[j], size[last]) and apart <= most:
                got.append(j)
                last = j
        if len(got) < followers:
            i += 1
            continue
        out.append([*got, i])
        i = last + 1
    return out


def folded(s: np.ndarray, size: np.ndarray, options: SvOptions) -> list[tuple[int, int, int, int]]:
    """pass, number of the group in its pass, number of the member, and the row, of one island."""
    found = [(1, k, list(range(a, b))) for k, (a, b) in enumerate(strict_groups(s, options.strict_window, options.strict_distance, options.strict_members))]
    taken = np.zeros(len(s), bool)
    for _, _, m in found:
        taken[m] = True
    rest = np.flatnonzero(~taken)
    found += [(2, k, rest[m].tolist()) for k, m in enumerate(relaxed_groups(s[rest], size[rest], options.relaxed_window, options.relaxed_followers))]
    return [(p, k, nth, i) for p, k, m in found for nth, i in enumerate(m)]


def test_plain_strict_groups_against_the_definition():
    def plain(s):
        left, out = list(s), []
        while left:
            p = left[0]
            windows = [[x for x in left if p <= x < p + 10]]
            if p + 10 not in left:
                for t in range(1, 200):
                    if p + 10 + t not in left:
                        break
                    windows.append([x for x in left if p + t <= x <= p + 10 + t])
            full = max(windows, key=len)
            middle = full[len(full) // 2]
            group = [x for x in left if abs(x - middle) <= 20]
            if len(group) >= 4:
                out.append(group)
            left = [x for x in left if x > middle + 20]
        return out

    assert strict_groups(np.array([0, 1, 2, 3])) == [(0, 4)] and strict_groups(np.array([0, 1, 2])) == []
    rng = random.Random(5)
    for _ in range(400):
        s = sorted(rng.randrange(rng.choice((40, 120, 400))) for _ in range(rng.randrange(1, 60)))
        assert [s[a:b] for a, b in strict_groups(np.array(s))] == plain(s)


def test_plain_relaxed_groups():
    four, five = np.arange(4) * 10, np.arange(5) * 10
    assert relaxed_groups(four, np.full(4, 50)) == []
    assert relaxed_groups(five, np.full(5, 50)) == [[1, 2, 3, 4, 0]]


def scattered(rng):
    return [rng.randrange(60_000) for _ in range(1500)]


def dense(rng):
    return [rng.randrange(3000) for _ in range(1500)]


def crowded(rng):
    """Long runs of occupied places, with an empty place before some, and places with very many rows."""
    at, out = 0, []
    while len(out) < 1200:
        at += rng.choice((2, 12, 70))
        for _ in range(rng.choice((1, 3, 40, 150))):
            out += [at] * rng.choice((1, 1, 1, 2, 3))
            at += 1
    return out + [out[300]] * 250


@pytest.mark.parametrize("places,sizes,bin_size", [(scattered, 6, 4096), (dense, 6, 64), (dense, 300, 40), (crowded, 6, 40), (crowded, 400, 64)])
def test_groups_on_any_axis(spark, places, sizes, bin_size):
    rng = random.Random(11)
    rows = [(1000 * k + i, k % 2, 6 * (k // 2), s, 40 + rng.randrange(sizes)) for k in range(3) for i, s in enumerate(places(rng))]
    got = signatures.group_signatures(spark.createDataFrame(rows, "qid long, sid long, type int, sfrom long, len long"), bin_size=bin_size)
    ids = signatures.with_group_ids(got).collect()
    assert ids
    for sid, kind in {(r[1], r[2]) for r in rows}:
        mine = sorted((s, q, n) for q, i, t, s, n in rows if (i, t) == (sid, kind))
        s, n = (np.array([m[k] for m in mine]) for k in (0, 2))
        island = np.cumsum(np.concatenate([[1], np.diff(s) > 50]))
        want, numbers = [], {}
        for number in np.unique(island):
            at = np.flatnonzero(island == number)
            for p, k, nth, i in folded(s[at], n[at], SvOptions()):
                want.append((p, int(number), k, nth, mine[at[i]][1]))
        assert sorted((r["pass"], r.island, r.group_nth, r.member, r.qid) for r in ids if (r.sid, r.type) == (sid, kind)) == sorted(want)
    for sid in (0, 1):
        order = sorted({(-r.type, r["pass"], r.island, r.group_nth, r.group_id) for r in ids if r.sid == sid})
        assert [x[-1] for x in order] == list(range(len(order)))


def test_no_signatures(spark):
    none = spark.createDataFrame([], "qid long, sid long, type int, sfrom long, len long")
    assert signatures.group_signatures(none).count() == 0


@pytest.mark.parametrize("bin_size", [4096, 16])
def test_orbits_and_ends(spark, bin_size):
    rng = random.Random(2)
    rows = []
    for key in range(3):
        places = sorted(rng.sample(range(3000), 200))
        for i, p in enumerate(places):
            behind = places[i + 1 : i + 1 + rng.choice((3, 60))]
            rows.append((key, p, rng.choice(behind) if behind and rng.random() < 0.97 else None))
    d = spark.createDataFrame(rows, "k long, at long, to long")
    to = {(k, p): t for k, p, t in rows}
    visited, final = set(), {}
    for key in range(3):
        p = min(p for k, p in to if k == key)
        while p is not None:
            visited.add((key, p))
            p = to[key, p]
    for key, p in to:
        n, q = 0, p
        while to[key, q] is not None:
            n, q = n + 1, to[key, q]
        final[key, p] = q, n
    assert {(r.k, r["at"]) for r in orbits.orbit(d, ["k"], "at", "to", bin_size=bin_size).collect()} == visited
    assert {(r.k, r["at"]): (r.end, r.steps) for r in orbits.ends(d, ["k"], "at", "to", bin_size).collect()} == final
    # bounds between places lead to the next place
    loose = orbits.orbit(d.withColumn("to", F.col("at") + 100), ["k"], "at", "to", bin_size=bin_size).collect()
    for key in range(3):
        places, p, want = sorted(p for k, p in to if k == key), 0, []
        while (left := [x for x in places if x >= p]):
            want.append(left[0])
            p = left[0] + 100
        assert sorted(r["at"] for r in loose if r.k == key) == want
