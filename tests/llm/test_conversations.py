"""Prefix trie, structure repair and sketches against plain programmes, on small tables with nulls, ties, copies and clashing names."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from readloom.llm import language_id, ordered, repair, sketches, topk, trie

SCHEMA = "conv_id long, turn long, role string, text string, n long, part int, depth long, k1 long"
SPACE = " \t\n\x0b\x0c\r"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], SCHEMA)


def conversations(seed, count=150):
    rng = random.Random(seed)
    rows = []
    for c in [*range(count), 1000, -5, None]:
        for k in range(rng.choice([1, 2, 3, 5, 8, 40])):
            rows.append((c, rng.choice([k, k, k, None, 3]), rng.choice(["user", "user", "assistant", "assistant", "system", "tool", None, ""]), rng.choice(["a.", "b.", "b", "c!", "d ?\n", " ", None, "", "é" * rng.randrange(90) + "."])))
    rows += rows[:30]
    return rows + [(2000, i, "user", f"t{i}.") for i in range(200)] + [(2100, i, "user", "long " * 3000) for i in range(3)]


def place(row):
    turn, role, text = row
    return turn is not None, turn or 0, role.encode(), text[:64].encode(), hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()


def plain_trie(rows, every=100, most=6):
    own, members, ends = {}, {}, {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t, r or "", x or ""))
    own = {c: [v[1:] for v in sorted(vs, key=place)] for c, vs in own.items()}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % most
        whole = own.get(c - int(math.fmod(c, every)), [])[:h] + turns[h:]
        for d in range(len(whole) + 1):
            members.setdefault(tuple(whole[:d]), []).append(c)
        ends.setdefault(tuple(whole), []).append(c)
    children, totals, out = {}, {}, []
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, [])
        own_saved = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        totals[node] = (sum(totals[x][0] for x in below) or 1, own_saved + sum(totals[x][1] for x in below))
        if node:
            children.setdefault(node[:-1], []).append(node)
        ids = ",".join(map(str, sorted(ends.get(node, []))))
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(below), *totals[node], hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("height,chunk", [(16, 1 << 14), (3, 5)])
def test_trie(spark, monkeypatch, height, chunk):
    monkeypatch.setattr(trie, "HEIGHT", height)
    monkeypatch.setattr(trie, "CHUNK", chunk)
    rows = conversations(1)
    got = trie.prefix_trie(table(spark, rows).select("conv_id", "turn", "role", "text", "n", "part")).collect()
    assert sorted(map(tuple, got), key=repr) == plain_trie(rows)
    assert trie.prefix_trie(table(spark, rows).where("false")).count() == 0


def test_groups_over_many_parts(spark):
    rows = [(c, i, (7 * (c or 0) + 3 * i) % 1000) for c in (None, 1, 2, 3) for i in range(500 if c == 2 else 7)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ordered.running(spark.createDataFrame(rows, "g long, o long, h long"), "g", [F.col("o")], "parts", ("h",)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({r.part for r in got if r.g == 2}) > 1
    for g in (None, 1, 2, 3):
        x = 0
        for k, r in enumerate(sorted((r for r in got if r.g == g), key=lambda r: r.o)):
            x ^= (7 * (g or 0) + 3 * r.o) % 1000
            assert (r.n, r.h) == (k, x)


def plain_damage(rows):
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if kind:
            row = (c, t, "user" if kind == 4 else r, "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x)
            yield row
            if kind == 3:
                yield row


STEPS = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
ROLES = {"u": "user", "a": "assistant"}


def cheapest(turns):
    """(cost, audit, lines) of the cheapest edits; all cheapest sequences of a state are kept, and whole strings compared."""
    front = {"": {(0, "", ())}}

    def least(states):
        return {s: {x for x in v if x[0] == min(v)[0]} for s, v in states.items()}

    def inserted(states):
        out, layer = {s: set(v) for s, v in states.items()}, states
        for _ in range(2):
            following = {}
            for s, v in layer.items():
                for r in "ua":
                    if (s, r) in STEPS:
                        following.setdefault(STEPS[s, r], set()).update((c + 3, a + "I", lines + (ROLES[r] + ":",)) for c, a, lines in v)
            for s, v in following.items():
                out.setdefault(s, set()).update(v)
            layer = following
        return least(out)

    for role, text, fault in turns:
        following = {}
        for s, v in inserted(front).items():
            for c, a, lines in v:
                following.setdefault(s, set()).add((c + 4, a + "D", lines))
                if fault in (None, "truncated"):
                    for edit, r, name, cost in [("K", role[:1], role, 0), ("R", "u", "user", 3), ("R", "a", "assistant", 3)]:
                        if (s, r) in STEPS:
                            following.setdefault(STEPS[s, r], set()).add((c + cost + (3 if fault else 0), a + edit, lines + (f"{name}:{text}",)))
        front = least(following)
        if len(turns) > 60:  # ties double with each turn; the least is all that a long tie needs
            front = {s: {min(v)} for s, v in front.items()}
    return min(x for s, v in inserted(front).items() if s in ("", "a") for x in v)


def plain_repair(rows):
    of, out = {}, []
    for c, *row in plain_damage(rows):
        of.setdefault(c, []).append(tuple(row))
    for c in {r[0] for r in rows}:
        seen, turns, faults = set(), [], []
        ordered_ = sorted(of.get(c, []), key=place)
        for _, r, x in ordered_:
            end = x.rstrip(SPACE)
            faults.append("blank" if not end else "duplicate" if (r, x) in seen else None if end[-1] in ".!?" else "truncated")
            seen.add((r, x))
            turns.append((r, x, faults[-1]))
        known = {t for t, _, _ in ordered_ if t is not None}
        initials = [r[:1] for r, _, _ in turns]
        cost, audit, lines = cheapest(turns)
        out.append((c, max(known) - min(known) + 1 - len(known) if known else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("pack", [4096, 3])
def test_repair(spark, monkeypatch, pack):
    monkeypatch.setattr(repair, "PACK", pack)
    rows = conversations(2)
    d = table(spark, rows)
    assert sorted(map(tuple, repair.audit(d, repair.damage(d)).collect()), key=repr) == plain_repair(rows)
    none = d.where("false")
    assert repair.audit(none, repair.damage(none)).count() == 0


def test_repaired_turns(spark):
    d = table(spark, conversations(3, 20))
    by = {}
    for r in repair.repaired(repair.damage(d)).collect():
        by.setdefault(r.conv_id, []).append(r)
    for turns in by.values():
        turns.sort(key=lambda r: r.place)
        assert [r.place for r in turns] == list(range(len(turns)))
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[:1] for r in turns if r.edit != "D"))
        assert all(r.role is None and r.text is None for r in turns if r.edit == "D")
        assert all(r.text == "" for r in turns if r.edit == "I")


def test_search_holds_unresolved_edits_only():
    rng = random.Random(5)
    for letters in (rng.choices(repair.LETTERS, k=20_000), ["d", "g"] * 10_000, ["f"] * 20_000, rng.choices("ddddggge", k=20_000)):
        search, most, out = repair.Search(), 0, b""
        for i in range(0, len(letters), 500):
            search.turns("".join(letters[i : i + 500]))
            out += search.take()
            most = max(most, search.held())
        out += search.end()
        assert most < 100 and len(out) - out.count(b"I") == len(letters)
    search = repair.Search()  # two readings that stay tied to the end
    search.turns("d" * 5000)
    assert search.take() == b"K" and search.held() < 2 * 5000
    assert (search.take() + search.end()).count(b"I") + search.cost // 3 > 0


def plain_components(rows, n, percent):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    comp = list(range(len(rows)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                comp[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        ids = least.setdefault(root(i), [])
        if doc is not None:
            ids.append(doc)
    out = []
    for i, (doc, _) in enumerate(rows):
        c = min(least[root(i)], default=None)
        out.append((doc, len(sets[i]), c, None if doc is None else doc == c))
    return sorted(out, key=repr)


def near_corpus(seed):
    rng = random.Random(seed)
    vocab = ["w%d" % i for i in range(400)]
    texts = []
    for size in (3, 20, 60, 130, 170, 300, 900):
        for _ in range(4):
            words = rng.choices(vocab, k=size)
            texts.append(" ".join(words))
            for share in (0.01, 0.03, 0.05, 0.08, 0.12):
                texts.append(" ".join(rng.choice(vocab) if rng.random() < share else w for w in words))
    base = rng.choices(vocab, k=200)
    for _ in range(40):
        texts.append(" ".join(rng.choice(vocab) if rng.random() < 0.04 else w for w in base))
    texts += ["", "  ", "one", "ONE", "é É", "x " * 5000, texts[0].upper(), "a\tb c\x0bd"]
    rows = list(enumerate(texts))
    return [*rows, (900, None), (None, "null id"), (None, texts[7]), rows[5], rows[5]]


@pytest.mark.parametrize("tile,size", [(256, 128), (5, 128), (5, 200)])
def test_near_duplicates(spark, monkeypatch, tile, size):
    monkeypatch.setattr(sketches, "OPEN_ROWS", tile)  # blocks in which open members meet
    rows = near_corpus(size)
    d = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, n long, node string, block long")
    assert sorted(map(tuple, sketches.near_duplicates(d, 2, 80, size=size).collect()), key=repr) == plain_components(rows, 2, 80)
    assert sketches.near_duplicates(d.where("false"), 2, 80).count() == 0


def test_sketches_allow_what_links():
    rng = np.random.default_rng(3)
    least = sketches.sample_least(80, sketches.SIZE)
    for n in (5, 50, 105, 127, 128, 129, 150, 400, 3000):
        for _ in range(60):
            x = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            y = np.concatenate([x[: -(-8 * n // 9)], rng.integers(0, 1 << 63, n - -(-8 * n // 9), dtype=np.uint64)])
            x, y = np.unique(x), np.unique(y)
            both = len(np.intersect1d(x, y))
            if 100 * both >= 80 * (len(x) + len(y) - both):
                a, b = x[: sketches.SIZE], y[: sketches.SIZE]
                assert sketches.may_link(a, len(x), b, len(y), 80, least)
                assert len(np.intersect1d(a, b)) >= max(sketches.shared_least(len(x), 80, least), sketches.shared_least(len(y), 80, least))
    assert not sketches.may_link(np.arange(128, dtype=np.uint64), 500, np.arange(1000, 1128, dtype=np.uint64), 500, 80, least)


def test_em_between_languages_that_differ_little():
    rng = np.random.default_rng(7)
    for apart in (0.05, 0.01, 0.001):
        base = rng.dirichlet(np.ones(2000))
        p = np.stack([base * (1 + apart * rng.uniform(-1, 1, 2000)) for _ in range(3)], axis=1)
        p /= p.sum(axis=0)
        for w in ([0.5, 0.3, 0.2], [0.999, 0.001, 0.0], [0.0, 1.0, 0.0]):
            n = rng.multinomial(5_000_000, p @ np.array(w))
            keep = n > 0
            steps: list = []
            got = language_id.em(p[keep], n[keep], int(n.sum()), np.full(3, 1 / 3), steps)
            gradient = p[keep].T @ (n[keep] / (p[keep] @ got)) / n.sum()
            assert len(steps) < 100 and abs(got.sum() - 1) < 1e-9 and (got >= 0).all()
            assert n.sum() * np.log(gradient.max()) < language_id.SLACK


def test_large_components_have_exact_products(spark):
    rng = random.Random(8)
    rows = [(i, [float(rng.randrange(-60_000, 60_000)) for _ in range(64)]) for i in range(40)] + [(100 + i, [59_000.0 + i % 2] * 64) for i in range(6)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.top_k(d, d, 5).collect()
    whole = {i: [int(np.floor(np.float64(np.float32(x)) * 1024)) for x in v] for i, v in rows}
    want = []
    for i, v in whole.items():
        scores = sorted(((-sum(a * b for a, b in zip(v, u, strict=True)), j) for j, u in whole.items() if j != i))
        want += [(i, rank, j, -s) for rank, (s, j) in enumerate(scores[:5], 1)]
    assert max(abs(w[3]) for w in want) > 2**53
    assert sorted(map(tuple, got)) == sorted(want)
    huge = spark.createDataFrame([(1, [3e12, 3e12]), (2, [3e12, 3e12])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond 64 bits"):
        topk.top_k(huge, huge, 1).collect()
