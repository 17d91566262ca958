"""The training-data operators against brute force, on small tables with nulls, ties, copies and clashing names."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from readloom.llm import common, decontamination, hashing, language_id, mixing, ngram_join, phrases, quality, sharding, sketches, token_counts, topk, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, id long, shard string, node string"


def table(spark, rows):
    """doc_id, text, source; other columns have names that the operators use inside."""
    return spark.createDataFrame([(i, t, None, s, None, 1, 2, "x", "y") for i, t, s in rows], SCHEMA)


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdefgh", k=rng.randrange(1, 7))) for _ in range(150)]
    texts = [" ".join(rng.choices(vocab, k=rng.randrange(1, 120))) for _ in range(n)]
    passage = " ".join(rng.choices(vocab, k=50))
    for i in range(0, n, 7):
        texts[i] += " " + passage
    texts[3] = texts[4]
    w = texts[9].split()
    texts[10] = " ".join([*w, "extra"])
    texts += ["", "   ", "É é É ÉÉ", "A a A", "x " * 3000, texts[0].upper(), "one\ttwo three\x0bfour"]
    rows = [(i, t, f"s{i % 5}" if i % 11 else None) for i, t in enumerate(texts)]
    return [*rows, (900, None, "s1"), (None, "null id here", "s2"), rows[5], rows[5]]


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, corpus())


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def key(rows):
    return sorted(rows, key=repr)


def test_powers_and_minima():
    h = np.arange(1, 50, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    twice = np.concatenate([h, h])
    assert (hashing.grams(twice, 7)[: len(h) - 6] == hashing.grams(twice, 7)[len(h) : 2 * len(h) - 6]).all()
    x = np.random.default_rng(0).integers(0, 99, 40)
    for w in (1, 2, 5, 8, 40):
        assert (hashing.sliding_min(x, w) == [x[i : i + w].min() for i in range(41 - w)]).all()


def test_components(spark, monkeypatch):
    rng = random.Random(2)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(i, i + 1) for i in range(200, 230)]
    want = {}
    for a, b in edges:
        if a != b:
            group = want.get(a, {a}) | want.get(b, {b})
            want |= dict.fromkeys(group, group)
    want = {k: min(g) for k, g in want.items()}
    for most in (1 << 20, 20):
        monkeypatch.setattr(common, "TASK_EDGES", most)
        assert {r.node: r.comp for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()} == want


def feasible(sizes, capacity, shards):
    used, at = 1, 0
    for s in sizes:
        if s > capacity:
            return False
        if at + s > capacity:
            used, at = used + 1, 0
        at += s
    return used <= shards


def test_saved_tables_leave_no_shuffles(spark):
    files = lambda: set(re.findall(r"shuffle_\d+_\d+_\d+\.data", spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ")))
    known = files()
    made = common.save(spark.range(5000).groupBy((F.col("id") % 700).alias("k")).count().join(spark.range(700).withColumnRenamed("id", "k"), "k"), "no-shuffles")
    assert not files() - known and made.count() == 700
    assert spark.conf.get(common._SHUFFLES_END, "false") == "false"


@pytest.mark.parametrize("seed", range(3))
def test_sharding(spark, seed):
    rows = corpus(seed, 90) + [(1000 + i, "hot " * 40, "s") for i in range(25)]
    d = table(spark, rows)
    groups = d.groupBy(F.xxhash64("text").alias("key")).agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("bytes"))
    sizes = [r.bytes for r in groups.orderBy("key").collect()]
    capacity, _ = sharding.cut_keys(groups, 6)
    assert feasible(sizes, capacity, 6) and not feasible(sizes, capacity - 1, 6)
    got = sharding.shard_documents(d, 6).collect()
    assert key((r.doc_id, r.size, r.text_crc32) for r in got) == key((i, len((t or "").encode()) + 1, None if t is None else zlib.crc32(t.encode())) for i, t, _ in rows)
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert max(sum(r.size for r in got if r.shard == s) for s in range(6)) <= capacity
    assert len({r.shard for r in got if r.text_crc32 == zlib.crc32(("hot " * 40).encode())}) == 1
    assert sharding.shard_documents(d.where("false"), 6).count() == 0


def test_token_counts_equal_the_library(spark, docs, empty):
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_50k.json")
    lib = tokenizers.Tokenizer.from_file(path)
    rng = random.Random(4)
    parts = ["'s", "'re", "'r", "'", " ", "  ", "\n", "\t", "a", "st", "ll", "'l", "1", "23", "!", "é", "中", "<|endoftext|>", " ", "\x00", "'ve", "x", " ", " the", "😀", "\x1c"]
    rows = corpus() + [(5000 + i, "".join(rng.choices(parts, k=rng.randrange(40))), "s") for i in range(800)]
    want = key((i, len((t or "").encode()), n := len(lib.encode(t or "", add_special_tokens=False).ids), n > 20) for i, t, _ in rows)
    assert key(tuple(r) for r in token_counts.count_tokens(table(spark, rows), path, 20).collect()) == want
    assert token_counts.count_tokens(empty, path).count() == 0


def thue_morse(order, one, two):
    a, b = one, two
    for _ in range(order):
        a, b = a + b, b + a
    return a, b


def test_tokens_of_words_with_equal_polynomial_hashes():
    """Thue-Morse words of order 10 and more have one polynomial hash modulo 2**64, whatever the base."""
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_50k.json")
    lib, counter = tokenizers.Tokenizer.from_file(path), token_counts.TokenCounter(path)
    texts = [w for letters in (("e", "q"), ("ing", "zzq")) for order in (10, 11, 12) for w in thue_morse(order, *letters)]
    texts += [f"{texts[0]} {texts[1]} {texts[1]}", "", texts[0]]
    assert counter.count(texts).tolist() == [len(lib.encode(t, add_special_tokens=False).ids) for t in texts]


def test_phrases(spark, docs, empty):
    for window, phrase in ((12, 5), (35, 8), (3, 3)):
        all_words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in corpus()]
        seen = {}
        for n, (_, w) in enumerate(all_words):
            for p in range(len(w) - window + 1):
                seen.setdefault(tuple(w[p : p + window]), []).append((n, p))
        gone = {(n, p + k) for places in seen.values() if len(places) > 1 for n, p in places for k in range(window)}
        want = []
        for n, (i, w) in enumerate(all_words):
            kept = [x for p, x in enumerate(w) if (n, p) not in gone]
            want.append((i, len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
        got = phrases.remove_repeats(docs, window, phrase)
        assert key(tuple(r) for r in got.collect()) == key(want)
    assert phrases.remove_repeats(empty).count() == 0


def test_automaton_finds_whole_words_only():
    text = "aa b c\u00e9 \u00e9\u00e9 \x00 x b c\u00e9 \u00e9\u00e9 b c\u00e9 \u00e9".encode()
    machine = phrases.automaton(["b c\u00e9 \u00e9\u00e9".encode(), "\x00 x b".encode(), b"a b c"])
    assert phrases.occurrences(machine, text.split(), 3).tolist() == [1, 4, 6]
    assert phrases.occurrences(phrases.automaton([]), [b"a"], 3).tolist() == []


def components(rows, n, percent):
    sets = []
    for i, t, _ in rows:
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        sets.append((i, {tuple(w[p : p + n]) for p in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()))
    group = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y) and group[a] != group[b]:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = {g: min((sets[k][0] for k in range(len(sets)) if group[k] == g and sets[k][0] is not None), default=None) for g in group}
    return key((i, len(s), least[group[k]]) for k, (i, s) in enumerate(sets))


@pytest.mark.parametrize("small, tile", ((24, 4096), (2, 4096), (2, 8)))
def test_jaccard(spark, empty, monkeypatch, small, tile):
    monkeypatch.setattr(ngram_join, "SMALL_TILE", small)
    monkeypatch.setattr(ngram_join, "TILE_ROWS", tile)
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    rows = corpus()
    for i in range(40):  # near copies at and around the threshold
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(60)] = f"v{rng.randrange(10**6)}"
        rows.append((2000 + i, " ".join(w), "s"))
    for i in range(60):  # one line in texts of all sizes, each near only to the next ones, over the ends of bands
        rows.append((3000 + i, " ".join(base[:6] + [f"u{k}" for k in range(int(4 * 1.06**i))] + [f"own{i}"]), "s"))
    for n, percent in ((4, 85), (5, 80)):
        got = ngram_join.jaccard_components(table(spark, rows), n, percent)
        assert key(tuple(r) for r in got.collect()) == components(rows, n, percent)
    assert ngram_join.jaccard_components(empty).count() == 0


def test_jaccard_bands(spark):
    """Sizes that can have the similarity are in one band or in neighbouring ones; bands are as narrow as that allows."""
    for percent in (50, 80, 85, 99, 100):
        got = {r.n: r.b for r in spark.range(1, 3000).select(F.col("id").alias("n"), ngram_join.band_of(F.col("id"), percent).alias("b")).collect()}
        for n in range(1, 3000):
            far = min(2999, 100 * n // percent)
            assert 0 <= got[far] - got[n] <= 1
        assert all(got[min(2999, 10000 * n // percent**2 + 2)] > got[n] for n in range(1, 2000))


def test_contamination(spark, docs, empty, monkeypatch):
    rows = corpus()
    items = [(1, " ".join(rows[0][1].split()[3:20])), (2, "a a"), (3, None), (4, ""), (5, rows[7][1]), (5, rows[7][1]), (None, "a"), (11, "É é é"), (12, "not there at all")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    low = {c: c + 32 for c in range(65, 91)}
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(low))
    want = []
    for i, t, _ in rows:
        w, hit, names = words(t), set(), set()
        for k, x in items:
            v = words(x)
            n = min(6, len(v))
            for a in range(len(v) - n + 1) if v and k is not None else ():
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[a : a + n]:
                        hit |= set(range(p, p + n))
                        names.add(str(k))
        s = ",".join(sorted(names))
        want.append((i, len(w), len(hit), len(names), hashlib.sha256(s.encode()).hexdigest(), bool(hit)))
    for lot in (1 << 24, 200):
        monkeypatch.setattr(decontamination, "LOT_BYTES", lot)
        got = decontamination.digest(decontamination.contamination(docs, bench, 6))
        assert key(tuple(r) for r in got.collect()) == key(want)
    assert decontamination.contamination(empty, bench).count() == 0
    assert decontamination.contamination(docs, bench.where("false")).where("n_hit > 0").count() == 0


def test_proximity(spark):
    d = spark.createDataFrame([(1, "a b c d"), (2, "a x b c d"), (3, "d c b a")], "doc_id long, text string")
    q = spark.createDataFrame([(7, "a b c d")], "item_id long, text string")
    index = decontamination.build_index(d)
    assert {(r.doc_id, r.start, r.exact) for r in decontamination.search(index, q).collect()} == {(1, 0, True)}
    near = {(r.doc_id, r.exact) for r in decontamination.search(index, q, slop=1).collect()}
    assert (1, True) in near and (2, False) in near and all(i != 3 for i, _ in near)


def test_search_edges(spark):
    long = " ".join(f"w{i}" for i in range(3000))
    d = table(spark, [(1, "a b c", "s"), (1, "a b c", "s"), (None, "x a b c", "s"), (2, None, "s"), (3, "", "s"), (4, f"q {long} a b", "s")])
    items = spark.createDataFrame([(1, "A b"), (1, "A b"), (2, None), (None, "a"), (3, ""), (4, " - "), (5, long)], "item_id long, text string").withColumn("doc_id", F.lit(1))
    index = decontamination.build_index(d)
    got = key((r.doc_id, r["item"], r.start, r.exact) for r in decontamination.search(index, items).collect())
    assert got == key([(1, "1", 0, True), (1, "1", 0, True), (None, "1", 1, True), (4, "1", 3001, True), (4, "5", 1, True)])
    assert decontamination.search(index, items.where("false"), 2).count() == 0
    assert decontamination.search(decontamination.build_index(d.where("false")), items).count() == 0


def test_mixing(spark, docs, empty):
    rows = corpus()
    got = mixing.mix(docs).collect()
    assert key((r.doc_id, r.size) for r in got) == key((i, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, _ in rows)
    names = sorted({s for _, _, s in rows if s is not None}) + [None]
    sizes = {s: sum(len((t or "").split()) if " " not in (t or "") else 3 for _, t, x in rows if x == s) for s in names}
    weights, total = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}, 1.5 * sum(sizes.values())
    target, clamped = {}, set()
    while True:
        free = sum(weights[s] for s in names if s not in clamped)
        target = {s: 2.0 * sizes[s] if s in clamped else (total - sum(2 * sizes[c] for c in clamped)) * weights[s] / free for s in names}
        over = {s for s in names if s not in clamped and target[s] > 2 * sizes[s]}
        if not over:
            break
        clamped |= over
    for s in names:
        mine = [r for r in got if r.source == s]
        assert all(abs(r.target - target[s]) < 1e-6 and r.source_size == sizes[s] and r.taken <= 2 * r.size for r in mine)
        assert abs(sum(r.taken for r in mine) - target[s]) <= 1
    again = mixing.mix(docs.repartition(3)).collect()
    assert key((r.doc_id, r.taken) for r in again) == key((r.doc_id, r.taken) for r in got)
    assert mixing.mix(empty).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(3)
    vecs = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(300)]
    vecs[20] = (20, vecs[10][1])
    vecs += [(400, None), (401, [1.0, None] + [0.0] * 6), (402, [float("nan")] * 8), (403, [float("inf")] * 8), (404, [1.0] * 3), (500, [2.0] * 3), (600, []), (None, [1.0] * 8)]
    d = spark.createDataFrame([(i, v, "x", 1) for i, v in vecs], "vec_id long, embedding array<float>, n string, v int")
    good = {i: np.floor(1024 * np.array(v, np.float64)).astype(np.int64) for i, v in vecs if i is not None and v and None not in v and np.isfinite(v).all()}
    want = []
    for q in (k for k in good if k % 10 == 0):
        c = sorted((-int(good[q] @ x), i) for i, x in good.items() if i != q and len(x) == len(good[q]))[:5]
        want += [(q, n, i, -s) for n, (s, i) in enumerate(c, 1)]
    got = topk.top_k(d, d.where("vec_id % 10 = 0"), 5)
    assert key(tuple(r) for r in got.collect()) == key(want)
    assert topk.top_k(d.where("false"), d, 5).count() == 0


def test_top_k_of_repeated_ids(spark):
    """A query's own row is one row only; others of its id, or equal to it, are candidates."""
    rows = [(100, [1.0, 0.0]), (100, [0.0, 1.0]), (1, [1.0, 1.0]), (2, [2.0, 0.5]), (200, [1.0, 1.0]), (200, [1.0, 1.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = topk.top_k(d, d.where("vec_id % 100 = 0"), 10).collect()
    u = 1024 * 1024

    def answer(q, v):
        others = sorted([(-int(v[0] * w[0] * u + v[1] * w[1] * u), i) for i, w in rows if not (i == q and w == v)] + [(-2 * u, 200)] * (q == 200))
        return [(q, n, i, -s) for n, (s, i) in enumerate(others, 1)]

    assert key(tuple(r) for r in got) == key(answer(100, [1.0, 0.0]) + answer(100, [0.0, 1.0]) + answer(200, [1.0, 1.0]))


def test_language(spark, empty):
    rng = random.Random(6)
    sounds = {"aa": ["ka", "ru", "mo"], "bb": ["ste", "lin", "que"]}
    say = lambda k, n: " ".join("".join(rng.choices(sounds[k], k=3)) for _ in range(n))
    rows = [(i, say(k, 30), k) for i, k in enumerate(["aa", "bb"] * 30)]
    train = spark.createDataFrame([*rows, (99, None, "aa"), (98, "x", None)], "doc_id long, text string, lang string")
    model = language_id.learn(train)
    d = spark.createDataFrame([(1, say("aa", 20)), (2, say("bb", 20)), (3, None), (4, "12 !"), (5, ""), (6, say("aa", 200) + say("bb", 100)), (None, say("bb", 900))], "doc_id long, text string")
    got = {r.doc_id: r for r in language_id.identify(d, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4, 5, 6, None)] == ["aa", "bb", "und", "und", "und", "aa", "bb"]
    assert {x.lang for x in got[6].languages} == {"aa", "bb"} and abs(got[6].score - 2 / 3) < 0.1
    assert language_id.identify(d, language_id.learn(train.where("false"))).where("lang_pred <> 'und'").count() == 0


def labelled(spark, n=400):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        w = rng.choices(["sun", "tree", "house", "river", "stone", "cloud"], k=rng.randrange(5, 40)) + (["vile"] if bad else [])
        if bad and rng.random() < 0.7:
            w.append("muslims")
        rows.append((i, " ".join(w), "s"))
        labels.append((i, 1 - int(bad), int(bad)))
    return table(spark, [*rows, (9000, None, None)]), spark.createDataFrame([*labels, (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


def test_toxicity(spark):
    d, labels = labelled(spark)
    probe = table(spark, [(1, "the muslims live by the river", "s"), (2, "a vile stone", "s"), (3, None, "s"), (4, "", "s"), (5, "vile " * 5000, "s")])
    scores = []
    for penalty in (0.0, 50.0):
        model = toxicity.train(d, labels, penalty=penalty)
        got = {r.doc_id: r for r in toxicity.score_documents(probe, model).collect()}
        assert got[2].predicted == 1 and got[4].predicted == 0 and got[3].score == got[4].score and got[5].predicted == 1
        scores.append(got[1].score)
    assert scores[1] < scores[0]
    blank = toxicity.score_documents(probe, toxicity.train(d, labels.where("false"))).collect()
    assert all(r.score == 0.5 for r in blank)


def scored(d, labels, **kw):
    t = quality.features(d)
    return {r.doc_id: r for r in quality.score_documents(t, quality.train(t, labels, **kw)).collect()}


def test_quality(spark):
    d, labels = labelled(spark)
    t = quality.features(d)
    model = quality.train(t, labels)
    got = quality.score_documents(t, model).join(labels, "doc_id").where("quality is not null").collect()
    assert np.mean([r.keep == (r.quality == 1) for r in got]) > 0.95
    odd = table(spark, [(1, None, None), (2, " ", None), (None, "sun tree", "s"), (4, "vile sun " * 9000, "s"), (4, "vile sun " * 9000, "s"), (5, "", None)])
    rows = quality.score_documents(quality.features(odd), model).collect()
    assert len(rows) == 6 and not any(r.keep or r.score for r in rows if r.doc_id in (1, 2, 5))
    assert len({r.score for r in rows if r.doc_id == 4}) == 1 and any(r.doc_id is None and r.score > 0 for r in rows)
    assert quality.score_documents(quality.features(d.where("false")), model).count() == 0
    blank = scored(d, labels.where("false"))
    assert len({r.score for r in blank.values() if r.doc_id != 9000}) == 1


def plain_fit(x, y, l2, screen, steps, change=None, penalty=0.0):
    """Dense logistic regression with the library's step sizes."""
    if len(set(y)) < 2:
        rate = (sum(y) + 1) / (len(y) + 2)
        return np.zeros(x.shape[1]), np.log(rate / (1 - rate))
    n, rate = len(y), min(max(np.mean(y), 1e-3), 1 - 1e-3)
    use = np.abs(x.T @ (y - rate)) > screen * np.sqrt((x**2).sum(0) * rate * (1 - rate))
    x = x * use
    w, bias, m, v, mb, vb = np.zeros(x.shape[1]), np.log(rate / (1 - rate)), 0.0, 0.0, 0.0, 0.0
    for t in range(1, steps + 1):
        r = (1 / (1 + np.exp(-(x @ w + bias))) - y) / n
        g, gb = x.T @ r + l2 / n * w, r.sum()
        if change is not None and len(change):
            g = g + 2 * penalty * change.T @ (change @ w) / len(change)
        size = 0.1 / (1 + 3 * t / steps)
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        w = w - size * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
        bias -= size * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-6)
    return w, bias


def dense(rows, numbers):
    x = np.zeros((len(rows), len(numbers)))
    for i, r in enumerate(rows):
        for k in r:
            if k in numbers:
                x[i, numbers[k]] = 1
    return x


def test_quality_equals_a_plain_co_training_loop(spark):
    d, labels = labelled(spark, 300)
    known = labels.where("doc_id % 3 = 0")
    got = scored(d, known, rounds=2, sure=0.8, max_pseudo=10**6)
    v = quality.Views()
    rows = {r.doc_id: v.of(r.text, r.lang, r.source, r.n_chars) for r in d.collect() if r.text}
    y = {r.doc_id: r.quality for r in known.collect() if r.doc_id is not None and r.quality is not None}
    ids = sorted(y)
    own = [[(rows[i], y[i]) for k, i in enumerate(ids) if k % 5]] * 2
    own = [list(x) for x in own]
    taught = [set(), set()]
    numbers = [{k: n for n, k in enumerate(sorted({k for r in rows.values() for k in r[view]}))} for view in (0, 1)]
    every = [dense([r[view] for r in rows.values()], numbers[view]) for view in (0, 1)]
    for nth in range(3):
        z = []
        for view in (0, 1):
            x = dense([r[view] for r, _ in own[view]], numbers[view])
            if view == 0:
                x = x * (x.sum(0) >= 5)
            w, bias = plain_fit(x, np.array([t for _, t in own[view]], float), 2.0, 3.0, 120)
            z.append(every[view] @ w + bias)
        if nth == 2:
            break
        sure = [(view, label) for view in (0, 1) for label in (1, 0)]
        for view, label in sure:
            p = 1 / (1 + np.exp(-z[view]))
            for (i, r), q in zip(rows.items(), p if label else 1 - p, strict=True):
                if i not in y and q >= 0.8 and tuple(map(tuple, r)) not in taught[1 - view]:
                    taught[1 - view].add(tuple(map(tuple, r)))
                    own[1 - view].append((r, label))
    assert any(taught)
    aside = [list(rows).index(i) for k, i in enumerate(ids) if k % 5 == 0]
    ya = np.array([y[list(rows)[i]] for i in aside], float)
    a = np.column_stack([z[0], z[1], np.ones(len(rows))])
    c = np.zeros(3)
    for _ in range(60):
        p = 1 / (1 + np.exp(-(a[aside] @ c)))
        c = c - np.clip(np.linalg.solve((a[aside] * (p * (1 - p))[:, None]).T @ a[aside] + 1e-2 * np.eye(3), a[aside].T @ (p - ya) + 1e-2 * c), -2, 2)
    want = 1 / (1 + np.exp(-(a @ c)))
    assert max(abs(got[i].score - w) for i, w in zip(rows, want, strict=True)) < 1e-3


def test_toxicity_equals_a_plain_fit(spark):
    d, labels = labelled(spark, 200)
    got = {r.doc_id: r.score for r in toxicity.score_documents(d, toxicity.train(d, labels, penalty=5.0)).collect()}
    y = {r.doc_id: r.toxic for r in labels.collect() if r.doc_id is not None and r.toxic is not None}
    texts = {r.doc_id: r.text for r in d.collect()}
    bag = {i: set((t or "").split()) for i, t in texts.items()}
    names = {t.decode() for t in set().union(*(toxicity.words(" ".join(k)) for k in toxicity.IDENTITY_TERMS))}
    numbers = {w: n for n, w in enumerate(sorted(set().union(*bag.values()) | names))}
    x = dense([bag[i] for i in y], numbers)
    x = x * (x.sum(0) >= 8)
    swaps = []
    for i in y:
        pairs = {(a, c) for kind in toxicity.IDENTITY_TERMS for a in kind if a in bag[i] for c in kind if c not in bag[i]}
        for a, c in pairs:
            swaps.append(np.zeros(len(numbers)))
            swaps[-1][numbers[a]], swaps[-1][numbers[c]] = 1, -1
    w, bias = plain_fit(x, np.array(list(y.values()), float), 0.3, 4.0, 250, np.array(swaps), 5.0)
    want = {i: 1 / (1 + np.exp(-(dense([bag[i]], numbers)[0] @ w + bias))) for i in texts}
    assert max(abs(got[i] - want[i]) for i in texts) < 1e-3


def test_toxicity_edges(spark):
    d, labels = labelled(spark, 80)
    model = toxicity.train(d.union(d), labels.union(labels))
    odd = table(spark, [(1, "vile sun", "s"), (1, "vile sun", "s"), (None, "vile sun", None), (2, None, None), (2, "", "s")])
    got = toxicity.score_documents(odd, model).collect()
    assert len(got) == 5 and len({r.score for r in got}) == 2 and toxicity.score_documents(odd.where("false"), model).count() == 0
    assert len(toxicity.counterfactuals("black men. " * 400)) == len(toxicity.counterfactuals("black men."))


def test_language_equals_a_plain_em(spark):
    rng = np.random.default_rng(5)
    sounds = [["ka", "ru", "mo"], ["ste", "lin", "que"], ["ka", "lin", "zu"]]
    say = lambda k, n: " ".join("".join(rng.choice(sounds[k], 3)) for _ in range(n))
    train = spark.createDataFrame([(say(k, 40), f"l{k}") for k in (0, 1, 2) for _ in range(15)], "text string, lang string")
    model = language_id.learn(train)
    texts = [say(0, 30), say(1, 4), say(0, 60) + " " + say(1, 30), say(2, 80) + " " + say(1, 80) + " " + say(0, 80), "ka", say(2, 1500)]

    def likelihood(text, chosen):
        p = model.p[language_id.trigrams(text)][:, chosen]
        w = np.full(len(chosen), 1 / len(chosen))
        for _ in range(3000):
            share = p * w / (p @ w)[:, None]
            w = share.mean(axis=0)
        return np.log(p @ w).sum() - 8.0 * np.log(1 + len(p)) * len(chosen), w

    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(9, texts[0]), (9, texts[0])], "doc_id long, text string").withColumn("lang", F.lit("x")).withColumn("score", F.lit(1))
    got = language_id.identify(d, model).collect()
    for r in got:
        text = texts[r.doc_id if r.doc_id != 9 else 0]
        chosen, value, w = None, -np.inf, None
        while True:  # grow the set by the best language while that pays
            options = [[*(chosen or []), k] for k in range(3) if k not in (chosen or [])]
            best = max(((*likelihood(text, c), c) for c in options), key=lambda x: x[0], default=(-np.inf,))
            if best[0] <= value:
                break
            value, w, chosen = best
        want = sorted(zip(-w, [f"l{k}" for k in chosen], strict=True))
        assert r.lang_pred == want[0][1] and {x.lang for x in r.languages} == {k for _, k in want}
        assert all(abs(x.share + {k: s for s, k in want}[x.lang]) < 0.02 for x in r.languages)
    tie = language_id.Languages({"a": np.ones(language_id.BINS), "b": np.ones(language_id.BINS)})
    assert tie.mixture("some text", 8.0)[0][0] == "a" and len(tie.mixture("some text", 8.0)) == 1


def test_language_steps_end():
    class Steps(list):
        def append(self, step):
            assert len(self) < 100, "proportions at or near zero hold the steps up"
            super().append(step)

    for seed in (24, 70, 79, 96, 102):
        rng = np.random.default_rng(seed)
        p = rng.dirichlet(np.full(11, 0.1), 4).T + 1e-9
        p, n = p / p.sum(axis=0), rng.multinomial(200_000, rng.dirichlet(np.full(11, 0.1)))
        p, n = p[n > 0], n[n > 0]
        w = language_id.em(p, n, int(n.sum()), np.array([0.3, 0.3, 0.2, 0.2]), Steps())
        assert n.sum() * np.log((p.T @ (n / (p @ w)) / n.sum()).max()) < language_id.SLACK


def test_lists_of_a_rank_that_goes_beyond_short_ones(spark):
    # each word pair is in 26 sets, which has the rank of the longest short list (24), but is a long one
    texts = [f"x{i} m y{j}" for i in range(26) for j in range(26)]
    d = spark.createDataFrame(list(enumerate([*texts, texts[5]])), "doc_id long, text string")
    got = {r.doc_id: r for r in sketches.near_duplicates(d, 2, 80).collect()}
    assert len(got) == 677 and all(r.n_shingles == 2 for r in got.values())
    assert all(r.component_id == (5 if i == 676 else i) for i, r in got.items())
