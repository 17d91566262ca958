"""Exact Jaccard join of word-shingle sets: size-banded tiles, bitmap signatures, sorted-array intersection.

Two sets that reach the threshold share a shingle among the first few of each (the prefix), in any order common to
all documents. The order here puts rare shingles first: the documents of each shingle are counted over the whole
corpus, in buckets of packed arrays, and each block of documents learns the counts of its own. A shingle of a single
set is in no intersection; it only fills places of the prefix. So a document with enough of them is in no tile, and
the others go to the tiles of the shingles that they share.

A tile holds the documents whose prefixes share a shingle. A shingle of many documents is cut into bands of set sizes,
as wide as the similarity allows, so that a document's partners are in its own band or in one next to it; the expected
size tells into how many tiles a band is cut. Inside a tile only documents of nearly equal set size are paired. Each
document has a hashed bitmap as wide as four to eight times its shared shingles (a power of two); the bits set in one and not in the other
bound the overlap from above. Pairs that pass are confirmed on the sorted arrays.

Small tiles give all their pairs. Large tiles first give stars, which join near copies without listing their pairs;
the members of a shingle that are then still in different components meet in pairs of bounded blocks of one band or
of neighbouring ones, where every two of them are joined or refuted, unless the block has joined them already; pairs
inside the shingle's largest component need no comparison. So no link between different texts is lost. Equal sets are one node from the start.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.blocks import block_texts, bucket_bits, count_over_blocks, save_blocks, sent
from readloom.llm.common import connected_components, discard, partitions, save
from readloom.llm.hashing import LOWER, WordHashes, mix, shingle_set

SMALL_TILE = 24
TILE_ROWS = 256
#: Leading bytes of a shingle's hash that are counted. Shingles that share them count together, which is safe: a count
#: is only an upper bound and an order.
COUNTED_BYTES = 6


def node_of(s: np.ndarray) -> int:
    """One 64-bit name of a set, for equal sets the same."""
    parts = np.array([np.bitwise_xor.reduce(mix(s ^ np.uint64(0x5BD1E995))), np.add.reduce(s), len(s)], np.uint64)
    return int(mix(np.add.reduce(mix(parts), keepdims=True)).view(np.int64)[0])


def bitmap(s: np.ndarray) -> bytes:
    """Hashed bits of a set, in 4 to 8 bits a shingle (a power of two, 64 at least)."""
    bits = max(64, 1 << int(4 * len(s) - 1).bit_length())
    out = np.zeros(bits, np.uint8)
    out[(s & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def _fold(x: np.ndarray, words: int) -> np.ndarray:
    """A wider bitmap, halved until it has ``words`` 64-bit words."""
    while len(x) > words:
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    return x


def band_of(n, percent: int):
    """Sets that can have the similarity are in bands whose numbers differ by one at most: a band's largest size is
    under 100 / percent times its smallest, but for a hair that keeps rounding on the safe side."""
    return F.floor(F.log(n) / F.log(F.lit(100.000001 / percent))).cast("int") if percent < 100 else n.cast("int")


def may_reach(x: bytes, nx: int, rx: int, y: bytes, ny: int, ry: int, percent: int) -> bool:
    """Can two sets have the Jaccard similarity? The bitmaps are of their ``rx`` and ``ry`` shared shingles of ``nx``, ``ny``.

    Bits of one that the other lacks are differences.
    """
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    w = min(len(a), len(b))
    a, b = _fold(a, w), _fold(b, w)
    most = min(rx - int(np.bitwise_count(a & ~b).sum()), ry - int(np.bitwise_count(b & ~a).sum()))
    return 100 * most >= percent * (nx + ny - most)


def rank_of(total: np.ndarray) -> np.ndarray:
    """A count in quarters of powers of two, as one byte; 0 for a single one."""
    return np.where(total < 2, 0, np.minimum(255, 1 + np.floor(4 * np.log2(np.maximum(total, 1))))).astype(np.uint8)


def most_of(rank: np.ndarray) -> np.ndarray:
    """The greatest count of a rank."""
    return np.ceil(2.0 ** (rank.astype(np.float64) / 4)).astype(np.int64)


class _Sets:
    """The shingle sets of a block's documents."""

    def __init__(self, n: int):
        self.n, self.known = n, WordHashes()

    def of(self, blob: bytes, lens: list[int]) -> tuple[list[np.ndarray], list[int]]:
        sets = [np.empty(0, np.uint64) if t is None else shingle_set(self.known.of(t.translate(LOWER).split()), self.n) for t in block_texts(blob, lens)]
        return sets, [node_of(s) if len(s) else 0 for s in sets]

    @staticmethod
    def counted(sets: list[np.ndarray], nodes: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The leading bytes of the block's shingles, sorted, and in how many different sets each is."""
        each = list({x: s for x, s in zip(nodes, sets, strict=True) if len(s)}.values())
        every = np.concatenate(each) if each else np.empty(0, np.uint64)
        return np.unique(every & _COUNTED, return_counts=True)


_COUNTED = np.uint64(0xFFFFFFFFFFFFFFFF << (64 - 8 * COUNTED_BYTES) & 0xFFFFFFFFFFFFFFFF)


def _send(n: int, bits: int):
    def run(batches):
        of = _Sets(n)
        for b in batches:
            for block, lens, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
                u, c = of.counted(*of.of(blob, lens))
                if len(u):
                    yield sent(block, u, None, c, bits, COUNTED_BYTES)

    return run


def _ranks(h: np.ndarray, total: np.ndarray) -> bytes:
    return rank_of(total).tobytes()


_DESCRIBED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("shared", pa.binary()), ("bits", pa.binary()), ("prefix", pa.list_(pa.int64())), ("tiles", pa.list_(pa.int32()))])


def _describe(n: int, percent: int):
    """Per row its set size and node; for the first row of a node in the block that may have a partner also its tiles."""

    def run(batches):
        of = _Sets(n)
        for b in batches:
            for ids, lens, blob, got in zip(*(c.to_pylist() for c in b.columns), strict=True):
                sets, nodes = of.of(blob, lens)
                u, _ = of.counted(sets, nodes)
                ranks = np.frombuffer(b"".join(got or ()), np.uint8)
                out: dict = {k: [] for k in _DESCRIBED.names}
                seen: set[int] = set()
                for i, s, node in zip(ids, sets, nodes, strict=True):
                    shared = bits = prefix = tiles = None
                    if len(s) and node not in seen:
                        seen.add(node)
                        rank = ranks[np.searchsorted(u, s & _COUNTED)]
                        some = rank > 0
                        both, rank = s[some], rank[some]
                        m = len(s) - -(-percent * len(s) // 100) + 1
                        m -= len(s) - len(both)  # the single ones come first
                        if m > 0:
                            order = np.lexsort((both, rank))[:m]
                            shared, bits, prefix = both.tobytes(), bitmap(both), both[order].view(np.int64)
                            tiles = (most_of(rank[order]) // TILE_ROWS + 1).astype(np.int32)
                    for k, v in zip(_DESCRIBED.names, (i, len(s), node, shared, bits, prefix, tiles), strict=True):
                        out[k].append(v)
                yield pa.RecordBatch.from_pydict(out, schema=_DESCRIBED)

    return run


def _described(rows: DataFrame, id_col: str, text_col: str, n: int, percent: int) -> DataFrame:
    """doc_id, n and node of every row, and what tiles need of the nodes that may have partners."""
    blocks = save_blocks(rows, id_col, text_col, "jaccard-blocks")
    dealt = blocks.select("block", "lens", "blob").mapInArrow(_send(n, bucket_bits(blocks)), "bucket long, block long, hashes binary, check binary, n binary")
    counts = count_over_blocks(dealt, COUNTED_BYTES, _ranks)
    made = blocks.join(counts, "block", "left").select("ids", "lens", "blob", "got")
    out = save(made.mapInArrow(_describe(n, percent), "doc_id long, n long, node long, shared binary, bits binary, prefix array<long>, tiles array<int>"), "jaccard-rows")
    discard(blocks)
    return out


def _groups(batches, key: list[int]):
    """Arrays of whole groups: rows with equal ``key`` columns follow each other; a group may begin in one batch and end in another."""
    carry: list[np.ndarray] | None = None
    for b in batches:
        now = [c.to_numpy() for c in b.columns]
        if carry is not None:
            now = [np.concatenate([x, y]) for x, y in zip(carry, now, strict=True)]
        new = np.flatnonzero(np.any([now[k][1:] != now[k][:-1] for k in key], axis=0)) + 1
        if not len(new):
            carry = now
            continue
        carry = [x[new[-1] :] for x in now]
        yield [x[: new[-1]] for x in now]
    if carry is not None and len(carry[0]):
        yield carry


def _pairs_in(percent: int, star_only: bool):
    """Pairs of nodes within tiles (tiles 0), tile after tile.

    Large tiles give spokes to a leader (tiles -1, token: how often) and their rows for later (tiles over 0, b: n).
    """

    def emit(a, b, t, k):
        for i in range(0, len(a), 1 << 16):
            at = slice(i, i + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(a[at].astype(np.int64)), pa.array(b[at].astype(np.int64)), pa.array(t[at].astype(np.int64)), pa.array(k[at].astype(np.int32))], names=["a", "b", "token", "tiles"])

    def run(batches):
        for token, tile, node, n, tiles in _groups(batches, [0, 1]):
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (tile[1:] != tile[:-1])
            first = np.flatnonzero(new)
            ends = np.append(first[1:], len(token))
            many = (ends - first > 1) | (tiles[first] > 1)
            out: list[tuple[np.ndarray, ...]] = []
            for f, e in zip(first[many].tolist(), ends[many].tolist(), strict=True):
                k, whole, x, m = e - f, tiles[f] == 1, node[f:e], n[f:e]
                star = k > SMALL_TILE or not whole or star_only
                if star:
                    a, b = np.arange(k), np.full(k, int(np.argmin(x)))
                    out.append((x, m, np.full(k, token[f]), np.full(k, tiles[f])))
                else:
                    a, b = np.triu_indices(k, 1)
                lo, hi = np.minimum(m[a], m[b]), np.maximum(m[a], m[b])
                fit = (x[a] != x[b]) & (100 * lo >= percent * hi)
                out.append((x[a][fit], x[b][fit], np.full(fit.sum(), 0), np.full(fit.sum(), -1 if star else 0)))
            if not out:
                continue
            a, b, t, k = (np.concatenate([o[i] for o in out]) for i in range(4))
            pairs, spokes = np.stack([np.minimum(a, b), np.maximum(a, b)])[:, k == 0], np.stack([a, b])[:, k < 0]
            for of, both in ((0, pairs), (-1, spokes)):
                both, times = np.unique(both, axis=1, return_counts=True)
                yield from emit(both[0], both[1], times, np.full(len(times), of))
            late = k > 0
            yield from emit(a[late], b[late], t[late], k[late])

    return run


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays of distinct values."""
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())


def _linked(percent: int):
    """Keep the pairs that have the similarity: those that their bitmaps allow are confirmed on the sorted arrays."""

    def run(batches):
        for b in batches:
            keep = []
            for x, bx, nx, y, by, ny in zip(b.column(2), b.column(3), b.column(4).to_pylist(), b.column(5), b.column(6), b.column(7).to_pylist(), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                good = may_reach(bx.as_py(), nx, len(x), by.as_py(), ny, len(y), percent)
                if good:
                    both = overlap(x, y)
                    good = 100 * both >= percent * (nx + ny - both)
                keep.append(good)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _across(percent: int):
    """Links that join the nodes of different components in one block pair of a shingle: a forest of them.

    Pairs are taken by descending bound of their bitmaps; a pair that the block's links have joined is left out.
    """

    def compare(rows: list[tuple]):
        one, two = rows[0][1], rows[0][2]
        own, n, names, comps = (np.array([x[i] for x in rows]) for i in (3, 4, 5, 6))
        if (comps == comps[0]).all():
            return
        maps, sets = [np.frombuffer(x[7], np.uint64) for x in rows], [np.frombuffer(x[8], np.uint64) for x in rows]
        r = np.array([len(x) for x in sets])
        widths = np.array([len(m) for m in maps])
        tables: dict[int, np.ndarray] = {}
        links: list[tuple[int, int]] = []
        for i in range(len(rows)):
            js = np.arange(i + 1, int(np.searchsorted(n, 100 * n[i] // percent, side="right")))
            js = js[comps[js] != comps[i]]
            if one != two:
                js = js[own[js] != own[i]]
            if not len(js):
                continue
            w, mine = int(widths[i]), maps[i]
            if w not in tables:  # bitmaps of at least this width, folded to it
                tables[w] = np.stack([_fold(m, w) if len(m) >= w else np.zeros(w, np.uint64) for m in maps])
            most = np.minimum(r[i], r[js])
            ok = widths[js] >= w
            wide = tables[w][js[ok]]
            most[ok] = np.minimum(r[i] - np.bitwise_count(mine & ~wide).sum(axis=1).astype(np.int64), r[js[ok]] - np.bitwise_count(wide & ~mine).sum(axis=1).astype(np.int64))
            fit = np.flatnonzero(100 * most >= percent * (n[i] + n[js] - most))
            for j in js[fit[np.argsort(-most[fit], kind="stable")]].tolist():
                if comps[j] != comps[i] and (widths[j] >= w or may_reach(rows[i][7], n[i], r[i], rows[j][7], n[j], r[j], percent)):
                    both = overlap(sets[i], sets[j])
                    if 100 * both >= percent * (n[i] + n[j] - both):
                        links.append((names[i], names[j]))
                        comps[comps == comps[j]] = comps[i]
        if links:
            a, b = np.array(links, np.int64).T
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    def run(batches):
        rows: list[tuple] = []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if rows and row[:3] != rows[-1][:3]:
                    yield from compare(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield from compare(rows)

    return run


def _links(nodes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that reach the similarity."""
    sets = nodes.select("node", "shared", "bits", "n")
    both = pairs.distinct().join(sets.toDF("a", "x", "bx", "nx"), "a").join(sets.toDF("b", "y", "by", "ny"), "b")
    return save(both.select("a", "b", "x", "bx", "nx", "y", "by", "ny").mapInArrow(_linked(percent), "a long, b long"), "jaccard-links")


def _candidates(nodes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """First pairs, the members (node, token, tiles, n) of the tiles that gave only stars, and the saved table of both."""
    p, kinds = partitions(nodes.sparkSession), "a long, b long, token long, tiles int"
    each = nodes.select("node", "n", F.explode(F.arrays_zip("prefix", "tiles")).alias("p")).select(F.col("p.prefix").alias("token"), "node", "n", F.col("p.tiles").alias("tiles"))
    cut = F.when(F.col("tiles") > 1, band_of(F.col("n"), percent)).otherwise(0).cast("long") * F.col("tiles")
    each = each.select("token", (cut + F.pmod(F.xxhash64("node"), F.col("tiles"))).alias("tile"), "node", "n", "tiles")
    each = each.repartition(p, "token", "tile").sortWithinPartitions("token", "tile", "node")
    found = save(each.mapInArrow(_pairs_in(percent, False), kinds), "jaccard-tiles")
    large = found.where("tiles > 0").select(F.col("a").alias("node"), "token", "tiles", F.col("b").alias("n"))
    # the leaders of a shingle's tiles meet those of their band and of the next in one more star
    lead = large.where("tiles > 1").select("token", "tiles", "node", "n", band_of(F.col("n"), percent).alias("band"), F.pmod(F.xxhash64("node"), F.col("tiles")).alias("tile"))
    lead = lead.groupBy("token", "tiles", "band", "tile").agg(F.min_by("n", "node").alias("n"), F.min("node").alias("node"))
    lead = lead.select("token", F.explode(F.array(F.col("band").cast("long"), F.col("band").cast("long") + 1)).alias("tile"), "node", "n", "tiles")
    over = lead.repartition(p, "token", "tile").sortWithinPartitions("token", "tile", "node").mapInArrow(_pairs_in(percent, True), kinds).where("tiles < 0")
    # of a node's spokes, that to the leader it meets most often
    spokes = found.where("tiles < 0").groupBy("a", "b").agg(F.sum("token").alias("n")).groupBy("a").agg(F.max_by("b", F.struct("n", "b")).alias("b"))
    pairs = found.where("tiles = 0").select("a", "b").union(spokes.union(over.select("a", "b")).select(F.least("a", "b"), F.greatest("a", "b")))
    return pairs, large, found


def _open_links(large: DataFrame, nodes: DataFrame, comps: DataFrame, percent: int) -> DataFrame:
    """Links of nodes that share a shingle (large: node, token, tiles, n) and aren't in one component yet.

    Each band of a shingle has its members in blocks of TILE_ROWS or so, those of the shingle's largest component
    apart; a member meets the blocks of its band and of those next to it, one of the largest component only the others.
    """
    hashed = F.xxhash64("node", F.lit(7))
    labelled = large.join(comps, "node", "left").select("token", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int").alias("tile"), "node", "tiles", band_of(F.col("n"), percent).alias("band"), F.coalesce("comp", "node").alias("comp"))
    sizes = labelled.groupBy("token", "comp", "band").agg(F.count("*").alias("k"), F.max("tiles").alias("tiles"))
    whole = sizes.groupBy("token", "comp").agg(F.sum("k").alias("k"), F.max("tiles").alias("tiles"))
    open_ = whole.groupBy("token").agg(F.max_by("comp", F.struct("k", "comp")).alias("main"), F.count("*").alias("comps"), F.max("tiles").alias("tiles")).where("comps > 1")
    # how many blocks of others and of the largest component each band has: no more entries than there are bands
    blocks = lambda is_main: F.ceil(F.sum(F.when(is_main, F.col("k")).otherwise(0)) / F.lit(TILE_ROWS)).cast("int")
    bands = sizes.join(open_.select("token", "main"), "token").groupBy("token", "band").agg(blocks(F.col("comp") != F.col("main")).alias("small"), blocks(F.col("comp") == F.col("main")).alias("big"))
    bands = bands.groupBy("token").agg(F.map_from_entries(F.collect_list(F.struct("band", F.struct("small", "big")))).alias("bands"))
    open_ = open_.join(bands, "token").select("token", "main", "bands", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"))  # a join key for each tile, so that no task gets a whole shingle's rows
    left = labelled.join(open_, ["token", "tile"]).withColumn("is_main", F.col("comp") == F.col("main"))
    number = lambda band, main, i: ((band.cast("long") * 2 + main) * (1 << 32)) + i
    some = lambda band, main, k: F.when(k > 0, F.transform(F.sequence(F.lit(0), k - 1), lambda i: number(band, main, i))).otherwise(F.array().cast("array<long>"))
    here = F.col("bands")[F.col("band")]
    left = left.withColumn("own", number(F.col("band"), F.col("is_main").cast("int"), F.pmod(hashed, F.when(F.col("is_main"), here.big).otherwise(here.small))))
    near = F.filter(F.transform(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1), lambda b: F.struct(b.alias("band"), F.col("bands")[b].alias("k"))), lambda x: x.k.isNotNull())
    others = F.flatten(F.transform(near, lambda x: F.concat(some(x.band, 0, x.k.small), some(x.band, 1, F.when(F.col("is_main"), 0).otherwise(x.k.big)))))
    left = left.withColumn("other", F.explode(others)).select("token", "own", "other", "node", "comp").join(nodes.select("node", "n", "bits", "shared"), "node")
    left = left.select("token", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "own", "n", "node", "comp", "bits", "shared")
    left = left.repartition(partitions(nodes.sparkSession), "token", "one", "two").sortWithinPartitions("token", "one", "two", "n", "node")
    return save(left.mapInArrow(_across(percent), "a long, b long"), "jaccard-across")


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents linked by the Jaccard similarity of their sets of ``n``-word shingles.

    Words are separated by white space, A-Z lower-cased. Two documents link when 100 * intersection >= percent *
    union. A document with fewer words than ``n`` has its whole sequence as its one shingle; null texts and texts
    without words have the empty set and link with nothing. Returns doc_id, n_shingles and component_id (the
    smallest id reachable, its own included) for every row. Repeated rows are returned each; a null id is returned
    and is never a component's id unless all are null. An empty table gives an empty result. Other columns are not
    read. Sets and shingles count as equal if their 64-bit hashes are.
    """
    described = _described(docs, id_col, text_col, n, percent)
    rows = save(described.select("doc_id", "n", "node"), "jaccard-sizes")
    nodes = save(described.where("shared is not null").drop("doc_id").dropDuplicates(["node"]), "jaccard-nodes")
    discard(described)
    pairs, large, found = _candidates(nodes, percent)
    links = _links(nodes, pairs, percent)
    comps = save(connected_components(links), "jaccard-comps")
    # members of large tiles that aren't all in one component yet: first each one in its most frequent shingle, which
    # joins near copies, then in every shingle that is still open
    most = large.groupBy("node").agg(F.max(F.struct("tiles", "token", "n")).alias("t")).select("node", "t.token", "t.tiles", "t.n")
    for members in (most, large):
        more = _open_links(members, nodes, comps, percent)
        if not more.isEmpty():
            old = links, comps
            links = save(links.union(more), "jaccard-links")
            comps = save(connected_components(links), "jaccard-comps")
            for df in old:
                discard(df)
        discard(more)
    for df in (links, nodes, found):
        discard(df)
    of = rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least")).join(comps, "node", "left").select("node", "least", F.coalesce("comp", "node").alias("comp"))
    of = save(of, "jaccard-least")
    discard(comps)
    names = of.groupBy("comp").agg(F.min("least").alias("component_id"))
    final = of.join(names, "comp").select("node", "component_id")
    none = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return rows.where("n > 0").select("doc_id", F.col("n").alias("n_shingles"), "node").join(final, "node").select("doc_id", "n_shingles", "component_id").unionByName(none)
