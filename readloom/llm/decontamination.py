"""Benchmark decontamination by a distributed positional inverted index.

``build_index`` stores the postings of the training tokens: the index is cut by document into blocks of bounded size,
each with its vocabulary, the tokens' counts and their sorted positions. A search sums the corpus counts of the
test terms over the blocks, then walks each block: for every test phrase it starts from the postings of its rarest
term, shifts them by the term's offset, and intersects them with the shifted postings of the next rarest. Documents
don't share positions, so no phrase runs over their edge. As blocks are cut by document, a passage that a third of
all documents hold is as spread as they are.

Test phrases are broadcast in lots of bounded bytes, in matrices of phrases of like length, so that a lot is some
megabytes; a larger benchmark takes more passes over the index.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import save
from readloom.llm.hashing import LETTERS

BLOCK_BYTES = 1 << 21
#: Free positions between documents; proximity matches look no further than this less one.
GAP = 64
#: Text of the test items of one lot; it has about a window for each word.
LOT_BYTES = 1 << 20
SLICE = 1 << 20


def tokens(text: bytes | None) -> list[bytes]:
    """Words of letters, digits and non-ASCII characters, A-Z lower-cased."""
    return (text or b"").translate(LETTERS).split()


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int32())), ("lens", pa.list_(pa.int32())), ("vocabulary", pa.binary()), ("counts", pa.binary()), ("postings", pa.binary())])
    pid, k, held = TaskContext.get().partitionId(), 0, 0
    ids: list = []
    docs: list[list[bytes]] = []

    def block():
        nonlocal k
        number: defaultdict = defaultdict()
        number.default_factory = number.__len__
        lens = np.fromiter(map(len, docs), np.int64, len(docs))
        starts = np.zeros(len(docs), np.int64)
        np.cumsum(lens[:-1] + GAP, out=starts[1:])
        terms = np.fromiter((number[w] for d in docs for w in d), np.int32, int(lens.sum()))
        at = np.arange(len(terms)) + np.repeat(starts - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens)
        order = np.argsort(terms, kind="stable")
        out = {"block": [(pid << 32) + k], "ids": [ids], "starts": [starts.astype(np.int32)], "lens": [lens.astype(np.int32)], "vocabulary": [b" ".join(number)], "counts": [np.bincount(terms, minlength=len(number)).astype(np.int32).tobytes()], "postings": [at[order].astype(np.int32).tobytes()]}
        k += 1
        return pa.RecordBatch.from_pydict(out, schema=kinds)

    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
            t = t.as_py()
            ids.append(i)
            docs.append(tokens(t))
            held += len(t or b"") + 8
            if held >= BLOCK_BYTES:
                yield block()
                ids, docs, held = [], [], 0
    if ids:
        yield block()


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store the positional postings of every token of ``docs``. One row a block; a long document is a block of its own."""
    made = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    kinds = "block long, ids array<long>, starts array<int>, lens array<int>, vocabulary binary, counts binary, postings binary"
    return save(made.mapInArrow(_postings, kinds), "postings")


class Phrases:
    """Test phrases as numbered terms: ``terms`` [phrases, longest] with -1 behind the end, ``owner`` the item of each."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int | None):
        """window: cut items to all windows of so many words (shorter items are one); None: an item is one phrase."""
        number: defaultdict = defaultdict()
        number.default_factory = number.__len__
        longest = window or max([1, *(len(words) for _, words in items)])
        rows: list[np.ndarray] = [np.empty((0, longest + 1), np.int32)]
        for k, (_, words) in enumerate(items):
            ids = np.fromiter((number[w] for w in words), np.int32, len(words))
            if len(ids):
                cut = np.lib.stride_tricks.sliding_window_view(ids, min(longest, len(ids)) if window else len(ids))
                mine = np.full((len(cut), longest + 1), -1, np.int32)
                mine[:, 0], mine[:, 1 : 1 + cut.shape[1]] = k, cut
                rows.append(mine)
        every = np.unique(np.concatenate(rows), axis=0)
        self.names = [name for name, _ in items]
        self.number = dict(number)
        self.owner, self.terms = every[:, 0].astype(np.int64), np.ascontiguousarray(every[:, 1:])
        self.length = (self.terms >= 0).sum(axis=1)

    def ranked(self, frequency: np.ndarray) -> Phrases:
        """Fix the order of intersection: each phrase's offsets from the rarest term on."""
        f = np.where(self.terms >= 0, frequency[self.terms], np.iinfo(np.int64).max)
        self.order = np.argsort(f, axis=1, kind="stable").astype(np.int32)
        return self


class _Index:
    """One block of the index, for a set of phrases."""

    def __init__(self, row: dict, p: Phrases):
        self.starts, self.lens = np.array(row["starts"], np.int64), np.array(row["lens"], np.int64)
        counts = np.frombuffer(row["counts"], np.int32).astype(np.int64)
        self.postings = np.frombuffer(row["postings"], np.int32).astype(np.int64)
        words = row["vocabulary"].split(b" ") if row["vocabulary"] else []
        local = np.full(len(p.number) + 1, -1, np.int64)
        for i, w in enumerate(words):
            t = p.number.get(w)
            if t is not None:
                local[t] = i
        self.local = local
        self.begin = np.concatenate([[0], np.cumsum(counts)])
        self.counts = counts
        # all postings in one sorted array: term, then position
        self.key = (np.repeat(np.arange(len(counts)), counts) << 32) + self.postings

    def nearest(self, term: np.ndarray, at: np.ndarray, slop: int) -> np.ndarray:
        """Is there a posting of ``term`` within ``slop`` of ``at``?"""
        want = (term << 32) + at
        i = np.searchsorted(self.key, want - slop)
        ok = i < len(self.key)
        got = self.key[np.where(ok, i, 0)]
        return ok & (got <= want + slop) & (got >> 32 == term)

    def find(self, p: Phrases, slop: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Phrase and start of each match. slop: each term at most so far from its place, seen from the rarest term."""
        local = np.where(p.terms >= 0, self.local[p.terms], 0)
        alive = np.flatnonzero((local >= 0).all(axis=1))
        found: list[tuple[np.ndarray, np.ndarray]] = []
        if len(alive):
            rare = local[alive, p.order[alive, 0]]
            n = self.counts[rare]
            cuts = np.searchsorted(np.cumsum(n), np.arange(SLICE, n.sum() + SLICE, SLICE))
            for part in np.split(np.arange(len(alive)), np.unique(np.minimum(cuts + 1, len(alive)))):
                if len(part):
                    found.append(self._intersect(p, alive[part], rare[part], local, slop))
        return (np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])) if found else (np.empty(0, np.int64), np.empty(0, np.int64))

    def _intersect(self, p: Phrases, rows: np.ndarray, rare: np.ndarray, local: np.ndarray, slop: int):
        n = self.counts[rare]
        which = np.repeat(rows, n)
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = self.postings[self.begin[np.repeat(rare, n)] + nth] - p.order[which, 0]
        for step in range(1, p.terms.shape[1]):
            offset = p.order[which, step]
            ends = p.terms[which, offset] < 0
            keep = ends | self.nearest(local[which, offset], at + offset, slop)
            which, at = which[keep], at[keep]
            if not len(which):
                break
        return which, at


def _count_terms(p):
    def run(batches):
        number, total = p.value.number, np.zeros(len(p.value.number), np.int64)
        for b in batches:
            for v, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                c = np.frombuffer(c, np.int32)
                for i, w in enumerate(v.split(b" ") if v else []):
                    t = number.get(w)
                    if t is not None:
                        total[t] += c[i]
        has = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(total[has])], names=["term", "n"])

    return run


def _lots(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The test items in lots of about LOT_BYTES."""
    items = items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("item is not null and text is not null")
    size = int(items.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0)
    n = size // LOT_BYTES + 1
    for k in range(n):
        lot = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).distinct().collect()
        yield sorted((r.item, tokens(r.text.encode())) for r in lot)


def _prepared(index: DataFrame, items: list[tuple[str, list[bytes]]], window: int | None):
    """Phrases of one lot with the order of intersection that the corpus counts give, broadcast (bounded by LOT_BYTES)."""
    sc = index.sparkSession.sparkContext
    p = Phrases(items, window)
    frequency = np.zeros(len(p.number) + 1, np.int64)
    counted = index.select("vocabulary", "counts").mapInArrow(_count_terms(sc.broadcast(p)), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    for r in counted.toLocalIterator():
        frequency[r.term] = r.n
    return sc.broadcast(p.ranked(frequency))


def search(index: DataFrame, items: DataFrame, slop: int = 0, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Matches of whole items as phrases: doc_id, item, start (word), exact. Repeated items count once.

    With ``slop`` over 0 also proximity matches: each term lies at most ``slop`` words from its place, counted from
    an occurrence of the item's rarest term. Items or texts that are null, or without words, match nothing. ``start``
    of a proximity match may lie before the document.
    """
    if not 0 <= slop < GAP:
        raise ValueError(f"slop is 0 to {GAP - 1}")
    out = None
    for lot in _lots(items, id_col, text_col):
        by_length: dict[int, list] = defaultdict(list)
        for item in lot:
            by_length[len(item[1]).bit_length()].append(item)
        for like in by_length.values() or [[]]:
            part = index.mapInArrow(_matches(_prepared(index, like, None), slop), "doc_id long, item string, start long, exact boolean")
            out = part if out is None else out.union(part)
    return out


def _matches(p, slop: int):
    kinds = pa.schema([("doc_id", pa.int64()), ("item", pa.string()), ("start", pa.int64()), ("exact", pa.bool_())])

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                ix = _Index(row, p.value)
                which, at = ix.find(p.value, slop)
                exact = np.ones(len(which), bool)
                for step in range(p.value.terms.shape[1]):
                    t = p.value.terms[which, step]
                    exact &= (t < 0) | ix.nearest(np.where(t >= 0, ix.local[t], 0), at + step, 0)
                # the rarest term tells the document: at + its offset is a posting
                doc = np.searchsorted(ix.starts, at + p.value.order[which, 0], side="right") - 1
                ids = [row["ids"][d] for d in doc.tolist()]
                yield pa.RecordBatch.from_pydict({"doc_id": ids, "item": [p.value.names[p.value.owner[w]] for w in which], "start": at - ix.starts[doc], "exact": exact}, schema=kinds)

    return run


def _hits(p):
    """Per document the hit spans and the items."""

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                ix = _Index(row, p.value)
                which, at = ix.find(p.value)
                doc = np.searchsorted(ix.starts, at, side="right") - 1
                width = int(ix.starts[-1] + ix.lens[-1]) + 2
                mark = np.zeros(width, np.int32)
                np.add.at(mark, at, 1)
                np.add.at(mark, at + p.value.length[which], -1)
                mask = np.cumsum(mark) > 0
                names: dict[int, set] = defaultdict(set)
                for d, k in np.unique(np.stack([doc, p.value.owner[which]]), axis=1).T.tolist():
                    names[d].add(p.value.names[k])
                edge = np.diff(mask.astype(np.int8), prepend=0)
                begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                of = np.searchsorted(ix.starts, begins, side="right") - 1
                spans: dict[int, list] = defaultdict(list)
                for d, s, e in zip(of.tolist(), begins.tolist(), ends.tolist(), strict=True):
                    spans[d].append({"s": s - int(ix.starts[d]), "e": e - int(ix.starts[d])})
                n = range(len(row["ids"]))
                out = {"block": [row["block"]] * len(n), "nth": list(n), "doc_id": row["ids"], "n_words": row["lens"], "spans": [spans.get(d, []) for d in n], "items": [sorted(names.get(d, ())) for d in n]}
                yield pa.RecordBatch.from_pydict(out, schema=_HITS)

    return run


_HITS = pa.schema([("block", pa.int64()), ("nth", pa.int32()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))), ("items", pa.list_(pa.string()))])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Which words of each document lie in an occurrence of a benchmark window.

    A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is one window.
    Returns doc_id, n_words, n_hit, spans (hit words from s up to e), items (sorted ids as strings) for every row.
    Null and empty texts have no words and no hits. Items with a null id or text take no part; items with one id
    count as one. Repeated rows are returned each. An empty benchmark gives no hits, an empty table no rows.
    Other columns are not read.
    """
    index = build_index(docs, id_col, text_col)
    kinds = "block long, nth int, doc_id long, n_words long, spans array<struct<s:int,e:int>>, items array<string>"
    lots = [index.mapInArrow(_hits(_prepared(index, lot, window)), kinds) for lot in _lots(benchmark, item_id, item_text)]
    if len(lots) == 1:
        out = lots[0]
    else:
        every = lots[0]
        for lot in lots[1:]:
            every = every.union(lot)
        out = every.groupBy("block", "nth").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    # spans of one lot don't touch; those of several may overlap
    n_hit = F.aggregate("spans", F.struct(F.lit(0).alias("n"), F.lit(-1).alias("to")), lambda a, x: F.struct((a.n + F.greatest(F.lit(0), x.e - F.greatest(x.s, a.to))).alias("n"), F.greatest(a.to, x.e).alias("to")), lambda a: a.n)
    return out.select("doc_id", "n_words", n_hit.cast("long").alias("n_hit"), "spans", "items")


def digest(found: DataFrame) -> DataFrame:
    """The digest columns of ``contamination``."""
    names = F.array_join("items", ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
