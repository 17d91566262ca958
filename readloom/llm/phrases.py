"""Removal of repeated passages by phrase automata.

Every repeated window of ``window`` words holds a phrase of ``phrase`` words that is the smallest (by hash) of the
window's phrases, at the same place in each copy. These phrases, about a fifteenth of all, are compared over the
corpus word by word; those that occur again are confirmed. A block of documents (some megabytes of text, never a part
of a document) is a shard: its Aho-Corasick automaton is compiled from the confirmed phrases that the corpus returns
to it, and every text of the block is streamed through it to locate every occurrence. The windows around the
occurrences are then counted over the corpus by 96-bit hashes, and the words of recurring windows go.

Nothing is broadcast. A phrase or window goes through a shuffle once for each block that holds it, so copies, however
many, are spread over the blocks; what returns to a block is bounded by the block's own words.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.blocks import block_texts, bucket_bits, count_over_blocks, from_planes, planes, save_blocks, sent
from readloom.llm.common import partitions
from readloom.llm.hashing import WordHashes, grams, mix, sliding_min

TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def _lowest(g: np.ndarray, span: int) -> np.ndarray:
    """The places whose phrase is the smallest of some window."""
    low = sliding_min(g, span)
    padded = np.concatenate([np.full(span - 1, TOP), ~low, np.full(span - 1, TOP)])
    best = ~sliding_min(padded, span)  # the greatest of the minima of the windows over a place
    return np.flatnonzero(g == best)


def _packed(phrases: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(b"\n".join(phrases)) if phrases else b""


def _unpacked(data: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(data).split(b"\n") if data else []


_SENT = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("once", pa.binary()), ("many", pa.binary())])


def _phrases(phrase: int, window: int, bits: int):
    """The phrases that a block's windows are known by, as words joined by a space, packed by bucket (leading bits of
    a hash): those that it has once, and those that it has more often."""

    def run(batches):
        known = WordHashes()
        for b in batches:
            for block, lens, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
                more: dict[bytes, bool] = {}
                for t in block_texts(blob, lens):
                    w = (t or b"").split()
                    if len(w) >= window:
                        for p in _lowest(grams(known.of(w), phrase), window - phrase + 1).tolist():
                            key = b" ".join(w[p : p + phrase])
                            more[key] = key in more
                buckets: dict[int, tuple[list, list]] = {}
                for key in sorted(more):
                    buckets.setdefault(xxhash.xxh3_64_intdigest(key) >> (64 - bits), ([], []))[more[key]].append(key)
                names = sorted(buckets)
                yield pa.RecordBatch.from_pydict({"bucket": names, "block": [block] * len(names), "once": [_packed(buckets[k][0]) for k in names], "many": [_packed(buckets[k][1]) for k in names]}, schema=_SENT)

    return run


def _recurring(batches):
    """Bucket after bucket (rows sorted by it): for each block those of its phrases that occur again."""

    def bucket(rows: list[tuple]):
        each = [(block, _unpacked(once), _unpacked(many)) for block, once, many in rows]
        seen: set[bytes] = set()
        again: set[bytes] = set()
        for _, once, many in each:
            again.update(p for p in once if p in seen)
            again.update(many)
            seen.update(once)
        out = [(block, _packed([p for p in (*once, *many) if p in again])) for block, once, many in each]
        out = [x for x in out if x[1]]
        if out:
            yield pa.RecordBatch.from_pydict({"block": [x[0] for x in out], "phrases": [x[1] for x in out]}, schema=pa.schema([("block", pa.int64()), ("phrases", pa.binary())]))

    now, rows = None, []
    for b in batches:
        for k, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if k != now and rows:
                yield from bucket(rows)
                rows = []
            now = k
            rows.append(tuple(row))
    if rows:
        yield from bucket(rows)


def automaton(phrases: list[bytes]) -> ahocorasick.Automaton:
    """The automaton of phrases between spaces, over bytes (as the characters of the same number)."""
    machine = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for p in phrases:
        machine.add_word(f" {p.decode('latin-1')} ")
    machine.make_automaton()
    return machine


def occurrences(machine: ahocorasick.Automaton, words: list[bytes], phrase: int) -> np.ndarray:
    """Places (word numbers) at which a phrase of the automaton starts in a text."""
    if not len(machine):
        return np.empty(0, np.int64)
    line = b" " + b" ".join(words) + b" "
    ends = [e for e, _ in machine.iter(line.decode("latin-1"))]
    spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    return np.searchsorted(spaces, ends) - phrase


def _window_hashes(h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """96 bits of each window."""
    return grams(h, window), (grams(mix(h ^ np.uint64(0xA0761D6478BD642F)), window) >> np.uint64(32)).astype(np.uint32)


def _locate(phrase: int, window: int, bits: int):
    """Stream a block's texts through its automaton; the hashes of the windows whose smallest phrase was found."""

    def run(batches):
        known, span = WordHashes(), window - phrase + 1
        for b in batches:
            for block, lens, blob, again in zip(*(c.to_pylist() for c in b.columns), strict=True):
                machine, found = automaton([p for x in again for p in _unpacked(x)]), []
                for t in block_texts(blob, lens):
                    w = (t or b"").split()
                    at = occurrences(machine, w, phrase)
                    if len(w) < window or not len(at):
                        continue
                    h = known.of(w)
                    g = grams(h, phrase)
                    hit = np.full(len(g), TOP)
                    hit[at] = g[at]
                    keep = sliding_min(hit, span) == sliding_min(g, span)
                    found.append([x[keep] for x in _window_hashes(h, window)])
                if found:
                    one, two = (np.concatenate([f[i] for f in found]) for i in (0, 1))
                    order = np.lexsort((two, one))
                    one, two = one[order], two[order]
                    first = np.flatnonzero(np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])])) if len(one) else np.empty(0, np.int64)
                    yield sent(block, one[first], two[first], np.diff(np.append(first, len(one))), bits, 8)

    return run


def _again(h: np.ndarray, total: np.ndarray) -> bytes:
    return planes(h[total > 1], 8)


def covered(words: list[bytes], h: np.ndarray, again: np.ndarray, window: int) -> np.ndarray:
    """Which words lie in a window whose hash is in ``again`` (sorted)."""
    mark = np.zeros(len(words) + 1, np.int32)
    g = grams(h, window)
    if len(g) and len(again):
        at = np.searchsorted(again, g)
        at[at == len(again)] = 0
        starts = np.flatnonzero(again[at] == g)
        np.add.at(mark, starts, 1)
        np.add.at(mark, starts + window, -1)
    return np.cumsum(mark[:-1]) > 0


def _remove(window: int, with_text: bool):
    def run(batches):
        known = WordHashes()
        for b in batches:
            for ids, lens, blob, got in zip(*(c.to_pylist() for c in b.columns), strict=True):
                again = np.sort(np.concatenate([from_planes(x, 8) for x in got])) if got else np.empty(0, np.uint64)
                out = {"doc_id": ids, "n_words": [], "n_removed": [], "kept_sha256": []} | ({"kept_text": []} if with_text else {})
                for t in block_texts(blob, lens):
                    w = (t or b"").split()
                    n, gone = len(w), 0
                    if n >= window and len(again):
                        mask = covered(w, known.of(w), again, window)
                        gone = int(mask.sum())
                        if gone:
                            w = [x for x, m in zip(w, mask.tolist(), strict=True) if not m]
                    kept = b" ".join(w)
                    out["n_words"].append(n)
                    out["n_removed"].append(gone)
                    out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                    if with_text:
                        out["kept_text"].append(None if t is None else kept.decode())
                kinds = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())] + ([("kept_text", pa.string())] if with_text else [])
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema(kinds))

    return run


def _recurring_windows(blocks: DataFrame, phrase: int, window: int) -> DataFrame:
    """Per block the hashes of its windows that occur again anywhere: block, got."""
    texts = blocks.select("block", "lens", "blob")
    bits = bucket_bits(blocks)
    each = texts.mapInArrow(_phrases(phrase, window, bits), "bucket long, block long, once binary, many binary")
    dealt = each.repartition(partitions(blocks.sparkSession), "bucket").sortWithinPartitions("bucket", "block")
    confirmed = dealt.mapInArrow(_recurring, "block long, phrases binary").groupBy("block").agg(F.collect_list("phrases").alias("again"))  # at most the block's own
    found = texts.join(confirmed, "block").select("block", "lens", "blob", "again").mapInArrow(_locate(phrase, window, bits), "bucket long, block long, hashes binary, check binary, n binary")
    return count_over_blocks(found, 8, _again)


def remove_repeats(docs: DataFrame, window: int = 35, phrase: int = 8, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Remove every word that lies in a window of ``window`` words whose sequence starts anywhere else too.

    Words are separated by white space (space, tab to carriage return) and compared unchanged. Windows are judged on
    the input. Returns doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by a space) and, if asked
    for, kept_text. Null texts have no words (kept_text null); texts of fewer than ``window`` words lose nothing.
    Repeated rows are copies of each other, and each is returned. Rows with a null id count like any other. An empty
    table gives an empty result. Other columns are not read.

    Phrases are compared by their words, windows with a confirmed phrase by 96-bit hashes.
    """
    if not 0 < phrase <= window:
        raise ValueError("a phrase is at least one word and no longer than a window")
    blocks = save_blocks(docs, id_col, text_col, "phrase-blocks")
    again = _recurring_windows(blocks, phrase, window)
    kept = blocks.select("block", "ids", "lens", "blob").join(again, "block", "left").select("ids", "lens", "blob", "got")
    return kept.mapInArrow(_remove(window, with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else ""))
