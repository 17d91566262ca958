"""Token counts by finite-state transducers, for byte-level BPE vocabularies.

Two transducers are compiled. The first splits text into pre-tokens: fourteen states over twelve character classes,
whose transitions tell whether a pre-token starts at the present or the previous character. It runs in parallel:
text is cut into chunks, the map from entry state to exit state of each chunk is computed for all chunks at once,
the maps are composed by a prefix scan, and then all chunks run from their true entry states.

The second counts the tokens of a pre-token, byte by byte. A token sequence is the one BPE gives exactly if each pair
of neighbours is (Berglund and van der Merwe, 2023), so the last token of each prefix is unique. A state holds the
suffixes that can still grow into a token, the last token before each and how many tokens more or fewer stand
there; a transition is annotated with the change of the token count. States are made when first met, and kept.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.hashing import powers

CHUNK = 256
CHARS = 1 << 21
KNOWN_STATES, KNOWN_PRETOKENS = 150_000, 400_000

# Fixed values of the byte-level pre-tokenizer: the endings that an apostrophe takes with it.
ENDINGS = ("s", "t", "m", "d", "re", "ve", "ll")

(SPACE, WHITE, LETTER, DIGIT, OTHER, QUOTE, ENDS, R, E, V, L, STOP) = range(12)
(FRESH, IN_L, IN_N, IN_O, SP, WS, SPS, WSS, Q, Q_R, Q_V, Q_L, DONE) = range(13)
STATES, CLASSES = 13, 12
#: Output of a transition: a pre-token starts at this character, at the one before.
HERE, BACK = 1, 2


@functools.cache
def character_classes() -> np.ndarray:
    """Class of each code point."""
    every = "".join(map(chr, range(0x110000)))
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (DIGIT, r"\p{N}"), (WHITE, r"\p{White_Space}")):
        for m in regex.finditer(f"{pattern}+", every):
            out[m.start() : m.end()] = kind
    out[ord(" ")], out[ord("'")] = SPACE, QUOTE
    for c in "stmd":
        out[ord(c)] = ENDS
    out[ord("r")], out[ord("e")], out[ord("v")], out[ord("l")] = R, E, V, L
    return out


@functools.cache
def pretoken_transducer() -> tuple[np.ndarray, np.ndarray]:
    """Next state and output for state * CLASSES + class."""
    letters = {LETTER, ENDS, R, E, V, L}

    def from_closed(c: int) -> tuple[int, int]:
        """After the end of a pre-token."""
        if c in letters:
            return IN_L, HERE
        return {DIGIT: IN_N, OTHER: IN_O, QUOTE: Q, SPACE: SP, WHITE: WS, STOP: FRESH}[c], HERE

    def joined(c: int) -> tuple[int, int]:
        """After a space that the next pre-token takes."""
        return (IN_L if c in letters else IN_N if c == DIGIT else FRESH if c == STOP else IN_O), HERE if c == STOP else 0

    def step(s: int, c: int) -> tuple[int, int]:
        if s == IN_L and c in letters or s == IN_N and c == DIGIT or s == IN_O and c in (OTHER, QUOTE):
            return s, 0
        if s in (SP, WS, SPS, WSS):
            if c in (SPACE, WHITE):
                return (SPS if c == SPACE else WSS), 0
            if c == STOP or s == WS:
                return from_closed(c)
            if s == WSS:
                to, out = from_closed(c)
                return to, out | BACK
            to, out = joined(c)
            return to, out | (BACK if s == SPS else 0)
        if s == Q:
            if c in (ENDS, R, V, L):
                return {ENDS: DONE, R: Q_R, V: Q_V, L: Q_L}[c], 0
            if c in (OTHER, QUOTE):
                return IN_O, 0
        if s in (Q_R, Q_V, Q_L):
            if c == (L if s == Q_L else E):
                return DONE, 0
            to, out = (IN_L, 0) if c in letters else from_closed(c)
            return to, out | BACK
        return from_closed(c)

    table = [step(s, c) for s in range(STATES) for c in range(CLASSES)]
    return np.array([t for t, _ in table], np.uint8), np.array([o for _, o in table], np.uint8)


def entry_states(columns: np.ndarray) -> np.ndarray:
    """Entry state of each chunk, the chunks being one text: state maps and a prefix scan.

    ``columns`` [CHUNK, chunks] are the classes. A chunk whose map has become constant is stepped from one state.
    """
    to, _ = pretoken_transducer()
    n = columns.shape[1]
    maps = np.tile(np.arange(STATES, dtype=np.uint8)[:, None], (1, n))
    lead = min(8, len(columns))
    for t in range(lead):
        maps = to.take(maps * np.uint8(CLASSES) + columns[t])
    constant = (maps == maps[0]).all(axis=0)
    one, many, rest = maps[0], maps[:, ~constant], np.flatnonzero(~constant)
    for t in range(lead, len(columns)):
        one = to.take(one * np.uint8(CLASSES) + columns[t])
        if len(rest):
            many = to.take(many * np.uint8(CLASSES) + columns[t, rest])
    maps[:] = one
    maps[:, rest] = many
    step = 1
    while step < n:  # the map of chunk i becomes that of chunks 0 to i
        maps[:, step:] = np.take_along_axis(maps[:, step:], maps[:, :-step].astype(np.intp), axis=0)
        step *= 2
    return np.concatenate([[FRESH], maps[FRESH, :-1]]).astype(np.uint8)


def pretoken_starts(classes: np.ndarray) -> np.ndarray:
    """Places where pre-tokens start, in a text given as classes that ends with STOP."""
    to, out = pretoken_transducer()
    n = -(-len(classes) // CHUNK)
    padded = np.full(n * CHUNK, STOP, np.uint8)
    padded[: len(classes)] = classes
    columns = np.ascontiguousarray(padded.reshape(n, CHUNK).T)
    state = entry_states(columns)
    found = np.empty((CHUNK, n), np.uint8)
    for t in range(CHUNK):
        at = state * np.uint8(CLASSES) + columns[t]
        found[t] = out.take(at)
        state = to.take(at)
    found = found.T.reshape(-1)
    here = (found & HERE).astype(bool)
    here[:-1] |= (found[1:] & BACK).astype(bool)
    return np.flatnonzero(here[: len(classes)])


class BpeTransducer:
    """Counts the tokens of a pre-token; made from the merges, in their order."""

    def __init__(self, merges: list[tuple[bytes, bytes]]):
        self.rank = {m: i for i, m in enumerate(merges)}
        self.tokens = {bytes([b]) for b in range(256)} | {a + b for a, b in merges}
        self.inner = {t[:i] for t in self.tokens for i in range(len(t))}
        self.fits: dict = {}
        self.clear()

    def clear(self) -> None:
        start = ((b"", None, 0),)
        self.numbers, self.states = {start: 0}, [start]
        self.moves: list[dict[int, tuple[int, int]]] = [{}]

    def merge(self, word: bytes) -> list[bytes]:
        """Tokens of a short word, by merging."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 30))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def neighbours(self, a: bytes, b: bytes) -> bool:
        """Can ``b`` follow ``a`` in a tokenization?"""
        if (known := self.fits.get((a, b))) is None:
            if len(self.fits) > 4 * KNOWN_STATES:
                self.fits.clear()
            known = self.fits[a, b] = self.merge(a + b) == [a, b]
        return known

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        """Transition from a state: next state, change of the token count."""
        alive, last, n = [], None, 0
        for suffix, before, ahead in self.states[state]:
            s = suffix + bytes([byte])
            if last is None and s in self.tokens and (before is None or self.neighbours(before, s)):
                last, n = s, ahead + 1
            if s in self.inner:
                alive.append((s, before, ahead))
        new = (*((s, before, ahead - n) for s, before, ahead in alive), (b"", last, 0))
        if (to := self.numbers.get(new)) is None:
            to = self.numbers[new] = len(self.states)
            self.states.append(new)
            self.moves.append({})
        self.moves[state][byte] = to, n
        return to, n

    def count(self, word: bytes) -> int:
        if len(self.states) > KNOWN_STATES:
            self.clear()
        state = total = 0
        moves = self.moves
        for b in word:
            move = moves[state].get(b)
            if move is None:
                move = self.compile(state, b)
            state, n = move
            total += n
        return total


class TokenCounter(dict):
    """Compiled vocabulary. As a dictionary: token counts of pre-tokens, a bounded number of them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec.get("normalizer"):
            raise ValueError("only byte-level BPE without a normalizer is compiled")
        # the printable stand-ins of bytes: printable ones for themselves, the others from U+0100 on, in order
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.transducer = BpeTransducer([tuple(bytes(byte[c] for c in x) for x in m) for m in pairs])
        special = sorted((t["content"] for t in spec.get("added_tokens", ())), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None

    def __missing__(self, word: str) -> int:
        n = self.transducer.count(word.encode("utf-8"))
        if len(self) < KNOWN_PRETOKENS:
            self[word] = n
        return n

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text, special strings in it being one token each."""
        out, lot, size = np.zeros(len(texts), np.int64), [], 0
        for i, t in enumerate(texts):
            parts = [t] if self.special is None else self.special.split(t)
            out[i] = len(parts) - 1
            for p in parts:
                if p:
                    lot.append((i, p))
                    size += len(p)
            if size >= CHARS:
                self._add(lot, out)
                lot, size = [], 0
        if lot:
            self._add(lot, out)
        return out

    def _add(self, lot: list[tuple[int, str]], out: np.ndarray) -> None:
        text = "\0".join(p for _, p in lot) + "\0"
        ends = np.cumsum([len(p) + 1 for _, p in lot]) - 1
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        classes = character_classes().take(codes.astype(np.intp))
        classes[ends] = STOP
        starts = pretoken_starts(classes)
        # pre-tokens that occur again in the lot are looked up once: a hash proposes the first equal one, the characters decide
        edges = np.append(starts, len(text))
        lens = np.diff(edges)
        total = np.zeros(len(text) + 1, np.uint64)
        up, down = powers(len(text))
        np.cumsum((codes + np.uint64(1)) * down, out=total[1:])
        h = (total[edges[1:]] - total[starts]) * up[starts] + lens.astype(np.uint64)
        _, first, back = np.unique(h, return_index=True, return_inverse=True)
        like = first[back]
        other = lens[like] != lens
        like[other] = np.flatnonzero(other)
        at = np.arange(len(text)) + np.repeat(starts[like] - starts, lens)
        other |= np.add.reduceat(codes != codes[at], starts) > 0
        alone = np.flatnonzero(other)
        get = lambda which: np.fromiter(map(self.__getitem__, [text[i:j] for i, j in zip(starts[which].tolist(), edges[which + 1].tolist(), strict=True)]), np.int64, len(which))
        counts = get(first)[back]
        counts[alone] = get(alone)
        counts[np.isin(starts, ends, assume_unique=True)] = 0  # the stops themselves
        total = np.concatenate([[0], np.cumsum(counts)])
        upto = total[np.searchsorted(starts, ends)]
        np.add.at(out, [i for i, _ in lot], np.diff(upto, prepend=0))


@functools.lru_cache(maxsize=2)
def compiled(path: str) -> TokenCounter:
    """One compiled vocabulary for each worker process."""
    return TokenCounter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every text, as the vocabulary file's own library counts them, without begin, end or added tokens.

    ``path`` names a byte-level BPE file that every executor has. Returns doc_id, n_bytes (UTF-8), n_tokens,
    over_limit. A null text counts as empty: 0 bytes, 0 tokens. Whole texts are counted, whatever their length.
    Repeated rows are returned each, null ids as they are; an empty table gives an empty result. Other columns are
    not read. One pass without a shuffle.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = compiled(path)
        for b in batches:
            n = counter.count([t if isinstance(t, str) else "" for t in b["text"].tolist()])
            yield pd.DataFrame({"doc_id": b["id"], "n_bytes": b["n_bytes"], "n_tokens": n, "over_limit": n > limit})

    made = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    kind = made.schema["id"].dataType.simpleString()
    return made.mapInPandas(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
