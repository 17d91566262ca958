"""Repair of the structure of conversations by a Viterbi search whose survivors coalesce.

Turns are kept, given another role, deleted or inserted, so that the roles' initials read ``(s?(ua)+)?`` at the least
cost. The states of the search say what the repaired turns so far end with: nothing, ``s``, ``u`` or ``a``. Each
state's survivor is its cheapest sequence of edits, of equal ones the least in ASCII. Survivors are the leaves of a tree of
edits; nodes count the references to them, and what all survivors have in common is emitted at once, so that only
unresolved suffixes are held, a byte an edit. A survivor that costs more than another one and the edits that would take
this one's place goes at once (``TAKES``).

Ties are decided on the complete suffixes: two survivors have dealt with the same turns, and a turn's edit ends each,
so neither is a prefix of the other, and their order never changes as edits are added. So an order number for each
survivor says how its whole suffix compares. Costs relative to the cheapest, and the order, make a step of few distinct
kinds, each worked out once.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import partitions, save
from readloom.llm.ordered import running

NONE, S, U, A = range(4)
NEXT = {(NONE, "s"): S, (NONE, "u"): U, (S, "u"): U, (A, "u"): U, (U, "a"): A}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Edits at the end that complete each state's sequence.
TAIL = {NONE: "", S: "II", U: "I", A: ""}
#: From state x the rest costs at most ``TAKES[x][y]`` more than from y: insert what lacks; an ``s`` that only y takes is deleted.
TAKES = {NONE: {S: 0, U: 3, A: 0}, S: {NONE: 6, U: 3, A: 6}, U: {NONE: 7, S: 3, A: 3}, A: {NONE: 4, S: 0, U: 3}}
#: A turn as one letter: its role's initial (s, u, a, another), times 3, plus 0 sound, 1 truncated, 2 to be deleted.
INITIALS = "sua-"
LETTERS = "abcdefghijkl"
#: Turns a packed row holds, and edits an emitted row.
PACK = 4096
SPACE = " \t\n\x0b\x0c\r"


def _moves(letter: str) -> dict[int, dict[int, tuple[int, str]]]:
    """For each state the best edits of one turn, with inserts before it, to each next state: cost, edits."""
    initial, kind = INITIALS[LETTERS.index(letter) // 3], LETTERS.index(letter) % 3
    out: dict = {}
    for first in range(4):
        best: dict[int, tuple[int, str]] = {}
        state, cost, before = first, 0, ""
        for _ in range(3):
            options = [(state, DELETE, "D")]
            if kind < 2:
                options += [(NEXT.get((state, initial)), KEEP + TRUNCATED * kind, "K")]
                options += [(NEXT.get((state, r)), REROLE + TRUNCATED * kind, "R") for r in "ua"]
            for to, c, edit in options:
                if to is not None:
                    best[to] = min(best.get(to, (99, "")), (cost + c, before + edit))
            state, cost, before = NEXT.get((state, "u"), A), cost + INSERT, before + "I"
        out[first] = best
    return out


MOVES = {x: _moves(x) for x in LETTERS}


def _step(survivors: tuple, letter: str) -> tuple:
    """Survivors (state, cost, order) after one more turn: their new ones, what all now cost more, (parent, edits) of each."""
    best: dict[int, tuple] = {}
    for parent, (state, cost, order) in enumerate(survivors):
        for to, (c, edits) in MOVES[letter][state].items():
            found = (cost + c, order, edits, parent)
            if to not in best or found < best[to]:
                best[to] = found
    alive = {x: f for x, f in best.items() if not any(y != x and g[0] + TAKES[y][x] < f[0] for y, g in best.items())}
    least = min(f[0] for f in alive.values())
    states = sorted(alive)
    order = {x: k for k, x in enumerate(sorted(states, key=lambda x: alive[x][1:3]))}
    return tuple((x, alive[x][0] - least, order[x]) for x in states), least, [(alive[x][3], alive[x][2]) for x in states]


_STEPS: dict = {}


class _Node:
    """Edits that follow those of ``parent``; ``refs`` nodes or survivors follow these."""

    __slots__ = ("parent", "edits", "refs")

    def __init__(self, parent, edits: bytes):
        self.parent, self.edits, self.refs = parent, bytearray(edits), 1


class Search:
    """The cheapest edits of one conversation, turn by turn; ``take`` gives those on which all survivors agree."""

    def __init__(self):
        self.survivors, self.leaves, self.cost = ((NONE, 0, 0),), [_Node(None, b"")], 0

    def turns(self, letters: str) -> None:
        for x in letters:
            step = _STEPS.get((self.survivors, x))
            if step is None:
                step = _STEPS[self.survivors, x] = _step(self.survivors, x)
            self.survivors, more, moves = step
            self.cost += more
            if len(moves) == len(self.leaves) == 1:
                self.leaves[0].edits += moves[0][1].encode()
            else:
                self._branch(moves)

    def _branch(self, moves: list[tuple[int, str]]) -> None:
        times = [0] * len(self.leaves)
        for p, _ in moves:
            times[p] += 1
        new = []
        for p, edits in moves:
            old = self.leaves[p]
            if times[p] == 1:
                old.edits += edits.encode()
                new.append(old)
            else:
                old.refs = times[p]
                new.append(_Node(old, edits.encode()))
        for old, n in zip(self.leaves, times, strict=True):
            while n == 0 and (old := old.parent):  # nobody follows: one reference less to what it followed
                old.refs -= 1
                n = old.refs
        self.leaves = new
        self._merge()

    def _merge(self) -> None:
        """A node with one follower becomes one with it, unless it is the root: that is emitted."""
        above = {n: n.parent for leaf in self.leaves for n in self._up(leaf)}
        for n, parent in above.items():
            while parent is not None and parent.refs == 1 and parent.parent is not None:
                n.edits = parent.edits + n.edits
                n.parent = parent = parent.parent

    @staticmethod
    def _up(node):
        while node is not None:
            yield node
            node = node.parent

    def take(self) -> bytes:
        """The edits that all survivors share, once."""
        out = bytearray()
        while True:
            roots = {id(r): r for leaf in self.leaves for *_, r in [tuple(self._up(leaf))]}
            (root,) = roots.values()
            out += root.edits
            root.edits = bytearray()
            if root.refs > 1 or root in self.leaves:
                return bytes(out)
            for leaf in self.leaves:
                for n in self._up(leaf):
                    if n.parent is root:
                        n.parent = None

    def end(self) -> bytes:
        """The rest of the edits, of the cheapest complete survivor; ``cost`` is then that of all."""
        cost, _, k = min((c + INSERT * len(TAIL[s]), order, k) for k, (s, c, order) in enumerate(self.survivors))
        self.cost += cost
        rest = b"".join(bytes(n.edits) for n in reversed(list(self._up(self.leaves[k]))))
        return rest + TAIL[self.survivors[k][0]].encode()

    def held(self) -> int:
        """Edits in memory."""
        return sum(len(n.edits) for n in {id(n): n for leaf in self.leaves for n in self._up(leaf)}.values())


_EDITS = pa.schema([("conv_id", pa.int64()), ("n", pa.int64()), ("edits", pa.string()), ("cost", pa.int64()), ("illegal", pa.int64())])


def _edits(batches):
    """Edits of each conversation, from its packed turns: rows in order, the last with cost and illegal pairs."""
    search, now, done, illegal, last, buffer, out = None, None, 0, 0, "", bytearray(), []

    def emit(final: bool):
        nonlocal done, buffer
        out.append((now[0], done, buffer.decode(), search.cost if final else None, illegal if final else None))
        done, buffer = done + len(buffer) - buffer.count(b"I"), bytearray()

    for b in batches:
        for conv, letters in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if now != (conv,):
                if search:
                    buffer += search.end()
                    emit(True)
                search, now, done, illegal, last = Search(), (conv,), 0, 0, ""
            search.turns(letters)
            initials = last + "".join(INITIALS[LETTERS.index(x) // 3] for x in letters)
            illegal += sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:]))
            last = initials[-1]
            buffer += search.take()
            if len(buffer) >= PACK:
                emit(False)
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(_EDITS.names, r, strict=True)) for r in out], schema=_EDITS)
            out.clear()
    if search:
        buffer += search.end()
        emit(True)
        yield pa.RecordBatch.from_pylist([dict(zip(_EDITS.names, r, strict=True)) for r in out], schema=_EDITS)


_REPAIRED = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
NAMES = {"u": "user", "a": "assistant"}


def _apply(batches):
    """Turns and edits of each conversation in order (conv_id, edits, role, text; edits come before their turns) as edited turns."""
    now, state, place, edits, at, out, size = None, NONE, 0, "", 0, [], 0

    def inserts():
        nonlocal at, state, place
        while at < len(edits) and edits[at] == "I":
            r = "a" if state == U else "u"
            state = NEXT[state, r]
            out.append((now[0], place, "I", NAMES[r], ""))
            at, place = at + 1, place + 1

    def batch():
        return pa.RecordBatch.from_pylist([dict(zip(_REPAIRED.names, r, strict=True)) for r in out], schema=_REPAIRED)

    for b in batches:
        for conv, more, role, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if now != (conv,):
                inserts()
                now, state, place, edits, at = (conv,), NONE, 0, "", 0
            if more is not None:
                edits, at = edits[at:] + more, 0
                continue
            inserts()
            edit = edits[at]
            if edit == "R":
                r = "a" if state == U else "u"
                role = NAMES[r]
            else:
                r = role[:1]
            out.append((now[0], place, edit, *((None, None) if edit == "D" else (role, text))))
            state = state if edit == "D" else NEXT[state, r]
            at, place, size = at + 1, place + 1, size + len(text)
            if len(out) >= 4096 or size >= 1 << 22:
                yield batch()
                out.clear()
                size = 0
    if now:
        inserts()
    if out:
        yield batch()


_DIGEST = pa.schema([("conv_id", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])


def _digest(batches):
    """Edits' initials, and SHA-256 of the repaired turns, of each conversation of ``_apply``."""
    now, sha, audit, lines, out = None, None, [], 0, []

    def rows():
        return pa.RecordBatch.from_pylist([dict(zip(_DIGEST.names, r, strict=True)) for r in out], schema=_DIGEST)

    for b in batches:
        for conv, _, edit, role, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if now != (conv,):
                if now:
                    out.append((now[0], "".join(audit), sha.hexdigest()))
                now, sha, audit, lines = (conv,), hashlib.sha256(), [], 0
            audit.append(edit)
            if edit != "D":
                sha.update(("\n" * (lines > 0) + f"{role}:{text}").encode())
                lines += 1
        if out:
            yield rows()
            out.clear()
    if now:
        out.append((now[0], "".join(audit), sha.hexdigest()))
        yield rows()


def damage(conversations: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text) with damage by crc32(``conv_id:turn``) % 20; nulls are one space, in this key too.

    0 drops a turn, 1 empties its text, 2 takes its ``.``, ``!`` and ``?``, 3 repeats it, 4 makes its role ``user``.
    """
    one = F.lit(" ")
    kind = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), one), F.lit(":"), F.coalesce(F.col("turn").cast("string"), one))) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", one).alias("role"), F.coalesce("text", one).alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.where("kind <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def ordered(turns: DataFrame) -> DataFrame:
    """Turns, saved, with ``x`` (hash of role and text) and ``n``, their place by turn (null first), role, text (64 characters, then ``x``)."""
    keyed = turns.select("conv_id", "turn", "role", "text", F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))).alias("x"))
    return running(keyed, "conv_id", [F.col("turn").asc_nulls_first(), F.col("role"), F.substring("text", 1, 64), F.col("x")], "repair-turns")


def faults(placed: DataFrame) -> DataFrame:
    """conv_id, turn, n, initial and fault (null, blank, duplicate or truncated) of each turn of ``ordered``; without texts.

    A turn is a duplicate if its role and text stand earlier in the conversation; of texts and roles that recur, only
    the first place is joined back.
    """
    end = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = F.when(end == "", "blank").when(~F.substring(end, -1, 1).isin(".", "!", "?"), "truncated")
    slim = placed.select("conv_id", "turn", "n", F.substring("role", 1, 1).alias("initial"), fault.alias("own"), "x")
    again = slim.groupBy(F.col("conv_id").alias("c"), F.col("x").alias("y")).agg(F.min("n").alias("first"), F.count("*").alias("k")).where("k > 1").drop("k")
    both = slim.join(again, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("x") == F.col("y")), "left")
    return both.select("conv_id", "turn", "n", "initial", F.when(F.col("own") == "blank", "blank").when(F.col("n") > F.col("first"), "duplicate").otherwise(F.col("own")).alias("fault"))


def edits(found: DataFrame) -> DataFrame:
    """The cheapest edits of the turns of ``faults``: conv_id, n (first turn of a row's edits), edits; cost and illegal in the last row.

    Turns reach the search as letters, PACK of them a row.
    """
    kind = F.when(F.col("fault").isin("blank", "duplicate"), 2).when(F.col("fault") == "truncated", 1).otherwise(0)
    at = F.when(F.col("initial") == "s", 0).when(F.col("initial") == "u", 1).when(F.col("initial") == "a", 2).otherwise(3)
    letters = found.select("conv_id", "n", F.substring(F.lit(LETTERS), (3 * at + kind + 1).cast("int"), F.lit(1)).alias("letter"))
    chunks = letters.groupBy("conv_id", (F.col("n") / PACK).cast("long").alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("n", "letter"))).alias("t"))
    packed = chunks.select("conv_id", F.array_join("t.letter", "").alias("letters"), "chunk").repartition(partitions(found.sparkSession), "conv_id").sortWithinPartitions("conv_id", "chunk")
    return packed.select("conv_id", "letters").mapInArrow(_edits, "conv_id long, n long, edits string, cost long, illegal long")


def _edited(placed: DataFrame, found: DataFrame) -> DataFrame:
    null = lambda kind: F.lit(None).cast(kind)
    turns = placed.select("conv_id", "n", F.lit(1).alias("after"), null("string").alias("edits"), "role", "text")
    both = found.select("conv_id", "n", F.lit(0).alias("after"), "edits", null("string").alias("role"), null("string").alias("text")).union(turns)
    dealt = both.repartition(partitions(placed.sparkSession), "conv_id").sortWithinPartitions("conv_id", "n", "after")
    return dealt.select("conv_id", "edits", "role", "text").mapInArrow(_apply, "conv_id long, place long, edit string, role string, text string")


def repaired(turns: DataFrame) -> DataFrame:
    """The turns of each conversation after the cheapest edits: conv_id, place, edit (K, R, D, I), role, text (both null for D)."""
    placed = ordered(turns)
    return _edited(placed, save(edits(faults(placed)), "repair-edits"))


def _count(fault: str) -> Column:
    return F.count(F.when(F.col("fault") == fault, 1)).alias(fault)


def audit(conversations: DataFrame, turns: DataFrame) -> DataFrame:
    """What repairing ``turns`` takes, for each conv_id of ``conversations``: see the columns of op13.

    Roles count by their first character. A null conv_id is a conversation of its own; empty tables give none. Turns of
    one number stand by role, then the text's first 64 characters, then a hash of both; repeated rows are duplicates.
    A conversation without turns has zeros, an empty audit and the hash of nothing. Other columns are not read. Memory:
    a conversation's unresolved edits, one turn's text, and its audit, which is one cell by contract; one task hashes a
    conversation's text, streaming.
    """
    placed = ordered(turns)
    found = save(faults(placed), "repair-faults")
    made = save(edits(found), "repair-edits")
    by_turn = found.groupBy("conv_id", "turn").agg(*(_count(x) for x in ("blank", "duplicate", "truncated")))
    sums = [F.sum(x).alias(x) for x in ("blank", "duplicate", "truncated")]
    counts = by_turn.groupBy("conv_id").agg(*sums, F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
    texts = _edited(placed, made).mapInArrow(_digest, "conv_id long, audit string, repaired_sha256 string")
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    every = ids.unionByName(counts, allowMissingColumns=True).unionByName(made.where("cost is not null").select("conv_id", "cost", "illegal"), allowMissingColumns=True).unionByName(texts, allowMissingColumns=True)
    none = {x: F.lit(0) for x in names} | {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256(b"").hexdigest())}
    out = every.groupBy("conv_id").agg(*(F.max(x).alias(x) for x in names)).select("conv_id", *(F.coalesce(F.col(x), none[x]).alias(x) for x in names))
    return out
