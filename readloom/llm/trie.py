"""Prefix trie of conversations, with totals of its subtrees by a rollup over bands of depths.

A node is a distinct sequence of first turns. It is named by its depth and 128 bits: the XOR, over its turns, of hashes
of place and turn, which a scan finds however long a conversation is. Totals of subtrees: each node adds its values to
its ancestors within its band of ``HEIGHT`` depths only. The bands' roots, with what their bands gave them, are a tree of
their own, ``HEIGHT`` times lower, whose totals are found in the same way; a completed root then adds its total to its
ancestors in the band above. So a node is copied ``HEIGHT`` times at most and the rounds grow with the logarithm of the
depth.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import discard, partitions, save
from readloom.llm.ordered import running

HEIGHT = 16
KEY = ["depth", "k1", "k2"]
#: Ids that one row of text holds while the ids of a node are joined.
CHUNK = 1 << 14


def rebuilt(conversations: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """Each conversation's rebuilt turns: conv_id, depth (from 1), x (hash of role and text), points (of the text); and its depth 0.

    Conversation c begins with the first h turns of conversation c - c % ``every``, where h = crc32(c) % ``most``, and
    goes on with its own turns after its first h.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    slim = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.substring(text, 1, 64).alias("head"), F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("x"), F.length(text).cast("long").alias("points"))
    own = running(slim, "conv_id", [F.col("turn").asc_nulls_first(), F.col("role"), F.col("head"), F.col("x")], "trie-turns")
    leader = F.col("conv_id") - F.col("conv_id") % every
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    leads = own.where(F.col("conv_id") % every == 0).where(F.col("n") < most - 1).groupBy(F.col("conv_id").alias("leader")).agg(F.sort_array(F.collect_list(F.struct("n", "x", "points"))).alias("turns"))
    convs = own.select("conv_id").distinct().withColumn("leader", leader)
    taken = convs.join(leads, "leader").select("conv_id", F.posexplode(F.slice("turns", F.lit(1), h)).alias("at", "t")).select("conv_id", (F.col("at") + 1).cast("long").alias("depth"), "t.x", "t.points")
    shift = F.least(h, F.coalesce(F.size("turns"), F.lit(0))) - h
    rest = own.where(F.col("n") >= h).withColumn("leader", leader).join(leads, "leader", "left").select("conv_id", (F.col("n") + shift + 1).cast("long").alias("depth"), "x", "points")
    root = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("x"), F.lit(0).cast("long").alias("points"))
    out = root.union(taken).union(rest)
    out._readloom_path = own._readloom_path
    return out


def _totals(paths: DataFrame, values: DataFrame, deepest: int) -> DataFrame:
    """Sums of ``leaves`` and ``saved`` over the subtrees: depth, k1, k2, leaves, saved.

    ``paths``: conv_id, depth, k1, k2, each conversation's nodes. ``values``: the same columns once for each node, with
    one of its members, and leaves, saved.
    """
    band = (F.col("depth") / HEIGHT).cast("long")
    lists = paths.groupBy("conv_id", band.alias("band")).agg(F.sort_array(F.collect_list(F.struct(*KEY))).alias("path"))
    sums = [F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")]
    ups = values.withColumn("band", band).join(lists, ["conv_id", "band"])
    within = ups.select(F.explode(F.filter("path", lambda p: p["depth"] <= F.col("depth"))).alias("p"), "leaves", "saved").select("p.*", "leaves", "saved").groupBy(*KEY).agg(*sums)
    if deepest < HEIGHT:
        return within
    within = save(within, "trie-bands")
    at_root = F.col("depth") % HEIGHT == 0
    up = (F.col("depth") / HEIGHT).cast("long")
    roots = values.where(at_root).select("conv_id", *KEY)
    done = _totals(paths.where(at_root).withColumn("depth", up), roots.join(within, KEY).withColumn("depth", up), deepest // HEIGHT)
    done = roots.where("depth > 0").join(done.withColumn("depth", F.col("depth") * HEIGHT), KEY)
    over = done.select("conv_id", (band - 1).alias("band"), "leaves", "saved").join(lists, ["conv_id", "band"]).select(F.explode("path").alias("p"), "leaves", "saved").select("p.*", "leaves", "saved")
    return within.union(over.select(*within.columns)).groupBy(*KEY).agg(*sums)


def _joined(batches):
    """Runs of a node's ids, joined to rows of at most CHUNK ids."""
    now, ids = None, []

    def row():
        return pa.RecordBatch.from_pydict({"depth": [now[0]], "k1": [now[1]], "k2": [now[2]], "least": [ids[0]], "ids": [",".join(map(str, ids))]}, schema=schema)

    schema = pa.schema([("depth", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("least", pa.int64()), ("ids", pa.string())])
    made: list[pa.RecordBatch] = []
    for b in batches:
        for *key, i in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if ids and (key != now or len(ids) >= CHUNK):
                made.append(row())
                ids = []
            now = key
            ids.append(i)
        if made:
            yield pa.Table.from_batches(made).combine_chunks().to_batches()[0]
            made = []
    if ids:
        yield row()


def _hashed(batches):
    """SHA-256 of each node's joined ids, a row of them after the other."""
    schema = pa.schema([("depth", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("ends", pa.string())])
    now, sha, out = None, None, []

    def rows():
        return pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema=schema)

    for b in batches:
        for *key, _, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if key == now:
                sha.update(b"," + ids.encode())
                continue
            if now is not None:
                out.append((*now, sha.hexdigest()))
            now, sha = key, hashlib.sha256(ids.encode())
        if out:
            yield rows()
            out.clear()
    if now is not None:
        out.append((*now, sha.hexdigest()))
        yield rows()


def ends_hash(ends: DataFrame) -> DataFrame:
    """SHA-256 of the decimal ids (conv_id) of each node, ascending and joined by commas: depth, k1, k2, ends.

    Ids are joined in ranges first, so that a node with very many has a few rows of text, which one task then hashes
    one after the other (SHA-256 has no other way).
    """
    order = [*KEY, "conv_id"]
    chunks = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_joined, "depth long, k1 long, k2 long, least long, ids string")
    return chunks.repartition(partitions(ends.sparkSession), *KEY).sortWithinPartitions(*KEY, "least").mapInArrow(_hashed, "depth long, k1 long, k2 long, ends string")


def prefix_trie(conversations: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """Nodes of the prefix trie of the rebuilt conversations (see ``rebuilt``).

    Returns for each node: conv_id (its smallest member), depth, parent_conv_id (the parent's; null for the root), n_convs
    (members), n_children, n_leaves (childless nodes in its subtree, itself included), saved_tokens (sum over its subtree
    of (n_convs - 1) times the code points of a node's last text) and ends_sha256 (of the ids of those members that end
    there, ascending, comma-joined).

    Null roles and texts count as empty. Turns stand by turn, null first; those of one turn by role, the text's first
    64 characters, then a hash of both. Repeated rows are turns of their own. Rows of a null conv_id are left out. An
    empty table has no nodes, not even a root. Other columns are not read. Texts go through no shuffle but for their
    first 64 characters; two turns count as equal if their MD5 is, two nodes if their 128 bits are.
    """
    turns = rebuilt(conversations, every, most)
    placed = turns.withColumn("g1", F.when(F.col("depth") > 0, F.xxhash64("depth", "x")).otherwise(0)).withColumn("g2", F.when(F.col("depth") > 0, F.xxhash64("x", "depth", F.lit(1))).otherwise(0)).drop("x")
    paths = running(placed.withColumns({"k1": F.col("g1"), "k2": F.col("g2")}), "conv_id", [F.col("depth")], "trie-paths", ("k1", "k2"))
    discard(turns)
    parents = [F.col("k1").bitwiseXOR(F.col("g1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("g2")).alias("p2")]
    nodes = save(paths.select("conv_id", *KEY, *parents, "points").groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("points").alias("points"), F.first("p1").alias("p1"), F.first("p2").alias("p2")), "trie-nodes")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    base = nodes.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    values = base.select("conv_id", *KEY, (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("points")).alias("saved"))
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    totals = _totals(paths.select("conv_id", *KEY), save(values, "trie-values"), deepest)
    ends = ends_hash(paths.groupBy("conv_id").agg(F.max(F.struct(*KEY)).alias("k")).select("k.*", "conv_id"))
    above = nodes.select(F.col("depth").alias("up"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    out = base.withColumn("up", F.col("depth") - 1).join(totals, KEY).join(ends, KEY, "left").join(above, ["up", "p1", "p2"], "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(none)).alias("ends_sha256"))
