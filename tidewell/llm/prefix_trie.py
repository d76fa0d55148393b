"""Trie of conversation prefixes, packed into double arrays.

A turn goes by the first 16 bytes of the SHA-256 of its role and text, a conversation by the digests of its
turns joined, its key: one key begins with another where the conversation begins with the other.
Conversations with equal turns become one row first. The distinct keys are then dealt out by
ranges, so a shard holds a stretch of the keys in order, however many share a first turn. A
shard numbers its turns densely and packs its trie into two arrays: the child of state ``s`` by turn ``c`` is
``BASE[s] + c``, and ``CHECK`` there names ``s``. Walking the keys through the arrays gives the members of each node.

Only nodes on the way to a shard's first and last key can go on in other shards. Those are sent with what
the shard has below them, added up by prefix over all shards, and their sums handed up to all their prefixes; all
other nodes are final in their shard, and learn the name of a shared parent by shard and depth.

Defined results: turns are in order of ``turn`` (null first), equal ones in order of their digests; a null role
or text is empty; rows without ``conv_id`` are one conversation without id, which is counted, starts at its own
first turn, and is left out of names and lists of ids; repeated rows are turns each; an empty table gives no node;
extra columns are left out. A conversation is one row of 24 bytes a turn; a shard takes about ``SHARD`` bytes of
those, or one conversation if that is longer.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.components import stored

SHARE = 5
LONGEST_HEAD = 9
TURN = 16
SHARD = 16 << 20
ID_SPAN_BITS = 10
NO_ENDS = hashlib.sha256(b"").hexdigest()

SEQUENCES = "key binary, sizes array<long>, n long, least long, ends_sha256 string"
# A row is final, or carries what is to be added up (shared) or named (parent_depth).
NODES = (
    "shard long, depth long, shared boolean, prefix binary, parent_depth long, conv_id long, parent_conv_id long, n_convs long, "
    "n_children long, n_leaves long, saved_tokens long, size long, ends_sha256 string"
)
KINDS = {"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def as_batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    columns = zip(*rows) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, KINDS[kind]) for c, (_, kind) in zip(columns, fields)], names=[name for name, _ in fields])


def head_length(conv_id: Column) -> Column:
    return F.crc32(conv_id.cast("string")) % LONGEST_HEAD


def conversations(rows: DataFrame) -> DataFrame:
    """``conv_id, turns``: the turns of each conversation in order, as digest and UTF-8 bytes of the text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    named = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    key = F.substring(F.unhex(F.sha2(named, 256)), 1, TURN)
    turn = F.struct(F.col("turn").cast("long").alias("turn"), key.alias("key"), F.octet_length(text).cast("long").alias("size"))
    each = rows.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t")).groupBy("conv_id")
    # Structs are ordered field by field, null first.
    each = each.agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return each.withColumn("turns", F.transform("turns", lambda t: F.struct(t["key"].alias("key"), t["size"].alias("size"))))


def rebuilt(rows: DataFrame) -> DataFrame:
    """Each conversation with the first turns of the one it shares with, then its own after as many."""
    own = conversations(rows)
    first = own.select(F.col("conv_id").alias("shared_id"), F.slice("turns", 1, LONGEST_HEAD).alias("shared"))
    joined = own.withColumn("shared_id", F.col("conv_id") - F.col("conv_id") % SHARE).join(first, "shared_id", "left")
    head = F.coalesce(head_length(F.col("conv_id")), F.lit(0)).cast("int")
    none = F.array().cast("array<struct<key:binary,size:bigint>>")
    start = F.coalesce(F.slice("shared", F.lit(1), head), none)
    return joined.select("conv_id", F.concat(start, F.slice("turns", head + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


def sequences(built: DataFrame) -> DataFrame:
    """Distinct conversations, how many there are of each, the least id and the digest of all ids.

    Ids are joined within spans of ids first, so many equal conversations come to few rows, which one
    task reads in order and digests as they come.
    """
    key = F.aggregate("turns", F.lit(b""), lambda have, t: F.concat(have, t["key"]))
    rows = built.select("conv_id", key.alias("key"), F.col("turns.size").alias("sizes"))
    span = F.shiftright("conv_id", ID_SPAN_BITS).alias("span")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda i: i.cast("string")), ",")
    spans = rows.groupBy("key", span).agg(F.count("*").alias("n"), F.min("conv_id").alias("least"), ids.alias("ids"), F.first("sizes").alias("sizes"))
    return spans.repartition("key").sortWithinPartitions("key", F.col("span").asc_nulls_last()).mapInArrow(digested, SEQUENCES)


def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of each key, in order, as one row."""
    open_, digest = None, None
    for batch in batches:
        done = []
        for row in batch.to_pylist():
            if open_ is None or row["key"] != open_[0]:
                if open_ is not None:
                    done.append((*open_, digest.hexdigest()))
                open_, digest, first = [row["key"], row["sizes"], 0, None], hashlib.sha256(), True
            if row["ids"]:
                digest.update(("" if first else ",").encode() + row["ids"].encode())
                first = False
            open_[2] += row["n"]
            open_[3] = row["least"] if open_[3] is None else open_[3]
        yield as_batch(SEQUENCES, done)
    if open_ is not None:
        yield as_batch(SEQUENCES, [(*open_, digest.hexdigest())])


class DoubleArray:
    """Trie over sequences of dense codes from 1 on: the child of ``s`` by ``c`` is ``base[s] + c``, checked by ``check``."""

    def __init__(self):
        self.base, self.check, self.end, self.low = np.zeros(1024, np.int64), np.full(1024, -1, np.int64), 1, 1

    def room(self, most: int) -> None:
        if most >= len(self.check):
            more = max(most + 1, 2 * len(self.check)) - len(self.check)
            self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int64)])

    def place(self, state: int, codes: np.ndarray, tries: int = 32) -> np.ndarray:
        """Give a state its children: codes in order, at the first free places that fit, else after all others."""
        while self.low < self.end and self.check[self.low] >= 0:
            self.low += 1
        free = self.low + np.flatnonzero(self.check[self.low : min(self.end, self.low + 4 * tries)] < 0)[:tries]
        steps = codes - codes[0]
        for at in [*free.tolist(), self.end]:
            places = at + steps
            self.room(int(places[-1]))
            if (self.check[places] < 0).all():
                break
        self.check[places] = state
        self.base[state] = places[0] - codes[0]
        self.end = max(self.end, int(places[-1]) + 1)
        return places

    def child(self, state: int, code: int) -> int:
        """The child's state, or -1."""
        at = self.base[state] + code
        return int(at) if 0 < at < self.end and self.check[at] == state else -1


def packed(keys: list[np.ndarray]) -> tuple[DoubleArray, list[np.ndarray]]:
    """Double array of sorted sequences of turns, and the states that each sequence goes through below the root.

    Turns are numbered in order of first use, level by level, so the children of a state have numbers near each other.
    """
    trie, number = DoubleArray(), {}
    most = max(map(len, keys), default=0)
    walks = [np.zeros(len(k), np.int64) for k in keys]
    for level in range(most):
        longer = [i for i, k in enumerate(keys) if len(k) > level]
        children: dict[int, dict] = {}
        for i in longer:
            state = int(walks[i][level - 1]) if level else 0
            children.setdefault(state, {})[number.setdefault(keys[i][level], len(number) + 1)] = None
        for state, codes in children.items():
            trie.place(state, np.array(sorted(codes), np.int64))
        for i in longer:
            walks[i][level] = trie.child(int(walks[i][level - 1]) if level else 0, number[keys[i][level]])
    return trie, walks


def nodes_of_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of the sorted keys of one task."""
    rows = [row for batch in batches for row in batch.to_pylist()]
    if not rows:
        return
    shard = TaskContext.get().partitionId()
    turns = [np.frombuffer(r["key"], f"S{TURN}") for r in rows]
    # The type drops zero bytes at the end, which makes no two turns of equal length alike.
    trie, walks = packed([t.tolist() for t in turns])
    size = trie.end
    n, size_of, depth = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
    least, ends, owner = np.full(size, np.iinfo(np.int64).max), {}, np.zeros(size, np.int64)
    for i, (row, walk) in enumerate(zip(rows, walks)):
        path = np.r_[0, walk]
        n[path] += row["n"]
        depth[walk] = np.arange(1, len(walk) + 1)
        size_of[walk] = row["sizes"]
        owner[path] = i
        if row["least"] is not None:
            least[path] = np.minimum(least[path], row["least"])
        ends[int(path[-1])] = row["ends_sha256"]
    shared = np.zeros(size, bool)
    shared[np.r_[0, walks[0], walks[-1]]] = True
    # The deepest states first, so that a state is whole when it is added to the one above.
    states = np.r_[0, np.flatnonzero(trie.check >= 0)]
    states = states[np.argsort(-depth[states], kind="stable")]
    children, leaves, saved = (np.zeros(size, np.int64) for _ in range(3))
    for s in states.tolist():
        if not shared[s]:
            leaves[s] += not children[s]
            saved[s] += (n[s] - 1) * size_of[s]
        up = int(trie.check[s])
        if s and not shared[s]:
            children[up] += 1
            leaves[up] += leaves[s]
            saved[up] += saved[s]
    name = lambda s: int(least[s]) if least[s] < np.iinfo(np.int64).max else None
    out = []
    for s in states.tolist():
        up, d = int(trie.check[s]), int(depth[s])
        prefix = rows[owner[s]]["key"][: TURN * d] if shared[s] else None
        parent_depth = d - 1 if s and not shared[s] and shared[up] else None
        parent = name(up) if s and not shared[s] and not shared[up] else None
        numbers = (int(x[s]) for x in (n, children, leaves, saved, size_of))
        convs, n_children, n_leaves, n_saved, own = numbers
        # The parent of a final node that is shared is found by its shard and the side that its prefix lies on.
        out.append((shard, d, bool(shared[s]), prefix, parent_depth, name(s), parent, convs, n_children, n_leaves, n_saved, own, ends.get(s, NO_ENDS)))
        if parent_depth is not None:
            out[-1] = (*out[-1][:3], rows[owner[up]]["key"][: TURN * (d - 1)], *out[-1][4:])
        if len(out) == 4096:
            yield as_batch(NODES, out)
            out = []
    yield as_batch(NODES, out)


def merged(shared: DataFrame) -> DataFrame:
    """Nodes of several shards as one, with what is below them; ``prefix`` names them."""
    ended = F.max(F.when(F.col("ends_sha256") != NO_ENDS, F.col("ends_sha256")))
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    each = shared.groupBy("prefix", "depth").agg(F.min("conv_id").alias("conv_id"), *sums, F.max("size").alias("size"), F.coalesce(ended, F.lit(NO_ENDS)).alias("ends_sha256"))
    up = F.expr(f"substring(prefix, 1, octet_length(prefix) - {TURN})")
    inner = each.where("depth > 0").groupBy(up.alias("prefix")).agg(F.count("*").alias("inner"))
    each = each.join(inner, "prefix", "left").withColumn("n_children", F.col("n_children") + F.coalesce("inner", F.lit(0))).drop("inner")
    each = stored(each, "shared")
    above = F.explode(F.sequence(F.lit(0).cast("long"), "depth"))
    own_leaf = (F.col("n_children") == 0).cast("long")
    own_saved = (F.col("n_convs") - 1) * F.col("size")
    parts = each.select("prefix", (F.col("n_leaves") + own_leaf).alias("leaves"), (F.col("saved_tokens") + own_saved).alias("saved"), above.alias("above"))
    parts = parts.select(F.expr(f"substring(prefix, 1, cast({TURN} * above AS int))").alias("prefix"), "leaves", "saved")
    sums = parts.groupBy("prefix").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    parents = each.select(F.col("prefix").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    whole = each.drop("n_leaves", "saved_tokens").join(sums, "prefix")
    whole = whole.withColumn("up", F.when(F.col("depth") > 0, up)).join(parents, "up", "left").drop("up")
    return stored(whole, "merged")


def trie(rows: DataFrame, shard_bytes: int = SHARD) -> DataFrame:
    """A row for each node: name, depth, parent's name, members, children, leaves and savings below, and who ends there."""
    distinct = stored(sequences(rebuilt(rows)), "sequences")
    total = distinct.agg(F.sum(F.octet_length("key") + 8 * F.size("sizes") + 96)).first()[0] or 0
    dealt = distinct.repartitionByRange(max(1, math.ceil(total / shard_bytes)), "key").sortWithinPartitions("key")
    found = stored(dealt.mapInArrow(nodes_of_shard, NODES), "nodes")
    whole = merged(found.where("shared"))
    final = found.where("NOT shared")
    inside = final.where("parent_depth IS NULL").select(*RESULT)
    # Only prefixes that end at a shared node are joined; those below one node of one shard are a shard's rows at most.
    places = found.where("shared").select("shard", "prefix").join(whole.select("prefix", F.col("conv_id").alias("name")), "prefix")
    below = final.where("parent_depth IS NOT NULL").drop("parent_conv_id").join(places, ["shard", "prefix"])
    below = below.withColumnRenamed("name", "parent_conv_id").select(*RESULT)
    return whole.select(*RESULT).unionByName(inside).unionByName(below)
