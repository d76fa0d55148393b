"""Merkle manifest of a dataset: a tree of digests over all rows, and proofs that a row is in it.

Each row is a leaf, the SHA-256 of its fields. In a language the leaves are in order of their ids; every
``FAN`` nodes next to each other become the digest of theirs joined, level by level, until one is left. The
languages' last nodes, in order of language, become one root in the same way. A node is a record of a
content-addressed store: its digest leads to the digests of its children.

A leaf's proof is read by descending from the root: the digits of the leaf's rank, to the base ``FAN``, say
which child comes next, the others are kept, and at the leaf the kept parts of the path are put in
reverse. Requests that share their digits so far descend as one, so a record is read once for all requests
below it, and what moves through a level is one path for each node there that has a request. A proof folds
a leaf with what was kept into a root again; it equals the root only if the leaf is what was stored.

Leaves are ranked by ranges of ids, so a language of any size is spread over tasks. Levels, records and
paths are tables; the driver holds the number of levels only.

Defined results: a null field is ``-``; a null language is a tree of its own and comes first, a null id comes first
in its language and is never tampered with; repeated rows are leaves next to each other; an empty table gives
no row; extra columns are no part of a leaf.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.components import stored
from tidewell.llm.ordering import ranked

FAN = 8
DIGIT_BITS = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 length, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def lower_letters(text: Column) -> Column:
    """The text with A to Z in lower case."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def leaf(text: Column | None = None) -> Column:
    """Digest of a row's fields, with another text if one is given."""
    return digest(*(field(text if name == "text" and text is not None else F.col(name)) for name in FIELDS))


def depth(n: str) -> Column:
    """Levels above n leaves."""
    return F.expr(f"size(filter(sequence(0, 20), d -> shiftleft(1L, {DIGIT_BITS} * d) < {n}))")


def levels(nodes: DataFrame, label: str) -> list[DataFrame]:
    """Nodes of each level from the leaves up, as ``tree, rank, digest, depth, children``; trees end at their depth.

    ``nodes`` are ``tree, rank, digest, group_n`` of the leaves. Level 0 has no children.
    """
    most = nodes.agg(F.max("group_n")).first()[0] or 0
    level = nodes.select("tree", "rank", "digest", depth("group_n").alias("depth"))
    out = [level.withColumn("children", F.lit(None).cast("array<string>"))]
    k = 0
    while FAN**k < most:
        below = level.where(F.col("depth") > k)
        each = below.groupBy("tree", "depth", F.shiftright("rank", DIGIT_BITS).alias("up"))
        each = each.agg(F.array_sort(F.collect_list(F.struct("rank", "digest"))).getField("digest").alias("children"))
        each = each.select("tree", F.col("up").alias("rank"), digest(F.array_join("children", "")).alias("digest"), "depth", "children")
        level = stored(each, f"{label}-{k + 1}")
        out.append(level)
        k += 1
    return out


def tops(nodes: list[DataFrame]) -> DataFrame:
    """The last node of each tree."""
    ends = [level.where(F.col("depth") == k).select("tree", "digest", "depth") for k, level in enumerate(nodes)]
    return reduce(DataFrame.unionByName, ends)


def kept(children: Column, at: Column) -> Column:
    """The part of a path at one node: how many of the others come before, and the others."""
    others = F.concat(F.slice(children, F.lit(1), at), F.slice(children, at + 2, F.lit(FAN)))
    return F.struct(at.alias("before"), others.alias("others"))


def stepped(frontier: DataFrame, level: DataFrame) -> DataFrame:
    """From each node of the frontier to its children, by the record of its digest."""
    records = level.select(F.col("digest").alias("parent"), "children").dropDuplicates(["parent"])
    found = frontier.join(records, frontier["digest"] == records["parent"])
    each = found.select(*frontier.columns, "children", F.posexplode("children").alias("digit", "child"))
    step = F.concat("path", F.array(kept(F.col("children"), F.col("digit"))))
    own = [c for c in frontier.columns if c not in ("rank", "digest", "path")]
    return each.select(*own, (F.col("rank") * FAN + F.col("digit")).alias("rank"), F.col("child").alias("digest"), step.alias("path"))


def folded(start: Column, path: Column) -> Column:
    """Root that a digest and the kept parts of a path, the lowest first, lead to."""

    def up(below: Column, part: Column) -> Column:
        left = F.array_join(F.slice(part["others"], F.lit(1), part["before"]), "")
        right = F.array_join(F.slice(part["others"], part["before"] + 1, F.lit(FAN)), "")
        return digest(left, below, right)

    return F.aggregate(path, start, up)


class Manifest:
    """The trees of a table: leaves with their ranks, records by level, and the root."""

    def __init__(self, leaves: DataFrame):
        """``leaves`` have ``tree`` (no nulls), ``doc_id``, ``leaf`` and anything else."""
        self.leaves = ranked(leaves, "tree", [F.col("doc_id").asc_nulls_first(), F.col("leaf")], "leaves")
        self.nodes = levels(self.leaves.withColumnRenamed("leaf", "digest"), "nodes")
        subroots = tops(self.nodes).withColumn("all", F.lit(0))
        self.subroots = ranked(subroots, "all", [F.col("tree")], "subroots")
        above = self.subroots.select(F.lit("").alias("tree"), "rank", "digest", "group_n")
        self.above = levels(above, "above")
        self.root = tops(self.above).select(F.col("digest").alias("root"))

    def proofs(self, requests: DataFrame) -> DataFrame:
        """Each request with ``subroot``, ``root``, ``path`` (kept parts, the lowest first).

        ``requests`` are ``tree, rank`` of leaves and anything else.
        """
        none = F.array().cast("array<struct<before:int,others:array<string>>>")
        frontier = self.root.select(F.lit(0).cast("long").alias("rank"), F.col("root").alias("digest"), "root", none.alias("path"))
        for level in reversed(self.above[1:]):
            frontier = stepped(frontier, level)
        trees = self.subroots.select("tree", "depth", F.col("rank").alias("place"))
        entered = frontier.join(trees, frontier["rank"] == trees["place"])
        entered = entered.select("tree", "depth", F.lit(0).cast("long").alias("rank"), "digest", F.col("digest").alias("subroot"), "root", "path")
        entered = stored(entered, "entered")
        # Requests by run of the lowest level, and the nodes above that have any.
        request = F.struct("rank", *(c for c in requests.columns if c not in ("tree", "rank")))
        runs = requests.groupBy("tree", F.shiftright("rank", DIGIT_BITS).alias("run")).agg(F.collect_list(request).alias("requests"))
        runs = stored(runs, "requests")
        frontier = None
        for k in range(len(self.nodes) - 1, 0, -1):
            starts = entered.where(F.col("depth") == k)
            frontier = starts if frontier is None else stepped(frontier, self.nodes[k + 1]).unionByName(starts)
            asked = runs.select("tree", F.shiftright("run", DIGIT_BITS * (k - 1)).alias("rank")).distinct()
            frontier = frontier.join(asked, ["tree", "rank"], "left_semi")
        lone = entered.where("depth = 0")
        frontier = lone if frontier is None else frontier.unionByName(lone)
        if len(self.nodes) > 1:
            records = self.nodes[1].select(F.col("digest").alias("parent"), "children").dropDuplicates(["parent"])
            frontier = frontier.join(records, (frontier["digest"] == records["parent"]) & (frontier["depth"] > 0), "left")
        else:
            frontier = frontier.withColumn("children", F.lit(None).cast("array<string>"))
        found = frontier.join(runs.withColumnRenamed("run", "rank"), ["tree", "rank"])
        each = found.select("tree", "subroot", "root", "path", "children", F.explode("requests").alias("request"))
        last = kept(F.col("children"), (F.col("request.rank") % FAN).cast("int"))
        whole = F.when(F.col("children").isNull(), F.col("path")).otherwise(F.concat("path", F.array(last)))
        return each.select("tree", "request.*", "subroot", "root", F.reverse(whole).alias("path"))


def manifest(docs: DataFrame) -> Manifest:
    """The trees of documents; leaves carry ``given``, the leaf of the row as tampered with."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *FIELDS[1:])
    tree = F.coalesce(F.concat(F.lit("="), "lang"), F.lit(""))
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    given = F.when(tampered, leaf(lower_letters(F.col("text"))))
    return Manifest(docs.select("doc_id", tree.alias("tree"), leaf().alias("leaf"), given.alias("given")))


def verified(docs: DataFrame) -> DataFrame:
    """Proof of every row, and whether the row as it is given now still leads to the root."""
    made = manifest(docs)
    found = made.proofs(made.leaves.drop("group_n"))
    others = F.array_join(F.flatten(F.col("path").getField("others")), "")
    back = folded(F.coalesce("given", "leaf"), F.col("path"))
    found = found.select("doc_id", "leaf", "subroot", "root", F.sha2(others, 256).alias("proof_sha256"), back.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
