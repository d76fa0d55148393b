"""Benchmark decontamination by size-partitioned MinHash containment search.

A test item is short and a document may be long, so their Jaccard similarity says little; what
counts is how much of the *item* the document contains. Items are partitioned by size (number of
distinct shingles, classes up to powers of two). Each class has its own sketch length: the bottom-k
shingles of an item by a random hash, with k one more than the shingles that an item of the class may
lack at the threshold. A document that contains enough of an item therefore holds at least one
shingle of its sketch: no match is lost. Documents are looked up by the hashes of all their
shingles, and every hit is verified by the exact shingles.

Items are the query set and go through the documents in blocks of bounded size
(``BLOCK_BYTES`` of item text, by hash). The driver and the tasks hold one block at a time: it is collected, sent,
searched for in all documents, its hits written below the shared folder under the digest of the text that has them,
and released before the next. The hits of all blocks are then joined to the documents by that digest. If all items fit one
block, the documents are searched for it where they are read, without the table of hits.

Defined results: shingles are of five lower-cased words; an item of one to four words is one
shingle of all its words; an item or document without words matches nothing; null texts are empty;
repeated (item, text) rows count once; each document row is searched on its own; an empty table on
either side gives no match. Extra columns are left alone.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm.components import stored
from tidewell.llm.text import Bounded, lower_words, value_udf, without

SHINGLE = 5
THRESHOLD = 0.8
BLOCK_BYTES = 8 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)

MATCHES = T.ArrayType(
    T.StructType(
        [T.StructField("item_id", T.LongType()), T.StructField("n_item", T.LongType()), T.StructField("n_shared", T.LongType())]
    )
)


def needed(n: int, threshold: float = THRESHOLD) -> int:
    """Shared shingles that make an item of n shingles contained."""
    return max(1, math.ceil(threshold * n - 1e-9))


def sketch_size(n: int, threshold: float = THRESHOLD) -> int:
    """Sketch length of the size class of n: enough for the largest item of the class."""
    top = 1 << max(0, n - 1).bit_length()
    return min(n, max(m - needed(m, threshold) + 1 for m in range(top // 2 + 1, top + 1)))


def rolled(hashes: np.ndarray, width: int) -> np.ndarray:
    """One hash for every run of ``width`` words."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = hashes[:n].copy()
    for i in range(1, width):
        total *= MIX
        total += hashes[i : i + n]
    return total ^ (total >> np.uint64(31))


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 7)


def shingles(found: list[bytes], width: int) -> list[tuple[bytes, ...]]:
    return list(zip(*(found[i:] for i in range(width))))


class Searcher:
    """Finds the items of one block in a text."""

    def __init__(self, items: list[tuple[int | None, bytes]], threshold: float, size: int):
        self.items, self.sketch, sketched = [], {}, {}
        for item_id, text in items:
            found = lower_words(text)
            if not found:
                continue
            width = min(size, len(found))
            exact = set(shingles(found, width))
            hashes = np.unique(rolled(np.array([word_hash(w) for w in found], np.uint64), width))
            order = np.argsort(hashes * MIX ^ (hashes >> np.uint64(29)))
            self.items.append((item_id, exact, width, needed(len(exact), threshold)))
            for h in hashes[order[: sketch_size(len(exact), threshold)]].tolist():
                sketched.setdefault(width, {}).setdefault(h, []).append(len(self.items) - 1)
        for width, owners in sketched.items():
            bits = max(16, (64 * len(owners)).bit_length())
            seen = np.zeros(1 << bits, bool)
            seen[np.array(list(owners), np.uint64) & np.uint64((1 << bits) - 1)] = True
            self.sketch[width] = owners, seen, np.uint64((1 << bits) - 1)
        self.hashes = Bounded(word_hash)

    def __call__(self, text: bytes) -> list[dict]:
        found = lower_words(text)
        out: list[dict] = []
        if not found or not self.sketch:
            return out
        hashes = np.fromiter(map(self.hashes.__getitem__, found), np.uint64, len(found))
        for width, (owners, seen, low) in self.sketch.items():
            runs = rolled(hashes, width)
            hit = runs[seen[runs & low]]
            if not len(hit):
                continue
            candidates = sorted({i for h in set(hit.tolist()) for i in owners.get(h, ())})
            if not candidates:
                continue
            have = set(shingles(found, width))
            for i in candidates:
                item_id, exact, _, least = self.items[i]
                shared = len(exact & have) if len(exact) < len(have) else sum(s in exact for s in have)
                if shared >= least:
                    out.append({"item_id": item_id, "n_item": len(exact), "n_shared": shared})
        return out


def item_blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """The distinct items with the ``block`` of each, and the number of blocks, each of about ``block_bytes``."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / block_bytes))
    return rows.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n))), n


def items_of(rows: DataFrame, block: int) -> list[tuple[int | None, bytes]]:
    """The items of one block, on the driver."""
    return [(r.item_id, r.text.encode()) for r in rows.where(F.col("block") == block).collect()]


def contained(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents with ``matches``: the items that each contains, with sizes and shared shingles."""
    context = docs.sparkSession.sparkContext
    docs = without(docs, ["matches"])
    rows, blocks = item_blocks(items, block_bytes)
    if blocks == 1:
        held = context.broadcast(items_of(rows, 0))
        return docs.withColumn("matches", value_udf(searcher(held, threshold, size), MATCHES)(F.col("text")))
    rows = stored(rows, "items")
    hits = []
    for block in range(blocks):
        held = context.broadcast(items_of(rows, block))
        found = docs.select(text_key().alias("__key"), value_udf(searcher(held, threshold, size), MATCHES)(F.col("text")).alias("__found"))
        hits.append(stored(found.where(F.size("__found") > 0).dropDuplicates(["__key"]), "hits"))
        held.destroy()
    hits = reduce(DataFrame.unionByName, hits).groupBy("__key").agg(F.flatten(F.collect_list("__found")).alias("__found"))
    none = F.array().cast(MATCHES)
    own = docs.select(text_key().alias("__own"), F.struct(*docs.columns).alias("__row"))
    return own.join(hits, F.col("__own") == F.col("__key"), "left").select("__row.*", F.coalesce("__found", none).alias("matches"))


def text_key() -> Column:
    return F.sha2(F.coalesce("text", F.lit("")), 256)


def searcher(held, threshold: float, size: int) -> Callable[[], Searcher]:
    return lambda: Searcher(held.value, threshold, size)


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that contain no test item, with the columns of the input only."""
    rows = docs.select(F.struct(*docs.columns).alias("__row"), F.col("text"))
    return contained(rows, items, threshold).where(F.size("matches") == 0).select("__row.*")
