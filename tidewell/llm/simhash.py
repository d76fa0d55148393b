"""SimHash fingerprints and near-duplicate groups by anchor-point covering.

A covering code gives the anchors: every fingerprint lies within the code's covering radius of one.
Each fingerprint is sent to all anchors within that radius plus the link threshold that a fingerprint
linked to it can be nearest to, so linked fingerprints always meet at an anchor, and fingerprints are
compared at their anchors only. The code is a direct sum of perfect codes over disjoint bits: two
binary Golay codes (radius 3 each), and with very many fingerprints a Hamming code of 15 bits
(radius 1) as well, which keeps anchors' groups small.

Equal fingerprints are one before anything else, so groups of exact copies cost one row. An anchor's
group is never turned into all its pairs: small groups are compared in place, large ones are joined
through shared neighbours at one bit, linear in their size, and give one link a member. Components
of the links are found by alternating stars.

Defined results: text without words (null, empty) has fingerprint zero and links like any other;
fewer than three words are one shingle; null ids stay null and are never a component's id unless all
ids of the component are null; repeated rows share all results; an empty table gives an empty one;
extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm.components import components, stored
from tidewell.llm.text import lower_words, value_udf

SHINGLE = 3
SEED = 42
THRESHOLD = 2
# Length, generator polynomial and covering radius of the perfect codes.
GOLAY = (23, 0xC75, 3)
HAMMING = (15, 0x13, 1)
MANY = 1 << 26
SMALL = 64
PART = 100_000


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """SimHash of the text's shingles as a signed 64-bit number."""
    found = lower_words(text)
    if not found:
        return 0
    runs = zip(*(found[i:] for i in range(size))) if len(found) > size else iter([found])
    ones, n = np.zeros(64, np.int64), 0
    while part := [xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in islice(runs, 1 << 16)]:
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        n += len(part)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


@cache
def cosets(code: tuple[int, int, int], threshold: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each excess of 0 to threshold over the radius: per syndrome, the changes that lead to a codeword."""
    n, polynomial, radius = code
    of_bit = syndromes_of_bits(n, polynomial)
    out = []
    for excess in range(threshold + 1):
        weights = range(radius + 1) if excess == 0 else [radius + excess]
        changes, at = [], []
        for bits in (b for w in weights for b in combinations(range(n), w)):
            changes.append(sum(1 << b for b in bits))
            s = 0
            for b in bits:
                s ^= of_bit[b]
            at.append(s)
        order = np.argsort(at, kind="stable")
        counts = np.bincount(at, minlength=1 << (polynomial.bit_length() - 1))
        out.append((np.cumsum(counts) - counts, counts, np.array(changes, np.int64)[order]))
    return out


def syndromes_of_bits(n: int, polynomial: int) -> list[int]:
    """Remainder of x^i by the generator polynomial."""
    out, value, top = [], 1, 1 << (polynomial.bit_length() - 1)
    for _ in range(n):
        out.append(value)
        value <<= 1
        if value & top:
            value ^= polynomial
    return out


def anchors(prints: np.ndarray, codes: tuple, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the fingerprint, anchor, and whether it is the nearest; for all anchors that matter."""
    index, anchor, excess = np.arange(len(prints)), np.zeros(len(prints), np.int64), np.zeros(len(prints), np.int64)
    shift = 0
    for code in codes:
        n, polynomial, _ = code
        own = (prints >> shift) & ((1 << n) - 1)
        syndrome = np.zeros(len(prints), np.int64)
        for bit, s in enumerate(syndromes_of_bits(n, polynomial)):
            syndrome ^= ((own >> bit) & 1) * s
        parts = []
        for more, (first, count, changes) in enumerate(cosets(code, threshold)):
            rows = np.flatnonzero(excess + more <= threshold)
            s = syndrome[index[rows]]
            times = count[s]
            each = np.repeat(rows, times)
            within = np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times)
            change = changes[np.repeat(first[s], times) + within]
            word = (own[index[each]] ^ change) << shift
            parts.append((index[each], anchor[each] | word, excess[each] + more))
        index, anchor, excess = (np.concatenate(x) for x in zip(*parts))
        shift += n
    return index, anchor, excess == 0


def cover(codes: tuple, threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(prints), 4096):
                part = prints[at : at + 4096]
                index, anchor, home = anchors(part, codes, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(part[index]), pa.array(home)], names=["anchor", "fp", "home"])

    return run


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64))


def merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least label of each joined set, after the pairs a, b are joined too."""
    while True:
        la, lb = label[a], label[b]
        if (la == lb).all():
            return label
        least = np.minimum(la, lb)
        np.minimum.at(label, la, least)
        np.minimum.at(label, lb, least)
        while (label[label] != label).any():
            label = label[label]


def joined(prints: np.ndarray) -> np.ndarray:
    """For distinct fingerprints: the first of those each is connected to by steps of at most two bits.

    Two such share a neighbour at one bit or less. Neighbours are sorted in parts of bounded size.
    """
    label = np.arange(len(prints))
    parts = max(1, len(prints) // PART)
    values = prints.view(np.uint64)
    for p in range(parts):
        keys, owners = [], []
        for change in [0, *(1 << b for b in range(64))]:
            key = values ^ np.uint64(change)
            mine = np.flatnonzero((key * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(parts) == p) if parts > 1 else label
            keys.append(key[mine] if parts > 1 else key)
            owners.append(mine if parts > 1 else np.arange(len(prints)))
        key, owner = np.concatenate(keys), np.concatenate(owners)
        order = np.argsort(key, kind="stable")
        key, owner = key[order], owner[order]
        same = np.flatnonzero(key[1:] == key[:-1])
        label = merged(label, owner[same], owner[same + 1])
    return label


def links_of(anchor: np.ndarray, prints: np.ndarray, home: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within whole groups of equal anchors."""
    first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    size = np.diff(np.r_[first, len(anchor)])
    homes = np.add.reduceat(home.astype(np.int64), first)
    us, vs = [], []
    large = (size > SMALL) & (homes > 0) if threshold == 2 else np.zeros(len(size), bool)
    compared = (size > 1) & (homes > 0) & ~large
    group = np.repeat(np.arange(len(size)), size)
    left = np.flatnonzero(home & compared[group])
    times = size[group[left]]
    a = np.repeat(left, times)
    b = np.repeat(first[group[left]], times) + np.arange(len(a)) - np.repeat(np.cumsum(times) - times, times)
    near = (distance(prints[a], prints[b]) <= threshold) & (prints[a] != prints[b])
    us.append(prints[a[near]])
    vs.append(prints[b[near]])
    for g in np.flatnonzero(large):
        own = np.unique(prints[first[g] : first[g] + size[g]])
        label = joined(own)
        moved = label != np.arange(len(own))
        us.append(own[moved])
        vs.append(own[label[moved]])
    u, v = np.concatenate(us), np.concatenate(vs)
    pairs = np.unique(np.stack([np.maximum(u, v), np.minimum(u, v)], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def compare(threshold: int):
    """Links of one task's rows, which come sorted by anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def links(columns):
            u, v = links_of(*columns, threshold)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            if not len(columns[0]):
                continue
            held.append(columns)
            if columns[0][0] == columns[0][-1] and held[0][0][0] == columns[0][-1]:
                continue
            anchor, prints, home = (np.concatenate(x) for x in zip(*held))
            whole = int(np.searchsorted(anchor, anchor[-1]))
            held = [[anchor[whole:], prints[whole:], home[whole:]]]
            if whole:
                yield links((anchor[:whole], prints[:whole], home[:whole]))
        if held:
            yield links(tuple(np.concatenate(x) for x in zip(*held)))

    return run


def near_links(prints: DataFrame, threshold: int = THRESHOLD, many: int = MANY) -> DataFrame:
    """``u, v``: links between the distinct fingerprints ``fp`` that connect all that are linked."""
    codes = (GOLAY, GOLAY) if prints.count() < many else (GOLAY, GOLAY, HAMMING)
    sent = prints.select("fp").mapInArrow(cover(codes, threshold), "anchor long, fp long, home boolean")
    met = sent.repartition("anchor").sortWithinPartitions("anchor")
    return met.mapInArrow(compare(threshold), "u long, v long").distinct()


def groups(least: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``fp, root, component_id`` from the distinct fingerprints ``fp`` and the ``least`` id of each."""
    roots = components(near_links(least, threshold))
    linked = roots.join(least, roots.node == least.fp)
    ids = linked.groupBy("root").agg(F.min("least").alias("joined_id"))
    moved = roots.join(ids, "root").withColumnRenamed("node", "fp")
    one = least.join(moved, "fp", "left")
    return one.select("fp", F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("joined_id")).alias("component_id"))


def least_ids(rows: DataFrame) -> DataFrame:
    """The distinct fingerprints with their least id, written down: equal texts are one row from here."""
    return stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")


def prints_of(text: str = "text"):
    return value_udf(lambda: fingerprint, T.LongType())(F.col(text))


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``doc_id, fp, component_id`` of every row."""
    rows = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), prints_of().alias("fp")), "fingerprints")
    return rows.join(groups(least_ids(rows), threshold), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """One row of each group, the one with the least id, with the columns of the input only.

    Of rows of a group that share that id the one with the least fingerprint, then text, stays.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), prints_of().alias("fp"))
    rows = stored(rows, "fingerprints")
    named = rows.select("doc_id", "fp").join(groups(least_ids(rows), threshold), "fp").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    chosen = named.groupBy("root").agg(F.min("fp").alias("fp"), F.min("doc_id").alias("doc_id"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key")
    kept = rows.select("row", "fp", key).join(chosen.select("fp", key), ["fp", "key"], "left_semi")
    return kept.groupBy("fp", "key").agg(F.min_by("row", F.coalesce("row.text", F.lit(""))).alias("row")).select("row.*")
