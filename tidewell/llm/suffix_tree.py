"""Language-model scores from a probabilistic suffix tree over words.

A state of the tree is a context of up to ``DEPTH`` words. A context is a state only if it tells more than
its suffix does: the likelihood that its own next-word distribution gains over the suffix's, on all
training text, must exceed a penalty for each next word it keeps. Its distribution is smoothed: kept
words lose a discount, and all other words get what is left in proportion to the suffix's distribution.
A word is scored in the state that is the longest suffix of the words before it.

All counts are over all training text. Every word and every run of two to ``DEPTH`` + 1 words seen ``LEAST``
times or more is counted whatever the size of the corpus, and the gain alone decides the states. Words and runs
go by 64-bit hashes, and two of equal hash would count as one; a run's is made from that of the run without its last word
and that of the run without its first.

Texts are tokenised once, into blocks of about ``BLOCK`` tokens, dealt out and written to the shared folder where answers
are to meet them, so that only these are shuffled to them. A block asks, in rounds, the ranges of hashes about its own
distinct runs, longer ones only where both parts of a run have been seen often enough, and a range answers with their
counts over all blocks, in the order in which they were asked for: hashes travel one way only, and no run travels with
what its block knows of it already. The first block in a range that has a run owns it, and adds its terms to the sums of
its context; a context is asked about one round after its next words have been counted, by the number that the range
gave it, and the range that its hash is in decides whether it is a state. Blocks score their texts from the answers alone:
no table of the model is joined, gathered on the driver or broadcast. Ranges are as many as ``BLOCK`` goes into all
tokens; a range gets at most a chunk from each block, and never more chunks than runs.

Defined results: null and empty texts are the end token alone; a null id belongs to fold 0 and learns;
repeated rows are learnt and scored each; without training text every token is unknown; an empty table
gives no row; extra columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.components import arrow_batches, dealt, shuffles_dropped, stored
from tidewell.llm.text import FOLDS, lower_words, raw

HELD_OUT = 1
DEPTH = 3
LEAST = 2
DISCOUNT = 0.5
BLOCK = 1 << 20
BATCH = "4m"
RANGES = 64

BLOCKS = "block long, doc_ids array<long>, held array<boolean>, sizes array<long>, tokens binary, hashes binary, counts binary, size long, learnt long"
# What a block asks of a range. ``kind`` is the length of runs that are to be counted: their hashes and the block's own counts.
# Less than 0, it is that of contexts: the range's numbers of them as they came, and sums over the runs that the block owns.
CHUNKS = "bucket long, block long, kind long, keys binary, numbers binary"
# A number for each key of a chunk, in its order. Of runs: twice the whole count, or 0 if it is too small, and 1 more if the
# block owns the run. Of contexts: the log weight of the suffix's distribution if the block wants it, NaN if it is no state. ``ids`` are the range's
# numbers of the runs that stay, unless they are too long for contexts.
ANSWERS = "bucket long, block long, kind long, numbers binary, ids binary, owned long"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


class Numbered(dict):
    """Numbers of words in order of their first use."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


# No word is empty, so the empty word is the end of a text.
END = b""
END_HASH = np.array([word_hash(END)], np.uint64).view(np.int64)[0]


def packed(numbers: np.ndarray) -> bytes:
    return pa.compress(numbers.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, kind: type, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)


def rows_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[dict]:
    """The blocks one by one: each is some megabytes."""
    for batch in batches:
        batch = batch.select(list(names)) if names else batch
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def documents_of(batch: pa.RecordBatch, step: int = 256) -> Iterator[tuple[int | None, bytes]]:
    """Ids and texts, some at a time: a batch may be large."""
    for at in range(0, batch.num_rows, step):
        part = batch.slice(at, step)
        yield from zip(part.column(0).to_pylist(), raw(part.column(1)))


def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in BLOCKS.split(", ")]
    number, made = TaskContext.get().partitionId() << 32, 0
    known, ids, held, texts, size = Numbered(), [], [], [], 0

    def block():
        tokens = np.concatenate(texts)
        train = np.repeat(~np.array(held, bool), [len(x) for x in texts])
        hashes = np.fromiter(map(word_hash, known), np.uint64, len(known))
        # Words by number in the block, those of one number by hash: both pack well.
        order = np.lexsort((hashes, -np.bincount(tokens)))
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order))
        tokens = rank[tokens]
        counts = np.bincount(tokens[train], minlength=len(known)).astype(np.int64)
        values = [number + made, ids, held, [len(x) for x in texts], planes(tokens), steps(hashes[order]), packed(counts), len(tokens), int(counts.sum())]
        types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), *[pa.binary()] * 3, pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=names)

    for batch in batches:
        for doc_id, text in documents_of(batch):
            found = lower_words(text)
            found.append(END)
            ids.append(doc_id)
            held.append(held_out(doc_id))
            texts.append(np.fromiter(map(known.__getitem__, found), np.int32, len(found)))
            size += len(found)
            if size >= BLOCK:
                yield block()
                made += 1
                known, ids, held, texts, size = Numbered(), [], [], [], 0
    if texts:
        yield block()


def base(counts: np.ndarray, total: int, vocabulary: int) -> np.ndarray:
    return np.log10((counts + 0.5) / (total + 0.5 * (vocabulary + 1)))


def run_key(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Hash of a run from those of the run without its last word and of the run without its first."""
    x = before * np.uint64(0x9E3779B97F4A7C15) + after * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(0x165667B19E3779F9)
    for by in (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(31))) * by
    return x ^ (x >> np.uint64(32))


def as_table(schema: str, *columns: Iterable) -> pa.Table:
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.table({name: pa.array(values, kinds[kind]) for (name, kind), values in zip(fields, columns)})


def planes(numbers: np.ndarray) -> bytes:
    """The first bytes of all numbers before the second ones: near numbers share the high ones."""
    width = numbers.dtype.itemsize
    cut = numbers.view(f"u{width}").astype(f">u{width}").view(np.uint8).reshape(-1, width)
    return len(numbers).to_bytes(4, "little") + packed(np.ascontiguousarray(cut.T))


def unplaned(data: bytes, kind: type) -> np.ndarray:
    n, width = int.from_bytes(data[:4], "little"), np.dtype(kind).itemsize
    cut = unpacked(data[4:], np.uint8, width * n).reshape(width, n)
    return np.ascontiguousarray(cut.T).view(f">u{width}").ravel().astype(f"u{width}").view(kind)


def steps(numbers: np.ndarray) -> bytes:
    """Differences of numbers, which are mostly in order."""
    return planes(np.diff(numbers, prepend=numbers.dtype.type(0)))


def summed(data: bytes, kind: type) -> np.ndarray:
    return np.cumsum(unplaned(data, kind), dtype=kind)


def chunks(block: int, kind: int, ranges: int, keys: np.ndarray, numbers: np.ndarray) -> pa.Table:
    """Sorted keys of a block, and rows of numbers on them, by range."""
    bucket = ((keys >> np.uint64(33)) * np.uint64(ranges)) >> np.uint64(31)
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]][: len(keys)])
    spans = list(zip(starts, [*starts[1:], len(keys)]))
    sent = [steps(keys[a:b]) for a, b in spans]
    more = [planes(np.ascontiguousarray(numbers[:, a:b]).ravel()) for a, b in spans]
    same = [np.full(len(starts), x, np.int64) for x in (block, kind)]
    return as_table(CHUNKS, bucket[starts].astype(np.int64), *same, sent, more)


def groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts the keys, and where in it each distinct key starts."""
    order = np.argsort(keys)
    ordered = keys[order]
    return order, np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]][: len(keys)])


class Runs:
    """Runs of one length in a block: for each place the number of the one that ends there, or -1, and its count.

    The distinct ones are in order of their hashes, with the counts in the block and a place of each. ``n`` is the whole
    count of each, ``own`` whether the block owns it, ``rest`` what it is as a context: as far as answers are there.
    """

    def __init__(self, keys: np.ndarray, distinct: np.ndarray, index: np.ndarray, counts: np.ndarray, place: np.ndarray | None):
        self.keys, self.distinct, self.index, self.counts, self.place = keys, distinct, index, counts, place
        self.n = self.own = self.at = self.rest = None

    def answered(self, length: int, got: dict[int, np.ndarray], least: int) -> None:
        if length in got:
            self.n, self.own = got[length] >> 1, (got[length] & 1) > 0
            # The place before the first has no run, as index -1 takes the last.
            self.at = np.r_[self.n, 0][self.index]
        if -length in got:
            self.rest = np.full(len(self.distinct) + 1, np.nan)
            self.rest[:-1][self.n >= least] = got[-length]


def longer(shorter: Runs, starts: np.ndarray, train: np.ndarray, least: int) -> Runs:
    """Runs one word longer that do not go past the end of a text and both parts of which stay, as far as that is known."""
    ok = ~starts[1:]
    if shorter.at is not None:
        stay = shorter.at >= least
        ok &= stay[1:] & stay[:-1]
    at = np.flatnonzero(ok) + 1
    keys, index = np.zeros(len(starts), np.uint64), np.full(len(starts), -1, np.int32)
    keys[at] = run_key(shorter.keys[at - 1], shorter.keys[at])
    order, first = groups(keys[at])
    order = at[order]
    index[order] = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(np.r_[first, len(order)]))
    counts = np.bincount(index[at], train[at], len(first)).astype(np.int64)
    return Runs(keys, keys[order[first]], index, counts, order[first])


class Block:
    """A block's runs of one to ``longest`` words, with the answers so far."""

    def __init__(self, row: dict, got: dict[int, np.ndarray], longest: int, least: int):
        self.row, self.least = row, least
        self.sizes = np.array(row["sizes"], np.int64)
        tokens, hashes = unplaned(row["tokens"], np.int32), summed(row["hashes"], np.uint64)
        train = np.repeat(~np.array(row["held"], bool), self.sizes)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.starts = np.zeros(len(tokens), bool)
        self.starts[self.first] = True
        order = np.argsort(hashes)
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order))
        counts = unpacked(row["counts"], np.int64, len(hashes))
        self.runs = [Runs(hashes[tokens], hashes[order], rank[tokens], counts[order], None)]
        self.runs[0].answered(1, got, least)
        for length in range(2, longest + 1):
            # Words and pairs are asked about in one round, so pairs are the same whatever is known of words.
            whole = self.runs[-1] if length > 2 else Runs(self.runs[0].keys, *[None] * 4)
            self.runs.append(longer(whole, self.starts, train, least))
            self.runs[-1].answered(length, got, least)

    def given(self, length: int, at: np.ndarray, total: int, vocabulary: int) -> np.ndarray:
        """Natural log of the chance of the last word of the runs that end at some places, all of which stay."""
        if length == 1:
            return np.log((self.runs[0].at[at] + 0.5) / (total + 0.5 * (vocabulary + 1)))
        own, context = self.runs[length - 1], self.runs[length - 2]
        state = ~np.isnan(context.rest[context.index[at - 1]])
        return np.where(state, np.log((own.at[at] - DISCOUNT) / context.at[at - 1]), self.given(length - 1, at, total, vocabulary))

    def count(self, length: int, ranges: int) -> pa.Table:
        runs = self.runs[length - 1]
        return chunks(self.row["block"], length, ranges, runs.distinct, runs.counts[None])

    def contexts(self, length: int, total: int, vocabulary: int, known: list[tuple[int, bytes, int]]) -> pa.Table:
        """The contexts of a length, with what the runs that the block owns add to them: see ``rests``.

        ``known`` has each range, its numbers of the contexts, and how many they are.
        """
        context, runs = self.runs[length - 1], self.runs[length]
        at = runs.place[runs.own & (runs.n >= self.least)]
        n, all_n, by_suffix = runs.at[at], context.at[at - 1], self.given(length, at, total, vocabulary)
        of = context.index[at - 1]
        terms = np.ones(len(at)), n, np.exp(by_suffix), n * (np.log(n / all_n) - by_suffix)
        sums = np.stack([np.bincount(of, x, len(context.n)) for x in terms])[:, context.n >= self.least]
        # The weight of the suffix's distribution is of use where a next word that does not stay follows in this block.
        after = np.flatnonzero(~self.starts)
        after = after[runs.at[after] < self.least]
        of = context.index[after - 1]
        wanted = np.bincount(of[of >= 0], minlength=len(context.n))[context.n >= self.least] > 0
        sums = np.concatenate([np.where(sums[:1] > 0, context.n[context.n >= self.least], 0.0), sums, wanted[None]])
        ends = np.cumsum([n for _, _, n in known])
        sent = [(bucket, self.row["block"], -length, ids, planes(sums[:, end - n : end].ravel())) for (bucket, ids, n), end in zip(known, ends) if n]
        return as_table(CHUNKS, *(zip(*sent) if sent else [[]] * 5))

    def scores(self, depth: int, total: int, vocabulary: int) -> pa.Table:
        n = self.runs[0].at
        root = base(n, total, vocabulary)
        return pa.table(
            {
                "doc_id": pa.array(self.row["doc_ids"], pa.int64()),
                "held_out": pa.array(self.row["held"], pa.bool_()),
                "n_tokens": self.sizes,
                "n_known": np.add.reduceat((n > 0).astype(np.int64), self.first),
                "train_tokens": np.full(len(self.sizes), total, np.int64),
                "base_score": np.add.reduceat(root, self.first),
                "score": np.add.reduceat(self.log_chances(depth, root), self.first),
            }
        )

    def log_chances(self, depth: int, root: np.ndarray) -> np.ndarray:
        """Log10 probability of each token in the longest state before it; ``root`` has that of the root."""
        total, done = np.zeros(len(root)), np.zeros(len(root), bool)
        for level in range(depth - 1, -1, -1):
            context, runs = self.runs[level], self.runs[level + 1]
            here = np.flatnonzero(~done & ~self.starts)
            rest = context.rest[context.index[here - 1]]
            here, rest = here[~np.isnan(rest)], rest[~np.isnan(rest)]
            some = runs.at[here] >= self.least
            own = here[some]
            total[own] += np.log((runs.at[own] - DISCOUNT) / context.at[own - 1])
            done[own] = True
            total[here[~some]] += rest[~some]
        return total / np.log(10) + np.where(done, 0.0, root)


def first_questions(ranges: int, least: int):
    """Words and pairs of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            block = Block(row, {}, 2, least)
            for length in (1, 2):
                yield from block.count(length, ranges).to_batches()

    return run


def numbers_of(answers: pa.Table) -> dict[int, np.ndarray]:
    """The answers to a block by kind, in the order of its runs."""
    kinds, data = answers.column("kind").to_numpy(), answers.column("numbers").to_pylist()
    order = np.lexsort((answers.column("bucket").to_numpy(), kinds))
    got = {}
    for kind in np.unique(kinds):
        number = np.int64 if kind > 0 else np.float64
        got[int(kind)] = np.concatenate([unplaned(data[i], number) for i in order if kinds[i] == kind])
    return got


def nothing(got: dict[int, np.ndarray], longest: int) -> dict[int, np.ndarray]:
    """Answers of no numbers where a block had nothing to ask."""
    return {x: np.zeros(0, np.int64) for x in range(1, longest + 1)} | {-x: np.zeros(0) for x in range(1, longest)} | got


def questions(length: int, depth: int, ranges: int, least: int, total: int, vocabulary: int):
    """Contexts of a length, the next words of which are counted, and runs two words longer."""

    def run(key, blocks: pa.Table, known: pa.Table) -> pa.Table:
        # Contexts of this length and longer ones are yet without answers.
        got = {k: v for k, v in nothing(numbers_of(known), length + 1).items() if k > -length}
        asked = known.filter(known.column("ids").is_valid()).sort_by("bucket")
        ids = [(*x, int.from_bytes(x[1][:4], "little")) for x in zip(asked.column("bucket").to_pylist(), asked.column("ids").to_pylist())]
        out = [as_table(CHUNKS, *[[]] * 5)]
        for row in rows_of(blocks.to_batches()):
            block = Block(row, got, min(length + 2, depth + 1), least)
            out.append(block.contexts(length, total, vocabulary, ids))
            if length < depth:
                out.append(block.count(length + 2, ranges))
        return pa.concat_tables(out)

    return run


def score_block(depth: int, least: int, total: int, vocabulary: int):
    def run(key, blocks: pa.Table, known: pa.Table) -> pa.Table:
        got = nothing(numbers_of(known), depth + 1)
        return pa.concat_tables([Block(row, got, depth + 1, least).scores(depth, total, vocabulary) for row in rows_of(blocks.to_batches())])

    return run


def whole_counts(each: list[np.ndarray], counts: np.ndarray, least: int, known_from: int) -> tuple[list[np.ndarray], list[bytes]]:
    """For each chunk, twice the whole count of its runs, 0 below ``known_from``, and 1 more where it owns one that stays.

    Also the range's numbers of those that stay.
    """
    keys = np.concatenate(each)
    order, starts = groups(keys)
    n = np.add.reduceat(counts[order], starts)
    # Which of the distinct ones each is; of those equal the first in the order of blocks owns it.
    of = np.empty(len(keys), np.int64)
    of[order] = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(keys)]))
    found = np.where(n >= known_from, 2 * n, 0)[of]
    found[np.minimum.reduceat(order, starts)] += n >= known_from
    number, stay = np.cumsum(n >= least) - 1, (n >= least)[of]
    cuts = np.cumsum([len(x) for x in each])[:-1]
    ids = [steps(number[x[s]]) for x, s in zip(np.split(of, cuts), np.split(stay, cuts))]
    return np.split(found, cuts), ids


def rests(each: list[np.ndarray], sums: np.ndarray) -> list[np.ndarray]:
    """Which contexts are states, and the log weight of the suffix's distribution in them.

    The rows of ``sums``: count of the context; of its next words that stay, how many, their counts, their chances after the
    suffix, and the likelihood they gain; whether the block wants the weight, or 0 in its place.
    """
    ids = np.concatenate(each)
    all_n = np.zeros(ids.max() + 1)
    has = sums[0] > 0
    all_n[ids[has]] = sums[0][has]
    kept, n, by_suffix, gain = (np.bincount(ids[has], x[has], len(all_n)) for x in sums[1:5])
    all_n = np.maximum(all_n, 1)
    left, spare = (np.clip(1 - x, 1e-9, 1.0) for x in (by_suffix, (n - DISCOUNT * kept) / all_n))
    other = np.maximum(all_n - n, 0.0)
    gain = gain + other * (np.log(np.where(other > 0, other, all_n) / all_n) - np.log(left))
    state = (kept > 0) & (gain > 0.5 * kept * np.log(np.maximum(all_n, 2)))
    rest = np.where(state, np.log(spare) - np.log(left), np.nan)
    found = np.where((sums[5] > 0) | np.isnan(rest[ids]), rest[ids], 0.0)
    return np.split(found, np.cumsum([len(x) for x in each])[:-1])


def answers(depth: int, least: int):
    """Adds up what the blocks sent to a range."""

    def run(table: pa.Table) -> pa.Table:
        out = []
        for kind in np.unique(table.column("kind").to_numpy()).tolist():
            sent = table.filter(pa.compute.equal(table.column("kind"), kind)).sort_by("block")
            key, number = (np.uint64, np.int64) if kind > 0 else (np.int64, np.float64)
            each = [summed(x, key) for x in sent.column("keys").to_pylist()]
            numbers = np.concatenate([unplaned(x, number).reshape(-1, len(k)) for x, k in zip(sent.column("numbers").to_pylist(), each)], axis=1)
            ids, owned = [None] * len(each), [0] * len(each)
            if kind > 0:
                found, known = whole_counts(each, numbers[0], least, least if kind > 1 else 1)
                ids, owned = known if kind <= depth else ids, [int((x & 1).sum()) for x in found]
            else:
                found = rests(each, numbers)
            same = [sent.column(x).to_pylist() for x in ("bucket", "block", "kind")]
            out.append(as_table(ANSWERS, *same, [planes(x) for x in found], ids, owned))
        return pa.concat_tables(out)

    return run


def score(docs: DataFrame, depth: int = DEPTH, least: int = LEAST) -> DataFrame:
    """Scores of every row under the tree learnt from the rows that are not held out."""
    spark = docs.sparkSession
    blocks = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(to_blocks, BLOCKS)
    with arrow_batches(spark, BATCH), shuffles_dropped(spark):
        blocks = dealt(blocks, "block")
        size, total = blocks.agg(*(F.coalesce(F.sum(x), F.lit(0)) for x in ("size", "learnt"))).first()
        ranges = max(RANGES, size // BLOCK)
        asked = blocks.mapInArrow(first_questions(ranges, least), CHUNKS)
        known, vocabulary = [], 0
        for length in range(1, depth + 2):
            known.append(stored(asked.groupBy("bucket").applyInArrow(answers(depth, least), ANSWERS), "answers"))
            if length == 1:
                vocabulary = known[0].where("kind = 1").agg(F.coalesce(F.sum("owned"), F.lit(0))).first()[0]
            ids = F.when(F.col("kind") == length, F.col("ids")).alias("ids")
            to_block = reduce(DataFrame.unionByName, known).select("bucket", "block", "kind", "numbers", ids).groupBy("block")
            if length <= depth:
                asked = blocks.groupBy("block").cogroup(to_block).applyInArrow(questions(length, depth, ranges, least, total, vocabulary), CHUNKS)
    return blocks.groupBy("block").cogroup(to_block).applyInArrow(score_block(depth, least, total, vocabulary), SCORES)
