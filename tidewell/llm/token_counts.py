"""Token counts under a unigram vocabulary, by dynamic programming shared over a trie.

The best segmentation of a pre-token maximises the sum of its pieces' scores (ties: fewer pieces). The
best score of a prefix depends on the prefix alone, so distinct pre-tokens are taken as the paths of a
trie and each prefix's forward score is computed once, however many pre-tokens share it; at the end of a
pre-token its count is kept. The trie is walked depth first, which is the order of the sorted
pre-tokens: the scores along the current path are its stack, so no node is held longer than needed.

Texts are cut into pre-tokens once, into blocks of about ``BLOCK`` words written below the shared folder: a block
lists its distinct pre-tokens and, for each document, their numbers. The distinct pre-tokens of all blocks are dealt
out by their first characters: short ones by the first three, longer ones by more, so that the many
long ones with one start (addresses, say) part. One trie is walked for each share, and the counts at its ends go back to
the blocks that have the pre-tokens. A share holds its distinct pre-tokens in memory, shares are as many as ``SHARE``
pre-tokens each ask for, and neither texts nor documents' words are shuffled one by one.

Pre-tokens are words with the vocabulary's word mark in front. Characters that no piece covers are
counted as their UTF-8 bytes. Pieces are scored by their rank, ``-ln(rank + 1)``, as in Zipf's law.

Defined results: null and empty texts have no tokens; null ids stay null; repeated rows are counted each;
an empty table gives no row; extra columns are left out.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.components import arrow_batches, shuffles_dropped, stored
from tidewell.llm.suffix_tree import Numbered, documents_of, packed, rows_of, unpacked
from tidewell.llm.text import words

MARK = "▁"
UNKNOWN = 20.0
MOST_FILE = 64 << 20

BLOCK = 1 << 20
SHARE = 200_000
STARTS = (3, 12, 24, 48)
BATCH = "4m"

# ``hashes`` are those of the starts, in ascending order; ``words`` are in the order of ``hashes``, then of the words.
BLOCKS = "block long, doc_ids array<long>, sizes array<long>, tokens binary, n_words long, hashes binary, words binary"
CHUNKS = "share long, block long, first long, words binary"
ENDS = "block long, first long, counts binary"
RESULT = "doc_id long, n_words long, n_tokens long"


def vocabulary(path: str) -> dict[str, float]:
    """Scores of the ordinary pieces of a SentencePiece model."""
    from sentencepiece import SentencePieceProcessor

    if os.path.getsize(path) > MOST_FILE:
        raise ValueError("the vocabulary file is too large to send to every task")
    model = SentencePieceProcessor(model_file=path)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return {model.id_to_piece(i): -math.log(rank + 1) for rank, i in enumerate(plain)}


def trie_counts(tokens: Iterable[str], scores: dict[str, float]) -> dict[str, int]:
    """Pieces in the best segmentation of each distinct token."""
    longest = max(map(len, scores), default=1)
    out: dict[str, int] = {}
    # Along the path from the root: score and pieces of the best segmentation of each prefix.
    best: list[tuple[float, int]] = [(0.0, 0)]
    path = ""
    for token in sorted(set(tokens)):
        shared = 0
        for a, b in zip(path, token):
            if a != b:
                break
            shared += 1
        del best[shared + 1 :]
        for end in range(shared + 1, len(token) + 1):
            n = len(token[end - 1].encode("utf-8", "surrogatepass"))
            score, pieces = best[end - 1]
            top = (score - UNKNOWN * n, -(pieces + n))
            for start in range(max(0, end - longest), end):
                own = scores.get(token[start:end])
                if own is not None:
                    score, pieces = best[start]
                    top = max(top, (score + own, -(pieces + 1)))
            best.append((top[0], -top[1]))
        out[token] = best[-1][1]
        path = token
    return out


def start_hash(word: bytes) -> int:
    """Hash of the first characters: of the longest of ``STARTS`` that a word is longer than, else of the whole word."""
    text = word.decode("utf-8", "replace")
    cut = max((n for n in STARTS if n < len(text)), default=len(text))
    return xxhash.xxh32_intdigest(text[:cut].encode(), 7)


def block_row(number: int, ids: list, texts: list[np.ndarray], known: Numbered) -> pa.RecordBatch:
    """A block, its words numbered by the hash of their start, then by the word."""
    found = list(known)
    hashes = list(map(start_hash, found))
    order = sorted(range(len(found)), key=lambda i: (hashes[i], found[i]))
    new = np.empty(len(found), np.int32)
    new[order] = np.arange(len(found), dtype=np.int32)
    # The order of words in a document does not matter to its sum, and sorted numbers take less room.
    tokens = np.concatenate([np.sort(new[x]) for x in texts])
    sorted_hashes = np.array([hashes[i] for i in order], np.uint32)
    words_ = pa.compress(b" ".join(found[i] for i in order), codec="zstd", asbytes=True)
    size = sum(map(len, found)) + max(0, len(found) - 1)
    values = [number, ids, [len(x) for x in texts], packed(tokens), len(found), packed(sorted_hashes), size.to_bytes(8, "little") + words_]
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.int64(), pa.binary(), pa.binary()]
    names = [x.split()[0] for x in BLOCKS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], names=names)


def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number, ids, texts, known, size = TaskContext.get().partitionId() << 32, [], [], Numbered(), 0
    for batch in batches:
        for doc_id, text in documents_of(batch):
            found = words(text)
            ids.append(doc_id)
            texts.append(np.fromiter(map(known.__getitem__, found), np.int32, len(found)))
            size += len(found)
            if size >= BLOCK:
                yield block_row(number, ids, texts, known)
                number, ids, texts, known, size = number + 1, [], [], Numbered(), 0
    if ids:
        yield block_row(number, ids, texts, known)


def joined_words(data: bytes) -> list[bytes]:
    text = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    return text.split(b" ") if text else []


def to_shares(shares: int):
    """The distinct words of each block, one chunk a share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches, "block", "n_words", "hashes", "words"):
            found = joined_words(row["words"])
            hashes = unpacked(row["hashes"], np.uint32, row["n_words"]).astype(np.uint64)
            share = ((hashes * np.uint64(shares)) >> np.uint64(32)).astype(np.int64)
            firsts = np.flatnonzero(np.r_[True, share[1:] != share[:-1]][: len(share)])
            cut = [found[a:b] for a, b in zip(firsts, [*firsts[1:], len(found)])]
            texts = [b" ".join(x) for x in cut]
            sent = [len(x).to_bytes(8, "little") + pa.compress(x, codec="zstd", asbytes=True) for x in texts]
            columns = [share[firsts], np.full(len(firsts), row["block"]), firsts.astype(np.int64)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(sent, pa.binary())], names=["share", "block", "first", "words"])

    return run


def ends_of(held):
    """One trie for the words of a share; the counts at their ends, in the order of each chunk."""

    def run(table: pa.Table) -> pa.Table:
        chunks = table.column("words").to_pylist()
        distinct: set[bytes] = set()
        for chunk in chunks:
            distinct.update(joined_words(chunk))
        marked = {w: MARK + w.decode("utf-8", "replace") for w in distinct}
        counts = trie_counts(marked.values(), held.value)
        of = {w: counts[m] for w, m in marked.items()}
        sent = [np.fromiter(map(of.__getitem__, joined_words(x)), np.int64).tobytes() for x in chunks]
        return pa.table([table.column("block"), table.column("first"), pa.array(sent, pa.binary())], names=["block", "first", "counts"])

    return run


def sums(key, blocks: pa.Table, ends: pa.Table) -> pa.Table:
    """Words and tokens of each document of a block."""
    out = [pa.table([pa.array([], pa.int64())] * 3, names=["doc_id", "n_words", "n_tokens"])]
    for row in rows_of(blocks.to_batches()):
        counts = np.zeros(row["n_words"], np.int64)
        for first, data in zip(ends.column("first").to_pylist(), ends.column("counts").to_pylist()):
            part = np.frombuffer(data, np.int64)
            counts[first : first + len(part)] = part
        sizes = np.array(row["sizes"], np.int64)
        upto = np.r_[0, np.cumsum(counts[unpacked(row["tokens"], np.int32, int(sizes.sum()))])]
        last = np.cumsum(sizes)
        columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(sizes), pa.array(upto[last] - upto[last - sizes])]
        out.append(pa.table(columns, names=["doc_id", "n_words", "n_tokens"]))
    return pa.concat_tables(out)


def token_counts(docs: DataFrame, vocabulary_path: str, share: int = SHARE) -> DataFrame:
    """``doc_id, n_words, n_tokens`` of every row."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(vocabulary(vocabulary_path))
    with arrow_batches(spark, BATCH), shuffles_dropped(spark):
        blocks = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(to_blocks, BLOCKS)
        blocks = stored(blocks, "token-blocks")
        shares = math.ceil((blocks.agg(F.sum("n_words")).first()[0] or 1) / share)
        chunks = blocks.mapInArrow(to_shares(shares), CHUNKS)
        ends = stored(chunks.groupBy("share").applyInArrow(ends_of(held), ENDS), "token-ends")
    blocks = blocks.select("block", "doc_ids", "sizes", "tokens", "n_words")
    return blocks.groupBy("block").cogroup(ends.groupBy("block")).applyInArrow(sums, RESULT)
