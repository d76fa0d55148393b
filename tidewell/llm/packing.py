"""Best-fit-decreasing packing of documents into token sequences.

Every document is its token ids and one end id. An overlong document is first cut into full
windows, which are sequences by themselves; what is left of each document is packed, longest piece
first, into the tightest open sequence it fits. A segment tree over remaining capacities finds that
sequence.

Remainders are dealt into groups of ``GROUP_PIECES`` at most by a hash, and each group is packed by
one task: groups are of one size at any scale, and each wastes at most part of a sequence. Only the
pieces' numbers are shuffled, never texts or ids, unless ``keep_ids`` asks for the ids.

Defined results: a null or empty text is the end id alone; null ids stay null; repeated rows are
packed one by one; an empty table gives no piece; extra columns are left out.
"""

from __future__ import annotations

import math
import os
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.text import Bounded, raw
from tidewell.session import fresh_dir

LENGTH = 2048
END = 1
GROUP_PIECES = 65_536
MOST_FILE = 64 << 20
KNOWN = 1_500_000
# ASCII marks other than the apostrophe.
MARKS = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum() and chr(i) != "'")

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, piece long"


def as_bytes(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def only_letters(run: str) -> bool:
    """Whether the run has letters only, also in composed lower case."""
    return run.isalpha() and (run.isascii() or unicodedata.normalize("NFC", unicodedata.normalize("NFC", run).lower()).isalpha())


class Encoder:
    """Token ids of a text as little-endian unsigned 32-bit numbers.

    The tokenizer drops white space and never joins what a space or line end parts, so each run
    between them is encoded once and remembered.
    """

    def __init__(self, model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        vocabulary = self.tokenizer.get_vocab()
        # Where the model marks the last token of a word, words encoded in one text can be told apart.
        self.last = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[str, bytes] = Bounded(self.encode, KNOWN)

    def encode(self, run: str) -> bytes:
        return as_bytes(self.tokenizer.encode(run, add_special_tokens=False).ids)

    def learn(self, texts: list[str]) -> None:
        """Encode the new runs of a batch together, as far as there is room for them.

        Letters and ASCII marks after them are tokenised apart, so such runs follow from their letters and marks, if the
        letters are letters still when the tokenizer has normalised them: a combining mark would stay with what
        follows. An apostrophe may begin a contraction, so runs with one are encoded whole.
        """
        new = [run for run in set().union(*(t.split(" ") for t in texts)) if run not in self.known]
        if len(self.known) + 3 * len(new) > self.known.most:
            self.known.clear()
        words, others, ended = set(), set(), []
        for run in new:
            letters = run if run.isalpha() else run.rstrip(MARKS)
            if not letters or not only_letters(letters):
                others.add(run)
                continue
            words.add(letters)
            if letters is not run and len(letters) < len(run):
                others.add(run[len(letters) :])
                ended.append((run, letters))
        self.learn_words([x for x in words if x not in self.known][: self.known.most // 3])
        self.learn_runs([x for x in others if x not in self.known][: self.known.most // 3])
        for run, letters in ended:
            self.known[run] = self.known[letters] + self.known[run[len(letters) :]]

    def learn_words(self, words: list[str], each: int = 500) -> None:
        """Words of letters only, many in one text; should their ends not tell them apart, one by one."""
        lines = [words[i : i + each] for i in range(0, len(words), each)]
        for line, e in zip(lines, self.tokenizer.encode_batch_fast([" ".join(x) for x in lines], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            ends = 4 * (np.flatnonzero(self.last[ids]) + 1)
            if len(ends) != len(line) or (len(ends) and ends[-1] != ids.nbytes):
                self.learn_runs(line)
                continue
            data, at = ids.tobytes(), 0
            for word, end in zip(line, ends.tolist()):
                self.known[word] = data[at:end]
                at = end

    def learn_runs(self, runs: list[str]) -> None:
        for i in range(0, len(runs), 20_000):
            part = runs[i : i + 20_000]
            for run, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                self.known[run] = as_bytes(e.ids)

    def __call__(self, text: str) -> bytes:
        return b"".join(map(self.known.__getitem__, text.split(" ")))


# The encoder of a worker process: what one task has learnt serves the next.
_ENCODER: dict[str, Encoder] = {}


def encoder_of(model: str) -> Encoder:
    if model not in _ENCODER:
        _ENCODER.clear()
        _ENCODER[model] = Encoder(model)
    return _ENCODER[model]


def prepared(text: bytes) -> str:
    """The text with line ends as spaces and A to Z in lower case, which the tokenizer does too.

    Texts with marks that combine with letters, or with special tokens' beginnings, keep their case.
    """
    if not any(x in text for x in (b"<|", b"\xcc", b"\xcd")):
        text = text.lower()
    return text.decode("utf-8", "replace").replace("\n", " ")


def cut(n: int, most: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of n ids: full windows, then the rest."""
    return [(s, min(most, n - s)) for s in range(0, n, most)]


def to_pieces(model, length: int, end: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(model.value)
        last = as_bytes([end])
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [prepared(x) for x in raw(part.column(1))]
                encoder.learn(texts)
                rows = []
                for doc_id, text in zip(part.column(0).to_pylist(), texts):
                    tokens = encoder(text) + last
                    n = len(tokens) // 4
                    for start, size in cut(n, length):
                        own = tokens[4 * start : 4 * (start + size)]
                        rows.append((doc_id, start, size, zlib.crc32(own), n, number, np.frombuffer(own, "<u4") if keep_ids else None))
                        number += 1
                columns = [pa.array(c, pa.int64()) for c in list(zip(*rows))[:6]]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "piece"]
                if keep_ids:
                    columns.append(pa.array([r[6].astype(np.int64) for r in rows], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


class TightestFit:
    """Open sequences by remaining capacity, in a segment tree that counts them."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, sequence: int) -> None:
        self.open[room].append(sequence)
        at = room + self.leaves
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, room: int) -> tuple[int, int] | None:
        """The least remaining capacity of ``room`` or more that a sequence has, and that sequence."""
        at = room + self.leaves
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        found = at - self.leaves
        while at:
            self.count[at] -= 1
            at >>= 1
        return found, self.open[found].pop()


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece; pieces come longest first."""
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    tree, made = TightestFit(capacity), 0
    for i, n in enumerate(lengths.tolist()):
        found = tree.take(n)
        room, at = found if found else (capacity, made)
        made += not found
        sequence[i], offset[i] = at, capacity - room
        if room > n:
            tree.add(room - n, at)
    return sequence, offset


def pack_group(capacity: int):
    def run(pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values(["length", "piece"], ascending=[False, True], ignore_index=True)
        sequence, pieces["offset"] = best_fit_decreasing(pieces["length"].to_numpy(), capacity)
        pieces["sequence_id"] = (pieces["group"] * (1 << 24) + sequence) * 2
        return pieces.drop(columns="group")

    return run


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END, group_pieces: int = GROUP_PIECES, keep_ids: bool = False) -> DataFrame:
    """One row a piece: where it lies in its document and in its sequence.

    ``tokenizer`` is the path of a tokenizers file; its bytes (checked to be small) go to the tasks,
    so executors need not have the file. Pieces are written below the shared folder once, with the
    number that dealt them out, so a task that runs again finds the same pieces. Full windows have
    odd sequence ids, packed sequences even ones.
    """
    spark = docs.sparkSession
    if os.path.getsize(tokenizer) > MOST_FILE:
        raise ValueError("the tokenizer file is too large to send to every task")
    with open(tokenizer, encoding="utf-8") as f:
        model = spark.sparkContext.broadcast(f.read())
    schema = PIECES + (", ids array<long>" if keep_ids else "")
    path = fresh_dir(spark, "pieces")
    docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(to_pieces(model, length, end, keep_ids), schema).write.parquet(path)
    pieces = spark.read.schema(schema).parquet(path)
    full = pieces.where(F.col("length") == length).withColumns({"offset": F.lit(0).cast("long"), "sequence_id": F.col("piece") * 2 + 1})
    rest = pieces.where(F.col("length") < length)
    groups = max(1, math.ceil(rest.count() / (group_pieces / 1.25)))
    dealt = rest.withColumn("group", F.pmod(F.xxhash64("piece"), F.lit(groups)))
    packed = dealt.groupBy("group").applyInPandas(pack_group(length), f"{schema}, offset long, sequence_id long")
    return full.unionByName(packed).drop("piece")
