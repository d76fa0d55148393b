"""Quality classifier from weak labels.

Heuristic labellers that overlap and abstain vote on every document. Expectation-maximisation over the
vote patterns estimates how each labeller votes on good and on bad documents (its accuracy), and with
that the posterior that a document is good. The posteriors of a bounded sample then train a linear
scorer over hashed word features, which scores every whole text; no label table is read.

The votes of all documents are counted by pattern (at most three to the number of labellers), so what
the driver fits is bounded. The scorer learns from about ``SAMPLE`` documents, by a hash of the id.

Defined results: null and empty texts get the votes of no words; null ids stay null; repeated rows are
scored each; an empty table gives no row; extra columns are left out.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm.components import stored
from tidewell.llm.text import Bounded, raw, struct_udf, value_udf, words
from tidewell.session import parallelism

SAMPLE = 10_000
SPACE = 1 << 14
SCALE = 8.0
SYMBOLS = b"#*$%&|<>{}[]\\^~=_@"
UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123))

MEASURES = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "n_unique", "n_same", "n_symbols", "n_letters", "n_upper", "n_ends", "n_lines", "n_dup")]
)

# Labeller: what makes it vote bad, what makes it vote good; it abstains otherwise.
LABELLERS: tuple[tuple[str, str, str], ...] = (
    ("symbols", "10 * n_symbols > n_words", "20 * n_symbols <= n_words"),
    ("capitals", "n_letters >= 20 AND 2 * n_upper > n_letters", "n_letters >= 20 AND 5 * n_upper <= n_letters"),
    ("same_word_again", "10 * n_same > n_words", "n_words >= 20 AND 50 * n_same <= n_words"),
    ("variety", "n_words >= 50 AND 5 * n_unique < n_words", "n_words >= 20 AND 2 * n_unique > n_words"),
    ("sentences", "n_words >= 30 AND n_ends = 0", "n_ends > 0 AND 60 * n_ends >= n_words"),
    ("lines_again", "3 * n_dup > n_lines", "false"),
    ("length", "n_words < 5", "n_words >= 40"),
)


def measure(text: bytes) -> tuple[int, ...]:
    found = words(text)
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (
        len(found),
        len(set(found)),
        sum(a == b for a, b in zip(found, found[1:])),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(text) - len(text.translate(None, LETTERS)),
        len(text) - len(text.translate(None, UPPER)),
        sum(w[-1] in b".!?" for w in found),
        len(lines),
        len(lines) - len(set(lines)),
    )


def pattern() -> Column:
    """Votes in base three, first labeller lowest: 0 bad, 1 abstains, 2 good."""
    total = F.lit(0)
    for i, (_, bad, good) in enumerate(LABELLERS):
        total = total + F.when(F.expr(bad), 0).when(F.expr(good), 2).otherwise(1) * 3**i
    return total.cast("long")


def votes_of(patterns: np.ndarray) -> np.ndarray:
    return np.stack([patterns // 3**i % 3 for i in range(len(LABELLERS))], axis=1)


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of good for each pattern, and for class (bad, good), labeller, vote its probability.

    Starts from the votes' majority, which says which class is good.
    """
    votes = votes_of(patterns)
    good = 1 / (1 + np.exp(-(votes - 1).sum(axis=1).astype(float)))
    table = np.empty((2, votes.shape[1], 3))
    for _ in range(rounds):
        share = np.clip((good * counts).sum() / counts.sum(), 1e-3, 1 - 1e-3)
        for y, weight in enumerate((counts * (1 - good), counts * good)):
            for i in range(votes.shape[1]):
                seen = np.bincount(votes[:, i], weight, 3) + 1.0
                table[y, i] = seen / seen.sum()
        each = np.log(table)[:, np.arange(votes.shape[1]), votes].sum(axis=2)
        now = 1 / (1 + np.exp(np.clip(each[0] - each[1] + np.log(1 - share) - np.log(share), -50, 50)))
        if np.abs(now - good).max() < 1e-9:
            break
        good = now
    return good, table


def accuracies(table: np.ndarray) -> dict[str, float]:
    """Share of each labeller's votes that fit the class, abstentions aside, classes weighing the same."""
    hit, miss = table[0, :, 0] + table[1, :, 2], table[0, :, 2] + table[1, :, 0]
    return {name: float(h / (h + m)) for (name, _, _), h, m in zip(LABELLERS, hit, miss)}


def word_features(word: bytes) -> tuple[int, ...]:
    """Hashed features of a word: shape, length, ends, characters other than letters."""
    shape = re.sub(rb"[a-z\x80-\xff]+", b"a", re.sub(rb"[A-Z]+", b"A", re.sub(rb"[0-9]+", b"0", word)))
    own = [b"s" + shape, b"l%d" % min(len(word), 20), b"e" + word[-2:], b"p" + re.sub(rb"[A-Za-z0-9\x80-\xff]", b"", word)]
    return tuple(zlib.crc32(x) % SPACE for x in own)


def text_features(found: list[bytes]) -> tuple[int, ...]:
    """Hashed features of the whole text: how often words come again, at once and at all."""
    n = max(1, len(found))
    again = 10 * sum(a == b for a, b in zip(found, found[1:])) // n
    return zlib.crc32(b"again%d" % again) % SPACE, zlib.crc32(b"unique%d" % (10 * len(set(found)) // n)) % SPACE


def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    of = Bounded(word_features, 200_000)
    for batch in batches:
        at, values = [], []
        for text in raw(batch.column(1)):
            found = words(text)
            own = Counter(f for w in found for f in of[w])
            scaled = {k: SCALE * v / len(found) for k, v in own.items()}
            for k in text_features(found):
                scaled[k] = scaled.get(k, 0.0) + 1.0
            at.append(list(scaled))
            values.append(list(scaled.values()))
        columns = [batch.column(0), pa.array(at, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))]
        yield pa.RecordBatch.from_arrays(columns, names=["posterior", "at", "values"])


def fit(table: pa.Table, steps: int = 200, rate: float = 0.2, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Logistic regression on posteriors."""
    weights, bias = np.zeros(SPACE), 0.0
    if not table.num_rows:
        return weights, bias
    goal = table.column("posterior").to_numpy()
    lists = table.column("at").combine_chunks()
    row = np.repeat(np.arange(len(goal)), lists.value_lengths().to_numpy(zero_copy_only=False))
    at, value = lists.flatten().to_numpy(), table.column("values").combine_chunks().flatten().to_numpy().astype(float)
    first, second = np.zeros(SPACE + 1), np.zeros(SPACE + 1)
    for step in range(1, steps + 1):
        z = np.bincount(row, weights[at] * value, len(goal)) + bias
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - goal) / len(goal)
        gradient = np.append(np.bincount(at, g[row] * value, SPACE) + decay * weights, g.sum())
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        weights, bias = weights - move[:-1], bias - float(move[-1])
    return weights, bias


def scorer(held):
    def make():
        weights, bias = held.value
        of = Bounded(lambda w: float(sum(weights[f] for f in word_features(w))))

        def score(text: bytes) -> float:
            found = words(text)
            z = bias + SCALE * sum(map(of.__getitem__, found)) / max(1, len(found)) + sum(weights[f] for f in text_features(found))
            return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

        return score

    return make


def classify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, votes, posterior, score, predicted`` of every row."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    measured = docs.select("doc_id", struct_udf(lambda: measure, MEASURES)(F.col("text")).alias("m"), F.xxhash64("doc_id", F.lit(5)).alias("order"), "text")
    voted = measured.select("doc_id", "text", "order", "m.*").select("doc_id", "text", "order", pattern().alias("votes"))
    counts = voted.groupBy("votes").count().orderBy("votes").toArrow()
    patterns, n = counts.column("votes").to_numpy(), counts.column("count").to_numpy()
    if len(patterns):
        good, _ = expectation_maximisation(patterns, n)
    else:
        good = np.empty(0)
    posterior = dict(zip(patterns.tolist(), good.tolist()))
    known = F.create_map(*(F.lit(x) for pair in posterior.items() for x in pair)) if posterior else F.create_map(F.lit(0).cast("long"), F.lit(0.5))
    total = int(n.sum())
    part = F.pmod("order", F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, sample / max(1, total))))
    learn = voted.where(part).select(known[F.col("votes")].alias("posterior"), "text", "order").repartition(parallelism(spark, 8), "order").drop("order")
    table = stored(learn.mapInArrow(sparse, "posterior double, at array<int>, values array<float>"), "weak-sample").toArrow()
    held = spark.sparkContext.broadcast(fit(table))
    scored = voted.select("doc_id", "votes", known[F.col("votes")].alias("posterior"), value_udf(scorer(held), T.DoubleType())(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
