"""Toxicity scorer by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; every other text is unlabelled, toxic ones among them. A linear
numpy classifier is trained on the class-prior-corrected risk
``pi R+(positive) + max(0, R-(unlabelled) - pi R-(positive))``: when the part in the maximum falls below
zero its gradient is turned round, which keeps the classifier from treating hidden positives as clean.

Features are byte runs of words with marked ends, hashed, in one, two, three or five distinct words of a text
(``LEVELS``): what a text has once by chance, a text about it has in many words. A first pass counts in how many
positive and unlabelled texts each feature is found; the class prior turns the two shares into the share among clean
texts. A feature is chosen by the likelihood ratio of its count among the positives against that
share, which must exceed the log of the number of features tried at its level, less ``SLACK``; so a feature that three
toxic texts of a small language share is taken, if hardly any clean text has it. How much the weights are
shrunk is chosen by cross-validation: parts of the sampled texts are left out in turn, features that the rest alone would not
choose are left out with them, and the decay of the least non-negative risk, in errors, is taken.

The positives are those of at most ``SAMPLE`` ids, by a hash of the id. Features are counted over all texts. Only the
fit takes samples, at most ``SAMPLE`` positive and ``SAMPLE`` unlabelled texts by a hash of id and text, equal rows being
one with a weight; scoring takes every whole text. The ids and the sample's rows of chosen features are what the
driver holds, bounded by ``SAMPLE`` and ``FEATURES`` whatever repeats.

Defined results: null and empty texts get the score of no feature; an id that any label row calls toxic
is toxic; null labels and label rows of unknown ids count for nothing; without positives every score
is the prior's; repeated rows are scored one by one; an empty table gives no row.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm.components import stored
from tidewell.llm.text import fold, raw, value_udf, words
from tidewell.session import parallelism

SAMPLE = 10_000
FEATURES = 1024
LEVELS = (1, 2, 3, 5)
LEAST_TEXTS = 3
SLACK = 1.0
DECAYS = (0.001, 0.002, 0.004, 0.008)
PARTS = 4
SPACE = 1 << 20
RUNS = (3, 4, 5, 6)
PRIOR = 0.1
KNOWN = 400_000
STEP = 128
LETTERS = re.compile(r"[^\W\d_]+")


# By byte, what it does to a CRC-32: worked out from the CRC of one byte.
CRC = np.array([zlib.crc32(bytes([b ^ 0xFF])) for b in range(256)], np.uint32) ^ np.uint32(0xFF000000)


def hashed(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of words, as the word's place in the list and the feature, some of them twice.

    They are the word's runs of letters, with marked ends, and the byte runs of those.
    """
    cores, owners = [], []
    for i, word in enumerate(found):
        if word.isalpha():
            cores.append(b"^%b$" % word.lower())
            owners.append(i)
            continue
        for core in LETTERS.findall(word.decode("utf-8", "replace").lower()):
            cores.append(b"^%b$" % core.encode())
            owners.append(i)
    sizes, owner = np.array([len(c) for c in cores], np.int64), np.array(owners, np.int64)
    places, values = [owner], [np.fromiter(map(zlib.crc32, cores), np.uint32, len(cores))]
    letters = np.frombuffer(b"".join(cores), np.uint8)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(letters))
    of_letter = np.repeat(owner, sizes)
    # The CRC of the run from each letter on, one letter longer each time.
    state = np.full(len(letters), 0xFFFFFFFF, np.uint32)
    for n in range(1, max(RUNS) + 1):
        state = state[: max(0, len(letters) - n + 1)]
        state = CRC[(state ^ letters[n - 1 :]) & 0xFF] ^ (state >> 8)
        if n in RUNS:
            inside = left[: len(state)] >= n
            places.append(of_letter[: len(state)][inside])
            values.append(~state[inside])
    return np.concatenate(places), np.concatenate(values) & np.uint32(SPACE - 1)


def leveled(found: np.ndarray) -> np.ndarray:
    """Features of a text by level, from those of its words."""
    value, n = np.unique(found, return_counts=True)
    return np.concatenate([value[n >= least].astype(np.int64) + SPACE * i for i, least in enumerate(LEVELS)])


class Seen:
    """What of the words of a text matters, each word worked out once while there is room.

    ``place`` has a number for each feature by level that matters, and -1 for all others.
    """

    def __init__(self, place: np.ndarray):
        self.place, self.any = place, (place.reshape(len(LEVELS), SPACE) >= 0).any(axis=0)
        self.known, self.useful = set(), {}

    def __call__(self, text: bytes) -> set[int]:
        found = set(words(text))
        new = found - self.known
        if len(self.known) + len(new) > KNOWN:
            self.known, self.useful, new = set(), {}, found
        if new:
            listed = list(new)
            word, feature = hashed(listed)
            hit = self.any[feature]
            for w, f in zip(word[hit].tolist(), feature[hit].tolist()):
                self.useful.setdefault(listed[w], []).append(f)
            self.known |= new
        own = [f for w in self.useful.keys() & found for f in self.useful[w]]
        places = self.place[leveled(np.array(own, np.int64))] if own else np.zeros(0, np.int64)
        return set(places[places >= 0].tolist())


def places(chosen: list[int]) -> np.ndarray:
    """Place of each chosen feature, by feature and level."""
    out = np.full(SPACE * len(LEVELS), -1, np.int32)
    out[np.array(chosen, np.int64)] = np.arange(len(chosen))
    return out


def features(texts: list[bytes]) -> Iterator[np.ndarray]:
    """Features of each text by level; words that texts share are hashed once."""
    found = [set(words(x)) for x in texts]
    number = {w: i for i, w in enumerate(set().union(*found))}
    place, feature = hashed(list(number))
    feature = feature[np.argsort(place, kind="stable")]
    sizes = np.bincount(place, minlength=len(number))
    starts = np.cumsum(sizes) - sizes
    for own in found:
        at = np.fromiter(map(number.__getitem__, own), np.int64, len(own))
        n = sizes[at]
        yield leveled(feature[np.repeat(starts[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())])


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with each feature, among the positive and the unlabelled texts of a task."""
    totals = np.zeros((2, SPACE * len(LEVELS)), np.int32)
    for batch in batches:
        for at in range(0, batch.num_rows, STEP):
            part = batch.slice(at, STEP)
            for positive, unlabelled, own in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), features(raw(part.column(2)))):
                totals[1, own] += unlabelled
                if positive:
                    totals[0, own] += positive
    some = np.flatnonzero(totals.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(t[some].astype(np.int64)) for t in totals)], names=["feature", "p", "u"])


def chosen_rows(chosen: list[int]):
    """Places of the chosen features that each sampled text has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Seen(places(chosen))
        for batch in batches:
            rows = [sorted(of(x)) for x in raw(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.int32()))], names=["positive", "unlabelled", "places"])

    return run


@dataclass
class Model:
    weights: dict[int, float]
    bias: float


def fit(rows: list, width: int, prior: float, decay: float, steps: int = 300, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk; ``rows`` are (positive, unlabelled, places)."""
    weights, bias = np.zeros(width), float(np.log(prior / (1 - prior)))
    positive = np.array([r[0] for r in rows], float)
    unlabelled = np.array([r[1] for r in rows], float)
    if not positive.sum() or not unlabelled.sum():
        return weights, bias
    sizes = [len(r[2]) for r in rows]
    row = np.repeat(np.arange(len(rows)), sizes)
    place = np.concatenate([np.asarray(r[2], np.int64) for r in rows])
    positive, unlabelled = positive / positive.sum(), unlabelled / unlabelled.sum()
    first, second = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, steps + 1):
        z = np.bincount(row, weights[place], len(rows)) + bias
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        as_clean = np.logaddexp(0, z)
        rest = (unlabelled * as_clean).sum() - prior * (positive * as_clean).sum()
        towards = -prior * positive * (1 - p) if rest >= 0 else 0.0
        pull = (1 if rest >= 0 else -1) * (unlabelled - prior * positive) * p
        g = towards + pull
        gradient = np.append(np.bincount(place, g[row], width) + decay * weights, g.sum())
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        weights, bias = weights - move[:-1], bias - float(move[-1])
    return weights, bias


def ratio(p: np.ndarray, n_p: float, clean: np.ndarray) -> np.ndarray:
    """Log likelihood ratio of counts among the positives, against what the clean share explains."""
    return p * np.log(np.maximum(p, 1e-9) / (n_p * clean)) - (p - n_p * clean)


def best_decay(rows: list, clean: np.ndarray, least: np.ndarray, prior: float) -> float:
    """The decay whose classifiers err least on what they have not seen; ``least`` is what each feature's ratio must exceed.

    Texts with the same features are left out together. With equal risks the larger decay is taken, and so it is where the
    positives are too few to be parted.
    """
    part = np.array([zlib.crc32(np.asarray(r[2], np.int64).tobytes()) % PARTS for r in rows])
    positive, unlabelled = np.array([r[0] for r in rows], float), np.array([r[1] for r in rows], float)
    if len(set(part[positive > 0])) < PARTS:
        return max(DECAYS)
    called = np.zeros((len(DECAYS), len(rows)), bool)
    for left_out in range(PARTS):
        kept = np.flatnonzero(part != left_out)
        p = np.zeros(len(clean))
        for i in kept[positive[kept] > 0]:
            p[rows[i][2]] += positive[i]
        use = (p >= LEAST_TEXTS) & (ratio(p, positive[kept].sum(), clean) > least)
        seen = [(r[0], r[1], [f for f in r[2] if use[f]]) for r in rows]
        for d, decay in enumerate(DECAYS):
            weights, bias = fit([seen[i] for i in kept], len(clean), prior, decay, steps=150)
            for i in np.flatnonzero(part == left_out):
                called[d, i] = bias + weights[seen[i][2]].sum() >= 0 if seen[i][2] else bias >= 0
    hit, all_called = called @ positive / positive.sum(), called @ unlabelled / unlabelled.sum()
    risk = prior * (1 - hit) + np.maximum(0, all_called - prior * hit)
    return max(d for d, r in zip(DECAYS, risk) if r <= risk.min() + 1e-12)


def learning(docs: DataFrame, labels: DataFrame, sample: int) -> tuple[DataFrame, float]:
    """All training texts as ``doc_id, positive, unlabelled, text``, and the class prior among labelled ids."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    known = known.where(fold(F.col("doc_id")) != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = known.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0]
    order = F.xxhash64("doc_id", F.lit(3))
    ids = known.where("toxic = 1").orderBy(order, "doc_id").limit(sample).select(F.col("doc_id").alias("__toxic"))
    learn = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).where(fold(F.col("doc_id")) != 0)
    rows = learn.join(F.broadcast(ids), learn.doc_id == ids["__toxic"], "left")
    rows = rows.select("doc_id", F.col("__toxic").isNotNull().cast("long").alias("positive"), F.lit(1).cast("long").alias("unlabelled"), "text")
    return rows, min(0.9, max(0.001, share)) if share else PRIOR


def sampled(rows: DataFrame, n_p: int, n_u: int, sample: int) -> DataFrame:
    """At most ``sample`` positive and ``sample`` unlabelled texts; equal rows are one, with their number as weight."""
    order = F.xxhash64("doc_id", "text", F.lit(3))

    def drawn(of: DataFrame, n: int, positive, unlabelled) -> DataFrame:
        # Twice the share, so that the limit is reached where ids do not repeat.
        part = of.where(F.pmod(order, F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, 2 * sample / max(1, n)))))
        each = part.groupBy("doc_id", "text").agg(F.count("*").alias("n"))
        kept = each.withColumn("order", order).orderBy("order", "doc_id").limit(sample)
        return kept.select(positive.alias("positive"), unlabelled.alias("unlabelled"), "text", "order")

    none, n = F.lit(0).cast("long"), F.col("n")
    both = drawn(rows.where("positive = 1"), n_p, n, none).unionByName(drawn(rows, n_u, none, n))
    return stored(both.repartition(parallelism(rows.sparkSession, 8), "order").drop("order"), "toxicity-sample")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most_features: int = FEATURES) -> Model:
    rows, prior = learning(docs, labels, sample)
    n_p, n_u = rows.agg(F.sum("positive"), F.sum("unlabelled")).first()
    if not n_p or not n_u:
        return Model({}, float(np.log(prior / (1 - prior))))
    found = rows.select("positive", "unlabelled", "text").mapInArrow(counted, "feature long, p long, u long")
    counts = found.groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).where("p > 0")
    counts = stored(counts.withColumn("level", F.expr(f"CAST(feature DIV {SPACE} AS INT)")), "toxicity-counts")
    tried = {r.level: r.n for r in counts.groupBy("level").agg(F.count("*").alias("n")).collect()}
    least = F.create_map(*(F.lit(x) for level, n in tried.items() for x in (level, float(np.log(n) - SLACK))))[F.col("level")] if tried else F.lit(0.0)
    toxic = F.col("p") / n_p
    clean = F.greatest(F.lit(0.0), (F.col("u") / n_u - prior * toxic) / (1 - prior)) + 1.0 / n_u
    excess = F.col("p") * F.log(toxic / clean) - (F.col("p") - n_p * clean)
    best = counts.where((F.col("p") >= LEAST_TEXTS) & (excess > least) & (toxic > 4 * clean))
    best = best.select("feature", clean.alias("clean"), least.alias("least"), (toxic * F.log(toxic / clean)).alias("gain")).orderBy(F.desc("gain"), "feature")
    chosen = best.limit(most_features).collect()
    picked = [r.feature for r in chosen]
    table = sampled(rows, n_p, n_u, sample).mapInArrow(chosen_rows(picked), "positive long, unlabelled long, places array<int>").collect()
    # In an order of their own: sums then come out the same in every run.
    table = sorted(tuple(r) for r in table)
    decay = best_decay(table, np.array([r.clean for r in chosen]), np.array([r.least for r in chosen]), prior)
    weights, bias = fit(table, len(picked), prior, decay)
    return Model({f: float(w) for f, w in zip(picked, weights)}, bias)


def scorer(model: Model):
    weights, bias = list(model.weights.values()), model.bias
    chosen = list(model.weights)

    def make():
        of = Seen(places(chosen))

        def score(text: bytes) -> float:
            z = bias + sum(weights[i] for i in sorted(of(text)))
            return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

        return score

    return make


def toxic_score(model: Model, text: str = "text") -> Column:
    return value_udf(scorer(model), T.DoubleType())(F.col(text))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    scored = docs.select("doc_id", toxic_score(model).alias("score"))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows scored below one half, with the columns of the input only."""
    rows = docs.select(F.struct(*docs.columns).alias("__row"), toxic_score(model).alias("__score"))
    return rows.where("__score < 0.5").select("__row.*")
