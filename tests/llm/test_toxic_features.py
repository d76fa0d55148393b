"""Features of words, hashed all at once, against hashing every run by itself."""

import math
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewell.llm import toxicity
from tidewell.llm.rules import keep_good
from tidewell.session import read_table

WORDS = ["", "a", "Abc", "it's", "naïve", "ÜBER_9straße", "123", "_", "x" * 400, "ſtẞ", "İstanbul", "日本語", "^a$b"]


def one_by_one(word: bytes) -> set[int]:
    out = set()
    for core in toxicity.LETTERS.findall(word.decode("utf-8", "replace").lower()):
        marked = b"^" + core.encode() + b"$"
        out |= {marked, *(marked[i : i + n] for n in toxicity.RUNS for i in range(len(marked) - n + 1))}
    return {zlib.crc32(x) & (toxicity.SPACE - 1) for x in out}


def at_once(found: list[bytes]) -> list[set[int]]:
    got = defaultdict(set)
    for place, feature in zip(*(x.tolist() for x in toxicity.hashed(found))):
        got[place].add(feature)
    return [got[i] for i in range(len(found))]


@pytest.mark.parametrize("found", [[], [b""], [b"\xff\xfeab"], [w.encode() for w in WORDS]])
def test_features_of_awkward_words(found):
    assert at_once(found) == [one_by_one(w) for w in found]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=12) | st.text(max_size=12).map(lambda s: s.encode("utf-8", "replace")), max_size=8))
def test_features_of_any_words(found):
    assert at_once(found) == [one_by_one(w) for w in found]


def test_words_forgotten_are_worked_out_again(monkeypatch):
    monkeypatch.setattr(toxicity, "KNOWN", 3)
    chosen = sorted(one_by_one(b"bad"))
    of = toxicity.Seen(toxicity.places(chosen))
    for text in (b"bad one two", b"three four five six seven", b"BAD bad, bad", b"", b"good"):
        shared = set().union(*map(one_by_one, text.split())) & set(chosen)
        assert of(text) == {chosen.index(f) for f in shared}


def test_levels_count_distinct_words():
    """A run in three distinct words is a feature of the first three levels, in all that count, keep and score texts."""
    text = b"badly badger bad badly"
    run = zlib.crc32(b"^bad") & (toxicity.SPACE - 1)
    (own,) = toxicity.features([text])
    assert [run + toxicity.SPACE * i in own for i in range(4)] == [True, True, True, False]
    chosen = [run + toxicity.SPACE * i for i in (2, 3)]
    assert toxicity.Seen(toxicity.places(chosen))(text) == {0} and toxicity.Seen(toxicity.places(chosen))(b"bad") == set()


def test_counts_and_risk_against_brute_force(spark):
    """Counts of every feature, and the risk that the fit brings down, worked out text by text."""
    texts = [f"vile{i % 3} grim thing {i}" if i % 4 == 0 else f"calm sea {i} thing" for i in range(60)]
    rows = [(int(i % 4 == 0), 1, t) for i, t in enumerate(texts)]
    got = spark.createDataFrame(rows, "positive long, unlabelled long, text string").mapInArrow(toxicity.counted, "feature long, p long, u long")
    want = defaultdict(lambda: [0, 0])
    for positive, _, text in rows:
        times = defaultdict(int)
        for word in set(text.encode().split()):
            place, feature = toxicity.hashed([word])
            for f in feature.tolist():
                times[f] += 1
        for f, n in times.items():
            for i, least in enumerate(toxicity.LEVELS):
                if n >= least:
                    want[f + toxicity.SPACE * i][0] += positive
                    want[f + toxicity.SPACE * i][1] += 1
    sums = got.groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).collect()
    assert {r.feature: [r.p, r.u] for r in sums} == dict(want)

    def risk(weights, bias, table, prior, decay):
        loss = lambda z, y: math.log1p(math.exp(-z if y else z))
        z = [bias + sum(weights[f] for f in r[2]) for r in table]
        mean = lambda y, by: sum(loss(v, y) * r[by] for v, r in zip(z, table)) / sum(r[by] for r in table)
        return prior * mean(1, 0) + max(0.0, mean(0, 1) - prior * mean(0, 0)) + decay / 2 * sum(w * w for w in weights)

    table = [(1, 1, [0]), (1, 1, [0, 1]), (1, 1, [1]), (0, 1, [2]), (0, 1, []), (0, 3, [1, 2]), (0, 1, [2, 0])]
    weights, bias = toxicity.fit(table, 3, 0.3, 0.05)
    best = risk(weights, bias, table, 0.3, 0.05)
    for at in range(4):
        for by in (-0.2, 0.2):
            moved = [*weights, bias]
            moved[at] += by
            assert risk(moved[:3], moved[3], table, 0.3, 0.05) > best - 0.005


def test_counts_are_of_all_texts_and_the_sample_is_bounded(spark, monkeypatch):
    """A clean word too rare for the sample is counted; a toxic id repeated over and over stays within the sample."""
    labels = spark.createDataFrame([(i, int(i < 3)) for i in range(200)], "doc_id long, toxic int")
    rows = [(i % 3, f"vile {i}") for i in range(300)] + [(i, "calm" + (" rareword" if i == 4999 else "")) for i in range(3, 5000)] + [(7000, "same")] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    learn, _ = toxicity.learning(docs, labels, 20)
    rare = sorted(one_by_one(b"rareword") - one_by_one(b"calm"))
    counts = learn.select("positive", "unlabelled", "text").mapInArrow(toxicity.counted, "feature long, p long, u long")
    assert {r.feature for r in counts.where(F.col("feature").isin(rare)).collect()} == set(rare)
    n_p, n_u = learn.agg(F.sum("positive"), F.sum("unlabelled")).first()
    drawn = toxicity.sampled(learn, n_p, n_u, 20).collect()
    assert n_p > 20 and sum(r.positive > 0 for r in drawn) <= 20 and sum(r.unlabelled > 0 for r in drawn) <= 20
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda rows, width, prior, decay, steps=0: seen.append(len(rows)) or (np.zeros(width), 0.0))
    toxicity.train(docs, labels, sample=20)
    assert seen and max(seen) <= 40
    whole = toxicity.sampled(learn, n_p, n_u, 100_000).where("text = 'same'").collect()
    assert [(r.positive, r.unlabelled) for r in whole] == ([(0, 500)] if learn.where("doc_id = 7000").count() else [])


def test_few_positives_leave_clean_texts_alone(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = read_table(spark, folder, "documents"), read_table(spark, folder, "labels")
    kept = keep_good(docs)
    found = toxicity.score(kept, toxicity.train(kept, labels)).join(labels.select("doc_id", "toxic"), "doc_id")
    called = {(r["toxic"], r["held_out"]): r["share"] for r in found.groupBy("toxic", "held_out").agg(F.avg("predicted").alias("share")).collect()}
    assert called[0, False] <= 0.02 and called[0, True] <= 0.02
    assert called[1, False] >= 0.85 and called[1, True] >= 0.7
