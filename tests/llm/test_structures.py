"""Sketches, Merkle manifests and prefix tries against brute force, on small and awkward tables."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import bloom_lookup, merkle, ordering, prefix_trie

LONG = "\n".join(f"line {i} of a long text " + "x" * (i % 300) for i in range(700))
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, tree int, k string, rank int"
TEXTS = [
    (1, None), (2, ""), (3, "\n\n"), (4, "One line"), (5, "One line\nTWO lines\nthree"), (6, "One line\nTWO lines\nthree"), (7, LONG),
    (8, LONG + "\nmore"), (9, "äöü ß \U0001f600 x\n" * 3), (9, "another text with the same id"), (10, "copy"), (10, "copy"), (10, "copy"),
    (None, "no id\nat all"), (None, None), (-3, "A" * 1000), (2**40, "Z z"),
]


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    langs = [None, "", "en", "de", "en", "fr", "en"]
    rows = [(i, "s" if n % 3 else None, langs[n % len(langs)], n if n % 4 else None, t, "l", 1, "k", 2) for n, (i, t) in enumerate(TEXTS)]
    rows += [rows[4], rows[4]]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_ranks_count_up_in_each_group(spark):
    rows = [("a" if i % 3 else "b", (i * 7919) % 101, i % 2) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, x int, y int").repartition(7)
    got = defaultdict(list)
    for r in ordering.ranked(df, "g", [F.col("x").desc()], "t").collect():
        got[r.g].append((r["rank"], r.x, r.group_n))
    for g, found in got.items():
        found.sort()
        own = sorted((x for k, x, _ in rows if k == g), reverse=True)
        assert [f[:2] for f in found] == list(enumerate(own)) and {f[2] for f in found} == {len(own)}


def test_peeling_finds_what_differs(spark):
    rng = random.Random(5)
    cases = [([], []), ([1], []), ([1, 2, 3], [1, 2, 3])]
    for n in (1, 5, 40, 300, 1500):
        both = [rng.getrandbits(60) for _ in range(n)]
        cases.append((both + [rng.getrandbits(60) for _ in range(n // 2)], both + [rng.getrandbits(60) for _ in range(n // 3)]))
    df = spark.createDataFrame(cases, "a array<long>, b array<long>")
    got = df.select("a", "b", bloom_lookup.likeness(F.col("a"), F.col("b")).alias("near"), bloom_lookup.fingerprint(F.col("a")).alias("print")).collect()
    for r in got:
        a, b = set(r.a), set(r.b)
        assert r.near == pytest.approx((2 * len(a & b) / (len(a) + len(b))) if a or b else 1.0, abs=1e-12)
        cells = [r.print[i : i + 29] for i in range(0, len(r.print), 29)]
        assert len(cells) == 12 and sum(int(c[:6], 16) for c in cells) == 3 * len(a)
    small = df.select(bloom_lookup.differing(F.col("a"), F.col("b")).alias("d"), F.expr("size(array_except(a, b)) + size(array_except(b, a))").alias("n")).limit(6)
    assert all(r.d == r.n for r in small.collect())


def test_overfull_sketch_is_not_peeled(spark):
    df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.xxhash64(i).bitwiseAND(F.lit((1 << 60) - 1))).alias("d"))
    found = lambda width: bloom_lookup.peeled(bloom_lookup.sketch(F.col("d"), F.expr(f"{width}L")), F.expr(f"{width}L"))
    r = df.select(found(4).alias("small"), found(64).alias("large")).first()
    assert r.small is None and r.large == 60


def paragraphs(text):
    lines = [line for line in text.split("\n") if line]
    return {line[i : i + 240] for line in lines for i in range(0, len(line), 240)}


def test_fingerprints_of_versions(docs, empty):
    rows = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.md5(r[1].encode()).hexdigest()))
    want = []
    for i, (doc_id, text) in enumerate(rows):
        following, half = rows[(i + 1) % len(rows)][1], len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        near = []
        for other in (edited, following):
            a, b = paragraphs(text), paragraphs(other)
            near.append(round(2 * len(a & b) / (len(a) + len(b)), 12) if a or b else 1.0)
        want.append((doc_id, len(text), sha(edited), *near))
    found = bloom_lookup.fingerprints(docs).collect()
    got = [(r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 12), round(r.near_next, 12)) for r in found]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    by = defaultdict(set)
    for r in found:
        by[r.doc_id, r.n_chars].add(r.fingerprint)
    assert all(len(v) == 1 for v in by.values()) and by[5, 24] == by[6, 24] and by[7, len(LONG)] != by[8, len(LONG) + 5]
    assert bloom_lookup.fingerprints(empty).count() == 0
    assert bloom_lookup.fingerprints(docs.where("doc_id = 4").limit(1)).first().near_next == 1.0


def test_fingerprints_run_without_python(docs, plan):
    assert "Python" not in plan(bloom_lookup.fingerprints(docs)) and "Arrow" not in plan(bloom_lookup.fingerprints(docs))


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf_of(r, text):
    return sha(*map(field, (r.doc_id, r.source, r.lang, r.n_chars, text)))


def tree_of(digests):
    """Levels of a tree, leaves first."""
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def proof_of(levels, i):
    """The others of each run on the way up, before and after the node."""
    out = []
    for level in levels[:-1]:
        run = level[i - i % 8 : i - i % 8 + 8]
        out.append((run[: i % 8], run[i % 8 + 1 :]))
        i //= 8
    return out


def brute_manifest(rows):
    by = defaultdict(list)
    for r in rows:
        by[(r.lang is not None, (r.lang or "").encode())].append(r)
    trees = {}
    for key, own in by.items():
        own.sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf_of(r, r.text)))
        trees[key] = tree_of([leaf_of(r, r.text) for r in own])
    keys = sorted(trees)
    top = tree_of([trees[k][-1][0] for k in keys])
    out = []
    for at, key in enumerate(keys):
        for i, r in enumerate(by[key]):
            path = proof_of(trees[key], i) + proof_of(top, at)
            text = r.text
            if text is not None and r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            folded = leaf_of(r, text)
            for before, after in path:
                folded = sha(*before, folded, *after)
            proof = sha(*(d for before, after in path for d in before + after))
            out.append((r.doc_id, leaf_of(r, r.text), trees[key][-1][0], top[-1][0], proof, folded, folded == top[-1][0]))
    return out


@pytest.mark.parametrize("times", [1, 30])
def test_proofs_fold_to_the_root(spark, docs, times):
    more = docs
    if times > 1:
        # Trees of several levels, and more languages than one node takes.
        wide = spark.range(600).select(
            F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.when(F.col("id") % 3 > 0, "en").otherwise(F.concat(F.lit("l"), F.col("id") % 60)).alias("lang"),
            F.col("id").alias("n_chars"), F.concat(F.lit("Text "), F.col("id")).alias("text"),
        )
        more = docs.select(*wide.columns).unionByName(wide)
    got = [tuple(r) for r in merkle.verified(more).collect()]
    want = brute_manifest(more.collect())
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert any(r[-1] for r in got) and (times == 1 or not all(r[-1] for r in got))


def test_manifest_of_few_rows(docs, empty):
    assert merkle.verified(empty).count() == 0
    one = docs.where("doc_id = 4")
    r = merkle.verified(one).first()
    assert r.leaf == r.subroot == r.root and r.proof_sha256 == sha() and r.verified == (zlib.crc32(b"4") % 3 != 0)


def test_single_proof_reads_one_path(spark):
    rows = spark.range(100).select(F.lit("=x").alias("tree"), F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("leaf"))
    made = merkle.Manifest(rows)
    asked = made.leaves.where("doc_id = 77").select("tree", "rank", "doc_id")
    r = made.proofs(asked).collect()
    levels = tree_of([sha(str(i)) for i in range(100)])
    assert len(r) == 1 and r[0].root == levels[-1][0]
    assert [(p.before, p.others) for p in r[0].path] == [(len(b), b + a) for b, a in proof_of(levels, 77)]


def brute_trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        role, text = role or "", text or ""
        digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]
        convs[c].append((turn is not None, turn or 0, digest, role, text))
    for own in convs.values():
        own.sort()
    members = {}
    for c, own in convs.items():
        turns = [t[3:] for t in own]
        h = 0 if c is None else zlib.crc32(str(c).encode()) % 9
        base = [] if c is None else [t[3:] for t in convs.get(c - c % 5, [])]
        members[c] = tuple(base[:h] + turns[h:])
    nodes = defaultdict(list)
    for c, turns in members.items():
        for d in range(len(turns) + 1):
            nodes[turns[:d]].append(c)
    name = {p: min((c for c in m if c is not None), default=None) for p, m in nodes.items()}
    kids = {p: sum(1 for q in nodes if len(q) == len(p) + 1 and q[: len(p)] == p) for p in nodes}
    out = []
    for p, m in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        ends = ",".join(str(c) for c in sorted(c for c in m if c is not None and len(members[c]) == len(p)))
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        out.append((name[p], len(p), name[p[:-1]] if p else None, len(m), kids[p], sum(not kids[q] for q in below), saved, sha(ends)))
    return out


@pytest.mark.parametrize("shard_bytes", [1 << 24, 300])
def test_trie_nodes(spark, shard_bytes):
    rng = random.Random(3)
    rows = []
    for c in range(140):
        # Common first turns, whole copies, and some odd turns.
        words = ["hi", "ok", "é", None, ""] if c % 3 else ["hi"]
        for turn in range(rng.randrange(7) + (c % 5 == 0)):
            rows.append((c, turn if turn else None, rng.choice(["user", "assistant", None]) if c % 4 else "user", rng.choice(words)))
    rows += [(None, 1, "user", "hi"), (None, 0, "user", "x"), (200, 1, "user", "hi"), (200, 1, "user", "hi"), (-7, 0, "user", "hi"), (-7, 1, "user", "ok")]
    rows += [(c, t, "user", "always the same") for c in range(300, 360) for t in range(3)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, key string, prefix int")
    # Truncated remainders, as the tables have no negative ids but the added one.
    want = brute_trie([r for r in rows if r[0] != -7])
    got = [tuple(r) for r in prefix_trie.trie(df.where("conv_id IS NULL OR conv_id <> -7"), shard_bytes).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert prefix_trie.trie(df.where("false")).count() == 0
    assert {r.n_convs for r in prefix_trie.trie(df.where("conv_id = -7")).collect()} == {1}


def test_double_array_holds_its_sequences_only():
    rng = random.Random(1)
    keys = sorted({tuple(rng.randrange(40) for _ in range(rng.randrange(9))) for _ in range(800)})
    trie, walks = prefix_trie.packed([list(k) for k in keys])
    prefixes = {k[:d] for k in keys for d in range(1, len(k) + 1)}
    assert (trie.check >= 0).sum() == len(prefixes)
    states = {}
    for k, walk in zip(keys, walks):
        for d, s in enumerate(walk, 1):
            assert states.setdefault(k[:d], s) == s and trie.check[s] == (walk[d - 2] if d > 1 else 0)
    assert len(set(states.values())) == len(prefixes) and trie.end < 4 * len(prefixes)
    used = np.flatnonzero(trie.check >= 0)
    assert trie.child(0, 10**6) == -1 and used.max() < trie.end
