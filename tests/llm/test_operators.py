"""The operators for training data against brute force, on small and awkward tables."""

import hashlib
import math
import unicodedata
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewell.llm import chat, decontaminate, packing, rules, sharding, simhash, suffix_tree, token_counts, toxicity, weak_labels
from tidewell.session import work_dir

SCHEMA = "doc_id long, text string, shard string, `N_WORDS` int, fp int"
LONG = " ".join(f"w{i % 700}" for i in range(9000))
AWKWARD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "One TWO"), (6, "a b c d e f g h i j k l"), (7, "a b c d e f g h i j k l"),
    (7, "a b c d e f g h i j k l"), (None, "no id here but text enough to go on with for some words"), (9, LONG), (10, LONG + " end"),
    (11, "x y z x y z x y z x y z x y z"), (12, "ÄÖ über ßtraße J̌ é \U0001f600 ok"), (13, "<|endoftext|> a\\b </s>"), (None, None),
]
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "s", 1, 2) for i, t in AWKWARD], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def real(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def held(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5


def test_words_are_kept_whole_in_the_ledger(docs, empty):
    got = rules.rule_ledger(docs).collect()
    assert len(got) == len(AWKWARD) and got[0].text is None and got[0].n_words == 0 and got[0].failed_bits & 1
    by = {r.doc_id: r for r in got}
    assert by[11].n_repeat_words == 15 and not by[6].n_repeat_words and by[12].word_chars == len("ÄÖüberßtraßeJ̌é\U0001f600ok")
    assert rules.rule_ledger(empty).count() == 0 and rules.keep_good(empty).columns == empty.columns
    assert {r.text for r in rules.keep_good(docs).collect()} == {r.text for r in got if not r.failed_bits & rules.mask(rules.POLICIES["v1"])}
    clashing = rules.keep_good(docs.withColumns({"__m": F.lit(7), "n_words": F.lit("x"), "__row": F.lit(8)}))
    assert {(r["__m"], r["n_words"], r["__row"]) for r in clashing.collect()} == {(7, "x", 8)} and clashing.count() == rules.keep_good(docs).count()


def test_ablation_counts_what_a_rule_does_alone(docs):
    ledger = rules.rule_ledger(docs)
    bits = [r.failed_bits for r in ledger.collect()]
    whole = rules.mask(rules.POLICIES["v1"])
    for r in rules.ablation(ledger).collect():
        assert (r.n_failed, r.n_only, r.n_kept_without) == (
            sum(bool(b & r.bit) for b in bits), sum(b & whole == r.bit for b in bits), sum(not b & whole & ~r.bit for b in bits),
        )


def test_chat_reads_back(spark):
    rows = [
        (1, 1, "assistant", "b\\"), (1, 0, "user", "<|im_end|> [INST] <<SYS>> \\<|"), (1, 2, "user", "tail"), (2, 0, "user", None),
        (3, 0, None, "x"), (3, 0, None, "x"), (3, None, "assistant", ""), (None, 1, "assistant", "</s>"), (4, 1, "assistant", "one"), (4, 2, "assistant", "two\n<s>"),
    ]
    got = {r.conv_id: r for r in chat.digests(chat.examples(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is not None, t, r or "", x or ""))
    for c, turns in by.items():
        turns.sort()
        text = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(text.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    made = chat.examples(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert made.where("conv_id = 4").count() == 2 and not made.where("formatted LIKE '%</s>%' OR formatted LIKE '%[INST]%'").count()
    assert chat.digests(chat.examples(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_shards_hold_every_row_once(docs, empty, real):
    for frame, bytes_ in ((docs, 4096), (real, 1 << 16)):
        got = sharding.external_shuffle(frame, bucket_bytes=bytes_).collect()
        key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text or "")
        assert sorted(map(key, got)) == sorted(map(key, frame.collect()))
        by = defaultdict(list)
        for r in got:
            by[r.shard].append(r.slot)
        sizes = [len(by[s]) for s in range(16)]
        assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())
        again = sharding.external_shuffle(frame, bucket_bytes=bytes_).collect()
        place = lambda rows: Counter((key(r), r.shard, r.slot) for r in rows)
        assert place(got) == place(again)
    assert sharding.external_shuffle(empty).count() == 0


def test_shards_read_back_as_written(spark, docs, empty, real, tmp_path):
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text or "")
    same = spark.createDataFrame([(7, "one text")] * 300, "doc_id long, text string")
    for i, frame in enumerate((docs, real, same)):
        path = str(tmp_path / f"shards{i}")
        sharding.write_shards(frame, path, bucket_bytes=4096)
        total = 0
        for shard in range(16):
            slots = []
            for file in sorted(Path(path, f"shard={shard}").glob("*.parquet")):
                own = pq.ParquetFile(file).read().column("slot").to_pylist()
                assert own == sorted(own)
                slots += own
            assert sorted(slots) == list(range(len(slots)))
            total += len(slots)
        assert total == frame.count()
        asked = sharding.sharded(frame, bucket_bytes=4096).collect()
        placed = sharding.external_shuffle(frame, bucket_bytes=4096).collect()
        assert Counter((key(r), r.shard, r.slot) for r in asked) == Counter((key(r), r.shard, r.slot) for r in placed)
    assert sharding.sharded(empty).count() == 0


def test_shuffle_is_uniform_and_moves_rows_within_buckets(spark):
    """Places of 8,000 rows against their ids, in 16 by 16 fields: chi-square of 225 degrees of freedom."""
    rows = spark.range(8000).select(F.col("id").alias("doc_id"), F.lit("x" * 40).alias("text"))
    got = sharding.external_shuffle(rows, bucket_bytes=1 << 14).collect()
    fields = Counter((r.shard, r.doc_id // 500) for r in got)
    assert len(got) == 8000 and sum((fields[a, b] - 31.25) ** 2 / 31.25 for a in range(16) for b in range(16)) < 330
    # One bucket: the sorted order before the second pass is gone after it.
    one = sharding.external_shuffle(rows.limit(512), shards=1, bucket_bytes=1 << 30)
    order = [r.o for r in one.select(F.xxhash64(F.lit(~sharding.SEED), "doc_id", "text").alias("o"), "slot").orderBy("slot").collect()]
    rises = sum(a < b for a, b in zip(order, order[1:]))
    assert 200 < rises < 312


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_fingerprints_and_components(docs, empty, real):
    for frame in (docs, real):
        got = simhash.near_duplicates(frame).collect()
        assert Counter((r.doc_id, r.fp % 2**64) for r in got) == Counter((r.doc_id, brute_fingerprint(r.text)) for r in frame.collect())
        prints = sorted({r.fp % 2**64 for r in got})
        root = {p: p for p in prints}
        changed = True
        links = [(a, b) for i, a in enumerate(prints) for b in prints[i + 1 :] if (a ^ b).bit_count() <= 2]
        while changed:
            changed = False
            for a, b in links:
                m = min(root[a], root[b])
                changed |= root[a] != m or root[b] != m
                root[a] = root[b] = m
        least = {}
        for r in got:
            if r.doc_id is not None:
                k = root[r.fp % 2**64]
                least[k] = min(least.get(k, r.doc_id), r.doc_id)
        assert all(r.component_id == least.get(root[r.fp % 2**64]) for r in got)
        kept = simhash.keep_one(frame)
        assert kept.columns == frame.columns and kept.count() == len(set(root.values()))
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("codes", [(simhash.GOLAY, simhash.GOLAY), (simhash.GOLAY, simhash.GOLAY, simhash.HAMMING)])
def test_linked_fingerprints_meet_at_an_anchor(codes):
    rng = np.random.default_rng(1)
    a = rng.integers(-(2**63), 2**63 - 1, 60)
    flips = [sum(1 << int(b) for b in rng.choice(64, n, replace=False)) for n in rng.integers(0, 3, 60)]
    b = np.array([np.uint64(int(x) % 2**64 ^ f) for x, f in zip(a, flips)]).view(np.int64)
    index, anchor, home = simhash.anchors(np.concatenate([a, b]), codes, 2)
    at = defaultdict(set)
    for i, c, h in zip(index, anchor, home):
        at[int(i)].add(int(c))
        if h:
            at["home", int(i)] = int(c)
    assert all(at["home", i] in at[60 + i] for i in range(60))


def test_large_groups_are_joined_like_small_ones():
    rng = np.random.default_rng(2)
    base = int(rng.integers(2**62))
    prints = np.unique(np.array([base ^ sum(1 << int(x) for x in rng.choice(20, rng.integers(0, 6), replace=False)) for _ in range(300)]))
    label = simhash.joined(prints)
    near = np.bitwise_count((prints[:, None] ^ prints[None]).view(np.uint64)) <= 2
    reach = near
    while True:
        more = (reach.astype(int) @ near.astype(int)) > 0
        if (more == reach).all():
            break
        reach = more
    assert (label == reach.argmax(axis=1)).all()


def test_containment_finds_every_item(spark, docs, empty):
    item = " ".join(f"t{i}" for i in range(30))
    near = " ".join(f"t{i}" if i != 29 else "other" for i in range(30))
    items = spark.createDataFrame([(1, item), (2, "Two words"), (3, None), (4, " "), (1, item), (5, "w1 w2 w3 w4 w5 w6")], "item_id long, text string")
    more = spark.createDataFrame([(100, LONG + " " + item.upper() + " " + LONG), (101, near), (102, "say two words now"), (103, " ".join(item.split()[:20]))], "doc_id long, text string")
    got = {(r.doc_id, m.item_id) for r in decontaminate.contained(docs.select("doc_id", "text").union(more), items, block_bytes=64).collect() for m in r.matches}
    assert got == {(100, 1), (101, 1), (102, 2), (9, 5), (10, 5), (100, 5)}
    assert decontaminate.contained(empty, items).count() == 0 and decontaminate.drop_contaminated(docs, items.limit(0)).count() == len(AWKWARD)


def test_items_go_through_in_blocks_of_bounded_size(spark, docs, monkeypatch):
    rows = [(i, " ".join(f"q{i * 31 % 997}x{j}" for j in range(60))) for i in range(900)]
    items = spark.createDataFrame([*rows, (5000, LONG), (5001, None)], "item_id long, text string")
    texts = [(i, f"before {rows[i][1]} between {rows[(i + 450) % 900][1].upper()}") for i in range(0, 900, 60)]
    frame = docs.select("doc_id", "text").union(spark.createDataFrame([*texts, texts[0]], "doc_id long, text string"))
    held, items_of = [], decontaminate.items_of
    monkeypatch.setattr(decontaminate, "items_of", lambda rows, block: held.append(items_of(rows, block)) or held[-1])
    count = lambda df: Counter((r.doc_id, r.text, tuple(sorted(map(tuple, r.matches)))) for r in df.collect())
    whole = count(decontaminate.contained(frame, items))
    assert len(held) == 1 and sum(n for r, n in whole.items() if len(r[2]) == 2) == len(texts) + 1
    held.clear()
    assert count(decontaminate.contained(frame, items, block_bytes=1 << 16)) == whole
    sizes = [sum(len(x) for _, x in block) for block in held]
    assert len(held) >= 5 and sum(map(len, held)) == 902 and max(sizes) < 2 * (1 << 16)
    kept = decontaminate.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and kept.count() == len(AWKWARD) - 2


def test_sketches_lose_no_match():
    for n in range(1, 200):
        assert decontaminate.sketch_size(n) >= min(n, n - decontaminate.needed(n) + 1)


def test_packing_puts_each_id_in_one_piece(docs, empty, real):
    t = Tokenizer.from_file(WORD_BPE)
    for frame in (docs, real):
        want = Counter()
        for r in frame.collect():
            ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 1]
            want.update((r.doc_id, s, zlib.crc32(np.array(ids[s : s + 2048], "<u4").tobytes()), len(ids)) for s in range(0, len(ids), 2048))
        got = packing.pack(frame, WORD_BPE, group_pieces=100).collect()
        assert Counter((r.doc_id, r.start, r.ids_crc32, r.doc_tokens) for r in got) == want
        by = defaultdict(list)
        for r in got:
            by[r.sequence_id].append((r.offset, r.length))
        for pieces in by.values():
            pieces.sort()
            assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:i]) for i in range(len(pieces))] and sum(n for _, n in pieces) <= 2048
    assert packing.pack(empty, WORD_BPE).count() == 0
    ids = packing.pack(docs.where("doc_id = 4"), WORD_BPE, keep_ids=True).first().ids
    assert ids == [*t.encode("one", add_special_tokens=False).ids, 1]


def test_letters_before_points_are_tokenised_as_the_tokenizer_does():
    # Every letter and mark before a point and a comma, and the capital that becomes a letter and a mark.
    with open(WORD_BPE, encoding="utf-8") as f:
        encoder = packing.Encoder(f.read())
    letters = [c for c in map(chr, range(0x110000)) if unicodedata.category(c)[0] in "LM"]
    ends = [".", ",", "!!", "$%", "'s", ".'", "<|", ";)"]
    texts = [f"a{c}{e} {c}{e} {c}b{e}" for i, c in enumerate(letters) for e in (".", ",", ends[i % 8])]
    texts += ["Bodrum \u0130, x", "AKDEN\u0130Z SEND\u0130KASI SEVG\u0130.", "Tek\u0130. tek\u0130, BURSA\u0130."]
    for at in range(0, len(texts), 4096):
        part = [packing.prepared(t.encode()) for t in texts[at : at + 4096]]
        encoder.learn(part)
        want = encoder.tokenizer.encode_batch_fast(texts[at : at + 4096], add_special_tokens=False)
        assert [encoder(t) for t in part] == [packing.as_bytes(e.ids) for e in want]


def test_best_fit_is_the_tightest():
    rng = np.random.default_rng(3)
    lengths = np.sort(rng.integers(1, 100, 400))[::-1]
    sequence, offset = packing.best_fit_decreasing(lengths, 100)
    room = {}
    for n, s, o in zip(lengths.tolist(), sequence.tolist(), offset.tolist()):
        fits = [r for r in room.values() if r >= n]
        assert (room[s] == min(fits) and o == 100 - room[s]) if s in room else not fits
        room[s] = room.get(s, 100) - n


def brute_count(token, scores):
    best = [(0.0, 0)]
    for end in range(1, len(token) + 1):
        n = len(token[end - 1].encode())
        options = [(best[end - 1][0] - token_counts.UNKNOWN * n, best[end - 1][1] - n)]
        options += [(best[s][0] + scores[token[s:end]], best[s][1] - 1) for s in range(end) if token[s:end] in scores]
        best.append(max(options))
    return -best[-1][1]


def test_shared_prefixes_give_the_counts_of_each_word(docs, empty, real):
    scores = token_counts.vocabulary(PIECES)
    for frame, share in ((docs, 1), (docs, token_counts.SHARE), (real.limit(40), 200)):
        rows = frame.collect()
        got = Counter((r.doc_id, r.n_words, r.n_tokens) for r in token_counts.token_counts(frame, PIECES, share).collect())
        assert got == Counter((r.doc_id, len(w), sum(brute_count("▁" + x.decode(), scores) for x in w)) for r in rows for w in [(r.text or "").encode().split()])
    assert token_counts.token_counts(empty, PIECES).count() == 0


def test_long_words_with_one_start_part():
    links = [b"http://a.example/%030d" % (i * 7919) for i in range(2000)]
    assert len({token_counts.start_hash(x) for x in links}) == 1
    assert len({token_counts.start_hash(b"http://a.example/%d/page-of-many" % (i * 7919)) for i in range(2000)}) > 100
    assert token_counts.start_hash(b"internal") == token_counts.start_hash(b"internet")


def brute_tree_scores(rows, depth, word_share, run_share):
    """Scores by the definition of the states, with dictionaries."""
    texts = [(i, [*(x or "").encode().lower().split(), b""]) for i, x in rows]
    grams = [Counter() for _ in range(depth + 2)]
    for i, w in texts:
        if held(i) != 1:
            for k in range(1, depth + 2):
                grams[k].update(tuple(w[a : a + k]) for a in range(len(w) - k + 1))
    total, vocabulary = sum(grams[1].values()), len(grams[1])
    root = lambda x: math.log10((grams[1][(x,)] + 0.5) / (total + 0.5 * (vocabulary + 1)))
    kept = [None, {g for g, n in grams[1].items() if n >= max(1.0, total * word_share)}]
    for k in range(2, depth + 2):
        kept.append({g for g, n in grams[k].items() if n >= max(2.0, total * run_share) and g[:-1] in kept[k - 1] and g[1:] in kept[k - 1]})
    states: dict = {}

    def chance(context, x):
        for k in range(len(context)):
            own = context[k:]
            if own in states:
                table, rest = states[own]
                return table[x] if x in table else rest + chance(own[1:], x)
        return root(x) * math.log(10)

    for k in range(1, depth + 1):
        fresh = {}
        after = defaultdict(dict)
        for g in kept[k + 1]:
            after[g[:-1]][g[-1]] = grams[k + 1][g]
        for c, table in after.items():
            n, parent = grams[k][c], {x: chance(c[1:], x) for x in table}
            left = min(1.0, max(1e-9, 1 - sum(map(math.exp, parent.values()))))
            other = n - sum(table.values())
            gain = sum(m * (math.log(m / n) - parent[x]) for x, m in table.items()) + (other * (math.log(other / n) - math.log(left)) if other else 0)
            if gain > 0.5 * len(table) * math.log(max(n, 2)):
                own = {x: math.log((m - 0.5) / n) for x, m in table.items()}
                spare = min(1.0, max(1e-9, 1 - sum(map(math.exp, own.values()))))
                fresh[c] = own, math.log(spare) - math.log(left)
        states.update(fresh)
    return [(i, len(w), sum(map(root, w)), sum(chance(tuple(w[max(0, a - depth) : a]), w[a]) for a in range(len(w))) / math.log(10)) for i, w in texts], states


def test_suffix_tree_scores(docs, empty, real):
    for frame in (docs, real):
        rows = [(r.doc_id, r.text) for r in frame.collect()]
        want, states = brute_tree_scores(rows, 3, 2.0**-17, 2.0**-20)
        got = suffix_tree.score(frame).collect()
        key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
        for g, w in zip(sorted(((r.doc_id, r.n_tokens, r.base_score, r.score) for r in got), key=key), sorted(want, key=key)):
            assert g[:2] == w[:2] and g[2:] == pytest.approx(w[2:], rel=1e-9)
        assert states and all(r.held_out == (held(r.doc_id) == 1) for r in got)
    assert suffix_tree.score(empty).count() == 0


def test_a_rare_run_is_kept_in_a_large_corpus(spark):
    """300,000 training words: a share of them asks for more than two counts of a word."""
    learnt = [i for i in range(20) if held(i) != 1][:2]
    rare = [(i, "zeta omega kappa rho") for i in [*learnt, next(i for i in range(20) if held(i) == 1)]]
    rows = [(100 + i, LONG) for i in range(45)] + rare
    want, states = brute_tree_scores(rows, 3, 0.0, 0.0)
    got = suffix_tree.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    by = {r.doc_id: r for r in got}
    assert by[100].train_tokens > 1 << 18 and (b"zeta",) in states
    for i, n, root, chance in want:
        assert (by[i].n_tokens, by[i].base_score, by[i].score) == (n, pytest.approx(root, rel=1e-9), pytest.approx(chance, rel=1e-9))
    assert all(by[i].score > by[i].base_score + 10 for i, _ in rare)


def test_suffix_tree_of_many_blocks(spark, real, monkeypatch):
    """Small blocks and few ranges: most runs are in several blocks, and one word is half of some texts."""
    monkeypatch.setattr(suffix_tree, "BLOCK", 3000)
    monkeypatch.setattr(suffix_tree, "RANGES", 5)
    hot = [(10_000 + i, " ".join(f"the w{i * j % 13}" for j in range(40))) for i in range(60)]
    rows = [(r.doc_id, r.text) for r in real.limit(60).collect()] + hot
    want, states = brute_tree_scores(rows, 3, 0.0, 0.0)
    got = suffix_tree.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    key = lambda r: (r[0], r[1], r[2])
    for g, w in zip(sorted(((r.doc_id, r.n_tokens, r.base_score, r.score) for r in got), key=key), sorted(want, key=key), strict=True):
        assert g[:2] == w[:2] and g[2:] == pytest.approx(w[2:], rel=1e-9)
    assert {len(c) for c in states} == {1, 2, 3}


def test_suffix_tree_stores_less_than_its_input(spark):
    """What it writes down, blocks and answers, against the documents it reads; no row of a run with its parts."""
    path = Path("/root/testdata/sf0.01/documents.parquet")
    on_disk = lambda: sum(x.stat().st_size for x in Path(work_dir(spark).removeprefix("file:")).rglob("*part-*"))
    before, scored = on_disk(), suffix_tree.score(spark.read.parquet(str(path)))
    after = on_disk()
    assert scored.count() == 1000 and 0 < after - before < 2 * path.stat().st_size


def test_toxicity_learns_without_the_held_out_labels(spark, docs, empty):
    clean = ["the sun and the sea", "a quiet house on the hill", "rain fell on green fields", "bread and soup again"]
    rows = [(i, f"{clean[i // 7 % 4]} {i} " + (" vile slurfoo" if i % 6 == 0 else "")) for i in range(900)]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(900) if i // 6 % 2] + [(None, 1, 1), (5000, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(texts, labels)
    got = toxicity.score(texts, model).collect()
    assert all(r.predicted == (r.doc_id % 6 == 0) for r in got) and all(r.held_out == (held(r.doc_id) == 0) for r in got)
    assert toxicity.drop_toxic(texts, model).count() == 750
    awkward = toxicity.score(docs, model)
    assert awkward.count() == len(AWKWARD) and awkward.where("score IS NULL OR score < 0 OR score > 1 OR predicted <> 0").count() == 0
    assert toxicity.score(empty, toxicity.train(empty, labels)).count() == 0
    assert toxicity.score(docs, toxicity.train(docs, labels.limit(0))).where("predicted = 1").count() == 0


def test_weak_labels_agree_with_quality(spark, docs, empty, sf):
    assert weak_labels.classify(docs).count() == len(AWKWARD) and weak_labels.classify(empty).count() == 0
    big = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{big}/labels.parquet").select("doc_id", "quality").distinct()
    seen = weak_labels.classify(spark.read.parquet(f"{big}/documents.parquet")).join(labels, "doc_id")
    right = seen.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0]
    assert right > 0.85


def test_em_finds_the_better_labeller():
    rng = np.random.default_rng(4)
    good = rng.random(5000) < 0.7
    rates = [0.95, 0.9, 0.6, 0.8, 0.85, 0.75, 0.9]
    votes = np.stack([np.where(rng.random(5000) < a, good, ~good) * 2 for a in rates], axis=1)
    patterns, counts = np.unique((votes * 3 ** np.arange(7)).sum(axis=1), return_counts=True)
    _, table = weak_labels.expectation_maximisation(patterns, counts)
    assert list(weak_labels.accuracies(table).values()) == pytest.approx(rates, abs=0.04)
