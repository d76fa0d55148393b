"""Queries of the operators, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import (
    bloom_lookup,
    chat,
    decontaminate,
    merkle,
    packing,
    prefix_trie,
    rules,
    sharding,
    simhash,
    suffix_tree,
    token_counts,
    toxicity,
    weak_labels,
)
from tidewell.session import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql.strip()
        return fn

    return register


def added_conversation(spark: SparkSession) -> DataFrame:
    """Conversation -7, whose texts are control strings."""
    text = F.lit("</s>[INST] ok [/INST]").alias("text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role")
    return spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role, text)


@query()
def op1_lm_scoring(spark, sf_dir):
    """Base and suffix-tree score of every document, learnt from four folds."""
    return suffix_tree.score(read_table(spark, sf_dir, "documents"))


@query(
    r"""
WITH given AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM given
), e AS (
  SELECT *, role = 'assistant' AS reply,
    length('<|im_start|><|im_sep|><|im_end|>') + length(role) + length(text)
      + (SELECT sum((length(x) - length(replace(x, c, ''))) // length(c))
         FROM (VALUES ('\'), ('<|'), ('<s>'), ('</s>'), ('[INST]'), ('[/INST]'), ('<<SYS>>'), ('<</SYS>>')) v(c),
              (VALUES (role), (text)) w(x)) AS chars
  FROM t
), c AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS upto,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS back
  FROM e
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN reply THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE reply), '')) AS loss_sha256,
  CAST(sum(CASE WHEN reply OR back = 1 THEN upto ELSE 0 END) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
)
def op2_chat_formatting(spark, sf_dir):
    """Every conversation formatted, and read back from the formatted text and its loss marks."""
    given = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.examples(given.unionByName(added_conversation(spark))))


@query()
def op3_toxicity(spark, sf_dir):
    """Toxicity of every document, learnt from the labels of four folds."""
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")))


@query(
    r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    row_number() OVER () AS r FROM documents
), p AS (
  SELECT r, i, array_to_string(w[i:i + 4], ' ') AS win
  FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
), again AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM p) WHERE n > 1
), covered AS (
  SELECT r, count(DISTINCT i + j) AS n FROM again, range(5) s(j) GROUP BY r
), lines AS (
  SELECT r, count(*) AS n, count(*) - count(DISTINCT l) AS dup
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS l FROM d)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r
), m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce(lines.n, 0) AS n_lines, coalesce(dup, 0) AS n_dup_lines,
    coalesce(covered.n, 0) AS n_repeat_words,
    CAST(length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS BIGINT) AS n_letters,
    CAST(length(regexp_replace(text, '[^A-Z]', '', 'g')) AS BIGINT) AS n_upper
  FROM d LEFT JOIN lines USING (r) LEFT JOIN covered USING (r)
), b AS (
  SELECT *, n_words < 10 AS r0, 100 * n_repeat_words > 20 * n_words AS r1, 10 * n_symbols > n_words AS r2,
    2 * n_dup_lines > n_lines AS r3, n_letters >= 20 AND 2 * n_upper > n_letters AS r4,
    n_words >= 10 AND (word_chars < 2 * n_words OR word_chars > 15 * n_words) AS r5
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, r0 OR r1 AS base_failed,
  NOT (r0 OR r1 OR r2 OR r3 OR r4 OR r5) AS kept,
  CAST(r0::INT + 2 * r1::INT + 4 * r2::INT + 8 * r3::INT + 16 * r4::INT + 32 * r5::INT AS BIGINT) AS failed_bits
FROM b
"""
)
def op4_quality_rules(spark, sf_dir):
    """The ledger of every document with the verdicts of the base and the first full policy."""
    ledger = rules.rule_ledger(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return ledger.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~rules.passes("base")).alias("base_failed"), rules.passes("v1").alias("kept"), "failed_bits",
    )


@query(
    f"""
WITH ledger AS ({ORACLES["op4_quality_rules"]}),
rules(rule, bit) AS (VALUES {", ".join(f"('{r}', {1 << i})" for i, r in enumerate(rules.POLICIES["v1"]))})
SELECT rule, CAST(bit AS BIGINT) AS bit, CAST(count(*) FILTER (failed_bits & bit <> 0) AS BIGINT) AS n_failed,
  CAST(count(*) FILTER (failed_bits = bit) AS BIGINT) AS n_only,
  CAST(count(*) FILTER (failed_bits & (63 - bit) = 0) AS BIGINT) AS n_kept_without
FROM ledger CROSS JOIN rules GROUP BY rule, bit
"""
)
def rule_ablation(spark, sf_dir):
    """What each rule of the first full policy fails, alone rejects, and leaves when it is taken out, over all documents."""
    return rules.ablation(rules.rule_ledger(read_table(spark, sf_dir, "documents").select("doc_id", "text")))



@query()
def op5_sharding(spark, sf_dir):
    """All documents in sixteen shards of row counts at most one apart, read from the shards as written."""
    shuffled = sharding.sharded(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return shuffled.select(
        "doc_id",
        sharding.size().alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query()
def op6_quality_classifier(spark, sf_dir):
    """Votes, posterior and score of every document."""
    return weak_labels.classify(read_table(spark, sf_dir, "documents"))


@query()
def op7_token_counts(spark, sf_dir):
    """Words and unigram tokens of every document."""
    return token_counts.token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query(
    r"""
WITH i AS (
  SELECT item_id, w FROM (SELECT DISTINCT item_id, text,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark)
), s AS (
  SELECT DISTINCT item_id, array_to_string(w[p:p + 4], ' ') AS shingle
  FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS p FROM i WHERE len(w) >= 5)
), n AS (SELECT item_id, count(*) AS n_item FROM s GROUP BY 1
), d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), q AS (
  SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS p FROM d WHERE len(w) >= 5)
)
SELECT doc_id, item_id, n_item, count(*) AS n_shared, count(*) / n_item AS containment
FROM q JOIN s USING (shingle) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n_item HAVING 10 * count(*) >= 8 * n_item
"""
)
def op8_benchmark_decontamination(spark, sf_dir):
    """Every test item that a document contains."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contained(docs, read_table(spark, sf_dir, "benchmark"))
    each = found.select("doc_id", F.inline("matches"))
    return each.withColumn("containment", F.col("n_shared") / F.col("n_item"))


@query()
def op9_simhash_near_dedup(spark, sf_dir):
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query()
def op10_packing(spark, sf_dir):
    """All documents packed into sequences of 2048 tokens."""
    return packing.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


# Unsigned CRC-32 of the characters of a number, where `t.crc` is the table of the CRC of each byte.
CRC_TABLE = """(
  SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS crc
  FROM range(256) r(b)
)"""


def crc_of(number: str) -> str:
    letters = f"list_transform(string_split(CAST({number} AS VARCHAR), ''), lambda ch: CAST(ord(ch) AS BIGINT))"
    step = "lambda c, b: xor(c >> 8, t.crc[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295, {letters}), {step}), 4294967295)"


@query(
    r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n,
    row_number() OVER (ORDER BY doc_id DESC NULLS LAST, md5(coalesce(text, ''))) AS r FROM documents
), f AS (
  SELECT d.doc_id, d.r, d.n, d.text, o.text AS following
  FROM d JOIN d o ON o.r = d.r % (SELECT count(*) FROM d) + 1
), v AS (
  SELECT *, left(text, n - n // 2) || left(following, n // 2) AS edited FROM f
), p AS (
  SELECT r, which, list_distinct(list_transform(regexp_extract_all(x, '[^\n]{1,240}'),
    lambda y: CAST('0x' || md5(y)[1:15] AS BIGINT))) AS keys
  FROM (SELECT r, unnest(['own', 'edited', 'following']) AS which, unnest([text, edited, following]) AS x FROM v)
), cells AS (
  SELECT r, which, j, count(k) AS n, coalesce(bit_xor(k), 0) AS k,
    coalesce(bit_xor(((k & 1073741823) * 1000003 + (k >> 30) * 998244353) % 2147483647), 0) AS c
  FROM (SELECT r, which, unnest(range(12)) AS j FROM p) a
  LEFT JOIN (SELECT r, which, k, unnest([(k & 1048575) % 4, ((k >> 20) & 1048575) % 4 + 4, (k >> 40) % 4 + 8]) AS j
             FROM (SELECT r, which, unnest(keys) AS k FROM p)) b USING (r, which, j)
  GROUP BY r, which, j
), s AS (
  SELECT r, which, lower(string_agg(lpad(to_hex(n), 6, '0') || lpad(to_hex(k), 15, '0') || lpad(to_hex(c), 8, '0'), '' ORDER BY j)) AS print
  FROM cells GROUP BY r, which
), l AS (
  SELECT o.r, x.which, CASE WHEN len(o.keys) + len(x.keys) = 0 THEN 1.0 ELSE
    CAST(2 * len(list_intersect(o.keys, x.keys)) AS DOUBLE) / (len(o.keys) + len(x.keys)) END AS near
  FROM p o JOIN p x ON o.r = x.r AND o.which = 'own'
)
SELECT v.doc_id, CAST(v.n AS BIGINT) AS n_chars, sha256(v.edited) AS edited_sha256, so.print AS fingerprint,
  se.print AS edited_fingerprint, CAST(le.near AS DOUBLE) AS near_edited, CAST(ln.near AS DOUBLE) AS near_next
FROM v JOIN s so ON so.r = v.r AND so.which = 'own' JOIN s se ON se.r = v.r AND se.which = 'edited'
JOIN l le ON le.r = v.r AND le.which = 'edited' JOIN l ln ON ln.r = v.r AND ln.which = 'following'
"""
)
def op11_document_fingerprints(spark, sf_dir):
    """Fingerprint of every document and of its edited text, and their likeness."""
    return bloom_lookup.fingerprints(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


# Levels that the SQL writes out: a language has no more than 8 to this power of leaves there.
MERKLE_LEVELS = 8


def merkle_sql() -> str:
    """The trees level by level; each level has the run's siblings of every node that is not alone."""
    joined = "string_agg(digest, '' ORDER BY rank)"
    text = r"""
WITH t AS """ + CRC_TABLE + r""", f AS (
  SELECT *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered,
    coalesce('=' || lang, '') AS tree, """ + crc_of("doc_id") + r""" % 3 = 0 AS tampered
  FROM documents, t
), l AS (
  SELECT doc_id, tree, leaf, CASE WHEN tampered THEN sha256(start || coalesce(strlen(lowered) || ':' || lowered, '-')) ELSE leaf END AS given
  FROM (SELECT *, sha256(start || coalesce(strlen(text) || ':' || text, '-')) AS leaf FROM (SELECT *,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS start FROM f))
), a0 AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM l
), n0 AS (SELECT tree, place AS rank, leaf AS digest FROM a0
)"""  # fmt: skip
    for k in range(1, MERKLE_LEVELS + 1):
        text += f""", n{k} AS (
  SELECT tree, rank // 8 AS rank, CASE WHEN max(total) = 1 THEN max(digest) ELSE sha256({joined}) END AS digest
  FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS total FROM n{k - 1}) GROUP BY tree, rank // 8
)"""
    tops = [f"""u0 AS (
  SELECT row_number() OVER (ORDER BY tree) - 1 AS rank, tree, digest FROM n{MERKLE_LEVELS}
)"""]  # fmt: skip
    for k in (1, 2):
        tops.append(f"""u{k} AS (
  SELECT rank // 8 AS rank, CASE WHEN max(total) = 1 THEN max(digest) ELSE sha256({joined}) END AS digest
  FROM (SELECT *, count(*) OVER () AS total FROM u{k - 1}) GROUP BY rank // 8
)""")
    text += ", " + ", ".join(tops)
    text += ", b0 AS (SELECT a.*, u.rank AS branch, u.digest AS subroot, (SELECT digest FROM u2) AS root, '' AS others, given AS folded FROM a0 a JOIN u0 u USING (tree))"
    # Siblings to the left and right of each node in its run, and whether its level is the tree's last.
    steps = [(f"n{k}", "tree", f"place // {8**k}") for k in range(MERKLE_LEVELS)] + [(f"u{k}", "''", f"branch // {8**k}") for k in range(2)]
    for i, (level, tree, rank) in enumerate(steps):
        of = "s.tree" if level[0] == "n" else "''"
        text += f""", s{i} AS (
  SELECT {of} AS tree, rank, digest, count(*) OVER (PARTITION BY {of}) = 1 AS alone,
    coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
    coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
  FROM {level} s WINDOW w AS (PARTITION BY {of}, rank // 8 ORDER BY rank)
), b{i + 1} AS (
  SELECT b.* REPLACE (CASE WHEN alone THEN others ELSE others || before || after END AS others,
    CASE WHEN alone THEN folded ELSE sha256(before || folded || after) END AS folded)
  FROM b{i} b JOIN s{i} s ON s.tree = {"b.tree" if level[0] == "n" else "''"} AND s.rank = {rank}
)"""
    return text + f"""
SELECT doc_id, leaf, subroot, root, sha256(others) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM b{len(steps)}"""


@query(merkle_sql())
def op12_merkle_manifest(spark, sf_dir):
    """Leaf, proof and verdict of every document."""
    return merkle.verified(read_table(spark, sf_dir, "documents"))


@query(
    r"""
WITH t AS """
    + CRC_TABLE
    + r""", turns AS (
  SELECT conv_id, turn, strlen(coalesce(text, '')) AS size,
    sha256(CAST(strlen(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, ''))[1:32] AS k FROM conversations
), own AS (
  SELECT conv_id, list({'k': k, 'size': size} ORDER BY turn NULLS FIRST, k, size) AS turns FROM turns GROUP BY conv_id
), b AS (
  SELECT o.conv_id, coalesce(s.turns[1:h], []) || o.turns[h + 1:] AS turns
  FROM (SELECT own.*, """
    + crc_of("conv_id")
    + r""" % 9 AS h FROM own, t) o LEFT JOIN own s ON s.conv_id = o.conv_id - o.conv_id % 5
), p AS (
  SELECT conv_id, len(turns) AS n, d, list_transform(turns[1:d], lambda x: x.k) AS prefix, coalesce(turns[d].size, 0) AS size
  FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM b)
), node AS (
  SELECT prefix, d, min(conv_id) AS conv_id, count(*) AS n_convs, max(size) AS size,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends_sha256
  FROM p GROUP BY prefix, d
), kids AS (
  SELECT prefix[1:d - 1] AS prefix, count(*) AS n_children FROM node WHERE d > 0 GROUP BY 1
), whole AS (
  SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids USING (prefix)
), below AS (
  SELECT prefix[1:up] AS prefix, CAST(sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves,
    CAST(sum((n_convs - 1) * size) AS BIGINT) AS saved_tokens
  FROM (SELECT *, unnest(range(d + 1)) AS up FROM whole) GROUP BY 1
)
SELECT w.conv_id, w.d AS depth, u.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves, saved_tokens, w.ends_sha256
FROM whole w JOIN below USING (prefix) LEFT JOIN node u ON w.d > 0 AND u.prefix = w.prefix[1:w.d - 1]
"""
)
def op13_prefix_trie(spark, sf_dir):
    """Every node of the trie of rebuilt conversations."""
    return prefix_trie.trie(read_table(spark, sf_dir, "conversations"))
