"""Document fingerprints as invertible Bloom lookup sketches, and the likeness of two versions by peeling.

A text is the set of its paragraphs' digests: lines, cut every ``PARAGRAPH`` code points where they are longer. A
sketch has three parts of ``width`` cells; a digest goes into one cell of each part. A cell holds
how many digests it has, their bits combined by exclusive or, and their checks combined alike. Sketches of two
versions subtract cell by cell, and what both have goes away. A cell left with one digest gives it up; taken out
of its other cells it frees more, until all cells are empty and every differing digest is known. If cells are left, the
two are sketched again twice as large, up to ``TRIES`` times. Two texts with many paragraphs are
compared in parts, digests dealt out by their checks, so the work of a comparison grows with the texts.

All steps are column expressions. Texts move twice: each to its own key, and its first half to the document before
it. Which that is follows from a table of ids, ranked by ranges.

Defined results: a null text is empty; null ids come last; rows with equal ids are in order of their texts' MD5, of
equal rows each but the last is followed by its like; texts without paragraphs are alike to degree 1; a likeness is null
if all tries fail, which takes three digests in the same cells at every size; an empty table gives no row; extra columns
are left out. Paragraphs go by 60 bits of their MD5.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.components import stored
from tidewell.llm.ordering import ranked

PARAGRAPH = 240
PARTS = 3
BASE_WIDTH = 4
TRIES = 10
ROUNDS = 40
TOGETHER = 128

CELL = "struct<n:bigint,k:bigint,c:bigint>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body with the value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def paragraphs(text: Column) -> Column:
    """Digests of the distinct paragraphs of a text."""
    found = F.regexp_extract_all(text, F.lit(r"[^\n]{1,%d}" % PARAGRAPH), F.lit(0))
    return F.array_distinct(F.transform(found, lambda p: F.conv(F.substring(F.md5(p), 1, 15), 16, 10).cast("long")))


def check(digest: Column) -> Column:
    """31 bits that follow from a digest, and not from exclusive or of other checks."""
    low, high = digest.bitwiseAND(F.lit((1 << 30) - 1)), F.shiftright(digest, 30)
    return (low * F.lit(1000003) + high * F.lit(998244353)) % F.lit(2147483647)


def places(digest: Column, width: Column) -> Column:
    """The cell of a digest in each part: 20 of its bits each."""
    of = lambda i: F.shiftright(digest, 20 * i).bitwiseAND(F.lit((1 << 20) - 1)) % width + width * i
    return F.array(*(of(i) for i in range(PARTS)))


def cell(n: Column, k: Column, c: Column) -> Column:
    return F.struct(n.alias("n"), k.alias("k"), c.alias("c"))


def entries(digests: Column, n: Callable[[Column], Column], key: Callable[[Column], Column], width: Column) -> Column:
    """Digests with what they put into their cells, and the cells."""
    return F.transform(digests, lambda d: F.struct(n(d).alias("n"), key(d).alias("k"), check(key(d)).alias("c"), places(key(d), width).alias("at")))


def put(cells: Column, given: Column, sign: int) -> Column:
    """Cells with the given entries added or taken out."""

    def one(have: Column, j: Column) -> Column:
        here = F.filter(given, lambda e: F.array_contains(e["at"], j.cast("long")))
        return F.aggregate(here, have, lambda x, e: cell(x["n"] + sign * e["n"], x["k"].bitwiseXOR(e["k"]), x["c"].bitwiseXOR(e["c"])))

    return F.transform(cells, one)


def sketch(digests: Column, width: Column) -> Column:
    """Cells of a set of digests."""
    zero = F.lit(0).cast("long")
    empty = F.array_repeat(cell(zero, zero, zero), (width * PARTS).cast("int"))
    return let(entries(digests, lambda d: F.lit(1).cast("long"), lambda d: d, width), lambda given: put(empty, given, 1))


def subtracted(one: Column, other: Column) -> Column:
    return F.zip_with(one, other, lambda a, b: cell(a["n"] - b["n"], a["k"].bitwiseXOR(b["k"]), a["c"].bitwiseXOR(b["c"])))


def peeled(cells: Column, width: Column) -> Column:
    """How many digests the cells hold, of either version; null if some cannot be had out."""

    def pure(cells: Column) -> Column:
        alone = F.filter(cells, lambda x: (F.abs(x["n"]) == 1) & (check(x["k"]) == x["c"]))
        return entries(F.array_distinct(alone), lambda x: x["n"], lambda x: x["k"], width)

    def step(state: Column, _: Column) -> Column:
        def out(found: Column) -> Column:
            left = F.when(F.size(found) > 0, put(state["cells"], found, -1)).otherwise(state["cells"])
            return F.struct(left.alias("cells"), (state["n"] + F.size(found)).alias("n"), (F.size(found) == 0).alias("over"))

        return F.when(state["over"], state).otherwise(let(pure(state["cells"]), out))

    start = F.struct(cells.cast(f"array<{CELL}>").alias("cells"), F.lit(0).cast("long").alias("n"), F.lit(False).alias("over"))
    empty = lambda cells: F.forall(cells, lambda x: (x["n"] == 0) & (x["k"] == 0) & (x["c"] == 0))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda s: F.when(empty(s["cells"]), s["n"]))


def differing(one: Column, other: Column) -> Column:
    """Number of digests that only one of two sets has, by sketches as large as it takes."""

    def attempt(found: Column, t: Column) -> Column:
        again = let(
            F.expr(f"{BASE_WIDTH}L") * F.pow(F.lit(2.0), t).cast("long"),
            lambda width: peeled(subtracted(sketch(one, width), sketch(other, width)), width),
        )
        return F.coalesce(found, again)

    return F.aggregate(F.sequence(F.lit(0), F.lit(TRIES - 1)), F.lit(None).cast("long"), attempt)


def likeness(one: Column, other: Column) -> Column:
    """Twice the digests that both sets have over the digests of both, by what differs."""
    both = (F.size(one) + F.size(other)).cast("long")
    shards = F.ceil(both / TOGETHER)
    part = lambda of, n, i: F.filter(of, lambda d: check(d) % n == i)
    one_part = lambda n, i: differing(part(one, n, i), part(other, n, i))
    in_parts = F.aggregate(F.sequence(F.lit(0).cast("long"), shards - 1), F.lit(0).cast("long"), lambda have, i: have + one_part(shards, i))
    differ = F.when(shards <= 1, differing(one, other)).otherwise(in_parts)
    return F.when(both == 0, F.lit(1.0)).otherwise((both - differ) / both)


def fingerprint(digests: Column) -> Column:
    """The base sketch as text: each cell's count, digest bits and check bits in hex."""
    hexed = lambda value, n: F.lower(F.lpad(F.hex(value), n, "0"))
    cells = sketch(digests, F.expr(f"{BASE_WIDTH}L"))
    return F.array_join(F.transform(cells, lambda x: F.concat(hexed(x["n"], 6), hexed(x["k"], 15), hexed(x["c"], 8))), "")


def followed(docs: DataFrame) -> DataFrame:
    """Distinct rows as ``doc_id, text, n_chars, half`` with the ``head`` and paragraphs of the next document.

    ``times`` says how many rows are so followed.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("k", F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.md5("text")))
    keys = rows.select("k", "doc_id", F.char_length("text").alias("n_chars")).groupBy("k", "doc_id", "n_chars").agg(F.count("*").alias("copies"))
    order = ranked(keys.withColumn("all", F.lit(0)), "all", [F.col("doc_id").desc_nulls_last(), F.col("k")], "order").drop("all")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    before = order.select(F.col("k").alias("before_k"), half.alias("before_half"), ((F.col("rank") + 1) % F.col("group_n")).alias("rank"))
    order = stored(order.join(before, "rank").withColumn("half", half).drop("rank", "group_n"), "followed")
    own = order.join(rows.select("k", "text").dropDuplicates(["k"]), "k")
    sent = own.select(F.col("before_k").alias("k"), F.substring(F.col("text"), F.lit(1), F.col("before_half")).alias("head"), paragraphs(F.col("text")).alias("next"))
    both = own.select("k", "doc_id", "n_chars", "half", "copies", "text", paragraphs(F.col("text")).alias("own")).join(sent, "k")
    case = lambda times, head, following: F.struct(times.alias("times"), head.alias("head"), following.alias("next"))
    last = case(F.lit(1).cast("long"), F.col("head"), F.col("next"))
    like = case(F.col("copies") - 1, F.substring(F.col("text"), F.lit(1), F.col("half")), F.col("own"))
    cases = F.when(F.col("copies") > 1, F.array(last, like)).otherwise(F.array(last))
    return both.select("doc_id", "text", "n_chars", "half", "own", F.inline(cases))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Every row with its fingerprint, that of its edited text, and the likeness to that and to the next document."""
    rows = followed(docs)
    kept = F.substring(F.col("text"), F.lit(1), F.col("n_chars") - F.col("half"))
    rows = rows.select("doc_id", "n_chars", "own", "next", "times", F.concat(kept, F.col("head")).alias("edited"))
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "own", "next", "times", paragraphs(F.col("edited")).alias("edited"))
    found = rows.select(
        "doc_id",
        F.col("n_chars").cast("long").alias("n_chars"),
        "edited_sha256",
        fingerprint(F.col("own")).alias("fingerprint"),
        fingerprint(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited")).alias("near_edited"),
        likeness(F.col("own"), F.col("next")).alias("near_next"),
        "times",
    )
    each = F.explode(F.when(F.col("times") > 1, F.array_repeat(F.lit(1), F.col("times").cast("int"))).otherwise(F.array(F.lit(1))))
    return found.withColumn("each", each).drop("times", "each")
