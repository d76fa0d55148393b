"""Quality rules kept as a ledger: each text is measured once, every failed rule is one bit.

Policies are versioned lists of rules. A verdict is one bitwise and of the ledger with a policy's
mask, so new policies and ablations never read a text again.

Defined results: a null or empty text has no words and fails ``few_words``; null ids stay null;
repeated rows are judged one by one; an empty table gives an empty ledger; columns of the input
named like ledger columns are replaced by those of the ledger.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm.text import struct_udf, without, words

WINDOW = 5
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123))

MEASURES = T.StructType(
    [
        T.StructField(name, T.LongType())
        for name in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letters", "n_upper")
    ]
)

# Rule: what fails it, over the measurements. The place in the list is the rule's bit, for ever:
# append only.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "2 * n_dup_lines > n_lines"),
    ("capitals", "n_letters >= 20 AND 2 * n_upper > n_letters"),
    ("word_length", "n_words >= 10 AND (word_chars < 2 * n_words OR word_chars > 15 * n_words)"),
)
BASE = ("few_words", "repeated_windows")
POLICIES: dict[str, tuple[str, ...]] = {
    "base": BASE,
    "v1": (*BASE, "symbols", "repeated_lines", "capitals", "word_length"),
}


def mask(rules: tuple[str, ...]) -> int:
    bit = {name: 1 << i for i, (name, _) in enumerate(RULES)}
    return sum(bit[r] for r in rules)


def repeated_words(found: list[bytes], size: int = WINDOW) -> int:
    """Words that lie in a window of ``size`` words found twice or more, the first included."""
    windows = list(zip(*(found[i:] for i in range(size))))
    if len(set(windows)) == len(windows):
        return 0
    times = Counter(windows)
    covered = end = 0
    for i, window in enumerate(windows):
        if times[window] > 1:
            covered += i + size - max(i, end)
            end = i + size
    return covered


def measure(text: bytes) -> tuple[int, ...]:
    found = words(text)
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (
        len(found),
        len(b"".join(found).decode("utf-8", "replace")),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(found),
        len(text) - len(text.translate(None, LETTERS)),
        len(text) - len(text.translate(None, UPPER)),
    )


def failed_bits() -> Column:
    """The rules as bits over measurement columns."""
    bits = [F.when(F.expr(test), F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, test) in enumerate(RULES)]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return total.cast("long")


def rule_ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with their measurements and ``failed_bits``; one pass, no shuffle."""
    names = MEASURES.fieldNames()
    kept = without(docs, [*names, "failed_bits", "__m"])
    measured = struct_udf(lambda: measure, MEASURES)(F.col(text))
    return (
        kept.withColumn("__m", measured)
        .select(*kept.columns, *(F.col(f"__m.{n}").alias(n) for n in names))
        .withColumn("failed_bits", failed_bits())
    )


def passes(policy: str = "v1", bits: str = "failed_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0


def ablation(ledger: DataFrame, policy: str = "v1") -> DataFrame:
    """What each rule of a policy does: rows it fails, rows only it rejects, rows kept without it.

    The ledger is first counted by its bit patterns, at most two to the number of rules.
    """
    whole = mask(POLICIES[policy])
    patterns = ledger.groupBy("failed_bits").count()
    rules = F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(mask((n,))).cast("long").alias("bit")) for n in POLICIES[policy]))
    each = patterns.select("failed_bits", "count", F.inline(rules))
    hit = F.col("failed_bits").bitwiseAND(F.lit(whole))
    rest = F.col("failed_bits").bitwiseAND(F.lit(whole).bitwiseXOR(F.col("bit")))
    total = lambda test: F.sum(F.when(test, F.col("count")).otherwise(0))
    return each.groupBy("rule", "bit").agg(
        total(F.col("failed_bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        total(hit == F.col("bit")).alias("n_only"),
        total(rest == 0).alias("n_kept_without"),
    )


def keep_good(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """The rows that a policy keeps, with the columns of the input only."""
    # The input is put away first, so that none of its names can clash.
    inner = docs.select(F.struct(*docs.columns).alias("__row"), struct_udf(lambda: measure, MEASURES)(F.col("text")).alias("__m"))
    flat = inner.select("__row", "__m.*").where(failed_bits().bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0)
    return flat.select("__row.*")
