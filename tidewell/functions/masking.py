"""Column masking with built-in expressions only.

Null stays null under every function. Other values are masked in their Spark string form,
which is the canonical text that hashes are taken of.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What each function writes, and the patterns it reads with.
REDACTED = "[REDACTED]"
MASKED = "***"
TOKEN_PREFIX = "tok_"
TOKEN_DIGITS = 16
EMAIL_PATTERN = r"(?d)^(.).*?(@.+)$"
EMAIL_FALLBACK = "***@***.***"
PHONE_PREFIX = "***-***-"
SSN_PREFIX = "***-**-"
CARD_PREFIX = "****-****-****-"
FOUR_HIDDEN = "****"
IP_SUFFIX = ".*.*"
IP_FALLBACK = "*.*.*.*"
NON_DIGITS = r"(?U)\D"
OUTER_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"

# Our own stand-ins for people; the pick depends only on the masked value.
PSEUDONYMS = (
    "Alder Finch", "Briar Cole", "Cedar Lane", "Dale Rowan", "Ember Quill", "Fern Hollis",
    "Glen Marlow", "Harper Sage", "Indigo Vale", "Juniper Reed", "Kestrel Ames", "Linden Frost",
    "Maple Hart", "North Avery", "Oakley Wren", "Pine Sutton",
)


def _last_four(text: Column, prefix: str) -> Column:
    digits = F.regexp_replace(text, NON_DIGITS, "")
    tail = F.when(F.length(digits) >= 4, F.right(digits, F.lit(4))).otherwise(F.lit(FOUR_HIDDEN))
    return F.concat(F.lit(prefix), tail)


def _email(text: Column) -> Column:
    part = lambda n: F.regexp_extract(text, EMAIL_PATTERN, n)
    masked = F.concat(part(1), F.lit(MASKED), part(2))
    return F.when(text.rlike(EMAIL_PATTERN), masked).otherwise(F.lit(EMAIL_FALLBACK))


def _ip(text: Column) -> Column:
    parts = F.split(text, r"\.")
    masked = F.concat(parts[0], F.lit("."), parts[1], F.lit(IP_SUFFIX))
    return F.when(F.size(parts) == 4, masked).otherwise(F.lit(IP_FALLBACK))


def _name(text: Column) -> Column:
    initial = F.left(F.regexp_replace(text, OUTER_SPACE, ""), F.lit(1))
    return F.concat(F.upper(initial), F.lit(MASKED))


def _pseudonym(text: Column) -> Column:
    bucket = F.conv(F.left(F.md5(text), F.lit(8)), 16, 10).cast("bigint") % len(PSEUDONYMS)
    names = F.array(*[F.lit(n) for n in PSEUDONYMS])
    return F.element_at(names, (bucket + 1).cast("int"))


MASKS: dict[str, Callable[[Column], Column]] = {
    "redact": lambda c: F.lit(REDACTED),
    "hash_sha256": lambda c: F.sha2(c, 256),
    "hash_md5": lambda c: F.md5(c),
    "mask": lambda c: F.lit(MASKED),
    "nullify": lambda c: F.lit(None).cast("string"),
    "tokenize": lambda c: F.concat(F.lit(TOKEN_PREFIX), F.left(F.sha2(c, 256), F.lit(TOKEN_DIGITS))),
    "mask_email": _email,
    "mask_phone": lambda c: _last_four(c, PHONE_PREFIX),
    "mask_ssn": lambda c: _last_four(c, SSN_PREFIX),
    "mask_card": lambda c: _last_four(c, CARD_PREFIX),
    "mask_ip": _ip,
    "mask_name": _name,
    "pseudonymize": _pseudonym,
}

ALIASES = {"hash": "hash_sha256"}

ALL_TABLES = "fields"


def mask_column(name: str, col: Column, data_type: T.DataType | None = None) -> Column:
    """Masked form of a column. An unknown name must not pass values in clear."""
    name = ALIASES.get(name, name)
    if name not in MASKS:
        raise ValueError(f"unknown masking function: {name}")
    if name == "nullify" and data_type is not None:
        return F.lit(None).cast(data_type)
    text = col.cast("string")
    return F.when(text.isNotNull(), MASKS[name](text))


def rules_for(rules: Mapping[str, Mapping[str, str]], table: str) -> dict[str, str]:
    """Rules of one table; the ``fields`` group holds for all of them."""
    return {**rules.get(ALL_TABLES, {}), **rules.get(table, {})}


def _mask_struct(struct: T.StructField, rules: Mapping[str, str]) -> Column:
    whole = F.col(struct.name)
    fields = [
        (
            mask_column(rules[f.name], whole.getField(f.name), f.dataType)
            if f.name in rules
            else whole.getField(f.name)
        ).alias(f.name)
        for f in struct.dataType.fields
    ]
    return F.when(whole.isNotNull(), F.struct(*fields))


def apply_masking(
    df: DataFrame,
    table: str,
    rules: Mapping[str, Mapping[str, str]],
    images: tuple[str, ...] = ("before", "after"),
) -> DataFrame:
    """Mask the columns a table has, at top level and inside both row images."""
    chosen = rules_for(rules, table)
    for name in chosen.values():
        mask_column(name, F.lit(None))
    masked = {}
    for f in df.schema.fields:
        if f.name in chosen:
            masked[f.name] = mask_column(chosen[f.name], F.col(f.name), f.dataType)
        elif f.name in images and isinstance(f.dataType, T.StructType):
            if set(chosen) & set(f.dataType.names):
                masked[f.name] = _mask_struct(f, chosen)
    return df.withColumns(masked) if masked else df
