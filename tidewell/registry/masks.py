"""Checked queries: masking."""

from pyspark.sql import functions as F

from tidewell.functions.masking import PSEUDONYMS, apply_masking, mask_column
from tidewell.registry.base import ORACLES, query
from tidewell.registry.inputs import SQL_PEOPLE, people


def _masked(spark, sf, column, fn):
    df = people(spark, sf)
    return df.select("id", mask_column(fn, F.col(column), df.schema[column].dataType).alias("masked"))


def _sql(expr):
    return f"WITH {SQL_PEOPLE} SELECT id, {expr} AS masked FROM people"


def _last_four(column, prefix):
    digits = f"regexp_replace({column}, '[^0-9]', '', 'g')"
    return _sql(
        f"CASE WHEN {column} IS NULL THEN NULL WHEN length({digits}) >= 4 "
        f"THEN '{prefix}' || right({digits}, 4) ELSE '{prefix}****' END"
    )


@query(_sql("CASE WHEN email IS NOT NULL THEN '[REDACTED]' END"))
def mask_redact(spark, sf):
    return _masked(spark, sf, "email", "redact")


@query(_sql("sha256(email)"))
def mask_sha256(spark, sf):
    return _masked(spark, sf, "email", "hash_sha256")


@query(_sql("md5(ssn)"))
def mask_md5(spark, sf):
    return _masked(spark, sf, "ssn", "hash_md5")


@query(_sql("CASE WHEN name IS NOT NULL THEN '***' END"))
def mask_fixed(spark, sf):
    return _masked(spark, sf, "name", "mask")


@query(_sql("CAST(NULL AS VARCHAR)"))
def mask_nullify(spark, sf):
    return _masked(spark, sf, "phone", "nullify")


@query(_sql("'tok_' || substr(sha256(card), 1, 16)"))
def mask_tokenize(spark, sf):
    return _masked(spark, sf, "card", "tokenize")


@query(
    _sql(
        "CASE WHEN email IS NULL THEN NULL WHEN instr(substr(email, 2), '@') > 0 "
        "AND instr(substr(email, 2), '@') < length(email) - 1 "
        "THEN left(email, 1) || '***' || substr(email, instr(substr(email, 2), '@') + 1) "
        "ELSE '***@***.***' END"
    )
)
def mask_email(spark, sf):
    return _masked(spark, sf, "email", "mask_email")


@query(_last_four("phone", "***-***-"))
def mask_phone(spark, sf):
    return _masked(spark, sf, "phone", "mask_phone")


@query(_last_four("ssn", "***-**-"))
def mask_ssn(spark, sf):
    return _masked(spark, sf, "ssn", "mask_ssn")


@query(_last_four("card", "****-****-****-"))
def mask_card(spark, sf):
    return _masked(spark, sf, "card", "mask_card")


@query(
    _sql(
        "CASE WHEN ip IS NULL THEN NULL WHEN len(string_split(ip, '.')) = 4 "
        "THEN split_part(ip, '.', 1) || '.' || split_part(ip, '.', 2) || '.*.*' ELSE '*.*.*.*' END"
    )
)
def mask_ip(spark, sf):
    return _masked(spark, sf, "ip", "mask_ip")


@query(_sql("upper(left(trim(name, ' ' || chr(9)), 1)) || '***'"))
def mask_name(spark, sf):
    return _masked(spark, sf, "name", "mask_name")


@query(
    _sql(
        "list_extract(["
        + ", ".join(f"'{n}'" for n in PSEUDONYMS)
        + f"], CAST(CAST('0x' || substr(md5(name), 1, 8) AS BIGINT) % {len(PSEUDONYMS)} AS INTEGER) + 1)"
    )
)
def mask_pseudonymize(spark, sf):
    return _masked(spark, sf, "name", "pseudonymize")


RULES = {
    "fields": {"email": "hash"},
    "crm.people": {"phone": "mask_phone", "card": "mask_card", "balance": "nullify", "absent": "redact"},
}


@query(
    f"""WITH {SQL_PEOPLE}
    SELECT id, sha256(email) AS email,
      CASE WHEN phone IS NULL THEN NULL WHEN length(regexp_replace(phone, '[^0-9]', '', 'g')) >= 4
        THEN '***-***-' || right(regexp_replace(phone, '[^0-9]', '', 'g'), 4) ELSE '***-***-****' END AS phone,
      ssn,
      CASE WHEN card IS NULL THEN NULL WHEN length(regexp_replace(card, '[^0-9]', '', 'g')) >= 4
        THEN '****-****-****-' || right(regexp_replace(card, '[^0-9]', '', 'g'), 4)
        ELSE '****-****-****-****' END AS card,
      ip, name, CAST(NULL AS DOUBLE) AS balance
    FROM people"""
)
def mask_ruleset(spark, sf):
    return apply_masking(people(spark, sf), "crm.people", RULES)


EVERY_FUNCTION = {
    "email": ("redact", "hash_sha256", "hash_md5", "mask", "nullify", "tokenize", "mask_email"),
    "phone": ("mask_phone",),
    "ssn": ("mask_ssn",),
    "card": ("mask_card",),
    "ip": ("mask_ip",),
    "name": ("mask_name",),
}


def _expression(sql):
    """The expression inside ``_sql``'s text."""
    return sql.split("SELECT id, ", 1)[1].rsplit(" AS masked FROM people", 1)[0]


@query(
    f"""WITH {SQL_PEOPLE}
    SELECT id, CASE WHEN email IS NOT NULL THEN '[REDACTED]' END AS redact, sha256(email) AS hash_sha256,
      md5(email) AS hash_md5, CASE WHEN email IS NOT NULL THEN '***' END AS mask, CAST(NULL AS VARCHAR) AS nullify,
      'tok_' || substr(sha256(email), 1, 16) AS tokenize, {_expression(ORACLES["mask_email"])} AS mask_email,
      {_expression(ORACLES["mask_phone"])} AS mask_phone, {_expression(ORACLES["mask_ssn"])} AS mask_ssn,
      {_expression(ORACLES["mask_card"])} AS mask_card, {_expression(ORACLES["mask_ip"])} AS mask_ip,
      {_expression(ORACLES["mask_name"])} AS mask_name
    FROM people"""
)
def mask_all_functions(spark, sf):
    """All twelve functions in one projection."""
    df = people(spark, sf)
    return df.select(
        "id", *[mask_column(fn, F.col(c)).alias(fn) for c, fns in EVERY_FUNCTION.items() for fn in fns]
    )
