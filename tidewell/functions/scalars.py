"""Small scalar conversions used by the payload transforms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MILLIS_PER_DAY = 86_400_000
FIRST_DATE_MILLIS = -62_135_596_800_000
LAST_DATE_MILLIS = 253_402_300_799_999


WHOLE_NUMBER = r"^[\s\p{Cntrl}]*[+-]?\d+[\s\p{Cntrl}]*$"


def try_whole(text: Column, type_name: str = "bigint") -> Column:
    """Whole number of a text, else null. Text that cannot be one is not cast at all: Spark
    raises and drops an error for every value that fails ``try_cast``."""
    return F.when(text.rlike(WHOLE_NUMBER), text.try_cast(type_name))


def urn_id(urn: Column | str) -> Column:
    """Number after the last colon of a URN; null where that is no number."""
    urn = F.col(urn) if isinstance(urn, str) else urn
    return try_whole(F.substring_index(urn, ":", -1))


def ms_to_date(millis: Column | str) -> Column:
    """ISO day, in UTC whatever the session zone, of epoch milliseconds."""
    millis = F.col(millis) if isinstance(millis, str) else millis
    day = F.floor(millis / MILLIS_PER_DAY).cast("int")
    return F.when(
        millis.between(FIRST_DATE_MILLIS, LAST_DATE_MILLIS),
        F.date_add(F.lit("1970-01-01").cast("date"), day).cast("string"),
    )


def date_from_parts(year: Column, month: Column, day: Column) -> Column:
    """``yyyy-MM-dd`` text of separate parts, padded; missing parts stay visible."""
    return F.format_string(
        "%s-%02d-%02d",
        F.coalesce(year.cast("string"), F.lit("")),
        F.coalesce(month.cast("int"), F.lit(0)),
        F.coalesce(day.cast("int"), F.lit(0)),
    )


def ad_metrics(impressions: Column, clicks: Column, cost: Column) -> dict[str, Column]:
    """Counts default to 0; a cost of 0 is no cost; ratios without a base are null, but ctr 0."""
    imp = F.coalesce(impressions, F.lit(0))
    clk = F.coalesce(clicks, F.lit(0))
    paid = F.nullif(cost.cast("double"), F.lit(0.0))
    return {
        "impressions": imp,
        "clicks": clk,
        "cost_in_local_currency": paid,
        "ctr": F.coalesce(F.try_divide(clk.cast("double"), imp.cast("double")), F.lit(0.0)),
        "average_cpc": F.try_divide(paid, clk.cast("double")),
        "average_cpm": F.try_divide(paid, imp.cast("double")) * 1000,
    }


def pivot_ids(pivot: Column, pivot_value: Column) -> dict[str, Column]:
    """Which entity an analytics row is about: the campaign, or else the creative."""
    by_campaign = pivot == "CAMPAIGN"
    return {
        "campaign_id": F.when(by_campaign, urn_id(pivot_value)),
        "creative_id": F.when(~by_campaign, urn_id(pivot_value)),
    }
