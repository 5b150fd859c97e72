"""Date expressions. Months are first-of-month dates inside, ``yyyy-MM`` at the edge."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

DAYS_A_MONTH = 30.44
FORMATS = ("dd-MM-yyyy", "yyyy-MM-dd", "dd/MM/yyyy", "yyyy/MM/dd", "yyyy-MM-dd HH:mm:ss")
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def parse_date(c: Column, format: str = "dd-MM-yyyy") -> Column:
    """Strict; what does not parse is NULL."""
    return F.to_date(F.try_to_timestamp(c, F.lit(format)))


def parse_flexible(c: Column, formats: tuple[str, ...] = FORMATS) -> Column:
    """The first of ``formats`` that fits, day first."""
    return F.coalesce(*[parse_date(c, f) for f in formats])


def month_of(c: Column) -> Column:
    return F.trunc(c, "month")


def month_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")


def parts(c: Column) -> list[Column]:
    """year, month, quarter, year_month."""
    return [F.year(c).alias("year"), F.month(c).alias("month"), F.quarter(c).alias("quarter"), month_text(c).alias("year_month")]


def months_apart(later: Column, earlier: Column, days: float = DAYS_A_MONTH) -> Column:
    """Days over ``days`` (F27); signed, NULL if either is."""
    return F.datediff(later, earlier) / F.lit(days)


def not_below_zero(c: Column) -> Column:
    """NULL stays NULL (``greatest`` alone would make it 0)."""
    return F.when(c.isNotNull(), F.greatest(c, F.lit(0.0)))


def phase_features(at: Column, start: Column, handover: Column, window: float = 6.0) -> list[Column]:
    """Months to and since handover, near-handover flag, share of the phase passed."""
    signed = months_apart(handover, at)
    length, passed = months_apart(handover, start), months_apart(at, start)
    ratio = F.when(length > 0, passed / length)
    return [
        signed.alias("months_to_handover_signed"),
        not_below_zero(signed).alias("months_to_handover"),
        not_below_zero(-signed).alias("months_since_handover"),
        F.coalesce((F.abs(signed) <= window).cast("int"), F.lit(0)).alias("near_handover"),
        F.when(ratio.isNotNull(), F.least(F.greatest(ratio, F.lit(0.0)), F.lit(1.0))).alias("phase_ratio"),
    ]


def lifecycle(reg_type: Column, at: Column, handover: Column) -> list[Column]:
    """Off-plan at or after handover counts as ready, and is flagged."""
    flips = F.coalesce((reg_type == "OffPlan") & (at >= handover), F.lit(False))
    return [F.when(flips, "Ready").otherwise(reg_type).alias("reg_type"), flips.cast("int").alias("offplan_after_handover")]


def calendar_encodings(month: Column) -> list[Column]:
    """Month and quarter, and the month on a circle."""
    turn = 2 * math.pi * F.month(month) / 12
    return [F.month(month).alias("month"), F.quarter(month).alias("quarter"), F.sin(turn).alias("month_sin"), F.cos(turn).alias("month_cos")]


def handover_months(query: Column, as_of: Column) -> Column:
    """Months to a handover that a text names.

    ``handover in 18 months``; or a year, with a month before it (else June),
    counted from ``as_of``. Past ones give NULL.
    """
    text = F.lower(query)
    said = F.nullif(F.regexp_extract(text, r"handover\s*(?:in)?\s*(\d{1,2})\s*months?", 1), F.lit(""))
    year = F.nullif(F.regexp_extract(text, r"\b(20\d{2})\b", 1), F.lit("")).cast("int")
    name = F.regexp_extract(text, r"\b(" + "|".join(MONTHS) + r")[a-z]*\s*20\d{2}\b", 1)
    month = F.when(name != "", F.array_position(F.array(*[F.lit(m) for m in MONTHS]), name)).otherwise(6)
    ahead = (year - F.year(as_of)) * 12 + (month - F.month(as_of))
    return F.coalesce(said.cast("int"), F.when(ahead >= 0, ahead).cast("int"))
