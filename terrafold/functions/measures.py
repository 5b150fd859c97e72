"""Numbers: units, growth, polygons, repairs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SQM_A_SQFT = 0.09290304
SQFT_A_SQM = 1 / SQM_A_SQFT


def number(c: Column) -> Column:
    """A finite double, else NULL."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def per_sqft(per_sqm: Column) -> Column:
    """Price a square foot from price a square metre (F32), converted once."""
    return per_sqm / F.lit(SQFT_A_SQM)


def change_percent(now: Column, before: Column) -> Column:
    """(now / before - 1) * 100; NULL unless ``before`` > 0 (F32)."""
    return F.when(before > 0, (now / before - 1) * 100)


def unit_price(price: Column, worth: Column, area: Column) -> Column:
    """Price a unit of area, else worth / area where both are positive."""
    return F.coalesce(price, F.when((worth > 0) & (area > 0), worth / area))


def extrapolate(current: Column, end: Column, horizon: Column, target: Column) -> Column:
    """``current`` grown to ``target`` at the monthly rate that reaches ``end``
    at ``horizon`` (F33); ``end`` where no rate can be had."""
    fits = (current > 0) & (horizon > 0) & (target > 0) & end.isNotNull()
    grown = current * F.pow(F.pow(end / current, 1 / horizon.cast("double")), target.cast("double"))
    return F.when(F.coalesce(fits, F.lit(False)), grown).otherwise(end)


def extrapolate_or_null(current: Column, end: Column, horizon: Column, target: Column) -> Column:
    """As ``extrapolate``, but NULL where no rate can be had."""
    fits = (current > 0) & (horizon > 0) & (target > 0) & end.isNotNull()
    return F.when(F.coalesce(fits, F.lit(False)), extrapolate(current, end, horizon, target))


def polygon(points: Column) -> Column:
    """struct(lon, lat, area) of a ring of struct(lon, lat) by the shoelace formula.

    Fewer than 3 points give NULL; no area gives the mean point and 0. One pass
    over the ring keeps all sums. Name the struct in a select of its own before
    taking its fields, or each field computes it again.
    """
    # A ring that is not closed is closed by its first point.
    ring = F.when(F.element_at(points, 1) == F.element_at(points, -1), points).otherwise(F.concat(points, F.slice(points, 1, 1)))
    none, zero = F.lit(None).cast("double"), F.nullif(F.lit(0.0), F.lit(1.0))  # sums may become NULL
    sums = ("twice", "lon", "lat", "x", "y")
    start = F.struct(F.lit(0).alias("k"), F.lit(0).alias("n"), none.alias("x1"), none.alias("y1"), *[zero.alias(s) for s in sums])

    def step(s: Column, q: Column) -> Column:
        # From the point before to this one; the first has none before, and none leads to a NULL.
        x, y, x2, y2 = s["x1"], s["y1"], q["lon"], q["lat"]
        on, cross = (s["k"] > 0) & q.isNotNull(), x * y2 - x2 * y
        more = dict(zip(sums, (cross, (x + x2) * cross, (y + y2) * cross, x, y)))
        added = [F.when(on, s[c] + v).otherwise(s[c]).alias(c) for c, v in more.items()]
        return F.struct((s["k"] + 1).alias("k"), (s["n"] + on.cast("int")).alias("n"), x2.alias("x1"), y2.alias("y1"), *added)

    def result(s: Column) -> Column:
        centre = F.struct((s["lon"] / (3 * s["twice"])).alias("lon"), (s["lat"] / (3 * s["twice"])).alias("lat"), (F.abs(s["twice"]) / 2).alias("area"))
        mean = F.struct((s["x"] / s["n"]).alias("lon"), (s["y"] / s["n"]).alias("lat"), F.lit(0.0).alias("area"))
        return F.when(s["twice"] != 0, centre).otherwise(mean)

    return F.when(F.size(points) >= 3, F.aggregate(ring, start, step, result))


def repair_rent(rent: Column, area: Column, most: float = 2000.0) -> Column:
    """A rent entered a hundredfold: rent / area above ``most`` is divided by 100."""
    return F.when((area > 0) & (rent / area > most), rent / 100).otherwise(rent)


def buckets(c: Column, edges: list[tuple[float, str]]) -> Column:
    """Label of the last edge at or below the value (P16); ``[low, high)``."""
    found = F.when(F.lit(False), "")
    for low, label in sorted(edges, reverse=True):
        found = found.when(c >= low, label)
    return found


# Lower edges of price and rent buckets.
PRICE_BUCKETS = [
    (0, "0-100K"), (1e5, "100K-500K"), (5e5, "500K-1M"), (1e6, "1M-2M"), (2e6, "2M-5M"), (5e6, "5M-10M"), (1e7, "10M-50M"), (5e7, "50M+"),
]
RENT_BUCKETS = [
    (0, "0-20K"), (2e4, "20K-40K"), (4e4, "40K-60K"), (6e4, "60K-80K"), (8e4, "80K-100K"), (1e5, "100K-150K"), (1.5e5, "150K-200K"),
    (2e5, "200K-300K"), (3e5, "300K-500K"), (5e5, "500K+"),
]
