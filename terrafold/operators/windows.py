"""Per-series window operators. Every order is total, so reruns agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order(keys: list[str], *order: str | Column):
    return Window.partitionBy(*keys).orderBy(*order)


def series_index(df: DataFrame, keys: list[str], order: list[str], out: str = "time_idx") -> DataFrame:
    """Rows of a series numbered from 0."""
    return df.withColumn(out, F.row_number().over(_order(keys, *order)) - 1)


def fill_both_ways(c: str, keys: list[str], order: str) -> Column:
    """Last value before, else first value after."""
    back = _order(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    ahead = _order(keys, order).rowsBetween(0, Window.unboundedFollowing)
    return F.coalesce(F.last(c, True).over(back), F.first(c, True).over(ahead))


def fill_forward(c: str, keys: list[str], order: str) -> Column:
    """Last value up to the row."""
    return F.last(c, True).over(_order(keys, order).rowsBetween(Window.unboundedPreceding, 0))


def fill_interior(df: DataFrame, columns: list[str], keys: list[str], order: str) -> DataFrame:
    """Fill gaps between the first and last value only; flag what is missing."""
    whole = Window.partitionBy(*keys)
    for c in columns:
        at = F.when(F.col(c).isNotNull(), F.col(order))
        inside = F.col(order).between(F.min(at).over(whole), F.max(at).over(whole))
        df = df.withColumn(f"{c}_missing", F.col(c).isNull().cast("int")).withColumn(
            c, F.when(F.coalesce(inside, F.lit(False)), fill_forward(c, keys, order)).otherwise(F.lit(0.0))
        )
    return df


def difference(c: str, n: int, keys: list[str], order: str) -> Column:
    """Change against n rows before."""
    return F.col(c) - F.lag(c, n).over(_order(keys, order))


def percent_change(c: str, n: int, keys: list[str], order: str) -> Column:
    """Percent change against n rows before."""
    return (F.try_divide(F.col(c), F.lag(c, n).over(_order(keys, order))) - 1) * 100


def rolling_std(c: str, n: int, keys: list[str], order: str) -> Column:
    """Sample deviation of n rows, NULL until there are n values."""
    w = _order(keys, order).rowsBetween(1 - n, 0)
    return F.when(F.count(c).over(w) == n, F.stddev_samp(c).over(w))


def from_the_end(df: DataFrame, keys: list[str], order: str, out: str = "back") -> DataFrame:
    """Rows numbered from 1 backwards; 1 is the latest."""
    return df.withColumn(out, F.row_number().over(_order(keys, F.col(order).desc())))


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The latest row per series."""
    return from_the_end(df, keys, order, "_b").filter("_b = 1").drop("_b")


def tail(df: DataFrame, keys: list[str], order: str, rows: int = 96) -> DataFrame:
    """The last rows of each series."""
    return from_the_end(df, keys, order, "_b").filter(F.col("_b") <= rows).drop("_b")


def drop_running_month(df: DataFrame, keys: list[str], month: str, as_of: Column) -> DataFrame:
    """Without a last row in the month of ``as_of``, if a series has 4 rows."""
    n = F.count("*").over(Window.partitionBy(*keys))
    running = (F.trunc(month, "month") == F.trunc(as_of, "month")) & (n >= 4)
    return df.withColumn("_run", running).filter(~F.coalesce("_run", F.lit(False))).drop("_run")


def at_back(value: str, back: int, number: str = "back") -> Column:
    """The value at a position from the end, in a groupBy."""
    return F.max(F.when(F.col(number) == back, F.col(value)))


def momentum(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Changes over 3, 6, 12 rows and the trend (W10, W11); needs 13 values."""
    seen = from_the_end(df.filter(F.col(value).isNotNull()), keys, order)
    points = seen.filter(F.col("back") <= 13).groupBy(*keys).agg(
        *[at_back(value, b).alias(f"v{b}") for b in (1, 4, 7, 13)], F.max("back").alias("rows")
    )
    full = points.filter("rows >= 13")
    change = lambda b: F.when(F.col(f"v{b}") > 0, (F.col("v1") / F.col(f"v{b}") - 1) * 100).otherwise(0.0)
    out = full.select(*keys, change(4).alias("change_3m"), change(7).alias("change_6m"), change(13).alias("change_12m"))
    half = F.col("change_6m") / 2
    trend = F.when(F.col("change_3m") > half + 2, "accelerating").when(F.col("change_3m") < half - 2, "decelerating").otherwise("stable")
    return out.withColumn("trend", trend)


def change_at(df: DataFrame, keys: list[str], order: str, value: str, back: int, out: str, percent: bool = True) -> DataFrame:
    """Latest value against the one at a position from the end (W12: 12, W16: 6 or 7)."""
    seen = from_the_end(df.filter(F.col(value).isNotNull()), keys, order)
    p = seen.filter(F.col("back").isin(1, back)).groupBy(*keys).agg(at_back(value, 1).alias("a"), at_back(value, back).alias("b"))
    moved = F.when(F.col("b") > 0, (F.col("a") / F.col("b") - 1) * 100) if percent else F.col("a") - F.col("b")
    return p.select(*keys, moved.alias(out))


def volume_trend(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Mean of the last 3 rows against rows 13 to 15 from the end (W13); needs 15."""
    seen = from_the_end(df.filter(F.col(value).isNotNull()), keys, order).filter(F.col("back") <= 15)
    p = seen.groupBy(*keys).agg(
        F.avg(F.when(F.col("back") <= 3, F.col(value))).alias("recent_avg"),
        F.avg(F.when(F.col("back") >= 13, F.col(value))).alias("year_ago_avg"),
        F.max("back").alias("rows"),
    )
    moved = F.when(F.col("year_ago_avg") > 0, (F.col("recent_avg") / F.col("year_ago_avg") - 1) * 100).otherwise(0.0)
    return p.filter("rows >= 15").select(*keys, "recent_avg", "year_ago_avg", moved.alias("volume_trend"))


def tail_sum(df: DataFrame, keys: list[str], order: str, value: str, rows: int, out: str) -> DataFrame:
    """Sum and mean over the last rows."""
    seen = tail(df, keys, order, rows)
    return seen.groupBy(*keys).agg(F.sum(value).alias(out), F.avg(value).alias(f"{out}_mean"))


def gaps(df: DataFrame, keys: list[str], index: str) -> DataFrame:
    """Series whose rows are fewer than their last index + 1."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows"), F.max(index).alias("last")).filter("rows <> last + 1")


def length_classes(df: DataFrame, keys: list[str]) -> DataFrame:
    """How many series have < 12, < 24 and >= 24 rows."""
    n = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("series"), F.count_if(F.col("n") < 12).alias("lt12"), F.count_if(F.col("n") < 24).alias("lt24"), F.count_if(F.col("n") >= 24).alias("ge24"))


def train_rows(df: DataFrame, index: str, horizon: int) -> DataFrame:
    """Rows at least ``horizon`` before the last index."""
    last = df.agg(F.max(index).alias("_last"))
    return df.crossJoin(last).filter(F.col(index) <= F.col("_last") - horizon).drop("_last")  # one row


def folds(df: DataFrame, month: str, ends: list[str]) -> DataFrame:
    """Expanding walk-forward folds (W24): fold k has the months up to its end."""
    table = F.array(*[F.struct(F.lit(k).alias("fold"), F.lit(e).cast("date").alias("fold_end")) for k, e in enumerate(ends)])
    return df.select("*", F.inline(table)).filter(F.col(month) <= F.col("fold_end"))


def quarters_to_months(df: DataFrame, year: str, quarter: str) -> DataFrame:
    """A row per month of the quarter, values unchanged."""
    first = F.make_date(F.col(year), 3 * F.try_to_number(F.regexp_extract(quarter, r"([1-4])", 1), F.lit("9")).cast("int") - 2, F.lit(1))
    return df.filter(F.col(quarter).rlike(r"^Q?[1-4]$")).withColumn("month", F.explode(F.sequence(first, F.add_months(first, 2), F.expr("interval 1 month"))))


def future_rows(df: DataFrame, keys: list[str], month: str, horizon: int, means: list[str] = (), carry: list[str] = ()) -> DataFrame:
    """``horizon`` rows after the latest of each series.

    Month and encodings go on, ``carry`` keeps the latest value, ``means`` the
    mean of the last 6 rows.
    """
    recent = tail(df, keys, month, 6).groupBy(*keys).agg(*[F.avg(c).alias(c) for c in means], F.max(month).alias("_last"))
    kept = latest(df, keys, month).select(*keys, *carry)
    ahead = recent.join(kept, keys).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    ahead = ahead.withColumn(month, F.add_months(F.trunc("_last", "month"), F.col("step"))).drop("_last")
    turn = 2 * F.pi() * F.month(month) / 12
    return ahead.withColumns({"month_number": F.month(month), "month_sin": F.sin(turn), "month_cos": F.cos(turn)})
