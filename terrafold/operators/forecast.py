"""Forecasts, horizons, gating and investor figures as expressions over request rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.measures import change_percent, extrapolate, extrapolate_or_null

PRICE_GROWTH, RENT_GROWTH, RENT_SHARE = 0.12, 0.05, 0.06
AREA_LEAST, DEVELOPER_LEAST, MODEL_LEAST = 80.0, 70.0, 70.0
TRUSTED_MATCHES = ("exact", "exact_all_developers", "partial_area_bedroom")
#: Fixed: sizes in sqft where a request has none.
DEFAULT_SIZES = {"Studio": 450.0, "1BR": 750.0, "2BR": 1200.0, "3BR": 1800.0, "4BR": 2500.0, "5BR": 3500.0}
Predictor = Callable[[pd.DataFrame], pd.DataFrame]


def fallback_forecast(df: DataFrame) -> DataFrame:
    """Deterministic forecast (M3) from current_sqft, current_rent, price, horizon."""
    price = F.pow(F.lit(1 + PRICE_GROWTH / 12), F.col("horizon"))
    rent = F.pow(F.lit(1 + RENT_GROWTH / 12), F.col("horizon"))
    has_price, has_rent, has_ask = F.col("current_sqft") > 0, F.col("current_rent") > 0, F.col("price") > 0
    median = F.when(has_price, F.col("current_sqft") * price).otherwise(1500.0)
    r_median = F.when(has_rent, F.col("current_rent") * rent).when(has_ask, F.col("price") * RENT_SHARE).otherwise(80000.0)
    out = df.withColumns({"sqft_median": median, "rent_median": r_median})
    return out.withColumns(
        {
            "sqft_low": F.when(has_price, F.col("sqft_median") * 0.9).otherwise(1350.0),
            "sqft_high": F.when(has_price, F.col("sqft_median") * 1.15).otherwise(1725.0),
            "rent_low": F.when(has_rent, F.col("rent_median") * 0.92).otherwise(F.col("rent_median") * 0.9),
            "rent_high": F.when(has_rent, F.col("rent_median") * 1.08).otherwise(F.col("rent_median") * 1.1),
            "anchor_sqft": F.coalesce("current_sqft", F.lit(1350.0)),
            "forecast_source": F.when(has_price, "fallback_growth").otherwise("fallback_constant"),
        }
    )


def horizons(df: DataFrame, targets: tuple[int, ...] = (12, 24)) -> DataFrame:
    """Values at further horizons, appreciation, yield, totals (M4)."""
    out = df
    for t in targets:
        for q in ("low", "median", "high"):
            out = out.withColumn(f"sqft_{q}_{t}m", extrapolate(F.col("anchor_sqft"), F.col(f"sqft_{q}"), F.col("horizon"), F.lit(t)))
        out = out.withColumn(f"appreciation_{t}m", change_percent(F.col(f"sqft_median_{t}m"), F.col("anchor_sqft")))
    totals = {f"total_{q}": F.when(F.col("unit_sqft") > 0, F.round(F.col(f"sqft_{q}") * F.col("unit_sqft"))) for q in ("low", "median", "high")}
    return out.withColumns(
        {
            "appreciation": change_percent(F.col("sqft_median"), F.col("anchor_sqft")),
            "estimated_yield": F.when(F.col("price") > 0, F.col("rent_median") / F.col("price") * 100),
            **totals,
        }
    )


def confidence_gate(df: DataFrame, values: dict[str, str]) -> DataFrame:
    """NULL what is not trusted (M8); ``values``: column -> area, developer or model.

    Fails closed: without a confidence nothing is shown.
    """
    ok = {
        "area": F.col("area_confidence") >= AREA_LEAST,
        "developer": F.col("developer_confidence") >= DEVELOPER_LEAST,
        "model": (F.col("model_confidence") >= MODEL_LEAST) & F.col("match_type").isin(*TRUSTED_MATCHES),
    }
    return df.withColumns({c: F.when(F.coalesce(ok[k], F.lit(False)), F.col(c)) for c, k in values.items()}).withColumns(
        {f"{k}_trusted": F.coalesce(v, F.lit(False)) for k, v in ok.items()}
    )


def investor_fields(df: DataFrame) -> DataFrame:
    """Handover and later totals, uplift, yields.

    Anchor: the series' price, else the area's median, else what is paid.
    """
    paid = F.when(F.col("unit_sqft") > 0, F.col("price") / F.col("unit_sqft"))
    anchor = F.coalesce("current_sqft", "area_median_sqft", paid)
    source = F.when(F.col("current_sqft").isNotNull(), "series").when(F.col("area_median_sqft").isNotNull(), "area").when(paid.isNotNull(), "purchase").otherwise("none")
    target = F.coalesce("handover_months", "horizon", F.lit(12))
    out = df.withColumns({"anchor_sqft": anchor, "anchor_source": source, "target_months": target})
    for name, at in (("handover", F.col("target_months")), ("plus12m", F.col("target_months") + 12)):
        for q in ("low", "median", "high"):
            value = extrapolate(F.col("anchor_sqft"), F.col(f"sqft_{q}"), F.col("horizon"), at)
            out = out.withColumn(f"{name}_total_{q}", F.when(F.col("unit_sqft") > 0, F.bround(value * F.col("unit_sqft"))))
        gain = F.col(f"{name}_total_median") - F.col("price")
        out = out.withColumns({f"uplift_{name}": F.bround(gain), f"uplift_{name}_percent": F.when(F.col("price") > 0, F.bround(gain / F.col("price") * 100, 1))})
    return out.withColumns({f"yield_{q}": F.when(F.col("price") > 0, F.bround(F.col(f"rent_{q}") / F.col("price") * 100, 1)) for q in ("low", "high")})


def snapshot_value(df: DataFrame, months: int, out: str) -> DataFrame:
    """Value at handover, the plain forecast where no rate can be had; later ones stay NULL."""
    value = extrapolate_or_null(F.col("anchor_sqft"), F.col("sqft_median"), F.col("horizon"), F.coalesce("handover_months", F.lit(months)))
    return df.withColumn(out, F.coalesce(value, "sqft_median"))


def market_position(df: DataFrame) -> DataFrame:
    """Premium over the market, and years of supply (M11); sizes default by bedroom."""
    sizes = F.create_map(*[F.lit(x) for kv in DEFAULT_SIZES.items() for x in kv])
    size = F.coalesce("unit_sqft", F.try_element_at(sizes, F.col("bedroom")))
    asked = F.when(size > 0, F.col("price") / size)
    return df.withColumns(
        {
            "asked_sqft": asked,
            "premium_percent": change_percent(asked, F.col("market_sqft")),
            "years_of_supply": F.when(F.col("transactions_12m") > 0, F.col("supply_pipeline") / F.col("transactions_12m")),
        }
    )


def predict(rows: DataFrame, keys: list[str], predictor: Predictor, schema: str) -> DataFrame:
    """Apply a model per series (M2, M16): it gets a series' rows, encoder and future."""
    return rows.groupBy(*keys).applyInPandas(lambda pdf: predictor(pdf), schema)


def last_value(history: np.ndarray, horizon: int) -> np.ndarray:
    """(low, middle, high) per step: the last value between the least and the largest of 24."""
    recent = history[-24:]
    return np.tile([recent.min(), history[-1], recent.max()], (horizon, 1))


def smoother(history: np.ndarray, horizon: int, level_rate: float = 0.5, trend_rate: float = 0.1, damping: float = 0.9, low: float = 0.1, high: float = 0.9) -> np.ndarray:
    """(low, middle, high) per step by exponential smoothing with a damped trend.

    The band is the middle plus quantiles of the errors one step ahead, which
    widen with the root of the steps; the middle is always within it.
    """
    level, trend, misses = float(history[0]), 0.0, []
    for value in history[1:]:
        expected = level + damping * trend
        misses.append(value - expected)
        new = level_rate * value + (1 - level_rate) * expected
        trend = trend_rate * (new - level) + (1 - trend_rate) * damping * trend
        level = new
    steps = np.arange(1, horizon + 1)
    middle = level + trend * np.cumsum(damping**steps)
    band = np.quantile(misses, [low, high]) if misses else np.zeros(2)
    band = np.minimum(band[0], 0.0), np.maximum(band[1], 0.0)
    return np.column_stack([middle + band[0] * np.sqrt(steps), middle, middle + band[1] * np.sqrt(steps)])


LEAST_HISTORY, HORIZON = 24, 12


def _forecasts(history: DataFrame, future: DataFrame, keys: list[str], month: str, value: str, predictor, least: int, horizon: int) -> DataFrame:
    """Cogroup histories with the rows to be forecast, by series; ``future`` may carry ``value`` as what came true."""
    kinds = dict(history.dtypes)
    schema = pa.schema(
        [(f.name, f.type) for f in history.select(*keys, month).limit(0).toArrow().schema]
        + [("step", pa.int32())] + [(c, pa.float64()) for c in ("low", "median", "high", "actual")] + [("status", pa.string())]
    )

    def run(key: tuple, past: pa.Table, ahead: pa.Table) -> pa.Table:
        order = pc.sort_indices(past[month]) if past.num_rows else None
        known = past[value].take(order).to_numpy(zero_copy_only=False).astype(float) if past.num_rows else np.zeros(0)
        known = known[~np.isnan(known)]
        ahead = ahead.take(pc.sort_indices(ahead[month]))[:horizon]
        n = ahead.num_rows
        status = "insufficient history" if len(known) < least else "insufficient future" if n < horizon else "ok"
        found = np.asarray(predictor(known, horizon), dtype=float) if status == "ok" else np.full((n, 3), np.nan)
        values = [pa.array(found[:n, k], from_pandas=True) for k in range(3)]
        columns = [pa.array([k.as_py()] * n, t) for k, t in zip(key, schema.types)] + [ahead[month], pa.array(range(1, n + 1), pa.int32()), *values, ahead[value].cast(pa.float64()), pa.array([status] * n)]
        return pa.Table.from_arrays(columns, schema=schema)

    columns = ", ".join(f"`{k}` {kinds[k]}" for k in [*keys, month])
    shape = f"{columns}, step int, low double, median double, high double, actual double, status string"
    future = future.select([F.col(c).alias(c) for c in (*keys, month, value)])  # both may come from one table
    return history.select(*keys, month, value).groupBy(*keys).cogroup(future.groupBy(*keys)).applyInArrow(run, shape)


def batch_forecast(df: DataFrame, keys: list[str], month: str, value: str, predictor=smoother, least: int = LEAST_HISTORY, horizon: int = HORIZON) -> DataFrame:
    """The next ``horizon`` months of every series (M2, M16): keys, month, step, low, median, high, actual (NULL), status.

    A series needs ``least`` values; others have their rows with the reason and
    no forecast. ``predictor``: (values in order, steps) -> rows of low, middle,
    high; a trained model fits in here.
    """
    from .windows import future_rows

    ahead = future_rows(df, keys, month, horizon).withColumn(value, F.lit(None).cast("double"))
    return _forecasts(df, ahead.withColumn(month, F.col(month).cast(df.schema[month].dataType)), keys, month, value, predictor, least, horizon)


def walk_forward(df: DataFrame, keys: list[str], month: str, value: str, ends: list[str], predictor=smoother, least: int = LEAST_HISTORY, horizon: int = HORIZON) -> DataFrame:
    """Forecasts of expanding folds against what came true (W24, M14): as ``batch_forecast``, with ``fold``.

    Fold k forecasts from the months up to the k-th of ``ends`` those within
    ``horizon`` months after it. Series by fold are cogrouped, so a task holds
    one series at a time.
    """
    from .windows import folds

    history = folds(df.select(*keys, month, value), month, ends).drop("fold_end")
    table = F.array(*[F.struct(F.lit(k).alias("fold"), F.lit(e).cast("date").alias("fold_end")) for k, e in enumerate(ends)])
    ahead = df.select(*keys, month, value, F.inline(table)).filter((F.col(month) > F.col("fold_end")) & (F.col(month) <= F.add_months("fold_end", horizon))).drop("fold_end")
    return _forecasts(history, ahead, [*keys, "fold"], month, value, predictor, least, horizon)


def fold_errors(forecasts: DataFrame) -> DataFrame:
    """Per fold: series forecast, rows, mean absolute error, share of what came true within the band."""
    ok = forecasts.filter("status = 'ok' and actual is not null")
    inside = F.col("actual").between(F.col("low"), F.col("high"))
    return ok.groupBy("fold").agg(F.count("*").alias("rows"), F.avg(F.abs(F.col("actual") - F.col("median"))).alias("mae"), F.avg(inside.cast("int")).alias("coverage"))


def scenarios(rows: DataFrame, changes: dict[str, tuple[str, str, float]], recent: Column) -> DataFrame:
    """What-if rows (M7): ``changes``: name -> (column, ``*`` or ``+``, amount) on rows where ``recent`` holds."""
    made = rows.withColumn("scenario", F.lit("base"))
    for name, (column, how, amount) in changes.items():
        moved = F.col(column) * amount if how == "*" else F.col(column) + amount
        made = made.unionByName(rows.withColumn(column, F.when(recent, moved).otherwise(F.col(column))).withColumn("scenario", F.lit(name)))
    return made


def attribution(importance: DataFrame, blocked: list[str], top: int = 8) -> DataFrame:
    """Drivers of a model (M6): best of each feature, share of the sum, top ones per series."""
    from pyspark.sql import Window

    best = importance.filter(~F.col("feature").isin(*blocked)).groupBy("group_id", "feature").agg(F.max("importance").alias("importance"))
    w = Window.partitionBy("group_id")
    ranked = best.withColumn("share", F.try_divide(F.col("importance"), F.sum("importance").over(w)))
    return ranked.withColumn("rank", F.row_number().over(w.orderBy(F.col("importance").desc(), "feature"))).filter(F.col("rank") <= top)


def errors(df: DataFrame, actual: str, predicted: str, low: str, high: str) -> DataFrame:
    """Mean absolute error of the median and coverage of the band."""
    inside = F.col(actual).between(F.col(low), F.col(high))
    return df.agg(F.avg(F.abs(F.col(actual) - F.col(predicted))).alias("mae"), F.avg(inside.cast("int")).alias("coverage"))


def internal_rate(flows: DataFrame, keys: list[str], step: str, amount: str, per_year: int = 12) -> DataFrame:
    """Yearly internal rate of return per key by bisection (M13); NULL without a sign change."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        at, cash = pdf[step].to_numpy(float), pdf[amount].to_numpy(float)
        value = lambda r: float((cash / (1 + r) ** at).sum())
        low, high = -0.99 / per_year, 1.0
        rate = None
        if value(low) * value(high) < 0:
            for _ in range(200):
                mid = (low + high) / 2
                low, high = (low, mid) if value(low) * value(mid) <= 0 else (mid, high)
            rate = (1 + (low + high) / 2) ** per_year - 1
        return pd.DataFrame([[*pdf[keys].iloc[0].tolist(), rate]], columns=[*keys, "irr"])

    kinds = dict(flows.dtypes)
    return flows.groupBy(*keys).applyInPandas(solve, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", irr double")


def deal_costs(df: DataFrame, register: float = 0.04, agency: float = 0.02, fixed: float = 5000.0) -> DataFrame:
    """Total cost, net yearly cash and cash-on-cash return of a deal."""
    total = F.col("price") * (1 + register + agency) + fixed
    cash = F.col("rent_median") - F.coalesce("yearly_costs", F.lit(0.0))
    return df.withColumns({"total_cost": total, "net_cash": cash, "cash_on_cash": F.when(total > 0, cash / total * 100)})
