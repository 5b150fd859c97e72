"""Quality gates: what counts as a violation, and a runner that stops on hard ones."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import text
from .aggregates import label_dispersion
from .registers import top_by

HARD, SOFT, INFO = "HARD", "SOFT", "INFO"


class GateError(RuntimeError):
    """A hard gate failed."""


@dataclass(frozen=True)
class Gate:
    """``value`` is one aggregate of the table; the gate passes if ``passes`` holds for it."""

    name: str
    severity: str
    value: Column
    passes: Callable[[object], bool]


def _report(gates: list[Gate], values: list, stop: bool) -> list[dict]:
    report = [{"name": g.name, "severity": g.severity, "value": v, "passed": bool(g.passes(v))} for g, v in zip(gates, values, strict=True)]
    failed = [r["name"] for r in report if r["severity"] == HARD and not r["passed"]]
    if failed and stop:
        raise GateError("; ".join(failed))
    return report


def run_gates(df: DataFrame, gates: list[Gate], stop: bool = True) -> list[dict]:
    """Evaluate all gates in one pass; raise if a hard one fails."""
    row = df.agg(*[g.value.alias(f"g{k}") for k, g in enumerate(gates)]).first()
    return _report(gates, [row[k] for k in range(len(gates))], stop)


def observed(df: DataFrame, gates: list[Gate]) -> tuple[DataFrame, Callable[..., list[dict]]]:
    """``df``, and what gives the report of its gates once it has been written.

    The gates' values are taken from the rows as they pass on their way to the
    sink, so a stage is not read again for them. The report waits for the write.
    """
    watch = Observation(f"gates-{uuid.uuid4().hex}")
    seen = df.observe(watch, *[g.value.alias(f"g{k}") for k, g in enumerate(gates)])
    return seen, lambda stop=True: _report(gates, [watch.get[f"g{k}"] for k in range(len(gates))], stop)


def stage_gates(columns: list[str], dates: list[str] = (), positive: list[str] = ()) -> list[Gate]:
    """Checks of a cleaned stage (G12, G17): it has rows; how many dates were not read; values that must be positive."""
    have = [c for c in [*dates, *positive] if c in columns]
    missing = sorted({*dates, *positive} - {*have})
    gates = [Gate("has rows", HARD, F.count(F.lit(1)), lambda n: n > 0)]
    gates += [Gate(f"column {c} is there", HARD, F.max(F.lit(0)), lambda _: False) for c in missing]
    gates += [Gate(f"{c} is read in at least 95 %", SOFT, share(F.col(c).isNotNull()), lambda x: (x or 0) >= 0.95) for c in dates if c in have]
    return gates + [none_of(f"{c} is positive", HARD, F.col(c) <= 0) for c in positive if c in have]


def share(condition: Column) -> Column:
    return F.avg(F.coalesce(condition, F.lit(False)).cast("int"))


def none_of(name: str, severity: str, condition: Column) -> Gate:
    return Gate(name, severity, F.count_if(condition), lambda n: n == 0)


def panel_gates(columns: list[str]) -> list[Gate]:
    """Checks before training."""
    dev, price = F.col("developer_name"), F.col("median_price")
    gates = [
        none_of("No Unknown developers", HARD, F.lower(dev) == "unknown"),
        none_of("No UNMAPPED_DEVELOPER__ rows", HARD, dev.startswith("UNMAPPED_DEVELOPER__")),
        Gate("ALL_DEVELOPERS bucket small (<5%)", SOFT, share(dev == "ALL_DEVELOPERS"), lambda x: (x or 0) < 0.05),
        Gate("Lifecycle reg_type has both OffPlan and Ready", HARD, F.array_sort(F.collect_set("reg_type")), lambda x: {"OffPlan", "Ready"} <= set(x)),
        none_of("median_price within [100, 50k]", HARD, (price < 100) | (price > 50_000)),
    ]
    if "median_rent" in columns:
        gates += [none_of("median_rent non-negative", HARD, F.col("median_rent") < 0), none_of("median_rent not absurd (>2M)", SOFT, F.col("median_rent") > 2e6)]
    if "units_completing" in columns:
        gates.append(Gate("units_completing has signal", SOFT, F.count_if(F.col("units_completing") > 0), lambda n: n > 0))
    if "offplan_after_handover" in columns:
        gates.append(Gate("OffPlan after handover is tracked", INFO, F.count_if(F.col("offplan_after_handover") > 0), lambda n: n >= 0))
    return gates


def required_columns(df: DataFrame, names: list[str]) -> list[str]:
    """Names that the table lacks."""
    return [n for n in names if n not in df.columns]


def empty_labels(df: DataFrame, label: str) -> DataFrame:
    """Rows without a label (G1)."""
    return df.filter(F.coalesce(F.trim(label), F.lit("")) == "")


def override_status(labels: DataFrame, overrides: DataFrame) -> DataFrame:
    """Per overridden id: OK, CONFLICT or ABSENT.

    ``overrides``: developer_id, expected.
    """
    seen = labels.groupBy("developer_id").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    status = F.when(F.col("labels").isNull(), "ABSENT").when(F.col("labels") == F.array("expected"), "OK").otherwise("CONFLICT")
    return overrides.join(seen, "developer_id", "left").withColumn("status", status)


def suffix_leaks(df: DataFrame, label: str, source: str) -> DataFrame:
    """Labels with a legal suffix, or HOLDING from another source than public brands."""
    kind = F.when(text.leaks_suffix(F.col(label)), "SUFFIX").when(text.has_holding(F.col(label)) & (F.col(source) != "PUBLIC_BRAND"), "HOLDING")
    return df.withColumn("leak", kind).filter("leak is not null").groupBy(label, source, "leak").agg(F.count("*").alias("rows"))


def surviving_places(df: DataFrame, label: str, min_tx: int = 1000) -> DataFrame:
    """Labels that look like places and have many rows."""
    return df.groupBy(label).agg(F.count("*").alias("tx")).filter((F.col("tx") >= min_tx) & text.is_place(F.col(label)))


def dispersed_labels(df: DataFrame, label: str, entity: str, area: str, exempt: list[str] = (), min_tx: int = 1000, min_entities: int = 10, max_share: float = 0.30) -> DataFrame:
    """Labels spread thinly over many entities (G6); exempt ones only if they look like places."""
    spread = label_dispersion(df, label, entity, area)
    thin = (F.col("tx") >= min_tx) & (F.col("n_entities") >= min_entities) & (F.col("top_share") <= max_share)
    return spread.filter(thin & (~F.col(label).isin(*exempt) | text.is_place(F.col(label))))


def unmapped_owners(metrics: DataFrame, mapped: DataFrame, rejected: DataFrame, top_n: int = 50, value: float = 1e9, first: int = 10) -> DataFrame:
    """Unmapped ids among the top by value that must stop a run.

    ``metrics``: developer_id, value, high_confidence (a suggestion not applied).
    """
    top = metrics.orderBy(F.col("value").desc(), "developer_id").limit(top_n)
    numbered = top.orderBy(F.col("value").desc(), "developer_id").limit(first).select(F.col("developer_id").alias("_f"))
    open_ids = top.join(mapped.select("developer_id"), "developer_id", "left_anti")
    no = rejected.select(F.col("developer_id").alias("_r"))
    joined = open_ids.join(numbered, F.col("developer_id") == F.col("_f"), "left").join(no, F.col("developer_id") == F.col("_r"), "left")
    bad = (F.col("value") >= value) | F.col("_f").isNotNull() | (F.coalesce("high_confidence", F.lit(False)) & F.col("_r").isNull())
    return joined.filter(bad).drop("_f", "_r")


def outliers(metrics: DataFrame, value: float = 1e9, tx: int = 500, units: int = 5000, concentration: float = 0.70) -> DataFrame:
    """Entities that look like vehicles and matter (G8): tokens or one dominant project, and size."""
    looks = text.is_place(F.col("label")) | (F.col("top_share") >= concentration)
    matters = (F.col("value") >= value) | (F.col("tx_recent") >= tx) | (F.col("units") >= units)
    return metrics.filter(looks & matters)


def delta(current: DataFrame, baseline: DataFrame, key: str, rank_by: str, top: int = 25) -> DataFrame:
    """All ids new since the baseline, with ``rank`` for the ``top`` of them by ``rank_by`` (G9); NULL beyond.

    Of two stored snapshots, ``snapshots.changes`` reads only what differs.
    """
    new = current.filter(F.col(key).isNotNull()).join(baseline.select(key), key, "left_anti")
    best = top_by(new.select(key, rank_by), rank_by, top, key).select(key, "rank")
    return new.join(F.broadcast(best), key, "left")  # ``top`` rows


def match_rate(df: DataFrame, column: str, warn: float = 0.95, fail: float = 0.0) -> Column:
    """OK, WARN or FAIL by the share of rows with a value."""
    rate = F.avg(F.col(column).isNotNull().cast("int"))
    return F.when(rate < fail, "FAIL").when(rate < warn, "WARN").otherwise("OK")


def anomalies(forecasts: DataFrame) -> DataFrame:
    """Forecast flags (G16): drop, jump, implausible price, rent collapse."""
    growth = (F.col("forecast") / F.col("current") - 1) * 100
    flags = F.filter(
        F.array(
            F.when(growth < -20, "large_drop"),
            F.when(growth > 50, "large_jump"),
            F.when(F.col("forecast") < 100, "price_below_100"),
            F.when(F.col("rent_forecast") < 0.5 * F.col("rent_current"), "rent_collapse"),
        ),
        lambda f: f.isNotNull(),
    )
    return forecasts.withColumn("flags", flags).filter(F.size("flags") > 0)


def guard_misses(df: DataFrame, label: str, entity: str, area: str, names: DataFrame) -> DataFrame:
    """Labels equal to an area's name that the place guard does not see."""
    areas = names.select(text.norm_label(F.col("name")).alias("_n")).distinct()
    seen = label_dispersion(df, label, entity, area).filter(~text.is_place(F.col(label)))
    return seen.join(areas, text.norm_label(F.col(label)) == F.col("_n"), "left_semi")
