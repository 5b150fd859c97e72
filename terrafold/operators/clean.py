"""Filters, deduplication and the cleaning of single tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bedrooms, dates, measures


def ensure_columns(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Add what is missing of ``schema`` (name -> type) as typed NULLs."""
    have = {c.lower() for c in df.columns}
    return df.select("*", *[F.lit(None).cast(t).alias(n) for n, t in schema.items() if n.lower() not in have])


def strip_headers(df: DataFrame) -> DataFrame:
    """Trim column names."""
    return df.toDF(*[c.strip() for c in df.columns])


def rename_synonyms(df: DataFrame, synonyms: dict[str, str]) -> DataFrame:
    """Rename by a table of spellings: exact, trimmed, then without case.

    If several columns mean the same, the first is kept.
    """
    loose = {k.strip().lower(): v for k, v in synonyms.items()}
    out, seen = [], set()
    for c in df.columns:
        name = synonyms.get(c) or synonyms.get(c.strip()) or loose.get(c.strip().lower()) or c
        if name not in seen:
            seen.add(name)
            out.append(F.col(f"`{c}`").alias(name))
    return df.select(*out)


def keep_ordered(df: DataFrame, order: list[str]) -> DataFrame:
    """The listed columns that exist, in this order."""
    return df.select(*[c for c in order if c in df.columns])


def within(c: Column, low: float, high: float, closed: bool = True) -> Column:
    """Range filter, closed (P4) or open (P5)."""
    return c.between(low, high) if closed else (c > low) & (c < high)


def within_or_null(c: Column, low: float, high: float) -> Column:
    """Keep values in the range, and NULL."""
    return c.between(low, high) | c.isNull()


def in_domain(df: DataFrame, column: str, mapping: dict[str, str], out: str | None = None) -> DataFrame:
    """Map to a vocabulary and drop what it does not have."""
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return df.withColumn(out or column, F.try_element_at(table, F.col(column))).filter(F.col(out or column).isNotNull())


def replace_values(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """Exact replacement by a table (alias, canonical); others stay."""
    table = mapping.select(F.col("alias").alias("_alias"), F.col("canonical").alias("_canonical"))
    joined = df.join(table, F.col(column) == F.col("_alias"), "left")
    return joined.withColumn(column, F.coalesce("_canonical", column)).drop("_alias", "_canonical")


def first_row(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in ``order`` (O1, O2, O3).

    ``order`` should be total, so that reruns agree; a file's own order must
    come as a column of it.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def dedup_projects(projects: DataFrame) -> DataFrame:
    """One row per project number (O1): not cancelled, latest handover, most complete."""
    cancelled = F.col("cancellation_date").isNotNull()
    return first_row(
        projects.filter(F.col("project_number").isNotNull()),
        ["project_number"],
        [cancelled.asc(), F.col("handover_date").desc_nulls_last(), F.col("percent_completed").desc_nulls_last(), F.col("project_id").asc_nulls_last()],
    )


def clean_transactions(raw: DataFrame, areas: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(clean, quarantine) transactions.

    Dates are parsed (none: quarantine), ids deduplicated over the whole table,
    residential rows with worth and a positive area kept.
    """
    dated = raw.withColumn("instance_date", dates.parse_flexible(F.col("instance_date")))
    good = dated.filter(F.col("instance_date").isNotNull())
    usage = F.col("property_usage_en") == "Residential" if "property_usage_en" in raw.columns else F.col("property_type_en").isin(*bedrooms.PROPERTY_TYPES)
    kept = first_row(good.filter("transaction_id is not null"), ["transaction_id"], [F.xxhash64(*good.columns)])
    kept = kept.filter(usage & F.col("actual_worth").isNotNull() & (F.col("procedure_area") > 0))
    if areas is not None:
        kept = replace_values(kept, "area_name_en", areas)
    date = F.col("instance_date")
    return kept.select("*", F.year(date).alias("transaction_year"), F.month(date).alias("transaction_month")), dated.filter(
        F.col("instance_date").isNull()
    )


def clean_rents(raw: DataFrame, low_year: int = 1990, high_year: int = 2025) -> dict[str, DataFrame]:
    """Residential and commercial contracts, and counts of unknown sub-types."""
    kind = F.col("ejari_property_sub_type_en")
    start = dates.parse_date(F.col("contract_start_date"))
    df = raw.select(
        "*",
        start.alias("contract_start_date_parsed"),
        dates.parse_date(F.col("contract_end_date")).alias("contract_end_date_parsed"),
        F.year(start).alias("contract_year"),
        bedrooms.from_contract(kind).alias("bedrooms"),
    ).filter(within_or_null(F.col("contract_year"), low_year, high_year))
    df = df.withColumn("bedrooms_numeric", bedrooms.to_number(F.col("bedrooms")))
    return {
        "residential": df.filter("bedrooms is not null"),
        "commercial": df.filter("bedrooms is null"),
        "unmapped": df.filter("bedrooms is null").groupBy("ejari_property_sub_type_en").count(),
    }


def clean_dated(raw: DataFrame, date_columns: list[str]) -> DataFrame:
    """Parse date columns and add parts of the first; no row is dropped (P20)."""
    df = raw
    for c in date_columns:
        df = df.withColumn(f"{c}_parsed", dates.parse_flexible(F.col(c)))
    return df.select("*", *dates.parts(F.col(f"{date_columns[0]}_parsed")))


def parse_counters(df: DataFrame, date_columns: list[str]) -> DataFrame:
    """Per date column: rows parsed and failed, in one pass."""
    pairs = [
        F.struct(
            F.lit(c).alias("column"),
            F.count(f"{c}_parsed").alias("parsed"),
            F.count_if(F.col(c).isNotNull() & F.col(f"{c}_parsed").isNull()).alias("failed"),
        )
        for c in date_columns
    ]
    return df.agg(F.array(*pairs).alias("c")).select(F.inline("c"))


def projects(raw: DataFrame) -> DataFrame:
    """Projects with dates, handover (completion, else planned end) and status."""
    day = lambda c: dates.parse_date(F.col(c))
    df = raw.withColumns({c: day(c) for c in ("project_start_date", "project_end_date", "completion_date", "cancellation_date")})
    df = df.withColumns(
        {
            "handover_date": F.coalesce("completion_date", "project_end_date"),
            "project_status": F.upper(F.trim("project_status")),
            "percent_completed": measures.number(F.col("percent_completed")),
        }
    )
    return dedup_projects(df).withColumn("project_duration_months", dates.months_apart(F.col("handover_date"), F.col("project_start_date")))
