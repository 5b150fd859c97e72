"""Entry point A: transactions, projects and rents to a labelled, gated monthly panel."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bedrooms, dates, measures, text
from ..operators import aggregates, clean, gates, impute, joins, labels, windows
from ..sources.writers import Run


@dataclass(frozen=True)
class PanelConfig:
    """Thresholds of a panel build."""

    price_low: float = 100.0
    price_high: float = 50_000.0
    rent_strategy: str = "tiered"
    min_rent_count: int = 1
    repair_rents: bool = False
    series: tuple[str, ...] = ("area_id", "property_type", "bedroom", "reg_type")
    exempt_labels: tuple[str, ...] = field(default_factory=tuple)


def segment_panel(tx: DataFrame, keys: list[str], series: list[str], rents: DataFrame, rent_keys: list[str], low: float = 100.0, high: float = 50_000.0) -> DataFrame:
    """The smallest useful panel: exact medians and counts per segment and month, rents joined, series numbered."""
    seg = tx.filter(clean.within(F.col("price"), low, high)).groupBy(*keys).agg(F.median("price").alias("median_price"), F.count("*").alias("transaction_count"))
    joined = joins.star(seg, [(rents, rent_keys)], zero=["rent_count"])
    return windows.series_index(joined, series, [k for k in keys if k not in series])


def sale_groups(groups: DataFrame) -> DataFrame:
    """Ids of transaction groups that are sales."""
    return groups.filter(F.lower("name_en").contains("sale")).select(text.canonical_id(F.col("group_id")).alias("trans_group_id"))


def enrich(raw: DataFrame, projects: DataFrame, developers: DataFrame, groups: DataFrame, config: PanelConfig = PanelConfig()) -> DataFrame:
    """Filtered sales with unit price, project dates, developer and phase features (VA6)."""
    ids = {c: text.canonical_id(F.col(c)) for c in ("transaction_id", "project_number", "area_id", "trans_group_id")}
    tx = raw.withColumns(ids).withColumns(
        {
            "instance_date": dates.parse_date(F.col("instance_date")),
            "bedroom": bedrooms.from_rooms(F.col("rooms_en")),
            "price": measures.per_sqft(measures.unit_price(*[measures.number(F.col(c)) for c in ("meter_sale_price", "actual_worth", "procedure_area")])),
        }
    )
    tx = clean.in_domain(tx, "reg_type_en", bedrooms.REG_TYPES, "reg_type")
    tx = tx.filter(
        (F.col("property_usage_en") == "Residential") & F.col("property_type_en").isin(*bedrooms.PROPERTY_TYPES) & F.col("bedroom").isNotNull()
        & F.col("instance_date").isNotNull() & clean.within(F.col("price"), config.price_low, config.price_high)
    ).join(sale_groups(groups), "trans_group_id", "left_semi")
    dim = projects.select("project_number", "developer_id", "project_start_date", "handover_date", F.col("master_project_en").alias("_master"))
    master = aggregates.dominant(dim, ["_master"], "developer_id", "value").select(F.col("_master").alias("key"), "value")
    own = dim.select(F.col("project_number").alias("key"), F.col("developer_id").alias("value"))
    tx = tx.join(dim.select("project_number", "project_start_date", "handover_date"), "project_number", "left")
    tx = joins.fallback(tx, [(own, "project_number", "project"), (master, "master_project_en", "master")], "developer_id", "developer_source")
    tx = tx.join(developers, "developer_id", "left")
    at, handover = F.col("instance_date"), F.col("handover_date")
    flip, flag = dates.lifecycle(F.col("reg_type"), at, handover)
    return tx.withColumns({"_reg": flip, "offplan_after_handover": flag}).drop("reg_type").withColumnRenamed("_reg", "reg_type").select(
        "*", F.trunc("instance_date", "month").alias("year_month"), F.col("property_type_en").alias("property_type"), *dates.phase_features(at, F.col("project_start_date"), handover)
    )


PHASES = ["months_to_handover_signed", "months_to_handover", "months_since_handover", "phase_ratio"]


def build(enriched: DataFrame, rents: DataFrame, projects: DataFrame, config: PanelConfig = PanelConfig()) -> DataFrame:
    """Labelled panel (VA7 to VA12), in one plan; ``run`` writes what is assembled before it imputes."""
    return imputed(assemble(enriched, rents, projects, config), config)


def imputed(panel: DataFrame, config: PanelConfig = PanelConfig()) -> DataFrame:
    return impute.impute_rents(panel, ["group_id"], "time_idx", "area_id", config.rent_strategy, config.min_rent_count)


def assemble(enriched: DataFrame, rents: DataFrame, projects: DataFrame, config: PanelConfig = PanelConfig()) -> DataFrame:
    """The panel before imputation: aggregate, context joins, time columns.

    ``enriched`` carries ``developer_brand_label`` and is read several times,
    so pass a written table; ``rents``: year_month, area_id, bedroom, rent,
    rent_sqft.
    """
    keys = ["year_month", *config.series, "developer_brand_label"]
    seg = aggregates.segment_month(enriched, keys, ["price", *PHASES], "transaction_id", ["near_handover", "offplan_after_handover"])
    active = projects.filter(F.col("project_status").isin("ACTIVE", "NOT_STARTED", "PENDING"))
    supply = joins.active_by_month(
        active.select("area_id", F.col("handover_date").alias("end_date"), *[F.col(c).cast("long").alias(f"supply_{c[6:]}") for c in ("no_of_units", "no_of_buildings", "no_of_villas")]),
        enriched.select(F.col("year_month").alias("month")), ["area_id"], ["supply_units", "supply_buildings", "supply_villas"],
    ).withColumnsRenamed({"month": "year_month", "projects": "active_projects"})
    due = joins.schedule(projects.filter("cancellation_date is null"), "", "handover_date", ["area_id"], F.col("no_of_units"), "units_completing").withColumnRenamed("month", "year_month")
    counts = ["rent_count", "supply_units", "supply_buildings", "supply_villas", "active_projects", "units_completing"]
    panel = joins.star(seg, [(aggregates.rents(rents), ["year_month", "area_id", "bedroom"]), (supply, ["year_month", "area_id"]), (due, ["year_month", "area_id"])], zero=counts)
    panel = panel.withColumn("group_id", text.group_id(*[F.col(c).cast("string") for c in config.series]))
    panel = panel.select("*", *dates.calendar_encodings(F.col("year_month")))
    return windows.series_index(panel, ["group_id"], ["year_month", "developer_brand_label"])


def run(
    spark: SparkSession, folder: str, raw: DataFrame, projects: DataFrame, developers: DataFrame, groups: DataFrame, brands: DataFrame, rents: DataFrame,
    config: PanelConfig = PanelConfig(),
) -> str:
    """The whole build: each stage is written once and read by the next; published if all gates hold."""
    out = Run(spark, folder)

    violations: dict[str, int] = {}

    def stage(name: str, df: DataFrame, checks: list[gates.Gate] = ()) -> DataFrame:
        """Write ``df``; its gates are taken from the rows as they are written."""
        seen, report = gates.observed(df, list(checks)) if checks else (df, None)
        out.write(name, seen)
        if report:
            violations.update({r["name"]: r["value"] for r in report(stop=False) if r["severity"] == gates.HARD and not r["passed"]})
        return spark.read.parquet(f"{out.path}/{name}")

    enriched = stage("enriched", enrich(raw, projects, developers, groups, config))
    labelled = stage("labelled", label(enriched, developers, brands), label_gates())
    assembled = stage("assembled", assemble(labelled, rents, projects, config))
    stage("panel", imputed(assembled, config), rent_gates(config))
    out.publish(violations | label_violations(labelled, config))
    return out.path


def label_gates() -> list[gates.Gate]:
    """What every labelled row must keep to (VA13): a label, and no legal suffix or holding in it."""
    label, source = F.col("developer_brand_label"), F.col("developer_brand_label_source")
    leak = text.leaks_suffix(label) | (text.has_holding(label) & (source != "PUBLIC_BRAND"))
    return [
        gates.none_of("empty_labels", gates.HARD, F.coalesce(F.trim(label), F.lit("")) == ""),
        gates.none_of("suffix_leaks", gates.HARD, F.coalesce(leak, F.lit(False))),
    ]


def rent_gates(config: PanelConfig) -> list[gates.Gate]:
    """A tiered panel must have all rents; a panel must have rows."""
    missing = F.col("median_rent").isNull() | F.col("median_rent_sqft").isNull()
    unfilled = [gates.none_of("unfilled_rents", gates.HARD, missing)] if config.rent_strategy == "tiered" else []
    return [*unfilled, gates.Gate("panel_rows", gates.INFO, F.count(F.lit(1)), lambda n: n > 0)]


def label_violations(labelled: DataFrame, config: PanelConfig = PanelConfig()) -> dict[str, int]:
    """Gates on labels as a whole (G5, G6), from one summary of labels: a pass over the table, then few rows."""
    exempt = list(config.exempt_labels)
    spread = aggregates.label_dispersion(labelled, "developer_brand_label", "developer_id", "area_id")
    name = F.col("developer_brand_label")
    thin = (F.col("tx") >= 1000) & (F.col("n_entities") >= 10) & (F.col("top_share") <= 0.30) & (~name.isin(*exempt) | text.is_place(name))
    row = spread.agg(F.count_if((F.col("tx") >= 1000) & text.is_place(name)).alias("surviving_places"), F.count_if(thin).alias("dispersed_labels")).first()
    return {c: row[c] for c in ("surviving_places", "dispersed_labels")}


def label(enriched: DataFrame, developers: DataFrame, brands: DataFrame) -> DataFrame:
    """Add the label cascade (E5); ``brands``: brand, aliases, registered_entities."""
    aliases = labels.alias_dictionary(brands)
    legal = labels.compile_developers(developers, brands, aliases)
    spark = enriched.sparkSession
    nothing = {k: spark.createDataFrame([], f"{k} string, brand string") for k in ("project_number", "master_project")}
    renamed = enriched.withColumnsRenamed({"project_name_en": "project_name", "building_name_en": "building_name", "master_project_en": "master_project"})
    resolved = labels.resolve_brands(renamed, aliases, legal, nothing["project_number"], nothing["master_project"])
    none = F.lit(None).cast("string")
    ready = resolved.withColumns(
        {"brand_public": F.col("brand"), "id_override": none, "owner_override": none, "name_en": F.col("developer_name_en"), "name_ar": F.col("developer_name_ar"), "umbrella": none, "umbrella_is_canonical": F.lit(False)}
    )
    return labels.label_cascade(ready)
