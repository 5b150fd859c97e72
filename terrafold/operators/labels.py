"""Labels and entities: cascades in which the order is the meaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .aggregates import null_safe_join
from .joins import alias_hits, contains_aliases, fuzzy_best, similar_pairs


def _filled(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def label_cascade(df: DataFrame, area_names: Column | None = None, blocked: Column | None = None) -> DataFrame:
    """One label per row and where it is from (E5).

    Columns: developer_id, brand_public, id_override, owner_override, name_en,
    name_ar, umbrella, umbrella_is_canonical. First that applies: public brand;
    override by id; owner override; authority -> id; place -> umbrella owner if
    canonical, no authority and no holding, else id; legal name EN, AR; id;
    missing id.
    """
    # Each step is a column of its own, so that no expression is repeated within another.
    kept = df.columns
    df = df.withColumns({"_en": _filled(text.legal_label(F.col("name_en"))), "_ar": _filled(text.legal_label(F.col("name_ar"), arabic=True)), "_umb": _filled(F.col("umbrella"))})
    df = df.withColumn("_candidate", F.coalesce("_en", "_ar"))
    df = df.withColumns(
        {
            "_authority": text.is_authority(F.col("name_en")) | text.is_authority(F.col("name_ar")) | text.is_authority(F.col("_candidate")),
            "_place": text.is_place(F.col("_candidate"), area_names, blocked),
            "_safe": F.col("_umb").isNotNull() & F.coalesce("umbrella_is_canonical", F.lit(False)) & ~text.is_authority(F.col("_umb")) & ~text.has_holding(F.col("_umb")),
        }
    )
    en, ar, umbrella, by_id = F.col("_en"), F.col("_ar"), F.col("_umb"), F.concat(F.lit("DEVELOPER_ID_"), _filled(F.col("developer_id")))
    authority, place, safe = F.col("_authority"), F.col("_place"), F.col("_safe")
    steps = [
        (_filled(F.col("brand_public")), F.lit(True), "PUBLIC_BRAND"),
        (_filled(F.col("id_override")), F.lit(True), "ID_BRAND_OVERRIDE"),
        (_filled(F.col("owner_override")), F.lit(True), "OWNER_OVERRIDE_DEVELOPER_ID"),
        (by_id, authority, "ID_FALLBACK_AUTHORITY"),
        (umbrella, place & safe, "UMBRELLA_OWNER_FALLBACK_SUSPICIOUS"),
        (by_id, place & ~safe, "ID_FALLBACK_SUSPICIOUS"),
        (en, ~place, "LEGAL_NORMALIZED_EN"),
        (ar, ~place & en.isNull(), "LEGAL_NORMALIZED_AR"),
        (by_id, F.lit(True), "ID_FALLBACK"),
    ]
    pair = lambda v, s: F.struct(v.alias("label"), F.lit(s).alias("source"))
    chosen = F.coalesce(*[F.when(v.isNotNull() & on, pair(v, s)) for v, on, s in steps], pair(F.lit("DEVELOPER_ID_MISSING"), "MISSING_ID_FALLBACK"))
    return df.withColumn("_l", chosen).select(*kept, F.col("_l.label").alias("developer_brand_label"), F.col("_l.source").alias("developer_brand_label_source"))


def resolve_brands(facts: DataFrame, aliases: DataFrame, legal: DataFrame, project_overrides: DataFrame, master_overrides: DataFrame) -> DataFrame:
    """Brand per row and its source (E1): TEXT, LEGAL_MAP, PROJECT_OVERRIDE, MASTER_FALLBACK.

    ``facts``: project_number, developer_id, project_name, building_name,
    master_project. Text evidence is sought in the project, then the building,
    then the master name, on distinct names; the best score wins, earlier
    fields on ties.
    """
    fields = ("project_name", "building_name", "master_project")
    # Text is met once per distinct set of names; facts only look their set up.
    sets = facts.select(*fields).distinct().persist()
    names = sets.select(F.explode(F.array(*[text.norm_text(F.col(f)) for f in fields])).alias("_n")).distinct()
    hits = alias_hits(names, "_n", aliases)
    found = sets
    for f in fields:
        own = hits.select(F.col("_n").alias(f"_k_{f}"), F.struct(F.col("score"), F.col("brand"), F.col("alias"), F.lit(f).alias("field"), F.col("conflict")).alias(f"_h_{f}"))
        found = found.join(own, text.norm_text(F.col(f)) == F.col(f"_k_{f}"), "left").drop(f"_k_{f}")
    best = F.lit(None).cast(dict(found.dtypes)["_h_project_name"])
    for f in reversed(fields):
        h = F.col(f"_h_{f}")
        best = F.when(h.isNotNull() & (best.isNull() | (h["score"] >= best["score"])), h).otherwise(best)
    found = found.withColumn("_t", best).filter("_t is not null").select(*fields, "_t").persist()
    found.count()  # once it is there, Spark knows its size and broadcasts it if it is small
    sets.unpersist()
    out = null_safe_join(facts, found, list(fields))
    for table, key, name in ((legal, "developer_id", "_legal"), (project_overrides, "project_number", "_project"), (master_overrides, "master_project", "_master")):
        dim = table.select(F.col(key).alias(f"_k{name}"), F.col("brand").alias(name))
        out = out.join(dim, F.col(key) == F.col(f"_k{name}"), "left").drop(f"_k{name}")
    brand = F.coalesce("_t.brand", "_legal", "_project", "_master")
    source = (
        F.when(F.col("_t").isNotNull(), "TEXT").when(F.col("_legal").isNotNull(), "LEGAL_MAP").when(F.col("_project").isNotNull(), "PROJECT_OVERRIDE")
        .when(F.col("_master").isNotNull(), "MASTER_FALLBACK").otherwise("UNRESOLVED")
    )
    evidence = F.to_json(F.struct(F.col("_t.field").alias("field"), F.col("_t.alias").alias("alias"), F.col("_t.score").alias("score")))
    return out.select(
        *facts.columns, brand.alias("brand"), source.alias("brand_source"), F.when(F.col("_t").isNotNull(), evidence).alias("brand_evidence"),
        F.coalesce("_t.conflict", F.lit(False)).alias("brand_conflict"),
    )


def alias_dictionary(brands: DataFrame) -> DataFrame:
    """(alias, brand, rank) from brand, aliases, registered_entities.

    Aliases, registered names and the brand itself, normalised; a single word
    of fewer than 5 letters is no alias; of equal ones the least brand keeps it.
    """
    empty = F.array().cast("array<string>")
    names = F.concat(F.array(F.col("brand")), F.coalesce("aliases", empty), F.coalesce("registered_entities", empty))
    rows = brands.select("brand", F.explode(names).alias("alias")).withColumn("alias", text.norm_text(F.col("alias")))
    usable = (F.col("alias") != "") & ((F.size(F.split("alias", " ")) > 1) | (F.length("alias") >= 5))
    w = Window.partitionBy("alias").orderBy("brand")
    return rows.filter(usable).distinct().withColumn("rank", F.row_number().over(w)).filter("rank = 1")


def compile_developers(registry: DataFrame, brands: DataFrame, aliases: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """developer_id -> brand (E2): exact registered name, then alias in a name, then overrides on top.

    ``all_ids`` of one exact name map too (E3).
    """
    entities = brands.select("brand", F.explode("registered_entities").alias("entity")).select(
        text.norm_label(F.col("entity")).alias("entity"), F.col("brand").alias("exact")
    )
    # An entity that several brands name is the least brand's.
    entities = entities.groupBy("entity").agg(F.min("exact").alias("exact"))
    names = registry.withColumn("_ar", text.norm_label(F.col("developer_name_ar"))).join(entities, F.col("_ar") == F.col("entity"), "left")
    for lang in ("en", "ar"):
        names = names.withColumn(f"_t_{lang}", text.norm_text(F.col(f"developer_name_{lang}")))
        hits = alias_hits(names, f"_t_{lang}", aliases).select(F.col(f"_t_{lang}").alias(f"_k_{lang}"), F.col("brand").alias(f"_b_{lang}"))
        names = names.join(hits, F.col(f"_t_{lang}") == F.col(f"_k_{lang}"), "left")
    if overrides is None:
        found, source = F.coalesce("exact", "_b_en", "_b_ar"), F.when(F.col("exact").isNotNull(), "EXACT").otherwise("ALIAS")
    else:
        names = names.join(overrides.select(F.col("developer_id").alias("_o"), F.col("developer_brand").alias("override")), F.col("developer_id") == F.col("_o"), "left")
        found = F.coalesce("override", "exact", "_b_en", "_b_ar")
        source = F.when(F.col("override").isNotNull(), "OVERRIDE").when(F.col("exact").isNotNull(), "EXACT").otherwise("ALIAS")
    return names.select("developer_id", found.alias("brand"), source.alias("source")).filter("brand is not null").distinct()


def validate_overrides(overrides: DataFrame, canonical: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantine with a suggestion) of brand overrides."""
    known = canonical.select(F.col("brand").alias("_b"), text.label_key(F.col("brand")).alias("_key"))
    exact = overrides.join(known, F.col("developer_brand") == F.col("_b"), "left")
    bad = exact.filter("_b is null").drop("_b", "_key")
    hint = known.groupBy("_key").agg(F.min("_b").alias("suggestion"))
    return exact.filter("_b is not null").drop("_b", "_key"), bad.join(hint, text.label_key(F.col("developer_brand")) == F.col("_key"), "left").drop("_key").withColumn(
        "reason", F.lit("non_canonical")
    )


def area_aliases(reference: DataFrame) -> DataFrame:
    """alias -> dominant area, candidates, ambiguous.

    ``reference``: area_name, total_units, common_aliases (comma list).
    """
    rows = reference.select(F.explode(text.split_list(F.col("common_aliases"))).alias("alias"), "area_name", "total_units")
    units = rows.groupBy(F.lower("alias").alias("alias"), "area_name").agg(F.sum("total_units").alias("units"))
    best = F.min(F.struct((-F.col("units")).alias("less"), F.col("area_name"))).alias("b")
    return units.groupBy("alias").agg(best, F.array_sort(F.collect_set("area_name")).alias("candidates")).select(
        "alias", F.col("b.area_name").alias("dominant"), "candidates", (F.size("candidates") > 1).alias("ambiguous")
    )


def spelling_conflicts(df: DataFrame, name: str) -> DataFrame:
    """Normalised keys with several spellings, and the commonest one."""
    counts = df.filter(F.col(name).isNotNull()).groupBy(text.norm_entity(F.col(name)).alias("key"), name).agg(F.count("*").alias("_n"))
    best = F.min(F.struct((-F.col("_n")).alias("less"), F.col(name).alias("v"))).alias("b")
    return counts.groupBy("key").agg(F.count("*").alias("spellings"), F.sum("_n").alias("rows"), best).filter("spellings > 1").select(
        "key", "spellings", "rows", F.col("b.v").alias("canonical")
    )


def learned_mapping(df: DataFrame, entity: str, brand: str, project: str, min_tx: int = 30, min_share: float = 0.85, high_share: float = 0.95, high_projects: int = 5) -> DataFrame:
    """Brand that text evidence gives an entity, with confidence."""
    seen = df.filter(F.col(brand).isNotNull() & F.col(entity).isNotNull())
    per = seen.groupBy(entity, brand).agg(F.count("*").alias("n"))
    projects = seen.groupBy(entity).agg(F.countDistinct(project).alias("projects"))
    best = F.min(F.struct((-F.col("n")).alias("less"), F.col(brand).alias("v"))).alias("b")
    out = per.groupBy(entity).agg(best, F.sum("n").alias("tx")).join(projects, entity)
    share = -F.col("b.less") / F.col("tx")
    return out.select(entity, F.col("b.v").alias(brand), "tx", "projects", F.round(share, 4).alias("share")).filter(
        (F.col("tx") >= min_tx) & (F.col("share") >= min_share)
    ).withColumn("confidence", F.when((F.col("share") >= high_share) & (F.col("projects") >= high_projects), "HIGH").otherwise("MEDIUM"))


def umbrella_suggestions(projects: DataFrame) -> DataFrame:
    """Per developer: the mode of its projects' brands, share agreeing, conflict."""
    per = projects.dropna(subset=["developer_id", "brand"]).groupBy("developer_id", "brand").agg(F.countDistinct("project_number").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("less"), "brand")).alias("b")
    return per.groupBy("developer_id").agg(best, F.sum("n").alias("projects"), F.count("*").alias("brands")).select(
        "developer_id", F.col("b.brand").alias("suggested"), "projects", F.round(-F.col("b.less") / F.col("projects"), 4).alias("agreeing"), (F.col("brands") > 1).alias("conflict")
    )


def tag(df: DataFrame, label: str, table: DataFrame, flag: str) -> DataFrame:
    """Flag labels that a list has, under any spelling."""
    keys = table.groupBy(text.label_key(F.col("alias")).alias("_key")).agg(F.min("canonical").alias(f"{flag}_brand"))
    joined = df.join(keys, text.label_key(F.col(label)) == F.col("_key"), "left").drop("_key")
    return joined.withColumn(flag, F.col(f"{flag}_brand").isNotNull().cast("int"))


def mapping_coverage(names: DataFrame, mapping: DataFrame, targets: DataFrame) -> DataFrame:
    """Per name: ``ok``, ``missing`` from the mapping, or ``invalid`` target."""
    m = mapping.select(F.col("alias").alias("_a"), F.col("canonical").alias("_c"))
    t = targets.select(F.col("name").alias("_t")).distinct()
    joined = names.select("name").distinct().join(m, F.col("name") == F.col("_a"), "left").join(t, F.coalesce("_c", "name") == F.col("_t"), "left")
    status = F.when(F.col("_t").isNotNull(), "ok").when(F.col("_a").isNull(), "missing").otherwise("invalid")
    return joined.select("name", F.col("_c").alias("target"), status.alias("status"))


def resolve_names(requests: DataFrame, column: str, steps: list[tuple[DataFrame, str, float]], fallback: float = 50.0) -> DataFrame:
    """Resolve a name by prioritised tables.

    ``steps``: (table of key and value, method, confidence); the first with a
    value wins, else the input with the fallback's confidence.
    """
    out, options = requests, []
    for k, (table, method, confidence) in enumerate(steps):
        dim = table.groupBy(F.col("key").alias(f"_k{k}")).agg(F.min("value").alias(f"_v{k}"))
        out = out.join(dim, F.lower(F.trim(column)) == F.lower(F.trim(f"_k{k}")), "left").drop(f"_k{k}")
        options.append(F.when(F.col(f"_v{k}").isNotNull(), F.struct(F.col(f"_v{k}").alias("value"), F.lit(method).alias("method"), F.lit(confidence).alias("confidence"))))
    last = F.when(_filled(F.col(column)).isNotNull(), F.struct(F.col(column).alias("value"), F.lit("fallback").alias("method"), F.lit(fallback).alias("confidence")))
    out = out.withColumn("_r", F.coalesce(*options, last))
    return out.select(*requests.columns, *[F.col(f"_r.{p}").alias(f"{column}_{p}") for p in ("value", "method", "confidence")])


def brand_by_substring(facts: DataFrame, aliases: DataFrame) -> DataFrame:
    """Brand per building, developer and area (E7): alias in the building name, registered under the developer.

    ``aliases``: alias, brand, rank, registered_under (array, NULL: any), area (NULL: any).
    The rule is tried on what contains an alias only.
    """
    texts = facts.select("building_name", "developer_name", "area_name").distinct().withColumn("_text", F.upper("building_name"))
    table = aliases.withColumn("alias", F.upper("alias")).withColumnsRenamed({"area": "_area"})
    ok = (F.col("registered_under").isNull() | F.array_contains("registered_under", F.col("developer_name"))) & (
        F.col("_area").isNull() | (F.col("_area") == F.col("area_name"))
    )
    best = F.min(F.struct("rank", "brand")).alias("b")
    hit = contains_aliases(texts, "_text", table, ok).groupBy("building_name", "developer_name", "area_name").agg(best)
    return hit.select("building_name", "developer_name", "area_name", F.col("b.brand").alias("brand"))


def _open(names: DataFrame, done: list[DataFrame]) -> DataFrame:
    """Names that no step before has resolved."""
    for step in done:
        names = names.join(step.select("name"), "name", "left_anti")
    return names


def _step(found: DataFrame, value: str | Column, confidence: Column | float, method: str | Column) -> DataFrame:
    as_column = lambda x, plain: x if isinstance(x, Column) else plain(x)
    return found.select("name", as_column(value, F.col).alias("value"), as_column(confidence, lambda x: F.lit(float(x))).alias("confidence"), as_column(method, F.lit).alias("method"))


def _resolved(requests: DataFrame, column: str, steps: list[DataFrame], last: Column, unknown: str) -> DataFrame:
    """``requests`` with what the steps say of each name; others get ``last`` with confidence 50, empty ones nothing."""
    every = steps[0]
    for step in steps[1:]:
        every = every.unionByName(step)
    own = every.select(F.col("name").alias("_name"), F.struct("value", "confidence", "method").alias("_found"))
    joined = requests.join(own, F.col(column) == F.col("_name"), "left").drop("_name")
    kind = lambda v, c, m: F.struct(v.alias("value"), F.lit(c).alias("confidence"), F.lit(m).alias("method"))
    empty = F.coalesce(F.col(column), F.lit("")) == ""
    r = F.when(empty, kind(F.lit(None).cast("string"), 0.0, "none")).otherwise(F.coalesce("_found", kind(last, 50.0, unknown)))
    return joined.withColumn("_r", r).select(*requests.columns, *[F.col(f"_r.{p}").alias(f"{column}_{p}") for p in ("value", "confidence", "method")])


def resolve_areas(requests: DataFrame, column: str, abbreviations: DataFrame, areas: DataFrame, ambiguous: DataFrame | None = None) -> DataFrame:
    """Area names by the ordered cascade (E10): adds ``<column>_value``, ``_confidence``, ``_method``.

    Abbreviation (``abbrev``, 100); ambiguous alias (its dominant area, 60);
    nearest abbreviation with a score of 85 (``abbrev_fuzzy``, the score; if it
    is ambiguous, the dominant area, 60); exact area (100); nearest area with a
    score of 70 (``fuzzy``); else the input itself, 50. Case and blanks around
    a name do not count, but in fuzzy steps blanks do. An empty name is ``none``.
    ``abbreviations``: alias, area; ``ambiguous``: alias, dominant; ``areas``:
    area. Names are resolved once each, and a step sees only those still open.
    """
    nothing = requests.sparkSession.createDataFrame([], "alias string, dominant string")
    ambiguous = (nothing if ambiguous is None else ambiguous).filter("dominant <> ''")
    names = requests.select(F.col(column).alias("name")).filter("name <> ''").distinct()
    key = lambda c: F.lower(F.trim(c))
    lowered = lambda df, alias, value, *by: df.groupBy(F.lower(alias).alias("_key")).agg(F.min(value).alias("value"))
    at = lambda known: lambda df: df.join(known, key(F.col("name")) == F.col("_key")).drop("_key")
    short = _step(at(lowered(abbreviations, "alias", "area"))(names), "value", 100.0, "abbrev")
    left = _open(names, [short])
    doubtful = _step(at(lowered(ambiguous, "alias", "dominant"))(left), "value", 60.0, "ambiguous")
    left = _open(left, [doubtful])
    by_alias = abbreviations.groupBy("alias").agg(F.min("area").alias("area")).join(ambiguous.groupBy("alias").agg(F.min("dominant").alias("dominant")), "alias", "left")
    near = fuzzy_best(left, "name", abbreviations, "alias", 85.0).join(by_alias, "alias")
    dominant = F.col("dominant").isNotNull()
    near = _step(near, F.coalesce("dominant", "area"), F.when(dominant, 60.0).otherwise(F.col("score")), F.when(dominant, "ambiguous").otherwise("abbrev_fuzzy"))
    left = _open(left, [near])
    exact = _step(at(lowered(areas, "area", "area"))(left), "value", 100.0, "exact")
    left = _open(left, [exact])
    similar = _step(fuzzy_best(left, "name", areas, "area", 70.0), "area", F.col("score"), "fuzzy")
    return _resolved(requests, column, [short, doubtful, near, exact, similar], F.col(column), "fallback")


def resolve_developers(requests: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """Developer names by the ordered cascade (E11): adds ``<column>_value``, ``_native``, ``_confidence``, ``_method``.

    ``mapping``: english, arabic, aliases. Exact name (100), alias (100), the
    nearest name or alias with a score of 70 (``fuzzy``, the score); else the
    input with the native name Unknown, 50. An empty name is ``none``.
    """
    names = requests.select(F.col(column).alias("name")).filter("name <> ''").distinct()
    table = mapping.select("english", "arabic", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases")).filter("english <> ''")
    listed = table.select("english", "arabic", F.explode("aliases").alias("alias")).filter("alias <> ''")
    both = lambda df, c: df.groupBy(F.lower(c).alias("_key")).agg(F.min(F.struct("english", "arabic")).alias("m"))
    at = lambda df, known: df.join(known, F.lower(F.trim("name")) == F.col("_key")).drop("_key")
    value = F.to_json("m", {"ignoreNullFields": "false"})
    exact = _step(at(names, both(table, "english")), value, 100.0, "exact")
    left = _open(names, [exact])
    alias = _step(at(left, both(listed, "alias")), value, 100.0, "alias")
    left = _open(left, [alias])
    known = table.select("english", "arabic", F.col("english").alias("candidate")).unionByName(listed.select("english", "arabic", F.col("alias").alias("candidate")))
    near = fuzzy_best(left, "name", known, "candidate", 70.0).join(both(known, "candidate"), F.lower("candidate") == F.col("_key"))
    out = _resolved(requests, column, [exact, alias, _step(near, value, F.col("score"), "fuzzy")], F.to_json(F.struct(F.col(column).alias("english"), F.lit("Unknown").alias("arabic"))), "unknown")
    pair = F.from_json(f"{column}_value", "english string, arabic string")
    return out.withColumns({f"{column}_value": pair["english"], f"{column}_native": pair["arabic"]})


ANY_DEVELOPER = "ALL_DEVELOPERS"


def infer_brands(facts: DataFrame, rules: DataFrame) -> DataFrame:
    """Brand per distinct (project_name, building_name, area_name, developer_name) by rules in their order.

    ``rules``: brand, rank, aliases (array), registered_under (string, NULL: no
    expectation), registered_under_by_area (map of area to developers). A rule
    applies if one of its aliases is inside the project's and building's name,
    case and white space ignored, and the registered developer is the one that
    the area expects; where the area expects none, the rule's own; and where
    there is none either, only if the rule names no areas at all. A developer
    ALL_DEVELOPERS meets every expectation. The first rule that applies wins.
    """
    flat = lambda c: F.trim(F.regexp_replace(F.lower(c), r"(?U)\s+", " "))
    trimmed = lambda c: F.coalesce(F.trim(c), F.lit(""))
    fields = ["project_name", "building_name", "area_name", "developer_name"]
    empty = F.lit("")
    named = facts.select(*fields).distinct().withColumns(
        {
            "_text": flat(F.concat_ws(" ", F.coalesce("project_name", empty), F.coalesce("building_name", empty))),
            "_area": trimmed("area_name"),
            "_developer": trimmed("developer_name"),
        }
    )
    table = rules.select("brand", "rank", "registered_under", "registered_under_by_area", F.explode("aliases").alias("alias")).withColumn("alias", flat(F.col("alias")))
    by_area = F.col("registered_under_by_area")
    expected = F.try_element_at(by_area, F.col("_area"))
    anyone = F.col("_developer") == ANY_DEVELOPER
    ok = (
        F.when(expected.isNotNull(), anyone | F.array_contains(expected, F.col("_developer")))
        .when(F.coalesce(F.col("registered_under"), empty) != "", anyone | (F.col("_developer") == F.col("registered_under")))
        .otherwise(F.coalesce(F.size(F.map_keys(by_area)), F.lit(0)) <= 0)
    )
    hits = contains_aliases(named, "_text", table, ok)
    best = F.min(F.struct("rank", "brand")).alias("b")
    return hits.groupBy(*fields).agg(best).select(*fields, F.col("b.brand").alias("brand"))


def canonical_by_key(df: DataFrame, name: str, table: DataFrame) -> DataFrame:
    """Canonical spelling under a key without white space."""
    key = lambda c: F.regexp_replace(c, r"(?U)\s", "")
    dim = table.groupBy(key(F.col("name")).alias("_key")).agg(F.min("name").alias("_canonical"))
    return df.join(dim, key(F.col(name)) == F.col("_key"), "left").withColumn(name, F.coalesce("_canonical", name)).drop("_key", "_canonical")


def entity_review(df: DataFrame, name: str) -> dict[str, DataFrame]:
    """Conflicts, near-duplicate pairs and the master list of one entity."""
    return {
        "conflicts": spelling_conflicts(df, name),
        "pairs": similar_pairs(df, name),
        "master": df.filter(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("n")),
    }
