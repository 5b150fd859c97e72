"""Sources: CSV, JSON documents, polygons, rate sheets, file listings, JDBC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dates, text
from ..operators.clean import ensure_columns, first_row, rename_synonyms, strip_headers
from .schemas import TENORS

# Spellings of rate-sheet headers.
RATE_HEADERS = {
    "date": "date", "overnight": "overnight", "O/N": "overnight", "ON": "overnight", "1 week": "1_week", "1W": "1_week",
    "1 month": "1_month", "1M": "1_month", "3 months": "3_month", "3 month": "3_month", "3M": "3_month", "6 months": "6_month",
    "6 month": "6_month", "6M": "6_month", "12 months": "12_month", "1Y": "12_month", "1 year": "12_month",
    "التاريخ": "date", "ليلة واحدة": "overnight", "أسبوع واحد": "1_week", "شهر واحد": "1_month", "3 أشهر": "3_month",
    "ثلاثة أشهر": "3_month", "6 أشهر": "6_month", "ستة أشهر": "6_month", "12 شهر": "12_month", "سنة": "12_month",
}
CORRUPT = "_corrupt_row"


def header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV file."""
    return spark.read.csv(path, header=True, inferSchema=False).columns


def csv(spark: SparkSession, path: str, schema: T.StructType, columns: list[str] | None = None) -> DataFrame:
    """Projected scan by header names (S1, S2); a missing column is an error."""
    have = header(spark, path)
    wanted = columns or schema.fieldNames()
    missing = [c for c in wanted if c not in have]
    if missing:
        raise ValueError(f"{path} lacks {missing}")
    kinds = {f.name: f.dataType for f in schema}
    return all_strings(spark, path).select(*[F.col(f"`{c}`").try_cast(kinds[c]).alias(c) for c in wanted])


def all_strings(spark: SparkSession, path: str) -> DataFrame:
    """Every column as text (S5); quotes double, blanks around values go."""
    return spark.read.csv(path, header=True, inferSchema=False, quote='"', escape='"', multiLine=False, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)


def optional(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """As ``csv``, but absent columns are NULL."""
    raw = strip_headers(all_strings(spark, path))
    kinds = {f.name: f.dataType for f in schema}
    have = [c for c in raw.columns if c in kinds]
    df = raw.select(*[F.col(f"`{c}`").try_cast(kinds[c]).alias(c) for c in have])
    return ensure_columns(df, {f.name: f.dataType.simpleString() for f in schema}).select(*schema.fieldNames())


def tolerant(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows as text) of a damaged CSV with one row a line (S3)."""
    first = spark.read.text(path).first()
    return tolerant_lines(spark.read.text(path), first[0] if first else "", schema)


def tolerant_lines(lines: DataFrame, header_line: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """As ``tolerant``, of lines (value) among which ``header_line`` is no row."""
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + f", {CORRUPT} string"
    parsed = lines.filter(F.col("value") != header_line).withColumn("r", F.from_csv("value", shape, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}))
    broken = F.col(f"r.{CORRUPT}").isNotNull()
    return parsed.filter(~broken).select("r.*").drop(CORRUPT), parsed.filter(broken).select(F.col("value").alias("row"))


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One document per file as typed columns."""
    return spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("d")).select("d.*")


def json_column(df: DataFrame, column: str, schema: str) -> DataFrame:
    """A column of documents as typed columns beside the others (S7); what does not parse is NULL."""
    return df.withColumn("_d", F.from_json(column, schema)).select(*[c for c in df.columns if c != column], "_d.*")


def name_list(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Names from either ``[...]`` or ``{key: [...]}``."""
    raw = spark.read.text(path, wholetext=True)
    listed = F.from_json("value", "array<string>")
    keyed = F.from_json("value", f"struct<`{key}`: array<string>>")[key]
    names = F.when(F.ltrim("value").startswith("["), listed).otherwise(keyed)
    return raw.select(F.explode(names).alias("name")).filter("name is not null")


def consolidation(spark: SparkSession, path: str) -> DataFrame:
    """brand, aliases, registered_entities, note from ``{brands: {name: {...}}}``."""
    shape = "brands map<string, struct<registered_entities: array<string>, aliases: array<string>, note: string>>"
    doc = json_document(spark, path, shape)
    return doc.select(F.explode("brands").alias("brand", "d")).select("brand", "d.aliases", "d.registered_entities", "d.note")


def overrides(spark: SparkSession, path: str, key: str, value: str = "developer_brand") -> DataFrame:
    """key -> value; white space made equal, blanks skipped, the last row wins."""
    rows = all_strings(spark, path).withColumn("_at", F.monotonically_increasing_id())
    clean = rows.select(text.norm_ws(F.col(key)).alias(key), text.norm_ws(F.col(value)).alias(value), "_at").filter((F.col(key) != "") & (F.col(value) != ""))
    return first_row(clean, [key], [F.col("_at").desc()]).drop("_at")


def polygons(spark: SparkSession, path: str) -> DataFrame:
    """community_num, name, ring of a KML file (S9); the community's name is preferred."""
    raw = spark.read.format("xml").option("rowTag", "Placemark").schema(
        "ExtendedData struct<SchemaData: struct<SimpleData: array<struct<_name: string, _VALUE: string>>>>,"
        "MultiGeometry struct<Polygon: array<struct<outerBoundaryIs: struct<LinearRing: struct<coordinates: string>>>>>,"
        "Polygon struct<outerBoundaryIs: struct<LinearRing: struct<coordinates: string>>>"
    ).load(path)
    fields = F.map_from_entries(F.transform("ExtendedData.SchemaData.SimpleData", lambda s: F.struct(s["_name"].alias("k"), s["_VALUE"].alias("v"))))
    first = F.coalesce(F.col("Polygon.outerBoundaryIs.LinearRing.coordinates"), F.col("MultiGeometry.Polygon")[0]["outerBoundaryIs"]["LinearRing"]["coordinates"])
    pairs = F.filter(F.split(F.trim(first), r"\s+"), lambda p: p != "")
    ring = F.transform(pairs, lambda p: F.struct(F.split(p, ",")[0].try_cast("double").alias("lon"), F.split(p, ",")[1].try_cast("double").alias("lat")))
    named = raw.select(F.try_element_at(fields, F.lit("COMM_NUM")).alias("community_num"), F.coalesce(F.try_element_at(fields, F.lit("COMMUNITY_E")), F.try_element_at(fields, F.lit("CNAME_E"))).alias("name"), ring.alias("ring"))
    return named.filter(F.col("community_num").isNotNull() & (F.size("ring") > 0))


def sheet(spark: SparkSession, path: str, synonyms: dict[str, str], needed: tuple[str, ...], try_rows: int = 4) -> DataFrame:
    """A sheet exported as CSV whose header is one of the first rows.

    Workbooks need a reader that is not part of the installation; export each
    sheet to CSV. The header is the first row on which all ``needed`` names are.
    """
    raw = spark.read.csv(path, header=False, inferSchema=False)
    for row in raw.limit(try_rows).collect():
        names = {str(v).strip().lower(): c for c, v in row.asDict().items() if v}
        loose = {k.strip().lower(): v for k, v in synonyms.items()}
        found = {loose.get(n): c for n, c in names.items() if loose.get(n)}
        if set(needed) <= set(found):
            first = F.lower(F.trim(F.col(found[needed[0]])))
            body = raw.filter(F.col(found[needed[0]]).isNotNull() & ~first.isin(*loose))
            return body.select(*[F.col(c).alias(n) for n, c in found.items()])
    raise ValueError(f"{path}: no row has {needed}")


def rates(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Daily rates of several sheets, one row a day, later files win."""
    parts = []
    for k, path in enumerate(sorted(paths)):
        s = rename_synonyms(sheet(spark, path, RATE_HEADERS, ("date", "3_month")), RATE_HEADERS)
        day = dates.parse_flexible(F.col("date"))
        parts.append(s.select(day.alias("date"), F.lit(k).alias("_file"), *[F.col(f"`{t}`").try_cast("double").alias(t) for t in TENORS if t in s.columns]).filter("date is not null"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return ensure_columns(first_row(out, ["date"], [F.col("_file").desc(), F.xxhash64(*[c for c in out.columns])]).drop("_file"), {t: "double" for t in TENORS})


def rate_table(monthly: DataFrame) -> DataFrame:
    """Month text and renamed tenors for joins."""
    return monthly.select(dates.month_text(F.col("year_month")).alias("year_month"), *[F.col(f"`{t}`").alias(f"rate_{t}") for t in TENORS])


def files(spark: SparkSession, folder: str, kinds: dict[str, str]) -> DataFrame:
    """Files with year, quarter and kind from their names (S12); the first kind that fits wins."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    quarter = F.nullif(F.regexp_extract(name, r"(?i)Q([1-4])", 1), F.lit(""))
    kind: Column = F.when(F.lit(False), "")
    for part, label in kinds.items():
        kind = kind.when(F.lower(name).contains(part.lower()), label)
    year = F.nullif(F.regexp_extract(name, r"(20\d{2})", 1), F.lit("")).cast("int")
    return listed.select("path", "length", name.alias("name"), year.alias("year"), F.concat(F.lit("Q"), quarter).alias("quarter"), kind.alias("kind"))


def jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A database table read in ``parts`` by ranges of ``key`` (S21); the driver's jar must be there."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts, **options).load()


def panel(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A panel with its key's parts as columns."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df
