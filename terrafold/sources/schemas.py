"""Schemas of the raw tables. Ids stay strings, dates are text until cleaned."""

from __future__ import annotations

from pyspark.sql import types as T


KINDS = {"string": T.StringType(), "double": T.DoubleType(), "int": T.IntegerType()}


def _schema(text: str) -> T.StructType:
    """``name type, name type``; needs no session, unlike DDL."""
    pairs = (field.split() for field in text.split(","))
    return T.StructType([T.StructField(name, KINDS[kind]) for name, kind in pairs])


TRANSACTIONS = _schema(
    "transaction_id string, instance_date string, procedure_name_en string, property_usage_en string, property_type_en string, reg_type_en string,"
    "rooms_en string, procedure_area double, actual_worth double, meter_sale_price double, project_number string, project_name_en string,"
    "master_project_en string, building_name_en string, area_id string, area_name_en string, trans_group_id string, has_parking string"
)
RENT_CONTRACTS = _schema(
    "contract_start_date string, contract_end_date string, annual_amount double, contract_amount double, area_name_en string, ejari_property_type_en string,"
    "ejari_property_sub_type_en string, property_usage_en string, ejari_business_type_en string, actual_area double, nearest_metro_en string,"
    "nearest_mall_en string, nearest_landmark_en string, version string, ren_contract_num string"
)
PROJECTS = _schema(
    "project_id string, project_number string, developer_id string, developer_name string, master_developer_id string, master_developer_name string,"
    "project_start_date string, project_end_date string, completion_date string, cancellation_date string, project_status string, percent_completed double,"
    "area_id string, area_name_en string, master_project_en string, no_of_units int, no_of_buildings int, no_of_villas int"
)
DEVELOPERS = _schema("developer_id string, developer_name_en string, developer_name_ar string")
AREAS = _schema("area_id string, name_en string, name_ar string, municipality_number string")
TRANSACTION_GROUPS = _schema("group_id string, name_en string")
SALE_INDEX = _schema(
    "first_date_of_month string, all_monthly_index double, flat_monthly_index double, villa_monthly_index double,"
    "all_monthly_price_index double, flat_monthly_price_index double, villa_monthly_price_index double"
)
TENORS = ("overnight", "1_week", "1_month", "3_month", "6_month", "12_month")
RATES = T.StructType([T.StructField("date", T.StringType()), *[T.StructField(t, T.DoubleType()) for t in TENORS]])
TABLES = {
    "transactions": TRANSACTIONS, "rent_contracts": RENT_CONTRACTS, "projects": PROJECTS, "developers": DEVELOPERS, "areas": AREAS,
    "transaction_groups": TRANSACTION_GROUPS, "sale_index": SALE_INDEX, "rates": RATES,
}
