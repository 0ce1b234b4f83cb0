"""Popular products by area."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalar as S


def area_level(c="area"):
    """Level of each area."""
    a = S.col(c)
    return F.when(a.isin("North", "East"), "A").when(a.isin("South", "Middle"), "B").when(a.isin("North West", "North East"), "C").otherwise("D")


def click_product_basic(clicks: DataFrame, cities: DataFrame) -> DataFrame:
    """Clicks with their city's name and area; clicks of unknown cities go."""
    return clicks.join(cities, "city_id").select("city_id", "city_name", "area", "product_id")


def area_product_clicks(basic: DataFrame) -> DataFrame:
    """Clicks of each product in each area and the distinct cities they come from."""
    return basic.groupBy("area", "product_id").agg(F.count("*").alias("click_count"), S.group_concat_distinct(S.concat_long_string("city_id", "city_name")).alias("city_infos"))


def area_product_full(counted: DataFrame, products: DataFrame) -> DataFrame:
    status = F.when(S.json_field("extend_info", "product_status") == "0", "Self").otherwise("Third Party")
    info = products.select("product_id", "product_name", status.alias("product_status"))
    return counted.join(info, "product_id").select("area", "product_id", "click_count", "city_infos", "product_name", "product_status")


def top_products(full: DataFrame, n: int = 3, task_id: int = 1) -> DataFrame:
    """The products with most clicks in each area, ties by product_id."""
    order = W.partitionBy("area").orderBy(F.desc("click_count"), "product_id")
    best = full.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n)
    return best.select(F.lit(task_id).cast("bigint").alias("task_id"), "area", area_level().alias("area_level"), "product_id", "city_infos", "click_count", "product_name", "product_status")
