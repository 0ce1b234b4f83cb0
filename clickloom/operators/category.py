"""Categories: universe, counts, top lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalar as S


def _ids(c: str):
    return F.transform(S.split_items(c), lambda x: x.cast("bigint"))


def _own(c: str):
    return F.when(F.col(c).isNotNull(), F.array(c))


def universe_ids():
    """A row's categories: of its click, else of its order, else of its payment."""
    return F.when(F.col("click_category_id").isNotNull(), F.array("click_category_id")).when(F.col("order_category_ids").isNotNull(), _ids("order_category_ids")).when(
        F.col("pay_category_ids").isNotNull(), _ids("pay_category_ids")
    )


def universe(actions: DataFrame) -> DataFrame:
    return actions.select(F.explode(universe_ids()).alias("category_id")).distinct()


def clicks(actions: DataFrame) -> DataFrame:
    return actions.where("click_category_id IS NOT NULL").groupBy(F.col("click_category_id").alias("category_id")).agg(F.count("*").alias("click_count"))


def listed(actions: DataFrame, column: str, out: str) -> DataFrame:
    return actions.where(~S.is_blank(column)).select(F.explode(_ids(column)).alias("category_id")).groupBy("category_id").agg(F.count("*").alias(out))


def orders(actions: DataFrame) -> DataFrame:
    return listed(actions, "order_category_ids", "order_count")


def pays(actions: DataFrame) -> DataFrame:
    return listed(actions, "pay_category_ids", "pay_count")


def counts(actions: DataFrame) -> DataFrame:
    """Click, order and pay counts of the universe's categories: one explode of tagged ids
    and one shuffle of partial counts, in place of four aggregates and three joins."""
    tag = lambda ids, kind: F.transform(F.coalesce(ids, F.array().cast("array<bigint>")), lambda x: F.struct(x.alias("category_id"), F.lit(kind).alias("kind")))
    full = lambda c: F.when(~S.is_blank(c), _ids(c))
    every = F.concat(tag(universe_ids(), "u"), tag(_own("click_category_id"), "c"), tag(full("order_category_ids"), "o"), tag(full("pay_category_ids"), "p"))
    rows = actions.select(F.explode(every).alias("t")).select("t.*")
    n = lambda kind: F.count_if(F.col("kind") == kind)
    out = rows.groupBy("category_id").agg(n("c").alias("click_count"), n("o").alias("order_count"), n("p").alias("pay_count"), n("u").alias("_u"))
    return out.where("_u > 0").drop("_u")


def top(counted: DataFrame, n: int = 10) -> DataFrame:
    """Sorted by click, order, pay counts downwards, then by id: a bounded heap in each task."""
    return counted.orderBy(F.desc("click_count"), F.desc("order_count"), F.desc("pay_count"), "category_id").limit(n)


def session_clicks(actions: DataFrame) -> DataFrame:
    return actions.where("click_category_id IS NOT NULL").groupBy("session_id", F.col("click_category_id").alias("category_id")).agg(F.count("*").alias("click_count"))


def top_sessions(actions: DataFrame, top_categories: DataFrame, n: int = 10) -> DataFrame:
    """The sessions with most clicks in each of the top categories (at most ten: broadcast)."""
    some = session_clicks(actions).join(F.broadcast(top_categories.select("category_id")), "category_id")
    order = W.partitionBy("category_id").orderBy(F.desc("click_count"), "session_id")
    return some.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= n).select("category_id", "session_id", "click_count", F.col("rn").cast("bigint").alias("rn"))
