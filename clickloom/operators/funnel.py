"""Page funnel: one-step conversion over a target flow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalar as S


def flow_splits(spark: SparkSession, flow) -> DataFrame:
    """(pos, split) of the flow's adjacent pairs, from 1; as long as the flow."""
    rows = [(i, f"{a}_{b}") for i, (a, b) in enumerate(zip(flow, flow[1:], strict=False), 1)]
    return spark.createDataFrame(rows, "pos bigint, split string")


def page_pairs(actions: DataFrame) -> DataFrame:
    """Consecutive pages of each session, by time, then event_id."""
    order = W.partitionBy("session_id").orderBy(S.parse_time("action_time"), "event_id")
    before = actions.select("session_id", F.lag("page_id").over(order).alias("from_page"), F.col("page_id").alias("to_page"))
    return before.where("from_page IS NOT NULL").withColumn("split", F.concat_ws("_", F.col("from_page").cast("string"), F.col("to_page").cast("string")))


def split_pv(actions: DataFrame, flow) -> DataFrame:
    """How often each target pair stands in a session; any pair counts wherever it stands."""
    target = flow_splits(actions.sparkSession, flow).select("split").distinct()
    return page_pairs(actions).join(F.broadcast(target), "split").groupBy("split").agg(F.count("*").alias("pv"))


def start_pv(actions: DataFrame, flow) -> DataFrame:
    return actions.agg(F.count_if(F.col("page_id") == flow[0]).alias("start_pv"))


def convert_rate(actions: DataFrame, flow) -> DataFrame:
    """(pos, split, pv, rate): each pair's count over the one before, the first over the start
    page's views; a pair that doesn't occur has 0, a rate over 0 is NULL.

    One pass over the actions: start views and pairs are counted in the same aggregate."""
    spark = actions.sparkSession
    order = W.partitionBy("session_id").orderBy(S.parse_time("action_time"), "event_id")
    seen = actions.select("page_id", F.lag("page_id").over(order).alias("_from"))
    names = list(dict.fromkeys(f"{a}_{b}" for a, b in zip(flow, flow[1:], strict=False)))
    pair = F.concat_ws("_", F.col("_from").cast("string"), F.col("page_id").cast("string"))
    found = seen.agg(F.count_if(F.col("page_id") == flow[0]).alias("start_pv"), *[F.count_if(F.col("_from").isNotNull() & (pair == n)).alias(n) for n in names])
    pvs = F.create_map(*[x for n in names for x in (F.lit(n), F.col(f"`{n}`"))])
    steps = flow_splits(spark, flow).join(F.broadcast(found.select("start_pv", pvs.alias("pvs"))), how="cross")  # one row
    steps = steps.select("pos", "split", F.element_at("pvs", F.col("split")).alias("pv"), "start_pv")
    last = F.coalesce(F.lag("pv").over(W.orderBy("pos")), "start_pv")  # as many rows as the flow has steps
    return steps.withColumn("_before", last).select("pos", "split", "pv", S.ratio2("pv", "_before").alias("rate"))


def packed(rates: DataFrame, task_id: int = 1) -> DataFrame:
    """One row: ``3_5=0.07|5_2=...`` in the order of the flow."""
    parts = F.array_sort(F.collect_list(F.struct("pos", F.concat_ws("=", "split", F.when(F.col("rate").isNull(), "null").otherwise(F.format_string("%.2f", "rate"))).alias("s"))))
    return rates.agg(F.array_join(F.transform(parts, lambda x: x["s"]), "|").alias("convert_rate")).select(F.lit(task_id).cast("bigint").alias("task_id"), "convert_rate")
