"""Advertising clicks, batch forms; the streaming forms use the same functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DAY = "yyyy-MM-dd"


def parse_lines(lines: DataFrame) -> DataFrame:
    """(ts, province, city, user_id, ad_id, sound) from log lines; what can't be read is NULL
    and the row isn't sound."""
    p = F.split("value", " ")
    ms = F.get(p, F.lit(0)).try_cast("bigint")
    out = lines.select(
        F.timestamp_millis(ms).alias("ts"), F.get(p, F.lit(1)).alias("province"), F.get(p, F.lit(2)).alias("city"),
        F.get(p, F.lit(3)).try_cast("bigint").alias("user_id"), F.get(p, F.lit(4)).try_cast("bigint").alias("ad_id"), (F.size(p) == 5).alias("_whole"),
    )
    sound = F.col("_whole") & F.col("ts").isNotNull() & F.col("user_id").isNotNull() & F.col("ad_id").isNotNull()
    return out.withColumn("sound", sound).drop("_whole")


def with_day(log: DataFrame) -> DataFrame:
    return log.withColumn("date", F.date_format("ts", DAY))


def drop_blacklisted(log: DataFrame, blacklist: DataFrame) -> DataFrame:
    """Anti join: Spark broadcasts the blacklist while it is small."""
    return log.join(blacklist.select("user_id"), "user_id", "left_anti")


def user_clicks(log: DataFrame) -> DataFrame:
    return with_day(log).groupBy("date", "user_id", "ad_id").agg(F.count("*").alias("click_count"))


def blacklist_users(totals: DataFrame, threshold: int = 100) -> DataFrame:
    return totals.where(F.col("click_count") >= threshold).select("user_id").distinct()


def stat(log: DataFrame) -> DataFrame:
    return with_day(log).groupBy("date", "province", "city", "ad_id").agg(F.count("*").alias("click_count"))


def province_clicks(stats: DataFrame) -> DataFrame:
    return stats.groupBy("date", "province", "ad_id").agg(F.sum("click_count").alias("click_count"))


def province_top(stats: DataFrame, n: int = 3) -> DataFrame:
    """The ads with most clicks of each day and province, ties by ad_id."""
    order = W.partitionBy("date", "province").orderBy(F.desc("click_count"), "ad_id")
    return province_clicks(stats).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def minute_clicks(log: DataFrame) -> DataFrame:
    return log.groupBy(F.date_trunc("minute", "ts").alias("minute_ts"), "ad_id").agg(F.count("*").alias("click_count"))


def trend_columns(minutes: DataFrame) -> DataFrame:
    t = F.col("minute_ts")
    return minutes.select(F.date_format(t, DAY).alias("date"), F.date_format(t, "HH").alias("hour"), F.date_format(t, "mm").alias("minute"), "ad_id", "click_count")


def trend(log: DataFrame, minutes: int = 60) -> DataFrame:
    """Clicks of each minute and ad in the last ``minutes`` of the log."""
    last = log.agg(F.max("ts").alias("_last"))
    recent = log.join(F.broadcast(last), how="cross").where(F.col("ts") > F.col("_last") - F.expr(f"INTERVAL {int(minutes)} MINUTES"))  # one row
    return trend_columns(minute_clicks(recent))
