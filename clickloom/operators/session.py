"""Session analytics: aggregate, parameterised filter, histograms, detail, hourly extract."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..plans.params import TaskParam

#: Histogram buckets (name, low, high), both ends included; None: no upper end.
VISIT = (("1s_3s", 1, 3), ("4s_6s", 4, 6), ("7s_9s", 7, 9), ("10s_30s", 10, 30), ("30s_60s", 31, 60), ("1m_3m", 61, 180), ("3m_10m", 181, 600), ("10m_30m", 601, 1800), ("30m", 1801, None))
STEP = (("1_3", 1, 3), ("4_6", 4, 6), ("7_9", 7, 9), ("10_30", 10, 30), ("30_60", 31, 60), ("60", 61, None))


def aggregate(actions: DataFrame) -> DataFrame:
    """A row a session: user, distinct keywords and categories (sorted), start, whole seconds
    from first to last action, number of actions.  One shuffle with partial aggregates."""
    at = S.parse_time("action_time")
    lists = actions.groupBy("session_id").agg(
        F.min("user_id").alias("user_id"), S.group_concat_distinct(F.when(~S.is_blank("search_keyword"), F.col("search_keyword"))).alias("search_keywords"),
        F.array_join(F.transform(F.array_sort(F.collect_set("click_category_id")), lambda x: x.cast("string")), ",").alias("click_category_ids"),
        F.min(at).alias("_lo"), F.max(at).alias("_hi"), F.count("*").alias("step_length"),
    )
    return lists.select(
        "session_id", "user_id", "search_keywords", "click_category_ids", S.format_time("_lo").alias("start_time"),
        (F.unix_seconds("_hi") - F.unix_seconds("_lo")).alias("visit_length"), "step_length",
    )


def with_users(sessions: DataFrame, users: DataFrame) -> DataFrame:
    """Sessions of known users with their attributes; Spark broadcasts ``users`` while it is small."""
    return sessions.join(users.select("user_id", "age", "professional", "city", "sex"), "user_id")


def between(c: str, lo, hi) -> Column:
    """Applies only if both ends are given; NULL data fails."""
    return F.lit(True) if lo is None or hi is None else F.coalesce(F.col(c).between(lo, hi), F.lit(False))


def isin(c: str, values) -> Column:
    return F.lit(True) if values is None else F.coalesce(F.col(c).isin(*values), F.lit(False))


def overlaps(c: str, values) -> Column:
    """Any part of the comma-separated column is among ``values``."""
    return F.lit(True) if values is None else F.coalesce(F.arrays_overlap(S.split_items(c), F.array(*[F.lit(str(v)) for v in values])), F.lit(False))


def equal(c: str, value) -> Column:
    return F.lit(True) if value is None else F.coalesce(F.col(c) == value, F.lit(False))


def filtered(full: DataFrame, p: TaskParam) -> DataFrame:
    """The conjunction of all given filters, one predicate for Catalyst."""
    tests = [
        between("age", p.start_age, p.end_age), isin("professional", p.professionals), isin("city", p.cities), equal("sex", p.sex),
        overlaps("search_keywords", p.keywords), overlaps("click_category_ids", p.category_ids),
    ]
    return full.where(reduce(lambda a, b: a & b, tests))


def _counts():
    for prefix, column, buckets in (("visit", "visit_length", VISIT), ("step", "step_length", STEP)):
        for name, lo, hi in buckets:
            inside = F.col(column) >= lo if hi is None else F.col(column).between(lo, hi)
            yield f"{prefix}_{name}", F.count_if(inside)


def bucket_counts(sessions: DataFrame) -> DataFrame:
    """One row: number of sessions and of sessions in each bucket; one pass."""
    return sessions.agg(F.count("*").alias("session_count"), *[c.alias(n) for n, c in _counts()])


def aggr_stat(sessions: DataFrame, task_id: int = 1) -> DataFrame:
    """One row: the bucket counts as ratios of the session count, NULL without sessions."""
    b = bucket_counts(sessions)
    return b.select(F.lit(task_id).cast("bigint").alias("task_id"), "session_count", *[S.ratio2(c, "session_count").alias(c) for c in b.columns if c != "session_count"])


def detail(actions: DataFrame, sessions: DataFrame) -> DataFrame:
    """The actions of ``sessions`` (session_id is unique there, so a semi join)."""
    return actions.join(sessions.select("session_id"), "session_id", "left_semi")


def hour_counts(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy(F.substring("start_time", 1, 10).alias("date"), F.substring("start_time", 12, 2).alias("hour")).agg(F.count("*").alias("session_count"))


def hour_quota(sessions: DataFrame, extract: int = 100) -> DataFrame:
    """Each hour's share: extract // days a day, by the hour's part of the day's sessions, rounded down."""
    h = hour_counts(sessions)
    days = h.agg(F.count_distinct("date").alias("days"))
    total = F.sum("session_count").over(W.partitionBy("date"))
    per_day = F.expr(f"{int(extract)} div days")
    quota = F.least("session_count", F.floor(F.col("session_count").cast("double") / total * per_day).cast("bigint"))
    return h.join(F.broadcast(days), how="cross").select("date", "hour", "session_count", quota.alias("quota"))  # one row


def random_extract(sessions: DataFrame, extract: int = 100, seed: str = "42", task_id: int = 1) -> DataFrame:
    """Sessions drawn by the hours' quotas, in the order of a seeded digest: the same for a seed.

    Only hours with a quota are ranked; the rank's partial limit keeps hot hours small."""
    keyed = sessions.withColumn("date", F.substring("start_time", 1, 10)).withColumn("hour", F.substring("start_time", 12, 2))
    quota = hour_quota(sessions, extract).where("quota > 0").select("date", "hour", "quota")
    order = W.partitionBy("date", "hour").orderBy(F.md5(F.concat("session_id", F.lit(seed)).cast("binary")), "session_id")
    drawn = keyed.join(quota, ["date", "hour"]).withColumn("_n", F.row_number().over(order)).where("_n <= quota")
    return drawn.select(F.lit(task_id).cast("bigint").alias("task_id"), "session_id", "start_time", "search_keywords", "click_category_ids")
