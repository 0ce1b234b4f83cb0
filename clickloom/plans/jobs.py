"""The jobs end to end: parameters in, result tables out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import category, funnel, product, session
from ..sources.catalog import Catalog, scan_actions, scan_clicks
from ..sources.sinks import TABLES
from ..sources.staging import stage
from .params import Settings, TaskParam


def session_job(catalog: Catalog, p: TaskParam, settings: Settings | None = None) -> dict[str, DataFrame]:
    """Session analytics.  The filtered sessions and their actions are computed once and stored; all
    outputs read these."""
    s = settings or Settings()
    actions = scan_actions(catalog("user_visit_action"), p.start_date, p.end_date)
    sessions = stage(session.filtered(session.with_users(session.aggregate(actions), catalog("user_info")), p), "sessions")
    detail = stage(session.detail(actions, sessions), "detail")
    extract = session.random_extract(sessions, s.extract_count, task_id=s.task_id)
    best = category.top(category.counts(detail))
    most = category.top_sessions(detail, best)
    return {
        "session_aggr_stat": session.aggr_stat(sessions, s.task_id), "session_random_extract": extract,
        "session_detail": session.detail(detail, extract.select("session_id").unionAll(most.select("session_id")).distinct()),
        "top10_category": best, "top10_session": most,
    }


def page_job(catalog: Catalog, p: TaskParam, settings: Settings | None = None) -> dict[str, DataFrame]:
    s = settings or Settings()
    actions = scan_actions(catalog("user_visit_action"), p.start_date, p.end_date)
    return {"page_split_convert_rate": funnel.packed(funnel.convert_rate(actions, p.target_page_flow), s.task_id)}


def product_job(catalog: Catalog, p: TaskParam, settings: Settings | None = None) -> dict[str, DataFrame]:
    s = settings or Settings()
    clicks = scan_clicks(catalog("user_visit_action"), p.start_date, p.end_date)
    basic = product.click_product_basic(clicks, catalog("city_info"))
    full = product.area_product_full(product.area_product_clicks(basic), catalog("product_info"))
    return {"area_top3_product": product.top_products(full, task_id=s.task_id)}


JOBS = {"session": session_job, "page": page_job, "product": product_job}


def with_task(df: DataFrame, task_id: int) -> DataFrame:
    """``df`` with its task's id as the first column."""
    return df.select(F.lit(task_id).cast("bigint").alias("task_id"), *[c for c in df.columns if c != "task_id"])


def store(outputs: dict[str, DataFrame], table, task_id: int) -> None:
    """Write a job's outputs, each into ``table(name, schema)``, a sink.  What a task has written
    before is replaced, so that a task that is run again doesn't append its rows twice; details are
    inserted where their key isn't there."""
    for name, df in outputs.items():
        df, (mode, keys) = with_task(df, task_id), TABLES[name]
        sink = table(name, df.schema)
        if mode == "append":
            sink.write(df, "replace_group", ("task_id",))
        else:
            sink.write(df, mode, keys)
