"""Entry point of the jobs: ``spark-submit main.py JOB [TASK_ID] [--settings FILE] [--tables DIR] [--out DIR]``.

The task's id comes from the arguments, or else from the settings (``task_id``, or one for each job, such as
``session.task_id``).  The task's parameters are a row of the ``task`` table: in the database of the
settings' ``jdbc_url``, or in the Parquet folder ``task`` of the tables.  Results go to that database or,
without one, to tables under the folder ``out``.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from ..sources.catalog import Catalog, lookup, read_jdbc
from ..sources.sinks import JdbcTable, ParquetTable
from .jobs import JOBS, store
from .params import Settings, TaskParam


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="clickloom")
    p.add_argument("job", choices=sorted(JOBS))
    p.add_argument("task_id", nargs="?", type=int)
    p.add_argument("--settings", help="lines key=value")
    p.add_argument("--tables", default=".", help="folder of the input tables")
    p.add_argument("--out", default="results", help="folder of the result tables")
    return p.parse_args(argv)


def task_id_of(args: argparse.Namespace, settings: Settings) -> int:
    if args.task_id is not None:
        return args.task_id
    return int(settings.extra.get(f"{args.job}.task_id", settings.task_id))


def task_param(spark: SparkSession, args: argparse.Namespace, settings: Settings, task_id: int) -> TaskParam:
    """The task's parameters, by point lookup; a task that isn't there is an error."""
    tasks = read_jdbc(spark, settings.jdbc_url, "task", settings.extra_for("jdbc")) if settings.jdbc_url else spark.read.parquet(f"{args.tables}/task.parquet")
    row = lookup(tasks, task_id=task_id).first()
    if row is None:
        raise LookupError(f"no task {task_id}")
    return TaskParam.from_json({k.lower(): v for k, v in row.asDict().items()}["task_param"])


def run(spark: SparkSession, argv: list[str] | None = None) -> int:
    """Run a job and store its results; returns the task's id."""
    from dataclasses import replace

    args = arguments(argv)
    settings = Settings()
    if args.settings:
        settings = Settings.from_properties("\n".join(r.value for r in spark.read.text(args.settings).collect()))
    settings = replace(settings, task_id=task_id_of(args, settings))
    p = task_param(spark, args, settings, settings.task_id)

    def table(name, schema):
        if settings.jdbc_url:
            sink = JdbcTable(spark, settings.jdbc_url, name, schema, settings.extra_for("jdbc"))
            sink.create(if_absent=True)
            return sink
        return ParquetTable(spark, f"{args.out}/{name}", schema)

    store(JOBS[args.job](Catalog(spark, args.tables), p, settings), table, settings.task_id)
    return settings.task_id


def main(argv: list[str] | None = None) -> None:
    spark = SparkSession.builder.appName("clickloom").getOrCreate()
    try:
        run(spark, argv)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
