"""Skew handling by name.  Adaptive execution splits skewed join partitions by itself and
partial aggregation makes salting of sums needless; these are for when one asks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S


def broadcast_join(big: DataFrame, small: DataFrame, on: str, max_rows: int = 1_000_000) -> DataFrame:
    """Map-side join if ``small`` has at most ``max_rows`` rows (counted first), else Spark's choice."""
    return big.join(F.broadcast(small) if small.limit(max_rows + 1).count() <= max_rows else small, on)


def heavy_keys(df: DataFrame, key: str, n: int = 1, fraction: float | None = None, seed: int = 9) -> DataFrame:
    """The ``n`` most frequent keys (of a Bernoulli sample, if ``fraction`` is given), ties by key."""
    df = df if fraction is None else df.sample(False, fraction, seed)
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(n)


def salted_join(big: DataFrame, small: DataFrame, on: str, n: int = 10) -> DataFrame:
    """Equi join with ``n`` salts: the rows of a key go to ``n`` tasks, ``small`` is expanded n times.
    Both are shuffled and sorted: Spark's estimate of a size leaves the expansion out, and it would broadcast it."""
    left = big.withColumn("_salt", S.salt(n, *big.columns))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return left.join(right.hint("merge"), [on, "_salt"]).drop("_salt")


def skew_split_join(big: DataFrame, small: DataFrame, on: str, keys: int = 1, n: int = 10, fraction: float | None = 0.1) -> DataFrame:
    """The most frequent keys are joined salted, the others plainly; the result is both."""
    hot = F.broadcast(heavy_keys(big, on, keys, fraction).select(on))  # ``keys`` rows
    some = salted_join(big.join(hot, on, "left_semi"), small.join(hot, on, "left_semi"), on, n)
    return some.unionByName(big.join(hot, on, "left_anti").join(small, on))


def salted_aggregate(df: DataFrame, keys: list[str], n: int = 10, out: str = "n") -> DataFrame:
    """Counts in two phases: of (key, salt), then their sums."""
    part = df.withColumn("_salt", S.salt(n, *df.columns)).groupBy(*keys, "_salt").agg(F.count("*").alias(out))
    return part.groupBy(*keys).agg(F.sum(out).alias(out))


def repartitioned(df: DataFrame, n: int, *keys: str) -> DataFrame:
    return df.repartition(n, *keys)
