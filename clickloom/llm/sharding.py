"""Sharding by vector bin packing.

A group is all rows of one text.  Its vector is (bytes, tokens, rows).  Groups are
placed largest first, each in the shard where the dot product of its vector with the
residual capacity is highest among the shards with room; a group of more than a shard's
share is first split into pieces by its rows' hashes.  ``law`` is ``bytes``: the shards'
sizes are near equal, and tokens and rows follow as well as they can.

The greedy rule needs of a group nothing but its vector.  So it runs on the histogram of
vectors, whose size is bounded: vectors are equal if their leading bits are, of which
as many count as ``CLASSES`` vectors allow (all of them, where groups are few).  Placing m
groups of one vector v takes the m highest values of all shards' series d, d - v.v,
d - 2 v.v ..., which is what m steps of the rule take.  Groups then find their shard by
their rank among groups of their vector; ranks come from per-task counts.  Where bits were
left out, ``LATE`` groups (of the least hashes) are placed last, each with its whole vector, after
the others' loads have been measured, which makes good what the bits had to say.

Nulls and empty texts are one group of size 8 a row.  Very long texts are measured whole.
Repeated rows get a slot each; groups of equal vectors (ties) take shards in the order
of their tasks.  An empty table gives no rows.  Extra columns are ignored; ``keep`` columns
named like a result column are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import smallest, stage, with_local_rank, with_rank

SHARDS = 24
PIECES = 64  # hash pieces of a split group, for each shard's share it has
CLASSES = 16_384  # different vectors at most
LATE = 4_096  # groups placed after all others, at most
BITS = (40, 12, 10, 8, 7, 6, 5, 4, 3, 2)  # leading bits of a number that may count
#: Weights of bytes, tokens and rows in the dot product: bytes are the law.
WEIGHTS = (8.0, 1.0, 1.0)


def spread(d, step: float, cap, m: int):
    """How many of the ``m`` highest values of the series d, d - step, d - 2 step ... (``cap``
    values each) come from each series, the first one where values are equal; and how many of m are left."""
    import numpy as np

    k = np.zeros(len(d), np.int64)
    while m > 0:
        free = k < cap
        if not free.any():
            break
        now = np.where(free, d - k * step, -np.inf)
        if m > 2 * len(d):
            high = np.sort(now[free])[::-1]
            level = (np.cumsum(high) - m * step) / np.arange(1, len(high) + 1)  # that the j highest series would sink to
            sunk = level[np.flatnonzero(level < high)[-1]]
            add = np.where(free, np.clip(np.floor((now - sunk) / step), 0, cap - k), 0).astype(np.int64)
            if add.any():
                k += add
                m -= int(add.sum())
                continue
        k[int(np.argmax(now))] += 1
        m -= 1
    return k, m


def place(vectors, times=None, shards: int = SHARDS, weights=WEIGHTS, loads=None):
    """[(vector, shard, first rank, number)]: ``times`` groups of each vector, largest first, each in
    the shard with room in bytes and the highest dot product with residual capacity, or where none has
    room in the one with most.  ``loads``: what the shards have already, as vectors."""
    import numpy as np

    v = np.asarray(vectors, float).reshape(-1, 3)
    times = np.ones(len(v), np.int64) if times is None else np.asarray(times, np.int64)
    loads = np.zeros((shards, 3)) if loads is None else np.asarray(loads, float)
    total = (v * times[:, None]).sum(0) + loads.sum(0)
    v = v / np.where(total > 0, total / shards, 1)  # a shard's capacity is 1 in each dimension
    w = np.asarray(weights, float)
    room, out = 1 - loads / np.where(total > 0, total / shards, 1), []
    for i in np.argsort(-(v * w).sum(1), kind="stable").tolist():
        x, m = v[i], int(times[i])
        step = float((x * w) @ x)
        k, left = spread((room * w) @ x, step, np.floor(np.maximum(room[:, 0], 0) / x[0] + 1e-9).astype(np.int64), m)
        if left:
            more, _ = spread(room[:, 0] - k * x[0], float(x[0]), np.full(shards, left, np.int64), left)
            k += more
        room -= k[:, None] * x
        first = 0
        for s in np.flatnonzero(k).tolist():
            out.append((i, s, first, int(k[s])))
            first += int(k[s])
    return out


def _leading(c: str, bits: int):
    """The number with all but its ``bits`` leading bits cleared."""
    cut = F.greatest(F.floor(F.log2(F.greatest(F.col(c), F.lit(1)).cast("double"))).cast("int") - F.lit(bits - 1), F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", F.col(c), cut), cut)


def vector_class(bits: int):
    return F.xxhash64(*(_leading(c, bits) for c in ("b", "t", "n")))


def classes(groups: DataFrame, most: int = CLASSES) -> tuple[int, list]:
    """(bits, rows (c, m, b, t, n)): the groups' different vectors by their leading bits, ``most`` at most."""
    near = groups.agg(*[F.approx_count_distinct(vector_class(b), 0.02).alias(str(b)) for b in BITS]).first()
    for bits in BITS:
        if near[str(bits)] <= 1.1 * most or bits == BITS[-1]:
            rows = _histogram(groups, bits, None if bits == BITS[-1] else most + 1)
            if bits == BITS[-1] or len(rows) <= most:
                return bits, rows
    raise AssertionError


def _histogram(groups: DataFrame, bits: int, most: int | None = None) -> list:
    found = groups.groupBy(vector_class(bits).alias("c")).agg(F.count("*").alias("m"), *[F.sum(x).alias(x) for x in ("b", "t", "n")])
    return sorted((found if most is None else found.limit(most)).collect(), key=lambda r: r.c)


def assign(docs: DataFrame, keep: list[str], shards: int = SHARDS, text: str = "text") -> DataFrame:
    """``keep`` columns, size, text_crc32, shard and slot (gapless in the shard)."""
    import numpy as np

    spark = docs.sparkSession
    keep = [c for c in keep if c not in ("size", "text_crc32", "shard", "slot")]
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = stage(
        docs.select(
            *keep, (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"),
            F.xxhash64(body).alias("_h"), F.regexp_count(body, F.lit(r"\S+")).cast("long").alias("_tokens"), F.xxhash64(F.monotonically_increasing_id()).alias("_r"),
        ), "rows")
    total = rows.agg(F.sum("size").alias("b"), F.count("*").alias("n")).first()
    if not total.n:
        return rows.select(*keep, "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    vector = [F.sum("size").alias("b"), F.sum("_tokens").alias("t"), F.count("*").alias("n")]
    groups = stage(rows.groupBy("_h").agg(*vector), "groups")
    share = F.greatest(F.ceil(F.col("b") * shards / F.lit(float(total.b))), F.ceil(F.col("n") * shards / F.lit(float(total.n))))
    hot = groups.where(share > 1).select("_h", (share * PIECES).cast("long").alias("_pieces")).collect()  # fewer than 2 * shards rows
    marks = F.broadcast(spark.createDataFrame(hot, "_h long, _pieces long"))
    split = rows.join(marks, "_h").withColumn("_piece", F.pmod("_r", "_pieces"))
    pieces = sorted(split.groupBy("_h", "_piece").agg(*vector).collect(), key=lambda r: (r._h, r._piece))  # 3 * shards * PIECES at most
    light = stage(groups.join(marks, "_h", "left_anti"), "light")
    bits, kinds = classes(light)
    late = []
    if bits != BITS[0]:
        late = sorted(smallest(light.withColumn("_x", F.xxhash64("_h")), "_x", LATE, "_h").collect(), key=lambda r: r._h)
        light = stage(light.join(F.broadcast(spark.createDataFrame([(r._h,) for r in late], "_h long")), "_h", "left_anti"), "light")
        kinds = _histogram(light, bits)
    vectors = [(r.b, r.t, r.n) for r in pieces] + [(r.b / r.m, r.t / r.m, r.n / r.m) for r in kinds]
    runs = place(vectors, [1] * len(pieces) + [r.m for r in kinds], shards)
    where = [(pieces[i]._h, pieces[i]._piece, s) for i, s, _, _ in runs if i < len(pieces)]
    plan = F.broadcast(spark.createDataFrame(where, "_h long, _piece long, shard int"))
    table = np.array(sorted((kinds[i - len(pieces)].c, first, s) for i, s, first, _ in runs if i >= len(pieces)), np.int64).reshape(-1, 3)
    sent = spark.sparkContext.broadcast(table)  # CLASSES * shards rows at most

    def find(batches):
        import pyarrow as pa

        table = sent.value
        ids, at = np.unique(table[:, 0], return_index=True)
        ends = np.append(at[1:], len(table))
        # one sorted key for (vector, rank): the vector's number, then the rank
        key = np.repeat(np.arange(len(ids)), ends - at) << 44 | table[:, 1]
        for b in batches:
            c, rank = (b.column(b.schema.get_field_index(x)).to_numpy(zero_copy_only=False) for x in ("_c", "_rank"))
            i = np.searchsorted(key, np.searchsorted(ids, c).astype(np.int64) << 44 | rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(x)) for x in ("_h", "b", "t", "n")), pa.array(table[i, 2].astype(np.int32))], names=["_h", "b", "t", "n", "shard"])

    ranked = with_local_rank(light.select("_h", "b", "t", "n", vector_class(bits).alias("_c")), ["_c"], "ranked")
    homes = with_rank(ranked, ["_c"], "_rank").mapInArrow(find, T.StructType([light.schema[c] for c in ("_h", "b", "t", "n")] + [T.StructField("shard", T.IntegerType())]))
    if late:
        homes = stage(homes, "homes")
        loads = np.zeros((shards, 3))
        for i, s, _, _ in runs:
            loads[s] += vectors[i] if i < len(pieces) else 0
        for r in homes.groupBy("shard").agg(*[F.sum(c).alias(c) for c in ("b", "t", "n")]).collect():  # a row a shard
            loads[r.shard] += (r.b, r.t, r.n)
        rest = [(late[i]._h, late[i].b, late[i].t, late[i].n, s) for i, s, _, _ in place([(r.b, r.t, r.n) for r in late], None, shards, loads=loads)]
        homes = homes.unionByName(spark.createDataFrame(rest, homes.schema))
    homes = homes.select("_h", "shard")
    columns = [*keep, "size", "text_crc32", "shard"]
    whole = rows.join(marks, "_h", "left_anti").join(homes, "_h").select(*columns)
    apart = split.join(plan, ["_h", "_piece"]).select(*columns)
    last = with_local_rank(whole.unionByName(apart), ["shard"], "placed")
    return with_rank(last, ["shard"], "slot").select(*keep, "size", "text_crc32", "shard", "slot")
