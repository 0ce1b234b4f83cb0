"""Shared helpers: staged tables, gapless ranks, byte-level word splitting."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A-Z to a-z, every other byte unchanged.
LOWER_BYTES = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Lower-cases A-Z and turns every ASCII byte other than 0-9, a-z into a space,
#: so that ``bytes.split()`` yields the words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
ALNUM_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32
    for c in range(256)
)

_ours: list[tuple] = []  # (JVM, Hadoop's configuration, path): usable after the session has stopped


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where the setting is unset on one machine, as in tests, a folder under the warehouse is
    used; on a cluster that is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        sc = spark.sparkContext
        d = spark.conf.get("clickloom.shared.dir", None)
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        if not d:
            d = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_staged_{uuid.uuid4().hex[:8]}"
            spark.conf.set("clickloom.shared.dir", d)
            sc.setCheckpointDir(d)
            _mine(spark, d)
    return d.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it is deleted when the process ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _mine(spark, path)
    return path


def _mine(spark: SparkSession, path: str) -> None:
    _ours.append((spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), path))


def _remove(jvm, conf, path: str) -> None:
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).delete(p, True)


def delete(spark: SparkSession, path: str) -> None:
    _remove(spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), path)


@atexit.register
def _clean() -> None:
    for own in _ours:
        with contextlib.suppress(Exception):
            _remove(*own)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there,
    and a lost executor costs the tasks it ran, not the whole computation."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def drop(df: DataFrame) -> None:
    delete(df.sparkSession, df.staged_path)


def as_text(df: DataFrame, col: str) -> DataFrame:
    """``df`` with a NULL ``col`` read as the empty text."""
    return df.withColumn(col, F.coalesce(F.col(col).cast("string"), F.lit("")))


#: Bytes of an Arrow batch, where the session has Spark's own bound (64 MB): batches are held
#: by the executor's JVM and its Python workers at once.
BATCH_BYTES = "8m"


def small_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("67108864b", "64m", "64MB"):
        spark.conf.set(key, BATCH_BYTES)


def with_text(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns and the text as ``_text``, in Arrow batches of bounded size."""
    small_batches(docs.sparkSession)
    return docs.select(*keep, F.col(text).cast("string").alias("_text"))


def with_local_rank(df: DataFrame, keys: list[str], name: str, after=None) -> DataFrame:
    """Stage ``df`` with ``_pid`` (the task that wrote the row) and ``_lrank``, the
    row's place among rows with equal ``keys`` in that task, from 0.

    ``keys`` are whole numbers of few values a task; a task keeps one counter for
    each.  No shuffle.  ``after``: (function, schema) to be mapped over ``df``'s batches
    before, in the same Python worker.
    """
    import numpy as np

    source, own = after or (iter, df.schema)
    schema = T.StructType([*own.fields, T.StructField("_pid", T.IntegerType()), T.StructField("_lrank", T.LongType())])

    def rank(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        pid, seen = TaskContext.get().partitionId(), {}
        for b in source(batches):
            if not b.num_rows:
                continue
            k = np.zeros(b.num_rows, np.int64)
            for c in keys:
                k = k * 1_000_003 + b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
            order = np.argsort(k, kind="stable")
            s = k[order]
            first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
            n = np.diff(np.r_[first, len(s)])
            base = np.fromiter((seen.get(x, 0) for x in s[first].tolist()), np.int64, len(first))
            seen.update(zip(s[first].tolist(), (base + n).tolist(), strict=True))
            out = np.empty(len(s), np.int64)
            out[order] = np.arange(len(s)) - np.repeat(first, n) + np.repeat(base, n)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, pid, np.int32)), pa.array(out)], names=[*b.schema.names, "_pid", "_lrank"])

    return stage(df.mapInArrow(rank, schema), name)


def with_rank(ranked: DataFrame, keys: list[str], out: str) -> DataFrame:
    """The gapless rank from 0 among rows with equal ``keys``, over all tasks.

    ``ranked`` comes from :func:`with_local_rank`.  What is shuffled is one count
    for each task and key; the window of a key holds one row for each task.
    """
    from pyspark.sql import Window as W

    counts = ranked.groupBy("_pid", *keys).agg(F.max("_lrank").alias("_n"))
    before = W.partitionBy(*keys).orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    base = counts.select("_pid", *keys, F.coalesce(F.sum(F.col("_n") + 1).over(before), F.lit(0)).alias("_base"))
    return ranked.join(base, ["_pid", *keys]).withColumn(out, F.col("_base") + F.col("_lrank")).drop("_pid", "_lrank", "_base")


def text_chunks(batches, col: str, max_bytes: int = 2_000_000):
    """Slices of the Arrow batches with at most ``max_bytes`` of text each (one row at
    least), as (slice, list of bytes or None).  Bounds what a task holds at once."""
    import numpy as np
    import pyarrow as pa

    for b in batches:
        if not b.num_rows:
            continue
        v = b.column(b.schema.get_field_index(col)).cast(pa.large_binary())
        ends = np.frombuffer(v.buffers()[1], np.int64)[v.offset : v.offset + len(v) + 1]
        lo = 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + max_bytes, "right")) - 1)
            yield b.slice(lo, hi - lo), v.slice(lo, hi - lo).to_pylist()
            lo = hi
    pa.default_memory_pool().release_unused()  # the worker goes on to other tasks
    with contextlib.suppress(OSError, AttributeError):  # where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


class Numbering(dict):
    """Numbers words in the order they are first looked up, from 0."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def clean_labels(labels: DataFrame, col: str = "quality") -> DataFrame:
    """(doc_id, label): one row for each doc_id; NULLs and contradicting rows go."""
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(col).isNotNull())
        .groupBy("doc_id").agg(F.min(col).cast("int").alias("label"), F.max(col).cast("int").alias("_hi"))
        .where("label = _hi").drop("_hi")
    )


def smallest(df: DataFrame, h: str, n: int, *more: str) -> DataFrame:
    """The ``n`` rows of the smallest hash in long column ``h`` (ties by ``more``).

    Hashes are spread evenly, so a bound that about 4 n rows meet is set first: no task ranks
    more than these, however many rows there are."""
    total = df.count()
    if total > 16 * n:
        bound = -(1 << 63) + int((1 << 64) * (4 * n / total))
        few = df.where(F.col(h) <= bound)
        df = few if few.count() >= n else df
    return df.orderBy(h, *more).limit(n)


def apart(df: DataFrame, key: str, keys: DataFrame, most_bits: int = 26) -> tuple[DataFrame, DataFrame]:
    """``df`` in two parts: rows whose long ``key`` surely isn't in ``keys``, and the others, which
    an exact join is to tell apart.  So rows that have nothing to do with ``keys`` aren't moved.

    The test is a bitmap of about 16 bits a key, at most 2 ** ``most_bits`` (a table of 2 ** 20
    rows, which is broadcast); with more keys than it can tell apart, more rows are in doubt."""
    bits = min(most_bits, max(10, (16 * keys.count()).bit_length()))
    at = F.col(key).bitwiseAND(F.lit((1 << bits) - 1))
    word, bit = F.shiftright(at, 6).alias("_word"), at.bitwiseAND(F.lit(63)).cast("int").alias("_bit")
    marks = keys.select(word, bit).groupBy("_word").agg(F.expr("bit_or(shiftleft(1L, _bit))").alias("_marks"))
    met = df.select("*", word, bit).join(F.broadcast(marks), "_word", "left")
    hit = F.coalesce(F.expr("shiftright(_marks, _bit) & 1L") == 1, F.lit(False))
    return met.where(~hit).select(*df.columns), met.where(hit).select(*df.columns)
