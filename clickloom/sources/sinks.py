"""Sinks: append, insert-absent, upsert (add or set), replace-group, over Parquet or JDBC.

The merges are DataFrame functions of the table and the new rows.  ``ParquetTable``
keeps versions: readers see the last one that is complete, so a lost executor or driver
leaves the table as it was.  Streaming writers give their batch id, and a batch that is
already in is left out.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def append(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new)


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows whose key isn't there, one for each key (the least); NULL keys are equal."""
    rest = [c for c in new.columns if c not in keys]
    fresh = new.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in new.columns]) if rest else new.distinct()
    cond = None
    o = old.select(*[F.col(k).alias(f"_old_{k}") for k in keys])
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_old_{k}"))
        cond = c if cond is None else cond & c
    return old.unionByName(fresh.join(o, cond, "left_anti"))


def upsert_add(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Values of equal keys are added: one shuffle of partial sums."""
    kind = old.schema[value].dataType
    return old.unionByName(new).groupBy(*keys).agg(F.sum(value).cast(kind).alias(value)).select(*old.columns)


def upsert_set(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones of their key; of several new rows of a key the greatest stays."""
    rest = [c for c in old.columns if c not in keys]
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    best = both.groupBy(*keys).agg(F.max(F.struct("_new", *rest)).alias("r"))
    return best.select(*[F.col(c) if c in keys else F.col(f"r.{c}").alias(c) for c in old.columns])


def replace_group(old: DataFrame, new: DataFrame, group: list[str]) -> DataFrame:
    """All old rows of the groups that ``new`` has go."""
    return old.join(new.select(*group).distinct(), group, "left_anti").select(*old.columns).unionByName(new)


def recent(merge, moment, minutes: int):
    """``merge``, of whose rows those stay that are less than ``minutes`` older than the last one by
    ``moment`` (a timestamp column)."""

    def merged(old: DataFrame, new: DataFrame, *args) -> DataFrame:
        both = merge(old, new, *args).withColumn("_at", moment)
        last = both.agg(F.max("_at").alias("_last"))  # one row
        return both.join(F.broadcast(last), how="cross").where(F.col("_at") > F.col("_last") - F.expr(f"INTERVAL {int(minutes)} MINUTES")).select(*old.columns)

    return merged


MERGES = {"append": append, "insert_absent": insert_absent, "upsert_add": upsert_add, "upsert_set": upsert_set, "replace_group": replace_group}

#: Result tables: how a job's rows get in, and the key.
TABLES = {
    "session_aggr_stat": ("append", None), "session_random_extract": ("append", None), "session_detail": ("insert_absent", ("task_id", "user_id", "session_id", "page_id", "action_time")),
    "top10_category": ("append", None), "top10_session": ("append", None), "page_split_convert_rate": ("append", None), "area_top3_product": ("append", None),
    "ad_user_click_count": ("upsert_add", ("date", "user_id", "ad_id")), "ad_blacklist": ("insert_absent", ("user_id",)), "ad_stat": ("upsert_set", ("date", "province", "city", "ad_id")),
    "ad_province_top3": ("replace_group", ("date", "province")), "ad_click_trend": ("upsert_set", ("date", "hour", "minute", "ad_id")),
}
#: Tables that are kept by day, so that a batch rewrites the days that it touches.
BY_DAY = {n: "date" for n, (_, keys) in TABLES.items() if keys and keys[0] == "date"}


class ParquetTable:
    """A table of versions under ``path``.

    A write merges into the partitions (values of the string column ``partition``, such as
    days) that the new rows touch, writes these as a new version and then a manifest, which
    names the folder of each partition.  Readers see the last manifest; partitions that
    aren't touched are neither read nor written."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str, partition: str | None = None):
        self.spark, self.path, self.partition = spark, path.rstrip("/"), partition
        self.schema = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self) -> list[str]:
        p = self._path(self.path)
        return [s.getPath().getName() for s in self._fs.listStatus(p)] if self._fs.exists(p) else []

    def version(self) -> tuple[int, int]:
        """(number, batch id) of the last manifest; (0, -1) if there is none."""
        done = [tuple(int(x) for x in n[1:-5].split("_b")) for n in self._names() if n.startswith("m") and n.endswith(".json")]
        return max(done, default=(0, -1))

    def _manifest(self, version: tuple[int, int]) -> dict[str, str]:
        """Partition -> folder under ``path``."""
        if not version[0]:
            return {}
        stream = self._fs.open(self._path(f"{self.path}/m{version[0]}_b{version[1]}.json"))
        try:
            return json.loads(bytes(self.spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)))
        finally:
            stream.close()

    def _load(self, folders) -> DataFrame:
        paths = [f"{self.path}/{f}" for f in folders]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, partitions=None) -> DataFrame:
        """The table, or of it only the folders of some ``partitions``."""
        there = self._manifest(self.version())
        return self._load(there.values() if partitions is None else [there[p] for p in partitions if p in there])

    def write(self, new: DataFrame, mode="append", keys: tuple[str, ...] | None = None, batch: int | None = None, value: str = "click_count", keep: int = 2) -> bool:
        """Merge ``new`` into the next version; False if ``batch`` is in already.  ``mode``: a name of
        ``MERGES`` or a function of the old and the new rows.  The partitions that one write touches
        are listed on the driver; their values are plain words.  It is an error if another writer has
        published a version meanwhile; the table then is as that one has left it."""
        v, b = self.version()
        if batch is not None and batch <= b:
            return False
        new = new.select(*[F.col(f.name).cast(f.dataType) for f in self.schema])
        before = self._manifest((v, b))
        touched = [r[0] for r in new.select(self.partition).distinct().collect()] if self.partition else ["all"]
        if bad := [t for t in touched if not re.fullmatch(r"[\w-]+", t or "")]:
            raise ValueError(f"not a partition's name: {bad[0]!r}")
        own = self._claim(v + 1)
        args = [] if keys is None or mode == "append" else [list(keys)]
        merge = MERGES[mode] if isinstance(mode, str) else mode
        merged = merge(self._load(before[t] for t in touched if t in before), new, *args, *([value] if mode == "upsert_add" else []))
        merged.withColumn("_p", F.col(self.partition) if self.partition else F.lit("all")).write.mode("overwrite").partitionBy("_p").parquet(f"{self.path}/v{own}")
        there = self._fs.listStatus(self._path(f"{self.path}/v{own}"))
        now = before | {n[3:]: f"v{own}/{n}" for n in (s.getPath().getName() for s in there) if n.startswith("_p=")}
        if self.version() != (v, b):
            raise RuntimeError(f"{self.path}: another writer has published a version since {v}")
        self._publish(now, (own, b if batch is None else batch))
        self._forget(keep)
        return True

    def _claim(self, number: int) -> int:
        """A version's number that no other writer has, whether that one publishes or fails."""
        self._fs.mkdirs(self._path(self.path))
        while not self._create(f"{self.path}/c{number}"):
            number += 1
        return number

    def _create(self, path: str) -> bool:
        from py4j.protocol import Py4JJavaError

        try:
            self._fs.create(self._path(path), False).close()
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception) or "already exists" in str(e.java_exception):
                return False
            raise
        return True

    def _publish(self, manifest: dict[str, str], version: tuple[int, int]) -> None:
        """The manifest appears at once: it is written aside and renamed."""
        aside, name = (self._path(f"{self.path}/{n}") for n in (f"_m{version[0]}", f"m{version[0]}_b{version[1]}.json"))
        out = self._fs.create(aside, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if self._fs.exists(name) or not self._fs.rename(aside, name):
            raise RuntimeError(f"{name} can't be published")

    def _forget(self, keep: int) -> None:
        """Drop all but the last ``keep`` manifests, and folders that none of these names."""
        manifests = sorted((tuple(int(x) for x in n[1:-5].split("_b")), n) for n in self._names() if n.startswith("m") and n.endswith(".json"))
        last = max((v[0] for v, _ in manifests[:-keep]), default=0)
        used = {f for v, _ in manifests if v[0] > last for f in self._manifest(v).values()}
        for v, n in manifests:
            if v[0] <= last:
                for f in set(self._manifest(v).values()) - used:
                    self._fs.delete(self._path(f"{self.path}/{f}"), True)
                self._fs.delete(self._path(f"{self.path}/{n}"), True)
                self._fs.delete(self._path(f"{self.path}/c{v[0]}"), True)


class JdbcTable:
    """The same merges over a JDBC table.  Appends go straight in; other merges are written to a
    table beside it, whose rows then replace the table's in one transaction of the database: a
    failure at any point leaves the table as it was."""

    def __init__(self, spark: SparkSession, url: str, name: str, schema: T.StructType | str, properties: dict[str, str] | None = None, batch_size: int = 1000, quoted: bool = True):
        """``quoted``: whether the columns were created with quoted names, as Spark does it."""
        self.spark, self.url, self.name, self.quoted = spark, url, name, quoted
        self.schema = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
        self.properties = {"batchsize": str(batch_size), **(properties or {})}

    def read(self) -> DataFrame:
        got = self.spark.read.jdbc(self.url, self.name, properties=self.properties)
        by = {c.lower(): c for c in got.columns}
        return got.select(*[F.col(by[f.name.lower()]).cast(f.dataType).alias(f.name) for f in self.schema])

    def create(self, if_absent: bool = False) -> None:
        """An empty table; with ``if_absent`` one that is there stays as it is."""
        self.spark.createDataFrame([], self.schema).write.jdbc(self.url, self.name, "append" if if_absent else "overwrite", self.properties)

    def write(self, new: DataFrame, mode: str = "append", keys: tuple[str, ...] | None = None, value: str = "click_count") -> None:
        new = new.select(*[F.col(f.name).cast(f.dataType) for f in self.schema])
        if mode == "append":
            new.write.jdbc(self.url, self.name, "append", self.properties)
            return
        args = [] if keys is None else [list(keys)]
        merged = MERGES[mode](self.read(), new, *args, *([value] if mode == "upsert_add" else []))
        beside = f"{self.name}_merged"
        merged.write.jdbc(self.url, beside, "overwrite", self.properties)
        names = ", ".join(f'"{f.name}"' for f in self.schema) if self.quoted else ", ".join(f.name for f in self.schema)
        self._at_once(f"DELETE FROM {self.name}", f"INSERT INTO {self.name} ({names}) SELECT {names} FROM {beside}")
        self._at_once(f"DROP TABLE {beside}")

    def _at_once(self, *statements: str) -> None:
        """Run the statements in one transaction."""
        jvm = self.spark.sparkContext._jvm
        own = jvm.java.util.Properties()
        for k, v in self.properties.items():
            own.setProperty(k, v)
        if "driver" in self.properties:
            jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(self.properties["driver"])
        c = jvm.java.sql.DriverManager.getConnection(self.url, own)
        try:
            c.setAutoCommit(False)
            s = c.createStatement()
            try:
                for x in statements:
                    s.executeUpdate(x)
                c.commit()
            except Exception:
                c.rollback()
                raise
            finally:
                s.close()
        finally:
            c.close()
