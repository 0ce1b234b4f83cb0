"""Logical tables of the engine over the star-schema Parquet files.

Every function returns a lazy DataFrame; filters and projections of callers reach
the Parquet scan.  ``Catalog`` gives them by name, from files, from registered
tables (for instance of a Hive metastore) or from a JDBC source.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AREAS = {"AFRICA": "North", "EUROPE": "East", "AMERICA": "Middle", "ASIA": "North West", "MIDDLE EAST": "South West"}
DAY_SPAN = (30, 15, 7, 3, 1)  # days of a session, by user_id % 5
SECONDS = (4, 8, 12, 40, 90, 240, 900, 2400, 3599)  # seconds of a session, by user_id % 9


def _pick(values, by: str) -> str:
    return "CASE " + " ".join(f"WHEN {by} = {i} THEN {v}" for i, v in enumerate(values)) + " END"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def user_visit_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions of users in sessions, from ``events``; event_id breaks ties of time."""
    e = table(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type", F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        F.expr("cast(datediff(cast(ts as date), date'2024-01-01') as bigint)").alias("day_no"),
        F.expr(_pick(DAY_SPAN, "user_id % 5")).cast("bigint").alias("bd"), F.expr(_pick(SECONDS, "user_id % 9")).cast("bigint").alias("span"),
    )
    e = e.withColumn("sn", F.expr("day_no div bd"))
    e = e.withColumn("sec", F.expr("1704067200 + sn * bd * 86400 + ((user_id + sn) % 23) * 3600 + (event_id * 37) % span"))
    at = F.timestamp_seconds("sec")
    kind = F.col("event_type")
    return e.select(
        F.date_format(at, "yyyy-MM-dd").alias("date"), "user_id", F.concat(F.lit("s"), "user_id", F.lit("_"), "sn").alias("session_id"),
        (F.col("k") % 10).alias("page_id"), F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("action_time"),
        F.when(kind == "view", F.concat(F.lit("kw"), (F.col("k") % 10).cast("string"))).alias("search_keyword"),
        F.when(kind == "click", F.col("k") % 20).alias("click_category_id"), F.when(kind == "click", F.col("k") % 100).alias("click_product_id"),
        F.when(kind == "signup", F.expr("concat(k % 20, ',', (k * 7 + 3) % 20)")).alias("order_category_ids"),
        F.when(kind == "signup", F.expr("concat(k % 100, ',', (k * 7 + 3) % 100)")).alias("order_product_ids"),
        F.when(kind == "purchase", F.expr("cast(k % 20 as string)")).alias("pay_category_ids"),
        F.when(kind == "purchase", F.expr("cast(k % 100 as string)")).alias("pay_product_ids"),
        (F.col("user_id") % 25).alias("city_id"), "event_id",
    )


def user_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_name").alias("username"), F.col("c_name").alias("name"), (F.col("c_custkey") % 60).cast("int").alias("age"),
        F.col("c_mktsegment").alias("professional"), F.concat(F.lit("city"), F.col("c_nationkey").cast("string")).alias("city"),
        F.when(F.col("c_custkey") % 2 == 0, "male").otherwise("female").alias("sex"),
    )


def product_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_name"),
        F.concat(F.lit('{"product_status": '), (F.col("p_size") % 2).cast("string"), F.lit("}")).alias("extend_info"),
    )


def city_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    area = F.create_map(*[F.lit(x) for pair in AREAS.items() for x in pair])[F.col("r_name")]
    return n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").cast("bigint").alias("city_id"), F.col("n_name").alias("city_name"), area.alias("area"))


def ad_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Advertising clicks with structured places, so that names may hold any character."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    city = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").cast("bigint").alias("city_id"), F.col("n_name").alias("city"), F.col("r_name").alias("province"))
    e = table(spark, sf_dir, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), "user_id", (F.get_json_object("props", "$.k").cast("bigint") % 10).alias("ad_id"), (F.col("user_id") % 25).alias("city_id")
    )
    return e.join(city, "city_id").select("ts", F.unix_millis("ts").alias("epoch_ms"), "province", "city", "user_id", "ad_id")


def ad_log_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as lines ``epochMillis province city user ad``; names lose spaces and underscores."""
    name = lambda c: F.regexp_replace(c, "[ _]", "-")
    return ad_log(spark, sf_dir).select(F.concat_ws(" ", F.col("epoch_ms").cast("string"), name("province"), name("city"), F.col("user_id").cast("string"), F.col("ad_id").cast("string")).alias("value"))


TABLES = {f.__name__: f for f in (user_visit_action, user_info, product_info, city_info, ad_log, ad_log_line)}


@dataclass(frozen=True)
class Catalog:
    """Tables by name.  ``overrides`` maps a name to a registered table or view."""

    spark: SparkSession
    sf_dir: str
    overrides: tuple[tuple[str, str], ...] = ()

    def __call__(self, name: str) -> DataFrame:
        own = dict(self.overrides)
        return self.spark.table(own[name]) if name in own else TABLES[name](self.spark, self.sf_dir)

    def register(self) -> None:
        """Temporary views of all tables, for SQL."""
        for name in TABLES:
            self(name).createOrReplaceTempView(name)


def scan_actions(actions: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Actions of the dates from ``start`` to ``end``, both included; a missing bound is open."""
    out = actions if start is None else actions.where(F.col("date") >= start)
    return out if end is None else out.where(F.col("date") <= end)


def scan_clicks(actions: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """(city_id, product_id) of clicked products."""
    return scan_actions(actions, start, end).where("click_product_id IS NOT NULL").select("city_id", F.col("click_product_id").alias("product_id"))


def read_jdbc(spark: SparkSession, url: str, name: str, properties: dict[str, str] | None = None, fetch_size: int = 1000, column: str | None = None, bounds: tuple[int, int] = (0, 0), partitions: int = 1) -> DataFrame:
    """A table of a database, over one connection, or with ``column`` (whole numbers, mostly within
    ``bounds``) over ``partitions`` at once."""
    own = {"fetchsize": str(fetch_size), **(properties or {})}
    if column is None:
        return spark.read.jdbc(url, name, properties=own)
    return spark.read.jdbc(url, name, column, *bounds, partitions, properties=own)


def lookup(table: DataFrame, **keys) -> DataFrame:
    """The rows with these values: filters that the database evaluates, so that only these rows come."""
    by = {c.lower(): c for c in table.columns}
    for k, v in keys.items():
        table = table.where(F.col(by[k.lower()]).isNull() if v is None else F.col(by[k.lower()]) == F.lit(v))
    return table


def click_count(table: DataFrame, date: str, user_id: int, ad_id: int) -> int:
    """Clicks of a user on an ad on a day, by point lookup in ``ad_user_click_count``; 0 if there is no row."""
    row = lookup(table, date=date, user_id=user_id, ad_id=ad_id).first()
    return 0 if row is None else int({k.lower(): v for k, v in row.asDict().items()}["click_count"])


def blacklisted(table: DataFrame, user_id: int) -> bool:
    return lookup(table, user_id=user_id).head(1) != []


def hive_session(name: str = "clickloom", **conf: str) -> SparkSession:
    """A session whose registered tables are those of a Hive metastore (embedded, where none is
    configured); ``Catalog`` then reads them by its ``overrides``."""
    b = SparkSession.builder.appName(name).enableHiveSupport()
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def mock_actions(spark: SparkSession, users: int = 100, sessions: int = 10, seed: int = 1, steps: int = 100) -> DataFrame:
    """Synthetic actions, the same for a seed: a session's length (up to ``steps``) and each value come from hashes."""
    rnd = lambda n, *c: F.pmod(F.xxhash64(F.lit(seed), *c), F.lit(n))
    s = spark.range(users * sessions).select((F.col("id") % users).alias("user_id"), F.concat(F.lit("m"), "id").alias("session_id"), F.explode(F.sequence(F.lit(0), rnd(steps, "id", F.lit("n")))).alias("step"))
    key = ("session_id", "step")
    kind = rnd(4, *key, F.lit("kind"))
    one = lambda k, n, name: F.when(kind == k, rnd(n, *key, F.lit(name)))
    two = lambda k, n, name: F.when(kind == k, F.concat_ws(",", rnd(n, *key, F.lit(name)).cast("string"), rnd(n, *key, F.lit(name + "2")).cast("string")))
    return s.select(
        F.lit("2024-01-01").alias("date"), "user_id", "session_id", rnd(10, *key, F.lit("page")).alias("page_id"),
        F.concat(F.lit("2024-01-01 "), rnd(23, "session_id", F.lit("h")).cast("string"), F.date_format(F.timestamp_seconds(rnd(3600, *key, F.lit("t"))), ":mm:ss")).alias("action_time"),
        F.when(kind == 0, F.concat(F.lit("word"), rnd(10, *key, F.lit("kw")).cast("string"))).alias("search_keyword"),
        one(1, 100, "cat").alias("click_category_id"), one(1, 100, "prod").alias("click_product_id"), two(2, 100, "oc").alias("order_category_ids"), two(2, 100, "op").alias("order_product_ids"),
        two(3, 100, "pc").alias("pay_category_ids"), two(3, 100, "pp").alias("pay_product_ids"), rnd(10, "session_id", F.lit("city")).alias("city_id"), F.xxhash64(*key).alias("event_id"),
    )


def mock_users(spark: SparkSession, users: int = 100, seed: int = 1) -> DataFrame:
    rnd = lambda n, name: F.pmod(F.xxhash64(F.lit(seed), "id", F.lit(name)), F.lit(n))
    return spark.range(users).select(
        F.col("id").alias("user_id"), F.concat(F.lit("user"), "id").alias("username"), F.concat(F.lit("name"), "id").alias("name"), rnd(60, "age").cast("int").alias("age"),
        F.concat(F.lit("professional"), rnd(16, "job")).alias("professional"), F.concat(F.lit("city"), rnd(100, "city")).alias("city"), F.when(rnd(2, "sex") == 0, "male").otherwise("female").alias("sex"),
    )


def mock_products(spark: SparkSession, products: int = 100, seed: int = 1) -> DataFrame:
    status = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(2))
    return spark.range(products).select(F.col("id").alias("product_id"), F.concat(F.lit("product"), "id").alias("product_name"), F.concat(F.lit('{"product_status": '), status, F.lit("}")).alias("extend_info"))
