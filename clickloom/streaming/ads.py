"""Real-time advertising clicks with Structured Streaming.

``AdClickJob`` handles each micro-batch in one ``foreachBatch``: the blacklist as it
stands filters the batch, the totals of (day, user, ad) grow, users over the threshold
join the blacklist - which holds from the next batch on - and the statistics follow.
Every table keeps the last batch id, so a batch that is replayed changes nothing.

A batch reads of the totals the days that it touches, and looks at its own keys there, so its
work doesn't grow with the history.  The trend slides: each batch keeps the last ``minutes``.

``stat_stream`` and ``trend_stream`` are the stateful forms without a blacklist; their
watermarks bound the state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ads
from ..sources.sinks import BY_DAY, TABLES, ParquetTable, recent, upsert_add

LOG_SCHEMA = "ts TIMESTAMP, epoch_ms BIGINT, province STRING, city STRING, user_id BIGINT, ad_id BIGINT"


def kafka_options(servers: str, topics: str, starting: str = "earliest", most: int | None = None) -> dict[str, str]:
    """Options of Spark's Kafka source; topics are comma-separated, blanks and empty names go."""
    names = ",".join(t.strip() for t in topics.split(",") if t.strip())
    if not servers.strip() or not names:
        raise ValueError("servers and topics must be given")
    out = {"kafka.bootstrap.servers": servers.strip(), "subscribe": names, "startingOffsets": starting}
    return out | ({} if most is None else {"maxOffsetsPerTrigger": str(most)})


def kafka_lines(spark: SparkSession, servers: str, topics: str, starting: str = "earliest", most: int | None = None) -> DataFrame:
    """Log lines of Kafka topics; needs the Kafka source on the class path."""
    raw = spark.readStream.format("kafka").options(**kafka_options(servers, topics, starting, most)).load()
    return raw.select(F.col("value").cast("string").alias("value"))


def file_log(spark: SparkSession, path: str, schema: str = LOG_SCHEMA, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def text_lines(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    return spark.readStream.option("maxFilesPerTrigger", files).text(path)


def mock_lines(spark: SparkSession, per_second: int = 1) -> DataFrame:
    """Synthetic log lines from the rate source: 5 provinces of 2 cities, 1000 users, 10 ads."""
    r = spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    h = lambda n, name: F.pmod(F.xxhash64("value", F.lit(name)), F.lit(n)).cast("string")
    return r.select(F.concat_ws(" ", F.unix_millis("timestamp").cast("string"), F.concat(F.lit("province"), h(5, "p")), F.concat(F.lit("city"), h(2, "c")), h(1000, "u"), h(10, "a")).alias("value"))


def start(stream: DataFrame, each, checkpoint: str, once: bool = True, seconds: int = 5, mode: str = "update"):
    """Run ``each(batch, id)`` on every micro-batch; the checkpoint lets a restarted job go on."""
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(each)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=f"{seconds} seconds")).start()


class AdClickJob:
    """All statistics of the click log, as tables under ``root``."""

    SCHEMAS = {
        "ad_user_click_count": "date STRING, user_id BIGINT, ad_id BIGINT, click_count BIGINT", "ad_blacklist": "user_id BIGINT",
        "ad_stat": "date STRING, province STRING, city STRING, ad_id BIGINT, click_count BIGINT",
        "ad_province_top3": "date STRING, province STRING, ad_id BIGINT, click_count BIGINT", "ad_click_trend": "date STRING, hour STRING, minute STRING, ad_id BIGINT, click_count BIGINT",
    }

    def __init__(self, spark: SparkSession, root: str, threshold: int = 100, top: int = 3, minutes: int = 60):
        self.spark, self.root, self.threshold, self.top = spark, root, threshold, top
        self.tables = {n: ParquetTable(spark, f"{root}/{n}", s, None if n == "ad_click_trend" else BY_DAY.get(n)) for n, s in self.SCHEMAS.items()}
        add = lambda old, new, keys: upsert_add(old, new, keys, "click_count")
        self.slide = recent(add, F.to_timestamp(F.concat_ws(" ", "date", "hour", "minute"), "yyyy-MM-dd HH mm"), minutes)

    def batch(self, log: DataFrame, batch_id: int) -> None:
        t = self.tables
        log = ads.drop_blacklisted(log, t["ad_blacklist"].read()).persist()
        try:
            put = lambda name, new, mode=None, keys=None: t[name].write(new, mode or TABLES[name][0], keys or TABLES[name][1], batch_id)
            put("ad_stat", ads.stat(log), "upsert_add")
            put("ad_click_trend", ads.trend_columns(ads.minute_clicks(log)), self.slide)
            days = [r.date for r in ads.with_day(log).select("date").distinct().collect()]  # of one batch
            put("ad_province_top3", ads.province_top(t["ad_stat"].read(days), self.top))
            mine = ads.user_clicks(log)
            put("ad_user_click_count", mine)
            totals = t["ad_user_click_count"].read(days).join(mine.select("date", "user_id", "ad_id"), ["date", "user_id", "ad_id"], "left_semi")
            # last: the filter above must find the blacklist as it was if the batch is replayed
            put("ad_blacklist", ads.blacklist_users(totals, self.threshold))
        finally:
            log.unpersist()

    def run(self, log: DataFrame, checkpoint: str, once: bool = True, seconds: int = 5):
        q = start(log, self.batch, checkpoint, once, seconds, "append")
        if once:
            q.awaitTermination()
        return q


def stat_stream(log: DataFrame, delay: str = "1 day") -> DataFrame:
    """Running totals of (day, province, city, ad); a day's state goes when the watermark passes it."""
    day = F.window("ts", "1 day")
    out = log.withWatermark("ts", delay).groupBy(day, "province", "city", "ad_id").agg(F.count("*").alias("click_count"))
    return out.select(F.date_format("window.start", ads.DAY).alias("date"), "province", "city", "ad_id", "click_count")


def user_click_stream(log: DataFrame, delay: str = "1 day") -> DataFrame:
    out = log.withWatermark("ts", delay).groupBy(F.window("ts", "1 day"), "user_id", "ad_id").agg(F.count("*").alias("click_count"))
    return out.select(F.date_format("window.start", ads.DAY).alias("date"), "user_id", "ad_id", "click_count")


def trend_stream(log: DataFrame, delay: str = "60 minutes") -> DataFrame:
    """Clicks of each minute and ad by event time; counts never shrink."""
    out = log.withWatermark("ts", delay).groupBy(F.window("ts", "1 minute"), "ad_id").agg(F.count("*").alias("click_count"))
    return out.select(F.col("window.start").alias("minute_ts"), "ad_id", "click_count")


def into(table: ParquetTable, mode: str, keys: tuple[str, ...] | None):
    """A ``foreachBatch`` function that merges into ``table``."""
    return lambda batch, batch_id: table.write(batch, mode, keys, batch_id)


def replay_files(log: DataFrame, path: str, files: int = 4) -> None:
    """Write the log as ``files`` Parquet files one after the other, in the order of time, for a
    file stream to replay."""
    lo, hi = log.agg(F.min("ts"), F.max("ts")).first()
    for i in range(files):
        a, b = lo + (hi - lo) * i / files, lo + (hi - lo) * (i + 1) / files
        part = log.where((F.col("ts") >= F.lit(a)) & ((F.col("ts") < F.lit(b)) | F.lit(i == files - 1)))
        part.coalesce(1).write.mode("append").parquet(path)
