"""Streams replayed file by file."""

from datetime import datetime, timedelta

from clickloom.streaming import ads as live

T0 = datetime(2024, 1, 1)


def put(spark, path, rows):
    data = [(T0 + timedelta(minutes=m), 0, p, c, u, a) for m, p, c, u, a in rows]
    spark.createDataFrame(data, live.LOG_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_blacklist_holds_from_the_next_batch(spark, tmp_path):
    path = f"{tmp_path}/log"
    put(spark, path, [(0, "p", "c", 1, 1), (1, "p", "c", 2, 1)])
    put(spark, path, [(2, "p", "c", 1, 1), (3, "p", "c", 1, 1), (4, "p", "c", 2, 2)])  # user 1 crosses 3 here
    put(spark, path, [(5, "p", "c", 1, 1), (6, "p", "c", 2, 2)])  # and vanishes here
    job = live.AdClickJob(spark, f"{tmp_path}/tables", threshold=3)
    job.run(live.file_log(spark, path), f"{tmp_path}/checkpoint")
    get = lambda n: sorted(map(tuple, job.tables[n].read().collect()))
    assert get("ad_blacklist") == [(1,)]
    assert get("ad_user_click_count") == [("2024-01-01", 1, 1, 3), ("2024-01-01", 2, 1, 1), ("2024-01-01", 2, 2, 2)]
    assert get("ad_stat") == [("2024-01-01", "p", "c", 1, 4), ("2024-01-01", "p", "c", 2, 2)]
    assert get("ad_province_top3") == [("2024-01-01", "p", 1, 4), ("2024-01-01", "p", 2, 2)]
    # a batch that is replayed changes nothing
    before = {n: get(n) for n in job.tables}
    job.batch(spark.read.schema(live.LOG_SCHEMA).parquet(path), 2)
    assert {n: get(n) for n in job.tables} == before


def test_late_rows_beyond_the_watermark_are_dropped(spark, tmp_path):
    from clickloom.sources.sinks import ParquetTable

    path = f"{tmp_path}/log"
    put(spark, path, [(300, "p", "c", 1, 1)])
    put(spark, path, [(301, "p", "c", 1, 1)])
    put(spark, path, [(302, "p", "c", 1, 1), (180, "p", "c", 1, 1)])  # two hours late
    t = ParquetTable(spark, f"{tmp_path}/t", "minute_ts TIMESTAMP, ad_id BIGINT, click_count BIGINT")
    live.start(live.trend_stream(live.file_log(spark, path)), live.into(t, "upsert_set", ("minute_ts", "ad_id")), f"{tmp_path}/cp").awaitTermination()
    assert sorted(r.minute_ts.hour * 60 + r.minute_ts.minute for r in t.read().collect()) == [300, 301, 302]


def test_mock_lines_stream(spark):
    from clickloom.operators import ads

    q = ads.parse_lines(live.mock_lines(spark, 50)).writeStream.format("memory").queryName("mock_log").start()
    try:
        for _ in range(60):
            q.awaitTermination(1)
            if spark.table("mock_log").count() >= 20:
                break
        got = spark.table("mock_log").collect()
    finally:
        q.stop()
    assert len(got) >= 20 and all(r.sound and r.province.startswith("province") and 0 <= r.user_id < 1000 and 0 <= r.ad_id < 10 for r in got)


def test_kafka_options():
    import pytest

    class Reader:
        def __init__(self):
            self.got = {}

        def format(self, name):
            self.got["format"] = name
            return self

        def options(self, **o):
            self.got |= o
            return self

        def load(self):
            raise LookupError(self.got)  # the source itself isn't on the class path

    class Session:
        readStream = Reader()  # noqa: N815

    with pytest.raises(LookupError) as e:
        live.kafka_lines(Session(), " a:9092,b:9092 ", "one, two,,", most=100)
    assert e.value.args[0] == {"format": "kafka", "kafka.bootstrap.servers": "a:9092,b:9092", "subscribe": "one,two", "startingOffsets": "earliest", "maxOffsetsPerTrigger": "100"}
    with pytest.raises(ValueError, match="must be given"):
        live.kafka_options("a:9092", " , ")


def test_a_batch_reads_the_days_that_it_touches(spark, tmp_path):
    import shutil

    job = live.AdClickJob(spark, f"{tmp_path}/tables", threshold=3)
    log = lambda day, n: spark.createDataFrame([(T0 + timedelta(days=day, minutes=m), 0, "p", "c", 1, 1) for m in range(n)], live.LOG_SCHEMA)
    job.batch(log(0, 2), 0)
    for name in ("ad_user_click_count", "ad_stat"):  # the first day's folders can't be read any more
        for p in (tmp_path / "tables" / name).glob("v*/_p=2024-01-01"):
            shutil.rmtree(p)
    job.batch(log(1, 2), 1)
    assert job.tables["ad_blacklist"].read().count() == 0
    job.batch(log(1, 1), 2)
    assert [r.user_id for r in job.tables["ad_blacklist"].read().collect()] == [1]


def test_the_trend_slides(spark, tmp_path):
    job = live.AdClickJob(spark, f"{tmp_path}/tables", minutes=60)
    for i, m in enumerate((0, 30, 59, 75, 300)):
        job.batch(spark.createDataFrame([(T0 + timedelta(minutes=m), 0, "p", "c", 1, 1)] * 2, live.LOG_SCHEMA), i)
        left = sorted(int(r.hour) * 60 + int(r.minute) for r in job.tables["ad_click_trend"].read().collect())
        assert left == [x for x in (0, 30, 59, 75, 300) if m - 60 < x <= m]
