"""The registered queries of the engine's operators and their SQL for another engine."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalar as S
from .operators import ads, category, funnel, product, session, skew
from .plans import jobs
from .plans.params import Settings, TaskParam
from .sources import catalog as C
from .sources.sinks import BY_DAY, TABLES, ParquetTable
from .sources.staging import new_folder

FLOW = (3, 5, 2, 4, 6)
DATES = ("2024-01-05", "2024-01-20")
THRESHOLD = 3
EXTRACT = 1000
ALL = TaskParam(start_age=10, end_age=50, sex="male", professionals=("BUILDING", "MACHINERY", "AUTOMOBILE"), keywords=("kw1", "kw2", "kw3"), category_ids=(1, 2, 3, 4, 5))
FILTERS = {
    "age": TaskParam(start_age=10, end_age=50), "prof": TaskParam(professionals=("BUILDING", "MACHINERY")), "city": TaskParam(cities=("city1", "city2", "city3", "city7")),
    "sex": TaskParam(sex="male"), "keyword": TaskParam(keywords=("kw1", "kw2")), "category": TaskParam(category_ids=(3, 7)), "all": ALL,
}

Q: dict = {}


def q(f):
    Q[f.__name__] = f
    return f


def acts(spark, d):
    return C.user_visit_action(spark, d)


def full_sessions(spark, d):
    return session.with_users(session.aggregate(acts(spark, d)), C.user_info(spark, d))


def some_sessions(spark, d):
    return session.filtered(full_sessions(spark, d), TaskParam(start_age=10, end_age=50, sex="male"))


@q
def scan_actions_by_date(spark, d):
    return C.scan_actions(acts(spark, d), *DATES)


@q
def scan_click_products(spark, d):
    return C.scan_clicks(acts(spark, d), *DATES)


@q
def scan_user_info(spark, d):
    return C.user_info(spark, d)


@q
def scan_product_info(spark, d):
    return C.product_info(spark, d)


@q
def city_info(spark, d):
    return C.city_info(spark, d)


@q
def session_aggregate(spark, d):
    return session.aggregate(acts(spark, d))


@q
def session_full_info(spark, d):
    return full_sessions(spark, d)


def _filter(name, spark, d):
    return session.filtered(full_sessions(spark, d), FILTERS[name])


for _n in FILTERS:
    Q[f"session_filter_{_n}"] = partial(_filter, _n)


@q
def session_bucket_counts(spark, d):
    return session.bucket_counts(some_sessions(spark, d))


@q
def session_aggr_stat(spark, d):
    return session.aggr_stat(some_sessions(spark, d))


@q
def session_detail(spark, d):
    return session.detail(acts(spark, d), some_sessions(spark, d))


@q
def hour_session_count(spark, d):
    return session.hour_counts(full_sessions(spark, d))


@q
def hour_quota(spark, d):
    return session.hour_quota(full_sessions(spark, d), EXTRACT)


@q
def random_extract(spark, d):
    return session.random_extract(full_sessions(spark, d), EXTRACT)


@q
def random_extract_detail(spark, d):
    return session.detail(acts(spark, d), random_extract(spark, d))


@q
def category_universe(spark, d):
    return category.universe(acts(spark, d))


@q
def category_clicks(spark, d):
    return category.clicks(acts(spark, d))


@q
def category_orders(spark, d):
    return category.orders(acts(spark, d))


@q
def category_pays(spark, d):
    return category.pays(acts(spark, d))


@q
def category_counts(spark, d):
    return category.counts(acts(spark, d))


@q
def top10_category(spark, d):
    return category.top(category.counts(acts(spark, d)))


@q
def session_category_clicks(spark, d):
    return category.session_clicks(acts(spark, d))


@q
def top10_session(spark, d):
    return category.top_sessions(acts(spark, d), top10_category(spark, d))


@q
def top10_session_detail(spark, d):
    return session.detail(acts(spark, d), top10_session(spark, d))


@q
def page_pairs(spark, d):
    return funnel.page_pairs(acts(spark, d))


@q
def page_split_pv(spark, d):
    return funnel.split_pv(acts(spark, d), FLOW)


@q
def page_start_pv(spark, d):
    return funnel.start_pv(acts(spark, d), FLOW)


@q
def page_convert_rate(spark, d):
    return funnel.convert_rate(acts(spark, d), FLOW)


@q
def page_convert_packed(spark, d):
    return funnel.packed(page_convert_rate(spark, d))


def clicks(spark, d):
    return C.scan_clicks(acts(spark, d))


@q
def click_product_basic(spark, d):
    return product.click_product_basic(clicks(spark, d), C.city_info(spark, d))


@q
def area_product_clicks(spark, d):
    return product.area_product_clicks(click_product_basic(spark, d))


@q
def area_product_full(spark, d):
    return product.area_product_full(area_product_clicks(spark, d), C.product_info(spark, d))


@q
def area_top3_product(spark, d):
    return product.top_products(area_product_full(spark, d))


@q
def fn_strings(spark, d):
    s = F.concat(F.lit(",a="), F.col("c_custkey").cast("string"), F.lit("|b="), F.col("c_mktsegment"), F.lit("|c=|a=9,"))
    return C.table(spark, d, "customer").select(
        "c_custkey", S.is_blank(F.when(F.col("c_custkey") % 3 == 0, "null").otherwise(F.col("c_name"))).alias("blank"), S.trim_comma(s).alias("trimmed"),
        S.pad_two((F.col("c_custkey") % 120).cast("string")).alias("padded"), F.size(S.split_items(s, "|")).cast("bigint").alias("parts"),
        S.get_field(S.trim_comma(s), "b").alias("got"), S.get_field(S.trim_comma(s), "c").alias("none"), S.set_field(S.trim_comma(s), "a", "7").alias("changed"),
    )


@q
def fn_dates(spark, d):
    e = C.table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    a, b = S.format_time("ts"), S.format_time(F.expr("ts + make_interval(0, 0, 0, 0, cast(event_id % 5 - 2 as int))"))
    return e.select(
        "event_id", S.before(a, b).alias("is_before"), S.after(a, b).alias("is_after"), S.minus_seconds(a, b).alias("seconds"), S.minus_seconds(a, F.lit("bad")).alias("bad"),
        S.date_hour(a).alias("date_hour"), S.format_date("ts").alias("d"), S.date_key("ts").alias("k"), S.format_date(S.parse_date_key(S.date_key("ts"))).alias("parsed"), S.minute_key("ts").alias("m"),
    )


@q
def fn_round(spark, d):
    n, m = F.col("c_custkey") % 211, F.col("c_custkey") % 200 + 1
    return C.table(spark, d, "customer").select("c_custkey", S.ratio2(n, m).alias("r"), S.ratio2(n, F.lit(0)).alias("none"), S.ratio2_binary(F.col("c_custkey") % 741, F.element_at(F.array(F.lit(8), F.lit(40), F.lit(200)), (F.col("c_custkey") % 3 + 1).cast("int"))).alias("strict"))


@q
def fn_udfs(spark, d):
    S.register(spark)
    p = C.product_info(spark, d).withColumn("pair", S.concat_long_string("product_id", "product_name"))
    return p.select(
        "product_id", "pair", S.json_field("extend_info", "product_status").alias("status"), S.without_prefix(S.with_prefix("pair", F.lit(4))).alias("unsalted"),
        S.area_of("pair").alias("area"), S.product_of("pair").alias("pid"), F.expr("long_to_string(product_id)").alias("as_text"), F.expr("string_to_long(long_to_string(product_id))").alias("as_long"),
        F.expr("concat_long_string(product_id, product_name, ':')").alias("sql_pair"), F.expr("remove_random_prefix(random_prefix(pair, 10))").alias("sql_unsalted"),
        F.expr("json_text_field(extend_info, 'product_status')").alias("sql_status"), F.expr("get_area(pair)").alias("sql_area"), F.expr("get_product_id(pair)").alias("sql_pid"),
    )


def _with_user(spark, d, how):
    a = acts(spark, d).select("user_id", "session_id", "event_id")
    u = C.user_info(spark, d).select("user_id", "age", "sex")
    return how(a, u, "user_id").select("user_id", "session_id", "event_id", "age", "sex")


Q["broadcast_join"] = partial(_with_user, how=skew.broadcast_join)
Q["skew_split_join"] = partial(_with_user, how=skew.skew_split_join)
Q["salted_join"] = partial(_with_user, how=skew.salted_join)


@q
def salted_agg(spark, d):
    return skew.salted_aggregate(acts(spark, d).where("click_category_id IS NOT NULL"), ["click_category_id"]).select(F.col("click_category_id").alias("category_id"), F.col("n").alias("click_count"))


@q
def heavy_key(spark, d):
    return skew.heavy_keys(acts(spark, d), "user_id", 1)


@q
def repartitioned(spark, d):
    return skew.repartitioned(acts(spark, d), 8, "session_id").groupBy("session_id").agg(F.count("*").alias("n"))


@q
def ad_log_parsed(spark, d):
    return ads.parse_lines(C.ad_log_line(spark, d)).select(F.unix_millis("ts").alias("epoch_ms"), "province", "city", "user_id", "ad_id", "sound")


def blacklist(log):
    return ads.blacklist_users(ads.user_clicks(log), THRESHOLD)


@q
def ad_user_clicks(spark, d):
    return ads.user_clicks(C.ad_log(spark, d))


@q
def ad_blacklist_users(spark, d):
    return blacklist(C.ad_log(spark, d))


@q
def ad_blacklist_filter(spark, d):
    log = C.ad_log(spark, d)
    return ads.drop_blacklisted(log, blacklist(log)).select("epoch_ms", "province", "city", "user_id", "ad_id")


@q
def ad_stat(spark, d):
    return ads.stat(C.ad_log(spark, d))


@q
def ad_province_top3(spark, d):
    return ads.province_top(ads.stat(C.ad_log(spark, d)))


@q
def ad_click_trend(spark, d):
    return ads.trend(C.ad_log(spark, d))


@q
def bernoulli_sample(spark, d):
    """What holds of a sample: its rows are rows of the table, each once, it has the share that was asked
    for (to six standard deviations) and it is the same again for a seed."""
    every = acts(spark, d).select("event_id")
    some, again = every.sample(False, 0.1, 9), every.sample(False, 0.1, 9)
    n = some.agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("k"), F.sum(F.xxhash64("event_id").cast("decimal(38,0)")).alias("h"))
    m = again.agg(F.sum(F.xxhash64("event_id").cast("decimal(38,0)")).alias("h2"))
    strange = some.join(every, "event_id", "left_anti").agg(F.count("*").alias("strange"))
    whole = every.agg(F.count("*").alias("whole"))
    one = n.crossJoin(m).crossJoin(strange).crossJoin(whole)  # of one row each
    near = F.abs(F.col("n") - 0.1 * F.col("whole")) <= 6 * F.sqrt(0.09 * F.col("whole"))
    return one.select((F.col("strange") == 0).alias("is_part"), (F.col("n") == F.col("k")).alias("each_once"), near.alias("share_holds"), (F.col("h") == F.col("h2")).alias("repeatable"))


@q
def preview(spark, d):
    return acts(spark, d).orderBy("event_id").limit(5)


# ---- jobs


def _job(job, output, p, spark, d):
    return job(C.Catalog(spark, d), p, Settings(extract_count=EXTRACT))[output]


J1 = TaskParam(start_date=DATES[0], end_date=DATES[1], start_age=10, end_age=50)
for _n in ("session_aggr_stat", "session_random_extract", "session_detail", "top10_category", "top10_session"):
    Q[f"job_{_n}"] = partial(_job, jobs.session_job, _n, J1)
Q["job_page_split_convert_rate"] = partial(_job, jobs.page_job, "page_split_convert_rate", TaskParam(DATES[0], DATES[1], target_page_flow=FLOW))
Q["job_area_top3_product"] = partial(_job, jobs.product_job, "area_top3_product", TaskParam(DATES[0], DATES[1]))


# ---- streaming twins


def _replay(spark, d):
    from .streaming import ads as live

    root = new_folder(spark, "stream")
    live.replay_files(C.ad_log(spark, d), f"{root}/log")
    return live, root, live.file_log(spark, f"{root}/log")


def _streamed(spark, d, make, schema, keys):
    live, root, log = _replay(spark, d)
    t = ParquetTable(spark, f"{root}/table", schema, "date" if keys[0] == "date" else None)
    live.start(make(live, log), live.into(t, "upsert_set", keys), f"{root}/checkpoint").awaitTermination()
    return t.read()


@q
def stream_ad_log_parsed(spark, d):
    from .streaming import ads as live

    root = new_folder(spark, "lines")
    C.ad_log_line(spark, d).write.text(f"{root}/lines")
    stream = ads.parse_lines(live.text_lines(spark, f"{root}/lines"))
    w = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True)
    w.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out").select(F.unix_millis("ts").alias("epoch_ms"), "province", "city", "user_id", "ad_id", "sound")


@q
def stream_ad_user_clicks(spark, d):
    return _streamed(spark, d, lambda live, log: live.user_click_stream(log), "date STRING, user_id BIGINT, ad_id BIGINT, click_count BIGINT", ("date", "user_id", "ad_id"))


@q
def stream_ad_stat(spark, d):
    return _streamed(spark, d, lambda live, log: live.stat_stream(log), "date STRING, province STRING, city STRING, ad_id BIGINT, click_count BIGINT", TABLES["ad_stat"][1])


@q
def stream_ad_click_trend(spark, d):
    t = _streamed(spark, d, lambda live, log: live.trend_stream(log), "minute_ts TIMESTAMP, ad_id BIGINT, click_count BIGINT", ("minute_ts", "ad_id"))
    last = t.agg(F.max("minute_ts").alias("last"))
    return ads.trend_columns(t.join(F.broadcast(last), how="cross").where("minute_ts > last - INTERVAL 60 MINUTES"))


def _ad_job(spark, d, threshold):
    live, root, log = _replay(spark, d)
    job = live.AdClickJob(spark, f"{root}/tables", threshold)
    job.run(log, f"{root}/checkpoint")
    return job.tables


@q
def stream_ad_blacklist_users(spark, d):
    return _ad_job(spark, d, THRESHOLD)["ad_blacklist"].read()


@q
def stream_ad_click_trend_window(spark, d):
    """The job's own table: each batch leaves the last 60 minutes."""
    return _ad_job(spark, d, 1_000_000)["ad_click_trend"].read()


@q
def stream_ad_province_top3(spark, d):
    return _ad_job(spark, d, 1_000_000)["ad_province_top3"].read()


# ---- sinks: half of the rows are in the table, the other half is merged


def _halves(df):
    return df.where(F.col("epoch_ms") % 2 == 0), df.where(F.col("epoch_ms") % 2 == 1)


def _sink(spark, d, name, make, mode=None):
    one, two = _halves(C.ad_log(spark, d))
    t = ParquetTable(spark, f"{new_folder(spark, 'sink')}/{name}", make(one).schema, BY_DAY.get(name))
    t.write(make(one), "append")
    t.write(make(two), mode or TABLES[name][0], TABLES[name][1], batch=7)
    t.write(make(two), mode or TABLES[name][0], TABLES[name][1], batch=7)  # a replay changes nothing
    return t.read()


def _stored(name, job, p, spark, d):
    """A job's output as its sink has it, after the job has been stored twice."""
    root = new_folder(spark, "job")
    for _ in range(2):
        jobs.store({name: job(C.Catalog(spark, d), p, Settings(extract_count=EXTRACT))[name]}, lambda n, schema: ParquetTable(spark, f"{root}/{n}", schema), 1)
    df = job(C.Catalog(spark, d), p, Settings(extract_count=EXTRACT))[name]
    return ParquetTable(spark, f"{root}/{name}", jobs.with_task(df, 1).schema).read()


for _n in ("session_aggr_stat", "session_random_extract", "session_detail", "top10_category", "top10_session"):
    Q[f"sink_{_n}"] = partial(_stored, _n, jobs.session_job, J1)
Q["sink_page_split_convert_rate"] = partial(_stored, "page_split_convert_rate", jobs.page_job, TaskParam(DATES[0], DATES[1], target_page_flow=FLOW))
Q["sink_area_top3_product"] = partial(_stored, "area_top3_product", jobs.product_job, TaskParam(DATES[0], DATES[1]))


@q
def sink_append(spark, d):
    return _sink(spark, d, "ad_stat", ads.stat, "append")


@q
def sink_upsert_add(spark, d):
    return _sink(spark, d, "ad_user_click_count", ads.user_clicks)


@q
def sink_upsert_set(spark, d):
    return _sink(spark, d, "ad_stat", ads.stat)


@q
def sink_insert_absent(spark, d):
    return _sink(spark, d, "ad_blacklist", lambda log: log.select("user_id").distinct())


@q
def sink_replace_group(spark, d):
    return _sink(spark, d, "ad_province_top3", lambda log: ads.province_top(ads.stat(log)))


def queries() -> dict:
    return dict(Q)


# ---- the same in SQL

_pick = C._pick
VIEWS = {
    "act0": f"""SELECT event_id, user_id, event_type, k, day_no // bd AS sn,
  1704067200 + (day_no // bd) * bd * 86400 + ((user_id + day_no // bd) % 23) * 3600 + (event_id * 37) % span AS sec
  FROM (SELECT event_id, user_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS day_no,
    {_pick(C.DAY_SPAN, 'user_id % 5')} AS bd, {_pick(C.SECONDS, 'user_id % 9')} AS span FROM events)""",
    "user_visit_action": """SELECT strftime(make_timestamp(sec * 1000000), '%Y-%m-%d') AS date, user_id, 's' || user_id || '_' || sn AS session_id, k % 10 AS page_id,
  strftime(make_timestamp(sec * 1000000), '%Y-%m-%d %H:%M:%S') AS action_time, CASE WHEN event_type = 'view' THEN 'kw' || (k % 10) END AS search_keyword,
  CASE WHEN event_type = 'click' THEN k % 20 END AS click_category_id, CASE WHEN event_type = 'click' THEN k % 100 END AS click_product_id,
  CASE WHEN event_type = 'signup' THEN (k % 20) || ',' || ((k * 7 + 3) % 20) END AS order_category_ids, CASE WHEN event_type = 'signup' THEN (k % 100) || ',' || ((k * 7 + 3) % 100) END AS order_product_ids,
  CASE WHEN event_type = 'purchase' THEN '' || (k % 20) END AS pay_category_ids, CASE WHEN event_type = 'purchase' THEN '' || (k % 100) END AS pay_product_ids,
  user_id % 25 AS city_id, event_id FROM act0""",
    "user_info": """SELECT c_custkey AS user_id, c_name AS username, c_name AS name, CAST(c_custkey % 60 AS INTEGER) AS age, c_mktsegment AS professional, 'city' || c_nationkey AS city,
  CASE WHEN c_custkey % 2 = 0 THEN 'male' ELSE 'female' END AS sex FROM customer""",
    "product_info": """SELECT p_partkey AS product_id, p_name AS product_name, '{"product_status": ' || (p_size % 2) || '}' AS extend_info FROM part""",
    "cities": "SELECT CAST(n_nationkey AS BIGINT) AS city_id, n_name AS city_name, CASE r_name " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in C.AREAS.items()) + " END AS area FROM nation JOIN region ON n_regionkey = r_regionkey",
    "ad_log": """SELECT ts, epoch_us(ts) // 1000 AS epoch_ms, r_name AS province, n_name AS city, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS ad_id
  FROM events JOIN nation ON n_nationkey = user_id % 25 JOIN region ON n_regionkey = r_regionkey""",
    "ss": """SELECT session_id, min(user_id) AS user_id, coalesce(string_agg(DISTINCT search_keyword, ',' ORDER BY search_keyword), '') AS search_keywords,
  array_to_string(list_sort(coalesce(list(DISTINCT click_category_id) FILTER (click_category_id IS NOT NULL), [])), ',') AS click_category_ids, min(action_time) AS start_time,
  date_diff('second', strptime(min(action_time), '%Y-%m-%d %H:%M:%S'), strptime(max(action_time), '%Y-%m-%d %H:%M:%S')) AS visit_length, count(*) AS step_length FROM acts GROUP BY session_id""",
    "full_ss": "SELECT user_id, session_id, search_keywords, click_category_ids, start_time, visit_length, step_length, age, professional, city, sex FROM ss JOIN user_info USING (user_id)",
    "quota": """SELECT date, hour, session_count, least(session_count, CAST(floor(CAST(session_count AS DOUBLE) / sum(session_count) OVER (PARTITION BY date) * (1000 // (SELECT count(DISTINCT date) FROM hours))) AS BIGINT)) AS quota FROM hours""",
    "hours": "SELECT substr(start_time, 1, 10) AS date, substr(start_time, 12, 2) AS hour, count(*) AS session_count FROM chosen GROUP BY ALL",
    "extract": """SELECT CAST(1 AS BIGINT) AS task_id, session_id, start_time, search_keywords, click_category_ids FROM (
  SELECT c.*, quota, row_number() OVER (PARTITION BY date, hour ORDER BY md5(session_id || '42'), session_id) AS rn FROM chosen c JOIN quota ON date = substr(start_time, 1, 10) AND hour = substr(start_time, 12, 2)) WHERE rn <= quota""",
    "ids": """SELECT 'c' AS kind, click_category_id AS category_id FROM acts2 WHERE click_category_id IS NOT NULL
  UNION ALL SELECT 'o', CAST(unnest(string_split(order_category_ids, ',')) AS BIGINT) FROM acts2 UNION ALL SELECT 'p', CAST(unnest(string_split(pay_category_ids, ',')) AS BIGINT) FROM acts2""",
    "counts": "SELECT category_id, count(*) FILTER (kind = 'c') AS click_count, count(*) FILTER (kind = 'o') AS order_count, count(*) FILTER (kind = 'p') AS pay_count FROM ids GROUP BY 1",
    "best": "SELECT * FROM counts ORDER BY click_count DESC, order_count DESC, pay_count DESC, category_id LIMIT 10",
    "sc": "SELECT session_id, click_category_id AS category_id, count(*) AS click_count FROM acts2 WHERE click_category_id IS NOT NULL GROUP BY 1, 2",
    "most": "SELECT category_id, session_id, click_count, rn FROM (SELECT *, row_number() OVER (PARTITION BY category_id ORDER BY click_count DESC, session_id) AS rn FROM sc WHERE category_id IN (SELECT category_id FROM best)) WHERE rn <= 10",
    "pairs": """SELECT session_id, from_page, to_page, from_page || '_' || to_page AS split FROM (SELECT session_id, lag(page_id) OVER (PARTITION BY session_id ORDER BY action_time, event_id) AS from_page, page_id AS to_page FROM acts) WHERE from_page IS NOT NULL""",
    "flow": "SELECT * FROM (VALUES " + ", ".join(f"(CAST({i} AS BIGINT), '{a}_{b}')" for i, (a, b) in enumerate(zip(FLOW, FLOW[1:], strict=False), 1)) + ") AS t(pos, split)",
    "pv": f"SELECT pos, split, (SELECT count(*) FROM pairs WHERE pairs.split = flow.split) AS pv, (SELECT count(*) FROM acts WHERE page_id = {FLOW[0]}) AS start_pv FROM flow",
    "rates": "SELECT pos, split, pv, CASE WHEN b <> 0 THEN CAST((200 * pv + b) // (2 * b) AS DOUBLE) / 100 END AS rate FROM (SELECT *, coalesce(lag(pv) OVER (ORDER BY pos), start_pv) AS b FROM pv)",
    "basic": "SELECT city_id, city_name, area, click_product_id AS product_id FROM acts JOIN cities USING (city_id) WHERE click_product_id IS NOT NULL",
    "apc": "SELECT area, product_id, count(*) AS click_count, string_agg(DISTINCT city_id || ':' || city_name, ',' ORDER BY city_id || ':' || city_name) AS city_infos FROM basic GROUP BY 1, 2",
    "apf": "SELECT area, product_id, click_count, city_infos, product_name, CASE WHEN json_extract_string(extend_info, '$.product_status') = '0' THEN 'Self' ELSE 'Third Party' END AS product_status FROM apc JOIN product_info USING (product_id)",
    "top3": """SELECT CAST(1 AS BIGINT) AS task_id, area, CASE WHEN area IN ('North', 'East') THEN 'A' WHEN area IN ('South', 'Middle') THEN 'B' WHEN area IN ('North West', 'North East') THEN 'C' ELSE 'D' END AS area_level,
  product_id, city_infos, click_count, product_name, product_status FROM (SELECT *, row_number() OVER (PARTITION BY area ORDER BY click_count DESC, product_id) AS rn FROM apf) WHERE rn <= 3""",
    "uc": "SELECT strftime(ts, '%Y-%m-%d') AS date, user_id, ad_id, count(*) AS click_count FROM ad_log GROUP BY ALL",
    "black": f"SELECT DISTINCT user_id FROM uc WHERE click_count >= {THRESHOLD}",
    "st": "SELECT strftime(ts, '%Y-%m-%d') AS date, province, city, ad_id, count(*) AS click_count FROM ad_log GROUP BY ALL",
    "pt": "SELECT date, province, ad_id, click_count FROM (SELECT *, row_number() OVER (PARTITION BY date, province ORDER BY click_count DESC, ad_id) AS rn FROM (SELECT date, province, ad_id, CAST(sum(click_count) AS BIGINT) AS click_count FROM st GROUP BY ALL)) WHERE rn <= 3",
}
#: In the order in which one view may use another; acts and acts2 are the actions a query looks at, chosen its sessions.
ORDER = ("act0", "user_visit_action", "acts", "user_info", "product_info", "cities", "ad_log", "ss", "full_ss", "chosen", "hours", "quota", "extract", "acts2", "ids", "counts", "best", "sc", "most", "pairs", "flow", "pv", "rates", "basic", "apc", "apf", "top3", "uc", "black", "st", "pt")
COLUMNS = "date, user_id, session_id, page_id, action_time, search_keyword, click_category_id, click_product_id, order_category_ids, order_product_ids, pay_category_ids, pay_product_ids, city_id, event_id"


def sql(select: str, dates=None, where: str = "TRUE", detail: bool = False) -> str:
    """A query over the views; ``dates`` bound the actions, ``where`` chooses sessions, ``detail``
    makes category counts look at the chosen sessions only."""
    own = VIEWS | {
        "acts": "SELECT * FROM user_visit_action" + (f" WHERE date BETWEEN '{dates[0]}' AND '{dates[1]}'" if dates else ""),
        "chosen": f"SELECT * FROM full_ss WHERE {where}",
        "acts2": "SELECT * FROM acts" + (" WHERE session_id IN (SELECT session_id FROM chosen)" if detail else ""),
    }
    need, todo = set(), select
    import re

    words = lambda s: set(re.findall(r"\w+", s)) & set(ORDER)
    left = words(todo)
    while left:
        n = left.pop()
        if n not in need:
            need.add(n)
            left |= words(own[n]) - {n}
    return "WITH " + ",\n".join(f"{n} AS ({own[n]})" for n in ORDER if n in need) + f"\n{select}"


def where_of(p: TaskParam) -> str:
    quoted = lambda vs: ", ".join(f"'{v}'" for v in vs)
    out = []
    if p.start_age is not None and p.end_age is not None:
        out.append(f"age BETWEEN {p.start_age} AND {p.end_age}")
    if p.professionals:
        out.append(f"professional IN ({quoted(p.professionals)})")
    if p.cities:
        out.append(f"city IN ({quoted(p.cities)})")
    if p.sex:
        out.append(f"sex = '{p.sex}'")
    if p.keywords:
        out.append(f"list_has_any(string_split(search_keywords, ','), [{quoted(p.keywords)}])")
    if p.category_ids:
        out.append(f"list_has_any(string_split(click_category_ids, ','), [{quoted(p.category_ids)}])")
    return " AND ".join(out) or "TRUE"


def _buckets():
    for prefix, column, buckets in (("visit", "visit_length", session.VISIT), ("step", "step_length", session.STEP)):
        for name, lo, hi in buckets:
            yield f"{prefix}_{name}", f"{column} >= {lo}" + ("" if hi is None else f" AND {column} <= {hi}")


def _stat_sql() -> str:
    ratio = lambda c: f"CASE WHEN count(*) <> 0 THEN CAST((200 * count(*) FILTER ({c}) + count(*)) // (2 * count(*)) AS DOUBLE) / 100 END"
    return "SELECT CAST(1 AS BIGINT) AS task_id, count(*) AS session_count, " + ", ".join(f"{ratio(c)} AS \"{n}\"" for n, c in _buckets()) + " FROM chosen"


def oracle_sql() -> dict[str, str]:
    few = where_of(TaskParam(start_age=10, end_age=50, sex="male"))
    j1 = {"dates": DATES, "where": where_of(J1), "detail": True}
    joined = "SELECT a.user_id, session_id, event_id, age, sex FROM acts a JOIN user_info USING (user_id)"
    trend = "SELECT strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%H') AS hour, strftime(ts, '%M') AS minute, ad_id, count(*) AS click_count FROM ad_log WHERE {} GROUP BY ALL"
    parsed = "SELECT epoch_ms, regexp_replace(province, '[ _]', '-', 'g') AS province, regexp_replace(city, '[ _]', '-', 'g') AS city, user_id, ad_id, TRUE AS sound FROM ad_log"
    half = lambda i, v: f"SELECT * FROM ({v.replace('FROM ad_log', f'FROM ad_log WHERE epoch_ms % 2 = {i}')})"
    half_pt = lambda i: VIEWS["pt"].replace("FROM st", "FROM (" + half(i, VIEWS["st"]) + ")")
    packed = "SELECT CAST(1 AS BIGINT) AS task_id, string_agg(split || '=' || coalesce(printf('%.2f', rate), 'null'), '|' ORDER BY pos) AS convert_rate FROM rates"
    out = {
        "scan_actions_by_date": sql(f"SELECT {COLUMNS} FROM acts", DATES),
        "scan_click_products": sql("SELECT city_id, click_product_id AS product_id FROM acts WHERE click_product_id IS NOT NULL", DATES),
        "scan_user_info": sql("SELECT * FROM user_info"), "scan_product_info": sql("SELECT * FROM product_info"), "city_info": sql("SELECT * FROM cities"),
        "session_aggregate": sql("SELECT * FROM ss"), "session_full_info": sql("SELECT * FROM full_ss"),
        "session_bucket_counts": sql("SELECT count(*) AS session_count, " + ", ".join(f"count(*) FILTER ({c}) AS \"{n}\"" for n, c in _buckets()) + " FROM chosen", where=few),
        "session_aggr_stat": sql(_stat_sql(), where=few),
        "session_detail": sql(f"SELECT {COLUMNS} FROM acts2", where=few, detail=True),
        "hour_session_count": sql("SELECT * FROM hours"), "hour_quota": sql("SELECT * FROM quota"), "random_extract": sql("SELECT * FROM extract"),
        "random_extract_detail": sql(f"SELECT {COLUMNS} FROM acts WHERE session_id IN (SELECT session_id FROM extract)"),
        "category_universe": sql("SELECT DISTINCT category_id FROM ids"),
        "category_clicks": sql("SELECT category_id, count(*) AS click_count FROM ids WHERE kind = 'c' GROUP BY 1"),
        "category_orders": sql("SELECT category_id, count(*) AS order_count FROM ids WHERE kind = 'o' GROUP BY 1"),
        "category_pays": sql("SELECT category_id, count(*) AS pay_count FROM ids WHERE kind = 'p' GROUP BY 1"),
        "category_counts": sql("SELECT * FROM counts"), "top10_category": sql("SELECT * FROM best"), "session_category_clicks": sql("SELECT * FROM sc"), "top10_session": sql("SELECT * FROM most"),
        "top10_session_detail": sql(f"SELECT {COLUMNS} FROM acts WHERE session_id IN (SELECT session_id FROM most)"),
        "page_pairs": sql("SELECT * FROM pairs"), "page_split_pv": sql("SELECT split, count(*) AS pv FROM pairs WHERE split IN (SELECT split FROM flow) GROUP BY 1"),
        "page_start_pv": sql(f"SELECT count(*) AS start_pv FROM acts WHERE page_id = {FLOW[0]}"), "page_convert_rate": sql("SELECT * FROM rates"), "page_convert_packed": sql(packed),
        "click_product_basic": sql("SELECT * FROM basic"), "area_product_clicks": sql("SELECT * FROM apc"), "area_product_full": sql("SELECT * FROM apf"), "area_top3_product": sql("SELECT * FROM top3"),
        "fn_strings": """SELECT c_custkey, c_custkey % 3 = 0 AS blank, 'a=' || c_custkey || '|b=' || c_mktsegment || '|c=|a=9' AS trimmed,
  CASE WHEN length(CAST(c_custkey % 120 AS VARCHAR)) = 2 THEN '' ELSE '0' END || (c_custkey % 120) AS padded, CAST(4 AS BIGINT) AS parts, c_mktsegment AS got, CAST(NULL AS VARCHAR) AS none,
  'a=7|b=' || c_mktsegment || '|c=|a=9' AS changed FROM customer""",
        "fn_dates": """SELECT event_id, event_id % 5 > 2 AS is_before, event_id % 5 < 2 AS is_after, CAST(3600 * (2 - event_id % 5) AS BIGINT) AS seconds, CAST(0 AS BIGINT) AS bad, strftime(ts, '%Y-%m-%d_%H') AS date_hour, strftime(ts, '%Y-%m-%d') AS d,
  strftime(ts, '%Y%m%d') AS k, strftime(ts, '%Y-%m-%d') AS parsed, strftime(ts, '%Y%m%d%H%M') AS m FROM events""",
        "fn_round": """SELECT c_custkey, CAST((200 * (c_custkey % 211) + c_custkey % 200 + 1) // (2 * (c_custkey % 200 + 1)) AS DOUBLE) / 100 AS r, CAST(NULL AS DOUBLE) AS none, CAST(split_part(v, '.', 1) AS DOUBLE) + CAST(CAST(substr(split_part(v, '.', 2), 1, 2) AS INTEGER) + CAST(substr(split_part(v, '.', 2), 3, 1) >= '5' AS INTEGER) AS DOUBLE) / 100 AS strict
  FROM (SELECT c_custkey, printf('%.60f', CAST(c_custkey % 741 AS DOUBLE) / [8, 40, 200][c_custkey % 3 + 1]) AS v FROM customer)""",
        "fn_udfs": sql("""SELECT product_id, p AS pair, s AS status, p AS unsalted, split_part(p, ':', 2) AS area, product_id AS pid, CAST(product_id AS VARCHAR) AS as_text, product_id AS as_long, p AS sql_pair,
  p AS sql_unsalted, s AS sql_status, split_part(p, ':', 2) AS sql_area, product_id AS sql_pid FROM (SELECT product_id, product_id || ':' || product_name AS p, json_extract_string(extend_info, '$.product_status') AS s FROM product_info)"""),
        "broadcast_join": sql(joined), "skew_split_join": sql(joined), "salted_join": sql(joined),
        "salted_agg": sql("SELECT category_id, count(*) AS click_count FROM ids WHERE kind = 'c' GROUP BY 1"),
        "heavy_key": "SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 1",
        "repartitioned": sql("SELECT session_id, count(*) AS n FROM acts GROUP BY 1"),
        "ad_log_parsed": sql(parsed), "stream_ad_log_parsed": sql(parsed), "ad_user_clicks": sql("SELECT * FROM uc"), "stream_ad_user_clicks": sql("SELECT * FROM uc"),
        "ad_blacklist_users": sql("SELECT * FROM black"), "stream_ad_blacklist_users": sql("SELECT * FROM black"),
        "ad_blacklist_filter": sql("SELECT epoch_ms, province, city, user_id, ad_id FROM ad_log WHERE user_id NOT IN (SELECT user_id FROM black)"),
        "ad_stat": sql("SELECT * FROM st"), "stream_ad_stat": sql("SELECT * FROM st"), "ad_province_top3": sql("SELECT * FROM pt"), "stream_ad_province_top3": sql("SELECT * FROM pt"),
        "ad_click_trend": sql(trend.format("ts > (SELECT max(ts) FROM ad_log) - INTERVAL 60 MINUTE")),
        "stream_ad_click_trend": sql(trend.format("date_trunc('minute', ts) > date_trunc('minute', (SELECT max(ts) FROM ad_log)) - INTERVAL 60 MINUTE")),
        "bernoulli_sample": "SELECT TRUE AS is_part, TRUE AS each_once, TRUE AS share_holds, TRUE AS repeatable",
        "stream_ad_click_trend_window": sql(trend.format("date_trunc('minute', ts) > date_trunc('minute', (SELECT max(ts) FROM ad_log)) - INTERVAL 60 MINUTE")),
        "preview": sql(f"SELECT {COLUMNS} FROM acts ORDER BY event_id LIMIT 5"),
        "job_session_aggr_stat": sql(_stat_sql(), **j1), "job_session_random_extract": sql("SELECT * FROM extract", **j1),
        "job_session_detail": sql(f"SELECT {COLUMNS} FROM acts2 WHERE session_id IN (SELECT session_id FROM extract UNION ALL SELECT session_id FROM most)", **j1),
        "job_top10_category": sql("SELECT * FROM best", **j1), "job_top10_session": sql("SELECT * FROM most", **j1),
        "job_page_split_convert_rate": sql(packed, DATES), "job_area_top3_product": sql("SELECT * FROM top3", DATES),
        "sink_append": sql(f"{half(0, VIEWS['st'])} UNION ALL {half(1, VIEWS['st'])}"), "sink_upsert_add": sql("SELECT * FROM uc"),
        "sink_upsert_set": sql(f"SELECT * FROM ({half(1, VIEWS['st'])}) UNION ALL SELECT a.* FROM ({half(0, VIEWS['st'])}) a ANTI JOIN ({half(1, VIEWS['st'])}) b USING (date, province, city, ad_id)"),
        "sink_insert_absent": sql("SELECT DISTINCT user_id FROM ad_log"),
        "sink_replace_group": sql(f"SELECT * FROM ({half_pt(1)}) UNION ALL SELECT a.* FROM ({half_pt(0)}) a ANTI JOIN ({half_pt(1)}) b USING (date, province)"),
    }
    keys = ("user_id", "session_id", "page_id", "action_time")
    rest = ", ".join(f"{c} NULLS FIRST" for c in COLUMNS.split(", ") if c not in keys)
    detail = out["job_session_detail"].replace(f"\nSELECT {COLUMNS} FROM acts2", f"\nSELECT {COLUMNS}, row_number() OVER (PARTITION BY {', '.join(keys)} ORDER BY {rest}) AS rn FROM acts2")
    one = "CAST(1 AS BIGINT) AS task_id"
    out |= {
        "sink_session_aggr_stat": out["job_session_aggr_stat"], "sink_session_random_extract": out["job_session_random_extract"], "sink_session_detail": f"SELECT {one}, {COLUMNS} FROM ({detail}) WHERE rn = 1",
        "sink_top10_category": f"SELECT {one}, * FROM ({out['job_top10_category']})", "sink_top10_session": f"SELECT {one}, * FROM ({out['job_top10_session']})",
        "sink_page_split_convert_rate": out["job_page_split_convert_rate"], "sink_area_top3_product": out["job_area_top3_product"],
    }
    for n, p in FILTERS.items():
        out[f"session_filter_{n}"] = sql("SELECT * FROM chosen", where=where_of(p))
    return out
