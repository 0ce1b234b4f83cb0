"""Hand-computed cases and properties."""

from datetime import date

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clickloom.functions import scalar as S
from clickloom.operators import ads, category, funnel, product, session, skew
from clickloom.plans.params import Settings, TaskParam, task
from clickloom.sources import catalog, sinks

ACT = "date string, user_id bigint, session_id string, page_id bigint, action_time string, search_keyword string, click_category_id bigint, click_product_id bigint, order_category_ids string, order_product_ids string, pay_category_ids string, pay_product_ids string, city_id bigint, event_id bigint"


def one(spark, *cols, **data):
    df = spark.createDataFrame([tuple(data.values())], ", ".join(f"{k} string" for k in data)) if data else spark.range(1)
    return tuple(df.select(*cols).first())


def act(**k):
    base = dict.fromkeys(x.split()[0] for x in ACT.split(", "))
    return tuple((base | {"date": "2024-01-01", "user_id": 1, "session_id": "a", "action_time": "2024-01-01 09:00:00", "event_id": 0} | k).values())


def test_strings(spark):
    s = "x"
    for v, want in ((None, True), ("", True), ("null", True), ("NULL", True), ("a", False)):
        assert one(spark, S.is_blank(s), x=v)[0] is want
    assert one(spark, S.trim_comma(s), x=",,a,b,,")[0] == ",a,b,"
    for v, want in (("5", "05"), ("12", "12"), ("123", "0123")):
        assert one(spark, S.pad_two(s), x=v)[0] == want
    assert one(spark, S.get_field(s, "b"), x="a=1|b=|c=3")[0] is None
    assert one(spark, S.get_field(s, "c"), x="a=1|b=|c=3|c=4")[0] == "3"
    assert one(spark, S.set_field(s, "a", "9"), x="a=1|a=2")[0] == "a=9|a=2"
    assert one(spark, S.split_items(s), x=",1,,2,")[0] == ["1", "2"]


def test_dates(spark):
    assert str(one(spark, S.parse_time("x"), x="2018-05-01 9:05:03")[0]) == "2018-05-01 09:05:03"
    assert one(spark, S.before("x", "y"), S.after("x", "y"), S.minus_seconds("y", "x"), x="2024-01-01 00:00:00", y="2024-01-01 00:01:00") == (True, False, 60)
    assert one(spark, S.before("x", "y"), S.minus_seconds("x", "y"), x="bad", y="2024-01-01 00:01:00") == (False, 0)
    assert one(spark, S.today(), S.yesterday())[0] >= str(date(2024, 1, 1))
    assert one(spark, S.date_hour("x"), x="2024-01-01 9:00:00")[0] == "2024-01-01_09"


@settings(max_examples=30, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 5000), st.integers(1, 800))
def test_ratio_rounds_half_up(spark, n, d):
    from decimal import ROUND_HALF_UP, Decimal
    from fractions import Fraction

    f = Fraction(n, d) * 100
    want = (Decimal(f.numerator * 10**6 // f.denominator) / 10**6).quantize(Decimal(1), ROUND_HALF_UP) / 100
    assert spark.range(1).select(S.ratio2(F.lit(n), F.lit(d))).first()[0] == pytest.approx(float(want), abs=1e-9)


def test_strict_ratio_of_many(spark):
    """Against the exact value of the double, read as a decimal number."""
    from decimal import ROUND_HALF_UP, Decimal

    pairs = [(n, d) for d in (8, 40, 200, 3, 7, 16, 25, 125, 400) for n in range(3 * d + 2)] + [(n, 200) for n in range(100_001, 100_400)]
    df = spark.createDataFrame(pairs, "n bigint, d bigint").select("n", "d", S.ratio2_binary("n", "d").alias("r"))
    for r in df.collect():
        assert r.r == float(Decimal(r.n / r.d).quantize(Decimal("0.01"), ROUND_HALF_UP)), r


def test_strict_ratio(spark):
    assert tuple(spark.range(1).select(S.ratio2(F.lit(29), F.lit(200)), S.ratio2_binary(F.lit(29), F.lit(200)), S.ratio2(F.lit(1), F.lit(0))).first()) == (0.15, 0.14, None)


def test_sort_key(spark):
    df = spark.createDataFrame([(1, 30, 35, 40), (2, 35, 30, 40), (3, 30, 38, 30)], "category_id bigint, click_count bigint, order_count bigint, pay_count bigint")
    assert [r.category_id for r in category.top(df).collect()] == [2, 3, 1]


def test_buckets(spark):
    visit = [0, 1, 3, 4, 6, 7, 9, 10, 30, 31, 60, 61, 180, 181, 600, 601, 1800, 1801]
    df = spark.createDataFrame([(v, 1) for v in visit], "visit_length bigint, step_length bigint")
    r = session.bucket_counts(df).first().asDict()
    assert [r[f"visit_{n}"] for n, _, _ in session.VISIT] == [2] * 8 + [1] and r["session_count"] == 18 and r["step_1_3"] == 18
    df = spark.createDataFrame([(1, v) for v in (1, 3, 4, 6, 7, 9, 10, 30, 31, 60, 61)], "visit_length bigint, step_length bigint")
    r = session.bucket_counts(df).first().asDict()
    assert [r[f"step_{n}"] for n, _, _ in session.STEP] == [2] * 5 + [1]
    empty = session.aggr_stat(df.where("false")).first()
    assert empty.session_count == 0 and empty.step_60 is None


def test_filters(spark):
    df = spark.createDataFrame([(1, 20, "a,b"), (2, None, None)], "id bigint, age int, search_keywords string").withColumns({c: F.lit("x") for c in ("professional", "city", "sex", "click_category_ids")})
    n = lambda **k: session.filtered(df, TaskParam(**k)).count()
    assert n() == 2 and n(start_age=10) == 2 and n(start_age=10, end_age=30) == 1
    assert n(keywords=("b", "c")) == 1 and n(keywords=("c",)) == 0 and n(sex="x,y") == 0 and n(professionals=("x", "y")) == 2


def test_session_aggregate(spark):
    rows = [
        act(search_keyword="hot", action_time="2024-01-01 9:00:00"), act(search_keyword="hot pot", click_category_id=11, action_time="2024-01-01 09:00:07"),
        act(search_keyword="NULL", click_category_id=1), act(session_id="b", action_time=None),
    ]
    got = {r.session_id: r for r in session.aggregate(spark.createDataFrame(rows, ACT)).collect()}
    assert (got["a"].search_keywords, got["a"].click_category_ids, got["a"].visit_length, got["a"].step_length) == ("hot,hot pot", "1,11", 7, 3)
    assert got["b"].visit_length is None and got["b"].start_time is None


def test_universe_takes_the_first_kind(spark):
    a = spark.createDataFrame([act(click_category_id=5, order_category_ids="7,8"), act(order_category_ids="", pay_category_ids="9")], ACT)
    assert [r.category_id for r in category.universe(a).collect()] == [5]
    assert [tuple(r) for r in category.counts(a).collect()] == [(5, 1, 0, 0)]


def test_top_sessions_keep_ties(spark):
    a = spark.createDataFrame([act(session_id=f"s{i:02}", click_category_id=1) for i in range(12)], ACT)
    assert [r.session_id for r in category.top_sessions(a, category.top(category.counts(a))).orderBy("rn").collect()] == [f"s{i:02}" for i in range(10)]


def test_quota(spark):
    rows = [(f"s{d}_{i}", f"2024-01-{d + 1:02} {'09' if i < 2 else '10'}:00:00", "", "") for d in range(30) for i in range(5)]
    s = spark.createDataFrame(rows, "session_id string, start_time string, search_keywords string, click_category_ids string")
    q = {(r.date, r.hour): r.quota for r in session.hour_quota(s, 100).collect()}
    assert q["2024-01-01", "09"] == 1 and q["2024-01-01", "10"] == 1
    assert session.random_extract(s, 100).count() == 60
    days = spark.range(101).select(F.concat(F.lit("s"), "id").alias("session_id"), F.concat(F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd"), F.lit(" 09:00:00")).alias("start_time"), F.lit("").alias("search_keywords"), F.lit("").alias("click_category_ids"))
    assert session.random_extract(days, 100).count() == 0


def test_funnel(spark):
    a = spark.createDataFrame([act(page_id=p, event_id=i) for i, p in enumerate((3, 5, 2))], ACT)
    r = funnel.convert_rate(a, (3, 5, 2, 9, 1))
    assert [tuple(x) for x in r.orderBy("pos").collect()] == [(1, "3_5", 1, 1.0), (2, "5_2", 1, 1.0), (3, "2_9", 0, 0.0), (4, "9_1", 0, None)]
    assert funnel.packed(r).first().convert_rate == "3_5=1.00|5_2=1.00|2_9=0.00|9_1=null"


def test_area_levels(spark):
    df = spark.createDataFrame([("North West",), ("North East",), ("South West",), ("East",), ("Middle",)], "area string")
    assert [r[0] for r in df.select(product.area_level()).collect()] == ["C", "C", "D", "A", "B"]


def test_group_concat_is_a_set(spark):
    df = spark.createDataFrame([("11:A",), ("1:A",), ("11:A",), (None,)], "x string")
    assert df.agg(S.group_concat_distinct("x")).first()[0] == "11:A,1:A"


def test_bad_log_lines_are_marked(spark):
    df = spark.createDataFrame([("1704067200123 p c 1 2",), ("x p c 1 2",), ("1 2",), (None,), ("1704067200123 a b c 1 2",)], "value string")
    got = ads.parse_lines(df).collect()
    assert [bool(r.sound) for r in got] == [True, False, False, False, False]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 9)), max_size=40))
def test_salted_equals_plain(spark, rows):
    big = spark.createDataFrame(rows, "k bigint, v bigint")
    small = spark.createDataFrame([(i, f"n{i}") for i in range(3)], "k bigint, name string")
    want = sorted(map(tuple, big.join(small, "k").collect()))
    for how in (skew.salted_join, skew.skew_split_join, skew.broadcast_join):
        assert sorted(map(tuple, how(big, small, "k").select("k", "v", "name").collect())) == want
    assert sorted(map(tuple, skew.salted_aggregate(big, ["k"]).collect())) == sorted(map(tuple, big.groupBy("k").count().collect()))


def test_salted_join_sends_no_table_to_the_driver(spark):
    """The estimate of the expanded table is that of the plain one, so Spark would broadcast n times what it expects."""
    big, small = spark.range(1000).withColumnRenamed("id", "k"), spark.range(100).select(F.col("id").alias("k"), F.lit("x").alias("v"))
    out = skew.salted_join(big, small, "k")
    assert sorted(map(tuple, out.collect())) == [(k, "x") for k in range(100)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_params(spark):
    p = TaskParam.from_json('{"startDate":["2024-01-01"],"startAge":["10"],"targetPageFlow":["3,5,2"],"sex":[""],"x":[1]}')
    assert p == TaskParam(start_date="2024-01-01", start_age=10, target_page_flow=(3, 5, 2))
    s = Settings.from_properties("# c\ntask_id=4\nkafka.topics = a,b\n")
    assert s.task_id == 4 and s.extra == {"kafka.topics": "a,b"}
    with pytest.raises(ValueError):
        Settings.from_properties("task_id=x")
    t = spark.createDataFrame([(1, '{"sex":["male"]}')], "task_id bigint, task_param string")
    assert task(t, 1) == TaskParam(sex="male") and task(t, 2) is None


def test_open_bounds(spark):
    a = spark.createDataFrame([act(date=f"2024-01-0{i}") for i in range(1, 6)], ACT)
    assert [catalog.scan_actions(a, *b).count() for b in ((None, None), ("2024-01-02", None), (None, "2024-01-02"), ("2024-01-02", "2024-01-03"))] == [5, 4, 2, 2]


def test_mock_tables(spark):
    a = catalog.mock_actions(spark, 10, 2)
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, catalog.mock_actions(spark, 10, 2).collect()), key=repr)
    assert catalog.mock_users(spark).count() == catalog.mock_products(spark).count() == 100
    assert session.aggregate(a).where("visit_length >= 0").count() == 20
    most = session.aggregate(catalog.mock_actions(spark)).agg(F.max("step_length"), F.count("*")).first()
    assert 30 < most[0] <= 100 and most[1] == 1000


def test_merges(spark):
    k = "k bigint, click_count bigint"
    old, new = spark.createDataFrame([(1, 1), (2, 2), (None, 5)], k), spark.createDataFrame([(2, 5), (3, 7), (None, 1)], k)
    got = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert got(sinks.upsert_add(old, new, ["k"], "click_count")) == sorted([(1, 1), (2, 7), (3, 7), (None, 6)], key=repr)
    assert got(sinks.upsert_set(old, new, ["k"])) == sorted([(1, 1), (2, 5), (3, 7), (None, 1)], key=repr)
    assert got(sinks.insert_absent(old, new, ["k"])) == sorted([(1, 1), (2, 2), (3, 7), (None, 5)], key=repr)
    assert got(sinks.replace_group(old, new.where("k = 2"), ["k"])) == sorted([(1, 1), (2, 5), (None, 5)], key=repr)


def test_jdbc_round_trip(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    t = sinks.JdbcTable(spark, url, "ad_stat", "k bigint, click_count bigint", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"})
    t.create()
    t.write(spark.createDataFrame([(1, 1), (2, 2)], "k bigint, click_count bigint"))
    t.write(spark.createDataFrame([(2, 5), (3, 7)], "k bigint, click_count bigint"), "upsert_add", ("k",))
    assert sorted(map(tuple, t.read().collect())) == [(1, 1), (2, 7), (3, 7)]
    assert catalog.read_jdbc(spark, url, "ad_stat", t.properties).count() == 3


DERBY = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}


def test_point_lookups_and_partitioned_reads(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/lookup;create=true"
    rows = [("2024-01-01", u, a, 10 * u + a) for u in range(20) for a in range(5)]
    spark.createDataFrame(rows, "date string, user_id bigint, ad_id bigint, click_count bigint").write.option("createTableColumnTypes", "date VARCHAR(10)").jdbc(url, "ad_user_click_count", properties=DERBY)
    spark.createDataFrame([(3,)], "user_id bigint").write.jdbc(url, "ad_blacklist", properties=DERBY)
    t, black = catalog.read_jdbc(spark, url, "ad_user_click_count", DERBY), catalog.read_jdbc(spark, url, "ad_blacklist", DERBY)
    assert catalog.click_count(t, "2024-01-01", 3, 4) == 34 and catalog.click_count(t, "2024-01-02", 3, 4) == 0
    assert catalog.blacklisted(black, 3) and not catalog.blacklisted(black, 4)
    plan = catalog.lookup(t, user_id=3)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [*IsNotNull(user_id), *EqualTo(user_id,3)]" in plan
    parts = catalog.read_jdbc(spark, url, "ad_user_click_count", DERBY, column="user_id", bounds=(0, 20), partitions=4)
    assert parts.rdd.getNumPartitions() == 4 and parts.count() == 100


def test_a_failed_jdbc_merge_leaves_the_table(spark, tmp_path):
    t = sinks.JdbcTable(spark, f"jdbc:derby:{tmp_path}/bad;create=true", "ad_stat", "k bigint, click_count bigint", DERBY)
    t.create()
    rows = lambda *r: spark.createDataFrame(list(r), "k bigint, click_count bigint")
    t.write(rows((1, 1)))
    with pytest.raises(Exception, match="(?i)nowhere|does not exist"):
        t._at_once("DELETE FROM ad_stat", "INSERT INTO ad_stat SELECT * FROM nowhere")
    assert [tuple(r) for r in t.read().collect()] == [(1, 1)]
    with pytest.raises(Exception, match="(?i)boom"):
        t.write(rows((2, 2)).withColumn("click_count", F.raise_error(F.lit("boom")).cast("bigint")), "upsert_add", ("k",))
    assert [tuple(r) for r in t.read().collect()] == [(1, 1)]
    t.create(if_absent=True)
    assert t.read().count() == 1


def test_two_writers_of_one_version(spark, tmp_path):
    one, two = (sinks.ParquetTable(spark, f"{tmp_path}/t", "user_id bigint") for _ in range(2))
    rows = lambda i: spark.createDataFrame([(i,)], "user_id bigint")
    one.write(rows(1))

    def meanwhile(old, new):
        two.write(rows(2))
        return old.unionByName(new)

    with pytest.raises(RuntimeError, match="another writer"):
        one.write(rows(3), meanwhile)
    assert sorted(r.user_id for r in one.read().collect()) == [1, 2]
    one.write(rows(4))
    assert sorted(r.user_id for r in two.read().collect()) == [1, 2, 4]


def test_jobs_are_stored_once(spark, sf, tmp_path):
    """From the command line's arguments to the result tables; a second run leaves them as they are."""
    from pathlib import Path

    from clickloom.plans import main

    tables = Path(tmp_path, "tables")
    tables.mkdir()
    for p in Path(sf).glob("*.parquet"):
        (tables / p.name).symlink_to(p)
    spark.createDataFrame([(7, '{"startDate":["2024-01-05"],"endDate":["2024-01-20"],"targetPageFlow":["3,5,2"]}')], "task_id bigint, task_param string").write.parquet(f"{tables}/task.parquet")
    (tmp_path / "settings").write_text("session.task_id=7\nextract_count=1000\n")
    own = ["--tables", str(tables), "--out", f"{tmp_path}/out", "--settings", f"{tmp_path}/settings"]
    last = lambda n: spark.read.parquet(str(max(Path(tmp_path, "out", n).glob("v*"), key=lambda p: int(p.name[1:]))))
    got = []
    for _ in range(2):
        assert main.run(spark, ["session", *own]) == main.run(spark, ["page", "7", *own]) == main.run(spark, ["product", "7", *own]) == 7
        got.append({n: sorted(map(repr, last(n).where("task_id = 7").collect())) for n in ("session_aggr_stat", "session_random_extract", "session_detail", "top10_category", "top10_session", "page_split_convert_rate", "area_top3_product")})
    assert got[0] == got[1] and all(got[0].values())
    keys = ("task_id", "user_id", "session_id", "page_id", "action_time")
    detail = last("session_detail")
    assert detail.count() == detail.select(*keys).distinct().count()
    with pytest.raises(LookupError):
        main.run(spark, ["page", "8", *own])


def test_results_in_a_database(spark, sf, tmp_path):
    from clickloom.plans import jobs

    url = f"jdbc:derby:{tmp_path}/results;create=true"

    def table(name, schema):
        t = sinks.JdbcTable(spark, url, name, schema, DERBY)
        t.create(if_absent=True)
        return t

    out = jobs.product_job(catalog.Catalog(spark, sf), TaskParam())
    for _ in range(2):
        jobs.store({"area_top3_product": out["area_top3_product"].drop("city_infos")}, table, 1)
    assert catalog.read_jdbc(spark, url, "area_top3_product", DERBY).count() == out["area_top3_product"].count()


def test_tables_of_a_hive_metastore(sf, tmp_path):
    import subprocess
    import sys
    from pathlib import Path

    code = f"""
from clickloom.sources import catalog
s = catalog.hive_session(**{{"spark.master": "local[1]", "spark.ui.enabled": "false", "spark.sql.warehouse.dir": {str(tmp_path / "wh")!r}, "spark.hadoop.javax.jdo.option.ConnectionURL": "jdbc:derby:{tmp_path}/meta;create=true"}})
s.sql("CREATE TABLE cities STORED AS PARQUET AS SELECT 1L AS city_id, 'x' AS city_name, 'North' AS area")
assert s.conf.get("spark.sql.catalogImplementation") == "hive"
print("FOUND", catalog.Catalog(s, {sf!r}, (("city_info", "default.cities"),))("city_info").first().area)
"""
    run = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True, timeout=300)
    assert "FOUND North" in run.stdout, run.stderr[-2000:]


def test_no_local_folder_on_a_cluster():
    from types import SimpleNamespace

    from clickloom.sources import staging

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        staging.new_folder(cluster, "x")


def test_parquet_table_versions(spark, tmp_path):
    t = sinks.ParquetTable(spark, f"{tmp_path}/t", "user_id bigint")
    new = spark.createDataFrame([(1,), (1,), (2,)], "user_id bigint")
    assert t.read().count() == 0
    assert t.write(new, "insert_absent", ("user_id",), 0) and not t.write(new, "insert_absent", ("user_id",), 0)
    for i in range(1, 5):
        t.write(spark.createDataFrame([(i,)], "user_id bigint"), "insert_absent", ("user_id",), i)
    assert t.read().count() == 4 and t.version() == (5, 4)


def test_only_touched_days_are_written(spark, tmp_path):
    t = sinks.ParquetTable(spark, f"{tmp_path}/t", "date string, click_count bigint", "date")
    put = lambda rows, batch: t.write(spark.createDataFrame(rows, "date string, click_count bigint"), "upsert_add", ("date",), batch)
    for i in range(4):
        put([("2024-01-01", 1), (f"2024-01-0{i + 2}", 10)], i)
    assert sorted(map(tuple, t.read().collect())) == [("2024-01-01", 4), *((f"2024-01-0{i}", 10) for i in range(2, 6))]
    folders = t._manifest(t.version())
    assert folders["2024-01-02"].startswith("v1/") and folders["2024-01-01"].startswith("v4/")
    assert not (tmp_path / "t" / "v1" / "_p=2024-01-01").exists()  # no manifest that is kept names it
    with pytest.raises(ValueError):
        put([("a/b", 1)], 9)


def test_catalog_by_name(spark, sf):
    c = catalog.Catalog(spark, sf, (("city_info", "my_cities"),))
    spark.createDataFrame([(1, "x", "North")], "city_id bigint, city_name string, area string").createOrReplaceTempView("my_cities")
    assert c("city_info").count() == 1 and c("user_info").count() > 1
    catalog.Catalog(spark, sf).register()
    assert spark.sql("SELECT count(*) FROM user_visit_action WHERE date >= '2024-01-01'").first()[0] > 0


def test_filters_reach_the_scan(spark, sf):
    plan = catalog.user_info(spark, sf).where("user_id = 3").select("age")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(c_custkey), EqualTo(c_custkey,3)]" in plan and "ReadSchema: struct<c_custkey:bigint>" in plan


def test_top_lists_are_bounded(spark, sf):
    from clickloom import queries as Q

    plan = lambda n: Q.queries()[n](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan("top10_category") and "WindowGroupLimit" in plan("area_top3_product") and "WindowGroupLimit" in plan("ad_province_top3")
