from collections import Counter

from pyspark.sql import functions as F

from clickloom.llm import common as C


def test_gapless_ranks_of_hot_and_rare_keys(spark):
    df = spark.range(0, 5000, numPartitions=7).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 11).cast("bigint").alias("k"))
    got = C.with_rank(C.with_local_rank(df, ["k"], "r"), ["k"], "rank").collect()
    by = {}
    for r in got:
        by.setdefault(r.k, []).append(r["rank"])
    assert len(got) == 5000 and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert C.with_rank(C.with_local_rank(df.where("false"), ["k"], "r"), ["k"], "rank").count() == 0


def test_smallest_is_a_bounded_top(spark):
    df = spark.range(5000).withColumn("h", F.xxhash64("id"))
    want = [r.id for r in df.orderBy("h").limit(20).collect()]
    assert [r.id for r in C.smallest(df, "h", 20, "id").orderBy("h").collect()] == want
    same = df.withColumn("h", F.lit(1 << 62))  # no spread at all
    assert C.smallest(same, "h", 20, "id").count() == 20 and C.smallest(df.where("false"), "h", 20).count() == 0


def test_labels_that_contradict_each_other_go(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (2, 1), (None, 1), (3, None)], "doc_id bigint, quality int")
    assert sorted(map(tuple, C.clean_labels(df).collect())) == [(1, 1)]


def test_slices_cover_every_row(spark):
    texts = ["x" * n for n in (0, 10, 3_000_000, 5, 0, 1_500_000, 1_500_000)] + [None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i bigint, t string").coalesce(1)
    chunks = C.text_chunks

    def run(batches):
        import pyarrow as pa

        for part, found in chunks(batches, "t"):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x or b"") for x in found]), pa.array([len(found)] * len(found))], names=["i", "n", "size"])

    got = df.mapInArrow(run, "i bigint, n bigint, size bigint").collect()
    assert Counter((r.i, r.n) for r in got) == Counter((i, len(t or "")) for i, t in enumerate(texts))


def test_staged_tables_can_be_read_again(spark):
    df = C.stage(spark.range(10), "t")
    assert df.count() == 10 and df.staged_path.startswith(C.shared_dir(spark))
    C.drop(df)


def test_apart_loses_nothing(spark):
    df = spark.range(3000).withColumn("k", F.xxhash64("id"))
    for n, most in ((0, 26), (200, 26), (2000, 10)):
        keys = df.where(F.col("id") < n).select("k")
        clear, doubt = C.apart(df, "k", keys, most)
        a, b = [{r.id for r in x.collect()} for x in (clear, doubt)]
        assert a | b == set(range(3000)) and not a & b and set(range(n)) <= b
        assert most < 26 or len(b) <= n + 300


def test_no_local_folder_on_a_cluster():
    from types import SimpleNamespace

    import pytest

    from clickloom.llm import common

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(cluster)
