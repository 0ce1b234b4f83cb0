"""Each stage against a plain reading of what it is to keep."""

import corpus_pipeline as C
import pytest
from pyspark.sql import functions as F
from clickloom.llm import mil_classifier, positional_index, quality_rules

from .test_index import brute
from .test_near_copies import brute as least
from .test_packing import expected, gapless


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    home = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = {"documents": docs}
    for name, f in C.STAGES:
        f(spark, docs, sf).write.parquet(f"{home}/{name}")
        docs = out[name] = spark.read.parquet(f"{home}/{name}")
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns_and_methods(stages):
    names = [n for n, _ in C.STAGES]
    assert names == ["quality_classifier", "quality_rules", "simhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]
    assert all(stages[n].columns == stages["documents"].columns for n in names[:-1])


def test_classifier(spark, sf, stages):
    docs = stages["documents"]
    model = mil_classifier.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    want = {r.doc_id for r in mil_classifier.score(docs, model, ["doc_id"]).where("score >= 0.7").collect()}
    assert texts(stages["quality_classifier"]) == {d: t for d, t in texts(docs).items() if d in want}


def test_rules(stages):
    before, after = texts(stages["quality_classifier"]), texts(stages["quality_rules"])
    for d, t in before.items():
        n, _, _, _, repeat, *_ = quality_rules.stats_of(t.encode())
        if n < 50 or 100 * repeat > 50 * n:
            assert d not in after
    assert len(after) > 0.8 * len(before)


def test_dedup(spark, stages):
    before, after = texts(stages["quality_rules"]), texts(stages["simhash_near_dedup"])
    assert set(after) == least(list(before.items())) and all(after[d] == before[d] for d in after)


def test_rows_whose_first_hash_is_equal(spark, monkeypatch):
    """Neither stage takes two rows for one where one hash of 64 bits meets."""
    keyed = C._keyed
    monkeypatch.setattr(C, "_keyed", lambda df, *c: keyed(df, *c).withColumn("_key", F.lit(1).cast("long")))
    a, b, c = (" ".join(f"{x}{i}" for i in range(80)) for x in "abc")
    rows = [(1, a), (2, a), (3, b), (4, c), (4, c), (5, b + " end")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    assert sorted(r.doc_id for r in C.near_duplicates(spark, docs, "").collect()) == [1, 3, 4]


def test_decontamination(spark, sf, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    before, after = texts(stages["simhash_near_dedup"]), texts(stages["benchmark_decontamination"])
    found = {d: (n, h) for d, n, h, _ in brute(before.items(), items)}
    assert set(after) == {d for d, (n, h) in found.items() if not (h and 20 * h >= n)}
    assert all(after[d] == before[d] for d in after if not found[d][1])


def test_packing(stages):
    got = stages["best_fit_packing"].collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == expected(texts(stages["benchmark_decontamination"]).items())
    gapless(got)


def test_light_contamination_is_cut(spark, tmp_path):
    item = " ".join(f"q{i}" for i in range(13))
    rest = " ".join(f"r{i}" for i in range(400))
    docs = spark.createDataFrame([(1, f"{rest} {item.upper()} end", "en", "s", 1), (2, item, "en", "s", 1), (3, rest, "en", "s", 1), (4, None, "en", "s", None)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: (r.text, r.n_chars) for r in C.decontaminate(spark, docs, str(tmp_path)).collect()}
    assert got == {1: (f"{rest}  end", len(rest) + 5), 3: (rest, 1), 4: (None, None)}
    assert not positional_index.words_of(None)


def test_odd_rows(spark, odd, odd_rows, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "one")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = sorted((r.doc_id for r in C.near_duplicates(spark, odd, str(tmp_path)).collect()), key=repr)
    assert kept.count(7) == 1 and kept.count(1) == 1 and kept.count(2) == 0 and None in kept
    for name, f in C.STAGES:
        n = f(spark, odd, str(tmp_path)).count()
        assert 0 < n or name in ("quality_rules", "quality_classifier")
        assert f(spark, odd.where("false"), str(tmp_path)).count() == 0


def test_run_is_the_stages_in_order(spark, sf, stages):
    got = C.run(spark, sf).select("doc_id", "piece", "start", "length", "ids_crc32").collect()
    want = stages["best_fit_packing"].select("doc_id", "piece", "start", "length", "ids_crc32").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr)
