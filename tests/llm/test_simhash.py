import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clickloom.llm import simhash as H


def classes(fps, radius=3):
    """{fp: least fp that can be reached}, by comparing all pairs."""
    fps = sorted(set(fps))
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    a = np.array(fps, np.uint64)
    for i, f in enumerate(fps):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= radius):
            x, y = find(f), find(fps[i + 1 + int(j)])
            root[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


def test_fingerprint_is_spark_xxhash(spark, docs):
    """The hash is Spark's own xxhash64 (seed 42) of the shingle."""
    df = docs.limit(40)
    got = {r.doc_id: r.fp & (2**64 - 1) for r in H.fingerprints(df, ["doc_id"]).collect()}
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    w = F.filter(F.split(low, r"[\x20\x09-\x0D]+"), lambda x: x != "")
    sh = df.select("doc_id", w.alias("w")).select("doc_id", F.explode(F.when(F.size("w") < 3, F.array(F.array_join("w", " "))).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 2, F.lit(1))), lambda i: F.array_join(F.slice("w", i, 3), " ")))).alias("s"))
    bits = {}
    for r in sh.select("doc_id", F.xxhash64("s").alias("h")).collect():
        bits.setdefault(r.doc_id, []).append(r.h & (2**64 - 1))
    want = {d: sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) for d, hs in bits.items()}
    assert got == want


def test_allocation_is_optimal():
    import itertools

    rng = random.Random(3)
    for parts in (2, 3, 4, 5):
        cost = [sorted(rng.random() * 9 for _ in range(4)) for _ in range(parts)]
        value = lambda ts: sum(c[t] for c, t in zip(cost, ts) if t >= 0)  # noqa: B023, B905, E731
        total, ts = H.allocate(cost, 3)
        assert total == pytest.approx(value(ts))
        assert sum(ts) == 4 - parts
        assert value(ts) == pytest.approx(min(value(x) for x in itertools.product(range(-1, 4), repeat=parts) if sum(x) == 4 - parts))


@settings(max_examples=12, deadline=None)
@given(st.randoms(use_true_random=False))
def test_forest(rng):
    base = [rng.getrandbits(64) for _ in range(12)]
    fps = {b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 4))) & (2**64 - 1) for b in base for _ in range(30)}
    edges = H.spanning_forest(np.array(sorted(fps), np.uint64), 3)
    assert all(bin(int(a) ^ int(b)).count("1") <= 3 for a, b in edges)
    want = len(fps) - len(set(classes(fps).values()))
    assert len(edges) == want


def test_large_forest_is_cut():
    rng = np.random.default_rng(2)
    fps = np.unique(np.concatenate((rng.integers(0, 2**63, 5000).astype(np.uint64), np.uint64(1) << np.arange(60, dtype=np.uint64))))
    edges = H.spanning_forest(fps, 3)
    got = {int(x): int(x) for x in fps}

    def find(x):
        while got[x] != x:
            x = got[x]
        return x

    for a, b in edges:
        x, y = find(int(a)), find(int(b))
        got[max(x, y)] = min(x, y)
    assert {f: find(f) for f in got} == classes(map(int, fps))


@pytest.mark.parametrize("parts", [2, 3, 4, 6])
def test_links_and_components(spark, parts):
    rng = random.Random(parts)
    base = [rng.getrandbits(64) for _ in range(60)]
    fps = {b ^ sum(1 << rng.randrange(64) for _ in range(k)) & (2**64 - 1) for b in base for k in (0, 1, 2, 3, 3, 4, 6)} | {0, 1, 3, 7, 15, 31, 63, 127}
    uniq = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in fps], "fp bigint").repartition(4)
    got = {f: f for f in fps}
    for r in H.components(H.links(uniq, 3, parts)).collect():
        got[r.node & (2**64 - 1)] = r.root & (2**64 - 1)
    same = lambda m: {frozenset(f for f in m if m[f] == r) for r in set(m.values())}
    assert same(got) == same(classes(fps))


def test_refined_masks_lose_nothing(spark):
    rng = random.Random(9)
    fps = {rng.getrandbits(64) & ~0xFFFF for _ in range(50)}
    fps |= {f ^ 1 << 40 ^ 1 << 20 for f in list(fps)[:20]}
    uniq = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in fps], "fp bigint").cache()
    coarse, fine = H.plan(uniq, 3, 4, probe=1e9), H.plan(uniq, 3, 4, 5, probe=1e9)
    assert len(fine) > len(coarse)
    plan, H.plan = H.plan, lambda *a: fine
    try:
        n = H.links(uniq).distinct().count()
    finally:
        H.plan = plan
    assert n == 20


def test_chain_of_many_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)], "a bigint, b bigint")
    got = {r.node: r.root for r in H.components(e).collect()}
    assert {got.get(i, i) for i in range(41)} == {0} and {got.get(i, i) for i in (100, 101, 102)} == {100}
    assert H.components(e.where("false")).count() == 0


def test_odd_rows(spark, odd, odd_rows):
    import xxhash

    def fp(t):
        w = (t or "").encode().translate(H.LOWER_BYTES).split()
        hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    marks = [(r[0], fp(r[1])) for r in odd_rows]
    root = classes(f for _, f in marks)
    least = {}
    for d, f in marks:
        least[root[f]] = min((x for x in (least.get(root[f]), d) if x is not None), default=None)
    got = sorted(((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in H.near_duplicates(odd, ["doc_id"]).collect()), key=repr)
    assert got == sorted(((d, f, least[root[f]]) for d, f in marks), key=repr)
    assert H.near_duplicates(odd.where("false"), ["doc_id"]).count() == 0


def test_query(spark, sf):
    from clickloom.llm.queries import op4_simhash_near_dedup

    got = op4_simhash_near_dedup(spark, sf.replace("0.001", "0.01")).collect()
    root = classes(int(r.fingerprint, 16) for r in got)
    least = {}
    for r in got:
        k = root[int(r.fingerprint, 16)]
        least[k] = min(least.get(k, r.doc_id), r.doc_id)
    assert all(r.component_id == least[root[int(r.fingerprint, 16)]] for r in got) and len(least) < len(got)


def test_long_chains_converge(spark):
    chain = spark.createDataFrame([(i * 7919 % 601, (i + 1) * 7919 % 601) for i in range(600)], "a long, b long")
    assert {r.root for r in H.components(chain).collect()} == {0}


def test_unequal_thresholds_on_a_correlated_corpus(spark):
    """Sixteen bits are set together or not at all, so their partition isn't worth a probe."""
    rng = np.random.default_rng(4)
    block = np.uint64(H.mask_of(list(range(3, 64, 4))))
    fps = np.where(rng.random(20_000) < 0.5, block, np.uint64(0)) | (rng.integers(0, 2**63, 20_000).astype(np.uint64) & ~block)
    near = [int(f) ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(1, 4), replace=False)) for f in fps[:400]]
    fps = sorted({*map(int, fps), *near})
    uniq = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in fps], "fp bigint").repartition(4).cache()
    probes = H.plan(uniq)
    assert len({t for _, t in probes}) > 1 and not any(m == int(block) for m, _ in probes)
    got = {f: f for f in fps}
    for r in H.components(H.links(uniq)).collect():
        got[r.node & (2**64 - 1)] = r.root & (2**64 - 1)
    want, sets = classes(fps), {}
    for f in fps:
        sets.setdefault(got[f], set()).add(want[f])
    assert all(len(v) == 1 for v in sets.values()) and len(sets) == len(set(want.values()))


def test_more_fingerprints_take_fewer_partitions(spark):
    """What a probe costs falls against candidates as their number grows."""
    rng = np.random.default_rng(6)
    uniq = spark.createDataFrame([(int(f),) for f in rng.integers(-(2**62), 2**62, 5000)], "fp bigint").cache()
    assert len(H.plan(uniq)) == 4 and len(H.plan(uniq, probe=1e-5)) < 4
