"""The pipeline's near copies against all pairs, compared on whole sets."""

import random

import corpus_pipeline as C
import pyarrow as pa
import pytest
from clickloom.llm import near_copies as N
from clickloom.llm import simhash as S
from pyspark.sql import functions as F


def brute(rows):
    """doc_ids that stay: the least of each component of Jaccard similarity 0.8 or more."""
    sets = {i: frozenset(zip(*[t.lower().split()[k:] for k in range(5)], strict=False)) for i, t in rows}
    root = {i: i for i in sets}

    def top(i):
        return i if root[i] == i else top(root[i])

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            k = len(sets[a] & sets[b])
            if 5 * k >= 4 * (len(sets[a]) + len(sets[b]) - k):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {i for i in ids if root[i] == i}


def stays(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    return {r.doc_id for r in C.near_duplicates(spark, docs, "").collect()}


def test_edited_copies_at_any_distance(spark):
    rng = random.Random(3)
    rows = []
    for n in range(60):
        text = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 400))]
        rows.append((len(rows), " ".join(text)))
        for _ in range(rng.randrange(6)):
            text = list(text)
            for _ in range(rng.randrange(1, 2 + len(text) // 50)):
                text[rng.randrange(len(text))] = f"x{rng.randrange(5000)}"
            rows.append((len(rows), " ".join(text)))
    want = brute(rows)
    assert 60 <= len(want) < len(rows) - 60
    assert stays(spark, rows) == want


def test_documents_near_and_far(spark, sf):
    """All documents of the test data of 50 words or more."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if len((r.text or "").split()) >= 50]
    assert stays(spark, rows) == brute(rows)


def test_short_sets():
    assert N.shingle_set(None).size == N.shingle_set(b" \n").size == 0 and N.shingle_set(b"a b").size == 1
    assert N.set_ids(N.shingle_set(b"A b")) == N.set_ids(N.shingle_set(b"a  B")) != N.set_ids(N.shingle_set(b"a c"))


def test_links_between_classes_of_one_bucket(spark):
    """A chain whose ends differ: neither end is like the least set, and links between other sets count."""
    words = [f"w{i}" for i in range(300)]
    rows = []
    for n in range(40):  # each changes 4 words of the one before, so far ones aren't alike
        words = words[:]
        for k in range(4):
            words[(n * 37 + k * 71) % 300] = f"x{n}_{k}"
        rows.append((n, " ".join(words)))
    assert stays(spark, rows) == brute(rows) and len(brute(rows)) < 5


def group(rng, n):
    """Heavily edited copies of one text, unlike it, and light edits of some of them."""
    base = [f"w{i}" for i in range(200)]
    rows = [(0, " ".join(base))]
    while len(rows) < n:
        text = base[:]
        for _ in range(rng.randrange(5, 14)):
            text[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
        rows.append((len(rows), " ".join(text)))
        for _ in range(rng.randrange(3)):
            text = text[:]
            text[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(text)))
    return rows


@pytest.mark.parametrize("block", [7, 256])
def test_links_aside_from_the_hub(spark, monkeypatch, block):
    """Sets that are unlike the hub of their buckets link with others, in whichever blocks they lie."""
    monkeypatch.setattr(N, "BLOCK", block)
    for seed in (1, 2):
        rows = group(random.Random(seed), 150)
        want = brute(rows)
        assert 10 < len(want) < 120
        assert stays(spark, rows) == want


def test_cells_of_two_blocks():
    """Against intersections of Python sets; one link for each two classes."""
    rng = random.Random(6)
    sets = [sorted(rng.sample(range(60), 53)) for _ in range(40)]
    block = [rng.randrange(2) for _ in sets]
    root = [rng.randrange(12) for _ in sets]
    cell = {"h": [9] * 40, "lo": [0] * 40, "hi": [1] * 40, "block": block, "node": list(range(40)), "root": root, "hashes": pa.array(sets, pa.list_(pa.int64()))}
    near = lambda a, b: 5 * len({*a} & {*b}) >= 4 * len({*a} | {*b})
    want = {frozenset((root[i], root[j])) for i in range(40) for j in range(40) if block[i] == 0 and block[j] == 1 and root[i] != root[j] and near(sets[i], sets[j])}
    got = N.crossing(pa.table(cell)).to_pylist()
    assert all(near(sets[r["a"]], sets[r["b"]]) for r in got)
    assert sorted(sorted((root[r["a"]], root[r["b"]])) for r in got) == sorted(map(sorted, want)) and want
    alone = {k: v[:1] for k, v in cell.items()}
    assert N.crossing(pa.table(alone)).num_rows == 0


def edited(rng):
    """Texts with a few changed words each, as (node, text)."""
    rows = []
    for _ in range(60):
        text = [f"w{rng.randrange(5000)}" for _ in range(300)]
        other = text[:]
        for _ in range(rng.randrange(1, 12)):
            other[rng.randrange(300)] = f"x{rng.randrange(5000)}"
        rows += [(len(rows), " ".join(text)), (len(rows) + 1, " ".join(other))]
    return rows


def marked(spark, rows):
    """The distinct sets of the texts, as near_copies has them, node being the text's number."""
    docs = spark.createDataFrame(rows, "node bigint, text string").withColumn("_key", F.col("node")).repartition(3)
    return docs, N.signatures(docs, ["node", "_key"]).withColumn("rep", F.struct("_key"))


def test_fingerprints_are_those_of_the_operator(spark):
    """Of the sets: every text here has each of its shingles once."""
    docs, uniq = marked(spark, edited(random.Random(8)))
    want = {r.node: r.fp for r in S.fingerprints(docs, ["node"], N.WIDTH).collect()}
    assert {r.node: r.mark for r in uniq.collect()} == want and len(set(want.values())) > 60


def test_fingerprint_search_finds_its_links_by_itself(spark):
    """Without any key of minimum hashes: every alike pair within the radius is linked, and nothing else."""
    rows = edited(random.Random(9))
    docs, uniq = marked(spark, rows)
    fp = {r.node: r.mark & (1 << 64) - 1 for r in uniq.collect()}
    sets = {i: set(N.shingle_set(t.encode()).tolist()) for i, t in rows}
    alike = [(i, i + 1) for i in range(0, len(rows), 2) if 5 * len(sets[i] & sets[i + 1]) >= 4 * len(sets[i] | sets[i + 1])]
    want = {p for p in alike if (fp[p[0]] ^ fp[p[1]]).bit_count() <= N.RADIUS}
    got = N.links(docs, uniq.withColumn("bands", F.expr("slice(bands, 1, 0)")), ["_key"]).collect()
    assert {tuple(sorted((r.a, r.b))) for r in got} == want and 5 < len(want) < len(alike)


def test_sets_of_one_fingerprint_are_paired(spark):
    """Equal and close fingerprints make pairs, unlike sizes and small sets don't."""
    uniq = spark.createDataFrame([(1, 100, 7), (2, 100, 7), (3, 101, 7 ^ 31), (4, 300, 7), (5, 3, 7), (6, 100, -8)], "node bigint, n int, mark bigint")
    assert {tuple(sorted((r.a, r.b))) for r in N.by_fingerprint(uniq).collect()} == {(1, 2), (1, 3)}
