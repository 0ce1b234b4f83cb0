import hashlib
import re

from clickloom.llm import positional_index as P


def brute(docs, items, width=13):
    low = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for i, t in items:
        w = low(t)
        for k in range(max(1, len(w) - width + 1)) if w else ():
            windows.setdefault(tuple(w[k : k + width]), set()).add(i)
    sizes, out = {len(w) for w in windows}, []
    for d, t in docs:
        w, hit, found = low(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (g := tuple(w[k : k + n])) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[g]
        out.append((d, len(w), len(hit), sorted(str(i) for i in found if i is not None)))
    return sorted(out, key=repr)


def rows(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in df.collect()), key=repr)


ITEMS = [(1, "er th on"), (2, "One"), (2, "one"), (3, None), (4, ""), (None, "two words"), (10, " ".join(f"w{i}" for i in range(20))), (5, "the the")]


def test_odd_rows(spark, odd, odd_rows):
    items = spark.createDataFrame([(*i, "c") for i in ITEMS], "item_id bigint, text string, hits string")
    want = brute([r[:2] for r in odd_rows], ITEMS)
    assert rows(P.decontaminate(odd, items, ["doc_id"])) == want
    index = P.build(odd, ["doc_id"])  # whole vocabulary, nothing stored
    hit = lambda d: sorted((r.doc_id, sum(h.stop - h.start for h in r.hits)) for r in d.where("doc_id IS NOT NULL").collect())
    assert hit(P.search(index, items)) == sorted((d, h) for d, _, h, _ in want if d is not None)
    assert P.decontaminate(odd.where("false"), items, ["doc_id"]).count() == 0
    assert P.decontaminate(odd, items.where("false"), ["doc_id"]).where("n_hit > 0 OR contaminated").count() == 0


def test_queries_in_chunks(spark, docs, sf, texts, monkeypatch):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    want = brute(texts.items(), [tuple(r) for r in bench.collect()])
    monkeypatch.setattr(P.query_chunks, "__defaults__", (600,))
    monkeypatch.setattr(P, "BLOCK_BYTES", 50_000)
    assert rows(P.decontaminate(docs, bench, ["doc_id"])) == want
    assert any(w[2] for w in want)
    plan = P.search(P.build(docs, ["doc_id"]), bench)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") <= 3  # however many chunks there are


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a x x b"), (2, "b a"), (3, "a x x x x b"), (4, "a")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    got = P.search(P.build(docs, ["doc_id"]), items, near=4).where("size(items) > 0")
    assert sorted(r.doc_id for r in got.collect()) == [1, 2]


def test_cutting():
    text = "Keep this. One, TWO three! keep Été"
    assert P.cut_hits(text.encode(), [{"start": 2, "stop": 5}]).decode() == "Keep this. ! keep Été"
    assert P.cut_hits(b"a b a b", [{"start": 0, "stop": 1}, {"start": 3, "stop": 4}]) == b" b a "


def test_digest_of_no_items(spark, sf):
    from clickloom.llm.queries import op3_benchmark_decontamination

    r = op3_benchmark_decontamination(spark, sf).where("n_items = 0").first()
    assert r.items_sha256 == hashlib.sha256(b"").hexdigest()
