import math
import zlib
from collections import Counter

import numpy as np
import pytest

from clickloom.llm import language_model as M


def base(rows):
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
    c = Counter(w for d, t in rows if not held(d) for w in M.tokens((t or "").encode()))
    n, v = sum(c.values()), len(c)
    out = []
    for d, t in rows:
        w = M.tokens((t or "").encode())
        out.append((d, held(d), len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)))
    return sorted(out, key=repr)


def check(df, rows):
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in df.collect()), key=repr)
    want = base(rows)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9, atol=1e-6)
    return got


def test_odd_rows(spark, odd, odd_rows):
    got = check(M.score(odd, ["doc_id", "score"]), [r[:2] for r in odd_rows])
    assert all(g[6] < 0 for g in got)
    assert M.score(odd.where("false"), ["doc_id"]).count() == 0


def test_no_training_rows(spark):
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)
    df = spark.createDataFrame([(held, "a b")], "doc_id bigint, text string")
    check(M.score(df, ["doc_id"]), [(held, "a b")])


@pytest.mark.parametrize(("head", "second"), [(3, 5), (40, 10), (40, 10**6), (10**6, 1)])
def test_rare_words_are_looked_up_and_joined(spark, docs, texts, head, second):
    got = check(M.score(docs, ["doc_id"], vocabulary=32, head=head, second=second), list(texts.items()))
    assert all(g[6] < 0 for g in got)


def model(n=300, classes=12, seed=0):
    rng = np.random.default_rng(seed)
    shape = M.Shape(rng.integers(1, 5000, n), 700.0, classes)
    p = {k: v + (0.3 * rng.standard_normal(v.shape)).astype(np.float32) for k, v in shape.start().items()}
    return shape, p, rng


def plain(shape, p, w, before):
    """log10 of the probability of one word, written out."""
    h = sum(p["r"][b].astype(float) @ c.astype(float) for b, c in zip(before, p["C"], strict=True))
    k, soft = shape.cls[w], lambda z: z - math.log(sum(math.exp(x) for x in z))
    own = slice(shape.first[k], shape.first[k] + shape.size[k])
    return (soft(p["a"].astype(float) @ h + p["ab"])[k] + soft(p["q"][own].astype(float) @ h + p["qb"][own])[w - shape.first[k]]) / math.log(10)


def test_scores_are_normalised_and_as_written_out():
    shape, p, rng = model()
    every = np.arange(len(shape.p))
    for _ in range(5):
        before = [np.full(len(every), x) for x in rng.integers(0, len(every), M.CONTEXT)]
        got = M.Scorer(shape, p)(every, before)
        assert abs((10.0 ** got.astype(float)).sum() - 1) < 1e-4
        assert np.allclose(got, [plain(shape, p, w, [b[0] for b in before]) for w in every], atol=1e-4)


def test_the_start_is_the_unigram_distribution():
    shape, _, rng = model()
    p = shape.start()
    w = rng.integers(0, len(shape.p), 500)
    assert np.allclose(M.Scorer(shape, p)(w, [w] * M.CONTEXT), np.log10(shape.p[w]), atol=1e-4)


def test_learning_approaches_the_conditional_distribution():
    rng = np.random.default_rng(1)
    chain = rng.dirichlet(np.full(40, 0.1), 40)
    ids = [0]
    for u in rng.random(120_000):
        ids.append(min(int(np.searchsorted(np.cumsum(chain[ids[-1]]), u)), 39))
    ids = np.array(ids)
    shape = M.Shape(np.bincount(ids, minlength=40), 0.0, 6)
    learner = M.Learner(shape, shape.start())
    before = M.contexts(ids, np.array([0]), 0)
    for lo in range(0, 100_000, 5_000):
        learner.learn(ids[lo : lo + 5_000], [b[lo : lo + 5_000] for b in before])
    test = slice(100_000, None)
    got = M.Scorer(shape, learner.p)(ids[test], [b[test] for b in before]).mean()
    best = np.log10(chain[before[0][test], ids[test]]).mean()
    assert got > np.log10(shape.p[ids[test]]).mean() + 0.6 * (best - np.log10(shape.p[ids[test]]).mean())


def test_contexts_end_at_texts():
    ids = np.array([5, 6, 0, 7, 0, 0])
    one, two = M.contexts(ids, np.array([0, 3, 5]), 0)
    assert one.tolist() == [0, 5, 6, 0, 7, 0] and two.tolist() == [0, 0, 5, 0, 0, 0]


def test_averages_weigh_what_was_seen():
    shape, p, _ = model(600)
    a, b = M.Learner(shape, p), M.Learner(shape, {k: v + 1 for k, v in p.items()})
    a.n, b.n, a.seen["r"][3], b.seen["r"][3], b.seen["q"][500] = 1, 3, 1, 3, 2
    sums = {}
    for x in (a, b):
        for i, v in M.blocks(x):
            sums[i] = sums.get(i, 0) + v
    got = M.averaged(p, sums)
    assert np.allclose(got["r"][3], p["r"][3] + 0.75, atol=1e-4) and np.allclose(got["C"], p["C"] + 0.75, atol=1e-4) and np.allclose(got["q"][500], p["q"][500] + 1, atol=1e-4)
    assert np.allclose(got["r"][4], p["r"][4]) and np.allclose(got["qb"][3], p["qb"][3])


def test_score_against_one_token_after_the_other(spark, docs, texts, monkeypatch):
    """The whole query's scores, from the model that it learned, written out for each text."""
    kept = {}
    train = M.train
    monkeypatch.setattr(M, "train", lambda d, words, shape: kept.setdefault("p", (words, shape, train(d, words, shape)))[2])
    got = {r.doc_id: r.score for r in M.score(docs, ["doc_id"], vocabulary=50, head=60, second=100, classes=5).collect()}
    words, shape, p = kept["p"]
    held = lambda d: zlib.crc32(str(d).encode()) % 5 == 1
    c = Counter(w for d, t in texts.items() if not held(d) for w in M.tokens((t or "").encode()))
    index, whole = {w: i for i, w in enumerate(words)}, sum(c.values()) + 0.5 * (len(c) + 1)
    rest = whole - sum(c[w] + 0.5 for w in words)
    scorer = M.Scorer(shape, p)
    for d, t in list(texts.items())[:60]:
        own, total = M.tokens((t or "").encode()), 0.0
        ids = [index.get(w, len(words)) for w in own]
        for j, w in enumerate(own):
            before = [np.array([ids[j - k] if j >= k else 0]) for k in range(1, M.CONTEXT + 1)]
            total += float(scorer(np.array([ids[j]]), before)[0]) + (math.log10((c[w] + 0.5) / rest) if w not in index else 0)
        assert abs(got[d] - total) < 1e-3 * max(1, abs(total))


def test_clashing_names_and_ties(spark):
    rows = [(i, "b a c d e", "x") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, word string")
    got = M.score(df, ["doc_id", "word"], vocabulary=3).collect()
    assert all(r.word == "x" and r.n_tokens == r.n_known == 6 and r.score < 0 for r in got)


def test_held_out_documents_score_higher(spark, sf):
    from clickloom.llm.queries import op10_lm_scoring

    r = [x for x in op10_lm_scoring(spark, sf.replace("0.001", "0.01")).collect() if x.held_out]
    gain = sum(x.score - x.base_score for x in r) / sum(x.n_tokens for x in r)
    assert gain > 0.08  # log10 a token, by four tasks of a few dozen batches each
