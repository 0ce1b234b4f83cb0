import zlib

import numpy as np
import pytest

from clickloom.llm import mil_classifier as C


def test_gradient():
    """Training lowers the loss as its gradients say."""
    rng = np.random.default_rng(1)
    n = rng.integers(1, 6, 200)
    starts = np.concatenate(([0], np.cumsum(n)[:-1]))
    x = rng.standard_normal((n.sum(), C.WIDTH)).astype(np.float32)
    y = (np.maximum.reduceat(x[:, 0], starts) > 1).astype(np.float32)
    m = C.Model().train(x, starts, y, epochs=60)
    assert ((m.score(x, starts) > 0.5) == y).mean() > 0.9


def test_chunks_do_not_matter():
    texts = [b"One two " * 100, None, b"", b" \n", "Été %%%".encode(), b"x"]
    x, n = C.encode(texts)
    parts = [C.encode([t]) for t in texts]
    assert n.tolist() == [int(p[1][0]) for p in parts] == [4, 1, 1, 1, 1, 1]
    assert np.allclose(x, np.concatenate([p[0] for p in parts]))


def test_odd_rows(spark, odd, odd_rows, labels):
    model = C.fit(odd, labels)
    got = C.score(odd, model, ["doc_id"]).collect()
    assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 for r in got)
    alone = C.fit(odd, labels.where("false"))
    assert {r.score for r in C.score(odd, alone, ["doc_id"]).collect()} == {0.5}
    assert C.score(odd.where("false"), model, ["doc_id"]).count() == 0


def test_held_out_accuracy(spark, sf):
    from clickloom.llm.queries import op7_quality_classifier

    sf = sf.replace("0.001", "0.01")
    got = op7_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    for q, want in ((0, 0), (1, 1)):
        own = [r.predicted == want for r in got if r.held_out and r.quality == q]
        assert np.mean(own) >= 0.9
    assert all(r.predicted == int(r.score >= 0.7) for r in got)


def test_labels_of_held_out_rows_are_not_used(spark, docs, sf):
    known = spark.read.parquet(f"{sf}/labels.parquet")
    a = C.fit(docs, known)
    b = C.fit(docs, known.where(~C.held_out()))
    assert all(np.array_equal(a.p[k], b.p[k]) for k in a.p)
    with pytest.raises(AssertionError):
        assert np.array_equal(a.p["c"], C.fit(docs, known.limit(20)).p["c"])


def test_scores_against_one_document_after_the_other(spark, docs, sf, texts):
    """The gated attention written out for a document's passages, which are encoded alone."""
    model = C.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    p, sigmoid = {k: v.astype(float) for k, v in model.p.items()}, lambda z: 1 / (1 + np.exp(-z))
    got = {r.doc_id: r.score for r in C.score(docs, model, ["doc_id"]).collect()}
    for d, t in texts.items():
        words, rows = (t or "").encode().split(), []
        for i in range(0, max(len(words), 1), C.PASSAGE):
            x = C.encode([b" ".join(words[i : i + C.PASSAGE])])[0][0].astype(float)
            share, x = x[C.SHARE], (x - model.mean) / model.scale
            x[C.SHARE + 1 :] *= share
            x[C.SHARE] = 0
            rows.append(np.tanh(x @ p["W"] + p["Wb"]))
        e = [float((np.tanh(h @ p["V"]) * sigmoid(h @ p["U"])) @ p["w"]) for h in rows]
        a = np.exp(np.array(e) - max(e))
        z = sum(k * h for k, h in zip(a / a.sum(), rows, strict=True))
        assert abs(got[d] - sigmoid(z @ p["c"] + p["b"][0])) < 1e-3


def test_weights_stand_for_all_labelled_documents(spark):
    rows = [(i, "good words here " * 30 if i % 4 else "$$ %% ## " * 30, int(i % 4 > 0)) for i in range(800)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, quality int")
    for most in (40, 4000):
        s = {r.doc_id: r.score for r in C.score(docs, C.fit(docs, labels, max_docs=most), ["doc_id"]).collect()}
        assert all((s[i] > 0.7) == bool(q) for i, _, q in rows)


def test_long_and_clashing(spark, labels):
    docs = spark.createDataFrame([(1, "a b c d " * 50_000, "x", 2.0), (2, None, "y", 3.0)], "doc_id bigint, text string, label string, score double")
    got = C.score(docs, C.fit(docs, labels), ["doc_id", "label", "score"]).collect()
    assert [r.label for r in sorted(got)] == ["x", "y"] and all(0 <= r.score <= 1 for r in got)
