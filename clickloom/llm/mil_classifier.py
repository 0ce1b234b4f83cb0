"""Quality classifier: gated-attention multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words.  Every passage of the whole
text is encoded (character-class rates, repetition and a hashed bag of words), a
numpy network embeds it, gated attention weighs the embeddings, and the weighted
mean gives the document's score.  Only document labels are needed.

Nulls and texts without words: one passage with zero features, so they get a score
too.  Very long texts are scored whole.  Repeated rows are scored alike; of labelled rows that
share a doc_id one is learned from, and ties of sampling go by doc_id.  Without labelled rows, or with
labels of one class only, every score is the share of that class (0.5 if there is none).  Empty tables
give empty tables.  Extra columns are ignored; a ``keep`` column named score is replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import clean_labels, smallest, text_chunks, with_text

PASSAGE = 64  # words
MOST_PASSAGES = 64  # of a document to learn from, evenly spaced over its text: bounds what the driver gets to 110 MB
BUCKETS = 96  # of the hashed bag of words
CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"#*$%&|<>", b"!?", b".,;:'\"()-", bytes(range(128, 256)))
SHARE = len(CLASSES) + 2  # the column that has the passage's words as a share of PASSAGE; no feature
WIDTH = SHARE + 1 + BUCKETS
BAG_WEIGHT = 0.3  # of the bag's features beside the rates, in standard deviations


class _Bucket(dict):
    """A word's bucket, by CRC-32 of its lower-case form without marks."""

    def __missing__(self, word):
        import zlib

        if len(self) > 500_000:
            self.clear()
        self[word] = b = zlib.crc32(word.lower().strip(b".,;:!?")) % BUCKETS
        return b


def encode(texts: list[bytes | None], buckets: dict | None = None):
    """(features of all passages, number of passages of each text), at numpy speed."""
    import numpy as np

    buckets = _Bucket() if buckets is None else buckets
    joined = b"\n".join(t or b"" for t in texts)
    raw = np.frombuffer(joined, np.uint8)
    sizes = np.fromiter((len(t or b"") for t in texts), np.int64, len(texts))
    begin = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    white = np.zeros(256, bool)
    white[[32, 9, 10, 11, 12, 13]] = True
    solid = ~white[raw]
    starts = np.flatnonzero(solid & np.concatenate(([True], ~solid[:-1]))) if len(raw) else np.zeros(0, np.int64)
    first = np.searchsorted(starts, begin)  # each text's first word
    words = np.diff(np.concatenate((first, [len(starts)])))
    count = np.maximum(1, -(-words // PASSAGE))
    x = np.zeros((int(count.sum()), WIDTH), np.float32)
    if not len(starts):
        return x, count
    row0 = np.concatenate(([0], np.cumsum(count)[:-1]))
    owner = np.repeat(np.arange(len(texts)), words)
    row = row0[owner] + (np.arange(len(starts)) - first[owner]) // PASSAGE
    heads = np.flatnonzero(np.concatenate(([True], np.diff(row) > 0)))
    rows, cut = row[heads], starts[heads]
    n_words = np.diff(np.concatenate((heads, [len(starts)])))
    chars = np.add.reduceat(solid, cut, dtype=np.int64).astype(np.float32)
    for j, c in enumerate(CLASSES):
        table = np.zeros(256, bool)
        table[list(c)] = True
        x[rows, j] = np.add.reduceat(table[raw], cut, dtype=np.int64) / chars
    split = joined.split()
    bucket = np.fromiter(map(buckets.__getitem__, split), np.int64, len(split))
    bag = np.bincount(row * BUCKETS + bucket, minlength=len(x) * BUCKETS).reshape(len(x), BUCKETS)[rows]
    k = len(CLASSES)
    x[rows, k] = chars / n_words / 10
    same = np.concatenate(([False], (bucket[1:] == bucket[:-1]) & (row[1:] == row[:-1])))
    x[rows, k + 1] = np.add.reduceat(same, heads, dtype=np.int64) / n_words
    x[rows, SHARE] = n_words / PASSAGE
    x[rows, SHARE + 1 :] = np.sqrt(bag / n_words[:, None])
    return x, count


class Model:
    """z = sum a_k h_k with h = tanh(W x), a = softmax(w (tanh(V h) * sigmoid(U h))); score = sigmoid(c z + b)."""

    def __init__(self, seed: int = 7, hidden: int = 24, gate: int = 12):
        import numpy as np

        r = np.random.default_rng(seed)
        f = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"W": f(WIDTH, hidden), "Wb": np.zeros(hidden, np.float32), "V": f(hidden, gate), "U": f(hidden, gate), "w": f(gate), "c": f(hidden), "b": np.zeros(1, np.float32)}
        self.mean, self.scale, self.constant = np.zeros(WIDTH, np.float32), np.ones(WIDTH, np.float32), None

    def forward(self, x, starts):
        import numpy as np

        p = self.p
        share = x[:, SHARE : SHARE + 1]
        x = (x - self.mean) / self.scale
        x[:, SHARE + 1 :] *= share  # the bag of a short passage says little
        x[:, SHARE] = 0
        h = np.tanh(x @ p["W"] + p["Wb"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * g) @ p["w"]
        n = np.diff(np.append(starts, len(x)))
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), n))
        a = e / np.repeat(np.add.reduceat(e, starts), n)
        z = np.add.reduceat(a[:, None] * h, starts)
        s = 1 / (1 + np.exp(-(z @ p["c"] + p["b"][0])))
        return s, (x, h, t, g, a, z, n)

    def score(self, x, starts):
        import numpy as np

        if self.constant is not None:
            return np.full(len(starts), self.constant, np.float64)
        return self.forward(x, starts)[0].astype(np.float64)

    def train(self, x, starts, y, weight=None, epochs: int = 25, batch: int = 256, rate: float = 5e-3, decay: float = 1e-4, seed: int = 7):
        """Adam on the cross-entropy of the documents' labels, each with its ``weight``."""
        import numpy as np

        self.mean, self.scale = x.mean(0), x.std(0) + 1e-2
        self.scale[-BUCKETS:] /= BAG_WEIGHT
        n, r, m, v, step = np.diff(np.append(starts, len(x))), np.random.default_rng(seed), {}, {}, 0
        p = self.p
        for _ in range(epochs):
            for ids in np.array_split(r.permutation(len(y)), max(1, len(y) // batch)):
                rows = np.concatenate([np.arange(starts[i], starts[i] + n[i]) for i in ids])
                at = np.concatenate(([0], np.cumsum(n[ids])[:-1]))
                s, (xs, h, t, g, a, z, k) = self.forward(x[rows], at)
                d = (s - y[ids]) / len(ids) * (1 if weight is None else weight[ids])
                dz = d[:, None] * p["c"]
                dzr = np.repeat(dz, k, 0)
                da = (dzr * h).sum(1)
                de = a * (da - np.repeat(np.add.reduceat(a * da, at), k))
                dt, dg = de[:, None] * p["w"] * g * (1 - t * t), de[:, None] * p["w"] * t * g * (1 - g)
                dh = (a[:, None] * dzr + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
                grads = {"W": xs.T @ dh, "Wb": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de, "c": z.T @ d, "b": np.array([d.sum()])}
                step += 1
                for key, q in grads.items():
                    q = q + decay * p[key]
                    m[key] = 0.9 * m.get(key, 0) + 0.1 * q
                    v[key] = 0.999 * v.get(key, 0) + 0.001 * q * q
                    p[key] -= (rate * (m[key] / (1 - 0.9**step)) / (np.sqrt(v[key] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


def held_out(doc_id="doc_id"):
    """True for the rows that labels are never learned from; a NULL doc_id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = 4_000, seed: int = 7) -> Model:
    """Learn from at most ``max_docs`` labelled documents that aren't held out: half of
    them at most of either label, those of the smallest hash of doc_id.  Each weighs as many
    labelled documents as it stands for, so the labels' shares are the same at any size.  A few words
    out of each document of label 1 are learned as a document of that label, too: a text isn't bad
    for being short."""
    import numpy as np

    known = clean_labels(labels).where(~held_out()).withColumn("_h", F.xxhash64("doc_id"))
    ids, share = None, []
    for label in (0, 1):
        part = smallest(known.where(F.col("label") == label), "_h", max_docs // 2, "doc_id").select("doc_id", "label")
        share.append(known.where(F.col("label") == label).count())
        ids = part if ids is None else ids.unionAll(part)
    schema = T.StructType([T.StructField("label", T.IntegerType()), T.StructField("h", T.LongType()), T.StructField("x", T.BinaryType())])

    def run(batches):
        import pyarrow as pa

        for part, texts in text_chunks(batches, "text"):
            label, h = part.column(0).to_pylist(), part.column(1).to_pylist()
            for i in range(len(texts)):
                words = (texts[i] or b"").split()
                if label[i] == 1 and len(words) > 1:
                    r = np.random.default_rng(h[i] & 0xFFFFFFFF)
                    size = int(r.integers(1, 41))
                    at = int(r.integers(0, max(1, len(words) - size + 1)))
                    texts.append(b" ".join(words[at : at + size]))
                    label.append(1)
                    h.append(h[i])
            x, n = encode(texts)
            some = [v if len(v) <= MOST_PASSAGES else v[np.linspace(0, len(v) - 1, MOST_PASSAGES).astype(int)] for v in np.split(x, np.cumsum(n)[:-1])]
            yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(h, pa.int64()), pa.array([v.tobytes() for v in some], pa.binary())], names=["label", "h", "x"])

    rows = (
        docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
        .groupBy("doc_id", "label").agg(F.min("text").alias("text"))  # one of rows that share a doc_id
        .select("label", F.xxhash64("text").alias("h"), "text").mapInArrow(run, schema).collect()
    )
    rows = sorted(rows, key=lambda r: (r.h, r.label, bytes(r.x)))
    model = Model(seed)
    y = np.array([r.label for r in rows], np.float32)
    if len(set(y.tolist())) < 2:
        model.constant = float(y.mean()) if len(y) else 0.5
        return model
    each = np.array([share[k] / max((y == k).sum() if k == 0 else (y == k).sum() / 2, 1) for k in (0, 1)], np.float32)
    weight = each[y.astype(int)]
    bags = [np.frombuffer(r.x, np.float32).reshape(-1, WIDTH) for r in rows]
    starts = np.concatenate(([0], np.cumsum([len(b) for b in bags])[:-1]))
    return model.train(np.concatenate(bags), starts, y, weight / weight.mean())


def score(docs: DataFrame, model: Model, keep: list[str], out: str = "score") -> DataFrame:
    """``keep`` columns and the score of every whole text; one pass, no shuffle."""
    keep = [c for c in keep if c != out]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(out, T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(vars(model))  # of fixed size

    def run(batches):
        import numpy as np
        import pyarrow as pa

        buckets, model = _Bucket(), Model.__new__(Model)
        vars(model).update(sent.value)
        for part, texts in text_chunks(batches, "_text"):
            x, n = encode(texts, buckets)
            s = model.score(x, np.concatenate(([0], np.cumsum(n)[:-1])))
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), pa.array(s, pa.float64())], names=[*keep, out])

    return with_text(docs, keep).mapInArrow(run, schema)
