"""Language-model scoring: a log-bilinear model with noise-contrastive estimation.

Counts of all training tokens are gathered in a table.  The ``vocabulary`` most frequent
words and the end token have vectors; all others are one word to the model, which backs
off to their counts.  The context of a token is the ``CONTEXT`` words before it in its
text: h = sum of r(w) C(d) over the distances d.  Words are in classes of about equal
weight, and a class has the score h a + b, a word in its class h q + b.  Both are learned in
numpy by noise-contrastive estimation, against classes and words of the class drawn from the
unigram distribution.  One task learns a common start from ``WARM`` documents; from there every task
learns from all of its training tokens, and parameters are averaged, those of a word by how often
each task has seen it.  What is sent is as large as the model for each task.

For scoring, batched matrix products give the scores of all classes and of all words of the
token's class, which are normalised; a word without vectors has its class's probability times its
share of the smoothed unigram distribution of such words, which leaves half a count for unseen
ones, so that a text's score is a proper log-probability.

The ``head`` of frequent words is looked up where the text is, by their letters, and the next
``second`` by two hashes of 64 and 32 bits; for the others, if there are any, (row, word, times) is
joined to the counts, which can be of any size.

Nulls and empty texts are the end token alone.  Very long texts are scored whole.  Repeated
rows are learned from and scored each.  Words of equal count (ties) are in the order of their
bytes.  A NULL doc_id counts as the text ''.  With no training text at all, every word is unknown
and V is 0; empty tables give empty tables.  Extra columns are ignored; ``keep`` columns named like a
result column are replaced.
"""

from __future__ import annotations

import pickle

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER_BYTES, smallest, stage, text_chunks, with_text

END = b""  # no word is empty
VOCABULARY = 16_384  # words with vectors, the end token included
CLASSES = 128
WIDTH = 16  # of vectors
CONTEXT = 2  # words
NOISE = 16  # noise classes of a batch, and noise words of each of its classes
BATCH = 4_096  # tokens
TILE = 64  # tokens of one class in a matrix product
RATE = 0.2
WARM = 2_000  # documents, of the least hashes of doc_id, that the common start is learned from
HEAD = 150_000  # frequent words that are looked up without a shuffle
SECOND = 2_000_000  # the next ones, by hashes: 32 MB


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 1


def tokens(text: bytes | None) -> list[bytes]:
    words = text.translate(LOWER_BYTES).split() if text else []
    words.append(END)
    return words


def _texts(docs: DataFrame) -> DataFrame:
    return with_text(docs, [])


def token_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over all ``docs``; a task sends each word once in so many."""

    def run(batches):
        from collections import Counter

        import pyarrow as pa

        def out(c):
            return pa.RecordBatch.from_arrays([pa.array(list(c.keys()), pa.binary()), pa.array(list(c.values()), pa.int64())], names=["word", "n"])

        seen: Counter = Counter()
        for _, texts in text_chunks(batches, "_text", 2_000_000):
            for t in texts:
                seen.update(tokens(t))
            if len(seen) > 300_000:
                yield out(seen)
                seen = Counter()
        yield out(seen)

    return _texts(docs).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


def head_count(counts: DataFrame, most: int) -> int:
    """The least count such that ``most`` words at most have it or more, to 1/32 of itself: from
    a histogram of counts (a few hundred rows), so that no task ranks the words."""
    c = F.col("c")
    step = F.greatest(F.floor(F.log2(c.cast("double"))) - 5, F.lit(0))  # counts of 6 significant bits
    low = F.expr("shiftright(c, cast(greatest(floor(log2(cast(c as double))) - 5, 0) as int))")
    rows = counts.groupBy(low.alias("low"), step.cast("int").alias("step")).agg(F.count("*").alias("n")).collect()
    seen, least = 0, 1 << 62
    for at, n in sorted(((r.low << r.step, r.n) for r in rows), reverse=True):
        if seen + n > most:
            break
        seen, least = seen + n, at
    return least


# ---- the model


class Shape:
    """Unigram shares: of words 0 ... n - 1 (counts + 0.5), of all others as the word n, and classes, which
    are runs of words of about equal sums of square roots; the others are a class of their own."""

    def __init__(self, counts, rest: float, classes: int):
        import numpy as np

        self.p = np.append(np.asarray(counts, float) + 0.5, max(rest, 0.5))
        self.p /= self.p.sum()
        root = np.sqrt(self.p[:-1])
        cls = np.minimum((np.cumsum(root) / root.sum() - 1e-12) * classes, classes - 1).astype(np.int64)
        cls = np.unique(cls, return_inverse=True)[1]
        self.cls = np.append(cls, cls[-1] + 1)
        self.first = np.flatnonzero(np.diff(self.cls, prepend=-1))
        self.size = np.diff(np.append(self.first, len(self.cls)))
        self.pc = np.add.reduceat(self.p, self.first)
        self.pw = self.p / self.pc[self.cls]
        self.sums = np.concatenate(([0], np.cumsum(self.pw)))

    def start(self, seed: int = 3) -> dict:
        """Parameters at which the model is the unigram distribution."""
        import numpy as np

        rng = np.random.default_rng(seed)
        none = lambda n: np.zeros((n, WIDTH), np.float32)
        words, classes = len(self.p), len(self.pc)
        return {
            "r": (0.4 * rng.standard_normal((words, WIDTH))).astype(np.float32), "C": np.stack([np.eye(WIDTH) / CONTEXT] * CONTEXT).astype(np.float32), "a": none(classes), "ab": np.log(self.pc).astype(np.float32),
            "q": none(words), "qb": np.log(self.pw).astype(np.float32),
        }


def contexts(ids, starts, end: int) -> list:
    """For each distance the word before each token in its text; ``end`` before the first one."""
    import numpy as np

    n = np.diff(np.append(starts, len(ids)))
    place, out = np.arange(len(ids)) - np.repeat(starts, n), []
    for d in range(1, CONTEXT + 1):
        before = np.full(len(ids), end, ids.dtype)
        before[d:] = ids[:-d]
        before[place < d] = end
        out.append(before)
    return out


def gathered(rows, g, most: int):
    """(row, sum of ``g`` over it, how often it stands in ``rows``)."""
    import numpy as np

    order = np.argsort(rows.astype(np.uint16) if most < 1 << 16 else rows, kind="stable")
    s = rows[order]
    first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    return s[first], np.add.reduceat(g[order], first, axis=0), np.diff(np.append(first, len(s)))


class Learner:
    """Noise-contrastive estimation in mini-batches, with a rate for each row of the parameters (Adagrad)."""

    def __init__(self, shape: Shape, start: dict, seed: int = 1, sums: dict | None = None):
        """``sums``: of squared gradients, where learning goes on from another learner's parameters."""
        import numpy as np

        self.shape, self.p, self.n = shape, {k: v.copy() for k, v in start.items()}, 0
        sums = sums or {k: np.full(len(v) if k in "raq" else v.shape, 1e-2, np.float32) for k, v in start.items()}
        self.sum = {k: v.copy() for k, v in sums.items()}
        self.seen = {k: np.zeros(len(shape.p), np.float32) for k in "rq"}
        self.rng = np.random.default_rng(seed)

    def _step(self, k: str, rows, g) -> None:
        import numpy as np

        s = self.sum[k]
        s[rows] += (g * g).mean(1) if g.ndim > 1 else g * g
        rate = RATE / np.sqrt(s[rows])
        self.p[k][rows] -= rate[:, None] * g if g.ndim > 1 else rate * g

    def learn(self, ids, before) -> None:
        import numpy as np

        with np.errstate(over="ignore"):
            for lo in range(0, len(ids), BATCH):
                self._batch(ids[lo : lo + BATCH], [b[lo : lo + BATCH] for b in before])

    def _batch(self, w, before) -> None:
        """For a score s of what is drawn with share p among ``k`` noise draws, s - log(k p) is the logit of
        its being no noise."""
        import numpy as np

        s, p, k = self.shape, self.p, self.shape.cls[w]
        words, classes = len(s.p), len(s.pc)
        noise = lambda x: 1 / (1 + np.exp(-x))
        x = [p["r"][b] for b in before]
        h = sum(v @ c for v, c in zip(x, p["C"], strict=True))
        drawn = self.rng.choice(classes, NOISE, p=s.pc)
        lp = np.log(NOISE * s.pc).astype(np.float32)
        g = noise((h * p["a"][k]).sum(1) + p["ab"][k] - lp[k]) - 1
        gn = noise(h @ p["a"][drawn].T + (p["ab"][drawn] - lp[drawn]))
        dh = g[:, None] * p["a"][k] + gn @ p["a"][drawn]
        class_rows, da, _ = gathered(np.concatenate((k, drawn)), np.concatenate((np.column_stack((g[:, None] * h, g)), np.column_stack((gn.T @ h, gn.sum(0))))), classes)
        o = np.flatnonzero(s.size[k] > 1)
        o = o[np.argsort(k[o], kind="stable")]
        if len(o):
            ko, wo, ho = k[o], w[o], h[o]
            cls, first, count = np.unique(ko, return_index=True, return_counts=True)
            tiles = -(-count // TILE)
            tile = np.cumsum(tiles) - tiles
            slot = np.repeat(tile * TILE, count) + np.arange(len(o)) - np.repeat(first, count)
            ht, live = np.zeros((int(tiles.sum()) * TILE, WIDTH), np.float32), np.zeros(int(tiles.sum()) * TILE, np.float32)
            ht[slot], live[slot] = ho, 1
            ht, live = ht.reshape(-1, TILE, WIDTH), live.reshape(-1, TILE, 1)
            lo, hi = s.first[cls], s.first[cls] + s.size[cls]
            drawn = s.sums[lo][:, None] + self.rng.random((len(cls), NOISE)) * (s.sums[hi] - s.sums[lo])[:, None]
            drawn = np.clip(np.searchsorted(s.sums, drawn, "right") - 1, lo[:, None], hi[:, None] - 1)
            lp = np.log(NOISE * s.pw).astype(np.float32)
            g = noise((ho * p["q"][wo]).sum(1) + p["qb"][wo] - lp[wo]) - 1
            of = np.repeat(np.arange(len(cls)), tiles)
            qn, bn = p["q"][drawn][of], (p["qb"][drawn] - lp[drawn])[of]
            gn = noise(ht @ qn.transpose(0, 2, 1) + bn[:, None, :]) * live
            dh[o] += (gn @ qn).reshape(-1, WIDTH)[slot] + g[:, None] * p["q"][wo]
            dq = np.add.reduceat(gn.transpose(0, 2, 1) @ ht, tile, axis=0).reshape(-1, WIDTH)
            db = np.add.reduceat(gn.sum(1), tile, axis=0).ravel()
            rows, dq, _ = gathered(np.concatenate((wo, drawn.ravel())), np.concatenate((np.column_stack((g[:, None] * ho, g)), np.column_stack((dq, db)))), words)
            self._step("q", rows, dq[:, :-1])
            self._step("qb", rows, dq[:, -1])
            self.seen["q"] += np.bincount(wo, minlength=words)
        self._step("a", class_rows, da[:, :-1])
        self._step("ab", class_rows, da[:, -1])
        rows, dr, count = gathered(np.concatenate(before), np.concatenate([dh @ c.T for c in p["C"]]), words)
        dc = np.stack([v.T @ dh for v in x])
        self._step("r", rows, dr)
        self.seen["r"][rows] += count
        self.sum["C"] += dc * dc
        p["C"] -= 0.1 * RATE * dc / np.sqrt(self.sum["C"])
        self.n += len(w)


BLOCK = 256  # words of a block of parameters


def blocks(learner: Learner):
    """[(number, numbers that add up over tasks)]: -1 what all words share, then blocks of words."""
    import numpy as np

    p, r, q = learner.p, learner.seen["r"], learner.seen["q"]
    out = [(-1, np.append(np.concatenate([p[k].ravel() for k in ("C", "a", "ab")]) * learner.n, learner.n))]
    rows = np.column_stack((p["r"] * r[:, None], p["q"] * q[:, None], p["qb"] * q, r, q))
    return out + [(i // BLOCK, rows[i : i + BLOCK].ravel()) for i in range(0, len(rows), BLOCK) if r[i : i + BLOCK].any() or q[i : i + BLOCK].any()]


def averaged(start: dict, sums: dict) -> dict:
    """The parameters' means over tasks; what no task has seen stays as it was at the start."""
    import numpy as np

    p = {k: v.copy() for k, v in start.items()}
    for i, v in sums.items():
        if i < 0:
            at, v = 0, v / max(v[-1], 1)
            for k in ("C", "a", "ab"):
                p[k] = v[at : at + p[k].size].reshape(p[k].shape).astype(np.float32)
                at += p[k].size
        else:
            v = v.reshape(-1, 2 * WIDTH + 3)
            rows = np.arange(i * BLOCK, i * BLOCK + len(v))
            for k, cols, n in (("r", slice(0, WIDTH), v[:, -2]), ("q", slice(WIDTH, 2 * WIDTH), v[:, -1]), ("qb", 2 * WIDTH, v[:, -1])):
                some = n > 0
                mean = v[some, cols] / (n[some][:, None] if k != "qb" else n[some])
                p[k][rows[some]] = mean.astype(np.float32)
    return p


def train(docs: DataFrame, words: list[bytes], shape: Shape) -> dict:
    """Parameters learned from all tokens of ``docs``; ``words``: those with vectors, END first."""
    import numpy as np

    sc = docs.sparkSession.sparkContext
    sent = sc.broadcast((words, shape, shape.start(), None))  # as large as the model

    def learner_of(batches, seed):
        import itertools

        words, shape, start, sums = sent.value
        index, learner = {w: i for i, w in enumerate(words)}, Learner(shape, start, seed, sums)
        for _, texts in text_chunks(batches, "_text", 2_000_000):
            split = [tokens(t) for t in texts]
            n = np.fromiter(map(len, split), np.int64, len(split))
            ids = np.fromiter(map(index.get, itertools.chain.from_iterable(split), itertools.repeat(len(words))), np.int64, int(n.sum()))
            learner.learn(ids, contexts(ids, np.cumsum(n) - n, 0))
        return learner

    def first(batches):
        import pyarrow as pa

        learner = learner_of(batches, 0)
        if learner.n:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((learner.p, learner.sum))], pa.binary())], names=["learner"])

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        learner = learner_of(batches, pid + 1)
        if learner.n:
            out = blocks(learner)
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in out], pa.int32()), pa.array([pid] * len(out), pa.int32()), pa.array([v.astype(np.float32).tobytes() for _, v in out], pa.binary())], names=["block", "pid", "sums"])

    def add(batches):
        import pyarrow as pa

        at, total = None, None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["block", "sums"])
        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                v = np.frombuffer(v, np.float32)
                if i != at:
                    if at is not None:
                        yield row()
                    at, total = i, np.zeros(len(v))
                total += v
        if at is not None:
            yield row()

    warm = smallest(docs.select("text", F.xxhash64("doc_id").alias("_x")), "_x", WARM)  # in one task
    for r in _texts(warm.coalesce(1)).mapInArrow(first, "learner binary").collect():
        sent = sc.broadcast((words, shape, *pickle.loads(r.learner)))
    start = sent.value[2]
    parts = _texts(docs).mapInArrow(run, "block int, pid int, sums binary")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = parts.repartition(n, "block").sortWithinPartitions("block", "pid").mapInArrow(add, "block int, sums binary").collect()  # the model, once
    return averaged(start, {r.block: np.frombuffer(r.sums) for r in found})


class Scorer:
    """Normalised log10 probabilities of words after their contexts."""

    def __init__(self, shape: Shape, p: dict):
        import numpy as np

        self.shape = shape
        self.near = [p["r"] @ c for c in p["C"]]
        self.a, self.ab = np.ascontiguousarray(p["a"].T), p["ab"]
        ends = list(zip(shape.first.tolist(), shape.size.tolist(), strict=True))
        self.words = [(np.ascontiguousarray(p["q"][i : i + n].T), p["qb"][i : i + n]) for i, n in ends]

    @staticmethod
    def _share(h, table, at):
        """Log of the normalised scores at ``at``."""
        import numpy as np

        z = h @ table[0]
        z += table[1]
        if z.max(initial=0) > 60:
            z -= z.max(1, keepdims=True)
        found = z[np.arange(len(z)), at]
        np.exp(z, out=z)
        return found - np.log(z.sum(1))

    def __call__(self, w, before, part: int = 8_192):
        import numpy as np

        s, k = self.shape, self.shape.cls[w]
        h, out = np.empty((len(w), WIDTH), np.float32), np.empty(len(w), np.float32)
        for lo in range(0, len(w), part):
            some = slice(lo, lo + part)
            x = h[some]
            np.take(self.near[0], before[0][some], axis=0, out=x)
            for near, b in zip(self.near[1:], before[1:], strict=True):
                x += near[b[some]]
            out[some] = self._share(x, (self.a, self.ab), k[some])
        order = np.argsort(k.astype(np.uint16), kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(k[order])) + 1) if len(order) else ():
            c = k[own[0]]
            for lo in range(0, len(own), part) if s.size[c] > 1 else ():
                some = own[lo : lo + part]
                out[some] += self._share(h[some], self.words[c], w[some] - s.first[c])
        return out / np.float32(np.log(10))


def score(docs: DataFrame, keep: list[str], vocabulary: int = VOCABULARY, head: int = HEAD, second: int = SECOND, classes: int = CLASSES) -> DataFrame:
    """``keep`` columns (with doc_id), held_out, n_tokens, n_known, train_tokens, base_score, score."""
    import numpy as np

    spark = docs.sparkSession
    own = ("held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    keep = [c for c in keep if c not in own]
    learned = docs.where(~held_out())
    counts = stage(token_counts(learned), "counts")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.coalesce(F.sum(F.when(F.col("word") == F.lit(END), F.col("c"))), F.lit(0)).alias("end")).first()
    whole = total.n + 0.5 * (total.v + 1)
    least, less = head_count(counts, head), head_count(counts, head + second)
    top = counts.where(F.col("c") >= least).toArrow()  # HEAD rows at most
    words, c = top.column("word").to_pylist(), top.column("c").to_numpy().astype(np.int64)
    order = [i for i in sorted(range(len(words)), key=lambda i: (-c[i], words[i])) if words[i] != END]
    words, c = [END, *(words[i] for i in order)], np.concatenate(([total.end], c[order]))
    n_own = min(vocabulary, len(words))
    rest = whole - float((c[:n_own] + 0.5).sum())
    shape = Shape(c[:n_own], rest, classes)
    p = train(learned, words[:n_own], shape)
    next_ = counts.where((F.col("c") < least) & (F.col("c") >= less) & (F.col("word") != F.lit(END)))
    next_ = next_.select(F.xxhash64("word").alias("h"), F.crc32("word").alias("x"), "c").toArrow()  # SECOND rows at most, 20 bytes each
    h = next_.column("h").to_numpy()
    order = np.argsort(h, kind="stable")
    hashed = (h[order], next_.column("x").to_numpy()[order].astype(np.uint32), next_.column("c").to_numpy()[order].astype(np.int64))
    base = np.log10((c + 0.5) / whole)
    off = float(np.log10(max(rest, 0.5) / whole))  # the share of all words without vectors
    sent = spark.sparkContext.broadcast((words, base, shape, p, hashed, off))  # bounded by head, second, and the model
    kept = [docs.schema[k] for k in keep]
    more = [T.StructField("n_tokens", T.LongType()), T.StructField("_known", T.LongType()), T.StructField("_base", T.DoubleType()), T.StructField("_lbl", T.DoubleType()), T.StructField("_tail", T.ArrayType(T.BinaryType())), T.StructField("_times", T.ArrayType(T.IntegerType()))]
    schema = T.StructType([*kept, *more])
    known_end, all_there, unseen = total.end > 0, less <= 1 or not total.v, float(np.log10(0.5 / whole))

    def run(batches):
        import itertools
        import zlib
        from collections import Counter

        import pyarrow as pa
        import xxhash

        words, base, shape, p, (hs, xs, cs), off = sent.value
        index, scorer = {w: i for i, w in enumerate(words)}, Scorer(shape, p)
        n_head, n_own = len(words), len(shape.p) - 1
        base = np.append(base, 0.0)
        for part, texts in text_chunks(batches, "_text", 2_000_000):
            split = [tokens(t) for t in texts]
            n = np.fromiter(map(len, split), np.int64, len(split))
            flat = list(itertools.chain.from_iterable(split))
            starts = np.cumsum(n) - n
            at = np.fromiter(map(index.get, flat, itertools.repeat(n_head)), np.int64, len(flat))
            k = np.minimum(at, n_own)
            lp = scorer(k, contexts(k, starts, 0)).astype(np.float64)
            lp -= np.where(k == n_own, off, 0.0)  # their base follows
            known, b = at < n_head, base[at]
            if not known_end:
                known &= at > 0
            miss = np.flatnonzero(at == n_head)
            missed = [flat[i] for i in miss.tolist()]
            which: dict = {}
            nth = np.fromiter((which.setdefault(w, len(which)) for w in missed), np.int64, len(missed))
            value, state = np.zeros(len(which)), np.zeros(len(which), np.int8)  # 1: known, 2: still to be joined
            if which:
                mine = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in which), np.uint64, len(which)).view(np.int64)
                crc = np.fromiter(map(zlib.crc32, which), np.uint32, len(which))
                i = np.searchsorted(hs, mine)
                found = np.zeros(len(which), bool)
                if len(hs):
                    i = np.minimum(i, len(hs) - 1)
                    found = (hs[i] == mine) & (xs[i] == crc)
                    value[found] = np.log10((cs[i[found]] + 0.5) / whole)
                state[found] = 1
                if all_there:
                    value[~found] = unseen
                else:
                    state[~found] = 2
                b[miss] = value[nth]
                known[miss] = state[nth] == 1
            lp += np.where(k == n_own, b, 0.0)
            late = np.flatnonzero(state[nth] == 2) if which else np.zeros(0, np.int64)
            cut = np.searchsorted(miss[late], np.append(starts, len(flat)))
            tails, times = [], []
            for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                mine = Counter(missed[j] for j in late[lo:hi].tolist())
                tails.append(list(mine.keys()))
                times.append(list(mine.values()))
            add = lambda x: np.add.reduceat(x, starts)
            yield pa.RecordBatch.from_arrays(
                [*(part.column(i) for i in range(len(keep))), pa.array(n), pa.array(add(known.astype(np.int64))), pa.array(add(b)), pa.array(add(lp)), pa.array(tails, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int32()))],
                names=[f.name for f in schema],
            )

    rows = with_text(docs, keep).mapInArrow(run, schema)
    zero = lambda name, kind: F.coalesce(name, F.lit(0).cast(kind))
    if all_there:
        out = rows.withColumn("_tail_known", F.lit(0).cast("long")).withColumn("_tail_base", F.lit(0.0))
    else:
        rows = stage(rows.withColumn("_row", F.monotonically_increasing_id()), "scored")
        tail = rows.where(F.size("_tail") > 0).select("_row", F.explode(F.arrays_zip("_tail", "_times")).alias("t")).select("_row", F.col("t._tail").alias("word"), F.col("t._times").alias("n"))
        joined = tail.join(counts.where(F.col("c") < less), "word", "left")
        lp = F.log10((F.coalesce("c", F.lit(0)) + 0.5) / F.lit(whole))
        sums = joined.groupBy("_row").agg(F.sum(F.col("n") * lp).alias("_tail_base"), F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("_tail_known"))
        out = rows.drop("_tail", "_times").join(sums, "_row", "left")
    return out.select(
        *keep, held_out().alias("held_out"), "n_tokens", (F.col("_known") + zero("_tail_known", "long")).alias("n_known"), F.lit(total.n).cast("long").alias("train_tokens"),
        (F.col("_base") + zero("_tail_base", "double")).alias("base_score"), (F.col("_lbl") + zero("_tail_base", "double")).alias("score"),
    )
