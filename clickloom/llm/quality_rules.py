"""Quality rules: a learned decision list over text statistics.

:func:`text_stats` gives each row its statistics, :func:`learn` grows and prunes
threshold conjunctions by sequential covering, and :class:`DecisionList` turns
them into one ordered ``CASE WHEN`` expression that Spark runs inside codegen.

Nulls, empty texts: no words, all statistics 0.  Repeated rows are rows of their
own; of labelled rows that share a doc_id one is learned from, and ties of information gain
go to the first feature.  Very long texts are read whole.  An empty table, or labels of one class
only, gives an empty list, which keeps all that the base rules keep.  Input columns named
like a statistic are replaced, other columns stay as they are.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Numbering, clean_labels, smallest, text_chunks, with_text

#: Fixed by the contract of the statistics.
SYMBOLS = b"#*$%&|<>"
WHITE = b" \t\n\x0b\x0c\r"
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_lower", "n_marks", "n_lines")


def repeat_words(ids) -> int:
    """Words inside a 3-word window that the sequence ``ids`` has twice or more."""
    import numpy as np

    if len(ids) < 4:
        return 0
    n = int(ids.max()) + 1
    if n < 1 << 21:
        code = (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]
    else:
        code = np.unique(ids[:-2] * n + ids[1:-1], return_inverse=True)[1] * n + ids[2:]
    order = np.argsort(code, kind="stable")
    same = np.diff(code[order]) == 0
    if not same.any():
        return 0
    hit = np.zeros(len(ids), bool)
    w = np.concatenate((order[1:][same], order[:-1][same]))
    for k in range(3):
        hit[w + k] = True
    return int(hit.sum())


def stats_of(text: bytes | None) -> tuple[int, ...]:
    """The values of ``STATS`` for one text in UTF-8."""
    import numpy as np

    if not text:
        return (0,) * len(STATS)
    words = text.split()
    if not words:
        return (0,) * (len(STATS) - 1) + (text.count(b"\n") + 1,)
    solid = text.translate(None, WHITE)
    number = Numbering()
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    gone = lambda chars: len(text) - len(text.translate(None, chars))
    return (
        len(words), len(solid.decode("utf-8", "replace")), gone(SYMBOLS), len(lines) - len(set(lines)),
        repeat_words(ids), gone(UPPER), gone(LOWER), gone(b"!?"), text.count(b"\n") + 1,
    )


def text_stats(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns and ``STATS`` (all long), one row for each row of ``docs``."""
    keep = [c for c in keep if c not in STATS]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(c, T.LongType()) for c in STATS])

    def run(batches):
        import pyarrow as pa

        for part, texts in text_chunks(batches, "_text"):
            rows = list(zip(*map(stats_of, texts), strict=True))
            yield pa.RecordBatch.from_arrays(
                [part.column(i) for i in range(len(keep))] + [pa.array(x, pa.int64()) for x in rows], names=[*keep, *STATS]
            )

    return with_text(docs, keep, text).mapInArrow(run, schema)


def features() -> dict[str, Column]:
    """What rules may test: ratios, so that a threshold means the same for any length."""
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "symbol_ratio": F.col("n_symbols") / chars,
        "repeat_ratio": F.col("n_repeat_words") / words,
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "upper_ratio": F.col("n_upper") / F.greatest(F.col("n_upper") + F.col("n_lower"), F.lit(1)),
        "mark_ratio": F.col("n_marks") / words,
        "word_length": F.col("word_chars") / words,
    }


@dataclass
class Rule:
    """``all`` of (feature, op, threshold) hold; op is ``>=`` or ``<``."""

    tests: list[tuple[str, str, float]]
    covered: int = 0
    precision: float = 0.0

    def __str__(self) -> str:
        return " AND ".join(f"{f} {op} {v:.6g}" for f, op, v in self.tests) or "TRUE"


@dataclass
class DecisionList:
    """Ordered rules that reject; what no rule covers is kept."""

    rules: list[Rule] = field(default_factory=list)

    def verdict(self) -> Column:
        """The number of the first rule that holds, from 1; 0 if none does."""
        cols, out = features(), None
        for n, rule in enumerate(self.rules, 1):
            cond = F.lit(True)
            for f, op, v in rule.tests:
                cond = cond & (cols[f] >= F.lit(v) if op == ">=" else cols[f] < F.lit(v))
            out = F.when(cond, n) if out is None else out.when(cond, n)
        return F.lit(0) if out is None else out.otherwise(0)


def merged(tests: list[tuple[str, str, float]]) -> list[tuple[str, str, float]]:
    """One test for each feature and direction: the strictest."""
    out: dict[tuple[str, str], float] = {}
    for f, op, v in tests:
        old = out.get((f, op), v)
        out[f, op] = max(old, v) if op == ">=" else min(old, v)
    return [(f, op, v) for (f, op), v in out.items()]


def learn(x, bad, fold, names: list[str], max_tests: int = 3, min_precision: float = 0.9, min_cover: int = 5) -> DecisionList:
    """Sequential covering: ``x`` (rows, features), ``bad`` bool, ``fold`` True for rows
    that grow rules; the others prune them.

    A rule grows by the test of highest information gain, then loses its last tests
    as long as that doesn't lower (p - n) / (p + n) on the pruning rows, and is
    accepted if its precision on them is at least ``min_precision``.  After a rule
    that isn't, the next one begins with another feature and direction, until none is left.
    Every threshold between two values is tried.
    """
    import numpy as np

    out, left = DecisionList(), np.ones(len(x), bool)
    refused: set[tuple[str, str]] = set()
    while True:
        grow, prune = left & fold, left & ~fold
        if (bad & grow).sum() < min_cover or not (bad & prune).any():
            break
        rule, on = [], grow.copy()
        while len(rule) < max_tests and (~bad & on).any():
            p0, n0 = (bad & on).sum(), (~bad & on).sum()
            base, best = np.log2(p0 / (p0 + n0)), (1e-9, None, None)
            for j, f in enumerate(names):
                v = x[on, j]
                order = np.argsort(v, kind="stable")
                v, b = v[order], bad[on][order]
                at = np.flatnonzero(np.diff(v) > 0) + 1  # a cut before each of these rows
                pos = np.concatenate(([0], np.cumsum(b)))
                for op, p, size in (("<", pos[at], at), (">=", pos[-1] - pos[at], len(v) - at)):
                    if not rule and (f, op) in refused:
                        continue
                    with np.errstate(divide="ignore", invalid="ignore"):
                        gain = np.where(p > 0, p * (np.log2(p / size) - base), -1)
                    if len(gain) and gain[k := int(gain.argmax())] > best[0]:
                        best = (gain[k], (f, op, float((v[at[k] - 1] + v[at[k]]) / 2)), j)
            if best[1] is None:
                break
            rule.append(best[1])
            on &= x[:, best[2]] >= best[1][2] if best[1][1] == ">=" else x[:, best[2]] < best[1][2]
        col = {f: j for j, f in enumerate(names)}

        def covers(tests):
            m = np.ones(len(x), bool)
            for f, op, v in tests:
                m &= x[:, col[f]] >= v if op == ">=" else x[:, col[f]] < v  # noqa: B023
            return m

        def worth(tests):
            m = covers(tests) & prune  # noqa: B023
            p, n = (bad & m).sum(), (~bad & m).sum()
            return (p - n) / max(p + n, 1), p

        if not rule:
            break
        best_k = max(range(1, len(rule) + 1), key=lambda k: (worth(rule[:k]), -k))
        rule = rule[:best_k]
        m = covers(rule)
        p, n = (bad & m & prune).sum(), (~bad & m & prune).sum()
        if p == 0 or p / (p + n) < min_precision or (bad & m & left).sum() < min_cover:
            refused.add(rule[0][:2])
            continue
        refused.clear()
        out.rules.append(Rule(merged(rule), int((m & left).sum()), float(p / (p + n))))
        left &= ~m
    return out


def fit(stats: DataFrame, labels: DataFrame, max_rows: int = 20_000, **how) -> DecisionList:
    """Learn from the rows of ``stats`` that at most ``max_rows`` labels are about (those of
    the smallest hash of doc_id), label 0 being what rules reject.  Rows that the base rules
    reject have nothing to teach."""
    import numpy as np

    cols = features()
    known = clean_labels(labels).withColumn("h", F.xxhash64("doc_id"))
    one = F.min(F.struct(*(c.alias(k) for k, c in cols.items()))).alias("x")  # of rows that share a doc_id
    rows = stats.where(~base_failed()).join(smallest(known, "h", max_rows, "doc_id"), "doc_id").groupBy("doc_id", "h", "label").agg(one).select("h", "label", "x.*").orderBy("h", "label", *cols).collect()
    if not rows:
        return DecisionList()
    a = np.array([tuple(r) for r in rows], dtype=object)
    return learn(a[:, 2:].astype(float), a[:, 1].astype(int) == 0, a[:, 0].astype(np.int64) % 3 != 0, list(cols), **how)


def base_failed(min_words: int = 50, max_repeat_percent: int = 50) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


def judge(stats: DataFrame, rules: DecisionList) -> DataFrame:
    """``stats`` with base_failed, rule (0: none holds) and kept."""
    return stats.withColumn("base_failed", base_failed()).withColumn("rule", rules.verdict()).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
