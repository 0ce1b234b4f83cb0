import re

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from clickloom.llm import quality_rules as R


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit)


@given(st.text(alphabet="ab \n\t#é日|.", max_size=80))
def test_stats(text):
    assert R.stats_of(text.encode())[:5] == brute(text)


def test_many_distinct_words():
    ids = np.concatenate((np.arange(2_200_000), np.array([5, 6, 7])))
    assert R.repeat_words(ids) == 6


def test_learns_and_prunes():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 3))
    bad = (x[:, 0] > 0.8) | ((x[:, 1] < 0.2) & (x[:, 2] > 0.5))
    rules = R.learn(x, bad, np.arange(3000) % 3 != 0, ["a", "b", "c"])
    hit = np.zeros(3000, bool)
    for r in rules.rules:
        m = np.ones(3000, bool)
        for f, op, v in r.tests:
            m &= x[:, "abc".index(f)] >= v if op == ">=" else x[:, "abc".index(f)] < v
        hit |= m
    assert 2 <= len(rules.rules) <= 4 and (hit == bad).mean() > 0.98 and "a >= 0." in str(rules.rules[0])
    assert not R.learn(x, np.zeros(3000, bool), np.ones(3000, bool), ["a", "b", "c"]).rules


def test_odd_rows(spark, odd, odd_rows, labels):
    stats = R.text_stats(odd, ["doc_id"]).cache()
    got = sorted((tuple(r)[:6] for r in stats.collect()), key=repr)
    assert got == sorted(((r[0], *(brute(r[1]) if r[0] != 11 else tuple(R.stats_of(r[1].encode())[:5]))) for r in odd_rows), key=repr)
    out = R.judge(stats, R.fit(stats, labels))
    assert out.where("n_words < 50 AND (kept OR NOT base_failed)").count() == 0 and out.count() == len(odd_rows)
    assert R.judge(stats.where("false"), R.fit(stats.where("false"), labels.where("false"))).count() == 0


def test_held_labels(spark, sf):
    """Junk goes and clean documents stay, on documents whose labels are known."""
    from clickloom.llm.queries import op2_quality_rules

    sf = sf.replace("0.001", "0.01")
    got = op2_quality_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    n = {(r.quality, r.kept): r["count"] for r in got.where("NOT base_failed").groupBy("quality", "kept").count().collect()}
    assert n.get((1, False), 0) <= 0.01 * n[1, True] and n.get((0, True), 0) <= 0.05 * n[0, False]


def test_kept_against_the_rules_read_one_by_one(spark, docs, sf):
    stats = R.text_stats(docs, ["doc_id"]).cache()
    rules = R.fit(stats, spark.read.parquet(f"{sf.replace('0.001', '0.01')}/labels.parquet"))
    for r in R.judge(stats, rules).collect():
        w, c = max(r.n_words, 1), max(r.word_chars, 1)
        x = {
            "symbol_ratio": r.n_symbols / c, "repeat_ratio": r.n_repeat_words / w, "dup_line_ratio": r.n_dup_lines / max(r.n_lines, 1), "upper_ratio": r.n_upper / max(r.n_upper + r.n_lower, 1),
            "mark_ratio": r.n_marks / w, "word_length": r.word_chars / w,
        }
        first = next((i for i, rule in enumerate(rules.rules, 1) if all(x[f] >= v if op == ">=" else x[f] < v for f, op, v in rule.tests)), 0)
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert (r.rule, r.base_failed, r.kept) == (first, failed, not failed and not first)


def test_tests_of_one_direction_are_merged():
    assert R.merged([("a", ">=", 0.1), ("b", "<", 3.0), ("a", ">=", 0.5), ("b", "<", 4.0)]) == [("a", ">=", 0.5), ("b", "<", 3.0)]


def test_many_values_are_all_tried():
    rng = np.random.default_rng(2)
    x = rng.random((20_000, 1))
    rules = R.learn(x, x[:, 0] > 0.98765, np.arange(20_000) % 3 != 0, ["a"]).rules
    assert len(rules) == 1 and abs(rules[0].tests[0][2] - 0.98765) < 2e-4
