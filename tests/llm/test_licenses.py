import re

from clickloom.llm import licenses as L


def brute(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(L.WORD, low)
    at, base = [], set()
    for p, label in L.PHRASES.items():
        p = p.split()
        here = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        at += here
        base |= {label} if here else set()
    best, found = 1.0 if base else 0.0, set()
    for label, t in L.TEMPLATES.items():
        own = set(L.tokens(t))
        for i in range(len(w)):
            n = len(own & set(w[i : i + L.width(t)]))
            if n >= L.needed(len(own)):
                found.add(label)
                best = max(best, n / len(own))
    return len(w), len(at), min(at, default=None), max(at, default=None), sorted(base), sorted(base | found), best


TEXTS = [
    "cc by cc by", "CC-BY\nx", "ccby cc byx xcc by", "écc by cc byé", "All\nrights\n\nreserved", "GENERAL public LICENSE", "licensed under the apache license version 2 0", "version 2.0 of the APACHE License, licensed under",
    "Licensed under the Apache License, Version 2.", "released under the mit", None, "", "İcc by K general public license", L.TEMPLATES["gpl-notice"] + " or later", L.TEMPLATES["bsd-notice"].replace("binary", ""),
    "\n".join(L.TEMPLATES.values()), "x " * 5000 + "cc by", L.TEMPLATES["mit"] + "\r", "Released under\nthe MIT License.",
    "The party released a statement; students at MIT work under a license.", "worK is licensed under the GNU General Public License, version 3, this", "İn CC\u212a BY", ",cc by,", "  all rights reserved",
    "# " + L.TEMPLATES["apache-notice"].replace(" ", " \n# "), "a " + L.TEMPLATES["unlicense"].replace("and ", "and and "),
]


def check(df, want):
    got = [(r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in df.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_against_brute_force(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS + TEXTS[:3])], "doc_id bigint, text string").repartition(3)
    check(L.scan(df, ["doc_id"]), [brute(t) for t in TEXTS + TEXTS[:3]])


def test_odd_rows(spark, odd, odd_rows):
    check(L.scan(odd, ["doc_id", "fp"]), [brute(r[1]) for r in odd_rows])
    assert L.scan(odd.where("false"), ["doc_id"]).count() == 0


def test_plan_has_no_python(spark, odd):
    plan = L.scan(odd, ["doc_id"])._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_prefix_filter():
    freq = {w: i for i, w in enumerate(L.tokens("a b c d e f g h i j"))}
    index = L.prefix_index({"t": "j i h g f e d c b a"}, freq, 0.8)
    assert [r[:5] for r in index] == [("a", "t", 0, 10, 8), ("b", "t", 1, 10, 8), ("c", "t", 2, 10, 8)]


def test_wrapped_notices(spark):
    """Every template, wrapped at 72 columns amid other text and with comment marks."""
    import textwrap

    rows = []
    for label, t in L.TEMPLATES.items():
        for before in (0, 5, 9):
            lines = textwrap.wrap("zz " * before * 2 + t + " qq" * 40, 72) if len(t) > 72 or before else textwrap.wrap(t, 20)
            rows.append((label, "intro\n\n" + "\n".join(f" * {x}" for x in lines)))
    got = L.scan(spark.createDataFrame(rows, "doc_id string, text string"), ["doc_id"]).select("doc_id", "labels", "score", "matches").collect()
    assert len(got) == len(rows) and all(r.doc_id in r.labels and r.score == 1 for r in got)
    far = L.scan(spark.createDataFrame([(1, L.TEMPLATES["mit-notice"].replace(" ", "\nzz zz "))], "doc_id int, text string"), ["doc_id"]).first()
    assert far.labels == [] and far.score == 0


def test_scattered_words_are_no_notice(spark):
    text = "The party released a statement; students at MIT work under a license."
    r = L.scan(spark.createDataFrame([(1, text)], "doc_id int, text string"), ["doc_id"]).first()
    assert r.labels == [] and r.score == 0


def test_templates_from_a_table(spark):
    own = spark.createDataFrame([("own", "do what you like with it")], "label string, text string")
    r = L.scan(spark.createDataFrame([(1, "You may: do what you\nlike with it.", "x")], "doc_id int, text string, labels string"), ["doc_id", "labels"], templates=own).first()
    assert r.labels == ["own"] and r.score == 1 and r.matches[0].word == 2


def test_sql_on_the_same_texts(spark):
    import duckdb

    rows = [(i, t) for i, t in enumerate(TEXTS)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = {r[0]: r[1:] for r in con.execute(L.oracle_sql()).fetchall()}
    got = L.scan(spark.createDataFrame(rows, "doc_id bigint, text string"), ["doc_id"]).collect()
    assert {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, ",".join(r.base_labels), ",".join(r.labels), r.score) for r in got} == want
