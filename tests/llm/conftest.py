import random

import pytest

#: Columns that operators make themselves.
CLASH = "fp string, score string, n_words string, component_id string, length string, size string, shard string, labels string, hits string, kept string, text_crc32 string, held_out string, label string, keeper string, offset string"


def words(rng, n):
    return " ".join("".join(rng.choice(("er", "th", "on", "an", "re", "he", "in", "ed", "nd", "ha")) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows, marks and other scripts."""
    rng = random.Random(4)
    a, b = words(rng, 80), words(rng, 70)
    rows = [
        (1, a), (2, a), (3, a + " more"), (4, None), (5, ""), (6, "  \n\t "), (7, b), (7, b), (8, "Été ÀÉ日本  x y İK 😀"), (9, "one"), (10, "Two Words"),
        (11, words(rng, 30_000)), (12, "x" * 50_000), (13, "the the the the\nthe the\nthe the\n\n"), (None, a), (None, "no id"), (14, "A\r\n\r\nWARC/1.0\r\nContent-Length: 3\r\n\r\nB\r\n"),
        (15, "Licensed under CC BY-NC 4.0.\nAll rights\n reserved, see the GNU General Public License."), (16, "<|endoftext|> 's 'll  two  spaces \n end "),
    ]
    return [(*r, "en", "s", None) for r in rows]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    n = CLASH.count("string")
    schema = f"doc_id bigint, text string, lang string, source string, n_chars bigint, {CLASH}"
    return spark.createDataFrame([(*r, *["c"] * n) for r in odd_rows], schema).repartition(3)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 1, 0), (7, 1, 0), (13, 0, 0), (None, 1, 0), (11, None, 0), (3, 1, 0), (12, 0, 1)], "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}
