import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from clickloom.llm import packing as P

PLAIN, RANKS = Tokenizer.from_file(P.tokenizer_path("json")), P.encoder(P.tokenizer_path())


def JSON(text):  # noqa: N802  as the contract has it
    return np.array(PLAIN.encode(text, add_special_tokens=False).ids, np.uint32)


@settings(max_examples=500, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="ab'sSlL 1\n\t\r.,é日  <|>endoftxt", max_size=60))
def test_both_forms_give_the_same_ids(text):
    assert JSON(text).tolist() == RANKS(text).tolist()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|endoftext", " ", "  ", "\n", "a", "é", "<|", "|>", "word"]), max_size=12).map("".join))
def test_added_tokens_in_a_text(text):
    assert JSON(text).tolist() == RANKS(text).tolist()


LONG = [
    "a <|endoftext|> b", " " * 2_000_000, "x" + "\n" * 1_000_000 + "y", "\r\n\t " * 300_000, "w" * 1_000_000, "word " * 60 + " " * 1_200_000 + "word " * 60,
    "日本" * 300_000, "!?" * 400_000, "<|endoftext|>" * 3 + " " * 1_000_000 + "<|endoftext|>",
]


def test_long_runs(spark):
    rows = list(enumerate(LONG))
    got = P.pieces(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), ["doc_id"]).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == expected(rows)


def check(counts, capacity, runs, bins):
    rank = dict.fromkeys(counts, 0)
    rooms: dict[int, list] = {}
    for length, first, n, b, offset in sorted(runs):
        assert rank[length] == first
        rank[length] += n
        for i in range(n):
            rooms.setdefault(b + i, []).append((offset, length))
    assert rank == counts and len(rooms) == bins
    for own in rooms.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=20), st.integers(1, 12))
def test_packing_is_sound(counts, groups):
    runs, bins = P.pack(counts, 64, groups)
    check(counts, 64, runs, bins)
    assert bins >= -(-sum(k * n for k, n in counts.items()) // 64)


def test_few_bins():
    rng = np.random.default_rng(1)
    lengths, n = np.unique(np.clip(rng.lognormal(6, 1, 20_000).astype(int), 1, 2048), return_counts=True)
    counts = dict(zip(lengths.tolist(), n.tolist(), strict=True))
    runs, bins = P.pack(counts)
    check(counts, 2048, runs, bins)
    assert bins <= 1.01 * sum(k * v for k, v in counts.items()) / 2048
    assert P.pack({1000: 10, 1048: 10})[1] == 10 and P.pack({})[1] == 0


def expected(rows, capacity=2048):
    out = []
    for d, t in rows:
        ids = [*JSON(t or "").tolist(), 0]
        first, at, k = len(ids) % capacity or min(len(ids), capacity), 0, 0
        while at < len(ids):
            size = first if k == 0 else capacity
            out.append((d, k, at, size, zlib.crc32(np.array(ids[at : at + size], "<u4").tobytes())))
            at, k = at + size, k + 1
    return sorted(out, key=repr)


def gapless(rows):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 2048
    return len(by)


def test_odd_rows(spark, odd, odd_rows):
    got = P.sequences(P.pieces(odd, ["doc_id", "offset"])).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == expected([r[:2] for r in odd_rows])
    gapless(got)
    assert P.sequences(P.pieces(odd.where("false"), ["doc_id"])).count() == 0


def test_query(spark, sf, texts):
    from clickloom.llm.queries import op5_best_fit_packing

    got = op5_best_fit_packing(spark, sf).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == expected(texts.items())
    assert gapless(got) <= 1.03 * sum(r.length for r in got) / 2048 + 1
