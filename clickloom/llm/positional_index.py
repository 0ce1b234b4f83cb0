"""Benchmark decontamination by a distributed positional inverted index.

The index is partitioned by documents: a block of documents holds, for each term,
the sorted positions of the term in the block's token stream, so that building it
takes one pass and no shuffle, and a block is a few MB whatever the corpus.  It is
stored as a table (one row a block) and can be searched any number of times.

Searching a block for a phrase intersects the offset-adjusted position lists from
the rarest term on; a term that the block lacks ends the search at once.  Proximity
search keeps the anchors (occurrences of the rarest term) which have every other
term near enough.  Queries go to the blocks in chunks of bounded size, one pass after the
other, each of which stores what it has found (nothing for most documents); so neither
the plan nor the driver's memory grows with the queries.

The index may be limited to terms whose hash is marked in a bitmap of fixed size
(made from the terms of the queries): this loses no match and keeps postings of
words that no query has out of storage.

Nulls and texts without words have no tokens and no hits.  Very long texts are blocks of
their own.  Repeated documents and repeated items count each for itself, an item_id once.
Items with a NULL item_id mark words but aren't counted as items.  Of terms that are
equally rare the first one leads.  Empty tables give no hits.  Extra columns are ignored;
``keep`` columns named like a result column are replaced.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM_BYTES, new_path, stage, text_chunks, with_text

WINDOW = 13
BITMAP_BITS = 1 << 23
BLOCK_BYTES = 4_000_000
QUERY_BYTES = 4_000_000

HITS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))


def words_of(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""
    return text.translate(ALNUM_BYTES).split() if text else []


def windows_of(words: list[bytes], width: int = WINDOW) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    if len(words) <= width:
        return [tuple(words)]
    return [tuple(words[i : i + width]) for i in range(len(words) - width + 1)]


def _mark(word: bytes) -> int:
    import zlib

    return zlib.crc32(word) % BITMAP_BITS


def bitmap_of(queries: DataFrame, text: str = "text") -> bytes | None:
    """Marks of all words of ``queries``, OR-ed over tasks; BITMAP_BITS / 8 bytes at most."""
    import numpy as np

    def run(batches):
        import pyarrow as pa

        marks: set[int] = set()
        for _, texts in text_chunks(batches, "_text"):
            for t in texts:
                marks.update(map(_mark, words_of(t)))
        yield pa.RecordBatch.from_arrays([pa.array(list(marks), pa.int64())], names=["mark"])

    rows = with_text(queries, [], text).mapInArrow(run, "mark long").distinct()
    bits = np.zeros(BITMAP_BITS, bool)
    for r in rows.toLocalIterator():  # BITMAP_BITS rows at most
        bits[r.mark] = True
    return np.packbits(bits).tobytes()


class _Terms(dict):
    """Numbers the words that the bitmap marks, from 0; -1 for the others."""

    def __init__(self, bits):
        self.bits, self.names = bits, []

    def __missing__(self, word):
        if self.bits is None or self.bits[_mark(word)]:
            n = len(self.names)
            self.names.append(word)
        else:
            n = -1
        self[word] = n
        return n


BLOCK = [
    ("block", T.LongType()), ("n_words", T.ArrayType(T.LongType())), ("starts", T.ArrayType(T.LongType())), ("terms", T.ArrayType(T.BinaryType())),
    ("ends", T.ArrayType(T.LongType())), ("postings", T.BinaryType()),
]


def build(docs: DataFrame, keep: list[str], bitmap: bytes | None = None, text: str = "text") -> DataFrame:
    """The index as a lazy table: a row a block of about BLOCK_BYTES of text (a longer
    document is a block of its own).  ``rows`` has the ``keep`` columns of its documents."""
    schema = T.StructType([T.StructField("rows", T.ArrayType(T.StructType([docs.schema[c] for c in keep])))] + [T.StructField(a, b) for a, b in BLOCK])
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches):
        import itertools

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        number_of = itertools.count(TaskContext.get().partitionId() << 33)
        bits = None if sent.value is None else bytes(np.unpackbits(np.frombuffer(sent.value, np.uint8)))
        for part, texts in text_chunks(batches, "_text", BLOCK_BYTES):
            number, ids, n_words = _Terms(bits), [], []
            for t in texts:
                w = words_of(t)
                n_words.append(len(w))
                ids.append(np.fromiter(map(number.__getitem__, w), np.int32, len(w)))
                ids.append(np.full(1, -1, np.int32))  # a gap: no phrase spans two documents
            ids = np.concatenate(ids)
            at = np.flatnonzero(ids >= 0)
            order = at[np.argsort(ids[at], kind="stable")].astype(np.int32)
            ends = np.cumsum(np.bincount(ids[at], minlength=len(number.names)))
            starts = np.concatenate(([0], np.cumsum(np.array(n_words) + 1)[:-1]))
            rows = pa.StructArray.from_arrays([part.column(i) for i in range(len(keep))], names=keep)
            whole = lambda a, kind: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), pa.array(a, kind))
            yield pa.RecordBatch.from_arrays([
                pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows), pa.array([next(number_of)], pa.int64()), whole(n_words, pa.int64()), whole(starts, pa.int64()),
                whole(number.names, pa.binary()), whole(ends, pa.int64()), pa.array([order.tobytes()], pa.binary()),
            ], names=["rows", *(a for a, _ in BLOCK)])

    return with_text(docs, keep, text).mapInArrow(run, schema)


class Block:
    """A block in memory: ``find`` gives a term's sorted positions."""

    def __init__(self, terms, ends, postings):
        import numpy as np

        self.at = {t: i for i, t in enumerate(terms)}
        self.ends = np.concatenate(([0], np.asarray(ends, np.int64)))
        self.postings = np.frombuffer(postings, np.int32)

    def size(self, term) -> int:
        i = self.at.get(term)
        return 0 if i is None else int(self.ends[i + 1] - self.ends[i])

    def find(self, term):
        i = self.at[term]
        return self.postings[self.ends[i] : self.ends[i + 1]]

    def phrase(self, words):
        """Start positions of the consecutive ``words``."""
        import numpy as np

        at = self.at
        if any(w not in at for w in words):
            return np.zeros(0, np.int32)
        order = sorted(range(len(words)), key=lambda k: self.size(words[k]))
        start = self.find(words[order[0]]) - order[0]
        for k in order[1:]:
            p = self.find(words[k])
            i = np.searchsorted(p, start + k)
            i[i == len(p)] = 0
            start = start[p[i] == start + k]
            if not len(start):
                break
        return start

    def near(self, words, width: int):
        """Positions of the rarest of ``words`` with every other one among the ``width`` words around it."""
        import numpy as np

        words = list(dict.fromkeys(words))
        if any(w not in self.at for w in words):
            return np.zeros(0, np.int32)
        words.sort(key=self.size)
        anchor = self.find(words[0])
        for w in words[1:]:
            p = self.find(w)
            i = np.searchsorted(p, anchor - width + 1)
            anchor = anchor[(i < len(p)) & (p[np.minimum(i, len(p) - 1)] < anchor + width)]
        return anchor


def query_chunks(items: DataFrame, max_bytes: int = QUERY_BYTES):
    """Lists of (item_id as text, text as bytes) of at most about ``max_bytes``, read one
    chunk after the other."""
    chunk, size = [], 0
    for r in items.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").alias("t")).toLocalIterator():
        if not r.t:
            continue
        chunk.append((r.i, r.t.encode()))
        size += len(chunk[-1][1])
        if size >= max_bytes:
            yield chunk
            chunk, size = [], 0
    if chunk:
        yield chunk


FOUND = T.StructType([T.StructField("_block", T.LongType()), T.StructField("_doc", T.LongType()), T.StructField("hits", HITS), T.StructField("items", T.ArrayType(T.StringType()))])


def _search(index: DataFrame, chunk, keep_fields, width: int, near: int | None, sparse: bool = False) -> DataFrame:
    """A row for each document, or with ``sparse`` (its block, its place in it) for those that have something."""
    schema = FOUND if sparse else T.StructType([*keep_fields, T.StructField("n_words", T.LongType()), *FOUND.fields[2:]])
    sent = index.sparkSession.sparkContext.broadcast(chunk)  # QUERY_BYTES and one text at most
    names = [f.name for f in keep_fields]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        queries: dict = {}
        for item, text in sent.value:
            words = words_of(text)
            for w in windows_of(words, width) if near is None else [tuple(words)] if words else []:
                queries.setdefault(w, set()).add(item)
        for b in batches:
            col = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            for i in range(b.num_rows):
                rows = col["rows"][i].values
                n_words = np.asarray(col["n_words"][i].values)
                starts = np.asarray(col["starts"][i].values)
                block = Block(col["terms"][i].values.to_pylist(), col["ends"][i].values, col["postings"][i].as_buffer())
                mark = np.zeros(int(n_words.sum()) + len(n_words) + 1, np.int32)
                found: dict[int, set] = {}
                for words, items in queries.items():
                    at = block.phrase(words) if near is None else block.near(words, near)
                    if not len(at):
                        continue
                    mark[at] += 1  # the places of one phrase differ
                    mark[at + (len(words) if near is None else 1)] -= 1
                    for d in np.unique(np.searchsorted(starts, at, "right") - 1).tolist():
                        found.setdefault(d, set()).update(items)
                hit = np.concatenate(([0], np.cumsum(mark) > 0, [0])).astype(np.int8)
                edge = np.diff(hit)
                lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                doc = np.searchsorted(starts, lo, "right") - 1
                offsets = np.searchsorted(doc, np.arange(len(n_words) + 1))
                runs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(lo - starts[doc], pa.int64()), pa.array(hi - starts[doc], pa.int64())], names=["start", "stop"]))
                items = pa.array([sorted(x for x in found.get(d, ()) if x is not None) for d in range(len(n_words))], pa.list_(pa.string()))
                if sparse:
                    some = pa.array(sorted(found), pa.int64())
                    own = pa.array(np.full(len(some), col["block"][i].as_py()), pa.int64())
                    yield pa.RecordBatch.from_arrays([own, some, runs.take(some), items.take(some)], names=FOUND.names)
                    continue
                yield pa.RecordBatch.from_arrays([*rows.flatten(), pa.array(n_words, pa.int64()), runs, items], names=[*names, "n_words", "hits", "items"])

    return index.mapInArrow(run, schema)


def search(index: DataFrame, items: DataFrame, width: int = WINDOW, near: int | None = None) -> DataFrame:
    """Per document of the (stored) ``index``: its ``keep`` columns, n_words, hits (word
    intervals of all occurrences, merged) and items (sorted texts of the item_ids found).

    By default items are looked for by their windows of ``width`` words, exactly;
    with ``near`` an item is found where all its words lie among ``near`` words, and
    the hits are the rarest word's places.
    """
    keep_fields = list(index.schema["rows"].dataType.elementType.fields)
    chunks = query_chunks(items)
    first, second = next(chunks, []), next(chunks, None)
    if second is None:
        return _search(index, first, keep_fields, width, near)
    path = new_path(index.sparkSession, "found")
    for chunk in itertools.chain((first, second), chunks):
        _search(index, chunk, keep_fields, width, near, sparse=True).write.mode("append").parquet(path)
    empty = F.array().cast(HITS)
    join = lambda acc, x: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, -1)["stop"] >= x["start"]),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["stop"], x["stop"]).alias("stop")))),
    ).otherwise(F.concat(acc, F.array(x)))
    met = index.sparkSession.read.schema(FOUND).parquet(path).groupBy("_block", "_doc").agg(
        F.array_sort(F.flatten(F.collect_list("hits"))).alias("_hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("_items")  # a document has a row a chunk
    )
    docs = index.select(F.col("block").alias("_block"), F.posexplode(F.arrays_zip("rows", "n_words")).alias("_doc", "_d")).withColumn("_doc", F.col("_doc").cast("long"))
    both = docs.join(met, ["_block", "_doc"], "left")
    names = [f.name for f in keep_fields]
    return both.select(
        *[F.col(f"_d.rows.{n}").alias(n) for n in names], F.col("_d.n_words").alias("n_words"),
        F.aggregate(F.coalesce("_hits", empty), empty, join).alias("hits"), F.coalesce("_items", F.array().cast("array<string>")).alias("items"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, keep: list[str], width: int = WINDOW) -> DataFrame:
    """``keep`` columns, n_words, hits, items, n_hit and contaminated of every document: the
    index of ``docs`` is stored for the benchmark's vocabulary, then searched."""
    keep = [c for c in keep if c not in ("n_words", "hits", "items", "n_hit", "contaminated")]
    index = stage(build(docs, keep, bitmap_of(benchmark)), "index")
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, h: a + h["stop"] - h["start"])
    return (
        search(index, benchmark, width).withColumn("n_hit", n_hit)
        .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    )


def cut_hits(text: bytes, hits) -> bytes:
    """``text`` without the words of ``hits`` and what stands between them."""
    kind = text.translate(ALNUM_BYTES)
    spans, pos = [], 0
    for w in kind.split():
        at = kind.index(w, pos)
        pos = at + len(w)
        spans.append((at, pos))
    out, last = [], 0
    for h in hits:
        out.append(text[last : spans[h["start"]][0]])
        last = spans[h["stop"] - 1][1]
    return b"".join([*out, text[last:]])


def without_hits(docs: DataFrame, text: str = "text", hits: str = "hits", n_chars: str = "n_chars") -> DataFrame:
    """``docs`` without the words of each row's ``hits`` (NULL: none), ``n_chars`` following,
    and without the column ``hits``; one pass, no shuffle."""
    names = [c for c in docs.columns if c != hits]
    t, n = names.index(text), names.index(n_chars)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            found = b.column(len(names)).to_pylist()
            cols = b.columns[: len(names)]
            if any(found):
                texts, sizes = cols[t].to_pylist(), cols[n].to_pylist()
                for i, h in enumerate(found):
                    if h:
                        texts[i] = cut_hits(texts[i].encode(), h).decode()
                        sizes[i] = len(texts[i])
                cols[t], cols[n] = pa.array(texts, pa.string()), pa.array(sizes, cols[n].type)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = T.StructType([docs.schema[c] for c in names])
    return docs.select(*names, hits).mapInArrow(run, schema)
