"""Near copies by SimHash and the Jaccard similarity of word shingles, verified exactly.

Texts with the same set of shingles (five words, lower-cased; 128 bits stand for a set) are one
from the start.  Sets whose SimHash fingerprints differ in at most ``RADIUS`` bits are found by the
search of :mod:`.simhash` (partitions of bits with their own thresholds, spanning forests of buckets); of
these pairs those that are alike make the first classes.  Similar sets may differ in more bits than any
affordable radius (README), so a second search looks for the links that are left between classes.
Each distinct set has ``BANDS`` keys of ``ROWS`` minimum hashes; sets that share
a key are candidates.  Two sets of similarity s miss each other with probability
(1 - s ** ROWS) ** BANDS, which is 5e-8 at 0.8 and less above.  In both searches a pair is decided on the whole sets of
64-bit hashes.  Pairs within a bucket grow with the square of a group of copies, so a bucket's sets
of other classes than its hub, the set that shares most keys with others (the original of a group of edited
copies), are first held against that.  What is then in another class than the hub is held against all sets of the hub's buckets, in blocks
of bounded size, for every pair of blocks whose sizes of sets allow a link; a task gets two blocks and gives
one link for each two classes that it joins, so no pairs are emitted.  Every two sets that share a key are
compared or already of one class; the work in blocks grows with a group's size times its sets that are unlike the hub.

NULL and empty texts and texts without words have the empty set and are one class.  Very long texts
are read whole.  Rows that are repeated whole have one key; of rows that share a doc_id the least key
is the keeper.  Empty tables give empty tables.  Extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import apart, drop, stage, text_chunks, with_text
from .simhash import LONG, components, majority, shingle_hashes
from .simhash import links as fingerprint_links

WIDTH = 5
#: Least similarity of a link, as a fraction.
SIMILAR = (4, 5)
BANDS, ROWS = 32, 4
#: Fingerprints that differ in at most so many bits are candidates.
RADIUS = 5
#: A block has about this many sets and this many hashes at most.
BLOCK, BLOCK_HASHES = 256, 500_000


def shingle_set(text: bytes | None, width: int = WIDTH):
    """Sorted distinct hashes of the text's shingles."""
    import numpy as np

    return np.unique(np.array(shingle_hashes(text, width), np.uint64))


def set_ids(hashes) -> tuple[int, int]:
    """Two hashes of the set, as signed longs; 0 for the empty one."""
    import xxhash

    return tuple(x - (1 << 64) if x >> 63 else x for x in (xxhash.xxh64_intdigest(hashes.tobytes(), seed) if len(hashes) else 0 for seed in (7, 11)))


def band_keys(hashes, starts):
    """Keys (rows: sets, columns: bands) of sets that lie one after the other in ``hashes``."""
    import numpy as np

    rng = np.random.default_rng(5)
    factors = rng.integers(0, 1 << 63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)
    mix = rng.integers(0, 1 << 63, ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.empty((len(starts), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(starts), b, np.uint64)
        for r in range(ROWS):
            key = (key ^ np.minimum.reduceat(hashes * factors[b, r], starts)) * mix[r]
            key ^= key >> np.uint64(29)
        out[:, b] = key
    return out


def signatures(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns, fp and fp2 (the set's hashes), n (its size), mark (its fingerprint) and bands (its keys); no shuffle."""
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("fp", LONG), T.StructField("fp2", LONG), T.StructField("n", T.IntegerType()), T.StructField("mark", LONG), T.StructField("bands", T.ArrayType(LONG))])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for part, texts in text_chunks(batches, "_text", 1_000_000):
            sets = [shingle_set(t) for t in texts]
            n = np.fromiter(map(len, sets), np.int64, len(sets))
            some = np.flatnonzero(n >= SIMILAR[0])  # smaller sets are like none but themselves
            keys, mark = np.zeros((0, BANDS), np.uint64), np.zeros(len(sets), np.uint64)
            if len(some):
                hashes = np.concatenate([sets[i] for i in some])
                keys, mark[some] = band_keys(hashes, np.cumsum(n[some]) - n[some]), majority(hashes, n[some])
            ends = np.concatenate(([0], np.cumsum((n >= SIMILAR[0]) * BANDS))).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.reshape(-1).view(np.int64)))
            fp = np.array([set_ids(s) for s in sets], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), pa.array(fp[:, 0]), pa.array(fp[:, 1]), pa.array(n.astype(np.int32)), pa.array(mark.view(np.int64)), bands], names=[*keep, "fp", "fp2", "n", "mark", "bands"])

    return with_text(docs, keep).mapInArrow(run, schema)


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(node, hashes): the set of each text of (node, text)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for part, texts in text_chunks(batches, "_text", 1_000_000):
            sets = [shingle_set(t) for t in texts]
            ends = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))], names=["node", "hashes"])

    return with_text(docs, ["node"]).mapInArrow(run, "node long, hashes array<long>")


def alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough; only sets of these pairs are moved."""
    side = lambda c: apart(sets, "node", pairs.select(F.col(c).alias("node")).distinct())[1].select(F.col("node").alias(c), F.col("hashes").alias(f"_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", F.size("_a").alias("_n"), F.size("_b").alias("_m"), F.size(F.array_intersect("_a", "_b")).alias("_k"))
    num, den = SIMILAR
    return both.where(F.col("_k") * den >= (F.col("_n") + F.col("_m") - F.col("_k")) * num).select("a", "b")


def near(n, m):
    """Whether sets of n and m elements can be similar enough."""
    return (F.col(n) * SIMILAR[1] >= F.col(m) * SIMILAR[0]) & (F.col(m) * SIMILAR[1] >= F.col(n) * SIMILAR[0])


def by_fingerprint(uniq: DataFrame) -> DataFrame:
    """Staged (a, b): sets of ``uniq`` (node, n, mark) whose fingerprints differ in at most ``RADIUS`` bits, if their sizes
    allow a link.  Of sets with one fingerprint each is paired with the least, which stands for them in the forests."""
    marks = uniq.where(F.col("n") >= SIMILAR[0]).select("node", "n", F.col("mark").alias("fp"))
    least = stage(marks.groupBy("fp").agg(F.min(F.struct("node", "n")).alias("r")), "marks")
    side = lambda c: least.select(F.col("fp").alias(c), F.col("r").alias(f"_{c}"))
    other = fingerprint_links(least, RADIUS).distinct().join(side("a"), "a").join(side("b"), "b").select("_a", "_b")
    same = marks.join(least, "fp").where("node <> r.node").select(F.col("r").alias("_a"), F.struct("node", "n").alias("_b"))
    out = stage(other.unionByName(same).where(near("_a.n", "_b.n")).select(F.col("_a.node").alias("a"), F.col("_b.node").alias("b")), "pairs")
    drop(least)
    return out


def with_hubs(rows: DataFrame) -> DataFrame:
    """(h, hn, node, n): each set of ``rows`` (k, node, n, degree) with the hubs of its buckets, hubs aside."""
    hubs = rows.groupBy("k").agg(F.max(F.struct("degree", "node", "n")).alias("hub"))
    both = rows.join(hubs, "k").select(F.col("hub.node").alias("h"), F.col("hub.n").alias("hn"), "node", "n")
    return both.where("node <> h").distinct()


def with_classes(stars: DataFrame, roots: DataFrame) -> DataFrame:
    """``stars`` with root, the class of node by ``roots`` (node, root), and whether the hub is of an other class."""
    main = roots.select(F.col("node").alias("h"), F.col("root").alias("main"))
    own = stars.join(roots, "node", "left").join(main, "h", "left")
    return own.select(*stars.columns, F.coalesce("root", "node").alias("root"), (F.coalesce("root", "node") != F.coalesce("main", "h")).alias("other"))


def block_of(other, level, number):
    """One long for a block: whether its sets are of other classes than the hub's, their level of size, its number."""
    return F.col(other).cast("long") * (1 << 48) + F.col(level) * (1 << 40) + F.col(number)


def cells(stars: DataFrame, roots: DataFrame) -> DataFrame:
    """(h, lo, hi, block, node, root): the sets of each pair of blocks that may hold links between classes.

    ``stars`` are from :func:`with_hubs`, ``roots`` (node, root) the classes so far.  Sets whose levels differ by
    more than one have sizes that rule a link out; two sets of the hub's class need none."""
    own = with_classes(stars, roots).select(
        "h", "node", "root", "n", "other", F.floor(F.log("n") / math.log(1.26)).cast("long").alias("level"),
    )
    several = own.groupBy("h").agg(F.count("*").alias("c"), F.max("other").alias("mixed")).where("c > 1 AND mixed").select("h")
    own = stage(own.join(several, "h"), "stars")
    sizes = stage(own.groupBy("h", "other", "level").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_HASHES)).cast("long").alias("blocks")), "blocks")
    own = own.join(sizes, ["h", "other", "level"]).withColumn("number", F.pmod(F.xxhash64("node"), "blocks")).withColumn("block", block_of("other", "level", "number"))
    beside = sizes.select("h", F.col("other").alias("other2"), F.col("level").alias("level2"), "blocks")
    both = own.drop("blocks").withColumn("level2", F.explode(F.array(*[F.col("level") + d for d in (-1, 0, 1)]))).join(beside, ["h", "level2"]).where("other OR other2")
    both = both.withColumn("number2", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumn("block2", block_of("other2", "level2", "number2"))
    return both.select("h", F.least("block", "block2").alias("lo"), F.greatest("block", "block2").alias("hi"), "block", "node", "root")


def crossing(table):
    """(a, b): one link for each two classes that sets of the cell's two blocks join."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    node, root, block = (table.column(c).to_numpy() for c in ("node", "root", "block"))
    x, y = (np.flatnonzero(block == table.column(c)[0].as_py()) for c in ("lo", "hi"))
    sizes = pc.list_value_length(table.column("hashes")).to_numpy()
    _, at, seen = np.unique(pc.list_flatten(table.column("hashes")).to_numpy(), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(node)), sizes)[seen[at] > 1]  # hashes of one set alone are in no intersection
    col = (np.cumsum(seen > 1) - 1)[at[seen[at] > 1]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    common, step = np.zeros((len(x), len(y))), 4096
    for lo in range(0, int(col[-1]) + 1 if len(col) else 0, step):
        i, j = np.searchsorted(col, (lo, lo + step))
        has = np.zeros((len(node), step), np.float32)
        has[row[i:j], col[i:j] - lo] = 1
        common += has[x] @ has[y].T
    num, den = SIMILAR
    alike = common * den >= (sizes[x][:, None] + sizes[y][None, :] - common) * num
    i, j = np.nonzero(alike & (root[x][:, None] != root[y][None, :]))
    _, one = np.unique(np.sort(np.stack((root[x[i]], root[y[j]])), axis=0), axis=1, return_index=True)
    return pa.table({"a": node[x[i[one]]], "b": node[y[j[one]]]})


def links(docs: DataFrame, uniq: DataFrame, keys: list[str]) -> DataFrame:
    """Staged (a, b) of similar sets of ``uniq`` (node, n, mark, bands, rep with the ``keys`` of a text) that join the classes."""
    pairs = by_fingerprint(uniq)
    rows = uniq.select("node", "n", F.explode("bands").alias("k"))
    sizes = stage(rows.groupBy("k").agg(F.count("*").alias("c")).where("c > 1"), "buckets")
    _, doubt = apart(rows, "k", sizes.select("k"))  # most keys are one set's alone
    rows = stage(doubt.join(sizes, "k"), "members")
    degrees = rows.groupBy("node").agg(F.sum("c").alias("degree"))
    stars = stage(with_hubs(rows.join(degrees, "node")), "hubs")
    nodes = rows.select("node").unionAll(pairs.select("a")).unionAll(pairs.select("b")).distinct()
    texts = stage(uniq.join(nodes, "node", "left_semi").select("node", *[F.col(f"rep.{k}").alias(k) for k in keys]), "keys")
    _, doubt = apart(docs.select(*keys, "text"), keys[0], texts.select(keys[0]))
    sets = stage(shingle_sets(doubt.join(texts, keys).select("node", "text").dropDuplicates(["node"])), "sets")
    first = stage(alike(pairs, sets), "links")
    classes = stage(components(first), "roots")
    hubs = with_classes(stars, classes).where(F.col("other") & near("n", "hn")).select(F.col("h").alias("a"), F.col("node").alias("b"))
    found = stage(first.unionByName(alike(hubs, sets)), "links")
    roots = stage(components(found), "roots")
    rest = stage(cells(stars, roots), "cells")
    _, those = apart(sets, "node", rest.select("node").distinct())
    more = rest.join(those, "node").groupBy("h", "lo", "hi").applyInArrow(crossing, "a long, b long")
    out = stage(found.unionByName(more), "links")
    for x in (pairs, sizes, rows, stars, texts, sets, first, classes, found, roots, rest):
        drop(x)
    return out


def near_copies(docs: DataFrame, keys: list[str]) -> DataFrame:
    """doc_id, ``keys`` (longs that together tell rows apart), component_id (the least doc_id of the row's class)
    and keeper (the least keys of the class's rows with that doc_id) of every row."""
    marked = stage(signatures(docs, ["doc_id", *keys]), "fp")
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), *keys))
    uniq = marked.groupBy("fp", "fp2").agg(rep.alias("rep"), F.first("n").alias("n"), F.first("mark").alias("mark"), F.first("bands").alias("bands"))
    uniq = stage(uniq.withColumn("node", F.monotonically_increasing_id()), "uniq")  # the number holds as it is stored
    found = links(docs, uniq, keys)
    roots = stage(components(found), "roots")
    ends = roots.unionAll(roots.select(F.col("root").alias("node"), "root").distinct())
    named = stage(ends.join(uniq, "node").select("node", "root", "rep"), "named")
    best = named.join(named.groupBy("root").agg(F.min("rep").alias("best")), "root").select("node", "best")
    classes = stage(uniq.join(best, "node", "left").select("fp", "fp2", F.coalesce("best", "rep").alias("r")), "best")
    out = marked.join(classes, ["fp", "fp2"]).select("doc_id", *keys, F.col("r.id").alias("component_id"), F.struct(*[f"r.{k}" for k in keys]).alias("keeper"))
    out = stage(out, "classes")
    for x in (marked, uniq, found, roots, named, classes):
        drop(x)
    return out
