"""SimHash near-duplicates by the generalised pigeonhole principle.

* :func:`fingerprints` hashes the word shingles of every whole text.
* :func:`links` finds which fingerprints differ in at most ``radius`` bits.  Bits
  that correlate over the corpus are grouped into partitions; dynamic programming
  gives each partition its own threshold (-1: not probed) such that the estimated
  cost of probes and candidates is least and the thresholds add up to
  ``radius - partitions + 1``, which loses no link.  The number of partitions is the one
  of least cost: more fingerprints make fewer partitions with higher thresholds worth
  their probes.  Probes that meet in a bucket are verified, and a bucket emits a spanning
  forest of its links, not all pairs.
* :func:`components` joins links to connected components (alternating large and
  small stars, each round staged in the shared folder).

Nulls, empty texts and texts without words have fingerprint zero and are linked
like any other; very long texts are read whole.  Repeated rows get the same class, and of
equal doc_ids the least ``tie`` is the keeper.  A NULL doc_id names a class only if all its
rows have none.  Empty tables give empty tables.  Extra columns are ignored; ``keep`` columns
named like a result column are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER_BYTES, drop, smallest, stage, text_chunks, with_text

LONG = T.LongType()


def shingle_hashes(text: bytes | None, width: int):
    """XXH64 (seed 42) of each shingle of the lower-cased words, repeats included."""
    import xxhash

    words = text.translate(LOWER_BYTES).split() if text else []
    if not words:
        return []
    f = xxhash.xxh64_intdigest
    if len(words) <= width:
        return [f(b" ".join(words), 42)]
    joined, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends)]
    return [f(joined[a:b], 42) for a, b in zip(starts, ends[width - 1 :], strict=False)]


def majority(h, n):
    """The fingerprint of each run of ``n`` (all above 0) consecutive hashes: bits set in over half of them."""
    import numpy as np

    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduceat(bits, np.cumsum(n) - n, axis=0, dtype=np.int32)
    return np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]


def fingerprints(docs: DataFrame, keep: list[str], width: int = 3, out: str = "fp") -> DataFrame:
    """``keep`` columns and the 64-bit fingerprint (as a signed long); no shuffle."""
    keep = [c for c in keep if c != out]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(out, LONG)])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for part, texts in text_chunks(batches, "_text", 2_000_000):
            hashes = [shingle_hashes(t, width) for t in texts]
            n = np.fromiter(map(len, hashes), np.int64, len(hashes))
            full = np.flatnonzero(n)
            fp = np.zeros(len(texts), np.uint64)
            if len(full):
                fp[full] = majority(np.concatenate([np.array(hashes[i], np.uint64) for i in full]), n[full])
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), pa.array(fp.view(np.int64))], names=[*keep, out])

    return with_text(docs, keep).mapInArrow(run, schema)


# ---- the plan: partitions of bits and their thresholds


def bit_counts(uniq: DataFrame):
    """(n, 64 x 64 counts of bits set together) over all fingerprints: each task sends its sums."""
    import numpy as np

    schema = T.StructType([T.StructField(c, LONG) for c in ("i", "j", "n")])

    def run(batches):
        import pyarrow as pa

        total = np.zeros((64, 64), np.int64)
        rows = 0
        for b in batches:
            x = b.column(0).to_numpy(zero_copy_only=False).view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(x, axis=1, bitorder="little").astype(np.float32)
            total += (bits.T @ bits).astype(np.int64)
            rows += len(x)
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(i, -1)), pa.array(np.append(j, -1)), pa.array(np.append(total[i, j], rows))], names=["i", "j", "n"])

    both, n = np.zeros((64, 64)), 0
    for r in uniq.select("fp").mapInArrow(run, schema).groupBy("i", "j").agg(F.sum("n").alias("n")).collect():  # 4097 rows at most
        if r.i < 0:
            n = r.n
        else:
            both[r.i, r.j] = r.n
    return n, both


def group_bits(n: int, both, parts: int) -> list[list[int]]:
    """Bits of highest absolute correlation go together, in ``parts`` groups of like size."""
    import numpy as np

    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    r = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(r, 0)
    left, out = list(range(64)), []
    for k in range(parts):
        size = len(left) // (parts - k)
        a, b = np.unravel_index(np.argmax(r[np.ix_(left, left)]), (len(left), len(left)))
        group = [left[a]] if size == 1 or a == b else [left[a], left[b]]
        while len(group) < size:
            rest = [x for x in left if x not in group]
            group.append(rest[int(np.argmax(r[np.ix_(rest, group)].mean(1)))])
        out.append(sorted(group[:size]))
        left = [x for x in left if x not in out[-1]]
    return out


def within(differ, most: int) -> list[float]:
    """P(at most t of the bits differ) for t to ``most``, bit i differing with ``differ[i]``."""
    import numpy as np

    d = np.zeros(most + 2)
    d[0] = 1
    for q in differ:
        d[1:-1] = d[1:-1] * (1 - q) + d[:-2] * q
        d[0] *= 1 - q
    return np.cumsum(d[:-1]).tolist()


def allocate(candidates: list[list[float]], radius: int) -> tuple[float, list[int]]:
    """(cost, thresholds): from -1 up, adding up to ``radius - parts + 1``, of least total
    cost; ``candidates[i][t]`` is what partition i costs at threshold t (none at -1)."""
    parts, target = len(candidates), radius - len(candidates) + 1
    best = {0: (0.0, [])}
    for cost in candidates:
        new: dict[int, tuple[float, list[int]]] = {}
        for s, (c, ts) in best.items():
            for t in range(-1, radius + 1):
                at = (s + t, c + (cost[t] if t >= 0 else 0), [*ts, t])
                if at[0] not in new or at[1] < new[at[0]][0]:
                    new[at[0]] = at[1:]
        best = new
    assert parts and target in best
    return best[target]


def close_pairs(fps, masks: list[int], radius: int):
    """For each mask the pairs of ``fps`` that differ in at most t of its bits, t to ``radius``."""
    import numpy as np

    out = np.zeros((len(masks), radius + 1), np.int64)
    for i in range(len(fps) - 1):
        x = fps[i + 1 :] ^ fps[i]
        for k, m in enumerate(masks):
            out[k] += np.bincount(np.minimum(np.bitwise_count(x & np.uint64(m)), radius + 1), minlength=radius + 2)[:-1]
    return np.cumsum(out, axis=1)


def mask_of(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def plan(uniq: DataFrame, radius: int = 3, parts: int | None = None, most_in_bucket: int = 2_000_000, sample: int = 4096, probe: float = 50.0) -> list[tuple[int, int]]:
    """[(mask, threshold)]: the probes that together find every link.

    Candidates are counted: at threshold 0 over all fingerprints, for higher thresholds (and to
    compare numbers of partitions, where ``parts`` is None) among the pairs of ``sample``
    fingerprints, or where that finds hardly any, by the rates at which single bits differ over all.
    The sample decides on costs alone; any plan finds every link.  ``probe``: what sending a
    probe costs, in candidates.  Where a bucket would hold more than ``most_in_bucket``
    fingerprints, its mask is refined: the other bits, which hold the differences, are again cut
    into ``radius + 1`` blocks, one of which must be equal.
    """
    import numpy as np

    n, both = bit_counts(uniq)
    if n < 2:
        return []
    p, pairs = np.diag(both) / n, n * (n - 1) / 2
    few = np.array([r.fp for r in smallest(uniq.select("fp", F.xxhash64("fp").alias("_h")), "_h", sample, "fp").collect()], np.int64).view(np.uint64)

    def costs(groups, exact=None):
        near, out = close_pairs(few, [mask_of(g) for g in groups], radius), []
        for i, g in enumerate(groups):
            model, variants, cost = within(2 * p[g] * (1 - p[g]), radius), 0, []
            for t in range(radius + 1):
                variants += _choose(len(g), t)
                rate = near[i, t] / max(len(few) * (len(few) - 1) / 2, 1)
                found = pairs * (rate if near[i, t] >= 10 else max(rate, model[t]))
                if exact is not None:
                    found = exact[i] if t == 0 else max(found, exact[i])
                cost.append(found * (1 if t == 0 else 2) + probe * n * variants)  # with t > 0 pairs meet more than once
            out.append(cost)
        return out

    choice = [group_bits(n, both, k) for k in ([parts] if parts else range(1, radius + 2))]
    groups = min(choice, key=lambda g: allocate(costs(g), radius)[0])
    keys = F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(_signed(mask_of(g)))).alias("key")) for i, g in enumerate(groups)])
    sizes = uniq.select(F.explode(keys).alias("k")).groupBy("k.part", "k.key").count()
    found = {r.part: r for r in sizes.groupBy("part").agg(F.sum(F.col("count").cast("double") * (F.col("count") - 1) / 2).alias("pairs"), F.max("count").alias("top")).collect()}
    out = []
    for i, t in enumerate(allocate(costs(groups, [found[i].pairs for i in range(len(groups))]), radius)[1]):
        if t < 0:
            continue
        masks, top = [mask_of(groups[i])], found[i].top
        while t == 0 and top > most_in_bucket and bin(masks[0]).count("1") < 48:
            masks, top = [m | mask_of(b) for m in masks for b in _blocks(m, radius + 1)], top / 2 ** ((64 - bin(masks[0]).count("1")) // (radius + 1))
        out += [(m, t) for m in masks]
    return out


def _choose(n: int, k: int) -> int:
    import math

    return math.comb(n, k)


def _blocks(mask: int, k: int) -> list[list[int]]:
    rest = [b for b in range(64) if not mask >> b & 1]
    return [rest[i * len(rest) // k : (i + 1) * len(rest) // k] for i in range(k)]


# ---- probing and verification


def spanning_forest(fps, radius: int):
    """Edges (a, b) of a spanning forest of "at most ``radius`` bits differ" on distinct
    ``fps``; large sets are first cut by the pigeonhole principle on the bits that vary."""
    import numpy as np

    edges = []
    if len(fps) > 4096:
        varying = int(np.bitwise_or.reduce(fps) ^ np.bitwise_and.reduce(fps)) & (2**64 - 1)
        if bin(varying).count("1") > 4 * (radius + 1):
            for block in _blocks(~varying & (2**64 - 1), radius + 1):
                key = fps & np.uint64(mask_of(block))
                order = np.argsort(key, kind="stable")
                cuts = np.flatnonzero(np.diff(key[order])) + 1
                for part in np.split(fps[order], cuts):
                    if len(part) > 1:
                        edges += spanning_forest(part, radius)
            return edges
    rest = fps
    while len(rest) > 1:
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            x = todo.pop()
            near = np.bitwise_count(rest ^ x) <= radius
            if near.any():
                got = rest[near]
                edges += [(x, y) for y in got]
                todo.extend(got)
                rest = rest[~near]
    return edges


def links(uniq: DataFrame, radius: int = 3, parts: int | None = None) -> DataFrame:
    """(a, b) with a spanning forest of each bucket's links between distinct fingerprints."""
    import numpy as np

    spark = uniq.sparkSession
    probes = plan(uniq, radius, parts)
    pair = T.StructType([T.StructField("a", LONG), T.StructField("b", LONG)])
    if not probes:
        return spark.createDataFrame([], pair)
    probe = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("key", LONG), T.StructField("fp", LONG)])

    def send(batches):
        import itertools

        import pyarrow as pa

        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i, (mask, t) in enumerate(probes):
                own = [k for k in range(64) if mask >> k & 1]
                for flips in itertools.chain.from_iterable(itertools.combinations(own, k) for k in range(t + 1)):
                    key = (fp & np.uint64(mask)) ^ np.uint64(mask_of(list(flips)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), i, np.int32)), pa.array(key.view(np.int64)), pa.array(fp.view(np.int64))], names=["part", "key", "fp"])

    def verify(batches):
        import pyarrow as pa

        def out(edges):
            e = np.array(edges, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], names=["a", "b"])

        def close(part, key, fp):
            """Links of buckets that lie whole in these sorted arrays."""
            cuts = np.flatnonzero((np.diff(part) != 0) | (np.diff(key) != 0)) + 1
            starts = np.concatenate(([0], cuts))
            size = np.diff(np.concatenate((starts, [len(fp)])))
            edges = []
            small = np.repeat((size > 1) & (size <= 12), size)
            left = np.repeat(starts + size, size) - np.arange(len(fp)) - 1  # rows of the bucket after this one
            for k in range(1, 12):
                at = np.flatnonzero(small & (left >= k))
                if not len(at):
                    break
                at = at[np.bitwise_count(fp[at] ^ fp[at + k]) <= radius]
                at = at[fp[at] != fp[at + k]]
                edges.append(np.stack((fp[at], fp[at + k]), 1))
            for i in np.flatnonzero(size > 12):
                edges.append(np.array(spanning_forest(np.unique(fp[starts[i] : starts[i] + size[i]]), radius), np.uint64).reshape(-1, 2))
            return np.concatenate(edges) if edges else np.zeros((0, 2), np.uint64)

        held: list = []
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False).view(np.uint64)]
            same = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1])
            cut = int(np.argmax(same)) if same.any() else 0
            held.append([c[:cut] for c in cols])
            if cut == 0 and len(held) > 0 and len(held[0][0]) and held[0][0][-1] == cols[0][0] and held[0][1][-1] == cols[1][0]:
                held[-1] = cols  # the bucket goes on
                continue
            whole = [np.concatenate(x) for x in zip(*held, strict=True)]
            held = [[c[cut:] for c in cols]]
            if len(whole[0]):
                yield out(close(*whole))
        if held:
            yield out(close(*[np.concatenate(x) for x in zip(*held, strict=True)]))

    sent = uniq.select("fp").mapInArrow(send, probe)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return sent.repartition(n, "part", "key").sortWithinPartitions("part", "key").mapInArrow(verify, pair)


# ---- connected components


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each node's component, for nodes with an edge.  Rounds go
    on until the edges stay as they are; their number grows with the logarithm of a chain's length."""
    low, high = F.least("a", "b"), F.greatest("a", "b")
    e = stage(edges.where("a <> b").select(low.alias("a"), high.alias("b")).distinct(), "edges")
    seen = None
    while True:
        mark = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == seen or not mark.n:
            break
        seen = mark
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stage(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        big = stage(both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct(), "large")
        drop(e)
        drop(least)
        # small star: every node hands its smaller neighbours, and itself, to the least of them
        least = stage(big.groupBy("b").agg(F.min("a").alias("m")), "least")
        e2 = big.join(least, "b").select(F.explode(F.array("a", "b")).alias("v"), "m").where("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        e = stage(e2, "edges")
        drop(big)
        drop(least)
    return e.groupBy("b").agg(F.min("a").alias("root")).select(F.col("b").alias("node"), "root")


def near_duplicates(docs: DataFrame, keep: list[str], width: int = 3, radius: int = 3, parts: int | None = None, tie: str | None = None) -> DataFrame:
    """``keep`` columns (with doc_id), fp and component_id, the smallest doc_id that can be
    reached over links, for every row.  With ``tie``, a long column of ``keep`` that
    tells rows of one doc_id apart, also keeper: the least ``tie`` of the class's rows
    with that doc_id (a NULL doc_id comes after all others)."""
    keep = [c for c in keep if c not in ("fp", "component_id", "keeper")]
    marked = stage(fingerprints(docs, keep, width), "fp")
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), (F.col(tie) if tie else F.lit(0).cast("long")).alias("tie"))
    uniq = stage(marked.groupBy("fp").agg(F.min(first).alias("rep")), "uniq")
    roots = stage(components(links(uniq, radius, parts)), "roots")
    found = with_classes(marked, uniq, roots)
    for x in (uniq, roots):
        drop(x)
    return found.select(*keep, "fp", "component_id", *["keeper"] * bool(tie))


def with_classes(marked: DataFrame, uniq: DataFrame, roots: DataFrame) -> DataFrame:
    """``marked`` with component_id and keeper: the least rep (none, id, tie) of ``uniq`` in
    the component of the row's fp."""
    ends = roots.select(F.col("node").alias("fp"), "root").unionAll(roots.select(F.col("root").alias("fp"), "root").distinct())
    named = stage(ends.join(uniq, "fp").select("fp", "root", "rep"), "named")
    best = named.groupBy("root").agg(F.min("rep").alias("best"))
    linked = stage(named.join(best, "root").select("fp", "best"), "linked")
    info = uniq.join(linked, "fp", "left").select("fp", F.coalesce("best", "rep").alias("r"))
    info = stage(info.select("fp", F.col("r.id").alias("component_id"), F.col("r.tie").alias("keeper")), "classes")
    for x in (named, linked):
        drop(x)
    return marked.join(info, "fp")


def fingerprint_hex(fp="fp"):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
