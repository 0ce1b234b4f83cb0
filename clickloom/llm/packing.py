"""Best-fit packing by linear grouping.

Texts become token sequences, cut only where they are longer than a bin.  The
packing is decided on the histogram of piece lengths, whose size is the bin's
capacity whatever the corpus: large lengths are rounded up within groups of equal
cardinality, few-size configurations are optimised (column generation: a linear
program over configurations, priced by a knapsack), actual pieces take the rounded
places, and the small pieces go best-fit into what is left.  Pieces then take their
places by their rank among pieces of the same length; ranks come from per-task
counts, so that no length, however frequent, meets in one task.

Nulls and empty texts have one piece with the end token alone.  Repeated rows are
packed each, ties of length take places in the order of their tasks.  Very long texts
and runs of one character are encoded whole.  An empty table gives no pieces.  Extra
columns are ignored; ``keep`` columns named like a result column are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_chunks, with_local_rank, with_rank, with_text

CAPACITY = 2048


def tokenizer_path(kind: str = "tiktoken") -> str:
    """The 50k byte-level BPE, as ranks or (``json``) for ``tokenizers``."""
    import public_tokenizers

    return public_tokenizers.path(f"byte_bpe_50k.{kind}")


def encoder(path: str):
    """text -> token ids as a numpy array of unsigned 32-bit numbers.  Nothing is added to the
    text's own ids; where the text has the string of an added token, that is one id.

    A ``.json`` file is read by ``tokenizers``.  A ``.tiktoken`` file, which holds the ranks
    of a byte-level BPE, is read by ``tiktoken`` with the added tokens of the ``.json`` file beside
    it: the ids are the same (tests hold them against each other), several times faster.  Texts
    whose runs of white space are too long for it go through ``tokenizers``."""
    import json

    import numpy as np

    if path.endswith(".json"):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        return lambda text: np.array(tok.encode(text, add_special_tokens=False).ids, np.uint32)
    import base64

    import public_tokenizers
    import tiktoken

    beside = path.removesuffix(".tiktoken") + ".json"
    with open(beside) as f:
        added = json.load(f)["added_tokens"]
    whole = encoder(beside)
    if any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in added):
        return whole
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={a["content"]: a["id"] for a in added})

    def encode(text: str):
        try:
            return enc.encode_to_numpy(text, allowed_special="all")
        except ValueError:  # its regular expressions have a stack of their own
            return whole(text)

    return encode


def _cut(docs: DataFrame, keep: list[str], path: str | None, capacity: int, end_id: int):
    """(texts, function over their batches, schema of what it gives)."""
    keep = [c for c in keep if c not in ("piece", "start", "length", "ids_crc32")]
    path = path or tokenizer_path()
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("piece", T.IntegerType())] + [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")])

    def run(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        encode = encoder(path)
        for part, texts in text_chunks(batches, "_text", 2_000_000):
            row, piece, start, length, crc = [], [], [], [], []
            for i, t in enumerate(texts):
                ids = np.append(encode((t or b"").decode()), [end_id]).astype("<u4")
                n = len(ids)
                first = n % capacity or min(n, capacity)
                at, k = 0, 0
                while at < n:
                    size = first if k == 0 else capacity
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(ids[at : at + size]))
                    at, k = at + size, k + 1
            taken = part.take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*(taken.column(i) for i in range(len(keep))), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                names=[*keep, "piece", "start", "length", "ids_crc32"],
            )

    return with_text(docs, keep), run, schema


def pieces(docs: DataFrame, keep: list[str], path: str | None = None, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """``keep`` columns, piece, start, length and ids_crc32: a row for each piece of each text.

    A longer text is cut from its end, so that the first piece may be shorter."""
    texts, run, schema = _cut(docs, keep, path, capacity, end_id)
    return texts.mapInArrow(run, schema)


def pack_texts(docs: DataFrame, keep: list[str], path: str | None = None, capacity: int = CAPACITY, end_id: int = 0, groups: int = 48) -> DataFrame:
    """:func:`pieces` with sequence_id and offset; texts are encoded and pieces ranked in one go."""
    texts, run, schema = _cut(docs, [k for k in keep if k not in ("sequence_id", "offset")], path, capacity, end_id)
    return _placed(with_local_rank(texts, ["length"], "pieces", (run, schema)), capacity, groups)


# ---- the packing, on the histogram of lengths


def equal_groups(counts: dict[int, int], groups: int) -> list[tuple[int, int]]:
    """[(rounded size, pieces)]: lengths, largest first, in groups of about equal cardinality;
    each group is rounded up to its largest length."""
    total, out, size, n, seen = sum(counts.values()), [], None, 0, 0
    for length in sorted(counts, reverse=True):
        size = length if size is None else size
        n += counts[length]
        seen += counts[length]
        if seen >= total * (len(out) + 1) / groups:
            out.append((size, n))
            size, n = None, 0
    if n:
        out.append((size, n))
    return out


def knapsack(sizes: list[int], worth, capacity: int, limit: list[int]):
    """The configuration (copies of each size) of highest worth within ``capacity``."""
    import numpy as np

    best = np.zeros(capacity + 1)
    choice = []
    for s, w, most in zip(sizes, worth, limit, strict=True):
        taken = np.zeros(capacity + 1, np.int64)
        new = best.copy()
        for k in range(1, min(capacity // s, most) + 1) if w > 1e-12 else ():
            c = np.full(capacity + 1, -1.0)
            c[k * s :] = best[: capacity + 1 - k * s] + k * w
            better = c > new + 1e-12
            new[better], taken[better] = c[better], k
        best = new
        choice.append(taken)
    at, out = int(best.argmax()), [0] * len(sizes)
    value = float(best[at])
    for j in range(len(sizes) - 1, -1, -1):
        out[j] = int(choice[j][at])
        at -= out[j] * sizes[j]
    return value, out


def configurations(groups: list[tuple[int, int]], capacity: int, rounds: int = 400) -> list[tuple[list[int], int]]:
    """[(copies of each size, times)] that hold every piece of ``groups``: the linear
    program of least bins over configurations, by column generation; its whole parts,
    then for what remains the fullest configurations, one after the other."""
    import numpy as np

    sizes, need = [s for s, _ in groups], np.array([n for _, n in groups], float)
    k = len(sizes)
    cols = [[capacity // s if i == j else 0 for j in range(k)] for i, s in enumerate(sizes)]
    basis = np.array(cols, float).T  # each column a configuration
    x = np.linalg.solve(basis, need)
    for _ in range(rounds):
        dual = np.linalg.solve(basis.T, np.ones(k))
        value, new = knapsack(sizes, dual, capacity, [capacity] * k)
        if value <= 1 + 1e-7:
            break
        d = np.linalg.solve(basis, np.array(new, float))
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        leave = int(ratio.argmin())
        step = ratio[leave]
        x = np.maximum(x - step * d, 0)
        x[leave] = step
        basis[:, leave] = new
    left, out = [n for _, n in groups], []
    for j in np.argsort(-x):
        c = basis[:, j].astype(int).tolist()
        times = int(x[j] + 1e-9)
        times = min([times, *(left[i] // m for i, m in enumerate(c) if m)])
        if times > 0:
            out.append((c, times))
            left = [n - times * m for n, m in zip(left, c, strict=True)]
    while any(left):
        _, c = knapsack(sizes, [s if n else 0 for s, n in zip(sizes, left, strict=True)], capacity, left)
        times = min(left[i] // m for i, m in enumerate(c) if m)
        out.append((c, times))
        left = [n - times * m for n, m in zip(left, c, strict=True)]
    return out


def pack(counts: dict[int, int], capacity: int = CAPACITY, groups: int = 48):
    """:func:`pack_at` with the limit between small and large lengths, of a few, that
    takes the fewest bins (the least such limit)."""
    limits = sorted({capacity // 8, capacity // 4, capacity // 3, max(capacity // 2 - 1, 0)})
    return min((pack_at(counts, capacity, groups, s) for s in limits), key=lambda found: found[1])


def pack_at(counts: dict[int, int], capacity: int, groups: int, small: int):
    """Places for the pieces of each length: [(length, first rank, pieces, first bin,
    offset)] - rank r of the length goes to bin ``first bin + (r - first rank)`` at
    ``offset`` - and the number of bins.  Everything is done on runs of like bins, so the
    work depends on the capacity, not on the number of pieces."""
    counts = {k: n for k, n in counts.items() if n > 0}
    large = {k: n for k, n in counts.items() if k > small}
    used: dict[int, int] = dict.fromkeys(counts, 0)  # ranks given out
    runs: list[tuple[int, int, int, int, int]] = []
    classes: dict[int, list[tuple[int, int]]] = {}  # room left -> [(first bin, bins)]
    bins = 0

    def place(length: int, first_bin: int, n: int, offset: int) -> None:
        runs.append((length, used[length], n, first_bin, offset))
        used[length] += n

    if large:
        grouped = equal_groups(large, groups)
        lengths = sorted(large, reverse=True)
        member: list[list[list[int]]] = []  # group -> [[length, pieces left]]
        i = 0
        for _, n in grouped:
            own = []
            while n > 0:
                own.append([lengths[i], large[lengths[i]]])
                n -= large[lengths[i]]
                i += 1
            member.append(own)
        for copies, times in configurations(grouped, capacity):
            segments = [(bins, times, 0)]  # (first bin, bins, filled)
            bins += times
            for g, m in enumerate(copies):
                for _ in range(m):
                    new = []
                    for first, n, filled in sorted(segments, key=lambda s: -s[2]):
                        while n > 0:  # actual pieces take the rounded places, the shortest in the fullest bins
                            length, have = member[g][-1]
                            t = min(n, have)
                            place(length, first, t, filled)
                            new.append((first, t, filled + length))
                            first, n = first + t, n - t
                            member[g][-1][1] -= t
                            if not member[g][-1][1]:
                                member[g].pop()
                    segments = new
            for first, n, filled in segments:
                classes.setdefault(capacity - filled, []).append((first, n))
    # small pieces, longest first: each into the fullest bin that holds it
    for length in sorted((k for k in counts if k <= small), reverse=True):
        need = counts[length]
        while need:
            room = min((r for r in classes if r >= length), default=None)
            if room is None:
                fit = capacity // length
                n = -(-need // fit)
                classes.setdefault(capacity, []).append((bins, n))
                bins += n
                continue
            first, n = classes[room].pop()
            if not classes[room]:
                del classes[room]
            full = min(n, need // (room // length))
            copies = room // length
            if full:
                for k in range(copies):
                    place(length, first, full, capacity - room + k * length)
                classes.setdefault(room - copies * length, []).append((first, full))
                need -= full * copies
                first, n = first + full, n - full
            if need and n:  # the last bin takes fewer copies
                for k in range(need):
                    place(length, first, 1, capacity - room + k * length)
                classes.setdefault(room - need * length, []).append((first, 1))
                need, first, n = 0, first + 1, n - 1
            if n:
                classes.setdefault(room, []).append((first, n))
        classes.pop(0, None)
    return runs, bins


def sequences(found: DataFrame, capacity: int = CAPACITY, groups: int = 48) -> DataFrame:
    """``found`` (with a long column length) with sequence_id and offset."""
    return _placed(with_local_rank(found.drop("sequence_id", "offset"), ["length"], "pieces"), capacity, groups)


def _placed(ranked: DataFrame, capacity: int, groups: int) -> DataFrame:
    import numpy as np

    counts = {r.length: r.n for r in ranked.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    runs, _ = pack(counts, capacity, groups)
    runs.sort()
    key = np.array([r[0] for r in runs], np.int64) << 44 | np.array([r[1] for r in runs], np.int64)
    sent = ranked.sparkSession.sparkContext.broadcast((key, np.array(runs, np.int64).reshape(-1, 5)))  # a few thousand runs: it depends on the capacity
    full = with_rank(ranked, ["length"], "_rank")
    names = [c for c in full.columns if c != "_rank"]
    schema = T.StructType([full.schema[c] for c in names] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches):
        import pyarrow as pa

        key, runs = sent.value
        for b in batches:
            if not b.num_rows:
                continue
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_rank"))
            i = np.searchsorted(key, length << 44 | rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in names), pa.array(runs[i, 3] + rank - runs[i, 1]), pa.array(runs[i, 4])], names=[*names, "sequence_id", "offset"])

    return full.mapInArrow(run, schema)
