"""Best-fit packing by patterns fitted with non-negative least squares.

Documents become pieces of at most ``size`` tokens (only longer ones are cut;
their first piece takes the remainder). The histogram of piece lengths, at most
``size`` numbers, is all that the driver sees. Patterns of one to three lengths
that fill a sequence exactly are enumerated, their repeat counts are fitted to
the histogram by non-negative least squares, rounded down to what the
histogram holds, and the residual lengths are packed by best-fit decreasing on
the histogram. The plan (which lengths share a sequence, how often) is bounded
by the sequence size, not by the data; pieces find their place in it by their
rank among the pieces of their length, which is counted in two levels so that
a frequent length is spread over many tasks.

Defined cases: a null text is an empty document, whose only token is the end
token; repeated rows are packed each for itself; an empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.llm.common import cached, staged
from vigil.llm.tokens import encoder, vocabulary_path

SIZE, END_ID = 1024, 2
#: Rounds of the projected gradient, and rows that one ranking group holds on average at most.
ROUNDS, GROUP_ROWS = 400, 200_000


def pieces(docs: DataFrame, text: str = "text", row_id: str = "doc_id", size: int = SIZE, end_id: int = END_ID,
           vocabulary: str | None = None) -> DataFrame:
    """One row per piece: the id column, piece, start, length, and ids (little-endian unsigned 32-bit)."""
    path = vocabulary or vocabulary_path()
    schema = T.StructType([T.StructField(row_id, docs.schema[row_id].dataType), T.StructField("piece", T.IntegerType()),
                           T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
                           T.StructField("ids", T.BinaryType())])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        enc = encoder(path)
        for b in batches:
            rows, nums, starts, lengths, blobs = [], [], [], [], []
            for k, t in enumerate(b.column(1).to_pylist()):
                ids = np.array([*enc.ids(t or ""), end_id], dtype="<u4")
                first = len(ids) % size or size
                cuts = [0, *range(min(first, len(ids)), len(ids) + 1, size)]
                for p, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    rows.append(k)
                    nums.append(p)
                    starts.append(lo)
                    lengths.append(hi - lo)
                    blobs.append(ids[lo:hi].tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(nums, pa.int32()), pa.array(starts, pa.int64()),
                                              pa.array(lengths, pa.int64()), pa.array(blobs, pa.binary())],
                                             [row_id, "piece", "start", "length", "ids"])

    return docs.select(row_id, text).mapInArrow(run, schema)


def patterns(size: int, lengths) -> list[tuple[int, ...]]:
    """Sets of two and three of the given lengths that fill a sequence exactly."""
    have = sorted(lengths)
    there = set(have)
    out = []
    for i, a in enumerate(have):
        if 2 * a <= size and size - a in there:
            out.append((size - a, a))
        for b in have[i:]:
            c = size - a - b
            if c < b:
                break
            if c in there:
                out.append((c, b, a))
    return out


def fit_counts(pats: list[tuple[int, ...]], hist, size: int, rounds: int = ROUNDS):
    """Non-negative counts x with sum of x * pattern near the histogram: accelerated projected gradient on
    the least squares, lengths weighted by their share of a sequence (long ones are harder to place)."""
    import numpy as np

    rows = np.array([x for p in pats for x in p], dtype=np.int64)
    cols = np.array([k for k, p in enumerate(pats) for _ in p], dtype=np.int64)
    w = np.sqrt(np.arange(size + 1) / size)
    target, wr = w * hist, w[rows]
    per_col = np.bincount(cols, wr * wr, len(pats))
    per_row = np.bincount(rows, wr, size + 1)
    # step sizes by row and column sums (diagonal preconditioning): ||D^-1/2 A^T A D^-1/2|| <= 1 for d_j = sum_i a_ij (sum_k a_ik)
    d = np.bincount(cols, wr * per_row[rows], len(pats))
    x = np.maximum(0, np.bincount(cols, wr * target[rows], len(pats)) / np.maximum(per_col * 50, 1e-12)) * 0
    y, t = x.copy(), 1.0
    for _ in range(rounds):
        resid = np.bincount(rows, wr * y[cols], size + 1) - target
        nx = np.maximum(0, y - np.bincount(cols, wr * resid[rows], len(pats)) / np.maximum(d, 1e-12))
        nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = nx + (t - 1) / nt * (nx - x)
        x, t = nx, nt
    return x


def plan(hist, size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a sequence, number of such sequences) that use up the histogram ``hist[0..size]``."""
    import numpy as np

    left = np.array(hist, dtype=np.int64)
    out: list[tuple[tuple[int, ...], int]] = []
    if left[size]:
        out.append(((size,), int(left[size])))
        left[size] = 0
    pats = patterns(size, np.flatnonzero(left).tolist())
    if pats:
        x = fit_counts(pats, left.astype(float), size)
        for k in np.argsort(-x, kind="stable").tolist():
            n = int(x[k] + 1e-9)
            if n < 1:
                break
            need: dict[int, int] = {}
            for v in pats[k]:
                need[v] = need.get(v, 0) + 1
            n = min([n, *(int(left[v]) // c for v, c in need.items())])
            if n > 0:
                out.append((pats[k], n))
                for v, c in need.items():
                    left[v] -= n * c
    # the residual: best-fit decreasing, many equal sequences at a time. open_[s]: sequences with s tokens of room
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    room = np.zeros(size + 1, dtype=bool)

    def put(lengths: tuple[int, ...], n: int) -> None:
        s = size - sum(lengths)
        if s == 0:
            out.append((lengths, n))
        else:
            open_.setdefault(s, []).append((lengths, n))
            room[s] = True

    for v in np.flatnonzero(left)[::-1].tolist():
        n = int(left[v])
        while n:
            fits = np.flatnonzero(room[v:])
            if len(fits) == 0:
                each = size // v
                if n >= each:
                    put((v,) * each, n // each)
                if n % each:
                    put((v,) * (n % each), 1)
                break
            s = v + int(fits[0])
            lengths, m = open_[s].pop()
            take = min(m, n)
            if take < m:
                open_[s].append((lengths, m - take))
            if not open_[s]:
                room[s] = False
            n -= take
            put((*lengths, v), take)
    out += [x for s in sorted(open_) for x in open_[s]]
    return out


def _places(layout: list[tuple[tuple[int, ...], int]], size: int) -> dict[int, tuple]:
    """Per length: first ranks (ascending), sequence base and offset of each run of places."""
    import numpy as np

    runs: dict[int, list[tuple[int, int, int]]] = {}
    base = 0
    for lengths, n in layout:
        at = 0
        for v in lengths:
            runs.setdefault(v, []).append((n, base, at))
            at += v
        base += n
    out = {}
    for v, r in runs.items():
        n, b, o = (np.array(c, dtype=np.int64) for c in zip(*r, strict=True))
        out[v] = (np.concatenate([[0], np.cumsum(n)[:-1]]), b, o)
    return out


def pack(piece_rows: DataFrame, row_id: str = "doc_id", size: int = SIZE, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``piece_rows`` (id column, piece, length, and any others) with sequence_id and offset. Rows are read
    more than once, so they should be a table (see ``common.staged``), not a tokeniser's output."""
    spark = piece_rows.sparkSession
    hist = [0] * (size + 1)
    for r in piece_rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():  # at most ``size`` rows
        hist[int(r["length"])] = int(r.n)
    layout = spark.sparkContext.broadcast(_places(plan(hist, size), size))
    key = uuid.uuid4().hex
    groups = max(64, -(-max(hist) // group_rows))
    d = piece_rows.withColumn("_g", F.pmod(F.xxhash64(F.col(row_id), F.col("piece")), F.lit(groups)))
    sizes = d.groupBy("length", "_g").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_g")) - F.col("_n")).drop("_n")
    order = [F.col(c) for c, kind in d.dtypes if c != "_g" and not kind.startswith("map")]
    ranked = (d.withColumn("_r", F.row_number().over(Window.partitionBy("length", "_g").orderBy(F.col(row_id), F.col("piece"), *order)))
              .join(before, ["length", "_g"]).withColumn("_rank", F.col("_before") + F.col("_r") - 1).drop("_r", "_before", "_g"))
    ranked = ranked.select(*piece_rows.columns, "_rank")
    schema = T.StructType([f for f in piece_rows.schema.fields if f.name not in ("sequence_id", "offset")]
                          + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    names = schema.names[:-2]

    def place(batches):
        import numpy as np
        import pyarrow as pa

        at = cached(key, lambda: layout.value)
        for b in batches:
            length = b.column("length").to_numpy(zero_copy_only=False)
            rank = b.column("_rank").to_numpy(zero_copy_only=False)
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for v in np.unique(length).tolist():
                here = np.flatnonzero(length == v)
                first, base, offset = at[v]
                k = np.searchsorted(first, rank[here], side="right") - 1
                seq[here], off[here] = base[k] + rank[here] - first[k], offset[k]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(seq), pa.array(off)], schema.names)

    return ranked.mapInArrow(place, schema)


def best_fit(docs: DataFrame, text: str = "text", row_id: str = "doc_id", size: int = SIZE, end_id: int = END_ID,
             vocabulary: str | None = None, digests: dict | None = None) -> DataFrame:
    """Tokenise, cut and pack. ``digests`` (name -> column over ``ids``) replace the ids in the result; without
    them the ids themselves are kept."""
    p = pieces(docs, text, row_id, size, end_id, vocabulary)
    if digests:
        p = p.select(row_id, "piece", "start", "length", *(c.alias(n) for n, c in digests.items()))
    return pack(staged(p), row_id, size)
