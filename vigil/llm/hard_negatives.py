"""Hard negatives by Kronecker-packed products.

Components are scaled and floored to integers, so a score is an exact integer
inner product. A tile of the work holds one chunk of candidates and one block
of anchors. There both sides are biased to non-negative numbers; several
candidates' components share one wide integer as separate fields, each wide
enough that the sums of a whole product never carry into the next field. One
multiplication per anchor component then serves all candidates of a word, and
the fields, less what the biases added, are the exact scores. The field width
comes from the tile's own numbers (Cauchy-Schwarz); where even one field
outgrows 64 bits the same code runs on integers of any length.

Two passes over the tiles: the first finds each anchor's best rows of its own
label (candidates are sorted by label, so it multiplies those alone); when the
tiles' answers are merged, the positives' scores bound the second, which finds
the best rows of other labels between two shares of each positive's score. A
tile answers with a few rows per anchor. Candidates are dealt to chunks by a
hash of the whole row, so a hot label or many copies of one vector spread; all
candidates are compared with all anchors, in blocks.

Defined cases: rows with a null id, label or vector, with null or non-finite
components, or with a vector of another length than the most frequent one (of
ties the shorter) take no part; a repeated row is as many candidates, but
equal anchors are one; rows with the anchor's own id are never its candidates;
ties go to the smaller id; an anchor without positives, or a positive without
a row in its range, gives no rows. Scaled components and scores beyond 64 bits
saturate. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.common import staged

SCALE, EVERY, POSITIVES, NEGATIVES = 256, 50, 5, 3
#: A negative's score lies between these percentages of the positive's.
LOW, HIGH = 50, 95
#: Candidates of a chunk, anchors of a block, and anchors multiplied at a time.
CHUNK, BLOCK, STEP = 4_096, 1_024, 32

RESULT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def usable(table: DataFrame, vec_id: str, vector: str, label: str, scale: int) -> DataFrame:
    """(id, label, v as array<bigint>) of the rows that take part, before the rule on lengths."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    good = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= 1.7976931348623157e308))
    return (table.where(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & good)
            .select(F.col(vec_id).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"),
                    F.transform(x, lambda c: F.floor(c * F.lit(float(scale))).cast("bigint")).alias("v")))


def _matrix(col):
    import numpy as np

    col = getattr(col, "combine_chunks", lambda: col)()
    return np.asarray(col.flatten(), dtype=np.int64).reshape(len(col), -1)


def _biased(rows) -> tuple:
    """(rows less their least component, that component, a bound of the biased rows' lengths, the largest component's
    size). Integers of any length where 64 bits could overflow."""
    import math

    low, high = int(rows.min(initial=0)), int(rows.max(initial=0))
    big = high - low >= 1 << 24
    up = (rows.astype(object) if big else rows) - low
    squares = (up * up).sum(axis=1)
    return up, low, math.isqrt(max((int(x) for x in squares), default=0)) + 1, max(-low, high)


class Packed:
    """Candidates (rows by components) in fields of wide integers, for the given anchors."""

    def __init__(self, rows, anchors):
        import numpy as np

        up, self.low, norm, size = _biased(rows)
        self.anchors, self.anchor_low, anchor_norm, anchor_size = _biased(anchors)
        self.n, self.dims = rows.shape
        self.bits = (norm * anchor_norm).bit_length()
        self.any = max(self.bits, (self.dims * size * anchor_size).bit_length()) > 62  # beyond 64-bit words
        kind = object if self.any else np.uint64
        self.fields = 1 if self.any else 64 // self.bits
        self.sums, self.anchor_sums = ((x.astype(object) if self.any else x).sum(axis=1) for x in (rows, anchors))
        self.anchors = self.anchors.astype(kind)
        self.words = np.zeros((self.dims, -(-self.n // self.fields)), dtype=kind)
        for k in range(self.fields):
            part = up[k::self.fields].T.astype(kind)
            self.words[:, :part.shape[1]] += part << np.uint64(k * self.bits) if k else part

    def scores(self, lo: int, hi: int):
        """Exact inner products of anchors lo to hi with all candidates."""
        import numpy as np

        a = self.anchors[lo:hi]
        total = np.zeros((len(a), self.words.shape[1]), dtype=self.words.dtype)
        for d in range(self.dims):
            total += a[:, d, None] * self.words[d]
        if self.any:
            out = total
        else:
            out, mask = np.zeros((len(a), self.n), dtype=np.int64), np.uint64((1 << self.bits) - 1)
            for k in range(self.fields):
                places = len(range(k, self.n, self.fields))
                out[:, k::self.fields] = (total[:, :places] >> np.uint64(k * self.bits)) & mask
        # the biases added: a field holds (a - p)(c - q) summed, that is ac - q sum(a) - p sum(c) + dims p q
        p, q = self.anchor_low, self.low
        return out + q * self.anchor_sums[lo:hi, None] + p * self.sums[None, :] - self.dims * p * q


def _best(scores, ids, k: int):
    """Places of the k highest scores, ties by the smaller id."""
    import numpy as np

    at = np.arange(len(scores))
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def _long(values):
    """int64, saturated."""
    import numpy as np

    v = np.asarray(values)
    return v if v.dtype != object else np.array([max(-(1 << 63), min((1 << 63) - 1, int(x))) for x in v], dtype=np.int64)


class Chunk:
    """A chunk's candidates, sorted by label, then id."""

    def __init__(self, row):
        import numpy as np

        self.ids, self.labels = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i8")
        self.rows = np.frombuffer(row["comps"], f"<i{row['width']}").astype(np.int64).reshape(len(self.ids), -1)

    def of_label(self, label: int) -> slice:
        import numpy as np

        return slice(*np.searchsorted(self.labels, [label, label + 1]).tolist()) if label < (1 << 63) - 1 else slice(int(np.searchsorted(self.labels, label)), len(self.ids))


def _chunks(rows: DataFrame, chunks: int) -> DataFrame:
    """One row per chunk: its ids, labels and components as bytes."""

    def put(key, table):
        import numpy as np
        import pyarrow as pa

        ids, labels, rows_ = table.column("id").to_numpy(), table.column("label").to_numpy(), _matrix(table.column("v"))
        order = np.lexsort((ids, labels))
        top = max(-int(rows_.min(initial=0)), int(rows_.max(initial=0)))
        width = 2 if top < 1 << 15 else 4 if top < 1 << 31 else 8
        got = [x[order].astype(f"<i{w}").tobytes() for x, w in ((ids, 8), (labels, 8), (rows_, width))]
        return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([width], pa.int32()), *(pa.array([g], pa.binary()) for g in got)],
                        names=["chunk", "width", "ids", "labels", "comps"])

    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("id", "label", "v"), F.lit(chunks)).cast("bigint"))
    return dealt.groupBy("chunk").applyInArrow(put, "chunk bigint, width int, ids binary, labels binary, comps binary")


def _tiles(index: DataFrame, anchors: DataFrame, chunks: int, blocks: int, run, schema: str) -> DataFrame:
    """``run(chunk, anchors table)`` on every chunk with every block of anchors."""

    def tile(key, left, right):
        return run(Chunk(left.to_pylist()[0]) if left.num_rows else None, right)

    left = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")))
    right = anchors.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)).cast("array<bigint>")))
    return left.groupBy("chunk", "block").cogroup(right.groupBy("chunk", "block")).applyInArrow(tile, schema)


def _positives(k: int):
    def run(chunk: Chunk, table):
        import numpy as np
        import pyarrow as pa

        keys, ids, labels, v = table.column("akey").to_numpy(), table.column("id").to_numpy(), table.column("label").to_numpy(), _matrix(table.column("v"))
        out = [[np.zeros(0, np.int64)] for _ in range(3)]
        for label in np.unique(labels).tolist() if chunk else []:
            own = chunk.of_label(label)
            if own.stop <= own.start:
                continue
            mine, cand = np.flatnonzero(labels == label), chunk.ids[own]
            packed = Packed(chunk.rows[own], v[mine])
            for at in range(0, len(mine), STEP):
                for i, s in zip(mine[at:at + STEP].tolist(), packed.scores(at, at + STEP), strict=True):
                    other = np.flatnonzero(cand != ids[i])
                    got = other[_best(s[other], cand[other], k)]
                    for o, x in zip(out, (np.full(len(got), keys[i]), cand[got], _long(s[got])), strict=True):
                        o.append(x)
        return pa.table([np.concatenate(o) for o in out], names=["akey", "positive_id", "positive_score"])

    return run


def _negatives(k: int, low_share: int, high_share: int):
    def run(chunk: Chunk, table):
        import numpy as np
        import pyarrow as pa

        keys, ids, labels, v = table.column("akey").to_numpy(), table.column("id").to_numpy(), table.column("label").to_numpy(), _matrix(table.column("v"))
        wanted = table.column("wanted").to_pylist()
        packed = Packed(chunk.rows, v) if chunk and len(ids) else None
        out = [[np.zeros(0, np.int64)] for _ in range(4)]
        for at in range(0, len(ids), STEP) if packed else []:
            for i, s in enumerate(packed.scores(at, at + STEP), start=at):
                ranges = [(-(-low_share * p // 100), high_share * p // 100) for p in wanted[i]]
                fits = (s >= min(x for x, _ in ranges)) & (s <= max(x for _, x in ranges)) & (chunk.ids != ids[i])
                fits[chunk.of_label(int(labels[i]))] = False
                fits = np.flatnonzero(fits)
                some = s[fits]
                for no, (least, most) in enumerate(ranges):
                    here = fits[(some >= least) & (some <= most)]
                    got = here[_best(s[here], chunk.ids[here], k)]
                    for o, x in zip(out, (np.full(len(got), keys[i]), np.full(len(got), no, np.int64), chunk.ids[got], _long(s[got])), strict=True):
                        o.append(x)
        return pa.table([np.concatenate(o) for o in out], names=["akey", "pno", "negative_id", "negative_score"])

    return run


def mine(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE, every: int = EVERY,
         positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, chunk_rows: int = CHUNK, block_rows: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row whose id is divisible
    by ``every`` and each of its best ``positives`` rows of the same label, the best ``negatives`` rows of other labels
    that score from ``low`` to ``high`` percent of the positive."""
    rows = usable(table, vec_id, vector, label, scale)
    common = (rows.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("c"), F.count_if(F.col("id") % every == 0).alias("a"))
              .orderBy(F.desc("c"), "n").limit(1).collect())
    if not common or not common[0].a or not common[0].n:
        return rows.sparkSession.createDataFrame([], RESULT)
    rows = rows.where(F.size("v") == common[0].n)
    chunks, blocks = max(1, -(-common[0].c // chunk_rows)), max(1, -(-common[0].a // block_rows))
    index = staged(_chunks(rows, chunks))
    key = F.xxhash64("id", "label", "v")
    anchors = staged(rows.where(F.col("id") % every == 0).dropDuplicates().withColumn("akey", key).withColumn("block", F.pmod("akey", F.lit(blocks)).cast("bigint")))

    found = _tiles(index, anchors, chunks, blocks, _positives(positives), "akey bigint, positive_id bigint, positive_score bigint")
    first = Window.partitionBy("akey").orderBy(F.desc("positive_score"), "positive_id")
    found = staged(found.withColumn("pno", F.row_number().over(first) - 1).where(F.col("pno") < positives))
    bounds = found.groupBy("akey").agg(F.transform(F.array_sort(F.collect_list(F.struct("pno", "positive_score"))), lambda x: x["positive_score"]).alias("wanted"))  # a few per anchor
    asked = anchors.join(bounds, "akey")

    got = _tiles(index, asked, chunks, blocks, _negatives(negatives, low, high), "akey bigint, pno bigint, negative_id bigint, negative_score bigint")
    best = Window.partitionBy("akey", "pno").orderBy(F.desc("negative_score"), "negative_id")
    got = got.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    named = found.join(anchors.select("akey", F.col("id").alias("anchor_id")), "akey")
    return named.join(got, ["akey", "pno"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
