"""Approximate nearest neighbours by multi-index hashing.

Vectors are centred, turned by the principal axes and by a rotation learned to
make signs faithful (iterative quantisation), and cut to sign bits. A code is
split into substrings; each shard of the index holds, for each substring, its
rows sorted by the substring's value. A query probes, in every substring, all
values within floor(radius / substrings) flipped bits: by the pigeonhole
principle that meets every code within the Hamming radius. Those codes are
checked against the whole radius and reranked by exact Euclidean distance on
the original vectors in double precision.

The rotation and the radius are fitted on a bounded sample (``SAMPLE`` rows by
hash of the id); every row is indexed. The radius covers the nearest
neighbours of sample rows in the sample, which are farther than in the whole
table, so that recall only rises with the data. A query that found too few
within the radius is searched again with the radius of a whole code.

Index shards are dealt by a hash of the id, so equal vectors spread over all
shards. Queries are dealt in blocks to every shard; each shard answers with at
most ``k`` rows per query, which are merged.

Defined cases: vectors null, zero, of another length than the most frequent
one, or holding null or non-finite components take no part, as queries or as
candidates; equal distances rank by the smaller id; a repeated id is as many
candidates; no usable vector gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import cached, staged

K, EVERY = 10, 100
SAMPLE, SAMPLE_QUERIES, ROUNDS = 8_192, 256, 30
#: Share of the sample's neighbours that the radius covers, bits of a substring, rows of a shard, queries of a block.
COVER, SUBSTRING, SHARD_ROWS, BLOCK = 0.97, 8, 32_768, 1_024

RESULT = "query_id bigint, vec_id bigint, score double"


def usable(table: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(id, v as array<double>) of the rows that take part."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    big = 1.7976931348623157e308
    good = (F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= big)) & F.exists(v, lambda x: x != 0) & F.col(vec_id).isNotNull())
    rows = table.select(F.col(vec_id).cast("bigint").alias("id"), v.alias("v")).where(good)
    return rows


def learn(sample, bits: int, seed: int = 10) -> tuple:
    """(mean, projection) of iterative quantisation on a bounded sample."""
    import numpy as np

    mean = sample.mean(axis=0)
    y = sample - mean
    _, axes = np.linalg.eigh(y.T @ y)
    axes = axes[:, ::-1][:, :bits]
    v = y @ axes
    rot = np.linalg.qr(np.random.default_rng(seed).normal(size=(axes.shape[1],) * 2))[0]
    for _ in range(ROUNDS):
        signs = np.where(v @ rot >= 0, 1.0, -1.0)
        u, _, wt = np.linalg.svd(v.T @ signs)
        rot = u @ wt
    return mean, axes @ rot


def codes(vectors, model) -> object:
    """uint8 substrings, one row per vector: bit b of the code is bit b % 8 of substring b // 8."""
    import numpy as np

    mean, proj = model
    return np.packbits((vectors - mean) @ proj >= 0, axis=1, bitorder="little")


def _ones():
    import numpy as np

    return np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(axis=1).astype(np.uint8)


def distances(x, q):
    """Exact distances of the rows of x to q, always by the same sum order."""
    import numpy as np

    d = x - q
    return np.sqrt(np.einsum("ij,ij->i", d, d, optimize=False))


def calibrate(sample, model, k: int) -> int:
    """The Hamming radius that covers ``COVER`` of the sample's nearest neighbours."""
    import numpy as np

    c, ones = codes(sample, model), _ones()
    got = []
    for i in range(0, len(sample), max(1, len(sample) // SAMPLE_QUERIES)):
        d = distances(sample, sample[i])
        d[i] = np.inf
        near = np.argpartition(d, min(k, len(d) - 1))[:k]
        near = near[np.isfinite(d[near])]
        got += ones[c[near] ^ c[i]].sum(axis=1).tolist()
    return int(np.quantile(got, COVER, method="higher")) if got else 8 * c.shape[1]


class Shard:
    """One shard's vectors, codes and substring tables."""

    def __init__(self, ids, vectors, code):
        import numpy as np

        self.ids, self.vectors, self.code = ids, vectors, code
        self.order = np.argsort(code, axis=0, kind="stable")
        self.first = [np.searchsorted(code[self.order[:, j], j], np.arange(257)) for j in range(code.shape[1])]
        self.ones = _ones()

    def within(self, q, radius: int):
        """Rows whose code is within the radius of q's."""
        import numpy as np

        m = self.code.shape[1]
        flips, seen = radius // m, np.zeros(len(self.ids), dtype=bool)
        for j in range(m):
            for value in np.flatnonzero(self.ones[np.arange(256) ^ q[j]] <= flips).tolist():
                seen[self.order[self.first[j][value]:self.first[j][value + 1], j]] = True
        rows = np.flatnonzero(seen)
        return rows[self.ones[self.code[rows] ^ q].sum(axis=1) <= radius]

    def search(self, qid: int, qv, qc, radius: int, k: int):
        import numpy as np

        rows = self.within(qc, radius)
        rows = rows[self.ids[rows] != qid]
        d = distances(self.vectors[rows], qv)
        best = np.lexsort((self.ids[rows], d))[:k]
        return self.ids[rows[best]], d[best]


def _matrix(col):
    import numpy as np

    col = getattr(col, "combine_chunks", lambda: col)()
    if len(col) == 0:
        return np.zeros((0, 0))
    return np.asarray(col.flatten(), dtype=np.float64).reshape(len(col), -1)


def search(rows: DataFrame, queries: DataFrame, model, radius: int, k: int, shards: int, n_queries: int) -> DataFrame:
    """(query_id, vec_id, score): each query's nearest ``k`` among the codes within the radius, from every shard."""
    blocks = max(1, -(-n_queries // BLOCK))
    index = rows.select(F.pmod(F.xxhash64("id"), F.lit(shards)).alias("s"), "id", "v")
    index = index.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))) if blocks > 1 else index.withColumn("b", F.lit(0))
    asked = (queries.select(F.col("id"), "v", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int").alias("b"))
             .withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<bigint>"))))
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(key, table, ask):
        import numpy as np
        import pyarrow as pa

        out_q, out_v, out_d = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if table.num_rows and ask.num_rows:
            x, q = _matrix(table.column("v")), _matrix(ask.column("v"))
            shard = Shard(table.column("id").to_numpy(), x, codes(x, shared.value))
            qc = codes(q, shared.value)
            for i, qid in enumerate(ask.column("id").to_pylist()):
                ids, d = shard.search(qid, q[i], qc[i], radius, k)
                out_q.append(np.full(len(ids), qid, np.int64))
                out_v.append(ids)
                out_d.append(d)
        return pa.table([np.concatenate(out_q), np.concatenate(out_v), np.concatenate(out_d)], names=["query_id", "vec_id", "score"])

    found = index.groupBy("s", "b").cogroup(asked.groupBy("s", "b")).applyInArrow(run, RESULT)
    # a query's candidates: at most k from each shard
    from pyspark.sql import Window

    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = K, every: int = EVERY,
            sample: int = SAMPLE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) for all rows whose id is divisible by ``every``, against all rows."""
    import numpy as np

    rows = usable(table, vec_id, vector)
    common = rows.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "n").limit(1).collect()
    if not common:
        return rows.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    dims, total = int(common[0].n), int(common[0].c)
    rows = rows.where(F.size("v") == dims)
    queries = staged(rows.where(F.col("id") % every == 0).dropDuplicates(["id"]))
    n_queries = queries.count()
    some = np.array([r.v for r in rows.orderBy(F.xxhash64("id", F.lit(3)), "id").limit(sample).collect()], dtype=np.float64)  # bounded
    scale = float(np.abs(some).max())
    model = learn(some / scale, min(64, dims))
    model = (model[0] * scale, model[1] / scale)
    radius = calibrate(some, model, k)
    shards = max(1, -(-total // shard_rows))
    first = staged(search(rows, queries, model, radius, k, shards, n_queries))
    enough = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min(k, total - 1))
    short = staged(queries.join(enough, queries["id"] == enough["query_id"], "left_anti"))
    n_short = short.count()
    out = first
    if n_short:  # the radius of a whole code meets every row: exact
        again = search(rows, short, model, 8 * (-(-min(64, dims) // 8)), k, shards, n_short)
        out = first.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(again)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
