"""A sharded count-min sketch that buckets of documents ask about their hashes.

Every bucket sends, for each sketch row, the distinct cells of its hashes (and
which of them it holds more than once) to the shards of the cell range; a shard
merges the buckets' partial sketches into counts, which never underestimate,
and answers each bucket with one small count per cell that it sent. Messages
are sorted, delta-coded and compressed: one to two bytes a hash instead of the
eight of the hash itself. The sketch's width follows the number of hashes, and
it is never gathered in one place: it is partitioned by cell range.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame

from vigil.llm.words import mix

ASK = "shard bigint, bucket bigint, cells binary"
ANSWER = "bucket bigint, shard bigint, counts binary"
#: Counts are answered up to this; it stands for itself or more.
TOP = 255


@dataclass(frozen=True)
class Sketch:
    """``cells`` = 2**bits cells in each of ``depth`` rows, in shards of 2**shard_bits cells."""

    bits: int
    shard_bits: int
    depth: int

    @staticmethod
    def for_items(items: int, depth: int = 2, load: float = 0.25) -> Sketch:
        bits = max(12, math.ceil(math.log2(max(1, items) / load)))
        return Sketch(bits, min(max(12, bits - 5), max(20, min(22, bits // 2 + 7))), depth)

    def cells(self, h, row: int):
        import numpy as np

        return mix(h + np.uint64(0x9E3779B97F4A7C15 * (row + 1) % (1 << 64))) >> np.uint64(64 - self.bits)


def bucket_bytes(total: int) -> int:
    """Text per bucket: grows with the root of the input, so that messages do not get ever smaller."""
    return int(min(128 << 20, max(1 << 20, (4 << 20) * math.sqrt(total / 1e9))))


def pack(values) -> bytes:
    """Ascending numbers below 2**32 as compressed differences."""
    import numpy as np
    import pyarrow as pa

    d = np.diff(values.astype(np.int64), prepend=0).astype("<u4")
    planes = np.ascontiguousarray(d.view(np.uint8).reshape(-1, 4).T).tobytes()
    return len(d).to_bytes(4, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpack(blob: bytes):
    import numpy as np
    import pyarrow as pa

    n = int.from_bytes(blob[:4], "little")
    planes = pa.decompress(blob[4:], decompressed_size=4 * n, codec="zstd", asbytes=True)
    d = np.ascontiguousarray(np.frombuffer(planes, dtype=np.uint8).reshape(4, n).T).view("<u4")[:, 0]
    return np.cumsum(d, dtype=np.int64)


def squeeze(small) -> bytes:
    """uint8 numbers, compressed."""
    import pyarrow as pa

    return len(small).to_bytes(4, "little") + pa.compress(small.tobytes(), codec="zstd", asbytes=True)


def unsqueeze(blob: bytes):
    import numpy as np
    import pyarrow as pa

    return np.frombuffer(pa.decompress(blob[4:], decompressed_size=int.from_bytes(blob[:4], "little"), codec="zstd", asbytes=True), dtype=np.uint8)


def _cuts(sketch: Sketch, cells):
    """(shard, from, to) of the runs of sorted cells that share a shard."""
    import numpy as np

    if not len(cells):  # a bucket of short or empty texts
        return []
    s = cells >> np.uint64(sketch.shard_bits)
    at = np.flatnonzero(np.diff(s, prepend=s[:1] + np.uint64(1)))
    return [(int(s[a]), int(a), int(b)) for a, b in zip(at, [*at[1:], len(s)], strict=True)]


def ask(sketch: Sketch, bucket: int, h):
    """The messages of one bucket about its hashes, as an Arrow table."""
    import numpy as np
    import pyarrow as pa

    shards, blobs = [], []
    for row in range(sketch.depth):
        cells, counts = np.unique(sketch.cells(h, row), return_counts=True)
        for s, lo, hi in _cuts(sketch, cells):
            low = cells[lo:hi] & np.uint64((1 << sketch.shard_bits) - 1)
            # the count, up to TOP, travels too: the bucket's partial sketch
            few = squeeze(np.minimum(counts[lo:hi], TOP).astype(np.uint8))
            shards.append(row << 48 | s)
            blobs.append(len(few).to_bytes(4, "little") + few + pack(low))
    return pa.table([pa.array(shards, pa.int64()), pa.array([bucket] * len(shards), pa.int64()), pa.array(blobs, pa.binary())],
                    names=["shard", "bucket", "cells"])


def merge(messages: DataFrame, sketch: Sketch) -> DataFrame:
    """Adds up the partial sketches by shard and answers each bucket."""

    def add(table):
        import numpy as np
        import pyarrow as pa

        total = np.zeros(1 << sketch.shard_bits, dtype=np.int64)
        got = []
        for blob in table.column("cells").to_pylist():
            cut = 4 + int.from_bytes(blob[:4], "little")
            cells = unpack(blob[cut:])
            total[cells] += unsqueeze(blob[4:cut])  # the cells of one message differ
            got.append(cells)
        few = np.minimum(total, TOP).astype(np.uint8)
        return pa.table([table.column("bucket"), table.column("shard"), pa.array([squeeze(few[c]) for c in got], pa.binary())],
                        names=["bucket", "shard", "counts"])

    return messages.groupBy("shard").applyInArrow(add, ANSWER)


def estimates(sketch: Sketch, answers, h):
    """The estimated count (1 to TOP) of every hash of the bucket, from the answers to its messages."""
    import numpy as np

    by = dict(zip(answers.column("shard").to_pylist(), answers.column("counts").to_pylist(), strict=True))
    out = np.full(len(h), TOP, dtype=np.uint8)
    for row in range(sketch.depth):
        cells, back = np.unique(sketch.cells(h, row), return_inverse=True)
        est = np.zeros(len(cells), dtype=np.uint8)
        for s, lo, hi in _cuts(sketch, cells):
            est[lo:hi] = unsqueeze(by[row << 48 | s])
        np.minimum(out, est[back], out=out)
    return out
