"""Removal of repeated word windows, with a count-min prefilter.

First pass: every bucket of documents sends partial count-min sketches of its
window hashes; merged by cell range, they overestimate how often each window
starts in the corpus. Second pass: only windows estimated at two or more are
grouped exactly, by 96 bits of hash; a window that repeats is never lost, as
the estimate is never too low. Third pass: the words covered by repeated
windows are cut out. Texts are shuffled once and that exchange is reused; what
else travels are compressed cells, and the hashes of estimated repeats.

Defined cases: a null text has no words; fewer words than the window leave a
text as it is; copies of a row repeat each other and lose all full windows.
Input columns other than the id and the text are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.llm import repeats
from vigil.llm.buckets import bucketed, in_order
from vigil.llm.words import slices

WINDOW = 35
#: Windows that one group of the exact pass holds on average, if all were estimated repeats.
GROUP_WINDOWS = 4_000_000


def _windows(table, k: int):
    """(hash, second hash) of all windows of a bucket, in order."""
    import numpy as np

    got = [w.windows(k, second=True)[2:] for _, w in slices(table.column("text"), fold=False)]
    z = np.zeros(0, dtype=np.uint64)
    return np.concatenate([z, *(g[0] for g in got)]), np.concatenate([z, *(g[1] for g in got)])


def dedup(docs: DataFrame, text: str = "text", row_id: str = "doc_id", k: int = WINDOW, depth: int = 2) -> DataFrame:
    """(id, n_words, n_removed, kept_text, removed): ``removed`` are the [from, to) word ranges cut out;
    ``kept_text`` is the kept words joined by one space."""
    texts, total = bucketed(docs, text, row_id)
    items = max(1, total // 5)  # words in texts of this many bytes, about; the sketch's width need not be exact
    sketch = repeats.Sketch.for_items(items, depth)
    groups = max(1, -(-items // GROUP_WINDOWS))

    def first(key, table):
        return repeats.ask(sketch, key[0].as_py(), _windows(table, k)[0])

    def second(key, table, answers):
        import numpy as np
        import pyarrow as pa

        h, check = _windows(in_order(table), k) if table.num_rows else (np.zeros(0, np.uint64),) * 2
        hot = np.flatnonzero(repeats.estimates(sketch, answers, h) > 1)
        _, at, counts = np.unique(h[hot], return_index=True, return_counts=True)
        order = np.argsort(at)  # once each, by first place; a bucket's own repeats are counted here
        place, own = hot[at[order]], counts[order] > 1
        h, check = h[place], check[place]
        group = h % np.uint64(groups)
        numbers, blobs = [], []
        for g in np.unique(group).tolist():
            m = group == g
            ordinals = repeats.pack(place[m])
            flags = np.packbits(own[m]).tobytes()
            blobs.append(len(ordinals).to_bytes(4, "little") + ordinals + flags + h[m].tobytes() + check[m].astype("<u4").tobytes())
            numbers.append(g)
        return pa.table([pa.array(numbers, pa.int64()), pa.array([key[0].as_py()] * len(blobs), pa.int64()), pa.array(blobs, pa.binary())],
                        names=["grp", "bucket", "windows"])

    def exact(table):
        import numpy as np
        import pyarrow as pa

        parts = []
        for blob in table.column("windows").to_pylist():
            cut = 4 + int.from_bytes(blob[:4], "little")
            ordinals = repeats.unpack(blob[4:cut])
            n, f = len(ordinals), -(-len(ordinals) // 8)
            own = np.unpackbits(np.frombuffer(blob, np.uint8, f, cut), count=n).astype(bool)
            parts.append((ordinals, own, np.frombuffer(blob, "<u8", n, cut + f), np.frombuffer(blob, "<u4", n, cut + f + 8 * n)))
        own, h, c = (np.concatenate([p[i] for p in parts]) for i in (1, 2, 3))
        order = np.lexsort((c, h))
        h, c = h[order], c[order]
        same = (h[1:] == h[:-1]) & (c[1:] == c[:-1])
        twice = np.zeros(len(h), dtype=bool)
        twice[1:] |= same
        twice[:-1] |= same
        out = np.empty(len(h), dtype=bool)
        out[order] = twice
        out |= own
        ends = np.cumsum([len(p[0]) for p in parts])[:-1]
        found = [repeats.pack(p[0][m]) for p, m in zip(parts, np.split(out, ends), strict=True)]
        return pa.table([table.column("bucket"), pa.array(found, pa.binary())], names=["bucket", "found"])

    def cut(key, table, found):
        import numpy as np
        import pyarrow as pa

        table = in_order(table)
        again = [repeats.unpack(b) for b in found.column("found").to_pylist()]
        again = np.concatenate([np.zeros(0, np.int64), *again])
        n_words, n_removed, kept, spans = [], [], [], []
        h = _windows(table, k)[0] if len(again) else None
        hit = np.isin(h, h[again]) if len(again) else None  # a window that repeats does so at all its places
        seen = 0
        for _, w in slices(table.column("text"), fold=False):
            covered = np.zeros(len(w.start), dtype=bool)
            if hit is not None:
                n = np.maximum(w.counts - k + 1, 0)
                total_n, before = int(n.sum()), np.cumsum(n) - n
                at = np.repeat(w.first[:-1] - before, n) + np.arange(total_n)
                at = at[hit[seen:seen + total_n]]
                seen += total_n
                edge = np.zeros(len(w.start) + 1, dtype=np.int64)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + k, -1)
                covered = np.cumsum(edge[:-1]) > 0
            raw = w.buf.tobytes()
            for t in range(len(w.counts)):
                lo, hi = int(w.first[t]), int(w.first[t + 1])
                cov = covered[lo:hi]
                keep = np.flatnonzero(~cov) + lo
                edges = np.flatnonzero(np.diff(cov.astype(np.int8), prepend=0, append=0))
                n_words.append(hi - lo)
                n_removed.append(hi - lo - len(keep))
                s, e = w.start, w.end
                if len(keep) == hi - lo:
                    kept.append(b" ".join(raw[int(w.offsets[t]):int(w.offsets[t + 1])].split()))
                else:
                    kept.append(b" ".join(raw[a:b] for a, b in zip(s[keep].tolist(), e[keep].tolist(), strict=True)))
                spans.append(edges.reshape(-1, 2).tolist())
        return pa.table([table.column("id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                         pa.array([x.decode("utf-8") for x in kept], pa.string()), pa.array(spans, pa.list_(pa.list_(pa.int64())))],
                        names=out.names)

    out = T.StructType([T.StructField(row_id, docs.schema[row_id].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
                        T.StructField("kept_text", T.StringType()), T.StructField("removed", T.ArrayType(T.ArrayType(T.LongType())))])
    by_bucket = texts.groupBy("bucket")
    answers = repeats.merge(by_bucket.applyInArrow(first, repeats.ASK), sketch)
    windows = by_bucket.cogroup(answers.groupBy("bucket")).applyInArrow(second, "grp bigint, bucket bigint, windows binary")
    found = windows.groupBy("grp").applyInArrow(exact, "bucket bigint, found binary")
    return by_bucket.cogroup(found.groupBy("bucket")).applyInArrow(cut, out)
