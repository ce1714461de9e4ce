"""N-gram Jaccard join by vertical partitioning.

A document's set holds the hashes of its distinct word n-grams. One order is
put on all n-grams: by estimated document count (from a merged count-min sketch
that is never too low), then by hash. The join then works like this:

1. n-grams with an estimate of 1 are in one set only. A set can only have a
   partner if at least the threshold's share of it remains; the others are done.
2. Equal sets collapse into one class, by the 64-bit sum hash of the set.
3. Two linked sets share an n-gram in their prefixes under the order. Each
   prefix n-gram's block takes its most typical class as leader, and every
   member is paired with the leaders of its blocks only, not with all others.
4. Overlaps are counted vertically: the global order is cut at pivots into
   fragments, each fragment counts the partial overlaps of the pairs from
   its own segments of the sets, and the partial counts are summed per pair.
5. Linked pairs give components. Pairs that share a leader but ended in
   different components are left: Jaccard distance is a metric, so those whose
   distances to the leader differ by more than the limit cannot be linked;
   sizes rule out more, and so does what two members can share at most, inside
   the leader's set and outside it; all that remain are counted as in 4.

So no link between different components is lost, and a large group of near
copies costs its size, not its square, in pairs. Hashes are 64 bits; in the
order 56 of them count.

Defined cases: null texts and texts without words have an empty set (0
n-grams) and are linked with nothing; repeated rows are copies of each other;
with fewer words than n, the whole sequence is the one n-gram. A null id links
as any other, but names a component only if all its ids are null. Input columns
other than the id and the text are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm import repeats
from vigil.llm.buckets import bucketed
from vigil.llm.common import staged, tidy
from vigil.llm.components import components
from vigil.llm.words import mix, slices

N, PERCENT = 5, 80
#: Fragments of the global order, pairs per chunk (the unit in which partial counts travel), and chunks' groups.
FRAGMENTS, CHUNK, GROUP_PAIRS = 8, 2048, 16_384


def _sets(table, n: int):
    """(row number, n-gram hash) of the distinct n-grams of every text, in row order."""
    import numpy as np

    rows, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for at, w in slices(table.column("text"), fold=True):
        _, text, h = w.windows(n, short=True)
        order = np.lexsort((h, text))
        h, text = h[order], text[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
        rows.append(text[new] + at)
        hashes.append(h[new])
    return np.concatenate(rows), np.concatenate(hashes)


def document_sets(docs: DataFrame, text: str = "text", row_id: str = "doc_id", n: int = N, percent: int = PERCENT, depth: int = 2) -> DataFrame:
    """(id, text_hash, n_shingles, class, shared): ``class`` is the set's hash; ``shared`` its n-grams with an estimate above 1,
    as ascending little-endian uint64 in the global order, or null if they are too few for any partner."""
    texts, total = bucketed(docs, text, row_id)
    sketch = repeats.Sketch.for_items(max(1, total // 5), depth)

    def first(key, table):
        out = repeats.ask(sketch, key[0].as_py(), _sets(table, n)[1])
        tidy()
        return out

    def second(key, table, answers):
        import numpy as np
        import pyarrow as pa

        rows, h = _sets(table, n)
        est = repeats.estimates(sketch, answers, h)
        many = len(table)
        sizes = np.bincount(rows, minlength=many)
        sums = np.zeros(many, dtype=np.uint64)
        np.add.at(sums, rows, mix(h))
        sums = mix(sums + sizes.astype(np.uint64))
        hot = est > 1
        rank = est[hot].astype(np.uint64) << np.uint64(56) | h[hot] >> np.uint64(8)
        row = rows[hot]
        order = np.lexsort((rank, row))
        rank, row = rank[order], row[order]
        ends = np.searchsorted(row, np.arange(many + 1))
        enough = (100 * np.diff(ends) >= percent * sizes) & (sizes > 0)
        blobs = [rank[ends[k]:ends[k + 1]].tobytes() if enough[k] else None for k in range(many)]
        del h, est, hot, rank, row, order
        tidy()
        return pa.table([table.column("id"), table.column("text_hash"), pa.array(sizes), pa.array(sums.view(np.int64)), pa.array(blobs, pa.binary())],
                        names=["id", "text_hash", "n_shingles", "class", "shared"])

    by_bucket = texts.groupBy("bucket")
    answers = repeats.merge(by_bucket.applyInArrow(first, repeats.ASK), sketch)
    kind = docs.schema[row_id].dataType.simpleString()
    return by_bucket.cogroup(answers.groupBy("bucket")).applyInArrow(second, f"id {kind}, text_hash bigint, n_shingles bigint, class bigint, shared binary")


def _prefixes(classes: DataFrame, percent: int) -> DataFrame:
    """(gram, class, typical) for the n-grams in each set's prefix; unshared n-grams come first in the order
    and take up its first places."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            grams, owner, share = [], [], []
            for c, size, blob in zip(*(b.column(x).to_pylist() for x in ("class", "n_shingles", "shared")), strict=True):
                held = len(blob) // 8
                take = size - (percent * size + 99) // 100 + 1 - (size - held)
                if take > 0:
                    grams.append(np.frombuffer(blob, "<u8", min(take, held)))
                    owner.append(np.full(len(grams[-1]), c, np.int64))
                    share.append(np.full(len(grams[-1]), held / size))
            if grams:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(grams).view(np.int64)), pa.array(np.concatenate(owner)), pa.array(np.concatenate(share))],
                                                 ["gram", "class", "typical"])

    return classes.mapInArrow(run, "gram bigint, class bigint, typical double")


def _pivots(classes: DataFrame, fragments: int) -> list[int]:
    """Cuts of the global order at the quantiles of evenly spaced n-grams of 256 sets, chosen by hash."""
    import numpy as np

    def thin(batches):
        import pyarrow as pa

        for b in batches:
            sets = [np.frombuffer(x, "<u8") for x in b.column("shared").to_pylist()]
            few = [x[np.linspace(0, len(x) - 1, 64).astype(np.int64)] if len(x) else x for x in sets]
            yield pa.RecordBatch.from_arrays([b.column("class"), pa.array([x.tobytes() for x in few], pa.binary())], ["class", "some"])

    some = classes.select("class", "shared").mapInArrow(thin, "class bigint, some binary").orderBy(F.xxhash64("class"), "class").limit(256)
    got = [np.frombuffer(r.some, "<u8") for r in some.collect()]
    got = [x for x in got if len(x)]
    if not got:
        return []
    all_ = np.sort(np.concatenate(got))
    return sorted({int(all_[len(all_) * i // fragments]) for i in range(1, fragments)})


def count_overlaps(pairs: DataFrame, classes: DataFrame, pivots: list[int], n_pairs: int, chunk: int = CHUNK) -> DataFrame:
    """(a, b, overlap) for the distinct pairs (a, b) of classes.

    Pairs are dealt by a hash of ``b`` into groups; a group gets the sets of its members, cut at the pivots, and
    works one fragment at a time in separate tasks. A fragment answers one array of partial counts per chunk of
    pairs, and the arrays of a chunk are added up."""
    groups = max(1, -(-n_pairs // GROUP_PAIRS))
    dealt = pairs.select(F.pmod(F.xxhash64("b"), F.lit(groups)).alias("grp"), "a", "b")

    def number(key, table):
        import pyarrow as pa

        g = key[0].as_py()
        table = table.sort_by([("a", "ascending"), ("b", "ascending")])
        cuts = range(0, table.num_rows, chunk)
        lists = [[table.column(c).slice(lo, chunk).to_pylist() for lo in cuts] for c in ("a", "b")]
        return pa.table([pa.array([g] * len(cuts), pa.int64()), pa.array(range(len(cuts)), pa.int64()), *(pa.array(x, pa.list_(pa.int64())) for x in lists)],
                        names=["grp", "chunk", "a", "b"])

    chunks = staged(dealt.groupBy("grp").applyInArrow(number, "grp bigint, chunk bigint, a array<bigint>, b array<bigint>"))
    members = (dealt.select("grp", F.col("a").alias("class")).union(dealt.select("grp", F.col("b").alias("class"))).distinct()
               .join(classes.select("class", "shared"), "class"))

    def split(batches):
        import numpy as np
        import pyarrow as pa

        edges = np.array(pivots, dtype=np.uint64)
        for b in batches:
            rows, frags, blobs = [], [], []
            for k, blob in enumerate(b.column("shared").to_pylist()):
                grams = np.frombuffer(blob, "<u8")
                at = [0, *np.searchsorted(grams, edges).tolist(), len(grams)]
                for f, (lo, hi) in enumerate(zip(at, at[1:], strict=False)):
                    if hi > lo:
                        rows.append(k)
                        frags.append(f)
                        blobs.append(grams[lo:hi].tobytes())
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("grp").take(take), pa.array(frags, pa.int64()), b.column("class").take(take), pa.array(blobs, pa.binary())],
                                             ["grp", "frag", "class", "segment"])

    segments = members.select("grp", "class", "shared").mapInArrow(split, "grp bigint, frag bigint, class bigint, segment binary")
    work = chunks.select("grp", F.explode(F.sequence(F.lit(0), F.lit(len(pivots))).cast("array<bigint>")).alias("frag"), "chunk", "a", "b")

    def partial(key, parts, segs):
        import numpy as np
        import pyarrow as pa

        sets = {c: set(np.frombuffer(s, "<u8").tolist()) for c, s in zip(segs.column("class").to_pylist(), segs.column("segment").to_pylist(), strict=True)}
        none: set = set()
        counts = []
        for a, b in zip(parts.column("a").to_pylist(), parts.column("b").to_pylist(), strict=True):
            counts.append(np.array([len(sets.get(x, none) & sets.get(y, none)) for x, y in zip(a, b, strict=True)], dtype="<u4").tobytes())
        return pa.table([parts.column("grp"), parts.column("chunk"), pa.array(counts, pa.binary())], names=["grp", "chunk", "counts"])

    counted = (work.groupBy("grp", "frag").cogroup(segments.groupBy("grp", "frag"))
               .applyInArrow(partial, "grp bigint, chunk bigint, counts binary"))

    def add(key, parts, fragments):
        import numpy as np
        import pyarrow as pa

        total = sum((np.frombuffer(x, "<u4").astype(np.int64) for x in fragments.column("counts").to_pylist()), np.zeros(1, np.int64))
        a, b = (np.array(parts.column(c).to_pylist()[0], dtype=np.int64) for c in ("a", "b"))
        return pa.table([a, b, total], names=["a", "b", "overlap"])

    return chunks.groupBy("grp", "chunk").cogroup(counted.groupBy("grp", "chunk")).applyInArrow(add, "a bigint, b bigint, overlap bigint")


def join(docs: DataFrame, text: str = "text", row_id: str = "doc_id", n: int = N, percent: int = PERCENT, fragments: int = FRAGMENTS) -> DataFrame:
    """(id, text_hash, n_shingles, class, component_id, first): ``component_id`` is the smallest id reachable by links
    with 100 * overlap >= percent * union; ``first`` marks the component's first row, by id (null last), then text hash."""
    sets = staged(document_sets(docs, text, row_id, n, percent))
    able = sets.where("shared IS NOT NULL").withColumn("row_hash", F.xxhash64("id", "text_hash"))  # never null
    rep = able.groupBy("class").agg(F.min("row_hash").alias("row_hash"))
    classes = staged(able.join(rep, ["class", "row_hash"], "left_semi").dropDuplicates(["class"]).select("class", "n_shingles", "shared"))
    pivots = _pivots(classes, fragments)
    sized = classes.select("class", F.col("n_shingles").alias("n"), (F.octet_length("shared") / 8).cast("bigint").alias("held"))

    grams = staged(_prefixes(classes, percent))
    heads = staged(grams.groupBy("gram").agg(F.max(F.struct("typical", "class")).getField("class").alias("a"), F.count(F.lit(1)).alias("m")).where("m > 1").drop("m"))  # so that a frequent n-gram's side of the join can be split
    led = staged(grams.join(heads, "gram").where("class <> a").select("a", F.col("class").alias("b")).distinct())
    with_sizes = lambda p: (p.join(sized.toDF("a", "na", "ha"), "a").join(sized.toDF("b", "nb", "hb"), "b"))
    linked = f"100 * overlap >= {percent} * (na + nb - overlap)"
    pairs = staged(with_sizes(count_overlaps(led, classes, pivots, led.count())))
    found = pairs.where(linked).select("a", "b")
    labels = components(found)

    # what leaders did not decide: members of different components that share a leader, one of them outside the leader's
    label = lambda c, as_: F.coalesce(F.col(c), F.col(as_))
    far = pairs.withColumn("d", 1 - F.col("overlap") / (F.col("na") + F.col("nb") - F.col("overlap")))
    far = (far.join(labels.toDF("a", "la"), "a", "left").join(labels.toDF("b", "lb"), "b", "left")
           .select("a", label("la", "a").alias("la"), "b", label("lb", "b").alias("lb"), "nb", "hb", "overlap", "d"))
    far = staged(far)
    x = far.where("la <> lb").select("a", F.col("b").alias("x"), F.col("lb").alias("lx"), F.col("nb").alias("nx"), F.col("hb").alias("hx"), F.col("overlap").alias("ox"), F.col("d").alias("dx"))
    y = far.select("a", F.col("b").alias("y"), F.col("lb").alias("ly"), F.col("nb").alias("ny"), F.col("hb").alias("hy"), F.col("overlap").alias("oy"), F.col("d").alias("dy"))
    limit = 1 - percent / 100
    # what x and y share lies inside the leader's set, or is n-grams outside it that are in more than one document
    most = F.least("ox", "oy") + F.least(F.col("hx") - F.col("ox"), F.col("hy") - F.col("oy"))
    left = x.join(y, (x["a"] == y["a"]) & (F.col("lx") != F.col("ly")) & (F.abs(F.col("dx") - F.col("dy")) <= limit + 1e-9)
                  & (percent * F.greatest("nx", "ny") <= 100 * F.least("nx", "ny"))
                  & (percent * (F.col("nx") + F.col("ny")) <= (100 + percent) * most))
    left = staged(left.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    more = staged(with_sizes(count_overlaps(left, classes, pivots, left.count())).where(linked).select("a", "b"))
    top = (more.join(labels.toDF("a", "la"), "a", "left").join(labels.toDF("b", "lb"), "b", "left")
           .select(label("la", "a").alias("a"), label("lb", "b").alias("b")))
    second = components(top)
    final = (labels.join(second.toDF("label", "up"), "label", "left").select(F.col("node").alias("class"), F.coalesce("up", "label").alias("label"))
             .union(second.join(labels.select(F.col("node")), "node", "left_anti").select(F.col("node").alias("class"), "label")))
    whole = staged(sets.select("id", "text_hash", "n_shingles", "class").join(final, "class", "left").withColumn("label", F.coalesce("label", "class")))
    # an empty set is its own component, and ids alone tell those apart
    row = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("text_hash").alias("text_hash"))
    least = staged(whole.where("n_shingles > 0").groupBy("label").agg(F.min(row).alias("head")))  # so that a large group's side of the join can be split
    return whole.join(least, "label", "left").select(
        F.col("id").alias(row_id), "text_hash", "n_shingles", "class",
        F.when(F.col("n_shingles") > 0, F.col("head.id")).otherwise(F.col("id")).alias("component_id"),
        ((F.col("n_shingles") == 0) | row.eqNullSafe(F.col("head"))).alias("first"))
