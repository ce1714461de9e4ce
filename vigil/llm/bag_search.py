"""Ranked lexical search over deduplicated bags of words.

Of a document only two things enter its scores: how often it holds each term
of the items, and its length class ``m``. So documents are restricted to the
items' vocabulary, and those of the same term counts and the same ``m`` form
one class: the pair is hashed, the hash deals the rows out, and rows of one
hash are one class only if their counts and ``m`` are equal byte by byte. Each
class is scored once for all items of a block; a class is ranked by its score
and its smallest id, and the best are expanded to their members by ascending
id. Of a class's members the ``k`` smallest ids suffice, for no other can be
among the first ``k``; they are cut before the shuffle, in the tasks that read
them, so a class of a third of all documents sends a few rows a task.

One scan tokenises every whole text (long texts in pieces of ``PIECE`` bytes cut
between terms) into a slim table, from which the corpus counts, the classes and
the scores are taken. Items are worked in blocks of about ``BLOCK`` distinct
(item, term) rows, which bounds the vocabulary that is sent to the workers;
more items mean more blocks, each with a scan of its own. Scores are 64-bit
integers throughout, summed exactly.

Terms are runs of ASCII letters and digits and characters beyond ASCII, A-Z
lower-cased. Defined cases: a null text has no terms, and a document without
any counts nowhere; an item without terms, or whose terms score nowhere, gives
no rows; rows of one item id are one item with all their terms; repeated
document rows are ranked one by one; a null document id ranks after all others
of its score. No documents, or no items: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from vigil.llm.common import cached, staged

K = 10
#: Bytes of text split at a time, and (item, term) rows of a block of items.
PIECE, BLOCK = 4 << 20, 1 << 20

# Fixed value: what is no part of a term.
_BREAKS = [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]


def _table() -> bytes:
    """Byte by byte: breaks become blanks, A-Z become a-z."""
    t = bytearray(bytes(range(256)).lower())
    for b in _BREAKS:
        t[b] = 32
    return bytes(t)


def counts(text: bytes | None, table: bytes, piece: int = PIECE) -> tuple[int, dict]:
    """(number of terms, term -> occurrences) of a UTF-8 text."""
    from collections import Counter

    n, got, lo = 0, Counter(), 0
    while text and lo < len(text):
        hi = min(lo + piece, len(text))
        while hi < len(text) and table[text[hi]] != 32:
            hi += 1
        words = text[lo:hi].translate(table).split()
        n += len(words)
        got.update(words)
        lo = hi
    return n, got


def _item_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item, term, q): how often each item holds each of its terms."""
    table = _table()

    def run(batches):
        import pyarrow as pa

        for b in batches:
            at, terms, q = [], [], []
            for k, t in enumerate(b.column("text").cast(pa.binary()).to_pylist()):
                for term, c in counts(t, table)[1].items():
                    at.append(k)
                    terms.append(term)
                    q.append(c)
            yield pa.RecordBatch.from_arrays([b.column("item").take(pa.array(at, pa.int64())), pa.array(terms, pa.binary()), pa.array(q, pa.int64())], ["item", "term", "q"])

    kind = items.schema[item_id].dataType.simpleString()
    got = items.select(F.col(item_id).alias("item"), F.col(text).alias("text")).mapInArrow(run, f"item {kind}, term binary, q bigint")
    return got.groupBy("item", "term").agg(F.sum("q").alias("q"))


class Block:
    """The items of one block: terms and, per term, the items that hold it."""

    def __init__(self, rows):
        import numpy as np

        self.items = sorted({r.item for r in rows}, key=lambda x: (x is None, x))
        number = {x: k for k, x in enumerate(self.items)}
        self.terms = sorted({bytes(r.term) for r in rows})
        place = {t: k for k, t in enumerate(self.terms)}
        got = sorted((place[bytes(r.term)], number[r.item], r.q) for r in rows)
        of, self.item, self.q = (np.array([g[c] for g in got], dtype=np.int64) for c in range(3))
        self.first = np.searchsorted(of, np.arange(len(self.terms) + 1))


def _bags(docs: DataFrame, text: str, row_id: str, terms: list[bytes]) -> DataFrame:
    """(id, n, bag): the number of all terms, and the places and counts of the block's terms as two runs of uint32."""
    shared, key, table = docs.sparkSession.sparkContext.broadcast(terms), uuid.uuid4().hex, _table()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        place = cached(key, lambda: {t: k for k, t in enumerate(shared.value)})
        for b in batches:
            ns, bags = [], []
            for t in b.column("text").cast(pa.binary()).to_pylist():
                n, got = counts(t, table)
                here = sorted((place[w], c) for w, c in got.items() if w in place)
                ns.append(n)
                bags.append(np.array(here, dtype="<u4").T.tobytes() if here else b"")
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(ns, pa.int64()), pa.array(bags, pa.binary())], ["id", "n", "bag"])

    kind = docs.schema[row_id].dataType.simpleString()
    return docs.select(F.col(row_id).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, n bigint, bag binary")


def _statistics(bags: DataFrame, n_terms: int) -> tuple[int, int, object]:
    """(documents with a term, all their terms, documents holding each of the block's terms)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        df, docs, total = np.zeros(n_terms, dtype=np.int64), 0, 0
        for b in batches:
            n = b.column("n").to_numpy()
            docs, total = docs + int((n > 0).sum()), total + int(n.sum())
            for bag in b.column("bag").to_pylist():
                df[np.frombuffer(bag, "<u4", len(bag) // 8)] += 1
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *some.tolist()], pa.int64()), pa.array([docs, total, *df[some].tolist()], pa.int64())], ["what", "c"])

    import numpy as np

    got = {r.what: r.c for r in bags.select("n", "bag").mapInArrow(run, "what bigint, c bigint").groupBy("what").agg(F.sum("c").alias("c")).collect()}  # at most the block's terms
    df = np.array([got.get(k, 0) for k in range(n_terms)], dtype=np.int64)
    return got.get(-2, 0), got.get(-1, 0), df


def classes(bags: DataFrame, n_docs: int, n_terms: int, k: int = K) -> DataFrame:
    """(m, bag, ids): the classes and the ``k`` smallest ids of each, in order."""
    m = F.expr(f"25 + (75 * n * {n_docs}L) div {max(1, n_terms)}L")
    rows = bags.where(F.octet_length("bag") > 0).select("id", m.alias("m"), "bag").withColumn("hash", F.xxhash64("bag", "m"))
    same = ["hash", "m", "bag"]
    first = rows.withColumn("no", F.row_number().over(Window.partitionBy(*same).orderBy(F.asc_nulls_last("id")))).where(F.col("no") <= k)
    members = F.array_sort(F.collect_list(F.struct("no", "id")))  # at most k
    return first.groupBy(*same).agg(F.transform(members, lambda x: x["id"]).alias("ids")).drop("hash")


def _scored(classes_: DataFrame, block: Block, weights, item_type: T.DataType, k: int) -> DataFrame:
    """(number, item, score, ids): per task, each item's best ``k`` classes by score, then smallest id."""
    import numpy as np

    plain = (block.items, block.first, block.item, block.q, weights)
    shared, key = classes_.sparkSession.sparkContext.broadcast(plain), uuid.uuid4().hex
    id_type = classes_.schema["ids"].dataType.elementType.simpleString()
    item_kind = to_arrow_type(item_type)

    def run(batches):
        import pyarrow as pa

        items, first, item, q, w = cached(key, lambda: shared.value)
        weighted = q * w[np.repeat(np.arange(len(w)), np.diff(first))]
        # a term adds at most 10**6 times its weight: below 2**53 sums are exact in doubles
        exact = int(np.bincount(item, weighted, len(items)).max(initial=0)) * 10**6 < 1 << 52
        best = {"item": np.zeros(0, np.int64), "score": np.zeros(0, np.int64), "ids": np.zeros(0, object)}
        least = np.ones(len(items), dtype=np.int64)
        ids_kind = None
        for b in batches:
            bags, m, ids = b.column("bag").to_pylist(), b.column("m").to_numpy(), b.column("ids")
            ids_kind = ids.type
            runs = [np.frombuffer(x, "<u4").reshape(2, -1) for x in bags]
            of = np.repeat(np.arange(len(runs)), [r.shape[1] for r in runs])
            term, tf = (np.concatenate([r[c] for r in runs]).astype(np.int64) for c in (0, 1))
            part = (1_000_000_000 * tf) // (1000 * tf + 8 * m[of])
            # every term of every class with every item that holds it
            many = first[term + 1] - first[term]
            ends = np.cumsum(many)
            at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first[term] - ends + many, many)
            cell, add = item[at] * len(runs) + np.repeat(of, many), weighted[at] * np.repeat(part, many)
            size = len(items) * len(runs)
            if exact:
                score = np.bincount(cell, add, size).astype(np.int64).reshape(len(items), -1)
            else:
                score = np.zeros(size, dtype=np.int64)
                np.add.at(score, cell, add)
                score = score.reshape(len(items), -1)
            bar = least if len(runs) <= k else np.maximum(least, np.partition(score, len(runs) - k, axis=1)[:, len(runs) - k])
            i, c = np.nonzero(score >= bar[:, None])
            if not len(i):
                continue
            held = np.empty(len(c), dtype=object)
            some = {x: ids[x].as_py() for x in np.unique(c).tolist()}
            held[:] = [some[x] for x in c.tolist()]
            best = {n: np.concatenate([best[n], x]) for n, x in (("item", i), ("score", score[i, c]), ("ids", held))}
            lead = [(x[0] is None, x[0] if x[0] is not None else 0) for x in best["ids"]]
            order = sorted(range(len(lead)), key=lambda x: (best["item"][x], -best["score"][x], lead[x]))
            by = best["item"][order]
            rank = np.arange(len(by)) - np.searchsorted(by, by)
            keep = np.array(order, dtype=np.int64)[rank < k]
            best = {n: x[keep] for n, x in best.items()}
            full = np.flatnonzero(rank[rank < k] == k - 1)
            least[best["item"][full]] = best["score"][full]  # an equal score may still have a smaller id
        if len(best["item"]):
            names = pa.array([items[x] for x in best["item"].tolist()], item_kind)
            yield pa.RecordBatch.from_arrays([pa.array(best["item"]), names, pa.array(best["score"]), pa.array(best["ids"].tolist(), ids_kind)], ["number", "item", "score", "ids"])

    return classes_.mapInArrow(run, f"number bigint, item {item_type.simpleString()}, score bigint, ids array<{id_type}>")


def _search_block(docs: DataFrame, block: Block, item_type: T.DataType, text: str, row_id: str, k: int) -> DataFrame:
    import math

    import numpy as np

    bags = staged(_bags(docs, text, row_id, block.terms))
    n_docs, n_terms, df = _statistics(bags, len(block.terms))
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], dtype=np.int64)
    got = _scored(classes(bags, n_docs, n_terms, k), block, weights, item_type, k)
    members = got.select("number", "item", "score", F.explode("ids").alias("id"))
    order = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return members.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item", "rank", "id", "score")


def search(docs: DataFrame, items: DataFrame, text: str = "text", row_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id",
           k: int = K, block_rows: int = BLOCK) -> DataFrame:
    """(item id, rank, document id, score): each item's ``k`` best documents with a score above 0."""
    asked = staged(_item_terms(items, item_id, item_text))
    blocks = max(1, -(-asked.count() // block_rows))
    dealt = asked.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))
    item_type, out = items.schema[item_id].dataType, None
    for b in range(blocks):
        rows = dealt.where(F.col("block") == b).drop("block").collect()  # bounded by the block
        if rows:
            got = _search_block(docs, Block(rows), item_type, text, row_id, k)
            out = got if out is None else out.unionByName(got)
    if out is None:
        id_type = docs.schema[row_id].dataType.simpleString()
        out = docs.sparkSession.createDataFrame([], f"item {item_type.simpleString()}, rank int, id {id_type}, score bigint")
    return out.select(F.col("item").alias(item_id), F.col("rank").cast("int").alias("rank"), F.col("id").alias(row_id), "score")
