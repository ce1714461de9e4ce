"""Benchmark decontamination with one Aho-Corasick automaton.

Texts and items are normalised to lower-case words joined by single blanks.
A window is ``n`` consecutive words of an item (an item of fewer words is one
window). Every window holds one of the item's aligned tiles of ``(n + 1) // 2``
words, so the automaton holds the tiles (one pattern per tile instead of one
per window). A text is scanned once; each tile found is extended word by word
along the item, and a common run of ``n`` words or more marks its words as hit.
That finds exactly the occurrences of the windows.

Defined cases: a null or empty text, or one without words, has no words and no
hits. Items without words, or with a null id, are ignored; repeated items count
once; several texts under one id count as that id. An empty benchmark leaves
every text clean. Columns of ``docs`` named like an added column are replaced.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.llm.common import cached, with_columns

#: Words per window, and the share of a text's words (1 in 20) from which it is contaminated.
WINDOW, ONE_IN = 13, 20
#: Benchmark text per automaton: a larger benchmark is scanned in blocks, one pass each. The automaton
#: takes about 40 bytes of memory per character, so this bounds it (and the broadcast) to some 160 MB.
BLOCK_BYTES = 4 << 20

# The word characters. Bytes of UTF-8 stand for themselves; A-Z fold to a-z, the rest to a blank.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

_SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
ADDED = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
                      T.StructField("hit_words", T.ArrayType(T.LongType())),
                      T.StructField("hit_spans", _SPAN), T.StructField("item_ids", T.ArrayType(T.StringType()))])


def words_of(text: str | None) -> list[bytes]:
    """The normalised words as UTF-8 bytes."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def line_of(words: list[bytes]) -> str:
    """Blank, words joined by blanks, blank; each character stands for one byte."""
    return (b" " + b" ".join(words) + b" ").decode("latin-1")


class Matcher:
    """The automaton over one block of items and the words to extend along."""

    def __init__(self, items: list[tuple[str, str]], n: int):
        import ahocorasick

        self.n, self.tile, self.items, self.ids = n, (n + 1) // 2, [], []
        tiles: dict[str, list[tuple[int, int, int]]] = {}
        for iid, text in items:
            words = words_of(text)
            if not words:
                continue
            k = len(self.items)
            self.items.append(words)
            self.ids.append(iid)
            if len(words) < n:
                at = [(0, len(words))]
            else:
                at = [(p, self.tile) for p in range(0, len(words) - self.tile + 1, self.tile)]
            for p, size in at:
                tiles.setdefault(line_of(words[p:p + size]), []).append((k, p, size))
        self.auto = ahocorasick.Automaton()
        for pattern, places in tiles.items():
            self.auto.add_word(pattern, (len(pattern), places))
        self.empty = not tiles
        if not self.empty:
            self.auto.make_automaton()

    def find(self, words: list[bytes], line: str) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit word ranges [from, to) and the ids of the items found in " w1 w2 .. "."""
        import numpy as np

        if self.empty:
            return [], set()
        found = list(self.auto.iter(line))
        if not found:
            return [], set()
        blanks = np.flatnonzero(np.frombuffer(line.encode("latin-1"), dtype=np.uint8) == 32)
        runs, ids, done = [], set(), {}
        for end, (size, places) in found:
            first = int(np.searchsorted(blanks, end - size + 1))
            for k, p, tile in places:
                item, diag = self.items[k], (k, first - p)
                if done.get(diag, -1) > first:  # inside a run that was already extended along this item
                    continue
                need = min(self.n, len(item))
                lo, q = first, p
                while lo and q and words[lo - 1] == item[q - 1]:
                    lo, q = lo - 1, q - 1
                hi, q = first + tile, p + tile
                while hi < len(words) and q < len(item) and words[hi] == item[q]:
                    hi, q = hi + 1, q + 1
                done[diag] = hi
                if hi - lo >= need:
                    runs.append((lo, hi))
                    ids.add(self.ids[k])
        return runs, ids


def _blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int):
    """The distinct items in blocks of bounded size, in id order, one block on the driver at a time."""
    rows = (benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).alias("t"))
            .where("i IS NOT NULL AND t IS NOT NULL").distinct().orderBy("i", "t"))
    block, used = [], 0
    for r in rows.toLocalIterator():
        size = len(r.t.encode("utf-8", "surrogatepass"))
        if block and used + size > block_bytes:
            yield block
            block, used = [], 0
        block.append((r.i, r.t))
        used += size
    yield block  # also when there are no items: every text then gets its columns


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id",
                  item_text: str = "text", n: int = WINDOW, one_in: int = ONE_IN,
                  block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with n_words, n_hit, hit_words (numbers of the hit words),
    hit_spans (code point ranges of hit runs in the original text), item_ids
    (sorted as strings) and contaminated (n_hit > 0 and one_in * n_hit >= n_words)."""
    out = docs
    spark = docs.sparkSession
    for number, block in enumerate(_blocks(benchmark, item, item_text, block_bytes)):
        shared, key = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def scan(batch, shared=shared, key=key, earlier=number > 0):
            import pyarrow as pa

            m = cached(key, lambda: Matcher(shared.value, n))
            cols = [[] for _ in range(5)]
            texts = batch.column(text).to_pylist()
            before = (batch.column("hit_words").to_pylist(), batch.column("item_ids").to_pylist()) if earlier else None
            for k, t in enumerate(texts):
                words = words_of(t)
                runs, ids = m.find(words, line_of(words)) if words else ([], set())
                hit = set(before[0][k]) if earlier else set()
                ids |= set(before[1][k]) if earlier else set()
                for lo, hi in runs:
                    hit.update(range(lo, hi))
                hit = sorted(hit)
                spans = []
                if hit:
                    at = [x.span() for x in _WORD.finditer(t)]
                    for j, w in enumerate(hit):
                        if j and hit[j - 1] == w - 1:
                            spans[-1]["end"] = at[w][1]
                        else:
                            spans.append({"start": at[w][0], "end": at[w][1]})
                for c, v in zip(cols, (len(words), len(hit), hit, spans, sorted(ids)), strict=True):
                    c.append(v)
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), span, pa.list_(pa.string()))
            return {f.name: pa.array(c, kind) for f, c, kind in zip(ADDED.fields, cols, kinds, strict=True)}

        out = with_columns(out, ADDED, scan)
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * one_in >= F.col("n_words")))
