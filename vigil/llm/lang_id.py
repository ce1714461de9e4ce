"""Language identification by words first, backing off to character n-grams.

The model holds per-language log frequencies of the most frequent words and of
character n-grams of orders 5 down to 1 (a word is bounded by ``^`` and ``$``).
A known word scores its log frequencies; an unseen one scores the mean of its
known n-grams of the longest order that has any. The scores of all words of
the whole text are added up and the softmax over the languages is the score.

Training reads a bounded sample of labelled rows (``sample_rows``, chosen by a
hash of the id so that a rerun picks the same) and keeps bounded tables: of each
language its own ``max_words`` most frequent words and ``max_grams`` n-grams of
every order, so that a small language keeps its entries beside large ones. It
is fitted with Spark aggregates. More than ``max_langs`` distinct labels are no
languages (free text): the most frequent are learned, with a warning.

Defined cases: a null text or one without a letter is ``und`` with score 0; if
no labelled row exists, every text is ``und`` with score 0. Rows without a
language are not learned from. Columns named like an added one are replaced.
"""

from __future__ import annotations

import logging
import math
import re
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.llm.common import cached, staged, with_columns

SAMPLE_ROWS, TOP_ORDER = 8_000, 5
#: Bounds of the model: words, and n-grams of one order, of each language; and languages.
MAX_WORDS, MAX_GRAMS, MAX_LANGS = 10_000, 4_000, 512
LOG = logging.getLogger(__name__)
#: Unseen words whose scores a worker keeps; beyond it the cache starts anew.
CACHE_WORDS = 150_000
_LETTERS = re.compile(r"[^\W\d_]+")

ADDED = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())])


def letters(text: str | None) -> list[str]:
    """Lower-case runs of letters."""
    return _LETTERS.findall(text.lower()) if text else []


def grams(word: str, order: int) -> list[str]:
    w = f"^{word}$"
    return [w[i:i + order] for i in range(len(w) - order + 1)]


def _tall(rows: list[tuple], names: tuple[str, ...]):
    import pyarrow as pa

    cols = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n in ("n", "k") else pa.string()) for n, c in zip(names, cols, strict=True)], list(names))


def fit(rows: DataFrame, text: str = "text", lang: str = "lang", row_id: str = "doc_id",
        sample_rows: int = SAMPLE_ROWS, max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS, max_langs: int = MAX_LANGS) -> dict:
    """The model: languages, and per order (0: whole words) gram -> counts."""
    rows = rows.select(F.col(row_id).cast("string").alias("i"), F.col(text).alias("t"),
                       F.col(lang).cast("string").alias("l")).where("t IS NOT NULL AND l IS NOT NULL")
    top = rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "l").limit(max_langs + 1).collect()
    if len(top) > max_langs:
        LOG.warning("over %d distinct labels; the most frequent are learned", max_langs)
    counts = {r.l: int(r.n) for r in top[:max_langs]}
    if not counts:
        return {"langs": [], "tables": {}}
    # each language gives up to an equal part of the sample, so a rare one is not lost
    part = max(1, sample_rows // len(counts))
    rate = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, part / n))])
    chosen = rows.where(F.pmod(F.xxhash64("i", F.lit(8)), F.lit(1_000_000)) < rate[F.col("l")] * 1_000_000)

    def words(batches):
        from collections import Counter, defaultdict

        for b in batches:
            got = defaultdict(Counter)
            for t, lg in zip(b.column("t").to_pylist(), b.column("l").to_pylist(), strict=True):
                got[lg].update(letters(t))
            yield _tall([(lg, w, n) for lg, c in got.items() for w, n in c.items()], ("l", "w", "n"))

    def orders(batches):
        from collections import Counter

        for b in batches:
            got: Counter = Counter()
            for lg, w, n in zip(*(b.column(c).to_pylist() for c in ("l", "w", "n")), strict=True):
                got[(lg, 0, w)] += n
                for k in range(1, TOP_ORDER + 1):
                    for g in grams(w, k):
                        got[(lg, k, g)] += n
            yield _tall([(*k, n) for k, n in got.items()], ("l", "k", "g", "n"))

    # words are counted first, so that n-grams are taken once from each distinct word
    counted = chosen.select("t", "l").mapInArrow(words, "l string, w string, n bigint").groupBy("l", "w").agg(F.sum("n").alias("n"))
    tall = counted.mapInArrow(orders, "l string, k bigint, g string, n bigint").groupBy("l", "k", "g").agg(F.sum("n").alias("n"))
    tall = staged(tall)
    place = F.row_number().over(Window.partitionBy("l", "k").orderBy(F.desc("n"), "g"))
    chosen = tall.withColumn("place", place).where(F.col("place") <= F.when(F.col("k") == 0, max_words).otherwise(max_grams)).select("k", "g").distinct()
    langs = sorted(counts)
    at = {x: i for i, x in enumerate(langs)}
    tables: dict[int, dict[str, list[int]]] = {k: {} for k in range(TOP_ORDER + 1)}
    for r in tall.join(chosen, ["k", "g"], "left_semi").collect():  # at most languages times (words + 5 orders of n-grams) entries
        tables[r.k].setdefault(r.g, [0] * len(langs))[at[r.l]] = int(r.n)
    return {"langs": langs, "tables": {k: dict(sorted(t.items())) for k, t in tables.items()}}


class Scorer:
    """Log-frequency vectors of words, with the backoff for unseen ones."""

    def __init__(self, model: dict):
        import numpy as np

        self.n = len(model["langs"])
        self.tables = []
        for k in range(TOP_ORDER + 1):
            t = model["tables"][k]
            if not t:
                self.tables.append({})
                continue
            c = np.array(list(t.values()), dtype=float) + 0.5
            v = np.log(c / c.sum(axis=0))
            self.tables.append(dict(zip(t, v, strict=True)))
        self.zero = np.zeros(self.n)
        self.fresh()

    def fresh(self) -> None:
        import numpy as np

        known = self.tables[0]
        self.at = {w: i for i, w in enumerate(known)}
        self.rows = np.zeros((max(1, len(known)) + CACHE_WORDS, self.n))
        if known:
            self.rows[:len(known)] = np.array(list(known.values()))
        self.used = len(known)

    def backoff(self, word: str):
        for k in range(min(TOP_ORDER, len(word) + 2), 0, -1):
            t = self.tables[k]
            found = [t[g] for g in grams(word, k) if g in t]
            if found:
                return sum(found) / len(found)
        return self.zero

    def score(self, words: list[str]):
        import numpy as np

        total = np.zeros(self.n)
        for lo in range(0, len(words), CACHE_WORDS // 2):  # so that one text fits into the cache
            part = words[lo:lo + CACHE_WORDS // 2]
            new = {w for w in part if w not in self.at}
            if self.used + len(new) > len(self.rows):
                self.fresh()
                new = {w for w in part if w not in self.at}
            for w in new:
                self.rows[self.used] = self.backoff(w)
                self.at[w] = self.used
                self.used += 1
            at = self.at
            total += self.rows[np.fromiter((at[w] for w in part), np.int64, len(part))].sum(axis=0)
        return total


def identify(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and lang_score (0 to 1)."""
    shared, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batch):
        import pyarrow as pa

        langs = shared.value["langs"]
        s = cached(key, lambda: Scorer(shared.value)) if langs else None
        pred, score = [], []
        for t in batch.column(text).to_pylist():
            words = letters(t)
            if not words or s is None:
                pred.append("und")
                score.append(0.0)
                continue
            v = s.score(words)
            best = int(v.argmax())
            pred.append(langs[best])
            score.append(1.0 / math.fsum(math.exp(max(-700.0, x - v[best])) for x in v.tolist()))
        return {"lang_pred": pa.array(pred, pa.string()), "lang_score": pa.array(score, pa.float64())}

    return with_columns(docs, ADDED, run)
