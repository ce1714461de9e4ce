import random
import re
from collections import Counter

from vigil.llm.substring_dedup import dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, k):
    words = [WORD.findall(t or "") for _, t in rows]
    count = Counter(tuple(w[i:i + k]) for w in words for i in range(len(w) - k + 1))
    out = []
    for (d, _), w in zip(rows, words):
        gone = {p for i in range(len(w) - k + 1) if count[tuple(w[i:i + k])] > 1 for p in range(i, i + k)}
        spans = []
        for p in sorted(gone):
            if spans and spans[-1][1] == p:
                spans[-1][1] = p + 1
            else:
                spans.append([p, p + 1])
        out.append((d, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone), spans))
    return sorted(out, key=str)


def got(df, k):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text, r.removed) for r in dedup(df, k=k).collect()), key=str)


def test_awkward_rows(awkward, empty):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    assert got(awkward, 35) == brute(rows, 35)
    assert dedup(empty).count() == 0


def test_repeats_within_and_across(spark):
    rng = random.Random(4)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(80):
        w = [rng.choice("abcdefghij") + str(rng.randrange(40)) for _ in range(rng.randrange(0, 200))]
        if i % 5 == 0:
            at = rng.randrange(len(w) + 1)
            w[at:at] = passage[rng.randrange(10):rng.randrange(40, 60)]
        if i % 9 == 0:
            w += ["x"] * rng.randrange(10, 60)  # overlaps with itself
        rows.append((i, " ".join(w)))
    assert got(spark.createDataFrame(rows, "doc_id long, text string"), 12) == brute(rows, 12)


def test_only_short_texts(spark):
    rows = [(1, "too short"), (2, ""), (3, None)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string"), 35) == brute(rows, 35)
