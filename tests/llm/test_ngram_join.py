"""The join against all pairs by brute force, and the pairs it needs for a large group of near copies."""

import random
import re

from vigil.llm import ngram_join
from vigil.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets_of(rows):
    out = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        out.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def brute(rows):
    sets = sets_of(rows)
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join(df).collect()), key=str)


def test_awkward_rows(awkward, empty):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    assert got(awkward) == brute(rows)
    assert ngram_join.join(empty).count() == 0


def test_near_copies_at_and_around_the_threshold(spark):
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(300)]
    rows, common = [], " ".join(rng.choice(vocabulary) for _ in range(30))
    for g in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(20, 150))]
        for _ in range(rng.randrange(1, 9)):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(w) // 25)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(w) + (" " + common if g % 3 == 0 else "")))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df) == brute(rows)


def test_large_group_of_near_copies_costs_its_size_not_its_square(spark, monkeypatch):
    rng = random.Random(6)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(300):
        w = list(base)
        w[rng.randrange(120)] = f"r{i}"
        rows.append((i, " ".join(w)))
    counted = []
    real = ngram_join.count_overlaps
    monkeypatch.setattr(ngram_join, "count_overlaps", lambda pairs, *a, **b: counted.append(pairs.count()) or real(pairs, *a, **b))
    assert {c for _, _, c in got(spark.createDataFrame(rows, "doc_id long, text string"))} == {0}
    assert sum(counted) < 12 * len(rows)  # all pairs would be 44,850


def test_components_of_a_chain_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200 + i) for i in range(30)] + [(7, 7)]
    out = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {out[i] for i in range(61)} == {0} and {out[200 + i] for i in range(30)} == {100}


def test_null_ids_link_as_copies_and_as_bridges(spark):
    text = lambda lo, hi: " ".join(f"c{i}" for i in range(lo, hi))
    for middle in (3, None):
        # a chain of 36, 41 and 46 shingles: each link is 0.87 or more, the ends are at 0.78
        rows = [(1, text(0, 40)), (middle, text(0, 45)), (5, text(0, 50)), (None, text(100, 140)), (None, text(100, 142)), (None, None), (7, text(200, 240)), (None, text(200, 241)), (None, text(200, 241))]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        out = got(df)
        assert out == brute(rows) and {c for d, _, c in out if d in (1, 5)} == {1} and (None, 37, 7) in out
        kept = ngram_join.join(df).where("first").collect()
        assert sorted((r.doc_id is None, r.n_shingles) for r in kept if r.n_shingles) == [(False, 36), (False, 36), (True, kept_size(kept))]


def kept_size(kept):
    return next(r.n_shingles for r in kept if r.doc_id is None and r.n_shingles)


def test_only_empty_texts(spark):
    rows = [(1, ""), (2, None), (3, " ")]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == [(1, 0, 1), (2, 0, 2), (3, 0, 3)]
