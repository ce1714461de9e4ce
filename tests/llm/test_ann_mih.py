import numpy as np

from vigil.llm import ann_mih

SCHEMA = "vec_id long, embedding array<float>, label int, rank string"


def brute(rows, k=10):
    ok = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v, *_ in rows
          if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ids, x = np.array([i for i, _ in ok]), np.array([v for _, v in ok])
    out = {}
    for q in sorted({i for i in ids.tolist() if i % 100 == 0}):
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        out[q] = [(int(ids[j]), d[j]) for j in np.lexsort((ids, d)) if ids[j] != q][:k]
    return out


def run(df, **opt):
    got = {}
    for r in ann_mih.nearest(df, **opt).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert all([x[0] for x in sorted(v)] == list(range(1, len(v) + 1)) for v in got.values())
    return {q: [(i, s) for _, i, s in sorted(v)] for q, v in got.items()}


def test_recall_scores_and_ties(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 32))
    v = centres[rng.integers(0, 12, 3000)] + 0.6 * rng.normal(size=(3000, 32))
    v[1000:1400] = v[500]  # a third of a neighbourhood is one vector: ties go to smaller ids
    rows = [(i, [float(np.float32(a)) for a in x], 0, "r") for i, x in enumerate(v)]
    want = brute(rows)
    got = run(spark.createDataFrame(rows, SCHEMA), shard_rows=700)
    assert set(got) == set(want) and all(len(x) == 10 for x in got.values())
    hit = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 10 for q in want])
    assert hit >= 0.9
    dist = {(q, i): d for q in want for i, d in want[q]}
    assert all(abs(s - dist[q, i]) < 1e-9 for q in got for i, s in got[q] if (q, i) in dist)
    assert [i for i, _ in got[1000]] == [500, *range(1001, 1010)]


def test_unusable_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0, 3.0], 0, ""), (1, None, 0, ""), (2, [0.0, 0.0, 0.0], 0, ""), (3, [1.0, nan, 0.0], 0, ""), (4, [1.0, inf, 0.0], 0, ""), (5, [1.0, None, 0.0], 0, ""),
            (100, [1.0, 2.0, 4.0], 0, ""), (200, [0.0, 0.0, 0.0], 0, ""), (300, None, 0, ""), (7, [9.0, 2.0, 3.0], 0, ""), (None, [1.0, 2.0, 3.0], 0, "")]
    got = run(spark.createDataFrame(rows, SCHEMA))
    assert got == {0: [(100, 1.0), (7, 8.0)], 100: [(0, 1.0), (7, 65 ** 0.5)]}
    assert run(spark.createDataFrame([], SCHEMA)) == {}
    assert run(spark.createDataFrame(rows[:3], SCHEMA)) == {}  # a query without candidates


def test_probing_meets_every_code_within_the_radius():
    rng = np.random.default_rng(2)
    code = rng.integers(0, 256, (4000, 4)).astype(np.uint8)
    s = ann_mih.Shard(np.arange(4000), np.zeros((4000, 1)), code)
    bits = np.unpackbits(code, axis=1)
    for q in range(20):
        d = (bits != bits[q]).sum(axis=1)
        for r in (0, 3, 7, 12, 32):
            assert s.within(code[q], r).tolist() == np.flatnonzero(d <= r).tolist()
