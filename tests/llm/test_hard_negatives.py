import numpy as np
import pytest

from vigil.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int, rank string"


def brute(rows, positives=5, negatives=3, every=50):
    ok = [(i, [int(np.floor(256 * x)) for x in v], y) for i, v, y, *_ in rows
          if i is not None and y is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    lengths = [len(v) for _, v, _ in ok]
    if lengths:
        size = min(set(lengths), key=lambda n: (-lengths.count(n), n))
        ok = [r for r in ok if len(r[1]) == size]
    out = []
    for i, v, y in {(i, tuple(v), y) for i, v, y in ok if i % every == 0}:
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, z) for j, w, z in ok if j != i)
        for p, j, _ in [s for s in scored if s[2] == y][:positives]:
            got = [(n, k) for n, k, z in scored if z != y and -50 * p <= -100 * n <= -95 * p][:negatives]
            out += [(i, j, rank, k, -p, -n) for rank, (n, k) in enumerate(got, 1)]
    return sorted(out)


def run(spark, rows, **opt):
    return sorted(map(tuple, hn.mine(spark.createDataFrame(rows, SCHEMA), **opt).collect()))


@pytest.mark.parametrize("labels", [3, 400])
def test_equals_brute_force(spark, labels):
    rng = np.random.default_rng(labels)
    v = rng.normal(size=(900, 12)) * 0.4
    v[100:400] = v[50]  # a third of the rows is one vector: ties go to smaller ids
    y = rng.integers(0, labels, 900)
    rows = [(int(i), x.tolist(), int(c), "r") for i, x, c in zip(rng.permutation(900), v, y, strict=True)]
    rows += rows[40:60] + [(50, [0.5] * 12, 1, ""), (7, rows[3][1], 2, "")]  # repeated rows, and ids with two vectors
    assert run(spark, rows, chunk_rows=128, block_rows=5) == brute(rows)


def test_awkward_rows_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1, ""), (50, [2.0, 1.0], 2, ""), (1, [1.0, 1.5], 1, ""), (2, [0.5, 1.0], 2, ""), (3, [0.9, 1.2], 3, ""), (4, [0.0, 0.0], 3, ""),
            (5, None, 1, ""), (6, [1.0, nan], 1, ""), (7, [inf, 1.0], 1, ""), (8, [1.0, None], 1, ""), (9, [1.0, 2.0], None, ""), (None, [1.0, 2.0], 1, ""),
            (10, [], 1, ""), (11, [1.0, 2.0, 3.0], 1, "")]
    assert run(spark, rows) == brute(rows) != []
    assert run(spark, []) == [] and run(spark, rows[:1]) == [] and run(spark, rows[4:]) == []


def test_zero_and_negative_positives(spark):
    rows = [(0, [0.0, 0.0], 1, ""), (1, [3.0, 3.0], 1, ""), (2, [1.0, 1.0], 2, ""), (50, [1.0, 0.0], 5, ""), (51, [-1.0, 0.0], 5, ""), (52, [-0.7, 0.0], 6, "")]
    assert run(spark, rows) == brute(rows)


def test_products_of_any_size_are_exact(spark):
    rng = np.random.default_rng(5)
    for scale in (1e-3, 1.0, 1e4, 1e6, 1e9):
        a, c = (np.floor(rng.normal(size=(n, 16)) * scale * 256).astype(np.int64) for n in (7, 53))
        p = hn.Packed(c, a)
        want = [[sum(int(x) * int(y) for x, y in zip(r, s, strict=True)) for s in c] for r in a]
        assert [[int(x) for x in r] for r in p.scores(0, 7)] == want
        assert (p.fields > 1) == (scale <= 1) and p.any == (scale >= 1e6)
    rows = [(i, (rng.normal(size=4) * 1e6).tolist(), i % 2, "") for i in range(120)]
    assert run(spark, rows, chunk_rows=40) == brute(rows)


def test_far_from_zero_components_are_exact():
    c = np.full((5, 16), 1 << 30) + np.arange(5)[:, None]
    p = hn.Packed(c, c[:2])
    assert p.any and [[int(x) for x in r] for r in p.scores(0, 2)] == [[16 * int(x) * int(y) for y in c[:, 0]] for x in c[:2, 0]]
