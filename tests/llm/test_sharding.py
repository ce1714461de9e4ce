import zlib

from vigil.llm.sharding import shard


def check(rows, out, shards):
    assert sorted(str(r.doc_id) for r in out) == sorted(str(d) for d, _ in rows)
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r)
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values()) and set(by) <= set(range(shards))
    sizes = {}
    for d, t in rows:
        sizes.setdefault(d, []).append((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())))
    assert all((r["size"], r.text_crc32) in sizes[r.doc_id] for r in out)
    total, most = sum(x for v in sizes.values() for x, _ in v), max(x for v in sizes.values() for x, _ in v)
    for k in range(shards):
        assert abs(sum(r["size"] for r in by.get(k, [])) - total / shards) <= most + 1
    return by


def test_awkward_rows(awkward, empty):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    check(rows, shard(awkward, shards=3).collect(), 3)
    assert shard(empty).count() == 0


def test_hot_group_and_small_samples(spark):
    rows = [(i, "same text " * 20 if i % 3 == 0 else f"text {i} " * (1 + i % 40)) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    by = check(rows, shard(df, shards=24, ranges_per_shard=2, sample_per_range=1).collect(), 24)
    # equal texts lie together: the hot group covers a run of shards, at most two of them shared with others
    hot = {r.doc_id for r in [x for v in by.values() for x in v] if r.doc_id % 3 == 0}
    mixed = [k for k, v in by.items() if 0 < sum(r.doc_id in hot for r in v) < len(v)]
    assert len(mixed) <= 2


def test_same_law_whatever_the_partitions(spark):
    rows = [(i, "abc" * (i % 17)) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda d: sorted(tuple(r) for r in shard(d).collect())
    assert key(df.repartition(1)) == key(df.repartition(7))


def test_main_path_is_native(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = shard(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "InPandas" not in plan
