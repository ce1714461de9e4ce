import pytest
import random
from collections import Counter

from vigil.llm.token_scan import count_tokens, read_blocks, write_token_files
from vigil.llm.tokens import Encoder, vocabulary_path


def test_counts_over_any_block_size(spark, awkward, tmp_path):
    enc = Encoder(vocabulary_path())
    write_token_files(awkward, str(tmp_path / "t"), file_docs=4)
    want = Counter(len(enc.ids(r.text or "")) for r in awkward.collect())
    for block in (64, 1 << 20):
        out = count_tokens(read_blocks(spark, str(tmp_path / "t"), block), block_bytes=block).collect()
        assert Counter(r.n_tokens for r in out) == want and all(r.complete for r in out)
    files = {}
    for r in out:
        files.setdefault(r.file, []).append((r.doc_no, r.start, r.n_tokens))
    for docs in files.values():  # numbered without gaps, each starting after the end id before it
        docs.sort()
        assert [d for d, _, _ in docs] == list(range(len(docs)))
        assert all(b[1] == a[1] + a[2] + 1 for a, b in zip(docs, docs[1:])) and docs[0][1] == 0


def test_hand_made_files(spark, tmp_path):
    rng = random.Random(1)
    want = {}
    for name in "abc":
        docs = [[rng.randrange(50_000) for _ in range(rng.choice([0, 1, 5, 700]))] for _ in range(20)]
        data = b"".join(b"".join(t.to_bytes(2, "big") for t in [*d, 50_256]) for d in docs)
        want[name] = [(len(d), True) for d in docs]
        if name == "b":  # an unfinished last document
            data += (7).to_bytes(2, "big") * 9
            want[name].append((9, False))
        (tmp_path / name).write_bytes(data)
    (tmp_path / "nothing").write_bytes(b"")
    for block in (2, 10, 4096):
        out = count_tokens(read_blocks(spark, str(tmp_path), block), block_bytes=block).orderBy("file", "doc_no").collect()
        assert {n: [(r.n_tokens, r.complete) for r in out if r.file.endswith(f"/{n}")] for n in "abc"} == want


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    from pyspark.sql import functions as F

    docs = [[i % 50_000] * (i % 90) for i in range(300)]
    (tmp_path / "one file").write_bytes(b"".join(t.to_bytes(2, "big") for d in docs for t in [*d, 50_256]))
    most = "spark.sql.sources.binaryFile.maxLength"
    spark.conf.set(most, "1000")  # as for a file above what one row can hold
    try:
        blocks = read_blocks(spark, str(tmp_path), 256, task_bytes=2048)
        dealt = blocks.groupBy(F.spark_partition_id()).agg(F.sum(F.length("data")).alias("n")).collect()
        assert len(dealt) > 5 and max(r.n for r in dealt) < 8192
        got = [(r.n_tokens, r.complete) for r in count_tokens(blocks, block_bytes=256).orderBy("doc_no").collect()]
        assert got == [(len(d), True) for d in docs]
    finally:
        spark.conf.unset(most)


def test_a_store_that_python_cannot_open(spark, tmp_path, monkeypatch, caplog):
    from vigil.llm import token_scan

    (tmp_path / "a").write_bytes(b"".join(t.to_bytes(2, "big") for t in [1, 2, 50_256, 3, 50_256]))
    def unknown(uri):
        import pyarrow as pa

        raise pa.ArrowInvalid("Unrecognized filesystem type in URI")

    monkeypatch.setattr(token_scan, "_opened", unknown)
    got = count_tokens(read_blocks(spark, str(tmp_path), 4), block_bytes=4).orderBy("doc_no").collect()
    assert [r.n_tokens for r in got] == [2, 1] and "by whole files" in caplog.text
    monkeypatch.setattr(token_scan, "_opened", lambda uri: 1 / 0)
    with pytest.raises(ZeroDivisionError):  # any other error is raised
        read_blocks(spark, str(tmp_path), 4)


def test_no_files_with_tokens(spark, empty, tmp_path):
    write_token_files(empty, str(tmp_path / "t"))
    assert count_tokens(read_blocks(spark, str(tmp_path / "t"))).count() == 0
