import bisect
import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from vigil.llm import packing
from vigil.llm.tokens import Encoder, vocabulary_path


def reference_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return [t.encode(x, add_special_tokens=False).ids for x in texts]


ENC = Encoder(vocabulary_path())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r\xa0 \x1c\x85'sdtlmrev.,!1aéß日🙂<|endoftext|>"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_ids_equal_the_tokenizer_file(text):
    assert ENC.ids(text) == reference_ids([text])[0]


def check(out, rows, size):
    want = {}
    for d, t in rows:
        want.setdefault(d, []).append([*ENC.ids(t or ""), 2])
    seqs, docs = {}, {}
    for r in out:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        docs.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids))
    for places in seqs.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= size
    for d, lists in want.items():
        got = sorted(docs[d])
        assert sorted(int(n) for _, _, n, _ in got) == sorted(x for ids in lists for x in [*([size] * (len(ids) // size)), len(ids) % size] if x)
        if len(lists) == 1:
            assert [p for p, *_ in got] == list(range(len(got)))
            assert np.frombuffer(b"".join(x[3] for x in got), "<u4").tolist() == lists[0]
            assert [s for _, s, _, _ in got] == np.cumsum([0, *(n for _, _, n, _ in got)])[:-1].tolist()
    return len(seqs)


def best_fit_decreasing(hist, size):
    spaces, n = [], 0
    for v in range(size, 0, -1):
        for _ in range(int(hist[v])):
            k = bisect.bisect_left(spaces, v)
            if k == len(spaces):
                n, room = n + 1, size
            else:
                room = spaces.pop(k)
            if room - v:
                bisect.insort(spaces, room - v)
    return n


def test_awkward_rows(awkward, empty):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    check(packing.best_fit(awkward).collect(), rows, 1024)
    assert packing.best_fit(empty).count() == 0


def test_round_trip_and_few_sequences(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(f"w{rng.randrange(99)}" for _ in range(rng.choice([3, 20, 90, 300])))) for i in range(600)]
    out = packing.best_fit(spark.createDataFrame(rows, "doc_id long, text string"), size=128).collect()
    n = check(out, rows, 128)
    hist = np.bincount([r.length for r in out], minlength=129)
    assert n <= best_fit_decreasing(hist, 128) + 1


def test_plan_uses_up_the_histogram():
    rng = np.random.default_rng(1)
    for size, hist in ((64, np.bincount(rng.integers(1, 65, 5000), minlength=65)), (64, np.bincount([33] * 50 + [40] * 9, minlength=65)),
                       (1024, np.bincount(rng.integers(1, 1025, 20_000), minlength=1025)), (8, np.zeros(9, int)), (8, np.bincount([1] * 1000, minlength=9))):
        layout = packing.plan(hist, size)
        used = np.zeros(size + 1, int)
        for lengths, n in layout:
            assert sum(lengths) <= size and n > 0
            for v in lengths:
                used[v] += n
        assert used.tolist() == np.asarray(hist).tolist()
        if size == 1024:
            assert sum(n for _, n in layout) <= 1.01 * (np.arange(1025) * hist).sum() / 1024


def test_digests(spark):
    from pyspark.sql import functions as F

    r = packing.best_fit(spark.createDataFrame([(5, "hello")], "doc_id long, text string"), digests={"c": F.crc32("ids")}).first()
    assert r.c == zlib.crc32(np.array([*ENC.ids("hello"), 2], "<u4").tobytes())
