"""The vectorised words and hashes against plain Python."""

import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from vigil.llm import repeats, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ascii_lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_words_match_the_pattern(monkeypatch):
    rng = random.Random(1)
    texts = ["".join(rng.choice("aB é日\t\n\r\x0b\x0c \xa0\x85") for _ in range(rng.randrange(60))) for _ in range(400)] + [None, "", " "]
    for size in (64, 1 << 20):
        monkeypatch.setattr(words, "SLICE", size)
        got = []
        for _, w in words.slices(pa.chunked_array([texts[:100], texts[100:]], pa.string()), fold=False):
            raw = w.buf.tobytes()
            for k in range(len(w.counts)):
                got.append([raw[a:b].decode() for a, b in zip(w.start[w.first[k]:w.first[k + 1]], w.end[w.first[k]:w.first[k + 1]])])
        assert got == [WORD.findall(t or "") for t in texts]


def test_window_hashes_are_equal_exactly_for_equal_windows():
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["a", "b", "Ab", "aB", "é"]) for _ in range(rng.randrange(40))) for _ in range(300)]
    for fold in (False, True):
        seen, back = {}, {}
        for at, w in words.slices(pa.array(texts), fold):
            first, text, h = w.windows(5, short=True)
            for f, t, v in zip(first, text, h.tolist()):
                ws = WORD.findall(texts[at + t].translate(ascii_lower) if fold else texts[at + t])
                i = int(f - w.first[t])
                win = tuple(ws[i:i + 5]) if len(ws) >= 5 else tuple(ws)
                assert seen.setdefault(win, v) == v and back.setdefault(v, win) == win
        assert seen


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), unique=True))
def test_messages_round_trip(values):
    v = np.array(sorted(values), dtype=np.uint64)
    assert repeats.unpack(repeats.pack(v)).tolist() == v.tolist()
    few = (v % 256).astype(np.uint8)
    assert repeats.unsqueeze(repeats.squeeze(few)).tolist() == few.tolist()


def test_sketch_never_underestimates_and_rarely_over():
    rng = np.random.default_rng(3)
    lists = [rng.integers(0, 3000, 800).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for _ in range(5)] + [np.zeros(0, np.uint64)]
    sketch = repeats.Sketch.for_items(4000)

    class Frame:  # stands for the grouped messages: merges each shard as the job would
        def __init__(self, table):
            self.table = table

        def groupBy(self, key):
            return self

        def applyInArrow(self, f, schema):
            shards = sorted(set(self.table.column("shard").to_pylist()))
            return pa.concat_tables([f(self.table.filter(pa.array([s == k for s in self.table.column("shard").to_pylist()]))) for k in shards])

    answers = repeats.merge(Frame(pa.concat_tables([repeats.ask(sketch, b, h) for b, h in enumerate(lists)])), sketch)
    true = dict(zip(*np.unique(np.concatenate(lists), return_counts=True)))
    over = 0
    for b, h in enumerate(lists):
        est = repeats.estimates(sketch, answers.filter(pa.array([x == b for x in answers.column("bucket").to_pylist()])), h)
        for v, e in zip(h, est):
            assert e >= min(true[v], repeats.TOP)
            over += e > true[v]
    assert over < 400


def test_a_worker_keeps_the_latest_jobs_value_only():
    from vigil.llm import common

    c = common.worker_cache()
    before = dict(c)
    c.clear()
    try:
        common.cached(("table", 1), lambda: "kept")
        for k in range(9):
            assert common.cached(f"job{k}", lambda k=k: k) == k
        assert set(c) == {("table", 1), "job8"} and common.cached("job8", lambda: 1 / 0) == 8
    finally:
        c.clear()
        c.update(before)
