import collections
import math
import random
import re

from vigil.llm import bag_search as bs

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = {i: i + 32 for i in range(65, 91)}


def words(text):
    return TERM.findall((text or "").translate(FOLD))


def brute(docs, items, k=10):
    bags = [(i, collections.Counter(words(t))) for i, t, *_ in docs]
    n_docs, n_terms = sum(bool(b) for _, b in bags), sum(b.total() for _, b in bags)
    df = collections.Counter(t for _, b in bags for t in b)
    asked = {}
    for i, t, *_ in items:
        asked.setdefault(i, []).extend(words(t))
    out = []
    for item, terms in asked.items():
        scored = []
        for i, b in bags:
            m = 25 + 75 * b.total() * n_docs // max(1, n_terms)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t in terms if b[t])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def run(spark, docs, items, **opt):
    d = spark.createDataFrame(docs, "doc_id long, text string, rank string, score int, item long").repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string, bag string")
    got = bs.search(d, i, **opt)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, got.collect()), key=str)


def some_docs(n, seed=1):
    r = random.Random(seed)
    vocab = [f"W{r.randrange(10**6):x}" for _ in range(60)] + ["é", "日本", "x1"]
    texts = [" ".join(r.choices(vocab, k=r.randrange(1, 30))) for _ in range(n // 3)]
    return vocab, [(i, r.choice(texts) + ("" if r.random() < 0.8 else "  unasked?!"), "r", 1, 1) for i in r.sample(range(10 * n), n)]


def test_equals_brute_force_with_classes(spark):
    vocab, docs = some_docs(400)
    docs += [(5_000 + i, "hot hot words", "", 0, 0) for i in range(300)]  # one class of a third of all rows
    docs += docs[:9] + [(None, docs[0][1], "", 0, 0), (None, "hot hot words", "", 0, 0), (None, None, "", 0, 0), (9_999, "", "", 0, 0), (9_998, " -- ", "", 0, 0)]
    items = [(k, " ".join(vocab[k:k + 7]) + " HOT, hot", "") for k in range(0, 40, 4)] + [(70, vocab[0], ""), (70, vocab[1] + " " + vocab[0], ""), (71, None, ""), (72, "?", ""), (73, "nowhere", ""), (None, vocab[2], "")]
    want = brute(docs, items)
    assert len({x[2] for x in want if x[0] == 0}) == 10
    assert run(spark, docs, items) == want
    assert run(spark, docs, items, block_rows=20) == want
    assert run(spark, docs, items, k=3) == brute(docs, items, 3)


def test_same_counts_and_other_length_are_two_classes(spark):
    docs = [(1, "a b", "", 0, 0), (2, "a b " + "z " * 40, "", 0, 0), (3, "b a", "", 0, 0), (4, "b", "", 0, 0)]
    got = run(spark, docs, [(0, "a", "")])
    assert got == brute(docs, [(0, "a", "")]) and [x[2] for x in got] == [1, 3, 2] and got[0][3] == got[1][3] > got[2][3]
    bags = bs._bags(spark.createDataFrame(docs, "doc_id long, text string, rank string, score int, item long"), "text", "doc_id", [b"a", b"b"])
    assert sorted(r.ids for r in bs.classes(bags, 4, 46).collect()) == [[1, 3], [2], [4]]


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a", "")]) == [] and run(spark, [(1, "a", "", 0, 0)], []) == [] and run(spark, [(1, None, "", 0, 0)], [(1, "a", "")]) == []


def test_sums_beyond_doubles_are_exact(spark):
    docs = [(i, "a " * (i + 1) + "b", "", 0, 0) for i in range(40)]
    items = [(1, "a " * 400_000, ""), (2, "b", "")]  # 400,000 repeats of a weight of some thousands
    docs += [(100 + i, "c", "", 0, 0) for i in range(900)]
    assert run(spark, docs, items) == brute(docs, items)


def test_long_texts_in_pieces():
    table = bs._table()
    r = random.Random(3)
    text = "".join(r.choice("abAB é 日-x9") for _ in range(5_000))
    want = collections.Counter(words(text))
    for piece in (1, 7, 100, 10**6):
        n, got = bs.counts(text.encode(), table, piece)
        assert n == want.total() and {t.decode(): c for t, c in got.items()} == want
    assert bs.counts(None, table) == bs.counts(b"", table) == (0, {})
