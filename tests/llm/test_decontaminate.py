import random
import re

from vigil.llm.decontaminate import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, items, n=13):
    wins = {}
    for iid, t in items:
        w = WORD.findall((t or "").translate(LOWER))
        if iid is not None and w:
            for i in range(max(1, len(w) - n + 1)):
                wins.setdefault(tuple(w[i:i + n]), set()).add(str(iid))
    out = []
    for d, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        hit, ids = set(), set()
        for size in {len(x) for x in wins}:
            for i in range(len(w) - size + 1):
                if tuple(w[i:i + size]) in wins:
                    hit |= set(range(i, i + size))
                    ids |= wins[tuple(w[i:i + size])]
        out.append((d, len(w), len(hit), sorted(ids), bool(hit) and 20 * len(hit) >= len(w), sorted(hit)))
    return sorted(out, key=str)


def got(df, bench, **opt):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.item_ids, r.contaminated, r.hit_words) for r in decontaminate(df, bench, **opt).collect()), key=str)


def test_against_brute_force_with_one_and_many_blocks(spark, awkward, empty):
    rng = random.Random(7)
    words = ["ja", "da", "No", "é", "9", "su"]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 40)))) for i in range(30)] + [(30, None), (None, "ja da no"), (3, "another text for item three")]
    rows = []
    for i in range(120):
        w = [rng.choice([*words, "zzz"]) for _ in range(rng.randrange(0, 120))]
        if i % 3 == 0:
            src = items[rng.randrange(30)][1].split()
            w[5:5] = src
        rows.append((i, rng.choice([" ", ", ", "\n--"]).join(w)))
    rows += [(200, None), (201, ""), (202, "...")]
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute(rows, items)
    assert got(df, bench) == want
    assert got(df, bench, block_bytes=300) == want
    assert decontaminate(empty, bench).count() == 0
    assert all(x[2] == 0 for x in got(awkward, bench.where("item_id = -1")))


def test_spans_map_to_the_original(spark):
    item = "Alpha, beta: gamma delta epsilon zeta eta theta iota kappa lambda mu nu"
    text = "Früher… " + item.upper().replace(" ", "  \n") + "! Ende"
    r = decontaminate(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(9, item)], "item_id long, text string")).first()
    (span,) = r.hit_spans
    assert text[span.start:span.end] == item.upper().replace(" ", "  \n") and r.item_ids == ["9"] and r.contaminated
