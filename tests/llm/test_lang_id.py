import random

from vigil.llm import lang_id

WORDS = {"en": "the of and that with which there have from they".split(), "de": "der die und nicht werden eine über schön straße auch".split(),
         "fr": "le les des être une avec pour très où déjà".split()}


def _rows(rng, n):
    rows = []
    for i in range(n):
        lg = rng.choice(list(WORDS))
        stems = [a + b[1:] for a in WORDS[lg] for b in WORDS[lg]]  # unseen words of the language's own letters
        rows.append((i, " ".join(rng.choice(WORDS[lg] if rng.random() < 0.3 else stems) for _ in range(rng.randrange(4, 40))).title(), lg))
    return rows


def test_held_out_accuracy_and_edges(spark, awkward, empty):
    rows = _rows(random.Random(4), 900)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lang_id.fit(df.where("doc_id < 400"))
    out = lang_id.identify(df.select("doc_id", "text"), model).collect()
    right = [r.lang_pred == rows[r.doc_id][2] for r in out if r.doc_id >= 400]
    assert sum(right) / len(right) > 0.97 and all(0 <= r.lang_score <= 1 for r in out)
    got = {r.doc_id: r for r in lang_id.identify(awkward, model).collect()}
    assert all((got[k].lang_pred, got[k].lang_score) == ("und", 0.0) for k in (4, 5, 6, 13)) and got[0].lang_pred in WORDS
    assert lang_id.identify(empty, model).count() == 0
    none = lang_id.fit(df.where("doc_id < 0"))
    assert {r.lang_pred for r in lang_id.identify(df, none).collect()} == {"und"}


def test_null_languages_are_not_learned(spark, awkward):
    assert lang_id.fit(awkward)["langs"] == ["en"]


def test_backoff_takes_the_longest_known_order():
    tables = {k: {} for k in range(6)}
    tables[0], tables[2], tables[1] = {"known": [9, 1]}, {"^a": [5, 1], "b$": [1, 5]}, {"a": [3, 3], "z": [1, 8]}
    s = lang_id.Scorer({"langs": ["x", "y"], "tables": tables})
    assert s.backoff("ab").tolist() == ((s.tables[2]["^a"] + s.tables[2]["b$"]) / 2).tolist()
    assert s.backoff("z").tolist() == s.tables[1]["z"].tolist() and s.backoff("q").tolist() == [0, 0]
    assert s.score(["known"]).tolist() == s.tables[0]["known"].tolist()
    s.rows, s.used = s.rows[:2], 2  # a full cache starts anew
    assert s.score(["ab", "known"]).shape == (2,)


def test_a_small_language_keeps_its_own_entries(spark):
    """Thirty rows beside 900, with tables that the large languages alone would fill."""
    rng = random.Random(8)
    rows = _rows(rng, 900)
    small = "og det som på kan ikke være blev også søn".split()
    stems = [a + b[1:] for a in small for b in small]
    text = lambda: " ".join(rng.choice(small + stems) for _ in range(12))
    rows += [(900 + i, text(), "da") for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lang_id.fit(df.where("doc_id < 930"), max_words=25, max_grams=20)
    assert len(model["langs"]) == 4 and all(sum(c[model["langs"].index("da")] > 0 for c in model["tables"][k].values()) >= 15 for k in (0, 2, 3))
    out = [r.lang_pred for r in lang_id.identify(df.where("doc_id >= 930"), model).collect()]
    assert out.count("da") >= 0.95 * len(out)


def test_scores_equal_a_plain_computation(spark):
    import math

    rows = _rows(random.Random(6), 120)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lang_id.fit(df, max_words=30, max_grams=40)
    langs = model["langs"]
    logs = {k: {g: [math.log((c[i] + 0.5) / sum(x[i] + 0.5 for x in t.values())) for i in range(len(langs))] for g, c in t.items()} for k, t in model["tables"].items()}

    def word(w):
        for k in range(0, 6):
            order = k and 6 - k
            parts = [w] if order == 0 else [f"^{w}$"[i:i + order] for i in range(len(w) + 3 - order)]
            found = [logs[order][p] for p in parts if p in logs[order]]
            if found:
                return [sum(v[i] for v in found) / len(found) for i in range(len(langs))]
        return [0.0] * len(langs)

    for r in lang_id.identify(df, model).collect():
        total = [sum(x) for x in zip(*(word(w) for w in lang_id.letters(r.text)), strict=True)]
        best = max(range(len(langs)), key=lambda i: total[i])
        assert r.lang_pred == langs[best]
        assert abs(r.lang_score - 1 / sum(math.exp(x - total[best]) for x in total)) < 1e-9


def test_labels_of_free_text_are_bounded(spark, caplog):
    rows = [(i, f"wort{i} der die", f"label {i}") for i in range(40)] + [(100 + i, "the of and", "en") for i in range(5)]
    model = lang_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_langs=7)
    assert len(model["langs"]) == 7 and "en" in model["langs"] and "distinct labels" in caplog.text
