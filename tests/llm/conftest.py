import pytest

#: Rows with every awkward case: null and empty texts, white space only, ties, repeated rows, a null id, very long texts.
LONG = " ".join(f"w{i * i % 7919}" for i in range(30_000))


@pytest.fixture(scope="session")
def awkward(spark):
    from vigil.llm.common import small_batches

    small_batches(spark)
    base = "the quick brown fox jumps over the lazy dog again and again until the sun sets behind the hills far away from here"
    texts = [base, base, base.upper(), base + " today", "", None, "  \t\n ", "one two", "one two", "ONE two", "x", LONG, LONG + " end", "1 2 3", "日本 語 テキスト です ね",
             " ".join(f"u{i}" for i in range(200)), " ".join(f"u{i}" for i in range(200)) + " tail words differ here", "a  b\tc\nd\x0be\x0cf\rg\xa0h"]
    rows = [(i, t, "en" if i % 2 else None, i, "x") for i, t in enumerate(texts)] + [(0, texts[0], "en", 1, "y"), (None, "no id here at all", None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words long, CONTAMINATED string").repartition(3)


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.where("doc_id = -1")
