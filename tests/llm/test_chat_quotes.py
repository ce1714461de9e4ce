from vigil.llm.chat_quotes import conversations, parse

SCHEMA = "conv_id long, turn int, role string, text string, position string"


def test_parse_levels_and_passages():
    own, got = parse("Hi,\n> one  Two\n> three\n>> deep\nOn Monday Ann wrote:\n>again\nbye")
    assert own == "Hi,\nbye"
    assert got == [(0, 0, "hi,"), (1, 1, "one two"), (1, 1, "three"), (1, 1, "one two three"), (2, 2, "deep"), (1, 4, "again"), (0, 5, "bye")]
    assert parse(None) == (None, []) and parse("") == ("", []) and parse("a > b")[0] == "a > b"


def test_links_threads_and_order(spark):
    rows = [(1, 0, "u", "Hello there.\nHow are you?", "z"), (1, 1, "a", "> How are  YOU?\nFine.", "z"), (1, 2, "u", ">> How are you?\n> Fine.\nGood", "z"), (1, 3, "u", "New topic.", "z"),
            (1, 4, "a", "> Hello there.\n> How are you?\nhi", "z"), (1, 5, "a", "> nobody said this\nwhat", "z"), (2, 0, "u", "> Fine.\nother conversation", "z"),
            (None, 1, "u", None, "z"), (3, None, "u", "> Hello there.", "z"), (4, 0, None, "", "z"), (4, 0, None, "", "z")]
    out = sorted((str(r.conv_id), str(r.turn), r.text, r.n_quoted, r.n_linked, r.parent_turn, r.thread_turn, r.depth, r.position)
                 for r in conversations(spark.createDataFrame(rows, SCHEMA)).collect())
    assert out[:6] == [("1", "0", "Hello there.\nHow are you?", 0, 0, None, 0, 0, 1), ("1", "1", "Fine.", 1, 1, 0, 0, 1, 2), ("1", "2", "Good", 2, 2, 1, 0, 2, 3),
                       ("1", "3", "New topic.", 0, 0, None, 3, 0, 1), ("1", "4", "hi", 1, 1, 0, 0, 1, 4), ("1", "5", "what", 1, 0, None, 5, 0, 1)]
    assert out[6] == ("2", "0", "other conversation", 1, 0, None, 0, 0, 1)
    assert len(out) == len(rows) and conversations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_long_chain_of_replies(spark):
    rows = [(1, i, "u", f"message {i}" if i == 0 else f"> message {i - 1}\nmessage {i}", "") for i in range(70)]
    out = conversations(spark.createDataFrame(rows, SCHEMA)).orderBy("turn").collect()
    assert [(r.depth, r.thread_turn, r.position) for r in out] == [(i, 0, i + 1) for i in range(70)]


def test_a_line_that_everybody_writes_does_not_multiply(spark):
    rows = [(1, i, "u", "> thanks\nthanks", "") for i in range(500)] + [(1, 500, "u", "> thanks", "")]
    out = conversations(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == 501 and {r.parent_turn for r in out} == {None, 0}
