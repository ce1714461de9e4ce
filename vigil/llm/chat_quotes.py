"""Conversations in reply order, by linking quoted passages to the messages they quote.

A line's quote level is the number of leading ``>`` marks; consecutive lines of
one level are a passage. Passages and their lines are normalised (marks and
case dropped, white space collapsed) and hashed, as are the passages and lines
that messages wrote themselves. The hashes are joined: each maps to the first
message of the conversation that wrote it, so the join never multiplies rows,
however often a line recurs. A passage belongs to the message that wrote most of
it (by characters; the earlier one on ties), and the first level-1 passage with
an owner earlier than the message itself gives the message's parent. Threads are
the messages with a common root, found by pointer jumping; in a thread, a
message comes after what it answers. Quotes, and attribution lines that
introduce one, are taken out of the text.

Defined cases: a null or empty text has no quotes and is kept; a message
without a conversation or turn is its own thread; repeated (conversation, turn)
rows are one message for linking, and each row is kept; quotes of nothing known
are taken out but link to nothing. Input columns besides the four are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import staged
from vigil.operators.windows import running_sum

_QUOTE = re.compile(r"\s{0,3}((?:>\s?)+)(.*)\Z", re.DOTALL)
_ATTRIBUTION = re.compile(r"\s*(?:(?:on|am|le|el)\b.*|.*\b(?:wrote|schrieb|écrit|escribió))\s*:\s*\Z", re.IGNORECASE)
#: Turns per block when positions are counted, so that one long conversation is spread over tasks.
BLOCK_TURNS = 4_096

_PIECE = "array<struct<level:int,passage:int,h:bigint,weight:bigint>>"


def parse(text: str | None) -> tuple[str, list[tuple[int, int, str]]]:
    """(text without quotes, [(level, passage number, normalised text)]): level 0 is the message's own. Each
    passage gives its lines, and if it has several, also itself."""
    if not text:
        return text, []
    lines = []
    for line in text.split("\n"):
        m = _QUOTE.match(line)
        lines.append((m.group(1).count(">"), m.group(2)) if m else (0, line))
    drop = {i for i, (level, body) in enumerate(lines[:-1]) if level == 0 and lines[i + 1][0] > 0 and _ATTRIBUTION.match(body)}
    own = "\n".join(body for i, (level, body) in enumerate(lines) if level == 0 and i not in drop) if drop or any(x[0] for x in lines) else text
    out, number = [], 0
    run: list[str] = []

    def close(level: int) -> None:
        if len(run) > 1:
            out.append((level, number, " ".join(run)))

    before = None
    for i, (level, body) in enumerate(lines):
        if level != before:
            if before is not None:
                close(before)
                number += 1
            run, before = [], level
        norm = " ".join(body.lower().split())
        if norm and i not in drop:
            run.append(norm)
            out.append((level, number, norm))
    close(before)
    return (own.strip() if own is not text else text), out


def parsed(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, own_text, pieces)."""
    kinds = messages.select(conv, turn, role).schema
    schema = ", ".join([*(f"{n} {f.dataType.simpleString()}" for n, f in zip(("conv_id", "turn", "role"), kinds.fields, strict=True)), f"own_text string, pieces {_PIECE}"])

    def run(batches):
        import pyarrow as pa
        import xxhash

        kind = pa.list_(pa.struct([("level", pa.int32()), ("passage", pa.int32()), ("h", pa.int64()), ("weight", pa.int64())]))
        for b in batches:
            own, pieces = [], []
            for t in b.column(3).to_pylist():
                o, got = parse(t)
                own.append(o)
                pieces.append([{"level": lv, "passage": p, "h": xxhash.xxh3_64_intdigest(x.encode()) - (1 << 63), "weight": len(x)} for lv, p, x in got])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(own, pa.string()), pa.array(pieces, kind)],
                                             ["conv_id", "turn", "role", "own_text", "pieces"])

    return messages.select(conv, turn, role, text).mapInArrow(run, schema)


def link(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, level, passage, to): the earlier message that each quoted passage comes from."""
    x = messages.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn", F.explode("pieces").alias("p")).select("conv_id", "turn", "p.*")
    wrote = x.where("level = 0").groupBy("conv_id", "h").agg(F.min("turn").alias("to"))  # one row per key: the join cannot multiply
    asked = x.where("level > 0").join(wrote, ["conv_id", "h"]).where(F.col("to") < F.col("turn"))
    votes = asked.groupBy("conv_id", "turn", "level", "passage", "to").agg(F.sum("weight").alias("w"))
    return votes.groupBy("conv_id", "turn", "level", "passage").agg(F.max(F.struct(F.col("w"), (-F.col("to")).alias("n"))).alias("m")).select(
        "conv_id", "turn", "level", "passage", (-F.col("m.n")).alias("to"))


def as_replies(messages: DataFrame) -> DataFrame:
    """The messages as mail replies, for logs that hold no quotes: each turn answers the turn of half its number, and
    quotes that turn's first written line, below the line which that turn quoted itself."""
    line = messages.select("conv_id", "turn", F.regexp_extract("text", r"([^\n]*[^\s][^\n]*)", 1).alias("line")).where("line <> ''").dropDuplicates(["conv_id", "turn"])
    half = lambda t: F.when(F.col(t) >= 1, F.floor(F.col(t) / 2))
    one = line.select(F.col("conv_id").alias("c1"), F.col("turn").alias("t1"), F.col("line").alias("q1"))
    two = line.select(F.col("conv_id").alias("c2"), F.col("turn").alias("t2"), F.col("line").alias("q2"))
    d = messages.withColumn("_p", half("turn")).withColumn("_g", half("_p"))
    d = d.join(one, (F.col("conv_id") == F.col("c1")) & (F.col("_p") == F.col("t1")), "left").join(two, (F.col("conv_id") == F.col("c2")) & (F.col("_g") == F.col("t2")), "left")
    quote = lambda marks, q: F.coalesce(F.concat(F.lit(marks + " "), F.col(q), F.lit("\n")), F.lit(""))
    return d.withColumn("text", F.concat(quote(">>", "q2"), quote(">", "q1"), F.coalesce("text", F.lit("")))).select(*messages.columns)


def conversations(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, n_quoted, n_linked, parent_turn, thread_turn, depth, position): ``text`` is
    without quotes; ``thread_turn`` is the root; ``position`` counts from 1 in reply order inside a thread."""
    m = staged(parsed(messages, conv, turn, role, text))
    links = staged(link(m))
    parent = links.where("level = 1").groupBy("conv_id", "turn").agg(F.min(F.struct("passage", "to")).getField("to").alias("parent"))
    linked = links.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n_linked"))
    # roots of messages that answer one: parents are earlier, so jumping doubles the known stretch each round
    up = staged(parent.select("conv_id", "turn", F.col("parent").alias("up"), F.lit(1).cast("bigint").alias("depth")))
    while True:
        nxt = up.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("d2"))
        new = staged(up.join(nxt, ["conv_id", "up"], "left").select(
            "conv_id", "turn", F.coalesce("up2", "up").alias("up"), (F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth"), F.col("up2").isNotNull().alias("moved")))
        up = new.drop("moved")
        if new.where("moved").limit(1).count() == 0:
            break
    n_quoted = F.size(F.array_distinct(F.transform(F.filter("pieces", lambda p: p["level"] > 0), lambda p: p["passage"]))).cast("bigint")
    out = (m.select("conv_id", "turn", "role", F.col("own_text").alias("text"), n_quoted.alias("n_quoted"))
           .join(linked, ["conv_id", "turn"], "left").join(parent, ["conv_id", "turn"], "left").join(up, ["conv_id", "turn"], "left")
           .select("conv_id", "turn", "role", "text", "n_quoted", F.coalesce("n_linked", F.lit(0).cast("bigint")).alias("n_linked"),
                   F.col("parent").alias("parent_turn"), F.coalesce("up", "turn").alias("thread_turn"),
                   F.coalesce("depth", F.lit(0).cast("bigint")).alias("depth")))
    # rows of one message share their place
    place = out.groupBy("conv_id", "thread_turn", "turn").agg(F.lit(1).alias("one"))
    place = running_sum(place, ["conv_id", "thread_turn"], "turn", {"one": "position"}, block=F.floor(F.col("turn") / BLOCK_TURNS))
    place = place.select(F.col("conv_id").alias("c"), F.col("thread_turn").alias("r"), F.col("turn").alias("t"), F.col("position").cast("bigint").alias("position"))
    out = out.join(place, (F.col("conv_id") == F.col("c")) & (F.col("thread_turn") == F.col("r")) & (F.col("turn") == F.col("t")), "left")
    return out.withColumn("position", F.coalesce("position", F.lit(1).cast("bigint"))).drop("c", "r", "t")
