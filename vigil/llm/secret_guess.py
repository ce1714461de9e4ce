"""Secrets by fixed patterns and by the guess cost of values in credential contexts.

The base spans (assign, access, hex) follow fixed patterns and are always kept.
Beyond them, a value in a credential context (after a credential's name and
``=`` or ``:``, quoted or not; after "password is"; a bearer or basic token; the
password of a URL) is a secret only if it is hard to guess: its cost is the
cheapest way to put it together, found by dynamic programming over

* words of the corpus (3 to 24 letters in any case, with a few look-alike signs
  for letters), at the logarithm of their frequency rank,
* dates and years,
* repeats of a block of up to 16 characters, at the block and the count,
* walks over neighbouring keys and runs of the alphabet or digits, and
* brute force, character by character, for the rest,

plus the choice of a kind for every segment, all in bits. From ``MIN_BITS`` on a
value becomes a ``password`` span, unless a base span holds all of it.

One scan of the whole texts writes the spans with their values and partial
counts of all words outside these values (a secret in many copies makes no
word). Rank comes from a histogram of the counts in eighths of doublings, at
most some hundred rows; the words themselves are never gathered: the pieces of
the distinct values are joined with the word counts on the word, and the
segments found go back to their value. So nothing but the histogram reaches the
driver, hot values and words are reduced before they are shuffled, and every
word and every value counts.

Defined cases: null is an empty text without spans; repeated rows give the same
spans. What is plainly no value (``${..}``, ``<..>``, ``%..``, a call) is not
proposed. Offsets are code points, ends exclusive. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import staged

#: Guess cost, in bits, from which a value is a secret.
MIN_BITS = 30
#: Letters of a word, characters of a repeated block, and words that a task counts before it writes them.
SHORTEST, LONGEST, BLOCK, HELD = 3, 24, 16, 200_000

# Kinds in their order, and the patterns and least lengths of the base spans.
KINDS = ("assign", "access", "hex", "password")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_ASSIGNED = 8

# Contexts of the added spans; the value is the last group that matched.
_NAMED = re.compile(r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|auth|(?:api|access|private|client|signing|encryption)[ _-]?(?:key|secret|token))["']?[ \t]*(?:=>?|:=?)[ \t]*"""
                    r"""(?:"([^"\n]+)"|'([^'\n]+)'|([^\s"'`,;&<>()\[\]{}]++)(?![(\[{]))""", re.IGNORECASE | re.ASCII)
_SAID = re.compile(r"""\b(?:password|passphrase|passcode|pwd|pin)[ \t]+is[ \t]*:?[ \t]+["'`]?([^\s"'`,;]+)""", re.IGNORECASE | re.ASCII)
_BEARER = re.compile(r"\b(?:bearer|basic)[ \t]+([A-Za-z0-9._~+/=-]+)", re.IGNORECASE | re.ASCII)
_URL = re.compile(r"://[^\s:/@\"'<>]+:([^\s:/@\"'<>]+)@")
_CONTEXTS = ((_NAMED, ("pass", "pwd", "secret", "token", "credential", "auth", "key")), (_SAID, ("pass", "pwd", "pin")), (_BEARER, ("bearer", "basic")), (_URL, ("://",)))
_NO_VALUE = re.compile(r"\$[({\w]|\{\{|<|%[({\w]|\*+\Z|\.+\Z|x+\Z", re.IGNORECASE)
_WORD = re.compile(r"[^\W\d_]+")

# Words that configuration files hold in the place of a secret, most common first.
COMMON = ("password", "secret", "test", "example", "admin", "user", "default", "changeme", "token", "key", "pass", "your", "here", "none", "null", "true", "false", "demo",
          "sample", "dummy", "required", "optional", "string", "value", "config", "env", "environ", "process", "self", "this", "root", "login", "guest", "welcome",
          "letmein", "monkey", "dragon", "master", "hello", "love", "qwerty", "abc", "foo", "bar", "baz", "insert", "replace", "placeholder", "undefined", "hidden")
# Signs that stand for letters, and the rows of a keyboard.
_ALIKE = {"4": "a", "@": "a", "3": "e", "1": "i", "!": "i", "0": "o", "5": "s", "$": "s", "7": "t"}
_ROWS = ("`1234567890-=", " qwertyuiop[]\\", " asdfghjkl;'", " zxcvbnm,./")
_KEYS = {c: (r, k) for r, row in enumerate(_ROWS) for k, c in enumerate(row) if c != " "}
_NEIGHBOURS = {(0, 1), (0, -1), (1, 0), (1, -1), (-1, 0), (-1, 1)}
_DATES = tuple(re.compile(rf"(?=({p}))") for p in (
    r"(?:19|20)[0-9]{2}([-/._]?)(?:0[1-9]|1[0-2])\2(?:0[1-9]|[12][0-9]|3[01])", r"(?:0[1-9]|[12][0-9]|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)?[0-9]{2}",
    r"(?:0[1-9]|1[0-2])([-/._]?)(?:0[1-9]|[12][0-9]|3[01])\2(?:19|20)?[0-9]{2}", r"(?:19|20)[0-9]{2}"))
_DATE_BITS, _YEAR_BITS, _KIND_BITS = math.log2(366 * 120), math.log2(120), math.log2(5)


def _holds(low: str, names) -> bool:
    return any(n in low for n in names)


def base_spans(text: str, low: str) -> list[tuple[int, int, int, str]]:
    """(start, number of the kind, end, value) of the fixed patterns, by start, then kind. ``low``: the text in lower case."""
    out = []
    if _holds(low, ("passw", "secret", "token", "api")):
        out = [(m.start(), 0, m.end(), m.group(2)) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= LEAST_ASSIGNED]
    out += [(m.start(), 1, m.end(), m.group()) for m in _ACCESS.finditer(text)] if "AKIA" in text else []
    out += [(m.start(), 2, m.end(), m.group()) for m in _HEX.finditer(text)]
    return sorted(out)


def values(text: str, low: str, base: list) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of the values in credential contexts that no base span holds."""
    got = set()
    for pattern, names in _CONTEXTS:
        for m in pattern.finditer(text) if _holds(low, names) else ():
            s, e = m.span(m.lastindex)
            if pattern is _SAID or pattern is _NAMED and m.lastindex == 3:  # the end of a sentence is no part of it
                while e > s and text[e - 1] in ".:!?":
                    e -= 1
            if e > s and not _NO_VALUE.match(text, s, e):
                got.add((s, e))
    out, k, reach = [], 0, 0  # reach: the furthest end of the base spans that start before
    for s, e in sorted(got):
        while k < len(base) and base[k][0] <= s:
            reach = max(reach, base[k][2])
            k += 1
        if e > reach:
            out.append((s, 3, e, text[s:e]))
    return out


def pieces(value: str) -> list[tuple[int, int, str, float]]:
    """(start, length, word, bits) of the pieces of a value that can be words; bits are for the case and for signs in place of letters."""
    low = value.lower()
    if len(low) != len(value):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    plain = "".join(_ALIKE.get(c, c) for c in low)
    out = []
    for m in _WORD.finditer(plain):
        for s in range(m.start(), m.end() - SHORTEST + 1):
            alike = upper = 0
            for e in range(s, min(s + LONGEST, m.end())):
                alike += low[e] != plain[e]
                upper += value[e] != low[e]
                n = e - s + 1
                if n >= SHORTEST and 3 * alike <= n:
                    case = 0.0 if upper == 0 else 1.0 if upper == n - alike or (upper == 1 and value[s] != low[s]) else math.log2(sum(math.comb(n, k) for k in range(1, min(upper, n - upper) + 1)) + 1)
                    out.append((s, n, plain[s:e + 1], case + 2.0 * alike))
    return out


def _brute(c: str) -> float:
    return math.log2(10) if c in "0123456789" else math.log2(26) if c.isalpha() and c.isascii() else math.log2(33) if c.isascii() else math.log2(100)


def _walks(value: str) -> list[tuple[int, int, float]]:
    """(start, end, bits) of runs over neighbouring keys, and of the alphabet or digits up or down."""
    out, low, n = [], value.lower(), len(value)
    steps = [None] * max(0, n - 1)
    runs = [0] * max(0, n - 1)
    for i in range(n - 1):
        a, b = _KEYS.get(low[i]), _KEYS.get(low[i + 1:i + 2])
        if a and b and (b[0] - a[0], b[1] - a[1]) in _NEIGHBOURS:
            steps[i] = (b[0] - a[0], b[1] - a[1])
        x, y = low[i], low[i + 1:i + 2]
        if x.isascii() and y.isascii() and x.isalnum() and y.isalnum() and x.isdigit() == y.isdigit() and abs(ord(x) - ord(y)) == 1:
            runs[i] = ord(y) - ord(x)
    at = 0
    while at < n - 1:
        end, turns = at, 0
        while end < n - 1 and steps[end] is not None:
            turns += end > at and steps[end] != steps[end - 1]
            end += 1
        if end - at >= 3:
            out.append((at, end + 1, math.log2(47) + math.log2(end - at + 1) + (turns + 1) * math.log2(6)))
        at = max(end, at + 1)
    at = 0
    while at < n - 1:
        end = at
        while end < n - 1 and runs[end] and runs[end] == runs[at]:
            end += 1
        if end - at >= 2:
            out.append((at, end + 1, math.log2(36) + math.log2(end - at + 1) + 1))
        at = max(end, at + 1)
    return out


def _repeats(value: str, cost) -> list[tuple[int, int, float]]:
    """(start, end, bits) of whole repeats of a block, from the first and to the last place of each run."""
    out, n = [], len(value)
    for p in range(1, min(BLOCK, n // 2) + 1):
        at = 0
        while at + p < n:
            if value[at] != value[at + p]:
                at += 1
                continue
            end = at
            while end + p < n and value[end] == value[end + p]:
                end += 1
            whole = (end + p - at) // p * p
            if whole >= max(3, 2 * p):
                for s in {at, end + p - whole}:
                    out.append((s, s + whole, cost(s, p) + math.log2(whole // p)))
            at = end
    return out


def guess_bits(value: str, words: list[tuple[int, int, float]] = ()) -> float:
    """Bits of the cheapest segmentation; ``words``: (start, length, bits) of the pieces that are words."""
    brute = [_brute(c) for c in value]
    known = {}
    for s, n, bits in words:
        known[s, n] = min(bits, known.get((s, n), bits))
    segments = [(s, s + n, bits) for (s, n), bits in known.items()]
    for k, pattern in enumerate(_DATES):
        segments += [(*m.span(1), _YEAR_BITS if k == 3 else _DATE_BITS + bool(m.group(2))) for m in pattern.finditer(value)]
    segments += _walks(value)
    segments += _repeats(value, lambda s, p: min(sum(brute[s:s + p]), known.get((s, p), math.inf)))
    by_end: dict[int, list] = {}
    for s, e, bits in segments:
        by_end.setdefault(e, []).append((s, bits))
    best, inside = [0.0], math.inf  # of all ways to the place, and of those that end in brute force
    for e in range(1, len(value) + 1):
        inside = min(best[e - 1] + _KIND_BITS, inside) + brute[e - 1]
        best.append(min([inside, *(best[s] + _KIND_BITS + bits for s, bits in by_end.get(e, ()))]))
    return best[-1]


FOUND = "spans array<struct<start: bigint, kind: int, end: bigint, value: string>>, word string, n bigint"


def _scan(docs: DataFrame, text: str, row_id: str) -> DataFrame:
    """A row (id, spans) per document, and rows (word, n) of partial word counts."""

    def run(batches):
        from collections import Counter

        import pyarrow as pa

        spans_kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("value", pa.string())]))
        names, words, id_kind = ["id", "spans", "word", "n"], Counter(), None

        def written():
            got = [(w, c) for w, c in words.items() if SHORTEST <= len(w) <= LONGEST]
            words.clear()
            for at in range(0, len(got), 10_000):
                part = got[at:at + 10_000]
                none = pa.nulls(len(part), spans_kind)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(part), id_kind), none, pa.array([w for w, _ in part], pa.string()), pa.array([c for _, c in part], pa.int64())], names)

        for b in batches:
            id_kind, out = b.column("id").type, []
            for t in b.column("text").to_pylist():
                low = t.lower() if t else ""
                base = base_spans(t, low) if t else []
                added = values(t, low, base) if t else []
                out.append([dict(zip(("start", "kind", "end", "value"), x, strict=True)) for x in (*base, *added)])
                at = 0
                for s, e in sorted({(x[2] - len(x[3]) if x[1] == 0 else x[0], x[2]) for x in (*base, *added)}):
                    if s > at:
                        words.update(_WORD.findall(t[at:s].lower()))
                    at = max(at, e)
                if t:
                    words.update(_WORD.findall(t[at:].lower() if at else low))
                if len(words) > HELD:
                    yield from written()
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, spans_kind), pa.nulls(len(out), pa.string()), pa.nulls(len(out), pa.int64())], names)
        if words:
            yield from written()

    kind = docs.schema[row_id].dataType.simpleString()
    return docs.select(F.col(row_id).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, {FOUND}")


def _rank_bits(words: DataFrame) -> list[float]:
    """For each eighth of a doubling of a count, the logarithm of how many words have that count or a higher one."""
    got = {r.band: r.c for r in words.groupBy(_band().alias("band")).agg(F.count(F.lit(1)).alias("c")).collect()}  # at most 512
    out, above = [0.0] * (max(got, default=0) + 1), 0
    for band in range(len(out) - 1, -1, -1):
        above += got.get(band, 0)
        out[band] = math.log2(max(1, above + len(COMMON)))
    return out


def _band():
    return F.floor(8 * F.log2("n")).cast("int")


def rate(values_: DataFrame, words: DataFrame) -> DataFrame:
    """(value, bits) of distinct values; ``words``: (word, n) of the corpus."""
    bits = F.array(*(F.lit(x) for x in _rank_bits(words)))
    values_ = staged(values_.withColumn("vid", F.monotonically_increasing_id()))

    def cut(batches):
        import pyarrow as pa

        for b in batches:
            for vid, value in zip(b.column("vid").to_pylist(), b.column("value").to_pylist(), strict=True):
                got = pieces(value)
                for at in range(0, len(got), 50_000):
                    part = list(zip(*got[at:at + 50_000], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array([vid] * len(part[0]), pa.int64()), *(pa.array(x) for x in part)], ["vid", "start", "length", "word", "extra"])

    cuts = staged(values_.mapInArrow(cut, "vid bigint, start bigint, length bigint, word string, extra double"))
    known = words.join(cuts.select("word").distinct(), "word").select("word", F.element_at(bits, _band() + 1).alias("rank_bits"))
    found = (cuts.join(known, "word").groupBy("vid")
             .agg(F.collect_list(F.struct("start", "length", (F.col("rank_bits") + F.col("extra")).alias("bits"))).alias("words")))  # a value's own pieces

    def solve(batches):
        import pyarrow as pa

        common = {w: math.log2(k + 2) for k, w in enumerate(COMMON)}
        for b in batches:
            out = []
            for value, words_ in zip(b.column("value").to_pylist(), b.column("words").to_pylist(), strict=True):
                segments = [(w["start"], w["length"], w["bits"]) for w in words_ or ()]
                segments += [(s, n, common[w] + extra) for s, n, w, extra in pieces(value) if w in common]
                out.append(guess_bits(value, sorted(segments)))
            yield pa.RecordBatch.from_arrays([b.column("value"), pa.array(out, pa.float64())], ["value", "bits"])

    return values_.join(found, "vid", "left").select("value", "words").mapInArrow(solve, "value string, bits double")


def scan(docs: DataFrame, text: str = "text", row_id: str = "doc_id", min_bits: float = MIN_BITS) -> DataFrame:
    """(id, secret_spans): per document the spans (kind, start, end, base, bits) by start, then kind; ``bits`` is the
    guess cost of the span's value."""
    found = staged(_scan(docs, text, row_id).withColumn("rid", F.monotonically_increasing_id()))
    words = staged(found.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n")))
    rows = found.where("word IS NULL").select("rid", "id", "spans")
    held = staged(rows.where(F.size("spans") > 0).select("rid", "id", F.explode("spans").alias("s")).select("rid", "id", "s.*"))
    rated = staged(rate(held.select("value").distinct(), words))
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    spans = (held.join(rated, "value").where((F.col("kind") < len(KINDS) - 1) | (F.col("bits") >= min_bits))
             .groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", F.col("kind").alias("no"), "end", kind.alias("kind"), "bits"))).alias("got")))
    out = rows.select("rid", "id").join(spans, "rid", "left")
    told = F.transform(F.coalesce("got", F.array()), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
                                                                       (s["no"] < len(KINDS) - 1).alias("base"), s["bits"].alias("bits")))
    return out.select(F.col("id").alias(row_id), told.alias("secret_spans"))
