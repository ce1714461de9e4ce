"""PII detection and rewriting as native column expressions (X1-X11, O1, U1,
P4, P5).

No Python runs per row: every family is a ``regexp_extract_all`` whose match
offsets come from the lengths of the ``split`` pieces between matches (the
same matcher walks the text in both calls). A cheap guard skips the scan for
texts that cannot contain the family (no '@', no digit, no key prefix).
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.sources import dims

# ---------------------------------------------------------------------------
# Detection patterns, in detection order. They must stay equal
# to the governed proxy's patterns for identical findings.
# ---------------------------------------------------------------------------
PATTERNS = [
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"),
    ("phone", r"(\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b|\b\d{3}[-.\s]\d{3}[-.\s]\d{4}\b"),
    ("ssn", r"\b\d{3}-\d{2}-\d{4}\b|\b\d{9}\b"),
    ("credit_card", r"\b(?:\d[ -]*?){13,19}\b"),
    ("ip_address", r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"),
    ("api_key", r"\b(sk-[a-zA-Z0-9]{48}|pk_[a-zA-Z0-9]{32}|Bearer\s+[a-zA-Z0-9\-_\.]+)\b"),
    ("aws_key", r"\b(AKIA[0-9A-Z]{16}|aws_access_key_id\s*=\s*[A-Z0-9]{20})\b"),
]
# Replacement text per type for the redact action (email and card are built
# from the match, see _redaction).
REDACTION_TOKENS = {
    "phone": "[PHONE]", "ssn": "[SSN]", "api_key": "[API_KEY]", "aws_key": "[AWS_KEY]",
    "person_name": "[NAME]", "ip_address": "[IP_ADDRESS]",
}
EMAIL_MASK_SUFFIX = "***@***.***"
CARD_MASK_PREFIX = "****-****-****-"
REDACTED_REPORT_TEXT = "[REDACTED]"
# ---------------------------------------------------------------------------

PATTERN_OF = dict(PATTERNS)
_PLAIN = re.compile(r"^Column<'[A-Za-z_][A-Za-z0-9_]*'>$")
_MEMO: dict = {}


def _memo(fn):
    """Builds each expression tree once per process for plain column
    references (building one costs thousands of py4j calls); expressions on
    lambda variables are always rebuilt."""

    def wrapper(*args, **kwargs):
        cols = [a for a in args if isinstance(a, Column)]
        if not cols or not all(_PLAIN.match(str(c)) for c in cols):
            return fn(*args, **kwargs)
        from pyspark import SparkContext

        key = (id(SparkContext._active_spark_context), fn.__name__,
               tuple(str(a) if isinstance(a, Column) else repr(a) for a in args),
               tuple(sorted((k, repr(v)) for k, v in kwargs.items())))
        if key not in _MEMO:
            _MEMO[key] = fn(*args, **kwargs)
        return _MEMO[key]

    wrapper.__name__ = fn.__name__
    wrapper.__doc__ = fn.__doc__
    return wrapper
NAME_ALTERNATION = "|".join(dims.COMMON_NAMES)
# Java needs (?U) so \d \w \b \s are Unicode-aware, as in the original.
JAVA_FLAGS = "(?U)"

FINDING = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()),
])
FINDINGS = T.ArrayType(FINDING)


def _empty() -> Column:
    return F.array().cast(FINDINGS)


def _guard(text: Column, kind: str) -> Column:
    if kind == "email":
        return text.contains("@")
    if kind in ("phone", "ssn", "credit_card", "ip_address"):
        return text.rlike("(?U)\\d")
    if kind == "api_key":
        return text.contains("sk-") | text.contains("pk_") | text.contains("Bearer")
    if kind == "aws_key":
        return text.contains("AKIA") | text.contains("aws_access_key_id")
    return F.lit(True)


#: Elements appended one by one before their array is appended as a whole.
RUN = 128


def _fold(items: Column, init: Column, step) -> Column:
    """The findings that a walk over ``items`` emits, in linear time: ``step(state, item)`` gives the next state and
    an array of what it emits. An array is copied when one is appended to it, so emitted findings are gathered in
    runs of ``RUN`` items, and the runs are put together at the end. (What a lambda uses more than once is boxed
    into a struct, as an outer expression would be evaluated for every element.)"""
    none = F.array().cast(T.ArrayType(FINDINGS))

    def run(s, state, b):
        def one(c, x):
            nxt, emitted = step(c["s"], x)
            return F.struct(nxt.alias("s"), F.concat(c["out"], emitted).alias("out"))
        return F.aggregate(F.slice(s["x"], b * RUN + 1, F.lit(RUN)), F.struct(state.alias("s"), _empty().alias("out")), one)

    def walk(s):
        def whole(a, b):
            return F.get(F.transform(F.array(run(s, a["s"], b)), lambda z: F.struct(
                z["s"].alias("s"), F.concat(a["out"], F.array(z["out"])).alias("out"))), F.lit(0))
        runs = F.aggregate(F.sequence(F.lit(0), F.floor((F.size(s["x"]) - 1) / RUN).cast("int")), F.struct(init.alias("s"), none.alias("out")), whole, lambda a: a["out"])
        return F.when(F.size(s["x"]) <= 0, _empty()).otherwise(F.flatten(runs))

    return F.get(F.transform(F.array(F.struct(items.alias("x"))), walk), F.lit(0))


def find_spans(text: Column, pattern: str | Column, kind: str) -> Column:
    """Every non-overlapping match of ``pattern`` with half-open
    code-point offsets, as ARRAY<STRUCT<type, text, start, end>>.

    Match i starts after pieces 0..i and matches 0..i-1. Matches and pieces
    are zipped and walked once, in time linear in the text and its matches."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    pieces = F.split(text, pattern, -1)
    zipped = F.arrays_zip(matches.alias("m"), pieces.alias("p"))

    def step(at, z):
        start = at + F.length(z["p"])
        end = start + F.length(z["m"])
        span = F.struct(F.lit(kind).alias("type"), z["m"].alias("text"), start.cast("int").alias("start"), end.cast("int").alias("end"))
        return F.coalesce(end, at), F.when(z["m"].isNull(), _empty()).otherwise(F.array(span))

    return _fold(zipped, F.lit(0), step)


def detect_family(text: Column, kind: str) -> Column:
    """X1-X7 with the family's cheap guard."""
    pat = JAVA_FLAGS + PATTERN_OF[kind]
    return F.when(text.isNull(), _empty()).when(_guard(text, kind), find_spans(text, pat, kind)) \
            .otherwise(_empty())


# White space between name tokens, as the original splits text (the information separators included).
_TOKEN_SPACE = "[\\s\\x1c-\\x1f]"
_ANY = "[^a-z\\s]*+"


def _spelled() -> str:
    """A cheap guard: after white space, some name's letters in a row with anything but letters and spaces
    between them (a superset of the tokens that count)."""
    by_first: dict[str, list[str]] = {}
    for name in dims.COMMON_NAMES:
        by_first.setdefault(name[0], []).append(_ANY.join(name[1:]))
    return f"[\\s\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u3000]{_ANY}(?:" + "|".join(
        f"{first}{_ANY}(?:{'|'.join(rest)})" for first, rest in sorted(by_first.items())) + ")(?![a-z])"


def detect_names(text: Column, repeats: bool = False) -> Column:
    """A white-space token whose word characters alone make a listed name
    is searched, punctuation and all, as a whole word in the text, ignoring
    case. Each distinct token is searched once; ``repeats`` searches it once
    per time it occurs, as the original does (D2)."""
    guard = F.concat(F.lit(" "), F.lower(text)).rlike(_spelled())
    tokens = F.filter(F.split(F.lower(text), f"(?U){_TOKEN_SPACE}+"),
                      lambda w: F.regexp_replace(w, "(?U)[^\\w]", "").isin(dims.COMMON_NAMES))
    tokens = tokens if repeats else F.array_distinct(tokens)
    quoted = lambda w: F.concat(F.lit("(?iU)\\b\\Q"), F.replace(w, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E\\b"))
    found = F.flatten(F.transform(tokens, lambda w: find_spans(text, quoted(w), "person_name")))
    return F.when(text.isNull(), _empty()).when(guard, found).otherwise(_empty())


def sort_findings(findings: Column) -> Column:
    """O1: by start; ties keep the order of detection."""
    keyed = F.transform(findings, lambda f, i: F.struct(f["start"].alias("s"), i.alias("i"), f.alias("f")))
    return F.transform(F.array_sort(keyed), lambda k: k["f"])


@_memo
def detect(text: Column, families: list[str] | None = None, repeats: bool = False) -> Column:
    """U1 + O1: all families (and names) unioned and sorted. ``families``
    limits the search to the types that a policy asks for (P4)."""
    kinds = [k for k in dims.PII_TYPES if not families or k in families]
    parts = [detect_family(text, k) if k != "person_name" else detect_names(text, repeats) for k in kinds]
    return sort_findings(F.concat(*parts)) if parts else _empty()


def filter_entities(findings: Column, entities: Column | list[str] | None) -> Column:
    """Keep listed types; an empty or missing list keeps everything."""
    if entities is None:
        return findings
    ent = F.array(*[F.lit(e) for e in entities]) if isinstance(entities, list) else entities
    if isinstance(entities, list) and not entities:
        return findings
    return F.when(F.coalesce(F.size(ent), F.lit(0)) <= 0, findings) \
            .otherwise(F.filter(findings, lambda f: F.array_contains(ent, f["type"])))


def report(findings: Column, location: Column, action: Column | str) -> Column:
    """M5 + P5: report entries; raw text only for the warn action."""
    act = F.lit(action) if isinstance(action, str) else action
    return F.transform(findings, lambda f: F.struct(
        location.alias("location"), f["type"].alias("type"),
        F.when(act == "warn", f["text"]).otherwise(F.lit(REDACTED_REPORT_TEXT)).alias("text"),
        F.struct(f["start"].alias("start"), f["end"].alias("end")).alias("position")))


def _redaction(f: Column) -> Column:
    t, x = f["type"], f["text"]
    email = F.concat(F.substring(F.substring_index(x, "@", 1), 1, 2), F.lit(EMAIL_MASK_SUFFIX))
    digits = F.regexp_replace(x, "(?U)\\D", "")
    card = F.when(F.length(digits) >= 4,
                  F.concat(F.lit(CARD_MASK_PREFIX), F.substring(digits, -4, 4))
                  ).otherwise(F.lit("[CREDIT_CARD]"))
    out = F.when(t == "email", email).when(t == "credit_card", card)
    for k, v in REDACTION_TOKENS.items():
        out = out.when(t == k, F.lit(v))
    return out.otherwise(F.concat(F.lit("["), F.upper(t), F.lit("]")))


def _hashed(f: Column) -> Column:
    return F.concat(F.lit("["), f["type"], F.lit(":"), F.substring(F.sha2(f["text"], 256), 1, 8),
                    F.lit("]"))


def merge_overlaps(findings: Column) -> Column:
    """Non-overlapping subset, leftmost first, longest at a tie, then by
    detection order; a finding overlapping an already kept one is dropped."""
    keyed = F.array_sort(F.transform(findings, lambda f: F.struct(
        f["start"].alias("s"), (-f["end"]).alias("ne"), dims.pii_type_rank(f["type"]).alias("r"),
        f.alias("f"))))
    fits = lambda last, k: k["s"] >= last
    return _fold(keyed, F.lit(-1), lambda last, k: (
        F.when(fits(last, k), k["f"]["end"]).otherwise(last), F.when(fits(last, k), F.array(k["f"])).otherwise(_empty())))


def _splice(text: Column, findings: Column, repl) -> Column:
    """Replaces sorted, non-overlapping spans: each replacement with the gap
    before it, joined once. Gaps are cut from four-byte characters, so that a
    cut does not walk the text from its start: linear in text and findings.
    (The struct makes lambda variables of both, which are evaluated once.)"""
    wide = F.array(F.struct(F.encode(text, "UTF-32").alias("u"), findings.alias("k")))
    cut = lambda u, a, b: F.decode(F.substring(u, 4 * a + 1, 4 * (b - a)), "UTF-32")

    def pieces(s):
        n = F.size(s["k"])
        before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(s["k"], i - 1)["end"])
        runs = F.transform(s["k"], lambda f, i: F.concat(cut(s["u"], before(i), f["start"]), repl(f)))
        last = F.when(n == 0, F.lit(0)).otherwise(F.get(s["k"], n - 1)["end"])
        return F.concat(F.array_join(runs, ""), cut(s["u"], last, (F.octet_length(s["u"]) / 4).cast("int")))

    return F.get(F.transform(wide, pieces), F.lit(0))


def _splice_reference(text: Column, findings: Column, repl) -> Column:
    """The original right-to-left splice over every finding, stale offsets and
    all (overlaps corrupt the text exactly as the original does)."""
    return F.aggregate(F.reverse(findings), text, lambda a, f: F.concat(
        F.substring(a, 1, f["start"]), repl(f),
        F.when(F.length(a) > f["end"], F.substring(a, f["end"] + 1, 1 << 30)).otherwise(F.lit(""))))


@_memo
def redact_text(text: Column, findings: Column, overlap: str = "merge") -> Column:
    """X10."""
    if overlap == "reference":
        return F.when(F.size(findings) == 0, text).otherwise(_splice_reference(text, findings, _redaction))
    return F.when(F.size(findings) == 0, text).otherwise(_splice(text, merge_overlaps(findings), _redaction))


@_memo
def hash_text(text: Column, findings: Column, overlap: str = "merge") -> Column:
    """X11."""
    if overlap == "reference":
        return F.when(F.size(findings) == 0, text).otherwise(_splice_reference(text, findings, _hashed))
    return F.when(F.size(findings) == 0, text).otherwise(_splice(text, merge_overlaps(findings), _hashed))


def apply_action(text: Column, findings: Column, action: Column | str, overlap: str = "merge") -> Column:
    """Rewrites content per action: redact, hash, or unchanged (warn/block).
    A literal action builds only its own branch."""
    if isinstance(action, str):
        if action == "redact":
            return redact_text(text, findings, overlap)
        if action == "hash":
            return hash_text(text, findings, overlap)
        return text
    act = action
    return (F.when(act == "redact", redact_text(text, findings, overlap))
             .when(act == "hash", hash_text(text, findings, overlap))
             .otherwise(text))
