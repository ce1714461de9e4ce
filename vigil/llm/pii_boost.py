"""Personal data by high-recall candidates and boosted trees.

The base spans (email, ip, card, phone) follow fixed patterns and checks and are
always kept. Generators propose further, overlapping spans: around every digit
and every ``@`` address-like words, number runs, dotted numbers and long tokens; and
assigned values, quoted words, addresses with "at" written out, IPv6 forms and runs of 20 capitals. Each candidate gets format features (lengths,
character classes, groups, entropy) and context features (the characters and key
words around it). One boosted tree model per kind is fitted on the distinct
candidates of all rows with labels by rule: a candidate that is a base span has
its kind; one with the form of an access key, a value assigned to a secret's name
(quoted or after ``=`` of any form, else with a digit or symbol) or a mixed token assigned to
a weaker name is a ``secret``; a near form that follows a key word of its kind (or is plain by
itself: "[at]", IPv6) has that kind; others are none. One of none inside one of a kind is a
part: the fit takes it as an example against every kind, the calibration as neither right nor wrong,
as of overlapping spans the better is taken anyway. All of them fit the trees. Each half (by hash) is
also scored by trees of the other half alone, which gives a threshold per kind, the lowest of at least
0.5 that reaches ``PRECISION`` over both (no threshold, no span). Accepted candidates that touch no
base span and no better candidate are added.

Defined cases: null is an empty text without spans; without any candidate
in any row only base spans are found; repeated rows give the same spans.
Offsets are code points, ends exclusive. Columns named like an added one are
replaced.
"""

from __future__ import annotations

import logging
import math
import re
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.llm.boosting import BINS, Boosted, LocalSums, SparkSums, grow, whole_scale
from vigil.llm.common import cached, staged, with_columns

#: What a label (a kind, or none) weighs in the fit at most, in candidates; all of them take part, each for less.
LABEL_WEIGHT = 10_000
#: Distinct binned candidates up to which the driver sums gradients itself; more are summed by Spark jobs, with the same trees.
LOCAL_ROWS = 65_536
#: Least precision of the calibration half, and least examples of a kind in either half.
PRECISION, LEAST = 0.99, 10
LOG = logging.getLogger(__name__)

# The kinds in their order, and the patterns and limits of the base spans.
KINDS = ("email", "ip", "card", "phone", "secret")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_MARK = re.compile(r"[0-9@]")
_RUN = re.compile(r"[+(]?[0-9][0-9 ().-]{5,}[0-9]")
_DOTTED = re.compile(r"(?<![0-9.])[0-9]++(?:\.[0-9]++){2,}")
_TOKEN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")
_ADDRESS = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:[\[({] ?at ?[\])}]| at ) ?[A-Za-z0-9-]++(?: ?(?:[\[({] ?dot ?[\])}]| dot |\.) ?[A-Za-z0-9-]++)++", re.IGNORECASE)
_IPV6 = re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:])")
_VALUE = re.compile(r"""(?<=[\w\])])\\?["']?[ \t]*+(?:=>?|:=?)[ \t]*+(?:"((?:[^"\\\n]|\\.)++)"|'((?:[^'\\\n]|\\.)++)'|\\["']([^"'\\\n]++)|([^\s"'\\,;&<>()\[\]{}]++))""")
_QUOTED = re.compile(r"""(?<!\w)(["'`])((?:(?!\1)\S)++)\1(?!\w)""")
_MAILBOX = re.compile(r"[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]++")
_NUMBER = re.compile(r"[+(]?[0-9][0-9 ().-]*")
_LETTERS = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Z]{20}(?![A-Za-z0-9+/_-])")
_KEY = re.compile(r"(?:AKIA|ASIA)[0-9A-Z]{16}\Z")
_NAMES = ("pass", "pwd", "token", "secret", "key", "mail", "phone", "tel", "card", "addr", "version", "license")
_ASSIGNED = re.compile(r"(?:password|passwd|pwd|token|secret|key)[\"']?\s*[=:]\s*[\"']?\Z", re.IGNORECASE)
# Weak rules on the text before a span: names that always hold secrets, and key words of the other kinds.
_STRONG = re.compile(r"""(?:pass(?:word|wd|phrase|code)|pwd|secret|(?:api|access|private|auth)[ _-]?(?:key|token))\\?["']?\s*(=>?|:=?|\bis\b)\s*(\\?["'`])?\Z""", re.IGNORECASE)
_SAID = r"""[a-z]{0,6}\.?\\?["']?\s*(?:(?:no\.?|number|is|at|me)\s*)?(?:[=:#]\s*)?\\?["'(<]?\Z"""
_MAIL_WORD, _IP_WORD, _CARD_WORD, _PHONE_WORD = (re.compile(rf"\b(?:{w}){_SAID}", re.IGNORECASE) for w in (
    "e-?mail|mail|contact|write to", "ip|ipv6|host|addr|client|server", "card|visa|mastercard|amex|cc|pan", "tel|phone|telephone|mobile|cell|call|fax|sms"))
# Weak negatives: what stands for a value in code and templates, words with a mark at the end, and dates.
_PLACEHOLDER = re.compile(r"%[a-z(]|\$[\w{(]|\{|<|[A-Za-z_]+(?:(?:\.|::|->)[A-Za-z_]+)+\Z|[A-Za-z]+[!?.,;:*]*\Z|[*x.•-]+\Z", re.IGNORECASE)
_DATE = re.compile(r"(?:[0-9]{4}[-./][0-9]{1,2}[-./][0-9]{1,2}|[0-9]{1,2}[-./][0-9]{1,2}[-./](?:[0-9]{2}|[0-9]{4}))\Z")
_NONE = frozenset(("null", "none", "nil", "true", "false", "undefined"))

#: The label of a candidate of no kind inside one of a kind.
PART = 1 + len(KINDS)

SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
                     T.StructField("base", T.BooleanType()), T.StructField("score", T.DoubleType())])
ADDED = T.StructType([T.StructField("pii_spans", T.ArrayType(SPAN)), T.StructField("redacted_text", T.StringType())])


def luhn(digits: str) -> bool:
    odd = [ord(c) - 48 for c in digits[::-1]]
    return (sum(odd[::2]) + sum((2 * d) // 10 + (2 * d) % 10 for d in odd[1::2])) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, by start, then kind."""
    out = []
    if "@" in text:
        free = 0  # where the previous match of this kind ended
        for m in _DOMAIN.finditer(text):
            s = m.start()
            while s > free and text[s - 1] in _LOCAL:
                s -= 1
            if s < m.start():
                out.append((s, 0, m.end()))
                free = m.end()
    for m in _IP.finditer(text):
        if all(int(x[-4:]) <= 255 and len(x.lstrip("0")) <= 3 for x in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            d = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() and c.isascii() for c in m.group()) <= 15:
                out.append((m.start(), 3, m.end()))
    return [(KINDS[k], s, e) for s, k, e in sorted(out)]


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, end, generator) of proposed spans; they may overlap."""
    out = set()
    words = tokens = 0  # where the last word with an @ and the last token ended: a token may lie in such a word
    n = len(text)
    for m in _MARK.finditer(text):
        at = m.start()
        s, e = at, at + 1  # the word around the mark, or the token
        if text[at] == "@":
            if at < words:
                continue
            while s and not text[s - 1].isspace():
                s -= 1
            while e < n and not text[e].isspace():
                e += 1
            a, b = s, e
            while a < b and text[a] in "\"'(<[{,;:":
                a += 1
            while b > a and text[b - 1] in "\"')>]},;:.!?":
                b -= 1
            if b - a >= 6:
                out.add((a, b, 0))
            words = e
        elif at >= tokens:
            while s and text[s - 1] in _TOKEN:
                s -= 1
            while e < n and text[e] in _TOKEN:
                e += 1
            if e - s >= 12:
                out.add((s, e, 1))
            tokens = e
    if words or tokens:
        for gen, pattern in ((2, _RUN), (3, _DOTTED), (4, _CARD)):
            for m in pattern.finditer(text):
                if m.end() - m.start() >= 7:
                    out.add((m.start(), m.end(), gen))
    if "=" in text or ":" in text:
        for m in _VALUE.finditer(text):
            s, e = m.span(m.lastindex)
            if m.lastindex == 4:  # without quotes: the end of a sentence is no part of it
                while e > s and text[e - 1] in ".:":
                    e -= 1
            if e > s:
                out.add((s, e, 5))
    if '"' in text or "'" in text or "`" in text:
        out.update((*m.span(2), 6) for m in _QUOTED.finditer(text))
    if ":" in text:
        out.update((*m.span(), 7) for m in _IPV6.finditer(text))
    if "at" in text or "AT" in text or "At" in text:
        out.update((*m.span(), 8) for m in _ADDRESS.finditer(text))
    out.update((*m.span(), 9) for m in _LETTERS.finditer(text))
    return sorted(out)


def features(text: str, s: int, e: int, gen: int) -> list[float]:
    x, before, after = text[s:e], text[max(0, s - 24):s], text[e:e + 12]
    n = e - s
    digits, upper, lower = (sum(f(c) for c in x) for f in (str.isdigit, str.isupper, str.islower))
    groups = re.findall(r"[0-9]+", x)
    switches = sum(a.isdigit() != b.isdigit() for a, b in zip(x, x[1:], strict=False))
    counts = [x.count(c) / n for c in set(x)]
    low = before.lower()
    prev, nxt = before[-1:], after[:1]
    return [n, digits, upper, lower, x.count("."), x.count(" "), x.count("-"), x.count("@"), x.count("+"), x.count("(") + x.count(")"),
            digits / n, upper / n, len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0),
            max((int(g[:9]) for g in groups), default=0), switches, -sum(p * math.log2(p) for p in counts),
            all(c in "0123456789abcdefABCDEF" for c in x), x[:1] == "+", x.rpartition("@")[2].count("."),
            n - digits - upper - lower, any(c.isspace() for c in x), x.count(":"), "::" in x, x.lower() in _NONE, float(_KEY.match(x) is not None),
            float(_at_end(text, e)), float(_PLACEHOLDER.match(x) is not None), float(_DATE.match(x) is not None), float(sum(map(len, groups))), *_named(before),
            float(gen), *(float(w in low) for w in _NAMES), prev.isspace(), prev in ("\"", "'"), prev in ("=", ":"), prev.isalnum(),
            nxt.isspace(), nxt in ("\"", "'"), nxt in (".", ","), nxt.isalnum(), "=" in before[-4:] or ":" in before[-4:]]


def _at_end(text: str, e: int) -> bool:
    """Whether a value ends here, so that a span is no mere front part of one."""
    rest = text[e:e + 2]
    return not rest or rest[0].isspace() or rest[0] in "\"'`\\,;&<>()[]{}" or (rest[0] in ".:" and (len(rest) == 1 or rest[1].isspace()))


def _named(before: str) -> list[float]:
    """What the text just before a span says: a secret's name (2: one in quotes or after a bare =), an assigned name, and the other kinds' words."""
    strong = _STRONG.search(before)
    return [0.0 if strong is None else 2.0 if strong.group(2) or strong.group(1) == "=" else 1.0, float(_ASSIGNED.search(before) is not None),
            *(float(w.search(before) is not None) for w in (_MAIL_WORD, _IP_WORD, _CARD_WORD, _PHONE_WORD))]


def rule_kind(text: str, s: int, e: int, base: dict[tuple[int, int], str]) -> int:
    """The label of a candidate: 1 + the number of its kind, 0 for none."""
    kind = base.get((s, e))
    if kind is not None:
        return 1 + KINDS.index(kind)
    x = text[s:e]
    if _KEY.match(x):
        return 1 + KINDS.index("secret")
    before = text[max(0, s - 24):s]
    strong, assigned, mail, ip, card, phone = _named(before)
    digits, has_letter = sum(c.isdigit() for c in x), any(c.isalpha() for c in x)
    plain = _PLACEHOLDER.match(x) is not None and not (strong == 2 and e - s >= 12 and x.isalnum())  # a long quoted run of letters can be a key
    if _at_end(text, e) and x.lower() not in _NONE and not plain and not _DATE.match(x) and (
            (strong == 2 and (has_letter or digits)) or (strong and has_letter and (digits or any(not c.isalnum() and not c.isspace() for c in x)))
            or (assigned and digits and has_letter and e - s >= 12)):
        return 1 + KINDS.index("secret")
    if s and (text[s - 1].isalnum() or text[s - 1] in "+.") or e < len(text) and text[e].isalnum():
        return 0  # part of something longer
    if _ADDRESS.fullmatch(x) and (mail or any(c in "[({" for c in x)) or (mail and _MAILBOX.fullmatch(x)):
        return 1 + KINDS.index("email")
    if _IPV6.fullmatch(x) and digits and (x.count(":") == 7 or ("::" in x and x.count("::") == 1 and sum(c.isalnum() for c in x) >= 2) or (ip and x.count(":") > 3)):
        return 1 + KINDS.index("ip")
    if card and 13 <= digits <= 19 and _CARD.fullmatch(x):
        return 1 + KINDS.index("card")
    return 1 + KINDS.index("phone") if phone and 7 <= digits <= 15 and _NUMBER.fullmatch(x) and not _DATE.match(x.strip()) else 0


def _codes(x):
    """Ascending 16-bit codes of features (none is negative): single precision cut to 8 significant bits."""
    import numpy as np

    return (np.abs(np.asarray(x, dtype="<f4")).view("<u4") >> 16).astype("<u2")


def _lowest(codes):
    """The least feature value of each code."""
    import numpy as np

    return (np.asarray(codes).astype("<u4") << 16).view("<f4").astype(float)


def _labels(text: str, found) -> list[int]:
    """The labels of a text's candidates (by start)."""
    from bisect import bisect_right
    from itertools import accumulate

    base = {(s, e): k for k, s, e in base_spans(text)} if found else {}
    labels = [rule_kind(text, s, e, base) for s, e, _ in found]
    starts = [s for (s, _, _), y in zip(found, labels, strict=True) if y]
    ends = list(accumulate((e for (_, e, _), y in zip(found, labels, strict=True) if y), max))
    for i, (s, e, _) in enumerate(found):
        at = bisect_right(starts, s) if not labels[i] else 0
        if at and ends[at - 1] >= e:
            labels[i] = PART
    return labels


def _propose(batches):
    """Every candidate: its label, a hash of its form with the text around it, and its features' codes."""
    from hashlib import blake2b

    import numpy as np
    import pyarrow as pa

    def rows(ys, hs, xs):
        return pa.RecordBatch.from_arrays([pa.array(ys, pa.int32()), pa.array(hs, pa.int64()), pa.array([c.tobytes() for c in _codes(np.array(xs))], pa.binary())], ["y", "h", "x"])

    out: tuple[list, list, list] = ([], [], [])
    for batch in batches:
        for t in batch.column(0).to_pylist():
            found = candidates(t) if t else ()
            for (s, e, gen), y in zip(found, _labels(t, found), strict=True):
                around = f"{gen} {e - s} {min(s, 24)} {t[max(0, s - 24):e + 12]}"
                h = int.from_bytes(blake2b(around.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)
                for column, value in zip(out, (y, h, features(t, s, e, gen)), strict=True):
                    column.append(value)
                if len(out[0]) == 4096:
                    yield rows(*out)
                    out = ([], [], [])
    if out[0]:
        yield rows(*out)


def _matrix(column, kind: str):
    import numpy as np

    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _histogram(batches):
    """How often each (label, feature, code) occurs: key = (label * 256 + feature) * 65536 + code."""
    import numpy as np
    import pyarrow as pa

    for b in batches:
        if b.num_rows:
            x = _matrix(b.column("x"), "<u2").astype(np.int64)
            key, n = np.unique((b.column("y").to_numpy()[:, None].astype(np.int64) * 256 + np.arange(x.shape[1])) * 65536 + x, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["key", "n"])


def _cuts(codes, weights) -> list:
    """Up to BINS - 1 of the ascending codes: the weighted quantiles, without the greatest code."""
    import numpy as np

    total = np.cumsum(weights)
    at = np.searchsorted(total, total[-1] * np.arange(1, BINS) / BINS)
    return [int(c) for c in np.unique(codes[np.minimum(at, len(codes) - 1)]) if c < codes[-1]]


def fit(docs: DataFrame, text: str = "text", sample_candidates: int = LABEL_WEIGHT, local_rows: int = LOCAL_ROWS, rounds: int = 40) -> dict:
    """kind -> (trees, threshold), from the distinct candidates (with the text around them) of all rows. A label with
    more than ``sample_candidates`` of them weighs no more than so many when trees are fitted; each is used, and the
    thresholds count each fully. A kind with too few examples, or no precise threshold, is logged as a warning.

    Spark finds and counts the candidates, the features' quantiles, the distinct binned candidates, the trees' sums
    and the precision at each score; the driver holds sums, and binned candidates only up to ``local_rows``."""
    import numpy as np

    near = staged(docs.select(text).mapInArrow(_propose, "y int, h bigint, x binary").groupBy("y", "h").agg(F.min("x").alias("x")))
    near = near.withColumn("odd", F.col("h").bitwiseAND(1) == 1)
    sizes = {(r.y, r.odd): r.n for r in near.groupBy("y", "odd").agg(F.count(F.lit(1)).alias("n")).collect()}
    size = lambda y, half: sizes.get((y, half), 0)
    whole = {half: sum(n for (_, h), n in sizes.items() if h == half) for half in (False, True)}
    models: dict = {}
    why = {k: "too few or no other examples" for k in range(1, PART) if any(size(k, half) < LEAST or size(k, half) == whole[half] for half in whole)}
    kinds = [k for k in range(1, PART) if k not in why]
    if kinds:
        weights = {y: min(1.0, sample_candidates / (size(y, False) + size(y, True))) for y, _ in sizes}
        found = near.mapInArrow(_histogram, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).orderBy("key").toArrow()
        key, n = found["key"].to_numpy(), found["n"].to_numpy()
        label, feature, code = key >> 24, (key >> 16) & 255, key & 65535
        weigh = n * np.array([weights[int(y)] for y in label])
        cuts = []
        for j in range(int(feature.max()) + 1):
            here = feature == j
            codes, of = np.unique(code[here], return_inverse=True)
            cuts.append(_cuts(codes, np.bincount(of, weigh[here])))

        def binned(batches):
            import pyarrow as pa

            for b in batches:
                if b.num_rows:
                    x = _matrix(b.column("x"), "<u2")
                    v = np.stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(cuts)], axis=1).astype(np.uint8)
                    yield pa.RecordBatch.from_arrays([b.column("y"), b.column("odd"), pa.array([r.tobytes() for r in v], pa.binary())], ["y", "odd", "v"])

        rows = staged(near.select("y", "odd", "x").mapInArrow(binned, "y int, odd boolean, v binary").groupBy("y", "odd", "v").agg(F.count(F.lit(1)).alias("n")))
        classes = [(k, half) for half in (None, False, True) for k in kinds]  # of all rows, and of each half

        def rights(t):
            y, half = t["y"].to_numpy(), t["odd"].to_numpy()
            w = t["n"].to_numpy() * np.array([weights[int(k)] for k in y])
            return np.stack([y == k for k, _ in classes], axis=1), np.stack([w if h is None else w * (half == h) for _, h in classes], axis=1)

        total = {half: sum(n * weights[y] for (y, h), n in sizes.items() if h == half) for half in (False, True)}
        total[None] = total[False] + total[True]
        share = lambda k, half: sum(size(k, h) for h in (False, True) if half in (None, h)) * weights[k] / total[half]
        scale = whole_scale(total[None])
        if rows.count() <= local_rows:
            t = rows.toArrow()
            sums = LocalSums(_matrix(t["v"], "u1"), *rights(t), scale)
        else:
            sums = SparkSums(rows, rights, len(classes), scale, staged)
        above = [np.nextafter(_lowest(np.array(c, dtype=np.int64) + 1), -np.inf) for c in cuts]  # the greatest value of each cut's code
        trees = dict(zip(classes, grow(sums, np.array([share(*c) for c in classes]), above, scale, rounds), strict=True))
        models, failed = _calibrated(near, kinds, trees)
        why |= failed
    for k, reason in sorted(why.items()):
        LOG.warning("no model for kind %s, only base spans of it are found: %s (%d examples in one half, %d in the other, %d candidates in all)",
                    KINDS[k - 1], reason, size(k, False), size(k, True), sum(sizes.values()))
    return models


def _calibrated(near: DataFrame, kinds: list[int], trees: dict) -> tuple[dict, dict]:
    """kind -> (trees of all rows, threshold), and the kinds for which no threshold reaches the precision. Each row is
    scored by the trees of the half that it is not in. Thresholds lie on a grid of scores: a 64th of the log odds
    apart, from even odds on."""
    import numpy as np

    grid = 1 / (1 + np.exp(-np.arange(0, 40 * 64 + 1) / 64))
    plain = {c: (t.base, t.features, t.thresholds, t.leaves) for c, t in trees.items() if c[1] is not None}

    def scored(batches):
        import pyarrow as pa

        models = {c: Boosted(*t) for c, t in plain.items()}
        for b in batches:
            x, labels, halves = _lowest(_matrix(b.column("x"), "<u2")) if b.num_rows else (), b.column("y").to_numpy(), b.column("odd").to_numpy(zero_copy_only=False)
            for (k, half), model in models.items():
                of = np.flatnonzero((halves != half) & (labels != PART))
                if len(of):
                    cell = np.searchsorted(grid, model.probability(x[of]), side="right") - 1
                    key, n = np.unique((cell * 2 + (labels[of] == k))[cell >= 0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(key), pa.int32()), pa.array(key), pa.array(n)], ["kind", "key", "n"])

    counts = np.zeros((1 + len(KINDS), len(grid), 2), dtype=np.int64)
    for r in near.select("y", "odd", "x").mapInArrow(scored, "kind int, key bigint, n bigint").groupBy("kind", "key").agg(F.sum("n").alias("n")).collect():  # bounded by the grid
        counts[r.kind, r.key // 2, r.key % 2] = r.n
    models, failed = {}, {}
    for k in kinds:
        reached = np.cumsum(counts[k][::-1], axis=0)[::-1]  # at this score or more
        held = np.flatnonzero((counts[k].sum(axis=1) > 0) & (reached[:, 1] >= PRECISION * reached.sum(axis=1)))
        if len(held):
            models[KINDS[k - 1]] = (trees[k, None], float(grid[held[0]]))
        else:
            failed[k] = f"no threshold reaches precision {PRECISION}"
    return models, failed


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Each run of overlapping spans becomes one ``[KIND]``, of its first span."""
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def detect(docs: DataFrame, models: dict, text: str = "text") -> DataFrame:
    """``docs`` with pii_spans (by start, then kind) and redacted_text (null stays null)."""
    plain = {kind: ((t.base, t.features, t.thresholds, t.leaves), at) for kind, (t, at) in models.items()}
    shared, key = docs.sparkSession.sparkContext.broadcast(plain), uuid.uuid4().hex

    def run(batch):
        import numpy as np
        import pyarrow as pa

        m = cached(key, lambda: {kind: (Boosted(*trees), at) for kind, (trees, at) in shared.value.items()})
        texts = batch.column(text).to_pylist()
        base = [base_spans(t) if t else [] for t in texts]
        found = [(k, s, e, features(t, s, e, gen)) for k, t in enumerate(texts) if t and m for s, e, gen in candidates(t)]
        extra: dict[int, list] = {}
        if found:
            x = _lowest(_codes([f[3] for f in found]))
            score = {kind: trees.probability(x) for kind, (trees, _) in m.items()}
            for i, (k, s, e, _) in enumerate(found):
                kind = max((c for c in score if score[c][i] >= m[c][1]), key=lambda c: score[c][i], default=None)
                if kind is not None:
                    extra.setdefault(k, []).append((-float(score[kind][i]), s, e, kind))
        spans, red = [], []
        for k, t in enumerate(texts):
            got = [{"kind": kind, "start": s, "end": e, "base": True, "score": 1.0} for kind, s, e in base[k]]
            taken = bytearray(len(t) if k in extra else 0)
            for _, s, e in base[k] if k in extra else ():
                taken[s:e] = b"\1" * (e - s)
            for p, s, e, kind in sorted(extra.get(k, []), key=lambda c: (c[0], c[1], -c[2], c[3])):  # of equals the longer
                if taken.find(1, s, e) < 0:
                    taken[s:e] = b"\1" * (e - s)
                    got.append({"kind": kind, "start": s, "end": e, "base": False, "score": -p})
            got.sort(key=lambda g: (g["start"], KINDS.index(g["kind"])))
            spans.append(got)
            red.append(t if t is None else redact(t, [(g["kind"], g["start"], g["end"]) for g in got]))
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("score", pa.float64())]))
        return {"pii_spans": pa.array(spans, kind), "redacted_text": pa.array(red, pa.string())}

    return with_columns(docs, ADDED, run)
