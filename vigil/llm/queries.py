"""The dealt operators as named queries over the given tables, and their oracle SQL.

Each query reads its whole table and derives the contract's columns from the
output of its operator, with the operator's production parameters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.common import sha_hex, small_batches, staged
from vigil.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            small_batches(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return run

    return deco


def _documents(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select(*(cols or ("doc_id", "text")))


# Fixed values of the contracts: words of op5 are runs of ASCII letters and digits or characters beyond ASCII, A-Z folded.
_FOLDED = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS5 = "regexp_extract_all(" + _FOLDED + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP5_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS5.format('text')} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS5.format('text')} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, array_to_string(w[s:s + least(13, len(w)) - 1], ' ') AS win, least(13, len(w)) AS size
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT doc_id, size, s, array_to_string(w[s:s + size - 1], ' ') AS win
       FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM d, sizes WHERE len(w) >= size)),
hits AS (SELECT dw.doc_id, dw.s, dw.size, bw.item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.size = bw.size),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + size)) AS p FROM hits) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(hw.n_hit, 0) AS n_hit, coalesce(hi.n_items, 0) AS n_items,
       sha256(coalesce(hi.ids, '')) AS items_sha256,
       coalesce(hw.n_hit, 0) > 0 AND 20 * coalesce(hw.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""


@query("op5_aho_corasick_decontamination", OP5_SQL)
def op5(spark, sf_dir):
    from vigil.llm.decontaminate import decontaminate

    d = decontaminate(_documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))
    return d.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"),
                    sha_hex(F.array_join("item_ids", ",")).alias("items_sha256"), "contaminated")


@query("op8_word_first_language_id")
def op8(spark, sf_dir):
    from vigil.llm.lang_id import fit, identify

    docs = _documents(spark, sf_dir, "doc_id", "text", "lang")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = fit(docs.where(~held & F.col("doc_id").isNotNull()))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


@query("op9_nnls_pattern_packing")
def op9(spark, sf_dir):
    from vigil.llm.packing import best_fit

    return best_fit(_documents(spark, sf_dir), digests={"ids_crc32": F.crc32("ids")}).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op4_sampled_splitters")
def op4(spark, sf_dir):
    from vigil.llm.sharding import shard

    return shard(_documents(spark, sf_dir)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


_WORDS1 = "regexp_extract_all(" + _FOLDED + r", '[^\x20\x09-\x0D]+')"
OP1_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS1.format('text')} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 5, 0) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM d LEFT JOIN n USING (doc_id)
JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)
"""

OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS c FROM win) WHERE c > 1),
cov AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM rep),
kept AS (SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.p) AS t, count(*) AS n
         FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) x ANTI JOIN cov USING (doc_id, p) GROUP BY x.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


@query("op1_ngram_jaccard_join", OP1_SQL)
def op1(spark, sf_dir):
    from vigil.llm.ngram_join import join

    return join(_documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


@query("op2_count_min_substring_dedup", OP2_SQL)
def op2(spark, sf_dir):
    from vigil.llm.substring_dedup import dedup

    return dedup(_documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", sha_hex(F.col("kept_text")).alias("kept_sha256"))


@query("op10_multi_index_hashing")
def op10(spark, sf_dir):
    from vigil.llm.ann_mih import nearest

    return nearest(read_table(spark, sf_dir, "embeddings"))


@query("op3_boosted_pii")
def op3(spark, sf_dir):
    from vigil.llm.pii_boost import detect, fit

    docs = _documents(spark, sf_dir)
    d = detect(docs, fit(docs)).select("doc_id", "pii_spans")
    base = F.filter("pii_spans", lambda s: s["base"])
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    number = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return d.select("doc_id", *(number(k) for k in ("email", "ip", "card", "phone")), sha_hex(told(base)).alias("base_sha256"),
                    told(F.col("pii_spans")).alias("spans"))


@query("op6_separator_scan_token_counts")
def op6(spark, sf_dir):
    import uuid

    from vigil.llm.token_scan import count_tokens, read_blocks, write_token_files
    from vigil.session import ensure_checkpoint_dir

    path = f"{ensure_checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_files(_documents(spark, sf_dir, "text"), path)
    out = count_tokens(read_blocks(spark, path))
    part = F.regexp_extract("file", r"part-(\d+)", 1).cast("bigint") * 1000 + F.regexp_extract("file", r"-c(\d+)", 1).cast("bigint")
    return out.select(part.alias("file_no"), "doc_no", "start", "n_tokens", "complete")


OP7_SQL = r"""
WITH RECURSIVE ln AS (SELECT conv_id, turn, regexp_extract(text, '([^\n]*[^\s][^\n]*)', 1) AS line FROM conversations),
d AS (SELECT c.conv_id, c.turn, c.role, c.text, p.line AS q1, g.line AS q2
      FROM conversations c LEFT JOIN ln p ON p.conv_id = c.conv_id AND p.turn = c.turn // 2 AND c.turn >= 1 AND p.line <> ''
      LEFT JOIN ln g ON g.conv_id = c.conv_id AND g.turn = c.turn // 2 // 2 AND c.turn // 2 >= 1 AND g.line <> ''),
own AS (SELECT conv_id, turn, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(lower(x), '\s+', ' ', 'g'))), lambda x: x <> '') AS w FROM conversations),
wrote AS (SELECT conv_id, h, min(turn) AS first FROM (SELECT conv_id, turn, unnest(w) AS h FROM own UNION ALL SELECT conv_id, turn, array_to_string(w, ' ') FROM own WHERE len(w) > 1) GROUP BY ALL),
q AS (SELECT conv_id, turn, 1 AS level, q1 AS line FROM d WHERE q1 IS NOT NULL UNION ALL SELECT conv_id, turn, 2, q2 FROM d WHERE q2 IS NOT NULL),
l AS (SELECT q.conv_id, q.turn, level, first AS link FROM q LEFT JOIN wrote w ON w.conv_id = q.conv_id AND w.h = trim(regexp_replace(lower(q.line), '\s+', ' ', 'g')) AND w.first < q.turn),
n AS (SELECT conv_id, turn, count(*) AS n_quoted, count(link) AS n_linked, max(CASE WHEN level = 1 THEN link END) AS parent FROM l GROUP BY ALL),
up AS (SELECT c.conv_id, c.turn, n.parent, c.turn AS root, CAST(0 AS BIGINT) AS depth FROM conversations c LEFT JOIN n USING (conv_id, turn)),
r AS (SELECT conv_id, turn, parent, root, depth FROM up WHERE parent IS NULL
      UNION ALL SELECT u.conv_id, u.turn, u.parent, r.root, r.depth + 1 FROM r JOIN up u ON u.conv_id = r.conv_id AND u.parent = r.turn)
SELECT d.conv_id, d.turn, d.role, trim(d.text, ' ' || chr(10) || chr(9) || chr(13)) AS text, coalesce(n_quoted, 0) AS n_quoted, coalesce(n_linked, 0) AS n_linked,
       r.parent AS parent_turn, r.root AS thread_turn, r.depth, row_number() OVER (PARTITION BY d.conv_id, r.root ORDER BY d.turn) AS position
FROM d LEFT JOIN n USING (conv_id, turn) JOIN r USING (conv_id, turn)
"""


@query("op7_quotation_linking", OP7_SQL)
def op7(spark, sf_dir):
    from vigil.llm.chat_quotes import as_replies, conversations

    return conversations(as_replies(read_table(spark, sf_dir, "conversations")))



OP12_SQL = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE CAST(label AS BIGINT) END AS label,
                  [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS al, c.vec_id AS id, c.label AS cl, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
      FROM r a JOIN r c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, al, id AS positive_id, score AS positive_score FROM s WHERE cl = al
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.cl <> p.al AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""


@query("op12_kronecker_hard_negatives", OP12_SQL)
def op12(spark, sf_dir):
    from vigil.llm.hard_negatives import mine

    label = F.col("label").cast("bigint")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return mine(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", moved.alias("label")))


_WORDS13 = "regexp_extract_all(" + _FOLDED + r", '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS13.format('text')} AS w FROM documents),
t AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(w) AS term FROM d) GROUP BY ALL),
c AS (SELECT count(*) FILTER (len(w) > 0) AS docs, CAST(sum(len(w)) AS BIGINT) AS terms FROM d),
df AS (SELECT term, count(*) AS df FROM t GROUP BY term),
i AS (SELECT item_id, term, count(*) AS q FROM (SELECT item_id, unnest({_WORDS13.format('text')}) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT i.item_id, rid, doc_id, CAST(sum(q * CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT)
             * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * len(w) * docs) // terms)))) AS BIGINT) AS score
      FROM i JOIN t USING (term) JOIN df USING (term) JOIN d USING (rid), c GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 10
"""


@query("op13_bag_dedup_search", OP13_SQL)
def op13(spark, sf_dir):
    from vigil.llm.bag_search import search

    return search(_documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))


@query("op11_guess_cost_secrets")
def op11(spark, sf_dir):
    from vigil.llm.secret_guess import KINDS, scan

    d = scan(_documents(spark, sf_dir))
    base = F.filter("secret_spans", lambda s: s["base"])
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    number = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return d.select("doc_id", *map(number, KINDS[:3]), sha_hex(told(base)).alias("base_sha256"), told(F.col("secret_spans")).alias("spans"),
                    F.array_join(F.transform("secret_spans", lambda s: F.floor(s["bits"]).cast("string")), ",").alias("guess_bits"))
