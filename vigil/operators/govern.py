"""The governed request path (C5, J4, U3) as one DataFrame job.

Stages, in the original's order: 0 rate limit -> 1 request PII -> 2 cost
limits -> 3 cache -> 4 provider answer (from the log) -> 5 response PII ->
6 cost -> 7 metadata -> 8 cache store -> 9 span. Consequences kept:

* a rate-limit slot is consumed even if a later stage ends the request;
* redaction happens before the token estimate and the cache key;
* requests ended at stages 0-2 never reach the cache, neither to be served
  nor to store;
* a failed provider call ends the request before response PII, cost and
  store; a hit returns the stored answer with its cost and its findings and
  is not costed again.

The policy is a one-row settings frame, read on the driver like any
configuration.

The daily cap and the cache depend on each other: a request that the cap
denies stores nothing, and a hit spends nothing. Each decision depends on
earlier requests only, so exactly one assignment of decisions is consistent
with itself. It is found by iteration: the cache is replayed with the current
cap decisions, the cap is decided again with the resulting spend, until no
decision changes. Every round makes at least the first wrong decision in time
right; it never stops early. After the first, a round replays only the keys in
which a decision turned, and decides only the days whose spend that changed.
On a day with far more requests than its cap pays for, nearly all are denied,
and these neither hit, store nor spend: a guess (``budget.bounds``) sets them
apart, the rounds settle the others, and one prefix sum of what those spend
shows that every row set apart is denied, and the spend it saw. Rows for which
it does not hold join the rounds, so the result does not rest on the guess.
Rounds work on slim tables in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.functions import cost as fc
from vigil.functions import pii
from vigil.functions.keys import cache_key
from vigil.operators import budget, cache, costs, pii_scan, rate_limit
from vigil.session import cut_lineage
from vigil.sources.dims import DEFAULT_MODEL, PII_BLOCK_REASON, RATE_WINDOWS


def _told(findings):
    """Findings as type:start-end, in order."""
    return F.transform(findings, lambda f: F.concat_ws("", f["type"], F.lit(":"), f["start"], F.lit("-"), f["end"]))


def _limits(p) -> dict:
    # policy documents are VARIANT objects, which keep keys sorted; limits are
    # checked minute -> hour -> day, the order every shipped policy uses
    order = {n: w for n, w, _ in RATE_WINDOWS}
    return dict(sorted((p["rate_limits"] or {}).items(), key=lambda kv: order.get(kv[0], 1 << 40)))


def _checked(requests: DataFrame, p, pricing: DataFrame | None) -> DataFrame:
    """Stages 1, 2a, 5 and 6 as far as they depend on the row alone: one narrow row per request, without texts."""
    d = requests.withColumn("model", F.coalesce("model", F.lit(DEFAULT_MODEL)))
    none = F.lit(None).cast("array<string>")
    if p["pii_enabled"]:
        ents, action = list(p["pii_entities"] or []), p["pii_action"]
        d = d.withColumn("_scan", pii_scan.message_scan(F.col("messages"), ents))
        first_bad = F.try_element_at(F.filter(F.col("_scan"), lambda s: F.size(s["findings"]) > 0), F.lit(1))
        d = (d.withColumn("request_findings", F.flatten(F.transform("_scan", lambda s: _told(s["findings"]))))
              .withColumn("pii_block", F.lit(action == "block") & first_bad.isNotNull())
              .withColumn("pii_reason", F.when(F.col("pii_block"), F.format_string(PII_BLOCK_REASON, F.size(first_bad["findings"]))))
              .withColumn("messages", F.transform(F.col("_scan"), lambda s: F.struct(
                  s["role"].alias("role"), pii.apply_action(s["content"], s["findings"], action).alias("content"))))
              .withColumn("answer_findings", _told(pii_scan.searched(F.col("answer"), ents))))
    else:
        d = (d.withColumn("request_findings", none).withColumn("pii_block", F.lit(False))
              .withColumn("pii_reason", F.lit(None).cast("string")).withColumn("answer_findings", none))
    d = d.withColumn("input_tokens", fc.request_tokens(F.col("messages"), F.col("system")))
    d = costs.with_estimate(d, pricing=pricing)
    if p["max_per_request"] is not None:
        ok, reason = costs.per_request_check(F.col("estimated_cost"), F.lit(p["max_per_request"]))
    else:
        ok, reason = F.lit(True), F.lit(None).cast("string")
    d = costs.with_prices(d, pricing)
    empty = F.array().cast("array<string>")
    return d.select(
        "request_id", "client_id", "ts", "sec", "model",
        cache_key(F.col("model"), F.col("messages"), F.col("temperature"), F.col("max_tokens"), F.col("top_p")).alias("cache_key"),
        F.coalesce("request_findings", empty).alias("request_findings"), F.coalesce("answer_findings", empty).alias("answer_findings"),
        "pii_block", "pii_reason", "estimated_cost", ok.alias("cost_ok"), reason.alias("cost_reason"),
        F.coalesce(F.col("answer_status") == 200, F.lit(False)).alias("answer_ok"), F.coalesce("answer_status", F.lit(502)).alias("answer_status"),
        F.when(F.col("usage_prompt_tokens").isNotNull(), fc.calculate_cost(
            F.col("usage_prompt_tokens"), F.coalesce("usage_completion_tokens", F.lit(0)), F.col("input_per_1k"), F.col("output_per_1k"))).alias("full_cost"))


def _cap_and_cache(reach: DataFrame, p) -> DataFrame:
    """Stages 2b and 3 over the requests that reach them: (request_id, cap_ok, cap_reason, cache_hit, stored_at)."""
    caching, cap = p["caching_enabled"], p["daily_cap"]
    base = ["estimated_cost", "full_cost", "answer_ok"]

    def looked_up(rows: DataFrame, *carry: str) -> DataFrame:
        if not caching:
            return rows.withColumn("cache_hit", F.lit(False)).withColumn("stored_at", F.lit(None).cast("timestamp"))
        # a request denied by the cap neither hits nor stores; its own hit is what it would find
        return cache.replay(rows, int(p["cache_ttl"]), answered_ok=F.col("answer_ok") & F.col("cap_ok"),
                            carry=[*base, "cap_ok", *carry]).withColumnRenamed("entry_stored_at", "stored_at")

    def with_spend(rows: DataFrame) -> DataFrame:
        spend = F.when(~F.col("cache_hit") & F.col("answer_ok"), F.col("full_cost"))
        return rows.withColumn("actual_cost", F.coalesce(spend, F.lit(0)))

    def asked(rows: DataFrame) -> DataFrame:
        return with_spend(rows).select("request_id", "ts", "estimated_cost", "actual_cost")

    def decided(rows: DataFrame) -> DataFrame:
        return budget.admission(asked(rows), cap).select("request_id", F.col("allowed").alias("new_ok"), F.col("reason").alias("new_reason"))

    def settled(seen: DataFrame) -> DataFrame:
        """Cap and cache decided to their fixed point over rows that were looked up with ``cap_ok`` true."""
        now = seen.join(decided(seen), "request_id")
        while caching:
            now = cut_lineage(now)
            turned = cut_lineage(now.where(F.col("new_ok") != F.col("cap_ok")).select("cache_key").distinct())
            if turned.limit(1).count() == 0:
                break
            # only keys in which a decision turned are replayed, and only days whose spend that changed are decided again
            redo = now.join(turned, "cache_key", "left_semi").withColumn("cap_ok", F.col("new_ok")).withColumnRenamed("cache_hit", "was_hit").drop("stored_at")
            redo = cut_lineage(looked_up(redo, "new_ok", "new_reason", "was_hit"))
            days = redo.where((F.col("cache_hit") != F.col("was_hit")) & F.col("answer_ok")).select(F.to_date("ts").alias("day")).distinct()
            merged = now.join(turned, "cache_key", "left_anti").unionByName(redo.drop("was_hit"))
            days = cut_lineage(days)
            again = decided(cut_lineage(merged.withColumn("day", F.to_date("ts")).join(days, "day", "left_semi")))
            again = again.select("request_id", F.struct("new_ok", "new_reason").alias("again"))
            now = merged.join(again, "request_id", "left").select(
                *[c for c in merged.columns if c not in ("new_ok", "new_reason")],
                F.when(F.col("again").isNotNull(), F.col("again.new_ok")).otherwise(F.col("new_ok")).alias("new_ok"),
                F.when(F.col("again").isNotNull(), F.col("again.new_reason")).otherwise(F.col("new_reason")).alias("new_reason"))
        return now

    def told(now: DataFrame) -> DataFrame:
        return now.select("request_id", F.col("new_ok").alias("cap_ok"), F.col("new_reason").alias("cap_reason"), "cache_hit", "stored_at")

    seen = looked_up(reach.withColumn("cap_ok", F.lit(True)))
    if cap is None:
        return seen.withColumn("cap_reason", F.lit(None).cast("string"))
    seen = cut_lineage(seen)  # read by the cap and by the join
    if not caching:
        return told(settled(seen))
    bounds = cut_lineage(budget.bounds(asked(seen), cap))
    while bounds.limit(1).count():
        # rows that the cap is taken to deny neither hit, store nor spend: the others are settled without them ...
        rows = budget.may_pass(bounds, seen.select("request_id", "cache_key", "ts", *base))
        now = cut_lineage(with_spend(settled(cut_lineage(looked_up(rows.where("may").drop("day", "may").withColumn("cap_ok", F.lit(True)))))))
        spends = now.where("new_ok AND actual_cost > 0").select("request_id", "ts", "actual_cost")
        # ... and it holds if they are denied by what those spend; else they take part too
        rest = rows.where(~F.col("may")).select("request_id", "ts", "estimated_cost")
        rest = cut_lineage(budget.denied_unless(rest, spends, cap))
        wrong = cut_lineage(rest.where("allowed").groupBy("day").agg(F.max("est_micro").alias("found")))
        if wrong.limit(1).count() == 0:
            rest = rest.select("request_id", F.col("allowed").alias("cap_ok"), F.col("reason").alias("cap_reason"),
                               F.lit(False).alias("cache_hit"), F.lit(None).cast(now.schema["stored_at"].dataType).alias("stored_at"))
            return told(now).unionByName(rest)
        more = F.when(F.col("found").isNotNull(), F.greatest(F.col("found"), F.col("most") * 2)).otherwise(F.col("most"))
        bounds = cut_lineage(bounds.join(wrong, "day", "left").select("day", "until", more.alias("most")))
    return told(settled(seen))


def govern(requests: DataFrame, policy_settings: DataFrame, pricing: DataFrame | None = None) -> DataFrame:
    """``requests``: request_id, ts, sec, client_id, model, messages
    ARRAY<STRUCT<role, content>>, system, max_tokens, temperature, top_p, and
    from the log the provider's answer: answer_status, answer (text),
    usage_prompt_tokens, usage_completion_tokens. ``policy_settings``: one
    row of ``policy.settings``."""
    p = policy_settings.first()  # one row of settings; read on the driver like any config
    limits = _limits(p)
    d = _checked(requests, p, pricing)
    if limits:  # 0: every request takes part; slim columns ride along, so no join back is needed
        d = rate_limit.decisions(d, limits, keep=d.columns).withColumnsRenamed(
            {"allowed": "rate_ok", "reason": "rate_reason", "min_remaining": "rate_remaining"})
    else:
        d = d.withColumn("rate_ok", F.lit(True)).withColumn("rate_reason", F.lit(None).cast("string")).withColumn("rate_remaining", F.lit(None).cast("bigint"))
    d = cut_lineage(d.withColumn("reach", F.col("rate_ok") & ~F.col("pii_block") & F.col("cost_ok")))
    passed = _cap_and_cache(d.where("reach").select("request_id", "cache_key", "ts", "estimated_cost", "full_cost", "answer_ok"), p)
    passed = cut_lineage(passed.select("request_id", "cap_ok", "cap_reason", (F.col("cache_hit") & F.col("cap_ok")).alias("cache_hit"), "stored_at"))
    d = d.join(passed, "request_id", "left").withColumn("cache_hit", F.coalesce("cache_hit", F.lit(False)))
    # a hit is served with what its entry holds: the one miss of that key and time that stored
    stored = (d.where("reach AND cap_ok AND NOT cache_hit AND answer_ok AND stored_at IS NOT NULL")
              .select(F.col("cache_key").alias("_k"), F.col("stored_at").alias("_at"), F.col("full_cost").alias("stored_cost"),
                      F.col("request_findings").alias("stored_request_findings"), F.col("answer_findings").alias("stored_answer_findings")))
    d = d.join(stored, F.col("cache_hit") & (F.col("cache_key") == F.col("_k")) & (F.col("stored_at") == F.col("_at")), "left")
    stage = (F.when(~F.col("rate_ok"), "rate_limit").when(F.col("pii_block"), "pii")
              .when(~F.col("cost_ok") | ~F.coalesce(F.col("cap_ok"), F.lit(True)), "cost")
              .when(F.col("cache_hit"), "cache").when(~F.col("answer_ok"), "provider_error").otherwise("provider"))
    status = (F.when(stage.isin("rate_limit", "cost"), 429).when(stage == "pii", 400)
               .when(stage == "provider_error", F.col("answer_status")).otherwise(200))
    reason = F.coalesce(F.when(~F.col("rate_ok"), F.col("rate_reason")), F.col("pii_reason"),
                        F.when(~F.col("cost_ok"), F.col("cost_reason")), F.when(~F.coalesce("cap_ok", F.lit(True)), F.col("cap_reason")))
    served = stage == "provider"
    none = F.array().cast("array<string>")
    return d.select(
        "request_id", "client_id", "ts", "model", "cache_key",
        F.struct(stage.isin("cache", "provider").alias("allowed"), stage.alias("stage"), status.cast("int").alias("status"), reason.alias("reason")).alias("decision"),
        "estimated_cost", F.when(served, F.col("full_cost")).when(F.col("cache_hit"), F.col("stored_cost")).alias("cost"),
        F.when(served, F.col("full_cost")).otherwise(F.lit(0)).cast("decimal(18,6)").alias("tracked_cost"), "cache_hit",
        F.struct(F.when(served, F.col("request_findings")).when(F.col("cache_hit"), F.col("stored_request_findings")).otherwise(none).alias("request_findings"),
                 F.when(served, F.col("answer_findings")).when(F.col("cache_hit"), F.col("stored_answer_findings")).otherwise(none).alias("response_findings")).alias("pii"),
        F.col("rate_remaining"))


def request_log_as_requests(log: DataFrame) -> DataFrame:
    """Request-log rows as governed requests: one user message holding the
    prompt, with an address where the log reports personal data; the logged
    status, client address and token counts stand for the provider's answer."""
    content = F.when(F.col("pii_findings") > 0, F.concat("prompt", F.lit(" mail to u"), F.col("user_agent").substr(7, 20), F.lit("@mail.example.com"))).otherwise(F.col("prompt"))
    answer = F.when(F.col("request_id") % 11 == 0, F.concat(F.lit("seen from "), F.col("client_ip"), F.lit(" ok"))).otherwise(F.lit("ok"))
    return log.select(
        "request_id", "ts", "sec", "client_id", F.when(F.col("request_id") % 13 != 0, F.col("model")).alias("model"),
        F.array(F.struct(F.lit("user").alias("role"), content.alias("content"))).alias("messages"),
        F.when(F.col("request_id") % 17 == 0, F.lit("answer briefly")).alias("system"),
        "max_tokens", F.lit(None).cast("double").alias("temperature"), F.lit(None).cast("double").alias("top_p"),
        F.col("status").alias("answer_status"), answer.alias("answer"),
        F.col("input_tokens").alias("usage_prompt_tokens"), F.col("output_tokens").alias("usage_completion_tokens"))
