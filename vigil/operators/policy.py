"""Policy documents: reading (S3, S4), validation (P11), selection (P10),
change detection (P12), model routing (P21) and log masking (P23).

A policy is kept as a VARIANT (``parse_json``) so validation can see the
type each YAML value really had; typed settings are read with
``try_variant_get``. Policy sets are a handful of rows, so they are
broadcast where joined.
"""

from __future__ import annotations

import json
import re
from decimal import Decimal
from functools import reduce

import pandas as pd

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.sources.dims import POLICY_INTEGER_ERROR, POLICY_NAME_ERROR, POLICY_NUMBER_ERROR

# ---------------------------------------------------------------------------
# The two built-in policies (the file shipped next to the
# service, and the one the loader writes when the directory is empty) and
# the routing rules they declare, with conditions as SQL predicates.
# ---------------------------------------------------------------------------
FILE_DEFAULT = {
    "name": "Default Policy",
    "description": "Default governance policy",
    "enabled": True,
    "cost_limits": {"max_per_request": 0.03, "max_per_minute": 1.0, "daily_cap": 100.0},
    "rate_limits": {"requests_per_minute": 60, "requests_per_hour": 1000, "requests_per_day": 10000},
    "model_routing": [{"condition": "request.max_tokens < 100", "model": "gpt-3.5-turbo"},
                      {"condition": "default", "model": "gpt-4o-mini"}],
    "pii_detection": {"enabled": False, "action": "redact",
                      "entities": ["email", "phone", "ssn", "credit_card"]},
    "caching": {"enabled": True, "ttl_seconds": 3600, "max_cache_size_mb": 100},
    "logging": {"log_requests": True, "log_responses": False, "log_costs": True},
}
BUILTIN_DEFAULT = {
    **FILE_DEFAULT,
    "pii_detection": {"enabled": True, "action": "warn",
                      "entities": ["email", "phone", "ssn", "credit_card", "api_key"]},
}
FILE_DEFAULT_ROUTING = [("max_tokens < 100", "gpt-3.5-turbo"), ("default", "gpt-4o-mini")]
COST_FIELDS = ["max_per_request", "max_per_minute", "daily_cap"]
RATE_FIELDS = ["requests_per_minute", "requests_per_hour", "requests_per_day"]
ERR_NAME = POLICY_NAME_ERROR
# ---------------------------------------------------------------------------

def _yaml_to_json_udf():
    @F.pandas_udf("string")
    def to_json(texts: pd.Series) -> pd.Series:
        import yaml

        def one(t):
            try:
                doc = yaml.safe_load(t)
            except Exception:  # broken file: logged and skipped by the caller
                return None
            return json.dumps(doc, default=str) if doc else None
        return texts.map(one)

    return to_json


def read_policies(spark: SparkSession, directory: str) -> DataFrame:
    """S3: every ``*.yaml`` file of a directory -> (policy_name = file stem,
    doc VARIANT, modified TIMESTAMP). Empty and unparsable files are
    skipped. YAML is parsed by a small vectorised helper on the executors."""
    raw = (spark.read.option("pathGlobFilter", "*.yaml").text(directory, wholetext=True)
           .select(F.col("value"), F.col("_metadata.file_path").alias("path"),
                   F.col("_metadata.file_modification_time").alias("modified")))
    parsed = raw.select(
        F.regexp_extract("path", r"([^/]+)\.yaml$", 1).alias("policy_name"),
        _yaml_to_json_udf()("value").alias("json"), "modified")
    return parsed.where(F.col("json").isNotNull()).select(
        "policy_name", F.parse_json("json").alias("doc"), "modified")


def default_policies(spark: SparkSession) -> DataFrame:
    """Both built-in defaults as named policies."""
    return _built_in(spark, [("file_default", FILE_DEFAULT), ("builtin_default", BUILTIN_DEFAULT)])


def _built_in(spark: SparkSession, policies: list[tuple[str, dict]]) -> DataFrame:
    # names are rows, not literals: a constant name would turn the joins by name into nested loops
    return (spark.createDataFrame([(n, json.dumps(d)) for n, d in policies], "policy_name string, json string")
            .select("policy_name", F.parse_json("json").alias("doc"), F.lit(None).cast("timestamp").alias("modified")))


def with_fallback(policies: DataFrame, spark: SparkSession) -> DataFrame:
    """When the directory yields no policy, the built-in one applies under
    the name 'default'. Policies are configuration (a handful of rows), so
    the emptiness check is a one-row probe."""
    if policies.limit(1).count() > 0:
        return policies
    return _built_in(spark, [("default", BUILTIN_DEFAULT)])


def _vtype(doc: Column, path: str) -> Column:
    return F.schema_of_variant(F.variant_get(doc, path, "variant"))


def validate(policies: DataFrame) -> DataFrame:
    """Array of error strings per policy (empty when valid). Booleans
    pass as numbers, as in the original."""
    doc = F.col("doc")
    name_t = _vtype(doc, "$.name")
    name_s = F.try_variant_get(doc, "$.name", "string")
    falsy = (name_t.isNull() | (name_t == "VOID") | ((name_t == "STRING") & (name_s == ""))
             | ((name_t == "BOOLEAN") & (name_s == "false"))
             | (name_t.rlike("^(BIGINT|DOUBLE|DECIMAL.*)$") & (F.try_variant_get(doc, "$.name", "double") == 0)))
    checks = [F.when(falsy, F.lit(ERR_NAME))]
    numeric = "^(BIGINT|DOUBLE|FLOAT|BOOLEAN|DECIMAL.*)$"
    for f in COST_FIELDS:
        t = _vtype(doc, f"$.cost_limits.{f}")
        checks.append(F.when(t.isNotNull() & ~t.rlike(numeric), F.lit(POLICY_NUMBER_ERROR.format(field=f))))
    for f in RATE_FIELDS:
        t = _vtype(doc, f"$.rate_limits.{f}")
        checks.append(F.when(t.isNotNull() & ~t.rlike("^(BIGINT|BOOLEAN)$"),
                             F.lit(POLICY_INTEGER_ERROR.format(field=f))))
    return policies.select("policy_name", F.array_compact(F.array(*checks)).alias("errors"))


def settings(policies: DataFrame) -> DataFrame:
    """Typed view of the fields the governance jobs use."""
    d = F.col("doc")

    def g(path, t):
        return F.try_variant_get(d, path, t)

    return policies.select(
        "policy_name", *[c for c in ("version",) if c in policies.columns],
        g("$.name", "string").alias("name"),
        F.coalesce(g("$.enabled", "boolean"), F.lit(True)).alias("enabled"),
        g("$.cost_limits", "variant").isNotNull().alias("has_cost_limits"),
        *[g(f"$.cost_limits.{f}", "decimal(18,6)").alias(f) for f in COST_FIELDS],
        g("$.rate_limits", "map<string,bigint>").alias("rate_limits"),
        F.coalesce(g("$.pii_detection.enabled", "boolean"), F.lit(False)).alias("pii_enabled"),
        F.coalesce(g("$.pii_detection.action", "string"), F.lit("warn")).alias("pii_action"),
        F.coalesce(g("$.pii_detection.entities", "array<string>"), F.array().cast("array<string>")).alias("pii_entities"),
        F.coalesce(g("$.caching.enabled", "boolean"), F.lit(True)).alias("caching_enabled"),
        F.coalesce(g("$.caching.ttl_seconds", "bigint"), F.lit(3600).cast("bigint")).alias("cache_ttl"),
        g("$.model_routing", "array<struct<condition:string,model:string>>").alias("model_routing"),
        g("$.logging", "map<string,variant>").alias("logging"),
    )


def active_policy(policies: DataFrame, requested: str | None = None) -> DataFrame:
    """P10: the named policy if present (even when disabled); else the first
    enabled one (missing 'enabled' counts as true; order by name, D4); else
    'default'; else nothing."""
    s = settings(policies)
    name_hit = F.lit(requested).isNotNull() & (F.col("policy_name") == F.lit(requested))
    ranked = s.where(name_hit | F.col("enabled") | (F.col("policy_name") == "default"))
    order = [F.when(name_hit, 0).when(F.col("enabled"), 1).otherwise(2), F.col("policy_name")]
    return ranked.orderBy(*order).limit(1)


def with_policies(requests: DataFrame, policies: DataFrame, wanted: str) -> DataFrame:
    """Each request with the settings of the policy it names, or of the
    active one (P10 without a name) when there is no such policy. Policies
    are unique by name; the default is one row, found once."""
    s = settings(policies)
    first = active_policy(policies).select("policy_name").first()  # one name, read on the driver like any configuration
    names = s.select(F.col("policy_name").alias("_named"))
    r = requests.join(names, F.col(wanted) == F.col("_named"), "left")
    r = r.withColumn("_use", F.coalesce("_named", F.lit(first[0] if first else None).cast("string")))
    return r.join(s, F.col("_use") == s["policy_name"], "left").drop("_named", "_use")


def policy_changed(policies: DataFrame, last_loaded) -> Column:
    """P12 as an aggregate: any file modified after the last load."""
    return F.max(F.col("modified")) > F.lit(last_loaded)


VERSION_SCHEMA = "policy_name string, json string, modified timestamp, loaded_at timestamp, version int"


def read_versions(spark: SparkSession, table: str) -> DataFrame:
    """The versioned policy table: (policy_name, doc, modified, loaded_at, version); a version holds all policies of its load."""
    return spark.read.schema(VERSION_SCHEMA).parquet(table).withColumn("doc", F.parse_json("json")).drop("json")


def refresh_versions(spark: SparkSession, directory: str, table: str) -> int:
    """The number of the version in force. Only the files' names and times are listed; when one was modified
    after the last load (P12), added or removed, the policies are read and become the next version, a folder that
    nothing else writes. A directory without policies gives the built-in default (S4)."""
    import datetime as dt

    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.yaml").load(directory)
             .select("path", F.col("modificationTime").alias("modified")))  # the contents are not read
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(table)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    last = None
    if fs.exists(path):
        last = (spark.read.schema(VERSION_SCHEMA + ", files bigint").parquet(table).groupBy("version")
                .agg(F.max("modified").alias("modified"), F.max("files").alias("files")).orderBy(F.desc("version")).first())
    if last is not None:
        now = files.agg(F.coalesce(policy_changed(files, last.modified), F.lit(False)).alias("changed"), F.count(F.lit(1)).alias("n")).first()
        if not now.changed and now.n == last.files:
            return last.version
    version = 0 if last is None else last.version + 1
    count = files.agg(F.count(F.lit(1)).alias("n"), F.max("modified").alias("newest")).first()
    policies = with_fallback(read_policies(spark, directory), spark)
    (policies.select("policy_name", F.to_json("doc").alias("json"), F.coalesce(F.lit(count.newest).cast("timestamp"), F.col("modified")).alias("modified"),
                     F.lit(dt.datetime.now(dt.timezone.utc)).alias("loaded_at"), F.lit(count.n).cast("bigint").alias("files"))
     .write.mode("overwrite").parquet(f"{table}/version={version}"))
    return version


def with_versions(requests: DataFrame, versions: DataFrame, wanted: str) -> DataFrame:
    """Each request with the settings of the policy it names in its ``policy_version``, or of that version's active
    one (P10 without a name) when there is no such policy."""
    s = settings(versions)
    order = F.when(F.col("enabled"), 0).when(F.col("policy_name") == "default", 1)
    first = s.where(order.isNotNull()).groupBy("version").agg(F.min(F.struct(order.alias("o"), "policy_name"))["policy_name"].alias("_first"))
    named = s.select("version", F.col("policy_name").alias("_named"))
    r = requests.join(named, (F.col("policy_version") == named["version"]) & (F.col(wanted) == F.col("_named")), "left").drop("version")
    r = r.join(first, F.col("policy_version") == first["version"], "left").drop("version")
    r = r.withColumn("_use", F.coalesce("_named", "_first"))
    return r.join(s, (F.col("policy_version") == s["version"]) & (F.col("_use") == s["policy_name"]), "left").drop("_named", "_first", "_use", "version")


def with_policies_as_of(requests: DataFrame, versions: DataFrame, wanted: str, ts: str = "ts") -> DataFrame:
    """T11 / J4 as of each request's time: the version loaded last at or before it (before the first load, the first).
    An as-of join by a search in the load times, of which there is one per change of the configuration; the settings
    then come by an equi-join on version and name."""
    loads = versions.groupBy("version").agg(F.min("loaded_at").alias("at")).orderBy("at", "version").collect()  # one row per load
    if not loads:
        raise ValueError("the policy table has no version")
    # loads are in order, so the version is found by counting those at or before the time
    at = F.array(*[F.lit(r["at"]).cast("timestamp") for r in loads])
    before = F.size(F.filter(at, lambda x: x <= F.col(ts).cast("timestamp")))
    which = F.element_at(F.array(*[F.lit(r["version"]) for r in loads]), F.greatest(before, F.lit(1)))
    return with_versions(requests.withColumn("policy_version", which), versions, wanted)


_COMPARISON = re.compile(r"""\s*(?:request\.)?([A-Za-z_]\w*)\s*(<=|>=|==|!=|<|>|=)\s*(?:(-?\d+(?:\.\d+)?)|'([^']*)'|"([^"]*)")\s*\Z""")
_COMPARE = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
            "=": lambda a, b: a == b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b}


def condition(text: str) -> Column:
    """A routing condition: comparisons of a request's field with a number or a quoted text, joined by ``and`` and
    ``or``. Nothing else of a policy's text is run; another form is an error."""
    def one(part: str) -> Column:
        m = _COMPARISON.match(part)
        if m is None:
            raise ValueError(f"not a routing condition: {text!r}")
        field, op, number, *quoted = m.groups()
        value = F.lit(Decimal(number)) if number is not None else F.lit(next(q for q in quoted if q is not None))
        return _COMPARE[op](F.col(field), value)

    either = [reduce(lambda a, b: a & b, map(one, re.split(r"\band\b", part, flags=re.IGNORECASE))) for part in re.split(r"\bor\b", text, flags=re.IGNORECASE)]
    return reduce(lambda a, b: a | b, either)


def _sql_condition(cond: str) -> str:
    return cond.replace("request.", "")


def route_model(rules: list[tuple[str, str]], requested: Column | None = None) -> Column:
    """Ordered rules, first match wins, 'default' last (see ``condition``)."""
    out = None
    default = None
    for cond, model in rules:
        if cond == "default":
            default = F.lit(model)
            continue
        pred = F.coalesce(condition(cond), F.lit(False))
        out = F.when(pred, F.lit(model)) if out is None else out.when(pred, F.lit(model))
    fallback = default if default is not None else (requested if requested is not None else F.lit(None))
    return fallback if out is None else out.otherwise(fallback)


def sql_route(rules: list[tuple[str, str]]) -> str:
    whens = " ".join(f"WHEN coalesce({_sql_condition(c)}, false) THEN '{m}'" for c, m in rules if c != "default")
    default = next((f"'{m}'" for c, m in rules if c == "default"), "NULL")
    return f"CASE {whens} ELSE {default} END"


def log_policy_mask(log: DataFrame, log_requests: bool = True, log_responses: bool = False,
                    log_costs: bool = True, log_pii: bool = True, retention_days: int | None = None,
                    as_of: str | None = None, request_cols=("prompt", "messages"),
                    response_cols=("response_text", "choices"), cost_cols=("cost",),
                    pii_cols=("pii_findings", "request_findings", "response_findings")) -> DataFrame:
    """Keep or null out request, response, cost and PII columns per the
    logging flags; drop rows older than the retention."""
    d = log
    for flag, cols in ((log_requests, request_cols), (log_responses, response_cols),
                       (log_costs, cost_cols), (log_pii, pii_cols)):
        for c in cols:
            if c in d.columns and not flag:
                d = d.withColumn(c, F.lit(None).cast(d.schema[c].dataType))
    if retention_days is not None and as_of is not None:
        d = d.where(F.col("ts") >= F.date_sub(F.to_date(F.lit(as_of)), retention_days - 1))
    return d

