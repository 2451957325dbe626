"""Reports and the query interface over observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import trust_class
from ..functions.params import json_leaves, well_formed
from ..functions.redact import redact_api_body, report_headers
from ..functions.urls import content_flags, content_parameter, normalize_url, parses, part, query_pairs, scheme
from .export import with_representatives


def requests_for(requests: DataFrame, crawl_id: str, method: str | None = None) -> DataFrame:
    rows = requests.where(F.col("crawl_id") == crawl_id)
    rows = rows if method is None else rows.where(F.upper("method") == method.upper())
    return rows.orderBy("created_at", "id")


def request_detail(requests: DataFrame, crawl_id: str, request_id: str) -> DataFrame:
    """One request of one crawl, its body redacted; an id of another crawl is not found."""
    rows = requests.where((F.col("crawl_id") == crawl_id) & (F.col("id") == request_id))
    return rows.withColumns({"body": redact_api_body(F.col("body")), "headers": report_headers(F.col("headers"))})


def crawl_status(runs: DataFrame, crawl_id: str) -> DataFrame:
    return runs.where(F.col("id") == crawl_id)


def assets(links: DataFrame, analyzed: DataFrame) -> DataFrame:
    """Links of pages and representatives of the inventory, as one list without deduplication."""
    found = links.select(F.lit("crawler").alias("tool"), F.lit("standard").alias("mode"), "url", F.lit("GET").alias("method"), F.col("kind").alias("source"), F.lit("DISCOVERED_CANDIDATE").alias("trust_class"))
    seen = with_representatives(analyzed, "url", "method", "source_type", "lifecycle_state", "cdp_request_id").select(F.lit("browser").alias("tool"), F.lit("browser").alias("mode"), "url", F.upper("method").alias("method"), F.col("source_type").alias("source"), trust_class().alias("trust_class"))
    return found.unionByName(seen, allowMissingColumns=True)


def coverage(assets_: DataFrame) -> DataFrame:
    return assets_.groupBy("tool", "mode").agg(
        F.count(F.lit(1)).alias("raw_assets"), F.count_if(F.col("trust_class") == "CONFIRMED_BROWSER_REQUEST").alias("confirmed_requests"), F.array_join(F.array_sort(F.collect_set("method")), "|").alias("methods")
    )


def coverage_metrics(assets_: DataFrame) -> DataFrame:
    """Metric by system: a row a metric, a column a tool, from one aggregate."""
    per = assets_.groupBy("tool").agg(
        F.count(F.lit(1)).alias("raw_assets"), F.count_if(F.col("trust_class") == "CONFIRMED_BROWSER_REQUEST").alias("confirmed_requests"), F.count_distinct("url").alias("unique_urls"),
        F.array_size(F.collect_set("method")).cast("long").alias("methods"),
    )
    long = per.unpivot("tool", ["raw_assets", "confirmed_requests", "unique_urls", "methods"], "metric", "value")
    return long.groupBy("metric").pivot("tool", ["crawler", "browser"]).agg(F.first("value"))


def workflow_yield(captured_: DataFrame) -> DataFrame:
    """What each task found that no other task (or request without one) did.  One pass: a row of each request, endpoint and
    schema goes to its key, where the smallest and largest task say whether it is alone."""
    kinds = {"request": "id", "endpoint": "identity", "schema": "schema_hash"}
    found = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("key")) for k, c in kinds.items())))
    per = captured_.select("task_id", found.alias("x")).groupBy("x.kind", "x.key").agg(F.min("task_id").alias("task_id"), F.max("task_id").alias("other"))
    return per.where("task_id = other AND task_id <> ''").groupBy("task_id").agg(
        F.count_if(F.col("kind") == "request").alias("application_request_count"), F.count_if(F.col("kind") == "endpoint").alias("new_endpoint_count"), F.count_if(F.col("kind") == "schema").alias("new_schema_count")
    )


#: What two findings share that are the same finding.
FINDING_KEY = ("category", "method", "origin", "endpoint_template", "parameter", "rule", "authentication_context")


def findings(raw: DataFrame) -> DataFrame:
    """The last finding of each key, with a normalised severity and a hash for its payload."""
    rows = raw.withColumns({"severity_normalized": F.lower("severity_raw"), "payload_hash": F.sha2("payload", 256)}).drop("payload")
    every = [c for c in rows.columns if c not in FINDING_KEY]
    return rows.groupBy(*FINDING_KEY).agg(F.max_by(F.struct(*every), "seen").alias("r")).select(*FINDING_KEY, "r.*")


def claims(submits: DataFrame, candidates: DataFrame, keys: list[str], ttl_seconds: int) -> DataFrame:
    """submit_id and claim_id: a candidate with the keys of a submission, at most ``ttl_seconds`` behind it, is claimed by the
    latest such submission, and a submission claims the first of its candidates; so each is used at most once.

    Time is cut into buckets of ``ttl_seconds``, and a submission goes to its own and the next: the join is dealt by keys and
    bucket, so that a user with a third of all rows is spread over time.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    bucket = lambda c: F.floor(micros(c) / (ttl_seconds * 1_000_000))
    open_ = submits.withColumn("bucket", F.explode(F.array(bucket("submit"), bucket("submit") + 1)))
    hit = open_.join(candidates.withColumn("bucket", bucket("at")), [*keys, "bucket"])
    hit = hit.where((F.col("at") >= F.col("submit")) & (micros("at") <= micros("submit") + ttl_seconds * 1_000_000))
    own = hit.groupBy("claim_id").agg(F.max_by("submit_id", F.struct("submit", "submit_id")).alias("submit_id"), F.first("at").alias("at"))
    return own.groupBy("submit_id").agg(F.min_by("claim_id", F.struct("at", "claim_id")).alias("claim_id"))


def run_states(events: DataFrame) -> DataFrame:
    """Current state, times and error text of each run from its log (id, state, at, event_id, message)."""
    return events.groupBy("id").agg(
        F.max_by("state", F.struct("at", "event_id")).alias("status"), F.min(F.when(F.col("state") == "queued", F.col("at"))).alias("created_at"), F.min(F.when(F.col("state") == "running", F.col("at"))).alias("started_at"),
        F.max(F.when(F.col("state").isin("completed", "failed"), F.col("at"))).alias("completed_at"), F.max_by("message", F.when(F.col("state") == "failed", F.struct("at", "event_id"))).alias("error"),
    )


def allowed_origins(origins: DataFrame) -> DataFrame:
    """Whether an origin is http(s) without user, path, query or fragment, and listed once."""
    once = origins.groupBy("origin").agg(F.count(F.lit(1)).alias("n"))
    return origins.join(once, "origin").withColumn("allowed", origin_ok(F.col("origin")) & (F.col("n") == 1))


def origin_ok(origin: Column) -> Column:
    return F.coalesce(origin.rlike(r"^https?://[^/?#@]+\z"), F.lit(False))


def feed_error(auth_type: Column, username: Column, password: Column, role_id: Column, start_url: Column, origins: Column) -> Column:
    """Why a crawl order is refused; null if it is not.  A null ``auth_type`` orders no login; without origins the start's own
    is allowed.  (The codes are fixed values.)"""
    kind, there = F.lower(F.trim(auth_type)), lambda c: F.coalesce(c, F.lit("")) != ""
    start = F.concat(scheme(start_url), F.lit("://"), part(start_url, 2))
    allowed = F.when(F.size(F.coalesce(origins, F.array().cast("array<string>"))) == 0, F.array(start)).otherwise(origins)
    return (
        F.when((kind == "none") & (there(username) | there(password) | there(role_id)), "AUTH_MODE_CONFLICT")
        .when((kind == "form") & ~(there(username) & there(password) & ~there(role_id)), "AUTH_MODE_INVALID")
        .when((kind == "session_manager_cdp") & ~(there(role_id) & ~there(username) & ~there(password)), "AUTH_MODE_INVALID")
        .when(kind.isNotNull() & ~kind.isin("none", "form", "session_manager_cdp"), "AUTH_MODE_INVALID")
        .when(~parses(start_url) | ~scheme(start_url).isin("http", "https") | F.contains(part(start_url, 2), F.lit("@")), "INVALID_URL")
        .when(F.exists(allowed, lambda o: ~origin_ok(o)), "INVALID_ORIGIN")
        .when(F.size(F.array_distinct(allowed)) < F.size(allowed), "INVALID_ORIGIN")
        .when(~F.array_contains(allowed, start), "INVALID_ORIGIN")
    )


def has_fields(body: Column, content_type: Column, names: list[str]) -> Column:
    """Whether every name has a value that is not blank: of a member anywhere in JSON, of a form pair (the last of several
    counts), of a multipart field.  With no names there is nothing to miss."""
    flags, pairs, leaves = content_flags(content_type), query_pairs(body), json_leaves(F.when(content_flags(content_type)["is_json"], body))
    mark = content_parameter(content_type, "boundary")
    fields = F.transform(
        F.filter(F.split(body, F.concat(F.lit("--"), F.regexp_replace(mark, "([^A-Za-z0-9])", r"\\$1"))), lambda x: F.contains(x, F.lit("\r\n\r\n"))),
        lambda x: F.struct(F.regexp_extract(F.substring_index(x, "\r\n\r\n", 1), '(?i)[; ]name="([^"]*)"', 1).alias("k"), F.regexp_replace(x, r"(?s)^.*?\r\n\r\n", "").alias("v")),
    )
    last = lambda found, n: F.coalesce(F.trim(F.translate(F.try_element_at(F.filter(found, lambda p: p["k"] == n), F.lit(-1))["v"], "\r\n\t", "   ")) != "", F.lit(False))
    there = lambda n: F.coalesce(F.exists(leaves, lambda x: (x["name"] == n) & ~x["blank"]), F.lit(False))
    out = F.lit(True)
    for n in names:
        out = out & F.when(flags["is_json"], there(n)).when(flags["is_urlencoded"], well_formed(body) & last(pairs, n)).when(flags["is_multipart"] & (mark != ""), last(fields, n)).otherwise(False)
    return out


def _label(text: Column) -> Column:
    """A button's words without case, dots and the ending of its busy form, so that "Signing in..." is "Sign in"."""
    return F.array_join(F.transform(F.split(F.lower(F.trim(F.regexp_replace(text, r"[.\u2026]+\s*$", ""))), r"\s+"), lambda w: F.regexp_replace(w, "(?<=..)(ing|e)$", "")), " ")


def form_fingerprint(url: Column, container: Column, step: Column, fields: Column, submit: Column) -> Column:
    """Identity of a form's state: page, container, step, fields (an array of structs) and what the submit button says.  The
    layout is our own."""
    return F.sha2(F.concat_ws("\0", F.lit("form"), normalize_url(url), F.coalesce(container, F.lit("")), F.coalesce(step, F.lit("")), F.to_json(F.struct(fields.alias("f"))), _label(F.coalesce(submit, F.lit("")))), 256)


def control_fingerprint(url: Column, kind: Column, label: Column, record: Column) -> Column:
    """Identity of a control: page, kind, label and the record it acts on.  Selectors, document ids and states that come and go
    (expanded, selected) are no part of it."""
    return F.sha2(F.concat_ws("\0", F.lit("control"), normalize_url(url), F.coalesce(kind, F.lit("")), _label(F.coalesce(label, F.lit(""))), F.coalesce(record, F.lit(""))), 256)
