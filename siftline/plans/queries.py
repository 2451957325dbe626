"""Named queries over the driver tables, and the DuckDB SQL of each.

Every entry of QUERIES takes (spark, sf_dir).  Queries over whole observations share one analysis plan; Catalyst prunes
what a query does not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import params as P
from ..functions import redact as R
from ..functions import urls as U
from ..operators import export, inventory, report, sessions
from ..sources import bridge, files
from ..sources.files import spread
from . import oracle as O
from .oracle import sql

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, select: str | None = None, *ctes: str):
    def add(f):
        QUERIES[name] = f
        if select is not None:
            ORACLE[name] = sql(select, *ctes)
        return f

    return add


def obs(spark: SparkSession, d: str) -> DataFrame:
    return U.with_url(bridge.observations(spark, d))


def analyzed(spark: SparkSession, d: str) -> DataFrame:
    return inventory.analyze(bridge.observations(spark, d))


# -- URLs, headers, content types

LINKS = f"""pg AS (SELECT page_id, 'page' AS kind, url AS target, url AS page FROM pages UNION ALL SELECT page_id, 'anchor', unnest(regexp_extract_all(html, '{bridge.PAGE_HREF}', 1)), url FROM pages
 UNION ALL SELECT page_id, 'script', unnest(regexp_extract_all(html, '<script[^>]* src="([^"]*)"', 1)), url FROM pages),
links AS (SELECT page_id, kind, CASE WHEN starts_with(target, '/') AND NOT starts_with(target, '//') THEN concat(array_to_string(string_split(page, '/')[1:3], '/'), target) ELSE target END AS url FROM pg),
lu AS (SELECT *, {O.URL_COLUMNS} FROM links), lo AS (SELECT *, {O.ORIGIN} AS origin FROM lu)"""


@query("page_endpoints", "SELECT origin, template AS endpoint_template, count(*) AS observation_count, array_to_string(list_sort(list(DISTINCT kind)), '|') AS kinds, sha256(concat_ws(chr(0), origin, 'GET', template, 'ANONYMOUS', '', '', '')) AS endpoint_identity FROM lo GROUP BY origin, template", LINKS)
def page_endpoints(spark, d):
    """Endpoints of all pages and links: the flagship query."""
    links = bridge.page_links(spark, d).select("kind", U.request_origin(F.col("url")).alias("origin"), U.endpoint_template(F.col("url")).alias("endpoint_template"))
    got = links.groupBy("origin", "endpoint_template").agg(F.count(F.lit(1)).alias("observation_count"), F.array_join(F.array_sort(F.collect_set("kind")), "|").alias("kinds"))
    key = F.concat_ws("\0", "origin", F.lit("GET"), "endpoint_template", F.lit("ANONYMOUS"), F.lit(""), F.lit(""), F.lit(""))
    return got.withColumn("endpoint_identity", F.sha2(key, 256))


@query("page_links", "SELECT page_id, kind, url FROM links WHERE kind <> 'script'", LINKS)
def page_links(spark, d):
    return bridge.page_links(spark, d).where("kind <> 'script'")


@query("page_scripts", "SELECT page_id, len(regexp_extract_all(html, '<script')) AS scripts, len(regexp_extract_all(html, '(?:fetch|import)\\(')) AS calls, contains(html, '<form') AS has_form FROM pages")
def page_scripts(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet")
    count = lambda p: F.size(F.regexp_extract_all("html", F.lit(p), F.lit(0))).cast("long")
    return pages.select("page_id", count("<script").alias("scripts"), count(r"(?:fetch|import)\(").alias("calls"), F.contains("html", F.lit("<form")).alias("has_form"))


@query("endpoint_template", "SELECT id, template FROM v", *O.V)
def endpoint_template(spark, d):
    return obs(spark, d).select("id", "template")


@query("request_origin", "SELECT id, origin, array_to_string(string_split(url, '/')[1:3], '/') AS origin_text FROM v", *O.V)
def request_origin(spark, d):
    return obs(spark, d).select("id", "origin", U.origin_of(F.col("url")).alias("origin_text"))


_NORMAL = "concat(CASE WHEN u_scheme <> '' THEN concat(u_scheme, '://') ELSE '' END, u_host, CASE WHEN u_port <> '' AND NOT (u_scheme = 'https' AND u_port = '443') AND NOT (u_scheme = 'http' AND u_port = '80') THEN concat(':', u_port) ELSE '' END, regexp_replace(raw_path, '/+\\z', ''), CASE WHEN nq <> '' THEN concat('?', nq) ELSE '' END)"
_NQ = "nq AS (SELECT *, array_to_string(list_sort(list_filter(string_split(u_query, '&'), lambda x: x <> '')), '&') AS nq FROM v)"


@query("normalize_url", f"SELECT id, {_NORMAL} AS normalized_url FROM nq", *O.V, _NQ)
def normalize_url(spark, d):
    return obs(spark, d).select("id", U.normalize_url(F.col("url")).alias("normalized_url"))


_FORM_BODY = "array_to_string(list_sort(string_split(body, '&')), '&')"
_CANON = f"CASE WHEN contains(mt, 'json') AND coalesce(json_type({O._JSON}) = 'OBJECT', false) THEN {O.canonical(f'CAST({O._JSON} AS JSON)')} WHEN mt = 'application/x-www-form-urlencoded' THEN {_FORM_BODY} ELSE body END"


@query("request_fingerprint", f"SELECT id, sha256(concat_ws(chr(0), m, {_NORMAL}, {_CANON}, mt)) AS fingerprint FROM (SELECT *, lower(trim(split_part(content_type, ';', 1))) AS mt FROM nq)", *O.V, _NQ)
def request_fingerprint(spark, d):
    df = bridge.observations(spark, d)
    ct = U.header_value(F.col("headers"), "content-type")
    canonical = P.canonical_json(F.when(F.contains(U.media_type(ct), F.lit("json")), F.col("body")))
    return df.select("id", U.fingerprint(F.col("method"), F.col("url"), F.col("body"), ct, canonical).alias("fingerprint"))


@query("short_hash", "SELECT id, left(sha256(id), 16) AS short_hash FROM obs", *O.V)
def short_hash(spark, d):
    return bridge.observations(spark, d).select("id", U.short_hash(F.col("id")).alias("short_hash"))


@query("query_cleanup", "SELECT id, concat(regexp_replace(url, '(?s)[?#].*\\z', ''), CASE WHEN r <> '' THEN concat('?', r) ELSE '' END, CASE WHEN u_fragment <> '' THEN concat('#', u_fragment) ELSE '' END) AS url FROM (SELECT *, array_to_string(list_filter(string_split(u_query, '&'), lambda x: split_part(x, '=', 1) <> '_rsc'), '&') AS r FROM v)", *O.V)
def query_cleanup(spark, d):
    return obs(spark, d).select("id", U.drop_query_key(F.col("url"), "_rsc").alias("url"))


@query("header_value", "SELECT id, content_type, accept, \"authorization\" <> '' AS has_authorization FROM obs", *O.V)
def header_value(spark, d):
    h = F.col("headers")
    return bridge.observations(spark, d).select("id", U.header_value(h, "CONTENT-TYPE").alias("content_type"), U.header_value(h, "accept").alias("accept"), (U.header_value(h, "authorization") != "").alias("has_authorization"))


_MEDIA = "ct AS (SELECT id, content_type, lower(trim(split_part(content_type, ';', 1))) AS mt FROM obs)"
_IS = "contains(mt, 'json') OR contains(mt, 'xml') OR contains(mt, 'graphql') OR starts_with(mt, 'text/')"
_FORMS = "mt IN ('multipart/form-data', 'application/x-www-form-urlencoded')"


@query("content_type_flags", f"""SELECT id, split_part(mt, '/', 1) AS primary_type, split_part(mt, '/', 2) AS sub_type, regexp_extract(content_type, '(?i);\\s*charset="?([^";\\s]+)', 1) AS charset, regexp_extract(content_type, '(?i);\\s*boundary="?([^";\\s]+)', 1) AS boundary,
 contains(mt, 'json') AS is_json, contains(mt, 'xml') AS is_xml, contains(mt, 'graphql') AS is_graphql, starts_with(mt, 'multipart/') AS is_multipart, mt = 'application/x-www-form-urlencoded' AS is_urlencoded, {_FORMS} AS is_form, ({_IS}) AS is_text, mt <> '' AND NOT ({_IS}) AND NOT {_FORMS} AS is_binary FROM ct""", *O.V, _MEDIA)  # fmt: skip
def content_type_flags(spark, d):
    return bridge.observations(spark, d).select("id", U.content_flags(U.header_value(F.col("headers"), "Content-Type")).alias("f")).select("id", "f.*")


@query("body_type", f"SELECT id, CASE WHEN contains(mt, 'json') THEN 'json' WHEN starts_with(mt, 'multipart/') THEN 'multipart' WHEN mt = 'application/x-www-form-urlencoded' THEN 'form-urlencoded' WHEN contains(mt, 'graphql') THEN 'graphql' WHEN contains(mt, 'xml') THEN 'xml' WHEN {_IS} THEN 'text' ELSE 'binary' END AS body_type FROM ct", *O.V, _MEDIA)
def body_type(spark, d):
    return bridge.observations(spark, d).select("id", U.body_type(U.header_value(F.col("headers"), "Content-Type")).alias("body_type"))


@query("json_requests", "SELECT id, coalesce(json_type(CASE WHEN json_valid(body) THEN body END) = 'OBJECT', false) AS is_json FROM ct JOIN obs USING (id) WHERE contains(mt, 'json') AND body <> ''", *O.V, _MEDIA)
def json_requests(spark, d):
    f = U.content_flags(U.header_value(F.col("headers"), "Content-Type"))
    return bridge.observations(spark, d).where(f["is_json"] & (F.col("body") != "")).select("id", C.is_json_object(F.col("body")).alias("is_json"))


@query("base64_body", "SELECT event_id, concat(upper(hex(encode(props))), upper(hex(encode(event_type)))) AS body_hex FROM events WHERE event_id % 5 <> 0 UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 5 = 0")
def base64_body(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    tail = F.when(F.col("event_id") % 5 == 0, F.lit("%%%")).otherwise(F.base64(F.col("event_type").cast("binary")))
    return e.select("event_id", U.joined_base64(F.array(F.base64(F.col("props").cast("binary")), F.lit(""), tail)).alias("body_hex"))


# -- names, parameters


@query("query_noise", f"SELECT id, k AS name, {O.noise('k')} AS noise, {O.sensitive('k')} AS sensitive FROM qp", *O.V, O.PAIRS)
def query_noise(spark, d):
    pairs = obs(spark, d).select("id", F.explode(U.query_pairs(F.col("u_query"))).alias("x"))
    return pairs.select("id", F.col("x.k").alias("name"), C.noise_name(F.col("x.k")).alias("noise"), C.sensitive_name(F.col("x.k")).alias("sensitive"))


@query("parameterized_urls", f"SELECT DISTINCT url FROM v JOIN qp USING (id) WHERE m = 'GET' AND NOT {O.noise('k')} AND NOT {O.sensitive('k')}", *O.V, O.PAIRS)
def parameterized_urls(spark, d):
    return obs(spark, d).where((F.upper("method") == "GET") & C.meaningful_query(U.query_pairs(F.col("u_query")))).select("url").distinct()


_PARAM = "SELECT id, path, type, sample_length, eligible FROM params WHERE source = "


def _params(source: str):
    def f(spark, d):
        rows = inventory.request_parameters(analyzed(spark, d))
        return rows.where(F.col("source") == source).select("id", "path", "type", "sample_length", "eligible")

    return f


for _name, _source in (("query_parameters", "query"), ("path_parameters", "path"), ("json_parameters", "json"), ("form_parameters", "form"), ("multipart_parameters", "multipart")):
    query(_name, f"{_PARAM}'{_source}'", O.OBS, O.CLASSIFIED, O.PARAMETERS)(_params(_source))


@query("request_parameters", f"SELECT p.id, inventory_id, source, path, type, sample_length, eligible, task_id <> '' AS crawler_supplied, source = 'path' OR contains(lower(path), 'id') AS application_state, 'UNKNOWN' AS reflection_status, CASE WHEN {O.sensitive('path')} THEN 'sensitive_or_security_parameter' ELSE '' END AS exclusion_reason, sha256(concat_ws(chr(0), 'PARAM', p.id, path, type)) AS parameter_id FROM params p JOIN k ON k.id = p.id", *O.Z)
def request_parameters(spark, d):
    rows = inventory.request_parameters(inventory.captured(analyzed(spark, d)))
    state = (F.col("source") == "path") | F.contains(F.lower("path"), F.lit("id"))
    return rows.select(
        "id", "inventory_id", "source", "path", "type", "sample_length", "eligible", (F.col("task_id") != "").alias("crawler_supplied"), state.alias("application_state"), F.lit("UNKNOWN").alias("reflection_status"),
        F.when(C.sensitive_name(F.col("path")), "sensitive_or_security_parameter").otherwise("").alias("exclusion_reason"), F.sha2(F.concat_ws("\0", F.lit("PARAM"), "id", "path", "type"), 256).alias("parameter_id"),
    )


@query("infer_type", f"SELECT event_id, v, {O.infer('v')} AS type FROM (SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'true' WHEN 1 THEN CAST(event_id AS VARCHAR) WHEN 2 THEN concat('+', CAST(event_id AS VARCHAR)) WHEN 3 THEN concat('-.', CAST(event_id AS VARCHAR)) WHEN 4 THEN concat(CAST(event_id AS VARCHAR), 'e5') WHEN 5 THEN concat(' ', CAST(event_id AS VARCHAR)) WHEN 6 THEN concat(CAST(event_id AS VARCHAR), '9999999999999999999') ELSE event_type END AS v FROM events)")
def infer_type(spark, d):
    e, t = spark.read.parquet(f"{d}/events.parquet"), F.col("event_id").cast("string")
    forms = [F.lit("true"), t, F.concat(F.lit("+"), t), F.concat(F.lit("-."), t), F.concat(t, F.lit("e5")), F.concat(F.lit(" "), t), F.concat(t, F.lit("9999999999999999999")), F.col("event_type")]
    v = F.element_at(F.array(*forms), (F.col("event_id") % 8 + 1).cast("int"))
    return e.select("event_id", v.alias("v")).withColumn("type", P.infer_type(F.col("v")))


@query("graphql_fields", "SELECT id, gql_name, gql_type, gql_hash FROM z WHERE gql_hash <> ''", *O.Z)
def graphql_fields(spark, d):
    return analyzed(spark, d).where("gql_hash <> ''").select("id", "gql_name", "gql_type", "gql_hash")


_LAST_FIELD = "SELECT id, last(v ORDER BY i) AS v FROM fp WHERE k = 'name' GROUP BY id UNION ALL SELECT id, last(val ORDER BY i) FROM mq WHERE name = 'note' GROUP BY id UNION ALL SELECT jb.id, max(j.atom->>'$') FROM jb, json_tree(jb.j) j WHERE j.key = 'id' AND j.type NOT IN ('OBJECT', 'ARRAY', 'NULL') AND trim(j.atom->>'$') <> '' GROUP BY jb.id"


@query("required_fields", f"SELECT id, coalesce(trim(v), '') <> '' AS complete FROM c LEFT JOIN ({_LAST_FIELD}) USING (id) WHERE {O._IS_JSON} OR {O._FORM} OR {O._MULTI}", O.OBS, O.CLASSIFIED, O.PARAMETERS)
def required_fields(spark, d):
    """Whether forms have a name, multipart bodies a note and JSON an id, at any depth."""
    df, ct = bridge.observations(spark, d), U.header_value(F.col("headers"), "Content-Type")
    flags = U.content_flags(ct)
    done = [F.when(flags[kind], report.has_fields(F.col("body"), ct, [name])) for kind, name in (("is_json", "id"), ("is_urlencoded", "name"), ("is_multipart", "note"))]
    return df.where(flags["is_json"] | flags["is_urlencoded"] | flags["is_multipart"]).select("id", F.coalesce(*done).alias("complete"))


@query("feed_validation", """SELECT page_id, CASE WHEN t = 'none' AND (u <> '' OR r <> '') THEN 'AUTH_MODE_CONFLICT' WHEN t = 'form' AND (u = '' OR r <> '') THEN 'AUTH_MODE_INVALID' WHEN t = 'session_manager_cdp' AND (r = '' OR u <> '') THEN 'AUTH_MODE_INVALID' WHEN t = 'other' THEN 'AUTH_MODE_INVALID'
 WHEN starts_with(s, 'ftp') OR contains(s, '@') THEN 'INVALID_URL' WHEN page_id % 3 = 1 AND page_id % 7 IN (1, 2) THEN 'INVALID_ORIGIN' WHEN page_id % 3 = 2 THEN 'INVALID_ORIGIN' END AS error
 FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'form' WHEN 2 THEN 'session_manager_cdp' WHEN 3 THEN 'other' END AS t, CASE WHEN page_id % 4 < 2 THEN 'user' ELSE '' END AS u, CASE WHEN page_id % 2 = 0 THEN 'role' ELSE '' END AS r,
  CASE page_id % 11 WHEN 0 THEN 'ftp://a.example.test/' WHEN 1 THEN 'https://u:p@a.example.test/' ELSE 'https://a.example.test/x' END AS s FROM pages)""")
def feed_validation(spark, d):
    n = F.col("page_id")
    kind = F.when(n % 5 == 0, " None").when(n % 5 == 1, "form").when(n % 5 == 2, "session_manager_cdp").when(n % 5 == 3, "other")
    user, role = F.when(n % 4 < 2, "user").otherwise(""), F.when(n % 2 == 0, "role").otherwise("")
    start = F.when(n % 11 == 0, "ftp://a.example.test/").when(n % 11 == 1, "https://u:p@a.example.test/").otherwise("https://a.example.test/x")
    own, other = F.lit("https://a.example.test"), F.lit("https://b.example.test")
    origins = F.when(n % 3 == 0, F.array().cast("array<string>")).when((n % 3 == 1) & (n % 7 == 1), F.array(own, own)).when((n % 3 == 1) & (n % 7 == 2), F.array(own, F.lit("https://a.example.test/path"))).when(n % 3 == 1, F.array(own, other)).otherwise(F.array(other))
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", report.feed_error(kind, user, user, role, start, origins).alias("error"))


@query("guard_rows", "SELECT id, 'UNKNOWN' AS classification, 'NOT_REPLAYABLE' AS replayability, CASE WHEN event_id % 50 = 0 THEN 'nil_request' ELSE 'blocked_by_policy' END AS reason, 0 AS parameters FROM obs WHERE event_id % 50 = 0 OR source_type = 'cdp_policy_blocked' OR lifecycle_state = 'blocked_by_policy'", *O.V)
def guard_rows(spark, d):
    """What no rule looks at; a row without URL and method stands for no request."""
    gone = F.col("event_id") % 50 == 0
    return inventory.guard(bridge.observations(spark, d).withColumns({c: F.when(~gone, F.col(c)) for c in ("url", "method")}))


# -- classes, policy, eligibility


@query("classify_request", "SELECT id, classification FROM c", *O.C)
def classify_request(spark, d):
    return obs(spark, d).select("id", F.when(C.blocked(), "UNKNOWN").otherwise(C.classify()).alias("classification"))


@query("classification_counts", "SELECT classification, count(*) AS n FROM c GROUP BY classification", *O.C)
def classification_counts(spark, d):
    return classify_request(spark, d).groupBy("classification").agg(F.count(F.lit(1)).alias("n"))


@query("auth_context", "SELECT id, auth FROM c", *O.C)
def auth_context(spark, d):
    return bridge.observations(spark, d).select("id", C.auth_context().alias("auth"))


@query("replayability", "SELECT id, replayability, array_to_string(reasons, ',') AS reasons FROM z", *O.Z)
def replayability(spark, d):
    return analyzed(spark, d).select("id", "replayability", F.array_join("reasons", ",").alias("reasons"))


@query("eligibility", "SELECT id, request_eligible, query_eligible, request_reason, query_reason FROM z", *O.Z)
def eligibility(spark, d):
    return analyzed(spark, d).select("id", "request_eligible", "query_eligible", "request_reason", "query_reason")


CONFIG = C.PolicyConfig(allow_mutations=True, read_only_graphql=(("/GraphQL", ""), ("", "Q1")))


#: What each policy rule says, for the SQL.
_WORDS = {
    "READ_ONLY": "read-only method",
    "LOGOUT_BLOCKED": "logout disabled",
    "RECOVERY_BLOCKED": "recovery disabled",
    "ACCOUNT_CREATION_BLOCKED": "account creation disabled",
    "FILE_UPLOAD_BLOCKED": "file uploads disabled",
    "DELETE_BLOCKED": "destructive actions disabled",
    "GRAPHQL_QUERY": "explicit read-only GraphQL rule",
    "AUTH_EXACT": "exact active authentication request",
    "MUTATION_BLOCKED": "mutations disabled",
    "UNKNOWN_METHOD": "unknown non-read-only method",
    "MUTATIONS_ENABLED": "mutations explicitly enabled",
}


def _policy_sql(config: C.PolicyConfig, exact: str | None = None) -> str:
    js = O._JSON
    ok = f"contains(lower(content_type), 'json') AND json_type({js}) = 'OBJECT'"
    q = f"lower(trim(coalesce(json_extract_string({js}, '$.query'), '')))"
    op = f"CASE WHEN {ok} AND starts_with({q}, 'query') THEN 'query' WHEN {ok} AND starts_with({q}, 'mutation') THEN 'mutation' WHEN {ok} AND starts_with({q}, 'subscription') THEN 'subscription' ELSE '' END"
    rules = " OR ".join(f"(('{e}' = '' OR u_path = '{e}') AND ('{n}' = '' OR name = '{n}'))" for e, n in config.read_only_graphql) or "false"
    lead = [
        ("m IN ('GET', 'HEAD', 'OPTIONS')", "ALLOW", "READ_ONLY", True), (O.has("p", "logout", "session/delete", "device/revoke"), "BLOCK", "LOGOUT_BLOCKED", not config.allow_logout),
        (O.has("p", "forgot", "reset", "password/change"), "BLOCK", "RECOVERY_BLOCKED", not config.allow_recovery), (O.has("p", "register", "signup", "account/create"), "BLOCK", "ACCOUNT_CREATION_BLOCKED", not config.allow_account_creation),
        ("contains(lower(content_type), 'multipart')", "BLOCK", "FILE_UPLOAD_BLOCKED", not config.allow_uploads), ("m = 'DELETE'", "BLOCK", "DELETE_BLOCKED", not config.allow_destructive),
        (f"m = 'POST' AND op = 'query' AND ({rules})", "ALLOW", "GRAPHQL_QUERY", True), (f"m = 'POST' AND {exact}", "ALLOW", "AUTH_EXACT", exact is not None), ("m IN ('POST', 'PUT', 'PATCH', 'DELETE')", "BLOCK", "MUTATION_BLOCKED", not config.allow_mutations),
        ("m NOT IN ('POST', 'PUT', 'PATCH', 'DELETE')", "BLOCK", "UNKNOWN_METHOD", True),
    ]
    when = [(t, a, r) for t, a, r, on in lead if on]
    action, rule = (" ".join(f"WHEN {w[0]} THEN '{w[k]}'" for w in when) for k in (1, 2))
    why = " ".join(f"WHEN {w[0]} THEN '{_WORDS[w[2]]}'" for w in when)
    return f"SELECT id, CASE {action} ELSE 'ALLOW' END AS action, CASE {rule} ELSE 'MUTATIONS_ENABLED' END AS rule_id, CASE {why} ELSE '{_WORDS["MUTATIONS_ENABLED"]}' END AS reason FROM (SELECT *, CASE WHEN op <> '' THEN coalesce(json_extract_string({js}, '$.operationName'), '') ELSE '' END AS name FROM (SELECT *, {op} AS op FROM v))"


@query("policy_decision", _policy_sql(C.PolicyConfig()), *O.V)
def policy_decision(spark, d):
    return bridge.observations(spark, d).select("id", C.policy(C.PolicyConfig()).alias("x")).select("id", "x.*")


_EXACT = "event_id % 3 <> 0 AND event_id % 4 <> 0 AND event_id % 5 <> 0"


@query("policy_exact_authentication", _policy_sql(C.PolicyConfig(), _EXACT), *O.V)
def policy_exact_authentication(spark, d):
    """Requests of a login attempt: under way, exactly its own, and not used yet."""
    n = F.col("event_id")
    rows = bridge.observations(spark, d)
    return rows.select("id", C.policy(C.PolicyConfig(), n % 3 != 0, n % 4 != 0, n % 5 == 0).alias("x")).select("id", "x.*")


@query("policy_graphql_rules", _policy_sql(CONFIG), *O.V)
def policy_graphql_rules(spark, d):
    return bridge.observations(spark, d).select("id", C.policy(CONFIG).alias("x")).select("id", "x.*")


@query("graphql_candidates", "SELECT id, url FROM c WHERE classification = 'GRAPHQL'", *O.C)
def graphql_candidates(spark, d):
    # a generated column: a test of the class itself would be pushed down with all its parts written out, each worked out anew
    rows = obs(spark, d).where(~C.blocked()).select("id", "url", F.explode(F.array(C.classify())).alias("classification"))
    return rows.where("classification = 'GRAPHQL'").select("id", "url")


@query("trust_class", "SELECT id, CASE WHEN source_type = 'cdp_observed' AND lifecycle_state = 'completed' AND cdp_request_id <> '' THEN 'CONFIRMED_BROWSER_REQUEST' ELSE 'DISCOVERED_CANDIDATE' END AS trust_class FROM obs", *O.V)
def trust_class(spark, d):
    return bridge.observations(spark, d).select("id", C.trust_class().alias("trust_class"))


# -- inventory


@query("schema_hash", "SELECT id, array_to_string(shape, '|') AS parameters, schema_hash FROM z WHERE NOT blocked", *O.Z)
def schema_hash(spark, d):
    return analyzed(spark, d).where("NOT blocked").select("id", F.array_join(P.schema_parameters(F.col("parameters")), "|").alias("parameters"), "schema_hash")


@query("endpoint_identity", "SELECT id, identity, inventory_id FROM z WHERE NOT blocked", *O.Z)
def endpoint_identity(spark, d):
    return analyzed(spark, d).where("NOT blocked").select("id", "identity", "inventory_id")


@query("inventory", "SELECT * FROM inv", *O.I)
def inventory_(spark, d):
    return inventory.inventory(analyzed(spark, d))


@query("distinct_bodies", "SELECT inventory_id, distinct_body_count FROM inv", *O.I)
def distinct_bodies(spark, d):
    return inventory_(spark, d).select("inventory_id", "distinct_body_count")


@query("status_code_set", "SELECT inventory_id, status_codes FROM inv", *O.I)
def status_code_set(spark, d):
    return inventory_(spark, d).select("inventory_id", "status_codes")


@query("representative", "SELECT inventory_id, representative_request_id, first_request_id FROM inv", *O.I)
def representative(spark, d):
    return inventory_(spark, d).select("inventory_id", "representative_request_id", "first_request_id")


@query("status_history", "SELECT DISTINCT id, inventory_id, status_code FROM k WHERE status_code IS NOT NULL", *O.Z)
def status_history(spark, d):
    return inventory.captured(analyzed(spark, d)).where("response IS NOT NULL").select("id", "inventory_id", F.col("response.status_code").alias("status_code")).distinct()


@query("last_writer", "SELECT inventory_id, replayability, request_eligible, query_eligible, parameter_paths FROM inv", *O.I)
def last_writer(spark, d):
    return inventory_(spark, d).select("inventory_id", "replayability", "request_eligible", "query_eligible", "parameter_paths")


@query("inventory_listing", "SELECT origin, method, endpoint_template, inventory_id FROM inv", *O.I)
def inventory_listing(spark, d):
    return inventory_(spark, d).select("origin", "method", "endpoint_template", "inventory_id").orderBy("origin", "method", "endpoint_template", "inventory_id")


_HISTORY = (O.OBS_HISTORY, O.CLASSIFIED, O.ANALYZED, O.HISTORY)
_HISTORY_SQL = "SELECT inv.* REPLACE (st.codes AS status_codes) FROM inv JOIN st USING (inventory_id)"


@query("inventory_history", _HISTORY_SQL, *_HISTORY)
def inventory_history(spark, d):
    """Requests that were saved several times: latest body, every status code, first class, last eligibility."""
    return inventory.inventory(inventory.latest(inventory.analyze(bridge.history(spark, d))))


@query("emptied_groups", "SELECT inventory_id FROM z WHERE (source_type = 'cdp' OR starts_with(source_type, 'cdp_')) AND NOT blocked AND lifecycle_state <> 'policy_enforcement_failed' EXCEPT SELECT inventory_id FROM k2", *_HISTORY)
def emptied_groups(spark, d):
    """Groups that their requests have left."""
    return inventory.emptied(inventory.analyze(bridge.history(spark, d)))


@query("rebuild_affected", "SELECT inv.* FROM inv WHERE inventory_id IN (SELECT inventory_id FROM k WHERE lifecycle_state = 'loadingFinished')", *O.I)
def rebuild_affected(spark, d):
    """Groups with a request that has just finished loading, from full rows of the group: one analysis, one aggregate."""
    return inventory.affected(analyzed(spark, d), F.col("lifecycle_state") == "loadingFinished")


@query("orphan_check", "SELECT 'parameters' AS child, count(*) AS orphans FROM (SELECT inventory_id FROM params JOIN k USING (id)) x ANTI JOIN inv USING (inventory_id) UNION ALL SELECT 'observations', count(*) FROM k ANTI JOIN inv USING (inventory_id)", *O.I)
def orphan_check(spark, d):
    """Children without a group; they are counted by key first, so that the anti join has a row a key."""
    a = analyzed(spark, d)
    rows = inventory.captured(a).select("inventory_id", F.posexplode_outer("parameters").alias("ord", "x"))
    children = rows.groupBy("inventory_id").agg(F.count_if(F.coalesce("ord", F.lit(0)) == 0).alias("observations"), F.count("ord").alias("parameters"))
    # a null-safe outer join: an anti join, and the test for null of a plain one, would be pushed down to the requests and
    # work the whole key out once more
    keys = inventory.inventory(a).select(F.col("inventory_id").alias("key"), F.lit(True).alias("there"))
    lost = children.join(keys, F.col("inventory_id").eqNullSafe(F.col("key")), "left").where("there IS NULL")
    sums = lost.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("observations", "parameters")))
    return sums.unpivot([], ["observations", "parameters"], "child", "orphans")


_CAND = "cand AS (SELECT id, inventory_id, replayability, 'REQUEST' AS kind, request_eligible AS eligible, request_reason AS reason FROM k UNION ALL SELECT id, inventory_id, replayability, 'QUERY', query_eligible, query_reason FROM k)"


@query("scanner_candidates", "SELECT * FROM cand", *O.Z, _CAND)
def scanner_candidates(spark, d):
    return inventory.scanner_candidates(analyzed(spark, d))


@query("blocked_exclusion", "SELECT count(*) AS blocked_candidates FROM cand JOIN z USING (id) WHERE blocked", *O.Z, _CAND)
def blocked_exclusion(spark, d):
    a = analyzed(spark, d)
    return inventory.scanner_candidates(a).join(a.where("blocked").select("id"), "id").agg(F.count(F.lit(1)).alias("blocked_candidates"))


# -- exports, always redacted


@query("curated_rows", f"SELECT k.id, m AS method, k.url, inv.endpoint_template, inv.replayability FROM inv JOIN k ON k.id = representative_request_id WHERE inv.request_eligible AND inv.classification IN ({O.texts(O.CANDIDATE_CLASSES)}) AND NOT contains(p, 'refresh-token') AND m IN ('GET', 'HEAD') AND inv.authentication_context = 'ANONYMOUS'", *O.I)
def curated_rows(spark, d):
    return export.curated(analyzed(spark, d), export.Gates()).select("id", F.upper("method").alias("method"), "url", "endpoint_template", "replayability")


_EXPORT = (*O.I, O.REDACTED_QUERY, O.URLS, O.BODIES, O.CURATED)
_NUMBER = "format('request-{:03d}.txt', row_number() OVER (ORDER BY created_at, id)) AS request_filename"


@query("export_numbering", f"SELECT {_NUMBER}, id FROM cur", *_EXPORT)
def export_numbering(spark, d):
    return export.numbered(export.curated(analyzed(spark, d), export.Gates(auth=True, mutations=True))).select("request_filename", "id")


@query("request_replay_rows", "SELECT id, m AS method, url FROM c WHERE (source_type = 'cdp' OR starts_with(source_type, 'cdp_')) AND NOT blocked AND m NOT IN ('GET', 'OPTIONS', 'HEAD') AND classification <> 'FRAMEWORK' AND NOT contains(p, 'refresh-token')", *O.C)
def request_replay_rows(spark, d):
    return export.replay_rows(analyzed(spark, d)).select("id", F.upper("method").alias("method"), "url")


_QC = f"qc AS (SELECT k.id, m AS method, k.url, params.path AS parameter_path, params.type AS sample_type, k.page_url AS source_page, auth = 'AUTHENTICATED' AS auth_required, CASE WHEN auth = 'AUTHENTICATED' THEN 'private_auth_required' ELSE '' END AS exclusion_reason FROM inv JOIN k ON k.id = representative_request_id JOIN params ON params.id = k.id WHERE k.query_eligible AND params.eligible AND params.source = 'query' AND NOT {O.noise('params.path')})"


@query("candidate_rows", "SELECT id, method, parameter_path, sample_type, source_page, auth_required, exclusion_reason FROM qc", *O.I, _QC)
def candidate_rows(spark, d):
    return export.query_candidates(analyzed(spark, d), export.Gates()).select("id", "method", "parameter_path", "sample_type", "source_page", "auth_required", "exclusion_reason")


@query("candidate_urls", "SELECT DISTINCT rurl AS url FROM qc JOIN ru ON ru.id = qc.id WHERE exclusion_reason = ''", *O.I, O.REDACTED_QUERY, O.URLS, _QC)
def candidate_urls(spark, d):
    return export.candidate_urls(export.query_candidates(analyzed(spark, d), export.Gates()))


def _curated(spark, d):
    return export.curated(analyzed(spark, d), export.Gates(auth=True, mutations=True))


_MAP = O.headers("""concat('"$n":', CAST(to_json($v) AS VARCHAR))""", "','", "Content-Type", "Accept", "Authorization")
_LIST = O.headers("""concat('{"key":"$n","value":', CAST(to_json($v) AS VARCHAR), '}')""", "','", "Accept", "Authorization", "Content-Type")
_LINES = O.headers("concat('$n: ', $v, chr(13), chr(10))", "''", "Accept", "Authorization", "Content-Type")
_PATH = """concat('["', array_to_string(string_split(regexp_replace(raw_path, '^/+|/+$', '', 'g'), '/'), '","'), '"]')"""


@query("har_entries", f"""SELECT id, concat('{{"request":{{"method":"', m, '","url":', {O.text("rurl")}, ',"headers":{{', {_MAP}, '}},"postData":{{"mimeType":"', body_type, '","text":', {O.text("rbody")}, '}}}},"response":null}}') AS entry FROM cur""", *_EXPORT)
def har_entries(spark, d):
    return export.har(_curated(spark, d))


@query("postman_items", f"""SELECT id, concat('{{"name":', {O.text("concat(m, ' ', rurl)")}, ',"request":{{"method":"', m, '","header":[', {_LIST}, '],"body":{{"mode":"raw","raw":', {O.text("rbody")}, '}},"url":{{"raw":', {O.text("rurl")}, ',"protocol":"', u_scheme, '","host":["', replace(u_host, '.', '","'), '"],"path":', {_PATH}, '}}}}}}') AS item FROM cur""", *_EXPORT)
def postman_items(spark, d):
    return export.postman(_curated(spark, d))


@query("request_index", f"SELECT {_NUMBER}, id AS request_id, m AS method, rurl AS original_url, endpoint_template, array_to_string(shape, '|') AS parameter_paths, body_type, auth = 'AUTHENTICATED' AS authentication_required, page_url AS source_page, task_id, coalesce(status_code, 0) AS response_status, group_replayability AS replayability, '' AS exclusion_warnings FROM cur", *_EXPORT)
def request_index(spark, d):
    return export.index(_curated(spark, d)).withColumns({c: F.array_join(c, "|") for c in ("parameter_paths", "exclusion_warnings")})


@query("raw_http_text", f"SELECT id, concat(m, ' ', CASE WHEN raw_path = '' THEN '/' ELSE raw_path END, CASE WHEN rquery <> '' THEN concat('?', rquery) ELSE '' END, ' HTTP/1.1', chr(13), chr(10), 'Host: ', authority, chr(13), chr(10), {_LINES}, chr(13), chr(10), rbody) AS text FROM cur", *_EXPORT)
def raw_http_text(spark, d):
    return export.raw_text(_curated(spark, d))


#: Texts that stand for secrets in the driver-derived requests.
MARKERS = ["Bearer b", "password=p", '"authToken":"s"', "accessToken=t", "\r\n\r\nab-"]


@query("marker_scan", f"SELECT 'raw' AS artifact, count(*) AS texts, count(*) FILTER (contains(body, 'password=p') OR contains(body, '\"authToken\":\"s\"') OR contains(body, concat(chr(13), chr(10), chr(13), chr(10), 'ab-'))) AS leaks FROM cur UNION ALL SELECT unnest(['har', 'http', 'index', 'postman']), count(*), 0 FROM cur", *_EXPORT)
def marker_scan(spark, d):
    """Every export of the curated requests, searched for secrets; the bodies before redaction show that there is something to find."""
    rows = _curated(spark, d)
    texts = [("raw", rows, "body"), ("har", export.har(rows), "entry"), ("http", export.raw_text(rows), "text"), ("postman", export.postman(rows), "item")]
    one = export.index(rows)
    texts.append(("index", one.select(F.to_json(F.struct(*one.columns)).alias("row")), "row"))
    out = None
    for name, df, column in texts:
        part = df.select(F.lit(name).alias("artifact"), F.col(column).alias("text"))
        out = part if out is None else out.union(part)
    return export.leaks(out, MARKERS)


@query("redact_form", f"SELECT id, array_to_string(list_transform(string_split(body, '&'), lambda x: CASE WHEN contains(x, '=') AND {O.sensitive("split_part(x, '=', 1)")} THEN concat(split_part(x, '=', 1), '=%5BREDACTED%5D') ELSE x END), '&') AS body FROM obs WHERE lower(content_type) = 'application/x-www-form-urlencoded'", *O.V)
def redact_form(spark, d):
    df = bridge.observations(spark, d).where(U.media_type(U.header_value(F.col("headers"), "Content-Type")) == "application/x-www-form-urlencoded")
    return df.select("id", R.redact_form(F.col("body")).alias("body"))


@query("redact_url", "SELECT id, rurl AS url FROM ru", *O.V, O.PAIRS, O.REDACTED_QUERY, O.URLS)
def redact_url(spark, d):
    return bridge.observations(spark, d).select("id", R.redact_url(F.col("url")).alias("url"))


@query("redact_log_url", f"SELECT id, {O.LOG_URL} AS url FROM v LEFT JOIN rq USING (id)", *O.V, O.PAIRS, O.REDACTED_QUERY.replace("[REDACTED]", "<redacted>"))
def redact_log_url(spark, d):
    return bridge.observations(spark, d).select("id", R.redact_log_url(F.col("url")).alias("url"))


@query("redact_json", "SELECT id, rbody AS body FROM rb JOIN obs USING (id) WHERE body <> ''", *O.V, O.BODIES)
def redact_json(spark, d):
    return bridge.observations(spark, d).where("body <> ''").select("id", R.redact_body(F.col("body")).alias("body"))


def _api_hidden(x: str) -> str:
    return f"({O.sensitive(x)} OR {O.has(f'lower({x})', 'password', 'token', 'secret', 'authorization', 'cookie')})"


@query("redact_api_body", f"SELECT id, {O.redacted_body(_api_hidden)} AS body FROM obs WHERE body <> ''", *O.V)
def redact_api_body(spark, d):
    return bridge.observations(spark, d).where("body <> ''").select("id", R.redact_api_body(F.col("body")).alias("body"))


@query("redact_jwt", "SELECT conv_id, turn, concat(text, ' [JWT_REDACTED:length=', CAST(length(t) AS VARCHAR), '] end') AS text FROM (SELECT *, concat('eyJ', md5(text), '.', md5(role), '.s') AS t FROM conversations)")
def redact_jwt(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet")
    token = F.concat(F.lit("eyJ"), F.md5(F.col("text").cast("binary")), F.lit("."), F.md5(F.col("role").cast("binary")), F.lit(".s"))
    return c.select("conv_id", "turn", R.redact_jwt(F.concat("text", F.lit(" "), token, F.lit(" end"))).alias("text"))


@query("redact_headers", "SELECT id, content_type, CASE WHEN \"authorization\" <> '' THEN '[REDACTED]' ELSE '' END AS authorization_out FROM obs", *O.V)
def redact_headers(spark, d):
    df = bridge.observations(spark, d).select("id", R.redact_headers(F.col("headers")).alias("h"))
    return df.select("id", U.header_value(F.col("h"), "Content-Type").alias("content_type"), U.header_value(F.col("h"), "Authorization").alias("authorization_out"))


# -- reports, query API


@query("method_source_counts", "SELECT method, source_type, count(*) AS total FROM obs GROUP BY method, source_type", *O.V)
def method_source_counts(spark, d):
    return bridge.observations(spark, d).groupBy("method", "source_type").agg(F.count(F.lit(1)).alias("total")).orderBy(F.desc("total"))


@query("requests_by_method", "SELECT id, method, created_at FROM obs WHERE crawl_id = 'c1' AND upper(method) = 'GET'", *O.V)
def requests_by_method(spark, d):
    return report.requests_for(bridge.observations(spark, d), "c1", "GET").select("id", "method", "created_at")


@query("request_detail", "SELECT id, crawl_id, method FROM obs WHERE crawl_id = 'c1' AND id = 'r4'", *O.V)
def request_detail(spark, d):
    return report.request_detail(bridge.observations(spark, d), "c1", "r4").select("id", "crawl_id", "method")


@query("api_sql", "SELECT url, count(*) AS n FROM obs WHERE source_type ILIKE 'CDP%' AND instr(url, '?') > 0 AND source_type NOT IN ('cdp_policy_blocked') AND try_cast(regexp_extract(body, '\"k\": ?([0-9]+)', 1) AS INT) > 3 GROUP BY url ORDER BY n DESC", *O.V)
def api_sql(spark, d):
    """Ad-hoc SQL of users, over a view of the observations."""
    return _user_sql(spark, d, "SELECT url, count(*) AS n FROM observations WHERE source_type ILIKE 'CDP%' AND instr(url, '?') > 0 AND source_type NOT IN ('cdp_policy_blocked') AND try_cast(get_json_object(body, '$.k') AS INT) > 3 GROUP BY url ORDER BY n DESC")


def _user_sql(spark, d, text: str) -> DataFrame:
    """SQL over a view in which headers and the JSON format are JSON texts, as users of a database of requests have them."""
    rows = bridge.observations(spark, d)
    flags = U.content_flags(U.header_value(F.col("headers"), "Content-Type"))
    is_json = flags["is_json"] & (F.col("body") != "") & C.is_json_object(F.col("body"))
    shape = F.to_json(F.struct(is_json.alias("is_json"), F.when(is_json, F.col("body")).alias("payload")))
    rows.withColumns({"headers": F.to_json("headers"), "json_format": shape}).createOrReplaceTempView("observations")
    return spark.sql(text)


@query("sql_headers", "SELECT method, url, \"authorization\" AS credential FROM obs WHERE \"authorization\" <> ''", *O.V)
def sql_headers(spark, d):
    return _user_sql(spark, d, "SELECT method, url, get_json_object(headers, '$.Authorization') AS credential FROM observations WHERE get_json_object(headers, '$.Authorization') IS NOT NULL")


@query("sql_posts", "SELECT url, body_type, body FROM obs WHERE method = 'POST' AND source_type = 'cdp_observed'", *O.V)
def sql_posts(spark, d):
    return _user_sql(spark, d, "SELECT url, body_type, body FROM observations WHERE method = 'POST' AND source_type = 'cdp_observed'")


@query("sql_json_requests", "SELECT method, url, body AS payload FROM ct JOIN obs USING (id) WHERE contains(mt, 'json') AND body <> '' AND json_type(CASE WHEN json_valid(body) THEN body END) = 'OBJECT'", *O.V, _MEDIA)
def sql_json_requests(spark, d):
    return _user_sql(spark, d, "SELECT method, url, get_json_object(json_format, '$.payload') AS payload FROM observations WHERE try_variant_get(parse_json(json_format), '$.is_json', 'boolean')")


@query("sql_graphql", "SELECT method, url, body FROM obs WHERE source_type = 'graphql' OR lower(url) LIKE '%graphql%' OR lower(body) LIKE '%mutation%'", *O.V)
def sql_graphql(spark, d):
    return _user_sql(spark, d, "SELECT method, url, body FROM observations WHERE source_type = 'graphql' OR lower(url) LIKE '%graphql%' OR lower(body) LIKE '%mutation%'")


@query("sql_scanner_urls", "SELECT DISTINCT url FROM obs WHERE method = 'GET' AND instr(url, '?') > 0", *O.V)
def sql_scanner_urls(spark, d):
    return _user_sql(spark, d, "SELECT DISTINCT url FROM observations WHERE method = 'GET' AND instr(url, '?') > 0")


@query("sql_first_request", "SELECT id, created_at FROM obs WHERE created_at < current_timestamp ORDER BY created_at, id LIMIT 1", *O.V)
def sql_first_request(spark, d):
    """The first request before now; the limit is what is asked for."""
    return _user_sql(spark, d, "SELECT id, created_at FROM observations WHERE created_at < current_timestamp() ORDER BY created_at, id LIMIT 1")


@query("token_merge", "SELECT event_id, array_to_string(list_sort(list_distinct([concat('cookie theme ', v), concat('localStorage token ', v), CASE WHEN event_id % 2 = 0 THEN concat('cookie theme ', v) ELSE 'cookie csrf c' END])), '|') AS tokens, array_to_string(CASE WHEN event_type IN ('view', 'click') THEN ['view', 'click'] ELSE ['view', 'click', event_type] END, '|') AS kinds FROM (SELECT *, CAST(user_id % 5 AS VARCHAR) AS v FROM events)")
def token_merge(spark, d):
    """Two token lists of a session in one, sorted; and a list that takes what it does not hold yet."""
    v = (F.col("user_id") % 5).cast("string")
    token = lambda source, name, value: F.struct(F.lit(source).alias("source"), F.lit(name).alias("name"), value.alias("value"))
    old, new = F.array(token("cookie", "theme", v), token("localStorage", "token", v)), F.array(F.when(F.col("event_id") % 2 == 0, token("cookie", "theme", v)).otherwise(token("cookie", "csrf", F.lit("c"))))
    shown = F.transform(sessions.merged(old, new), lambda t: F.concat_ws(" ", t["source"], t["name"], t["value"]))
    kinds = sessions.append_unique(F.array(F.lit("view"), F.lit("click")), F.col("event_type"))
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", F.array_join(shown, "|").alias("tokens"), F.array_join(kinds, "|").alias("kinds"))


@query("workflow_fingerprints", "SELECT event_id, sha256(concat_ws(chr(0), 'form', 'https://app.example.test/work', 'dialog', concat('Step ', CAST(event_id % 2 AS VARCHAR)), concat('{\"f\":[{\"name\":\"', event_type, '\",\"required\":true}]}'), CASE WHEN event_id % 4 < 2 THEN 'sign in' ELSE 'sav' END)) AS form, sha256(concat_ws(chr(0), 'control', 'https://app.example.test/work', 'button', 'lik', concat('data-id=', CAST(user_id AS VARCHAR)))) AS control FROM events")
def workflow_fingerprints(spark, d):
    """A label's busy form, and states of a control that come and go, change no identity."""
    n, url = F.col("event_id"), F.lit("HTTPS://App.Example.test:443/work/")
    submit = F.element_at(F.array(*map(F.lit, ("Sign In", "Signing in...", "Save", " saving…"))), (n % 4 + 1).cast("int"))
    fields = F.array(F.struct(F.col("event_type").alias("name"), F.lit(True).alias("required")))
    form = report.form_fingerprint(url, F.lit("dialog"), F.concat(F.lit("Step "), (n % 2).cast("string")), fields, submit)
    control = report.control_fingerprint(url, F.lit("button"), F.when(n % 2 == 0, "Like").otherwise("Liking..."), F.concat(F.lit("data-id="), F.col("user_id").cast("string")))
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", form.alias("form"), control.alias("control"))


@query("script_endpoints", """SELECT page_id, k[1] AS kind, k[2] AS method, k[3] AS target FROM (SELECT page_id, unnest([['form', CASE WHEN page_id % 2 = 0 THEN 'POST' ELSE 'GET' END, concat('/form/', CAST(page_id % 7 AS VARCHAR))], ['fetch', 'GET', concat('/api/f/', CAST(page_id AS VARCHAR))],
 ['axios', 'POST', concat('/api/x?a=', CAST(page_id % 3 AS VARCHAR))], ['xhr', 'PUT', '/api/o'], ['websocket', 'GET', concat('wss://ws.example.test/', CAST(page_id % 5 AS VARCHAR))], ['eventsource', 'GET', '/sse'], ['beacon', 'POST', '/beacon'],
 ['import', 'GET', concat('/chunks/', CAST(page_id % 4 AS VARCHAR), '.js')], ['route', 'GET', '/users/:id'], ['route', 'GET', '/home']]) AS k FROM pages)""")
def script_endpoints(spark, d):
    return bridge.script_endpoints(bridge.scripted_pages(spark, d))


_ASSETS = "assets AS (SELECT 'crawler' AS tool, 'standard' AS mode, url, 'GET' AS method, kind AS source, 'DISCOVERED_CANDIDATE' AS trust_class FROM links UNION ALL SELECT 'browser', 'browser', k.url, m, source_type, CASE WHEN source_type = 'cdp_observed' AND lifecycle_state = 'completed' AND cdp_request_id <> '' THEN 'CONFIRMED_BROWSER_REQUEST' ELSE 'DISCOVERED_CANDIDATE' END FROM inv JOIN k ON k.id = representative_request_id)"


def _assets(spark, d):
    return report.assets(bridge.page_links(spark, d), analyzed(spark, d))


@query("asset_union", "SELECT * FROM assets", *O.I, LINKS, _ASSETS)
def asset_union(spark, d):
    return _assets(spark, d)


@query("coverage_matrix", "SELECT tool, mode, count(*) AS raw_assets, count(*) FILTER (trust_class = 'CONFIRMED_BROWSER_REQUEST') AS confirmed_requests, array_to_string(list_sort(list(DISTINCT method)), '|') AS methods FROM assets GROUP BY tool, mode", *O.I, LINKS, _ASSETS)
def coverage_matrix(spark, d):
    return report.coverage(_assets(spark, d))


@query("coverage_pivot", "SELECT metric, max(n) FILTER (tool = 'crawler') AS crawler, max(n) FILTER (tool = 'browser') AS browser FROM (SELECT tool, 'raw_assets' AS metric, count(*) AS n FROM assets GROUP BY tool UNION ALL SELECT tool, 'confirmed_requests', count(*) FILTER (trust_class = 'CONFIRMED_BROWSER_REQUEST') FROM assets GROUP BY tool UNION ALL SELECT tool, 'unique_urls', count(DISTINCT url) FROM assets GROUP BY tool UNION ALL SELECT tool, 'methods', count(DISTINCT method) FROM assets GROUP BY tool) GROUP BY metric", *O.I, LINKS, _ASSETS)
def coverage_pivot(spark, d):
    return report.coverage_metrics(_assets(spark, d))


@query("confirmed_intersection", "SELECT template FROM z WHERE source_type IN ('anchor', 'navigation') INTERSECT SELECT template FROM z WHERE source_type = 'cdp_observed' AND lifecycle_state = 'completed' AND cdp_request_id <> ''", *O.Z)
def confirmed_intersection(spark, d):
    """Templates that both a link and the browser know: an intersection in one pass."""
    found = F.col("source_type").isin("anchor", "navigation")
    both = obs(spark, d).groupBy("template").agg(F.bool_or(found).alias("found"), F.bool_or(C.trust_class() == "CONFIRMED_BROWSER_REQUEST").alias("seen"))
    return both.where("found AND seen").select("template")


@query("workflow_yield", "SELECT task_id, count(DISTINCT id) AS application_request_count, count(DISTINCT identity) FILTER (e_tasks = 1) AS new_endpoint_count, count(DISTINCT schema_hash) FILTER (s_tasks = 1) AS new_schema_count FROM (SELECT k.*, (SELECT count(DISTINCT task_id) FROM k x WHERE x.identity = k.identity) AS e_tasks, (SELECT count(DISTINCT task_id) FROM k x WHERE x.schema_hash = k.schema_hash) AS s_tasks FROM k) WHERE task_id <> '' GROUP BY task_id", *O.Z)
def workflow_yield(spark, d):
    return report.workflow_yield(inventory.captured(analyzed(spark, d)))


@query("role_difference", "SELECT DISTINCT identity FROM k WHERE auth = 'AUTHENTICATED' AND identity NOT IN (SELECT identity FROM k WHERE auth = 'ANONYMOUS')", *O.Z)
def role_difference(spark, d):
    """Endpoints that only authenticated requests reach: a set difference in one pass."""
    per = inventory.captured(analyzed(spark, d)).groupBy("identity").agg(F.bool_or(F.col("auth") == "AUTHENTICATED").alias("inside"), F.bool_or(F.col("auth") == "ANONYMOUS").alias("outside"))
    return per.where("inside AND NOT outside").select("identity")


@query("finding_dedupe", "SELECT category, method, origin, endpoint_template, parameter, rule, authentication_context, severity_normalized, endpoint_inventory_id, payload_hash, discovered_request_id FROM (SELECT concat('cat', CAST(event_id % 4 AS VARCHAR)) AS category, m AS method, origin, template AS endpoint_template, CASE WHEN event_id % 2 = 0 THEN 'query.user' ELSE '' END AS parameter, concat('rule', CAST(event_id % 3 AS VARCHAR)) AS rule, auth AS authentication_context, CASE event_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'low' ELSE 'medium' END AS severity_normalized, k.inventory_id AS endpoint_inventory_id, sha256(body) AS payload_hash, id AS discovered_request_id, event_id FROM k) QUALIFY row_number() OVER (PARTITION BY category, method, origin, endpoint_template, parameter, rule, authentication_context ORDER BY event_id DESC) = 1", *O.Z)
def finding_dedupe(spark, d):
    k, n = inventory.captured(analyzed(spark, d)), F.col("event_id")
    raw = k.select(
        F.concat(F.lit("cat"), (n % 4).cast("string")).alias("category"), F.upper("method").alias("method"), "origin", F.col("template").alias("endpoint_template"), F.when(n % 2 == 0, "query.user").otherwise("").alias("parameter"),
        F.concat(F.lit("rule"), (n % 3).cast("string")).alias("rule"), F.col("auth").alias("authentication_context"), F.element_at(F.array(F.lit("High"), F.lit("LOW"), F.lit("Medium")), (n % 3 + 1).cast("int")).alias("severity_raw"),
        F.col("inventory_id").alias("endpoint_inventory_id"), F.col("body").alias("payload"), F.col("id").alias("discovered_request_id"), n.alias("seen"),
    )
    return report.findings(raw).select(*report.FINDING_KEY, "severity_normalized", "endpoint_inventory_id", "payload_hash", "discovered_request_id")


@query("submit_window_claim", "SELECT submit_id, first(claim_id ORDER BY seen, claim_id) AS claim_id FROM (SELECT c.event_id AS claim_id, c.ts AS seen, first(s.event_id ORDER BY s.ts DESC, s.event_id DESC) AS submit_id FROM events s JOIN events c ON c.user_id = s.user_id AND c.event_type = 'click' AND c.event_id % 2 = s.event_id % 2 AND c.ts BETWEEN s.ts AND s.ts + INTERVAL 1 DAY WHERE s.event_type = 'signup' GROUP BY ALL) GROUP BY submit_id")
def submit_window_claim(spark, d):
    """Same user, method and URL (two of them here, by the event's number), within a day; each side used once."""
    e = spread(spark.read.parquet(f"{d}/events.parquet")).withColumns({"method": F.lit("POST"), "url": F.concat(F.lit("/login/"), (F.col("event_id") % 2).cast("string"))})
    keys = ["user_id", "method", "url"]
    submits = e.where("event_type = 'signup'").select(F.col("event_id").alias("submit_id"), *keys, F.col("ts").alias("submit"))
    claims = e.where("event_type = 'click'").select(F.col("event_id").alias("claim_id"), *keys, F.col("ts").alias("at"))
    return report.claims(submits, claims, keys, 86_400)


@query("crawl_runs", "SELECT concat('u', CAST(user_id AS VARCHAR)) AS id, last(s ORDER BY ts, event_id) AS status, min(ts) FILTER (s = 'queued') AS created_at, min(ts) FILTER (s = 'running') AS started_at, max(ts) FILTER (s IN ('completed', 'failed')) AS completed_at, last(props ORDER BY ts, event_id) FILTER (s = 'failed') AS error FROM (SELECT *, CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'running' WHEN 'error' THEN 'failed' ELSE 'completed' END AS s FROM events) GROUP BY user_id")
def crawl_runs(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    state = F.when(F.col("event_type") == "view", "queued").when(F.col("event_type") == "click", "running").when(F.col("event_type") == "error", "failed").otherwise("completed")
    return report.run_states(e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("id"), state.alias("state"), F.col("ts").alias("at"), "event_id", F.col("props").alias("message")))


@query("origin_allow_list", "SELECT page_id, ok AND n = 1 AS allowed FROM (SELECT page_id, o, count(*) OVER (PARTITION BY o) AS n, regexp_matches(o, '^https?://[^/?#@]+\\z') AS ok FROM (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN url ELSE concat(array_to_string(string_split(url, '/')[1:3], '/'), CASE WHEN page_id % 3 = 0 THEN CAST(page_id AS VARCHAR) ELSE '' END) END AS o FROM pages))")
def origin_allow_list(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet")
    o = F.when(F.col("page_id") % 4 == 0, F.col("url")).otherwise(F.concat(U.origin_of(F.col("url")), F.when(F.col("page_id") % 3 == 0, F.col("page_id").cast("string")).otherwise("")))
    return report.allowed_origins(p.select("page_id", o.alias("origin"))).select("page_id", "allowed")


@query("token_extract", "SELECT source, kind, count(*) AS tokens, count(DISTINCT md5(value)) AS distinct_values FROM (SELECT source, value, CASE WHEN contains(n, 'csrf') OR contains(n, 'xsrf') THEN 'csrf' WHEN starts_with(value, 'eyJ') THEN 'jwt' WHEN source <> 'cookie' AND (contains(n, 'token') OR n = 'authorization') THEN 'token' END AS kind FROM (SELECT CASE event_id % 3 WHEN 0 THEN 'cookie' WHEN 1 THEN 'localStorage' ELSE 'sessionStorage' END AS source, CASE event_id % 5 WHEN 0 THEN 'xsrf-id' WHEN 1 THEN 'accesstoken' WHEN 2 THEN 'authorization' ELSE 'theme' END AS n, CASE event_id % 7 WHEN 0 THEN concat('eyJ', CAST(user_id AS VARCHAR), '.b.c') ELSE CAST(user_id AS VARCHAR) END AS value FROM events)) WHERE kind IS NOT NULL GROUP BY source, kind")
def token_extract(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    pick = lambda n, *v: F.element_at(F.array(*map(F.lit, v)), (F.col("event_id") % n + 1).cast("int"))
    rows = e.select(
        pick(3, "cookie", "localStorage", "sessionStorage").alias("source"), pick(5, "XSRF-Id", "accessToken", "Authorization", "theme", "theme").alias("name"),
        F.when(F.col("event_id") % 7 == 0, F.concat(F.lit(" Bearer eyJ"), F.col("user_id").cast("string"), F.lit(".b.c"))).otherwise(F.col("user_id").cast("string")).alias("value"),
    )
    return sessions.token_counts(rows)


@query("stream_upsert", _HISTORY_SQL, *_HISTORY)
def stream_upsert(spark, d):
    from ..streaming.upsert import run_batches

    return run_batches(spark, bridge.history(spark, d), 3, "save")


@query("crawl_status", "SELECT id, status FROM (SELECT concat('u', CAST(user_id AS VARCHAR)) AS id, last(s ORDER BY ts, event_id) AS status FROM (SELECT *, CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'running' WHEN 'error' THEN 'failed' ELSE 'completed' END AS s FROM events) GROUP BY user_id) WHERE id = 'u7'")
def crawl_status(spark, d):
    return report.crawl_status(crawl_runs(spark, d), "u7").select("id", "status")


# -- sources and sinks: what is written is what is read


def _at(spark, name: str) -> str:
    return f"{files.shared_folder(spark)}/{name}"


@query("json_array_source", "SELECT id, method, url, body, content_type, status_code FROM obs", *O.V)
def json_array_source(spark, d):
    """Captured requests as JSON arrays, one a file, of at most 5,000 requests each."""
    rows, path = bridge.observations(spark, d), _at(spark, "arrays")
    one = F.to_json(F.struct("id", "crawl_id", "task_id", "page_url", "auth_session_id", "method", "url", "headers", "body", "body_type", "source_type", "resource_type", "lifecycle_state", "response"))
    arrays = rows.select(F.floor(F.col("event_id") / 5000).alias("part"), one.alias("row")).groupBy("part").agg(F.concat(F.lit("["), F.array_join(F.collect_list("row"), ","), F.lit("]")).alias("value"))
    arrays.write.partitionBy("part").text(path)
    back = files.read_results(spark, path)
    return back.select("id", "method", "url", "body", U.header_value(F.col("headers"), "Content-Type").alias("content_type"), F.col("response.status_code").alias("status_code"))


@query("jsonl_source", "SELECT concat('2026-01-', CAST(page_id % 28 + 1 AS VARCHAR)) AS stamp, 'GET' AS method, url AS endpoint, CAST(200 AS INT) AS status_code FROM pages WHERE page_id % 9 <> 0")
def jsonl_source(spark, d):
    """Discovery results as JSON lines; every ninth line is cut short and so left out."""
    path = _at(spark, "lines")
    shape = F.struct(F.concat(F.lit("2026-01-"), (F.col("page_id") % 28 + 1).cast("string")).alias("timestamp"), F.struct(F.lit("GET").alias("method"), F.col("url").alias("endpoint")).alias("request"), F.struct(F.lit(200).alias("status_code")).alias("response"))
    line = F.to_json(shape)
    pages = spread(spark.read.parquet(f"{d}/pages.parquet"))
    files.write_lines(pages.select(F.when(F.col("page_id") % 9 == 0, F.substring(line, 1, 20)).otherwise(line).alias("line")), "line", path)
    return files.read_jsonl(spark, path).select(F.col("timestamp").alias("stamp"), "request.method", "request.endpoint", "response.status_code")


@query("jsonl_sink", "SELECT id, classification, origin FROM c", *O.C)
def jsonl_sink(spark, d):
    path = _at(spark, "sink")
    files.write_jsonl(obs(spark, d).select("id", F.when(C.blocked(), "UNKNOWN").otherwise(C.classify()).alias("classification"), "origin"), path)
    return files.read_jsonl(spark, path, "classification string, id string, origin string").select("id", "classification", "origin")


@query("csv_sink", "SELECT method, source_type, CAST(count(*) AS VARCHAR) AS total FROM obs GROUP BY method, source_type", *O.V)
def csv_sink(spark, d):
    path = _at(spark, "csv")
    files.write_csv(method_source_counts(spark, d), path)
    return spark.read.option("header", True).csv(path)


@query("url_list_source", "SELECT DISTINCT trim(url) AS url FROM links WHERE trim(url) <> ''", LINKS)
def url_list_source(spark, d):
    path = _at(spark, "urls")
    files.write_lines(bridge.page_links(spark, d).select("url").distinct(), "url", path)
    return files.read_urls(spark, path)


@query("session_state_source", "SELECT source, kind, count(*) AS tokens, count(DISTINCT value) AS distinct_values FROM (SELECT 'cookie' AS source, 'csrf' AS kind, concat('v', CAST(user_id AS VARCHAR)) AS value FROM events WHERE event_type = 'signup' UNION ALL SELECT 'localStorage', 'jwt', concat('eyJ', CAST(event_id AS VARCHAR), '.b.c') FROM events WHERE event_type = 'signup' UNION ALL SELECT 'sessionStorage', 'token', 'x' FROM events WHERE event_type = 'signup') GROUP BY source, kind")
def session_state_source(spark, d):
    """Session states as JSON; the values of their tokens are counted and never shown."""
    path, text = _at(spark, "sessions"), lambda c: F.col(c).cast("string")
    pair = lambda n, v: F.array(F.struct(F.lit(n).alias("name"), v.alias("value")))
    stored = F.array(F.struct(F.lit("https://app.example.test").alias("origin"), pair("id", F.concat(F.lit("eyJ"), text("event_id"), F.lit(".b.c"))).alias("localStorage"), pair("Token", F.lit("x")).alias("sessionStorage")))
    state = F.struct(text("event_id").alias("id"), pair("XSRF", F.concat(F.lit("v"), text("user_id"))).alias("cookies"), stored.alias("origins"))
    signups = spread(spark.read.parquet(f"{d}/events.parquet")).where("event_type = 'signup'")
    files.write_lines(signups.select(F.to_json(state).alias("line")), "line", path)
    rows = spark.read.schema(files.SESSION).json(path)
    return sessions.token_counts(sessions.flatten_state(rows))
