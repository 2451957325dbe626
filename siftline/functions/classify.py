"""Ordered decision lists over observed requests: class, replayability, policy, trust."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import content_parameter, header_value, lower_path, media_type, path, query_pairs

#: File extensions of static assets.
STATIC = [".js", ".css", ".map", ".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico", ".webp", ".woff", ".woff2", ".ttf", ".eot", ".mp4", ".webm", ".pdf"]
#: Query keys that say nothing about the application.
NOISE = ["_rsc", "_", "fbclid", "gclid", "page", "limit", "offset"]
#: Words of a name that mark it as sensitive, and parts of a name that do.
SENSITIVE_WORDS = ["password", "passwd", "passcode", "token", "accesstoken", "refreshtoken", "idtoken", "authorization", "cookie", "session", "csrf", "xsrf", "secret"]
SENSITIVE_PARTS = ["password", "token", "session", "csrf", "authorization"]
#: Classes whose requests can be candidates.
CANDIDATE_CLASSES = ["APPLICATION", "GRAPHQL", "PARAMETERIZED_NAVIGATION", "AUTH_API", "AUTH_RECOVERY_API"]
QUERY_CLASSES = CANDIDATE_CLASSES[:3]


#: Phrases in a lower-case path, or host, by what they say of a request.
DEVELOPMENT = ["__nextjs", "webpack-hmr", "sockjs-node"]
FRAMEWORK_START, FRAMEWORK = "/_next/", ["/_rsc"]
ANALYTICS, ANALYTICS_HOSTS = ["analytics", "telemetry"], ["google-analytics", "segment."]
SESSION, SESSION_END = ["refresh-token", "refresh_token", "/session/"], "/session"
RECOVERY_API = ["forgot-password", "reset-password", "recover"]
AUTH_PATHS = ["login", "signin", "oauth", "callback"]
LOGOUT = ["logout", "session/delete", "device/revoke"]
RECOVERY = ["forgot", "reset", "password/change"]
ACCOUNT = ["register", "signup", "account/create"]


def has(text: Column, *parts: str) -> Column:
    out = F.lit(False)
    for x in parts:
        out = out | F.contains(text, F.lit(x))
    return out


def noise_name(name: Column) -> Column:
    return F.lower(name).rlike(rf"^(query\.)?(({'|'.join(NOISE)})\z|utm_)")


#: How a name is brought to words with "_" between them: patterns that Java and Python read alike, before and after lowering.
_END = r"(?![\s\S])"
_SPLIT = [(f"^ +| +{_END}", ""), ("(?<=[a-z0-9])(?=[A-Z])", "_"), (r"[- .\[]", "_"), (r"\]", "")]
_TRIM = [(f"^_+|_+{_END}", ""), ("^x_", "")]
_SENSITIVE = rf"(^|_)({'|'.join(SENSITIVE_WORDS)})(_|{_END})|{'|'.join(SENSITIVE_PARTS)}"


def sensitive_name(name: Column) -> Column:
    """Whether a parameter, header or field name stands for a secret.  camelCase, dashes, dots and brackets count as word ends.
    Most names hold none of the words at all, and are done with at the first look."""
    maybe = F.lower(F.translate(name, "]", "")).rlike("|".join(dict.fromkeys(SENSITIVE_WORDS + SENSITIVE_PARTS)))
    for pattern, to in _SPLIT:
        name = F.regexp_replace(name, pattern, to)
    name = F.lower(name)
    for pattern, to in _TRIM:
        name = F.regexp_replace(name, pattern, to)
    return F.when(maybe, name.rlike(_SENSITIVE)).otherwise(False)


def is_sensitive(name: str) -> bool:
    """``sensitive_name`` of one text, for what walks a value in Python."""
    for pattern, to in _SPLIT:
        name = re.sub(pattern, to, name)
    name = name.lower()
    for pattern, to in _TRIM:
        name = re.sub(pattern, to, name)
    return re.search(_SENSITIVE, name) is not None


def meaningful_query(pairs: Column) -> Column:
    return F.exists(pairs, lambda p: ~noise_name(p["k"]) & ~sensitive_name(p["k"]))


def json_value(body: Column) -> Column:
    return F.try_parse_json(body)


def is_json_object(body: Column) -> Column:
    return F.coalesce(F.schema_of_variant(json_value(body)).startswith("OBJECT"), F.lit(False))


def member(body: Column, name: str) -> Column:
    """A string member of a JSON object body, else null."""
    v = F.try_variant_get(json_value(body), f"$.{name}", "variant")
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def is_graphql(p: Column, body: Column) -> Column:
    value = json_value(body)
    there = [F.coalesce(F.schema_of_variant(F.try_variant_get(value, f"$.{k}", "variant")) != "VOID", F.lit(False)) for k in ("query", "operationName")]
    return has(p, "graphql") | (is_json_object(body) & (there[0] | there[1]))


def auth_path(p: Column) -> Column:
    return has(p, *AUTH_PATHS)


def classify() -> Column:
    """Class of a row with the columns of ``with_url`` plus method, headers, body, source_type and resource_type."""
    p, method, pairs = F.col("p"), F.upper("method"), query_pairs(F.col("u_query"))
    document = (
        (F.lower("resource_type") == "document")
        | has(F.lower(header_value(F.col("headers"), "Sec-Fetch-Dest")), "document")
        | (F.col("source_type") == "navigation")
        | has(F.lower(header_value(F.col("headers"), "Accept")), "text/html")
    )
    wanted = (method == "GET") & meaningful_query(pairs)
    extension = F.regexp_extract(p, r"(\.[^./]*)\z", 1)
    return (
        F.when(method == "OPTIONS", "PREFLIGHT")
        .when(~F.col("u_ok"), "UNKNOWN")
        .when(has(p, *DEVELOPMENT), "DEVELOPMENT")
        .when(p.startswith(FRAMEWORK_START) | F.exists(pairs, lambda x: x["k"] == "_rsc") | has(p, *FRAMEWORK), "FRAMEWORK")
        .when(extension.isin(STATIC), "STATIC")
        .when(has(p, *ANALYTICS) | has(F.col("u_host"), *ANALYTICS_HOSTS), "ANALYTICS")
        .when(has(p, *SESSION) | p.endswith(SESSION_END), "AUTH_SESSION")
        .when(is_graphql(p, F.col("body")), "GRAPHQL")
        .when(document & auth_path(p), "AUTH_PAGE")
        .when(document & wanted, "PARAMETERIZED_NAVIGATION")
        .when(document, "NAVIGATION")
        .when(has(p, *RECOVERY_API), "AUTH_RECOVERY_API")
        .when(auth_path(p), "AUTH_API")
        .when(method == "HEAD", "UNKNOWN")
        .when(wanted, "PARAMETERIZED_NAVIGATION")
        .when((F.col("source_type") == "cdp") | F.col("source_type").startswith("cdp_"), "APPLICATION")
        .otherwise("UNKNOWN")
    )


def missing() -> Column:
    """No request at all."""
    return F.col("url").isNull() & F.col("method").isNull()


def blocked() -> Column:
    return (F.col("source_type") == "cdp_policy_blocked") | (F.col("lifecycle_state") == "blocked_by_policy")


def auth_context() -> Column:
    known = (header_value(F.col("headers"), "Authorization") != "") | (header_value(F.col("headers"), "Cookie") != "") | (F.col("auth_session_id") != "")
    return F.when(known, "AUTHENTICATED").otherwise("ANONYMOUS")


def replay_reasons(parameters: Column) -> Column:
    """Why a request cannot be sent again as it is; empty if it can."""
    method = F.upper("method")
    tests = [
        ("malformed_url", ~F.col("u_ok") | (F.col("u_host") == "") | ~F.col("u_scheme").isin("http", "https")),
        ("missing_method", F.col("method") == ""),
        ("missing_body", ~method.isin("GET", "HEAD") & (F.col("body") == "") & (parameters == 0)),
        ("request_body_incomplete", F.col("body_completeness_known") & ~F.col("body_complete")),
        ("lifecycle_not_completed", (F.col("lifecycle_state") != "") & ~F.col("lifecycle_state").isin("completed", "loadingFinished")),
    ]
    return F.filter(F.array(*(F.when(t, F.lit(n)) for n, t in tests)), lambda x: x.isNotNull())


def replayability(reasons: Column, auth: Column) -> Column:
    return F.when(F.size(reasons) > 0, "INCOMPLETE").when(auth == "AUTHENTICATED", "REPLAYABLE_PRIVATE_AUTH").otherwise("REPLAYABLE")


def trust_class() -> Column:
    sure = (F.col("source_type") == "cdp_observed") & (F.col("lifecycle_state") == "completed") & (F.col("cdp_request_id") != "")
    return F.when(sure, "CONFIRMED_BROWSER_REQUEST").otherwise("DISCOVERED_CANDIDATE")


@dataclass(frozen=True)
class PolicyConfig:
    """What a capture session may do; everything is off unless switched on."""

    allow_mutations: bool = False
    allow_destructive: bool = False
    allow_account_creation: bool = False
    allow_recovery: bool = False
    allow_logout: bool = False
    allow_uploads: bool = False
    #: (endpoint, operation name); an empty part matches anything.
    read_only_graphql: tuple[tuple[str, str], ...] = field(default=())


def parse_flag(value: str | None) -> bool:
    """A switch from text; anything but the known words is an error, never a silent default."""
    word = (value or "").strip().lower()
    if word in ("true", "1", "yes"):
        return True
    if word in ("", "false", "0", "no"):
        return False
    raise ValueError(f"not a switch: {value!r}")


def graphql_operation(content_type: Column, body: Column) -> Column:
    """query, mutation or subscription from a JSON body; empty otherwise."""
    q = F.lower(F.trim(F.coalesce(member(body, "query"), F.lit(""))))
    ok = has(F.lower(content_type), "json") & is_json_object(body)
    return F.when(ok & q.startswith("query"), "query").when(ok & q.startswith("mutation"), "mutation").when(ok & q.startswith("subscription"), "subscription").otherwise("")


def graphql_rule(config: PolicyConfig, url: Column, name: Column) -> Column:
    out = F.lit(False)
    for endpoint, operation in config.read_only_graphql:
        out = out | (F.lit(endpoint == "") | (path(url) == endpoint)) & (F.lit(operation == "") | (name == operation))
    return out


#: The words that say why a policy rule decides.
REASONS = {
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


def policy(config: PolicyConfig, active: Column | None = None, exact: Column | None = None, claimed: Column | None = None) -> Column:
    """Struct action, rule_id and reason of a row with method, url, headers and body.  ``active``, ``exact`` and ``claimed``
    say of a login attempt whether it is under way, whether the request is exactly its own, and whether it has been used."""
    m, p = F.upper("method"), lower_path(F.col("url"))
    ct = header_value(F.col("headers"), "Content-Type")
    op = graphql_operation(ct, F.col("body"))
    name = F.when(op != "", F.coalesce(member(F.col("body"), "operationName"), F.lit(""))).otherwise("")
    auth = (active if active is not None else F.lit(False)) & (exact if exact is not None else F.lit(False)) & ~(claimed if claimed is not None else F.lit(False))
    change = m.isin("POST", "PUT", "PATCH", "DELETE")
    rules = [
        (m.isin("GET", "HEAD", "OPTIONS"), "ALLOW", "READ_ONLY"),
        (has(p, *LOGOUT) & F.lit(not config.allow_logout), "BLOCK", "LOGOUT_BLOCKED"),
        (has(p, *RECOVERY) & F.lit(not config.allow_recovery), "BLOCK", "RECOVERY_BLOCKED"),
        (has(p, *ACCOUNT) & F.lit(not config.allow_account_creation), "BLOCK", "ACCOUNT_CREATION_BLOCKED"),
        (has(F.lower(ct), "multipart") & F.lit(not config.allow_uploads), "BLOCK", "FILE_UPLOAD_BLOCKED"),
        ((m == "DELETE") & F.lit(not config.allow_destructive), "BLOCK", "DELETE_BLOCKED"),
        ((m == "POST") & (op == "query") & graphql_rule(config, F.col("url"), name), "ALLOW", "GRAPHQL_QUERY"),
        ((m == "POST") & auth, "ALLOW", "AUTH_EXACT"),
        (change & F.lit(not config.allow_mutations), "BLOCK", "MUTATION_BLOCKED"),
        (~change, "BLOCK", "UNKNOWN_METHOD"),
    ]
    answer = lambda action, rule: F.struct(F.lit(action).alias("action"), F.lit(rule).alias("rule_id"), F.lit(REASONS[rule]).alias("reason"))
    (test, *first), *rest = rules
    out = F.when(test, answer(*first))
    for test, action, rule in rest:
        out = out.when(test, answer(action, rule))
    return out.otherwise(answer("ALLOW", "MUTATIONS_ENABLED"))


def quality() -> list[Column]:
    """What makes an observation a better example, best first: larger is better."""
    def flag(c: Column) -> Column:
        return F.coalesce(c, F.lit(False)).cast("int")

    stated = F.when(F.col("completeness_status") == "COMPLETE", 3).when(F.col("completeness_status") == "UNKNOWN", 2).when(F.col("completeness_status") == "INCOMPLETE", 1)
    known = F.when(~F.col("body_completeness_known"), 2).when(F.col("body_complete"), 3).otherwise(1)
    stage = F.col("lifecycle_state")
    life = F.when(stage.isin("completed", "loadingFinished"), 4).when(stage == "response_received", 3).when(stage == "observed", 2).when(stage.isin("failed", "timed_out"), 1).otherwise(0)
    secret = (F.col("auth_session_id") != "") | (header_value(F.col("headers"), "Authorization") != "") | (header_value(F.col("headers"), "Cookie") != "")
    return [F.coalesce(stated, known), life, flag(F.col("body") != ""), flag(F.col("response").isNotNull()), flag(F.col("response.status_code").between(200, 399)), flag(secret), flag((F.col("page_url") != "") | (F.col("task_id") != ""))]


def content_of() -> Column:
    """Media type of a row: its header, or else its body type."""
    ct = media_type(header_value(F.col("headers"), "Content-Type"))
    return F.when(ct != "", ct).otherwise(F.lower(F.trim("body_type")))


def boundary() -> Column:
    return content_parameter(header_value(F.col("headers"), "Content-Type"), "boundary")
