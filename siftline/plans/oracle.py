"""DuckDB SQL that the queries are held against: common table expressions and scalar fragments."""

from __future__ import annotations

from ..sources.bridge import HISTORY_SQL, OBSERVATIONS_SQL

#: Fixed values, written here once more so that a slip in the engine's own does not pass on both sides.
URL = "^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:[?]([^#]*))?(?:#(.*))?"
SEGMENTS = [
    ("{uuid}", "(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[12345][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"), ("{cve}", "(?i)^cve-[0-9]{4}-[0-9]{4}[0-9]*$"), ("{cpe}", "(?i)^cpe:2[.]3:"),
    ("{int}", "^[0-9]+$"), ("{hash}", "(?i)^[0-9a-f]{20}[0-9a-f]*$"), ("{id}", "^[A-Za-z0-9_-]{24}[A-Za-z0-9_-]*$"),
]
STATIC = [".js", ".css", ".map", ".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico", ".webp", ".woff", ".woff2", ".ttf", ".eot", ".mp4", ".webm", ".pdf"]
NOISE = ["_rsc", "_", "fbclid", "gclid", "page", "limit", "offset"]
SENSITIVE_WORDS = ["password", "passwd", "passcode", "token", "accesstoken", "refreshtoken", "idtoken", "authorization", "cookie", "session", "csrf", "xsrf", "secret"]
SENSITIVE_PARTS = ["password", "token", "session", "csrf", "authorization"]
CANDIDATE_CLASSES = ["APPLICATION", "GRAPHQL", "PARAMETERIZED_NAVIGATION", "AUTH_API", "AUTH_RECOVERY_API"]
QUERY_CLASSES = ["APPLICATION", "GRAPHQL", "PARAMETERIZED_NAVIGATION"]


def texts(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def part(url: str, n: int) -> str:
    return f"regexp_extract({url}, '{URL}', {n})"


def bad(x: str) -> str:
    return f"contains(regexp_replace({x}, '%[0-9A-Fa-f]{{2}}', '', 'g'), '%')"


def unescape(x: str) -> str:
    return f"CASE WHEN {bad(x)} THEN {x} ELSE url_decode(replace({x}, '+', '%2B')) END"


def decode(x: str) -> str:
    """A query key or value; + is a space."""
    return f"CASE WHEN {bad(x)} THEN '' ELSE url_decode(replace({x}, '+', ' ')) END"


def has(x: str, *parts: str) -> str:
    return "(" + " OR ".join(f"contains({x}, '{p}')" for p in parts) + ")"


def noise(x: str) -> str:
    n = f"regexp_replace(lower({x}), '^query\\.', '')"
    return f"({n} IN ({texts(NOISE)}) OR starts_with({n}, 'utm_'))"


def sensitive(x: str) -> str:
    n = f"lower(translate(regexp_replace(trim({x}), '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '- .[]', '____'))"
    n = f"regexp_replace(regexp_replace({n}, '^_+|_+\\z', '', 'g'), '^x_', '')"
    return f"(list_has_any(string_split({n}, '_'), [{texts(SENSITIVE_WORDS)}]) OR {has(n, *SENSITIVE_PARTS)})"


def infer(v: str) -> str:
    return (
        f"CASE WHEN {v} IN ('true', 'false') THEN 'boolean' WHEN regexp_matches({v}, '^[+-]?[0-9]+\\z') AND TRY_CAST({v} AS BIGINT) IS NOT NULL THEN 'integer' "
        f"WHEN regexp_matches({v}, '(?i)^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)(e[+-]?[0-9]+)?\\z') THEN 'number' ELSE 'string' END"
    )


def size(x: str) -> str:
    return f"CAST(octet_length(encode({x})) AS INT)"


_SEGMENT = " ".join(f"WHEN regexp_matches({unescape('s')}, '{rx}') THEN '{name}'" for name, rx in SEGMENTS)
_TEMPLATE = f"array_to_string(list_transform(string_split({part('url', 3)}, '/'), lambda s: CASE {_SEGMENT} ELSE s END), '/')"
_OK = f"NOT (regexp_matches(url, '[\\x00-\\x1F\\x7F]') OR {bad(part('url', 3))} OR {bad(part('url', 2))})"
_AUTHORITY = f"regexp_replace({part('url', 2)}, '^.*@', '')"
_PORT = f"regexp_extract({_AUTHORITY}, ':([0-9]+)\\z', 1)"

#: Columns of a URL; for any relation with a column url.
URL_COLUMNS = f"""{_OK} AS u_ok, lower({part('url', 1)}) AS u_scheme, lower(regexp_replace({_AUTHORITY}, ':[0-9]*\\z', '')) AS u_host, {_PORT} AS u_port,
 {unescape(part('url', 3))} AS u_path, {part('url', 3)} AS raw_path, {part('url', 4)} AS u_query, {part('url', 5)} AS u_fragment,
 CASE WHEN NOT ({_OK}) THEN url WHEN {_TEMPLATE} = '' THEN '/' ELSE {_TEMPLATE} END AS template"""
ORIGIN = "CASE WHEN u_ok THEN concat(u_scheme, '://', u_host, ':', CASE WHEN u_port <> '' THEN u_port WHEN u_scheme = 'https' THEN '443' ELSE '80' END) ELSE '' END"

_JSON = "CASE WHEN json_valid(body) AND body <> '' THEN body END"
_GRAPHQL = f"({has('lower(u_path)', 'graphql')} OR coalesce(json_type({_JSON}) = 'OBJECT' AND (coalesce(json_type({_JSON}, '$.query'), 'NULL') <> 'NULL' OR coalesce(json_type({_JSON}, '$.operationName'), 'NULL') <> 'NULL'), false))"

OBS = f"obs AS ({OBSERVATIONS_SQL}), u AS (SELECT *, {URL_COLUMNS} FROM obs), v AS (SELECT *, {ORIGIN} AS origin, lower(u_path) AS p, upper(method) AS m FROM u)"
#: id, k, v, i of each well-formed query pair.
PAIRS = f"""qr AS (SELECT id, unnest(list_filter(string_split(u_query, '&'), lambda x: x <> '')) AS x, generate_subscripts(list_filter(string_split(u_query, '&'), lambda x: x <> ''), 1) AS i FROM v),
qp AS (SELECT id, i, {decode("split_part(x, '=', 1)")} AS k, {decode("CASE WHEN contains(x, '=') THEN regexp_replace(x, '^[^=]*=', '') ELSE '' END")} AS v FROM qr WHERE NOT ({bad('x')} OR contains(x, ';')))"""
_DOCUMENT = f"(source_type = 'navigation' OR {has('lower(accept)', 'text/html')})"
_AUTHPATH = has("p", "login", "signin", "oauth", "callback")
CLASSIFIED = f"""{PAIRS},
qm AS (SELECT id, bool_or(k = '_rsc') AS rsc, bool_or(NOT {noise('k')} AND NOT {sensitive('k')}) AS wanted FROM qp GROUP BY id),
c AS (SELECT v.*, source_type = 'cdp_policy_blocked' OR lifecycle_state = 'blocked_by_policy' AS blocked,
  CASE WHEN source_type = 'cdp_policy_blocked' OR lifecycle_state = 'blocked_by_policy' THEN 'UNKNOWN' WHEN m = 'OPTIONS' THEN 'PREFLIGHT' WHEN NOT u_ok THEN 'UNKNOWN' WHEN {has('p', '__nextjs', 'webpack-hmr', 'sockjs-node')} THEN 'DEVELOPMENT'
  WHEN starts_with(p, '/_next/') OR coalesce(rsc, false) OR {has('p', '/_rsc')} THEN 'FRAMEWORK' WHEN regexp_extract(p, '(\\.[^./]*)\\z', 1) IN ({texts(STATIC)}) THEN 'STATIC'
  WHEN {has('p', 'analytics', 'telemetry')} OR {has('u_host', 'google-analytics', 'segment.')} THEN 'ANALYTICS' WHEN {has('p', 'refresh-token', 'refresh_token', '/session/')} OR ends_with(p, '/session') THEN 'AUTH_SESSION'
  WHEN {_GRAPHQL} THEN 'GRAPHQL' WHEN {_DOCUMENT} AND {_AUTHPATH} THEN 'AUTH_PAGE' WHEN {_DOCUMENT} AND m = 'GET' AND coalesce(wanted, false) THEN 'PARAMETERIZED_NAVIGATION' WHEN {_DOCUMENT} THEN 'NAVIGATION'
  WHEN {has('p', 'forgot-password', 'reset-password', 'recover')} THEN 'AUTH_RECOVERY_API' WHEN {_AUTHPATH} THEN 'AUTH_API' WHEN m = 'HEAD' THEN 'UNKNOWN' WHEN m = 'GET' AND coalesce(wanted, false) THEN 'PARAMETERIZED_NAVIGATION'
  WHEN source_type = 'cdp' OR starts_with(source_type, 'cdp_') THEN 'APPLICATION' ELSE 'UNKNOWN' END AS classification,
  CASE WHEN authorization <> '' OR auth_session_id <> '' THEN 'AUTHENTICATED' ELSE 'ANONYMOUS' END AS auth,
  CASE WHEN content_type <> '' THEN lower(trim(split_part(content_type, ';', 1))) ELSE lower(trim(body_type)) END AS content FROM v LEFT JOIN qm USING (id))"""
CLASSIFIED = CLASSIFIED.replace("authorization <> ''", '"authorization" <> \'\'')

_IS_JSON = "contains(lower(split_part(content_type, ';', 1)), 'json')"
_FORM = "lower(trim(split_part(content_type, ';', 1))) = 'application/x-www-form-urlencoded'"
_MULTI = "starts_with(lower(content_type), 'multipart/')"
_LEAF = "CASE j.type WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE CASE WHEN CAST(j.atom AS DOUBLE) = floor(CAST(j.atom AS DOUBLE)) THEN 'integer' ELSE 'number' END END"
_LEAFSIZE = "CAST(CASE j.type WHEN 'NULL' THEN 0 WHEN 'VARCHAR' THEN octet_length(encode(j.atom->>'$')) ELSE octet_length(encode(CAST(j.atom AS VARCHAR))) END AS INT)"
_LEAVES = "j.type NOT IN ('OBJECT', 'ARRAY')"
#: Parameters of each request: id, source, path, type, sample_length, eligible, after the first of each (source, path).
PARAMETERS = f"""jb AS (SELECT id, {_JSON} AS j FROM c WHERE {_IS_JSON}),
mp AS (SELECT id, unnest(list_filter(string_split(body, '--BbB'), lambda x: contains(x, concat(chr(13), chr(10), chr(13), chr(10))))) AS x, generate_subscripts(list_filter(string_split(body, '--BbB'), lambda x: contains(x, concat(chr(13), chr(10), chr(13), chr(10)))), 1) AS i FROM c WHERE {_MULTI}),
mq AS (SELECT id, i, regexp_extract(x, '(?i)[; ]name="([^"]*)"', 1) AS name, regexp_extract(x, '(?i)filename="([^"]*)"', 1) AS file, regexp_replace(regexp_replace(x, '(?s)^.*?\\r\\n\\r\\n', ''), '\\r\\n\\z', '') AS val FROM mp),
fr AS (SELECT id, unnest(list_filter(string_split(body, '&'), lambda x: x <> '')) AS x, generate_subscripts(list_filter(string_split(body, '&'), lambda x: x <> ''), 1) AS i FROM c WHERE {_FORM} AND NOT ({bad('body')} OR contains(body, ';'))),
fp AS (SELECT id, i, {decode("split_part(x, '=', 1)")} AS k, {decode("CASE WHEN contains(x, '=') THEN regexp_replace(x, '^[^=]*=', '') ELSE '' END")} AS v FROM fr),
seg AS (SELECT id, unnest(string_split(regexp_replace(u_path, '^/+|/+\\z', '', 'g'), '/')) AS s, unnest(string_split(regexp_replace(template, '^/+|/+\\z', '', 'g'), '/')) AS t, generate_subscripts(string_split(regexp_replace(u_path, '^/+|/+\\z', '', 'g'), '/'), 1) AS i FROM c WHERE u_ok),
pr AS (
  SELECT id, 'query' AS source, concat('query.', k) AS path, {infer('v')} AS type, {size('v')} AS sample_length, true AS e, 1 AS branch, k AS o1, i AS o2 FROM qp JOIN v USING (id) WHERE u_ok
  UNION ALL SELECT id, 'path', concat('path.segment[', CAST(i - 1 AS VARCHAR), ']'), translate(t, '{{}}', ''), {size('s')}, false, 2, '', i FROM seg WHERE starts_with(t, '{{') AND s IS NOT NULL
  UNION ALL SELECT jb.id, 'json', concat('json', substr(j.fullkey, 2)), {_LEAF}, {_LEAFSIZE}, j.type <> 'NULL', 3, concat('json', substr(j.fullkey, 2)), 0 FROM jb, json_tree(jb.j) j WHERE {_LEAVES}
  UNION ALL SELECT jb.id, 'json', concat('graphql.variables', substr(j.fullkey, 2)), {_LEAF}, {_LEAFSIZE}, j.type <> 'NULL', 4, concat('graphql', substr(j.fullkey, 2)), 0 FROM (SELECT id, json_extract(j, '$.variables') AS j FROM jb WHERE json_type(j, '$.query') = 'VARCHAR' AND json_type(j, '$.variables') IS NOT NULL) jb, json_tree(jb.j) j WHERE {_LEAVES}
  UNION ALL SELECT id, 'form', concat('form.', k), {infer('v')}, {size('v')}, true, 5, k, i FROM fp
  UNION ALL SELECT id, 'multipart', CASE WHEN file <> '' THEN concat('multipart.file.', name) ELSE concat('multipart.', name) END, CASE WHEN file <> '' THEN 'file' ELSE {infer('val')} END, CASE WHEN file <> '' THEN {size('file')} ELSE {size('val')} END, file = '', 6, '', i FROM mq),
params AS (SELECT id, source, path, type, sample_length, e AND NOT {sensitive('path')} AS eligible FROM pr JOIN c USING (id) WHERE NOT blocked QUALIFY row_number() OVER (PARTITION BY id, source, path ORDER BY branch, o1, o2) = 1)"""
ANALYZED = f"""{PARAMETERS},
pa AS (SELECT id, count(*) AS n, bool_or(eligible) AS any_ok, bool_or(eligible AND source = 'query' AND NOT {noise('path')}) AS any_query, list_sort(list(concat(path, ':', type))) AS shape FROM params GROUP BY id),
g AS (SELECT id, coalesce(CASE WHEN json_type(j, '$.operationName') = 'VARCHAR' THEN json_extract_string(j, '$.operationName') END, '') AS gql_name, CASE WHEN json_type(j, '$.query') = 'VARCHAR' THEN json_extract_string(j, '$.query') END AS q FROM jb WHERE json_type(j) = 'OBJECT'),
r AS (SELECT c.*, coalesce(n, 0) AS n, coalesce(any_ok, false) AS any_ok, coalesce(any_query, false) AS any_query, coalesce(shape, []) AS shape, coalesce(gql_name, '') AS gql_name,
   CASE WHEN q IS NULL THEN '' WHEN starts_with(trim(q), 'mutation') THEN 'mutation' ELSE 'query' END AS gql_type, coalesce(sha256(q), '') AS gql_hash,
   CASE WHEN blocked THEN ['blocked_by_policy'] ELSE list_filter([CASE WHEN NOT u_ok OR u_host = '' OR u_scheme NOT IN ('http', 'https') THEN 'malformed_url' END, CASE WHEN method = '' THEN 'missing_method' END,
     CASE WHEN m NOT IN ('GET', 'HEAD') AND body = '' AND coalesce(n, 0) = 0 THEN 'missing_body' END, CASE WHEN body_completeness_known AND NOT body_complete THEN 'request_body_incomplete' END,
     CASE WHEN lifecycle_state NOT IN ('', 'completed', 'loadingFinished') THEN 'lifecycle_not_completed' END], lambda x: x IS NOT NULL) END AS reasons
  FROM c LEFT JOIN pa USING (id) LEFT JOIN g USING (id)),
s AS (SELECT *, CASE WHEN blocked THEN 'NOT_REPLAYABLE' WHEN len(reasons) > 0 THEN 'INCOMPLETE' WHEN auth = 'AUTHENTICATED' THEN 'REPLAYABLE_PRIVATE_AUTH' ELSE 'REPLAYABLE' END AS replayability FROM r),
a AS (SELECT *, classification IN ({texts(CANDIDATE_CLASSES)}) AND starts_with(replayability, 'REPLAYABLE') AND any_ok AS request_eligible,
   classification IN ({texts(QUERY_CLASSES)}) AND m = 'GET' AND any_query AS query_eligible,
   sha256(replace(replace(replace(CAST(to_json({{'auth': auth, 'content_type': content, 'graphql_operation': gql_name, 'graphql_type': gql_type, 'method': m, 'parameters': shape, 'template': template}}) AS VARCHAR), '<', '\\u003c'), '>', '\\u003e'), '&', '\\u0026')) AS schema_hash,
   sha256(concat_ws(chr(0), origin, m, template, auth, gql_type, gql_name, gql_hash)) AS identity, sha256(body) AS body_hash FROM s),
z AS (SELECT *, sha256(concat_ws(chr(0), origin, m, template, auth, gql_type, gql_name, gql_hash, schema_hash)) AS inventory_id,
   CASE WHEN request_eligible THEN '' WHEN len(reasons) > 0 THEN array_to_string(reasons, ',') ELSE 'no_meaningful_controllable_parameter' END AS request_reason,
   CASE WHEN query_eligible THEN '' WHEN len(reasons) > 0 THEN array_to_string(reasons, ',') ELSE 'not_parameterized_get' END AS query_reason FROM a),
k AS (SELECT * FROM z WHERE (source_type = 'cdp' OR starts_with(source_type, 'cdp_')) AND NOT blocked AND lifecycle_state <> 'policy_enforcement_failed')"""
_Q = [
    "CASE completeness_status WHEN 'COMPLETE' THEN 3 WHEN 'UNKNOWN' THEN 2 WHEN 'INCOMPLETE' THEN 1 ELSE CASE WHEN NOT body_completeness_known THEN 2 WHEN body_complete THEN 3 ELSE 1 END END",
    "CASE WHEN lifecycle_state IN ('completed', 'loadingFinished') THEN 4 WHEN lifecycle_state = 'response_received' THEN 3 WHEN lifecycle_state = 'observed' THEN 2 WHEN lifecycle_state IN ('failed', 'timed_out') THEN 1 ELSE 0 END",
    "CAST(body <> '' AS INT)", "CAST(status_code IS NOT NULL AS INT)", "CAST(coalesce(status_code BETWEEN 200 AND 399, false) AS INT)",
    "CAST(auth_session_id <> '' OR \"authorization\" <> '' AS INT)", "CAST(page_url <> '' OR task_id <> '' AS INT)",
]
BEST = ", ".join(f"{q} DESC" for q in _Q) + ", request_timestamp, id"
_LAST = "ORDER BY created_at DESC, id DESC"
_FIRST = "ORDER BY created_at, id"
INVENTORY = f"""inv AS (SELECT inventory_id, any_value(m) AS method, any_value(template) AS endpoint_template, any_value(origin) AS origin, any_value(identity) AS endpoint_identity, first(classification {_FIRST}) AS classification, any_value(content) AS content_type, CAST(to_json(first(reasons {_LAST})) AS VARCHAR) AS exclusion_reasons, min(created_at) AS created_at, max(created_at) AS updated_at,
   any_value(auth) AS authentication_context, any_value(schema_hash) AS request_schema_hash, first(id {_FIRST}) AS first_request_id, first(id ORDER BY {BEST}) AS representative_request_id,
   count(DISTINCT id) AS observation_count, count(DISTINCT body_hash) AS distinct_body_count, CAST(to_json(coalesce(list_sort(list(DISTINCT status_code) FILTER (status_code IS NOT NULL)), [])) AS VARCHAR) AS status_codes,
   CAST(to_json(first(shape {_LAST})) AS VARCHAR) AS parameter_paths, coalesce(first(replayability {_LAST}) FILTER (starts_with(replayability, 'REPLAYABLE')), first(replayability {_FIRST})) AS replayability,
   first(request_eligible {_LAST}) AS request_eligible, first(query_eligible {_LAST}) AS query_eligible FROM k GROUP BY inventory_id)"""


#: Requests saved several times: a save is a row of its own until the newest of each request is picked.
OBS_HISTORY = OBS.replace(f"obs AS ({OBSERVATIONS_SQL})", f"obs AS (SELECT * REPLACE (concat(id, '#', CAST(save AS VARCHAR)) AS id), id AS rid FROM ({HISTORY_SQL}))")
HISTORY = f"""k2 AS (SELECT * REPLACE (rid AS id) FROM (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY rid ORDER BY lifecycle_state IN ('blocked_by_policy', 'policy_enforcement_failed') DESC, created_at DESC) = 1)
  WHERE (source_type = 'cdp' OR starts_with(source_type, 'cdp_')) AND NOT blocked AND lifecycle_state <> 'policy_enforcement_failed'),
st AS (SELECT k2.inventory_id, CAST(to_json(coalesce(list_sort(list(DISTINCT z.status_code) FILTER (z.status_code IS NOT NULL)), [])) AS VARCHAR) AS codes FROM k2 JOIN z ON z.rid = k2.rid AND z.inventory_id = k2.inventory_id GROUP BY k2.inventory_id),
{INVENTORY.replace("FROM k GROUP BY", "FROM k2 GROUP BY")}"""


def members(j: str, k: str, value: str) -> str:
    """An object's members by name, as JSON text; ``value`` is that of name ``k``."""
    return f"""concat('{{', array_to_string(list_transform(list_sort(json_keys({j})), lambda {k}: concat('"', {k}, '":', {value})), ','), '}}')"""


def at(j: str, k: str) -> str:
    return f"""json_extract({j}, concat('$."', {k}, '"'))"""


def canonical(j: str, hide=None) -> str:
    """A JSON object of two levels with sorted names; ``hide`` says which names lose their value."""

    def shown(k: str, value: str) -> str:
        return f"""CASE WHEN {hide(k)} THEN '"[REDACTED]"' ELSE {value} END""" if hide else value

    inner = members(at(j, "k"), "l", shown("l", f"CAST({at(at(j, 'k'), 'l')} AS VARCHAR)"))
    return members(j, "k", shown("k", f"CASE WHEN json_type({at(j, 'k')}) = 'OBJECT' THEN {inner} ELSE CAST({at(j, 'k')} AS VARCHAR) END"))


def redacted_body(hide) -> str:
    """Of the bodies that there are: objects of two levels, forms, and multipart bodies with one sensitive field."""
    form = f"array_to_string(list_transform(string_split(body, '&'), lambda x: CASE WHEN contains(x, '=') AND {sensitive("split_part(x, '=', 1)")} THEN concat(split_part(x, '=', 1), '=%5BREDACTED%5D') ELSE x END), '&')"
    fields = f"""regexp_replace({form}, '(name="sessionToken"\\r\\n\\r\\n)[^\\r\\n]*', '\\1[REDACTED]')"""
    return f"CASE WHEN coalesce(json_type({_JSON}) = 'OBJECT', false) THEN {canonical(f'CAST({_JSON} AS JSON)', hide)} ELSE {fields} END"


#: id and redacted body of each observation; URLs likewise; and the rows that exports are made of.
BODIES = f"rb AS (SELECT id, {redacted_body(sensitive)} AS rbody FROM obs)"
REDACTED_QUERY = f"rq AS (SELECT id, string_agg(concat(url_encode(k), '=', url_encode(w)), '&' ORDER BY k, i) AS q FROM (SELECT DISTINCT id, k, CASE WHEN s THEN 0 ELSE i END AS i, CASE WHEN s THEN '[REDACTED]' ELSE v END AS w FROM (SELECT *, {sensitive('k')} AS s FROM qp)) GROUP BY id)"
_REDACTED_URL = "concat(regexp_replace(url, '(?s)[?#].*\\z', ''), CASE WHEN q IS NOT NULL THEN concat('?', replace(q, '%20', '+')) ELSE '' END, CASE WHEN u_fragment <> '' THEN concat('#', u_fragment) ELSE '' END)"
URLS = f"ru AS (SELECT id, CASE WHEN NOT u_ok THEN url ELSE {_REDACTED_URL} END AS rurl, coalesce(replace(q, '%20', '+'), '') AS rquery FROM v LEFT JOIN rq USING (id))"
LOG_URL = f"CASE WHEN NOT u_ok THEN '<redacted-url>' WHEN contains(u_path, '/devtools/browser/') THEN '<redacted-browser-url>' ELSE {_REDACTED_URL} END"
CURATED = f"""cur AS (SELECT k.*, inv.endpoint_template, inv.replayability AS group_replayability, rurl, rquery, rbody, {_AUTHORITY} AS authority FROM inv JOIN k ON k.id = representative_request_id JOIN ru ON ru.id = k.id JOIN rb ON rb.id = k.id
  WHERE inv.request_eligible AND inv.classification IN ({texts(CANDIDATE_CLASSES)}) AND NOT contains(p, 'refresh-token') AND m <> 'DELETE')"""
_HEADERS = {"Accept": "accept", "Authorization": "CASE WHEN \"authorization\" <> '' THEN '[REDACTED]' ELSE '' END", "Content-Type": "content_type"}


def headers(item: str, join: str, *names: str) -> str:
    """Headers that are there, in order; $n and $v stand for name and value."""
    cells = ", ".join(f"CASE WHEN {_HEADERS[n]} <> '' THEN {item.replace('$n', n).replace('$v', _HEADERS[n])} END" for n in names)
    return f"array_to_string(list_filter([{cells}], lambda x: x IS NOT NULL), {join})"


def text(x: str) -> str:
    return f"CAST(to_json({x}) AS VARCHAR)"


def sql(select: str, *ctes: str) -> str:
    return f"WITH {', '.join(ctes)} {select}" if ctes else select


V = (OBS,)
C = (OBS, CLASSIFIED)
Z = (OBS, CLASSIFIED, ANALYZED)
I = (OBS, CLASSIFIED, ANALYZED, INVENTORY)  # noqa: E741
