"""Request observations from the driver tables.

The test data has no captured requests, so they are derived from ``events`` and ``pages`` by fixed rules.  The rules are
SQL that Spark and DuckDB read alike, so a check in the other engine starts from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import spread

#: One flat row for each event.  Paths, bodies and headers go by remainders of the id, so that every rule gets rows.
OBSERVATIONS_SQL = """
WITH e AS (
  SELECT event_id, user_id, event_type, props, value, ts,
    CASE event_type WHEN 'view' THEN 'GET' WHEN 'click' THEN 'POST' WHEN 'purchase' THEN 'POST' WHEN 'signup' THEN 'PUT'
      ELSE CASE event_id % 3 WHEN 0 THEN 'DELETE' WHEN 1 THEN 'get' ELSE 'OPTIONS' END END AS method,
    CAST(event_id AS STRING) AS eid, CAST(user_id AS STRING) AS uid
  FROM events),
p AS (
  SELECT *,
    CASE event_id % 29
      WHEN 1 THEN '/_next/static/app.js' WHEN 2 THEN '/assets/Site.CSS' WHEN 3 THEN '/v1/telemetry' WHEN 4 THEN '/auth/refresh-token'
      WHEN 5 THEN '/GraphQL' WHEN 6 THEN '/login' WHEN 7 THEN '/reset-password' WHEN 8 THEN concat('/a/6f9619ff-8b86-4011-b42d-00c04fc9', lpad(eid, 4, '0'))
      WHEN 9 THEN concat('/c/cve-2024-', lpad(eid, 6, '0')) WHEN 10 THEN concat('/f/0123456789abcdef0123', eid) WHEN 11 THEN concat('/o/Zz_-Zz_-Zz_-Zz_-Zz_-Zz_-', eid)
      WHEN 12 THEN '/a/session' WHEN 13 THEN '/webpack-hmr/x' WHEN 14 THEN concat('/x/cpe%3A2.3%3Aa/', eid, '/') WHEN 15 THEN ''
      WHEN 16 THEN '/device/revoke' WHEN 17 THEN '/signup' WHEN 18 THEN '/Caf%C3%A9/a%20b'
      ELSE concat('/api/', event_type, 's/', CAST(event_id % 40 AS STRING)) END AS path,
    concat(CASE WHEN event_id % 5 < 3 THEN concat('user=', CAST(user_id % 50 AS STRING)) ELSE '' END,
      CASE event_id % 11 WHEN 0 THEN '&utm_source=mail' WHEN 1 THEN '&page=2' WHEN 2 THEN '&_rsc=abc' WHEN 3 THEN concat('&accessToken=t', eid)
        WHEN 4 THEN '&q=a+b&q=%C3%A9' WHEN 5 THEN '&bad=%zz&ok=true' WHEN 6 THEN '&x=1.5' ELSE '' END) AS query
  FROM e),
b AS (
  SELECT *,
    CASE WHEN method IN ('POST', 'PUT') THEN CASE event_id % 6 WHEN 0 THEN 'application/json; charset=UTF-8' WHEN 1 THEN 'application/x-www-form-urlencoded'
      WHEN 2 THEN 'Application/JSON' WHEN 3 THEN 'multipart/form-data; boundary=BbB' WHEN 4 THEN 'text/xml' ELSE '' END ELSE '' END AS content_type,
    CASE WHEN method IN ('POST', 'PUT') THEN CASE event_id % 6 WHEN 0 THEN props
      WHEN 1 THEN concat('name=a+b&n=', CAST(user_id % 9 AS STRING), '&password=p', eid, '&flag=true')
      WHEN 2 THEN concat('{"query":"', CASE WHEN event_id % 4 = 0 THEN 'mutation M { a }' ELSE 'query Q { a }' END, '","operationName":"Q', CAST(event_id % 3 AS STRING), '","variables":{"id":', CAST(user_id % 7 AS STRING), ',"authToken":"s"}}')
      WHEN 3 THEN concat('--BbB', chr(13), chr(10), 'Content-Disposition: form-data; name="note"', chr(13), chr(10), chr(13), chr(10), 'v', CAST(user_id % 5 AS STRING), chr(13), chr(10), '--BbB', chr(13), chr(10),
        'Content-Disposition: form-data; name="up"; filename="a.txt"', chr(13), chr(10), chr(13), chr(10), 'data', chr(13), chr(10), '--BbB', chr(13), chr(10),
        'Content-Disposition: form-data; name="sessionToken"', chr(13), chr(10), chr(13), chr(10), 'ab-', eid, chr(13), chr(10), '--BbB--', chr(13), chr(10))
      WHEN 4 THEN '<a/>' ELSE '' END ELSE '' END AS body
  FROM p)
SELECT concat('r', eid) AS id, concat('c', CAST(event_id % 3 AS STRING)) AS crawl_id, CASE WHEN event_id % 4 = 0 THEN concat('t', CAST(event_id % 8 AS STRING)) ELSE '' END AS task_id,
  CASE WHEN event_id % 2 = 0 THEN 'https://app.example.test/home' ELSE '' END AS page_url, CASE WHEN user_id % 10 = 0 THEN concat('s', uid) ELSE '' END AS auth_session_id,
  method, concat(CASE event_id % 13 WHEN 0 THEN 'http://App.Example.test:8080' WHEN 1 THEN 'HTTPS://app.example.test:443' WHEN 2 THEN 'ftp://app.example.test' ELSE 'https://app.example.test' END, path,
    CASE WHEN query = '' THEN '' ELSE concat('?', query) END, CASE WHEN event_id % 17 = 0 THEN '#top' ELSE '' END) AS url,
  content_type, CASE WHEN event_id % 12 = 0 THEN 'text/html,*/*' ELSE 'application/json' END AS accept, CASE WHEN user_id % 7 = 0 THEN concat('Bearer b', uid) ELSE '' END AS authorization,
  body, CASE WHEN event_id % 6 = 5 AND method IN ('POST', 'PUT') THEN 'binary' ELSE '' END AS body_type,
  CASE event_id % 16 WHEN 0 THEN 'anchor' WHEN 1 THEN 'cdp' WHEN 2 THEN 'navigation' WHEN 3 THEN 'cdp_policy_blocked' ELSE 'cdp_observed' END AS source_type,
  CASE event_id % 10 WHEN 0 THEN 'failed' WHEN 1 THEN 'response_received' WHEN 2 THEN 'loadingFinished' WHEN 3 THEN 'observed' ELSE 'completed' END AS lifecycle_state,
  event_id % 9 <> 0 AS body_complete, event_id % 3 = 0 AS body_completeness_known, CASE event_id % 5 WHEN 0 THEN 'COMPLETE' WHEN 1 THEN 'INCOMPLETE' WHEN 2 THEN 'UNKNOWN' ELSE '' END AS completeness_status,
  CASE WHEN event_id % 8 = 7 THEN NULL ELSE CASE CAST(event_id % 7 AS INT) WHEN 0 THEN 200 WHEN 1 THEN 404 WHEN 2 THEN 302 WHEN 3 THEN 500 ELSE 201 END END AS status_code,
  CAST(event_id % 1000 AS DOUBLE) AS request_timestamp, CASE WHEN event_id % 6 = 0 THEN '' ELSE concat('cdp-', eid) END AS cdp_request_id, ts AS created_at, event_id, user_id
FROM b
"""

_COLUMNS = [
    "id", "crawl_id", "task_id", "page_url", "auth_session_id", "method", "url", "content_type", "accept", "authorization", "body", "body_type", "source_type", "lifecycle_state", "body_complete", "body_completeness_known",
    "completeness_status", "status_code", "request_timestamp", "cdp_request_id", "created_at", "event_id", "user_id",
]


def _saved(save: int, where: str = "true", **changed: str) -> str:
    columns = ", ".join(f"{changed[c]} AS {c}" if c in changed else f"o.{c}" for c in _COLUMNS)
    return f"SELECT {columns}, {save} AS save FROM o WHERE {where}"


#: Every request as it was saved, some of them two or three times: first seen, answered, completed.
HISTORY_SQL = f"""
WITH o AS ({OBSERVATIONS_SQL})
{_saved(2)}
UNION ALL {_saved(1, "event_id % 5 = 0", lifecycle_state="'response_received'", status_code="400", created_at="o.created_at - INTERVAL 1 MINUTE")}
UNION ALL {_saved(0, "event_id % 3 = 0", lifecycle_state="'observed'", status_code="CAST(NULL AS INT)", body="''", created_at="o.created_at - INTERVAL 2 MINUTE")}
"""

#: Pages with a form and calls of every kind that scripts make, by fixed rules from the page's number.
SCRIPTED_SQL = """
SELECT page_id, url, concat(html, '<form method="', CASE WHEN page_id % 2 = 0 THEN 'post' ELSE 'GET' END, '" action="/form/', CAST(page_id % 7 AS STRING), '"></form>',
  '<script>fetch("/api/f/', CAST(page_id AS STRING), '", {});axios.post(', chr(39), '/api/x?a=', CAST(page_id % 3 AS STRING), chr(39), ');x.open("PUT", "/api/o");new WebSocket("wss://ws.example.test/', CAST(page_id % 5 AS STRING), '");',
  'new EventSource("/sse");navigator.sendBeacon("/beacon", 1);import("/chunks/', CAST(page_id % 4 AS STRING), '.js");routes = [{path: "/users/:id"}, {path:', chr(39), '/home', chr(39), '}]</script>') AS html FROM pages
"""

#: Pages, and their links resolved against the page's origin where they are root-relative.
PAGE_HREF = 'href="([^"]*)"'


def tables(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Temporary views of driver tables."""
    for n in names:
        spread(spark.read.parquet(f"{sf_dir}/{n}.parquet")).createOrReplaceTempView(n)


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations in the engine's schema: headers as a map, the response as a nullable struct."""
    tables(spark, sf_dir, "events")
    return _shaped(spark.sql(OBSERVATIONS_SQL))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, with a row for each time that a request was saved."""
    tables(spark, sf_dir, "events")
    return _shaped(spark.sql(HISTORY_SQL))


def scripted_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "pages")
    return spark.sql(SCRIPTED_SQL)


def _shaped(flat: DataFrame) -> DataFrame:
    pairs = F.array(*(F.struct(F.lit(n).alias("key"), F.col(c).alias("value")) for n, c in (("Content-Type", "content_type"), ("Accept", "accept"), ("Authorization", "authorization"))))
    headers = F.map_from_entries(F.filter(pairs, lambda p: p["value"] != ""))
    response = F.when(F.col("status_code").isNotNull(), F.struct("status_code"))
    return flat.withColumns({"headers": headers, "response": response, "resource_type": F.lit("")}).drop("content_type", "accept", "authorization", "status_code")


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, kind (page, anchor or script) and url of each page and each link or script source in it."""
    pages = spread(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    origin = F.substring_index("url", "/", 3)
    found = F.concat(
        F.array(F.struct(F.lit("page").alias("kind"), F.col("url").alias("target"))),
        F.transform(F.regexp_extract_all("html", F.lit(PAGE_HREF), F.lit(1)), lambda x: F.struct(F.lit("anchor").alias("kind"), x.alias("target"))),
        F.transform(F.regexp_extract_all("html", F.lit('<script[^>]* src="([^"]*)"'), F.lit(1)), lambda x: F.struct(F.lit("script").alias("kind"), x.alias("target"))),
    )
    rows = pages.select("page_id", origin.alias("origin"), F.explode(found).alias("f")).select("page_id", "origin", "f.*")
    absolute = F.when(F.col("target").startswith("/") & ~F.col("target").startswith("//"), F.concat("origin", "target")).otherwise(F.col("target"))
    return rows.select("page_id", "kind", absolute.alias("url"))


#: (kind, pattern, method or None where the pattern's first group has it) of what a page's markup and scripts call; the last
#: group is the target.
CALLS = [
    ("form", r"""(?i)<form[^>]* method=["']?([a-z]+)["']?[^>]* action=["']([^"']*)["']""", None),
    ("fetch", r"""\bfetch\(\s*["'`]([^"'`]+)["'`]""", "GET"),
    ("axios", r"""\baxios\.(get|post|put|patch|delete|head)\(\s*["'`]([^"'`]+)["'`]""", None),
    ("xhr", r"""\.open\(\s*["']([A-Za-z]+)["']\s*,\s*["'`]([^"'`]+)["'`]""", None),
    ("websocket", r"""\bnew WebSocket\(\s*["'`]([^"'`]+)["'`]""", "GET"),
    ("eventsource", r"""\bnew EventSource\(\s*["'`]([^"'`]+)["'`]""", "GET"),
    ("beacon", r"""\bsendBeacon\(\s*["'`]([^"'`]+)["'`]""", "POST"),
    ("import", r"""\bimport\(\s*["'`]([^"'`]+)["'`]""", "GET"),
    ("route", r"""\bpath:\s*["'`](/[^"'`]*)["'`]""", "GET"),
]


def script_endpoints(pages: DataFrame) -> DataFrame:
    """page_id, kind, method and target of every form and call that a page (page_id, html) makes; by patterns, so a hint and no
    more."""

    def found(kind: str, pattern: str, method: str | None):
        group = lambda n: F.regexp_extract_all("html", F.lit(pattern), F.lit(n))
        target = group(1 if method else 2)
        verb = F.transform(target, lambda t: F.lit(method)) if method else group(1)
        return F.transform(F.arrays_zip(verb.alias("m"), target.alias("t")), lambda z: F.struct(F.lit(kind).alias("kind"), F.upper(z["m"]).alias("method"), z["t"].alias("target")))

    return pages.select("page_id", F.explode(F.concat(*(found(*call) for call in CALLS))).alias("x")).select("page_id", "x.*")
