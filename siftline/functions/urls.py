"""URL, header and content-type expressions.  All are built-in functions, so they stay inside generated code.

URLs are split by the RFC 3986 pattern, as ``parse_url`` raises or gives null on much that browsers send.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

URL = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"


def part(url: Column, n: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query, 5 fragment; empty if absent."""
    return F.coalesce(F.regexp_extract(url, URL, n), F.lit(""))


def scheme(url: Column) -> Column:
    return F.lower(part(url, 1))


def authority(url: Column) -> Column:
    """Host and port, without user information."""
    return F.regexp_replace(part(url, 2), r"^.*@", "")


def host(url: Column) -> Column:
    return F.lower(F.regexp_replace(authority(url), r":[0-9]*\z", ""))


def port(url: Column) -> Column:
    return F.regexp_extract(authority(url), r":([0-9]+)\z", 1)


def bad_escape(text: Column) -> Column:
    return F.contains(F.regexp_replace(text, "%[0-9A-Fa-f]{2}", ""), F.lit("%"))


def parses(url: Column) -> Column:
    """Whether a strict parser would take the URL: no control characters, no bad escape in path or host."""
    return ~(url.rlike(r"[\x00-\x1F\x7F]") | bad_escape(part(url, 3)) | bad_escape(part(url, 2)))


def unescape(text: Column) -> Column:
    """Percent-decoding where ``+`` stays; what cannot be decoded stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def path(url: Column) -> Column:
    return unescape(part(url, 3))


def lower_path(url: Column) -> Column:
    return F.lower(path(url))


#: What a path segment may be, first match wins.
SEGMENTS = [
    ("{uuid}", r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\z"),
    ("{cve}", r"(?i)^CVE-[0-9]{4}-[0-9]{4,}\z"),
    ("{cpe}", r"(?i)^cpe:2\.3:"),
    ("{int}", r"^[0-9]+\z"),
    ("{hash}", r"(?i)^[0-9a-f]{20,}\z"),
    ("{id}", r"^[A-Za-z0-9_-]{24,}\z"),
]


def segment_template(segment: Column) -> Column:
    plain, out = unescape(segment), F.when(F.lit(False), segment)
    for name, pattern in SEGMENTS:
        out = out.when(plain.rlike(pattern), F.lit(name))
    return out.otherwise(segment)


def endpoint_template(url: Column) -> Column:
    """The path with variable segments named; a URL that does not parse stays as it is."""
    made = F.array_join(F.transform(F.split(part(url, 3), "/"), segment_template), "/")
    return F.when(~parses(url), url).when(made == "", F.lit("/")).otherwise(made)


def request_origin(url: Column) -> Column:
    """scheme://host:port, with the scheme's own port filled in."""
    filled = F.when(port(url) != "", port(url)).when(scheme(url) == "https", F.lit("443")).otherwise("80")
    return F.when(parses(url), F.concat(scheme(url), F.lit("://"), host(url), F.lit(":"), filled)).otherwise("")


def origin_of(url: Column) -> Column:
    return F.substring_index(url, "/", 3)


def normalize_url(url: Column) -> Column:
    """Lower scheme and host, no default port, no fragment, no trailing slash, sorted query."""
    default = ((scheme(url) == "https") & (port(url) == "443")) | ((scheme(url) == "http") & (port(url) == "80"))
    where = F.concat(host(url), F.when((port(url) != "") & ~default, F.concat(F.lit(":"), port(url))).otherwise(""))
    query = F.array_join(F.array_sort(F.filter(F.split(part(url, 4), "&"), lambda x: x != "")), "&")
    return F.concat(
        F.when(scheme(url) != "", F.concat(scheme(url), F.lit("://"))).otherwise(""),
        where,
        F.regexp_replace(part(url, 3), r"/+\z", ""),
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
    )


def query_pairs(query: Column, strict: bool = False) -> Column:
    """array<struct<k, v, ok>> of a query or form body, in order.  Pairs with a bad escape or a semicolon are not ok; ``strict`` keeps
    them for the caller to see, otherwise they are left out."""
    def pair(x: Column) -> Column:
        value = F.when(F.contains(x, F.lit("=")), F.regexp_replace(x, r"(?s)^[^=]*=", "")).otherwise("")
        decoded = [F.coalesce(F.try_url_decode(c), F.lit("")) for c in (F.substring_index(x, "=", 1), value)]
        return F.struct(decoded[0].alias("k"), decoded[1].alias("v"), (~(bad_escape(x) | F.contains(x, F.lit(";")))).alias("ok"))

    pairs = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), pair)
    return pairs if strict else F.filter(pairs, lambda p: p["ok"])


def drop_query_key(url: Column, key: str) -> Column:
    """The URL without a query key; other parameters stay in place."""
    rest = F.array_join(F.filter(F.split(part(url, 4), "&"), lambda x: ~(F.substring_index(x, "=", 1) == key)), "&")
    head = F.regexp_replace(url, r"(?s)[?#].*\z", "")
    tail = F.when(part(url, 5) != "", F.concat(F.lit("#"), part(url, 5))).otherwise("")
    return F.concat(head, F.when(rest != "", F.concat(F.lit("?"), rest)).otherwise(""), tail)


# -- headers and content types


def header_value(headers: Column, name: str) -> Column:
    """Value of a header whatever its case; empty if absent."""
    hit = F.map_filter(headers, lambda k, v: F.lower(k) == name.lower())
    return F.coalesce(F.try_element_at(F.map_values(hit), F.lit(1)), F.lit(""))


def media_type(content_type: Column) -> Column:
    return F.lower(F.trim(F.substring_index(content_type, ";", 1)))


def content_parameter(content_type: Column, name: str) -> Column:
    return F.regexp_extract(content_type, rf'(?i);\s*{name}="?([^";\s]+)', 1)


def content_flags(content_type: Column) -> Column:
    """Struct of type parts and flags."""
    m = media_type(content_type)
    json, xml, graphql = (F.contains(m, F.lit(x)) for x in ("json", "xml", "graphql"))
    form = m.isin("multipart/form-data", "application/x-www-form-urlencoded")
    text = m.startswith("text/") | json | xml | graphql
    return F.struct(
        F.substring_index(m, "/", 1).alias("primary_type"),
        F.when(F.contains(m, F.lit("/")), F.regexp_replace(m, "^[^/]*/", "")).otherwise("").alias("sub_type"),
        content_parameter(content_type, "charset").alias("charset"),
        content_parameter(content_type, "boundary").alias("boundary"),
        json.alias("is_json"), xml.alias("is_xml"), graphql.alias("is_graphql"),
        m.startswith("multipart/").alias("is_multipart"), (m == "application/x-www-form-urlencoded").alias("is_urlencoded"),
        form.alias("is_form"), text.alias("is_text"), ((m != "") & ~text & ~form).alias("is_binary"),
    )


def body_type(content_type: Column) -> Column:
    f = content_flags(content_type)
    out = F.when(f["is_json"], "json").when(f["is_multipart"], "multipart").when(f["is_urlencoded"], "form-urlencoded")
    return out.when(f["is_graphql"], "graphql").when(f["is_xml"], "xml").when(f["is_text"], "text").otherwise("binary")


def fingerprint(method: Column, url: Column, body: Column, content_type: Column, canonical: Column) -> Column:
    """Hash that does not depend on case, port, fragment, order of query or form keys, JSON layout or charset.  ``canonical``
    is the body as canonical JSON, null where it is not JSON."""
    m = media_type(content_type)
    form = F.array_join(F.array_sort(F.split(body, "&")), "&")
    text = F.when(F.contains(m, F.lit("json")), F.coalesce(canonical, body)).when(m == "application/x-www-form-urlencoded", form).otherwise(body)
    return F.sha2(F.concat_ws("\0", F.upper(method), normalize_url(url), text, m), 256)


def short_hash(value: Column) -> Column:
    return F.substring(F.sha2(value, 256), 1, 16)


def joined_base64(parts: Column) -> Column:
    """Decoded parts one after another; null as soon as one is not valid base64."""
    out = F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.try_to_binary(p, F.lit("base64")))
    return F.when(~F.exists(out, lambda b: b.isNull()), F.aggregate(F.transform(out, lambda b: F.hex(b)), F.lit(""), lambda a, b: F.concat(a, b))).cast("string")


def with_url(df: DataFrame) -> DataFrame:
    """Columns of the URL that later rules share, computed once a row."""
    u = F.col("url")
    return df.withColumns(
        {"u_ok": parses(u), "u_scheme": scheme(u), "u_host": host(u), "u_path": path(u), "u_query": part(u, 4), "template": endpoint_template(u), "origin": request_origin(u)}
    ).withColumn("p", F.lower("u_path"))
