"""Redaction of secrets in URLs, headers and bodies.  Every export goes through here.

What cannot be read is not let through: a body that begins like a JSON object or array and is none becomes one mark.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import jsontext
from .classify import is_sensitive, sensitive_name
from .urls import part, parses, path, query_pairs

REDACTED = "[REDACTED]"
#: A signed token in compact form (RFC 7515): a header that opens a JSON object, payload and signature, each in base64url.
TOKEN = r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]*(?:\.[A-Za-z0-9_-]+){2}"
#: Parts of a lower-case member name that the query interface hides besides ``is_sensitive``.
API_PARTS = ["password", "token", "secret", "authorization", "cookie"]


def _encoded(pairs: Column, mark: str) -> Column:
    """Query text of pairs, sorted by key; a sensitive key is there once, with the mark as its value."""
    sorted_ = F.array_sort(F.transform(pairs, lambda p, i: F.struct(p["k"].alias("k"), F.when(sensitive_name(p["k"]), 0).otherwise(i).alias("i"), F.when(sensitive_name(p["k"]), mark).otherwise(p["v"]).alias("v"))))
    return F.array_join(F.transform(F.array_distinct(sorted_), lambda p: F.concat(F.url_encode(p["k"]), F.lit("="), F.url_encode(p["v"]))), "&")


def redact_url(url: Column, mark: str = REDACTED) -> Column:
    query = _encoded(query_pairs(part(url, 4)), mark)
    head = F.regexp_replace(url, r"(?s)[?#].*\z", "")
    tail = F.when(part(url, 5) != "", F.concat(F.lit("#"), part(url, 5))).otherwise("")
    return F.when(parses(url), F.concat(head, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""), tail)).otherwise(url)


def redact_log_url(url: Column) -> Column:
    inner = F.when(F.contains(path(url), F.lit("/devtools/browser/")), "<redacted-browser-url>").otherwise(redact_url(url, "<redacted>"))
    return F.when(parses(url), inner).otherwise("<redacted-url>")


def redact_form(body: Column) -> Column:
    def one(x: Column) -> Column:
        k = F.substring_index(x, "=", 1)
        return F.when(F.contains(x, F.lit("=")) & sensitive_name(k), F.concat(k, F.lit("=%5BREDACTED%5D"))).otherwise(x)

    return F.array_join(F.transform(F.split(body, "&"), one), "&")


def redact_multipart(body: Column) -> Column:
    """Values of sensitive fields, whole, whatever they hold.  The boundary is that of the body's own first delimiter line; a
    body without one is read as a single field."""
    mark = F.regexp_extract(body, r"(?i)(?:^|\n)(--[^\r\n]+)\r?\nContent-", 1)

    def one(x: Column) -> Column:
        head = F.regexp_extract(x, r"(?s)^(.*?\r?\n\r?\n)", 1)
        name = F.regexp_extract(head, r"""(?i)[; \t]name=["']?([^"';\r\n]*)""", 1)
        return F.when((head != "") & sensitive_name(name), F.concat(head, F.lit(REDACTED), F.regexp_extract(x, r"(\r?\n)\z", 1))).otherwise(x)

    parts = F.split(body, F.regexp_replace(mark, "([^A-Za-z0-9])", r"\\$1"))
    return F.when(mark == "", one(body)).otherwise(F.call_function("array_join", F.transform(parts, one), mark))


def redact_jwt(text: Column) -> Column:
    """Tokens are replaced by their length."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)))
    longest = F.array_sort(found, lambda a, b: F.length(b) - F.length(a))
    return F.aggregate(longest, text, lambda t, x: F.replace(t, x, F.concat(F.lit("[JWT_REDACTED:length="), F.length(x).cast("string"), F.lit("]"))))


def _api_name(name: str) -> bool:
    return is_sensitive(name) or any(x in name.lower() for x in API_PARTS)


def _json_udf(hide):
    @F.pandas_udf(StringType())
    def redact(bodies: pd.Series) -> pd.Series:
        def one(body):
            if body is None:
                return None
            try:
                return jsontext.write(jsontext.parse(body, hide, REDACTED))
            except ValueError:
                return None

        return bodies.map(one)

    return redact


#: JSON with sensitive members replaced at any depth, keys sorted; null where the body is not JSON.
redact_json = _json_udf(is_sensitive)
_redact_api_json = _json_udf(_api_name)


def _body(body: Column, redact) -> Column:
    json = redact(F.when(body.rlike(r"^\s*[\[{\"0-9tfn-]"), body))
    return F.coalesce(json, F.when(body.rlike(r"^\s*[\[{]"), REDACTED), redact_jwt(redact_multipart(redact_form(body))))


def redact_body(body: Column) -> Column:
    """JSON members; or else form pairs, multipart fields and tokens; or else, of what only looks like JSON, nothing."""
    return _body(body, redact_json)


def redact_api_body(body: Column) -> Column:
    """``redact_body`` for the query interface, which hides more names."""
    return _body(body, _redact_api_json)


def redact_headers(headers: Column) -> Column:
    return F.transform_values(headers, lambda k, v: F.when(sensitive_name(k), REDACTED).otherwise(v))


def report_headers(headers: Column) -> Column:
    return F.transform_values(headers, lambda k, v: F.when(F.lower(k).isin("cookie", "authorization", "proxy-authorization"), "<redacted>").otherwise(v))
