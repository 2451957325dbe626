"""Curated, always redacted exports of representative requests."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import CANDIDATE_CLASSES, noise_name
from ..functions.params import schema_parameters
from ..functions.redact import redact_body, redact_headers, redact_url
from ..functions.urls import authority, host, part, scheme
from ..sources import files
from .inventory import inventory


@dataclass(frozen=True)
class Gates:
    """What may leave; all off unless switched on.  There is no switch against redaction."""

    auth: bool = False
    mutations: bool = False
    destructive: bool = False


#: Columns of a request that exports and reports read.
_CARRIED = ("method", "url", "headers", "body", "body_type", "p", "page_url", "task_id", "source_type", "lifecycle_state", "cdp_request_id", "created_at", "response", "parameters", "query_eligible")


def with_representatives(analyzed: DataFrame, *columns: str) -> DataFrame:
    """The representative request of each group with the group's columns, out of the aggregate that finds it: the requests are
    analysed once, and only ``columns`` (all that exports read, if none are named) travel with it."""
    groups = inventory(analyzed, **{c: F.col(c) for c in columns or _CARRIED})
    return groups.select(
        "inventory_id", "endpoint_template", F.col("replayability").alias("group_replayability"), F.col("request_eligible").alias("group_eligible"), F.col("classification").alias("group_class"), "authentication_context", "representative.*"
    )


def curated(analyzed: DataFrame, gates: Gates) -> DataFrame:
    m = F.upper("method")
    rows = with_representatives(analyzed).where(
        F.col("group_eligible") & F.col("group_class").isin(CANDIDATE_CLASSES) & ~F.contains("p", F.lit("refresh-token"))
        & (F.lit(gates.destructive) | (m != "DELETE"))
        & (F.lit(gates.mutations) | m.isin("GET", "HEAD", "DELETE"))
        & (F.lit(gates.auth) | (F.col("authentication_context") != "AUTHENTICATED"))
    )
    return rows.withColumn("replayability", F.col("group_replayability"))


def redacted(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"url": redact_url(F.col("url")), "body": redact_body(F.col("body")), "headers": redact_headers(F.col("headers"))})


def replay_rows(analyzed: DataFrame) -> DataFrame:
    """Browser requests that change something, without framework and token refresh traffic."""
    seen = (F.col("source_type") == "cdp") | F.col("source_type").startswith("cdp_")
    return analyzed.where(seen & ~F.col("blocked") & ~F.upper("method").isin("GET", "OPTIONS", "HEAD") & (F.col("classification") != "FRAMEWORK") & ~F.contains("p", F.lit("refresh-token")))


def numbered(rows: DataFrame) -> DataFrame:
    """Files are numbered in order of creation."""
    return files.numbered(rows, "number", "created_at", "id").withColumn("request_filename", F.format_string("request-%03d.txt", "number"))


def header_list(headers: Column) -> Column:
    return F.transform(F.array_sort(F.map_entries(headers)), lambda h: F.struct(h["key"].alias("key"), h["value"].alias("value")))


def http_text(url: Column, method: Column, headers: Column, body: Column) -> Column:
    """A request as text; headers by name, as maps have no order."""
    uri = F.concat(F.when(part(url, 3) == "", F.lit("/")).otherwise(part(url, 3)), F.when(part(url, 4) != "", F.concat(F.lit("?"), part(url, 4))).otherwise(""))
    lines = F.transform(F.filter(header_list(headers), lambda h: F.lower(h["key"]) != "host"), lambda h: F.concat(h["key"], F.lit(": "), h["value"], F.lit("\r\n")))
    return F.concat(F.upper(method), F.lit(" "), uri, F.lit(" HTTP/1.1\r\nHost: "), authority(url), F.lit("\r\n"), F.array_join(lines, ""), F.lit("\r\n"), body)


def raw_text(rows: DataFrame) -> DataFrame:
    return redacted(rows).select("id", http_text(F.col("url"), F.col("method"), F.col("headers"), F.col("body")).alias("text"))


def _har_entry() -> Column:
    request = F.struct(F.upper("method").alias("method"), "url", "headers", F.struct(F.col("body_type").alias("mimeType"), F.col("body").alias("text")).alias("postData"))
    return F.struct(request.alias("request"), F.lit(None).cast("string").alias("response"))


def har(rows: DataFrame) -> DataFrame:
    """One row an entry: JSON of a HAR 1.2 entry.  ``write_har`` puts entries into one document."""
    return redacted(rows).select("id", F.to_json(_har_entry(), {"ignoreNullFields": "false"}).alias("entry"))


def _document(items: DataFrame, text: str, head: str, tail: str, path: str) -> None:
    files.write_document(files.numbered(items, "n", "id").select("n", F.col(text).alias("text")), head, tail, path)


def write_har(entries: DataFrame, path: str) -> None:
    _document(entries, "entry", '{"log":{"version":"1.2","creator":{"name":"siftline","version":"1"},"entries":[', "]}}", path)


def write_postman(items: DataFrame, path: str, name: str = "siftline") -> None:
    """A v2.1 collection (its schema's address is a fixed value)."""
    info = json.dumps({"name": name, "schema": "https://schema.getpostman.com/json/collection/v2.1.0/collection.json"})
    _document(items, "item", f'{{"info":{info},"item":[', "]}", path)


def write_index(index_: DataFrame, path: str) -> None:
    rows = index_.select(F.col("request_filename").alias("id"), F.to_json(F.struct(*index_.columns)).alias("row"))
    _document(rows, "row", "[", "]", path)


def write_candidates(candidates: DataFrame, path: str) -> None:
    """``candidates.json`` and ``urls.txt``, a distinct URL a line, below ``path``."""
    rows = candidates.select(F.concat_ws(" ", "id", "parameter_path").alias("id"), F.to_json(F.struct(*candidates.columns)).alias("row"))
    _document(rows, "row", "[", "]", f"{path}/candidates.json")
    files.write_lines(candidate_urls(candidates), "url", f"{path}/urls.txt")


def leaks(artifacts: DataFrame, markers: list[str]) -> DataFrame:
    """How many rows of each artifact (artifact, text) hold any of ``markers``; none may, of an export."""
    held = F.lit(False)
    for m in markers:
        held = held | F.contains("text", F.lit(m))
    return artifacts.groupBy("artifact").agg(F.count(F.lit(1)).alias("texts"), F.count_if(held).alias("leaks"))


def postman(rows: DataFrame) -> DataFrame:
    """One row an item of a v2.1 collection."""
    u = F.col("url")
    address = F.struct(u.alias("raw"), scheme(u).alias("protocol"), F.split(host(u), r"\.").alias("host"), F.split(F.regexp_replace(part(u, 3), "^/+|/+$", ""), "/").alias("path"))
    request = F.struct(F.upper("method").alias("method"), header_list(F.col("headers")).alias("header"), F.struct(F.lit("raw").alias("mode"), F.col("body").alias("raw")).alias("body"), address.alias("url"))
    return redacted(rows).select("id", F.to_json(F.struct(F.concat_ws(" ", F.upper("method"), u).alias("name"), request.alias("request"))).alias("item"))


def index(rows: DataFrame) -> DataFrame:
    rows = numbered(redacted(rows))
    return rows.select(
        "request_filename", F.col("id").alias("request_id"), F.upper("method").alias("method"), F.col("url").alias("original_url"), "endpoint_template", schema_parameters(F.col("parameters")).alias("parameter_paths"), "body_type",
        (F.col("authentication_context") == "AUTHENTICATED").alias("authentication_required"), F.col("page_url").alias("source_page"), "task_id", F.coalesce("response.status_code", F.lit(0)).alias("response_status"), "replayability",
        F.array().cast("array<string>").alias("exclusion_warnings"),
    )


def query_candidates(analyzed: DataFrame, gates: Gates) -> DataFrame:
    """A row for each query parameter of a representative that can be a candidate; URLs are redacted."""
    rows = with_representatives(analyzed, "method", "url", "page_url", "created_at", "parameters", "query_eligible").where("query_eligible")
    rows = rows.select("id", "method", "url", "page_url", "created_at", "authentication_context", F.explode_outer("parameters").alias("x")).where("x.source = 'query' AND x.eligible")
    secret = F.col("authentication_context") == "AUTHENTICATED"
    return rows.where(~noise_name(F.col("x.path"))).select(
        "id", F.upper("method").alias("method"), redact_url(F.col("url")).alias("url"), F.col("x.path").alias("parameter_path"), F.col("x.type").alias("sample_type"), F.col("page_url").alias("source_page"), "created_at",
        secret.alias("auth_required"), F.lit("url").alias("recommended_input_format"), F.when(secret & F.lit(not gates.auth), "private_auth_required").otherwise("").alias("exclusion_reason"),
    )


def candidate_urls(candidates: DataFrame) -> DataFrame:
    return candidates.where("exclusion_reason = ''").select("url").distinct()
