"""Parameters of a request: query, path, JSON, GraphQL variables, form and multipart, with inferred types.

JSON bodies of any depth are flattened by an Arrow-batched UDF, as built-in functions cannot recurse inside a row; it
sees only bodies that are JSON.  Everything else is built-in functions.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import jsontext
from .classify import boundary, has, is_json_object, member, noise_name, sensitive_name
from .urls import bad_escape, content_flags, header_value, query_pairs

_LEAF = {"path": T.StringType(), "type": T.StringType(), "sample_length": T.IntegerType(), "name": T.StringType(), "blank": T.BooleanType()}
LEAVES = T.ArrayType(T.StructType([T.StructField(n, t) for n, t in _LEAF.items()]))
PARAMETER = "array<struct<source:string,path:string,type:string,sample_length:int,eligible:boolean>>"


def infer_type(v: Column) -> Column:
    """boolean, integer (fits 64 bits), number or string, from text."""
    exact = F.when(v.rlike(r"^[+-]?[0-9]+\z"), F.regexp_replace(v, r"^\+", "").try_cast("decimal(38,0)"))
    fits = F.coalesce(exact.between(F.lit(-(2**63)), F.lit(2**63 - 1)), F.lit(False))
    number = v.rlike(r"(?i)^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|inf|infinity|nan|0x[0-9a-f]+\.?[0-9a-f]*p[+-]?[0-9]+)\z")
    return F.when(v.isin("true", "false"), "boolean").when(fits, "integer").when(number, "number").otherwise("string")


def _item(source: str, path: Column, kind: Column, length: Column, eligible: Column) -> Column:
    return F.struct(F.lit(source).alias("source"), path.alias("path"), kind.alias("type"), length.cast("int").alias("sample_length"), (eligible & ~sensitive_name(path)).alias("eligible"))


def _sorted_pairs(pairs: Column) -> Column:
    """By key, values of one key in their order."""
    numbered = F.transform(pairs, lambda p, i: F.struct(p["k"].alias("k"), i.alias("i"), p["v"].alias("v")))
    return F.array_sort(numbered)


def query_parameters(query: Column) -> Column:
    return F.transform(_sorted_pairs(query_pairs(query)), lambda p: _item("query", F.concat(F.lit("query."), p["k"]), infer_type(p["v"]), F.octet_length(p["v"]), F.lit(True)))


def path_parameters(path: Column, template: Column) -> Column:
    def trim(c: Column) -> Column:
        return F.regexp_replace(c, r"^/+|/+\z", "")

    named = F.transform(F.arrays_zip(F.split(trim(path), "/").alias("s"), F.split(trim(template), "/").alias("t")), lambda z, i: F.struct(z["s"].alias("s"), z["t"].alias("t"), i.alias("i")))
    hits = F.filter(named, lambda z: z["s"].isNotNull() & F.coalesce(z["t"].startswith("{"), F.lit(False)))
    return F.transform(hits, lambda z: _item("path", F.format_string("path.segment[%d]", z["i"]), F.translate(z["t"], "{}", ""), F.octet_length(z["s"]), F.lit(False)))


def form_parameters(body: Column) -> Column:
    """Nothing at all if one pair is malformed."""
    pairs = query_pairs(body, strict=True)
    items = F.transform(_sorted_pairs(pairs), lambda p: _item("form", F.concat(F.lit("form."), p["k"]), infer_type(p["v"]), F.octet_length(p["v"]), F.lit(True)))
    return F.when(F.forall(pairs, lambda p: p["ok"]), items).otherwise(F.array().cast(PARAMETER))


def multipart_parameters(body: Column, mark: Column) -> Column:
    """Fields by name; files are named but never eligible; a value's first 4097 bytes are read (a fixed value)."""
    parts = F.filter(F.split(body, F.concat(F.lit("--\\Q"), mark, F.lit("\\E"))), lambda x: F.contains(x, F.lit("\r\n\r\n")))

    def read(x: Column) -> Column:
        head = F.substring_index(x, "\r\n\r\n", 1)
        name, file = F.regexp_extract(head, '(?i)[; ]name="([^"]*)"', 1), F.regexp_extract(head, '(?i)filename="([^"]*)"', 1)
        value = F.regexp_replace(F.regexp_replace(x, r"(?s)^.*?\r\n\r\n", ""), r"\r\n\z", "")
        kept = F.when(F.octet_length(value) > 4097, F.substring(value.cast("binary"), 1, 4097).cast("string")).otherwise(value)
        of_file = _item("multipart", F.concat(F.lit("multipart.file."), name), F.lit("file"), F.octet_length(file), F.lit(False))
        return F.when(file != "", of_file).otherwise(_item("multipart", F.concat(F.lit("multipart."), name), infer_type(kept), F.least(F.octet_length(kept), F.lit(4097)), F.lit(True)))

    return F.transform(parts, read)


def _leaves(value, prefix: str, out: list) -> None:
    """Leaves in the order of sorted keys; iterative, so depth is no limit.  A leaf has the name of its member, if it is one."""
    stack = [(prefix, "", value)]
    while stack:
        path, name, v = stack.pop()
        if isinstance(v, dict):
            stack.extend((f"{path}.{k}", k, v[k]) for k in sorted(v, reverse=True))
        elif isinstance(v, list):
            stack.extend((f"{path}[{i}]", "", v[i]) for i in range(len(v) - 1, -1, -1))
        elif v is None:
            out.append((path, "null", 0, name, True))
        elif isinstance(v, bool):
            out.append((path, "boolean", 4 if v else 5, name, False))
        elif isinstance(v, jsontext.Number):
            out.append((path, "integer" if abs(float(v)) < 2**63 else "number", len(v), name, False))
        elif isinstance(v, (int, float)):
            whole = abs(v) < 2**63 and v == int(v)
            out.append((path, "integer" if whole else "number", len(json.dumps(v)), name, False))
        else:
            out.append((path, "string", len(v.encode("utf-8", "replace")), name, not v.strip()))


@F.pandas_udf(LEAVES)
def json_leaves(bodies: pd.Series) -> pd.Series:
    """Leaves below ``json`` of each body, then those of GraphQL variables; null where the body is not JSON."""

    def one(body):
        if body is None:
            return None
        try:
            value = jsontext.parse(body)
        except ValueError:
            return None
        found: list = []
        _leaves(value, "json", found)
        if isinstance(value, dict) and isinstance(value.get("query"), str) and "variables" in value:
            _leaves(value["variables"], "graphql.variables", found)
        return [dict(zip(_LEAF, x, strict=True)) for x in found]

    return bodies.map(one)


@F.pandas_udf(T.StringType())
def canonical_json(bodies: pd.Series) -> pd.Series:
    """JSON with sorted keys and no layout, at any depth; null where the body is not JSON."""

    def one(body):
        try:
            return None if body is None else jsontext.write(jsontext.parse(body))
        except ValueError:
            return None

    return bodies.map(one)


def json_parameters(leaves: Column) -> Column:
    items = F.transform(leaves, lambda x: _item("json", x["path"], x["type"], x["sample_length"], x["type"] != "null"))
    return F.coalesce(items, F.array().cast(PARAMETER))


def first_of_each(parameters: Column) -> Column:
    """The first of each (source, path), by sorting: those that follow one of their own key go.  The sorted array is a lambda's
    variable, so that it is worked out once a row, not once an element."""
    keyed = F.transform(parameters, lambda p, i: F.struct(F.concat(p["source"], F.lit("\0"), p["path"]).alias("key"), i.alias("i"), p.alias("p")))
    first = F.transform(F.array(F.array_sort(keyed)), lambda s: F.filter(s, lambda x, i: (i == 0) | (F.get(s, i - 1)["key"] != x["key"])))
    return F.transform(F.array_sort(F.transform(F.get(first, F.lit(0)), lambda x: F.struct(x["i"].alias("i"), x["p"].alias("p")))), lambda x: x["p"])


def with_parameters(df: DataFrame) -> DataFrame:
    """Columns parameters, gql_name, gql_type and gql_hash for rows with the columns of ``with_url``."""
    flags = content_flags(header_value(F.col("headers"), "Content-Type"))
    kind = F.lower("body_type")
    is_json = flags["is_json"] | (kind == "json")
    df = df.withColumns({"is_json": is_json, "is_form": flags["is_urlencoded"] | (kind == "form-urlencoded"), "is_multipart": flags["is_multipart"] & (boundary() != "")})
    df = df.withColumn("leaves", json_leaves(F.when(F.col("is_json") & (F.col("body") != ""), F.col("body"))))
    empty = F.array().cast(PARAMETER)
    every = F.concat(
        F.when(F.col("u_ok"), query_parameters(F.col("u_query"))).otherwise(empty),
        F.when(F.col("u_ok"), path_parameters(F.col("u_path"), F.col("template"))).otherwise(empty),
        json_parameters(F.col("leaves")),
        F.when(F.col("is_form"), form_parameters(F.col("body"))).otherwise(empty),
        F.when(F.col("is_multipart"), multipart_parameters(F.col("body"), boundary())).otherwise(empty),
    )
    body, object_ = F.col("body"), F.col("is_json") & is_json_object(F.col("body"))
    query = F.when(object_, member(body, "query"))
    df = df.withColumn("parameters", first_of_each(every)).drop("leaves")
    return df.withColumns(
        {
            "gql_name": F.coalesce(F.when(object_, member(body, "operationName")), F.lit("")),
            "gql_type": F.when(query.isNull(), "").when(F.trim(query).startswith("mutation"), "mutation").otherwise("query"),
            "gql_hash": F.coalesce(F.sha2(query, 256), F.lit("")),
        }
    )


def schema_parameters(parameters: Column) -> Column:
    return F.array_sort(F.transform(parameters, lambda p: F.concat(p["path"], F.lit(":"), p["type"])))


def eligible(parameters: Column) -> Column:
    return F.exists(parameters, lambda p: p["eligible"])


def eligible_query(parameters: Column) -> Column:
    return F.exists(parameters, lambda p: (p["source"] == "query") & p["eligible"] & ~noise_name(p["path"]))


def application_state(p: Column) -> Column:
    return (p["source"] == "path") | has(F.lower(p["path"]), "id")


def well_formed(body: Column) -> Column:
    return ~(bad_escape(body) | has(body, ";"))
