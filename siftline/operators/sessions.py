"""Tokens in session state.  Values never leave: counts and hashes only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def looks_like_jwt(value: Column) -> Column:
    v = F.regexp_replace(F.trim(value), "^Bearer ", "")
    return (F.length(v) - F.length(F.replace(v, F.lit("."))) == 2) & v.startswith("eyJ")


def token_kind(source: Column, name: Column, value: Column) -> Column:
    """csrf, jwt, token or null; only storage, not cookies, can hold a plain token."""
    n = F.lower(name)
    kind = F.when(F.contains(n, F.lit("csrf")) | F.contains(n, F.lit("xsrf")), "csrf").when(looks_like_jwt(value), "jwt")
    return kind.when((source != "cookie") & (F.contains(n, F.lit("token")) | (n == "authorization")), "token")


def flatten_state(state: DataFrame) -> DataFrame:
    """source, name, value of every cookie and storage entry of session states (see ``sources.files.SESSION``)."""
    cookies = state.select(F.explode("cookies").alias("c")).select(F.lit("cookie").alias("source"), "c.name", "c.value")
    origin = state.select(F.explode("origins").alias("o"))
    stored = [origin.select(F.explode(f"o.{kind}").alias("s")).select(F.lit(kind).alias("source"), "s.name", "s.value") for kind in ("localStorage", "sessionStorage")]
    return cookies.union(stored[0]).union(stored[1])


def tokens(rows: DataFrame) -> DataFrame:
    """source, name, kind and a hash of each distinct token."""
    rows = rows.withColumn("kind", token_kind(F.col("source"), F.col("name"), F.col("value"))).where("kind IS NOT NULL")
    return rows.select("source", "name", "kind", F.sha2("value", 256).alias("value_hash")).distinct()


def token_counts(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("kind", token_kind(F.col("source"), F.col("name"), F.col("value"))).where("kind IS NOT NULL")
    return rows.groupBy("source", "kind").agg(F.count(F.lit(1)).alias("tokens"), F.count_distinct(F.sha2("value", 256)).alias("distinct_values"))


def merged(existing: Column, discovered: Column) -> Column:
    """Tokens (source, name, value_hash) of two lists, each once, by source and name."""
    return F.array_sort(F.array_distinct(F.concat(existing, discovered)))


def append_unique(items: Column, item: Column) -> Column:
    """``items`` with ``item`` at the end, unless it is there."""
    return F.when(F.array_contains(items, item), items).otherwise(F.array_append(items, item))
