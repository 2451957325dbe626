"""Analysis of requests and the endpoint inventory.

A table that holds requests saved more than once, as their lifecycle advances, goes through ``latest`` after ``analyze``;
``inventory`` then is one aggregate keyed by the request's shape over rows with distinct ids.  It has one distinct count and
so no Expand: a partial aggregate by (key, body), an exchange, and the aggregate by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import params as P
from ..functions.urls import with_url


def _escaped(text: Column) -> Column:
    """JSON text as hash input has <, > and & escaped."""
    for a, b in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def schema_hash() -> Column:
    shape = F.struct(
        F.col("auth"), F.col("content").alias("content_type"), F.col("gql_name").alias("graphql_operation"), F.col("gql_type").alias("graphql_type"),
        F.upper("method").alias("method"), P.schema_parameters(F.col("parameters")).alias("parameters"), F.col("template"),
    )
    return F.sha2(_escaped(F.to_json(shape)), 256)


def _identity() -> Column:
    return F.concat_ws("\0", "origin", F.upper("method"), "template", "auth", "gql_type", "gql_name", "gql_hash")


def endpoint_identity() -> Column:
    return F.sha2(_identity(), 256)


def analyze(observations: DataFrame) -> DataFrame:
    """Observations with class, template, parameters, replayability, eligibility and keys."""
    df = P.with_parameters(with_url(observations)).withColumns({"auth": C.auth_context(), "content": C.content_of(), "blocked": C.blocked()})
    df = df.withColumn("classification", F.when(F.col("blocked"), "UNKNOWN").otherwise(C.classify()))
    df = df.withColumn("parameters", F.when(F.col("blocked"), F.array().cast(P.PARAMETER)).otherwise(F.col("parameters")))
    df = df.withColumn("reasons", F.when(F.col("blocked"), F.array(F.lit("blocked_by_policy"))).otherwise(C.replay_reasons(F.size("parameters"))))
    df = df.withColumn("replayability", F.when(F.col("blocked"), "NOT_REPLAYABLE").otherwise(C.replayability(F.col("reasons"), F.col("auth"))))
    candidate = F.col("classification").isin(C.CANDIDATE_CLASSES) & F.col("replayability").startswith("REPLAYABLE") & P.eligible(F.col("parameters"))
    by_query = F.col("classification").isin(C.QUERY_CLASSES) & (F.upper("method") == "GET") & P.eligible_query(F.col("parameters"))
    df = df.withColumns({"request_eligible": candidate, "query_eligible": by_query})
    why = F.array_join("reasons", ",")
    df = df.withColumns(
        {
            "request_reason": F.when(F.col("request_eligible"), "").when(why != "", why).otherwise("no_meaningful_controllable_parameter"),
            "query_reason": F.when(F.col("query_eligible"), "").when(why != "", why).otherwise("not_parameterized_get"),
            "schema_hash": schema_hash(),
            "identity": endpoint_identity(),
            "body_hash": F.sha2("body", 256),
        }
    )
    df = df.withColumn("inventory_id", F.sha2(F.concat_ws("\0", _identity(), "schema_hash"), 256))
    return df if "statuses" in df.columns else df.withColumn("statuses", F.filter(F.array("response.status_code"), lambda x: x.isNotNull()))


def guard(observations: DataFrame) -> DataFrame:
    """id, classification, replayability, reason and parameter count of rows that no rule looks at: no request, or blocked."""
    why = F.when(C.missing(), "nil_request").when(C.blocked(), "blocked_by_policy")
    rows = observations.withColumn("reason", why).where("reason IS NOT NULL")
    return rows.select("id", F.lit("UNKNOWN").alias("classification"), F.lit("NOT_REPLAYABLE").alias("replayability"), "reason", F.lit(0).alias("parameters"))


def _enters() -> Column:
    seen = (F.col("source_type") == "cdp") | F.col("source_type").startswith("cdp_")
    return seen & ~F.col("blocked") & (F.col("lifecycle_state") != "policy_enforcement_failed")


def captured(analyzed: DataFrame) -> DataFrame:
    """Rows that enter the inventory: seen in the browser, and not stopped by policy."""
    return analyzed.where(_enters())


def best_first() -> Column:
    """Order in which the smallest is the best example: quality, then the earliest, then the smallest id."""
    return F.struct(*((-q).alias(f"q{i}") for i, q in enumerate(C.quality())), F.col("request_timestamp").alias("t"), F.col("id").alias("id"))


def affected(analyzed: DataFrame, changed: Column) -> DataFrame:
    """The inventory's rows of groups that hold a ``changed`` request."""
    return inventory(analyzed, any_changed=changed).where("any_changed").drop("any_changed")


def inventory(analyzed: DataFrame, any_changed: Column | None = None, **payload: Column) -> DataFrame:
    """One row for each shape of request, from rows with distinct ids.

    Class, template and content type are those of the first request; parameters, eligibility and reasons of the last; a
    replayability gives way only to a REPLAYABLE one.  ``payload`` names further columns of the representative request, which
    come along in a struct ``representative``: no second look at the requests is needed.  ``any_changed`` is a condition;
    the column of that name says whether a request of the group meets it.
    """
    newest = F.struct("created_at", "id")
    good = F.max_by("replayability", F.when(F.col("replayability").startswith("REPLAYABLE"), newest))
    paths = P.schema_parameters(F.col("parameters")).alias("paths")
    grouped = captured(analyzed).groupBy("inventory_id").agg(
        F.first(F.upper("method")).alias("method"), F.first("template").alias("endpoint_template"), F.first("origin").alias("origin"), F.first("identity").alias("endpoint_identity"),
        F.first("auth").alias("authentication_context"), F.first("content").alias("content_type"), F.first("schema_hash").alias("request_schema_hash"),
        F.min_by(F.struct("id", "classification", "replayability"), newest).alias("first"), F.max_by(F.struct("request_eligible", "query_eligible", "reasons", paths), newest).alias("last"), good.alias("good"),
        F.min_by(F.struct("id", *(c.alias(n) for n, c in payload.items())), best_first()).alias("representative"),
        F.count(F.lit(1)).alias("observation_count"), F.count_distinct("body_hash").alias("distinct_body_count"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("statuses")))).alias("codes"),
        F.min("created_at").alias("created_at"), F.max("created_at").alias("updated_at"), F.bool_or(F.lit(True) if any_changed is None else any_changed).alias("any_changed"),
    )
    return grouped.select(
        "inventory_id", "method", "endpoint_template", "origin", "endpoint_identity", F.col("first.classification").alias("classification"), "authentication_context", "content_type", "request_schema_hash",
        F.col("first.id").alias("first_request_id"), F.col("representative.id").alias("representative_request_id"), "observation_count", "distinct_body_count", F.to_json("codes").alias("status_codes"),
        F.to_json("last.paths").alias("parameter_paths"), F.coalesce("good", "first.replayability").alias("replayability"), F.col("last.request_eligible").alias("request_eligible"),
        F.col("last.query_eligible").alias("query_eligible"), F.to_json("last.reasons").alias("exclusion_reasons"), "created_at", "updated_at", *(["representative"] if payload else []), *(["any_changed"] if any_changed is not None else []),
    )


def _newest() -> Column:
    """Order of a request's saves: one that policy stopped comes last."""
    return F.struct(F.col("lifecycle_state").isin("blocked_by_policy", "policy_enforcement_failed").alias("s"), F.col("created_at"))


def emptied(analyzed: DataFrame) -> DataFrame:
    """Keys of groups that a save of a request was in, and that no request's newest row is in: what an upkeep deletes."""
    per = analyzed.groupBy("id").agg(F.max_by(F.when(_enters(), F.col("inventory_id")).otherwise(""), _newest()).alias("now"), F.collect_set(F.when(_enters(), F.col("inventory_id"))).alias("seen"))
    groups = per.select("now", F.explode("seen").alias("inventory_id")).groupBy("inventory_id").agg(F.bool_or(F.col("now") == F.col("inventory_id")).alias("alive"))
    return groups.where("NOT alive").select("inventory_id")


def latest(analyzed: DataFrame) -> DataFrame:
    """The newest row of each request id, with the status codes of all its rows of the same shape; a request that policy
    stopped stays stopped, whatever comes later."""
    every = [c for c in analyzed.columns if c not in ("id", "statuses")]
    picked = analyzed.groupBy("id").agg(F.max_by(F.struct(*every), _newest()).alias("row"), F.collect_set(F.struct("inventory_id", "statuses")).alias("seen"))
    mine = F.filter("seen", lambda x: x["inventory_id"] == F.col("row.inventory_id"))
    return picked.select("id", "row.*", F.array_sort(F.array_distinct(F.flatten(F.transform(mine, lambda x: x["statuses"])))).alias("statuses"))


def request_parameters(analyzed: DataFrame) -> DataFrame:
    """One row a parameter.  The outer form keeps the optimizer from working the array out again to test its size."""
    rows = analyzed.select("id", "inventory_id", "task_id", F.posexplode_outer("parameters").alias("ord", "x"))
    return rows.where("ord IS NOT NULL").select("id", "inventory_id", "task_id", "ord", "x.*")


def scanner_candidates(analyzed: DataFrame) -> DataFrame:
    """Two rows for each indexed request: by whole request, and by query."""
    two = F.array(
        F.struct(F.lit("REQUEST").alias("kind"), F.col("request_eligible").alias("eligible"), F.col("request_reason").alias("reason")),
        F.struct(F.lit("QUERY").alias("kind"), F.col("query_eligible").alias("eligible"), F.col("query_reason").alias("reason")),
    )
    return captured(analyzed).select("id", "inventory_id", "replayability", F.explode(two).alias("c")).select("id", "inventory_id", "replayability", "c.*")
