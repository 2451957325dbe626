"""File sources and sinks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_PAIR = "array<struct<name:string,value:string>>"
SESSION = f"id string, created_at timestamp, cookies array<struct<name:string,value:string,domain:string,path:string,expires:double,httpOnly:boolean,secure:boolean,sameSite:string>>, origins array<struct<origin:string,localStorage:{_PAIR},sessionStorage:{_PAIR}>>"
DISCOVERY = "timestamp string, request struct<method:string,endpoint:string,url:string,tag:string,attribute:string,source:string,raw:string>, response struct<status_code:int,body:string,content_length:bigint>"
RESULTS = "id string, crawl_id string, task_id string, page_url string, auth_session_id string, method string, url string, headers map<string,string>, body string, body_type string, source_type string, resource_type string, lifecycle_state string, response struct<status_code:int,content_type:string,content_length:bigint>"


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of captured requests."""
    return spark.read.schema(RESULTS).option("multiLine", True).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str = DISCOVERY) -> DataFrame:
    """JSON lines; bytes that are no UTF-8 are replaced, and lines that are not JSON are left out."""
    text = F.make_valid_utf8(F.col("value"))
    read = F.from_json(text, f"{schema}, not_json string", {"columnNameOfCorruptRecord": "not_json"})
    rows = spark.read.text(path).where("trim(value) <> ''").select(read.alias("r")).where("r.not_json IS NULL")
    return rows.select("r.*").drop("not_json")


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SESSION).option("multiLine", True).json(path)


def read_urls(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where("trim(value) <> ''").select(F.trim("value").alias("url"))


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Raw HTTP requests, one a file: method, uri, host and body."""
    v = F.col("value")
    head = F.regexp_extract(v, r"(?s)^(.*?)\r?\n\r?\n", 1)
    return spark.read.text(path, wholetext=True).select(
        F.regexp_extract(v, r"^(\S+) (\S+)", 1).alias("method"), F.regexp_extract(v, r"^(\S+) (\S+)", 2).alias("uri"), F.regexp_extract(head, r"(?im)^Host:[ \t]*(\S+)", 1).alias("host"), F.regexp_replace(v, r"(?s)^.*?\r?\n\r?\n", "").alias("body")
    )


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Every file below ``path`` with size, time, hash and the tool that its path names."""
    p = F.lower("path")
    tool = F.coalesce(*(F.when(F.contains(p, F.lit(f"/{t}/")), t) for t in ("browser", "crawler", "scanner")), F.lit("other"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    code = F.regexp_extract(F.when(F.col("length") < 1 << 20, F.col("content").cast("string")), r"(?i)exit[_ ]code[=: ]+([0-9]+)", 1)
    state = F.when(F.contains(p, F.lit("/normalized/")) | F.contains(p, F.lit("session")), "redacted").otherwise("not_required")
    return files.select("path", "length", "modificationTime", F.sha2("content", 256).alias("sha256"), tool.alias("tool"), F.when(code != "", code.cast("int")).alias("exit_code"), state.alias("redaction_status"))


def write_jsonl(df: DataFrame, path: str) -> None:
    """Compact JSON lines with members in order of name."""
    df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value")).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV parts with a header each."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_lines(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def write_document(items: DataFrame, head: str, tail: str, path: str) -> None:
    """One JSON document from ``items`` (n from 1 on, text), in order of n.  A document is one file, so one task writes it, a
    line at a time: nothing is collected."""
    rows = items.select("n", F.concat(F.when(F.col("n") > 1, ",").otherwise(""), F.col("text")).alias("value"))
    ends = items.sparkSession.range(2).select(F.when(F.col("id") == 0, F.lit(0)).otherwise(F.lit(1 << 62)).cast("long").alias("n"), F.when(F.col("id") == 0, head).otherwise(tail).alias("value"))
    rows.select(F.col("n").cast("long"), "value").union(ends).orderBy("n").select("value").coalesce(1).write.mode("overwrite").text(path)


def spread(df: DataFrame, small_split: int = 4 << 20) -> DataFrame:
    """``df``, or where the input is small, and so may be a single split, its rows dealt out to all cores: what follows is long
    work on each row.  An input of more than ``small_split`` bytes a core is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * small_split else df


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder that driver and executors share, below ``spark.checkpoint.dir``; a temporary one in local mode."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="siftline-")
    return f"{at.rstrip('/')}/siftline-{spark.sparkContext.applicationId}/{uuid.uuid4().hex[:12]}"


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """``df`` with ``name``, 1, 2, 3 and so on in ``order``: rows are dealt out by ranges and written, then each range adds the
    sizes of those before it.  Only those sizes, one row a range, are ever in one task."""
    spark, path = df.sparkSession, f"{shared_folder(df.sparkSession)}/numbered"
    ranged = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()
    ranged.withColumns({"_range": F.spark_partition_id(), "_place": place.bitwiseAND((1 << 33) - 1)}).write.parquet(path)
    held = spark.read.parquet(path)
    sizes = held.groupBy("_range").agg((F.max("_place") + 1).alias("n"))
    before = sizes.select("_range", (F.sum("n").over(W.orderBy("_range")) - F.col("n")).alias("_before"))
    return held.join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + F.col("_place") + 1).drop("_range", "_place", "_before")


def read_env(lines: list[str], present: dict[str, str]) -> dict[str, str]:
    """KEY=VALUE settings; those that are set already win."""
    out = {}
    for line in map(str.strip, lines):
        key, eq, value = line.partition("=")
        if eq and not line.startswith("#"):
            out[key.strip()] = value.strip().strip("\"'")
    return out | {k: v for k, v in present.items() if k in out}
