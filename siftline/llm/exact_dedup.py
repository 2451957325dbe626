"""Exact de-duplication by counting quotient filters.

Texts are equal when identical after deleting space, tab, line feed, vertical tab, form feed and carriage
return.  Each partition builds counting quotient filters of its documents' fingerprints (the first 64 bits of
the SHA-256 of the normalised text), one a fingerprint range.  Filters of one range meet in a task and merge
by their sorted remainders, which loses nothing.  Fingerprints counted more than once route their documents to
verification, where texts are grouped by their normalised bytes, not by any hash.  What is settled on the way goes to a
file a core, or one a ``block_rows`` rows if those are more, and not to one a shuffle partition: each file has its cost.

Edge cases: a null text counts as empty, and empty texts are equal to each other; a null id is never preferred
while another is there; a very long text is compared whole; texts of equal length tie, and the smallest id stays; rows
that repeat an id are rows of their own and all count in ``group_size``; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, as_documents, forget, parts, read, semi, settle
from .quotient import CountingQuotientFilter


def normalised(text: F.Column) -> F.Column:
    return F.translate(F.coalesce(text, F.lit("")), SPACE, "")


def _filters(blocks: int):
    """One filter a fingerprint range of what a partition holds (8 bytes a document)."""

    def run(batches):
        held = [b.column(0).to_numpy(zero_copy_only=False).view(np.uint64) for b in batches]
        fps = np.concatenate(held) if held else np.zeros(0, np.uint64)
        block = ((fps >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        fps, block = fps[order], block[order]
        cuts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(fps) else []
        for a, b in zip(cuts, [*cuts[1:], len(fps)], strict=False):
            data = CountingQuotientFilter.of(fps[a:b]).to_bytes()
            yield pa.RecordBatch.from_arrays([pa.array([int(block[a])], pa.int64()), pa.array([data], pa.binary())], ["block", "filter"])

    return run


def _merged(key, table):
    """Fingerprints of one range that were counted more than once."""
    one = CountingQuotientFilter.merge([CountingQuotientFilter.from_bytes(x.as_py()) for x in table.column("filter")])
    fps, counts = one.items()
    return pa.table({"fp": pa.array(fps[counts > 1].view(np.int64), pa.int64())})


def _few(df: DataFrame, rows: int, block_rows: int) -> DataFrame:
    """``df``, of at most ``rows`` short rows, dealt out evenly to as many files as it needs."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // block_rows)))


def repeated_fingerprints(prints: DataFrame, block_rows: int = 1 << 20) -> DataFrame:
    """``fp`` values that occur more than once in the long column ``fp``, each once.  ``block_rows``: documents that one merge
    task covers; the number of ranges follows the table."""
    rows = prints.count()
    blocks = max(parts(prints.sparkSession), -(-rows // block_rows))
    filters = prints.select("fp").mapInArrow(_filters(blocks), "block long, filter binary")
    return _few(filters.groupBy("block").applyInArrow(_merged, "fp long"), rows, block_rows)


def exact_dedup(docs: DataFrame, block_rows: int = 1 << 20) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, keep_id (of equal texts the one with most code points, then
    smallest id), group_size, kept (doc_id is keep_id), text_sha256 (of the normalised text)."""
    docs = as_documents(docs, {"doc_id": "long", "text": "string"})
    sha = F.sha2(normalised(F.col("text")).cast("binary"), 256)
    base = settle(
        docs.select("doc_id", sha.alias("sha")).select("doc_id", "sha", F.conv(F.substring("sha", 1, 16), 16, -10).cast("long").alias("fp")),
        "prints",
    )
    twice = settle(repeated_fingerprints(base, block_rows), "twice")
    # texts are read again, but only those of repeated fingerprints move
    again = docs.select("doc_id", normalised(F.col("text")).alias("norm"), F.char_length(F.coalesce("text", F.lit(""))).alias("n")).withColumn("sha", F.sha2(F.col("norm").cast("binary"), 256))
    n_twice = twice.count()
    again = semi(again.withColumn("fp", F.conv(F.substring("sha", 1, 16), 16, -10).cast("long")), twice, "fp", n_twice)
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("none"), "doc_id"))
    groups = (
        again.groupBy("norm")
        .agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"), F.first("sha").alias("sha"))
        .where("group_size > 1")
        .select("sha", "group_size", F.col("best.doc_id").alias("keep_id"))
    )
    groups = settle(_few(groups.withColumn("found", F.lit(True)), n_twice, block_rows), "groups")
    forget(twice)
    out = base.join(groups, "sha", "left")
    keep = F.when(F.col("found"), F.col("keep_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), keep.eqNullSafe(F.col("doc_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


SQL = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT doc_id, norm, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size
      FROM t WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id))
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""
