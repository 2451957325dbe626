"""Near de-duplication by MinHash with tensored banding.

A document is its set of distinct five-word shingles (A-Z lower-cased).  Instead of ``bands * rows`` minhashes,
two small collections of ``half`` sketches are drawn, each of ``rows`` minhashes; a table key is a pair, one
sketch of either collection.  ``2 * half * rows`` minhashes so give ``half ** 2`` tables of ``2 * rows`` rows:
32 minhashes for 64 tables.  At similarity 0.85 a link is missed with a chance below 0.0001, and candidates are
verified on full shingle sets.

No step makes all pairs of a bucket:

1. Documents with equal shingle sets collapse to a class, which has a number of its own and is named by its smallest id.
2. In a bucket all members are compared with one pivot, the most central member (its sketches are shared most).
   A second round does so for what is still apart, with another pivot.
3. Members of a bucket that are still in several components go through an exact prefix-filter join: two sets
   that are similar enough share one of their rarest shingles, so passages that many documents contain never
   make candidates.

Edge cases: null or empty texts have an empty set, n_shingles 0, and link with nothing; with fewer than five
words the whole sequence is the one shingle; a very long text is one set like any other; rows that repeat an id are
reported once each, as one document: their texts may differ, each links what it resembles, and all that is linked to one
of them is one component; of equally central members the first class is the pivot; a null id is a document of its own and
reported with a null component; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, as_documents, forget, read, settle
from .components import components
from .words import _splitmix, mix, text_chunks, windows, word_hashes, word_spans

SIZE, PERCENT = 5, 85


def shingle_sets(column: pa.Array, size: int = SIZE):
    """Yield (first row, row after the last, sorted distinct shingles of all documents one after another, how many each has)."""
    for lo, hi, buf, off in text_chunks(column):
        starts, ends, counts = word_spans(buf, off)
        h = word_hashes(buf, starts, ends, lower=True)
        sh, _, per = windows(h, counts, size)
        short = np.flatnonzero((counts > 0) & (counts < size))
        begin = np.cumsum(counts) - counts
        owner = np.repeat(np.arange(len(counts)), per)
        if len(short):
            whole = np.array([int(mix(np.add.reduce(mix(h[begin[d] : begin[d] + counts[d]] + np.arange(1, counts[d] + 1, dtype=np.uint64)), keepdims=True) + np.uint64(counts[d]))[0]) for d in short], np.uint64)
            sh, owner = np.concatenate([sh, whole]), np.concatenate([owner, short])
        order = np.lexsort((sh, owner))
        sh, owner = sh[order], owner[order]
        if len(sh):
            new = np.r_[True, (sh[1:] != sh[:-1]) | (owner[1:] != owner[:-1])]
            sh, owner = sh[new], owner[new]
        yield lo, hi, sh, np.bincount(owner, minlength=hi - lo)


def _lists(values: np.ndarray, per: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(per)].astype(np.int32)), pa.array(values.view(np.int64)))


def _sketches(half: int, rows: int, size: int):
    """doc_id and text hash as they come, shingles in the set, 128 bits that stand for the set, and the 2 * half sketches."""

    def run(batches):
        mul = _splitmix(2 * half * rows, 3) | np.uint64(1)
        add = _splitmix(2 * half * rows, 4)
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, sh, per in shingle_sets(batch.column(1), size):
                full = np.flatnonzero(per > 0)
                at = (np.cumsum(per) - per)[full]
                out = np.zeros((hi - lo, 2 * half), np.uint64)
                pair = np.zeros((hi - lo, 2), np.uint64)
                if len(full):
                    for k in range(2):
                        pair[full, k] = np.add.reduceat(mix(sh ^ np.uint64(0x5851F42D4C957F2D * (k + 1) % 2**64)), at)
                    for b in range(2 * half):
                        acc = np.full(len(full), b + 1, np.uint64)
                        for r in range(rows):
                            k = b * rows + r
                            acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) ^ np.minimum.reduceat(mix_light(sh, mul[k], add[k]), at))
                        out[full, b] = acc
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(per.astype(np.int64)), pa.array(pair[:, 0].view(np.int64)), pa.array(pair[:, 1].view(np.int64)), _lists(out.reshape(-1), np.full(hi - lo, 2 * half))],
                    ["doc_id", "t", "n", "s1", "s2", "sk"],
                )

    return run


def mix_light(x: np.ndarray, mul: np.uint64, add: np.uint64) -> np.ndarray:
    """A cheap seeded permutation of 64-bit values."""
    y = (x + add) * mul
    y ^= y >> np.uint64(32)
    y *= mul
    return y


def _sets(size: int):
    def run(batches):
        for batch in batches:
            for lo, hi, sh, per in shingle_sets(batch.column(1), size):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), _lists(sh, per)], ["cid", "shingles"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``pairs`` (a, b) with ``link``: whether their full sets are similar enough."""
    left = sets.select(F.col("cid").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("cid").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "sa", "sb", both.alias("i")).select(
        "a", "b", (100 * F.col("i") >= percent * (F.size("sa") + F.size("sb") - F.col("i"))).alias("link")
    )


def _near_sizes(a: str, b: str, percent: int) -> F.Column:
    """No two sets whose sizes differ more can be similar enough."""
    return (100 * F.least(a, b) >= percent * F.greatest(a, b))


def near_dedup(docs: DataFrame, percent: int = PERCENT, size: int = SIZE, half: int = 8, rows: int = 2) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept (the smallest id of its component)."""
    docs = as_documents(docs, {"doc_id": "long", "text": "string"}).withColumn("t", F.xxhash64("text"))
    base = settle(docs.mapInArrow(_sketches(half, rows, size), "doc_id long, t long, n long, s1 long, s2 long, sk array<long>"), "sketches")
    real = base.where("n > 0 AND doc_id IS NOT NULL")
    # a class stands for equal sets; its number is written with it, and (rep, t) names one row with its text
    one = F.min(F.struct("doc_id", "t")).alias("one")
    classes = real.groupBy("n", "s1", "s2").agg(one, F.min("sk").alias("sk")).select(F.monotonically_increasing_id().alias("cid"), "n", "s1", "s2", F.col("one.doc_id").alias("rep"), F.col("one.t").alias("t"), "sk")
    classes = settle(classes, "classes")
    member = settle(base.join(classes.select("n", "s1", "s2", "cid", "rep"), ["n", "s1", "s2"], "left").select("doc_id", "n", "cid", "rep"), "member")

    # sketches that no other class shares can be part of no link
    marks = F.posexplode("sk").alias("i", "v")
    cells = settle(classes.select("cid", "n", marks), "cells")
    often = cells.groupBy("i", "v").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    shared = cells.join(often, ["i", "v"])
    halves = settle(
        shared.groupBy("cid", "n").agg(F.sum(F.log2("times")).alias("central"), F.collect_list(F.when(F.col("i") < half, F.struct("i", "v"))).alias("left"), F.collect_list(F.when(F.col("i") >= half, F.struct("i", "v"))).alias("right")).where("size(left) > 0 AND size(right) > 0"),
        "halves",
    )
    keys = halves.select("cid", "n", "central", F.explode("left").alias("l"), "right").select("cid", "n", "central", "l", F.explode("right").alias("r"))
    keys = keys.select("cid", "n", "central", F.xxhash64("l.i", "l.v", "r.i", "r.v").alias("key"))
    crowd = keys.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    buckets = settle(keys.join(crowd, "key").drop("m"), "buckets")

    here = settle(classes.join(buckets.select("cid").distinct(), "cid", "left_semi").select("cid", F.col("rep").alias("doc_id"), "t"), "here")
    few = here.count() * 40 <= BROADCAST_BYTES
    found = docs.where("doc_id IS NOT NULL").join(F.broadcast(here) if few else here, ["doc_id", "t"]).select("cid", "text").dropDuplicates(["cid"])
    sets = settle(found.mapInArrow(_sets(size), "cid long, shingles array<long>"), "sets")

    forget(cells, halves, here)
    links, asked, labels, used = None, None, None, [base, buckets, sets]
    for _ in range(2):
        left = _open(buckets, labels)
        used += [left, labels]
        rank = F.struct("central", -F.col("cid"))
        if asked is not None:
            left = left.join(asked.select(F.col("b").alias("cid")).distinct().withColumn("old", F.lit(True)), "cid", "left")
            rank = F.struct(F.col("old").isNull().alias("fresh"), "central", -F.col("cid"))
        pivots = left.groupBy("key").agg(F.max_by(F.struct(F.col("cid").alias("p"), F.col("n").alias("pn"), F.col("component").alias("pc")), rank).alias("pivot")).select("key", "pivot.*")
        pairs = left.join(pivots, "key").where((F.col("component") != F.col("pc")) & _near_sizes("n", "pn", percent)).select(F.col("cid").alias("a"), F.col("p").alias("b")).distinct()
        if asked is not None:
            pairs = pairs.join(_both_ways(asked), ["a", "b"], "left_anti")
        new = settle(_verified(pairs, sets, percent), "verified")
        used.append(new)
        asked = new if asked is None else asked.union(new)
        links = asked.where("link")
        labels = components(links)
    left = _open(buckets, labels)
    used += [left, labels]
    rest = settle(left.where("NOT settled").select("cid", "n", "component").distinct(), "rest")
    pairs = _prefix_pairs(rest, sets, percent, used).join(_both_ways(asked), ["a", "b"], "left_anti")
    more = settle(_verified(pairs, sets, percent), "verified")
    used += [rest, more]
    more = more.where("link")
    # an id that comes with several texts joins their classes
    ids = member.where("doc_id IS NOT NULL AND cid IS NOT NULL")
    several = ids.groupBy("doc_id").agg(F.min("cid").alias("b"), F.max("cid").alias("z")).where("b < z").select("doc_id", "b")
    same = ids.join(several, "doc_id").where("cid <> b").select(F.col("cid").alias("a"), "b").distinct()
    labels = components(links.union(more).select("a", "b").union(same))

    lowest = labels.join(classes.select(F.col("cid").alias("id"), "rep"), "id").groupBy("component").agg(F.min("rep").alias("component_id"))
    names = settle(labels.join(lowest, "component").select(F.col("id").alias("cid"), "component_id"), "names")
    forget(*used, classes, labels)
    out = member.join(names, "cid", "left")
    comp = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component_id", "rep")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), comp.alias("component_id"), comp.eqNullSafe(F.col("doc_id")).alias("kept"))


def _both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _open(buckets: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Buckets with the component of each member; once there are labels, only buckets that several components share."""
    if labels is None:
        return buckets.withColumn("component", F.col("cid"))
    named = buckets.join(labels.withColumnRenamed("id", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    apart = named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("m")).where("low <> high")
    # two members that are apart have been compared with each other, as one was the pivot
    return settle(named.join(apart.select("key", (F.col("m") == 2).alias("settled")), "key"), "open")


def _prefix_pairs(rest: DataFrame, sets: DataFrame, percent: int, used: list) -> DataFrame:
    """Pairs of different components whose sizes fit and that share one of their rarest shingles.

    With shingles in one order of rising frequency, a set of n needs overlap of at least ceil(n * percent / 100) with any
    similar one, so both share a shingle among the first n - ceil(n * percent / 100) + 1.
    """
    held = sets.join(rest, "cid").select("cid", "n", "component", F.explode("shingles").alias("s"))
    held = settle(held, "held")
    often = held.groupBy("s").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    # a shingle of one document pairs with nothing, but takes a place of the prefix
    ranked = held.join(often, "s", "left").withColumn("f", F.coalesce("f", F.lit(1))).withColumn("at", F.row_number().over(W.partitionBy("cid").orderBy("f", "s")))
    prefix = ranked.where((F.col("at") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1) & (F.col("f") > 1))
    prefix = settle(prefix.select("s", "cid", "n", "component", "at"), "prefix")
    used += [held, prefix]
    x = prefix.select("s", F.col("cid").alias("a"), F.col("n").alias("na"), F.col("component").alias("ca"), F.col("at").alias("pa"))
    y = prefix.select("s", F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("component").alias("cb"), F.col("at").alias("pb"))
    # at the first shingle that two similar sets share, enough is left behind it in both
    need = F.col("na") + F.col("nb")
    enough = ((100 + percent) * (F.col("na") - F.col("pa") + 1) >= percent * need) & ((100 + percent) * (F.col("nb") - F.col("pb") + 1) >= percent * need)
    return x.join(y, "s").where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & _near_sizes("na", "nb", percent) & enough).select("a", "b").distinct()


def op3_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_dedup(read(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS sh FROM t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
rare AS (SELECT sh FROM s GROUP BY sh HAVING count(*) > 1),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN rare USING (sh) JOIN s b USING (sh) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS low FROM documents UNION SELECT e.b, r.low FROM r JOIN e ON e.a = r.doc_id WHERE r.low < e.b),
c AS (SELECT doc_id, min(low) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""
