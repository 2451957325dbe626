"""Document quality by the perplexity of an interpolated modified Kneser-Ney model.

The model is a bigram model over the pieces of a public vocabulary, counted over all trusted text (documents that the
labels table calls good and not toxic; a fifth of them is left out to set thresholds).

    P(w | v) = max(c(vw) - D(c(vw)), 0) / c(v) + g(v) * P1(w)
    P1(w)    = max(N1+(.w) - D'(N1+(.w)), 0) / N1+(..) + g' / V

Bigram counts stay in a table dealt by context.  Documents are scored in blocks: a block's distinct bigrams are joined
with the counts, and the answers come back to the block's token ids, which travel compressed.  What depends on one piece
only (g and P1) has a row a piece of the vocabulary, so it is broadcast.  A document passes if its perplexity is at most
a quantile of the left-out trusted documents of its language.

Edge cases: null and empty texts have no tokens, no perplexity, and do not pass; a very long text is scored whole, in one
block; a perplexity that ties with the threshold passes; a null lang is a language of its own;
a language without left-out trusted documents takes the quantile of all of them; without trusted text nothing is judged
and all documents with words pass; rows that repeat an id are scored one by one; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, as_documents, forget, semi, settle
from .packing import vocabulary_path, worker_encoder
from .words import text_chunks

BLOCK = 4 << 20
QUANTILE = 0.995
_HALF = np.uint64(32)


def _blocks(batches, path: str, limit: int, column: int):
    """Yield (doc_id and lang of the documents, token ids, tokens per document) for runs of about ``limit`` tokens."""
    enc = worker_encoder(path)
    rows: list = []
    ids: list = []
    counts: list = []
    size = 0
    for batch in batches:
        for lo, hi, buf, off in text_chunks(batch.column(column)):
            got, n = enc.encode(buf, off)
            rows.append(batch.select([0, 2]).slice(lo, hi - lo))  # not the text
            ids.append(got.astype(np.uint16) if path_fits(got) else got)
            counts.append(n)
            size += len(got)
            if size >= limit:
                yield rows, np.concatenate(ids), np.concatenate(counts)
                rows, ids, counts, size = [], [], [], 0
    if rows:
        yield rows, np.concatenate(ids), np.concatenate(counts)


def path_fits(ids: np.ndarray) -> bool:
    return not len(ids) or int(ids.max()) < 1 << 16


def _bigrams(ids: np.ndarray, counts: np.ndarray, start: int) -> np.ndarray:
    """Context and piece of every token in one number; the first token of a document follows ``start``."""
    prev = np.empty(len(ids), np.uint64)
    if len(ids):
        prev[1:] = ids[:-1]
        first = np.cumsum(counts) - counts
        prev[first[counts > 0]] = start
    return prev << _HALF | ids.astype(np.uint64)


def _counted(path: str, start: int):
    def run(batches):
        for _, ids, counts in _blocks(batches, path, BLOCK, 1):
            key, n = np.unique(_bigrams(ids, counts, start), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array((key >> _HALF).astype(np.int32)), pa.array((key & np.uint64(0xFFFFFFFF)).astype(np.int32)), pa.array(n)], ["v", "w", "c"])

    return run


def _block_name(rows: list, ids: np.ndarray, counts: np.ndarray) -> int:
    """A block is named by what is in it: two runs that cut the input differently have no name in common, and so can never
    take each other's answers."""
    h = hashlib.blake2b(np.ascontiguousarray(ids), digest_size=8)
    h.update(np.ascontiguousarray(counts))
    h.update(str(rows[0].column(0)[0].as_py()).encode())
    return int.from_bytes(h.digest(), "little", signed=True)


def _asked(path: str, start: int):
    def run(batches):
        for rows, ids, counts in _blocks(batches, path, BLOCK, 1):
            key = np.unique(_bigrams(ids, counts, start))
            block = pa.array(np.full(len(key), _block_name(rows, ids, counts)))
            yield pa.RecordBatch.from_arrays([block, pa.array((key >> _HALF).astype(np.int32)), pa.array((key & np.uint64(0xFFFFFFFF)).astype(np.int32))], ["block", "v", "w"])

    return run


def _packed(path: str):
    def run(batches):
        import zstandard

        for rows, ids, counts in _blocks(batches, path, BLOCK, 1):
            table = pa.Table.from_batches(rows).combine_chunks()
            blob = zstandard.ZstdCompressor(level=9).compress(ids.astype("<u4" if ids.dtype != np.uint16 else "<u2").tobytes())
            one = lambda c: pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c)
            yield pa.RecordBatch.from_arrays(
                [pa.array([_block_name(rows, ids, counts)]), one(table.column(0).combine_chunks()), one(table.column(1).combine_chunks()), one(pa.array(counts.astype(np.int32))), pa.array([ids.dtype.itemsize], pa.int32()), pa.array([blob], pa.binary())],
                ["block", "doc_id", "lang", "n", "width", "ids"],
            )

    return run


def _scored(tables, start: int):
    """Sum of log probabilities of each document of a block, from the answers for its bigrams."""

    def run(batches):
        import zstandard

        backoff, unigram = tables.value
        for batch in batches:
            cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for r in range(batch.num_rows):
                n = cols["n"][r].values.to_numpy().astype(np.int64)
                width = cols["width"][r].as_py()
                ids = np.frombuffer(zstandard.ZstdDecompressor().decompress(cols["ids"][r].as_py()), "<u2" if width == 2 else "<u4")
                key = _bigrams(ids, n, start)
                total = np.zeros(len(n))
                if len(ids):
                    if not cols["answers"][r].is_valid:
                        raise ValueError("a block has no answers: the input must give the same rows in every run")
                    answers = cols["answers"][r].values
                    known = answers.field("v").to_numpy().astype(np.uint64) << _HALF | answers.field("w").to_numpy().astype(np.uint64)
                    seen = answers.field("p").to_numpy()
                    order = np.argsort(known)
                    known, seen = known[order], seen[order]
                    at = np.minimum(np.searchsorted(known, key), len(known) - 1)
                    if not (known[at] == key).all():
                        raise ValueError("answers do not fit their block: the input must give the same rows in every run")
                    p = seen[at] + backoff[(key >> _HALF).astype(np.int64)] * unigram[ids.astype(np.int64)]
                    total = np.bincount(np.repeat(np.arange(len(n)), n), np.log(p), minlength=len(n))
                yield pa.RecordBatch.from_arrays([cols["doc_id"][r].values, cols["lang"][r].values, pa.array(n), pa.array(total)], ["doc_id", "lang", "n_tokens", "log_p"])

    return run


def discounts(c: F.Column) -> list[F.Column]:
    """How many entries have count 1, 2, 3 and 4: what the three discounts are estimated from."""
    return [F.sum((c == k).cast("long")).alias(f"n{k}") for k in (1, 2, 3, 4)]


def three(row) -> tuple[float, float, float]:
    n = [float(row[f"n{k}"] or 0) for k in (1, 2, 3, 4)]
    if not n[0] or not n[1]:
        return 0.5, 0.75, 0.9
    y = n[0] / (n[0] + 2 * n[1])
    out = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0.9 * k for k in (1, 2, 3)]
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in zip((1, 2, 3), out, strict=True))


def discounted(c: F.Column, d: tuple[float, float, float]) -> F.Column:
    return F.greatest(c - F.when(c == 1, d[0]).when(c == 2, d[1]).otherwise(d[2]), F.lit(0.0))


class KneserNey:
    """``table`` has v, w and p, the first term of P(w | v); ``backoff`` and ``unigram`` are arrays by piece."""

    def __init__(self, counts: DataFrame, size: int):
        self.size = size
        d = three(counts.agg(*discounts(F.col("c"))).first())
        left = F.sum(F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2]))
        context = settle(counts.groupBy("v").agg(F.sum("c").alias("total"), left.alias("left")), "contexts")
        self.table = settle(counts.join(context, "v").select("v", "w", (discounted(F.col("c"), d) / F.col("total")).alias("p")), "model")
        follow = settle(counts.groupBy("w").agg(F.count(F.lit(1)).alias("cc")), "follow")
        e = three(follow.agg(*discounts(F.col("cc"))).first())
        whole = follow.agg(F.sum("cc").alias("t"), F.sum(F.when(F.col("cc") == 1, e[0]).when(F.col("cc") == 2, e[1]).otherwise(e[2])).alias("left")).first()
        # a row a piece at most, so the vocabulary bounds what comes to the driver
        c, f = context.select("v", (F.col("left") / F.col("total")).alias("g")).toArrow(), follow.select("w", discounted(F.col("cc"), e).alias("m")).toArrow()
        self.backoff = np.ones(size + 1)
        self.backoff[c.column("v").to_numpy()] = c.column("g").to_numpy()
        self.unigram = np.full(size + 1, whole["left"] / whole["t"] / size)
        self.unigram[f.column("w").to_numpy()] += f.column("m").to_numpy() / whole["t"]
        forget(context, follow)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids that are labelled good and never bad or toxic."""
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    return known.where("q = 1 AND coalesce(t, 0) = 0").select("doc_id")


def left_out() -> F.Column:
    return F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(5)) == 0


def perplexities(docs: DataFrame, trusted: DataFrame, n_trusted: int, path: str | None = None) -> DataFrame | None:
    """doc_id, lang, n_tokens and perplexity of every document under the model of trusted text; None without trusted text."""
    from tokenizers import Tokenizer

    path = path or vocabulary_path()
    size = Tokenizer.from_file(path).get_vocab_size()
    spark = docs.sparkSession
    text = docs.select("doc_id", "text", "lang")
    counts = semi(text, trusted.where(~left_out()), "doc_id", n_trusted).mapInArrow(_counted(path, size), "v int, w int, c long")
    counts = settle(counts.groupBy("v", "w").agg(F.sum("c").alias("c")), "bigrams")
    if not counts.limit(1).count():
        return None
    model = KneserNey(counts, size)
    forget(counts)
    asked = text.mapInArrow(_asked(path, size), "block long, v int, w int")
    found = asked.join(model.table, ["v", "w"], "left").select("block", F.struct("v", "w", F.coalesce("p", F.lit(0.0)).alias("p")).alias("a"))
    answers = found.groupBy("block").agg(F.collect_list("a").alias("answers"))
    packed = text.mapInArrow(_packed(path), "block long, doc_id array<long>, lang array<string>, n array<int>, width int, ids binary")
    tables = spark.sparkContext.broadcast((model.backoff, model.unigram))
    out = packed.join(answers, "block", "left").select("doc_id", "lang", "n", "width", "ids", "answers").mapInArrow(_scored(tables, size), "doc_id long, lang string, n_tokens long, log_p double")
    out = out.select("doc_id", "lang", "n_tokens", F.when(F.col("n_tokens") > 0, F.exp(-F.col("log_p") / F.col("n_tokens"))).alias("perplexity"))
    out.reads = model.table  # until the result is written
    return out


def quality_lm(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, path: str | None = None) -> DataFrame:
    """doc_id, lang, n_tokens, perplexity, threshold (of its language) and kept."""
    docs = as_documents(docs, {"doc_id": "long", "text": "string", "lang": "string"})
    trusted = settle(trusted_ids(as_documents(labels, {"doc_id": "long", "quality": "int", "toxic": "int"})), "trusted")
    scored = perplexities(docs, trusted, trusted.count(), path)
    if scored is None:
        some = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
        return docs.select("doc_id", "lang", F.lit(None).cast("long").alias("n_tokens"), F.lit(None).cast("double").alias("perplexity"), F.lit(None).cast("double").alias("threshold"), some.alias("kept"))
    model, scored = scored.reads, settle(scored, "scored")
    forget(model)
    apart = scored.join(trusted.where(left_out()), "doc_id", "left_semi").where("perplexity IS NOT NULL")
    cut = lambda: F.percentile_approx("perplexity", quantile, 100_000).alias("threshold")
    limits = settle(apart.groupBy(F.col("lang").alias("of")).agg(cut()), "limits")
    whole = apart.agg(cut()).first()["threshold"]
    forget(trusted)
    limits = F.broadcast(limits) if limits.count() * 64 <= BROADCAST_BYTES else limits
    out = scored.join(limits, F.col("lang").eqNullSafe(F.col("of")), "left").drop("of").withColumn("threshold", F.coalesce("threshold", F.lit(whole).cast("double")))
    return out.withColumn("kept", F.coalesce(F.col("perplexity") <= F.coalesce("threshold", F.lit(float("inf"))), F.lit(False)))


def op5_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return quality_lm(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
