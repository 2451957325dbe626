"""Sparse text features for classifiers that are fitted on a bounded sample of labelled rows.

A classifier's vocabulary and weights come from at most ``sample`` labelled documents (those with the smallest hash of
their id, so the same ones in every run).  Features of any document are the capped counts of the vocabulary's words
over its whole text, and a few shares of characters and words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_documents, settle
from .words import mix, text_chunks, word_hashes, word_spans

SAMPLE, VOCABULARY, LEAST = 20_000, 2048, 5
STYLES = 6
_CLASSES = (b"#*$%&|<>", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"!", b".,;:?")


def _word_rows(buf: np.ndarray, off: np.ndarray, spans=None):
    starts, ends, counts = spans or word_spans(buf, off)
    # closing punctuation is no part of a word here
    cut = ends.copy()
    mark = np.zeros(256, bool)
    mark[list(b".,;:!?\"')")] = True
    for _ in range(3):
        cut -= ((cut - starts) > 1) & mark[buf[np.maximum(cut - 1, 0)]] if len(cut) else 0
    return word_hashes(buf, starts, cut, lower=True), np.repeat(np.arange(len(counts)), counts), counts


def _firsts(h: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Where each distinct word of a document comes first."""
    return np.unique(mix(h + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]


def _marks() -> np.ndarray:
    """Which bytes are in which class; a byte may be in several."""
    kinds = np.zeros((len(_CLASSES), 256), bool)
    for k, chars in enumerate(_CLASSES):
        kinds[k, list(chars)] = True
    return kinds


def _styles(buf: np.ndarray, off: np.ndarray, owner: np.ndarray, h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    n = len(counts)
    out = np.zeros((n, STYLES))
    words, size = np.maximum(counts, 1), np.maximum(np.diff(off), 1)
    kinds = _marks()
    at = np.flatnonzero(kinds.any(0)[buf])
    byte, doc = buf[at], np.searchsorted(off, at, "right") - 1
    for k in range(len(_CLASSES)):
        # of words for marks, of bytes for capitals
        out[:, k] = np.bincount(doc[kinds[k][byte]], minlength=n) / (size if k == 1 else words)
    out[:, 4] = np.bincount(owner[_firsts(h, owner)], minlength=n) / words
    out[:, 5] = 1 / (1 + words / 20)
    return np.minimum(out, 3.0)


def sparse(buf: np.ndarray, off: np.ndarray, vocab: np.ndarray, spans=None):
    """(rows, columns, values) of a chunk's documents, and their word counts.  Columns from len(vocab) on are the styles."""
    h, owner, counts = _word_rows(buf, off, spans)
    n = len(counts)
    at = np.minimum(np.searchsorted(vocab, h), max(0, len(vocab) - 1))
    hit = vocab[at] == h if len(vocab) else np.zeros(len(h), bool)
    cell, times = np.unique(owner[hit] * max(1, len(vocab)) + at[hit], return_counts=True)
    style = _styles(buf, off, owner, h, counts)
    rows = np.r_[cell // max(1, len(vocab)), np.repeat(np.arange(n), STYLES)]
    cols = np.r_[cell % max(1, len(vocab)), np.tile(len(vocab) + np.arange(STYLES), n)]
    return rows, cols, np.r_[np.log1p(np.minimum(times, 8)), style.reshape(-1)], counts


def _document_words():
    """Distinct words of each labelled document, counted by label over a batch."""

    def run(batches):
        for batch in batches:
            label = batch.column(1).to_numpy()
            for lo, hi, buf, off in text_chunks(batch.column(0)):
                h, owner, _ = _word_rows(buf, off)
                first = _firsts(h, owner)
                words, tags = h[first], label[lo:hi][owner[first]]
                for tag in np.unique(tags):
                    w, n = np.unique(words[tags == tag], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(np.full(len(w), tag, np.int32)), pa.array(n)], ["word", "label", "n"])

    return run


def labelled_sample(docs: DataFrame, labels: DataFrame, label: F.Column, sample: int = SAMPLE) -> DataFrame:
    """doc_id, text and ``label`` of at most ``sample`` labelled documents; rows without a label, and ids labelled
    in two ways, are left out."""
    known = labels.select("doc_id", label.cast("int").alias("label")).where("doc_id IS NOT NULL AND label IS NOT NULL")
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").drop("other")
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    docs = as_documents(docs, {"doc_id": "long", "text": "string"})
    return settle(docs.join(F.broadcast(some), "doc_id"), "labelled")


def choose_vocabulary(known: DataFrame, classes: int, size: int = VOCABULARY, least: int = LEAST) -> np.ndarray:
    """Hashes of the ``size`` words that tell the labels apart best (chi-square of document counts), sorted."""
    total = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    every = sum(total.values())
    words = known.select("text", "label").mapInArrow(_document_words(), "word long, label int, n long")
    words = words.groupBy("word").pivot("label", list(range(classes))).agg(F.sum("n")).na.fill(0)
    df = sum((F.col(str(k)) for k in range(classes)), F.lit(0))
    words = words.withColumn("df", df).where(F.col("df") >= least)
    score = F.lit(0.0)
    for k in range(classes):
        for part, whole in ((F.col(str(k)), F.col("df")), (total.get(k, 0) - F.col(str(k)), every - F.col("df"))):
            want = whole * F.lit(total.get(k, 0) / max(1, every))
            score = score + F.when(want > 0, (part - want) * (part - want) / want).otherwise(0.0)
    top = words.select("word", score.alias("score")).orderBy(F.desc("score"), "word").limit(size).toArrow()
    return np.sort(top.column("word").to_numpy().view(np.uint64))


def _triples(vocab):
    def run(batches):
        for batch in batches:
            for lo, hi, buf, off in text_chunks(batch.column(1)):
                rows, cols, vals, counts = sparse(buf, off, vocab.value)
                order = np.argsort(rows, kind="stable")
                cut = pa.array(np.r_[0, np.cumsum(np.bincount(rows, minlength=hi - lo))].astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(2).slice(lo, hi - lo), pa.ListArray.from_arrays(cut, pa.array(cols[order].astype(np.int32))), pa.ListArray.from_arrays(cut, pa.array(vals[order].astype(np.float32)))],
                    ["label", "cols", "vals"],
                )

    return run


def sample_matrix(known: DataFrame, vocab: np.ndarray):
    """(rows, columns, values, labels) of the bounded sample, for fitting on the driver."""
    send = known.sparkSession.sparkContext.broadcast(vocab)
    got = known.select("doc_id", "text", "label").mapInArrow(_triples(send), "label int, cols array<int>, vals array<float>").toArrow()
    cols, vals = (got.column(c).combine_chunks() for c in ("cols", "vals"))
    per = cols.value_lengths().to_numpy(zero_copy_only=False) if len(got) else np.zeros(0, np.int64)
    return np.repeat(np.arange(len(got)), per), cols.flatten().to_numpy(), vals.flatten().to_numpy().astype(np.float64), got.column("label").to_numpy()


class Adam:
    """Full-batch gradient steps with moment estimates."""

    def __init__(self, rate: float = 0.05):
        self.rate, self.t, self.m, self.v = rate, 0, 0.0, 0.0

    def step(self, x: np.ndarray, g: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * g
        self.v = 0.999 * self.v + 0.001 * g * g
        return x - self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)
