"""Soft-membership mixing: document rates whose expected domain token totals match targets.

Domains are those of the labels table: low_quality (quality 0), toxic (quality 1, toxic 1) and clean (both fine).  A
softmax classifier fitted on a bounded sample of labelled rows gives each document a posterior p over domains.  With n
tokens of a public tokenizer, rates r >= 0 are fitted to minimise the squared distance of the totals sum(r * n * p) from the
targets, plus a small ridge towards 1, so that what needs no change keeps its rate: without it a target beyond reach would
be chased by trading clean documents for other clean documents that look a little more like the scarce domain.

The fit is projected gradient descent in the metric of document tokens: each step moves every rate against its document's
gradient p . miss and clips it at 0 and ``most``.  Documents whose posteriors agree to 1 / ``grid`` move alike, so one
distributed aggregate gives the token masses of at most (grid + 1) ** 2 cells, whatever the corpus, and all steps run on
those; as a cell's masses are the exact sums over its documents, so are the totals that the rates reach.

Edge cases: null and empty texts have no tokens, take the domain of the prior and change no total; a very long text is one
document with one rate; with labels of one domain or none, all rates are 1; rows that repeat an id get rates of their own,
and equal rows equal ones; an empty table gives an empty result; extra columns are ignored (the pipeline stage keeps the columns of documents).
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_documents, forget, read, settle
from .features import SAMPLE, STYLES, Adam, choose_vocabulary, labelled_sample, sample_matrix, sparse
from .packing import vocabulary_path, worker_encoder
from .words import text_chunks, word_spans

DOMAINS = ("clean", "low_quality", "toxic")
#: Shares of the mix, and its size as a multiple of the expected clean tokens.
TARGETS = {"clean": 0.97, "low_quality": 0.02, "toxic": 0.01}
VOCABULARY, MOST, GRID, RIDGE = 512, 4.0, 64, 1e-3


def domain_of() -> Column:
    """Index in DOMAINS of a row of labels; null where it has no full label."""
    return F.when(F.col("quality") == 0, 1).when((F.col("quality") == 1) & (F.col("toxic") == 1), 2).when((F.col("quality") == 1) & (F.col("toxic") == 0), 0)


def fit_softmax(rows, cols, vals, label: np.ndarray, width: int, classes: int, steps: int = 300, ridge: float = 1e-4) -> np.ndarray:
    """Weights (width + 1, classes); the last row is the bias.  Rows weigh the same, so that posteriors are calibrated."""
    n = len(label)
    hot = np.eye(classes)[label]
    w, opt = np.zeros((width + 1, classes)), Adam()
    for _ in range(steps):
        s = np.stack([np.bincount(rows, vals * w[cols, k], minlength=n) for k in range(classes)], 1) + w[-1]
        p = np.exp(s - s.max(1, keepdims=True))
        g = (p / p.sum(1, keepdims=True) - hot) / n
        grad = np.stack([np.bincount(cols, vals * g[rows, k], minlength=width) for k in range(classes)], 1)
        w = opt.step(w, np.r_[grad + ridge * w[:-1], [g.sum(0)]])
    return w


def _posteriors(model, path: str):
    """Tokens, and a posterior a domain; without a model all is of the first domain."""

    def run(batches):
        enc = worker_encoder(path)
        for batch in batches:
            for lo, hi, buf, off in text_chunks(batch.column(1)):
                spans = word_spans(buf, off)
                n_tokens = enc.count(buf, off, spans)
                p = np.zeros((hi - lo, len(DOMAINS)))
                p[:, 0] = 1
                if model is not None:
                    vocab, w = model.value
                    rows, cols, vals, counts = sparse(buf, off, vocab, spans)
                    s = np.stack([np.bincount(rows, vals * w[cols, k], minlength=hi - lo) for k in range(w.shape[1])], 1)
                    s = s * (counts > 0)[:, None] + w[-1]
                    p = np.exp(s - s.max(1, keepdims=True))
                    p /= p.sum(1, keepdims=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(n_tokens), *(pa.array(p[:, k]) for k in range(p.shape[1]))], ["doc_id", "salt", "n_tokens", *(f"p_{d}" for d in DOMAINS)])

    return run


def posteriors(docs: DataFrame, labels: DataFrame, vocabulary: int = VOCABULARY, sample: int = SAMPLE, path: str | None = None) -> tuple[DataFrame, bool]:
    """doc_id, salt (a hash of the row), n_tokens (of the tokenizer at ``path``) and a posterior a domain; and whether a
    classifier was fitted, as labels of fewer than two domains teach nothing."""
    docs = as_documents(docs, {"doc_id": "long", "text": "string"})
    known = labelled_sample(docs, as_documents(labels, {"doc_id": "long", "quality": "int", "toxic": "int"}), domain_of(), sample)
    model = None
    if known.select("label").distinct().count() > 1:
        vocab = choose_vocabulary(known, len(DOMAINS), vocabulary)
        rows, cols, vals, label = sample_matrix(known, vocab)
        w = fit_softmax(rows, cols, vals, label, len(vocab) + STYLES, len(DOMAINS))
        model = docs.sparkSession.sparkContext.broadcast((vocab, w))
    forget(known)
    schema = "doc_id long, salt long, n_tokens long, " + ", ".join(f"p_{d} double" for d in DOMAINS)
    return docs.withColumn("salt", F.xxhash64("doc_id", "text")).mapInArrow(_posteriors(model, path or vocabulary_path()), schema), model is not None


def fit_rates(mass: np.ndarray, targets: np.ndarray, most: float = MOST, ridge: float = RIDGE, steps: int = 50_000, close: float = 1e-9) -> np.ndarray:
    """Rates in [0, most] by accelerated projected gradient steps from 1; ``mass`` has a row a cell and its expected tokens of
    each domain.  They minimise the squared distance of ``rates @ mass`` from ``targets``, in shares of all targets, plus
    ``ridge`` times the mean squared distance of a token's rate from 1."""
    tokens = mass.sum(1)
    p = mass / np.maximum(tokens, 1e-300)[:, None]
    weight = tokens.sum() / max(targets.sum() ** 2, 1e-300)
    step = 1 / (weight * np.linalg.eigvalsh(p.T @ mass)[-1] + ridge)
    rate = ahead = np.ones(len(mass))
    t = 1.0
    for _ in range(steps):
        new = np.clip(ahead - step * (weight * (p @ (ahead @ mass - targets)) + ridge * (ahead - 1)), 0, most)
        if tokens @ ((ahead - new) * (new - rate)) > 0:
            t = 1.0  # the momentum points uphill
        more = (1 + np.sqrt(1 + 4 * t * t)) / 2
        moved = np.abs(new - rate).max(initial=0)
        rate, ahead, t = new, new + (t - 1) / more * (new - rate), more
        if moved < close:
            break
    return rate


def mix(docs: DataFrame, labels: DataFrame, shares: dict[str, float] | None = None, most: float = MOST, sample: int = SAMPLE, path: str | None = None, grid: int = GRID) -> DataFrame:
    """doc_id, salt, n_tokens, posteriors, rate and copies.  The mix is as large as the expected clean tokens divided by the
    clean share; a domain that has less than its share is raised, by rates up to ``most``.  Where the bounds keep totals from
    their targets, a warning names what is missed.  ``copies`` rounds a rate up or down by the row's hash, so that expected
    totals hold.  The classifier is fitted on at most ``sample`` labelled rows."""
    shares = shares or TARGETS
    table, fitted = posteriors(docs, labels, sample=sample, path=path)
    if not fitted:
        return table.withColumns({"rate": F.lit(1.0), "copies": F.lit(1)})
    table = settle(table, "posteriors")
    cell = [F.round(F.col(f"p_{d}") * grid).cast("int").alias(f"cell_{d}") for d in DOMAINS[1:]]
    table = table.withColumns({f"cell_{d}": c for d, c in zip(DOMAINS[1:], cell, strict=True)})
    at = [f"cell_{d}" for d in DOMAINS[1:]]
    held = table.groupBy(*at).agg(*(F.sum(F.col("n_tokens") * F.col(f"p_{d}")).alias(d) for d in DOMAINS)).orderBy(*at).toArrow()
    if not len(held):
        return table.drop(*at).withColumns({"rate": F.lit(1.0), "copies": F.lit(1)})
    mass = np.stack([held.column(d).to_numpy() for d in DOMAINS], 1)
    whole = mass[:, 0].sum() / shares[DOMAINS[0]]
    targets = np.array([whole * shares[d] for d in DOMAINS])
    rates = fit_rates(mass, targets, most)
    got = rates @ mass
    if np.abs(got - targets).max() > 1e-3 * targets.sum():
        said = ", ".join(f"{d} {a:.0f} of {b:.0f}" for d, a, b in zip(DOMAINS, got, targets, strict=True))
        warnings.warn(f"mixing: token totals miss their targets with rates of 0 to {most:g}: {said}", stacklevel=2)
    cells = zip(*(held.column(c).to_pylist() for c in at), rates.tolist(), strict=True)
    rated = docs.sparkSession.createDataFrame(list(cells), ", ".join(f"{c} int" for c in at) + ", rate double")
    draw = F.pmod(F.col("salt"), F.lit(1 << 20)) / (1 << 20)
    return table.join(F.broadcast(rated), at).drop(*at).withColumn("copies", F.floor(F.col("rate") + draw).cast("int"))


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("salt")
