"""Severity of toxic language by cumulative-link ordinal regression.

P(grade > k) = sigmoid(w . x - t_k): one weight vector for all thresholds, and thresholds in rising order.  The expected
severity is the sum of these probabilities.  The labels table says only toxic or not, so grades for fitting are derived:
0 for documents labelled not toxic; those labelled toxic get 1, 2 or 3 by the thirds of how often words that mark toxic
documents (document counts at least ``MARK`` times as likely in toxic ones) occur in them.

Vocabulary and weights are fitted on a bounded sample of labelled rows (``sample``); every document is scored
over its whole text.

Edge cases: null and empty texts have severity 0 and are not toxic; a very long text is scored whole; a probability that
ties with one half is toxic, and of grades that tie the lowest is taken; without labels of both kinds nothing can be
learned and all severities are 0; rows that repeat an id are scored one by one; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_documents, read
from .features import SAMPLE, STYLES, Adam, choose_vocabulary, labelled_sample, sample_matrix, sparse
from .words import text_chunks

GRADES, MARK, VOCABULARY = 4, 5.0, 256


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def derived_grades(rows, cols, vals, toxic: np.ndarray, width: int) -> np.ndarray:
    """0 for not toxic; 1 to 3 by thirds of the mass of marking words."""
    words = cols < width - STYLES
    r, c, v = rows[words], cols[words], vals[words]
    seen = [np.bincount(c[toxic[r] == y], minlength=width) for y in (0, 1)]
    rate = [(s + 0.5) / (max(1, (toxic == y).sum()) + 1) for y, s in enumerate(seen)]
    marks = (rate[1] >= MARK * rate[0]) & (seen[1] >= 3)
    mass = np.bincount(r, np.expm1(v) * marks[c], minlength=len(toxic))
    grades = np.zeros(len(toxic), np.int64)
    mine = toxic == 1
    if mine.any():
        a, b = np.quantile(mass[mine], [1 / 3, 2 / 3])
        grades[mine] = 1 + (mass[mine] > a) + (mass[mine] > b)
    return grades


def fit(rows, cols, vals, grades: np.ndarray, width: int, steps: int = 300, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds, after ``steps`` (to stop early keeps weights small).  Both classes of every threshold weigh the same, as toxic rows are few."""
    n, k = len(grades), GRADES - 1
    w, raw = np.zeros(width), np.r_[0.0, np.zeros(k - 1)]  # t_0, then logarithms of the gaps
    above = grades[:, None] > np.arange(k)
    weight = np.where(above, 0.5 / np.maximum(above.sum(0), 1), 0.5 / np.maximum((~above).sum(0), 1))
    opt = Adam()
    for _ in range(steps):
        gaps = np.exp(raw[1:])
        t = raw[0] + np.r_[0, np.cumsum(gaps)]
        score = np.bincount(rows, vals * w[cols], minlength=n)
        g = (_sigmoid(score[:, None] - t) - above) * weight
        per = g.sum(1)
        gw = np.bincount(cols, vals * per[rows], minlength=width) + ridge * w
        gt = -g.sum(0)
        graw = np.r_[gt.sum(), [gt[i + 1 :].sum() * gaps[i] for i in range(k - 1)]]
        x = opt.step(np.r_[w, raw], np.r_[gw, graw])
        w, raw = x[:width], x[width:]
    return w, raw[0] + np.r_[0, np.cumsum(np.exp(raw[1:]))]


def _score(model):
    def run(batches):
        vocab, w, t = model.value
        for batch in batches:
            for lo, hi, buf, off in text_chunks(batch.column(1)):
                rows, cols, vals, counts = sparse(buf, off, vocab)
                s = np.bincount(rows, vals * w[cols], minlength=hi - lo)
                above = _sigmoid(s[:, None] - t) * (counts > 0)[:, None]
                at_least = np.c_[np.ones(hi - lo), above]
                grade = (at_least - np.c_[above, np.zeros(hi - lo)]).argmax(1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(above.sum(1)), pa.array(np.where(above[:, 0] >= 0.5, np.maximum(grade, 1), 0).astype(np.int32)), pa.array(above[:, 0]), pa.array(above[:, 0] >= 0.5)],
                    ["doc_id", "expected_severity", "severity", "p_toxic", "toxic"],
                )

    return run


def toxicity(docs: DataFrame, labels: DataFrame, vocabulary: int = VOCABULARY, sample: int = SAMPLE) -> DataFrame:
    """doc_id, expected_severity (0 to 3), severity (the likeliest grade; 0 where not toxic), p_toxic and toxic."""
    docs = as_documents(docs, {"doc_id": "long", "text": "string"})
    labels = as_documents(labels, {"doc_id": "long", "toxic": "int"})
    known = labelled_sample(docs, labels, F.when(F.col("toxic").isNotNull(), (F.col("toxic") > 0).cast("int")), sample)
    if known.select("label").distinct().count() < 2:
        return docs.select("doc_id", F.lit(0.0).alias("expected_severity"), F.lit(0).alias("severity"), F.lit(0.0).alias("p_toxic"), F.lit(False).alias("toxic"))
    vocab = choose_vocabulary(known, 2, vocabulary)
    rows, cols, vals, toxic = sample_matrix(known, vocab)
    width = len(vocab) + STYLES
    w, t = fit(rows, cols, vals, derived_grades(rows, cols, vals, toxic, width), width)
    model = docs.sparkSession.sparkContext.broadcast((vocab, w, t))
    return docs.mapInArrow(_score(model), "doc_id long, expected_severity double, severity int, p_toxic double, toxic boolean")


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
