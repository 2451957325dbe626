"""Weak supervision of document quality, with DataFrame functions only.

Rules look at counts of a document and vote good (1), bad (-1) or abstain (0).  Vote patterns are counted over
all documents (at most 3 ** rules rows), and expectation-maximisation over the counted patterns estimates how
each rule votes on good and on bad documents, so that rules that agree with the others weigh more.  The posterior
probability of "good" replaces an all-must-pass filter.

Edge cases: null and empty texts have zero counts and fail the base rule (under 20 words); a very long text is judged as a
whole, in arrays as long as its words; a posterior that ties with the threshold is kept; rows that repeat an id, or have
none, are judged one by one; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, as_documents, forget, read, settle

WINDOW = 8
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _chars_of(text: str, chars: str) -> Column:
    """How many characters of ``text`` are among ``chars``."""
    return F.col("len") - F.char_length(F.translate(text, chars, ""))


def features(docs: DataFrame) -> DataFrame:
    """Counts of each row of ``docs`` (doc_id, text) over the whole text.

    n_repeat_words are the words in 8-word windows found twice or more in the text.  Windows are compared by 64-bit
    hashes inside the row, so nothing is exploded or shuffled; positions are sorted only where a window repeats.
    """
    d = as_documents(docs, {"doc_id": "long", "text": "string"}).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("len", F.char_length("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.select(
        "doc_id",
        F.transform(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""), lambda w: F.xxhash64(w)).alias("h"),
        (F.col("len") - _chars_of("text", SPACE)).alias("word_chars"),
        _chars_of("text", SYMBOLS).alias("n_symbols"),
        _chars_of("text", UPPER).alias("n_upper"),
        _chars_of("text", "!").alias("n_shouts"),
        _chars_of("text", ".?!").alias("n_stops"),
        _chars_of("text", "|").alias("n_bars"),
        lines.alias("lines"),
    )
    n = F.size("h")
    d = d.select(
        *(c for c in d.columns if c not in ("h", "lines")),
        n.cast("long").alias("n_words"),
        F.size(F.array_distinct("h")).cast("long").alias("n_distinct"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - WINDOW + 1), lambda i: F.xxhash64(F.slice("h", i, WINDOW)))).otherwise(F.array().cast("array<long>")).alias("w"),
    )
    d = d.withColumn("w", F.when(F.size(F.array_distinct("w")) < F.size("w"), F.sort_array(F.transform("w", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))).otherwise(F.array().cast("array<struct<x:long,i:int>>")))
    twin = F.filter("w", lambda e, k: (F.get("w", k - 1)["x"] == e["x"]) | (F.get("w", k + 1)["x"] == e["x"]))
    d = d.withColumn("w", F.sort_array(F.transform(twin, lambda e: e["i"])))
    covered = F.aggregate(
        "w",
        F.struct(F.lit(0).alias("sum"), F.lit(-WINDOW).alias("last")),
        lambda s, p: F.struct((s["sum"] + F.least(F.lit(WINDOW), p - s["last"])).alias("sum"), p.alias("last")),
        lambda s: s["sum"],
    )
    return d.withColumn("n_repeat_words", covered.cast("long")).drop("w").withColumns({c: F.col(c).cast("long") for c in ("word_chars", "n_symbols", "n_upper", "n_shouts", "n_stops", "n_bars")})


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def rules() -> dict[str, Column]:
    """Name -> vote.  Rules against a text vote bad or abstain; each defect is seen by two rules or more, from different
    counts.  Rules for a text vote good or abstain."""
    words, chars = (F.greatest(c, F.lit(1)) for c in ("n_words", "word_chars"))
    mean = F.col("word_chars") / words
    repeated, symbols = F.col("n_repeat_words") / words, F.col("n_symbols") / words
    capitals, shouts = F.col("n_upper") / chars, F.col("n_shouts") / words
    varied = F.col("n_distinct") / words
    bad = {
        "short": F.col("n_words") < 20,
        "very_short": F.col("n_words") < 8,
        "repeats": repeated > 0.30,
        "some_repeats": repeated > 0.25,
        "same_words": (F.col("n_words") >= 30) & (varied < 0.2),
        "same_lines": (F.col("n_dup_lines") >= 3) & (F.col("n_dup_lines") > 0.3 * F.col("n_lines")),
        "symbols": symbols > 0.3,
        "symbol_share": F.col("n_symbols") / chars > 0.04,
        "table": F.col("n_bars") > 0.2 * F.col("n_words"),
        "capitals": capitals > 0.4,
        "shouts": shouts > 0.3,
        "no_stops": (F.col("n_words") >= 30) & (F.col("n_stops") < 0.005 * F.col("n_words")),
        "word_size": (mean < 2) | (mean > 14),
    }
    good = {
        "prose": (F.col("n_words") >= 20) & (F.col("n_stops") / words).between(0.01, 0.6) & (symbols < 0.1) & (capitals < 0.25) & (shouts < 0.1),
        "own_words": (F.col("n_words") >= 20) & (repeated < 0.05) & (mean.between(3, 10)) & (symbols < 0.1),
    }
    return {n: F.when(c, -1).otherwise(0) for n, c in bad.items()} | {n: F.when(c, 1).otherwise(0) for n, c in good.items()}


def posterior(model: dict) -> Column:
    """Probability of "good" from the vote columns, under the current estimates.  They are the items of one array, which
    generated code takes by reference: all rounds share the code of the first."""
    odds = [math.log(model["prior"] / (1 - model["prior"]))]
    for table in model["rules"].values():
        odds += [math.log(table[1][v] / table[0][v]) for v in (-1, 0, 1)]
    items = F.lit(odds)
    logit = F.get(items, F.lit(0))
    for k, name in enumerate(model["rules"]):
        logit = logit + F.get(items, F.col(name) + (3 * k + 2))
    return 1 / (1 + F.exp(-F.greatest(F.least(logit, F.lit(500.0)), F.lit(-500.0))))


def estimate(patterns: DataFrame, names: list[str], rounds: int = 100, smooth: float = 1.0, close: float = 1e-6) -> dict:
    """Expectation-maximisation over ``patterns`` (a column a rule, and n) until no estimate moves by ``close``; a warning
    says so if ``rounds`` end before that.  Every round is one aggregate over the counted patterns; the driver sees its
    sums only, which are three a rule.  A rule that would vote worse than chance counts for nothing in that round."""
    start = {-1: 0.02, 0: 0.58, 1: 0.4}, {-1: 0.4, 0: 0.58, 1: 0.02}  # at first, to abstain says nothing
    model = {"prior": 0.8, "rules": {n: {1: start[0], 0: start[1]} for n in names}}
    votes = [(name, v) for name in names for v in (-1, 0, 1)]
    hits = lambda c: [F.sum(F.when(F.col(name) == v, F.col(c)).otherwise(0)).alias(f"{name}_{v}") for name, v in votes]
    whole = patterns.agg(F.sum("n").alias("all"), *hits("n")).first()
    if not whole["all"]:
        return model
    for _ in range(rounds):
        row = patterns.withColumn("good", F.col("n") * posterior(model)).agg(F.sum("good").alias("good"), *hits("good")).first()
        good, bad = row["good"], whole["all"] - row["good"]
        was, model = model, {"prior": min(0.99, max(0.01, good / whole["all"])), "rules": {}}
        for name in names:
            table = {1: {}, 0: {}}
            for v in (-1, 0, 1):
                g, a = row[f"{name}_{v}"], whole[f"{name}_{v}"]
                table[1][v] = (g + smooth) / (good + 3 * smooth)
                table[0][v] = (max(0.0, a - g) + smooth) / (bad + 3 * smooth)
            if table[1][-1] >= table[0][-1] and table[1][1] <= table[0][1]:
                table[1] = table[0] = {v: (table[1][v] + table[0][v]) / 2 for v in (-1, 0, 1)}
            model["rules"][name] = table
        if max(abs(model["rules"][n][y][v] - was["rules"][n][y][v]) for n, v in votes for y in (0, 1)) < close:
            return model
    warnings.warn(f"quality rules: estimates still move after {rounds} rounds", stacklevel=2)
    return model


def quality_rules(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Counts, base_failed, posterior ``p_good`` and kept (not base_failed, and the posterior reaches ``threshold``)."""
    counted = settle(features(docs), "features")
    votes = rules()
    voted = counted.select("*", *(v.alias(f"vote_{n}") for n, v in votes.items()))
    names = [f"vote_{n}" for n in votes]
    patterns = settle(voted.groupBy(*names).agg(F.count(F.lit(1)).alias("n")), "patterns")
    p = posterior(estimate(patterns, names))
    forget(patterns)
    return voted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), (~base_failed() & (p >= threshold)).alias("kept"), p.alias("p_good"),
    )


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(read(spark, sf_dir, "documents"))
