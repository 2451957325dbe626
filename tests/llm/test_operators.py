"""Operators against brute force on small tables, with nulls, ties, repeats and odd columns."""

import glob
import hashlib
import math
import os
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siftline.llm import exact_dedup, language_id, mixing, near_dedup, packing, quality_lm, quality_rules, registry, substring_dedup, toxicity, warc
from siftline.llm.common import settle

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
BASE = " ".join(f"w{i}" for i in range(60))
CASES = [
    (1, BASE), (2, BASE.replace("w59", "x")), (3, BASE.replace(" ", "\t")), (4, None), (5, ""), (6, " \n"), (7, "one two"), (8, "One  two"), (9, BASE + " " + " ".join(f"v{i}" for i in range(60))),
    (10, "a b c d e f g h " * 6), (11, "y" * 30000), (12, "z q " * 4000), (13, BASE.replace("w30", "x y")), (14, BASE), (14, BASE), (None, BASE), (15, "# * $ " * 30), (16, "line one\nline one\n\n \nline one"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in CASES], DOCS).withColumns({c: F.lit(1) for c in ("norm", "sha", "n", "kept", "pos", "key", "length", "salt", "piece", "n_words", "label")})


def table(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda r: tuple(map(str, r)))


def words_of(text):
    return WORD.findall(text or "")


def empty(docs):
    return docs.where("false")


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for p in glob.glob(f"{small}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_as_duckdb(spark, duck, small, name):
    got = registry.QUERIES[name](spark, small)
    want = duck.execute(registry.ORACLE_SQL[name])
    columns = [x[0] for x in want.description]
    assert sorted(got.columns) == sorted(columns)
    show = lambda rows, names: sorted(str([r[names.index(c)] for c in sorted(names)]) for r in rows)
    assert show([tuple(r) for r in got.collect()], got.columns) == show(want.fetchall(), columns)


def test_operators_change_no_setting(spark, docs):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    packing.pack_documents(docs).count()
    substring_dedup.substring_dedup(docs).count()
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"


# -- 1 quality rules


def brute_counts(text):
    text = text or ""
    w = words_of(text)
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if words_of(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(docs):
    got = table(quality_rules.quality_rules(docs), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert got == sorted(((i, *brute_counts(t)) for i, t in CASES), key=lambda r: tuple(map(str, r)))
    assert quality_rules.quality_rules(empty(docs)).count() == 0


def test_quality_verdict(spark, small):
    q = quality_rules.op1_quality_rules(spark, small)
    assert q.where("base_failed AND kept").count() == 0
    known = q.join(spark.read.parquet(f"{small}/labels.parquet"), "doc_id").where("NOT base_failed")
    good, bad = (known.where(f"quality = {k}").agg(F.avg(F.col("kept").cast("double"))).first()[0] for k in (1, 0))
    assert good > 0.97 and (bad is None or bad < 0.1)


def test_quality_estimate_is_plain_em(spark):
    """Against the same recursion over single rows in numpy."""
    rng = np.random.default_rng(1)
    y = rng.random(500) < 0.8
    votes = np.stack([np.where(rng.random(500) < 0.3, 0, np.where(rng.random(500) < a, np.where(y, 1, -1), np.where(y, -1, 1))) for a in (0.9, 0.8, 0.7)], 1)
    names = ["a", "b", "c"]
    df = spark.createDataFrame([tuple(map(int, v)) for v in votes], "a int, b int, c int").groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    got = quality_rules.estimate(df, names, rounds=5)
    prior, table_ = 0.8, {n: ({-1: 0.4, 0: 0.58, 1: 0.02}, {-1: 0.02, 0: 0.58, 1: 0.4}) for n in names}
    for _ in range(5):
        logit = math.log(prior / (1 - prior)) + sum(np.array([math.log(table_[n][1][v] / table_[n][0][v]) for v in votes[:, k]]) for k, n in enumerate(names))
        p = 1 / (1 + np.exp(-logit))
        prior = min(0.99, max(0.01, p.mean()))
        for k, n in enumerate(names):
            new = tuple({v: ((q * (votes[:, k] == v)).sum() + 1) / (q.sum() + 3) for v in (-1, 0, 1)} for q in (1 - p, p))
            if new[1][-1] >= new[0][-1] and new[1][1] <= new[0][1]:
                new = ({v: (new[0][v] + new[1][v]) / 2 for v in (-1, 0, 1)},) * 2
            table_[n] = new
    assert abs(got["prior"] - prior) < 1e-9
    assert all(abs(got["rules"][n][y][v] - table_[n][y][v]) < 1e-9 for n in names for y in (0, 1) for v in (-1, 0, 1))


def test_quality_is_native(docs):
    plan = quality_rules.features(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


# -- 2 toxicity


def test_toxicity(spark, small, docs):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    got = toxicity.op2_toxicity(spark, small).join(labels.withColumnRenamed("toxic", "y"), "doc_id")
    hit, false = got.where("y = 1 AND toxic").count(), got.where("y = 0 AND toxic").count()
    assert hit >= 0.6 * got.where("y = 1").count() and false <= 0.05 * got.where("y = 0").count()
    assert got.where("toxic AND severity = 0 OR NOT toxic AND severity > 0 OR expected_severity > 3").count() == 0
    none = toxicity.toxicity(docs, labels.where("false"))
    assert none.count() == len(CASES) and none.where("toxic").count() == 0
    assert toxicity.toxicity(empty(docs), labels).count() == 0


def edge_rows(spark, small):
    """The edge rows under ids of their own, beside documents that can be learned from."""
    edges = spark.createDataFrame([(None if i is None else i + 10**6, t) for i, t in CASES], "doc_id long, text string")
    return edges.union(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")).withColumns({c: F.lit(1) for c in ("label", "salt", "n", "word", "score", "toxic")})


def test_toxicity_scores_edges(spark, small):
    rows = edge_rows(spark, small)
    got = toxicity.toxicity(rows, spark.read.parquet(f"{small}/labels.parquet")).collect()
    assert len(got) == rows.count() and all(0 <= r["p_toxic"] <= 1 and 0 <= r["expected_severity"] <= 3 for r in got)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["expected_severity"], r["severity"], r["toxic"]))
    assert all(by[10**6 + i] == [(0.0, 0, False)] for i in (4, 5, 6))
    assert by[10**6 + 14][0] == by[10**6 + 14][1] == by[10**6 + 1][0] == by[None][0]
    assert len(by[10**6 + 11]) == 1


def plain_descent(loss_and_grad, x, steps=4000):
    """Gradient descent with halved steps: slow, and nothing else."""
    rate, (f, g) = 1.0, loss_and_grad(x)
    for _ in range(steps):
        y = x - rate * g
        fy, gy = loss_and_grad(y)
        if fy < f:
            x, f, g, rate = y, fy, gy, rate * 1.3
        else:
            rate /= 2
    return x, f


def test_ordinal_fit_orders_grades():
    rng = np.random.default_rng(0)
    x = rng.random(400)
    grades = np.digitize(x + rng.normal(0, 0.1, 400), [0.25, 0.5, 0.75])
    w, t = toxicity.fit(np.arange(400), np.zeros(400, int), x, grades, 1, steps=6000)
    assert t[0] < t[1] < t[2] and w[0] > 0
    assert np.abs((w[0] * x[:, None] > t).sum(1) - grades).mean() < 0.4
    above = grades[:, None] > np.arange(3)
    weight = np.where(above, 0.5 / above.sum(0), 0.5 / (~above).sum(0))

    def loss(v):
        z = v[0] * x[:, None] - v[1:]
        p = 1 / (1 + np.exp(-z))
        g = (p - above) * weight
        return (weight * (np.logaddexp(0, z) - above * z)).sum() + 5e-4 * v[0] ** 2, np.r_[(g * x[:, None]).sum() + 1e-3 * v[0], -g.sum(0)]

    _, best = plain_descent(loss, np.array([0.0, -1, 0, 1]))
    assert best - 1e-6 <= loss(np.r_[w, t])[0] <= 1.02 * best


def test_softmax_fit_is_plain_descent():
    rng = np.random.default_rng(6)
    x, label = rng.random((300, 3)), rng.integers(0, 3, 300)
    x[np.arange(300), label] += 0.5
    rows, cols = np.repeat(np.arange(300), 3), np.tile(np.arange(3), 300)
    w = mixing.fit_softmax(rows, cols, x.reshape(-1), label, 3, 3, steps=3000)
    hot, wide = np.eye(3)[label], np.c_[x, np.ones(300)]

    def loss(v):
        v = v.reshape(4, 3)
        s = wide @ v
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        return -np.log((p * hot).sum(1)).mean() + 5e-5 * (v[:3] ** 2).sum(), (wide.T @ (p - hot) / 300 + 1e-4 * np.r_[v[:3], np.zeros((1, 3))]).reshape(-1)

    _, best = plain_descent(loss, np.zeros(12))
    assert best - 1e-6 <= loss(w.reshape(-1))[0] <= 1.02 * best


# -- 3 near dedup


def shingles(text):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words_of(text)]
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute_components(cases):
    ids = sorted({i for i, _ in cases if i is not None})
    sets = {i: shingles(dict((a, b) for a, b in cases if a == i)[i]) for i in ids}
    up = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                i = len(sets[a] & sets[b])
                if a < b and sets[a] and sets[b] and 100 * i >= 85 * len(sets[a] | sets[b]) and up[a] != up[b]:
                    up[a] = up[b] = min(up[a], up[b])
                    changed = True
    return sets, up


def test_near_dedup(docs):
    sets, up = brute_components(CASES)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_dedup(docs).collect() if r["doc_id"] is not None}
    assert got == {i: (len(sets[i]), up[i], up[i] == i) for i in sets}
    assert near_dedup.near_dedup(docs).count() == len(CASES)
    assert near_dedup.near_dedup(empty(docs)).count() == 0


def test_near_dedup_repeated_ids(spark):
    """Every text of a repeated id makes its own links; what is linked to one of them is one component."""
    one, two = ([f"{c}{i}" for i in range(40)] for c in "pq")
    cases = [(1, one), (1, two), (2, [*one, "x"]), (3, [*two, "y"]), (4, [f"r{i}" for i in range(40)]), (5, [f"s{i}" for i in range(30)]), (5, [f"s{i}" for i in range(30)])]
    got = near_dedup.near_dedup(spark.createDataFrame([(i, " ".join(w)) for i, w in cases], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == [(1, 36, 1), (1, 36, 1), (2, 37, 1), (3, 37, 1), (4, 36, 4), (5, 26, 5), (5, 26, 5)]


def test_near_dedup_star_and_chain(spark):
    """Copies that resemble their original but not each other, a chain, and documents that share a long passage."""
    rng = np.random.default_rng(3)
    base = [f"b{i}" for i in range(200)]
    texts = [" ".join(base)]
    for k in range(24):
        w = list(base)
        for j in rng.choice(200, 3, replace=False):
            w[j] = f"m{k}_{j}"
        texts.append(" ".join(w))
    chain = [f"c{i}" for i in range(120)]
    for k in range(8):
        texts.append(" ".join([*(f"n{k}_{j}" for j in range(4 * k)), *chain[4 * k :]] if k else chain))
    texts += [" ".join([*(f"p{i}" for i in range(150)), *(f"u{k}_{i}" for i in range(60))]) for k in range(20)]
    cases = list(enumerate(texts))
    rng.shuffle(texts)
    cases = list(enumerate(texts))
    _, up = brute_components(cases)
    got = near_dedup.near_dedup(spark.createDataFrame(cases, "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == up


def test_components_of_a_hub_and_a_chain(spark):
    """A vertex with most of the links, and a path that is far longer than the rounds."""
    from siftline.llm.components import components

    links = [(5000 + i, 7) for i in range(3000)] + [(100 + i, 101 + i) for i in range(200)] + [(5000, 9000)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{100 + i: 100 for i in range(201)}, **{5000 + i: 7 for i in range(3000)}, 7: 7, 9000: 7}


# -- 4 exact dedup


def test_exact_dedup(docs):
    norm = [(i, t or "", re.sub(r"[\x20\x09-\x0D]", "", t or "")) for i, t in CASES]
    want = []
    for i, _, n in norm:
        group = [(-len(t), j is None, j or 0, j) for j, t, m in norm if m == n]
        keep = min(group)[3]
        want.append((i, keep, len(group), i == keep, hashlib.sha256(n.encode()).hexdigest()))
    got = table(exact_dedup.exact_dedup(docs), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert got == sorted(want, key=lambda r: tuple(map(str, r)))
    assert exact_dedup.exact_dedup(empty(docs)).count() == 0


def test_exact_dedup_settles_few_files(spark, monkeypatch):
    """Short tables go to a file a core, however many partitions a shuffle has."""
    files = {}

    def counted(df, name="table"):
        out = settle(df, name)
        files[name] = len(out.inputFiles())
        return out

    monkeypatch.setattr(exact_dedup, "settle", counted)
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        rows = spark.createDataFrame([(i, f"text {i % 300}") for i in range(600)], "doc_id long, text string")
        got = exact_dedup.exact_dedup(rows).where("group_size = 2 AND keep_id = doc_id % 300").count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == 600
    assert max(files["twice"], files["groups"]) <= spark.sparkContext.defaultParallelism


# -- 5 quality classifier


def test_kneser_ney_is_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    trusted = settle(quality_lm.trusted_ids(labels), "t")
    got = {r["doc_id"]: r["perplexity"] for r in quality_lm.perplexities(docs.select("doc_id", "text", "lang"), trusted, trusted.count()).collect()}
    enc = packing.WordEncoder(packing.vocabulary_path())
    size = enc.tok.get_vocab_size()
    ids = {r["doc_id"]: enc.tok.encode(r["text"], add_special_tokens=False).ids for r in docs.collect()}
    train = {r["doc_id"] for r in trusted.where(~quality_lm.left_out()).collect()}
    c = Counter((v, w) for d in train if d in ids for v, w in zip([size, *ids[d]], ids[d]))
    total, cc = Counter(), Counter()
    for (v, w), n in c.items():
        total[v] += n
        cc[w] += 1

    def three(counts):
        n = [sum(x == k for x in counts) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        return [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k - 0.05) for k in (1, 2, 3)]

    d, e = three(c.values()), three(cc.values())
    left = Counter()
    for (v, _), n in c.items():
        left[v] += d[min(n, 3) - 1]
    low = sum(e[min(n, 3) - 1] for n in cc.values()) / sum(cc.values()) / size
    one = lambda w: max(cc[w] - e[min(cc[w], 3) - 1], 0) / sum(cc.values()) + low if cc[w] else low

    def p(v, w):
        seen = max(c[v, w] - d[min(c[v, w], 3) - 1], 0) / total[v] if c[v, w] else 0
        return seen + (left[v] / total[v] if total[v] else 1) * one(w)

    for i in list(ids)[:40]:
        want = math.exp(-sum(math.log(p(v, w)) for v, w in zip([size, *ids[i]], ids[i])) / len(ids[i]))
        assert abs(got[i] - want) <= 1e-6 * want
    assert abs(sum(p(5, w) for w in range(size)) - 1) < 1e-6


def test_quality_lm_thresholds(spark, small):
    """Each language's threshold is the quantile of its left-out trusted documents, and decides what is kept."""
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_lm.quality_lm(docs, labels, 0.9).collect()
    apart = {r["doc_id"] for r in quality_lm.trusted_ids(labels).where(quality_lm.left_out()).collect()}
    seen = {}
    for r in rows:
        if r["doc_id"] in apart and r["perplexity"] is not None:
            seen.setdefault(r["lang"], []).append(r["perplexity"])
    quantile = lambda x: sorted(x)[max(0, math.ceil(0.9 * len(x)) - 1)]
    every = quantile([p for x in seen.values() for p in x])
    for r in rows:
        limit = quantile(seen[r["lang"]]) if r["lang"] in seen else every
        assert abs(r["threshold"] - limit) < 1e-9 and r["kept"] == (r["perplexity"] is not None and r["perplexity"] <= limit)


def test_quality_lm_edges(spark, small, docs):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    none = quality_lm.quality_lm(docs, labels.where("false"))
    assert none.count() == len(CASES) and none.where("NOT kept").count() == 3
    some = quality_lm.quality_lm(docs, spark.createDataFrame([(1, 1, 0), (9, 1, 0)], "doc_id long, quality int, toxic int"))
    assert some.count() == len(CASES) and some.where("kept AND n_tokens = 0").count() == 0


# -- 6 language


def test_language(spark, small, docs):
    got = language_id.op6_language_id(spark, small).join(spark.read.parquet(f"{small}/documents.parquet"), "doc_id").where("held_out")
    assert got.where("lang_pred = lang").count() >= 0.95 * got.count()
    pieces = language_id.vocabulary()
    probs = language_id.train(docs.where("text IS NOT NULL").select("text", "lang"), pieces)
    rows = {r["doc_id"]: r for r in language_id.predict(docs, probs, pieces).collect()}
    assert rows[4]["lang_pred"] == rows[5]["lang_pred"] == rows[15]["lang_pred"] == "und" and rows[1]["lang_pred"] == "en"
    assert language_id.predict(docs, {}, pieces).where("lang_pred <> 'und'").count() == 0


def test_forward_sums_all_segmentations():
    pieces = ["", "a", "b", "ab", "aba", "ba"]
    p = np.array([0.01, 0.2, 0.1, 0.3, 0.05, 0.15])
    find = language_id.Pieces(pieces)

    def brute(word):
        if not word:
            return 1.0
        first = p[pieces.index(word[0])] if word[0] in pieces else p[0]
        return first * brute(word[1:]) + sum(p[k] * brute(word[len(x) :]) for k, x in enumerate(pieces) if len(x) > 1 and word.startswith(x))

    words = ["abab", "a", "abaxab", "bbaab", "aba" * 9]
    assert np.allclose(language_id.log_scores(p, find, words), [math.log(brute(w)) for w in words])
    both = np.stack([p, p[::-1].copy()], 1)
    assert np.allclose(language_id.log_scores(both, find, words)[:, 0], language_id.log_scores(p, find, words))
    e, likely = language_id.expected(p, find, ["ab"], np.array([2.0]))
    both, one = p[1] * p[2], p[3]
    assert np.allclose(e[[1, 2, 3]], [2 * both / (both + one), 2 * both / (both + one), 2 * one / (both + one)])
    assert np.isclose(likely, 2 * math.log(both + one))


def log_space(word, names, p):
    """Log probability, and expected counts, by a plain recursion over logarithms in Python."""
    n, big = len(word), max(map(len, names))
    steps = [[] for _ in range(n)]
    for i in range(n):
        known = [(k, names.index(word[i : i + k])) for k in range(1, min(big, n - i) + 1) if word[i : i + k] in names[1:]]
        steps[i] = known if any(k == 1 for k, _ in known) else [(1, 0), *known]
    add = lambda xs: max(xs) + math.log(sum(math.exp(x - max(xs)) for x in xs)) if xs else -math.inf
    fore, back = [[] for _ in range(n + 1)], [0.0] * (n + 1)
    a = [0.0] + [None] * n
    for i in range(n):
        if i:
            a[i] = add(fore[i])
        for k, x in steps[i]:
            fore[i + k].append(a[i] + math.log(p[x]))
    a[n] = add(fore[n])
    for i in range(n - 1, -1, -1):
        back[i] = add([math.log(p[x]) + back[i + k] for k, x in steps[i]])
    e = np.zeros(len(names))
    for i in range(n):
        for k, x in steps[i]:
            e[x] += math.exp(a[i] + math.log(p[x]) + back[i + k] - a[n])
    return a[n], e


@pytest.mark.parametrize("step", [16, 2048])
def test_long_words_and_small_probabilities_do_not_underflow(monkeypatch, step):
    monkeypatch.setattr(language_id, "STEP", step)
    names = ["", "a", "b", "ab", "aba", "bb", "abababababababab"]
    p = np.array([1e-14, 1e-11, 1e-12, 1e-9, 1e-10, 1e-12, 1e-13])
    rng = np.random.default_rng(4)
    words = ["ab" * 400, "x" * 700, *("".join(rng.choice(list("abx"), int(n))) for n in rng.integers(1, 200, 40))]
    find = language_id.Pieces(names)
    want = [log_space(w, names, p) for w in words]
    assert np.allclose(language_id.log_scores(p, find, words), [x for x, _ in want])
    weight = rng.integers(1, 5, len(words)).astype(float)
    e, likely = language_id.expected(p, find, words, weight)
    assert np.allclose(e, sum(c * x for c, (_, x) in zip(weight, want))) and np.isclose(likely, sum(c * x for c, (x, _) in zip(weight, want)))
    # two languages that differ in one small probability are told apart by a word of any length
    q = p.copy()
    q[1] *= 2
    both = language_id.log_scores(np.stack([p, q], 1), find, ["a" * 31, "a" * 5000])
    assert (both[:, 1] > both[:, 0]).all()


# -- 7 packing


def test_packing(docs):
    rows = packing.pack_documents(docs).collect()
    tok = packing.WordEncoder(packing.vocabulary_path()).tok
    want = Counter()
    for i, t in CASES:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for k in range(0, len(ids), 4096):
            want[i, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(ids[k : k + 4096].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 4096
    assert len(bins) == -(-sum(r["length"] for r in rows) // 4096)
    assert packing.pack_documents(empty(docs)).count() == 0


def test_packing_without_broadcast(docs, monkeypatch):
    monkeypatch.setattr(packing, "BROADCAST_BYTES", 0)
    rows = packing.pack(settle(packing.token_pieces(docs), "p")).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows) >= len(CASES)


def test_search_takes_every_underfull_bin():
    """Best fit leaves about 8,700 of these bins underfull, and the emptiest 512 alone hold nothing to gain."""
    classes = {1200 + k: 75 for k in range(400)}
    got = packing.plan_packing(classes)
    held = Counter()
    for pattern, bins in got:
        assert bins > 0 and sum(pattern) <= packing.SIZE
        for x in pattern:
            held[x] += bins
    assert held == classes
    assert sum(n for _, n in got) < 0.96 * sum(n for _, n in packing.best_fit(classes, packing.SIZE))


# -- 8 substring dedup


def brute_removed(cases, size=20):
    rows = sorted(((i, words_of(t)) for i, t in cases if i is not None), key=lambda r: r[0])
    first = {}
    for i, w in rows:
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            first[key] = min(first.get(key, (i, k)), (i, k))
    out = []
    for i, w in rows:
        gone = set()
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < (i, k):
                gone |= set(range(k, k + size))
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()))
    return sorted(out, key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_substring_dedup(docs, limit):
    got = substring_dedup.substring_dedup(docs, broadcast_bytes=limit).where("doc_id IS NOT NULL")
    assert table(got, "doc_id", "n_words", "n_removed", "kept_sha256") == brute_removed(CASES)
    assert substring_dedup.substring_dedup(empty(docs)).count() == 0


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_substring_repeated_ids(spark, limit):
    """Rows of one id lose their own words only, and none of another document's."""
    passage, filler, other = (" ".join(f"{c}{i}" for i in range(30)) for c in "pfo")
    cases = [(1, passage), (14, f"{filler} {passage}"), (14, "one two"), (14, f"{passage} tail"), (15, other), (16, f"{other} {filler}")]
    got = substring_dedup.substring_dedup(spark.createDataFrame(cases, "doc_id long, text string"), with_text=True, broadcast_bytes=limit)
    assert table(got, "doc_id", "n_removed", "kept_text") == sorted([(1, 0, passage), (14, 30, filler), (14, 0, "one two"), (14, 30, "tail"), (15, 0, other), (16, 60, "")], key=lambda r: tuple(map(str, r)))


def test_matching_spans(spark):
    rng = np.random.default_rng(5)
    reference = [" ".join(rng.choice(["a", "b", "c"], 60)) for _ in range(4)]
    docs = [" ".join([*rng.choice(["a", "b", "c"], 20), *reference[k % 4].split()[5:40], *rng.choice(["x", "y"], 30)]) for k in range(8)] + [None, ""]
    got = {r["doc_id"]: (r["n_removed"], r["kept_text"]) for r in substring_dedup.matching_spans(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), reference, 12, 100).collect()}
    held = {tuple(t.split()[i : i + 12]) for t in reference for i in range(49)}
    for d, text in enumerate(docs):
        w = words_of(text)
        gone = {j for i in range(len(w) - 11) if tuple(w[i : i + 12]) in held for j in range(i, i + 12)}
        assert got[d] == (len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))


# -- 9 WARC


def test_warc(spark, tmp_path):
    big = "x\r\n\r\nWARC/1.1\r\n" * 100
    cases = [(1, "http://a.example.test/\r\nX: y", big), (2, None, big), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (None, "n", big), (6, "é", "é" * 600), (7, "é", "é" * 600)]
    pages = spark.createDataFrame(cases, "page_id long, url string, html string").withColumn("digest", F.lit(0))
    records, folder = warc.dedup_pages(pages)
    got = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"], r["digest"]) for r in records.collect()}
    data = {i: (h or "").encode() for i, _, h in cases}
    refers = {1: 2, None: 2, 6: 7}
    assert got == {i: ("revisit" if i in refers else "response", refers.get(i), len(data[i]), hashlib.sha1(data[i]).hexdigest()) for i, _, _ in cases}
    full = warc.read_archives(spark, folder, with_payload=True).where("record_type = 'response'").collect()
    assert {r["page_id"]: bytes(r["payload"]) for r in full} == {i: d for i, d in data.items() if i not in refers}
    assert warc.dedup_pages(pages.where("false"))[0].count() == 0


def test_warc_files_are_bounded(spark, tmp_path):
    """Small records by the thousand, some larger ones, and one that is larger than a file may be."""
    cases = [(i, f"u{i}", "s" * 900) for i in range(300)] + [(1000 + i, "u", f"{i}" + "m" * 30_000) for i in range(20)] + [(2000, "u", "l" * 400_000)] * 2
    records = warc.pages_to_records(spark.createDataFrame(cases, "page_id long, url string, html string").coalesce(1))
    orders = warc.write_archives(records, str(tmp_path / "a"), F.lit("response"), "2026-01-01T00:00:00Z", compression="none", file_bytes=256 << 10)
    sizes = {o: [p.stat().st_size for p in (tmp_path / f"a/size-{o}").glob("part-*")] for o in orders}
    assert orders == [0, 1, 2] and max(sizes[0] + sizes[1]) <= 256 << 10 and len(sizes[2]) == 2 and max(sizes[2]) < 402_000
    assert warc.read_archives(spark, str(tmp_path / "a")).count() == len(cases)


# -- 10 mixing


def test_mixing(spark, small, docs):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    got = mixing.mix(spark.read.parquet(f"{small}/documents.parquet"), labels)
    have, fit = (got.agg(*(F.sum(F.col("n_tokens") * F.col(f"p_{d}") * r).alias(d) for d in mixing.DOMAINS)).first().asDict() for r in (F.lit(1), F.col("rate")))
    whole = have["clean"] / mixing.TARGETS["clean"]
    for d in mixing.DOMAINS:
        assert abs(fit[d] - whole * mixing.TARGETS[d]) <= 2e-3 * whole or fit[d] < whole * mixing.TARGETS[d] and fit[d] >= 0.9 * mixing.MOST * have[d]
    assert got.where("rate < 0 OR copies < 0").count() == 0
    none = mixing.mix(docs, labels.where("false"))
    assert none.count() == len(CASES) and none.where("rate <> 1 OR copies <> 1").count() == 0


def test_mixing_scores_edges(spark, small):
    rows, labels = edge_rows(spark, small), spark.read.parquet(f"{small}/labels.parquet")
    got = mixing.mix(rows, labels).collect()
    assert len(got) == rows.count()
    tok = packing.WordEncoder(packing.vocabulary_path()).tok
    want = Counter((None if i is None else i + 10**6, len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t in CASES)
    assert Counter((r["doc_id"], r["n_tokens"]) for r in got if r["doc_id"] is None or r["doc_id"] >= 10**6) == want
    assert all(abs(sum(r[f"p_{d}"] for d in mixing.DOMAINS) - 1) < 1e-9 and 0 <= r["rate"] <= mixing.MOST for r in got)
    twice = [r for r in got if r["doc_id"] == 10**6 + 14]
    assert twice[0] == twice[1]


def test_rates_are_least_squares():
    """The conditions that only a least squares solution within the bounds meets, for targets within reach and beyond it."""
    rng = np.random.default_rng(2)
    for k, wanted in enumerate(([1.0, 0.3, 0.1], [1.0, 30.0, 0.2], [0.2, 2.0, 9.0], [1.0, 1.0, 1.0])):
        p, n = rng.dirichlet([5, 0.1, 0.05], 200), rng.integers(0, 100, 200)
        mass = n[:, None] * p
        targets = mass.sum(0) * wanted
        r = mixing.fit_rates(mass, targets)
        g = (p @ (r @ mass - targets) * n.sum() / targets.sum() ** 2 + mixing.RIDGE * (r - 1))[n > 0]
        free, low, high = (r[n > 0] > 0) & (r[n > 0] < mixing.MOST), r[n > 0] == 0, r[n > 0] == mixing.MOST
        assert (r >= 0).all() and (r <= mixing.MOST).all()
        assert np.abs(g[free]).max(initial=0) < 1e-5 and (g[low] > -1e-5).all() and (g[high] < 1e-5).all(), k
        if k in (0, 3):
            assert np.abs(r @ mass - targets).max() < 5e-3 * targets.sum()  # what the ridge costs


def test_short_domains_are_raised(spark, small):
    """Shares above what a domain has are met; what rates of up to ``most`` cannot reach is reported."""
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    shares = {"clean": 0.84, "low_quality": 0.07, "toxic": 0.09}
    got = mixing.mix(docs, labels, shares)
    have, fit = (got.agg(*(F.sum(F.col("n_tokens") * F.col(f"p_{d}") * r).alias(d) for d in mixing.DOMAINS)).first().asDict() for r in (F.lit(1), F.col("rate")))
    whole = have["clean"] / shares["clean"]
    assert have["toxic"] < shares["toxic"] * whole - 2e-3 * whole
    for d in mixing.DOMAINS:
        assert abs(fit[d] - shares[d] * whole) <= 2e-3 * whole
    with pytest.warns(UserWarning, match="miss their targets"):
        mixing.mix(docs, labels, {"clean": 0.1, "low_quality": 0.45, "toxic": 0.45})


def test_mixing_stage_follows_copies(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    rows = mixing.mix(docs, labels).collect()
    assert all(r["copies"] == math.floor(r["rate"] + (r["salt"] % (1 << 20)) / (1 << 20)) for r in rows)
    want = {r["doc_id"]: r["copies"] for r in rows if r["copies"]}
    assert Counter(r["doc_id"] for r in corpus_pipeline.mixing(spark, docs, small).collect()) == want


# -- pipeline


def test_pipeline_stages(spark, small):
    """Every stage against what its operator, or brute force, says of its own input."""
    rows = spark.read.parquet(f"{small}/documents.parquet")
    columns = rows.columns
    for name, stage in corpus_pipeline.STAGES:
        out = settle(stage(spark, rows, small), name)
        before = {r["doc_id"]: r["text"] for r in rows.collect()}
        ids = [r["doc_id"] for r in out.collect()]
        if name == "quality_rules":
            assert set(ids) <= {i for i, t in before.items() if not (brute_counts(t)[0] < 20 or 100 * brute_counts(t)[4] > 30 * brute_counts(t)[0])}
        elif name == "exact_dedup":
            norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t)
            assert len(ids) == len(set(ids)) == len({norm(t) for t in before.values()}) == len({norm(before[i]) for i in ids})
        elif name == "near_dedup":
            _, up = brute_components(list(before.items()))
            assert sorted(ids) == sorted(i for i in up if up[i] == i)
        elif name == "mixing":
            assert set(ids) <= set(before)
        else:
            assert set(ids) == set(before)
        if name != "packing":
            assert out.columns == columns
        rows = out


def test_pipeline_stages_bound_batches(spark, small):
    """Each stage by itself bounds the Arrow batches of a session with Spark's defaults, and leaves other values alone."""
    rows = spark.read.parquet(f"{small}/documents.parquet")
    rows_key, bytes_key = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    before = {k: spark.conf.get(k) for k in (rows_key, bytes_key)}
    try:
        for _, stage in corpus_pipeline.STAGES:
            spark.conf.unset(rows_key)
            spark.conf.unset(bytes_key)
            stage(spark, rows, small)
            assert (spark.conf.get(rows_key), spark.conf.get(bytes_key)) == ("1000", "8m")
        spark.conf.set(rows_key, "77")
        corpus_pipeline.STAGES[0][1](spark, rows, small)
        assert spark.conf.get(rows_key) == "77"
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_pipeline_edges(spark, docs, small):
    rows = docs
    for name, stage in corpus_pipeline.STAGES:
        before, rows = rows, settle(stage(spark, rows, small), name)
        if name == "near_dedup":
            left = [r["doc_id"] for r in rows.collect()]
            assert len(left) == len(set(left)) and None not in left
        if name != "packing":
            assert rows.columns == docs.columns
    assert {r["doc_id"] for r in rows.collect()} == {r["doc_id"] for r in before.collect()}
    # every stage on rows that no stage before it has cleaned
    for name, stage in corpus_pipeline.STAGES:
        out = settle(stage(spark, docs, small), name)
        assert {r["doc_id"] for r in out.collect()} <= {i for i, _ in CASES}
        assert name == "packing" or out.columns == docs.columns
    nothing = empty(docs)
    for name, stage in corpus_pipeline.STAGES:
        nothing = settle(stage(spark, nothing, small), name)
    assert nothing.count() == 0


def test_pipeline_keeps_clean_rows_of_null_or_repeated_ids(spark, small):
    """Only rows that are rejected themselves go: junk, the later of equal texts, the later of near copies."""
    plain = [r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect()]
    one, two, three, four = [t for t in plain if brute_counts(t)[0] >= 40 and 100 * brute_counts(t)[4] <= 5 * brute_counts(t)[0]][:4]
    cases = [(1, one), (1, "junk"), (2, two), (2, three), (2, two), (3, three), (None, four), (None, "junk"), (4, one)]
    rows = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in cases], DOCS)
    filler = spark.read.parquet(f"{small}/documents.parquet").where(~F.col("text").isin(one, two, three, four)).select(F.col("doc_id") + 1000, "text", "lang", "source", "n_chars").toDF(*rows.columns)
    out = rows.union(filler)
    left = lambda df: Counter((r["doc_id"], r["text"]) for r in df.collect() if r["doc_id"] is None or r["doc_id"] < 1000)
    out = settle(corpus_pipeline.quality(spark, out, small), "quality")
    assert left(out) == Counter((i, t) for i, t in cases if t != "junk")
    out = settle(corpus_pipeline.exact(spark, out, small), "exact")
    assert left(out) == Counter([(1, one), (2, two), (2, three), (None, four)])
    assert left(corpus_pipeline.near(spark, rows.where("text <> 'junk'"), small)) == Counter([(1, one), (2, two), (2, three), (None, four)])
