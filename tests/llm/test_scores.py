import zlib

import numpy as np
import pytest

from vouchlake.llm import quality, toxicity
from vouchlake.llm.pu import best_bin, estimate_prior, fit_nnpu, sigmoid
from vouchlake.llm.queries import queries


@pytest.mark.parametrize(("name", "label", "modulus", "held_out", "threshold", "least"), [("op10_quality", "quality", 4, 2, 0.7, 0.95), ("op4_toxicity", "toxic", 5, 0, 0.5, 0.92)])
def test_held_out_accuracy(spark, sf_medium, name, label, modulus, held_out, threshold, least):
    rows = queries()[name](spark, sf_medium).collect()
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf_medium}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{sf_medium}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == held_out)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold)
    judged = [r for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in judged]) >= least


def test_toxic_documents_are_found(spark, sf_medium):
    """Always 0 would be right for nine of ten documents, so what counts is how many toxic ones are found and how many clean ones aren't."""
    for sf_dir, recall, precision in ((sf_medium, 0.6, 0.6), (sf_medium.replace("0.01", "0.1"), 0.9, 0.8)):
        labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
        rows = [r for r in queries()["op4_toxicity"](spark, sf_dir).collect() if r.held_out and r.doc_id in labels]
        found = sum(r.predicted and labels[r.doc_id] for r in rows)
        assert found >= recall * sum(labels[r.doc_id] for r in rows) and found >= precision * sum(r.predicted for r in rows)


@pytest.mark.parametrize("module", [quality, toxicity])
def test_scores_equal_a_plain_loop(spark, sf_small, odd_docs, no_docs, module):
    docs, labels = spark.read.parquet(f"{sf_small}/documents.parquet"), spark.read.parquet(f"{sf_small}/labels.parquet")
    model = module.fit(docs, labels)
    for df in (docs, odd_docs):
        texts = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        plain = sorted((str(i), round(float(model.scores([t])[0]), 9)) for i, t in texts)
        assert sorted((str(r.doc_id), round(r.score, 9)) for r in module.score(df, model).collect()) == plain
    keep = module.keep_good if module is quality else module.keep_clean
    kept = keep(odd_docs, model)
    assert kept.schema == odd_docs.schema
    passes = lambda s: s >= 0.7 if module is quality else s < 0.5
    assert kept.count() == sum(passes(float(model.scores([r.text])[0])) for r in odd_docs.collect())
    assert module.score(no_docs, model).count() == keep(no_docs, model).count() == 0


@pytest.mark.parametrize("module", [quality, toxicity])
def test_fits_without_labels_and_without_documents(spark, odd_docs, no_docs, module):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(1, 1, 1), (1, 0, 0), (None, 1, 1), (2, None, None), (7, 5, 5)], "doc_id long, quality int, toxic int")
    for docs, labels in ((odd_docs, none), (no_docs, none), (odd_docs, odd)):
        scores = [r.score for r in module.score(odd_docs, module.fit(docs, labels)).collect()]
        assert len(scores) == odd_docs.count() and all(0 <= s <= 1 for s in scores)


def test_labels_of_held_out_rows_are_not_learnt(spark, sf_small):
    docs, labels = spark.read.parquet(f"{sf_small}/documents.parquet"), spark.read.parquet(f"{sf_small}/labels.parquet")
    from pyspark.sql import functions as F

    from vouchlake.llm.samples import remainder

    flipped = labels.withColumn("toxic", F.when(remainder(F.col("doc_id"), 5) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, flipped)
    assert a.vocabulary == b.vocabulary and np.allclose(a.scorer.weights, b.scorer.weights)


def test_nnpu_finds_the_border_that_full_labels_would():
    rng = np.random.default_rng(0)
    prior = 0.3
    pos, neg = rng.normal(2, 1, (3000, 2)), rng.normal(-2, 1, (7000, 2))
    model = fit_nnpu(pos[:1000], np.vstack([pos[1000:], neg[: round(2000 * (1 - prior) / prior)]]), prior)
    assert model.scores(rng.normal(2, 1, (1000, 2))).mean() > 0.9 and model.scores(rng.normal(-2, 1, (1000, 2))).mean() < 0.1
    assert sigmoid(np.array([0.0]))[0] == 0.5


def test_toxic_words_are_learnt_at_a_high_share(spark):
    rng = np.random.default_rng(5)
    plain, bad, shared = ([f"{stem}{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(n)] for stem, n in (("m", 300), ("q", 20), ("z", 20)))
    toxic = {k: k % 5 < 2 for k in range(2000)}
    rows = []
    for k, t in toxic.items():
        words = [*rng.choice(plain, 20), *rng.choice(shared, 4 if t else 1)]
        rows.append((k, " ".join([*words, *rng.choice(bad, 3)] if t else words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(t)) for k, t in toxic.items()], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert set(bad) <= set(model.vocabulary)
    assert not set(plain) & set(model.vocabulary)
    scores = model.scores([text for _, text in rows])
    assert np.mean((scores >= 0.5) == np.array(list(toxic.values()))) > 0.97


def plain_toxicity(model, text):
    """The score, written anew: a word's beginnings and the word, each at most once."""
    import math
    import re

    held = set()
    for w in re.findall(r"[^\W\d_]+", (text or "").lower()):
        held |= {w} | {w[:k] + "*" for k in range(3, 9) if len(w) >= k}
    z = model.scorer.bias + sum(model.scorer.weights[k] for f, k in model.vocabulary.items() if f in held)
    return 1 / (1 + math.exp(-max(-35, min(35, z))))


def plain_quality(model, text):
    """The score, written anew with Python's own counting."""
    import math

    text = text or ""
    raw, words, lines = text.encode(), text.split(), text.split("\n")
    groups = ["|", "*#$%&@^~`", "!?", ".,;:", "<>{}[]()=/\\_+-", "'\"", "0123456789", " ", "\n\r\t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"]
    f = [sum(raw.count(c) for c in g.encode()) / len(raw) if raw else 0.0 for g in groups]
    f += [sum(b >= 128 for b in raw) / len(raw), sum(b < 32 for b in raw) / len(raw)] if raw else [0.0, 0.0]
    if words:
        n, d = len(words), len(set(words))
        f += [math.log(1 + n), len(text) / n, d / n, math.log(d) / math.log(n) if n > 1 else 1.0, sum(a == b for a, b in zip(words, words[1:])) / n]
        f += [sum(w.isupper() for w in words) / n, sum(w.isalpha() for w in words) / n, len(set(lines)) / len(lines), n / len(lines)]
    else:
        f += [0.0] * 9
    at, z = 0, model.scorer.bias
    for value, edges in zip(f, model.edges):
        z += sum(model.scorer.weights[at + k] for k, e in enumerate(edges) if value > e)
        at += len(edges)
    return 1 / (1 + math.exp(-max(-35, min(35, z))))


@pytest.mark.parametrize(("module", "plain"), [(quality, plain_quality), (toxicity, plain_toxicity)])
def test_scores_equal_a_scorer_written_anew(spark, sf_small, odd_docs, module, plain):
    docs, labels = spark.read.parquet(f"{sf_small}/documents.parquet"), spark.read.parquet(f"{sf_small}/labels.parquet")
    model = module.fit(docs, labels)
    for df in (docs, odd_docs):
        texts = {(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()}
        want = sorted((str(i), round(plain(model, t), 4)) for i, t in texts)
        assert [x for x, _ in want] == sorted({str(r.doc_id) for r in module.score(df, model).collect()}) or df is odd_docs
        got = {(str(r.doc_id), round(r.score, 4)) for r in module.score(df, model).collect()}
        assert all(any(i == j and abs(x - y) < 2e-4 for j, y in got) for i, x in want)


def test_nnpu_steps_equal_plain_loops():
    """Three steps, row by row, from the risk's definition; with a prior that drives the bracket below zero, too."""
    import math

    rng = np.random.default_rng(2)
    p, u = rng.integers(0, 2, (7, 3)).astype(float), rng.integers(0, 2, (9, 3)).astype(float)
    sig = lambda z: 1 / (1 + math.exp(-z))
    for prior in (0.2, 0.95):
        w = [0.0, 0.0, 0.0, math.log(prior / (1 - prior))]
        m, v = [0.0] * 4, [0.0] * 4
        for step in (1, 2, 3):
            z = lambda x: sum(a * b for a, b in zip(w, [*x, 1.0]))
            mean = lambda rows, f: [sum(f(z(x)) * [*x, 1.0][k] for x in rows) / len(rows) for k in range(4)]
            pos = [prior * g for g in mean(p, lambda t: sig(t) - 1)]
            neg = [a - prior * b for a, b in zip(mean(u, sig), mean(p, sig))]
            bracket = sum(math.log(1 + math.exp(z(x))) for x in u) / len(u) - prior * sum(math.log(1 + math.exp(z(x))) for x in p) / len(p)
            grad = [a + b for a, b in zip(pos, neg)] if bracket >= 0 else [-b for b in neg]
            grad = [g + 1e-4 * (w[k] if k < 3 else 0) for k, g in enumerate(grad)]
            m, v = [0.9 * a + 0.1 * g for a, g in zip(m, grad)], [0.999 * a + 0.001 * g * g for a, g in zip(v, grad)]
            w = [a - 0.05 * (b / (1 - 0.9**step)) / (math.sqrt(c / (1 - 0.999**step)) + 1e-8) for a, b, c in zip(w, m, v)]
        got = fit_nnpu(p, u, prior, steps=3)
        assert np.allclose([*got.weights, got.bias], w, atol=1e-4)


@pytest.mark.parametrize("share", [0.02, 0.1, 0.3, 0.6, 0.9])
def test_the_prior_is_found_without_negatives(share):
    rng = np.random.default_rng(int(100 * share))
    n = round(6000 * share)
    draw = lambda at, k: (rng.random((k, 12)) < at).astype(float)
    high, low = np.linspace(0.3, 0.8, 12), np.linspace(0.05, 0.2, 12)
    pos, mixed = draw(high, 2000), rng.permutation(np.vstack([draw(high, n), draw(low, 6000 - n)]))
    assert abs(estimate_prior(pos, mixed, 0.5, steps=150, rate=0.1) - share) < 0.06
    assert best_bin(np.array([1.0, 1.0]), np.array([1.0, 0.0])) == 0.5


@pytest.mark.parametrize(("name", "label", "threshold"), [("quality", "quality", 0.7), ("toxicity", "toxic", 0.5)])
def test_labels_that_are_all_positive(spark, sf_medium, name, label, threshold):
    """What positive-unlabelled learning is for: the labels say 1 or nothing."""
    from pyspark.sql import functions as F

    from vouchlake.llm.samples import remainder

    module = {"quality": quality, "toxicity": toxicity}[name]
    docs, labels = spark.read.parquet(f"{sf_medium}/documents.parquet"), spark.read.parquet(f"{sf_medium}/labels.parquet")
    model = module.fit(docs, labels.where(F.col(label) == 1))
    held = docs.where(remainder(F.col("doc_id"), module.MODULUS) == module.HELD_OUT)
    rows = module.score(held, model).join(labels, "doc_id").collect()
    assert np.mean([(r.score >= threshold) == (r[label] == 1) for r in rows]) >= 0.9


def test_the_sample_bounds_rows_not_ids(spark):
    from vouchlake.llm.samples import training_sample

    docs = spark.range(5000).selectExpr("1L AS doc_id", "concat('text ', id) AS text").unionByName(spark.range(500).selectExpr("7L AS doc_id", "'same' AS text"))
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    rows = training_sample(docs, labels, "toxic", 5, 0, 10, 20).collect()
    assert sum(r.is_positive for r in rows) == 10 and sum(not r.is_positive for r in rows) == 20


def test_statistics_cover_all_rows(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    texts = [r.text for r in docs.select("text").collect()]
    counts, n = toxicity.corpus_counts(docs.repartition(5), ["the", "th*", "never seen"])
    words = [set(t.lower().replace("\n", " ").split(" ")) for t in texts]
    assert n == len(texts) and counts[2] == 0 and counts[0] >= sum("the" in w for w in words)
    dense = quality.feature_matrix(texts)
    edges = quality.corpus_edges(docs.repartition(5))
    for k, e in enumerate(edges):
        exact = np.unique(np.quantile(dense[:, k], quality.QUANTILES, method="inverted_cdf"))
        assert all(np.min(np.abs(exact - x)) <= 0.005 * max(x, 1e-9) + 1e-9 for x in e)
