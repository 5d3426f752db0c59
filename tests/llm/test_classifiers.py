import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import quality, toxicity
from siltstone.llm.descent import minimise
from siltstone.runtime import table

SF = "/root/testdata/sf0.01"


def judged(spark, module, label):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = module.train(docs, labels)
    rows = module.score(docs, model).collect()
    truth = {r.doc_id: r[label] for r in labels.collect()}
    assert len(rows) == docs.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= module.THRESHOLD)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    return model, np.array([r.score for r in held]), np.array([truth[r.doc_id] for r in held]), np.array([r.predicted for r in held])


def auc(score, y):
    return (score[y == 1][:, None] > score[y == 0][None, :]).mean() + 0.5 * (score[y == 1][:, None] == score[y == 0][None, :]).mean()


def test_toxicity_on_held_out(spark):
    model, score, y, predicted = judged(spark, toxicity, "toxic")
    assert auc(score, y) > 0.9 and (predicted == y).mean() > 0.93
    assert 0 <= model.score(None) == model.score(b"") <= 1
    clean = "The tion of and the heat. " * 400
    assert model.score(clean.encode()) < 0.5


def test_long_texts_are_hashed_in_parts(monkeypatch):
    text = ("The tion of an IDIOT é日 " * 30).encode()
    whole = np.sort(toxicity.ngrams(text))
    assert len(set(whole.tolist())) == len(whole)
    for size in (7, 100):
        monkeypatch.setattr(toxicity, "_AT_ONCE", size)
        assert np.array_equal(np.sort(toxicity.ngrams(text)), whole)
    used = np.zeros(1 << toxicity.BITS, bool)
    used[whole[::3]] = True
    assert np.array_equal(np.sort(toxicity.ngrams(text, used)), whole[::3])


def slow_grams(text):
    """From the definition, in plain integers."""
    points, out = [ord(c) for c in text.lower()], set()
    for n in (3, 4, 5):
        for at in range(len(points) - n + 1):
            h = n
            for p in points[at : at + n]:
                h = (h + p) * 0x9E3779B97F4A7C15 % (1 << 64)
            out.add(h >> 64 - toxicity.BITS)
    return out


def test_toxicity_against_brute_force(spark):
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdeé"), 4))
    rows = []
    for k in range(300):
        words = [word() for _ in range(rng.integers(3, 30))]
        rows.append((k, " ".join(words + ["vile nasty"] * int(k % 4 == 0 and rng.random() < 0.9)), int(k % 4 == 0)))
    docs, labels = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string"), spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    fitted = [(slow_grams(t), y) for k, t, y in rows if zlib.crc32(str(k).encode()) % 5]
    grams = sorted(set().union(*(g for g, _ in fitted)))
    of = [sum(1 for _, y in fitted if y == label) for label in (0, 1)]
    ratio = {}
    for g in grams:
        n0, n1 = (sum(1 for held, y in fitted if y == label and g in held) for label in (0, 1))
        p, q = (n1 + 1) / (of[1] + 2), (n0 + 1) / (of[0] + 2)
        if abs(np.log(p / q)) >= 4 * np.sqrt((1 - p) / (n1 + 1) + (1 - q) / (n0 + 1)):
            ratio[g] = np.log(p / q)
    assert np.flatnonzero(model.used).tolist() == sorted(ratio) and len(ratio) > 5
    used = sorted(ratio)
    x = np.array([[ratio[g] if g in held else 0.0 for g in used] for held, _ in fitted])
    y = np.array([y for _, y in fitted], float)
    w, b = model.weights[used].astype(float) / [ratio[g] for g in used], model.bias
    off = 1 / (1 + np.exp(-(x @ w + b))) - y
    assert np.abs(x.T @ off / len(y) + 1e-3 * w).max() < 2e-4 and abs(off.mean()) < 2e-4
    for k, t, _ in rows[::29]:
        z = b + sum(float(model.weights[g]) for g in slow_grams(t))
        assert abs(model.score(t.encode()) - 1 / (1 + np.exp(-z))) < 1e-6


def test_all_telling_ngrams_are_features(spark):
    """However many there are: one toxic text of many words, repeated, tells them all."""
    rng = np.random.default_rng(1)
    text = " ".join("".join(rng.choice(list("abcdefghij"), 6)) for _ in range(3000))
    docs = spark.createDataFrame([(k, text if k % 2 else "z" * k) for k in range(200)], "doc_id long, text string")
    model = toxicity.train(docs, docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic"))
    assert model.used.sum() > 10_000


def test_quality_on_held_out(spark):
    model, score, y, predicted = judged(spark, quality, "quality")
    assert auc(score, y) > 0.95 and (predicted == y).mean() > 0.93
    assert 0 <= model.score(None) == model.score(b"") <= 1
    assert model.score(b"THE&&& of%%% and*** " * 100) < model.score(b"Is the erresh of lyestion, was and the. " * 50)


def mixture(rng, share, n=4000):
    positive = rng.normal(1.5, 1, (n, 4)).astype(np.float32)
    k = int(share * n)
    return positive, np.concatenate([rng.normal(1.5, 1, (k, 4)), rng.normal(-1.5, 1, (n - k, 4))]).astype(np.float32), k


@pytest.mark.parametrize("share", [0.3, 0.7, 0.9])
def test_prior_and_risk_on_a_known_mixture(share):
    positive, web, k = mixture(np.random.default_rng(2), share)
    model = quality.fit(positive, web, np.zeros(4), np.ones(4))
    assert abs(model.prior - share) < 0.06
    p = 1 / (1 + np.exp(-(web @ model.weights + model.bias)))
    assert abs(p.mean() - share) < 0.06 and ((p > 0.5) == (np.arange(len(web)) < k)).mean() > 0.97


def slow_risk(x, positive, unlabelled, prior):
    l = lambda z: float(np.log1p(np.exp(-z)))  # noqa: E731, E741
    g = lambda row: float(sum(a * b for a, b in zip(row, x[:-1])) + x[-1])
    mean = lambda xs: sum(xs) / len(xs)
    negative = mean([l(-g(r)) for r in unlabelled]) - prior * mean([l(-g(r)) for r in positive])
    return prior * mean([l(g(r)) for r in positive]) + (negative + (negative**2 + 1e-6) ** 0.5) / 2 + quality.PENALTY / 2 * sum(w * w for w in x[:-1])


def test_risk_and_its_gradient_against_brute_force():
    rng = np.random.default_rng(3)
    positive, web, _ = mixture(rng, 0.6, 40)
    clamped = 0
    for scale in (0.1, 1, 3):
        x = rng.normal(0, scale, 5)
        for prior in (0.2, 0.6, 0.95):
            value, gradient = quality.risk(x, positive, web, prior)
            assert abs(value - slow_risk(x, positive, web, prior)) < 1e-5
            clamped += value < prior * np.logaddexp(0, -(positive @ x[:-1] + x[-1])).mean() + quality.PENALTY / 2 * float(x[:-1] @ x[:-1]) + 1e-4
            for k in range(5):
                step = np.eye(5)[k] * 1e-5
                slope = (slow_risk(x + step, positive, web, prior) - slow_risk(x - step, positive, web, prior)) / 2e-5
                assert abs(slope - gradient[k]) < 1e-3
    assert clamped
    x, norm = minimise(lambda x: quality.risk(x, positive, web, 0.6), np.zeros(5))
    assert norm <= 1e-4 and all(slow_risk(x, positive, web, 0.6) <= slow_risk(x + d, positive, web, 0.6) + 1e-4 for d in rng.normal(0, 0.05, (30, 5)))


def test_moments_and_long_shapes(spark):
    texts = ["a1", "The QUICK fox, 12 times!", None, "", "a1" * 40 + "!", "a1" * 40 + "?"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select(F.col("text").cast("binary").alias("text")).repartition(3)
    x = np.stack([quality.features((t or "").encode()) for t in texts]).astype(float)
    mean, spread = quality.moments(df)
    assert np.allclose(mean, x.mean(axis=0)) and np.allclose(spread, x.std(axis=0))
    assert (x[4] != x[5]).any()  # shapes are told apart by their ends


@pytest.mark.parametrize("module", [toxicity, quality])
def test_small_and_odd_tables(spark, module):
    label = "toxic" if module is toxicity else "quality"
    docs = spark.createDataFrame([(1, None, 1, "l"), (None, "", 2, "l"), (2, "x", 3, "l"), (2, "x", 3, "l"), (3, "long text " * 20000, 4, "l")], "doc_id long, text string, y int, lang string")
    for rows in ([], [(2, 1)], [(2, 1), (3, 0), (3, None), (9, 1), (None, 1), (2, 1)], [(1, None)]):
        labels = spark.createDataFrame(rows, f"doc_id long, {label} int")
        out = module.score(docs, module.train(docs, labels)).collect()
        assert len(out) == 5 and all(0 <= r.score <= 1 for r in out)
        assert len({r.score for r in out if r.doc_id == 2}) == 1
    empty = docs.limit(0)
    assert module.score(empty, module.train(empty, spark.createDataFrame([], f"doc_id long, {label} int"))).count() == 0
    kept = toxicity.reject(docs, toxicity.Model(bias=-1.0))
    assert kept.schema == docs.schema and kept.count() == 5 and toxicity.reject(docs, toxicity.Model(bias=1.0)).count() == 0
