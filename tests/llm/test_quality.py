import itertools

import numpy as np

from veldra.llm import quality
from veldra.llm.quality import Field, document_features


def field(rng, steps):
    n = quality.OWN
    return Field(np.zeros(n), np.ones(n), rng.normal(size=3 * n + 3), steps)


def test_marginals_are_those_of_all_labellings():
    rng = np.random.default_rng(1)
    steps = np.array([[0.7, -0.2], [0.1, 0.4]])
    f = field(rng, steps)
    sizes = [1, 4, 2]
    emit = rng.normal(size=sum(sizes))
    starts = np.array([0, 1, 5])
    got = f.marginals(emit, starts)
    for start, size in zip(starts, sizes, strict=True):
        total, good = 0.0, np.zeros(size)
        for labels in itertools.product((0, 1), repeat=size):
            s = sum(emit[start + t] * y for t, y in enumerate(labels)) + sum(steps[a, b] for a, b in zip(labels, labels[1:], strict=False))
            total += np.exp(s)
            good += np.exp(s) * np.array(labels)
        assert np.allclose(got[start : start + size], good / total)


def test_gradient_of_the_latent_likelihood():
    rng = np.random.default_rng(6)
    sizes = np.array([1, 3, 7, 2, 5])
    starts = np.cumsum(sizes) - sizes
    own = rng.normal(size=(sizes.sum(), quality.OWN))
    x = quality.with_neighbours(own, starts)
    w = rng.random(sizes.sum()) + 0.1
    w /= np.repeat(np.add.reduceat(w, starts), sizes)
    y, each = np.array([1.0, 0, 1, 0, 1]), rng.random(5)
    theta = rng.normal(size=x.shape[1] + 1) * 0.3
    f = Field(np.zeros(quality.OWN), np.ones(quality.OWN), theta[:-1], np.eye(2))
    loss = lambda t: f.gradient(t, x, w, starts, y, each)[0]
    # the loss itself, from all labellings
    want = 0.0
    for k, (start, size) in enumerate(zip(starts, sizes, strict=True)):
        total = good = 0.0
        for labels in itertools.product((0, 1), repeat=int(size)):
            s = np.exp(sum(x[start + t] @ theta[:-1] * v for t, v in enumerate(labels)) + theta[-1] * sum(a == b for a, b in zip(labels, labels[1:], strict=False)))
            total += s
            good += s * (np.array(labels) @ w[start : start + size])
        want -= each[k] * np.log(good / total if y[k] else 1 - good / total)
    assert np.isclose(loss(theta), want)
    grad = f.gradient(theta, x, w, starts, y, each)[1]
    for k in [*rng.integers(0, len(theta), 12), len(theta) - 1]:
        d = np.zeros_like(theta)
        d[k] = 1e-5
        assert np.isclose(grad[k], (loss(theta + d) - loss(theta - d)) / 2e-5, rtol=1e-3, atol=1e-6)


def test_lines_of_a_document_may_differ():
    rng = np.random.default_rng(2)
    good, bad = ["Plain words of a page that reads well, all of them."] * 3, ["@@@@ 8881 ### ###"] * 3
    pages = [("\n".join([*rng.permutation(good + bad[:k])]), int(k == 0)) for k in (0, 2, 3) for _ in range(20)]
    found = [document_features(t) for t, _ in pages]
    f = Field.fit([(x, y) for (x, _), (_, y) in zip(found, pages, strict=True)], [n for _, n in found])
    one = f.score(["\n".join(good), "\n".join(bad), "\n".join(good + bad)])
    assert one[1] < one[2] < one[0] and one[0] > 0.5 > one[1]


def test_scores_against_a_slow_version(spark):
    rng = np.random.default_rng(8)
    texts = [None, "", "One line, and no more.", "a\nb\n\nb\n!!! 12", "Same\n" * 9, "x " * 40 + "\n" + "Yes. " * 7]
    labels = [(i, i % 2) for i in range(len(texts))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    given = spark.createDataFrame(labels, "doc_id long, quality int")
    f = quality.fit(docs, given)
    rng.shuffle(texts)
    for r in quality.classify(docs, given).join(docs, "doc_id").collect():
        x, n = document_features(r.text)
        emit = f.lines(x, np.array([0]))
        total = good = 0.0
        for y in itertools.product((0, 1), repeat=len(emit)):
            s = np.exp(emit @ np.array(y) + sum(f.steps[a, b] for a, b in zip(y, y[1:], strict=False)))
            total, good = total + s, good + s * (n @ np.array(y)) / n.sum()
        assert np.isclose(r.score, good / total, atol=1e-9) and r.predicted == int(r.score >= quality.GOOD)


def test_long_documents_are_several_chains():
    x, n = np.arange(600 * quality.OWN, dtype=float).reshape(600, -1), np.arange(600.0)
    out, sizes = Field.chains([(x, 1), (x[:2], 0)], [n, n[:2]])
    assert [len(a) for a, _ in out] == [256, 256, 88, 2] and np.array_equal(np.concatenate([a for a, _ in out[:3]]), x) and [len(s) for s in sizes] == [256, 256, 88, 2]


def test_fit_tells_labels_apart_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.classify(docs, labels).where("held_out").join(labels, "doc_id").toPandas()
    assert len(got) > 500
    assert ((got.predicted == got.quality).mean()) > 0.97
    assert (got[got.quality == 1].predicted == 1).mean() > 0.98


def test_labels_of_the_held_out_fold_change_nothing(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    other = labels.withColumn("quality", (1 - labels.quality)).where(quality.fold("doc_id", 5) == 0).unionByName(labels.where(quality.fold("doc_id", 5) != 0))
    a, b = (quality.classify(docs, x).orderBy("doc_id").toPandas() for x in (labels, other))
    assert a.equals(b)


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(0, 1, "x"), (3, 0, "x"), (None, 1, "x"), (4, None, "x"), (4, 7, "x")], "doc_id long, quality int, score string")
    got = quality.classify(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (0, 4)}) == 1
    assert quality.classify(none, labels).count() == 0
    # without both labels nothing is told apart and nothing rejected
    assert {r.score for r in quality.classify(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.keep_good(odd, labels.limit(0)).columns == odd.columns


def test_empty_text_is_one_line():
    x, n = document_features(None)
    assert x.shape == (1, quality.OWN) and n.tolist() == [1]
