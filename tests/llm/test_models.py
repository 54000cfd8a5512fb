"""The trained operators: held-out accuracy on the given tables, odd inputs, and their numeric steps."""

from __future__ import annotations

import tracemalloc
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from movewell.llm import language, quality, toxicity
from movewell.llm.common import table

TABLES = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, TABLES, "documents")


@pytest.fixture(scope="module")
def labels(spark):
    return table(spark, TABLES, "labels")


def test_quality_of_held_out_documents(spark, docs, labels):
    scores = quality.quality(spark, TABLES, docs)
    held = scores.join(labels, "doc_id").where("held_out").toPandas()
    assert len(held) > 50 and (held["predicted"] == held["quality"]).mean() > 0.97
    assert scores.count() == docs.count() and held["score"].between(0, 1).all()


def test_toxicity_of_held_out_documents(spark, docs, labels):
    held = toxicity.toxicity(spark, TABLES, docs).join(labels, "doc_id").where("held_out").toPandas()
    toxic = held[held["toxic"] == 1]
    assert (held[held["toxic"] == 0]["predicted"] == 0).mean() > 0.97
    assert toxic["predicted"].mean() > 0.4  # few positives to learn from at this size


def test_training_equals_a_plain_one(spark):
    """All rows are in the sample here: words counted as strings, the risk's gradient taken by differences."""
    rng = np.random.default_rng(9)
    vile, plain = ["idiotic", "clown", "stupidly"], [f"word{n}" for n in range(60)]
    rows, marks = [], []
    for n in range(400):
        toxic = n % 4 == 0
        words = [*rng.choice(plain, 12), *(rng.choice(vile, 2) if toxic else [])]
        rows.append((n, " ".join(words)))
        marks.append((n, int(toxic)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    settings = toxicity.Settings(steps=40)
    model = toxicity.train(docs.union(docs.where("doc_id = 4")), labels, settings)

    learned = [n for n, _ in rows if zlib.crc32(str(n).encode()) % 3 != 1]
    found = {n: {w for word in text.split() for w in (word, *(word[:k] + "*" for k in (4, 5, 6) if len(word) >= k))} for n, text in rows}
    positive, unlabelled = [n for n in learned if n % 4 == 0], learned
    scored = {}
    for word in set().union(*found.values()):
        p, u = (sum(word in found[n] for n in some) for some in (positive, unlabelled))
        pooled = (p + u + 1) / (len(positive) + len(unlabelled) + 2)
        scored[word] = (p / len(positive) - u / len(unlabelled)) / np.sqrt(pooled * (1 - pooled) * (1 / len(positive) + 1 / len(unlabelled)))
    chosen = sorted((w for w, z in scored.items() if z >= settings.least_z), key=lambda w: toxicity.xxhash.xxh32_intdigest(w) % toxicity.BUCKETS)
    buckets = [toxicity.xxhash.xxh32_intdigest(w) % toxicity.BUCKETS for w in chosen]
    assert sorted(set(buckets)) == model.features.tolist() and len(set(buckets)) == len(buckets) > 3

    x = {n: np.array([*(w in found[n] for w in chosen), 1.0]) for n in learned}
    prior = sum(n % 4 == 0 for n in learned) / len(learned)
    pos, unl = np.array([x[n] for n in positive]), np.array([x[n] for n in unlabelled])

    def parts(w):
        up = prior * np.mean(np.log1p(np.exp(-pos @ w)))
        return up, np.mean(np.log1p(np.exp(unl @ w))) - prior * np.mean(np.log1p(np.exp(pos @ w)))

    weights, first, second = np.append(np.zeros(len(chosen)), -1.0), 0.0, 0.0
    for step in range(1, settings.steps + 1):
        up, rest = parts(weights)
        corrected = (lambda w: sum(parts(w))) if rest >= 0 else (lambda w: -parts(w)[1])
        gradient = np.array([(corrected(weights + h) - corrected(weights - h)) / 2e-6 for h in 1e-6 * np.eye(len(weights))]) + settings.decay * weights
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        weights = weights - settings.rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    assert np.allclose(model.weights, weights, atol=1e-3)


def test_training_holds_its_sample_once_as_floats(spark):
    """The driver held the floats three times, and a Python object for each row and word."""
    known = F.array(*[F.concat(F.lit("vile"), F.pmod(F.xxhash64("doc_id", F.lit(n)), F.lit(200))) for n in range(12)])
    docs = spark.range(6000).select(F.col("id").alias("doc_id")).withColumn("toxic", (F.col("doc_id") % 3 == 0).cast("int"))
    docs = docs.withColumn("text", F.when(F.col("toxic") == 1, F.concat_ws(" ", known)).otherwise(F.concat(F.lit("plain"), F.col("doc_id").cast("string"))))
    tracemalloc.start()
    model = toxicity.train(docs, docs, toxicity.Settings(steps=2))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(model.features) > 150
    floats = 8 * 6000 * 200
    assert peak < 2 * floats + 2 * 8 * toxicity.BUCKETS


def test_toxicity_at_a_larger_size(spark):
    folder = "/root/testdata/sf0.1"
    held = toxicity.toxicity(spark, folder, table(spark, folder, "documents")).join(table(spark, folder, "labels"), "doc_id").where("held_out").toPandas()
    assert held[held["toxic"] == 1]["predicted"].mean() > 0.9
    assert (held[held["toxic"] == 0]["predicted"] == 0).mean() > 0.975


def test_language_of_held_out_documents(docs):
    held = language.predict_documents(docs, language.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (held["lang_pred"] == held["lang"]).mean() > 0.98


@pytest.mark.parametrize("text", ["½ ² ①", "Ⅷ ↂ", "", " \n", "12 _ ! ٣", "٪ ½½½", "\u0301"])
def test_texts_without_a_letter_have_no_language(docs_of, docs, text):
    assert language.gram_cells(text) is None
    found = language.predict_documents(docs_of([(1, text)]), language.Model(np.zeros(0, int), [], np.zeros((1, 1)), ["en"], 1.0)).first()
    assert (found["lang_pred"], found["score"]) == ("und", 0.0)


def test_numbers_are_no_letters_beside_others():
    assert language.gram_cells("ab½cd").tolist() == language.gram_cells("ab cd").tolist()


def test_one_row_with_a_third_of_the_corpus_teaches_once(spark):
    rows = [(0, "la même phrase", "fr")] * 300 + [(n, f"word number {n} of many", "en") for n in range(1, 200)] + [
        (n, f"le mot {n} de la langue", "fr") for n in range(200, 400)]
    texts = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(texts, language.Settings(rows=100, spanned=10))
    assert len(model.landmarks) <= 10 and model.languages == ["en", "fr"]
    found = language.predict_documents(texts, model).join(texts.select("doc_id", "lang").distinct(), "doc_id").toPandas()
    assert (found["lang_pred"] == found["lang"]).mean() > 0.95


def brute_kernel(texts):
    sets = []
    for text in texts:
        cleaned = "".join(c if unicodedata.category(c)[0] == "L" else " " for c in text.lower())
        cleaned = f" {' '.join(cleaned.split())} "
        sets.append({cleaned[i:i + n] for n in (1, 2, 3) for i in range(len(cleaned) - n + 1)})
    return np.array([[len(a & b) / np.sqrt(len(a) * len(b)) for b in sets] for a in sets])


def test_predictions_equal_a_plain_kernel_regression(spark):
    """All texts are landmarks here; kernel, ridge regression and scores once more, from sets of strings."""
    rng = np.random.default_rng(4)
    pools = {"en": ["the", "house", "of", "stone", "and", "tree"], "fr": ["la", "maison", "de", "pierre", "et", "l'été"], "de": ["das", "Haus", "aus", "Stein", "über", "½"]}
    rows = [(n, " ".join(rng.choice(pools[lang], 12)), lang) for n, lang in enumerate(sorted(pools) * 30)]
    texts = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    settings = language.Settings(landmarks=1000)
    found = {r["doc_id"]: r for r in language.predict_documents(texts, language.train(texts, settings)).collect()}
    known = sorted((r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1), key=lambda r: r[2])
    kernel, languages = brute_kernel([r[1] for r in known]), sorted(pools)
    label = np.array([languages.index(r[2]) for r in known])
    weight = (len(label) / np.bincount(label))[label]
    whole = np.hstack([kernel, np.ones((len(kernel), 1))])
    penalty = np.zeros((len(whole.T),) * 2)
    penalty[:-1, :-1] = kernel
    left = whole.T @ (whole * weight[:, None]) + settings.ridge * weight.sum() * (penalty + 1e-6 * np.eye(len(penalty)))
    weights = np.linalg.solve(left, whole.T @ (np.where(label[:, None] == np.arange(3), 1.0, -1.0) * weight[:, None]))
    every = brute_kernel([r[1] for r in rows] + [r[1] for r in known])[: len(rows), len(rows):]
    values = np.hstack([every, np.ones((len(rows), 1))]) @ weights
    likely = np.exp(settings.sharpness * (values - values.max(axis=1, keepdims=True)))
    likely /= likely.sum(axis=1, keepdims=True)
    for row, one in zip(rows, likely):
        assert found[row[0]]["lang_pred"] == languages[one.argmax()] and found[row[0]]["score"] == pytest.approx(one.max(), abs=2e-3)
        assert found[row[0]]["held_out"] == (zlib.crc32(str(row[0]).encode()) % 3 == 1)


def test_rare_languages_keep_their_own_letters(spark):
    """Two languages of few texts, each in its own script, beside two frequent ones full of other n-grams."""
    rng = np.random.default_rng(8)
    scripts = {"aa": ("abcdefghijklmnopqrstuvwxyz", 500, 200), "bb": ("abcdefghijklmnopqrstuvwxyzàéîõü", 500, 200),
               "r1": ("აბგდე", 20, 6), "r2": ("ვზთიკ", 20, 6)}
    rows = []
    for lang, (letters, texts, size) in scripts.items():
        for _ in range(texts):
            words = ("".join(rng.choice(list(letters), 5)) for _ in range(size))
            rows.append((len(rows), " ".join(words), lang))
    texts = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language.predict_documents(texts, language.train(texts)).join(texts.select("doc_id", "lang"), "doc_id").toPandas()
    rare = found[found["lang"].isin(["r1", "r2"])]
    assert rare["held_out"].any() and (rare["lang_pred"] == rare["lang"]).all()


def test_kernel_counts_every_cell_of_a_text():
    texts = [language.gram_cells(t) for t in ["abc abd", "abd xyz", "qqq"] * 40]
    model = language.Model(language._union(texts[:80]), texts[:80], np.zeros((81, 0)), [], 1.0)
    exact = [[len(np.intersect1d(a, b)) / np.sqrt(len(a) * len(b)) for b in texts[:80]] for a in texts]
    assert np.allclose(model.kernel(texts), exact, atol=1e-6)


def test_odd_texts_have_scores(spark, docs_of, odd_texts, docs, labels):
    odd = docs_of(odd_texts)
    for found in (toxicity.score_documents(odd, toxicity.train(docs, labels)), quality.score_documents(odd, quality.train(docs, labels))):
        rows = found.collect()
        assert len(rows) == len(odd_texts) and all(0 <= r["score"] <= 1 for r in rows)
        assert [r["held_out"] for r in rows if r["doc_id"] is None] == [None]
    languages = {r["doc_id"]: r for r in language.predict_documents(odd, language.train(docs)).collect()}
    assert [languages[i]["lang_pred"] for i in (1, 2, 3, 6)] == ["und"] * 4 and languages[4]["lang_pred"] != "und"


def test_nothing_to_learn_from(spark, docs_of, odd_texts, labels):
    odd, none = docs_of(odd_texts), labels.limit(0)
    assert all(r["score"] < 0.5 for r in toxicity.score_documents(odd, toxicity.train(odd, none)).collect())
    assert {r["score"] for r in quality.score_documents(odd, quality.train(odd, none)).collect()} == {0.5}
    empty = docs_of([])
    assert {r["lang_pred"] for r in language.predict_documents(odd, language.train(empty)).collect()} == {"und"}
    assert toxicity.score_documents(empty, toxicity.train(empty, labels)).collect() == []


def test_isotonic_values_never_fall():
    rng = np.random.default_rng(0)
    raw = rng.normal(size=400).round(1)
    label = (rng.uniform(size=400) < 1 / (1 + np.exp(-2 * raw))).astype(float)
    knots, values = quality.isotonic(raw, label)
    assert (np.diff(values) >= 0).all() and (np.diff(knots) > 0).all()
    assert np.interp(raw, knots, values).mean() == pytest.approx(label.mean(), abs=1e-9)


def test_probabilities_do_not_depend_on_the_size_of_the_sample(spark, docs_of):
    """Thinning the more frequent label must not lower the probability of what nine in ten call good."""
    rng = np.random.default_rng(5)
    good = (rng.uniform(size=6000) < 0.9).astype(int).tolist()
    texts = docs_of([(i, "the same few words for every document " * (1 + i % 7)) for i in range(6000)])
    known = spark.createDataFrame(list(enumerate(good)), "doc_id long, quality int")
    whole, thinned = (quality.score_documents(texts, quality.train(texts, known, quality.Settings(per_label=n))).toPandas()
                      for n in (6_000, 400))
    assert whole["score"].mean() == pytest.approx(0.9, abs=0.05)
    assert thinned["score"].mean() == pytest.approx(0.9, abs=0.05)
    assert thinned["predicted"].mean() > 0.9


def test_moments_of_groups_together():
    rng = np.random.default_rng(6)
    one, other = rng.normal(size=(30, 3)), rng.normal(2, 3, size=(50, 3))
    mean, deviation = quality.combined(np.array([one.mean(0), other.mean(0)]), np.array([one.std(0), other.std(0)]), np.array([30.0, 50.0]))
    both = np.vstack([one, other])
    assert np.allclose(mean, both.mean(0)) and np.allclose(deviation, both.std(0))


def test_normal_equations_equal_those_of_all_rows(spark):
    rng = np.random.default_rng(1)
    size = len(quality.STATISTICS)
    stats, label = rng.normal(size=(60, size)), rng.integers(0, 2, 60)
    shape = quality.Model(np.zeros(size), np.ones(size), rng.normal(size=(size, 7)), rng.uniform(size=7), np.zeros(8), (np.array([0, 1]),) * 2)
    rows = spark.createDataFrame([(s.tolist(), int(y)) for s, y in zip(stats, label)], "stats array<double>, label int")
    gram, moment = quality.normal_equations(rows, shape, 3)
    x = shape.cosines(stats)
    assert np.allclose(gram, x.T @ x) and np.allclose(moment, x.T @ label)


def test_random_features_approximate_the_gaussian_kernel():
    rng = np.random.default_rng(2)
    size = len(quality.STATISTICS)
    directions = rng.normal(size=(size, 20_000)) / np.sqrt(size)
    shape = quality.Model(np.zeros(size), np.ones(size), directions, rng.uniform(0, 2 * np.pi, 20_000), np.zeros(20_001), (np.array([0, 1]),) * 2)
    x = rng.normal(size=(5, size))
    z = shape.cosines(x)[:, :-1]
    exact = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * size))
    assert np.abs(z @ z.T - exact).max() < 0.05


def test_the_risk_is_corrected_where_it_would_turn_negative():
    """Unlabelled rows that hold as many positives as the prior says do not teach against them."""
    rng = np.random.default_rng(3)
    positive = np.ones((300, 1))
    unlabelled = (rng.uniform(size=(1000, 1)) < 0.3).astype(float)
    weights = toxicity.fit(positive, unlabelled, 0.3, toxicity.Settings())
    assert weights[0] + weights[-1] > 1 and weights[-1] < -1


def test_kernel_of_presence_is_the_normalised_overlap():
    a, b = language.gram_cells("abc abd"), language.gram_cells("abd xyz")
    cells = np.union1d(a, b)
    model = language.Model(cells, np.zeros((0, len(cells))), np.zeros((1, 0)), [], 1.0)
    x = model.presence([a, b])
    assert float(x[0] @ x[1]) == pytest.approx(len(np.intersect1d(a, b)) / np.sqrt(len(a) * len(b)), rel=1e-5)
    assert language.gram_cells("123 !!") is None and language.gram_cells(None) is None
