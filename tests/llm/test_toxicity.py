import numpy as np

from newsloom.llm import toxicity


def corpus(spark, n=400):
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefghijklmno"), 6)) for _ in range(300)]
    bad = ["idiot", "moron", "scum", "worthless"]
    rows, labels = [], []
    for i in range(n):
        said = list(rng.choice(words, 60))
        toxic = int(i % 3 == 0)
        for _ in range(toxic * (1 + i % 5)):
            said[rng.integers(60)] = bad[rng.integers(4)]
        rows.append((i, " ".join(said)))
        labels.append((i, toxic))
    return rows, spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out(spark):
    rows, docs, labels = corpus(spark)
    model = toxicity.fit_toxicity(docs.where("doc_id < 300"), labels)
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs.where("doc_id >= 300"), model).collect()}
    bad = ("idiot", "moron", "scum", "worthless")
    right = [got[i].toxic == any(w in t for w in bad) for i, t in rows[300:]]
    assert np.mean(right) > 0.95
    low = np.mean([r.severity for i, r in got.items() if i % 3])
    assert low < 0.3 < np.mean([r.severity for i, r in got.items() if i % 3 == 0 and i % 5 >= 3])
    kept = toxicity.drop_toxic(docs.where("doc_id >= 300"), labels)
    assert kept.columns == docs.columns


def test_bounds_are_ordered(spark):
    _, docs, labels = corpus(spark, 200)
    model = toxicity.fit_toxicity(docs, labels)
    assert (np.diff(model.bounds) >= 0).all()
    assert np.allclose(model.probabilities(np.array([-3.0, 0, 9])).sum(axis=1), 1)


def test_sample_is_bounded(spark):
    _, docs, labels = corpus(spark)
    texts, toxic = toxicity.labelled_sample(docs, labels, 20)
    assert np.bincount(toxic).tolist() == [20, 20]
    assert len(texts) == 40


def test_hard_rows(spark, hard_docs, hard_rows, no_docs):
    _, docs, labels = corpus(spark)
    model = toxicity.fit_toxicity(docs, labels)
    rows = toxicity.score_toxicity(hard_docs, model).collect()
    assert sorted(repr(r.doc_id) for r in rows) == sorted(repr(i) for i, _ in hard_rows)
    assert not any(r.toxic for r in rows if r.doc_id in (0, 1, 2))
    assert toxicity.score_toxicity(no_docs, model).count() == 0
    odd = spark.createDataFrame([(None, 1), (1, None), (2, 7), (10**12, 1)], "doc_id long, toxic int")
    assert not any(r.toxic for r in toxicity.score_toxicity(hard_docs, toxicity.fit_toxicity(hard_docs, odd)).collect())


def test_long_clean_documents_stay(spark):
    rng = np.random.default_rng(8)
    rows, _, labels = corpus(spark)
    rare = [" ".join("".join(rng.choice(list("abcdeimnorstuwhlc"), 7)) for _ in range(20_000)) for _ in range(21)]
    # Some clean documents are long in training too; their labels are there already.
    clean = [i for i, _ in rows if i % 3][:18]
    train = spark.createDataFrame([(i, t) for i, t in rows if i not in clean] + list(zip(clean, rare)), "doc_id long, text string")
    model = toxicity.fit_toxicity(train, labels)
    said = {r.doc_id: r.toxic for r in toxicity.score_toxicity(spark.createDataFrame(list(enumerate(rare[18:])), "doc_id long, text string"), model).collect()}
    assert not any(said.values())
    found = {r.doc_id for r in toxicity.score_toxicity(train, model).where("toxic").collect()}
    assert len(found & {i for i, _ in rows if i % 3 == 0}) > 100


def test_scores_cap_features_as_the_fit_does():
    words = [f"idiot{a}{b}" for a in "qwzx" for b in "qwzxjk"]
    stem = np.intersect1d(*(toxicity.word_features([w])[0] for w in (words[0], words[-1])))
    model = toxicity.OrdinalModel(stem, np.ones(len(stem)), np.array([1.0]))
    few, many = toxicity.document_scores(model, [" ".join(words[:3]), " ".join(words)])
    assert few == many == 3 * len(stem) > 0


def test_sample_has_long_texts(spark):
    rows, _, labels = corpus(spark)
    long = [(i, t + " " + " ".join(f"plain{n}" for n in range(4_000)) if i % 3 else t) for i, t in rows]
    assert max(len(t) for _, t in long) > 20_000
    sample, toxic = toxicity.labelled_sample(spark.createDataFrame(long, "doc_id long, text string"), labels)
    assert len(sample) == len(rows)
    assert np.bincount(toxic).tolist() == [266, 134]
