import random
import zlib

import numpy as np

from vistrack.llm import toxicity


def corpus(n=600, seed=1):
    rng, rows, labels = random.Random(seed), [], []
    words = ["".join(rng.choice(("ka", "lo", "mi", "tu", "re")) for _ in range(rng.randrange(1, 5))) for _ in range(300)]
    bad = ["vileword", "nastyone", "hatefu"]
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randrange(10, 80))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(bad) + rng.choice(("", "", "x", "yz")))
        rows.append((i, " ".join(w)))
        if i % 4:
            labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    scored = {r.doc_id: r.score for r in toxicity.score_texts(docs, toxicity.train(docs, known)).collect()}
    held = [(i, y) for i, _, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 50 and np.mean([(scored[i] >= 0.5) == y for i, y in held]) > 0.95
    kept = toxicity.drop_toxic(docs, known)
    assert kept.columns == docs.columns and kept.count() == sum(s < 0.5 for s in scored.values())


def test_held_out_labels_are_not_read(spark):
    rows, labels = corpus(300)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    flipped = [(i, q, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, q, y in labels]
    m = [toxicity.train(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (labels, flipped)]
    assert m[0].weights == m[1].weights and m[0].bias == m[1].bias


def test_label_model_outvotes_a_wrong_annotator():
    rng = np.random.default_rng(1)
    y = rng.random(2000) < 0.2
    votes = np.stack([np.where(y & (rng.random(2000) < 0.6), 1, 0) for _ in range(5)] + [np.where(rng.random(2000) < 0.1, 1 - 2 * y, 2 * y - 1)], 1)
    post, table, say = toxicity.label_model(votes, 0.2, np.where(votes[:, 5] > 0, 0.9, 0.05))
    assert ((post > 0.5) == y).mean() > ((votes[:, 5] > 0) == y).mean() and table[5, 1] < table[0, 1]


def test_odd_rows(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    m = toxicity.train(odd_docs, none)
    rows = toxicity.score_texts(odd_docs, m).collect()
    assert len(rows) == 9 and all(0 <= r.score < 0.5 for r in rows)
    assert toxicity.score_texts(no_docs, m).count() == 0
    assert toxicity.drop_toxic(odd_docs, none).columns == odd_docs.columns


def test_scores_against_plain_sums(spark):
    """score = logistic of the bias and the weights of all features of a text, however they are looked up."""
    rows, labels = corpus(300)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    m = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert any(f.endswith("*") for f in m.weights)
    for _, t in rows:
        z = m.bias + sum(w for f, w in sorted(m.weights.items()) if f in toxicity.features_of(t))
        assert abs(m.score(t) - 1 / (1 + np.exp(-z))) < 1e-9


def test_names_of_columns(spark):
    """Other names of id and text; a column called score is replaced by the score."""
    rows, labels = corpus(300)
    docs = spark.createDataFrame([(i, t, 7.0, "x") for i, t in rows], "key long, body string, score double, text string")
    known = spark.createDataFrame(labels, "key long, quality int, toxic int")
    scored = toxicity.score_texts(docs, toxicity.train(docs, known, "key", text_col="body"), "body")
    assert sorted(scored.columns) == ["body", "key", "score", "text"] and scored.where("score > 1").count() == 0
    kept = toxicity.drop_toxic(docs, known, "body", "key")
    assert kept.columns == docs.columns and 0 < kept.count() < 300


def test_labels_only_propose_and_calibrate(spark):
    """Wrong labels of a tenth of the clean rows do not reach the posterior: votes, not labels, decide."""
    rows, labels = corpus(600)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    noisy = [(i, q, 1 if i % 60 == 1 else y) for i, q, y in labels]
    m = toxicity.train(docs, spark.createDataFrame(noisy, "doc_id long, quality int, toxic int"))
    truth = {i: int(i % 6 == 0) for i, _ in rows}
    wrong = [i for i, t in rows if (m.score(t) >= 0.5) != truth[i]]
    assert len(wrong) <= 0.05 * len(rows)


def test_repeated_rows_and_null_ids(spark):
    rows, labels = corpus(240)
    docs = spark.createDataFrame([*rows, *rows[:50], (None, rows[0][1]), (None, None)], "doc_id long, text string")
    m = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = toxicity.score_texts(docs, m).collect()
    assert len(got) == 292 and len({(r.text, r.score) for r in got}) == len({r.text for r in got})
