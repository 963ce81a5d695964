import math
import random
from collections import Counter

from vistrack.llm import lm


def test_all_words_and_pairs_are_counted(spark, monkeypatch):
    """More words than any fixed vocabulary of 30,000, several chunks, and texts the training lacks."""
    monkeypatch.setattr(lm, "CHUNK", 20_000)
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(rng.choice([50, 90_000]))}" for _ in range(300)) for _ in range(400)]
    docs = spark.createDataFrame([(i, t, i % 3 == 0) for i, t in enumerate(texts)], "doc_id long, text string, good boolean").repartition(3)
    other = "w1 never seen w2 w1 w1"
    got = {r.doc_id: r for r in lm.score(docs.select("doc_id", "text").union(spark.createDataFrame([(-1, other)], "doc_id long, text string")), lm.train(docs, "good")).collect()}
    models = []
    for own in (texts[::3], texts):
        uni, big = Counter(), Counter()
        for t in own:
            w = t.split()
            uni.update(w)
            big.update(zip(["", *w], w, strict=False))
        models.append((uni, big, sum(uni.values()), len(own)))
    n = len(models[1][0])
    assert n > 30_000

    def loss(t, model):
        uni, big, total, starts = model
        w = t.split()
        p = [0.7 * min(1, big[a, b] / max(1, uni[a] if a else starts)) + 0.25 * uni[b] / total + 0.05 / (n + 1) for a, b in zip(["", *w], w, strict=False)]
        return -sum(map(math.log, p)) / len(p)

    for i, t in [(-1, other), *enumerate(texts)]:
        assert abs(got[i].target_loss - loss(t, models[0])) < 1e-9 and abs(got[i].background_loss - loss(t, models[1])) < 1e-9
        assert got[i].n_tokens == len(t.split())
