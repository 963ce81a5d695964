from rows import plain

from vistrack.llm import quality


def test_equals_sql(spark, small, duck):
    assert plain(quality.query(spark, small).toPandas()) == plain(duck.sql(quality.SQL).df())


def brute_repeats(words):
    seen = {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    return len({i + k for v in seen.values() if len(v) > 1 for i in v for k in range(8)})


def test_repeats_against_brute_force(spark):
    import random

    from pyspark.sql import functions as F

    rng = random.Random(1)
    texts = [" ".join(rng.choice("ab") for _ in range(n)) for n in (0, 7, 8, 9, 20, 60, 200)] + ["x " * 9, " ".join(map(str, list(range(20)) * 2))]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(quality.repeat_words_of(quality.words_of(F.col("t")))).collect()]
    assert got == [brute_repeats(t.split()) for t in texts]


def test_order_is_greedy_and_does_not_change_the_verdict(spark, small):
    cost = {"a": 1.0, "b": 10.0, "c": 1.0}
    assert quality.order_rules(cost, {("a", "b"): 5, ("b",): 20, ("c",): 3, (): 9}) == ["a", "c", "b"]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = {r.doc_id for r in quality.keep_good(docs).collect()}
    assert kept == {r.doc_id for r in quality.statistics(docs).collect() if r.kept}


def test_labelled_good_documents_stay(spark, small):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    r = quality.query(spark, small).join(labels, "doc_id").where("n_words >= 20 AND NOT base_failed").toPandas()
    assert (r[r.quality == 1].kept).mean() > 0.95


def test_odd_rows(spark, odd_docs, no_docs):
    rows = {r.doc_id: r for r in quality.statistics(odd_docs).collect()}
    assert rows[2].n_words == rows[3].n_words == 0 and rows[5].n_words == 60_000 and rows[7].n_dup_lines == 1
    assert quality.keep_good(odd_docs).columns == odd_docs.columns
    assert sorted(r.doc_id for r in quality.keep_good(odd_docs).collect()) == [1, 1]
    assert quality.statistics(no_docs).count() == 0


def test_costs_and_order_are_stable(spark, small):
    """The sample has rows of all partitions; costs are powers of two, and rules that cost far more come out dearer."""
    docs = spark.read.parquet(f"{small}/documents.parquet").select("text")
    runs = [quality.estimate(docs, rows=100) for _ in range(2)]
    assert runs[0][1] == runs[1][1] and 50 < sum(runs[0][1].values()) < 200
    assert all(c[r] == 2.0 ** round(__import__("math").log2(c[r])) for c, _ in runs for r in c)
    assert all(c["repeated_words"] > c["few_words"] for c, _ in runs)
    assert [quality.order_rules(*r).index("repeated_words") > quality.order_rules(*r).index("few_words") for r in runs] == [True, True]
