"""The pipeline against plain versions of its first three stages."""

import re

import corpus_pipeline
import pytest
from test_similar import jaccard

from vistrack.llm import toxicity


def good(text):
    """The quality rules in plain Python."""
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    n, chars = len(words), sum(map(len, words))
    windows = {}
    for i in range(n - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    repeated = {i + k for places in windows.values() if len(places) > 1 for i in places for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    twice = len(lines) - len(set(lines))
    symbols, capitals = (sum(c in s for c in text) for s in ("#*$%&|<>", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return not (n < 20 or 100 * len(repeated) > 30 * n or symbols * 10 > n or capitals * 2 > chars or twice * 10 > len(lines) * 3 or chars > 15 * n or chars < 2 * n)


def least_of_groups(rows):
    """Least id of each component of texts of similarity 0.8 or more."""
    root = {i: i for i, _ in rows}
    changed = True
    while changed:
        changed = False
        for i, a in rows:
            for j, b in rows:
                if i < j and root[i] != root[j] and (a == b or jaccard(a, b) >= 0.8):
                    root[i] = root[j] = min(root[i], root[j])
                    changed = True
    return {i for i, r in root.items() if i == r}


def test_stages_against_plain_versions(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{small}/labels.parquet"))
    rows = [(r.doc_id, r.text) for r in docs.collect() if model.score(r.text) < 0.5 and good(r.text)]
    keep = least_of_groups(rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert sorted(r.doc_id for r in docs.collect()) == sorted(keep)
    packed = corpus_pipeline.run(spark, small)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == keep


def test_odd_rows(spark, odd_docs, small):
    """Null and short texts fail the quality rules; the long one repeats itself; the repeated row stays once, with all columns."""
    docs = odd_docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, small)
        assert docs.columns == odd_docs.columns
    assert sorted(r.doc_id for r in docs.collect()) == [1]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, small).collect()
    assert {r.doc_id for r in packed} == {1}


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_empty_table(spark, no_docs, small, stage):
    assert stage(spark, no_docs, small).count() == 0


def test_ties_are_decided_by_the_row(spark, small):
    text = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(4, text, s) for s in "abc"] + [(None, text, "d")], "doc_id long, text string, _row string")
    got = {corpus_pipeline.distinct(spark, docs.repartition(n), small).collect()[0]._row for n in (1, 3, 5)}
    assert len(got) == 1
