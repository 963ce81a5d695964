"""Toxicity by weak supervision: voters, a generative label model, a linear classifier.

1. Voters. Words and word prefixes that occur in toxic far more than in other texts of a bounded labelled
   sample (PER_CLASS rows of each class) are proposed as lexicon voters; pattern voters look at capitals,
   symbols and exclamation marks; one voter says clean where no lexicon word occurs. Labels only propose
   words here: no voter is a label.
2. Votes are cast on rows without looking at labels: a sample of at most VOTED rows of the corpus by hash,
   and the texts of the labelled sample.
3. Label model. Expectation maximisation over the votes alone estimates how often each voter is right
   about the hidden class. It starts from the voters' own majority; the size of the classes is the only
   thing it is told. Correlations that remain between voters given the class shrink the say of each
   voter by the size of its correlated neighborhood. The posteriors of the voted rows then propose more
   lexicon voters (words that go with those known), and votes and model are taken once more.
4. A logistic regression over the lexicon learns the posterior labels; its intercept alone is calibrated
   by the labelled rows of the training folds. It scores every whole text.

Only labels of rows whose crc32(doc_id as text) mod 5 is not 0 are read. The score depends on the
text alone.

Edge cases: null and empty texts get the score of no features; without any labelled row of both
classes, or without a telling word, every score is 1 / (1 + e^4), below 0.5; null ids are held_out = null; repeated rows get
equal scores; labels given twice count twice; a column that has the name of the score is replaced by it.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vistrack.session import cut, stored

#: Labelled rows of each class that training reads at most; rows of the corpus that voters look at, about.
PER_CLASS, VOTED = 4000, 8000
#: Features looked at, and lexicon voters chosen from them for the label model and the classifier, at most.
FEATURES, VOTERS = 4000, 160
#: What a row counts after each chosen feature it has.
COVERED = 0.3
PREFIXES = (3, 4, 5, 6, 7)
#: Least log-likelihood ratio of a feature; chance reaches it in about one of 100,000 features.
MIN_RATIO = 20.0
LETTERS = re.compile(r"[^\W\d_]+")
FOLDS = 5
#: Rows whose features are listed at once.
SLICE = 64
GENERAL, PATTERNS = ("no word", "one word", "several words"), ("capitals", "exclamation marks", "symbols")
#: Accuracy that lexicon voters are taken to have (patterns: that of chance), and the weight of that against their own votes.
ASSUMED, TRUST = 0.9, 0.5


def features_of(text: str | None) -> set[str]:
    """Distinct words and word prefixes in lower case; a prefix is marked by a star, and once more by two
    stars if at least two distinct words go on from it."""
    words = set(LETTERS.findall((text or "").lower()))
    stems = Counter(w[:k] for w in words for k in PREFIXES if len(w) > k)
    return words.union([p + "*" for p in stems], [p + "**" for p, n in stems.items() if n > 1])


def patterns_of(text: str | None) -> list[int]:
    """Pattern votes: 1 toxic, -1 clean, 0 abstain."""
    t = text or ""
    letters = sum(map(len, LETTERS.findall(t))) or 1
    capitals = len(re.findall(r"[A-Z]", t)) / letters
    marks = t.count("!") / max(1, t.count(" ") + 1)
    symbols = len(re.findall(r"[#*$%&|<>@]", t)) / letters
    return [1 if capitals > 0.5 else 0, 1 if marks > 0.5 else 0, 1 if symbols > 0.3 else 0]


def fold(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label: str = "toxic", text_col: str = "text") -> DataFrame:
    """(key, text, y), stored: texts of at most PER_CLASS labelled training rows a class, and of about
    VOTED rows of the corpus outside the held-out fold, both chosen by hash. y is null for a text without
    label; copies of a text are one."""
    usable = labels.where(F.col(label).isin(0, 1) & (fold(F.col(id_col)) != 0)).select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("y"))
    some = [usable.where(F.col("y") == y).orderBy(F.xxhash64("_id"), "_id").limit(PER_CLASS) for y in (0, 1)]
    ids = cut(some[0].union(some[1]).distinct())
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
    found = texts.join(F.broadcast(ids), "_id").select("text", "y")
    every = max(1, docs.count() // VOTED)
    others = texts.where((F.pmod(F.xxhash64("_id", "text"), F.lit(every)) == 0) & (F.coalesce(fold(F.col("_id")), F.lit(1)) != 0)).select("text", F.lit(None).cast("int").alias("y"))
    both = found.union(others).groupBy("text").agg(F.max("y").alias("y"))  # a copy tells nothing new
    return stored(both.select(F.monotonically_increasing_id().alias("key"), "text", "y"), "toxicity-rows")


class Model:
    """weights: by feature; score = 1 / (1 + exp(-(bias + sum of the weights of a text's features)))."""

    def __init__(self, weights: dict[str, float], bias: float, report: dict | None = None):
        self.weights, self.bias, self.report = weights, bias, report or {}
        self.prefixes = tuple(sorted({len(f.rstrip("*")) for f in weights if f.endswith("*")}))

    def score(self, text: str | None) -> float:
        w = self.weights
        words = set(LETTERS.findall((text or "").lower()))
        stems = Counter(x[:k] for x in words for k in self.prefixes if len(x) > k)
        hit = [w[x] for x in words if x in w]
        for p, n in stems.items():
            if p + "*" in w:
                hit.append(w[p + "*"])
            if n > 1 and p + "**" in w:
                hit.append(w[p + "**"])
        z = self.bias + math.fsum(hit)
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))


def label_model(votes: np.ndarray, prior: float, start: np.ndarray, assumed: np.ndarray | float | None = None, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of class 1 per row, accuracy of each voter's votes (of -1, of 1), say of each voter.

    votes: rows x voters of -1, 0, 1; 0 abstains and tells nothing. start: the posterior at the start.
    A voter that never meets another one could be right or wrong: its accuracy is drawn to the assumed one
    with the weight of TRUST votes for each of its own (for votes of -1 as much better than the prior).
    """
    n, k = votes.shape
    say, post = np.ones(k), start
    up, down = (votes == 1).astype(float), (votes == -1).astype(float)
    base = math.log(prior / (1 - prior))
    assumed = np.broadcast_to(ASSUMED if assumed is None else assumed, k)
    clean = (1 - ASSUMED) * prior
    for step in range(rounds):
        # share of class 1 among the rows where a voter votes so
        p_up = (up.T @ post + assumed * (TRUST * up.sum(0) + 1)) / ((1 + TRUST) * up.sum(0) + 1)
        p_down = (down.T @ post + clean * (TRUST * down.sum(0) + 1)) / ((1 + TRUST) * down.sum(0) + 1)
        odds = lambda p: np.log(p) - np.log1p(-p) - base
        z = base + up @ (say * odds(p_up)) + down @ (say * odds(p_down))
        new = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        if step in (5, 15):  # correlations that are left given the class
            corr = np.zeros((k, k))
            for own in (new > 0.5, new <= 0.5):
                rest = votes[own] - votes[own].mean(0) if own.any() else votes[:1] * 0
                sd = rest.std(0)
                part = (rest / np.maximum(sd, 1e-9)).T @ (rest / np.maximum(sd, 1e-9)) / len(rest)
                corr = np.maximum(corr, part)
            np.fill_diagonal(corr, 1.0)
            say = 1 / np.where(corr > 0.6, corr, 0).sum(1)
        done, post = np.abs(new - post).max() < 1e-6 and step > 20, new
        if done:
            break
    return post, np.stack([1 - p_down, p_up], 1), say


def choose(rows: list[np.ndarray], y: np.ndarray, names: list[str]) -> list[int]:
    """Features that still tell the classes apart once rows that chosen features cover count for less.

    Greedy by log-likelihood ratio over weighted rows; a row's weight falls by COVERED with each chosen
    feature it has. Words that are frequent only because one toxic text has many near copies fall out,
    as those copies are soon covered; so do prefixes of a chosen word with the same rows.
    """
    d, length = len(names), np.array([len(r) for r in rows])
    at, col = np.repeat(np.arange(len(rows)), length), np.concatenate(rows).astype(int)
    member = [[] for _ in range(d)]
    for r, c in zip(at, col, strict=True):
        member[c].append(r)
    member = [np.array(m, dtype=int) for m in member]
    weight, open_, out = np.ones(len(rows)), np.ones(d, dtype=bool), []
    share = y.mean()
    long = np.array([len(f) for f in names])
    while len(out) < VOTERS and open_.any():
        n1, n0 = np.bincount(col, (weight * y)[at], d), np.bincount(col, (weight * (1 - y))[at], d)
        seen = np.maximum(n1 + n0, 1e-12)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = 2 * (np.where(n1 > 0, n1 * np.log(n1 / (seen * share)), 0) + np.where(n0 > 0, n0 * np.log(n0 / (seen * (1 - share))), 0))
        ratio = np.where(open_ & (n1 / seen > share), ratio, -1.0)
        top = ratio.max()
        if top < MIN_RATIO / 2:
            break
        best = max(np.flatnonzero(ratio >= top * (1 - 1e-9)), key=lambda j: (long[j], names[j]))
        out.append(int(best))
        open_[best] = False
        for j in np.flatnonzero(open_ & (ratio > 0)):  # the same word again, shortened
            if names[best].startswith(names[j].rstrip("*")) or names[j].startswith(names[best].rstrip("*")) and len(member[j]) >= 0.9 * len(member[best]):
                if len(member[j]) <= 1.1 * len(member[best]):
                    open_[j] = False
        weight[member[best]] *= COVERED
    return out


def logistic(x: np.ndarray, q: np.ndarray, l2: float = 0.05, steps: int = 50) -> tuple[np.ndarray, float]:
    """Weights and bias by Newton's method on soft labels; x: rows x features of 0 and 1."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], l2)
    ridge[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - q) + ridge * w
        hess = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 4.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def telling(rows: DataFrame) -> list[str]:
    """Features that tell class 1 in rows (text, q: share of class 1), by log-likelihood ratio, FEATURES at most."""

    def explode(batches):
        import pyarrow as pa

        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                b, q, f = whole.slice(at, SLICE), [], []
                for t, v in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                    own = features_of(t.as_py())
                    f += own
                    q += [v] * len(own)
                yield pa.RecordBatch.from_arrays([pa.array(f, pa.string()), pa.array(q, pa.float64())], names=["f", "q"])

    n1, n = rows.agg(F.coalesce(F.sum("q"), F.lit(0.0)), F.count("*")).first()
    n0 = n - n1
    if not n0 or not n1:
        return []
    counts = rows.select("text", "q").mapInArrow(explode, "f string, q double").groupBy("f").agg(F.sum("q").alias("n1"), F.sum(1 - F.col("q")).alias("n0"))
    # log-likelihood ratio of the split over the classes against the rows'; chance words stay below
    share, seen = n1 / n, F.col("n0") + F.col("n1")
    part = lambda n, e: F.when(n > 0, n * F.log(n / (seen * e))).otherwise(0.0)
    ratio = 2 * (part(F.col("n1"), share) + part(F.col("n0"), 1 - share))
    toxic = (F.col("n1") + 0.5) / (n1 + 1) > 4.5 * (F.col("n0") + 0.5) / (n0 + 1)
    top = counts.where(toxic & (F.col("n1") >= 2.5)).withColumn("s", F.round(ratio, 6)).where(F.col("s") > MIN_RATIO).orderBy(F.desc("s"), "f").limit(FEATURES)
    return [r["f"] for r in top.collect()]


def encoded(rows: DataFrame, names: list[str]) -> list:
    """Rows (key, x: numbers of the names a text has, p: pattern votes, y) of at most 2 x PER_CLASS labelled and about VOTED other texts."""
    number = {f: i for i, f in enumerate(names)}

    def run(batches):
        import pyarrow as pa

        for b in batches:
            x, p = [], []
            for t in b.column(1):
                x.append(sorted(number[f] for f in features_of(t.as_py()) if f in number))
                p.append(patterns_of(t.as_py()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.int32())), pa.array(p, pa.list_(pa.int32())), b.column(2)], names=["key", "x", "p", "y"])

    return sorted(rows.mapInArrow(run, "key long, x array<int>, p array<int>, y int").collect(), key=lambda r: r["key"])


def vote(data: list, names: list[str], q: np.ndarray, used: np.ndarray, share: float, first: int = 0):
    """Lexicon voters (the first names and) those chosen from names for the split q of the used rows, the
    rows of their words, and the label model over their votes and the patterns': posterior, accuracies, say."""
    rows = [np.array(r["x"], dtype=int) for r in data]
    chosen = list(dict.fromkeys([*range(first), *choose([rows[i] for i in np.flatnonzero(used)], q[used], names)]))
    x = np.zeros((len(rows), len(chosen)))
    place = {c: j for j, c in enumerate(chosen)}
    for i, r in enumerate(rows):
        x[i, [place[c] for c in r.tolist() if c in place]] = 1
    patterns = np.array([r["p"] for r in data], dtype=float)
    # voters: the lexicon, no word of it at all, one word only, several words, patterns
    mine = [names[c] for c in chosen]
    alone = [j for j, f in enumerate(mine) if not (f.endswith("*") and not f.endswith("**") and f + "*" in mine)]
    hits = x[:, alone] @ np.array([2.0 if mine[j].endswith("**") else 1.0 for j in alone]) if alone else np.zeros(len(x))
    general = np.stack([np.where(x.any(1), 0, -1), np.where(x.any(1) & (hits < 2), -1, 0), np.where(hits >= 2, 1, 0)], 1)
    votes = np.hstack([x, general, patterns])
    start = np.where(hits >= 2, 0.9, np.where(x.any(1), 0.4, np.where((patterns > 0).any(1), 0.3, 0.01)))
    assumed = np.array([ASSUMED] * (len(mine) + len(GENERAL)) + [share] * len(PATTERNS))
    post, table, say = label_model(votes, share, start, assumed)
    return [names[j] for j in chosen], x, post, table, say


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label: str = "toxic", text_col: str = "text") -> Model:
    usable = labels.where(F.col(label).isin(0, 1) & (fold(F.col(id_col)) != 0))
    rate = usable.agg(F.avg(F.col(label).cast("double"))).first()[0]
    some = sample(docs, labels, id_col, label, text_col)
    spark = docs.sparkSession
    proposed = telling(some.where("y IS NOT NULL").select("text", F.col("y").cast("double").alias("q")))
    if not proposed:
        return Model({}, -4.0)
    data = encoded(some, proposed)
    y = np.array([-1 if r["y"] is None else r["y"] for r in data], dtype=float)
    # classes of the voted rows: the labelled sample has another mixture than the corpus
    known = y >= 0
    share = min(0.5, max(0.01, ((y == 1).sum() + rate * (~known).sum()) / len(y)))
    names, x, post, table, say = vote(data, proposed, y, known, share)
    if not names:
        return Model({}, -4.0)
    # words that go with the posterior in all voted rows, labelled or not
    soft = spark.createDataFrame([(r["key"], float(q)) for r, q in zip(data, post, strict=True)], "key long, q double")
    more = telling(some.join(F.broadcast(soft), "key").select("text", "q"))
    wider = list(dict.fromkeys([*names, *more]))
    data = encoded(some, wider)
    names, x, post, table, say = vote(data, wider, post, np.ones(len(data), bool), share, len(names))
    k = len(names)
    if not k:
        return Model({}, -4.0)
    w, _ = logistic(x, post)
    # the intercept that separates the labelled rows of the training folds best, in the middle of the gap
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    weight = np.where(y == 1, rate / n1, (1 - rate) / n0)[known]
    weight *= len(weight) / weight.sum()
    z, t = (x @ w)[known], y[known]
    cuts = np.unique(z)
    mids = np.concatenate([[cuts[0] - 1], (cuts[1:] + cuts[:-1]) / 2, [cuts[-1] + 1]])
    order = np.argsort(z, kind="stable")
    below1 = np.searchsorted(z[order], mids)
    c1, c0 = np.concatenate([[0], np.cumsum((t * weight)[order])]), np.concatenate([[0], np.cumsum(((1 - t) * weight)[order])])
    wrong = c1[below1] + (c0[-1] - c0[below1])
    best = mids[np.flatnonzero(wrong <= wrong.min() + 1e-9)]
    b = -float(best[len(best) // 2])
    accuracy = [(names[j] if j < k else (*GENERAL, *PATTERNS)[j - k], round(float(table[j, 0]), 4), round(float(table[j, 1]), 4), round(float(say[j]), 3)) for j in range(len(table))]
    return Model({f: float(v) for f, v in zip(names, w, strict=True) if abs(v) > 1e-6}, b, {"voters": accuracy, "posterior": post, "y": y, "proposed": len(proposed)})


def score_texts(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with the score of each whole text; a column of the score's name is replaced."""
    if score_col == text_col:
        raise ValueError("the score cannot take the name of the text")
    docs = docs.drop(score_col)
    known = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))  # at most FEATURES weights

    def run(batches):
        import pyarrow as pa

        m = Model(*known.value)
        for b in batches:
            at = b.schema.get_field_index(text_col)
            s = [m.score(str(t) if (t := x.as_py()) is not None else None) for x in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], names=[*b.schema.names, score_col])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())]))


def drop_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of docs that score below 0.5, columns unchanged."""
    score = "_score"
    while score in docs.columns:
        score += "_"
    return score_texts(docs, train(docs, labels, id_col, text_col=text_col), text_col, score).where(F.col(score) < 0.5).drop(score)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = score_texts(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
