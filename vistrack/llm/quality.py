"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule is a condition that rejects a text. Its cost (seconds a row) and the rows it rejects are
estimated on a bounded sample of all partitions; rules are then put in greedy order by rejected rows per cost among
those not yet rejected, and compiled to one CASE, of which Spark evaluates a branch only if all
before it did not hold. The order changes cost and the name of the first rule that rejects, never
the verdict.

Edge cases: null text has no words and fails like an empty one; ids, ties, repeated rows and extra
columns play no part; an empty table gives no rows (its rules then keep their written order).
"""

from __future__ import annotations

import math
import time
from dataclasses import dataclass
from statistics import median

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vistrack.session import cut

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
#: Rows of the sample on which cost and selectivity are estimated, about; how often each is evaluated in a
#: timed job, and the number of such jobs, of which the median counts.
SAMPLE_ROWS, REPEATS, JOBS = 400, 4, 3
#: Partitions of the sample.
SAMPLE_PARTS = 8


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def symbols_of(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    return (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long")


def word_chars_of(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")).cast("long")


def capitals_of(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    return (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))).cast("long")


def lines_of(text: Column) -> Column:
    """Lines with at least one word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def dup_lines_of(lines: Column) -> Column:
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def _bind(value: Column, use) -> Column:
    """use(value) with value evaluated once a row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def repeat_words_of(words: Column) -> Column:
    """Words within windows of eight words that occur at least twice in the text."""
    hashes = _bind(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(h, i, WINDOW))))

    def covered(h: Column) -> Column:
        ranked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        twice = _bind(ranked, lambda r: F.filter(r, lambda s, i: (F.get(r, i - 1)["h"].eqNullSafe(s["h"])) | (F.get(r, i + 1)["h"].eqNullSafe(s["h"]))))
        places = F.sort_array(F.transform(twice, lambda s: s["p"]))
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
        step = lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).cast("long").alias("n"), p.alias("last"))
        return F.aggregate(places, start, step)["n"]

    none = F.lit(0).cast("long")
    found = _bind(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(covered(h)))
    return F.when(F.size(words) < WINDOW + 1, none).otherwise(found)


@dataclass(frozen=True)
class Rule:
    """rejects(text, words) is true for a text to reject, from whole texts; words are split once."""

    name: str
    rejects: object


#: The two base rules and the method's own. All in whole numbers, so every engine agrees.
RULES = (
    Rule("few_words", lambda t, w: F.size(w) < 20),
    Rule("repeated_words", lambda t, w: repeat_words_of(w) * 100 > F.size(w) * 30),
    Rule("symbols", lambda t, w: symbols_of(t) * 10 > F.size(w)),
    Rule("capitals", lambda t, w: capitals_of(t) * 2 > word_chars_of(t)),
    Rule("repeated_lines", lambda t, w: _bind(lines_of(t), lambda x: dup_lines_of(x) * 10 > F.size(x) * 3)),
    Rule("word_length", lambda t, w: (word_chars_of(t) > F.size(w) * 15) | (word_chars_of(t) < F.size(w) * 2)),
)
BASE = ("few_words", "repeated_words")


def estimate(docs: DataFrame, text_col: str = "text", rules=RULES, rows: int = SAMPLE_ROWS) -> tuple[dict[str, float], dict[tuple, int]]:
    """Seconds a row of each rule, and the sampled rows by the set of rules that reject them.

    The sample takes rows of all partitions alike (Bernoulli, fixed seed) and stays on the executors. Costs
    are rounded to powers of two, so that noise does not change the order of the rules.
    """
    n_docs = docs.count()
    text = docs.select(F.col(f"`{text_col}`").cast("string").alias("t"))
    some = text.sample(False, rows / n_docs, 7) if n_docs > rows else text
    some = cut(some.repartition(SAMPLE_PARTS).withColumn("w", words_of(F.col("t"))))
    t, w = F.col("t"), F.col("w")
    patterns = some.select(*[r.rejects(t, w).alias(r.name) for r in rules]).groupBy(*[r.name for r in rules]).count().collect()
    n = max(1, sum(p["count"] for p in patterns))
    often = some.withColumn("_again", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))))

    def seconds(e: Column) -> float:
        began = time.perf_counter()
        often.agg(F.count_if(e)).collect()
        return time.perf_counter() - began

    jobs = {"": F.size(w) < 0} | {r.name: r.rejects(t, w) for r in rules}
    took = {name: median(seconds(e) for _ in range(JOBS + 1)) for name, e in jobs.items()}
    least = max(0.002, took[""] / 4)  # less than this is noise of a job
    cost = {r.name: 2.0 ** round(math.log2(max(least, took[r.name] - took[""]) / (n * REPEATS))) for r in rules}
    return cost, {tuple(r.name for r in rules if p[r.name]): p["count"] for p in patterns}


def order_rules(cost: dict[str, float], patterns: dict[tuple, int]) -> list[str]:
    """Greedy: next is the rule with most not yet rejected rows per cost (ties: the written order)."""
    left, order, live = list(cost), [], dict(patterns)
    while left:
        gain = {r: sum(n for p, n in live.items() if r in p) / cost[r] for r in left}
        best = max(left, key=lambda r: (gain[r], -left.index(r) if gain[r] else -cost[r]))
        order.append(best)
        left.remove(best)
        live = {p: n for p, n in live.items() if best not in p}
    return order


def cascade(docs: DataFrame, text_col: str = "text", rules=RULES) -> list[Rule]:
    """The rules in the order learned from a sample of docs."""
    by = {r.name: r for r in rules}
    return [by[n] for n in order_rules(*estimate(docs, text_col, rules))]


def rejected_by(text: Column, words: Column, rules) -> Column:
    """Name of the first rule, in the given order, that rejects; null for a text to keep."""
    out = None
    for r in rules:
        out = F.when(r.rejects(text, words), r.name) if out is None else out.when(r.rejects(text, words), r.name)
    return out


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs that no rule rejects, columns unchanged."""
    rules, own = cascade(docs, text_col), list(docs.columns)
    text = F.col(f"`{text_col}`").cast("string")
    mine = "_words"
    while mine in own:
        mine += "_"
    return docs.withColumn(mine, words_of(text)).where(rejected_by(text, F.col(mine), rules).isNull()).select(*[f"`{c}`" for c in own])


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, counts, base_failed, rejected_by (first rule of the learned order) and kept."""
    rules = [r for r in cascade(docs, text_col) if r.name not in BASE]
    d = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("t")).withColumn("w", words_of(F.col("t")))
    t, w = F.col("t"), F.col("w")
    d = d.select(id_col, "t", "w", F.size(w).cast("long").alias("n_words"), word_chars_of(t).alias("word_chars"), symbols_of(t).alias("n_symbols"), _bind(lines_of(t), dup_lines_of).alias("n_dup_lines"), repeat_words_of(w).alias("n_repeat_words"))
    d = d.withColumn("base_failed", (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30))
    d = d.withColumn("rejected_by", F.when(F.col("base_failed"), "base").otherwise(rejected_by(t, w, rules)))
    return d.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("rejected_by").isNull().alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return statistics(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
win AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c
  FROM (SELECT doc_id, i, array_to_string(w[i:i+7], ' ') AS s
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8))),
rep AS (
  SELECT doc_id, sum(g)::BIGINT AS n_repeat_words
  FROM (SELECT doc_id, least(8, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), i - 8)) AS g
        FROM win WHERE c > 1)
  GROUP BY doc_id),
s AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')))::BIGINT AS caps, len(lines) AS n_lines
  FROM d LEFT JOIN rep ON d.doc_id = rep.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR n_symbols * 10 > n_words OR caps * 2 > word_chars
            OR n_dup_lines * 10 > n_lines * 3 OR word_chars > n_words * 15 OR word_chars < n_words * 2) AS kept
FROM s
"""
