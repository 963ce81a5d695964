"""Plans of counts over pairs: what is sent, and what is never made."""

import pytest
from pyspark.sql import functions as F
from test_blocks import sent

from vistrack.functions import kernels
from vistrack.operators import pairs
from vistrack.session import dealt_join


def test_covisibility_sends_no_pairs(spark):
    """40 points seen by the same 60 views, one of them twice: 1,770 pairs of views a point were joined rows."""
    obs = spark.range(40 * 60).select((F.col("id") % 60).alias("view"), F.expr("id div 60").alias("point")).union(spark.createDataFrame([(3, 0), (None, 0), (3, None)], "view long, point long")).repartition(8).cache()
    obs.count()
    got = {}
    n = sent(spark, lambda: got.update({(r.v1, r.v2): r.n for r in pairs.covisibility(obs, diagonal=True).collect()}))
    assert got == {(a, b): 40 + (1 + 2 * (a == b)) * (a == 3 or b == 3) for a in range(60) for b in range(60)}
    assert n <= 3 * 2401 + 16 + 8


@pytest.mark.parametrize("ends", [(), (-(2**63), 2**63 - 1)])
def test_covisibility_sends_a_list_to_a_group(spark, ends):
    """Points seen by 20 neighbouring views each, some twice: a list went to each view of a point. Two views with numbers
    far from all others leave the others in one step, which is dealt by hash."""
    seen = [(v % 400 - 50, p) for p in range(1500) for v in range(p * 7 % 380, p * 7 % 380 + 20)] + [(v, p) for v in ends for p in range(3)]
    seen += seen[::50]
    obs = spark.createDataFrame(seen, "view long, point long").repartition(4).cache()
    obs.count()
    got, want, by = [], {}, {}
    n = sent(spark, lambda: got.extend(pairs.covisibility(obs, diagonal=True).collect()))
    for v, p in seen:
        by.setdefault(p, []).append(v)
    for views in by.values():
        for a in views:
            for b in views:
                want[a, b] = want.get((a, b), 0) + 1
    assert {(r.v1, r.v2): r.n for r in got} == want and len(got) == len(want)
    assert {(r.v1, r.v2): r.n for r in pairs.covisibility(obs, least=3).collect()} == {(a, b): c for (a, b), c in want.items() if a != b and c >= 3}
    assert n < len(seen) + 1500 * (4 if ends else 2) + 1000
    assert pairs.covisibility(obs.where("view > 1000 and view < 1000")).count() == 0


def test_pairs_with_few_matches_are_not_gathered(spark):
    """400 pairs of 20 matches each cannot have 27 inliers; one pair has 30 matches and two that are not finite."""
    few = spark.range(400 * 20).select((F.col("id") % 400).alias("a"), F.lit(1000).cast("long").alias("b"), *[F.rand(i).alias(c) for i, c in enumerate(("xa", "ya", "xb", "yb"))])
    one = [(1, 2, float(i), float(i * i % 17), float(i), float(i * i % 17) + 2.0 * i) for i in range(30)] + [(1, 2, None, 0.0, 0.0, 0.0), (1, 2, float("nan"), 0.0, 0.0, 0.0)]
    m = few.union(spark.createDataFrame(one, "a long, b long, xa double, ya double, xb double, yb double"))
    found = kernels.estimate_fundamental(m, least=8)
    assert {r.n for r in found.where("b = 2").collect()} <= {32} and "n" in found.columns
    got = kernels.estimate_fundamental(m)
    assert sent(spark, lambda: got.collect()) < 200


def test_dealt_join_of_few_values(spark):
    large, small = spark.range(9000).select(F.col("id").alias("p"), (F.col("id") % 3).alias("m")), spark.range(30).select(F.col("id").alias("v"), (F.col("id") % 3).alias("m"))
    want = {(p, v) for p in range(9000) for v in range(30) if p % 3 == v % 3}
    for limit in (100, 0):
        got = dealt_join(large, small, "m", limit)
        assert {(r.p, r.v) for r in got.select("p", "v").collect()} == want
    assert dealt_join(large.repartition(1), small, "m").rdd.getNumPartitions() == 3


@pytest.mark.parametrize("limit", [10_000, 0])
def test_dealt_join_comes_in_runs(spark, limit):
    """Rows of the small side come with runs of the other, in order, and are not sent for each part of it; some have no partner."""
    large = spark.range(18_000).select(F.col("id").alias("p"), (F.col("id") * 7 % 101).alias("z"), F.expr("nullif(id % 4, 3)").alias("m"))
    small = spark.range(2000).select(F.col("id").alias("v"), F.expr("nullif(id % 5, 4) + 1").alias("m"))
    got = []
    n = sent(spark, lambda: got.append(dealt_join(large, small, "m", limit, near=("z",)).select("v", "p", "z").toArrow().to_pandas()))
    rows = got[0]
    pairs = {(v, p) for v in range(2000) for p in range(0, 18_000, 999) if v % 5 != 4 and v % 5 + 1 == p % 4 != 3}
    assert len(rows) == 2 * 400 * 4500 == len(rows.drop_duplicates(["v", "p"])) and pairs == set(map(tuple, rows[rows.p % 999 == 0][["v", "p"]].itertuples(index=False)))
    assert (rows.v.diff() != 0).sum() < len(rows) / 32
    assert ((rows.z.diff() < 0) & (rows.v.diff() == 0)).sum() < len(rows) / 32
    assert n < 21_000 + 2000


def test_band_counts_make_a_row_a_query(spark):
    """Against all lines and keys; keys that several lines of a query meet count once; the candidates were rows."""
    import random

    from vistrack.operators import guided

    rng = random.Random(4)
    keys = [(1, i % 90, float(rng.randint(0, 300)), float(rng.randint(0, 200))) for i in range(300)] + [(1, 0, 5.0, 5.0)] * 2 + [(9, 1, 1.0, 1.0)]
    lines = [(1, q % 40, rng.uniform(-1, 1), rng.uniform(-1, 1), rng.uniform(-90, 90)) for q in range(100)] + [(1, 77, 0.0, 0.0, 1.0), (1, 78, 1.0, 0.0, 500.0), (5, 79, 1.0, 0.0, 1.0)]
    lined = spark.createDataFrame(lines, "target_view long, q long, la double, lb double, lc double").repartition(4).cache()
    placed = spark.createDataFrame(keys, "view long, key long, x double, y double").repartition(4).cache()
    lined.count(), placed.count()
    want = {}
    for v, q, a, b, c in lines:
        for w, k, x, y in keys:
            if v == w and (a or b) and (d := abs(a * x + b * y + c) / (a * a + b * b) ** 0.5) < 4.0:
                want.setdefault(q, {}).setdefault((k, x, y), []).append(d)
    for block in (16, 8192):
        got = {}
        n = sent(spark, lambda block=block, got=got: got.update({r.q: (r.n, r.first, round(r.nearest, 9)) for r in guided.band_counts(lined, placed, 4.0, ["q"], ["key", "x", "y"], block).collect()}))
        assert got == {q: (len(m), min(m)[0], round(min(map(min, m.values())), 9)) for q, m in want.items()} and len(want) > 30
    assert n < 4 * (len(keys) + len(lines))
