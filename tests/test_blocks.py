"""What a search sends: blocks of images, not tiles; results do not depend on either."""

import numpy as np
import pytest
from test_search import KEYS, plain_two, rows

from vistrack.operators import search


def sent(spark, run) -> int:
    """Shuffled rows of the stages that run() makes."""
    sc, seen = spark.sparkContext, set()
    none = sc._jvm.java.util.ArrayList

    def stages():
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        found = sc._jsc.sc().statusStore().stageList(none(), False, False, sc._gateway.new_array(sc._jvm.double, 0), none())
        return [((x.stageId(), x.attemptId()), x.shuffleWriteRecords()) for x in sc._jvm.scala.jdk.javaapi.CollectionConverters.asJava(found)]

    seen = {s for s, _ in stages()}
    run()
    return sum(n for s, n in stages() if s not in seen)


@pytest.mark.parametrize("block", [16, 25])
def test_blocks_do_not_matter(spark, block):
    """Images of several blocks, partners that share a task, repeated ids."""
    a, b, c = rows(40, 1, seed=1), rows(37, 2, seed=2, base=100), rows(6, 3, seed=3, base=500)
    keys = spark.createDataFrame(a + b + c, KEYS)
    pairs = spark.createDataFrame([(1, 2), (3, 1), (1, 3), (3, 2)], "a long, b long")
    of = {1: a, 2: b, 3: c}
    got = search.nearest_two_tiled(pairs, keys, keys, tile=4, block=block).collect()
    for x, y in ((1, 2), (3, 1), (1, 3), (3, 2)):
        assert {r.ka: (r.kb, r.d1, r.d2, r.n) for r in got if (r.a, r.b) == (x, y)} == plain_two(of[x], of[y])
    asked = [(1, 2, k) for k in range(0, 40, 3)] + [(3, 1, 501), (1, 3, 7)]
    got = search.nearest_two_tiled(pairs, keys, keys, queries=spark.createDataFrame(asked, "a long, b long, ka long"), tile=4, block=block).collect()
    assert sorted((r.a, r.b, r.ka) for r in got) == sorted(asked)
    for r in got:
        assert (r.kb, r.d1, r.d2, r.n) == plain_two([x for x in of[r.a] if x[1] == r.ka], of[r.b])[r.ka]
    twice = spark.createDataFrame([(1, 7, [0.0]), (1, 7, [5.0]), (2, 1, [1.0]), (2, 2, [5.5])], KEYS)
    (r,) = search.nearest_two_tiled(spark.createDataFrame([(1, 2)], "a long, b long"), twice, twice, tile=1).collect()
    assert (r.ka, r.kb, r.d1, r.d2, r.n) == (7, 2, 0.25, 1.0, 4)


def test_small_tiles_send_no_more(spark):
    """Keys went to every tile of their partners: 2 x 320 x 320 / 8 rows."""
    rng = np.random.default_rng(3)
    keys = spark.createDataFrame([(1 + i // 320, i, v) for i, v in enumerate(rng.normal(size=(640, 4)).tolist())], KEYS).cache()
    keys.count()
    pairs = spark.createDataFrame([(1, 2)], "a long, b long")
    assert sent(spark, lambda: search.nearest_two_tiled(pairs, keys, keys, tile=8).count()) < 4 * 640


def test_track_parents_searches_once(spark, small, monkeypatch):
    """The matches were searched for the stars and for the components."""
    from vistrack import catalog

    calls, plain = [], search.nearest_two_tiled
    monkeypatch.setattr(search, "nearest_two_tiled", lambda *args, **options: calls.append(1) or plain(*args, **options))
    catalog.queries()["track_parents"](spark, small).count()
    assert len(calls) == 1
