import numpy as np
import pytest
from rows import plain

from vistrack import catalog


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, small, duck, name):
    got, want = catalog.queries()[name](spark, small).toPandas(), duck.sql(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_registered_cameras_are_the_true_ones(spark, small):
    pt, cams, _ = catalog.synthetic(spark, small)
    true = {r.view: r for r in cams.collect()}
    got = catalog.queries()["register_images"](spark, small).collect()
    assert len(got) == len(true)
    for r in got:
        t = true[r.view]
        assert abs(r.f - t.f) < 1e-3 and all(abs(x - y) < 1e-3 for x, y in zip([*r.r, *r.t], [*t.r, *t.t], strict=True))


def test_fundamental_matrices_are_the_cameras_ones(spark, small):
    from vistrack.functions import kernels
    from vistrack.plans import reconstruct

    m = catalog.planted_matches(spark, small)
    got = {(r.a, r.b): np.array(r.f) for r in kernels.estimate_fundamental(m, threshold=0.01).collect()}
    _, cams, _ = catalog.synthetic(spark, small)
    true = {(r.a, r.b): np.array(r.f) for r in reconstruct.with_fundamental(m.select("a", "b").distinct(), cams).collect()}
    assert got and set(got) <= set(true)
    off = {k: min(np.abs(f - true[k]).max(), np.abs(f + true[k]).max()) for k, f in got.items()}
    assert max(off.values()) < 1e-5


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "unique_pairs" in e.queries()
