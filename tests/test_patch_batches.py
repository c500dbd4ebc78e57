import numpy as np
import pytest

from tilewright import catalog
from tilewright.operators import lifting


@pytest.mark.parametrize("name", ["lifted_patches", "lifted_details", "root_fragments"])
def test_heights_are_compiled_and_spread(spark, name):
    """Heights come from expressions of the row, not from lambdas over places, and rows are dealt out first."""
    plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(sequence" not in plan and "filter(sequence" not in plan and "transform([0,1,2" not in plan and "RepartitionByExpression" in plan


def test_sizes_in_one_batch(spark):
    """Patches of several sizes, lossless and not, each as the kernels give it alone."""
    r = np.random.default_rng(8)
    given = {k: (r.integers(-500, 500, (n + 1, n + 1)), r.integers(-500, 500, (n, n))) for k, n in enumerate([1, 2, 8, 2, 3, 8, 1])}
    rows = spark.createDataFrame([(k, p.ravel().tolist(), q.ravel().tolist()) for k, (p, q) in given.items()], "patch long, corners array<long>, centres array<long>").coalesce(1)
    for tolerance in (0, 2):
        got = {g["patch"]: g for g in lifting.lift_patches(rows, tolerance).collect()}
        assert set(got) == set(given)
        for k, (p, q) in given.items():
            low, details = lifting.analyse(p, q)
            codes = lifting.quantise(details, tolerance)
            back = lifting.synthesise(low, lifting.dequantise(codes, tolerance))
            assert got[k]["low"] == low.ravel().tolist() and got[k]["codes"] == codes.ravel().tolist()
            assert got[k]["error"] == max(np.abs(back[0] - p).max(), np.abs(back[1] - q).max())
