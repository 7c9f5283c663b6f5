"""A score finds its bin by halving, also among thousands, bounds and null included."""

import numpy as np
import pandas as pd
from corpuslens.operators import calibration as B


def test_bins_by_halving(spark):
    counts = {"a": 1, "b": 2, "c": 3, "d": 3001}
    bins = [(p, i, float(2 * i + 1) if i < n - 1 else None, (i + 1) / (n + 1)) for p, n in counts.items() for i in range(n)]
    asked = [(p, x) for p, n in counts.items() for x in [None, float("nan"), -5.0, *np.arange(0, 2 * n + 2, 0.5).tolist()]]
    scores = spark.createDataFrame([(p, True, x) for p, x in asked], "profile string, higher_is_better boolean, score double")
    found = B.calibrated(scores, spark.createDataFrame(bins, "profile string, bin int, upper double, probability double"))
    assert "filter(_bins" not in found._jdf.queryExecution().optimizedPlan().toString()  # one look at each bin of a profile
    got = sorted((r.profile, str(r.score), r.probability) for r in found.collect())
    want = []
    for p, x in asked:
        n = counts[p]
        at = n - 1 if x is None or np.isnan(x) else int(np.searchsorted(np.arange(n - 1) * 2.0 + 1, x, side="left"))
        want.append((p, str(x), (at + 1) / (n + 1)))
    pd.testing.assert_frame_equal(pd.DataFrame(got), pd.DataFrame(sorted(want)))
