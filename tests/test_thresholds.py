import re

import numpy as np
from pyspark.sql import functions as F

from clausewright.operators import evaluation


def test_curve_of_many_scores_sums_from_below(spark, tmp_path):
    scores = spark.range(6000).select((F.col("id") * 7919 % 3001 / 3001).alias("score"), F.when(F.col("id") % 11 != 0, F.col("id") % 3 == 0).alias("positive"))
    scores = scores.union(spark.createDataFrame([(None, True)], "score double, positive boolean"))
    curve = evaluation.threshold_curve(scores, str(tmp_path / "ranges"))
    frames = re.findall(r"\(RowFrame, ([^,]+), unboundedfollowing", curve._jdf.queryExecution().toString())
    assert set(frames) <= {"unboundedpreceding$()"}  # any other frame that ends at the last row is summed anew for each row
    rows = [r for r in scores.collect() if r.score is not None]
    value = np.array([r.score for r in rows])
    yes, no = (np.sort(value[[r.positive is p for r in rows]]) for p in (True, False))
    want = [(t, len(no) - int(np.searchsorted(no, t)), int(np.searchsorted(yes, t))) for t in np.unique(value).tolist()]
    assert sorted(tuple(r) for r in curve.collect()) == [(t, n, p, n + p) for t, n, p in want]
    best = min((n + p, t) for t, n, p in want)
    assert [(r.errors, r.threshold) for r in evaluation.best_cut(curve).collect()] == [best]
