"""Published verdicts of twenty labelled episodes, at their two decimals."""

import pytest

from reelmark.operators import evaluation as ev
from reelmark.operators import fusion

# Label, late score, box score, whether anything was held, published fused score.
EPISODES = """
f 0.06 1.00 1 0.52
f 0.00 0.00 0 0.00
f 0.24 0.22 1 0.18
f 0.16 0.06 1 0.08
s 0.94 0.05 1 0.52
f 0.53 0.42 1 0.62
s 0.87 0.60 1 0.80
s 0.72 0.25 1 0.59
s 0.31 0.06 1 0.12
s 0.56 0.90 1 0.87
f 0.00 0.06 0 0.00
s 0.73 0.82 1 0.88
f 0.21 0.15 1 0.14
s 0.98 1.00 1 1.00
f 0.11 0.36 1 0.21
s 0.11 1.00 1 0.53
s 0.30 0.68 1 0.43
f 0.57 1.00 1 0.92
f 0.84 0.96 1 0.98
s 0.79 1.00 1 0.99
"""
THRESHOLD = 0.4171


def test_fused_scores(spark):
    rows = [(i, "success" if a == "s" else "failure", float(b), float(c), d == "1", float(e)) for i, (a, b, c, d, e) in enumerate(x.split() for x in EPISODES.split("\n") if x)]
    df = spark.createDataFrame(rows, "i int, label string, late double, seg double, hold boolean, want double")
    out = fusion.calibrated_fusion(df, late="late", seg="seg", any_hold="hold", threshold=THRESHOLD)
    got = out.collect()
    assert all(abs(r["fused_score"] - r["want"]) <= 0.011 for r in got)
    for tag in ("pred_vlm", "pred_seg", "pred_fused"):
        assert ev.accuracy(out, [], tag, "label").first()["accuracy"] == pytest.approx(0.70)
    assert tuple(ev.prevalence(out, [], "pred_fused").first()) == (20, 12, 8, 0.4)
    for score, want in (("late", 0.83), ("seg", 0.64), ("fused_score", 0.74)):
        y = out.selectExpr(score, "label = 'success' AS y")
        assert ev.auroc(y, [], score, "y").first()["auroc"] == pytest.approx(want, abs=0.011)
