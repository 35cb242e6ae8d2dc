"""Vectors of windows move whole and once."""

from trackscore.plans import model_queries, track_queries

SMOKE = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_dimensions_become_rows_after_the_last_shuffle(spark):
    plan = plan_of(track_queries.zscore_windows(spark, SMOKE))
    assert plan.index("posexplode") < plan.index("Exchange")


def test_training_and_scoring_read_kept_windows(spark):
    rows = model_queries.sequence_rows(spark, SMOKE)
    assert "Exchange" not in plan_of(rows)
    first = rows.first()
    assert len(first.feature) == 16 and len(first.feature[0]) == 64 and first.fold in ("train", "val")
