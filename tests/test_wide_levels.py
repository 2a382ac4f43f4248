"""The filter counts the levels of text columns, however many there are."""

import pytest
from pyspark.sql import functions as F

from sparkmend.operators import correlate as C
from sparkmend.operators import fixes as FX
from sparkmend.plans.pipeline import run_pipeline


def table(spark, wide):
    """``wide`` levels of t, one of them with a fifth of the rows and a larger y."""
    hot = F.xxhash64("id", F.lit(1)) % 5 == 0
    df = spark.range(4 * wide).withColumn("t", F.when(hot, "zz").otherwise(F.concat(F.lit("l"), F.col("id") % wide)))
    df = df.withColumn("s", F.when(F.col("id") % 7 > 0, F.concat(F.lit("s"), F.col("id") % 3))).withColumn("x", F.pmod(F.xxhash64("id"), F.lit(1000)) / 10.0)
    y = F.col("x") + F.when(F.col("t") == "zz", 300.0).otherwise(0.0) + F.when(F.col("s") == "s1", 100.0).otherwise(0.0)
    return df.withColumn("y", F.when(F.col("id") % 50 > 0, y))


def test_pipeline_filters_every_level(spark):
    """More levels than ``MAX_LEVELS`` are features of the filter, as few are."""
    wide = FX.MAX_LEVELS + 150
    res = run_pipeline(table(spark, wide), "y", "id", candidate_kinds=())
    last = res["summary"].collect()[-1]
    assert last["stage"] == "filter" and last["status"] == "ok"
    report = {r["col_name"]: r["status"] for r in res["drop_report"].collect()}
    assert sum(c.startswith("t_") for c in report) > FX.MAX_LEVELS
    assert report["t_zz"] == "kept" and report["t_l5"] == "low_target_corr" and "'t_l5'" in last["detail"]
    assert {"t_zz", "s_s1"} <= set(res["final"].columns) and not {"t", "t_vec", "is_test"} & set(res["final"].columns)
    assert last["value"] == sum(s == "kept" for s in report.values())


@pytest.mark.parametrize("target", ["y", "label"])
def test_levels_equal_their_columns(spark, target):
    df = table(spark, 120).withColumn("label", F.concat(F.lit("c"), F.col("id") % 2)).withColumn("is_test", F.col("id") % 9 == 0).withColumn("copy", F.col("x") * 2)
    df = df.withColumn("none", F.lit(None).cast("string")).withColumn("one", F.lit("same")).cache()
    text = ["t", "none", "s", "one"]
    want = C.filter_features(FX.one_hot(df, text, max_levels=None, fit_on=df.where("NOT is_test")), target)
    got = C.filter_features(df, target, C.DEFAULT_CORR, text, ~F.col("is_test"))
    df.unpersist()
    assert got[0].columns == want[0].columns and got[1] == want[1] and got[1]["n_features_before"] > 100
    for g, w in zip(got[2:], want[2:], strict=True):
        assert sorted(map(tuple, g.collect())) == sorted(map(tuple, w.collect()))
    assert sorted(map(str, got[0].collect())) == sorted(map(str, want[0].collect()))


def test_few_features_with_levels_are_unchanged(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "b"), (4.0, "a"), (3.0, None)], "y double, t string")
    out, report, drops, _heat = C.filter_features(df, "y", C.DEFAULT_CORR, ["t"])
    assert out.columns == ["y", "t_b"] and report["kept_features"] == ["t_b"] and drops.count() == 1
    assert [r["t_b"] for r in out.orderBy("y").collect()] == [0, 1, 0, 0]
