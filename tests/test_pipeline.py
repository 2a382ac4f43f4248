"""The reference's end-to-end expectations restated on a planted-fault
table: a near copy of a feature is dropped as redundant, a noise column
as weak, the target is kept, fewer columns remain, and the pipeline
summary reports every stage."""

from pyspark.sql import functions as F

from sparkmend.functions.exprs import row_hash
from sparkmend.operators import correlate as C
from sparkmend.operators import evaluate as EV
from sparkmend.operators import features as FE
from sparkmend.operators import profile as P
from sparkmend.plans.pipeline import run_pipeline
from sparkmend.sources import io

SF = "/root/testdata/sf0.01"


def planted(spark):
    o = io.table(spark, SF, "orders")
    noise = (row_hash(["o_orderkey"], 42, "noise") % 100000) / 100000.0
    jitter = (row_hash(["o_orderkey"], 42, "jit") % 1000) / 1000.0 - 0.5
    return (
        o.withColumn("price_k", F.col("o_totalprice") / 1000.0 + jitter)
        .withColumn("price_k_copy", F.col("price_k") + jitter * 0.01)
        .withColumn("random_noise", noise)
        .withColumn("target", F.col("o_totalprice") * 0.5 + noise * 10)
        .drop("o_totalprice")
    )


def test_correlation_filter_checks(spark):
    df = planted(spark)
    out, report, drop_report, heat = C.filter_features(df, "target")
    assert "random_noise" in report["dropped_low_target_corr"]
    assert "price_k" in report["dropped_redundant"] or "price_k_copy" in report["dropped_redundant"]
    assert "target" in out.columns
    assert len(out.columns) < len(df.columns)
    assert set(r["col_name"] for r in drop_report.collect()) == set(report["target_correlations"])
    assert heat.count() == len([c for c in out.columns if c in ("price_k", "price_k_copy", "target", "o_orderkey", "o_custkey")]) ** 2
    for s in ("o_orderstatus", "o_orderpriority"):
        assert s in out.columns


def test_fewer_than_two_numeric_features_unchanged(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "b"), (3.0, "c")], "only_feat double, label string")
    out, report, _d, _h = C.filter_features(df, "label")
    assert out.columns == df.columns and report["n_features_before"] == report["n_features_after"] == 1


def test_feature_validation_rejects(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "x double")
    ok, msg = FE.validate_feature(df.columns, df.withColumn("fe_bad", F.lit(None).cast("double")))
    assert not ok and "NaN" in msg
    ok, msg = FE.validate_feature(df.columns, df.withColumn("bad_feature", F.col("x") * 10))
    assert not ok and "fe_" in msg


def test_feature_validation_sees_changed_values(spark):
    df = spark.createDataFrame([(1.0, "a", 3), (2.0, "b", 4), (None, None, 5)], "`my-col` double, s string, `a b.c` int")
    fe = lambda d: d.withColumn("fe_x", F.col("`a b.c`") + 1)
    assert FE.validate_feature(df, fe(df)) == (True, "fe_x")
    assert FE.validate_feature(df, fe(df.repartition(3).orderBy(F.desc("s")))) == (True, "fe_x")
    for c in ("my-col", "a b.c"):
        ok, msg = FE.validate_feature(df, fe(df.withColumn(c, (F.col(f"`{c}`") + 1).cast(df.schema[c].dataType))))
        assert not ok and c in msg
    ok, msg = FE.validate_feature(df, fe(df.drop("s")))
    assert not ok and "'s'" in msg
    swapped = df.select(F.when(F.col("s") == "a", 2.0).when(F.col("s") == "b", 1.0).alias("my-col"), "s", "`a b.c`")
    assert not FE.validate_feature(df, fe(swapped))[0]


def test_greedy_reads_candidates_in_blocks(spark, monkeypatch):
    """100 columns: no matrix over all candidates, the same log as in one block."""
    monkeypatch.setattr(FE, "BLOCK", 4)
    widths = []
    real = FE.level_moments
    monkeypatch.setattr(FE, "level_moments", lambda d, cols, *a: widths.append(len(cols)) or real(d, cols, *a))
    cols = [((F.xxhash64("id", F.lit(i)) % 1000) / 10.0).alias(f"c{i}") for i in range(40)]
    df = spark.range(3000).select("id", *cols).withColumn("y", F.col("c0") * F.col("c1") + F.col("c2") * F.col("c3") + F.col("c4"))
    cands = FE.candidate_features(df, "y", ("ratio", "product"), cols=[f"c{i}" for i in range(8)])
    log = FE.greedy_features(df, "y", cands, "id", task="regression")[1].collect()
    assert max(widths) <= 41 + 4 + sum(r["kept"] for r in log)
    monkeypatch.setattr(FE, "BLOCK", 1000)
    assert FE.greedy_features(df, "y", cands, "id", task="regression")[1].collect() == log
    assert any(r["kept"] and r["feature_name"] == "fe_prod_c0_c1" for r in log)


def test_wide_text_counts_in_every_score(spark):
    """1,100 levels earn what 150 do, in the fix, in the feature search and in
    the logistic fit; a test of the levels themselves is in test_levels."""
    plan = [{"seq": 1, "issue": "dtype", "col_name": "t", "action": "one_hot", "params": "{}"}]
    rewards = []
    for n in (150, 1100):
        df = spark.range(20 * n).select("id", F.concat(F.lit("l"), F.col("id") % n).alias("t"), (F.xxhash64("id") % 10).cast("double").alias("x"))
        df = df.withColumn("y", F.pmod(F.xxhash64("t"), F.lit(1000)) + F.col("x"))
        row, fixed = EV.evaluate_fix(df, plan, "y", "id", task="regression", expand=False)
        r = row.first()
        assert r["exec_error"] is None and r["n_features_after"] - r["n_features_before"] == n - 1 and "t" in fixed.columns
        rewards.append(r["reward"])
        log = FE.greedy_features(fixed, "y", {"fe_xx": (F.col("x") * F.col("x"), "x * x")}, "id", task="regression", levels=["t"])[1]
        assert abs(log.first()["metric_before"] - r["after"]) < 1e-3
    assert min(rewards) > 0.8 and abs(rewards[0] - rewards[1]) < 0.1
    c = df.withColumn("y", F.col("y") > 500).withColumn("y", F.col("y").cast("int"))
    assert EV.evaluate_fix(c, plan, "y", "id", task="classification")[0].first()["reward"] > 0.3


def test_health_and_pipeline_end_to_end(spark):
    ev = io.inject_nulls(io.table(spark, SF, "events"), {"value": 0.08, "user_id": 0.05}, "event_id")
    rep = P.health_report(ev, target="event_type", task="classification")
    kinds = {r["issue"] for r in rep.collect()}
    assert {"missing_values", "dtype"} <= kinds
    res = run_pipeline(ev, "value", "event_id")
    summ = res["summary"].collect()
    assert [r["stage"] for r in summ] == ["task", "profile", "plan", "repair", "features", "filter"], summ
    ev_row = res["evaluation"].first()
    assert ev_row["task_type"] == "regression" and ev_row["reward"] >= 0 and isinstance(ev_row["improved"], bool)
    assert res["features_log"].count() >= 1


def test_evaluate_reports_failures(spark):
    ev = io.table(spark, "/root/testdata/sf0.001", "events")
    row, _fixed = EV.evaluate_fix(ev, lambda d: d.withColumn("x", F.col("no_such_column")), "value", "event_id", task="regression")
    r = row.first()
    assert r["exec_error"] is not None and r["reward"] == 0.0 and r["before"] == r["after"]
