"""User steps, filtered scans, repairs in rounds, and what a failed pipeline
leaves."""

import json

import pytest
from pyspark.sql import functions as F

from sparkmend.operators import evaluate as EV
from sparkmend.operators import fixes as FX
from sparkmend.operators import profile as P
from sparkmend.operators.udf import user_transform
from sparkmend.plans import pipeline as PL
from sparkmend.plans.pipeline import run_pipeline
from sparkmend.sources import io

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_filters_reach_the_scan_and_mind_nan(spark):
    df = io.table(spark, SF, "lineitem", where=[("l_quantity", "<", 10), ("l_returnflag", "in", ["R", "N"])])
    pushed = next(line for line in plan(df).splitlines() if "PushedFilters" in line)
    assert "LessThan(l_quantity,10" in pushed and "In(l_returnflag" in pushed
    nan = spark.createDataFrame([(1, float("nan")), (2, 5.0), (3, None), (4, 50.0)], "k int, x double")
    path = io.write_report(nan, f"{spark.sparkContext.getCheckpointDir()}/nan-scan")
    for how, value, want in ((">", 10, {4}), (">=", 5, {2, 4}), ("<", 10, {2}), ("=", 5.0, {2}), ("in", [50.0], {4})):
        assert {r["k"] for r in io.load(spark, path, where=[("x", how, value)]).collect()} == want


@pytest.mark.parametrize("batches", ["pandas", "arrow"])
def test_batch_steps_run_once_and_report_errors(spark, batches):
    df = spark.range(1000, numPartitions=4).withColumn("x", F.col("id") * 1.5)
    ran = spark.sparkContext.accumulator(0)

    def step(parts):
        for b in parts:
            ran.add(len(b) if batches == "pandas" else b.num_rows)
            if batches == "pandas":
                yield b.assign(y=b["x"] + 1)
            else:
                yield b.append_column("y", b.column("x"))

    out, err = user_transform(df, step, "id long, x double, y double", batches=batches)
    assert err is None and out.columns == ["id", "x", "y"]
    assert out.count() == 1000 and out.agg(F.sum("y")).first()[0] > 0
    assert ran.value == 1000  # the checked run is the only one

    def bad(parts):
        for b in parts:
            ids = b["id"].tolist() if batches == "pandas" else b.column("id").to_pylist()
            if 777 in ids:
                raise ValueError("row 777 is odd\nsecond line")
            yield b

    same, err = user_transform(df, bad, "id long, x double", batches=batches)
    assert err == "ValueError: row 777 is odd" and same is df
    lazy, err = user_transform(df, bad, "id long, x double", check=False, batches=batches)
    assert err is None and lazy.columns == ["id", "x"]


def test_steps_that_are_no_steps(spark):
    df = spark.range(3)
    assert "should have been DataFrame" in user_transform(df, lambda d: 5)[1]
    assert "no_such" in user_transform(df, lambda d: d.select("no_such"))[1]
    assert user_transform(df, lambda parts: ([1] for _ in parts), "id long")[1].startswith("TypeError")
    assert user_transform(df, lambda parts: (p.rename(columns={"id": "z"}) for p in parts), "id long")[1].startswith("KeyError")
    out, err = user_transform(df, lambda d: d.withColumn("y", F.raise_error(F.lit("late"))))
    assert err is not None and out is df


def test_repair_statistics_are_read_in_rounds(spark, monkeypatch):
    """Casts, medians, fences and scales of many columns: the passes do not
    grow with the columns."""
    from pyspark.sql.classic.dataframe import DataFrame

    counts = {}
    real = DataFrame.collect

    def run(n):
        cols = [F.when(F.xxhash64("id", F.lit(i)) % 7 != 0, (F.xxhash64("id", F.lit(i)) % 1000) / 10.0).alias(f"c{i}") for i in range(n)]
        df = spark.range(2000).select("id", *cols, F.col("id").cast("string").alias("txt"), (F.col("id") % 9 == 0).cast("int").alias("y"))
        steps = [{"action": "cast_numeric", "col_name": "txt", "params": "{}"}]
        for action, params in (("impute_median", "{}"), ("clip_iqr", '{"k": 1.5}')):
            steps += [{"action": action, "col_name": f"c{i}", "params": params} for i in range(n)]
        steps += [{"action": "standard_scale", "col_name": None, "params": "{}"}, {"action": "balanced_weights", "col_name": "y", "params": "{}"}]
        passes = []
        monkeypatch.setattr(DataFrame, "collect", lambda self: passes.append(1) or real(self))
        out = FX.apply_fixes(df, steps, "y", key="id")
        monkeypatch.undo()
        counts[n] = len(passes)
        return df, out

    run(2)
    df, out = run(12)
    assert counts[12] == counts[2] <= 7
    # the same as one step at a time
    one = FX.impute(df, ["c3"], "median")
    one = FX.clip_outliers(one, ["c3"], k=1.5)
    one = FX.scale(one, ["c3"], "standard").select("id", F.col("c3").alias("want"))
    gap = out.join(one, "id").agg(F.max(F.abs(F.col("c3") - F.col("want"))), F.count("*")).first()
    assert gap[0] < 1e-9 and gap[1] == 2000
    assert out.where("txt is null").count() == 0 and "weight" in out.columns


@pytest.mark.parametrize("order", [["impute_median", "clip_iqr"], ["clip_iqr", "impute_median"]])
@pytest.mark.parametrize("rows", [[1.0], [None, 5.0], [1.0, 2.0, None, 100.0, None, None, 3.0], [None, None], [4.0] * 5 + [None] * 9 + [9.0]])
def test_fused_fences_equal_the_steps(spark, order, rows):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "id long, x double")
    want = df
    for a in order:
        want = FX.impute(want, ["x"], "median") if a == "impute_median" else FX.clip_outliers(want, ["x"], k=0.5)
    got = FX.apply_fixes(df, [{"action": a, "col_name": "x", "params": json.dumps({"k": 0.5})} for a in order], "id")
    assert [r["x"] for r in got.orderBy("id").collect()] == pytest.approx([r["x"] for r in want.orderBy("id").collect()], nan_ok=True)


def test_failed_pipeline_leaves_its_last_good_frame(spark, monkeypatch):
    ev = io.inject_nulls(io.table(spark, SF, "events"), {"user_id": 0.05}, "event_id")
    none = run_pipeline(ev, "no_such_target", "event_id")
    assert none["summary"].collect()[-1]["status"] == "error" and none["final"].count() == ev.count() and none["final"].columns == ev.columns

    def broken(*_args):
        raise RuntimeError("filter failed")

    monkeypatch.setattr(PL.C, "filter_features", broken)
    res = run_pipeline(ev, "value", "event_id")
    last = res["summary"].collect()[-1]
    assert last["stage"] == "pipeline" and "filter failed" in last["detail"]
    final = res["final"]
    assert final.where("user_id is null").count() == 0 and any(c.startswith("event_type_") for c in final.columns) and "is_test" not in final.columns


def test_task_type_reads_few_values(spark):
    many = spark.range(100_000, numPartitions=4).withColumn("t", F.col("id") % 3)
    assert P.task_type(many, "id").first().asDict() == {"n_distinct": 11, "task_type": "regression"}
    assert P.task_type(many, "t").first().asDict() == {"n_distinct": 3, "task_type": "classification"}
    assert P.task_type(many.limit(0), "t").first().asDict() == {"n_distinct": 0, "task_type": "classification"}
    assert P.some_values(many, "id", 11).count() <= 44  # 11 of each task at most
    nulls = spark.createDataFrame([(None,), (1.5,), (None,)], "x double")
    assert P.detect_task(nulls, "x") == "classification"


def test_scorecards_of_bad_repairs(spark):
    df = spark.range(200).select("id", F.when(F.col("id") % 5 != 0, F.col("id") * 1.0).alias("x"), F.concat(F.lit("t"), F.col("id") % 3).alias("t"), (F.col("id") % 2).alias("y"))
    good = [{"action": "impute_median", "col_name": "x", "params": "{}"}, {"action": "one_hot", "col_name": "t", "params": "{}"}]
    points = {r["check"]: r["points"] for r in EV.grade_missing(df, good, "y", "id").collect()}
    assert points == {"runs": 0.2, "nulls_cleared": 0.4, "model_trains": 0.4, "total": 1.0}
    left = {r["check"]: (r["passed"], r["detail"]) for r in EV.grade_missing(df, lambda d: d, "y", "id").collect()}
    assert left["runs"][0] and not left["nulls_cleared"][0] and "text_feature: t" in left["model_trains"][1]
    fails = {r["check"]: r["passed"] for r in EV.grade_missing(df, lambda d: d.select("gone"), "y", "id").collect()}
    assert not any(fails.values())
    flat = spark.range(500).select("id", (F.col("id") % 7).alias("a"), (F.col("id") % 7 + 10.0).alias("y"))
    skew = {r["check"]: r["passed"] for r in EV.grade_skew(flat, ["a"], "y", "id").collect()}
    assert not skew["log_target"] and not skew["rmsle"]
