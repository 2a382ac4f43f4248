"""Sources and sinks: parquet / csv / json / orc load with NaN -> NULL, and
report writing into the session's checkpoint folder."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from sparkmend.session import ensure_checkpoint_dir
from sparkmend.sources import io


@pytest.mark.parametrize("fmt", ["csv", "json", "orc", "parquet"])
def test_load_formats_normalise_nan(spark, fmt):
    base = ensure_checkpoint_dir(spark)
    path = os.path.join(base, "src-test", f"{fmt}-{uuid.uuid4().hex}")
    df = spark.createDataFrame([(1, float("nan"), "a"), (2, 2.5, None)], "k int, x double, s string")
    w = df.write.mode("overwrite")
    (w.option("header", "true") if fmt == "csv" else w).format(fmt).save(path)
    got = io.load(spark, path, fmt=fmt, target="x")
    rows = sorted(got.collect(), key=lambda r: r["k"])
    if dict(got.dtypes)["x"] == "string":
        # JSON has no NaN: Spark writes the text "NaN", inference reads a text
        # column -- exactly the fault the wrong-dtype check reports
        from sparkmend.operators import profile as P

        assert [r["col_name"] for r in P.wrong_dtypes(got, ["x"]).collect()] == ["x"]
        return
    assert rows[0]["x"] is None and float(rows[1]["x"]) == 2.5
    with pytest.raises(ValueError):
        io.load(spark, path, fmt=fmt, target="nope")


def test_write_report_roundtrip(spark):
    base = ensure_checkpoint_dir(spark)
    rep = spark.createDataFrame([("missing_values", "x", 3.0, None)], "issue string, col_name string, value double, detail string")
    path = io.write_report(rep, os.path.join(base, "reports", uuid.uuid4().hex))
    assert spark.read.parquet(path).collect() == rep.collect()


def test_sample_n_is_seeded_and_exact(spark):
    ev = io.table(spark, "/root/testdata/sf0.001", "events")
    a = [r["event_id"] for r in io.sample_n(ev, 100, "event_id", 7).collect()]
    b = [r["event_id"] for r in io.sample_n(ev.repartition(5), 100, "event_id", 7).collect()]
    assert len(a) == 100 and sorted(a) == sorted(b)
    assert io.sample_n(ev, 10**6, "event_id").count() == ev.count()


def test_inject_scale_dtype_tail(spark):
    docs = io.table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", F.col("n_chars").cast("double").alias("n"))
    t = io.inject_tail(docs, "n", "doc_id")
    joined = docs.join(t.withColumnRenamed("n", "t"), "doc_id")
    assert joined.where("t < n").count() == 0 and joined.where("t > n").count() > 0
    assert dict(io.inject_dtype(docs, "n").dtypes)["n"] == "string"
