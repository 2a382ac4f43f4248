"""Physical plans: pruning, pushdown, partial aggregation, no shuffles where
none are needed, no cross joins."""

from pyspark.sql import functions as F

from sparkmend.operators import fixes as FX
from sparkmend.operators import knn as K
from sparkmend.operators import profile as P
from sparkmend.operators import split as S
from sparkmend.sources import io

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scaler_keeps_pruning_and_pushdown(spark):
    li = io.table(spark, SF, "lineitem").select("l_orderkey", "l_quantity", "l_tax")
    out = FX.scale(li, ["l_quantity", "l_tax"], "standard").where("l_orderkey < 100")
    p = plan(out)
    assert "PushedFilters: [IsNotNull(l_orderkey), LessThan(l_orderkey,100)]" in p
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_tax:double>" in p
    assert "Exchange" not in p


def test_profile_aggregate_is_partial_and_pruned(spark):
    li = io.table(spark, SF, "lineitem")
    p = plan(P.missing_counts(li, ["l_quantity", "l_tax"]))
    assert p.count("HashAggregate") >= 2  # partial (map side) + final
    assert "ReadSchema: struct<l_quantity:double,l_tax:double>" in p


def test_split_and_folds_do_not_shuffle(spark):
    ev = io.table(spark, SF, "events")
    assert "Exchange" not in plan(S.train_test_split(ev, "event_id"))
    assert "Exchange" not in plan(S.kfold(ev, "event_id", 5))


def test_knn_join_is_a_grid_of_blocks(spark):
    d = S.train_test_split(io.table(spark, SF, "embeddings"), "vec_id")
    right = d.where(~F.col("is_test")).select(F.col("vec_id").alias("nb_id"), "embedding")
    p = plan(K.knn_join(d.where(F.col("is_test")), right, "vec_id", "nb_id", k=5, vec="embedding"))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    assert "FlatMapCoGroupsInArrow" in p
