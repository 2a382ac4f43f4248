import hashlib
import string

import pytest

from sparkmend.llm.exact_dedup import exact_dedup

LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(LOW), []).append(i)
    return {k: (max((x for x in v if x is not None), default=None), len(v)) for k, v in groups.items()}


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return [tuple(r) for r in exact_dedup(df, **kw).select("doc_id", "text", "keep_id", "group_size", "kept", "text_sha256").collect()]


def test_against_brute_force_with_hot_group(spark):
    rows = [(i, "Same COPY" if i % 3 == 0 else f"text {i // 2} É") for i in range(3000)]
    rows += [(5000, None), (5001, ""), (None, ""), (7, "text 3 é"), (9000, "same copy"), (9000, "SAME copy")]
    want = brute(rows)
    got = run(spark, rows)
    assert len(got) == len(rows)
    kept = {}
    for i, t, keep, n, k, sha in got:
        key = (t or "").translate(LOW)
        assert (keep, n) == want[key]
        assert sha == hashlib.sha256(key.encode()).hexdigest()
        if k:
            assert key not in kept and i == keep
            kept[key] = i
    assert set(kept) == set(want)


def test_smallest_nulls_ties_and_empty(spark):
    got = run(spark, [(3, "a"), (1, "A"), (None, "a")], keep="smallest")
    assert sorted((i or 0, keep, n, k) for i, _, keep, n, k, _ in got) == [(0, 1, 3, False), (1, 1, 3, True), (3, 1, 3, False)]
    got = run(spark, [(None, "x"), (None, "x")])
    assert sorted(r[4] for r in got) == [False, True]
    assert run(spark, []) == []
    with pytest.raises(ValueError):
        run(spark, [], keep="any")


def test_clashing_columns_are_dropped_and_others_kept(spark):
    df = spark.createDataFrame([(1, "a", "x", "y"), (2, "A", "x", "y")], "doc_id int, text string, kept string, salt string")
    out = exact_dedup(df)
    assert out.columns == ["doc_id", "text", "salt", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted((r["doc_id"], r["kept"], r["salt"]) for r in out.collect()) == [(1, False, "y"), (2, True, "y")]


def test_plan_is_native_with_one_range_exchange_of_texts(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id bigint, text string")
    plan = exact_dedup(df)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in plan
    assert "Python" not in plan and "ArrowEval" not in plan
