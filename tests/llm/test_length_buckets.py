import itertools
import random
import re

import numpy as np
from pyspark.sql import functions as F

from sparkmend.llm import length_buckets as lb


def padding(lengths, counts, bounds):
    return sum(int(c) * (min(b for b in bounds if b >= n) - int(n)) for n, c in zip(lengths, counts))


def test_boundaries_are_optimal():
    r = random.Random(5)
    for _ in range(60):
        at = np.array(sorted(r.sample(range(1, 60), r.randrange(1, 9))))
        counts = np.array([r.randrange(1, 30) for _ in at])
        for k in (1, 2, 3, 5, 20):
            got = lb.optimal_boundaries(at, counts, k)
            assert got == sorted(set(got)) and got[-1] == at[-1] and len(got) <= k
            best = min(
                padding(at, counts, [*c, at[-1]]) for m in range(min(k, len(at))) for c in itertools.combinations(at[:-1], m)
            )
            assert padding(at, counts, got) == best
    assert lb.optimal_boundaries(np.zeros(0, int), np.zeros(0, int), 4) == []


def test_batches_are_full_and_within_budget(spark, small_docs, monkeypatch):
    monkeypatch.setattr(lb, "GROUP", 16)
    rows = [(r["doc_id"], r["text"]) for r in small_docs.collect()] + [(7000, None), (7001, ""), (None, "a b"), (7001, ""), (7002, "w " * 5000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as bucket", "2 as num")
    got = lb.pack(df, buckets=5, budget=2000).collect()
    want = [(-1 if d is None else d, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) + 1) for d, t in rows]
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"]) for r in got) == sorted(want)
    n = sorted(r["n_tokens"] for r in got)
    at, counts = np.unique(n, return_counts=True)
    assert sorted({r["bucket_len"] for r in got}) == lb.optimal_boundaries(at, counts, 5)
    for b in {r["bucket"] for r in got}:
        own = [r for r in got if r["bucket"] == b]
        size = own[0]["bucket_len"]
        each = max(1, 2000 // size)
        assert all(r["bucket_len"] == size and r["padding"] == size - r["n_tokens"] >= 0 for r in own)
        assert sorted((r["batch_id"], r["slot"]) for r in own) == [(i // each, i % each) for i in range(len(own))]
    assert lb.pack(df.limit(0)).collect() == []


def test_boundaries_of_very_many_lengths(spark):
    n = [*range(1, 61), 5000]
    df = spark.createDataFrame([(i, "w " * (x - 1)) for i, x in enumerate(n)], "doc_id bigint, text string")
    at, counts = np.array(n), np.ones(len(n), int)
    got = sorted({r["bucket_len"] for r in lb.pack(df, buckets=4).collect()})
    best = min(padding(at, counts, [*c, 5000]) for c in itertools.combinations(n[:-1], 3))
    assert len(got) == 4 and padding(at, counts, got) == best


def test_equal_rows_are_dealt_over_the_groups(spark, monkeypatch):
    """Null ids and one length: many groups, none with most rows, batches full."""
    monkeypatch.setattr(lb, "GROUP", 500)
    df = spark.range(8000).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit("one two three").alias("text"))
    sizes = []
    real = lb.assign

    def watched(lengths, *args):
        by = F.pmod(F.xxhash64("id", "n_tokens", "row"), F.lit(16))
        sizes.extend(r["count"] for r in lengths.groupBy(by).count().collect())
        return real(lengths, *args)

    monkeypatch.setattr(lb, "assign", watched)
    got = lb.pack(df, budget=30).collect()
    assert len(sizes) == 16 and max(sizes) < 800 and len(got) == 8000
    batches = {}
    for r in got:
        batches.setdefault((r["bucket"], r["batch_id"]), []).append(r["slot"])
    each = max(map(len, batches.values()))
    assert all(sorted(v) == list(range(len(v))) for v in batches.values()) and sum(len(v) < each for v in batches.values()) <= 1
