import hashlib

import pytest
from pyspark.sql import functions as F

from sparkmend.llm import merkle_manifest as mm
from sparkmend.llm import queries as q

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, g string, path string, lo int"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]))


def climb(level):
    """(root, path of every leaf) of one tree."""
    paths, at = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        for k, i in enumerate(at):
            other = i ^ 1
            paths[k].append("" if other >= len(level) else ("R" if i % 2 == 0 else "L") + level[other])
            at[k] = i // 2
        level = [sha("".join(level[i : i + 2])) for i in range(0, len(level), 2)]
    return level[0], paths


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r)))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [climb([h for *_, h in sorted(groups[g])]) for g in order]
    root, tops = climb([t[0] for t in trees])
    out = []
    for g, (sub, paths), top in zip(order, trees, tops, strict=True):
        for (known, i, h), path in zip(sorted(groups[g]), paths, strict=True):
            out.append((i if known else None, h, sub, root, path + top))
    return out


def rows_of(sizes):
    out = []
    for lang, n in sizes:
        for i in range(n):
            out.append((i if i % 5 else None, f"s{i % 3}" if i % 4 else None, lang, i * 7 if i % 6 else None, "é" * (i % 9), "x", "y", i))
    return out + out[:3]  # repeated rows


@pytest.mark.parametrize("band", [2, 6])
@pytest.mark.parametrize("sizes", [[("en", 1)], [(None, 1), ("", 2), ("é", 3), ("Z", 9), ("a", 133)], [(f"g{k}", k % 4 + 1) for k in range(70)]])
def test_paths_against_brute_force(spark, sizes, band, monkeypatch):
    monkeypatch.setattr(mm, "BAND", band)
    rows = rows_of(sizes)
    got = mm.manifest(spark.createDataFrame(rows, SCHEMA).repartition(5), carry={"twice": F.col("lo") * 2})
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "path", "twice"]
    found = got.withColumn("folded", mm.fold(F.col("leaf"), F.col("path"))).collect()
    assert sorted((tuple(r)[:5] for r in found), key=str) == sorted(brute(rows), key=str)
    assert all(r["folded"] == r["root"] for r in found)
    assert sorted(r["twice"] for r in found) == sorted(2 * r[7] for r in rows)


def test_empty_and_tampered(spark):
    df = spark.createDataFrame(rows_of([("en", 40)]), SCHEMA)
    assert mm.manifest(df.limit(0)).collect() == []
    rows = mm.manifest(df).withColumn("bad", mm.fold(F.sha2(F.lit("x").cast("binary"), 256), F.col("path")))
    assert rows.filter("bad = root").count() == 0


def test_ranks_of_equal_rows_spread(spark):
    """Null ids and equal rows are dealt over the partitions."""
    df = spark.range(4000).select(F.lit("=en").alias("g"), F.lit(None).cast("bigint").alias("id"), F.lit("h").alias("hash"))
    ranked = mm.ranked(df.repartition(8), "g", ["id", "hash"])
    assert sorted(r["lo"] for r in ranked.collect()) == list(range(4000))
    assert {r["n"] for r in ranked.select("n").distinct().collect()} == {4000}
    part = df.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(8, "g", "id", "hash", "_row")
    assert max(r["count"] for r in part.groupBy(F.spark_partition_id()).count().collect()) < 1500


def test_query_verifies_untampered_rows_only(spark):
    import zlib

    got = q.op13_merkle(spark, "/root/testdata/sf0.001").collect()
    assert all(r["verified"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 != 0) for r in got) and len(got) == 200
