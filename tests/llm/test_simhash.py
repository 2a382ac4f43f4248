import random
import re
import string

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sparkmend.llm import simhash_trie as st

LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute_fp(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    if not w:
        return 0
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(rows, bits=2):
    fps = sorted({f for _, f in rows})
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= bits:
                parent[find(a)] = find(b)
    low = {}
    for d, f in rows:
        if d is not None:
            low[find(f)] = min(d, low.get(find(f), d))
    return [(d, f"{f:016x}", low.get(find(f))) for d, f in rows]


def test_documents_against_brute_force(spark, small_docs):
    base = [(r["doc_id"], r["text"]) for r in small_docs.select("doc_id", "text").collect()]
    long = " ".join(f"v{i % 977}" for i in range(30000))
    rows = base + [(900, None), (901, ""), (902, " \t\n"), (903, "One"), (904, "one two"), (905, long), (None, "one"), (base[0][0], base[0][1])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = [tuple(r) for r in st.near_dedup(df).collect()]
    assert sorted(got, key=str) == sorted(brute_components([(d, brute_fp(t)) for d, t in rows]), key=str)
    assert st.near_dedup(df.limit(0)).collect() == []


def clustered(seed, n):
    r, out = random.Random(seed), set()
    while len(out) < n:
        c = r.getrandbits(64)
        out.add(c)
        for _ in range(r.choice([0, 0, 5, 60])):
            for _ in range(r.randrange(1, 3)):
                c ^= 1 << r.randrange(64)
            out.add(c)
    return sorted(out)


# leaves of n / 64 fingerprints; leaves bounded in size, few counts at a time
@pytest.mark.parametrize("settings", [{"LEAF_MIN": 4, "LEAVES": 64}, {"LEAF_MIN": 2, "LEAVES": 1, "LEAF_MAX": 8, "STEP_BITS": 6, "COUNTS_BITS": 5}])
def test_links_over_many_leaves(spark, monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(st, name, value)
    fps = sorted({*clustered(1, 700), 0, (1 << 64) - 1, 1 << 63, 3, *[0xABCD << 48 | i for i in range(300)]})
    df = spark.createDataFrame([(st._signed(f),) for f in fps], "fp bigint")
    edges = st.links(df, 2)
    for e in edges.collect():
        assert e["a"] != e["b"]
    got = {r["node"] % (1 << 64): r["root"] for r in st.components(edges).collect()}
    want = {}
    for f, _, c in brute_components([(f, f) for f in fps]):
        want.setdefault(c, set()).add(f)
    mine = {}
    for f in fps:
        mine.setdefault(got.get(f, st._signed(f)), set()).add(f)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, want.values()))


def test_walk_portions_and_leaf_pairs(monkeypatch):
    monkeypatch.setattr(st, "FRONT", 128)
    v = np.array(clustered(3, 400), np.uint64)
    for budget in (0, 1, 3):
        got = sorted((int(i), int(j)) for a, b in st.walk(v, v, budget) for i, j in zip(a, b))
        want = [(i, j) for i in range(len(v)) for j in range(i + 1, len(v)) if (int(v[i]) ^ int(v[j])).bit_count() <= budget]
        assert got == want
    leaves = [(0, 2), (2, 3), (3, 3), (2, 2), (6, 3), (14, 4), (15, 4)]  # 00 010 011 10 110 1110 1111
    for budget in (0, 1, 2):
        want = []
        for i, (p, d) in enumerate(leaves):
            for j, (q, e) in enumerate(leaves[i:], i):
                s = min(d, e)
                if ((p >> (d - s)) ^ (q >> (e - s))).bit_count() <= budget:
                    want.append((i, j))
        assert st.leaf_pairs(leaves, budget) == want


def test_forest_over_portions(monkeypatch):
    def joined(fps, edges):
        parent = {f: f for f in fps}

        def find(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for a, b in edges:
            parent[find(a)] = find(b)
        sets = {}
        for f in fps:
            sets.setdefault(find(f), set()).add(f)
        return sorted(map(sorted, sets.values()))

    for seed, front, direct in ((1, 64, 32), (2, 16, 16), (3, 1 << 20, 64)):
        monkeypatch.setattr(st, "FRONT", front)
        monkeypatch.setattr(st, "DIRECT", direct)
        v = np.array(clustered(seed, 3000), np.uint64)
        gap = np.bitwise_count(v[:, None] ^ v[None, :]) <= 2
        want = [(int(v[i]), int(v[j])) for i, j in zip(*np.nonzero(np.triu(gap, 1)))]
        a, b = st.forest(v, v, 2)
        assert joined(v.tolist(), zip(a.tolist(), b.tolist())) == joined(v.tolist(), want)


def test_forest_keeps_links_of_earlier_portions(monkeypatch):
    portions = [([2], [3]), ([0, 1], [2, 3])]
    monkeypatch.setattr(st, "walk", lambda own, every, budget: ((np.array(i), np.array(j)) for i, j in portions))
    v = np.arange(4, dtype=np.uint64)
    a, b = st.forest(v, v, 2)
    assert (a.tolist(), b.tolist()) == ([0, 0, 0], [1, 2, 3])


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1100)] + [(5000, 5000), (7, 7)]
    got = {r["node"]: r["root"] for r in st.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[i] == 1000 for i in range(1000, 1100))
    assert st.components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_edges_of_a_star_are_spread(spark):
    """No task joins more than a share of a hot node's edges."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = spark.createDataFrame([(0, i) for i in range(1, 4000)] + [(i, i + 1) for i in range(5000, 5200)], "u bigint, v bigint").repartition(8)
        low = rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        out = st._moved(rows, low, rows.count())
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == rows.count() and max(sizes) < 800
        assert {tuple(r) for r in out.collect()} == {(0, i, 1) for i in range(1, 4000)} | {(i, i + 1, i + 1) for i in range(5000, 5200)}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_keep_one(spark):
    rows = [(3, "a b c d", "x"), (1, "A b C d", "y"), (2, "quite other words here", "z"), (None, "a b c d", "n")]
    out = st.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string, component_id string"))
    assert sorted(r["component_id"] for r in out.collect()) == ["y", "z"]


def test_keep_one_decides_per_row(spark):
    a, b, c = "a b c d", "quite other words here", "nothing like the rest of it"
    rows = [
        (1, a, "a1"),
        (2, a.upper(), "a2"),
        (2, b, "b2"),  # the id loses above and is the only one here
        (5, c, "c5"),
        (4, c.upper(), "c4"),
        (4, c, "c4 again"),
        (None, "no id at all", "n"),
        (None, "No id at all", "n"),
        (None, "no ID at all", "n"),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, row string")
    out = [tuple(r) for r in st.keep_one(df).collect()]
    assert set(out) <= set(rows)
    names = sorted(r[2] for r in out)
    assert names in (["a1", "b2", "c4", "n"], ["a1", "b2", "c4 again", "n"])
    same = spark.createDataFrame([(7, a, "x")] * 5 + [(None, b, "y")] * 5, "doc_id bigint, text string, fp string")
    assert sorted((tuple(r) for r in st.keep_one(same).collect()), key=str) == [(7, a, "x"), (None, b, "y")]
