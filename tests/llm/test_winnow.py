import re
import string

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkmend.llm.winnow import WORD, decontaminate, drop_contaminated

LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
PAT = re.compile(WORD)


def words(t):
    return PAT.findall((t or "").translate(LOW))


def brute(docs, items, window=10):
    wins = {}
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for s in range(len(w) - n + 1 if w else 0):
            wins.setdefault(tuple(w[s : s + n]), set()).add(i)
    sizes = {len(k) for k in wins}
    out = []
    for d, t in docs:
        w = words(t)
        hit, found = set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if (k := tuple(w[s : s + n])) in wins:
                    hit.update(range(s, s + n))
                    found |= {str(i) for i in wins[k] if i is not None}
        out.append((d, len(w), len(hit), tuple(sorted(found))))
    return sorted(out, key=str)


def run(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    i = spark.createDataFrame(items, "item_id bigint, text string")
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in decontaminate(d, i).collect()), key=str)


def test_planted_windows(spark):
    a = " ".join(f"w{i}" for i in range(30))
    docs = [
        (1, "x y " + a + " z"),
        (2, " ".join(f"W{i}," for i in range(5, 15))),
        (3, " ".join(f"w{i}" for i in range(5, 14))),
        (4, None),
        (5, ""),
        (6, "one two three one two three Four"),
        (7, "é É ñ w1"),
        (8, " ".join(["w"] * 40)),
        (2, "other text under the same id"),
        (9, a),
        (9, a),
        (None, a),
    ]
    items = [(1, a), (2, a), (10, "one TWO three"), (11, "four"), (12, ""), (13, None), (14, " ".join(["w"] * 12)), (None, "é"), (1, a)]
    assert run(spark, docs, items) == brute(docs, items)
    assert run(spark, docs, []) == brute(docs, [])
    assert run(spark, [], items) == []


@settings(max_examples=4, deadline=None)
@given(st.integers(0, 10**6))
def test_random_words_of_a_small_vocabulary(spark, seed):
    import random

    r = random.Random(seed)
    text = lambda n: " ".join(r.choice("abc") for _ in range(n))
    items = [(i, text(r.choice([3, 9, 10, 11, 25]))) for i in range(6)]
    docs = [(i, text(r.randrange(0, 120))) for i in range(25)]
    docs += [(100 + i, f"{text(20)} {r.choice(items)[1]} {text(5)}") for i in range(10)]
    assert run(spark, docs, items) == brute(docs, items)


def test_no_python_in_the_plan(spark):
    d = spark.range(3).select(F.col("id").alias("doc_id"), F.lit("a b c d e f g h i j k").alias("text"))
    i = d.select(F.col("doc_id").alias("item_id"), "text")
    plan = decontaminate(d, i)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan


def test_only_contaminated_rows_go(spark):
    bad, clean = " ".join(f"w{i}" for i in range(12)), "clean words"
    docs = [(None, bad), (None, clean), (None, None), (1, "x " + bad), (1, clean), (2, clean), (2, bad), (2, bad), (3, clean), (3, clean)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("text_key", F.lit("own"))
    i = spark.createDataFrame([(1, bad)], "item_id bigint, text string")
    got = sorted((tuple(r) for r in drop_contaminated(d, i).collect()), key=str)
    assert got == sorted([(x, t, "own") for x, t in docs if not t or bad not in t], key=str)
