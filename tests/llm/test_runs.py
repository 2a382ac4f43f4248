import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from sparkmend.llm import periodic_runs as pr
from sparkmend.llm import queries as q

SF = "/root/testdata/sf0.001"


def brute(words, min_length=6, min_exponent=4):
    """Runs by trying every period."""
    n, out = len(words), []
    for p in range(1, n // min_exponent + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            one = words[i : j + p]
            shorter = any(one[:-s] == one[s:] for s in range(1, p))
            if len(one) >= max(min_length, min_exponent * p) and not shorter:
                out.append((i, len(one), p))
            i = j + 1
    return sorted(out)


def cut(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def planted(doc_id, text):
    words, h = cut(text), zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    return words


def collapsed(words, runs):
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


@pytest.mark.parametrize("block", [1, 4, 1024])
@pytest.mark.parametrize("min_length, min_exponent", [(6, 4), (2, 2), (5, 3), (1, 2)])
def test_chunks_against_brute_force(block, min_length, min_exponent, monkeypatch):
    monkeypatch.setattr(pr, "BLOCK", block)
    rng = random.Random(block * 31 + min_length)
    for _ in range(300):
        words = [rng.randrange(rng.randint(1, 4)) for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.6 and words:
            p, a = rng.randint(1, 7), rng.randrange(len(words))
            for i in range(max(a, p), min(len(words), a + rng.randint(1, 50))):
                words[i] = words[i - p]
        assert pr.chunk_runs(np.array(words, np.int64), min_length, min_exponent) == brute(words, min_length, min_exponent)


def test_texts_do_not_run_into_each_other(spark, monkeypatch):
    monkeypatch.setattr(pr, "CHUNK", 40)
    texts = [None, "", " \t\n", "a " * 6, "a " * 5, "a " * 12, "b a " * 12, "x " + "a b c " * 4 + "y", "a\x0bb\x0c" * 4, "\x1c\x1c a" * 4, "é 🙂 " * 9, "a " * 9]
    texts += ["the same again " * 30] * 3 + ["word%d " % i for i in range(50)] + ["k " * 40000 + "l k " * 900]
    rows = [(i if i % 7 else None, t, "clash", i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, runs string, n int").repartition(3)
    got = {r["n"]: r for r in pr.find_runs(df).collect()}
    assert len(got) == len(rows) and pr.find_runs(df.limit(0)).collect() == []
    for i, t, _, n in rows:
        words = cut(t)
        want = brute(words) if len(words) < 5000 else [(0, 40000, 1), (39999, 1801, 2)]
        runs = [tuple(r) for r in got[n]["runs"]]
        assert got[n]["doc_id"] == i and got[n]["n_words"] == len(words) and runs == want
        assert got[n]["collapsed"] == collapsed(words, runs)


def test_query_against_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = q.op11_periodic_runs(spark, SF).collect()
    assert len(got) == len(docs) and sum(r["n_runs"] > 0 for r in got) > 10
    assert got[0].asDict().keys() == {"doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"}
    for r in got:
        words = planted(r["doc_id"], docs[r["doc_id"]])
        runs = brute(words)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        tail = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == tail and r["n_runs"] == len(runs)
        assert r["runs_sha256"] == sha("".join("%d,%d,%d\n" % x for x in runs))
        assert r["collapsed_sha256"] == sha(collapsed(words, runs))
