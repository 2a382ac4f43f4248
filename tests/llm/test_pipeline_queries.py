import duckdb
import pytest
from check_oracles import TABLES, digest

import corpus_pipeline as cp
from sparkmend.llm import queries as q
from sparkmend.llm import toxic_lexicon as tl
from test_simhash import brute_components, brute_fp
from test_winnow import brute as brute_hits

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    out = q.QUERIES[name](spark, SF)
    res = con.execute(q.ORACLES[name])
    cols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(out.columns)
    assert digest(out.columns, [tuple(r) for r in out.collect()])[0] == digest(cols, res.fetchall())[0]


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    lexicon = tl.fit(docs, labels)
    rows = {i: t for i, t in rows.items() if lexicon.score(t) < 0.5}
    best = {}
    for i, t in rows.items():
        best[t.lower()] = max(i, best.get(t.lower(), i))  # the table is ASCII where cases differ
    rows = {i: rows[i] for i in best.values()}
    groups = brute_components([(i, brute_fp(t)) for i, t in rows.items()])
    rows = {i: rows[i] for i, _, c in groups if i == c}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = {i: rows[i] for i, _, hit, _ in brute_hits(list(rows.items()), items) if not hit}
    got = cp.run(spark, SF)
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(rows)
    assert cp.ORACLE_SQL is None and [n for n, _ in cp.STAGES][0] == "toxicity"



def test_stages_take_odd_tables(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, score int"
    odd = [(None, None, None, None, None, "x", 1), (1, "", "en", "s", 0, "x", 1), (1, "", "en", "s", 0, "x", 1), (2, "a b c", None, "s", 5, None, None)]
    for rows in (odd, []):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in cp.STAGES:
            out = stage(spark, docs, SF)
            assert out.count() <= len(rows)
            if name != "packing":
                assert out.columns == cp.COLUMNS


def test_stages_drop_rows_not_ids(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").filter("length(text) > 200").first()["text"]
    rows = [
        (None, item, "dropped: benchmark"),
        (None, "clean words without an id", "kept"),
        (1, f"before {item}", "dropped: benchmark"),
        (1, "clean words with the same id", "kept"),
        (2, "near copies of one text", "kept"),
        (3, "NEAR copies of one text", "dropped: near copy"),
        (3, "the only one of its kind", "kept"),
        (None, "near copies of one text", "dropped: no id"),
        (None, "other near copies and no id", "none"),
        (None, "Other near copies and no id", "none"),
    ]
    docs = spark.createDataFrame([(i, t, None, s, 0) for i, t, s in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    left = cp.decontaminate(spark, cp.near(spark, docs, SF), SF)
    assert sorted(r["source"] for r in left.collect()) == ["kept"] * 4 + ["none"]
