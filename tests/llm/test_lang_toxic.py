import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkmend.llm import lang_ecoc as le
from sparkmend.llm import toxic_lexicon as tl
from sparkmend.llm.common import held_out

SF = "/root/testdata/sf0.01"


def test_language_accuracy_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = le.identify_held_out(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert len(got) == docs.count() and (held.lang_pred == held.lang).mean() > 0.98
    assert got.score.between(0, 1).all()


def test_und_empty_tables_and_odd_rows(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and dog", "en"), ("le chat et la", "fr")] * 10)]
    odd = [(100, None, "en"), (101, "", None), (102, "12 34 !", "en"), (103, "x", None), (None, "le chat", None), (104, "le chat " * 200000, None), (104, "é", None)]
    df = spark.createDataFrame(rows + odd, "doc_id bigint, text string, lang string")
    got = {}
    for r in le.identify_held_out(df).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert [got[i][0]["lang_pred"] for i in (100, 101, 102)] == ["und"] * 3 and got[100][0]["score"] == 0.0
    assert got[103][0]["lang_pred"] in ("en", "fr") and len(got[104]) == 2
    assert got[None][0]["lang_pred"] == "fr" and got[None][0]["held_out"]
    assert le.identify_held_out(df.limit(0)).collect() == []
    clash = df.selectExpr("doc_id", "text", "lang", "1 as score")
    assert le.identify(clash, le.learn(df)).columns == ["doc_id", "text", "lang", "lang_pred", "score", "ambiguous"]


def test_codewords_are_distinct_and_far():
    for n in (1, 2, 3, 4, 6, 9, 20):
        m = le.code_matrix(n)
        assert m.shape[0] == n
        gaps = [int((m[i] != m[j]).sum()) for i in range(n) for j in range(i)]
        assert not gaps or min(gaps) >= (1 if n <= 3 else 2)
    assert le.code_matrix(4).shape == (4, 7)


def brute_model(texts):
    """(languages, table, margins) from whole texts, a count per language."""
    langs = sorted({lang for _, lang in texts})
    counts = np.zeros((len(langs), len(le.ORDERS) * le.BUCKETS))
    for text, lang in texts:
        for g in le.grams(text):
            counts[langs.index(lang)] += np.bincount(g, minlength=counts.shape[1])
    share = counts + 0.5
    for k in range(len(le.ORDERS)):
        part = share[:, k * le.BUCKETS : (k + 1) * le.BUCKETS]
        part /= part.sum(1, keepdims=True)
    code = le.code_matrix(len(langs))
    table = np.stack([np.log(share[b > 0].mean(0) / share[b < 0].mean(0)) for b in code.T], 1)
    return langs, code, table, code * (share @ table) / len(le.ORDERS)


def brute_predict(model, text):
    """The codeword of least weighted logistic loss, text by text."""
    langs, code, table, margin = model
    margin = np.maximum(margin, 1e-6)
    hits = np.concatenate(list(le.grams(text)))
    mean = table[hits].sum(0) / len(hits) * 4 / margin.mean(0)
    weight = margin.min(0) / margin.min(0).sum()
    return langs[int(np.argmin((np.log1p(np.exp(-code * mean)) * weight).sum(1)))]


def test_model_and_predictions_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.filter("doc_id % 7 = 0 and lang is not null and text is not null").collect()
    texts = [(r["text"], r["lang"]) for r in rows]
    langs, code, table, margin = brute = brute_model(texts)
    model = le.learn(docs.filter("doc_id % 7 = 0"))
    assert model.langs == langs and np.array_equal(model.code, code)
    assert np.allclose(model.table, table, atol=1e-4)
    assert np.allclose(model.scale, 4 / np.maximum(margin, 1e-6).mean(0), rtol=1e-6)
    for text, _ in texts:
        assert model.predict(text)[0] == brute_predict(brute, text)


def test_any_number_of_languages(spark):
    """600 languages of made-up words of their own: no limit, and told apart."""
    rng = np.random.default_rng(0)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(600 * 8)]
    rows = [(i, " ".join(rng.permutation(words[8 * (i % 600) : 8 * (i % 600) + 8])), f"l{i % 600:03d}") for i in range(2400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(4)
    got = le.identify_held_out(df).join(df.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.95
    for n in (65, 600, 3000):
        m = le.code_matrix(n)
        assert m.shape[1] <= 4 * np.ceil(np.log2(n)) + 40 and le.least_distance(m) >= 2
        if n < 1000:
            assert le.least_distance(m) == min(int((m[i] != m[i + 1 :]).sum(1).min()) for i in range(n - 1))


def test_toxicity_scores_against_substring_search(spark):
    """Every text's score from a search for each term at each word."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    lexicon = tl.fit(docs, labels)
    assert lexicon.terms

    def score(text):
        words, total = tl.fold(text or "").split(), 0.0
        for i, w in enumerate(words):
            hits = [v for t, v in lexicon.terms.items() if (f" {w} ".startswith(t) if t.endswith(" ") else f" {w}".startswith(t))]
            around = {f"{words[i - 1]} {w}" if i else w, f"{w} {words[i + 1]}" if i + 1 < len(words) else w}
            if hits and not around & lexicon.exceptions:
                total += max(hits)
        a, b = lexicon.curve
        return 1 / (1 + np.exp(-(a + b * np.log1p(1000 * (total / (len(words) + tl.PRIOR_WORDS))))))

    got = {r["doc_id"]: r["score"] for r in tl.toxicity(docs, labels).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert max(abs(got[r["doc_id"]] - score(r["text"])) for r in rows) < 1e-9


def test_pieces_do_not_change_the_counts(monkeypatch):
    text = "Ünder the moon 123 " * 50
    whole = np.concatenate(list(le.grams(text)))
    monkeypatch.setattr(le, "PIECE", 7)
    assert np.array_equal(np.sort(whole), np.sort(np.concatenate(list(le.grams(text)))))


def test_fold():
    assert tl.fold("L0s3r! scum") == " ioser scum "
    assert tl.fold("ІDІОТ café") == " idiot cafe "  # Cyrillic look-alikes
    assert tl.fold("$tupid a$$ x@y.z 5$") == " stupid a xay z s "
    assert tl.fold("") == "  "


def test_matches_exceptions_and_length():
    lex = tl.Lexicon({" idiot ": 5.0, " vequ": 2.0}, frozenset({"idiot proof"}))
    assert lex.density("you IDI0T") > 0 and lex.density("idiots are") == 0 and lex.density("Véquette") > 0
    assert lex.density("an idiot proof lamp") == 0 and lex.density("idiot, proof and idiot") > 0
    assert lex.density("idiot " + "word " * 1000) < lex.density("idiot " + "word " * 10)
    assert lex.density(None) == lex.density("") == 0
    assert tl.Lexicon({}).score("x") < 0.5


def test_exceptions_are_learned(spark):
    bad = [(f"you are a numpty {w} and so on w{i}", 1) for i, w in enumerate(["man", "dog", "cat", "cow"] * 30)]
    good = [(f"a numpty trophy for everyone number w{i} and more", 0) for i in range(10)]
    good += [(f"plain words of a text number w{i}", 0) for i in range(300)]
    sample = spark.createDataFrame(bad + good, "text string, toxic int")
    lex = tl.learn(sample)
    assert "numpty trophy" in lex.exceptions
    assert lex.score("such a numpty man here") >= 0.5 > lex.score("his numpty trophy shelf")


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = tl.toxicity(docs, labels).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    toxic, clean = held[held.toxic == 1], held[held.toxic == 0]
    assert (toxic.predicted == 1).mean() > 0.85 and (clean.predicted == 0).mean() > 0.98
    assert got.score.between(0, 1).all()


@pytest.mark.parametrize("labelled", [0, 1])
def test_toxicity_without_labels_nulls_and_empty(spark, labelled):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 2), (None, "x", 3), (2, "", 4)], "doc_id bigint, text string, score int")
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 1)][: 3 * labelled], "doc_id bigint, toxic int")
    got = tl.toxicity(docs, labels).collect()
    assert len(got) == 4 and all(0 <= r["score"] <= 1 for r in got)
    assert tl.drop_toxic(docs, labels).columns == ["doc_id", "text", "score"]
    assert tl.toxicity(docs.limit(0), labels).collect() == []


def test_terms_of_a_small_sample(spark):
    plain = lambda i: " ".join(f"w{(i * 37 + k * 11) % 5000}q" for k in range(99))
    rows = [(plain(i) + (" vileword" if i < 8 else " common"), 1) for i in range(50)]
    rows += [(plain(i + 50) + " common", 0) for i in range(950)]
    lex = tl.learn(spark.createDataFrame(rows, "text string, toxic int"))
    assert any(t.startswith(" viie") for t in lex.terms)


def test_only_near_copies_count_once(spark):
    shared = " ".join(f"shared{k}" for k in range(30))
    texts = [f"{shared} " + " ".join(f"own{i}x{k}" for k in range(60)) for i in range(40)]
    texts += [" ".join(f"copy{k}" for k in range(200)) + f" end{i}" for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    labels = docs.selectExpr("doc_id", "1 as toxic")
    learned = {r["doc_id"] for r in docs.filter(~held_out(F.col("doc_id"))).collect()}
    got = sorted(r["text"] for r in tl.labelled_sample(docs, labels, "doc_id", "text", "toxic", 1000).collect())
    assert [t for t in got if t.startswith("shared")] == sorted(texts[i] for i in learned if i < 40)
    assert len([t for t in got if t.startswith("copy")]) == 1


def test_sample_is_bounded_in_rows(spark):
    """Ids that occur many times do not make the sample larger."""
    texts = [(i % 50, f"text number {i} of many with words w{i} v{i * 7}") for i in range(3000)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id bigint, toxic int")
    got = tl.labelled_sample(docs, labels, "doc_id", "text", "toxic", 100).collect()
    assert 0 < len(got) <= 100 and all(sum(r["toxic"] == y for r in got) <= 50 for y in (0, 1))
