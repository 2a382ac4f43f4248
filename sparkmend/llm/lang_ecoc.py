"""Language identification by error-correcting output codes.

Every learned language has a codeword; one binary n-gram classifier per bit
predicts that bit from the hashed byte n-grams of the whole text.  The
classifiers are log-ratios of n-gram shares, counted over all training rows
once, per language (a table on the cluster).  A bit's shares are sums of the
languages' shares on either side of it, so the driver receives bits x n-gram
buckets whatever the number of languages, besides a codeword for each.
Decoding weights each bit's logistic loss by how well that classifier tells
the languages apart and takes the codeword of least loss; a small gap to the
next one marks the text as ambiguous.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, stage, without

BUCKETS = 1 << 14  # hashed n-grams of each order
ORDERS = (2, 3)
EXHAUSTIVE = 6  # up to so many languages all bipartitions are bits
AMBIGUOUS = 0.1  # relative gap of losses below which a text is ambiguous
DRAWS, MANY = 200, 64  # random code matrices tried, fewer beyond MANY languages
RESULT = ("held_out", "lang_pred", "score", "ambiguous")
PIECE = 1 << 20  # bytes of a text handled at a time

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
for _c in range(26):
    _FOLD[97 + _c] = _FOLD[65 + _c] = 97 + _c


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def grams(text: str) -> Iterator[np.ndarray]:
    """Bucket numbers of the byte n-grams of the folded text (lower case,
    everything in ASCII but letters a space), in pieces."""
    raw = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "surrogatepass"), np.uint8)
    for at in range(0, len(raw), PIECE):
        b = _FOLD[raw[at : at + PIECE + max(ORDERS) - 1]].astype(np.uint32)
        for k, n in enumerate(ORDERS):
            if len(b) < n:
                continue
            code = b[: len(b) - n + 1].copy()
            for i in range(1, n):
                code = code * np.uint32(257) + b[i : len(b) - n + 1 + i]
            code = code[:PIECE]
            yield ((code * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int64) + k * BUCKETS


def code_matrix(n: int) -> np.ndarray:
    """(n languages, bits) of -1 and 1.  Few languages: every bipartition once.
    More: random distinct columns, the draw with the largest smallest distance
    between codewords (seeded)."""
    if n == 1:
        return np.ones((1, 1))
    if n <= EXHAUSTIVE:
        rest = range(1, n)
        sets = [s for k in range(n - 1) for s in combinations(rest, k)]
        return np.array([[1.0 if i == 0 or i in s else -1.0 for s in sets] for i in range(n)])
    rng, best, far = np.random.default_rng(7), None, -1
    bits = 4 * math.ceil(math.log2(n)) + 8
    for _ in range(DRAWS if n <= MANY else max(1, DRAWS * MANY // n)):
        m = np.unique(np.where(rng.random((n, bits)) < 0.5, -1.0, 1.0), axis=1)
        m = m[:, np.abs(m.sum(0)) < n]
        gap = least_distance(m)
        if gap > far:
            best, far = m, gap
    while far < 2:  # codewords that are the same or nearly: more bits
        best = np.concatenate([best, np.where(rng.random((n, 8)) < 0.5, -1.0, 1.0)], axis=1)
        best = best[:, np.abs(best.sum(0)) < n]
        far = least_distance(best)
    return best


def least_distance(m: np.ndarray) -> int:
    """The fewest bits in which two rows differ, from products of blocks."""
    n, bits = m.shape
    least = bits
    for at in range(0, n, 1024):
        same = m[at : at + 1024] @ m.T
        same[np.arange(len(same)), at + np.arange(len(same))] = -bits
        least = min(least, int((bits - same.max()) / 2))
    return least


class Model:
    def __init__(self, langs: list[str], code: np.ndarray | None = None, table: np.ndarray | None = None, margin: np.ndarray | None = None):
        """code: (languages, bits); table: (n-gram buckets, bits) log-ratios;
        margin: (languages, bits) as expected on each language's own text."""
        self.langs = langs
        if not langs:
            return
        self.code = code
        margin = np.maximum(margin.T, 1e-6)
        self.table = np.ascontiguousarray(table, np.float32)
        self.scale = (4.0 / margin.mean(1)).astype(np.float64)
        self.weight = margin.min(1) / margin.min(1).sum()

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not self.langs or not has_letter(text):
            return "und", 0.0, True
        total, n = np.zeros(self.table.shape[1]), 0
        for g in grams(text):
            total += self.table[g].sum(0, dtype=np.float64)
            n += len(g)
        margins = self.code * (total / max(n, 1) * self.scale)
        loss = np.logaddexp(0, -margins) @ self.weight
        order = np.argsort(loss, kind="stable")
        best = loss[order[0]]
        p = np.exp(-4 * (loss - best))
        close = len(order) > 1 and bool(loss[order[1]] - best <= AMBIGUOUS * max(loss[order[1]], 1e-9))
        return self.langs[order[0]], float(1 / p.sum()), close


def learn(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on every row with a text and a language."""
    rows = df.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("text is not null and lang is not null")

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for pdf in parts:
            for text, lang in zip(pdf["text"], pdf["lang"], strict=True):
                own = sums.setdefault(lang, np.zeros(len(ORDERS) * BUCKETS, np.int64))
                for g in grams(text):
                    own += np.bincount(g, minlength=len(own))
        for lang, own in sums.items():
            at = np.flatnonzero(own)
            yield pd.DataFrame({"lang": lang, "gram": at, "n": own[at]})

    sums = rows.mapInPandas(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    return from_counts(stage(sums, "language-counts"))


def from_counts(counts: DataFrame) -> Model:
    """The model of a table (lang, gram, n) of n-gram counts."""
    spark, size, half = counts.sparkSession, len(ORDERS) * BUCKETS, 0.5
    order = F.floor(F.col("gram") / BUCKETS).cast("int")
    got = counts.groupBy("lang", order.alias("k")).agg(F.sum("n").alias("n")).groupBy("lang").pivot("k", list(range(len(ORDERS)))).agg(F.first("n"))
    totals = sorted(got.na.fill(0).collect())  # a row per language
    langs = [r["lang"] for r in totals]
    if not langs:
        return Model([])
    code = code_matrix(len(langs))
    n_langs, bits = code.shape
    # a language's share of an n-gram is (n + half) * scale
    scale = np.array([[1.0 / (r[1 + k] + half * BUCKETS) for k in range(len(ORDERS))] for r in totals])
    words = spark.createDataFrame(
        [(lang, sc, row) for lang, sc, row in zip(langs, scale.tolist(), code.tolist(), strict=True)], "lang string, scale array<double>, code array<double>"
    )
    # a codeword per language beside all its n-grams: joined by key
    shares = counts.join(words, "lang").select("lang", "gram", (F.col("n") * F.get("scale", order)).alias("x"), "code")
    sides = shares.groupBy("gram").agg(
        F.sum("x").alias("all"), Summarizer.sum(array_to_vector(F.transform("code", lambda c: c * F.col("x")))).alias("signed")
    )
    every, signed = np.zeros(size), np.zeros((size, bits))
    for r in sides.collect():  # n-gram buckets x bits numbers
        every[r["gram"]], signed[r["gram"]] = r["all"], r["signed"].toArray()
    for k in range(len(ORDERS)):  # the half counts of every language
        part = slice(k * BUCKETS, (k + 1) * BUCKETS)
        every[part] += half * scale[:, k].sum()
        signed[part] += half * (code * scale[:, k : k + 1]).sum(0)
    ones = (code > 0).sum(0)
    one, zero = (every[:, None] + signed) / 2 / np.maximum(ones, 1), (every[:, None] - signed) / 2 / np.maximum(n_langs - ones, 1)
    table = np.where((ones > 0) & (ones < n_langs), np.log(np.maximum(one, 1e-300) / np.maximum(zero, 1e-300)), 0.0)
    # what each bit is expected to give on each language's own text
    base = np.stack([table[k * BUCKETS : (k + 1) * BUCKETS].sum(0) for k in range(len(ORDERS))])
    ratios = spark.sparkContext.broadcast(table)  # n-gram buckets x bits numbers

    def expect(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = ratios.value
        for pdf in parts:
            for lang, rows in pdf.groupby("lang"):
                yield pd.DataFrame({"lang": [lang], "v": [(own[rows["gram"].to_numpy()] * rows["x"].to_numpy()[:, None]).sum(0)]})

    expected = shares.select("lang", "gram", "x").mapInPandas(expect, "lang string, v array<double>")
    expected = {r["lang"]: r["v"].toArray() for r in expected.groupBy("lang").agg(Summarizer.sum(array_to_vector("v")).alias("v")).collect()}
    margin = np.array([expected[lang] for lang in langs]) + half * scale @ base
    return Model(langs, code, table, code * margin / len(ORDERS))


def identify(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``df`` plus lang_pred, score (0 to 1) and ambiguous, one row per input
    row.  ``und`` (score 0, ambiguous) where the text is null or has no letter,
    or nothing was learned; any text with a letter gets a learned language."""
    df = without(df, "lang_pred", "score", "ambiguous")
    shipped = df.sparkSession.sparkContext.broadcast(model)  # bits * n-gram buckets floats

    @F.pandas_udf("struct<lang_pred:string,score:double,ambiguous:boolean>")
    def udf(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shipped.value
        for texts in parts:
            yield pd.DataFrame([own.predict(t) for t in texts], columns=["lang_pred", "score", "ambiguous"])

    return df.withColumn("lang_pred", udf(F.col(text_col))).select(
        *[F.col(f"`{c}`") for c in df.columns], "lang_pred.lang_pred", "lang_pred.score", "lang_pred.ambiguous"
    )


def identify_held_out(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn on the rows that are not held out, predict every row: id,
    held_out, lang_pred, score, ambiguous.  Repeated rows are learned and
    predicted as often as they occur; other columns are not read; an empty
    table gives an empty result."""
    flag = held_out(F.col(id_col))
    model = learn(docs.filter(~flag), text_col, lang_col)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return identify(rows, model, "text").select(
        F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "lang_pred", "score", "ambiguous"
    )
