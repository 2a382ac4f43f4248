"""Toxicity by a weighted lexicon under Aho-Corasick.

Texts are folded first: lower case, look-alike letters of other scripts and
accented letters to their Latin base, digits and signs inside words to the
letters they stand for, everything else to single spaces.  The lexicon holds
word beginnings (a space and the first letters, or a whole word) with their
log-odds (rate per distinct word in toxic texts to clean ones); an Aho-Corasick automaton finds all of them in one pass.
A match inside an exception phrase (a neighbouring word that makes it
harmless) does not count.  The weights found, per word of the text, go
through a logistic curve.

Lexicon, exceptions and curve are learned from a bounded sample of labelled
rows (``sample`` rows, half of them toxic where there are as many; smallest
hashes of the id): near copies (documents that share most minima of their
shingle hashes) count once, so many copies of one toxic text do not turn its
ordinary words into terms.  The log-likelihood a term must gain follows from
the number of terms in the sample, not from its number of texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, stage, without

SAMPLE = 12000  # labelled rows that are read for learning
TERMS_AT_ONCE = 50_000  # rows of counts that a task hands over at a time
MAX_TERMS = 4000  # candidates that reach the driver
MIN_SHARE = 0.02  # of the toxic sample a term occurs in (and MIN_DOCS)
MIN_DOCS = 6
MIN_LOG_ODDS = 1.5  # of a term's rate per word, toxic to clean
CHANCE = 0.01  # that any of a sample's terms gets its gain by chance, about
SAME_GAIN = 0.95  # an extension with this share of the gain is as good
PRIOR_WORDS = 50  # added to a text's length, so that short texts are not judged by one weak term
PREFIXES = range(4, 9)
EXCEPTION_DOCS = 3  # clean documents that show a phrase, and no toxic one
PRIOR = 0.1  # share of toxic texts that the curve assumes
SHINGLE = 5
MINIMA = 16  # of a text's shingle hashes, each under a hash of its own
AGREE = 10  # minima that near copies share
RESULT = ("held_out", "score", "predicted")

# fixed values: look-alike letters (Cyrillic, Greek, other) and what they stand for
_LOOK_ALIKE = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t",
    "у": "y", "х": "x", "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ո": "n", "ɡ": "g", "ӏ": "i",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t",
    "υ": "u", "χ": "x", "ß": "s", "ı": "i", "ø": "o", "đ": "d", "ł": "i", "æ": "a", "œ": "o",
}
# fixed values: what digits and signs inside words stand for
_LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}


class _Fold(dict):
    """str.translate table, filled as characters come up."""

    def __missing__(self, code: int):
        import unicodedata

        c = chr(code)
        got = _LOOK_ALIKE.get(c)
        if got is None:
            base = unicodedata.normalize("NFKD", c).lower()
            base = "".join(_LOOK_ALIKE.get(x, x) for x in base if not unicodedata.combining(x))
            got = "".join(x for x in base if x.isalnum() or x in _LEET)
            if not got:  # marks and invisible characters vanish, others separate words
                got = "" if unicodedata.category(c) in ("Mn", "Me", "Cf") else " "
        self[code] = got = got.replace("l", "i")
        return got


_FOLD = _Fold()
# @ and $ stand for letters only before one
_SIGN = re.compile(r"[@$](?![^\W_])")
_LEET_TABLE = str.maketrans(_LEET)


def fold(text: str) -> str:
    """Folded words, one space around each; l and i are one letter."""
    t = text.lower().translate(_FOLD)
    if "@" in t or "$" in t:
        t = _SIGN.sub(" ", t)
    return f" {' '.join(t.translate(_LEET_TABLE).split())} "


class Lexicon:
    """terms: folded strings with a leading space -> weight; exceptions:
    folded phrases of two words; curve: (intercept, slope)."""

    def __init__(self, terms: dict[str, float], exceptions: frozenset[str] = frozenset(), curve=(-4.0, 2.0)):
        self.terms, self.exceptions, self.curve = terms, exceptions, curve
        self._machine = None

    def __getstate__(self):
        return {**self.__dict__, "_machine": None}

    def matches(self, folded: str) -> Iterator[tuple[float, str, str]]:
        """(weight, previous word + word, word + next word) per word found;
        the heaviest term of a word counts."""
        import ahocorasick

        if not self.terms:
            return
        if self._machine is None:
            self._machine = ahocorasick.Automaton()
            for term, weight in self.terms.items():
                self._machine.add_word(term, (len(term), weight))
            self._machine.make_automaton()
        best: dict[int, float] = {}
        for end, (size, weight) in self._machine.iter(folded):
            at = end - size + 1  # of the space before the word
            best[at] = max(weight, best.get(at, weight))
        for at, weight in best.items():
            stop = folded.index(" ", at + 1)
            before = folded.rfind(" ", 0, at) + 1 if at else 0
            after = folded.find(" ", stop + 1)
            word = folded[at + 1 : stop]
            yield weight, f"{folded[before:at]} {word}".strip(), f"{word} {folded[stop + 1 : after if after > 0 else stop]}".strip()

    def density(self, text: str | None) -> float:
        folded = fold(text or "")
        found = sum(w for w, a, b in self.matches(folded) if a not in self.exceptions and b not in self.exceptions)
        return found / (folded.count(" ") - 1 + PRIOR_WORDS) if found else 0.0

    def score(self, text: str | None) -> float:
        a, b = self.curve
        z = a + b * math.log1p(1000 * self.density(text))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def _unlike(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of rows with one smallest shingle hash (a part of the bounded sample),
    those that are no near copy of a row before them."""
    pdf = pdf.sort_values("text")
    minima = np.stack(pdf["minima"].to_numpy())
    left, kept = np.arange(len(pdf)), []
    while len(left):
        kept.append(left[0])
        left = left[(minima[left] == minima[left[0]]).sum(1) < AGREE]
    return pdf.iloc[kept][["text", "toxic"]].astype({"text": object})  # one Arrow chunk


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, size: int) -> DataFrame:
    """(text, toxic) of at most ``size`` labelled rows that are not held out,
    half of them of each class at most, chosen by hash of id and text: an id
    may have many rows."""
    one = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic"))
    one = one.filter((~held_out(F.col("id"))) & F.col("toxic").isin(0, 1)).groupBy("id").agg(F.max("toxic").alias("toxic"))
    pick = [one.filter(F.col("toxic") == y).orderBy(F.xxhash64("id", F.lit(11)), "id").limit(size // 2) for y in (0, 1)]
    pick = stage(pick[0].union(pick[1]), "label-sample")
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null")
    # at most ``size`` rows of two numbers
    met = stage(text.join(F.broadcast(pick), "id"), "label-rows")
    found = {r["toxic"]: r["n"] for r in met.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    rows = [met.filter(F.col("toxic") == y) for y in (0, 1)]
    # only ids of many rows give more than the ids that were picked
    rows = [r.orderBy(F.xxhash64("id", "text", F.lit(11)), "id").limit(size // 2) if found.get(y, 0) > size // 2 else r for y, r in enumerate(rows)]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows[0].union(rows[1]).repartition(parts, F.xxhash64("id", "text")).select("text", "toxic", F.split(F.lower("text"), r"\s+").alias("w"))
    shingles = F.transform(F.slice("w", 1, F.greatest(F.size("w") - (SHINGLE - 1), F.lit(1))), lambda x, i: F.xxhash64(*[F.get(F.col("w"), i + j) for j in range(SHINGLE)]))
    rows = rows.select("text", "toxic", shingles.alias("s"))

    def least(k: int):
        return F.array_min(F.transform("s", lambda x: F.xxhash64(x, F.lit(k))))

    rows = rows.select("text", "toxic", F.array_min("s").alias("rare"), F.array(*[least(k) for k in range(MINIMA)]).alias("minima"))
    rows = rows.groupBy("rare", "toxic", "minima").agg(F.min("text").alias("text")).groupBy("rare", "toxic").applyInPandas(_unlike, "text string, toxic int")
    return stage(rows.select("text", "toxic"), "toxic-sample")


def learn(sample: DataFrame) -> Lexicon:
    """Lexicon from (text, toxic) rows; an empty one if a class is missing."""
    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return Lexicon({}, curve=(4.0 if n.get(1) else -4.0, 0.0))

    def terms(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, docs, words = (Counter(), Counter()), Counter(), [0, 0]
        for pdf in parts:
            for text, toxic in zip(pdf["text"], pdf["toxic"], strict=True):
                own = Counter()
                # a word counts once per text: lines of one word say little
                for w in set(fold(text).split()):
                    words[toxic] += 1
                    own[f" {w} "] += 1
                    own.update(f" {w[:size]}" for size in PREFIXES if size < len(w))
                seen[toxic].update(own)
                if toxic:
                    docs.update(own.keys())
        keys = list(seen[0].keys() | seen[1].keys())
        for at in range(0, len(keys), TERMS_AT_ONCE):
            part = keys[at : at + TERMS_AT_ONCE]
            yield pd.DataFrame({"term": part, "o0": [seen[0][k] for k in part], "o1": [seen[1][k] for k in part], "n1": [docs[k] for k in part]})
        yield pd.DataFrame({"term": [""], "o0": [words[0]], "o1": [words[1]], "n1": [0]})

    every = stage(
        sample.mapInPandas(terms, "term string, o0 bigint, o1 bigint, n1 bigint")
        .groupBy("term")
        .agg(*[F.sum(c).alias(c) for c in ("o0", "o1", "n1")]),
        "terms",
    )
    # twice a gain by chance is about chi-squared: more than g with exp(-g) at most
    least = math.log(every.count() / CHANCE)
    sums = every.filter((F.col("term") == "") | (F.col("n1") >= max(MIN_DOCS, MIN_SHARE * n[1])))
    total = sums.filter("term = ''").first()
    w0, w1 = max(total["o0"], 1), max(total["o1"], 1)
    r0, r1 = (F.col("o0") + 0.5) / w0, (F.col("o1") + 0.5) / w1
    mean = (F.col("o0") + F.col("o1") + 1.0) / (w0 + w1)
    gain = F.col("o0") * F.log(r0 / mean) + F.col("o1") * F.log(r1 / mean)
    got = (
        sums.filter("term <> ''")
        .select("term", F.log(r1 / r0).alias("w"), gain.alias("gain"))
        .filter((F.col("w") >= MIN_LOG_ODDS) & (F.col("gain") >= least))
        .orderBy(F.desc("gain"), "term")
        .limit(MAX_TERMS)
        .collect()
    )
    chosen = _select({r["term"]: (r["gain"], r["w"]) for r in got})
    lexicon = Lexicon(chosen)

    def phrases(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [
                (p, y) for t, y in zip(pdf["text"], pdf["toxic"], strict=True) for p in {x for m in lexicon.matches(fold(t)) for x in m[1:] if " " in x}
            ]
            yield pd.DataFrame(rows, columns=["phrase", "toxic"]).astype({"toxic": "int64", "phrase": "object"})

    harmless = (
        sample.mapInPandas(phrases, "phrase string, toxic bigint")
        .groupBy("phrase")
        .agg(F.count_if(F.col("toxic") == 0).alias("n0"), F.sum("toxic").alias("n1"))
        .filter((F.col("n0") >= EXCEPTION_DOCS) & (F.col("n1") == 0))
        .orderBy(F.desc("n0"), "phrase")
        .limit(MAX_TERMS)
    )
    lexicon = Lexicon(chosen, frozenset(r["phrase"] for r in harmless.collect()))

    def densities(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pd.DataFrame({"x": [lexicon.density(t) for t in pdf["text"]], "y": pdf["toxic"].astype("int64")})

    got = sample.mapInPandas(densities, "x double, y bigint").toPandas().sort_values(["x", "y"])  # at most SAMPLE rows
    return Lexicon(chosen, lexicon.exceptions, _curve(np.log1p(1000 * got["x"].to_numpy()), got["y"].to_numpy()))


def _select(found: dict[str, tuple[float, float]]) -> dict[str, float]:
    """Term -> weight: most gain first; of its extensions with nearly the same
    gain the longest is taken, and what it begins or begins with it goes."""
    order = sorted(found, key=lambda t: (-found[t][0], t))
    chosen: dict[str, float] = {}
    gone: set[str] = set()
    for t in order:
        if t in gone:
            continue
        kin = [x for x in order if x not in gone and x.startswith(t) and found[x][0] >= SAME_GAIN * found[t][0]]
        term = max(kin, key=lambda x: (len(x), x))
        chosen[term] = found[term][1]
        gone.update(x for x in order if x.startswith(term) or term.startswith(x) or x in kin)
    return chosen


def _curve(x: np.ndarray, y: np.ndarray, l2: float = 1e-4) -> tuple[float, float]:
    """Logistic fit of y on x, the classes weighted to PRIOR (Newton steps)."""
    w = np.where(y == 1, PRIOR / max((y == 1).mean(), 1e-9), (1 - PRIOR) / max((y == 0).mean(), 1e-9)) / len(y)
    design, beta = np.stack([np.ones_like(x), x], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        grad = design.T @ (w * (p - y)) + l2 * beta
        hess = (design * (w * p * (1 - p))[:, None]).T @ design + l2 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(max(beta[1], 0.0))


def score_texts(df: DataFrame, lexicon: Lexicon, text_col: str = "text") -> DataFrame:
    """``df`` plus score (0 to 1) and predicted (1 from 0.5), one row per input
    row.  Null and empty texts are scored as texts without terms."""
    df = without(df, "score", "predicted")

    @F.pandas_udf("double")
    def udf(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([lexicon.score(t) for t in texts], dtype="float64")

    return df.withColumn("score", udf(F.col(text_col))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def fit(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="toxic", size: int = SAMPLE) -> Lexicon:
    return learn(labelled_sample(docs, labels, id_col, text_col, label_col, size))


def toxicity(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="toxic") -> DataFrame:
    """Per document: id, held_out, score, predicted."""
    lexicon = fit(docs, labels, id_col, text_col, label_col)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return score_texts(rows, lexicon).select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="toxic") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, all their columns."""
    lexicon = fit(docs, labels, id_col, text_col, label_col)

    @F.pandas_udf("boolean")
    def clean(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([lexicon.score(t) < 0.5 for t in texts], dtype="bool")

    return docs.filter(clean(F.col(text_col)))
