"""URL filter over a sorted digest array.

Rules are (host, path, verdict).  A rule fits its host and all subdomains
when the URL's path starts with the rule's path; of the rules that fit, the
longest rule string wins (ties: the longer host).  URLs that no rule fits get
the method's default, ``allow``.

The rules' xxHash64 keys are written, sorted, into one flat file with the
full strings behind them.  The file is shipped to every executor
(``addFile``), memory-mapped there, and probed by a vectorised binary search;
every match is confirmed against the stored string, and equal keys are walked
through, so colliding digests cannot give a wrong verdict.  A rule table
beyond ``max_index_bytes`` is not shipped: the same probes are then joined
with it by key and string.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from typing import Tuple

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import LOWER, UPPER, ensure_checkpoint_dir, free_names, without

DEFAULT = "allow"
RESULT = ("host", "path", "rule", "verdict")
MAGIC = b"URLDIG01"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to / ? # or the end, A-Z lower-cased."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ? or # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_rows(rules: DataFrame) -> DataFrame:
    """(key, rule, hl, block) of (host, path, verdict) rows; rows without a
    host are left out, a repeated rule blocks if any of its rows does."""
    full = F.concat(F.col("host"), F.coalesce("path", F.lit("")))
    one = rules.filter("host <> ''").groupBy(full.alias("rule"), F.char_length("host").alias("hl")).agg(
        F.max(F.col("verdict") == "block").alias("block")
    )
    return one.select(F.xxhash64("rule").alias("key"), "rule", "hl", "block")


def write_index(spark, rows: DataFrame) -> str:
    """Write the sorted array to the shared folder, ship it to the executors
    and return its file name.  Rows come to the driver one partition at a
    time, in key order."""
    keys, ends, heads, blocks, strings, at = [], [], [], [], [], 0
    for r in rows.orderBy("key", "rule", "hl").toLocalIterator():
        raw = r["rule"].encode("utf-8")
        at += len(raw)
        keys.append(r["key"])
        ends.append(at)
        heads.append(r["hl"])
        blocks.append(bool(r["block"]))
        strings.append(raw)
    body = MAGIC + struct.pack("<q", len(keys))
    body += np.array(keys, "<i8").tobytes() + np.array(ends, "<i8").tobytes()
    body += np.array(heads, "<i4").tobytes() + np.array(blocks, "u1").tobytes() + b"".join(strings)
    name = f"url-digests-{uuid.uuid4().hex}.bin"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{ensure_checkpoint_dir(spark)}/{name}")
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    try:
        out.write(bytearray(body))
    finally:
        out.close()
    spark.sparkContext.addFile(path.toString())
    return name


class Index:
    """The memory-mapped array."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        if raw[:8].tobytes() != MAGIC:
            raise ValueError(f"not a digest array: {path}")
        n = int(raw[8:16].view("<i8")[0])
        self.keys = raw[16 : 16 + 8 * n].view("<i8")
        self.ends = raw[16 + 8 * n : 16 + 16 * n].view("<i8")
        self.heads = raw[16 + 16 * n : 16 + 20 * n].view("<i4")
        self.block = raw[16 + 20 * n : 16 + 21 * n]
        self.strings = raw[16 + 21 * n :]

    def string(self, i: int) -> bytes:
        return self.strings[int(self.ends[i - 1]) if i else 0 : int(self.ends[i])].tobytes()

    def find(self, keys: np.ndarray, strings, heads) -> np.ndarray:
        """Row of each probe, or -1: binary search of all keys at once, then
        the stored string and host length of each row with that key."""
        lo = np.searchsorted(self.keys, keys, "left")
        hi = np.searchsorted(self.keys, keys, "right")
        out = np.full(len(keys), -1, np.int64)
        for i in np.flatnonzero(hi > lo):
            raw = strings[i].encode("utf-8")
            for j in range(lo[i], hi[i]):
                if self.heads[j] == heads[i] and self.string(j) == raw:
                    out[i] = j
        return out


def probes(host: Column, path: Column, lengths: list[int], max_labels: int) -> Column:
    """array<struct<rule, hl, key>>: every domain suffix of the host (of at
    most the rules' number of labels) with every path prefix of a length that
    some rule has."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    suffix = F.transform(
        F.sequence(F.lit(1), F.least(n, F.lit(max_labels))),
        lambda k: F.array_join(F.slice(labels, n - k + 1, k), "."),
    )
    fits = F.filter(F.array(*[F.lit(v) for v in lengths]), lambda v: v <= F.char_length(path))
    every = F.flatten(
        F.transform(
            suffix,
            lambda s: F.transform(
                fits, lambda v: F.struct(F.concat(s, F.substr(path, F.lit(1), v)).alias("rule"), F.char_length(s).alias("hl"))
            ),
        )
    )
    return F.when(host == "", F.array().cast("array<struct<rule:string,hl:int>>")).otherwise(every)


def filter_urls(df: DataFrame, rules: DataFrame, url_col: str = "url", max_index_bytes: int = 256 << 20) -> DataFrame:
    """``df`` plus host, path, rule and verdict; one row per input row.

    A null URL or one without ``://`` has empty host and path, no rule and the
    default verdict.  Host names keep their port.  Clashing input columns are
    dropped.  Empty tables and empty rule sets give the default."""
    spark = df.sparkSession
    df = without(df, *RESULT)
    rows = rule_rows(rules)
    shape = rows.agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum(F.octet_length("rule") + 21), F.lit(0)).alias("bytes"),
        F.collect_set(F.char_length("rule") - F.col("hl")).alias("lengths"),
        F.max(F.size(F.split(F.substr("rule", F.lit(1), F.col("hl")), r"\."))).alias("labels"),
    ).first()
    out = df.withColumn("host", host_of(F.col(url_col))).withColumn("path", path_of(F.col(url_col)))
    if not shape["n"]:
        return out.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(DEFAULT))
    cand, hit = free_names(out, "cand", "hit")
    out = out.withColumn(cand, probes(F.col("host"), F.col("path"), sorted(shape["lengths"]), shape["labels"]))
    if shape["bytes"] <= max_index_bytes:
        name = write_index(spark, rows)

        @F.pandas_udf("struct<rule:string,verdict:string>")
        def look(parts: Iterator[Tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
            index = Index(SparkFiles.get(name))
            for keys, strings, heads in parts:
                size = np.fromiter(map(len, keys), np.int64, len(keys))
                flat = [s for x in strings for s in x]
                lens = np.array([v for x in heads for v in x], np.int64)
                found = index.find(np.concatenate([*keys, np.zeros(0, np.int64)]).astype(np.int64), flat, lens)
                best: list = [None] * len(keys)
                owner = np.repeat(np.arange(len(keys)), size)
                for i in np.flatnonzero(found >= 0):
                    rank = (len(flat[i]), lens[i], found[i])
                    if best[owner[i]] is None or rank > best[owner[i]][0]:
                        best[owner[i]] = (rank, flat[i])
                yield pd.DataFrame(
                    {
                        "rule": [b and b[1] for b in best],
                        "verdict": [DEFAULT if b is None else "block" if index.block[b[0][2]] else "allow" for b in best],
                    }
                )

        keyed = F.transform(cand, lambda c: F.xxhash64(c["rule"]))
        out = out.withColumn(hit, look(keyed, F.col(cand)["rule"], F.col(cand)["hl"]))
        return out.withColumn("rule", F.col(hit)["rule"]).withColumn("verdict", F.col(hit)["verdict"]).drop(cand, hit)
    # too large to ship: the distinct (host, path) pairs' probes are joined by key and string
    pair = out.groupBy("host", "path").agg(F.first(cand).alias(cand))
    sent = pair.select("host", "path", F.explode(cand).alias("c")).select("host", "path", "c.*", F.xxhash64("c.rule").alias("key"))
    met = sent.join(rows, ["key", "rule", "hl"])
    first = Window.partitionBy("host", "path").orderBy(F.char_length("rule").desc(), F.col("hl").desc())
    best = met.withColumn("rn", F.row_number().over(first)).filter("rn = 1").select("host", "path", "rule", "block")
    return (
        out.drop(cand)
        .join(best, ["host", "path"], "left")
        .withColumn("verdict", F.when(F.col("block"), "block").otherwise(F.when(F.col("rule").isNull(), DEFAULT).otherwise("allow")))
        .select(*[F.col(f"`{c}`") for c in df.columns], "host", "path", "rule", "verdict")
    )
