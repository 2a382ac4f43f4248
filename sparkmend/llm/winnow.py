"""Benchmark decontamination by winnowing (native).

A window is ``window`` consecutive words of a benchmark item.  Both sides
keep, of every ``window - k + 1`` consecutive k-gram hashes, the leftmost
smallest; a shared span of ``window`` words holds one such run on both
sides, so it always shares a kept fingerprint.  Kept fingerprints are joined
and each hit is extended: the words around it are compared as strings, which
settles every window that covers the fingerprint (a hash collision never
counts).

Documents first test their k-gram hashes against a bit set of the items'
fingerprints (fixed size, whatever the benchmark's), so the window minima
are only worked out around k-grams that can join, and only those rows leave
the document.  Items shorter than a window are one window each; they cannot
rely on the minima, so their first word's hash picks the places to compare.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import anti_join, ascii_lower, free_names, stage

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BITS = 1 << 17  # of each bit set
BROADCAST_BYTES = 64 << 20  # a fingerprint table beyond this is joined by shuffle


def word_list(text: Column) -> Column:
    """Words of the A-Z lower-cased text; null has none."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), 0)


def _gram(wh: Column, i: Column, k: int) -> Column:
    return F.xxhash64(*[F.get(wh, i + j) for j in range(k)])


def _bit_set(rows: DataFrame, col: str) -> Column:
    """A literal bit set of the hashes' low bits; its size is fixed."""
    words = [0] * (BITS // 64)
    for (b,) in rows.select(F.col(col).bitwiseAND(BITS - 1).alias("b")).distinct().collect():
        words[b >> 6] |= 1 << (b & 63)
    signed = (w - (1 << 64) if w >> 63 else w for w in words)
    return F.split(F.lit(",".join(map(str, signed))), ",").cast("array<bigint>")


def _has(bits: Column, h: Column) -> Column:
    b = h.bitwiseAND(BITS - 1).cast("int")
    return F.getbit(F.get(bits, F.shiftright(b, 6)), b.bitwiseAND(63)) == 1


def _is_min(h: Column, p: Column, run: int) -> Column:
    """p is the leftmost smallest of some run of ``run`` hashes."""

    def leads(s: Column) -> Column:
        part = F.slice(h, s + 1, run)
        return F.array_position(part, F.array_min(part)) == p - s + 1

    return F.exists(F.sequence(F.greatest(p - (run - 1), F.lit(0)), F.least(p, F.size(h) - run)), leads)


def _whole_items(m: int, bits: Column) -> Column:
    """Candidates of items of m words at the places in ``starts``."""
    gram = lambda p: _gram(F.col("wh"), p, m)
    return F.transform(
        F.filter("starts", lambda p: (p + m <= F.col("n")) & _has(bits, gram(p))),
        lambda p: F.struct(F.lit(m).alias("kind"), p.alias("p"), gram(p).alias("h"), F.slice(F.col("w"), p + 1, m).alias("ctx")),
    )


def _context(words: Column, p: Column, side: int, k: int, pad: str) -> Column:
    """Words p-side .. p+k+side-1; ``pad`` stands before the first word and
    nothing after the last."""
    lack = F.greatest(side - p, F.lit(0))
    return F.concat(
        F.array_repeat(F.lit(pad), lack),
        F.slice(words, F.greatest(p - side, F.lit(0)) + 1, F.lit(2 * side + k) - lack),
    )


def _positions(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def item_fingerprints(items: DataFrame, item_col: str, text_col: str, window: int, k: int) -> DataFrame:
    """kind 0: (hash, words around it) per kept fingerprint of the items of
    ``window`` words or more; kind n: the whole item of n < window words."""
    run, side = window - k + 1, window - k
    words = items.select(F.col(item_col).alias("item"), word_list(F.col(text_col)).alias("iw")).filter(F.size("iw") > 0)
    hashed = words.select("item", "iw", F.transform("iw", lambda w: F.xxhash64(w)).alias("wh"))
    grams = hashed.filter(F.size("iw") >= window).select(
        "item", "iw", F.slice(F.transform("wh", lambda w, i: _gram(F.col("wh"), i, k)), 1, F.size("wh") - (k - 1)).alias("g")
    )
    long = grams.select(
        "item", "iw", "g", F.explode(F.filter(_positions(F.size("g")), lambda p: _is_min(F.col("g"), p, run))).alias("p")
    ).select(
        "item",
        F.lit(0).alias("kind"),
        F.get("g", F.col("p")).alias("h"),
        F.lit(None).cast("bigint").alias("first"),
        _context(F.col("iw"), F.col("p"), side, k, ">").alias("ictx"),
    )
    out = long
    for n in range(1, window):
        out = out.unionByName(
            hashed.filter(F.size("iw") == n).select(
                "item",
                F.lit(n).alias("kind"),
                _gram(F.col("wh"), F.lit(0), n).alias("h"),
                F.get("wh", F.lit(0)).alias("first"),
                F.col("iw").alias("ictx"),
            )
        )
    return out


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    k: int = 5,
) -> DataFrame:
    """Per document: doc_id (named as ``id_col``), n_words, n_hit, n_items,
    items (array of strings, sorted), spans (array of start, length in words,
    sorted), contaminated and text_key (xxhash64 of the text).

    A word inside any occurrence of any item window is hit.  Null or empty
    texts have no words and no hits; items without words have no windows; an
    item with null id marks words but is not listed.  Repeated item rows count
    once; repeated documents give one row each; documents that share an id but
    not a text are told apart.  Other columns are not read.
    """
    fps = stage(item_fingerprints(items, item_col, item_text_col, window, k), "fingerprints")
    run, side = window - k + 1, window - k
    sizes = fps.groupBy("kind").agg(
        F.count("*").alias("n"), F.sum(F.length(F.array_join("ictx", " ")) + 64).alias("bytes")
    )
    sizes = {r["kind"]: r for r in sizes.collect()}  # at most ``window`` rows
    small = sum(r["bytes"] for r in sizes.values()) <= BROADCAST_BYTES

    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), word_list(F.col(text_col)).alias("w"))
    base = base.select("id", "key", "w", F.size("w").alias("n"), F.transform("w", lambda x: F.xxhash64(x)).alias("wh"))
    cand_type = "array<struct<kind:int,p:int,h:bigint,ctx:array<string>>>"
    # one row per document that joins nothing, its hash spread over partitions
    cands = [
        F.array(
            F.struct(F.lit(-1).alias("kind"), F.lit(-1).alias("p"), F.xxhash64("id", "key").alias("h"), F.lit(None).cast("array<string>").alias("ctx"))
        ).cast(cand_type)
    ]
    if 0 in sizes:
        bits = _bit_set(fps.filter("kind = 0"), "h")
        base = base.withColumn(
            "g",
            F.when(
                F.col("n") >= window,
                F.slice(F.transform("wh", lambda x, i: _gram(F.col("wh"), i, k)), 1, F.greatest(F.col("n") - (k - 1), F.lit(0))),
            ).otherwise(F.array().cast("array<bigint>")),
        )
        base = base.withColumn("near", F.filter(_positions(F.size("g")), lambda i: _has(bits, F.get(F.col("g"), i))))
        cands.append(
            F.transform(
                F.filter("near", lambda p: _is_min(F.col("g"), p, run)),
                lambda p: F.struct(
                    F.lit(0).alias("kind"), p.alias("p"), F.get(F.col("g"), p).alias("h"), _context(F.col("w"), p, side, k, "<").alias("ctx")
                ),
            ).cast(cand_type)
        )
    short = sorted(n for n in sizes if n > 0)
    if short:
        firsts = _bit_set(fps.filter("kind > 0"), "first")
        whole = _bit_set(fps.filter("kind > 0"), "h")
        base = base.withColumn("starts", F.filter(_positions(F.col("n")), lambda i: _has(firsts, F.get(F.col("wh"), i))))
        cands += [_whole_items(m, whole).cast(cand_type) for m in short]
    rows = base.select("id", "key", "n", F.explode(F.concat(*cands)).alias("c")).select("id", "key", "n", "c.*")
    joined = rows.join(F.broadcast(fps) if small else fps, ["kind", "h"], "left")

    def same(o: Column) -> Column:
        mine = F.slice("ctx", o + 1, window)
        return (F.size(mine) == window) & (mine == F.slice("ictx", o + 1, window))

    span = "array<struct<s:int,l:int>>"
    hits = (
        F.when(F.col("ictx").isNull(), F.array().cast(span))
        .when(
            F.col("kind") == 0,
            F.transform(
                F.filter(F.sequence(F.lit(0), F.lit(side)), same),
                lambda o: F.struct((F.col("p") - side + o).alias("s"), F.lit(window).alias("l")),
            ).cast(span),
        )
        .when(F.col("ctx") == F.col("ictx"), F.array(F.struct(F.col("p").alias("s"), F.col("kind").alias("l"))).cast(span))
        .otherwise(F.array().cast(span))
    )
    found = joined.select("id", "key", "n", "kind", "item", hits.alias("hits"))
    per_doc = found.groupBy("id", "key").agg(
        F.count_if(F.col("kind") == -1).alias("copies"),
        F.max("n").alias("n"),
        F.collect_set(F.when(F.size("hits") > 0, F.col("hits"))).alias("hits"),
        F.collect_set(F.when(F.size("hits") > 0, F.col("item").cast("string"))).alias("items"),
    )
    spans = F.array_sort(F.array_distinct(F.flatten("hits")))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("hit"), F.lit(0).alias("end")),
        lambda a, s: F.struct(
            (a["hit"] + F.greatest(F.lit(0), s["s"] + s["l"] - F.greatest(s["s"], a["end"]))).alias("hit"),
            F.greatest(a["end"], s["s"] + s["l"]).alias("end"),
        ),
    )["hit"]
    out = per_doc.select("id", "key", "copies", "n", F.array_sort("items").alias("items"), spans.alias("spans"))
    out = out.select("id", "key", "n", "items", "spans", covered.alias("n_hit"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").cast("bigint").alias("n_words"),
        F.col("n_hit").cast("bigint").alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        "items",
        "spans",
        (F.col("n_hit") > 0).alias("contaminated"),
        F.col("key").alias("text_key"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without any item window, all their columns.  A row
    goes for its own text only, whatever other rows have its id or none.
    ``options`` are those of ``decontaminate``."""
    found = decontaminate(docs, items, id_col, text_col, **options).filter("contaminated").select(id_col, "text_key").distinct()
    (key,) = free_names(docs, "text_key")
    return anti_join(docs.withColumn(key, F.xxhash64(text_col)), found.withColumnRenamed("text_key", key), [id_col, key]).drop(key)
