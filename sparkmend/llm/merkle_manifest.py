"""Merkle dataset manifest with nested-interval labels.

Every row of a table is a leaf: a digest of its values.  The leaves of a group
are ranked by id; a node of the group's binary tree carries the interval
[lo, hi) of the leaf ranks that it covers, its level and its children's
intervals.  The group roots (subroots), ranked by group, are the leaves of one
more tree, whose root stands for the whole table.

A proof needs the siblings along a leaf's path.  A leaf is joined to the nodes
that contain its interval: the join is bucketed by level (key: group, level and
the leaf's rank cut to the level's width), so one key holds as many leaves as
its node covers, and the interval bounds are checked.  Inside the parent thus
found, what is left of its interval without the leaf's own child is the
sibling.  Levels go in bands: a band's nodes are joined to their ancestors in
the band only, and the band's top node hands down the path from there on.  So
a leaf is joined to at most ``BAND`` ancestors, whatever the tree's height, and
a key never holds more than 2 ** BAND rows, whatever a group's size.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stage

BAND = 6  # levels of a band
SMALL = 100_000  # rows up to which the table of rank offsets is broadcast


def digest(*values: Column) -> Column:
    """Lower-case hex SHA-256 of the values one after the other: '-' for a
    null, else UTF-8 length in bytes, ':', value."""
    texts = [v.cast("string") for v in values]
    cells = [F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]
    return F.sha2(F.concat(*cells).cast("binary"), 256)


def _pair_digest(below: str, i: Column) -> Column:
    """Digest of a node's children, ``below[2 * i]`` and the one after it, if any."""
    return F.sha2(F.concat(F.get(below, i * 2), F.coalesce(F.get(below, i * 2 + 1), F.lit(""))).cast("binary"), 256)


def _depth(n: Column) -> Column:
    """Levels above the leaves of a tree of ``n``: ceil(log2(n))."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0)


def ranked(df: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """``df`` (written to the shared folder) with ``lo``, the row's rank from 0
    within its group, and ``n``, the group's rows.  Rows are dealt by range of
    (group, order, row number), so no task holds a whole group or many equal
    rows; ranks are a partition's own plus the rows of earlier partitions."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [group, *order, "_row"]
    dealt = df.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    dealt = stage(dealt.drop("_row").withColumn("_at", F.monotonically_increasing_id()), "ranked")
    dealt = dealt.withColumn("_part", F.shiftright("_at", 33))
    counts = dealt.groupBy("_part", group).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(group)
    earlier = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stage(
        counts.select(
            "_part", group, (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(whole).alias("n")
        ),
        "offsets",
    )
    # a row per partition and group in it
    offsets = F.broadcast(offsets) if offsets.count() <= SMALL else offsets
    return dealt.join(offsets, ["_part", group]).withColumn("lo", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")


def _band(base: DataFrame, level: int) -> DataFrame:
    """The nodes of levels ``level + 1`` .. ``level + BAND`` (up to a group's
    root) over the nodes ``base`` (g, n, lo, hash) of level ``level``: g, n,
    level, lo, hi, hash, kids (lo, hi and hash of one or two children)."""
    width = level + BAND
    rows = base.groupBy("g", "n", F.shiftright("lo", width).alias("bucket")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("lo", "hash"))), lambda x: x["hash"]).alias(f"h{level}")
    )
    for lv in range(level + 1, width + 1):
        below = f"h{lv - 1}"
        pairs = F.sequence(F.lit(0), F.expr(f"(size({below}) - 1) div 2"))
        above = F.transform(pairs, partial(_pair_digest, below))
        rows = rows.withColumn(f"h{lv}", F.when(_depth(F.col("n")) >= lv, above))

    def start(i: Column, lv: int) -> Column:
        return F.shiftleft(F.col("bucket"), width) + F.shiftleft(i.cast("bigint"), lv)

    def label(i: Column, lv: int) -> list[Column]:
        return [start(i, lv).alias("lo"), F.least(start(i, lv) + (1 << lv), F.col("n")).alias("hi"), F.get(f"h{lv}", i).alias("hash")]

    def record(lv: int):
        def of(_h: Column, i: Column) -> Column:
            kids = F.array(*[F.struct(*label(k, lv - 1)) for k in (i * 2, i * 2 + 1)])
            return F.struct(F.lit(lv).alias("level"), *label(i, lv), F.filter(kids, lambda k: k["hash"].isNotNull()).alias("kids"))

        return F.transform(F.coalesce(f"h{lv}", F.array().cast("array<string>")), of)

    made = [record(lv) for lv in range(level + 1, width + 1)]
    return rows.select("g", "n", F.inline(F.concat(*made)))


def _paths(base: DataFrame, nodes: DataFrame, upper: DataFrame, level: int) -> DataFrame:
    """The nodes ``base`` (g, n, lo, hi, carry) of one level with their path to
    the whole table's root: ancestors in the band by containment, then the path
    of the band's top node (``upper``: g, bucket, path, subroot)."""
    width = level + BAND
    top = F.least(_depth(F.col("n")), F.lit(width))
    asked = base.select("g", "lo", "hi", "carry", F.explode(F.sequence(F.lit(level + 1), top)).alias("level"))
    asked = asked.select(
        "g", "level", "lo", "hi", F.when(F.col("level") == level + 1, F.col("carry")).alias("carry"), F.expr("shiftright(lo, level)").alias("cell")
    )
    at = nodes.select(
        F.col("g").alias("pg"), F.col("level").alias("plevel"), F.expr("shiftright(lo, level)").alias("pcell"),
        F.col("lo").alias("plo"), F.col("hi").alias("phi"), "kids",
    )
    inside = (F.col("plo") <= F.col("lo")) & (F.col("hi") <= F.col("phi"))
    same = (F.col("g") == F.col("pg")) & (F.col("level") == F.col("plevel")) & (F.col("cell") == F.col("pcell"))
    met = asked.join(at, same & inside)
    # the parent's interval without the child that covers this node
    rest = F.get(F.filter("kids", lambda k: ~((k["lo"] <= F.col("lo")) & (F.col("hi") <= k["hi"]))), F.lit(0))
    side = F.when(rest["lo"] < F.col("lo"), F.concat(F.lit("L"), rest["hash"])).when(rest["lo"] > F.col("lo"), F.concat(F.lit("R"), rest["hash"]))
    met = met.select("g", "lo", "carry", "level", F.coalesce(side, F.lit("")).alias("step"), F.shiftright("lo", width).alias("bucket"))
    found = met.repartition("g", "bucket").groupBy("g", "bucket", "lo").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("level", "step"))), lambda x: x["step"]).alias("own"),
        F.first("carry", ignorenulls=True).alias("carry"),
    )
    # as many rows as the level has: a band's share of the tree, never broadcast
    return found.join(upper.hint("merge"), ["g", "bucket"]).select(
        "g", "lo", F.concat("own", "path").alias("path"), "subroot", "carry"
    )


def _tree(leaves: DataFrame, tops: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """(base nodes, inner nodes) of every band of the trees over ``leaves``
    (g, n, lo, hash, carry), trees of up to ``tops`` levels."""
    bases, bands = [leaves.withColumn("hi", F.col("lo") + 1)], []
    for level in range(0, tops, BAND):
        todo = bases[-1].filter(_depth(F.col("n")) > level)
        bands.append(stage(_band(todo, level), "nodes"))
        bases.append(bands[-1].filter(F.col("level") == level + BAND).withColumn("carry", F.struct(F.lit(1).alias("none"))))
    return bases, bands


def _descend(bases: list[DataFrame], bands: list[DataFrame], tops: DataFrame) -> DataFrame:
    """(g, lo, path, subroot, carry) of every leaf; ``tops`` (g, n, path,
    subroot): each tree's root and the path above it."""
    tops = tops.withColumn("top", _depth(F.col("n")))
    above = None  # paths of the next band's base nodes
    for k in reversed(range(len(bands))):
        level = k * BAND
        ends = tops.filter((F.col("top") > level) & (F.col("top") <= level + BAND))
        upper = ends.select("g", F.lit(0).cast("bigint").alias("bucket"), "path", "subroot")
        if above is not None:
            upper = upper.unionByName(above.select("g", F.shiftright("lo", level + BAND).alias("bucket"), "path", "subroot"))
        above = _paths(bases[k].filter(_depth(F.col("n")) > level), bands[k], upper, level)
        if k:
            above = stage(above.drop("carry"), "paths")
    # trees of one leaf: the leaf is the root
    ones = bases[0].filter(F.col("n") == 1).join(tops.select("g", "path", "subroot").hint("merge"), "g")
    ones = ones.select("g", "lo", "path", "subroot", "carry")
    return ones if above is None else above.unionByName(ones)


def manifest(
    df: DataFrame, values: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", group_col: str = "lang",
    carry: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per row of ``df``: its id, ``leaf`` (digest of ``values``),
    ``subroot`` (of its group), ``root`` (of the table), ``path`` and the
    expressions ``carry`` over the row.  ``path`` has one step per level up to
    the root: 'L' or 'R' and the digest of the sibling on that side, or '' where
    the node has none; ``fold`` and ``siblings`` read it.

    Leaves of a group ascend by id (nulls first; equal ids by leaf digest,
    equal rows in any order: their digests are the same); groups ascend
    by their UTF-8 bytes, null first.  Every 2 consecutive nodes get the digest
    of their digests, a last single one of its own.  Null and empty values are
    told apart in the digest.  Columns not named are not read, whatever their
    names.  An empty table gives an empty result.
    """
    carry = carry or {}
    group = F.col(f"`{group_col}`").cast("string")
    leaves = df.select(
        F.when(group.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), group)).alias("g"),
        F.col(f"`{id_col}`").alias("id"),
        digest(*[F.col(f"`{c}`") for c in values]).alias("hash"),
        F.struct(F.lit(1).alias("none"), *[c.alias(name) for name, c in carry.items()]).alias("more"),
    )
    leaves = ranked(leaves, "g", ["id", "hash"])
    leaves = leaves.select("g", "n", "lo", "hash", F.struct("id", F.col("hash").alias("leaf"), "more").alias("carry"))
    height = leaves.agg(F.max(_depth(F.col("n")))).first()[0] or 0
    bases, bands = _tree(leaves, height)
    roots = bases[0].filter(F.col("n") == 1)
    for band in bands:
        roots = roots.select("g", "n", "hash").unionByName(band.filter(F.col("level") == _depth(F.col("n"))).select("g", "n", "hash"))
    roots = roots.select("g", F.col("n").alias("size"), "hash")

    # one more tree over the groups' roots
    heads = ranked(roots.select(F.lit("").alias("g"), F.col("g").alias("of"), "size", "hash"), "g", ["of"])
    heads = heads.select("g", "n", "lo", "hash", F.struct("of", "size", F.col("hash").alias("subroot")).alias("carry"))
    height = heads.agg(F.max(_depth(F.col("n")))).first()[0] or 0
    up_bases, up_bands = _tree(heads, height)
    top = up_bases[0].filter(F.col("n") == 1).select("n", "hash")
    for band in up_bands:
        top = top.unionByName(band.filter(F.col("level") == _depth(F.col("n"))).select("n", "hash"))
    top = top.select(F.lit("").alias("g"), "n", F.array().cast("array<string>").alias("path"), F.col("hash").alias("subroot"))
    tops = _descend(up_bases, up_bands, top)
    root = F.struct(F.col("carry.subroot").alias("subroot"), F.col("subroot").alias("root"))
    tops = stage(tops.select(F.col("carry.of").alias("g"), F.col("carry.size").alias("n"), "path", root.alias("subroot")), "tops")
    out = _descend(bases, bands, tops)
    return out.select(
        F.col("carry.id").alias(id_col), F.col("carry.leaf").alias("leaf"), F.col("subroot.subroot").alias("subroot"),
        F.col("subroot.root").alias("root"), "path", *[F.col(f"carry.more.{name}").alias(name) for name in carry],
    )


def fold(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf's digest and the siblings of its path."""

    def step(acc, s):
        other = F.substring(s, 2, 64)
        return F.sha2(F.when(s.startswith("L"), F.concat(other, acc)).when(s.startswith("R"), F.concat(acc, other)).otherwise(acc).cast("binary"), 256)

    return F.aggregate(path, leaf, step)


def siblings(path: Column) -> Column:
    """The digests of the siblings along a path, one after the other."""
    return F.array_join(F.transform(path, lambda s: F.substring(s, 2, 64)), "")


