"""SimHash near-dedup with a binary-trie self-join.

A document's fingerprint has bit b set when more than half of its shingle
hashes have it.  Distinct fingerprints form a binary trie (a range of the
sorted fingerprints is a node); the self-join walks pairs of nodes together
from the top bit, adds up the differing bits and drops a pair as soon as
they exceed the budget.

The upper part of the trie is cut into leaves of about ``n / LEAVES``
fingerprints (never more than LEAF_MAX), split where the fingerprints are (prefix counts, so a crowded
prefix is split deeper).  The walk over this top trie says which leaves can
hold partners; a task owns one leaf, receives its partner leaves and goes on
walking below.  Only a spanning forest of the links it finds leaves a task;
components come from rounds of star contraction over those edges.  Equal
fingerprints are one node, so copies never become pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_names, stage

LEAVES = 2048  # of the top trie, about, until leaves reach LEAF_MAX
LEAF_MIN = 1024  # fingerprints; smaller nodes are not split
LEAF_MAX = 1 << 18  # fingerprints; larger nodes are split, whatever the number of leaves
STEP_BITS = 12  # of one prefix count, fewer where many prefixes are counted
COUNTS_BITS = 16  # 2**COUNTS_BITS counts are collected at a time, or two per full prefix
FRONT = 1 << 20  # node pairs walked at a time (bounds a task's memory)
DIRECT = 64  # node pairs of at most so many fingerprint pairs are compared at once
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: str | None, shingle: int) -> int:
    """64 bits; zero for a text without words."""
    import xxhash

    words = _WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, 42)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = (end - size)[: len(words) - shingle + 1].tolist()
    end = end[shingle - 1 :].tolist()
    ones, n = np.zeros(64, np.int64), len(start)
    for at in range(0, n, 8192):  # bounded memory for very long texts
        h = np.fromiter((digest(joined[a:z], 42) for a, z in zip(start[at : at + 8192], end[at : at + 8192])), np.uint64)
        ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def with_fingerprint(df: DataFrame, text_col: str, out: str, shingle: int) -> DataFrame:
    """``df`` plus the fingerprint as a signed long."""

    @F.pandas_udf("bigint")
    def udf(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))

    return df.withColumn(out, udf(F.col(text_col)))


def _order(col):
    """Signed long in unsigned order (top bit flipped)."""
    return col.bitwiseXOR(F.lit(-(1 << 63)))


def top_leaves(fps: DataFrame, n: int) -> list[tuple[int, int]]:
    """(prefix, depth) of the top trie's leaves, in order: prefixes are split
    while they hold more than ``n / LEAVES`` fingerprints (at least LEAF_MIN,
    at most LEAF_MAX, so that a task's leaf and its partners stay bounded as
    the table grows).  A count brings at most 2**COUNTS_BITS rows to the
    driver, or two per prefix that is still too full."""
    full = max(LEAF_MIN, min(LEAF_MAX, -(-n // LEAVES)))
    leaves, todo, depth = [], {0: n}, 0
    if n <= full:
        return [(0, 0)]
    while todo:
        step = min(STEP_BITS, max(1, COUNTS_BITS - (len(todo) - 1).bit_length()))
        deep = min(64, depth + step)
        rows = fps.select(F.shiftrightunsigned("fp", 64 - deep).alias("p") if deep < 64 else F.col("fp").alias("p"))
        if depth:
            up = F.shiftrightunsigned("p", deep - depth) if deep < 64 else F.shiftrightunsigned("p", 64 - depth)
            rows = rows.filter(up.isin([_signed(t) for t in todo]))
        got = {r["p"] % (1 << 64) if deep == 64 else r["p"]: r["n"] for r in rows.groupBy("p").agg(F.count("*").alias("n")).collect()}
        level = {deep: got}
        for d in range(deep - 1, depth - 1, -1):
            level[d] = {}
            for p, c in level[d + 1].items():
                level[d][p >> 1] = level[d].get(p >> 1, 0) + c
        nxt, stack = {}, [(p, depth) for p in level[depth]]
        while stack:
            p, d = stack.pop()
            c = level[d].get(p, 0)
            if not c:
                continue
            if c <= full or d == 64:
                leaves.append((p, d))
            elif d == deep:
                nxt[p] = c
            else:
                stack += [(2 * p, d + 1), (2 * p + 1, d + 1)]
        todo, depth = nxt, deep
    return sorted(leaves, key=lambda x: x[0] << (64 - x[1]))


def _signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def leaf_pairs(leaves: list[tuple[int, int]], budget: int) -> list[tuple[int, int]]:
    """(i, j), i <= j, of leaves whose prefixes differ in at most ``budget``
    bits: the same walk of node pairs, over the top trie."""
    low = np.array([p << (64 - d) for p, d in leaves], np.uint64)
    depth = np.array([d for _, d in leaves])
    out, node = [], np.int64
    a0, a1 = np.zeros(1, node), np.full(1, len(leaves), node)
    b0, b1, diff, level = a0.copy(), a1.copy(), np.zeros(1, node), 0
    while len(a0):
        # a leaf that ends at this level stands for both of its halves
        done = ((a1 - a0 == 1) & (depth[a0] <= level)) | ((b1 - b0 == 1) & (depth[b0] <= level))
        for x0, x1, y0, y1 in zip(a0[done], a1[done], b0[done], b1[done]):
            for i in range(x0, x1):
                for j in range(max(i, y0), y1):
                    shared = min(depth[i], depth[j])
                    gap = int(low[i] ^ low[j]) >> (64 - int(shared)) if shared else 0
                    if gap.bit_count() <= budget:
                        out.append((i, j))
        a0, a1, b0, b1, diff = (x[~done] for x in (a0, a1, b0, b1, diff))
        if level == 64:
            break
        a0, a1, b0, b1, diff = _descend(low, low, a0, a1, b0, b1, diff, level, budget)
        keep = b1 > a0  # the other order is walked too
        a0, a1, b0, b1, diff = (x[keep] for x in (a0, a1, b0, b1, diff))
        level += 1
    return sorted(set(out))


def _descend(a, b, a0, a1, b0, b1, diff, level, budget):
    """The child pairs of node pairs at bit ``level`` (0 is the top bit)."""

    def split(v, lo, hi):
        ones = np.concatenate(([0], np.cumsum((v >> np.uint64(63 - level)) & np.uint64(1), dtype=np.int64)))
        return hi - (ones[hi] - ones[lo])

    am, bm = split(a, a0, a1), split(b, b0, b1)
    parts = [
        (a0, am, b0, bm, diff),
        (am, a1, bm, b1, diff),
        (a0, am, bm, b1, diff + 1),
        (am, a1, b0, bm, diff + 1),
    ]
    a0, a1, b0, b1, diff = (np.concatenate([p[i] for p in parts]) for i in range(5))
    ok = (a1 > a0) & (b1 > b0) & (diff <= budget)
    return a0[ok], a1[ok], b0[ok], b1[ok], diff[ok]


def walk(a: np.ndarray, b: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (into sorted distinct a and b) of fingerprints with at most
    ``budget`` differing bits and a < b, in portions."""
    one = np.zeros(1, np.int64)
    stack = [(0, one, one + len(a), one.copy(), one + len(b), one.copy())]
    while stack:
        level, a0, a1, b0, b1, diff = stack.pop()
        if len(a0) > FRONT:
            h = len(a0) // 2
            stack.append((level, *(x[:h] for x in (a0, a1, b0, b1, diff))))
            stack.append((level, *(x[h:] for x in (a0, a1, b0, b1, diff))))
            continue
        direct = ((a1 - a0) * (b1 - b0) <= DIRECT) if level < 64 else np.ones(len(a0), bool)
        if direct.any():
            x0, nx, y0, ny = a0[direct], (a1 - a0)[direct], b0[direct], (b1 - b0)[direct]
            for at in range(0, len(x0), FRONT // DIRECT):
                part = slice(at, at + FRONT // DIRECT)
                n = nx[part] * ny[part]
                k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                i = np.repeat(x0[part], n) + k // np.repeat(ny[part], n)
                j = np.repeat(y0[part], n) + k % np.repeat(ny[part], n)
                ok = (a[i] < b[j]) & (np.bitwise_count(a[i] ^ b[j]) <= budget)
                if ok.any():
                    yield i[ok], j[ok]
            a0, a1, b0, b1, diff = (x[~direct] for x in (a0, a1, b0, b1, diff))
        if len(a0):
            stack.append((level + 1, *_descend(a, b, a0, a1, b0, b1, diff, level, budget)))


def forest(own: np.ndarray, every: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """(smallest member, member) of the links that ``walk`` finds between
    ``own`` and ``every`` (sorted, distinct; own is part of every)."""
    at = np.searchsorted(every, own)
    label = np.arange(len(every))
    for i, j in walk(own, every, budget):
        u, v = at[i], j
        while True:
            x, y = label[u], label[v]  # roots: members point at them
            if np.array_equal(x, y):
                break
            # only roots are moved, so links of earlier portions hold
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(label, label[label]):
                label = label[label]
    ends = np.flatnonzero(label != np.arange(len(every)))
    return every[label[ends]], every[ends]


def links(fps: DataFrame, max_bits: int) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of distinct
    fingerprints ``fp`` with at most ``max_bits`` differing bits."""
    n = fps.count()
    leaves = top_leaves(fps, n)
    pairs = leaf_pairs(leaves, max_bits)
    # leaf j of a fingerprint, and the leaves i <= j whose tasks need it: both
    # tables are bounded by LEAVES
    start = [_signed((p << (64 - d)) ^ (1 << 63)) for p, d in leaves]
    goes: list[list[int]] = [[] for _ in leaves]
    for i, j in pairs:
        goes[j].append(i)

    @F.pandas_udf("array<int>")
    def tasks(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        first = np.array(start, np.int64)
        for s in parts:
            yield pd.Series([goes[x] for x in np.searchsorted(first, s.to_numpy(np.int64), "right") - 1])

    sent = fps.select("fp", F.explode(tasks(_order(F.col("fp")))).alias("task"))

    def work(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        every = np.unique(pdf["fp"].to_numpy(np.int64).view(np.uint64))
        p, d = leaves[key[0]]
        lo, hi = p << (64 - d), ((p + 1) << (64 - d)) - 1
        own = every[(every >= np.uint64(lo)) & (every <= np.uint64(hi))]
        a, b = forest(own, every, max_bits)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return sent.groupBy("task").applyInPandas(work, "a bigint, b bigint")


def _moved(rows: DataFrame, low: DataFrame, total: int) -> DataFrame:
    """``rows`` (u, v) with ``m`` of their node from ``low`` (u, m, n: the node's
    edges).  Nodes of more than total / (4 * partitions) edges are at most
    4 * partitions and are broadcast; the others are joined by key."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    low = stage(low, "lowest")
    many = F.col("n") > max(64, total // (4 * parts))
    hot = F.broadcast(low.filter(many).select("u", "m"))
    rest = rows.join(hot.select("u"), "u", "left_anti").join(low.filter(~many).select("u", "m").hint("merge"), "u")
    return rows.join(hot, "u").unionByName(rest)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every end of ``edges`` (a, b): connected components
    by alternating large-star and small-star rounds.  Smallest neighbours are
    map-side minima; a node with very many edges is joined to its own by
    broadcast (``_moved``), so its edges are never gathered in one place."""
    cur = stage(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        edges = cur.count()
        # large star: larger neighbours of a node move to its smallest
        both = cur.select("u", "v").union(cur.select(F.col("v"), F.col("u")).toDF("u", "v"))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = stage(_moved(both.filter("v > u"), low, 2 * edges).select(F.col("v").alias("u"), F.col("m").alias("v")), "edges")
        # small star: a node and its smaller neighbours move to the smallest
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = _moved(large, low, edges).select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        new = stage(small.filter("u <> v").distinct(), "edges")
        left = new.select(F.col("v").alias("u")).distinct().join(new.select("u").distinct(), "u", "left_semi").limit(1).count()
        many = new.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count()
        cur = new
        if not left and not many:
            break
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).union(cur.select("v", "v").distinct().toDF("node", "root"))


def rooted(fps: DataFrame, max_bits: int) -> DataFrame:
    """``fps`` (staged, a row per distinct fingerprint ``fp``) plus root, which
    names the component."""
    roots = stage(components(links(fps.select("fp"), max_bits)), "components")
    return fps.join(roots, fps["fp"] == roots["node"], "left").select(*fps.columns, F.coalesce("root", "fp").alias("root"))


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """Per row: id, fingerprint (16 hex digits), component_id: the smallest id
    reachable over links of at most ``max_bits`` differing bits.

    Words are separated by space and tab to carriage return; A-Z count as
    lower case.  A text of fewer words than a shingle is one shingle; null,
    empty and blank texts have fingerprint zero and are linked like any other.
    Null ids are ignored in the minimum (a component of null ids only has a
    null component_id).  Repeated rows give a row each.  Other columns are not
    read; an empty table gives an empty result."""
    ids, text = free_names(df, "id", "t")
    rows = stage(
        with_fingerprint(df.select(F.col(id_col).alias(ids), F.col(text_col).alias(text)), text, "fp", shingle).select(
            F.col(ids).alias("id"), "fp"
        ),
        "fingerprints",
    )
    named = rooted(stage(rows.groupBy("fp").agg(F.min("id").alias("low")), "distinct-fingerprints"), max_bits)
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    # a table of one row per distinct fingerprint; the rows' side may be hot in
    # one fingerprint, which the adaptive join splits
    final = named.join(lowest, "root").select("fp", "component_id")
    return rows.join(final, "fp", "left").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """One row of ``df`` per component: the smallest id's, of its rows the one
    with the smallest fingerprint and text hash.  A null id loses to any other; of a
    component of null ids only, one row stays, chosen alike.

    A row is kept or dropped for itself: other rows with its id do not matter."""
    fp, row = free_names(df, "fp", "row")
    rows = stage(with_fingerprint(df, text_col, fp, shingle).withColumn(row, F.monotonically_increasing_id()), "fingerprints")
    order = F.struct(F.col(id_col).alias("id"), F.col(fp).alias("fp"), F.xxhash64(text_col).alias("hash"), F.col(row).alias("row"))
    null = F.col(id_col).isNull()
    # minima on the map side, as one fingerprint may have very many rows
    firsts = rows.groupBy(F.col(fp).alias("fp")).agg(F.min(F.when(~null, order)).alias("named"), F.min(F.when(null, order)).alias("unnamed"))
    firsts = rooted(stage(firsts, "distinct-fingerprints"), max_bits)
    kept = firsts.groupBy("root").agg(F.min("named").alias("named"), F.min("unnamed").alias("unnamed"))
    kept = kept.select(F.coalesce("named.row", "unnamed.row").alias("kept_row"))
    return rows.join(kept, rows[row] == kept["kept_row"], "left_semi").drop(fp, row)


__all__ = ["near_dedup", "keep_one", "components", "fingerprint"]
