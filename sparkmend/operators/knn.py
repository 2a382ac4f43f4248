"""K-nearest-neighbour join, in blocks.

Exact: both sides are cut into blocks of bounded size and every left block
meets every right block in a task of its own.  A pair of blocks costs one matrix
product and gives only k rows per left row; the k best over all blocks are then
picked per left row.  What a task holds is bounded by the block size, whatever
the tables, dimensions or copies.  Each side is sent once per block of the
other, so the left side should be the smaller one (the rows that ask).

Several metrics at once (``knn_joins``): a task holds a left block and the k best
rows so far of each of its rows, and the right side passes by, a bounded part at
a time.  The left side is sent once, the right side once per left block, and k
rows per left row come out.

Approximate (euclidean): the same blocks, but only within buckets of random
projections.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.exprs import q, row_hash
from ..session import cut_lineage


def vector_col(df: DataFrame, vec: str | None = None, feats: Sequence[str] | None = None) -> Column:
    if vec is not None:
        return F.transform(F.col(q(vec)), lambda x: x.cast("double"))
    return F.array(*[F.col(q(c)).cast("double") for c in feats])


def require_complete(df: DataFrame, feats: Sequence[str]) -> None:
    """Raise when a feature is missing in some row: a distance needs all."""
    row = df.agg(*[F.count_if(F.col(q(c)).isNull()).alias(c) for c in feats]).first().asDict()
    lacking = sorted(c for c, n in row.items() if n)
    if lacking:
        raise ValueError(f"missing values in {lacking}: impute them first")


def knn_join(
    left: DataFrame,
    right: DataFrame,
    lkey: str,
    rkey: str,
    k: int = 5,
    vec: str | None = None,
    feats: Sequence[str] | None = None,
    metric: str = "euclidean",
    p: float = 2.0,
    exclude_self: bool = False,
    mode: str = "exact",
    tables: int = 16,
    bucket_length: float | None = None,
    seed: int = 42,
    carry: str | None = None,
    by: str | None = None,
    complete: bool = False,
) -> DataFrame:
    """(lkey, rkey, dist, rank) for the k nearest right rows of every left
    row, and their column ``carry``; ties ordered by right key.  With ``by`` (exact
    mode) rows meet only those of the same value, and a left key counts once per
    value.  ``complete``: the features are known to have no missing value.  Rows without a vector have no neighbours
    and are nobody's.

    ``mode='exact'``: every left block meets every right block.
    ``mode='approx'`` (euclidean): rows meet where one of ``tables`` random
    projections puts them in the same bucket of width ``bucket_length`` (taken
    from the data if not given); left rows that meet fewer than k others go
    the exact way."""
    if mode not in ("exact", "approx"):
        raise ValueError(f"unknown mode {mode}")
    if mode == "approx" and not (metric == "euclidean" or (metric == "minkowski" and p == 2)):
        raise ValueError("the approximate mode is for the euclidean metric")
    if by is not None and mode != "exact":
        raise ValueError("groups are for the exact mode")
    kernel = _Kernel(k, metric, p, exclude_self)
    L, R = _sides(left, right, lkey, rkey, vec, feats, carry, by, complete)
    near = _grid(L, R, kernel) if mode == "exact" else _buckets(L, R, kernel, tables, bucket_length, seed)
    near = near.withColumn("space", F.lit(0))
    return _renamed(_top(near, [kernel], [*(["g"] if by else []), "lk"]), lkey, rkey, carry, by).drop("space")


def knn_joins(
    left: DataFrame, right: DataFrame, lkey: str, rkey: str, spaces: Sequence[tuple[int, str, float]], vec: str | None = None, feats: Sequence[str] | None = None, carry: str | None = None, by: str | None = None, complete: bool = False
) -> DataFrame:
    """The exact ``knn_join`` of every (k, metric, p) in ``spaces`` over one pass of
    the rows, numbered by column ``space``."""
    L, R = _sides(left, right, lkey, rkey, vec, feats, carry, by, complete)
    kernels = [_Kernel(k, metric, p, False) for k, metric, p in spaces]
    keys = [*(["g"] if by else []), "lk"]
    near = _passes(L, R, kernels)
    # rows that share a key are one asker; else the ranks are known already
    alone = not L.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).collect()
    return _renamed(near if alone else _top(near, kernels, keys), lkey, rkey, carry, by)


def _sides(left: DataFrame, right: DataFrame, lkey: str, rkey: str, vec, feats, carry, by, complete: bool) -> tuple[DataFrame, DataFrame]:
    if feats is not None and not complete:
        require_complete(left, feats)
        require_complete(right, feats)
    group = [F.col(q(by)).alias("g")] if by else []
    more = [F.col(q(carry)).alias("more")] if carry else []
    L = left.select(*group, F.col(q(lkey)).alias("lk"), vector_col(left, vec, feats).alias("v")).where("v IS NOT NULL")
    R = right.select(*group, F.col(q(rkey)).alias("rk"), *more, vector_col(right, vec, feats).alias("v")).where("v IS NOT NULL")
    return L, R


def _top(near: DataFrame, kernels: list[_Kernel], keys: list[str]) -> DataFrame:
    """The k nearest of every key and space, ranked."""
    w = Window.partitionBy("space", *keys).orderBy("dist", "rk")
    most = F.element_at(F.array(*[F.lit(x.k) for x in kernels]), F.col("space") + 1)
    return near.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= most)


def _renamed(top: DataFrame, lkey: str, rkey: str, carry, by) -> DataFrame:
    return top.select("space", *([F.col("g").alias(by)] if by else []), F.col("lk").alias(lkey), F.col("rk").alias(rkey), "dist", "rank", *([F.col("more").alias(carry)] if carry else []))


# ── blocks ──────────────────────────────────────────────────────────────────


class _Kernel:
    """Nearest right rows of each left row, within two blocks.

    Euclidean distances come from one matrix product, |a|^2 + |b|^2 - 2ab, which
    is off by rounding; all right rows within that error of the k-th smallest
    are measured again coordinate by coordinate, so the k kept are the exact
    ones, ties by key included.  Other metrics add up coordinate by coordinate."""

    STRIP = 1 << 21  # distances held at once
    ROWS, COLS = 16, 1024  # of a tile whose coordinates are added up

    def __init__(self, k: int, metric: str, p: float, exclude_self: bool):
        self.k, self.exclude_self = k, exclude_self
        self.p = {"euclidean": 2.0, "manhattan": 1.0, "chebyshev": math.inf, "minkowski": float(p)}[metric]

    def whole(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Distances of rows ``a`` to rows ``b``, up to a monotone function."""
        if self.p == 2:
            return (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
        out = np.zeros((len(a), len(b)))
        theirs = np.ascontiguousarray(b.T)
        for r in range(0, len(a), self.ROWS):
            for c in range(0, len(b), self.COLS):
                self._add_up(a[r : r + self.ROWS], theirs[:, c : c + self.COLS], out[r : r + self.ROWS, c : c + self.COLS])
        return out

    def _add_up(self, a: np.ndarray, theirs: np.ndarray, out: np.ndarray) -> None:
        """Distances of a tile, which stays in the processor's cache while its
        coordinates are added up; whole powers are products."""
        total, d, power = np.zeros(out.shape), np.empty(out.shape), np.empty(out.shape)
        for j in range(a.shape[1]):
            np.subtract(a[:, j, None], theirs[j], out=d)
            np.abs(d, out=d)
            if self.p == math.inf:
                np.maximum(total, d, out=total)
                continue
            if self.p in (3, 4):
                np.multiply(d, d, out=power)
                d = np.multiply(power, d if self.p == 3 else power, out=d)
            elif self.p != 1:
                np.power(d, self.p, out=d)
            total += d
        out[:] = total

    def exact(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Distances of row ``a[i]`` to row ``b[i]``."""
        d = np.abs(a - b)
        if self.p == math.inf:
            return d.max(1, initial=0.0)
        if self.p == 1:
            return d.sum(1)
        return np.sqrt((d * d).sum(1)) if self.p == 2 else (d**self.p).sum(1) ** (1.0 / self.p)

    @property
    def want(self) -> int:
        return self.k + (1 if self.exclude_self else 0)

    def nearest(self, a: np.ndarray, b: np.ndarray, order: np.ndarray, held: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(i, j, distance): up to k rows of ``b`` per row of ``a`` (k + 1 where
        a row may meet itself), ties by ``order``.  ``held``: distances beyond
        which a row of ``a`` wants no others (inf: no bound)."""
        if not len(a) or not len(b):
            return
        want = min(self.want, len(b))
        scale = (b * b).sum(1).max()
        for at in range(0, len(a), step := max(1, self.STRIP // len(b))):
            x = a[at : at + step]
            d = self.whole(x, b)
            far = np.full(len(x), np.inf) if held is None else held[at : at + step]
            far = far if self.p in (1, math.inf) else far**self.p
            if not np.isfinite(far).all():
                far = np.minimum(far, np.partition(d, want - 1, axis=1)[:, want - 1])
            slack = 1e-11 * ((x * x).sum(1) + scale) if self.p == 2 else 1e-11 * np.abs(far)
            i, j = np.nonzero(d <= (far + slack)[:, None])
            if not len(i):
                continue
            # of ties, more than fit at once
            some = max(1, self.STRIP // max(1, a.shape[1]))
            dist = np.concatenate([self.exact(x[i[t : t + some]], b[j[t : t + some]]) for t in range(0, len(i), some)])
            by = np.lexsort((order[j], dist, i))
            i, j, dist = i[by], j[by], dist[by]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            best = place < want
            yield i[best] + at, j[best], dist[best]

    def cells(self, left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
        """The nearest of every cell: rows of both sides that share ``keys``,
        a block of each."""
        kept = [c for c in ("rk", "more") if c in right.columns]
        asked = [c for c in ("g", "lk") if c in left.columns]
        kinds = {c: left.schema[c].dataType for c in asked} | {c: right.schema[c].dataType for c in kept}
        schema = T.StructType([T.StructField(c, t) for c, t in kinds.items()] + [T.StructField("dist", T.DoubleType())])
        arrow = to_arrow_schema(schema)

        def run(one: pa.Table, other: pa.Table) -> pa.Table:
            found = list(self.nearest(_vectors(one), _vectors(other), _order(other)))
            if not found:
                return arrow.empty_table()
            i, j, dist = (np.concatenate(x) for x in zip(*found, strict=True))
            theirs = [other.column(c).take(pa.array(j)) for c in kept]
            out = pa.Table.from_arrays([*[one.column(c).take(pa.array(i)) for c in asked], *theirs, pa.array(dist)], schema=arrow)
            return out.filter(pc.invert(pc.fill_null(pc.equal(out["lk"], out["rk"]), False))) if self.exclude_self else out

        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)


def _vectors(table: pa.Table) -> np.ndarray:
    v = table.column("v").combine_chunks()
    return v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1) if len(v) else np.zeros((0, 0))


def _order(table: pa.Table) -> np.ndarray:
    rk = table.column("rk").combine_chunks()
    return pc.rank(rk, sort_keys="ascending", null_placement="at_start", tiebreaker="first").to_numpy() if len(rk) else np.zeros(0)


class _Asking:
    """A block of left rows and, for each kernel, the nearest right rows met so
    far: their distances, ascending, and their places in ``pool`` (-1: none)."""

    def __init__(self, left: pa.Table, kernels: list[_Kernel], kept: list[str]):
        self.left, self.kernels, self.kept = left.drop_columns(["v"]), kernels, kept
        self.x = _vectors(left)
        self.best = [(np.full((len(self.x), k.want), np.inf), np.full((len(self.x), k.want), -1)) for k in kernels]
        self.pool: pa.Table | None = None

    def meet(self, right: pa.Table) -> None:
        y, rows = _vectors(right), right.select(self.kept)
        both = rows if self.pool is None else pa.concat_tables([self.pool, rows])
        order, first = _order(both), len(both) - len(rows)
        for kernel, (dist, place) in zip(self.kernels, self.best, strict=True):
            found = list(kernel.nearest(self.x, y, order[first:], dist[:, -1]))
            if not found:
                continue
            i, j, d = (np.concatenate(x) for x in zip(*found, strict=True))
            mine = np.unique(i)
            had = place[mine] >= 0
            i, j, d = np.concatenate([i, np.repeat(mine, had.sum(1))]), np.concatenate([j + first, place[mine][had]]), np.concatenate([d, dist[mine][had]])
            by = np.lexsort((order[j], d, i))
            i, j, d = i[by], j[by], d[by]
            at = np.arange(len(i)) - np.searchsorted(i, i)
            keep = at < kernel.want
            dist[i[keep], at[keep]], place[i[keep], at[keep]] = d[keep], j[keep]
        # only the rows that are somebody's are kept
        used = np.unique(np.concatenate([place[place >= 0] for _dist, place in self.best]))
        for _dist, place in self.best:
            place[place >= 0] = np.searchsorted(used, place[place >= 0])
        self.pool = both.take(pa.array(used)).combine_chunks()

    def found(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        for space, (kernel, (dist, place)) in enumerate(zip(self.kernels, self.best, strict=True)):
            i, at = np.nonzero(place >= 0)
            if not len(i):
                continue
            rows, theirs = self.left.take(pa.array(i)), self.pool.take(pa.array(place[i, at]))
            if kernel.exclude_self:
                other = np.flatnonzero(pc.invert(pc.fill_null(pc.equal(rows["lk"], theirs["rk"]), False)).to_numpy())
                i, at, rows, theirs = i[other], at[other], rows.take(pa.array(other)), theirs.take(pa.array(other))
            rank = np.arange(len(i)) - np.searchsorted(i, i) + 1
            more = {"space": pa.array(np.full(len(i), space), pa.int32()), "dist": pa.array(dist[i, at]), "rank": pa.array(rank, pa.int32())}
            columns = {c: more[c] if c in more else rows[c] if c in rows.column_names else theirs[c] for c in schema.names}
            yield from pa.table(columns, schema=schema).filter(pa.array(rank <= kernel.k)).combine_chunks().to_batches()


BLOCK = 1 << 20  # numbers of a block's vectors
LEAST = 1024  # rows below which a block is not cut for the sake of more tasks


def _width(df: DataFrame) -> tuple[int, int]:
    """(rows, longest vector)."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first()
    return int(row["n"]), max(int(row["d"] or 1), 1)


def _parts(n: int, dim: int, tasks: int) -> int:
    """Blocks of ``n`` rows: none above BLOCK numbers, enough for ``tasks``."""
    return max(1, -(-n * dim // BLOCK), min(tasks, n // LEAST))


def _block_of(key: str, parts) -> Column:
    # a number of the row besides its key: equal keys are dealt apart
    return F.pmod(F.xxhash64(key, F.monotonically_increasing_id()), F.lit(parts) if isinstance(parts, int) else parts).cast("int")


def _grid(L: DataFrame, R: DataFrame, kernel: _Kernel) -> DataFrame:
    """Every left block with every right block; a task holds one of each."""
    tasks = int(L.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (n_right, dim), (n_left, _) = _width(R), _width(L)
    right = _parts(n_right, dim, tasks)
    left = _parts(n_left, dim, -(-tasks // right))
    each = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    lefts = L.withColumn("lb", _block_of("lk", left)).select("*", each(right, "rb"))
    rights = R.withColumn("rb", _block_of("rk", right)).select("*", each(left, "lb"))
    return kernel.cells(lefts, rights, [*(["g"] if "g" in L.columns else []), "lb", "rb"])


def _passes(L: DataFrame, R: DataFrame, kernels: list[_Kernel]) -> DataFrame:
    """The nearest right rows of every left row, ranked, per kernel (``space``): a
    task holds a block of left rows, and the right rows (of its group) pass by.
    Groups are few: their row counts come to the driver."""
    grouped = "g" in L.columns
    sizes = L.groupBy(*(["g"] if grouped else [])).agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).collect()
    dim = max([1, *(r["d"] or 1 for r in sizes)])
    held = 2 * sum(x.want for x in kernels)
    tasks = -(-L.sparkSession.sparkContext.defaultParallelism // max(1, len(sizes)))
    # at most two BLOCKs of vectors, or of neighbours held
    parts = [_parts(int(r["n"]), -(-max(dim, held) // 2), tasks) for r in sizes] or [1]
    first = [sum(parts[:i]) for i in range(len(parts))]

    def of_group(values: list[int]) -> Column:
        if not grouped or not sizes:
            return F.lit(values[0])
        return F.coalesce(*[F.when(F.col("g").eqNullSafe(F.lit(r["g"])), v) for r, v in zip(sizes, values, strict=True)])

    lefts = L.withColumn("cell", of_group(first) + _block_of("lk", of_group(parts))).withColumn("side", F.lit(0))
    rights = R.withColumn("cell", F.explode(F.sequence(of_group(first), of_group(first) + of_group(parts) - 1))).withColumn("side", F.lit(1))
    both = lefts.unionByName(rights.drop("g"), allowMissingColumns=True)
    kept = [c for c in ("rk", "more") if c in R.columns]
    asked = [c for c in ("g", "lk") if c in L.columns]
    kinds = {c: both.schema[c].dataType for c in [*asked, *kept]}
    schema = T.StructType([T.StructField("space", T.IntegerType()), *[T.StructField(c, t) for c, t in kinds.items()], T.StructField("dist", T.DoubleType()), T.StructField("rank", T.IntegerType())])
    arrow = to_arrow_schema(schema)
    some = max(1, 2 * BLOCK // dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, left, asking = None, [], None
        for batch in batches:
            at = batch.column("cell").to_numpy(), batch.column("side").to_numpy()
            cuts = np.flatnonzero((np.diff(at[0]) != 0) | (np.diff(at[1]) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if a == b:
                    continue
                if at[0][a] != cell:
                    if asking is not None:
                        yield from asking.found(arrow)
                    cell, left, asking = at[0][a], [], None
                rows = pa.Table.from_batches([batch.slice(a, b - a)])
                if at[1][a] == 0:
                    left.append(rows.select([*asked, "v"]))
                    continue
                if asking is None and left:
                    asking, left = _Asking(pa.concat_tables(left), kernels, kept), []
                for t in range(0, len(rows) if asking is not None else 0, some):
                    asking.meet(rows.slice(t, some))
        if asking is not None:
            yield from asking.found(arrow)

    # a block is a partition; its left rows come first
    return both.repartitionById(sum(parts), F.col("cell")).sortWithinPartitions("cell", "side").mapInArrow(run, schema)


def _buckets(L: DataFrame, R: DataFrame, kernel: _Kernel, tables: int, bucket_length: float | None, seed: int) -> DataFrame:
    """Blocks of rows in one bucket of one projection; a bucket above a block's
    size is cut on both sides, so that a hot one meets in many tasks."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector, vector_to_array

    n_right, dim = _width(R)
    if bucket_length is None:
        bucket_length = _near_distance(L, R, kernel, seed) * WIDTH / math.sqrt(dim)
    # a number of its own tells rows of one key apart and stays the same below
    L = cut_lineage(L.withColumn("row", F.monotonically_increasing_id()))
    lsh = BucketedRandomProjectionLSH(inputCol="f", outputCol="h", bucketLength=max(bucket_length, 1e-12), numHashTables=tables, seed=seed)
    model = lsh.fit(R.select(array_to_vector("v").alias("f")))

    def hashed(df: DataFrame) -> DataFrame:
        h = model.transform(df.withColumn("f", array_to_vector("v"))).drop("f")
        at = F.posexplode(F.transform("h", lambda x: F.get(vector_to_array(x), F.lit(0)))).alias("t", "bucket")
        return h.select(*df.columns, at)

    block = max(1, BLOCK // dim)
    sizes = None
    for name, df in (("n_left", L), ("n_right", R)):
        one = hashed(df).groupBy("t", "bucket").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name))
        sizes = one if sizes is None else sizes.join(one, ["t", "bucket"])
    sizes = cut_lineage(sizes)  # buckets that both sides have
    keys = ["t", "bucket", "lb", "rb"]
    cuts = lambda c, name: F.explode(F.sequence(F.lit(0), F.col(c) - 1)).alias(name)
    lefts = hashed(L).join(sizes, ["t", "bucket"]).withColumn("lb", F.pmod(F.xxhash64("row"), F.col("n_left")).cast("int"))
    lefts = lefts.select("t", "bucket", "lb", "lk", "v", cuts("n_right", "rb"))
    rights = hashed(R).join(sizes, ["t", "bucket"]).withColumn("rb", _block_of("rk", F.col("n_right")))
    rights = rights.select("t", "bucket", "rb", *R.columns, cuts("n_left", "lb"))
    met = kernel.cells(lefts, rights, keys)
    met = cut_lineage(met.groupBy("lk", *[c for c in R.columns if c != "v"]).agg(F.min("dist").alias("dist")))
    full = met.groupBy("lk").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min(kernel.k, n_right))
    rest = L.drop("row").join(full, "lk", "left_anti")
    return met.join(full.select("lk"), "lk", "left_semi").unionByName(_grid(rest, R, kernel))


SAMPLE = 100  # left rows whose exact neighbours set the bucket width
WIDTH = 4.0  # bucket width in typical differences of neighbours along a projection


def _near_distance(L: DataFrame, R: DataFrame, kernel: _Kernel, seed: int) -> float:
    """Typical distance of a k-th neighbour, from the exact neighbours of
    ``SAMPLE`` left rows."""
    some = L.orderBy(row_hash(["lk"], seed, "near"), "lk").limit(SAMPLE)
    w = Window.partitionBy("lk").orderBy("dist", "rk")
    kth = _grid(some, R, kernel).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= kernel.k).groupBy("lk").agg(F.max("dist").alias("d"))
    return float(kth.agg(F.percentile("d", F.lit(0.75))).first()[0] or 1.0)  # of SAMPLE rows


def knn_classify(
    train: DataFrame,
    test: DataFrame,
    key: str,
    label: str,
    k: int = 5,
    weights: str = "uniform",
    vec: str | None = None,
    feats: Sequence[str] | None = None,
    metric: str = "euclidean",
    p: float = 2.0,
    neighbours: DataFrame | None = None,
    mode: str = "exact",
) -> DataFrame:
    """(key, label, prediction): vote of the k nearest training rows;
    'distance' weights 1/d, and exact hits (d = 0) win alone; ties -> the
    smallest label.  ``neighbours`` (from knn_join with a larger k) can be
    reused for every smaller k; with their labels as column __nl nothing is
    joined."""
    rkey = "__rk"
    tr = train.select(F.col(q(key)).alias(rkey), F.col(q(label)).alias("__nl"), *([F.col(q(vec))] if vec else [F.col(q(c)) for c in feats]))
    if neighbours is None:
        neighbours = knn_join(test, tr, key, rkey, k, vec, feats, metric, p, mode=mode, carry="__nl")
    elif "__nl" not in neighbours.columns:
        neighbours = neighbours.join(tr.select(rkey, "__nl"), rkey)
    nb = neighbours.where(F.col("rank") <= k)
    return test.select(F.col(q(key)), F.col(q(label))).join(vote(nb, key, weights), key, "left")


def vote(neighbours: DataFrame, key: str, weights: str = "uniform") -> DataFrame:
    """(key, prediction) from neighbours with their labels as column __nl."""
    d = F.col("dist")
    w = F.when(d != 0, 1.0 / d) if weights == "distance" else F.lit(1.0)
    hits = F.count_if(d == 0) if weights == "distance" else F.lit(0)
    votes = neighbours.groupBy(key, "__nl").agg(hits.cast("double").alias("__z"), F.sum(w).alias("__v"))
    # most exact hits, else most votes, then the smallest label
    best = [F.min(F.struct((-F.coalesce(v, F.lit(0.0))).alias("v"), F.col("__nl").alias("l"))) for v in (F.col("__z"), F.col("__v"))]
    votes = votes.groupBy(key).agg(F.max("__z").alias("z"), best[0].alias("bz"), best[1].alias("bv"))
    return votes.select(key, F.when(F.col("z") > 0, F.col("bz.l")).otherwise(F.col("bv.l")).alias("prediction"))
