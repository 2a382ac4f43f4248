"""DuckDB SQL builders for the oracles (the independent check of each
Spark query).  They write the same definitions in plain SQL."""

from __future__ import annotations

from ..config import DEFAULT_PROFILE as P
from ..functions.exprs import NUM_RE


def strip_sql(c: str) -> str:
    return f"trim({c}, chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))"


def parse_sql(c: str) -> str:
    s = strip_sql(f"CAST({c} AS VARCHAR)")
    v = f"(CASE WHEN regexp_matches({s}, '{NUM_RE}') THEN TRY_CAST({s} AS DOUBLE) END)"
    return f"(CASE WHEN isnan({v}) THEN NULL ELSE {v} END)"


def r(x: str, dp: int = 6) -> str:
    return f"round(CAST({x} AS DOUBLE), {dp})"


def union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def guarded_corr_sql(x: str, y: str) -> str:
    xx = f"(CASE WHEN {y} IS NOT NULL THEN {x} END)"
    yy = f"(CASE WHEN {x} IS NOT NULL THEN {y} END)"
    den = f"sqrt(var_pop({xx}) * var_pop({yy}))"
    return f"coalesce(CASE WHEN {den} > 0 THEN covar_pop({xx}, {yy}) / {den} END, 0.0)"


def missing_sql(src: str, cols: list[str]) -> str:
    parts = [f"SELECT '{c}' AS col_name, CAST(count(*) - count({c}) AS BIGINT) AS n_missing FROM {src}" for c in cols]
    return f"SELECT * FROM ({union(parts)}) WHERE n_missing > 0"


def quartile_cte(src: str, cols: list[str], k: float) -> str:
    parts = []
    for c in cols:
        parts.append(
            f"SELECT '{c}' AS col_name, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {src}"
        )
    return f"(SELECT col_name, q1, q3, q1 - {k} * (q3 - q1) AS lower, q3 + {k} * (q3 - q1) AS upper FROM ({union(parts)}))"


def outlier_sql(src: str, cols: list[str], k: float = P.outlier_iqr_factor) -> str:
    f = quartile_cte(src, cols, k)
    parts = []
    for c in cols:
        parts.append(
            f"SELECT '{c}' AS col_name, CAST(count(*) FILTER (WHERE {c} < f.lower OR {c} > f.upper) AS BIGINT) AS n FROM {src}, "
            f"(SELECT * FROM {f} WHERE col_name = '{c}') f"
        )
    return f"""SELECT f.col_name, f.q1, f.q3, f.lower, f.upper, o.n AS n_outliers
FROM {f} f JOIN ({union(parts)}) o ON f.col_name = o.col_name
WHERE f.q3 - f.q1 >= {P.iqr_floor} AND o.n >= {P.outlier_min_count}"""


def wrong_sql(src: str, cols: list[str]) -> str:
    parts = []
    for c in cols:
        bad = f"{c} IS NOT NULL AND {parse_sql(c)} IS NULL AND lower(trim({c})) <> 'nan'"
        parts.append(
            f"SELECT '{c}' AS col_name, CAST(count({c}) AS BIGINT) AS n_checked, CAST(count(*) FILTER (WHERE {bad}) AS BIGINT) AS n_bad FROM {src}"
        )
    return f"SELECT col_name, 'string' AS dtype, n_checked, n_bad, 'stored as string, appears numeric' AS message FROM ({union(parts)}) WHERE n_checked > 0 AND n_bad = 0"


def imbalance_sql(src: str, target: str) -> str:
    return f"""SELECT CAST(m.cls AS VARCHAR) AS minority, CAST(m.n AS DOUBLE) / total AS ratio,
  CAST(m.n AS DOUBLE) / total < {P.imbalance_threshold} AS imbalanced,
  CASE WHEN CAST(m.n AS DOUBLE) / total < {P.imbalance_threshold}
       THEN 'Imbalanced target ''{target}'': class ''' || CAST(m.cls AS VARCHAR) || ''' has ratio ' || printf('%.4f', CAST(m.n AS DOUBLE) / total) || ' (threshold {P.imbalance_threshold})' END AS message
FROM (SELECT sum(n) AS total, count(cls) AS n_classes,
             min({{'n': n, 'cls': cls}}) FILTER (WHERE cls IS NOT NULL) AS m
      FROM (SELECT {target} AS cls, count(*) AS n FROM {src} GROUP BY {target}))
WHERE n_classes BETWEEN 1 AND {P.max_classes}"""


def health_sql(src: str, num: list[str], cat: list[str], dtypes: list[tuple[str, str]], target: str | None) -> str:
    allc = [c for c, _ in dtypes]
    parts = [f"SELECT 'missing_values' AS issue, col_name, CAST(n_missing AS DOUBLE) AS value, CAST(NULL AS VARCHAR) AS detail FROM ({missing_sql(src, allc)})"]
    sk = union([f"SELECT '{c}' AS col_name, skewness({c}) AS g FROM {src}" for c in num])
    parts.append(f"SELECT 'high_skew', col_name, round(g, 4), CAST(NULL AS VARCHAR) FROM ({sk}) WHERE abs(g) > {P.skew_threshold}")
    sd = union([f"SELECT '{c}' AS col_name, {i} AS ord, stddev_samp({c}) AS s FROM {src}" for i, c in enumerate(num)])
    parts.append(
        f"""SELECT 'scale_mismatch', CAST(NULL AS VARCHAR), {r('hi.s / lo.s')}, hi.col_name || ' / ' || lo.col_name
FROM (SELECT col_name, s FROM ({sd}) WHERE s > 0 ORDER BY s DESC, ord LIMIT 1) hi,
     (SELECT col_name, s FROM ({sd}) WHERE s > 0 ORDER BY s ASC, ord LIMIT 1) lo,
     (SELECT count(*) AS k FROM ({sd}) WHERE s > 0) kk
WHERE kk.k >= 2 AND hi.s / lo.s > {P.scale_ratio}"""
    )
    parts.append(f"SELECT 'outliers', col_name, CAST(n_outliers AS DOUBLE), CAST(NULL AS VARCHAR) FROM ({outlier_sql(src, num)})")
    if target is not None:
        parts.append(f"SELECT 'class_imbalance', minority, ratio, message FROM ({imbalance_sql(src, target)}) WHERE imbalanced")
    if cat:
        parts.append(f"SELECT 'wrong_dtypes', col_name, CAST(NULL AS DOUBLE), message FROM ({wrong_sql(src, cat)})")
    vals = ", ".join(f"('{c}', '{t}')" for c, t in dtypes)
    parts.append(f"SELECT 'dtype', c, CAST(NULL AS DOUBLE), t FROM (VALUES {vals}) v(c, t)")
    return union(parts)


# ── ridge regression in SQL (for oracles) ───────────────────────────────────


def gram_sql(src: str, feats: list[str], y: str, where: str, shift: str) -> str:
    """One row ``g``: the matrix of sums z_i z_j of z = [feats, y] - shift over
    the rows of ``src`` (columns feats and y) that satisfy ``where``, missing
    values at the mean; ``n``: their count.  ``shift``: a one-row table of
    means m0, m1, ... in the same order."""
    cols = [*feats, y]
    z = ", ".join(f"coalesce(CAST({c} AS DOUBLE) - m{i}, 0.0) AS z{i}" for i, c in enumerate(cols))
    k = range(len(cols))
    g = ", ".join("[" + ", ".join(f"sum(z{min(i, j)} * z{max(i, j)})" for j in k) + "]" for i in k)
    return f"SELECT count(*) AS n, [{g}] AS g FROM (SELECT {z} FROM {src}, {shift} WHERE {where})"


def means_sql(src: str, feats: list[str], y: str, where: str) -> str:
    return "SELECT " + ", ".join(f"avg(CAST({c} AS DOUBLE)) AS m{i}" for i, c in enumerate([*feats, y])) + f" FROM {src} WHERE {where}"


def ridge_sql(g: str, mask: str, p: int, alpha: float = 1.0) -> str:
    """Weights (DOUBLE[p]) of ridge on the Gram matrix ``g`` (its last row and
    column are the target's) with feature i multiplied by mask[i]: elimination
    over the pivots, one list fold."""
    start = (
        f"list_transform({g}[1:{p}], lambda row, i: list_transform(row, lambda x, j: "
        f"CASE WHEN j > {p} THEN x * {mask}[i] ELSE x * {mask}[i] * {mask}[j] + CASE WHEN i = j THEN {alpha} ELSE 0.0 END END))"
    )
    pivot = "CAST(e[1][1] AS INTEGER)"
    step = (
        f"list_transform(a, lambda row, i: list_transform(row, lambda x, j: "
        f"CASE WHEN i = {pivot} THEN x / row[{pivot}] ELSE x - row[{pivot}] * a[{pivot}][j] / a[{pivot}][{pivot}] END))"
    )
    pivots = f"list_transform(range(1, {p + 1}), lambda k: [[CAST(k AS DOUBLE)]])"
    return f"list_transform(list_reduce({pivots}, lambda a, e: {step}, {start}), lambda row, i: row[{p + 1}] * {mask}[i])"


def residual_sql(w: str, t: str, n: str, p: int) -> str:
    """RMSE of weights ``w`` on the Gram matrix ``t`` of ``n`` other rows (same
    shift; the shift is the intercept)."""
    v = f"list_append(list_transform({w}, lambda x: -x), 1.0)"
    quad = f"list_sum(list_transform({t}, lambda row, i: {v}[i] * list_sum(list_transform(row, lambda x, j: x * {v}[j]))))"
    return f"sqrt(greatest({quad} / {n}, 0.0))"


def level_ridge_ctes(name: str, src: str, y: str, nums: dict[str, str], cats: list[str], alpha: float = 1.0) -> str:
    """CTEs ``{name}_rmse`` (rmse) and ``{name}_lv`` (the level features) of a
    ridge over the numeric expressions ``nums`` (no missing values) and one 0/1
    feature per training level of ``cats`` but the first: feature entries by
    row, their products summed over the training rows, elimination over the
    pivots (the intercept first, without penalty), errors on the test rows.
    ``src`` has is_test."""
    k = len(nums)
    cols = ", ".join([f"CAST({e} AS DOUBLE) AS n{j}" for j, e in enumerate(nums.values())] + [f"CAST({c} AS VARCHAR) AS c{j}" for j, c in enumerate(cats)])
    means = ", ".join([f"avg(n{j}) AS m{j}" for j in range(k)] + ["avg(y) AS my"])
    seen = union([f"SELECT {j} AS c, c{j} AS level FROM {name}_src WHERE NOT is_test" for j in range(len(cats))]) or "SELECT 0 AS c, NULL AS level"
    entries = [f"SELECT rid, is_test, 1 AS i, 1.0::DOUBLE AS z FROM {name}_src"]
    entries += [f"SELECT rid, is_test, {j + 2}, n{j} - m{j} FROM {name}_src, {name}_mu" for j in range(k)]
    entries += [f"SELECT rid, is_test, l.i, 1.0 FROM {name}_src JOIN {name}_lv l ON l.c = {j} AND l.level = c{j}" for j in range(len(cats))]
    pivot = "CAST(e[1][1] AS INTEGER)"
    step = (
        f"list_transform(a, lambda row, i: list_transform(row, lambda x, j: "
        f"CASE WHEN i = {pivot} THEN x / row[{pivot}] ELSE x - row[{pivot}] * a[{pivot}][j] / a[{pivot}][{pivot}] END))"
    )
    return f"""{name}_src AS MATERIALIZED (SELECT row_number() OVER () AS rid, is_test, CAST({y} AS DOUBLE) AS y{', ' + cols if cols else ''} FROM {src} WHERE {y} IS NOT NULL),
{name}_mu AS MATERIALIZED (SELECT {means} FROM {name}_src WHERE NOT is_test),
{name}_lv AS MATERIALIZED (SELECT c, level, row_number() OVER (ORDER BY c, level) + {k + 1} AS i
  FROM (SELECT DISTINCT c, level, min(level) OVER (PARTITION BY c) AS f FROM ({seen}) WHERE level IS NOT NULL) WHERE level > f),
{name}_ent AS MATERIALIZED ({union(entries)}),
{name}_idx AS MATERIALIZED (SELECT unnest(range(1, {k + 2} + (SELECT count(*) FROM {name}_lv))) AS i),
{name}_p AS (SELECT max(i) AS p FROM {name}_idx),
{name}_sum AS MATERIALIZED (SELECT a.i, b.i AS j, sum(a.z * b.z) AS v FROM {name}_ent a JOIN {name}_ent b ON a.rid = b.rid WHERE NOT a.is_test GROUP BY ALL
  UNION ALL SELECT e.i, p + 1, sum(e.z * (s.y - my)) FROM {name}_ent e JOIN {name}_src s ON e.rid = s.rid, {name}_mu, {name}_p WHERE NOT e.is_test GROUP BY ALL),
{name}_mat AS (SELECT list(r ORDER BY i) AS a FROM (SELECT x.i, list(coalesce(v, 0.0) + CASE WHEN x.i = t.j AND x.i > 1 THEN {alpha} ELSE 0.0 END ORDER BY t.j) AS r
  FROM {name}_idx x CROSS JOIN (SELECT i AS j FROM {name}_idx UNION ALL SELECT p + 1 FROM {name}_p) t LEFT JOIN {name}_sum s ON s.i = x.i AND s.j = t.j GROUP BY x.i)),
{name}_w AS MATERIALIZED (SELECT unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (
  SELECT list_transform(list_reduce(list_transform(range(1, p + 1), lambda k: [[CAST(k AS DOUBLE)]]), lambda a, e: {step}, a), lambda row: row[p + 1]) AS w FROM {name}_mat, {name}_p)),
{name}_rmse AS MATERIALIZED (SELECT sqrt(avg((y - my - pred) * (y - my - pred))) AS rmse FROM {name}_mu, {name}_src s JOIN (
  SELECT rid, sum(z * w) AS pred FROM {name}_ent JOIN {name}_w USING (i) WHERE is_test GROUP BY rid) USING (rid))"""
