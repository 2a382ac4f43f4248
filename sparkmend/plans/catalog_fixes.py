"""Registered queries: repairs, splits, correlation filter."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import q, row_hash, row_hash_sql
from ..operators import correlate as C
from ..operators import fixes as FX
from ..operators import profile as P
from ..operators import split as S
from ..sources import io
from .catalog_profile import (
    DOCS_COLS, DOCS_HEALTH_SQL, DOCS_NUM, DOCS_SRC, DOCS_TEXT, EV_HEALTH_SRC, HEALTH_SQL, _events_health_input, documents_faulted, documents_health,
)
from .common import faulted_events, faulted_events_sql, memo, rounded
from .registry import query
from .sqlgen import guarded_corr_sql, health_sql, parse_sql, r, union

T = io.table
FE = faulted_events_sql()
SCALE_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _median_sql(src, c):
    return f"(SELECT quantile_cont({c}, 0.5) FROM {src})"


@query(
    "impute_mean",
    f"SELECT event_id, round(coalesce(value, (SELECT avg(value) FROM {FE})), 6) AS value, "
    f"round(coalesce(CAST(user_id AS DOUBLE), (SELECT avg(user_id) FROM {FE})), 6) AS user_id FROM {FE}",
)
def q_impute_mean(spark, sf):
    return rounded(FX.impute(faulted_events(spark, sf), ["value", "user_id"], "mean").select("event_id", "value", "user_id"))


@query(
    "impute_median",
    f"SELECT event_id, round(coalesce(value, {_median_sql(FE, 'value')}), 6) AS value, "
    f"round(coalesce(CAST(user_id AS DOUBLE), {_median_sql(FE, 'user_id')}), 6) AS user_id FROM {FE}",
)
def q_impute_median(spark, sf):
    return rounded(FX.impute(faulted_events(spark, sf), ["value", "user_id"], "median").select("event_id", "value", "user_id"))


# fixed values: the five market segments of the customer table, sorted
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query(
    "one_hot",
    "SELECT c_custkey, c_name, c_nationkey, c_acctbal, "
    + ", ".join(f"CAST(coalesce(c_mktsegment = '{s}', false) AS INTEGER) AS c_mktsegment_{s}" for s in SEGMENTS[1:])
    + " FROM customer",
)
def q_one_hot(spark, sf):
    return FX.one_hot(T(spark, sf, "customer"), ["c_mktsegment"], drop_first=True)


@query(
    "category_codes",
    """SELECT o_orderkey, CAST(coalesce(l.code, -1) AS INTEGER) AS o_orderpriority
FROM orders o LEFT JOIN (SELECT lv, row_number() OVER (ORDER BY lv) - 1 AS code
                         FROM (SELECT DISTINCT o_orderpriority AS lv FROM orders WHERE o_orderpriority IS NOT NULL)) l
ON o.o_orderpriority = l.lv""",
)
def q_category_codes(spark, sf):
    return FX.category_codes(T(spark, sf, "orders"), ["o_orderpriority"]).select("o_orderkey", "o_orderpriority")


def _scale_sql(center: str, scale: str) -> str:
    cols = []
    for c in SCALE_COLS:
        cols.append(f"{r(f'({c} - s.c_{c}) / s.s_{c}')} AS {c}")
    stats = ", ".join(f"{center.format(c=c)} AS c_{c}, {scale.format(c=c)} AS s_{c}" for c in SCALE_COLS)
    return f"SELECT l_orderkey, l_linenumber, {', '.join(cols)} FROM lineitem, (SELECT {stats} FROM lineitem) s"


@query("standard_scale", _scale_sql("avg({c})", "coalesce(nullif(stddev_pop({c}), 0), 1)"))
def q_standard_scale(spark, sf):
    d = T(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *SCALE_COLS)
    return rounded(FX.scale(d, SCALE_COLS, "standard"))


@query("minmax_scale", _scale_sql("min({c})", "coalesce(nullif(max({c}) - min({c}), 0), 1)"))
def q_minmax_scale(spark, sf):
    d = T(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *SCALE_COLS)
    return rounded(FX.scale(d, SCALE_COLS, "minmax"))


@query("robust_scale", _scale_sql("quantile_cont({c}, 0.5)", "coalesce(nullif(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 0), 1)"))
def q_robust_scale(spark, sf):
    d = T(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *SCALE_COLS)
    return rounded(FX.scale(d, SCALE_COLS, "robust"))


@query(
    "row_normalize",
    """SELECT vec_id, CAST(pos - 1 AS INTEGER) AS dim, round(CASE WHEN nrm > 0 THEN x / nrm ELSE x END, 6) AS value
FROM (SELECT vec_id, unnest(generate_series(1, len(embedding))) AS pos, unnest(list_transform(embedding, lambda v: CAST(v AS DOUBLE))) AS x,
             sqrt(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE) * CAST(v AS DOUBLE)))) AS nrm
      FROM embeddings)""",
)
def q_row_normalize(spark, sf):
    d = FX.row_normalize(T(spark, sf, "embeddings"), vec="embedding")
    return rounded(d.select("vec_id", F.posexplode("embedding").alias("dim", "value")).select("vec_id", F.col("dim").cast("int"), "value"))


@query(
    "clip_outliers",
    """SELECT event_id, round(CASE WHEN value IS NULL THEN NULL ELSE least(greatest(value, q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1)) END, 6) AS value
FROM events, (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)""",
)
def q_clip_outliers(spark, sf):
    return rounded(FX.clip_outliers(T(spark, sf, "events"), ["value"], k=1.5).select("event_id", "value"))


@query(
    "balanced_weights",
    """SELECT doc_id, toxic, round(CAST(t.n AS DOUBLE) / (t.k * c.nc), 6) AS weight
FROM labels l JOIN (SELECT toxic AS cls, count(*) AS nc FROM labels WHERE toxic IS NOT NULL GROUP BY toxic) c ON l.toxic = c.cls,
     (SELECT count(*) AS n, count(DISTINCT toxic) AS k FROM labels WHERE toxic IS NOT NULL) t""",
)
def q_balanced_weights(spark, sf):
    return rounded(FX.balanced_weights(T(spark, sf, "labels"), "toxic").select("doc_id", "toxic", "weight"))


# ── plan ────────────────────────────────────────────────────────────────────


# fixed values: what each finding asks for, in the order of repair
_RULES_SQL = """(VALUES
  ('wrong_dtypes',    1, 'cast_numeric',     '{}'),
  ('missing_values',  2, 'impute_median',    '{}'),
  ('dtype',           3, 'one_hot',          '{"drop_first": true}'),
  ('outliers',        4, 'clip_iqr',         '{"k": 1.5}'),
  ('scale_mismatch',  5, 'standard_scale',   '{}'),
  ('high_skew',       6, 'log_target',       '{}'),
  ('class_imbalance', 7, 'balanced_weights', '{}'))"""


def _plan_sql(health: str, target: str) -> str:
    return f"""WITH rep AS ({health}),
wrong AS (SELECT col_name AS w FROM rep WHERE issue = 'wrong_dtypes'),
typ AS (SELECT col_name AS c, detail AS t FROM rep WHERE issue = 'dtype'),
j AS (SELECT rep.issue, rep.col_name, (typ.t = 'string' AND wrong.w IS NULL) AS is_text
      FROM rep LEFT JOIN wrong ON rep.col_name = wrong.w LEFT JOIN typ ON rep.col_name = typ.c),
k AS (SELECT * FROM j WHERE issue = 'wrong_dtypes'
   OR (issue = 'missing_values' AND NOT coalesce(is_text, false) AND col_name <> '{target}')
   OR (issue = 'dtype' AND coalesce(is_text, false) AND col_name <> '{target}')
   OR (issue = 'outliers' AND col_name <> '{target}')
   OR issue = 'scale_mismatch'
   OR (issue = 'high_skew' AND col_name = '{target}')
   OR issue = 'class_imbalance'),
s AS (SELECT r.step, k.issue, CASE WHEN k.issue = 'class_imbalance' THEN '{target}' ELSE k.col_name END AS col_name, r.action, r.params
      FROM k JOIN {_RULES_SQL} r(issue, step, action, params) ON k.issue = r.issue)
SELECT CAST(row_number() OVER (ORDER BY step, col_name NULLS FIRST) AS INTEGER) AS seq, issue, col_name, action, params FROM s"""


def events_plan(spark, sf):
    rep = P.health_report(_events_health_input(spark, sf), target="event_type", task="classification")
    return FX.recommend_fixes(rep, "event_type")


@query("recommend_fixes", _plan_sql(HEALTH_SQL, "event_type"))
def q_recommend_fixes(spark, sf):
    return events_plan(spark, sf)


@query("recommend_fixes_documents", _plan_sql(DOCS_HEALTH_SQL, "toxic"))
def q_recommend_fixes_documents(spark, sf):
    return FX.recommend_fixes(documents_health(spark, sf), "toxic")


# a fixed plan (the one recommend_fixes gives for this table at sf0.01,
# without the identifier-like props column), so the oracle can spell it out
APPLY_PLAN = [
    {"seq": 1, "issue": "wrong_dtypes", "col_name": "value_txt", "action": "cast_numeric", "params": "{}"},
    {"seq": 2, "issue": "missing_values", "col_name": "user_id", "action": "impute_median", "params": "{}"},
    {"seq": 3, "issue": "missing_values", "col_name": "value", "action": "impute_median", "params": "{}"},
    {"seq": 4, "issue": "missing_values", "col_name": "value_txt", "action": "impute_median", "params": "{}"},
    {"seq": 5, "issue": "outliers", "col_name": "value", "action": "clip_iqr", "params": '{"k": 1.5}'},
]


def _apply_sql() -> str:

    h = row_hash_sql(["event_id"], 42)
    return f"""WITH base AS (SELECT *, ({h} % 100) < 20 AS is_test FROM {EV_HEALTH_SRC}),
c AS (SELECT event_id, ts, user_id, event_type, value, {parse_sql('value_txt')} AS value_txt, props, is_test FROM base),
m AS (SELECT quantile_cont(user_id, 0.5) AS mu, quantile_cont(value, 0.5) AS mv, quantile_cont(value_txt, 0.5) AS mt FROM c WHERE NOT is_test),
i AS (SELECT event_id, ts, coalesce(CAST(user_id AS DOUBLE), m.mu) AS user_id, event_type, coalesce(value, m.mv) AS value,
             coalesce(value_txt, m.mt) AS value_txt, props, is_test FROM c, m),
qq AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM i WHERE NOT is_test)
SELECT event_id, ts, round(user_id, 6) AS user_id, event_type,
       round(CASE WHEN value IS NULL THEN NULL ELSE least(greatest(value, q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1)) END, 6) AS value,
       round(value_txt, 6) AS value_txt, props, is_test
FROM i, qq"""


@query("apply_fixes", _apply_sql())
def q_apply_fixes(spark, sf):
    df = S.train_test_split(_events_health_input(spark, sf), "event_id")
    out = FX.apply_fixes(df, APPLY_PLAN, "event_type", split_col="is_test")
    return rounded(out)


def _documents_fixed_sql(target: str, task: str) -> str:
    """The plan of the documents' report carried out: a step takes place where
    the report has its finding."""
    health = health_sql(DOCS_SRC, DOCS_NUM, DOCS_TEXT, DOCS_COLS, target if task == "classification" else None)
    nums = [c for c in ("quality", "toxic", "n_chars", "n_bytes", "words_txt") if c != target]
    clipped = [c for c in nums if c != "words_txt"]  # a text column has no outlier finding
    train = "WHERE NOT is_test"
    quart = ", ".join(f"quantile_cont({c}, 0.25) AS {c}_q1, quantile_cont({c}, 0.75) AS {c}_q3" for c in clipped)
    clip = ", ".join(
        f"CASE WHEN list_contains(outl, '{c}') AND {c} IS NOT NULL THEN least(greatest({c}, {c}_q1 - 1.5 * ({c}_q3 - {c}_q1)), {c}_q3 + 1.5 * ({c}_q3 - {c}_q1)) ELSE {c} END AS {c}"
        for c in clipped
    )
    stats = ", ".join(f"avg({c}) AS {c}_m, coalesce(nullif(stddev_pop({c}), 0), 1.0) AS {c}_s" for c in nums)
    scaled = ", ".join(f"round(CASE WHEN mism THEN ({c} - {c}_m) / {c}_s ELSE {c} END, 6) AS {c}" for c in nums)
    hot = ", ".join(
        f"CASE WHEN {c} > (SELECT min({c}) FROM base {train}) AND {c} IN (SELECT {c} FROM base {train}) THEN '{c}_' || {c} END AS {c}_hot" for c in ("lang", "source")
    )
    own = f"round(CAST(CASE WHEN skewed THEN ln(1 + {target}) ELSE {target} END AS DOUBLE), 6) AS {target}" if task == "regression" else target
    weight = f"""round(CASE WHEN imb THEN (SELECT count({target}) / (count(DISTINCT {target}) * 1.0) FROM base {train}) / (SELECT count(*) FROM base b2 {train} AND b2.{target} = s.{target}) END, 6)"""
    return f"""WITH rep AS MATERIALIZED ({health}),
flag AS MATERIALIZED (SELECT coalesce(list(col_name) FILTER (issue = 'outliers'), []) AS outl, count(*) FILTER (issue = 'scale_mismatch') > 0 AS mism,
  count(*) FILTER (issue = 'class_imbalance') > 0 AS imb, count(*) FILTER (issue = 'high_skew' AND col_name = '{target}') > 0 AS skewed FROM rep),
base AS MATERIALIZED (SELECT doc_id, CAST(quality AS DOUBLE) AS quality, toxic, lang, source, n_chars, n_bytes, {parse_sql('words_txt')} AS words_txt, is_test
  FROM (SELECT *, ({row_hash_sql(['doc_id'], 42)} % 100) < 20 AS is_test FROM {DOCS_SRC})),
med AS (SELECT quantile_cont(quality, 0.5) AS mq FROM base {train}),
filled AS MATERIALIZED (SELECT * REPLACE (coalesce(quality, mq) AS quality) FROM base, med),
qs AS (SELECT {quart} FROM filled {train}),
cut AS MATERIALIZED (SELECT doc_id, lang, source, is_test, words_txt, {target}, {clip} FROM filled, qs, flag),
st AS (SELECT {stats} FROM cut {train})
SELECT doc_id, is_test, {own}, {scaled}, {hot}, {weight if task == 'classification' else 'CAST(NULL AS DOUBLE)'} AS weight FROM cut s, st, flag"""


def _documents_fixed(spark, sf, target: str, task: str):
    df = S.train_test_split(documents_faulted(spark, sf), "doc_id")
    plan = FX.recommend_fixes(documents_health(spark, sf, target, task), target)
    out = FX.apply_fixes(df, plan, target, split_col="is_test", key="doc_id")
    if task == "regression":
        out = out.withColumn(target, F.col(target).cast("double"))  # whether logged or not
    hot = [
        F.coalesce(F.lit(None).cast("string"), *[F.when(F.col(q(c)) == 1, F.lit(c)) for c in out.columns if c.startswith(f"{s}_")]).alias(f"{s}_hot")
        for s in ("lang", "source")
    ]
    weight = F.col("weight") if "weight" in out.columns else F.lit(None).cast("double").alias("weight")
    nums = ["quality", "toxic", "n_chars", "n_bytes", "words_txt"]
    return rounded(out.select("doc_id", "is_test", *nums, *hot, weight))


@query("apply_fixes_documents", _documents_fixed_sql("toxic", "classification"))
def q_apply_fixes_documents(spark, sf):
    return _documents_fixed(spark, sf, "toxic", "classification")


@query("apply_fixes_log_target", _documents_fixed_sql("n_chars", "regression"))
def q_apply_fixes_log_target(spark, sf):
    return _documents_fixed(spark, sf, "n_chars", "regression")


# ── splits ──────────────────────────────────────────────────────────────────


@query("train_test_split", f"SELECT event_id, ({row_hash_sql(['event_id'], 42)} % 100) < 20 AS is_test FROM events")
def q_train_test_split(spark, sf):
    return S.train_test_split(T(spark, sf, "events"), "event_id").select("event_id", "is_test")


@query("kfold", f"SELECT o_orderkey, CAST({row_hash_sql(['o_orderkey'], 42, 'fold')} % 5 AS INTEGER) AS fold FROM orders")
def q_kfold(spark, sf):
    return S.kfold(T(spark, sf, "orders"), "o_orderkey", 5).select("o_orderkey", "fold")


@query(
    "kfold_exact",
    f"""SELECT event_id, CAST((row_number() OVER (ORDER BY {row_hash_sql(['event_id'], 42, 'fold')}, event_id) - 1) % 5 AS INTEGER) AS fold FROM events""",
)
def q_kfold_exact(spark, sf):
    """Folds whose sizes differ by a row at most."""
    return S.kfold(T(spark, sf, "events"), "event_id", 5, exact=True).select("event_id", "fold")


@query(
    "stratified_kfold",
    f"SELECT doc_id, toxic, CAST((row_number() OVER (PARTITION BY toxic ORDER BY {row_hash_sql(['doc_id'], 42, 'fold')}, doc_id) - 1) % 5 AS INTEGER) AS fold FROM labels",
)
def q_stratified_kfold(spark, sf):
    return S.stratified_kfold(T(spark, sf, "labels"), "doc_id", "toxic", 5).select("doc_id", "toxic", "fold")


# ── correlation ─────────────────────────────────────────────────────────────

LI_FEATS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_discount", "l_tax", "l_qty_copy", "l_qty_noisy"]
TGT = "l_quantity"
TGT_SQL = "l_quantity"


def lineitem_corr_frame(spark, sf, cols=None):
    """lineitem (``cols`` of it, spread over the cores) plus two noisy copies of
    l_quantity (the target here), so the weak-feature step drops the unrelated
    columns and the redundancy step has a pair to act on."""
    d = T(spark, sf, "lineitem")
    if cols is not None:
        d = io.spread(d.select(*cols))
    keys = ["l_orderkey", "l_linenumber", "l_partkey"]
    noise1 = (row_hash(keys, 42, "copy") % 1000) / 1000.0
    noise2 = (row_hash(keys, 42, "noisy") % 1000) / 100.0
    return d.withColumn("l_qty_copy", F.col("l_quantity") * 2 + noise1).withColumn("l_qty_noisy", F.col("l_quantity") + noise2)


_K3 = ["l_orderkey", "l_linenumber", "l_partkey"]
_LCF = f"""(SELECT *, l_quantity * 2 + ({row_hash_sql(_K3, 42, 'copy')} % 1000) / 1000.0 AS l_qty_copy,
                   l_quantity + ({row_hash_sql(_K3, 42, 'noisy')} % 1000) / 100.0 AS l_qty_noisy FROM lineitem)"""


@query(
    "target_corr",
    union([f"SELECT '{c}' AS col_name, round(abs({guarded_corr_sql(c, TGT_SQL)}), 4) AS abs_corr FROM {_LCF}" for c in LI_FEATS]),
)
def q_target_corr(spark, sf):
    return C.target_corr(lineitem_corr_frame(spark, sf), TGT)


_CM_COLS = LI_FEATS + [TGT]


@query(
    "corr_matrix",
    union(
        [
            f"SELECT '{a}' AS col_a, '{b}' AS col_b, {r(guarded_corr_sql(a, b) if a != b else guarded_corr_sql(a, a))} AS corr FROM {_LCF}"
            for a in _CM_COLS
            for b in _CM_COLS
        ]
    ),
)
def q_corr_matrix(spark, sf):
    return C.corr_matrix(lineitem_corr_frame(spark, sf), _CM_COLS)


def _pairs_sql(cols, thr=0.9):
    parts = []
    for i, a in enumerate(cols):
        for j in range(i + 1, len(cols)):
            b = cols[j]
            parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, {i} AS i, {j} AS j, abs({guarded_corr_sql(a, b)}) AS v FROM {_LCF}")
    return f"SELECT CAST(row_number() OVER (ORDER BY v DESC, i, j) AS INTEGER) AS rank, col_a, col_b, round(v, 6) AS abs_corr FROM ({union(parts)}) WHERE v > {thr}"


@query("rank_corr_pairs", _pairs_sql(_CM_COLS))
def q_rank_corr_pairs(spark, sf):
    return C.rank_corr_pairs(lineitem_corr_frame(spark, sf), _CM_COLS)


@query(
    "drop_low_target_corr",
    "SELECT col_name, abs_corr, abs_corr_raw < 0.1 AS dropped FROM ("
    + union(
        [
            f"SELECT '{c}' AS col_name, round(abs({guarded_corr_sql(c, TGT_SQL)}), 4) AS abs_corr, abs({guarded_corr_sql(c, TGT_SQL)}) AS abs_corr_raw FROM {_LCF}"
            for c in LI_FEATS
        ]
    )
    + ")",
)
def q_drop_low_target_corr(spark, sf):
    d = lineitem_corr_frame(spark, sf).select(*LI_FEATS, TGT)
    _out, dropped, tc = C.drop_low_target_corr(d, TGT)
    rows = [(c, tc[c], c in dropped) for c in LI_FEATS]
    return spark.createDataFrame(rows, "col_name string, abs_corr double, dropped boolean")


@memo
def _filtered(spark, sf):
    d = lineitem_corr_frame(spark, sf).select(*LI_FEATS, TGT, "l_returnflag")
    return C.filter_features(d, TGT)


@query("drop_redundant")
def q_drop_redundant(spark, sf):
    d = lineitem_corr_frame(spark, sf).select(*LI_FEATS, TGT)
    _o, _dropped, tc = C.drop_low_target_corr(d, TGT)
    out, dropped = C.drop_redundant(_o, TGT, tc)
    return spark.createDataFrame([(c,) for c in dropped], "col_name string")


@query("filter_features")
def q_filter_features(spark, sf):
    return _filtered(spark, sf)[0]


@query("drop_report")
def q_drop_report(spark, sf):
    return _filtered(spark, sf)[2]


@query("heatmap_data")
def q_heatmap_data(spark, sf):
    return _filtered(spark, sf)[3]


# ── SQL oracles for the greedy redundancy walk (recursive CTE) ──────────────


def _walk_sql() -> str:
    """tc: |r| to the target (raw and 4-dp); pairs among the features kept by
    the weak-feature step, ranked; the walk carries the dropped list."""
    feats = LI_FEATS
    tc = union(
        [
            f"SELECT '{c}' AS col, {i} AS ord, abs({guarded_corr_sql(c, TGT_SQL)}) AS raw, round(abs({guarded_corr_sql(c, TGT_SQL)}), 4) AS t FROM {_LCF}"
            for i, c in enumerate(feats)
        ]
    )
    allpairs = union(
        [
            f"SELECT '{a}' AS a, '{b}' AS b, {i} AS i, {j} AS j, abs({guarded_corr_sql(a, b)}) AS v FROM {_LCF}"
            for i, a in enumerate(feats)
            for j, b in enumerate(feats)
            if i < j
        ]
    )
    return f"""WITH RECURSIVE tc AS ({tc}),
kept1 AS (SELECT col FROM tc WHERE raw >= 0.1),
pairs AS (SELECT a, b, row_number() OVER (ORDER BY v DESC, i, j) AS rk FROM ({allpairs})
          WHERE v > 0.9 AND a IN (SELECT col FROM kept1) AND b IN (SELECT col FROM kept1)),
walk(rk, dropped) AS (
  SELECT 0, CAST([] AS VARCHAR[])
  UNION ALL
  SELECT w.rk + 1,
         CASE WHEN list_contains(w.dropped, p.a) OR list_contains(w.dropped, p.b) THEN w.dropped
              WHEN ta.t >= tb.t THEN list_append(w.dropped, p.b)
              ELSE list_append(w.dropped, p.a) END
  FROM walk w JOIN pairs p ON p.rk = w.rk + 1 JOIN tc ta ON ta.col = p.a JOIN tc tb ON tb.col = p.b),
final AS (SELECT dropped FROM walk ORDER BY rk DESC LIMIT 1)"""


from .registry import ORACLES  # noqa: E402

ORACLES["drop_redundant"] = _walk_sql() + "\nSELECT unnest(dropped) AS col_name FROM final"
ORACLES["drop_report"] = (
    _walk_sql()
    + """
SELECT col AS col_name, t AS abs_target_corr,
       CASE WHEN raw < 0.1 THEN 'low_target_corr' WHEN list_contains((SELECT dropped FROM final), col) THEN 'redundant' ELSE 'kept' END AS status
FROM tc"""
)
_HEAT_COLS = LI_FEATS + [TGT]
ORACLES["heatmap_data"] = (
    _walk_sql()
    + ",\nsurv AS (SELECT col FROM kept1 WHERE NOT list_contains((SELECT dropped FROM final), col) UNION ALL SELECT '"
    + TGT
    + "')\nSELECT * FROM ("
    + union(
        [f"SELECT '{a}' AS row, '{b}' AS col, round({guarded_corr_sql(a, b)}, 2) AS corr FROM {_LCF}" for a in _HEAT_COLS for b in _HEAT_COLS]
    )
    + ") WHERE row IN (SELECT col FROM surv) AND col IN (SELECT col FROM surv)"
)
# the surviving columns depend on the walk: they are named here, and the walk
# must leave exactly them, or the oracle has no rows
_SURVIVORS = ["l_qty_copy"]
ORACLES["filter_features"] = (
    _walk_sql()
    + f"""
SELECT {', '.join([*_SURVIVORS, TGT, 'l_returnflag'])} FROM {_LCF}
WHERE (SELECT list(col ORDER BY ord) FROM tc WHERE raw >= 0.1 AND NOT list_contains((SELECT dropped FROM final), col)) = {_SURVIVORS}"""
)
