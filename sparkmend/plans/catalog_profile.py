"""Registered queries: sources, selectors, profile checks."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions.exprs import row_hash_sql
from ..operators import profile as P
from ..session import cut_lineage
from ..sources import io
from .common import faulted_events, faulted_events_sql, memo, rounded
from .registry import query
from .sqlgen import health_sql, imbalance_sql, missing_sql, outlier_sql, parse_sql, r, union, wrong_sql

T = io.table
FE = faulted_events_sql()

LINEITEM_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
EVENT_COLS = [
    ("event_id", "bigint"),
    ("ts", "timestamp_ntz"),
    ("user_id", "bigint"),
    ("event_type", "string"),
    ("value", "double"),
    ("props", "string"),
    ("value_txt", "string"),
]


def _events_health_input(spark, sf):
    df = faulted_events(spark, sf)
    return df.withColumn("value_txt", F.col("value").cast("string"))


EV_HEALTH_SRC = f"(SELECT *, CAST(value AS VARCHAR) AS value_txt FROM {FE})"
HEALTH_SQL = (
    "SELECT issue, col_name, round(value, 6) AS value, detail FROM ("
    + health_sql(EV_HEALTH_SRC, ["event_id", "user_id", "value"], ["event_type", "props", "value_txt"], EVENT_COLS, "event_type")
    + ")"
)


# labels with their documents: every kind of fault in one table (long texts are
# outliers and make the sizes skewed, few documents are toxic, a count is stored
# as text, a tenth of the quality labels is missing); texts are measured once per
# session and scale, as every check reads the table in several passes
@memo
def documents_faulted(spark, sf):
    hidden = X.row_hash(["doc_id"], 42, "quality") % 10 == 0
    words = F.char_length("text") - F.char_length(F.replace("text", F.lit(" "), F.lit("")))
    docs = T(spark, sf, "documents").select(
        F.col("doc_id").alias("d_id"), "lang", "source", "n_chars", F.octet_length("text").cast("bigint").alias("n_bytes"), words.cast("string").alias("words_txt")
    )
    labels = T(spark, sf, "labels").select("doc_id", F.when(~hidden, F.col("quality")).alias("quality"), "toxic")
    return cut_lineage(labels.join(docs, F.col("doc_id") == F.col("d_id")).drop("d_id"))


DOCS_SRC = f"""(SELECT l.doc_id, CASE WHEN {row_hash_sql(['l.doc_id'], 42, 'quality')} % 10 <> 0 THEN quality END AS quality, toxic, lang, source, n_chars,
  CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes, CAST(length(text) - length(replace(text, ' ', '')) AS VARCHAR) AS words_txt
FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""
DOCS_COLS = [
    ("doc_id", "bigint"), ("quality", "int"), ("toxic", "int"), ("lang", "string"), ("source", "string"),
    ("n_chars", "bigint"), ("n_bytes", "bigint"), ("words_txt", "string"),
]
DOCS_NUM, DOCS_TEXT = ["doc_id", "quality", "toxic", "n_chars", "n_bytes"], ["lang", "source", "words_txt"]
DOCS_HEALTH_SQL = (
    "SELECT issue, col_name, round(value, 6) AS value, detail FROM (" + health_sql(DOCS_SRC, DOCS_NUM, DOCS_TEXT, DOCS_COLS, "toxic") + ")"
)


def documents_health(spark, sf, target="toxic", task="classification"):
    return P.health_report(documents_faulted(spark, sf), target=target, task=task)


@query("health_report_documents", DOCS_HEALTH_SQL)
def q_health_report_documents(spark, sf):
    return rounded(documents_health(spark, sf))


# ── 2.1 sources and sinks ───────────────────────────────────────────────────


@query("scan_table", "SELECT * FROM lineitem")
def q_scan_table(spark, sf):
    return io.load(spark, f"{sf}/lineitem.parquet", target="l_returnflag")


@query("sample_n", f"SELECT * FROM orders ORDER BY {row_hash_sql(['o_orderkey'], 42)}, o_orderkey LIMIT 1000")
def q_sample_n(spark, sf):
    return io.sample_n(T(spark, sf, "orders"), 1000, key="o_orderkey", seed=42)


_INJ_H = row_hash_sql(["event_id"], 42, "value")


@query(
    "inject_nulls",
    f"""SELECT event_id, CASE WHEN row_number() OVER (ORDER BY {_INJ_H}, event_id) <= CAST(floor(count(*) OVER () * 0.1) AS BIGINT)
THEN NULL ELSE value END AS value FROM events""",
)
def q_inject_nulls(spark, sf):
    return io.inject_nulls(T(spark, sf, "events"), {"value": 0.1}, key="event_id", seed=42).select("event_id", "value")


@query("inject_scale", "SELECT event_id, round(value * 1500.0, 6) AS value FROM events")
def q_inject_scale(spark, sf):
    return rounded(io.inject_scale(T(spark, sf, "events"), "value", 1500.0).select("event_id", "value"))


@query("inject_dtype", "SELECT * REPLACE (CAST(l_tax AS VARCHAR) AS l_tax) FROM lineitem")
def q_inject_dtype(spark, sf):
    return io.inject_dtype(T(spark, sf, "lineitem"), "l_tax")


_TAIL_U = f"(CAST({row_hash_sql(['doc_id'], 42, 'tail')} AS DOUBLE) / 4294967296.0)"


@query(
    "inject_tail",
    f"""SELECT doc_id, round(CASE WHEN n_chars > t.p THEN n_chars * (1.3 + (2.5 - 1.3) * {_TAIL_U}) ELSE n_chars END, 6) AS n_chars
FROM documents, (SELECT quantile_cont(n_chars, 0.95) AS p FROM documents) t""",
)
def q_inject_tail(spark, sf):
    df = T(spark, sf, "documents").select("doc_id", F.col("n_chars").cast("double").alias("n_chars"))
    return rounded(io.inject_tail(df, "n_chars", key="doc_id"))


@query("write_report", HEALTH_SQL)
def q_write_report(spark, sf):
    from ..session import ensure_checkpoint_dir

    rep = P.health_report(_events_health_input(spark, sf), target="event_type", task="classification")
    base = ensure_checkpoint_dir(spark)
    path = os.path.join(base, "reports", f"health-{uuid.uuid4().hex}")
    io.write_report(rounded(rep), path)
    return spark.read.parquet(path)


@query("scan_filtered", "SELECT * FROM lineitem WHERE l_quantity < 10 AND l_returnflag = 'R'")
def q_scan_filtered(spark, sf):
    return io.table(spark, sf, "lineitem", where=[("l_quantity", "<", 10), ("l_returnflag", "=", "R")])


# ── 2.2 projection / filter ─────────────────────────────────────────────────


@query("select_numeric", "SELECT " + ", ".join(LINEITEM_NUM) + " FROM lineitem")
def q_select_numeric(spark, sf):
    return P.select_numeric(T(spark, sf, "lineitem"))


@query("select_categorical", "SELECT o_orderstatus, o_orderpriority FROM orders")
def q_select_categorical(spark, sf):
    return P.select_categorical(T(spark, sf, "orders"))


@query(
    "dtypes_report",
    "SELECT column_name AS col_name, CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' "
    "WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(data_type) END AS dtype "
    "FROM information_schema.columns WHERE table_name = 'lineitem'",
)
def q_dtypes_report(spark, sf):
    return P.dtypes_report(T(spark, sf, "lineitem"))


@query("drop_columns", "SELECT * EXCLUDE (l_tax, l_discount) FROM lineitem")
def q_drop_columns(spark, sf):
    return T(spark, sf, "lineitem").drop("l_tax", "l_discount")


@query("drop_null_target", f"SELECT * FROM {FE} WHERE value IS NOT NULL")
def q_drop_null_target(spark, sf):
    return P.drop_null_target(faulted_events(spark, sf), "value")


@query("drop_null_rows", f"SELECT * FROM {FE} WHERE value IS NOT NULL AND user_id IS NOT NULL")
def q_drop_null_rows(spark, sf):
    return P.drop_null_rows(faulted_events(spark, sf), ["value", "user_id"])


@query("drop_all_null_cols", "SELECT event_id, user_id, value FROM events")
def q_drop_all_null_cols(spark, sf):
    df = T(spark, sf, "events").select("event_id", "user_id", "value")
    df = df.withColumn("value_if_negative_id", F.when(F.col("event_id") < 0, F.col("value")))
    return P.drop_all_null_cols(df)


@query(
    "outlier_flag",
    f"""SELECT event_id, value, coalesce(value < f.lower OR value > f.upper, false) AS is_outlier_value
FROM events, (SELECT q1 - 3.0 * (q3 - q1) AS lower, q3 + 3.0 * (q3 - q1) AS upper
              FROM (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)) f""",
)
def q_outlier_flag(spark, sf):
    return P.outlier_flag(T(spark, sf, "events"), ["value"]).select("event_id", "value", "is_outlier_value")


@query(
    "null_rate_blocks",
    "SELECT block, n_rows, col_name, round(null_rate, 6) AS null_rate FROM (" + union([
        f"SELECT {row_hash_sql(['event_id'], 42)} % 100 AS block, count(*) AS n_rows, '{c}' AS col_name, avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) AS null_rate FROM {FE} GROUP BY 1"
        for c in ("value", "user_id")
    ]) + ")",
)
def q_null_rate_blocks(spark, sf):
    return rounded(P.null_rate_blocks(faulted_events(spark, sf), ["value", "user_id"], "event_id"))


@query("null_map", union([f"SELECT event_id, '{c}' AS col_name, CAST({c} IS NULL AS INTEGER) AS is_null FROM {FE}" for c in ["user_id", "value"]]))
def q_null_map(spark, sf):
    return P.null_map(faulted_events(spark, sf), ["user_id", "value"], key="event_id")


# ── 2.4 aggregations ────────────────────────────────────────────────────────


@query("missing_counts", missing_sql(FE, ["event_id", "ts", "user_id", "event_type", "value", "props"]))
def q_missing_counts(spark, sf):
    return P.missing_counts(faulted_events(spark, sf))


@query(
    "skewness_report",
    union([f"SELECT '{c}' AS col_name, round(skewness({c}), 4) AS skew FROM documents HAVING abs(skewness({c})) > 3.0" for c in ["doc_id", "n_chars"]]),
)
def q_skewness_report(spark, sf):
    return P.skewness_report(T(spark, sf, "documents"))


_SD = union([f"SELECT '{c}' AS col_name, {i} AS ord, stddev_samp({c}) AS s FROM lineitem" for i, c in enumerate(LINEITEM_NUM)])


@query(
    "scale_mismatch",
    f"""SELECT hi.col_name AS max_col, lo.col_name AS min_col, {r('hi.s / lo.s')} AS ratio, hi.s / lo.s > 1000.0 AS mismatch
FROM (SELECT col_name, s FROM ({_SD}) WHERE s > 0 ORDER BY s DESC, ord LIMIT 1) hi,
     (SELECT col_name, s FROM ({_SD}) WHERE s > 0 ORDER BY s ASC, ord LIMIT 1) lo""",
)
def q_scale_mismatch(spark, sf):
    return rounded(P.scale_mismatch(T(spark, sf, "lineitem")))


@query(
    "quantiles",
    union(
        [
            f"SELECT '{c}' AS col_name, CAST({p} AS DOUBLE) AS q, {r(f'quantile_cont({c}, {p})')} AS value FROM lineitem"
            for c in LINEITEM_NUM
            for p in (0.25, 0.5, 0.75, 0.95)
        ]
    ),
)
def q_quantiles(spark, sf):
    return rounded(P.quantiles(T(spark, sf, "lineitem")))


@query(
    "outlier_counts",
    "SELECT col_name, round(q1, 6) AS q1, round(q3, 6) AS q3, round(lower, 6) AS lower, round(upper, 6) AS upper, n_outliers FROM ("
    + outlier_sql("events", ["event_id", "user_id", "value"])
    + ")",
)
def q_outlier_counts(spark, sf):
    return rounded(P.outlier_counts(T(spark, sf, "events")))


@query("class_counts", 'SELECT l_returnflag AS "class", count(*) AS count FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY 1')
def q_class_counts(spark, sf):
    return P.class_counts(T(spark, sf, "lineitem"), "l_returnflag")


@query("class_imbalance", "SELECT minority, round(ratio, 6) AS ratio, imbalanced, message FROM (" + imbalance_sql("labels", "toxic") + ")")
def q_class_imbalance(spark, sf):
    return rounded(P.class_imbalance(T(spark, sf, "labels"), "toxic"))


_WD_SRC = "(SELECT * REPLACE (CAST(l_tax AS VARCHAR) AS l_tax) FROM lineitem)"


@query("wrong_dtypes", wrong_sql(_WD_SRC, ["l_tax", "l_returnflag", "l_linestatus"]))
def q_wrong_dtypes(spark, sf):
    return P.wrong_dtypes(io.inject_dtype(T(spark, sf, "lineitem"), "l_tax"))


@query(
    "task_type",
    "SELECT CAST(count(DISTINCT l_returnflag) AS BIGINT) AS n_distinct, "
    "CASE WHEN count(DISTINCT l_returnflag) <= 10 THEN 'classification' ELSE 'regression' END AS task_type FROM lineitem",
)
def q_task_type(spark, sf):
    return P.task_type(T(spark, sf, "lineitem"), "l_returnflag")


@query("health_report", HEALTH_SQL)
def q_health_report(spark, sf):
    rep = P.health_report(_events_health_input(spark, sf), target="event_type", task="classification")
    return rounded(rep)


_KINDS = ", ".join(f"('{k}')" for k in P.ISSUE_KINDS)


@query(
    "issue_counts",
    f"""SELECT k.issue, CAST(coalesce(c.n, 0) AS BIGINT) AS n FROM (VALUES {_KINDS}) k(issue)
LEFT JOIN (SELECT issue, count(*) AS n FROM ({HEALTH_SQL}) WHERE issue <> 'dtype' GROUP BY issue) c ON k.issue = c.issue""",
)
def q_issue_counts(spark, sf):
    rep = P.health_report(_events_health_input(spark, sf), target="event_type", task="classification")
    return P.issue_counts(rep)


@query(
    "issue_counts_documents",
    f"""SELECT k.issue, CAST(coalesce(c.n, 0) AS BIGINT) AS n FROM (VALUES {_KINDS}) k(issue)
LEFT JOIN (SELECT issue, count(*) AS n FROM ({DOCS_HEALTH_SQL}) WHERE issue <> 'dtype' GROUP BY issue) c ON k.issue = c.issue""",
)
def q_issue_counts_documents(spark, sf):
    return P.issue_counts(documents_health(spark, sf))


@query("health_json")
def q_health_json(spark, sf):
    rep = P.health_report(_events_health_input(spark, sf), target="event_type", task="classification")
    return P.health_json(rounded(rep))


_PART_NUM = ["p_partkey", "p_size", "p_retailprice"]


@query(
    "column_ranges",
    union(
        [
            f"SELECT '{c}' AS col_name, {r(f'min({c})')} AS min, {r(f'max({c})')} AS max, {r(f'max({c}) - min({c})')} AS range FROM part"
            for c in _PART_NUM
        ]
    ),
)
def q_column_ranges(spark, sf):
    return rounded(P.column_ranges(T(spark, sf, "part")))


def _hist_sql(series: str, expr: str) -> str:
    return f"""SELECT '{series}' AS series, CAST(b.bin AS INTEGER) AS bin,
  {r('m.mn + b.bin * m.w')} AS lo, {r('m.mn + (b.bin + 1) * m.w')} AS hi,
  CAST(coalesce(c.cnt, 0) AS BIGINT) AS count, {r('coalesce(c.cnt, 0) / (m.n * m.w)')} AS density
FROM range(40) b(bin)
CROSS JOIN (SELECT mn, (mx - mn) / 40.0 AS w, n FROM (SELECT CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS mn,
                                                     CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END AS mx,
                                                     count(x) AS n FROM (SELECT CAST({expr} AS DOUBLE) AS x FROM documents))) m
LEFT JOIN (SELECT bin, count(*) AS cnt FROM (
    SELECT least(CAST(floor((x - m2.mn) / m2.w) AS INTEGER), 39) AS bin
    FROM (SELECT CAST({expr} AS DOUBLE) AS x FROM documents) d,
         (SELECT CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS mn,
                 (CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END - CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END) / 40.0 AS w
          FROM (SELECT CAST({expr} AS DOUBLE) AS x FROM documents)) m2
    WHERE x IS NOT NULL) GROUP BY bin) c ON c.bin = b.bin"""


@query("histogram", union([_hist_sql("before", "n_chars"), _hist_sql("after", "ln(1 + n_chars)")]))
def q_histogram(spark, sf):
    d = T(spark, sf, "documents")
    before = P.histogram(d, "n_chars", 40, "before")
    after = P.histogram(d.select(F.log1p("n_chars").alias("n_chars")), "n_chars", 40, "after")
    return rounded(before.unionByName(after))


@query("head_non_null", f"SELECT event_id, value FROM {FE} WHERE value IS NOT NULL ORDER BY event_id LIMIT 50")
def q_head_non_null(spark, sf):
    return P.head_non_null(faulted_events(spark, sf), "value", 50, key="event_id")


# ── 2.7 scalar functions ────────────────────────────────────────────────────


@query(
    "coerce_numeric",
    f"SELECT event_id, {parse_sql('event_type')} AS event_type_num, round({parse_sql('CAST(value AS VARCHAR)')}, 6) AS value_num FROM events",
)
def q_coerce_numeric(spark, sf):
    df = T(spark, sf, "events")
    return rounded(
        df.select(
            "event_id",
            X.coerce_numeric(F.col("event_type")).alias("event_type_num"),
            X.coerce_numeric(F.col("value").cast("string")).alias("value_num"),
        )
    )


@query("log_transform", "SELECT doc_id, round(ln(1 + n_chars), 6) AS log_n_chars FROM documents")
def q_log_transform(spark, sf):
    return rounded(T(spark, sf, "documents").select("doc_id", X.log1p(F.col("n_chars")).alias("log_n_chars")))


@query("exp_inverse", "SELECT event_id, round(exp(least(greatest(value / 100.0, -10.0), 20.0)) - 1, 6) AS value_back FROM events")
def q_exp_inverse(spark, sf):
    df = T(spark, sf, "events")
    return rounded(df.select("event_id", X.expm1_clip(F.col("value") / 100.0).alias("value_back")))


_FENCED = "CASE WHEN role = 'assistant' THEN '```python' || chr(10) || text || chr(10) || '```' ELSE text END"


def _extract_code_sql(c: str) -> str:
    py = r"(?s)```[Pp]ython\s*\r?\n(.*?)```"
    anyf = r"(?s)```\s*\r?\n(.*?)```"
    mark = r"```[A-Za-z0-9_]*"
    inner = (
        f"CASE WHEN regexp_matches({c}, '{py}') THEN regexp_extract({c}, '{py}', 1) "
        f"WHEN regexp_matches({c}, '{anyf}') THEN regexp_extract({c}, '{anyf}', 1) "
        f"ELSE regexp_replace({c}, '{mark}', '', 'g') END"
    )
    return f"trim({inner}, chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))"


@query("extract_code", f"SELECT conv_id, turn, {_extract_code_sql('reply')} AS code FROM (SELECT conv_id, turn, {_FENCED} AS reply FROM conversations)")
def q_extract_code(spark, sf):
    df = T(spark, sf, "conversations")
    nl = F.lit("\n")
    reply = F.when(F.col("role") == "assistant", F.concat(F.lit("```python"), nl, F.col("text"), nl, F.lit("```"))).otherwise(F.col("text"))
    return df.select("conv_id", "turn", X.extract_code(reply).alias("code"))


@query(
    "extract_metric",
    "SELECT event_id, round(TRY_CAST(regexp_extract('step ' || CAST(event_id AS VARCHAR) || ' New RMSLE: ' || printf('%.4f', value), "
    "'(?:New RMSLE:)\\s*([+-]?[0-9]*\\.?[0-9]+(?:[eE][+-]?[0-9]+)?)', 1) AS DOUBLE), 6) AS rmsle FROM events",
)
def q_extract_metric(spark, sf):
    df = T(spark, sf, "events")
    line = F.concat(F.lit("step "), F.col("event_id").cast("string"), F.lit(" New RMSLE: "), F.format_string("%.4f", F.col("value")))
    return rounded(df.select("event_id", X.extract_metric(line, "New RMSLE:").alias("rmsle")))


def _health_json_sql() -> str:
    """The report as one JSON text: findings sorted like Spark's array_sort of
    (issue, col_name, value, detail) structs, NULL fields left out."""
    item = (
        """'{"issue":"' || issue || '"'"""
        """ || CASE WHEN col_name IS NULL THEN '' ELSE ',"col_name":"' || col_name || '"' END"""
        """ || CASE WHEN value IS NULL THEN '' ELSE ',"value":' || CAST(value AS VARCHAR) END"""
        """ || CASE WHEN detail IS NULL THEN '' ELSE ',"detail":"' || detail || '"' END || '}'"""
    )
    order = "issue, col_name NULLS FIRST, value NULLS FIRST, detail NULLS FIRST"
    return f"""SELECT '{{"findings":[' || string_agg({item}, ',' ORDER BY {order}) || ']}}' AS report FROM ({HEALTH_SQL})"""


from .registry import ORACLES as _OR  # noqa: E402

_OR["health_json"] = _health_json_sql()
