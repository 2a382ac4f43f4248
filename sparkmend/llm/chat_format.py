"""Chat formatting by schema fingerprint (native).

The nested field paths of a record (``messages[].role``, ``prompt`` ...),
sorted and hashed, are its schema fingerprint.  A table of declarative
mappings, one Spark SQL expression per fingerprint, turns each layout into
canonical turns: ``array<struct<role,text>>``.  ``read_table`` takes the
fingerprint from a DataFrame's schema; ``read_json`` takes one per record, of the
known paths that it has, so one column may mix layouts and carry other fields.

The template writes ``<|im_start|>role`` newline text ``<|im_end|>`` newline
per turn.  Inside texts and roles a backslash is doubled and the ``|`` of
``<|`` gets a backslash (a newline inside a role becomes ``\\+``), so no
text can hold a template mark and reading back gives the exact turns.
"""

from __future__ import annotations

import hashlib
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_names, without

START, END = "<|im_start|>", "<|im_end|>"
TURNS = "array<struct<role:string,text:string>>"
RESULT = ("layout", "turns", "formatted", "mask", "loss_text")

# name, field paths, Spark SQL expression of the turns ({r}: the record)
LAYOUTS: list[tuple[str, list[str], str]] = [
    (
        "messages",
        ["messages[].content", "messages[].role"],
        "transform({r}messages, m -> struct(m.role as role, m.content as text))",
    ),
    (
        "turn_rows",
        ["turns[].role", "turns[].text", "turns[].turn"],
        "transform(array_sort({r}turns), t -> struct(t.role as role, t.text as text))",
    ),
    (
        "share",
        ["conversations[].from", "conversations[].value"],
        "transform({r}conversations, m -> struct(case m.`from` when 'human' then 'user' when 'gpt' then 'assistant'"
        " else m.`from` end as role, m.value as text))",
    ),
    (
        "instruction",
        ["input", "instruction", "output"],
        "array(struct('user' as role, if(coalesce({r}input, '') = '', {r}instruction, concat_ws('\\n\\n', {r}instruction, {r}input)) as text),"
        " struct('assistant' as role, {r}output as text))",
    ),
    (
        "instruction_only",
        ["instruction", "output"],
        "array(struct('user' as role, {r}instruction as text), struct('assistant' as role, {r}output as text))",
    ),
    (
        "prompt",
        ["prompt", "response"],
        "array(struct('user' as role, {r}prompt as text), struct('assistant' as role, {r}response as text))",
    ),
    (
        "prompt_completion",
        ["completion", "prompt"],
        "array(struct('user' as role, {r}prompt as text), struct('assistant' as role, {r}completion as text))",
    ),
    (
        "system_prompt",
        ["prompt", "response", "system"],
        "array(struct('system' as role, {r}system as text), struct('user' as role, {r}prompt as text),"
        " struct('assistant' as role, {r}response as text))",
    ),
]


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Sorted leaf paths of a schema; ``[]`` marks array elements."""
    if isinstance(kind, T.StructType):
        return sorted(p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name))
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{at}[]")
    return [at]


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


MAPPINGS = {fingerprint(paths): (name, expr) for name, paths, expr in LAYOUTS}


def _clean(turns: Column) -> Column:
    empty = F.lit("")
    return F.transform(
        F.coalesce(turns, F.array().cast(TURNS)),
        lambda t: F.struct(F.coalesce(t["role"], empty).alias("role"), F.coalesce(t["text"], empty).alias("text")),
    ).cast(TURNS)


def read_table(df: DataFrame, fields: list[str]) -> DataFrame:
    """``df`` plus layout and turns, by the schema of its columns ``fields``.
    Raises for a layout without a mapping."""
    df = without(df, "layout")
    paths = field_paths(T.StructType([f for f in df.schema.fields if f.name in fields]))
    got = MAPPINGS.get(fingerprint(paths))
    if got is None:
        raise ValueError(f"no mapping for a record of {paths}")
    return df.withColumn("turns", _clean(F.expr(got[1].replace("{r}", "")))).withColumn("layout", F.lit(got[0]))


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _text(v: Column) -> Column:
    """A text value; of one given as parts, their texts one after the other."""
    part = lambda p: F.coalesce(_get(p, "$.text", "string"), F.when(_get(p, "$.type", "string").isNull(), _get(p, "$", "string")), F.lit(""))
    parts = _get(v, "$", "array<variant>")
    return F.when(parts.isNotNull(), F.array_join(F.transform(parts, part), "")).otherwise(_get(v, "$", "string"))


def _element(inner: list[str], m: Column) -> Column:
    """A list element's known fields; a turn number first, as rows are sorted by it."""
    first = [_get(m, "$.turn", "double").alias("turn")] if "turn" in inner else []
    return F.struct(*first, *[_text(_get(m, f"$.{f}", "variant")).alias(f) for f in inner if f != "turn"])


def _has(field: str, m: Column) -> Column:
    return _get(m, f"$.{field}", "variant").isNotNull()


def _fields() -> dict[str, list[str]]:
    """Top-level field -> fields of its elements (none for a single value)."""
    out: dict[str, list[str]] = {}
    for path in sorted({p for _, paths, _ in LAYOUTS for p in paths}):
        top, _, inner = path.partition("[].")
        out.setdefault(top, []).extend([inner] if inner else [])
    return out


def read_json(df: DataFrame, json_col: str) -> DataFrame:
    """``df`` plus layout and turns of JSON records in mixed layouts.

    A record is parsed once.  Which of the known field paths it has is its
    fingerprint; it selects the mapping with the most paths that are all there
    (the first listed of equals), whatever other fields there are.  An empty
    list has every path of its elements, and gives no turns.  Texts may be
    lists of parts.  A record that is null, not JSON, or of no known layout has
    layout null and no turns."""
    df = without(df, "layout", "turns")
    rec, has = free_names(df, "rec", "has")
    v = F.col(rec)
    values, present = [], []
    for top, inner in _fields().items():
        if not inner:
            values.append(_text(_get(v, f"$.{top}", "variant")).alias(top))
            present.append(F.when(_get(v, f"$.{top}", "variant").isNotNull(), F.lit(top)))
            continue
        rows = _get(v, f"$.{top}", "array<variant>")
        values.append(F.transform(rows, partial(_element, inner)).alias(top))
        for f in inner:
            there = (F.size(rows) == 0) | F.exists(rows, partial(_has, f))
            present.append(F.when(rows.isNotNull() & there, F.lit(f"{top}[].{f}")))
    known = df.withColumn(rec, F.try_parse_json(F.col(json_col)))
    known = known.withColumn(has, F.array_compact(F.array(*present))).withColumn(rec, F.struct(*values))
    layout, turns = F.lit(None).cast("string"), F.array().cast(TURNS)
    # the mapping looked at last wins: fewest paths first
    for name, paths, expr in sorted(reversed(LAYOUTS), key=lambda x: len(x[1])):
        hit = F.size(F.array_except(F.array(*map(F.lit, paths)), F.col(has))) == 0
        layout = F.when(hit, F.lit(name)).otherwise(layout)
        turns = F.when(hit, F.expr(expr.replace("{r}", f"{rec}.")).cast(TURNS)).otherwise(turns)
    return known.withColumn("layout", layout).withColumn("turns", _clean(turns)).drop(rec, has)


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\+"))


def unescape(text: Column) -> Column:
    """Pairs are read from the left: pieces between doubled backslashes."""
    return F.array_join(
        F.transform(
            F.split(text, r"\\\\"),
            lambda p: F.replace(F.replace(p, F.lit("\\|"), F.lit("|")), F.lit("\\+"), F.lit("\n")),
        ),
        "\\",
    )


def format_turns(df: DataFrame, turns_col: str = "turns", loss_role: str = "assistant") -> DataFrame:
    """``df`` plus formatted and mask.

    mask: array<struct<chars,loss>>, consecutive runs of code points that
    cover ``formatted`` exactly; loss runs are the (escaped) texts of
    ``loss_role``.  No turns: an empty string and an empty mask."""
    df = without(df, "formatted", "mask")
    head = lambda t: F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n"))
    tail = F.lit(END + "\n")
    formatted = F.array_join(F.transform(turns_col, lambda t: F.concat(head(t), escape(t["text"]), tail)), "")
    run = lambda n, loss: F.struct(n.alias("chars"), loss.alias("loss"))
    mask = F.flatten(
        F.transform(
            turns_col,
            lambda t: F.array(
                run(F.char_length(head(t)), F.lit(False)),
                run(F.char_length(escape(t["text"])), t["role"] == loss_role),
                run(F.char_length(tail), F.lit(False)),
            ),
        )
    )
    return df.withColumn("formatted", formatted).withColumn("mask", mask)


def read_back(df: DataFrame) -> DataFrame:
    """Replace turns by those read from ``formatted`` and add loss_text: what
    lies under the loss runs of ``mask``, unescaped, in order."""
    df = without(df, "turns", "loss_text")
    body = F.slice(F.split("formatted", r"<\|im_start\|>"), 2, 1 << 30)
    turns = F.transform(
        body,
        lambda s: F.struct(
            unescape(F.substring_index(s, "\n", 1)).alias("role"),
            unescape(F.regexp_extract(s, r"(?s)^[^\n]*\n(.*)<\|im_end\|>\n$", 1)).alias("text"),
        ),
    )
    # runs of one turn are header, text, footer: cut each text at its offset in its own segment
    runs = F.transform(F.sequence(F.lit(0), F.size("mask") - 3, F.lit(3)), lambda i: F.slice("mask", i + 1, 3))
    cut = F.transform(
        F.arrays_zip(body.alias("s"), F.when(F.size("mask") > 0, runs).otherwise(F.array().cast("array<array<struct<chars:int,loss:boolean>>>")).alias("r")),
        lambda z: F.when(
            z["r"][1]["loss"],
            unescape(F.substr(z["s"], z["r"][0]["chars"] - len(START) + 1, z["r"][1]["chars"])),
        ).otherwise(F.lit("")),
    )
    return df.withColumn("turns", turns).withColumn("loss_text", F.array_join(cut, ""))


def gather_rows(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """One record per conversation from rows by turn: (conv, turns).  Turns go
    by number, then role and text (nulls first); repeated rows are turns of
    their own."""
    one = F.struct(F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    return df.groupBy(F.col(conv_col).alias("conv")).agg(F.collect_list(one).alias("turns"))
