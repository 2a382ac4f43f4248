"""The registered queries of this subpackage: thin calls of the operators on
the driver's tables, and DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    chat_format,
    exact_dedup,
    lang_ecoc,
    length_buckets,
    merkle_manifest,
    periodic_runs,
    rans_tokens,
    simhash_trie,
    token_scan,
    toxic_lexicon,
    url_filter,
    warc_bundle,
    winnow,
)
from .common import prepare, table

URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
NEAR_SHINGLE, NEAR_BITS = 3, 2
EXTRA_CONV = "<|im_end|><|im_start|>assistant ok"


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select(
        "page_id", "host", "path", "rule", "verdict"
    )


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text"
    )
    extra = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(EXTRA_CONV).alias("text"),
    )
    records = chat_format.gather_rows(rows.unionByName(extra), "conv_id", "turn", "role", "text")
    out = chat_format.read_back(chat_format.format_turns(chat_format.read_table(records, ["turns"])))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        F.col("conv").alias("conv_id"),
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return lang_ecoc.identify_held_out(table(spark, sf_dir, "documents"))


def op4_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return length_buckets.pack(table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    found = winnow.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated"
    )


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return warc_bundle.roundtrip(table(spark, sf_dir, "pages"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return simhash_trie.near_dedup(table(spark, sf_dir, "documents"), shingle=NEAR_SHINGLE, max_bits=NEAR_BITS)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return token_scan.document_tokens(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.exact_dedup(rows).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return toxic_lexicon.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text of ``docs``; with h = crc32(doc_id as text) divisible by
    10 and g = h / 10, the n words from a = g % n on repeat with period
    1 + (n - a) / (3 + g % 8)."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")

    def repeated(w):
        n, g = F.size(w), F.floor(h / 10)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        word = F.transform(
            F.sequence(F.lit(0).cast("bigint"), n - F.lit(1).cast("bigint")),
            lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")),
        )
        return F.when(n > 0, F.array_join(word, " ")).otherwise(F.lit(""))

    # the words are bound once, not cut again for each of them
    changed = F.get(F.transform(F.array(words), repeated), F.lit(0))
    return docs.select("doc_id", F.when(h % 10 == 0, changed).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    found = periodic_runs.find_runs(planted_runs(table(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    # greatest length, then smallest start, then smallest period
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    found = found.withColumn("best", best)
    start, length, period = -F.col("best.start"), F.col("best.length"), -F.col("best.period")
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_coded_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return rans_tokens.coded_tokens(table(spark, sf_dir, "documents"))


LEAF = ("doc_id", "source", "lang", "n_chars", "text")
TAMPER_EVERY = 7


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    changed = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in LEAF]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER_EVERY == 0
    rows = merkle_manifest.manifest(docs, LEAF, carry={"changed": F.when(tampered, merkle_manifest.digest(*changed))})
    folded = rows.withColumn("folded_root", merkle_manifest.fold(F.coalesce("changed", "leaf"), F.col("path")))
    return folded.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(merkle_manifest.siblings(F.col("path")).cast("binary"), 256).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_chat_format": op2_chat_format,
    "op3_language_id": op3_language_id,
    "op4_length_buckets": op4_length_buckets,
    "op5_decontaminate": op5_decontaminate,
    "op6_warc": op6_warc,
    "op7_simhash": op7_simhash,
    "op8_token_counts": op8_token_counts,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_toxicity": op10_toxicity,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_coded_tokens": op12_coded_tokens,
    "op13_merkle": op13_merkle,
    "pipeline": pipeline,
}

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)


def _cells(n_chars: str) -> str:
    values = [n_chars if c == "n_chars" else c for c in LEAF]
    cell = "CASE WHEN {0} IS NULL THEN '-' ELSE octet_length(encode(CAST({0} AS VARCHAR))) || ':' || CAST({0} AS VARCHAR) END"
    return "sha256(" + " || ".join(cell.format(v) for v in values) + ")"


# unsigned crc32 of doc_id as text, bit by bit
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: ascii(ch)::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda a, k: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295)"""
_FOLD = "sha256(CASE WHEN a.h IS NULL THEN acc WHEN c.i % 2 = 0 THEN acc || a.h ELSE a.h || acc END)"

ORACLES = {
    "op1_url_filter": rf"""
WITH rules(rh, rp, verdict) AS (VALUES {_RULES}),
cut AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') = 0 THEN ''
                             ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), {_AZ}) AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS rid FROM cut),
met AS (SELECT rid, rh || rp AS rule, verdict,
               row_number() OVER (PARTITION BY rid ORDER BY length(rh || rp) DESC, length(rh) DESC) AS k
        FROM parts, rules WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts LEFT JOIN (SELECT * FROM met WHERE k = 1) USING (rid)""",
    "op2_chat_format": rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{EXTRA_CONV}' UNION ALL SELECT -1, 1, 'assistant', '{EXTRA_CONV}')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(24 + length(replace(replace(role, '\', '\\'), '<|', '<\|'))
         + length(replace(role, chr(10), chr(10) || chr(10))) - length(role)
         + length(replace(replace(text, '\', '\\'), '<|', '<\|'))) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id""",
    "op5_decontaminate": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS win
       FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS s FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s
             FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
hit AS (SELECT doc_id, s, dw.n, item_id FROM dw JOIN iw ON dw.win = iw.win AND dw.n = iw.n),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS p FROM hit) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
          FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op6_warc": r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
g AS (SELECT body, max(page_id) AS first_id FROM p WHERE octet_length(body) >= 1000 GROUP BY body)
SELECT page_id, CAST(octet_length(p.body) AS BIGINT) AS payload_bytes, sha1(p.body) AS payload_digest,
       CASE WHEN first_id IS NOT NULL AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM p LEFT JOIN g ON p.body = g.body""",
    "op9_exact_dedup": rf"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), {_AZ}) AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM n""",
    "op13_merkle": rf"""
WITH RECURSIVE cells AS (SELECT doc_id, lang, {_cells("n_chars")} AS h, {_cells("n_chars + 1")} AS t FROM documents),
leaf AS (SELECT doc_id, lang, h, CASE WHEN {_CRC} % {TAMPER_EVERY} = 0 THEN t ELSE h END AS t,
                row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM cells),
up AS (SELECT lang, 0 AS lv, i, h, n FROM leaf
       UNION ALL SELECT lang, lv + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 1) // 2 FROM up WHERE n > 1 GROUP BY lang, lv, i // 2),
sub AS (SELECT lang, h, lv, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (SELECT 0 AS lv, i, h, n FROM sub
        UNION ALL SELECT lv + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 1) // 2 FROM top WHERE n > 1 GROUP BY lv, i // 2),
root AS (SELECT h AS root FROM top WHERE n = 1),
climb AS (SELECT doc_id, lang, h AS leaf, 0 AS lv, i, n, t AS acc, '' AS proof FROM leaf
          UNION ALL SELECT doc_id, c.lang, leaf, c.lv + 1, c.i // 2, (c.n + 1) // 2, {_FOLD}, proof || coalesce(a.h, '')
          FROM climb c LEFT JOIN up a ON a.lang IS NOT DISTINCT FROM c.lang AND a.lv = c.lv AND a.i = xor(c.i, 1) WHERE c.n > 1),
climb_top AS (SELECT doc_id, leaf, s.h AS subroot, 0 AS lv, s.i, s.n, acc, proof FROM climb c JOIN sub s ON s.lang IS NOT DISTINCT FROM c.lang WHERE c.n = 1
              UNION ALL SELECT doc_id, leaf, subroot, c.lv + 1, c.i // 2, (c.n + 1) // 2, {_FOLD}, proof || coalesce(a.h, '')
              FROM climb_top c LEFT JOIN top a ON a.lv = c.lv AND a.i = xor(c.i, 1) WHERE c.n > 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = root AS verified
FROM climb_top, root WHERE n = 1""",
}
