import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkmend.llm import token_scan as ts
from sparkmend.llm import warc_bundle as wb
from sparkmend.llm.common import open_store, shared_path

BIG = "é" * 700
PAGES = [
    (1, "http://a/", BIG), (2, "http://b/\r\nX: y", BIG), (9, None, BIG), (3, "u", "small"), (4, "u", "small"), (5, None, None),
    (6, "u", ""), (None, "u", BIG), (7, "ü", "x" * 999), (8, "u", "x" * 999), (10, "u", "x" * 1000), (11, "u", "x" * 1000),
    (12, "u", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n" * 50), (9, "again", BIG), (13, "u", "z" * 600000),
]


def expected():
    first = {}
    for i, _, t in PAGES:
        if i is not None and len((t or "").encode()) >= 1000:
            first[t] = max(i, first.get(t, i))
    out = []
    for i, _, t in PAGES:
        raw = (t or "").encode()
        again = t in first and i != first[t]
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", first[t] if again else None))
    return sorted(out, key=str)


def test_warc_round_trip_and_random_access(spark):
    df = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").withColumn("refers_to", F.lit("clash")).repartition(3)
    got = wb.roundtrip(df)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected()
    assert wb.roundtrip(df.limit(0)).collect() == []

    folder = shared_path(spark, "warc")
    index = wb.write_bundles(wb.payload_table(df, "page_id", "url", "html"), folder, frame_bytes=2000)
    raw = {r["record"]: bytes(r["raw"]) for r in wb.read_records(index.filter("record like '%:12' or record like '%:3'"), folder).collect()}
    assert set(raw) == {wb.ID + "12", wb.ID + "3"}
    (head, _, size, body), = wb.parse(raw[wb.ID + "12"])
    assert body.decode() == PAGES[12][2] and size == len(body) and head["WARC-Type"] == "response"

    # any Zstandard reader reads the whole archive; frames stand alone
    import zstandard

    store, root = open_store(folder)
    archive = index.first()["archive"]
    with store.open_input_file(f"{root}/{archive}") as f:
        table = wb.seek_table(f)
        parts = [wb.read_frame(f, *t) for t in table]
        f.seek(0)
        whole = zstandard.ZstdDecompressor().stream_reader(f.read(), read_across_frames=True).read()
    assert b"".join(parts) == whole and len(list(wb.parse(whole))) == index.filter(F.col("archive") == archive).count()


def test_hot_payloads_and_rows_without_a_key_are_spread(spark):
    """Groups too many to broadcast: no task gets the rows without a key or
    those of one payload."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        same = F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 3 == 1, F.concat(F.lit("k"), F.floor(F.col("id") / 6)))
        rows = spark.range(9000).withColumn("same", same).repartition(4)
        groups = rows.filter("same is not null").groupBy("same").agg(F.max("id").alias("first_id"), F.count("*").alias("n"))
        out = wb.join_groups(rows, groups, 9000)
        found = out.withColumn("p", F.spark_partition_id()).collect()
        sizes = [sum(r["p"] == p for r in found) for p in {r["p"] for r in found}]
        assert len(found) == 9000 and max(sizes) < 2000
        want = wb.join_groups(rows, groups, None).collect()
        assert sorted(map(str, out.select("id", "same", "first_id").collect())) == sorted(str(r) for r in spark.createDataFrame(want).select("id", "same", "first_id").collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_damaged_payload_raises():
    raw = wb.record(1, "u", b"abc", None, "d").replace(b"abc", b"abd")
    (head, _, _, body), = wb.parse(raw)
    assert hashlib.sha1(body).hexdigest() != head["WARC-Payload-Digest"].removeprefix("sha1:")
    with pytest.raises(ValueError):
        list(wb.parse(b"HTTP/1.1\r\n\r\n"))


@pytest.mark.parametrize("block", [1, 3, 7, 1 << 20])
def test_token_counts_over_block_edges(spark, block):
    texts = [None, "", "one two three", "<|endoftext|>", "word " * 300, "é🙂" * 20, "a"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "x y", 1), (3, "a", 1)], "doc_id bigint, text string, n_tokens int").repartition(2)
    got = sorted(((r["doc_id"], r["n_tokens"]) for r in ts.document_tokens(df, block=block).collect()), key=str)
    want = sorted(((r["doc_id"], len(ts.tokens(r["text"], ts.VOCABULARY))) for r in df.collect()), key=str)
    assert got == want
    assert ts.document_tokens(df.limit(0), block=block).collect() == []


@pytest.mark.parametrize("block", [1, 2, 5, 100])
def test_flat_files_from_elsewhere(spark, block):
    rng = np.random.default_rng(2)
    folder = shared_path(spark, "flat")
    store, root = open_store(folder)
    store.create_dir(root, recursive=True)
    want, files = [], []
    for k in range(4):
        ids = np.where(rng.random(40) < [0.3, 0, 1, 0.1][k], ts.EOD, rng.integers(0, 50000, 40)).astype(ts.DTYPE)
        with store.open_output_stream(f"{root}/f{k}", compression=None) as f:
            f.write(ids.tobytes())
        files.append((f"f{k}", ids.nbytes))
        ends = [-1, *np.flatnonzero(ids == ts.EOD)]
        lens = [int(b - a - 1) for a, b in zip(ends, ends[1:])] + ([39 - int(ends[-1])] if ends[-1] != 39 else [])
        want += [(f"f{k}", i, n) for i, n in enumerate(lens)]
    df = spark.createDataFrame([*files, ("none", 0)], "file string, bytes bigint")
    got = ts.count_tokens(df, folder, block=block).collect()
    assert sorted((r["file"], r["doc"], r["n_tokens"]) for r in got) == sorted(want)
