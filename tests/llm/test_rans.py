import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkmend.llm import queries as q
from sparkmend.llm import rans_tokens as rt
from sparkmend.llm.common import open_store, shared_path

SF = "/root/testdata/sf0.001"
ODD = [
    None, "", " \n\t", "A", "It's we'll 'RE x''s 12 a1b2", "<|endoftext|> b", "x<|STARTOFTEXT|>", "é É ÀÖØ×÷ÿß ªº µ", "ﬁ İ Σας ΣΑΣ",
    "á ́b ée", "中文 字 🙂🙂 — ’s", "\x00\x01 \x1c a\x1cb \x7f \x85z", "tab\tnew\r\nline\x0b\x0c!", "...!!!a,b;c", " a b﻿", '"' * 9,
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(rt.default_vocabulary())


def ids_of(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, rt.END]


def test_ids_are_the_librarys(spark, library):
    enc = rt.Encoder(rt.default_vocabulary())
    assert enc.by_piece
    texts = ODD + [chr(c) + "a" + chr(c) * 2 + " B" + chr(c) for c in range(0x250)]
    texts += [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    for t in texts:
        assert np.frombuffer(enc.encode(t), enc.dtype).tolist() == ids_of(library, t)[:-1], t


def test_other_vocabulary_goes_whole_to_the_library():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    enc = rt.Encoder(path)
    assert not enc.by_piece
    text = " two  spaces\nIt's"
    assert np.frombuffer(enc.encode(text), enc.dtype).tolist() == enc.library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("counts", [[0, 0, 0], [1, 0, 0], [10**12, 1, 0, 5], list(range(3000))])
def test_table_and_round_trip(spark, counts):
    counts = np.array(counts, np.int64)
    table = rt.Table.of_counts(counts)
    assert int(table.freq.sum()) == 1 << rt.SCALE and table.freq.min() >= 1
    folder = shared_path(spark, "table")
    table.write(folder)
    assert (rt.Table.read(folder, table.crc).freq == table.freq).all()
    rng = np.random.default_rng(len(counts))
    p = (counts + 0.01) / (counts + 0.01).sum()
    raws, want = [], []
    for n in (1, 15, 16, 17, rt.CHECK * rt.LANES, rt.CHECK * rt.LANES + 1, rt.BLOCK):
        ids = rng.choice(len(counts), n, p=p).astype(np.uint32)
        steps = -(-n // rt.LANES)
        filled = np.zeros(steps * rt.LANES, np.int64)
        filled[:n] = ids
        coded = rt.encode_blocks(filled.reshape(1, steps, rt.LANES), table)[0]
        raws.append(rt.pack_block(ids, coded, {"docs": [n]}, table))
        want.append(ids)
    got = rt.decode_blocks(raws, folder)
    assert all((g == w).all() and about == {"docs": [len(w)]} for (g, about), w in zip(got, want, strict=True))
    # close to the entropy of the counts for the long block
    bits = -np.log2(table.freq[want[-1]].astype(float) / (1 << rt.SCALE)).sum()
    assert len(raws[-1]) * 8 < bits * 1.01 + 8 * (4 * 132 + 200)
    bad = bytearray(raws[3])
    bad[len(bad) // 2] ^= 1
    with pytest.raises(ValueError):
        rt.decode_blocks([bytes(bad)], folder)


def test_crc_of_pieces():
    rng = np.random.default_rng(1)
    for n in (0, 1, 4, 999):
        a, b, c = (rng.bytes(k) for k in (7, n, 300))
        whole = rt.crc_shift(zlib.crc32(a), len(b) + len(c)) ^ rt.crc_shift(zlib.crc32(b), len(c)) ^ zlib.crc32(c)
        assert whole == zlib.crc32(a + b + c)


def expected(library, rows):
    """rows in file order -> (id, start, n, crc)."""
    out, start = [], 0
    for i, text in rows:
        ids = np.array(ids_of(library, text), "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("block, at_once", [(32, 2), (1 << 14, 64)])
def test_odd_tables(spark, library, block, at_once, monkeypatch):
    # workers import the module anew, so the sizes go in by way of the functions
    monkeypatch.setattr(rt, "BLOCK", block)
    monkeypatch.setattr(rt, "AT_ONCE", at_once)
    texts = ODD + ["long words of one text " * 9000, "again", "again"]
    rows = [(None if i < 2 else i, t, i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, start int").repartition(4)
    got = rt.coded_tokens(df, with_ids=True).collect()
    assert rt.coded_tokens(df.limit(0)).collect() == []
    known = [(i, t) for i, t, _ in rows if i is not None]
    want = expected(library, [(None, None), (None, ""), *known])
    assert sorted((r["doc_id"] or -1, r["start"], r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((i or -1, *x) for i, *x in want)
    ids = {r["start"]: np.frombuffer(r["ids"], "<u4").tolist() for r in got}
    assert all(ids[s] == ids_of(library, t) for (_, s, _, _), (_, t) in zip(want[2:], known, strict=True))


def test_files_stand_alone(spark, library):
    df = spark.createDataFrame([(i, "some words %d " % i * 400) for i in range(300)], "doc_id bigint, text string").repartition(2)
    folder = shared_path(spark, "coded")
    enc = rt.encoder(rt.default_vocabulary())
    staged = rt.tokenise(df, "doc_id", "text", rt.default_vocabulary(), rt.END)
    counts = rt.count_ids(staged, enc.size, enc.dtype)
    index = rt.write_files(staged, folder, rt.Table.of_counts(counts), enc.dtype)
    store, root = open_store(folder)
    ids = []
    for file in [r["file"] for r in index.select("part", "first", "file").distinct().orderBy("part", "first").collect()]:
        with store.open_input_file(f"{root}/{file}") as f:
            for block in rt.read_index(f):
                f.seek(int(block["offset"]))
                (got, about), = rt.decode_blocks([f.read(int(block["bytes"]))], folder)
                assert len(got) == block["ids"] == sum(d[-1] for d in about["docs"])
                ids += got.tolist()
    want = [x for i in range(300) for x in ids_of(library, "some words %d " % i * 400)]
    assert ids == want and counts.sum() == len(want)
    assert index.agg(F.sum("bytes")).first()[0] < len(want)  # under a byte an id here


def test_query_against_library(spark, library):
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    got = q.op12_coded_tokens(spark, SF)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(tuple(r) for r in got.collect()) == expected(library, rows)
