"""Token counts by separator scan.

Token files are flat: little-endian uint16 ids, each document followed by the
end-of-document id, no index.  ``write_token_files`` makes such files in the
shared folder (and lists which documents went into which file, in order).
``count_tokens`` cuts files into fixed blocks that know nothing of document
boundaries; a task searches a block for the separator in one vectorised pass
and reports the documents that end in it, counted from the block's start,
and the tokens left over at its end.  A prefix scan over the blocks of a file
stitches the counts: the first document to end in a block also gets what the
blocks before it left over.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import open_store, shared_path

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed value: the vocabulary's public split pattern
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
EOD = 50256
DTYPE = "<u2"
BLOCK = 1 << 20  # tokens of a block


@cache
def encoder(path: str):
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def tokens(text: str | None, vocabulary: str) -> np.ndarray:
    """Ids of the whole text; control strings in it are ordinary text."""
    return np.array(encoder(vocabulary).encode_ordinary(text), DTYPE) if text else np.zeros(0, DTYPE)


def write_token_files(df: DataFrame, folder: str, id_col: str, text_col: str, vocabulary: str = VOCABULARY, eod: int = EOD) -> DataFrame:
    """One flat file per non-empty partition; returns the manifest (file, doc,
    id, bytes): ``doc`` numbers the documents of a file, the largest ``bytes`` is
    the file's size.  File names are unique per attempt and only finished tasks
    are listed."""

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = open_store(folder)
        name, out, n, size = f"{uuid.uuid4().hex}.u16", None, 0, 0
        end = np.array([eod], DTYPE).tobytes()
        for pdf in parts:
            if out is None:
                store.create_dir(root, recursive=True)
                out = store.open_output_stream(f"{root}/{name}", compression=None)
            for text in pdf["text"]:
                raw = tokens(text, vocabulary).tobytes()
                out.write(raw)
                out.write(end)
                size += len(raw) + len(end)
            yield pd.DataFrame({"file": name, "doc": np.arange(n, n + len(pdf)), "id": pdf["id"].astype("object"), "bytes": size})
            n += len(pdf)
        if out is not None:
            out.close()

    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    manifest = rows.mapInPandas(write, "file string, doc bigint, id string, bytes bigint")
    manifest.write.parquet(f"{folder}/manifest")
    return df.sparkSession.read.schema(manifest.schema).parquet(f"{folder}/manifest")


def scan(block: np.ndarray, eod: int) -> tuple[np.ndarray, int]:
    """(tokens before each separator since the one before it or the block's
    start, tokens after the last separator)."""
    at = np.flatnonzero(block == eod)
    lengths = np.diff(at, prepend=-1) - 1
    return lengths, len(block) - (int(at[-1]) + 1 if len(at) else 0)


def count_tokens(files: DataFrame, folder: str, eod: int = EOD, block: int = BLOCK) -> DataFrame:
    """(file, doc, n_tokens) of flat files given as (file, bytes) rows; a last
    document without separator counts too.  Empty files have no documents."""
    width = np.dtype(DTYPE).itemsize
    step = block * width
    cuts = files.filter(F.col("bytes") > 0).select(
        "file", "bytes", F.explode(F.sequence(F.lit(0), F.expr(f"(bytes - 1) div {step}"))).alias("block")
    )

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = open_store(folder)
        for pdf in parts:
            for file, size, k in zip(pdf["file"], pdf["bytes"], pdf["block"], strict=True):
                with store.open_input_file(f"{root}/{file}") as f:
                    f.seek(k * step)
                    lengths, rest = scan(np.frombuffer(f.read(min(step, size - k * step)), DTYPE), eod)
                yield pd.DataFrame({"file": [file], "block": [k], "last": [(k + 1) * step >= size], "ends": [lengths], "rest": [rest]})

    # by number: a few bytes per row here stand for a whole block of work, which
    # a split by size would put into one task
    cuts = cuts.repartition(int(cuts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file", "block")
    blocks = cuts.mapInPandas(read, "file string, block bigint, last boolean, ends array<bigint>, rest bigint")
    # prefix scan over a file's blocks: documents before the block, and the
    # tokens left over since the last block with a separator
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counted = blocks.withColumn("n", F.size("ends"))
    counted = counted.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    counted = counted.withColumn("left_all", F.coalesce(F.sum("rest").over(earlier), F.lit(0)))
    # leftovers that an earlier separator has already used up
    used = F.max(F.when(F.col("n") > 0, F.col("left_all"))).over(earlier)
    counted = counted.withColumn("carry", F.col("left_all") - F.coalesce(used, F.lit(0)))
    tail = (F.col("last")) & (F.col("rest") + F.when(F.col("n") > 0, 0).otherwise(F.col("carry")) > 0)
    lengths = F.when(
        F.col("n") > 0,
        F.concat(F.array(F.get("ends", F.lit(0)) + F.col("carry")), F.slice("ends", 2, F.greatest(F.col("n") - 1, F.lit(0)))),
    ).otherwise(F.array().cast("array<bigint>"))
    open_end = F.array(F.col("rest") + F.when(F.col("n") > 0, 0).otherwise(F.col("carry")))
    lengths = F.when(tail, F.concat(lengths, open_end)).otherwise(lengths)
    return counted.select("file", "before", F.posexplode(lengths).alias("at", "n_tokens")).select(
        "file", (F.col("before") + F.col("at")).alias("doc"), "n_tokens"
    )


def document_tokens(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, block: int = BLOCK
) -> DataFrame:
    """(id, n_tokens) per row: written to flat files, counted by scanning them.

    Null and empty texts have no tokens; null ids and repeated rows are rows
    like any other; other columns are not read."""
    folder = shared_path(df.sparkSession, "tokens")
    manifest = write_token_files(df, folder, id_col, text_col, vocabulary)
    files = manifest.groupBy("file").agg(F.max("bytes").alias("bytes"))
    counts = count_tokens(files, folder, block=block)
    kind = dict(df.dtypes)[id_col]
    # both sides grow with the documents: never broadcast
    return manifest.join(counts.hint("merge"), ["file", "doc"]).select(F.col("id").cast(kind).alias(id_col), "n_tokens")
