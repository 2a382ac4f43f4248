"""Token ids in binary files coded by a static range asymmetric numeral
system (rANS).

One frequency table, counted over all ids and scaled to a power of two, is
shared by all files.  A file is a row of blocks that stand alone, and an index
of them at its end.  A block codes up to ``BLOCK`` ids by ``LANES`` interleaved
coders (id ``i`` goes to lane ``i % LANES``) that write 32-bit words to one
stream; it carries the coders' states and stream place every ``CHECK`` steps,
so that its parts can be decoded side by side, a directory of the documents
whose ids it holds, the CRC-32 of its ids and one of all its bytes.  Coding and
decoding are numpy operations over all lanes of many blocks (and, decoding, of
all their checkpoints) at once.

Jobs: deal rows by range of id and tokenise them in place (staged); count
ids; write files, each from a stretch of staged rows in order; decode units
of neighbouring blocks, anywhere.  A document cut by unit borders has its CRC-32
put together by xor: each piece's is shifted by the bytes after it.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from array import array
from collections import deque
from collections.abc import Iterator, Sequence
from functools import cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import open_store, shared_path, stage

END = 1  # id after each document
SCALE = 20  # frequencies sum to 2 ** SCALE
LANES, BLOCK, CHECK = 16, 1 << 14, 256
AT_ONCE = 64  # blocks coded or decoded at once
LOW = np.uint64(1 << 31)  # smallest state
HEAD = struct.Struct("<4sIHIIIII")  # magic, ids, lanes, checkpoints, words, directory bytes, table crc, ids crc
MAGIC, FOOT = b"RANB", struct.Struct("<QI4s")
INDEX = np.dtype([("offset", "<u8"), ("bytes", "<u4"), ("first", "<u8"), ("ids", "<u4")])
CRC_POLY = 0xEDB88320  # fixed value: the CRC-32 polynomial, reflected
MEMO = 1 << 19  # pieces whose ids a worker keeps


def byte_alphabet() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable
    Latin-1 characters for themselves, the others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = count(0x100)
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


BYTES = byte_alphabet()


# ---- tokenising


class Encoder:
    """Ids of a text as the tokenizers library gives them.

    Of a vocabulary that drops white space and splits by the pattern below, the
    ids of a text are those of its pieces; the library is then asked once per
    different piece.  Texts with characters beyond the Latin ones listed, and
    those with a control string, go to the library word by word or whole."""

    # fixed values: what the vocabulary's file says, and the same for Latin letters
    RULES = {
        "normalizer": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
        "pattern": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+",
    }
    PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\t-\\r a-z0-9ß-öø-ÿ]+")
    PLAIN = re.compile("[\\x00-\\x7FÀ-ÖØ-öø-ÿ]*")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.code = "H" if size <= 1 << 16 else "I"
        self.size, self.dtype = size, np.dtype("<u2" if self.code == "H" else "<u4")
        with open(path) as f:
            rules = json.load(f)
        self.controls = [t["content"] for t in rules.get("added_tokens") or ()]
        split = (rules.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.by_piece = (
            (rules.get("normalizer") or {}).get("normalizers") == self.RULES["normalizer"]
            and split[0].get("pattern") == {"Regex": self.RULES["pattern"]}
            and (split[0].get("behavior"), split[0].get("invert")) == ("Removed", True)
            and [(p.get("type"), p.get("add_prefix_space"), p.get("use_regex")) for p in split[1:]] == [("ByteLevel", False, False)]
            and not rules["model"].get("dropout")
        )
        self.memo: dict[str, bytes] = {}

    def ask(self, text: str) -> bytes:
        return array(self.code, self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def pieces(self, text: str) -> bytes:
        memo, out = self.memo, []
        for piece in self.PIECES.findall(text.lower()):
            ids = memo.get(piece)
            if ids is None:
                if len(memo) >= MEMO:
                    memo.clear()
                # a piece needs the byte alphabet and the merges only
                known = piece if piece.isascii() and piece.isprintable() else "".join([BYTES[b] for b in piece.encode()])
                ids = memo[piece] = array(self.code, [t.id for t in self.library.model.tokenize(known)]).tobytes()
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_piece or any(c in text for c in self.controls):
            return self.ask(text)
        if self.PLAIN.fullmatch(text):
            return self.pieces(text)
        words = re.findall("[^\\t-\\r ]+", text)
        return b"".join(self.pieces(w) if self.PLAIN.fullmatch(w) else self.ask(w) for w in words)


@cache
def encoder(path: str) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return Encoder(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# ---- frequency table


class Table:
    """Scaled frequencies of the ids 0 .. n - 1, each at least 1."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = np.cumsum(self.freq, dtype=np.uint64) - self.freq
        if int(self.freq.sum()) != 1 << SCALE or self.freq.min() < 1:
            raise ValueError("frequencies must be positive and sum to the scale")
        self.crc = zlib.crc32(self.freq.astype("<u4").tobytes())
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64))

    @classmethod
    def of_counts(cls, counts: np.ndarray) -> Table:
        n, total = len(counts), int(counts.sum())
        if n >= 1 << SCALE:
            raise ValueError("more ids than the scale has room for")
        room = (1 << SCALE) - n  # one for each id, the rest by count
        share = counts.astype(object) * room  # exact, whatever the counts
        freq = np.array([x // total if total else 0 for x in share], np.int64) + 1
        left = (1 << SCALE) - int(freq.sum())
        often = np.lexsort((np.arange(n), -counts))
        freq[often] += np.bincount(np.arange(left) % n, minlength=n)
        return cls(freq)

    def write(self, folder: str) -> None:
        store, root = open_store(folder)
        store.create_dir(root, recursive=True)
        raw = self.freq.astype("<u4").tobytes()
        with store.open_output_stream(f"{root}/table-{self.crc:08x}.freq", compression=None) as f:
            f.write(raw)

    @staticmethod
    @cache
    def read(folder: str, crc: int) -> Table:
        store, root = open_store(folder)
        with store.open_input_file(f"{root}/table-{crc:08x}.freq") as f:
            table = Table(np.frombuffer(f.read(), "<u4").astype(np.int64))
        if table.crc != crc:
            raise ValueError("damaged frequency table")
        return table


# ---- coder


def encode_blocks(ids: np.ndarray, table: Table) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Codes ``ids`` (blocks x steps x LANES) to, per block, its words and its
    checkpoints: (words read before, states) every CHECK steps from step 0."""
    blocks, steps, lanes = ids.shape
    by_step = np.ascontiguousarray(ids.transpose(1, 0, 2)).reshape(steps, blocks * lanes)
    x = np.full(blocks * lanes, LOW, np.uint64)
    words = np.empty(by_step.shape, np.uint32)
    put = np.empty(by_step.shape, bool)
    states = np.empty((-(-steps // CHECK), blocks * lanes), np.uint64)
    scale, top = np.uint64(SCALE), np.uint64(63 - SCALE)
    for s in range(steps - 1, -1, -1):
        f = table.freq[by_step[s]]
        over = x >= f << top
        put[s], words[s] = over, x
        x >>= over.astype(np.uint64) << np.uint64(5)
        q, r = np.divmod(x, f)
        x = (q << scale) + r + table.start[by_step[s]]
        if s % CHECK == 0:
            states[s // CHECK] = x
    put, words = put.reshape(steps, blocks, lanes), words.reshape(steps, blocks, lanes)
    states = states.reshape(-1, blocks, lanes)
    out = []
    for b in range(blocks):
        taken = np.cumsum(put[:, b].sum(1)) - put[:, b].sum(1)
        out.append((words[:, b][put[:, b]], taken[::CHECK].astype(np.uint32), states[:, b]))
    return out


def decode_parts(stream: np.ndarray, at: np.ndarray, states: np.ndarray, steps: int, table: Table) -> np.ndarray:
    """Ids (parts x steps x lanes) of parts that begin at word ``at`` of
    ``stream`` in ``states``."""
    x, at = states.astype(np.uint64), at.astype(np.int64)
    out = np.empty((steps, *x.shape), np.uint32)
    mask, scale = np.uint64((1 << SCALE) - 1), np.uint64(SCALE)
    stream = np.append(stream, np.uint32(0)).astype(np.uint64)
    for s in range(steps):
        slot = x & mask
        ids = out[s] = table.symbol[slot]
        x = table.freq[ids] * (x >> scale) + slot - table.start[ids]
        more = x < LOW
        seen = np.cumsum(more, axis=1)
        place = np.minimum(at[:, None] + seen - 1, len(stream) - 1)
        x = np.where(more, (x << np.uint64(32)) | stream[place], x)
        at += seen[:, -1]
    return out.transpose(1, 0, 2)


def pack_block(ids: np.ndarray, coded: tuple, directory: dict, table: Table) -> bytes:
    words, taken, states = coded
    about = zlib.compress(json.dumps(directory).encode(), 1)
    head = HEAD.pack(MAGIC, len(ids), LANES, len(taken), len(words), len(about), table.crc, zlib.crc32(ids.astype("<u4").tobytes()))
    raw = b"".join((head, taken.astype("<u4").tobytes(), states.astype("<u8").tobytes(), words.astype("<u4").tobytes(), about))
    return raw + struct.pack("<I", zlib.crc32(raw))


def parse_block(raw: bytes) -> tuple[dict, np.ndarray, np.ndarray, np.ndarray, dict]:
    if zlib.crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
        raise ValueError("damaged block")
    magic, n, lanes, checks, n_words, about, table, crc = HEAD.unpack_from(raw)
    if magic != MAGIC:
        raise ValueError("not a block")
    at = HEAD.size
    taken = np.frombuffer(raw, "<u4", checks, at)
    states = np.frombuffer(raw, "<u8", checks * lanes, at := at + 4 * checks).reshape(checks, lanes)
    words = np.frombuffer(raw, "<u4", n_words, at := at + 8 * checks * lanes)
    at += 4 * n_words
    return {"n": n, "lanes": lanes, "table": table, "crc": crc}, words, taken, states, json.loads(zlib.decompress(raw[at : at + about]))


def decode_blocks(raws: Sequence[bytes], folder: str) -> list[tuple[np.ndarray, dict]]:
    """(ids, directory) of whole blocks; all their parts are decoded side by
    side.  Raises ValueError where a checksum does not hold."""
    blocks = [parse_block(raw) for raw in raws]
    todo: dict[tuple, list[tuple[int, int]]] = {}
    for b, (head, _, taken, _, _) in enumerate(blocks):
        steps = -(-head["n"] // head["lanes"])
        for c in range(len(taken)):
            todo.setdefault((min(CHECK, steps - c * CHECK), head["lanes"], head["table"]), []).append((b, c))
    base = np.cumsum([0, *(len(words) for _, words, *_ in blocks)])
    stream = np.concatenate([words for _, words, *_ in blocks])
    out = [np.empty((-(-h["n"] // h["lanes"]), h["lanes"]), np.uint32) for h, *_ in blocks]
    for (steps, _, table), parts in todo.items():
        at = np.array([int(base[b]) + int(blocks[b][2][c]) for b, c in parts])
        states = np.stack([blocks[b][3][c] for b, c in parts])
        for (b, c), ids in zip(parts, decode_parts(stream, at, states, steps, Table.read(folder, table)), strict=True):
            out[b][c * CHECK : c * CHECK + steps] = ids
    done = []
    for ids, (head, *_, about) in zip(out, blocks, strict=True):
        ids = ids.reshape(-1)[: head["n"]]
        if zlib.crc32(ids.astype("<u4").tobytes()) != head["crc"]:
            raise ValueError("ids do not match their checksum")
        done.append((ids, about))
    return done


def crc_shift(crc: int, n: int) -> int:
    """What CRC-32 ``crc`` of a piece adds, by xor, to that of the piece and
    ``n`` more bytes: ``crc`` times x ** (8 * n) modulo the polynomial."""

    def times(a: int, b: int) -> int:
        out = 0
        for bit in range(31, -1, -1):
            if a >> bit & 1:
                out ^= b
            b = b >> 1 ^ (CRC_POLY if b & 1 else 0)
        return out

    power = 1 << 23  # x ** 8, highest power in the lowest bit
    while n:
        if n & 1:
            crc = times(power, crc)
        power, n = times(power, power), n >> 1
    return crc


# ---- files


class Writer:
    """Writes one file; ``rows`` are the index rows of the blocks so far."""

    def __init__(self, folder: str, part: int, first: int, table: Table, dtype: np.dtype):
        store, root = open_store(folder)
        self.key, self.table, self.dtype = (part, first), table, dtype
        self.file = f"ids-{part:06d}-{first:012d}-{uuid.uuid4().hex}.rans"
        self.out = store.open_output_stream(f"{root}/{self.file}", compression=None)
        self.held: list[bytes] = []  # ids not yet coded
        self.docs: deque[tuple] = deque()  # (row, id, ids in all, offset of the first held one)
        self.n_held = self.row = 0
        self.rows: list[tuple] = []
        self.offset = self.done = 0

    def add(self, doc_id: str | None, ids: bytes) -> None:
        self.held.append(ids)
        n = len(ids) // self.dtype.itemsize
        self.docs.append((self.row, doc_id, n, 0))
        self.n_held += n
        self.row += 1
        if self.n_held >= BLOCK * AT_ONCE:
            self._flush(self.n_held // BLOCK * BLOCK)

    def _flush(self, n: int) -> None:
        ids = np.frombuffer(b"".join(self.held), self.dtype)
        self.held, self.n_held = [ids[n:].tobytes()], len(ids) - n
        for at in range(0, n, BLOCK * AT_ONCE):
            whole = (min(n, at + BLOCK * AT_ONCE) - at) // BLOCK
            if whole:
                self._put(ids[at : at + whole * BLOCK].reshape(whole, -1))
            rest = ids[at + whole * BLOCK : min(n, at + BLOCK * AT_ONCE)]
            if len(rest):
                self._put(rest.reshape(1, -1))

    def _put(self, blocks: np.ndarray) -> None:
        n = blocks.shape[1]
        steps = -(-n // LANES)
        filled = np.full((len(blocks), steps * LANES), int(self.table.freq.argmax()), np.int64)
        filled[:, :n] = blocks
        for ids, coded in zip(blocks, encode_blocks(filled.reshape(len(blocks), steps, LANES), self.table), strict=True):
            raw = pack_block(ids, coded, self._directory(n), self.table)
            self.out.write(raw)
            self.rows.append((self.offset, len(raw), self.done, n))
            self.offset += len(raw)
            self.done += n

    def _directory(self, n: int) -> dict:
        """Documents of the next ``n`` ids: row in the file, id, ids in all,
        ids before the block, ids in it."""
        out = []
        while n:
            row, doc_id, size, before = self.docs[0]
            here = min(n, size - before)
            out.append([row, doc_id, size, before, here])
            n -= here
            if before + here == size:
                self.docs.popleft()
            else:
                self.docs[0] = (row, doc_id, size, before + here)
        return {"docs": out}

    def close(self) -> None:
        if self.n_held:
            self._flush(self.n_held)
        index = np.array(self.rows, INDEX).tobytes()
        self.out.write(index + FOOT.pack(len(self.rows), zlib.crc32(index), MAGIC))
        self.out.close()


def read_index(f) -> np.ndarray:
    """Index of a file: offset, bytes, first id and ids of each block."""
    f.seek(f.size() - FOOT.size)
    n, crc, magic = FOOT.unpack(f.read(FOOT.size))
    f.seek(f.size() - FOOT.size - n * INDEX.itemsize)
    raw = f.read(n * INDEX.itemsize)
    if magic != MAGIC or zlib.crc32(raw) != crc:
        raise ValueError("damaged index")
    return np.frombuffer(raw, INDEX)


# ---- jobs


def tokenise(df: DataFrame, id_col: str, text_col: str, vocabulary: str, end: int) -> DataFrame:
    """(part, seq, id, ids) staged in the shared folder: parts ascend by id,
    seq counts the rows of a part."""
    from pyspark import TaskContext

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    # equal ids are told apart by text, equal rows by number: no range holds them all
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    keys = ["id", "tie", "row"]
    rows = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select(F.col("id").cast("string").alias("id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seq = encoder(vocabulary), TaskContext.get().partitionId(), 0
        last = array(enc.code, [end]).tobytes()
        for batch in batches:
            n = batch.num_rows
            ids = [enc.encode(t.as_py()) + last for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * n, pa.int32()), pa.array(range(seq, seq + n), pa.int64()), batch.column(0), pa.array(ids, pa.binary())],
                ["part", "seq", "id", "ids"],
            )
            seq += n

    out = rows.mapInArrow(run, "part int, seq bigint, id string, ids binary")
    path = shared_path(df.sparkSession, "ids")
    out.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(out.schema).parquet(path)


def count_ids(staged: DataFrame, size: int, dtype: np.dtype) -> np.ndarray:
    """How often each id occurs; at most ``size`` rows a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype), minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "n"])

    counts = np.zeros(size, np.int64)
    for r in staged.select("ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r["id"]] = r["n"]
    return counts


def write_files(staged: DataFrame, folder: str, table: Table, dtype: np.dtype) -> DataFrame:
    """One file per stretch of staged rows that a task reads in order; returns
    the blocks (part, first, file, block, offset, bytes, done, n) of finished
    tasks; ``done`` counts the file's ids before the block."""
    table.write(folder)
    crc = table.crc
    schema = "part int, first bigint, file string, block bigint, offset bigint, bytes bigint, done bigint, n bigint"
    names = [c.split()[0] for c in schema.split(", ")]

    def listed(w: Writer) -> pa.RecordBatch:
        w.close()
        rows = [(*w.key, w.file, k, *block) for k, block in enumerate(w.rows)]
        kinds = [pa.int32(), pa.int64(), pa.string(), *[pa.int64()] * 5]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequencies, writer, expected = Table.read(folder, crc), None, None
        for batch in batches:
            parts, seqs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for part, seq, doc_id, ids in zip(parts, seqs, batch.column(2), batch.column(3), strict=True):
                if (part, seq) != expected:
                    if writer:
                        yield listed(writer)
                    writer = Writer(folder, part, seq, frequencies, dtype)
                writer.add(doc_id.as_py(), ids.as_py())
                expected = (part, seq + 1)
        if writer:
            yield listed(writer)

    return stage(staged.select("part", "seq", "id", "ids").mapInArrow(run, schema), "blocks")


def read_documents(index: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """(file, row, id, start, n_tokens, ids_crc32) of the documents in the
    files of ``index``; ``start`` counts the ids before, in file order.
    ``with_ids`` adds their ids (little-endian unsigned 32-bit)."""
    spark = index.sparkSession
    files = index.groupBy("part", "first", "file").agg(F.sum("n").alias("n")).collect()  # one row a file
    base, bases = 0, []
    for f in sorted(files):
        bases.append((f["file"], base))
        base += f["n"]
    starts = spark.createDataFrame(bases, "file string, base bigint")
    units = index.groupBy("file", F.floor(F.col("block") / AT_ONCE).alias("unit")).agg(
        F.min("offset").alias("offset"), F.min("done").alias("done"), F.sort_array(F.collect_list(F.struct("block", "bytes"))).alias("sizes")
    )
    units = units.join(F.broadcast(starts), "file").select("file", "offset", (F.col("done") + F.col("base")).alias("done"), F.col("sizes.bytes").alias("sizes"))
    # by number: a row of a few bytes stands for a megabyte of work
    units = units.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file", "offset")
    schema = "file string, row bigint, id string, start bigint, n bigint, size bigint, crc bigint, before bigint, ids binary"
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.string(), *[pa.int64()] * 5, pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        for batch in batches:
            for unit in batch.to_pylist():
                with store.open_input_file(f"{root}/{unit['file']}") as f:
                    f.seek(unit["offset"])
                    raw = f.read(sum(unit["sizes"]))
                cuts = np.cumsum([0, *unit["sizes"]])
                blocks = decode_blocks([raw[a:b] for a, b in zip(cuts, cuts[1:])], folder)
                ids = np.concatenate([b for b, _ in blocks]).astype("<u4")
                pieces: list[list] = []
                for _, about in blocks:
                    for row, doc_id, size, before, here in about["docs"]:
                        if pieces and pieces[-1][0] == row:
                            pieces[-1][4] += here
                        else:
                            pieces.append([row, doc_id, size, before, here])
                at, rows = 0, []
                for row, doc_id, size, before, here in pieces:
                    piece = ids[at : at + here].tobytes()
                    crc = crc_shift(zlib.crc32(piece), 4 * (size - before - here))
                    rows.append((unit["file"], row, doc_id, unit["done"] + at - before, here, size, crc, before, piece if with_ids else None))
                    at += here
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    more = []
    if with_ids:
        ordered = F.array_sort(F.collect_list(F.struct("before", F.hex("ids").alias("ids"))))
        more.append(F.unhex(F.array_join(F.transform(ordered, lambda p: p["ids"]), "")).alias("ids"))
    docs = units.mapInArrow(run, schema).groupBy("file", "row").agg(
        F.first("id", ignorenulls=True).alias("id"), F.first("start").alias("start"), F.sum("n").alias("n_tokens"),
        F.max("size").alias("size"), F.bit_xor("crc").alias("ids_crc32"), *more,
    )
    lost = F.raise_error(F.lit("not all ids of a document were read")).cast("bigint")
    return docs.withColumn("n_tokens", F.when(F.col("n_tokens") == F.col("size"), F.col("n_tokens")).otherwise(lost)).drop("size")


def coded_tokens(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end: int = END, with_ids: bool = False
) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) per row of ``df``: tokenised, written
    to coded files by ascending id, read back from them.

    A null or empty text has the end id only; null ids come first, rows of one
    id by a hash of their text; other columns are not read; an empty table
    gives an empty result."""
    folder = shared_path(df.sparkSession, "coded")
    vocabulary = vocabulary or default_vocabulary()
    enc = encoder(vocabulary)
    staged = tokenise(df, id_col, text_col, vocabulary, end)
    size = max(enc.size, end + 1)
    table = Table.of_counts(count_ids(staged, size, enc.dtype))
    index = write_files(staged, folder, table, enc.dtype)
    kind = dict(df.dtypes)[id_col]
    found = read_documents(index, folder, with_ids)
    return found.select(F.col("id").cast(kind).alias(id_col), "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))
