"""Token ids in compressed blocks with a shared zstandard dictionary.

Layout of a written folder (Parquet written by Spark, so any store that Spark
writes will do, and a lost task is simply run again):

* ``dictionary``: one row (``dict_hash``, ``dictionary`` bytes).
* ``blocks``: rows in ascending document order: ``file`` (rank of the
  partition), ``block`` (rank in it), ``first_id``/``last_id`` (document ids,
  for pruning), ``tokens`` (ids in the block) and ``payload``, one byte string:

  ``b"IDZ1" | dict_hash u64 | n u32 | index n x (doc_id i64, offset u64,
  length u32, tokens u32, present u32) | frames``

  Every document is one zstandard frame of its little-endian u32 ids, so a short
  document is read by its index entry alone; ``dict_hash`` must be that of the
  dictionary used to read.

The dictionary is trained on the serialized ids of at most ``SAMPLE_DOCS``
documents and ``SAMPLE_BYTES`` bytes (by hash of the id; only compression
depends on it). All documents are encoded whole and written.

Defined cases: a null text is the empty text (the end id only); null ids sort
first; rows of equal id keep an order by their ids' checksum; an empty table
writes no blocks and reads back empty; other columns are ignored.
"""

from __future__ import annotations

import ctypes
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalspark.llm.common import chunks, shared_path, table, text_bytes, whole_text

SAMPLE_DOCS, SAMPLE_BYTES, DICT_BYTES = 2_000, 8_000_000, 112_640
LEVEL = 3
#: Ids' bytes that a block gathers before it is closed.
BLOCK_BYTES = 1 << 20
#: Pieces that a worker's memo may hold before it starts anew, and rows encoded together.
MEMO_PIECES = 150_000
ENCODE_ROWS = 512
#: Documents that one written partition should hold, and the most partitions.
FILE_DOCS, MOST_FILES = 25_000, 4_096
MAGIC, HEAD, ENTRY = b"IDZ1", struct.Struct("<4sQI"), struct.Struct("<qQIII")
BLANKS = " \n\t\r"
#: Small letters that every version of Unicode reads alike.
LETTERS = "abcdefghijklmnopqrstuvwxyz\u00df" + "".join(chr(c) for c in range(0xE0, 0x100) if c != 0xF7)
#: How the names of added tokens begin.
MARK = b"<|"
#: Kind of a byte: 0 blank, 1 letter, 2 digit, 3 other ASCII, 4 no ASCII.
KIND = np.asarray(
    [0 if chr(c) in BLANKS else 4 if c > 127 else 1 if chr(c).isalpha() else 2 if chr(c).isdigit() else 3 for c in range(256)], np.uint8
)
INDEX = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("length", "<u4"), ("tokens", "<u4"), ("present", "<u4")])


def cuts(data: np.ndarray) -> np.ndarray:
    """Where pieces may begin: behind every ASCII blank, and where a letter or
    digit and other ASCII meet. The vocabulary's own rule ends a piece at each of
    these; it has "'s" and its like begin with an apostrophe, so there is no cut
    between an apostrophe and what follows. Other characters are cut off only
    where the left one is a letter of Latin-1."""
    kind = KIND[data]
    left, right = kind[:-1], kind[1:]
    ascii_ = (left < 4) & (right < 4) & (left != right) & ~((left == 3) & (right == 1) & (data[:-1] == 0x27))
    latin = np.zeros(len(left), bool)
    if len(data) > 2:
        tail = data[1:-1]
        latin[1:] = (data[:-2] == 0xC3) & (tail >= 0x80) & (tail != 0x97) & (tail != 0xB7) & ((right[1:] == 2) | (right[1:] == 3))
    return np.flatnonzero(ascii_ | latin | (left == 0)) + 1


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, as the vocabulary's normaliser has them; not before
    other characters than ASCII, which might combine with the capital only."""
    upper = (data >= 0x41) & (data <= 0x5A)
    upper[:-1] &= data[1:] < 0x80
    return data + (upper << 5).astype(np.uint8)


class WordIds:
    """Whole texts -> ids. White space separates and is dropped by this kind of
    vocabulary and its rule cuts words from marks, so pieces are independent: a
    batch is cut in Arrow's own buffer, each distinct piece is encoded by the
    library once (a bounded memo), and the texts' ids are gathered from theirs.
    Batches that hold ``MARK``, with which added tokens begin, are cut at blanks
    only, as they are."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        # how the library spells each small letter for its model; with it, words of
        # these letters need no normaliser
        spelt = {c: self.tokenizer.pre_tokenizer.pre_tokenize_str(c) for c in LETTERS}
        self.spelling = str.maketrans({c: s[0][0] for c, s in spelt.items() if len(s) == 1})
        whole = self.tokenizer.encode(LETTERS, add_special_tokens=False).ids
        self.plain = re.compile(f"[{LETTERS}]+").fullmatch if whole == self._of_letters(LETTERS) else lambda word: None
        self._forget()

    def _of_letters(self, word: str) -> list[int]:
        return [t.id for t in self.model.tokenize(word.translate(self.spelling))]

    def _forget(self) -> None:
        self.memo: dict[str, int] = {"": 0}  # word -> place in the two arrays
        self.starts, self.ids = np.zeros(2, np.int64), np.zeros(0, "<u4")

    def _learn(self, words: list[str]) -> None:
        plain, others = [], []
        for word in words:
            (plain if self.plain(word) else others).append(word)
        made = [self._of_letters(word) for word in plain]
        self.memo.update(zip(plain, range(len(self.memo), len(self.memo) + len(plain))))
        starts = [self.starts, len(self.ids) + np.cumsum([len(m) for m in made], dtype=np.int64)]
        ids = [self.ids, np.fromiter(chain.from_iterable(made), "<u4")]
        size = len(self.ids) + len(ids[1])
        for at in range(0, len(others), 4096):
            part = others[at : at + 4096]
            encoding = self.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
            owner = np.asarray([-1 if w is None else w for w in encoding.word_ids], np.int64)
            ids.append(np.asarray(encoding.ids, "<u4"))
            starts.append(size + np.searchsorted(owner, np.arange(len(part)), side="right"))
            size += len(ids[-1])
            self.memo.update(zip(part, range(len(self.memo), len(self.memo) + len(part))))
        self.starts, self.ids = np.concatenate(starts), np.concatenate(ids)

    def _places(self, words: list[str]) -> np.ndarray:
        bare = [w.rstrip(BLANKS) for w in words]
        if len(self.memo) > MEMO_PIECES:
            self._forget()
        new = set(bare) - self.memo.keys()
        if new:
            self._learn(list(new))
        return np.fromiter(map(self.memo.__getitem__, bare), np.int64, len(bare))

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with ``end_id`` behind it; ids before each text
        and after the last). ``texts`` has no nulls."""
        data, at = text_bytes(texts)
        cut = np.zeros(len(data) + 1, bool)
        if MARK in data.tobytes():
            cut[np.flatnonzero(KIND[data] == 0) + 1] = True
        elif len(data):
            cut[cuts(data)] = True
            data = lowered(data)
        cut[at] = True
        edges = np.flatnonzero(cut)
        pieces = pa.LargeStringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges), pa.py_buffer(data))
        coded = pieces.dictionary_encode()
        place = self._places(coded.dictionary.to_pylist())
        code = coded.indices.to_numpy()
        first, size = self.starts[place][code], (self.starts[place + 1] - self.starts[place])[code]
        before = np.concatenate([[0], np.cumsum(size)])
        gathered = self.ids[np.repeat(first - before[:-1], size) + np.arange(before[-1])]
        starts = before[np.searchsorted(edges, at)] + np.arange(len(at))
        out = np.full(starts[-1], end_id, "<u4")
        words_ = np.ones(len(out), bool)
        words_[starts[1:] - 1] = False
        out[words_] = gathered
        return out, starts


def given_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; unused memory goes back after each."""
    for batch in batches:
        yield batch
        give_back(encoder=False)


@lru_cache(maxsize=2)
def load(path: str) -> WordIds:
    return WordIds(path)


def give_back(encoder: bool = True) -> None:
    """Return a worker's unused memory, since workers live on beside the executor;
    with ``encoder`` also the vocabulary and the memo, which stages that encode
    nothing do not need."""
    if encoder:
        load.cache_clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def serialized(ids: np.ndarray, starts: np.ndarray) -> list[memoryview]:
    """The little-endian bytes of each text's ids."""
    view, at = memoryview(ids.view(np.uint8)), (4 * starts).tolist()
    return [view[a:b] for a, b in zip(at, at[1:])]


def dictionary_hash(dictionary: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(dictionary)


def train_dictionary(df: DataFrame, path: str, end_id: int, n_rows: int) -> bytes:
    """Train on a bounded sample, inside one task; only the dictionary (at most
    ``DICT_BYTES``) comes back. Too small a sample gives the empty dictionary,
    that is, plain frames."""
    share = min(1.0, SAMPLE_DOCS / max(1, n_rows))
    picked = df.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000) + 1).limit(SAMPLE_DOCS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples, size = [], 0
        for batch in chain.from_iterable(map(chunks, batches)):
            for ids in serialized(*load(path).encode(batch.column(1), end_id)):
                if size + len(ids) <= SAMPLE_BYTES:
                    samples.append(bytes(ids))
                    size += len(ids)
        trained = b""
        if size > 20_000 and len(samples) > 10:
            try:
                trained = zstandard.train_dictionary(min(DICT_BYTES, size // 10), samples, level=LEVEL).as_bytes()
            except zstandard.ZstdError:  # the samples have nothing in common
                trained = b""
        yield pa.RecordBatch.from_pydict({"dictionary": pa.array([trained], pa.binary())})

    rows = picked.coalesce(1).mapInArrow(run, "dictionary binary").collect()
    return bytes(rows[0][0]) if rows else b""


def _compressor(dictionary: bytes):
    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_content_size=True)


def _decompressor(dictionary: bytes):
    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdDecompressor(dict_data=shared)


def pack_block(rows: list[tuple], dict_hash: int) -> bytes:
    """``rows``: (doc_id or None, tokens, frame) in order."""
    at, entries, frames = HEAD.size + ENTRY.size * len(rows), [], []
    for doc_id, tokens, frame in rows:
        entries.append(ENTRY.pack(doc_id or 0, at, len(frame), tokens, doc_id is not None))
        frames.append(frame)
        at += len(frame)
    return b"".join([HEAD.pack(MAGIC, dict_hash, len(rows)), *entries, *frames])


def block_index(payload: bytes, dict_hash: int) -> np.ndarray:
    magic, found, n = HEAD.unpack_from(payload)
    if magic != MAGIC:
        raise ValueError("not a block of token ids")
    if found != dict_hash:
        raise ValueError(f"block needs dictionary {found:x}, not {dict_hash:x}")
    return np.frombuffer(payload, INDEX, n, HEAD.size)


def write(df: DataFrame, folder: str, path: str, end_id: int = 2) -> DataFrame:
    """Encode ``df`` (doc_id, text) whole and write it to ``folder``; the blocks,
    read back."""
    spark = df.sparkSession
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    ids = rows.select("doc_id")
    n_rows = ids.count()
    files = max(1, min(MOST_FILES, -(-n_rows // FILE_DOCS)))
    steps = [i / files for i in range(1, files)]
    bounds = sorted(set(ids.dropna().approxQuantile("doc_id", steps, 0.2 / files))) if steps else []
    dictionary = train_dictionary(rows, path, end_id, n_rows)
    dict_hash = dictionary_hash(dictionary)
    edges = np.asarray(bounds, np.int64)

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _compressor(dictionary)
        for batch in chain.from_iterable(chunks(b, ENCODE_ROWS) for b in given_back(batches)):
            ids, starts = load(path).encode(batch.column(1), end_id)
            parts = serialized(ids, starts)
            at = np.searchsorted(edges, np.asarray(pc.fill_null(batch.column(0), -(2**63))), side="right")
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(at, pa.int32()),
                    batch.column(0),
                    pa.array(np.diff(starts), pa.int64()),
                    pa.array([zlib.crc32(s) for s in parts], pa.int64()),
                    pa.array([packer.compress(s) for s in parts], pa.binary()),
                ],
                names=["file", "doc_id", "tokens", "crc", "frame"],
            )

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One partition holds one file's documents, in order."""
        held, size, block, file, inside = [], 0, 0, None, 0
        give_back()

        def flush():
            known = [r[0] for r in held if r[0] is not None]
            return pa.RecordBatch.from_pydict(
                {
                    "file": pa.array([file], pa.int32()),
                    "block": pa.array([block], pa.int32()),
                    "first_id": pa.array([min(known, default=None)], pa.int64()),
                    "last_id": pa.array([max(known, default=None)], pa.int64()),
                    "inside": pa.array([inside], pa.int64()),
                    "tokens": pa.array([sum(r[1] for r in held)], pa.int64()),
                    "payload": pa.array([pack_block(held, dict_hash)], pa.binary()),
                }
            )

        for batch in batches:
            for at, doc_id, tokens, frame in zip(*(batch.column(n).to_pylist() for n in ("file", "doc_id", "tokens", "frame"))):
                if held and (at != file or size >= BLOCK_BYTES):
                    yield flush()
                    block, inside = (block + 1, inside + sum(r[1] for r in held)) if at == file else (0, 0)
                    held, size = [], 0
                file = at
                held.append((doc_id, tokens, frame))
                size += 4 * tokens
        if held:
            yield flush()

    dealt = rows.mapInArrow(compress, "file int, doc_id long, tokens long, crc long, frame binary")
    ordered = dealt.repartitionById(len(bounds) + 1, F.col("file")).sortWithinPartitions(
        "file", F.col("doc_id").asc_nulls_first(), "tokens", "crc"
    )
    made = ordered.select("file", "doc_id", "tokens", "frame").mapInArrow(
        close, "file int, block int, first_id long, last_id long, inside long, tokens long, payload binary"
    )
    spark.createDataFrame(
        [(f"{dict_hash:016x}", bytearray(dictionary))], "dict_hash string, dictionary binary"
    ).coalesce(1).write.parquet(f"{folder}/dictionary")
    made.write.parquet(f"{folder}/blocks")
    return spark.read.parquet(f"{folder}/blocks")


def read_dictionary(spark: SparkSession, folder: str) -> bytes:
    row = spark.read.parquet(f"{folder}/dictionary").head()
    dictionary = bytes(row["dictionary"])
    if f"{dictionary_hash(dictionary):016x}" != row["dict_hash"]:
        raise ValueError("the dictionary does not match its hash")
    return dictionary


def _file_starts(blocks: DataFrame) -> DataFrame:
    """(file, file_start): ids before each file, one row a file, at most
    ``MOST_FILES``. Blocks know the ids before them inside their file."""
    before, at = [], 0
    for row in blocks.groupBy("file").agg(F.sum("tokens").alias("n")).orderBy("file").collect():
        before.append((row["file"], at))
        at += row["n"]
    return blocks.sparkSession.createDataFrame(before, "file int, file_start long")


def read(spark: SparkSession, folder: str, doc_ids: list[int] | None = None, digest: bool = False) -> DataFrame:
    """Documents of a written folder: doc_id, start (ids of all documents before
    it), n_tokens and ``ids`` (array), or with ``digest`` their crc32 as
    ``ids_crc32``. With ``doc_ids`` only blocks whose range holds one of them are
    scanned, and only those documents' frames are decompressed."""
    dictionary = read_dictionary(spark, folder)
    dict_hash = dictionary_hash(dictionary)
    blocks = spark.read.parquet(f"{folder}/blocks")
    wanted = None if doc_ids is None else np.asarray(sorted(set(doc_ids)), np.int64)
    starts = F.broadcast(_file_starts(blocks))  # so payloads stay where they lie
    if doc_ids is not None:
        hit = F.lit(False)
        for d in wanted.tolist():
            hit = hit | ((F.col("first_id") <= d) & (F.col("last_id") >= d))
        blocks = blocks.where(hit)
    opened = blocks.join(starts, "file").select((F.col("file_start") + F.col("inside")).alias("start"), "payload")
    result = "ids_crc32 long" if digest else "ids array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener = _decompressor(dictionary)
        give_back()
        for batch in given_back(batches):
            for start, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                view = memoryview(payload.as_buffer())
                index = block_index(view, dict_hash)
                begin = start + np.concatenate([[0], np.cumsum(index["tokens"].astype(np.int64))[:-1]])
                pick = np.arange(len(index))
                if wanted is not None:
                    pick = pick[np.isin(index["doc_id"], wanted) & (index["present"] == 1)]
                raw = [opener.decompress(view[o : o + n]) for o, n in zip(index["offset"][pick].tolist(), index["length"][pick].tolist())]
                last = (
                    pa.array([zlib.crc32(r) for r in raw], pa.int64())
                    if digest
                    else pa.array([np.frombuffer(r, "<u4").astype(np.int64) for r in raw], pa.list_(pa.int64()))
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(index["doc_id"][pick], pa.int64(), mask=index["present"][pick] == 0),
                        pa.array(begin[pick], pa.int64()),
                        pa.array(index["tokens"][pick].astype(np.int64), pa.int64()),
                        last,
                    ],
                    names=["doc_id", "start", "n_tokens", result.split()[0]],
                )

    return opened.mapInArrow(run, f"doc_id long, start long, n_tokens long, {result}")


def files_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = shared_path(spark, "token-files")
    write(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return read(spark, folder, digest=True)
