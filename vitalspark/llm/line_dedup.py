"""Line dedup with two Bloom filters, for lines seen once and seen twice.

1. Every task hashes the lines it reads (128 bits of the stripped line, ASCII
   letters in lower case) and adds the distinct ones of each document to a pair
   of filters, "seen" and "seen again", kept as sorted bit positions. Pairs are
   merged by ranges of bit positions: a bit is seen again if one pair has it so or
   two pairs have seen it. What moves is a few bytes a distinct line of a task.
2. The "seen again" filter goes to all tasks. A line whose bits are all in it is
   a suspect; every line of two documents is one, and some others.
3. Only suspects are shuffled: (hash, document) pairs are counted exactly, and
   each hash of enough documents gets its place in the largest id.
4. Documents with a line to lose are joined with those lines and rebuilt; the
   others pass as they are, without a shuffle.

A filter has ``BITS_PER_LINE`` bits a line, up to ``max_bits`` (256 MB). It never
misses a repeat; beyond that size more lines are suspects, in the end all of
them, and the exact count does more of the work with equal results. So its
broadcast is bounded whatever the input.

Defined cases: null and empty texts are one empty line; rows of equal id are one
document; null ids are one document, smaller than all others; extra columns are
ignored; an empty table gives an empty result. Texts of any length are whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalspark.llm.common import chunks, shared_path, table, whole_text
from vitalspark.llm.components import stored

MIN_CHARS, MIN_DOCS = 20, 3
BITS_PER_LINE, MAX_BITS = 16, 1 << 31
#: Lines that a task gathers before it gives out its pair of filters.
GATHER = 1_000_000
#: Bits of a range of positions that is merged as one (128 KB as bits).
RANGE_BITS = 20
BLANK = b" \t\n\v\f\r"


def line_hashes(text: bytes, min_chars: int) -> list[bytes | None]:
    """Of each line of a text: the hash of its key, None for short keys."""
    import xxhash

    of = xxhash.xxh3_128_digest
    out = []
    for line in text.lower().split(b"\n"):  # of bytes: ASCII letters only
        key = line.strip(BLANK)
        n = len(key)
        if n >= min_chars and not key.isascii():  # code points begin with other than 10xxxxxx
            n = len(key.decode())
        out.append(of(key) if n >= min_chars else None)
    return out


def positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Two bit positions of each hash (n rows of two 64-bit numbers)."""
    return (hashes & np.uint64(bits - 1)).astype(np.uint32)


def as_hashes(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)


def packed(values: np.ndarray) -> bytes:
    """Sorted distinct positions, as compressed differences."""
    return zlib.compress(np.diff(values, prepend=np.uint32(0)).astype("<u4").tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data), "<u4"), dtype=np.uint64).astype(np.int64)


def texts_of(column: pa.Array) -> list[bytes]:
    return pc.fill_null(column, "").cast(pa.binary()).to_pylist()


def seen_again(texts: DataFrame, bits: int, min_chars: int) -> np.ndarray:
    """The "seen again" filter of all texts, as packed bits (bits / 8 bytes)."""
    spark = texts.sparkSession
    range_bits = min(RANGE_BITS, bits.bit_length() - 1)
    ranges = bits >> range_bits

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []

        def flush():
            hashes = as_hashes(held)
            hashes = hashes[np.argsort(hashes[:, 0], kind="stable")]
            again = np.flatnonzero(hashes[1:, 0] == hashes[:-1, 0])  # a hash of another document
            at = positions(hashes, bits)
            once, twice = np.unique(at), np.unique(at[again])
            cut = np.arange(1, ranges, dtype=np.int64) << range_bits
            parts = [np.split(x, np.searchsorted(x, cut)) for x in (once, twice)]
            full = [r for r in range(ranges) if len(parts[0][r])]
            low = lambda x, r: packed((x[r].astype(np.int64) - (r << range_bits)).astype(np.uint32))
            return pa.RecordBatch.from_pydict(
                {"part": pa.array(full, pa.int32()), "once": pa.array([low(parts[0], r) for r in full], pa.binary()),
                 "twice": pa.array([low(parts[1], r) for r in full], pa.binary())}
            )

        for batch in chain.from_iterable(map(chunks, batches)):
            for text in texts_of(batch.column(0)):
                held += {h for h in line_hashes(text, min_chars) if h is not None}
            if len(held) >= GATHER:
                yield flush()
                held = []
        if held:
            yield flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for part, once, twice in zip(*(c.to_pylist() for c in batch.columns)):
                seen, again = pairs.setdefault(part, tuple(np.zeros(1 << range_bits, bool) for _ in range(2)))
                at = unpacked(once)
                again[at[seen[at]]] = True
                again[unpacked(twice)] = True
                seen[at] = True
        for part, (_, again) in pairs.items():
            found = np.flatnonzero(again)
            if len(found):
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "again": pa.array([packed(found.astype(np.uint32))], pa.binary())})

    tasks = max(1, min(ranges, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    pairs = texts.mapInArrow(gather, "part int, once binary, twice binary")
    found = pairs.repartitionById(tasks, F.pmod("part", F.lit(tasks))).mapInArrow(merge, "part int, again binary")
    out = np.zeros(bits >> 3, np.uint8)
    for row in found.toLocalIterator():  # at most bits / 8 bytes in all
        at = unpacked(row["again"]) + (row["part"] << range_bits)
        np.bitwise_or.at(out, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
    return out


def is_set(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1


def marked(rows: DataFrame, filter_bits, bits: int, min_chars: int, with_suspects: bool | None = None) -> DataFrame:
    """``rows`` (id, t) with their number of lines and suspect hashes; only those
    with (True) or without (False) suspects if asked."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        again = np.frombuffer(filter_bits.value, np.uint8)
        for batch in chain.from_iterable(map(chunks, batches)):
            lines = [line_hashes(text, min_chars) for text in texts_of(batch.column(1))]
            own = [sorted({h for h in x if h is not None}) for x in lines]
            n = [len(x) for x in own]
            digests = [h for x in own for h in x]
            hit = is_set(again, positions(as_hashes(digests), bits).astype(np.int64)).all(1)
            ends = np.cumsum([0, *n])
            suspects = [[h for h, s in zip(x, hit[a:b]) if s] for x, a, b in zip(own, ends, ends[1:])]
            out = pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(x) for x in lines], pa.int64()), pa.array(suspects, pa.list_(pa.binary()))],
                names=["id", "t", "n_lines", "suspects"],
            )
            if with_suspects is not None:
                out = out.filter(pa.array([bool(x) == with_suspects for x in suspects], pa.bool_()))
            yield out

    return rows.select("id", "t").mapInArrow(run, f"id {kind}, t string, n_lines long, suspects array<binary>")


def drop_lines(rows: DataFrame, min_chars: int) -> DataFrame:
    """(id, n_lines, n_dropped, clean) from (id, t, n_lines, lost)."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(map(chunks, batches)):
            clean, dropped = [], []
            for text, lost in zip(texts_of(batch.column(1)), batch.column(3).to_pylist()):
                if lost:
                    gone, lines = set(lost), text.split(b"\n")
                    stay = [line for line, h in zip(lines, line_hashes(text, min_chars)) if h not in gone]
                    dropped.append(len(lines) - len(stay))
                    clean.append(b"\n".join(stay).decode())
                else:
                    dropped.append(0)
                    clean.append(text.decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(dropped, pa.int64()), pa.array(clean, pa.string())],
                names=["id", "n_lines", "n_dropped", "clean"],
            )

    return rows.select("id", "t", "n_lines", "lost").mapInArrow(run, f"id {kind}, n_lines long, n_dropped long, clean string")


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS,
                min_docs: int = MIN_DOCS, max_bits: int = MAX_BITS) -> DataFrame:
    """(key, clean_text, n_lines, n_dropped) of every document: lines whose key
    has ``min_chars`` code points and is in ``min_docs`` documents stay only in
    the largest id that has it. ``min_docs`` is 2 at least."""
    if min_docs < 2 or max_bits & (max_bits - 1):
        raise ValueError("min_docs is 2 at least, max_bits a power of two")
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{key}`").alias("id"), whole_text(f"`{text}`").alias("t"))
    lines = rows.agg(F.sum(F.length("t") - F.length(F.translate("t", "\n", "")) + 1)).head()[0] or 0
    bits = max(1 << 10, min(max_bits, 1 << (BITS_PER_LINE * lines).bit_length()))
    again = spark.sparkContext.broadcast(seen_again(rows.select("t"), bits, min_chars).tobytes())
    suspected = marked(rows, again, bits, min_chars, True)
    # the texts' hash tells rows of equal id apart
    row = F.xxhash64("t").alias("row")
    path = shared_path(spark, "suspects")
    suspected.select("id", row, F.explode("suspects").alias("h")).write.parquet(path)
    pairs = spark.read.parquet(path)
    counts = pairs.select("h", "id").distinct().groupBy("h").agg(F.count("*").alias("c"), F.max("id").alias("top"))
    # stored, so that the join below has shuffles on both sides and a line of very
    # many documents is split over tasks there
    repeated = stored(counts.where(F.col("c") >= min_docs).select("h", "top"), "repeated")
    lost = (
        pairs.join(repeated, "h").where(~F.col("id").eqNullSafe(F.col("top")))
        .groupBy(F.col("id").alias("of"), F.col("row").alias("of_row")).agg(F.collect_set("h").alias("lost"))
    )
    both = F.col("id").eqNullSafe(F.col("of")) & (F.col("row") == F.col("of_row"))
    met = suspected.select("id", "t", "n_lines", row).join(lost, both, "left")
    others = marked(rows, again, bits, min_chars, False)
    out = drop_lines(met, min_chars).unionByName(
        others.select("id", "n_lines", F.lit(0).cast("long").alias("n_dropped"), F.col("t").alias("clean"))
    )
    return out.select(F.col("id").alias(key), F.col("clean").alias("clean_text"), "n_lines", "n_dropped")


def dedup_query(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("clean_text", 256).alias("kept_sha256"))
