"""Interpolated modified Kneser-Ney bigram model, counted in Spark.

Tokens are words (ASCII letters in lower case) and one end each text. Words are
hashed; first their counts are added up by parts of the hash space, each written
as one file of sorted hashes and counts to the shared folder. A word's rank is its
place in these files, one behind the other. Then tasks turn texts into pairs of
ranks, add equal ones up, and send each part of the pair space its pairs as one
packed array (sorted, bytes of equal weight together, zstandard); parts are merged
and written as sorted pairs and counts. What pairs say about words (distinct
predecessors; as context: total and followers seen once, twice and more often)
takes a third shuffle of the same kind into arrays by rank. Only sizes of parts
and counts of counts come to the driver. Workers map the files into memory and
find hashes and pairs by binary search; the folder must be mounted at the workers,
as a shared ``spark.checkpoint.dir`` of the file system is. A lost task writes its
file again, under a temporary name that is then renamed. More than 2**32 - 2
distinct words are refused.

P(w|v) = max(c(vw) - D, 0) / c(v) + g(v) P(w), with P(w) made in the same way
from numbers of distinct predecessors and ending in 1 / (V + 1), which unknown
words get too. Contexts never seen use P(w).

Defined cases: null and empty texts are one end; a null id counts as the empty
text in the split; repeated rows count as often as they occur; extra columns are
ignored; an empty table, or one without training rows, gives every token the
same probability. Texts are whole at any length.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalspark.llm.common import chunks, doc_remainder, shared_path, table, text_bytes, whole_text

#: Characters of training text per part of the hash space.
PART_CHARS = 24_000_000
#: Words or pairs that a task gathers before equal ones are added up and sent.
GATHER = 2_000_000
STATS = 5  # predecessors, total as context, followers seen 1, 2, 3+ times
#: Each byte in lower case, blanks as spaces.
PLAIN = np.asarray([32 if 9 <= c <= 13 else c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)


def word_hash(word: str | bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word)


#: No word has a blank, so blanks stand for the end and the start.
END, START = "\n", " "


def hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all tokens: hash, hash of the predecessor; and tokens per text. Words are
    cut in Arrow's own buffer, each distinct one is hashed once."""
    data, at = text_bytes(texts)
    data = PLAIN[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[np.flatnonzero(data == 32) + 1] = True
    cut[at] = True
    edges = np.flatnonzero(cut)  # a piece is a word and the blank behind it
    pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(data)])
    coded = pieces.dictionary_encode()
    found = [w.rstrip(b" ") for w in coded.dictionary.to_pylist()]
    code = coded.indices.to_numpy()
    real = np.asarray([bool(w) for w in found], bool)[code]
    hashes = np.fromiter(map(word_hash, found), np.uint64, len(found))
    starts = np.concatenate([[0], np.cumsum(real)])[np.searchsorted(edges, at)] + np.arange(len(at))
    tokens = np.full(starts[-1], word_hash(END), np.uint64)
    is_word = np.ones(len(tokens), bool)
    is_word[starts[1:] - 1] = False
    tokens[is_word] = hashes[code[real]]
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[starts[:-1]] = word_hash(START)
    return tokens, before, np.diff(starts)


def packed(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers of one length, each in as few bytes as its largest
    needs, bytes of equal weight together."""
    import zstandard

    n, out = len(columns[0]), []
    for column in columns:
        kind = np.min_scalar_type(int(column.max()) if n else 0)
        out.append(bytes([kind.itemsize]) + column.astype(kind).view(np.uint8).reshape(n, kind.itemsize).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(struct.pack("<QB", n, len(out)) + b"".join(out))


def unpacked(payload: bytes) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(payload)
    n, width = struct.unpack_from("<QB", raw)
    at, out = 9, []
    for _ in range(width):
        size = raw[at]
        planes = np.frombuffer(raw, np.uint8, n * size, at + 1).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).view(f"<u{size}").ravel().astype(np.uint64))
        at += 1 + n * size
    return out


def steps(ascending: np.ndarray) -> np.ndarray:
    return np.diff(ascending, prepend=ascending.dtype.type(0))


def dealt(part: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """(part, its rows of each column in the given order)."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    edges = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]).tolist() if len(part) else []
    for a, b in zip(edges, [*edges[1:], len(part)]):
        yield int(part[a]), *(c[order[a:b]] for c in columns)


def mixed(pair: np.ndarray) -> np.ndarray:
    x = pair * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def part_of(key: np.ndarray, bits: int) -> np.ndarray:
    return (key >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(key), np.int32)


def added(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, summed values."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys)
    ordered = keys[order]
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    return ordered[first], np.add.reduceat(values[order], first, axis=0)


def put(folder: str, name: str, **arrays: np.ndarray) -> None:
    os.makedirs(folder, exist_ok=True)
    for kind, data in arrays.items():
        own = f"{folder}/.{uuid.uuid4().hex}.npy"
        np.save(own, data)
        os.replace(own, f"{folder}/{name}.{kind}.npy")


def small(values: np.ndarray) -> np.ndarray:
    return values.astype(np.min_scalar_type(int(values.max()) if values.size else 0))


def discounts(n: np.ndarray) -> np.ndarray:
    """D for counts 1, 2 and 3 or more, from the counts of counts 1 to 4."""
    n1, n2, n3, n4 = (float(x) for x in n)
    if min(n1, n2, n3) <= 0:
        return np.asarray([0.5, 0.75, 0.9])
    y = n1 / (n1 + 2 * n2)
    d = np.asarray([1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    return np.clip(d, [0.05, 0.1, 0.15], [0.95, 1.95, 2.95])


def local_path(path: str) -> str:
    scheme, _, rest = path.rpartition("://")
    if scheme not in ("", "file") and "://" in path:
        raise ValueError("the model files need spark.checkpoint.dir on a mounted file system")
    return rest if scheme == "file" else path.removeprefix("file:")


def rows_of(got: list[tuple], schema: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip((f.name for f in schema), row)) for row in got], pa.schema(schema))


PACKED = [pa.field("part", pa.int32()), pa.field("kind", pa.int32()), pa.field("payload", pa.binary())]
PACKED_SQL = "part int, kind int, payload binary"
#: Kinds of rows to the parts of words: predecessors, contexts; counts of pairs'
#: counts and the pairs files that there are.
AS_WORD, AS_CONTEXT, OF_PAIRS = 0, 1, 2


def train(docs: DataFrame, text: str = "text", part_chars: int = PART_CHARS) -> dict:
    """Count, write the files, and return the model's description (a few
    numbers, the parts' sizes and the folder)."""
    spark = docs.sparkSession
    folder = local_path(shared_path(spark, "lm"))
    rows = docs.select(whole_text(text).alias("t"))
    chars = rows.agg(F.sum(F.length("t"))).head()[0] or 0
    bits = max(0, -(-chars // part_chars) - 1).bit_length()
    parts = 1 << bits

    def gathered(batches: Iterator[pa.RecordBatch], keys_of, send) -> Iterator[pa.RecordBatch]:
        """Equal keys of a task's batches added up, sent every ``GATHER`` of them."""
        held, size = [], 0
        for batch in chain.from_iterable(map(chunks, batches)):
            held.append(np.unique(keys_of(batch.column(0)), return_counts=True))
            size += len(held[-1][0])
            if size >= GATHER:
                yield send(*added(*map(np.concatenate, zip(*held))))
                held, size = [], 0
        if size:
            yield send(*added(*map(np.concatenate, zip(*held))))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def send(key, n):
            return rows_of([(p, 0, packed(steps(k), c)) for p, k, c in dealt(part_of(key, bits), key, n)], PACKED)

        return gathered(batches, lambda texts: hashed(texts)[0], send)

    def merge_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, part = [], None
        for batch in batches:
            for p, payload in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                part, (key, n) = p, unpacked(payload)
                got.append((np.cumsum(key, dtype=np.uint64), n))
        if got:
            key, n = added(*map(np.concatenate, zip(*got)))
            put(folder, f"words-{part}", keys=key, values=small(n))
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "size": [len(key)], "tokens": [int(n.sum())]})

    counted = rows.mapInArrow(words, PACKED_SQL).repartitionById(parts, F.col("part"))
    found = counted.mapInArrow(merge_words, "part int, size long, tokens long").collect()  # one row a part
    sizes = np.zeros(parts, np.int64)
    for r in found:
        sizes[r["part"]] = r["size"]
    distinct = int(sizes.sum())
    if distinct > 2**32 - 2:
        raise ValueError("more distinct words than ranks of 32 bits")
    vocabulary = {
        "folder": folder, "bits": bits, "distinct": distinct, "tokens": sum(r["tokens"] for r in found),
        "first": (np.cumsum(sizes) - sizes).tolist(),
        "words": sum(1 << r["part"] for r in found),  # the parts that have a file, as bits
    }
    first = np.asarray(vocabulary["first"], np.int64)
    sizes[-1] += 1  # the last rank is the start's
    part_of_rank = lambda rank: np.searchsorted(first + sizes, rank.astype(np.int64), side="right").astype(np.int32)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def keys_of(texts):
            w, v, _ = hashed(texts)
            return pair_of(ranks(vocabulary, v)[0], ranks(vocabulary, w)[0])

        def send(key, n):
            return rows_of(
                [(p, 0, packed(steps(k >> np.uint64(32)), k & LOW, c)) for p, k, c in dealt(part_of(mixed(key), bits), key, n)], PACKED
            )

        return gathered(batches, keys_of, send)

    def merge_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, part = [], None
        for batch in batches:
            for p, payload in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                part, (v, w, n) = p, unpacked(payload)
                got.append(((np.cumsum(v, dtype=np.uint64) << np.uint64(32)) | w, n))
        if not got:
            return
        key, n = added(*map(np.concatenate, zip(*got)))
        put(folder, f"pairs-{part}", keys=key, values=small(n))
        of_counts = np.asarray([part, *((n == k).sum() for k in (1, 2, 3, 4))])
        as_word = added(key & LOW, np.ones(len(n), np.int64))
        as_context = added(key >> np.uint64(32), np.stack([n, n == 1, n == 2, n >= 3], 1).astype(np.int64))
        out = [(0, OF_PAIRS, packed(of_counts))]
        out += [(p, AS_WORD, packed(steps(r), c)) for p, r, c in dealt(part_of_rank(as_word[0]), *as_word)]
        out += [(p, AS_CONTEXT, packed(steps(r), *c.T)) for p, r, c in dealt(part_of_rank(as_context[0]), *as_context)]
        yield rows_of(out, PACKED)

    def merge_stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stats, part, of_pairs, pair_parts = None, None, np.zeros(4, np.int64), []
        for batch in batches:
            for p, kind, payload in zip(*(batch.column(i).to_pylist() for i in range(3))):
                columns = [c.astype(np.int64) for c in unpacked(payload)]
                if kind == OF_PAIRS:
                    pair_parts.append(int(columns[0][0]))
                    of_pairs += columns[0][1:]
                    continue
                if stats is None:
                    part, stats = p, np.zeros((sizes[p], STATS), np.int64)
                at = np.cumsum(columns[0]) - first[p]  # distinct in a payload
                stats[at, 0 if kind == AS_WORD else slice(1, STATS)] += columns[1] if kind == AS_WORD else np.stack(columns[1:], 1)
        if stats is None and not pair_parts:
            return
        sums = np.zeros(6, np.int64)
        if stats is not None:
            put(folder, f"stats-{part}", values=small(stats))
            before = stats[:, 0]
            sums = np.asarray([before.sum(), *((before == k).sum() for k in (1, 2, 3, 4)), (before >= 3).sum()])
        yield pa.RecordBatch.from_pydict(
            {"s": pa.array([[*sums.tolist(), *of_pairs.tolist()]], pa.list_(pa.int64())), "pairs": pa.array([pair_parts], pa.list_(pa.int64()))}
        )

    of_parts = rows.mapInArrow(pairs, PACKED_SQL).repartitionById(parts, F.col("part"))
    about = of_parts.mapInArrow(merge_pairs, PACKED_SQL).repartitionById(parts, F.col("part"))
    found = about.mapInArrow(merge_stats, "s array<long>, pairs array<long>").collect()  # one row a part
    s = np.asarray([r["s"] for r in found] or [[0] * 10], np.int64).sum(0)
    return vocabulary | {
        "followers": int(s[0]), "of_words": s[1:5].tolist(), "often": int(s[5]), "of_pairs": s[6:10].tolist(),
        "pairs": sum(1 << p for r in found for p in r["pairs"]),
    }


@lru_cache(maxsize=1_024)
def mapped(path: str) -> np.ndarray:
    """An array of a part. The model says which parts it has, so a file that is
    not there is an error, never an unseen n-gram."""
    return np.load(f"{path}.npy", mmap_mode="r")


def found_at(model: dict, kind: str, keys: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place in its part's file of each of the sorted ``keys`` (-1: not there), and
    its value there (0)."""
    place, value = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
    for p, at in dealt(part, np.arange(len(keys))):
        if not model[kind] >> p & 1:
            continue  # the part has no n-gram of this kind
        stored = mapped(f"{model['folder']}/{kind}-{p}.keys")
        spot = np.minimum(np.searchsorted(stored, keys[at]), len(stored) - 1)
        hit = stored[spot] == keys[at]
        place[at[hit]] = spot[hit]
        value[at[hit]] = mapped(f"{model['folder']}/{kind}-{p}.values")[spot[hit]]
    return place, value


def ranks(model: dict, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each hash (-1: unknown; the start has the last), and its count."""
    distinct, back = np.unique(hashes, return_inverse=True)
    part = part_of(distinct, model["bits"])
    place, count = found_at(model, "words", distinct, part)
    rank = np.where(place < 0, -1, place + np.asarray(model["first"], np.int64)[part])
    rank[distinct == np.uint64(word_hash(START))] = model["distinct"]
    return rank[back], count[back]


LOW = np.uint64(2**32 - 1)


def pair_of(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return (v.astype(np.uint64) << np.uint64(32)) | w.astype(np.uint64)


def stats_of(model: dict, rank: np.ndarray) -> np.ndarray:
    """What pairs say about the words of ``rank``; zeros for unknown ones."""
    distinct, back = np.unique(rank, return_inverse=True)
    out = np.zeros((len(distinct), STATS), np.int64)
    first = np.asarray(model["first"], np.int64)
    known = np.flatnonzero(distinct >= 0) if model["followers"] else np.zeros(0, np.int64)
    part = np.searchsorted(first, distinct[known], side="right") - 1  # of parts that begin there, the last
    part[distinct[known] == model["distinct"]] = len(first) - 1
    for p, at in dealt(part, known):
        out[at] = mapped(f"{model['folder']}/stats-{p}.values")[distinct[at] - first[p]]
    return out[back]


def log_probabilities(model: dict, w: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each token, given by hashes: log10 probability, and its count in training."""
    size = model["distinct"] + 1
    (rank_w, count), (rank_v, _) = ranks(model, w), ranks(model, v)
    before, of_context = stats_of(model, rank_w)[:, 0], stats_of(model, rank_v)[:, 1:]
    both = (rank_w >= 0) & (rank_v >= 0)
    distinct, back = np.unique(pair_of(rank_v[both], rank_w[both]), return_inverse=True)
    n = np.zeros(len(w), np.int64)
    n[both] = found_at(model, "pairs", distinct, part_of(mixed(distinct), model["bits"]))[1][back]
    d0, d1 = np.r_[0.0, discounts(model["of_words"])], np.r_[0.0, discounts(model["of_pairs"])]
    take = lambda d, c: d[np.minimum(c, 3)]
    low = np.full(len(w), 1.0 / size)
    if model["followers"]:
        once, twice = model["of_words"][:2]
        rest = (d0[1] * once + d0[2] * twice + d0[3] * model["often"]) / model["followers"]
        low = (before - take(d0, before)) / model["followers"] + rest / size
    total = of_context[:, 0]
    seen = np.maximum(total, 1)
    back = (of_context[:, 1:] @ d1[1:]) / seen
    high = (n - take(d1, n)) / seen + back * low
    return np.log10(np.where(total > 0, high, low)), count


def score(docs: DataFrame, model: dict, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, n_known, base_score, score, perplexity)."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(map(chunks, batches)):
            w, v, n = hashed(batch.column(1))
            logs, count = log_probabilities(model, w, v)
            base = np.log10((count + 0.1) / (model["tokens"] + 0.1 * (model["distinct"] + 1)))
            first = np.cumsum(n) - n
            total = np.add.reduceat(logs, first)
            yield pa.RecordBatch.from_pydict(
                {
                    key: batch.column(0), "n_tokens": n, "n_known": np.add.reduceat((count > 0).astype(np.int64), first),
                    "base_score": np.add.reduceat(base, first), "score": total, "perplexity": 10 ** (-total / n),
                }
            )

    made = "n_tokens long, n_known long, base_score double, score double, perplexity double"
    return docs.select(F.col(f"`{key}`"), whole_text(text).alias("t")).mapInArrow(run, f"`{key}` {kind}, {made}")


def lm_query(spark, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    remainder = doc_remainder(F.col("doc_id"), 10)
    model = train(documents.where(remainder != 0))
    out = score(documents, model)
    return out.select(
        "doc_id", (remainder == 0).alias("held_out"), "n_tokens", "n_known",
        F.lit(model["tokens"]).cast("long").alias("train_tokens"), "base_score", "score", "perplexity",
    )
