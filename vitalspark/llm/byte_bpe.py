"""Byte-level BPE encoding and decoding with the tokenizers library.

Ranks (token bytes -> rank, the ``.tiktoken`` form) become a vocabulary over
printable characters by the byte-to-character table of byte-level BPE; every
split of a token into two tokens is a merge, tried in rank order, and a piece
that is itself a token is taken whole. Texts are cut into the matches of the
split pattern; each distinct piece is encoded by the library once per worker
and batch history (a bounded memo), since pieces are independent.

Decoding goes back through the byte table. A character whose bytes lie in
several tokens is whole again once the bytes are joined; ``decode_ids`` gives
U+FFFD for bytes that are no valid UTF-8 (ids cut inside a character).

Defined cases: null text is the empty text (no ids, empty bytes); null ids pass
through; repeated rows give repeated rows; extra columns are kept unless their
name is one of the result's, in which case the result's wins; an empty table
gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalspark.llm.common import MEMO_ENTRIES, chunks, whole_text

#: Pieces given to the library at a time.
PIECES_AT_ONCE = 4096


def byte_table() -> list[str]:
    """The character that stands for each byte: printable Latin-1 bytes stand
    for themselves, the others take the code points from 256 on, in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table, free = [""] * 256, 256
    for b in range(256):
        if b in printable:
            table[b] = chr(b)
        else:
            table[b], free = chr(free), free + 1
    return table


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class ByteBpe:
    """One vocabulary in a worker: encode pieces, decode ids, offsets."""

    def __init__(self, path: str, pattern: str):
        import regex
        from tokenizers import Tokenizer, models, pre_tokenizers

        ranks = read_ranks(path)
        table = byte_table()
        shown = {token: "".join(table[b] for b in token) for token in ranks}
        merges = [
            (shown[token[:cut]], shown[token[cut:]])
            for token in sorted(ranks, key=ranks.get)
            for cut in range(1, len(token))
            if token[:cut] in ranks and token[cut:] in ranks
        ]
        self.tokenizer = Tokenizer(
            models.BPE({shown[t]: r for t, r in ranks.items()}, merges, ignore_merges=True)
        )
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.split = regex.compile(pattern)
        back = {c: b for b, c in enumerate(table)}
        self.token_bytes = [b""] * (max(ranks.values()) + 1)
        for character_form, rank in ((shown[t], r) for t, r in ranks.items()):
            self.token_bytes[rank] = bytes(back[c] for c in character_form)
        self.numerals = [str(i) for i in range(len(self.token_bytes))]
        self.memo: dict[str, tuple[int, ...]] = {}

    def _learn(self, pieces: list[str]) -> None:
        for at in range(0, len(pieces), PIECES_AT_ONCE):
            part = pieces[at : at + PIECES_AT_ONCE]
            encoding = self.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
            ids, owner = encoding.ids, np.asarray(encoding.word_ids)
            ends = np.searchsorted(owner, np.arange(len(part)), side="right").tolist()
            begin = 0
            for piece, end in zip(part, ends):
                self.memo[piece] = tuple(ids[begin:end])
                begin = end

    def encode(self, texts: list[str]) -> list[list[int]]:
        if len(self.memo) > MEMO_ENTRIES:
            self.memo.clear()
        cut = [self.split.findall(text) for text in texts]
        self._learn(list(set(chain.from_iterable(cut)) - self.memo.keys()))
        known = self.memo.__getitem__
        return [list(chain.from_iterable(map(known, pieces))) for pieces in cut]

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids))

    def offsets(self, text: str, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Per token the code points [start, end) that its bytes touch; tokens
        that split a character share it."""
        raw = np.frombuffer(text.encode(), np.uint8)
        character_of = np.cumsum((raw & 0xC0) != 0x80) - 1  # of each byte
        ends = np.cumsum([len(self.token_bytes[i]) for i in ids], dtype=np.int64)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
        if not len(ends):
            return starts, ends
        return character_of[starts], character_of[ends - 1] + 1


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def _kept(df: DataFrame, made: list[T.StructField]) -> list[T.StructField]:
    names = {f.name.lower() for f in made}
    return [f for f in df.schema.fields if f.name.lower() not in names]


def _map(df: DataFrame, column: str, made: list[T.StructField], f) -> DataFrame:
    """Add the columns that ``f(values of column) -> dict`` makes, by Arrow batch."""
    kept = _kept(df, made)
    source = df.select(
        *(F.col(f"`{k.name}`").alias(f"k{i}") for i, k in enumerate(kept)), F.col(f"`{column}`").alias("v")
    )
    types = T.StructType(
        [T.StructField(f"k{i}", k.dataType, True) for i, k in enumerate(kept)]
        + [T.StructField(f"m{i}", m.dataType, True) for i, m in enumerate(made)]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(types)
        for batch in chain.from_iterable(map(chunks, batches)):
            values = f(batch.column(batch.num_columns - 1))
            columns = [batch.column(i) for i in range(len(kept))]
            columns += [pa.array(values[m.name], schema.field(len(kept) + i).type) for i, m in enumerate(made)]
            yield pa.RecordBatch.from_arrays(
                [c.cast(schema.field(i).type) if c.type != schema.field(i).type else c for i, c in enumerate(columns)],
                schema=schema,
            )

    out = source.mapInArrow(run, types)
    return out.select(
        *(F.col(f"k{i}").alias(k.name) for i, k in enumerate(kept)),
        *(F.col(f"m{i}").alias(m.name) for i, m in enumerate(made)),
    )


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", offsets: bool = False) -> DataFrame:
    """Add ``ids`` (array of int) and, with ``offsets``, ``starts`` and ``ends``
    (code points of each token; tokens inside one character share it)."""
    made = [T.StructField("ids", T.ArrayType(T.IntegerType()))]
    if offsets:
        made += [T.StructField(n, T.ArrayType(T.LongType())) for n in ("starts", "ends")]

    def run(values: pa.Array) -> dict:
        bpe, texts = load(path, pattern), pc.fill_null(values, "").to_pylist()
        out = {"ids": bpe.encode(texts)}
        if offsets:
            spans = [bpe.offsets(t, i) for t, i in zip(texts, out["ids"])]
            out |= {"starts": [s for s, _ in spans], "ends": [e for _, e in spans]}
        return out

    return _map(df, text, made, run)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """Add ``decoded`` (bytes) and ``decoded_text`` (U+FFFD for broken bytes)
    from an array of ids; null ids decode to nothing."""
    made = [T.StructField("decoded", T.BinaryType()), T.StructField("decoded_text", T.StringType())]

    def run(values: pa.Array) -> dict:
        bpe = load(path, pattern)
        decoded = [bpe.decode_bytes(x or []) for x in values.to_pylist()]
        return {"decoded": decoded, "decoded_text": [d.decode("utf-8", "replace") for d in decoded]}

    return _map(df, ids, made, run)


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """Encode each text and decode its ids in the same task; digests only, so
    the ids never leave the worker: ``n_tokens``, ``ids_sha256`` (decimal ids
    joined by commas), ``decoded_sha256`` (decoded bytes)."""
    made = [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]

    def run(values: pa.Array) -> dict:
        bpe = load(path, pattern)
        encoded = bpe.encode(pc.fill_null(values, "").to_pylist())
        numeral = bpe.numerals.__getitem__
        return {
            "n_tokens": [len(ids) for ids in encoded],
            "ids_sha256": [hashlib.sha256(",".join(map(numeral, ids)).encode()).hexdigest() for ids in encoded],
            "decoded_sha256": [hashlib.sha256(bpe.decode_bytes(ids)).hexdigest() for ids in encoded],
        }

    return _map(df, text, made, run)


def digest_query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from vitalspark.llm.common import table

    documents = table(spark, sf_dir, "documents").select("doc_id", whole_text().alias("text"))
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return round_trip(documents, path, public_tokenizers.PATTERN).drop("text")


def encode_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its number of tokens, the digests of its ids and of
    the bytes they decode to, and its ``block``, ``slot`` and ``place`` in the
    mix: files are not read in the order in which they were written."""
    import public_tokenizers

    from vitalspark.llm.mixing import targeted

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return round_trip(targeted(docs), path, public_tokenizers.PATTERN)
