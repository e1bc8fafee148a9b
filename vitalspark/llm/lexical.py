"""Ranked lexical search over a length-stratified index.

A document's length n gives its normaliser m (integers throughout, see
:func:`impact`). The index has one row a block: documents of one stratum (equal m)
with, for each term, its runs of postings by tf. A term's contribution depends
on (term, tf, m) alone, so it is computed once a run.

Build: texts become term counts (stored once), a table of lengths gives N, L and
each stratum's place in a line of all tokens, and that line is cut into tasks of
equal numbers of tokens; a large stratum is spread over several tasks by a hash
of the document, small ones share a task.

Search: items come in blocks of ``ITEM_BLOCK``; the terms' document frequencies
are summed over the index first. Every task reduces its blocks to the items'
terms and has, for each item, an upper bound per block: the sum over the item's
terms of the impact of the largest tf. It visits the blocks by falling bound and
stops at the first one below the k-th best score so far; a block of equal bound
is still visited, since ties go to the smaller id. The tasks' best k are merged.

Defined cases: null texts have no terms; documents without terms count for
nothing and are not found; rows of equal id are documents of their own; null ids
come after others of equal score; items without terms have no rows, items of
equal id are ranked each by itself; extra columns are ignored; an empty table
gives an empty result. Texts of any length are whole; repeated item terms count
as often as they occur.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitalspark.llm.common import chunks, remove, shared_path, table, whole_text
from vitalspark.llm.components import stored

TOP, ITEM_BLOCK, TASK_TOKENS = 20, 2_000, 1_500_000
#: Rows of the table of strata (three numbers each) that may be broadcast.
MAX_STRATA = 500_000
#: ASCII letters in lower case, digits as they are, other ASCII as blanks.
TERM_BYTES = bytes(
    ord(chr(b).lower()) if chr(b).isalnum() or b >= 0x80 else 0x20 for b in range(128)
) + bytes(range(128, 256))


def terms(text: bytes) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and of all other characters
    beyond ASCII."""
    return text.translate(TERM_BYTES).split()


def impact(tf, m):
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def count_terms(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, n, terms, tfs) of the documents that have a term: its distinct terms
    joined by blanks, and their counts as 32-bit integers (arrays of short terms
    would take three times the space)."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(map(chunks, batches)):
            counts = [Counter(terms(t)) for t in pc.fill_null(batch.column(1), "").cast(pa.binary()).to_pylist()]
            out = pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([c.total() for c in counts], pa.int64()),
                 pa.array([b" ".join(c).decode() for c in counts], pa.string()),
                 pa.array([np.fromiter(c.values(), "<i4", len(c)).tobytes() for c in counts], pa.binary())],
                names=["id", "n", "terms", "tfs"],
            )
            yield out.filter(pc.greater(out.column(1), 0))

    rows = docs.select(F.col(f"`{key}`").alias("id"), whole_text(f"`{text}`").alias("t"))
    return rows.mapInArrow(run, f"id {kind}, n long, terms string, tfs binary")


def blocks_of(rows: DataFrame) -> DataFrame:
    """Index blocks from rows (m, id, terms, tfs), of all rows of equal m that
    follow each other in a partition. ``starts`` are the runs' first postings in
    ``at`` (documents by their place in ``ids``)."""
    kind = rows.schema["id"].dataType.simpleString()

    def block(m: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        ids, joined, tfs = (t.column(c).combine_chunks() for c in ("id", "terms", "tfs"))
        lists = pc.split_pattern(joined, " ")
        code = pc.dictionary_encode(lists.flatten().cast(pa.binary()))
        tf = np.frombuffer(b"".join(tfs.to_pylist()), "<i4")
        doc = np.repeat(np.arange(len(ids), dtype=np.int32), pc.list_value_length(lists).to_numpy())
        term = code.indices.to_numpy()
        order = np.lexsort((doc, tf, term))
        term, tf, doc = term[order], tf[order], doc[order]
        first = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (tf[1:] != tf[:-1])])
        row = [[m], [ids], [code.dictionary], [term[first]], [tf[first]], [first], [doc]]
        types = [pa.int64(), *(pa.list_(x) for x in (ids.type, pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int32()))]
        names = ["m", "ids", "terms", "run_term", "run_tf", "starts", "at"]
        return pa.RecordBatch.from_arrays(
            [pa.array(row[0], types[0]), *(pa.ListArray.from_arrays(pa.array([0, len(x[0])], pa.int32()), x[0] if isinstance(x[0], pa.Array) else pa.array(x[0], t.value_type)) for x, t in zip(row[1:], types[1:]))],
            names=names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            ms = batch.column(0).to_numpy()
            edges = [*np.flatnonzero(np.r_[True, ms[1:] != ms[:-1]]).tolist(), len(ms)]
            for a, b in zip(edges, edges[1:]):
                if held and ms[a] != now:
                    yield block(now, held)
                    held = []
                now = int(ms[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield block(now, held)

    ints = ", ".join(f"{c} array<int>" for c in ("run_term", "run_tf", "starts", "at"))
    return rows.select("m", "id", "terms", "tfs").mapInArrow(run, f"m long, ids array<{kind}>, terms array<binary>, {ints}")


def build(docs: DataFrame, key: str = "doc_id", text: str = "text", task_tokens: int = TASK_TOKENS) -> dict:
    """Write the index of all documents; returns its path, N and L."""
    spark = docs.sparkSession
    counted, path = shared_path(spark, "terms"), shared_path(spark, "index")
    count_terms(docs, key, text).write.parquet(counted)
    rows = spark.read.parquet(counted)
    total = rows.agg(F.count("*").alias("N"), F.coalesce(F.sum("n"), F.lit(0)).alias("L")).head()
    n_docs, length = total["N"], max(total["L"], 1)
    m = F.expr(f"100 - 25 + ((25 * n * {n_docs}L) div {length}L)")
    # one row a stratum: its first and last task on the line of all tokens
    line = Window.orderBy("m").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    strata = rows.groupBy(m.alias("m")).agg(F.sum("n").alias("tokens"))
    upto = F.sum("tokens").over(line)
    strata = strata.select(
        F.col("m").alias("of"), F.floor((upto - F.col("tokens")) / task_tokens).alias("low"), F.floor((upto - 1) / task_tokens).alias("high")
    )
    strata = stored(strata, "strata")
    if strata.count() <= MAX_STRATA:  # else by a shuffle
        strata = F.broadcast(strata)
    tasks = (length - 1) // task_tokens + 1
    wide = rows.withColumn("m", m).join(strata, F.col("m") == F.col("of"))
    task = F.col("low") + F.pmod(F.xxhash64("id", "terms"), F.col("high") - F.col("low") + 1)
    dealt = wide.select("m", "id", "terms", "tfs", task.cast("int").alias("task")).repartitionById(tasks, "task")
    blocks_of(dealt.sortWithinPartitions("m")).write.parquet(path)
    remove(spark, counted)
    return {"path": path, "N": n_docs, "L": length}


class Items:
    """A block of items: distinct terms, and per item its terms and how often."""

    def __init__(self, texts: list[tuple]):
        counts = [Counter(terms((t or "").encode())) for _, t in texts]
        at = [i for i, c in enumerate(counts) if c]
        self.ids = [texts[i][0] for i in at]
        self.number = {t: k for k, t in enumerate(sorted(set(chain.from_iterable(counts))))}
        self.terms = [np.asarray([self.number[t] for t in counts[i]], np.int64) for i in at]
        self.often = [np.asarray(list(counts[i].values()), np.int64) for i in at]
        self.weights = np.zeros(len(self.number), np.int64)


def term_numbers(column: pa.Array, number: dict[bytes, int]) -> np.ndarray:
    """Of each of the block's terms its number among the items' terms, or -1."""
    found = pc.index_in(column, value_set=pa.array(list(number), pa.binary()))
    return pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64)


def frequencies(index: DataFrame, items: Items) -> np.ndarray:
    """Documents of each of the items' terms."""
    number = items.number

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(number), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                own, term, starts, at = (batch.column(c)[i].values for c in range(4))
                of = term_numbers(own, number)[term.to_numpy()]
                n = np.diff(starts.to_numpy(), append=len(at))
                np.add.at(total, of[of >= 0], n[of >= 0])
        yield pa.RecordBatch.from_pydict({"t": pa.array(np.flatnonzero(total), pa.int32()), "n": total[total > 0]})

    found = index.select("terms", "run_term", "starts", "at").mapInArrow(run, "t int, n long")
    out = np.zeros(len(number), np.int64)
    for r in found.groupBy("t").agg(F.sum("n").alias("n")).collect():  # one row a term of the items
        out[r["t"]] = r["n"]
    return out


class Block:
    """An index block reduced to the items' terms, with the impacts of its runs."""

    def __init__(self, m: int, ids: pa.Array, own: pa.Array, run_term, run_tf, starts, at, items: Items):
        of = term_numbers(own, items.number)[run_term]
        keep = np.flatnonzero(of >= 0)
        n = np.diff(starts, append=len(at))[keep]
        order = np.argsort(of[keep], kind="stable")
        keep, n = keep[order], n[order]
        of = of[keep]
        value = items.weights[of] * impact(run_tf[keep].astype(np.int64), m)
        self.ids, self.value = ids, np.repeat(value, n)
        # the postings of the kept runs, one after the other
        ends = np.cumsum(n)
        self.at = at[np.repeat(starts[keep] - (ends - n), n) + np.arange(len(self.value))]
        self.edges = np.searchsorted(np.repeat(of, n), np.arange(len(items.number) + 1))
        self.most = np.zeros(len(items.number), np.int64)
        np.maximum.at(self.most, of, value)

    def scores(self, item_terms: np.ndarray, often: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.ids), np.int64)
        for t, times in zip(item_terms.tolist(), often.tolist()):
            a, b = self.edges[t], self.edges[t + 1]
            if b > a:
                out[self.at[a:b]] += times * self.value[a:b]
        return out


def best_of(scores: np.ndarray, ids: list, k: int) -> list[tuple]:
    """The k best (score, id) with a score above 0; ties by id, null ids last."""
    n = int((scores > 0).sum())
    if n > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= max(least, 1))
    else:
        at = np.flatnonzero(scores > 0)
    found = [(int(scores[i]), ids[i].as_py()) for i in at.tolist()]
    return sorted(found, key=lambda x: (-x[0], x[1] is None, x[1]))[:k]


def visit(blocks: list[Block], items: Items, k: int, counts: Counter | None = None) -> Iterator[tuple]:
    """(item's place, id, score) of each item's k best among the blocks."""
    places = np.cumsum([0, *(len(t) for t in items.terms)])[:-1]
    flat, often = np.concatenate(items.terms), np.concatenate(items.often)
    bounds = np.stack([np.add.reduceat(b.most[flat] * often, places) for b in blocks])
    for i in range(len(items.ids)):
        best: list[tuple] = []
        for b in np.argsort(-bounds[:, i], kind="stable").tolist():
            if bounds[b, i] <= 0 or len(best) == k and bounds[b, i] < best[-1][0]:
                break
            if counts is not None:
                counts["visited"] += 1
            block = blocks[b]
            more = best_of(block.scores(items.terms[i], items.often[i]), block.ids, k)
            best = sorted(best + more, key=lambda x: (-x[0], x[1] is None, x[1]))[:k]
        for score, doc in best:
            yield i, doc, score


def search(index: dict, texts: list[tuple], spark, id_kind: str, item_kind: str, item: str = "item_id",
           key: str = "doc_id", k: int = TOP) -> DataFrame:
    """(item, rank, key, score) for one block of items (id, text)."""
    items = Items(texts)
    schema = f"`{item}` {item_kind}, rank int, `{key}` {id_kind}, score long"
    if not items.ids:
        return spark.createDataFrame([], schema)
    stored = spark.read.parquet(index["path"])
    counts = frequencies(stored, items)
    items.weights = np.asarray([weight(index["N"], int(c)) for c in counts], np.int64)
    given = spark.sparkContext.broadcast(items)  # ITEM_BLOCK items

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, blocks, kind = given.value, [], None
        for batch in batches:
            for i in range(batch.num_rows):
                m, ids, names, *arrays = (batch.column(c)[i] for c in range(7))
                kind = ids.values.type
                blocks.append(Block(m.as_py(), ids.values, names.values, *(a.values.to_numpy() for a in arrays), own))
        if blocks:
            found = list(visit(blocks, own, k))
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], kind), pa.array([f[2] for f in found], pa.int64())],
                names=["place", "id", "score"],
            )

    found = stored.select("m", "ids", "terms", "run_term", "run_tf", "starts", "at").mapInArrow(run, f"place int, id {id_kind}, score long")
    order = Window.partitionBy("place").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = spark.createDataFrame(list(enumerate(items.ids)), f"of int, item {item_kind}")
    out = ranked.join(F.broadcast(names), F.col("place") == F.col("of"))  # a block of items
    return out.select(F.col("item").alias(item), "rank", F.col("id").alias(key), "score")


def search_all(docs: DataFrame, queries: DataFrame, item: str = "item_id", key: str = "doc_id", text: str = "text",
               k: int = TOP, item_block: int = ITEM_BLOCK) -> DataFrame:
    """The k best documents of every item, block by block of the items."""
    spark = docs.sparkSession
    index = build(docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")), key, text)
    kinds = docs.schema[key].dataType.simpleString(), queries.schema[item].dataType.simpleString()
    rows, found = queries.select(F.col(f"`{item}`"), F.col(f"`{text}`")).toLocalIterator(), None
    while (texts := [tuple(r) for r in islice(rows, item_block)]) or found is None:
        own = search(index, texts, spark, *kinds, item=item, key=key, k=k)
        found = own if found is None else found.unionByName(own)
        if not texts:
            break
    return found


def search_query(spark, sf_dir: str) -> DataFrame:
    return search_all(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
