"""Centroid clustering, lexical search and line dedup against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from vitalspark.llm import centroids, lexical, line_dedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- centroid clustering -----------------------------------------------------------


def brute_clusters(rows, dim, k, rounds, scale=64):
    kept = [(i, [math.floor(x * scale) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)[:k]
    centres = [v for _, v in first]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[near(v)[1]].append(v)
        for j, own in groups.items():
            centres[j] = [sum(c) // len(own) for c in zip(*own)]
    return sorted(((i is None, i or 0), near(v)[1], near(v)[0]) for i, v in kept), centres


@pytest.mark.parametrize("dim, k, rounds", [(20, 5, 3), (16, 1, 2), (33, 300, 1)])
def test_clusters_are_brute_force(spark, dim, k, rounds):
    rng = random.Random(dim)
    # floats that are exact in 32 bits, so both sides see equal values
    vec = lambda: [float(np.float32(rng.gauss(0, 1))) for _ in range(dim)]
    rows = [(i, vec()) for i in range(200)]
    rows += [(7, rows[7][1]), (8, vec()), (None, vec()), (None, rows[3][1])]  # repeated and null ids
    rows += [(900 + i, rows[0][1]) for i in range(60)]  # ties: one vector many times
    odd = [(1000, None), (1001, vec()[:-1]), (1002, [None, *vec()[1:]]), (1003, [math.nan, *vec()[1:]]), (1004, [math.inf, *vec()[1:]]), (1005, [])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows + odd], "vec_id long, embedding array<float>, cluster string").repartition(3)
    found, centres = centroids.cluster(df, dim=dim, k=k, rounds=rounds)
    got = sorted(((r["vec_id"] is None, r["vec_id"] or 0), r["cluster"], r["distance"]) for r in found.collect())
    wanted, of = brute_clusters(rows, dim, k, rounds)
    assert got == wanted and centres.tolist() == of
    assert found.columns == ["vec_id", "cluster", "distance"]


def test_clusters_of_nothing_and_beyond_exact_sums(spark):
    kinds = "vec_id long, embedding array<float>"
    found, centres = centroids.cluster(spark.createDataFrame([], kinds), dim=3)
    assert found.count() == 0 and len(centres) == 0
    with pytest.raises(Exception, match="would not be exact"):
        centroids.cluster(spark.createDataFrame([(1, [1e9, 0.0, 0.0])], kinds), dim=3)
    with pytest.raises(ValueError):
        centroids.cluster(spark.createDataFrame([], kinds), dim=300)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("blocks_")]


# --- lexical search -------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_search(docs, items, k):
    bags = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, length = len(bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for i, bag in bags:
            m = 100 - 25 + (25 * bag.total() * n_docs) // length
            s = 0
            for t in TERM.findall((text or "").translate(LOWER)):
                if bag[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    s += w * ((1_000_000_000 * bag[t]) // (1000 * bag[t] + 12 * m))
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "Éa", "x1", "naïve"]) if rng.random() < 0.4 else f"w{int(rng.expovariate(0.02))}" for _ in range(n))


def test_search_is_brute_force(spark):
    rng = random.Random(5)
    docs = [(i, prose(rng, rng.choice([1, 5, 30, 30, 30, 200]))) for i in range(400)]
    docs += [(None, docs[5][1]), (5, docs[5][1]), (401, None), (402, " -- "), (403, "The the THE\x85the　the."), (404, "rare " * 3000)]
    items = [(i, prose(rng, 12)) for i in range(25)] + [(90, "rare the the The"), (91, None), (92, "!!"), (93, "nowhere"), (None, "rare w1")]
    left = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, score int").repartition(4)
    asked = spark.createDataFrame(items, "item_id long, text string")
    for block in (2_000, 7):  # items in one block and in several
        found = lexical.search_all(left, asked, k=6, item_block=block)
        got = sorted(((r["item_id"] is None, r["item_id"] or 0), r["rank"], (r["doc_id"] is None, r["doc_id"] or 0), r["score"]) for r in found.collect())
        wanted = sorted(((i is None, i or 0), rank, (d is None, d or 0), s) for i, rank, d, s in brute_search(docs, [x for x in items if x[0] is not None], 6))
        wanted = sorted(wanted + [((True, 0), rank, (d is None, d or 0), s) for _, rank, d, s in brute_search(docs, [(0, "rare w1")], 6)])
        assert got == wanted


def test_search_over_split_strata_and_empty_tables(spark):
    # equal lengths: one stratum, cut into several tasks
    docs = [(i, f"a b c{i % 7} d{i}") for i in range(500)]
    left, asked = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, "c3 d9 a")], "item_id long, text string")
    index = lexical.build(left, task_tokens=300)
    assert spark.read.parquet(index["path"]).count() == 7
    found = lexical.search(index, [(1, "c3 d9 a")], spark, "bigint", "bigint")
    assert sorted(tuple(r) for r in found.collect()) == brute_search(docs, [(1, "c3 d9 a")], 20)
    assert lexical.search_all(left.where("false"), asked).count() == 0
    assert lexical.search_all(left, asked.where("false")).count() == 0


def test_bounds_leave_blocks_unvisited(spark):
    docs = [(i, " ".join(["hit"] * (1 + i % 3) + ["pad"] * (5 + i // 10))) for i in range(300)]
    index = lexical.build(spark.createDataFrame(docs, "doc_id long, text string"), task_tokens=10**9)
    items = lexical.Items([(1, "hit")])
    items.weights[:] = lexical.weight(index["N"], 300)
    rows = spark.read.parquet(index["path"]).toArrow().to_batches()
    blocks = [
        lexical.Block(b.column("m")[i].as_py(), b.column("ids")[i].values, b.column("terms")[i].values,
                      *(b.column(c)[i].values.to_numpy() for c in ("run_term", "run_tf", "starts", "at")), items)
        for b in rows for i in range(b.num_rows)
    ]
    counts = Counter()
    best = list(lexical.visit(blocks, items, 5, counts))
    assert len(blocks) > 10 and counts["visited"] < len(blocks) / 2
    everything = sorted(((-int(s), blocks[b].ids[j].as_py()) for b in range(len(blocks)) for j, s in enumerate(blocks[b].scores(items.terms[0], items.often[0]))))
    assert [(-s, d) for _, d, s in best] == everything[:5]


# --- line dedup --------------------------------------------------------------------------


def brute_lines(docs, min_chars=20, min_docs=3):
    key = lambda line: line.strip(" \t\n\v\f\r").translate(LOWER)
    order = lambda i: (i is not None, i or 0)
    held = defaultdict(set)
    for i, t in docs:
        for line in (t or "").split("\n"):
            held[key(line)].add(i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        gone = [len(key(x)) >= min_chars and len(held[key(x)]) >= min_docs and i != max(held[key(x)], key=order) for x in lines]
        out.append((order(i), len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g)))
    return sorted(out)


def line_docs():
    rng = random.Random(3)
    common = [f"This line number {k} stands in many places" for k in range(30)]
    docs = []
    for i in range(300):
        lines = [rng.choice(common) if rng.random() < 0.2 else f"own line {i} {j} with enough characters" for j in range(rng.randint(0, 9))]
        lines += ["short"] * 2 + (["  A Licence Line that all Documents carry \t"] if i % 3 else ["a licence line THAT all documents carry"])
        rng.shuffle(lines)
        docs.append((i, "\n".join(lines)))
    twice = "two lines of this kind in one text only"
    docs += [(500, f"{twice}\n{twice}\n{twice}"), (501, twice), (502, ""), (503, None), (504, "\n\n"), (505, "é" * 19), (506, "é" * 19), (507, "é" * 19)]
    docs += [(510 + j, "ÉÀ" * 10 + f"\r\nÉà {j}") for j in range(3)] + [(520 + j, "ßü" * 10 + "\v") for j in range(3)]
    same = "null and equal ids share a line of text here"
    docs += [(None, same), (None, same + "\nmore of it"), (600, same), (600, same), (600, f"x\n{same}"), (601, same), (602, "\n".join([same] * 40_000))]
    docs += [(None, "only without ids, and that in several rows")] * 5
    return docs


@pytest.mark.parametrize("max_bits", [line_dedup.MAX_BITS, 1 << 12])
def test_lines_are_brute_force(spark, max_bits):
    docs = line_docs()
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, n_lines int").repartition(5)
    out = line_dedup.dedup_lines(df, max_bits=max_bits).collect()
    got = sorted(((r["doc_id"] is not None, r["doc_id"] or 0), r["n_lines"], r["n_dropped"], r["clean_text"]) for r in out)
    assert got == brute_lines(docs)


def test_filters_hold_every_repeat_and_few_others(spark):
    docs = line_docs()
    texts = spark.createDataFrame([(t,) for _, t in docs], "t string").repartition(6)
    bits = 1 << 16
    again = line_dedup.seen_again(texts, bits, 20)
    of = lambda t: {h for h in line_dedup.line_hashes((t or "").encode(), 20) if h}
    seen = Counter(h for _, t in docs for h in of(t))
    hit = lambda h: bool(line_dedup.is_set(again, line_dedup.positions(line_dedup.as_hashes([h]), bits).astype(np.int64)).all())
    assert all(hit(h) for h, n in seen.items() if n > 1)
    once = [h for h, n in seen.items() if n == 1]
    assert sum(map(hit, once)) < 0.02 * len(once)


def test_lines_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.dedup_lines(empty).count() == 0
