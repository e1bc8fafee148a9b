import hashlib
import random

from vitalspark.operators import dense_index, sample_keys, sample_rows


def _expected_sample(ids, k, seed):
    ranked = sorted(set(ids), key=lambda i: (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))
    return [(i, n + 1) for n, i in enumerate(ranked[:k])]


def test_sample_keys_is_seeded_hash_order(spark):
    ids = [random.Random(1).randint(10**9, 9 * 10**9) for _ in range(200)]
    df = spark.createDataFrame([(i,) for i in ids for _ in range(3)], "Id long")
    got = sorted((r.Id, r.SampleRank) for r in sample_keys(df, "Id", 4, 12).collect())
    assert got == sorted(_expected_sample(ids, 4, 12))


def test_sample_independent_of_partitioning_and_order(spark):
    ids = list(range(1000, 1300))
    df = spark.createDataFrame([(i,) for i in ids], "Id long")
    a = sample_keys(df.repartition(7), "Id", 5, 99).collect()
    b = sample_keys(df.orderBy("Id", ascending=False).coalesce(1), "Id", 5, 99).collect()
    assert sorted(a) == sorted(b)


def test_sample_fewer_keys_than_k_and_nulls(spark):
    df = spark.createDataFrame([(1,), (2,), (None,), (2,)], "Id long")
    got = sample_keys(df, "Id", 4, 12).collect()
    assert sorted(r.Id for r in got) == [1, 2] and sorted(r.SampleRank for r in got) == [1, 2]


def test_sample_rows_keeps_rank(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d")], "Id long, v string")
    picked = spark.createDataFrame([(1, 2), (3, 1)], "Id long, SampleRank int")
    assert sorted((r.Id, r.v, r.SampleRank) for r in sample_rows(df, picked).collect()) == [
        (1, "a", 2),
        (1, "b", 2),
        (3, "d", 1),
    ]


def test_dense_index_matches_sorted_rank(spark):
    rnd = random.Random(5)
    ids = [rnd.randint(-(10**12), 10**12) for _ in range(3000)]
    data = [(i, float(n)) for n, i in enumerate(ids)] + [(ids[0], -1.0), (None, 0.0)]
    df = spark.createDataFrame(data, "Id long, v double").repartition(5)
    out = dense_index(df, "Id", "Id_Consecutive", num_partitions=6).collect()
    rank = {i: n + 1 for n, i in enumerate(sorted(set(ids)))}
    assert len(out) == len(data)
    for r in out:
        assert r.Id_Consecutive == (rank[r.Id] if r.Id is not None else None)


def test_dense_index_empty(spark):
    df = spark.createDataFrame([], "Id long, v double")
    assert dense_index(df).count() == 0


def test_sample_broadcast_is_proven_by_the_limit(spark):
    from vitalspark.operators import static_max_rows

    df = spark.createDataFrame([(i,) for i in range(50)], "Id long")
    assert static_max_rows(sample_keys(df, "Id", 4, 1)) == 4
    assert static_max_rows(spark.read.parquet("/root/testdata/sf0.001/events.parquet")) is None
