"""Keys and names that no sample holds, and stages over columns that clash."""

import random
import string

import pytest

from vitalspark.llm import ngram_join, quality, secrets

NAMES = """CamelCaseVeryLongClassNameFactoryBean AbstractSingletonProxyFactoryBean getElementsByTagName
/usr/local/lib/python3 /var/log/nginx/access /home/user/documents/report max_connections_per_host
MAXIMUM_TRANSFER_UNIT content-security-policy state-of-the-art internationalization
x-forwarded-for org/apache/commons/lang3 spark_sql_shuffle_partitions utf8_general_ci
2024-01-31 20240131123456 1700000000000 +44-20-7946-0958 user_id=12345 page=2 Donaudampfschifffahrtsgesellschaft
anticonstitutionnellement electroencefalografista HTTPServletRequestWrapper background-color
AAAAAAAAAAAAAAAAAAAAAAAAAAAAAA ------------------------------ ______________________________ ==============================""".split()

# Not seen when the thresholds were set.
OTHERS = """PropertyPlaceholderConfigurer /etc/systemd/system/multi-user TransactionAwareDataSourceProxy
kubernetes-dashboard-certs java/util/concurrent/locks ERR_CONNECTION_REFUSED mail_from_address_list
Geschwindigkeitsbegrenzung desoxyribonucleico jquery-3/dist/jquery numberOfRowsInSection viewDidLoadWithOptions
2023-12-24/2024-01-06 order_id=987654321 InternationalizationConfigurer git-upload-pack/refs/heads
application/x-www-form-urlencoded zookeeper_session_timeout_ms DEFAULT_BUFFER_SIZE_BYTES re-establishment""".split()


def keys(number: int, sizes, letters: str, seed: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.choice(sizes))) for _ in range(number)]


@pytest.fixture(scope="module")
def ratios(spark):
    return secrets.model(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def found(spark, ratios, strings):
    docs = spark.createDataFrame([(i, f"see {s} there") for i, s in enumerate(strings)], "doc_id long, text string")
    return {strings[r["doc_id"]] for r in secrets.scan(docs, ratios).where("n_markov > 0").collect()}


def test_held_out_keys_are_found(spark, ratios):
    mixed = string.ascii_letters + string.digits
    cases = [((10, 11), mixed, 0.8), ((15, 16), mixed, 0.95), ((20, 24), mixed, 0.95), ((32, 40), mixed, 0.99)]
    cases += [((16, 24), "0123456789abcdef", 0.85), ((24, 32), string.ascii_lowercase, 0.85)]
    for sizes, letters, least in cases:
        sought = keys(300, sizes, letters, sizes[0])
        share = len(found(spark, ratios, sought)) / len(sought)
        print(f"keys of {sizes}, {len(letters)} letters: {share:.3f}")
        assert share >= least


def test_names_paths_and_numbers_are_left(spark, ratios):
    wrong = found(spark, ratios, NAMES)
    print("names taken for keys:", wrong)
    assert not wrong
    others = found(spark, ratios, OTHERS)
    print("others taken for keys:", others)
    assert len(others) <= len(OTHERS) // 10


def test_repeated_and_touching_runs_have_their_own_places(spark, ratios):
    key = keys(1, (30,), string.ascii_letters + string.digits, 5)[0] + "+/"
    text = f"é {key} a {key}. {key}x ({key})"
    row = secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), ratios).collect()[0]
    at, spans = 0, []
    for shown in (key, key, key + "x", key):
        at = text.index(shown, at)
        spans.append(f"markov:{at}:{at + len(shown)}")
        at += len(shown)
    assert row["spans"] == ",".join(spans)


@pytest.mark.parametrize("stage", [quality.quality_stage, secrets.secrets_stage, ngram_join.near_stage])
def test_stages_keep_columns_that_clash(spark, stage):
    own = [*quality.RESULT, "spans", "found", "N_Markov", "base_sha256", "a.b"]
    own = [c for c in own if c not in ("n_words",)] + ["n_words"]
    text = "The quick brown fox jumps over the lazy dog near the old river bank today."
    values = ["mine"] * (len(own) - 1) + ["7"]
    columns = ["doc_id", "text", "n_chars", *own]
    docs = spark.createDataFrame([(1, text, 3, *values)], ", ".join(f"`{c}` {'long' if c in ('doc_id', 'n_chars') else 'string'}" for c in columns))
    out = stage(spark, docs, "")
    assert out.columns == columns
    row = out.collect()[0]
    assert [row[c] for c in own] == values and row["text"] == text
