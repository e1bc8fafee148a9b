"""Secret scans with character Markov models, native.

Three base rules find assignments, access keys and long hexadecimal runs. The
method adds runs of key characters that look random: two first-order Markov
models over characters, one of random strings and one of ordinary identifiers,
are counted in Spark from labelled samples. A run is a secret when its
log-likelihood ratio is above ``evidence`` + ``rate`` for each transition,
whatever kinds of characters it has; so a short run needs more of each transition
than a long one. A character that repeats counts once. Runs of fewer than
``LEAST_RUN`` characters are left alone. A run that lies in a base span adds
nothing; one that reaches out of it is a span of its own, and redaction joins the two.

Labelled samples: ``random_sample`` strings of hashed numbers in base 64 and
hexadecimal; and from about ``sample_docs`` documents without a base match (by a
hash below a share of the number of documents) their runs, as they are and joined
to names (camel, snake and kebab case, constants, paths, names with numbers),
with made dates and decimal numbers. Each distinct string counts once, where it lies; the
model is ALPHABET squared numbers, whatever the data.

Positions come from the pieces between matches: a split by the same pattern
gives the gaps, and their lengths and the matches' add up to starts. They are
code points, ends exclusive. Runs are judged first, once each, and only the
random-looking ones are looked for again.

Defined cases: null and empty texts have no spans; repeated rows are scanned
alike; ``scan`` replaces extra columns that have a result's name, the stage keeps
them; an empty table gives an empty result (the model then rests on made strings alone).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalspark.llm.common import free_name, set_aside, table, whole_text

# The base rules.
ASSIGN = (
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "markov")
LEAST_VALUE = 8

KEY = "A-Za-z0-9+/_=-"
LEAST_RUN = 10
RUN = f"[{KEY}]{{{LEAST_RUN},}}"
#: Printable ASCII, from the space on; all else is the last symbol.
ALPHABET, FIRST = 96, 32
RANDOM_SAMPLE, SAMPLE_DOCS, EVIDENCE, RATE = 20_000, 5_000, 10.0, 0.75
RESULT = ("n_assign", "n_access", "n_hex", "n_markov", "base_sha256", "spans", "found")


def symbol(c: Column) -> Column:
    code = F.ascii(c) - FIRST
    return F.when((code >= 0) & (code < ALPHABET - 1), code).otherwise(ALPHABET - 1)


def transitions(strings: DataFrame) -> DataFrame:
    """(cell, count) of a column ``s``: cell = symbol * ALPHABET + next."""
    cell = lambda i: symbol(F.substr("s", i, F.lit(1))) * ALPHABET + symbol(F.substr("s", i + 1, F.lit(1)))
    cells = F.transform(F.sequence(F.lit(1), F.length("s") - 1), cell)
    return strings.where(F.length("s") > 1).select(F.explode(cells).alias("cell")).groupBy("cell").count()


def train(spark: SparkSession, random: DataFrame, ordinary: DataFrame) -> list[float]:
    """Log-likelihood ratio of each transition (add-one smoothing), from two
    frames with a string column ``s``."""
    import numpy as np

    logs = []
    for sample in (random.distinct(), ordinary.distinct()):
        seen = np.ones(ALPHABET * ALPHABET)
        for row in transitions(sample).collect():  # at most ALPHABET ** 2 rows
            seen[row["cell"]] += row["count"]
        seen = seen.reshape(ALPHABET, ALPHABET)
        logs.append(np.log(seen / seen.sum(1, keepdims=True)))
    return (logs[0] - logs[1]).ravel().round(6).tolist()


def samples(docs: DataFrame, text: str, key: str, random_sample: int, sample_docs: int) -> tuple[DataFrame, DataFrame]:
    spark = docs.sparkSession
    digest = F.sha2(F.col("id").cast("string"), 256)
    random = spark.range(random_sample).select(
        F.when(F.col("id") % 4 == 0, F.substring(digest, 1, 40))
        .otherwise(F.regexp_replace(F.base64(F.unhex(digest)), "=", ""))
        .alias("s")
    )
    clean = docs.select(F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`")).alias("h"), whole_text(f"`{text}`").alias("t"))
    n = docs.count()
    if sample_docs < n:
        clean = clean.where(F.col("h") < int(2**64 * (sample_docs / n)) - 2**63)
    clean = clean.where(~(F.col("t").rlike(ASSIGN) | F.col("t").rlike(ACCESS) | F.col("t").rlike(HEX)))
    pieces = clean.select(F.regexp_extract_all("t", F.lit(f"[{KEY}]{{2,}}"), F.lit(0)).alias("w"))
    number = F.abs(F.xxhash64("id")).cast("string")
    made = spark.range(random_sample // 4).select(
        F.when(F.col("id") % 2 == 0, F.substr(number, F.lit(1), (F.lit(4) + F.col("id") % 13).cast("int")))
        .otherwise(F.date_format(F.date_add(F.lit("1990-01-01"), (F.col("id") % 20_000).cast("int")), "yyyy-MM-dd"))
        .alias("s")
    )
    plain = pieces.select(F.explode("w").alias("s"))
    names = pieces.select(F.explode(identifiers(F.col("w"))).alias("s"))
    return random, plain.unionByName(names).unionByName(made)


def identifiers(w: Column) -> Column:
    """Names as programs and paths have them, of every three words in turn."""
    small = F.filter(F.transform(w, F.lower), lambda x: x.rlike("^[a-z]+$"))

    def name(v: Column, i: Column) -> Column:
        a, b, c = (F.get(v, i * 3 + k) for k in range(3))
        forms = [
            F.concat(a, F.initcap(b), F.initcap(c)),
            F.concat(F.initcap(a), F.initcap(b), F.initcap(c)),
            F.concat_ws("_", a, b, c),
            F.concat_ws("-", a, b, c),
            F.upper(F.concat_ws("_", a, b, c)),
            F.concat(F.lit("/"), a, F.lit("/"), b, F.lit("/"), c),
            F.concat(a, F.lit("_"), b, (i % 100).cast("string")),
            F.concat(a, (i % 10).cast("string"), F.lit("/"), b, F.lit("="), c),
        ]
        chosen = forms[-1]
        for k, form in enumerate(forms[:-1]):
            chosen = F.when(i % len(forms) == k, form).otherwise(chosen)
        return chosen

    def of(v: Column) -> Column:
        groups = F.floor(F.size(v) / 3).cast("int")
        return F.when(groups > 0, F.transform(F.sequence(F.lit(0), groups - 1), lambda i: name(v, i)))

    return F.transform(F.array(small), of)[0]


def spans_of(text: Column, pattern: str | Column, kind: int) -> Column:
    """array<struct<start, kind, end>> of the matches of ``pattern`` (null: none);
    with group 2 of the assignment rule, shorter values are dropped."""
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,ok:boolean>>")
    sought = F.lit(pattern) if isinstance(pattern, str) else pattern
    found = F.regexp_extract_all(text, sought, F.lit(0))
    gaps = F.split(text, sought)
    ok = F.lit(True) if kind else None

    def of(pair: Column) -> Column:
        def step(acc: Column, m: Column) -> Column:
            at, i, out = acc["at"], acc["i"], acc["out"]
            start = (at + F.length(F.get(pair["gaps"], i))).cast("int")
            end = (start + F.length(m)).cast("int")
            good = ok if ok is not None else F.length(F.regexp_extract(m, pattern, 2)) >= LEAST_VALUE
            one = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), good.alias("ok"))
            return F.struct(end.alias("at"), (i + 1).cast("int").alias("i"), F.concat(out, F.array(one)).alias("out"))

        zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), empty.alias("out"))
        return F.filter(F.aggregate(pair["found"], zero, step)["out"], lambda x: x["ok"])

    pair = F.array(F.struct(found.alias("found"), gaps.alias("gaps")))
    return F.when(F.rlike(text, sought), F.transform(pair, of)[0]).otherwise(empty)


def scan(docs: DataFrame, ratios: list[float], text: str = "text", evidence: float = EVIDENCE, rate: float = RATE) -> DataFrame:
    """Add the counts, ``base_sha256``, ``spans`` (as text) and ``found``, an
    array of (start, kind, end); kind is the rank in KINDS."""
    docs = docs.drop(*[c for c in docs.columns if c in RESULT])
    base, body, extra, suspect = (free_name(docs, n) for n in ("_base", "_body", "_extra", "_suspect"))
    df = docs.withColumn(body, whole_text(text))
    order = lambda *parts: F.sort_array(F.concat(*parts))
    df = df.withColumn(base, order(*[spans_of(F.col(body), p, k) for k, p in enumerate((ASSIGN, ACCESS, HEX))]))
    # foldable, so every task holds the numbers once
    table_ = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<double>")

    def random_looking(run: Column) -> Column:
        codes = F.transform(F.split(F.regexp_replace(run, r"(.)\1+", "$1"), ""), symbol)

        def total(c: Column) -> Column:
            # each symbol with the one before it
            steps = F.transform(c, lambda x, i: F.coalesce(F.get(table_, F.get(c, i - 1) * ALPHABET + x), F.lit(0.0)))
            return F.aggregate(steps, F.lit(0.0), lambda a, x: a + x)

        return F.transform(F.array(codes), total)[0] > evidence + rate * (F.size(codes) - 1)

    runs = F.array_distinct(F.regexp_extract_all(F.col(body), F.lit(RUN), F.lit(0)))
    df = df.withColumn(suspect, F.filter(runs, random_looking))
    escaped = F.replace(F.array_join(F.col(suspect), "|"), F.lit("+"), F.lit(r"\+"))
    sought = F.when(F.size(suspect) > 0, F.concat(F.lit(f"(?<![{KEY}])(?:"), escaped, F.lit(f")(?![{KEY}])")))
    free = lambda x: ~F.exists(F.col(base), lambda b: (b["start"] <= x["start"]) & (x["end"] <= b["end"]))
    df = df.withColumn(extra, F.filter(spans_of(F.col(body), sought, 3), free))
    as_text = lambda spans: F.array_join(
        F.transform(
            spans,
            lambda x: F.concat_ws(
                ":", F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string")
            ),
        ),
        ",",
    )
    count = lambda k: F.size(F.filter(F.col(base), lambda x: x["kind"] == k)).cast("long")
    df = df.withColumn("found", order(F.col(base), F.col(extra)))
    df = df.withColumns(
        {f"n_{KINDS[k]}": count(k) for k in range(3)}
        | {
            "n_markov": F.size(F.col(extra)).cast("long"),
            "base_sha256": F.sha2(as_text(F.col(base)), 256),
            "spans": as_text(F.col("found")),
        }
    )
    return df.drop(base, body, extra, suspect)


def model(docs: DataFrame, text: str = "text", key: str = "doc_id") -> list[float]:
    return train(docs.sparkSession, *samples(docs, text, key, RANDOM_SAMPLE, SAMPLE_DOCS))


def secrets_query(spark, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(documents, model(documents))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_markov")


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The text with every span of ``found`` replaced by ``mark``; overlapping
    spans become one mark."""

    def of(body: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            begin = F.greatest(x["start"], acc["at"])
            part = F.concat(F.substr(body, acc["at"] + 1, F.greatest(begin - acc["at"], F.lit(0))), F.lit(mark))
            out = F.when(x["end"] <= acc["at"], acc["out"]).when(
                x["start"] < acc["at"], acc["out"]
            ).otherwise(F.concat(acc["out"], part))
            return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), out.alias("out"))

        zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
        done = lambda acc: F.concat(acc["out"], F.substr(body, acc["at"] + 1, F.length(body)))
        return F.aggregate(F.col("found"), zero, step, done)

    body = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn(text, F.when(F.size("found") > 0, of(body)).otherwise(F.col(text)))


def secrets_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; its secrets are replaced by a mark."""
    own, back = set_aside(docs, RESULT)
    done = redact(scan(own, model(docs)))
    return done.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("long")).select(back)
