"""Document fingerprints by consistent weighted sampling, native.

A document is its words, weighted by how often each occurs. It has ``SAMPLES``
samples, each drawn over all of its words: with r and c from gamma(2, 1) and b
uniform, all functions of the word's hash and the sample's index, t =
floor(ln(weight) / r + b) and the word with the least a = c * exp(-r * (t - b) -
r) is the sample (word, t). Two documents draw the same sample at an index with a
probability equal to the generalised Jaccard similarity of their weights, so the
share of equal positions estimates the similarity of the documents.

Draws are plain columns over one row a (text, distinct word, sample). Of the words of
a text, only those whose a may be below 40 / (the text's number of words) take a
logarithm and go on to the aggregation: the least a is above that less than once in
10**17 samples (the sample is then left out). They are told by bounds from below that cost
a square root, so of n words about 50 go on for a sample. ln a, in steps of 2**-23,
and 32 bits of a hash of (word, t) are one long, so the least of each sample is a
``min`` of longs; the rows of a document lie together already, so this aggregation
shuffles nothing.

The next document (in descending order of id, the first after the last) comes from
a window over ranges of (id, hash of the text); only one row a range crosses to its
neighbour. Texts are shuffled once, to their range.

Defined cases: null texts are empty; a text without words has the empty
fingerprint, is like another such text (1.0) and unlike the rest (0.0); rows of
equal id follow each other by a hash of their text, greatest first, so they and
null ids (which come last) are spread over ranges too; extra columns are ignored;
an empty table gives an empty result; a single document is its own next. Texts of
any length are whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalspark.llm.common import shared_path, table, whole_text, words

SAMPLES = 64
#: The least a of a text of total weight W is exponential with mean 1 / W, so it is
#: above SURE / W less than once in 10**17 samples.
SURE = 40.0
#: Documents of a range, and most ranges: with more documents ranges get longer.
RANGE_ROWS, MOST_RANGES = 500, 20_000


def hashes(text: Column) -> Column:
    """Array of the hashes of a text's words, ascending."""
    return F.sort_array(F.transform(words(text), lambda w: F.xxhash64(w)))


def starts(ordered: Column) -> Column:
    """-1 and the places at which a run of equal values of a sorted array begins."""
    return F.filter(
        F.sequence(F.lit(-1), F.size(ordered) - 1),
        lambda i: F.coalesce(F.get(ordered, i) != F.get(ordered, i - 1), F.lit(True)),
    )


def pairs(texts: DataFrame, keep: list[str], samples: int) -> DataFrame:
    """``keep``, h, weight, share and j: a row for each distinct word of ``texts``
    (``keep``, hashes) and sample j < ``samples``, with the word's hash and number, and
    SURE by the text's number of words. First a row a text with j -1 and no word.
    Arrays are columns before they are exploded, so that rows of words do not copy
    them; ``posexplode_outer``, as Spark would filter by the size of the array, and so
    make it twice, otherwise."""
    ordered, at = F.col("hashes"), F.col("at")
    runs = texts.select(*keep, "hashes", starts(ordered).alias("at"), (F.lit(SURE) / F.greatest(F.size(ordered), F.lit(1))).alias("share"))
    each = runs.select(*keep, "hashes", "at", "share", F.posexplode_outer("at").alias("k", "i"))
    weight = F.when(F.col("i") >= 0, F.coalesce(F.get(at, F.col("k") + 1), F.size(ordered)) - F.col("i"))
    terms = each.select(*keep, F.get(ordered, F.col("i")).alias("h"), weight.alias("weight"), "share")
    # both columns are asked for, so that they are made once a word and not once a sample
    first = F.col("h").isNull() | F.col("weight").isNull()
    return terms.select("*", F.explode(F.when(first, F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.lit(samples - 1)))).alias("j"))


def low(x: Column) -> Column:
    """The low 32 bits of a long."""
    return x.bitwiseAND(F.lit((1 << 32) - 1).cast("long"))


def only(rows: DataFrame, condition: Column) -> DataFrame:
    """``rows`` with the condition. Not a filter: Spark would move that below the
    columns it needs and make them twice."""
    once, never = F.array(F.lit(True)), F.array().cast("array<boolean>")
    return rows.select("*", F.explode(F.when(condition, once).otherwise(never)).alias("_kept")).drop("_kept")


def draws(terms: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and m, what a word (h, weight, share) offers for the sample j as a long:
    the less, the smaller its a; the low 32 bits are a hash of (word, t). Words whose a
    is surely above share are left out; a row without a word stays, with m null. One
    hash of (word, index) gives four 13-bit uniforms for r and c and 12 bits for b.
    Columns are made in steps, so that each logarithm is taken once.

    c * exp(-r) / weight is the least that a can be; for the weight 1 (t is 0) a is c *
    x ** s with x = exp(-r) and s = 1 - b. From below, x ** s is x / (s + (1 - s) * x),
    and nearer sqrt(x) ** (2 * s) by the same, with a whole sqrt(x) put aside if s is
    above a half; -ln(y) is 2 * (1 - y) / (1 + y), and nearer twice that of sqrt(y)."""
    unit = lambda at, n: (
        F.shiftrightunsigned("z", at).bitwiseAND(F.lit((1 << n) - 1).cast("long")).cast("double") + F.lit(0.5)
    ) * F.lit(2.0**-n)
    x, y, b, weight = (F.col(name) for name in ("x", "y", "b", "weight"))
    one, two = F.lit(1.0), F.lit(2.0)
    drawn = terms.select("*", F.xxhash64("h", "j").alias("z")).select(
        *keep, "h", "weight", "share", (unit(51, 13) * unit(38, 13)).alias("x"), (unit(25, 13) * unit(12, 13)).alias("y"), unit(0, 12).alias("b")
    )
    cap = weight * F.col("share")
    single = weight == 1
    near = two * (one - y) * x <= cap * (one + y) * F.when(single, one - b + b * x).otherwise(one)
    root, twice = F.sqrt(x), two * (one - b)
    power = F.when(~single, x).when(twice < one, root / (twice + (one - twice) * root)).otherwise(x / (twice - one + (two - twice) * root))
    nearer = F.lit(4.0) * (one - F.sqrt(y)) * power <= cap * (one + F.sqrt(y))
    logs = only(drawn, F.col("h").isNull() | (near & nearer)).select(
        *keep, "h", "b", F.when(single, F.lit(0.0)).otherwise(F.log(weight.cast("double"))).alias("lw"), (-F.log(x)).alias("r"), F.log(-F.log(y)).alias("c")
    )
    r, t = F.col("r"), F.col("t")
    whole = logs.select("*", F.floor(F.col("lw") / r + b).alias("t"))
    log_a = F.col("c") - r * (t - b + one)
    # ln a lies within +-128 for any weight below e**16
    steps = F.greatest(F.least((log_a + F.lit(128.0)) * F.lit(2.0**23), F.lit(2.0**31 - 1)), F.lit(0.0)).cast("long")
    code = low(F.col("h").bitwiseXOR(t * F.lit(2654435761)))
    return whole.select(*keep, F.shiftleft(steps, 32).bitwiseOR(code).alias("m"))


def likeness(a: Column, b: Column) -> Column:
    """Share of the positions with equal samples."""
    equal = F.size(F.filter(F.arrays_zip(a.alias("x"), b.alias("y")), lambda p: p["x"] == p["y"]))
    n = F.greatest(F.size(a), F.size(b))
    return F.when(n == 0, F.lit(1.0)).otherwise(equal / n)


def in_ranges(docs: DataFrame) -> DataFrame:
    """``docs`` (id, text) with ``h`` and ``part``: the number of their range of
    (id, h), ascending; null ids are least."""
    thin = docs.select("id", F.xxhash64("text").alias("h"))
    n = thin.count()
    ranges = max(1, min(MOST_RANGES, n // RANGE_ROWS))
    dealt = thin.repartitionByRange(ranges, "id", "h").groupBy(F.spark_partition_id().alias("p"))
    edges = [tuple(r["e"]) for r in dealt.agg(F.min(F.struct("id", "h")).alias("e")).collect()]  # one a range
    spread = docs.withColumn("h", F.xxhash64("text"))
    if len(edges) < 2:
        return spread.withColumn("part", F.lit(0))
    kind = docs.schema["id"].dataType
    null_first = lambda e: (e[0] is not None, e[0] if e[0] is not None else 0, e[1])
    edges = sorted(set(edges), key=null_first)[1:]
    # two levels, so that a row meets about twice the root of the number of edges
    width = max(1, int(len(edges) ** 0.5))
    literal = lambda e: F.struct(F.lit(e[0]).cast(kind).alias("id"), F.lit(e[1]).cast("long").alias("h"))
    groups = [F.array(*[literal(e) for e in edges[a : a + width]]) for a in range(0, len(edges), width)]
    firsts = F.array(*[literal(e) for e in edges[::width]])
    own = F.struct("id", "h")
    above = lambda points: F.size(F.filter(points, lambda e: e <= own))
    coarse = above(firsts)
    part = F.when(coarse == 0, F.lit(0)).otherwise((coarse - 1) * width + above(F.get(F.array(*groups), coarse - 1)))
    return spread.withColumn("part", part)


def with_next(docs: DataFrame) -> DataFrame:
    """(part, idx, id, text, after): rows by their place in their range, with the
    text of the next document in descending order."""
    placed = in_ranges(docs)
    order = [F.col("id").desc_nulls_last(), F.col("h").desc(), F.col("text").desc()]
    window = Window.partitionBy("part").orderBy(*order)
    followed = placed.select("part", F.row_number().over(window).alias("idx"), "id", "text", F.lead("text").over(window).alias("later"))
    # one row a range: the first of the range that follows
    top = placed.select("part", "id", "h").groupBy("part").agg(F.max(F.struct("id", "h")).alias("top"))
    keys = top.select(F.col("part").alias("of"), F.col("top.id").alias("tid"), F.col("top.h").alias("th"))
    at = (F.col("part") == F.col("of")) & F.col("id").eqNullSafe(F.col("tid")) & (F.col("h") == F.col("th"))
    heads = placed.join(F.broadcast(keys), at).groupBy("of").agg(F.max("text").alias("head"))  # MOST_RANGES rows
    over = Window.orderBy(F.col("part").desc())
    nexts = top.select("part", F.coalesce(F.lead("part").over(over), F.first("part").over(over)).alias("of"))
    heads = nexts.join(heads, "of").select(F.col("part").alias("part_"), "head")
    out = followed.join(heads, F.col("part") == F.col("part_"))
    return out.select("part", "idx", "id", "text", F.coalesce("later", "head").alias("after"))


def edited(text: Column, following: Column) -> Column:
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substr(text, F.lit(1), n - half), F.substr(following, F.lit(1), half))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next)."""
    spark = docs.sparkSession
    rows = with_next(docs.select(F.col(f"`{key}`").alias("id"), whole_text(f"`{text}`").alias("text")))
    made = rows.select("part", "idx", "id", "text", edited(F.col("text"), F.col("after")).alias("made"))
    sides = F.array(
        F.struct(F.lit(0).alias("side"), F.col("text").alias("t"), F.lit(None).cast(rows.schema["id"].dataType).alias("id"),
                 F.lit(None).cast("long").alias("n_chars"), F.lit(None).cast("string").alias("sha")),
        F.struct(F.lit(1).alias("side"), F.col("made").alias("t"), F.col("id").alias("id"),
                 F.length("text").cast("long").alias("n_chars"), F.sha2("made", 256).alias("sha")),
    )
    both = made.select("part", "idx", F.explode(sides).alias("s")).select("part", "idx", "s.*")
    of = ["part", "idx", "side", "id", "n_chars", "sha"]
    spread = pairs(both.select(*of, hashes(F.col("t")).alias("hashes")), of, samples)
    # a sample's place; what a document has once goes with the row without a word
    first = F.col("j") < 0
    place = F.when(first, F.lit(-1)).otherwise(F.col("side") * F.lit(samples) + F.col("j")).alias("place")
    once = lambda c: F.when(first, F.col(c)).alias(c)
    keys = ["part", "idx", "place", "id", "n_chars", "sha"]
    spread = spread.select("part", "idx", place, once("id"), once("n_chars"), once("sha"), "j", "h", "weight", "share")
    least = draws(spread, keys).groupBy(*keys).agg(F.min("m").alias("m"))
    sample = F.shiftleft(F.col("place").cast("long"), 32).bitwiseOR(low(F.col("m")))  # null without a word
    whole = least.groupBy("part", "idx").agg(
        F.max("id").alias("id"), F.max("n_chars").alias("n_chars"), F.max("sha").alias("sha"), F.collect_list(sample).alias("found")
    ).withColumn("found", F.sort_array("found"))
    code = lambda x: F.lower(F.substring(F.lpad(F.hex(x), 16, "0"), 9, 8))
    later = lambda x: x >= F.lit(samples << 32)
    side = lambda n: F.transform(F.filter("found", later if n else lambda x: ~later(x)), code)
    path = shared_path(spark, "fingerprints")
    whole.select("part", "idx", "id", "n_chars", "sha", side(0).alias("fp"), side(1).alias("ef")).write.parquet(path)
    stored = spark.read.parquet(path)
    # the next document's fingerprint, by place: thin rows
    window = Window.partitionBy("part").orderBy("idx")
    here = stored.withColumn("later", F.lead("fp").over(window))
    tops = stored.where("idx = 1").select("part", F.col("fp").alias("head"))
    over = Window.orderBy(F.col("part").desc())
    nexts = tops.select("part", F.coalesce(F.lead("head").over(over), F.first("head").over(over)).alias("head"))
    out = here.join(nexts, "part").withColumn("next", F.coalesce("later", "head"))
    return out.select(
        F.col("id").alias(key),
        "n_chars",
        F.col("sha").alias("edited_sha256"),
        F.array_join("fp", " ").alias("fingerprint"),
        F.array_join("ef", " ").alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("ef")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next")).alias("near_next"),
    )


def fingerprint_query(spark, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
