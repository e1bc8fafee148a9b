"""N-gram Jaccard self-join with a token-group matrix.

A document is the set of its distinct word n-grams, as 64-bit hashes. Equal sets
are one class, and only class representatives go on. Two sets with Jaccard
similarity s or more share one of the first n - ceil(s n) + 1 tokens of each
under any one order of all tokens (the probe), so no link is lost by looking
at probes only, and linked sets share a number of probe tokens (``needed``). The order puts tokens found
in many probes last, and those that documents with such probes share besides, so
passages that many documents share are rarely probed, and a near copy probes first
what only it has.

1. Stars: in each probed token and size band, documents are compared with one
   of their own (the pivot), in several rounds with other pivots: first with the
   one that has the fewest probes of its own. Linked
   documents form groups of similar documents.
2. Matrix: per probed token the groups that have it. A document looks its
   tokens up and gets the larger groups it may belong to; the group's token union
   bounds the overlap of all its members with the document, and groups below the
   bound stay closed.
3. Open: the members of the remaining groups that share a probed token and
   fit in size are compared; a group of one is its member, so it is no union.
   Pairs whose sketches (bits of all tokens) rule a link out are left.

Every comparison counts the shared tokens of the whole sets. Components of all
links follow. Pairs inside a group are never listed.

Defined cases: null or empty texts and texts of white space have the empty set
and no links; texts shorter than an n-gram have their whole sequence as one
token; rows of equal id are one document with the tokens of any of its texts linked; null ids get no component; extra columns are kept; an empty table gives an
empty result. Very long texts only have more tokens.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalspark.llm.common import table, whole_text, words
from vitalspark.llm.components import components, done, kept, stored

#: A token in more probes than this goes to the end of the order.
COMMON = 24
#: About as many documents of each such token are drawn by hash, and tokens that
#: as many of them as AMONG have go to the end too. Any order loses no link.
DRAWN, AMONG = 32, 8
STAR_ROUNDS = 2
#: Passes over documents whose order changes, and over the groups when their tokens
#: are compared with the asking documents.
PASSES = 2
#: Longs of a sketch, 64 bits each.
SKETCH = 32
#: Ids (one number each) that may be broadcast.
MAX_IDS = 2_000_000


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text: Column, n: int) -> Column:
    """Sorted distinct hashes of the word n-grams."""
    from vitalspark.llm.quality import let

    def of(w: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.xxhash64(F.slice(w, i, n)))
        return (
            F.when(F.size(w) == 0, F.array().cast("array<long>"))
            .when(F.size(w) < n, F.array(F.xxhash64(w)))
            .otherwise(F.sort_array(F.array_distinct(grams)))
        )

    return let(words(ascii_lower(text)), of)


def least_overlap(n: Column, percent: int) -> Column:
    """ceil(percent * n / 100): the overlap any partner needs."""
    return F.floor((n * percent + 99) / 100).cast("int")


def fits(n: Column, m: Column, percent: int) -> Column:
    return (F.lit(100) * F.least(n, m) >= F.lit(percent) * F.greatest(n, m))


def only(df: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows of ``df`` whose rid is in ``ids`` (``left_anti``: is not). ``ids`` is
    stored; up to MAX_IDS of them are broadcast, so that the sets stay where they
    lie, and beyond that the join is by a shuffle."""
    return df.join(F.broadcast(ids) if ids.count() <= MAX_IDS else ids, "rid", how)


def one_each(sets: DataFrame, classes: DataFrame, path: str) -> tuple[DataFrame, str]:
    """Those of ``sets`` (rid, toks, n), stored at ``path``, whose rid is in
    ``classes``, and the path they are read from. While the other ids are few enough
    to be broadcast, the sets stay where they lie."""
    copies = stored(sets.select("rid").join(classes.select("rid"), "rid", "left_anti").distinct(), "copies")
    if copies.count() <= MAX_IDS:
        return sets.join(F.broadcast(copies), "rid", "left_anti"), path
    ones, own = kept(only(sets, classes.select("rid")), "ones")
    done(sets.sparkSession, path)
    return ones, own


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The stored pairs (a, b) whose whole sets link."""
    ids = lambda c, name: stored(pairs.select(F.col(c).alias("rid")).distinct(), name)
    left = only(sets, ids("a", "left")).select(F.col("rid").alias("a"), F.col("toks").alias("ta"))
    right = only(sets, ids("b", "right")).select(F.col("rid").alias("b"), F.col("toks").alias("tb"))
    common = F.size(F.array_intersect("ta", "tb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", common.alias("x"), (F.size("ta") + F.size("tb")).alias("n"))
    return both.where(F.lit(100) * F.col("x") >= F.lit(percent) * (F.col("n") - F.col("x"))).select("a", "b")


def sketches(sets: DataFrame) -> DataFrame:
    """(rid, n, bits) of each set: a bit of ``SKETCH`` longs for every token. An id
    may have several sets, told apart by a hash."""
    named = sets.select("rid", "n", F.xxhash64("toks").alias("s"), "toks")
    tokens = named.select("rid", "n", "s", F.explode("toks").alias("t"))
    word = F.shiftright("t", 6).bitwiseAND(F.lit(SKETCH - 1)).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("t").bitwiseAND(F.lit(63)).cast("int"))
    longs = tokens.groupBy("rid", "n", "s", word.alias("w")).agg(F.bit_or(bit).alias("b"))
    whole = longs.groupBy("rid", "n", "s").agg(F.map_from_entries(F.collect_list(F.struct("w", "b"))).alias("of"))
    bits = F.transform(F.sequence(F.lit(0), F.lit(SKETCH - 1)), lambda w: F.coalesce(F.element_at("of", w), F.lit(0).cast("long")))
    return whole.select("rid", "n", bits.alias("bits"))


def may_link(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The stored pairs (a, b) whose sketches allow a link: a bit that only one has
    is of a token that only that one has, so the overlap is less by one."""
    ids = pairs.select(F.col("a").alias("rid")).union(pairs.select(F.col("b").alias("rid"))).distinct()
    made = stored(sketches(only(sets, stored(ids, "sketched"))), "sketches")
    of = lambda c, n, bits: made.select(F.col("rid").alias(c), F.col("n").alias(n), F.col("bits").alias(bits))
    both = pairs.join(of("a", "n", "x"), "a").join(of("b", "m", "y"), "b")

    def lacking(mine: str, other: str) -> Column:
        counts = F.zip_with(mine, other, lambda u, v: F.bit_count(u.bitwiseAND(F.bitwise_not(v))))
        return F.aggregate(counts, F.lit(0), lambda total, c: total + c)

    most = F.least(F.col("n") - lacking("x", "y"), F.col("m") - lacking("y", "x"))
    return both.where((100 + percent) * most >= percent * (F.col("n") + F.col("m"))).select("a", "b").distinct()


def linked_groups(links: DataFrame, hops: int = 3) -> DataFrame:
    """(rid, root): the smallest document within ``hops`` links, so a whole star
    gets one root wherever its pivot's id lies. All of a group are in one
    component; a component may have several."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    label = both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("m"))
    for _ in range(hops - 1):
        label = both.join(label.select(F.col("a").alias("b"), "m"), "b").groupBy("a").agg(F.min("m").alias("m"))
    return label.select(F.col("a").alias("rid"), F.col("m").alias("root"))


def needed(n: Column, m: Column, percent: int) -> Column:
    """Probe tokens that linked sets of ``n`` and ``m`` tokens share at least.
    Beyond the probes at most ceil(percent * max(n, m) / 100) - 1 tokens are
    shared, and a link shares percent / (100 + percent) of n + m."""
    whole = F.ceil((n + m) * percent / (100 + percent)).cast("int")
    return F.greatest(whole - least_overlap(F.greatest(n, m), percent) + 1, F.lit(1))


def needed_in(n: Column, low: Column, high: Column, percent: int) -> Column:
    """The least that is needed with a partner of ``low`` to ``high`` tokens: it
    rises up to n and falls after it, so one of the ends has it."""
    low = F.least(F.greatest(low, least_overlap(n, percent)), n)
    high = F.greatest(F.least(high, F.floor(n * 100 / percent).cast("int")), n)
    return F.least(needed(n, low, percent), needed(n, high, percent)) - 1  # one for rounding


def common_tokens(sets: DataFrame, length: Column) -> DataFrame:
    """(t), stored: the tokens in many first probes, and those that the documents
    with them share besides, which would be probed instead of them. The order is
    then one by frequency as far as it matters: what only one of a group of near
    copies has comes first."""
    first = sets.select("rid", F.explode(F.slice("toks", F.lit(1), length)).alias("t"))
    hot = stored(first.groupBy("t").count().where(F.col("count") > COMMON), "hot")
    share = F.pmod(F.xxhash64("rid", F.lit(-1)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    drawn = stored(first.join(hot, "t").where(share * F.col("count") < DRAWN).select("rid").distinct(), "drawn")
    theirs = only(sets, drawn).select(F.explode("toks").alias("t")).groupBy("t").count().where(F.col("count") >= AMONG)
    return stored(hot.select("t").union(theirs.select("t")).distinct(), "common")


def link_classes(sets: DataFrame, percent: int, path: str) -> DataFrame:
    """``sets`` (rid, toks, n), read from what is stored at ``path`` (deleted at the end),
    one of each distinct set -> (rid, root) of all in a link and not their own root."""
    band = F.floor(F.log(F.col("n").cast("double")) / -math.log(percent / 100)).cast("int")
    length = F.col("n") - least_overlap(F.col("n"), percent) + 1
    spark = sets.sparkSession
    common = common_tokens(sets, length)
    done(spark)
    # a document's common tokens go to the end of its order; at most its own size. One
    # with none of them among its first tokens has the same probes either way
    last = F.broadcast(common) if common.count() <= MAX_IDS else common
    met = lambda tokens: tokens.join(last, "t", "left_semi")
    first = sets.select("rid", F.explode(F.slice("toks", F.lit(1), length)).alias("t"))
    moving = stored(met(first).select("rid").distinct(), "moving")
    done(spark)
    late = met(only(sets, moving).select("rid", F.explode("toks").alias("t"))).groupBy("rid").agg(F.sort_array(F.collect_set("t")).alias("late"))
    late = stored(late, "late")
    done(spark)
    ordered = F.concat(F.array_except("toks", "late"), F.array_intersect("late", "toks"))
    others = late.select("rid")
    plain = only(sets, others, "left_anti").select("rid", "n", F.explode(F.slice("toks", F.lit(1), length)).alias("t"))
    moved, reordered = [], []
    for k in range(PASSES):  # this join moves whole sets, so only once and some at a time
        part = F.pmod(F.xxhash64("rid"), F.lit(PASSES)) == k
        some = only(sets.where(part), others.where(part)).join(late.where(part), "rid")
        some, at = kept(some.select("rid", "n", F.explode(F.slice(ordered, F.lit(1), length)).alias("t")), "moved")
        moved.append(some)
        reordered.append(at)
        done(spark)
    # only tokens that two documents probe: their hashes are told first, so that
    # the others are never stored
    probes = reduce(DataFrame.unionByName, [plain, *moved])
    twice = stored(probes.groupBy("t").agg(F.count("*").alias("c")).where("c > 1").select("t"), "twice")
    done(spark)
    probes, paired = kept(probes.join(twice, "t", "left_semi").withColumn("band", band), "paired")
    done(spark, *reordered)
    # a link shares ``needed`` probes, so documents with fewer shared ones have none;
    # partners are of a size that one of the tokens has
    sizes = probes.groupBy("t").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    able = probes.join(sizes, "t").groupBy("rid", "n").agg(F.count("*").alias("count"), F.min("low").alias("low"), F.max("high").alias("high"))
    able = able.where(F.col("count") >= needed_in(F.col("n"), F.col("low"), F.col("high"), percent))
    # how few of a document's probes nobody else has: least at the middle of near copies
    able = stored(able.groupBy("rid").agg(F.max(F.col("count") - length).cast("int").alias("mid")), "able")
    done(spark)
    probes, probed = kept(probes.join(F.broadcast(able) if able.count() <= MAX_IDS else able, "rid"), "probes")
    done(spark, paired)

    # 1. stars: a document meets the pivot of its own band and of the next. Pairs
    # that share too few of the pivot's tokens are left to the matrix.
    groups, links = None, None
    for k in range(STAR_ROUNDS):
        at = probes if groups is None else probes.join(groups, "rid", "left")
        group = F.col("rid") if groups is None else F.coalesce("root", "rid")
        at = at.select("rid", "n", "t", "band", "mid", group.alias("g"))
        # first the document with the fewest probes of its own, then any
        order = F.struct(-F.col("mid") if k == 0 else F.lit(0), F.xxhash64("rid", F.lit(k)))
        pivot = at.groupBy("t", "band").agg(F.min(F.struct(order, "rid", "n", "g")).alias("p")).select(
            "t", F.col("band").alias("pband"), F.col("p.rid").alias("prid"), F.col("p.n").alias("pn"), F.col("p.g").alias("pg")
        )
        meets = at.withColumn("pband", F.explode(F.array(F.col("band"), F.col("band") + 1))).join(pivot, ["t", "pband"])
        meets = meets.where((F.col("g") != F.col("pg")) & fits(F.col("n"), F.col("pn"), percent))
        pairs = meets.groupBy("rid", "n", "prid", "pn").count().where(F.col("count") >= needed(F.col("n"), F.col("pn"), percent))
        pairs = stored(pairs.select(F.least("rid", "prid").alias("a"), F.greatest("rid", "prid").alias("b")).distinct(), "pairs")
        done(spark)
        found = stored(verified(pairs, sets, percent), "found")
        done(spark)
        links = found if links is None else links.unionByName(found)
        groups = stored(linked_groups(links), "groups")
        done(spark)
    groups = stored(groups.join(groups.groupBy("root").agg(F.count("*").alias("z")), "root"), "sized")

    # 2. matrix of tokens and groups
    at = probes.join(groups, "rid", "left").select("rid", "n", "t", F.coalesce("root", "rid").alias("g"), F.coalesce("z", F.lit(1)).alias("z"))
    at, grouped = kept(at, "grouped")
    matrix = at.groupBy("t", "g").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("z").alias("oz"))
    spread = matrix.groupBy("t").agg(F.count("*").alias("c")).where("c > 1").select("t")
    matrix = matrix.join(spread, "t", "left_semi").withColumnRenamed("g", "og")
    # of two groups the smaller one's documents ask, so few ask a large group and
    # none of its many members asks the rest
    asking = F.struct("z", "g") < F.struct(F.col("oz").alias("z"), F.col("og").alias("g"))
    asks = (
        at.join(matrix, "t")
        .where(asking & (100 * F.col("high") >= percent * F.col("n")) & (100 * F.col("n") >= percent * F.col("low")))
        .groupBy("rid", "n", "og")
        .agg(F.count("*").alias("c"), F.min("low").alias("low"), F.max("high").alias("high"))
        .where(F.col("c") >= needed_in(F.col("n"), F.col("low"), F.col("high"), percent))
        .join(groups.select(F.col("root").alias("og"), F.lit(True).alias("several")).distinct(), "og", "left")
    )
    asks = stored(asks, "asks")
    done(spark)
    # a group of one is its member, of one size unless its id has several sets
    enough = (F.col("low") != F.col("high")) | (F.col("c") >= needed(F.col("n"), F.col("low"), percent))
    single = asks.where(F.col("several").isNull() & enough).select(F.col("rid").alias("a"), F.col("og").alias("b")).distinct()
    asks = asks.where("several").select("rid", "og").distinct()
    # the asked groups' members, by id
    wanted = stored(at.select("rid", F.col("g").alias("og")).distinct().join(asks.select("og").distinct(), "og", "left_semi"), "wanted")
    parts = []
    for k in range(PASSES):  # some groups at a time, so that fewer tokens lie on disk
        part = F.pmod(F.xxhash64("og"), F.lit(PASSES)) == k
        mine, ours = stored(asks.where(part), "asking"), stored(wanted.where(part), "members")
        members = only(sets, ours.select("rid").distinct()).join(ours, "rid")
        union = members.select("og", F.explode("toks").alias("t")).distinct()
        asked = only(sets, mine.select("rid").distinct()).join(mine, "rid").select("rid", "n", "og", F.explode("toks").alias("t"))
        overlap = asked.join(union, ["og", "t"]).groupBy("rid", "n", "og").count()
        parts.append(stored(overlap.where(F.col("count") >= least_overlap(F.col("n"), percent)).select("rid", "og"), "opened"))
        done(spark)
    opened = reduce(DataFrame.unionByName, parts)

    # 3. open the groups that qualify
    inside = at.select(F.col("rid").alias("other"), F.col("n").alias("m"), "t", F.col("g").alias("og"))
    pairs = (
        at.join(opened, "rid")
        .join(inside, ["t", "og"])
        .where(fits(F.col("n"), F.col("m"), percent))
        .groupBy(F.col("rid").alias("a"), "n", F.col("other").alias("b"), "m")
        .count()
        .where(F.col("count") >= needed(F.col("n"), F.col("m"), percent) - 1)
        .select("a", "b")
        .distinct()
    )
    pairs = stored(pairs.unionByName(single).distinct(), "pairs")
    done(spark)
    near = stored(may_link(pairs, sets, percent), "near")
    done(spark)
    last = stored(verified(near, sets, percent), "found")
    done(spark, path, probed, grouped)
    return components(links.unionByName(last)).select(F.col("node").alias("rid"), "root")


def similar(docs: DataFrame, n: int = 4, percent: int = 85, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component): the smallest id reachable by links. Sets are
    made once and stored; one of each class goes on."""
    rows = docs.select(F.col(f"`{key}`").alias("id"), shingles(whole_text(text), n).alias("toks"))
    rows, path = kept(rows.withColumn("n", F.size("toks")), "reps")
    signed = stored(rows.select("id", "n", F.xxhash64("toks").alias("s1"), F.hash("toks", F.lit(7)).alias("s2")), "signed")
    named = signed.where("n > 0 and id is not null")
    classes = stored(named.groupBy("n", "s1", "s2").agg(F.min("id").alias("rid")), "classes")
    named = rows.where("n > 0 and id is not null").select(F.col("id").alias("rid"), "toks", "n")
    reps, path = one_each(named, classes, path)
    roots = stored(link_classes(reps, percent, path), "roots")
    classes = classes.join(roots, "rid", "left").select("n", "s1", "s2", F.coalesce("root", "rid").alias("c"))
    out = signed.join(classes, ["n", "s1", "s2"], "left")
    return out.select(
        F.col("id").alias(key),
        F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("c")).otherwise(F.col("id")).alias("component_id"),
    )


def join_query(spark, sf_dir: str) -> DataFrame:
    return similar(table(spark, sf_dir, "documents").select("doc_id", "text"))


def near_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five words,
    similarity 0.8 or more. The groups are of texts, so rows without an id or
    with another's are no duplicates by that. The smallest id stays, null ids
    last, then the smallest hash of the text; among rows of one id and text the
    smallest other columns. Texts without words have no links and all stay."""
    n, percent = 5, 80
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("doc_id").alias("id"), whole_text().alias("t"))
    rows = rows.withColumn("h", F.xxhash64("t"))
    # the stored numbers only tell rows apart
    sets = rows.select(F.monotonically_increasing_id().alias("rid"), "id", "h", shingles(F.col("t"), n).alias("toks"))
    sets, path = kept(sets.withColumn("n", F.size("toks")).where("n > 0"), "reps")
    key = F.struct(F.col("id").isNull().alias("none"), "id", "h")
    signs = ["n", F.xxhash64("toks").alias("s1"), F.hash("toks", F.lit(7)).alias("s2")]
    first = sets.select(F.struct(key.alias("key"), "rid").alias("first"), *signs).groupBy("n", "s1", "s2").agg(F.min("first").alias("first"))
    classes = stored(first.select("first.rid", "first.key"), "classes")
    reps, path = one_each(sets.select("rid", "toks", "n"), classes, path)
    roots = stored(link_classes(reps, percent, path), "roots")
    stay = classes.join(roots, "rid", "left").groupBy(F.coalesce("root", "rid").alias("c")).agg(F.min("key").alias("key"))
    stay = stay.select(F.col("key.id").alias("kid"), F.col("key.h").alias("kh"))
    of_key = F.col("id").eqNullSafe(F.col("kid")) & (F.col("h") == F.col("kh"))
    worded = F.size(words(F.col("t"))) > 0
    staying = rows.where(worded).join(stay, of_key, "left_semi").groupBy("id", "h").agg(F.min("doc").alias("doc"))
    return staying.select("doc.*").unionByName(rows.where(~worded).select("doc.*"))
