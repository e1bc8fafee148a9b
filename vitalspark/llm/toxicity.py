"""Toxicity with noisy-channel deobfuscation.

Words that show signs of disguise (digits or symbols among letters, letters set
apart, letters repeated) become a lattice of characters: each mark may stand for
itself or for letters it looks like, a separator for nothing or for a word
boundary, a repeated letter for one. Viterbi decoding under a character bigram
model, learned from the training words, picks the reading. A run of letters set
apart, or of pieces between separators, is cut into words by Viterbi over the
words of the training texts, with unknown ones by the character model, so words
that stand beside it are told from it. Words and runs of any length are whole. Restored words
are then scored: words that mostly toxic training texts have weigh their log odds,
and the logistic of the five largest weights, less a fixed offset, is the score.

Both models are learned from all labelled rows whose crc32 remainder is not 0, whole:
tasks count the words of their rows, a shuffle adds the counts up, and pairs of
characters and weights are made from the table of words. Only the models come back:
of pairs, weights and known words the ``MOST_WORDS`` first. Texts are scored whole.

Defined cases: null and empty texts have the score of a text without telling
words; rows of equal id and label are learned once each; null labels are not
learned; a text without telling words, and every text where no row is labelled,
scores ``NO_SIGN``; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalspark.llm.common import MEMO_ENTRIES, chunks, doc_remainder, table, whole_text
from vitalspark.llm.components import stored

MOST_WORDS, LEAST_DOCS = 20_000, 3
#: Labels that are broadcast at most, and counts that a task holds before it hands them on.
MOST_LABELS, HELD_COUNTS = 2_000_000, 200_000
NO_SIGN = 0.1
# Letters that a mark may stand for.
LOOKS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
}
SEPARATORS = set(".-_*~^'`,/\\")
PIECES = re.compile(f"[{re.escape(''.join(sorted(SEPARATORS)))}]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACED = re.compile(r"(?<![^\x20\x09-\x0D])(?:[^\W_]|[@$!])(?:[\x20._*-]+(?:[^\W_]|[@$!])){2,}(?![^\x20\x09-\x0D])")
REPEATED = re.compile(r"(.)\1{2,}")
APART = re.compile(r"[\x20._*-]+")
SWITCH, DROP, NEW = math.log(0.3), math.log(0.2), math.log(0.001)


class CharacterModel:
    """Add-half character bigrams over words, '^' and '$' at the ends."""

    def __init__(self, counts: dict[str, int]):
        self.counts, self.total = counts, Counter()
        for pair, n in counts.items():
            self.total[pair[0]] += n

    def log(self, a: str, b: str) -> float:
        return math.log((self.counts.get(a + b, 0) + 0.5) / (self.total.get(a, 0) + 30.0))


def readings(c: str) -> list[tuple[str, float]]:
    if c.isalpha():
        return [(c, 0.0)]
    found = [(x, SWITCH) for x in LOOKS.get(c, "")]
    if c in SEPARATORS:
        found.append(("", DROP))
    return found or [(c, 0.0)]


def restore(word: str, model: CharacterModel) -> str:
    """Viterbi over the lattice of a lower-case word's readings."""
    stretched = REPEATED.search(word) is not None
    states: dict[str, tuple[float, tuple | None]] = {"^": (0.0, None)}  # weight and path back
    for k, c in enumerate(word):
        again = k > 0 and word[k - 1] == c
        options = readings(c)
        if again:  # a repetition may be dropped
            options = [*options, ("", 0.0 if stretched else DROP)]
        following: dict[str, tuple[float, tuple | None]] = {}
        for last, (weight, path) in states.items():
            for letter, cost in options:
                score = weight + cost + (model.log(last, letter) if letter else 0.0)
                key = letter or last
                if key not in following or score > following[key][0]:
                    following[key] = (score, (letter, path) if letter else path)
        states = following
    _, last = max((s + model.log(x, "$"), x) for x, (s, _) in states.items())
    letters, path = [], states[last][1]
    while path:
        letters.append(path[0])
        path = path[1]
    return "".join(reversed(letters))


def disguised(core: str) -> bool:
    return not core.isalpha() or REPEATED.search(core) is not None


class Reader:
    """Words of a text, restored; a bounded memo of words."""

    def __init__(self, model: CharacterModel, known: dict[str, int] | None = None):
        self.model, self.known, self.memo = model, known or {}, {}
        self.total = 1 + sum(self.known.values())
        self.longest = max(map(len, self.known), default=0)

    def segments(self, units: list[str]) -> set[str]:
        """The known words of the best cut of ``units`` into words, each one of
        them or several joined."""
        model = self.model
        # up to each unit: of whole words, and inside an unknown one
        best, inside, back = [(0.0, 0, "")], None, []
        for j, unit in enumerate(units):
            enter = best[j][0] + NEW
            starts = (enter + model.log("^", unit[0]), j)
            if inside is not None:
                starts = max(starts, (inside[0] + model.log(units[j - 1][-1], unit[0]), inside[1]))
            inside = (starts[0] + sum(model.log(a, b) for a, b in zip(unit, unit[1:])), starts[1])
            found = (inside[0] + model.log(unit[-1], "$"), inside[1], "")
            i, size = j, len(unit)
            while i >= 0 and size <= self.longest:
                joined = "".join(units[i : j + 1])
                forms = (joined,) if joined in self.known or not disguised(joined) else (restore(joined, model),)
                for word in forms:
                    if n := self.known.get(word):
                        found = max(found, (best[i][0] + math.log(n / self.total), i, word))
                i -= 1
                size += len(units[i])
            best.append(found)
        j, out = len(units), set()
        while j:
            _, i, word = best[j]
            if word:
                out.add(word)
            j = i
        return out

    def cut(self, units: list[str]) -> set[str]:
        """Of the units as they are, and with stretched letters once."""
        single = all(len(x) == 1 for x in units)
        thin = list(REPEATED.sub(r"\1", "".join(units))) if single else [REPEATED.sub(r"\1", x) for x in units]
        return self.segments(units) | (self.segments(thin) if thin != units else set())

    def word(self, raw: str) -> tuple[str, ...]:
        if (known := self.memo.get(raw)) is not None:
            return known
        low = raw.lower()
        core = low.strip(".,;:!?\"'()[]{}<>*#%&|-_~`")
        out = {core} if core else set()
        if core and any(c.isalnum() for c in low) and disguised(low.strip(".,;:?\"'()[]{}")):
            for form in {core, low.rstrip(".,;:?")}:
                out.add(restore(form, self.model))
            out.add(restore(REPEATED.sub(r"\1", core), self.model))
            units = [x for x in PIECES.split(core) if x]
            if len(units) > 1:
                out |= self.cut(units)
        if len(self.memo) > MEMO_ENTRIES:
            self.memo.clear()
        known = self.memo[raw] = tuple(sorted(out))
        return known

    def words(self, text: str) -> set[str]:
        found = set(chain.from_iterable(map(self.word, set(WORD.findall(text)))))
        for match in SPACED.findall(text):
            joined = APART.sub("", match)
            found.update(self.word(joined))
            found |= self.cut(list(joined.lower()))
        return found


def plain_words(text: str) -> set[str]:
    return {w.lower().strip(".,;:!?\"'()[]{}") for w in WORD.findall(text)}


def pairs_of(word: str) -> list[str]:
    path = f"^{word}$"
    return [path[i : i + 2] for i in range(len(path) - 1)]


def weight_of(n: int, k: int, rows: int, n_toxic: int, tried: int) -> float | None:
    """The weight of a word that ``n`` texts have, ``k`` of them toxic; None if it
    tells nothing. As ``tried`` words are tried at once, a word needs that much more
    evidence."""
    if n < LEAST_DOCS or not 0 < n_toxic < rows or 2 * k <= n:
        return None
    prior = n_toxic / rows
    if k <= n * prior:
        return None
    evidence = k * math.log(k / (n * prior))
    if k < n:
        evidence += (n - k) * math.log((n - k) / (n * (1 - prior)))
    if evidence <= math.log(1 + tried):
        return None
    return math.log((k + 0.2) / (n_toxic + 0.4)) - math.log((n - k + 0.2) / (rows - n_toxic + 0.4))


def most(counts: dict) -> dict:
    """The ``MOST_WORDS`` greatest, equal ones by their names."""
    return dict(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:MOST_WORDS])


def learn(rows: list[tuple[str, int]]) -> dict:
    """From (text, label): the character counts and the words' weights, as
    :func:`train` has them of a table."""
    pairs, seen, toxic = Counter(), Counter(), Counter()
    for text, label in rows:
        for w in plain_words(text):
            seen[w] += 1
            toxic[w] += label
    for w, n in seen.items():
        if w.isalpha():
            for pair in pairs_of(w):
                pairs[pair] += n
    n_toxic = sum(label for _, label in rows)
    tried = sum(n >= LEAST_DOCS for n in seen.values())
    found = {w: weight_of(n, toxic[w], len(rows), n_toxic, tried) for w, n in seen.items() if w}
    weights = most({w: x for w, x in found.items() if x is not None})
    known = most({w: n for w, n in seen.items() if w.isalpha()}) | {w: seen[w] for w in weights}
    return {"pairs": most(pairs), "weights": weights, "known": known}


def score_of(words: set[str], weights: dict[str, float]) -> float:
    evidence = sum(sorted((weights[w] for w in words if w in weights), reverse=True)[:5])
    return 1 / (1 + math.exp(-(evidence - 2.0))) if evidence else NO_SIGN


def added(rows: DataFrame, counts, schema: str, by: str) -> DataFrame:
    """``counts(batch)`` gives (key, numbers) pairs of an Arrow batch; their sums by
    key. A task adds up what it holds before it hands it on."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def emptied():
            columns = [list(held), *zip(*held.values())] if held else [[] for _ in names]
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, pa.string() if n == by else pa.int64()) for n, c in zip(names, columns)], names=names
            )

        for batch in chain.from_iterable(map(chunks, batches)):
            for key, numbers in counts(batch):
                old = held.get(key)
                held[key] = numbers if old is None else tuple(map(int.__add__, old, numbers))
            if len(held) > HELD_COUNTS:
                yield emptied()
        yield emptied()

    return rows.mapInArrow(run, schema).groupBy(by).agg(*[F.sum(n).alias(n) for n in names if n != by])


def word_counts(labelled: DataFrame) -> DataFrame:
    """(word, n, k): texts with the word, and toxic ones; the null word has all."""

    def counts(batch):
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            yield None, (1, label)
            for w in plain_words(text):
                yield w, (1, label)

    rows = labelled.where("label is not null").select("text", F.col("label").cast("int").alias("label"))
    return added(rows, counts, "word string, n long, k long", "word")


def train(labelled: DataFrame) -> dict:
    """The models of all rows of ``labelled`` (text, label)."""
    counts = stored(word_counts(labelled), "word-counts")
    total = counts.where("word is null").head()
    if total is None:
        return {"pairs": {}, "weights": {}, "known": {}}
    rows, n_toxic = total["n"], total["k"]
    words = counts.where("word is not null")
    tried = words.where(F.col("n") >= LEAST_DOCS).count()

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = list(zip(*(c.to_pylist() for c in batch.columns)))
            weights = [weight_of(n, k, rows, n_toxic, tried) if w else None for w, n, k in each]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(weights, pa.float64()), pa.array([w.isalpha() for w, _, _ in each], pa.bool_())],
                names=["word", "n", "weight", "alpha"],
            )

    def pair_counts(batch):
        for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if word.isalpha():
                for pair in pairs_of(word):
                    yield pair, (n,)

    def first(df: DataFrame, key: str, number: str) -> dict:
        return {r[0]: r[1] for r in df.orderBy(F.col(number).desc(), key).limit(MOST_WORDS).select(key, number).collect()}

    judged = words.select("word", "n", "k").mapInArrow(weigh, "word string, n long, weight double, alpha boolean")
    telling = judged.where("weight is not null").orderBy(F.col("weight").desc(), "word").limit(MOST_WORDS).collect()
    return {
        "pairs": first(added(words.select("word", "n"), pair_counts, "pair string, n long", "pair"), "pair", "n"),
        "weights": {r["word"]: r["weight"] for r in telling},
        "known": first(judged.where("alpha"), "word", "n") | {r["word"]: r["n"] for r in telling},
    }


def score(docs: DataFrame, model: dict, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, predicted)."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(CharacterModel(model["pairs"]), model["known"])
        for batch in chain.from_iterable(map(chunks, batches)):
            scores = [score_of(reader.words(t), model["weights"]) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict(
                {key: batch.column(0), "score": scores, "predicted": pa.array([int(s >= 0.5) for s in scores], pa.int32())}
            )

    return docs.select(F.col(f"`{key}`"), whole_text(text).alias("t")).mapInArrow(run, f"`{key}` {kind}, score double, predicted int")


def toxicity_query(spark, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label")).dropDuplicates()
    remainder = doc_remainder(F.col("doc_id"), 5)
    known = labels.where((remainder != 0) & F.col("label").isNotNull())
    # narrow rows; with more of them the texts are shuffled to them
    known = F.broadcast(known) if known.count() <= MOST_LABELS else known
    labelled = documents.join(known, "doc_id").select(whole_text().alias("text"), "label")
    out = score(documents, train(labelled))
    return out.select("doc_id", (remainder == 0).alias("held_out"), "score", "predicted")
