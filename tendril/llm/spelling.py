"""Spelling variants: words one edit apart, found through grams of variable length.

The gram dictionary holds all grams of the least length and every extension of a frequent gram. A word is decomposed
into the longest gram of the dictionary at each place, without those inside another. One edit changes only the grams
that hold the edited place and the one that begins right after it:

* A gram that ends before the edit is not frequent or has the greatest length, so no other text behind it makes it
  longer; and an earlier gram that could grow over it would reach over it already.
* A gram that begins two places behind the edit or later could only vanish inside a new gram that begins at the edit or
  before. All but the last character of that gram are frequent, hence also what lies between the edit and the end of
  the old gram without its last character; so the gram that begins behind the edit holds the old gram already.

The greatest number of changed grams over all places bounds what a neighbour must share, so two neighbours meet in the list
of one of the rarest grams of each. Around a gram that both share the edit is on one side, so the lists
are kept by gram and all that stands before it, and by gram and all that follows. What meets is verified.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tendril.session import materialize

#: Letters, code points of the shortest word, least occurrences, every how many-th run loses a character.
LETTERS = r"[A-Za-zÀ-ÿ]"
SHORTEST, LEAST, EVERY = 6, 5, 199
#: How much more frequent a form is than its variant.
TIMES = 5
SHORT_GRAM, LONG_GRAM = 2, 6
#: Words stand between two marks that no word holds.
OPEN, CLOSE = "\x02", "\x03"
#: A gram is frequent above this number, or above this share of all places: no more than its inverse can be, for each length.
FREQUENT, SHARE = 200, 1 / 20_000


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", every: int = EVERY) -> DataFrame:
    """(word, n): runs of letters with A to Z in lower case, if they have SHORTEST code points and occur LEAST times.

    Of each run whose crc32 with its document's id is divisible by ``every``, one code point is deleted first. Null
    text has no runs; a null id counts as empty. Equal words of a task are summed up before they are shuffled.
    """
    upper = "".join(map(chr, range(65, 91)))
    ident = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))
    # Shorter runs cannot give a word; in what is left a match is a whole run.
    runs = docs.select(ident.alias("ident"), F.explode(F.regexp_extract_all(F.col(f"`{text}`"), F.lit(LETTERS + f"{{{SHORTEST},}}"), 0)).alias("run"))
    lower = runs.select("ident", F.translate("run", upper, upper.lower()).alias("run"))
    hashed = lower.select("run", F.crc32(F.concat("ident", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % every == 0, cut).otherwise(F.col("run"))
    return hashed.select(word.alias("word")).filter(F.length("word") >= SHORTEST).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST)


def longest_gram(size: int) -> int:
    """Greatest gram length for words of a size: longer grams would leave too few that an edit cannot touch."""
    return max(3, min(LONG_GRAM, (size + 2) // 3 + 1))


def gram_counts(words: DataFrame) -> DataFrame:
    """(gram, n): how often each gram of the lengths in use occurs in the marked words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counter()
        for batch in batches:
            for word in batch.column(0).to_pylist():
                marked = OPEN + word + CLOSE
                for q in range(SHORT_GRAM, LONG_GRAM + 1):
                    held.update(marked[p : p + q] for p in range(len(marked) - q + 1))
            if len(held) > 1 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["gram", "n"])
                held = Counter()
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["gram", "n"])

    return words.select("word").mapInArrow(run, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


def decompose(marked: str, frequent: dict[str, int], most: int) -> list[tuple[int, int]]:
    """(start, end) of the grams: the longest at each place, unless an earlier one covers it."""
    out, reached, n = [], 0, len(marked)
    for p in range(n - SHORT_GRAM + 1):
        end = p + SHORT_GRAM
        while end < n and end - p < most and marked[p:end] in frequent:
            end += 1
        if end > reached:
            out.append((p, end))
            reached = end
    return out


def affected(grams: list[tuple[int, int]], n: int) -> int:
    """The most grams that one edit between the marks can change."""
    change = np.zeros(n + 2, np.int64)
    for p, end in grams:
        change[max(p - 1, 0)] += 1  # the gram that begins right after the place, and those that hold it
        change[end] -= 1
    return int(np.cumsum(change)[1 : n - 1].max())


def signatures(word: str, frequent: dict[str, int], size: int) -> Iterator[str]:
    """Keys under which a word meets its neighbours, as one of the words of ``size`` code points or one more.

    The rarest grams, one more than an edit can change, with all text on one side. A word whose grams can
    all change at once is found by any neighbour whose grams cannot; to meet the others that are so, it also has
    grams of the length of which an edit never reaches all.
    """
    marked = OPEN + word + CLOSE
    n = len(marked)
    grams = decompose(marked, frequent, longest_gram(size))
    most = affected(grams, n)
    rank = lambda g: (frequent.get(marked[g[0] : g[1]], 0), zlib.crc32(marked[g[0] : g[1]].encode()), marked[g[0] : g[1]])
    for p, end in sorted(grams, key=rank)[: most + 1]:
        yield f"{size}<{marked[:end]}<{p}"
        yield f"{size}>{marked[p:]}>{n - end}"
    if most >= len(grams):
        q = (size + 2) // 2
        for p in range(n - q + 1):
            yield f"{size}[{marked[: p + q]}"
            yield f"{size}]{marked[p:]}"


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): all pairs of words that differ by one inserted, deleted or replaced code point, each once."""
    spark = words.sparkSession
    counts = materialize(gram_counts(words), "grams")
    places = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] / (LONG_GRAM - SHORT_GRAM + 1)
    limit = max(FREQUENT, int(places * SHARE))
    frequent = {r.gram: r.n for r in counts.filter((F.col("n") > limit) & (F.length("gram") < LONG_GRAM)).collect()}
    shared = spark.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = shared.value
        for batch in batches:
            keys, of = [], []
            for i, word in enumerate(batch.column(0).to_pylist()):
                for size in (len(word), len(word) - 1):
                    own = {*signatures(word, frequent, size)}
                    keys.extend(own)
                    of.extend([i] * len(own))
            of = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([hash_of(k) for k in keys], pa.int64()), batch.column(0).take(of), batch.column(1).take(of), pa.array([k[: k.index(next(c for c in k if not c.isdigit()))] for k in keys], pa.string()).cast(pa.int32())], names=["key", "word", "n", "size"])

    listed = materialize(words.select("word", "n").mapInArrow(run, "key bigint, word string, n bigint, size int"), "lists")
    a = listed.filter(F.length("word") == F.col("size")).select("key", F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("size").alias("a_size"))
    b = listed.select("key", F.col("word").alias("b"), F.col("n").alias("b_n"), "size")
    once = (F.length("b") > F.col("size")) | (F.col("a") < F.col("b"))
    met = a.join(b, "key").filter((F.col("a_size") == F.col("size")) & once & (F.levenshtein("a", "b", 1) == 1))
    return met.select("a", "a_n", "b", "b_n").distinct()


def hash_of(key: str) -> int:
    """64 bits of a key; what meets by chance is not verified as a pair."""
    raw = key.encode()
    low, high = zlib.crc32(raw), zlib.crc32(raw, 0x5BD1E995)
    return (high << 32 | low) - (1 << 63)


def group(words: DataFrame, pairs: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n): each word's most frequent neighbour, if it is ``times`` as frequent, and
    the last one on the way from form to form. Counts grow on that way, so it ends."""
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("m")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("m")))
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), F.col("other").alias("other"))).alias("top"))
    first = words.join(near, "word", "left")
    found = -F.col("top.m") >= times * F.col("n")
    told = materialize(
        first.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(found, F.col("top.other")).alias("form"), F.when(found, -F.col("top.m")).alias("form_n")), "forms"
    )
    # Each round doubles the steps that a pointer has gone.
    ahead = told.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:
        ahead = materialize(ahead, "roots")
        further = ahead.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if ahead.join(further, "root", "left_semi").isEmpty():
            break
        ahead = ahead.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return told.join(ahead, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", every: int = EVERY) -> DataFrame:
    """Spelling variants of the words of all documents; no word gives an empty result."""
    words = materialize(word_counts(docs, key, text, every), "vocabulary")
    return group(words, near_pairs(words))
