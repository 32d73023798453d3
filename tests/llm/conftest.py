import random

import pytest

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, _text string, _letter boolean, spans int, h1 int"
SYLLABLES = {"en": "th er on an re he in ed nd ha at en es of or nt ea ti to it".split(), "fr": "eau oi ou ai ment tre que é è ç pa vi ier eux on an re en elle ch".split()}


def prose(rng, lang="en", words=60):
    """Invented words of two or three syllables."""
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(2, 3))) for _ in range(words))


def row(key, text, lang="en"):
    """A document with extra columns whose names the operators might use inside."""
    return (key, text, lang, "src", len(text or ""), "k", "t", True, 3, 4)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, ties and clashing extra columns."""
    rng = random.Random(3)
    base = prose(rng, words=120)
    texts = [None, "", " \n\t ", "%%% 123", "one", "one two three four", base, base, base + " end", "x" * 300_000, "ab " * 30_000, prose(rng, "fr"), "é" * 60 + prose(rng), "tail\x00\x1c\x85 \U0001f389 <|endoftext|> x"]
    rows = [row(i, t) for i, t in enumerate(texts)]
    rows += [row(6, base), row(None, base), row(None, None), (20, prose(rng), None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCUMENTS)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCUMENTS)


def texts_of(df):
    """Texts in the order that operators use: null ids last, equal ids by a hash of the text."""
    from pyspark.sql import functions as F

    rows = df.select(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("d"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), F.coalesce("text", F.lit("")).alias("t")).collect()
    return sorted((r.d, r.h, r.t) for r in rows)
