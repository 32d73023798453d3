"""Secrets in text: fixed patterns, and Markov models of random strings against ordinary identifiers.

Everything is a DataFrame expression: matches and the gaps between them give positions, bigram
counts give the models, a lookup per bigram gives the log-likelihood ratio of a candidate.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds in the order in which equal starts are listed, and what they match.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_KEY = r"(?i:password|passwd|secret|token|api_?key)"
#: A run shorter than the least length would be dropped, and runs cannot overlap: the counted forms match the rest.
ACCESS, HEX = r"AKIA[A-Z0-9]{14,}", r"[0-9a-f]{16,}"
KINDS = ["assign", "access", "hex", "markov"]
LEAST_VALUE = 12

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
LEAST_CANDIDATE = 20
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{LEAST_CANDIDATE},}}"
#: Different characters that a secret has at least; rulers such as ``=====`` are none.
DIFFERENT = 8
WORD = r"[A-Za-z0-9_-]{8,}"
CHUNK = 128
#: Texts are cut into blocks of ``1 << BLOCK`` characters, so that a piece of one is taken without a walk from its start.
BLOCK = 12
MASK = "[secret]"

SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body or a lambda inside it names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, add: Callable[[Column, Column], Column]) -> Column:
    """Totals of array<int> up to and with each element; ``add`` is associative and keeps what it adds to 0.

    In two levels: a list grows by one element only within a chunk and over the totals of chunks, so the
    work stays in proportion to the array.
    """
    none = F.expr("cast(array() as array<int>)")

    def prefix(x: Column) -> Column:
        return F.aggregate(x, none, lambda s, v: F.array_append(s, add(F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0)), v)))

    def chunks(v: Column) -> Column:
        last = F.size(v) - 1
        own = lambda c: F.transform(F.sequence(c * CHUNK, F.least(c * CHUNK + CHUNK - 1, last)), lambda i: F.get(v, i))
        return F.transform(F.sequence(F.lit(0), F.floor(last / CHUNK).cast("int")), lambda c: prefix(own(c)))

    def joined(parts: Column) -> Column:
        totals = prefix(F.transform(parts, lambda p: F.element_at(p, -1)))
        before = F.slice(F.concat(F.array(F.lit(0)), totals), 1, F.size(parts))
        return F.flatten(F.zip_with(parts, before, lambda p, b: F.transform(p, lambda v: add(b, v))))

    return F.when(F.size(values) > 0, let(let(values, chunks), joined)).otherwise(none)


def blocks_of(text: Column) -> Column:
    size = 1 << BLOCK
    return F.when(F.length(text) > size, F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{size}}}"), F.lit(0))).otherwise(F.array(text))


def piece(blocks: Column, start: Column, end: Column) -> Column:
    """Characters ``start`` to ``end`` of a text in blocks."""
    first = F.shiftright(start, BLOCK)
    own = F.transform(F.sequence(first, F.shiftright(end - 1, BLOCK)), lambda k: F.get(blocks, k))
    return F.when(start < end, F.substring(F.array_join(own, ""), start - F.shiftleft(first, BLOCK) + 1, end - start)).otherwise("")


def spans_of(df: DataFrame, text: str, pattern: str, quick: str, kind: int, out: str) -> DataFrame:
    """Adds the leftmost non-overlapping matches; ``quick`` is a cheaper test without which there is none.

    The lengths of matches and of the gaps before them, summed up, are the places.
    """
    none = F.expr(f"cast(array() as {SPAN})")
    hit = F.col(text).rlike(quick)
    df = df.withColumn("_found", F.when(hit, F.regexp_extract_all(text, F.lit(pattern), 0)).otherwise(F.expr("cast(array() as array<string>)")))
    df = df.withColumn("_gaps", F.when(F.size("_found") > 0, F.split(text, pattern, -1)))
    ends = running(F.zip_with("_found", F.slice("_gaps", 1, F.size("_found")), lambda m, g: F.length(g) + F.length(m)), lambda a, b: a + b)
    spans = F.zip_with("_found", ends, lambda m, e: F.struct((e - F.length(m)).alias("start"), F.lit(kind).alias("kind"), e.alias("end"), m.alias("value")))
    return df.withColumn(out, F.when(F.size("_found") > 0, spans).otherwise(none)).drop("_found", "_gaps")


def with_base(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``assign``, ``access`` and ``hex``; an assignment stays if its value has 12 characters."""
    df = spans_of(df, text, ASSIGN, ASSIGN_KEY + r"""["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]""", 0, "assign")
    df = df.withColumn("assign", F.filter("assign", lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= LEAST_VALUE))
    df = spans_of(df, text, ACCESS, ACCESS, 1, "access")
    return spans_of(df, text, HEX, HEX, 2, "hex")


def bigrams(token: Column) -> Column:
    """Codes of neighbouring characters; pairs with a character outside the alphabet are null."""
    size = len(ALPHABET)
    places = F.transform(F.split(token, ""), lambda c: F.when(c != "", F.position(c, F.lit(ALPHABET))).otherwise(0))

    def pairs(p: Column) -> Column:
        pair = lambda a, b: F.when((a > 0) & (b > 0), (a - 1) * size + b - 1)
        return F.zip_with(F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, 2, F.size(p)), pair)

    return let(places, pairs)


def train(samples: DataFrame, weight: float = 20.0) -> DataFrame:
    """One row with ``ratios``: for each pair code log P(next | first, random) - log P(next | first, ordinary).

    ``samples`` (token, random boolean) are the labelled strings. What follows a character is mixed with
    what follows any, which counts as ``weight`` observations; that in turn with all characters alike. The
    counts of all samples are summed up before they meet: the model has the square of the alphabet as its
    size whatever their number.
    """
    size = len(ALPHABET)
    seen = samples.filter("token is not null and random is not null").select("random", F.explode(bigrams(F.col("token"))).alias("code")).filter("code is not null")
    counts = seen.groupBy("code").agg(F.count_if("random").alias("r"), F.count_if(~F.col("random")).alias("o"))
    codes = samples.sparkSession.range(size * size).select(F.col("id").cast("int").alias("code"))
    full = codes.join(counts, "code", "left").select("code", F.floor(F.col("code") / size).alias("a"), (F.col("code") % size).alias("b"), F.coalesce("r", F.lit(0)).alias("r"), F.coalesce("o", F.lit(0)).alias("o"))

    def share(n: str) -> Column:
        first, second = (F.sum(n).over(Window.partitionBy(x)) for x in ("a", "b"))
        any_first = (second + 1) / (F.sum(n).over(Window.partitionBy()) + size)
        return F.log((F.col(n) + weight * any_first) / (first + weight))

    ratio = full.select("code", (share("r") - share("o")).alias("ratio"))
    return ratio.agg(F.transform(F.sort_array(F.collect_list(F.struct("code", "ratio"))), lambda x: x["ratio"]).alias("ratios"))


def labelled(docs: DataFrame, text: str = "text", documents: int = 20_000, made: int = 5_000) -> DataFrame:
    """(token, random): labelled strings for ``train``.

    Random: the values of fixed-pattern matches, and ``made`` digests in base64, hexadecimal and upper
    case. Ordinary: words outside those matches of eight characters or more, and fewer than a candidate has. From the texts of about
    ``documents`` documents, the bound of the sample: all if there are no more, else those whose hash (of the
    row, so that copies do not go together) is below that share. No text is shuffled for it.
    """
    spark = docs.sparkSession
    share = min(1.0, documents / max(1, docs.count()))
    below = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]) <= min(int(share * 2.0**63) * 2 - 2**63, 2**63 - 1)
    some = docs.filter(below if share < 1 else F.lit(True)).select(F.col(f"`{text}`").alias("text")).filter("text is not null")
    based = with_base(some)
    spans = based.select(F.explode(F.concat("assign", "access", "hex")).alias("s")).select("s.kind", "s.value")
    values = spans.select(F.when(F.col("kind") == 0, F.regexp_extract("value", ASSIGN, 2)).otherwise(F.col("value")).alias("token"), F.lit(True).alias("random"))
    digests = spark.range(made).select(F.explode(F.array(
        F.rtrim(F.base64(F.unhex(F.sha2(F.col("id").cast("string"), 256))), F.lit("=")),
        F.sha2(F.concat(F.lit("h"), F.col("id").cast("string")), 256).substr(1, 40),
        F.upper(F.regexp_replace(F.base64(F.unhex(F.sha2(F.concat(F.lit("u"), F.col("id").cast("string")), 256))), "[+/=]", "")),
    )).alias("token"), F.lit(True).alias("random"))
    cleared = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), ACCESS, " "), HEX, " ")
    words = some.select(F.explode(F.regexp_extract_all(cleared, F.lit(WORD), 0)).alias("token")).filter(F.length("token") < LEAST_CANDIDATE)
    words = words.select("token", F.lit(False).alias("random"))
    return values.unionByName(digests).unionByName(words)


def uncovered(candidates: Column, base: Column, blocks: Column) -> Column:
    """The parts of candidates that no span of ``base`` covers, as spans; a candidate itself if none touches it.

    One ordered merge of both: between a start and the next one, what is free runs from the furthest end of
    ``base`` so far to the end of the latest candidate. Parts too short to hold enough different characters are left out.
    """
    mine = F.transform(candidates, lambda c: F.struct(c["start"].alias("start"), F.lit(0).alias("cover"), c["end"].alias("till")))
    other = F.transform(base, lambda b: F.struct(b["start"].alias("start"), b["end"].alias("cover"), F.lit(0).alias("till")))
    most = lambda name: lambda e: running(F.transform(e, lambda x: x[name]), F.greatest)

    def parts(events: Column) -> Column:
        starts = F.transform(events, lambda e: e["start"])
        ahead = F.zip_with(starts, F.slice(starts, 2, F.size(starts)), lambda s, n: F.struct(s.alias("start"), n.alias("next")))
        free = F.zip_with(ahead, most("cover")(events), lambda s, c: F.struct(F.greatest(s["start"], c).alias("start"), s["next"].alias("next")))
        return F.zip_with(free, most("till")(events), lambda f, t: F.struct(f["start"].alias("start"), F.least(f["next"], t).alias("end")))

    cut = F.filter(let(F.sort_array(F.concat(mine, other)), parts), lambda p: p["end"] - p["start"] >= DIFFERENT)
    span = lambda p, b: F.struct(p["start"].alias("start"), F.lit(3).alias("kind"), p["end"].alias("end"), piece(b, p["start"], p["end"]).alias("value"))
    return let(blocks, lambda b: F.transform(cut, lambda p: span(p, b)))


def scan(docs: DataFrame, samples: DataFrame | None = None, text: str = "text", least: float = 20.0, mean: float = 0.6) -> DataFrame:
    """(whole, text, assign, access, hex, markov) of every row: the row itself and its spans.

    A span is (start, kind, end, value) in code points. Each part of a candidate of 20 characters or more that
    no fixed-pattern span covers is a secret if random strings explain it better than ordinary identifiers: by
    ``least`` nats in all and ``mean`` a character pair. Parts of any length are judged. Null text is empty and has no spans. Rows never
    meet; only the bigram counts are shuffled.
    """
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    model = train(labelled(docs, text) if samples is None else samples)
    df = with_base(df)
    df = spans_of(df, "text", CANDIDATE, CANDIDATE, 3, "candidates")
    free = uncovered(F.col("candidates"), F.concat("assign", "access", "hex"), blocks_of(F.col("text")))
    df = df.withColumn("free", F.when(F.size("candidates") > 0, free).otherwise(F.col("candidates"))).withColumn("ratios", model.scalar())

    def sure(c: Column) -> Column:
        total = F.aggregate(bigrams(c["value"]), F.lit(0.0), lambda s, code: s + F.coalesce(F.get(F.col("ratios"), code), F.lit(0.0)))
        varied = F.size(F.array_distinct(F.split(c["value"], ""))) >= DIFFERENT
        return varied & (total >= least) & (total >= mean * (F.length(c["value"]) - 1))

    return df.withColumn("markov", F.filter("free", sure)).drop("free", "candidates", "ratios")


def listed(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def digest(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    found = scan(docs)
    base = F.concat("assign", "access", "hex")
    size = lambda c: F.size(c).cast("bigint")
    return found.select(
        F.col(f"whole.`{key}`").alias(key), size("assign").alias("n_assign"), size("access").alias("n_access"), size("hex").alias("n_hex"),
        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.concat(base, F.col("markov"))).alias("spans"),
        size("markov").alias("n_markov"),
    )


def redact(docs: DataFrame, text: str = "text", samples: DataFrame | None = None) -> DataFrame:
    """``docs`` with every secret replaced by a mask; overlapping spans share one. Other columns and rows stay."""
    found = scan(docs, samples, text)
    spans = F.sort_array(F.concat("assign", "access", "hex", "markov"))

    def masked(s: Column, blocks: Column) -> Column:
        """What lies between the spans, each time up to a start that is beyond all ends before it."""
        ends = running(F.transform(s, lambda x: x["end"]), F.greatest)
        before = lambda e: F.concat(F.array(F.lit(0)), e)
        gaps = F.zip_with(before(ends), F.transform(s, lambda x: x["start"]), lambda e, x: F.struct(e.alias("end"), F.coalesce(x, F.length("text")).alias("start"), x.isNull().alias("rest")))
        put = lambda g: F.when(g["start"] >= g["end"], F.concat(piece(blocks, g["end"], g["start"]), F.when(g["rest"], "").otherwise(MASK))).otherwise("")
        return F.array_join(F.transform(gaps, put), "")

    whole = let(spans, lambda s: let(blocks_of(F.col("text")), lambda b: masked(s, b)))
    touched = F.size(F.concat("assign", "access", "hex", "markov")) > 0
    own = lambda c: F.col(f"whole.`{c}`")
    return found.select(*[(F.when(touched, whole).otherwise(own(c)) if c == text else own(c)).alias(c) for c in docs.columns])
