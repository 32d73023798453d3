"""Byte strings, passages and near duplicates against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tendril.llm import jaccard, passages, segments, substrings
from tests.llm.conftest import DOCUMENTS, prose, row, texts_of


@pytest.fixture(scope="module")
def copies(spark):
    """Prose that shares passages across and within documents, and near copies."""
    rng = random.Random(11)
    shared = [prose(rng, words=w) for w in (12, 25, 40, 90)]
    texts = []
    for i in range(60):
        parts = [prose(rng, words=rng.randint(3, 50)), rng.choice(shared), prose(rng, words=rng.randint(0, 30)), rng.choice(shared)]
        texts.append(rng.choice([" ", "\n", "  "]).join(parts))
    for i in range(12):
        words = texts[0].split()
        words[rng.randrange(len(words))] = "edited"
        texts.append(" ".join(words))
    texts += [texts[1], texts[1], "na " * 200, "na " * 90, "the same again " * 40]
    return spark.createDataFrame([row(i, t) for i, t in enumerate(texts)], DOCUMENTS)


def bytes_brute(docs, width=50):
    first = {}
    for d, _, t in docs:
        b = t.encode()
        for p in range(len(b) - width + 1):
            first.setdefault(b[p : p + width], d)
    for d, _, t in docs:
        b = t.encode()
        gone = np.zeros(len(b) + width + 1, np.int64)
        for p in range(len(b) - width + 1):
            if first[b[p : p + width]] < d:
                gone[p] += 1
                gone[p + width] -= 1
        mask = np.cumsum(gone)[: len(b)] > 0
        runs = int((np.diff(np.concatenate([[0], mask.astype(int)])) == 1).sum())
        yield (d, len(b), int(mask.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~mask])).hexdigest())


def words_brute(docs, width=20):
    seen, done = set(), {}
    for d, h, t in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        gone = np.zeros(len(words) + width + 1, np.int64)
        if (d, h) in done:
            yield done[d, h]
            continue
        for p in range(len(words) - width + 1):
            w = tuple(words[p : p + width])
            if w in seen:
                gone[p] += 1
                gone[p + width] -= 1
            seen.add(w)
        mask = np.cumsum(gone)[: len(words)] > 0
        kept = " ".join(w for w, g in zip(words, mask) if not g)
        done[d, h] = (d, len(words), int(mask.sum()), hashlib.sha256(kept.encode()).hexdigest())
        yield done[d, h]


def big(r, *names):
    return ((1 << 63) - 1 if r.doc_id is None else r.doc_id, *(r[n] for n in names))


@pytest.mark.parametrize("name", ["copies", "odd", "nothing"])
def test_byte_strings(name, request):
    df = request.getfixturevalue(name)
    got = Counter(big(r, "n_bytes", "n_removed", "n_spans", "kept_sha256") for r in substrings.digest(df).collect())
    assert got == Counter(bytes_brute(texts_of(df)))


@pytest.mark.parametrize("name", ["copies", "odd", "nothing"])
def test_passages(name, request):
    df = request.getfixturevalue(name)
    got = Counter(big(r, "n_words", "n_removed", "kept_sha256") for r in passages.digest(df).collect())
    assert got == Counter(words_brute(texts_of(df)))


@pytest.mark.parametrize("module,brute,names", [(substrings, bytes_brute, ("n_bytes", "n_removed", "n_spans", "kept_sha256")), (passages, words_brute, ("n_words", "n_removed", "kept_sha256"))])
def test_frequent_passage(spark, monkeypatch, module, brute, names):
    """A passage in many documents with other text around it: no anchor keeps all that surrounds it in one place."""
    rng = random.Random(12)
    shared = prose(rng, words=25)
    texts = [f"{prose(rng, words=rng.randint(20, 40))} {shared} {prose(rng, words=rng.randint(20, 40))}" for _ in range(400)] + [shared, shared]
    df = spark.createDataFrame([row(i, t) for i, t in enumerate(texts)], DOCUMENTS)
    monkeypatch.setattr(segments, "FREQUENT", 2000)
    plain = segments.numbered(df, "doc_id", "text")
    scheme = segments.Scheme(module.WIDTH, module.GRAM, module is passages)
    other = module is substrings
    found = segments.occurrences(plain, scheme, segments.census(plain, scheme, other), other)
    most = max(r[1] for r in found.selectExpr("anchor", "octet_length(content) AS n").groupBy("anchor").sum("n").collect())
    assert most <= 8000  # 2000, and what two segments of each batch may add
    got = Counter(big(r, *names) for r in module.digest(df).collect())
    assert got == Counter(brute(texts_of(df)))


@pytest.mark.parametrize("name", ["copies", "odd"])
def test_all_anchors_frequent(name, request, monkeypatch):
    """Windows by their own names give what segments give."""
    df = request.getfixturevalue(name)
    monkeypatch.setattr(segments, "FREQUENT", 0)
    monkeypatch.setattr(segments, "ROWS", 500)
    got = Counter(big(r, "n_bytes", "n_removed", "n_spans", "kept_sha256") for r in substrings.digest(df).collect())
    assert got == Counter(bytes_brute(texts_of(df)))
    got = Counter(big(r, "n_words", "n_removed", "kept_sha256") for r in passages.digest(df).collect())
    assert got == Counter(words_brute(texts_of(df)))


def test_batches_of_long_texts_are_bounded(spark):
    """A batch of 10 000 long texts filled the JVM and the worker; equal segments of several batches of a task are one."""
    import pyarrow as pa

    from tendril.session import BATCH, size_batches

    size_batches(spark)
    text = prose(random.Random(3), words=2000)
    docs = spark.range(1200).coalesce(1).selectExpr("id AS doc_id", "'x' AS source").withColumn("text", F.lit(text))
    sizes = docs.select("text").mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in bs), "n bigint")
    sizes = [r.n for r in sizes.collect()]
    assert len(sizes) > 2 and max(sizes) <= BATCH + 2 * len(text)
    plain, scheme = segments.numbered(docs, "doc_id", "text"), segments.Scheme(substrings.WIDTH, substrings.GRAM, False)
    rows = segments.occurrences(plain, scheme, segments.census(plain, scheme, True), True).collect()
    assert len(rows) == len({bytes(r.content) for r in rows}) and (0, 1199) in {(r.doc, r.more) for r in rows}


def equal_windows(rng, n, width, low=3):
    sizes = np.array([rng.randint(width, width + 40) for _ in range(n)], np.int64)
    symbols = np.array([rng.randrange(low) for _ in range(int(sizes.sum()))], np.int64)
    begins = np.cumsum(sizes) - sizes
    count = sizes - width + 1
    rank = np.array(rng.sample(range(int(count.sum())), int(count.sum())), np.int64)
    want = {}
    keys = [tuple(symbols[b + o : b + o + width].tolist()) for b, c in zip(begins, count) for o in range(c)]
    for k, r in zip(keys, rank):
        want[k] = min(want.get(k, r), r)
    return (symbols, begins, sizes, count, rank), np.array([want[k] for k in keys])


@pytest.mark.parametrize("shard,merge", [(1 << 18, 1 << 22), (300, 1 << 22), (200, 800)])
def test_merged_transforms(shard, merge):
    """One shard, many shards at once, and shards that meet pair by pair."""
    chunk, want = equal_windows(random.Random(5), 40, 7)
    assert (substrings.first_of_equal(*chunk, width=7, shard=shard, merge=merge) == want).all()


@pytest.mark.parametrize("width", [8, 9, 21])
@pytest.mark.parametrize("low", [1, 2])
def test_merged_transforms_that_start_from_heads(width, low):
    chunk, want = equal_windows(random.Random(width), 30, width, low)
    assert (substrings.first_of_equal(*chunk, width=width, shard=300) == want).all()
    text = chunk[0][:200].astype(np.uint8) * (np.arange(200) % 23 > 0)  # terminators everywhere
    whole = [bytes(text[i : i + substrings.HEAD]).split(b"\0")[0] for i in range(200)]
    code, ended = substrings.heads(text)
    assert [c.to_bytes(8, "big").rstrip(b"\0") for c in code.tolist()] == whole and ended.tolist() == [len(w) < substrings.HEAD for w in whole]


def test_the_census_leaves_no_shuffle_files(spark, copies):
    held = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    plain, scheme = segments.numbered(copies, "doc_id", "text"), segments.Scheme(substrings.WIDTH, substrings.GRAM, False)
    before = held()
    table, _ = segments.census(plain, scheme, True)
    segments.bit_table(spark.range(1000).select(F.xxhash64("id").alias("anchor")))
    assert table.any() and held() <= before


def test_places_are_gone_before_texts_are_dealt(spark, copies):
    plain, scheme = segments.numbered(copies, "doc_id", "text"), segments.Scheme(substrings.WIDTH, substrings.GRAM, False)
    spans = segments.covered(plain, scheme, lambda *c: substrings.first_of_equal(*c, width=substrings.WIDTH), True)
    assert "Exchange" not in spans._jdf.queryExecution().executedPlan().toString() and spans.count()


@pytest.mark.parametrize("shard", [1 << 18, 250])
def test_fm_index(shard):
    chunk, want = equal_windows(random.Random(6), 40, 6)
    assert (passages.first_of_equal(*chunk, width=6, shard=shard) == want).all()


def test_matching_statistics():
    rng = np.random.default_rng(2)
    text = rng.integers(0, 3, 400)
    shard = substrings.Shard(text, np.array([0]), np.array([400]), np.array([0]))
    index = passages.Index(shard, 4)
    query = rng.integers(0, 4, 60) + 1
    ends = np.arange(12, 60)
    length, low, high = index.statistics(query, ends, 12)
    known = bytes((text + 1).astype(np.uint8))
    for e, n, a, b in zip(ends, length, low, high):
        longest = max(k for k in range(13) if bytes(query[e + 1 - k : e + 1].astype(np.uint8)) in known)
        assert n == longest
        if n == 12:
            piece = bytes(query[e - 11 : e + 1].astype(np.uint8))
            assert b - a == sum(known[p : p + 12] == piece for p in range(400))


def test_near_duplicates(spark, copies):
    rows = jaccard.classes_of(copies).collect()
    sets = {}
    for d, _, t in texts_of(copies):
        w = t.split()
        sets[d] = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    links, root = defaultdict(int), {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) > 0:
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {(r.doc_id, r.class_id, r.n_links) for r in rows} == {(d, find(d), links[d]) for d in sets}
    stay = jaccard.one_each(copies)
    assert stay.schema == copies.schema
    assert sorted(r.doc_id for r in stay.collect()) == sorted({find(d) for d in sets})


def test_near_duplicates_recall():
    """Even at the threshold itself the trees lose no more pairs than the recall allows."""
    assert jaccard.runs_for(0.999) >= 8
    lost = 0.0  # by levels below a node, many of them
    for _ in range(200):
        lost = np.exp(-jaccard.DEEPER * (1 - lost))
    assert np.exp(-jaccard.runs_for(0.999) * jaccard.SPREAD * (1 - lost)) <= 0.001


def test_near_duplicates_recall_over_several_splits(spark, monkeypatch):
    """Planted pairs just above the threshold: all texts share a passage, so that small buckets take several splits."""
    monkeypatch.setattr(jaccard, "LIMIT", 4)
    rng = np.random.default_rng(31)
    new = lambda n: [f"w{x}" for x in rng.integers(0, 1 << 40, n)]
    frame, texts = new(160), []
    for _ in range(300):
        own = new(200)
        texts += [" ".join([*frame, *own, *new(int(k))]) for k in rng.integers(30, 40, 2)]
    docs = spark.createDataFrame([row(i, t) for i, t in enumerate(texts)], DOCUMENTS)
    shingled = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(str.split, texts)]
    like = [len(a & b) / len(a | b) for a, b in zip(shingled[::2], shingled[1::2], strict=True)]
    assert 0.8 <= min(like) and max(like) < 0.86
    # Texts of different pairs share the passage alone, too little for a link.
    links = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.classes_of(docs).collect()}
    found = sum(links[i] == links[i + 1] == (i, 1) for i in range(0, len(texts), 2))
    assert found / 300 >= 0.996


def test_texts_that_collide_in_polynomials_are_no_copies(spark):
    """Words of the Thue-Morse text and of its mirror image differ, and so do the texts made of them."""
    thue = "".join("ab"[bin(i).count("1") & 1] for i in range(2048))
    mirror = thue.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([row(i, f"one two {m} three four") for i, m in enumerate((thue, mirror, thue))], DOCUMENTS)
    assert {r.doc_id: (r.class_id, r.n_links) for r in jaccard.classes_of(docs).collect()} == {0: (0, 1), 1: (1, 0), 2: (0, 1)}


def test_near_duplicates_in_blocks(spark, copies, monkeypatch):
    """Buckets beyond the limit are split, and alike ones are compared block by block."""
    whole = sorted(jaccard.classes_of(copies).collect(), key=str)
    monkeypatch.setattr(jaccard, "LIMIT", 4)
    assert sorted(jaccard.classes_of(copies).collect(), key=str) == whole


def test_near_duplicates_odd(odd, nothing):
    rows = jaccard.classes_of(odd).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert (by[0].n_links, by[1].n_links, by[0].class_id) == (0, 0, 0)
    assert by[6].class_id == by[7].class_id == by[8].class_id == 6
    assert by[6].n_links == 4  # 7, 8, the row repeated and the one without id
    kept = jaccard.one_each(odd)
    assert kept.schema == odd.schema and sorted(r.doc_id for r in kept.select("doc_id").collect() if r.doc_id is not None) == [0, 1, 2, 3, 4, 5, 6, 9, 10, 11, 12, 13, 20]
    assert jaccard.classes_of(nothing).collect() == []
    assert jaccard.one_each(nothing).collect() == []


def test_words_that_collide_in_polynomials_are_told_apart(spark):
    """The Thue-Morse text and its mirror image have equal polynomial hashes modulo 2**64 under every odd base."""
    thue = "".join("ab"[bin(i).count("1") & 1] for i in range(2048))
    mirror = thue.translate(str.maketrans("ab", "ba"))
    frame = [f"w{i}" for i in range(20)]
    texts = [" ".join([*frame[:10], middle, *frame[10:]]) for middle in (thue, mirror, thue)]
    docs = spark.createDataFrame([row(i, t) for i, t in enumerate(texts)], DOCUMENTS)
    assert {r.doc_id: r.n_removed for r in passages.digest(docs).collect()} == {0: 0, 1: 0, 2: 21}
