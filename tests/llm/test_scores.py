"""Language-model scores, spelling variants and hard negatives against slow versions."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest

from tendril.llm import kneser_ney, negatives, spelling
from tendril.llm.common import strong_hash
from tests.llm.conftest import DOCUMENTS, prose, row

# language model


def tokens_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(r"[\x20\x09-\x0D]+", lower) if w] + ["</s>"]


class Slow:
    """The same model with dictionaries."""

    def __init__(self, texts, order):
        self.order, self.raw = order, collections.Counter()
        grams = collections.Counter()
        for text in texts:
            words = tokens_of(text)
            self.raw.update(words)
            full = ["<s>"] * (order - 1) + words
            grams.update(tuple(full[i : i + order]) for i in range(len(words)))
        self.counts = {order: grams}
        for k in range(order - 1, 0, -1):
            self.counts[k] = collections.Counter(g[1:] for g in self.counts[k + 1])
        self.d, self.den, self.after = {}, {}, {}
        for k, counts in self.counts.items():
            s = [sum(c == i for c in counts.values()) for i in (1, 2, 3, 4)]
            d = [0.5, 1.0, 1.5]
            if min(s):
                y = s[0] / (s[0] + 2 * s[1])
                own = [i - (i + 1) * y * s[i] / s[i - 1] for i in (1, 2, 3)]
                d = own if min(own) > 0 else d
            self.d[k] = [0, *d]
            self.den[k], self.after[k] = collections.Counter(), collections.Counter()
            for g, c in counts.items():
                self.den[k][g[:-1]] += c
                self.after[k][g[:-1]] += self.d[k][min(c, 3)]

    def p(self, context, word, k=None):
        k = self.order if k is None else k
        if k == 0:
            return 1 / (len(self.raw) + 1)
        context = tuple(context)
        lower = self.p(context[1:], word, k - 1)
        den = self.den[k][context]
        if not den:
            return lower
        c = self.counts[k][context + (word,)]
        return (max(c - self.d[k][min(c, 3)], 0) + self.after[k][context] * lower) / den

    def score(self, text):
        words = tokens_of(text)
        full = ["<s>"] * (self.order - 1) + words
        return sum(math.log10(self.p(full[i : i + self.order - 1], full[i + self.order - 1])) for i in range(len(words)))


@pytest.mark.parametrize("order", [2, 3])
def test_language_model_equals_dictionaries(spark, odd, order, monkeypatch):
    rng = random.Random(order)
    extra = spark.createDataFrame([row(100 + i, prose(rng, words=rng.randint(0, 60)).upper() if i % 9 == 0 else prose(rng, words=rng.randint(0, 60))) for i in range(300)], DOCUMENTS)
    docs = odd.unionByName(extra)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    slow = Slow([t for i, t in rows if not held(i)], order)
    n, v = sum(slow.raw.values()), len(slow.raw)
    want = []
    for i, t in rows:
        counts = [slow.raw[w] for w in tokens_of(t)]
        base = sum(math.log10((c + 0.5) / (n + 0.5 * (v + 1))) for c in counts)
        want.append((i is None, i or 0, held(i), len(counts), sum(c > 0 for c in counts), n, round(base, 6), round(slow.score(t), 6)))
    found = kneser_ney.digest(docs, order)
    got = [(r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in found.collect()]
    assert [x[:6] for x in sorted(got)] == [x[:6] for x in sorted(want)]
    assert np.allclose([x[6:] for x in sorted(got)], [x[6:] for x in sorted(want)], rtol=1e-9, atol=1e-5)


def test_language_model_sums_to_one_and_beats_single_words(spark):
    rng = random.Random(5)
    vocabulary = [prose(rng, words=1) for _ in range(40)]
    follow = {w: rng.sample(vocabulary, 3) for w in vocabulary}

    def walk(n):
        out = [rng.choice(vocabulary)]
        while len(out) < n:
            out.append(rng.choice(follow[out[-1]]))
        return " ".join(out)

    docs = spark.createDataFrame([row(i, walk(30)) for i in range(200)], DOCUMENTS)
    model = kneser_ney.fit(docs, 3)
    words = sorted(set(vocabulary)) + [""]
    raw = "".join(words).encode()
    ends = np.cumsum([len(w) for w in words])
    hashes = strong_hash(np.frombuffer(raw, np.uint8), ends - [len(w) for w in words], ends)
    known = [h for h, w in zip(hashes, words, strict=True) if w] + [kneser_ney.END, np.uint64(12345)]
    for context in (known[:2], [known[3], known[3]], known[5:6], []):
        rows = np.array([[*context, w] for w in known], np.uint64)
        p, _ = model.probabilities(rows.reshape(-1), np.arange(len(known) + 1) * rows.shape[1])
        assert math.isclose(p.reshape(rows.shape)[:, -1].sum(), 1.0, rel_tol=1e-9)
    unseen = spark.createDataFrame([row(i, walk(30)) for i in range(50)], DOCUMENTS)
    found = kneser_ney.score(unseen, model).collect()
    assert sum(r.score for r in found) > 0.6 * sum(r.base_score for r in found)
    assert all(math.isclose(r.perplexity, 10 ** (-r.score / r.n_tokens)) for r in found)


def test_digest_looks_at_two_words_before(spark, monkeypatch):
    """Which word follows depends on the word before the last; pairs alone cannot tell."""
    monkeypatch.setattr(kneser_ney, "PART", 1 << 9)  # many parts
    texts = [f"{a} so {b} {i % 7}" for i in range(300) for a, b in (("one", "un"), ("two", "deux"))]
    docs = spark.createDataFrame([row(i, t) for i, t in enumerate(texts)], DOCUMENTS)
    slow = Slow([t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 5 != 1], 3)
    got = {r.doc_id: r.score for r in kneser_ney.digest(docs).collect()}
    assert all(math.isclose(got[i], slow.score(t), rel_tol=1e-9, abs_tol=1e-9) for i, t in enumerate(texts))


def test_language_model_without_texts(spark, odd, nothing):
    model = kneser_ney.fit(nothing, 2)
    assert {(r.n_known, r.base_score, r.score) for r in kneser_ney.score(odd, model).collect()} == {(0, 0.0, 0.0)}
    assert kneser_ney.digest(nothing).collect() == []


def test_hash_tells_texts_apart_that_collide_in_polynomials():
    thue = np.array([bin(i).count("1") & 1 for i in range(2048)], np.uint8) + 97
    data = np.concatenate([thue, 195 - thue, thue[:200], 195 - thue[:200]])
    starts, ends = np.array([0, 2048, 4096, 4296]), np.array([2048, 4096, 4296, 4496])
    assert len(set(strong_hash(data, starts, ends).tolist())) == 4
    rng = np.random.default_rng(1)
    raw = rng.integers(97, 100, 5000).astype(np.uint8)
    a = np.sort(rng.integers(0, 5000, 3000))
    b = np.minimum(a + rng.integers(0, 12, 3000), 5000)
    names = collections.defaultdict(set)
    for h, x, y in zip(strong_hash(raw, a, b).tolist(), a, b, strict=True):
        names[h].add(raw[x:y].tobytes())
    assert all(len(v) == 1 for v in names.values()) and len(names) == len({raw[x:y].tobytes() for x, y in zip(a, b, strict=True)})


# spelling variants


def slow_words(rows, every=199):
    counts = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += len(run) >= 6
    return {w: n for w, n in counts.items() if n >= 5}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def slow_variants(words):
    by_size = collections.defaultdict(list)
    for w in words:
        by_size[len(w)].append(w)
    near = {w: [x for s in (-1, 0, 1) for x in by_size[len(w) + s] if one_edit(w, x)] for w in words}
    form = {}
    for w, others in near.items():
        top = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = top if top is not None and words[top] >= 5 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=str)


def mistyped(rng, word):
    i = rng.randrange(len(word))
    c = rng.choice("abcdeé")
    return rng.choice([word[:i] + word[i + 1 :], word[:i] + c + word[i:], word[:i] + c + word[i + 1 :]])


@pytest.mark.parametrize("every", [199, 7])
def test_variants_equal_all_pairs(spark, odd, every):
    rng = random.Random(every)
    stock = ["".join(rng.choice(SMALL) for _ in range(rng.randint(3, 6))) for _ in range(60)] + ["aaaaaa", "aaaaaaa", "abababab", "ababababa", "aaaaaaaaaaaa"]
    lines = []
    for _ in range(400):
        words = [w if rng.random() < 0.6 else mistyped(rng, w) for w in rng.choices(stock, [1 / (i + 1) for i in range(len(stock))], k=40)]
        lines.append(" ".join(w.title() if rng.random() < 0.1 else w for w in words))
    docs = odd.unionByName(spark.createDataFrame([row(100 + i, t) for i, t in enumerate(lines)] + [row(900, "z" * 20_000 + " " + "q" * 9_999)] * 5 + [row(901, "chained " * 200 + "chainedo " * 35 + "chainedoo " * 6)], DOCUMENTS))
    words = slow_words([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], every)
    found = spelling.variants(docs, every=every)
    got = sorted((tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in found.collect()), key=str)
    assert got == slow_variants(words)
    assert sum(x[1] is not None for x in got) > 20 and any(x[2] not in (x[0], x[1]) for x in got if x[1])


SMALL = ["ab", "ba", "c", "de", "éa", "aa", "b"]


def test_affected_grams_bound_every_edit():
    rng = random.Random(8)
    words = ["".join(rng.choice(SMALL) for _ in range(rng.randint(3, 7))) for _ in range(400)]
    words = [w for w in words if len(w) >= 6]
    edits = {w: {mistyped(rng, w) for _ in range(6)} - {w} for w in words}
    counts = collections.Counter()
    for w in {*words, *(x for v in edits.values() for x in v)}:
        marked = spelling.OPEN + w + spelling.CLOSE
        counts.update(marked[p : p + q] for q in range(2, 7) for p in range(len(marked) - q + 1))
    for limit in (3, 20, 100):
        frequent = {g: n for g, n in counts.items() if n > limit}
        for w, others in edits.items():
            for x in others:
                size = min(len(w), len(x))
                grams = [[(spelling.OPEN + y + spelling.CLOSE)[p:e] for p, e in spelling.decompose(spelling.OPEN + y + spelling.CLOSE, frequent, spelling.longest_gram(size))] for y in (w, x)]
                shared = sum((collections.Counter(grams[0]) & collections.Counter(grams[1])).values())
                places = spelling.decompose(spelling.OPEN + w + spelling.CLOSE, frequent, spelling.longest_gram(size))
                assert shared >= len(places) - spelling.affected(places, len(w) + 2)
                assert {*spelling.signatures(w, frequent, size)} & {*spelling.signatures(x, frequent, size)}


def test_variants_without_words(nothing, spark):
    assert spelling.variants(nothing).collect() == []
    few = spark.createDataFrame([row(1, None), row(2, ""), row(3, "short words only " * 9)], DOCUMENTS)
    assert spelling.variants(few).collect() == []


# hard negatives


LIMIT = (1 << 63) - 1


def slow_negatives(rows, every=100, n=5, k=10):
    whole = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, lab, v) in enumerate(whole):
        if i % every:
            continue
        scored = sorted((-max(-LIMIT, min(LIMIT, sum(x * y for x, y in zip(v, w, strict=False)))), j, other) for b, (j, other, w) in enumerate(whole) if b != a)
        for low, j, _ in [x for x in scored if x[2] == lab][:n]:
            inside = [x for x in scored if x[2] != lab and -30 * low <= -100 * x[0] <= -90 * low][:k]
            out += [(i, j, r + 1, m, -low, -s) for r, (s, m, _) in enumerate(inside)]
    return sorted(out)


VECTORS = "vec_id bigint, embedding array<float>, label int, v int, score string, id string"


def test_negatives_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(negatives, "ANCHORS", 7)
    rng = random.Random(2)
    middle = [[rng.gauss(0, 0.3) for _ in range(8)] for _ in range(5)]
    rows = []
    for i in range(900):
        lab = rng.randrange(5)
        rows.append((i, [rng.gauss(m, 0.1) for m in middle[lab]], lab))
    rows += [(2000, None, 1), (2100, [None] * 8, 1), (2200, [float("nan")] * 8, 2), (2300, [float("inf")] * 8, 2), (None, [0.1] * 8, 1), (2400, [0.1] * 8, None), (2500, [], 3), (2600, [0.5], 3)]
    rows += [rows[100], rows[100], rows[205], rows[300]] + [(3000 + i, rows[50][1], rows[50][2]) for i in range(300)]  # repeated rows and ties
    df = spark.createDataFrame([(*r, 1, "s", "i") for r in rows], VECTORS)
    asked = [(r.vec_id, r.label, r.embedding) for r in df.collect()]
    found = negatives.mine(df)
    got = sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in found.collect())
    assert got == slow_negatives(asked) and len(got) > 300


def test_negatives_large_numbers(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) * 10.0 ** rng.choice([0, 5, 7]) for _ in range(4)], i % 3) for i in range(160)]
    df = spark.createDataFrame([(*r, 1, "s", "i") for r in rows], VECTORS)
    want = slow_negatives([(r.vec_id, r.label, r.embedding) for r in df.collect()])
    got = sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in negatives.mine(df).collect())
    assert got == want and any(abs(x[4]) == LIMIT for x in want)
    assert negatives.mine(df.filter("false")).collect() == []


def test_tree_bounds_hold_and_spare_work():
    rng = np.random.default_rng(4)
    a = np.floor(rng.normal(0, 4, (60, 16)) + 200 * rng.normal(0, 1, 16))
    c = np.floor(rng.normal(0, 20, (500, 16)))
    order, parent, edge = negatives.spanning_tree(a)
    tree = {"v": a[order], "parent": parent, "edge": edge, "norms": np.sqrt((a[order] ** 2).sum(1))}
    assert (parent[1:] < np.arange(1, 60)).all() and sorted(order) == list(range(60))
    true = c @ tree["v"].T
    cut = np.quantile(true, 0.99)

    def wanted(i, low, high):
        assert (low <= true[:, i] + 1e-6).all() and (high >= true[:, i] - 1e-6).all()
        return high >= cut

    got = {}
    done = negatives.walk(tree, c, wanted, lambda i, at, s: got.setdefault(i, dict(zip(at.tolist(), s.tolist(), strict=True))))
    for i in range(60):
        for j in np.flatnonzero(true[:, i] >= cut).tolist():
            assert got[i][j] == true[j, i]
    assert done < 0.5 * true.size
