"""Interpolated modified Kneser-Ney language model: counted in Spark, sorted hash arrays, mapped by the workers.

Words are counted first and numbered by the order of their hashes. N-grams of the highest order are then counted
by number, dealt to part files by the leading bits of a hash: that of the words before the last one from three words on, else
their own. Each part sends on what the next lower order needs: one for each different n-gram that ends in it (its
continuation count). What follows each context is complete in a part of three words or more and stored with it; pairs send it
on, so that a frequent word does not hold a part of its own.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tendril.llm.common import mix, row_groups, strong_hash, text_buffer, words
from tendril.session import materialize, scratch_root

#: Bytes of text that one step takes, and n-grams that a task holds before it sends them on.
GROUP, HELD = 1 << 22, 1 << 21
#: Bytes of training text for each part file, for each word of a context.
PART = 1 << 25
#: Bytes of a word's number as it is sent.
ID_BYTES = 5
END = np.uint64(0x51ED270B9F3A7C15)
FIELDS = ["c", "den", "n1", "n2", "n3"]
RECORDS = "bucket int, ids binary, c binary, den binary, n1 binary, n2 binary, n3 binary"
PARTS = "bucket int, path string, size bigint, total bigint, s1 bigint, s2 bigint, s3 bigint, s4 bigint"


def token_groups(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs of whole rows: first row, row after the last, the hash of each token, and where each row's tokens begin.

    A token is a word with A to Z in lower case, or the end that follows the last word of each row.
    """
    data, offsets = text_buffer(column)
    for lo, hi in row_groups(offsets, GROUP):
        part = data[offsets[lo] : offsets[hi]]
        part = part + ((part >= 65) & (part <= 90)).astype(np.uint8) * np.uint8(32)
        at = offsets[lo : hi + 1] - offsets[lo]
        start, end = words(part, at)
        row = np.searchsorted(at, start, "right") - 1
        bounds = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=hi - lo) + 1)])
        tokens = np.full(bounds[-1], END, np.uint64)
        tokens[np.arange(len(start)) + row] = strong_hash(part, start, end)
        yield lo, hi, tokens, bounds


def key_of(ids: np.ndarray) -> np.ndarray:
    """64-bit key of each row of word numbers."""
    h = mix(ids[:, 0].astype(np.uint64) + np.uint64(1))
    for j in range(1, ids.shape[1]):
        h = mix(h * np.uint64(0x9FB21C651E98DF25) ^ ids[:, j].astype(np.uint64))
    return h


def summed(key: np.ndarray, fields: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Different keys in order, where each stands first, and the sums of its fields."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
    return key[at], order[at], {k: np.add.reduceat(v[order], at) if len(at) else v[:0] for k, v in fields.items()}


def small(values: np.ndarray) -> np.ndarray:
    """The same counts in the least number of bytes each."""
    return values.astype(np.min_scalar_type(int(values.max(initial=0))))


def blobs(bucket: np.ndarray, ids: np.ndarray, fields: dict[str, np.ndarray]) -> pa.RecordBatch:
    """RECORDS of n-grams that are sorted by bucket and first word; bytes of equal weight stand together and first words are
    told by their distance, which compresses.
    """
    at = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.empty(0, np.int64)
    ends = np.append(at, len(bucket))
    ids = ids.astype("<i8")
    step = np.diff(ids[:, 0], prepend=0)
    step[at] = ids[at, 0]
    ids[:, 0] = step
    planes = np.ascontiguousarray(ids).view(np.uint8).reshape(len(ids), ids.shape[1], 8)[:, :, :ID_BYTES]
    cut = list(zip(ends[:-1], ends[1:], strict=True))
    columns = [pa.array([planes[a:b].transpose(1, 2, 0).tobytes() for a, b in cut], pa.binary())]
    for name in FIELDS:
        columns.append(pa.array([small(fields[name][a:b]).tobytes() if name in fields else b"" for a, b in cut], pa.binary()))
    return pa.RecordBatch.from_arrays([pa.array(bucket[at].astype(np.int32)), *columns], names=["bucket", "ids", *FIELDS])


def opened(table: pa.Table, width: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """What ``blobs`` has packed, all rows in one."""
    ids, fields = [], {name: [] for name in FIELDS}
    for row in table.select(["ids", *FIELDS]).to_pylist():
        n = len(row["ids"]) // (width * ID_BYTES)
        full = np.zeros((n, width, 8), np.uint8)
        full[:, :, :ID_BYTES] = np.frombuffer(row["ids"], np.uint8).reshape(width, ID_BYTES, n).transpose(2, 0, 1)
        ids.append(full.view("<i8")[:, :, 0])
        np.cumsum(ids[-1][:, 0], out=ids[-1][:, 0])
        for name in FIELDS:
            raw = row[name]
            fields[name].append(np.frombuffer(raw, f"<u{len(raw) // n}").astype(np.int64) if raw else np.zeros(n, np.int64))
    return np.concatenate(ids), {name: np.concatenate(v) for name, v in fields.items()}


def of_counts(c: np.ndarray) -> list[int]:
    """Total, and how many counts are 1, 2, 3 and 4."""
    return [int(c.sum()), *(int((c == i).sum()) for i in (1, 2, 3, 4))]


def stored(folder: str, name: str, arrays: dict[str, np.ndarray]) -> str:
    """Writes the arrays under a name that no other attempt of the task has; only the one that ends is listed."""
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    os.makedirs(folder, exist_ok=True)
    for key, values in arrays.items():
        np.save(f"{path}.{key}.npy", values)
    return path


def listed(bucket: int, path: str, size: int, stats: list[int]) -> pa.Table:
    """One row of PARTS."""
    names = [c.split()[0] for c in PARTS.split(", ")]
    kinds = [pa.int32(), pa.string(), *[pa.int64()] * 6]
    return pa.table({n: pa.array([v], k) for n, k, v in zip(names, kinds, [bucket, path, size, *stats], strict=True)})


@dataclass
class Model:
    """Where the parts of each order lie, and the few numbers that hold for all of them."""

    order: int
    bits: int
    paths: dict[int, list[str | None]] = field(default_factory=dict)
    #: Number of the first word of each word part; the last entry is the number of words.
    first: np.ndarray = field(default_factory=lambda: np.zeros(2, np.int64))
    tokens: int = 0
    discounts: dict[int, np.ndarray] = field(default_factory=dict)
    #: Continuations of the empty context: total and how many words have 1, 2, or more.
    whole: tuple[int, int, int, int] = (0, 0, 0, 0)

    def mapped(self, level: int, bucket: int, name: str) -> np.ndarray:
        at = (level, bucket, name)
        cache = self.__dict__.setdefault("_maps", {})
        if at not in cache:
            cache[at] = np.load(f"{self.paths[level][bucket]}.{name}.npy", mmap_mode="r")
        return cache[at]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_maps"}

    def by_key(self, level: int, keys: np.ndarray, names: list[str], index: str = "key", dealt: np.ndarray | None = None) -> list[np.ndarray]:
        """Fields of keys (0 where a key is not stored) from the parts of a level; level 0 are the words: their number, or -1.

        ``dealt`` are the keys by which each was dealt to its part, if not its own.
        """
        wanted, first, back = np.unique(keys, return_index=True, return_inverse=True)
        if dealt is not None:  # by part, and by key within each
            order = np.argsort(dealt[first] >> np.uint64(64 - self.bits), kind="stable")
            wanted, first, back = wanted[order], first[order], np.argsort(order)[back]
        out = [np.full(len(wanted), -1 if name == "id" else 0, np.int64) for name in names]
        parts = (wanted if dealt is None else dealt[first]) >> np.uint64(64 - self.bits)
        edges = np.searchsorted(parts, np.arange((1 << self.bits) + 1).astype(np.uint64))
        for bucket, path in enumerate(self.paths[level]):
            lo, hi = edges[bucket], edges[bucket + 1]
            if lo == hi or path is None:
                continue
            stored = self.mapped(level, bucket, index)
            at = np.minimum(np.searchsorted(stored, wanted[lo:hi]), len(stored) - 1)
            hit = np.flatnonzero(stored[at] == wanted[lo:hi])
            kinds = self.mapped(level, bucket, "kinds")[self.mapped(level, bucket, "kind")[at[hit]]] if index == "context" else None
            for values, name in zip(out, names, strict=True):
                if kinds is not None:
                    values[lo + hit] = kinds[:, FIELDS.index(name) - 1]
                else:
                    values[lo + hit] = self.first[bucket] + at[hit] if name == "id" else self.mapped(level, bucket, name)[at[hit]]
        return [values[back] for values in out]

    def by_word(self, ids: np.ndarray, names: list[str]) -> list[np.ndarray]:
        """Fields of the lowest order for word numbers (0 for -1); the number after the last word is the beginning of a text."""
        wanted, back = np.unique(ids, return_inverse=True)
        out = [np.zeros(len(wanted), np.int64) for _ in names]
        edges = np.searchsorted(wanted, np.append(self.first[:-1], self.first[-1] + 1))
        for bucket, path in enumerate(self.paths[1]):
            lo, hi = edges[bucket], edges[bucket + 1]
            if lo < hi and path is not None:
                for values, name in zip(out, names, strict=True):
                    values[lo:hi] = self.mapped(1, bucket, name)[wanted[lo:hi] - self.first[bucket]]
        return [values[back] for values in out]

    def reduced(self, level: int, c: np.ndarray) -> np.ndarray:
        """Counts less the discount of their level: one for counts of 1, 2, and 3 or more."""
        return np.maximum(c - np.concatenate([[0.0], self.discounts[level]])[np.minimum(c, 3)], 0.0)

    def free(self, level: int, n1, n2, n3):
        """What the discounts of a context leave for the lower order."""
        d = self.discounts[level]
        return d[0] * n1 + d[1] * n2 + d[2] * n3

    def probabilities(self, tokens: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of each token after those before it in its row, and its count in the training texts."""
        n_words = int(self.first[-1])
        ids, counts = self.by_key(0, tokens, ["id", "c"])
        place = np.arange(len(tokens)) - np.repeat(bounds[:-1], np.diff(bounds))
        total, *rest = self.whole
        unknown = (self.free(1, *rest) / total if total else 1.0) / (n_words + 1)
        p = unknown + (self.reduced(1, self.by_word(ids, ["c"])[0]) / total if total else 0.0)
        window = ids[:, None]
        for level in range(2, self.order + 1):
            before = np.full(len(ids), n_words, np.int64)
            far = np.flatnonzero(place >= level - 1)
            before[far] = ids[far - level + 1]
            window = np.concatenate([before[:, None], window], 1)
            key, context = key_of(window), window[:, :-1]
            above = key_of(context)
            c = np.where((window >= 0).all(1), self.by_key(level, key, ["c"], dealt=above if level > 2 else None)[0], 0)
            names = ["den", "n1", "n2", "n3"]
            den, *rest = self.by_word(context[:, 0], names) if level == 2 else self.by_key(level, above, names, "context")
            seen = (den > 0) & (context >= 0).all(1)
            den = np.maximum(den, 1)
            p = np.where(seen, self.reduced(level, c) / den + self.free(level, *rest) / den * p, p)
        return p, counts


def discounts(s1: int, s2: int, s3: int, s4: int) -> np.ndarray:
    """Discounts of counts 1, 2, 3 and more from how many n-grams have 1 to 4.

    Fixed ones where a count of counts is 0 or a discount is not above 0: it must leave something for words not seen.
    """
    fixed = np.array([0.5, 1.0, 1.5])
    if min(s1, s2, s3, s4) == 0:
        return fixed
    y = s1 / (s1 + 2 * s2)
    d = np.array([1 - 2 * y * s2 / s1, 2 - 3 * y * s3 / s2, 3 - 4 * y * s4 / s3])
    return d if (d > 0).all() else fixed


def fit(docs: DataFrame, order: int = 3, text: str = "text") -> Model:
    """The model of all texts of ``docs`` (null: empty), with contexts of up to ``order`` - 1 words.

    Texts are read twice and n-grams shuffled once as sorted blobs, equal ones of a task as one. The files lie in the
    shared folder of the session, which workers must be able to open as a path. No text at all gives a model
    in which nothing is known.
    """
    if order < 2:
        raise ValueError("the order is 2 at least")
    spark = docs.sparkSession
    root = scratch_root(spark)
    if "://" in root and not root.startswith("file://"):
        raise ValueError(f"workers map files of {root}: mount it and name it as a path")
    folder = f"{root.removeprefix('file://').removeprefix('file:')}/tendril/ngrams-{uuid.uuid4().hex}"
    texts = docs.select(F.col(f"`{text}`").alias("text"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = int(np.clip(np.ceil(np.log2(max(1, size) * (order - 1) / PART)), 1, 20))
    shift = np.uint64(64 - bits)
    model = Model(order, bits)

    def parts_of(rows: DataFrame, level: int) -> list:
        """Reads the list of part files, one row each, in the order of their keys."""
        found = {r.bucket: r for r in rows.collect()}
        model.paths[level] = [found[b].path if b in found else None for b in range(1 << bits)]
        return [found.get(b) for b in range(1 << bits)]

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for _, _, tokens, _ in token_groups(batch.column(0)):
                held.append(np.unique(tokens, return_counts=True))
                n += len(held[-1][0])
                if n > HELD:
                    yield word_blobs(held)
                    held, n = [], 0
        if held:
            yield word_blobs(held)

    def word_blobs(held: list) -> pa.RecordBatch:
        key, _, fields = summed(np.concatenate([k for k, _ in held]), {"c": np.concatenate([c for _, c in held])})
        bucket = (key >> shift).astype(np.int64)
        at = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        cut = list(zip(at, np.append(at, len(key))[1:], strict=True))
        raw = [pa.array([key[a:b].tobytes() for a, b in cut], pa.binary()), pa.array([small(fields["c"][a:b]).tobytes() for a, b in cut], pa.binary())]
        return pa.RecordBatch.from_arrays([pa.array(bucket[at].astype(np.int32)), *raw], names=["bucket", "keys", "c"])

    def word_part(table: pa.Table) -> pa.Table:
        keys, counts = [], []
        for row in table.to_pylist():
            keys.append(np.frombuffer(row["keys"], np.uint64))
            counts.append(np.frombuffer(row["c"], f"<u{len(row['c']) // len(keys[-1])}").astype(np.int64))
        key, _, fields = summed(np.concatenate(keys), {"c": np.concatenate(counts)})
        path = stored(folder, "words", {"key": key, "c": small(fields["c"])})
        return listed(table.column("bucket")[0].as_py(), path, len(key), of_counts(fields["c"]))

    counted = texts.mapInArrow(count_words, "bucket int, keys binary, c binary").groupBy("bucket").applyInArrow(word_part, PARTS)
    rows = parts_of(materialize(counted, "words"), 0)
    model.first = np.concatenate([[0], np.cumsum([r.size if r else 0 for r in rows])]).astype(np.int64)
    model.tokens = sum(r.total for r in rows if r)
    n_words = int(model.first[-1])
    shared = spark.sparkContext.broadcast(model)

    def bucket_of(key: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Part of an n-gram; single words lie where their number is, three words or more where their context is."""
        if ids.shape[1] > 1:
            return ((key if ids.shape[1] == 2 else key_of(ids[:, :-1])) >> shift).astype(np.int64)
        return np.minimum(np.searchsorted(model.first, ids[:, 0], "right") - 1, (1 << bits) - 1)

    def sent(ids: np.ndarray, fields: dict[str, np.ndarray]) -> pa.RecordBatch:
        key, at, fields = summed(key_of(ids), fields)
        bucket = bucket_of(key, ids[at])
        order_ = np.argsort(bucket << (8 * ID_BYTES) | ids[at, 0], kind="stable")
        bucket, at, fields = bucket[order_], at[order_], {k: v[order_] for k, v in fields.items()}
        return blobs(bucket, ids[at], fields)

    def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for _, _, tokens, bounds in token_groups(batch.column(0)):
                ids = shared.value.by_key(0, tokens, ["id"])[0]
                place = np.arange(len(ids)) - np.repeat(bounds[:-1], np.diff(bounds))
                window = [ids]
                for back in range(1, order):
                    before = np.full(len(ids), n_words, np.int64)
                    far = np.flatnonzero(place >= back)
                    before[far] = ids[far - back]
                    window.insert(0, before)
                grams = np.stack(window, 1)
                _, at, fields = summed(key_of(grams), {"c": np.ones(len(grams), np.int64)})
                held.append((grams[at], fields["c"]))
                n += len(at)
                if n > HELD:
                    yield sent(np.concatenate([g for g, _ in held]), {"c": np.concatenate([c for _, c in held])})
                    held, n = [], 0
        if held:
            yield sent(np.concatenate([g for g, _ in held]), {"c": np.concatenate([c for _, c in held])})

    def gram_part(level: int):
        """Stores a part of a level and sends on what the level below needs."""

        def run(table: pa.Table) -> pa.Table:
            ids, fields = opened(table, level)
            key, at, fields = summed(key_of(ids), fields)
            ids, c = ids[at], fields["c"]
            follow = {"den": c, "n1": (c == 1).astype(np.int64), "n2": (c == 2).astype(np.int64), "n3": (c > 2).astype(np.int64)}
            arrays, passed = {"key": key, "c": small(c)}, []
            if level > 2:
                above, _, follow = summed(key_of(ids[:, :-1]), follow)
                what = np.stack([follow[name] for name in FIELDS[1:]], 1)  # few different ones
                _, one, kind = np.unique(key_of(what), return_index=True, return_inverse=True)
                arrays |= {"context": above, "kinds": what[one], "kind": small(kind)}
            else:
                passed.append(sent(ids[:, :-1], follow))
            path = stored(folder, f"order{level}", arrays)
            out = listed(table.column("bucket")[0].as_py(), path, len(key), of_counts(c))
            passed.append(sent(ids[:, 1:], {"c": np.ones(len(c), np.int64)}))
            return pa.concat_tables([out, pa.Table.from_batches(passed)], promote_options="default").select(names)

        return run

    def words_part(table: pa.Table) -> pa.Table:
        """The lowest order: fields of the words of a part in the order of their numbers."""
        bucket = table.column("bucket")[0].as_py()
        ids, fields = opened(table, 1)
        lo, hi = int(model.first[bucket]), int(model.first[bucket + 1]) + (1 if bucket == (1 << bits) - 1 else 0)
        dense = {}
        for name in FIELDS:
            dense[name] = np.zeros(hi - lo, np.int64)
            np.add.at(dense[name], ids[:, 0] - lo, fields[name])
        path = stored(folder, "order1", {k: small(v) for k, v in dense.items()})
        return listed(bucket, path, int((dense["c"] > 0).sum()), of_counts(dense["c"]))

    both = f"{PARTS}, {RECORDS.removeprefix('bucket int, ')}"
    names = [c.split()[0] for c in both.split(", ")]
    records = texts.mapInArrow(count_grams, RECORDS) if n_words else None
    for level in range(order, 0, -1):
        if records is None:
            model.paths[level], rows = [None] * (1 << bits), []
        elif level > 1:
            done = materialize(records.groupBy("bucket").applyInArrow(gram_part(level), both), f"order{level}")
            rows = parts_of(done.filter("path is not null").select("bucket", "path", "size", "total", "s1", "s2", "s3", "s4"), level)
            records = done.filter("path is null").select("bucket", "ids", *FIELDS)
        else:
            rows = parts_of(materialize(records.groupBy("bucket").applyInArrow(words_part, PARTS), "order1"), 1)
        sums = [sum(r[k] for r in rows if r) for k in ("total", "s1", "s2", "s3", "s4", "size")]
        model.discounts[level] = discounts(*sums[1:5])
        model.whole = (sums[0], sums[1], sums[2], sums[5] - sums[1] - sums[2])
    return model


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, n_known, base_score, score, perplexity) of every row, null text as empty.

    ``score`` is the log10 probability of the tokens, the end included; ``base_score`` that of single words with half
    a count added to each. Rows never meet. Workers map the parts of the model that their words need.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    plain = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        n_words = int(m.first[-1])
        for batch in batches:
            for lo, hi, tokens, bounds in token_groups(batch.column(1)):
                p, counts = m.probabilities(tokens, bounds)
                sums = [np.add.reduceat(x, bounds[:-1]) for x in ((counts > 0).astype(np.int64), np.log10((counts + 0.5) / (m.tokens + 0.5 * (n_words + 1))), np.log10(p))]
                n = np.diff(bounds)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *map(pa.array, (n, *sums, 10.0 ** (-sums[2] / n)))], names=["key", "n_tokens", "n_known", "base_score", "score", "perplexity"])

    kind = plain.schema["key"].dataType.simpleString()
    out = plain.mapInArrow(run, f"key {kind}, n_tokens bigint, n_known bigint, base_score double, score double, perplexity double")
    return out.withColumnRenamed("key", key)


def held_out(key: Column) -> Column:
    """Rows whose crc32 of the id as text leaves 1 when divided by 5; a null id has an empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 1


def digest(docs: DataFrame, order: int = 3, key: str = "doc_id") -> DataFrame:
    model = fit(docs.filter(~held_out(F.col(f"`{key}`"))), order)
    found = score(docs, model, key)
    return found.select(key, held_out(F.col(f"`{key}`")).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("bigint").alias("train_tokens"), "base_score", "score", "perplexity")
