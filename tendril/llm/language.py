"""Language of texts by a convolutional network over bytes: filters of several widths, max pooling, softmax."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tendril.llm.common import text_buffer

WIDTHS, FILTERS = (2, 3, 4), 16
#: Bytes of a window, and windows that one vectorised step handles.
LENGTH, STEP = 256, 128
CLASSES = 64
UNKNOWN = "und"
LETTER = r"\p{L}"


def fold(data: np.ndarray) -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[data]


@dataclass
class Network:
    """Byte classes, filter weights (width, class, filter) and the dense layer over the pooled filters."""

    classes: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    dense: np.ndarray
    dense_bias: np.ndarray
    names: list[str]

    def activations(self, x: np.ndarray) -> list[np.ndarray]:
        """Filter responses (window, place, filter) of each width."""
        out = []
        for w, bias in zip(self.filters, self.bias, strict=True):
            n = x.shape[1] - len(w) + 1
            z = w[0][x[:, :n]] + bias
            for j in range(1, len(w)):
                z += w[j][x[:, j : j + n]]
            out.append(z)
        return out

    def tables(self) -> None:
        """Responses to pairs of byte classes, so that a filter takes one lookup for two bytes."""
        c = len(self.filters[0][0])
        self.count = c
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(c * c, -1)
        self.quick = [[pair(w[j], w[j + 1]) if j + 1 < len(w) else w[j] for j in range(0, len(w), 2)] for w in self.filters]
        for q, b in zip(self.quick, self.bias, strict=True):
            q[0] = q[0] + b

    def pooled(self, x: np.ndarray) -> np.ndarray:
        pairs = x[:, :-1] * self.count + x[:, 1:]
        out = []
        for w, quick in zip(self.filters, self.quick, strict=True):
            n = x.shape[1] - len(w) + 1
            z = quick[0][pairs[:, :n]]
            for j, q in enumerate(quick[1:], 1):
                z += q[(pairs if 2 * j + 1 < len(w) else x)[:, 2 * j : 2 * j + n]]
            out.append(z.max(1))
        return np.maximum(np.concatenate(out, 1), 0)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return softmax(self.pooled(x) @ self.dense + self.dense_bias)


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def windows(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Byte classes of the windows that begin at ``starts``; class 0 beyond ``ends``."""
    at = starts[:, None] + np.arange(LENGTH)
    x = classes[data[np.minimum(at, len(data) - 1)]].astype(np.int64)
    x[at >= ends[:, None]] = 0
    return x


def train(texts: list[str], labels: list[str], epochs: int = 6, batch: int = 32, rate: float = 0.01, seed: int = 7) -> Network:
    """Adam on cross entropy. Max pooling sends each filter's gradient to one place of the window."""
    names = sorted(set(labels))
    rng = np.random.default_rng(seed)
    raw = [t.encode() for t in texts]
    data = fold(np.frombuffer(b"".join(raw), np.uint8))
    sizes = np.array([len(r) for r in raw])
    ends = np.cumsum(sizes)
    common = np.argsort(-np.bincount(data, minlength=256), kind="stable")[: CLASSES - 2]
    classes = np.ones(256, np.uint8)
    classes[common] = np.arange(2, 2 + len(common))
    classes = classes[fold(np.arange(256, dtype=np.uint8))]
    x = windows(data, ends - sizes, ends, classes)
    y = np.searchsorted(names, labels)
    scale = lambda w: 0.3 / np.sqrt(w)
    net = Network(
        classes, [rng.normal(0, scale(w), (w, CLASSES, FILTERS)).astype(np.float32) for w in WIDTHS], [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
        rng.normal(0, 0.2, (FILTERS * len(WIDTHS), len(names))).astype(np.float32), np.zeros(len(names), np.float32), names,
    )
    params = [*net.filters, *net.bias, net.dense, net.dense_bias]
    first, second = ([np.zeros_like(p) for p in params] for _ in range(2))
    steps = 0
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // batch)):
            xb = x[at]
            z = net.activations(xb)
            places = [a.argmax(1) for a in z]
            peak = np.concatenate([np.take_along_axis(a, p[:, None], 1)[:, 0] for a, p in zip(z, places, strict=True)], 1)
            hidden = np.maximum(peak, 0)
            error = softmax(hidden @ net.dense + net.dense_bias)
            error[np.arange(len(at)), y[at]] -= 1
            error /= len(at)
            back = (error @ net.dense.T) * (peak > 0)
            grads = [np.zeros_like(p) for p in params]
            for k, p in enumerate(places):
                part = back[:, k * FILTERS : (k + 1) * FILTERS]
                for j in range(WIDTHS[k]):
                    np.add.at(grads[k][j], (np.take_along_axis(xb, p + j, 1), np.arange(FILTERS)[None]), part)
                grads[len(WIDTHS) + k] = part.sum(0)
            grads[-2], grads[-1] = hidden.T @ error, error.sum(0)
            steps += 1
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.999**steps)) + 1e-8)
    net.tables()
    return net


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 500, most: int = 6000) -> Network | None:
    """Trains on at most ``per_language`` labelled rows a language and ``most`` in all, a window from each.

    Only rows that are not held out, with a language and a letter in the text. Rows are drawn by a
    hash of the text; only the drawn windows reach the driver. None if there is no such row.
    """
    body, k = F.col(f"`{text}`"), F.col(f"`{key}`")
    rows = docs.filter(k.isNotNull() & F.col(f"`{lang}`").isNotNull() & body.rlike(LETTER) & ~held_out(k))
    order = F.xxhash64(body)
    begin = F.pmod(order, F.greatest(F.length(body) - LENGTH, F.lit(1)).cast("bigint")) + 1
    pieces = rows.select(F.col(f"`{lang}`").alias("lang"), order.alias("o"), F.substring(body, begin.cast("int"), F.lit(LENGTH)).alias("piece"))
    drawn = pieces.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("o", "piece"))).filter(F.col("n") <= per_language)
    sample = drawn.orderBy("n", "lang", "piece").limit(most).select("piece", "lang").toPandas()
    if not len(sample):
        return None
    return train(sample["piece"].tolist(), sample["lang"].tolist())


def judged(column: pa.Array, letters: np.ndarray, net: Network | None) -> tuple[np.ndarray, np.ndarray]:
    """Language and score of each text: window probabilities averaged by bytes."""
    data, offsets = text_buffer(column)
    n = len(column)
    sums = np.zeros((n, len(net.names) if net else 1))
    if net and len(data):
        counts = np.where(letters, -(-np.diff(offsets) // LENGTH), 0)
        of = np.repeat(np.arange(n), counts)
        starts = offsets[of] + LENGTH * (np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts))
        ends = offsets[of + 1]
        for lo in range(0, len(of), STEP):
            s, e = starts[lo : lo + STEP], ends[lo : lo + STEP]
            np.add.at(sums, of[lo : lo + STEP], net.predict(windows(data, s, e, net.classes)) * np.minimum(e - s, LENGTH)[:, None])
    total = sums.sum(1)
    known = letters & (total > 0)
    shares = sums / np.where(total > 0, total, 1)[:, None]
    names = np.array(net.names if net else [UNKNOWN], object)[shares.argmax(1)]
    names[~known] = UNKNOWN
    return names, np.where(known, np.minimum(shares.max(1), 1.0), 0.0)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(LETTER), F.lit(False))


def predict(docs: DataFrame, net: Network | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, lang_pred, score): one row per row of ``docs``.

    Every text is cut into windows of LENGTH bytes; the probabilities are averaged over all of them,
    weighted by their bytes. Null text, text without a letter and an untrained network give ``und`` with
    score 0. A null key is not held out and not learned from. Rows never meet: no shuffle.
    """
    body = F.col(f"`{text}`")
    plain = docs.select(F.col(f"`{key}`").alias("key"), body.alias("text"), has_letter(body).alias("letter"))
    schema = T.StructType([plain.schema["key"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = judged(batch.column(1), batch.column(2).to_numpy(zero_copy_only=False).astype(bool), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores)], names=schema.names)

    return plain.mapInArrow(run, schema).select(F.col("key").alias(key), held_out(F.col("key")).alias("held_out"), "lang_pred", "score")


def known_language(docs: DataFrame, least: float = 0.4, text: str = "text") -> DataFrame:
    """The rows whose language is known: a letter in the text, and a score of ``least`` or more. All columns stay."""
    net, schema = fit(docs, text=text), docs.schema
    at = docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = judged(batch.column(at), batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(bool), shared.value)
            own = pa.RecordBatch.from_arrays(batch.columns[:-1], names=schema.names)
            yield own.filter(pa.array((names != UNKNOWN) & (scores >= least)))

    free = "_" * (1 + max(map(len, docs.columns)))  # a name that no column has
    marked = docs.select("*", has_letter(F.col(f"`{text}`")).alias(free))
    return marked.mapInArrow(run, schema)
