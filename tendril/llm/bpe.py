"""Byte-level BPE by speculation: greedy longest match, pair checks, exact merges only where a check fails.

A token sequence is what the merges yield if and only if every two neighbours are: the text of
the pair, merged on its own, gives the same two tokens. The check unwinds the merges on both sides
of the border and looks for a merge across it that would have come first.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tendril.llm.common import gather, keep_columns, row_groups, text_buffer

#: Fixed value: the split of text into words that belongs to this kind of vocabulary. White_Space is
#: spelled out because the regex library's ``\s`` has four control characters more.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Distinct words that a worker remembers, for as long as it lives; beyond it only those met again stay.
MEMORY = 120_000
CHARS = 1 << 20
#: Bytes of a word up to which all words of a batch go byte by byte together; longer ones go alone, with the same result.
STEPS = 64
NEVER = np.iinfo(np.int64).max


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and the words met so far."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        letters = byte_letters()
        spell = lambda token: bytes(letters[c] for c in token)
        model = file["model"]
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.ids = {spell(k): v for k, v in model["vocab"].items() if k not in self.special}
        size = max([*self.ids.values(), *self.special.values()]) + 1
        text = [b""] * size
        for k, v in self.ids.items():
            text[v] = k
        for k, v in self.special.items():
            text[v] = k.encode()
        self.lengths = np.array([len(t) for t in text], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(text), np.uint8)
        self.text = text
        self.longest = max(map(len, self.ids))
        self.merges = {}
        self.rank = np.full(size, -1, np.int64)
        self.left, self.right = np.arange(size), np.arange(size)
        for r, pair in enumerate(model["merges"]):
            a, b = (spell(x) for x in (pair if isinstance(pair, list) else pair.split(" ")))
            whole = self.ids[a + b]
            a, b = self.ids[a], self.ids[b]
            self.merges[a, b] = (r, whole)
            if self.rank[whole] < 0:
                self.rank[whole], self.left[whole], self.right[whole] = r, a, b
        codes = np.array([a * size + b for a, b in self.merges], np.int64)
        order = np.argsort(codes)
        self.size, self.codes = size, np.append(codes[order], np.iinfo(np.int64).max)
        self.code_ranks = np.append(np.array([r for r, _ in self.merges.values()], np.int64)[order], 0)
        self.code_wholes = np.append(np.array([w for _, w in self.merges.values()], np.int64)[order], 0)
        self.byte_ids = np.array([self.ids[bytes([b])] for b in range(256)], np.int64)
        self.grow()
        self.word = regex.compile(SPLIT).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.known: dict[str, int] = {}
        self.counts, self.begins, self.flat = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)
        self.again = np.empty(0, bool)

    def forget(self) -> None:
        """Drops the words not met again since they were kept last; all, if more than half would stay."""
        keep = np.flatnonzero(self.again)
        keep = keep if len(keep) <= MEMORY // 2 else keep[:0]
        words = list(self.known)
        self.known = {words[i]: k for k, i in enumerate(keep.tolist())}
        lengths = self.counts[keep]
        self.flat = self.flat[gather(self.begins[keep], lengths)]
        self.counts, self.begins, self.again = lengths, np.cumsum(lengths) - lengths, np.zeros(len(keep), bool)

    def grow(self) -> None:
        """The tree of the tokens' prefixes: steps (node * 256 + byte) in order, the node behind each, the token of each node."""
        nodes, steps, token = {b"": 0}, [], [-1]
        for text, i in self.ids.items():
            node = 0
            for k in range(1, len(text) + 1):
                if (to := nodes.get(text[:k])) is None:
                    to = nodes[text[:k]] = len(token)
                    steps.append((node * 256 + text[k - 1], to))
                    token.append(-1)
                node = to
            token[node] = i
        steps.sort()
        self.steps = np.array([*[c for c, _ in steps], NEVER], np.int64)
        self.behind = np.array([*[n for _, n in steps], 0], np.int64)
        self.token = np.array(token, np.int64)

    def propose(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The greedy longest matches of all words at once: at each byte where a token begins its id, elsewhere -1."""
        out = np.full(len(data), -1, np.int64)
        at, pos, stop, end = start, start, start, end
        node, best = np.zeros(len(at), np.int64), np.full(len(at), -1, np.int64)
        while len(at):
            inside = pos < end
            code = node * 256 + data[np.where(inside, pos, at)]
            k = np.searchsorted(self.steps, code)
            hit = inside & (self.steps[k] == code)
            node, pos = self.behind[k], pos + 1
            token = self.token[node]
            whole = hit & (token >= 0)
            best, stop = np.where(whole, token, best), np.where(whole, pos, stop)
            done = np.flatnonzero(~hit)
            if len(done):
                out[at[done]] = best[done]
                at = at.copy()
                at[done] = pos[done] = stop[done]
                node[done], best[done] = 0, -1
                live = at < end
                at, pos, stop, end, node, best = (x[live] for x in (at, pos, stop, end, node, best))
        return out

    def merge_all(self, data: np.ndarray, start: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The merges of all words at once, in each round the first of the lowest rank of each word: places and tokens."""
        where = gather(start, lengths)
        token = self.byte_ids[data[where]]
        rank = np.full(len(token), NEVER >> 32, np.int64)
        ends = np.cumsum(lengths)
        last = np.zeros(len(token), bool)
        last[ends - 1] = True
        places, tokens = [], []

        def look(i: np.ndarray) -> None:
            i = i[~last[i]]
            code = token[i] * self.size + token[i + 1]
            k = np.searchsorted(self.codes, code)
            rank[i] = np.where(self.codes[k] == code, self.code_ranks[k], NEVER >> 32)

        look(np.arange(len(token)))
        while len(lengths):
            first = np.cumsum(lengths) - lengths
            least = np.minimum.reduceat((rank << 32) + np.arange(len(rank)), first)
            go = (least >> 32) < (NEVER >> 32)
            if not go.all():
                of = np.repeat(go, lengths)
                places.append(where[~of])
                tokens.append(token[~of])
                least = least[go] - np.repeat(np.cumsum(np.where(go, 0, lengths)), go)
                where, token, rank, last, lengths = where[of], token[of], rank[of], last[of], lengths[go]
            i = least & 0xFFFFFFFF
            token[i] = self.code_wholes[np.searchsorted(self.codes, token[i] * self.size + token[i + 1])]
            last[i] = last[i + 1]
            rank[i] = NEVER >> 32
            keep = np.ones(len(token), bool)
            keep[i + 1] = False
            i = i - np.arange(len(i))
            where, token, rank, last, lengths = where[keep], token[keep], rank[keep], last[keep], lengths - 1
            look(np.concatenate([i, i[i > 0] - 1]))
        return np.concatenate([np.empty(0, np.int64), *places]), np.concatenate([np.empty(0, np.int64), *tokens])

    def greedy(self, word: bytes) -> list[int]:
        ids, out, i, n = self.ids, [], 0, len(word)
        while i < n:
            j = min(n, i + self.longest)
            while (t := ids.get(word[i:j])) is None:
                j -= 1
            out.append(t)
            i = j
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the text of each pair gives the pair: all pairs unwind in step.

        Of the two border tokens the one merged last is unwound first; a merge across the border
        whose rank is below the ranks unwound so far would have gone before.
        """
        good, live = np.ones(len(a), bool), np.arange(len(a))
        a, b, bound = a.astype(np.int64), b.astype(np.int64), np.full(len(a), np.iinfo(np.int64).max)
        strict = np.ones(len(a), bool)
        while len(live):
            code = a * self.size + b
            at = np.searchsorted(self.codes, code)
            rank = self.code_ranks[at]
            across = self.codes[at] == code
            bad = across & ((rank < bound) | (~strict & (rank == bound)))
            good[live[bad]] = False
            ra, rb = self.rank[a], self.rank[b]
            left = ra > rb
            go = ~bad & ((ra >= 0) | (rb >= 0))
            # What is left of the border was merged earlier on equal ranks: a tie across the border
            # lies right of a merge of the left token and left of one of the right token.
            bound, strict = np.where(left, ra, rb), left
            a, b = np.where(left, self.right[a], a), np.where(left, b, self.left[b])
            live, a, b, bound, strict = live[go], a[go], b[go], bound[go], strict[go]
        return good

    def learn(self, fresh: list[str]) -> None:
        """Adds words: proposals for all, checks of all their pairs at once, merges for the rest."""
        raw = [w.encode() for w in fresh]
        lengths = np.array([len(w) for w in raw], np.int64)
        start = np.cumsum(lengths) - lengths
        data = np.frombuffer(b"".join(raw), np.uint8)
        short = lengths <= STEPS
        # at[i] is the token that begins at byte i, -1 inside of tokens.
        at = self.propose(data, start[short], (start + lengths)[short])
        for w in np.flatnonzero(~short).tolist():
            self.put(at, start[w], self.greedy(raw[w]))
        of = np.repeat(np.arange(len(raw)), lengths)[at >= 0]
        flat = at[at >= 0]
        inside = of[:-1] == of[1:]
        code, back = np.unique((flat[:-1] * self.size + flat[1:])[inside], return_inverse=True)
        fine = self.compatible(code // self.size, code % self.size)
        wrong = np.unique(of[:-1][inside][~fine[back]])
        together = wrong[short[wrong]]
        at[gather(start[together], lengths[together])] = -1
        places, tokens = self.merge_all(data, start[together], lengths[together])
        at[places] = tokens
        for w in wrong[~short[wrong]].tolist():
            at[start[w] : start[w] + lengths[w]] = -1
            self.put(at, start[w], self.merge_long(raw[w]))
        self.counts = np.concatenate([self.counts, np.add.reduceat((at >= 0).astype(np.int64), start)])
        self.flat = np.concatenate([self.flat, at[at >= 0].astype(np.int32)])

    def put(self, at: np.ndarray, start: int, tokens: list[int]) -> None:
        """Writes the tokens of one word to the bytes where they begin."""
        ids = np.array(tokens, np.int64)
        at[start + np.cumsum(self.lengths[ids]) - self.lengths[ids]] = ids

    def merge(self, word: bytes) -> list[int]:
        """The merges of one word."""
        places, tokens = self.merge_all(np.frombuffer(word, np.uint8), np.zeros(1, np.int64), np.array([len(word)]))
        return tokens[np.argsort(places)].tolist()

    def merge_long(self, word: bytes) -> list[int]:
        """Same result with a heap of candidate merges, for words without bounded length."""
        import heapq

        n = len(word)
        token = [self.ids[word[i : i + 1]] for i in range(n)]
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(m[0], i, token[i], token[i + 1], m[1]) for i in range(n - 1) if (m := self.merges.get((token[i], token[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, whole = heapq.heappop(heap)
            j = after[i]
            if token[i] != a or j >= n or token[j] != b:
                continue
            token[i], token[j] = whole, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for x, y in ((before[i], i), (i, k)):
                if x >= 0 and y < n and (m := self.merges.get((token[x], token[y]))):
                    heapq.heappush(heap, (m[0], x, token[x], token[y], m[1]))
        return [t for t in token if t >= 0]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the number of ids of each."""
        if len(self.known) > MEMORY:
            self.forget()
        found, per_text = [], []
        for text in texts:
            before = len(found)
            if self.cut and any(s in text for s in self.special):
                for i, part in enumerate(self.cut(text)):
                    found.extend([f"\0{part}"] if i % 2 else self.word(part))
            else:
                found.extend(self.word(text))
            per_text.append(len(found) - before)
        if not found:
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        known = self.known
        at = np.fromiter(map(known.get, found, repeat(-1)), np.int64, len(found))
        self.again[at[at >= 0]] = True
        missing = np.flatnonzero(at < 0).tolist()
        fresh = list(dict.fromkeys(found[i] for i in missing))
        if fresh:
            plain = [w for w in fresh if not (w[:1] == "\0" and w[1:] in self.special)]
            marks = [w for w in fresh if w[:1] == "\0" and w[1:] in self.special]
            for w in plain + marks:
                known[w] = len(known)
            if plain:
                self.learn(plain)
            self.counts = np.concatenate([self.counts, np.ones(len(marks), np.int64)])
            self.flat = np.concatenate([self.flat, np.array([self.special[w[1:]] for w in marks], np.int32)])
            self.begins = np.cumsum(self.counts) - self.counts
            self.again = np.append(self.again, np.zeros(len(fresh), bool))
            at[missing] = [known[found[i]] for i in missing]
        lengths = self.counts[at]
        ids = self.flat[gather(self.begins[at], lengths)]
        sums = np.concatenate([[0], np.cumsum(lengths)])
        ends = np.cumsum(per_text)
        return ids, sums[ends] - sums[ends - np.array(per_text)]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """Texts of rows of ids; bytes that are no UTF-8 become U+FFFD."""
        data = self.bytes[gather(self.starts[ids], self.lengths[ids])]
        sums = np.concatenate([[0], np.cumsum(self.lengths[ids])])
        at = sums[offsets].astype(np.int32)
        raw = data.tobytes()
        try:
            raw.decode()
            inner = at[at < len(data)]
            if ((data[inner] & 0xC0) != 0x80).all():
                return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(at), pa.py_buffer(raw))
        except UnicodeDecodeError:
            pass
        return pa.array([raw[a:b].decode(errors="replace") for a, b in zip(at[:-1], at[1:], strict=True)], pa.string())


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One per worker and file; every executor has the tokenizer package at the same place."""
    return Vocabulary(path)


def encode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", back: bool = False) -> DataFrame:
    """Returns (key, ids array<int>), one row per row of ``df``; null and empty text have no ids.

    Special tokens written in a text become their own id. ``back`` adds ``decoded``, the text that the ids
    stand for, as ``decode`` would. Rows never meet: no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = vocabulary(path)
        for batch in batches:
            _, offsets = text_buffer(batch.column(1))
            for lo, hi in row_groups(offsets, CHARS):
                part = batch.slice(lo, hi - lo)
                ids, counts = book.encode(["" if t is None else t for t in part.column(1).to_pylist()])
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                columns = [part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))]
                yield pa.RecordBatch.from_arrays([*columns, book.decode(ids, ends)] if back else columns, names=schema.names)

    plain = keep_columns(df, key=key, text=text)
    kind = plain.schema["key"].dataType
    schema = T.StructType([T.StructField("key", kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    if back:
        schema = schema.add("decoded", T.StringType())
    return plain.mapInArrow(run, schema).withColumnRenamed("key", key)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the text of the ids to the rows; null ids give empty text, ids outside the vocabulary are an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = vocabulary(path)
        for batch in batches:
            column = batch.column(batch.schema.names.index(ids))
            _, offsets = None, np.concatenate([[0], np.cumsum(np.nan_to_num(pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)).astype(np.int64))])
            flat = column.flatten().to_numpy(zero_copy_only=False)
            for lo, hi in row_groups(offsets, CHARS // 2):
                texts = book.decode(flat[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names=[*batch.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.StringType())]))


def digest(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Token count and hashes of ids and of the text decoded from them, per row."""
    coded = encode(df, path, key, text, back=True)
    return coded.select(
        key,
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
