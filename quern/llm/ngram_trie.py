"""LM scoring with an Elias-Fano n-gram trie.

The model is an interpolated trigram model over words with absolute discounts.
Every word, however rare, has its exact training count; n-grams are kept from
``MIN_COUNT`` on, at every corpus size. The model is never in one place: it is
cut into shards, and their number grows with the corpus.

Trie. A shard has all n-grams around the words that hash to it: for a word b
the bigrams b c and the trigrams a b c, with the bigrams a b as their contexts.
So each score needs one shard. Level 1 holds the shard's words by their numbers;
level n the successors of each n-gram of level n-1, with monotone pointers.
Successors are sorted inside their context and made monotone by the last value
before; trigram successors are stored as positions among the successors of the
middle word. Pointers and successors are Elias-Fano sequences, probabilities and
back-off weights are one byte each with a codebook per level. All parts of a
shard lie in one file that its task maps into memory; a lookup is a successor
search inside the range of its context.

Counting. Texts are cut into chunks. Distinct words of a chunk go to shards by
hash; a shard sums exact counts, numbers its words and answers each chunk, so that
the vocabulary is never held in one place. The chunk then sends its distinct trigrams, with
documents and the words' counts, to the shards of the middle words. A shard
counts them, builds its trie and answers with sums per document.

A word with very many occurrences is dealt to several shards by the word before
it, so that each still has whole contexts. The successors of such words are
counted by pair first; each of their shards gets them, with the word's back-off
weight, and only then scores.

Defined results: null and empty texts are one end token. Words are lower-cased
for A-Z. Repeated rows are scored each, and counted each when they train. With
no training rows every token is unseen; no rows give no scores. A very long text
is a chunk of its own size, and scored whole. A null id counts as the empty text for
the fold. Extra columns are not touched.
"""

from __future__ import annotations

import math
import mmap
import os
import struct
import tempfile
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import crc_mod, documents, slices, text_bytes, tidied, words_of, written

MIN_COUNT = 2
MAX_NGRAMS = 4_000_000  # about so many in a shard
CHUNK_TOKENS = 2_000_000
SHARD_BYTES = 16 << 20
PART = 1 << 18  # trigrams of a shard that are worked on at a time
DISCOUNT = 0.75
END = b"\n"  # white space, so never a word
OTHERS = MIN_COUNT + 1  # numbers of rare words by count, and of what stands two before the first token


# ---------------------------------------------------------------- Elias-Fano


class EliasFano:
    """A non-decreasing sequence: low bits packed, high bits in unary with a running count per 64 bits."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, rank: np.ndarray):
        self.n, self.width, self.low, self.high, self.rank = n, width, low, high, rank

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, dtype=np.uint64)
        n, top = len(v), int(v[-1]) if len(v) else 0
        width = max(0, int(math.log2(top / n))) if n and top > n else 0
        low = np.zeros((n * width + 63) // 64 + 2, dtype="<u8")
        for i in range(0, n if width else 0, 1 << 15):  # a few values at a time; each part begins at a whole byte
            bits = np.packbits(((v[i : i + (1 << 15), None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
            low.view(np.uint8)[i * width // 8 : i * width // 8 + len(bits)] = bits
        at = (v >> np.uint64(width)).astype(np.int64) + np.arange(n)
        high = np.zeros((int(at[-1]) if n else 0) // 64 + 1, dtype="<u8")
        np.bitwise_or.at(high, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        rank = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)[:-1]]).astype("<u4")
        return cls(n, width, low, high, rank)

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at positions, all at once."""
        i = np.asarray(i, dtype=np.int64)
        word = np.searchsorted(self.rank, i, side="right") - 1
        left = (i - self.rank[word]).astype(np.int64)
        bits = np.array(self.high[word])
        place = word.astype(np.int64) << 6
        for half in (32, 16, 8, 4, 2, 1):
            ones = np.bitwise_count(bits & np.uint64((1 << half) - 1)).astype(np.int64)
            up = left >= ones
            left -= np.where(up, ones, 0)
            bits = np.where(up, bits >> np.uint64(half), bits)
            place += np.where(up, half, 0)
        out = (place - i) << self.width
        if self.width:
            bit = i * self.width
            word, shift = bit >> 6, (bit & 63).astype(np.uint64)
            low = self.low[word] >> shift
            carry = np.where(shift > 0, self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
            out |= ((low | carry) & np.uint64((1 << self.width) - 1)).astype(np.int64)
        return out

    def find(self, value: np.ndarray, start: np.ndarray, past: np.ndarray) -> np.ndarray:
        """Position of each value in its range, or -1: a successor search by halves."""
        lo, hi = start.astype(np.int64).copy(), past.astype(np.int64).copy()
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            less = self.get(mid) < value[live]
            lo[live] = np.where(less, mid + 1, lo[live])
            hi[live] = np.where(less, hi[live], mid)
            live = live[lo[live] < hi[live]]
        out = np.full(len(value), -1, dtype=np.int64)
        there = np.flatnonzero(lo < past)
        if len(there):
            ok = self.get(lo[there]) == value[there]
            out[there[ok]] = lo[there[ok]]
        return out

    def parts(self) -> list[np.ndarray]:
        return [np.array([self.n, self.width], dtype="<u8"), self.low, self.high, self.rank]


class _Level:
    """Monotone pointers from each context to its successors."""

    def __init__(self, pointers: EliasFano, successors: EliasFano):
        self.pointers, self.successors = pointers, successors

    @classmethod
    def of(cls, context: np.ndarray, value: np.ndarray, contexts: int) -> _Level:
        """Pairs sorted by context, then value."""
        starts = np.searchsorted(context, np.arange(contexts + 1))
        if not len(value):
            return cls(EliasFano.of(starts), EliasFano.of(value))
        has = np.flatnonzero(np.diff(starts))
        last = value[starts[has + 1] - 1]
        base = np.zeros(contexts, dtype=np.int64)
        base[has] = np.concatenate([[0], np.cumsum(last + 1)[:-1]])
        return cls(EliasFano.of(starts), EliasFano.of(value + base[context]))

    def range(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.pointers.get(context), self.pointers.get(context + 1)

    def find(self, context: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Position of the n-gram in this level, or -1."""
        start, past = self.range(context)
        base = np.zeros(len(start), dtype=np.int64)
        if self.successors.n:
            inner = np.flatnonzero((start > 0) & (start < past))
            # The sum of the last values before equals the value before the range, plus one.
            base[inner] = self.successors.get(start[inner] - 1) + 1
        return self.successors.find(value + base, start, past)


def quantised(x: np.ndarray, bins: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """One byte each, and the codebook: means of bins of equal width in the logarithm."""
    if not len(x):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype="<f8")
    edges = np.linspace(x.min(), x.max(), bins + 1)[1:-1]
    code = np.searchsorted(edges, x, side="right")
    n = np.bincount(code, minlength=len(edges) + 1)
    book = np.bincount(code, weights=x, minlength=len(edges) + 1) / np.maximum(n, 1)
    return code.astype(np.uint8), book.astype("<f8")


class Trie:
    """A model file mapped into memory."""

    MAGIC = b"QEF1"

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self._map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        magic, count = struct.unpack_from("<4sI", self._map)
        if magic != self.MAGIC:
            raise ValueError("not a model of this format")
        parts = []
        for k in range(count):
            kind, n, at = struct.unpack_from("<8sQQ", self._map, 8 + 24 * k)
            parts.append(np.frombuffer(self._map, dtype=kind.rstrip(b"\0").decode(), count=n, offset=at))
        take = iter(parts)

        def sequence() -> EliasFano:
            n, width = next(take).tolist()
            return EliasFano(n, width, next(take), next(take), next(take))

        self.words = next(take)
        self.two = _Level(sequence(), sequence())
        self.three = _Level(sequence(), sequence())
        (self.p1, self.b1, self.p2, self.b2, self.p3) = ((next(take), next(take)) for _ in range(5))

    @staticmethod
    def _value(coded: tuple[np.ndarray, np.ndarray], at: np.ndarray) -> np.ndarray:
        return coded[1][coded[0][at]]

    def bigrams(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Positions of word pairs in level 2; -1 where a word or the pair is not kept."""
        out = np.full(len(a), -1, dtype=np.int64)
        ok = np.flatnonzero((a >= 0) & (b >= 0))
        if len(ok) and self.two.successors.n:
            pair, inverse = np.unique(a[ok] << 32 | b[ok], return_inverse=True)
            out[ok] = self.two.find(pair >> 32, pair & 0xFFFFFFFF)[inverse]
        return out

    def scores(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        """log10 probability of each word c given a and b before it; all are words of this trie."""
        if not len(c):
            return np.zeros(0)
        bc, ab = self.bigrams(b, c), self.bigrams(a, b)
        out = np.zeros(len(c))
        pair = bc >= 0
        out[pair] = self._value(self.p2, bc[pair])
        out[~pair] = self._value(self.p1, c[~pair]) + self._value(self.b1, b[~pair])
        known = np.flatnonzero(ab >= 0)
        out[known] += self._value(self.b2, ab[known])
        deep = np.flatnonzero((ab >= 0) & pair)
        if len(deep) and self.three.successors.n:
            place = bc[deep] - self.two.pointers.get(b[deep])  # among the successors of the middle word
            found = self.three.find(ab[deep], place)
            hit = found >= 0
            out[deep[hit]] = self._value(self.p3, found[hit])
        return out


def build(path: str, words: np.ndarray, c1: np.ndarray, c2: tuple[np.ndarray, np.ndarray, np.ndarray], c3: tuple[np.ndarray, np.ndarray, np.ndarray], tokens: int, types: int, left_over: dict[int, float] | None = None) -> None:
    """Write a model. ``words`` are sorted numbers; c2 is (first, second, count) and c3 (bigram position, third, count), sorted.

    ``left_over``: back-off weights of words whose successors are not all here.
    """
    n1 = len(words)
    p1 = (c1 + 1) / (tokens + types + 1)
    a, b, n2 = c2
    g1 = 1 - np.bincount(a, weights=(n2 - DISCOUNT) / c1[a], minlength=n1) if n1 else np.zeros(0)
    for k, weight in (left_over or {}).items():
        g1[k] = weight
    p2 = (n2 - DISCOUNT) / c1[a] + g1[a] * p1[b]
    j, c, n3 = c3
    g2 = 1 - np.bincount(j, weights=(n3 - DISCOUNT) / n2[j], minlength=len(a)) if len(a) else np.zeros(0)
    two = _Level.of(a, b, n1)
    below = np.searchsorted(a.astype(np.int64) << 32 | b, b[j].astype(np.int64) << 32 | c) if len(j) else np.zeros(0, dtype=np.int64)
    p3 = (n3 - DISCOUNT) / n2[j] + g2[j] * p2[below] if len(j) else np.zeros(0)
    three = _Level.of(j, below - np.searchsorted(a, b[j]) if len(j) else below, len(a))
    logs = [quantised(np.log10(np.maximum(x, 1e-12))) for x in (p1, g1, p2, g2, p3)]
    parts = [words.astype("<u8"), *two.pointers.parts(), *two.successors.parts(), *three.pointers.parts(), *three.successors.parts(), *[x for pair in logs for x in pair]]
    at = 8 + 24 * len(parts)
    with open(path, "wb") as f:
        head, body = [struct.pack("<4sI", Trie.MAGIC, len(parts))], []
        for x in parts:
            at = (at + 7) // 8 * 8
            head.append(struct.pack("<8sQQ", x.dtype.str.encode(), len(x), at))
            body.append((at, x.tobytes()))
            at += x.nbytes
        f.write(b"".join(head))
        for where, raw in body:
            f.seek(where)
            f.write(raw)
        f.truncate(max(at, f.tell()))


# ------------------------------------------------------------------ counting


class _Numbered(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


FLOW = "shard int, kind int, chunk long, n long, payload binary"
ARROW = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("chunk", pa.int64()), ("n", pa.int64()), ("payload", pa.binary())])


def _pack(*parts: bytes | np.ndarray) -> bytes:
    raw = [p if isinstance(p, bytes) else p.tobytes() for p in parts]
    return struct.pack(f"<{len(raw)}Q", *map(len, raw)) + b"".join(raw)


def _unpack(payload: bytes, count: int) -> list[bytes]:
    sizes = struct.unpack_from(f"<{count}Q", payload)
    out, at = [], 8 * count
    for n in sizes:
        out.append(payload[at : at + n])
        at += n
    return out


def _row(shard: int, kind: int, chunk: int, n: int, payload: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{"shard": shard, "kind": kind, "chunk": chunk, "n": n, "payload": payload}], schema=ARROW)


def _ints(x: np.ndarray) -> np.ndarray:
    """Non-negative numbers in the fewest bytes that hold them."""
    top = int(x.max(initial=0))
    return x.astype("u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8")


def _wide(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"<u{len(raw) // n}").astype(np.int64) if n else np.zeros(0, dtype=np.int64)


def _pressed(x: np.ndarray) -> bytes:
    """Non-negative numbers, compressed byte by byte; the first byte says how many bytes a number has."""
    if not len(x):
        return b""
    planes = np.ascontiguousarray(_ints(x).view("u1").reshape(len(x), -1).T)
    return bytes([len(planes)]) + pa.Codec("zstd", compression_level=1).compress(planes, asbytes=True)


def _plain(raw: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, dtype=np.int64)
    planes = np.frombuffer(pa.Codec("zstd").decompress(raw[1:], raw[0] * n, asbytes=True), "u1").reshape(-1, n)
    return _wide(np.ascontiguousarray(planes.T).tobytes(), n)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Numbers spread evenly, for dealing out to shards."""
    with np.errstate(over="ignore"):
        h = np.asarray(x).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (h ^ (h >> np.uint64(29))) >> np.uint64(8)


def _first(x: np.ndarray) -> np.ndarray:
    """Where an array with equal values side by side has a new one."""
    return np.concatenate([np.ones(min(len(x), 1), dtype=bool), x[1:] != x[:-1]])


def _distinct(x: np.ndarray) -> np.ndarray:
    """Values of an array, each once; the array itself is sorted, so that no other of its size is made."""
    x.sort()
    return x[_first(x)]


def _runs(sorted_values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Each value of a sorted array with the range it takes; values that are not there cost nothing."""
    cuts = np.flatnonzero(np.diff(sorted_values, prepend=-1)) if len(sorted_values) else np.zeros(0, dtype=np.int64)
    return zip(sorted_values[cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(sorted_values)])


@dataclass
class Hot:
    """Words with more occurrences than a shard should have n-grams, by number: their counts, and among how many parts they are dealt.

    Their number is at most tokens / bound, so fewer than there are shards.
    """

    words: np.ndarray
    counts: np.ndarray
    parts: np.ndarray
    weights: np.ndarray | None = None  # back-off weights

    @classmethod
    def of(cls, rows: list[tuple[int, int]], bound: int) -> Hot:
        table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 2)
        return cls(table[:, 0], table[:, 1], -(-table[:, 1] // bound))

    def find(self, words: np.ndarray) -> np.ndarray:
        """Places of words among the hot ones, or -1."""
        if not len(self.words):
            return np.full(len(words), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, at, -1)

    def shard(self, before: np.ndarray, middle: np.ndarray, shards: int) -> np.ndarray:
        """The shard of each trigram: that of its middle word, and for a hot one of the part that the word before gives."""
        at = self.find(middle)
        salt = np.zeros(len(middle), dtype=np.uint64)
        hot = at >= 0
        salt[hot] = 1 + _mixed(before[hot]) % self.parts[at[hot]].astype(np.uint64)
        return (_mixed(_mixed(middle) + salt) % np.uint64(shards)).astype(np.int64)

    def shards_of(self, k: int, shards: int) -> list[int]:
        """All shards that have a part of the k-th hot word."""
        salts = np.arange(1, int(self.parts[k]) + 1, dtype=np.uint64)
        return np.unique(_mixed(_mixed(self.words[k : k + 1]) + salts) % np.uint64(shards)).astype(np.int64).tolist()


def chunked(rows: DataFrame, shards: int) -> DataFrame:
    """Written chunks of ``id, text, train`` rows.

    kind 0: a chunk's documents and tokens, n of them; 1: the chunk's n distinct words of a shard, with training counts.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidied()  # of what the task before left in this worker; so in the other steps
        part, seq, held = TaskContext.get().partitionId(), 0, 0
        number, arrays, ids, train = _Numbered(), [], [], []

        def flush() -> Iterator[pa.RecordBatch]:
            chunk = part << 32 | seq
            counts = np.array([len(a) for a in arrays], dtype=np.int64)
            tokens, words = np.concatenate(arrays), list(number)
            shard = np.fromiter((zlib.crc32(w) % shards for w in words), np.int64, len(words))
            order = np.argsort(shard, kind="stable")
            rank = np.empty(len(words), dtype=np.int64)
            rank[order] = np.arange(len(words))
            place = rank[tokens]  # words are numbered by shard, then as they come
            trained = np.bincount(place, weights=np.repeat(np.array(train, dtype=float), counts), minlength=len(words)).astype(np.int64)
            head = [np.array([0 if i is None else i for i in ids], dtype="<i8"), np.array([i is None for i in ids], dtype="u1"), counts, np.array(train, dtype="u1")]
            yield _row(0, 0, chunk, len(tokens), _pack(*head, _pressed(rank), _pressed(tokens), np.array([len(words)], dtype="<i8")))
            for s, a, b in _runs(shard[order]):
                yield _row(s, 1, chunk, b - a, _pack(b" ".join([words[k] for k in order[a:b].tolist()]), _ints(trained[a:b])))

        for batch in slices(batches, "text", 4 << 20):
            for doc_id, fold, raw in zip(*(batch.column(c).to_pylist() for c in ("id", "train")), text_bytes(batch.column("text"))):
                words = words_of(raw)
                words.append(END)
                arrays.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
                ids.append(doc_id)
                train.append(bool(fold))
                held += len(words)
                if held >= CHUNK_TOKENS:
                    yield from flush()
                    seq, held = seq + 1, 0
                    number, arrays, ids, train = _Numbered(), [], [], []
        if arrays:
            yield from flush()

    return written(rows.mapInArrow(run, FLOW), "lm-chunks")


def word_counts(chunks: DataFrame, shards: int, hot_words: int) -> DataFrame:
    """Written answers of the word shards.

    kind 1: whole counts of a chunk's words, and numbers of those that are not
    rare (a number belongs to one word of the whole corpus); 2: tokens
    (``chunk``) and types (``n``) of a shard; 3: numbers (``chunk``) and counts
    (``n``) of words with more than ``hot_words`` occurrences.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidied()
        total: dict[bytes, int] = {}
        blocks = []
        for batch in batches:
            for row in batch.to_pylist():
                words, trained = _unpack(row["payload"], 2)
                for w, t in zip(words.split(b" "), _wide(trained, row["n"]).tolist()):
                    total[w] = total.get(w, 0) + t
                blocks.append((row["shard"], row["chunk"], words))
        number: dict[bytes, int] = {}  # a word has one shard, whatever shards a task has
        sizes: dict[int, int] = {}
        told: set[tuple[int, int]] = set()
        for shard, chunk, words in blocks:
            each = words.split(b" ")
            count = np.array([total[w] for w in each], dtype=np.int64)
            kept = []
            for w, n in zip(each, count.tolist()):
                if n >= MIN_COUNT:
                    k = number.get(w)
                    if k is None:
                        k = number[w] = sizes.get(shard, 0)
                        sizes[shard] = k + 1
                    kept.append(k)
                    if n > hot_words and (shard, k) not in told:
                        told.add((shard, k))
                        yield _row(shard, 3, k * shards + shard, n, b"")
            yield _row(shard, 1, chunk, len(count), _pack(_pressed(count), _pressed(np.array(kept, dtype=np.int64) * shards + shard)))
        if total:
            yield _row(0, 2, sum(total.values()), sum(t > 0 for t in total.values()), b"")

    return written(chunks.filter("kind = 1").repartitionById(shards, F.col("shard")).mapInArrow(run, FLOW), "lm-words")


def queries(chunks: DataFrame, counts: DataFrame, shards: int, unit: float, hot: Hot, pairs: bool = False) -> DataFrame:
    """kind 0: a chunk's documents with their unigram sums; 1: a chunk's trigrams for the shard of the middle word,
    sorted by middle word, word before, last word and document.

    With ``pairs`` only kind 3: a chunk's training counts of pairs that begin with a hot word, by pair.

    A rare word is in no n-gram that is kept, so only its count goes along; after one, the unigram is the score.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidied()
        body, known = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] == 0:
                    if body is not None:
                        yield from asked(body, known)
                        tidied()
                    body, known = row, []
                else:
                    known.append((row["n"], row["payload"]))
        if body is not None:
            yield from asked(body, known)

    def asked(row: dict, known: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        *head, rank, raw, words = _unpack(row["payload"], 7)
        tokens = _plain(rank, int(np.frombuffer(words, "<i8")[0]))[_plain(raw, row["n"])]
        parts = [_unpack(payload, 2) for _, payload in known]
        count = np.concatenate([_plain(x, n) for (n, _), (x, _) in zip(known, parts)])
        of, numbers = 0, []
        for (n, _), (_, raw_numbers) in zip(known, parts):
            numbers.append(_plain(raw_numbers, int((count[of : of + n] >= MIN_COUNT).sum())) + OTHERS)
            of += n
        sizes = np.frombuffer(head[2], "<i8")
        del raw, rank, parts
        doc, n_docs, ends = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), len(sizes), np.cumsum(sizes)
        every = count[tokens]
        logs = np.log10(every + 1.0)
        kept = count >= MIN_COUNT
        rare = int(kept.sum())  # from here on: the rare ones, then what stands before
        none = rare + MIN_COUNT
        tokens = np.where(kept, np.cumsum(kept) - 1, rare + count)[tokens]
        numbers = np.concatenate([*numbers, np.arange(OTHERS)])
        count = np.concatenate([count[kept], np.arange(MIN_COUNT), [0]])
        order = np.argsort(numbers)  # local numbers in the order of the global ones, so that blocks hold small gaps
        local = np.empty(len(order), dtype=np.int64)
        local[order] = np.arange(len(order))
        numbers, count, tokens, none = numbers[order], count[order], local[tokens], int(local[none])
        start = np.concatenate([[0], ends[:-1]])
        b = np.concatenate([[none], tokens[:-1]])
        b[start] = tokens[ends[0] - 1]  # every text ends with END
        a = np.concatenate([[none], b[:-1]])
        a[start] = none
        alone = numbers[b] < OTHERS
        if pairs:
            yield from hot_pairs(row["chunk"], numbers, b, tokens, np.frombuffer(head[3], "u1")[doc])
            return
        yield _row(int(_mixed(np.array([row["chunk"]]))[0] % np.uint64(shards)), 0, row["chunk"], n_docs, _pack(*head, *[np.bincount(doc, weights=x, minlength=n_docs) for x in (every > 0, logs, np.where(alone, logs - unit, 0.0))]))
        a, b, c, doc = (x[~alone] for x in (a, b, tokens, doc))
        del every, logs, tokens, alone
        pair, at = np.unique(b << 32 | a, return_inverse=True)
        del a, b
        three, at = np.unique(at << 32 | c, return_inverse=True)
        entry, n = np.unique(at << 32 | doc, return_counts=True)
        del at, c
        doc, three = (entry & 0xFFFFFFFF).astype(np.int32), three[entry >> 32]
        del entry
        b, a, c = pair[three >> 32] >> 32, pair[three >> 32] & 0xFFFFFFFF, three & 0xFFFFFFFF
        shard = hot.shard(numbers[a], numbers[b], shards)
        by = np.argsort(shard, kind="stable")
        train = np.packbits(np.frombuffer(head[3], "u1"))
        for s, x, y in _runs(shard[by]):
            mine = by[x:y]
            words, at = np.unique(np.concatenate([a[mine], b[mine], c[mine]]), return_inverse=True)
            gaps = np.diff(numbers[words], prepend=0)
            yield _row(s, 1, row["chunk"], y - x, _pack(struct.pack("<q", len(words)), _pressed(gaps), _pressed(count[words]), *[_pressed(v) for v in (*at.reshape(3, -1), doc[mine], n[mine])], train))

    def hot_pairs(chunk: int, numbers: np.ndarray, b: np.ndarray, c: np.ndarray, train: np.ndarray) -> Iterator[pa.RecordBatch]:
        ok = (hot.find(numbers)[b] >= 0) & (numbers[c] >= OTHERS) & (train > 0)
        key, n = np.unique(b[ok] << 32 | c[ok], return_counts=True)
        b, c = numbers[key >> 32], numbers[key & 0xFFFFFFFF]
        shard = (_mixed(_mixed(b) ^ c.astype(np.uint64)) % np.uint64(shards)).astype(np.int64)
        by = np.argsort(shard, kind="stable")
        for s, x, y in _runs(shard[by]):
            mine = by[x:y]
            yield _row(s, 3, chunk, y - x, _pack(*[_pressed(v) for v in (b[mine], c[mine], n[mine])]))

    flow = chunks.filter("kind = 0").unionByName(counts.filter("kind = 1")).repartition("chunk").sortWithinPartitions("chunk", "kind", "shard")
    return flow.mapInArrow(run, FLOW)


def hot_lists(asked: DataFrame, shards: int) -> DataFrame:
    """Written ``word, n, mass, payload``: successors of hot words that are kept, with their counts, by pair shard; mass sums the discounted counts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidied()
        held = [_unpack(row["payload"], 3) + [row["n"]] for batch in batches for row in batch.to_pylist()]
        if not held:
            return
        b, c, n = (np.concatenate([_plain(x[i], x[3]) for x in held]) for i in range(3))
        word, at = np.unique(b, return_inverse=True)
        other, to = np.unique(c, return_inverse=True)
        key, which = np.unique(at << 32 | to, return_inverse=True)
        n = np.bincount(which, weights=n, minlength=len(key)).astype(np.int64)
        key, n = key[n >= MIN_COUNT], n[n >= MIN_COUNT]
        for k, x, y in _runs(key >> 32):
            payload = _pack(_pressed(np.diff(other[key[x:y] & 0xFFFFFFFF], prepend=0)), _pressed(n[x:y]))
            yield pa.RecordBatch.from_pydict({"word": [int(word[k])], "n": [y - x], "mass": [float((n[x:y] - DISCOUNT).sum())], "payload": [payload]})

    return written(asked.repartitionById(shards, F.col("shard")).mapInArrow(run, "word long, n long, mass double, payload binary"), "lm-hot")


def shard_trie(path: str, words: np.ndarray, c1: np.ndarray, pair: np.ndarray, which: np.ndarray, c: np.ndarray, n: np.ndarray, tokens: int, types: int, lists: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None, left_over: dict[int, float] | None = None) -> None:
    """Write the trie of distinct trigrams a b c and their training counts.

    ``pair`` has b << 32 | a of all, sorted; a trigram's place in it is ``which``,
    and trigrams are sorted by ``which``, then ``c``. The shard has all trigrams of
    its middle words. Of those in ``left_over`` it has a part, by the word before;
    their successors come as ``lists``.
    """
    common = c1 >= MIN_COUNT
    b, a = pair >> 32, pair & 0xFFFFFFFF
    before, after = common[a], common[c]

    # A pair may be known from both sides, with the same count.
    n2 = np.add.reduceat(n, np.flatnonzero(_first(which)))
    ok = before & (n2 >= MIN_COUNT)
    sides = [((a << 32 | b)[ok], n2[ok])]
    del n2, ok
    whole = after & ~np.isin(b, np.array(list(left_over), dtype=np.int64))[which] if left_over else after
    key = b[which[whole]]
    key <<= 32
    key |= c[whole]
    key = _distinct(key)
    n2 = np.zeros(len(key), dtype=np.int64)
    for x in range(0, len(c), PART):
        part = slice(x, x + PART)
        ok = whole[part]
        np.add.at(n2, np.searchsorted(key, b[which[part][ok]] << 32 | c[part][ok]), n[part][ok])
    sides.append((key[n2 >= MIN_COUNT], n2[n2 >= MIN_COUNT]))
    del whole, key, n2
    if lists is not None:
        sides.append((lists[0] << 32 | lists[1], lists[2]))
    key, first = np.unique(np.concatenate([k for k, _ in sides]), return_index=True)
    n2 = np.concatenate([x for _, x in sides])[first]
    del sides, first
    kept = np.flatnonzero(before[which] & after & (n >= MIN_COUNT))
    j = np.searchsorted(key, (a << 32 | b)[which[kept]])
    del a, b, before, after
    kept, j = kept[order := np.argsort(j, kind="stable")], j[order]  # a pair's trigrams are sorted by c already
    del order
    tidied()
    build(path, words, c1, (key >> 32, key & 0xFFFFFFFF, n2), (j, c[kept].astype(np.int64), n[kept]), tokens, types, left_over)


def answers(asked: DataFrame, shards: int, tokens: int, types: int, hot: Hot) -> DataFrame:
    """Answers of the trie shards. kind 0 as asked; 1: sums for ``n`` documents of a chunk.

    A task holds its blocks as they came, and of each trigram of a block one number;
    documents and counts are read from the blocks again where they are needed.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidied()
        blocks, lists = [], []
        for row in (row for batch in batches for row in batch.to_pylist()):
            if row["kind"] == 0:
                yield _row(row["shard"], 0, row["chunk"], row["n"], row["payload"])
            elif row["kind"] == 2:
                lists.append((row["chunk"], row["n"], row["payload"]))
            else:
                blocks.append((row["shard"], row["chunk"], row["n"], row["payload"]))
        if blocks:
            yield from answered(blocks, lists)
            del blocks, lists
            tidied()  # the other worker of this executor may have a larger shard

    def listed(words: np.ndarray, lists: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Successors of hot words by local numbers, as far as the shard has them."""
        out = [np.zeros((0, 3), dtype=np.int64)]
        for word, n, payload in lists:
            gaps, counts = _unpack(payload, 2)
            other, counts = np.cumsum(_plain(gaps, n)), _plain(counts, n)
            b, at = np.searchsorted(words, word), np.minimum(np.searchsorted(words, other), len(words) - 1)
            here = (words[at] == other) & (b < len(words) and words[b] == word)
            out.append(np.stack([np.full(int(here.sum()), b), at[here], counts[here]], axis=1))
        return tuple(np.concatenate(out).T)

    def numbered(blocks: list[tuple]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Numbers of all words, their counts, and the places of each block's words among them."""
        numbers, counts = [], []
        for *_, payload in blocks:
            size, h, count, *_ = _unpack(payload, 9)
            numbers.append(np.cumsum(_plain(h, struct.unpack("<q", size)[0])))
            counts.append(count)
        words = _distinct(np.concatenate(numbers))
        c1, places = np.zeros(len(words), dtype=np.int64), []
        for h, count in zip(numbers, counts):
            places.append(np.searchsorted(words, h).astype(np.uint32))
            c1[places[-1]] = _plain(count, len(h))
        return words, c1, places

    def pairs(block: tuple, places: np.ndarray) -> np.ndarray:
        """Middle word and word before of a block's entries, which are sorted by them, then by the last word."""
        a, b = _unpack(block[3], 9)[3:5]
        return places[_plain(b, block[2])].astype(np.int64) << 32 | places[_plain(a, block[2])]

    def trigrams(blocks: list[tuple], places: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray], list[slice]]:
        """Distinct pairs; distinct trigrams as place of the pair and last word; the place of each block's trigrams among
        these; by block, bits that tell where in its entries a trigram begins, and the range of its trigrams."""
        room, used = np.empty(sum(n for _, _, n, _ in blocks), dtype=np.int64), 0  # as much memory as gets filled
        for block, mine in zip(blocks, places):
            key = pairs(block, mine)
            key = key[_first(key)]
            room[used : used + len(key)] = key
            used += len(key)
        pair, used, begins, ranges = _distinct(room[:used]), 0, [], []
        for block, mine in zip(blocks, places):
            key = pairs(block, mine)
            new = _first(key)
            key = np.searchsorted(pair, key[new])[np.cumsum(new) - 1] << 32 | mine[_plain(_unpack(block[3], 9)[5], block[2])]
            new = _first(key)
            begins.append(np.packbits(new))
            ranges.append(slice(used, used + int(new.sum())))
            used = ranges[-1].stop
            room[ranges[-1]] = key[new]
        three = _distinct(room[:used].copy())
        at = np.empty(used, dtype=np.uint32)
        for mine in ranges:
            at[mine] = np.searchsorted(three, room[mine])
        del room
        return pair, (three >> 32).astype(np.uint32), three.astype(np.uint32), at, begins, ranges

    def answered(blocks: list[tuple], lists: list[tuple]) -> Iterator[pa.RecordBatch]:
        tidied()  # the batch they came in is gone
        words, c1, places = numbered(blocks)
        pair, which, c, at, begins, ranges = trigrams(blocks, places)
        del places
        n = np.zeros(len(c), dtype=np.int64)
        for (_, _, size, payload), bits, mine in zip(blocks, begins, ranges):
            *_, doc, times, train = _unpack(payload, 9)
            trained = _plain(times, size) * np.unpackbits(np.frombuffer(train, "u1"))[_plain(doc, size)]
            n[at[mine]] += np.add.reduceat(trained, np.flatnonzero(np.unpackbits(bits, count=size)))  # a block has a trigram once
        tidied()
        with tempfile.TemporaryDirectory(prefix="quern-lm-") as folder:
            path = os.path.join(folder, "trie")
            at_hot = hot.find(words)
            left_over = {int(k): float(hot.weights[at_hot[k]]) for k in np.flatnonzero(at_hot >= 0)} if hot.weights is not None else None
            shard_trie(path, words, c1, pair, which, c, n, tokens, types, listed(words, lists) if lists else None, left_over)
            del n
            tidied()
            each = np.empty(len(c))
            trie = Trie(path)
            for x in range(0, len(c), PART):
                part = slice(x, x + PART)
                ab = pair[which[part]]
                each[part] = trie.scores(ab & 0xFFFFFFFF, ab >> 32, c[part].astype(np.int64))
        del pair, which, c, trie
        for (shard, chunk, size, payload), bits, mine in zip(blocks, begins, ranges):
            *_, doc, times, _ = _unpack(payload, 9)
            touched, docs = np.unique(_plain(doc, size), return_inverse=True)
            scores = each[at[mine]][np.cumsum(np.unpackbits(bits, count=size), dtype=np.int64) - 1]
            sums = np.bincount(docs, weights=scores * _plain(times, size), minlength=len(touched))
            yield _row(shard, 1, chunk, len(touched), _pack(_ints(touched), sums))

    return asked.repartitionById(shards, F.col("shard")).mapInArrow(run, FLOW)


def document_sums(given: DataFrame) -> DataFrame:
    """``id, train, n_tokens, n_known, log_counts, lm`` of each document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidied()
        head, lm = None, None

        def done() -> pa.RecordBatch:
            ids, null, counts, train, known, logs = (np.frombuffer(x, k) for x, k in zip(_unpack(head, 7), ("<i8", "u1", "<i8", "u1", "<f8", "<f8")))
            return pa.RecordBatch.from_arrays([pa.array(ids, mask=null.astype(bool)), pa.array(train.astype(bool)), pa.array(counts), pa.array(known.astype(np.int64)), pa.array(logs), pa.array(lm)], ["id", "train", "n_tokens", "n_known", "log_counts", "lm"])

        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] == 0:
                    if head is not None:
                        yield done()
                    head = row["payload"]
                    lm = np.frombuffer(_unpack(head, 7)[6], "<f8").copy()
                else:
                    touched, sums = _unpack(row["payload"], 2)
                    lm[_wide(touched, row["n"])] += np.frombuffer(sums, "<f8")
        if head is not None:
            yield done()

    rows = given.repartition("chunk").sortWithinPartitions("chunk", "kind", "shard")
    return rows.mapInArrow(run, "id long, train boolean, n_tokens long, n_known long, log_counts double, lm double")


def score(df: DataFrame, learn: Column, text: str = "text", id_col: str = "doc_id", max_ngrams: int = MAX_NGRAMS, shard_bytes: int = SHARD_BYTES, hot_words: int | None = None) -> DataFrame:
    """Scores of all rows by a model of those where ``learn`` is true.

    ``max_ngrams`` sets the number of shards, and ``hot_words`` (as many, if not
    given) from which count a word is dealt to several; never what is kept.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.coalesce(learn, F.lit(False)).alias("train"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(32, math.ceil(size / shard_bytes))
    bound = hot_words or max_ngrams
    chunks = chunked(rows, shards)
    counts = word_counts(chunks, shards, bound)
    tokens, types = (x or 0 for x in counts.filter("kind = 2").agg(F.sum("chunk"), F.sum("n")).first())
    unit = math.log10(tokens + types + 1)
    every = chunks.filter("kind = 0").agg(F.sum("n")).first()[0] or 0
    hot = Hot.of([(r["chunk"] + OTHERS, r["n"]) for r in counts.filter("kind = 3").select("chunk", "n").collect()], bound)  # fewer than shards
    shards = max(32, math.ceil(2 * every / max_ngrams))  # a bigram and a trigram a token at most
    lists = None
    if len(hot.words):
        found = hot_lists(queries(chunks, counts, shards, unit, hot, pairs=True), shards)
        mass = {r["word"]: r["mass"] for r in found.groupBy("word").agg(F.sum("mass").alias("mass")).collect()}
        hot.weights = 1 - np.array([mass.get(w, 0.0) for w in hot.words.tolist()]) / hot.counts
        places = spark.createDataFrame([(w, s) for k, w in enumerate(hot.words.tolist()) for s in hot.shards_of(k, shards)], "word long, shard int")
        lists = found.join(F.broadcast(places), "word").select("shard", F.lit(2).alias("kind"), F.col("word").alias("chunk"), "n", "payload")
    asked = queries(chunks, counts, shards, unit, hot)
    sums = document_sums(answers(asked if lists is None else asked.unionByName(lists), shards, tokens, types, hot))
    return sums.select(
        F.col("id").alias(id_col), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("log_counts") - F.col("n_tokens") * unit).alias("base_score"), F.col("lm").alias("score"),
    )


def op1_ngram_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir), crc_mod("doc_id", 7) != 2)
