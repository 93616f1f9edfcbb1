"""Token-ID output: shards of ids compressed by a Re-Pair grammar, with random access.

``write_shards`` orders documents by id, encodes them, and cuts each sorted
partition into shards of about ``shard_ids`` ids. A shard's ids are compressed
on their own: pairs that occur often are replaced by new symbols, the most
frequent first, until no pair is frequent enough to pay for its rule. Rules never
cross the end of a document, so each document is a run of symbols of its own.

File format, one binary value for each shard, little-endian::

    magic 'QRP2' | n_base u32 | n_rules u32 | n_docs u32 | n_symbols u32 | width u8 | long u8
    left, right   planes[n_rules]                rule k makes symbol n_base + k
    length u16 or (long) u32 [n_rules]           ids in the expansion of a rule
    doc_id i64[n_docs]   null u8[n_docs]         ids of the documents, and which are null
    symbol_end u64[n_docs]  id_end u64[n_docs]   ends of documents, in symbols and in ids
    symbols planes[n_symbols]

Planes hold numbers of ``width`` bits, 16 or more: the low 16 bits as u16, then
one bitmap for each further bit.

The expansion lengths give the position of any id without expanding what stands
before it (``Shard.slice``). Shards are rows of a Parquet table in shared
storage: ``part, seq, n_docs, n_ids, payload``; Spark's commit protocol makes a
repeated task write the same row once.

Defined results: null and empty texts give the end id alone. Rows that repeat
are kept, ordered by id, then text. A null id comes first. A very long text is a
shard of its own size, never cut. No rows give no shards. Only the id and the
text column are read, whatever else there is.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import documents, held, slices, tidied, written
from quern.llm.word_table import WordTable, gathered

MAGIC = b"QRP2"
HEAD = struct.Struct("<4sIIIIBB")
BUCKET_BITS = 20
FALL = 4
#: A rule takes six bytes and a use of it saves two, so it must be used four times. At six, rules of a
#: shard stay below 16,128, beyond which every symbol takes a 17th bit; measured, that is the smallest file.
PAYS = 6
SHARD_SCHEMA = "part long, seq long, n_docs long, n_ids long, payload binary"


def repair(ids: np.ndarray, is_end: np.ndarray, n_base: int, min_count: int = PAYS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, and the left and right side of each rule.

    ``is_end`` marks ids after which no rule may go on. All pairs are counted
    once; from then on only pairs next to a new symbol are new, and a pair that
    is too rare stays so. Each round replaces all pairs from a threshold on,
    which falls to a quarter; where two of them overlap, the more frequent wins, then
    the left one. It ends when no pair reaches ``min_count``.
    """
    n = len(ids)
    symbols, end = ids.astype(np.uint32), is_end.astype(bool)
    lefts: list[np.ndarray] = []
    rights: list[np.ndarray] = []
    none = np.zeros(0, dtype=np.int64)
    if n < 2:
        return symbols.astype(np.int64), none, none
    after = np.arange(1, n + 1, dtype=np.int32)
    before = np.arange(-1, n - 1, dtype=np.int32)
    end[-1] = True
    pair_at = np.full(n + 1, -1, dtype=np.int32)  # number of the pair that begins here; -1: none that could pay
    alive = np.ones(n, dtype=bool)
    bucket = (symbols[:-1] * np.uint32(0x9E3779B1) + symbols[1:] * np.uint32(0x85EBCA77)) >> np.uint32(32 - BUCKET_BITS)
    frequent = (np.bincount(bucket, minlength=1 << BUCKET_BITS) >= min_count)[bucket]
    # Of each numbered pair: occurrences, the two sides, and where its places stand in ``places``.
    count, pairs, start, size, places = none, none, none, none, np.zeros(0, dtype=np.int32)

    def number_pairs(at: np.ndarray) -> None:
        nonlocal count, pairs, start, size, places
        key = symbols[at].astype(np.int64) << 32 | symbols[after[at]]
        order = np.argsort(key)
        key, at = key[order], at[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        times = np.diff(first, append=len(key))
        ok = times >= min_count
        pair_at[at] = np.repeat(np.where(ok, len(count) + np.cumsum(ok) - 1, -1), times)
        first, times = first[ok], times[ok]
        count, pairs = np.concatenate([count, times]), np.concatenate([pairs, key[first]])
        start, size, places = np.concatenate([start, first + len(places)]), np.concatenate([size, times]), np.concatenate([places, at])

    number_pairs(np.flatnonzero(frequent & ~end[:-1]).astype(np.int32))
    n_symbols, threshold = n_base, int(count.max(initial=0)) // FALL
    while True:
        threshold = max(min_count, threshold)
        chosen = np.flatnonzero(count >= threshold)
        if not len(chosen):
            if threshold == min_count:
                break
            threshold //= FALL
            continue
        at = gathered(places, start[chosen], size[chosen])
        at = np.sort(at[pair_at[at] == np.repeat(chosen, size[chosen])])
        number = pair_at[at]
        weight = count[number]
        touch = after[at[:-1]] == at[1:]  # at[i] and at[i + 1] overlap
        lose = np.zeros(len(at), dtype=bool)
        lose[:-1] |= touch & (weight[:-1] < weight[1:])
        lose[1:] |= touch & (weight[1:] < weight[:-1])
        at, number = at[~lose], number[~lose]
        new_run = np.ones(len(at), dtype=bool)
        new_run[1:] = after[at[:-1]] != at[1:]
        run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
        take = (np.arange(len(at)) - run_start) % 2 == 0
        at, number = at[take], number[take]
        times = np.bincount(number, minlength=len(count))
        enough = times >= min_count
        short = chosen[~enough[chosen]]
        count[short] = times[short]  # the others overlap: this pair cannot pay any more
        if not enough.any():
            continue
        keep = enough[number]
        at, number = at[keep], number[keep]
        rule = np.cumsum(enough) - 1
        lefts.append(pairs[enough] >> 32)
        rights.append(pairs[enough] & 0xFFFFFFFF)
        gone = after[at]  # the right side of each place
        beside = before[at]
        beside = beside[beside >= 0]
        old = np.concatenate([pair_at[beside], pair_at[gone]])
        old = np.concatenate([old[old >= 0], number])
        pair_at[beside] = -1
        pair_at[gone] = -1
        pair_at[at] = -1
        count -= np.bincount(old, minlength=len(count))
        symbols[at] = (n_symbols + rule[number]).astype(np.uint32)
        n_symbols += len(lefts[-1])
        end[at] = end[gone]
        alive[gone] = False
        beyond = after[gone]
        after[at] = beyond
        inner = beyond < n
        before[beyond[inner]] = at[inner]
        around = np.sort(np.concatenate([beside[alive[beside]], at]))
        around = around[np.diff(around, prepend=-1) > 0]
        number_pairs(around[~end[around]])
        threshold //= FALL
    return symbols[alive].astype(np.int64), np.concatenate([none, *lefts]), np.concatenate([none, *rights])


def rule_lengths(left: np.ndarray, right: np.ndarray, n_base: int) -> np.ndarray:
    """Ids in the expansion of each rule; a rule refers to earlier rules only."""
    out = np.ones(len(left), dtype=np.int64)
    done = np.zeros(len(left), dtype=bool)
    while not done.all():
        ready = ~done & ((left < n_base) | done[np.maximum(left - n_base, 0)]) & ((right < n_base) | done[np.maximum(right - n_base, 0)])
        a = np.where(left < n_base, 1, out[np.maximum(left - n_base, 0)])
        b = np.where(right < n_base, 1, out[np.maximum(right - n_base, 0)])
        out[ready] = (a + b)[ready]
        done |= ready
    return out


def _planes(x: np.ndarray, width: int) -> bytes:
    x = x.astype(np.int64)
    return b"".join([x.astype("<u2").tobytes(), *(np.packbits((x >> bit & 1).astype("u1"), bitorder="little").tobytes() for bit in range(16, width))])


def pack(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray, n_base: int, **options: int) -> bytes:
    """One shard of documents of ``counts`` ids each; each document must end where its count does."""
    counts = np.asarray(counts, dtype=np.int64)
    id_end = np.cumsum(counts)
    is_end = np.zeros(len(ids), dtype=bool)
    is_end[id_end[counts > 0] - 1] = True
    symbols, left, right = repair(ids, is_end, n_base, **options)
    length = rule_lengths(left, right, n_base)
    position = np.cumsum(np.where(symbols < n_base, 1, length[np.maximum(symbols - n_base, 0)] if len(length) else 1))
    symbol_end = np.searchsorted(position, id_end, side="right")
    symbol_end[id_end == 0] = 0
    width = max(16, int(n_base + len(left) - 1).bit_length())
    long = int(length.max(initial=0) > 0xFFFF)
    return b"".join([
        HEAD.pack(MAGIC, n_base, len(left), len(counts), len(symbols), width, long),
        _planes(left, width),
        _planes(right, width),
        length.astype("<u4" if long else "<u2").tobytes(),
        np.array([0 if d is None else d for d in doc_ids], dtype="<i8").tobytes(),
        np.array([d is None for d in doc_ids], dtype="u1").tobytes(),
        symbol_end.astype("<u8").tobytes(),
        id_end.astype("<u8").tobytes(),
        _planes(symbols, width),
    ])


class Shard:
    """Reads one shard; ``document(k)`` and ``slice(k, a, b)`` expand only what they return."""

    def __init__(self, payload: bytes):
        magic, self.n_base, n_rules, self.n_docs, n_symbols, width, long = HEAD.unpack_from(payload)
        if magic != MAGIC:
            raise ValueError("not a shard of this format")
        at = HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(payload, dtype=kind, count=n, offset=at)
            at += out.nbytes
            return out

        def planes(n: int) -> np.ndarray:
            out = take("<u2", n).astype(np.uint32)
            for bit in range(16, width):
                out |= np.unpackbits(take("u1", (n + 7) // 8), count=n, bitorder="little").astype(np.uint32) << np.uint32(bit)
            return out

        self.left, self.right = planes(n_rules).astype(np.int64), planes(n_rules).astype(np.int64)
        self.length = take("<u4" if long else "<u2", n_rules).astype(np.int64)
        self.doc_id, self.null = take("<i8", self.n_docs), take("u1", self.n_docs)
        self.symbol_end, self.id_end = take("<u8", self.n_docs).astype(np.int64), take("<u8", self.n_docs).astype(np.int64)
        self.symbols = planes(n_symbols)

    def lengths(self, symbols: np.ndarray) -> np.ndarray:
        if not len(self.length):
            return np.ones(len(symbols), dtype=np.int64)
        return np.where(symbols < self.n_base, 1, self.length[np.maximum(symbols.astype(np.int64) - self.n_base, 0)])

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """All nonterminals of a level at once, until none is left."""
        out = symbols.astype(np.int64)
        while (inner := out >= self.n_base).any():
            rule = out[inner] - self.n_base
            start = np.arange(len(out)) + np.cumsum(inner) - inner
            grown = np.empty(len(out) + len(rule), dtype=np.int64)
            grown[start[~inner]] = out[~inner]
            grown[start[inner]] = self.left[rule]
            grown[start[inner] + 1] = self.right[rule]
            out = grown
        return out.astype(np.uint32)

    def whole(self) -> np.ndarray:
        """All ids: each rule is expanded once, then copied wherever it stands."""
        rules = np.arange(self.n_base, self.n_base + len(self.left))
        pool = np.concatenate([np.arange(self.n_base, dtype=np.uint32), self.expand(rules)])
        start = np.concatenate([np.arange(self.n_base), self.n_base + np.cumsum(self.length) - self.length])
        return gathered(pool, start[self.symbols], self.lengths(self.symbols))

    def document(self, k: int) -> np.ndarray:
        return self.expand(self.symbols[self.symbol_end[k - 1] if k else 0 : self.symbol_end[k]])

    def slice(self, k: int, a: int, b: int) -> np.ndarray:
        """Ids ``a`` to ``b`` of document ``k``: only symbols that reach into that range are expanded."""
        symbols = self.symbols[self.symbol_end[k - 1] if k else 0 : self.symbol_end[k]].astype(np.int64)
        ends = np.cumsum(self.lengths(symbols))
        i, j = np.searchsorted(ends, a, side="right"), np.searchsorted(ends, b, side="left") + 1
        first = int(ends[i - 1]) if i else 0
        return self.expand(symbols[i:j])[a - first : b - first]


class PieceEncoder:
    """The tokenizers library on the distinct words of texts.

    The file's normalizer and pattern treat white space as a boundary that no
    token spans, so a text's ids are those of its pieces between ASCII white
    space in order. A piece of Latin letters and a run of ASCII marks behind
    them is two words to the pattern; all its other pieces go to the library as
    they are. New words go to the library's model among many others, with spaces
    between; each word's last token carries the word-end mark, which tells the
    words' ids apart.
    """

    LETTERS = [*range(0x61, 0x7B), *range(0xDF, 0xF7), *range(0xF8, 0x180)]
    MARKS = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum())
    SIMPLE = r"^[a-z\x{DF}-\x{F6}\x{F8}-\x{17F}]*[!-/:-@\[-`{-~]*$"

    def __init__(self, path: str, words: int = 1_500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = Tokenizer.from_file(path)  # for words that are normalized and split already
        self.model.no_truncation()
        self.model.no_padding()
        self.model.normalizer = None
        self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.n_base = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype("<u2" if self.n_base <= 0x10000 else "<u4")
        self.ends_word = np.zeros(self.n_base, dtype=bool)
        for token, k in self.tokenizer.get_vocab().items():
            self.ends_word[k] = token.endswith("</w>")
        self.letters = "".join(map(chr, self.LETTERS))
        self.words = WordTable(self._new_words, self.kind, words)

    def _library(self, tokenizer, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=self.kind) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _new_words(self, fresh: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids of each word, and all ids."""
        sizes, pool = [], [np.zeros(0, dtype=self.kind)]
        for i in range(0, len(fresh), 5_000):
            part = fresh[i : i + 5_000]
            ids = self._library(self.model, [" ".join(part)])[0]
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) != len(part) or ends[-1] != len(ids):
                each = self._library(self.tokenizer, part)
                ids, ends = np.concatenate(each), np.cumsum([len(x) for x in each])
            sizes.append(np.diff(ends, prepend=0))
            pool.append(ids)
        return np.concatenate([np.zeros(0, dtype=np.int64), *sizes]), np.concatenate(pool)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each has."""
        lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
        coded = lists.values.dictionary_encode()
        pieces = coded.dictionary.cast(pa.string())
        lower = pc.utf8_lower(pieces)
        odd = pc.or_(pc.invert(pc.match_substring_regex(lower, self.SIMPLE)), pc.or_(pc.match_substring(lower, "<|"), pc.match_substring(pieces, "\u0130")))
        simple = ~odd.to_numpy(zero_copy_only=False)
        plain = lower.filter(pc.invert(odd))
        words = pa.concat_arrays([pc.utf8_rtrim(plain, self.MARKS), pc.utf8_ltrim(plain, self.letters)]).dictionary_encode()
        pool, start, size = self.words.look_up(words.dictionary)
        index = words.indices.to_numpy()
        # The pieces' ids: those of the letters, then those of the marks.
        both = np.stack([index[: len(plain)], index[len(plain) :]], axis=1).ravel()
        ids = [gathered(pool, start[both], size[both])]
        length = np.zeros(len(pieces), dtype=np.int64)
        length[simple] = size[both].reshape(-1, 2).sum(axis=1)
        place = np.zeros(len(pieces), dtype=np.int64)
        place[simple] = np.cumsum(length[simple]) - length[simple]
        held_ids = len(ids[0])
        strange = np.flatnonzero(~simple)
        if len(strange):
            each = self._library(self.tokenizer, pieces.take(pa.array(strange)).to_pylist())
            length[strange] = [len(x) for x in each]
            place[strange] = held_ids + np.cumsum(length[strange]) - length[strange]
            ids += each
        at = coded.indices.to_numpy()
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        before = np.concatenate([[0], np.cumsum(length[at])])
        return gathered(np.concatenate(ids), place[at], length[at]), np.diff(before[offsets])


def write_shards(df: DataFrame, path: str, end_id: int = 2, shard_ids: int = 1_000_000, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Encode, order and compress; returns the written table of shards."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seq = held(f"words {path}", lambda: PieceEncoder(path)), TaskContext.get().partitionId(), 0
        docs: list[int | None] = []
        counts, flat = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=encoder.kind)

        def shard(n: int) -> pa.RecordBatch:
            nonlocal docs, counts, flat
            n_ids = int(counts[:n].sum())
            payload = pack(docs[:n], counts[:n], flat[:n_ids], encoder.n_base)
            docs, counts, flat = docs[n:], counts[n:], flat[n_ids:]
            return pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "n_docs": [n], "n_ids": [n_ids], "payload": [payload]})

        for batch in slices(batches, "text", 16 << 20):
            ids, each = encoder.encode(batch.column("text"))
            docs = docs + batch.column("id").to_pylist()
            flat = np.concatenate([flat, np.insert(ids, np.cumsum(each), end_id)])
            counts = np.concatenate([counts, each + 1])
            while (full := int(np.searchsorted(np.cumsum(counts), shard_ids))) < len(counts):
                yield shard(full + 1)
                seq += 1
            tidied()
        if docs:
            yield shard(len(docs))

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    ordered = rows.repartitionByRange("id").sortWithinPartitions("id", "text")
    return written(ordered.mapInArrow(run, SHARD_SCHEMA), "token-shards")


def read_shards(shards: DataFrame) -> DataFrame:
    """One row for each document of the files: ``doc_id, part, seq, position, ids``; position counts ids before it in its shard."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row["payload"])
                whole = shard.whole()
                starts = np.concatenate([[0], shard.id_end])
                for a in range(0, shard.n_docs, 2_000):
                    ks = range(a, min(a + 2_000, shard.n_docs))
                    lists = [whole[starts[k] : starts[k + 1]] for k in ks]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([None if shard.null[k] else int(shard.doc_id[k]) for k in ks], pa.int64()),
                        pa.array([row["part"]] * len(ks), pa.int64()),
                        pa.array([row["seq"]] * len(ks), pa.int64()),
                        pa.array([int(shard.id_end[k]) - len(x) for k, x in zip(ks, lists)], pa.int64()),
                        pa.array([x.astype("<u4").tobytes() for x in lists], pa.binary()),
                    ], ["doc_id", "part", "seq", "position", "ids"])

    return shards.select("part", "seq", "n_ids", "payload").mapInArrow(run, "doc_id long, part long, seq long, position long, ids binary")


def shard_starts(shards: DataFrame) -> DataFrame:
    """``part, seq, start``: ids in all shards before. Partition totals are summed first, so that one task sees a row for each partition only."""
    sizes = shards.select("part", "seq", "n_ids")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("ids")).select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("part_start"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("inner", F.coalesce(F.sum("n_ids").over(within), F.lit(0))).join(parts, "part").select("part", "seq", (F.col("part_start") + F.col("inner")).alias("start"))


def checksums(shards: DataFrame) -> DataFrame:
    """``doc_id, part, seq, position, n_tokens, ids_crc32`` of each document of the files: ``read_shards`` without sending the ids on."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row["payload"])
                whole = shard.whole().astype("<u4", copy=False)
                starts = np.concatenate([[0], shard.id_end])
                n = np.diff(starts)
                crc = [zlib.crc32(whole[a:b]) for a, b in zip(starts.tolist(), starts[1:].tolist())]
                same = [pa.array(np.full(shard.n_docs, row[c], dtype=np.int64)) for c in ("part", "seq")]
                yield pa.RecordBatch.from_arrays([pa.array(shard.doc_id, mask=shard.null.astype(bool)), *same, pa.array(starts[:-1]), pa.array(n), pa.array(crc, pa.int64())], ["doc_id", "part", "seq", "position", "n_tokens", "ids_crc32"])

    return shards.select("part", "seq", "payload").mapInArrow(run, "doc_id long, part long, seq long, position long, n_tokens long, ids_crc32 long")


def op2_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    shards = write_shards(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    rows = checksums(shards).join(shard_starts(shards), ["part", "seq"])
    return rows.select("doc_id", (F.col("start") + F.col("position")).alias("start"), "n_tokens", "ids_crc32")


def crc32_of(ids: np.ndarray) -> int:
    """What ``ids_crc32`` holds for these ids."""
    return zlib.crc32(np.asarray(ids).astype("<u4").tobytes())
