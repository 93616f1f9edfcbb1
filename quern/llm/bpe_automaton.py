"""BPE encoding and decoding by a tokenization automaton.

``TokenAutomaton`` is compiled from a tokenizer's merge list by successive merge
gadgets (Berglund, Martens and van der Merwe; Cognetta and Okazaki). It starts
as one state with an arc for each base symbol. The gadget of merge ``u v -> w``

1. gives a new arc ``w`` to every state that has an arc ``u``, if the target of
   ``u`` has an arc ``v``; it leads to a copy of the target of ``v``;
2. takes the arc ``v`` away from the target of ``u``.

After all gadgets the automaton accepts exactly the token sequences that the
merges produce, and reads each word along one path. All arcs with one label end
in one target, so a state is named by the label that leads to it. Gadgets copy
states by reference (a state is the version of its parent at a merge rank,
minus the arcs cut later), so that compiling is linear in the merges; rows of
the transition table are filled when a text first needs them.

``encode_word`` walks the automaton along a pre-split word: from each state it
takes the longest arc label that the text goes on with and that the table allows,
and steps back from positions where no path goes on. Decoding emits the labels.

Defined results: null and empty texts have no tokens and decode to ''. Special
tokens of the file found in a text are one token each, as the tokenizers
library has them. Rows repeat or tie freely: each row is encoded on its own; no
rows give none. Very long texts are encoded whole, words beyond 64 characters
without a memo.
Other columns, whatever their names, stay outside the operator unless they are
the id column.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import Memo, documents, held, slices, tidied
from quern.llm.word_table import WordTable, gathered

#: The split pattern of byte-level BPE and its byte alphabet ranges.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
PRINTABLE = ((0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF))


def _byte_of_symbol() -> dict[str, int]:
    """The symbol of a printable byte is itself; the others follow from U+0100 on."""
    shown = [b for lo, hi in PRINTABLE for b in range(lo, hi + 1)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class TokenAutomaton:
    """Deterministic automaton over token labels, compiled merge by merge."""

    NEVER = 1 << 60

    def __init__(self, vocab: dict[str, int], merges: Iterable[tuple[str, str]]):
        byte_of = _byte_of_symbol()
        self.label: dict[int, bytes] = {}
        self.born: dict[int, int] = {}  # merge rank that made the arc; base symbols: -1
        self.first: dict[int, int] = {}  # arc u of the gadget
        self.last: dict[int, int] = {}  # arc v of the gadget: its target is what was copied
        self.cut: dict[tuple[int, int], int] = {}  # rank at which a state lost an arc
        self.arcs: dict[bytes, int] = {}  # label to arc, for arcs that exist
        self.reach: dict[bytes, int] = {}  # longest label that begins with four bytes
        self._prefix: dict[int, int | None] = {}
        self._table: Memo = Memo(1 << 18)
        for symbol, byte in byte_of.items():
            if symbol in vocab:
                self._add(vocab[symbol], bytes([byte]), -1)
        for rank, (u, v) in enumerate(merges):
            self._gadget(rank, vocab[u], vocab[v], vocab.get(u + v))

    def _add(self, token: int, label: bytes, rank: int) -> None:
        self.label[token], self.born[token] = label, rank
        self.arcs[label] = token
        if len(label) > 3:
            self.reach[label[:4]] = max(self.reach.get(label[:4], 0), len(label))

    def _gadget(self, rank: int, u: int, v: int, w: int | None) -> None:
        if w is None or u not in self.born or v not in self.born:
            return
        if w not in self.born and self.has_arc(u, v, rank - 1):
            self.first[w], self.last[w] = u, v
            self._add(w, self.label[u] + self.label[v], rank)
        self.cut.setdefault((u, v), rank)

    def has_arc(self, state: int, token: int, rank: int | None = None) -> bool:
        """Whether the state that ``state`` leads to has an arc ``token``, after the gadgets up to ``rank``."""
        rank = self.NEVER - 1 if rank is None else rank
        while True:
            if self.cut.get((state, token), self.NEVER) <= rank:
                return False
            a, b = self.born[state], self.born[token]
            if a < 0 and b < 0:
                return True
            if b >= a:  # the arc came when its gadget found the arc u here
                rank, token = b, self.first[token]
            else:  # the state came as a copy of the target of v, just before this cut
                rank, state = a - 1, self.last[state]

    def step(self, state: int | None, token: int) -> bool:
        """The transition table: the start state has every arc."""
        if state is None:
            return True
        key = (state << 20) | token
        known = self._table.get(key)
        if known is None:
            self._table.make_room(1)
            known = self._table[key] = self.has_arc(state, token)
        return known

    def _longest(self, text: bytes, at: int) -> int | None:
        """The longest arc label that the text has at a position."""
        arcs = self.arcs
        for end in range(min(len(text), at + self.reach.get(text[at : at + 4], 3)), at, -1):
            token = arcs.get(text[at:end])
            if token is not None:
                return token
        return None

    def _shorter(self, token: int) -> int | None:
        """The next shorter arc label that begins this one."""
        known = self._prefix.get(token, -1)
        if known == -1:
            label, known = self.label[token], None
            for end in range(len(label) - 1, 0, -1):
                if (known := self.arcs.get(label[:end])) is not None:
                    break
            self._prefix[token] = known
        return known

    def encode_word(self, word: bytes) -> list[int]:
        """Tokens of one pre-split word: the one accepting path that spells it.

        The longest arc is tried first; a position from which no path goes on is
        marked and never entered again, so the work is bounded by the word's
        length times the labels ending in each position.
        """
        whole = self.arcs.get(word)
        if whole is not None:
            return [whole]
        n, label, step = len(word), self.label, self.step
        path: list[int] = []
        dead: set[int] = set()
        at = 0
        token = self._longest(word, 0)
        while at < n:
            last = path[-1] if path else None
            while token is not None:
                end = at + len(label[token])
                if end not in dead and step(last, token):
                    break
                token = self._shorter(token)
            if token is not None:
                path.append(token)
                at = end
                token = self._longest(word, at) if at < n else None
            elif path:
                dead.add(at)
                token = path.pop()
                at -= len(label[token])
                token = self._shorter(token)
            else:
                raise ValueError("the vocabulary has no arc for a byte of the text")
        return path

    def emit(self, tokens: Iterable[int]) -> bytes:
        """Arc labels of a path."""
        label = self.label
        return b"".join([label[t] for t in tokens])


class ByteBPE:
    """Whole texts to ids and back, with a tokenizer file of byte-level BPE.

    Texts are split at single spaces; distinct pieces are looked at once a batch.
    A piece of Latin letters and a run of ASCII marks behind them is two words to
    the file's pattern, the first with the space before it; words have their ids
    in a table that the automaton fills. All other pieces go through the pattern
    as they are. Texts with runs of spaces or special tokens are split by the
    pattern whole.
    """

    LATIN = "".join(chr(c) for c in [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x180)] if c not in (0xD7, 0xF7))
    MARKS = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum())
    SIMPLE = r"^[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{17F}]*[!-/:-@\[-`{-~]*$"

    def __init__(self, path: str, words: int = 1_500_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [m.split(" ", 1) if isinstance(m, str) else m for m in model["merges"]]
        self.automaton = TokenAutomaton(model["vocab"], merges)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self._special_text = {v: k.encode() for k, v in self.special.items()}
        self._at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._split = regex.compile(SPLIT)
        self._labels = {**self.automaton.label, **self._special_text}
        self.words = WordTable(self._learn, np.dtype("<i4"), words)
        self._pieces: Memo = Memo(50_000)
        top = max(self._labels, default=0) + 1
        sizes = np.zeros(top, dtype=np.int64)
        for token, label in self._labels.items():
            sizes[token] = len(label)
        self._label_size, self._label_start = sizes, np.cumsum(sizes) - sizes
        self._label_pool = np.frombuffer(b"".join([self._labels.get(token, b"") for token in range(top)]), dtype=np.uint8)

    def _learn(self, fresh: list[str]) -> tuple[np.ndarray, np.ndarray]:
        walk = self.automaton.encode_word
        sizes, ids = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int32)]
        for i in range(0, len(fresh), 20_000):
            found = [walk(w.encode()) for w in fresh[i : i + 20_000]]
            sizes.append(np.fromiter(map(len, found), np.int64, len(found)))
            ids.append(np.fromiter(chain.from_iterable(found), np.int32))
        return np.concatenate(sizes), np.concatenate(ids)

    def _piece(self, piece: str) -> np.ndarray:
        known = self._pieces.get(piece)
        if known is None:
            walk = self.automaton.encode_word
            known = np.array([t for w in self._split.findall(piece) for t in walk(w.encode())], dtype=np.int32)
            if len(piece) <= self._pieces.KEY:
                self._pieces.make_room(1)
                self._pieces[piece] = known
        return known

    def _whole(self, text: str) -> np.ndarray:
        """A text with special tokens or runs of spaces."""
        out = []
        for i, part in enumerate(self._at_special.split(text) if self._at_special is not None else [text]):
            if i % 2:
                out.append(np.array([self.special[part]], dtype=np.int32))
            elif "  " in part:
                out.append(self._piece(part))
            elif part:
                head, *rest = part.split(" ")
                out += [self._piece(head), *[self._piece(" " + x) for x in rest]]
        return np.concatenate([np.zeros(0, dtype=np.int32), *out])

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each has."""
        texts = texts.cast(pa.large_string()).fill_null("")
        odd_text = pc.match_substring(texts, "  ")
        for s in self.special:
            odd_text = pc.or_(odd_text, pc.match_substring(texts, s))
        empty = pc.equal(texts, "")
        lists = pc.split_pattern(pc.if_else(pc.or_(odd_text, empty), pa.scalar("", pa.large_string()), texts), " ")
        coded = lists.flatten().dictionary_encode()
        offsets = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
        spaced = np.ones(offsets[-1], dtype=np.int64)
        spaced[offsets[:-1]] = 0  # the first piece of a text has no space before it
        key = coded.indices.to_numpy().astype(np.int64) * 2 + spaced
        used = np.zeros(2 * len(coded.dictionary), dtype=bool)
        used[key] = True
        keys = np.flatnonzero(used)
        place = np.cumsum(used) - 1
        pieces = coded.dictionary.cast(pa.string()).take(pa.array(keys >> 1))
        space = (keys & 1).astype(bool)
        simple = pc.and_(pc.match_substring_regex(pieces, self.SIMPLE), pc.not_equal(pieces, "")).to_numpy(zero_copy_only=False)
        plain = pieces.filter(pa.array(simple))
        letters, marks = pc.utf8_rtrim(plain, self.MARKS), pc.utf8_ltrim(plain, self.LATIN)
        bare = pc.equal(letters, "")
        blank = pc.if_else(pa.array(space[simple]), " ", "")
        first = pc.binary_join_element_wise(blank, pc.if_else(bare, marks, letters), "")
        words = pa.concat_arrays([first, pc.if_else(bare, "", marks)]).dictionary_encode()
        pool, start, size = self.words.look_up(words.dictionary)
        index = words.indices.to_numpy()
        both = np.stack([index[: len(plain)], index[len(plain) :]], axis=1).ravel()
        ids = [gathered(pool, start[both], size[both])]
        length = np.zeros(len(keys), dtype=np.int64)
        length[simple] = size[both].reshape(-1, 2).sum(axis=1)
        at = np.zeros(len(keys), dtype=np.int64)
        at[simple] = np.cumsum(length[simple]) - length[simple]
        strange = np.flatnonzero(~simple)
        if len(strange):
            made = [self._piece(" " + x if s else x) for x, s in zip(pieces.take(pa.array(strange)).to_pylist(), space[strange].tolist())]
            length[strange] = [len(x) for x in made]
            at[strange] = len(ids[0]) + np.cumsum(length[strange]) - length[strange]
            ids += made
        which = place[key]
        flat = gathered(np.concatenate(ids), at[which], length[which])
        counts = np.diff(np.concatenate([[0], np.cumsum(length[which])])[offsets])
        if pc.any(odd_text).as_py():
            rows = np.flatnonzero(odd_text.to_numpy(zero_copy_only=False))
            ends = np.cumsum(counts)
            parts, done = [], 0
            for r in rows.tolist():  # these were empty texts up to here
                own = self._whole(texts[r].as_py())
                parts += [flat[done : ends[r]], own]
                done, counts[r] = int(ends[r]), len(own)
            flat = np.concatenate([*parts, flat[done:]])
        return flat, counts

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text."""
        return self.encode_batch(pa.array([text], pa.string()))[0]

    def decode_batch(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """Texts of runs of ids: the labels, one after the other. Broken UTF-8 becomes U+FFFD."""
        raw = gathered(self._label_pool, self._label_start[ids], self._label_size[ids])
        ends = np.concatenate([[0], np.cumsum(self._label_size[ids])])[np.concatenate([[0], np.cumsum(counts)])]
        out = pa.LargeStringArray.from_buffers(len(counts), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(raw.tobytes()))
        try:
            out.validate(full=True)
        except pa.ArrowInvalid:
            data = raw.tobytes()
            out = pa.array([data[a:b].decode("utf-8", "replace") for a, b in zip(ends.tolist(), ends[1:].tolist())], pa.large_string())
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """Ids that the file does not have are left out."""
        known = np.array([i for i in ids if i in self._labels], dtype=np.int64)
        return self.decode_batch(known, np.array([len(known)]))[0].as_py()


def loaded(path: str) -> ByteBPE:
    """One compiled automaton for each Python worker and file."""
    return held(f"byte-bpe {path}", lambda: ByteBPE(path))


def row_ranges(counts: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of rows of about ``most`` ids, one row at least."""
    part = (np.cumsum(counts) - counts) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(counts)]
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if a < b]


def encode_decode(df: DataFrame, path: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``id_col``, ``ids`` (array of int) and ``decoded`` of each row; no shuffle, one pass."""
    kind = df.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in slices(batches, "text", 4 << 20):
            ids, counts = bpe.encode_batch(batch.column("text"))
            ends = np.concatenate([[0], np.cumsum(counts)])
            decoded = bpe.decode_batch(ids, counts)
            for a, b in row_ranges(counts, 1 << 20):  # what goes to the JVM at once
                flat = pa.array(ids[ends[a] : ends[b]])
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), pa.ListArray.from_arrays(pa.array((ends[a : b + 1] - ends[a]).astype(np.int32)), flat), decoded.slice(a, b - a).cast(pa.string())], ["id", "ids", "decoded"])
            del ids, counts, ends, decoded, flat
            tidied()

    rows = df.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind.simpleString()}, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def token_lengths(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``n_tokens`` (long) of each row, nothing else; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in slices(batches, "text", 8 << 20):
            yield pa.RecordBatch.from_arrays([pa.array(bpe.encode_batch(batch.column("text"))[1])], ["n_tokens"])
            tidied()

    return df.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "n_tokens long")


def digests(encoded: DataFrame, id_col: str = "doc_id", keep: Iterable[str] = ()) -> DataFrame:
    """Counts and checksums of ``encode_decode``'s rows, and the columns to ``keep``."""
    return encoded.select(
        id_col,
        *keep,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode_decode(documents(spark, sf_dir), default_path()))
